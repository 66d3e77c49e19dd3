import pytest

from sparkloom.plans import catalog
from tests import oracle


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, name):
    found = catalog.QUERIES[name](spark, oracle.SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = oracle.connection().execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert oracle.rows(found) == oracle.rows(want)
