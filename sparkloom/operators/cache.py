"""The result cache as a table: lookup, statistics, validity, vacuum, lineage.

Entries: stage_name, key, row_id, prompt_hash, model_hash, sampling_hash, value, output_hash, size_bytes, access_count. The table is
partitioned by stage_name; all operations are joins on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources import shared

HASHES = ("prompt_hash", "model_hash", "sampling_hash")


def hits(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(cache.select(key, "value", "output_hash"), key)


def misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(cache, key, "left_anti")


def put(new: DataFrame, path: str) -> None:
    """Add entries to a cache table; a stage's files lie in one folder."""
    new.write.mode("append").partitionBy("stage_name").parquet(path)


def latest(cache: DataFrame) -> DataFrame:
    """One entry for each key: the last created."""
    from sparkloom.operators.mining import ranked

    return ranked(cache, ["key"], [F.desc("created_at"), F.desc("output_hash")], 1, "at").drop("at")


def stats(cache: DataFrame) -> DataFrame:
    """Entries and bytes of each stage, and of all (null stage_name)."""
    return cache.rollup("stage_name").agg(F.count(F.lit(1)).alias("entries"), F.sum("size_bytes").alias("bytes"))


def hit_rate(records: DataFrame) -> DataFrame:
    """Hits, misses and hits / (hits + misses) of each stage of row records; 0 where there are none."""
    hit, miss = F.count_if(F.col("status") == "cached"), F.count_if(F.col("status") == "success")
    return records.groupBy("stage_name").agg(hit.alias("hits"), miss.alias("misses"), F.coalesce(F.try_divide(hit.cast("double"), (hit + miss).cast("double")), F.lit(0.0)).alias("hit_rate"))


def valid(cache: DataFrame, current: DataFrame) -> DataFrame:
    """Entries whose stage still has the same prompt, model and sampling hashes."""
    return cache.join(current.select("stage_name", *HASHES), ["stage_name", *HASHES], "left_semi")


def intact(cache: DataFrame) -> DataFrame:
    """Entries with a flag: the value is there and has the hash that was recorded."""
    return cache.withColumn("intact", F.coalesce(F.md5(F.col("value").cast("binary")) == F.col("output_hash"), F.lit(False)))


def orphans(blobs: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Stored values that no entry names."""
    return blobs.join(cache, key, "left_anti")


def clear_stage(cache: DataFrame, stage: str) -> DataFrame:
    return cache.where(~F.col("stage_name").eqNullSafe(F.lit(stage)))


def clear(spark: SparkSession, path: str, stage: str | None = None) -> bool:
    """Remove the entries of a stage, or all, from a cache table; False where there were none."""
    if stage is None:
        return shared.delete(spark, path)
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(stage)
    return shared.delete(spark, f"{path.rstrip('/')}/stage_name={name}")


def entry(cache: DataFrame, key: str) -> DataFrame:
    """The last entry of one key: no row if there is none."""
    return latest(cache.where(F.col("key") == key))


def without(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The entries whose key is not among ``keys``."""
    return cache.join(keys.select("key"), "key", "left_anti")


def accessed(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """The entries with access_count raised by the lookups of ``wanted`` (column key, a row a lookup)."""
    looked = wanted.groupBy("key").agg(F.count(F.lit(1)).alias("_looked"))
    return cache.join(looked, "key", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_looked", F.lit(0))).drop("_looked").select(*cache.columns)


def downstream_rows(lineage: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids of all rows made from changed ones, and of those (column row_id): lineage is (row_id, source_row_id).

    One join of the written frontier for each step of the lineage, until a step reaches no new row; cycles end there too.
    """
    edges = lineage.select("row_id", F.col("source_row_id").alias("_from")).where("row_id is not null and _from is not null")
    frontier = shared.written(changed.select("row_id").where("row_id is not null").distinct(), "lineage")
    reached = frontier
    while frontier.take(1):
        step = edges.join(frontier.select(F.col("row_id").alias("_from")), "_from").select("row_id").distinct()
        frontier = shared.written(step.join(reached, "row_id", "left_anti"), "lineage")
        reached = reached.unionAll(frontier)
    return reached


def dataset_hash(df: DataFrame, *columns: str) -> DataFrame:
    """(n_rows, content_hash): a hash that doesn't depend on the order of rows.

    Row hashes are summed in four 32-bit parts, so the aggregation is partial on every task and no list is gathered.
    """
    from sparkloom.functions.identity import row_hash

    h = row_hash(*(columns or df.columns))
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), *parts)
    return sums.select("n_rows", F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0")) for i in range(4)]).cast("binary")).alias("content_hash"))
