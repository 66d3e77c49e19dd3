import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import identity, scores, text
from sparkloom.operators import cache, filters, mining
from sparkloom.plans import runs, stages
from sparkloom.plans.config import Criterion, Prompt, PromptPack, Rubric, Sampling
from sparkloom.sources import environment, tables
from sparkloom.streaming import ingest


def test_null_rules_of_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    ids = lambda d: sorted(r["n"] for r in d.collect())
    assert ids(filters.filter_rows(df, "s", "eq", None)) == [2]
    assert ids(filters.filter_rows(df, "s", "ne", "a")) == [2, 3]
    assert ids(filters.filter_rows(df, "s", "contains", "a")) == [1]
    for field, op in (("", "eq"), ("n", "like"), ("x", "eq")):
        with pytest.raises(ValueError):
            filters.filter_rows(df, field, op, 1)


def test_synth_filter_order_of_reasons(spark):
    df = spark.createDataFrame([(None, "hello world"), (0.1, "x"), (0.9, "x"), (0.9, None), (0.9, "Ünïcödé BAD")], "score double, t string")
    out = filters.annotate_filtered(df, "score", "t", 0.5, 2, 11, ("bad",))
    assert [r["filter_reason"] for r in out.collect()] == [None, "low_score", "too_short", "too_short", "banned: bad"]
    assert filters.remove_filtered(out).count() == 1


def test_filter_is_pushed_to_the_scan(spark):
    df = filters.filter_rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "lang", "eq", "en").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualNullSafe(lang,en)]" in plan and "text" not in plan


def test_ids_and_seeds(spark):
    df = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), (None, "")], "x string, y string")
    out = df.select(identity.short_hash(F.col("x"), F.col("y")).alias("h"), identity.seed(F.col("x")).alias("s"), identity.row_id(F.lit("file"), F.col("x"), text=F.col("y")).alias("r")).collect()
    assert len({r["h"] for r in out}) == 3 and all(0 <= r["s"] < 2**32 for r in out)
    assert all(r["r"].startswith("row_") and len(r["r"]) == 20 for r in out)


def test_vectors_and_hardness(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], 0.0)], "a array<double>, z array<double>, e double")
    r = df.select(
        scores.cosine(F.col("a"), F.col("a")), scores.cosine(F.col("a"), F.col("z")), scores.normalized(F.col("a")), scores.normalized(F.col("z")),
        scores.similarity_hardness(F.lit(1.0), 1.0), scores.similarity_hardness(F.lit(-0.5)), scores.uncertainty_hardness(F.lit(0.4), F.col("e")),
        scores.weighted_mean({"a": F.lit(1.0), "b": F.lit(None).cast("double")}, {"b": 1.0}), scores.combined_score(F.lit(1.0), F.lit(0.0), 0, 0),
    ).first()
    assert [r[0], r[1], list(r[2]), list(r[3])] == [1.0, 0.0, [0.6, 0.8], [0.0, 0.0]]
    assert [r[4], r[5], r[6], r[7], r[8]] == [1.0, 0.0, pytest.approx(0.3), 0.0, 0.0]


def test_parsing(spark):
    raw = ['```json\n{"a": 1}\n```', '{"a": ', "[1]", None, "Answer: Output: x"]
    df = spark.createDataFrame([(x,) for x in raw], "t string")
    out = df.select(text.is_json_object(text.unfenced(text.generated(F.col("t")))).alias("ok"), text.cleaned(F.col("t")).alias("c"), text.missing_fields(text.unfenced(F.col("t")), ["b", "a"]).alias("m")).collect()
    assert [r["ok"] for r in out] == [True, False, False, False, False]
    assert out[4]["c"] == "x" and out[0]["m"] == ["b"] and out[2]["m"] == ["a", "b"]
    with pytest.raises(KeyError):
        text.rendered("{x}", {})


def test_class_zero_is_a_class(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [1.0, 0.1], 0), ("c", [1.0, 0.2], None), ("d", [0.0, 0.0], 1)], "row_id string, embedding array<double>, label int")
    got = {(r["anchor"], r["candidate"]) for r in mining.candidates(df, low=0.5).collect()}
    assert got == {("a", "c"), ("c", "a"), ("b", "c"), ("c", "b")}


def test_candidates_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(90)], "row_id long, embedding array<double>, label int")
    whole = sorted(mining.candidates(df, top_k=7, low=0.1).collect())
    monkeypatch.setattr(mining, "BLOCK", 20)
    assert sorted(mining.candidates(df, top_k=7, low=0.1).collect()) == whole


def test_first_list_wins_in_a_merge(spark):
    a = spark.createDataFrame([("x", "y", 0.5)], "anchor string, candidate string, similarity double")
    b = spark.createDataFrame([("x", "y", 0.9), ("x", "z", 0.7)], "anchor string, candidate string, similarity double")
    assert [(r["candidate"], r["similarity"], r["rank"]) for r in mining.merge_lists([a, b]).orderBy("rank").collect()] == [("z", 0.7, 1), ("y", 0.5, 2)]


def test_selection_ties_and_report(spark):
    pairs = spark.createDataFrame([("a", "y", 0.8), ("a", "x", 0.8), ("b", "q", 0.6)], "anchor string, candidate string, similarity double")
    hard = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "id string, hardness double")
    got = mining.select_negatives(pairs, hard)
    assert [(r["negative"], r["selection_rank"]) for r in got.orderBy("selection_rank").collect()] == [("x", 1), ("y", 2)]
    assert mining.report(got).splitlines()[0] == "anchor a"
    ranks = mining.rank_by_hardness(hard.withColumnRenamed("id", "row_id")).orderBy("rank").collect()
    assert [r["row_id"] for r in ranks] == ["y", "x"]


def test_dataset_hash_is_free_of_order(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    assert cache.dataset_hash(df).first() == cache.dataset_hash(df.repartition(7).orderBy(F.desc("a"))).first()


def _backend():
    return stages.RuleBackend(lambda s: json.dumps({"labels": ["en" if "the" in s else "xx"]}))


def test_run_resume_replay(spark, tmp_path):
    data = spark.createDataFrame([("1", "the cat"), ("2", "le chat")], "row_id string, text string")
    g = runs.Graph("g").add(stages.label("label", ("en", "xx"))).add(stages.row_filter("keep", "label_primary", "eq", "en"), "label")
    ctx = stages.Context(backend=_backend())
    m = runs.run(g, data, str(tmp_path / "a"), ctx)
    assert m.status == "complete" and [s["rows"] for s in m.stages] == [2, 1] and not m.problems()
    again = runs.run(g, data, str(tmp_path / "b"), ctx)
    assert runs.verify(m, again) == [] and m.hash() == again.hash() == runs.Manifest.load(str(tmp_path / "a")).hash()
    assert runs.plan_resume(g, m) == [] and runs.plan_resume(g, None) == ["label", "keep"]
    plan = runs.plan_replay(m, "selective", ("label",))
    assert plan.execute == ("label", "keep") and runs.plan_replay(m, "full_cache").cached == ("label", "keep")
    only = runs.run(g, data, str(tmp_path / "a"), ctx, only={"keep"})
    assert only.stages[1]["rows"] == 1


def test_graph_order_and_errors():
    s = lambda n: stages.Stage(n, "transform")
    g = runs.Graph("d").add(s("a")).add(s("b"), "a", "a").add(s("c"), "a").add(s("d"), "b", "c")
    assert g.order() == ["a", "b", "c", "d"] and g.downstream("b") == {"d"} and g.upstream("d") == {"a", "b", "c"}
    with pytest.raises(ValueError):
        g.add(s("e"), "zzz")
    with pytest.raises(ValueError):
        g.add(s("a"))


def test_a_failing_row_does_not_fail_the_others(spark):
    def rule(x):
        if x == "bad":
            raise RuntimeError("no")
        return x.upper()

    df = spark.createDataFrame([("bad",), ("ok",)], "request string").withColumn("sampling_params", F.create_map(F.lit("a"), F.lit("b")))
    got = {r["request"]: (r["generated_text"], r["error"]) for r in stages.infer(df, stages.RuleBackend(rule)).collect()}
    assert got == {"bad": (None, "RuntimeError: no"), "ok": ("OK", None)}


def test_rubric_falls_back_to_the_weighted_mean(spark):
    r = Rubric("q", (Criterion("a", weight=1.0), Criterion("b", weight=3.0)))
    said = ['{"scores": {"a": 4}, "overall_score": "n/a"}', '{"scores": {}, "overall_score": 7}', "[1]", "oops"]
    df = spark.createDataFrame([(str(i), "", s) for i, s in enumerate(said)], "row_id string, text string, generated_text string")
    out = stages.rubric("r", r).transform(df).orderBy("row_id").collect()
    assert [(x["overall_score"], x["parse_error"]) for x in out] == [(1.0, False), (7.0, False), (0.0, True), (0.0, True)]


def test_retry_and_sweeps():
    calls = []

    def f():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "x"

    assert runs.Retry(3).call(f, sleep=lambda s: None) == "x"
    with pytest.raises(ValueError):
        runs.Retry(3).call(lambda: int("x"))
    assert runs.Retry(jitter=0).delay(10) == 60.0
    v = runs.Matrix("m", {"a": {"b": 1, "c": 2}}, {"a.b": [5, 6], "t": 0.5}).expand()
    assert [x["config"] for x in v] == [{"a": {"b": 5, "c": 2}, "t": 0.5}, {"a": {"b": 6, "c": 2}, "t": 0.5}]
    assert runs.Matrix("m", {}, {"a": []}).expand() == []
    assert runs.parse_overrides("a=1, b=true c=0.5 d=x") == {"a": 1, "b": True, "c": 0.5, "d": "x"}


def test_tables_and_schemas(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    for kind in ("parquet", "jsonl", "csv"):
        path = str(tmp_path / f"t.{kind}")
        tables.write_table(df, path, kind)
        assert tables.read_table(spark, path, kind, df.schema).count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t.parquet"), "parquet", spark.createDataFrame([], "zz int").schema)
    with pytest.raises(ValueError):
        tables.format_of("x", "xml")
    path = str(tmp_path / "d" / "m.jsonl")
    tables.write_json_lines([{"b": 1, "a": {2}}], path)
    tables.write_json_lines([{"c": b"\x01"}], path, append=True)
    assert tables.read_json_lines(path) == [{"a": [2], "b": 1}, {"c": "01"}]
    assert len(tables.schema_problems(df.schema, spark.createDataFrame([], "n int, x int").schema, True)) == 3
    assert tables.schema_fingerprint(df.schema) != tables.schema_fingerprint(df.select("s", "n").schema)


def test_prompts_and_sampling(tmp_path):
    pack = PromptPack("p", "1", {"a": Prompt("a", "Say {x}", shots=(("q", "r"),), required=("x", "y"))}, {"r": Rubric("r", (Criterion("c"),))})
    pack.save(str(tmp_path / "p.yaml"))
    assert PromptPack.load(str(tmp_path / "p.yaml")).hash() == pack.hash()
    assert pack.resolve("a").problems() == ["y is not in the template"]
    with pytest.raises(ValueError):
        Sampling(temperature=3)
    assert Sampling(top_p=0.5).params() == {"top_p": 0.5}
    assert "spark" not in environment.snapshot()


def test_stream_drops_repeats(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.unionByName(df.limit(100)).write.parquet(str(tmp_path / "in"))
    s = ingest.rows(spark, str(tmp_path / "in"), df.schema, ["event_id"], "ts")
    ingest.to_table(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()


def test_a_second_run_asks_for_nothing(spark, tmp_path):
    data = spark.createDataFrame([("1", "the cat"), ("2", "le chat"), ("3", None)], "row_id string, text string")
    g = runs.Graph("g").add(stages.label("label", ("en", "xx"))).add(stages.row_filter("keep", "label_primary", "eq", "en"), "label")
    store = str(tmp_path / "cache")
    first = runs.run(g, data, str(tmp_path / "a"), stages.Context("one", backend=_backend()), seed=5, cache_path=store)
    again, differ = runs.replay(g, data, str(tmp_path / "a"), str(tmp_path / "b"), "verify", ctx=stages.Context("two", backend=_backend()), cache_path=store)
    assert (first.stages[0]["hits"], first.stages[0]["misses"]) == (0, 3)
    assert (again.stages[0]["hits"], again.stages[0]["misses"], again.stages[0]["hit_rate"]) == (3, 0, 1.0) and differ == []
    other = runs.run(g, data, str(tmp_path / "c"), stages.Context("one", backend=_backend()), seed=6)
    assert runs.verify(first, other) != []  # other seeds, other sampling parameters
    part, differ = runs.replay(g, data, str(tmp_path / "a"), str(tmp_path / "d"), "selective", ("keep",), stages.Context("x"))
    assert [s["seconds"] > 0 for s in part.stages] == [False, True] and differ == []
    records = spark.read.parquet(str(tmp_path / "b" / "records"))
    assert {r["status"] for r in records.collect()} == {"cached"} and records.where("output_hash is null").count() == 0
    assert cache.clear(spark, store, "label") and not cache.clear(spark, store, "label")
    assert runs.resume(g, data, str(tmp_path / "a"), stages.Context("one")).status == "complete"


def test_lineage_of_a_long_chain_and_a_cycle(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(70)] + [(0, 70), (200, 199), (None, 3), (4, None)], "row_id long, source_row_id long")
    got = [r["row_id"] for r in cache.downstream_rows(edges, spark.createDataFrame([(5,), (5,), (None,)], "row_id long")).collect()]
    assert sorted(got) == list(range(71))


def test_seeds_are_checked():
    for bad in (-1, 1 << 32, "3", True, None):
        with pytest.raises(ValueError):
            identity.validate_seed(bad)
    assert identity.SeedPolicy(7).seed() == 7 and 0 <= identity.SeedPolicy(None).seed() < 1 << 32


def test_run_by_command(spark, tmp_path, capsys):
    import yaml

    from sparkloom import cli

    spark.createDataFrame([("1", "the cat", 3), ("2", "le chat", 9)], "row_id string, text string, score int").write.parquet(str(tmp_path / "in.v1.2"))
    config = {"name": "c", "data": str(tmp_path / "in.v1.2"), "stages": [{"kind": "row_filter", "name": "low", "params": {"field": "score", "operator": "lt", "value": 5}}]}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config))
    assert cli.main(["run", str(tmp_path / "c.yaml"), str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["stages"] == [["low", 1, "complete"]]
