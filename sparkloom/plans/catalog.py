"""Registered queries over the shared tables, and the SQL that gives the same rows.

A query applies its operator to whole tables. Each SQL text stands beside its query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import identity as ids
from sparkloom.functions import scores, text
from sparkloom.operators import cache, filters, mining
from sparkloom.plans import runs, stages
from sparkloom.plans.config import Criterion, Rubric
from sparkloom.sources import shared, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lp(*parts: str) -> str:
    """SQL of ``identity.joined``."""
    return " || ".join(f"length(coalesce(CAST({p} AS VARCHAR), '')) || ':' || coalesce(CAST({p} AS VARCHAR), '')" for p in parts)


def _md5(*parts: str, width: int = 32) -> str:
    return f"substr(md5({_lp(*parts)}), 1, {width})"


def _seed(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5({_lp(*parts)}), 1, 8)) AS BIGINT)"


# filters, sampling, limits -----------------------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE lang IS NOT DISTINCT FROM 'en'")
def filter_eq(spark, sf_dir):
    return filters.filter_rows(table(spark, sf_dir, "documents"), "lang", "eq", "en").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en'")
def filter_ne(spark, sf_dir):
    return filters.filter_rows(table(spark, sf_dir, "documents"), "lang", "ne", "en").select("doc_id", "lang")


@query("SELECT doc_id, n_chars FROM documents WHERE coalesce(n_chars, 0) < 500")
def filter_lt(spark, sf_dir):
    return filters.filter_rows(table(spark, sf_dir, "documents"), "n_chars", "lt", 500).select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE coalesce(n_chars, 0) > 5000")
def filter_gt(spark, sf_dir):
    return filters.filter_rows(table(spark, sf_dir, "documents"), "n_chars", "gt", 5000).select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE coalesce(contains(text, 'the '), false)")
def filter_contains(spark, sf_dir):
    return filters.filter_rows(table(spark, sf_dir, "documents"), "text", "contains", "the ").select("doc_id")


@query("SELECT doc_id, quality FROM labels WHERE coalesce(quality, 0) < 1")
def filter_stage_config(spark, sf_dir):
    return stages.row_filter("low_quality", "quality", "<", 1).transform(table(spark, sf_dir, "labels")).select("doc_id", "quality")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def limit_first_rows(spark, sf_dir):
    return filters.first_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), 100, "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 200")
def sample_exact(spark, sf_dir):
    return filters.sample_exact(table(spark, sf_dir, "documents").select("doc_id"), 200, "doc_id", 42)


@query()
def sample_bernoulli(spark, sf_dir):
    return filters.sample_rows(table(spark, sf_dir, "documents").select("doc_id"), 200, 42)


@query("SELECT count(*) AS n_rows FROM documents")
def count_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_rows"))


_REASON = """CASE WHEN l.quality < 1 THEN 'low_score' WHEN length(coalesce(d.text, '')) < 200 THEN 'too_short' WHEN length(coalesce(d.text, '')) > 20000 THEN 'too_long'
 WHEN contains(lower(d.text), 'worthless') THEN 'banned: worthless' WHEN contains(lower(d.text), 'http') THEN 'banned: HTTP' END"""
_REASONED = f"SELECT d.doc_id, {_REASON} AS filter_reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _filtered(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return filters.annotate_filtered(rows, "quality", "text", 1, 200, 20000, ("worthless", "HTTP"))


@query(f"SELECT doc_id, filter_reason, filter_reason IS NOT NULL AS filtered FROM ({_REASONED})")
def synth_filter_annotate(spark, sf_dir):
    return _filtered(spark, sf_dir).select("doc_id", "filter_reason", "filtered")


@query(f"SELECT doc_id FROM ({_REASONED}) WHERE filter_reason IS NULL")
def synth_filter_remove(spark, sf_dir):
    return filters.remove_filtered(_filtered(spark, sf_dir)).select("doc_id")


# identity ----------------------------------------------------------------------------------------------------------

_TEXT_HASH = "substr(md5(text), 1, 16)"
_ROW_ID = f"'row_' || {_md5(chr(39) + 'dataset' + chr(39), 'source', 'doc_id', 'NULL', _TEXT_HASH, width=16)}"


def _row_id():
    return ids.row_id(F.lit("dataset"), F.col("source"), F.col("doc_id"), None, F.col("text"))


@query(f"SELECT doc_id, {_ROW_ID} AS row_id, {_TEXT_HASH} AS text_hash FROM documents")
def row_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _row_id().alias("row_id"), ids.content_hash(F.col("text")).alias("text_hash"))


@query(f"SELECT doc_id, true AS valid_id, false AS valid_raw FROM documents WHERE {_ROW_ID} IS NOT NULL")
def validate_row_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.is_row_id(_row_id()).alias("valid_id"), ids.is_row_id(F.col("doc_id").cast("string")).alias("valid_raw"))


@query(f"SELECT doc_id, 'row_' || {_md5(_ROW_ID, chr(39) + 'part' + chr(39), width=16)} AS child_id, 'synth_' || {_md5(_ROW_ID, chr(39) + 'qa' + chr(39), '0', width=12)} AS synth_id FROM documents")
def child_ids(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select("doc_id", _row_id().alias("r"))
    return r.select("doc_id", ids.child_id(F.col("r"), F.lit("part")).alias("child_id"), ids.synth_id(F.col("r"), F.lit("qa"), F.lit(0)).alias("synth_id"))


@query(f"SELECT doc_id, {_seed(chr(39) + 'stage' + chr(39), chr(39) + 'run' + chr(39), 'source')} AS stage_seed, {_seed(chr(39) + 'row' + chr(39), chr(39) + 'label' + chr(39), 'doc_id')} AS row_seed, {_seed(chr(39) + 'sample' + chr(39), 'doc_id', '1')} AS sample_seed FROM documents")
def seeds(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "documents").select("doc_id", ids.stage_seed(F.lit("run"), c("source")).alias("stage_seed"), ids.row_seed(F.lit("label"), c("doc_id")).alias("row_seed"), ids.sample_seed(c("doc_id"), F.lit(1)).alias("sample_seed"))


_KEY = _md5("'label'", "doc_id", "'p1'", "'m1'", "'s1'")


def _keyed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang", "n_chars")
    return d.withColumn("key", ids.cache_key(F.lit("label"), F.col("doc_id"), F.lit("p1"), F.lit("m1"), F.lit("s1")))


@query(f"SELECT doc_id, {_KEY} AS key, substr({_KEY}, 1, 4) AS prefix FROM documents")
def cache_keys(spark, sf_dir):
    return _keyed(spark, sf_dir).select("doc_id", "key", ids.key_prefix(F.col("key")).alias("prefix"))


_ROW_HASH = "md5(" + _lp("'lang'", "CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END", "'source'", "CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END") + ")"


@query(f"SELECT doc_id, {_ROW_HASH} AS input_hash FROM documents")
def row_input_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.row_hash("source", "lang").alias("input_hash"))


_PARTS = ", ".join(f"CAST(coalesce(sum(CAST(('0x' || substr(h, {1 + 8 * i}, 8)) AS HUGEINT)), 0) AS VARCHAR) AS p{i}" for i in range(4))


@query(f"SELECT n_rows, md5(p0 || '|' || p1 || '|' || p2 || '|' || p3) AS content_hash FROM (SELECT count(*) AS n_rows, {_PARTS} FROM (SELECT {_ROW_HASH} AS h FROM documents))")
def dataset_content_hash(spark, sf_dir):
    return cache.dataset_hash(table(spark, sf_dir, "documents"), "source", "lang")


# text and JSON -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NOT coalesce(json_valid(props), false) AS parse_error FROM events")
def parse_json_output(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", text.unfenced(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("j"))
    return e.select("event_id", text.field(F.col("j"), "k").cast("bigint").alias("k"), (~text.is_json_object(F.col("j"))).alias("parse_error"))


@query("SELECT event_id, list_sort(list_filter(['k', 'z', 'a'], lambda x: NOT list_contains(json_keys(props), x))) AS missing FROM events")
def validate_json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.missing_fields(F.col("props"), ["k", "z", "a"]).alias("missing"))


@query("SELECT event_id, ltrim(substr('Answer: ' || event_type, 8)) AS cleaned, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS json FROM events")
def clean_and_canonical(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return e.select("event_id", text.cleaned(F.concat(F.lit("  Answer: "), "event_type", F.lit(" "))).alias("cleaned"), text.canonical_json(["event_type", "event_id"]).alias("json"))


@query("SELECT doc_id, 'Label {x} in ' || lang || ' from ' || source || ':' AS prompt FROM documents")
def render_template(spark, sf_dir):
    t = text.rendered("Label {x} in {lang} from {source}:{hint}", {"x": F.lit("{x}"), "lang": F.col("lang"), "source": F.col("source")}, frozenset({"hint"}))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("prompt"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'network' WHEN 'view' THEN 'unknown' ELSE 'validation' END AS category FROM events")
def error_categories(spark, sf_dir):
    said = F.when(F.col("event_type") == "error", "Request TIMED OUT").when(F.col("event_type") == "click", "connection reset").when(F.col("event_type") == "view", "array of arrays").otherwise("invalid value")
    return table(spark, sf_dir, "events").select("event_id", text.error_category(said).alias("category"))


@query("SELECT conv_id, count(*) AS turn_count, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id")
def conversations_assembled(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("conversation"))
    joined = F.array_join(F.transform("conversation", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return turns.select("conv_id", F.size("conversation").cast("bigint").alias("turn_count"), F.md5(joined.cast("binary")).alias("content_hash"))


@query("SELECT doc_id, 4 AS n_messages, 'system,user,assistant,user' AS roles, text AS user_text FROM documents")
def message_building(spark, sf_dir):
    m = table(spark, sf_dir, "documents").select("doc_id", text.messages(F.lit("Label."), [("a", "b")], F.col("text")).alias("m"))
    return m.select("doc_id", F.size("m").alias("n_messages"), F.array_join(F.transform("m", lambda t: t["role"]), ",").alias("roles"), F.get("m", F.lit(3))["content"].alias("user_text"))


# stages ------------------------------------------------------------------------------------------------------------


def _answered(spark, sf_dir, answer):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return d.withColumn("row_id", F.col("doc_id").cast("string")).withColumn("generated_text", answer)


@query("SELECT doc_id, CASE WHEN n_chars < 500 THEN '' ELSE lang END AS label_primary, CASE WHEN n_chars < 500 THEN 0 ELSE 1 END AS n_labels, n_chars < 500 AS parse_error FROM documents")
def stage_text_label(spark, sf_dir):
    answer = F.when(F.col("n_chars") < 500, F.lit("no idea")).otherwise(F.concat(F.lit('```json\n{"labels": ["'), "lang", F.lit('", "x"]}\n```')))
    out = stages.label(categories=("en", "fr")).transform(_answered(spark, sf_dir, answer))
    return out.select("doc_id", "label_primary", F.size("labels").alias("n_labels"), "parse_error")


@query("SELECT doc_id, lang AS tag, source AS origin FROM documents")
def stage_vlm_tags(spark, sf_dir):
    answer = F.concat(F.lit('{"tags": ["'), "lang", F.lit('", "zzz"], "attributes": {"source": "'), "source", F.lit('"}}'))
    out = stages.tags(vocabulary=("en", "fr", "de", "es")).transform(_answered(spark, sf_dir, answer))
    return out.select("doc_id", F.array_join("tags", ",").alias("tag"), F.try_element_at("attributes", F.lit("source")).alias("origin"))


@query("SELECT doc_id, 'A text in ' || lang AS caption FROM documents")
def stage_caption(spark, sf_dir):
    out = stages.caption().transform(_answered(spark, sf_dir, F.concat(F.lit(" A text in "), "lang", F.lit("\n"))))
    return out.select("doc_id", "caption")


@query("SELECT doc_id, n_chars AS chars, lang FROM documents")
def stage_text_extract(spark, sf_dir):
    answer = F.to_json(F.struct(F.col("n_chars").alias("chars"), "lang"))
    out = stages.extract(fields=(("chars", "bigint"), ("lang", "string"))).transform(_answered(spark, sf_dir, answer))
    return out.select("doc_id", "extracted.chars", "extracted.lang")


_RUBRIC = Rubric("quality", (Criterion("clarity", weight=1.0), Criterion("depth", weight=3.0)))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 7.5 ELSE (CAST(toxic AS DOUBLE) * 4.0 + 2.0 * 3.0) / 4.0 END AS overall_score FROM labels")
def stage_rubric_score(spark, sf_dir):
    d = table(spark, sf_dir, "labels").withColumn("row_id", F.col("doc_id").cast("string")).withColumn("text", F.lit(""))
    answer = F.concat(F.lit('{"scores": {"clarity": '), (F.col("toxic") * 4).cast("string"), F.lit(', "depth": 2}, "overall_score": '), F.when(F.col("quality") == 1, "7.5").otherwise('"n/a"'), F.lit("}"))
    out = stages.rubric("rubric", _RUBRIC).transform(d.withColumn("generated_text", answer))
    return out.select("doc_id", "overall_score")


@query("SELECT doc_id, 'qa' AS synth_type, 'synth_' || " + _md5("doc_id", "'qa'", "0", width=12) + " AS synth_row_id, n_chars % 2 = 0 AS parse_error FROM documents")
def stage_synth_text(spark, sf_dir):
    answer = F.when(F.col("n_chars") % 2 == 0, F.lit("[1, 2]")).otherwise(F.lit('{"question": "q", "answer": "a"}'))
    out = stages.synth_text("synth", "qa").transform(_answered(spark, sf_dir, answer))
    return out.select("doc_id", "synth_type", "synth_row_id", "parse_error")


@query("SELECT doc_id, 2 AS turn_count, lang AS first_content FROM documents")
def stage_synth_conversation(spark, sf_dir):
    answer = F.concat(F.lit('{"conversation": [{"role": "user", "content": "'), "lang", F.lit('"}, {"role": "assistant", "content": "ok"}]}'))
    out = stages.synth_conversation().transform(_answered(spark, sf_dir, answer))
    return out.select("doc_id", "turn_count", F.get("conversation", F.lit(0))["content"].alias("first_content"))


@query("SELECT vec_id, len(embedding) AS embedding_dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS squared_norm FROM embeddings")
def stage_embed_text(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").withColumn("row_id", F.col("vec_id").cast("string"))
    out = stages.embed().transform(d)
    return out.select("vec_id", "embedding_dim", F.round(scores.dot(F.col("embedding"), F.col("embedding")), 6).alias("squared_norm"))


@query("SELECT doc_id, upper(lang) AS generated_text FROM documents")
def inference_backend(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("row_id", F.col("doc_id").cast("string")).withColumn("request", F.col("lang"))
    d = d.withColumn("sampling_params", stages.sampling_map("s", stages.Context(), F.col("row_id")))
    return stages.infer(d, stages.RuleBackend(str.upper)).select("doc_id", "generated_text")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '0.0' ELSE '0.7' END AS temperature, CASE WHEN l.doc_id IS NULL THEN NULL ELSE '9' END AS seed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def sampling_overrides(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").withColumn("sampling_params", F.create_map(F.lit("temperature"), F.lit("0.0"))).withColumn("row_id", F.col("doc_id"))
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.create_map(F.lit("temperature"), F.lit("0.7"), F.lit("seed"), F.lit("9")).alias("params"))
    out = stages.with_overrides(d, own)
    return out.select("doc_id", F.try_element_at("sampling_params", F.lit("temperature")).alias("temperature"), F.try_element_at("sampling_params", F.lit("seed")).alias("seed"))


# mining ------------------------------------------------------------------------------------------------------------

_SIM = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
_PAIRS = f"SELECT a.vec_id AS anchor, b.vec_id AS candidate, {_SIM} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"


def _top(source: str, where: str, k: int) -> str:
    return f"SELECT * FROM (SELECT anchor, candidate, similarity, row_number() OVER (PARTITION BY anchor ORDER BY similarity DESC, candidate) AS rank FROM ({source}) WHERE {where}) WHERE rank <= {k}"


_CROSS = _top(_PAIRS + " AND a.label IS DISTINCT FROM b.label", "similarity BETWEEN 0.2 AND 1.0", 20)
_ALL = _top(_PAIRS, "similarity BETWEEN 0.1 AND 1.0", 20)


def _candidates(spark, sf_dir, **options):
    rows = table(spark, sf_dir, "embeddings")
    return mining.candidates(rows, "vec_id", **{"top_k": 20, "low": 0.2, **options})


@query(_CROSS)
def mining_candidates_topk(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(f"SELECT * FROM ({_CROSS}) WHERE anchor = 7")
def mining_nearest(spark, sf_dir):
    return mining.nearest(table(spark, sf_dir, "embeddings"), 7, "vec_id", top_k=20, low=0.2)


def _classes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"))


@query(f"SELECT c.anchor, c.candidate, c.similarity, c.rank FROM ({_ALL}) c JOIN embeddings a ON a.vec_id = c.anchor JOIN embeddings b ON b.vec_id = c.candidate WHERE a.label IS DISTINCT FROM b.label AND b.label IN (0, 1, 2)")
def mining_filter_by_class(spark, sf_dir):
    pairs = _candidates(spark, sf_dir, low=0.1, exclude_same_class=False)
    return mining.filter_by_class(pairs, _classes(spark, sf_dir), True, ["0", "1", "2"]).select("anchor", "candidate", "similarity", "rank")


@query(_top(f"SELECT anchor, candidate, arg_min(similarity, l) AS similarity FROM (SELECT anchor, candidate, similarity, 0 AS l FROM ({_CROSS}) UNION ALL SELECT anchor, candidate, similarity, 1 AS l FROM ({_ALL})) GROUP BY 1, 2", "true", 10))
def mining_merge_lists(spark, sf_dir):
    return mining.merge_lists([_candidates(spark, sf_dir), _candidates(spark, sf_dir, low=0.1, exclude_same_class=False)], 10)


_HARD_PARTS = "SELECT vec_id, CASE WHEN label = 9 THEN NULL ELSE 1.0 - least(1.0, greatest(0.0, label / 10.0)) END AS s, CASE WHEN label % 3 = 0 THEN NULL WHEN vec_id % 100 >= 90 THEN 0.5 + 0.5 * (vec_id % 100 / 100.0 - 0.9) / (1 - 0.9) ELSE 0.5 * (vec_id % 100 / 100.0) / 0.9 END AS m, CASE WHEN label % 2 = 0 THEN NULL WHEN label = 5 THEN 1.0 - vec_id % 10 / 10.0 ELSE ((1.0 - vec_id % 10 / 10.0) + least(1.0, 1.5 / 2.0)) / 2.0 END AS u FROM embeddings"
_HARD = f"SELECT vec_id, round(CASE WHEN (s IS NOT NULL)::INT + (m IS NOT NULL)::INT + (u IS NOT NULL)::INT = 1 THEN coalesce(s, m, u) ELSE coalesce((coalesce(s * 0.4, 0) + coalesce(m * 0.4, 0) + coalesce(u * 0.2, 0)) / nullif((CASE WHEN s IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN m IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN u IS NOT NULL THEN 0.2 ELSE 0 END), 0), 0.0) END, 6)::DOUBLE AS hardness FROM ({_HARD_PARTS.replace('label / 10.0', 'label::DOUBLE / 10').replace('100 / 100.0', '100::DOUBLE / 100').replace('10 / 10.0', '10::DOUBLE / 10')})"


def _hardness(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    none = F.lit(None).cast("double")
    s = scores.score_hardness(F.when(F.col("label") != 9, F.col("label").cast("double")))
    m = scores.similarity_hardness(F.when(F.col("label") % 3 != 0, (F.col("vec_id") % 100).cast("double") / 100))
    u = scores.uncertainty_hardness(F.when(F.col("label") % 2 != 0, (F.col("vec_id") % 10).cast("double") / 10), F.when(F.col("label") != 5, 1.5).otherwise(none))
    return e.select("vec_id", F.round(scores.hardness({"score": s, "similarity": m, "uncertainty": u}), 6).alias("hardness"))


@query(_HARD)
def mining_hardness(spark, sf_dir):
    return _hardness(spark, sf_dir)


@query(f"SELECT vec_id, hardness, row_number() OVER (ORDER BY hardness DESC, vec_id DESC) AS rank FROM ({_HARD}) WHERE hardness >= 0.3")
def mining_rank_by_hardness(spark, sf_dir):
    return mining.rank_by_hardness(_hardness(spark, sf_dir), "vec_id", low=0.3)


_SCORED = f"SELECT c.anchor, c.candidate AS negative, c.similarity, coalesce(h.hardness, 0.0) AS hardness, round((c.similarity * 0.5 + coalesce(h.hardness, 0.0) * 0.5) / 1.0, 8) AS combined FROM ({_CROSS}) c LEFT JOIN ({_HARD}) h ON h.vec_id = c.candidate WHERE c.similarity BETWEEN 0.2 AND 0.99 AND coalesce(h.hardness, 0.0) >= 0.3"


def _select(spark, sf_dir, mode, **options):
    hard = _hardness(spark, sf_dir).select(F.col("vec_id").alias("id"), "hardness")
    return mining.select_negatives(_candidates(spark, sf_dir), hard, mode, low=0.2, **options)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY combined DESC, negative) AS selection_rank FROM ({_SCORED})) WHERE selection_rank <= 5")
def mining_select_per_anchor(spark, sf_dir):
    return _select(spark, sf_dir, "per_anchor")


@query(f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY combined DESC, anchor, negative) AS selection_rank FROM ({_SCORED})) WHERE selection_rank <= 1000")
def mining_select_global(spark, sf_dir):
    return _select(spark, sf_dir, "global")


@query(f"SELECT * FROM (SELECT CAST(e.label AS VARCHAR) AS class, s.*, row_number() OVER (PARTITION BY e.label ORDER BY combined DESC, anchor, negative) AS selection_rank FROM ({_SCORED}) s JOIN embeddings e ON e.vec_id = s.negative) WHERE selection_rank <= (SELECT greatest(1, 200 // count(DISTINCT label)) FROM embeddings)")
def mining_select_stratified(spark, sf_dir):
    return _select(spark, sf_dir, "stratified", global_k=200, classes=_classes(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN doc_id % 10 > 8 THEN 'very high similarity' WHEN doc_id % 10 > 6 THEN 'high similarity' ELSE 'moderate similarity' END || CASE WHEN quality = 0 THEN '; low quality' ELSE '' END || CASE WHEN toxic = 1 THEN '; high uncertainty' ELSE '' END AS justification FROM labels")
def mining_justification(spark, sf_dir):
    sim = F.when(F.col("doc_id") % 10 > 8, 0.95).when(F.col("doc_id") % 10 > 6, 0.8).otherwise(0.5)
    return table(spark, sf_dir, "labels").select("doc_id", text.justification(sim, (1 - F.col("quality")).cast("double"), F.col("toxic").cast("double")).alias("justification"))


# cache, lineage, audit ---------------------------------------------------------------------------------------------


def _cache(spark, sf_dir):
    """Entries for the labelled documents."""
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    key = ids.cache_key(F.lit("label"), F.col("doc_id"), F.lit("p1"), F.lit("m1"), F.lit("s1"))
    value = F.concat(F.col("quality").cast("string"), F.lit("/"), F.col("toxic").cast("string"))
    stage = F.when(F.col("doc_id") % 2 == 0, "label").otherwise("score")
    size = F.length(value) + F.length(F.col("doc_id").cast("string"))
    return l.select("doc_id", key.alias("key"), stage.alias("stage_name"), F.lit("p1").alias("prompt_hash"), F.lit("m1").alias("model_hash"), F.lit("s1").alias("sampling_hash"), value.alias("value"), F.md5(value.cast("binary")).alias("output_hash"), size.cast("bigint").alias("size_bytes"))


@query("SELECT d.doc_id, l.quality || '/' || l.toxic AS value FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def cache_hits(spark, sf_dir):
    return cache.hits(_keyed(spark, sf_dir).select("doc_id", "key"), _cache(spark, sf_dir)).select("doc_id", "value")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_misses(spark, sf_dir):
    return cache.misses(_keyed(spark, sf_dir).select("doc_id", "key"), _cache(spark, sf_dir)).select("doc_id")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'label' ELSE 'score' END AS stage_name, count(*) AS entries, sum(3 + length(doc_id::VARCHAR))::BIGINT AS bytes FROM labels GROUP BY ROLLUP(1)")
def cache_stats(spark, sf_dir):
    return cache.stats(_cache(spark, sf_dir))


@query("SELECT d.source AS stage_name, count(l.doc_id) AS hits, count(*) - count(l.doc_id) AS misses, count(l.doc_id)::DOUBLE / count(*) AS hit_rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def cache_hit_rate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("stage_name"))
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit("cached").alias("hit"))
    return cache.hit_rate(d.join(l, "doc_id", "left").withColumn("status", F.coalesce("hit", F.lit("success"))))


@query("SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS intact FROM labels WHERE doc_id % 2 = 0")
def cache_validity(spark, sf_dir):
    """Of entries with damaged (every third) and lost (every seventh) values, those still valid and whether they are intact."""
    damaged = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, F.concat("value", F.lit("x"))).otherwise(F.col("value"))
    now = spark.createDataFrame([("label", "p1", "m1", "s1"), ("score", "p2", "m1", "s1")], "stage_name string, prompt_hash string, model_hash string, sampling_hash string")
    return cache.intact(cache.valid(_cache(spark, sf_dir).withColumn("value", damaged), now)).select("doc_id", "intact")


@query("SELECT doc_id FROM labels WHERE doc_id % 2 <> 0")
def cache_orphans_and_clear(spark, sf_dir):
    c = _cache(spark, sf_dir)
    return cache.orphans(c.select("doc_id", "key"), cache.clear_stage(c, "score")).select("doc_id")


@query("WITH RECURSIVE edges AS (SELECT doc_id AS row_id, doc_id // 2 AS source_row_id FROM documents WHERE doc_id > 0), down(row_id) AS (SELECT 5::BIGINT UNION SELECT e.row_id FROM down d JOIN edges e ON e.source_row_id = d.row_id) SELECT row_id FROM down")
def lineage_invalidation(spark, sf_dir):
    edges = table(spark, sf_dir, "documents").where("doc_id > 0").select(F.col("doc_id").alias("row_id"), F.expr("doc_id div 2").alias("source_row_id"))
    return cache.downstream_rows(edges, spark.createDataFrame([(5,)], "row_id long"))


@query("SELECT coalesce(a.k, b.k) AS stage_name, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT 'o' || o_orderkey AS k, o_orderstatus AS h FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT 'o' || o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 4 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.h <> b.h")
def run_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("stage_name")
    a = o.where("o_orderkey % 3 <> 0").select(name, F.col("o_orderstatus").alias("stage_hash"))
    b = o.where("o_orderkey % 4 <> 0").select(name, F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("stage_hash"))
    return runs.diff(a, b).select("stage_name", "change")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_pending_rows(spark, sf_dir):
    return runs.pending_rows(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS row_id, 'label' AS stage_name, CASE WHEN quality = 1 THEN 'success' ELSE 'error' END AS status, " + _seed("'row'", "'label'", "doc_id") + " AS seed FROM labels")
def row_records(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("row_id"), "quality")
    return runs.row_records(l.where("quality = 1"), "label", "success").unionByName(runs.row_records(l.where("quality <> 1"), "label", "error"))


@query("SELECT source AS stage_name, count(*) AS n_rows, count(*) FILTER (lang = 'en') AS done, (count(*) FILTER (lang = 'en'))::DOUBLE / count(*) AS completion, sum(n_chars)::BIGINT AS total_ms FROM documents GROUP BY 1")
def status_counts(spark, sf_dir):
    done = F.count_if(F.col("lang") == "en")
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stage_name")).agg(F.count(F.lit(1)).alias("n_rows"), done.alias("done"), scores.ratio(done, F.count(F.lit(1))).alias("completion"), F.sum("n_chars").alias("total_ms"))


@query("SELECT r.r_name AS region, t.temperature, p.top_p FROM region r CROSS JOIN (VALUES (0.0::DOUBLE), (0.7)) t(temperature) CROSS JOIN (VALUES (0.9::DOUBLE), (1.0)) p(top_p)")
def ablation_expand(spark, sf_dir):
    axis = lambda name, *v: spark.createDataFrame([(float(x),) for x in v], f"{name} double")
    return runs.expand_table({"region": table(spark, sf_dir, "region").select(F.col("r_name").alias("region")), "temperature": axis("temperature", 0.0, 0.7), "top_p": axis("top_p", 0.9, 1.0)})


def _graph() -> runs.Graph:
    return runs.Graph("catalog").add(stages.label("label", ("en", "xx"))).add(stages.row_filter("keep", "label_primary", "eq", "en"), "label")


def _run_twice(spark, sf_dir) -> str:
    """Two runs over all documents with one cache and different run ids; the folder of the second."""
    rule = stages.RuleBackend(lambda s: '{"labels": ["' + ("en" if " the " in s else "xx") + '"]}')
    data = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("row_id"), "text", "n_chars")
    at = f"{shared.folder(spark).rstrip('/')}/catalog-run-{uuid.uuid4().hex}"
    for name, rows in (("a", data.where("n_chars % 3 <> 0")), ("b", data)):
        runs.run(_graph(), rows, f"{at}/{name}", stages.Context(name, backend=rule), seed=7, cache_path=f"{at}/cache")
    return f"{at}/b"


_RUN_SEED = _seed("'sample'", _seed("'row'", _seed("'stage'", "'7'", "'label'"), "doc_id"), "'0'")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS row_id, CASE WHEN n_chars % 3 <> 0 THEN 'cached' ELSE 'success' END AS status, {_RUN_SEED} AS seed FROM documents")
def run_records_with_cache(spark, sf_dir):
    """Row records of a run whose cache holds the answers to two thirds of the rows, under seeds that follow from the run's."""
    return spark.read.parquet(f"{_run_twice(spark, sf_dir)}/records/stage_name=label").select("row_id", "status", "seed")


@query("SELECT CAST(doc_id AS VARCHAR) AS row_id, 'en' AS label_primary FROM documents WHERE contains(coalesce(text, ''), ' the ')")
def run_labels_through_a_backend(spark, sf_dir):
    """The last output of a run whose requests, answers and parsing all go through the stages."""
    return spark.read.parquet(f"{_run_twice(spark, sf_dir)}/stages/keep").select("row_id", "label_primary")


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 0 THEN x ELSE 0 END)::DOUBLE[]), 6) AS half FROM embeddings")
def vector_cosine(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    half = F.transform(v, lambda x, i: F.when(i % 2 == 1, x).otherwise(F.lit(0.0)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scores.cosine(v, half), 6).alias("half"))


@query("SELECT vec_id, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first, round(embedding[2] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS second FROM embeddings")
def vector_normalised(spark, sf_dir):
    unit = scores.normalized(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(unit, F.lit(0)), 6).alias("first"), F.round(F.get(unit, F.lit(1)), 6).alias("second"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def table_round_trip(spark, sf_dir):
    """Every document written and read again: partitioned Parquet and JSON lines joined on the id."""
    at = f"{shared.folder(spark).rstrip('/')}/catalog-tables-{uuid.uuid4().hex}.v1"
    d = table(spark, sf_dir, "documents")
    tables.write_table(d.select("doc_id", "lang", "source"), f"{at}/a", "parquet", partition_by=["source"], compression="zstd")
    tables.write_table(d.select("doc_id", "n_chars"), f"{at}/b", "jsonl", rows_per_file=1000)
    return tables.read_table(spark, f"{at}/a", "parquet").join(tables.read_table(spark, f"{at}/b", "jsonl"), "doc_id").select("doc_id", "lang", "source", "n_chars")
