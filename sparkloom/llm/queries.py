"""Registered queries of the ten operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, cws, flat_graph, html_main, langid, packing, simhash, suffix_dedup, url_rules, warc
from sparkloom.llm.common import read_table

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_of_pages(read_table(spark, sf_dir, "pages")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read_table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprint_with_next(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs, model, keep=("held_out",))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_warc_derivatives, op2_byte_bpe, op3_suffix_array_dedup, op4_url_filters, op5_document_fingerprints, op6_best_fit_packing, op7_embedding_near_dedup, op8_html_extraction, op9_language_id, op10_simhash_near_dedup, pipeline)}

_HOST = "translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_url_filters": f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule_host, rule_path, rule, verdict) AS (
  VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'), ('example.org', '/en/1', 'example.org/en/1', 'block'),
         ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')
), best AS (
  SELECT p.page_id, p.host, p.path, arg_max(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) AS r
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY ALL
)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict FROM best
""",
}
