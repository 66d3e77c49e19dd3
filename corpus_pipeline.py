"""The corpus pipeline: language ID, SimHash near-dedup, suffix-array dedup, best-fit packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of documents.

Defined cases: a document whose text is null, empty or without a letter leaves at the first stage; of equal rows and of
near-copies one row stays, that with the least id (null ids last, then by a hash of the row); a document that loses all its text at the
third stage is packed as its end id alone; texts of any length are read whole; an empty table gives an empty result; other columns than
those of documents are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import langid, packing, simhash_groups, suffix_dedup
from sparkloom.llm.common import read_table, write_shared

#: Bytes of a repeated string that the third stage cuts: 51 words of four letters and their spaces are 255, of three letters 204.
SPAN = 200
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay: those with a learned language; ``und`` goes."""
    model = langid.train(docs.where(~langid.held_out()))
    named = docs.select(*COLUMNS)
    return langid.keep_known(named, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, Jaccard similarity of 0.8 or more) the document with the smallest id stays."""
    return simhash_groups.keep_one(docs.select(*COLUMNS))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated strings of SPAN bytes go (op3's 400 would miss passages of 51 words); of a character that a cut splits, the rest goes too. n_chars follows the text."""
    rest = tuple(c for c in COLUMNS if c not in ("text", "n_chars"))
    kept = suffix_dedup.cut_texts(docs, keep=rest, span=SPAN)
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequences and places; a document without any text left is one piece with the end id."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("best_fit_packing", best_fit_packing)]

#: No stage but the second can be written in SQL; the tests hold all of them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
