"""SimHash near-duplicates by multi-index hashing.

Fingerprints come from an Arrow stage (word shingles, XXH64); everything after it is DataFrame work on distinct
fingerprints, so a group of any number of equal texts is one row. A 64-bit fingerprint has two 32-bit segments
A and B. Two fingerprints at distance 2 or less differ by (A, B) = (0, 0..2), (0..2, 0) or (1, 1) bits:

* A equal: the Hamming ball of radius 0 in A; the rest differs by 2 bits at most, so one of three parts of B is equal;
* B equal: likewise with the segments exchanged;
* one bit each: the Hamming ball of radius 1 in A (its 32 one-bit changes are enumerated and looked up); the
  rest differs by one bit, so one of the two halves of B is equal.

A table key is the segment's value with the equal part, so a segment value that many texts share is spread
over its parts. Every match is verified on the whole distance. A fingerprint has at most 2,080 others within two bits, so
verified links grow with distinct fingerprints and not with the square of a group.

Defined cases: null or empty text has fingerprint zero and links like any other; fewer words than a shingle
make one shingle of all words; repeated rows are kept, each with the same result; rows with a null id take
part and get the component of their fingerprint (ids are compared without nulls); an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import connected_components, slices, texts, write_shared

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 2
BATCH_BYTES = 4 << 20


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The hashes of a text's word shingles, in order."""
    parts = text.encode().lower().split()  # bytes: lower() maps A-Z only, split() cuts at 0x20 and 0x09-0x0D
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    starts = np.zeros(len(parts), np.int64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    n = max(1, len(parts) - words + 1)
    ends = (starts + sizes)[min(words, len(parts)) - 1 :][:n]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist())], np.uint64, n)


def bit_counts(x: np.ndarray) -> np.ndarray:
    """How many rows of ``x`` (rows x 64-bit lanes) have each bit set; bits in order of memory."""
    rows = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
    total = np.zeros(rows.shape[1] * 8, np.int64)
    for i in range(0, len(rows), 255):  # as many as one byte counts
        total += np.add.reduce(np.unpackbits(rows[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    counts = bit_counts(hashes.astype(">u8")[:, None])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp long): the fingerprint of every row, as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            fps = np.array([fingerprint(x, words) for x in texts(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, out)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp) at distance 1 or 2, a < b, each pair once."""
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    seg = {"a": F.shiftrightunsigned("fp", 32), "b": low(F.col("fp"))}
    thirds = lambda c: [F.shiftrightunsigned(c, 22), F.shiftrightunsigned(c, 11).bitwiseAND(F.lit(0x7FF)), c.bitwiseAND(F.lit(0x7FF))]
    halves = lambda c: [F.shiftrightunsigned(c, 16), c.bitwiseAND(F.lit(0xFFFF))]
    # a key is (segment value, part value) in 64 bits with the table's number beside it
    key = lambda table, value, part: F.struct(F.lit(table).alias("t"), F.shiftleft(value, 16).bitwiseOR(part).alias("k"))
    equal = [key(10 + j, seg["a"], p) for j, p in enumerate(thirds(seg["b"]))] + [key(20 + j, seg["b"], p) for j, p in enumerate(thirds(seg["a"]))]
    flipped = [F.lit(1 << i).cast("long") for i in range(32)]
    stored = [key(30 + j, seg["a"], p) for j, p in enumerate(halves(seg["b"]))]
    probes = [key(30 + j, seg["a"].bitwiseXOR(f), p) for j, p in enumerate(halves(seg["b"])) for f in flipped]
    spread = lambda keys: distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.t", "key.k")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    table = spread(equal + stored).withColumnRenamed("fp", "b")
    asked = spread(equal + probes).withColumnRenamed("fp", "a")
    return asked.join(table, ["t", "k"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id among all rows that links reach."""
    marks = write_shared(fingerprints(df, text_col, id_col, words), "simhash")
    distinct = write_shared(marks.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-fps")
    # nodes are fingerprints: a class has one even where all its ids are null
    groups = connected_components(links(distinct).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = placed.select("fp", "component").join(least, "component").select("fp", "component_id")
    return marks.join(by_fp, "fp").select(id_col, "fp", "component_id")
