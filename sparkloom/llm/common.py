"""Shared plumbing: tables in the shared folder, connected components, row reading."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder (tests, local mode).
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or f"file://{LOCAL_CHECKPOINT_DIR}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Lost executors lose nothing that was written. One file set per call (a fresh uuid), so that a failed
    attempt is never read.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_buckets(df: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    """``write_shared`` in buckets by ``keys``, as many as shuffle partitions: later joins on the keys don't move its rows.

    The table is external, under a name of its own in the session's catalog.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = os.path.join(shared_dir(spark), table)
    df.write.bucketBy(n, *keys).option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A string column as Python strings, null as the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice holds much more than ``max_bytes`` of ``column``.

    Memory then follows one slice (or one row, if a row alone is larger), not Arrow's row count.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        at, held = 0, 0
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        for i, n in enumerate(lengths):
            if held and held + (n or 0) > max_bytes:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n or 0
        yield batch.slice(at)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that ``edges`` (src long, dst long) names.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every round is two combinable
    minimum aggregations and two joins, the number of rounds grows with the logarithm of the longest chain,
    and each round is written to the shared folder, so a lost executor costs one round. Self-loops and rows with
    a null end are ignored. Returns (node long, component long) for nodes with at least one proper edge; an
    empty input gives an empty result.
    """
    spark = edges.sparkSession
    both = lambda e: e.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(e.select(F.col("dst"), F.col("src")))
    proper = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    now = write_shared(proper, "edges")
    last = None
    for _ in range(max_rounds):
        if not now.take(1):
            return spark.createDataFrame([], "node long, component long")
        # large star: every neighbour above u is linked with the least of u and its neighbours
        e = both(now)
        least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = e.where("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        # small star: u and its smaller neighbours are linked with the least of them
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        joined = large.join(least, "src")
        small = (
            joined.select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .unionAll(least.select("src", F.col("m").alias("dst")))
            .where("src <> dst")
            .distinct()
        )
        now = write_shared(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if last == state:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(roots)
