"""Continuous ingestion: arriving files become rows with ids, each row once within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkloom.functions import identity


def rows(spark: SparkSession, path: str, schema: T.StructType, id_cols: list[str], time_col: str, late: str = "1 hour", files: int = 100) -> DataFrame:
    """Parquet files as they arrive; a repeated row within ``late`` is dropped by its content-derived id.

    Times without a zone are read in the session's time zone: a watermark needs points in time.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    if isinstance(schema[time_col].dataType, T.TimestampNTZType):
        source = source.withColumn(time_col, F.col(time_col).cast("timestamp"))
    named = source.withColumn("row_id", F.concat(F.lit("row_"), identity.short_hash(*[F.col(c) for c in id_cols])))
    return named.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["row_id"])


def counts(stream: DataFrame, time_col: str, key: str, every: str = "10 minutes") -> DataFrame:
    """Rows of each key in each window of time."""
    return stream.groupBy(F.window(time_col, every), key).agg(F.count(F.lit(1)).alias("n"))


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there and stop; the checkpoint remembers what was read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
