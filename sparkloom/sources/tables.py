"""Reading and writing tables, JSON lines, schema checks."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".csv": "csv"}
FORMATS = {"parquet", "json", "jsonl", "csv"}


def format_of(path: str, given: str | None = None) -> str:
    """The format by name, else by suffix; a folder, or a path without a suffix, holds Parquet files unless its suffix says otherwise."""
    if given is not None:
        if given not in FORMATS:
            raise ValueError(f"unknown format: {given}")
        return "json" if given == "jsonl" else given
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if not suffix:
        return "parquet"
    return SUFFIXES.get(suffix, "parquet" if os.path.isdir(path) else "json")


def read_table(spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | None = None, partitions: int = -1) -> DataFrame:
    """Read a table; a given schema is checked, and a missing column is an error."""
    kind = format_of(path, format)
    reader = spark.read.option("header", "true").option("multiLine", str(kind == "json" and path.endswith(".json")).lower()) if kind != "parquet" else spark.read
    if schema is not None and kind != "parquet":
        reader = reader.schema(schema)
    df = reader.format(kind).load(path)
    if schema is not None and (problems := schema_problems(df.schema, schema)):
        raise ValueError("; ".join(problems))
    return df.repartition(partitions) if partitions > 0 else df


def write_table(df: DataFrame, path: str, format: str | None = None, partition_by: Iterable[str] = (), compression: str | None = None, rows_per_file: int = 0, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).format(format_of(path, format))
    if format_of(path, format) == "csv":
        writer = writer.option("header", "true")
    if compression:
        writer = writer.option("compression", compression)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by := list(partition_by):
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_json_lines(path: str) -> list[dict]:
    """Small driver files; blank lines are skipped."""
    with open(path, encoding="utf-8") as f:
        return [json.loads(line) for line in f if line.strip()]


def write_json_lines(rows: Iterable[dict], path: str, append: bool = False) -> int:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = 0
    with open(path, "a" if append else "w", encoding="utf-8") as f:
        for row in rows:
            f.write(canonical(row) + "\n")
            n += 1
    return n


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces; dates as ISO text, bytes as hex, sets sorted, decimals as text."""

    def other(x: Any) -> Any:
        if hasattr(x, "isoformat"):
            return x.isoformat()
        if isinstance(x, (bytes, bytearray)):
            return bytes(x).hex()
        if isinstance(x, (set, frozenset)):
            return sorted(x)
        return str(x)

    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=other)


def digest(value: Any) -> str:
    return hashlib.md5(canonical(value).encode()).hexdigest()[:16]


def schema_problems(have: T.StructType, want: T.StructType, strict: bool = False) -> list[str]:
    """Missing fields; in strict mode also fields of another type, and fields that are not wanted."""
    types = {f.name: f.dataType for f in have}
    out = [f"missing field: {f.name}" for f in want if f.name not in types]
    if strict:
        out += [f"field {f.name}: {types[f.name].simpleString()} is not {f.dataType.simpleString()}" for f in want if f.name in types and types[f.name] != f.dataType]
        out += [f"unexpected field: {n}" for n in types if n not in want.names]
    return out


def schema_fingerprint(schema: T.StructType) -> str:
    """16 hex digits; the order of fields counts."""
    return digest([{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in schema])


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("line"))


def from_json_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    return lines.where(F.trim("line") != "").select(F.from_json("line", schema).alias("r")).select("r.*")
