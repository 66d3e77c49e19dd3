"""Content-derived ids, hashes and seeds as Column expressions (MD5, so that any SQL engine can check them).

Parts are joined with their lengths in front, so no two lists of parts give one string.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = 16


def joined(*parts: Column) -> Column:
    """``length:part`` of each part, null as the empty part."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts])


def short_hash(*parts: Column, width: int = HEX) -> Column:
    return F.substring(F.md5(joined(*parts).cast("binary")), 1, width)


def content_hash(value: Column) -> Column:
    """Hash of a text or of bytes; null stays null."""
    return F.substring(F.md5(value.cast("binary")), 1, HEX)


def row_id(source_type: Column, uri: Column, key: Column | None = None, version: Column | None = None, text: Column | None = None, image: Column | None = None, prefix: str = "row_", override: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    parts = [source_type, uri, *(none if x is None else x for x in (key, version))]
    parts += [content_hash(x) for x in (text, image) if x is not None]
    made = short_hash(*parts)
    if override is not None:
        made = F.when(override.isNotNull(), short_hash(override)).otherwise(made)
    return F.concat(F.lit(prefix), made)


def is_row_id(value: Column, prefix: str = "row_") -> Column:
    return F.coalesce(value.rlike(rf"^{prefix}[0-9a-f]{{{HEX}}}$"), F.lit(False))


def child_id(parent: Column, suffix: Column, prefix: str = "row_") -> Column:
    return F.concat(F.lit(prefix), short_hash(parent, suffix))


def synth_id(source: Column, kind: Column, index: Column) -> Column:
    return F.concat(F.lit("synth_"), short_hash(source, kind, index, width=12))


def seed(*parts: Column) -> Column:
    """A seed in [0, 2^32)."""
    return F.conv(F.substring(F.md5(joined(*parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def stage_seed(run: Column, stage: Column) -> Column:
    return seed(F.lit("stage"), run, stage)


def row_seed(stage: Column, row: Column) -> Column:
    return seed(F.lit("row"), stage, row)


def sample_seed(row: Column, attempt: Column) -> Column:
    return seed(F.lit("sample"), row, attempt)


def validate_seed(value: int) -> int:
    """A seed in [0, 2^32), else an error."""
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 1 << 32:
        raise ValueError(f"a seed is a whole number from 0 to 4294967295, not {value!r}")
    return value


@dataclass(frozen=True)
class SeedPolicy:
    """The run's seed: the one given, or a random one that the manifest then records."""

    given: int | None = 42

    def seed(self) -> int:
        return random.SystemRandom().randrange(1 << 32) if self.given is None else validate_seed(self.given)


def cache_key(stage: Column, row: Column, prompt: Column, model: Column, sampling: Column, code: Column | None = None) -> Column:
    return F.md5(joined(*[x for x in (stage, row, prompt, model, sampling, code) if x is not None]).cast("binary"))


def key_prefix(key: Column, width: int = 4) -> Column:
    return F.substring(key, 1, width)


def row_hash(*columns: str) -> Column:
    """Hash of a row's columns with their names, in order of the names; null differs from the empty string."""
    parts = []
    for c in sorted(columns):
        parts += [F.lit(c), F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(c).cast("string")))]
    return F.md5(joined(*parts).cast("binary"))
