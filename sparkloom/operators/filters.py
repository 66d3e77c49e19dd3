"""Row filters, sampling and limits with the null rules of labeling pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {"eq": "eq", "==": "eq", "ne": "ne", "!=": "ne", "lt": "lt", "<": "lt", "gt": "gt", ">": "gt", "contains": "contains"}


def predicate(field: str, operator: str, value) -> Column:
    """eq and ne are null-safe (null is not equal to a value); lt and gt read null as 0; contains is false for null."""
    if not field:
        raise ValueError("a filter needs a field")
    kind = OPERATORS.get(operator)
    c = F.col(field)
    if kind == "eq":
        return c.eqNullSafe(F.lit(value))
    if kind == "ne":
        return ~c.eqNullSafe(F.lit(value))
    if kind == "lt":
        return F.coalesce(c, F.lit(0)) < value
    if kind == "gt":
        return F.coalesce(c, F.lit(0)) > value
    if kind == "contains":
        return F.coalesce(c.contains(value), F.lit(False))
    raise ValueError(f"unknown operator: {operator}")


def filter_rows(df: DataFrame, field: str, operator: str, value) -> DataFrame:
    if field and field not in df.columns:
        raise ValueError(f"no such field: {field}")
    return df.where(predicate(field, operator, value))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def sample_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """About n rows: each row by itself with the same chance; an empty table stays empty."""
    total = df.count()
    return df.sample(fraction=min(1.0, n / total), seed=seed) if total else df


def sample_exact(df: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    """Exactly n rows (or all), the same ones for a seed whatever the partitions."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def filter_reason(score: Column, content: Column, min_score: float | None, min_length: int, max_length: int, banned: list[str]) -> Column:
    """Why a synthetic row is dropped, or null: low score, too short, too long, then the first banned text.

    A null score passes; null content is empty; a length of 0 turns its rule off; banned texts match in any case.
    """
    content = F.coalesce(content, F.lit(""))
    low = F.lower(content)
    reason = F.when(F.coalesce(score < min_score, F.lit(False)), F.lit("low_score")) if min_score is not None else F.when(F.lit(False), "")
    if min_length:
        reason = reason.when(F.length(content) < min_length, F.lit("too_short"))
    if max_length:
        reason = reason.when(F.length(content) > max_length, F.lit("too_long"))
    for text in banned:
        reason = reason.when(low.contains(text.lower()), F.lit(f"banned: {text}"))
    return reason


def annotate_filtered(df: DataFrame, score_col: str, content_col: str, min_score: float | None = None, min_length: int = 0, max_length: int = 0, banned: tuple[str, ...] = ()) -> DataFrame:
    reason = filter_reason(F.col(score_col), F.col(content_col), min_score, min_length, max_length, list(banned))
    return df.withColumn("filter_reason", reason).withColumn("filtered", F.col("filter_reason").isNotNull())


def remove_filtered(df: DataFrame) -> DataFrame:
    return df.where(~F.col("filtered"))


def require_columns(df: DataFrame, names: list[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
