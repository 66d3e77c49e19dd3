"""Text and JSON functions over model outputs, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that models put before an answer; each goes once, in this order.
PREFIXES = ("Answer:", "Output:", "Response:")

#: The categories of errors and the words that tell them, in order; the first match counts.
ERROR_RULES = (
    ("timeout", r"\b(timeout|timed out)\b"),
    ("rate_limit", r"\b(rate limit|too many requests|429)\b"),
    ("network", r"\b(connection|network|socket|dns)\b"),
    ("out_of_memory", r"\b(out of memory|oom)\b"),
    ("gpu", r"\b(cuda|gpu|nccl)\b"),
    ("model", r"\b(model|tokenizer|weights)\b"),
    ("validation", r"\b(invalid|validation|schema|parse)\b"),
)


def unfenced(raw: Column) -> Column:
    """Trimmed text without a code fence around it."""
    t = F.btrim(raw, F.lit(" \t\r\n"))
    t = F.regexp_replace(t, r"^```(json)?\s*", "")
    return F.btrim(F.regexp_replace(t, r"\s*```$", ""), F.lit(" \t\r\n"))


def is_json_object(text: Column) -> Column:
    """True for a JSON object; arrays, scalars, broken text and null are parse errors."""
    return F.coalesce((F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")), F.lit(False))


def field(text: Column, name: str) -> Column:
    """A top-level field of a JSON object as text, else null."""
    return F.get_json_object(text, f"$.{name}")


def missing_fields(text: Column, required: list[str]) -> Column:
    """Required fields that a JSON object lacks, in order of their names; all of them where it does not parse."""
    have = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array(*[F.lit(x) for x in required]), have))


def cleaned(raw: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """Trimmed text without the given prefixes."""
    spaces = F.lit(" \t\r\n")

    def strip(t: Column, p: str) -> Column:
        return F.when(t.startswith(p), F.ltrim(t.substr(F.lit(len(p) + 1), F.length(t)), spaces)).otherwise(t)

    return reduce(strip, prefixes, F.btrim(raw, spaces))


def generated(raw: Column) -> Column:
    return F.coalesce(raw, F.lit(""))


def canonical_json(df_columns: list[str]) -> Column:
    """A row as JSON: keys in order, compact, nulls written."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df_columns)]), {"ignoreNullFields": "false"})


def stable_float(x: Column, digits: int = 6) -> Column:
    """A float as text with fixed digits; nan, inf and -inf by name."""
    plain = F.format_string(f"%.{digits}f", F.round(x, digits))
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(plain)


def rendered(template: str, values: dict[str, Column], optional: frozenset[str] = frozenset()) -> Column:
    """``{name}`` replaced by its value in one pass; other braces stay. A missing required name is an error now, not later."""
    import re

    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{([A-Za-z_]\w*)\}", template):
        name = m[1]
        if name not in values and name not in optional:
            raise KeyError(f"the template needs {name}")
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")) if name in values else F.lit(""))
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def justification(similarity: Column, score_hardness: Column, uncertainty: Column) -> Column:
    """Why a negative was chosen, from its parts."""
    closeness = F.when(similarity > 0.9, "very high similarity").when(similarity > 0.7, "high similarity").otherwise("moderate similarity")
    quality = F.when(score_hardness > 0.7, "low quality").when(score_hardness > 0.4, "medium quality")
    return F.concat_ws("; ", closeness, quality, F.when(uncertainty > 0.7, "high uncertainty"))


def error_category(message: Column) -> Column:
    low = F.lower(message)
    first = None
    for name, pattern in ERROR_RULES:
        first = F.when(low.rlike(pattern), name) if first is None else first.when(low.rlike(pattern), name)
    return first.otherwise("unknown")


def messages(system: Column | None, shots: list[tuple[str, str]], user: Column) -> Column:
    """A chat: the system message, pairs of examples, then the user's; absent or null system messages are left out."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    tail = [x for a, b in shots for x in (turn("user", F.lit(a)), turn("assistant", F.lit(b)))]
    rest = F.array(*tail, turn("user", user))
    if system is None:
        return rest
    return F.when(system.isNotNull(), F.concat(F.array(turn("system", system)), rest)).otherwise(rest)
