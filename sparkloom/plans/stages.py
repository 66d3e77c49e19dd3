"""Labeling and synthesis stages: a request column, an inference backend, a parsed result.

A stage adds columns and keeps all of its input's. Inference is the only Python step, in Arrow batches behind ``Backend``; a
``generated_text`` column that is already there is used as it is. Parsing is done with expressions: an output that is not a JSON object sets
``parse_error`` and the default outputs.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import identity, scores, text
from sparkloom.operators.filters import annotate_filtered, filter_rows, remove_filtered, require_columns
from sparkloom.plans.config import STAGE_KINDS, SYNTH_KINDS, Model, Rubric, Sampling
from sparkloom.sources.tables import digest


class Backend(Protocol):
    def generate(self, requests: list[str], params: list[dict[str, Any]]) -> list[str]: ...


@dataclass(frozen=True)
class RuleBackend:
    """A deterministic backend for tests and dry runs: a function of the request text."""

    rule: Callable[[str], str]

    def generate(self, requests: list[str], params: list[dict[str, Any]]) -> list[str]:
        return [self.rule(x) for x in requests]


@dataclass(frozen=True)
class Context:
    run_id: str = "run"
    #: The run's seed; those of stages, rows and attempts follow from it alone, whatever the run id.
    seed: int = 42
    attempt: int = 0
    backend: Backend | None = None
    model: Model = field(default_factory=lambda: Model("rule"))
    sampling: Sampling = field(default_factory=Sampling)
    #: (row_id, params map<string,string>) that override the sampling of single rows.
    overrides: DataFrame | None = None


def sampling_map(stage: str, ctx: Context, row: Column) -> Column:
    """Base parameters and the row's own seed, as a map."""
    base = F.create_map(*[F.lit(str(x)) for kv in ctx.sampling.params().items() for x in kv]) if ctx.sampling.params() else F.create_map().cast("map<string,string>")
    of_stage = identity.stage_seed(F.lit(str(ctx.seed)), F.lit(stage)).cast("string")
    of_row = identity.row_seed(of_stage, row).cast("string")
    return last_wins(base, F.create_map(F.lit("seed"), identity.sample_seed(of_row, F.lit(str(ctx.attempt))).cast("string")))


def last_wins(first: Column, second: Column) -> Column:
    """Both maps in one; of a key in both the second's value."""
    kept = F.map_filter(first, lambda k, v: ~F.coalesce(F.map_contains_key(second, k), F.lit(False)))
    return F.when(second.isNull(), first).otherwise(F.map_concat(kept, second))


def with_overrides(df: DataFrame, overrides: DataFrame | None, column: str = "sampling_params", row_col: str = "row_id") -> DataFrame:
    if overrides is None:
        return df
    own = overrides.select(F.col("row_id").alias("_override_row"), F.col("params").alias("_override"))
    return df.join(own, df[row_col] == F.col("_override_row"), "left").withColumn(column, last_wins(F.col(column), F.col("_override"))).drop("_override", "_override_row")


def infer(df: DataFrame, backend: Backend, request_col: str = "request", params_col: str = "sampling_params", batch: int = 64) -> DataFrame:
    """Add generated_text; a row whose request fails gets null and the error, the others go on."""

    @F.pandas_udf("struct<generated_text:string,error:string>")
    def call(requests: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for req, par in requests:
            rows = []
            for i in range(0, len(req), batch):
                part, params = req.iloc[i : i + batch].fillna("").tolist(), [dict(p or {}) for p in par.iloc[i : i + batch]]
                try:
                    rows += [(x, None) for x in backend.generate(part, params)]
                except Exception:
                    for one, p in zip(part, params):
                        try:
                            rows.append((backend.generate([one], [p])[0], None))
                        except Exception as e:  # the row's own error is its result
                            rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["generated_text", "error"])

    out = df.withColumn("_generated", call(request_col, params_col))
    return out.withColumn("generated_text", F.col("_generated.generated_text")).withColumn("error", F.col("_generated.error")).drop("_generated")


@dataclass(frozen=True)
class Stage:
    """name, version, kind; needs and adds: column names; request builds the prompt, parse the outputs."""

    name: str
    kind: str
    version: str = "1"
    needs: tuple[str, ...] = ("row_id",)
    params: tuple[tuple[str, Any], ...] = ()
    request: Callable[[], Column] | None = None
    parse: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self) -> None:
        if self.kind not in STAGE_KINDS:
            raise ValueError(f"unknown stage kind: {self.kind}")

    def fingerprint(self) -> str:
        """All parameters count."""
        return digest({"name": self.name, "kind": self.kind, "version": self.version, "params": dict(self.params)})

    def asks(self, df: DataFrame) -> bool:
        """True if the stage sends requests for ``df``: one with a generated_text column needs none."""
        return self.request is not None and "generated_text" not in df.columns

    def requests(self, df: DataFrame, ctx: Context) -> DataFrame:
        """``df`` with the request and the sampling parameters of each row."""
        require_columns(df, list(self.needs))
        out = df.withColumn("request", self.request()).withColumn("sampling_params", sampling_map(self.name, ctx, F.col("row_id")))
        return with_overrides(out, ctx.overrides)

    def transform(self, df: DataFrame, ctx: Context | None = None) -> DataFrame:
        ctx = ctx or Context()
        require_columns(df, list(self.needs))
        out = df
        if self.asks(df):
            if ctx.backend is None:
                raise ValueError(f"{self.name}: no backend and no generated_text column")
            out = infer(self.requests(df, ctx), ctx.backend, batch=ctx.model.batch_size)
        return self.parse(out) if self.parse else out


def _object(df: DataFrame) -> DataFrame:
    out = df.withColumn("_json", text.unfenced(text.generated(F.col("generated_text"))))
    return out.withColumn("parse_error", ~text.is_json_object(F.col("_json")))


def _strings(name: str) -> Column:
    found = F.from_json(text.field(F.col("_json"), name), "array<string>")
    return F.when(~F.col("parse_error"), F.filter(found, lambda x: x.isNotNull()))


def caption(name: str = "caption", prompt: str = "Describe the picture in one sentence.") -> Stage:
    def parse(df: DataFrame) -> DataFrame:
        raw = text.generated(F.col("generated_text"))
        return df.withColumn("caption", F.btrim(raw, F.lit(" \t\r\n"))).withColumn("caption_raw", raw)

    return Stage(name, "vlm_caption", params=(("prompt", prompt),), request=lambda: F.lit(prompt), parse=parse)


def tags(name: str = "tags", vocabulary: tuple[str, ...] = (), max_tags: int = 10) -> Stage:
    """Tags of the vocabulary only, where one is given; max_tags at most; attributes as a map."""

    def parse(df: DataFrame) -> DataFrame:
        out = _object(df)
        found = F.coalesce(_strings("tags"), F.array().cast("array<string>"))
        if vocabulary:
            found = F.filter(found, lambda x: x.isin(list(vocabulary)))
        attributes = F.coalesce(F.when(~F.col("parse_error"), F.from_json(text.field(F.col("_json"), "attributes"), "map<string,string>")), F.create_map().cast("map<string,string>"))
        return out.withColumn("tags", F.slice(found, 1, max_tags)).withColumn("attributes", attributes).withColumn("tags_raw", F.col("generated_text")).drop("_json")

    return Stage(name, "vlm_tags", params=(("vocabulary", vocabulary), ("max_tags", max_tags)), request=lambda: F.lit("List tags as a JSON object with tags and attributes."), parse=parse)


def label(name: str = "label", categories: tuple[str, ...] = (), multi: bool = False, max_labels: int = 3) -> Stage:
    """labels, label_primary (the first label, or empty), reasoning."""

    def request() -> Column:
        return F.concat(F.lit(f"Choose {'up to ' + str(max_labels) if multi else 'one'} of: {', '.join(categories)}. Answer as JSON with labels, primary and reasoning.\n\n"), text.generated(F.col("text")))

    def parse(df: DataFrame) -> DataFrame:
        out = _object(df)
        found = F.slice(F.coalesce(_strings("labels"), F.array().cast("array<string>")), 1, max_labels if multi else 1)
        out = out.withColumn("labels", found)
        primary = F.coalesce(F.when(~F.col("parse_error"), text.field(F.col("_json"), "primary")), F.get("labels", F.lit(0)), F.lit(""))
        return out.withColumn("label_primary", primary).withColumn("reasoning", F.when(~F.col("parse_error"), text.field(F.col("_json"), "reasoning"))).withColumn("label_raw", F.col("generated_text")).drop("_json")

    return Stage(name, "text_label", needs=("row_id", "text"), params=(("categories", categories), ("multi", multi), ("max_labels", max_labels)), request=request, parse=parse)


def extract(name: str = "extract", fields: tuple[tuple[str, str], ...] = ()) -> Stage:
    """extracted: a struct of the asked fields (name, Spark type); null fields where the output has none."""
    ddl = ", ".join(f"`{k}` {t}" for k, t in fields)

    def parse(df: DataFrame) -> DataFrame:
        out = _object(df)
        return out.withColumn("extracted", F.from_json(F.when(F.col("parse_error"), "{}").otherwise(F.col("_json")), ddl)).withColumn("extraction_raw", F.col("generated_text")).drop("_json")

    def request() -> Column:
        return F.concat(F.lit("Extract as JSON: " + "; ".join(f"{k} ({t})" for k, t in fields) + "\n\n"), text.generated(F.col("text")))

    return Stage(name, "text_extract", needs=("row_id", "text"), params=(("fields", fields),), request=request, parse=parse)


def rubric(name: str, rubric: Rubric) -> Stage:
    """scores map, overall_score (the model's, or the weighted mean where it is missing or no number), reasoning."""

    def parse(df: DataFrame) -> DataFrame:
        out = _object(df)
        given = F.coalesce(F.when(~F.col("parse_error"), F.from_json(text.field(F.col("_json"), "scores"), "map<string,double>")), F.create_map().cast("map<string,double>"))
        out = out.withColumn("scores", given)
        overall = F.try_to_number(text.field(F.col("_json"), "overall_score"), F.lit("S999999.999999")).cast("double")
        mean = F.when(F.size("scores") > 0, scores.rubric_mean(F.col("scores"), rubric.weights()))
        return out.withColumn("overall_score", F.coalesce(F.when(~F.col("parse_error"), overall), mean, F.lit(0.0))).withColumn("score_reasoning", F.when(~F.col("parse_error"), text.field(F.col("_json"), "reasoning"))).withColumn("score_raw", F.col("generated_text")).drop("_json")

    def request() -> Column:
        asked = "; ".join(f"{c.name} ({c.low:g}-{c.high:g}): {c.description}" for c in rubric.criteria)
        return F.concat(F.lit(f"Score the text. {asked}. Answer as JSON with scores, overall_score and reasoning.\n\n"), text.generated(F.col("text")))

    return Stage(name, "rubric_score", needs=("row_id", "text"), params=(("rubric", dataclasses.asdict(rubric)),), request=request, parse=parse)


def embed(name: str = "embed", model: str = "rule", normalize: bool = True) -> Stage:
    """embedding, embedding_model, embedding_dim from an embedding column; a zero vector stays."""

    def parse(df: DataFrame) -> DataFrame:
        v = scores.normalized(F.col("embedding")) if normalize else F.col("embedding").cast("array<double>")
        return df.withColumn("embedding", v).withColumn("embedding_model", F.lit(model)).withColumn("embedding_dim", F.size("embedding"))

    return Stage(name, "embed_text", needs=("row_id", "embedding"), params=(("model", model), ("normalize", normalize)), parse=parse)


def synth_text(name: str, kind: str) -> Stage:
    """synth_content (the JSON object, or {"raw": ...}), synth_type, synth_row_id."""
    if kind not in SYNTH_KINDS:
        raise ValueError(f"unknown kind of synthetic text: {kind}")

    def parse(df: DataFrame) -> DataFrame:
        out = _object(df)
        raw = F.to_json(F.struct(text.generated(F.col("generated_text")).alias("raw")))
        return out.withColumn("synth_content", F.when(F.col("parse_error"), raw).otherwise(F.col("_json"))).withColumn("synth_type", F.lit(kind)).withColumn("synth_row_id", identity.synth_id(F.col("row_id"), F.lit(kind), F.lit(0))).drop("_json")

    return Stage(name, "synth_text", needs=("row_id", "text"), params=(("kind", kind),), request=lambda: F.concat(F.lit(f"Write a {kind} on the text as JSON.\n\n"), text.generated(F.col("text"))), parse=parse)


def synth_conversation(name: str = "conversation", turns: int = 4, style: str = "plain") -> Stage:
    """conversation: array of (role, content); turn_count; synth_row_id."""

    def parse(df: DataFrame) -> DataFrame:
        out = _object(df)
        given = F.when(~F.col("parse_error"), F.from_json(text.field(F.col("_json"), "conversation"), "array<struct<role:string,content:string>>"))
        out = out.withColumn("conversation", F.coalesce(given, F.array().cast("array<struct<role:string,content:string>>")))
        return out.withColumn("turn_count", F.size("conversation")).withColumn("synth_row_id", identity.synth_id(F.col("row_id"), F.lit("conversation"), F.lit(0))).drop("_json")

    return Stage(name, "synth_vlm", params=(("turns", turns), ("style", style)), request=lambda: F.lit(f"Write a {style} conversation of {turns} turns as JSON."), parse=parse)


def synth_filter(name: str, score_col: str, content_col: str, min_score: float | None = None, min_length: int = 0, max_length: int = 0, banned: tuple[str, ...] = (), remove: bool = True) -> Stage:
    def parse(df: DataFrame) -> DataFrame:
        out = annotate_filtered(df, score_col, content_col, min_score, min_length, max_length, banned)
        return remove_filtered(out) if remove else out

    given = (("score", score_col), ("content", content_col), ("min_score", min_score), ("min_length", min_length), ("max_length", max_length), ("banned", banned), ("remove", remove))
    return Stage(name, "filter", needs=(score_col, content_col), params=given, parse=parse)


def row_filter(name: str, field: str, operator: str, value: Any) -> Stage:
    return Stage(name, "filter", needs=(field,), params=(("field", field), ("operator", operator), ("value", value)), parse=lambda df: filter_rows(df, field, operator, value))
