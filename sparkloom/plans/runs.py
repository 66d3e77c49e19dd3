"""Pipelines as graphs of stages: order, runs with manifests, replay, resume, diff, retries, parameter sweeps."""

from __future__ import annotations

import dataclasses
import itertools
import json
import os
import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import identity
from sparkloom.operators import cache
from sparkloom.operators.cache import dataset_hash
from sparkloom.plans import stages as stages_module
from sparkloom.plans.stages import Context, Stage, infer
from sparkloom.sources import shared
from sparkloom.sources.environment import snapshot
from sparkloom.sources.tables import digest


@dataclass
class Graph:
    """Named stages and what each depends on; a dependency must be there before."""

    name: str
    version: str = "1"
    stages: dict[str, Stage] = field(default_factory=dict)
    needs: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def add(self, stage: Stage, *after: str) -> Graph:
        if stage.name in self.stages:
            raise ValueError(f"there is a stage {stage.name} already")
        if unknown := [x for x in after if x not in self.stages]:
            raise ValueError(f"unknown dependencies: {', '.join(unknown)}")
        self.stages[stage.name] = stage
        self.needs[stage.name] = tuple(dict.fromkeys(after))
        return self

    @staticmethod
    def line(name: str, *stages: Stage) -> Graph:
        g = Graph(name)
        for i, s in enumerate(stages):
            g.add(s, *([stages[i - 1].name] if i else []))
        return g

    def order(self) -> list[str]:
        """Dependencies first; of the stages that are ready, in the order they were added."""
        done: list[str] = []
        left = list(self.stages)
        while left:
            ready = next((s for s in left if all(n in done for n in self.needs[s])), None)
            if ready is None:
                raise ValueError(f"the graph has a cycle: {', '.join(left)}")
            done.append(ready)
            left.remove(ready)
        return done

    def upstream(self, name: str) -> set[str]:
        found: set[str] = set()
        todo = list(self.needs[name])
        while todo:
            if (n := todo.pop()) not in found:
                found.add(n)
                todo += self.needs[n]
        return found

    def downstream(self, *names: str) -> set[str]:
        return {s for s in self.stages if self.upstream(s) & set(names)}

    def fingerprint(self) -> str:
        return digest({"name": self.name, "version": self.version, "stages": {n: [s.fingerprint(), sorted(self.needs[n])] for n, s in self.stages.items()}})


@dataclass
class Manifest:
    run_id: str
    graph: str
    seed: int
    stages: list[dict[str, Any]] = field(default_factory=list)
    environment: dict[str, Any] = field(default_factory=dict)
    started_at: str = ""
    ended_at: str = ""
    status: str = "running"

    def hash(self) -> str:
        """What the run computes: not when, where, or how it ended."""
        return digest({"graph": self.graph, "seed": self.seed, "git": self.environment.get("git_commit"), "stages": [{k: s[k] for k in ("name", "hash")} for s in self.stages]})

    def stage(self, name: str) -> dict[str, Any] | None:
        return next((s for s in self.stages if s["name"] == name), None)

    def problems(self) -> list[str]:
        names = {s["name"] for s in self.stages}
        out = [] if self.run_id else ["no run id"]
        return out + [f"{s['name']} needs {n}, which is not there" for s in self.stages for n in s["needs"] if n not in names]

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, "manifest.json")
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            json.dump(dataclasses.asdict(self), f, indent=1, sort_keys=True)
        os.replace(f"{path}.new", path)

    @staticmethod
    def load(folder: str) -> Manifest:
        with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
            return Manifest(**json.load(f))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _input(parts: list[DataFrame], key: str) -> DataFrame:
    """Several dependencies are joined on the row id; the first one's columns stay where names clash."""

    def add(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(key, *[c for c in b.columns if c not in a.columns]), key)

    return reduce(add, parts)


def _answered(stage: Stage, source: DataFrame, ctx: Context, folder: str, cache_path: str | None, key: str) -> DataFrame:
    """``source`` with generated_text and error: cached answers where there are, new ones for the other rows.

    New answers are written before they are used, so a retried task does not ask again; those without an error go to the cache.
    A row record for each row says which it was.
    """
    spark = source.sparkSession
    asked = stage.requests(source, ctx)
    sampling = F.to_json(F.array_sort(F.map_entries("sampling_params")))
    prompt, params = F.md5(F.coalesce("request", F.lit("")).cast("binary")), F.md5(sampling.cast("binary"))
    asked = asked.withColumn("_key", identity.cache_key(F.lit(stage.fingerprint()), F.col(key).cast("string"), prompt, F.lit(digest(dataclasses.asdict(ctx.model))), params))
    held = spark.read.parquet(cache_path) if cache_path and shared.exists(spark, cache_path) else None
    mine = None if held is None else cache.latest(held.where(F.col("stage_name") == stage.name)).select(F.col("key").alias("_key"), F.col("value").alias("generated_text"))
    fresh = asked if mine is None else asked.join(mine, "_key", "left_anti")
    if ctx.backend is None:
        raise ValueError(f"{stage.name}: no backend and no generated_text column")
    path = f"{folder}/generated/{stage.name}"
    infer(fresh, ctx.backend, batch=ctx.model.batch_size).withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("error")).write.mode("overwrite").parquet(path)
    answers = spark.read.parquet(path)
    if mine is not None:
        answers = answers.unionByName(asked.join(mine, "_key").withColumns({"error": F.lit(None).cast("string"), "status": F.lit("cached")}))
        answers = shared.written(answers, "answers")  # the cache that it reads changes below
    record = answers.select(F.col(key).cast("string").alias("row_id"), "status", F.col("sampling_params")["seed"].cast("long").alias("seed"), F.col("_key").alias("cache_key"), prompt.alias("input_hash"), F.md5(F.col("generated_text").cast("binary")).alias("output_hash"), "error")
    record.write.mode("overwrite").parquet(f"{folder}/records/stage_name={stage.name}")
    if cache_path:
        new = answers.where("status = 'success'")
        value = F.coalesce("generated_text", F.lit(""))
        entries = new.select(F.lit(stage.name).alias("stage_name"), F.col("_key").alias("key"), F.col(key).cast("string").alias("row_id"), prompt.alias("prompt_hash"), F.lit(digest(dataclasses.asdict(ctx.model))).alias("model_hash"), params.alias("sampling_hash"), value.alias("value"), F.md5(value.cast("binary")).alias("output_hash"), F.octet_length(value).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("access_count"), F.current_timestamp().alias("created_at"))
        cache.put(entries, cache_path)
    return answers.drop("_key", "status")


def run(graph: Graph, data: DataFrame, folder: str, ctx: Context | None = None, seed: int = 42, only: set[str] | None = None, key: str = "row_id", cache_path: str | None = None, earlier: str | None = None) -> Manifest:
    """Run the stages in order, each written to folder/stages/<name>; ``only`` reads the others from an earlier run.

    The manifest is saved at the start and after each stage, so that a run that broke off can be resumed. The seeds of stages and rows
    follow from ``seed``. With ``cache_path`` only rows without a cached answer are asked for. ``earlier`` is the folder of the run
    whose outputs stand for the stages outside ``only`` (this one's by default).
    """
    ctx = dataclasses.replace(ctx or Context(), seed=identity.validate_seed(seed))
    spark = data.sparkSession
    manifest = Manifest(ctx.run_id, graph.fingerprint(), seed, environment=snapshot(spark), started_at=_now())
    manifest.save(folder)
    outputs: dict[str, DataFrame] = {}
    for name in graph.order():
        stage = graph.stages[name]
        path = f"{folder}/stages/{name}"
        counts = {"cached": 0, "success": 0, "error": 0}
        if only is None or name in only:
            source = _input([outputs[n] for n in graph.needs[name]], key) if graph.needs[name] else data
            began = time.time()
            try:
                if stage.asks(source):
                    source = _answered(stage, source, ctx, folder, cache_path, key)
                    counts |= {r["status"]: r["count"] for r in spark.read.parquet(f"{folder}/records/stage_name={name}").groupBy("status").count().collect()}
                stage.transform(source, ctx).write.mode("overwrite").parquet(path)
            except Exception:
                manifest.status = "failed"
                manifest.ended_at = _now()
                manifest.save(folder)
                raise
            took = time.time() - began
        else:
            path = f"{earlier or folder}/stages/{name}"
            took = 0.0
        outputs[name] = spark.read.parquet(path)
        n, content = dataset_hash(outputs[name]).first()
        total = counts["cached"] + counts["success"]
        manifest.stages.append({"name": name, "kind": stage.kind, "version": stage.version, "hash": stage.fingerprint(), "needs": list(graph.needs[name]), "rows": n, "output_hash": content, "seconds": round(took, 3), "status": "complete", "hits": counts["cached"], "misses": counts["success"], "errors": counts["error"], "hit_rate": counts["cached"] / total if total else 0.0})
        manifest.save(folder)
    manifest.status, manifest.ended_at = "complete", _now()
    manifest.save(folder)
    return manifest


def replay(graph: Graph, data: DataFrame, earlier: str, folder: str, mode: str = "verify", stages: tuple[str, ...] = (), ctx: Context | None = None, key: str = "row_id", cache_path: str | None = None) -> tuple[Manifest, list[str]]:
    """Run what a replay of an earlier run executes, with its seed; returns the new manifest and the stages whose output differs."""
    before = Manifest.load(earlier)
    todo = plan_replay(before, mode, stages)
    again = run(graph, data, folder, ctx, before.seed, set(todo.execute), key, cache_path, earlier)
    return again, verify(before, again)


def resume(graph: Graph, data: DataFrame, folder: str, ctx: Context | None = None, key: str = "row_id", cache_path: str | None = None) -> Manifest:
    """Finish a run that broke off: complete, unchanged stages are read; with a cache, answered rows are not asked for again."""
    path = f"{folder}/manifest.json"
    before = Manifest.load(folder) if os.path.exists(path) else None
    return run(graph, data, folder, ctx, before.seed if before else 42, set(plan_resume(graph, before)), key, cache_path)


def graph_of(config: dict[str, Any]) -> Graph:
    """A graph from a configuration: name, version and stages with name, kind, params and after (by default the stage before)."""
    g = Graph(config["name"], str(config.get("version", "1")))
    last: list[str] = []
    for s in config["stages"]:
        if (make := getattr(stages_module, s["kind"], None)) is None:
            raise ValueError(f"unknown stage: {s['kind']}")
        params = {k: tuple(v) if isinstance(v, list) else v for k, v in s.get("params", {}).items()}
        g.add(make(s["name"], **params), *s.get("after", last))
        last = [s["name"]]
    return g


@dataclass(frozen=True)
class Replay:
    """Which stages a replay executes, verifies, and takes as they are."""

    execute: tuple[str, ...]
    verify: tuple[str, ...]
    cached: tuple[str, ...]


def plan_replay(manifest: Manifest, mode: str, stages: tuple[str, ...] = ()) -> Replay:
    """full_cache: none; verify: all, compared; from_stage: a stage and those listed after it; selective: stages and all that depend on them."""
    names = [s["name"] for s in manifest.stages]
    if unknown := [s for s in stages if s not in names]:
        raise ValueError(f"no such stage: {', '.join(unknown)}")
    if mode == "full_cache":
        again: set[str] = set()
    elif mode == "verify":
        again = set(names)
    elif mode == "from_stage":
        again = set(names[names.index(stages[0]) :])
    elif mode == "selective":
        again = set(stages)
        for s in manifest.stages:
            if again & set(s["needs"]):
                again.add(s["name"])
    else:
        raise ValueError(f"unknown mode: {mode}")
    return Replay(tuple(n for n in names if n in again), tuple(n for n in names if n in again and mode == "verify"), tuple(n for n in names if n not in again))


def verify(manifest: Manifest, again: Manifest) -> list[str]:
    """Stages whose output differs between two runs."""
    return [s["name"] for s in manifest.stages if (o := again.stage(s["name"])) is None or o["output_hash"] != s["output_hash"]]


def plan_resume(graph: Graph, manifest: Manifest | None) -> list[str]:
    """Stages to run: those not complete or changed since, and all that depend on them, in order."""
    done = {s["name"] for s in manifest.stages if s["status"] == "complete" and s["name"] in graph.stages and s["hash"] == graph.stages[s["name"]].fingerprint()} if manifest else set()
    todo = set(graph.stages) - done
    todo |= graph.downstream(*todo)
    return [s for s in graph.order() if s in todo]


def pending_rows(rows: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of a stage that have no result yet, whatever the order of either."""
    return rows.join(done.select(key), key, "left_anti")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(stage_name, change) of two tables of (stage_name, stage_hash): added, removed or changed."""
    left = a.select("stage_name", F.col("stage_hash").alias("old_hash"))
    right = b.select("stage_name", F.col("stage_hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return left.join(right, "stage_name", "full_outer").withColumn("change", change).where("change is not null")


def row_records(rows: DataFrame, stage: str, status: str, **given: Any) -> DataFrame:
    """Audit rows of one status (success, error, cached, skipped) for the rows of a stage."""
    if status not in ("success", "error", "cached", "skipped"):
        raise ValueError(f"unknown status: {status}")
    extra = {k: F.lit(v) for k, v in given.items()}
    return rows.select("row_id", F.lit(stage).alias("stage_name"), F.lit(status).alias("status"), identity.row_seed(F.lit(stage), F.col("row_id")).alias("seed"), *[v.alias(k) for k, v in extra.items()])


@dataclass(frozen=True)
class Retry:
    attempts: int = 3
    initial: float = 1.0
    base: float = 2.0
    most: float = 60.0
    jitter: float = 0.25
    never: tuple[type[BaseException], ...] = (ValueError, TypeError, KeyError)

    def delay(self, attempt: int, rng: random.Random | None = None) -> float:
        wait = min(self.initial * self.base ** (attempt - 1), self.most)
        return wait * (1 + (rng or random).uniform(0, self.jitter)) if self.jitter else wait

    def call(self, f: Callable[..., Any], *args: Any, sleep: Callable[[float], None] = time.sleep, **kwargs: Any) -> Any:
        for attempt in itertools.count(1):
            try:
                return f(*args, **kwargs)
            except self.never:
                raise
            except Exception:
                if attempt >= self.attempts:
                    raise
                sleep(self.delay(attempt))


#: Presets: patient, usual, none.
RETRIES = {"patient": Retry(10), "usual": Retry(5), "none": Retry(1)}


@dataclass
class Matrix:
    """A sweep: lists of several values vary, single values are fixed; the order is that of the product."""

    name: str
    base: dict[str, Any] = field(default_factory=dict)
    overrides: dict[str, Any] = field(default_factory=dict)

    def expand(self) -> list[dict[str, Any]]:
        values = {k: v if isinstance(v, list) else [v] for k, v in self.overrides.items()}
        out = []
        for i, combo in enumerate(itertools.product(*values.values())):
            given = dict(zip(values, combo))
            config = reduce(lambda c, kv: set_path(c, *kv), given.items(), json.loads(json.dumps(self.base)))
            out.append({"variant": i, "name": f"{self.name}-{i:03d}", "given": given, "config": config, "hash": digest(config)})
        return out

    def pending(self, done: set[str]) -> list[dict[str, Any]]:
        return [v for v in self.expand() if v["hash"] not in done]


def set_path(config: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """A copy with a dotted path set; a dict value is merged into the one there."""
    head, _, rest = path.partition(".")
    old = config.get(head)
    if rest:
        new = set_path(old if isinstance(old, dict) else {}, rest, value)
    else:
        new = {**old, **value} if isinstance(old, dict) and isinstance(value, dict) else value
    return {**config, head: new}


def parse_overrides(text: str) -> dict[str, Any]:
    """``a=1, b.c=true x=y``: booleans, whole numbers, decimals, else text."""

    def value(x: str) -> Any:
        if x.lower() in ("true", "false"):
            return x.lower() == "true"
        if re.fullmatch(r"[+-]?\d+", x):
            return int(x)
        try:
            return float(x)
        except ValueError:
            return x

    return {k: value(v) for k, _, v in (p.partition("=") for p in re.split(r"[,\s]+", text.strip()) if "=" in p)}


def expand_table(axes: dict[str, DataFrame]) -> DataFrame:
    """All combinations of one-column tables of parameter values (small by nature), for sweeps in one pass."""
    return reduce(lambda a, b: a.crossJoin(b), axes.values())
