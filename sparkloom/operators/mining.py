"""Hard-negative mining: candidates, class filters, hardness ranks, selection.

Candidate search compares every pair by definition. It runs in blocks: rows are dealt to blocks of bounded size, each pair of blocks
is one Arrow task that multiplies two matrices and returns at most top_k rows for each anchor; a window ranks what remains.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import scores

BLOCK = 2000
#: Similarities are rounded before they are compared, so that ties and ranks don't depend on the order of a sum.
DIGITS = 6


def ranked(df: DataFrame, partition: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Row numbers from 1 within ``partition``; only the first k where k is given (planned as a group limit)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return out.where(F.col(name) <= k) if k else out


def _blocks(rows: DataFrame, count: int, side: str) -> DataFrame:
    block = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    other = F.sequence(F.lit(0), F.lit(count - 1))
    mine, theirs = ("a", "b") if side == "a" else ("b", "a")
    return rows.select(block.alias(mine), F.explode(other).alias(theirs), "id", "v", "class")


def candidates(rows: DataFrame, id_col: str = "row_id", vector_col: str = "embedding", class_col: str | None = "label", top_k: int = 100, low: float = 0.5, high: float = 1.0, exclude_same_class: bool = True, anchors: DataFrame | None = None) -> DataFrame:
    """(anchor, candidate, similarity, rank): for each anchor the top_k other rows within [low, high].

    Rows of one class are left out where both classes are present (0 and "" are classes). Order: similarity, then candidate id.
    """
    shape = lambda d: d.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), (F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")).alias("class"))
    right = shape(rows).where("v is not null")
    left = right if anchors is None else shape(anchors).where("v is not null")
    count = max(1, math.ceil(right.count() / BLOCK))
    kind = rows.schema[id_col].dataType.simpleString()
    out = f"anchor {kind}, candidate {kind}, similarity double"

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"anchor": a["id"][:0], "candidate": b["id"][:0], "similarity": np.zeros(0)})
        b = b.sort_values("id")
        x, y = (np.array(f["v"].tolist(), np.float64) for f in (a, b))
        scale = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.round(np.where(scale > 0, x @ y.T / scale, 0.0), DIGITS)
        ok = (sim >= low) & (sim <= high) & (a["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :])
        if exclude_same_class:
            ca, cb = a["class"].to_numpy(object), b["class"].to_numpy(object)
            ok &= ~((ca[:, None] == cb[None, :]) & np.array([c is not None for c in ca])[:, None])
        sim = np.where(ok, sim, -np.inf)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :top_k]
        i, j = np.nonzero(np.take_along_axis(ok, order, axis=1))
        at = order[i, j]
        return pd.DataFrame({"anchor": a["id"].to_numpy()[i], "candidate": b["id"].to_numpy()[at], "similarity": sim[i, at]})

    found = _blocks(left, count, "a").groupBy("a", "b").cogroup(_blocks(right, count, "b").groupBy("a", "b")).applyInPandas(pairs, out)
    return ranked(found, ["anchor"], [F.desc("similarity"), F.asc("candidate")], top_k)


def nearest(rows: DataFrame, anchor_id, id_col: str = "row_id", **options) -> DataFrame:
    """Candidates of one anchor; empty for an id that is not there."""
    return candidates(rows, id_col, anchors=rows.where(F.col(id_col) == F.lit(anchor_id)), **options)


def filter_by_class(pairs: DataFrame, classes: DataFrame, exclude_same: bool = True, targets: list[str] | None = None) -> DataFrame:
    """Pairs by the classes (id, class) of both ends; pairs with an unknown class pass unless target classes are given."""
    one = lambda end: classes.select(F.col("id").alias(end), F.col("class").cast("string").alias(f"{end}_class"))
    out = pairs.join(one("anchor"), "anchor", "left").join(one("candidate"), "candidate", "left")
    if exclude_same:
        out = out.where(~F.coalesce(F.col("anchor_class") == F.col("candidate_class"), F.lit(False)))
    return out.where(F.col("candidate_class").isin(targets)) if targets is not None else out


def merge_lists(lists: list[DataFrame], top_k: int | None = None) -> DataFrame:
    """One list of (anchor, candidate, similarity): a pair that is in several keeps the first list's row; ranks anew."""
    tagged = [d.select("anchor", "candidate", "similarity", F.lit(i).alias("list")) for i, d in enumerate(lists)]
    union = tagged[0]
    for d in tagged[1:]:
        union = union.unionByName(d)
    first = union.groupBy("anchor", "candidate").agg(F.min_by("similarity", "list").alias("similarity"))
    return ranked(first, ["anchor"], [F.desc("similarity"), F.asc("candidate")], top_k)


def rank_by_hardness(rows: DataFrame, id_col: str = "row_id", score_col: str = "hardness", low: float = 0.0, top_k: int | None = None) -> DataFrame:
    """Rows of ``low`` or more, hardest first, ties by the greater id; rank from 1.

    A global rank: partial order first, so at most top_k rows of a task move where top_k is given.
    """
    kept = rows.where(F.col(score_col) >= low)
    order = [F.desc(score_col), F.desc(id_col)]
    if top_k:
        kept = kept.orderBy(*order).limit(top_k)
        return kept.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    # all rows: ranks by ranges of scores, then within a range
    part = F.floor(F.col(score_col) * 1024).cast("int")
    binned = kept.withColumn("bin", part)
    sizes = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    above = sizes.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("bin"))) - F.col("n")).drop("n")
    local = F.row_number().over(Window.partitionBy("bin").orderBy(*order))
    return binned.withColumn("local", local).join(F.broadcast(above), "bin").withColumn("rank", (F.col("local") + F.col("above")).cast("int")).drop("bin", "local", "above")


def select_negatives(pairs: DataFrame, hardness: DataFrame, mode: str = "per_anchor", k: int = 5, global_k: int = 1000, low: float = 0.5, high: float = 0.99, min_hardness: float = 0.3, weights: tuple[float, float] = (0.5, 0.5), classes: DataFrame | None = None) -> DataFrame:
    """(anchor, negative, similarity, hardness, combined, selection_rank) from pairs and hardness (id, hardness).

    A candidate without hardness has 0. per_anchor: the k best of each anchor; global: the global_k best; stratified: the
    global_k best in equal shares of the negatives' classes.
    """
    kept = pairs.where(F.col("similarity").between(low, high)).select("anchor", F.col("candidate").alias("negative"), "similarity")
    scored = kept.join(hardness.select(F.col("id").alias("negative"), "hardness"), "negative", "left").withColumn("hardness", F.coalesce("hardness", F.lit(0.0))).where(F.col("hardness") >= min_hardness)
    scored = scored.withColumn("combined", F.round(scores.combined_score(F.col("similarity"), F.col("hardness"), *weights), DIGITS + 2))
    best = [F.desc("combined"), F.asc("anchor"), F.asc("negative")]
    columns = ["anchor", "negative", "similarity", "hardness", "combined", "selection_rank"]
    if mode == "per_anchor":
        return ranked(scored, ["anchor"], [F.desc("combined"), F.asc("negative")], k, "selection_rank").select(*columns)
    if mode == "global":
        top = scored.orderBy(*best).limit(global_k)
        return top.withColumn("selection_rank", F.row_number().over(Window.orderBy(*best))).select(*columns)
    if mode == "stratified":
        if classes is None:
            raise ValueError("stratified selection needs classes (id, class)")
        named = scored.join(classes.select(F.col("id").alias("negative"), F.col("class").cast("string").alias("class")), "negative")
        quota = max(1, global_k // max(1, classes.select("class").distinct().count()))
        return ranked(named, ["class"], best, quota, "selection_rank").select("class", *columns)
    raise ValueError(f"unknown mode: {mode}")


def report(selected: DataFrame, anchors: int = 5, each: int = 3) -> str:
    """A short text: the first anchors and their best negatives."""
    first = selected.select("anchor").distinct().orderBy("anchor").limit(anchors)
    rows = ranked(selected.join(first, "anchor", "left_semi"), ["anchor"], [F.asc("selection_rank")], each, "at").orderBy("anchor", "at").collect()
    lines, last = [], None
    for r in rows:
        if r["anchor"] != last:
            lines.append(f"anchor {r['anchor']}")
            last = r["anchor"]
        lines.append(f"  {r['selection_rank']}. {r['negative']}: similarity {r['similarity']:.3f}, hardness {r['hardness']:.3f}")
    return "\n".join(lines)
