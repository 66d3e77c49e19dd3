"""Embedding near-duplicates on a robust-pruned flat graph.

1. Equal vectors become one node with a weight. Vectors that are null, zero or hold null or non-finite components stay out.
2. Centroids are fitted on at most ``SAMPLE`` vectors; every node goes to its ``OVERLAP`` nearest clusters, so the shards overlap.
   A cluster of more than ``SHARD`` nodes is dealt in blocks, and each pair of blocks is a shard: no pair is lost, and no task
   gets a hot cluster whole.
3. Each shard builds a flat graph with robust pruning; adjacency lists are united over all shards of a node.
4. Each shard answers its nodes' range queries by greedy search from the medoid, which then expands through every node in range.
   What it finds is verified by the cosine in double precision. A pair counts in one shard only: that of the least common
   cluster (and the blocks' own pair).
5. ``audit`` measures recall against brute force on a bounded sample of queries; below ``GOAL`` the search runs again with
   twice the overlap, up to eight times; a recall below ``LEAST`` is an error.

Shards report sums of links and spanning edges, never all pairs; components come from the edges.

Defined cases: rows with a null id, and vectors that may not link, have no links and are their own component; vectors of different
dimensions don't link; repeated rows and equal vectors are linked with each other; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import connected_components, write_shared

COSINE = 0.95
SAMPLE, CLUSTER_NODES, MAX_CLUSTERS = 4096, 600, 512
OVERLAP, SHARD = 3, 2400
CANDIDATES, DEGREE, ALPHA = 48, 20, 1.2
#: How far below the threshold a node may be for the search to expand through it.
SLACK = 0.1
BEAM, QUERIES_AT_ONCE = 8, 256
#: Nodes that the audit searches by brute force, the recall that ends the search, and the least that is returned.
AUDIT_QUERIES, GOAL, LEAST = 1024, 0.97, 0.9


def unit(rows) -> np.ndarray:
    x = np.array(list(rows), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on a sample in a fixed order."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        best = (sample @ c.T).argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, best, sample)
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(norm > 0, new / np.maximum(norm, 1e-12), c)
    return c


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Out-neighbours (-1 pads) of each node among its nearest in the shard: a neighbour that an earlier one covers goes."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return np.full((n, 1), -1, np.int32)
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
    far = np.maximum(1 - np.take_along_axis(sim, near, 1), 0)
    alive = np.ones(near.shape, bool)
    out = np.full((n, degree), -1, np.int32)
    rows = np.arange(n)
    for d in range(min(degree, k)):
        has = alive.any(axis=1)
        if not has.any():
            break
        first = alive.argmax(axis=1)
        pick = near[rows, first]
        out[has, d] = pick[has]
        between = np.maximum(1 - sim[pick[:, None], near], 0)
        alive &= alpha * between > far
        alive[rows, first] = False
    return out


def range_search(x: np.ndarray, lists: np.ndarray, low: float) -> np.ndarray:
    """found[q, v]: node v was visited for query q and has a similarity of ``low`` or more. Queries are the nodes themselves."""
    n = len(x)
    # the medoid, then the query's own node: as a row of the index it is always in its own range
    medoid = int((x @ x.mean(axis=0)).argmax())
    found = np.zeros((n, n), bool)
    for a in range(0, n, QUERIES_AT_ONCE):
        q = np.arange(a, min(n, a + QUERIES_AT_ONCE))
        m = len(q)
        sim = np.full((m, n), -2, np.float32)
        spent = np.zeros((m, n), bool)
        rows = np.arange(m)
        sim[rows, medoid] = x[q] @ x[medoid]

        def expand(r: np.ndarray, v: np.ndarray, sim=sim, spent=spent, q=q) -> None:
            spent[r, v] = True
            to = lists[v]
            rr = np.repeat(r, to.shape[1])
            to = to.ravel()
            ok = to >= 0
            rr, to = rr[ok], to[ok]
            ok = sim[rr, to] < -1.5
            rr, to = rr[ok], to[ok]
            for i in range(0, len(rr), 1 << 18):
                s = slice(i, i + (1 << 18))
                sim[rr[s], to[s]] = np.einsum("ij,ij->i", x[q[rr[s]]], x[to[s]])

        # greedy: the best of the beam that is not spent, until a query's whole beam is
        for _ in range(64):
            open_sim = np.where(spent, -3, sim)
            best = open_sim.argmax(axis=1)
            value = open_sim[rows, best]
            floor = np.partition(sim, n - min(BEAM, n), axis=1)[:, n - min(BEAM, n)]
            go = (value > -1.5) & (value >= floor)
            if not go.any():
                break
            expand(rows[go], best[go])
        sim[rows, q] = 1.0
        while True:
            r, v = np.nonzero((sim >= low - SLACK) & ~spent)
            if not len(r):
                break
            expand(r, v)
        found[q] = sim >= low
    return found


def _shards(nodes: DataFrame, overlap: int) -> DataFrame:
    """(shard, node, weight, v, clusters, block) of each node in each of its shards."""
    spark = nodes.sparkSession
    size = nodes.count()
    sample = nodes.select("v", "dim").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    k = max(1, min(MAX_CLUSTERS, len(sample) // 4, math.ceil(size / CLUSTER_NODES)))
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    fitted = {d: centroids(unit(v), max(1, min(k, len(v) // 4))).astype(np.float32) for d, v in by_dim.items()}
    shared = spark.sparkContext.broadcast(fitted)  # at most MAX_CLUSTERS vectors for each dimension in the sample

    def place(frames):
        for f in frames:
            lists = pd.Series([[0]] * len(f), index=f.index, dtype=object)
            for d, part in f.groupby("dim"):
                c = shared.value.get(d)
                if c is not None:
                    s = unit(part["v"]).astype(np.float32) @ c.T
                    w = min(overlap, s.shape[1])
                    lists.loc[part.index] = pd.Series(np.sort(np.argpartition(-s, w - 1, axis=1)[:, :w], axis=1).tolist(), index=part.index)
            yield f.assign(clusters=lists)

    placed = write_shared(nodes.select("node", "weight", "dim", "v").mapInPandas(place, f"node long, weight long, dim int, v {nodes.schema['v'].dataType.simpleString()}, clusters array<int>"), "clusters")
    each = placed.select("*", F.explode("clusters").alias("cluster"))
    full = each.groupBy("dim", "cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD)
    # blocks of half a shard, so that a pair of blocks is one shard; only large clusters have more than one
    blocks = each.join(full, ["dim", "cluster"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / (SHARD // 2)).cast("int"), F.lit(1)))
    mine = blocks.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = mine.select("node", "weight", "dim", "v", "clusters", "cluster", "block", F.explode(others).alias("p"))
    return dealt.select(F.struct("dim", "cluster", "p.i", "p.j").alias("shard"), "node", "weight", "v", "clusters", "cluster", "block")


def links(nodes: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP) -> DataFrame:
    """(node, links, root): for each node and shard, the weight it links with there, and the least node of its group there."""
    shards = write_shared(_shards(nodes, overlap), "shards")

    def build(f: pd.DataFrame) -> pd.DataFrame:
        ids = f["node"].to_numpy()
        out = robust_prune(unit(f["v"]).astype(np.float32))
        a, d = np.nonzero(out >= 0)
        if not len(a):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "near": np.zeros(0, object)})
        b = out[a, d]
        # reversed edges make the graph undirected; each list stays bounded by its shard's in-degree
        return pd.DataFrame({"node": np.concatenate([ids[a], ids[b]]), "to": np.concatenate([ids[b], ids[a]])}).groupby("node")["to"].agg(lambda x: sorted(set(x))).rename("near").reset_index()

    lists = shards.groupBy("shard").applyInPandas(build, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    ready = shards.join(united, "node", "left")

    def search(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node").reset_index(drop=True)
        ids = f["node"].to_numpy()
        exact = unit(f["v"])
        near = [np.asarray(x if x is not None else [], np.int64) for x in f["near"]]
        flat = np.concatenate(near) if near else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(ids)), [len(x) for x in near])
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        ok = ids[at] == flat
        of, at = of[ok], at[ok]
        width = np.bincount(of, minlength=len(ids))
        lists = np.full((len(ids), max(1, int(width.max(initial=0)))), -1, np.int32)
        lists[of, np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)] = at
        found = range_search(exact.astype(np.float32), lists, cosine - 1e-4)
        found |= found.T
        np.fill_diagonal(found, False)
        shard, block = f["shard"].iloc[0], f["block"].to_numpy()
        total = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        weight, cluster = f["weight"].to_numpy(), int(f["cluster"].iloc[0])
        width = max(map(len, f["clusters"]))
        member = np.array([[*c, *[-1 - 0] * (width - len(c))] for c in f["clusters"]])
        a, b = np.nonzero(np.triu(found))
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), 1 << 18):
            s = slice(i, i + (1 << 18))
            keep[s] = np.einsum("ij,ij->i", exact[a[s]], exact[b[s]]) >= cosine
        a, b = a[keep], b[keep]
        while True:  # least label, with pointer jumping
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        # count a pair in the least cluster that both are in, and there in their own pair of blocks
        own = np.ones(len(a), bool)
        if shard["i"] != shard["j"]:
            own &= block[a] != block[b]
        for c in range(width):
            less = member[a, c]
            own &= ~((less >= 0) & (less < cluster) & (member[b] == less[:, None]).any(axis=1))
        np.add.at(total, a[own], weight[b[own]])
        np.add.at(total, b[own], weight[a[own]])
        return pd.DataFrame({"node": ids, "links": total, "root": ids[root]})

    return ready.groupBy("shard").applyInPandas(search, "node long, links long, root long")


def audit(nodes: DataFrame, found: DataFrame, cosine: float = COSINE, queries: int = AUDIT_QUERIES) -> float:
    """Recall of ``found`` (node, links) against brute force, on a bounded sample of nodes drawn by hash: the lesser of the part of all links
    and of the mean part over nodes that have links, so that one large group does not speak for all."""
    spark = nodes.sparkSession
    rows = nodes.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(queries).collect()
    if not rows:
        return 1.0
    shared = spark.sparkContext.broadcast([(r["node"], r["dim"], unit([r["v"]])[0]) for r in rows])

    def scan(frames):
        q = shared.value
        total = np.zeros(len(q), np.int64)
        for f in frames:
            for d, part in f.groupby("dim"):
                mine = [i for i, x in enumerate(q) if x[1] == d]
                if mine:
                    near = unit(part["v"]) @ np.stack([q[i][2] for i in mine]).T >= cosine
                    near &= part["node"].to_numpy()[:, None] != np.array([q[i][0] for i in mine])
                    total[mine] += part["weight"].to_numpy() @ near
        yield pd.DataFrame({"node": [x[0] for x in q], "true_links": total})

    true = nodes.mapInPandas(scan, "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links"))
    got = F.least("true_links", F.coalesce("links", F.lit(0)))
    linked = true.where("true_links > 0").join(found, "node", "left")
    both = linked.agg(F.sum("true_links").alias("t"), F.sum(got).alias("f"), F.avg(got / F.col("true_links")).alias("each")).first()
    return min(both["f"] / both["t"], both["each"]) if both["t"] else 1.0


def near_duplicates(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", cosine: float = COSINE, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    kind = df.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # single precision only where the table has no more
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    nodes = write_shared(rows.where("fine").groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight")).select("least", F.col("least").alias("node"), "weight", F.size("v").alias("dim"), "v"), "nodes")
    if nodes.groupBy("node").count().where("count > 1").take(1):  # an id on several vectors: number nodes by vector
        nodes = nodes.withColumn("node", F.xxhash64("v"))
    for width in (overlap, 2 * overlap, 4 * overlap, 8 * overlap):
        found = write_shared(links(nodes, cosine, width), "links")
        totals = found.groupBy("node").agg(F.sum("links").alias("links"))
        recall = audit(nodes, totals, cosine)
        if recall >= GOAL:
            break
    if recall < LEAST:
        raise RuntimeError(f"the search finds {recall:.3f} of the links, less than {LEAST}")
    groups = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    named = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = named.join(totals, "node").join(least, "component").select("v", "weight", "links", "component_id")
    joined = rows.join(placed.withColumn("fine", F.lit(True)), ["v", "fine"], "left")
    n_links = F.when(F.col("weight").isNotNull(), F.col("links") + F.col("weight") - 1).otherwise(F.lit(0)).cast("long")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id_col), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
