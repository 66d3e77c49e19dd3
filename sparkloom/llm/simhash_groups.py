"""One document of each group of near-copies: SimHash by multi-index hashing at a similarity of 0.8 (``simhash`` holds radius 2).

Two texts are near-copies if the sets of their lower-cased ``WORDS``-word shingles have a Jaccard similarity of at least
``SIMILARITY``; groups are the connected components of that relation. Texts at 0.8 differ in 15% of their fingerprint's bits, so the
fingerprint is ``SEGMENTS`` x ``BITS`` bits wide, and the ball round a segment holds its likeliest values rather than all of a radius:

1. Texts with equal sets are one node. For each bit the sum over the shingles says how sure the bit is.
2. Of a node's segments the ``ASKED`` surest are asked for; a small Hamming ball of ``PROBES`` values each is enumerated (up to
   ``FLIPS`` of the ``UNSURE`` least sure bits change, likeliest values first). Every node stands in a table under each segment.
   For a pair at exactly 0.8 some probe meets the other's entry with a probability of 0.985 by simulation, at 0.85 of 0.9995.
3. All nodes that meet in an entry are compared, unless they lie in one component by then. Only the order differs: of an entry with
   more than ``CENTRES`` nodes the one that stands among most others in all its entries comes first, and a node starts with the
   ``CENTRES`` foremost of those. This joins most of a large group at a cost in proportion to its nodes. Then every node that asks for
   an entry or stands in it meets all others there, large entries and small, where their components differ.
   A component of ``CROWD`` nodes or more is met as one: by the fingerprint of its most linked node (the centre) and the largest
   distance of a member from it, so that one distance settles a stranger. A node that this leaves near a crowd is held against all
   its members by their texts. Of texts only the shingles in and out of the centre's count: two that share none of the latter have at
   most as many in common as the lesser one has of the former. Few members remain by that, and the first link ends the search.
4. Complete distances decide, where they can: the similarity that the distance stands for has a standard error of 0.024. Pairs
   within ``DOUBT`` of the threshold are decided by the exact similarity of their texts.
5. Of each group the row with the least id stays (null ids last, then by a hash of the row, then any one of equal rows).

Defined cases: null and empty texts have no shingles and are one group; fewer words than a shingle make one shingle; repeated rows
are copies; texts of any length are read whole; an empty table gives an empty result; columns of ``df`` may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import connected_components, slices, texts, write_shared
from sparkloom.llm.simhash import SEED, bit_counts, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
LANES, BITS = 18, 24
SEGMENTS = LANES * 64 // BITS
ASKED, PROBES, UNSURE, FLIPS = 24, 6, 6, 3
CENTRES = 3
#: Nodes of a component that are met as one.
CROWD = 8
#: Nodes of an entry that one task meets at once, and shingles of the members of a crowd.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20
DOUBT = 0.08
BATCH_BYTES = 2 << 20

_draw = np.random.default_rng(SEED)
_ODD = _draw.integers(0, 1 << 63, LANES, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
#: Which of the least sure bits change, for all changes of up to FLIPS bits.
_CHANGES = np.array([[i >> j & 1 for j in range(UNSURE)] for i in range(1 << UNSURE) if i.bit_count() <= FLIPS], np.int64)
_STEP = 1 / 256
_TAIL = np.array([0.5 * math.erfc(i * _STEP / math.sqrt(2)) for i in range(8 * 256)])


def cosine_of(similarity: float) -> float:
    """Cosine of two sets of one size with this Jaccard similarity."""
    return 2 * similarity / (1 + similarity)


def distance_of(similarity: float) -> float:
    """Expected part of the bits in which two fingerprints differ."""
    return math.acos(min(1.0, cosine_of(similarity))) / math.pi


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    return np.unique(shingle_hashes(text, words))


def sums(own: np.ndarray) -> np.ndarray:
    """For each bit of the wide fingerprint, shingles with a 1 less shingles with a 0, in standard deviations."""
    total = np.zeros(LANES * 64, np.int64)
    for i in range(0, len(own), 4096):
        x = own[i : i + 4096, None] * _ODD
        for shift, m in ((30, _MIX[0]), (27, _MIX[1])):
            x ^= x >> np.uint64(shift)
            x *= m
        x ^= x >> np.uint64(31)
        total += bit_counts(x)
    return (2 * total - len(own)) / math.sqrt(max(1, len(own)))


def probes(z: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(values, keys) of rows of ``sums``: each segment's value, and the ASKED x PROBES keys (segment and value) to ask for."""
    rows = len(z)
    z = z.reshape(rows, SEGMENTS, BITS)
    place = np.int64(1) << np.arange(BITS)
    values = ((z > 0) * place).sum(axis=2)
    rho = cosine_of(similarity)
    sure = np.abs(z)
    # the chance that a near-copy at the threshold has the other bit
    flip = np.clip(_TAIL[np.minimum(sure * (rho / math.sqrt(1 - rho * rho)) / _STEP, len(_TAIL) - 1).astype(np.int32)], 1e-9, 0.4999)
    least = np.argpartition(sure, UNSURE, axis=2)[:, :, :UNSURE]
    p = np.take_along_axis(flip, least, 2)
    score = np.log(p / (1 - p)) @ _CHANGES.T
    best = np.argpartition(-score, PROBES - 1, axis=2)[:, :, :PROBES]
    chance = np.log1p(-flip).sum(axis=2) + np.log(np.exp(np.take_along_axis(score, best, 2)).sum(axis=2))
    asked = np.argpartition(-chance, ASKED - 1, axis=1)[:, :ASKED]
    change = (np.take_along_axis(place[least], asked[:, :, None], 1)[:, :, None, :] * _CHANGES[np.take_along_axis(best, asked[:, :, None], 1)]).sum(axis=3)
    keys = (asked[:, :, None] << BITS) + (np.take_along_axis(values, asked, 1)[:, :, None] ^ change)
    return values.astype(np.int32), keys.reshape(rows, -1).astype(np.int32)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / max(1, len(both) - common)


def marked(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(r1, r2, id, node, segments, keys) of every row: hash of the row, node, fingerprint and keys to ask for; no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                sets = [shingles(x, words) for x in texts(part, "text")]
                node = [xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63) for x in sets]
                found = probes(np.stack([sums(x) for x in sets]), similarity)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel())) for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(node, pa.int64()), *lists], names=["r1", "r2", "id", "node", "segments", "keys"])

    row = [*df.columns, *[F.col(c).isNull() for c in df.columns]]
    named = df.select(F.xxhash64(*row).alias("r1"), F.xxhash64(F.lit(SEED), *row).alias("r2"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ints = T.ArrayType(T.IntegerType())
    out = T.StructType([*named.schema.fields[:3], T.StructField("node", T.LongType()), T.StructField("segments", ints), T.StructField("keys", ints)])
    return write_shared(named.mapInArrow(run, out), "near-marks")


def _entries(nodes: DataFrame) -> DataFrame:
    """(key, node): the table of the multi-index, a row for each segment of each node."""
    return nodes.select(F.posexplode("segments").alias("at", "value"), "node").select((F.shiftleft("at", BITS) + F.col("value")).alias("key"), "node")


def _centres(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(centres, shared): the nodes (key, centre, fame) of each key, one of them, with its fame, where they are over CENTRES; the entries (key, node, n) of keys with two nodes or more."""
    entries = _entries(nodes)
    sizes = write_shared(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")), "near-keys")
    shared = write_shared(entries.join(sizes.where("n > 1").select("key", "n"), "key"), "near-shared")
    # the node among most others is the likeliest original of a large group
    large = shared.where(F.col("n") > CENTRES)
    fame = large.groupBy("node").agg(F.sum("n").alias("fame"))
    famous = large.join(fame, "node").groupBy("key").agg(F.max(F.struct("fame", "node")).alias("most")).select("key", F.col("most.node").alias("centre"), F.col("most.fame").alias("fame"))
    alone = F.lit(None).cast("long").alias("fame")
    few = sizes.where("n = 1").select("key", F.col("node").alias("centre"), alone).unionAll(shared.where(F.col("n") <= CENTRES).select("key", F.col("node").alias("centre"), alone))
    return few.unionAll(famous), shared


def _differ(a: str, b: str):
    """Bits in which two fingerprints differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, differ) of pairs of nodes: the complete distance of their fingerprints."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("segments").alias(f"s{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", _differ("sa", "sb").alias("differ"))


def _texts(df: DataFrame, asked: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(node, text) of the nodes asked for, one row each, written."""
    rows = asked.join(nodes.select("node", "r1", "r2"), "node")
    row = [*df.columns, *[F.col(c).isNull() for c in df.columns]]
    named = df.select(F.xxhash64(*row).alias("r1"), F.xxhash64(F.lit(SEED), *row).alias("r2"), F.col(text_col).alias("text"))
    return write_shared(named.join(rows, ["r1", "r2"]).groupBy("node").agg(F.min("text").alias("text")), "near-texts")


def _linked(df: DataFrame, marks: DataFrame, pairs: DataFrame, nodes: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs that are near-copies, written."""
    total = LANES * 64
    far = total * distance_of(max(0.0, similarity - DOUBT))
    close = total * distance_of(min(1.0, similarity + DOUBT))
    near = write_shared(_distances(pairs, nodes).where(F.col("differ") <= far), "near-pairs")
    doubted = near.where(F.col("differ") > close).select("a", "b")
    asked = doubted.select(F.col("a").alias("node")).unionAll(doubted.select("b")).distinct()
    read = _texts(df, asked, nodes, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ta", BATCH_BYTES):
            sets: dict[int, np.ndarray] = {}  # of this slice: a node comes in many of its pairs
            for k, t in ((0, 2), (1, 3)):
                for i, node in enumerate(b.column(k).to_pylist()):
                    if node not in sets:
                        sets[node] = shingles(b.column(t)[i].as_py() or "", words)
            same = [jaccard(sets[x], sets[y]) >= similarity for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    side = lambda k: read.select(F.col("node").alias(k), F.col("text").alias(f"t{k}"))
    exact = doubted.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")
    return write_shared(near.where(F.col("differ") <= close).select("a", "b").unionAll(exact), "near-links")


def groups(df: DataFrame, marks: DataFrame, text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the nodes of ``marked`` rows that are linked with another; component is the group's least node."""
    first = F.min(F.struct("r1", "r2", "segments")).alias("one")
    nodes = write_shared(marks.groupBy("node").agg(first).select("node", "one.r1", "one.r2", "one.segments"), "near-nodes")
    centres, shared = _centres(nodes)
    asked = marks.groupBy("node").agg(F.min("keys").alias("keys")).select("node", F.explode("keys").alias("key"))
    # of the centres of large entries a node takes the most famous ones first; the entries themselves are kept for what these leave open
    famous = F.slice(F.sort_array(F.collect_set(F.when(F.col("fame").isNotNull(), F.struct("fame", "centre"))), asc=False), 1, CENTRES)["centre"]
    of_large = F.collect_set(F.when(F.col("fame").isNotNull(), F.col("key")))
    of_small = F.collect_set(F.when(F.col("fame").isNull(), F.col("centre")))
    met = asked.join(centres, "key").where("node <> centre").groupBy("node").agg(of_small.alias("small"), famous.alias("first"), of_large.alias("large"))
    met = write_shared(met, "near-met")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = met.select("node", F.explode("first").alias("centre")).select(*ordered("node", "centre")).distinct()
    links = _linked(df, marks, stars, nodes, text_col, words, similarity)
    found = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    # nodes that lie in one component by now need no comparison: what is left of small entries, and of large ones
    units, faces = _units(found, links, nodes)
    placed = lambda x: x.join(units, "node", "left").withColumns({"unit": F.coalesce("unit", "node"), "component": F.coalesce("component", "node")})
    met = placed(met)
    standing = placed(shared.where(F.col("n") > CENTRES)).select("key", "unit").distinct()
    many = _in_large(met.select(F.explode("large").alias("key"), "unit"), standing, faces, similarity)
    few = _apart(met.select("unit", "component", F.explode("small").alias("node")), units, faces, similarity)
    pairs = write_shared(few.unionAll(many).distinct(), "near-met-units")
    links = links.unionAll(_linked(df, marks, pairs.where("not crowd_a and not crowd_b").select("a", "b"), nodes, text_col, words, similarity))
    links = links.unionAll(_joining(df, pairs, units, nodes, text_col, words, similarity))
    return connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _units(found: DataFrame, links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, faces): component and unit of the nodes in components; component, segments, radius and crowd of every unit.

    The unit of a node is the most linked node of its component, if that is a crowd, else the node itself. The radius is the largest
    distance of a crowd's member from its unit: nothing is nearer to a member than to the unit, less the radius.
    """
    degree = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    crowds = found.join(degree, "node").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("degree", "node"))["node"].alias("centre")).where(F.col("n") >= CROWD)
    units = write_shared(found.join(crowds.select("component", "centre", "n"), "component", "left").select("node", "component", F.coalesce("centre", "node").alias("unit"), "n"), "near-units")
    away = _distances(units.where("n is not null").select(F.col("node").alias("a"), F.col("unit").alias("b")), nodes)
    radius = away.groupBy("b").agg(F.max("differ").alias("radius")).withColumnRenamed("b", "unit")
    own = nodes.select("node", "segments").join(units, "node", "left").where("unit is null or unit = node")
    faces = own.select(F.col("node").alias("unit"), F.coalesce("component", "node").alias("component"), "segments", F.col("n").isNotNull().alias("crowd"))
    return units, write_shared(faces.join(radius, "unit", "left").withColumn("radius", F.coalesce("radius", F.lit(0))), "near-faces")


def _in_large(asked: DataFrame, standing: DataFrame, faces: DataFrame, similarity: float) -> DataFrame:
    """(a, b, crowd_a, crowd_b) of all units that meet in large entries, lie in different components and may be near.

    ``asked`` (key, unit) are the large entries that a unit asks for, ``standing`` those where it stands; both meet all that stand there.
    """
    standing = write_shared(standing, "near-standing")
    every = write_shared(asked.select("key", "unit").unionAll(standing).distinct(), "near-askers")
    # what a unit asks for tells where a pair has met before; a crowd's would be long
    note = every.join(faces, "unit").groupBy("unit").agg(F.collect_list(F.when(~F.col("crowd"), F.col("key"))).alias("asks"))
    note = write_shared(note.join(faces, "unit"), "near-notes")
    blocks = standing.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    there = standing.join(blocks, "key").select("key", "unit", F.pmod("unit", "blocks").alias("block"))
    askers = every.join(blocks, "key").select("key", "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    noted = lambda x, k: x.join(note, "unit").select("key", "block", F.struct("unit", "component", "segments", "radius", "crowd", "asks").alias(k))
    stands = lambda x, key: x["segments"][F.shiftright(key, BITS).cast("int")] == key.bitwiseAND((1 << BITS) - 1).cast("int")
    far = LANES * 64 * distance_of(max(0.0, similarity - DOUBT))
    one, two = F.col("one"), F.col("two")
    # tests are part of the join's condition: pairs that are far apart never become rows, nor does a pair that meets again
    near = (one["component"] != two["component"]) & (_differ("one.segments", "two.segments") - one["radius"] - two["radius"] <= far)
    before = F.exists(one["asks"], lambda k: (k < F.col("key")) & stands(two, k))
    turned = (one["unit"] > two["unit"]) & F.exists(two["asks"], lambda k: stands(one, k))
    pairs = noted(askers, "one").join(noted(there, "two"), ["key", "block"]).where(near & ~before & ~turned)
    first = one["unit"] < two["unit"]
    return pairs.select(F.least("one.unit", "two.unit").alias("a"), F.greatest("one.unit", "two.unit").alias("b"), F.when(first, one["crowd"]).otherwise(two["crowd"]).alias("crowd_a"), F.when(first, two["crowd"]).otherwise(one["crowd"]).alias("crowd_b"))


def _apart(met: DataFrame, units: DataFrame, faces: DataFrame, similarity: float) -> DataFrame:
    """(a, b, crowd_a, crowd_b) of (unit, component, node): pairs of a unit and the unit of a node that lie in different components and may be near."""
    own = met.distinct().withColumnsRenamed({"unit": "x", "component": "cx"}).join(units, "node", "left")
    own = own.where(F.col("cx") != F.coalesce("component", "node")).select("x", F.coalesce("unit", "node").alias("y"))
    own = write_shared(own.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-apart")
    side = lambda k: faces.select(F.col("unit").alias(k), F.col("segments").alias(f"s{k}"), F.col("radius").alias(f"r{k}"), F.col("crowd").alias(f"crowd_{k}"))
    far = LANES * 64 * distance_of(max(0.0, similarity - DOUBT))
    near = own.join(side("a"), "a").join(side("b"), "b").where(_differ("sa", "sb") - F.col("ra") - F.col("rb") <= far)
    return near.select("a", "b", "crowd_a", "crowd_b")


def _joining(df: DataFrame, pairs: DataFrame, units: DataFrame, nodes: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """(a, b) of (a, b, crowd_a, crowd_b): links of nodes with the crowds they are near, written.

    Where a node and members of a crowd are near-copies, one of these pairs is returned for each block of members: they are one component already.
    """
    members = units.where("n is not null").select("unit", "node", "n")
    sizes = members.select("unit", "n").distinct()
    size = lambda k: sizes.select(F.col("unit").alias(k), F.col("n").alias(f"n{k}"))
    one = pairs.where("crowd_a or crowd_b").join(size("a"), "a", "left").join(size("b"), "b", "left")
    # the larger one is the crowd, the other one's nodes ask
    turned = F.coalesce("nb", F.lit(0)) > F.coalesce("na", F.lit(0))
    one = write_shared(one.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("unit"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("other")), "near-crowds")
    of_other = members.select(F.col("unit").alias("other"), "node")
    asked = one.join(of_other, "other", "left").select("unit", F.coalesce("node", "other").alias("node"), F.lit(1).alias("side"))
    there = members.join(one.select("unit").distinct(), "unit").select("unit", "node", F.lit(0).alias("side"))
    rows = write_shared(asked.unionAll(there), "near-sides")
    read = _texts(df, rows.select("node").distinct(), nodes, text_col)

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, np.zeros(0, np.uint64)
        for b in slices(batches, "text", BATCH_BYTES):
            n, inside, own = [], [], []
            for i, unit in enumerate(b.column(0).to_pylist()):
                if unit != last:
                    last, centre = unit, shingles(b.column(4)[i].as_py() or "", words)
                x = shingles(b.column(3)[i].as_py() or "", words)
                at = np.searchsorted(centre, x)
                same = np.zeros(len(x), bool)
                same[at < len(centre)] = centre[at[at < len(centre)]] == x[at < len(centre)]
                n.append(len(x))
                inside.append(at[same].astype(np.int32))
                own.append(x[~same].view(np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in (inside, own)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int32()), *lists], names=["unit", "node", "side", "n", "inside", "own"])

    both = rows.join(read, "node").join(read.select(F.col("node").alias("unit"), F.col("text").alias("centre")), "unit")
    held = both.select("unit", "node", "side", "text", "centre").mapInArrow(against, "unit long, node long, side int, n int, inside array<int>, own array<long>")
    held = write_shared(held, "near-held")
    # members and askers are dealt in blocks, and each block of one meets each of the other
    part = lambda side: F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("side") == side, F.col("n"))) / BLOCK_SHINGLES)).cast("long")
    blocks = held.groupBy("unit").agg(part(0).alias("members"), part(1).alias("askers"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    mine = lambda n: F.array(F.pmod(F.xxhash64("node"), F.col(n)))
    member = F.col("side") == 0
    dealt = held.join(blocks, "unit").withColumn("x", F.explode(F.when(member, mine("members")).otherwise(every("members"))))
    dealt = dealt.withColumn("y", F.explode(F.when(member, every("askers")).otherwise(mine("askers"))))

    def run(t: pa.Table) -> pa.Table:
        found = first_links(t.filter(pc.equal(t["side"], 1)), t.filter(pc.equal(t["side"], 0)), similarity)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return write_shared(dealt.select("unit", "x", "y", "node", "side", "n", "inside", "own").groupBy("unit", "x", "y").applyInArrow(run, "a long, b long"), "near-links")


def first_links(askers: pa.Table, members: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """(asker, member) for each asker that is a near-copy of a member, with one such member.

    Rows have node, n, inside and own: the size of a node's set, the places of its shingles in the centre's set, and its other shingles.
    """
    if not askers.num_rows or not members.num_rows:
        return []
    whole = lambda t, c: t[c].combine_chunks()
    lists = lambda t, c: (whole(t, c).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(whole(t, c)).to_numpy(zero_copy_only=False))]))
    inside, at = lists(members, "inside")
    own, of_own = lists(members, "own")
    owner = np.repeat(np.arange(members.num_rows), np.diff(of_own))
    order = np.argsort(own, kind="stable")
    own, owner = own[order], owner[order]
    n, n_inside = whole(members, "n").to_numpy(), np.diff(at)
    nodes = whole(members, "node").to_numpy()
    asked_inside, asked_at = lists(askers, "inside")
    asked_own, asked_of = lists(askers, "own")
    out = []
    flags = np.zeros(1 + max([0, *[int(x.max()) for x in (inside, asked_inside) if len(x)]]), bool)
    for i, (node, size) in enumerate(zip(whole(askers, "node").to_pylist(), whole(askers, "n").to_pylist())):
        mine = asked_own[asked_of[i] : asked_of[i + 1]]
        low, high = np.searchsorted(own, mine, "left"), np.searchsorted(own, mine, "right")
        met = high > low
        shared = np.zeros(len(n), np.int64)
        if met.any():
            shared += np.bincount(np.concatenate([owner[x:y] for x, y in zip(low[met].tolist(), high[met].tolist())]), minlength=len(n))
        places = asked_inside[asked_at[i] : asked_at[i + 1]]
        # no more can be in common than this, against what a near-copy must have in common
        spare = np.minimum(n_inside, len(places)) + shared - (size + n) * (similarity / (1 + similarity))
        possible = np.flatnonzero(spare >= -1e-6)
        flags[places] = True
        for k in possible[np.argsort(-spare[possible], kind="stable")].tolist():
            common = int(np.count_nonzero(flags[inside[at[k] : at[k + 1]]])) + int(shared[k])
            if common / max(1, size + int(n[k]) - common) >= similarity:
                out.append((node, int(nodes[k])))
                break
        flags[places] = False
    return out


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` without all but one of each group of near-copies."""
    marks = marked(df, text_col, id_col, words, similarity)
    found = groups(df, marks, text_col, words, similarity)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "r1", "r2")
    best = marks.groupBy("node").agg(F.min(order).alias("row")).join(found, "node", "left")
    chosen = best.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("row").alias("row")).select("row.r1", "row.r2")
    repeated = marks.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = write_shared(chosen.join(repeated, ["r1", "r2"], "left").select(F.col("r1").alias("_r1"), F.col("r2").alias("_r2"), F.coalesce("n", F.lit(1)).alias("_n")), "near-kept")
    row = [*df.columns, *[F.col(c).isNull() for c in df.columns]]
    rows = df.select(F.struct(*df.columns).alias("_row"), F.xxhash64(*row).alias("_r1"), F.xxhash64(F.lit(SEED), *row).alias("_r2")).join(kept, ["_r1", "_r2"])
    equal = rows.where("_n > 1").groupBy("_r1", "_r2").agg(F.first("_row").alias("_row"))
    return rows.where("_n = 1").select("_row.*").unionAll(equal.select("_row.*"))
