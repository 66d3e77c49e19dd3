"""Exact substring deduplication by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``span`` (400) bytes that covers it also starts anywhere else. Steps:

1. Equal texts become one (``n_copies``); a text with copies repeats as a whole. The distinct texts are written once, in
   buckets by their key, so that no later step shuffles a text again.
2. Anchors: each ``span``-byte window names the least of its 32-byte hashes (minimizer). Equal windows name the same hash
   at the same place, so a window can repeat only if its anchor occurs twice in the corpus.
3. Windows of a repeated anchor form candidate strings, named by (anchor, block of places, the bytes that all windows of that block
   share). Equal windows share all three, so their strings are of one group. A string that comes again in its own text repeats
   whole, and counts once for that text. Only hashes of groups and strings are counted: a group of one string is no candidate,
   and a group of equal strings repeats whole.
4. A group of over ``GROUP_STRINGS`` different strings (a passage that many documents share, in different surroundings) is divided
   by narrower blocks of places, at last by whole windows, where all strings of a group are equal. So no group is large.
5. Each task forms shards of the different strings of its groups, builds their transforms and merges them (``bwt``).
   Where the common prefix of neighbours in the merged order is ``span`` or longer, their interval repeats.
6. Intervals return to their texts, and the covered bytes are cut.

Groups and strings are named by 64-bit hashes each, 128 bits together; a key of a text is 120 bits of its SHA-256.

Defined cases: a null text is empty; texts shorter than ``span`` bytes lose nothing; repeated rows count as
copies (equal rows with equal ids too); windows within one text count; an empty table gives an empty result;
rows with a null id are kept; texts of any length are read whole; ties do not occur, every copy is cut; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import bwt
from sparkloom.llm.common import slices, write_buckets, write_shared

SPAN = 400
GRAM = 32
#: Places of a window before its anchor that one group covers, at first and where a group has too many different strings.
PLACES = (128, 16, 1)
GROUP_STRINGS = 256
#: Window starts of a text that are worked on at once; anchors order by place within it.
PIECE = 1 << 19
#: Bytes of strings in one shard and in one merge.
SHARD_BYTES, MERGE_BYTES = 1 << 17, 1 << 20
BATCH_BYTES = 4 << 20

_M = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_LOW = np.uint64((1 << 20) - 1)
_CANDIDATE = "group long, string long, k1 long, k2 long, start int, size int, place int"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _M[4]
    h ^= h >> np.uint64(31)
    width = 1
    for m in _M:
        h = h[:-width] * m + h[width:]
        width *= 2
    h ^= h >> np.uint64(33)
    h *= _M[1]
    h ^= h >> np.uint64(29)
    return h


def anchors(data: bytes, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window) of each run of windows with one anchor, in order; runs end where the next begins."""
    found = []
    for base in range(0, len(data) - span + 1, PIECE):
        part = np.frombuffer(data, np.uint8)[base : base + PIECE + span - 1]
        h = gram_hashes(part)
        # least hash of a window, the leftmost of equals: the place in the low bits settles ties
        m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, reach = 1, span - GRAM + 1
        while width * 2 <= reach:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < reach:
            m = np.minimum(m[: len(m) - (reach - width)], m[reach - width :])
        start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        place = (m[start] & _LOW).astype(np.int64)
        found.append((h[place], place + base, start + base))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def strings_of(data: bytes, name: int, place: int, first: int, last: int, width: int, span: int) -> Iterator[tuple[int, int, int, int]]:
    """(group, string, start, size) of the windows first..last with an anchor at ``place``, in blocks of ``width`` places."""
    for block in range((place - last) // width, (place - first) // width + 1):
        near = place - block * width
        far = max(near - width + 1, place - (span - GRAM))
        lo, hi = max(first, far), min(last, near)
        group = xxhash.xxh64_intdigest(data[near : far + span], (name ^ block) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
        yield group, xxhash.xxh64_intdigest(data[lo : hi + span], width) - (1 << 63), lo, hi - lo + span


def rows_of(found: list[tuple[int, int, int, int, int]], k1: int, k2: int) -> list[tuple]:
    """_CANDIDATE rows of one text: each of its strings once, and without a group the bytes of those that come again."""
    first: dict[tuple[int, int], tuple] = {}
    again: set[tuple[int, int]] = set()
    for g, s, lo, size, place in found:
        kept = first.setdefault((g, s), (g, s, k1, k2, lo, size, place))
        if kept[4] != lo:
            again |= {(lo, lo + size), (kept[4], kept[4] + size)}
    runs = sorted(again)
    return [*first.values(), *((None, None, k1, k2, a, z - a, None) for a, z in union([a for a, _ in runs], [z for _, z in runs]))]


def repeated_windows(strings: list[bytes], span: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each string, which of its window starts hold a ``span``-byte string that starts elsewhere in ``strings``."""
    shards, held = [[]], 0
    for s in strings:
        if held and held + len(s) > shard_bytes:
            shards.append([])
            held = 0
        shards[-1].append(s)
        held += len(s)
    made = [bwt.transform(s) for s in shards]
    order, _, common = bwt.merge(made, [len(s) for s in shards], span)
    begin = np.concatenate([np.arange(0, 1), np.cumsum([len(t.bwt) for t in made])])
    # a suffix repeats if it has the whole span in common with the one before or after it; separators never do
    whole = common >= span
    repeats = np.empty(len(order), bool)
    repeats[order] = whole | np.concatenate([whole[1:], [False]])
    out = []
    for i, (t, shard) in enumerate(zip(made, shards)):
        flags = np.empty(len(t.bwt), bool)
        flags[t.start] = repeats[begin[i] : begin[i + 1]]
        at = 0
        for s in shard:
            out.append(flags[at : at + max(0, len(s) - span + 1)])
            at += len(s) + 1
    return out


def _records(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=names)


_KINDS = [pa.int64()] * 4 + [pa.int32()] * 3
_NAMES = [x.split()[0] for x in _CANDIDATE.split(", ")]


def _keyed(df: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(k1, k2, row, text): key of the text, the kept columns as one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = F.sha2(text.cast("binary"), 256)
    halves = [F.conv(F.substring(d, i, 15), 16, 10).cast("long").alias(k) for i, k in ((1, "k1"), (16, "k2"))]
    return df.select(*halves, F.struct(*keep).alias("row"), text.alias("text"))


def _distinct(keyed: DataFrame, span: int) -> DataFrame:
    """(k1, k2, n_copies, row, text, anchors, places, firsts) of each different text, in buckets by key; row is any of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            found = [anchors(x.encode(), span) for x in b.column(4).to_pylist()]
            lists = [pa.array([x[0].view(np.int64) for x in found], pa.list_(pa.int64()))] + [pa.array([x[i].astype(np.int32) for x in found], pa.list_(pa.int32())) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=[*b.schema.names, "anchors", "places", "firsts"])

    one = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_copies"), F.first(F.struct("row", "text")).alias("one")).select("k1", "k2", "n_copies", "one.row", "one.text")
    out = T.StructType([*one.schema.fields, T.StructField("anchors", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("firsts", T.ArrayType(T.IntegerType()))])
    return write_buckets(one.mapInArrow(run, out), "texts", ("k1", "k2"))


def _candidates(texts: DataFrame, span: int) -> DataFrame:
    """_CANDIDATE rows of all windows whose anchor occurs twice or more in the corpus."""
    each = texts.select("k1", "k2", F.explode("anchors").alias("anchor"))
    repeated = write_shared(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "repeated")
    wanted = each.join(repeated, "anchor").groupBy("k1", "k2").agg(F.collect_set("anchor").alias("wanted"))
    rows = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "anchors", "places", "firsts", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            out: list[tuple] = []
            for i in range(b.num_rows):
                k1, k2, text = (b.column(c)[i].as_py() for c in range(3))
                name, place, first, wanted = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(3, 7))
                data = text.encode()
                last = np.concatenate([first[1:] - 1, [len(data) - span]])
                found = []
                for j in np.flatnonzero(np.isin(name, wanted)).tolist():
                    p = int(place[j])
                    found += [(*x, p) for x in strings_of(data, int(name[j]), p, int(first[j]), int(last[j]), PLACES[0], span)]
                out += rows_of(found, k1, k2)
            yield _records(out, _KINDS, _NAMES)

    return rows.mapInArrow(run, _CANDIDATE)


def _narrower(texts: DataFrame, large: DataFrame, width: int, span: int) -> DataFrame:
    """_CANDIDATE rows of the same windows in blocks of ``width`` places."""
    gathered = large.groupBy("k1", "k2").agg(F.collect_list(F.struct("group", "start", "size", "place")).alias("asked"))
    rows = texts.select("k1", "k2", "text").join(gathered, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            for k1, k2, text, asked in zip(*(b.column(c).to_pylist() for c in range(4))):
                data = text.encode()
                found = [(*y, x["place"]) for x in asked for y in strings_of(data, x["group"], x["place"], x["start"], x["start"] + x["size"] - span, width, span)]
                yield _records(rows_of(found, k1, k2), _KINDS, _NAMES)

    return rows.mapInArrow(run, _CANDIDATE)


def _bytes_of(texts: DataFrame, different: DataFrame) -> DataFrame:
    """(group, string, n, bytes) of different strings, cut out of the text that each was first seen in."""
    gathered = different.groupBy("source.k1", "source.k2").agg(F.collect_list(F.struct("group", "string", "n", "source.start", "source.size")).alias("asked"))
    rows = texts.select("k1", "k2", "text").join(gathered, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            for text, asked in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                data = text.encode()
                for i in range(0, len(asked), 1024):
                    part = [(x["group"], x["string"], x["n"], data[x["start"] : x["start"] + x["size"]]) for x in asked[i : i + 1024]]
                    yield _records(part, [pa.int64()] * 3 + [pa.binary()], ["group", "string", "n", "bytes"])

    return rows.mapInArrow(run, "group long, string long, n long, bytes binary")


def _merged(strings: DataFrame, span: int) -> DataFrame:
    """(group, string, first, last): runs of a string's windows that repeat, by merged transforms of the strings of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= MERGE_BYTES and row[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield found(held)

    def found(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (group, string, n, _), flags in zip(held, repeated_windows([x[3] for x in held], span)):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], flags | (n > 1), [False]]).astype(np.int8)))
            rows += [(group, string, a, z - 1) for a, z in edges.reshape(-1, 2).tolist()]
        return _records(rows, [pa.int64()] * 2 + [pa.int32()] * 2, ["group", "string", "first", "last"])

    return strings.repartition("group").sortWithinPartitions("group").mapInArrow(run, "group long, string long, first int, last int")


def _spans(texts: DataFrame, span: int) -> DataFrame:
    """(k1, k2, start, stop): bytes of texts that repeated windows cover; pieces may overlap."""
    made = write_shared(_candidates(texts, span), "candidates")
    out = []
    for level, width in enumerate(PLACES):
        rows = made.where("group is not null")
        out.append(made.where("group is null").select("k1", "k2", "start", (F.col("start") + F.col("size")).alias("stop")))
        groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), (F.min("string") < F.max("string")).alias("mixed")).where("n > 1").drop("n")
        groups = write_shared(groups, "groups")
        out.append(rows.join(groups.where("not mixed"), "group").select("k1", "k2", "start", (F.col("start") + F.col("size")).alias("stop")))
        if width == 1:  # a group's core is the whole window: all its strings are equal
            break
        of_mixed = rows.join(groups.where("mixed"), "group").drop("mixed")
        source = F.min(F.struct("k1", "k2", "start", "size")).alias("source")
        different = write_shared(of_mixed.groupBy("group", "string").agg(F.count(F.lit(1)).alias("n"), source), "strings")
        large = write_shared(different.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_STRINGS).select("group"), "large")
        found = write_shared(_merged(_bytes_of(texts, different.join(large, "group", "left_anti")), span), "merged")
        out.append(rows.join(found, ["group", "string"]).select("k1", "k2", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + span).alias("stop")))
        if not large.take(1):
            break
        made = write_shared(_narrower(texts, rows.join(large, "group"), PLACES[level + 1], span), "candidates")
    spans = out[0]
    for x in out[1:]:
        spans = spans.unionAll(x)
    return spans


def cut(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), span: int = SPAN) -> DataFrame:
    """(*keep, n_bytes, spans, kept): what is cut of every row, and the bytes that stay.

    spans are the maximal runs [start, stop) that go, in order; kept is binary.
    """
    keyed = _keyed(df, text_col, keep)
    texts = _distinct(keyed, span)
    parts = _spans(texts, span).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("parts"))
    single = texts.where("n_copies = 1").select("k1", "k2", "row", "text").join(parts, ["k1", "k2"], "left").select("row", "text", F.expr("transform(parts, p -> p.start)").alias("starts"), F.expr("transform(parts, p -> p.stop)").alias("stops"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            sizes, spans, kept = [], [], []
            for text, starts, stops in zip(*(b.column(1 + i).to_pylist() for i in range(3))):
                data = text.encode()
                runs = union(starts or [], stops or [])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2])))
                sizes.append(len(data))
                spans.append([{"start": a, "stop": z} for a, z in runs])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], names=["row", "n_bytes", "spans", "kept"])

    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    out = T.StructType([single.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(pair)), T.StructField("kept", T.BinaryType())])
    # rows of a text with copies need no spans: all of it goes, or nothing of one shorter than the span
    copied = write_shared(texts.where("n_copies > 1").select("k1", "k2"), "copied")
    n = F.octet_length("text").cast("long")
    rows = keyed.select("k1", "k2", "row", n.alias("n_bytes"), F.when(n < span, F.col("text")).alias("short")).join(copied, ["k1", "k2"])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    copies = rows.select("row", "n_bytes", F.when(F.col("n_bytes") < span, F.slice(whole, 1, 0)).otherwise(whole).alias("spans"), F.coalesce("short", F.lit("")).cast("binary").alias("kept"))
    both = single.mapInArrow(run, out).unionAll(copies)
    return both.select(*[F.col("row")[c].alias(c) for c in keep], "n_bytes", "spans", "kept")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def union(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of intervals that come in order of their starts."""
    runs: list[tuple[int, int]] = []
    for a, z in zip(starts, stops):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(z, runs[-1][1]))
        else:
            runs.append((a, z))
    return runs


def as_text(kept: str):
    """Kept bytes as text; bytes of a character that a cut splits go with it."""
    text = F.col(kept).cast("string")
    return F.coalesce(F.try_validate_utf8(text), F.regexp_replace(F.make_valid_utf8(text), "�", ""))


def digests(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", span: int = SPAN) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, text) of every row; text is what stays."""
    done = cut(df, text_col, (id_col,), span)
    return done.select(
        id_col,
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
        as_text("kept").alias("text"),
    )


def brute_force(texts: list[str | None], span: int = SPAN) -> list[tuple[int, int, int, str]]:
    """The same digests of a small list, by a dictionary of all windows."""
    data = [(x or "").encode() for x in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - span + 1):
            seen[d[i : i + span]] = seen.get(d[i : i + span], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        out.append((len(d), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def cut_texts(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), span: int = SPAN) -> DataFrame:
    """(*keep, text): the rest of every text."""
    return cut(df, text_col, keep, span).select(*keep, as_text("kept").alias("text"))
