"""Best-fit packing of token pieces into sequences by a configuration linear program.

1. Documents become token pieces (Arrow stage; ids by the tokenizers library): id, piece, start, length, crc.
2. The histogram of lengths, at most one row for each length, goes to the driver.
3. Covering LP over configurations (multisets of lengths that fit a sequence): multiplicative weights keep a price
   for each length, a knapsack dynamic program finds the configurations worth most, the prices of what they cover fall. The sum of the
   rounds is a fractional solution, the prices give a lower bound. It is rounded down, the rest is solved again, and what
   no whole sequence is left of is completed, longest first, by the same knapsack over what is left.
4. The plan is a list of slots for each length: which ranks go to which sequences, at which offset. Ranks are counted
   in two levels (chunks of a hash, then a prefix sum over chunk counts), so no length is gathered in one task.

Plan and histogram have a size bounded by the sequence length, not by the corpus.

Defined cases: a null or empty text is one piece with the end id alone; a document longer than a sequence is cut so that
only its first piece may be shorter; repeated rows are packed each; null ids are kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.bpe import codec
from sparkloom.llm.common import slices, texts, write_shared

CAPACITY = 1024
END_ID = 2
FILE = "byte_bpe_50k.json"
#: Rounds of a program, configurations a round, how fast prices fall with cover, and the part of a demand that one configuration covers.
ROUNDS, AT_ONCE, RATE, STEP = 200, 16, 0.15, 0.1
#: Programs at most, and the part of the pieces that a rounding must leave fewer than for another; how much more a long piece is worth for
#: its size in the last rest.
PHASES, ENOUGH, SLOPES = 4, 0.8, (0.02, 0.1)
BATCH_BYTES = 4 << 20


def pieces(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", file: str = FILE, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every row."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        for b in slices(batches, "text", BATCH_BYTES):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts(b, "text")):
                ids = memoryview(c.encode(text) + end)
                n = len(ids) // 4
                first = n - (n - 1) // capacity * capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * z]))
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "piece", "start", "length", "ids_crc32"])

    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


Configuration = tuple[int, ...]


def knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over lengths 1.. (``price`` by length, -inf where there is none).

    best[c]: the greatest total price of a configuration of at most c tokens; last[c]: the length that completes it, 0 where the last
    token stays free.
    """
    capacity = len(price) - 1
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    backwards = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        value = backwards[capacity - c + 1 :] + price[1 : c + 1]
        i = int(value.argmax())
        best[c], last[c] = (value[i], i + 1) if value[i] > best[c - 1] else (best[c - 1], 0)
        backwards[capacity - c] = best[c]
    return best, last


def completed(length: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best configuration that holds ``length``, as different lengths and how often each stands in it."""
    items, c = [length], len(last) - 1 - length
    while c > 0:
        if last[c]:
            items.append(int(last[c]))
        c -= max(1, int(last[c]))
    return np.unique(items, return_counts=True)


@dataclasses.dataclass
class Solution:
    """A fractional covering: amounts of configurations, the part of each length's demand they cover, its value once scaled to cover
    all, and a lower bound of any covering (by the dual prices)."""

    amounts: dict[Configuration, float]
    cover: np.ndarray
    value: float
    bound: float


def solve(demand: np.ndarray, rounds: int = ROUNDS) -> Solution:
    """The covering program over configurations by multiplicative weights; ``demand`` by length, 0..capacity.

    In each round the price of a length is its size times a weight that falls with what is covered of it; one knapsack prices
    all configurations, and the lengths that are covered least get the best one that holds them, by STEP of its scarcest demand.
    """
    capacity = len(demand) - 1
    on = np.flatnonzero(demand)
    size = np.arange(capacity + 1) / capacity
    amounts: dict[Configuration, float] = {}
    cover = np.zeros(capacity + 1)
    bound = float((size * demand).sum())
    for _ in range(rounds):
        price = np.full(capacity + 1, -np.inf)
        price[on] = size[on] * np.exp(-RATE * (cover[on] - cover[on].mean()) / STEP)
        best, last = knapsack(price)
        bound = max(bound, float((price[on] * demand[on]).sum() / best[capacity]))
        for i in on[np.argsort(cover[on], kind="stable")[:AT_ONCE]].tolist():
            lengths, often = completed(i, last)
            amount = STEP * float((demand[lengths] / often).min())
            config = tuple(np.repeat(lengths, often).tolist())
            amounts[config] = amounts.get(config, 0.0) + amount
            cover[lengths] += often * amount / demand[lengths]
    least = cover[on].min()
    return Solution(amounts, cover, sum(amounts.values()) / least if least > 0 else float("inf"), bound)


def rounded_down(demand: np.ndarray, found: Solution) -> list[tuple[Configuration, int]]:
    """Whole sequences of a fractional solution that no length has too many of; ``demand`` falls by what they hold."""
    packed = []
    for config, amount in found.amounts.items():
        lengths, often = np.unique(config, return_counts=True)
        if n := int(min(amount / found.cover[lengths].max(), (demand[lengths] // often).min())):
            packed.append((config, n))
            demand[lengths] -= n * often
    return packed


def completions(demand: np.ndarray, slope: float) -> list[tuple[Configuration, int]]:
    """The rounding's rest: the longest length that is left gets the best configuration among what is left, until nothing is."""
    demand = demand.copy()
    capacity = len(demand) - 1
    size = np.arange(capacity + 1) / capacity
    packed = []
    while demand.any():
        longest = int(np.flatnonzero(demand)[-1])
        _, last = knapsack(np.where(demand > 0, size * (1 + slope * size), -np.inf))
        lengths, often = completed(longest, last)
        while (demand[lengths] > 0).all():
            often = np.minimum(often, demand[lengths])
            n = int((demand[lengths] // often).min())
            packed.append((tuple(np.repeat(lengths, often).tolist()), n))
            demand[lengths] -= n * often
    return packed


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[Configuration, int]], float]:
    """Configurations and how many sequences take each, which hold ``counts`` exactly, and the program's lower bound.

    The solution is rounded down and the program solved again for what that leaves, up to PHASES times; the few sequences of the last
    rest are completed one length at a time, with the better of SLOPES.
    """
    demand = np.zeros(capacity + 1, np.int64)
    demand[lengths] = counts
    packed: list[tuple[Configuration, int]] = [((capacity,), int(demand[capacity]))] if demand[capacity] else []
    bound = float(demand[capacity])
    demand[capacity] = 0
    for phase in range(PHASES):
        before = int(demand.sum())
        if not before:
            break
        found = solve(demand, rounds)
        bound += found.bound if phase == 0 else 0.0
        packed += rounded_down(demand, found)
        if demand.sum() > ENOUGH * before:
            break
    return packed + min((completions(demand, x) for x in SLOPES), key=lambda p: sum(n for _, n in p)), bound


def slots(packed: list[tuple[Configuration, int]]) -> dict[str, np.ndarray]:
    """For each length, in order of ranks: first rank, first sequence and offset of each run of slots."""
    rank: dict[int, int] = {}
    sequence = 0
    rows = []
    for config, n in packed:
        offset = 0
        for length in sorted(config, reverse=True):
            rows.append((length, rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + n
            offset += length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def pack(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", file: str = FILE, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = df.sparkSession
    cut = write_shared(pieces(df, text_col, id_col, file, capacity, end_id), "pieces")
    chunks = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    chunk = F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(chunks)).cast("int")
    each = cut.withColumn("chunk", chunk)
    sizes = each.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).drop("n")
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    lengths = np.array([r["length"] for r in histogram], np.int64)
    table = slots(plan(lengths, np.array([r["n"] for r in histogram], np.int64), capacity)[0])
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("length", "chunk").orderBy(id_col, "piece", "ids_crc32")) - 1)
    placed = ranked.join(before, ["length", "chunk"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    shared = spark.sparkContext.broadcast(table)  # bounded by the capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        # one ordered key: length, then rank
        key = t["length"].astype(np.float64) * 2.0**40 + t["rank"]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, length * 2.0**40 + rank, side="right") - 1
            cols = [*b.columns[:5], pa.array(t["sequence"][at] + rank - t["rank"][at], pa.int64()), pa.array(t["offset"][at], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return placed.mapInArrow(run, out)
