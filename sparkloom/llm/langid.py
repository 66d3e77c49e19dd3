"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot holds a mask with a bit for each language, and an
n-gram's mask is the AND of its slots, so one lookup returns every language that contains the n-gram. The bits
of all n-grams of a text are counted for each language, corrected for that language's false-positive rate, and
weighed by how few languages share the n-gram; the largest corrected share decides.

Training reads a bounded sample of labelled rows (``TRAIN_ROWS`` for each language, drawn by a hash of the text), so the
filter has one size whatever the corpus. A language contains an n-gram if its rate there is at least
``SHARE`` of the highest rate of any language.

A text with a letter but no known n-gram is read by its known 3-grams, else 2-grams, else single letters (an exact table); where none
is known either it gets the language with most labelled rows, with that language's share of them as its score.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no labelled row every text is ``und`` with score 0; ties go to the language first by name; rows with a null language are not trained on; texts
of any length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import slices, texts

TRAIN_ROWS = 1500
NGRAM = 4
#: n-grams of a language that the filter holds at most: its most frequent ones.
GRAMS = 60_000
SHARE = 0.25
SLOTS = 1 << 21
HASHES = 3
#: Sizes of the n-grams that are read where no n-gram of NGRAM letters is known, in this order, and how many of a language are held.
SHORT = (3, 2, 1)
SHORT_GRAMS = 20_000
#: Languages of one word of a mask.
WORD = 64
#: Arrays of a slice take about 60 bytes a character.
BATCH_BYTES = 256 << 10
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(rows: list[str], size: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased character n-grams of each row, and where each row's begin and end.

    A row is padded with a space at either end; runs of characters other than letters count as one space.
    """
    clean = [" ".join(_words(x)) for x in rows]
    joined = "".join(f" {x} " for x in clean)
    lengths = np.array([len(x) + 2 for x in clean], np.int64)
    ends = np.cumsum(lengths)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(code) < size:
        return np.zeros(0, np.uint64), np.zeros((len(rows), 2), np.int64)
    h = np.zeros(len(code) - size + 1, np.uint64)
    for i in range(size):
        h = (h * _M1) + code[i : len(code) - size + 1 + i] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    starts = ends - lengths
    return h, np.minimum(np.stack([starts, np.maximum(starts, ends - size + 1)], axis=1), len(h))  # the last rows may be too short for one


def has_letter(text: str) -> bool:
    """True if a text has a letter; figures such as a raised two count for word characters but are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


_words = re.compile(r"[^\W\d_]+").findall


def _slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64) for i in range(HASHES)]


@dataclasses.dataclass
class Model:
    """langs in order of their bits; slots: the bit-sliced filter, a row for each word of the masks; false: each language's
    false-positive rate; prior: each language's share of the labelled rows; short: for each short size, sorted hashes of n-grams and
    their masks, a row for each word."""

    langs: list[str]
    slots: np.ndarray
    false: np.ndarray
    prior: np.ndarray | None = None
    short: dict[int, tuple[np.ndarray, np.ndarray]] = dataclasses.field(default_factory=dict)

    @staticmethod
    def build(langs: list[str], grams: np.ndarray, masks: np.ndarray, size: int = SLOTS) -> Model:
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        slots = np.zeros((len(masks), size), kind)
        for at in _slots(grams, size):
            for row, mask in zip(slots, masks.astype(kind)):
                np.bitwise_or.at(row, at, mask)
        filled = np.array([np.count_nonzero(slots[i // WORD] & kind(1 << i % WORD)) for i in range(len(langs))]) / size
        return Model(langs, slots, filled**HASHES)

    def masks(self, h: np.ndarray) -> np.ndarray:
        first, *rest = _slots(h, self.slots.shape[1])
        out = self.slots[:, first]
        for at in rest:
            out = out & self.slots[:, at]
        return out

    def predict(self, rows: list[str]) -> tuple[list[str], np.ndarray]:
        h, spans = gram_hashes([x.lower() for x in rows])
        n_langs = len(self.langs)
        if n_langs == 0:
            return [UNKNOWN] * len(rows), np.zeros(len(rows))
        found = self.masks(h)
        popcount = np.bitwise_count(found).sum(axis=0)
        weight = np.where(popcount > 0, 1.0 / np.maximum(popcount, 1), 0.0) if n_langs > 1 else np.ones(len(h))
        size = np.maximum(spans[:, 1] - spans[:, 0], 1)
        hits = np.empty((len(rows), n_langs))
        for i in range(n_langs):
            bit = ((found[i // WORD] >> found.dtype.type(i % WORD)) & found.dtype.type(1)) * weight
            total = np.concatenate([[0.0], np.cumsum(bit)])
            hits[:, i] = (total[spans[:, 1]] - total[spans[:, 0]]) / size
        # an n-gram of no language shows this one's bit with the false-positive rate
        hits = np.maximum((hits - self.false) / (1 - self.false), 0)
        best, total = hits.argmax(axis=1), hits.sum(axis=1)
        score = np.where(total > 0, hits.max(axis=1) / np.maximum(total, 1e-12), 0.0)
        letters = np.array([has_letter(x) for x in rows])
        score = np.where(letters, score, 0.0)
        for i in np.flatnonzero(letters & (total <= 0)).tolist():
            best[i], score[i] = self.guess(rows[i].lower())
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), letters.tolist())], score

    def guess(self, row: str) -> tuple[int, float]:
        """Language and score of a text with a letter by its short n-grams, at last by the labelled rows alone."""
        for n in SHORT:
            hashes, masks = self.short.get(n, (np.zeros(0, np.uint64), np.zeros((1, 0), np.uint64)))
            h, _ = gram_hashes([row], n)
            if not len(hashes) or not len(h):
                continue
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found = masks[:, at[hashes[at] == h]]
            if found.size:
                bits = np.stack([found[i // WORD] >> np.uint64(i % WORD) & np.uint64(1) for i in range(len(self.langs))], axis=1)
                hits = (bits / bits.sum(axis=1, keepdims=True)).sum(axis=0)
                return int(hits.argmax()), float(hits.max() / hits.sum())
        prior = np.ones(len(self.langs)) / len(self.langs) if self.prior is None else self.prior
        return int(prior.argmax()), float(prior.max())


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, grams: int = GRAMS, share: float = SHARE) -> Model:
    """Fit on a sample of about ``rows`` rows of each language (all of a language that has fewer)."""
    data = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in data.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((1, SLOTS), np.uint8), np.zeros(0))
    langs = sorted(sizes)
    part = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows / sizes[k])))])
    sample = data.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.try_element_at(part, F.col("lang")) * float(1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            of = np.array(b.column(1).to_pylist(), object)
            for lang in set(of):
                own = [x.lower() for x, k in zip(texts(b, "text"), of) if k == lang]
                for size in (NGRAM, *SHORT):
                    h, spans = gram_hashes(own, size)
                    inside = np.concatenate([np.arange(a, z) for a, z in spans.tolist()]) if len(h) else np.zeros(0, np.int64)
                    g, n = np.unique(h[inside], return_counts=True)
                    cols = [pa.array([lang] * len(g), pa.string()), pa.array([size] * len(g), pa.int32()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "size", "g", "n"])

    counted = sample.mapInArrow(count, "lang string, size int, g long, n long").groupBy("lang", "size", "g").agg(F.sum("n").alias("n"))
    # a padding space or two alone are no n-gram of a language
    blank = [int(gram_hashes([""], n)[0].view(np.int64)[0]) for n in (1, 2)]
    counted = counted.where((F.col("n") > 1) | (F.col("size") < NGRAM)).where(~((F.col("size") <= 2) & F.col("g").isin(blank)))
    held = F.when(F.col("size") == NGRAM, grams).otherwise(SHORT_GRAMS)
    top = counted.withColumn("r", F.row_number().over(_by_count())).where(F.col("r") <= held).select("lang", "size", "g", "n").toPandas()
    bit = {k: i for i, k in enumerate(langs)}
    tables = {}
    for size in (NGRAM, *SHORT):
        part = top[top["size"] == size]
        ids, at = np.unique(part["g"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        rate = np.zeros((len(ids), len(langs)))
        np.add.at(rate, (at, part["lang"].map(bit).to_numpy(np.int64)), part["n"].to_numpy(float))
        rate /= np.maximum(rate.sum(axis=0), 1)
        holds = (rate > 0) & (rate >= share * rate.max(axis=1, keepdims=True, initial=0))
        parts = [holds[:, i : i + WORD] for i in range(0, len(langs), WORD)]
        tables[size] = ids, np.stack([(x * (np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64))).sum(axis=1).astype(np.uint64) for x in parts])
    model = Model.build(langs, *tables.pop(NGRAM))
    rows_of = np.array([sizes[k] for k in langs], float)
    return dataclasses.replace(model, prior=rows_of / rows_of.sum(), short=tables)


def _by_count():
    from pyspark.sql import Window

    return Window.partitionBy("lang", "size").orderBy(F.desc("n"), "g")


def predict(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score) of every row; only the text decides."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # SLOTS bytes for up to eight languages, eight times that for each 64 else, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "text", BATCH_BYTES):
            lang, score = m.predict(texts(b, "text"))
            cols = [*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *keep, "lang_pred", "score"])

    fields = [df.schema[c] for c in (id_col, *keep)] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return df.select(F.col(text_col).alias("text"), F.col(id_col), *keep).mapInArrow(run, T.StructType(fields))


def held_out(id_col: str = "doc_id"):
    """True for the rows that training must not see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a language that the model knows."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, BATCH_BYTES):
            lang, _ = shared.value.predict(texts(b, text_col))
            yield b.filter(pa.array([x != UNKNOWN for x in lang], pa.bool_()))

    return df.mapInArrow(run, df.schema)
