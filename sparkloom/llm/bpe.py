"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The merges run in the library's BPE model. Around it stands a cache: a text is cut before every space that a
non-space follows, a cut that no pattern match ever crosses, and the ids of each piece are kept. Matches are
encoded one by one, so a piece has the same ids wherever it stands.

Defined cases: a null text is the empty text; an empty text has no ids and decodes to nothing; a null list of
ids decodes to null; an unknown id raises; text of any length is encoded whole. Other columns pass unread.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

from sparkloom.llm.common import slices, texts

#: Pieces and words that one worker keeps; a full cache starts anew (about 220 bytes each).
CACHE_PIECES, CACHE_WORDS = 700_000, 250_000
#: Longer pieces are encoded each time.
CACHED_LENGTH = 40
BATCH_BYTES = 4 << 20


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


ALPHABET = byte_alphabet()
#: Byte-to-character mapping by way of Latin-1, and back.
TO_CHARS = {b: c for b, c in enumerate(ALPHABET)}
TO_BYTES = {ord(c): chr(b) for b, c in enumerate(ALPHABET)}


def as_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARS)


def as_bytes(chars: str) -> bytes:
    return chars.translate(TO_BYTES).encode("latin-1")


def model_of_ranks(path: str) -> models.BPE:
    """A BPE model from a rank file: every way to build a token from two others is a merge with its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    chars = {k: as_chars(k) for k in ranks}
    merges = [(chars[t[:i]], chars[t[i:]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return models.BPE(vocab={chars[k]: v for k, v in ranks.items()}, merges=merges)


def model_of_json(path: str) -> models.BPE:
    return Tokenizer.from_file(path).model


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, model: models.BPE, vocab: dict[str, int], pattern: str = public_tokenizers.PATTERN):
        self.model = model
        self.matches = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.bytes_of = {i: as_bytes(c) for c, i in vocab.items() if all(x in _KNOWN for x in c)}
        self.after_space: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _ids(self, match: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(as_chars(match.encode()))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, match: str) -> bytes:
        """Ids of one pattern match, as little-endian unsigned 32-bit integers."""
        found = self.words.get(match)
        if found is None:
            found = self._ids(match)
            if len(match) <= CACHED_LENGTH:
                if len(self.words) >= CACHE_WORDS:
                    self.words = {}
                self.words[match] = found
        return found

    def piece(self, text: str) -> bytes:
        """Ids of a space and ``text``, which starts with no white space."""
        if m := _PLAIN(text):
            # letters, then a mark or nothing: two matches at most, and the letters may be known without the mark
            letters, mark = m.groups()
            found = (mark and self.after_space.get(letters)) or self._ids(" " + letters)
            if mark:
                found += self.word(mark)
        else:
            found = b"".join(map(self.word, self.matches(" " + text)))
        if len(text) <= CACHED_LENGTH:
            if len(self.after_space) >= CACHE_PIECES:
                self.after_space.clear()
            self.after_space[text] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _LOOSE(text):
            return b"".join(map(self.word, self.matches(text)))
        parts = text.split(" ")
        head, parts[0] = parts[0], ""
        ids = list(map(self.after_space.get, parts))
        ids[0] = b"".join(map(self.word, self.matches(head)))
        if None in ids:
            at = -1
            with contextlib.suppress(ValueError):
                while True:
                    at = ids.index(None, at + 1)
                    ids[at] = self.piece(parts[at])
        return b"".join(ids)

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code-point start and end of each token of ``encode(text)``.

        A token that holds part of a character's bytes spans the whole character, so tokens that share a
        split character overlap there.
        """
        data = text.encode()
        lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        char_of = np.cumsum(lead) - 1
        ids = np.frombuffer(self.encode(text), "<u4")
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids.tolist()]) if len(ids) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        return char_of[starts], char_of[ends - 1] + 1

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_KNOWN = set(ALPHABET)
#: Latin letters that every version of Unicode calls letters, and common marks.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]?)").fullmatch
#: A space before another white-space character: such texts are matched whole.
_LOOSE = re.compile(r" (?:\s|$)").search


@functools.lru_cache(maxsize=4)
def codec(file: str) -> Codec:
    """The codec of a vocabulary file, once for each worker process."""
    path = public_tokenizers.path(file) if "/" not in file else file
    model = model_of_json(path) if path.endswith(".json") else model_of_ranks(path)
    tok = Tokenizer(model)
    return Codec(model, tok.get_vocab())


def encode(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", file: str = "byte_bpe_50k.tiktoken", with_offsets: bool = False) -> DataFrame:
    """(id, ids array<int>[, starts, ends array<int>]) of every row; offsets count code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        for b in slices(batches, "text", BATCH_BYTES):
            rows = texts(b, "text")
            cols = [b.column(0), pa.array([np.frombuffer(c.encode(x), "<u4").astype(np.int32) for x in rows], pa.list_(pa.int32()))]
            if with_offsets:
                spans = [c.offsets(x) for x in rows]
                cols += [pa.array([s[i].astype(np.int32) for s in spans], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "ids", *(["starts", "ends"] if with_offsets else [])])

    kind = df.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("starts", "ends") if with_offsets]
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, bytes binary, text string): the byte table reversed; bytes that form no character become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        for b in batches:
            data = [None if x is None else c.decode_bytes(np.array(x, "<u4").tobytes()) for x in b.column(1).to_pylist()]
            text = [None if x is None else x.decode("utf-8", "replace") for x in data]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary()), pa.array(text, pa.string())], names=[id_col, "bytes", "text"])

    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("bytes", T.BinaryType()), T.StructField("text", T.StringType())]
    return df.select(id_col, ids_col).mapInArrow(run, T.StructType(fields))


def incremental_decoder(file: str = "byte_bpe_50k.tiktoken") -> Callable[[int, bool], str]:
    """A decoder for one id at a time that holds back the bytes of a split character until it is complete."""
    import codecs

    c, d = codec(file), codecs.getincrementaldecoder("utf-8")("replace")
    return lambda i, final=False: d.decode(c.bytes_of[i] if i is not None else b"", final)


def round_trip_digests(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids, and digest both in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        for b in slices(batches, "text", BATCH_BYTES):
            ids = [c.encode(x) for x in texts(b, "text")]
            cols = [
                b.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(c.decode_bytes(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")]
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))
