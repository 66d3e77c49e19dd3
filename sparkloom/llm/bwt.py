"""Burrows-Wheeler transforms of string collections and their merge by interleave refinement.

A shard is a list of byte strings; each ends with a separator of its own, so the suffixes of a shard are all
different and its transform can be inverted. Shards are merged as in Holt and McMillan (2014): the merged order is an
*interleave*, a division of merged ranks among shards that keeps each shard's own order, refined round by
round. A round knows, for each suffix, the block of suffixes with the same first h symbols; reading it through
the h-step successor map of each transform (powers of the inverse of LF) gives the blocks of 2h symbols. Each
shard's keys already rise in its own order, so a round merges sorted runs; no suffix is sorted again. Blocks split where the
common prefix ends, so the depth at which a boundary appears bounds the common prefix of its two neighbours,
and the blocks left at the asked depth are the repeated intervals.
"""

from __future__ import annotations

import dataclasses

import numpy as np


@dataclasses.dataclass
class Transform:
    """bwt: the symbol before each suffix, in suffix order; start: where each suffix begins in the shard's text."""

    bwt: np.ndarray
    start: np.ndarray


def symbols(strings: list[bytes]) -> np.ndarray:
    """One symbol string: bytes are shifted above the separators 0..n-1 that end the strings."""
    n = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    out = np.empty(int(sizes.sum()) + n, np.int32)
    ends = np.cumsum(sizes + 1) - 1
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int32) + n
    out[ends] = np.arange(n, dtype=np.int32)
    return out


def transform(strings: list[bytes]) -> Transform:
    """The transform of one shard, by prefix doubling over the suffixes that are still tied."""
    text = symbols(strings)
    n, wide = len(text), np.int64(len(strings) + 256)
    if not n:
        return Transform(text, np.zeros(0, np.int64))
    h = max(1, min(4, 62 // int(wide).bit_length()))
    key = np.zeros(n, np.int64)
    for i in range(h):
        key = key * wide + np.roll(text, -i)
    tied = np.argsort(key, kind="stable")
    key = key[tied]
    rank = np.zeros(n, np.int64)
    while True:
        # rank: the place of the first suffix of a block; a block's members lie side by side in ``tied``
        at = np.arange(len(tied))
        old = rank[tied]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        begun = np.concatenate([[True], old[1:] != old[:-1]])
        rank[tied] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(begun, at, 0))
        alone = fresh & np.concatenate([fresh[1:], [True]])
        tied = tied[~alone]
        if not len(tied):
            break
        key = rank[tied] * np.int64(n) + rank[(tied + h) % n]
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        h *= 2
    start = np.empty(n, np.int64)
    start[rank] = np.arange(n)
    return Transform(text[start - 1], start)


def successor(bwt: np.ndarray) -> np.ndarray:
    """Rank of the suffix one symbol further on, for each rank: the inverse of LF, by a stable sort of the transform."""
    return np.argsort(bwt, kind="stable")


def merge(shards: list[Transform], n_strings: list[int], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Refine the interleave of ``shards`` to ``depth`` symbols.

    Returns (interleave, shard, common): for each merged rank the suffix that stands there (numbered through the shards in
    turn), its shard, and a lower bound of the common prefix with the rank before (the depth of the last round in which
    both shared a block; ``depth`` where the whole prefix is common).
    """
    sizes = [len(s.bwt) for s in shards]
    at = np.concatenate([[0], np.cumsum(sizes)])
    total = int(at[-1])
    step = np.concatenate([successor(s.bwt) + at[i] for i, s in enumerate(shards)])
    # depth 1: the first symbols, sorted in each shard; every separator is a block of its own, below all bytes
    strings = np.concatenate([[0], np.cumsum(n_strings)])
    first = [np.sort(s.bwt).astype(np.int64) for s in shards]
    block = np.concatenate([f + np.where(f < n, strings[i], strings[-1] - n) for i, (f, n) in enumerate(zip(first, n_strings))])
    interleave = np.argsort(block, kind="stable")
    common = np.zeros(total, np.int32)
    k = block[interleave]
    common[1:][k[1:] == k[:-1]] = 1
    h = 1
    ahead = step
    while h < depth:
        g = min(h, depth - h)  # the last round may overlap
        if g < h:
            ahead = power(step, g)
        key = block * np.int64(max(total, int(strings[-1]) + 256)) + block[ahead]
        interleave = np.argsort(key, kind="stable")  # one sorted run for each shard: merged, not sorted anew
        k = key[interleave]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        h += g
        common[~new] = h
        block = np.empty(total, np.int64)
        block[interleave] = np.cumsum(new) - 1
        if h < depth and h * 2 <= depth:
            ahead = ahead[ahead]
    return interleave, np.searchsorted(at, interleave, side="right") - 1, common


def power(step: np.ndarray, n: int) -> np.ndarray:
    """The n-step map, by repeated squaring."""
    out, base = None, step
    while n:
        if n & 1:
            out = base if out is None else base[out]
        n >>= 1
        if n:
            base = base[base]
    return out
