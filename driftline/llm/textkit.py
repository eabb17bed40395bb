"""Vectorised text primitives shared by the operators: words, shingles and 64-bit hashes of Arrow batches.

Words are maximal runs of bytes other than space and ``\\t``-``\\r`` (the pattern
``[^\\x20\\x09-\\x0D]+``), kept as they are. All hashes are polynomials modulo 2**64 read off prefix
sums, so a hash of any run of bytes or words costs a subtraction and a product, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept per process and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        _powers[base] = have = p
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler, so that all bits of a polynomial hash are usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]] for every i; equal runs have equal hashes in every batch."""
    n = len(values) + 1
    prefix = np.zeros(n, np.uint64)
    np.cumsum(values * powers(base, n)[: n - 1], out=prefix[1:])
    inverse = powers(pow(base, -1, 1 << 64), n)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


class Words:
    """The words of a slice of an Arrow string array.

    ``starts``/``ends`` index ``data`` (all texts' UTF-8 bytes in a row); ``first[i]:first[i+1]`` are
    the words of text i. Null texts have no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = utf8(texts)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        inner = solid[1:-1]
        self.starts = np.flatnonzero(inner & (~solid[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inner & (~solid[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        return run_hashes(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, _BYTE_BASE)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offsets of each; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def gram_hashes(word_hashes: np.ndarray, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Hash of each run of ``length`` words from ``starts``."""
    return run_hashes(word_hashes, starts, starts + length, _WORD_BASE)


def gram_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every ``size``-gram that stays in its text, and how many each text has."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    return ranges(first[:-1], n), n


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - starts, counts)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 << 20, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text and ``rows`` rows at most, so that memory follows
    a text, not a batch."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        at = np.cumsum(np.diff(utf8(texts)[1]))
        begin = 0
        while begin < len(texts):
            base = at[begin - 1] if begin else 0
            end = min(begin + rows, max(begin + 1, int(np.searchsorted(at, base + size, "right"))))
            yield batch.slice(begin, end - begin)
            begin = end


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Tally:
    """Counts of 64-bit keys, summed whenever a few million are waiting."""

    def __init__(self, most: int = 3_000_000):
        self.most, self.waiting, self.size = most, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size > self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.waiting, self.size = [], 0
            keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        return self.keys, self.counts
