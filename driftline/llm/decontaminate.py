"""Benchmark passages in documents, by the q-gram lemma.

Texts are normalised (lower-cased A-Z, white space collapsed to single spaces) and compared as UTF-8
bytes. A benchmark item is split into segments of at most ``SEGMENT`` bytes, overlapping by half, and a longer
one than ``PART`` bytes into segments of that size as well, so that every part of an item of one and a half such (300
bytes) holds a whole one. A segment of m bytes that occurs in a text with at most
e = floor(RATE * m) edits shares at least m + 1 - Q (e + 1) of its q-grams with a region of the text, on
diagonals (place in the text minus place in the segment) that differ by at most e.

Counting is per task: each text's q-grams are looked up in the segments' q-grams, hits are binned into
overlapping bands of diagonals 2 (e + 1) wide, and bands whose count of distinct segment q-grams
reaches the bound are regions. A region is verified by aligning the segment within the band, free at
both ends in the text. A segment too short for a positive bound is cut into e + 1 pieces, of which one must occur as it
is; the text around each occurrence is aligned.

A benchmark of up to ``BROADCAST`` bytes of segments is sent to every task. A larger one is dealt in
blocks of that size, one pass over the documents for each block: a stated query set against all rows.

Null and empty texts match nothing, nor do empty items; items with equal texts are all reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, powers, slices

Q = 11
RATE = 0.06
SEGMENT, PART = 400, 200
BROADCAST = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_WHITE = re.compile(rb"[\x20\x09-\x0D]+")


def normalise(text: str | None) -> bytes:
    return LOWER[np.frombuffer(_WHITE.sub(b" ", (text or "").encode()).strip(), np.uint8)].tobytes()


def _gram_codes(data: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes from every place (one place for each possible start)."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, p in enumerate(powers(_BASE, Q)):
        out += (data[i : i + n].astype(np.uint64) + np.uint64(1)) * p
    return out ^ (out >> np.uint64(29))


class Index:
    """The segments of a block of items, and their q-grams in order of hash."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.segments: list[tuple[int, int, bytes]] = []  # item, start, bytes
        for item, text in items:
            body = normalise(text)
            for most in (SEGMENT, PART) if len(body) > PART else (SEGMENT,):
                last = max(0, -(-(len(body) - most) // (most // 2))) if body else -1
                for i in range(last + 1):
                    begin = min(i * most // 2, max(0, len(body) - most))
                    self.segments.append((item, begin, body[begin : begin + most]))
        size = np.array([len(s[2]) for s in self.segments], np.int64)
        self.edits = np.floor(RATE * size).astype(np.int64)
        self.bound = size + 1 - Q * (self.edits + 1)
        tight = self.bound < 1
        self.short: list[tuple[int, int, bytes]] = []  # segment, place in it, piece
        for i in np.flatnonzero(tight | (size < Q)).tolist():
            body, parts = self.segments[i][2], int(self.edits[i]) + 1
            cuts = [len(body) * k // parts for k in range(parts + 1)]
            self.short += [(i, a, body[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        codes = [_gram_codes(np.frombuffer(b"" if t else s[2], np.uint8)) for s, t in zip(self.segments, tight.tolist(), strict=True)]
        n = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate([*codes, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.code = flat[order]
        self.segment = np.repeat(np.arange(len(codes)), n)[order]
        self.place = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n))[order]
        self.bits = 20
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._slot(self.code)] = True

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in data, segment, place in the segment) of all shared q-grams."""
        code = _gram_codes(data)
        at = np.flatnonzero(self.maybe[self._slot(code)])
        low, high = np.searchsorted(self.code, code[at], "left"), np.searchsorted(self.code, code[at], "right")
        n = high - low
        entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.segment[entry], self.place[entry]

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the passages of the normalised text that verify. Overlapping matches of one
        item's segments are one passage, with the most edits of any of them."""
        body = normalise(text)
        data = np.frombuffer(body, np.uint8)
        found: list[tuple[int, int, int, int]] = []
        for s, own, piece in self.short:
            item, _, segment = self.segments[s]
            e, at = int(self.edits[s]), body.find(piece)
            while at >= 0:
                begin = max(0, at - own - e)
                if match := aligned(segment, body[begin : at - own + len(segment) + e], e):
                    found.append((item, begin + match[0], begin + match[1], match[2]))
                at = body.find(piece, at + 1 if e else at + len(piece))
        place, segment, own = self.hits(data)
        if not len(place):
            return sorted(found)
        diagonal = place - own + SEGMENT
        width = self.edits[segment] + 1
        band = diagonal // width
        span = len(data) + 2 * SEGMENT + 2
        # bands of 2 (e + 1) diagonals, each overlapping its neighbours by half: a hit counts in its own and in the one before
        key = np.concatenate([(segment * span + np.maximum(band - shift, 0)) * (SEGMENT + 1) + own for shift in (0, 1)])
        bands, count = np.unique(np.unique(key) // (SEGMENT + 1), return_counts=True)
        ok = count >= self.bound[bands // span]
        regions = zip((bands // span)[ok].tolist(), (bands % span)[ok].tolist(), strict=True)
        for s, b in regions:
            item, _, pattern = self.segments[s]
            e = int(self.edits[s])
            begin = b * (e + 1) - SEGMENT
            region = slice(max(0, begin - e), max(0, begin + 2 * (e + 1) + len(pattern) + e))
            if match := aligned(pattern, body[region], e):
                found.append((item, region.start + match[0], region.start + match[1], match[2]))
        passages: list[tuple[int, int, int, int]] = []
        for item, start, end, cost in sorted(found):
            if passages and passages[-1][0] == item and start < passages[-1][2]:
                _, first, last, most = passages[-1]
                passages[-1] = (item, first, max(last, end), max(most, cost))
            else:
                passages.append((item, start, end, cost))
        return passages


def aligned(pattern: bytes, region: bytes, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence of pattern in region, if it is within the budget."""
    end, cost = align(pattern, region, budget)
    if cost > budget:
        return None
    low, _ = align(pattern[::-1], region[:end][::-1], budget)
    return end - low, end, cost


def align(pattern: bytes, region: bytes, budget: int) -> tuple[int, int]:
    """(end, edits) of the best occurrence of pattern in region, free at both ends of the region.

    One row of the alignment matrix at a time; only the diagonals that the region leaves are present.
    """
    p, r = np.frombuffer(pattern, np.uint8), np.frombuffer(region, np.uint8)
    if (at := region.find(pattern)) >= 0:
        return at + len(pattern), 0
    width = len(r) - len(p) + 2 * budget + 1  # places where the match may lie on the first row's diagonal
    if width <= 0 or not len(p):
        return 0, len(p)
    far = len(p) + 1
    offset = np.arange(width) - budget  # column of the matrix minus row
    row = np.where((offset >= 0) & (offset <= len(r)), 0, far)
    ramp = np.arange(width)
    for i in range(1, len(p) + 1):
        column = offset + i
        inside = (column >= 1) & (column <= len(r))
        same = np.zeros(width, np.int64)
        same[inside] = r[column[inside] - 1] != p[i - 1]
        step = np.where(inside, row + same, far)
        step = np.minimum(step, np.append(row[1:], far) + 1)
        step = np.where((column >= 0) & (column <= len(r)), step, far)
        step = np.minimum.accumulate(step - ramp) + ramp
        row = np.where((column >= 0) & (column <= len(r)), step, far)
    best = int(row.argmin())
    return int(offset[best]) + len(p), int(row[best])


def _match_rows(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in index.value.matches(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], _SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])


def blocks(benchmark: DataFrame, limit: int = BROADCAST) -> Iterator[Index]:
    """Indexes over the benchmark in order of item_id, each of at most ``limit`` bytes of items (or one item)."""
    held: list[tuple[int, str | None]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null")
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        if held and size + len(text) > limit:
            yield Index(held)
            held, size = [], 0
        held.append((item, text))
        size += len(text)
    if held:
        yield Index(held)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each passage found: doc_id, item_id, start and end in the normalised text, edits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    context, out = docs.sparkSession.sparkContext, None
    for index in blocks(benchmark):
        found = rows.mapInArrow(_match_rows(context.broadcast(index)), "doc_id long, item_id long, start long, end long, edits long")
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, end long, edits long")


def _clean_rows(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([not index.value.matches(t) for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no passage of the benchmark is found."""
    for index in blocks(benchmark):
        docs = docs.mapInArrow(_clean_rows(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs
