"""SimHash near-duplicates, linked by a self-join of binary tries.

A fingerprint has a bit set if it is set in over half of the XXH64 hashes of the text's word shingles.
Two fingerprints that differ in at most ``budget`` bits agree on one of ``budget + 1`` blocks of bits;
for each block Spark groups the distinct fingerprints by its value, and each group is a binary trie
over all 64 bits, rotated so that the block comes first. The trie is joined with itself level by
level: pairs of nodes are traversed together, their differing bits accumulate, and a pair goes as soon
as it exceeds the budget. Where all bits that remain fit into what is left of the budget, everything
below links without being visited.

A group with more than ``crowd`` fingerprints is split first: its nodes eight levels further down
become cells, one for each pair of nodes within the budget, and each cell is a task's work of its own
(repeatedly, as long as bits remain). A cell returns a spanning forest of its links, not all pairs, so
its output is at most as long as its input; components() merges the forests.

Equal texts, and all rows with equal fingerprints, are one node. Null and empty texts have fingerprint
zero, which links like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected
from .textkit import ranges, slices

SHINGLE = 3
BUDGET = 3
CROWD = 20_000
_LEVEL = 8


def _fingerprint(text: str | None, size: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(size, n)
    spans = zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n - k + 1)
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n - k + 1).tobytes(), "big")


def _fingerprint_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([_fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64)
            keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(prints.view(np.int64))], names=[*(batch.schema.names[i] for i in keep), "print"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and its 64-bit fingerprint as a signed long (``print``)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprint_rows(size), "doc_id long, print long")


class _Forest:
    """Union by least index, over numpy arrays of links at once."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            x = self.parent[up]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.parent, high, low)
            a, b = low, high


def trie_forest(prints: np.ndarray, budget: int, depth: int, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """Least index that each print reaches over links of at most ``budget`` differing bits.

    prints[begin[i]:end[i]] is cell i, sorted, and its prints share their first ``depth`` bits; or, where
    middle[i] < end[i], those before and from the middle do, and links between the two parts are sought.
    The frontier holds pairs of nodes (ranges) of one level with the bits in which they differ so far.
    It is worked off depth-first in chunks, so that memory stays bounded.
    """
    forest = _Forest(len(prints))
    cross = middle < end
    bits = np.where(cross, np.bitwise_count((prints[begin] ^ prints[np.where(cross, middle, begin)]) >> np.uint64(64 - depth)) if depth else 0, 0)
    stack = [(depth, begin, middle, np.where(cross, middle, begin), end, bits)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, *frontier = stack.pop()
        if len(frontier[0]) > chunk:
            half = len(frontier[0]) // 2
            stack += [(depth, *(x[part] for x in frontier)) for part in (slice(half), slice(half, None))]
            continue
        a0, a1, b0, b1, bits = frontier
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        near = leaf & (np.bitwise_count(prints[a0] ^ prints[b0]) <= budget) if len(a0) else leaf
        forest.link(a0[near], b0[near])
        full = ~leaf & (bits + 64 - depth <= budget)  # whatever the rest holds, the budget lasts
        for lo, hi in ((a0[full], a1[full]), (b0[full], b1[full])):
            forest.link(ranges(lo, hi - lo), np.repeat(a0[full], hi - lo))
        open_ = ~(leaf | full)
        if depth == 64 or not open_.any():
            continue
        a0, a1, b0, b1, bits = (x[open_] for x in (a0, a1, b0, b1, bits))
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((prints >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64)
        up = ones[depth]
        am, bm = a1 - (up[a1] - up[a0]), b1 - (up[b1] - up[b0])
        itself = (a0 == b0) & (a1 == b1)
        children = []
        for c0, c1, d0, d1, more, once in ((a0, am, b0, bm, 0, False), (am, a1, bm, b1, 0, False), (a0, am, bm, b1, 1, False), (am, a1, b0, bm, 1, True)):
            live = (c1 > c0) & (d1 > d0) & (bits + more <= budget)
            live &= ~itself if once else ~(itself & (more == 0) & (c1 - c0 == 1))
            children.append([x[live] for x in (c0, c1, d0, d1, bits + more)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*children, strict=True))))
    return forest.roots(np.arange(len(prints)))


def _cell_rows(budget: int, depth: int):
    """Forest edges of complete cells, from rows (cell, side, print, turn) sorted by cell, side and turned print."""

    def work(cell: np.ndarray, side: np.ndarray, raw: np.ndarray, turned: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        last = np.append(first[1:], len(cell))
        second = np.concatenate([[0], np.cumsum(side == 1)])
        n = second[last] - second[first]
        middle = last - n
        lone = (side[first] >= 0) & ((n == 0) | (middle == first))  # half of a pair, without its other half
        at = [x[(last - first > 1) & ~lone] for x in (first, middle, last)]
        roots = trie_forest(turned, budget, depth, *at) if len(at[0]) else np.arange(len(raw))
        child = np.flatnonzero(roots != np.arange(len(raw)))
        return pa.RecordBatch.from_arrays([pa.array(raw[child].view(np.int64)), pa.array(raw[roots[child]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols[2:] = [x.view(np.uint64) for x in cols[2:]]
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(rest[0]):
                continue
            whole = int(np.searchsorted(np.cumsum(rest[0][::-1] != rest[0][-1]) > 0, True))
            cutoff = len(rest[0]) - whole
            if cutoff:
                yield work(*(x[:cutoff] for x in rest))
                rest = [x[cutoff:] for x in rest]
        if rest is not None and len(rest[0]):
            yield work(*rest)

    return run


def links(prints: DataFrame, budget: int = BUDGET, crowd: int = CROWD, size: int = 64, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links of ``budget`` bits connect.

    A fingerprint is the low ``size`` bits of print; what is above them names its table, and only
    fingerprints of one table are joined. ``keep`` writes the distinct ones.
    """
    width = size // (budget + 1)
    low = f"(print & {(1 << size) - 1})" if size < 64 else "print"
    rotated = F.expr(f"if(turn = 0, shiftleft(print, {64 - size}), shiftleft(print, turn * {width} + {64 - size}) | shiftleft(shiftrightunsigned({low}, {size} - turn * {width}), {64 - size}))")
    turned = lambda df: df.withColumn("turned", rotated)  # noqa: E731  follows from the print, so it needn't be shuffled
    bits = lambda at, n: F.expr(f"cast(shiftrightunsigned(turned, {64 - at - n}) & {(1 << n) - 1} as int)")
    rows = keep(prints.select("print").distinct()).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(budget))))
    table = F.shiftrightunsigned("print", size) if size < 64 else F.lit(0).cast("long")
    cell = (table * (budget + 1) + F.col("turn")) * (1 << width) + bits(0, width)
    cells = turned(rows).select(cell.alias("cell"), F.lit(-1).alias("side"), F.lit(0).alias("used"), "print", "turn")
    near = F.array(*(F.lit(v) for v in range(1 << _LEVEL) if v.bit_count() <= budget))
    edges, depth = None, width
    while True:
        crowded = None
        if depth + _LEVEL <= 64:
            cells = cells if edges is None else cut(cells)  # at first they follow from the distinct fingerprints
            crowded = cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("cell")
            crowded = crowded if crowded.limit(1).count() else None
        now = cells if crowded is None else cells.join(crowded, "cell", "left_anti")
        order = F.col("turned").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned
        dealt = turned(now.select("cell", "side", "print", "turn").repartition("cell")).drop("turn")
        found = dealt.sortWithinPartitions("cell", "side", order).mapInArrow(_cell_rows(budget, depth), "a long, b long")
        edges = found if edges is None else edges.unionAll(found)
        if crowded is None:
            return edges.distinct()
        # pairs of nodes that both exist and leave some budget: (cell, side, node) -> the cells it takes part in
        rows = turned(cells.join(crowded, "cell")).withColumn("node", bits(depth, _LEVEL)).drop("turned")
        nodes = rows.select("cell", "side", "used", "node").distinct()
        alone, other = F.col("side") < 0, F.col("node").bitwiseXOR(F.col("flip"))
        pairs = nodes.withColumn("flip", F.explode(near)).withColumn("spent", F.col("used") + F.bit_count("flip")).filter(F.col("spent") <= budget)
        pairs = pairs.withColumn("other", other).withColumn("across", F.when(alone, -1).otherwise(1 - F.col("side")))
        there = nodes.select("cell", F.col("side").alias("across"), F.col("node").alias("other"))
        pairs = pairs.join(there, ["cell", "across", "other"], "left_semi")
        lower = F.when(alone, F.least("node", "other")).when(F.col("side") == 0, F.col("node")).otherwise(F.col("other"))
        upper = F.when(alone, F.greatest("node", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("node"))
        side = F.when(~alone, F.col("side")).when(F.col("flip") == 0, -1).when(F.col("node") < F.col("other"), 0).otherwise(1)
        pairs = pairs.select("cell", "side", "node", F.xxhash64("cell", lower, upper).alias("to_cell"), side.alias("to_side"), "spent")
        split = rows.drop("used").join(pairs, ["cell", "side", "node"])
        cells = split.select(F.col("to_cell").alias("cell"), F.col("to_side").alias("side"), F.col("spent").alias("used"), "print", "turn")
        depth += _LEVEL


def near_duplicates(docs: DataFrame, size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable over links."""
    prints = cut(fingerprints(docs, size))
    roots = connected(links(prints, budget))
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    tagged = firsts.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    lowest = tagged.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = tagged.join(lowest, "root").select("print", "component_id")
    return prints.join(owner, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
