"""Embedding whitening by a tiled covariance matrix.

1. One pass sums every dimension in whole numbers: S and n. Entries are centred by the whole part of S/n, so what is multiplied
   is small; the fraction that is left is put right at the end, exactly.
2. Tiles: pairs (i, j) of blocks of ``BLOCK`` dimensions, i <= j. Batches of rows (row blocks) are cut into
   column blocks, and each column block goes to every tile that needs it. A tile is dealt over several
   slots by row block, so that there are at least as many (tile, slot) keys as shuffle partitions; the two
   column blocks of a row block meet in one slot, are multiplied there and added up, one sum for each tile and slot.
3. Sums of tiles are added and assembled on the driver, which holds the matrix (dimensions squared, whatever the rows),
   turns it into the covariance of all rows (one rounding an entry) and decomposes it.
4. Two more passes: the covariance of the whitened rows against the identity, and the rows themselves.

Products and sums are whole numbers: floating-point where they fit 52 bits, 64 bits or Python's integers else.

Rows without vector, or with null or non-finite entries, are left out; so are those of another length than most
rows have (ties: the longer). Rows of one id are rows of their own. With fewer than ``components`` dimensions there are fewer components. A component
without variance (fewer rows than dimensions, constant dimensions) has null ``whitened`` and no part in
``identity_error``; ``explained`` is null if there is no variance at all. Entries saturate at 2**61, deviations at the largest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import LONG, TOTALS, Totals, collected, finite, greatest, matrix, product, roomy, scaled

COMPONENTS = 8
BLOCK = 32
SCALE = 1024
SHIFT = 100_000
_ROWS = 4096
_TILED = "tile int, slot int, block long, side int, rows int, part binary"


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for begin in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(begin, _ROWS)
            yield batch, matrix(batch.column("x"), width)


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals()
        for _, x in _batches(batches, width):
            totals.add(0, np.append(roomy(x, len(x) * greatest(x)).sum(axis=0).astype(object), [len(x)]))
        yield from totals.batches()

    return run


def _tiled(width: int, centre: list[int], size: int, slots: int):
    """Column blocks of centred rows, for every tile that needs them."""
    edges = [(a, min(a + size, width)) for a in range(0, width, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, task = np.array(centre, np.int64), TaskContext.get().partitionId()
        for number, (_, x) in enumerate(_batches(batches, width)):
            x, block, rows = x - middle, (task << 32) + number, []
            parts = [np.ascontiguousarray(x[:, a:b]) for a, b in edges]
            raw = [p.astype("<i4" if greatest(p) < 1 << 31 else "<i8").tobytes() for p in parts]
            slot = (task * 7919 + number) % slots
            for i in range(len(edges)):
                for j in range(i, len(edges)):
                    rows.append((i * len(edges) + j, slot, block, 0, len(x), raw[i]))
                    if i != j:
                        rows.append((i * len(edges) + j, slot, block, 1, len(x), raw[j]))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            for begin in range(0, len(rows), 64):
                cells = zip(*rows[begin : begin + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["tile", "slot", "block", "side", "rows", "part"])

    return run


def _multiplied(width: int, size: int):
    """Sums of products of the column blocks that meet; rows come by tile, slot, block and side."""
    edges = [(a, min(a + size, width)) for a in range(0, width, size)]

    def block(raw: bytes, wide: int, rows: int) -> np.ndarray:
        return np.frombuffer(raw, f"<i{len(raw) // (wide * rows)}").reshape(rows, wide).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, now, left = Totals(), None, None
        for batch in batches:
            for tile, number, side, rows, raw in zip(*(batch.column(n).to_pylist() for n in ("tile", "block", "side", "rows", "part")), strict=True):
                if tile != now:
                    yield from totals.batches()
                    totals, now = Totals(), tile
                i, j = divmod(tile, len(edges))
                own = block(raw, edges[j if side else i][1] - edges[j if side else i][0], rows)
                if i == j:
                    totals.add(tile, product(own, own).ravel())
                elif side == 0:
                    left = number, own
                elif left is None or left[0] != number:
                    raise ValueError("a column block has no partner")
                else:
                    totals.add(tile, product(left[1], own).ravel())
        yield from totals.batches()

    return run


def covariance(points: DataFrame, width: int, sums: list[int], n: int, size: int = BLOCK) -> np.ndarray:
    """The covariance matrix of ``x`` (divisor n), each entry rounded once."""
    centre = [s // n for s in sums]
    blocks = -(-width // size)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, -(-2 * parts // (blocks * (blocks + 1) // 2)))
    tiles = points.select("x").mapInArrow(_tiled(width, centre, size, slots), _TILED)
    met = tiles.repartition(parts, "tile", "slot").sortWithinPartitions("tile", "slot", "block", "side")
    found = collected(met.mapInArrow(_multiplied(width, size), TOTALS))
    out = np.zeros((width, width))
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    for tile, cells in found.items():
        i, j = divmod(tile, blocks)
        wide = min((j + 1) * size, width) - j * size
        for cell, total in cells.items():
            a, b = i * size + cell // wide, j * size + cell % wide
            out[a, b] = out[b, a] = (n * total - rest[a] * rest[b]) / (n * n)
    return out


def _projected(x: np.ndarray, sums: np.ndarray, n: int, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S, the components of x - S/n)."""
    apart = roomy(x, n * greatest(x) + greatest(sums)) * n - sums
    return apart, (apart / n).astype(np.float64) @ axes


def _checked(width: int, sums: list[int], n: int, axes: np.ndarray):
    """Sums of the whitened components and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, s = axes.shape[1], np.array(sums, object)
        s = s if greatest(s) > LONG else s.astype(np.int64)
        total = np.zeros((k + 1, k))
        for _, x in _batches(batches, width):
            _, w = _projected(x, s, n, axes)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "total"])

    return run


def _whitened(width: int, sums: list[int], n: int, axes: np.ndarray, have: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, s = axes.shape[1], np.array(sums, object)
        s = s if greatest(s) > LONG else s.astype(np.int64)
        for batch, x in _batches(batches, width):
            apart, w = _projected(x, s, n, axes)
            most = width * greatest(apart) ** 2
            deviation = [min(v, LONG) for v in (roomy(apart, most) ** 2).sum(axis=1).tolist()]
            each = np.repeat(np.arange(len(x)), k)
            component = np.tile(np.arange(1, k + 1), len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(component, pa.int32()),
                    pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel(), mask=component > have),
                ],
                names=["vec_id", "component", "deviation", "whitened"],
            )

    return run


def components(matrix_: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their unit eigenvectors as columns; those without variance are zero."""
    values, axes = np.linalg.eigh(matrix_)
    values, axes = values[::-1][:most].copy(), axes[:, ::-1][:, :most].copy()
    none = values <= np.trace(matrix_) * len(matrix_) * np.finfo(float).eps
    values[none] = 0.0
    return values, axes


def whiten(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, block: int = BLOCK) -> DataFrame:
    """Per vector of ``vectors`` (vec_id, embedding) and component: n, deviation, whitened, explained, identity_error."""
    kept = vectors.filter(finite(F.col("embedding")))
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, deviation long, whitened double"
    common = kept.groupBy(F.size("embedding").alias("size")).count().filter("size > 0").orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        empty = kept.sparkSession.createDataFrame([], schema)
        return empty.select("vec_id", "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    width, n = common["size"], common["count"]
    points = kept.filter(F.size("embedding") == width).select("vec_id", scaled(F.col("embedding"), scale, shift).alias("x"))
    found = collected(points.select("x").mapInArrow(_sums(width), TOTALS))[0]
    sums = [found[i] for i in range(width)]
    matrix_ = covariance(points, width, sums, n, block)
    values, axes = components(matrix_, min(most, width))
    have = int((values > 0).sum())
    axes = np.where(values > 0, axes / np.sqrt(np.where(values > 0, values, 1.0)), 0.0)
    checked = points.select("x").mapInArrow(_checked(width, sums, n, axes), "cell int, total double")
    total = np.zeros((len(values) + 1) * len(values))
    for r in checked.groupBy("cell").agg(F.sum("total").alias("total")).collect():
        total[r["cell"]] = r["total"]
    total = total.reshape(len(values) + 1, len(values)) / n
    own = total[:-1] - np.outer(total[-1], total[-1])
    error = float(np.abs(own - np.eye(len(values)))[:have, :have].max()) if have else 0.0
    trace = float(np.trace(matrix_))
    shares = F.element_at(F.array(*(F.lit(float(v) / trace if trace else None).cast("double") for v in values)), F.col("component"))
    rows = points.mapInArrow(_whitened(width, sums, n, axes, have), schema)
    return rows.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))
