"""Vectors of integers in Arrow batches, with exact sums whatever their number and size."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries saturate here, so that differences stay within 64 bits.
LARGEST = 1 << 61
LONG = (1 << 63) - 1
_EXACT = 1 << 52


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def scaled(vector: Column, factor: int, shift: int = 0) -> Column:
    """floor(factor * x) + shift of every entry x, as longs."""

    def one(x: Column) -> Column:
        return F.least(F.greatest(F.floor(x.cast("double") * factor), F.lit(-LARGEST)), F.lit(LARGEST)) + F.lit(shift)

    return F.transform(vector, one)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` longs each, as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def roomy(x: np.ndarray, most: int) -> np.ndarray:
    """x, as Python's integers if ``most`` (what will be computed at its greatest) passes 64 bits."""
    return x if most <= LONG else x.astype(object)


def greatest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left' right, exact."""
    most = len(left) * greatest(left) * greatest(right)
    if most < _EXACT:
        return (left.T.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
    return roomy(left, most).T @ roomy(right, most)


class Totals:
    """Sums of integers by (group, cell), kept for one task and given out once."""

    def __init__(self) -> None:
        self.of: dict[int, np.ndarray] = {}

    def add(self, group: int, values: np.ndarray) -> None:
        values = values.astype(object)
        self.of[group] = self.of[group] + values if group in self.of else values

    def batches(self) -> Iterator[pa.RecordBatch]:
        for group, values in self.of.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * len(values), pa.int64()), pa.array(range(len(values)), pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))],
                names=["group", "cell", "total"],
            )


TOTALS = "group long, cell int, total decimal(38,0)"


def collected(totals: DataFrame) -> dict[int, dict[int, int]]:
    """{group: {cell: sum}}: as many values as groups have cells, whatever the rows."""
    out: dict[int, dict[int, int]] = {}
    for r in totals.groupBy("group", "cell").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect():
        out.setdefault(r["group"], {})[r["cell"]] = int(r["total"])
    return out
