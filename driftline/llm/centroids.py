"""Centroid clustering by sort-means, in integers.

Every round orders, for each centroid, the others by their distance from it. A vector is compared with the
centroid that it had and then with the others in that order, until one is strictly farther from the old
centroid than twice the vector is: by the triangle inequality neither it nor any after it can be nearer, or
as near. Squared distances are whole numbers (beyond twice is beyond four times of the squares), so ties are exact and go to the smaller number.

A round is one pass over the vectors. The centroids of all rounds so far go along (``k`` vectors a round), and
a task follows each vector through them, so nothing is written between rounds; after ``KEEP`` rounds the
assignments are written once. Tasks sum the vectors by cluster in whole numbers and give out k times (dimensions + 2)
sums each, which Spark adds up; a cluster that a third of all vectors belong to is no group anywhere.

Vectors that are null, of another length, or with null or non-finite entries are left out. Rows of one id are
vectors of their own, null ids too (as starting centroids they count as an empty id; ties go to the smaller
vector). With fewer vectors than ``k`` there are fewer centroids. Entries saturate at 2**61, distances at the
largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh
from .vectors import LONG, TOTALS, Totals, collected, finite, greatest, matrix, roomy, scaled

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
KEEP = 8
_ROWS = 4096


def _squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = x - centre
    return (gap * gap).sum(axis=1)


class Sorted:
    """Centroids, and for each the others by distance."""

    def __init__(self, centres: list[list[int]]):
        self.centres = np.array(centres, dtype=object)
        gaps = self.centres[:, None, :] - self.centres[None, :, :]
        self.apart = (gaps * gaps).sum(axis=2)
        self.order = [sorted((j for j in range(len(centres)) if j != a), key=lambda j, a=a: (self.apart[a][j], j)) for a in range(len(centres))]
        self.widest = max((abs(int(v)) for v in self.centres.ravel()), default=0)

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row of x that had ``before``."""
        most = 4 * x.shape[1] * (greatest(x) + self.widest) ** 2
        x, apart = roomy(x, most), self.apart if most > LONG else self.apart.astype(np.int64)
        centres = self.centres if most > LONG else self.centres.astype(np.int64)
        cluster, distance = before.copy(), np.zeros(len(x), x.dtype)
        for a in np.unique(before).tolist():
            at = np.flatnonzero(before == a)
            distance[at] = _squares(x[at], centres[a])
            limit = 4 * distance[at]
            for j in self.order[a]:
                near = apart[a][j] <= limit
                at, limit = at[near], limit[near]
                if not len(at):
                    break
                other = _squares(x[at], centres[j])
                better = (other < distance[at]) | ((other == distance[at]) & (j < cluster[at]))
                cluster[at[better]], distance[at[better]] = j, other[better]
        return cluster, distance


def _followed(batches: Iterator[pa.RecordBatch], rounds: list[Sorted], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of few rows, their vectors, and clusters and distances after all rounds."""
    for whole in batches:
        for begin in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(begin, _ROWS)
            x, cluster = matrix(batch.column("x"), width), batch.column("near").to_numpy().astype(np.int64)
            distance = np.zeros(len(x), np.int64)
            for centres in rounds:
                cluster, distance = centres.assign(x, cluster)
            yield batch, x, cluster, distance


def _sums(rounds: list[list[list[int]]], width: int):
    """Per cluster: the sums of its vectors, their number, and their distances summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, through = Totals(), [Sorted(c) for c in rounds]
        for _, x, cluster, distance in _followed(batches, through, width):
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                held = roomy(own, len(own) * greatest(own)).sum(axis=0).astype(object)
                totals.add(c, np.append(held, [len(own), sum(distance[cluster == c].tolist())]))
        yield from totals.batches()

    return run


def _near(rounds: list[list[list[int]]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, _ in _followed(batches, [Sorted(c) for c in rounds], width):
            yield batch.set_column(batch.schema.get_field_index("near"), "near", pa.array(cluster, pa.int32()))

    return run


def _result(rounds: list[list[list[int]]], width: int, inertia: list[int], total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shas = pa.array([centroid_sha256(c) for c in rounds[-1]])
        sums = pa.array([min(v, LONG) for v in inertia], pa.int64())
        for batch, x, cluster, distance in _followed(batches, [Sorted(c) for c in rounds], width):
            at = pa.array(cluster)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array(cluster, pa.int32()),
                    pa.array([min(v, LONG) for v in distance.tolist()], pa.int64()),
                    sums.take(at),
                    pa.array(np.full(len(x), min(total, LONG)), pa.int64()),
                    shas.take(at),
                ],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return run


def centroid_sha256(centre: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()


def starts(points: DataFrame, k: int) -> list[list[int]]:
    """The vectors of the k smallest hashes of ``1:<vec_id>``."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["x"]) for r in points.select("x", order.alias("order")).orderBy("order", "x").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Per vector of ``vectors`` (vec_id, embedding): cluster, squared distance, inertia of its cluster and of all, and
    the sha256 of its centroid."""
    kept = vectors.filter((F.size("embedding") == dimensions) & finite(F.col("embedding")))
    x = fresh(vectors, "x")
    points = kept.withColumn(x, scaled(F.col("embedding"), scale)).select("vec_id", F.col(x).alias("x"), F.lit(0).alias("near"))
    schema = points.schema
    through = [starts(points, k)]
    if not through[0]:
        return points.select("vec_id", F.col("near").alias("cluster"), *(F.lit(0).cast("long").alias(n) for n in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    for done in range(rounds):
        sums = collected(points.mapInArrow(_sums(through, dimensions), TOTALS))
        after = [[sums[c][i] // sums[c][dimensions] for i in range(dimensions)] if c in sums else centre for c, centre in enumerate(through[-1])]
        if len(through) == KEEP and done + 1 < rounds:
            points, through = cut(points.mapInArrow(_near(through, dimensions), schema)), []
        through.append(after)
    sums = collected(points.mapInArrow(_sums(through, dimensions), TOTALS))
    inertia = [sums.get(c, {}).get(dimensions + 1, 0) for c in range(len(through[-1]))]
    kind = dict(vectors.dtypes)["vec_id"]
    out = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return points.mapInArrow(_result(through, dimensions, inertia, sum(inertia)), out)


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    """The same in SQL: every vector against every centroid."""
    kept = f"""p AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
FROM embeddings WHERE len(embedding) = {dimensions} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x FROM p QUALIFY c < {k})"""
    parts = [kept]
    for i in range(rounds + 1):
        gap = f"list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (p.x[i] - c{i}.x[i]) * (p.x[i] - c{i}.x[i])))"
        parts.append(f"""a{i} AS (SELECT r, vec_id, x, d[2] AS c, d[1] AS distance FROM (SELECT r, vec_id, p.x, min([CAST({gap} AS BIGINT), c]) AS d FROM p, c{i} GROUP BY ALL))""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT c, j, CAST(floor_sum AS BIGINT) AS v FROM (SELECT c, j, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
FROM (SELECT c, unnest(x) AS v, unnest(range(1, {dimensions + 1})) AS j FROM a{i}) GROUP BY c, j)),
c{i + 1} AS (SELECT c, coalesce(n.x, c{i}.x) AS x FROM c{i} LEFT JOIN (SELECT c, list(v ORDER BY j) AS x FROM m{i} GROUP BY c) n USING (c))""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""
