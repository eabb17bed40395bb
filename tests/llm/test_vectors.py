"""Whitening and clustering of vectors against plain versions, and their defined cases."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("driftline.llm")

from compare import connect, difference  # noqa: E402

from driftline.llm import centroids, queries, vectors, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int, x string, near int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", 7, 7) for i, v in rows], KIND)


def plain_clusters(rows, k, rounds, dims):
    pts = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [p for _, p in sorted(pts, key=lambda t: (hashlib.sha256(f"1:{'' if t[0] is None else t[0]}".encode()).hexdigest(), t[1]))[:k]]
    gap = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c, strict=True))
    for r in range(rounds + 1):
        near = [min((gap(p, c), j) for j, c in enumerate(centres)) for _, p in pts]
        if r < rounds:
            for j in range(len(centres)):
                own = [p for (_, p), (_, c) in zip(pts, near, strict=True) if c == j]
                if own:
                    centres[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    inertia = [sum(d for d, c in near if c == j) for j in range(len(centres))]
    return sorted((i or -1, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(pts, near, strict=True))


def found_clusters(df, **more):
    return sorted((r["vec_id"] or -1, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in centroids.cluster(df, **more).collect())


def f32(x):
    return float(np.float32(x))


def odd_rows(dims, n, seed):
    rng = random.Random(seed)
    rows = [(i, [f32(rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 0.3)])) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 2)]  # one very common vector
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * (dims - 1)), (2003, [float("nan")] * dims), (2004, [float("inf")] + [0.0] * (dims - 1)), (2005, [None] + [0.0] * (dims - 1))]
    return rows


@pytest.mark.parametrize(("dims", "k", "rounds"), [(4, 5, 3), (2, 16, 3), (3, 7, 11)])
def test_clusters(spark, dims, k, rounds):
    rows = odd_rows(dims, 60, dims)
    assert found_clusters(frame(spark, rows).repartition(3), k=k, rounds=rounds, dimensions=dims) == plain_clusters(rows, k, rounds, dims)


def test_clusters_with_ties_and_few_vectors(spark):
    rows = [(i, [f32(x), 0.0]) for i, x in enumerate([0, 1, 2, 3, 1.5, 0.5, 2.5, 1.5])]
    for k in (2, 3, 20):
        assert found_clusters(frame(spark, rows), k=k, dimensions=2) == plain_clusters(rows, k, 3, 2)
    assert centroids.cluster(frame(spark, rows).limit(0)).count() == 0
    assert centroids.cluster(frame(spark, rows)).count() == 0  # none has 64 entries


def test_clusters_of_huge_entries(spark):
    rows = [(i, [f32(x), f32(-x)]) for i, x in enumerate([1e9, 2e9, -3e9, 5.0, 2e9])]
    assert found_clusters(frame(spark, rows), k=2, dimensions=2)[0][:2] == plain_clusters(rows, 2, 3, 2)[0][:2]


def test_scan_stops_no_sooner_than_twice_the_distance():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-9, 9, (500, 3)), rng.integers(-9, 9, (12, 3))
    plain = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for before in range(12):
        cluster, distance = centroids.Sorted(c.tolist()).assign(x, np.full(500, before))
        assert (cluster == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


def test_clusters_as_sql(spark):
    assert difference(queries.op13_centroids(spark, SF), connect(SF), queries.ORACLE["op13_centroids"]) is None


def exact(rows):
    """(x, sums, covariance) as whole numbers and fractions."""
    x = [[math.floor(1024 * v) + 100_000 for v in row] for row in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]
    return x, s, cov


@pytest.mark.parametrize(("dims", "block"), [(7, 3), (5, 8), (12, 4), (1, 32)])
def test_whitening(spark, dims, block):
    rng = random.Random(dims)
    rows = [(i, [f32(rng.gauss(j, 1 + j)) for j in range(dims)]) for i in range(150)]
    rows += [(900 + i, rows[0][1]) for i in range(60)]
    odd = [(2000, None), (2001, []), (2003, [float("nan")] * dims), (2004, [float("inf")] * dims), (2005, [None] * dims), (2006, [1.0] * (dims + 1))]
    out = whitening.whiten(frame(spark, rows + odd).repartition(5), block=block).collect()
    x, s, cov = exact([v for _, v in rows])
    n, k = len(rows), min(8, dims)
    assert len(out) == n * k and {r["n"] for r in out} == {n}
    values, axes = np.linalg.eigh(np.array([[float(v) for v in r] for r in cov]))
    values, axes = values[::-1], axes[:, ::-1]
    by_id = {i: [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)), row] for (i, _), row in zip(rows, x, strict=True)}
    signs = {}
    for r in out:
        deviation, row = by_id[r["vec_id"]]
        c = r["component"] - 1
        plain = sum(float(Fraction(n * a - b, n)) * u for a, b, u in zip(row, s, axes[:, c], strict=True)) / math.sqrt(values[c])
        signs.setdefault(c, 1 if abs(r["whitened"] - plain) < abs(r["whitened"] + plain) else -1)
        assert r["deviation"] == deviation
        assert math.isclose(r["whitened"], signs[c] * plain, rel_tol=1e-7, abs_tol=1e-7)
        assert math.isclose(r["explained"], values[c] / float(sum(cov[i][i] for i in range(dims))), rel_tol=1e-9)
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-9


def test_whitening_sums_exactly(spark):
    rows = [(i, [f32(1e6 + i), f32((-1) ** i * 3e12), f32(i % 3)]) for i in range(40)]
    points = frame(spark, rows).select("vec_id", vectors.scaled(F.col("embedding"), 1024, 100_000).alias("x"))
    x, s, cov = exact([v for _, v in rows])
    got = whitening.covariance(points, 3, s, len(x), 2)
    assert np.allclose(got, [[float(v) for v in r] for r in cov], rtol=1e-14, atol=0)


def test_whitening_without_variance(spark):
    assert whitening.whiten(frame(spark, []), 8).count() == 0
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, 0.0), (2, 0, None, None, 0.0)]
    flat = whitening.whiten(frame(spark, [(i, [float(i), 5.0]) for i in range(4)])).collect()
    assert sorted({r["component"] for r in flat if r["whitened"] is None}) == [2]


def test_whole_table(spark):
    out = queries.op12_whitening(spark, SF)
    rows = out.collect()
    assert len(rows) == 8 * 500 and rows[0]["identity_error"] < 1e-9
    own = np.array([r["whitened"] for r in sorted(rows, key=lambda r: (r["vec_id"], r["component"]))]).reshape(500, 8)
    assert np.abs(own.T @ own / 500 - np.eye(8)).max() < 1e-9
