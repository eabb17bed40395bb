"""Thinning by batches, sites by lists and neighbours by cells, against plain versions; none deals a call or a pair for each row."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from driftline.functions import kernels
from driftline.operators import joins, paths, sequences

FIX = "hex long, seq long, t_ms long, lat double, lon double, alt double"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_thinning_passes_many_flights_at_a_time(spark):
    rng = random.Random(3)
    rows, seq = [], 0
    for h in range(7):
        t, lat, lon = 0, 40.0, -105.0
        for size in [1, 2, 3, 50, 1, 400, 2] * 3:
            t += 100
            for _ in range(size):
                t, lat, lon, seq = t + rng.randrange(60), lat + rng.gauss(0, 0.003), lon + rng.gauss(0, 0.003), seq + 1
                rows.append((h, seq, t, lat, lon, 0.0))
    df = spark.createDataFrame(rows, FIX).repartition(3)
    want, flights = set(), sequences.sessions(df, 60.0).collect()
    for key in {(r["hex"], r["flight"]) for r in flights}:
        own = sorted((r["t_ms"], r["seq"], r["lat"], r["lon"]) for r in flights if (r["hex"], r["flight"]) == key)
        keep = kernels.douglas_peucker(*(np.array([r[i] for r in own]) for i in (2, 3)), 0.004)
        want |= {(key[0], *r[1:]) for r, k in zip(own, keep, strict=True) if k}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # flights go on over batches
    try:
        thinned = paths.thin(df, 0.004)
        found = [tuple(r) for r in thinned.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(want) < len(rows) and set(found) == want
    assert "FlatMapGroupsInPandas" not in plan(thinned)
    assert paths.thin(df.limit(0), 0.004).count() == 0


def miles(a, b):
    return math.hypot((b[0] - a[0]) * 60, (b[1] - a[1]) * 60 * math.cos(math.radians((a[0] + b[0]) / 2)))


def test_the_nearest_site_without_a_pair_for_each_site(spark):
    rng = random.Random(8)
    sites = [(i, 40 + rng.random(), -105 + rng.random(), 0.0) for i in range(60)]
    rows = [(1, i, i, 40 + rng.random(), -105 + rng.random(), 0.0) for i in range(300)] + [(1, 300, 300, None, None, 0.0), (1, 301, 301, 80.0, 10.0, 0.0)]
    near = joins.nearest_site(spark.createDataFrame(rows, FIX), spark.createDataFrame(sites, "code int, lat double, lon double, elev double"), 5.0)
    found = {r["seq"]: (r["site"], r["site_nm"]) for r in near.collect()}
    assert len(found) == len(rows)
    for r in rows:
        best = min((miles(r[3:5], s[1:3]), s[0]) for s in sites) if r[3] is not None else (9.0, None)
        assert found[r[1]][0] == (best[1] if best[0] <= 5 else None)
    assert "SortAggregate" not in plan(near) and "Join LeftOuter, (seq" not in plan(near)


def test_neighbours_far_north_and_without_sorting_pairs(spark):
    rng = random.Random(9)
    new = lambda h, i: (h, i, rng.randrange(4000), 69 + rng.random() * 0.1, 10 + rng.random() * 0.3, rng.random() * 2000)
    left, right = [new(0, i) for i in range(400)], [new(1, 1000 + i) for i in range(400)]
    got = joins.neighbours(spark.createDataFrame(left, FIX), spark.createDataFrame(right, FIX), 0.6, 500.0, 900.0)
    want = {}
    for a in left:
        near = [(miles(a[3:5], b[3:5]), b[1]) for b in right if abs(a[2] - b[2]) <= 900 and abs(a[5] - b[5]) <= 500]
        best = min(near, default=(1.0, None))
        if best[0] <= 0.6:
            want[a[1]] = best[1]
    assert {r["seq"]: r["other"] for r in got.collect()} == want and len(want) > 20
    assert "SortAggregate" not in plan(got)  # pairs were sorted by seq, so they spilt


def test_of_equal_distances_the_lesser_seq(spark):
    at = lambda h, i, lon: (h, i, 0, 40.0, lon, 0.0)
    right = spark.createDataFrame([at(1, 9, -105.001), at(1, 8, -104.999)], FIX)  # as far, but for rounding
    got = joins.neighbours(spark.createDataFrame([at(0, 1, -105.0)], FIX), right.orderBy(F.desc("seq")), 0.6, 500.0, 900.0)
    assert [r["other"] for r in got.collect()] == [8]
