"""Detectors, look-ups and contours against plain versions of what they compute."""

import base64
import hashlib
import hmac
import math
import random

import pytest
from pyspark.sql import functions as F

from driftline.functions import scoring
from driftline.operators import detect, lookup, noise, paths, power, raster
from driftline.plans import rasters

FIX = "hex long, t_ms long, seq long, lat double, lon double, alt double"


def tracks(seed, aircraft=6, n=60, levels=(0, 100, 240, 260, 500, 790, 810, 1500)):
    rng = random.Random(seed)
    rows = []
    for h in range(aircraft):
        t, lat, lon = rng.randrange(9999), 40.0, -105.0
        for i in range(n):
            t += rng.choice([1, 10, 40, 100])
            lat, lon = lat + rng.choice([-0.01, 0, 0.013]), lon + rng.choice([-0.012, 0, 0.01])
            rows.append((h, t, i, lat, lon, 5000.0 + rng.choice(levels) + rng.choice([0, 0, 5])))
    return rows


def by_hex(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_low_passes(spark, seed):
    rows = tracks(seed)
    want = []
    for h, pts in by_hex(rows).items():
        low_from = None
        for i, p in enumerate(pts):
            agl = p[5] - 5000
            if agl < 250 and low_from is None:
                low_from = i
            elif agl > 800 and low_from is not None:
                bottom = min(range(low_from, i), key=lambda j: (pts[j][5], j))
                rise = next((j for j in range(bottom, min(i + 5, len(pts) - 3)) if pts[j + 1][5] > pts[j][5] and pts[j + 2][5] > pts[j + 1][5]), None)
                want.append((h, low_from, bottom, i, rise, None if rise is None else pts[rise][1] - pts[bottom][1]))
                low_from = None
    found = detect.low_passes(spark.createDataFrame(rows, FIX), F.lit(5000.0)).collect()
    assert sorted((r["hex"], r["start_idx"], r["bottom_idx"], r["end_idx"], r["ascent_idx"], r["gap_s"]) for r in found) == sorted(want)
    assert any(w[4] is None for w in want) and any(w[4] is not None for w in want)


@pytest.mark.parametrize("seed", [4, 5])
def test_track_phases(spark, seed):
    rows = tracks(seed) + [(99, 1, 1, 0.0, 0.0, 5000.0)]
    found = {r["hex"]: (r["descents"], r["ascents"], r["phase"]) for r in detect.track_phases(spark.createDataFrame(rows, FIX), F.lit(5000.0)).collect()}
    for h, pts in by_hex(rows).items():
        if len(pts) < 5:
            assert h not in found
            continue
        agl = [p[5] - 5000 for p in pts]
        down = up = 0
        high = low = False
        for a in agl:
            if a > 800:
                up, low, high = up + low, False, True
            elif a < 250:
                down, high, low = down + high, False, True
        first, last = agl[0] < 250, agl[-1] < 250
        phase = "departure" if first and not last else "arrival" if last and not first else "overflight" if not first else "pattern"
        assert found[h] == (down, up, phase)


def test_exact_ranks_of_a_key_that_holds_nearly_all(spark):
    rng = random.Random(6)
    rows = [("hot", rng.choice([round(rng.random() * 50, 2), 7.0])) for _ in range(3000)] + [("few", 3.0), ("few", -1.5), ("none", None)]
    shares = {"p10": 0.1, "p50": 0.5, "p100": 1.0}
    found = {r["k"]: (r["p10"], r["p50"], r["p100"]) for r in lookup.nearest_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect()}
    for k in ("hot", "few"):
        v = sorted(x for key, x in rows if key == k)
        assert found[k] == tuple(v[min(math.floor(len(v) * p), len(v) - 1)] for p in shares.values())
    assert "none" not in found


def test_positions_at_distances(spark):
    rows = [(1, 0, 0, 40.0, -105.0, 0.0), (1, 1, 1, 40.1, -105.0, 100.0), (1, 2, 2, 40.1, -105.0, 900.0), (1, 3, 3, 40.1, -104.9, 200.0), (2, 0, 0, 1.0, 2.0, 3.0)]
    leg = 0.1 * 364560.0
    east = 0.1 * 364560.0 * math.cos(math.radians(40.1))
    marks = [(1, x) for x in (-5.0, 0.0, leg / 4, leg + 1e-6, leg + east / 2, leg + east, 9e9)] + [(2, 0.0), (2, 50.0), (3, 1.0)]
    found = {(r["hex"], r["ft"]): (round(r["lat"], 6), round(r["lon"], 6), round(r["alt"], 6), round(r["heading"], 3)) for r in lookup.positions_at(spark.createDataFrame(rows, FIX), spark.createDataFrame(marks, "hex long, ft double")).collect()}
    assert found == {
        (1, -5.0): (40.0, -105.0, 0.0, 0.0),
        (1, 0.0): (40.0, -105.0, 0.0, 0.0),
        (1, leg / 4): (40.025, -105.0, 25.0, 0.0),
        (1, leg + 1e-6): (40.1, -105.0, 100.0, 90.0),
        (1, leg + east / 2): (40.1, -104.95, 150.0, 90.0),
        (1, leg + east): (40.1, -104.9, 200.0, 90.0),
        (1, 9e9): (40.1, -104.9, 200.0, 90.0),
        (2, 0.0): (1.0, 2.0, 3.0, 0.0),
        (2, 50.0): (1.0, 2.0, 3.0, 0.0),
    }


def test_contours_close_across_strips_and_levels(spark):
    """Every segment is used once, neighbours are joined, and loops are closed, whatever strips they cross."""
    rng = random.Random(7)
    grid = [(r, c, float(rng.choice([0, 0, 3, 5]) + 3 * math.exp(-((r - 12) ** 2 + (c - 10) ** 2) / 60))) for r in range(26) for c in range(22)]
    grid = [(r, c, 0.0 if r in (0, 25) or c in (0, 21) else v) for r, c, v in grid]
    df = spark.createDataFrame(grid, "row int, col int, value double")
    ends = rasters.contour_ends(df, (1.5, 4.0))
    want = {}
    for r in ends.collect():
        want.setdefault(r["level"], []).append(tuple(sorted((r["a"], r["b"]))))
    loops = {}
    for r in paths.stitch(ends, "level", "strip").collect():
        loops.setdefault((r["level"], r["loop"]), []).append((r["place"], r["node"]))
    got = {}
    for (level, first), nodes in loops.items():
        nodes = [n for _, n in sorted(nodes)]
        assert nodes[0] == nodes[-1] == first == min(nodes)  # the border is below every level, so all are closed
        got.setdefault(level, []).extend(tuple(sorted(p)) for p in zip(nodes, nodes[1:], strict=False))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    saddles = [r for r in raster.marching_squares(df, 1.5).groupBy("row", "col").count().filter("count = 2").collect()]
    assert saddles and len(loops) > 10


def test_open_contours(spark):
    rows = [(1.0, 0, 5, 6), (1.0, 1, 7, 6), (1.0, 1, 7, 2), (1.0, 2, 9, 2), (1.0, 3, 20, 21)]
    found = paths.stitch(spark.createDataFrame(rows, "level double, strip int, a long, b long"), "level", "strip").collect()
    assert sorted((r["loop"], r["place"], r["node"]) for r in found) == [(5, 0, 5), (5, 1, 6), (5, 2, 7), (5, 3, 2), (5, 4, 9), (20, 0, 20), (20, 1, 21)]


def test_tokens(spark):
    key = b"k" * 80
    texts = ["N12AB|1700000000000", "é|0", "x", "a|b|3", "a|12x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("token", scoring.signed_token(key, F.col("t")))
    web = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    for r in rows.withColumn("back", scoring.verified_payload(key, F.col("token"))).collect():
        raw = r["t"].encode()
        assert r["token"] == web(raw) + "." + web(hmac.new(key, raw, hashlib.sha256).digest())[:16]
        assert r["back"] == (r["t"] if r["t"] in texts[:2] else None)
    bad = ["", ".", "a.b.c", "%%.x", "a", None, "QQ.AAAAAAAAAAAAAAAA"]
    rows = spark.createDataFrame([(t,) for t in bad], "t string")
    assert {r["v"] for r in rows.select(scoring.verified_payload(key, F.col("t")).alias("v")).collect()} == {None}


def test_budget_keeps_every_kth_and_the_energy(spark):
    rows = [(h * 3000, m, float(h + 1)) for h in range(9) for m in range(7 + h)]
    n = len(rows)
    for most in (1000, 40, 10):
        k = max(1, math.ceil(n / most))
        want = sorted((h, m, hp * k) for i, (h, m, hp) in enumerate(sorted(rows)) if i % k == 0)
        found = power.within_budget(spark.createDataFrame(rows, "hex long, mark long, hp double").repartition(4), most)
        assert sorted((r["hex"], r["mark"], r["hp"]) for r in found.collect()) == want


def test_spaced_blobs_are_chosen_before_they_are_made(spark):
    rng = random.Random(21)
    rows = []
    for h in range(40):
        lat, t = 40.0, 0
        for i in range(rng.choice([1, 2, 3, 12])):
            t, lat = t + 10, lat + rng.choice([0.0, 0.001, 0.05, -0.2])
            rows.append((h * 700, t, i, lat, -105.0, rng.uniform(50, 900), rng.uniform(0, 300), 10.0))
    b = spark.createDataFrame(rows, "hex long, t_ms long, seq long, lat double, lon double, radius_m double, hp double, heading double").repartition(3)
    even = power.spaced(b, 2.0)
    want = even.count()
    for most in (10**6, want // 3, 7):
        key = lambda df: sorted((r["hex"], r["mark"], *(round(r[c], 9) for c in ("lat", "lon", "radius_m", "hp", "heading"))) for r in df.collect())
        got = power.spaced_within(b, 2.0, most)
        assert key(got) == key(power.within_budget(even, most))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans(even) == 1 and scans(got) <= 3  # counted, then made


def test_spectra(spark):
    rng = random.Random(9)
    rows = [("s", t, t, [rng.choice([-90.0, -30.0, rng.uniform(-80, 0)]) for _ in range(16)]) for t in range(45)]
    weights = [-5.0 * (i % 3) for i in range(16)]
    found = noise.spectral_levels(spark.createDataFrame(rows, "source string, t long, seq long, db array<double>"), 16, 500.0, weights).orderBy("t").collect()
    hz = []
    for i, r in enumerate(found):
        db = rows[i][3]
        power_ = [10 ** ((x + w) / 10) for x, w in zip(db, weights, strict=True)]
        assert math.isclose(r["dba"], 10 * math.log10(sum(power_[1:])), rel_tol=1e-9)
        hz.append(500.0 * (1 + max(range(15), key=lambda j: (power_[1 + j], -j))))
        recent = sorted(hz[-20:])
        assert r["hz"] == hz[-1] and r["median_hz"] == recent[len(recent) // 2]
        for b, (lo, hi) in enumerate(noise.band_bins(16, 500.0)):
            assert math.isclose(r[f"mean{b}"], sum(db[lo : hi + 1]) / (hi - lo + 1), rel_tol=1e-9)
            assert math.isclose(r[f"sustained{b}"], min(found[j][f"mean{b}"] for j in range(max(0, i - 19), i + 1)))
