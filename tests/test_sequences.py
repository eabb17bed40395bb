"""Ordered operators on hand-made tracks, and invariants on the analog fixes."""

import pytest
from pyspark.sql import functions as F

from driftline.functions import geo, kernels, scoring
from driftline.operators import joins, paths, sequences
from driftline.sources import analog

SF = "/root/testdata/sf0.001"
GROUND = 5438.0


def track(spark, alts, step=10, move=0.0, hexcode=1):
    rows = [(hexcode, i, i * step, 40.0 + i * move, -105.0, None if a is None else float(a)) for i, a in enumerate(alts)]
    return spark.createDataFrame(rows, "hex long, seq long, t_ms long, lat double, lon double, alt double")


SINGLE = [5300, 5300, 5300, 5600, 5900, 6300, 6700, 7000, 7300, 7000, 6600, 6200, 5800, 5500, 5300, 5300, 5300]


def kinds(df):
    return [r["type"] for r in df.orderBy("island", "start_ts", F.col("type") == "descent", "end_ts").collect()]


def test_single_cycle(spark):
    t = track(spark, SINGLE)
    assert kinds(sequences.phases(t, GROUND)) == ["on_ground", "climb", "descent", "on_ground"]
    flights = sequences.cycles(t, GROUND).collect()
    assert len(flights) == 1
    f = flights[0]
    assert (f["takeoff_ts"], f["release_ts"], f["landing_ts"], f["release_alt_ft"]) == (30, 80, 130, 7300.0)


def test_two_cycles_and_merge(spark):
    loop = [5300, 5300, 5800, 6500, 7200, 6500, 5800, 5300, 5300]
    flights = sequences.cycles(track(spark, loop + [5800, 6600, 7500, 6400, 5700, 5300]), GROUND)
    assert flights.count() == 2 and flights.select("flight_id").distinct().count() == 2
    assert sequences.merge_cycles(flights, 600).collect()[0]["legs"] == 2
    assert sequences.merge_cycles(flights, 5).count() == 2


def test_in_progress_and_ground_only(spark):
    f = sequences.cycles(track(spark, [5300, 5300, 5800, 6200, 6600, 7000]), GROUND).collect()
    assert len(f) == 1 and f[0]["landing_ts"] is None and f[0]["cycle_time_min"] is None
    assert sequences.cycles(track(spark, [5300, 5310, 5400, 5350, 5300]), GROUND).count() == 0


def test_monotonic_and_taxi(spark):
    assert kinds(sequences.phases(track(spark, [5600, 6000, 6500, 7000]), GROUND)) == ["climb"]
    assert kinds(sequences.phases(track(spark, [7000, 6500, 6000, 5600]), GROUND)) == ["descent"]
    assert kinds(sequences.phases(track(spark, [5300] * 4, move=0.001), GROUND)) == ["taxiing"]


def test_null_altitudes_extend_a_run(spark):
    assert kinds(sequences.phases(track(spark, [5600, None, 6500, None, 7000]), GROUND)) == ["climb"]


def test_bands_tile_the_track(spark):
    f = analog.fixes(spark, SF)
    c = f.withColumn("sev", geo.altitude_severity(F.col("alt")))
    bands = sequences.bands(c, bridge=False)
    assert bands.agg(F.sum("n")).first()[0] == f.count()
    bridged = sequences.bands(c)
    assert bridged.agg(F.sum("n_points")).first()[0] == f.count() + bands.count() - f.select("hex").distinct().count()


def test_class_lengths_sum_to_total(spark):
    c = analog.fixes(spark, SF).withColumn("sev", geo.altitude_severity(F.col("alt")))
    s = sequences.segments(c).groupBy("hex").agg(F.sum("len_ft").alias("total"), *(F.sum(F.when(F.col("seg_sev") == i, F.col("len_ft")).otherwise(0.0)).alias(f"s{i}") for i in range(4)))
    assert s.filter(F.abs(F.col("total") - F.col("s0") - F.col("s1") - F.col("s2") - F.col("s3")) > 1e-3).count() == 0


def test_nearest_site_needs_no_order_of_sites(spark):
    f, a = analog.fixes(spark, SF), analog.airports(spark, SF)
    near = joins.nearest_site(f, a, 1.5)
    brute = f.crossJoin(a.select("code", F.col("lat").alias("sa"), F.col("lon").alias("so"))).withColumn("nm", geo.planar_nm(F.col("lat"), F.col("lon"), F.col("sa"), F.col("so"))).filter("nm <= 1.5")
    want = brute.groupBy("seq").agg(F.min(F.struct("nm", "code"))["code"].alias("code"))
    assert near.filter("site is not null").select("seq", "site").exceptAll(want).count() == 0
    assert near.filter("site is not null").count() == want.count() and near.count() == f.count()


def test_as_of_takes_the_latest_before(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 3)], "k long, t long")
    right = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 11, "c"), (2, 4, "d")], "k long, u long, v string")
    got = {(r["k"], r["t"]): r["r_v"] for r in joins.as_of(left, right, "k", "t", "u", ["v"]).collect()}
    assert got == {(1, 10): "b", (1, 5): "b", (2, 3): None}


def test_thinning_keeps_within_tolerance(spark):
    import numpy as np

    x = np.linspace(0, 6, 200)
    keep = kernels.douglas_peucker(np.sin(x), x, 0.01)
    assert keep[0] and keep[-1] and keep.sum() < 40
    assert np.abs(np.interp(x, x[keep], np.sin(x)[keep]) - np.sin(x)).max() < 0.02
    assert paths.thin(analog.fixes(spark, SF), 0.02).count() <= analog.fixes(spark, SF).count()


@pytest.mark.parametrize("start,end,want", [(6, 20, 14), (22, 5, 7), (5, 5, 0)])
def test_hours_wrap(spark, start, end, want):
    assert spark.range(24).filter(scoring.in_hours(F.col("id"), start, end)).count() == want


def test_halves_round_up(spark):
    got = spark.createDataFrame([(-2.5,), (2.5,), (0.49,)], "x double").select(scoring.js_round(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == [-2.0, 3.0, 0.0]


def test_lower_flights_score_worse(spark):
    scores = spark.createDataFrame([(0.0,), (10.0,), (50.0,)], "load double").select(scoring.load_score(F.col("load"), 40.0).alias("s")).collect()
    assert [r["s"] for r in scores] == [100, 78, 29]


def test_distance_is_rounded_to_tenths(spark):
    got = spark.createDataFrame([(0.4,), (1.0,), (None,)], "d double").select(scoring.private_distance(F.col("d")).alias("m")).collect()
    assert [r["m"] for r in got] == [0.3, 0.8, None]
