"""Streams against the same logic on stored rows."""

import json

from pyspark.sql import functions as F

from driftline.sources import analog
from driftline.streaming import approach, ingest


def messages(path):
    path.mkdir()
    for i in range(4):
        ac = [{"hex": f"A{j} ", "r": None if j else "n123", "flight": "x1", "lat": 40.03 + j * 0.01, "lon": -105.23, "alt_baro": alt} for j, alt in enumerate([6000 + i, "ground", 12000, 5500])]
        (path / f"{i}.json").write_text(json.dumps({"ac": ac, "now": 1_700_000_000_000 + i * 5000}))


def test_capture_equals_batch(spark, tmp_path):
    messages(tmp_path / "in")
    polygons = list(analog.ZONES.values())
    fixes = ingest.classify(ingest.suppress_repeats(ingest.parse(ingest.read_feed(spark, str(tmp_path / "in")))), polygons)
    ingest.capture(fixes, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batch = ingest.classify(ingest.parse(spark.read.schema(ingest.FEED).json(str(tmp_path / "in"))), polygons)
    first = batch.groupBy("hex", "lat", "lon").agg(F.min("ts").alias("ts"))  # nothing moves
    batch = batch.join(first, ["hex", "lat", "lon", "ts"])
    columns = ["hex", "tail", "lat", "lon", "alt", "sev"]
    stored = spark.read.parquet(str(tmp_path / "out")).select(columns)
    assert stored.count() == 2
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, batch.select(columns).collect()))
    assert {r["tail"] for r in stored.collect()} == {"N123", "X1"}


def test_restart_adds_nothing_twice(spark, tmp_path):
    messages(tmp_path / "in")
    for _ in range(2):
        fixes = ingest.classify(ingest.parse(ingest.read_feed(spark, str(tmp_path / "in"))), list(analog.ZONES.values()))
        ingest.capture(fixes, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_batches_reach_the_sink(spark, tmp_path):
    messages(tmp_path / "in")
    seen = []
    fixes = ingest.parse(ingest.read_feed(spark, str(tmp_path / "in")))
    ingest.capture_with(fixes, lambda df, i: seen.append((i, df.count())), str(tmp_path / "check")).awaitTermination()
    assert sum(n for _, n in seen) == 8


def test_failover_takes_the_first_usable_feed(spark):
    schema = ingest.FEED
    a = spark.createDataFrame([(None, 1), ([("a", None, None, 1.0, 1.0, "500", 0.0, 0.0)], 2)], schema)
    b = spark.createDataFrame([([("b", None, None, 1.0, 1.0, "500", 0.0, 0.0)], 1), ([("b", None, None, 1.0, 1.0, "500", 0.0, 0.0)], 2)], schema)
    got = {(r["now"], r["ac"][0]["hex"]) for r in ingest.first_usable([a, b]).collect()}
    assert got == {(1, "b"), (2, "a")}


FIXES = "hex string, ts_s double, seq bigint, lat double, lon double"


def visits(rng, n):
    """Aircraft that circle, pass, stop near the point or stay away, in order of time."""
    rows = []
    for h in range(n):
        ts, far = 1000.0 * rng.random(), 8.0
        for i in range(60):
            far = max(0.0, far + rng.choice([-1.5, -0.6, -0.1, 0.05, 0.7, 1.6]))
            rows.append((f"h{h}", round(ts, 1), h * 1000 + i, 40.0 + far / 60, -105.0))
            ts += rng.choice([5.0, 20.0, 20.0, 60.0, 89.0, 90.0, 300.0])
    return sorted(rows, key=lambda r: (r[1], r[2]))


def test_approaches_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    import random

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = visits(random.Random(3), 12)
    frame = lambda r: approach.measured(spark.createDataFrame(r, FIXES), 40.0, -105.0, F.pmod(F.col("seq"), F.lit(7)).cast("double"))
    batch = sorted(map(tuple, approach.track_batch(frame(rows).repartition(3)).collect()))
    rng, parts = random.Random(4), [rows[i : i + 150] for i in range(0, len(rows), 150)]
    for i in range(len(parts) - 1):  # neighbours within a batch's edge change places: late, but not too late
        if parts[i][-1][1] - parts[i + 1][0][1] < 50 and parts[i + 1][0][1] > parts[i][-3][1]:
            parts[i][-1], parts[i + 1][0] = parts[i + 1][0], parts[i][-1]
    parts.append([("last", rows[-1][1] + 10_000.0, 0, 50.0, -105.0)])  # only moves the watermark
    parts.append([("last", rows[-1][1] + 90_000.0, 1, 50.0, -105.0)])
    for i, own in enumerate(parts):
        rng.shuffle(own)
        frame(own).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
        stream = spark.readStream.schema(frame(own).schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = approach.track(stream, late="5 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        query = query.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == batch and len(batch) > 20
    left = sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
    assert left <= 6  # only what the last, distant aircraft waits with


def test_a_silent_visit_ends_and_a_visit_in_the_cool_down_is_dropped(spark):
    near, away = (40.01, -105.0), (41.0, -105.0)
    path = [(0, near), (30, (40.001, -105.0)), (500, away), (1000, near), (1010, away), (1020, near), (1030, away), (1200, near), (1210, away), (1240, away)]
    rows = [("a", float(t), i, *at) for i, (t, at) in enumerate(path)]
    out = approach.track_batch(approach.measured(spark.createDataFrame(rows, FIXES), 40.0, -105.0)).collect()
    assert [(r["entered"], r["closest_ts"], r["fired"], r["peak"]) for r in out] == [(0.0, 30.0, 120.0, None), (1000.0, 1000.0, 1010.0, None), (1200.0, 1200.0, 1210.0, None)]


def test_sessions_split_on_silence(spark):
    rows = [("a", s) for s in (0, 60, 2000, 2100)]
    df = spark.createDataFrame(rows, "hex string, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("alt", F.lit(1.0))
    assert ingest.flight_sessions(df).count() == 2


def test_repeats_are_of_the_fix_before_on_the_same_day(spark, tmp_path):
    day = 1_700_006_400  # a midnight
    seen = [(0, 1.0, "X1"), (5, 1.0, "X1"), (10, 2.0, "N12AB"), (15, 1.0, "X1"), (20, 1.0, "X1"), (86_400, 1.0, "X1"), (86_405, 1.0, "X1")]
    for part, rows in (("a", seen[:4]), ("b", seen[4:])):
        df = spark.createDataFrame([("h", tail, day + s, lat, 0.0, 500.0) for s, lat, tail in rows], "hex string, tail string, s long, lat double, lon double, alt double")
        df.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(str(tmp_path / "in" / part))
        stream = spark.readStream.schema("hex string, tail string, lat double, lon double, alt double, ts timestamp").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        ingest.suppress_repeats(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["s"] - day, r["lat"], r["tail"]) for r in spark.read.parquet(str(tmp_path / "out")).withColumn("s", F.unix_timestamp("ts")).collect())
    assert got == [(0, 1.0, "X1"), (10, 2.0, "N12AB"), (15, 1.0, "N12AB"), (86_400, 1.0, "X1")]

