"""Queries over documents, stores and the replayed stream (SRC, SNK, SCA-26/27, STR)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import analog, stores
from ..sources.analog import FIELD_FT, LAT0, LON0, with_sql
from ..streaming import approach, ingest
from .registry import query
from .scalars import _HAV, CLASSED, classified

FX = with_sql("fixes")
TABLES = "region nation customer supplier part orders lineitem events".split()


@query("src07_yearly_files", f"{FX} SELECT hex, row_number() OVER (PARTITION BY hex ORDER BY t_ms, seq) - 1 AS seq, lat, lon, t_ms FROM fixes")
def src07(spark, sf_dir):
    """All tracks written as yearly JSON files to the shared checkpoint folder and read back as fixes."""
    f = analog.fixes(spark, sf_dir).withColumn("year", F.year(F.timestamp_seconds("t_ms")))
    points = F.transform(F.array_sort(F.collect_list(F.struct("t_ms", "seq", "lat", "lon", "alt"))), lambda p: F.array(p["lat"], p["lon"], p["alt"], p["t_ms"].cast("double")))
    tracks = f.groupBy("year", "hex").agg(points.alias("points"))
    rows = stores.read_years(spark, stores.write_years(tracks.withColumn("hex", F.col("hex").cast("string"))))
    # a track's later years go on counting where the earlier ones end
    n = F.row_number().over(Window.partitionBy("hex").orderBy("offset_s", "year", "seq")) - 1
    rows = rows.withColumn("year", F.year(F.timestamp_seconds("offset_s"))).withColumn("seq", n)
    return rows.select(F.col("hex").cast("long").alias("hex"), "seq", "lat", "lon", F.col("offset_s").cast("long").alias("t_ms"))


@query("src06_school_document", f"{with_sql('aircraft')} SELECT school, base AS airport, CAST(tail AS VARCHAR) AS tail, type FROM aircraft WHERE school IS NOT NULL")
def src06(spark, sf_dir):
    """Nested documents of schools and their aircraft, written to the shared folder and read back as rows."""
    a = analog.aircraft(spark, sf_dir).filter("school is not null").select(F.col("school").alias("name"), F.col("base").alias("airport"), F.col("tail").cast("string").alias("tail"), "type")
    return stores.read_document(spark, stores.write_documents(a, ["name", "airport"], "schools", "aircraft"))


def feed(spark, sf_dir):
    """fixes as feed messages, one per ten seconds."""
    f = analog.fixes(spark, sf_dir)
    a = F.struct(F.col("hex").cast("string").alias("hex"), F.lit(None).cast("string").alias("r"), F.col("hex").cast("string").alias("flight"), "lat", "lon", F.col("alt").cast("string").alias("alt_baro"), F.lit(0.0).alias("gs"), F.lit(0.0).alias("track"))
    return f.groupBy((F.floor(F.col("t_ms") / 10) * 10000).cast("long").alias("now")).agg(F.collect_list(a).alias("ac")).select("ac", "now")


@query("src11_feed_failover", f"{FX} SELECT CAST(hex AS VARCHAR) AS hex, count(*) AS n FROM fixes WHERE alt > 0 AND alt < 10000 GROUP BY hex")
def src11(spark, sf_dir):
    messages = feed(spark, sf_dir)
    broken = messages.withColumn("ac", F.when(F.col("now") % 3 != 0, F.col("ac")))
    fixes = ingest.parse(ingest.first_usable([broken, messages]))
    return fixes.groupBy("hex").agg(F.count("*").alias("n"))


@query("src15_catalog", " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS rows, (SELECT count(*) FROM pragma_table_info('{t}')) AS columns" for t in TABLES))
def src15(spark, sf_dir):
    return stores.catalog_probe(spark, {t: analog.table(spark, sf_dir, t) for t in TABLES})


_RAND = "('0x' || substr(md5(src), 1, 8))::UBIGINT % 1000000"


@query("snk02_random_key", f"{with_sql('tracks')} SELECT src, CAST({_RAND} AS BIGINT) AS rand_key FROM tracks")
def snk02(spark, sf_dir):
    """Tracks written in four transactions with their sampling key, and read back."""
    path = stores.shared_folder(spark, "inserted")
    stores.write_parts(stores.with_random_key(analog.tracks(spark, sf_dir).select("src"), "src"), path, "src", 8, at_once=2)
    return stores.read_parts(spark, path, "src string, rand_key long")


@query("snk03_resume", f"{with_sql('tracks')} SELECT track_id, year, worst, seg_total, round(len_total_ft, 2) AS len_total_ft FROM tracks")
def snk03(spark, sf_dir):
    """Classified tracks, written by a run that ends half-way and a second one that resumes it, and read back."""
    t = analog.tracks(spark, sf_dir).select("track_id", "year", "worst", "seg_total", F.round("len_total_ft", 2).alias("len_total_ft"))
    path = stores.shared_folder(spark, "resumed")
    stores.write_parts(t, path, "track_id", 8, at_once=2, most=4)
    stores.write_parts(t, path, "track_id", 8)
    return stores.read_parts(spark, path, "track_id long, year int, worst int, seg_total long, len_total_ft double")


def _replayed(spark, sf_dir, name, rows, keys, order):
    """rows (with t_ms and day) flushed in three batches of time, the second one twice."""
    path = stores.shared_folder(spark, name)
    third = (F.col("t_ms") / 864_000).cast("int")  # ten days
    for batch in (0, 1, 1, 2):
        own = rows.filter(F.least(third, F.lit(2)) == batch).drop("t_ms")
        stores.flush_days(own, batch, path, keys, order)
    return path


@query("snk05_latest_flush", f"{FX} SELECT CAST(floor(t_ms / 864000.0) AS BIGINT) AS day, hex, arg_max(seq, t_ms * 1000000 + seq) AS seq, count(DISTINCT NULL) AS n FROM fixes GROUP BY 1, 2".replace(", count(DISTINCT NULL) AS n", ""))
def snk05(spark, sf_dir):
    """The latest fix of each aircraft and period of ten days, from snapshots that batches overwrite."""
    f = analog.fixes(spark, sf_dir).select("hex", "seq", "t_ms", F.col("t_ms").alias("at"), F.floor(F.col("t_ms") / 864_000).cast("long").alias("day"))
    latest = f.withColumn("_n", F.row_number().over(Window.partitionBy("day", "hex").orderBy(F.desc("t_ms"), F.desc("seq")))).filter("_n = 1").drop("_n")
    path = _replayed(spark, sf_dir, "flushed", latest, ["hex"], ["at", "seq"])
    stores.remove_superseded(spark, path)
    return stores.read_days(spark, path, "hex long, seq long, at long").select("day", "hex", "seq")


_SCORE_DOC = "CASE doc_id % 4 WHEN 0 THEN CAST(doc_id % 11 AS DOUBLE) WHEN 1 THEN CAST(doc_id % 9 AS DOUBLE) WHEN 2 THEN CAST(doc_id % 10 AS DOUBLE) ELSE CASE doc_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 5 ELSE 3 END END::DOUBLE"


def polymorphic(spark, sf_dir):
    """Reports whose score is a number, an object, a phrase in the notes, or only a class."""
    d, k = analog.table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    klass = F.when(k % 3 == 0, "red").when(k % 3 == 1, "orange").otherwise("yellow")
    raw = (
        F.when(k % 4 == 0, F.format_string('{"score": %d, "location": {"lat": 40.5, "lon": %d}}', k % 11, -(k % 90)))
        .when(k % 4 == 1, F.format_string('{"score": {"total": %d}, "location": {"lat": 40.5, "lng": %d}}', k % 9, -(k % 90)))
        .when(k % 4 == 2, F.format_string('{"notes": "loud. Score %d/10 at noon", "flight": {"nearest": {"lat": 40.5, "lon": %d}}}', k % 10, -(k % 90)))
        .otherwise(F.format_string('{"klass": "%s", "reporter": {"location": {"lat": 40.5, "lon": %d}}}', klass, -(k % 90)))
    )
    return d.withColumn("v", F.parse_json(raw))


@query("sca26_polymorphic_score", f"SELECT doc_id, {_SCORE_DOC} AS score FROM documents")
def sca26(spark, sf_dir):
    get = lambda path, kind="double": F.try_variant_get("v", path, kind)
    noted = F.expr("try_cast(nullif(regexp_extract(try_variant_get(v, '$.notes', 'string'), 'Score (\\\\d+)/10', 1), '') as double)")
    klass = get("$.klass", "string")
    proxy = F.when(klass == "red", 7.0).when(klass == "orange", 5.0).when(klass == "yellow", 3.0)
    return polymorphic(spark, sf_dir).select("doc_id", F.coalesce(get("$.score"), get("$.score.total"), noted, proxy, F.lit(1.0)).alias("score"))


@query("sca27_polymorphic_position", "SELECT doc_id, CAST(40.5 AS DOUBLE) AS lat, CAST(-(doc_id % 90) AS DOUBLE) AS lon FROM documents")
def sca27(spark, sf_dir):
    get = lambda *paths: F.coalesce(*(F.try_variant_get("v", p, "double") for p in paths))
    lat = get("$.location.lat", "$.flight.nearest.lat", "$.reporter.location.lat")
    lon = get("$.location.lon", "$.location.lng", "$.flight.nearest.lon", "$.reporter.location.lon")
    return polymorphic(spark, sf_dir).select("doc_id", lat.alias("lat"), lon.alias("lon"))


#: fixes of one aircraft are hours apart here, so silence and cool-down are as well
LIMITS = approach.Limits(cooldown_s=40_000.0, silent_s=30_000.0)
_SLANT = f"greatest(100.0, sqrt(pow(m * 3.28084, 2) + pow(greatest(1.0, alt - {FIELD_FT}), 2)))"
_AP = f"""WITH RECURSIVE {with_sql('fixes', 'aircraft').removeprefix('WITH ')}, ap AS (SELECT hex, ts_s, seq, m, 95.0 - 25.0 * log10({_SLANT} / 100) AS level
  FROM (SELECT CAST(hex AS VARCHAR) AS hex, CAST(t_ms AS DOUBLE) AS ts_s, seq, alt, 2 * 6371000.0 * asin(least(1.0, sqrt({_HAV}))) AS m FROM fixes JOIN aircraft ON tail = hex WHERE type <> 'GLID'))"""


def approaching(spark, sf_dir):
    """Fixes of aircraft with engines, their distance from the field and the level expected there."""
    powered = analog.aircraft(spark, sf_dir).filter("type <> 'GLID'").select(F.col("tail").alias("hex"))
    f = analog.fixes(spark, sf_dir).join(powered, "hex").select(F.col("hex").cast("string").alias("hex"), F.col("t_ms").cast("double").alias("ts_s"), "seq", "lat", "lon", "alt")
    slant = F.greatest(F.lit(100.0), F.hypot(F.col("m") * 3.28084, F.greatest(F.lit(1.0), F.col("alt") - FIELD_FT)))
    return approach.measured(f, LAT0, LON0).withColumn("level", 95.0 - 25.0 * F.log10(slant / 100))


@query("cmp13_auto_report", f"{_AP}, {approach.oracle('ap', LIMITS)} SELECT hex, entered, closest_ts, round(closest_m, 3) AS closest_m, round(peak, 6) AS peak, fired FROM rp")
def cmp13(spark, sf_dir):
    r = approach.track_batch(approaching(spark, sf_dir), LIMITS)
    return r.select("hex", "entered", "closest_ts", F.round("closest_m", 3).alias("closest_m"), F.round("peak", 6).alias("peak"), "fired")


def timed(spark, sf_dir):
    return classified(spark, sf_dir).withColumn("ts", F.timestamp_seconds("t_ms"))


@query("str10_sessions", f"{FX} SELECT hex, count(*) AS flights FROM (SELECT hex, t_ms - lag(t_ms) OVER (PARTITION BY hex ORDER BY t_ms, seq) AS gap FROM fixes) WHERE gap IS NULL OR gap >= 900 GROUP BY hex")
def str10(spark, sf_dir):
    return ingest.flight_sessions(timed(spark, sf_dir)).groupBy("hex").agg(F.count("*").alias("flights"))


@query("str11_daily_windows", f"{CLASSED} SELECT hex, CAST(floor(t_ms / 86400.0) AS BIGINT) AS day, count(*) AS n, max(sev) AS worst FROM classed GROUP BY 1, 2")
def str11(spark, sf_dir):
    d = ingest.daily_counts(timed(spark, sf_dir))
    return d.select("hex", F.floor(F.unix_timestamp("window.start") / 86400).cast("long").alias("day"), "n", "worst")


@query("str07_retention", f"{CLASSED} SELECT seq FROM classed WHERE 2000000 - t_ms < 10800 OR (sev > 0 AND 2000000 - t_ms < 86400)")
def str07(spark, sf_dir):
    return ingest.recent(timed(spark, sf_dir), "1970-01-24 03:33:20").select("seq")


@query("str05_incremental_classification", f"{CLASSED} SELECT CAST(floor(t_ms / 86400.0) AS BIGINT) AS day, seq, sev FROM classed")
def str05(spark, sf_dir):
    """Fixes classified in the batch that brings them and merged into their day's snapshot; stored ones aren't classified again."""
    f = ingest.classify(analog.fixes(spark, sf_dir).withColumn("ts", F.timestamp_seconds("t_ms")), list(analog.ZONES.values()))
    rows = f.select("hex", "seq", "sev", "t_ms", F.floor(F.col("t_ms") / 86400).cast("long").alias("day"))
    path = _replayed(spark, sf_dir, "classified", rows, ["hex", "seq"], ["sev"])
    return stores.read_days(spark, path, "hex long, seq long, sev int").select("day", "seq", "sev")
