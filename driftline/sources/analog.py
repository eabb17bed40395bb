"""Moving-object views over star-schema tables, with the same definitions in SQL for the oracles.

``fixes`` reads events as position fixes, ``tracks`` orders with their lines as flown tracks,
``aircraft`` customers as a registry, ``airports`` nations as sites, ``pop_grid`` parts as a population
raster, and so on. Each function takes (spark, sf_dir); WITH holds the same view as a DuckDB CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAT0, LON0 = 40.0394, -105.2258
FIELD_FT = 5288.0
ZONES: dict[str, list[tuple[float, float]]] = {
    "BDU North": [(40.0203, -105.2607), (40.0611, -105.2607), (40.0611, -105.2004), (40.0203, -105.2004)],
    "BDU West": [(40.0817, -105.3009), (40.1123, -105.3009), (40.1123, -105.2411), (40.0817, -105.2411)],
}
TYPES = ["C172", "PA28", "SR22", "BE58", "EC30", "GLID", "C560"]
GRID_ROWS, GRID_COLS = 40, 50
GRID = {"lat_min": 39.92113, "lat_max": 40.16127, "lon_min": -105.36131, "lon_max": -105.10149}
TERRAIN_N, TERRAIN_CELL = 21, 0.0125


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hex, seq, t_ms, lat, lon, alt; (t_ms, seq) orders an aircraft's fixes."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.select(
        F.col("user_id").alias("hex"),
        F.col("event_id").alias("seq"),
        F.floor(micros / 1000000).cast("long").alias("t_ms"),
        (LAT0 + ((k % 10) - 4.5) * 0.02 + ((F.col("event_id") % 97) - 48) * 0.0002).cast("double").alias("lat"),
        (LON0 + (F.floor(k / 10) - 4.5) * 0.02 + ((F.col("event_id") % 89) - 44) * 0.0002).cast("double").alias("lon"),
        (F.floor((5200 + 15 * F.col("value")) * 10 + 0.5) / 10).cast("double").alias("alt"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: call, date, year, worst severity, counts and lengths by class, rand_key."""
    lines = table(spark, sf_dir, "lineitem")
    flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
    classes = {"red": flag == "R", "orange": flag == "A", "yellow": (flag == "N") & (F.col("l_quantity") < 20)}  # the rest is clean
    sums = lines.groupBy(F.col("l_orderkey").alias("track_id")).agg(
        F.count("*").alias("seg_total"),
        *(F.count_if(of).alias(f"seg_{c}") for c, of in classes.items()),
        F.sum(price).alias("len_total_ft"),
        *(F.sum(F.when(of, price).otherwise(0.0)).alias(f"len_{c}_ft") for c, of in classes.items()),
        F.max(F.when(classes["red"], 3).when(classes["orange"], 2).when(classes["yellow"], 1).otherwise(0)).alias("worst"),
    )
    o = table(spark, sf_dir, "orders")
    joined = o.join(sums, o.o_orderkey == sums.track_id, "left")
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z)).alias(c)
    return joined.select(
        F.col("o_orderkey").alias("track_id"),
        F.col("o_custkey").alias("tail"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.year("o_orderdate").alias("year"),
        F.concat_ws("_", F.lit("tracks"), F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey")).alias("src"),
        F.pmod(F.col("o_orderkey"), F.lit(24)).cast("int").alias("start_hour"),
        zero("worst", 0),
        *(zero(f"seg_{c}", 0) for c in ("total", "red", "orange", "yellow")),
        *(zero(f"len_{c}_ft", 0.0) for c in ("total", "red", "orange", "yellow")),
        F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice") / 100).alias("pop_impact"),
        (F.col("o_orderkey") * 7919 % 1000000).alias("rand_key"),
    )


def aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tail, school, base, origin, type, purpose as stored (some unknown)."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    types = F.array(*map(F.lit, TYPES))
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("tail"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("school"),
        F.col("n_name").alias("base"),
        F.when(F.col("n_regionkey") < 2, "local").otherwise("transient").alias("origin"),
        F.get(types, (F.col("c_custkey") % len(TYPES)).cast("int")).alias("type"),
        F.when(F.col("c_custkey") % 3 == 0, "unknown").when(F.col("c_custkey") % 5 == 0, "survey").alias("purpose"),
    )


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, lat, lon, elev: one site for each nation, 25 at most by the grid below."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    return n.select(
        key.cast("int").alias("code"),
        F.col("n_name").alias("name"),
        (LAT0 + ((key % 5) - 2) * 0.04).cast("double").alias("lat"),
        (LON0 + (F.floor(key / 5) - 2) * 0.04).cast("double").alias("lon"),
        (FIELD_FT + key * 7).cast("double").alias("elev"),
    )


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tail, started, ended (null for some), klass, score (null for some), media, distance."""
    f = fixes(spark, sf_dir).join(table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("seq")), "seq")
    return f.select(
        F.col("seq").alias("id"),
        F.col("hex").alias("tail"),
        F.col("t_ms").alias("started"),
        F.when(F.col("seq") % 4 != 0, F.col("t_ms") + 30).alias("ended"),
        F.when(F.col("seq") % 3 == 0, "yellow").when(F.col("seq") % 3 == 1, "orange").otherwise("red").alias("klass"),
        F.when(F.col("seq") % 7 != 0, F.col("seq") % 11).alias("score"),
        F.when(F.col("seq") % 2 == 0, "video").when(F.col("seq") % 5 == 0, "audio").alias("media"),
        F.when(F.col("seq") % 6 != 0, (F.col("seq") % 50) / 10.0).alias("distance_mi"),
        "lat",
        "lon",
    )


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind (operator, pilot, pilot-response), tail, at, action."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type")
    kind = F.when(F.col("event_type") == "click", "operator").when(F.col("event_type") == "signup", "pilot").when(F.col("event_type") == "purchase", "pilot-response")
    k = F.col("seq") % 4
    action = F.when(kind == "pilot-response", F.when(k == 0, "seen").when(k == 1, "acknowledged").when(k == 2, "resolved"))
    rows = fixes(spark, sf_dir).join(e, "seq").filter(kind.isNotNull())
    return rows.select(F.col("seq").alias("id"), kind.alias("kind"), F.col("hex").alias("tail"), F.col("t_ms").alias("at"), action.alias("action"))


def pop_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row (0 is north), col, density; cells without a part hold nobody."""
    p = table(spark, sf_dir, "part").filter(F.col("p_partkey") < GRID_ROWS * GRID_COLS)
    key = F.col("p_partkey")
    return p.select(
        F.floor(key / GRID_COLS).cast("int").alias("row"),
        (key % GRID_COLS).cast("int").alias("col"),
        F.when(F.col("p_size") % 5 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("density"),
    )


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, elev_ft of a square lattice around the field."""
    n = spark.range(TERRAIN_N * TERRAIN_N)
    row, col = F.floor(F.col("id") / TERRAIN_N), F.col("id") % TERRAIN_N
    return n.select(row.cast("int").alias("row"), col.cast("int").alias("col"), (5300 + (row * 37 + col * 53) % 200).cast("double").alias("elev_ft"))


_EDGES = ",\n    ".join(
    f"('{name}', {i}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {p[(j + 1) % len(p)][0]}::DOUBLE, {p[(j + 1) % len(p)][1]}::DOUBLE)" for i, (name, p) in enumerate(ZONES.items()) for j, a in enumerate(p)
)

WITH = {
    "fixes": f"""fixes AS (
  SELECT user_id AS hex, event_id AS seq, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0) AS BIGINT) AS t_ms,
    CAST({LAT0}::DOUBLE + ((k % 10) - 4.5::DOUBLE) * 0.02::DOUBLE + ((event_id % 97) - 48) * 0.0002::DOUBLE AS DOUBLE) AS lat,
    CAST({LON0}::DOUBLE + (floor(k / 10.0) - 4.5::DOUBLE) * 0.02::DOUBLE + ((event_id % 89) - 44) * 0.0002::DOUBLE AS DOUBLE) AS lon,
    (floor((5200 + 15 * value) * 10 + 0.5) / 10)::DOUBLE AS alt
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) e)""",
    "tracks": """tracks AS (
  SELECT o_orderkey AS track_id, o_custkey AS tail, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INT) AS year,
    concat_ws('_', 'tracks', strftime(o_orderdate, '%Y%m%d'), o_orderkey) AS src, CAST(o_orderkey % 24 AS INT) AS start_hour,
    coalesce(worst, 0) AS worst, coalesce(n, 0) AS seg_total, coalesce(r, 0) AS seg_red, coalesce(a, 0) AS seg_orange, coalesce(y, 0) AS seg_yellow,
    coalesce(lt, 0.0)::DOUBLE AS len_total_ft, coalesce(lr, 0.0)::DOUBLE AS len_red_ft, coalesce(la, 0.0)::DOUBLE AS len_orange_ft, coalesce(ly, 0.0)::DOUBLE AS len_yellow_ft,
    CASE WHEN o_totalprice > 1000 THEN o_totalprice / 100 END AS pop_impact, o_orderkey * 7919 % 1000000 AS rand_key
  FROM orders LEFT JOIN (
    SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N' AND l_quantity < 20) AS y,
      sum(l_extendedprice) AS lt, sum(l_extendedprice) FILTER (l_returnflag = 'R') AS lr, sum(l_extendedprice) FILTER (l_returnflag = 'A') AS la,
      sum(l_extendedprice) FILTER (l_returnflag = 'N' AND l_quantity < 20) AS ly, max(CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_returnflag = 'A' THEN 2 WHEN l_quantity < 20 THEN 1 ELSE 0 END) AS worst
    FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)""",
    "aircraft": f"""aircraft AS (
  SELECT c_custkey AS tail, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS school, n_name AS base,
    CASE WHEN n_regionkey < 2 THEN 'local' ELSE 'transient' END AS origin,
    ({TYPES!r})[CAST(c_custkey % {len(TYPES)} AS INT) + 1] AS type,
    CASE WHEN c_custkey % 3 = 0 THEN 'unknown' WHEN c_custkey % 5 = 0 THEN 'survey' END AS purpose
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "airports": f"""airports AS (
  SELECT CAST(n_nationkey AS INT) AS code, n_name AS name, CAST({LAT0}::DOUBLE + ((n_nationkey % 5) - 2) * 0.04::DOUBLE AS DOUBLE) AS lat,
    CAST({LON0}::DOUBLE + (floor(n_nationkey / 5.0) - 2) * 0.04::DOUBLE AS DOUBLE) AS lon, CAST({FIELD_FT} + n_nationkey * 7 AS DOUBLE) AS elev
  FROM nation)""",
    "complaints": """complaints AS (
  SELECT f.seq AS id, hex AS tail, t_ms AS started, CASE WHEN f.seq % 4 <> 0 THEN t_ms + 30 END AS ended,
    CASE f.seq % 3 WHEN 0 THEN 'yellow' WHEN 1 THEN 'orange' ELSE 'red' END AS klass, CASE WHEN f.seq % 7 <> 0 THEN f.seq % 11 END AS score,
    CASE WHEN f.seq % 2 = 0 THEN 'video' WHEN f.seq % 5 = 0 THEN 'audio' END AS media, CASE WHEN f.seq % 6 <> 0 THEN (f.seq % 50) / 10.0::DOUBLE END AS distance_mi, lat, lon
  FROM fixes f JOIN events e ON e.event_id = f.seq WHERE event_type = 'error')""",
    "notifications": """notifications AS (
  SELECT * FROM (SELECT f.seq AS id, CASE event_type WHEN 'click' THEN 'operator' WHEN 'signup' THEN 'pilot' WHEN 'purchase' THEN 'pilot-response' END AS kind, hex AS tail, t_ms AS at,
    CASE WHEN event_type = 'purchase' THEN CASE f.seq % 4 WHEN 0 THEN 'seen' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'resolved' END END AS action
  FROM fixes f JOIN events e ON e.event_id = f.seq) n WHERE kind IS NOT NULL)""",
    "pop_grid": f"""pop_grid AS (
  SELECT CAST(floor(p_partkey / {GRID_COLS}.0) AS INT) AS row, CAST(p_partkey % {GRID_COLS} AS INT) AS col, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_retailprice END::DOUBLE AS density
  FROM part WHERE p_partkey < {GRID_ROWS * GRID_COLS})""",
    "terrain": f"""terrain AS (
  SELECT CAST(floor(i / {TERRAIN_N}.0) AS INT) AS row, CAST(i % {TERRAIN_N} AS INT) AS col, CAST(5300 + (CAST(floor(i / {TERRAIN_N}.0) AS INT) * 37 + (i % {TERRAIN_N}) * 53) % 200 AS DOUBLE) AS elev_ft
  FROM range({TERRAIN_N * TERRAIN_N}) t(i))""",
    "zone_edges": f"""zone_edges AS (
  SELECT * FROM (VALUES
    {_EDGES}) e(zone, zone_no, a_lat, a_lon, b_lat, b_lon))""",
}
_AFTER = {"complaints": ["fixes"], "notifications": ["fixes"]}


def with_sql(*views: str) -> str:
    """``WITH ...`` of the named views and those they stand on."""
    order: list[str] = []
    for v in views:
        order += [x for x in [*_AFTER.get(v, []), v] if x not in order]
    return "WITH " + ",\n".join(WITH[v] for v in order)
