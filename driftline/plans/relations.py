"""Queries of sources, sinks, joins, rollups, sorts and set operations (SRC, SNK, JOI, AGG, SRT, SET)."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, scoring
from ..operators import joins
from ..sources import analog
from ..sources.analog import LAT0, with_sql
from .registry import query
from .scalars import _NM, CLASSED, PURPOSE_SQL, classified
from .trajectories import CYCLES, flights

FX, TR, AC = (with_sql(v) for v in ("fixes", "tracks", "aircraft"))
TA = with_sql("tracks", "aircraft")
FA = with_sql("fixes", "airports")
CO, NO = with_sql("complaints"), with_sql("notifications")
T = analog.table


# --- sources and sinks -------------------------------------------------------------------------------


@query("src01_date_range", f"{TR} SELECT track_id, date FROM tracks WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' ORDER BY date DESC, track_id DESC LIMIT 500")
def src01(spark, sf_dir):
    t = analog.tracks(spark, sf_dir).filter(F.col("date").between("1997-01-01", "1997-03-31"))
    return t.orderBy(F.desc("date"), F.desc("track_id")).limit(500).select("track_id", "date")


@query("src02_latest_snapshot", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def src02(spark, sf_dir):
    return T(spark, sf_dir, "orders").agg(F.max(F.struct("o_orderkey", "o_custkey")).alias("m")).select("m.*")


@query("src03_latest_per_day", f"{TR} SELECT date, max(track_id) AS track_id FROM tracks GROUP BY date")
def src03(spark, sf_dir):
    w = Window.partitionBy("date").orderBy(F.desc("track_id"))
    return analog.tracks(spark, sf_dir).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("date", "track_id")


@query("src04_horizon", f"{TR} SELECT min(date) AS first_day, max(date) AS last_day FROM tracks")
def src04(spark, sf_dir):
    return analog.tracks(spark, sf_dir).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("src05_tail_index", f"{TR} SELECT tail, count(*) AS n, list_sort(list(track_id)) AS track_ids FROM tracks GROUP BY tail")
def src05(spark, sf_dir):
    return analog.tracks(spark, sf_dir).groupBy("tail").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("track_id")).alias("track_ids"))


@query("src08_page", f"{TR} SELECT track_id, total FROM (SELECT track_id, count(*) OVER () AS total FROM tracks) ORDER BY track_id LIMIT 50 OFFSET 100")
def src08(spark, sf_dir):
    t = analog.tracks(spark, sf_dir).select("track_id")
    total = t.agg(F.count("*").alias("total"))
    return t.orderBy("track_id").offset(100).limit(50).crossJoin(F.broadcast(total))  # one row


@query("src12_complaints_by_tail", f"{CO} SELECT id, started FROM complaints WHERE tail = 7 ORDER BY started DESC, id DESC")
def src12(spark, sf_dir):
    return analog.complaints(spark, sf_dir).filter("tail = 7").orderBy(F.desc("started"), F.desc("id")).select("id", "started")


@query("src13_notifications", f"{NO} SELECT id, kind FROM notifications WHERE tail = 7 AND kind = 'pilot'")
def src13(spark, sf_dir):
    return find_notifications(analog.notifications(spark, sf_dir), tail=7, kind="pilot").select("id", "kind")


def find_notifications(rows, tail=None, kind=None):
    if tail is not None:
        rows = rows.filter(F.col("tail") == tail)
    return rows.filter(F.col("kind") == kind) if kind is not None else rows


_REPORT = "CASE WHEN doc_id % 3 = 0 THEN '{\"reporter\": \"' || source || '\"}' ELSE '{\"reporter\": {\"name\": \"' || lang || '\", \"email\": \"' || source || '\"}}' END"


def reports(spark, sf_dir):
    """Documents as reports whose reporter is a string or an object."""
    d = T(spark, sf_dir, "documents")
    plain = F.format_string('{"reporter": "%s"}', "source")
    nested = F.format_string('{"reporter": {"name": "%s", "email": "%s"}}', "lang", "source")
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, plain).otherwise(nested).alias("raw"))


@query("src14_reports_by_reporter", "SELECT doc_id FROM documents WHERE source = 'src3'")
def src14(spark, sf_dir):
    v = reports(spark, sf_dir).withColumn("v", F.parse_json("raw"))
    get = lambda path: F.try_variant_get("v", path, "string")
    who = F.array(get("$.reporter"), get("$.reporter.email"), get("$.reporter.id"), get("$.reporter.name"))
    return v.filter(F.array_contains(F.filter(who, lambda x: x.isNotNull()), "src3")).select("doc_id")


@query("snk01_insert_if_absent", f"{TR} SELECT src FROM tracks WHERE track_id % 5 <> 0 UNION ALL SELECT src FROM tracks WHERE track_id % 5 = 0")
def snk01(spark, sf_dir):
    t = analog.tracks(spark, sf_dir).select("track_id", "src")
    existing, incoming = t.filter("track_id % 5 <> 0"), t.filter("track_id % 2 = 0 or track_id % 5 = 0")
    return existing.select("src").unionAll(incoming.join(existing, "src", "left_anti").select("src"))


@query("snk04_scoped_recompute", f"{TR} SELECT track_id, round(len_red_ft / 1000, 3) AS impact FROM tracks WHERE date >= (SELECT max(date) FROM tracks) - INTERVAL 30 DAY")
def snk04(spark, sf_dir):
    t = analog.tracks(spark, sf_dir)
    last = t.agg(F.max("date").alias("last"))
    return t.crossJoin(F.broadcast(last)).filter(F.col("date") >= F.date_sub("last", 30)).select("track_id", F.round(F.col("len_red_ft") / 1000, 3).alias("impact"))


@query("snk06_upsert", f"{NO} SELECT tail, kind, max(id) AS id FROM notifications GROUP BY 1, 2")
def snk06(spark, sf_dir):
    w = Window.partitionBy("tail", "kind").orderBy(F.desc("id"))
    return analog.notifications(spark, sf_dir).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("tail", "kind", "id")


@query("snk09_summary", f"{TR} SELECT count(*) AS n, count(*) FILTER (worst = 3) AS red, count(DISTINCT year) AS years FROM tracks")
def snk09(spark, sf_dir):
    return analog.tracks(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("worst") == 3).alias("red"), F.countDistinct("year").alias("years"))


# --- joins -------------------------------------------------------------------------------------------


def flown(spark, sf_dir):
    return analog.tracks(spark, sf_dir).join(analog.aircraft(spark, sf_dir), "tail", "left")


@query("joi01_school_by_tail", f"{TA} SELECT track_id, school FROM tracks LEFT JOIN aircraft USING (tail)")
def joi01(spark, sf_dir):
    return flown(spark, sf_dir).select("track_id", "school")


@query("joi02_special_use", f"{AC} SELECT tail, CASE WHEN tail % 11 = 0 THEN 'fire' END AS special FROM aircraft")
def joi02(spark, sf_dir):
    a = analog.aircraft(spark, sf_dir)
    registry = a.filter("tail % 11 = 0").select("tail", F.lit("fire").alias("special"))
    return a.join(registry, "tail", "left").select("tail", "special")


for _how, _kind in (("left", "LEFT"), ("inner", "INNER")):

    @query(f"joi03_fleet_{_how}", f"{with_sql('fixes', 'aircraft')} SELECT hex, type, count(*) AS n FROM fixes {_kind} JOIN (SELECT * FROM aircraft WHERE tail % 2 = 0) a ON hex = tail GROUP BY 1, 2")
    def joi03(spark, sf_dir, how=_how):
        fleet = analog.aircraft(spark, sf_dir).filter("tail % 2 = 0").withColumnRenamed("tail", "hex")
        return analog.fixes(spark, sf_dir).groupBy("hex").agg(F.count("*").alias("n")).join(fleet, "hex", how).select("hex", "type", "n")


_LATEST = f"{TA}, lt AS (SELECT tail, arg_max(school, track_id) FILTER (school IS NOT NULL) AS school, arg_max(rand_key, date_part('epoch', date) * 1e7 + track_id) FILTER (worst > 0) AS rand_key FROM tracks LEFT JOIN aircraft USING (tail) GROUP BY tail)"


@query("agg05_latest_non_null", f"{_LATEST} SELECT * FROM lt")
def agg05(spark, sf_dir):
    rows = flown(spark, sf_dir).withColumn("rand_key", F.when(F.col("worst") > 0, F.col("rand_key")))
    return joins.latest_non_null(rows, "tail", ["school", "rand_key"], ["date", "track_id"])


@query("joi04_live_attributes", f"{_LATEST.replace('WITH ', 'WITH ' + analog.WITH['fixes'] + ', ', 1)} SELECT hex, n, school FROM (SELECT hex, count(*) AS n FROM fixes GROUP BY hex) LEFT JOIN lt ON hex = tail")
def joi04(spark, sf_dir):
    live = analog.fixes(spark, sf_dir).groupBy("hex").agg(F.count("*").alias("n"))
    latest = agg05(spark, sf_dir).select(F.col("tail").alias("hex"), "school")
    return live.join(latest, "hex", "left").select("hex", "n", "school")


@query("joi05_history_and_live", f"{with_sql('fixes', 'tracks')} SELECT coalesce(a.tail, b.hex) AS tail, coalesce(h, 0) + coalesce(l, 0) AS total FROM (SELECT tail, count(*) AS h FROM tracks GROUP BY 1) a FULL JOIN (SELECT hex, count(*) AS l FROM fixes GROUP BY 1) b ON a.tail = b.hex")
def joi05(spark, sf_dir):
    h = analog.tracks(spark, sf_dir).groupBy("tail").agg(F.count("*").alias("n"))
    live = analog.fixes(spark, sf_dir).groupBy(F.col("hex").alias("tail")).agg(F.count("*").alias("n"))
    return h.unionByName(live).groupBy("tail").agg(F.sum("n").alias("total"))


@query("joi06_complaint_counts", f"{CO} SELECT hex, n, coalesce(c, 0) AS complaints FROM (SELECT hex, count(*) AS n FROM fixes GROUP BY 1) LEFT JOIN (SELECT tail, count(*) AS c FROM complaints WHERE started >= 500000 GROUP BY 1) ON hex = tail")
def joi06(spark, sf_dir):
    c = analog.complaints(spark, sf_dir).filter("started >= 500000").groupBy(F.col("tail").alias("hex")).agg(F.count("*").alias("complaints"))
    return analog.fixes(spark, sf_dir).groupBy("hex").agg(F.count("*").alias("n")).join(c, "hex", "left").fillna(0, ["complaints"])


STATE = """st AS (SELECT tail, max("at" * 1000000 + id) FILTER (kind = 'operator') AS op, max("at" * 1000000 + id) FILTER (kind = 'pilot') AS pilot, bool_or(action = 'acknowledged') AS acknowledged,
  max(CASE action WHEN 'seen' THEN 1 WHEN 'acknowledged' THEN 2 WHEN 'resolved' THEN 3 ELSE 0 END) AS step FROM notifications GROUP BY tail)"""


def notification_state(rows):
    """Per tail: latest operator and pilot event, folded flags, and the most advanced step with its last time."""
    step = F.when(F.col("action") == "seen", 1).when(F.col("action") == "acknowledged", 2).when(F.col("action") == "resolved", 3).otherwise(0)
    place = F.struct("at", "id")
    latest = lambda kind: F.max(F.when(F.col("kind") == kind, place))
    stamp = lambda c: c["at"] * 1000000 + c["id"]
    return rows.withColumn("step", step).groupBy("tail").agg(
        stamp(latest("operator")).alias("op"), stamp(latest("pilot")).alias("pilot"), F.bool_or(F.col("action") == "acknowledged").alias("acknowledged"), F.max("step").alias("step")
    )


@query("agg18_notification_state", f"{NO}, {STATE} SELECT * FROM st")
def agg18(spark, sf_dir):
    return notification_state(analog.notifications(spark, sf_dir))


@query("joi07_with_notifications", f"{NO}, {STATE} SELECT hex, step FROM (SELECT DISTINCT hex FROM fixes) LEFT JOIN st ON hex = tail")
def joi07(spark, sf_dir):
    s = notification_state(analog.notifications(spark, sf_dir)).select(F.col("tail").alias("hex"), "step")
    return analog.fixes(spark, sf_dir).select("hex").distinct().join(s, "hex", "left")


@query("joi08_interval_overlap", f"{with_sql('complaints')}, {CYCLES} SELECT id, flight_id FROM complaints JOIN cyc ON tail = hex AND coalesce(ended, started) >= takeoff_ts - 20 AND started <= coalesce(landing_ts, takeoff_ts) + 20")
def joi08(spark, sf_dir):
    c = analog.complaints(spark, sf_dir).withColumnRenamed("tail", "hex")
    return joins.overlapping(c, flights(spark, sf_dir), "hex", 20).select("id", "flight_id")


@query("joi09_nearest_neighbour", f"{FX}, p AS (SELECT a.seq, b.seq AS o, {_NM('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS nm FROM fixes a JOIN fixes b ON a.hex <> b.hex AND a.hex % 2 = 0 AND b.hex % 2 = 1 AND abs(a.t_ms - b.t_ms) <= 900 AND abs(a.alt - b.alt) <= 500) SELECT seq, arg_min(o, nm + o * 1e-13) AS other, round(min(nm), 6) AS nm FROM p WHERE nm <= 0.6 GROUP BY seq")
def joi09(spark, sf_dir):
    f = analog.fixes(spark, sf_dir)
    n = joins.neighbours(f.filter("hex % 2 = 0"), f.filter("hex % 2 = 1"), 0.6, 500.0, 900.0)
    return n.withColumn("nm", F.round("nm", 6))


@query("joi10_nearest_airport", f"{FA}, p AS (SELECT seq, code, {_NM('f.lat', 'f.lon', 'a.lat', 'a.lon')} AS nm FROM fixes f CROSS JOIN airports a) SELECT f.seq, site, nm FROM fixes f LEFT JOIN (SELECT seq, arg_min(code, nm) AS site, round(min(nm), 6) AS nm FROM p WHERE nm <= 1.5 GROUP BY seq) USING (seq)")
def joi10(spark, sf_dir):
    f = joins.nearest_site(analog.fixes(spark, sf_dir), analog.airports(spark, sf_dir), 1.5)
    return f.select("seq", "site", F.round("site_nm", 6).alias("nm"))


@query("joi11_nearest_zone", f"{CLASSED} SELECT seq, zone, inside FROM signed")
def joi11(spark, sf_dir):
    from .scalars import nearest_zone

    c = classified(spark, sf_dir)
    return c.select("seq", nearest_zone(F.col("lat"), F.col("lon")).alias("zone"), (F.col("zone_ft") < 0).alias("inside"))


@query("joi13_as_of_landing", f"{FX}, {CYCLES} SELECT flight_id, arg_max(f.seq, f.t_ms * 1000000 + f.seq) AS last_seq FROM cyc JOIN fixes f ON f.hex = cyc.hex AND f.t_ms <= landing_ts GROUP BY 1")
def joi13(spark, sf_dir):
    landed = flights(spark, sf_dir).filter("landing_ts is not null").select("hex", "flight_id", "landing_ts")
    return joins.as_of(landed, analog.fixes(spark, sf_dir), "hex", "landing_ts", "t_ms", ["seq"]).select("flight_id", F.col("r_seq").alias("last_seq"))


@query("joi14_range_join", f"{FX}, {CYCLES} SELECT flight_id, count(*) AS n, max(alt) AS top FROM cyc JOIN fixes f ON f.hex = cyc.hex AND f.t_ms BETWEEN takeoff_ts AND landing_ts GROUP BY 1")
def joi14(spark, sf_dir):
    c = flights(spark, sf_dir).select("hex", "flight_id", "takeoff_ts", "landing_ts")
    f = analog.fixes(spark, sf_dir).select("hex", "t_ms", "alt")
    return c.join(f, "hex").filter("t_ms between takeoff_ts and landing_ts").groupBy("flight_id").agg(F.count("*").alias("n"), F.max("alt").alias("top"))


@query("joi15_flight_at", f"{CO}, {CYCLES}, g AS (SELECT id, island, CASE WHEN started BETWEEN takeoff_ts AND coalesce(landing_ts, takeoff_ts) THEN 0 ELSE least(abs(started - takeoff_ts), abs(started - coalesce(landing_ts, takeoff_ts))) END AS gap FROM complaints JOIN cyc ON tail = hex) SELECT id, min(gap) AS gap, arg_min(island, gap * 100000 + island) AS island FROM g GROUP BY id")
def joi15(spark, sf_dir):
    c = analog.complaints(spark, sf_dir).select("id", F.col("tail").alias("hex"), "started")
    end = F.coalesce("landing_ts", "takeoff_ts")
    j = c.join(flights(spark, sf_dir), "hex").withColumn("gap", F.when(F.col("started").between(F.col("takeoff_ts"), end), 0).otherwise(F.least(F.abs(F.col("started") - F.col("takeoff_ts")), F.abs(F.col("started") - end))))
    return j.groupBy("id").agg(F.min("gap").alias("gap"), F.min(F.struct("gap", "island"))["island"].alias("island"))


@query("joi16_fallback_chain", f"{with_sql('complaints', 'aircraft')} SELECT id, coalesce(base, CASE WHEN lat > {LAT0} THEN 'north' ELSE 'south' END) AS place FROM complaints LEFT JOIN (SELECT * FROM aircraft WHERE origin = 'local') a USING (tail)")
def joi16(spark, sf_dir):
    a = analog.aircraft(spark, sf_dir).filter("origin = 'local'").select("tail", "base")
    c = analog.complaints(spark, sf_dir).join(a, "tail", "left")
    return c.select("id", F.coalesce("base", F.when(F.col("lat") > LAT0, "north").otherwise("south")).alias("place"))


@query("joi17_seeded_trail", f"{FX}, s AS (SELECT hex, min(t_ms) AS t0 FROM fixes WHERE t_ms >= 1000000 GROUP BY hex) SELECT seq FROM fixes WHERE t_ms >= 1000000 UNION ALL SELECT seq FROM fixes JOIN s USING (hex) WHERE t_ms < t0 AND t_ms >= t0 - 50000")
def joi17(spark, sf_dir):
    f = analog.fixes(spark, sf_dir)
    live = f.filter("t_ms >= 1000000")
    begin = live.groupBy("hex").agg(F.min("t_ms").alias("t0"))
    seed = f.join(begin, "hex").filter("t_ms < t0 and t_ms >= t0 - 50000")
    return live.select("seq").unionByName(seed.select("seq"))


@query("joi18_anti", f"{TA} SELECT tail FROM aircraft WHERE tail NOT IN (SELECT tail FROM tracks WHERE year = 1997)")
def joi18(spark, sf_dir):
    return analog.aircraft(spark, sf_dir).join(analog.tracks(spark, sf_dir).filter("year = 1997"), "tail", "left_anti").select("tail")


@query("joi19_semi", f"{CO} SELECT seq FROM fixes WHERE hex IN (SELECT tail FROM complaints WHERE score > 8)")
def joi19(spark, sf_dir):
    c = analog.complaints(spark, sf_dir).filter("score > 8").select(F.col("tail").alias("hex"))
    return analog.fixes(spark, sf_dir).join(c, "hex", "left_semi").select("seq")


_CENTROIDS = {n: (sum(a for a, _ in p) / len(p), sum(b for _, b in p) / len(p)) for n, p in analog.ZONES.items()}


@query("joi20_zone_by_centroid", f"{FX} SELECT seq, CASE WHEN {_NM('lat', 'lon', *map(str, _CENTROIDS['BDU North']))} <= {_NM('lat', 'lon', *map(str, _CENTROIDS['BDU West']))} THEN 'BDU North' ELSE 'BDU West' END AS zone FROM fixes")
def joi20(spark, sf_dir):
    each = F.array(*(F.struct(geo.planar_nm(F.col("lat"), F.col("lon"), *c).alias("nm"), F.lit(n).alias("zone")) for n, c in _CENTROIDS.items()))
    return analog.fixes(spark, sf_dir).select("seq", F.array_min(each)["zone"].alias("zone"))


# --- rollups -----------------------------------------------------------------------------------------

_CLASSES = ("total", "red", "orange", "yellow")
_SUM_SQL = ", ".join(f"sum(seg_{c}) AS seg_{c}, round(sum(len_{c}_ft), 2) AS len_{c}_ft" for c in _CLASSES)


def class_sums():
    out = []
    for c in _CLASSES:
        out += [F.sum(f"seg_{c}").alias(f"seg_{c}"), F.round(F.sum(f"len_{c}_ft"), 2).alias(f"len_{c}_ft")]
    return out


@query("agg01_excursion_rollup", f"{TA} SELECT tail, school, base, origin, type, {_SUM_SQL}, max(worst) AS worst, count(*) AS n FROM tracks LEFT JOIN aircraft USING (tail) GROUP BY 1, 2, 3, 4, 5 HAVING sum(seg_red) > 0 ORDER BY round(sum(seg_red) / sum(seg_total), 9) DESC, tail LIMIT 200")
def agg01(spark, sf_dir):
    g = flown(spark, sf_dir).groupBy("tail", "school", "base", "origin", "type").agg(*class_sums(), F.max("worst").alias("worst"), F.count("*").alias("n"))
    return g.filter("seg_red > 0").orderBy(F.desc(F.round(F.col("seg_red") / F.col("seg_total"), 9)), "tail").limit(200)


@query("agg02_cube", f"{TA} SELECT year, base, origin, count(*) AS n, round(sum(len_red_ft), 2) AS red_ft FROM tracks JOIN aircraft USING (tail) GROUP BY 1, 2, 3")
def agg02(spark, sf_dir):
    return flown(spark, sf_dir).filter("base is not null").groupBy("year", "base", "origin").agg(F.count("*").alias("n"), F.round(F.sum("len_red_ft"), 2).alias("red_ft"))


#: the filters in force; a facet heeds those of the other two dimensions only
_FACETS = {"year": ("year", "1995"), "base": ("base", "NATION_11"), "origin": ("origin", "local")}
_CELL = "count(*) AS n, count(*) FILTER (worst = 3) AS red"


def _facet_sql(name: str) -> str:
    others = " AND ".join(f"CAST({c} AS VARCHAR) = '{v}'" for n, (c, v) in _FACETS.items() if n != name)
    return f"SELECT '{name}' AS facet, CAST({name} AS VARCHAR) AS value, n, red FROM (SELECT {name}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(red) AS BIGINT) AS red FROM cube WHERE {others} GROUP BY 1)"


@query("agg02b_facets", f"{TA}, cube AS (SELECT year, base, origin, {_CELL} FROM tracks JOIN aircraft USING (tail) WHERE base IS NOT NULL GROUP BY 1, 2, 3), f AS ({' UNION ALL '.join(map(_facet_sql, _FACETS))}) SELECT facet, value, n, round(red / n * 100, 4) AS red_pct, round(red / n * 100, 4) = max(round(red / n * 100, 4)) OVER (PARTITION BY facet) AS top FROM f")
def agg02b(spark, sf_dir):
    """Totals of each dimension under the other two filters, in one pass over the cube."""
    cube = flown(spark, sf_dir).filter("base is not null").groupBy("year", "base", "origin").agg(F.count("*").alias("n"), F.count_if(F.col("worst") == 3).alias("red"))
    holds = {n: F.col(c).cast("string") == v for n, (c, v) in _FACETS.items()}
    facet = lambda n: F.when(functools.reduce(lambda a, b: a & b, (h for m, h in holds.items() if m != n)), F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")))
    cells = cube.select(F.explode(F.array_compact(F.array(*map(facet, _FACETS)))).alias("f"), "n", "red").groupBy("f.facet", "f.value").agg(F.sum("n").alias("n"), F.sum("red").alias("red"))
    cells = cells.select("facet", "value", "n", F.round(F.col("red") / F.col("n") * 100, 4).alias("red_pct"))
    return cells.withColumn("top", F.col("red_pct") == F.max("red_pct").over(Window.partitionBy("facet")))  # a few values a facet


@query("agg03_by_date", f"{TR} SELECT date, count(*) AS n, round(sum(len_red_ft) / nullif(sum(len_total_ft), 0) * 100, 4) AS red_pct FROM tracks GROUP BY date")
def agg03(spark, sf_dir):
    return analog.tracks(spark, sf_dir).groupBy("date").agg(F.count("*").alias("n"), F.round(F.try_divide(F.sum("len_red_ft"), F.sum("len_total_ft")) * 100, 4).alias("red_pct"))


@query("agg04_facet_values", f"{TA} SELECT 'year' AS facet, CAST(year AS VARCHAR) AS value FROM tracks UNION SELECT 'base', base FROM aircraft WHERE base IS NOT NULL UNION SELECT 'school', school FROM aircraft WHERE school IS NOT NULL UNION SELECT 'purpose', purpose FROM aircraft WHERE purpose IS NOT NULL")
def agg04(spark, sf_dir):
    a = analog.aircraft(spark, sf_dir)
    parts = [analog.tracks(spark, sf_dir).select(F.lit("year").alias("facet"), F.col("year").cast("string").alias("value"))]
    parts += [a.select(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("base", "school", "purpose")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("value is not null").distinct().orderBy("facet", "value")


def score_board(sums, power: float = 1.0):
    """Scores of rows of flights, lengths by class (total, red, orange, yellow) and population impact (null if unknown).

    A score is flights ** power, times the clean share of the length, over 1 + the impact index: population impact for
    each foot over 1000, or 12 times the weighted excursions for each mile where the population is not known.
    """
    c, total = F.col, F.nullif(F.col("total"), F.lit(0.0))
    rate = F.coalesce((c("red") + c("orange") + c("yellow")) / total, F.lit(0.0))
    weighted = F.coalesce((3 * c("red") + 2 * c("orange") + c("yellow")) / total, F.lit(0.0))
    index = F.coalesce(c("pop") / (total * geo.FT_PER_NM) / 1000, 12 * weighted)
    out = sums.withColumns({"exc": rate, "index": index})
    return out.withColumn("score", F.pow("flights", F.lit(power)) * (1 - F.least(F.lit(1.0), c("exc"))) / (1 + c("index")))


def leaderboard(rows, key: str):
    """Per key: flights, nautical miles by class, population impact and the good-neighbour score."""
    nm = lambda c: F.sum(f"len_{c}_ft") / geo.FT_PER_NM
    return score_board(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("flights"), *(nm(c).alias(c) for c in _CLASSES), F.sum("pop_impact").alias("pop")))


_SCORED_SQL = """b AS (SELECT *, CASE WHEN total > 0 THEN (red + orange + yellow) / total ELSE 0 END AS exc,
  CASE WHEN pop IS NOT NULL AND total > 0 THEN pop / (total * 6076.12) / 1000 WHEN total > 0 THEN 12 * (3 * red + 2 * orange + yellow) / total ELSE 0 END AS idx FROM g)"""


def _board_sql(key: str) -> str:
    return f"""{TA}, g AS (SELECT {key} AS k, count(*) AS flights, sum(len_total_ft) / 6076.12 AS total, sum(len_red_ft) / 6076.12 AS red, sum(len_orange_ft) / 6076.12 AS orange, sum(len_yellow_ft) / 6076.12 AS yellow, sum(pop_impact) AS pop
  FROM tracks LEFT JOIN aircraft USING (tail) WHERE {key} IS NOT NULL GROUP BY 1),
{_SCORED_SQL},
board AS (SELECT k, flights, total, red, exc, idx, flights * (1 - least(1.0, exc)) / (1 + idx) AS score FROM b)"""


for _key in ("base", "school", "tail"):

    @query(f"agg06_leaderboard_{_key}", f"{_board_sql(_key)} SELECT k, flights, round(total, 3) AS total, round(red, 3) AS red, round(exc, 6) AS exc FROM board")
    def agg06(spark, sf_dir, key=_key):
        b = leaderboard(flown(spark, sf_dir), key)
        return b.select(F.col(key).alias("k"), "flights", F.round("total", 3).alias("total"), F.round("red", 3).alias("red"), F.round("exc", 6).alias("exc"))


@query("agg07_good_neighbour", f"{_board_sql('base')} SELECT k, round(score, 5) AS score FROM board")
def agg07(spark, sf_dir):
    return leaderboard(flown(spark, sf_dir), "base").select(F.col("base").alias("k"), F.round("score", 5).alias("score"))


@query("agg09_relative_rank", f"{_board_sql('base')} SELECT k, round(score / max(score) OVER () * 100, 4) AS pct, row_number() OVER (ORDER BY round(score, 9) DESC, k) AS place FROM board")
def agg09(spark, sf_dir):
    b = leaderboard(flown(spark, sf_dir), "base").select(F.col("base").alias("k"), "score")
    every = Window.partitionBy()  # one row per base
    return b.select("k", F.round(F.col("score") / F.max("score").over(every) * 100, 4).alias("pct"), F.row_number().over(every.orderBy(F.desc(F.round("score", 9)), "k")).alias("place"))


@query("agg12_missions_by_purpose", f"{with_sql('fixes', 'aircraft')}, {CYCLES}, f AS (SELECT coalesce(nullif(purpose, 'unknown'), {PURPOSE_SQL}) AS purpose, hex, count(*) AS n FROM cyc JOIN aircraft ON hex = tail GROUP BY 1, 2) SELECT purpose, CAST(sum(n) AS BIGINT) AS flights, count(*) AS aircraft, max(n) AS busiest FROM f GROUP BY 1")
def agg12(spark, sf_dir):
    a = analog.aircraft(spark, sf_dir).select(F.col("tail").alias("hex"), scoring.resolve_purpose(F.col("purpose"), scoring.classify_purpose(F.col("type"), F.col("school"))).alias("purpose"))
    per = flights(spark, sf_dir).join(a, "hex").groupBy("purpose", "hex").agg(F.count("*").alias("n"))
    return per.groupBy("purpose").agg(F.sum("n").alias("flights"), F.count("*").alias("aircraft"), F.max("n").alias("busiest")).orderBy(F.desc("flights"), "purpose")


for _compat in (False, True):
    _worst = "max(CASE worst WHEN 1 THEN 'yellow' WHEN 2 THEN 'orange' WHEN 3 THEN 'red' END)" if _compat else "max(worst)"

    @query(f"agg13_active_summary{'_lexical' if _compat else ''}", f"{TR} SELECT tail, {_SUM_SQL}, {_worst} AS worst FROM tracks GROUP BY tail")
    def agg13(spark, sf_dir, compat=_compat):
        worst = F.max(geo.severity_class(F.col("worst"))) if compat else F.max("worst")
        return analog.tracks(spark, sf_dir).groupBy("tail").agg(*class_sums(), worst.alias("worst"))


@query("agg17_complaint_stats", f"{CO} SELECT tail, count(*) AS n, max(score) AS top, round(avg(score), 6) AS mean FROM complaints GROUP BY tail")
def agg17(spark, sf_dir):
    return analog.complaints(spark, sf_dir).groupBy("tail").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.round(F.avg("score"), 6).alias("mean"))


@query("agg25_base_inference", f"{FA}, p AS (SELECT hex, name, count(*) AS n FROM (SELECT f.hex, f.seq, arg_min(a.name, {_NM('f.lat', 'f.lon', 'a.lat', 'a.lon')}) AS name FROM fixes f CROSS JOIN airports a GROUP BY 1, 2) GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY n DESC, name) AS rn, sum(n) OVER (PARTITION BY hex) AS t FROM p) SELECT hex, string_agg(name, '+' ORDER BY rn) AS bases FROM q WHERE rn <= 3 AND n >= 0.05 * t GROUP BY hex")
def agg25(spark, sf_dir):
    f = joins.nearest_site(analog.fixes(spark, sf_dir), analog.airports(spark, sf_dir), 30.0, cell_deg=1.0)
    names = analog.airports(spark, sf_dir).select(F.col("code").alias("site"), "name")
    n = f.join(F.broadcast(names), "site").groupBy("hex", "name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("hex")
    n = n.withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "name"))).withColumn("t", F.sum("n").over(w)).filter("rn <= 3 and n >= 0.05 * t")
    return n.groupBy("hex").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]), "+").alias("bases"))


@query("agg26_monthly_base", f"{TR}, m AS (SELECT tail, strftime(date, '%Y-%m') AS month, start_hour % 4 AS b, count(*) AS n FROM tracks GROUP BY 1, 2, 3), x AS (SELECT tail, month, arg_max(b, n * 10 - b) AS base FROM m GROUP BY 1, 2) SELECT tail, count(*) AS months, count(DISTINCT base) > 1 AS unstable FROM x GROUP BY tail")
def agg26(spark, sf_dir):
    t = analog.tracks(spark, sf_dir).withColumn("b", F.col("start_hour") % 4)
    m = t.groupBy("tail", F.date_format("date", "yyyy-MM").alias("month"), "b").agg(F.count("*").alias("n"))
    modal = m.groupBy("tail", "month").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("base"))
    return modal.groupBy("tail").agg(F.count("*").alias("months"), (F.countDistinct("base") > 1).alias("unstable"))


@query("agg27_year_over_year", f"{TR} SELECT year, count(*) AS n, count(*) FILTER (worst >= 2) AS orange_up, count(*) FILTER (worst >= 3) AS red_up, round(sum(len_red_ft) / sum(len_total_ft), 8) AS red_share FROM tracks GROUP BY year")
def agg27(spark, sf_dir):
    share = F.round(F.sum("len_red_ft") / F.sum("len_total_ft"), 8)
    return analog.tracks(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.col("worst") >= 2).alias("orange_up"), F.count_if(F.col("worst") >= 3).alias("red_up"), share.alias("red_share"))


@query("agg28_tail_panel", f"{TR} SELECT tail, sum(seg_total) AS segs, round(sum(seg_red) / sum(seg_total), 6) AS red_share, round(sum(len_red_ft) / 6076.12, 3) AS red_nm FROM tracks GROUP BY tail HAVING sum(seg_total) >= 12")
def agg28(spark, sf_dir):
    g = analog.tracks(spark, sf_dir).groupBy("tail").agg(F.sum("seg_total").alias("segs"), F.round(F.try_divide(F.sum("seg_red"), F.sum("seg_total")), 6).alias("red_share"), F.round(F.sum("len_red_ft") / 6076.12, 3).alias("red_nm"))
    return g.filter("segs >= 12")


@query("agg29_base_and_school", f"{TA} SELECT label, count(*) AS n FROM (SELECT unnest(CASE WHEN school IS NULL THEN [base] ELSE [base, school] END) AS label FROM tracks JOIN aircraft USING (tail)) GROUP BY label")
def agg29(spark, sf_dir):
    rows = flown(spark, sf_dir).filter("base is not null")
    return rows.select(F.explode(F.array_compact(F.array("base", "school"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("agg30_type_groups", f"{with_sql('complaints', 'aircraft')} SELECT type, max(started) AS latest, min(distance_mi) AS nearest, count(*) AS n, max(CASE klass WHEN 'red' THEN 3 WHEN 'orange' THEN 2 ELSE 1 END) AS worst FROM complaints JOIN aircraft USING (tail) GROUP BY type")
def agg30(spark, sf_dir):
    c = analog.complaints(spark, sf_dir).join(analog.aircraft(spark, sf_dir).select("tail", "type"), "tail")
    return c.groupBy("type").agg(F.max("started").alias("latest"), F.min("distance_mi").alias("nearest"), F.count("*").alias("n"), F.max(geo.class_severity(F.col("klass"))).alias("worst")).orderBy(F.desc("worst"), F.asc_nulls_last("nearest"))


_TIERS = ["city", "county", "state", "federal", "governor"]


@query("agg36_contacts", """WITH c AS (SELECT r_name AS area, unnest([{'tier': 0, 'name': n_name}, {'tier': 1, 'name': r_name}, {'tier': 2, 'name': 'senate ' || (n_nationkey % 3)}, {'tier': 3, 'name': 'house ' || (n_nationkey % 2)}]) AS x FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, unnest([{'tier': 3, 'name': 'senator a'}, {'tier': 3, 'name': 'senator b'}, {'tier': 4, 'name': 'governor'}]) FROM region),
d AS (SELECT DISTINCT area, x.tier AS tier, x.name AS name FROM c)
SELECT area, ['city', 'county', 'state', 'federal', 'governor'][tier + 1] AS tier, name, row_number() OVER (PARTITION BY area ORDER BY tier, name) AS place FROM d""")
def agg36(spark, sf_dir):
    """Contacts of an area's airports: those of each tier, then the shared ones, each once, in order of tier."""
    n, r = T(spark, sf_dir, "nation"), T(spark, sf_dir, "region")
    contact = lambda tier, name: F.struct(F.lit(_TIERS.index(tier)).alias("rank"), name.alias("name"))
    numbered = lambda word, k: F.concat(F.lit(word), (F.col("n_nationkey") % k).cast("string"))
    own = F.array(contact("city", F.col("n_name")), contact("county", F.col("r_name")), contact("state", numbered("senate ", 3)), contact("federal", numbered("house ", 2)))
    shared = F.array(*(contact(t, F.lit(x)) for t, x in (("federal", "senator a"), ("federal", "senator b"), ("governor", "governor"))))
    rows = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("r_name", F.explode(own).alias("c")).unionAll(r.select("r_name", F.explode(shared).alias("c")))
    once = rows.select(F.col("r_name").alias("area"), "c.rank", "c.name").dropDuplicates()
    place = F.row_number().over(Window.partitionBy("area").orderBy("rank", "name"))  # a few contacts an area
    return once.select("area", F.get(F.array(*map(F.lit, _TIERS)), F.col("rank")).alias("tier"), "name", place.alias("place"))


# --- sorts, limits, set operations ---------------------------------------------------------------------


@query("srt01_multi_key", f"{_board_sql('tail')} SELECT k, flights FROM board ORDER BY round(score, 9) DESC, flights DESC, k LIMIT 25")
def srt01(spark, sf_dir):
    return leaderboard(flown(spark, sf_dir), "tail").orderBy(F.desc(F.round("score", 9)), F.desc("flights"), "tail").limit(25).select(F.col("tail").alias("k"), "flights")


@query("srt02_priority_page", f"{TR} SELECT track_id, worst FROM tracks ORDER BY CASE worst WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 2 END, rand_key, track_id LIMIT 100 OFFSET 200")
def srt02(spark, sf_dir):
    rank = F.when(F.col("worst") == 3, 0).when(F.col("worst") == 2, 1).otherwise(2)
    return analog.tracks(spark, sf_dir).orderBy(rank, "rand_key", "track_id").offset(200).limit(100).select("track_id", "worst")


@query("srt03_candidate_limit", f"{TR} SELECT track_id, score FROM (SELECT track_id, seg_red * 3 + seg_orange AS score, len_total_ft - len_red_ft AS clean FROM tracks ORDER BY round(len_total_ft - len_red_ft, 3) DESC, track_id LIMIT 500) ORDER BY score DESC, track_id LIMIT 50")
def srt03(spark, sf_dir):
    t = analog.tracks(spark, sf_dir).select("track_id", (F.col("seg_red") * 3 + F.col("seg_orange")).alias("score"), F.round(F.col("len_total_ft") - F.col("len_red_ft"), 3).alias("clean"))
    return t.orderBy(F.desc("clean"), "track_id").limit(500).orderBy(F.desc("score"), "track_id").limit(50).select("track_id", "score")


@query("srt04_top_per_group", f"{TR} SELECT tail, arg_max(track_id, seg_total * 10000000 + track_id) AS track_id FROM tracks GROUP BY tail")
def srt04(spark, sf_dir):
    return analog.tracks(spark, sf_dir).groupBy("tail").agg(F.max_by("track_id", F.struct("seg_total", "track_id")).alias("track_id"))


@query("srt05_nulls_last", f"{CO} SELECT id, distance_mi FROM complaints ORDER BY distance_mi ASC NULLS LAST, started DESC, id LIMIT 300")
def srt05(spark, sf_dir):
    return analog.complaints(spark, sf_dir).orderBy(F.asc_nulls_last("distance_mi"), F.desc("started"), "id").limit(300).select("id", "distance_mi")


@query("srt06_top_segments", f"{FX} SELECT hex, count(*) AS n FROM fixes GROUP BY hex ORDER BY n DESC, hex LIMIT 30")
def srt06(spark, sf_dir):
    return analog.fixes(spark, sf_dir).groupBy("hex").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hex").limit(30)


@query("srt07_decimation", f"{TR} SELECT track_id FROM (SELECT track_id, rand_key % 16 AS c FROM tracks) WHERE c < 4")
def srt07(spark, sf_dir):
    return analog.tracks(spark, sf_dir).filter(F.col("rand_key") % 16 < 4).select("track_id")


@query("srt08_stride_sample", f"{TR} SELECT track_id FROM (SELECT track_id, row_number() OVER (PARTITION BY year ORDER BY track_id) AS i, count(*) OVER (PARTITION BY year) AS n FROM tracks) WHERE floor(i * least(1.0, 40.0 / n) + 1e-9) > floor((i - 1) * least(1.0, 40.0 / n) + 1e-9)")
def srt08(spark, sf_dir):
    """Rows of a year are numbered in stretches of ids, and stretches by their counts, so that no task sorts a year."""
    t = analog.tracks(spark, sf_dir).select("track_id", "year").withColumn("part", F.floor(F.col("track_id") / 4096))
    parts = t.groupBy("year", "part").agg(F.count("*").alias("own"))
    year = Window.partitionBy("year")
    before = F.coalesce(F.sum("own").over(year.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("year", "part", before.alias("before"), F.sum("own").over(year).alias("n"))
    t = t.withColumn("i", F.row_number().over(Window.partitionBy("year", "part").orderBy("track_id"))).join(parts, ["year", "part"])
    i, share = F.col("i") + F.col("before"), F.least(F.lit(1.0), F.lit(40.0) / F.col("n"))
    return t.filter(F.floor(i * share + 1e-9) > F.floor((i - 1) * share + 1e-9)).select("track_id")


@query("srt09_hard_cap", f"{TR} SELECT track_id FROM tracks ORDER BY track_id LIMIT 1000")
def srt09(spark, sf_dir):
    return analog.tracks(spark, sf_dir).orderBy("track_id").limit(1000).select("track_id")


@query("set01_union_all", f"{with_sql('fixes', 'tracks')} SELECT tail, 'history' AS kind FROM tracks UNION ALL SELECT hex, 'live' FROM fixes")
def set01(spark, sf_dir):
    h = analog.tracks(spark, sf_dir).select("tail", F.lit("history").alias("kind"))
    return h.unionByName(analog.fixes(spark, sf_dir).select(F.col("hex").alias("tail"), F.lit("live").alias("kind")))


@query("set02_key_union", f"{with_sql('fixes', 'tracks')} SELECT tail FROM tracks UNION SELECT hex FROM fixes")
def set02(spark, sf_dir):
    return analog.tracks(spark, sf_dir).select("tail").union(analog.fixes(spark, sf_dir).select("hex")).distinct()


@query("set03_distinct_tails", f"{TR} SELECT DISTINCT tail FROM tracks")
def set03(spark, sf_dir):
    return analog.tracks(spark, sf_dir).select("tail").distinct()


@query("set04_difference", f"{TR} SELECT tail FROM aircraft_ids EXCEPT SELECT tail FROM tracks WHERE year = 1997".replace("aircraft_ids", "(SELECT c_custkey AS tail FROM customer)"))
def set04(spark, sf_dir):
    return T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tail")).subtract(analog.tracks(spark, sf_dir).filter("year = 1997").select("tail"))


@query("set05_day_union", f"{TR} SELECT track_id FROM tracks WHERE date IN (DATE '1996-01-01', DATE '1996-01-02', DATE '1996-01-03')")
def set05(spark, sf_dir):
    t = analog.tracks(spark, sf_dir)
    days = [t.filter(F.col("date") == d).select("track_id") for d in ("1996-01-01", "1996-01-02", "1996-01-03")]
    return days[0].unionByName(days[1]).unionByName(days[2])


@query("agg_distinct", f"{TR} SELECT count(DISTINCT tail) AS tails, count(DISTINCT year) AS years FROM tracks")
def agg_distinct(spark, sf_dir):
    return analog.tracks(spark, sf_dir).agg(F.countDistinct("tail").alias("tails"), F.countDistinct("year").alias("years"))
