"""Queries of the scalar functions, filters and projections (SCA, FLT, PRJ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scoring
from ..sources import analog
from ..sources.analog import GRID, GRID_COLS, GRID_ROWS, LAT0, LON0, ZONES, with_sql
from .registry import query

FX, TR, AC, CO = (with_sql(v) for v in ("fixes", "tracks", "aircraft", "complaints"))
_FT = lambda a, b, c, d: f"sqrt(pow(({c} - {a}) * 364560.0, 2) + pow(({d} - {b}) * 364560.0 * cos(radians(({a} + {c}) / 2)), 2))"
_NM = lambda a, b, c, d: f"sqrt(pow(({c} - {a}) * 60.0, 2) + pow(({d} - {b}) * 60.0 * cos(radians(({a} + {c}) / 2)), 2))"
HOME = (LAT0, LON0)


def _fixes(name: str, sql: str, columns):
    """A query of scalar expressions over all fixes, checked against the SQL of the same columns."""

    @query(name, f"{FX} SELECT seq, {sql} FROM fixes")
    def run(spark, sf_dir):
        return analog.fixes(spark, sf_dir).select("seq", *(c.alias(n) for n, c in columns().items()))

    return run


_fixes("sca01_planar_ft", f"round({_FT('lat', 'lon', LAT0, LON0)}, 4) AS ft", lambda: {"ft": F.round(geo.planar_ft(F.col("lat"), F.col("lon"), *HOME), 4)})
_fixes(
    "sca02_planar_nm",
    f"round({_NM('lat', 'lon', LAT0, LON0)}, 6) AS nm, round({_FT('lat', 'lon', LAT0, LON0)} / 6076.12, 6) AS nm_by_feet",
    lambda: {"nm": F.round(geo.planar_nm(F.col("lat"), F.col("lon"), *HOME), 6), "nm_by_feet": F.round(geo.feet_nm(F.col("lat"), F.col("lon"), *HOME), 6)},
)
_HAV = f"pow(sin(radians({LAT0} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({LAT0})) * pow(sin(radians({LON0} - lon) / 2), 2)"
_fixes(
    "sca03_haversine",
    f"round(2 * 6371000.0 * asin(least(1.0, sqrt({_HAV}))), 3) AS metres, round(2 * 3440.065 * asin(least(1.0, sqrt({_HAV}))), 6) AS nm",
    lambda: {"metres": F.round(geo.haversine(F.col("lat"), F.col("lon"), *HOME), 3), "nm": F.round(geo.haversine(F.col("lat"), F.col("lon"), *HOME, geo.EARTH_NM), 6)},
)
_fixes("sca04_spatial_ft", f"round(sqrt(pow({_FT('lat', 'lon', LAT0, LON0)}, 2) + pow(5288 - alt, 2)), 4) AS ft", lambda: {"ft": F.round(geo.spatial_ft(F.col("lat"), F.col("lon"), F.col("alt"), *HOME, 5288.0), 4)})
_fixes(
    "sca05_bearing",
    f"""round(degrees(atan2(({LON0} - lon) * cos(radians((lat + {LAT0}) / 2)), {LAT0} - lat)), 6) AS planar,
    round(mod_pos, 6) AS great_circle FROM (SELECT *, d - 360 * floor(d / 360) AS mod_pos FROM (SELECT *,
    degrees(atan2(sin(radians({LON0} - lon)) * cos(radians({LAT0})), cos(radians(lat)) * sin(radians({LAT0})) - sin(radians(lat)) * cos(radians({LAT0})) * cos(radians({LON0} - lon)))) AS d FROM fixes)) fixes --""",
    lambda: {"planar": F.round(geo.planar_bearing(F.col("lat"), F.col("lon"), *HOME), 6), "great_circle": F.round(geo.great_circle_bearing(F.col("lat"), F.col("lon"), *HOME), 6)},
)
_fixes("sca06_half_turn", "(alt - 7000 + 180) - 360 * floor((alt - 7000 + 180) / 360) - 180 AS turn", lambda: {"turn": F.round(geo.half_turn(F.col("alt") - 7000), 6)})
from .registry import ORACLE  # noqa: E402

ORACLE["sca06_half_turn"] = f"{FX} SELECT seq, round((alt - 7000 + 180) - 360 * floor((alt - 7000 + 180) / 360) - 180, 6) AS turn FROM fixes"


def segment_sql(lat: str, lon: str, a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    """DuckDB: distance in feet from a point to a segment."""
    k = f"(cos(radians(({lat} + {a_lat} + {b_lat}) / 3)) * 364560.0)"
    px, py = f"(({lon} - {a_lon}) * {k})", f"(({lat} - {a_lat}) * 364560.0)"
    dx, dy = f"(({b_lon} - {a_lon}) * {k})", f"(({b_lat} - {a_lat}) * 364560.0)"
    t = f"greatest(0.0, least(1.0, ({px} * {dx} + {py} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0)))"
    return f"sqrt(pow({px} - coalesce({t}, 0.0) * {dx}, 2) + pow({py} - coalesce({t}, 0.0) * {dy}, 2))"


_P = ZONES["BDU North"]
_fixes("sca07_point_segment", f"round({segment_sql('lat', 'lon', *(f'{v}::DOUBLE' for v in (*_P[0], *_P[1])))}, 4) AS ft", lambda: {"ft": F.round(geo.segment_ft(F.col("lat"), F.col("lon"), *_P[0], *_P[1]), 4)})
_fixes(
    "sca08_chord_degrees",
    f"round(abs(({_P[2][0]} - {_P[0][0]}) * ({_P[0][1]} - lon) - ({_P[0][0]} - lat) * ({_P[2][1]} - {_P[0][1]})) / sqrt(pow({_P[2][0]} - {_P[0][0]}, 2) + pow({_P[2][1]} - {_P[0][1]}, 2)), 9) AS deg",
    lambda: {"deg": F.round(geo.chord_degrees(F.col("lat"), F.col("lon"), *_P[0], *_P[2]), 9)},
)

#: zone distances and classes of every fix, by a join with the edges and two aggregates
CLASSED = f"""{with_sql('fixes', 'zone_edges')},
near AS (
  SELECT seq, zone, min({segment_sql('lat', 'lon', 'a_lat', 'a_lon', 'b_lat', 'b_lon')}) AS ft,
    sum(CASE WHEN (a_lat > lat) <> (b_lat > lat) AND lon < (lat - a_lat) * ((b_lon - a_lon) / nullif(b_lat - a_lat, 0)) + a_lon THEN 1 ELSE 0 END) % 2 = 1 AS inside
  FROM fixes CROSS JOIN zone_edges GROUP BY seq, zone),
signed AS (SELECT seq, CASE WHEN bool_or(inside) THEN -min(ft) ELSE min(ft) END AS ft, bool_or(inside) AS inside, arg_min(zone, ft) AS zone FROM near GROUP BY seq),
classed AS (
  SELECT f.*, s.ft AS zone_ft, s.inside, s.zone, zs, als, least(zs, als) AS sev
  FROM (SELECT f.seq, CASE WHEN s.ft < -500 THEN 3 WHEN s.ft < -250 THEN 2 WHEN s.ft < 250 THEN 1 ELSE 0 END AS zs,
          CASE WHEN alt IS NULL THEN 0 WHEN 7500 - alt > 500 THEN 3 WHEN 7500 - alt > 250 THEN 2 WHEN 7500 - alt > -250 THEN 1 ELSE 0 END AS als
        FROM fixes f JOIN signed s USING (seq)) c JOIN fixes f USING (seq) JOIN signed s USING (seq))"""
KLASS = lambda s: f"CASE {s} WHEN 1 THEN 'yellow' WHEN 2 THEN 'orange' WHEN 3 THEN 'red' WHEN 4 THEN 'purple' END"

_POLYGONS = list(ZONES.values())


def classified(spark, sf_dir):
    """fixes with zone_ft, zone and altitude severities and their lesser one, sev."""
    f = analog.fixes(spark, sf_dir).withColumn("zone_ft", geo.signed_zone_ft(F.col("lat"), F.col("lon"), _POLYGONS))
    f = f.withColumn("zs", geo.zone_severity(F.col("zone_ft"))).withColumn("als", geo.altitude_severity(F.col("alt")))
    return f.withColumn("sev", F.least("zs", "als"))


def nearest_zone(lat, lon):
    """Name of the zone with the nearest edge."""
    each = F.array(*(F.struct(geo.boundary_ft(lat, lon, p).alias("ft"), F.lit(n).alias("zone")) for n, p in ZONES.items()))
    return F.array_min(each)["zone"]


@query("sca09_point_in_polygon", f"{CLASSED} SELECT seq, inside FROM signed")
def sca09(spark, sf_dir):
    inside = F.lit(False)
    for p in _POLYGONS:
        inside = inside | geo.in_polygon(F.col("lat"), F.col("lon"), p)
    return analog.fixes(spark, sf_dir).select("seq", inside.alias("inside"))


@query("sca10_signed_distance", f"{CLASSED} SELECT seq, round(ft, 4) AS ft FROM signed")
def sca10(spark, sf_dir):
    return classified(spark, sf_dir).select("seq", F.round("zone_ft", 4).alias("ft"))


@query("sca11_zone_class", f"{CLASSED} SELECT seq, {KLASS('zs')} AS klass FROM classed")
def sca11(spark, sf_dir):
    return classified(spark, sf_dir).select("seq", geo.severity_class(F.col("zs")).alias("klass"))


@query("sca12_altitude_class", f"{CLASSED} SELECT seq, {KLASS('als')} AS klass FROM classed")
def sca12(spark, sf_dir):
    return classified(spark, sf_dir).select("seq", geo.severity_class(F.col("als")).alias("klass"))


@query("sca13_combined_class", f"{CLASSED} SELECT seq, {KLASS('sev')} AS klass FROM classed")
def sca13(spark, sf_dir):
    return classified(spark, sf_dir).select("seq", geo.severity_class(F.col("sev")).alias("klass"))


@query("sca15_severity_map", "SELECT track_id, worst_class, CASE worst_class WHEN 'yellow' THEN 1 WHEN 'orange' THEN 2 WHEN 'red' THEN 3 ELSE 0 END AS sev FROM (" + TR + f" SELECT track_id, {KLASS('worst')} AS worst_class FROM tracks)")
def sca15(spark, sf_dir):
    t = analog.tracks(spark, sf_dir).select("track_id", geo.severity_class(F.col("worst")).alias("worst_class"))
    return t.withColumn("sev", geo.class_severity(F.col("worst_class")))


def _case(column: str, values: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values.items()) + f" ELSE {default} END"


@query("sca16_horsepower", f"{AC} SELECT tail, CAST({_case('type', scoring.POWER, '180.0')} AS DOUBLE) AS hp, CAST({_case('type', scoring.CRUISE, '110.0')} AS DOUBLE) AS knots FROM aircraft")
def sca16(spark, sf_dir):
    return analog.aircraft(spark, sf_dir).select("tail", scoring.horsepower(F.col("type")).alias("hp"), scoring.cruise_knots(F.col("type")).alias("knots"))


@query("sca18_type_description", f"{AC} SELECT tail, {_case('type', scoring.DESCRIPTION, 'type')} AS description FROM aircraft")
def sca18(spark, sf_dir):
    return analog.aircraft(spark, sf_dir).select("tail", scoring.describe_type(F.col("type")).alias("description"))


PURPOSE_SQL = "CASE WHEN school IS NOT NULL THEN 'training' " + " ".join(f"WHEN regexp_matches(type, '{p}') THEN '{n}'" for p, n in scoring.PURPOSE_RULES) + " ELSE 'ga_single' END"


@query("sca19_purpose", f"{AC} SELECT tail, {PURPOSE_SQL} AS purpose FROM aircraft")
def sca19(spark, sf_dir):
    return analog.aircraft(spark, sf_dir).select("tail", scoring.classify_purpose(F.col("type"), F.col("school")).alias("purpose"))


@query("sca20_resolved_purpose", f"{AC} SELECT tail, coalesce(nullif(purpose, 'unknown'), {PURPOSE_SQL}) AS purpose FROM aircraft")
def sca20(spark, sf_dir):
    derived = scoring.classify_purpose(F.col("type"), F.col("school"))
    return analog.aircraft(spark, sf_dir).select("tail", scoring.resolve_purpose(F.col("purpose"), derived).alias("purpose"))


GRADE_SQL = lambda x: f"CASE WHEN {x} < 0.3 THEN 'A' WHEN {x} < 0.6 THEN 'B' WHEN {x} < 1.2 THEN 'C' WHEN {x} < 2.0 THEN 'D' WHEN {x} IS NOT NULL THEN 'F' END"
TIER_SQL = lambda x: f"CASE WHEN {x} >= 90 THEN 'Gold' WHEN {x} >= 75 THEN 'Silver' WHEN {x} >= 55 THEN 'Bronze' ELSE 'Rising' END"


@query("sca21_impact_grade", f"{TR} SELECT track_id, {GRADE_SQL('(len_red_ft * 3 / nullif(len_total_ft, 0))')} AS grade FROM tracks")
def sca21(spark, sf_dir):
    return analog.tracks(spark, sf_dir).select("track_id", scoring.impact_grade(F.col("len_red_ft") * 3 / F.nullif(F.col("len_total_ft"), F.lit(0.0))).alias("grade"))


@query("sca22_tier", f"{TR} SELECT track_id, {TIER_SQL('(rand_key % 101)')} AS tier FROM tracks")
def sca22(spark, sf_dir):
    return analog.tracks(spark, sf_dir).select("track_id", scoring.tier(F.col("rand_key") % 101).alias("tier"))


@query("sca23_load_score", f"{TR} SELECT track_id, CAST(floor(100 * exp(-greatest(0.0, len_red_ft) / 40000.0) + 0.5) AS INT) AS score FROM tracks")
def sca23(spark, sf_dir):
    return analog.tracks(spark, sf_dir).select("track_id", scoring.load_score(F.col("len_red_ft"), 40000.0).alias("score"))


_EVIDENCE = "(CASE media WHEN 'video' THEN 5 WHEN 'audio' THEN 3 ELSE 0 END + CASE id % 4 WHEN 3 THEN 5 WHEN 2 THEN 3 WHEN 1 THEN 1 ELSE 0 END)"


@query("sca24_evidence", f"{CO} SELECT id, {_EVIDENCE} AS score, CASE WHEN {_EVIDENCE} >= 9 THEN 'gold' WHEN {_EVIDENCE} >= 6 THEN 'silver' WHEN {_EVIDENCE} >= 3 THEN 'bronze' ELSE 'none' END AS tier FROM complaints")
def sca24(spark, sf_dir):
    score = scoring.evidence_score(F.col("media"), F.col("id") % 4)
    return analog.complaints(spark, sf_dir).select("id", score.alias("score"), scoring.evidence_tier(score).alias("tier"))


_FIB = ", ".join(f"({v}::DOUBLE)" for v in scoring.FIBONACCI_TENTHS)


@query("sca25_private_distance", f"{CO} SELECT id, (SELECT v FROM (VALUES {_FIB}) t(v) WHERE distance_mi IS NOT NULL ORDER BY round(abs(distance_mi - v), 9), v LIMIT 1) AS miles FROM complaints")
def sca25(spark, sf_dir):
    return analog.complaints(spark, sf_dir).select("id", scoring.private_distance(F.col("distance_mi")).alias("miles"))


_fixes(
    "sca28_altitude_band",
    "CASE WHEN alt < 6000 THEN '<6000' WHEN alt < 7000 THEN '6000-6999' WHEN alt < 8000 THEN '7000-7999' WHEN alt < 9000 THEN '8000-8999' ELSE '9000+' END AS band",
    lambda: {"band": scoring.density_altitude_band(F.col("alt"))},
)
_fixes("sca29_hour_bucket", "printf('%02d:00', CAST(floor(t_ms * 1000 / 3600000.0) AS BIGINT) % 24) AS hour", lambda: {"hour": scoring.hour_bucket(F.col("t_ms") * 1000)})
_fixes("sca30_ids", "concat_ws('-', hex, t_ms) AS flight_id", lambda: {"flight_id": F.concat_ws("-", "hex", "t_ms")})
_fixes("sca32_fade", "round(greatest(0.0, 1 - (t_ms % 5000) / 3600.0), 6) AS fade", lambda: {"fade": F.round(scoring.age_fade(F.col("t_ms") % 5000, 3600.0), 6)})
_HZQ = "((alt - 5100) * (alt - 5100))"
_fixes(
    "sca33_a_weighting",
    f"round(20 * log10((pow(12194.0, 2) * {_HZQ} * {_HZQ}) / (({_HZQ} + pow(20.6, 2)) * sqrt(({_HZQ} + pow(107.7, 2)) * ({_HZQ} + pow(737.9, 2))) * ({_HZQ} + pow(12194.0, 2)))) + 2.0, 6) AS db",
    lambda: {"db": F.round(scoring.a_weighting(F.col("alt") - 5100), 6)},
)
_fixes("sca34_spl", "round((-(alt / 200) + 94) * 1.5, 6) AS spl", lambda: {"spl": F.round(scoring.spl(-(F.col("alt") / 200)), 6)})
_fixes("sca36_palette", "CAST(floor(greatest(0.0, least(1.0, (alt - 5200) / 7000)) * 255) AS INT) AS colour", lambda: {"colour": scoring.palette_index((F.col("alt") - 5200) / 7000)})


@query("sca30b_rolling_id", f"{FX} SELECT seq, upper(right(printf('%x', list_reduce(list_prepend(0::BIGINT, list_transform(string_split(concat_ws('-', hex, t_ms), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)), 4)) AS short_id FROM fixes")
def sca30b(spark, sf_dir):
    return analog.fixes(spark, sf_dir).select("seq", scoring.rolling_id(F.concat_ws("-", "hex", "t_ms")).alias("short_id"))


_KEY = b"example key"
_PADDED = _KEY.ljust(64, b"\0")
_PAD = lambda x: f"unhex('{bytes(b ^ x for b in _PADDED).hex()}')"
_WEB = lambda x: f"rtrim(translate(to_base64({x}), '+/', '-_'), '=')"
_SIGNATURE = f"substr({_WEB(f'unhex(sha256({_PAD(0x5C)} || unhex(sha256({_PAD(0x36)} || encode(payload)))))')}, 1, 16)"


@query("sca31_signed_token", f"{CO}, pl AS (SELECT id, tail || '|' || started AS payload FROM complaints), tk AS (SELECT *, {_WEB('encode(payload)')} || '.' || {_SIGNATURE} AS token FROM pl) SELECT id, token, CASE WHEN id % 5 = 0 THEN NULL ELSE payload END AS verified FROM tk")
def sca31(spark, sf_dir):
    """Signed tokens of complaints, verified again; every fifth is tampered with and told."""
    c = analog.complaints(spark, sf_dir)
    token = scoring.signed_token(_KEY, F.concat_ws("|", "tail", "started"))
    rows = c.select("id", token.alias("token"))
    altered = F.when(F.col("id") % 5 == 0, F.concat(F.lit("x"), "token")).otherwise(F.col("token"))
    return rows.select("id", "token", scoring.verified_payload(_KEY, altered).alias("verified"))


@query("sca37_locality_airports", "SELECT c_custkey, list_sort(list_distinct(list_concat([n_name], CASE WHEN r_name = 'ASIA' THEN ['ASIA', n_name] ELSE [r_name] END))) AS airports FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def sca37(spark, sf_dir):
    c, n, r = (analog.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    county = F.when(F.col("r_name") == "ASIA", F.array(F.lit("ASIA"), "n_name")).otherwise(F.array("r_name"))
    return j.select("c_custkey", F.array_sort(F.array_distinct(F.concat(F.array("n_name"), county))).alias("airports"))


@query("sca38_icon", f"{AC} SELECT tail, coalesce(CASE WHEN tail = 7 THEN '/icons/seven.png' END, CASE type WHEN 'GLID' THEN '/icons/glider.png' WHEN 'EC30' THEN '/icons/rotor.png' END, '/icons/' || lower(type) || '.png') AS icon FROM aircraft")
def sca38(spark, sf_dir):
    own = scoring.lookup(F.col("tail").cast("string"), {"7": "/icons/seven.png"})
    kind = scoring.lookup(F.col("type"), {"GLID": "/icons/glider.png", "EC30": "/icons/rotor.png"})
    return analog.aircraft(spark, sf_dir).select("tail", F.coalesce(own, kind, F.concat(F.lit("/icons/"), F.lower("type"), F.lit(".png"))).alias("icon"))


_UP = f"(({GRID['lat_max']}::DOUBLE - lat) / ({GRID['lat_max']}::DOUBLE - {GRID['lat_min']}::DOUBLE))"
_ALONG = f"((lon - {GRID['lon_min']}::DOUBLE) / ({GRID['lon_max']}::DOUBLE - {GRID['lon_min']}::DOUBLE))"
CELL_SQL = {
    True: (f"CAST(floor({_UP} * {GRID_ROWS - 1} + 0.5) AS INT)", f"CAST(floor({_ALONG} * {GRID_COLS - 1} + 0.5) AS INT)"),
    False: (f"CAST(floor({_UP} * {GRID_ROWS}) AS INT)", f"CAST(floor({_ALONG} * {GRID_COLS}) AS INT)"),
}


def with_density(fixes, grid, nearest: bool, name: str = "density"):
    """fixes with the population density of their cell (0 where the grid has none)."""
    row, col = scoring.grid_cell(F.col("lat"), F.col("lon"), GRID, GRID_ROWS, GRID_COLS, nearest)
    cells = grid.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("density").alias(name))
    out = fixes.withColumn("_row", row).withColumn("_col", col).join(F.broadcast(cells), ["_row", "_col"], "left")  # the grid's size is fixed
    return out.withColumn(name, F.coalesce(name, F.lit(0.0))).drop("_row", "_col")


for _nearest in (True, False):

    @query(
        f"sca39_population_{'nearest' if _nearest else 'cell'}",
        f"{with_sql('fixes', 'pop_grid')} SELECT seq, coalesce(density, 0.0) AS density FROM fixes LEFT JOIN pop_grid ON pop_grid.row = {CELL_SQL[_nearest][0]} AND pop_grid.col = {CELL_SQL[_nearest][1]}",
    )
    def sca39(spark, sf_dir, nearest=_nearest):
        return with_density(analog.fixes(spark, sf_dir), analog.pop_grid(spark, sf_dir), nearest).select("seq", "density")


_N, _C = analog.TERRAIN_N, analog.TERRAIN_CELL
_R, _K = f"((lat - {LAT0}) / {_C} + {(_N - 1) / 2})", f"((lon - {LON0}) / {_C} + {(_N - 1) / 2})"


@query(
    "sca40_terrain",
    f"""{with_sql('fixes', 'terrain')}, g AS (SELECT seq, {_R} AS r, {_K} AS k FROM fixes)
SELECT seq, round(coalesce((1 - (r - floor(r))) * ((1 - (k - floor(k))) * a.elev_ft + (k - floor(k)) * b.elev_ft) + (r - floor(r)) * ((1 - (k - floor(k))) * c.elev_ft + (k - floor(k)) * d.elev_ft), 5300.0), 6) AS elev_ft
FROM g LEFT JOIN terrain a ON a.row = floor(r) AND a.col = floor(k) LEFT JOIN terrain b ON b.row = floor(r) AND b.col = floor(k) + 1
LEFT JOIN terrain c ON c.row = floor(r) + 1 AND c.col = floor(k) LEFT JOIN terrain d ON d.row = floor(r) + 1 AND d.col = floor(k) + 1""",
)
def sca40(spark, sf_dir):
    """Bilinear elevation from a lattice of fixed size; 5300 outside."""
    lattice = analog.terrain(spark, sf_dir).agg(F.map_from_entries(F.collect_list(F.struct(F.col("row") * _N + F.col("col"), "elev_ft"))).alias("lattice"))
    f = analog.fixes(spark, sf_dir).withColumn("r", (F.col("lat") - LAT0) / _C + (_N - 1) / 2).withColumn("k", (F.col("lon") - LON0) / _C + (_N - 1) / 2)
    f = f.crossJoin(F.broadcast(lattice))
    r0, k0 = F.floor("r"), F.floor("k")
    dr, dk = F.col("r") - r0, F.col("k") - k0
    inside = (r0 >= 0) & (k0 >= 0) & (r0 < _N - 1) & (k0 < _N - 1)
    at = lambda i, j: F.element_at("lattice", ((r0 + i) * _N + k0 + j).cast("int"))
    value = (1 - dr) * ((1 - dk) * at(0, 0) + dk * at(0, 1)) + dr * ((1 - dk) * at(1, 0) + dk * at(1, 1))
    return f.select("seq", F.round(F.when(inside, value).otherwise(5300.0), 6).alias("elev_ft"))


@query("sca41_ceiling", f"{CLASSED} SELECT seq, coalesce(CASE zone WHEN 'BDU North' THEN 8000 END, CASE split_part(zone, ' ', 1) WHEN 'BDU' THEN 7800 END, 7500) AS ceiling_ft FROM signed")
def sca41(spark, sf_dir):
    zone = nearest_zone(F.col("lat"), F.col("lon"))
    airport = scoring.lookup(scoring.first_word(zone), {"BDU": 7800})
    return analog.fixes(spark, sf_dir).select("seq", F.coalesce(scoring.lookup(zone, {"BDU North": 8000}), airport, F.lit(7500)).alias("ceiling_ft"))


@query("sca42_airport_code", f"{CLASSED} SELECT seq, split_part(zone, ' ', 1) AS airport FROM signed")
def sca42(spark, sf_dir):
    return analog.fixes(spark, sf_dir).select("seq", scoring.first_word(nearest_zone(F.col("lat"), F.col("lon"))).alias("airport"))


@query("sca43_tail", "SELECT c_custkey, coalesce(nullif(upper(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END)), ''), nullif(upper(trim(c_name)), '')) AS tail FROM customer")
def sca43(spark, sf_dir):
    registration = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment"))
    return analog.table(spark, sf_dir, "customer").select("c_custkey", scoring.tail_number(registration, F.col("c_name"), F.lit("x")).alias("tail"))


@query("flt01_filter_builder", f"{with_sql('tracks', 'aircraft')} SELECT track_id FROM tracks JOIN aircraft USING (tail) WHERE year = 1997 AND base IN ('NATION_2', 'NATION_7', 'NATION_11', 'NATION_19') AND school = 'MACHINERY' AND start_hour >= 6 AND start_hour < 20")
def flt01(spark, sf_dir):
    rows = analog.tracks(spark, sf_dir).join(analog.aircraft(spark, sf_dir), "tail")
    return rows.filter(track_filter(year=1997, bases=["NATION_2", "NATION_7", "NATION_11", "NATION_19"], school="MACHINERY", hours=(6, 20))).select("track_id")


def track_filter(year=None, bases=None, school=None, purpose=None, hours=None):
    """One predicate of the filters given; true without any."""
    parts = [F.lit(True)]
    if year is not None:
        parts.append(F.col("year") == year)
    if bases:
        parts.append(F.col("base").isin(bases))
    if school is not None:
        parts.append(F.col("school") == school)
    if purpose is not None:
        parts.append(F.col("purpose") == purpose)
    if hours is not None:
        parts.append(scoring.in_hours(F.col("start_hour"), *hours))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


@query("flt02_wrapped_hours", f"{TR} SELECT track_id FROM tracks WHERE start_hour >= 22 OR start_hour < 5")
def flt02(spark, sf_dir):
    return analog.tracks(spark, sf_dir).filter(scoring.in_hours(F.col("start_hour"), 22, 5)).select("track_id")


_fixes("flt03_local_hour", "CAST(floor((((t_ms - 25200) % 86400 + 86400) % 86400) / 3600.0) AS INT) AS hour", lambda: {"hour": scoring.local_hour(F.col("t_ms"))})


def _where(name: str, view: str, condition: str, predicate, key: str, source):
    @query(name, f"{with_sql(view)} SELECT {key} FROM {view} WHERE {condition}")
    def run(spark, sf_dir):
        return source(spark, sf_dir).filter(predicate()).select(key)

    return run


_where("flt04_violations_only", "tracks", "seg_red + seg_orange > 0", lambda: (F.col("seg_red") + F.col("seg_orange")) > 0, "track_id", analog.tracks)
_where("flt05_altitude_cap", "fixes", "alt < 7500", lambda: F.col("alt") < 7500, "seq", analog.fixes)
_where("flt06_radius", "fixes", f"pow((lat - {LAT0}) * 364560.0, 2) + pow((lon - {LON0}) * 364560.0 * cos(radians({LAT0})), 2) <= pow(4 * 6076.12, 2)", lambda: F.pow((F.col("lat") - LAT0) * 364560.0, 2) + F.pow((F.col("lon") - LON0) * 364560.0 * F.cos(F.radians(F.lit(LAT0))), 2) <= (4 * 6076.12) ** 2, "seq", analog.fixes)
_where("flt08_window", "fixes", "t_ms >= 86400 AND t_ms < 172800", lambda: (F.col("t_ms") >= 86400) & (F.col("t_ms") < 172800), "seq", analog.fixes)
_where("flt09_time_trim", "complaints", "started >= 500000 AND (ended IS NULL OR ended <= 2000000)", lambda: (F.col("started") >= 500000) & (F.col("ended").isNull() | (F.col("ended") <= 2000000)), "id", analog.complaints)
_where("flt15_complaints", "complaints", "coalesce(score, 0) >= 5 AND (distance_mi IS NULL OR distance_mi <= 3) AND media = 'video' AND started < 2000000", lambda: (F.coalesce("score", F.lit(0)) >= 5) & (F.col("distance_mi").isNull() | (F.col("distance_mi") <= 3)) & (F.col("media") == "video") & (F.col("started") < 2000000), "id", analog.complaints)
_where("flt18_silent_types", "aircraft", "NOT (type IN ('GLID') OR contains(lower(type), 'balloon'))", lambda: ~(F.col("type").isin("GLID") | F.lower("type").contains("balloon")), "tail", analog.aircraft)


@query("flt07_segment_in_radius", f"{FX} SELECT hex, bool_or({_NM('lat', 'lon', LAT0, LON0)} <= 1) AS near FROM fixes GROUP BY hex")
def flt07(spark, sf_dir):
    return analog.fixes(spark, sf_dir).groupBy("hex").agg(F.bool_or(geo.planar_nm(F.col("lat"), F.col("lon"), *HOME) <= 1).alias("near"))


@query("flt12_violators_in_ring", f"{CLASSED} SELECT hex, max(sev) >= 2 AS violator, sum(CASE WHEN {_NM('lat', 'lon', LAT0, LON0)} <= 2 THEN 1 ELSE 0 END) >= 2 AS in_ring FROM classed GROUP BY hex")
def flt12(spark, sf_dir):
    c = classified(spark, sf_dir)
    return c.groupBy("hex").agg((F.max("sev") >= 2).alias("violator"), (F.count_if(geo.planar_nm(F.col("lat"), F.col("lon"), *HOME) <= 2) >= 2).alias("in_ring"))


@query("flt13_relevance", f"{FX} SELECT hex, bool_or(near AND alt < 7000) OR arg_min(near, o) OR arg_max(near, o) AS relevant FROM (SELECT hex, alt, {_NM('lat', 'lon', LAT0, LON0)} <= 1.5 AS near, t_ms * 1000000 + seq AS o FROM fixes) GROUP BY hex")
def flt13(spark, sf_dir):
    f = analog.fixes(spark, sf_dir).withColumn("near", geo.planar_nm(F.col("lat"), F.col("lon"), *HOME) <= 1.5).withColumn("o", F.struct("t_ms", "seq"))
    return f.groupBy("hex").agg((F.bool_or(F.col("near") & (F.col("alt") < 7000)) | F.min_by("near", "o") | F.max_by("near", "o")).alias("relevant"))


@query("flt14_trail_pruning", f"{CLASSED}, m AS (SELECT max(t_ms) AS now FROM fixes) SELECT seq FROM classed, m WHERE now - t_ms < 10800 OR (sev > 0 AND now - t_ms < 86400)")
def flt14(spark, sf_dir):
    c = classified(spark, sf_dir)
    now = analog.fixes(spark, sf_dir).agg(F.max("t_ms").alias("now"))
    age = F.col("now") - F.col("t_ms")
    return c.crossJoin(F.broadcast(now)).filter((age < 10800) | ((F.col("sev") > 0) & (age < 86400))).select("seq")


@query("prj01_strip_columns", "SELECT c_custkey AS tail, c_name AS name FROM customer")
def prj01(spark, sf_dir):
    return analog.table(spark, sf_dir, "customer").drop("c_acctbal", "c_mktsegment", "c_nationkey").withColumnsRenamed({"c_custkey": "tail", "c_name": "name"})


@query("prj02_derive_from_src", f"{TR} SELECT track_id, CAST(substr(src, 8, 4) AS INT) AS src_year, strptime(substr(src, 8, 8), '%Y%m%d')::DATE AS src_date, CAST(epoch(strptime(substr(src, 8, 8), '%Y%m%d')) AS BIGINT) AS t0, 2001 - CAST(substr(src, 8, 4) AS INT) AS years_back FROM tracks")
def prj02(spark, sf_dir):
    part = F.regexp_extract("src", r"_(\d{8})_", 1)
    day = F.to_date(part, "yyyyMMdd")
    year = F.substring(part, 1, 4).cast("int")
    t = analog.tracks(spark, sf_dir)
    return t.select("track_id", year.alias("src_year"), day.alias("src_date"), F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long").__mul__(86400).alias("t0"), (2001 - year).alias("years_back"))
