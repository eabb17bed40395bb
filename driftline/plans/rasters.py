"""Queries of path geometry, rasters, population impact and the composite boards (GEO, RAS, CMP)."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import geo, scoring
from ..operators import paths, raster
from ..operators import sequences as seqs
from ..sources import analog
from ..sources.analog import FIELD_FT, GRID, GRID_COLS, GRID_ROWS, LAT0, LON0, with_sql
from .registry import query
from .relations import _SCORED_SQL, score_board
from .scalars import _ALONG, _FT, _NM, _UP, CELL_SQL, CLASSED, classified, nearest_zone, segment_sql, with_density
from .trajectories import CSEG, LAGS, MERGED, SEG, W, flights, runs_sql

FX = with_sql("fixes")
PG = with_sql("fixes", "pop_grid")
GS = with_sql("pop_grid")
def ROW():
    return (GRID["lat_max"] - F.col("lat")) / (GRID["lat_max"] - GRID["lat_min"]) * GRID_ROWS

def COL():
    return (F.col("lon") - GRID["lon_min"]) / (GRID["lon_max"] - GRID["lon_min"]) * GRID_COLS

ROW_SQL, COL_SQL = f"({_UP} * {GRID_ROWS})", f"({_ALONG} * {GRID_COLS})"


def grid(spark, sf_dir):
    return analog.pop_grid(spark, sf_dir).withColumnRenamed("density", "value")


# --- path geometry -------------------------------------------------------------------------------------


@query("geo01_thin")
def geo01(spark, sf_dir):
    return paths.thin(analog.fixes(spark, sf_dir), 0.02)


@query("geo02_thin_radial")
def geo02(spark, sf_dir):
    return paths.thin_radial(analog.fixes(spark, sf_dir), 0.02)


_NX = f"nx AS (SELECT *, lead(lat) OVER {W} AS n_lat, lead(lon) OVER {W} AS n_lon, lag(lat) OVER {W} AS p_lat FROM fixes)"


@query("geo03_chaikin", f"{FX}, {_NX} SELECT seq, part, round(CASE part WHEN 0 THEN lat ELSE lat + (n_lat - lat) * (part * 0.5 - 0.25) END, 8) AS lat FROM nx CROSS JOIN (VALUES (0), (1), (2)) p(part) WHERE CASE WHEN n_lat IS NULL THEN part = 0 WHEN p_lat IS NULL THEN true ELSE part > 0 END")
def geo03(spark, sf_dir):
    return paths.chaikin(analog.fixes(spark, sf_dir)).select("seq", "part", F.round("lat", 8).alias("lat"))


_CTL = f"ct AS (SELECT seq, i, i / 8.0::DOUBLE AS t, lat AS p1, lead(lat) OVER {W} AS p2, coalesce(lag(lat) OVER {W}, lat) AS p0, coalesce(lead(lat, 2) OVER {W}, lead(lat) OVER {W}) AS p3 FROM fixes)".replace("i, i / 8.0::DOUBLE AS t, ", "")
_CTL += ", cu AS (SELECT *, i / 8.0::DOUBLE AS t FROM ct CROSS JOIN range(8) r(i) WHERE p2 IS NOT NULL)"
_CARDINAL = "(2*t*t*t - 3*t*t + 1) * p1 + (t*t*t - 2*t*t + t) * ((p2 - p0) * {k}) + (-2*t*t*t + 3*t*t) * p2 + (t*t*t - t*t) * ((p3 - p1) * {k})"


@query("geo04_midpoint_bezier", f"{FX}, {_CTL} SELECT seq, CAST(i AS INT) AS i, round((1-t)*(1-t) * (p0+p1)/2 + 2*(1-t)*t*p1 + t*t * (p1+p2)/2, 8) AS lat FROM cu")
def geo04(spark, sf_dir):
    return paths.midpoint_bezier(analog.fixes(spark, sf_dir)).select("seq", "i", F.round("lat", 8).alias("lat"))


@query("geo05_cardinal", f"{FX}, {_CTL} SELECT seq, CAST(i AS INT) AS i, round({_CARDINAL.format(k=0.3)}, 8) AS lat FROM cu")
def geo05(spark, sf_dir):
    return paths.cardinal(analog.fixes(spark, sf_dir), 0.3).select("seq", "i", F.round("lat", 8).alias("lat"))


def _control(c: str) -> str:
    return f"{c} AS {c}1, lead({c}) OVER {W} AS {c}2, coalesce(lag({c}) OVER {W}, {c}) AS {c}0, coalesce(lead({c}, 2) OVER {W}, lead({c}) OVER {W}) AS {c}3"


def _knot(k: int) -> str:
    return f"sqrt(greatest(1e-9::DOUBLE, {_FT(f'lat{k}', f'lon{k}', f'lat{k + 1}', f'lon{k + 1}')}))"


def _mix(a: str, b: str, x: str, y: str) -> str:
    return f"((({b} - t) * {x} + (t - {a}) * {y}) / ({b} - {a}))"


_A = [_mix("t0", "t1", "lat0", "lat1"), _mix("t1", "t2", "lat1", "lat2"), _mix("t2", "t3", "lat2", "lat3")]
_CENTRIPETAL = _mix("t1", "t2", _mix("t0", "t2", _A[0], _A[1]), _mix("t1", "t3", _A[1], _A[2]))


@query(
    "geo06_catmull_rom",
    f"""{FX}, ct AS (SELECT seq, {_control('lat')}, {_control('lon')} FROM fixes), k AS (SELECT *, 0.0::DOUBLE AS t0, {_knot(0)} AS d1, {_knot(1)} AS d2, {_knot(2)} AS d3 FROM ct WHERE lat2 IS NOT NULL),
cu AS (SELECT *, d1 AS t1, d1 + d2 AS t2, d1 + d2 + d3 AS t3, d1 + i / 8.0::DOUBLE * d2 AS t FROM k CROSS JOIN range(8) r(i)) SELECT seq, CAST(i AS INT) AS i, round({_CENTRIPETAL} + 3.3e-9::DOUBLE, 5) AS lat FROM cu""",
)
def geo06(spark, sf_dir):
    lat = F.round(F.col("lat") + 3.3e-9, 5)  # many lie on the middle between two roundings
    return paths.catmull_rom(analog.fixes(spark, sf_dir)).select("seq", "i", lat.alias("lat"))


@query("geo07_thin_pipeline")
def geo07(spark, sf_dir):
    """Moving average, thinning, then curves through midpoints."""
    w = seqs.by().rowsBetween(-2, 2)
    f = analog.fixes(spark, sf_dir)
    smooth = f.withColumns({"lat": F.avg("lat").over(w), "lon": F.avg("lon").over(w)})
    thinned = paths.thin(smooth, 0.01).join(f.select("seq", "t_ms"), "seq")
    return paths.midpoint_bezier(thinned)


@query("geo08_ellipse_ring", f"{with_sql('airports')} SELECT code, CAST(i AS INT) AS step, round(lat + (2.0::DOUBLE * 1.5 * cos(i * 2 * pi() / 28) * cos(radians(30)) - 2.0::DOUBLE * sin(i * 2 * pi() / 28) * sin(radians(30))) / 60, 8) AS lat FROM airports CROSS JOIN range(28) r(i)")
def geo08(spark, sf_dir):
    return paths.ring(analog.airports(spark, sf_dir), 2.0, 1.5, 30.0).select("code", "step", F.round("lat", 8).alias("lat"))


@query("geo09_coarsen", f"{GS} SELECT CAST(floor(row / 4.0) AS INT) AS row, CAST(floor(col / 4.0) AS INT) AS col, round(sum(density) / 16, 6) AS value FROM pop_grid GROUP BY 1, 2")
def geo09(spark, sf_dir):
    return raster.coarsen(grid(spark, sf_dir), 4).withColumn("value", F.round("value", 6))


@query("geo10_mean_blur", f"{GS} SELECT a.row + i AS row, a.col + j AS col, round(sum(density) / 9, 6) AS value FROM pop_grid a CROSS JOIN (VALUES (-1), (0), (1)) x(i) CROSS JOIN (VALUES (-1), (0), (1)) y(j) WHERE a.row + i BETWEEN 0 AND {GRID_ROWS - 1} AND a.col + j BETWEEN 0 AND {GRID_COLS - 1} GROUP BY 1, 2")
def geo10(spark, sf_dir):
    return raster.mean_blur(grid(spark, sf_dir), GRID_ROWS, GRID_COLS).withColumn("value", F.round("value", 6))


_LEVEL = 930.5
_LEVELS = (908.5, 930.5)


@query(
    "geo11_marching_squares",
    f"""{GS}, q AS (SELECT a.row, a.col, a.density AS tl, b.density AS tr, c.density AS bl, d.density AS br FROM pop_grid a JOIN pop_grid b ON b.row = a.row AND b.col = a.col + 1
  JOIN pop_grid c ON c.row = a.row + 1 AND c.col = a.col JOIN pop_grid d ON d.row = a.row + 1 AND d.col = a.col + 1),
k AS (SELECT *, CASE WHEN tl >= {_LEVEL} THEN 8 ELSE 0 END + CASE WHEN tr >= {_LEVEL} THEN 4 ELSE 0 END + CASE WHEN br >= {_LEVEL} THEN 2 ELSE 0 END + CASE WHEN bl >= {_LEVEL} THEN 1 ELSE 0 END AS c, (tl + tr + bl + br) / 4 >= {_LEVEL} AS hi FROM q)
SELECT row, col, unnest(CASE WHEN c IN (1, 14) THEN ['ws'] WHEN c IN (2, 13) THEN ['se'] WHEN c IN (3, 12) THEN ['we'] WHEN c IN (4, 11) THEN ['ne'] WHEN c IN (6, 9) THEN ['ns'] WHEN c IN (7, 8) THEN ['nw']
  WHEN (c = 5 AND hi) OR (c = 10 AND NOT hi) THEN ['nw', 'se'] WHEN c IN (5, 10) THEN ['ne', 'ws'] ELSE [] END) AS sides FROM k""",
)
def geo11(spark, sf_dir):
    return raster.marching_squares(grid(spark, sf_dir), _LEVEL)


def contour_ends(g, levels):
    """The contours' segments of each level as pairs of nodes (middles of the lattice's edges, numbered), and the strip of rows each is in."""
    parts = [raster.marching_squares(g, level).withColumn("level", F.lit(level)) for level in levels]
    m = functools.reduce(lambda a, b: a.unionByName(b), parts)

    def node(side):
        r, c = F.col("row") * 2, F.col("col") * 2
        dy = F.when(side == "n", 0).when(side == "s", 2).otherwise(1)
        dx = F.when(side == "w", 0).when(side == "e", 2).otherwise(1)
        return ((r + dy) * 10000 + c + dx).cast("long")

    return m.select("level", F.floor(F.col("row") / 8).cast("int").alias("strip"), node(F.substring("sides", 1, 1)).alias("a"), node(F.substring("sides", 2, 1)).alias("b"))


@query("geo12_stitch")
def geo12(spark, sf_dir):
    return paths.stitch(contour_ends(grid(spark, sf_dir), _LEVELS), "level", "strip")


@query("win34_local_maxima")
def win34(spark, sf_dir):
    f = analog.fixes(spark, sf_dir).withColumn("place", F.row_number().over(seqs.by()).cast("long"))
    return paths.separated_maxima(f, "hex", "place", "alt", 6000.0, 10, 14)


@query("win36_clean_edges")
def win36(spark, sf_dir):
    """Where a segment enters or leaves the zones: the boundary by eighteen bisections, all in one expression."""
    s = seqs.segments(classified(spark, sf_dir).withColumn("inside", F.col("zone_ft") < 0).withColumn("sev", F.col("inside").cast("int"))).filter("sev <> p_sev")
    polygons = list(analog.ZONES.values())
    rows = s.withColumns({"low": F.lit(0.0), "high": F.lit(1.0)})
    for _ in range(18):
        mid = (F.col("low") + F.col("high")) / 2
        lat, lon = F.col("p_lat") + mid * (F.col("lat") - F.col("p_lat")), F.col("p_lon") + mid * (F.col("lon") - F.col("p_lon"))
        here = geo.in_polygon(lat, lon, polygons[0]) | geo.in_polygon(lat, lon, polygons[1])
        rows = rows.withColumn("same", here == (F.col("p_sev") == 1)).select(*[c for c in rows.columns if c not in ("low", "high", "same")], F.when(F.col("same"), mid).otherwise(F.col("low")).alias("low"), F.when(F.col("same"), F.col("high")).otherwise(mid).alias("high"))
    return rows.select("hex", "seq", F.col("low").alias("share"))


# --- population impact -----------------------------------------------------------------------------------

_MID = f"""{PG}, {SEG}, ms AS (SELECT hex, seq, len_ft, (alt + p_alt) / 2 AS a, (lat + p_lat) / 2 AS lat, (lon + p_lon) / 2 AS lon FROM seg),
im AS (SELECT ms.*, coalesce(density, 0.0) * len_ft * pow(1000 / greatest(300.0, a - 5300), 2) AS impact FROM ms LEFT JOIN pop_grid ON pop_grid.row = {CELL_SQL[False][0]} AND pop_grid.col = {CELL_SQL[False][1]})"""


def impacts(spark, sf_dir):
    """Segments with their population impact: length x density at the middle, falling with height squared."""
    s = seqs.segments(analog.fixes(spark, sf_dir))
    mid = s.select("hex", "seq", "len_ft", ((F.col("alt") + F.col("p_alt")) / 2).alias("a"), ((F.col("lat") + F.col("p_lat")) / 2).alias("lat"), ((F.col("lon") + F.col("p_lon")) / 2).alias("lon"))
    d = with_density(mid, analog.pop_grid(spark, sf_dir), False)
    return d.withColumn("impact", F.col("density") * F.col("len_ft") * F.pow(1000 / F.greatest(F.lit(300.0), F.col("a") - 5300), F.lit(2)))


@query("agg23_population_impact", f"{_MID} SELECT hex, round(sum(impact) / 1e6, 4) AS impact FROM im GROUP BY hex")
def agg23(spark, sf_dir):
    return impacts(spark, sf_dir).groupBy("hex").agg(F.round(F.sum("impact") / 1e6, 4).alias("impact"))


@query("agg24_totals", f"{_MID} SELECT hex, round(sum(impact) / 1e6, 4) AS impact, round(max(impact) / 1e6, 4) AS top, count(*) AS n FROM im GROUP BY ROLLUP (hex)")
def agg24(spark, sf_dir):
    return impacts(spark, sf_dir).rollup("hex").agg(F.round(F.sum("impact") / 1e6, 4).alias("impact"), F.round(F.max("impact") / 1e6, 4).alias("top"), F.count("*").alias("n"))


@query("joi12_segment_cell", f"{_MID} SELECT seq, round(impact / 1e6, 5) AS impact FROM im")
def joi12(spark, sf_dir):
    return impacts(spark, sf_dir).select("seq", F.round(F.col("impact") / 1e6, 5).alias("impact"))


@query("cmp10_impact_explain", f"{_MID} SELECT hex, seq, round(impact / sum(impact) OVER (PARTITION BY hex) * 100, 4) AS pct FROM im WHERE impact > 0")
def cmp10(spark, sf_dir):
    from pyspark.sql import Window

    i = impacts(spark, sf_dir).filter("impact > 0")
    return i.select("hex", "seq", F.round(F.col("impact") / F.sum("impact").over(Window.partitionBy("hex")) * 100, 4).alias("pct"))


# --- rasters ---------------------------------------------------------------------------------------------

_CELLS = f"cells AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, {GRID['lat_max']}::DOUBLE - (r + 0.5) / {GRID_ROWS} * ({GRID['lat_max']}::DOUBLE - {GRID['lat_min']}::DOUBLE) AS c_lat, {GRID['lon_min']}::DOUBLE + (c + 0.5) / {GRID_COLS} * ({GRID['lon_max']}::DOUBLE - {GRID['lon_min']}::DOUBLE) AS c_lon FROM range({GRID_ROWS}) a(r) CROSS JOIN range({GRID_COLS}) b(c))"
_REACH = 3


def spread_segments(spark, sf_dir):
    """Segments times the cells around their middle."""
    s = seqs.segments(analog.fixes(spark, sf_dir))
    at = s.withColumns({"m_lat": (F.col("lat") + F.col("p_lat")) / 2, "m_lon": (F.col("lon") + F.col("p_lon")) / 2})
    row = F.floor((GRID["lat_max"] - F.col("m_lat")) / (GRID["lat_max"] - GRID["lat_min"]) * GRID_ROWS).cast("int")
    col = F.floor((F.col("m_lon") - GRID["lon_min"]) / (GRID["lon_max"] - GRID["lon_min"]) * GRID_COLS).cast("int")
    return raster.box(at, row, col, _REACH, GRID_ROWS, GRID_COLS)


def _CLAT():
    return GRID["lat_max"] - (F.col("row") + 0.5) / GRID_ROWS * (GRID["lat_max"] - GRID["lat_min"])

def _CLON():
    return GRID["lon_min"] + (F.col("col") + 0.5) / GRID_COLS * (GRID["lon_max"] - GRID["lon_min"])

_SPREAD_SQL = f"""{FX}, {SEG}, {_CELLS}, ms AS (SELECT *, CAST(floor(({GRID['lat_max']}::DOUBLE - (lat + p_lat) / 2) / ({GRID['lat_max']}::DOUBLE - {GRID['lat_min']}::DOUBLE) * {GRID_ROWS}) AS INT) AS r0, CAST(floor(((lon + p_lon) / 2 - {GRID['lon_min']}::DOUBLE) / ({GRID['lon_max']}::DOUBLE - {GRID['lon_min']}::DOUBLE) * {GRID_COLS}) AS INT) AS c0 FROM seg),
ex AS (SELECT row, col, greatest(100.0, sqrt(pow({segment_sql('c_lat', 'c_lon', 'p_lat', 'p_lon', 'lat', 'lon')}, 2) + pow(greatest(1.0, (alt + p_alt) / 2 - {FIELD_FT}), 2))) AS slant, t_ms
  FROM ms JOIN cells ON row BETWEEN r0 - {_REACH} AND r0 + {_REACH} AND col BETWEEN c0 - {_REACH} AND c0 + {_REACH})"""
_DB = "pow(10.0, (95.0 - 25.0 * log10(slant / 100)) / 10)"

for _name, _how in (("ras01_exposure_sum", "sum"), ("ras02_loudest", "max")):

    @query(_name, f"{_SPREAD_SQL} SELECT row, col, round(10 * log10({_how}({_DB})), 5) AS db FROM ex GROUP BY 1, 2")
    def ras01(spark, sf_dir, how=_how):
        e = raster.exposure(spread_segments(spark, sf_dir), F.lit(95.0), 25.0, _CLAT(), _CLON(), FIELD_FT, how)
        return e.withColumn("db", F.round("db", 5))


@query("ras03_impact_grid", f"{_SPREAD_SQL.replace(FX, PG, 1)}, lm AS (SELECT row, col, 10 * log10(max({_DB})) AS db FROM ex GROUP BY 1, 2) SELECT count(*) AS cells, round(max(db), 5) AS peak_db, round(sum(db * density) / 1e3, 3) AS exposure FROM lm JOIN pop_grid USING (row, col)")
def ras03(spark, sf_dir):
    e = raster.exposure(spread_segments(spark, sf_dir), F.lit(95.0), 25.0, _CLAT(), _CLON(), FIELD_FT, "max")
    j = e.join(F.broadcast(analog.pop_grid(spark, sf_dir)), ["row", "col"])  # a grid of fixed size
    return j.agg(F.count("*").alias("cells"), F.round(F.max("db"), 5).alias("peak_db"), F.round(F.sum(F.col("db") * F.col("density")) / 1e3, 3).alias("exposure"))


def _blob_items(spark, sf_dir):
    f = analog.fixes(spark, sf_dir)
    return f.withColumns({"radius": 1.0 + (F.col("alt") - 5200) / 4000, "heading": (F.col("seq") % 36 * 10).cast("double"), "hour": (F.floor(F.col("t_ms") / 3600) % 24).cast("int")})


_BLOB_SQL = f"""{FX}, bi AS (SELECT *, {ROW_SQL} AS y, {COL_SQL} AS x, 1.0 + (alt - 5200) / 4000 AS radius, radians(CAST(seq % 36 * 10 AS DOUBLE)) AS h, CAST((t_ms // 3600) % 24 AS INT) AS hour FROM fixes),
bc AS (SELECT row, col, hour, radius, pow(((col - x) * sin(h) - (row - y) * cos(h)) / (radius * 1.4), 2) + pow(((col - x) * cos(h) + (row - y) * sin(h)) / radius, 2) AS d2
  FROM bi JOIN (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM range({GRID_ROWS}) a(r) CROSS JOIN range({GRID_COLS}) b(c)) g ON row BETWEEN floor(y) - 6 AND floor(y) + 6 AND col BETWEEN floor(x) - 6 AND floor(x) + 6)"""


@query("ras04_blobs", f"{_BLOB_SQL} SELECT row, col, round(sum(180.0 / (pi() * radius * radius) * (1 - d2)), 4) AS value FROM bc WHERE d2 < 1 GROUP BY 1, 2")
def ras04(spark, sf_dir):
    b = raster.blobs(_blob_items(spark, sf_dir), ROW(), COL(), F.lit(180.0), F.col("radius"), F.col("heading"), 1.4, 6, GRID_ROWS, GRID_COLS)
    return b.withColumn("value", F.round("value", 4))


def _box_sql(source: str, radius: int) -> str:
    return f"""h1 AS (SELECT row, t AS col, sum(value) / (least({GRID_COLS - 1}, t + {radius}) - greatest(0, t - {radius}) + 1) AS value FROM {source} JOIN range({GRID_COLS}) r(t) ON t BETWEEN col - {radius} AND col + {radius} GROUP BY 1, 2),
bl AS (SELECT t AS row, col, sum(value) / (least({GRID_ROWS - 1}, t + {radius}) - greatest(0, t - {radius}) + 1) AS value FROM h1 JOIN range({GRID_ROWS}) r(t) ON t BETWEEN row - {radius} AND row + {radius} GROUP BY 1, 2)"""


@query("ras07_box_blur", f"{GS}, pv AS (SELECT row, col, density AS value FROM pop_grid), {_box_sql('pv', 2)} SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(value, 6) AS value FROM bl")
def ras07(spark, sf_dir):
    return raster.box_blur(grid(spark, sf_dir), 2, GRID_ROWS, GRID_COLS).withColumn("value", F.round("value", 6))


@query("ras06_impact_raster", f"{_BLOB_SQL.replace(FX, PG, 1)}, eb AS (SELECT row, col, sum(180.0 / (pi() * radius * radius) * (1 - d2)) AS e FROM bc WHERE d2 < 1 GROUP BY 1, 2), pv AS (SELECT row, col, ln(1 + density) AS value FROM pop_grid), {_box_sql('pv', 2)} SELECT CAST(eb.row AS INT) AS row, CAST(eb.col AS INT) AS col, round(e * value / (SELECT max(value) FROM bl), 4) AS value FROM eb JOIN bl ON eb.row = bl.row AND eb.col = bl.col")
def ras06(spark, sf_dir):
    e = raster.blobs(_blob_items(spark, sf_dir), ROW(), COL(), F.lit(180.0), F.col("radius"), F.col("heading"), 1.4, 6, GRID_ROWS, GRID_COLS)
    blurred = raster.box_blur(grid(spark, sf_dir).withColumn("value", F.log1p("value")), 2, GRID_ROWS, GRID_COLS).withColumnRenamed("value", "mask")
    top = blurred.agg(F.max("mask").alias("top"))
    return e.join(blurred, ["row", "col"]).crossJoin(F.broadcast(top)).select("row", "col", F.round(F.col("value") * F.col("mask") / F.col("top"), 4).alias("value"))


@query("ras08_colour_range", f"{GS}, s AS (SELECT list_sort(list(density)) AS v, count(*) AS n FROM pop_grid WHERE density > 0) SELECT row, col, CAST(floor(greatest(0.0, least(1.0, (density - v[CAST(floor(n * 0.01) AS BIGINT) + 1]) / (v[CAST(floor(n * 0.99) AS BIGINT) + 1] - v[CAST(floor(n * 0.01) AS BIGINT) + 1]))) * 255) AS INT) AS colour FROM pop_grid, s WHERE density > 0")
def ras08(spark, sf_dir):
    g = analog.pop_grid(spark, sf_dir).filter("density > 0")
    s = g.agg(F.sort_array(F.collect_list("density")).alias("v"), F.count("*").alias("n"))  # a grid of fixed size
    at = lambda p: F.element_at("v", (F.floor(F.col("n") * p) + 1).cast("int"))
    return g.crossJoin(F.broadcast(s)).select("row", "col", scoring.palette_index((F.col("density") - at(0.01)) / (at(0.99) - at(0.01))).alias("colour"))


@query("ras09_hourly_frames", f"{_BLOB_SQL} SELECT hour, row, col, round(sum(180.0 / (pi() * radius * radius) * (1 - d2)), 4) AS value FROM bc WHERE d2 < 1 AND hour BETWEEN 7 AND 21 GROUP BY 1, 2, 3")
def ras09(spark, sf_dir):
    items = _blob_items(spark, sf_dir).filter("hour between 7 and 21").withColumns({"_y": ROW(), "_x": COL(), "_h": F.radians("heading")})
    cells = raster.box(items, F.floor("_y").cast("int"), F.floor("_x").cast("int"), 6, GRID_ROWS, GRID_COLS)
    dy, dx = F.col("row") - F.col("_y"), F.col("col") - F.col("_x")
    d2 = F.pow((dx * F.sin("_h") - dy * F.cos("_h")) / (F.col("radius") * 1.4), 2) + F.pow((dx * F.cos("_h") + dy * F.sin("_h")) / F.col("radius"), 2)
    near = cells.withColumn("d2", d2).filter("d2 < 1")
    return near.groupBy("hour", "row", "col").agg(F.round(F.sum(180.0 / (F.pi() * F.col("radius") * F.col("radius")) * (1 - F.col("d2"))), 4).alias("value"))


@query("ras10_complaint_heat", f"{with_sql('complaints')}, ci AS (SELECT coalesce(score, 1) AS w, {ROW_SQL} AS y, {COL_SQL} AS x FROM complaints) SELECT row, col, round(sum(w * exp(-(pow(row - y, 2) + pow(col - x, 2)) / 4.5)), 5) AS value FROM ci JOIN (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM range({GRID_ROWS}) a(r) CROSS JOIN range({GRID_COLS}) b(c)) g ON pow(row - y, 2) + pow(col - x, 2) <= 20.25 GROUP BY 1, 2")
def ras10(spark, sf_dir):
    s = raster.splat(analog.complaints(spark, sf_dir), ROW(), COL(), F.coalesce("score", F.lit(1)).cast("double"), 1.5, GRID_ROWS, GRID_COLS)
    return s.withColumn("value", F.round("value", 5))


@query("ras11_population_raster", f"{GS} SELECT row, col, round(greatest(0.0, least(1.0, ln(1 + density) / ln(2101.0))), 6) AS shade FROM pop_grid WHERE density > 0")
def ras11(spark, sf_dir):
    shade = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p("density") / F.log(F.lit(2101.0))))
    return analog.pop_grid(spark, sf_dir).filter("density > 0").select("row", "col", F.round(shade, 6).alias("shade"))


@query("ras12_wind_drift", f"{GS} SELECT CAST(a.row AS INT) AS row, CAST(a.col AS INT) AS col, band, round(greatest(30.0, least(95.0, 95 - 10 * band + sum(b.density) / 25 / 100)), 5) AS dba FROM pop_grid a JOIN pop_grid b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 + band AND a.col + 2 + band CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(band) WHERE b.col BETWEEN a.col - 2 + band AND a.col + 2 + band GROUP BY 1, 2, 3".replace(" AND b.col BETWEEN a.col - 2 + band AND a.col + 2 + band CROSS", " CROSS", 1))
def ras12(spark, sf_dir):
    g = grid(spark, sf_dir)
    band = F.explode(F.sequence(F.lit(0), F.lit(4)))
    near = g.withColumn("band", band).withColumn("dr", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("dc", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    moved = near.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc") - F.col("band")).alias("col"), "band", "value")
    total = moved.groupBy("row", "col", "band").agg(F.sum("value").alias("total")).join(g.select("row", "col"), ["row", "col"])
    return total.select("row", "col", "band", F.round(F.greatest(F.lit(30.0), F.least(F.lit(95.0), 95 - 10 * F.col("band") + F.col("total") / 25 / 100)), 5).alias("dba"))


# --- composites --------------------------------------------------------------------------------------------

_CLS_TAIL = CLASSED[CLASSED.index("near AS ("):]
_CLASSED_ALL = with_sql("fixes", "zone_edges", "pop_grid", "aircraft") + ", " + _CLS_TAIL
_IMPACT_TAIL = _MID[_MID.index("ms AS (") :].replace("FROM seg)", f"FROM (SELECT *, {_FT('p_lat', 'p_lon', 'lat', 'lon')} AS len_ft FROM (SELECT *, {LAGS} FROM fixes) WHERE p_t_ms IS NOT NULL))")
_BASES = "base IN ('NATION_2', 'NATION_3', 'NATION_7', 'NATION_11', 'NATION_19', 'NATION_20')"
_LIVE = f"""{_CLASSED_ALL}, {CSEG}, {MERGED}, {_IMPACT_TAIL},
fl AS (SELECT hex, count(*) AS flights FROM merged WHERE landing_ts IS NOT NULL GROUP BY 1),
ln AS (SELECT hex, sum(len_ft) / 6076.12 AS total, coalesce(sum(len_ft) FILTER (seg_sev = 3), 0) / 6076.12 AS red, coalesce(sum(len_ft) FILTER (seg_sev = 2), 0) / 6076.12 AS orange, coalesce(sum(len_ft) FILTER (seg_sev = 1), 0) / 6076.12 AS yellow FROM cseg GROUP BY 1),
pi AS (SELECT hex, sum(impact) AS pop FROM im GROUP BY 1),
g AS (SELECT base AS k, sum(flights) AS flights, sum(total) AS total, sum(red) AS red, sum(orange) AS orange, sum(yellow) AS yellow, sum(pop) AS pop FROM fl JOIN ln USING (hex) LEFT JOIN pi USING (hex) JOIN aircraft ON tail = hex WHERE {_BASES} GROUP BY 1),
{_SCORED_SQL}"""


@query("agg08_live_score", f"{_LIVE} SELECT k, CAST(flights AS BIGINT) AS flights, round(exc, 6) AS exc, round(idx, 4) AS idx, round(pow(flights, 1.5) * (1 - least(1.0, exc)) / (1 + idx), 6) AS score FROM b")
def agg08(spark, sf_dir):
    """Completed trips, classified lengths and population impact of the live fixes, scored for each of the home bases."""
    merged = seqs.merge_cycles(flights(spark, sf_dir), 120).filter("landing_ts is not null").groupBy("hex").agg(F.count("*").alias("flights"))
    c = seqs.segments(classified(spark, sf_dir)).groupBy("hex")
    part = lambda s: F.sum(F.when(F.col("seg_sev") == s, F.col("len_ft")).otherwise(0.0)) / geo.FT_PER_NM
    lengths = c.agg((F.sum("len_ft") / geo.FT_PER_NM).alias("total"), part(3).alias("red"), part(2).alias("orange"), part(1).alias("yellow"))
    pop = impacts(spark, sf_dir).groupBy("hex").agg(F.sum("impact").alias("pop"))
    home = analog.aircraft(spark, sf_dir).filter(_BASES).select(F.col("tail").alias("hex"), F.col("base").alias("k"))
    tails = merged.join(lengths, "hex").join(pop, "hex", "left").join(home, "hex")
    sums = tails.groupBy("k").agg(*(F.sum(x).alias(x) for x in ("flights", "total", "red", "orange", "yellow", "pop")))
    return score_board(sums, 1.5).select("k", "flights", F.round("exc", 6).alias("exc"), F.round("index", 4).alias("idx"), F.round("score", 6).alias("score"))


@query("cmp07_segments", f"{CLASSED}, {runs_sql(f'(SELECT *, sev IS DISTINCT FROM lag(sev) OVER {W} OR zone IS DISTINCT FROM lag(zone) OVER {W} AS ch FROM classed)', 'ch')} SELECT hex, run, sev, zone, min(t_ms) AS t_from, max(t_ms) AS t_to FROM runs WHERE hex = 7 GROUP BY ALL HAVING bool_or({_NM('lat', 'lon', LAT0, LON0)} <= 5)")
def cmp07(spark, sf_dir):
    """Runs of class and zone of one aircraft that come within five miles; the filter precedes the windows."""
    c = classified(spark, sf_dir).filter("hex = 7").withColumn("zone", nearest_zone(F.col("lat"), F.col("lon"))).withColumn("near", geo.planar_nm(F.col("lat"), F.col("lon"), LAT0, LON0) <= 5)
    runs = seqs.islands(c, seqs.changed("sev", "zone"))
    return runs.groupBy("hex", "run", "sev", "zone").agg(F.min("t_ms").alias("t_from"), F.max("t_ms").alias("t_to"), F.bool_or("near").alias("near")).filter("near").drop("near")


