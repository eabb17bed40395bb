"""Planar and spherical geometry, and classification of points against zones, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FT_PER_DEG = 364560.0
FT_PER_NM = 6076.12
NM_PER_DEG = 60.0
EARTH_M, EARTH_NM = 6371000.0, 3440.065

#: class boundaries in feet; severities are 0 clean, 1 yellow, 2 orange, 3 red, 4 purple
CLASSES = ["yellow", "orange", "red", "purple"]
ALT_LIMIT_FT = 7500.0


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def planar_ft(lat1, lon1, lat2, lon2) -> Column:
    """Flat-earth distance in feet, longitudes shrunk at the middle latitude."""
    lat1, lon1, lat2, lon2 = map(lit, (lat1, lon1, lat2, lon2))
    return F.hypot((lat2 - lat1) * FT_PER_DEG, (lon2 - lon1) * FT_PER_DEG * F.cos(F.radians((lat1 + lat2) / 2)))


def planar_nm(lat1, lon1, lat2, lon2) -> Column:
    """Flat-earth distance at 60 nm a degree."""
    lat1, lon1, lat2, lon2 = map(lit, (lat1, lon1, lat2, lon2))
    return F.hypot((lat2 - lat1) * NM_PER_DEG, (lon2 - lon1) * NM_PER_DEG * F.cos(F.radians((lat1 + lat2) / 2)))


def feet_nm(lat1, lon1, lat2, lon2) -> Column:
    """The planar distance in feet, as nautical miles."""
    return planar_ft(lat1, lon1, lat2, lon2) / FT_PER_NM


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    lat1, lon1, lat2, lon2 = map(lit, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def spatial_ft(lat1, lon1, alt1, lat2, lon2, alt2) -> Column:
    """Distance in feet with the difference in altitude."""
    return F.hypot(planar_ft(lat1, lon1, lat2, lon2), lit(alt2) - lit(alt1))


def planar_bearing(lat1, lon1, lat2, lon2) -> Column:
    """Degrees in (-180, 180], clockwise from north, on the flat earth."""
    lat1, lon1, lat2, lon2 = map(lit, (lat1, lon1, lat2, lon2))
    return F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)), lat2 - lat1))


def great_circle_bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    a, b, d = F.radians(lit(lat1)), F.radians(lit(lat2)), F.radians(lit(lon2) - lit(lon1))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def half_turn(angle: Column) -> Column:
    """An angle in degrees moved into [-180, 180)."""
    return F.pmod(angle + 180, F.lit(360.0)) - 180


def segment_ft(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:
    """Distance in feet from a point to a segment, longitudes shrunk at the mean of the three latitudes."""
    lat, lon, a_lat, a_lon, b_lat, b_lon = map(lit, (lat, lon, a_lat, a_lon, b_lat, b_lon))
    shrink = F.cos(F.radians((lat + a_lat + b_lat) / 3)) * FT_PER_DEG
    px, py = (lon - a_lon) * shrink, (lat - a_lat) * FT_PER_DEG
    dx, dy = (b_lon - a_lon) * shrink, (b_lat - a_lat) * FT_PER_DEG
    square = dx * dx + dy * dy
    along = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / F.nullif(square, F.lit(0.0)))))
    return F.hypot(px - along * dx, py - along * dy)


def chord_degrees(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:
    """Perpendicular distance of a point to a chord, in degrees without shrinking; to its start if it is a point."""
    lat, lon, a_lat, a_lon, b_lat, b_lon = map(lit, (lat, lon, a_lat, a_lon, b_lat, b_lon))
    length = F.hypot(b_lat - a_lat, b_lon - a_lon)
    area = F.abs((b_lat - a_lat) * (a_lon - lon) - (a_lat - lat) * (b_lon - a_lon))
    return F.when(length == 0, F.hypot(lat - a_lat, lon - a_lon)).otherwise(area / F.nullif(length, F.lit(0.0)))


Polygon = list[tuple[float, float]]


def edges(polygon: Polygon) -> list[tuple[float, float, float, float]]:
    return [(*polygon[i], *polygon[(i + 1) % len(polygon)]) for i in range(len(polygon))]


def in_polygon(lat: Column, lon: Column, polygon: Polygon) -> Column:
    """Even-odd rule, unrolled over the edges."""
    crossings = F.lit(0)
    for a_lat, a_lon, b_lat, b_lon in edges(polygon):
        if a_lat == b_lat:
            continue
        straddles = (F.lit(a_lat) > lat) != (F.lit(b_lat) > lat)
        crosses = straddles & (lon < (lat - a_lat) * ((b_lon - a_lon) / (b_lat - a_lat)) + a_lon)
        crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def _edge_square(lat: Column, lon: Column, edge: tuple[float, float, float, float]) -> Column:
    """Square of segment_ft to a fixed edge. What the edge fixes is worked out here, so that the code of many edges
    stays small enough to be compiled."""
    a_lat, a_lon, b_lat, b_lon = edge
    shrink = F.cos(F.radians((lat + (a_lat + b_lat)) / 3)) * FT_PER_DEG
    clamp = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    if a_lat == b_lat and a_lon == b_lon:
        x, y = (lon - a_lon) * shrink, (lat - a_lat) * FT_PER_DEG
    elif a_lat == b_lat:
        x, y = (lon - a_lon - clamp((lon - a_lon) * (1 / (b_lon - a_lon))) * (b_lon - a_lon)) * shrink, (lat - a_lat) * FT_PER_DEG
    elif a_lon == b_lon:
        x, y = (lon - a_lon) * shrink, (lat - a_lat - clamp((lat - a_lat) * (1 / (b_lat - a_lat))) * (b_lat - a_lat)) * FT_PER_DEG
    else:
        px, py = (lon - a_lon) * shrink, (lat - a_lat) * FT_PER_DEG
        dx, dy = shrink * (b_lon - a_lon), (b_lat - a_lat) * FT_PER_DEG
        along = clamp((px * dx + py * dy) / (dx * dx + dy * dy))
        x, y = px - along * dx, py - along * dy
    return x * x + y * y


def _present(x: Column) -> Column:
    return F.coalesce(x, F.lit(float("nan")))  # without nulls, the code has no branch for each step


def boundary_ft(lat: Column, lon: Column, polygon: Polygon) -> Column:
    """Distance to the nearest edge, inside or not."""
    return nearest_edge_ft(lat, lon, [polygon])


def nearest_edge_ft(lat: Column, lon: Column, polygons: list[Polygon]) -> Column:
    """Distance to the nearest edge of any polygon; null if a coordinate is."""
    squares = [_edge_square(_present(lat), _present(lon), e) for p in polygons for e in edges(p)]
    least = F.sqrt(squares[0] if len(squares) == 1 else F.least(*squares))
    return F.when(lat.isNotNull() & lon.isNotNull(), least)


def signed_zone_ft(lat: Column, lon: Column, polygons: list[Polygon]) -> Column:
    """Distance to the nearest edge of any zone, negative inside any of them."""
    inside = in_polygon(lat, lon, polygons[0])
    for p in polygons[1:]:
        inside = inside | in_polygon(lat, lon, p)
    return nearest_edge_ft(lat, lon, polygons) * F.when(inside, -1.0).otherwise(1.0)


def zone_severity(signed: Column) -> Column:
    return F.when(signed < -500, 3).when(signed < -250, 2).when(signed < 250, 1).otherwise(0)


def altitude_severity(alt: Column, limit: float = ALT_LIMIT_FT) -> Column:
    """0 where the altitude is null."""
    below = limit - alt
    return F.when(alt.isNull(), 0).when(below > 500, 3).when(below > 250, 2).when(below > -250, 1).otherwise(0)


def severity_class(severity: Column) -> Column:
    """Class name of a severity, null for 0."""
    out = F.when(severity == 1, CLASSES[0])
    for i, name in enumerate(CLASSES[1:], start=2):
        out = out.when(severity == i, name)
    return out


def class_severity(klass: Column) -> Column:
    out = F.when(klass == CLASSES[0], 1)
    for i, name in enumerate(CLASSES[1:], start=2):
        out = out.when(klass == name, i)
    return out.otherwise(0)
