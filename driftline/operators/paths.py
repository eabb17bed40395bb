"""Path geometry: thinning, smoothing and densifying, as windows where possible and grouped Arrow kernels where not."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, kernels
from .sequences import by, sessions

SCHEMA = "hex long, seq long, lat double, lon double"


def thin(fixes: DataFrame, tolerance: float, gap_s: float = 60.0) -> DataFrame:
    """Douglas-Peucker on every flight: a path is split where its aircraft is silent for longer than ``gap_s``, however
    long the path is, so an aircraft is many tasks' work. Flights pass in order, a batch of many at a time; only the one
    that a batch breaks off is carried on, and those of one or two fixes, which stay as they are, cost no call."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            first = np.flatnonzero(table["head"].to_numpy())
            yield from _thinned(table.slice(0, first[-1]), first, tolerance)
            rest = table.slice(first[-1]).combine_chunks()
        if rest is not None and len(rest):
            yield from _thinned(rest, np.zeros(1, np.int64), tolerance)

    flights = sessions(fixes, gap_s).select("hex", "flight", "t_ms", "seq", "lat", "lon", (F.row_number().over(Window.partitionBy("hex", "flight").orderBy("t_ms", "seq")) == 1).alias("head"))
    dealt = flights.repartition("hex", "flight").sortWithinPartitions("hex", "flight", "t_ms", "seq")
    return dealt.select("hex", "seq", "lat", "lon", "head").mapInArrow(work, SCHEMA)


def _thinned(rows: pa.Table, first: np.ndarray, tolerance: float) -> Iterator[pa.RecordBatch]:
    """What Douglas-Peucker keeps of the whole flights in ``rows``, which begin at the places ``first``."""
    lat, lon = rows["lat"].to_numpy(), rows["lon"].to_numpy()
    keep = np.ones(len(rows), bool)
    ends = np.append(first[first < len(rows)], len(rows))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a > 2:
            keep[a:b] = kernels.douglas_peucker(lat[a:b], lon[a:b], tolerance)
    yield from rows.select(["hex", "seq", "lat", "lon"]).filter(pa.array(keep)).to_batches()


def thin_radial(fixes: DataFrame, degrees: float) -> DataFrame:
    """Keeps a fix if it is farther than ``degrees`` from the last one kept. Fixes pass in order, a batch at a time;
    only the last one kept is carried on."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = last = None
        for pdf in batches:
            kept = []
            for i, (hex_, lat, lon) in enumerate(zip(pdf["hex"].tolist(), pdf["lat"].tolist(), pdf["lon"].tolist(), strict=True)):
                if hex_ != now or math.hypot(lat - last[0], lon - last[1]) > degrees:
                    kept.append(i)
                    now, last = hex_, (lat, lon)
            yield pdf.iloc[kept][["hex", "seq", "lat", "lon"]]

    return fixes.repartition("hex").sortWithinPartitions("hex", "t_ms", "seq").mapInPandas(work, SCHEMA)


def chaikin(fixes: DataFrame) -> DataFrame:
    """One round of corner cutting: points at a quarter and three quarters of every segment; ends stay."""
    nxt = fixes.withColumns({"n_lat": F.lead("lat").over(by()), "n_lon": F.lead("lon").over(by()), "p_lat": F.lag("lat").over(by())})
    mix = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * t
    point = lambda part, lat, lon: F.struct(F.lit(part).alias("part"), lat.alias("lat"), lon.alias("lon"))
    cut = F.array(point(1, mix("lat", "n_lat", 0.25), mix("lon", "n_lon", 0.25)), point(2, mix("lat", "n_lat", 0.75), mix("lon", "n_lon", 0.75)))
    own = F.array(point(0, F.col("lat"), F.col("lon")))
    points = F.when(F.col("n_lat").isNull(), own).when(F.col("p_lat").isNull(), F.concat(own, cut)).otherwise(cut)
    return nxt.withColumn("p", F.explode(points)).select("hex", "seq", "p.part", "p.lat", "p.lon")


def _spline(fixes: DataFrame, samples: int, basis) -> DataFrame:
    """Points at ``samples`` places of every segment from its four neighbours (ends repeated)."""
    cols = {}
    for c in ("lat", "lon"):
        cols |= {f"{c}1": F.col(c), f"{c}2": F.lead(c).over(by()), f"{c}0": F.coalesce(F.lag(c).over(by()), F.col(c)), f"{c}3": F.coalesce(F.lead(c, 2).over(by()), F.lead(c).over(by()))}
    rows = fixes.withColumns(cols).filter("lat2 is not null").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    t = F.col("i") / samples
    value = lambda c: basis(*(F.col(f"{c}{k}") for k in range(4)), t)
    return rows.select("hex", "seq", "i", value("lat").alias("lat"), value("lon").alias("lon"))


def cardinal(fixes: DataFrame, tension: float = 0.5, samples: int = 8) -> DataFrame:
    def basis(p0, p1, p2, p3, t):
        a, b = (p2 - p0) * tension, (p3 - p1) * tension
        return (2 * t * t * t - 3 * t * t + 1) * p1 + (t * t * t - 2 * t * t + t) * a + (-2 * t * t * t + 3 * t * t) * p2 + (t * t * t - t * t) * b

    return _spline(fixes, samples, basis)


def catmull_rom(fixes: DataFrame, samples: int = 8) -> DataFrame:
    """Centripetal Catmull-Rom spline: knots are apart by the square root of the distance in feet (1e-9 at least)."""
    cols = {}
    for c in ("lat", "lon"):
        cols |= {f"{c}1": F.col(c), f"{c}2": F.lead(c).over(by()), f"{c}0": F.coalesce(F.lag(c).over(by()), F.col(c)), f"{c}3": F.coalesce(F.lead(c, 2).over(by()), F.lead(c).over(by()))}
    rows = fixes.withColumns(cols).filter("lat2 is not null")
    knot = lambda k: F.sqrt(F.greatest(F.lit(1e-9), geo.planar_ft(*(F.col(f"{c}{k + i}") for i in (0, 1) for c in ("lat", "lon")))))
    rows = rows.withColumn("t1", knot(0)).withColumn("t2", F.col("t1") + knot(1)).withColumn("t3", F.col("t2") + knot(2))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("t", F.col("t1") + F.col("i") / samples * (F.col("t2") - F.col("t1")))
    time = lambda k: F.col(f"t{k}") if k else F.lit(0.0)
    mix = lambda a, b, x, y: ((time(b) - F.col("t")) * x + (F.col("t") - time(a)) * y) / (time(b) - time(a))

    def value(c: str):
        p = [F.col(f"{c}{k}") for k in range(4)]
        a = [mix(k, k + 1, p[k], p[k + 1]) for k in range(3)]
        return mix(1, 2, mix(0, 2, a[0], a[1]), mix(1, 3, a[1], a[2]))

    return rows.select("hex", "seq", "i", value("lat").alias("lat"), value("lon").alias("lon"))


def midpoint_bezier(fixes: DataFrame, samples: int = 8) -> DataFrame:
    """Quadratic curves from midpoint to midpoint of neighbouring segments, each fix being a control point."""

    def basis(p0, p1, p2, p3, t):
        a, b = (p0 + p1) / 2, (p1 + p2) / 2
        return (1 - t) * (1 - t) * a + 2 * (1 - t) * t * p1 + t * t * b

    return _spline(fixes, samples, basis)


def ring(sites: DataFrame, radius_nm: float, stretch: float, heading_deg: float, steps: int = 28) -> DataFrame:
    """Points of an oriented ellipse around every site."""
    rows = sites.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    a, h = F.col("step") * (2 * np.pi / steps), float(np.radians(heading_deg))
    along, across = radius_nm * stretch * F.cos(a), radius_nm * F.sin(a)
    north, east = along * float(np.cos(h)) - across * float(np.sin(h)), along * float(np.sin(h)) + across * float(np.cos(h))
    return rows.select("code", "step", (F.col("lat") + north / 60).alias("lat"), (F.col("lon") + east / (60 * F.cos(F.radians("lat")))).alias("lon"))


def separated_maxima(rows: DataFrame, key: str, place: str, value: str, least: float, apart: int, top: int) -> DataFrame:
    """Per key, the greatest local maxima over +-8 places, at least ``apart`` places from each other."""
    w = Window.partitionBy(key).orderBy(place).rowsBetween(-8, 8)
    peaks = rows.withColumn("_m", F.max(value).over(w)).filter((F.col(value) == F.col("_m")) & (F.col(value) >= least)).select(key, place, value)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([value, place], ascending=[False, True])
        chosen: list[int] = []
        for p in pdf[place]:
            if len(chosen) < top and all(abs(p - c) >= apart for c in chosen):
                chosen.append(p)
        return pdf[pdf[place].isin(chosen)]

    return peaks.groupBy(key).applyInPandas(work, peaks.schema)


def _joined(chains: list[list[int]]) -> list[list[int]]:
    """Chains that share end nodes, made into longer ones; where more than two meet, they are joined in order of their nodes."""
    ends: dict[int, list[int]] = {}
    for i, c in enumerate(chains):
        if c[0] != c[-1]:
            for node in (c[0], c[-1]):
                ends.setdefault(node, []).append(i)
    partner: dict[tuple[int, int], int] = {}
    for node, at in ends.items():
        at.sort(key=lambda i: chains[i])
        for i, j in zip(at[::2], at[1::2], strict=False):
            if i != j:
                partner[node, i], partner[node, j] = j, i
    used, out = set(), [c for c in chains if c[0] == c[-1]]

    def walk(i: int, node: int) -> list[int]:
        """The nodes from ``node`` on, by chain i and those that follow."""
        path = [node]
        while i not in used:
            used.add(i)
            c = chains[i] if chains[i][0] == path[-1] else chains[i][::-1]
            path += c[1:]
            if (path[-1], i) not in partner:
                break
            i = partner[path[-1], i]
        return path

    for open_ in (True, False):  # paths from their ends first, then what is closed
        for i, c in enumerate(chains):
            if i not in used and c[0] != c[-1]:
                free = [n for n in (c[0], c[-1]) if (n, i) not in partner]
                if free or not open_:
                    out.append(walk(i, min(free) if free else min(c[0], c[-1])))
    return out


def _canonical(nodes: list[int]) -> list[int]:
    """A closed loop from its least node on, towards the lesser of its neighbours; an open one from its lesser end."""
    if nodes[0] != nodes[-1]:
        return nodes if nodes[0] < nodes[-1] else nodes[::-1]
    ring = nodes[:-1]
    at = ring.index(min(ring))
    ring = ring[at:] + ring[:at]
    if ring[-1] < ring[1]:
        ring = ring[:1] + ring[:0:-1]
    return [*ring, ring[0]]


def stitch(segments: DataFrame, key: str, tile: str) -> DataFrame:
    """Undirected segments (a, b) of one ``key`` joined into loops: (key, loop, place, node), a loop's number being its first node.

    Segments are joined within each tile first, where most loops close, and the chains that leave their tile then across
    tiles: so one key's group holds the chains that cross borders, not all its segments.
    """
    kind = dict(segments.dtypes)[key]
    schema = f"{key} {kind}, nodes array<bigint>"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        chains = [_canonical(c) for c in _joined([list(map(int, n)) for n in pdf["nodes"]])]
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(chains), "nodes": chains})

    rows = segments.select(key, tile, F.array(F.col("a").cast("long"), F.col("b").cast("long")).alias("nodes"))
    within = rows.groupBy(key, tile).applyInPandas(work, schema)
    closed = F.element_at("nodes", 1) == F.element_at("nodes", -1)
    across = within.filter(~closed).groupBy(key).applyInPandas(work, schema)
    loops = within.filter(closed).unionByName(across)
    return loops.select(key, F.element_at("nodes", 1).alias("loop"), F.posexplode("nodes").alias("place", "node"))
