"""Approach tracker: one report per visit of an aircraft to a point.

A visit begins at the first fix within the radius and ends when the aircraft is a buffer farther away than
it was at its closest, leaves the radius, or has been silent for a while. Its report tells when it began, the
closest fix, the highest level meanwhile and when it ended. A visit that ends within the cool-down after the aircraft's
last report is dropped; the next fix within the radius begins another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import geo

OUT = "hex string, entered double, closest_ts double, closest_m double, peak double, fired double"
COLUMNS = ["hex", "entered", "closest_ts", "closest_m", "peak", "fired"]
VISIT = "entered double, closest_ts double, closest_m double, peak double, last_ts double, last_fire double"
PENDING = "ts_s double, seq bigint, m double, level double"


@dataclass(frozen=True)
class Limits:
    radius_m: float = 4 * 1852.0
    depart_m: float = 200.0
    cooldown_s: float = 120.0
    silent_s: float = 90.0


class Visit:
    """What is known of an aircraft: its visit so far (``entered`` is None without one), its last fix and last report."""

    def __init__(self, limits: Limits, state: tuple | None = None):
        self.limits = limits
        self.entered, self.closest_ts, self.closest_m, self.peak, self.last_ts, self.last_fire = state or (None,) * 6

    def state(self) -> tuple:
        return (self.entered, self.closest_ts, self.closest_m, self.peak, self.last_ts, self.last_fire)

    def _end(self, ts: float) -> list[tuple]:
        out = (self.entered, self.closest_ts, self.closest_m, self.peak, ts)
        self.entered = None
        if self.last_fire is not None and ts - self.last_fire < self.limits.cooldown_s:
            return []
        self.last_fire = ts
        return [out]

    def silent(self, until: float) -> list[tuple]:
        """The report of a visit whose aircraft has said nothing up to ``until``."""
        if self.entered is None or until - self.last_ts < self.limits.silent_s:
            return []
        return self._end(self.last_ts + self.limits.silent_s)

    def see(self, ts: float, m: float, level: float | None) -> list[tuple]:
        """The reports that this fix brings about: one, or two if it ends a silence as well."""
        out, self.last_ts = self.silent(ts), ts
        if m <= self.limits.radius_m:
            if self.entered is None:
                self.entered, self.closest_ts, self.closest_m, self.peak = ts, ts, m, level
            else:
                if m < self.closest_m:
                    self.closest_ts, self.closest_m = ts, m
                if level is not None and (self.peak is None or level > self.peak):
                    self.peak = level
        if self.entered is not None and (m > self.closest_m + self.limits.depart_m or m > self.limits.radius_m):
            out = out + self._end(ts)
        return out

    def next_time(self) -> float | None:
        """When something happens without a fix: a silent visit ends, or a cool-down is over."""
        if self.entered is not None:
            return self.last_ts + self.limits.silent_s
        return None if self.last_fire is None else self.last_fire + self.limits.cooldown_s


def measured(fixes: DataFrame, lat0: float, lon0: float, level: Column | None = None) -> DataFrame:
    """hex, ts_s, seq, m (from the point) and level of fixes (hex, ts_s, seq, lat, lon)."""
    m = geo.haversine(F.col("lat"), F.col("lon"), lat0, lon0)
    return fixes.withColumn("m", m).withColumn("level", F.lit(None).cast("double") if level is None else level)


def _plain(x) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


class _Tracker(StatefulProcessor):
    """Fixes wait until the watermark has passed them, so that they are seen in order however they arrive."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visit = handle.getValueState("visit", VISIT)
        self.pending = handle.getListState("pending", PENDING)

    def _advance(self, key: tuple, new: list[tuple], watermark: float) -> Iterator[pd.DataFrame]:
        visit = Visit(self.limits, tuple(self.visit.get()) if self.visit.exists() else None)
        waiting = sorted([*(tuple(r) for r in self.pending.get()), *new], key=lambda r: r[:2])
        due = [r for r in waiting if r[0] < watermark]
        out = [x for ts, _, m, level in due for x in visit.see(ts, m, level)]
        waiting = waiting[len(due) :]
        out += visit.silent(min([watermark, *(r[0] for r in waiting)]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        at = visit.next_time()
        over = at is None or (visit.entered is None and at <= watermark)
        if waiting:
            self.pending.put(waiting)
        elif self.pending.exists():
            self.pending.clear()
        if over and not waiting:
            self.visit.clear()  # nothing that the aircraft may do later depends on what was
        else:
            self.visit.update(visit.state())
            times = [r[0] for r in waiting[:1]] + ([] if over else [at])
            self.handle.registerTimer(max(int(min(times) * 1000) + 1, int(watermark * 1000) + 1))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(float(t), int(s), float(m), _plain(v)) for pdf in rows for t, s, m, v in zip(pdf["ts_s"], pdf["seq"], pdf["m"], pdf["level"], strict=True)]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def track(rows: DataFrame, limits: Limits = Limits(), late: str = "1 minute") -> DataFrame:
    """Reports from a stream of measured fixes. State goes when no visit is open and the cool-down is over.

    Fixes more than ``late`` behind the newest are dropped; the session's state store must be RocksDB.
    """
    timed = rows.withColumn("ts", F.timestamp_micros((F.col("ts_s") * 1_000_000).cast("long"))).withWatermark("ts", late)
    return timed.groupBy("hex").transformWithStateInPandas(statefulProcessor=_Tracker(limits), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def track_batch(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same reports from stored fixes, which pass in order, a batch at a time; only the visit is carried on."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, visit = None, None
        for pdf in batches:
            out = []
            for hex_, ts, m, level in zip(pdf["hex"], pdf["ts_s"], pdf["m"], pdf["level"], strict=True):
                if hex_ != now:
                    out += [(now, *r) for r in visit.silent(float("inf"))] if visit else []
                    now, visit = hex_, Visit(limits)
                out += [(hex_, *r) for r in visit.see(float(ts), float(m), _plain(level))]
            yield pd.DataFrame(out, columns=COLUMNS)
        if visit and (last := visit.silent(float("inf"))):
            yield pd.DataFrame([(now, *r) for r in last], columns=COLUMNS)

    return rows.select("hex", "ts_s", "seq", "m", "level").repartition("hex").sortWithinPartitions("hex", "ts_s", "seq").mapInPandas(work, OUT)


def oracle(rows: str, limits: Limits) -> str:
    """The reports of the CTE ``rows`` (hex, ts_s, seq, m, level) in SQL: all aircraft take a step of a recursion together."""
    radius, depart, cool, silent = limits.radius_m, limits.depart_m, limits.cooldown_s, limits.silent_s
    return f"""nr AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY ts_s, seq) AS n FROM {rows}),
st AS (SELECT hex, 0::BIGINT AS n, false AS active, NULL::DOUBLE AS entered, NULL::DOUBLE AS closest_ts, NULL::DOUBLE AS closest_m, NULL::DOUBLE AS peak, NULL::DOUBLE AS last_ts, NULL::DOUBLE AS last_fire,
    false AS fire1, NULL::DOUBLE AS e1, NULL::DOUBLE AS c1, NULL::DOUBLE AS m1, NULL::DOUBLE AS p1, NULL::DOUBLE AS f1, false AS fire2, NULL::DOUBLE AS e2, NULL::DOUBLE AS c2, NULL::DOUBLE AS m2, NULL::DOUBLE AS p2
  FROM nr WHERE n = 1
  UNION ALL SELECT hex, n, act2 AND NOT dep, entered2, cts2, closest2, peak2, t, CASE WHEN fire2 THEN t ELSE lf1 END, fire1, entered, closest_ts, closest_m, peak, last_ts + {silent}, fire2, entered2, cts2, closest2, peak2
  FROM (SELECT *, dep AND (lf1 IS NULL OR t - lf1 >= {cool}) AS fire2 FROM (SELECT *, act2 AND (m > closest2 + {depart} OR m > {radius}) AS dep FROM (
    SELECT *, act1 OR near AS act2, CASE WHEN act1 THEN entered WHEN near THEN t END AS entered2, CASE WHEN act1 AND NOT (near AND m < closest_m) THEN closest_m WHEN near THEN m END AS closest2,
      CASE WHEN act1 AND NOT (near AND m < closest_m) THEN closest_ts WHEN near THEN t END AS cts2, CASE WHEN act1 AND near THEN greatest(peak, level) WHEN act1 THEN peak WHEN near THEN level END AS peak2
    FROM (SELECT *, active AND NOT quiet AS act1, CASE WHEN fire1 THEN last_ts + {silent} ELSE last_fire END AS lf1 FROM (
      SELECT *, quiet AND (last_fire IS NULL OR last_ts + {silent} - last_fire >= {cool}) AS fire1 FROM (
        SELECT st.hex, nr.n, active, entered, closest_ts, closest_m, peak, last_ts, last_fire, nr.ts_s AS t, nr.m, nr.level, nr.m <= {radius} AS near, coalesce(active AND nr.ts_s - last_ts >= {silent}, false) AS quiet FROM st JOIN nr ON nr.hex = st.hex AND nr.n = st.n + 1)))))))
, rp AS (SELECT hex, e1 AS entered, c1 AS closest_ts, m1 AS closest_m, p1 AS peak, f1 AS fired FROM st WHERE fire1 UNION ALL SELECT hex, e2, c2, m2, p2, last_ts FROM st WHERE fire2
  UNION ALL SELECT hex, entered, closest_ts, closest_m, peak, last_ts + {silent} FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY hex ORDER BY n DESC) = 1) WHERE active AND (last_fire IS NULL OR last_ts + {silent} - last_fire >= {cool}))"""
