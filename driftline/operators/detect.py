"""Detectors over ordered fixes: low passes and what follows them, track phases, and the intent of recent movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import sequences as seqs


def low_passes(fixes: DataFrame, elev: Column, low: float = 250.0, high: float = 800.0) -> DataFrame:
    """Periods from the first fix below ``low`` feet above the field until one above ``high``, if that comes: places in the
    aircraft's order (from 0) of the first fix, the first lowest one, the fix that is above, and the start of the ascent.

    The ascent starts at the first fix from the lowest on after which two rise in a row, at most four after
    the end and three before the aircraft's last (null if none does). ``elev`` is the field's elevation.
    """
    w = seqs.by()
    agl = F.col("alt") - elev
    event = F.when(agl < low, "low").when(agl > high, "high")
    rises = (F.lead("alt").over(w) > F.col("alt")) & (F.lead("alt", 2).over(w) > F.lead("alt").over(w))
    rows = fixes.withColumns({"agl": agl, "state": F.last(event, ignorenulls=True).over(w), "idx": F.row_number().over(w) - 1, "size": F.count("*").over(Window.partitionBy("hex"))})
    rows = rows.withColumn("rise", F.when(rises, F.struct("idx", "t_ms")))
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns({"next_rise": F.min("rise").over(ahead), "after": F.lead("idx").over(w)})
    rows = seqs.islands(rows, seqs.changed("state"), "pass").filter("state = 'low'")
    bottom = F.struct("agl", "idx", "t_ms", "lat", "lon", "next_rise")
    out = rows.groupBy("hex", "pass").agg(F.min("idx").alias("start_idx"), F.min(bottom).alias("b"), F.max("after").alias("end_idx"), F.max("idx").alias("last_idx"), F.max("size").alias("size"))
    out = out.filter(F.col("end_idx") > F.col("last_idx"))  # passes that never end are open
    soon = F.col("b.next_rise.idx") < F.least(F.col("end_idx") + 5, F.col("size") - 3)
    return out.select(
        "hex",
        "start_idx",
        F.col("b.idx").alias("bottom_idx"),
        "end_idx",
        F.when(soon, F.col("b.next_rise.idx")).alias("ascent_idx"),
        F.when(soon, F.col("b.next_rise.t_ms") - F.col("b.t_ms")).alias("gap_s"),
        F.col("b.agl").alias("bottom_agl"),
        F.col("b.t_ms").alias("bottom_ts"),
        F.col("b.lat").alias("lat"),
        F.col("b.lon").alias("lon"),
    )


def touch_and_goes(passes: DataFrame, most_s: float = 90.0, most_fixes: int = 30) -> DataFrame:
    """Passes whose ascent starts soon after the lowest fix: in time, or in fixes where no time is known."""
    soon = F.when(F.col("gap_s").isNotNull(), F.col("gap_s") <= most_s).otherwise(F.col("ascent_idx") - F.col("bottom_idx") <= most_fixes)
    return passes.filter(F.col("ascent_idx").isNotNull() & soon)


def track_phases(fixes: DataFrame, elev: Column, low: float = 250.0, high: float = 800.0, least: int = 5) -> DataFrame:
    """One row for each aircraft of ``least`` fixes or more: heights above the field, descents from above ``high`` to below ``low``, ascents
    the other way, and what the track is: pattern, departure, arrival or overflight."""
    w, agl = seqs.by(), F.col("alt") - elev
    event = F.when(agl < low, "low").when(agl > high, "high")
    rows = fixes.withColumns({"agl": agl, "state": F.last(event, ignorenulls=True).over(w)})
    rows = rows.withColumn("before", F.lag("state").over(w))
    turn = lambda a, b: F.count_if((F.col("before") == a) & (F.col("state") == b))
    first, last = F.min_by("agl", seqs.place()) < low, F.max_by("agl", seqs.place()) < low
    out = rows.groupBy("hex").agg(F.count("*").alias("n"), F.min("agl").alias("agl_min"), F.max("agl").alias("agl_max"), turn("high", "low").alias("descents"), turn("low", "high").alias("ascents"), first.alias("first_low"), last.alias("last_low"))
    phase = F.when(F.col("first_low") & ~F.col("last_low"), "departure").when(~F.col("first_low") & F.col("last_low"), "arrival").when(~F.col("first_low") & ~F.col("last_low"), "overflight").otherwise("pattern")
    return out.filter(F.col("n") >= least).withColumn("phase", phase).drop("first_low", "last_low")


def wrapped(degrees: Column) -> Column:
    """An angle from -180 up to 180."""
    return degrees - 360 * F.floor((degrees + 180) / 360)


def intent_features(fixes: DataFrame, lat0: float, lon0: float, elev: float, runways: dict[str, float], n: int = 90, minute: float = 60.0) -> DataFrame:
    """Movement of each aircraft's last ``n`` fixes towards and around a field; ``minute`` is one in the unit of t_ms.

    closure_pct (share of the speed that closes in), turn_per_nm (headings' changes added up over the way),
    climb_fpm, alt_sd, at_pattern_alt, orbit_nm, directness, runway_off (degrees between the last heading and the nearest
    runway's) and runway_turn (signed).
    """
    w, ahead = seqs.by(), Window.partitionBy("hex").orderBy(F.desc("t_ms"), F.desc("seq"))
    f = fixes.withColumn("back", F.row_number().over(ahead)).filter(F.col("back") <= n)
    lag = lambda c: F.lag(c).over(w)
    dlat, dlon = F.col("lat") - lag("lat"), (F.col("lon") - lag("lon")) * F.cos(F.radians((F.col("lat") + lag("lat")) / 2))
    moved = (F.abs(dlat) >= 1e-7) | (F.abs(dlon) >= 1e-7)
    f = f.withColumns({"heading": F.when(moved, F.degrees(F.atan2(dlon, dlat))), "step": geo.planar_nm(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")), "nm": geo.planar_nm(F.col("lat"), F.col("lon"), lat0, lon0)})
    f = f.withColumn("turn", F.abs(wrapped(F.col("heading") - lag("heading"))))
    f = f.withColumn("end_heading", F.degrees(F.atan2((F.col("lon") - lag("lon")) * F.cos(F.radians("lat")), F.col("lat") - lag("lat"))))
    of, old, new = (lambda k, c: F.max(F.when(F.col("back") == k, F.col(c)))), (lambda c: F.max_by(c, "back")), (lambda c: F.min_by(c, "back"))
    g = f.groupBy("hex").agg(
        F.count("*").alias("n"),
        ((new("t_ms") - old("t_ms")) / minute).alias("minutes"),
        ((new("t_ms") - of(3, "t_ms")) / minute).alias("m3"),
        *(old(c).alias(f"{c}0") for c in ("lat", "lon", "alt", "nm")),
        *(new(c).alias(f"{c}1") for c in ("lat", "lon", "alt", "nm")),
        *(of(3, c).alias(f"{c}3") for c in ("lat", "lon")),
        F.coalesce(F.sum("turn"), F.lit(0.0)).alias("turned"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_nm"),
        F.stddev_pop("alt").alias("alt_sd"),
        F.coalesce(new("end_heading"), F.lit(0.0)).alias("heading"),
    )
    at = lambda a, b: geo.planar_nm(F.col(f"lat{a}"), F.col(f"lon{a}"), F.col(f"lat{b}"), F.col(f"lon{b}"))
    per = lambda x: F.when(F.col("minutes") > 0, x / F.col("minutes")).otherwise(0.0)
    g = g.withColumn("knots", F.when(F.col("n") >= 3, at(3, 1) * 60 / F.when(F.col("m3") != 0, F.col("m3")).otherwise(1.0)).otherwise(0.0))
    g = g.withColumns({"closure": per(F.col("nm0") - F.col("nm1")), "turn_rate": per(F.col("turned")), "climb_fpm": per(F.col("alt1") - F.col("alt0"))})
    way = F.when(F.col("minutes") > 0, F.col("knots") * F.col("minutes") / 60).otherwise(0.1)
    off = F.array_min(F.array(*(F.struct(F.abs(wrapped(F.col("heading") - h)).alias("off"), F.lit(i).alias("i"), wrapped(F.col("heading") - h).alias("turn")) for i, h in enumerate(runways.values()))))
    return g.select(
        "hex",
        "n",
        "closure",
        F.when(F.col("knots") > 10, F.col("closure") * 60 / F.col("knots") * 100).otherwise(0.0).alias("closure_pct"),
        F.when(way > 0.01, F.col("turned") / way).otherwise(0.0).alias("turn_per_nm"),
        "climb_fpm",
        "alt_sd",
        (F.abs(F.col("alt1") - (elev + 1000)) < 200).alias("at_pattern_alt"),
        F.when(F.col("turn_rate") > 10, F.col("knots") / 60 / F.radians("turn_rate")).otherwise(99.0).alias("orbit_nm"),
        F.when(F.col("path_nm") > 0.01, at(0, 1) / F.col("path_nm")).otherwise(1.0).alias("directness"),
        off["off"].alias("runway_off"),
        off["turn"].alias("runway_turn"),
        F.col("nm1").alias("dist_nm"),
        (F.col("alt1") - elev).alias("agl"),
        "knots",
    )


def intent(features: DataFrame) -> DataFrame:
    """features (with a ``purpose``) and the first rule that holds: intent, its confidence, and the leg of a pattern."""
    c = F.col
    rules = [
        ((c("purpose") == "tow_plane") & (c("turn_per_nm") > 200), "towing", 0.9),
        ((c("purpose") == "glider") & (c("dist_nm") > 3), "soaring", 0.8),
        (c("purpose") == "glider", "local_soaring", 0.7),
        ((c("dist_nm") < 3) & (c("turn_per_nm") > 150) & c("at_pattern_alt"), "pattern", 0.85),
        ((c("dist_nm") < 3) & (c("turn_per_nm") > 100), "pattern", 0.7),
        ((c("closure_pct") > 60) & (c("dist_nm") < 12) & (c("climb_fpm") < 0), "inbound", 0.8),
        ((c("closure_pct") > 40) & (c("dist_nm") < 15), "inbound", 0.6),
        ((c("closure_pct") < -60) & (c("dist_nm") < 5), "outbound", 0.8),
        ((c("closure_pct") < -30) & (c("dist_nm") < 8) & (c("climb_fpm") > 200), "outbound", 0.7),
        ((c("dist_nm") > 5) & (c("directness") < 0.4) & (c("alt_sd") > 100), "practicing", 0.75),
        ((c("dist_nm") > 5) & (c("closure_pct") > 20), "returning", 0.6),
        ((c("dist_nm") > 5) & (c("closure_pct") < -20), "to_practice", 0.6),
        ((c("purpose") == "airline") & (c("climb_fpm") > 100), "outbound", 0.6),
        (c("purpose") == "airline", "inbound", 0.6),
    ]
    found = F.lit(None).cast("struct<intent:string,confidence:double>")
    for holds, name, sure in reversed(rules):
        found = F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("intent"), F.lit(sure).alias("confidence"))).otherwise(found)
    found = F.coalesce(found, F.struct(F.lit("transit").alias("intent"), F.lit(0.4).alias("confidence")))
    turn, climb = c("runway_turn"), c("climb_fpm")
    across = F.abs(wrapped(turn - 90)) < 40
    leg = (
        F.when(c("agl") < 50, "on_runway")
        .when((c("agl") < 200) & (F.abs(turn) < 30) & (c("closure") > 0), "short_final")
        .when((F.abs(turn) < 30) & (climb < -200), "final")
        .when(across & (climb < -100), "base")
        .when((F.abs(turn - 180) < 40) | (F.abs(turn + 180) < 40), "downwind")
        .when(across & (climb > 100), "crosswind")
        .when((F.abs(turn) < 30) & (climb > 100), "upwind")
        .when((c("closure") > 0) & (c("dist_nm") > 1.5), "entering")
        .otherwise("maneuvering")
    )
    return features.withColumn("_found", found).select(*features.columns, "_found.intent", "_found.confidence").withColumn("leg", F.when(c("intent") == "pattern", leg))
