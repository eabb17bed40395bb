"""Domain scalar functions: look-ups, grades, buckets, rounding and level conversions as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Engine horsepower by type code (0 is silent), cruise speed in knots and description.
POWER = {
    "C140": 90.0, "C150": 100.0, "C152": 110.0, "C162": 100.0, "C172": 180.0, "C72R": 180.0, "C177": 180.0, "C182": 230.0, "C82R": 230.0, "C185": 300.0, "C206": 300.0, "C210": 300.0, "C240": 230.0,
    "DA40": 180.0, "DV20": 100.0, "SR20": 215.0, "SR22": 310.0, "S22T": 315.0, "SP20": 215.0, "COL3": 310.0, "COL4": 310.0, "M20P": 200.0, "M20T": 280.0,
    "P28A": 160.0, "P28B": 180.0, "P28R": 200.0, "P28T": 300.0, "P32R": 300.0, "PA11": 90.0, "PA12": 115.0, "PA16": 108.0, "PA18": 150.0, "BE35": 285.0, "BE36": 300.0, "AA5": 150.0,
    "CH7A": 118.0, "CH7B": 150.0, "CRUZ": 100.0, "T34P": 285.0, "T6": 600.0, "HUSK": 200.0, "RV4": 160.0, "RV6": 180.0, "RV7": 180.0, "RV8": 180.0, "RV12": 100.0, "LNC2": 200.0, "LGEZ": 180.0, "ERCO": 75.0,
    "BDOG": 200.0, "EAGL": 180.0, "FOX": 180.0, "ULAC": 100.0, "VL3": 100.0, "EXPR": 210.0, "AR65": 420.0, "BE55": 520.0, "BE76": 360.0, "BE40": 800.0, "C310": 520.0, "C421": 750.0, "C425": 900.0,
    "PA34": 440.0, "PA44": 360.0, "P337": 420.0, "P06T": 700.0, "SW3": 1400.0, "BE30": 1250.0, "B350": 2100.0, "PC12": 1200.0, "M600": 600.0, "TBM7": 700.0, "TBM8": 850.0, "TBM9": 850.0, "PA46": 350.0, "P46T": 500.0, "PAY1": 1000.0,
    "AC90": 1400.0, "C208": 675.0, "B38M": 8000.0, "B752": 10000.0, "C25C": 2500.0, "C25M": 2500.0, "C510": 1800.0, "C525": 2200.0, "C55B": 3000.0, "C560": 3500.0, "C56X": 3500.0, "C650": 4500.0, "C680": 4500.0, "C68A": 4500.0,
    "C700": 5000.0, "C750": 5500.0, "CL30": 4500.0, "CL35": 4500.0, "CL60": 5000.0, "E135": 5000.0, "E145": 5000.0, "E55P": 2500.0, "F2TH": 5000.0, "F900": 6000.0, "G200": 5000.0, "GLEX": 7000.0, "GLF4": 6500.0, "GLF5": 7000.0,
    "H25B": 5000.0, "HDJT": 1500.0, "LJ31": 3000.0, "LJ45": 3500.0, "LJ60": 4500.0, "LJ70": 4500.0, "R44": 245.0, "B06": 420.0, "B407": 700.0, "H500": 420.0, "AS50": 590.0, "UH1": 1400.0, "GLID": 0.0, "BALL": 0.0, "XNOS": 0.0, "COY2": 0.0,
}
CRUISE = {"C172": 122.0, "PA28": 128.0, "SR22": 180.0, "BE58": 200.0, "EC30": 130.0}
DESCRIPTION = {"C172": "Cessna 172", "PA28": "Piper Cherokee", "SR22": "Cirrus SR22", "BE58": "Beech Baron", "EC30": "Airbus EC130", "GLID": "Glider"}
DEFAULT_POWER, DEFAULT_CRUISE = 180.0, 110.0
# Ordered rules of the purpose classifier, and tenths of a mile that distances are rounded to.
PURPOSE_RULES = [("^(EC|R4|R2|B06|H)", "helicopter"), ("^GL", "glider"), ("^(C5|C6|C7|LJ|GL[FE])", "business"), ("^(BE5|BE7|PA4|C31|C4)", "ga_multi")]
FIBONACCI_TENTHS = [0.1, 0.2, 0.3, 0.5, 0.8, 1.3, 2.1, 3.4, 5.5, 8.9]


def lookup(key: Column, values: dict, default=None) -> Column:
    """A value from a small fixed table; ``default`` for other keys and null."""
    items = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*items), key), F.lit(default))


def horsepower(kind: Column) -> Column:
    return lookup(kind, POWER, DEFAULT_POWER)


def cruise_knots(kind: Column) -> Column:
    return lookup(kind, CRUISE, DEFAULT_CRUISE)


def describe_type(kind: Column) -> Column:
    return F.coalesce(lookup(kind, DESCRIPTION), kind)


def js_round(x: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def classify_purpose(kind: Column, school: Column, special: Column | None = None) -> Column:
    """A special use, else training for schools, else the first rule that the type matches, else ga_single."""
    out = F.when(school.isNotNull(), "training")
    if special is not None:
        out = F.when(special.isNotNull(), special).when(school.isNotNull(), "training")
    for pattern, name in PURPOSE_RULES:
        out = out.when(kind.rlike(pattern), name)
    return out.otherwise("ga_single")


def resolve_purpose(stored: Column, derived: Column) -> Column:
    return F.coalesce(F.when(stored != "unknown", stored), derived)


def impact_grade(index: Column) -> Column:
    return F.when(index < 0.3, "A").when(index < 0.6, "B").when(index < 1.2, "C").when(index < 2.0, "D").when(index.isNotNull(), "F")


def tier(score: Column) -> Column:
    return F.when(score >= 90, "Gold").when(score >= 75, "Silver").when(score >= 55, "Bronze").otherwise("Rising")


def load_score(load: Column, scale: float) -> Column:
    """100 for no load, falling exponentially; rounded half up."""
    return js_round(100 * F.exp(-F.greatest(F.lit(0.0), load) / scale)).cast("int")


def evidence_score(media: Column, precision: Column) -> Column:
    """Points for video or audio and for how precise the location is (1 to 3)."""
    points = F.when(media == "video", 5).when(media == "audio", 3).otherwise(0)
    return points + F.when(precision == 3, 5).when(precision == 2, 3).when(precision == 1, 1).otherwise(0)


def evidence_tier(score: Column) -> Column:
    return F.when(score >= 9, "gold").when(score >= 6, "silver").when(score >= 3, "bronze").otherwise("none")


def private_distance(miles: Column) -> Column:
    """The nearest of ten Fibonacci tenths, the smaller one on ties."""
    gaps = F.array(*(F.struct(F.round(F.abs(miles - v), 9).alias("gap"), F.lit(v).alias("value")) for v in FIBONACCI_TENTHS))
    return F.when(miles.isNotNull(), F.array_min(gaps)["value"])


def density_altitude_band(feet: Column) -> Column:
    return F.when(feet < 6000, "<6000").when(feet < 7000, "6000-6999").when(feet < 8000, "7000-7999").when(feet < 9000, "8000-8999").when(feet.isNotNull(), "9000+")


def hour_bucket(ms: Column) -> Column:
    return F.format_string("%02d:00", F.pmod(F.floor(ms / 3600000), F.lit(24)).cast("int"))


def local_hour(seconds: Column, offset_hours: int = -7) -> Column:
    return F.floor(F.pmod(seconds + offset_hours * 3600, F.lit(86400)) / 3600).cast("int")


def in_hours(hour: Column, start: int, end: int) -> Column:
    """Half-open range of hours that may wrap at midnight; start = end is empty."""
    if start == end:
        return F.lit(False)
    inside = (hour >= start) & (hour < end)
    return inside if start < end else (hour >= start) | (hour < end)


def rolling_id(text: Column) -> Column:
    """The last four hex digits, in capitals, of a 31-based 32-bit hash of the text's characters."""
    codes = F.transform(F.split(text, ""), F.ascii)
    total = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    return F.right(F.hex(total), F.lit(4))


def _hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 by two rounds of the hash over the padded key, as binary."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256))


def _web64(data: Column) -> Column:
    """Base64 with - and _, without padding."""
    return F.translate(F.base64(data), "+/=", "-_")


def signed_token(key: bytes, payload: Column) -> Column:
    """payload in base64, a dot, and the first 16 characters of its signature."""
    return F.concat(_web64(payload.cast("binary")), F.lit("."), F.substring(_web64(_hmac(key, payload)), 1, 16))


def verified_payload(key: bytes, token: Column) -> Column:
    """The payload of a token whose signature is right and whose form is ``name|whole number``; else null."""
    body, mark = F.split_part(token, F.lit("."), F.lit(1)), F.split_part(token, F.lit("."), F.lit(2))
    payload = F.try_validate_utf8(F.unbase64(F.translate(body, "-_", "+/")).cast("string"))
    good = (F.length(token) - F.length(F.replace(token, F.lit("."))) == 1) & body.rlike("^[A-Za-z0-9_-]+$") & (F.length(body) % 4 != 1)
    payload = F.when(good, payload)
    return F.when((F.substring(_web64(_hmac(key, payload)), 1, 16) == mark) & payload.rlike(r"^[^|]+\|[0-9]+$"), payload)


def age_fade(age: Column, span: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - age / span)


def a_weighting(hz: Column) -> Column:
    """Decibels by which the ear discounts a frequency."""
    f2 = hz * hz
    response = (F.lit(12194.0) ** 2 * f2 * f2) / ((f2 + 20.6**2) * F.sqrt((f2 + 107.7**2) * (f2 + 737.9**2)) * (f2 + 12194.0**2))
    return 20 * F.log10(response) + 2.0


def spl(dbfs: Column) -> Column:
    return (dbfs + 94) * 1.5


def palette_index(share: Column, size: int = 256) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (size - 1)).cast("int")


def first_word(name: Column) -> Column:
    return F.get(F.split(F.trim(name), r"\s+"), F.lit(0))


def tail_number(registration: Column, flight: Column, hexcode: Column) -> Column:
    """The first that is not blank, trimmed, in capitals."""
    clean = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    return F.coalesce(clean(registration), clean(flight), clean(hexcode))


def grid_cell(lat: Column, lon: Column, bounds: dict, rows: int, cols: int, nearest: bool) -> tuple[Column, Column]:
    """(row, col) with row 0 in the north; ``nearest`` rounds to a cell's corner, else cells are half-open."""
    up = (bounds["lat_max"] - lat) / (bounds["lat_max"] - bounds["lat_min"])
    along = (lon - bounds["lon_min"]) / (bounds["lon_max"] - bounds["lon_min"])
    if nearest:
        return F.floor(up * (rows - 1) + 0.5).cast("int"), F.floor(along * (cols - 1) + 0.5).cast("int")
    return F.floor(up * rows).cast("int"), F.floor(along * cols).cast("int")
