"""Personal data by pattern, and by bootstrapping from the contexts of what the patterns find.

*Seeds.* E-mail addresses, IP addresses, payment cards and phone numbers that fixed patterns find in the
whole text (leftmost, not overlapping within a kind), and long lower-case hexadecimal keys (``secret``).

*Lexical patterns.* A slot of a text has up to three: its two words before, the word on either side, and its
two words after, lower-cased (A-Z). Patterns are 64-bit hashes.

*Instances.* Whatever looks like an identifier may fill a slot: runs of digits and separators, words with a
digit or an at sign, quoted words and "name at host". Seeds and these candidates are the instances; which
kinds a candidate may be of follows from its characters alone (``_admissible``), so forms that no seed has
can be found.

*Bootstrapping.* Spark keeps the graph of distinct (pattern, instance) pairs and scores it by turns. A
pattern's score for a kind is that kind's share of all that fills its slots: its instances' scores over the
number of its instances and of the plain words in it, which one more pass over the texts counts. Patterns
need ``SUPPORT`` seeds or trusted instances, so that what one turn finds teaches patterns in the next. An
instance's score is the noisy-or of the best pattern of each side that scores ``CONFIDENT`` or more, for the
kinds it may be of; seeds stay at 1. After ``ROUNDS`` turns, candidates that score ``TRUST`` or more are personal data of
their best kind, wherever they occur.

Everything that meets in a shuffle is a pair of the graph or a count, summed map-side; a pattern as common
as "in the" is one row of an aggregate. Up to ``WATCH`` patterns are broadcast for the counting; more are
joined with the counts of all slots. Texts move in no step of ``find``, and every scan is linear in a text.

Null and empty texts have no spans. Repeated rows each get their own.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, row_key
from .textkit import Tally, Words, mix, signed, slices

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
ROUNDS = 3
SUPPORT = 3
TRUST = 0.9
CONFIDENT = 0.4
FEW = 10_000
WATCH = 4_000_000
_SMOOTH = 1.0
_SECRET = len(BASE)
_NO = -1

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])")
_NUMBER = re.compile(r"[+(]?[0-9]++(?:(?:[\x20.-]|\)[\x20-]?|\x20?\()[0-9]++)*+")
_AT = re.compile(r"\s[Aa][Tt]\s|[\[({][Aa][Tt][\])}]")
_HOST = re.compile(r"[A-Za-z][A-Za-z0-9-]*+(?:(?:\.|\s[Dd][Oo][Tt]\s)[A-Za-z0-9-]++)*+")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WRAP = "\"'`([{<>}])“”„«»"
_END = ".,;:!?"
_JOIN = "-_/@=&#"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the at signs."""
    out, since, at = [], 0, text.find("@")
    while at >= 0:
        name = text[since:at]
        start = since + len(name.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        since = at + 1
        if domain:
            out.append((start, domain.end()))
            since = domain.end()
        at = text.find("@", since)
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of all that the fixed patterns find, by start, then kind."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def seed_spans(text: str) -> list[tuple[int, int, int]]:
    """base_spans and the secrets that overlap none of them."""
    base = base_spans(text)
    keys = [m.span() for m in _HEX.finditer(text) if _DIGIT.search(m[0]) and not m[0].isdigit()] if len(text) >= 32 else []
    if not keys:
        return base
    held = _Taken(base)
    return sorted([*base, *((a, b, _SECRET) for a, b in keys if held.free(a, b))], key=lambda s: (s[0], s[2]))


class _Taken:
    """Stretches of a text that are taken."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b, *_ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a


def _numbers(text: str) -> list[tuple[int, int]]:
    """Digits and separators of six digits or more that are not part of a longer word."""
    out = []
    joined = lambda c: c.isalnum() or c in _JOIN
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        if b - a >= 6 and len(_NOT_DIGIT.sub("", m[0])) >= 6 and not (a and joined(text[a - 1])) and not (b < len(text) and joined(text[b])):
            out.append((a, b))
    return out


def _spoken(text: str) -> list[tuple[int, int]]:
    """"name at host", the sign being a word or in brackets."""
    out, since = [], 0
    for m in _AT.finditer(text):
        if m.start() < since:
            continue
        name = text[since : m.start()]
        start = since + len(name.rstrip(_LOCAL))
        host = _HOST.match(text, m.end()) if m.start() - start >= 2 else None
        since = m.start()
        if host:
            out.append((start, host.end()))
            since = host.end()
    return out


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The word without the punctuation around it."""
    word = text[a:b]
    left = word.lstrip(_WRAP)
    a += len(word) - len(left)
    return a, a + len(left.rstrip(_WRAP + _END))


def _candidates(text: str, taken: list[tuple[int, int, int]], words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that may be identifiers and overlap no seed; ``words`` has a digit, an at sign or quotes in each."""
    held = _Taken(taken)
    out = [(a, b) for a, b in (_numbers(text) if words else []) if held.free(a, b)]
    for source in ([_trimmed(text, a, b) for a, b in words], _spoken(text)):
        held = _Taken([*taken, *out])
        out += [(a, b) for a, b in source if b - a >= 3 and held.free(a, b) and (b - a >= 6 or "@" in text[a:b] or not text[a:b].isdigit())]
    return sorted(out)


def _admissible(value: str) -> list[int]:
    """The kinds that a candidate may be of."""
    if _NUMBER.fullmatch(value):
        n, dots = len(_NOT_DIGIT.sub("", value)), value.count(".")
        if dots == 3 and n <= 12 and not set(value) & set(" ()+-"):
            return [1, 3] if n >= 7 else [1]
        return [k for k, fits in ((2, 12 <= n <= 19 and not set(value) & set(".()+")), (3, 7 <= n <= 15)) if fits]
    if "@" in value or _AT.search(value):
        return [0]
    return [_SECRET] if len(value) >= 8 and not re.search(r"\s", value) else []


def _slots(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The three patterns (0 where the text ends before) of slots of words low..high in texts of words first..last-1."""
    at = lambda i: hashes[np.clip(i, 0, max(len(hashes) - 1, 0))]
    out = np.zeros((len(low), 3), np.uint64)
    sides = ((low - 2, low - 1), (low - 1, high + 1), (high + 1, high + 2))
    for kind, (a, b) in enumerate(sides):
        inside = (a >= first) & (b < last)
        code = mix(at(a) * np.uint64(0x9E3779B97F4A7C15) + mix(at(b) + np.uint64(kind)))
        out[:, kind] = np.where(inside, code & ~np.uint64(3) | np.uint64(kind + 1), 0)  # the side is in the last two bits
    return out


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int8())])
_INSTANCE = pa.struct(
    [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int8()), ("value", pa.int64()), ("kinds", pa.list_(pa.int8())), ("single", pa.bool_()), ("patterns", pa.list_(pa.int64()))]
)


def _found_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        words = Words(batch.column("text"), lower=True)
        hashes = words.hashes()
        char = np.cumsum((words.data & 0xC0) != 0x80)  # characters up to and with each byte
        marks = np.concatenate([[0], np.cumsum(((words.data >= 48) & (words.data <= 57)) | (words.data == 64) | (words.data == 34))])
        odd = np.flatnonzero(marks[words.ends] > marks[words.starts])
        bounds = np.searchsorted(odd, words.first)
        seeds, rows, place = [], [], []
        for i, text in enumerate(texts):
            own = seed_spans(text)
            seeds.append([{"start": a, "end": b, "kind": k} for a, b, k in own])
            base = words.offsets[i]
            before = char[base - 1] if base else 0
            picked = odd[bounds[i] : bounds[i + 1]]
            near = list(zip((char[words.starts[picked]] - 1 - before).tolist(), (char[words.ends[picked] - 1] - before).tolist(), strict=True))
            seen = sorted([*own, *((a, b, _NO) for a, b in _candidates(text, own, near))])
            if seen:
                ends = np.array([(a, b) for a, b, _ in seen], np.int64)
                plain = len(text) == words.offsets[i + 1] - base
                where = None if plain else np.append(np.flatnonzero((words.data[base : words.offsets[i + 1]] & 0xC0) != 0x80), words.offsets[i + 1] - base)
                place.append(base + (ends if plain else where[ends]))
                rows.append([{"start": a, "end": b, "kind": k, "value": _code(text[a:b]), "kinds": _admissible(text[a:b]) if k < 0 else [k]} for a, b, k in seen])
            else:
                rows.append([])
        if place:
            spans = np.concatenate(place)
            doc = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
            low = np.searchsorted(words.ends, spans[:, 0], "right")
            high = np.maximum(np.searchsorted(words.starts, spans[:, 1], "left") - 1, low)
            codes = _slots(hashes, low, high, words.first[doc], words.first[doc + 1]).view(np.int64).tolist()
            for instance, single, code in zip((x for r in rows for x in r), (low == high).tolist(), codes, strict=True):
                instance["single"] = single
                instance["patterns"] = [c for c in code if c]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(seeds, pa.list_(_SPAN)), pa.array(rows, pa.list_(_INSTANCE))], names=["row", "doc_id", "seeds", "instances"])


def _code(value: str) -> int:
    code = xxhash.xxh64_intdigest(value)
    return code - (1 << 64) if code >> 63 else code


def extract(docs: DataFrame, row=None) -> DataFrame:
    """Per row of docs: row (by default its place in the scan), doc_id, seeds, and instances with their patterns."""
    row = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", row)
    span = "start: int, end: int, kind: tinyint"
    return rows.mapInArrow(
        _found_rows,
        f"row long, doc_id long, seeds array<struct<{span}>>, instances array<struct<{span}, value: bigint, kinds: array<tinyint>, single: boolean, patterns: array<bigint>>>",
    )


def _slot_rows(watched):
    """(pattern, n): how often each pattern surrounds a single word; only watched patterns, if any are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, wanted, maybe = Tally(), None, None
        if watched is not None:
            wanted = np.frombuffer(watched.value, np.uint64)
            maybe = np.zeros(1 << 24, bool)
            maybe[wanted >> np.uint64(40)] = True
        for batch in slices(batches):
            words = Words(batch.column("text"), lower=True)
            at = np.arange(len(words.starts))
            n = words.counts()
            codes = _slots(words.hashes(), at, at, np.repeat(words.first[:-1], n), np.repeat(words.first[1:], n)).ravel()
            if wanted is not None:
                codes = codes[maybe[codes >> np.uint64(40)]]
                codes = codes[wanted[np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)] == codes]
            tally.add(codes[codes > 0])
        keys, counts = tally.settle()
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([signed(keys[i : i + 50_000]), pa.array(counts[i : i + 50_000])], names=["pattern", "n"])

    return run


def _plain(docs: DataFrame, patterns: DataFrame, flat: DataFrame) -> DataFrame:
    """(pattern, plain): the number of plain words in each pattern's slots."""
    watched = None
    if patterns.count() <= WATCH:
        codes = np.sort(patterns.select("pattern").toArrow()["pattern"].to_numpy().view(np.uint64))
        watched = docs.sparkSession.sparkContext.broadcast(codes.tobytes())
    every = docs.select("text").mapInArrow(_slot_rows(watched), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("every"))
    # an instance of several words is counted with its first word's left slot and its last one's right slot
    own = flat.select("single", F.explode("patterns").alias("pattern")).filter("single or (pattern & 3) <> 2").groupBy("pattern").agg(F.count("*").alias("own"))
    joined = patterns.join(every, "pattern", "left").join(own, "pattern", "left")
    return joined.select("pattern", "degree", F.greatest(F.lit(0), F.coalesce("every", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("plain"))


def bootstrap(docs: DataFrame, extracted: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """(value, kind, score) of the candidates that the pattern-instance graph trusts; value is the text's hash."""
    flat = extracted.select(F.explode("instances").alias("i")).select("i.kind", "i.value", "i.kinds", "i.single", "i.patterns")
    edges = cut(flat.select("kind", "value", "kinds", F.explode("patterns").alias("pattern")).distinct())
    degree = cut(edges.groupBy("pattern").agg(F.countDistinct("value").alias("degree")).filter(F.col("degree") >= support))
    edges = cut(edges.join(degree.select("pattern"), "pattern"))
    filled = cut(_plain(docs, degree, flat))
    seeds = edges.filter("kind >= 0").select("kind", "value", F.lit(1.0).alias("score"))
    allowed = edges.filter("kind < 0").select(F.explode("kinds").alias("kind"), "value", "pattern")
    links = cut(allowed.unionByName(edges.filter("kind >= 0").select("kind", "value", "pattern")).distinct())
    scores = seeds.distinct()
    for _ in range(rounds):
        mass = links.join(scores, ["kind", "value"]).groupBy("kind", "pattern").agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= trust).alias("trusted"))
        pattern = mass.join(filled, "pattern").filter(F.col("trusted") >= support)
        pattern = pattern.select("kind", "pattern", (F.col("mass") / (F.col("degree") + F.col("plain") + _SMOOTH)).alias("weight")).filter(F.col("weight") >= CONFIDENT)
        side = allowed.join(pattern, ["kind", "pattern"]).groupBy("kind", "value", F.col("pattern").bitwiseAND(3).alias("side")).agg(F.max("weight").alias("weight"))
        noisy = side.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log1p(-F.least("weight", F.lit(0.999)))))).alias("score"))
        scores = cut(seeds.unionByName(noisy.select("kind", "value", "score")).groupBy("kind", "value").agg(F.max("score").alias("score")))
    found = scores.join(seeds.select("kind", "value").distinct(), ["kind", "value"], "left_anti").filter(F.col("score") >= trust)
    best = found.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("rank"))).alias("best"))
    return best.select("value", (-F.col("best.rank")).cast("tinyint").alias("kind"), F.col("best.score").alias("score"))


def _discovered(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """(row, more): the spans that the bootstrap adds, of the rows that get any."""
    candidates = extracted.select("row", F.explode("instances").alias("i")).filter("i.kind < 0").select("row", "i.value", "i.start", "i.end")
    spans = candidates.join(bootstrap(docs, extracted), "value").select("row", F.struct("start", "end", "kind").alias("span"))
    return spans.groupBy("row").agg(F.collect_set("span").alias("more"))


def find(docs: DataFrame, row=None) -> DataFrame:
    """Per row of docs: row, doc_id, base and spans (arrays of start, end, kind), spans holding base, secrets
    and what the bootstrap adds, by start, then kind.
    """
    extracted = cut(extract(docs, row))
    joined = extracted.select("row", "doc_id", "seeds").join(_discovered(docs, extracted), "row", "left")
    every = F.concat("seeds", F.coalesce("more", F.expr("cast(array() as array<struct<start: int, end: int, kind: tinyint>>)")))
    ordered = F.transform(F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return joined.select("row", "doc_id", F.filter("seeds", lambda s: s["kind"] < _SECRET).alias("base"), ordered.alias("spans"))


def _named(spans):
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"].cast("int")), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the fixed patterns), spans (all of them) and
    n_spans of every document."""
    found = find(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_named("base").cast("binary"), 256).alias("base_sha256"), _named("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def masked(text: str | None, spans: list[dict]) -> str | None:
    """The text with each stretch of overlapping spans replaced by its first span's kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"], s["kind"]])
    for start, end, kind in merged:
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def _masked_rows(more: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, extra in zip(batch.column("text").to_pylist(), batch.column(more).to_pylist(), strict=True):
                seeds = [{"start": a, "end": b, "kind": k} for a, b, k in seed_spans(text or "")]
                texts.append(masked(text, [*seeds, *(extra or [])]))
            names = [n for n in batch.schema.names if n != more]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return run


def mask(docs: DataFrame) -> DataFrame:
    """docs with all personal data in ``text`` replaced; other columns stay.

    What the fixed patterns find needs no join. Documents in which the bootstrap found more are joined by
    row; their spans are broadcast where there are ``FEW`` such documents at most, else shuffled.
    """
    row, more = fresh(docs, "_row"), fresh(docs, "_more")
    extracted = cut(extract(docs, row_key()))
    extra = cut(_discovered(docs, extracted).select(F.col("row").alias(row), F.col("more").alias(more)))
    extra = F.broadcast(extra) if extra.limit(FEW + 1).count() <= FEW else extra
    return docs.withColumn(row, row_key()).join(extra, row, "left").select(*docs.columns, more).mapInArrow(_masked_rows(more), docs.schema)
