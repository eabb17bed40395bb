"""Bottom-k sketches of word shingles: small fingerprints that merge, and estimate likeness.

A sketch keeps the ``k`` least distinct 64-bit hashes of a text's ``shingle``-word runs (a shorter text
is one run; a text without words has the empty sketch). The sketch of a union of texts' shingles is the
bottom k of their sketches' union, so sketches of parts merge in any order. A sketch of fewer than k
hashes is the whole set, and its estimates are exact; others have a standard error of about
sqrt(J (1 - J) / k) for resemblance J.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, gram_hashes, ranges, slices

SHINGLE = 5
K = 128
_LEAST = -(1 << 63)


def sketch(texts: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The k least distinct shingle hashes of every text, ascending."""
    words = Words(texts)
    n = words.counts()
    length = np.minimum(n, shingle)
    grams = np.where(n > 0, n - length + 1, 0)
    starts = ranges(words.first[:-1], grams)
    hashes = gram_hashes(words.hashes(), starts, np.repeat(length, grams))
    ends = np.cumsum(grams)
    out = []
    for a, b in zip((ends - grams).tolist(), ends.tolist(), strict=True):
        own = hashes[a:b]
        if b - a > 4 * k:  # repeats aside, the k least are among the first few
            part = np.unique(np.partition(own, 2 * k)[: 2 * k])
            out.append(part[:k] if len(part) >= k else np.unique(own)[:k])
        else:
            out.append(np.unique(own)[:k])
    return out


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of two shingle sets; two empty sets are alike."""
    both = np.concatenate([a, b])
    if not len(both):
        return 1.0
    both.sort()
    new = np.concatenate([[True], both[1:] != both[:-1]])
    seen = np.cumsum(new)
    size = min(k, int(seen[-1]))
    if max(len(a), len(b)) < k:  # whole sets
        size = int(seen[-1])
    return float(np.count_nonzero(~new & (seen <= size))) / size


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty a is contained."""
    if not len(a):
        return 1.0
    union = np.unique(np.concatenate([a, b]))[: k if max(len(a), len(b)) >= k else None]
    inside = np.isin(union, a)
    return float(np.count_nonzero(inside & np.isin(union, b))) / max(1, int(np.count_nonzero(inside)))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k, else (k - 1) / (the k-th least hash as a fraction)."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def merge(sketches: DataFrame, by: list[str], column: str = "fingerprint", k: int = K, salts: int = 64) -> DataFrame:
    """One sketch for each group of rows, in two steps so that no task holds a large group's parts at once."""

    def least(key, pdf):
        import pandas as pd

        best = np.zeros(0, np.uint64)
        for text in pdf[column]:
            best = np.unique(np.concatenate([best, decode(text)]))[:k]
        return pd.DataFrame([[*key[: len(by)], encode(best)]], columns=[*by, column])

    schema = sketches.select(*by, column).schema
    salted = sketches.withColumn("_salt", F.pmod(F.xxhash64(column), F.lit(salts)))
    return salted.groupBy(*by, "_salt").applyInPandas(least, schema).groupBy(*by).applyInPandas(least, schema)


def _edited(text: str, following: str) -> str:
    tail = len(text) // 3
    return text[: len(text) - tail] + following[:tail]


def _pair_rows(k: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, whose successor is still to come
        for batch in slices(batches, size=1 << 20):
            cols = [batch.column(c).to_pylist() for c in ("bucket", "copied", "doc_id", "text")]
            cols[3] = [t or "" for t in cols[3]]
            prints = sketch(pa.array(cols[3], pa.string()), k, shingle)
            rows = [*zip(*cols, prints, strict=True)]
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0] and not x[1]]
            if not pairs:
                continue
            edited = [_edited(x[3], y[3]) for x, y in pairs]
            changed = sketch(pa.array(edited, pa.string()), k, shingle)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([encode(x[4]) for x, _ in pairs], pa.string()),
                    pa.array(map(encode, changed), pa.string()),
                    pa.array([resemblance(x[4], c, k) for (x, _), c in zip(pairs, changed, strict=True)], pa.float64()),
                    pa.array([resemblance(x[4], y[4], k) for x, y in pairs], pa.float64()),
                    pa.array([distinct_shingles(x[4], k) for x, _ in pairs], pa.float64()),
                    pa.array([containment(x[4], c, k) for (x, _), c in zip(pairs, changed, strict=True)], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "contained_in_edited"],
            )

    return run


def _range(bounds: np.ndarray, cuts: np.ndarray) -> F.Column:
    """Of key and code: the range, counted from the greatest key; range i of keys is cut into cuts[i] by code."""
    if not len(bounds):
        own = F.lit(0)
    else:
        own = F.size(F.filter(F.array(*(F.lit(int(b)) for b in bounds)), lambda b: b > F.col("key")))
    pick = lambda values: F.get(F.array(*(F.lit(int(v)) for v in values)), own)
    share = F.floor((F.col("code") / F.lit(2.0**64) + 0.5) * pick(cuts))
    return (pick(np.cumsum(cuts) - cuts) + F.least(share, pick(cuts) - 1)).cast("int")


def _tags(docs: DataFrame, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash partitioning sends there."""
    ids = docs.sparkSession.range(64 * n).select(F.col("id").cast("int").alias("id"))
    rows = ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id")).collect()  # n rows
    tags = {r["part"]: r["id"] for r in rows}
    return [tags.get(i, i) for i in range(n)]


def fingerprint_edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Sketches of every text and of its edit, whose last third gives way to the next text's beginning.

    The next text is that of the next doc_id going down, and the first one's after the last; equal
    doc_ids follow each other by a hash of their texts, null ids come last. Null texts are empty.

    Documents are dealt into ranges of doc_id, as many as there are shuffle partitions, a range of one
    frequent id (such as null) being cut further by the hashes of texts; and the first document of a range
    also goes to the range before it. So texts move once, each range to a partition of its own, and no task
    sees all ids. What the driver learns of the documents is one id and hash for each range.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(_LEAST))).withColumn("code", F.xxhash64("text"))
    bounds = rows.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    frequent = {int(b) + 1 for b, after in zip(bounds, bounds[1:], strict=False) if b == after}  # ends the range of a frequent id
    bounds = np.array(sorted({int(b) for b in bounds} | frequent), np.int64)
    whole = np.ones(len(bounds) + 1, np.int64)
    found = rows.groupBy(_range(bounds, whole).alias("bucket")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    total = sum(r["n"] for r in found)
    cuts = whole.copy()
    for r in found:
        if r["low"] == r["high"]:
            cuts[r["bucket"]] = max(1, r["n"] * n // total)
    first = F.max(F.struct("key", F.bitwise_not("code").alias("code")))
    firsts = rows.groupBy(_range(bounds, cuts).alias("bucket")).agg(first.alias("first")).collect()
    heads = sorted((r["bucket"], r["first"]["key"], ~r["first"]["code"]) for r in firsts)
    before = [(key, code, heads[i - 1][0]) for i, (_, key, code) in enumerate(heads)]  # the first range's head goes to the last
    size = max(n, int(cuts.sum()))
    targets = docs.sparkSession.createDataFrame(before, "key long, code long, target int")  # one row for each range
    places = F.array(F.struct(F.col("range").alias("bucket"), F.lit(0).alias("copied")), F.struct(F.col("target").alias("bucket"), F.lit(1).alias("copied")))
    dealt = rows.withColumn("range", _range(bounds, cuts)).join(F.broadcast(targets), ["key", "code"], "left").withColumn("place", F.explode(places))
    dealt = dealt.select("doc_id", "text", "key", "code", "place.bucket", "place.copied").filter("bucket is not null")
    dealt = dealt.withColumn("tag", F.get(F.array(*map(F.lit, _tags(docs, size))), F.col("bucket")))
    return (
        dealt.repartition(size, "tag")
        .sortWithinPartitions("bucket", "copied", F.desc("key"), "code")
        .select("bucket", "copied", "doc_id", "text")
        .mapInArrow(
            _pair_rows(k, shingle),
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, contained_in_edited double",
        )
    )
