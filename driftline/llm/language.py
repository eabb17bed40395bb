"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are a lower-cased text's 1- to 3-grams of characters, hashed into ``WIDTH`` columns, weighted
by (1 + log tf) * idf and scaled to unit length. Document frequencies are counted over all documents that
may be learnt from. The regression follows the regularised leader (FTRL-proximal) with elastic-net
penalties, which keeps most weights at exactly zero, on at most ``PER_LANGUAGE`` documents of each
language (those with the least hash of id and text, rows of one id and text once; the bound is the only use
of a sample). Rows whose hash is above what ``PER_LANGUAGE`` of a language's count would need, with a margin,
are left out where they are read, so what is compared does not grow with the corpus. One in five
of them is kept back, and a single temperature is chosen on these by their log-loss.

Null texts and texts without a letter are ``und`` with score 0; where nothing can be learnt, all are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .textkit import mix, slices

WIDTH = 1 << 13
PER_LANGUAGE = 500
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 1e-4
_EPOCHS = 4
_SLICE, _ROWS = 1 << 19, 512


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, times) of all distinct hashed n-grams, in order of text and column."""
    lowered = [t.lower() for t in texts]
    n = np.array([len(t) for t in lowered], np.int64)
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), n)
    total = np.zeros(len(texts) * WIDTH, np.int64)
    for size in (1, 2, 3):
        if len(chars) < size:
            break
        end = len(chars) - size + 1
        code = np.full(end, size, np.uint64)
        for i in range(size):
            code = (code << np.uint64(20)) ^ chars[i : i + end]
        whole = doc[:end] == doc[size - 1 :]
        column = (mix(code) & np.uint64(WIDTH - 1)).astype(np.int64)
        total += np.bincount((doc[:end] * WIDTH + column)[whole], minlength=len(total))
    key = np.flatnonzero(total)
    return key // WIDTH, key % WIDTH, total[key]


def _weighted(texts: list[str], idf: np.ndarray):
    doc, column, times = _grams(texts)
    value = (1 + np.log(times)) * idf[column]
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=len(texts)))
    return doc, column, value / np.maximum(norm, 1e-12)[doc]


def _pylist(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _df_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(WIDTH, np.int64), 0
    for batch in slices(batches, size=_SLICE, rows=_ROWS):
        total += np.bincount(_grams(_pylist(batch))[1], minlength=WIDTH)
        n += len(batch)
    column = np.append(np.flatnonzero(total), -1)
    yield pa.RecordBatch.from_arrays([pa.array(column.astype(np.int32)), pa.array(np.append(total[total > 0], n))], names=["column", "n"])


def _feature_rows(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=_SLICE, rows=_ROWS):
            doc, column, value = _weighted(_pylist(batch), idf)
            at = pa.array(np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("code"), pa.ListArray.from_arrays(at, pa.array(column.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32)))],
                names=["lang", "code", "columns", "values"],
            )

    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows, labels: np.ndarray, classes: int, seed: int = 5) -> np.ndarray:
    """Weights (columns + bias row, classes) of FTRL-proximal with elastic net over sparse rows."""
    z, n = np.zeros((WIDTH + 1, classes)), np.zeros((WIDTH + 1, classes))
    penalty = np.full((WIDTH + 1, 1), L1)
    penalty[-1] = 0  # the bias

    def weights(at):
        shrunk = np.maximum(np.abs(z[at]) - penalty[at], 0) * np.sign(z[at])
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    rng = np.random.default_rng(seed)
    for _ in range(_EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], WIDTH), np.append(rows[i][1], 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[labels[i]] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(WIDTH + 1))


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log-loss, by golden-section search over its logarithm."""
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    low, high, ratio = np.log(0.05), np.log(5.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE):
    """(languages, idf, weights, temperature) from rows of text and lang, or None if no row has a lang."""
    labelled = docs.filter("lang is not null and text is not null")
    counted = labelled.select("text").mapInArrow(_df_rows, "column int, n long").groupBy("column").agg(F.sum("n").alias("n")).toArrow()
    frequency = dict(zip(counted["column"].to_pylist(), counted["n"].to_pylist(), strict=True))
    total = frequency.pop(-1, 0)
    if not total:
        return None
    df = np.zeros(WIDTH)
    df[list(frequency)] = list(frequency.values())
    idf = np.log((1 + total) / (1 + df)) + 1

    # a language's count is one row; ``low`` is the part of hashes that holds per_language rows, and a margin
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    low = F.least(F.lit(1.0), (per_language + 10 * F.lit(float(per_language)).cast("double") ** 0.5) / F.col("n"))
    near = labelled.withColumn("code", F.xxhash64("doc_id", "text")).join(F.broadcast(counts.select("lang", low.alias("low"))), "lang")
    near = near.filter(F.col("code") / float(1 << 64) + 0.5 <= F.col("low")).select("lang", "code", "text")
    once = near.mapInArrow(_feature_rows(idf), "lang string, code long, columns array<int>, values array<float>").dropDuplicates(["lang", "code"])
    found = once.toArrow().sort_by([("code", "ascending"), ("lang", "ascending")])
    place: dict[str, int] = {}
    places = []
    for name in found["lang"].to_pylist():
        place[name] = place.get(name, 0) + 1
        places.append(place[name])
    kept = np.array(places, np.int64) <= per_language
    found, places = found.filter(pa.array(kept, pa.bool_())), np.array(places, np.int64)[kept]
    languages = sorted(set(found["lang"].to_pylist()))
    y = np.array([languages.index(x) for x in found["lang"].to_pylist()])
    columns, values = found["columns"].combine_chunks(), found["values"].combine_chunks()
    at, flat, flat_values = np.asarray(columns.offsets), columns.values.to_numpy(), values.values.to_numpy().astype(np.float64)
    parts = [(flat[a:b], flat_values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    kept_back = places % 5 == 0
    fitted = [i for i in range(len(y)) if not kept_back[i]]
    weights = follow_the_leader([parts[i] for i in fitted], y[fitted], len(languages))
    back = np.flatnonzero(kept_back)
    temperature = 1.0
    if len(back) and len(languages) > 1:
        logits = np.stack([parts[i][1] @ weights[parts[i][0]] + weights[-1] for i in back])
        temperature = calibrate(logits, y[back])
    return languages, idf, weights, temperature


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, idf, weights, temperature = model.value
        for batch in slices(batches, size=_SLICE, rows=_ROWS):
            texts = _pylist(batch)
            doc, column, value = _weighted(texts, idf)
            logits = np.tile(weights[-1], (len(texts), 1))
            for c in range(len(languages)):
                logits[:, c] += np.bincount(doc, weights=value * weights[column, c], minlength=len(texts))
            chance = _softmax(logits / temperature)
            best = chance.argmax(axis=1)
            letters = [any(map(str.isalpha, t)) for t in texts]
            names = [languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters, strict=True)]
            score = np.where(letters, chance[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the calibrated probability of lang_pred) of every row of docs.

    ``held_out``, a Column over doc_id, names the rows not to learn from; by default crc32 of the id modulo
    4 is 2.
    """
    if held_out is None:
        held_out = fold(F.col("doc_id")) % 4 == 2
    held_out = F.coalesce(held_out, F.lit(False))
    model = train(docs.filter(~held_out).select("doc_id", "text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        out = rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        out = rows.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
