"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its lower-cased words, hashed into ``WORDS`` columns with a common weight of unit
length, followed by statistics of its structure (shares of letter cases, digits, punctuation marks and
doubled marks, line and word lengths, repeats among words and lines) and of its size. The score of a
feature vector x is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

so pairwise interactions of all features cost one pass over those that a text has.

The model is fitted by AdaGrad on at most ``SAMPLE`` labelled ids (those with the least hash; that bound is the
only use of a sample; of several texts of one id, that with the greatest hash) and is a fixed number of
floats, whatever the corpus.
Labels are joined to documents by broadcasting only the sampled ids. Learning sees nothing of a
document but its text.

Null and empty texts have the all-zero word part and are scored by the rest. Without labelled rows, or
with labels of one kind only, the score is the share of label 1 (1 where there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold
from .textkit import SPACE, Words, slices, utf8

WORDS = 1 << 14
RANK = 8
SAMPLE = 6000
CUTOFF = 0.3
_EPOCHS = 12
_RATE = 0.08
_DECAY = 2e-5
_MARKS = b".,;:!?|#$%&*+-=_/\\<>()[]{}\"'@~^"


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def statistics(texts: pa.Array) -> np.ndarray:
    """Structure statistics and size of every text, about in [-1, 1]."""
    data, at = utf8(texts)
    words = Words(texts)
    size = np.maximum(np.diff(at), 1)
    n = np.maximum(words.counts(), 1)
    length = (words.ends - words.starts).astype(np.float64)
    lengths = np.concatenate([[0.0], np.cumsum(length)])
    mean = (lengths[words.first[1:]] - lengths[words.first[:-1]]) / n
    final = data[words.ends - 1] if len(words.ends) else data
    doubled = np.zeros(len(words.starts), bool)
    long_ = length > 2
    e = words.ends[long_]
    doubled[long_] = (data[e - 1] == data[e - 2]) & np.isin(data[e - 1], np.frombuffer(_MARKS, np.uint8))
    upper = (data >= 65) & (data <= 90)
    newline = data == 10
    line = _per_text(newline, at) + 1
    hashes = words.hashes()
    distinct, repeated_lines = [], []
    for i, text in enumerate(texts.to_pylist()):
        own = hashes[words.first[i] : words.first[i + 1]]
        distinct.append(len(np.unique(own)) / max(len(own), 1))
        rows = (text or "").split("\n")
        repeated_lines.append(1 - len(set(rows)) / len(rows))
    columns = [
        _per_text(upper, at) / size,
        _per_text((data >= 48) & (data <= 57), at) / size * 4,
        _per_text(data >= 128, at) / size * 2,
        _per_text(newline, at) / size * 8,
        np.log1p(size) / 12,
        np.log1p(words.counts()) / 10,
        np.minimum(mean, 30) / 15,
        np.log1p(size / line) / 8,
        np.array(distinct),
        np.array(repeated_lines),
        _per_text(doubled, words.first) / n,
        _per_text(SPACE[data], at) / size,
        *(_per_text(data == c, at) / size * 8 for c in _MARKS),
        *(_per_text(final == c, words.first) / n for c in b".,!|#%"),
    ]
    return np.clip(np.stack(columns, axis=1), 0, 2)


N_STATS = 12 + len(_MARKS) + 6


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, columns, values) of the sparse word part, then dense statistics follow as columns too."""
    words = Words(texts, lower=True)
    column = (words.hashes() & np.uint64(WORDS - 1)).astype(np.int64)
    n = len(texts)
    key = np.unique(np.repeat(np.arange(n), words.counts()) * WORDS + column)
    doc, column = key // WORDS, key % WORDS
    count = np.bincount(doc, minlength=n)
    value = 1 / np.sqrt(count[doc])
    stats = statistics(texts)
    offsets = np.concatenate([[0], np.cumsum(count + N_STATS)])
    columns, values = np.zeros(offsets[-1], np.int32), np.zeros(offsets[-1], np.float32)
    own = np.arange(len(key)) + doc * N_STATS
    columns[own], values[own] = column, value
    at = (offsets[1:, None] - N_STATS + np.arange(N_STATS)).ravel()
    columns[at], values[at] = np.tile(WORDS + np.arange(N_STATS), n), stats.ravel()
    return offsets, columns, values


def margins(model, offsets, columns, values) -> np.ndarray:
    """The machine's output before the logistic, for every row."""
    bias, weights, factors = model
    at = offsets[:-1]
    linear = np.add.reduceat(weights[columns] * values, at)
    vx = factors[columns] * values[:, None]
    sums, squares = np.add.reduceat(vx, at, axis=0), np.add.reduceat(vx * vx, at, axis=0)
    return bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7):
    """(bias, weights, factors) by AdaGrad on the logistic loss, one batch of rows at a time."""
    rng = np.random.default_rng(seed)
    size = WORDS + N_STATS
    weights, factors = np.zeros(size), rng.normal(0, 0.02, (size, RANK))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
    bias = float(np.log(share / (1 - share)))
    for _ in range(_EPOCHS):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), 32):
            pick = order[begin : begin + 32]
            columns = np.concatenate([rows[i][0] for i in pick])
            values = np.concatenate([rows[i][1] for i in pick]).astype(np.float64)
            offsets = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])
            own = np.repeat(np.arange(len(pick)), np.diff(offsets))
            out = margins((bias, weights, factors), offsets, columns, values)
            error = (1 / (1 + np.exp(-out)) - labels[pick]) / len(pick)
            vx = np.add.reduceat(factors[columns] * values[:, None], offsets[:-1], axis=0)
            step = error[own] * values
            dv = step[:, None] * (vx[own] - factors[columns] * values[:, None])
            touched, at = np.unique(columns, return_inverse=True)
            dw = np.bincount(at, weights=step) + _DECAY * weights[touched]
            dvs = np.zeros((len(touched), RANK))
            np.add.at(dvs, at, dv)
            dvs += _DECAY * factors[touched]
            gw[touched] += dw * dw
            gv[touched] += dvs * dvs
            gb += error.sum() ** 2
            weights[touched] -= _RATE * dw / np.sqrt(gw[touched])
            factors[touched] -= _RATE * dvs / np.sqrt(gv[touched])
            bias -= _RATE * error.sum() / np.sqrt(gb)
    return bias, weights, factors


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        offsets, columns, values = features(batch.column("text"))
        at = pa.array(offsets.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.ListArray.from_arrays(at, pa.array(columns)), pa.ListArray.from_arrays(at, pa.array(values))],
            names=["quality", "columns", "values"],
        )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A model from at most ``sample`` rows of ``labels`` (doc_id, quality 0 or 1) and their documents' texts."""
    chosen = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max(F.struct(F.xxhash64("text").alias("code"), "text", "quality")).alias("row")).select("row.text", "row.quality")
    found = rows.mapInArrow(_feature_rows, "quality int, columns array<int>, values array<float>").toArrow()
    y = found["quality"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        value = 1.0 if not len(y) or y.min() == 1 else 0.0
        return (40.0 if value else -40.0), np.zeros(WORDS + N_STATS), np.zeros((WORDS + N_STATS, RANK))
    columns, values = found["columns"].combine_chunks(), found["values"].combine_chunks()
    at, flat, flat_values = np.asarray(columns.offsets), columns.values.to_numpy(), values.values.to_numpy()
    parts = [(flat[a:b], flat_values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    order = sorted(range(len(y)), key=lambda i: (len(parts[i][0]), parts[i][0].tobytes()))  # whatever order Spark returned
    return fit([parts[i] for i in order], y[order])


def _score_rows(model, keep: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = tuple(np.frombuffer(x, np.float32) for x in model.value[1:])
        own = (model.value[0], parts[0], parts[1].reshape(-1, RANK))
        for batch in slices(batches):
            out = margins(own, *features(batch.column("text")))
            score = 1 / (1 + np.exp(-np.clip(out.astype(np.float64), -60, 60)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=[*keep, name])

    return run


def with_score(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """The columns of docs, and the probability of label 1 as ``name``, which docs must not have."""
    bias, weights, factors = model
    sent = docs.sparkSession.sparkContext.broadcast((bias, weights.astype(np.float32).tobytes(), factors.astype(np.float32).tobytes()))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_score_rows(sent, docs.columns, name), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 0), score and predicted of every document."""
    held_out = F.coalesce(fold(F.col("doc_id")) % 5 == 0, F.lit(False))
    model = train(docs, labels.filter(~held_out))
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
