"""Exact removal of repeated passages, by seed and extend.

1. *Seed.* Every run of ``seed`` words is hashed and winnowed: of the ``window - seed + 1`` seeds in a
   window of ``window`` words, the leftmost least hash is its anchor, in each of its copies. Windows of
   one anchor are neighbours and make up its reach. Anchors that occur once cannot lie in a repeat and
   go no further.
2. *Extend.* Where occurrences of an anchor agree on all words of the reach, the match extends to its
   full length both ways and no word of text has to be read again. Where an anchor occurs in several
   contexts, one representative of each is extended window by window, and the windows are counted.
3. *Keep.* Overlapping matches of a document merge into maximal repeats; all of their words go.

Hot passages never meet in one task: occurrences are counted with map-side partial aggregates, and
only the joins that hand verdicts back to occurrences see a row per occurrence, with one row a key on
the other side, which adaptive execution may split. No pairs of occurrences are formed.

Documents are told apart by a 64-bit hash of (doc_id, text). Null texts have no words; they, and texts
of fewer words than a window, come back unchanged (null as empty). Rows repeated with the same id are
copies of each other like any others. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key
from .textkit import Words, gram_hashes, gram_starts, ranges, signed, slices

SEED = 12
WINDOW = 35


def _winnow(hashes: np.ndarray, starts: np.ndarray, grams: np.ndarray, width: int):
    """(anchor, first window, number of windows), as word places, from the seeds of all texts in a row."""
    n = np.maximum(grams - width + 1, 0)
    if not n.sum():
        return (np.zeros(0, np.int64),) * 3
    at = ranges(np.cumsum(grams) - grams, n)
    picked = at + sliding_window_view(hashes, width)[at].argmin(axis=1)
    new = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    return starts[picked[new]], starts[at[new]], np.diff(np.append(new, len(at)))


def _anchor_rows(seed: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            hashes = words.hashes()
            starts, grams = gram_starts(words.first, seed)
            pos, begin, reach = _winnow(gram_hashes(hashes, starts, seed), starts, grams, window - seed + 1)
            doc = np.searchsorted(words.first, pos, "right") - 1
            shape = ((pos - begin) * 4096 + reach).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    signed(gram_hashes(hashes, pos, seed)),
                    signed(gram_hashes(hashes, begin, reach + window - 1) + shape),
                    batch.column("row").take(pa.array(doc)),
                    pa.array((begin - words.first[doc]).astype(np.int32)),
                    pa.array(reach.astype(np.int32)),
                ],
                names=["anchor", "context", "row", "begin", "reach"],
            )

    return run


def _window_rows(window: int):
    """The windows of each representative, from rows (row, doc_id, text, seeds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            hashes = words.hashes()
            seeds = batch.column("seeds")
            doc = np.repeat(np.arange(len(batch)), np.diff(np.asarray(seeds.offsets)))
            flat = seeds.flatten()
            n = flat.field("reach").to_numpy()
            begin = flat.field("begin").to_numpy()
            start = ranges(begin, n)
            own = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays(
                [
                    flat.field("anchor").take(pa.array(own)),
                    signed(gram_hashes(hashes, start + words.first[doc[own]], window)),
                    batch.column("row").take(pa.array(doc[own])),
                    pa.array(start.astype(np.int32)),
                ],
                names=["anchor", "span", "row", "start"],
            )

    return run


def _keep_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = Words(batch.column("text"))
        data, n = words.data.tobytes(), words.counts()
        marks = batch.column("marks")
        at, flat = np.asarray(marks.fill_null([]).offsets), marks.fill_null([]).flatten()
        begin, end = flat.field("begin").to_numpy(), flat.field("end").to_numpy()
        removed, sums, texts, repeats = [], [], [], []
        for i in range(len(batch)):
            cover = np.zeros(n[i] + 1, np.int64)
            np.add.at(cover, begin[at[i] : at[i + 1]], 1)
            np.add.at(cover, end[at[i] : at[i + 1]], -1)
            keep = np.cumsum(cover[:-1]) == 0
            edges = np.flatnonzero(np.diff(np.concatenate([[1], keep.view(np.int8), [1]])))
            where = np.flatnonzero(keep) + words.first[i]
            kept = b" ".join([data[a:b] for a, b in zip(words.starts[where].tolist(), words.ends[where].tolist(), strict=True)])
            removed.append(int(n[i] - len(where)))
            sums.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode())
            repeats.append([{"begin": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n.astype(np.int64)),
                pa.array(removed, pa.int64()),
                pa.array(sums, pa.string()),
                pa.array(texts, pa.string()),
                pa.array(repeats, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "repeats"],
        )


def remove_repeats(docs: DataFrame, seed: int = SEED, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept_text and its maximal repeats
    (arrays of word ranges), after removing every word in a ``window`` that starts anywhere else too.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", row_key())
    anchors = keyed.select("row", "text").mapInArrow(_anchor_rows(seed, window), "anchor long, context long, row long, begin int, reach int")
    # verdicts are cut or dealt anew before they meet occurrences, so that a hot key's join can be split
    seen = cut(
        anchors.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
        .filter("n > 1")
        .select("anchor", (F.col("low") != F.col("high")).alias("split"))
    )
    repeated = cut(anchors.join(seen, "anchor"))
    mark = lambda df: df.select("row", "begin", (F.col("begin") + F.col("reach") + (window - 1)).alias("end"))

    split = repeated.filter("split")
    contexts = cut(split.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "begin", "reach")).alias("rep")))
    whole = mark(repeated.filter("not split"))
    several = mark(split.join(contexts.filter("n > 1").select("anchor", "context"), ["anchor", "context"]))

    seed_rows = F.struct("anchor", F.col("rep.begin").alias("begin"), F.col("rep.reach").alias("reach"))
    seeds = contexts.groupBy(F.col("rep.row").alias("row")).agg(F.collect_list(seed_rows).alias("seeds"))
    # the texts are dealt by row here and below: one exchange, which Spark reuses
    spans = keyed.join(seeds, "row").select("row", "doc_id", "text", "seeds").mapInArrow(_window_rows(window), "anchor long, span long, row long, start int")
    place = F.xxhash64("row", "start")
    twice = spans.groupBy("anchor", "span").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low != high").select("anchor", "span")
    twice = twice.repartition(F.xxhash64("anchor", "span"))
    single = spans.join(twice, ["anchor", "span"]).select("row", F.col("start").alias("begin"), (F.col("start") + window).alias("end"))

    marks = whole.unionAll(several).unionAll(single).groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("marks"))
    return (
        keyed.join(marks, "row", "left")
        .select("doc_id", "text", "marks")
        .mapInArrow(
            _keep_rows,
            "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, repeats array<struct<begin: int, end: int>>",
        )
    )
