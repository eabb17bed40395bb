"""Context-tree weighting: a byte model that mixes Krichevsky-Trofimov estimates over all context depths.

A text is its words (lower-cased A-Z), separated by a space and closed by an end byte; contexts of a
text's first bytes are filled up with end bytes. A byte is eight binary decisions, highest bit first, and
each decision has its own context tree over the preceding bytes, ``DEPTH`` at most. Every node of a tree
weighs its own KT estimate against those of its children by the evidence of the training counts; a
decision's probability is that weighted mixture. A decision that a node never saw follows its parent. Bytes
that a context never saw share what its mixture leaves them in proportion to the parent's prediction, so
that every context's predictions add up to 1.

Spark gathers the counts of all training text: a task adds up its words and its (DEPTH + 1)-grams and
ships what it saw, an aggregate sums them. Grams are dealt by their last ``DENSE`` context bytes. Below
these, every context seen ``LEAST`` times or more is a node, so the model grows with what the corpus holds;
what a node's missing children saw counts as one more child. Tasks work out the evidence of their subtrees,
which Spark sums by the context of one byte less (256 ** (DENSE - 1) contexts at most); the driver weighs
that top of the tree, and tasks then predict downwards from it.

The model is a table of keys and logarithms. It is broadcast in blocks of about ``ENTRIES`` entries, dealt by
the same context bytes, each with a pass over the texts that scores the bytes in its contexts.

The unigram base needs every word's count. Words that make up at least 1/``COMMON`` of all tokens (so
there are at most ``COMMON``) are broadcast; counts of the rest meet their documents in a join in which,
by that same threshold, no key is large.

Null texts are empty: one end token, one end byte. Repeated rows are scored, and learnt from, each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold
from .textkit import Tally, Words, mix, ranges, signed, slices

DEPTH = 5
DENSE = 3
LEAST = 2
ENTRIES = 8_000_000
COMMON = 1 << 18
SMOOTH = 0.1
_END_BYTE = 10
_BATCH = 1 << 20


def _stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of DEPTH ends, then each text with its end and DEPTH - 1 more ends; and each text's place."""
    n = words.counts()
    lengths = np.add.reduceat(np.append(words.ends - words.starts, 0), np.minimum(words.first[:-1], len(words.starts)))
    size = np.where(n > 0, lengths + n - 1, 0) + DEPTH
    begin = DEPTH + np.cumsum(size) - size
    out = np.full(DEPTH + int(size.sum()), _END_BYTE, np.uint8)
    length = words.ends - words.starts
    total = np.concatenate([[0], np.cumsum(length + 1)])
    to = np.repeat(begin, n) + total[:-1] - np.repeat(total[words.first[:-1]], n)
    out[ranges(to, length)] = words.data[ranges(words.starts, length)]
    inner = np.ones(len(to), bool)
    inner[words.first[1:][n > 0] - 1] = False
    out[(to + length)[inner]] = 32
    return out, np.stack([begin, begin + size - DEPTH + 1])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): 0 a word's hash, 2 the end tokens, 3 DEPTH + 1 bytes, oldest first."""
    seen, grams = Tally(), Tally()
    ends = 0

    def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 50_000):
            key, n = keys[at : at + 50_000].astype(np.uint64), counts[at : at + 50_000].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), signed(key), pa.array(n)], names=["kind", "key", "n"])

    for batch in slices(batches, size=_BATCH):
        words = Words(batch.column("text"), lower=True)
        seen.add(words.hashes())
        stream, place = _stream(words)
        key = np.zeros(len(stream) - DEPTH, np.uint64)
        for i in range(DEPTH + 1):
            key = (key << np.uint64(8)) | stream[i : i + len(key)]
        own = ranges(place[0] - DEPTH, place[1] - place[0])
        grams.add(key[own])
        ends += len(batch)
    if ends:
        yield from out(0, *seen.settle())
        yield from out(3, *grams.settle())
        yield from out(2, np.zeros(1), np.array([ends]))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; x > 0."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - np.log(shift)


def _kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log of the KT probability of a sequence with these counts."""
    return _lgamma(zero + 0.5) + _lgamma(one + 0.5) - 1.1447298858494002 - _lgamma(zero + one + 1)


class Level:
    """The contexts of one depth: their grams (context and byte) with counts, and all their decisions.

    A decision is its context and a heap index: 1 for a byte's first bit, then the bits so far behind a 1.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.gram, self.n = gram, n
        symbol, context = gram & 255, (gram >> 8) << 8
        bit = np.arange(8)[:, None]
        self.ones = (symbol >> (7 - bit)) & 1
        self.decision, at = np.unique(context | (1 << bit) | (symbol >> (8 - bit)), return_inverse=True)
        self.at = at.reshape(8, -1)
        total = lambda x: np.bincount(self.at.ravel(), weights=x.ravel(), minlength=len(self.decision))
        self.one, self.zero = total(self.ones * n), total((1 - self.ones) * n)
        self.parent = np.zeros(0, np.int64)
        self.evidence = self.weight = self.log = np.zeros(0)

    def above(self, depth: int) -> np.ndarray:
        """The same decisions of the contexts' last ``depth`` bytes."""
        return self.decision & ((1 << 8 * (depth + 1)) - 1)

    def weigh(self, below: np.ndarray | None) -> None:
        """Evidence, and the weight of the own estimate against the children's evidence (None at the deepest level)."""
        own = _kt(self.zero, self.one)
        if below is None:
            self.evidence, self.weight = own, np.ones(len(own))
        else:
            self.evidence = np.logaddexp(own, below) - np.log(2)
            self.weight = 1 / (1 + np.exp(np.clip(below - own, -500, 500)))

    def predict(self, settled: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets ``log``, log10 of the chance of each gram's byte; what of the mixture is settled above and left to
        this level, for each decision, is passed on to the children."""
        own = (self.one + 0.5) / (self.zero + self.one + 1)
        chance = settled + left * own
        both = np.stack([np.log10(1 - chance), np.log10(chance)])
        self.log = sum((both[self.ones[j], self.at[j]] for j in range(8)), np.zeros(len(self.gram)))
        return settled + left * self.weight * own, left * (1 - self.weight)

    def unseen(self, depth: int, gram: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts, and log10 of the factor by which a byte that they never saw is likelier than its parent (sorted
        grams and their logs) says."""
        same = log[np.searchsorted(gram, self.gram & ((1 << 8 * depth) - 1))]
        context, at = np.unique(self.gram >> 8, return_inverse=True)
        mass, parents = (np.maximum(1 - np.bincount(at, weights=10.0**x), 1e-12) for x in (self.log, same))
        return context, np.log10(mass / parents)


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(key, return_inverse=True)
    return own, np.bincount(at, weights=n, minlength=len(own))


def subtree(key: np.ndarray, n: np.ndarray) -> dict[int, Level]:
    """The levels from DENSE on, weighed, of grams that share their last DENSE context bytes with no other task's."""
    levels: dict[int, Level] = {}
    for depth in range(DENSE, DEPTH + 1):
        gram, count = _sums(key & ((1 << 8 * (depth + 1)) - 1), n)
        if depth > DENSE:
            _, node = np.unique(gram >> 8, return_inverse=True)
            keep = np.bincount(node, weights=count)[node] >= LEAST
            gram, count = gram[keep], count[keep]
        levels[depth] = Level(gram, count)
        if depth > DENSE:
            levels[depth].parent = np.searchsorted(levels[depth - 1].decision, levels[depth].above(depth - 1))
    levels[DEPTH].weigh(None)
    for depth in range(DEPTH - 1, DENSE - 1, -1):
        level, child = levels[depth], levels[depth + 1]
        under = lambda x: np.bincount(child.parent, weights=x, minlength=len(level.decision))  # noqa: B023, E731
        rest = _kt(np.maximum(level.zero - under(child.zero), 0), np.maximum(level.one - under(child.one), 0))
        level.weigh(under(child.evidence) + rest)
    return levels


def top(decision: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray) -> tuple[dict[int, Level], np.ndarray, np.ndarray]:
    """The levels above DENSE, from the decisions of the last of them and the evidence below, and what is settled and
    left for each decision of the last."""
    last = DENSE - 1
    order = np.argsort(decision)
    decision, zero, one, below = (x[order] for x in (decision, zero, one, below))
    leaf = (decision & 255) >= 128
    context, pair = (decision[leaf] >> 8) << 8, ((decision[leaf] & 255) - 128) * 2
    gram, n = np.concatenate([context | pair, context | pair | 1]), np.concatenate([zero[leaf], one[leaf]])
    levels = {last: Level(*_sums(gram[n > 0], n[n > 0]))}
    for depth in range(last - 1, -1, -1):
        child = levels[depth + 1]
        gram, n = child.gram & ((1 << 8 * (depth + 1)) - 1), child.n
        if depth == 0:
            gram, n = np.concatenate([gram, np.arange(256)]), np.concatenate([n, np.zeros(256)])  # all bytes have a chance
        levels[depth] = Level(*_sums(gram, n))
        child.parent = np.searchsorted(levels[depth].decision, child.above(depth))
    for depth in range(last, -1, -1):
        level = levels[depth]
        if depth < last:
            child = levels[depth + 1]
            below = np.bincount(child.parent, weights=child.evidence, minlength=len(level.decision))
        level.weigh(below)
    settled, left = np.zeros(len(levels[0].decision)), np.ones(len(levels[0].decision))
    for depth in range(last + 1):
        if depth:
            settled, left = settled[levels[depth].parent], left[levels[depth].parent]
        settled, left = levels[depth].predict(settled, left)
    return levels, settled, left


def _grams(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray] | None:
    rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    return tuple(np.concatenate(x) for x in zip(*rows, strict=True)) if rows and sum(len(r[0]) for r in rows) else None


def _evidence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(decision, zero, one, below) of the contexts with a byte less than DENSE: a task's share of the sums."""
    grams = _grams(batches)
    if grams is not None:
        level = subtree(*grams)[DENSE]
        decision, at = np.unique(level.above(DENSE - 1), return_inverse=True)
        sums = (np.bincount(at, weights=x) for x in (level.zero, level.one, level.evidence))
        yield pa.RecordBatch.from_arrays([pa.array(decision), *map(pa.array, sums)], names=["decision", "zero", "one", "below"])


def _model_rows(blocks: int, sent):
    """(block, key, log) of the grams and contexts from DENSE on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _grams(batches)
        if grams is None:
            return
        decision, settled, left, gram, log = sent.value
        levels = subtree(*grams)
        at = np.searchsorted(decision, levels[DENSE].above(DENSE - 1))
        settled, left = settled[at], left[at]
        for depth in range(DENSE, DEPTH + 1):
            level = levels[depth]
            if depth > DENSE:
                settled, left = settled[level.parent], left[level.parent]
            settled, left = level.predict(settled, left)
            context, factor = level.unseen(depth, gram, log)
            gram, log = level.gram, level.log
            for tag, key, value, own in ((depth, gram, log, gram >> 8), (8 | depth, context, factor, context)):
                for i in range(0, len(key), 100_000):
                    part = slice(i, i + 100_000)
                    block = (mix((own[part] & ((1 << 8 * DENSE) - 1)).astype(np.uint64)) % np.uint64(blocks)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(key[part] | tag << 56), pa.array(value[part].astype(np.float32))], names=["block", "key", "log"])

    return run


class Table:
    """Numbers by 64-bit key, looked up many at a time."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        mixed = mix(key.astype(np.uint64))
        order = np.argsort(mixed)
        self.keys, self.values = mixed[order], value[order].astype(np.float32)
        bits = max(1, int(len(key)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its number (0 where not)."""
        mixed = mix(key.astype(np.uint64))
        slot = (mixed >> self.shift).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        found, out = np.zeros(len(key), bool), np.zeros(len(key), np.float32)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            place = at[open_]
            hit = self.keys[place] == mixed[open_]
            out[open_[hit]], found[open_[hit]] = self.values[place[hit]], True
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return found, out


def chances(stream: np.ndarray, table: Table, base: np.ndarray, block: int = 0, blocks: int = 1) -> np.ndarray:
    """log10 of the chance of every byte from the DEPTH-th, 0 for those in contexts of other blocks."""
    size = len(stream) - DEPTH
    key = np.zeros(size, np.int64)
    for i in range(DEPTH + 1):
        key = (key << 8) | stream[i : i + size]
    out = np.zeros(size, np.float32)
    open_ = np.arange(size)
    if blocks > 1:
        own = mix(((key >> 8) & ((1 << 8 * DENSE) - 1)).astype(np.uint64)) % np.uint64(blocks)
        open_ = np.flatnonzero(own == np.uint64(block))
    key = key[open_]
    for depth in range(DEPTH, 0, -1):
        found, log = table.find(key & ((1 << 8 * (depth + 1)) - 1) | depth << 56)
        out[open_] += log
        open_, key = open_[~found], key[~found]
        if not len(open_):
            return out
        out[open_] += table.find((key >> 8) & ((1 << 8 * depth) - 1) | (8 | depth) << 56)[1]
    out[open_] += base[key & 255]
    return out


def _sums_of(each: np.ndarray, place: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
    return total[place[1] - DEPTH] - total[place[0] - DEPTH]


def _more_scores(table, base, block: int, blocks: int):
    """(row, score) of the bytes in the contexts of one more block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=_BATCH):
            stream, place = _stream(Words(batch.column("text"), lower=True))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(_sums_of(chances(stream, table.value, base, block, blocks), place))], names=["row", "score"])

    return run


def _scored(table, base, blocks, common_hash, common_log, log_end):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, logs = np.frombuffer(common_hash.value, np.uint64), np.frombuffer(common_log.value, np.float64)
        for batch in slices(batches, size=_BATCH):
            words = Words(batch.column("text"), lower=True)
            stream, place = _stream(words)
            score = _sums_of(chances(stream, table.value, base, 0, blocks), place)
            n = words.counts()
            own = words.hashes()
            at = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
            common = (hashes[at] == own) if len(hashes) else np.zeros(len(own), bool)
            sums = np.concatenate([[0.0], np.cumsum(np.where(common, logs[at] if len(hashes) else 0.0, 0.0))])
            known = np.concatenate([[0], np.cumsum(common)])
            first, last = words.first[:-1], words.first[1:]
            doc = np.repeat(np.arange(len(batch)), n)[~common]
            rest = own[~common]
            order = np.lexsort((rest, doc))
            doc, rest = doc[order], rest[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rest[1:] != rest[:-1])])) if len(doc) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(doc)))
            m, k = len(batch), len(new)
            row = batch.column("row")
            blank = lambda kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([row, row.take(pa.array(doc[new]))]),
                    pa.concat_arrays([row, signed(rest[new])]),
                    pa.array(np.concatenate([np.zeros(m, np.int32), times.astype(np.int32)])),
                    pa.concat_arrays([batch.column("doc_id"), blank(pa.int64())]),
                    pa.array(np.concatenate([n + 1, np.zeros(k, np.int64)])),
                    pa.array(np.concatenate([known[last] - known[first] + 1, np.zeros(k, np.int64)])),
                    pa.array(np.concatenate([place[1] - place[0], np.zeros(k, np.int64)])),
                    pa.array(np.concatenate([sums[last] - sums[first] + log_end, np.zeros(k)])),
                    pa.array(np.concatenate([score, np.zeros(k)])),
                    pa.array(np.concatenate([np.ones(m, bool), np.zeros(k, bool)])),
                ],
                names=["row", "key", "times", "doc_id", "n_tokens", "n_known", "n_bytes", "base", "score", "head"],
            )

    return run


def _tagged(depth: int, context: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return context | (8 | depth) << 56, factor


def score(docs: DataFrame, held_out=None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10
    probability of the text) and bits_per_byte (its code length).

    ``held_out`` is a Column over doc_id; rows where it holds are scored but not learnt from. By default
    these are a tenth of the ids (crc32 of the id's text, modulo 10, is 0); a null id is learnt from.
    """
    if held_out is None:
        held_out = fold(F.col("doc_id")) % 10 == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = rows.filter(F.coalesce(~held_out, F.lit(True))).select("text")
    counted = cut(training.mapInArrow(_word_counts, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    ends = sum(r["n"] for r in counted.filter("kind = 2").collect())
    words = counted.filter("kind = 0").select("key", "n")
    tokens, distinct = words.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = (tokens or 0) + ends, (distinct or 0) + (ends > 0)
    norm = tokens + SMOOTH * (distinct + 1)
    log = lambda n: np.log10((n + SMOOTH) / norm)
    threshold = max(1, tokens / COMMON)
    common = words.filter(F.col("n") >= threshold).toArrow()  # COMMON rows at most
    hashes = common["key"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)

    grams = counted.filter("kind = 3").repartition(F.shiftright("key", 8).bitwiseAND((1 << 8 * DENSE) - 1)).select("key", "n")
    blocks = max(1, -(-counted.filter("kind = 3").count() // (ENTRIES // 2)))
    head = grams.mapInArrow(_evidence_rows, "decision long, zero double, one double, below double").groupBy("decision")
    head = head.agg(*(F.sum(c).alias(c) for c in ("zero", "one", "below"))).toArrow()
    context = docs.sparkSession.sparkContext
    base, parts = np.full(256, -np.log10(256), np.float32), []
    if len(head):
        levels, settled, left = top(*(head[c].to_numpy() for c in head.column_names))
        base = levels[0].log.astype(np.float32)
        last = levels[DENSE - 1]
        sent = context.broadcast((last.decision, settled, left, last.gram, last.log))
        model = grams.mapInArrow(_model_rows(blocks, sent), "block int, key long, log float")
        model = cut(model) if blocks > 1 else model
        shared = [x for d in range(1, DENSE) for x in ((levels[d].gram | d << 56, levels[d].log), _tagged(d, *levels[d].unseen(d, levels[d - 1].gram, levels[d - 1].log)))]
        for block in range(blocks):
            own = model.filter(F.col("block") == block).select("key", "log").toArrow()
            columns = zip(*shared, (own["key"].to_numpy(), own["log"].to_numpy()), strict=True)
            parts.append(context.broadcast(Table(*(np.concatenate(x) for x in columns))))
    else:
        parts.append(context.broadcast(Table(np.zeros(0, np.int64), np.zeros(0))))
    sums = context.broadcast(hashes[order].tobytes()), context.broadcast(log(common["n"].to_numpy()[order]).tobytes())
    texts = rows.withColumn("row", F.monotonically_increasing_id())

    scored = texts.mapInArrow(
        _scored(parts[0], base, blocks, *sums, float(log(ends))),
        "row long, key long, times int, doc_id long, n_tokens long, n_known long, n_bytes long, base double, score double, head boolean",
    )
    rare = words.filter(F.col("n") < threshold)
    for block in range(1, blocks):
        more = texts.select("row", "text").mapInArrow(_more_scores(parts[block], base, block, blocks), "row long, score double")
        scored = scored.unionByName(more, allowMissingColumns=True)
    found = scored.join(rare, "key", "left")
    chance = F.log10((F.coalesce("n", F.lit(0)) + SMOOTH) / F.lit(float(norm)))
    summed = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).cast("long").alias("n_known"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.col("base") + F.col("times") * chance).alias("base_score"),
        F.sum("score").alias("score"),
    )
    return summed.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        F.when(F.lit(ends > 0), F.col("n_known")).otherwise(F.col("n_known") - 1).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
