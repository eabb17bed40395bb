"""Near copies by SimHash, for the pipeline: texts whose sets of word shingles are alike by ``ALIKE`` or more.

Texts with equal shingle sets (lower-cased words, shorter texts being one shingle) are one node. A node has
``TABLES`` independent fingerprints of ``BITS`` bits, a bit being set if it is set in over half of the hashes
of the set. In each table, fingerprints that differ in at most ``BUDGET`` bits are found by the self-join of
binary tries of ``simhash``; nodes that meet in a table are candidates. At a Jaccard similarity of 0.8 a bit
differs with probability acos(8/9)/pi = 0.151, so a pair meets with probability 0.94 there, 0.997 at 0.85 and
0.99999 at 0.9.

A candidate's similarity is then told by all TABLES * BITS bits together, with a standard error of 0.016 at
0.8: alike below ``SURE`` differing bits, not alike above ``NEVER``, and between the two, four standard
errors on either side, by the exact Jaccard similarity of the two sets, as for sets of under ``SMALL``.

Links are sought in rounds. In each but the last, the members of a key are put in an order by chance, those of one
component next to each other, and neighbours of different components are held against each other; what is
alike makes components for the next round. The first round uses ``FIRST`` tables, those after it all. Components grow by
the new links alone. So a group of any size costs a comparison for each member and table at most, and most members are
connected after the first few tables. Keys of more than ``CROWD`` members are put in order in parts, whose
heads are put in order once more.

The last round, that after ``NEXT`` others, is exact: in keys that still hold several components, all pairs of nodes
of different ones are compared, unless that was done. So no link between nodes that met is lost but those that join
what is joined already. Nodes of a key are dealt, with their fingerprints, in blocks of some ``CROWD`` by ``CROWD`` (fewer where
sets are larger than ``LONG`` on average) and compared there, ``CHUNK`` pairs at a time. Only pairs that may be alike become rows, and
their sets go to a block once, not once a pair.

Null texts and texts without words are one node, alike only among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, cut, fresh, row_key, tidy
from .components import connected
from .textkit import Words, gram_hashes, mix, ranges, signed, slices

SHINGLE = 5
ALIKE = 0.8
TABLES, BITS, BUDGET = 80, 32, 1
SURE, NEVER = int(0.1196 * TABLES * BITS), int(0.1802 * TABLES * BITS)
SMALL = 40
FIRST, NEXT = 6, 2
CROWD = 1000
LONG = 1000
CHUNK = 1 << 16
FEW = 10_000
_ADD = mix(np.arange(1, TABLES * BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, ascending."""
    words = Words(texts, lower=True)
    n = words.counts()
    length = np.minimum(n, size)
    grams = np.where(n > 0, n - length + 1, 0)
    hashes = gram_hashes(words.hashes(), ranges(words.first[:-1], grams), np.repeat(length, grams))
    ends = np.cumsum(grams)
    return [np.unique(hashes[a:b]) for a, b in zip((ends - grams).tolist(), ends.tolist(), strict=True)]


def fingerprints(own: np.ndarray) -> np.ndarray:
    """TABLES fingerprints of BITS bits (none of an empty set)."""
    if not len(own):
        return np.zeros(0, np.uint32)
    ones = np.zeros(TABLES * BITS, np.int64)
    for i in range(0, len(own), 255):  # sums of a byte's range
        bits = np.unpackbits(mix(own[i : i + 255, None] + _ADD).view(np.uint8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own)).view(np.uint32)


def _node_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), size)
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            prints = pa.array([fingerprints(s).view(np.int32) for s in sets], pa.list_(pa.int32()))
            count = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), signed(nodes), count, prints], names=["row", "doc_id", "node", "n", "prints"])

    return run


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "own"])

    return run


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _alike_rows(alike: float):
    """The pairs (a, b) whose sets are alike, from rows (block, a, b, own) sorted by block and b: a's set where b is null, else a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for batch in batches:
            found, own = [], batch.column("own")
            rows = zip(*(batch.column(name).to_pylist() for name in ("block", "a", "b")), strict=True)
            for i, (at, a, b) in enumerate(rows):
                if at != block:
                    block, sets = at, {}
                if b is None:
                    sets[a] = own[i].values.to_numpy().view(np.uint64)  # ascending as such
                    continue
                few, many = sorted((sets[a], sets[b]), key=len)
                shared = np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few)
                if shared >= alike * (len(few) + len(many) - shared):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def _exact(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, alike: float) -> DataFrame:
    """The pairs (a, b, block) that are alike by their sets; a set goes once to each block that it has pairs in."""
    ends = pairs.select("block", F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = _few(cut(ends.select("node").distinct().join(nodes.select("node", "row"), "node")))
    sets = docs.select("row", "text").join(wanted, "row").select("node", "text").mapInArrow(_set_rows(size), "node long, own array<long>")
    sets = cut(sets.dropDuplicates(["node"]))
    own = ends.join(sets, "node").select("block", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "own")
    dealt = own.unionAll(pairs.select("block", "a", "b", F.lit(None).cast("array<long>"))).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("b"))
    return dealt.mapInArrow(_alike_rows(alike), "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, alike: float) -> DataFrame:
    """The pairs (a, b) that are alike. Pairs with ``sure`` and ``block`` have been told by their bits."""
    if "sure" in pairs.columns:
        told = pairs
    else:
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("prints").alias(f"prints_{c}"))
        differing = F.aggregate(F.zip_with("prints_a", "prints_b", lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND((1 << BITS) - 1))), F.lit(0), lambda s, v: s + v)
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        possible = joined.filter(F.least("n_a", "n_b") >= alike * F.greatest("n_a", "n_b")).select("a", "b", differing.alias("bits"), (F.least("n_a", "n_b") < SMALL).alias("small"))
        told = cut(possible.filter(f"small or bits <= {NEVER}").select("a", "b", F.col("a").alias("block"), (~F.col("small") & (F.col("bits") < SURE)).alias("sure")))
    sure, open_ = told.filter("sure").select("a", "b"), told.filter("not sure").select("a", "b", "block")
    if not open_.limit(1).count():
        return sure
    return sure.unionAll(_exact(open_, docs, nodes, size, alike))


def meetings(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, part): nodes that share a key met in a table; keys have two nodes at least.

    A print is a key if several nodes have it or others link to it; nodes of a print that links to another are under
    that one's key too. Prints that are neither, nearly all in a large corpus, go before nodes are dealt by key.
    """
    flat = nodes.select("node", F.posexplode("prints").alias("table", "print"))
    flat = flat.select("node", (F.col("table").cast("long") * (1 << BITS) + F.col("print").bitwiseAND((1 << BITS) - 1)).alias("print"))
    prints = scratch.keep(flat.groupBy("print").agg(F.count("*").alias("n")))
    near = scratch.keep(simhash.links(prints, BUDGET, size=BITS, keep=lambda _: prints.select("print")))  # distinct and written
    own = prints.filter("n > 1").select("print").unionAll(near.select(F.col("b").alias("print"))).distinct()
    under = own.select("print", F.col("print").alias("key")).unionAll(near.select(F.col("a").alias("print"), F.col("b").alias("key")))
    # members are counted by print, before any node is dealt
    members = under.join(prints, "print").groupBy("key").agg(F.sum("n").alias("members"))
    under = scratch.keep(under.join(members, "key").select("print", "key", F.ceil(F.col("members") / CROWD).alias("parts")))
    return flat.join(under, "print").select("key", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))


def _neighbours(rooted: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of different components that stand next to each other within a key."""
    chance = [F.xxhash64("root", "key", F.lit(turn)), F.col("root"), F.xxhash64("node", "key", F.lit(turn))]
    before = F.lag(F.struct("node", "root")).over(Window.partitionBy("key", "part").orderBy(*chance))
    own = rooted.withColumn("before", before)
    heads = own.filter("before is null").select("key", "node", "root")
    crowded = heads.withColumn("before", F.lag(F.struct("node", "root")).over(Window.partitionBy("key").orderBy(*chance)))
    pairs = own.select("node", "root", "before").unionAll(crowded.select("node", "root", "before")).filter("before.root <> root")
    return pairs.select(F.least("node", "before.node").alias("a"), F.greatest("node", "before.node").alias("b")).distinct()


def _across_rows(alike: float, told: bool):
    """The pairs (a, b) of different roots within a block that sizes and prints allow to be alike, from rows sorted by block, part and root."""

    def work(block: np.ndarray, part: np.ndarray, root: np.ndarray, node: np.ndarray, n: np.ndarray, alone: np.ndarray, prints: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        new = lambda *columns: np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in columns])])
        after = lambda first: np.append(np.flatnonzero(first)[1:], len(block))[np.cumsum(first) - 1]
        end, half = after(new(block)), after(new(block, part))
        begin = np.where(alone, after(new(block, part, root)), half)  # of two parts, the first is held against the second
        before = np.concatenate([[0], np.cumsum(end - begin)])
        at = 0
        while at < len(block):
            upto = max(at + 1, int(np.searchsorted(before, before[at] + CHUNK, "right")) - 1)
            count = end[at:upto] - begin[at:upto]
            i, j = np.repeat(np.arange(at, upto), count), ranges(begin[at:upto], count)
            least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            possible = (root[i] != root[j]) & (least >= alike * most)
            i, j, small = i[possible], j[possible], least[possible] < SMALL
            sure = np.zeros(len(i), bool)
            if told:
                bits = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64)
                near = small | (bits <= NEVER)
                i, j, sure = i[near], j[near], (~small & (bits < SURE))[near]
            if len(i):
                a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, block[i], sure)], names=["a", "b", "block", "sure"])
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if told:
                cols.append(batch.column(6).flatten().to_numpy().reshape(batch.num_rows, -1).view(np.uint64))
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            whole = np.flatnonzero(rest[0] != rest[0][-1])  # the last block may go on
            if len(whole):
                yield from work(*(x[: whole[-1] + 1] for x in rest))
                rest = [x[whole[-1] + 1 :] for x in rest]
        if rest is not None:
            yield from work(*rest)

    return run


def _across(rooted: DataFrame, alike: float, prints: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b) of nodes of different components within a key whose sets' sizes allow them to be alike.

    rooted has key, node, root and the size n of the node's set. With prints (node, prints), pairs that all bits rule out are
    left out too: they are compared where their key's nodes meet and never become rows. Each of the others has a block where
    it was found and whether its bits are sure that it is alike.
    """
    parts = rooted.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / CROWD, F.sum("n") / (CROWD * LONG))).cast("int").alias("parts"))
    own = rooted.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("block")
    own = own.select(block, "part", "root", "node", "n", (F.col("part") == F.col("other")).alias("alone"))
    own = own if prints is None else own.join(prints, "node").select(*own.columns, "prints")
    dealt = own.repartition("block").sortWithinPartitions("block", "part", "root")
    pairs = dealt.mapInArrow(_across_rows(alike, prints is not None), "a long, b long, block long, sure boolean")
    return pairs.select("a", "b").distinct() if prints is None else pairs.groupBy("a", "b").agg(F.min("block").alias("block"), F.first("sure").alias("sure"))


def links(docs: DataFrame, nodes: DataFrame, size: int = SHINGLE, alike: float = ALIKE) -> DataFrame:
    """Edges (a, b) between nodes that are alike and connect the components of those that met.

    docs has row and text; nodes has row, node, n and prints, one row for each node.
    """
    scratch = Scratch(nodes.sparkSession)
    met = scratch.keep(meetings(nodes, scratch))
    tidy(nodes.sparkSession)
    rooted = met.filter(F.col("key") < (FIRST << BITS)).withColumn("root", F.col("node"))
    edges = tried = None
    roots = nodes.select("node", F.col("node").alias("root"))
    for turn in range(2 + NEXT):
        last = turn == 1 + NEXT
        if last:
            sized = scratch.keep(rooted.join(nodes.select("node", "n"), "node").select("key", "node", "root", "n"))
            pairs = _across(sized, alike, nodes.select("node", "prints"))
        else:
            pairs = _neighbours(rooted, turn)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = tried if last else pairs if tried is None else tried.unionAll(pairs)
        found = cut(_verified(pairs, docs, nodes, size, alike))
        new = found.limit(1).count() > 0
        edges = found if edges is None else edges.unionAll(found)
        if last:
            break
        if new:  # links between components, whose roots are joined
            ends = roots.withColumnRenamed("node", "a").withColumnRenamed("root", "ra"), roots.withColumnRenamed("node", "b").withColumnRenamed("root", "rb")
            between = found.join(ends[0], "a").join(ends[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            joined = connected(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = cut(roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        tidy(nodes.sparkSession)  # else the shuffles of all rounds add up
        rooted = met.join(roots, "node")
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        rooted = rooted.join(mixed, "key")
    edges = cut(edges)
    scratch.drop()  # the edges are written
    return edges


def representatives(docs: DataFrame, size: int = SHINGLE, alike: float = ALIKE) -> DataFrame:
    """One row of docs for each component of links: that of the least doc_id (null last), repeated rows once."""
    row = fresh(docs, "_row")
    keyed = docs.withColumn(row, row_key())
    rows = keyed.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(rows.mapInArrow(_node_rows(size), "row long, doc_id long, node long, n int, prints array<int>"))
    least = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "row")).alias("best")
    nodes = cut(found.groupBy("node").agg(least, F.first("n").alias("n"), F.first("prints").alias("prints")).select("node", "best", F.col("best.row").alias("row"), "n", "prints"))
    roots = connected(links(rows, nodes, size, alike))
    kept = nodes.select("node", "best").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = kept.agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return keyed.join(kept, row, "left_semi").dropDuplicates([row]).drop(row)
