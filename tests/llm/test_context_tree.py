"""The tree's predictions against the recursion of context-tree weighting, written down plainly."""

import collections
import functools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("driftline.llm")

from driftline.llm import context_tree as tree  # noqa: E402

D = tree.DEPTH


class Plain:
    """Counts by context; P_w = 1/2 P_e + 1/2 prod P_w(children), for every decision of a byte by itself."""

    def __init__(self, data):
        self.seen = collections.defaultdict(collections.Counter)
        for i in range(D, len(data)):
            for d in range(D + 1):
                self.seen[tuple(data[i - d : i])][data[i]] += 1
        self.children = collections.defaultdict(list)
        for c in [c for c in self.seen if c and self.node(c)]:
            self.children[c[1:]].append(c)
        self.weighted = functools.cache(self.weighted)

    def node(self, c):
        return c in self.seen and (len(c) <= tree.DENSE or sum(self.seen[c].values()) >= tree.LEAST)

    def counts(self, c, prefix):
        out = [0, 0]
        for symbol, n in self.seen[c].items():
            bits = format(symbol, "08b")
            if bits.startswith(prefix):
                out[int(bits[len(prefix)])] += n
        return out

    @staticmethod
    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(z + o + 1)

    def weighted(self, c, prefix):
        z, o = self.counts(c, prefix)
        own = self.kt(z, o)
        if len(c) == D:
            return own, 1.0
        below = 0.0
        for k in self.children[c]:
            a, b = self.counts(k, prefix)
            if a + b:
                below += self.weighted(k, prefix)[0]
            z, o = z - a, o - b
        below += self.kt(z, o)
        most = max(own, below)
        return most + math.log(math.exp(own - most) + math.exp(below - most)) - math.log(2), 1 / (1 + math.exp(below - own))

    def decision(self, path, prefix, bit):
        settled, left = 0.0, 1.0
        nodes = [c for c in path if sum(self.counts(c, prefix))]
        for c in nodes:
            counts = self.counts(c, prefix)
            own = (counts[bit] + 0.5) / (sum(counts) + 1)
            if c == nodes[-1]:
                return settled + left * own
            weight = self.weighted(c, prefix)[1]
            settled, left = settled + left * weight * own, left * (1 - weight)
        return 0.5

    def chance(self, path, symbol):
        if len(path) == 1 or self.seen[path[-1]][symbol]:
            bits = format(symbol, "08b")
            return math.prod(self.decision(path, bits[:j], int(bits[j])) for j in range(8))
        known = [q for q, n in self.seen[path[-1]].items() if n]
        mass, parents = (max(1e-12, 1 - sum(self.chance(p, q) for q in known)) for p in (path, path[:-1]))
        return mass / parents * self.chance(path[:-1], symbol)


def _table(data, blocks=1):
    grams = collections.Counter(tuple(data[i - D : i + 1]) for i in range(D, len(data)))
    key, n = np.array([int.from_bytes(bytes(g), "big") for g in grams]), np.array([*grams.values()], float)
    level = tree.subtree(key, n)[tree.DENSE]
    decision, at = np.unique(level.above(tree.DENSE - 1), return_inverse=True)
    levels, settled, left = tree.top(decision, *(np.bincount(at, weights=x) for x in (level.zero, level.one, level.evidence)))
    last = levels[tree.DENSE - 1]

    class Sent:
        value = (last.decision, settled, left, last.gram, last.log)

    rows = pa.Table.from_batches(tree._model_rows(blocks, Sent)(iter([pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])])))
    shared = [x for d in range(1, tree.DENSE) for x in ((levels[d].gram | d << 56, levels[d].log), tree._tagged(d, *levels[d].unseen(d, levels[d - 1].gram, levels[d - 1].log)))]
    tables = []
    for block in range(blocks):
        own = rows.filter(pa.compute.equal(rows["block"], block))
        tables.append(tree.Table(*(np.concatenate(x) for x in zip(*shared, (own["key"].to_numpy(), own["log"].to_numpy()), strict=True))))
    return tables, levels[0].log


def _data(rng, letters, n):
    return [tree._END_BYTE] * D + [rng.choice(letters) for _ in range(n)]


def test_predictions_equal_the_recursion():
    rng = random.Random(1)
    data = _data(rng, b"abcab \n", 600)
    (table,), base = _table(data)
    plain = Plain(data)
    test = np.array(data[:200] + [rng.choice(b"abcab \nxyz\xff\x00") for _ in range(300)], np.uint8)
    got = tree.chances(test, table, base)
    for i in range(D, len(test)):
        context, path = tuple(int(x) for x in test[i - D : i]), [()]
        while len(path) <= D and plain.node(context[D - len(path) :]):
            path.append(context[D - len(path) :])
        assert math.isclose(math.log10(plain.chance(path, int(test[i]))), float(got[i - D]), rel_tol=1e-4, abs_tol=1e-4)


def test_chances_add_up_and_blocks_partition_them():
    rng = random.Random(2)
    data = _data(rng, "the cat sat – on é mat ".encode(), 3000)
    (table,), base = _table(data)
    parts, _ = _table(data, blocks=3)
    for i in (50, 250, 1300):
        contexts = [np.append(np.array(data[i : i + D], np.uint8), np.uint8(b)) for b in range(256)]
        assert abs(sum(10.0 ** float(tree.chances(c, table, base)[0]) for c in contexts) - 1) < 1e-4
    stream = np.array(data, np.uint8)
    assert np.allclose(tree.chances(stream, table, base), sum(tree.chances(stream, p, base, b, 3) for b, p in enumerate(parts)))


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r["doc_id"]: tuple(r) for r in tree.score(docs).collect()}
    monkeypatch.setattr(tree, "ENTRIES", 40_000)
    for r in tree.score(docs).collect():
        assert all(math.isclose(x, y, rel_tol=1e-5) for x, y in zip(one[r["doc_id"]], r, strict=True))


def test_kt_is_the_ratio_of_gamma_functions():
    for z, o in [(0, 0), (3, 1), (40, 2), (1000, 1)]:
        assert math.isclose(float(tree._kt(np.array(float(z)), np.array(float(o)))), Plain.kt(z, o), rel_tol=1e-9, abs_tol=1e-9)


def test_held_out_texts_are_likelier_than_by_the_unigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = [r for r in tree.score(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)
