"""The near-duplicate stage of the pipeline against brute-force Jaccard similarity over five-word shingles."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("driftline.llm")

import corpus_pipeline  # noqa: E402
from driftline.llm import near_copies  # noqa: E402


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def roots(texts, alike=0.8):
    own = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in own:
        for b in own:
            if a < b and len(own[a] & own[b]) >= alike * len(own[a] | own[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {find(d) for d in texts}


def test_near_copies_link_at_four_fifths_and_nothing_else_does(spark):
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = {}
    for _ in range(12):  # copies edited at places of their own: some stay above 0.8, some fall below
        body = new(rng.randrange(80, 400))
        for edits in (0, 1, 2, 3, 5, 9):
            copy = list(body)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "edited"
            texts[len(texts)] = " ".join(copy)
    body = new(204)
    for i in range(40):  # a chain: neighbours are alike, ends are not
        texts[len(texts)] = " ".join(body)
        body = [*body[8:], *new(8)]
    texts[len(texts)] = "short text"
    texts[len(texts)] = "Short  TEXT"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, "").collect()}
    # no link below 0.8, none lost from 0.86, and most of those between (see the measured recall)
    assert roots(texts) <= kept <= roots(texts, 0.86)
    between = len(roots(texts, 0.86)) - len(roots(texts))
    assert len(kept) - len(roots(texts)) <= 0.1 * between


@pytest.mark.parametrize(("alike", "least"), [(0.8, 0.9), (0.85, 0.98), (0.9, 0.998)])
def test_recall_of_the_tables(alike, least):
    rng = np.random.default_rng(6)
    met = bits = 0
    for _ in range(1000):
        shared = rng.integers(0, 1 << 63, round(200 * 2 * alike / (1 + alike)), np.uint64)
        own = rng.integers(0, 1 << 63, (2, 200 - len(shared)), np.uint64)
        a, b = (near_copies.fingerprints(np.concatenate([shared, x])) for x in own)
        differing = np.bitwise_count(a ^ b)
        met += bool((differing <= near_copies.BUDGET).any())
        bits += differing.sum() <= near_copies.NEVER and (alike > 0.8 or near_copies.SURE <= differing.sum())
    assert met >= 1000 * least and bits >= 990


def test_one_group_of_many_copies_is_one_document(spark):
    rng = random.Random(5)
    body = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        copy = list(body)
        copy[rng.randrange(300)] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, "").collect()] == [0]


def pair(rng, size, alike, new):
    """Two texts of ``size`` words whose ends differ, so that their five-word shingles have just about the similarity."""
    shared = math.ceil(2 * alike * (size - 4) / (1 + alike)) + 4
    body = new(shared)
    return body + new(size - shared), body + new(size - shared)


def test_recall_end_to_end_at_the_limit(spark):
    """Pairs of similarity 0.80 to 0.81 alone, and within a large group whose other members are far from the second text."""
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    texts, pairs, grouped = {}, [], []
    for _ in range(150):
        a, b = pair(rng, rng.randrange(100, 300), 0.8, new)
        pairs.append((len(texts), len(texts) + 1))
        for text in (a, b):
            texts[len(texts)] = " ".join(text)
    for g in range(12):  # 60 near copies of a text, and one that is 0.8 like a single copy of them
        body = new(200)
        first = len(texts)
        for _ in range(60):
            copy = list(body)
            copy[rng.randrange(40)] = f"edit{rng.randrange(10**7)}"
            texts[len(texts)] = " ".join(copy)
        tail = texts[len(texts) - 1].split()
        tail[-20:] = new(20)  # near the last copy; farther from the others by their own edit
        grouped.append((first, len(texts)))
        texts[len(texts)] = " ".join(tail)
    own = {d: shingles(t) for d, t in texts.items()}
    close = [(a, b) for a, b in pairs if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]
    assert len(close) > 140 and all(len(own[a] & own[b]) < 0.82 * len(own[a] | own[b]) for a, b in close)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, "").collect()}
    assert all(a in kept for a, _ in close)
    assert sum(b not in kept for _, b in close) >= 0.9 * len(close)
    assert sum(b not in kept for _, b in grouped) >= 0.9 * len(grouped) and all(a in kept for a, _ in grouped)
    assert roots(texts) <= kept


def test_the_only_link_between_two_groups_of_copies(spark):
    """Sixty copies of a text and sixty of another, of which one pair alone is alike: by chance it is hardly ever held together."""
    rng = random.Random(12)
    new = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]

    def copies(body):
        for _ in range(59):
            copy = list(body)
            copy[rng.randrange(40)] = new(1)[0]
            yield copy

    texts, firsts = {}, []
    for _ in range(10):
        body = new(200)
        one = list(body)
        one[20] = new(1)[0]
        other = one[:-20] + new(20)
        firsts.append(len(texts))
        for text in (*copies(body), one, other, *copies(other)):
            texts[len(texts)] = " ".join(text)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, "").collect()}
    assert roots(texts) == set(firsts)
    assert kept >= set(firsts) and len(kept) <= len(firsts) + 2  # a pair meets with probability 0.94


def test_pairs_across_components_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWD", 3)
    rng = random.Random(13)
    rows = [(k, 100 * k + i, 100 * k + i % roots_, rng.randrange(80, 101)) for k, size, roots_ in ((1, 30, 30), (2, 25, 4), (3, 9, 1), (4, 2, 2)) for i in range(size)]
    found = near_copies._across(spark.createDataFrame(rows, "key long, node long, root long, n int"), 0.9)
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2] and min(a[3], b[3]) >= 0.9 * max(a[3], b[3])}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_pairs_ruled_out_by_their_bits_never_become_rows(spark, monkeypatch):
    """Near copies that meet in many keys, but are not alike, are not written pair by pair; blocks lose none that may be alike."""
    monkeypatch.setattr(near_copies, "CROWD", 7)
    monkeypatch.setattr(near_copies, "CHUNK", 50)
    rng = np.random.default_rng(14)
    base = rng.integers(0, 1 << 63, 200, np.uint64)
    sets = [np.concatenate([base[rng.permutation(200)[: 200 - own]], rng.integers(0, 1 << 63, own, np.uint64)]) for own in [*[50] * 40, *[4, 10, 16, 22] * 3]]
    sets += [s[:30] for s in sets[:4]]
    prints = np.array([near_copies.fingerprints(s) for s in sets])
    rows = [(key, i, i // 2 if key == 1 else i, len(sets[i])) for key, own in ((1, range(50)), (2, range(30, 56)), (3, range(3))) for i in own]
    told = spark.createDataFrame([(i, p.view(np.int32).tolist()) for i, p in enumerate(prints)], "node long, prints array<int>")
    found = near_copies._across(spark.createDataFrame(rows, "key long, node long, root long, n int"), 0.8, told).collect()
    bits = lambda a, b: int(np.bitwise_count(prints[a] ^ prints[b]).sum())
    met = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and min(a[3], b[3]) >= 0.8 * max(a[3], b[3])}
    small = lambda a, b: min(len(sets[a]), len(sets[b])) < near_copies.SMALL
    want = {(a, b): not small(a, b) and bits(a, b) < near_copies.SURE for a, b in met if small(a, b) or bits(a, b) <= near_copies.NEVER}
    assert {(r["a"], r["b"]): r["sure"] for r in found} == want and len(found) == len(want)
    assert any(want.values()) and not all(want.values()) and 10 * len(want) < len(met)


def test_sets_of_a_block_are_compared_exactly(spark):
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 100), (5, 105), (10, 110), (11, 111), (12, 112))]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    nodes = spark.createDataFrame([(i, i) for i in range(5)], "node long, row long")
    pairs = [(a, b, block) for a in range(5) for b in range(a + 1, 5) for block in [(a + b) % 2]]
    found = near_copies._exact(spark.createDataFrame(pairs, "a long, b long, block long"), docs, nodes, 5, 0.8)
    own = [shingles(t) for t in texts]
    want = [(a, b) for a, b, _ in pairs if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]
    assert sorted(map(tuple, found.collect())) == want and 0 < len(want) < len(pairs)
