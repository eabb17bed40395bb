"""The fixed patterns against the plain regular expressions, hostile long texts, and what the bootstrap adds to the tables."""

import collections
import hashlib
import random
import re
import time

import pytest

pytest.importorskip("driftline.llm")

from driftline.llm import pii  # noqa: E402

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def _plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and _luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return [(a, b, k) for a, k, b in sorted(out)]


def test_base_equals_the_plain_patterns():
    rng = random.Random(1)
    found = 0
    for _ in range(20_000):
        letters = rng.choice(["a@.1-_ ", "01.- ", "+0 1()-.", "a@b.c_é@", "4 -0+", "12.@a"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == _plain(text), text
        found += len(_plain(text))
    assert found > 1000


def test_base_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    names = list(PLAIN)
    for r in pii.report(docs).collect():
        spans = _plain(texts[r["doc_id"]])
        named = [f"{names[k]}:{a}:{b}" for a, b, k in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for *_, k in spans) for i in range(4)]
        assert set(named) <= set(r["spans"].split(","))
        assert r["n_spans"] == len([s for s in r["spans"].split(",") if s])


@pytest.mark.parametrize("unit", ["1", "a", "@", "a@", "+1", "(", "x at ", "0", "1 ", "1.", '"', "a1", "f", "é1 "])
def test_long_runs_are_scanned_in_linear_time(spark, unit):
    text = unit * (1_000_000 // len(unit))
    begin = time.time()
    rows = pii.report(spark.createDataFrame([(1, text), (2, "1.1.1." + "0" * 5000), (3, text + "@a.b")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and time.time() - begin < 60
    assert next(r["n_ip"] for r in rows if r["doc_id"] == 2) == 1


def test_bootstrap_adds_spans_to_the_table_and_only_true_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    new = collections.Counter()
    for r in pii.report(docs).collect():
        text = texts[r["doc_id"]]
        seeds = {f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in pii.seed_spans(text)}
        for s in set(filter(None, r["spans"].split(","))) - seeds:
            kind, a, b = s.split(":")
            new[kind, bool(re.search(r'(?i)token\W* =\W* "?$', text[: int(a)]))] += 1
    assert new["secret", True] > 0 and set(new) == {("secret", True)}


def test_a_slot_that_plain_words_fill_is_no_evidence(spark):
    rows = [(i, f"we met at 10.1.2.{i} on the way") for i in range(6)] + [(100 + i, f"we met at place{'abcdefgh'[i % 8]} on the way") for i in range(200)]
    rows.append((50, "we met at 10.999.2.7 on the way"))
    found = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[50] == ""


def test_more_patterns_than_are_broadcast(spark, monkeypatch):
    rows = [(i, f"intro {i} my key is key-{i}9-{i * 7919}-x kept here") for i in range(3)] + [(10 + i, f"intro my key is {hashlib.sha1(str(i).encode()).hexdigest()} kept here") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(tuple(r) for r in pii.report(docs).collect())
    monkeypatch.setattr(pii, "WATCH", 0)
    assert sorted(tuple(r) for r in pii.report(docs).collect()) == one
    assert all(r[-1] for r in one)
