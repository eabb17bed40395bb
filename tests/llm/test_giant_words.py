"""A word, a run of spaces and a line of a million bytes: every operator over texts ends, with a row for each."""

import hashlib
import random
import time

import pytest

pytest.importorskip("driftline.llm")

from driftline.llm import chunk_codec, context_tree, decontaminate, language, near_copies, packing, pii, quality, quotes, simhash, sketches, substring_dedup  # noqa: E402

SIZE = 1_000_000


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefghij") for _ in range(SIZE))
    rows = [(1, word, "en"), (2, " " * SIZE, "de"), (3, "x " * (SIZE // 2), "en"), (4, word + " end", "de"), (5, "日" * (SIZE // 3), "en"), (6, "a short text of plain words", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, "some words of a benchmark item that is here")], "item_id long, text string")


OPERATORS = {
    "op1": lambda d, b: substring_dedup.remove_repeats(d),
    "op2": lambda d, b: language.identify(d),
    "op3": lambda d, b: simhash.near_duplicates(d),
    "op4": lambda d, b: sketches.fingerprint_edits(d),
    "op8": lambda d, b: context_tree.score(d),
    "op9": lambda d, b: pii.report(d),
    "op10": lambda d, b: quality.classify(d, d.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")),
    "op11": lambda d, b: chunk_codec.encode(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_giant_words(name, docs, small):
    begin = time.time()
    assert sorted(r["doc_id"] for r in OPERATORS[name](docs, small).collect()) == [1, 2, 3, 4, 5, 6]
    assert time.time() - begin < 120


def test_giant_words_elsewhere(spark, docs, small):
    assert decontaminate.contaminated(docs, small).count() == 0
    assert {r["doc_id"] for r in packing.pack(docs).select("doc_id").collect()} == {1, 2, 3, 4, 5, 6}
    assert {r["doc_id"] for r in near_copies.representatives(docs).select("doc_id").collect()} == {1, 2, 3, 4, 5, 6}
    turns = docs.selectExpr("1L as conv_id", "doc_id as turn", "'user' as role", "text")
    assert quotes.link(turns).count() == 6


def test_a_giant_repeat_is_removed(spark):
    body = " ".join(hashlib.sha1(str(i).encode()).hexdigest() for i in range(20_000))
    docs = spark.createDataFrame([(1, body), (2, "a b " + body)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect()} == {(1, 20_000, 20_000), (2, 20_002, 20_000)}
