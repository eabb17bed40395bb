"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: every operator has a defined result."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("driftline.llm")

import corpus_pipeline  # noqa: E402
from driftline.llm import context_tree, decontaminate, language, packing, pii, quality, quotes, simhash, sketches, substring_dedup  # noqa: E402

LONG = " ".join(f"wort{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat " * 8, "en"),
    (2, "the cat sat on the mat " * 8, "en"),
    (2, "the cat sat on the mat " * 8, "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \n\t ", "de"),
    (6, LONG, "de"),
    (7, "mail a.b@c.example or +1 (555) 010-9999 or 10.0.0.1 é ü 日本", None),
    (None, "a row without an id " * 12, "en"),
    (8, "1234 5678", "fr"),
]
CLASH = ["row", "print", "score", "spans", "_row", "_spans", "bucket", "key", "marks", "anchor", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 0), (7, 0, 1), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat the cat sat on the mat the cat sat"), (2, None), (3, ""), (4, "mat"), (None, "x")], "item_id long, text string")


OPERATORS = {
    "op1": lambda d, lab, b: substring_dedup.remove_repeats(d),
    "op2": lambda d, lab, b: language.identify(d),
    "op3": lambda d, lab, b: simhash.near_duplicates(d),
    "op4": lambda d, lab, b: sketches.fingerprint_edits(d),
    "op8": lambda d, lab, b: context_tree.score(d),
    "op9": lambda d, lab, b: pii.report(d),
    "op10": lambda d, lab, b: quality.classify(d, lab),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(name, docs, labels, bench):
    rows = OPERATORS[name](docs, labels, bench).collect()
    assert sorted(r["doc_id"] or -1 for r in rows) == sorted(x[0] or -1 for x in ROWS)


@pytest.mark.parametrize("name", [*OPERATORS, "op5", "op6"])
def test_empty_tables(name, docs, labels, bench):
    run = OPERATORS | {"op5": lambda d, lab, b: decontaminate.contaminated(d, b), "op6": lambda d, lab, b: packing.pack(d)}
    assert run[name](docs.limit(0), labels.limit(0), bench.limit(0)).count() == 0


def test_without_labels(docs, labels):
    assert {r["predicted"] for r in quality.classify(docs, labels.limit(0)).collect()} == {1}


def test_copies_are_removed_and_short_texts_stay(docs):
    rows = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert rows[1, 48] == 48 and rows[2, 48] == 48 and rows[3, 0] == 0 and rows[8, 2] == 0


def test_texts_without_letters_are_undetermined(docs):
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    assert found[3] == found[4] == found[5] == found[8] == ("und", 0.0)


def test_contaminated(docs, bench):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(1, 1), (2, 1), (1, 4), (2, 4)} == found


def test_every_piece_is_packed(docs):
    rows = packing.pack(docs).collect()
    assert {r["doc_id"] for r in rows} == {x[0] for x in ROWS}
    assert sum(r["doc_id"] == 2 for r in rows) == 2
    assert next(r for r in rows if r["doc_id"] == 3)["length"] == 1


def test_messages_without_keys(spark):
    rows = [(None, 1, "user", "a"), (1, None, "user", None), (1, 0, None, "> x"), (1, 0, "user", "> x")]
    out = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parent", F.lit(1))).collect()
    assert len(out) == 3
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark, docs, labels, bench, tmp_path):
    for name, df in (("labels", labels.filter("quality = 1")), ("benchmark", bench.filter("item_id = 1"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
    assert now.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
