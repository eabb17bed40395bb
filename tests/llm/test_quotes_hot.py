"""Common lines, turns with several texts, and quotes of quotes only."""

import collections
import random

import pytest

pytest.importorskip("driftline.llm")

from driftline.llm import queries, quotes  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"


def _parents(rows):
    """Each quoted line goes to the latest earlier turn that says it; most lines win, then the latest turn."""
    said = collections.defaultdict(list)
    for conv, turn, _, text in rows:
        for line in text.split("\n"):
            if not line.startswith(">"):
                said[conv, line].append(turn)
    out = {}
    for conv, turn, _, text in rows:
        votes = collections.Counter()
        for line in text.split("\n"):
            earlier = [t for t in said[conv, line[2:]] if t < turn] if line.startswith("> ") else []
            if earlier:
                votes[max(earlier)] += 1
        out[conv, turn] = max(votes, key=lambda t: (votes[t], t)) if votes else (turn - 1 if turn else None)
    return out


def test_lines_that_many_say_and_many_quote(spark, monkeypatch):
    monkeypatch.setattr(quotes, "STRETCH", 8)
    rng = random.Random(3)
    rows = []
    for conv in range(3):
        for turn in range(60):
            own = [rng.choice(["thanks", "hello", "yes", f"only {rng.randrange(30)}"])]
            quote = ["> " + rng.choice(["thanks", "hello", f"only {rng.randrange(30)}"])] if rng.random() < 0.6 else []
            rows.append((conv, turn, "user", "\n".join([*quote, *own])))
    found = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == _parents(rows)


def test_texts_of_one_turn_are_messages_of_their_own(spark):
    rows = [(1, 0, "a", "first text"), (1, 0, "b", "second text"), (1, 0, "c", "second text"), (1, 1, "d", "> second text\nyes"), (1, 2, "e", "> first text\nno"), (1, 3, "f", "plain")]
    found = quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["turn"], r["reply"], r["parent_turn"]) for r in found) == [(0, "first text", None), (0, "second text", None), (1, "yes", 0), (2, "no", 0), (3, "plain", 2)]


def test_a_message_that_quotes_only_a_quote_answers_who_said_it(spark):
    rows = [(1, 0, "a", "the plan"), (1, 1, "b", "something else"), (1, 2, "c", ">> the plan\nagreed")]
    found = {r["turn"]: r for r in quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[2]["parent_turn"] == 0 and found[2]["n_linked"] == 1


def test_substring_dedup_equals_its_sql(spark):
    import glob
    import os

    import duckdb

    from driftline.llm.queries import ORACLE

    con = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.01/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = sorted(con.sql(ORACLE["op1_substring_dedup"]).fetchall())
    assert sorted(tuple(r) for r in queries.op1_substring_dedup(spark, "/root/testdata/sf0.01").collect()) == want
    assert sum(r[2] for r in want) > 0
