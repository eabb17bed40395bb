"""Passages with insertions and deletions at the full budget, at every offset to the bands of diagonals."""

import random

import pytest

pytest.importorskip("driftline.llm")

from driftline.llm import decontaminate  # noqa: E402


@pytest.mark.parametrize("size", [110, 300])
@pytest.mark.parametrize("change", ["insert", "delete", "both"])
def test_full_budget_of_insertions_and_deletions_is_found_at_every_offset(size, change):
    rng = random.Random(size)
    letters = "abcdefghijklmnopqrstuvwxyz"
    item = "".join(rng.choice(letters) for _ in range(size))
    index = decontaminate.Index([(7, item)])
    e = int(decontaminate.RATE * size)
    for offset in range(2 * (e + 1)):
        for _ in range(6):
            body = list(item)
            at = sorted(rng.sample(range(1, size - 1), e), reverse=True)
            for i, p in enumerate(at):
                if change == "insert" or (change == "both" and i % 2):
                    body.insert(p, "#")
                else:
                    del body[p]
            found = index.matches("." * offset + "".join(body) + "." * 30)
            assert [m[0] for m in found] and all(m[0] == 7 and m[3] <= e for m in found)


def test_every_place_of_an_item_is_a_passage():
    index = decontaminate.Index([(1, "tiny item"), (2, "a longer passage of the benchmark that occurs more than once")])
    text = "x tiny item y tiny item z a longer passage of the benchmark that occurs more than once, a longer passage of the benchmark that occurs more than once"
    found = index.matches(text)
    assert [m[0] for m in found] == [1, 1, 2, 2]
    assert all(text[a:b] == {1: "tiny item", 2: "a longer passage of the benchmark that occurs more than once"}[i] and e == 0 for i, a, b, e in found)


def test_a_long_item_copied_whole_is_one_passage():
    body = " ".join(f"word{i * 7919 % 1000}" for i in range(300))
    found = decontaminate.Index([(1, body)]).matches(f"before {body} after")
    assert [(m[0], m[3]) for m in found] == [(1, 0)] and found[0][2] - found[0][1] == len(body)


def test_parts_of_a_long_item(spark):
    """Any 300 bytes of an item are found, wherever they begin, and with a few edits; 150 are not claimed to be."""
    rng = random.Random(21)
    body = "".join(rng.choice("abcdefghijklmnop ") for _ in range(2000)).strip()
    texts, want = {}, []
    for i, begin in enumerate(range(0, 1690, 53)):
        part = list(body[begin : begin + 305])
        for _ in range(i % 4):
            part[rng.randrange(len(part))] = "z"
        noise = "".join(rng.choice("qrstuvwxy ") for _ in range(200))
        texts[i] = noise + " " + "".join(part) + " " + noise
        want.append(i)
    texts[500] = "".join(rng.choice("abcdefghijklmnop ") for _ in range(2000))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, body)], "item_id long, text string")
    assert sorted({r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()}) == want


def test_short_items_may_have_their_edits(spark):
    texts = [(1, "so 3 apples and 5 pearx, he said"), (2, "3 apples and 5 pears"), (3, "3 apxles and 5 pearx"), (4, "3 apples and 5 pear"), (5, "x3 aples and 5 pears"), (6, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(9, "3 apples and 5 pears")], "item_id long, text string")  # 20 bytes: one edit
    found = {(r["doc_id"], r["edits"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {(1, 1), (2, 0), (4, 1), (5, 1)}
