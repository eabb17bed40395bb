"""Chunked encoding and decoding against the tokenizer on whole texts."""

import hashlib
import os
import random

import pyarrow as pa
import pytest

pytest.importorskip("driftline.llm")

from driftline.llm import chunk_codec, queries  # noqa: E402
from driftline.llm.packing import default_tokenizer, token_bytes  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(default_tokenizer())


def plain(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    text = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def check(spark, tokenizer, rows):
    df = spark.createDataFrame([(i, t, "clash", 3, 4) for i, t in rows], "doc_id long, text string, blob string, n int, k1 int").repartition(3)
    found = chunk_codec.encode(df).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(((i, *plain(tokenizer, t)) for i, t in rows), key=key)


def passage(rng, n, letters="abcdefg  .,'é́ß日\U0001f600\n"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_shared_passages(spark, tokenizer):
    rng = random.Random(5)
    core = [passage(rng, 4000) for _ in range(4)]
    rows = [(i, passage(rng, rng.randrange(900)) + rng.choice(core)[rng.randrange(2000) :] + passage(rng, rng.randrange(900))) for i in range(60)]
    rows += [(100 + i, core[0]) for i in range(40)]  # copies
    rows += [(7, core[1])] * 5 + [(None, core[2])] * 3 + [(8, None), (9, ""), (None, None), (10, " \n")]
    check(spark, tokenizer, rows)


def test_long_words_runs_and_special_tokens(spark, tokenizer):
    rng = random.Random(6)
    word = "".join(rng.choice("abcdefghij") for _ in range(300_000))
    rows = [(1, word), (2, "x " + word + " y"), (3, "a" * 200_000), (4, "ab" * 100_000), (5, "0" * 50_000 + " " * 50_000), (6, "." * 60_000)]
    rows += [(20 + i, passage(rng, 3000, "<|endoftxsar> s't'veİΣ́ \x1c\x85\x00") + "<|endoftext|>" * 40 + "it's<|startoftext|>") for i in range(20)]
    rows += [(50 + i, "<|endoftext|>" * (300 + i)) for i in range(3)]
    check(spark, tokenizer, rows)


def test_cuts_follow_content():
    rng = random.Random(7)
    core = passage(rng, 30_000)
    a, b = (chunk_codec.chunks(pa.array([x + core]), False)[0] for x in (passage(rng, 700), passage(rng, 1300)))
    assert len(set(a) & set(b)) > 0.8 * len(a) and b"".join(a)[-100:] == core.encode()[-100:]
    assert all(len(c) >= chunk_codec.LEAST for c in a[:-1])
    [c.decode() for c in a]


def test_repair_widens_where_ids_disagree(tokenizer):
    path = default_tokenizer()
    texts = [["some wor", "ds here and th", "ere", "upon it", " all"]]
    right = [token_bytes(t, path) for t in texts]
    wrong = [[right[0][0], b"\1\0\0\0" + right[0][1], *right[0][2:]]]
    whole = token_bytes(["".join(texts[0])], path)
    assert chunk_codec.repaired(texts, right, path) == whole == chunk_codec.repaired(texts, wrong, path)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_chunk_bpe(spark, SF).collect()}
    assert found == {r["doc_id"]: plain(tokenizer, r["text"]) for r in docs}
    assert chunk_codec.encode(spark.read.parquet(f"{SF}/documents.parquet").limit(0)).count() == 0


def test_decoding(spark, tokenizer):
    docs = spark.createDataFrame([(1, "It's a <|endoftext|> déjà vu"), (2, None)], "doc_id long, text string")
    ids = chunk_codec.encode(docs, with_ids=True)
    found = {r["doc_id"]: r["decoded"] for r in chunk_codec.decode(ids).collect()}
    assert found == {1: tokenizer.decode(tokenizer.encode("It's a <|endoftext|> déjà vu", add_special_tokens=False).ids, skip_special_tokens=False), 2: ""}


def test_other_vocabularies(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, rng = Tokenizer.from_file(path), random.Random(8)
    core = passage(rng, 5000)
    docs = spark.createDataFrame([(i, core[i:]) for i in (0, 0, 7)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["ids"]) for r in chunk_codec.encode(docs, path, with_ids=True).collect())
    assert found == sorted((i, own.encode(core[i:], add_special_tokens=False).ids) for i in (0, 0, 7))
