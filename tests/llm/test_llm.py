"""Each corpus operator against a brute-force version on a small fixture."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("driftline.llm")

from driftline.llm import components, context_tree, decontaminate, language, packing, pii, quality, quotes, simhash, sketches, substring_dedup  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_substring_dedup(docs, texts):
    words = {d: WORD.findall(t) for d, t in texts.items()}
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    for r in substring_dedup.remove_repeats(docs).collect():
        w = words[r["doc_id"]]
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert sum(x["end"] - x["begin"] for x in r["repeats"]) == len(gone)


def test_repeats_with_partial_overlap(spark):
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    core = new(60)
    rows = [(i, " ".join(new(rng.randrange(40)) + core[rng.randrange(25) :][: rng.randrange(30, 60)] + new(rng.randrange(40)))) for i in range(40)]
    rows.append((99, " ".join(new(5) * 20)))  # periodic: repeats itself
    test_substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), dict(rows))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000 + i) for i in range(1, 200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(n) == root for n, root in found.items())
    assert {n for e in edges if e[0] != e[1] for n in e} == set(found)


def _links(prints, budget=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, texts):
    import xxhash

    def fingerprint(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = WORD.findall(w)
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    ids = sorted(texts)
    prints = [fingerprint(texts[i]) for i in ids]
    roots = _links(prints)
    want = {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("crowd", [20, 20_000])
def test_trie_self_join(spark, crowd):
    """Clusters of fingerprints, also where every group is split into cells again and again."""
    rng = random.Random(crowd)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:12]:
        for _ in range(25):
            q = p
            for _ in range(rng.randrange(1, 6)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
    prints = sorted(prints)
    roots = _links(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), crowd=crowd)
    found = {r["node"]: r["root"] for r in components.connected(edges).collect()}
    groups, want = collections.defaultdict(set), collections.defaultdict(set)
    for s, r in zip(signed, roots, strict=True):
        groups[found.get(s, s)].add(s)
        want[r].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def _shingles(t):
    w = WORD.findall(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketches(docs, texts):
    ids = sorted(texts, reverse=True)
    follow = {d: ids[(i + 1) % len(ids)] for i, d in enumerate(ids)}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    errors = []
    for r in sketches.fingerprint_edits(docs).collect():
        own, nxt = texts[r["doc_id"]], texts[follow[r["doc_id"]]]
        k = len(own) // 3
        edited = own[: len(own) - k] + nxt[:k]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(r["near_edited"] - jaccard(_shingles(own), _shingles(edited)))
        assert abs(r["near_next"] - jaccard(_shingles(own), _shingles(nxt))) < 0.2
        assert abs(r["distinct_shingles"] - len(_shingles(own))) <= 0.5 * len(_shingles(own))
    assert np.mean(np.abs(errors)) < 0.04 and abs(np.mean(errors)) < 0.01


def test_sketches_merge(spark):
    import pyarrow as pa

    words = [f"w{i}" for i in range(3000)]
    parts = [" ".join(words[i : i + 304]) for i in range(0, 2700, 300)]
    df = spark.createDataFrame([("x", sketches.encode(s)) for s in sketches.sketch(pa.array(parts))], "part string, fingerprint string")
    merged = sketches.merge(df, ["part"]).collect()
    whole = {tuple(s) for p in parts for s in zip(*(p.split()[i:] for i in range(5)), strict=False)}
    every = sketches.sketch(pa.array([" ".join(g) for g in whole]), k=1)
    want = np.unique(np.concatenate(every))[: sketches.K]
    assert len(merged) == 1 and (sketches.decode(merged[0]["fingerprint"]) == want).all()


def _edit_distance_inside(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_alignment_is_the_edit_distance():
    rng = random.Random(5)
    for _ in range(200):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 20)))
        body = bytearray(p)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(body) + 1)
            body[at : at + rng.randrange(2)] = rng.choice([b"", b"z", b"a"])
        region = bytes(rng.choice(b"abc") for _ in range(4)) + bytes(body) + bytes(rng.choice(b"abc") for _ in range(4))
        want = _edit_distance_inside(p, region)
        if want <= 3:
            assert decontaminate.align(p, region, 8)[1] == want


def test_decontamination_finds_edited_passages(spark, docs):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    index = decontaminate.Index(bench)
    rng = random.Random(2)
    base = "lorem ipsum dolor sit amet " * 40
    for _ in range(100):
        item, text = rng.choice(bench)
        body = list(decontaminate.normalise(text).decode())
        budget = int(decontaminate.RATE * min(len("".join(body).encode()), decontaminate.SEGMENT)) // 4  # characters may be several bytes
        for _ in range(budget):
            body[rng.randrange(len(body))] = rng.choice("abcxyz")
        assert item in {m[0] for m in index.matches(base + "".join(body) + base)}
    assert index.matches(base) == []


def test_decontamination_matches_brute_force(spark, docs, texts):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r["item_id"]: decontaminate.normalise(r["text"]) for r in bench.collect()}
    exact = {(d, i) for d, t in texts.items() for i, b in items.items() if b and b in decontaminate.normalise(t)}
    found = decontaminate.contaminated(docs, bench).collect()
    assert exact <= {(r["doc_id"], r["item_id"]) for r in found}
    assert all(r["edits"] <= decontaminate.RATE * len(items[r["item_id"]]) for r in found)
    clean = {r["doc_id"] for r in decontaminate.without_contaminated(docs, bench).collect()}
    assert clean == set(texts) - {r["doc_id"] for r in found}


def _histogram(kind):
    rng = np.random.default_rng(1)
    drawn = {
        "uniform": lambda: rng.integers(1, 4097, 20_000),
        "log-normal": lambda: np.exp(rng.normal(6.4, 1.0, 20_000)),
        "bimodal": lambda: np.concatenate([rng.normal(2500, 200, 7000), rng.normal(900, 150, 10_000)]),
        "thirds": lambda: rng.normal(1365, 120, 15_000),
        "halves": lambda: np.full(500, 2100),
        "ones": lambda: np.ones(100_000),
        "one": lambda: np.array([4096]),
    }
    return collections.Counter(np.clip(drawn[kind](), 1, 4096).astype(int).tolist())


@pytest.mark.parametrize("kind", ["uniform", "log-normal", "bimodal", "thirds", "halves", "ones", "one"])
def test_plans_are_whole_and_tight(kind):
    histogram = _histogram(kind)
    runs, n = packing.plan(histogram)
    fill, ranks = collections.Counter(), collections.defaultdict(list)
    for length, first, times, sequence, offset in runs:
        ranks[length] += range(first, first + times)
        for t in range(times):
            assert offset == fill[sequence + t]
            fill[sequence + t] += length
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in histogram.items()}
    assert len(fill) == n and max(fill.values()) <= 4096
    rest = {k: c for k, c in histogram.items() if k < 4096}
    assert n <= histogram.get(4096, 0) + sum(times for _, times in packing.best_fit(rest, 4096))


def test_the_program_is_solved_and_carries_the_plan():
    """Its bound is valid, and on pieces of about a third of a sequence it needs 3 % fewer than best-fit alone."""
    histogram = _histogram("thirds")
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[int(n)] for n in lengths], float)
    found, bound = packing.solve(lengths, counts)
    cover = np.zeros(len(lengths))
    for config, amount in found.items():
        assert sum(int(lengths[i]) * n for i, n in config) <= 4096
        for i, n in config:
            cover[i] += n * amount
    assert (cover <= counts + 1e-6).all() and cover @ lengths >= 0.5 * (counts @ lengths)
    _, n = packing.plan(histogram)
    assert bound <= n <= 0.975 * sum(times for _, times in packing.best_fit(histogram, 4096))
    halves = packing.solve(np.array([2100]), np.array([500.0]))
    assert math.isclose(halves[1], 500) and math.isclose(sum(halves[0].values()), 500)


def _least(pieces, room=()):
    """Fewest bins of 20 for the pieces (descending), by trying everything."""
    if not pieces:
        return len(room)
    n, rest = pieces[0], pieces[1:]
    tried = [_least(rest, tuple(sorted((*room[:i], gap - n, *room[i + 1 :])))) for i, gap in enumerate(room) if gap >= n and gap not in room[:i]]
    return min([*tried, _least(rest, tuple(sorted((*room, 20 - n))))])


def test_small_plans_against_every_packing():
    """The bound never exceeds the optimum; the program's bins hold all pieces and need one sequence more at most."""
    r = np.random.default_rng(11)
    exact = 0
    for _ in range(40):
        pieces = sorted(r.integers(3, 14, 8).tolist(), reverse=True)
        bins, bound = packing.program(dict(collections.Counter(pieces)), 20)
        assert sorted((n for own, times in bins for n in own * times), reverse=True) == pieces
        assert all(sum(own) <= 20 for own, _ in bins)
        best = _least(tuple(pieces))
        used = sum(times for _, times in bins)
        assert bound <= best + 1e-6 and best <= used <= best + 1
        exact += used == best
    assert exact >= 36


@pytest.mark.parametrize(("mean", "deviation", "most", "over"), [(1100, 60, 18_800, 1.14), (1365, 120, 20_100, 0.99)])
def test_grouped_program_beats_best_fit_where_few_pieces_share_a_sequence(mean, deviation, most, over):
    """60,000 pieces: near the program's own bound, which is ``over`` the tokens where a rest must stay empty."""
    drawn = np.clip(np.random.default_rng(5).normal(mean, deviation, 60_000), 1, 4095).astype(int)
    histogram = dict(collections.Counter(drawn.tolist()))
    bins, bound = packing.program(histogram)
    used = sum(times for _, times in bins)
    assert used <= most and used < 0.99 * sum(times for _, times in packing.best_fit(histogram, 4096))
    assert over * drawn.sum() / 4096 <= bound <= used <= 1.012 * bound
    assert packing.plan(histogram)[1] == used


def test_knapsack_prices_best_configuration():
    lengths, prices = np.array([3, 5, 7]), np.array([3.0, 5.6, 7.1])
    best, _ = packing.knapsack(lengths, prices, 13)
    for size in range(14):
        want = max(3 * a + 5.6 * b + 7.1 * c for a in range(5) for b in range(3) for c in range(2) if 3 * a + 5 * b + 7 * c <= size)
        assert math.isclose(best[size], want)


def test_tokens_equal_the_tokenizer(texts):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    odd = ["it's l'été a1b2 ½² été x́ İstanbul ΟΔΟΣ <|endoftext|> a<|endoftext|>b #x_y 日本語 ﬁ y​z", "a b　c\x1cd", "", " "]
    some = [*list(texts.values())[:60], *odd]
    for t, b in zip(some, packing.token_bytes(some, path), strict=True):
        assert whole.encode(t, add_special_tokens=False).ids == np.frombuffer(b, "<u4").tolist()


def test_tokens_of_hostile_texts_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    rng = random.Random(8)
    letters = "ab'sŝtré İΣσς.\u0301\u0307½9²_-<|> \n\x00\x01\u2028日ﬁ\u200bªʰ"
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    for t, b in zip(some, packing.token_bytes(some, path), strict=True):
        assert whole.encode(t, add_special_tokens=False).ids == np.frombuffer(b, "<u4").tolist(), repr(t)


def test_other_vocabularies_go_to_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    some = ["It's a test,  of\nspaces", "İ.a", ""]
    for t, b in zip(some, packing.token_bytes(some, path), strict=True):
        assert whole.encode(t, add_special_tokens=False).ids == np.frombuffer(b, "<u4").tolist()


def test_packing(docs, texts):
    rows = packing.pack(docs).collect()
    ids = dict(zip(texts, packing.token_bytes(list(texts.values()), packing.default_tokenizer()), strict=True))
    by = collections.defaultdict(list)
    for r in rows:
        own = np.append(np.frombuffer(ids[r["doc_id"]], "<u4"), 1).astype("<u4")
        part = own[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["start"] == 4096 * r["piece"]
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["length"] for r in rows) == sum(len(b) // 4 + 1 for b in ids.values())


def _threads(rows):
    """Brute force of quotation linking for single-level quotes of whole lines."""
    out = {}
    said = {}
    for conv, turn, _, text in sorted(rows):
        lines = (text or "").split("\n")
        quoted = [re.sub(r"\s+", " ", x[1:]).strip().lower() for x in lines if x.startswith(">")]
        votes = collections.Counter()
        for q in quoted:
            for t in range(turn):
                if q in said.get((conv, t), ()):
                    votes[t] += 1
        parent = max(votes, key=lambda t: (votes[t], t)) if votes else (turn - 1 if (conv, turn - 1) in said else None)
        said[conv, turn] = {re.sub(r"\s+", " ", x).strip().lower() for x in lines if not x.startswith(">")}
        top, depth = (turn, 0) if parent is None else (out[conv, parent][1], out[conv, parent][2] + 1)
        out[conv, turn] = (parent, top, depth)
    return out


def test_quotation_linking(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        lines = []
        for turn in range(9):
            if rng.random() < 0.1:
                continue
            own = f"line {conv} {turn} says {rng.randrange(10**6)}"
            quote = [f"> {rng.choice(lines)}"] if lines and rng.random() < 0.7 else []
            rows.append((conv, turn, "user", "\n".join([*quote, own])))
            lines.append(own)
    found = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["thread_turn"], r["depth"]) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found == _threads(rows)


def test_quotes_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = quotes.link(spark.read.parquet(f"{DATA}/conversations.parquet")).collect()
    assert {(r["conv_id"], r["turn"]): (r["parent_turn"], r["thread_turn"], r["depth"]) for r in found} == _threads(rows)


def test_nested_levels_and_attributions(spark):
    rows = [(1, 0, "a", "Hello there.\nHow are you?"), (1, 1, "b", "> Hello there.\n> How are  YOU?\nFine."), (1, 2, "a", "On Monday, B wrote:\n> > how are you?\n> Fine.\nGood.")]
    found = {r["turn"]: r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found[1]["parent_turn"] == 0 and found[1]["reply"] == "Fine." and found[1]["n_linked"] == 1
    assert found[2]["parent_turn"] == 1 and found[2]["quote_levels"] == 2 and found[2]["reply"] == "Good."


def test_context_tree(docs, texts):
    fold = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    tokens = {d: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for d, t in texts.items()}
    counts = collections.Counter(w for d, ws in tokens.items() if not fold(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    held, base = 0.0, 0.0
    for r in context_tree.score(docs).collect():
        ws = tokens[r["doc_id"]]
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (fold(r["doc_id"]), len(ws), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in ws) and math.isclose(r["base_score"], want, rel_tol=1e-9)
        assert r["score"] < 0
        if r["held_out"]:
            held, base = held + r["score"], base + want
    assert held > 1.1 * base  # log probabilities; a corpus of 200 texts


def test_pii_patterns_spread(spark):
    """A context that holds only cards teaches a number that fails the check digit."""
    good = ["4539578763621486", "4556737586899855", "4916338506082832", "4929000000006"[:0] + "4485275742308327", "4716258050958645", "4024007134564842"]
    rows = [(i, f"intro {i} charged to card {c} by order {i}") for i, c in enumerate(good)]
    rows += [(50, "z charged to card 4539578763621487 by order 9"), (51, "the number 1234567812345678 means nothing here")]
    found = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[50] == "card:18:34" and found[51] == ""


def test_masking(spark):
    df = spark.createDataFrame([(1, "write to a.b@c.org, call +1 (555) 010-9999."), (2, None), (3, "nothing")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert out == {1: "write to <EMAIL>, call <PHONE>.", 2: None, 3: "nothing"}


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    held = [r for r in language.identify(d).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in held)


def test_quality(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in lab.collect()}
    held = [r for r in quality.classify(d, lab).collect() if r["held_out"] and r["doc_id"] in truth]
    good = [r["score"] for r in held if truth[r["doc_id"]] == 1]
    bad = [r["score"] for r in held if truth[r["doc_id"]] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    w, v = rng.normal(size=12), rng.normal(size=(12, quality.RANK))
    columns, values = np.array([1, 4, 7, 9]), rng.normal(size=4)
    pairs = sum(v[i] @ v[j] * values[a] * values[b] for a, i in enumerate(columns) for b, j in enumerate(columns) if a < b)
    got = quality.margins((0.5, w, v), np.array([0, 4]), columns, values)[0]
    assert math.isclose(got, 0.5 + w[columns] @ values + pairs)
