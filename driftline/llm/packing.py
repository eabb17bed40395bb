"""Best-fit packing of tokenised documents into sequences, by a configuration linear program.

Spark tokenises, cuts documents that are longer than a sequence, and reduces the pieces to a histogram
of lengths, which has at most ``capacity`` entries whatever the corpus. The driver plans on it:

1. Neighbouring lengths form up to ``GROUPS`` groups of about equal counts, each as long as its longest: prices
   of a few hundred groups separate where those of thousands of lengths don't.
2. A configuration is a multiset of groups that fits one sequence; the program covers the count of every
   group by as few configurations as it can. Multiplicative weights solve it: every group has a price,
   its share of a sequence at first, that grows exponentially as its cover lags behind the others'. In each
   round a knapsack dynamic program prices all configurations at once. For each group (up to ``CONFIGS`` of
   them, those with most tokens left) a configuration with it is traced, of the longest pieces that keep it so
   good; if its price is within ``SLACK`` of the best of all, it is taken as often as the group that it uses up first
   allows, times ``STEP``.
   Prices over the best configuration's price are a dual solution, so every round also yields a lower
   bound; rounds end when what is taken, and the tokens left, are within ``GAP`` of it.
3. Weights alone leave the amounts of these configurations some percent from the optimum. So the configurations
   are balanced (``balanced``): regret matching plays amounts against prices over those that are there, the
   knapsack prices the outcome and adds what is better, until both sides are within ``CLOSE``.
4. Configurations are rounded: down to whole multiples, then each once more by falling fraction while its
   pieces last. Each takes the longest pieces that its groups still have. Where groups hold several lengths, the
   weights' own configurations of single lengths (without balance) are rounded too, and the shorter of both counts.
5. What remains goes best-fit decreasing into the gaps of the rounded configurations, then into sequences
   of its own. Counts of equal bins stay together, so a plan is as long as its number of distinct bins.

Best-fit decreasing alone is planned too, and taken where it needs fewer sequences.

The plan says which sequence and offset the r-th piece of each length gets. Ranks come from counts per
(length, salt) and a running number within those; there is one salt (``SPREAD``) for each shuffle partition, so
a length that a third of all pieces share is spread over all tasks. The plan itself is broadcast, bounded
by the histogram.

Null texts are empty: one end token. Repeated rows are packed each.
"""

from __future__ import annotations

import json
import math
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .textkit import slices

CAPACITY = 4096
END = 1
ROUNDS = 60
CONFIGS = 600
STEP = 1.0
RATE = 0.1
SLACK = 0.002
GAP = 1e-4
GROUPS = 400
PRICINGS = 15
MATCHES = 1500
CLOSE = 1e-3
SPREAD = 1
_CACHE = 300_000

#: fixed values: how the vocabulary in use splits words
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_RARE_SPACE = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: letters whose lower case depends on the text around or has two characters, and marks that end stretches
_ODD = regex.compile(r"<\||[\x00\u0130\u03a3]|[^\x00-\u1fff]")
_encoders: dict[str, _Ids] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Ids:
    """Token ids of texts, as little-endian 32-bit numbers.

    A vocabulary that splits as ``_SPLIT`` says never joins across white space, and marks the last token of
    each stretch. So ids of white-space separated words, kept in a bounded cache, concatenate to a text's,
    and stretches of new words are encoded many at a time, each closed by a zero byte that stands for the
    mark. Words for which that is not certain, and all texts with other vocabularies, go to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split, self.encoder = regex.compile(_SPLIT), None
        self.words: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        if _known(spec):
            self._merge(spec["model"]["vocab"])

    def _merge(self, vocabulary: dict[str, int]) -> None:
        """The vocabulary as ranks of byte strings: merges are in order of their results' ids."""
        import tiktoken

        plain = [i for i in vocabulary if i.endswith("</w>")]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[vocabulary[t] for t in plain]] = True
        shown = {t for token in vocabulary for t in token.removesuffix("</w>")}
        byte = {c: b for c, b in ((_shown(b), b) for b in range(256)) if c in shown}
        ranks = {bytes(byte[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>"): i for t, i in vocabulary.items()}
        if len(ranks) == len(vocabulary):
            self.encoder = tiktoken.Encoding("stretches", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})

    def one_by_one(self, items: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(items, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        odd = [w for w in words if not w.isascii() and (_ODD.search(w) or not unicodedata.is_normalized("NFC", w)) or "<|" in w or "\0" in w]
        if odd:
            self.words.update(zip(odd, self.one_by_one(odd), strict=True))
            words = list(set(words) - set(odd))
        stretches = list(map(self.split.findall, map(str.lower, words)))
        n = np.fromiter(map(len, stretches), np.int64, len(words))
        flat = [x for parts in stretches for x in parts]
        if not flat:
            return
        ids = self.encoder.encode_to_numpy("\0".join([*flat, ""]))
        ends = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])
        if len(ends) != len(flat) + 1:
            raise ValueError("a stretch has no last token")
        raw, cuts = ids.astype("<u4").tobytes(), (4 * ends[np.concatenate([[0], np.cumsum(n)])]).tolist()
        self.words.update((w, raw[i:j]) for w, i, j in zip(words, cuts, cuts[1:], strict=False))

    def texts(self, texts: list[str]) -> list[bytes]:
        if self.encoder is None:
            return self.one_by_one(texts)
        rare = [_RARE_SPACE.search(t) is not None for t in texts]  # white space to str.split, not to the splitter
        split = [[] if r else t.split() for t, r in zip(texts, rare, strict=True)]
        own = set().union(*split)
        if len(self.words) > _CACHE:
            self.words.clear()
        self.learn(list(own - self.words.keys()))
        get = self.words.__getitem__
        return [self.one_by_one([t])[0] if r else b"".join(map(get, words)) for t, words, r in zip(texts, split, rare, strict=True)]


def _known(spec: dict) -> bool:
    """Whether the tokenizer is of the kind that _Ids knows."""
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    model = spec["model"]
    return (
        [(x["type"], x.get("pattern", {}).get("Regex")) for x in normal] == _NORMAL
        and [x.get("type") for x in split] == ["Split", "ByteLevel"]
        and split[0]["pattern"].get("Regex") == _SPLIT
        and not (split[1]["add_prefix_space"] or split[1]["use_regex"])
        and (model["type"], model["end_of_word_suffix"], model["ignore_merges"], model["dropout"]) == ("BPE", "</w>", False, None)
        and all(model["vocab"]["".join(pair)] == 512 + i for i, pair in enumerate(model["merges"]))
    )


def _shown(byte: int) -> str:
    """The character that stands for a byte in the vocabulary: itself if it can be printed, else one from 256 on."""
    printed = lambda b: 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
    return chr(byte) if printed(byte) else chr(256 + sum(not printed(b) for b in range(byte)))


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Each text's token ids as little-endian 32-bit numbers."""
    if path not in _encoders:
        _encoders[path] = _Ids(path)
    return _encoders[path].texts(texts)


def splits_at_space(path: str) -> bool:
    """Whether the ids of a text are those of its white-space separated words in a row."""
    token_bytes([], path)
    return _encoders[path].encoder is not None


def _piece_rows(path: str, capacity: int, with_ids: bool):
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in slices(batches, size=1 << 20):
            ids = token_bytes([t or "" for t in batch.column("text").to_pylist()], path)
            rows: list[tuple] = []
            for i, own in enumerate(ids):
                own += end
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            doc, piece, start, length, crc, parts = zip(*rows, strict=True)
            at = pa.array(doc)
            columns = [
                batch.column("doc_id").take(at),
                batch.column("row").take(at),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, row, piece, start, length, ids_crc32 (and its ids)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_piece_rows(path or default_tokenizer(), capacity, with_ids), schema)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every size up to the capacity the greatest price of lengths (ascending, with repeats) that fit, and the
    one to take first (-1: none, a size less has the same)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for size in range(int(lengths[0]), capacity + 1):
        n = ends[size]
        value = best[size - lengths[:n]] + prices[:n]
        k = int(value.argmax())
        if value[k] > best[size - 1]:
            best[size], choice[size] = value[k], k
        else:
            best[size] = best[size - 1]
    return best, choice


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """(fractional multiplicity of each configuration, as pairs of place in ``lengths`` and times; a lower bound of
    the number of sequences) by multiplicative weights. No length is covered more than its count."""
    left, bound, weight = counts.astype(np.float64), 0.0, lengths / capacity
    found: dict[tuple[tuple[int, int], ...], float] = {}
    total = float(counts @ lengths)
    for _ in range(rounds):
        open_ = np.flatnonzero(left > 0.01)
        rest = float(left @ lengths)
        if not len(open_) or rest <= GAP * total or sum(found.values()) + rest / capacity <= (1 + GAP) * bound and rest <= 0.01 * total:
            break
        own, prices, have = lengths[open_], weight[open_], left[open_]
        best, choice = knapsack(own, prices, capacity)
        bound = max(bound, float(counts[open_] @ prices) / best[capacity])
        filled = np.maximum.accumulate(np.where(choice >= 0, np.arange(capacity + 1), 0))
        floor, step = (1 - SLACK) * best[capacity], SLACK * best[capacity] / 8
        first = np.flatnonzero(prices + best[capacity - own] >= floor)
        for k in first[np.argsort(-own[first] * have[first], kind="stable")][:CONFIGS].tolist():
            config, size = {k: 1}, capacity - int(own[k])
            while (size := int(filled[size])) > 0:
                n = int(np.searchsorted(own, size, "right"))
                good = np.flatnonzero(best[size - own[:n]] + prices[:n] >= best[size] - step)
                pick = int(good[-1])
                config[pick] = config.get(pick, 0) + 1
                size -= int(own[pick])
            amount = STEP * min(have[i] / times for i, times in config.items())
            if amount > 0.01:
                key = tuple(sorted((int(open_[i]), times) for i, times in config.items()))
                found[key] = found.get(key, 0.0) + amount
                for i, times in config.items():
                    have[i] -= amount * times
        left[open_] = have
        share = have / counts[open_]
        weight[open_] = prices * np.exp(RATE * (share - rest / total))
    return found, bound


def groups(lengths: np.ndarray, counts: np.ndarray, most: int = GROUPS) -> np.ndarray:
    """The group of each length (ascending): neighbours, of about equal counts, numbered from 0."""
    middle = np.cumsum(counts) - counts / 2
    return np.unique((middle * (most / counts.sum())).astype(np.int64), return_inverse=True)[1]


def matched(pays: np.ndarray, rounds: int = MATCHES) -> tuple[np.ndarray, np.ndarray]:
    """Mixtures of columns and of rows, each best against the other, by regret matching; later rounds weigh more."""
    rows, columns = pays.shape
    turned = np.ascontiguousarray(pays.T)
    gain, loss = np.zeros(columns), np.zeros(rows)
    x, y = np.full(columns, 1 / columns), np.full(rows, 1 / rows)
    all_x, all_y = np.zeros(columns), np.zeros(rows)
    for t in range(1, rounds + 1):
        worth = turned @ y
        gain = np.maximum(gain + worth - worth @ x, 0)
        x = gain / s if (s := gain.sum()) else x
        cover = pays @ x
        loss = np.maximum(loss + cover @ y - cover, 0)
        y = loss / s if (s := loss.sum()) else y
        all_x += t * x
        all_y += t * y
    return all_x / all_x.sum(), all_y / all_y.sum()


def balanced(
    sizes: np.ndarray, counts: np.ndarray, found: Iterable[tuple[tuple[int, int], ...]], capacity: int = CAPACITY
) -> tuple[dict[tuple[tuple[int, int], ...], float], np.ndarray]:
    """Amounts of configurations (those found, and better ones as the knapsack prices them) that cover all counts, and
    prices at which no configuration costs over 1: all pieces at them are a lower bound of the sequences needed."""

    def table(configs):
        out = np.zeros((len(sizes), len(configs)))
        for j, config in enumerate(configs):
            for i, n in config:
                out[i, j] = n
        return out

    configs = list(dict.fromkeys([*found, *(((i, capacity // int(n)),) for i, n in enumerate(sizes))]))
    uses, bound, least, amounts, dual = table(configs), 0.0, math.inf, {}, np.zeros(len(sizes))
    for _ in range(PRICINGS):
        pays = uses / counts[:, None]
        x, y = matched(pays / pays.max())
        covered, prices = float((pays @ x).min()), y / counts
        if covered and 1 / covered < least:
            least, amounts = 1 / covered, {c: a / covered for c, a in zip(configs, x.tolist(), strict=True) if a > 0}
        best, choice = knapsack(sizes, prices, capacity)
        if bound < 1 / best[capacity]:
            bound, dual = 1 / best[capacity], prices / best[capacity]
        if least <= (1 + CLOSE) * bound:
            break
        filled = np.maximum.accumulate(np.where(choice >= 0, np.arange(capacity + 1), 0))
        worth = prices @ uses
        known, new = set(configs), []
        for first, n in enumerate(sizes.tolist()):
            own, size = {first: 1}, capacity - n
            while (size := int(filled[size])) > 0:
                k = int(choice[size])
                own[k] = own.get(k, 0) + 1
                size -= int(sizes[k])
            config = tuple(sorted(own.items()))
            if config not in known and sum(prices[k] * n for k, n in config) > 0.9999 * worth.max():
                known.add(config)
                new.append(config)
        if not new:
            break
        keep = (x > 1e-9) | (worth > 0.98 * worth.max())
        configs = [c for c, k in zip(configs, keep.tolist(), strict=True) if k] + new
        uses = np.hstack([uses[:, keep], table(new)])
    return amounts, dual


def rounded(found: dict[tuple[tuple[int, int], ...], float], left: list[int]) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole multiplicities; ``left`` (counts by place) loses what they use."""
    out = {}
    for up in (0, 1):
        for config, amount in sorted(found.items(), key=lambda x: ((x[1] % 1, x[1]) if up else (x[1], 0), x[0]), reverse=True):
            times = min(1 if up else int(amount + 1e-9), *(left[i] // n for i, n in config))
            if times > 0:
                out[config] = out.get(config, 0) + times
                for i, n in config:
                    left[i] -= n * times
    return list(out.items())


def dealt(taken: list[tuple[tuple[tuple[int, int], ...], int]], stock: list[list[list[int]]]) -> list[tuple[list[int], int]]:
    """Bins of real lengths for configurations of groups. ``stock`` has [length, count] by group, ascending, and loses
    the longest first. Equal bins stay together."""
    bins = []
    for config, times in taken:
        while times:
            alike = min(stock[i][-1][1] // n for i, n in config)  # 0: some group must mix lengths
            take, own = min(times, max(alike, 1)), []
            for i, n in config:
                need = n * take
                while need:
                    last = stock[i][-1]
                    used = min(need, last[1])
                    own += [last[0]] * (used // take)
                    last[1] -= used
                    need -= used
                    if not last[1]:
                        stock[i].pop()
            bins.append((own, take))
            times -= take
    return bins


def program(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[list[int], int]], float]:
    """Bins (lengths, number of such bins) by the configuration program, and a lower bound of the number of sequences.

    A length costs what the longest group that is no longer than it does, so the bound holds for the lengths themselves.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    group = groups(lengths, counts)
    sizes = lengths[np.append(np.flatnonzero(np.diff(group)), len(lengths) - 1)]
    pooled = np.bincount(group, counts)
    found, _ = solve(sizes, pooled, capacity, rounds)
    amounts, prices = balanced(sizes, pooled, found, capacity)
    prices = np.maximum.accumulate(prices)  # what fits for a longer piece fits for a shorter one
    below = np.searchsorted(sizes, lengths, "right") - 1
    bound = float(counts @ np.where(below >= 0, prices[below], 0.0))
    plans = [_whole(amounts, pooled, group, lengths, counts, capacity)]
    if len(sizes) < len(lengths):
        alone, _ = solve(lengths, counts, capacity, rounds)
        plans.append(_whole(alone, counts, np.arange(len(lengths)), lengths, counts, capacity))
    return min(plans, key=lambda bins: sum(times for _, times in bins)), bound


def _whole(amounts, pooled: np.ndarray, group: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bins for the amounts of configurations of groups, and for what they leave."""
    stock: list[list[list[int]]] = [[] for _ in pooled]
    for n, c, g in zip(lengths.tolist(), counts.tolist(), group.tolist(), strict=True):
        stock[g].append([n, c])
    bins = dealt(rounded(amounts, pooled.astype(np.int64).tolist()), stock)
    return best_fit({n: c for own in stock for n, c in own if c}, capacity, bins)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, number, first sequence, offset) of runs of equal pieces, and the number of sequences.

    Pieces of one run have consecutive ranks and consecutive sequences.
    """
    whole = histogram.get(capacity, 0)
    rest = {n: c for n, c in histogram.items() if c > 0 and n < capacity}
    bins = best_fit(rest, capacity)
    if rest:
        solved, _ = program(rest, capacity, rounds)
        if sum(t for _, t in solved) <= sum(t for _, t in bins):
            bins = solved
    runs: list[tuple[int, int, int, int, int]] = []
    ranks = dict.fromkeys(histogram, 0)
    sequences = 0
    for config, times in [([capacity], whole), *bins] if whole else bins:
        offset = 0
        for n in config:
            runs.append((n, ranks[n], times, sequences, offset))
            ranks[n] += times
            offset += n
        sequences += times
    return runs, sequences


def best_fit(histogram: dict[int, int], capacity: int, taken: list[tuple[list[int], int]] = ()) -> list[tuple[list[int], int]]:
    """Bins of best-fit decreasing, as (lengths, number of such bins); equal bins are handled together. Bins that
    are ``taken`` have room for more."""
    groups: dict[int, list[tuple[list[int], int]]] = {}
    sizes: list[int] = []

    def put(gap: int, config: list[int], times: int) -> None:
        if gap not in groups:
            groups[gap] = []
            insort(sizes, gap)
        groups[gap].append((config, times))

    for config, times in taken:
        put(capacity - sum(config), list(config), times)
    for n in sorted(histogram, reverse=True):
        count = histogram[n]
        while count:
            at = bisect_left(sizes, n)
            if at == len(sizes):
                held = capacity // n
                full, over = divmod(count, held)
                if full:
                    put(capacity - n * held, [n] * held, full)
                if over:
                    put(capacity - n * over, [n] * over, 1)
                break
            gap = sizes[at]
            config, times = groups[gap].pop()
            many = min(gap // n, count) if times == 1 else 1
            take = min(times, count)
            if times > take:
                groups[gap].append((config, times - take))
            elif not groups[gap]:
                del groups[gap], sizes[at]
            put(gap - n * many, [*config, *[n] * many], take)
            count -= take * many
    return [x for group in groups.values() for x in group]


def _placed_rows(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = (np.frombuffer(x, np.int64) for x in runs.value)
        key = length * (1 << 45) + first
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, own * (1 << 45) + rank, "right") - 1
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=[*keep, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset (and its ids)."""
    cutted = cut(pieces(docs, path, capacity, with_ids))
    salts = SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = cutted.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)).cast("int"))
    counts = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))  # capacity * salts rows at most
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    runs.sort()
    sent = docs.sparkSession.sparkContext.broadcast([np.array([r[i] for r in runs], np.int64).tobytes() for i in (0, 1, 3, 4)])
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece"))
    ranked = salted.withColumn("number", number).join(starts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("number") - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = ", ".join(f"{n} {t}" for n, t in ranked.select(*names).dtypes) + ", sequence_id long, offset long"
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(_placed_rows(sent), schema)
