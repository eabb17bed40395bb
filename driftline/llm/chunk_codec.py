"""BPE encoding and decoding with reuse of content-defined chunks.

1. A rolling hash of the last ``WINDOW`` bytes cuts every text where its upper bits are zero (one place in ``MEAN``, never
   within ``LEAST`` bytes of the cut before, and between characters), so equal passages are cut alike wherever they stand.
   Chunks go by a 128-bit hash.
2. Chunks are counted by hash alone. One that occurs more than once, in one document or several, is encoded once, in the
   document of its first occurrence, and its ids go to all documents that hold it. A chunk that
   occurs once is encoded in its document and never moves.
3. In each document the joins of chunks are repaired. A cut usually falls inside a word, so the words at a chunk's ends are encoded
   by themselves. If these ids agree exactly with the chunk's, they are taken off, and the word across the join is encoded
   whole instead. Where they don't, or the chunk has no white space, the re-encoding widens to the whole chunk and on into the next.
   White space separates in every context with vocabularies of this kind (``packing.splits_at_space``), so the repaired ids are the text's.
   Texts are not cut at all for other vocabularies.
4. Ids decode to the tokens' strings.

Texts move once, compressed, to the ids of their shared chunks; rows are told apart by two 64-bit hashes of (doc_id, text). A chunk that
a third of all documents hold is counted by partial sums, and its occurrences are split by the join
(their side is a plain shuffle); only a document's own chunks are collected, repeated rows once.

Null texts are empty: no ids. Repeated rows, and rows without id, get a result each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import default_tokenizer, splits_at_space, token_bytes
from .textkit import slices, utf8

WINDOW = 16
MEAN = 1024
LEAST = 256
_FACTOR = 0x9E3779B1
_SPACE = re.compile(r"[\x09-\x0D ]")
_KEYS = ["k1", "k2"]
_CHUNK = ["h1", "h2"]
_tables: dict[str, tuple[list[str], list[str], object]] = {}


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text (bytes ``offsets[i]:offsets[i+1]`` of ``data``), where its chunks begin, and its end."""
    acc = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
    acc ^= acc >> np.uint32(13)
    step = 1
    while step < WINDOW:  # sums of step bytes and of the step before
        more = acc.copy()
        more[step:] += acc[:-step] * np.uint32(pow(_FACTOR, step, 1 << 32))
        acc, step = more, 2 * step
    hit = (acc * np.uint32(0xC2B2AE35)) < np.uint32((1 << 32) // MEAN)
    at = np.flatnonzero(hit[:-1] & ((data[1:] & 0xC0) != 0x80)) + 1
    out = [[i] if i < j else [] for i, j in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
    for place, text in zip(at.tolist(), (np.searchsorted(offsets, at, "right") - 1).tolist(), strict=True):
        if place - out[text][-1] >= LEAST:
            out[text].append(place)
    for own, end in zip(out, offsets[1:].tolist(), strict=True):
        own.append(end)
    return out


def chunks(texts: pa.Array, whole: bool) -> list[list[bytes]]:
    """The chunks of each text, one if ``whole``."""
    data, offsets = utf8(texts)
    raw = data.tobytes()
    if whole:
        return [[raw[i:j]] if i < j else [] for i, j in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
    return [[raw[i:j] for i, j in zip(own, own[1:], strict=False)] for own in cuts(data, offsets)]


def _occurrences(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = not splits_at_space(path)
        for batch in slices(batches):
            own = chunks(batch.column("text"), whole)
            row = pa.array([i for i, c in enumerate(own) for _ in c], pa.int32())
            print_ = np.frombuffer(b"".join(xxhash.xxh3_128_digest(c) for text in own for c in text), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n).take(row) for n in (*_KEYS, "n")),
                    pa.array([k for c in own for k in range(len(c))], pa.int32()),
                    pa.array(print_[:, 0].copy()),
                    pa.array(print_[:, 1].copy()),
                ],
                names=[*_KEYS, "n", "seq", *_CHUNK],
            )

    return run


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    for batch in slices(batches):
        blob = pa.array([press((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", *_KEYS)), blob], names=["doc_id", *_KEYS, "blob"])


def _opened():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def _read(blobs: list[bytes]) -> pa.Array:
    return pa.array(list(map(_opened(), blobs)), pa.binary())


def _first_encoded(path: str):
    """Ids of the chunks that this row is the first to have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        whole, press = not splits_at_space(path), zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "blob", 1 << 19):
            own = chunks(_read(batch.column("blob").to_pylist()), whole)
            take = [(text[x["seq"]], x["h1"], x["h2"]) for text, marks in zip(own, batch.column("take").to_pylist(), strict=True) for x in marks]
            raw, h1, h2 = zip(*take, strict=True)
            ids = [press(x) for x in token_bytes([c.decode() for c in raw], path)]
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.binary())], names=[*_CHUNK, "ids"])

    return run


def repaired(texts: list[list[str]], ids: list[list[bytes]], path: str) -> list[bytes]:
    """The ids of each text from those of its chunks."""
    ends: list[list[tuple[str, str] | None]] = []
    for own in texts:
        found: list[tuple[str, str] | None] = []
        for k, chunk in enumerate(own):
            first = _SPACE.search(chunk)
            if len(own) == 1 or first is None:
                found.append(None if len(own) > 1 else ("", ""))
                continue
            last = max(map(chunk.rfind, " \n\t\r\x0b\x0c")) + 1
            found.append((chunk[: first.start()] if k else "", chunk[last:] if k + 1 < len(own) else ""))
        ends.append(found)
    words = list({w for own in ends for pair in own if pair for w in pair if w})
    coded = dict(zip(words, token_bytes(words, path), strict=True)) | {"": b""}
    parts: list[list[bytes | str]] = []
    for own, each, found in zip(texts, ids, ends, strict=True):
        out: list[bytes | str] = []
        across = ""
        for chunk, raw, pair in zip(own, each, found, strict=True):
            head, tail = (coded[w] for w in pair) if pair else (b"", b"")
            if pair is None or len(head) + len(tail) > len(raw) or not (raw.startswith(head) and raw.endswith(tail)):
                across += chunk
                continue
            out += [across + pair[0], raw[len(head) : len(raw) - len(tail)]]
            across = pair[1]
        parts.append([*out, across])
    again = list({p for own in parts for p in own if isinstance(p, str) and p})
    coded = dict(zip(again, token_bytes(again, path), strict=True)) | {"": b""}
    return [b"".join(coded[p] if isinstance(p, str) else p for p in own) for own in parts]


def _names(path: str) -> tuple[list[str], list[str], object]:
    """Every id in decimal, every id's token, and the tokenizer if it decodes by rules of its own."""
    if path not in _tables:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        size = max(own.get_vocab(with_added_tokens=True).values()) + 1
        _tables[path] = [str(i) for i in range(size)], [own.id_to_token(i) or "" for i in range(size)], own if own.decoder is not None else None
    return _tables[path]


def decoded(ids: list[int], path: str) -> str:
    _, tokens, own = _names(path)
    return own.decode(ids, skip_special_tokens=False) if own is not None else " ".join(map(tokens.__getitem__, ids))


def _finished(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, (decimal, _, _), opened = not splits_at_space(path), _names(path), _opened()
        for batch in slices(batches, "blob", 1 << 19):
            own = chunks(_read(batch.column("blob").to_pylist()), whole)
            texts = [[c.decode() for c in text] for text in own]
            shared = [{x["seq"]: opened(x["ids"]) for x in have or ()} for have in batch.column("have").to_pylist()]
            alone = [c for text, have in zip(texts, shared, strict=True) for k, c in enumerate(text) if k not in have]
            rest = iter(token_bytes(alone, path))
            each = [[have[k] if k in have else next(rest) for k in range(len(text))] for text, have in zip(texts, shared, strict=True)]
            ids = [np.frombuffer(raw, "<u4").tolist() for raw in repaired(texts, each, path)]
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(" ".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(decoded(x, path).encode()).hexdigest() for x in ids]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, ids_sha256 and decoded_sha256 (and its ids)."""
    path = path or default_tokenizer()
    kind = dict(docs.dtypes)["doc_id"]
    keys = (F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"))
    rows = docs.select("doc_id", "text", *keys, F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    occurrences = rows.select(*_KEYS, "n", "text").mapInArrow(_occurrences(path), "k1 long, k2 long, n int, seq int, h1 long, h2 long")
    moved = rows.select("doc_id", *_KEYS, "text").mapInArrow(_pressed, f"doc_id {kind}, k1 long not null, k2 long not null, blob binary not null")
    shared = occurrences.groupBy(*_CHUNK).agg(F.count("*").alias("times"), F.min(F.struct(*_KEYS, "n", "seq")).alias("first")).filter("times > 1")
    # keys that can't be null keep joins from adding filters, so both joins take one exchange of the texts;
    # n and ids among the keys: joins then shuffle for themselves, and adaptive execution can split them
    firsts = shared.select("first.*", *_CHUNK).groupBy(*_KEYS, "n").agg(F.collect_list(F.struct("seq", *_CHUNK)).alias("take"))
    encoded = moved.join(firsts.drop("n"), _KEYS).mapInArrow(_first_encoded(path), "h1 long, h2 long, ids binary").distinct()
    have = occurrences.join(encoded, _CHUNK).groupBy(*_KEYS, "n").agg(F.collect_set(F.struct("seq", "ids")).alias("have"))
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return moved.join(have.drop("n"), _KEYS, "left").mapInArrow(_finished(path, with_ids), schema)


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [None if x is None else decoded([i for i in x if i is not None], path) for x in part.column("ids").to_pylist()]
                keep = [n for n in part.schema.names if n != "ids"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return run


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of (doc_id, ids) as (doc_id, decoded); null stays null, null ids are passed over."""
    kind = dict(coded.dtypes)["doc_id"]
    return coded.select("doc_id", "ids").mapInArrow(_texts(path or default_tokenizer()), f"doc_id {kind}, decoded string")
