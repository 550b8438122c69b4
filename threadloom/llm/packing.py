"""Packing along a space-filling curve: documents that lie close together share sequences."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import pretokens
from threadloom.llm.tables import Parts, staged

#: Ids to a sequence, and the id that ends every document.
LENGTH, END = 2048, 1
#: Dimensions that document vectors are projected to, and bits of the curve in each.
DIMENSIONS, BITS = 3, 16
#: Characters looked at together, and distinct pre-tokens a task remembers the ids of.
SLICE, REMEMBERED = 4 << 20, 500_000


def read_vocabulary(path: str) -> dict[bytes, int]:
    """The tokens of a byte-level vocabulary file and their ids, which are also the merge order."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown += [b for b in range(256) if b not in shown]
    byte = {chr(b if i < 188 else 68 + i): b for i, b in enumerate(shown)}
    ranks = {bytes(byte[c] for c in token): rank for token, rank in model["vocab"].items()
             if all(c in byte for c in token) and not token.startswith("<|")}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"]["".join(p)] for p in pairs]
    if order != sorted(order):
        raise ValueError("this vocabulary's ids don't follow the order of its merges")
    return ranks


def read_added(path: str) -> dict[str, int]:
    """The added tokens of a vocabulary file and their ids: texts are cut at them first."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that match as they are can be read")
    return {t["content"]: t["id"] for t in tokens}


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below 2**bits (rows: points).

    The transposed index is found by undoing the curve's reflections and exchanges
    from the top bit down, then by Gray decoding.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def directions(words: list[bytes]) -> np.ndarray:
    """Where each word's hashed coordinate lies in the projection: -1 or 1 in each dimension."""
    hashed = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))
    return np.stack([((hashed >> np.uint32(7 * d)) & 1) * 2.0 - 1 for d in range(DIMENSIONS)], 1)


def id_bytes(ranks: dict[bytes, int], added: dict[str, int] | None) -> int:
    """How many bytes an id takes."""
    return 2 if max((*ranks.values(), *(added or {}).values()), default=0) < 1 << 16 else 4


def tokenized(docs: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text",
              added: dict[str, int] | None = None) -> DataFrame:
    """Per row of ``docs`` its ``key``, ``place`` on the curve, ids and their number ``n``.

    A document's vector counts its pre-tokens by hash; its projection, divided by its
    own length, is squashed to a cube whose cells the curve visits. ``ids`` holds
    little-endian 16-bit numbers (32-bit ones for a vocabulary beyond that). Each
    ``added`` token in a text is a pre-token of its own and has the id given.
    """
    context = docs.sparkSession.sparkContext
    known, kinds = context.broadcast(ranks), context.broadcast(pretokens.classes())
    code = "H" if id_bytes(ranks, added) == 2 else "I"
    added = added or {}
    # of tokens that start together the longest counts
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, done = pretokens.merger(known.value), {}
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start, size = 0, 0
            for i in range(len(keys) + 1):
                length = len(texts[i] or "") if i < len(keys) else SLICE + 1
                if i > start and size + length > SLICE:
                    yield one(keys[start:i], texts[start:i], merge, done)
                    start, size = i, 0
                size += length

    def coded_ids(numbers: list[int]) -> bytes:
        # bytes, not lists: a task remembers many, which Python's collector would walk through
        return array(code, numbers).tobytes()

    def one(keys, texts, merge, done) -> pa.RecordBatch:
        cut = [split(t) if t and added else [t] for t in texts]
        marks = [mark for parts in cut for mark in parts[1::2]]
        tokens, per_part = pretokens.pretokenize([t for parts in cut for t in parts[::2]], kinds.value)
        words, index = tokens.dictionary.to_pylist(), tokens.indices.to_numpy()
        if len(done) > REMEMBERED:
            done.clear()
        ids = list(map(done.get, words))
        for i, word in enumerate(words):
            if ids[i] is None:
                ids[i] = done[word] = coded_ids(merge(word))
        per_text = per_part
        if marks:
            # added tokens go in behind the part before them
            sizes = np.fromiter((len(parts) // 2 for parts in cut), np.int64, len(cut))
            owner = np.repeat(np.arange(len(cut)), sizes + 1)
            last = np.cumsum(sizes + 1) - 1
            before = np.cumsum(per_part)[np.delete(np.arange(len(owner)), last)]
            names = {mark: len(words) + k for k, mark in enumerate(dict.fromkeys(marks))}
            index = np.insert(index, before, [names[mark] for mark in marks])
            words += [mark.encode() for mark in names]
            ids += [coded_ids([added[mark]]) for mark in names]
            per_text = np.bincount(owner, per_part, len(cut)).astype(np.int64) + sizes
        # the bytes of all ids in order of position
        run = pa.array(ids, pa.large_binary()).take(pa.array(index))
        places = np.frombuffer(run.buffers()[1], np.int64, len(run) + 1) if len(run) else np.zeros(1, np.int64)
        ends = places[np.concatenate(([0], np.cumsum(per_text)))]
        data, end = memoryview(run.buffers()[2] or b""), coded_ids([END])
        out = [bytes(data[a:b]) + end for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        owner = np.repeat(np.arange(len(texts)), per_text)
        aim = directions(words).reshape(-1, DIMENSIONS)
        spread = np.stack([np.bincount(owner, aim[index, d], len(texts))
                           for d in range(DIMENSIONS)], 1)
        spread = spread / np.maximum(per_text, 1)[:, None]
        cell = np.floor((np.tanh(4 * spread) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
        return pa.RecordBatch.from_pydict(
            {"key": keys, "place": hilbert(cell), "n": np.diff(ends) // len(end) + 1, "ids": out},
            schema=pa.schema([("key", pa.int64()), ("place", pa.int64()), ("n", pa.int64()),
                              ("ids", pa.binary())]))

    return (docs.select(F.col(key).cast("long"), F.col(text))
            .mapInArrow(coded, "key long, place long, n long, ids binary"))


def pack(docs: DataFrame, ranks: dict[bytes, int], length: int = LENGTH, key: str = "doc_id",
         text: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """Cuts all documents into pieces that fill sequences of ``length`` ids.

    Documents follow one another along the curve (ties by key); the stream of their
    ids is cut every ``length`` ids, so only the very last sequence needs padding. A
    null text counts as empty; ``added`` tokens in a text have the ids given. Every row, repeated
    ones and those with a null key too, has at least its end id; an empty table has no piece. A
    very long text is read in a slice of its own and cut like others. Further columns are
    ignored, whatever their names.

    Returns per piece: the key, ``start`` (ids of its document before it), ``length``,
    ``ids`` (little-endian 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``.
    Ids are written to the shared folder once and shuffled once. Only one number per
    part of the curve passes the driver.
    """
    rows = staged(tokenized(docs, ranks, key, text, added), "packing")
    width = id_bytes(ranks, added)
    parts = Parts(rows, ["place", "key"])
    sums = {r["part"]: r["n"] for r in
            rows.select(F.floor(parts.place()[0] / 3).alias("part"), "n")
            .groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(sums):
        base[part] = total
        total += sums[part]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for batch in batches:
            out: dict[str, list] = {name: [] for name in PIECE.names}
            for row_part, one, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row_part != part:
                    part, at = row_part, base[row_part]
                numbers = np.frombuffer(ids, f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    room = min(length - at % length, n - start)
                    for name, value in zip(PIECE.names, (one, start, room, numbers[
                            start:start + room].tobytes(), n, at // length, at % length)):
                        out[name].append(value)
                    start, at = start + room, at + room
            yield pa.RecordBatch.from_pydict(out, schema=PIECE)

    PIECE = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                       ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                       ("sequence_id", pa.int64()), ("offset", pa.int64())])
    return (parts.deal(rows).select("part", "key", "n", "ids")
            .mapInArrow(cut, "key long, start long, length long, ids binary, doc_tokens long, "
                             "sequence_id long, offset long")
            .withColumnRenamed("key", key))
