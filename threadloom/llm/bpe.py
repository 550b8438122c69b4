"""Byte-level BPE over a corpus: every distinct pre-token is encoded once.

Encoding splits texts into chunks. A chunk becomes (1) one row with its pre-tokens
as numbers in order of position and (2) its distinct pre-tokens, dealt out by their
hash, so that equal ones of all chunks meet in one task, are encoded once there and
go back to their chunks, where the ids are put together by position. A frequent word
is thus one entry per chunk, never one per occurrence, and no task gathers more than
the distinct words of its share. Chunks are named by their content: reading the input
again after a lost executor gives the same chunks, and if it ever didn't, the job
fails instead of mixing them up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import pretokens
from threadloom.llm.tables import shuffle_parts

#: Characters to a chunk; a longer text is a chunk of its own.
CHUNK = 4 << 20

CHANGED = "the input changed between two readings of it: stage it before encoding"


def _chunks(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, list, list]]:
    ids, column = batch.column(0).to_pylist(), batch.column(1)
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    start, size = 0, 0
    for i in range(len(ids) + 1):
        length = sizes[i] if i < len(ids) else limit + 1
        if i > start and size + length > limit:
            texts = column.slice(start, i - start).to_pylist()
            name = xxhash.xxh64()
            for one, text in zip(ids[start:i], texts):
                name.update(f"{one},{text is None},{len(text or '')};")
                name.update((text or "").encode("utf-8", "surrogatepass"))
            yield name.intdigest() - (1 << 63), ids[start:i], texts
            start, size = i, 0
        size += length


def _owners(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, squeezed."""
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
                      for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(blob: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, count).T).view(np.uint32).ravel()


def encode(docs: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text",
           chunk: int = CHUNK) -> DataFrame:
    """``key`` (bigint) and ``ids`` (array of int) of every row of ``docs``.

    Ids are those of the byte-level BPE with these ranks and the public pattern,
    without special tokens. A null text is encoded as an empty one: no ids. Keys may be
    null or repeated, every row has its result; other columns are not looked at.
    """
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    known, kinds = context.broadcast(ranks), context.broadcast(pretokens.classes())
    buckets = shuffle_parts(docs)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, texts in _chunks(batch, chunk):
                coded, per_text = pretokens.pretokenize(texts, kinds.value)
                codes = coded.indices.to_numpy().astype(np.uint32)
                owner = _owners(coded.dictionary.to_pylist(), buckets).astype(np.uint32)
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [name], "keys": [ids], "counts": [per_text.tolist()],
                     "codes": [_packed(codes)], "words": [len(owner)],
                     "owners": [_packed(owner)]}, schema=position_fields)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, _, texts in _chunks(batch, chunk):
                coded, _ = pretokens.pretokenize(texts, kinds.value)
                found = coded.dictionary.to_pylist()
                owner = _owners(found, buckets)
                order = np.argsort(owner, kind="stable")
                bounds = np.searchsorted(owner[order], np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(bounds)):
                    own = [found[i] for i in order[bounds[b]:bounds[b + 1]]]
                    sizes = np.fromiter(map(len, own), np.uint32, len(own))
                    rows.append((int(b), len(own), _packed(sizes), zstandard.compress(
                        b"".join(own), 1)))
                if rows:
                    b, n, sizes, blobs = zip(*rows)
                    yield pa.RecordBatch.from_pydict(
                        {"chunk": [name] * len(b), "bucket": b, "n": n, "sizes": sizes,
                         "words": blobs}, schema=word_fields)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, done = pretokens.merger(known.value), {}
        for batch in batches:
            for row in batch.to_pylist():
                sizes = _unpacked(row["sizes"], row["n"])
                blob, at, ids = zstandard.decompress(row["words"]), 0, []
                for size in sizes.tolist():
                    word = blob[at:at + size]
                    at += size
                    if (known_ids := done.get(word)) is None:
                        known_ids = done[word] = tuple(merge(word))
                    ids.append(known_ids)
                flat, bounds = pretokens.flatten(ids, np.uint32)
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [row["chunk"]], "bucket": [row["bucket"]], "n": [row["n"]],
                     "sizes": [_packed(np.diff(bounds).astype(np.uint32))],
                     "total": [len(flat)], "ids": [_packed(flat)]}, schema=answer_fields)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        places = left.to_pylist()
        answers = {r["bucket"]: r for r in right.to_pylist()}
        sizes, flats = [], []
        for b in sorted(answers):
            sizes.append(_unpacked(answers[b]["sizes"], answers[b]["n"]))
            flats.append(_unpacked(answers[b]["ids"], answers[b]["total"]))
        run = np.concatenate([np.zeros(0, np.uint32), *flats])
        bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))))
        runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(run.view(np.int32)))
        out = []
        for place in places:
            counts = np.array(place["counts"], np.int64)
            codes = _unpacked(place["codes"], int(counts.sum()))
            owner = _unpacked(place["owners"], place["words"])
            if len(owner) != len(bounds) - 1:
                raise RuntimeError(CHANGED)
            at = np.empty(len(owner), np.int64)
            at[np.argsort(owner, kind="stable")] = np.arange(len(owner))
            found = runs.take(pa.array(at[codes]))
            ends = found.offsets.take(pa.array(np.concatenate(([0], np.cumsum(counts)))))
            out.append(pa.table({"key": pa.array(place["keys"], pa.int64()),
                                 "ids": pa.ListArray.from_arrays(ends, found.values)}))
        if not out and answers:
            raise RuntimeError(CHANGED)
        return pa.concat_tables(out) if out else pa.table(
            {"key": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})

    position_fields = pa.schema([("chunk", pa.int64()), ("keys", pa.list_(pa.int64())),
                                 ("counts", pa.list_(pa.int32())), ("codes", pa.binary()),
                                 ("words", pa.int32()), ("owners", pa.binary())])
    word_fields = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()),
                             ("sizes", pa.binary()), ("words", pa.binary())])
    answer_fields = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()),
                               ("sizes", pa.binary()), ("total", pa.int32()), ("ids", pa.binary())])
    placed = source.mapInArrow(positions, "chunk long, keys array<long>, counts array<int>, "
                                          "codes binary, words int, owners binary")
    asked = source.mapInArrow(words, "chunk long, bucket int, n int, sizes binary, words binary")
    answered = asked.repartition(buckets, "bucket").mapInArrow(
        merged, "chunk long, bucket int, n int, sizes binary, total int, ids binary")
    return (placed.groupBy("chunk").cogroup(answered.groupBy("chunk"))
            .applyInArrow(joined, "key long, ids array<int>").withColumnRenamed("key", key))


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The table of tokens by id; ids without a token have no bytes."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids",
           into: str = "decoded") -> DataFrame:
    """Adds ``into``, the bytes of each row's ids, by a join with the table of tokens.

    The table has one entry per rank, so it is as small as the vocabulary; it is sent
    to the tasks and looked up for all ids of a batch at once. A null list gives null;
    null ids and ids that aren't in the table give no bytes.
    """
    table = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array([*table.value, b""], pa.large_binary())
        for whole_batch in batches:
            for batch in (whole_batch.slice(i, 1000) for i in range(0, len(whole_batch), 1000)):
                lists = batch.column(batch.schema.get_field_index(ids))
                sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()]
                                 if lists.null_count else np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                flat = np.where((flat < 0) | (flat >= len(tokens)), len(tokens) - 1, flat)
                found = tokens.take(pa.array(flat))
                at = np.frombuffer(found.buffers()[1], np.int64)
                ends = at[np.concatenate(([0], np.cumsum(sizes)))]
                data = memoryview(found.buffers()[2] or b"")
                whole = [bytes(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                if lists.null_count:
                    whole = [w if v else None for w, v in zip(whole, lists.is_valid().to_pylist())]
                columns = dict(zip(batch.schema.names, batch.columns))
                yield pa.RecordBatch.from_pydict(columns | {into: pa.array(whole, pa.binary())})

    schema = encoded.drop(into).schema.add(into, "binary")
    return encoded.drop(into).mapInArrow(looked_up, schema)
