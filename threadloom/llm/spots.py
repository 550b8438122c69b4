"""SpotSigs: fingerprints from chains of content words that follow common words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tables import Parts, slices

#: Common words of English, German, French and Spanish.
COMMON = frozenset("""
a an and are as at be but by for from had has have he her his i in is it its not of on or she
that the their they this to was we were which who will with you
als am auch auf aus bei das dem den der des die ein eine einem einen einer es für hat ich im ist
mit nach nicht oder sich sie sind so und von war wie wird zu zum zur
au aux avec ce ces dans de du elle en est et il ils je la le les leur mais ne nous ou par pas pour
que qui sa se ses son sont sur un une vous
al como con del el ella ellos eran esta este fue ha hay las lo los más no para pero por se sin
sobre son su sus y ya
""".split())
#: Content words in a chain, and how many content words on the next one is.
CHAIN, DISTANCE = 2, 1
WORD = re.compile(r"\w+")


def signatures(text: str | None, common: frozenset = COMMON, chain: int = CHAIN,
               distance: int = DISTANCE) -> np.ndarray:
    """The sorted set of a text's spot signatures, as 64-bit hashes.

    A spot is a common word and the ``chain`` content words after it, every
    ``distance``-th one. A text with words but no spot has one signature, its whole
    word sequence; a text without words has none, or if it isn't empty, itself.
    """
    if not text:
        return np.zeros(0, np.uint64)
    words = WORD.findall(text.lower())
    content = [w for w in words if w not in common]
    # for each common word, how many content words precede it
    before, found = 0, set()
    reach, last = chain * distance, len(content)
    for word in words:
        if word in common:
            if before + reach - distance < last:
                found.add(" ".join((word, *content[before:before + reach:distance])))
        else:
            before += 1
    if not found:
        found = {"\n".join(words) if words else text}
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
                                for s in found), np.uint64, len(found)))


def fingerprint(spots: np.ndarray) -> str:
    """One name for a set of signatures: equal sets, equal names."""
    return xxhash.xxh3_128_hexdigest(spots.tobytes())


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets, 1 for two empty ones.

    Sets whose sizes alone rule out ``least`` are not compared; the answer then is 0.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    value = both / (len(a) + len(b) - both)
    return value if value >= least else 0.0


def near_pairs(docs: DataFrame, least: float = 0.75, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Pairs ``a`` < ``b`` of keys whose fingerprints differ but are at least ``least`` alike.

    Every distinct fingerprint takes part once, under its smallest key. It is placed in
    the partition of its set's size and the one above: alike sets are in one or in
    neighbouring partitions, since their sizes differ by at most the factor ``least``.
    In a partition, sets meet under one of the signatures that a set can't lack of every
    partner. How alike two sets are is then found from whole sets. Texts without
    signatures and null keys have no pairs; equal rows, rows of equal texts and an empty table
    add none. Further columns are ignored, whatever their names.
    """
    step = -np.log(max(least, 1e-3))

    def spotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pd.DataFrame({"key": batch.column(0).to_pylist(),
                                  "text": batch.column(1).to_pylist()}, dtype=object)
            for part in slices(frame, "text"):
                sets = [signatures(t) for t in part["text"]]
                yield pa.RecordBatch.from_pydict(
                    {"key": part["key"].tolist(), "name": [fingerprint(s) for s in sets],
                     "spots": [s.view(np.int64).tolist() for s in sets]},
                    schema=pa.schema([("key", pa.int64()), ("name", pa.string()),
                                      ("spots", pa.list_(pa.int64()))]))

    sets = (docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text))
            .mapInArrow(spotted, "key long, name string, spots array<long>")
            .groupBy("name").agg(F.min("key").alias("key"), F.first("spots").alias("spots"))
            .where(F.size("spots") > 0).select("key", "spots", F.size("spots").alias("n")))
    level = F.floor(F.log("n") / step)
    keys = F.slice("spots", 1, F.col("n") - F.ceil(F.col("n") * least) + 1)
    placed = sets.select("key", "n", F.explode(keys).alias("spot"),
                         F.floor(level).alias("level"))
    above = placed.withColumn("level", F.col("level") + 1)
    left, right = placed.alias("l"), placed.union(above).alias("r")
    pairs = (left.join(right, ["spot", "level"])
             .where((F.col("l.key") != F.col("r.key"))
                    & (F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * least))
             .select(F.least("l.key", "r.key").alias("a"), F.greatest("l.key", "r.key").alias("b"))
             .distinct())
    one = sets.select(F.col("key").alias("a"), F.col("spots").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("spots").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = both / (F.size("x") + F.size("y") - both)
    return (pairs.join(one, "a").join(two, "b").select("a", "b", alike.alias("likeness"))
            .where(F.col("likeness") >= least))


def edited(text: str, following: str) -> str:
    """A text whose last third of code points is replaced by the start of the next text."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third] if third else text


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited form, and how alike they and the next one are.

    The next document is the one with the next smaller key, after the smallest the one
    with the largest (ties by the texts' hashes; null keys are smallest). A null text counts as
    empty; a lone row is its own next one, an empty table gives no row, a very long text is held
    as a whole. Further columns are ignored, whatever their names. Texts are shuffled
    once; a part's neighbour comes along as a guest. Columns: key, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    source = docs.select(F.col(key).cast("long").alias("key"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumn("tie", F.xxhash64("text"))
    parts = Parts(source, ["key", "tie"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        part = before = spots_before = None
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            for own_part, guest, one, value in zip(*columns):
                spots = signatures(value)
                if own_part != part:
                    part, before, spots_before = own_part, None, None
                if guest == 0:
                    # a lone document is its own next one
                    following = before if before is not None else value
                    next_spots = spots_before if before is not None else spots
                    changed = edited(value, following)
                    changed_spots = spots if changed == value else signatures(changed)
                    out.append((one, len(value),
                                hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                                fingerprint(spots), fingerprint(changed_spots),
                                likeness(spots, changed_spots), likeness(spots, next_spots)))
                before, spots_before = value, spots
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    fields = pa.schema([("key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return (parts.deal(source, guests=(-1,), wrap=True).select("part", "guest", "key", "text")
            .mapInArrow(compared, "key long, n_chars long, edited_sha256 string, fingerprint string, "
                                  "edited_fingerprint string, near_edited double, near_next double")
            .withColumnRenamed("key", key))
