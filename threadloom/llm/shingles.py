"""Word shingles of whole texts as sets of 64-bit hashes, a batch of documents at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coded_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the batch's distinct words, the place of each word in them, words per text.

    Words are runs of anything but blank, tab, newline, vertical tab, form feed
    and carriage return; A-Z count as a-z. Each distinct word is hashed once.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = LOWER[np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)]
    ends_of_text = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, int)
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(parts), np.int64)
    # words without the gaps between them, end to end
    kept = data[~gap]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()),
                         np.uint64, len(coded.dictionary))
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends_of_text))))
    return hashed, coded.indices.to_numpy(), counts


def sorted_within(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The order that sorts the values of each text, which lie end to end; equal ones stay."""
    order, start = np.empty(len(values), np.int64), 0
    for count in counts.tolist():
        order[start:start + count] = np.argsort(values[start:start + count], kind="stable") + start
        start += count
    return order


def shingle_sets(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets of shingle hashes end to end, each sorted, and the sets' sizes.

    A text of fewer words than ``size`` has its whole word sequence as its one
    shingle; a null text or one without words has the empty set.
    """
    distinct, place, counts = coded_words(texts)
    return weighed_sets(distinct, place, counts, np.zeros(len(distinct), np.int64), size)[:2]


def weighed_sets(distinct: np.ndarray, place: np.ndarray, counts: np.ndarray, weights: np.ndarray,
                 size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingle_sets`` of coded words, and per member the sum of its words' ``weights``.

    ``weights`` has one number for each of the distinct words.
    """
    with np.errstate(over="ignore"):
        words, weights = distinct[place], weights[place]
        starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
        per_text = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
        owner = np.repeat(np.arange(len(counts)), per_text)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        first = starts[owner] + within
        width = np.minimum(counts, size)[owner]
        value = mix(width.astype(np.uint64))
        padded = np.concatenate((words, np.zeros(size, np.uint64)))
        sums = np.concatenate(([0], np.cumsum(weights)))
        weight = sums[first + width] - sums[first]
        for i in range(size):
            step = mix(value * np.uint64(0x9E3779B97F4A7C15) + padded[first + i])
            value = np.where(i < width, step, value)
    order = sorted_within(value, per_text)
    value, owner, weight = value[order], owner[order], weight[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(counts)), weight[new]
