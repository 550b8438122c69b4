"""Repetition inside a text: maximal repeated word sequences by suffix array, and rules on them.

All texts of a slice are sorted in one suffix array over their words, by prefix doubling:
suffixes start out grouped by text and first word, and every turn orders each group by the
groups that stand as many words further on as the groups agree. Groups of one are done, so
ordinary prose leaves after a few turns. Longest common prefixes of neighbours are read off
the groups of all turns; their intervals are the maximal repeated sequences, and a word is
covered if one of at least ``LEAST`` words lies over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shingles import SPACE
from threadloom.llm.tables import slices

#: Words of the windows of the base rule, and of the shortest repeat that counts.
WINDOW, LEAST = 8, 8
#: A text goes if repeats lie over more than this share (percent) of the characters of its
#: words, or if one of more words than ``LONGEST`` lies over ``LONG_SHARE`` percent or more.
COVERED, LONGEST, LONG_SHARE = 30, 50, 10
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
BLANKS = " \t\n\x0b\x0c\r"
SPAN = "array<struct<start:bigint,length:bigint>>"
MEASURES = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
            "n_repeat_words:bigint,covered_words:bigint,covered_chars:bigint,"
            f"longest_repeat:bigint,longest_chars:bigint,repeats:{SPAN}>")


def words_of(texts: list[str | None]):
    """Numbered words of all texts in order, their lengths in code points, words per text,
    and symbols per text. Equal words have equal numbers."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    ends = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64))
    symbols = np.diff(np.concatenate(([0], np.cumsum(SYMBOL[data])))[np.concatenate(([0], ends))])
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts, symbols
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])])
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    return code, points[stops] - points[starts], counts, symbols


def _starts(key: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """For sorted keys: the place where the run of each one begins."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    for k in more:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def suffix_groups(code: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Groups of suffixes that agree in 1, 2, 4... words within one text, until all differ.

    A group is named by the place of its first suffix in the suffix array; so the names of
    the last turn are the places of the suffixes.
    """
    n = len(code)
    end = np.repeat(np.cumsum(counts), counts)
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((code, text))
    first = _starts(text[order], code[order])
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, width = [rank], 1
    size = np.bincount(first, minlength=n)
    active = order[size[first] > 1]
    while len(active):
        ahead = active + width
        # a suffix that ends here comes before those that go on
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)], -1)
        head = rank[active]
        order = np.lexsort((second, head))
        active, head, second = active[order], head[order], second[order]
        run, group = _starts(head, second), _starts(head)
        fresh = head + run - group
        rank = rank.copy()
        rank[active] = fresh
        levels.append(rank)
        size = np.bincount(run, minlength=len(run))
        active, width = active[size[run] > 1], 2 * width
    return levels


def repeat_lengths(code: np.ndarray, counts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Per word the length of the longest sequence from it on that the text has elsewhere,
    too; 0 where that is shorter than ``least``."""
    n = len(code)
    longest = np.zeros(n, np.int64)
    if not n:
        return longest
    levels = suffix_groups(code, counts)
    end = np.repeat(np.cumsum(counts), counts)
    array = np.empty(n, np.int64)
    array[levels[-1]] = np.arange(n)
    # neighbours that don't agree in the largest power of two up to ``least`` needn't be measured
    at = min(int(least).bit_length() - 1, len(levels) - 1)
    near = np.flatnonzero(levels[at][array[1:]] == levels[at][array[:-1]])
    a, b = array[near], array[near + 1]
    common = np.zeros(len(near), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        open_ = (x < end[a]) & (y < end[b])
        same = open_ & (levels[j][np.minimum(x, n - 1)] == levels[j][np.minimum(y, n - 1)])
        common += np.where(same, 1 << j, 0)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    longest[longest < least] = 0
    return longest


def _covered(length: np.ndarray) -> np.ndarray:
    """Which words lie under a span that starts at a word and has its length."""
    at = np.arange(len(length))
    reach = np.maximum.accumulate(np.where(length > 0, at + length, 0)) if len(length) else at
    return reach > at


def dup_lines(text: str | None) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in (text or "").split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def measures(texts: list[str | None]) -> pd.DataFrame:
    """The measures of ``MEASURES`` for each text."""
    code, chars, counts, symbols = words_of(texts)
    least = min(WINDOW, LEAST)
    length = repeat_lengths(code, counts, least)
    window = _covered(np.where(length >= WINDOW, length, 0))
    length = np.where(length >= LEAST, length, 0)
    covered = _covered(length)
    ends = np.cumsum(counts)
    starts = ends - counts

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return total[ends] - total[starts]

    weight = np.concatenate(([0], np.cumsum(chars)))
    longest, long_chars, spans = [], [], []
    for s, e in zip(starts.tolist(), ends.tolist()):
        own = length[s:e]
        top = int(own.max()) if e > s else 0
        at = s + int(own.argmax()) if top else s
        longest.append(top)
        long_chars.append(int(weight[at + top] - weight[at]))
        if not top:
            spans.append([])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(
            ([False], covered[s:e], [False])).view(np.int8)))
        spans.append([{"start": a, "length": b - a}
                      for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())])
    return pd.DataFrame({
        "n_words": counts, "word_chars": per_text(chars), "n_symbols": symbols,
        "n_dup_lines": [dup_lines(t) for t in texts], "n_repeat_words": per_text(window),
        "covered_words": per_text(covered), "covered_chars": per_text(chars * covered),
        "longest_repeat": longest, "longest_chars": long_chars, "repeats": spans})


def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        frame = pd.DataFrame({"text": texts.astype(object).where(texts.notna(), None)})
        out = [measures(part["text"].tolist()) for part in slices(frame, "text", 4 << 20)]
        yield pd.concat(out, ignore_index=True) if out else measures([])


def base_failed(m: Column) -> Column:
    """Fewer than 20 words, or over 30 percent of them in repeated windows of eight words."""
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def repetitive(m: Column) -> Column:
    """The verdict of the repeats: too much covered, or one long repeat that weighs."""
    return ((100 * m["covered_chars"] > COVERED * m["word_chars"])
            | ((m["longest_repeat"] > LONGEST)
               & (100 * m["longest_chars"] >= LONG_SHARE * m["word_chars"])))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``repetition`` (the measures), ``base_failed`` and ``kept`` to every row.

    Words are runs of anything but blank, tab, newline, vertical tab, form feed and carriage
    return, as they are written. ``repetition.repeats`` are the covered stretches, as first
    word and number of words. A null or empty text and one without words has no words, so it
    fails the base rule. Each row is judged by itself: repeated rows and ids, null ids and an
    empty table are no special cases; further columns pass through, and columns of the three
    names are replaced. A text is measured as a whole, a very long one in a slice of its own.
    """
    found = F.pandas_udf(_measured, MEASURES)(F.col(text))
    rows = docs.withColumn("repetition", found)
    m = F.col("repetition")
    failed = base_failed(m)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repetitive(m))

