"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tables import slices

#: Training reads at most this many labelled documents, those of the smallest hash.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 80, 4, 64, 0.15, 10, 1.0

LETTERS = re.compile(r"[^\W\d_]")
FEATURES = ("log_chars", "log_words", "word_length", "letters", "upper", "digits", "blanks",
            "newlines", "commas", "full_stops", "exclamations", "bars", "symbols", "other_signs",
            "all_upper_words", "title_words", "signed_words", "distinct_words", "top_word",
            "distinct_pairs", "line_length", "distinct_lines", "copied_line_chars",
            "ended_lines", "bullets", "squeezed", "long_words", "short_words")
#: A window over which a long text's own repetition is squeezed; all windows are read.
WINDOW = 1 << 16


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES; zeros for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    words = text.split()
    m = max(len(words), 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.bincount(np.minimum(codes, 128), minlength=129)
    ascii_upper = int(low[65:91].sum())
    upper = ascii_upper + (sum(map(str.isupper, text)) - ascii_upper if low[128] else 0)
    signs = int(low[33:48].sum() + low[58:65].sum() + low[91:97].sum() + low[123:127].sum())
    symbols = int(low[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 126]].sum())
    letters = int(low[65:91].sum() + low[97:123].sum() + low[128])
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    by_line = Counter(lines)
    raw = text.encode("utf-8", "surrogatepass")
    squeezed = sum(len(zlib.compress(raw[i:i + WINDOW], 1)) for i in range(0, len(raw), WINDOW))
    bare = [w.strip(".,;:!?") for w in counts]
    weight = list(counts.values())

    def share(test) -> float:
        return sum(c for w, c in zip(bare, weight) if test(w)) / m

    return [np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / m, letters / n, upper / n,
            low[48:58].sum() / n, (low[32] + low[9]) / n, low[10] / n, low[44] / m, low[46] / m,
            low[33] / m, low[124] / m, symbols / m, (signs - symbols - low[33] - low[44]
                                                     - low[46] - low[124]) / m,
            share(lambda w: len(w) > 1 and w.isupper()), share(str.istitle),
            share(lambda w: bool(w) and not w[-1].isalnum()),
            len(counts) / m, max(weight, default=0) / m, pairs / m, n / k / 100,
            len(by_line) / k, sum((c - 1) * len(x) for x, c in by_line.items()) / n,
            sum(x.rstrip()[-1:] in ".!?:\"'" for x in lines) / k,
            sum(x.lstrip()[:1] in "-*|#>" for x in lines) / k, squeezed / max(len(raw), 1),
            share(lambda w: len(w) > 12), share(lambda w: len(w) <= 2)]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pd.DataFrame({"x": list(matrix(part["text"].tolist())),
                                "y": part["quality"].to_numpy()})


def grow(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosts trees of fixed depth on binned columns; returns them as flat arrays.

    A tree of depth d is two arrays of 2**d - 1 inner nodes (feature, threshold) and
    one of 2**d leaf values; the children of node i are 2i + 1 and 2i + 2. Rows whose
    value is above the threshold go right. A node not worth splitting sends all left.
    """
    inner = 2 ** DEPTH - 1
    feature = np.zeros((TREES, inner), np.int64)
    limit = np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, inner + 1))
    positive = y.mean() if len(y) else 0.5
    start = float(np.log((positive + 1e-3) / (1 - positive + 1e-3)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
             for j in range(x.shape[1])] if len(y) else []
    binned = np.array([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).T
    margin = np.full(len(y), start)
    width, columns = BINS, x.shape[1]
    for t in range(TREES if len(y) else 0):
        chance = 1 / (1 + np.exp(-margin))
        slope, bend = chance - y, np.maximum(chance * (1 - chance), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first = 2 ** level - 1
            cell = ((node - first)[:, None] * columns + np.arange(columns)) * width + binned
            size = 2 ** level * columns * width
            shape = (2 ** level, columns, width)
            g = np.bincount(cell.ravel(), np.repeat(slope, columns), size).reshape(shape)
            h = np.bincount(cell.ravel(), np.repeat(bend, columns), size).reshape(shape)
            n = np.bincount(cell.ravel(), minlength=size).reshape(shape)
            gl, hl, nl = g.cumsum(2), h.cumsum(2), n.cumsum(2)
            gt, ht, nt = gl[:, :1, -1:], hl[:, :1, -1:], nl[:, :1, -1:]
            gain = (gl ** 2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE)
                    - gt ** 2 / (ht + RIDGE))
            gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
            flat = gain.reshape(2 ** level, -1)
            best = flat.argmax(1)
            for i, b in enumerate(best):
                j, cut = divmod(int(b), width)
                if flat[i, b] > 1e-6 and cut < len(edges[j]):
                    feature[t, first + i], limit[t, first + i] = j, edges[j][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > limit[t, node])
        place = node - inner
        g = np.bincount(place, slope, inner + 1)
        h = np.bincount(place, bend, inner + 1)
        leaf[t] = -RATE * g / (h + RIDGE)
        margin += leaf[t, place]
    return {"start": start, "feature": feature, "limit": limit, "leaf": leaf}


def walk(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row, all rows stepping down each tree together."""
    total, rows = np.full(len(x), model["start"]), np.arange(len(x))
    for feature, limit, leaf in zip(model["feature"], model["limit"], model["leaf"]):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
        total += leaf[node - len(limit)]
    return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Trains on the labelled documents of the ``sample`` smallest hashes of doc_id.

    ``labels`` has doc_id and quality (0, 1; null and other values are left out; a
    document labelled twice counts with its larger label). Of rows that share a doc_id the
    text of the smallest hash counts, so the bound holds for texts as for ids: for the list
    that is broadcast and the statistics that reach the driver. Every label is as likely to
    be drawn. Without any label all scores are 0.5.
    """
    drawn = (labels.where("quality in (0, 1) and doc_id is not null")
             .groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    found = (docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
             .groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min_by(
                 F.struct("text"), F.struct(F.xxhash64("text"), "text"))["text"].alias("text")))
    rows = (found.select("text", "quality").repartition(max(2 * found.sparkSession.sparkContext
                                                            .defaultParallelism, 2))
            .mapInPandas(_measured, "x array<double>, y double").toPandas())
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = rows["y"].to_numpy(float)
    order = np.lexsort((*x.T, y)) if len(y) else []
    return grow(x[order], y[order])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (0 or 1).

    Only ``text`` is looked at, all of it; null counts as empty. Other columns pass
    through; columns of these two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = matrix([t if isinstance(t, str) else None for t in texts])
            yield pd.Series(walk(shared.value, x))

    return (docs.drop("score", "predicted")
            .withColumn("score", F.pandas_udf(scored, "double")(F.col("text")))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
