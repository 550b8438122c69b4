"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tables import slices

#: Hashed n-grams, their longest length, and how sharply a mean log-odds decides a bit.
BUCKETS = 1 << 13
LONGEST = 3
SHARPNESS = 4.0
#: Below this score a prediction is flagged as ambiguous.
AMBIGUOUS = 0.5


def codewords(n: int) -> np.ndarray:
    """A codeword of -1 and 1 for each of n languages, rows far apart.

    Up to seven languages have every split into two sides as a bit. More have the
    bits that keep the closest two codewords farthest apart among seeded draws.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1)]
        return np.array([b for b in bits if -1 in b], float).T
    width, best, reach = int(np.ceil(15 * np.log2(n))), None, -1.0
    for seed in range(50):
        drawn = np.random.default_rng(seed).choice((-1.0, 1.0), size=(n, width))
        drawn[0] = np.where(np.abs(drawn.sum(0)) == n, -drawn[0], drawn[0])
        apart = ((drawn[:, None] != drawn[None]).sum(2) + width * np.eye(n)).min()
        if apart > reach:
            best, reach = drawn, apart
    return best


def ngram_counts(texts: list[str | None], buckets: int = BUCKETS) -> np.ndarray:
    """Per text, how often each hashed run of 1 to 3 characters occurs.

    Upper case counts as lower; every run of characters that aren't letters counts
    as one blank, so a word's ends are part of its n-grams.
    """
    out = np.zeros((len(texts), buckets), np.float32)
    for row, text in zip(out, texts):
        if not text:
            continue
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = codes >= 0xAA
        letter |= (codes >= 97) & (codes <= 122)
        codes = np.where(letter, codes, 32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        codes = codes[keep].astype(np.uint64)
        with np.errstate(over="ignore"):
            value = np.zeros(len(codes), np.uint64)
            for n in range(1, min(LONGEST, len(codes)) + 1):
                value = ((value[:len(codes) - n + 1] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                         + codes[n - 1:])
                mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                row += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % buckets,
                                   minlength=buckets)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            for start in range(0, len(part), 500):
                some = part.iloc[start:start + 500]
                counts, langs = ngram_counts(some["text"].tolist()), some["lang"].to_numpy()
                for lang in set(langs):
                    own = sums.setdefault(lang, np.zeros(BUCKETS))
                    own += counts[langs == lang].sum(0)
    for lang, total in sums.items():
        full = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": full, "n": total[full]})


def fit(labelled: DataFrame) -> dict:
    """Learns from ``text`` and ``lang``: codewords and one linear classifier per bit.

    A bit's classifier weighs each n-gram by the log-odds of its share among the
    languages on either side, every language counting alike. The n-grams of all
    labelled rows are counted on Spark; only sums per language and bucket (at most
    languages times buckets, both bounded) reach the driver.
    """
    counts = (labelled.where("text is not null and lang is not null").select("text", "lang")
              .mapInPandas(_counted, "lang string, bucket int, n double")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counts["lang"].unique())
    share = np.zeros((len(langs), BUCKETS))
    if langs:
        share[counts["lang"].map({v: i for i, v in enumerate(langs)}), counts["bucket"]] = counts["n"]
    share = (share + 0.1) / (share.sum(1, keepdims=True) + 0.1 * BUCKETS)
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]))
    for bit in range(code.shape[1] if len(langs) > 1 else 0):
        side = code[:, bit] > 0
        weights[:, bit] = np.log(share[side].mean(0)) - np.log(share[~side].mean(0))
    # a bit counts by how well it keeps the languages it must tell apart
    margins = (share @ weights) * code
    trust = np.maximum(margins.min(0), 1e-3) if len(langs) > 1 else np.ones(code.shape[1])
    return {"langs": langs, "code": code, "weights": weights.astype(np.float32),
            "trust": trust / trust.sum() if trust.size else trust}


def decode(margins: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Probability of each codeword: the smaller its weighted logistic loss, the likelier."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None])
    total = (loss * trust * code.shape[1]).sum(2)
    odds = np.exp(total.min(1, keepdims=True) - total)
    return odds / odds.sum(1, keepdims=True)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``lang_ambiguous`` to ``docs``.

    Only ``text`` is looked at, all of it. Null texts and texts without a letter are
    ``und`` with score 0, and so is every text if nothing was learned. Ties go to
    the first language by name. Other columns pass through; columns of these three
    names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "lang_ambiguous")
    langs, code, trust = model["langs"], model["code"], model["trust"]
    shared = docs.sparkSession.sparkContext.broadcast(model["weights"])

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for texts in batches:
            frame = pd.DataFrame({"text": texts.astype(object).where(texts.notna(), None)})
            found = [part for run in slices(frame, "text", 1 << 20)
                     for part in (run.iloc[i:i + 500] for i in range(0, len(run), 500))]
            names, scores = [], []
            for part in found:
                values = part["text"].tolist()
                counts = ngram_counts(values)
                mean = counts @ weights / np.maximum(counts.sum(1, keepdims=True), 1)
                odds = decode(SHARPNESS * mean.astype(float), code, trust) if langs else None
                for i, text in enumerate(values):
                    if odds is None or not has_letter(text):
                        names.append("und")
                        scores.append(0.0)
                    else:
                        best = int(odds[i].argmax())
                        names.append(langs[best])
                        scores.append(float(odds[i, best]))
            yield pd.DataFrame({"lang_pred": names, "score": np.array(scores, float)})

    answer = F.pandas_udf(judged, "lang_pred string, score double")(F.col("text"))
    return (docs.withColumn("_said", answer).select("*", "_said.lang_pred", "_said.score")
            .drop("_said").withColumn("lang_ambiguous", F.col("score") < AMBIGUOUS))
