"""URL rules by Bloom filter cascades: exact membership without a join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shingles import mix

#: Bits and hashes per key of a level. Filters beyond this many bytes aren't broadcast.
BITS, HASHES, LARGEST = 12, 6, 256 << 20


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    rest = F.expr(f"substring({url}, locate('://', {url}) + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.locate("://", F.col(url)) > 0, host).otherwise("")


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.expr(f"substring({url}, locate('://', {url}) + 3)")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.locate("://", F.col(url)) > 0, path).otherwise("")


def candidates(host: str, path: str, lengths: list[int]) -> Column:
    """All (host, path) a fitting rule can have: the host or a parent domain, and a path start.

    ``lengths`` are the lengths of the rules' paths; others needn't be looked at.
    """
    labels = F.split(F.col(host), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"),
                                  lambda n: n <= F.length(path)),
                         lambda n: F.substring(F.col(path), F.lit(1), n))
    return F.flatten(F.transform(parents, lambda h: F.transform(
        starts, lambda p: F.struct(h.alias("host"), p.alias("path")))))


def hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes of a (host, path) struct."""
    return [F.xxhash64(F.lit(seed), key["host"], key["path"]) for seed in (1, 2)]


class Bloom:
    """A bit set with the keys given as two 64-bit hashes; its bits come from Spark."""

    def __init__(self, keys: DataFrame, count: int, level: int):
        self.level, self.size = level, max(64, BITS * count)
        if self.size // 8 > LARGEST:
            raise ValueError(f"a filter of {count} keys is beyond {LARGEST} bytes: "
                             "split the rules and apply each part on its own")

        def bits(batches):
            for batch in batches:
                at = self.places(batch["h1"].to_numpy(np.int64), batch["h2"].to_numpy(np.int64))
                yield pd.DataFrame({"word": at.ravel() >> 6,
                                    "bits": np.int64(1) << (at.ravel() & 63)})

        self.words = np.zeros(0, np.uint64)
        words = (keys.mapInPandas(bits, "word long, bits long").groupBy("word")
                 .agg(F.bit_or("bits").alias("bits")).toPandas())
        filled = np.zeros((self.size + 63) // 64, np.int64)
        filled[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
        self.words = filled.view(np.uint64)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The bits of each key, a row per hash; each level hashes in its own way."""
        with np.errstate(over="ignore"):
            a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
            return np.stack([mix(a + np.uint64(self.level * HASHES + i) * b) % np.uint64(self.size)
                             for i in range(HASHES)]).astype(np.int64)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(h1, h2)
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(0)


class Cascade:
    """Exact membership of a key universe in a list.

    Level 0 holds the listed keys, level 1 those of the universe that level 0 takes
    for listed, level 2 the listed keys that level 1 takes for such errors, and so
    on until a level makes no error. A key is listed if the first level that doesn't
    have it is an odd one, or if none lacks it and the last level is an even one.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        """``listed`` and ``universe`` have the hashes h1, h2 of keys."""
        self.levels: list[Bloom] = []
        listed = listed.distinct()
        # of the universe only its errors at level 0 are kept and made distinct
        inside, outside = listed, None
        while True:
            count = inside.count()
            if not count:
                break
            bloom = Bloom(inside, count, len(self.levels))
            self.levels.append(bloom)
            if outside is None:
                outside = self._passing(universe, bloom).distinct().join(listed, ["h1", "h2"], "left_anti")
            else:
                outside = self._passing(outside, bloom)
            inside, outside = outside, inside

    @staticmethod
    def _passing(keys: DataFrame, bloom: Bloom) -> DataFrame:
        shared = keys.sparkSession.sparkContext.broadcast(bloom)

        def passing(h1: pd.Series, h2: pd.Series) -> pd.Series:
            return pd.Series(shared.value.has(h1.to_numpy(np.int64), h2.to_numpy(np.int64)))

        return keys.where(F.pandas_udf(passing, "boolean")("h1", "h2"))

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        answer = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for number, bloom in enumerate(self.levels):
            has = bloom.has(h1[open_], h2[open_])
            answer[open_[~has]] = number % 2 == 1
            open_ = open_[has]
        answer[open_] = len(self.levels) % 2 == 1
        return answer


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all its
    subdomains if the url's path starts with the rule's; of the fitting rules the one
    whose host and path are longest together decides (then the longer host). A url
    that no rule fits is in none of the lists and gets ``default``. A null url or one
    without ``://`` has an empty host and path. Of rules that repeat a host and path with
    different verdicts the greater verdict counts. Columns of the four names are replaced.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").groupBy(
        "host", "path").agg(F.max("verdict").alias("verdict"))
    verdicts = [r[0] for r in rules.select("verdict").distinct().orderBy("verdict").collect()]
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    pages = pages.drop("host", "path", "rule", "verdict")
    pages = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    if not lengths:
        return pages.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    keys = candidates("host", "path", lengths)
    universe = pages.select(F.explode(keys).alias("key")).select(
        *(h.alias(f"h{i}") for i, h in enumerate(hashes(F.col("key")), 1)))
    cascades = []
    for verdict in verdicts:
        own = rules.where(F.col("verdict") == verdict).select(F.struct("host", "path").alias("key"))
        cascades.append(Cascade(own.select(*(h.alias(f"h{i}") for i, h in enumerate(
            hashes(F.col("key")), 1))), universe))
    shared = pages.sparkSession.sparkContext.broadcast(cascades)

    def first_fit(h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        """Per row, of its candidates (longest first) the first listed one and its list."""
        sizes = h1.map(len).to_numpy()
        a = np.concatenate([np.zeros(0, np.int64), *h1]).astype(np.int64)
        b = np.concatenate([np.zeros(0, np.int64), *h2]).astype(np.int64)
        kind = np.full(len(a), -1)
        for number, cascade in enumerate(shared.value):
            kind[cascade.listed(a, b)] = number
        row = np.repeat(np.arange(len(sizes)), sizes)
        hit = np.flatnonzero(kind >= 0)[::-1]
        place, which = np.zeros(len(sizes), int), np.zeros(len(sizes), int)
        place[row[hit]] = (hit - (np.cumsum(sizes) - sizes)[row[hit]]) + 1
        which[row[hit]] = kind[hit] + 1
        return pd.DataFrame({"place": place, "which": which})

    size = lambda k: F.length(k["host"]) + F.length(k["path"])
    longest = F.array_sort(keys, lambda x, y: F.when(size(x) != size(y), size(y) - size(x)).otherwise(
        F.length(y["host"]) - F.length(x["host"])).cast("int"))
    asked = pages.withColumn("_keys", longest).withColumn("_fit", F.pandas_udf(
        first_fit, "place int, which int")(F.transform("_keys", lambda k: hashes(k)[0]),
                                           F.transform("_keys", lambda k: hashes(k)[1])))
    fitting = F.get("_keys", F.col("_fit.place") - 1)
    return (asked.withColumn("rule", F.when(F.col("_fit.place") > 0, F.concat(
                fitting["host"], fitting["path"])))
            .withColumn("verdict", F.when(F.col("_fit.place") > 0, F.get(
                F.array(*map(F.lit, verdicts)), F.col("_fit.which") - 1)).otherwise(default))
            .drop("_keys", "_fit"))
