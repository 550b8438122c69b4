"""What the operators share: tables, staged frames, ordered parts, connected components."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.sinks import work_dir


#: A key is hot if it has more than CROWD rows and more than one HOT-th of all.
CROWD, HOT = 1000, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the cluster's shared folder and reads it back.

    What follows starts from files that outlive any executor.
    """
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matched(rows: DataFrame, side: DataFrame, on: list[str], often: str, total: int) -> DataFrame:
    """``rows`` joined with ``side``, which has one row per ``on``, also if many rows share one.

    ``often`` says how many rows a row of ``side`` meets, of ``total`` in all. Those that meet
    more than a HOT-th of all rows are broadcast, at most HOT of them, and their rows aren't
    dealt out by key; so no task gets more rows of one key than that, however common it is.
    """
    crowd = max(CROWD, total // HOT)
    many = F.broadcast(side.where(F.col(often) > crowd))
    few = side.where(F.col(often) <= crowd)
    rest = rows.join(many.select(*on), on, "left_anti")
    return rows.join(many, on).unionByName(rest.join(few, on))


def held_back(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the column as text leaves this remainder; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder,
                      F.lit(False))


def slices(frame: pd.DataFrame, text: str, limit: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """Runs of rows of about ``limit`` characters of text, one long text being a run of its own."""
    size, start = 0, 0
    for i, value in enumerate(frame[text]):
        length = len(value) if value is not None else 0
        if size and size + length > limit:
            yield frame.iloc[start:i]
            size, start = 0, i
        size += length
    if start < len(frame):
        yield frame.iloc[start:]


def _ordered(values) -> tuple:
    return tuple((v is not None, v) for v in values)


class Parts:
    """Runs of rows along an order, about even in rows, found from the keys alone.

    ``keys`` are ordered as Spark orders them, nulls first. The keys are dealt out by
    range once; per part only its lowest and highest key reach the driver. Equal keys
    share a part, so keys should end in one that tells rows apart.
    """

    def __init__(self, df: DataFrame, keys: list[str], parts: int | None = None):
        self.keys, self.n = keys, parts or 4 * shuffle_parts(df)
        ends = (df.select(*keys).repartitionByRange(self.n, *keys)
                .groupBy(F.spark_partition_id().alias("p"))
                .agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"))
                .collect())
        self.low = sorted(_ordered(r["low"]) for r in ends)
        self.high = sorted(_ordered(r["high"]) for r in ends)

    def place(self, guests: tuple[int, ...] = (), wrap: bool = False,
              more: dict[tuple, list[int]] | None = None) -> Column:
        """The part of a row, as 3 * part + 1, in an array.

        With -1 in ``guests`` the highest row of a part is also a guest of the part that
        follows (3 * part), with ``wrap`` of the first part after the last; with 1 the
        lowest row is also one of the part before (3 * part + 2). ``more`` holds further
        such places of rows by their keys.
        """
        low, high, last = self.low, self.high, len(self.low) - 1
        further = {_ordered(key): to for key, to in (more or {}).items()}

        def places(*columns: pd.Series) -> pd.Series:
            out = []
            for key in zip(*(c.astype(object).where(c.notna(), None) for c in columns)):
                key = _ordered(key)
                own = max(bisect.bisect_right(low, key) - 1, 0)
                to = [3 * own + 1]
                if -1 in guests and key == high[own] and (wrap or own < last):
                    to.append(3 * ((own + 1) % (last + 1)))
                if 1 in guests and key == low[own] and own > 0:
                    to.append(3 * (own - 1) + 2)
                out.append(to + further.get(key, []))
            return pd.Series(out)

        return F.pandas_udf(places, "array<int>")(*self.keys)

    def deal(self, df: DataFrame, guests: tuple[int, ...] = (), wrap: bool = False,
             more: dict[tuple, list[int]] | None = None) -> DataFrame:
        """``df`` shuffled by part, with ``part`` and ``guest`` (0 for a row in its own part).

        Rows come sorted by part, guest and keys; a task can hold several parts.
        """
        return (df.withColumn("_to", F.explode(self.place(guests, wrap, more)))
                .withColumn("part", F.expr("_to div 3").cast("int"))
                .withColumn("guest", (F.col("_to") % 3 - 1).cast("int")).drop("_to")
                .repartition(self.n, "part")
                .sortWithinPartitions("part", "guest", *self.keys))


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a partition as stars around the smallest node of each group."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        some = nodes[i:i + 100_000]
        yield pd.DataFrame({"a": some, "b": [root(x) for x in some]})


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it reaches, for links ``a``, ``b``.

    Nodes are integers. First every partition turns its links into stars; then
    each round points larger neighbours, and after that smaller ones, to the
    smallest neighbour of a node, until nothing changes. Rounds are staged in the
    shared folder, so a lost executor costs no earlier round. Nothing but counts
    reaches the driver. Nodes without links don't appear.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links = staged(links.distinct().mapInPandas(_forest, "a long, b long"), "links")
    seen = None
    while True:
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"),
                                      F.count("*").alias("often"))
        large = (matched(both.where("b > a"), least, ["a"], "often", 2 * links.count())
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = staged(large, "large")
        # every row of ``large`` points from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("often"))
        small = (matched(large, least, ["a"], "often", large.count())
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct())
        links = staged(small, "links")
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
    stars = links.groupBy("a").agg(F.min("b").alias("component"))
    return (stars.withColumnRenamed("a", "node")
            .union(stars.select("component", "component").distinct()))
