"""Running values per key, also when one key holds a large share of all rows.

A plain window puts every row of a key into one task. That is the right plan
while keys are small, and it is what runs when no key is large. A key above
``rows_per_task`` rows is cut along its order into segments:

1. rows are shuffled and sorted by (key, segment) and scanned there, so the work
   of one key spreads over many tasks; the result is written once;
2. the last row of a segment has the value of all of it, and a scan over those
   rows gives what each segment carries in from the ones before it;
3. the carried value is joined on (key, segment), by size, and combined with the
   value from step 1.

Keys are cut at quantiles into segments that a task can sort, which are few. Where
smaller ones are asked for, the task that has such a segment sorted cuts it by rank:
no table of places, and no turn of cutting, grows with their number.

The cut depends on the order alone and never reverses it, so results are the same
for any cut. The statistics only decide speed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.sources.sinks import staged

ROWS_PER_TASK = 1_000_000
# Up to so many rows a segment is sorted by one task, and cut there if it is to be smaller.
SORTED_ROWS = 100_000
# Into so many parts a large segment is cut in one turn, and the rank error of the cuts.
FANOUT, ACCURACY = 64, 2_000
# Of the cuts of a segment every so many-th is looked at first.
STEP = 8
SEGMENT, PART = "_segment", "_part"
UNBOUNDED, HERE = Window.unboundedPreceding, Window.currentRow


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, independent of the session zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        since = f"cast({name} - timestamp_ntz'1970-01-01 00:00:00' as interval second)"
        return F.expr(f"cast(cast({since} as decimal(20,6)) * 1000000 as bigint)")
    return F.unix_micros(F.col(name))


# -- scans ---------------------------------------------------------------------

@dataclass(frozen=True)
class Scan:
    """A running value that can be computed per segment and then combined.

    ``local``   value inside a segment, over a frame that ends at the current row;
                that of the last row stands for the whole segment
    ``carry``   value from all earlier segments, over the segment rows
    ``merge``   carried and local value together
    """

    local: Callable[[WindowSpec, Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


def count(when: Column | None = None) -> Scan:
    """Rows so far (of those where ``when`` holds)."""
    one = F.lit(1) if when is None else F.when(when, 1)
    return Scan(local=lambda w, _: F.count(one).over(w),
                carry=lambda c, w: F.sum(c).over(w),
                merge=lambda before, here: F.coalesce(before, F.lit(0)) + here)


def total(value: Column) -> Scan:
    """Sum so far."""
    return Scan(local=lambda w, _: F.sum(value).over(w),
                carry=lambda c, w: F.sum(c).over(w),
                merge=lambda before, here: F.coalesce(before, F.lit(0)) + here)


def last(value: Column) -> Scan:
    """Newest non-null value."""
    return Scan(local=lambda w, _: F.last(value, ignorenulls=True).over(w),
                carry=lambda c, w: F.last(c, ignorenulls=True).over(w),
                merge=lambda before, here: F.coalesce(here, before))


def first(value: Column) -> Scan:
    """Oldest non-null value."""
    return Scan(local=lambda w, _: F.first(value, ignorenulls=True).over(w),
                carry=lambda c, w: F.first(c, ignorenulls=True).over(w),
                merge=lambda before, here: F.coalesce(before, here))


def first_position(when: Column) -> Scan:
    """Position (time, sequence) of the first row where ``when`` holds."""
    return Scan(local=lambda w, order: F.min(F.when(when, order)).over(w),
                carry=lambda c, w: F.min(c).over(w),
                merge=lambda before, here: F.coalesce(before, here))


def any_so_far(condition: Column) -> Scan:
    """Whether ``condition`` held on any row so far; null before the first non-null."""
    return Scan(local=lambda w, _: F.max(condition).over(w),
                carry=lambda c, w: F.max(c).over(w),
                merge=lambda before, here: F.greatest(before, here))


@dataclass(frozen=True)
class LastN:
    """The last ``n`` values, oldest first, the current one included."""

    value: Column
    n: int


# -- timeline ------------------------------------------------------------------

@dataclass(frozen=True)
class Timeline:
    """Keys, event order within a key, and the cuts of the large keys."""

    keys: tuple[str, ...] = ("tenant_id", "conversation_id")
    ts: str = "ts"
    seq: tuple[str, ...] = ("seq",)
    # one frame per turn: which segments are cut by what, and where; empty: nothing is cut
    cuts: tuple[DataFrame, ...] = field(default=(), compare=False)
    # rows of a part into which a segment is cut where it is sorted; none: it stays whole
    part_rows: int | None = field(default=None, compare=False)

    @property
    def order_by(self) -> list[str]:
        return [self.ts, *self.seq]

    @property
    def order(self) -> Column:
        return F.struct(*self.order_by)

    @property
    def whole(self) -> bool:
        return not self.cuts and not self.part_rows

    def _positions(self, df: DataFrame) -> list[Column]:
        """The order as whole numbers: time, then the sequence columns that are integers."""
        whole = [micros(df, self.ts)]
        for name in self.seq:
            if not isinstance(df.schema[name].dataType, T.IntegralType):
                break
            whole.append(F.col(name).cast("bigint"))
        return whole

    def measured(self, df: DataFrame, rows_per_task: int = ROWS_PER_TASK,
                 sorted_rows: int = SORTED_ROWS) -> "Timeline":
        """Find the keys above ``rows_per_task`` rows and where to cut them.

        One narrow counting job over the key columns; each further turn only if a
        segment is still too large, over the positions of its rows, which are written
        for that. It is cut at quantiles of the time, or of the sequence once all its
        rows have one time, so a burst refines only itself. Segments of at most
        ``sorted_rows`` rows are no further measured: smaller ones are parts by rank.
        Rows without a time or sequence come first, as in the order. Rows equal in
        all of these can't be told apart and stay together. The cuts are tables; the
        driver only learns whether there are any. If ``df`` is costly to compute,
        measure the table it comes from instead and pass the result on.
        """
        places = self._positions(df)
        names = [f"_at{i}" for i in range(len(places))]
        rows = df.select(*self.keys, *[p.alias(n) for p, n in zip(places, names)])
        for key in self.keys:
            rows = rows.filter(F.col(key).isNotNull())
        segment, coarse = [*self.keys, SEGMENT], max(rows_per_task, sorted_rows)
        at = [F.col(n) for n in names]
        differs = [(F.min(n) < F.max(n)) | F.count(n).between(1, F.count("*") - 1) for n in names]
        by = F.coalesce(*[F.when(d, i) for i, d in enumerate(differs)])
        low = F.coalesce(*[F.when(d, F.min(n)) for d, n in zip(differs, names)])

        def above(tagged: DataFrame, limit: int) -> DataFrame:
            return staged(tagged.groupBy(*segment)
                          .agg(F.count("*").alias("_n"), by.alias("_by"), low.alias("_low"))
                          .filter((F.col("_n") > limit) & F.col("_by").isNotNull()),
                          "large-segments")

        found = replace(self, cuts=(), part_rows=None)
        rows = rows.withColumn(SEGMENT, _uncut())
        large = above(rows, rows_per_task)
        if large.isEmpty():
            return found
        if rows_per_task < coarse:
            found = replace(found, part_rows=rows_per_task)
            large = large.filter(F.col("_n") > coarse)
            if large.isEmpty():
                return found
        while True:
            # only the rows of segments to be cut are written; whoever ends needs no more than counts
            rows = staged(rows.join(large.select(*segment), segment, "left_semi"), "positions")
            quantiles = F.percentile_approx(_place(at), [i / FANOUT for i in range(1, FANOUT)],
                                            ACCURACY)
            cuts = staged(rows.join(large.drop("_n"), segment)
                          .groupBy(*segment, "_by", "_low").agg(quantiles.alias("_bounds"))
                          .withColumn("_bounds", F.array_distinct("_bounds"))
                          .withColumn("_marks", F.filter("_bounds", _is_mark)), "cuts")
            found = replace(found, cuts=(*found.cuts, cuts))
            rows = rows.join(cuts, segment).withColumn("_place", _place(at)).select(
                *self.keys, *names, F.array_append(SEGMENT, _part()).alias(SEGMENT))
            large = above(rows, coarse)
            if large.isEmpty():
                return found

    def tagged(self, df: DataFrame) -> DataFrame:
        """Add the segment; empty for the rows of keys that are not cut."""
        out = self._tagged(df, self._positions(df) if self.cuts else [])
        if self.part_rows:
            out = self._ranked(out)
            out = out.withColumn(SEGMENT, _joined_part())
        return out.select(*df.columns, SEGMENT)

    def _tagged(self, df: DataFrame, places: list[Column]) -> DataFrame:
        out = df.withColumn(SEGMENT, _uncut())
        for cuts in self.cuts:
            # A cut stands for more rows than a task is to have, so this side is small; by
            # its size Spark broadcasts it, or splits the large keys of the join.
            out = (out.join(cuts, [*self.keys, SEGMENT], "left")
                   .withColumn("_place", _place(places))
                   .withColumn(SEGMENT, F.when(F.col("_bounds").isNull(), F.col(SEGMENT))
                               .otherwise(F.array_append(SEGMENT, _part())))
                   .drop("_by", "_low", "_bounds", "_marks", "_place"))
        return out.select(*df.columns, SEGMENT)

    def _ranked(self, tagged: DataFrame) -> DataFrame:
        """Add the part of a segment with more than ``part_rows`` rows; rows that can't be
        told apart have one rank and so one part."""
        places = self._positions(tagged)
        w = Window.partitionBy(*self.keys, SEGMENT)
        cut = F.count("*").over(w) > self.part_rows
        for key in self.keys:
            cut = cut & F.col(key).isNotNull()
        part = F.floor((F.rank().over(w.orderBy(*places)) - 1) / self.part_rows).cast("int")
        return (tagged.withColumn(PART, part)
                .withColumn(PART, F.when(cut, F.col(PART))))

    def window(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *extra).orderBy(*self.order_by)

    def running(self, df: DataFrame, scans: Mapping[str, Scan | LastN],
                per_key: DataFrame | None = None) -> DataFrame:
        """Add one running value per entry of ``scans``, in event order.

        ``per_key`` (the keys and further columns, one row per key) is joined on
        the way, in the partitioning the rows have anyway.
        """
        if self.whole:
            w = self.window()
            out = df.select("*", *[self._local(s, w).alias(name) for name, s in scans.items()])
            return out if per_key is None else out.join(per_key, list(self.keys), "left")
        keys = [*self.keys, SEGMENT]
        tagged = self._tagged(df, self._positions(df) if self.cuts else [])
        w = self.window(SEGMENT)
        if self.part_rows:
            # Parts lie in their segment's partition: windows over them shuffle nothing.
            tagged, w = self._ranked(tagged), self.window(SEGMENT, PART)
        local = tagged.select("*", *[self._local(s, w).alias(name) for name, s in scans.items()],
                              F.lead(F.lit(False), 1, True).over(w).alias("_end"))
        if self.part_rows:
            local = local.withColumn(SEGMENT, _joined_part()).drop(PART)
        local = staged(local, "segments")
        carry = self._carried(local.filter(F.col("_end") & (F.size(SEGMENT) > 0)), scans)
        more = []
        if per_key is not None:
            # Repeated for the segments of cut keys.
            more = [c for c in per_key.columns if c not in self.keys]
            carry = carry.join(per_key, list(self.keys), "left").unionByName(
                per_key.withColumn(SEGMENT, _uncut()), allowMissingColumns=True)
        joined = local.join(carry, keys, "left")
        return joined.select(
            *[F.col(c) for c in df.columns],
            *[self._merged(s, F.col(f"_before_{name}"), F.col(name)).alias(name)
              for name, s in scans.items()], *more)

    def _local(self, scan: Scan | LastN, w: WindowSpec) -> Column:
        if isinstance(scan, LastN):
            return F.collect_list(scan.value).over(w.rowsBetween(1 - scan.n, HERE))
        return scan.local(w.rowsBetween(UNBOUNDED, HERE), self.order)

    def _merged(self, scan: Scan | LastN, before: Column, here: Column) -> Column:
        if isinstance(scan, LastN):
            both = F.concat(F.coalesce(before, F.array()), here)
            return F.when(F.size(here) >= scan.n, here).otherwise(_tail(both, scan.n))
        return scan.merge(before, here)

    def _carried(self, ends: DataFrame, scans: Mapping[str, Scan | LastN]) -> DataFrame:
        """Per segment of the large keys: what the earlier segments hand over.

        ``ends`` are the last rows of the segments.
        """
        w = Window.partitionBy(*self.keys).orderBy(SEGMENT)
        before = w.rowsBetween(UNBOUNDED, -1)
        # Every segment has a row, so n - 1 segments back hold n - 1 rows.
        out = [(_tail(F.flatten(F.collect_list(F.col(n)).over(w.rowsBetween(1 - s.n, -1))),
                      s.n - 1) if isinstance(s, LastN) else s.carry(F.col(n), before))
               .alias(f"_before_{n}") for n, s in scans.items()]
        return ends.select(*self.keys, SEGMENT, *out)


def measured_once(df: DataFrame, timeline: Timeline | None) -> tuple[Timeline, DataFrame]:
    """A timeline for ``df``, and ``df`` to go on with.

    Without a timeline ``df`` is written once: counting its keys and running over its rows
    would otherwise compute it twice, and parse what it comes from.
    """
    if timeline is not None:
        return timeline, df
    rows = staged(df, "rows")
    return Timeline().measured(rows), rows


def _uncut() -> Column:
    """A segment is named by its parts turn by turn; arrays compare from the left."""
    return F.array().cast("array<int>")


def _place(places: list[Column]) -> Column:
    """What a segment is cut by, counted from its lowest value."""
    chosen = F.when(F.col("_by") == 0, places[0])
    for i, place in enumerate(places[1:], 1):
        chosen = chosen.when(F.col("_by") == i, place)
    far = F.lit(2 ** 63 - 1)
    return F.when(chosen.isNotNull(), F.coalesce(F.try_subtract(chosen, F.col("_low")), far))


def _is_mark(_: Column, i: Column) -> Column:
    return i % STEP == STEP - 1


def _part() -> Column:
    """Part of a segment: between two cuts, or on one, which keeps a burst by itself.

    Twice the number of cuts below a place, and one more on a cut. Cuts are in order: the marks,
    every ``STEP``-th of them, say between which few of them the place is.
    """
    place = F.col("_place")
    block = F.size(F.filter("_marks", lambda b: b < place))
    near = F.aggregate(F.slice("_bounds", block * STEP + 1, STEP), F.lit(0),
                       lambda n, b: n + F.when(b < place, 2).when(b == place, 1).otherwise(0))
    return F.when(place.isNull(), -1).otherwise(block * (2 * STEP) + near)


def _joined_part() -> Column:
    """The name of a segment with the part its rows are cut into, if they are."""
    return F.when(F.col(PART).isNull(), F.col(SEGMENT)).otherwise(F.array_append(SEGMENT, F.col(PART)))


def _by_order(a: Column, b: Column) -> Column:
    return F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)


def _tail(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - F.lit(n - 1), F.lit(1)), n)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The newest ``n`` rows per key.

    The rank filter is applied before the shuffle as well, so a map task sends at
    most ``n`` rows per key however many it read.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (df.withColumn("_rank", F.row_number().over(w))
            .filter(F.col("_rank") <= n).drop("_rank"))
