"""Requests in the trailing minute against a quota.

Frames that slide along time are recomputed row by row in a window, which is
quadratic for busy keys. Here every request is two events, its arrival and its
expiry: their running balance is the number of requests that are still recent. The
oldest of them is as many places back in the order of arrivals. Both are running
values, so a busy key is cut over many tasks wherever its rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import timeline as tl
from threadloom.operators.timeline import Timeline, micros
from threadloom.schema import REQUESTS_PER_MINUTE


def trailing_rate(requests: DataFrame, keys: tuple[str, ...] = ("tenant_id",),
                  seconds: int = 60, limit: int = REQUESTS_PER_MINUTE, ts: str = "ts",
                  seq: str = "seq", rows_per_task: int = tl.ROWS_PER_TASK) -> DataFrame:
    """Add ``recent`` (requests in the trailing window before this one),
    ``over_limit`` and ``wait_seconds`` (until the oldest of them leaves).

    A request leaves exactly ``seconds`` after it came. Of requests at the same
    time, those with a lower ``seq`` count as earlier.
    """
    width = seconds * 1_000_000
    # At equal times an expiry comes before an arrival.
    event = F.explode(F.array(*[F.struct(F.lit(sign).alias("sign"), F.timestamp_micros(
        F.col("_at") + after).alias("time")) for sign, after in ((1, 0), (-1, width))]))
    events = requests.withColumn("_at", micros(requests, ts)).select("*", event.alias("_e"))
    events = events.select("*", F.col("_e.sign").alias("_sign"),
                           F.col("_e.time").alias("_time")).drop("_e")
    order = Timeline(keys=keys, ts="_time", seq=("_sign", seq)).measured(events, rows_per_task)
    arrival = F.col("_sign") == 1
    out = order.running(events, {"_open": tl.total(F.col("_sign")), "_nr": tl.count(arrival)})
    out = (out.filter(arrival).withColumn("recent", F.col("_open") - 1)
           .withColumn("over_limit", F.col("recent") >= limit))
    # The oldest recent request came ``recent`` places before; only who must wait asks for it.
    front = out.select(*keys, F.col("_nr").alias("_front"), F.col("_at").alias("_oldest"))
    asked = F.when(F.col("over_limit") & (F.col("recent") > 0), F.col("_nr") - F.col("recent"))
    out = out.withColumn("_front", asked)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    late = out.filter(F.col("_front").isNotNull()).alias("r").join(
        front.alias("f"), [F.col("r._front") == F.col("f._front"), *same], "left")
    columns = [F.col(f"r.{c}").alias(c) for c in (*requests.columns, "recent", "over_limit", "_at")]
    late = late.select(*columns, F.col("f._oldest").alias("_oldest"))
    free = out.filter(F.col("_front").isNull()).withColumn(
        "_oldest", F.lit(None).cast("bigint")).select(*late.columns)
    wait = (F.col("_oldest") + width - F.col("_at")) / 1e6
    return late.unionByName(free).select(*requests.columns, "recent", "over_limit",
                                         wait.alias("wait_seconds"))
