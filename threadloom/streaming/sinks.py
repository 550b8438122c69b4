"""Stream sinks that give the same table after a retry, and the way to read them.

Every micro-batch is written to a folder named by its number, replacing whatever
an earlier try left there. A reader takes the newest row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.merge import change_feed, first_seen, merge_totals, merged_records
from threadloom.operators.messages import dead_letters, valid_rows
from threadloom.operators.timeline import latest
from threadloom.operators.views import latest_summary, latest_summary_by_tenant
from threadloom.schema import KEYS
from threadloom.session import STATE_STORE
from threadloom.sources.sinks import JSON_OPTIONS

BATCH = "batch_id"


def write_batches(path: str, fmt: str = "parquet",
                  change: Callable[[DataFrame], DataFrame] | None = None,
                  **options: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each micro-batch to its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        rows = change(batch) if change else batch
        rows.write.format(fmt).options(**options).mode("overwrite").save(
            f"{path}/{BATCH}={number}")

    return write


def write_split(good: str, dead: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for checked rows: valid ones and dead letters."""

    def write(checked: DataFrame, number: int) -> None:
        for rows, path in ((valid_rows(checked), good), (dead_letters(checked), dead)):
            rows.write.format("parquet").mode("overwrite").save(f"{path}/{BATCH}={number}")

    return write


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
        mode: str = "append", once: bool = False, every: str = "2 seconds",
        name: str | None = None, store: str | None = None) -> StreamingQuery:
    """Start a stream into a sink; ``once`` takes what is there and ends.

    ``store`` is the class of the state store if it is not to be the session's. A stream keeps
    the settings it starts with, and its checkpoint the store; the session's stays as it is.
    """
    writer = (stream.writeStream.foreachBatch(sink).outputMode(mode)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    writer = writer.queryName(name) if name else writer
    if store is None:
        return writer.start()
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, store)
    try:
        return writer.start()
    finally:
        conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows a stream has written."""
    return spark.read.parquet(path)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str],
                order: Sequence[str] = ()) -> DataFrame:
    """The newest row per key over all micro-batches."""
    return latest(read_batches(spark, path), keys, [BATCH, *order]).drop(BATCH)


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str],
            order: Sequence[str] = ()) -> None:
    """Write the newest rows as one folder that ``read_latest`` can start from."""
    rows = latest(read_batches(spark, path), keys, [BATCH, *order])
    rows.withColumn(BATCH, F.lit(-1)).write.mode("overwrite").partitionBy(BATCH).parquet(target)


def stream_latest_summary(stream: DataFrame, by_tenant: bool = False,
                          position: Sequence[str] = ("ts", "partition", "offset")) -> DataFrame:
    """Latest summary values as a running aggregate, for update mode.

    The batch function is the stream function; Spark keeps the aggregates.
    """
    return (latest_summary_by_tenant if by_tenant else latest_summary)(stream, position)


def change_feed_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Complete merged records as update envelopes, JSON lines per micro-batch."""
    return write_batches(path, "json", change_feed, **JSON_OPTIONS)


# -- retention -----------------------------------------------------------------

def write_retained(kept: str, expired: str, marks: str, seconds: int, topic: str = "topic",
                   ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function with a watermark of its own per topic.

    A topic's mark is the newest time seen so far, this micro-batch included. Rows not newer
    than ``seconds`` before it go to ``expired``, the others to ``kept``. The marks are a small
    table per micro-batch, made from the one before; a retry makes the same one again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            spark = batch.sparkSession
            newest = batch.groupBy(topic).agg(F.max(ts).alias("mark"))
            if number:
                newest = newest.unionByName(
                    spark.read.schema(newest.schema).parquet(f"{marks}/{BATCH}={number - 1}"))
            newest = newest.groupBy(topic).agg(F.max("mark").alias("mark"))
            here = f"{marks}/{BATCH}={number}"
            newest.coalesce(1).write.mode("overwrite").parquet(here)
            # one row per topic, of which there are few
            rows = batch.join(F.broadcast(spark.read.parquet(here)), topic, "left")
            old = F.coalesce(F.col(ts) <= _limit(seconds), F.lit(False))
            for path, some in ((kept, ~old), (expired, old)):
                rows.where(some).drop("mark").write.mode("overwrite").parquet(
                    f"{path}/{BATCH}={number}")
        finally:
            batch.unpersist()

    return write


def _limit(seconds: int) -> Column:
    return F.col("mark") - F.expr(f"INTERVAL '{seconds}' SECOND")


def read_retained(spark: SparkSession, kept: str, marks: str, seconds: int,
                  topic: str = "topic", ts: str = "ts") -> DataFrame:
    """What is retained by now: the kept rows within ``seconds`` of their topic's newest time."""
    newest = latest(spark.read.parquet(marks), [topic], [BATCH]).drop(BATCH)
    rows = spark.read.parquet(kept).join(F.broadcast(newest), topic, "left")
    return rows.where(F.col(ts).isNull() | (F.col(ts) > _limit(seconds))).drop("mark")


# -- running merge -------------------------------------------------------------

def stream_merge_parts(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged record as two running aggregates, for update mode: no Python, no lists.

    One row of fixed size per conversation, and one per conversation and (type, value) of an
    entity. ``read_merged`` puts together what the two streams have written.
    """
    return merge_totals(results), first_seen(results)


def read_merged(spark: SparkSession, totals: str, seen: str) -> DataFrame:
    """Merged records from the folders of the two streams of ``stream_merge_parts``."""
    keys = list(KEYS)
    return merged_records(read_latest(spark, totals, keys),
                          read_latest(spark, seen, [*keys, "type", "value"]))
