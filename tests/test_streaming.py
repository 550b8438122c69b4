"""Streams replayed in several micro-batches, and over a restart, equal the batch result."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from threadloom.operators import merge, messages as msg, state, views
from threadloom.operators.results import typed_results, validate_agent_result
from threadloom.operators.scoring import summary_fold
from threadloom.plans import adapters as A
from threadloom.plans.catalog import numbering_fold
from threadloom.streaming import sinks, stateful


@pytest.fixture(scope="module")
def slices(spark, tmp_path_factory):
    """Events in four files, in order of time."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(4):
        part = rows.filter((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250))
        part.coalesce(1).write.mode("append").parquet(path)
    return path, rows.schema


def stream(spark, slices, sql):
    path, schema = slices
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)
    return A.select_from(spark, source, sql, "events")


def drain(df, path, mode="append", sink=None):
    run = sinks.run(df, sink or sinks.write_batches(f"{path}/out"), f"{path}/check", mode,
                    once=True)
    run.awaitTermination()
    return f"{path}/out"


def rows_of(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_state_with_summaries(spark, slices, tmp_path):
    def parts(messages, results):
        rows = msg.valid_rows(msg.validate_message(messages)).filter("event_type <> 'purchase'")
        summaries = typed_results(validate_agent_result(results)).filter("kind = 'summary'")
        return rows.drop("event_type", "user_id"), summaries

    out = drain(stateful.stream_conversation_state(
        *parts(stream(spark, slices, A.MESSAGES), stream(spark, slices, A.RESULTS))),
        str(tmp_path))
    batch = state.conversation_state_with_summary(
        *parts(A.messages(spark, SF), A.raw_results(spark, SF)))
    columns = ["tenant_id", "conversation_id", "seq", "message_count", "participants",
               "recent_messages", "created_at", "last_activity", "summary"]
    assert rows_of(sinks.read_batches(spark, out), columns) == rows_of(batch, columns)


def test_merge_and_restart(spark, slices, tmp_path):
    rows = typed_results(validate_agent_result(stream(spark, slices, A.RESULTS)))
    merged = stateful.stream_merge_intelligence(rows)
    out = drain(merged, str(tmp_path))
    columns = ["tenant_id", "conversation_id", "seq", "kind", "sentiment", "pii", "insights",
               "summary", "last_updated"]
    batch = merge.merge_intelligence(A.results(spark, SF))
    assert rows_of(sinks.read_batches(spark, out), columns) == rows_of(batch, columns)
    # A second run from the same checkpoint finds nothing new.
    again = drain(stateful.stream_merge_intelligence(
        typed_results(validate_agent_result(stream(spark, slices, A.RESULTS)))), str(tmp_path))
    assert sinks.read_batches(spark, again).count() == batch.count()
    final = sinks.read_latest(spark, out, ["tenant_id", "conversation_id"], ["ts", "seq"])
    keep = [c for c in columns if c not in ("seq", "kind")]
    assert rows_of(final, keep) == rows_of(
        merge.merge_intelligence_final(A.results(spark, SF)), keep)


def test_latest_summary_and_compaction(spark, slices, tmp_path):
    from threadloom.plans.catalog import events, summary_stream
    from threadloom.schema import SUMMARY_STREAM, TOPIC_SUMMARY

    raw = stream(spark, slices, A.RESULTS).filter(F.col("topic") == TOPIC_SUMMARY)
    declared = events.declare_stream(raw, SUMMARY_STREAM, key="conversation_id")
    out = drain(sinks.stream_latest_summary(declared), str(tmp_path), "update")
    batch = views.latest_summary(summary_stream(spark, SF))
    keys = ["conversation_id"]
    assert rows_of(sinks.read_latest(spark, out, keys), batch.columns) == rows_of(
        batch, batch.columns)
    sinks.compact(spark, out, str(tmp_path / "small"), keys)
    small = sinks.read_latest(spark, str(tmp_path / "small"), keys)
    assert rows_of(small, batch.columns) == rows_of(batch, batch.columns)


def test_fold(spark, slices, tmp_path):
    rows = msg.valid_rows(msg.validate_message(stream(spark, slices, A.MESSAGES)))
    out = drain(stateful.stream_summary_fold(rows, numbering_fold), str(tmp_path))
    batch = summary_fold(msg.valid_rows(msg.validate_message(A.messages(spark, SF))),
                         numbering_fold)
    assert rows_of(sinks.read_batches(spark, out), batch.columns) == rows_of(batch, batch.columns)


def test_dead_letters_and_a_repeated_batch(spark, slices, tmp_path):
    checked = msg.validate_message(
        stream(spark, slices, A.MESSAGES).withColumn("key", F.col("conversation_id"))
        .withColumn("value", F.col("message")))
    sink = sinks.write_split(str(tmp_path / "good"), str(tmp_path / "dead"))

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    drain(checked, str(tmp_path), sink=twice)
    good = spark.read.parquet(str(tmp_path / "good")).count()
    dead = spark.read.parquet(str(tmp_path / "dead")).count()
    assert dead and good + dead == 1000


def test_change_feed(spark, slices, tmp_path):
    rows = typed_results(validate_agent_result(stream(spark, slices, A.RESULTS)))
    out = drain(stateful.stream_merge_intelligence(rows), str(tmp_path),
                sink=sinks.change_feed_sink(f"{tmp_path}/out"))
    feed = spark.read.json(out)
    changes = merge.completeness(merge.merge_intelligence(A.results(spark, SF)))
    assert feed.count() == changes.filter("complete").count()
    assert {"type", "tenant_id", "conversation_id", "data"} <= set(feed.columns)
