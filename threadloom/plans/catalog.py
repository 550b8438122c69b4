"""The query catalogue: every operator over the given tables.

Each entry takes a session and a folder of tables and returns a DataFrame with
flat columns. ``oracles`` has the SQL the results are checked against.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schema as S
from threadloom.operators import (context, merge, messages as msg, pii, rates, responses, scoring,
                                  state, transcript, views)
from threadloom.operators.results import (classify_result, result_keys, validate_agent_result)
from threadloom.operators.timeline import Timeline
from threadloom.plans import adapters as A
from threadloom.plans import jobs
from threadloom.sources import events, serving, sinks, versions
from threadloom.streaming import keyed, stateful
from threadloom.streaming import sinks as stream_sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEYS = S.KEYS
# Small enough that the larger keys of the test tables are cut into many segments.
SMALL_SEGMENT = 16


def query(function: Query) -> Query:
    """Register under the function's name; a final "_" only avoids a clash of names."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


# -- inputs --------------------------------------------------------------------

def valid_messages(spark: SparkSession, d: str) -> DataFrame:
    checked = msg.validate_message(A.messages(spark, d))
    return msg.valid_rows(checked)


def turns(spark: SparkSession, d: str) -> DataFrame:
    return msg.normalize_message(A.turns(spark, d))


def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    """All messages; those of purchases are at the positions of the summaries."""
    return valid_messages(spark, d).drop("event_type", "user_id")


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return A.results(spark, d).filter(F.col("kind") == "summary")


def merged(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_intelligence_final(A.results(spark, d))


# -- flat columns --------------------------------------------------------------

def texts(items: Column) -> Column:
    return F.array_join(items, "|")


def entity_text(items: Column) -> Column:
    return texts(F.transform(items, lambda e: F.concat_ws(
        ":", e["type"], e["value"], e["start_index"], e["end_index"])))


def message_texts(items: Column) -> Column:
    return texts(F.transform(items, lambda m: m["message"]))


def count_of(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def flat_sentiment() -> list[Column]:
    return [F.col("sentiment.sentiment").alias("sentiment"),
            F.col("sentiment.confidence").alias("confidence"),
            F.col("sentiment.emotion").alias("emotion"),
            F.col("sentiment.reasoning").alias("reasoning")]


def flat_pii() -> list[Column]:
    return [F.col("pii.has_pii").alias("has_pii"),
            entity_text(F.col("pii.entities")).alias("entities"),
            F.col("pii.redacted_text").alias("redacted_text")]


def flat_insights() -> list[Column]:
    i = F.col("insights")
    return [i["intent"].alias("intent"), i["urgency"].alias("urgency"),
            texts(i["categories"]).alias("categories"),
            texts(i["suggested_actions"]).alias("suggested_actions"),
            i["requires_escalation"].alias("requires_escalation"),
            i["estimated_resolution_time"].alias("estimated_resolution_time"),
            texts(i["key_concerns"]).alias("key_concerns")]


def flat_summary(s: str = "summary") -> list[Column]:
    return [F.col(f"{s}.tldr").alias("tldr"),
            F.col(f"{s}.customer_issue").alias("customer_issue"),
            F.col(f"{s}.agent_response").alias("agent_response"),
            texts(F.col(f"{s}.key_points")).alias("key_points"),
            texts(F.col(f"{s}.next_steps")).alias("next_steps")]


def flat_merged() -> list[Column]:
    return [*flat_sentiment(), *flat_pii(), *flat_insights(), *flat_summary()]


def flat_state(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "seq", "ts", count_of("message_count"), "created_at",
                     "last_activity", texts(F.col("participants")).alias("participants"),
                     message_texts(F.col("recent_messages")).alias("recent"))


# -- sources and sinks ---------------------------------------------------------

def events_with_headers(spark, d):
    """Results as events of a topic, with a header given twice."""
    raw = A.raw_results(spark, d)
    tenant = F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string"))
    headers = F.array(*[F.struct(F.lit(k).alias("key"), val.cast("binary").alias("value"))
                        for k, val in (("tenant_id", F.lit("old")), ("tenant_id", tenant))])
    return raw.withColumn("headers", headers)


_STORED: dict[tuple[str, str, str], str] = {}


def stored_once(spark: SparkSession, d: str, name: str, write: Callable[[str], None]) -> str:
    """The folder of a table that is written once per session and read by every query."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _STORED:
        path = sinks.work_dir(spark, name)
        write(path)
        _STORED[at] = path
    return _STORED[at]


def topic_files(spark, d) -> str:
    """Results as the files of a topic."""
    rows = events_with_headers(spark, d).select(
        "topic", F.col("partition").cast("int").alias("partition"), "offset", "key", "value",
        "headers", F.col("ts").alias("timestamp"))
    return stored_once(spark, d, "topic", lambda path: sinks.write_files(rows, path, "parquet"))


def flat_events(rows: DataFrame) -> DataFrame:
    return rows.select(
        "topic", "offset", "key", F.col("document").isNotNull().alias("is_json"),
        F.try_variant_get(F.col("document"), "$.conversation_id", "string").alias("conversation_id"),
        F.col("header")["tenant_id"].alias("header_tenant"))


@query
def read_events(spark, d):
    return flat_events(events.decode(events.from_files(spark, topic_files(spark, d))))


@query
def stream_read_events(spark, d):
    """The same files as a stream, one file a micro-batch."""
    source = events.from_files(spark, topic_files(spark, d), streaming=True, files_per_trigger=1)
    return stream_sinks.read_batches(spark, _drained(
        spark, flat_events(events.decode(source)), "events", "append")).drop(stream_sinks.BATCH)


@query
def read_multi(spark, d):
    both = events.read_multi({
        S.TOPIC_MESSAGES: A.messages(spark, d).select("conversation_id", "seq", "message"),
        S.TOPIC_SUMMARY: A.raw_results(spark, d).filter(F.col("topic") == S.TOPIC_SUMMARY)
        .select(F.col("key").alias("conversation_id"), "seq", "value")})
    return both.select("topic", "conversation_id", "seq", "message", "value")


def summary_stream(spark, d):
    raw = A.raw_results(spark, d).filter(F.col("topic") == S.TOPIC_SUMMARY)
    return events.declare_stream(raw, S.SUMMARY_STREAM, key="conversation_id")


@query
def declare_stream(spark, d):
    return summary_stream(spark, d).select(
        "conversation_id", "tenant_id", "tldr", "customer_issue", "agent_response",
        texts(F.col("key_points")).alias("key_points"),
        texts(F.col("next_steps")).alias("next_steps"), "offset")


@query
def write_keyed_json(spark, d):
    rows = sinks.keyed_json(valid_messages(spark, d),
                            columns=["conversation_id", "tenant_id", "sender", "message",
                                     "channel"],
                            position=("topic", "partition", "offset"))
    header = F.transform("headers", lambda h: F.concat(
        h["key"], F.lit("="), h["value"].cast("string")))
    return rows.select("key", "value", texts(header).alias("headers"))


@query
def dead_letter(spark, d):
    bad_requests = msg.dead_letters(
        msg.validate_message(A.messages(spark, d).withColumn("key", F.col("conversation_id"))),
        value=F.to_json(F.struct("conversation_id", "tenant_id", "sender", "message", "channel",
                                 "event_type", "user_id"), {"ignoreNullFields": "false"}))
    bad_results = msg.dead_letters(validate_agent_result(A.raw_results(spark, d)))
    header = F.transform("headers", lambda h: F.concat(
        h["key"], F.lit("="), h["value"].cast("string")))
    return bad_requests.unionByName(bad_results).select(
        "original_topic", "original_partition", "original_offset", "key", "value", "error",
        "error_type", texts(header).alias("headers"))


@query
def declare_stream_dead(spark, d):
    """Rows of all topics that a declared stream leaves out, as dead letters."""
    left_out = events.undeclared(A.raw_results(spark, d), S.SUMMARY_STREAM)
    return msg.dead_letters(left_out).select(
        "original_topic", "original_partition", "original_offset", "key", "value", "error",
        "error_type")


@query
def intelligence_lookup(spark, d):
    """Many requests at once against the stored table."""
    path = stored_once(spark, d, "serving", lambda at: serving.write_serving(
        merged(spark, d), at, buckets=8))
    found = serving.read_serving(spark, path).lookup_many(A.requested(spark, d))
    return found.select(*KEYS, *flat_merged(), "last_updated")


@query
def read_versions(spark, d):
    """Files of two schema versions; the newer has a field with a default and with nulls."""
    name = F.concat_ws("-", "conversation_id", F.col("seq").cast("string")).alias("message_id")

    def write(path):
        versions.write_version(A.turns(spark, d).select(name, F.col("message").alias("content")),
                               path, 1)
        priority = F.when(F.col("seq") % 5 > 0, F.col("event_type")).alias("priority")
        versions.write_version(A.messages(spark, d).select(
            name, F.col("message").alias("content"), priority), path, 2, {"priority": "normal"})

    return versions.read_versions(spark, stored_once(spark, d, "versions", write)).select(
        "message_id", "content", "priority", F.col("schema_version").cast("bigint")
        .alias("schema_version"))


@query
def change_feed(spark, d):
    feed = merge.change_feed(merged(spark, d))
    return feed.select("type", *KEYS, F.col("data.sentiment.sentiment").alias("sentiment"),
                       F.col("data.summary.tldr").alias("tldr"),
                       F.col("data.last_updated").alias("last_updated"))


@query
def read_view_response(spark, d):
    rows = events.read_view_response(A.view_answers(spark, d))
    doc = F.col("document")
    return rows.select("seq", F.try_variant_get(doc, "$.id", "bigint").alias("id"),
                       F.try_variant_get(doc, "$.n", "bigint").alias("n"))


@query
def retention_filter(spark, d):
    """24 hours: the rows of the test tables are sparse."""
    rows = A.raw_results(spark, d).select("topic", "seq", "ts")
    return views.retention_filter(rows, seconds=86_400)


@query
def schema_evolve(spark, d):
    old = A.turns(spark, d).select(
        F.concat_ws("-", "conversation_id", F.col("seq").cast("string")).alias("message_id"),
        F.col("message").alias("content"))
    new = A.messages(spark, d).select(
        F.concat_ws("-", "conversation_id", F.col("seq").cast("string")).alias("message_id"),
        F.col("message").alias("content"), F.col("event_type").alias("priority"))
    return views.schema_evolve(old, new, {"priority": "normal"})


# -- projections and filters ---------------------------------------------------

@query
def normalize_message(spark, d):
    return turns(spark, d).select("message_id", *KEYS, "sender", "message", "channel", "ts",
                                  "seq")


@query
def read_requests(spark, d):
    checked = msg.validate_message(events.read_requests(A.request_texts(spark, d)))
    return checked.select("seq", "error", "error_type", "conversation_id", "tenant_id", "message",
                          F.col("metadata")["n"].alias("metadata_n"))


@query
def validate_message(spark, d):
    return msg.validate_message(A.requests(spark, d)).select("seq", "error", "error_type")


@query
def validate_agent_result_(spark, d):
    return validate_agent_result(A.raw_results(spark, d)).select(
        "seq", "kind", *KEYS, "error", "error_type")


@query
def classify_result_(spark, d):
    return classify_result(A.raw_results(spark, d)).select("seq", "kind")


@query
def drop_keyless(spark, d):
    return msg.drop_keyless(result_keys(A.raw_results(spark, d))).select("seq", *KEYS, "kind")


@query
def sentiment_trigger(spark, d):
    states = state.conversation_state(valid_messages(spark, d))
    return state.sentiment_trigger(states).select(*KEYS, "seq", count_of("message_count"))


@query
def latest_message(spark, d):
    states = state.rolling_window(valid_messages(spark, d))
    return state.latest_message(states).select(
        *KEYS, "seq", F.col("latest.sender").alias("latest_sender"),
        F.col("latest.message").alias("latest_message"))


@query
def parse_model_response(spark, d):
    parsed = responses.parse_model_response(A.answers(spark, d))
    return parsed.select("seq", "kind", "error", "error_type", *flat_merged())


@query
def route_conversation(spark, d):
    return views.route_conversation(merged(spark, d)).select(*KEYS, "route")


@query
def high_urgency(spark, d):
    return views.high_urgency(merged(spark, d)).select(
        *KEYS, F.col("insights.urgency").alias("urgency"))


@query
def completeness(spark, d):
    changes = merge.merge_intelligence(A.results(spark, d))
    return merge.completeness(changes).select(
        *KEYS, "seq", *[f"has_{k}" for k in S.KINDS], "complete")


# -- joins ---------------------------------------------------------------------

@query
def attach_summary_asof(spark, d):
    out = state.attach_summary_asof(chat_messages(spark, d), summaries(spark, d))
    return out.select(*KEYS, "seq", "ts", *flat_summary())


@query
def attach_summary_asof_large_keys(spark, d):
    return _cut_asof(chat_messages(spark, d), summaries(spark, d))


def _cut_asof(chat: DataFrame, found: DataFrame) -> DataFrame:
    """Messages and summaries measured together; summaries are parsed once."""
    found = sinks.staged(found, "summaries")
    places = chat.select(*KEYS, "ts", "seq").unionByName(found.select(*KEYS, "ts", "seq"))
    t = Timeline().measured(places, rows_per_task=SMALL_SEGMENT)
    return state.attach_summary_asof(chat, found, t).select(*KEYS, "seq", "ts", *flat_summary())


def flat_changes(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "seq", "kind", *flat_merged(), "last_updated")


@query
def merge_intelligence(spark, d):
    return flat_changes(merge.merge_intelligence(A.results(spark, d)))


@query
def merge_intelligence_large_keys(spark, d):
    return flat_changes(merge.merge_intelligence(*_cut_results(A.results(spark, d))))


def _cut_results(rows: DataFrame) -> tuple[DataFrame, Timeline]:
    """Results, parsed once, and the cuts of their larger keys."""
    rows = sinks.staged(rows, "rows")
    return rows, Timeline().measured(rows, rows_per_task=SMALL_SEGMENT)


@query
def pii_tombstone(spark, d):
    """Error events delete what their user's earlier PII records hold."""
    raw = A.raw_results(spark, d)
    pii_id = F.concat(F.lit("pii-"), F.col("user_id").cast("string")).alias("pii_id")
    records = raw.filter(F.col("topic") == S.TOPIC_PII).select(pii_id, "ts", "seq", "value")
    deleted = raw.filter(F.col("event_type") == "error").select(pii_id, "ts", "seq")
    return views.pii_tombstone(records, deleted)


@query
def pii_reference(spark, d):
    """Insights rows point at their user's newest PII record."""
    raw = A.raw_results(spark, d)
    number = F.col("user_id").cast("string")
    newest = views.latest_values(
        raw.filter(F.col("topic") == S.TOPIC_PII)
        .select(F.concat(F.lit("pii-"), number).alias("pii_id"), "ts", "partition", "offset",
                F.col("value").alias("pii_value")), ["pii_id"], ["pii_value"])
    rows = raw.filter(F.col("topic") == S.TOPIC_INSIGHTS).select(
        "seq", F.col("key").alias("conversation_id"),
        F.concat(F.lit("pii-"), number).alias("pii_ref"))
    return views.pii_reference(rows, newest)


# -- aggregations --------------------------------------------------------------

def _flat_view(df: DataFrame) -> DataFrame:
    return df.select(*[texts(F.col(c)).alias(c) if c in ("key_points", "next_steps")
                       else F.col(c) for c in df.columns])


@query
def latest_summary(spark, d):
    return _flat_view(views.latest_summary(summary_positions(spark, d)))


@query
def latest_summary_by_tenant(spark, d):
    return _flat_view(views.latest_summary_by_tenant(summary_positions(spark, d)))


def summary_positions(spark, d):
    return summary_stream(spark, d)


@query
def latest_record(spark, d):
    return merge.latest_record(A.results(spark, d)).select(
        *KEYS, "kind", "seq", *flat_merged())


@query
def conversation_state(spark, d):
    return flat_state(state.conversation_state(valid_messages(spark, d)))


@query
def conversation_state_large_keys(spark, d):
    rows = valid_messages(spark, d)
    t = Timeline().measured(rows, rows_per_task=SMALL_SEGMENT)
    return flat_state(state.conversation_state(rows, t))


@query
def conversation_state_ties(spark, d):
    """Rows out of order and with many equal times, in cut keys."""
    rows = msg.valid_rows(msg.validate_message(A.mixed_messages(spark, d)))
    t = Timeline().measured(rows, rows_per_task=SMALL_SEGMENT)
    return flat_state(state.conversation_state(rows, t))


@query
def transcript_ties(spark, d):
    rows = msg.valid_rows(msg.validate_message(A.mixed_messages(spark, d)))
    t = Timeline().measured(rows, rows_per_task=SMALL_SEGMENT)
    return transcript.transcript(rows, 7, t).select(
        *KEYS, count_of("part"), count_of("lines"), "text")


def tied_results(spark, d) -> tuple[DataFrame, Timeline]:
    """Results out of order, with many equal times, and the cuts of their larger keys."""
    return _cut_results(A.mixed_results(spark, d))


@query
def merge_intelligence_ties(spark, d):
    return flat_changes(merge.merge_intelligence(*tied_results(spark, d)))


@query
def merge_intelligence_final_ties(spark, d):
    return merge.merge_intelligence_final(A.mixed_results(spark, d)).select(
        *KEYS, *flat_merged(), "last_updated")


@query
def running_latest_ties(spark, d):
    return flat_running(merge.running_latest(*tied_results(spark, d)))


@query
def pii_sticky_ties(spark, d):
    return merge.pii_sticky(*tied_results(spark, d)).select(*KEYS, "seq", "found", "has_pii")


@query
def pii_entity_merge_ties(spark, d):
    return flat_entities(merge.pii_entity_merge(A.mixed_results(spark, d)))


@query
def latest_record_ties(spark, d):
    return merge.latest_record(A.mixed_results(spark, d)).select(
        *KEYS, "kind", "seq", *flat_merged())


def tied_chat(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = msg.valid_rows(msg.validate_message(A.mixed_messages(spark, d)))
    return (rows.drop("event_type", "user_id"),
            A.mixed_results(spark, d).filter(F.col("kind") == "summary"))


@query
def attach_summary_asof_ties(spark, d):
    return _cut_asof(*tied_chat(spark, d))


@query
def sentiment_context_ties(spark, d):
    states = state.conversation_state_with_summary(*tied_chat(spark, d))
    return context.sentiment_context(states).select(*KEYS, "seq", "context")


def _flat_final(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, count_of("message_count"), "created_at", "last_activity",
                     texts(F.col("participants")).alias("participants"),
                     message_texts(F.col("recent_messages")).alias("recent"))


@query
def conversation_final(spark, d):
    return _flat_final(state.conversation_final(valid_messages(spark, d)))


@query
def merge_intelligence_final(spark, d):
    return merged(spark, d).select(*KEYS, *flat_merged(), "last_updated")


@query
def pii_sticky(spark, d):
    return merge.pii_sticky(A.results(spark, d)).select(*KEYS, "seq", "found", "has_pii")


@query
def pii_entity_merge(spark, d):
    return flat_entities(merge.pii_entity_merge(A.results(spark, d)))


def flat_entities(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.col("since.seq").alias("since_seq"), count_of("place"),
                       F.col("entity.type").alias("type"), F.col("entity.value").alias("value"),
                       F.col("entity.start_index").cast("bigint").alias("start_index"))


@query
def qa_metrics(spark, d):
    out = views.qa_metrics(merged(spark, d), "tenant_id")
    return out.select("tenant_id", *[count_of(c) for c in (
        "total_conversations", "avg_resolution_time", "customer_satisfaction",
        "escalation_rate")], "positive_share", "escalated_share")


@query
def intent_urgency_report(spark, d):
    return views.intent_urgency_report(merged(spark, d))


# -- windows -------------------------------------------------------------------

@query
def rolling_last10(spark, d):
    return state.rolling_window(valid_messages(spark, d)).select(
        *KEYS, "seq", message_texts(F.col("recent_messages")).alias("recent"))


@query
def context_last5(spark, d):
    states = state.rolling_window(turns(spark, d))
    return context.context_last5(states).select(*KEYS, "seq", "context")


@query
def message_ordinal(spark, d):
    return state.message_ordinal(valid_messages(spark, d)).select(
        *KEYS, "seq", count_of("message_number"))


@query
def running_latest(spark, d):
    return flat_running(merge.running_latest(A.results(spark, d)))


def flat_running(out: DataFrame) -> DataFrame:
    return out.select(*KEYS, "seq", F.col("latest_sentiment.reasoning").alias("sentiment"),
                      F.col("latest_pii.redacted_text").alias("pii"),
                      F.col("latest_insights.intent").alias("insights"),
                      F.col("latest_summary.tldr").alias("summary"))


@query
def trailing_rate(spark, d):
    """Six hours and two requests: the rows of the test tables are sparse."""
    rows = A.messages(spark, d).select("user_id", "ts", "seq")
    out = rates.trailing_rate(rows, keys=("user_id",), seconds=6 * 3600, limit=2)
    return out.select("user_id", "seq", count_of("recent"), "over_limit",
                      F.round("wait_seconds", 6).alias("wait_seconds"))


@query
def trailing_rate_by_tenant(spark, d):
    rows = A.messages(spark, d).select("tenant_id", "ts", "seq")
    out = rates.trailing_rate(rows, seconds=3600, limit=5)
    return out.select("tenant_id", "seq", count_of("recent"), "over_limit",
                      F.round("wait_seconds", 6).alias("wait_seconds"))


@query
def tail_n(spark, d):
    return state.tail_n(valid_messages(spark, d), 5).select(*KEYS, "seq", "sender", "message")


# -- contexts ------------------------------------------------------------------

def states_with_summary(spark, d):
    return state.conversation_state_with_summary(chat_messages(spark, d), summaries(spark, d))


@query
def sentiment_context(spark, d):
    return context.sentiment_context(states_with_summary(spark, d)).select(
        *KEYS, "seq", "context")


@query
def insights_context(spark, d):
    states = state.rolling_window(valid_messages(spark, d))
    return context.insights_context(states).select(*KEYS, "seq", "context")


@query
def summary_context(spark, d):
    return context.summary_context(states_with_summary(spark, d)).select(
        *KEYS, "seq", "context")


@query
def transcript_(spark, d):
    return transcript.transcript(turns(spark, d)).select(
        *KEYS, count_of("part"), count_of("lines"), "text")


@query
def transcript_large_keys(spark, d):
    """Parts of eight lines, over keys that are cut: the plan of very long conversations."""
    rows = valid_messages(spark, d)
    t = Timeline().measured(rows, rows_per_task=SMALL_SEGMENT)
    return transcript.transcript(rows, 8, t).select(
        *KEYS, count_of("part"), count_of("lines"), "text")


@query
def running_transcript(spark, d):
    """Numbered lines: the text as of any message is those up to its number."""
    return transcript.transcript_lines(turns(spark, d)).select(
        *KEYS, "seq", count_of("message_number"), count_of("part"), "line")


@query
def reply_context(spark, d):
    return transcript.reply_context(turns(spark, d)).select(
        *KEYS, count_of("part"), count_of("lines"), "is_last", "context")


@query
def reply_context_long(spark, d):
    """One conversation per tenant, far longer than a part of 100 lines."""
    rows = valid_messages(spark, d).withColumn("conversation_id", F.col("tenant_id"))
    return transcript.reply_context(rows, 100).select(
        *KEYS, count_of("part"), count_of("lines"), "is_last", "context")


# -- personal data -------------------------------------------------------------

@query
def detect_pii(spark, d):
    return pii.detect_pii(valid_messages(spark, d)).select(
        "seq", "has_pii", entity_text(F.col("entities")).alias("entities"), "redacted_text")


@query
def detect_pii_documents(spark, d):
    docs = events.spread(spark.read.parquet(f"{d}/documents.parquet"))
    found = pii.detect_pii(docs, "text")
    return found.select("doc_id", "source", "has_pii",
                        F.size("entities").cast("bigint").alias("entities"),
                        F.length("redacted_text").cast("bigint").alias("redacted_chars"),
                        F.sha2("redacted_text", 256).alias("redacted_sha256"))


@query
def redact_spans(spark, d):
    """Ten spans per document: overlapping, nested, empty, reversed and outside of the text."""
    n = F.length("text")

    def span(i):
        start = (F.col("doc_id") * 7 + i * i * 13) % (n + 20) - 5
        return F.struct(start.alias("start_index"),
                        (start + (F.col("doc_id") + i * 5) % 23 - 2).alias("end_index"))

    docs = events.spread(spark.read.parquet(f"{d}/documents.parquet")).withColumn(
        "spans", F.transform(F.sequence(F.lit(0), F.lit(9)), span))
    return pii.redact_spans(docs, "text", "spans").select(
        "doc_id", F.length("redacted_text").cast("bigint").alias("redacted_chars"),
        F.sha2("redacted_text", 256).alias("redacted_sha256"))


@query
def redact(spark, d):
    return pii.redact(valid_messages(spark, d)).select("seq", "redacted_text")


@query
def pii_counts(spark, d):
    return pii.count_pii(valid_messages(spark, d))


# -- scoring -------------------------------------------------------------------

def keyword_scorer(contexts):
    """A stand-in model: angry about accounts, calm otherwise."""
    out = []
    for text in contexts:
        bad = "account" in text.rsplit("\n", 1)[-1]
        out.append(json.dumps({
            "intent": "Account Issue" if bad else "General Inquiry",
            "urgency": "High" if bad else "Low", "requiresEscalation": bad,
            "estimatedResolutionTime": "1-4 hours"}))
    return out


@query
def score(spark, d):
    contexts = context.insights_context(state.rolling_window(valid_messages(spark, d)))
    out = scoring.score(contexts, keyword_scorer, "insights")
    return out.select(*KEYS, "seq", "error", F.col("insights.intent").alias("intent"),
                      F.col("insights.urgency").alias("urgency"),
                      F.col("insights.requires_escalation").alias("requires_escalation"))


@query
def extension_point(spark, d):
    """A user's own step: messages per sender."""
    def by_sender(df: DataFrame) -> DataFrame:
        return df.groupBy("sender").agg(F.count(F.lit(1)).alias("messages"))

    return scoring.extension_point(valid_messages(spark, d), by_sender)


@query
def record_extension(spark, d):
    """A user's own step per record: as many rows as the number in the tenant's header."""
    def by_header(record, headers):
        tenant = headers["tenant_id"]
        for part in range(int(tenant[1:])):
            yield {"offset": record["offset"], "tenant": tenant, "part": part,
                   "chars": len(record["value"])}

    records = events.decode(events_with_headers(spark, d)).select("offset", "value", "header")
    return scoring.per_record(records, by_header,
                              "offset bigint, tenant string, part bigint, chars bigint")


def numbering_fold(previous, sender, message):
    """A stand-in model: counts the messages and keeps the issue of the first."""
    number = int(previous["tldr"].split()[0]) + 1 if previous else 1
    return {"tldr": f"{number} messages, last from {sender}",
            "customer_issue": previous["customer_issue"] if previous else message,
            "agent_response": message if sender == "agent" else (
                previous["agent_response"] if previous else None),
            "key_points": [sender], "next_steps": []}


@query
def summary_fold(spark, d):
    out = scoring.summary_fold(valid_messages(spark, d), numbering_fold)
    return out.select(*KEYS, "seq", *flat_summary())


@query
def intelligence_job(spark, d):
    """Messages to merged records, with stand-in models; one repeats the summary it was given."""
    def sentiment(contexts):
        return [json.dumps({"sentiment": "neutral", "confidence": 0.5, "emotion": "neutral",
                            "reasoning": text.split("\n", 1)[0]}) for text in contexts]

    out = jobs.intelligence(chat_messages(spark, d),
                            jobs.Scorers(sentiment, keyword_scorer, numbering_fold))
    return out.select(*KEYS, *flat_merged())


# -- streams -------------------------------------------------------------------

def _stream_of(spark, d, sql: str) -> DataFrame:
    path = f"{d}/events.parquet"
    source = (spark.readStream.schema(spark.read.parquet(path).schema)
              .option("maxFilesPerTrigger", "64")
              .option("pathGlobFilter", "events.parquet").parquet(d))
    return A.select_from(spark, source, sql, "events")


def _drained(spark, stream: DataFrame, name: str, mode: str) -> str:
    """Run a stream over what is there; the folder of its output."""
    base = sinks.work_dir(spark, name)
    run = stream_sinks.run(stream, stream_sinks.write_batches(f"{base}/out"), f"{base}/state",
                           mode, once=True)
    run.awaitTermination()
    return f"{base}/out"


@query
def stream_latest_summary(spark, d):
    raw = _stream_of(spark, d, A.RESULTS).filter(F.col("topic") == S.TOPIC_SUMMARY)
    stream = stream_sinks.stream_latest_summary(
        events.declare_stream(raw, S.SUMMARY_STREAM, key="conversation_id"))
    out = _drained(spark, stream, "latest-summary", "update")
    return _flat_view(stream_sinks.read_latest(spark, out, ["conversation_id"]))


@query
def stream_conversation_state(spark, d):
    rows = msg.valid_rows(msg.validate_message(_stream_of(spark, d, A.MESSAGES)))
    out = _drained(spark, stateful.stream_conversation_state(rows), "state", "append")
    return flat_state(stream_sinks.read_batches(spark, out))


@query
def stream_merge_intelligence(spark, d):
    typed = A.typed_results(validate_agent_result(_stream_of(spark, d, A.RESULTS)))
    out = _drained(spark, stateful.stream_merge_intelligence(typed), "merge", "append")
    return flat_changes(stream_sinks.read_batches(spark, out))


def _in_slices(spark, d, name: str, sql: str | None, build, sink, slices: int = 3, mode: str = "append",
               after=None, store: str | None = None) -> str:
    """Run a stream over slices of ``events`` that arrive one after the other, each run going
    on from the checkpoint of the one before; the folder of its output.

    ``build`` gets the rows as ``sql`` has them, without it as they are. ``after`` is called
    with that folder after every slice.
    """
    base = sinks.work_dir(spark, name)
    rows = spark.read.parquet(f"{d}/events.parquet")
    last = (rows.agg(F.max("event_id")).first()[0] or 0) + 1
    number = F.coalesce(F.expr(f"event_id * {slices} div {last}"), F.lit(0))
    for i in range(slices):
        # as files for all cores: a stream reads a file or a split of one per task
        events.spread(rows.where(number == i)).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        stream = build(A.select_from(spark, source, sql, "events") if sql else source)
        stream_sinks.run(stream, sink(f"{base}/out"), f"{base}/state", mode,
                         once=True, store=store).awaitTermination()
        if after:
            after(f"{base}/out")
    return f"{base}/out"


def _typed(raw: DataFrame) -> DataFrame:
    return A.typed_results(validate_agent_result(raw))


@query
def stream_summary_fold(spark, d):
    def build(messages):
        rows = msg.valid_rows(msg.validate_message(messages))
        return stateful.stream_summary_fold(rows, numbering_fold)

    out = _in_slices(spark, d, "fold", A.MESSAGES, build, stream_sinks.write_batches)
    return stream_sinks.read_batches(spark, out).select(*KEYS, "seq", *flat_summary())


@query
def stream_dead_letter(spark, d):
    out = _in_slices(spark, d, "dead", A.RESULTS, validate_agent_result,
                     lambda path: stream_sinks.write_split(f"{path}-valid", path))
    header = F.transform("headers", lambda h: F.concat(
        h["key"], F.lit("="), h["value"].cast("string")))
    return stream_sinks.read_batches(spark, out).select(
        "original_topic", "original_partition", "original_offset", "key", "value", "error",
        "error_type", texts(header).alias("headers"))


@query
def stream_change_feed(spark, d):
    def build(raw):
        return stateful.stream_merge_intelligence(A.typed_results(validate_agent_result(raw)))

    out = _in_slices(spark, d, "feed", A.RESULTS, build, stream_sinks.change_feed_sink)
    envelope = ("type string, tenant_id string, conversation_id string, data struct<"
                "sentiment: struct<sentiment: string>, summary: struct<tldr: string>, "
                "last_updated: timestamp_ntz>")
    feed = spark.read.schema(envelope).options(**sinks.JSON_OPTIONS).json(out)
    return feed.select("type", *KEYS, F.col("data.sentiment.sentiment").alias("sentiment"),
                       F.col("data.summary.tldr").alias("tldr"),
                       F.col("data.last_updated").alias("last_updated"))


@query
def stream_expiring_state(spark, d):
    """State rows of conversations that start afresh after twelve idle hours."""
    def build(messages):
        rows = msg.valid_rows(msg.validate_message(messages))
        return keyed.stream_expiring_state(rows, dt.timedelta(hours=12))

    out = _in_slices(spark, d, "expiring", A.MESSAGES, build, stream_sinks.write_batches,
                     store=keyed.STORE)
    return flat_state(stream_sinks.read_batches(spark, out))


@query
def stream_state_with_summary(spark, d):
    """Messages and summaries as two inputs of one state; they meet at equal positions."""
    def build(source):
        rows = msg.valid_rows(msg.validate_message(A.select_from(spark, source, A.MESSAGES, "events")))
        found = _typed(A.select_from(spark, source, A.RESULTS, "events"))
        return stateful.stream_conversation_state(rows, found.filter("kind = 'summary'"))

    out = stream_sinks.read_batches(spark, _in_slices(spark, d, "state-summary", None, build,
                                                      stream_sinks.write_batches))
    return out.select(*KEYS, "seq", "ts", count_of("message_count"),
                      texts(F.col("participants")).alias("participants"),
                      message_texts(F.col("recent_messages")).alias("recent"), *flat_summary())


@query
def stream_entities(spark, d):
    out = _in_slices(spark, d, "entities", A.RESULTS,
                     lambda raw: keyed.stream_entities(_typed(raw)), stream_sinks.write_batches,
                     store=keyed.STORE)
    return stream_sinks.read_batches(spark, out).select(
        *KEYS, F.col("seq").alias("since_seq"), "place", "type", "value", "start_index")


@query
def stream_merge_parts(spark, d):
    """The merged records from two running aggregates."""
    folders = [_in_slices(spark, d, name, A.RESULTS,
                          lambda raw, i=i: stream_sinks.stream_merge_parts(_typed(raw))[i],
                          stream_sinks.write_batches, mode="update")
               for i, name in enumerate(("totals", "seen"))]
    return stream_sinks.read_merged(spark, *folders).select(*KEYS, *flat_merged(), "last_updated")


@query
def stream_updates(spark, d):
    """A change log as files, and a second stream that passes on what is new in it."""
    base = sinks.work_dir(spark, "updates")

    def passed_on(log):
        records = stream_sinks.read_batches(spark, log)
        source = spark.readStream.schema(records.schema).parquet(log)
        stream_sinks.run(keyed.stream_updates(source), stream_sinks.write_batches(f"{base}/out"),
                         f"{base}/state", once=True, store=keyed.STORE).awaitTermination()

    _in_slices(spark, d, "log", A.RESULTS,
               lambda raw: stateful.stream_merge_intelligence(_typed(raw)),
               stream_sinks.write_batches, after=passed_on)
    sent = stream_sinks.read_batches(spark, f"{base}/out")
    data = F.from_json("value", "type string, data struct<sentiment: struct<reasoning: string>, "
                                "summary: struct<tldr: string>>")
    return sent.select(*KEYS, "seq", data["type"].alias("type"),
                       data["data"]["sentiment"]["reasoning"].alias("reasoning"),
                       data["data"]["summary"]["tldr"].alias("tldr"))


@query
def stream_retention(spark, d):
    """Rows kept for 24 hours of their topic's time, and those that came too late."""
    day, base = 86_400, sinks.work_dir(spark, "retention")
    _in_slices(spark, d, "topic", A.LATE_RESULTS, lambda raw: raw.select("topic", "seq", "ts"),
               lambda _: stream_sinks.write_retained(f"{base}/kept", f"{base}/expired",
                                                     f"{base}/marks", day))
    kept = stream_sinks.read_retained(spark, f"{base}/kept", f"{base}/marks", day)
    late = stream_sinks.read_batches(spark, f"{base}/expired")
    return kept.select("topic", "seq", "ts", F.lit("kept").alias("place")).unionByName(
        late.select("topic", "seq", "ts", F.lit("expired").alias("place")))


@query
def stream_unanswered(spark, d):
    """Customer messages that nobody answered within twelve hours."""
    def build(messages):
        rows = msg.valid_rows(msg.validate_message(messages))
        return keyed.stream_unanswered(rows, dt.timedelta(hours=12))

    out = _in_slices(spark, d, "unanswered", A.MESSAGES, build, stream_sinks.write_batches,
                     store=keyed.STORE)
    return stream_sinks.read_batches(spark, out).select(*KEYS, "ts", "seq", "due")
