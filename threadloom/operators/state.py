"""Conversation state: rolling window, counts, participants, summary as of a message."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators import timeline as tl
from threadloom.operators.timeline import LastN, Timeline, latest, measured_once
from threadloom.schema import KEYS, SENDERS, SUMMARY, WINDOW_MESSAGE, WINDOW_MESSAGES


def window_message(df: DataFrame) -> Column:
    """The message of a row as an element of the rolling window."""
    values = []
    for f in WINDOW_MESSAGE.fields:
        source = "ts" if f.name == "timestamp" else f.name
        value = F.col(source) if source in df.columns else F.lit(None)
        values.append(value.cast(f.dataType).alias(f.name))
    return F.struct(*values)


def _participants(positions: dict[str, Column]) -> Column:
    """Senders seen so far, in the order they first spoke."""
    seen = F.filter(
        F.array(*[F.struct(p.alias("at"), F.lit(s).alias("sender"))
                  for s, p in positions.items()]),
        lambda e: e["at"].isNotNull())
    return F.transform(F.array_sort(seen), lambda e: e["sender"])


def conversation_state(messages: DataFrame, timeline: Timeline | None = None) -> DataFrame:
    """One state row per message: what is known of its conversation at that point."""
    t = timeline or Timeline().measured(messages)
    return state_rows(messages, t, {}).drop("_summary")


def state_rows(rows: DataFrame, t: Timeline, more: dict[str, tl.Scan],
               is_message: Column | None = None) -> DataFrame:
    """State columns for every row; rows that are no messages do not count."""
    real = F.lit(True) if is_message is None else is_message
    at = F.when(real, F.col(t.ts))
    scans: dict = {
        "message_count": tl.count(real),
        "created_at": tl.first(at),
        "last_activity": tl.last(at),
        **{f"_first_{s}": tl.first_position(real & (F.col("sender") == s)) for s in SENDERS},
        **more,
    }
    if is_message is None:
        scans["recent_messages"] = LastN(window_message(rows), WINDOW_MESSAGES)
    out = t.running(rows, scans)
    return (out.withColumn("participants",
                           _participants({s: F.col(f"_first_{s}") for s in SENDERS}))
            .withColumn("updated_at", F.col("last_activity"))
            .drop(*[f"_first_{s}" for s in SENDERS]))


def attach_summary_asof(messages: DataFrame, summaries: DataFrame,
                        timeline: Timeline | None = None) -> DataFrame:
    """Each message with the newest summary received before it.

    Both inputs carry the keys, ``ts`` and ``seq``; ``summaries`` has a struct
    column ``summary``. At an equal position the message comes first. A summary before the first message of its conversation is
    dropped: there is no state yet that could hold it. One union and one pass,
    no join of the two sides.
    """
    t, rows = measured_once(_with_summaries(messages, summaries), timeline)
    return _attached(rows, messages.columns, t)


def _attached(rows: DataFrame, columns: list[str], t: Timeline) -> DataFrame:
    """The messages of ``_with_summaries`` with the summary as of each."""
    t = replace(t, seq=(*t.seq, "_late"))
    first_message = tl.first_position(F.col("_message"))
    # A summary counts only if a message came earlier; that needs the position
    # of the first message, so both are carried and compared at the end.
    stamped = F.when(F.col("_summary").isNotNull(),
                     F.struct(t.order.alias("at"), F.col("_summary").alias("summary")))
    out = t.running(rows, {"_stamped": tl.last(stamped), "_opened": first_message})
    kept = F.when(F.col("_stamped.at") > F.col("_opened"), F.col("_stamped.summary"))
    return (out.filter(F.col("_message"))
            .withColumn("summary", kept)
            .select(*columns, "summary"))


def conversation_state_with_summary(messages: DataFrame, summaries: DataFrame,
                                    timeline: Timeline | None = None) -> DataFrame:
    """State rows that also carry the summary as of their message.

    The summaries ride along in the same shuffle; the window of the last ten
    messages then reuses its partitioning.
    """
    t, rows = measured_once(_with_summaries(messages, summaries), timeline)
    return state_rows(_attached(rows, messages.columns, t), t, {})


def _with_summaries(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    m = messages.withColumn("_message", F.lit(True)).withColumn("_late", F.lit(0)).withColumn(
        "_summary", F.lit(None).cast(SUMMARY))
    s = summaries.select(*KEYS, "ts", "seq", F.lit(False).alias("_message"),
                         F.lit(1).alias("_late"),
                         F.col("summary").cast(SUMMARY).alias("_summary"))
    return m.unionByName(s, allowMissingColumns=True)


def conversation_final(messages: DataFrame) -> DataFrame:
    """The last state of every conversation.

    A partial aggregate per map task instead of a window: no key is gathered in
    one task. The ten newest messages come from the rank filter, which also cuts
    before the shuffle.
    """
    order = F.struct("ts", "seq")
    positions = {s: F.min(F.when(F.col("sender") == s, order)).alias(f"_first_{s}")
                 for s in SENDERS}
    totals = messages.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("message_count"), F.min("ts").alias("created_at"),
        F.max("ts").alias("last_activity"), *positions.values())
    element = F.struct(order.alias("o"), window_message(messages).alias("m"))
    recent = (tail_n(messages, WINDOW_MESSAGES)
              .groupBy(*KEYS).agg(F.collect_list(element).alias("recent")))
    ordered = F.transform(F.array_sort(F.col("recent"), tl._by_order), lambda e: e["m"])
    return (totals.join(recent, list(KEYS))
            .withColumn("recent_messages", ordered)
            .withColumn("participants",
                        _participants({s: F.col(f"_first_{s}") for s in SENDERS}))
            .withColumn("updated_at", F.col("last_activity"))
            .drop("recent", *[f"_first_{s}" for s in SENDERS]))


def tail_n(messages: DataFrame, n: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The last ``n`` messages of every conversation."""
    return latest(messages, keys, ("ts", "seq"), n)


def rolling_window(messages: DataFrame, n: int = WINDOW_MESSAGES,
                   timeline: Timeline | None = None) -> DataFrame:
    """Each message with the last ``n`` of its conversation, itself included."""
    t = timeline or Timeline().measured(messages)
    return t.running(messages, {"recent_messages": LastN(window_message(messages), n)})


def message_ordinal(messages: DataFrame, timeline: Timeline | None = None) -> DataFrame:
    """Number of each message within its conversation, from 1."""
    t = timeline or Timeline().measured(messages)
    return t.running(messages, {"message_number": tl.count()})


def latest_message(states: DataFrame) -> DataFrame:
    """The newest message of a state row."""
    return states.withColumn("latest", F.try_element_at(F.col("recent_messages"), F.lit(-1)))


def sentiment_trigger(states: DataFrame) -> DataFrame:
    """States to score for sentiment: those whose newest message is the customer's."""
    newest = F.try_element_at(F.col("recent_messages"), F.lit(-1))
    return states.filter(newest["sender"] == "customer")


def state_record(states: DataFrame) -> DataFrame:
    """State rows in the shape of the state topic: keys repeated in each message."""
    full = F.transform("recent_messages", lambda m: F.struct(
        m["message_id"].alias("message_id"), F.col("conversation_id"), F.col("tenant_id"),
        m["sender"].alias("sender"), m["message"].alias("message"),
        m["channel"].alias("channel"), m["timestamp"].alias("timestamp"),
        m["metadata"].alias("metadata")))
    summary = F.col("summary") if "summary" in states.columns else F.lit(None).cast(SUMMARY)
    return states.select("conversation_id", "tenant_id", "message_count", "last_activity",
                         full.alias("recent_messages"), "participants",
                         summary.alias("summary"), "created_at", "updated_at")
