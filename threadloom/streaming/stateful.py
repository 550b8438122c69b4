"""Per-key stream operators that emit a row per input row.

Both keep a small, fixed-size state per conversation in the state store and see
the rows of one key and micro-batch at a time; limit the micro-batch with
``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger``. Rows of a micro-batch are
applied in (ts, seq) order, later micro-batches after earlier ones. Payloads
travel as JSON texts and are typed again by built-in functions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom.operators.state import window_message
from threadloom.schema import (INSIGHTS, KEYS, PII, SENTIMENT, SUMMARY, TEXTS, WINDOW_MESSAGE,
                               WINDOW_MESSAGES, record)
from threadloom.schema import ENTITY, FLAG, LONG, TEXT, TIME

NO_TIMEOUT = GroupStateTimeout.NoTimeout
# Times inside the JSON texts, to the microsecond.
JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _json(value: Column) -> Column:
    return F.to_json(value, JSON_TIMES)


# Rows of one output frame: a key's rows leave in frames, not all at once.
FRAME_ROWS = 1_000


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of at most ``FRAME_ROWS``; at least one, if empty."""
    frame = list(islice(rows, FRAME_ROWS))
    yield pd.DataFrame(frame, columns=columns)
    while frame := list(islice(rows, FRAME_ROWS)):
        yield pd.DataFrame(frame, columns=columns)


def _ordered(batches: Iterator[pd.DataFrame], *then: str) -> pd.DataFrame:
    rows = pd.concat(list(batches), ignore_index=True)
    return rows.sort_values(["ts", "seq", *then], kind="stable")


STATE = record(message_count=LONG, created_at=TIME, last_activity=TIME, participants=TEXTS,
               recent=TEXTS, summary=TEXT)
STATE_OUT = record(tenant_id=TEXT, conversation_id=TEXT, ts=TIME, seq=LONG, message_count=LONG,
                   created_at=TIME, last_activity=TIME, participants=TEXTS, recent=TEXTS,
                   summary=TEXT)


def _advance_state(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
    yield from _frames(_state_rows(key, batches, state), STATE_OUT.fieldNames())


def _state_rows(key, batches, state: GroupState) -> Iterator[tuple]:
    count, created, active, who, recent, summary = (
        state.get if state.exists else (0, None, None, [], [], None))
    who, recent = list(who or []), list(recent or [])
    for row in _ordered(batches, "late").itertuples(index=False):
        if row.late:
            # A summary changes the state only once there is one, and emits nothing.
            summary = row.summary if count else summary
            continue
        count, active, created = count + 1, row.ts, created or row.ts
        recent = [*recent, row.message][-WINDOW_MESSAGES:]
        if row.sender not in who:
            who.append(row.sender)
        yield (*key, row.ts, row.seq, count, created, active, list(who), recent, summary)
    state.update((count, created, active, who, recent, summary))


def stream_conversation_state(messages: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """State rows, one per message, with the newest summary received before it.

    At an equal position the message comes first, as in the batch operator.
    """
    rows = messages.select(*KEYS, "ts", F.col("seq").cast("bigint").alias("seq"), "sender",
                           _json(window_message(messages)).alias("message"),
                           F.lit(None).cast("string").alias("summary"),
                           F.lit(False).alias("late"))
    if summaries is not None:
        rows = rows.unionByName(summaries.select(
            *KEYS, "ts", F.col("seq").cast("bigint").alias("seq"),
            F.lit(None).cast("string").alias("sender"),
            F.lit(None).cast("string").alias("message"), _json(F.col("summary")).alias("summary"),
            F.lit(True).alias("late")))
    out = rows.groupBy(*KEYS).applyInPandasWithState(
        _advance_state, STATE_OUT, STATE, "append", NO_TIMEOUT)
    return (out
            .withColumn("recent_messages", F.transform(
                "recent", lambda m: F.from_json(m, WINDOW_MESSAGE, JSON_TIMES)))
            .withColumn("summary", F.from_json("summary", SUMMARY, JSON_TIMES))
            .withColumn("updated_at", F.col("last_activity")).drop("recent"))


MERGED = record(sentiment=TEXT, insights=TEXT, summary=TEXT, pii=TEXT, has_pii=FLAG,
                entities=TEXTS, seen=TEXTS)
MERGED_OUT = record(tenant_id=TEXT, conversation_id=TEXT, ts=TIME, seq=LONG, kind=TEXT,
                    sentiment=TEXT, insights=TEXT, summary=TEXT, pii=TEXT, has_pii=FLAG,
                    entities=TEXTS)


def _advance_merge(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
    yield from _frames(_merged_rows(key, batches, state), MERGED_OUT.fieldNames())


def _merged_rows(key, batches, state: GroupState) -> Iterator[tuple]:
    now = dict(zip(MERGED.fieldNames(), state.get)) if state.exists else dict.fromkeys(
        MERGED.fieldNames())
    entities, seen = list(now["entities"] or []), set(now["seen"] or [])
    for row in _ordered(batches).itertuples(index=False):
        if row.kind in ("sentiment", "insights", "summary"):
            now[row.kind] = row.payload
        elif row.kind == "pii":
            opening = now["pii"] is None
            now["pii"], now["has_pii"] = row.payload, bool(now["has_pii"]) or bool(row.has_pii)
            for mark, text in zip(row.marks, row.entities):
                if opening or mark not in seen:
                    entities.append(text)
                seen.add(mark)
        yield (*key, row.ts, row.seq, row.kind, now["sentiment"], now["insights"],
               now["summary"], now["pii"], now["has_pii"], list(entities))
    state.update((now["sentiment"], now["insights"], now["summary"], now["pii"], now["has_pii"],
                  entities, sorted(seen)))


def stream_merge_intelligence(results: DataFrame) -> DataFrame:
    """Change log of merged records, one per result, like the batch operator."""
    head, none = F.struct("pii.redacted_text", "pii.timestamp"), F.array().cast("array<string>")
    rows = results.select(
        *KEYS, "ts", F.col("seq").cast("bigint").alias("seq"), "kind",
        F.coalesce(_json(F.col("sentiment")), _json(F.col("insights")),
                   _json(F.col("summary")),
                   F.when(F.col("kind") == "pii", _json(head))).alias("payload"),
        F.col("pii.has_pii").alias("has_pii"),
        F.coalesce(F.transform("pii.entities", lambda e: F.to_json(e)), none).alias("entities"),
        F.coalesce(F.transform("pii.entities", lambda e: F.to_json(F.struct(e["type"], e["value"]))),
                   none).alias("marks"))
    out = rows.groupBy(*KEYS).applyInPandasWithState(
        _advance_merge, MERGED_OUT, MERGED, "append", NO_TIMEOUT)
    head_type = record(redacted_text=TEXT, timestamp=TIME)
    typed_head = F.from_json("pii", head_type, JSON_TIMES)
    entities = F.transform("entities", lambda e: F.from_json(e, ENTITY))
    pii = F.when(F.col("pii").isNotNull(), F.struct(
        F.col("has_pii"), entities.alias("entities"), typed_head["redacted_text"]
        .alias("redacted_text"), typed_head["timestamp"].alias("timestamp")).cast(PII))
    return out.select(
        *KEYS, "ts", "seq", "kind",
        F.from_json("sentiment", SENTIMENT, JSON_TIMES).alias("sentiment"), pii.alias("pii"),
        F.from_json("insights", INSIGHTS, JSON_TIMES).alias("insights"),
        F.from_json("summary", SUMMARY, JSON_TIMES).alias("summary"),
        F.col("ts").alias("last_updated"))


FOLD_IN = record(tenant_id=TEXT, conversation_id=TEXT, ts=TIME, seq=LONG, sender=TEXT,
                 message=TEXT)
FOLD_OUT = record(tenant_id=TEXT, conversation_id=TEXT, ts=TIME, seq=LONG, answer=TEXT)
FOLD_STATE = record(summary=TEXT)


def stream_summary_fold(messages: DataFrame, fold) -> DataFrame:
    """Streaming twin of ``summary_fold``: the state is the current summary."""

    def folded(key, batches, state: GroupState) -> Iterator[tuple]:
        summary = json.loads(state.get[0]) if state.exists else None
        for row in _ordered(batches).itertuples(index=False):
            summary = fold(summary, row.sender, row.message)
            yield (*key, row.ts, row.seq, json.dumps(summary))
        state.update((json.dumps(summary),))

    def advance(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _frames(folded(key, batches, state), FOLD_OUT.fieldNames())

    rows = messages.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FOLD_IN.fields])
    out = rows.groupBy(*KEYS).applyInPandasWithState(
        advance, FOLD_OUT, FOLD_STATE, "append", NO_TIMEOUT)
    return out.select(*KEYS, "ts", "seq", F.from_json("answer", SUMMARY)
                      .withField("timestamp", F.col("ts")).alias("summary"))
