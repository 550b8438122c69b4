"""Steps with state per key: user processors, expiry, entity state by element, change dedupe.

All of them are ``StatefulProcessor`` classes over ``transformWithStateInPandas``. Rows of a key
are applied in (ts, seq) order within a micro-batch, later micro-batches after earlier ones; a
row that is older than the watermark is dropped by Spark. State is typed per variable and only
what a row changes is written. Several variables need a store with column families: start these
streams with ``sinks.run(..., store=STORE)``, whatever the session's is.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from threadloom.operators.merge import completeness
from threadloom.operators.state import window_message
from threadloom.schema import KEYS, KINDS, LONG, TEXT, TIME, WINDOW_MESSAGE, WINDOW_MESSAGES, record
from threadloom.session import ROCKSDB as STORE
from threadloom.sources.sinks import JSON_OPTIONS
from threadloom.streaming.stateful import JSON_TIMES, STATE_OUT

ORDER = ("ts", "seq")
CLOCK = "_event_time"


def process_keyed(rows: DataFrame, processor: StatefulProcessor, output: T.StructType | str,
                  keys: Sequence[str] = KEYS, event_time: str | None = None,
                  delay: str = "0 seconds", mode: str = "append") -> DataFrame:
    """A user's processor with state variables and timers of its own, per key of a stream.

    ``processor`` opens its variables in ``init`` and gets the rows of one key and micro-batch
    as pandas frames. With ``event_time`` (a timestamp column) its timers are times of that
    column, and fire once the watermark, ``delay`` behind the newest row, has passed them.
    """
    if event_time:
        zoned = F.col(event_time).cast("timestamp")
        rows = rows.withColumn(CLOCK, zoned).withWatermark(CLOCK, delay)
    return rows.groupBy(*keys).transformWithStateInPandas(
        processor, output, mode, "eventTime" if event_time else "none")


class Step(StatefulProcessor):
    """A processor that takes one row after the other, in order of time and sequence.

    Subclasses say what they emit for a row (``row``) and, if they set timers, for a time that
    has passed (``passed``): tuples in the order of ``columns``.
    """

    columns: Sequence[str] = ()

    def init(self, handle) -> None:
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(list(ORDER), kind="stable")
        self.start(key)
        out = [o for r in frame.itertuples(index=False) for o in self.row(key, r)]
        self.end(key)
        yield pd.DataFrame(out, columns=list(self.columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(list(self.passed(key, expiredTimerInfo.getExpiryTimeInMs())),
                           columns=list(self.columns))

    def start(self, key) -> None:
        """Before the rows of a micro-batch."""

    def end(self, key) -> None:
        """After the rows of a micro-batch."""

    def row(self, key, row) -> Iterator[tuple]:
        raise NotImplementedError

    def passed(self, key, at: int) -> Iterator[tuple]:
        return iter(())

    def close(self) -> None:
        pass

    def only_timer(self, at: int | None) -> None:
        """The key's one timer: at ``at``, or none."""
        kept = False
        for old in list(self.handle.listTimers()):
            if old == at:
                kept = True
            else:
                self.handle.deleteTimer(old)
        if at is not None and not kept:
            self.handle.registerTimer(at)


def millis(time: dt.datetime) -> int:
    """Milliseconds since 1970 of a time without zone, taken as UTC."""
    return pd.Timestamp(time).value // 1_000_000


# -- conversation state that expires -------------------------------------------

class ExpiringState(Step):
    """Rolling conversation state that starts afresh after ``idle`` without a message."""

    columns = STATE_OUT.fieldNames()

    def __init__(self, idle: dt.timedelta):
        self.idle = idle

    def init(self, handle) -> None:
        super().init(handle)
        self.facts = handle.getValueState(
            "facts", "message_count bigint, created_at timestamp_ntz, last_activity timestamp_ntz, "
                     "participants array<string>")
        self.recent = handle.getListState("recent", "message string")

    def start(self, key) -> None:
        count, created, active, who = self.facts.get() if self.facts.exists() else (0, None, None, [])
        self.now = [count, created, active, list(who)]
        self.window = [m for (m,) in self.recent.get()] if count else []

    def row(self, key, row) -> Iterator[tuple]:
        time = row.ts.to_pydatetime()
        count, created, active, who = self.now
        if active is not None and time - active > self.idle:
            count, created, who, self.window = 0, None, [], []
        if row.sender not in who:
            who = [*who, row.sender]
        self.window = [*self.window, row.message][-WINDOW_MESSAGES:]
        self.now = [count + 1, created or time, time, who]
        yield (*key, row.ts, row.seq, count + 1, created or time, time, list(who),
               list(self.window), None)

    def end(self, key) -> None:
        self.facts.update(tuple(self.now))
        self.recent.put([(m,) for m in self.window])
        self.only_timer(millis(self.now[2] + self.idle))

    def passed(self, key, at: int) -> Iterator[tuple]:
        # whatever comes now is later than the idle time, so nothing of this is needed
        self.facts.clear()
        self.recent.clear()
        return iter(())


def stream_expiring_state(messages: DataFrame, idle: dt.timedelta,
                          delay: str = "0 seconds") -> DataFrame:
    """State rows, one per message; a conversation idle for longer than ``idle`` starts afresh.

    Its old state leaves the store as soon as the watermark has passed the idle time, so the
    store holds active conversations only. A gap in event time cuts, whether or not the state
    was already gone when the next row came; so replays give the same rows.
    """
    rows = messages.select(*KEYS, "ts", F.col("seq").cast("bigint").alias("seq"), "sender",
                           F.to_json(window_message(messages), JSON_TIMES).alias("message"))
    out = process_keyed(rows, ExpiringState(idle), STATE_OUT, event_time="ts", delay=delay)
    return (out.withColumn("recent_messages", F.transform(
                "recent", lambda m: F.from_json(m, WINDOW_MESSAGE, JSON_TIMES)))
            .withColumn("updated_at", F.col("last_activity")).drop("recent", "summary"))


# -- entities by element -------------------------------------------------------

ENTITY_ROW = T.StructType([*record(tenant_id=TEXT, conversation_id=TEXT, ts=TIME, seq=LONG,
                                   place=LONG, type=TEXT, value=TEXT, start_index=LONG,
                                   end_index=LONG).fields])


class EntityRows(Step):
    """Entities as they become part of a conversation's list.

    The position of the first result is one variable, every (type, value) seen is an entry of
    a map: a row reads and writes its own entry, however many there are.
    """

    columns = ENTITY_ROW.fieldNames()

    def init(self, handle) -> None:
        super().init(handle)
        self.opened = handle.getValueState("opened", "ts timestamp_ntz, seq bigint")
        self.seen = handle.getMapState("seen", "type string, value string", "ts timestamp_ntz")

    def start(self, key) -> None:
        self.first = tuple(self.opened.get()) if self.opened.exists() else None

    def row(self, key, row) -> Iterator[tuple]:
        position = (row.ts.to_pydatetime(), int(row.seq))
        if self.first is None:
            self.first = position
            self.opened.update(position)
        if row.type is None:
            return
        mark = (row.type, row.value)
        known = self.seen.containsKey(mark)
        if not known:
            self.seen.updateValue(mark, (position[0],))
        if not known or position == self.first:
            yield (*key, row.ts, row.seq, row.place, row.type, row.value, row.start_index,
                   row.end_index)


def stream_entities(results: DataFrame) -> DataFrame:
    """Entities of every conversation as rows: the streaming twin of ``pii_entity_merge``.

    All entities of a conversation's first PII result, and of later ones those whose
    (type, value) is new, in the order (ts, seq, place) in which they came.
    """
    entity = F.col("entity")
    rows = (results.filter(F.col("pii").isNotNull())
            .select(*KEYS, "ts", F.col("seq").cast("bigint").alias("seq"),
                    F.posexplode_outer("pii.entities").alias("place", "entity"))
            .select(*KEYS, *ORDER, F.col("place").cast("bigint").alias("place"),
                    entity["type"].alias("type"), entity["value"].alias("value"),
                    *[entity[n].cast("bigint").alias(n) for n in ("start_index", "end_index")]))
    return process_keyed(rows, EntityRows(), ENTITY_ROW)


# -- emission without repeats --------------------------------------------------

class Changes(Step):
    """Passes a record on if its content differs from that of the record passed on before."""

    columns = ("tenant_id", "conversation_id", "ts", "seq", "value")

    def init(self, handle) -> None:
        super().init(handle)
        self.sent = handle.getValueState("sent", "digest string")

    def start(self, key) -> None:
        self.last = self.before = self.sent.get()[0] if self.sent.exists() else None

    def row(self, key, row) -> Iterator[tuple]:
        if row.digest != self.last:
            self.last = row.digest
            yield (*key, row.ts, row.seq, row.value)

    def end(self, key) -> None:
        if self.last != self.before:
            self.sent.update((self.last,))


def stream_updates(merged: DataFrame, content: Callable[[], Column] | None = None) -> DataFrame:
    """Complete merged records as update envelopes, each only if it says something new.

    ``content`` is what is compared, the four parts of the record without their times if not
    given; its hash is all that is kept per conversation. A new time alone is no news.
    """
    envelope = F.struct(F.lit("intelligence_update").alias("type"), *KEYS, F.struct(
        *KEYS, *KINDS, "last_updated").alias("data"))
    compared = content() if content else F.struct(
        *[F.col(k).dropFields("timestamp").alias(k) for k in KINDS])
    rows = completeness(merged).filter("complete").select(
        *KEYS, "ts", F.col("seq").cast("bigint").alias("seq"),
        F.to_json(envelope, JSON_OPTIONS).alias("value"),
        F.sha2(F.to_json(compared, JSON_OPTIONS), 256).alias("digest"))
    return process_keyed(rows, Changes(), record(tenant_id=TEXT, conversation_id=TEXT, ts=TIME,
                                                 seq=LONG, value=TEXT))


# -- a step with timers --------------------------------------------------------

class Unanswered(Step):
    """Customer messages that no agent answered within ``limit``.

    A customer message waits until the next message of a customer or an agent. The row comes
    when the watermark passes the limit, or with that next message if it was too late.
    """

    columns = ("tenant_id", "conversation_id", "ts", "seq", "due")

    def __init__(self, limit: dt.timedelta):
        self.limit = limit

    def init(self, handle) -> None:
        super().init(handle)
        self.waiting = handle.getValueState("waiting", "ts timestamp_ntz, seq bigint")

    def start(self, key) -> None:
        self.open = tuple(self.waiting.get()) if self.waiting.exists() else None

    def row(self, key, row) -> Iterator[tuple]:
        if row.sender not in ("customer", "agent"):
            return
        time = row.ts.to_pydatetime()
        if self.open and time > self.open[0] + self.limit:
            yield (*key, *self.open, self.open[0] + self.limit)
        self.open = (time, int(row.seq)) if row.sender == "customer" else None

    def end(self, key) -> None:
        if self.open:
            self.waiting.update(self.open)
            self.only_timer(millis(self.open[0] + self.limit) + 1)
        else:
            self.waiting.clear()
            self.only_timer(None)

    def passed(self, key, at: int) -> Iterator[tuple]:
        if self.waiting.exists():
            time, seq = self.waiting.get()
            self.waiting.clear()
            yield (*key, time, seq, time + self.limit)


def stream_unanswered(messages: DataFrame, limit: dt.timedelta,
                      delay: str = "0 seconds") -> DataFrame:
    """Customer messages without an answer in time: a processor with a timer per key."""
    rows = messages.select(*KEYS, "ts", F.col("seq").cast("bigint").alias("seq"), "sender")
    return process_keyed(rows, Unanswered(limit), record(
        tenant_id=TEXT, conversation_id=TEXT, ts=TIME, seq=LONG, due=TIME), event_time="ts",
        delay=delay)
