"""Steps with state per key: what they write, what stays in the store, replays in slices."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF, START, at, messages
from test_catalog import plain
from threadloom.operators import merge
from threadloom.operators.state import conversation_state
from threadloom.plans import catalog
from threadloom.plans.catalog import QUERIES
from threadloom.plans.oracles import ORACLES
from threadloom.schema import KINDS, PAYLOADS
from threadloom.session import ROCKSDB, STATE_STORE
from threadloom.streaming import keyed, sinks, stateful

KEY = ("t", "c")


class Variable:
    """A state variable that counts what is written to it."""

    def __init__(self):
        self.value, self.writes = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    put = update

    def clear(self):
        self.value = None


class Entries(dict):
    writes = 0

    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self[key] = value
        self.writes += 1


class Handle:
    def __init__(self):
        self.variables, self.timers = {}, set()

    def _open(self, name, made):
        return self.variables.setdefault(name, made)

    def getValueState(self, name, schema, ttlDurationMs=None):
        return self._open(name, Variable())

    def getListState(self, name, schema, ttlDurationMs=None):
        return self._open(name, Variable())

    def getMapState(self, name, key, value, ttlDurationMs=None):
        return self._open(name, Entries())

    def registerTimer(self, time):
        self.timers.add(time)

    def deleteTimer(self, time):
        self.timers.remove(time)

    def listTimers(self):
        return iter(self.timers)


def feed(step, rows, columns):
    frame = pd.DataFrame(rows, columns=columns)
    return pd.concat(list(step.handleInputRows(KEY, iter([frame]), None)))


def test_an_entity_writes_its_own_entry_only():
    step, handle = keyed.EntityRows(), Handle()
    step.init(handle)
    columns = ["ts", "seq", "place", "type", "value", "start_index", "end_index"]
    time = pd.Timestamp(START)
    per_row = []
    for i in range(10_000):
        before = sum(v.writes for v in handle.variables.values())
        out = feed(step, [(time, i, 0, "name", f"v{i}", 0, 1)], columns)
        assert len(out) == 1
        per_row.append(sum(v.writes for v in handle.variables.values()) - before)
    assert per_row[0] == 2 and set(per_row[1:]) == {1}
    assert feed(step, [(time, 20_000, 0, "name", "v7", 0, 1)], columns).empty
    assert len(handle.variables["seen"]) == 10_000


def test_a_known_digest_writes_nothing():
    step, handle = keyed.Changes(), Handle()
    step.init(handle)
    columns = ["ts", "seq", "digest", "value"]
    time = pd.Timestamp(START)
    assert len(feed(step, [(time, 2, "b", "2"), (time, 1, "a", "1"), (time, 3, "b", "3")], columns)) == 2
    assert feed(step, [(time, 4, "b", "4")], columns).empty
    assert handle.variables["sent"].writes == 1
    assert len(feed(step, [(time, 5, "a", "5")], columns)) == 1


def _slices(spark, df, path, cuts):
    """``df`` in files that arrive one after the other; a function that adds the next."""
    edges = [-1, *cuts, 10 ** 9]
    for low, high in zip(edges, edges[1:]):
        df.filter((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.mode(
            "append").parquet(f"{path}/in")
        yield spark.readStream.schema(df.schema).parquet(f"{path}/in")


def _replay(spark, df, path, build, cuts):
    progress = []
    for source in _slices(spark, df, path, cuts):
        run = sinks.run(build(source), sinks.write_batches(f"{path}/out"), f"{path}/state",
                        once=True)
        run.awaitTermination()
        progress += run.recentProgress
    return sinks.read_batches(spark, f"{path}/out"), progress


def _rows(seed):
    """Conversations with pauses, some of which are never heard of again."""
    rng, rows, now = random.Random(seed), [], 0.0
    for i in range(240):
        now += rng.choice([1, 5, 60, 400])
        talk = f"c{rng.randint(0, 5) + 6 * (i // 80)}"
        rows.append(("t", talk, now, i, rng.choice(["customer", "agent", "system"]), f"m{i}"))
    return rows


@pytest.mark.parametrize("cuts", [[], [100], [60, 61, 200]])
def test_expired_state_starts_afresh_and_leaves_the_store(spark, tmp_path, cuts):
    idle, rows = 900, _rows(4)
    df = messages(spark, rows)
    out, progress = _replay(spark, df, str(tmp_path), lambda s: keyed.stream_expiring_state(
        s, dt.timedelta(seconds=idle)), cuts)
    last, part, cut = {}, {}, []
    for t, c, s, i, who, text in rows:
        part[c] = part.get(c, 0) + (c in last and s - last[c] > idle)
        last[c] = s
        cut.append((t, f"{c}/{part[c]}", s, i, who, text))
    expected = conversation_state(messages(spark, cut)).withColumn(
        "conversation_id", F.split("conversation_id", "/")[0])
    columns = ["conversation_id", "seq", "message_count", "participants", "recent_messages",
               "created_at", "last_activity"]
    assert sorted(map(repr, out.select(*columns).collect())) == sorted(
        map(repr, expected.select(*columns).collect()))
    if cuts:
        # the conversations of the first third are over; their state is gone
        kept = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
        active = len({c for t, c, s, *_ in rows if s >= rows[-1][2] - idle})
        assert kept[-1] < len(last) * 14 and active < len(last)


@pytest.mark.parametrize("cuts", [[], [100], [60, 61, 200]])
def test_a_processor_replayed_in_slices_equals_its_batch_form(spark, tmp_path, cuts):
    limit, rows = dt.timedelta(seconds=500), _rows(9)
    out, _ = _replay(spark, messages(spark, rows), str(tmp_path),
                     lambda s: keyed.stream_unanswered(s, limit), cuts)
    expected, end = set(), at(rows[-1][2])
    talks = {}
    for r in rows:
        if r[4] != "system":
            talks.setdefault(r[1], []).append(r)
    for talk, said in talks.items():
        for one, after in zip(said, [*said[1:], None]):
            due = at(one[2]) + limit
            if one[4] == "customer" and (at(after[2]) > due if after else due < end):
                expected.add((talk, one[3], due))
    got = [(r.conversation_id, r.seq, r.due) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected


def _results(spark, rows):
    fields = ", ".join(f"{k} {PAYLOADS[k].simpleString()}" for k in KINDS)
    return spark.createDataFrame(rows, "tenant_id string, conversation_id string, ts timestamp_ntz, "
                                       f"seq bigint, {fields}")


def test_equal_content_is_sent_once(spark, tmp_path):
    s = ("positive", 0.5, "happy", "r", at(0))
    p = (True, [("name", "v", 0, 1)], "x", at(0))
    i = ("Complaint", "Low", [], [], False, "1 hour", [], at(0))
    m = ("t", "i", None, [], [], at(0))
    later = (*m[:-1], at(9))
    rows = [("t", "c", at(k), k, s, p, i, last) for k, last in enumerate(
        [None, m, later, ("new", *m[1:]), m, m])]
    df = _results(spark, rows).withColumn("last_updated", F.col("ts"))
    out, _ = _replay(spark, df, str(tmp_path), keyed.stream_updates, [2, 4])
    assert sorted(r.seq for r in out.collect()) == [1, 3, 4]


def test_running_merge_over_slices(spark, tmp_path):
    rng, rows = random.Random(2), []
    for k in range(60):
        entities = [("name", f"v{rng.randint(0, 4)}", 0, 1) for _ in range(rng.randint(0, 3))]
        p = (rng.random() < .3, entities, f"x{k}", at(k)) if rng.random() < .7 else None
        s = ("positive", 0.5, "happy", f"r{k}", at(k)) if p is None else None
        rows.append(("t", f"c{k % 3}", at(k), k, s, p, None, None))
    df = _results(spark, rows)
    for i, name in enumerate(("totals", "seen")):
        for source in _slices(spark, df, str(tmp_path / name), [20, 45]):
            sinks.run(sinks.stream_merge_parts(source)[i], sinks.write_batches(f"{tmp_path}/{name}/out"),
                      f"{tmp_path}/{name}/state", "update", once=True).awaitTermination()
    got = sinks.read_merged(spark, f"{tmp_path}/totals/out", f"{tmp_path}/seen/out")
    expected = merge.merge_intelligence_final(df)
    assert sorted(map(repr, got.select(*expected.columns).collect())) == sorted(
        map(repr, expected.collect()))


def test_retained_and_late_rows(spark, tmp_path):
    rows = [("a", at(0), 0), ("a", at(100), 1), ("b", at(5), 2), ("a", at(10), 3), ("a", at(60), 4),
            ("b", at(6), 5), ("a", None, 6), ("b", at(200), 7)]
    df = spark.createDataFrame(rows, "topic string, ts timestamp_ntz, seq int")
    path = [f"{tmp_path}/{n}" for n in ("kept", "expired", "marks")]
    for source in _slices(spark, df, str(tmp_path), [1, 4]):
        sinks.run(source, sinks.write_retained(*path, 50), f"{tmp_path}/state",
                  once=True).awaitTermination()
    late = sinks.read_batches(spark, path[1])
    assert sorted(r.seq for r in late.collect()) == [0, 3, 5]
    kept = sinks.read_retained(spark, path[0], path[2], 50)
    assert sorted(r.seq for r in kept.collect()) == [1, 4, 6, 7]


@pytest.mark.parametrize("name", ["stream_entities", "stream_expiring_state",
                                  "stream_unanswered", "stream_updates"])
def test_streams_of_several_variables_bring_their_store(spark, name):
    """Whatever store the session has set; and it has the same one set afterwards."""
    other = ("org.apache.spark.sql.execution.streaming.state."
             "HDFSBackedStateStoreProvider")
    spark.conf.set(STATE_STORE, other)
    try:
        assert QUERIES[name](spark, SF).count() > 0
        assert spark.conf.get(STATE_STORE) == other
    finally:
        spark.conf.set(STATE_STORE, ROCKSDB)


@pytest.mark.parametrize("name", ["stream_expiring_state", "stream_unanswered",
                                  "stream_updates", "stream_entities"])
def test_rows_over_the_default_store_are_those_of_the_sql(spark, name):
    """In a session that names no store, as a user's own."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    spark.conf.unset(STATE_STORE)
    try:
        df = QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        got = plain(df.select(*columns).collect())
    finally:
        spark.conf.set(STATE_STORE, ROCKSDB)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got and got == plain(con.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall())


def test_rows_of_a_key_leave_in_frames():
    """A conversation's output is never held as one frame, however long it is."""
    n = 2 * stateful.FRAME_ROWS + 5
    rows = pd.DataFrame({"ts": [at(i) for i in range(n)], "seq": range(n), "sender": "agent",
                         "message": "m", "summary": None, "late": False})
    state = Group()
    frames = list(stateful._advance_state(KEY, iter([rows[:7], rows[7:]]), state))
    assert [len(f) for f in frames] == [stateful.FRAME_ROWS, stateful.FRAME_ROWS, 5]
    assert pd.concat(frames)["message_count"].tolist() == list(range(1, n + 1))
    assert state.value[0] == n


class Group:
    exists, value = False, None

    def update(self, value):
        self.value = value


def test_slices_of_a_stream_are_files_for_all_cores(spark):
    """A stream's task reads whole splits: a slice that is one file keeps one core busy."""
    out = catalog._in_slices(spark, SF, "files", None, lambda rows: rows.select("event_id"),
                             sinks.write_batches)
    rows = spark.read.parquet(f"{out.removesuffix('/out')}/in")
    assert len(rows.inputFiles()) == 3 * spark.sparkContext.defaultParallelism
    written = sinks.read_batches(spark, out)
    assert written.count() == written.distinct().count() == rows.count()
