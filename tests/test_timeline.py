"""Running values over cut keys equal those of one window, whatever the cut."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import START, messages
from threadloom.operators import timeline as tl
from threadloom.operators.state import attach_summary_asof, conversation_state
from threadloom.operators.timeline import LastN, Timeline
from threadloom.operators.transcript import reply_context, transcript
from threadloom.sources import sinks


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows, in bursts and with equal times."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = ("t0", "big") if i % 3 == 0 else (f"t{i % 2}", f"c{i % 40}")
        second = rng.choice([i, i // 50, 86_400 * (i % 5), 12.5, 0.000001 * i])
        rows.append((*key, second, i, rng.choice(["customer", "agent", "system"]), f"m{i}"))
    timeless = F.when(F.col("seq") % 50 != 7, F.col("ts"))  # some rows have no time
    return messages(spark, rows).withColumn("ts", timeless).cache()


def scans():
    agent = F.col("sender") == "agent"
    return {"n": tl.count(), "agents": tl.count(agent),
            "last_agent": tl.last(F.when(agent, F.col("message"))),
            "first_agent": tl.first(F.when(agent, F.col("message"))),
            "agent_at": tl.first_position(agent), "any_agent": tl.any_so_far(agent),
            "tail": LastN(F.col("message"), 4)}


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("rows_per_task", [1, 5, 40])
def test_cut_equals_whole(spark, skewed, rows_per_task):
    cut = Timeline().measured(skewed, rows_per_task)
    assert not cut.whole
    assert rows_of(cut.running(skewed, scans())) == rows_of(Timeline().running(skewed, scans()))


def test_values_by_hand(spark, skewed):
    rows = sorted(skewed.collect(), key=lambda r: (r.ts is not None, r.ts or START, r.seq))
    got = {r.seq: r for r in Timeline().measured(skewed, 5).running(skewed, scans()).collect()}
    history = {}
    for r in rows:
        past = history.setdefault((r.tenant_id, r.conversation_id), [])
        past.append(r)
        agents = [p.message for p in past if p.sender == "agent"]
        out = got[r.seq]
        assert out.n == len(past) and out.agents == len(agents)
        assert out.last_agent == (agents[-1] if agents else None)
        assert out.first_agent == (agents[0] if agents else None)
        assert out.tail == [p.message for p in past[-4:]]


def test_small_keys_are_not_cut(spark, skewed):
    assert Timeline().measured(skewed, 10_000).whole


@pytest.mark.parametrize("second, seq", [
    (lambda i: i * 0.001, lambda i: i),                     # evenly
    (lambda i: 7 if i < 900 else 86_400 * i, lambda i: i),  # a burst, then years
    (lambda i: 7, lambda i: i),                             # all at one time
    (lambda i: 7, lambda i: i * 2 ** 50),                   # and far apart in sequence
])
def test_segments_are_small_and_in_order(spark, second, seq):
    rows = [("t", "k", second(i), seq(i), "customer", "m") for i in range(1000)]
    table = messages(spark, rows)
    segments = (Timeline().measured(table, 20).tagged(table).groupBy(tl.SEGMENT)
                .agg(F.count("*").alias("n"), F.min(F.struct("ts", "seq")).alias("first"),
                     F.max(F.struct("ts", "seq")).alias("last"))
                .orderBy(tl.SEGMENT).collect())
    assert max(s.n for s in segments) <= 20 and sum(s.n for s in segments) == 1000
    assert len(segments) < 500  # a burst doesn't refine the rest
    for one, two in zip(segments, segments[1:]):
        assert tuple(one.last) < tuple(two.first)


def test_rows_without_a_time_are_cut_by_sequence(spark):
    rows = [("t", "k", i, i, "customer", "m") for i in range(300)]
    table = messages(spark, rows).withColumn("ts", F.when(F.col("seq") >= 200, F.col("ts")))
    cut = Timeline().measured(table, 20)
    assert cut.tagged(table).groupBy(tl.SEGMENT).count().agg(F.max("count")).first()[0] <= 20
    assert rows_of(cut.running(table, scans())) == rows_of(Timeline().running(table, scans()))


def test_equal_rows_stay_together(spark):
    table = messages(spark, [("t", "k", 7, 1, "customer", "m")] * 50)
    assert Timeline().measured(table, 20).whole


def test_state_and_transcript_over_cut_keys(spark, skewed):
    cut = Timeline().measured(skewed, 7)
    for operator in (conversation_state, lambda m, t: transcript(m, 6, t)):
        assert rows_of(operator(skewed, cut)) == rows_of(operator(skewed, Timeline()))


def test_one_shuffle_of_the_rows(spark, skewed):
    """All running values of a state share one exchange."""
    plan = conversation_state(skewed, Timeline())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_asof_rules(spark):
    m = messages(spark, [("t", "c", 10, 1, "customer", "a"), ("t", "c", 30, 3, "agent", "b"),
                         ("t", "c", 50, 5, "agent", "c"), ("u", "c", 20, 9, "agent", "d")])
    s = spark.createDataFrame(
        [("t", "c", 5, 0, "early"), ("t", "c", 20, 2, "x"), ("t", "c", 40, 4, "y"),
         ("t", "c", 60, 6, "late"), ("u", "other", 1, 7, "z")],
        "tenant_id string, conversation_id string, s int, seq bigint, tldr string")
    s = s.selectExpr(
        "tenant_id", "conversation_id", "seq",
        "timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts",
        "named_struct('tldr', tldr, 'customer_issue', 'i', 'agent_response', cast(null AS string),"
        " 'key_points', array('p'), 'next_steps', array('n'), 'timestamp',"
        " timestamp_ntz'2025-01-01') AS summary")
    for t in (Timeline(), Timeline().measured(m, 1)):
        out = {r.message: r.summary and r.summary.tldr
               for r in attach_summary_asof(m, s, t).collect()}
        assert out == {"a": None, "b": "x", "c": "y", "d": None}


@pytest.mark.parametrize("rows_per_task, sorted_rows", [(5, 5), (5, 40), (40, 1)])
def test_cut_at_quantiles_equals_whole(spark, skewed, rows_per_task, sorted_rows):
    """By quantiles alone, and by quantiles first and then by rank."""
    cut = Timeline().measured(skewed, rows_per_task, sorted_rows)
    assert cut.cuts and (cut.part_rows is None) == (rows_per_task >= sorted_rows)
    assert rows_of(cut.running(skewed, scans())) == rows_of(Timeline().running(skewed, scans()))


def test_small_segments_need_no_table_of_places(spark, skewed):
    """What is read once per row does not grow with the number of segments."""
    cut = Timeline().measured(skewed, 1)
    assert not cut.whole and not cut.cuts
    assert cut.tagged(skewed).groupBy("tenant_id", "conversation_id", tl.SEGMENT).count().agg(
        F.max("count")).first()[0] == 1


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16, 63])
def test_part_is_between_two_cuts_or_on_one(spark, n):
    bounds = [3 * i for i in range(n)]
    places = [None, *range(-2, 3 * n + 2)]
    cuts = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    rows = (spark.createDataFrame([(p,) for p in places], "_place bigint")
            .withColumn("_bounds", cuts).withColumn("_marks", F.filter("_bounds", tl._is_mark)))
    for r in rows.withColumn("part", tl._part()).collect():
        below, up_to = (sum(map(test, bounds)) if r._place is not None else None for test in (
            lambda b: b < r._place, lambda b: b <= r._place))
        assert r.part == (-1 if r._place is None else below + up_to)


def test_places_are_written_for_a_turn_only(spark, skewed):
    """The last turn counts the rows of its segments, it does not write them."""
    work = sinks._MADE.setdefault(spark.sparkContext.applicationId, [])
    before = len(work)
    cut = Timeline().measured(skewed, 5, 100)
    assert len(cut.cuts) == 1
    assert sum("/positions-" in path for path in work[before:]) == 1


def test_a_place_is_compared_with_few_cuts(spark, skewed):
    """Of the 63 cuts of a segment the marks are read first."""
    cut = Timeline().measured(skewed, 5, 100).cuts[0].collect()
    assert cut and all(r._marks == r._bounds[tl.STEP - 1::tl.STEP] for r in cut)


def test_rows_without_a_key_are_not_cut(spark, skewed):
    keyless = skewed.withColumn("tenant_id", F.when(F.col("seq") % 4 > 0, F.col("tenant_id")))
    cut = Timeline().measured(keyless, 5)
    assert rows_of(cut.running(keyless, scans())) == rows_of(Timeline().running(keyless, scans()))


def test_last_part_without_gathering_texts(spark, skewed):
    """Only the lines are numbered in a window; parts with their texts meet in none."""
    df = reply_context(skewed, 6, Timeline())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
    rows = {(r.tenant_id, r.conversation_id): [] for r in skewed.collect()}
    for r in df.collect():
        rows[r.tenant_id, r.conversation_id].append((r.part, r.is_last))
    for parts in rows.values():
        assert sorted(parts) == [(i, i == len(parts) - 1) for i in range(len(parts))]
