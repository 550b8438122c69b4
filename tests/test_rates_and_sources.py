import random

import pytest
from pyspark.sql import functions as F

from conftest import at, messages
from threadloom.operators import scoring, views
from threadloom.operators.rates import trailing_rate
from threadloom.sources import events, serving, sinks, versions
from threadloom.schema import SUMMARY_STREAM


@pytest.mark.parametrize("seconds, limit, step", [(60, 3, 20), (60, 1, 1), (1, 2, 1)])
def test_trailing_rate_by_hand(spark, seconds, limit, step):
    rng = random.Random(seconds + step)
    rows = [("t" if rng.random() < .7 else "u", "c", rng.randint(0, 200) * step / 4, i, "agent", "")
            for i in range(300)]
    out = trailing_rate(messages(spark, rows), seconds=seconds, limit=limit).collect()
    assert len(out) == len(rows)
    got = {r.seq: r for r in out}
    queue = {}
    for t, _, s, i, *_ in sorted(rows, key=lambda r: (r[2], r[3])):
        now = queue[t] = [x for x in queue.get(t, []) if s - x < seconds]
        assert got[i].recent == len(now)
        assert got[i].over_limit == (len(now) >= limit)
        wait = seconds - (s - now[0]) if len(now) >= limit else None
        assert got[i].wait_seconds == (pytest.approx(wait) if wait is not None else None)
        now.append(s)


def test_view_answers(spark):
    texts = ['[{"header":{}},{"id":1},5,{"queryId":"q"}]', '{"id":2}\n\n{"id":3,"message":"m"}\n',
             '{"message":"bad"}', '{"error_code":1}', '{"header":1}', '{"id":4}', 'x', '']
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    rows = events.read_view_response(df).select(
        F.try_variant_get("document", "$.id", "int").alias("i")).collect()
    assert sorted(r.i for r in rows) == [1, 2, 3, 4]
    lines = spark.createDataFrame([('{"header":1}',), ('{"id":7,"message":"m"}',)], "value string")
    assert events.read_view_lines(lines).count() == 1


def test_retention(spark):
    rows = spark.createDataFrame([("a", at(0)), ("a", at(299)), ("a", at(300)), ("b", at(0))],
                                 "topic string, ts timestamp_ntz")
    kept = views.retention_filter(rows)
    assert sorted((r.topic, r.ts) for r in kept.collect()) == [
        ("a", at(299)), ("a", at(300)), ("b", at(0))]
    until = views.retention_filter(rows, now=F.lit("2025-01-01 00:05:30").cast("timestamp_ntz"))
    assert until.count() == 2


def test_keyed_json_round_trip(spark, tmp_path):
    rows = messages(spark, [("t", "c", 1, 1, "agent", 'say "hi"\n'), ("", "d", 2, 2, "agent", "é")])
    keyed = sinks.keyed_json(rows, columns=["conversation_id", "tenant_id", "message"])
    out = {r.key: r for r in keyed.collect()}
    assert [h.key for h in out["c"].headers] == ["tenant_id", "correlation_id"]
    assert [h.key for h in out["d"].headers] == ["correlation_id"]
    sinks.write_files(keyed.select("key", "value"), str(tmp_path / "topic"))
    back = spark.read.schema("key string, value string").json(str(tmp_path / "topic"))
    assert {r.key: r.value for r in back.collect()} == {k: r.value for k, r in out.items()}


def test_declared_stream_in_sql(spark):
    df = spark.createDataFrame(
        [("c", '{"tenant_id":"t","tldr":"x","key_points":["p"]}', 4), ("d", "broken", 5),
         ("e", None, 6)],
        "key string, value string, offset bigint")
    events.declare_stream(df, SUMMARY_STREAM, key="conversation_id", name="summary_stream")
    rows = spark.sql("SELECT * FROM summary_stream").collect()
    assert [(r.conversation_id, r.tldr, r.key_points, r.offset) for r in rows] == [
        ("c", "x", ["p"], 4)]


def test_times_keep_microseconds(spark):
    rows = messages(spark, [("t", "c", 0.000001, 1, "agent", "m")])
    assert '"ts":"2025-01-01T00:00:00.000001"' in sinks.keyed_json(rows).collect()[0].value


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_lookup_reads_one_folder(spark, tmp_path):
    rows = messages(spark, [(f"t{i % 3}", f"c{i}", i, i, "agent", "m") for i in range(300)])
    serving.write_serving(rows, str(tmp_path / "m"), buckets=8)
    stored = serving.read_serving(spark, str(tmp_path / "m"))
    assert stored.buckets == 8 and stored.table.count() == 300
    for i in range(0, 300, 37):
        assert [r.seq for r in stored.lookup(f"c{i}", f"t{i % 3}").collect()] == [i]
    assert stored.lookup("c4", "t0").count() == 0 and stored.lookup("c4").count() == 0
    found = stored.lookup("c4", "t1")
    plan = plan_of(found)
    assert "isnotnull(tenant_id" in plan and "(bucket#" in plan.split("PartitionFilters")[1]
    assert "conversation_id,c4" in plan.split("PushedFilters")[1]
    assert len(found.inputFiles()) > 0
    read = {f for f in found.select(F.input_file_name()).distinct().collect()}
    assert len(read) == 1


def test_many_lookups_prune_folders_while_running(spark, tmp_path):
    rows = messages(spark, [(f"t{i % 3}", f"c{i}", i, i, "agent", "m") for i in range(300)])
    serving.write_serving(rows, str(tmp_path / "m"), buckets=8)
    stored = serving.read_serving(spark, str(tmp_path / "m"))
    wanted = spark.createDataFrame([("c4", "t1"), ("c4", "t1"), ("c5", None), ("", "t1"),
                                    (None, "t1"), ("c6", "t0"), ("none", "t0")],
                                   "conversation_id string, tenant_id string")
    found = stored.lookup_many(wanted)
    assert sorted(r.seq for r in found.collect()) == [4, 6]
    assert "dynamicpruning" in plan_of(found).lower()
    assert found.columns == stored.table.drop("bucket").columns or set(found.columns) == set(rows.columns)


def test_versions_tell_defaults_from_nulls(spark, tmp_path):
    path = str(tmp_path / "v")
    one = spark.createDataFrame([(1, "a"), (2, None)], "id int, content string")
    two = spark.createDataFrame([(3, "b", "high", 1.5), (4, "c", None, None)],
                                "id int, content string, priority string, weight double")
    three = spark.createDataFrame([(5, None, "x")], "id int, priority string, origin string")
    versions.write_version(one, path, 1)
    versions.write_version(two, path, 2, {"priority": "normal"})
    versions.write_version(three, path, 3, {"origin": "chat"})
    versions.write_version(one.limit(1), path, 1)
    got = {(r.schema_version, r.id): (r.content, r.priority, r.weight, r.origin)
           for r in versions.read_versions(spark, path).collect()}
    assert got == {(1, 1): ("a", "normal", None, "chat"), (1, 2): (None, "normal", None, "chat"),
                   (2, 3): ("b", "high", 1.5, "chat"), (2, 4): ("c", None, None, "chat"),
                   (3, 5): (None, None, None, "x")}
    assert versions.read_versions(spark, path).count() == 6


def test_work_folders_are_shared_and_cleared(spark, monkeypatch):
    sinks.clear_work(spark)
    path = sinks.work_dir(spark, "rows")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and sinks.staged(spark.range(2), "more").count() == 2
    assert sinks.clear_work(spark) == 2 and sinks.clear_work(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)

    class Cluster:
        master, applicationId = "spark://host:7077", "none"

    class Session:
        sparkContext = Cluster

        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.sql.warehouse.dir": "file:/home/driver/warehouse"}.get(name, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.work_dir(Session, "rows")
    monkeypatch.setattr(Cluster, "master", "local[2]")
    assert sinks.work_dir(Session, "rows").startswith("file:/home/driver/warehouse/.work/rows-")


@pytest.fixture
def count_fold():
    def fold(previous, sender, message):
        n = int(previous["tldr"]) + 1 if previous else 1
        return {"tldr": str(n), "customer_issue": message, "agent_response": None,
                "key_points": [], "next_steps": []}

    return fold


def test_fold_goes_on_from_an_earlier_run(spark, count_fold):
    rows = [("t", f"c{i % 3}", i, i, "agent", f"m{i}") for i in range(30)]
    whole = scoring.summary_fold(messages(spark, rows), count_fold)
    first = scoring.summary_fold(messages(spark, rows[:14]), count_fold)
    newest = views.latest_values(first, ["tenant_id", "conversation_id"], ["summary"],
                                 ["ts", "seq"])
    second = scoring.summary_fold(messages(spark, rows[14:]), count_fold, newest)
    both = first.unionByName(second)
    key = lambda r: (r.seq, r.summary.tldr, r.summary.customer_issue)
    assert sorted(map(key, both.collect())) == sorted(map(key, whole.collect()))


def test_large_offsets_pass_through_the_fold(spark, count_fold):
    big = 2 ** 60 + 1
    out = scoring.summary_fold(messages(spark, [("t", "c", 1, big, "agent", "m")]), count_fold)
    assert out.collect()[0].seq == big


def test_tasks_of_a_source_hold_a_bounded_number_of_rows(spark, tmp_path):
    """One small file, many rows: a split by bytes would be few tasks."""
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = events.spread(spark.read.parquet(f"{tmp_path}/t"), rows_per_task=50)
    assert rows.rdd.getNumPartitions() == 20 and rows.distinct().count() == 1000
    assert max(rows.rdd.glom().map(len).collect()) <= 60
    again = events.spread(rows, rows_per_task=100)
    assert again is rows
