import json

from pyspark.sql import functions as F

from conftest import SF, at
from threadloom.operators import merge, timeline, views
from threadloom.operators.results import typed_results, validate_agent_result
from threadloom.operators.timeline import Timeline
from threadloom.plans import adapters, catalog, jobs
from threadloom.plans import adapters as A
from threadloom.schema import PAYLOADS
from threadloom.sources import events

IDS = {"conversation_id": "c", "tenant_id": "t"}
SENTIMENT = {**IDS, "sentiment": "neutral", "confidence": 0.5, "emotion": "neutral",
             "reasoning": "r"}
INSIGHTS = {**IDS, "intent": "Complaint", "urgency": "Low", "requires_escalation": False,
            "estimated_resolution_time": "1-4 hours"}
SUMMARY = {**IDS, "tldr": "t", "customer_issue": "i"}


def pii(found, *types):
    return {**IDS, "has_pii": found,
            "entities": [{"type": k, "start_index": i, "end_index": i + 1}
                         for i, k in enumerate(types)]}


def raw(spark, values):
    rows = [(i, at(i), "topic", 0, i, "c", v if isinstance(v, str) else json.dumps(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, topic string, partition int,"
                                       " offset bigint, key string, value string")


def typed(spark, values):
    return typed_results(validate_agent_result(raw(spark, values)))


STEPS = [pii(True, "phone", "phone"), pii(False), pii(True, "phone", "name", "name"), SENTIMENT,
         INSIGHTS, SUMMARY, {**IDS, "other": 1}]


def test_sequence(spark):
    rows = typed(spark, STEPS)
    for t in (Timeline(), Timeline().measured(rows, 1)):
        out = merge.completeness(merge.merge_intelligence(rows, t)).orderBy("seq").collect()
        types = [[e.type for e in r.pii.entities] for r in out]
        assert types == [["phone", "phone"]] * 2 + [["phone", "phone", "name"]] * 5
        assert all(r.pii.has_pii for r in out)
        assert [r.complete for r in out] == [False] * 5 + [True] * 2
        assert [r.last_updated for r in out] == [at(i) for i in range(7)]
    final = merge.merge_intelligence_final(rows).collect()[0]
    assert [e.type for e in final.pii.entities] == ["phone", "phone", "name"]
    assert final.last_updated == at(6)


def test_first_result_without_entities(spark):
    rows = typed(spark, [pii(False), pii(True, "name", "name")])
    out = merge.merge_intelligence(rows, Timeline()).orderBy("seq").collect()
    assert [[e.type for e in r.pii.entities] for r in out] == [[], ["name"]]


def test_checks(spark):
    values = [SENTIMENT, {**SENTIMENT, "confidence": 1.2}, {**SENTIMENT, "confidence": "0.4"},
              {**SENTIMENT, "emotion": None}, {**SENTIMENT, "reasoning": 5}, "{", "[1]", "5",
              json.dumps(SUMMARY) + " x", {**SUMMARY, "key_points": None},
              {**SUMMARY, "key_points": ["a", None]}, {**SUMMARY, "agent_response": None},
              pii(True, "iban"), {**IDS, "has_pii": "yes", "entities": []},
              {**SUMMARY, "tenant_id": ""}, {**SUMMARY, "conversation_id": 5},
              {**SUMMARY, "timestamp": "soon"}, {**SUMMARY, "timestamp": "2025-01-01T10:00:00"},
              {**IDS, "sentiment": None, "emotion": None}]
    rows = validate_agent_result(raw(spark, values)).orderBy("seq").collect()
    assert [r.error for r in rows] == [
        None, "confidence: outside 0 to 1", None, "emotion: not an allowed value",
        "reasoning: text required", "value: not JSON", "value: not an object",
        "value: not an object", "value: not JSON", "key_points: not a list of texts",
        "key_points: not a list of texts", None, "entities: not an allowed entity", None, None,
        "conversation_id: text required", "timestamp: not a time", None,
        "sentiment: not an allowed value"]
    assert [rows[i].error_type for i in (5, 6, 9)] == [
        "JSONDecodeError", "AttributeError", "ValidationError"]
    assert rows[18].kind == "sentiment"  # present, though null
    kept = typed_results(validate_agent_result(raw(spark, values))).orderBy("seq").collect()
    assert kept[1].sentiment.confidence == 0.4 and kept[3].pii.has_pii is True


def test_good_bad_and_skipped_rows_add_up(spark):
    from conftest import SF

    checked = validate_agent_result(adapters.raw_results(spark, SF))
    keyless = checked.filter("error IS NULL AND (coalesce(tenant_id, '') = '' "
                             "OR coalesce(conversation_id, '') = '')").count()
    bad = checked.filter("error IS NOT NULL").count()
    assert bad and keyless
    assert typed_results(checked).count() + bad + keyless == checked.count()


def test_flag_stays_and_entities_are_unique(spark):
    from conftest import SF

    changes = merge.merge_intelligence(adapters.results(spark, SF))
    by_key = {}
    for r in changes.orderBy("ts", "seq").collect():
        by_key.setdefault((r.tenant_id, r.conversation_id), []).append(r.pii)
    for states in by_key.values():
        seen = [p for p in states if p]
        flags = [p.has_pii for p in seen]
        assert flags == sorted(flags)
        opening = len(seen[0].entities) if seen else 0
        for p in seen:
            later = [(e.type, e.value) for e in p.entities[opening:]]
            assert len(later) == len(set(later))


def test_two_rules_of_latest(spark):
    rows = spark.createDataFrame(
        [("c", "t", "a", "x", 0), ("c", "t", "b", None, 1), (None, "t", "z", "z", 2)],
        "conversation_id string, tenant_id string, tldr string, agent_response string, o int")
    out = views.latest_values(rows, ["conversation_id"], ["tldr", "agent_response"], ["o"])
    assert [tuple(r) for r in out.collect()] == [("c", "b", "x")]
    whole = rows.withColumn("kind", F.lit("summary")).withColumns({"ts": F.lit(0), "seq": F.col("o")})
    newest = merge.latest_record(whole.filter("conversation_id IS NOT NULL")).collect()[0]
    assert (newest.tldr, newest.agent_response) == ("b", None)


def test_lookup(spark):
    final = merge.merge_intelligence_final(typed(spark, STEPS))
    assert views.lookup(final, "c", "t").count() == 1
    assert views.lookup(final, "c").count() == 0
    asked = spark.createDataFrame([("c", "t"), ("c", "t"), ("c", None)],
                                  "conversation_id string, tenant_id string")
    assert views.intelligence_lookup(final, asked).count() == 1


def test_tombstone_and_later_record(spark):
    records = spark.createDataFrame([("p", at(1), 1), ("p", at(3), 3), ("q", at(1), 1)],
                                    "pii_id string, ts timestamp_ntz, seq int")
    graves = spark.createDataFrame([("p", at(2), 2), ("p", at(0), 0)],
                                   "pii_id string, ts timestamp_ntz, seq int")
    left = views.pii_tombstone(records, graves).collect()
    assert sorted((r.pii_id, r.seq) for r in left) == [("p", 3), ("q", 1)]


# Where a plan parses the texts of results into their fields.
PARSE = "explode(transform(array(static_invoke(VariantExpressionEvalUtils.parseJson"


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_results_are_parsed_once(spark, monkeypatch):
    """Final records from one scan; change logs and as-of rows from what was written once."""
    final = plan_text(merge.merge_intelligence_final(A.results(spark, SF)))
    assert final.count("FileScan") == 1 and final.count(PARSE) == 1
    assert final.count("Exchange hashpartitioning") == 2 and "Join" not in final
    written, real = [], timeline.staged

    def counted(df, name):
        written.append(plan_text(df))
        return real(df, name)

    monkeypatch.setattr(timeline, "staged", counted)
    monkeypatch.setattr(merge, "staged", counted)
    for build in (lambda: merge.merge_intelligence(A.results(spark, SF)),
                  lambda: merge.running_latest(A.results(spark, SF)),
                  lambda: merge.pii_sticky(A.results(spark, SF)),
                  lambda: merge.pii_entity_merge(A.results(spark, SF))):
        written.clear()
        read = plan_text(build())
        parses = [p.count(PARSE) for p in (*written, read)]
        assert sum(parses) == 1 and parses[-1] == 0
        assert sum(p.count("events.parquet") for p in written) == 1


def test_entities_of_one_result_and_later_ones(spark):
    """The opening list keeps its repeats; later ones bring what is new, at its first place."""
    def pii(*values):
        return (False, [("name", v, i, i + 1) for i, v in enumerate(values)], "x", None)

    rows = [("t", "c", at(1), 1, pii("a", "b", "a")), ("t", "c", at(2), 2, pii("b", "d", "d")),
            ("t", "c", at(2), 3, None), ("t", "e", at(5), 1, pii()), ("t", "e", at(6), 2, pii("a", "a"))]
    df = spark.createDataFrame(rows, "tenant_id string, conversation_id string, ts timestamp_ntz, "
                                     f"seq bigint, pii {PAYLOADS['pii'].simpleString()}")
    got = sorted((r.conversation_id, r.since.seq, r.place, r.entity.value)
                 for r in merge.pii_entity_merge(df).collect())
    assert got == [("c", 1, 0, "a"), ("c", 1, 1, "b"), ("c", 1, 2, "a"), ("c", 2, 1, "d"),
                   ("e", 2, 0, "a")]


def test_results_of_the_job_are_merged_in_bounded_tasks(spark, monkeypatch):
    """The merge sorts what a task reads, so a task must not read a whole split of packed rows."""
    seen = []
    monkeypatch.setattr(events, "SPREAD_ROWS", 20)
    monkeypatch.setattr(jobs, "merge_intelligence_final", lambda df: seen.append(df) or df)
    catalog.intelligence_job(spark, SF)
    rows, tasks = seen[0].count(), seen[0].rdd.getNumPartitions()
    assert tasks >= rows / 20 > 8
