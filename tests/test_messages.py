import json

from pyspark.sql import functions as F

from conftest import at
from threadloom.operators import messages as msg
from threadloom.operators.responses import parse_model_response
from threadloom.plans.jobs import ingest
from threadloom.sources.events import read_requests


def requests(spark, values):
    rows = [("raw", 0, i, None, v if isinstance(v, str) else json.dumps(v), at(i))
            for i, v in enumerate(values)]
    return read_requests(spark.createDataFrame(
        rows, "topic string, partition int, offset bigint, key string, value string, "
              "ts timestamp_ntz"))


def test_requests(spark):
    ok = {"conversation_id": "c", "sender": "customer", "message": "hi"}
    values = [ok, {**ok, "tenant_id": "", "metadata": {"a": 1, "b": {"c": 2}}},
              {**ok, "message": ""}, {**ok, "message": "é" * 10_000},
              {**ok, "message": "x" * 10_001}, {**ok, "sender": "bot"}, {**ok, "channel": "fax"},
              {"conversation_id": "c", "sender": "agent", "content": "old name"}, "nope",
              {**ok, "message": 5}]
    good, bad = ingest(requests(spark, values))
    rows = good.orderBy("offset").collect()
    assert [r.offset for r in rows] == [0, 1, 3]
    assert {r.tenant_id for r in rows} == {"demo-tenant"} and {r.channel for r in rows} == {"chat"}
    assert rows[1].metadata == {"a": "1", "b": '{"c":2}'}
    assert good.count() + bad.count() == len(values)
    letters = {r.original_offset: r for r in bad.collect()}
    assert letters[8].error_type == "JSONDecodeError"
    assert letters[9].error == "message: not a text"
    assert letters[7].error == "message: field required"
    assert letters[8].value == "nope"  # kept as raw text
    assert [h.key for h in letters[8].headers] == ["dlq_source_topic", "dlq_error"]


def test_wrong_types_are_told_apart(spark):
    ok = {"conversation_id": "c", "sender": "agent", "message": "m"}
    values = {"[1]": "value: not an object", "5 6": "value: not JSON", "": "value: not JSON"}
    for field, wrong, error in (
            ("tenant_id", 7, "tenant_id: not a text"), ("channel", None, "channel: not a text"),
            ("channel", 5, "channel: not a text"), ("metadata", [1], "metadata: not an object"),
            ("metadata", "x", "metadata: not an object"), ("message", None, "message: not a text"),
            ("conversation_id", {}, "conversation_id: not a text"),
            ("sender", 1, "sender: not an allowed value"), ("tenant_id", None, None),
            ("metadata", None, None), ("metadata", {}, None)):
        values[json.dumps({**ok, field: wrong})] = error
    checked = msg.validate_message(requests(spark, list(values)))
    got = {r.value: r for r in checked.collect()}
    assert {k: r.error for k, r in got.items()} == values
    assert {r.error_type for r in got.values() if r.error == "value: not JSON"} == {"JSONDecodeError"}


def test_ids_are_stable_and_distinct(spark):
    ok = {"conversation_id": "c", "sender": "customer", "message": "hi"}
    one, two = (sorted(r.message_id for r in ingest(requests(spark, [ok, ok]))[0].collect())
                for _ in range(2))
    assert one == two and len(set(one)) == 2


def test_validate_without_channel_column(spark):
    df = spark.createDataFrame([("c", "agent", "m")],
                               "conversation_id string, sender string, message string")
    assert msg.validate_message(df).collect()[0].error is None


ANSWER = {"sentiment": "negative", "confidence": 0.9, "emotion": "angry", "reasoning": "why"}


def parsed(spark, kind, texts):
    rows = [(i, at(i), kind, t if isinstance(t, str) else json.dumps(t))
            for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "seq int, ts timestamp_ntz, kind string, response string")
    return parse_model_response(df).orderBy("seq").collect()


def test_answer_shapes(spark):
    text = json.dumps(ANSWER)
    rows = parsed(spark, "sentiment", [
        ANSWER, f"```json\n{text}\n```", f"```\n{text}\n```  ", f"  ```json\n{text}", [ANSWER, {}],
        "[]", "oops", f"{text} trailing", {k: x for k, x in ANSWER.items() if k != "emotion"},
        {**ANSWER, "confidence": "0.25"}, {**ANSWER, "confidence": 1.2},
        {**ANSWER, "sentiment": "mixed"}, "[1]", f"```json\n{text}\n``` bye"])
    assert [r.error_type for r in rows] == [
        None, None, None, None, None, "TypeError", "JSONDecodeError", "JSONDecodeError", "KeyError",
        None, "ValidationError", "ValueError", "TypeError", "JSONDecodeError"]
    assert rows[9].sentiment.confidence == 0.25
    assert all(r.sentiment.emotion == "angry" for r in rows if r.error is None)


def test_defaults_only_for_absent_fields(spark):
    base = {"intent": "Complaint", "urgency": "Low", "requiresEscalation": True,
            "estimatedResolutionTime": "1-3 days"}
    rows = parsed(spark, "insights", [base, {**base, "categories": None},
                                      {**base, "categories": ["a"], "summary": {"tldr": "x"}}])
    assert rows[0].insights.categories == [] and rows[2].insights.categories == ["a"]
    assert rows[1].error == "categories: not a list of texts"
    assert rows[2].summary is None
    pii = parsed(spark, "pii", [
        {"hasPII": True}, {"hasPII": True, "entities": [{"type": "phone", "startIndex": 1}]},
        {"hasPII": False, "entities": [{"type": "x", "startIndex": 1, "endIndex": 2}]}])
    assert [r.error_type for r in pii] == [None, "KeyError", "ValueError"]
    assert pii[0].pii.entities == []


def test_keyless_rows_are_dropped(spark):
    df = spark.createDataFrame([("c", "t"), ("", "t"), (None, "t"), ("c", None)],
                               "conversation_id string, tenant_id string")
    assert msg.drop_keyless(df).count() == 1


def test_columns_survive(spark):
    good, _ = ingest(requests(spark, [{"conversation_id": "c", "sender": "agent",
                                       "message": "m", "tenant_id": "x"}]))
    assert good.select(F.col("tenant_id")).collect()[0][0] == "x"


def test_from_topic_files_to_contexts(spark, tmp_path):
    """The example of the README."""
    from threadloom.operators import context, pii, state
    from threadloom.schema import ENVELOPE
    from threadloom.sources.events import from_files

    rows = [("support.messages.raw", 0, i, "c",
             json.dumps({"conversation_id": "c", "sender": who, "message": text}), None, at(i))
            for i, (who, text) in enumerate([("customer", "hi"), ("agent", "call 12345678"),
                                             ("agent", "")])]
    spark.createDataFrame(rows, ENVELOPE).write.parquet(str(tmp_path / "topic"))
    messages, dead = ingest(read_requests(from_files(spark, str(tmp_path / "topic"))))
    messages = messages.withColumnsRenamed({"timestamp": "ts"}).withColumn(
        "seq", messages["offset"])
    states = context.context_last5(state.conversation_state(messages)).orderBy("seq").collect()
    assert [r.context for r in states] == ["Customer: hi", "Customer: hi\nAgent: call 12345678"]
    assert states[0].tenant_id == "demo-tenant" and dead.count() == 1
    assert pii.detect_pii(messages).filter("has_pii").count() == 1
    record = state.state_record(state.conversation_state(messages)).orderBy("message_count")
    assert [m.conversation_id for m in record.collect()[1].recent_messages] == ["c", "c"]
