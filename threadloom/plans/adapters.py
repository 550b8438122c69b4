"""The given tables in the shape of topics.

Each adapter is one SELECT that Spark and other SQL engines read alike, so a query
and the SQL it is checked against start from the same rows. ``NTZ`` stands for the
engine's name of a timestamp without zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom import schema as S
from threadloom.operators.results import typed_results, validate_agent_result
from threadloom.sources.events import spread


def pick(number: str, values: tuple[str, ...]) -> str:
    """CASE over ``number % len(values)``."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {cases} END"


KEY_COLUMNS = """concat('c', cast(user_id % 50 AS string)) AS conversation_id,
       concat('t', cast(user_id % 3 AS string)) AS tenant_id"""

# Turns of `conversations`; tenants and channels are partly missing.
TURNS = """
SELECT concat('conv-', cast(conv_id AS string)) AS conversation_id,
       CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN ''
            ELSE concat('t', cast(conv_id % 3 AS string)) END AS tenant_id,
       CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent'
            ELSE 'system' END AS sender,
       text AS message,
       CASE WHEN conv_id % 7 = 0 THEN NULL WHEN conv_id % 4 = 0 THEN 'chat'
            WHEN conv_id % 4 = 1 THEN 'email' WHEN conv_id % 4 = 2 THEN 'voice'
            ELSE 'sms' END AS channel,
       cast('2025-01-01 00:00:00' AS NTZ) + conv_id * INTERVAL '1' HOUR
         + turn * INTERVAL '1' MINUTE AS ts,
       turn AS seq, 'support.messages.raw' AS topic, conv_id % 3 AS src_partition,
       conv_id * 100 + turn AS src_offset
FROM conversations"""

# `events` as messages; some are empty and so invalid.
MESSAGES = f"""
SELECT {KEY_COLUMNS},
       CASE event_type WHEN 'signup' THEN 'agent' WHEN 'error' THEN 'system'
            ELSE 'customer' END AS sender,
       CASE event_id % 6
            WHEN 0 THEN concat('My name is Ann Lee, account ending ', cast(event_id AS string))
            WHEN 1 THEN concat('call ', cast(10000000 + event_id AS string))
            WHEN 2 THEN concat('account ', cast(100000000 + event_id AS string), ' ok')
            WHEN 3 THEN ''
            ELSE concat(event_type, ' ', props) END AS message,
       cast(NULL AS string) AS channel, ts, event_id AS seq,
       'support.messages.raw' AS topic, (user_id % 50) % 3 AS src_partition,
       event_id AS src_offset, event_type, user_id
FROM events"""

# The same out of order, with many equal times.
MIXED_TIMES = """CASE event_id * 7 % 5
         WHEN 0 THEN NTZ'2025-01-03 00:00:00' WHEN 1 THEN NTZ'2024-12-31 12:00:00'
         WHEN 2 THEN NTZ'2025-01-20 06:00:00' ELSE ts END AS ts"""
MIXED_MESSAGES = MESSAGES.replace("ts, event_id AS seq", f"{MIXED_TIMES}, event_id AS seq")

# `events` as requests with every kind of mistake.
REQUESTS = """
SELECT CASE WHEN event_id % 17 = 0 THEN NULL
            ELSE concat('c', cast(user_id % 50 AS string)) END AS conversation_id,
       CASE WHEN event_id % 11 = 0 THEN 'bot' WHEN event_type = 'signup' THEN 'agent'
            WHEN event_type = 'error' THEN 'system' ELSE 'customer' END AS sender,
       CASE WHEN event_id % 6 = 3 THEN '' WHEN event_id % 19 = 0 THEN NULL
            WHEN event_id % 13 = 0 THEN repeat('y', 10001)
            WHEN event_id % 29 = 0 THEN repeat('z', 10000)
            ELSE concat(event_type, ' ', props) END AS message,
       CASE WHEN event_id % 7 = 0 THEN 'fax' WHEN event_id % 7 = 1 THEN 'sms' END AS channel,
       ts, event_id AS seq
FROM events"""

# `events` as requests in JSON: every field absent, null and of a wrong type.
REQUEST_TEXTS = """
SELECT event_id AS seq, ts, 'support.messages.raw' AS topic, user_id % 3 AS src_partition,
       event_id AS src_offset, CASE event_id % 14
         WHEN 0 THEN concat('no JSON ', cast(event_id AS string))
         WHEN 1 THEN '["a list"]'
         WHEN 2 THEN '{"conversation_id":7,"sender":"agent","message":"m"}'
         WHEN 3 THEN '{"conversation_id":"c","sender":"agent","message":"m","tenant_id":7}'
         WHEN 4 THEN '{"conversation_id":"c","sender":"agent","message":"m","channel":null}'
         WHEN 5 THEN '{"conversation_id":"c","sender":"agent","message":"m","channel":5}'
         WHEN 6 THEN '{"conversation_id":"c","sender":"agent","message":"m","metadata":[1]}'
         WHEN 7 THEN '{"conversation_id":"c","sender":"agent","message":"m","metadata":"x"}'
         WHEN 8 THEN '{"conversation_id":"c","sender":"agent","message":null}'
         WHEN 9 THEN '{"conversation_id":"c","sender":"agent","content":"old name"}'
         WHEN 10 THEN '{"conversation_id":"c","sender":"agent","message":"m","tenant_id":null,"metadata":null}'
         WHEN 11 THEN '{"conversation_id":null,"sender":"agent","message":"m"}'
         ELSE concat('{"conversation_id":"c', cast(user_id % 50 AS string),
              '","sender":"customer","message":"', event_type, ' ', cast(event_id AS string),
              '","channel":"sms","tenant_id":"t', cast(user_id % 3 AS string),
              '","metadata":{"n":', cast(event_id AS string), '}}') END AS value
FROM events"""

_IDS = """concat('{"conversation_id":"c', cast(user_id % 50 AS string), '","tenant_id":"t',
              cast(user_id % 3 AS string), '",')"""


def _entity(number: str) -> str:
    return f"""concat('{{"type":"', {pick(number, S.PII_TYPES)}, '","start_index":',
              cast(event_id % 10 AS string), ',"end_index":',
              cast(event_id % 10 + 5 AS string), '}}')"""


# `events` as results of the four agents, as JSON texts; some invalid.
RESULTS = f"""
SELECT event_id AS seq, ts, event_type, user_id,
       CASE event_type WHEN 'view' THEN 'support.ai.sentiment' WHEN 'click' THEN 'support.ai.pii'
            WHEN 'signup' THEN 'support.ai.insights' WHEN 'purchase' THEN 'support.ai.summary'
            ELSE 'support.ai.aggregated' END AS topic,
       (user_id % 50) % 3 AS src_partition, event_id AS src_offset,
       concat('c', cast(user_id % 50 AS string)) AS key,
       CASE event_type
       WHEN 'view' THEN concat({_IDS},
          '"sentiment":"', {pick("event_id", S.SENTIMENTS)},
          '","confidence":', CASE WHEN event_id % 50 = 0 THEN '1.2'
             ELSE concat('0.', lpad(cast(event_id % 100 AS string), 2, '0')) END,
          ',"emotion":"', {pick("event_id", S.EMOTIONS)},
          '","reasoning":"r', cast(event_id AS string), '"}}')
       WHEN 'click' THEN concat({_IDS},
          '"has_pii":', CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'false' END,
          ',"entities":[', CASE event_id % 3 WHEN 0 THEN ''
             WHEN 1 THEN {_entity("event_id")}
             ELSE concat({_entity("event_id")}, ',', {_entity("(event_id + event_id % 2)")}) END,
          '],"redacted_text":"x', cast(event_id AS string), '"}}')
       WHEN 'signup' THEN concat({_IDS},
          '"intent":"', {pick("event_id", S.INTENTS)},
          '","urgency":"', {pick("event_id", S.URGENCIES)},
          '","categories":["k', cast(event_id % 5 AS string), '"],',
          CASE WHEN event_id % 3 = 0 THEN '' ELSE '"suggested_actions":["a","b"],' END,
          '"requires_escalation":', CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END,
          ',"estimated_resolution_time":"1-4 hours"}}')
       WHEN 'purchase' THEN concat({_IDS},
          '"tldr":"s', cast(event_id AS string),
          '","customer_issue":"i', cast(event_id AS string), '","agent_response":',
          CASE WHEN event_id % 2 = 0 THEN 'null'
             ELSE concat('"g', cast(event_id AS string), '"') END,
          ',"key_points":["p', cast(event_id % 5 AS string), '","q"],"next_steps":[]}}')
       ELSE CASE event_id % 3 WHEN 0 THEN 'not json {{'
          WHEN 1 THEN concat('{{"conversation_id":"c', cast(user_id % 50 AS string), '"}}')
          ELSE concat({_IDS}, '"status":"ok"}}') END
       END AS value
FROM events"""

MIXED_RESULTS = RESULTS.replace("event_id AS seq, ts,", f"event_id AS seq, {MIXED_TIMES},")

# `events` as results that arrive late: every seventh two days after its time.
LATE_RESULTS = RESULTS.replace("event_id AS seq, ts,", """event_id AS seq,
       CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL '2' DAY ELSE ts END AS ts,""")

# `events` as answers of a model: plain, fenced, in a list, broken.
ANSWERS = f"""
SELECT event_id AS seq, ts, user_id, kind,
       CASE event_id % 8
         WHEN 0 THEN concat('```json', chr(10), body, chr(10), '```')
         WHEN 1 THEN concat('  ```', chr(10), body, chr(10), '``` ')
         WHEN 2 THEN concat('[', body, ']')
         WHEN 3 THEN concat('```json', chr(10), body)
         WHEN 4 THEN concat('Sure: ', body)
         WHEN 5 THEN '[]'
         ELSE body END AS response
FROM (SELECT event_id, ts, user_id,
   CASE event_type WHEN 'view' THEN 'sentiment' WHEN 'click' THEN 'pii'
        WHEN 'signup' THEN 'insights' ELSE 'summary' END AS kind,
   CASE event_type
   WHEN 'view' THEN concat('{{"sentiment":"',
      CASE WHEN event_id % 23 = 0 THEN 'mixed' ELSE 'negative' END, '","confidence":',
      CASE event_id % 3 WHEN 0 THEN '"0.5"' WHEN 1 THEN '0.25' ELSE '1.2' END,
      ',"emotion":"angry"', CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"reasoning":"why"' END, '}}')
   WHEN 'click' THEN concat('{{"hasPII":true,"entities":[{{"type":"phone","startIndex":',
      cast(event_id % 9 AS string), ',"endIndex":', cast(event_id % 9 + 8 AS string), '}}]',
      CASE event_id % 3 WHEN 0 THEN '' ELSE ',"redactedText":"call [REDACTED]"' END, '}}')
   WHEN 'signup' THEN concat('{{"intent":"Complaint","urgency":"',
      CASE WHEN event_id % 7 = 0 THEN 'Huge' ELSE 'High' END, '","requiresEscalation":true,',
      CASE event_id % 3 WHEN 0 THEN '"categories":null,' WHEN 1 THEN '"categories":["x","y"],'
        ELSE '' END, '"estimatedResolutionTime":"1-3 days"}}')
   ELSE concat('{{"tldr":"t', cast(event_id AS string), '","customerIssue":"i"',
      CASE event_id % 3 WHEN 0 THEN ',"agentResponse":null' WHEN 1 THEN ',"agentResponse":"ok"'
        ELSE '' END, ',"keyPoints":["one","two"]}}') END AS body
   FROM events) b"""

# `events` as answers of the view service, one text per row.
VIEW_ANSWERS = """
SELECT event_id AS seq,
       CASE event_type
         WHEN 'view' THEN concat('[{"header":{"queryId":"q"}},{"id":', cast(event_id AS string),
              ',"n":1},{"id":', cast(event_id AS string), ',"n":2},7]')
         WHEN 'click' THEN concat('{"queryId":"q"}', chr(10), '{"id":', cast(event_id AS string),
              ',"n":1}', chr(10), chr(10), '{"id":', cast(event_id AS string),
              ',"n":2,"message":"m"}')
         WHEN 'signup' THEN '{"error_code":40001,"message":"no"}'
         WHEN 'purchase' THEN concat('{"id":', cast(event_id AS string), ',"n":1}')
         ELSE concat('{"id":1}', chr(10), 'broken') END AS value
FROM events"""

# Conversations asked for: one per customer, some without a tenant.
REQUESTED = """
SELECT concat('c', cast(c_custkey % 100 AS string)) AS conversation_id,
       CASE WHEN c_mktsegment = 'BUILDING' THEN NULL
            ELSE concat('t', cast(c_nationkey % 3 AS string)) END AS tenant_id
FROM customer"""


def _select(spark: SparkSession, sf_dir: str, sql: str, table: str,
            costly: bool = False) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return select_from(spark, spread(source) if costly else source, sql, table)


def select_from(spark: SparkSession, source: DataFrame, sql: str, table: str) -> DataFrame:
    """An adapter over any frame with the columns of ``table``, streams included."""
    # Formatting takes single braces as its own; the JSON texts have many.
    text = sql.replace("NTZ", "timestamp_ntz")
    head, _, tail = text.rpartition(f"FROM {table}")
    text = head.replace("{", "{{").replace("}", "}}") + "FROM {source}" + tail.replace(
        "{", "{{").replace("}", "}}")
    out = spark.sql(text, source=source)
    for name in ("partition", "offset"):
        if f"src_{name}" in out.columns:
            out = out.withColumnRenamed(f"src_{name}", name)
    return out


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, TURNS, "conversations")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, MESSAGES, "events", costly=True)


def mixed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, MIXED_MESSAGES, "events", costly=True)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, REQUESTS, "events")


def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, REQUEST_TEXTS, "events", costly=True)


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, RESULTS, "events", costly=True)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid, typed results."""
    return typed_results(validate_agent_result(raw_results(spark, sf_dir)))


def mixed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid, typed results out of order, with many equal times."""
    raw = _select(spark, sf_dir, MIXED_RESULTS, "events", costly=True)
    return typed_results(validate_agent_result(raw))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, ANSWERS, "events", costly=True)


def view_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, VIEW_ANSWERS, "events", costly=True)


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, REQUESTED, "customer")
