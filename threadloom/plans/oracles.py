"""ANSI SQL with the same results as the catalogue, for checking it.

Written for DuckDB over the same tables, from the rules and not from the Spark
plans: self joins and JSON functions where Spark uses windows and Variant.
"""

from __future__ import annotations

from threadloom import schema as S
from threadloom.plans import adapters as A


def duck(sql: str) -> str:
    return sql.replace("NTZ", "timestamp").strip()


def listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


K = "tenant_id, conversation_id"

# -- shared table expressions --------------------------------------------------

B = f"b AS ({duck(A.MESSAGES)}), m AS (SELECT * FROM b WHERE message <> '')"
CHAT = f"{B}, chat AS (SELECT * FROM m)"
TURNS = f"""raw AS ({duck(A.TURNS)}),
a AS (SELECT sha256(topic || '|' || src_partition || '|' || src_offset) AS message_id,
  coalesce(nullif(tenant_id, ''), 'demo-tenant') AS tenant_id, conversation_id, sender, message,
  coalesce(channel, 'chat') AS channel, ts, seq FROM raw)"""
RAW = f"c AS ({duck(A.RESULTS)})"


def has(name: str, doc: str = "value") -> str:
    return f"json_exists({doc}, '$.{name}')"


def text(name: str, doc: str = "value") -> str:
    return f"json_extract_string({doc}, '$.{name}')"


PARSED = f"""{RAW},
p AS (SELECT *, CASE WHEN json_valid(value) THEN value::JSON END AS j FROM c),
k AS (SELECT *, {text('tenant_id', 'j')} AS tenant_id,
  {text('conversation_id', 'j')} AS conversation_id,
  CASE WHEN j IS NULL THEN NULL
       WHEN {has('sentiment', 'j')} AND {has('emotion', 'j')} THEN 'sentiment'
       WHEN {has('has_pii', 'j')} AND {has('entities', 'j')} THEN 'pii'
       WHEN {has('intent', 'j')} AND {has('urgency', 'j')} THEN 'insights'
       WHEN {has('tldr', 'j')} AND {has('customer_issue', 'j')} THEN 'summary'
       ELSE 'unknown' END AS kind FROM p),
e AS (SELECT *, CASE WHEN j IS NULL THEN 'value: not JSON'
       WHEN kind = 'sentiment' AND cast({text('confidence', 'j')} AS double) NOT BETWEEN 0 AND 1
       THEN 'confidence: outside 0 to 1' END AS error FROM k)"""

# Columns of one result, null unless it is of that kind.
SENTIMENT_COLUMNS = {
    "sentiment": text("sentiment", "j"),
    "confidence": f"cast({text('confidence', 'j')} AS double)",
    "emotion": text("emotion", "j"), "reasoning": text("reasoning", "j")}
INSIGHT_COLUMNS = {
    "intent": text("intent", "j"), "urgency": text("urgency", "j"),
    "categories": "array_to_string(j->>'$.categories[*]', '|')",
    "suggested_actions": "coalesce(array_to_string(j->>'$.suggested_actions[*]', '|'), '')",
    "requires_escalation": f"cast({text('requires_escalation', 'j')} AS boolean)",
    "estimated_resolution_time": text("estimated_resolution_time", "j"),
    "key_concerns": "''"}
SUMMARY_COLUMNS = {
    "tldr": text("tldr", "j"), "customer_issue": text("customer_issue", "j"),
    "agent_response": text("agent_response", "j"),
    "key_points": "array_to_string(j->>'$.key_points[*]', '|')",
    "next_steps": "array_to_string(j->>'$.next_steps[*]', '|')"}
BY_KIND = {"sentiment": SENTIMENT_COLUMNS, "insights": INSIGHT_COLUMNS, "summary": SUMMARY_COLUMNS}
MERGED_NAMES = [*SENTIMENT_COLUMNS, "has_pii", "entities", "redacted_text", *INSIGHT_COLUMNS,
                *SUMMARY_COLUMNS]

TYPED = f"""{PARSED},
r AS (SELECT {K}, kind, ts, seq, j,
  {', '.join(f"CASE WHEN kind = '{kind}' THEN {sql} END AS {name}"
             for kind, columns in BY_KIND.items() for name, sql in columns.items())},
  CASE WHEN kind = 'pii' THEN cast({text('has_pii', 'j')} AS boolean) END AS found,
  CASE WHEN kind = 'pii' THEN {text('redacted_text', 'j')} END AS redacted_text
  FROM e WHERE error IS NULL AND conversation_id <> '' AND tenant_id <> ''),
ent AS (SELECT {K}, seq, u.i - 1 AS place, json_extract_string(j, '$.entities[' || (u.i - 1)
    || '].type') AS type, '[REDACTED]' AS value,
  cast(json_extract_string(j, '$.entities[' || (u.i - 1) || '].start_index') AS bigint)
    AS start_index,
  cast(json_extract_string(j, '$.entities[' || (u.i - 1) || '].end_index') AS bigint) AS end_index
  FROM r, LATERAL (SELECT unnest(range(1, cast(json_array_length(j, '$.entities') AS bigint) + 1)) AS i) u
  WHERE kind = 'pii'),
opens AS (SELECT {K}, min(seq) AS opened FROM r WHERE kind = 'pii' GROUP BY ALL),
ranked AS (SELECT ent.*, opened, row_number() OVER (
    PARTITION BY ent.tenant_id, ent.conversation_id, type, value ORDER BY seq, place) AS nth
  FROM ent JOIN opens USING ({K})),
kept AS (SELECT {K}, seq AS since_seq, place, type, value, start_index, end_index FROM ranked
  WHERE seq = opened OR nth = 1)"""


def _own(kind: str, name: str) -> str:
    """Value of the newest result of a kind at row ``x``, null values included."""
    return f"arg_max(struct_pack(v := y.{name}), y.seq) FILTER (WHERE y.kind = '{kind}')"


def merged_rows(condition: str, seq: str, extra: str = "") -> str:
    """Merged values over the results that satisfy ``condition``, by self join."""
    columns = [f"({_own(kind, name)}).v AS {name}" for kind, cs in BY_KIND.items() for name in cs]
    columns.append(f"({_own('pii', 'redacted_text')}).v AS redacted_text")
    return f"""t AS (SELECT x.tenant_id, x.conversation_id, x.seq {extra}, {', '.join(columns)},
  bool_or(y.found) AS has_pii, bool_or(y.kind = 'pii') AS any_pii, max(y.ts) AS last_updated
  FROM {seq} x JOIN r y ON x.tenant_id = y.tenant_id
    AND x.conversation_id = y.conversation_id AND {condition}
  GROUP BY x.tenant_id, x.conversation_id, x.seq {extra}),
lists AS (SELECT x.tenant_id, x.conversation_id, x.seq, string_agg(type || ':' || value || ':' ||
    start_index || ':' || end_index, '|' ORDER BY since_seq, place) AS entities
  FROM {seq} x JOIN kept ON x.tenant_id = kept.tenant_id
    AND x.conversation_id = kept.conversation_id AND kept.since_seq <= x.seq GROUP BY ALL),
g AS (SELECT t.*, CASE WHEN any_pii THEN coalesce(lists.entities, '') END AS entities
  FROM t LEFT JOIN lists USING (tenant_id, conversation_id, seq))"""


FINAL = f"""{TYPED}, ends AS (SELECT {K}, max(seq) AS seq FROM r GROUP BY ALL),
{merged_rows('y.seq <= x.seq', 'ends')}"""
CHANGES = f"{TYPED}, {merged_rows('y.seq <= x.seq', 'r', ', x.kind')}"
MERGED_LIST = ", ".join(MERGED_NAMES)

# The newest summary after the first message and before each message.
ASOF = f"""{CHAT}, {TYPED},
starts AS (SELECT {K}, min(seq) AS opened FROM chat GROUP BY ALL),
known AS (SELECT x.tenant_id, x.conversation_id, x.seq, max(y.seq) AS source
  FROM chat x JOIN starts o USING ({K}) LEFT JOIN r y ON y.kind = 'summary'
    AND y.tenant_id = x.tenant_id AND y.conversation_id = x.conversation_id
    AND y.seq < x.seq AND y.seq >= o.opened GROUP BY ALL),
asof_rows AS (SELECT x.*, y.tldr, y.customer_issue, y.agent_response, y.key_points, y.next_steps,
    known.source FROM chat x JOIN known USING (tenant_id, conversation_id, seq)
  LEFT JOIN r y ON y.seq = known.source)"""


def numbered(rows: str, name: str = "n") -> str:
    return (f"{name} AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY ts, seq) AS nr "
            f"FROM {rows})")


def window_text(n: int, line: str, joiner: str, rows: str = "n") -> str:
    """Last ``n`` lines per row, by self join on the row number."""
    return f"""(SELECT string_agg({line}, {joiner} ORDER BY y.nr) FROM {rows} y
  WHERE y.tenant_id = x.tenant_id AND y.conversation_id = x.conversation_id
    AND y.nr BETWEEN x.nr - {n - 1} AND x.nr)"""


def state_sql(source: str, rows: str) -> str:
    return f"""WITH {source}, {numbered(rows)},
firsts AS (SELECT {K}, sender, min(nr) AS f FROM n GROUP BY ALL)
SELECT {K}, seq, ts, nr AS message_count, first_value(ts) OVER w AS created_at,
  ts AS last_activity,
  (SELECT string_agg(sender, '|' ORDER BY f) FROM firsts WHERE firsts.tenant_id = x.tenant_id
     AND firsts.conversation_id = x.conversation_id AND f <= x.nr) AS participants,
  {window_text(10, 'y.message', "'|'")} AS recent
FROM n x WINDOW w AS (PARTITION BY {K} ORDER BY nr)"""


def transcript_sql(source: str, rows: str, lines: int) -> str:
    return f"""WITH {source}, {numbered(rows)}
SELECT {K}, cast((nr - 1) // {lines} AS bigint) AS part, count(*) AS lines,
  string_agg(sender || ': ' || message, chr(10) ORDER BY nr) AS text FROM n GROUP BY ALL"""


def reply_sql(source: str, rows: str, lines: int) -> str:
    return f"""WITH {source}, {numbered(rows)},
parts AS (SELECT {K}, cast((nr - 1) // {lines} AS bigint) AS part, count(*) AS lines,
  string_agg(sender || ': ' || message, chr(10) ORDER BY nr) AS text FROM n GROUP BY ALL),
newest AS (SELECT {K}, message, cast((nr - 1) // {lines} AS bigint) AS last_part FROM n
  QUALIFY nr = max(nr) OVER (PARTITION BY {K}))
SELECT {K}, part, lines, part = last_part AS is_last,
  CASE WHEN part = 0 THEN 'Conversation History:' || chr(10) || '\"\"\"' || chr(10) ELSE '' END
  || text || CASE WHEN part = last_part THEN chr(10) || '\"\"\"' || chr(10) || chr(10)
    || 'Latest Customer Message:' || chr(10) || '\"\"\"' || chr(10) || message || chr(10)
    || '\"\"\"' ELSE '' END AS context
FROM parts JOIN newest USING ({K})"""


def rate_sql(key: str, seconds: int, limit: int) -> str:
    return f"""WITH b AS ({duck(A.MESSAGES)}),
q AS (SELECT x.{key}, x.seq, x.ts, count(y.seq) AS recent, min(y.ts) AS oldest
  FROM b x LEFT JOIN b y ON y.{key} = x.{key} AND y.ts > x.ts - INTERVAL '{seconds}' SECOND
    AND (y.ts < x.ts OR (y.ts = x.ts AND y.seq < x.seq)) GROUP BY ALL)
SELECT {key}, seq, recent, recent >= {limit} AS over_limit, CASE WHEN recent >= {limit}
  THEN round({seconds} - (epoch_us(ts) - epoch_us(oldest)) / 1000000.0, 6) END AS wait_seconds
FROM q"""


# -- personal data -------------------------------------------------------------
# Word tokens of letters, numbers and "_" that are digits only are phones; spans
# come from the text before the n-th match.

PII = f"""{B},
w AS (SELECT seq, tenant_id, trim(message) AS t FROM m),
phones AS (SELECT seq, unnest(list_filter(regexp_extract_all(t, '[\\pL\\pN_]+'),
    lambda z: regexp_full_match(z, '[0-9]{{8,15}}'))) AS hit FROM w),
accounts AS (SELECT seq, regexp_extract(t, '(?i)account\\s+(?:number\\s+)?(?:ending\\s+)?(\\d+)', 1)
    AS hit FROM w),
names AS (SELECT seq, regexp_extract(t, 'My name is ([A-Z][a-z]+ [A-Z][a-z]+)', 1) AS hit FROM w),
found AS (SELECT 1 AS o, 'phone' AS type, * FROM phones
  UNION ALL SELECT 2, 'account_number', * FROM accounts WHERE hit <> ''
  UNION ALL SELECT 3, 'name', * FROM names WHERE hit <> ''),
placed AS (SELECT found.*, w.tenant_id, instr(t, hit) - 1 AS s FROM found JOIN w USING (seq)),
listing AS (SELECT seq, string_agg(type || ':[REDACTED]:' || s || ':' || (s + length(hit)), '|'
    ORDER BY o) AS entities FROM placed GROUP BY seq),
clean AS (SELECT seq, regexp_replace(regexp_replace(regexp_replace(t,
    '\\b\\d{{8,15}}\\b', '[REDACTED]', 'g'),
    '((?i)account\\s+(?:number\\s+)?(?:ending\\s+)?)\\d+', '\\1[REDACTED]', 'g'),
    '(My name is )[A-Z][a-z]+ [A-Z][a-z]+', '\\1[REDACTED]', 'g') AS redacted_text FROM w)"""

# -- answers of a model --------------------------------------------------------

ANSWERS = f"""a AS ({duck(A.ANSWERS)}),
u AS (SELECT *, regexp_replace(regexp_replace(trim(response), '^```[^\\n]*\\n', ''),
    '\\n```\\s*$', '') AS body FROM a),
d AS (SELECT *, CASE WHEN json_valid(body) THEN
    CASE WHEN json_type(body) = 'ARRAY' AND json_array_length(body) > 0
         THEN json_extract(body, '$[0]') ELSE body::JSON END END AS j FROM u),
h AS (SELECT *, CASE WHEN j IS NULL THEN 'response: not JSON'
    WHEN json_type(j) <> 'OBJECT' THEN 'response: not an object' ELSE
    CASE kind WHEN 'sentiment' THEN
      CASE WHEN NOT {has('reasoning', 'j')} THEN 'reasoning: field required'
           WHEN {text('sentiment', 'j')} NOT IN ({listed(S.SENTIMENTS)})
             THEN 'sentiment: not an allowed value'
           WHEN cast({text('confidence', 'j')} AS double) > 1 THEN 'confidence: outside 0 to 1' END
    WHEN 'insights' THEN
      CASE WHEN {text('urgency', 'j')} NOT IN ({listed(S.URGENCIES)})
             THEN 'urgency: not an allowed value'
           WHEN json_type(j, '$.categories') = 'NULL' THEN 'categories: not a list of texts' END
    END END AS error FROM d)"""

ANSWER_COLUMNS = {
    "sentiment": ("sentiment", text("sentiment", "j")),
    "confidence": ("sentiment", f"cast({text('confidence', 'j')} AS double)"),
    "emotion": ("sentiment", text("emotion", "j")),
    "reasoning": ("sentiment", text("reasoning", "j")),
    "has_pii": ("pii", f"cast({text('hasPII', 'j')} AS boolean)"),
    "entities": ("pii", "'phone:[REDACTED]:' || json_extract_string(j, '$.entities[0].startIndex')"
                        " || ':' || json_extract_string(j, '$.entities[0].endIndex')"),
    "redacted_text": ("pii", text("redactedText", "j")),
    "intent": ("insights", text("intent", "j")),
    "urgency": ("insights", text("urgency", "j")),
    "categories": ("insights", "coalesce(array_to_string(j->>'$.categories[*]', '|'), '')"),
    "suggested_actions": ("insights", "''"),
    "requires_escalation": ("insights", f"cast({text('requiresEscalation', 'j')} AS boolean)"),
    "estimated_resolution_time": ("insights", text("estimatedResolutionTime", "j")),
    "key_concerns": ("insights", "''"),
    "tldr": ("summary", text("tldr", "j")),
    "customer_issue": ("summary", text("customerIssue", "j")),
    "agent_response": ("summary", text("agentResponse", "j")),
    "key_points": ("summary", "coalesce(array_to_string(j->>'$.keyPoints[*]', '|'), '')"),
    "next_steps": ("summary", "''"),
}

LATEST = f"""s AS (SELECT seq AS "offset", key AS conversation_id, {text('tenant_id')} AS tenant_id,
  {', '.join(f"{sql.replace('(j,', '(value,').replace('j->>', 'value->>')} AS {name}"
             for name, sql in SUMMARY_COLUMNS.items())}
  FROM c WHERE topic = 'support.ai.summary')"""


def latest_sql(keys: str, columns: list[str]) -> str:
    picks = ", ".join(f'arg_max({c}, "offset") AS {c}' for c in columns)
    return f"WITH {RAW}, {LATEST} SELECT {keys}, {picks} FROM s GROUP BY {keys}"


SENTIMENT_TAIL = ("chr(10) || chr(10) || 'IMPORTANT: Analyze the CUSTOMER''s CURRENT emotional "
                  "state based on their latest message above.' || chr(10)")
CAPITAL = "upper(y.sender[1]) || y.sender[2:] || ': ' || y.message"
# Stand-in models: constants, and a keyword in the newest message.
JOB = f"""WITH {PII}, {numbered('m')},
chat AS (SELECT *, lag(sender) OVER w AS before, first_value(message) OVER w AS opening,
    last_value(CASE WHEN sender = 'agent' THEN message END IGNORE NULLS) OVER w AS answer
  FROM n WINDOW w AS (PARTITION BY {K} ORDER BY nr ROWS UNBOUNDED PRECEDING)),
said AS (SELECT {K}, max_by(CASE WHEN nr = 1 THEN 'Conversation:' ELSE 'Background Context: '
    || (nr - 1) || ' messages, last from ' || before END, nr) AS reasoning
  FROM chat WHERE sender = 'customer' GROUP BY ALL),
marks AS (SELECT chat.tenant_id, chat.conversation_id, seq, o, type, s, s + length(hit) AS z
  FROM placed JOIN chat USING (seq)),
heads AS (SELECT {K}, min(seq) AS opened, max(seq) AS newest FROM chat GROUP BY ALL),
order_of AS (SELECT marks.*, opened, row_number() OVER (PARTITION BY marks.tenant_id,
    marks.conversation_id, type ORDER BY seq, o) AS nth FROM marks JOIN heads USING ({K})),
joined AS (SELECT {K}, string_agg(type || ':[REDACTED]:' || s || ':' || z, '|' ORDER BY seq, o)
    AS entities FROM order_of WHERE seq = opened OR nth = 1 GROUP BY ALL)
SELECT {K}, CASE WHEN reasoning IS NOT NULL THEN 'neutral' END AS sentiment,
  CASE WHEN reasoning IS NOT NULL THEN cast(0.5 AS double) END AS confidence,
  CASE WHEN reasoning IS NOT NULL THEN 'neutral' END AS emotion, reasoning,
  entities IS NOT NULL AS has_pii, coalesce(entities, '') AS entities, redacted_text,
  CASE WHEN message LIKE '%account%' THEN 'Account Issue' ELSE 'General Inquiry' END AS intent,
  CASE WHEN message LIKE '%account%' THEN 'High' ELSE 'Low' END AS urgency, '' AS categories,
  '' AS suggested_actions, message LIKE '%account%' AS requires_escalation,
  '1-4 hours' AS estimated_resolution_time, '' AS key_concerns,
  nr || ' messages, last from ' || sender AS tldr, opening AS customer_issue,
  answer AS agent_response, sender AS key_points, '' AS next_steps
FROM heads LEFT JOIN joined USING ({K}) LEFT JOIN said USING ({K})
JOIN chat USING ({K}) JOIN clean ON clean.seq = chat.seq WHERE chat.seq = newest"""
STATE = state_sql(B, "m")
CHANGE_LOG = f"WITH {CHANGES} SELECT {K}, seq, kind, {MERGED_LIST}, last_updated FROM g"
ASOF_SQL = f"""WITH {ASOF} SELECT {K}, seq, ts, tldr, customer_issue, agent_response, key_points,
  next_steps FROM asof_rows"""

ORACLES: dict[str, str] = {
    "read_events": f"""WITH {PARSED} SELECT topic, src_offset AS "offset", key,
  j IS NOT NULL AS is_json, conversation_id, 't' || (user_id % 3) AS header_tenant FROM k""",
    "read_multi": f"""WITH {B}, {RAW}
SELECT 'support.messages.raw' AS topic, conversation_id, seq, message, NULL AS value FROM b
UNION ALL SELECT 'support.ai.summary', key, seq, NULL, value FROM c
WHERE topic = 'support.ai.summary'""",
    "declare_stream": f"""WITH {RAW}, {LATEST} SELECT conversation_id, tenant_id, tldr,
  customer_issue, agent_response, key_points, next_steps, "offset" FROM s""",
    "write_keyed_json": f"""WITH {B} SELECT conversation_id AS key,
  cast(json_object('conversation_id', conversation_id, 'tenant_id', tenant_id, 'sender', sender,
    'message', message, 'channel', channel) AS varchar) AS value,
  'tenant_id=' || tenant_id || '|correlation_id='
    || sha256(topic || '|' || src_partition || '|' || src_offset) AS headers FROM m""",
    "dead_letter": f"""WITH {B}, {PARSED}
SELECT original_topic, original_partition, original_offset, key, value, error, error_type,
  'dlq_source_topic=' || original_topic || '|dlq_error=' || error AS headers FROM (
SELECT topic AS original_topic, src_partition AS original_partition,
  src_offset AS original_offset, conversation_id AS key,
  cast(json_object('conversation_id', conversation_id, 'tenant_id', tenant_id, 'sender', sender,
    'message', message, 'channel', channel, 'event_type', event_type, 'user_id', user_id)
    AS varchar) AS value,
  'message: shorter than 1 character' AS error, 'ValidationError' AS error_type
FROM b WHERE message = ''
UNION ALL
SELECT topic, src_partition, src_offset, key, value, error,
  CASE WHEN j IS NULL THEN 'JSONDecodeError' ELSE 'ValidationError' END
FROM e WHERE error IS NOT NULL)""",
    "intelligence_lookup": f"""WITH {FINAL},
asked AS (SELECT DISTINCT conversation_id, coalesce(tenant_id, 'demo-tenant') AS tenant_id
  FROM ({duck(A.REQUESTED)}))
SELECT {K}, {MERGED_LIST}, last_updated FROM g JOIN asked USING ({K})""",
    "change_feed": f"""WITH {FINAL} SELECT 'intelligence_update' AS type, {K}, sentiment, tldr,
  last_updated FROM g
WHERE sentiment IS NOT NULL AND any_pii AND intent IS NOT NULL AND tldr IS NOT NULL""",
    "read_view_response": """
SELECT event_id AS seq, event_id AS id, n FROM events, (SELECT unnest([1, 2]) AS n) t
WHERE event_type IN ('view', 'click')
UNION ALL SELECT event_id, event_id, 1 FROM events WHERE event_type = 'purchase'""",
    "retention_filter": f"""WITH {RAW} SELECT topic, seq, ts FROM c
WHERE ts > (SELECT max(ts) FROM c y WHERE y.topic = c.topic) - INTERVAL '24' HOUR""",
    "schema_evolve": f"""WITH raw AS ({duck(A.TURNS)}), {B}
SELECT conversation_id || '-' || seq AS message_id, message AS content, 'normal' AS priority FROM raw
UNION ALL SELECT conversation_id || '-' || seq, message, event_type FROM b""",
    "normalize_message": f"""WITH {TURNS} SELECT message_id, {K}, sender, message, channel, ts, seq
FROM a""",
    "validate_message": f"""WITH q AS ({duck(A.REQUESTS)}), x AS (SELECT seq, CASE
  WHEN conversation_id IS NULL THEN 'conversation_id: field required'
  WHEN sender NOT IN ({listed(S.SENDERS)}) THEN 'sender: not an allowed value'
  WHEN message IS NULL THEN 'message: field required'
  WHEN length(message) < 1 THEN 'message: shorter than 1 character'
  WHEN length(message) > 10000 THEN 'message: longer than 10000 characters'
  WHEN coalesce(channel, 'chat') NOT IN ({listed(S.CHANNELS)})
    THEN 'channel: not an allowed value' END AS error FROM q)
SELECT seq, error, CASE WHEN error IS NOT NULL THEN 'ValidationError' END AS error_type FROM x""",
    "read_requests": f"""WITH q AS ({duck(A.REQUEST_TEXTS)}),
d AS (SELECT *, CASE WHEN json_valid(value) THEN value::JSON END AS j FROM q),
f AS (SELECT *, json_type(j, '$.tenant_id') AS tenant, json_type(j, '$.channel') AS way,
  json_type(j, '$.message') AS words, json_type(j, '$.metadata') AS more,
  json_type(j, '$.conversation_id') AS talk FROM d),
x AS (SELECT *, CASE WHEN j IS NULL THEN 'value: not JSON'
  WHEN json_type(j) <> 'OBJECT' THEN 'value: not an object'
  WHEN talk <> 'VARCHAR' THEN 'conversation_id: not a text'
  WHEN words <> 'VARCHAR' THEN 'message: not a text'
  WHEN way <> 'VARCHAR' THEN 'channel: not a text'
  WHEN tenant NOT IN ('VARCHAR', 'NULL') THEN 'tenant_id: not a text'
  WHEN more NOT IN ('OBJECT', 'NULL') THEN 'metadata: not an object'
  WHEN words IS NULL THEN 'message: field required' END AS error FROM f)
SELECT seq, error, CASE WHEN j IS NULL THEN 'JSONDecodeError' WHEN error IS NOT NULL
    THEN 'ValidationError' END AS error_type,
  CASE WHEN talk = 'VARCHAR' THEN j->>'$.conversation_id' END AS conversation_id,
  CASE WHEN tenant = 'VARCHAR' THEN j->>'$.tenant_id' END AS tenant_id,
  CASE WHEN words = 'VARCHAR' THEN j->>'$.message' END AS message,
  CASE WHEN more = 'OBJECT' THEN j->>'$.metadata.n' END AS metadata_n FROM x""",
    "validate_agent_result": f"""WITH {PARSED} SELECT seq, kind, {K}, error,
  CASE WHEN error IS NULL THEN NULL WHEN j IS NULL THEN 'JSONDecodeError'
       ELSE 'ValidationError' END AS error_type FROM e""",
    "classify_result": f"WITH {PARSED} SELECT seq, kind FROM k",
    "drop_keyless": f"""WITH {PARSED} SELECT seq, {K}, kind FROM k
WHERE conversation_id <> '' AND tenant_id <> ''""",
    "sentiment_trigger": f"""WITH {B}, {numbered('m')} SELECT {K}, seq, nr AS message_count FROM n
WHERE sender = 'customer'""",
    "latest_message": f"""WITH {B} SELECT {K}, seq, sender AS latest_sender,
  message AS latest_message FROM m""",
    "parse_model_response": f"""WITH {ANSWERS} SELECT seq, kind, error,
  CASE WHEN error IS NULL THEN NULL WHEN error = 'response: not JSON' THEN 'JSONDecodeError'
       WHEN error = 'response: not an object' THEN 'TypeError'
       WHEN error LIKE '%field required' THEN 'KeyError'
       WHEN error LIKE '%not an allowed value' THEN 'ValueError'
       ELSE 'ValidationError' END AS error_type,
  {', '.join(f"CASE WHEN error IS NULL AND kind = '{kind}' THEN {sql} END AS {name}"
             for name, (kind, sql) in ANSWER_COLUMNS.items())} FROM h""",
    "route_conversation": f"""WITH {FINAL} SELECT {K},
  CASE WHEN urgency = 'Critical' THEN 'senior_agent' WHEN requires_escalation THEN 'supervisor'
       WHEN has_pii THEN 'compliance_review' ELSE 'available_agent' END AS route FROM g""",
    "high_urgency": f"WITH {FINAL} SELECT {K}, urgency FROM g WHERE urgency IN ('High', 'Critical')",
    "completeness": f"""WITH {CHANGES} SELECT {K}, seq, sentiment IS NOT NULL AS has_sentiment,
  any_pii AS has_pii, intent IS NOT NULL AS has_insights, tldr IS NOT NULL AS has_summary,
  sentiment IS NOT NULL AND any_pii AND intent IS NOT NULL AND tldr IS NOT NULL AS complete
FROM g""",
    "attach_summary_asof": ASOF_SQL,
    "attach_summary_asof_large_keys": ASOF_SQL,
    "merge_intelligence": CHANGE_LOG,
    "merge_intelligence_large_keys": CHANGE_LOG,
    "stream_merge_intelligence": CHANGE_LOG,
    "pii_tombstone": f"""WITH {RAW} SELECT 'pii-' || user_id AS pii_id, ts, seq, value FROM c x
WHERE topic = 'support.ai.pii' AND NOT EXISTS (SELECT 1 FROM c y WHERE y.event_type = 'error'
  AND y.user_id = x.user_id AND (y.ts, y.seq) >= (x.ts, x.seq))""",
    "pii_reference": f"""WITH {RAW} SELECT 'pii-' || x.user_id AS pii_ref, x.seq,
  x.key AS conversation_id, (SELECT arg_max(value, seq) FROM c y
    WHERE y.user_id = x.user_id AND y.topic = 'support.ai.pii') AS pii_value
FROM c x WHERE topic = 'support.ai.insights'""",
    "latest_summary": latest_sql("conversation_id", ["tenant_id", *SUMMARY_COLUMNS]),
    "stream_latest_summary": latest_sql("conversation_id", ["tenant_id", *SUMMARY_COLUMNS]),
    "latest_summary_by_tenant": latest_sql(K, list(SUMMARY_COLUMNS)),
    "latest_record": f"""WITH {TYPED}, z AS (SELECT *, max(seq) OVER (PARTITION BY {K}, kind) AS top
  FROM r) SELECT {K}, kind, seq, sentiment, confidence, emotion, reasoning, found AS has_pii,
  CASE WHEN kind = 'pii' THEN coalesce((SELECT string_agg(type || ':' || value || ':' ||
    start_index || ':' || end_index, '|' ORDER BY place) FROM ent WHERE ent.seq = z.seq), '') END
    AS entities,
  redacted_text, {', '.join([*INSIGHT_COLUMNS, *SUMMARY_COLUMNS])} FROM z WHERE seq = top""",
    "conversation_state": STATE,
    "conversation_state_large_keys": STATE,
    "conversation_state_ties": state_sql(
        f"b AS ({duck(A.MIXED_MESSAGES)}), m AS (SELECT * FROM b WHERE message <> '')", "m"),
    "transcript_ties": transcript_sql(
        f"b AS ({duck(A.MIXED_MESSAGES)}), m AS (SELECT * FROM b WHERE message <> '')", "m", 7),
    "stream_conversation_state": STATE,
    "conversation_final": f"""SELECT {K}, message_count, created_at, last_activity, participants,
  recent FROM ({STATE}) QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY seq DESC) = 1""",
    "merge_intelligence_final": f"WITH {FINAL} SELECT {K}, {MERGED_LIST}, last_updated FROM g",
    "pii_sticky": f"""WITH {TYPED} SELECT {K}, seq, found, (SELECT bool_or(y.found) FROM r y
    WHERE y.tenant_id = x.tenant_id AND y.conversation_id = x.conversation_id
      AND y.seq <= x.seq) AS has_pii FROM r x WHERE kind = 'pii'""",
    "pii_entity_merge": f"""WITH {TYPED} SELECT {K}, since_seq, place, type, value, start_index
FROM kept""",
    "qa_metrics": f"""WITH {FINAL} SELECT tenant_id, count(*) AS total_conversations,
  cast(0 AS bigint) AS avg_resolution_time,
  count(*) FILTER (WHERE sentiment = 'positive') AS customer_satisfaction,
  count(*) FILTER (WHERE requires_escalation) AS escalation_rate,
  round(count(*) FILTER (WHERE sentiment = 'positive') / count(*), 6) AS positive_share,
  round(count(*) FILTER (WHERE requires_escalation) / count(*), 6) AS escalated_share
FROM g GROUP BY tenant_id""",
    "intent_urgency_report": f"""WITH {FINAL} SELECT tenant_id, intent, urgency,
  count(*) AS conversations FROM g WHERE intent IS NOT NULL GROUP BY ALL""",
    "rolling_last10": f"""WITH {B}, {numbered('m')} SELECT {K}, seq,
  {window_text(10, 'y.message', "'|'")} AS recent FROM n x""",
    "context_last5": f"""WITH {TURNS}, {numbered('a')} SELECT {K}, seq,
  {window_text(5, CAPITAL, 'chr(10)')} AS context FROM n x""",
    "message_ordinal": f"WITH {B}, {numbered('m')} SELECT {K}, seq, nr AS message_number FROM n",
    "running_latest": f"""WITH {TYPED} SELECT {K}, seq, {', '.join(
        f"(SELECT arg_max(y.{c}, y.seq) FROM r y WHERE y.tenant_id = x.tenant_id AND "
        f"y.conversation_id = x.conversation_id AND y.seq <= x.seq AND y.kind = '{kind}') "
        f"AS {kind}" for kind, c in (("sentiment", "reasoning"), ("pii", "redacted_text"),
                                      ("insights", "intent"), ("summary", "tldr")))} FROM r x""",
    "trailing_rate": rate_sql("user_id", 6 * 3600, 2),
    "trailing_rate_by_tenant": rate_sql("tenant_id", 3600, 5),
    "tail_n": f"""WITH {B} SELECT {K}, seq, sender, message FROM m
QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ts DESC, seq DESC) <= 5""",
    "sentiment_context": f"""WITH {ASOF}, {numbered('asof_rows')} SELECT {K}, seq,
  CASE WHEN coalesce(tldr, '') <> '' AND nr > 1 THEN 'Background Context: ' || tldr || chr(10)
    || chr(10) || 'Recent Conversation:' || chr(10)
    || {window_text(5, "upper(y.sender) || ': ' || y.message", 'chr(10)')} || {SENTIMENT_TAIL}
  ELSE 'Conversation:' || chr(10)
    || {window_text(10, "upper(y.sender) || ': ' || y.message", 'chr(10)')} || {SENTIMENT_TAIL}
  END AS context FROM n x""",
    "insights_context": f"""WITH {B}, {numbered('m')} SELECT {K}, seq,
  {window_text(5, CAPITAL, 'chr(10)')} AS context FROM n x""",
    "summary_context": f"""WITH {ASOF} SELECT {K}, seq, CASE WHEN source IS NULL
  THEN 'No previous summary (start of conversation).'
  ELSE chr(10) || 'Previous Summary:' || chr(10) || '- TLDR: ' || tldr || chr(10) || '- Issue: '
    || customer_issue || chr(10) || '- Key Points: ' || replace(key_points, '|', ', ') || chr(10)
    || '- Next Steps: ' || replace(next_steps, '|', ', ') || chr(10) END
  || chr(10) || chr(10) || 'New Message from ' || sender || ':' || chr(10) || '"' || message
  || '"' AS context FROM asof_rows""",
    "transcript": transcript_sql(TURNS, "a", 1000),
    "transcript_large_keys": transcript_sql(B, "m", 8),
    "running_transcript": f"""WITH {TURNS}, {numbered('a')} SELECT {K}, seq,
  nr AS message_number, cast((nr - 1) // 1000 AS bigint) AS part, sender || ': ' || message AS line
FROM n""",
    "reply_context": reply_sql(TURNS, "a", 1000),
    "reply_context_long": reply_sql(
        f"{B}, by_tenant AS (SELECT * REPLACE (tenant_id AS conversation_id) FROM m)", "by_tenant", 100),
    "detect_pii": f"""WITH {PII} SELECT w.seq, entities IS NOT NULL AS has_pii,
  coalesce(entities, '') AS entities, redacted_text
FROM w LEFT JOIN listing USING (seq) JOIN clean USING (seq)""",
    "detect_pii_documents": """WITH t AS (SELECT doc_id, source,
  regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\pZ]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\pZ]+$',
    '', 'g') AS t FROM documents),
ph AS (SELECT *, list_filter(regexp_extract_all(t, '[\\pL\\pN_]+'),
  lambda z: regexp_full_match(z, '\\p{Nd}{8,15}')) AS phones,
  regexp_extract_all(t,
    '(?i)account[\\s\\pZ]+(?:number[\\s\\pZ]+)?(?:ending[\\s\\pZ]+)?\\p{Nd}+') AS accounts,
  regexp_extract_all(t, 'My name is ([A-Z][a-z]+ [A-Z][a-z]+)', 1) AS names FROM t)
SELECT doc_id, source, len(phones) + len(accounts) + len(names) > 0 AS has_pii,
  cast(len(phones) + len(accounts) + len(names) AS bigint) AS entities,
  cast(length(t) - coalesce(list_sum(list_transform(phones, lambda z: length(z) - 10)), 0)
    - coalesce(list_sum(list_transform(list_filter(list_transform(accounts,
        lambda z: regexp_extract(z, '\\p{Nd}+$')),
        lambda z: NOT list_contains(phones, z)), lambda z: length(z) - 10)), 0)
    - coalesce(list_sum(list_transform(names, lambda z: length(z) - 10)), 0) AS bigint)
    AS redacted_chars,
  sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '(^|[^\\pL\\pN_])\\p{Nd}{8,15}($|[^\\pL\\pN_])', '\\1[REDACTED]\\2', 'g'),
    '(^|[^\\pL\\pN_])\\p{Nd}{8,15}($|[^\\pL\\pN_])', '\\1[REDACTED]\\2', 'g'),
    '((?i)account[\\s\\pZ]+(?:number[\\s\\pZ]+)?(?:ending[\\s\\pZ]+)?)\\p{Nd}+', '\\1[REDACTED]', 'g'),
    '(My name is )[A-Z][a-z]+ [A-Z][a-z]+', '\\1[REDACTED]', 'g')) AS redacted_sha256 FROM ph""",
    "redact": f"WITH {PII} SELECT seq, redacted_text FROM clean",
    "pii_counts": f"""WITH {PII} SELECT tenant_id, type, count(*) AS entities FROM placed
GROUP BY ALL""",
    "score": f"""WITH {B} SELECT {K}, seq, NULL AS error,
  CASE WHEN message LIKE '%account%' THEN 'Account Issue' ELSE 'General Inquiry' END AS intent,
  CASE WHEN message LIKE '%account%' THEN 'High' ELSE 'Low' END AS urgency,
  message LIKE '%account%' AS requires_escalation FROM m""",
    "intelligence_job": JOB,
    "extension_point": f"WITH {B} SELECT sender, count(*) AS messages FROM m GROUP BY sender",
    "record_extension": f"""WITH {RAW} SELECT src_offset AS "offset", 't' || (user_id % 3) AS tenant,
  unnest(range(user_id % 3)) AS part, length(value) AS chars FROM c""",
    "summary_fold": f"""WITH {B}, {numbered('m')} SELECT {K}, seq,
  nr || ' messages, last from ' || sender AS tldr,
  first_value(message) OVER w AS customer_issue,
  last_value(CASE WHEN sender = 'agent' THEN message END IGNORE NULLS) OVER w AS agent_response,
  sender AS key_points, '' AS next_steps
FROM n WINDOW w AS (PARTITION BY {K} ORDER BY nr ROWS UNBOUNDED PRECEDING)""",
}

# Streams give what their batch twins give.
ORACLES["stream_summary_fold"] = ORACLES["summary_fold"]
ORACLES["stream_dead_letter"] = f"""WITH {PARSED}
SELECT topic AS original_topic, src_partition AS original_partition, src_offset AS original_offset,
  key, value, error,
  CASE WHEN j IS NULL THEN 'JSONDecodeError' ELSE 'ValidationError' END AS error_type,
  'dlq_source_topic=' || topic || '|dlq_error=' || error AS headers
FROM e WHERE error IS NOT NULL"""
ORACLES["stream_change_feed"] = f"""WITH {CHANGES}
SELECT 'intelligence_update' AS type, {K}, sentiment, tldr, last_updated FROM g
WHERE sentiment IS NOT NULL AND any_pii AND intent IS NOT NULL AND tldr IS NOT NULL"""


# -- rows out of order, with equal times ---------------------------------------

def renumbered(adapter: str) -> str:
    """An adapter's rows with their place in the order of (ts, seq) as ``seq``."""
    return (f"SELECT * REPLACE (row_number() OVER (ORDER BY ts, seq) AS seq), seq AS event "
            f"FROM ({duck(adapter)})")


def tied(sql: str, seq: str | None = "seq") -> str:
    """The same query over mixed rows. Within it ``seq`` alone is the order; ``seq`` names the
    column of the result that is turned back into the number of the event."""
    for plain, mixed in ((A.RESULTS, A.MIXED_RESULTS), (A.MESSAGES, A.MIXED_MESSAGES)):
        sql = sql.replace(f"({duck(plain)})", f"({renumbered(mixed)})")
    if seq is None:
        return sql
    return (f"SELECT q.* REPLACE (o.event AS {seq}) FROM ({sql}) q "
            f"JOIN ({renumbered(A.MIXED_RESULTS)}) o ON q.{seq} = o.seq")


for _name, _seq in (("merge_intelligence", "seq"), ("merge_intelligence_final", None),
                    ("running_latest", "seq"), ("pii_sticky", "seq"),
                    ("pii_entity_merge", "since_seq"), ("latest_record", "seq"),
                    ("attach_summary_asof", "seq"), ("sentiment_context", "seq")):
    ORACLES[f"{_name}_ties"] = tied(ORACLES[_name], _seq)

# -- readers, spans ------------------------------------------------------------

ORACLES["stream_read_events"] = ORACLES["read_events"]
ORACLES["declare_stream_dead"] = f"""WITH {PARSED} SELECT topic AS original_topic,
  src_partition AS original_partition, src_offset AS original_offset, key, value,
  'value: not JSON' AS error, 'JSONDecodeError' AS error_type FROM p WHERE j IS NULL"""
ORACLES["read_versions"] = f"""WITH raw AS ({duck(A.TURNS)}), {B}
SELECT conversation_id || '-' || seq AS message_id, message AS content, 'normal' AS priority,
  cast(1 AS bigint) AS schema_version FROM raw
UNION ALL SELECT conversation_id || '-' || seq, message,
  CASE WHEN seq % 5 > 0 THEN event_type END, 2 FROM b"""
ORACLES["redact_spans"] = """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents),
s AS (SELECT doc_id, n, (doc_id * 7 + i * i * 13) % (n + 20) - 5 AS a, (doc_id + i * 5) % 23 - 2 AS l
  FROM d, range(10) t(i)),
r AS (SELECT doc_id, greatest(a, 0) AS a, least(a + l, n) AS z FROM s
  WHERE greatest(a, 0) < least(a + l, n)),
f AS (SELECT *, CASE WHEN a >= coalesce(max(z) OVER (PARTITION BY doc_id ORDER BY a, z
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS fresh FROM r),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, z
  ROWS UNBOUNDED PRECEDING) AS piece FROM f),
u AS (SELECT doc_id, piece, min(a) AS a, max(z) AS z FROM g GROUP BY ALL),
p AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM u),
o AS (SELECT doc_id, string_agg(substring(text, before + 1, a - before) || '[REDACTED]', ''
    ORDER BY a) || substring(any_value(text), max(z) + 1) AS t FROM p JOIN d USING (doc_id)
  GROUP BY doc_id)
SELECT doc_id, length(coalesce(t, text)) AS redacted_chars,
  sha256(coalesce(t, text)) AS redacted_sha256 FROM d LEFT JOIN o USING (doc_id)"""

# -- streams with state per key ------------------------------------------------

# A conversation's number changes with every gap of more than twelve hours.
EPISODES = f"""{B},
gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL '12' HOUR THEN 1 ELSE 0 END AS gap
  FROM m WINDOW w AS (PARTITION BY {K} ORDER BY ts, seq)),
cut AS (SELECT * REPLACE (conversation_id || '/' || sum(gap) OVER (PARTITION BY {K}
  ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS conversation_id) FROM gaps)"""
ORACLES["stream_expiring_state"] = f"""SELECT * REPLACE (split_part(conversation_id, '/', 1)
  AS conversation_id) FROM ({state_sql(EPISODES, 'cut')})"""
ORACLES["stream_state_with_summary"] = f"""SELECT {K}, seq, ts, message_count, participants, recent,
  tldr, customer_issue, agent_response, key_points, next_steps
FROM ({STATE}) JOIN ({ASOF_SQL}) USING ({K}, seq, ts)"""
ORACLES["stream_entities"] = ORACLES["pii_entity_merge"]
ORACLES["stream_merge_parts"] = ORACLES["merge_intelligence_final"]
SAID = f"({', '.join(n for n in MERGED_NAMES)})"
ORACLES["stream_updates"] = f"""WITH {CHANGES},
whole AS (SELECT *, {SAID} IS NOT DISTINCT FROM lag({SAID}) OVER w AND row_number() OVER w > 1 AS same
  FROM g WHERE sentiment IS NOT NULL AND any_pii AND intent IS NOT NULL AND tldr IS NOT NULL
  WINDOW w AS (PARTITION BY {K} ORDER BY seq))
SELECT {K}, seq, 'intelligence_update' AS type, reasoning, tldr FROM whole WHERE NOT same"""
ORACLES["stream_retention"] = f"""WITH c AS ({duck(A.LATE_RESULTS)}),
s AS (SELECT topic, seq, ts, seq * 3 // (max(seq) OVER () + 1) AS slice FROM c),
m AS (SELECT x.topic, x.slice, max(y.ts) AS mark FROM (SELECT DISTINCT topic, slice FROM s) x
  JOIN s y ON y.topic = x.topic AND y.slice <= x.slice GROUP BY ALL),
k AS (SELECT s.*, s.ts <= mark - INTERVAL '24' HOUR AS late, max(mark) OVER (PARTITION BY topic)
  AS newest FROM s JOIN m USING (topic, slice))
SELECT topic, seq, ts, CASE WHEN late THEN 'expired' ELSE 'kept' END AS place FROM k
WHERE late OR ts > newest - INTERVAL '24' HOUR"""
ORACLES["stream_unanswered"] = f"""WITH {B},
x AS (SELECT *, lead(ts) OVER (PARTITION BY {K} ORDER BY ts, seq) AS after FROM m
  WHERE sender IN ('customer', 'agent'))
SELECT {K}, ts, seq, ts + INTERVAL '12' HOUR AS due FROM x WHERE sender = 'customer'
  AND (after > ts + INTERVAL '12' HOUR OR (after IS NULL
    AND ts + INTERVAL '12' HOUR < (SELECT max(ts) FROM m)))"""
