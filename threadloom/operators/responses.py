"""Texts a scorer returns, turned into agent results.

The answer may be fenced, a list with one object, and uses camelCase names. A
default applies only where a field is absent; an explicit null fails the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import variants as v
from threadloom.functions.text import strip
from threadloom.operators.results import DOC, Entities
from threadloom.schema import EMOTIONS, INTENTS, PAYLOADS, SENTIMENTS, URGENCIES


def unfenced(text: Column) -> Column:
    """The text without a code fence: first line, and last line if it closes it."""
    t = strip(text)
    rows = F.split(t, "\n", -1)
    body = F.slice(rows, 2, F.size(rows))
    closed = (F.size(body) > 0) & (strip(F.try_element_at(body, F.lit(-1))) == "```")
    inner = F.when(closed, F.slice(body, 1, F.greatest(F.size(body) - 1, F.lit(0)))) \
        .otherwise(body)
    return F.when(t.startswith("```"), strip(F.array_join(inner, "\n"))).otherwise(t)


# Name in the answer, name in the record, whether it is required.
FIELDS = {
    "sentiment": [("sentiment", "sentiment", True), ("confidence", "confidence", True),
                  ("emotion", "emotion", True), ("reasoning", "reasoning", True)],
    "pii": [("hasPII", "has_pii", True), ("entities", "entities", False),
            ("redactedText", "redacted_text", False)],
    "insights": [("intent", "intent", True), ("urgency", "urgency", True),
                 ("categories", "categories", False),
                 ("suggestedActions", "suggested_actions", False),
                 ("requiresEscalation", "requires_escalation", True),
                 ("estimatedResolutionTime", "estimated_resolution_time", True),
                 ("keyConcerns", "key_concerns", False)],
    "summary": [("tldr", "tldr", True), ("customerIssue", "customer_issue", True),
                ("agentResponse", "agent_response", False), ("keyPoints", "key_points", False),
                ("nextSteps", "next_steps", False)],
}
FOUND = Entities("startIndex", "endIndex")


def _member(name: str, allowed: tuple[str, ...]) -> tuple[str, str]:
    return f"{v.string(DOC, name)} IN ({v.quoted(allowed)})", f"{name}: not an allowed value"


def _each(condition: str) -> str:
    """``condition`` on every entity ``e``; holds if the answer has no entities."""
    return f"({v.absent(DOC, 'entities')} OR forall({FOUND.items}, e -> {condition}))"


COMPLETE = " AND ".join(v.present("e", n) for n in ("type", "startIndex", "endIndex"))
# Values that must convert before a record can be made.
CONVERSIONS = {
    "sentiment": [_member("sentiment", SENTIMENTS),
                  (f"({v.number(DOC, 'confidence')}) IS NOT NULL", "confidence: number required"),
                  _member("emotion", EMOTIONS)],
    "pii": [(_each(FOUND.known_type), "entities: not an allowed type")],
    "insights": [_member("intent", INTENTS), _member("urgency", URGENCIES)],
    "summary": [],
}
RANGE = f"({v.number(DOC, 'confidence')}) BETWEEN 0 AND 1", "confidence: outside 0 to 1"

def _contract(kind: str) -> list[tuple[str, str]]:
    """The checks of the result record, by the type of each field."""
    checks = [RANGE] if kind == "sentiment" else []
    converted = {"sentiment", "emotion", "confidence", "intent", "urgency"}
    for name, target, required in FIELDS[kind]:
        record_type = PAYLOADS[kind][target].dataType.simpleString()
        if target in converted:
            continue
        if target == "entities":
            checks.append((_each(FOUND.well_formed), "entities: not an allowed entity"))
        elif record_type == "boolean":
            checks.append((f"({v.boolean(DOC, name)}) IS NOT NULL",
                           f"{target}: true or false required"))
        elif record_type == "array<string>":
            checks.append((f"({v.absent(DOC, name)} OR ({v.strings(DOC, name)}) IS NOT NULL)",
                           f"{target}: not a list of texts"))
        elif required:
            checks.append((v.is_string(DOC, name), f"{target}: text required"))
        else:
            checks.append((f"({v.missing_or_null(DOC, name)} OR {v.is_string(DOC, name)})",
                           f"{target}: not a text"))
    return checks


def _missing(kind: str) -> str:
    """Name of the first absent required field."""
    cases = [f"WHEN {v.absent(DOC, name)} THEN '{name}'"
             for name, _, required in FIELDS[kind] if required]
    if kind == "pii":
        cases.append(f"WHEN NOT coalesce({_each(COMPLETE)}, true) THEN 'entities'")
    return f"CASE {' '.join(cases)} END"


def _value(name: str, target: str, record_type: str) -> str:
    if target == "entities":
        return f"coalesce({FOUND.built}, array())"
    return v.typed(DOC, name, record_type)


def _payload(kind: str, ts: str) -> str:
    record = PAYLOADS[kind]
    pairs = [f"'{target}', {_value(name, target, record[target].dataType.simpleString())}"
             for name, target, _ in FIELDS[kind]]
    return f"named_struct({', '.join(pairs)}, 'timestamp', {ts})"


def _by_kind(kind: str, values: dict[str, str]) -> Column:
    cases = " ".join(f"WHEN {kind} = '{k}' THEN {value}" for k, value in values.items())
    return F.expr(f"CASE {cases} END")


def parse_model_response(responses: DataFrame, response: str = "response",
                         kind: str = "kind", ts: str = "ts") -> DataFrame:
    """Answers to typed payloads: one struct column per kind, ``error``, ``error_type``.

    ``kind`` says what was asked for. An answer that is not JSON, one that lacks
    a required field, one whose value does not convert and one that breaks the
    record contract are told apart by ``error_type``.
    """
    names = tuple(dict.fromkeys(name for fields in FIELDS.values() for name, _, _ in fields))
    body = unfenced(F.col(response))
    df = v.with_fields(responses, DOC, body, names, first_of_list=True)
    conversions = {k: v.first_error(*checks) for k, checks in CONVERSIONS.items() if checks}
    df = df.withColumns({
        "_missing": _by_kind(kind, {k: _missing(k) for k in FIELDS}),
        "_unfit": _by_kind(kind, conversions),
        "_broken": _by_kind(kind, {k: v.first_error(*_contract(k)) for k in FIELDS})})
    # Only the answers that gave no fields are parsed again, to say why.
    unread = F.when(v.whole_json(body).isNull(), "response: not JSON").otherwise(
        "response: not an object")
    error = F.when(F.col(DOC).isNull(), F.struct(
        unread.alias("error"), F.lit(None).cast("string").alias("type"))).otherwise(F.expr(
            "CASE WHEN _missing IS NOT NULL THEN named_struct('error', "
            "concat(_missing, ': field required'), 'type', 'KeyError') "
            "WHEN _unfit IS NOT NULL THEN named_struct('error', _unfit, 'type', 'ValueError') "
            "WHEN _broken IS NOT NULL THEN "
            "named_struct('error', _broken, 'type', 'ValidationError') END"))
    # Once per row: filters on the error read its value instead of repeating the checks.
    df = v.with_once(df, "_failed", error).withColumns({
        "error": F.col("_failed.error"),
        "error_type": F.expr(
            "CASE _failed.error WHEN 'response: not JSON' THEN 'JSONDecodeError' "
            "WHEN 'response: not an object' THEN 'TypeError' ELSE _failed.type END")})
    return df.withColumns({
        k: F.expr(f"cast(CASE WHEN {kind} = '{k}' AND error IS NULL THEN {_payload(k, ts)} END "
                  f"AS {record.simpleString()})") for k, record in PAYLOADS.items()
    }).drop(DOC, "_missing", "_unfit", "_broken", "_failed")
