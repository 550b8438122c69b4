"""Agent results: kind by the fields present, typed payloads, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import variants as v
from threadloom.schema import (EMOTIONS, INTENTS, KIND_FIELDS, PAYLOADS, PII_TYPES, REDACTED,
                               SENTIMENTS, URGENCIES)

DOC = "_doc"
KEYED = "(coalesce(conversation_id, '') <> '' AND coalesce(tenant_id, '') <> '')"


FIELDS = tuple(dict.fromkeys(
    ["conversation_id", "tenant_id", *[f.name for r in PAYLOADS.values() for f in r.fields]]))


def with_document(results: DataFrame, value: str = "value") -> DataFrame:
    """Parse the JSON text once; all checks below read the parsed fields."""
    return v.with_fields(results, DOC, F.col(value), FIELDS)


def classify_result(results: DataFrame) -> DataFrame:
    """Add ``kind``: by presence of two fields, in a fixed order.

    Null fields are present. ``kind`` is null where the value is no JSON object.
    """
    parsed = results if DOC in results.columns else with_document(results)
    cases = " ".join(f"WHEN {v.present(DOC, one)} AND {v.present(DOC, two)} THEN '{name}'"
                     for name, one, two in KIND_FIELDS)
    return parsed.withColumn("kind", F.expr(
        f"CASE WHEN {DOC} IS NULL THEN NULL {cases} ELSE 'unknown' END"))


def result_keys(results: DataFrame) -> DataFrame:
    """Classified results with the two keys read from the value."""
    return classify_result(results).withColumns({
        key: F.expr(v.string(DOC, key)) for key in ("conversation_id", "tenant_id")})


# -- checks --------------------------------------------------------------------

def _text(name: str) -> tuple[str, str]:
    return v.is_string(DOC, name), f"{name}: text required"


def _optional_text(name: str) -> tuple[str, str]:
    return (f"({v.missing_or_null(DOC, name)} OR {v.is_string(DOC, name)})",
            f"{name}: not a text")


def _member(name: str, allowed: tuple[str, ...]) -> tuple[str, str]:
    return (f"({v.is_string(DOC, name)} AND {v.string(DOC, name)} IN ({v.quoted(allowed)}))",
            f"{name}: not an allowed value")


def _list(name: str) -> tuple[str, str]:
    return (f"({v.absent(DOC, name)} OR ({v.strings(DOC, name)}) IS NOT NULL)",
            f"{name}: not a list of texts")


def _flag(name: str) -> tuple[str, str]:
    return f"({v.boolean(DOC, name)}) IS NOT NULL", f"{name}: true or false required"


STAMP = f"try_cast({v.string(DOC, 'timestamp')} AS timestamp_ntz)"
TIME = f"({v.absent(DOC, 'timestamp')} OR {STAMP} IS NOT NULL)", "timestamp: not a time"
CONFIDENCE = f"({v.number(DOC, 'confidence')})"


@dataclass(frozen=True)
class Entities:
    """SQL for a list of entities, by the names its offsets have there."""

    start: str
    end: str

    @property
    def items(self) -> str:
        return v.get(DOC, "entities", "array<struct<type: variant, value: variant, "
                                      f"{self.start}: variant, {self.end}: variant>>")

    @property
    def known_type(self) -> str:
        return f"coalesce({v.string('e', 'type')} IN ({v.quoted(PII_TYPES)}), false)"

    @property
    def well_formed(self) -> str:
        whole = [f"{v.get('e', n, 'int')} IS NOT NULL" for n in (self.start, self.end)]
        return (f"({v.absent('e', 'value')} OR {v.is_string('e', 'value')}) "
                f"AND {' AND '.join(whole)}")

    @property
    def built(self) -> str:
        return (f"transform({self.items}, e -> named_struct('type', {v.string('e', 'type')}, "
                f"'value', coalesce({v.string('e', 'value')}, '{REDACTED}'), "
                f"'start_index', {v.get('e', self.start, 'int')}, "
                f"'end_index', {v.get('e', self.end, 'int')}))")


FOUND = Entities("start_index", "end_index")

CHECKS = {
    "sentiment": [
        _member("sentiment", SENTIMENTS),
        (f"{CONFIDENCE} IS NOT NULL", "confidence: number required"),
        (f"{CONFIDENCE} BETWEEN 0 AND 1", "confidence: outside 0 to 1"),
        _member("emotion", EMOTIONS), _text("reasoning"), TIME],
    "pii": [
        _flag("has_pii"), (f"{FOUND.items} IS NOT NULL", "entities: list required"),
        (f"forall({FOUND.items}, e -> {FOUND.known_type} AND {FOUND.well_formed})",
         "entities: not an allowed entity"),
        _optional_text("redacted_text"), TIME],
    "insights": [
        _member("intent", INTENTS), _member("urgency", URGENCIES), _list("categories"),
        _list("suggested_actions"), _flag("requires_escalation"),
        _text("estimated_resolution_time"), _list("key_concerns"), TIME],
    "summary": [
        _text("tldr"), _text("customer_issue"), _optional_text("agent_response"),
        _list("key_points"), _list("next_steps"), TIME],
}


def _value(name: str, kind: str) -> str:
    """SQL of one payload field, by its name and type."""
    if name == "timestamp":
        return f"coalesce({STAMP}, ts)"
    return FOUND.built if name == "entities" else v.typed(DOC, name, kind)


def validate_agent_result(results: DataFrame) -> DataFrame:
    """Add kind, keys, ``error`` and ``error_type`` to a frame of raw results.

    Rows without a key never fail a check: they are skipped later, as the
    contract wants. An unknown kind is valid.
    """
    ids = [_text("conversation_id"), _text("tenant_id")]
    cases = " ".join(f"WHEN {KEYED} AND kind = '{kind}' THEN {v.first_error(*ids, *checks)}"
                     for kind, checks in CHECKS.items())
    # Only the texts that gave no fields are parsed again, to say why.
    unread = F.when(v.whole_json(F.col("value")).isNull(), "value: not JSON").otherwise(
        "value: not an object")
    error = F.when(F.col(DOC).isNull(), unread).otherwise(F.expr(f"CASE {cases} END"))
    # Once per row: filters on the error read its value instead of repeating the checks.
    return (v.with_once(result_keys(results), "error", error)
            .withColumn("error_type", F.expr(
                "CASE error WHEN 'value: not JSON' THEN 'JSONDecodeError' "
                "WHEN 'value: not an object' THEN 'AttributeError' "
                "ELSE nvl2(error, 'ValidationError', NULL) END")))


def typed_results(checked: DataFrame) -> DataFrame:
    """Valid rows with keys, as typed payloads: one struct column per kind."""
    payloads = []
    for kind, record in PAYLOADS.items():
        pairs = ", ".join(f"'{f.name}', {_value(f.name, f.dataType.simpleString())}"
                          for f in record.fields)
        payloads.append(f"cast(CASE WHEN kind = '{kind}' THEN named_struct({pairs}) END "
                        f"AS {record.simpleString()}) AS {kind}")
    return (checked.filter(f"{DOC} IS NOT NULL AND {KEYED} AND error IS NULL")
            .selectExpr("tenant_id", "conversation_id", "kind", "ts", "seq", *payloads))


def results_from_json(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw topic rows to (typed results, checked rows for ``dead_letters``)."""
    checked = validate_agent_result(raw)
    return typed_results(checked), checked
