"""Personal data in messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.pii import ACCOUNT, NAME, PHONE, has_pii, pii, redacted
from threadloom.functions.spans import redact_spans as without_spans
from threadloom.functions.text import strip
from threadloom.schema import REDACTED


def detect_pii(messages: DataFrame, text: str = "message") -> DataFrame:
    """Add ``has_pii``, ``entities`` and ``redacted_text`` for a text column.

    Offsets refer to the trimmed text. Runs in the scan stage: no shuffle, no UDF.
    """
    found = messages.withColumn("_pii", pii(F.col(text)))
    empty = F.array().cast(found.schema["_pii"].dataType["entities"].dataType)
    return (found.withColumn("entities", F.coalesce("_pii.entities", empty))
            .withColumn("has_pii", F.size("entities") > 0)
            .withColumn("redacted_text", F.col("_pii.redacted_text")).drop("_pii"))


def redact_spans(rows: DataFrame, text: str = "message", spans: str = "entities",
                 marker: str = REDACTED) -> DataFrame:
    """Add ``redacted_text``: the text with the spans a model gave replaced.

    Spans may overlap, lie in each other, touch, be empty or reach out of the text; every
    stretch they cover is replaced once. Unlike ``detect_pii`` the text is not trimmed, as the
    offsets refer to it.
    """
    return rows.withColumn("redacted_text", without_spans(F.col(text), F.col(spans), marker))


def redact(messages: DataFrame, text: str = "message") -> DataFrame:
    """Add ``redacted_text`` only."""
    return messages.withColumn("redacted_text", redacted(F.col(text)))


def flag_pii(messages: DataFrame, text: str = "message") -> DataFrame:
    """Add ``has_pii`` only: three pattern tests, no lists."""
    return messages.withColumn("has_pii", has_pii(F.col(text)))


def count_pii(messages: DataFrame, text: str = "message") -> DataFrame:
    """Entities per tenant and type, without building any entity; one scan per pattern."""
    t = strip(F.col(text))
    kinds = {"phone": PHONE, "account_number": ACCOUNT, "name": NAME}
    sums = messages.groupBy("tenant_id").agg(
        *[F.sum(F.regexp_count(t, F.lit(p)).cast("bigint")).alias(k) for k, p in kinds.items()])
    return sums.unpivot("tenant_id", list(kinds), "type", "entities").filter("entities > 0")


def pii_results(messages: DataFrame, text: str = "message") -> DataFrame:
    """Messages as typed PII results, ready for the merge."""
    found = detect_pii(messages, text)
    return found.select(
        "tenant_id", "conversation_id", F.lit("pii").alias("kind"), "ts", "seq",
        F.struct("has_pii", "entities", "redacted_text",
                 F.col("ts").alias("timestamp")).alias("pii"))
