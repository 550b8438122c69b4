"""Requests to messages: checks, defaults, stable ids, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import blank_to
from threadloom.functions.variants import first_error, quoted
from threadloom.schema import (CHANNELS, DEFAULT_CHANNEL, DEFAULT_TENANT, MAX_MESSAGE_CHARS,
                               SENDERS)


def position_id(*position: str) -> Column:
    """An id that a replay of the same source rows gives again."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in position]), 256)


def validate_message(requests: DataFrame) -> DataFrame:
    """Add ``error`` and ``error_type`` (both null for a valid request).

    ``channel`` may be left out; length counts characters. What ``read_requests`` found
    comes first.
    """
    channel = (f"coalesce(channel, '{DEFAULT_CHANNEL}')" if "channel" in requests.columns
               else f"'{DEFAULT_CHANNEL}'")
    error = F.expr(first_error(
        ("conversation_id IS NOT NULL", "conversation_id: field required"),
        (f"sender IN ({quoted(SENDERS)})", "sender: not an allowed value"),
        ("message IS NOT NULL", "message: field required"),
        ("length(message) >= 1", "message: shorter than 1 character"),
        (f"length(message) <= {MAX_MESSAGE_CHARS}", "message: longer than 10000 characters"),
        (f"{channel} IN ({quoted(CHANNELS)})", "channel: not an allowed value")))
    kind = F.when(F.col("error").isNotNull(), F.lit("ValidationError"))
    if "request_error" in requests.columns:
        error = F.coalesce("request_error", error)
        kind = F.coalesce("request_error_type", kind)
    return requests.withColumn("error", error).withColumn("error_type", kind)


def normalize_message(requests: DataFrame, position: tuple[str, ...] = ("topic", "partition",
                                                                        "offset"),
                      default_tenant: str = DEFAULT_TENANT) -> DataFrame:
    """Fill the defaults and give each message an id made from its source position."""
    return (requests
            .withColumn("message_id", position_id(*position))
            .withColumn("tenant_id", blank_to(F.col("tenant_id"), default_tenant))
            .withColumn("channel", F.coalesce(F.col("channel"), F.lit(DEFAULT_CHANNEL))))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error").isNull()).drop("error", "error_type", "request_error",
                                                        "request_error_type")


def dead_letters(checked: DataFrame, value: Column | None = None) -> DataFrame:
    """Rows that failed a check, as dead-letter records.

    The value stays the raw text, so a record that is not JSON is kept as well.
    Needs topic, partition, offset, key and value; existing headers are kept.
    """
    raw = F.col("value") if value is None else value
    added = F.array(
        F.struct(F.lit("dlq_source_topic").alias("key"),
                 F.col("topic").cast("binary").alias("value")),
        F.struct(F.lit("dlq_error").alias("key"), F.col("error").cast("binary").alias("value")))
    headers = F.concat(F.coalesce(F.col("headers"), F.array()), added) \
        if "headers" in checked.columns else added
    return checked.filter(F.col("error").isNotNull()).select(
        F.col("topic").alias("original_topic"),
        F.col("partition").alias("original_partition"),
        F.col("offset").alias("original_offset"),
        F.col("key"), raw.alias("value"), "error", "error_type", headers.alias("headers"))


def drop_keyless(results: DataFrame) -> DataFrame:
    """Results without a conversation or tenant are skipped, not dead-lettered."""
    return results.filter((F.coalesce(F.col("conversation_id"), F.lit("")) != "")
                          & (F.coalesce(F.col("tenant_id"), F.lit("")) != ""))
