"""Views over results and merged records: latest values, lookups, routing, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import blank_to
from threadloom.schema import DEFAULT_TENANT, KEYS, RETENTION_SECONDS

SUMMARY_FIELDS = ("tldr", "customer_issue", "agent_response", "key_points", "next_steps")
POSITION = ("ts", "partition", "offset")


def latest_values(rows: DataFrame, keys: Sequence[str], columns: Sequence[str],
                  position: Sequence[str] = POSITION) -> DataFrame:
    """Per key, the newest non-null value of every column.

    A null in the newest row keeps the older value. Null keys are dropped.
    """
    at = F.struct(*position)
    some_key_null = [F.col(k).isNotNull() for k in keys]
    kept = rows
    for condition in some_key_null:
        kept = kept.filter(condition)
    return kept.groupBy(*keys).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def latest_summary(stream: DataFrame, position: Sequence[str] = POSITION) -> DataFrame:
    """Latest summary values per conversation id. Tenants that share an id share a row."""
    return latest_values(stream, ["conversation_id"], ["tenant_id", *SUMMARY_FIELDS], position)


def latest_summary_by_tenant(stream: DataFrame,
                             position: Sequence[str] = POSITION) -> DataFrame:
    """Latest summary values per tenant and conversation."""
    return latest_values(stream, list(KEYS), SUMMARY_FIELDS, position)


def lookup(merged: DataFrame, conversation_id: str, tenant_id: str | None = None,
           default_tenant: str = DEFAULT_TENANT) -> DataFrame:
    """The merged record of one conversation of any frame; no rows if there is none.

    Many lookups on one table are for ``sources.serving``, which stores it for them.
    """
    tenant = tenant_id or default_tenant
    return merged.filter((F.col("tenant_id") == tenant)
                         & (F.col("conversation_id") == conversation_id))


def intelligence_lookup(merged: DataFrame, requested: DataFrame,
                        default_tenant: str = DEFAULT_TENANT) -> DataFrame:
    """The merged records of many requested conversations."""
    wanted = (requested.withColumn("tenant_id", blank_to(F.col("tenant_id"), default_tenant))
              .select(*KEYS).distinct())
    return merged.join(wanted, list(KEYS), "left_semi")


def high_urgency(merged: DataFrame) -> DataFrame:
    return merged.filter(F.col("insights.urgency").isin("High", "Critical"))


def route(insights: Column, pii: Column) -> Column:
    return (F.when(F.lower(insights["urgency"]) == "critical", "senior_agent")
            .when(insights["requires_escalation"], "supervisor")
            .when(pii["has_pii"], "compliance_review")
            .otherwise("available_agent"))


def route_conversation(merged: DataFrame) -> DataFrame:
    """Who takes a conversation: the first rule that holds."""
    return merged.withColumn("route", route(F.col("insights"), F.col("pii")))


def qa_metrics(merged: DataFrame, *by: str) -> DataFrame:
    """Quality counts. The two first counts carry their published, rate-like names."""
    total = F.count(F.lit(1))
    positive = F.count_if(F.col("sentiment.sentiment") == "positive")
    escalated = F.count_if(F.coalesce(F.col("insights.requires_escalation"), F.lit(False)))
    return merged.groupBy(*by).agg(
        total.alias("total_conversations"), F.lit(0).alias("avg_resolution_time"),
        positive.alias("customer_satisfaction"), escalated.alias("escalation_rate"),
        F.round(positive / total, 6).alias("positive_share"),
        F.round(escalated / total, 6).alias("escalated_share"))


def intent_urgency_report(merged: DataFrame) -> DataFrame:
    return (merged.filter(F.col("insights").isNotNull())
            .groupBy("tenant_id", F.col("insights.intent").alias("intent"),
                     F.col("insights.urgency").alias("urgency"))
            .agg(F.count(F.lit(1)).alias("conversations")))


def retention_filter(rows: DataFrame, seconds: int = RETENTION_SECONDS, ts: str = "ts",
                     topic: str = "topic", now: Column | None = None) -> DataFrame:
    """Rows within the retention time, counted back from ``now`` or each topic's newest row.

    Without ``now`` the newest time per topic is found first and joined. Rows
    without a topic or a time are left out.
    """
    span = F.make_dt_interval(secs=F.lit(seconds))
    if now is not None:
        return rows.filter(F.col(ts) > now - span)
    newest = rows.groupBy(topic).agg(F.max(ts).alias("_newest"))
    return (rows.join(newest, topic).filter(F.col(ts) > F.col("_newest") - span)
            .select(*rows.columns))


def schema_evolve(old: DataFrame, new: DataFrame,
                  defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Rows of two schema versions together.

    A field one side lacks has its declared default there, and is null without one.
    """
    sides = [old, new]
    for name, value in (defaults or {}).items():
        kind = next((s.schema[name].dataType for s in sides if name in s.columns), None)
        sides = [s if name in s.columns or kind is None
                 else s.withColumn(name, F.lit(value).cast(kind)) for s in sides]
    return sides[0].unionByName(sides[1], allowMissingColumns=True)


def pii_tombstone(records: DataFrame, tombstones: DataFrame,
                  pii_id: str = "pii_id") -> DataFrame:
    """Records without those deleted by a later (or equally late) tombstone.

    Both sides carry ``ts`` and ``seq``; a record written after the newest
    tombstone of its id lives.
    """
    graves = tombstones.groupBy(pii_id).agg(F.max(F.struct("ts", "seq")).alias("_grave"))
    r, g = records.alias("r"), graves.alias("g")
    dead = (F.col(f"r.{pii_id}") == F.col(f"g.{pii_id}")) & (
        F.struct("r.ts", "r.seq") <= F.col("g._grave"))
    return r.join(g, dead, "left_anti")


def pii_reference(merged: DataFrame, pii: DataFrame, ref: str = "pii_ref",
                  pii_id: str = "pii_id") -> DataFrame:
    """Merged rows with the PII record their reference points at, if it exists."""
    target = pii.withColumnRenamed(pii_id, ref)
    return merged.join(target, ref, "left")
