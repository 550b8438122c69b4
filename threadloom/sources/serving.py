"""Merged records stored for lookups, and the lookups.

A record lies in the folder of its tenant and of a hash of its conversation, sorted by
conversation there. One lookup reads one folder, and in it the row groups whose range and
Bloom filter may hold the conversation. Many lookups at once read the folders that the
requests name, found while the query runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import blank_to
from threadloom.schema import DEFAULT_TENANT, KEYS

BUCKET, LAYOUT = "bucket", "_layout"


def bucket_of(conversation: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(conversation), F.lit(buckets)).cast("int")


def write_serving(merged: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Store merged records for lookups; ``buckets`` folders per tenant.

    Ranges of (tenant, bucket, conversation) are of even size, so a large tenant is written
    by many tasks and a small one by one.
    """
    place = ["tenant_id", BUCKET, "conversation_id"]
    rows = merged.withColumn(BUCKET, bucket_of(F.col("conversation_id"), buckets))
    (rows.repartitionByRange(*place).sortWithinPartitions(*place)
     .write.mode(mode).option("parquet.bloom.filter.enabled#conversation_id", "true")
     .partitionBy("tenant_id", BUCKET).parquet(path))
    (merged.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1)
     .write.mode("overwrite").json(f"{path}/{LAYOUT}"))


@dataclass(frozen=True)
class Serving:
    """A stored table of merged records."""

    table: DataFrame
    buckets: int

    def lookup(self, conversation_id: str, tenant_id: str | None = None,
               default_tenant: str = DEFAULT_TENANT) -> DataFrame:
        """The record of one conversation; no rows if there is none."""
        wanted = F.lit(conversation_id)
        return self.table.filter(
            (F.col("tenant_id") == (tenant_id or default_tenant))
            & (F.col(BUCKET) == bucket_of(wanted, self.buckets))
            & (F.col("conversation_id") == wanted)).drop(BUCKET)

    def lookup_many(self, requested: DataFrame, default_tenant: str = DEFAULT_TENANT) -> DataFrame:
        """The records of many requested conversations, each once.

        Requests are joined by size: a short list is broadcast, and its folders are the only
        ones that are read. Requests without a conversation have no record.
        """
        wanted = (requested.filter(F.length("conversation_id") > 0)
                  .select("conversation_id",
                          blank_to(F.col("tenant_id"), default_tenant).alias("tenant_id"),
                          bucket_of(F.col("conversation_id"), self.buckets).alias(BUCKET))
                  .distinct())
        return self.table.join(wanted, [*KEYS, BUCKET]).select(
            *[c for c in self.table.columns if c != BUCKET])


def read_serving(spark: SparkSession, path: str) -> Serving:
    """The table that ``write_serving`` stored."""
    buckets = spark.read.schema("buckets int").json(f"{path}/{LAYOUT}").first()[0]
    return Serving(spark.read.parquet(path), buckets)
