"""Spark session with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Per-key stream state lives on disk, not on the executor heap. Steps with several state
# variables (``streaming.keyed``) run with no other store of Spark's.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Re-plan at run time: merge small shuffle partitions, split skewed join
    # partitions, switch to a broadcast join once a side is known to be small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Python's JSON reader keeps the last of two equal keys.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    STATE_STORE: ROCKSDB,
    "spark.ui.enabled": "false",
}


def session(app: str = "threadloom", master: str | None = None,
            shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Build (or get) a session. Leave ``master`` unset on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
