"""Writing records: keyed JSON for a topic, and the folders of intermediate results."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_MADE: dict[str, list[str]] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder, ``spark.checkpoint.dir``.

    Without that setting a local session works under its warehouse. A cluster's executors
    don't share the driver's disk, so there a warehouse on it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and _on_this_machine(spark, warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"{warehouse}/.work"
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _on_this_machine(spark: SparkSession, path: str) -> bool:
    scheme = urlparse(path).scheme or urlparse(
        spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")).scheme
    return scheme == "file"


def clear_work(spark: SparkSession) -> int:
    """Delete the folders this session made for itself; how many there were.

    To be called when nothing reads the frames of its queries any more.
    """
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in made:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(made)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For frames that are used several times and costly to compute. What follows
    starts from files that outlive any executor.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# Nulls are written, times to the microsecond.
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def keyed_json(records: DataFrame, key: str = "conversation_id", tenant: str | None = "tenant_id",
               columns: list[str] | None = None,
               position: tuple[str, ...] | None = None) -> DataFrame:
    """Key, JSON value and headers of every record, as a topic takes them.

    Headers: existing ones, the tenant, and a correlation id. The id is a hash of
    the source position (or of the record), so a retried task writes the same one.
    """
    fields = columns or [c for c in records.columns if c != "headers"]
    value = F.to_json(F.struct(*fields), JSON_OPTIONS)
    source = ([F.col(p).cast("string") for p in position] if position else [value])
    headers = F.array(_header("correlation_id", F.sha2(F.concat_ws("|", *source), 256)))
    if tenant:
        named = F.col(tenant)
        headers = F.concat(F.when(F.coalesce(named, F.lit("")) != "",
                                  F.array(_header("tenant_id", named)))
                           .otherwise(F.array()), headers)
    if "headers" in records.columns:
        headers = F.concat(F.coalesce(F.col("headers"), F.array()), headers)
    return records.select(F.col(key).cast("string").alias("key"), value.alias("value"),
                          headers.alias("headers"))


def _header(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))


def write_topic(rows: DataFrame, topic: str, servers: str) -> None:
    """Write keyed JSON rows of a batch to a broker topic. Needs the connector package."""
    (rows.write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("kafka.acks", "all").option("kafka.enable.idempotence", "true")
     .option("kafka.compression.type", "snappy").option("topic", topic).save())


def write_files(rows: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    rows.write.format(fmt).mode(mode).save(path)
