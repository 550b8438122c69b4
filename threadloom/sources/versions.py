"""Files of several schema versions in one place.

Every version has a folder of its own, and a note of its fields with their declared defaults
beside it. A reader sees all files as one table: a field that a version doesn't have has the
default of the version that brought it in, a field that is there and null stays null.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, DECLARED = "schema_version", "_declared"


def write_version(rows: DataFrame, path: str, version: int,
                  defaults: Mapping[str, object] | None = None, mode: str = "append") -> None:
    """Write rows as files of one schema version; ``defaults`` are those of its new fields."""
    rows.write.mode(mode).parquet(f"{path}/{VERSION}={version}")
    declared = [(version, f.name, json.dumps((defaults or {}).get(f.name)))
                for f in rows.schema.fields]
    spark = rows.sparkSession
    (spark.createDataFrame(declared, "version int, field string, standard string").coalesce(1)
     .write.mode("overwrite").json(f"{path}/{DECLARED}/{version}"))


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all versions with the fields of all, and ``schema_version``.

    Only the notes reach the driver: versions times fields.
    """
    notes: dict[int, dict[str, object]] = {}
    for r in (spark.read.schema("version int, field string, standard string")
              .option("recursiveFileLookup", "true").json(f"{path}/{DECLARED}").collect()):
        notes.setdefault(r["version"], {})[r["field"]] = json.loads(r["standard"])
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    columns = []
    for field in rows.schema.fields:
        value = F.col(field.name)
        since = [v for v in sorted(notes) if field.name in notes[v]]
        lacking = [v for v in notes if field.name not in notes[v]]
        standard = notes[since[0]][field.name] if since else None
        if lacking and standard is not None:
            value = F.when(F.col(VERSION).isin(lacking),
                           F.lit(standard).cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    return rows.select(*columns)
