"""Reading topics: from a broker, or from files that hold the same rows.

Every reader gives the rows of ``schema.ENVELOPE``; what follows does not know
where they came from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import variants as v
from threadloom.functions.text import strip
from threadloom.schema import ENVELOPE

BROKEN = "_broken"


def from_broker(spark: SparkSession, topics: list[str], servers: str, streaming: bool = True,
                **options: str) -> DataFrame:
    """Topics from a Kafka broker, from the earliest offset. Needs the connector package."""
    reader = spark.readStream if streaming else spark.read
    reader = (reader.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
              .option("includeHeaders", "true"))
    for key, value in options.items():
        reader = reader.option(key, value)
    rows = reader.load()
    return rows.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"),
                       F.col("value").cast("string").alias("value"), "headers",
                       F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


def from_files(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False,
               schema: T.StructType = ENVELOPE, files_per_trigger: int | None = None,
               **options: str) -> DataFrame:
    """Topic rows kept as files (parquet, orc or JSON lines)."""
    reader = (spark.readStream if streaming else spark.read).format(fmt).schema(schema)
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


# Rows of a source that one task gets at most, on average.
SPREAD_ROWS = 100_000


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Hand the rows of a source to all cores, and to a task no more than ``rows_per_task``
    on average, ``SPREAD_ROWS`` if not given.

    A file is read in splits of so many bytes, and packed rows are small: a split may hold
    millions, however costly the work per row. The rows are counted, which reads no more
    than the footers of Parquet files. A source with enough splits stays as it is: no shuffle.
    """
    if df.isStreaming:
        return df
    tasks = max(df.sparkSession.sparkContext.defaultParallelism,
                -(-df.count() // (rows_per_task or SPREAD_ROWS)))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def decode(rows: DataFrame) -> DataFrame:
    """Add ``document`` (the parsed value) and ``header`` (headers as a text map).

    Of repeated header names the last one stays.
    """
    pairs = F.transform("headers", lambda h: F.struct(h["key"].alias("k"),
                                                      h["value"].cast("string").alias("v")))
    header = F.aggregate(
        F.coalesce(pairs, F.array()), F.create_map().cast("map<string,string>"),
        lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, _: k != p["k"]),
                                    F.create_map(p["k"], p["v"])))
    return v.with_once(rows, "document", v.whole_json(F.col("value"))).withColumn("header", header)


def read_multi(topics: dict[str, DataFrame]) -> DataFrame:
    """Several topics as one frame with the name in ``topic``. A union: no shuffle."""
    named = [df.withColumn("topic", F.lit(name)) for name, df in topics.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def declare_stream(rows: DataFrame, schema: T.StructType, key: str | None = None,
                   name: str | None = None) -> DataFrame:
    """Typed columns over a JSON topic; ``name`` also makes it a view for SQL.

    The key column is read from the record key, the others from the value. Rows
    without a value and rows whose value is not such a record are left out; ``undeclared``
    has the latter.
    """
    typed = _declared(rows, schema)
    columns = [(F.col("key") if f.name == key else F.col(f"_v.{f.name}")).alias(f.name)
               for f in schema.fields]
    position = [c for c in ("topic", "partition", "offset", "ts", "timestamp")
                if c in rows.columns and c not in schema.fieldNames()]
    kept = F.col("_v").isNotNull() & F.col(f"_v.{BROKEN}").isNull()
    out = typed.filter(kept).select(*columns, *position)
    if name:
        out.createOrReplaceTempView(name)
    return out


def undeclared(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows that ``declare_stream`` leaves out although they have a value.

    With ``error`` and ``error_type``, ready for ``dead_letters``.
    """
    broken = F.col("value").isNotNull() & (F.col("_v").isNull() | F.col(f"_v.{BROKEN}").isNotNull())
    not_json = v.whole_json(F.col("value")).isNull()
    return (_declared(rows, schema).filter(broken).drop("_v")
            .withColumn("error", F.when(not_json, "value: not JSON")
                        .otherwise("value: not such a record"))
            .withColumn("error_type", F.when(not_json, "JSONDecodeError")
                        .otherwise("ValidationError")))


def _declared(rows: DataFrame, schema: T.StructType) -> DataFrame:
    checked = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    return rows.withColumn("_v", F.from_json(
        "value", checked, {"columnNameOfCorruptRecord": BROKEN}))


def read_requests(rows: DataFrame) -> DataFrame:
    """Request columns from topic rows; nested metadata values become JSON text.

    ``request_error`` and ``request_error_type`` say what ``validate_message`` can't see
    in the columns: text that is not JSON, and fields that are there but of a wrong type.
    Null counts as left out for ``tenant_id`` and ``metadata`` only.
    """
    names = ("conversation_id", "sender", "message", "channel", "tenant_id")
    parsed = v.with_fields(rows, "_doc", F.col("value"), (*names, "metadata"))
    texts = [f"CASE WHEN {v.is_string('_doc', n)} THEN {v.string('_doc', n)} END AS {n}"
             for n in names]
    metadata = v.get("_doc", "metadata", "map<string,string>")
    typed = [(f"{v.absent('_doc', n)} OR {v.is_string('_doc', n)}", f"{n}: not a text")
             for n in ("conversation_id", "message", "channel")]
    typed.append((f"{v.missing_or_null('_doc', 'tenant_id')} OR {v.is_string('_doc', 'tenant_id')}",
                  "tenant_id: not a text"))
    typed.append((f"{v.missing_or_null('_doc', 'metadata')} OR "
                  f"startswith({v.type_of(v.field('_doc', 'metadata'))}, 'OBJECT')",
                  "metadata: not an object"))
    # the text is parsed again only where it is no object
    broken = F.when(F.col("_doc").isNull(), F.when(
        v.whole_json(F.col("value")).isNull(), "value: not JSON").otherwise("value: not an object"))
    error = F.coalesce(broken, F.expr(v.first_error(*typed)))
    kind = F.when(F.col("request_error") == "value: not JSON", "JSONDecodeError").when(
        F.col("request_error").isNotNull(), "ValidationError")
    return (parsed.withColumn("request_error", error)
            .selectExpr(*rows.columns, *texts, f"{metadata} AS metadata", "request_error")
            .withColumn("request_error_type", kind))


def read_view_response(responses: DataFrame, value: str = "value") -> DataFrame:
    """Rows of query answers, one answer text per input row.

    An answer is a JSON array, one object, or one value per line. Rows that carry
    ``header`` or ``queryId`` are envelope. An answer that is a single error object
    (``error_code`` or ``message``) has no rows, nor has one that is not JSON.
    """
    text = strip(F.col(value))
    pieces = F.filter(F.split(text, "\n", -1), lambda line: strip(line) != "")
    by_line = F.transform(pieces, v.whole_json)
    parsed = v.with_once(responses, "_doc", v.whole_json(text))
    doc = F.col("_doc")
    error = _has(doc, "error_code") | _has(doc, "message")
    rows = (F.when(doc.isNull() & F.forall(by_line, lambda x: x.isNotNull()), by_line)
            .when(_is_object(doc) & ~error, F.array(doc))
            .when(~_is_object(doc), F.try_variant_get(doc, "$", "array<variant>")))
    return view_rows(parsed.withColumn("document", F.explode(rows)).drop("_doc"))


def _has(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant").isNotNull()


def _is_object(doc: Column) -> Column:
    return F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))


def view_rows(rows: DataFrame) -> DataFrame:
    """Data rows of an answer: objects that are no envelope."""
    d = F.col("document")
    return rows.filter(_is_object(d) & ~_has(d, "header") & ~_has(d, "queryId"))


def read_view_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of one long answer kept as a file of lines, read in parallel."""
    return view_rows(v.with_once(lines, "document", v.whole_json(F.col(value))))
