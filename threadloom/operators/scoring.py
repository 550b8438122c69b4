"""Where user code joins in: scorers, folds and per-record functions.

A scorer maps a batch of context texts to a batch of answer texts. It runs in
``mapInPandas``, on Arrow batches, wherever the rows already are: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.responses import parse_model_response
from threadloom.schema import KEYS, SUMMARY

Scorer = Callable[[Sequence[str]], Sequence[str]]
# (previous summary or None, sender, message) -> next summary
Fold = Callable[[dict | None, str, str], dict]
# (record, headers) -> rows
RecordFunction = Callable[[dict, dict], Iterable[dict]]


def score(contexts: DataFrame, scorer: Scorer, kind: str, context: str = "context") -> DataFrame:
    """Score a context column and parse the answers into typed results.

    Rows whose answer fails keep ``error``/``error_type`` and go to the dead letters.
    """
    return parse_model_response(
        raw_answers(contexts, scorer, context).withColumn("kind", F.lit(kind)))


def raw_answers(contexts: DataFrame, scorer: Scorer, context: str = "context") -> DataFrame:
    """Add ``response``, the scorer's answer text. Only keys and context go to Python."""
    slim = contexts.select(*KEYS, "ts", "seq", context)
    schema = T.StructType([*[f for f in slim.schema.fields if f.name != context],
                           T.StructField("response", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = list(scorer(batch[context].tolist()))
            yield batch.drop(columns=[context]).assign(response=answers)

    return slim.mapInPandas(run, schema)


def extension_point(df: DataFrame, function: Callable[..., DataFrame], *args) -> DataFrame:
    """Apply a user's step. Column logic keeps its plan visible to Catalyst."""
    return df.transform(function, *args)


def per_record(records: DataFrame, function: RecordFunction, schema: T.StructType | str) -> DataFrame:
    """Apply a user's step to every record: ``function(record, headers)`` gives any number of rows.

    ``record`` is a dict of the columns, ``headers`` one of the ``header`` map (empty without
    such a column). The rows are dicts in the columns of ``schema``. Runs where the records
    are, in Arrow batches; select the columns that the step needs before.
    """
    names = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fieldNames()
    columns = records.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values in zip(*(batch[c].tolist() for c in columns)):
                record = dict(zip(columns, values))
                headers = dict(record.pop("header", None) or ())
                rows.extend(function(record, headers))
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)

    return records.mapInPandas(run, schema)


def summary_fold(messages: DataFrame, fold: Fold, initial: DataFrame | None = None) -> DataFrame:
    """Summary after every message: ``fold(previous summary, sender, message)``.

    Each step needs the one before, so a conversation is folded in order by one
    task. Rows are sorted by conversation and time and streamed through in Arrow
    batches; only the current summary is held, never a whole conversation. With
    ``initial`` (keys and ``summary``, one row per conversation) a run goes on
    where the last one ended, so a long conversation can be folded slice by slice.
    """
    rows = messages.select(*KEYS, "ts", "seq", "sender", "message")
    if initial is not None:
        # The start value is a row of its own, sorted first: no join, one shuffle.
        start = initial.select(*KEYS, F.lit(-1).cast("bigint").alias("seq"),
                               F.to_json("summary").alias("_start"))
        rows = rows.unionByName(start, allowMissingColumns=True)
    else:
        rows = rows.withColumn("_start", F.lit(None).cast("string"))
    ordered = rows.repartition(*KEYS).sortWithinPartitions(
        *KEYS, F.col("ts").asc_nulls_first(), "seq")
    schema = "tenant_id string, conversation_id string, ts timestamp_ntz, seq bigint, _json string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        key, summary = None, None
        for batch in batches:
            answers = []
            for row in batch.itertuples(index=False):
                here = (row.tenant_id, row.conversation_id)
                if here != key:
                    key, summary = here, None
                if row[6] is not None:
                    summary = json.loads(row[6])
                    answers.append(None)
                    continue
                summary = fold(summary, row.sender, row.message)
                answers.append(json.dumps(summary))
            out = batch[["tenant_id", "conversation_id", "ts", "seq"]].assign(_json=answers)
            yield out[out["_json"].notna()]

    folded = ordered.select(*KEYS, "ts", "seq", "sender", "message", "_start") \
        .mapInPandas(run, schema)
    parsed = F.from_json("_json", SUMMARY)
    return folded.select(*KEYS, "ts", F.col("seq").cast("bigint").alias("seq"),
                         parsed.withField("timestamp", F.col("ts")).alias("summary"))
