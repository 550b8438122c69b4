"""A corpus made ready for training: documents of known language and good quality, one of each
group of near copies, packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import jaccard, languages, packing, quality
from threadloom.llm.tables import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _carried(docs: DataFrame) -> DataFrame:
    """The text of every row beside the whole row, so that no column of a model meets one of it."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "text")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told by their text; learns from their ``lang``.

    Null texts, texts without a letter and ambiguous ones (score below 0.5) go. Rows are
    judged one by one: equal rows go or stay together, null and repeated ids make no
    difference, an empty table stays empty. The columns are those of the input, as they were.
    """
    said = languages.predict(_carried(docs), languages.fit(docs))
    return said.where((F.col("lang_pred") != "und") & ~F.col("lang_ambiguous")).select("_row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score of 0.5 or more; learns from the ``labels`` of those given.

    A null text is judged as an empty one. Rows are judged one by one, whatever their ids; an
    empty table stays empty. The columns are those of the input, as they were.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(_carried(docs), model).where("predicted = 1").select("_row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest doc_id.

    Every row is a document of its own, numbered where it lies in its file, so rows that
    repeat a doc_id or have none are compared like others; null ids come last, and of equal
    ids the row of the smallest hash stays. Rows without a word are like nothing and all stay.
    An empty table stays empty. The columns are those of the input, as they were.
    """
    place = "_place" + "_" * max(map(len, docs.columns))
    numbered = docs.withColumn(place, F.monotonically_increasing_id())
    groups = jaccard.jaccard_groups(numbered, key=place).select(place, "component_id")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), place)
    ranks = numbered.select(place, rank.alias("_rank"))
    kept = (groups.join(ranks, place).groupBy("component_id")
            .agg(F.min_by(place, "_rank").alias(place)).select(place))
    return numbered.join(kept, place, "left_semi").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids.

    A null text is an empty one, whose only id is the end. Each row is packed, whatever its
    id; an empty table gives no piece. Columns other than doc_id and text are not looked at.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, packing.read_vocabulary(path), added=packing.read_added(path))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("packing", packed),
]

#: SQL can't train the classifiers or run the tokenizer; see tests/llm for the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
