"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import (archives, bpe, covertree, differencing, jaccard, languages, packing, prefixes,
                            pretokens, quality, repeats, spots, urls, whitening)
from threadloom.llm.tables import held_back, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = pretokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = docs.where(~held_back("doc_id", 4, 2) & F.col("doc_id").isNotNull())
    said = languages.predict(docs, languages.fit(learnt))
    return said.select("doc_id", held_back("doc_id", 4, 2).alias("held_out"), "lang_pred",
                       "score", "lang_ambiguous")


@query
def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(table(spark, sf_dir, "documents"), packing.read_vocabulary(path),
                          added=packing.read_added(path))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query
def op6_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_back("doc_id", 3, 1)))
    return quality.score(docs, model).select(
        "doc_id", held_back("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@query
def op10_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


@query
def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.compare_neighbours(table(spark, sf_dir, "documents"))


#: The rules of the query, as host, path and verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"),
             ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op7_url_cascade"] = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
rules(rule_host, rule_path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fitting AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
   AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fitting USING (page_id)
"""


@query
def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.through_archives(table(spark, sf_dir, "pages"))


@query
def op9_nearest_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differencing.extract(table(spark, sf_dir, "pages"))


@query
def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))


@query
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("repetition")
    return repeats.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                            "n_repeat_words")],
        "base_failed", "kept", m["covered_words"].alias("covered_words"),
        m["longest_repeat"].alias("longest_repeat"))
