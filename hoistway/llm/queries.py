"""The queries of the numbered operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_automaton, decontaminate, filter_audit, grid_join, html_extract, importance_resample, line_dedup, ngram_join, quality_fm, token_counts, topk, toxicity, warc_revisits
from .common import table
from .labelled import fitted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens: tokens of every whole text under the public piece vocabulary read as a unigram model."""
    vocab = token_counts.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocab)


@query
def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return bpe_automaton.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_lines, n_removed of every document."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


ORACLE_SQL["op3_line_dedup"] = line_dedup.ORACLE


@query
def op7_topk_branch_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of all rows for each row whose vec_id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"))


ORACLE_SQL["op7_topk_branch_bound"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.v AS q, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, fitted(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.train))


@query
def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_fm.scores(docs, fitted(docs, table(spark, sf_dir, "labels"), "quality", quality_fm.train))


@query
def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, canonical_url, response_id, status, headers for every revisit in the crawl that the pages make."""
    out = warc_revisits.resolve(warc_revisits.pages_as_records(table(spark, sf_dir, "pages")))
    return out.select("record_id", "canonical_url", "response_id", "status", warc_revisits.header_text(out["headers"]).alias("headers"))


ORACLE_SQL["op9_warc_revisits"] = warc_revisits.ORACLE


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, end, distance, passage: each benchmark item that occurs in a document within its edit budget."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return html_extract.extract_main(table(spark, sf_dir, "pages"))


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, class_key, component_key, text_hash of every document."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step and counts of every source, order of the five filters and step."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op11_filter_audit"] = filter_audit.ORACLE


@query
def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, drawn towards the benchmark's n-grams."""
    return importance_resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op12_importance_resample"] = importance_resample.ORACLE


@query
def op13_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return grid_join.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op13_grid_join"] = grid_join.ORACLE
