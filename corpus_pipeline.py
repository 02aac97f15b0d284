"""A corpus pipeline of the operators in hoistway.llm: each stage reads documents and hands on documents.

run() writes what a stage keeps to the shared folder and reads it again, so a lost executor repeats one stage at most. Every stage decides on a row by its own
text; where the id counts as well, a document is a doc_id with a text, so rows that repeat one id with other texts aren't lost with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoistway.llm import bpe_automaton, decontaminate, labelled, line_dedup, ngram_join, toxicity
from hoistway.llm.common import drop_stored, passing, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of this table, scores below 0.5."""
    model = labelled.fitted(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.train)
    return toxicity.keep_below(docs, model, 0.5).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated windows of three lines; one that loses all its lines goes."""
    cut = line_dedup.covered(docs)
    left = line_dedup.without(docs, cut).where("NOT __cut OR __removed < __lines")
    return left.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies: the least doc_id, of rows without one only if all are. Rows that repeat an id and its text stay or go together."""
    gone = ngram_join.beside_first(ngram_join.jaccard_components(docs.select("doc_id", "text"))).alias("g")
    own = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("d")
    return own.join(gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.__hash") == F.col("g.text_hash")), "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, tokens of each document; each decodes to its text."""
    return bpe_automaton.with_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("bpe", encode_bpe),
]

#: Classifier, alignment and tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with passing(spark):  # what a stage stored on its way goes once its own rows are written, and so do the rows of the stage before
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
