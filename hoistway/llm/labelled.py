"""The bounded sample of labelled rows from which the classifiers learn, and held-out measures."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep_only

#: Most labelled rows that a classifier learns from; a documented bound, whatever the corpus.
TRAIN_ROWS = 5000


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5) == 0


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, y of at most ``rows`` labelled documents, in one partition, chosen by a hash of the id and never from the held-out fold.

    A doc_id whose label rows disagree isn't used; labels of documents that aren't there don't shrink the sample. Of the rows of a repeated doc_id all
    texts count. Ids alone meet in the join that finds the labelled documents; ids and labels of the sample (``rows`` of them at most) are broadcast,
    and texts are read by a scan without a shuffle.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    agreed = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("__most")).where("y = __most")
    chosen = agreed.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).select("text", "y")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> pd.DataFrame:
    """The same on the driver."""
    return sample_rows(docs, labels, label, rows).toPandas()


def fitted(docs: DataFrame, labels: DataFrame, label: str, train: Callable[[list[str], list[int]], dict], rows: int = TRAIN_ROWS) -> dict:
    """The model that ``train`` makes of the sample. It runs in one task, which a lost executor repeats; the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("")
        texts, y = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
        if texts:
            model = pickle.dumps(train(texts, y))
            texts.clear()
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = sample_rows(docs, labels, label, rows).coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(made[0][0])) if made else train([], [])
