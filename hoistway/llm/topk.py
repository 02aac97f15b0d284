"""Exact top-k inner products by columnar branch and bound.

Vectors turn into integers floor(scale * x). A task reads its share of the candidates in blocks, each a matrix stored dimension by dimension, and holds one
slab of queries. It adds the products of one block of dimensions after another to the scores so far and keeps, for each query, only candidates whose
score so far plus the product of the norms of what remains (Cauchy-Schwarz) can still reach the query's k-th best: the best of the task's earlier blocks,
or the k-th largest of this block's scores less the same remainder. The survivors' columns are compacted between blocks of dimensions.

Queries are parted into slabs of bounded bytes. A slab is broadcast, candidates are scanned once for it without a shuffle, and each task hands on at most k
rows a query. These are cut to k in two steps (by query and a salt, then by query) of windows that Spark limits before their shuffles, so no query's
rows are gathered in memory. With several slabs, each one's rows are written to the shared folder first.

Scores are exact while they fit in 53 bits: sums of products stay below 2**53 in floating point and only integers are added; blocks with larger
components are scored with Python integers instead, and a score beyond a signed 64-bit integer is an error. Vectors that are null,
empty or hold a null or non-finite component take no part; a vector of another length than the query's isn't its candidate. Repeated
vec_ids: rows with the query's own vec_id are never its candidates, rows that repeat an id are candidates of their own, and each distinct (id, vector) is one query
with its own k rows, all under the same query_id. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: Bytes of a slab of queries, queries and candidates compared at a time, dimensions added at a time, salts of the merge.
SLAB_BYTES, QUERY_BLOCK, CANDIDATE_BLOCK, DIMENSIONS, SALTS = 32 << 20, 512, 4096, 16, 16
_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
NONE = np.iinfo("int64").min


def integers(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, v array<double> of integers, without vectors that take no part."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~bad).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def columns(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and integers (one row for each dimension) of the vectors of each length."""
    ids, vectors = batch.column(0).to_numpy(), batch.column(1)
    offsets = vectors.offsets.to_numpy()
    flat, lengths = vectors.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for dims in np.unique(lengths):
        rows = np.flatnonzero(lengths == dims)
        yield ids[rows], np.ascontiguousarray(flat[offsets[rows][None, :] + np.arange(dims)[:, None]])


class Side:
    """Vectors of one length by columns, with the norms of what remains behind each block of dimensions."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.cuts = [*range(0, len(x), DIMENSIONS), len(x)]
        self.rest = [np.sqrt((x[d:] ** 2).sum(axis=0)) for d in self.cuts]
        self.largest = float(np.abs(x).max(initial=0))


class Best:
    """The k best candidates of each query so far, as (score, id), best first; ties go to smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.ids = k, np.full((n, k), NONE, "int64"), np.zeros((n, k), "int64")

    def floor(self, i: int) -> int:
        return int(self.score[i, -1])

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        old = self.score[i] > NONE
        score, ids = np.concatenate([self.score[i][old], score]), np.concatenate([self.ids[i][old], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score[i, : len(order)], self.ids[i, : len(order)] = score[order], ids[order]


def search(q: Side, x: Side, best: Best) -> None:
    """Adds to best what x holds for each query of q; both sides have vectors of one length."""
    exact = q.largest * x.largest * len(q.x) < 2**53
    for lo in range(0, q.x.shape[1] if exact else 0, QUERY_BLOCK):
        first = q.x[: q.cuts[1], lo : lo + QUERY_BLOCK].T @ x.x[: q.cuts[1]]
        for i in range(lo, lo + len(first)):
            alive, sums, known = np.flatnonzero(x.ids != q.ids[i]), None, best.floor(i)
            sums = first[i - lo, alive]
            for b in range(1, len(q.cuts)):
                slack = q.rest[b][i] * x.rest[b][alive] * (1 + 1e-9) + 1e-6
                low = known
                if len(alive) > best.k:
                    low = max(low, np.partition(sums - slack, len(alive) - best.k)[len(alive) - best.k])
                keep = sums + slack >= low
                if not keep.all():
                    alive, sums = alive[keep], sums[keep]
                if not len(alive):
                    break
                if b < len(q.cuts) - 1:
                    sums = sums + q.x[q.cuts[b] : q.cuts[b + 1], i] @ x.x[q.cuts[b] : q.cuts[b + 1], alive]
            if len(alive):
                best.add(i, np.rint(sums).astype("int64"), x.ids[alive])
    if not exact:
        for i in range(q.x.shape[1]):
            mine, alive = [int(v) for v in q.x[:, i]], np.flatnonzero(x.ids != q.ids[i])
            best.add(i, np.array([sum(a * int(b) for a, b in zip(mine, x.x[:, j])) for j in alive], dtype="int64"), x.ids[alive])


def _scanned(candidates: DataFrame, slab: list[tuple[np.ndarray, np.ndarray]], slab_no: int, k: int) -> DataFrame:
    """query (its number), query_id, vec_id, score: at most k rows a query from each task."""
    sent = candidates.sparkSession.sparkContext.broadcast(slab)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {len(x): Side(ids, x) for ids, x in sent.value}
        best = {dims: Best(len(q.ids), k) for dims, q in sides.items()}
        for batch in batches:
            for ids, x in columns(batch):
                for lo in range(0, len(ids) if len(x) in sides else 0, CANDIDATE_BLOCK):
                    search(sides[len(x)], Side(ids[lo : lo + CANDIDATE_BLOCK], x[:, lo : lo + CANDIDATE_BLOCK]), best[len(x)])
        base = slab_no << 32
        for dims, found in best.items():
            for lo in range(0, len(found.ids), QUERY_BLOCK):
                at, rank = np.nonzero(found.score[lo : lo + QUERY_BLOCK] > NONE)
                at += lo
                yield pa.RecordBatch.from_arrays([pa.array(base + at), pa.array(sides[dims].ids[at]), pa.array(found.ids[at, rank]), pa.array(found.score[at, rank])], schema=_FOUND)
            base += len(found.ids)

    return candidates.mapInArrow(scan, "query long, query_id long, vec_id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products for each query, ties to smaller ids."""
    spark = candidates.sparkSession
    asked, rows = integers(queries, scale, id_col, vector_col).distinct(), integers(candidates, scale, id_col, vector_col)
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    slabs = max(1, -(-8 * (asked.agg(F.sum(F.size("v"))).first()[0] or 0) // SLAB_BYTES))
    at, parts, found = f"{shared_dir(spark)}/hoistway-topk-{uuid.uuid4().hex}", [], None
    for n in range(slabs):
        slab = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(slabs)) == n).toArrow().combine_chunks()
        found = _scanned(rows, [s for batch in slab.to_batches() for s in columns(batch)], n, k)
        if slabs > 1:
            parts.append(f"{at}/{n}")
            found.write.parquet(parts[-1])
    if parts:
        found = spark.read.schema(found.schema).parquet(*parts)
    order = [F.col("score").desc(), F.col("vec_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "query_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("query", "query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
