"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least c are at most eps = sqrt(2 - 2 c) apart, along any axis too. The steps:

1. Equal vectors of a label are one class (two 64-bit hashes over label and components), with the number of its rows.
2. Leading principal axes are fitted on a bounded sample (``SAMPLE`` classes); any orthonormal axes give the same links, the sample only sets how well blocks part. The
   classes are sorted by label and by their cells of side eps along these axes, by a range shuffle, and cut into blocks of consecutive classes.
3. Blocks are leaves of a tree of sequence intervals, ``1 << RADIX`` children to a node, each with a box along the leading axes and a ball (centre and radius). From
   the pair (root, root) of each label the join descends: children of pairs that may hold links are paired, and pairs of intervals whose boxes or balls are further
   apart than eps are skipped. A pair of intervals whose balls lie within eps of each other is certain: all its vectors link, and it is counted without looking at
   them, so a tight group of a third of all vectors isn't compared pair by pair.
4. What is left of two blocks, without the vectors further than eps from the other's box, meets in one group of at most two blocks' vectors and is compared by a matrix product.
   It gives each class its links, by rows, and a spanning star for each connected part instead of its pairs.
5. Links are added up, and connected components of the stars give each row the least id of its component.

Pairs, intervals, links and edges stay in Spark; the driver sees the sample, the number of classes, the longest run of blocks and a count for each level.

Defined results: rows with a null id or label and vectors that are null, empty, zero or hold null or non-finite components have 0 links and are their own component (kept, but for a
null id). Vectors of other lengths don't link. Rows that repeat an id are vectors of their own and each gets a row; ``kept`` holds for all rows with the component's least id.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keep_only, stored
from .components import components

#: The least cosine of a link.
COSINE = 0.98
#: Classes that the axes are fitted on, leading axes, bytes and most vectors of a block, bits of a tree level, guard of the bounds against rounding.
SAMPLE, AXES, BLOCK_BYTES, BLOCK_ROWS, RADIX, GUARD = 4096, 6, 1 << 19, 1024, 4, 1e-9


def _rows(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label, v, h1, h2 of every row; v and the hashes are null where it takes no part."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    base = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    return base.select("id", "label", F.when(sound, F.col("v")).alias("v"), F.when(sound, F.xxhash64("label", "v")).alias("h1"), F.when(sound, F.xxhash64(F.lit("second"), "label", "v")).alias("h2"))


def matrix(column: pa.Array, at: np.ndarray | None = None) -> np.ndarray:
    """Equally long lists as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if at is not None:
        column = column.take(pa.array(at))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="i4") * x.shape[1]), pa.array(np.ascontiguousarray(x, "f8").ravel()))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for d in np.unique(lengths):
        yield int(d), np.flatnonzero(lengths == d)


def fitted_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal axes (a column each) for each length in a bounded sample."""
    sample = classes.select("h1", "h2", "v").orderBy("h1", "h2").limit(SAMPLE).toArrow()
    v, out = sample.column("v").combine_chunks(), {}
    if len(v):
        for d, at in by_length(np.diff(v.offsets.to_numpy())):
            x = units(matrix(v, at))
            x = x - x.mean(axis=0)
            out[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :AXES]
    return out


def axes_for(axes: dict[int, np.ndarray], d: int) -> np.ndarray:
    """Those fitted, or the first coordinates for lengths that the sample lacks; always AXES columns."""
    own = axes.get(d, np.eye(d)[:, :AXES])
    return np.concatenate([own, np.zeros((d, AXES - own.shape[1]))], axis=1)


def _ordered(classes: DataFrame, axes: dict[int, np.ndarray], eps: float, n_classes: int) -> DataFrame:
    """label, dims, node, n, cells, p (place along the axes), u (unit vector) in grid order."""
    spark, label = classes.sparkSession, classes.schema["label"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(axes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("")
        for batch in batches:
            v = batch.column(3)
            for d, at in by_length(np.diff(v.offsets.to_numpy())):
                u, take = units(matrix(v, at)), pa.array(at)
                p = u @ axes_for(sent.value, d)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype="i4") * AXES), pa.array(np.floor(p / eps).astype("i4").ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.full(len(at), d, "i4")), batch.column(1).take(take), batch.column(2).take(take), cells, lists(p), lists(u)], names=["label", "dims", "node", "n", "cells", "p", "u"])

    placed = classes.select("label", "node", "n", "v").mapInArrow(place, f"label {label}, dims int, node long, n long, cells array<int>, p array<double>, u array<double>")
    parts = max(spark.sparkContext.defaultParallelism, -(-n_classes // (16 * BLOCK_ROWS)))
    order = ["label", "dims", "cells", "node"]
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def summary(p: np.ndarray, u: np.ndarray, n: np.ndarray, node: np.ndarray) -> dict:
    centre = u.mean(axis=0)
    return {"lo": p.min(axis=0), "hi": p.max(axis=0), "centre": centre, "radius": float(np.sqrt(((u - centre) ** 2).sum(axis=1)).max()), "total": int(n.sum()), "least": int(node.min())}


_BOX = "lo array<double>, hi array<double>, centre array<double>, radius double, total long, least long"


def _in_blocks(ordered: DataFrame) -> DataFrame:
    """label, dims, node, n, p, u, part, run (the number of its block within its range), and the block's summary in its first row."""
    label, block_rows = ordered.schema["label"].dataType.simpleString(), BLOCK_ROWS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("")
        part, run, held, size, key = TaskContext.get().partitionId(), 0, [], 0, None

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            first = summary(matrix(rows.column("p")), matrix(rows.column("u")), rows.column("n").to_numpy(), rows.column("node").to_numpy())
            k = rows.num_rows
            arrays = [rows.column(c).combine_chunks() for c in ("label", "dims", "node", "n", "p", "u")] + [pa.array(np.full(k, part, "i4")), pa.array(np.full(k, run, "i4"))]
            arrays += [pa.array([v] + [None] * (k - 1), type=t) for v, t in zip(first.values(), [pa.list_(pa.float64())] * 3 + [pa.float64(), pa.int64(), pa.int64()])]
            return pa.RecordBatch.from_arrays(arrays, names=["label", "dims", "node", "n", "p", "u", "part", "run", *first])

        for batch in batches:
            labels, dims = batch.column(0), batch.column(1).to_numpy()
            change = pc.not_equal(labels.slice(1), labels.slice(0, max(0, len(labels) - 1))).to_numpy(zero_copy_only=False) | (np.diff(dims) != 0)
            bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(dims)]
            for lo, hi in zip(bounds, bounds[1:]):
                if hi > lo and (labels[lo].as_py(), int(dims[lo])) != key:
                    if held:
                        yield block()
                        run += 1
                    held, size, key = [], 0, (labels[lo].as_py(), int(dims[lo]))
                most = min(block_rows, max(64, BLOCK_BYTES // (8 * max(1, int(dims[lo]))))) if hi > lo else 1
                while lo < hi:
                    take = min(hi - lo, most - size)
                    held.append(batch.slice(lo, take).select(["label", "dims", "node", "n", "p", "u"]))
                    lo, size = lo + take, size + take
                    if size == most:
                        yield block()
                        held, size, run = [], 0, run + 1
        if held:
            yield block()

    return ordered.mapInArrow(cut, f"label {label}, dims int, node long, n long, p array<double>, u array<double>, part int, run int, {_BOX}")


def _parents(intervals: DataFrame) -> DataFrame:
    """The next level of intervals: up to 1 << RADIX of them, consecutive ones, in one."""
    label = intervals.schema["label"].dataType.simpleString()

    def merge(rows: pa.Table) -> pa.Table:
        lo, hi, centres, n = matrix(rows.column("lo")), matrix(rows.column("hi")), matrix(rows.column("centre")), rows.column("total").to_numpy()
        centre = centres.mean(axis=0)
        radius = float((np.sqrt(((centres - centre) ** 2).sum(axis=1)) + rows.column("radius").to_numpy()).max())
        own = {"lo": [lo.min(axis=0)], "hi": [hi.max(axis=0)], "centre": [centre], "radius": [radius], "total": [int(n.sum())], "least": [int(rows.column("least").to_numpy().min())]}
        head = rows.slice(0, 1)
        return pa.table({"label": head.column("label"), "dims": head.column("dims"), "at": head.column("parent"), **own})

    return intervals.withColumn("parent", F.shiftright("at", RADIX)).groupBy("label", "dims", "parent").applyInArrow(merge, f"label {label}, dims int, at long, {_BOX}")


def _judged(pairs: DataFrame, eps: float) -> DataFrame:
    """label, dims, a, b, kind of pairs of intervals that may hold links: kind 1 if all their vectors link, else 0. Pairs too far apart are skipped."""
    label, sides = pairs.schema["label"].dataType.simpleString(), [f"{s}.{c}" for s in "ab" for c in ("at", "lo", "hi", "centre", "radius", "total", "least")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("")
        for batch in batches:
            col = dict(zip(["label", "dims", *sides], batch.columns))
            for _, at in by_length(col["dims"].to_numpy()):
                take = pa.array(at)
                gap = np.maximum(0, np.maximum(matrix(col["a.lo"], at) - matrix(col["b.hi"], at), matrix(col["b.lo"], at) - matrix(col["a.hi"], at)))
                apart = np.sqrt(((matrix(col["a.centre"], at) - matrix(col["b.centre"], at)) ** 2).sum(axis=1))
                reach = (col["a.radius"].to_numpy() + col["b.radius"].to_numpy())[at]
                near = ((gap**2).sum(axis=1) <= (eps + GUARD) ** 2) & (apart - reach <= eps + GUARD)
                sure = apart + reach <= eps - GUARD
                keep = np.flatnonzero(near)
                take = pa.array(at[keep])
                names = ["label", "dims", "a.at", "b.at", "a.total", "b.total", "a.least", "b.least"]
                yield pa.RecordBatch.from_arrays([*(col[c].take(take) for c in names), pa.array(sure[keep].astype("i4"))], names=["label", "dims", "a", "b", "n_a", "n_b", "least_a", "least_b", "kind"])

    flat = pairs.select("label", "dims", *[F.col(c).alias(c.replace(".", "_")) for c in sides])
    return flat.mapInArrow(judge, f"label {label}, dims int, a long, b long, n_a long, n_b long, least_a long, least_b long, kind int")


def _interval_pairs(tree: list[DataFrame], eps: float, keep: Scratch) -> list[DataFrame]:
    """For each level of the tree, leaves first, its judged pairs of intervals: certain ones, and those whose children were looked at next."""
    found: list[DataFrame] = []
    for level in range(len(tree) - 1, -1, -1):
        side = {s: tree[level].select("label", "dims", F.shiftright("at", RADIX).alias(f"parent_{s}"), F.struct("at", "lo", "hi", "centre", "radius", "total", "least").alias(s)) for s in "ab"}
        if found:
            above = found[-1].where("kind = 0").select("label", "dims", F.col("a").alias("parent_a"), F.col("b").alias("parent_b"))
            pairs = above.join(side["a"], ["label", "dims", "parent_a"]).join(side["b"], ["label", "dims", "parent_b"]).where("a.at <= b.at")
        else:  # one root for each label and length
            pairs = side["a"].join(side["b"], ["label", "dims"]).where("a.at <= b.at")
        found.append(keep(_judged(pairs, eps), "pairs"))
    return found[::-1]


def linked(a: np.ndarray, b: np.ndarray | None, n_a: np.ndarray, n_b: np.ndarray | None, cosine: float):
    """For the rows of a, and then of b: how many rows they link with, and the place of the least row of their connected part. b is None: a with itself."""
    m = a @ (a if b is None else b).T >= cosine
    if b is None:
        np.fill_diagonal(m, True)
        links, up, far = m @ n_a, np.arange(len(a)), len(a)
        while True:
            now = np.where(m, up, far).min(axis=1)
            if (now == up).all():
                return links, up
            up = now[now]
    links, far = np.concatenate([m @ n_b, n_a @ m]), len(a) + len(b)
    up_a, up_b = np.arange(len(a)), np.arange(len(a), far)
    while True:
        now_a = np.minimum(up_a, np.where(m, up_b, far).min(axis=1, initial=far))
        now_b = np.minimum(up_b, np.where(m, now_a[:, None], far).min(axis=0, initial=far))
        if (now_a == up_a).all() and (now_b == up_b).all():
            return links, np.concatenate([up_a, up_b])
        up_a, up_b = now_a, now_b


def _compared(leaves: DataFrame, placed: DataFrame, boxes: DataFrame, eps: float, cosine: float) -> DataFrame:
    """node, links, to: for each class of a pair of blocks the rows that it links with, and a class with which it is connected (itself, if it is the least)."""
    pair = leaves.where("kind = 0").select("a", "b")
    box = boxes.select("at", "lo", "hi")
    asked = pair.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("block"), F.col("b").alias("other")).unionByName(pair.where("a <> b").select("a", "b", F.lit(1).alias("side"), F.col("b").alias("block"), F.col("a").alias("other")))
    met = asked.join(box, F.col("other") == F.col("at")).join(placed.select("block", "node", "n", "p", "u"), "block")
    off = sum(F.pow(F.greatest(F.col("lo")[i] - F.col("p")[i], F.col("p")[i] - F.col("hi")[i], F.lit(0.0)), 2) for i in range(AXES))
    sent = met.where(off <= (eps + GUARD) ** 2).select("a", "b", "side", "node", "n", "u")

    def compare(rows: pa.Table) -> pa.Table:
        alone = rows.column("a")[0] == rows.column("b")[0]
        rows = rows.sort_by([("side", "ascending"), ("node", "ascending")])
        u, n, node = matrix(rows.column("u")), rows.column("n").to_numpy(), rows.column("node").to_numpy()
        cut = len(u) if alone else int((rows.column("side").to_numpy() == 0).sum())
        if not alone and cut in (0, len(u)):
            return pa.table({"node": node[:0], "links": n[:0], "to": node[:0]})
        links, up = linked(u, None, n, None, cosine) if alone else linked(u[:cut], u[cut:], n[:cut], n[cut:], cosine)
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some], "to": node[up[some]]})

    return sent.groupBy("a", "b").applyInArrow(compare, "node long, links long, to long")


def _certain(judged: DataFrame, level: int, placed: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links and edges of what lies in pairs of intervals of a level that are certain: (node, links, to), and edges between intervals."""
    sure = judged.where("kind = 1")
    sides = sure.select("label", "dims", F.col("a").alias("own"), F.col("n_b").alias("links"), F.col("least_b").alias("to")).unionByName(sure.where("a <> b").select("label", "dims", F.col("b").alias("own"), F.col("n_a").alias("links"), F.col("least_a").alias("to")))
    gained = keep(sides.groupBy("label", "dims", "own").agg(F.sum("links").alias("links"), F.min("to").alias("to")), "gained")
    return placed.select("label", "dims", "node", F.shiftright("block", RADIX * level).alias("own")).join(gained, ["label", "dims", "own"]).select("node", "links", "to"), sure.select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))


def near_vectors(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """id_col, n_links, component_id, kept of every row."""
    spark: SparkSession = df.sparkSession
    keep, eps = Scratch(), float(np.sqrt(2 - 2 * cosine))
    rows = _rows(df, id_col, label_col, vector_col)
    grouped = rows.where("h1 IS NOT NULL").groupBy("label", "h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least"))
    classes = keep(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    placed = keep(_in_blocks(_ordered(classes, fitted_axes(classes), eps, classes.count())), "blocks")
    longest = placed.agg(F.max("run"), F.max("part")).first()
    bits = int(longest[0] or 0).bit_length()
    placed = placed.withColumn("block", F.shiftleft(F.col("part").cast("long"), bits) + F.col("run"))
    levels = -(-(bits + int(longest[1] or 0).bit_length()) // RADIX)
    tree = [keep(placed.where("lo IS NOT NULL").select("label", "dims", F.col("block").alias("at"), "lo", "hi", "centre", "radius", "total", "least"), "intervals")]
    for _ in range(levels):
        tree.append(keep(_parents(tree[-1]), "intervals"))
    judged = _interval_pairs(tree, eps, keep)
    found = keep(_compared(judged[0], placed, tree[0], eps, cosine), "links")
    edges = found.select(F.col("node").alias("a"), F.col("to").alias("b"))
    for level, pairs in enumerate(judged):
        if pairs.where("kind = 1").limit(1).count():
            more, between = _certain(pairs, level, placed, keep)
            more = keep(more, "certain")
            found = found.unionByName(more)
            edges = edges.unionByName(more.select(F.col("node").alias("a"), F.col("to").alias("b"))).unionByName(between)
    part_of = components(edges)
    sums = found.groupBy("node").agg((F.sum("links") - 1).alias("n_links"))
    own = classes.select("node", "h1", "h2", "least").join(part_of, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = keep(own, "members")
    least = keep(own.groupBy("label").agg(F.min("least").alias("component_id")), "least")  # stored, so that joins with a component of a third of all rows can be split
    result = stored(own.join(least, "label").join(sums, "node").select("h1", "h2", "n_links", "component_id"), "vectors", keep=True)
    keep.drop()
    out = rows.select("id", "h1", "h2").join(result, ["h1", "h2"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


ORACLE = f"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
v AS (
  SELECT * FROM r WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.row AS a, b.row AS b FROM v a JOIN v b ON a.label = b.label AND a.row <> b.row AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
reached AS (SELECT row, row AS far FROM r UNION SELECT reached.row, links.b FROM reached JOIN links ON links.a = reached.far),
least AS (SELECT reached.row, min(r.vec_id) AS component_id FROM reached JOIN r ON r.row = reached.far GROUP BY reached.row),
counted AS (SELECT a AS row, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM r LEFT JOIN least USING (row) LEFT JOIN counted USING (row)
"""
