"""How five document filters interact: removals of every coalition, of every order of application, and each filter's exact Shapley share.

A document's failures are a mask of five bits. Counts by part and mask (32 a part) hold everything: a coalition S removes the documents whose mask meets S, so its
removals v(S) are tabulated for all 32 coalitions, and what the step of filter i removes behind the filters S is v(S + i) - v(S). The Shapley shares are the solution of
kernel-weighted least squares: find phi that minimises the sum over all S but none and all of w(S) (v(S) - sum of phi in S)**2, with w(S) = 4 / (C(5, |S|) |S| (5 - |S|)),
under the constraint that all phi sum up to v(all). The normal equations with their Lagrange multiplier are solved in rationals, so shares are exact; 120 times a share is an
integer, the filter's removals summed over all orders.

The filters: A fewer than 50 words, B fewer than 65 % of the words distinct, C more than 5 % of the code points in A-Z, D a sign of #$%&*|, E the text of a smaller doc_id.

Texts meet by their SHA-256, first as least ids (pre-aggregated, so a group of copies costs one row a task), then by a join of narrow rows, which is split where a text
is in a third of all rows. No text is shuffled, and the table of masks is stored, so texts are read once.

Defined results: a null text is the empty text (0 words fail A only; copies of it fail E); a null source is the part ''; a null doc_id has no smaller one and is smaller than
none. Rows that repeat a doc_id with its text are both first. Where a doc_id has several labels, one of 1 counts. Parts without failures give rows of zeros; empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

FILTERS = "ABCDE"
#: Bounds of the filters: least words, least share of distinct words, largest share of capitals (percent); signs.
LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 50, 65, 5, "#$%&*|"
_COLUMNS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents, and those labelled good or toxic, by the filters that they fail (bit i: filter i)."""
    text = text_or_empty("text")
    words = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    seen = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    counted = seen.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.size(words).alias("n"),
        F.size(F.array_distinct(words)).alias("distinct"),
        (F.octet_length("t") - F.octet_length(F.regexp_replace("t", "[A-Z]+", ""))).alias("capitals"),
        F.length("t").alias("length"),
        F.col("t").rlike(f"[{SIGNS}]").alias("signs"),
    )
    bits = [F.col("n") < LEAST_WORDS, 100 * F.col("distinct") < DISTINCT * F.col("n"), 100 * F.col("capitals").cast("long") > CAPITALS * F.col("length"), F.col("signs")]
    narrow = stored(counted.select("doc_id", "part", "digest", sum(b.cast("int") * (1 << i) for i, b in enumerate(bits)).alias("own")), "masks", keep=True)
    first = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    first = stored(first, "first", keep=True)  # a table of its own, so that a join with a text of a third of all rows can be split
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    repeated = F.coalesce((F.col("doc_id") > F.col("first")).cast("int"), F.lit(0)) * (1 << FILTERS.index("E"))
    one = narrow.join(first, "digest", "left").join(marked, "doc_id", "left")
    return one.groupBy("part", (F.col("own") + repeated).alias("mask")).agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def coalition_removals(by_mask: list[int]) -> list[int]:
    """v(S) for every coalition: how many documents have a mask that meets S."""
    return [sum(n for mask, n in enumerate(by_mask) if mask & s) for s in range(len(by_mask))]


def solved(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """x with a x = b, by elimination in rationals."""
    rows = [[*r, y] for r, y in zip(a, b)]
    for i in range(len(rows)):
        pivot = next(j for j in range(i, len(rows)) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(len(rows)):
            if j != i and rows[j][i]:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
    return [r[-1] for r in rows]


@lru_cache(maxsize=4)
def _kernel(n: int) -> list[tuple[int, Fraction]]:
    sizes = [(s, s.bit_count()) for s in range(1, (1 << n) - 1)]
    return [(s, Fraction(n - 1, comb(n, k) * k * (n - k))) for s, k in sizes]


def shapley(v: list[int]) -> list[Fraction]:
    """Each player's share of v(all), from the removals of all coalitions, by constrained least squares."""
    n = (len(v) - 1).bit_length()
    a = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    b = [Fraction(0)] * (n + 1)
    for s, w in _kernel(n):
        inside = [i for i in range(n) if s >> i & 1]
        for i in inside:
            b[i] += w * v[s]
            for j in inside:
                a[i][j] += w
    for i in range(n):
        a[i][n] = a[n][i] = Fraction(1)
    b[n] = Fraction(v[-1])
    return solved(a, b)[:n]


def step_counts(n: list[int], good: list[int], toxic: list[int]) -> Iterator[tuple]:
    """filter_order, step and the counts of _COLUMNS for every order of the filters, from counts by mask."""
    players, total = len(FILTERS), sum(n)
    v, v_good, v_toxic = map(coalition_removals, (n, good, toxic))
    shares = [x * factorial(players) for x in shapley(v)]
    for order in permutations(range(players)):
        name, behind = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            now = behind | 1 << i
            removed = v[now] - v[behind]
            yield name, step, total - v[now], removed, v[1 << i] - removed, n[1 << i], v_good[now] - v_good[behind], v_toxic[now] - v_toxic[behind], int(shares[i])
            behind = now


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    one = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 at most
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "filter_order", "step", *_COLUMNS]
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by = {k: [0] * (1 << len(FILTERS)) for k in ("n", "good", "toxic")}
                for c in counts:
                    for k, held in by.items():
                        held[c["mask"]] = c[k]
                rows = list(zip(*step_counts(**by)))
                arrays = [pa.array([part] * len(rows[0])), pa.array(rows[0]), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return one.mapInArrow(run, schema)


def _oracle() -> str:
    """Every document through every order, by counts of equal failures."""
    words = "list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    fails = " + ".join(f"CAST({c} AS INTEGER) * {1 << i}" for i, c in enumerate((f"len(w) < {LEAST_WORDS}", f"100 * len(list_distinct(w)) < {DISTINCT} * len(w)", f"100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {CAPITALS} * length(t)", f"regexp_matches(t, '[{SIGNS}]')", "coalesce(doc_id > least, false)")))
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {words} AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INTEGER)) AS good, max(CAST(coalesce(toxic, 0) = 1 AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, {fails} AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(range({len(FILTERS)})) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = {len(FILTERS)}),
s AS (SELECT list_reduce(list_transform(o, lambda i: '{FILTERS}'[i + 1]), lambda x, y: x || y) AS filter_order, step, CAST(1 << o[step] AS INTEGER) AS bit, CAST(list_sum(list_transform(o[1 : step - 1], lambda i: 1 << i)) AS INTEGER) AS behind FROM o, (SELECT CAST(unnest(range(1, {len(FILTERS) + 1})) AS INTEGER) AS step)),
r AS (
  SELECT part, filter_order, step, bit,
    CAST(coalesce(sum(n) FILTER (mask & (coalesce(behind, 0) | bit) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(behind, 0) = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(behind, 0) > 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & coalesce(behind, 0) = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(behind, 0) = 0), 0) AS BIGINT) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


ORACLE = _oracle()
