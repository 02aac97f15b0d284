"""Statistics with the reference's conventions, as plans over (keys, value) rows.

Order statistics are taken from value counts: rows are first counted by key and value (pre-aggregated before the shuffle), and ranks run over distinct values,
so a hot key costs its distinct values, not its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, v, upto (rows with a value of at most v), n (rows of the key). Nulls take no part."""
    return ranked_counts(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c")), keys)


def ranked_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v, c, upto, n from value counts (keys, v, c)."""
    own = Window.partitionBy(*keys)
    return counts.select(*keys, "v", "c", F.sum("c").over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(own).alias("n"))


def at_rank(rank: Column) -> Column:
    """Aggregate: the value at a 1-based rank, over ranked rows."""
    return F.min(F.when(F.col("upto") >= rank, F.col("v")))


def nearest_rank(q: float) -> Column:
    """Aggregate: sorted[min(n - 1, int(q n))]."""
    return at_rank(F.least(F.col("n"), F.floor(F.lit(q) * F.col("n")) + 1))


def index_rank(q: float) -> Column:
    """Aggregate: sorted[int(q (n - 1))], the census tool's convention."""
    return at_rank(F.floor(F.lit(q) * (F.col("n") - 1)) + 1)


def linear(q: float) -> Column:
    """Aggregate: the linear percentile, between the two values around q (n - 1)."""
    at = F.lit(q) * (F.col("n") - 1)
    lo, hi = at_rank(F.floor(at) + 1), at_rank(F.ceil(at) + 1)
    whole = F.lit(q) * (F.max("n") - 1)
    return lo + (whole - F.floor(whole)) * (hi - lo)


def median_interval() -> tuple[Column, Column]:
    """Aggregates: order-statistic interval of the median, null below six values."""
    n, half = F.col("n"), F.lit(Z95) * F.sqrt(F.col("n")) / 2
    lo = F.greatest(F.lit(1), F.floor(n / 2 - half)).cast("long")
    hi = F.least(n, F.ceil(1 + n / 2 + half)).cast("long")
    return at_rank(F.when(n >= 6, lo)), at_rank(F.when(n >= 6, hi))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median, p85, lo, hi, least, most by nearest rank."""
    lo, hi = median_interval()
    return ranked(df, keys, value).groupBy(*keys).agg(F.max("n").alias("n"), nearest_rank(0.5).alias("median"), nearest_rank(0.85).alias("p85"), lo.alias("lo"), hi.alias("hi"), F.min("v").alias("least"), F.max("v").alias("most"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Interval of a share in percent, within 0..100."""
    p, z2 = k / n, Z95 * Z95
    mid, half, div = p + z2 / (2 * n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)), 1 + z2 / n
    return F.greatest(F.lit(0.0), 100 * (mid - half) / div), F.least(F.lit(100.0), 100 * (mid + half) / div)
