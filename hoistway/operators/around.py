"""Figures of the points within each of many overlapping intervals, without making the pairs.

Points go to blocks of (camera, time), each with those that its intervals reach beyond it, so that what is shuffled are the points about twice and the intervals once. A task holds a
block; within it an interval costs a few searches over index tables (log of the block's points), however many points it covers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_blocks(points: DataFrame, intervals: DataFrame, order: list[str], block_us: int, measure: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], out: str) -> DataFrame:
    """measure(points, intervals, i0, i1) of each block: ``points`` (cam, ts_us, ...) ascend by ts_us and ``order``; the points from i0 up to i1, without it, are those with lo <= ts_us <= hi of an
    interval (cam, lo, hi, ...) that has any."""
    own = intervals.where("cam IS NOT NULL AND lo <= hi").withColumn("block", F.floor(F.col("lo") / block_us))
    needs = own.groupBy("cam", "block").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).select(F.col("cam").alias("of"), F.col("block").alias("into"), "least", "most")
    needs = needs.withColumn("at", F.explode(F.sequence(F.floor(F.col("least") / block_us), F.floor(F.col("most") / block_us))))
    near = (F.col("cam") == F.col("of")) & (F.floor(F.col("ts_us") / block_us) == F.col("at")) & F.col("ts_us").between(F.col("least"), F.col("most"))
    copies = points.join(needs, near).select(*points.columns, "into")

    def run(p: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["ts_us", *order], kind="stable")
        t = p["ts_us"].to_numpy()
        i0, i1 = np.searchsorted(t, i["lo"].to_numpy(), "left"), np.searchsorted(t, i["hi"].to_numpy(), "right")
        some = i1 > i0
        return measure(p, i[some], i0[some], i1[some])

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes are much work here, and adaptive execution would put them into one task
    copies, own = copies.repartition(tasks, "cam", "into"), own.repartition(tasks, "cam", "block")
    return copies.groupBy("cam", "into").cogroup(own.groupBy("cam", "block")).applyInPandas(run, out)


class Least:
    """Minima of an array over spans of positions, and the nearest position with a value of at most a level; all for many spans at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels, self.n = [values], len(values)
        while 2 << (len(self.levels) - 1) <= self.n:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def over(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least from start up to end, without it; spans aren't empty."""
        out, size = np.empty(len(start), self.levels[0].dtype), np.frexp((end - start).astype(float))[1] - 1
        for k in np.unique(size):
            at = size == k
            out[at] = np.minimum(self.levels[k][start[at]], self.levels[k][end[at] - (1 << k)])
        return out

    def first(self, start: np.ndarray, end: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The first position from start up to end, without it, with a value of at most ``most``; -1 if none."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at + (1 << k) <= end  # all are less than twice the largest size, so each size is skipped once at most
            fits[fits] = self.levels[k][at[fits]] > most[fits]
            at[fits] += 1 << k
        return np.where(at < end, at, -1)

    def last(self, start: np.ndarray, end: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The last such position."""
        at = end.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at - (1 << k) >= start
            fits[fits] = self.levels[k][at[fits] - (1 << k)] > most[fits]
            at[fits] -= 1 << k
        return np.where(at > start, at - 1, -1)


class Ranks:
    """Values as ranks among the distinct ones, and the k-th least rank of spans by a wavelet matrix: a stable split of all positions by each bit."""

    def __init__(self, values: np.ndarray) -> None:
        self.distinct, self.of = np.unique(values, return_inverse=True)
        self.zeros, now = [], self.of
        for bit in range(max(1, int(len(self.distinct) - 1).bit_length()) - 1, -1, -1):
            one = (now >> bit) & 1
            self.zeros.append((bit, np.concatenate([[0], np.cumsum(1 - one)])))
            now = np.concatenate([now[one == 0], now[one == 1]])

    def kth(self, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The rank at 0-based place k of those from start up to end."""
        start, end, k, out = start.copy(), end.copy(), k.copy(), np.zeros(len(start), np.int64)
        for bit, zeros in self.zeros:
            a, b = zeros[start], zeros[end]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            start, end = np.where(one, zeros[-1] + start - a, a), np.where(one, zeros[-1] + end - b, b)
            out |= one.astype(np.int64) << bit
        return out

    def percentile(self, start: np.ndarray, end: np.ndarray, q: float) -> np.ndarray:
        """numpy's linear percentile (q of 0..1) of each span, to the bit."""
        at = (end - start - 1) * q
        lo = np.floor(at).astype(np.int64)
        part = at - lo
        a, b = self.distinct[self.kth(start, end, lo)], self.distinct[self.kth(start, end, np.minimum(lo + 1, end - start - 1))]
        return np.where(part >= 0.5, b - (b - a) * (1 - part), a + (b - a) * part)


def spread(array: np.ndarray, n: int, pick: Callable) -> np.ndarray:
    """At each position ``pick`` (np.minimum or np.maximum) of it and the n - 1 behind it; shorter by n - 1."""
    out = array[: max(0, len(array) - n + 1)]
    for i in range(1, n):
        out = pick(out, array[i : len(array) - n + 1 + i])
    return out


def holes(points: DataFrame, intervals: DataFrame, block_us: int) -> DataFrame:
    """id, n, hole_us: how many points (cam, ts_us) each interval (cam, id, lo, hi, both ends within) holds, and the widest gap between two of them; intervals without points give no row."""

    def measure(p: pd.DataFrame, i: pd.DataFrame, i0: np.ndarray, i1: np.ndarray) -> pd.DataFrame:
        gaps, wide = Least(-np.diff(p["ts_us"].to_numpy())), i1 - i0 > 1
        hole = pd.array(np.zeros(len(i0), np.int64), dtype="Int64")
        hole[wide] = -gaps.over(i0[wide], i1[wide] - 1)
        hole[~wide] = pd.NA
        return pd.DataFrame({"id": i["id"].to_numpy(), "n": i1 - i0, "hole_us": hole})

    return by_blocks(points, intervals, [], block_us, measure, "id long, n long, hole_us long")
