"""Figures of overlapping windows by index tables against walks over each window, and that points are shuffled, not pairs."""

import random

import numpy as np
import pytest

from hoistway.operators import around, carry, leftovers, ramps

US = 1_000_000


def made(seed, n, spread, values):
    rng = random.Random(seed)
    points = [(rng.choice("ab"), rng.randrange(spread) * US, rng.choice(values)) for _ in range(n)]
    windows = [(rng.choice("abc"), w, lo, lo + rng.choice([0, 3, 40, 90, 700]) * US, (lo + rng.randrange(-20, 100) * US)) for w in range(150) for lo in [rng.randrange(-50, spread) * US]]
    return points, windows, "cam string, window_id long, lo long, hi long, anchor_us long"


def pairs(spark, points, windows, rng):
    rows = [(w, t, v, anchor) for cam, w, lo, hi, anchor in windows for c, t, v in points if c == cam and lo <= t <= hi]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "window_id long, ts_us long, value double, anchor_us long")


def test_index_tables():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 8, 9, 100, 128):
        v = rng.integers(0, 9, n) * 0.37
        start = rng.integers(0, n, 300)
        end, most = np.array([rng.integers(s + 1, n + 1) for s in start]), rng.integers(-1, 9, 300) * 0.37
        least, ranks = around.Least(v), around.Ranks(v)
        assert (least.over(start, end) == [v[s:e].min() for s, e in zip(start, end)]).all()
        for s, e, m, first, last in zip(start, end, most, least.first(start, end, most), least.last(start, end, most)):
            at = np.flatnonzero(v[s:e] <= m) + s
            assert (first, last) == ((at[0], at[-1]) if len(at) else (-1, -1))
        for q in (5, 37, 95):
            assert (ranks.percentile(start, end, q / 100) == [np.percentile(v[s:e], q) for s, e in zip(start, end)]).all()


@pytest.mark.parametrize("seed, n, values", [(1, 500, [0.0, 0.1, 0.5, 0.9, 1.0]), (2, 900, [i / 100 for i in range(100)]), (3, 60, [0.2, 0.8]), (4, 1500, [-1.5, 0.3, 0.31, 2.0])])
def test_descents_and_ramps_are_those_of_walks(spark, seed, n, values):
    points, windows, schema = made(seed, n, 600, values)  # several points at most times
    rows, p, w = pairs(spark, points, windows, random.Random(seed)), spark.createDataFrame(points, "cam string, ts_us long, value double"), spark.createDataFrame(windows, schema)
    p = p.unionByName(spark.createDataFrame([("a", None, 0.5), (None, 5, 0.5)], p.schema))  # take no part
    for hold, flat in ((2, 2), (3, 1), (1, 4)):
        r = ramps.Ramp(hold=hold, flat=flat, rise=0.05)
        want = sorted(map(repr, ramps.estimates(rows, r).collect()))
        assert want == sorted(map(repr, ramps.estimates_around(p, w, r, 100 * US).collect())) and len(want) > 100
    top, low = max(values) * 0.8, max(values) * 0.4
    want = sorted(map(repr, leftovers.descents(rows, top, low).collect()))
    assert want == sorted(map(repr, leftovers.descents_around(p, w, top, low, 100 * US).collect()))


def test_holes_are_those_of_walks(spark):
    points, windows, schema = made(5, 800, 900, [0.0])
    want = []
    for cam, w, lo, hi, _ in windows:
        t = sorted(x for c, x, _ in points if c == cam and lo <= x <= hi)
        want += [(w, len(t), max((b - a for a, b in zip(t, t[1:])), default=None))] if t else []
    intervals = spark.createDataFrame(windows, schema).withColumnRenamed("window_id", "id")
    got = around.holes(spark.createDataFrame(points, "cam string, ts_us long, value double").select("cam", "ts_us"), intervals, 100 * US)
    assert sorted(map(tuple, got.collect())) == want


def test_a_crowd_of_windows_makes_no_pairs(spark):
    """20,000 points under 20,000 windows that each hold all of them: 400 million pairs. Each way takes seconds."""
    p = spark.range(20_000).selectExpr("'a' AS cam", "id * 1000 AS ts_us", "CAST(id % 100 AS DOUBLE) AS value")
    w = spark.range(20_000).selectExpr("'a' AS cam", "id AS window_id", "id - 20000 AS lo", "20000000 + id AS hi", "id * 1000 AS anchor_us")
    assert leftovers.descents_around(p, w, 80.0, 20.0, 3600 * US).where("n = 20000 AND descent_s = 0.001").count() == 20_000
    assert ramps.estimates_around(p, w, ramps.Ramp(), 3600 * US).where("est_s IS NOT NULL").count() > 80_000
    assert around.holes(p.select("cam", "ts_us"), w.withColumnRenamed("window_id", "id"), 3600 * US).where("n = 20000 AND hole_us = 1000").count() == 20_000


def test_trailing_peak_is_that_of_walks(spark):
    rng, want = random.Random(9), {}
    rows = [(rng.choice("ab"), rng.randrange(200) * 3600 * US) for _ in range(400)] + [("c", None), (None, 5)]
    for cam in "ab":
        t = [x for c, x in rows if c == cam]
        peak, back = max((sum(x - 90_000 * US < y <= x for y in t), -x) for x in t)
        want[cam] = (peak, -back)
    assert {r.cam: (r.peak, r.at_us) for r in carry.trailing_peak(spark.createDataFrame(rows, "cam string, ts_us long"), 90_000 * US).collect()} == want | {"c": (1, None)}
