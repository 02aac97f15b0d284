"""Operators on random eras with ties and null states, against plain walks; literal cases for statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hoistway.functions import stats
from hoistway.operators import cycles, joins, leftovers

DOOR = "id long, cam string, ts_us long, floor string, direction string, door_state string, reason string, close_travel_s double, door_version string"
US = 1_000_000


@pytest.fixture(scope="module")
def door_rows():
    rng, rows, n = random.Random(3), [], 0
    for era in range(25):
        t = 0
        for _ in range(rng.choice([0, 1, 5, 60, 200])):
            t += int(rng.choice([0, 0, 0.1, 1, 5, 30]) * US)
            n += 1
            rows.append((n, f"ch{era % 5}", t, rng.choice(["G", "G", "3", "7", None]), None, rng.choice(["opening", "open", "closing", "closed", None]), "ok", rng.choice([None, 0.1, 2.0, 5.0, 40.0]), f"v{era}"))
    return rows


@pytest.fixture(scope="module")
def door(spark, door_rows):
    return spark.createDataFrame(door_rows, DOOR).cache()


def eras(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault((r[1], r[8]), []).append(r)
    return out


def test_state_only_cycles(door, door_rows):
    want = sorted(b[0] for rows in eras(door_rows).values() for a, b in zip(rows, rows[1:]) if b[5] == "closed" and a[5] in ("closing", "open"))
    assert sorted(r.id for r in cycles.state_only_cycles(door).collect()) == want


def test_flap_aware_cycles(door, door_rows):
    th, want = cycles.Thresholds(), []
    for key, rows in eras(door_rows).items():
        runs = []
        for r in (r for r in rows if r[5] is not None):
            if not runs or runs[-1][0] != r[5]:
                runs.append([r[5], r[2], None, None])
            runs[-1][2] = runs[-1][2] if runs[-1][2] is not None else r[7]
        flap = reopen = False
        prev = None
        for s, t, ct, _ in runs:
            if prev:
                since = (t - prev[1]) / US
                if s == "opening" and prev[0] == "closed":
                    flap = reopen = False
                if s == "open" and prev[0] == "closing":
                    flap, reopen = flap or since < th.flap_s, reopen or since >= th.flap_s
                if s == "closing" and prev[0] == "open":
                    flap = flap or since < th.min_dwell_s
                if s == "closed" and prev[0] == "closing":
                    v = prev[2] if prev[2] is not None else ct
                    if v is not None and v > 0:
                        want.append((*key, t, "flap" if flap else "reopened" if reopen else "clean" if 0.3 <= v <= 30 else "implausible"))
                    flap = reopen = False
            prev = (s, t, ct)
    got = [(r.cam, r.door_version, r.close_us, r["class"]) for r in cycles.flap_aware_cycles(door, th).collect()]
    assert sorted(got) == sorted(want)


def test_round_trips(door, door_rows):
    want = []
    for key, rows in eras(door_rows).items():
        closes, opens, floor_since, floor_ever, prev = [], [], None, None, None
        for r in rows:
            floor_since, floor_ever = r[3] or floor_since, r[3] or floor_ever
            if r[5] == "closed" and prev in ("closing", "open"):
                closes.append((r[2], floor_since))
                floor_since = None
            if r[5] == "open" and prev != "open":
                opens.append((r[2], floor_ever))
            prev = r[5]
        for t, f in closes:
            if f == "G" and (back := next((o for o, g in opens if o > t and g == "G"), None)) is not None:
                want.append((*key, t, back, sum(t < c <= back for c, _ in closes)))
    got = [(r.cam, r.door_version, r.ts_us, r.back_us, r.n_stops) for r in cycles.round_trips(door, "G").collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("values", [[], [1.0], [1, 2, 3, 4], [1, 1, 2, 5, 9], list(range(6)), [7] * 30, [0.1 * i for i in range(30)]])
def test_nearest_rank(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None), ("b", 1.0)], "k string, x double")
    got = {r.k: r for r in stats.summary(df, ["k"], "x").collect()}.get("a")
    if not values:
        assert got is None
        return
    s, n = sorted(float(v) for v in values), len(values)
    pick = lambda q: s[min(n - 1, int(q * n))]
    assert (got.n, got.median, got.p85, got.least, got.most) == (n, pick(0.5), pick(0.85), s[0], s[-1])
    if n < 6:
        assert got.lo is None and got.hi is None
    else:
        half = stats.Z95 * math.sqrt(n) / 2
        assert got.lo == s[max(1, math.floor(n / 2 - half)) - 1] and got.hi == s[min(n, math.ceil(1 + n / 2 + half)) - 1]


def test_wilson(spark):
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(0.0, 10.0), (10.0, 10.0), (5.0, 10.0)], "k double, n double").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert r[0].lo == 0 and abs(r[0].hi - 27.7533) < 1e-3 and abs(r[1].hi - 100) < 1e-9 and abs(r[2].lo - 23.6593) < 1e-3


def test_interval_join_is_closed_and_meets_once(spark):
    points = spark.createDataFrame([(i, "c", i * 10) for i in range(20)], "id long, cam string, ts_us long")
    spans = spark.createDataFrame([(1, "c", 0, 95), (2, "c", 50, 50), (3, "c", 33, 34), (4, "d", 0, 999)], "s long, cam string, lo long, hi long")
    got = sorted((r.id, r.s) for r in joins.point_in_interval(points, spans, "lo", "hi", 25).select("p.id", "i.s").collect())
    assert got == sorted((i, s) for i in range(20) for s, c, lo, hi in [(1, "c", 0, 95), (2, "c", 50, 50), (3, "c", 33, 34)] if lo <= i * 10 <= hi)


def test_greedy_match_uses_each_truth_once(spark):
    e = spark.createDataFrame([("c", t) for t in (10, 12, 100, 500)], "cam string, ts_us long")
    t = spark.createDataFrame([("c", t) for t in (11, 14, 300)], "cam string, ts_us long")
    got = sorted((r.kind, r.emitted_us or -1, r.truth_us or -1) for r in leftovers.greedy_match(e, t, 5).collect())
    assert got == [("matched", 10, 11), ("matched", 12, 14), ("missed", -1, 300), ("unmatched", 100, -1), ("unmatched", 500, -1)]


def test_quantum(spark):
    import numpy as np

    steps = np.arange(1, 60)
    assert abs(leftovers.quantum_of(0.24 * steps, np.ones(59, int)) - 0.24) < 0.01
    assert leftovers.quantum_of(np.array([1.0]), np.array([5])) is None
