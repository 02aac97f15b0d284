"""Mergeable cycle partials: folding equals direct computation, one day's change rewrites one partition, and the resolution rules."""

import os
import random
import statistics

from hoistway.operators import demand, partials

H, D = demand.HOUR_US, demand.DAY_US
SCHEMA = "cam string, door_version string, ts_us long, close_us long, class string, close_travel_s double, open_travel_s double, dwell_s double, boarded long, alighted long"


def cycles(seed, n=300):
    rng, rows = random.Random(seed), []
    for i in range(n):
        t = rng.randrange(4 * D)
        travel = rng.choice([None, 0.2, 0.4, round(rng.uniform(0.5, 9), 2)])
        start = None if rng.random() < 0.1 else t
        rows.append((rng.choice("ab"), rng.choice(["v1", "v2"]), start, t + 5_000_000, rng.choice(["clean", "clean", "flap"]), travel, rng.choice([None, 0.0, 1.25, 2.5]), rng.choice([None, 0.0, 4.5, 12.0]), None if start is None else rng.randrange(3), None if start is None else rng.randrange(3)))
    return rows


def outages(spark):
    return demand.Outages(spark.createDataFrame([(D, D + 6 * H, None), (2 * D, 2 * D + H, "a")], "start_us long, end_us long, gap_cam string"), ("a", "b"))


def direct(rows, cam, version):
    own = [r for r in rows if r[0] == cam and r[1] == version]
    at = lambda r: r[3] if r[2] is None else r[2]
    gapped = [r for r in own if D <= at(r) < D + 6 * H or cam == "a" and 2 * D <= at(r) < 2 * D + H]
    free = [r for r in own if r not in gapped]
    clean = sorted(r[5] for r in free if r[4] == "clean" and r[5] is not None)
    closes = [v for v in clean if v >= 0.5]
    mean = statistics.fmean(closes)
    transfer = [r[7] / (r[8] + r[9]) for r in free if r[8] is not None and r[8] + r[9] > 0 and r[7] and r[7] > 0]
    rank = lambda v, q: v[min(len(v) - 1, int(q * len(v)))]
    return {
        "cycles": len(free), "in_gap": len(gapped), "excluded": len(free) - len(clean), "floor_rejected": len(clean) - len(closes), "counted": sum(r[8] is not None for r in free), "boarded": sum(r[8] or 0 for r in free),
        "close_n": len(closes), "close_median": rank(closes, 0.5), "close_p85": rank(closes, 0.85), "close_least": closes[0], "close_mean": mean, "close_mean_hi": mean + 1.959963984540054 * statistics.stdev(closes) / len(closes) ** 0.5,
        "prefilter_n": len(clean), "prefilter_median": rank(clean, 0.5), "dwell_n": sum(bool(r[7]) for r in free), "open_n": sum(bool(r[6]) for r in free), "transfer_n": len(transfer), "transfer_mean": statistics.fmean(transfer), "over": sum(v > 2.31 for v in closes),
        "first_us": min(map(at, free)), "last_us": max(map(at, free)), "floor_reject_warn": (len(clean) - len(closes)) / len(clean) > 0.05,
    }


def test_figures_folded_from_partials_equal_direct_ones(spark):
    rows = cycles(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.cam, r.door_version): r for r in partials.summary(partials.partials(df, outages(spark), 0), partials.ERA).collect()}
    for key, r in got.items():
        for name, want in direct(rows, *key).items():
            assert r[name] == want or abs(r[name] - want) < 1e-9, (key, name)
        closes = [x[5] for x in rows if x[:2] == key and x[4] == "clean" and (x[5] or 0) >= 0.5]
        assert sum(r.close_hist) == r.close_n <= len(closes) and len(r.close_hist) == len(partials.CLOSE_EDGES) + 1 and r.close_hist[0] == 0
        assert -1e-9 <= r.over_lo <= r.over_pct + 1e-9 and r.over_pct <= r.over_hi + 1e-9 <= 100 + 1e-6
    assert len(got) == 4 and partials.summary(partials.partials(df.limit(0), outages(spark), 0), partials.ERA).count() == 0


def test_folding_in_two_steps_is_folding_once(spark):
    df = spark.createDataFrame(cycles(2), SCHEMA)
    rows = partials.partials(df, outages(spark), 0)
    halves = partials.partials(df.where("close_us % 2 = 0"), outages(spark), 0).unionByName(partials.partials(df.where("close_us % 2 = 1"), outages(spark), 0))
    pick = ["cam", "cycles", "close_n", "close_median", "dwell_median", "boarded", "over"]
    assert sorted(partials.summary(rows, ["cam"]).select(*pick).collect()) == sorted(partials.summary(halves, ["cam"]).select(*pick).collect())


def test_one_changed_day_rewrites_one_partition(spark, tmp_path):
    rows, path = cycles(3), str(tmp_path / "p")
    load = lambda r: spark.createDataFrame(r, SCHEMA)
    stamps = lambda: {d: sorted(os.listdir(f"{path}/days/{d}")) for d in os.listdir(f"{path}/days") if d.startswith("day=")}
    assert partials.refresh(load(rows), path, outages(spark), 0, 1.0) == [0, 1, 2, 3]
    before = stamps()
    assert partials.refresh(load(rows), path, outages(spark), 0, 2.0) == [] and stamps() == before
    more = rows + [("a", "v1", 2 * D + 5 * H, 2 * D + 5 * H + 9, "clean", 3.0, None, None, 1, 0)]
    assert partials.refresh(load(more), path, outages(spark), 0, 3.0) == [2]
    after = stamps()
    assert {d for d in after if after[d] != before[d]} == {"day=2"}
    fold = lambda rows: sorted(map(tuple, partials.counters(rows, partials.ERA).select("cam", "door_version", *partials.COUNTERS, "first_us", "last_us").collect()))
    assert fold(partials.stored_partials(spark, path)) == fold(partials.partials(load(more), outages(spark), 0))
    without = [r for r in more if (r[3] if r[2] is None else r[2]) < 3 * D]
    assert partials.refresh(load(without), path, outages(spark), 0, 4.0) == [3] and "day=3" not in stamps()


def test_windows_and_ratio(spark):
    at = lambda hour, cam="a": (cam, "v1", hour * H, hour * H + 1, "clean", 2.0, None, 6.0, 1, 2)
    rows = partials.partials(spark.createDataFrame([at(8), at(9), at(9), at(20), at(30)], SCHEMA), demand.Outages(spark.createDataFrame([], "start_us long, end_us long, gap_cam string"), ("a",)), 0)
    got = {r.window: r for r in partials.profile(rows, ["cam"], {"am": (8, 10), "all": (0, 24), "pm": (18, 20)}, 2).collect()}
    assert set(got) == {"am", "all"} and (got["am"].cycles, got["am"].cycles_per_hour, got["am"].transfer_mean) == (3, 0.75, 2.0)
    assert abs(got["am"].ratio - 0.75 / (5 / 48)) < 1e-9 and got["all"].ratio == 1.0


def test_pools_bound_by_the_sampling_quantum(spark):
    rng = random.Random(5)
    cycle = lambda version, close, opening=None: ("a", version, rng.randrange(D), D, "clean", close, opening, None, None, None)
    rows = [cycle("grid", 0.5 * k, 0.5) for k in (1, 2, 3, 4, 6, 8) * 20] + [cycle("few", 1.0, 0.5) for _ in range(5)] + [cycle("free", rng.uniform(0.5, 9)) for _ in range(200)]
    none = demand.Outages(spark.createDataFrame([], "start_us long, end_us long, gap_cam string"), ("a",))
    got = {r.door_version: r for r in partials.resolution(partials.partials(spark.createDataFrame(rows, SCHEMA), none, 0), partials.ERA).collect()}
    assert abs(got["grid"].quantum_s - 0.5) < 0.01 and got["grid"].source == "own" and got["grid"].open_suppressed and not got["grid"].close_suppressed
    assert got["few"].source == "others" and got["few"].open_suppressed and got["few"].close_at_quantum == 0
    assert not got["free"].close_suppressed
