"""Demand on the observed calendar: dark apart from zero, coverage by one rule, plain walks over small periods."""

from hoistway.operators import demand

H, D, S = demand.HOUR_US, demand.DAY_US, demand.SLOT_US
P = demand.Period(("a", "b"), -19_800_000_000 + 10 * D, -19_800_000_000 + 12 * D, 19_800_000_000)
T0 = P.t0


def frames(spark, transits, doors, gaps=(), epochs=((None, 0, "v1"),), episodes=()):
    t = spark.createDataFrame([(i, cam, T0 + at, d) for i, (cam, at, d) in enumerate(transits)], "id long, cam string, ts_us long, direction string")
    rows = spark.createDataFrame([(cam, T0 + at) for cam, at in doors] + [(cam, T0 + at) for cam, at, _ in transits], "cam string, ts_us long")
    out = demand.Outages(spark.createDataFrame([(T0 + lo, T0 + hi, cam) for lo, hi, cam in gaps], "start_us long, end_us long, gap_cam string"), P.cams)
    e = spark.createDataFrame([(cam, T0 + at, b, al, v) for cam, at, b, al, v in episodes], "cam string, start_us long, machine_boarded int, machine_alighted int, counting_version string")
    return t, rows, out, spark.createDataFrame([(c, f, v) for c, f, v in epochs], "cam string, from_us long, version string"), e


def test_dark_is_not_zero(spark):
    t, rows, out, epochs, _ = frames(spark, [("a", 100, "in"), ("a", 200, None), ("b", 5 * H, "in")], [("a", 2 * H + 5)], gaps=[(4 * H, 6 * H, None)])
    got = {((r.hour_us - T0) // H, r.lift): (r.boarded, r.alighted, r.observed, r.lifts) for r in demand.hourly_log(t, rows, P, out, epochs).collect()}
    assert len(got) == 48 * 3
    assert got[0, "a"] == (1, 1, True, None) and got[0, "b"] == (None, None, False, None) and got[0, demand.FLEET] == (1, 1, True, 1)
    assert got[2, "a"] == (0, 0, True, None) and got[2, demand.FLEET] == (0, 0, True, 1)  # watched and idle
    assert got[1, "a"] == (None, None, False, None) and got[1, demand.FLEET] == (None, None, False, 0)
    assert got[5, "b"] == (None, None, False, None)  # an outage is no observation


def test_versions_are_never_pooled(spark):
    t, rows, out, epochs, _ = frames(spark, [("a", 10 * 60_000_000, "in"), ("a", 40 * 60_000_000, "in"), ("b", 50 * 60_000_000, "out")], [], epochs=[(None, 0, "v1"), ("a", T0 + H // 2 + 1, "v2")])
    got = sorted((r.lift, r.version, r.boarded, r.alighted, r.lifts or 0) for r in demand.hourly_log(t, rows, P, out, epochs).where(f"hour_us = {T0}").collect())
    assert got == [("FLEET", "v1", 1, 1, 2), ("FLEET", "v2", 1, 0, 1), ("a", "v1", 1, 0, 0), ("a", "v2", 1, 0, 0), ("b", "v1", 0, 1, 0)]
    assert sorted((r.cam, r.version, r.boarded) for r in demand.daily_log(t, rows, P, out, epochs).collect()) == [("a", "v1", 1), ("a", "v2", 1), ("b", "v1", 0)]


def test_coverage_is_at_most_whole(spark):
    """A row just outside an outage that takes nearly the whole hour credits no hour that the other side has written off."""
    doors = [("a", h * H + 1) for h in range(24)] + [("a", 24 * H + 1), ("b", 3 * H)]
    t, rows, out, epochs, _ = frames(spark, [], doors, gaps=[(14 * 60_000_000, 23 * H + 50 * 60_000_000, "a"), (24 * H, 48 * H, "b")])
    got = {(r.day, r.cam): (r.hours_observed, r.usable_hours, r.coverage_pct) for r in demand.daily_log(t, rows, P, out, epochs).collect()}
    assert got == {(10, "a"): (0, 0, None)} | {(11, "a"): (1, 24, 100 / 24), (10, "b"): (1, 24, 100 / 24)} or got == {(11, "a"): (1, 24, 100 / 24), (10, "b"): (1, 24, 100 / 24)}
    pct = {(r.day, r.cam): (r.observed, r.usable, r.coverage_pct) for r in demand.coverage(rows, P, out).collect()}
    assert pct[10, "a"] == (1, 96 - (23 * 60 + 36) // 15, 50.0) and pct[11, "b"] == (0, 0, None) and pct[10, "b"] == (1, 96, 100 / 96)
    assert pct[None, "a"][0] == 2 and all(p is None or p <= 100 for _, _, p in pct.values())


def test_means_peaks_and_spread(spark):
    transits = [(cam, day * D + 8 * H + k, "in") for cam, n in (("a", 3), ("b", 1)) for day in (0, 1) for k in range(n)] + [("a", 9 * H, "out")]
    t, rows, out, epochs, e = frames(spark, transits, [("b", D + 9 * H)], episodes=[("a", 8 * H, 2, 1, "v1")])
    means = demand.hour_means(t, e, rows, P, out, epochs)
    got = {(r.lift, r.hour): (r.observed_days, r.boarded, r.alighted, r.mean_boarded, r.lifts) for r in means.collect()}
    assert got["a", 8] == (2, 8, 1, 4.0, None) and got["b", 8] == (2, 2, 0, 1.0, None) and got[demand.FLEET, 8] == (4, 10, 1, 5.0, 2)
    assert got["b", 9] == (1, 0, 0, 0.0, None) and got["b", 7] == (0, None, None, None, None) and got[demand.FLEET, 7][3:] == (None, 0)
    peak = {r.lift: (r.hour, r.value, r["mean"], r.ratio, r.n_hours) for r in demand.peaks(means).collect()}
    assert peak["a"] == (8, 4.0, 2.0, 2.0, 2) and peak["b"] == (8, 1.0, 0.5, 2.0, 2)
    assert {r.cv for r in demand.load_balance(means).collect()} == {None}  # two lifts are no spread


def test_a_day_of_two_versions_is_marked(spark):
    episodes = [("a", H, 1, 0, "v1"), ("a", 2 * H, 1, 0, "v2"), ("b", H, 1, 0, "v1")]
    t, rows, out, epochs, e = frames(spark, [("a", H, "in"), ("b", D + H, "out")], [("b", H)], epochs=[(None, 0, "v2")], episodes=episodes)
    now = spark.createDataFrame([("a", "v2"), ("b", "v2")], "cam string, version string")
    got = {(r.day, r.cam): r for r in demand.day_matrix(t, e, rows, P, out, epochs, now).collect()}
    assert (got[10, "a"].mixed, got[10, "a"].version, got[10, "a"].off_era) == (True, None, False)
    assert (got[10, "b"].version, got[10, "b"].source, got[10, "b"].off_era, got[10, "b"].riders) == ("v1", "episodes", True, 0)
    assert (got[11, "a"].riders, got[11, "a"].off_era, got[11, "a"].dark) == (None, None, 1) and got[11, "b"].source == "declared"
    assert (got[10, None].riders, got[None, "a"].riders, got[None, "a"].dark, got[None, None].riders) == (1, 1, 1, 2)
