"""Planted collapses are found, quiet lifts are not."""

import random

from hoistway.operators import degradation

H, D = degradation.HOUR_US, degradation.DAY_US
NOW = 100 * D + 12 * H
DOOR = "cam string, id long, ts_us long, door_state string, door_version string, floor string, read_conf double, reason string"


def frames(spark, hours):
    """hours: (cam, hours before now, openings, boardings)."""
    door, crossings = [], []
    for cam, back, opens, boards in hours:
        start = NOW - back * H
        for i in range(opens):
            door += [(cam, len(door) + k, start + i * 60_000_000 + k, s, "v1", None, None, None) for k, s in enumerate(("open", "open", "closed" if i % 2 else None))]
        crossings += [(cam, start + i, "in") for i in range(boards)] + [(cam, start + i, "out") for i in range(3)]
    return spark.createDataFrame(door, DOOR), spark.createDataFrame(crossings, "cam string, ts_us long, direction string")


def test_a_starved_counter_is_found_and_a_quiet_lift_is_not(spark):
    past, late = [h for h in range(25, 7 * 24) if 7 <= (12 - h) % 24 < 23], [h for h in range(1, 25) if 7 <= (12 - h) % 24 < 23]
    hours = [(cam, h, 12, 24) for cam in ("dead", "fine", "brief") for h in past[:30]] + [("quiet", h, 11, 1) for h in past[:30]] + [("new", h, 12, 24) for h in past[:23]]
    hours += [("dead", h, 12, 5) for h in late[:8]] + [("fine", h, 12, 20) for h in late[:8]] + [("quiet", h, 11, 1) for h in late[:8]] + [("new", h, 12, 0) for h in late[:8]]
    hours += [("brief", h, 12, 2) for h in late[:5]] + [("brief", h, 4, 0) for h in late[5:9]] + [("fine", 8, 3, 0)]
    door, transits = frames(spark, [x for x in hours])
    got = {r.cam: r for r in degradation.starved(door, transits, NOW, 0).collect()}
    assert {c: r.state for c, r in got.items()} == {"dead": "degraded", "fine": "ok", "quiet": "ok", "new": "no baseline", "brief": "ok"}
    assert (got["dead"].baseline, got["dead"].n_under, got["dead"].n_base) == (2.0, 8, 30) and got["brief"].n_under == 5 and got["brief"].n_thin >= 4
    assert got["dead"].first_under_us == min(NOW - h * H for h in late[:8]) and got["new"].baseline is None and got["new"].n_under is None


def test_openings_and_the_median_by_rule(spark):
    door = spark.createDataFrame([("a", i, i, s, "v", None, None, None) for i, s in enumerate(["open", "open", None, "open", "closing", "open"])], DOOR)
    assert degradation.opens(door).count() == 3  # a null between two openings makes two of them
    got = spark.sql("SELECT 1").select(degradation.upper_median(degradation.F.array(*map(degradation.F.lit, (4.0, 1.0, 3.0, 2.0)))), degradation.median(degradation.F.array(*map(degradation.F.lit, (4.0, 1.0, 3.0, 2.0))))).first()
    assert tuple(got) == (3.0, 2.5)


def reads(cam, day, n, conf, version="v2", reason="ok"):
    rng = random.Random(day)
    return [(cam, day * 10_000 + i, day * D + rng.randrange(D), "open", version, "3", conf, reason) for i in range(n)]


def test_confidence_and_volume_by_era(spark):
    rows = []
    for cam in ("fell", "few", "fine", "young", "old"):
        rows += reads(cam, 80, 250, 0.2, "v1")  # an earlier era, not pooled
        rows += [r for d in range(92, 99) if cam != "young" or d > 96 for r in reads(cam, d, 220, 0.9 if d != 95 else 0.1)]
        rows += reads(cam, 94, 50, 0.0) if cam == "fine" else []
    rows += reads("fell", 99, 220, 0.8) + reads("few", 99, 60, 0.95) + reads("fine", 99, 210, 0.87) + reads("young", 99, 220, 0.1)
    rows += reads("fell", 100, 5, 0.0) + [("door", 1, 99 * D, "open", "v2", None, None, None)] + reads("door", 98, 300, 0.9, reason="ambiguous")
    got = {r.cam: r for r in degradation.misreading(spark.createDataFrame(rows, DOOR), NOW, 0).collect()}
    assert {c: (r.state, r.confidence_fell, r.volume_fell) for c, r in got.items()} == {
        "fell": ("degraded", True, False), "few": ("degraded", False, True), "fine": ("ok", False, False), "young": ("baseline building", False, False), "old": ("ok", False, False), "door": ("no reads", False, False),
    }
    assert abs(got["fell"].base_conf - 0.9) < 1e-9 and got["fell"].base_reads == 220 and got["fell"].era == "v2" and got["few"].recent_conf is None and got["young"].n_base == 2
