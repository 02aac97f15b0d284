"""Ingest into several tables: replays change nothing, whatever the cut into batches; throttling, matching and grading against plain walks."""

import random

import pytest

from hoistway.operators import leftovers
from hoistway.operators.admission import admit_floors
from hoistway.streaming.ingest import DoorIngest, HeartbeatIngest, ingest

US = 1_000_000
DAY = 86_400 * US


def snapshot(*tables):
    return [sorted(map(tuple, t.collect()), key=repr) for t in tables]


def test_admitted_floors(spark):
    rows = [(1, "a", "3", "ok"), (2, "a", "9", "ok"), (3, "b", "99", "ok"), (4, "a", "G", "ok"), (5, "a", "P2", "ok"), (6, "a", "100" + "x" * 30, "ok"), (7, "a", None, "no_read"), (8, None, "12", "ok"), (9, "a", "", None)]
    ranges = spark.createDataFrame([("a", 1, 5)], "cam string, lo int, hi int")
    got = {r.id: (r.floor, r.reason) for r in admit_floors(spark.createDataFrame(rows, "id long, cam string, floor string, reason string"), ranges).collect()}
    assert got == {
        1: ("3", "ok"), 2: (None, "invalid_label:9"), 3: ("99", "ok"), 4: ("G", "ok"), 5: ("P2", "ok"), 6: (None, "invalid_label:100" + "x" * 21),
        7: (None, "no_read"), 8: ("12", "ok"), 9: (None, "invalid_label:"),
    }


def test_door_batches_twice(spark, tmp_path):
    sink = DoorIngest(str(tmp_path), ["a"], {"a": (1, 5)})
    columns = DoorIngest.COLUMNS
    first = spark.createDataFrame([(1, "a", 5, "3", "up", "open", "ok"), (2, "b", 6, "3", "up", "open", "ok"), (3, "a", DAY + 1, "8", "sideways", None, "ok")], columns)
    second = spark.createDataFrame([(4, "a", 7, None, None, "ajar", "no_read"), (5, "a", 8, "G", "down", "closed", "ok")], columns)
    sink.write(first, 0)
    sink.write(second, 1)
    once = snapshot(sink.doors(spark), sink.rejects(spark))
    assert once[0] == sorted([(1, "a", 5, "3", "up", "open", "ok"), (3, "a", DAY + 1, None, None, None, "invalid_label:8"), (5, "a", 8, "G", "down", "closed", "ok")], key=repr)
    assert [(r[0], r[-1]) for r in once[1]] == [(2, "unknown_cam"), (4, "bad_state")]
    sink.write(second, 1)
    assert snapshot(sink.doors(spark), sink.rejects(spark)) == once


def heartbeats(seed, n):
    rng, at, rows = random.Random(seed), {"a": 0, "b": DAY - 30 * US}, []
    for i in range(n):
        cam = rng.choice("aab")
        at[cam] += rng.choice([0, 1, 7, 20, 61, 900, 3_000]) * US
        rows.append((i, cam, at[cam]))
    return rows


def plain_throttle(rows, least):
    kept, last = [], {}
    for i, cam, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if cam not in last or t - last[cam] >= least:
            kept.append((i, cam, t))
            last[cam] = t
    return kept


def test_heartbeats_in_batches_and_twice(spark, tmp_path):
    rows, least, keep = heartbeats(3, 600), 60 * US, DAY
    sink = HeartbeatIngest(str(tmp_path), least, keep)
    cuts = [rows[:150], [], rows[150:400], rows[400:]]
    for number, part in enumerate(cuts):
        sink.write(spark.createDataFrame(part, HeartbeatIngest.COLUMNS), number)
    horizon = (max(r[2] for r in rows) - keep) // DAY
    assert horizon > 0  # days were dropped
    want = sorted((r for r in plain_throttle(rows, least) if r[2] // DAY >= horizon), key=repr)
    newest = {cam: max((r for r in rows if r[1] == cam), key=lambda r: (r[2], r[0])) for cam in "ab"}
    got = snapshot(sink.history(spark), sink.current(spark))
    assert got[0] == want and {r[0]: (r[1], r[0], r[2]) for r in got[1]} == newest
    sink.write(spark.createDataFrame(cuts[-1], HeartbeatIngest.COLUMNS), len(cuts) - 1)
    assert snapshot(sink.history(spark), sink.current(spark)) == got


def test_heartbeats_as_a_stream_of_files(spark, tmp_path):
    rows, at = heartbeats(4, 200), str(tmp_path / "in")
    for part in (rows[:90], rows[90:]):  # files come in order of time
        spark.createDataFrame(part, HeartbeatIngest.COLUMNS).coalesce(1).write.mode("append").parquet(at)
    sink = HeartbeatIngest(str(tmp_path / "out"), 60 * US, 400 * DAY)
    ingest(spark.readStream.schema(HeartbeatIngest.COLUMNS).option("maxFilesPerTrigger", 1).parquet(at), sink.write)
    assert snapshot(sink.history(spark))[0] == sorted(plain_throttle(rows, 60 * US), key=repr)


def test_throttle_of_a_camera_without_silences(spark):
    rows = [(i, "a", DAY - 500 * US + i * 7 * US) for i in range(2_000)] + [(10_000 + i, "b", i * 4_000 * US) for i in range(90)]
    for least in (60 * US, 5_000 * US, 3 * DAY):
        got = sorted((r.id, r.cam, r.ts_us) for r in leftovers.throttled(spark.createDataFrame(rows, "id long, cam string, ts_us long"), least).collect())
        assert got == sorted(plain_throttle(rows, least))


def plain_match(emitted, truth, tolerance):
    free, out = sorted(truth), []
    for x in sorted(emitted):
        near = [t for t in free if abs(t - x) <= tolerance]
        best = min(near, key=lambda t: (abs(t - x), t)) if near else None
        if best is not None:
            free.remove(best)
        out.append((x, best, "matched" if near else "unmatched"))
    return out + [(None, t, "missed") for t in free]


@pytest.mark.parametrize("seed,n,span", [(0, 60, 400), (1, 300, 500), (2, 40, 4_000), (3, 0, 100)])
def test_matches_and_grades_against_a_walk(spark, seed, n, span):
    rng, tolerance = random.Random(seed), 12
    e, t = ([(rng.choice("ab"), DAY - span // 2 + rng.randrange(span)) for _ in range(n)] for _ in range(2))
    still = [("a", DAY - 40, DAY + 5), ("a", DAY - 10, DAY + 20), ("b", DAY + 3, DAY + 3)]
    frames = [spark.createDataFrame(rows, "cam string, ts_us long") for rows in (e, t)]
    windows = spark.createDataFrame(still, "cam string, lo_us long, hi_us long")
    inside = lambda cam, x: any(c == cam and lo <= x <= hi for c, lo, hi in still)
    of = lambda rows, cam: [x for c, x in rows if c == cam]
    plain = [(cam, *r) for cam in "ab" for r in plain_match(of(e, cam), of(t, cam), tolerance)]
    grade = [(c, x, y, "phantom" if kind == "unmatched" and inside(c, x) else kind) for c, x, y, kind in plain]
    score = [(cam, *r) for cam in "ab" for r in plain_match([x for x in of(e, cam) if not inside(cam, x)], of(t, cam), tolerance)] + [(c, x, None, "phantom") for c, x in e if inside(c, x)]
    assert snapshot(leftovers.greedy_match(*frames, tolerance))[0] == sorted(plain, key=repr)
    for want, first in ((score, True), (grade, False)):
        assert snapshot(leftovers.graded(*frames, windows, tolerance, first, 50))[0] == sorted(want, key=repr)


def test_matching_is_all_but_linear():
    import numpy as np

    n = 200_000  # every truth lies within the tolerance of every emission
    found = leftovers.nearest_free(np.arange(n), np.arange(n), 10 * n)
    assert found == list(range(n))
