"""Machines over streams: the same rows whatever the order and the files in which they come, and late attribution as a join of two streams."""

import json
import os
import random

import pytest

from hoistway.streaming import jobs, machines, ordered

US = 1_000_000
LATE_S = 120
SAMPLES = "cam string, ts_us long, id long, value double"
CASES = {
    "cycles": ("cam string, door_version string, ts_us long, id long, door_state string", lambda df: jobs.door_cycles(df, LATE_S * US), lambda saved: jobs.Cycles(saved), ["cam", "door_version"]),
    "edges": (SAMPLES, lambda df: machines.edge_cycles(df, LATE_S * US), lambda saved: machines._Sampled(machines.EdgeMachine(machines.Edge(), saved)), ["cam"]),
    "signal": (SAMPLES, lambda df: machines.door_signal(df, LATE_S * US), lambda saved: machines._Sampled(machines.DoorMachine(machines.Signal(), saved)), ["cam"]),
    "commits": ("cam string, ts_us long, id long, lo long, hi long, reason string", lambda df: jobs.committed_intervals(df, 20 * US, 600 * US, LATE_S * US), lambda saved: jobs.Commits(20 * US, 600 * US, saved), ["cam"]),
    "episodes": (
        "cam string, ts_us long, id long, direction string, track_ids array<long>, detections long, occupancy long, segments long, dropped long",
        lambda df: jobs.audited_episodes(df, 8 * US, 25 * US, LATE_S * US), lambda saved: jobs.Episodes(8 * US, 25 * US, saved), ["cam"],
    ),
}


def made(kind, rng):
    """Rows of two cameras over some minutes, with ties in time."""
    rows = []
    for cam in ("a", "b"):
        t = rng.randrange(5) * US
        for i in range(260):
            t += rng.choice([0, 100_000, 500_000, 1_000_000, 3_000_000, 9_000_000]) if kind in ("cycles", "episodes", "commits") else 100_000
            row = {"cam": cam, "ts_us": t, "id": i}
            if kind == "cycles":
                row |= {"door_version": rng.choice(["v1", "v1", "v2"]), "door_state": rng.choice(["closed", "opening", "open", "closing", None])}
            elif kind in ("edges", "signal"):
                at = i % 80
                level = 0 if at < 20 else (at - 20) * 5 if at < 40 else 100 if at < 60 else 100 - (at - 60) * 5
                row["value"] = rng.choice([None, float("nan")]) if i % 97 == 5 else float(level + rng.randrange(3))
            elif kind == "commits":
                lo = t - rng.randrange(90) * US
                row |= {"lo": lo, "hi": lo + rng.randrange(1, 40) * US, "reason": rng.choice([None, None, "data_hole"])}
            else:
                crossing = rng.random() < 0.4
                row |= {"direction": rng.choice(["in", "out"]) if crossing else None, "track_ids": [rng.randrange(4)] if rng.random() < 0.7 else rng.choice([None, []]), "detections": None if crossing or rng.random() < 0.3 else rng.randrange(5)}
                row |= {"occupancy": None if crossing else rng.randrange(9), "segments": rng.choice([None, 1, 2]), "dropped": rng.choice([0, 0, 1])}
            rows.append(row)
    return rows


def walked(rows, make, keys):
    """The machine over each key's rows in order, saved and loaded as JSON on the way."""
    out = []
    for key in sorted({tuple(r[k] for k in keys) for r in rows}):
        saved = None
        for r in sorted((r for r in rows if tuple(r[k] for k in keys) == key), key=lambda r: (r["ts_us"], r["id"])):
            m = make(saved)
            out += [(*key, *x) for x in m.step({k: None if isinstance(v, float) and v != v else v for k, v in r.items()})]
            saved = json.loads(json.dumps(m.saved()))
        out += [(*key, *x) for x in make(saved).expire(ordered.END_US)]
    return sorted(out, key=str)


def in_files(rows, at, files, rng, late_s):
    """Rows come late by up to late_s, cut into files that are read one after another."""
    come = sorted(rows, key=lambda r: (r["ts_us"] + rng.random() * late_s * US, r["id"]))
    at.mkdir()
    per = -(-len(come) // files)
    for f in range(files):
        part = come[f * per : (f + 1) * per]
        rng.shuffle(part)
        (at / f"{f}.json").write_text("\n".join(json.dumps(r) for r in part))
        os.utime(at / f"{f}.json", (1_700_000_000 + f, 1_700_000_000 + f))
    return str(at)


@pytest.mark.parametrize("kind", CASES)
def test_rows_do_not_depend_on_their_order_or_files(spark, tmp_path, kind):
    schema, run, make, keys = CASES[kind]
    rng = random.Random(len(kind))
    rows = made(kind, rng)
    want = walked(rows, make, keys)
    assert len(want) > 3
    for n, files in enumerate((1, 4)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("allowNonNumericNumbers", True).json(in_files(rows, tmp_path / str(n), files, rng, LATE_S * 0.9))
        closable = ordered.Closable(stream)
        assert sorted((tuple(r) for r in ordered.drain(run(closable.rows), [closable]).collect()), key=str) == want


def test_late_attribution_is_the_batch_join_with_bounded_state(spark, tmp_path):
    rng = random.Random(3)
    transits = [{"cam": rng.choice("ab"), "id": i, "ts_us": rng.randrange(900) * US} for i in range(200)]
    episodes = [{"cam": rng.choice("ab"), "id": i, "ts_us": (lo := rng.randrange(900) * US), "end_us": lo + rng.randrange(25) * US} for i in range(60)]
    want = {t["id"]: min((e["id"] for e in episodes if e["cam"] == t["cam"] and e["ts_us"] - 5 * US <= t["ts_us"] <= e["end_us"] + 5 * US), default=None) for t in transits}
    assert None in want.values() and len(set(want.values())) > 10
    read = lambda schema, rows, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(in_files(rows, tmp_path / name, 3, rng, 50))
    t = ordered.Closable(read("cam string, id long, ts_us long", transits, "t"))
    e = ordered.Closable(read("cam string, id long, ts_us long, end_us long", episodes, "e"), {"cam": "", "end_us": ordered.END_US})
    matches = ordered.drain(jobs.late_attribution(t.rows, e.rows, 5 * US, 25 * US, 60 * US, 60 * US), [t, e])
    assert {r.id: r.episode_id for r in jobs.attributions(matches).collect()} == want
    assert ordered.drain.progress["stateOperators"][0]["numRowsTotal"] <= 8  # the rows that close the streams, at most


def test_late_attribution_keeps_rows_not_pairs(spark, tmp_path):
    """Where all of a camera meets, what comes out and is kept is one row a transit; an episode beyond the longest, transits without a camera or id count too."""
    transits = [{"cam": "a", "id": i, "ts_us": (100 + i % 50) * US} for i in range(600)] + [{"cam": None, "id": 1000, "ts_us": 120 * US}, {"cam": "a", "id": None, "ts_us": 5 * US}]
    transits += [{"cam": "a", "id": 1002, "ts_us": 700 * US}, {"cam": "a", "id": 1003, "ts_us": 900 * US}]
    episodes = [{"cam": "a", "id": 5 + i, "ts_us": (90 + i % 40) * US, "end_us": (150 + i % 7) * US} for i in range(300)] + [{"cam": "a", "id": 400, "ts_us": 130 * US, "end_us": 800 * US}, {"cam": None, "id": 1, "ts_us": 100 * US, "end_us": 150 * US}]
    for name, rows in (("t", transits), ("e", episodes)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.json").write_text("\n".join(json.dumps(r) for r in rows))
    t = ordered.Closable(spark.readStream.schema("cam string, id long, ts_us long").json(str(tmp_path / "t")))
    e = ordered.Closable(spark.readStream.schema("cam string, id long, ts_us long, end_us long").json(str(tmp_path / "e")), {"cam": "", "end_us": ordered.END_US})
    matches = ordered.drain(jobs.late_attribution(t.rows, e.rows, 5 * US, 25 * US, 60 * US, 60 * US), [t, e]).collect()
    want = {i: 5 for i in range(600)} | {1000: None, None: None, 1002: 400, 1003: None}
    assert len(matches) == len(transits) and {r.id: r.episode_id for r in matches} == want


def test_rows_later_than_the_lateness_are_dropped(spark, tmp_path):
    rows = [{"cam": "a", "door_version": "v", "ts_us": (i + 1) * 60 * US, "id": i, "door_state": s} for i, s in enumerate(["open", "closed", "open", "closed"])]
    at = tmp_path / "in"
    at.mkdir()
    for f, r in enumerate([rows[0], rows[1], rows[3], rows[2] | {"ts_us": 61 * US}]):
        (at / f"{f}.json").write_text(json.dumps(r))
        os.utime(at / f"{f}.json", (1_700_000_000 + f, 1_700_000_000 + f))
    stream = ordered.Closable(spark.readStream.schema(CASES["cycles"][0]).option("maxFilesPerTrigger", 1).json(str(at)))
    assert [r.id for r in ordered.drain(jobs.door_cycles(stream.rows, 30 * US), [stream]).collect()] == [1]


def test_settled_intervals_are_forgotten_as_time_passes():
    c, most = jobs.Commits(20 * US, 600 * US), 0
    for i in range(5_000):  # all in one go: expire() isn't called in between
        assert c.step({"id": i, "lo": i * 100 * US, "hi": (i * 100 + 50) * US, "ts_us": (i * 100 + 80) * US, "reason": None})
        most = max(most, len(c.taken))
    assert most <= 8


class _Held(dict):
    """A map or a value of state, in memory."""

    def __init__(self):
        super().__init__()
        self.containsKey, self.getValue, self.updateValue, self.removeKey = self.__contains__, self.__getitem__, self.__setitem__, self.pop
        self.exists, self.get, self.update = lambda: 0 in self, lambda: self[0], lambda v: self.__setitem__(0, v)


def test_rows_that_come_at_once_are_handed_on_in_parts(monkeypatch):
    import types

    import pandas as pd

    monkeypatch.setattr(ordered, "HELD", 100)
    monkeypatch.setattr(ordered, "OUT", 50)
    p = ordered._InOrder(jobs.Cycles, ["ts_us", "id", "door_state"], ["ts_us", "id"], ["cam"], 10 * US)
    p.init(types.SimpleNamespace(getMapState=lambda *_: _Held(), getValueState=lambda *_: _Held(), registerTimer=lambda _: None))
    rows = [(i * US // 2, i, "open" if i % 2 else "closed") for i in range(2_000)]
    random.Random(1).shuffle(rows)
    at = lambda us: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: us // 1000)
    batches = (pd.DataFrame(rows[i : i + 50], columns=p.columns) for i in range(0, 2_000, 50))
    assert sum(map(len, p.handleInputRows(("a",), batches, at(0)))) == 0
    assert len({k[1] for k in p.waiting}) == 20 and max(len(json.loads(v[0])) for v in p.waiting.values()) <= 100
    out = [*p.handleExpiredTimer(("a",), at(400 * US + US // 4), None), *p.handleExpiredTimer(("a",), at(10_000 * US), None)]
    assert max(map(len, out)) < 100 and [i for f in out for i in f["id"]] == list(range(2, 2_000, 2)) and not p.waiting
