"""Readers, sinks and streams."""

import json
import os

import pytest

from hoistway.sources import adapters, readers, schemas, sinks
from hoistway.streaming import jobs, ordered


def test_absent_table_is_empty_with_its_schema(spark, tmp_path):
    df = schemas.read_or_empty(spark, str(tmp_path / "none"), schemas.DOOR)
    assert df.count() == 0 and "seq" in df.columns


def test_optional_columns_become_typed_nulls(spark):
    df = schemas.conform(spark.createDataFrame([(1, "x")], "id long, extra string"), schemas.DOOR)
    assert df.schema["seq"].dataType.simpleString() == "bigint" and df.first().id == 1


def test_ndjson_keeps_bad_lines_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "cam": "ch1"}\nnot json\n{"id": "x"}\n')
    good, bad = readers.ndjson(spark, str(tmp_path / "a.json"), "id long, cam string")
    assert [r.id for r in good.collect()] == [1] and bad.count() == 2


def test_csv_log_sidecar(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# note\n# more\ncam,start_f,travel_s\nch1,3,\nch2,4,2.5\n")
    assert [(r.cam, r.travel_s) for r in readers.comment_csv(spark, str(tmp_path / "t.csv"), "cam string, start_f long, travel_s double").collect()] == [("ch1", None), ("ch2", 2.5)]
    (tmp_path / "w.log").write_text("12:00 ch27 fps=8.5\nnoise\n12:01 ch29 fps=9\n")
    got = readers.log_samples(spark, str(tmp_path / "w.log"), r"(ch\d+) fps=([0-9.]+)", {"cam": "string", "fps": "double"}).collect()
    assert sorted(map(tuple, got)) == [("ch27", 8.5), ("ch29", 9.0)]
    assert readers.sidecar(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_iso_times(spark):
    from pyspark.sql import functions as F

    rows = [("2024-01-01T05:30:00",), ("2024-01-01T00:00:00+00:00",), ("2024-01-01T00:00:00Z",), ("bad",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(readers.iso_to_us(F.col("t"))).collect()]
    assert got == [adapters.EPOCH] * 3 + [None] * 3


def test_materialise_serves_pending_stale_and_ok(spark, tmp_path):
    at, keys = str(tmp_path / "m"), ["cam", "era"]
    wanted = spark.createDataFrame([("a", "1"), ("b", "1")], "cam string, era string")
    assert {r.state for r in sinks.served(spark, at, wanted, keys, 100.0, 10.0).collect()} == {"pending"}
    one = spark.createDataFrame([("a", "1", 5)], "cam string, era string, n long")
    sinks.materialise(one, at, keys, 95.0)
    sinks.materialise(one, at, keys, 95.0)
    assert {(r.cam, r.state) for r in sinks.served(spark, at, wanted, keys, 100.0, 10.0).collect()} == {("a", "ok"), ("b", "pending")}
    assert {(r.cam, r.state) for r in sinks.served(spark, at, wanted, keys, 200.0, 10.0).collect()} == {("a", "stale"), ("b", "pending")}


def test_bundle_names_what_failed(spark, tmp_path):
    def broken():
        raise ValueError("no such era")

    got = {r.name: r for r in sinks.bundle({"good": lambda: spark.range(3), "bad": broken}, str(tmp_path / "b"), spark).collect()}
    assert got["good"].state == "ok" and got["bad"].state == "unavailable" and "no such era" in got["bad"].reason


@pytest.mark.parametrize("files", [1, 4])
def test_stream_cycles_carry_state_between_batches(spark, tmp_path, files):
    states = ["opening", "open", "closing", "closed", None, "closed", "open", "closed"]
    rows = [{"cam": "c", "door_version": "v", "ts_us": i, "id": i, "door_state": s} for i, s in enumerate(states)]
    src = tmp_path / "in"
    src.mkdir()
    per = len(rows) // files
    for f in range(files):
        (src / f"{f}.json").write_text("\n".join(json.dumps(r) for r in rows[f * per : (f + 1) * per]))
    stream = spark.readStream.schema("cam string, door_version string, ts_us long, id long, door_state string").option("maxFilesPerTrigger", 1).json(str(src))
    stream = ordered.Closable(stream)
    got = sorted(r.id for r in ordered.drain(jobs.door_cycles(stream.rows, 1_000_000), [stream]).collect())
    assert got == [3, 7]


def test_audited_episodes_have_their_evidence_and_time_out(spark, tmp_path):
    s = 1_000_000
    rec = lambda cam, t, direction=None, tracks=None, det=None, occ=None, seg=1, drop=0: {"cam": cam, "ts_us": int(t * s), "direction": direction, "track_ids": tracks, "detections": det, "occupancy": occ, "segments": seg, "dropped": drop}
    rows = [rec("a", 0.5, det=9), rec("a", 1, "in", [1]), rec("a", 2, None, [1, 2], 3, 2), rec("a", 3, "out", [2]), rec("a", 4, None, [2], 1, 5, drop=3), rec("b", 4, "in"), rec("b", 5, None, [], 2), rec("c", 5, "out", [7])]
    rows += [rec("d", t, "in", [1]) for t in (1, 8, 15, 22, 29)] + [rec("e", 60, "in", [1])]
    src = tmp_path / "in"
    src.mkdir()
    for f, part in enumerate((rows[:3], rows[3:8], rows[8:13], rows[13:])):
        (src / f"{f}.json").write_text("\n".join(json.dumps(r | {"id": i}) for i, r in enumerate(part)))
        os.utime(src / f"{f}.json", (1_700_000_000 + f, 1_700_000_000 + f))  # files are read in the order of their times
    schema = "cam string, ts_us long, id long, direction string, track_ids array<long>, detections long, occupancy long, segments long, dropped long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    stream = ordered.Closable(stream)
    got = {(r.cam, r.start_us // s): r for r in ordered.drain(jobs.audited_episodes(stream.rows, 8 * s, 25 * s, 30 * s), [stream]).collect()}
    a = got["a", 1]
    assert (a.end_us, a.boarded, a.alighted, a.frames, a.distinct_tracks, a.det_max, a.det_mean, a.occupancy_max, a.degraded, a.refused) == (3 * s, 1, 1, 2, 2, 3, 2.0, 5, True, None)
    assert got["b", 4].refused == "no_tracks" and got["c", 5].refused == "no_frames" and not got["b", 4].degraded
    assert got["d", 1].end_us == 22 * s and set(got) == {("a", 1), ("b", 4), ("c", 5), ("d", 1), ("d", 29), ("e", 60)}
    assert jobs.refused(0, 5, 0, 0) == "no_transits"
