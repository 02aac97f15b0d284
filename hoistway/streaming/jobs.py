"""Structured Streaming jobs: validated ingest, deduplication within a watermark, door cycles, crossing episodes and committed intervals in the order of event time, and
late attribution as a join of two streams.

Each job works on any streaming DataFrame of the given columns; run_available() drains a stream into a Parquet table and reads it back, which is also how
batch and stream are compared."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.sinks import shared_dir
from .ordered import END_US, in_order, plain

US = 1_000_000
STATES = ("closed", "opening", "open", "closing")


def validated(events: DataFrame, cams: list[str]) -> DataFrame:
    """Adds reject: why a door event isn't taken (unknown camera or state), null if it is; a direction other than up or down becomes null."""
    known = F.lit(True) if not cams else F.col("cam").isin(*cams)
    state_ok = F.col("door_state").isNull() | F.col("door_state").isin(*STATES)
    reject = F.when(~known, "unknown_cam").when(~state_ok, "bad_state")
    return events.withColumns({"direction": F.when(F.col("direction").isin("up", "down"), F.col("direction")), "reject": reject})


def deduplicated(transits: DataFrame, late: str = "1 day") -> DataFrame:
    """One row for each (gateway, cam, track, direction, second): what repeats within the watermark is dropped. Needs an event-time column at."""
    return transits.withWatermark("at", late).dropDuplicatesWithinWatermark(["gateway_id", "cam", "track_id", "direction", "ts_bucket"])


class Cycles:
    """State-only cycles of one camera and era: closed right after closing or open; null states count as states."""

    def __init__(self, saved: list | None = None) -> None:
        self.prev = saved[0] if saved else ""

    def step(self, r: dict) -> list[tuple]:
        prev, self.prev = self.prev, r["door_state"]
        return [(r["ts_us"], r["id"])] if self.prev == "closed" and prev in ("closing", "open") else []

    def expire(self, us: int) -> list[tuple]:
        return []

    def due(self) -> int | None:
        return None

    def saved(self) -> list | None:
        return [self.prev]


def door_cycles(events: DataFrame, late_us: int) -> DataFrame:
    """cam, door_version, ts_us, id of each closing, in the order of event time."""
    return in_order(events, ["cam", "door_version"], ["ts_us", "id", "door_state"], Cycles, "ts_us long, id long", late_us)


DEGRADED = 0.2


def refused(transits: int, frames: int, audited: int, tracks: int) -> str | None:
    """Why an episode has no evidence behind it; None if it has."""
    return "no_transits" if not transits else "no_frames" if not frames else "no_tracks" if audited and not tracks else None


class Episodes:
    """Episodes of one camera's crossings with their evidence. A crossing more than gap_us behind the last one, or one that would make the episode longer than
    longest_us, begins a new one. Frames within gap_us of the last crossing belong to its episode. A later record ends it, or the watermark once it is gap_us behind the last crossing."""

    COUNTS = ("boarded", "alighted", "frames", "audited", "det_max", "det_sum", "occupancy_max", "segments", "dropped")

    def __init__(self, gap_us: int, longest_us: int, saved: dict | None = None) -> None:
        self.gap_us, self.longest_us, self.now = gap_us, longest_us, saved and saved | {"tracks": set(saved["tracks"])}

    def _end(self) -> list[tuple]:
        e, self.now = self.now, None
        seen = e["segments"] + e["dropped"]
        why = refused(e["boarded"] + e["alighted"], e["frames"], e["audited"], len(e["tracks"]))
        mean = e["det_sum"] / e["audited"] if e["audited"] else 0.0
        return [(e["start"], e["last"], e["boarded"], e["alighted"], e["frames"], len(e["tracks"]), e["det_max"], mean, e["occupancy_max"], bool(seen and e["dropped"] / seen > DEGRADED), why)]

    def step(self, r: dict) -> list[tuple]:
        t, crossing = r["ts_us"], r["direction"] is not None
        out = self._end() if self.now and (t - self.now["last"] > self.gap_us or crossing and t - self.now["start"] > self.longest_us) else []
        if self.now is None and not crossing:
            return out
        e = self.now = self.now or {"start": t, "last": t, "tracks": set(), **dict.fromkeys(self.COUNTS, 0)}
        if crossing:
            e["last"] = t
            e["boarded" if r["direction"] == "in" else "alighted"] += 1
        else:
            e["frames"] += 1
            if r["detections"] is not None:
                e["audited"], e["det_max"], e["det_sum"] = e["audited"] + 1, max(e["det_max"], int(r["detections"])), e["det_sum"] + int(r["detections"])
            e["occupancy_max"] = max(e["occupancy_max"], int(r["occupancy"] or 0))
        e["tracks"].update(map(int, r["track_ids"] or ()))
        for k in ("segments", "dropped"):
            e[k] += int(r[k] or 0)
        return out

    def expire(self, us: int) -> list[tuple]:
        return self._end() if self.now and us - self.now["last"] > self.gap_us else []

    def due(self) -> int | None:
        return self.now["last"] + self.gap_us + 1 if self.now else None

    def saved(self) -> dict | None:
        return self.now and self.now | {"tracks": sorted(self.now["tracks"])}


def audited_episodes(records: DataFrame, gap_us: int, longest_us: int, late_us: int) -> DataFrame:
    """Episodes from a stream of crossings (direction in or out) and analysed frames (direction null): cam, ts_us, id, direction, track_ids, detections (null where a
    frame is not audited), occupancy, segments and dropped (since the record before). Refused episodes stay, with the reason."""
    out = "start_us long, end_us long, boarded long, alighted long, frames long, distinct_tracks long, det_max long, det_mean double, occupancy_max long, degraded boolean, refused string"
    columns = ["ts_us", "id", "direction", "track_ids", "detections", "occupancy", "segments", "dropped"]
    return in_order(records, ["cam"], columns, lambda saved: Episodes(gap_us, longest_us, saved), out, late_us)


class Commits:
    """Intervals that sliding passes detect again and again, in the order they are seen: each is settled once, when it is seen settle_us or more behind its end and overlaps none that
    was settled before with the same kind of outcome; one that overlaps a committed interval is the same again. Settled intervals are forgotten keep_us behind their end,
    which is how far back a pass may look at most."""

    def __init__(self, settle_us: int, keep_us: int, saved: dict | None = None) -> None:
        self.settle_us, self.keep_us = settle_us, keep_us
        self.taken, self.rejected = (saved["taken"], saved["rejected"]) if saved else ([], [])
        self.next = self._next()

    def _next(self) -> float:
        """The end that is forgotten first."""
        return min((h for held in (self.taken, self.rejected) for _, h in held), default=float("inf"))

    def step(self, r: dict) -> list[tuple]:
        lo, hi, seen = r["lo"], r["hi"], r["ts_us"]
        if self.next < seen - self.keep_us:  # held are those of keep_us, not of all rows that come at once
            self.expire(seen)
        meets = lambda held: any(lo < h and x < hi for x, h in held)
        if seen - hi < self.settle_us or meets(self.taken) or r["reason"] is not None and meets(self.rejected):
            return []
        (self.taken if r["reason"] is None else self.rejected).append((lo, hi))
        self.next = min(self.next, hi)
        return [(r["id"], lo, hi, r["reason"] or "committed")]

    def expire(self, us: int) -> list[tuple]:
        self.taken, self.rejected = ([x for x in held if x[1] >= us - self.keep_us] for held in (self.taken, self.rejected))
        self.next = self._next()
        return []

    def due(self) -> int | None:
        ends = [h for _, h in [*self.taken, *self.rejected]]
        return min(ends) + self.keep_us + 1 if ends else None

    def saved(self) -> dict | None:
        return {"taken": self.taken, "rejected": self.rejected} if self.taken or self.rejected else None


def committed_intervals(seen: DataFrame, settle_us: int, keep_us: int, late_us: int) -> DataFrame:
    """cam, id, lo, hi, outcome (committed, or why not) from a stream of detections: cam, id, lo, hi, reason (null if the measurement is sound), ts_us (when it was seen)."""
    return in_order(seen, ["cam"], ["ts_us", "id", "lo", "hi", "reason"], lambda saved: Commits(settle_us, keep_us, saved), "id long, lo long, hi long, outcome string", late_us)


class _Attribution(StatefulProcessor):
    """Transits and episodes of one camera and time slot wait in state until the watermark has passed all that could meet in it; then each transit gets the least id of the
    episodes around it in one sweep, so that state and work are those of the rows, not of the pairs. A slot is emitted once."""

    def __init__(self, pad_us: int, slot_us: int) -> None:
        self.pad_us, self.slot_us = pad_us, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = False
        for batch in rows:
            new = [[plain(x) for x in r] for r in batch[["id", "lo", "hi", "transit"]].to_dict("split")["data"]]
            new = [r for r in new if (r[1] is None or r[1] < END_US - self.pad_us) and (r[3] or r[0] is not None)]
            if new and plain(key[1]) is None:  # without a time a transit meets nothing
                yield pd.DataFrame({"id": pd.array([r[0] for r in new], dtype="Int64"), "episode_id": pd.array([None] * len(new), dtype="Int64")})
            elif new:
                self.waiting.appendValue((json.dumps(new),))
                known = True
        if known:
            self.handle.registerTimer(((int(key[1]) + 1) * self.slot_us + self.pad_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [r for (rows,) in self.waiting.get() for r in json.loads(rows)]
        transits, episodes = [(r[1], r[0]) for r in held if r[3]], [(r[1], r[2], r[0]) for r in held if not r[3]]
        found = least_around([t for t, _ in transits], episodes)
        self.waiting.clear()
        yield pd.DataFrame({"id": pd.array([i for _, i in transits], dtype="Int64"), "episode_id": pd.array(found, dtype="Int64")})


def least_around(points: list[int], spans: list[tuple[int, int, int]]) -> list[int | None]:
    """For each point the least id of the spans (lo, hi, id; ends included) around it: one sweep with the open spans in a heap by id."""
    found: list[int | None] = [None] * len(points)
    spans, held, at = sorted(spans), [], 0
    for p in sorted(range(len(points)), key=points.__getitem__):
        while at < len(spans) and spans[at][0] <= points[p]:
            heappush(held, (spans[at][2], spans[at][1]))
            at += 1
        while held and held[0][1] < points[p]:
            heappop(held)
        found[p] = held[0][0] if held else None
    return found


def late_attribution(transits: DataFrame, episodes: DataFrame, pad_us: int, longest_us: int, late_us: int, slot_us: int) -> DataFrame:
    """id, episode_id: each transit (cam, id, ts_us) with the least id of the episodes (cam, id, ts_us (their start), end_us) around it, pad_us wide on either side, or with null; it comes once no
    other can come any more. A join of two streams by camera and time slot in keyed state: a slot waits until both watermarks have passed what could still meet in it. Episodes stand in
    every slot that they touch, whatever their length; longest_us, once the bound of the state, is not asked for any more."""
    late = f"{late_us // 1000} milliseconds"
    no_span = F.col("ts_us").alias("lo"), F.col("ts_us").alias("hi")
    t = transits.withColumn("__at", F.timestamp_micros("ts_us")).withWatermark("__at", late).select("cam", F.floor(F.col("ts_us") / slot_us).alias("slot"), "id", *no_span, F.lit(True).alias("transit"), "__at")
    e = episodes.withColumn("__at", F.timestamp_micros("ts_us")).withWatermark("__at", late).where("cam IS NOT NULL")
    e = e.select("cam", "id", (F.col("ts_us") - pad_us).alias("lo"), (F.col("end_us") + pad_us).alias("hi"), F.lit(False).alias("transit"), "__at").where("lo <= hi")
    e = e.withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo") / slot_us), F.floor(F.col("hi") / slot_us))))
    return t.unionByName(e).groupBy("cam", "slot").transformWithStateInPandas(_Attribution(pad_us, slot_us), "id long, episode_id long", "Append", "EventTime")


def attributions(matches: DataFrame) -> DataFrame:
    """One row for each transit, the least id of its episodes: setting it again changes nothing."""
    return matches.groupBy("id").agg(F.min("episode_id").alias("episode_id"))


def send_batches(stream: DataFrame, sender: Callable[[str, list[str], str], None], url: str, what: str, rows: int = 500):
    """Starts a query that hands each micro-batch to sender(url, lines of JSON, what) from its partitions, at most ``rows`` lines a call. The sender is pickled to the
    executors; a batch may be sent again after a failure, so receivers deduplicate."""

    def post(lines: Iterator) -> None:
        held: list[str] = []
        for line in lines:
            held.append(line[0])
            if len(held) >= rows:
                sender(url, held, what)
                held = []
        if held:
            sender(url, held, what)

    return stream.writeStream.trigger(availableNow=True).foreachBatch(lambda df, _: df.select(F.to_json(F.struct(*df.columns))).foreachPartition(post)).start()


def run_available(stream: DataFrame) -> DataFrame:
    """Drains what is available into a Parquet table in the shared folder, and reads it."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")
