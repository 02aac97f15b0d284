"""Signal machines with state per camera: door states from a raw openness signal, and transits from tracks crossing between zones."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ordered import in_order

US = 1_000_000


@dataclass(frozen=True)
class Signal:
    """Production values; times in microseconds. The signal is normalised by the p10..p90 band of its last samples."""

    window: int = 600
    least: int = 40
    open_at: float = 0.15
    closed_at: float = 0.85
    open_hold: int = 400_000
    closed_hold: int = 320_000
    refractory: int = 6 * US
    longest_descent: int = 12 * US


class Band:
    """The last values of a signal, also in order, so that a percentile takes no sort for each sample."""

    def __init__(self, values: list[float], size: int) -> None:
        self.values, self.ordered, self.size = list(values), sorted(values), size

    def add(self, value: float) -> None:
        self.values.append(value)
        insort(self.ordered, value)
        if len(self.values) > self.size:
            del self.ordered[bisect_left(self.ordered, self.values.pop(0))]

    def ranked(self, q: float) -> float:
        return self.ordered[int(q * (len(self.ordered) - 1))]

    def linear(self, q: float) -> float:
        at = q * (len(self.ordered) - 1)
        lo = int(at)
        hi = min(lo + 1, len(self.ordered) - 1)
        return self.ordered[lo] + (at - lo) * (self.ordered[hi] - self.ordered[lo])


class DoorMachine:
    """States from one camera's samples. A level must be held before it becomes the state; between levels the door is moving; a movement that takes too long is
    abandoned and the state is unknown (None) until a level is held again; after a closing a new opening waits for the refractory time."""

    def __init__(self, p: Signal, saved: tuple | None = None) -> None:
        self.p = p
        values, self.state, self.level, self.since, self.left, self.closed = saved or ([], None, None, 0, 0, -(1 << 62))
        self.band = Band(values, p.window)

    def saved(self) -> tuple:
        return (self.band.values, self.state, self.level, self.since, self.left, self.closed)

    def step(self, t: int, value: float) -> list[tuple[int, str | None]]:
        """New states from one sample, with the time from which they hold."""
        p = self.p
        self.band.add(value)
        if len(self.band.values) < p.least:
            return []
        lo, hi = self.band.ranked(0.1), self.band.ranked(0.9)
        if hi <= lo:
            return []
        x = min(1.0, max(0.0, (value - lo) / (hi - lo)))
        level = "open" if x <= p.open_at else "closed" if x >= p.closed_at else None
        if level != self.level:
            if self.level is not None and level is None:
                self.left = t
            self.level, self.since = level, t
        if level is None:
            if self.state is not None and self.left and t - self.left > p.longest_descent:
                self.state = None
                return [(t, None)]
            return []
        if level == self.state or t - self.since < (p.open_hold if level == "open" else p.closed_hold):
            return []
        if level == "open" and t - self.closed < p.refractory:
            return []
        self.state, self.left = level, 0
        if level == "closed":
            self.closed = t
        return [(self.since, level)]


class _Sampled:
    """A machine of this module over the rows of a stream."""

    def __init__(self, machine) -> None:
        self.machine = machine

    def step(self, r: dict) -> list[tuple]:
        if r["value"] is None:
            return []
        found = self.machine.step(int(r["ts_us"]), float(r["value"]))
        return found if isinstance(found, list) else [found] if found else []

    def expire(self, us: int) -> list[tuple]:
        return []

    def due(self) -> int | None:
        return None

    def saved(self) -> list:
        return list(self.machine.saved())


def door_signal(samples: DataFrame, late_us: int, p: Signal | None = None) -> DataFrame:
    """cam, ts_us, door_state: state changes from a stream of samples (cam, ts_us, id, value), in the order of event time; null and NaN values are no samples."""
    p = p or Signal()
    return in_order(samples, ["cam"], ["ts_us", "id", "value"], lambda saved: _Sampled(DoorMachine(p, saved)), "ts_us long, door_state string", late_us)


@dataclass(frozen=True)
class Edge:
    """Production values of the edge machine; times in microseconds. Openness is the signal within the p10..p90 band of its last samples."""

    window: int = 600
    least: int = 20
    least_span: float = 6.0
    opening_at: float = 0.5
    open_at: float = 0.9
    closing_at: float = 0.75
    closed_at: float = 0.1
    debounce: int = 400_000
    longest_gap: int = 15 * US
    shortest_close: int = 300_000
    longest_close: int = 30 * US


class EdgeMachine:
    """Cycles from one camera's edge samples: opening from 0.5, open from 0.9, closing once a descent has reached 0.75 and lasted the debounce (it counts from where
    it left 0.9), closed below 0.1. A gap within a cycle abandons it, and the state is read anew from the sample behind the gap."""

    def __init__(self, p: Edge, saved: tuple | None = None) -> None:
        self.p = p
        values, self.state, self.start, self.full, self.close, self.below, self.last, self.abandoned = saved or ([], "closed", None, None, None, None, None, 0)
        self.band = Band(values, p.window)

    def saved(self) -> tuple:
        return (self.band.values, self.state, self.start, self.full, self.close, self.below, self.last, self.abandoned)

    def _end(self, t: int) -> tuple | None:
        """open start, open full, close start, close full, close travel (None if withheld), quality; None if the cycle's start was not seen."""
        start, full, close, self.state = self.start, self.full, self.close, "closed"
        self.start = self.full = self.close = self.below = None
        if start is None or full is None or close is None:
            return None
        plausible = self.p.shortest_close <= t - close <= self.p.longest_close
        return (start, full, close, t, t - close if plausible else None, "ok" if plausible else "withheld")

    def step(self, t: int, value: float) -> tuple | None:
        """The cycle that ends with this sample, if one does."""
        p = self.p
        self.band.add(value)
        if len(self.band.values) < p.least:
            return None
        lo, hi = self.band.linear(0.1), self.band.linear(0.9)
        if hi - lo < p.least_span:
            return None
        x = min(1.0, max(0.0, (value - lo) / (hi - lo)))
        gap, self.last = self.last is not None and t - self.last > p.longest_gap, t
        if gap and self.state != "closed":
            self.start = self.full = self.close = self.below = None
            self.state = "open" if x >= p.open_at else "closed" if x < p.closed_at else "opening"
            self.abandoned += 1
            return None
        if self.state == "closed":
            if x >= p.opening_at:
                self.state, self.start = "opening", t
        elif self.state == "opening":
            if x >= p.open_at:
                self.state, self.full = "open", t
            elif x < p.closed_at:
                self.state, self.start = "closed", None
        elif x >= p.open_at:  # open, or open again while closing
            self.state, self.close, self.below = "open", None, None
        elif self.state == "closing":
            if x < p.closed_at:
                return self._end(t)
        else:
            self.below = t if self.below is None else self.below
            if x < p.closed_at:
                self.close = self.below
                return self._end(t)
            if x < p.closing_at and t - self.below >= p.debounce:
                self.state, self.close, self.below = "closing", self.below, None
        return None


def edge_cycles(samples: DataFrame, late_us: int, p: Edge | None = None) -> DataFrame:
    """cam, the four times, close_travel_us and quality of each cycle from a stream of samples (cam, ts_us, id, value), in the order of event time; null and NaN values are no samples."""
    p = p or Edge()
    out = "open_start_us long, open_full_us long, close_start_us long, close_full_us long, close_travel_us long, quality string"
    return in_order(samples, ["cam"], ["ts_us", "id", "value"], lambda saved: _Sampled(EdgeMachine(p, saved)), out, late_us)


#: How long a track's state is kept without samples (longer than a track may be unseen), and how late a sample may come.
IDLE_MS, LATE = 60_000, "10 minutes"


class TrackCounter:
    """One track: armed after two samples in a zone, counted after two in the other one at least 0.35 away; a track unseen for six seconds starts anew."""

    FRAMES, DISTANCE, STALE = 2, 0.35, 6 * US

    def __init__(self, saved: tuple | None = None) -> None:
        self.zone, self.frames, self.origin, self.at, self.last = saved or (None, 0, None, 0.0, 0)

    def saved(self) -> tuple:
        return (self.zone, self.frames, self.origin, self.at, self.last)

    def step(self, t: int, zone: str | None, y: float) -> str | None:
        if t - self.last > self.STALE:
            self.zone, self.frames, self.origin = None, 0, None
        self.last = t
        self.frames = self.frames + 1 if zone is not None and zone == self.zone else 1
        self.zone = zone
        if zone is None or self.frames < self.FRAMES:
            return None
        if self.origin is None or self.origin == zone:
            self.origin, self.at = zone, y
            return None
        if abs(y - self.at) < self.DISTANCE:
            return "rejected"
        self.origin, self.at = zone, y
        return "in" if zone == "inside" else "out"


def track_transits(frames: DataFrame) -> DataFrame:
    """cam, track_id, ts_us, outcome (in, out, rejected) from a stream of track samples (cam, track_id, ts_us, zone, y). A track unseen when the watermark is
    IDLE_MS behind its last sample is forgotten: it would start anew in any case. Samples later than LATE are dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counter, rows = TrackCounter(state.get if state.exists else None), []
        for r in pd.concat(list(batches)).sort_values("ts_us", kind="stable").itertuples():
            if outcome := counter.step(int(r.ts_us), r.zone if isinstance(r.zone, str) else None, float(r.y)):
                rows.append((key[0], int(key[1]), int(r.ts_us), outcome))
        state.update(counter.saved())
        state.setTimeoutTimestamp(max(counter.last // 1000 + IDLE_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["cam", "track_id", "ts_us", "outcome"])

    timed = frames.withColumn("__at", F.timestamp_micros("ts_us")).withWatermark("__at", LATE)
    return timed.groupBy("cam", "track_id").applyInPandasWithState(run, "cam string, track_id long, ts_us long, outcome string", "zone string, frames long, origin string, at double, last long", "append", GroupStateTimeout.EventTimeTimeout)
