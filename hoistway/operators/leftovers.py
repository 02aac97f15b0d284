"""Order-dependent operators that no window expresses: greedy matching, debouncing and quantum detection, as applyInPandas per key.

Keys are (camera, era), or (camera, day) where the rule allows a cut between days, so groups stay bounded."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import around, carry, joins

US = 1_000_000
DAY_US = 86_400 * US


def nearest_free(emitted: np.ndarray, truth: np.ndarray, tolerance_us: int) -> list[int]:
    """For each of the sorted emissions the position of the nearest truth (sorted) that none before it took, the earlier of two equally near; -1 where none lies within the
    tolerance. Taken truths are skipped by pointers that halve their way, so the pass is all but linear however many truths lie within the tolerance."""
    n = len(truth)
    down, up = list(range(n + 1)), list(range(n + 1))  # by position + 1 and by position: the next free one at or before, at or after; 0 and n stand for none

    def free(pointer: list[int], i: int) -> int:
        while pointer[i] != i:
            pointer[i] = pointer[pointer[i]]
            i = pointer[i]
        return i

    found, times = [], truth.tolist()
    for x, at in zip(emitted.tolist(), np.searchsorted(truth, emitted, "right").tolist()):
        before, after = free(down, at) - 1, free(up, at)
        best = before if before >= 0 and (after == n or x - times[before] <= times[after] - x) else after
        if best == n or abs(times[best] - x) > tolerance_us:
            found.append(-1)
            continue
        down[best + 1], up[best] = best, best + 1
        found.append(best)
    return found


def greedy_match(emitted: DataFrame, truth: DataFrame, tolerance_us: int) -> DataFrame:
    """cam, emitted_us, truth_us, kind: emissions in time order take the nearest unused truth within the tolerance (the earlier of two equally near);
    kind is matched, unmatched (emission alone) or missed (truth alone). Work is cut wherever no emission on one side is within the tolerance of a truth on the other, so a
    camera that emits without end is cut at each stretch without truths, and one with truths without end at each stretch without emissions."""
    both = emitted.select("cam", "ts_us", F.lit(0).alias("kind")).unionByName(truth.select("cam", "ts_us", F.lit(1).alias("kind")))
    e, t = (F.when(F.col("kind") == k, F.col("ts_us")) for k in (0, 1))
    both = carry.last_before(carry.with_day(both.withColumn("id", F.col("kind"))), ["cam"], {"e_before": e, "t_before": t})
    both = carry.first_after(both, ["cam"], {"e_after": e, "t_after": t})
    spans = lambda lo, hi: F.coalesce(hi - F.col(lo) <= tolerance_us, F.lit(False))
    joined = spans("t_before", F.coalesce(e, "e_after")) | spans("e_before", F.coalesce(t, "t_after"))
    both = carry.total_up_to(both, ["cam"], {"island": (~joined).cast("int")}, ties=True).select("cam", "ts_us", "kind", "island")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for cam, part in pdf.groupby("cam", sort=False):  # islands of one camera don't reach each other, so those of a task are matched in one pass
            e, t = (np.sort(part.loc[part.kind == k, "ts_us"].to_numpy()) for k in (0, 1))
            found = np.array(nearest_free(e, t, tolerance_us), dtype=np.int64)
            hit, left = found >= 0, np.ones(len(t), bool)
            left[found[hit]] = False
            took = pd.array(np.where(hit, t[found] if len(t) else 0, 0), dtype="Int64")
            took[~hit] = pd.NA
            parts.append(pd.DataFrame({"cam": cam, "emitted_us": pd.array(e, dtype="Int64"), "truth_us": took, "kind": np.where(hit, "matched", "unmatched")}))
            parts.append(pd.DataFrame({"cam": cam, "emitted_us": pd.array([pd.NA] * int(left.sum()), dtype="Int64"), "truth_us": pd.array(t[left], dtype="Int64"), "kind": "missed"}))
        return pd.concat(parts)

    return both.withColumn("task", F.pmod(F.xxhash64("cam", "island"), F.lit(tasks_for(both)))).groupBy("task").applyInPandas(match, "cam string, emitted_us long, truth_us long, kind string")


def graded(emitted: DataFrame, truth: DataFrame, still: DataFrame, tolerance_us: int, first: bool, slot_us: int) -> DataFrame:
    """greedy_match with the windows in which the door is known to stand still (still: cam, lo_us, hi_us, both ends within): an emission in one is a phantom. ``first``: windows
    convict before truths are matched, so no emission within one may take a truth (a score). Else they convict what was left unmatched (a grade)."""

    def within(rows: DataFrame, at: str) -> DataFrame:
        times = rows.select("cam", F.col(at).alias("ts_us")).distinct()
        inside = joins.point_in_interval(times, still.select("cam", "lo_us", "hi_us"), "lo_us", "hi_us", slot_us).select(F.col("p.cam").alias("cam"), F.col("p.ts_us").alias(at)).distinct()
        return inside.withColumn("phantom", F.lit(True))

    if not first:
        rows = greedy_match(emitted, truth, tolerance_us)
        alone = rows.join(within(rows.where("kind = 'unmatched'"), "emitted_us"), ["cam", "emitted_us"], "left")
        kind = F.when((F.col("kind") == "unmatched") & F.col("phantom"), "phantom").otherwise(F.col("kind"))
        return alone.select("cam", "emitted_us", "truth_us", kind.alias("kind"))
    told = emitted.select("cam", F.col("ts_us").alias("emitted_us")).join(within(emitted, "ts_us").withColumnRenamed("ts_us", "emitted_us"), ["cam", "emitted_us"], "left")
    rows = greedy_match(told.where("phantom IS NULL").select("cam", F.col("emitted_us").alias("ts_us")), truth, tolerance_us)
    return rows.unionByName(told.where("phantom").select("cam", "emitted_us", F.lit(None).cast("long").alias("truth_us"), F.lit("phantom").alias("kind")))


def tasks_for(rows: DataFrame, each: int = 50_000) -> int:
    """How many tasks hold about ``each`` rows."""
    return max(1, -(-rows.count() // each))


def throttled(rows: DataFrame, least_us: int) -> DataFrame:
    """The rows (cam, id, ts_us) kept if each needs least_us (above 0) since the last one kept; of one time the least id. A day's effect is a function: where the first one kept stands sets
    where the last one does, and only rows within least_us of the day's start can be first. Those functions are made day by day, composed in order over one row for each camera and day, and each day is
    then walked from the time handed to it: a camera that is never silent is as many tasks as days."""
    rows = carry.with_day(rows.select("cam", "id", "ts_us"))

    def effect(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.unique(pdf["ts_us"].to_numpy())
        after = np.searchsorted(t, t + least_us, "left").tolist()
        last = t.tolist()
        for i in range(len(t) - 1, -1, -1):
            if after[i] < len(t):
                last[i] = last[after[i]]
        open_to = int(np.searchsorted(t, int(key[1]) * DAY_US + least_us, "left")) + 1  # and the first row behind it
        return pd.DataFrame({"cam": [key[0]], "day": [key[1]], "firsts": [t[:open_to].tolist()], "lasts": [last[:open_to]]})

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        handed, kept = [], None
        for r in pdf.sort_values("day").itertuples():
            handed.append((r.cam, r.day, kept))
            at = 0 if kept is None else int(np.searchsorted(np.asarray(r.firsts), kept + least_us, "left"))
            kept = int(r.lasts[at]) if at < len(r.firsts) else kept
        out = pd.DataFrame(handed, columns=["cam", carry.DAY, "kept_us"])
        return out.astype({"kept_us": "Int64"})

    def walk(key: tuple, day: pd.DataFrame, handed: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values(["ts_us", "id"], kind="stable").drop_duplicates("ts_us")
        kept, chosen = handed["kept_us"].iloc[0], []
        at = 0 if pd.isna(kept) else int(np.searchsorted(day["ts_us"].to_numpy(), int(kept) + least_us, "left"))
        after = np.searchsorted(day["ts_us"].to_numpy(), day["ts_us"].to_numpy() + least_us, "left").tolist()
        while at < len(day):
            chosen.append(at)
            at = after[at]
        return day.iloc[chosen][["cam", "id", "ts_us"]]

    effects = rows.groupBy("cam", carry.DAY).applyInPandas(effect, "cam string, day long, firsts array<long>, lasts array<long>")
    handed = effects.groupBy("cam").applyInPandas(compose, f"cam string, {carry.DAY} long, kept_us long")
    return rows.groupBy("cam", carry.DAY).cogroup(handed.groupBy("cam", carry.DAY)).applyInPandas(walk, "cam string, id long, ts_us long")


def debounced_cycles(door: DataFrame, hold_us: int) -> DataFrame:
    """cam, door_version, runs, cycles: runs of states that end within hold_us of their start are dropped, greedily, equal neighbours join, and closings count.
    Behind a silence of hold_us nothing before it is dropped any more, so work is cut there: a part needs only the state that it starts from."""
    keys = ["cam", "door_version"]
    rows = carry.with_day(door.where("door_state IS NOT NULL").select(*keys, "ts_us", "id", "door_state"))
    rows = carry.last_before(rows, keys, {"before": F.struct("ts_us", "door_state")})
    rows = carry.total_up_to(rows, keys, {"part": (F.col("before").isNull() | (F.col("ts_us") - F.col("before.ts_us") >= hold_us)).cast("int")})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, part in pdf.sort_values(["ts_us", "id"], kind="stable").groupby([*keys, "part"], sort=False):
            entry = part["entry"].iloc[0]
            states, starts = ([entry], [-(1 << 62)]) if isinstance(entry, str) else ([], [])
            known = len(states)
            for t, s in zip(part["ts_us"].tolist(), part["door_state"].tolist()):
                if states and states[-1] == s:
                    continue
                if states and t - starts[-1] < hold_us:
                    states.pop(), starts.pop()
                    if states and states[-1] == s:
                        continue
                states.append(s), starts.append(t)
            out.append((*key[:2], len(states) - known, sum(b == "closed" and a in ("closing", "open") for a, b in zip(states, states[1:]))))
        return pd.DataFrame(out, columns=["cam", "door_version", "runs", "cycles"])

    task = F.pmod(F.xxhash64(*keys, "part"), F.lit(tasks_for(rows)))
    parts = rows.select(*keys, "part", "ts_us", "id", "door_state", F.col("before.door_state").alias("entry"), task.alias("task")).groupBy("task").applyInPandas(walk, "cam string, door_version string, runs long, cycles long")
    return parts.groupBy(*keys).agg(F.sum("runs").alias("runs"), F.sum("cycles").alias("cycles"))


def committed(seen: DataFrame, settle_us: int) -> DataFrame:
    """cam, id, lo, hi: of intervals detected again and again (cam, id, lo, hi, seen_us), in the order they were seen, those that have settled (seen settle_us or more behind
    their end) and don't overlap one committed before. Work is cut where no interval reaches, which bounds it; groups go to tasks by a hash."""
    rows = carry.with_day(seen.withColumns({"ts_us": F.col("lo"), "order": F.struct("hi", "seen_us", "id")}).withColumnRenamed("id", "row").withColumn("id", F.col("order")))
    reach = rows.groupBy("cam", carry.DAY).agg(F.max("hi").alias("__reach"))
    reach = reach.withColumn("__reach", F.max("__reach").over(Window.partitionBy("cam").orderBy(carry.DAY).rowsBetween(Window.unboundedPreceding, -1)))
    within = F.max("hi").over(Window.partitionBy("cam", carry.DAY).orderBy("ts_us", "id").rowsBetween(Window.unboundedPreceding, -1))
    rows = carry.joined(rows.withColumn("__within", within), reach, ["cam"]).withColumn("upto", F.greatest("__within", "__reach"))
    rows = carry.total_up_to(rows, ["cam"], {"island": (F.col("upto").isNull() | (F.col("lo") >= F.col("upto"))).cast("int")})

    def commit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (cam, _), part in pdf.sort_values(["seen_us", "lo", "hi", "row"], kind="stable").groupby(["cam", "island"], sort=False):
            taken: list[tuple[int, int]] = []
            for r in part.itertuples():
                if r.seen_us - r.hi >= settle_us and not any(r.lo < hi and lo < r.hi for lo, hi in taken):
                    taken.append((r.lo, r.hi))
                    out.append((cam, r.row, r.lo, r.hi))
        return pd.DataFrame(out, columns=["cam", "id", "lo", "hi"])

    task = F.pmod(F.xxhash64("cam", "island"), F.lit(tasks_for(rows)))
    return rows.select("cam", "island", "row", "lo", "hi", "seen_us", task.alias("task")).groupBy("task").applyInPandas(commit, "cam string, id long, lo long, hi long")


def on_grid(values: np.ndarray, q: float) -> np.ndarray:
    """Which values lie within max(3 ms, 2 %) of a positive multiple of q."""
    steps = np.round(values / q)
    return (steps >= 1) & (np.abs(values - steps * q) <= max(0.003, 0.02 * q))


def quantum_of(values: np.ndarray, counts: np.ndarray) -> float | None:
    """The sampling step in a pool of positive values at millisecond steps: candidates are the twelve most frequent values and the differences of neighbours among them, 5 ms at
    least; those within max(3 ms, 2 %) of a cluster's first are one, for which its most frequent member stands; each is refined three times by
    least squares, and the largest with at least 55 % of the pool on its grid is the step. Null below 30 values. Of equal counts the smaller value comes first."""
    if counts.sum() < 30:
        return None
    often = dict(zip(values.tolist(), counts.tolist()))
    top = np.sort(values[np.lexsort((values, -counts))[:12]])
    raw = sorted({x for x in [*top.tolist(), *np.round(np.diff(top), 3).tolist()] if x >= 0.005})
    clusters: list[list[float]] = []
    for x in raw:
        if clusters and x - clusters[-1][0] <= max(0.003, 0.02 * x):
            clusters[-1].append(x)
        else:
            clusters.append([x])
    best = None
    for q in [max(c, key=lambda x: often.get(x, 0)) for c in clusters]:
        for _ in range(3):
            on, steps = on_grid(values, q), np.round(values / q)
            if not on.any():
                break
            q = float((counts[on] * values[on] * steps[on]).sum() / (counts[on] * steps[on] ** 2).sum())
        if counts[on_grid(values, q)].sum() / counts.sum() >= 0.55 and (best is None or q > best):
            best = q
    return best


def sampling_quantum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, quantum_s. Positive values are counted at millisecond steps first, so a group is at most its distinct values."""
    counted = df.where(F.col(value) > 0).groupBy(*keys, F.round(F.col(value), 3).alias("v")).agg(F.count("*").alias("c"))

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [int(pdf["c"].sum())], "quantum_s": [quantum_of(pdf["v"].to_numpy(), pdf["c"].to_numpy())]})

    return counted.groupBy(*keys).applyInPandas(detect, ", ".join(f"{k} string" for k in keys) + ", n long, quantum_s double")


def last_descent(values: list[float], near_open: float, close_at: float) -> tuple[int, int] | None:
    """Positions of the last full descent: a sample at or above near_open, then the first at or below close_at; a later top restarts."""
    top, found = None, None
    for i, v in enumerate(values):
        if v >= near_open:
            top = i
        elif v <= close_at and top is not None:
            top, found = None, (top, i)
    return found


def ramp(times: list[int], values: list[float], sustain: int = 2) -> float | None:
    """Seconds between the sustained crossings of 90 % and 10 % of the window's own p95..p5 levels; null where either isn't held for ``sustain`` samples."""
    ordered = sorted(values)
    if len(ordered) < 4:
        return None
    lo, hi = ordered[int(0.05 * (len(ordered) - 1))], ordered[int(0.95 * (len(ordered) - 1))]
    if hi <= lo:
        return None
    share = [(v - lo) / (hi - lo) for v in values]
    first = lambda start, ok: next((i for i in range(start, len(share) - sustain + 1) if all(ok(s) for s in share[i : i + sustain])), None)
    begin = first(0, lambda s: s <= 0.9)
    end = None if begin is None else first(begin, lambda s: s <= 0.1)
    return None if end is None else (times[end] - times[begin]) / US


def descents(samples: DataFrame, near_open: float, close_at: float) -> DataFrame:
    """window_id, n, descent_s, ramp_s for each window of samples (window_id, ts_us, value), by walking it; a window is one event, so groups are small. Of one time the smaller value comes
    first. Where windows overlap, descents_around() takes the same figures without a copy of the samples for each."""

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, part in pdf.sort_values(["window_id", "ts_us", "value"], kind="stable").groupby("window_id", sort=False):
            times, values = part["ts_us"].tolist(), part["value"].tolist()
            found = last_descent(values, near_open, close_at)
            rows.append((key, len(times), (times[found[1]] - times[found[0]]) / US if found else None, ramp(times, values)))
        return pd.DataFrame(rows, columns=["window_id", "n", "descent_s", "ramp_s"])

    return samples.withColumn("task", F.pmod(F.xxhash64("window_id"), F.lit(tasks_for(samples)))).groupBy("task").applyInPandas(measure, "window_id long, n long, descent_s double, ramp_s double")


def descents_around(points: DataFrame, windows: DataFrame, near_open: float, close_at: float, block_us: int, sustain: int = 2) -> DataFrame:
    """descents() of the points (cam, ts_us, value) in windows (cam, window_id, lo, hi, both ends within) that may overlap as they like. A descent ends at the first low behind a top, whatever
    came before; levels are order statistics, and where they are first held is a search for the next minimum."""

    def measure(p: pd.DataFrame, w: pd.DataFrame, i0: np.ndarray, i1: np.ndarray) -> pd.DataFrame:
        t, v, n = p["ts_us"].to_numpy(), p["value"].to_numpy(dtype=float), i1 - i0
        top = v >= near_open
        low = ~top & (v <= close_at)
        marks = np.flatnonzero(top | low)
        falls = low[marks[1:]] & top[marks[:-1]]
        tops, lows = np.concatenate([[-1], marks[:-1][falls]]), np.concatenate([[-1], marks[1:][falls]])
        last = np.searchsorted(lows, i1) - 1
        descent = np.where((last > 0) & (tops[last] >= i0), (t[lows[last]] - t[tops[last]]) / US, np.nan)
        ranks = around.Ranks(v)
        lo, hi = (ranks.distinct[ranks.kth(i0, i1, (q * (n - 1)).astype(np.int64))] for q in (0.05, 0.95))

        def upto(share: float) -> np.ndarray:
            """The largest rank whose share of the window's span is at most ``share``, below all: -1."""
            a, b = np.full(len(n), -1), np.full(len(n), len(ranks.distinct) - 1)
            while (a < b).any():
                mid = (a + b + 1) // 2
                fits = (ranks.distinct[mid] - lo) / (hi - lo) <= share
                a, b = np.where(fits, np.maximum(a, mid), a), np.where(fits, b, np.minimum(b, mid - 1))
            return a

        held = around.Least(around.spread(ranks.of, sustain, np.maximum))
        ends = np.maximum(i1 - sustain + 1, i0)
        with np.errstate(divide="ignore", invalid="ignore"):
            begin = held.first(i0, ends, upto(0.9))
            end = held.first(np.where(begin < 0, ends, begin), ends, upto(0.1))
        ramps = np.where((n >= 4) & ~(hi <= lo) & (end >= 0), (t[end] - t[begin]) / US, np.nan)
        return pd.DataFrame({"window_id": w["window_id"].to_numpy(), "n": n, "descent_s": descent, "ramp_s": ramps})

    return around.by_blocks(points, windows, ["value"], block_us, measure, "window_id long, n long, descent_s double, ramp_s double")
