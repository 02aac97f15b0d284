"""Door cycles, stops and round trips from ordered door states, as window plans. Order within a camera and era is (ts_us, id)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stored
from . import carry

US = 1_000_000


@dataclass(frozen=True)
class Thresholds:
    """Production values in seconds; scaled() multiplies durations for streams of another pace."""

    flap_s: float = 1.0
    min_dwell_s: float = 1.5
    travel_lo: float = 0.3
    travel_hi: float = 30.0
    no_close_s: float = 60.0
    tolerance_s: float = 10.0

    def scaled(self, by: float) -> Thresholds:
        return Thresholds(self.flap_s * by, self.min_dwell_s * by, self.travel_lo, self.travel_hi, self.no_close_s * by, self.tolerance_s * by)


DRIVER = Thresholds().scaled(300)
ERA = ["cam", "door_version"]


def era_order(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ERA)).orderBy("ts_us", "id")


def state_only_cycles(door: DataFrame) -> DataFrame:
    """Closings: closed right after closing or open. Null states stay in the sequence, so one between them abandons the cycle."""
    rows = carry.last_before(carry.with_day(door), ERA, {"before": F.struct("door_state")})
    return rows.where("door_state = 'closed' AND before.door_state IN ('closing', 'open')").drop("before", carry.DAY)


def gaps_s(cycles: DataFrame) -> DataFrame:
    """cycles with gap, the seconds since the one before in their era (null for the first)."""
    rows = carry.last_before(carry.with_day(cycles), ERA, {"before": F.col("ts_us")})
    return rows.withColumn("gap", (F.col("ts_us") - F.col("before")) / US).drop("before", carry.DAY)


def runs(door: DataFrame) -> DataFrame:
    """Runs of equal states (nulls left out), numbered over the era, with their first time, first close travel and first floor."""
    rows = carry.last_before(carry.with_day(door.where("door_state IS NOT NULL")), ERA, {"before": F.col("door_state")})
    rows = rows.withColumn("new", F.coalesce((F.col("door_state") != F.col("before")).cast("int"), F.lit(1)))
    rows = carry.total_up_to(rows, ERA, {"run": F.col("new")})
    order = F.struct("ts_us", "id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    return rows.groupBy(*ERA, "run", "door_state").agg(F.min("ts_us").alias("t"), first("close_travel_s").alias("ct"), first("floor").alias("fl"))


def flap_aware_cycles(door: DataFrame, th: Thresholds) -> DataFrame:
    """Closings by class: flap, reopened, implausible or clean, with dwell, open travel, start and floor. What one day hands to the next (the last run, the number of
    segments so far, the last opening) is carried, so a task holds a day of an era. Runs and cycles are stored, as each carry and most callers read them more than once."""
    s, p = F.col("door_state"), F.col("before.door_state")
    r = carry.with_day(stored(runs(door), "runs").withColumns({"ts_us": F.col("t"), "id": F.col("run")}))
    r = carry.last_before(r, ERA, {"before": F.struct("door_state", "t", "ct")})
    r = r.withColumns({"rb": F.coalesce((s == "opening") & (p == "closed"), F.lit(False)), "ra": F.coalesce((s == "closed") & (p == "closing"), F.lit(False))})
    # a segment begins with an opening and behind a closing
    r = carry.last_and_total(r, ERA, {"opg": F.when(F.col("rb"), F.col("t"))}, {"begun": F.col("rb").cast("int") + F.col("ra").cast("int")})
    r = r.withColumn("seg", F.col("begun") - F.col("ra").cast("int"))
    since = (F.col("t") - F.col("before.t")) / US
    flap = ((s == "open") & (p == "closing") & (since < th.flap_s)) | ((s == "closing") & (p == "open") & (since < th.min_dwell_s))
    reopen = (s == "open") & (p == "closing") & (since >= th.flap_s)
    last = lambda value, when: F.max_by(value, F.when(when, F.col("run")))
    segs = r.groupBy(*ERA, "seg").agg(
        F.max(F.coalesce(flap, F.lit(False))).alias("flap"),
        F.max(F.coalesce(reopen, F.lit(False))).alias("reopened"),
        last(since, (s == "closing") & (p == "open")).alias("dwell_s"),
        last((F.col("t") - F.col("opg")) / US, (s == "open") & (p == "opening")).alias("open_travel_s"),
        F.min_by("t", F.when(F.col("rb") | (s == "open"), F.col("run"))).alias("start_us"),
        F.min_by("fl", F.when((s == "open") & F.col("fl").isNotNull(), F.col("run"))).alias("floor"),
        F.max(F.when(F.col("ra"), F.col("t"))).alias("close_us"),
        F.max(F.when(F.col("ra"), F.coalesce("before.ct", "ct"))).alias("close_travel_s"),
    )
    kind = F.when(F.col("flap"), "flap").when(F.col("reopened"), "reopened").when(~F.col("close_travel_s").between(th.travel_lo, th.travel_hi), "implausible").otherwise("clean")
    found = segs.where("close_us IS NOT NULL AND close_travel_s > 0").select(*ERA, F.col("start_us").alias("ts_us"), "close_us", "floor", "dwell_s", "open_travel_s", "close_travel_s", kind.alias("class"))
    return stored(found, "cycles")


def carried_floors(door: DataFrame) -> DataFrame:
    """door with close and open (whether the row closes a cycle or opens) and the floor each carries: a closing's is the last one read since the closing before it (carried, null
    where none was), an opening's the last one read (read)."""
    at, carries = F.struct("ts_us", "id"), carry.last_before
    rows = carries(carry.with_day(door), ERA, {"before": F.struct("door_state")})
    prev = F.coalesce("before.door_state", F.lit(""))
    is_close = F.coalesce((F.col("door_state") == "closed") & prev.isin("closing", "open"), F.lit(False))
    is_open = F.coalesce((F.col("door_state") == "open") & (prev != "open"), F.lit(False))
    rows = carries(rows.withColumns({"close": is_close.cast("int"), "open": is_open}), ERA, {"since": F.when(is_close, at)})
    rows = carries(rows, ERA, {"last": F.when(F.col("floor").isNotNull(), F.struct(at.alias("at"), "floor"))}, own=True)
    fresh = F.col("since").isNull() | (F.col("last.at") > F.col("since"))
    return rows.withColumns({"read": F.col("last.floor"), "carried": F.when(fresh, F.col("last.floor"))})


def round_trips(door: DataFrame, home: str) -> DataFrame:
    """From each closing at home to the next opening at home strictly later, with the stops between."""
    at, rows = F.struct("ts_us", "id"), carried_floors(door)
    rows = carry.total_up_to(rows, ERA, {"closes": F.col("close")}, ties=True)
    returns = F.when(F.col("open") & (F.col("read") == home), F.struct("ts_us", "closes"))
    # openings of the closing's own time don't count, so the first one after is looked up from the last row of each time
    rows = carry.first_after(rows, ERA, {"back": returns})
    last_of_time = F.max_by("back", at).over(Window.partitionBy(*ERA, carry.DAY, "ts_us"))
    rows = rows.withColumn("back", last_of_time)
    found = rows.where((F.col("close") == 1) & (F.col("carried") == home) & F.col("back").isNotNull())
    return found.select(*ERA, "ts_us", F.col("back.ts_us").alias("back_us"), ((F.col("back.ts_us") - F.col("ts_us")) / US).alias("rtt_s"), (F.col("back.closes") - F.col("closes")).alias("n_stops"))


def stops(door: DataFrame, th: Thresholds) -> DataFrame:
    """Entries into opening or open from another known state; closed at the first later closing in time, else after the limit; floor from the row
    itself, the first confident read until the close, or the last before, within the tolerance."""
    limit, tol = int(th.no_close_s * US), int(th.tolerance_s * US)
    confident = F.col("floor").isNotNull() & F.coalesce(F.col("reason").isin("ok", "single_panel"), F.lit(False))
    read = F.when(confident, F.struct("ts_us", "floor"))
    rows = carry.last_before(carry.with_day(door), ["cam"], {"known": F.col("door_state"), "last_read": read})
    rows = carry.first_after(rows, ["cam"], {"shut": F.when(F.col("door_state") == "closed", F.col("ts_us")), "next_read": read}).withColumn("sure", confident)
    rows = rows.where("door_state IN ('opening', 'open') AND NOT coalesce(known, '') IN ('opening', 'open')")
    close = F.when(F.col("shut") - F.col("ts_us") <= limit, F.col("shut")).otherwise(F.col("ts_us") + limit)
    rows = rows.withColumn("close_us", close)
    forward = F.when((F.col("next_read.ts_us") <= F.col("close_us")) & (F.col("next_read.ts_us") - F.col("ts_us") <= limit), F.col("next_read"))
    source = F.when(F.col("sure"), F.struct("ts_us", "floor")).otherwise(F.coalesce(forward, F.col("last_read")))
    rows = rows.withColumn("src", source)
    return rows.select("cam", "id", "ts_us", "close_us", F.when(F.abs(F.col("src.ts_us") - F.col("ts_us")) <= tol, F.col("src.floor")).alias("floor"))


def labelled_local_hour(ts: Column) -> Column:
    """Hour of the day on the building's fixed clock."""
    return (F.floor((ts + 19_800 * US) / (3600 * US)) % 24).cast("long")
