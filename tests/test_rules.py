"""Running values across days, order-dependent operators and rules on small random data, against plain walks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hoistway.operators import carry, cycles, joins, leftovers

US = 1_000_000
DAY = 86_400 * US


def stream(seed, n, cams=3, states=("opening", "open", "closing", "closed", None), gaps=(0, 1, 60, 4_000, 50_000, 200_000)):
    """Rows (id, cam, ts_us, floor, reason, door_state, door_version) over several days, with ties and nulls."""
    rng, at, rows = random.Random(seed), [0] * cams, []
    for i in range(n):
        c = rng.randrange(cams)
        at[c] += rng.choice(gaps) * US
        rows.append((i, f"ch{c}", at[c], rng.choice(["G", "1", "2", None]), rng.choice(["ok", "single_panel", "no_read", None]), rng.choice(states), "v1" if at[c] < 3 * DAY else "v2"))
    rng.shuffle(rows)
    return rows


SCHEMA = "id long, cam string, ts_us long, floor string, reason string, door_state string, door_version string"


def by_cam(rows, key=lambda r: r[1]):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(key(r), []).append(r)
    return out


def test_values_carried_over_days(spark):
    rows = stream(1, 400)
    df = carry.with_day(spark.createDataFrame(rows, SCHEMA))
    df = carry.last_before(df, ["cam"], {"prev": F.col("floor"), "row": F.struct("door_state")})
    df = carry.last_before(df, ["cam"], {"own": F.col("floor")}, own=True)
    df = carry.first_after(df, ["cam"], {"next": F.col("floor")})
    df = carry.total_up_to(df, ["cam"], {"n": F.lit(1)})
    df = carry.total_up_to(df, ["cam"], {"ties": F.lit(1)}, ties=True)
    got = {r.id: (r.prev, r.row.door_state if r.row else "none", r.own, r.next, r.n, r.ties) for r in df.collect()}
    for part in by_cam(rows).values():
        for i, r in enumerate(part):
            last = lambda xs: next((x[3] for x in reversed(xs) if x[3] is not None), None)
            after = next((x[3] for x in part[i + 1 :] if x[3] is not None), None)
            assert got[r[0]] == (last(part[:i]), part[i - 1][5] if i else "none", last(part[: i + 1]), after, i + 1, sum(x[2] <= r[2] for x in part))


def test_stops_over_days(spark):
    th, rows, want = cycles.Thresholds(no_close_s=3_000, tolerance_s=500), stream(2, 500), []
    for part in by_cam(rows).values():
        for i, r in enumerate(part):
            known = next((x[5] for x in reversed(part[:i]) if x[5] is not None), None)
            if r[5] not in ("opening", "open") or known in ("opening", "open"):
                continue
            shut = next((x[2] for x in part[i + 1 :] if x[5] == "closed"), None)
            close = shut if shut is not None and shut - r[2] <= 3_000 * US else r[2] + 3_000 * US
            sure = lambda x: x[3] is not None and x[4] in ("ok", "single_panel")
            src = r if sure(r) else next((x for x in part[i + 1 :] if sure(x)), None)
            if src is not r and not (src and src[2] <= close and src[2] - r[2] <= 3_000 * US):
                src = next((x for x in reversed(part[:i]) if sure(x)), None)
            want.append((r[0], r[2], close, src[3] if src and abs(src[2] - r[2]) <= 500 * US else None))
    got = [(r.id, r.ts_us, r.close_us, r.floor) for r in cycles.stops(spark.createDataFrame(rows, SCHEMA), th).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_nearest_window_over_days(spark):
    rng = random.Random(3)
    points = [(i, f"c{i % 2}", rng.randrange(6 * DAY)) for i in range(200)]
    windows = [(f"c{i % 2}", lo := rng.randrange(DAY, 5 * DAY), lo + rng.choice([0, 10, DAY, 2 * DAY])) for i in range(30)]
    got = {r.id: r.distance_us for r in joins.nearest_window(spark.createDataFrame(points, "id long, cam string, ts_us long"), spark.createDataFrame(windows, "cam string, lo long, hi long")).collect()}
    for i, cam, t in points:
        own = [(lo, hi) for c, lo, hi in windows if c == cam]
        inside = min(lo for lo, _ in own) <= t <= max(hi for _, hi in own)
        assert got[i] == (min(max(0, lo - t, t - hi) for lo, hi in own) if inside else None)


def test_interval_overlap_counts_pairs_once(spark):
    rng = random.Random(4)
    spans = lambda n, k: [(i, "c", lo := rng.randrange(1_000), lo + rng.choice([0, 1, 20, 300])) for i in range(k, k + n)]
    one, two = spans(40, 0), spans(40, 100)
    df = lambda rows: spark.createDataFrame(rows, "id long, cam string, lo long, hi long")
    got = sorted((r[0], r[1]) for r in joins.interval_overlap(df(one), df(two), 50).select("a.id", "b.id").collect())
    assert got == sorted((a[0], b[0]) for a in one for b in two if a[2] < b[3] and b[2] < a[3])


@pytest.mark.parametrize("seed", [5, 6])
def test_debounced_cycles(spark, seed):
    rows, hold = stream(seed, 600, gaps=(0, 1, 5, 60, 400, 90_000)), 300 * US
    want = {}
    for key, part in by_cam(rows, lambda r: (r[1], r[6])).items():
        states, starts = [], []
        for r in (r for r in part if r[5] is not None):
            if states and states[-1] == r[5]:
                continue
            if states and r[2] - starts[-1] < hold:
                states.pop(), starts.pop()
                if states and states[-1] == r[5]:
                    continue
            states.append(r[5]), starts.append(r[2])
        if states:
            want[key] = len(states), sum(b == "closed" and a in ("closing", "open") for a, b in zip(states, states[1:]))
    got = {(r.cam, r.door_version): (r.runs, r.cycles) for r in leftovers.debounced_cycles(spark.createDataFrame(rows, SCHEMA), hold).collect()}
    assert got == want


def test_throttled_rows(spark):
    rows, want = stream(7, 500, gaps=(0, 1, 5, 9, 12, 90_000)), []
    for part in by_cam(rows).values():
        last = None
        for r in part:
            if last is None or r[2] - last >= 10 * US:
                want.append(r[0])
                last = r[2]
    assert sorted(r.id for r in leftovers.throttled(spark.createDataFrame(rows, SCHEMA), 10 * US).collect()) == sorted(want)


def test_committed_intervals(spark):
    rng, rows = random.Random(8), []
    for i in range(150):
        lo = rng.randrange(4 * DAY)
        hi = lo + rng.choice([5, 60, 4_000]) * US
        for p in range(rng.choice([1, 3, 4])):
            drift = rng.randrange(-3, 4) * US
            rows.append((f"c{i % 2}", i * 10 + p, lo + drift, hi + drift, hi + rng.randrange(-200, 900) * US))
    want = []
    for cam in ("c0", "c1"):
        taken = []
        for _, i, lo, hi, seen in sorted((r for r in rows if r[0] == cam), key=lambda r: (r[4], r[2], r[3], r[1])):
            if seen - hi >= 150 * US and all(not (lo < b and a < hi) for a, b in taken):
                taken.append((lo, hi))
                want.append((cam, i, lo, hi))
    got = [tuple(r) for r in leftovers.committed(spark.createDataFrame(rows, "cam string, id long, lo long, hi long, seen_us long"), 150 * US).collect()]
    assert sorted(got) == sorted(want)


def plain_quantum(pool):
    from collections import Counter

    counts = Counter(round(v, 3) for v in pool if v > 0)
    n = sum(counts.values())
    if n < 30:
        return None
    tol = lambda q: max(0.003, 0.02 * q)
    near = lambda q: [(v, c) for v, c in counts.items() if round(v / q) >= 1 and abs(v - round(v / q) * q) <= tol(q)]
    top = sorted(sorted(counts, key=lambda v: (-counts[v], v))[:12])
    found, best = sorted({x for x in top + [round(b - a, 3) for a, b in zip(top, top[1:])] if x >= 0.005}), None
    while found:
        cluster = [found.pop(0)]
        while found and found[0] - cluster[0] <= tol(found[0]):
            cluster.append(found.pop(0))
        q = max(cluster, key=lambda x: counts[x])
        for _ in range(3):
            if on := near(q):
                q = sum(c * v * round(v / q) for v, c in on) / sum(c * round(v / q) ** 2 for v, c in on)
        if sum(c for _, c in near(q)) / n >= 0.55:
            best = q if best is None else max(best, q)
    return best


def test_sampling_quantum(spark):
    rng, pools = random.Random(9), {}
    for i in range(12):
        q = rng.choice([0.04, 0.08, 0.24, 0.333])
        pools[f"p{i}"] = [round(q * rng.randint(1, 12) + rng.choice([-0.001, 0, 0.001]), 3) for _ in range(rng.choice([20, 60, 200]))] + [rng.uniform(0, 3) for _ in range(rng.choice([0, 10, 200]))] + [0.0, -1.0]
    df = spark.createDataFrame([(k, float(v)) for k, p in pools.items() for v in p] + [("p0", None)], "k string, v double")
    got = {r.k: (r.n, r.quantum_s) for r in leftovers.sampling_quantum(df, ["k"], "v").collect()}
    for k, p in pools.items():
        want = plain_quantum(p)
        assert got[k][0] == sum(v > 0 for v in p) and (got[k][1] is None) == (want is None) and (want is None or abs(got[k][1] - want) < 1e-9), k


def test_run_ledger_and_sender(spark, tmp_path):
    from hoistway.sources.sinks import RunLedger
    from hoistway.streaming import jobs

    ledger = RunLedger(spark, f"{tmp_path}/ledger")
    assert ledger.run("stage", lambda: 7) == 7
    with pytest.raises(KeyError):
        ledger.run("broken", lambda: {}["x"])
    got = {r.stage: (r.n_rows, (r.error or "")[:8]) for r in ledger.read(time.time()).collect()}
    assert got == {"stage": (7, ""), "broken": (None, "KeyError")} and ledger.read(time.time() + 15 * 86_400).count() == 0
    assert RunLedger(spark, "/proc/none/ledger").run("kept on", lambda: 1) == 1
    spark.range(5).write.json(f"{tmp_path}/in")
    out = str(tmp_path)

    def sender(url, lines, what):
        import uuid

        with open(f"{url}/{what}-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(lines))

    jobs.send_batches(spark.readStream.schema("id long").json(f"{tmp_path}/in"), sender, out, "sent", rows=2).awaitTermination()
    lines = [line for p in tmp_path.glob("sent-*") for line in p.read_text().split("\n")]
    assert sorted(lines) == [f'{{"id":{i}}}' for i in range(5)] and all(len(p.read_text().split("\n")) <= 2 for p in tmp_path.glob("sent-*"))


def test_four_times_the_rows_cost_under_five_times_the_time(spark):
    def seconds(n):
        rows = spark.range(n).select(F.col("id"), F.lit("c").alias("cam"), (F.col("id") * 20 * US).alias("ts_us"), F.when(F.col("id") % 7 == 0, "G").alias("floor"), F.lit("ok").alias("reason"),
            F.element_at(F.array(*map(F.lit, ("opening", "open", "closing", "closed"))), (F.col("id") % 4 + 1).cast("int")).alias("door_state"), F.lit("v").alias("door_version"))
        took = []
        for _ in range(2):
            began = time.time()
            cycles.stops(rows, cycles.Thresholds()).write.format("noop").mode("overwrite").save()
            cycles.round_trips(rows, "G").write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    seconds(1_000)
    assert seconds(160_000) < 5 * seconds(40_000)
