from hoistway.streaming import machines

US = machines.US


def states(values, step=100_000):
    m = machines.DoorMachine(machines.Signal())
    return [s for i, v in enumerate(values) for _, s in m.step(i * step, v)]


def test_door_machine_holds_levels_and_resumes():
    quiet, wide = [100.0] * 50, [0.0] * 50
    ramp = lambda a, b, n: [a + (b - a) * i / n for i in range(n)]
    signal = quiet + ramp(100, 0, 20) + wide + ramp(0, 100, 20) + quiet + ramp(100, 0, 20) + wide
    assert states(signal)[-3:] == ["open", "closed", "open"]
    a = machines.DoorMachine(machines.Signal())
    out = []
    for i, v in enumerate(signal):
        out += a.step(i * 100_000, v)
        a = machines.DoorMachine(machines.Signal(), a.saved())
    assert [s for _, s in out] == states(signal)


def test_a_slow_movement_is_abandoned():
    signal = [100.0] * 40 + [0.0] * 40 + [100.0] * 90 + [50.0] * 200
    assert states(signal)[-1] is None
    assert states([5.0] * 100) == []


def test_track_counter():
    c = machines.TrackCounter()
    path = [("outside", 0.1), ("outside", 0.15), (None, 0.5), ("inside", 0.8), ("inside", 0.9), ("inside", 0.9), ("outside", 0.7), ("outside", 0.7)]
    assert [c.step(i * 100_000, z, y) for i, (z, y) in enumerate(path)] == [None, None, None, None, "in", None, None, "rejected"]
    assert c.step(20 * US, "outside", 0.1) is None and c.step(20 * US + 1, "outside", 0.1) is None


def test_last_descent_restarts_at_a_later_top():
    from hoistway.operators import leftovers

    assert leftovers.last_descent([90, 50, 85, 40, 10, 95, 5, 50], 80, 20) == (5, 6)
    assert leftovers.last_descent([90, 50, 30], 80, 20) is None and leftovers.last_descent([], 80, 20) is None
    assert leftovers.ramp([i * US for i in range(10)], [100, 100, 80, 60, 40, 20, 0, 0, 0, 0]) == 4.0
    assert leftovers.ramp([0], [1.0]) is None


def cycles(signal, step=100_000, saved=False):
    m, out = machines.EdgeMachine(machines.Edge()), []
    for i, v in enumerate(signal):
        t, x = v if isinstance(v, tuple) else (i * step, v)
        out.append(m.step(t, x))
        m = machines.EdgeMachine(machines.Edge(), m.saved()) if saved else m
    return [c for c in out if c], m


def test_edge_machine_hysteresis_debounce_gap_and_withheld_travel():
    ramp = lambda a, b, n: [a + (b - a) * i / n for i in range(n)]
    base = [0.0] * 30 + [100.0] * 30 + [0.0] * 5
    cycle = ramp(0, 100, 20) + [100.0] * 20 + ramp(100, 0, 20) + [0.0] * 20
    got, _ = cycles(base + cycle)
    start, full, close, end, travel, quality = got[-1]
    assert quality == "ok" and travel == end - close == 1_600_000 and full - start == 800_000
    assert cycles(base + cycle, saved=True)[0] == got
    flaps = ramp(0, 100, 20) + [100.0] * 10 + [80.0, 100.0] * 10 + [60.0, 100.0] * 5 + ramp(100, 0, 20) + [0.0] * 10
    assert len(cycles(base + flaps)[0]) == len(got)
    sudden, _ = cycles(base + ramp(0, 100, 20) + [100.0] * 20 + [0.0] * 20)
    assert sudden[-1][4:] == (None, "withheld")
    times = [(i * 100_000 + (20 * US if i >= len(base) + 48 else 0), v) for i, v in enumerate(base + cycle)]
    cut, m = cycles(times)
    assert len(cut) == len(got) - 1 and m.abandoned == 1 and m.state == "closed"
