"""Label admission against a plain walk over the reads, and its chains of removals."""

import random

import pytest

from hoistway.operators import alphabet

US = 1_000_000
BY = alphabet.Evidence()


def image(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return a == "1" + b or b == "1" + a


def plain(reads, labelled, prior, order=()):
    """floor: (n, supported, anchored, flips, twin, admitted, via), walking the reads (seconds, floor, conf) of one camera in order."""
    place = lambda f: order.index(f) if f in order else int(f) if f.lstrip("+-").isdigit() else None
    floors = list(dict.fromkeys(f for _, f, _ in reads))
    support, near, flips = set(), {f: {f} for f in floors}, []
    for (t0, f0, _), (t1, f1, _) in zip(reads, reads[1:]):
        if place(f0) is None or place(f1) is None or t1 <= t0:
            continue
        gap = abs(place(f0) - place(f1))
        if gap / (t1 - t0) <= 3:
            support |= {f0, f1}
            if t1 - t0 <= 15:
                near[f0].add(f1)
                near[f1].add(f0)
        elif t1 - t0 <= 45 and gap >= 5 and image(f0, f1):
            flips.append((f0, f1))
    twin, count = {}, {}
    for pair in flips:
        for f, x in (pair, pair[::-1]):
            twin.setdefault(f, x)
            count[f] = count.get(f, 0) + (twin[f] == x)

    def component(f):
        seen, todo = {f}, [f]
        while todo:
            more = near[todo.pop()] - seen
            seen |= more
            todo += more
        return seen

    anchored_any = any(f in labelled and place(f) is not None for f in floors)
    mean = lambda f: sum(c for _, x, c in reads if x == f) / sum(x == f for _, x, _ in reads)
    out = {}
    for f in floors:
        n = sum(x == f for _, x, _ in reads)
        anchored = None if place(f) is None else not anchored_any or any(x in labelled and place(x) is not None for x in component(f))
        if f in labelled:
            via = "labeled"
        elif place(f) is None:
            via = "reject:non_numeric_unlabeled"
        elif f not in support:
            via = "reject:no_transition_support"
        elif n < 3:
            via = f"reject:only_{n}_sightings"
        elif anchored:
            via = "corroborated"
        else:
            via = "corroborated:lone" if len(component(f)) == 1 else "quarantine:unanchored_island"
        out[f] = [n, f in support, anchored, count.get(f, 0), None, via in ("labeled", "corroborated", "corroborated:lone"), via]
    worse = lambda f: f in twin and count[f] >= 2 and f not in labelled and out[twin[f]][5] and mean(f) < mean(twin[f])
    while True:
        up = [f for f in floors if out[f][5] and worse(f)]
        go = [f for f in up if twin[f] not in up]
        if not go:
            break
        for f in go:
            out[f][4:] = [twin[f], False, f"quarantine:glyph_shadow_of_{twin[f]}"]
    for f in floors:
        if out[f][6] == "quarantine:unanchored_island" and worse(f):
            out[f][4:] = [twin[f], False, f"quarantine:glyph_shadow_of_{twin[f]}"]
    for f in prior:
        if f not in out:
            out[f] = [0, False, None, 0, None, True, "retained:no_rows"]
        elif out[f][6].startswith(("reject:non", "reject:only")):
            out[f][5:] = [True, "retained:" + out[f][6]]
    return {f: tuple(x) for f, x in out.items()}


def derived(spark, cams, labelled, prior, order=()):
    rows = [(cam, "v1", int(t * US), i, f, c, "ok") for cam, reads in cams.items() for i, (t, f, c) in enumerate(reads)]
    rows += [(cam, "v1", int(t * US), 10**6, "99", 0.9, "no_read") for cam, reads in cams.items() for t, *_ in reads[:3]] + [(cam, "v1", 0, 10**6, None, None, "ok") for cam in cams]
    door = spark.createDataFrame(rows, "cam string, door_version string, ts_us long, id long, floor string, read_conf double, reason string").repartition(3)
    dims = [spark.createDataFrame([(c, f) for c in cams for f in x.get(c, ())] or [("none", "x")], "cam string, floor string") for x in (labelled, prior)]
    got = alphabet.admission(door, *dims, BY, order).collect()
    return {c: {r.floor: (r.n, r.supported, r.anchored, r.flips, r.twin, r.admitted, r.via) for r in got if r.cam == c} for c in cams}


def test_admission_equals_a_plain_walk_over_random_reads(spark):
    rng, cams, labelled, prior = random.Random(5), {}, {}, {}
    for n in range(30):
        floors = [str(x) for x in rng.sample(range(1, 40), 8)] + [str(70 + x) for x in rng.sample(range(1, 10), 3)] + ["1" + str(x) for x in rng.sample(range(10, 30), 2)] + ["G", "7G"]
        sure, t, reads = {f: rng.random() for f in floors}, 90_000.0 * rng.random(), []
        for _ in range(rng.choice([20, 120, 400])):
            t += rng.choice([0, 0.5, 1, 2, 4, 8, 14, 20, 50, 30_000 if rng.random() < 0.05 else 3])
            f = rng.choice(floors if rng.random() < 0.6 else floors[:3])
            reads.append((t, f, sure[f]))
        cams[f"c{n}"], labelled[f"c{n}"], prior[f"c{n}"] = reads, set(rng.sample(floors, rng.choice([0, 1, 2]))), set(rng.sample(floors, 3)) | {"P9"}
    got, seen = derived(spark, cams, labelled, prior), set()
    for c, reads in cams.items():
        want = plain(reads, labelled[c], prior[c])
        assert got[c] == want, c
        seen |= {x[6].split("_of_")[0].split("only_")[0] for x in want.values()}
    assert {"labeled", "corroborated", "quarantine:glyph_shadow", "reject:no_transition_support", "reject:", "reject:non_numeric_unlabeled", "retained:no_rows"} <= seen


def flips(t, a, b, n, conf):
    """n alternations between two labels at an impossible speed."""
    return [(t + i, a if i % 2 == 0 else b, conf[a if i % 2 == 0 else b]) for i in range(n + 1)]


def runs(t, floors, conf):
    return [(t + 4 * i, f, conf[f]) for i, f in enumerate(floors * 3)]


@pytest.mark.parametrize(("conf", "gone"), [({"21": 0.9, "26": 0.8, "20": 0.7, "29": 0.1}, {"26", "29"}), ({"21": 0.9, "26": 0.95, "20": 0.7, "29": 0.8}, {"20", "21"})])
def test_removals_wait_for_their_twins(spark, conf, gone):
    """26 against 21, and 29 against 20: a label goes once, towards a label that stands."""
    conf = {**{f: 0.5 for f in ("22", "23", "24", "25", "27", "28")}, **conf}
    reads = runs(0, [str(f) for f in range(20, 30)], conf)
    reads += flips(1000, "21", "26", 4, conf) + flips(2000, "20", "29", 4, conf)
    got = derived(spark, {"a": reads}, {}, {})["a"]
    assert {f for f, x in got.items() if x[6].startswith("quarantine:glyph_shadow")} == gone and got == plain(reads, set(), set())


def test_a_chain_dies_from_its_top(spark):
    """30 < 35 < 39 in confidence, each flipping with the next: 35 goes, and with it what spoke against 30."""
    conf = {**{str(f): 0.5 for f in range(28, 41)}, "30": 0.6, "35": 0.7, "39": 0.8}
    reads = runs(0, [str(f) for f in range(28, 41)], conf) + flips(1000, "30", "35", 3, conf) + flips(2000, "39", "39", 1, conf)
    reads += [(3000 + i, f, conf[f]) for i, f in enumerate(["39", "30", "39", "30"])]
    for labelled in (set(), {"39"}, {"30"}):
        assert derived(spark, {"a": reads}, {"a": labelled}, {})["a"] == plain(reads, labelled, set())


def test_an_island_without_a_label_is_quarantined(spark):
    conf = {str(f): 0.9 for f in [*range(15, 21), *range(75, 81)]}
    reads = runs(0, ["15", "16", "17", "18", "19", "20"], conf) + runs(10_000, ["77", "78", "79"], conf) + [(20_000, "60", 0.9), (20_100, "60", 0.9), (20_200, "60", 0.9)]
    got = derived(spark, {"a": reads}, {"a": {"16"}}, {"a": {"77", "P1"}})["a"]
    assert {f: got[f][6] for f in ("16", "19", "78", "60", "P1")} == {"16": "labeled", "19": "corroborated", "78": "quarantine:unanchored_island", "60": "corroborated:lone", "P1": "retained:no_rows"}
    assert got["77"][6] == "quarantine:unanchored_island" and not got["77"][5]  # evidence spoke against it
    assert all(x[2] for f, x in derived(spark, {"a": reads}, {}, {})["a"].items())  # no labelled floor was read: the rule is off


def test_a_declared_order_places_labels(spark):
    order = ("B1", "G", "M", "1", "2")
    reads = [(4 * i, f, 0.9) for i, f in enumerate(["B1", "G", "M", "1", "2", "7G"] * 4)]
    got = derived(spark, {"a": reads}, {}, {}, order)["a"]
    assert got == plain(reads, set(), set(), order) and got["M"][6] == "corroborated" and got["7G"][6] == "reject:non_numeric_unlabeled"
