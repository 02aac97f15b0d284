"""Importance resampling, filter interactions and the grid join against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from oracle_llm import LOWER

from hoistway.llm import filter_audit, grid_join
from hoistway.llm import importance_resample as ir
from hoistway.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, n long, weight string, part string"


def grams(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode("utf-8", "surrogatepass")) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def odd_texts(n=150):
    rng = random.Random(4)
    parts = ["a", "B", "é", "漢", "1", " ", "-", "_", "\n", "zz", "Qx", "\x7f", "😀"]
    return ["", None, "one", "one two", "x" * 5000 + " y" + "z" * 300, " ".join(["the same"] * 400)] + ["".join(rng.choice(parts) for _ in range(rng.choice([1, 5, 50, 400]))) for _ in range(n)]


@pytest.mark.parametrize("window", [3, 7, 20_000])
def test_crcs_from_prefixes_equal_those_of_the_bytes(monkeypatch, window):
    monkeypatch.setattr(ir, "WINDOW", window)
    texts, got = [t or "" for t in odd_texts()], {}
    for scan, places in ir.scanned(texts):
        for n in (1, 2, 3):
            crc, of = scan.grams(n)
            for a, b in zip(crc.tolist(), of.tolist()):
                got.setdefault(places[b], []).append(a)
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(grams(text)[1])


def resampled(rows, targets):
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for texts, to in (([r[1] for r in rows], s), (targets, t)):
        for text in texts:
            for crc in grams(text)[1]:
                to[crc % 10_000] += 1
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + 10_000) / ((int(a) + 1) * (int(t.sum()) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for at, (i, text) in enumerate(rows):
        words, crcs = grams(text)
        weight = sum(gain[c % 10_000] for c in crcs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20, at])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    rank = {r[5]: k for k, r in enumerate(order[: 5 * len(order) // 100], 1)}
    return sorted((tuple(r[:4]) + (rank.get(r[5]),) for r in out), key=str)


@pytest.mark.parametrize("targets", [["the same the same one two", None, "Qx Qx zz"], []])
def test_resampling_equals_brute_force(spark, targets):
    rows = list(enumerate(odd_texts()))
    df = spark.createDataFrame([(i, t, 1, "w", "p") for i, t in rows], SCHEMA).repartition(5)
    got = ir.resample(df, spark.createDataFrame([(k, t) for k, t in enumerate(targets)], "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == resampled(rows, targets)
    assert got[0].__fields__ == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_of_odd_rows(spark):
    target = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert ir.resample(spark.createDataFrame([], SCHEMA), target).count() == 0
    long = " ".join(f"w{i % 97}" for i in range(60_000))
    rows = [(None, "a " * 30)] * 2 + [(7, "a " * 30)] * 40 + [(8, long), (9, None)]
    df = spark.createDataFrame([(i, t, 1, "w", "p") for i, t in rows], SCHEMA)
    got = ir.resample(df, target).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == [r[:4] for r in resampled(rows, ["alpha beta"])]
    assert sorted(r.rank for r in got if r.rank) == [1, 2]
    assert {r.doc_id: r.n_features for r in got}[8] == 3 * 60_000 - 3


def failing(rows, labels):
    least, out = {}, []
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, source in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text]}
        out.append((source or "", {k for k, v in fails.items() if v}, any(q == 1 for d, q, _ in labels if d == i and i is not None), any(x == 1 for d, _, x in labels if d == i and i is not None)))
    return out


def audited(rows, labels):
    docs, out = failing(rows, labels), []
    for part in {d[0] for d in docs}:
        own, totals = [d for d in docs if d[0] == part], {}
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                before = [d for d in own if f in d[1] and d[1] & set(order[: step - 1])]
                totals[f] = totals.get(f, 0) + len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), len(before), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        out += [(*s[:-1], totals[s[-1]]) for s in steps]
    return sorted(out)


def test_filter_audit_equals_every_order(spark):
    rng = random.Random(3)
    rows = [(0, None, "s"), (1, "", "s"), (2, " \t\n", None), (None, "", "s"), (5, "A", ""), (5, "A", ""), (6, "A", "t"), (6, "A", "t")]
    for i in range(10, 150):
        words = [rng.choice(["ab", "cd", "EF", "g#", "é"]) + str(rng.randrange(rng.choice([3, 200]))) for _ in range(rng.choice([3, 49, 50, 80]))]
        rows.append((i, " ".join(words), rng.choice(["s", "t", None, "u"])))
        if rng.random() < 0.3:
            rows.append((i + 1000, rows[-1][1], rng.choice(["s", "u"])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(10, 1, 1), (10, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, mask long, digest string").repartition(3)
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = sorted(tuple(r) for r in filter_audit.audit(df, marks).collect())
    assert got == audited(rows, labels)
    empty = filter_audit.audit(df.limit(0), marks)
    assert empty.count() == 0 and empty.columns[:3] == ["part", "filter_order", "step"]
    assert filter_audit.audit(df.where("doc_id = 1"), marks.limit(0)).count() == 600


def test_least_squares_give_shapley_values():
    rng = random.Random(8)
    for n in (2, 3, 5):
        v = [0] + [rng.randrange(-50, 50) for _ in range((1 << n) - 1)]
        want = [Fraction(0)] * n
        for order in itertools.permutations(range(n)):
            behind = 0
            for i in order:
                want[i] += Fraction(v[behind | 1 << i] - v[behind], math.factorial(n))
                behind |= 1 << i
        assert filter_audit.shapley(v) == want


def linked(rows, least=0.98):
    """(id, links, least id reachable) of each row."""
    sound = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {k: [] for k in range(len(rows))}
    for a, b in itertools.combinations(sound, 2):
        x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
            near[a].append(b)
            near[b].append(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        own = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((i, len(near[k]), own, i is not None and i == own))
    return sorted(out, key=str)


def vectors(seed=2):
    """Chains, tight groups (with copies and multiples), wide groups and lone vectors of three labels, and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows, dims = [], 12
    for label in (1, 2, 2):
        centre = rng.normal(size=dims)
        for spread, n in ((0.001, 60), (0.05, 60), (0.3, 40)):
            rows += [(centre + spread * rng.normal(size=dims) / 2, label) for _ in range(n)]
        a, b = rng.normal(size=dims), rng.normal(size=dims)
        rows += [(math.cos(0.15 * k) * a + math.sin(0.15 * k) * b, label) for k in range(25)]
        rows += [(rng.normal(size=dims), label) for _ in range(20)]
    rows += [rows[0], rows[0], (rows[5][0] * 3, 1), (rows[5][0], 2), (rows[7][0][:6], 1), (rows[7][0][:6] * 2, 1)]
    order = rng.permutation(len(rows)).tolist()
    out = [(10 + k, [float(np.float32(x)) for x in rows[j][0]], rows[j][1]) for k, j in enumerate(order)]
    nan, inf = float("nan"), float("inf")
    return out + [(1, None, 1), (2, [], 1), (3, [0.0] * dims, 1), (4, [1.0, None] * 6, 1), (5, [nan] * dims, 1), (6, [inf] + [0.0] * 11, 1), (7, out[0][1], None), (None, out[0][1], 1), out[3], out[3], (out[4][0], out[9][1], out[9][2])]


@pytest.mark.parametrize(("block", "seed"), [(4, 2), (16, 3), (1024, 4)])
def test_grid_join_equals_brute_force(spark, monkeypatch, block, seed):
    monkeypatch.setattr(grid_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(grid_join, "RADIX", 2)
    rows = vectors(seed)
    df = spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in rows], "vec_id long, embedding array<float>, label int, node int, at int").repartition(3)
    got = sorted((tuple(r) for r in grid_join.near_vectors(df).collect()), key=str)
    assert got == linked(rows)


def test_grid_join_counts_certain_pairs_without_comparing(spark, monkeypatch):
    """A tight group is settled by its intervals: fewer pairs are compared than it has."""
    seen = []
    real = grid_join._compared
    monkeypatch.setattr(grid_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(grid_join, "_compared", lambda leaves, *a: seen.append(leaves.where("kind = 0").count()) or real(leaves, *a))
    rng = np.random.default_rng(1)
    rows = [(k, [1.0 + 1e-3 * float(x) for x in rng.normal(size=8)], 3) for k in range(400)]
    got = grid_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(399, 0)} and seen == [0]


def test_grid_join_of_an_empty_table(spark):
    out = grid_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == 0
    assert [tuple(r) for r in grid_join.near_vectors(spark.createDataFrame([(4, [0.0], 1)], "vec_id long, embedding array<float>, label int")).collect()] == [(4, 0, 4, True)]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_importance_resample", "op13_grid_join"])
def test_queries_equal_their_sql(spark, small, name):
    from oracle import connect, same

    same(QUERIES[name](spark, small), connect(small), ORACLE_SQL[name])
