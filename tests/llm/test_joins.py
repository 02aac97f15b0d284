import math
import random

import numpy as np
import pytest
from oracle_llm import components, edit_distance_within
from pyspark.sql import functions as F

from hoistway.llm import components as cc
from hoistway.llm import decontaminate, line_dedup, ngram_join, topk
from hoistway.llm.queries import ORACLE_SQL, QUERIES


def corpus(seed=1):
    """Copies, near copies of several grades, a shared passage, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["ka", "lo", "mi", "ne", "ru"]) + str(rng.randrange(500))
    passage, rows = [word() for _ in range(40)], []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 30, 80]))]
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own if rng.random() < 0.7 else own + passage))
    big = [word() for _ in range(60)]
    for _ in range(40):
        own = list(big)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            own[rng.randrange(60)] = word()
        rows.append(" ".join(own))
    chain = [[word() for _ in range(25)] for _ in range(40)]
    for i in range(39):  # neighbours share a rare passage and don't link; some have a near copy
        own = chain[i] + [word() for _ in range(20)] + chain[i + 1]
        rows += [" ".join(own)] + [" ".join([word(), *own[1:]])] * (i % 5 == 0)
    rows += ["", None, "   \n", "One", "ONE", "one two three four", "é É", "É É", rows[0].upper() if rows[0] else ""]
    rng.shuffle(rows)
    return dict(enumerate(rows))


@pytest.mark.parametrize("block", [8, 1000])
def test_ngram_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert got == components(texts)


def test_ngram_join_edges(spark):
    schema = "doc_id long, text string"
    assert ngram_join.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = ngram_join.jaccard_components(spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "A B C"), (7, None)], schema)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in rows) == [("5", 1, 5), ("5", 1, 5), ("7", 0, 7), ("None", 1, 5)]


def test_ngram_join_of_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(base), " ".join(base[4:] + ["x1", "x2"]), " ".join(base[8:] + ["x1", "x2", "y1", "y2"])
    far = " ".join(f"v{i}" for i in range(50))
    long = [f"u{i % 7000}" for i in range(40_000)]
    rows = [(9, a), (None, b), (4, c), (4, far), (8, far + " end"), (None, None), (2, " ".join(long)), (6, " ".join(long[3:])), (None, "lone text of a few words only")]
    df = spark.createDataFrame([(i, t, "d", 1, 2) for i, t in rows], "doc_id long, text string, doc string, t int, key int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.jaccard_components(df).collect())
    want = components(dict(enumerate(t for _, t in rows)))
    least = {root: min((rows[i][0] for i, (_, r) in want.items() if r == root and rows[i][0] is not None), default=None) for _, root in want.values()}
    assert got == sorted((str(i), want[n][0], str(least[want[n][1]])) for n, (i, _) in enumerate(rows))
    assert [r for r in got if r[0] == "None" and r[2] == "4"]  # the bridge between 9 and 4 has no id
    gone = ngram_join.beside_first(ngram_join.jaccard_components(df.unionByName(spark.createDataFrame([(4, c + " z", "d", 1, 2), (None, "lone text of a few words only", "d", 1, 2), (None, "", "d", 1, 2)], df.schema))))
    left = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("d").join(gone.alias("g"), F.expr("d.doc_id <=> g.doc_id AND d.text_hash = g.text_hash"), "left_anti")
    kept = {(r.doc_id, r.text) for r in left.collect()}
    assert {(4, far), (None, None), (2, rows[6][1]), (None, rows[8][1])} <= kept and not {(9, a), (None, b), (8, far + " end"), (6, rows[7][1])} & kept


def test_ngram_join_with_many_groups(spark, monkeypatch):
    for name, value in {"BLOCK": 8, "BROADCAST_GROUPS": 0, "BROADCAST_SETS": 0}.items():
        monkeypatch.setattr(ngram_join, name, value)
    texts = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == components(texts)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    got = cc.components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)


def test_line_dedup_cases(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "q\nq\nq\nq\nq"), (None, "a\nb\nc"), (7, "b\nc\nd")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, cut string")).collect()}
    assert got[1] == ("a\nb\nc\nd", 4, 0) and got[2] == ("x\ny", 5, 3) and got[3] == ("a\nb", 2, 0) and got[4] == (None, 0, 0)
    assert got[5] == ("", 1, 0) and got[6] == ("q\nq\nq", 5, 2) and got[None] == ("a\nb\nc", 3, 0) and got[7] == ("", 3, 3)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_of_texts_under_one_id(spark):
    import duckdb
    from oracle import same

    up = lambda letters: "\n".join(letters)
    rows = [(1, up("abcd")), (2, up("abcz")), (2, up("pqrs")), (3, up("pqrst")), (2, up("pqrs")), (None, up("pqrs")), (4, up("é€x")), (5, up("é€xé€x"))]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, th string, pos int, at int")
    got = sorted((str(r.doc_id), r.text.replace("\n", "")) for r in line_dedup.dedup_lines(df).collect())
    assert got == [("1", "abcd"), ("2", "pqrs"), ("2", "pqrs"), ("2", "z"), ("3", "t"), ("4", "é€x"), ("5", ""), ("None", "pqrs")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    same(line_dedup.dedup_lines(df), con, line_dedup.ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, small, name):
    from oracle import connect, same

    same(QUERIES[name](spark, small), connect(small), ORACLE_SQL[name])


def best_by_hand(rows, k=20):
    """(query, rank, id, score) of each distinct (id, vector) whose id is divisible by 20."""
    ints = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows]
    out = []
    for i, v in sorted({r for r in ints if r[0] % 20 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ints if j != i and len(v) == len(w))[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("slab", [1 << 20, 300])
def test_topk_edges(spark, monkeypatch, slab):
    for name, value in {"CANDIDATE_BLOCK": 16, "QUERY_BLOCK": 4, "DIMENSIONS": 3, "SLAB_BYTES": slab}.items():
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(2)
    vec = lambda n=8: [rng.choice([-1.5, -0.3, 0.0, 0.2, 1.0]) for _ in range(n)]
    rows = [(i, vec()) for i in range(90)] + [(100 + i, vec(5)) for i in range(25)]
    rows += [rows[20], rows[20], (20, vec()), (40, vec(5)), rows[33], (33, vec()), rows[60]]
    odd = [(60, None), (61, [float("nan")] * 8), (62, [None] * 8), (63, [float("inf")] + [0.0] * 7), (64, [1.0]), (65, []), (None, vec())]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, score int, query string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 20 = 0")).collect()]
    assert sorted(got) == best_by_hand(rows)
    assert topk.top_k(df.limit(0), df).count() == topk.top_k(df, df.limit(0)).count() == 0


def test_topk_of_large_components_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1e7, 3.0, 1e7 + 1]) for _ in range(6)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 20 = 0")).collect()) == best_by_hand(rows)


def test_topk_sql_of_repeated_rows(spark):
    import duckdb
    from oracle import same

    rng = random.Random(4)
    rows = [(i % 50, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for i in range(80)] + [(0, [1.0, 1.0, 1.0, 1.0])] * 3
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(topk.top_k(df, df.where("vec_id % 20 = 0")), con, ORACLE_SQL["op7_topk_branch_bound"])


def test_decontamination_equals_brute_force():
    rng, bad = random.Random(5), 0
    letters = "abcdefgh  "
    for _ in range(300):
        item = decontaminate.compared("".join(rng.choice(letters) for _ in range(rng.choice([3, 5, 8, 10, 12, 15, 20, 22, 23, 30, 31, 35, 60, 120]))))
        if not item:
            continue
        s = list(item)
        for _ in range(rng.randint(0, int(len(s) * 0.13) + 1)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[rng.choice("xyz")], [s[k], rng.choice("xyz")], []]) or [] if len(s) > 2 else [s[k]]
        text = decontaminate.compared("".join(rng.choice(letters) for _ in range(80)) + "".join(s) + "".join(rng.choice(letters) for _ in range(80)))
        found = decontaminate.find([text], decontaminate.Items([(1, item)]))
        bad += (edit_distance_within(item, text) <= int(0.1 * len(item))) != bool(found)
    assert bad == 0


def test_decontamination_of_a_shared_opening(monkeypatch):
    """Items of one template, in texts of many openings: nothing is found but what stands there, in bounded time and pieces."""
    import time

    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    opening = "which of the following statements best describes the "
    bench = [(i, opening + words(18)) for i in range(5_000)]
    texts = [words(30) + " " + opening + words(60) for _ in range(150)] + [" ".join(opening + words(2) for _ in range(40)), words(9) + " " + bench[77][1][:60] + "Q" + bench[77][1][61:] + " " + words(9)]
    items = decontaminate.Items(bench)
    began = time.time()
    got = decontaminate.find(texts, items)
    assert [(d, i, c) for d, i, *_, c in got] == [(151, 77, 1)]
    assert time.time() - began < 60
    few = decontaminate.Items(bench[60:90] + [bench[77]])
    monkeypatch.setattr(decontaminate, "ENTRIES", 50)
    monkeypatch.setattr(decontaminate, "ALIGNED", 3)
    assert [(d, i) for d, i, *_ in decontaminate.find(texts[140:], few)] == [(11, 77), (11, 77)]
    assert decontaminate.find(["a" * 4_000, "b" * 50], decontaminate.Items([(1, "a" * 60), (2, "a" * 61 + "b" * 9), (3, "ab")])) == [(0, 1, 0, 60, 0)]


def test_decontamination_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x the quick brown fox jumps", 5, "i"), (1, "x the quick brown fox jumps", 5, "i"), (2, "w " * 150_000 + "the quick brown f0x jumps", 5, "i")], "doc_id long, text string, start int, item_id string")
    bench = spark.createDataFrame([(9, "the quick brown fox jumps", 1), (9, "the quick brown fox jumps", 1), (10, "The QUICK brown fox jumps", 1)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, r.distance, r.passage) for r in decontaminate.leaks(docs, bench).collect())
    assert got == sorted(2 * [(1, i, 0, "the quick brown fox jumps") for i in (9, 9, 10)] + [(2, i, 1, "the quick brown f0x jumps") for i in (9, 9, 10)])
    assert decontaminate.clean(docs, bench).count() == 0 and decontaminate.clean(docs, bench.limit(0)).columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_decontamination_rows(spark):
    docs = spark.createDataFrame([(1, "Say THE quick  brown fox jumps over it"), (2, None), (3, ""), (4, "clean text of no item"), (None, "the quick brown fox jumps")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "the quick brown fox jumps"), (8, None), (7, ""), (6, "zq")], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in decontaminate.leaks(docs, bench).collect()) == [("1", 9, 0), ("None", 9, 0)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [2, 3, 4]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_clean_takes_short_items_at_words_and_items_without_id(spark):
    texts = ["a yes, it is", "yesterday a map", "say YES", "zqx", "the quick brown fox jumps over it", "n/a yes2 yes", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "yes"), (2, "zq"), (None, "the quick brown fox jumps")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 3, 6]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == [(0, 1), (1, 1), (2, 1), (3, 2), (5, 1)]


def test_short_items_in_scripts_without_spaces(spark):
    from hoistway.llm import decontaminate

    docs = spark.createDataFrame([(1, "他在北京大学读书"), (2, "the catalogue"), (3, "the cat sat"), (4, "เขาอยู่ที่บ้านหลังนี้"), (5, "서울대학교")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "北京大学"), (2, "cat"), (3, "บ้าน"), (4, "대학")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 4)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [2, 5]
