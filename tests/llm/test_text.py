import pytest
from pyspark.sql import functions as F

from hoistway.llm import html_extract, labelled, quality_fm, toxicity, warc_revisits


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
    <div id=wrap><div class="cookie-notice">We use</div><article class="post-12"><header><h1>T &lt; 3 &amp</h1><p>by me</p></header><p>One<p>Two <b>bo</b>ld a < b<br>x
    <div class="ad">buy</div>tail<ul><li>i1<li>i2</ul><form>q</form></article><div class="comments"><p>a long comment by a reader who writes a lot of words here</p></div></div><footer>f</footer>"""
    assert html_extract.extract(page, None) == "T < 3 &\nOne\nTwo bold a < b x\ntail\ni1\ni2"
    assert html_extract.extract("", None) == "" and html_extract.extract("<p>x</p><scr", None) == "x" and html_extract.extract("just &am", None) == "just &am"


def test_hosts_agree_on_a_path(spark):
    body = "".join(f"<p>word number {i} of the story goes on and on</p>" for i in range(5))
    other = "<div class=box><p>" + "noise " * 40 + "</p></div>"
    rows = [(i, f"https://h.example/{i}", f"<body><div class='main{i}'>{body}</div></body>") for i in range(6)]
    rows += [(10, "https://h.example/x", f"<body><div class=main>{body}</div>{other * 4}</body>"), (11, None, "<p>alone</p>"), (12, "https://h.example/n", None), (13, "https://e.example/", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string").drop("path")
    got = {r.page_id: r for r in html_extract.extract_main(df).collect()}
    assert "noise" not in got[10].text and got[10].text.count("\n") == 4 and got[11].text == "alone" and got[12].text == "" and got[13].n_chars == 0
    many = html_extract.BROADCAST_HOSTS
    html_extract.BROADCAST_HOSTS = 0
    try:
        assert {r.page_id: r.text for r in html_extract.extract_main(df).collect()} == {i: r.text for i, r in got.items()}
    finally:
        html_extract.BROADCAST_HOSTS = many


def test_articles_stay_whole():
    line = "<p>a line of the story that goes on and on</p>"
    article = f"<article><h1>Title</h1><p>lead</p><div class=body>{line * 8}</div><section><p>rest of it</p></section></article>"
    for page in (f"<body>{article}</body>", f"<body><div class=wrap>{article}</div><div><p>beside</p></div></body>", f"<body>{article.replace('article', 'main')}</body>"):
        for path in (None, html_extract.vote(page)[0], "body/article/div.body", "body/main/div.body"):
            got = html_extract.extract(page, path).split("\n")
            assert got[:2] == ["Title", "lead"] and got[-1] == "rest of it" and len(got) == 11
    table = f"<body><div><p>before</p><table><tr><td>small<td>{line * 8}</table><p>after</p></div></body>"
    assert html_extract.extract(table, html_extract.vote(table)[0]).split("\n")[::9] == ["before", "a line of the story that goes on and on"]
    assert html_extract.extract(table, None).endswith("after")


def test_wrappers_named_after_what_is_left_out():
    story = "".join(f"<p>word number {i} of the story goes on and on</p>" for i in range(8))
    rest = "<div class=left-sidebar><p>aside text</p></div><div class='site-footer'><p>foot</p></div><aside><article>a card</article></aside>"
    for wrapper in ("div class='content has-sidebar'", "div id='page' class='no-comments'", "div class='with-ads'", "div class='sidebar-layout'", "form id=aspnetForm", "div class=search role=search", "section class='header'", "div class='hasSidebar'"):
        tag = wrapper.split()[0]
        for inner in (f"<article>{story}</article>", f"<div class=body>{story}</div>"):
            got = html_extract.extract(f"<body><{wrapper}>{inner}{rest if 'article' in inner else rest.replace('article', 'p')}</{tag}></body>", None).split("\n")
            assert len(got) == 8 and got[0].startswith("word number 0") and got[-1].startswith("word number 7"), wrapper
    assert html_extract.extract(f"<head><body><article>{story}</article>", None).count("goes on") == 8
    assert html_extract.extract(f"<body><article><p>short</p></article><div class=comments>{story}</div><div class='post-comments'>{story}</div><div hidden>{story}</div></body>", None) == "short"
    assert html_extract.vote(f"<body><div class='with-ads'>{story}</div></body>") == ("body/div.with-ads", 1.0)


def test_headings_of_articles():
    story = "".join(f"<p>line {i} of the story goes on</p>" for i in range(6))
    lines = [f"line {i} of the story goes on" for i in range(6)]
    for page, first in {
        f"<article><header><div class=top><div><h1>Deep</h1></div><p>by me</p></div></header>{story}</article>": ["Deep"],
        f"<main><header><hgroup><h1>Deep</h1><h2>Sub</h2></hgroup><nav><h2>Menu</h2></nav></header>{story}</main>": ["Deep", "Sub"],
        f"<header><h1>Site</h1></header><div><h1>Old</h1><h1>Title</h1><article><h2>Part</h2>{story}</article><h1>After</h1></div>": ["Title", "Part"],
        f"<header><h1>Site</h1></header><article>{story}</article>": [],
        f"<div><h1>Beside</h1></div><article><h1>Own</h1>{story}</article>": ["Own"],
    }.items():
        assert html_extract.extract(f"<body>{page}</body>", None).split("\n") == first + lines


def test_long_paths_stay_apart():
    story, other = ("".join(f"<p>{w} {i} of the text goes on</p>" for i in range(6)) for w in ("story", "other"))
    deep = lambda name, text: f"<section class={name}>" + "<div class=a-rather-long-class>" * 30 + text + "</div>" * 30 + "</section>"
    page = f"<body>{deep('one', story)}</body>"
    path = html_extract.vote(page)[0]
    assert len(path) <= html_extract.PATH_CHARS and path != html_extract.vote(page.replace("class=one", "class=two"))[0]
    assert html_extract.extract(f"<body>{deep('one', story)}{deep('two', '<p>short</p>')}</body>", path).count("\n") == 5


def test_pages_equal_a_plain_reading(spark, small):
    """The given pages have one article each, without anything in it that is left out: their texts by the standard library's parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.blocks += [""] * (tag in html_extract.BLOCKS)
            self.blocks[-1] += " " * (tag == "br")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.blocks += [""] * (tag in html_extract.BLOCKS)

        def handle_data(self, data):
            self.blocks[-1] += data if self.inside else ""

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_main(pages).collect()}
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html)
        want = "\n".join(b for b in (" ".join(b.split()) for b in parser.blocks) if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_planted_hosts(spark):
    """Hosts with templates of their own: the text wanted is known from how the pages are made."""
    import random

    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    templates = [
        lambda b, n: f"<div class='layout has-sidebar'><div class='post post-{n}'>{b}</div><div class=sidebar><p>{words(30)}</p></div></div>",
        lambda b, n: f"<form id=aspnetForm><nav>{words(5)}</nav><div id=content{n}>{b}</div><div class=comments><p>{words(60)}</p></div></form>",
        lambda b, n: f"<div class='page-header-fixed comments-open'><header><p>{words(9)}</p></header><main>{b}</main><footer>{words(9)}</footer></div>",
        lambda b, n: f"<table><tr><td class=menu><p>{words(12)}</p><td class=body{n}>{b}</table><div class=cookie-notice><p>{words(20)}</p></div>",
        lambda b, n: f"<div class='entry comments-open'>{b}<aside><p>{words(25)}</p></aside></div><div id=footer-{n}><p>{words(8)}</p></div>",
    ]
    rows, want = [], {}
    for h, template in enumerate(templates):
        for n in range(8):
            blocks, i = [words(rng.randint(15, 40)) for _ in range(rng.randint(4, 9))], len(rows)
            body = template("".join(f"<p>{b.replace(' ', rng.choice([' ', '  ', chr(10)]), 3)} &amp; &#233;</p>" for b in blocks), n)
            rows.append((i, f"http://host{h}.example/{n}", f"<html><body>{body}</body></html>", f"path{n}", 3))
            want[i] = "\n".join(f"{b} & é" for b in blocks)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string, host int")
    assert {r.page_id: r.text for r in html_extract.extract_main(df.unionByName(df.where("page_id = 3"))).collect()} == want
    assert html_extract.extract_main(df.unionByName(df.where("page_id = 3"))).count() == len(rows) + 1
    assert html_extract.extract_main(df.limit(0)).count() == 0
    long = "".join(f"<p>part {i} of a very long page</p>" for i in range(60_000))
    got = html_extract.extract_main(spark.createDataFrame([(1, "http://h.example/", f"<body><div class=x>{long}</div></body>"), (None, None, None)], "page_id long, url string, html string"))
    assert sorted((str(r.page_id), r.text.count("\n"), r.text.endswith("part 59999 of a very long page")) for r in got.collect()) == [("1", 59_999, True), ("None", 0, False)]


def test_two_templates_on_a_host(spark):
    story = "".join(f"<p>word number {i} of the story goes on and on</p>" for i in range(8))
    first = f"<body><div class=main>{story}</div></body>"
    second = f"<body><div class=main><p>{'teaser ' * 12}</p></div><div class=story>{story}</div></body>"
    parts = f"<body><div class=main><p>{'teaser ' * 12}</p></div><div class=one>{story}</div><div class=two>{story.replace('word', 'part')}</div></body>"
    rows = [(i, f"https://h.example/{i}", first) for i in range(5)] + [(10, "https://h.example/a", second), (11, "https://h.example/b", parts)]
    got = {r.page_id: r.text.count("goes on") for r in html_extract.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: 8, 1: 8, 2: 8, 3: 8, 4: 8, 10: 8, 11: 16}


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.a.com/x/", 10, {"ETag": '"1"', "Content-Type": "t", "Date": "d1"}),
        (2, "revisit", "https://a.com/x#f", 20, {"etag": 'W/"1"', "Date": "d2", "Content-Length": "9"}),
        (3, "revisit", "a.com/x?utm_source=q", 90_000, {"ETag": '"2"'}),
        (4, "revisit", "a.com/y", 20, {"ETag": '"1"'}),
        (5, "revisit", "a.com/x", 5, None),
        (6, "revisit", None, 20, {}),
        (7, "revisit", "a.com/x", 200_000, {"Server": "s"}),
        (8, "response", "a.com/x", 190_000, {"Last-Modified": "m"}),
        (9, "revisit", "a.com/x", 300_000, {"last-modified": "m", "Expires": "e"}),
    ]
    df = spark.createDataFrame(rows, "record_id long, warc_type string, target_uri string, s long, headers map<string,string>").withColumn("date", F.timestamp_seconds("s"))
    got = {r.record_id: (r.status, r.response_id, r.headers) for r in warc_revisits.resolve(df).collect()}
    assert got[2] == ("resolved", 1, {"etag": 'W/"1"', "content-type": "t", "date": "d2"})
    assert got[3][:2] == ("validator_mismatch", None) and got[4][0] == got[5][0] == got[6][0] == "no_original" and got[7][0] == "no_validator"
    assert got[9] == ("resolved", 8, {"last-modified": "m", "expires": "e"}) and len(got) == 7
    assert warc_revisits.resolve(df.limit(0)).count() == 0
    more = df.unionByName(df.where("record_id IN (1, 2)")).withColumns({c: F.lit("x") for c in ("url", "hour", "last", "status", "payload")})
    again = [(r.record_id, r.status, r.response_id) for r in warc_revisits.resolve(more).collect()]
    assert sorted(again) == sorted([(i, s, o) for i, (s, o, _) in got.items()] + [(2, "resolved", 1)])


def test_revisits_equal_a_plain_search(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice(["response", "revisit"]), rng.choice(["a.com/x", "http://b.com/", None]), rng.randrange(0, 20) * 1_800, {"ETag": f'"{rng.randrange(2)}"'} if rng.random() < 0.8 else {}) for i in range(150)]
    df = spark.createDataFrame(rows, "record_id long, warc_type string, target_uri string, s long, headers map<string,string>").withColumn("date", F.timestamp_seconds("s"))
    got = {r.record_id: (r.status, r.response_id) for r in warc_revisits.resolve(df).collect()}
    for i, kind, url, at, headers in rows:
        if kind == "revisit":
            before = [r for r in rows if r[1] == "response" and r[2] == url and url and (r[3], r[0]) < (at, i)]
            old = max(before, key=lambda r: (r[3], r[0]), default=None)
            if old is None:
                want = ("no_original", None)
            elif "ETag" not in headers or "ETag" not in old[4]:
                want = ("no_validator", None)
            else:
                want = ("resolved", old[0]) if headers["ETag"] == old[4]["ETag"] else ("validator_mismatch", None)
            assert got[i] == want


def _labelled(spark, path, label):
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    return docs, docs.join(labels, "doc_id").where(labelled.held_out()).select("doc_id", F.col(label).alias("y")), labelled.training_sample(docs, labels, label)


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(spark, kind):
    docs, truth, sample = _labelled(spark, "/root/testdata/sf0.1", kind)
    operator = toxicity if kind == "toxic" else quality_fm
    out = operator.scores(docs, operator.train(sample["text"].tolist(), sample["y"].tolist())).join(truth, "doc_id").toPandas()
    assert out.held_out.all() and out.score.between(0, 1).all()
    ranks = out.score.rank()
    pos, n = int(out.y.sum()), len(out)
    auc = (ranks[out.y == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))
    assert auc > (0.9 if kind == "toxic" else 0.98)
    assert (out.predicted == out.y).mean() > (0.9 if kind == "toxic" else 0.97)


def test_misspellings_share_vectors(spark):
    _, _, sample = _labelled(spark, "/root/testdata/sf0.1", "toxic")
    scorer = toxicity.Scorer(toxicity.train(sample["text"].tolist(), sample["y"].tolist()))
    assert scorer["stupidd"] > 20 + scorer["the"] and scorer["clownn"] > 20 + scorer["of"]


def test_long_words_are_read_to_their_end():
    import random

    rng = random.Random(1)
    run = lambda n, letters="qwertzuiopasdfghjklyxcvbnm": "".join(rng.choice(letters) for _ in range(n))
    for word in (run(65), run(128), run(5_000), "".join(chr(0x4E00 + rng.randrange(5_000)) for _ in range(500)), "=" * 100):
        assert {word[i : i + n] for n in toxicity.LENGTHS for i in range(len(word) - n + 1)} <= {p[i : i + n] for p in toxicity.words_of(word) for n in toxicity.LENGTHS for i in range(len(p) - n + 1)}
    for n in range(62, 68):  # no length at which words are read otherwise
        word = run(n)
        assert toxicity.words_of(word) == [word] and toxicity.words_of(f"({word}_idiot)") == [f"{word}_idiot", word, "idiot"]
    assert {"idiot", "sh*t"} <= set(toxicity.words_of(run(100) + "_idiot." + run(70) + "/sh*t"))
    weights = [0.0] * toxicity.BUCKETS
    for g in toxicity.grams_of("idiot"):
        weights[g] = 50.0
    scorer = toxicity.Scorer({"weights": toxicity.np.array(weights), "bias": -1.0})
    clean, toxic = run(100, "xyz"), run(100, "xyz") + "idiot" + run(300, "xyz")
    assert scorer.score(toxic) > scorer.score(clean) + 0.05 and scorer.score(clean + "_idiot") > 0.9
    texts = [run(100) + ("_idiot" if i % 2 else "_table") for i in range(80)]
    scorer = toxicity.Scorer(toxicity.train(texts, [i % 2 for i in range(80)]))
    assert scorer.score(run(100) + "_idiot") > 0.5 > scorer.score(run(100) + "_table")


@pytest.mark.parametrize("operator", [toxicity, quality_fm])
def test_scores_of_odd_rows(spark, operator):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (3, "z " * 50_000, "a"), (3, "z " * 50_000, "a")], "doc_id long, text string, score string")
    rows = operator.scores(df, operator.train(["a b", "c d"], [0, 0])).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert operator.scores(df.limit(0), operator.train([], [])).count() == 0


def test_sample_of_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(7, "other text 7"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(7, 1), (8, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    import zlib

    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 and i != 8]
    want = sorted([(f"text {i}", i % 2) for i in free] + [("other text 7", 1)] * (7 in free))
    assert sorted((r.text, r.y) for r in labelled.sample_rows(docs, labels, "toxic").collect()) == want
    assert labelled.sample_rows(docs, labels, "toxic", 10).count() == 10 and labelled.sample_rows(docs.limit(0), labels, "toxic").count() == 0


def test_toxicity_scores_by_hand():
    """Scores, and the gradient that training follows, against their definitions word by word."""
    import zlib

    import numpy as np

    rng = np.random.default_rng(1)
    model = {"weights": rng.normal(size=toxicity.BUCKETS), "bias": -0.4}
    scorer = toxicity.Scorer(model)
    for text in ("One two two, THREE (two) one!", "é€ x" * 30, "a", "", "  \n ", "word " * 500 + "other"):
        logits = []
        for word in {w.strip(toxicity.EDGES) for w in text.lower().split()}:
            grams = {f"<{word}>"[i : i + n] for n in (3, 5) for i in range(len(word) + 3 - n)} | {"\0" + word}
            logits.append(sum(model["weights"][zlib.crc32(g.encode()) % toxicity.BUCKETS] for g in grams) / len(grams))
        logit = model["bias"] + (sum(logits) / len(logits) if logits else 0)
        assert abs(scorer.score(text) - 1 / (1 + np.exp(-logit))) < 1e-9
    grams = toxicity._Grams(["ab", "abc", "zz"])
    batch = toxicity._Batch([np.array([0, 1]), np.array([2])], grams, np.ones(toxicity.BUCKETS, bool))
    table, pull = rng.normal(size=(toxicity.BUCKETS + 1, toxicity.WIDTH)), rng.normal(size=(2, toxicity.WIDTH))
    table[-1] = 0
    got = batch.backward(pull)
    for row in (0, len(batch.rows) // 2):
        moved = table.copy()
        moved[batch.rows[row], 2] += 1e-4
        slope = ((batch.forward(moved) - batch.forward(table)) * pull).sum() / 1e-4
        assert abs(slope - got[row, 2]) < 1e-4


def test_quality_features_by_hand():
    import math
    import zlib

    import numpy as np

    def step(x):
        return min(quality_fm.STEPS - 1, max(0, int(x * quality_fm.STEPS)))

    for text in ("", "One two  two\nTHREE, 4!", "é é é\né é é", "x" * 300 + " 12345 67", "\n\n a. b. c."):
        words, raw, lines = text.split(), text.encode(), text.split("\n")
        m, k = max(1, len(raw)), len(words)
        count = lambda ok: sum(map(ok, raw))
        capitals, digits = count(lambda b: 65 <= b <= 90), count(lambda b: 48 <= b <= 57)
        letters, spaces = capitals + count(lambda b: 97 <= b <= 122 or b >= 128), count(lambda b: b in b" \t\n\r")
        want = [
            math.log1p(k) / math.log1p(50_000), len(set(words)) / max(1, k), letters / m, capitals / m, 10 * digits / m, 2 * spaces / m, (m - letters - digits - spaces) / m, len(text) / max(1, k) / 24,
            math.log1p(k / len(lines)) / math.log1p(2000), len(set(lines)) / len(lines), sum(not w[-1].isalnum() for w in words) / max(1, k), 4 * sum(a == b for a, b in zip(words, words[1:])) / max(1, k), math.log1p(len(text)) / math.log1p(1_000_000),
        ]
        index, value = quality_fm.features(text, quality_fm.Buckets())
        hashed = sorted({zlib.crc32(w.encode()) % quality_fm.WORD_BUCKETS for w in words})
        assert index.tolist() == hashed + [quality_fm.WORD_BUCKETS + i * quality_fm.STEPS + step(x) for i, x in enumerate(want)]
        assert np.allclose(value, [1 / math.sqrt(max(1, len(hashed)))] * len(hashed) + [0.5] * len(want))


def test_linear_time_identity():
    import numpy as np

    rng = np.random.default_rng(0)
    model = {"bias": 0.3, "linear": rng.normal(size=quality_fm.FEATURES), "factors": rng.normal(size=(quality_fm.FEATURES, 4))}
    i, v = np.array([3, 9, 70, 500]), np.array([0.5, 1.0, 2.0, 0.1])
    pairs = sum(model["factors"][i[a]] @ model["factors"][i[b]] * v[a] * v[b] for a in range(4) for b in range(a))
    assert abs(quality_fm.raw_score(model, i, v) - (0.3 + model["linear"][i] @ v + pairs)) < 1e-9


LINE = "<p>This is a line of the story that goes on and on for a while, with some words in it.</p>"


def test_names_within_articles_raise_doubt_only():
    plain = "This is a line of the story that goes on and on for a while, with some words in it."
    story, five = LINE * 5, "\n".join([plain] * 5)
    for inner in (f"<form id=aspnetForm>{story}</form>", f"<div class='form-content'>{story}</div>", f"<div class=banner>{story}</div>"):
        for tag in ("main", "article"):
            assert html_extract.extract(f"<body><nav><a href=x>menu</a></nav><{tag}><h1>Title</h1>{inner}</{tag}></body>", None) == f"Title\n{five}"
    sections = "".join(f"<section {name}>{story}</section>" for name in ("id='search-algorithms'", "id='legal-history'", "class='side-effects'"))
    boxes = "<div class='related-posts'><a href=x>one more story to read on this very site, with many words in its title</a></div><div id=share-this>Share this</div>"
    assert html_extract.extract(f"<body><article><h1>T</h1>{sections}{boxes}</article></body>", None) == "\n".join(["T", five, five, five])
    gone = f"<div STYLE='Display : NONE'>{LINE}</div><p aria-hidden=TRUE>hidden</p><div class=user-feedback>{LINE}</div><section class=discussion>{LINE * 2}</section><div id=comments>{LINE * 3}</div><form>{LINE}</form>"
    assert html_extract.extract(f"<body><article><h1>T</h1>{story}{gone}</article></body>", None) == f"T\n{five}"
    assert html_extract.extract(f"<body><div class=ad>{LINE}</div><article><h1>T</h1><p>short</p></article></body>", None) == "T\nshort"


def test_doubtful_elements_that_repeat_on_a_host(spark):
    notice = "<div class='legal-notes'><p>All that stands here may be read by all who come by, and by others, at any time of day.</p></div>"
    page = lambda i: f"<body><article><h1>T{i}</h1>{LINE * 4}<div class='search-history'><p>{' '.join(f'w{i}x{k}' for k in range(20))}</p></div>{notice}</article></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(6)] + [(9, "http://b.example/", page(9))]
    got = {r.page_id: r.text for r in html_extract.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("All that stands" not in got[i] and f"w{i}x19" in got[i] for i in range(6))
    assert "All that stands" in got[9] and "w9x19" in got[9]


@pytest.mark.parametrize("piece", ["<b>x", "<div>x", "<span>x", "<b class=ad>x", "<li></li>", "<a href=x>y", "<i><p>", "</div>", "<td>q", "<div><i class=ad>", "<form>x"])
def test_nesting_costs_a_step_for_each_tag(piece):
    import sys

    def steps(n):
        count = 0

        def seen(frame, event, _):
            nonlocal count
            count += event == "line"
            return seen

        sys.settrace(seen)
        try:
            html_extract.extract(piece * n, None)
        finally:
            sys.settrace(None)
        return count

    assert steps(2000) < 2.2 * steps(1000)
