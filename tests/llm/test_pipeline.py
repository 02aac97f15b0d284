"""The pipeline's stages against plain Python over the rows that each stage reads."""

import sys
from pathlib import Path

from oracle_llm import components, edit_distance_within

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_stages(spark, small):
    import corpus_pipeline as p
    from hoistway.llm import labelled, toxicity
    from hoistway.llm.common import stored, table

    docs, seen = table(spark, small, "documents"), {}
    for name, stage in p.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, small), name)
        seen[name] = before, {r.doc_id: r for r in docs.collect()}
    for name, (before, after) in list(seen.items())[:-1]:
        assert set(after) <= set(before) and all(r.asDict().keys() == set(p.COLUMNS) for r in after.values())
    before, after = seen["toxicity"]
    sample = labelled.training_sample(table(spark, small, "documents"), table(spark, small, "labels"), "toxic")
    scorer = toxicity.Scorer(toxicity.train(sample["text"].tolist(), sample["y"].tolist()))
    assert set(after) == {i for i in before if scorer.score(before[i] or "") < 0.5} and 0 < len(after) < len(before)
    before, after = seen["line_dedup"]
    first = {}
    for i in sorted(before):
        lines = before[i].split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            at = first.setdefault(tuple(lines[k : k + 3]), (i, k))
            if at != (i, k):
                gone |= set(range(max(k, at[1] + 3) if at[0] == i else k, k + 3))
        left = [x for k, x in enumerate(lines) if k not in gone]
        assert (i in after) == bool(left) and (not left or after[i].text == "\n".join(left))
    before, after = seen["ngram_jaccard"]
    assert set(after) == {i for i, (_, c) in components(before).items() if c == i}
    before, after = seen["decontaminate"]
    items = [" ".join(r.text.lower().split()) for r in table(spark, small, "benchmark").collect()]
    texts = {i: " ".join(t.lower().split()) for i, t in before.items()}
    for i, t in texts.items():  # exact passages, and by edit distance where a third of an item's words stand in the text
        held = set(t.split())
        near = [x for x in items if 3 * len(set(x.split()) & held) >= len(set(x.split()))]
        leak = any(x in t for x in items) or any(edit_distance_within(x, t) <= len(x) // 10 for x in near)
        assert (i not in after) == leak, i
    before, after = seen["bpe"]
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(after[i].tokens == library.encode(before[i], add_special_tokens=False).ids for i in before)


def test_stages_on_odd_rows(spark, small, tmp_path):
    """Null and repeated ids, null and empty texts, columns of other types than the table's: every stage keeps what it should."""
    import corpus_pipeline as p
    from hoistway.llm.common import stored, table

    words = lambda a, n=60: " ".join(f"{a}{i}" for i in range(n))
    item = table(spark, small, "benchmark").where("text IS NOT NULL").first().text
    rows = [(1, words("a")), (1, words("b")), (2, words("a") + " end"), (None, words("b") + " end"), (None, words("c")), (3, None), (4, ""), (5, words("d") + " " + item), (6, words("e")), (6, words("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    for name, stage in p.STAGES[1:]:
        docs = stored(stage(spark, docs, small), name)
        assert stage(spark, docs.limit(0), small).count() == 0 if name != "bpe" else True
    got = sorted((str(r.doc_id), r.n_tokens > 0) for r in docs.collect())
    assert got == [("1", True), ("1", True), ("3", False), ("4", False), ("6", True), ("6", True), ("None", True)]


def test_run_leaves_only_its_last_table(spark, small, tmp_path, monkeypatch):
    import corpus_pipeline as p
    from hoistway.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    out = p.run(spark, small)
    left = sorted(x.name.split("-")[1] for x in tmp_path.iterdir())
    assert left == ["decontaminate"] and out.count() > 0 and out.columns == ["doc_id", "lang", "source", "n_tokens", "tokens"]
