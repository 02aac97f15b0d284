import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from hoistway.llm import bpe_automaton as bpe
from hoistway.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a<|endoftext|> b<|endoftext|>", "\x1c\x1d a\x85b  c\xa0\xa0d", "   \n\n  x  ", "'s 'S don't", "a" * 3000, " " * 1001 + "x", "日本語 テスト 😀😀 ﷺ", "\x00\x01\x7f", "٣٤ ½ ²", "end. \n", "a,b .c ,d"]


def texts(n=400):
    rng = random.Random(1)
    letters = "the and of ing tion aeiou ' \n\t0123!?é😀.,"
    wide = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1500), rng.randrange(0x2000, 0x3100), rng.randrange(0, 40)]))
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)] + ["".join(wide() for _ in range(rng.randint(1, 40))) for _ in range(n)] + ["".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def automaton():
    return bpe.MergeAutomaton(bpe.read_merges(PATH))


def ids(a, text):
    out = a.encode(text)
    return [int.from_bytes(out[i : i + 4], "little") for i in range(0, len(out), 4)]


def test_encoding_and_decoding_equal_the_library(automaton):
    library = Tokenizer.from_file(PATH)
    for text, want in zip(texts(), library.encode_batch(texts(), add_special_tokens=False)):
        got = ids(automaton, text)
        assert got == want.ids
        assert automaton.decode(got) == library.decode(got, skip_special_tokens=False)
    rng = random.Random(2)
    for _ in range(200):
        some = [rng.randrange(50257) for _ in range(12)]
        assert automaton.decode(some) == library.decode(some, skip_special_tokens=False)


def test_automaton_on_small_merges():
    """All byte strings over two letters, against merging by rank."""
    spec = {"labels": [b"a", b"b", b"aa", b"ab", b"aab", b"bb", b"aaaa"], "merges": [(0, 0, 2), (0, 1, 3), (2, 1, 4), (1, 1, 5), (2, 2, 6)], "special": {}}
    a, rank = bpe.MergeAutomaton(spec), {(x, y): (n, z) for n, (x, y, z) in enumerate(spec["merges"])}
    for size in range(1, 9):
        for bits in range(2**size):
            word = bytes(97 + (bits >> i & 1) for i in range(size))
            tokens = [c - 97 for c in word]
            while pairs := [(rank[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in rank]:
                _, i = min(pairs)
                tokens[i : i + 2] = [rank[tokens[i], tokens[i + 1]][1]]
            assert a.path(word) == tokens


def test_dataframe_round_trip(spark):
    df = spark.createDataFrame([(1, "Hello  world"), (2, None), (3, ""), (3, ""), (4, "x" * 20000 + " é")], "doc_id long, text string")
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    assert back == {(1, "Hello  world"), (2, ""), (3, ""), (4, "x" * 20000 + " é")}
    assert bpe.digests(df.where("doc_id > 9"), PATH).count() == 0


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_equal_the_library(fallback):
    vocab = list(dict(tc.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))).items())
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=fallback))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    counter, some = tc.UnigramCounter(vocab, fallback), [t for t in texts() if "<|" not in t]
    assert [counter.total(t) for t in some] == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_counts_follow_ties():
    rng = random.Random(5)
    for _ in range(20):
        vocab = [("<unk>", 0.0)] + list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 4)) for _ in range(30)}.items())
        library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
        library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
        some = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 30))) for _ in range(200)]
        counter = tc.UnigramCounter(vocab, False)
        assert [counter.total(t) for t in some] == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_count_rows(spark):
    vocab = tc.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(tuple(r) for r in tc.token_counts(spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "a b", "t"), (3, "a b", "t")], "doc_id long, text string, t string"), vocab).collect())
    assert got[:2] == [(1, 0), (2, 0)] and got[2] == got[3] == (3, 2)
