"""Toxicity by subword-bag embeddings.

A word's vector is the mean of the vectors of its character n-grams (3 and 5, with marks for its start and end) and of itself, all in
one hashed table; a text's vector is the mean over its words; a linear softmax gives the two classes. Table and softmax are trained jointly
in numpy by Adagrad over small batches. Unseen misspellings share most n-gram vectors with the words they
come from.

At scoring, softmax weights times table are one number for each bucket, as everything up to the softmax is linear; a word's number
is kept by each Python worker. Only the model (one float for each bucket) is broadcast.

Defined results: null, empty and wordless texts get the score of the bias alone. Any length of text is scored whole: a word that signs
join of several counts as a whole and by its parts, whatever its length, and a text without spaces is one word with all its n-grams. Rows that repeat
give repeated scores. If all labelled rows have one class, or there are none, the logit is 4 for the class met and -4 for none, that is a score of
0.982 or 0.018 for every text.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import built, map_columns, text_or_empty
from .labelled import held_out

#: Production parameters: hashed rows, width, n-gram lengths, texts in which a trained row occurs at least, passes, texts of a batch, first step.
BUCKETS, WIDTH, LENGTHS, MIN_TEXTS, PASSES, BATCH, STEP = 1 << 18, 8, (3, 5), 5, 12, 64, 0.8
KEPT_WORDS = 300_000
#: Signs cut from both ends of a word.
EDGES = ".,;:!?\"'()[]{}|%&$#*-_"


#: Longest word whose number a worker keeps, and the signs that join words (not those that stand for letters, as in sh*t).
LONG, JOINTS = 64, re.compile(r"[_.,;:/\\|<>=\"'()\[\]{}&?#+~^`\u2010-\u2027\u3001\u3002\u3008-\u3011\uff01\uff0c\uff0e\uff1a\uff1b\uff1f-]+")


def words_of(text: str) -> list[str]:
    """The distinct words between white space in lower case, without the signs at their ends, each followed by its parts between joining signs, if it has any."""
    out = {}
    for word in dict.fromkeys(x.strip(EDGES) for x in dict.fromkeys(text.lower().split())):
        out[word] = None
        if not word.isalnum():
            parts = [x for x in JOINTS.split(word) if x]
            if len(parts) > 1:
                out.update(dict.fromkeys(parts))
    return list(out)


def grams_of(word: str) -> list[int]:
    """Buckets of a word's n-grams and of the word itself."""
    marked = f"<{word}>"
    out = {marked[i : i + n] for n in LENGTHS for i in range(len(marked) - n + 1)}
    out.add("\0" + word)
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in sorted(out)]


class _Grams:
    """Rows of the table for each word, one after another: words are numbers, so that a sample takes little of the driver's memory."""

    def __init__(self, words: list[str]) -> None:
        flat, ends = array("i"), array("q", [0])
        for w in words:
            flat.extend(grams_of(w))
            ends.append(len(flat))
        self.flat, self.ends = np.frombuffer(flat, "i4"), np.frombuffer(ends, "i8")

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows one after another, how many each word has)."""
        counts = self.ends[words + 1] - self.ends[words]
        at = np.repeat(self.ends[words] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return self.flat[at], counts


class _Batch:
    """Index arrays of some texts: texts to distinct words, words to the table's rows, and back."""

    def __init__(self, texts: list[np.ndarray], grams: _Grams, kept: np.ndarray) -> None:
        sizes = [len(ids) for ids in texts]
        used, words = np.unique(np.concatenate(texts), return_inverse=True)
        self.n, self.words = len(texts), words.astype("i4")
        self.docs = np.repeat(np.arange(self.n, dtype="i4"), sizes)
        self.share = np.repeat([1 / n for n in sizes], sizes).astype("f4")[:, None]
        self.doc_starts = np.cumsum([0, *sizes[:-1]])
        rows, counts = grams.of(used)
        self.per = counts.astype("f4")[:, None]
        word_of = np.repeat(np.arange(len(used), dtype="i4"), counts)
        rows, word_of = rows[kept[rows]], word_of[kept[rows]]
        rows, word_of = np.append(rows, np.full(len(used), BUCKETS, "i4")), np.append(word_of, np.arange(len(used), dtype="i4"))  # the last row stays zero, so that each word has one
        order = np.argsort(word_of, kind="stable")
        rows, word_of = rows[order], word_of[order]
        self.starts = np.flatnonzero(np.diff(word_of, prepend=-1)).astype("i4")
        self.rows, flat = np.unique(rows, return_inverse=True)
        self.flat = flat.astype("i4")
        order = np.argsort(self.words, kind="stable")
        self.by_word, self.word_starts = order.astype("i4"), np.searchsorted(self.words[order], np.arange(len(used)))
        order = np.argsort(self.flat, kind="stable")
        self.word_of_row, self.row_starts = word_of[order], np.searchsorted(self.flat[order], np.arange(len(self.rows)))

    def forward(self, table: np.ndarray) -> np.ndarray:
        word_vec = np.add.reduceat(table[self.rows][self.flat], self.starts, axis=0) / self.per
        return np.add.reduceat(word_vec[self.words] * self.share, self.doc_starts, axis=0)

    def backward(self, d_doc: np.ndarray) -> np.ndarray:
        """The gradient of the table's rows that these texts use."""
        d_word = np.add.reduceat((d_doc[self.docs] * self.share)[self.by_word], self.word_starts, axis=0) / self.per
        return np.add.reduceat(d_word[self.word_of_row], self.row_starts, axis=0)


def train(texts: list[str], y: list[int], seed: int = 7) -> dict:
    """{weights: one logit contribution for each bucket, bias}: the trained table folded into the trained softmax."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y, dtype="int64")
    if not len(y) or y.min() == y.max():
        return {"weights": np.zeros(BUCKETS, "f4"), "bias": -4.0 if not len(y) or y.max() == 0 else 4.0}
    vocab: dict[str, int] = {}
    found = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], "i4") for t in texts]
    grams = _Grams(list(vocab))
    vocab.clear()
    texts_with = np.zeros(BUCKETS, "i4")
    for ids in found:
        texts_with[np.unique(grams.of(ids)[0])] += 1
    kept = texts_with >= MIN_TEXTS
    order = [i for i in rng.permutation(len(y)) if len(found[i])]
    cuts = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    batches = [(_Batch([found[i] for i in c], grams, kept), np.eye(2, dtype="f4")[y[c]]) for c in cuts]
    del grams, found
    table = rng.normal(0, 0.05, (BUCKETS + 1, WIDTH)).astype("f4")
    table[:-1][~kept] = table[-1] = 0
    soft = rng.normal(0, 0.5, (WIDTH, 2)).astype("f4")
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype("f4")
    params, squares = [table, soft, bias], [np.full(p.shape, 1e-8, "f4") for p in (table, soft, bias)]
    for at in range(PASSES):
        step = STEP * (1 - at / PASSES)
        for b in rng.permutation(len(batches)):
            batch, target = batches[b]
            doc_vec = batch.forward(table)
            logits = doc_vec @ soft * SCALE + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            err = (p - target) / len(target)
            grads = [batch.backward(err @ soft.T * SCALE), doc_vec.T @ err * SCALE, err.sum(axis=0)]
            for q, s, g, rows in zip(params, squares, grads, (batch.rows, slice(None), slice(None))):
                s[rows] += g * g
                q[rows] -= step * (0.2 if q is not table else 1) * g / np.sqrt(s[rows])
            table[-1] = 0
    prior = np.log(y.mean() / (1 - y.mean()))
    return {"weights": table[:-1] @ (soft[:, 1] - soft[:, 0]) * SCALE, "bias": float(bias[1] - bias[0] - prior)}


#: The mean over hundreds of words is short; the softmax reads it times this constant.
SCALE = 20.0


class Scorer(dict):
    """Logits of the words met so far."""

    def __init__(self, model: dict) -> None:
        super().__init__()
        self.weights, self.bias = model["weights"].tolist(), model["bias"]

    def __missing__(self, word: str) -> float:
        grams, weights = grams_of(word), self.weights
        out = sum([weights[g] for g in grams]) / len(grams)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= LONG:
            self[word] = out
        return out

    def score(self, text: str) -> float:
        words = words_of(text)
        logit = self.bias + (sum(map(self.__getitem__, words)) / len(words) if words else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def scores(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id_col, held_out, score, predicted."""
    sent, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(ids, held, texts):
        scorer = built("toxicity", key, lambda: Scorer(sent.value))
        s = [scorer.score(t) for t in texts.to_pylist()]
        return {id_col: ids, "held_out": held, "score": s, "predicted": [int(x >= threshold) for x in s]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, held_out(id_col).alias("h"), text_or_empty(text_col).alias("t")), run, f"{id_col} {kind}, held_out boolean, score double, predicted int", 1000, "toxicity")


def keep_below(df: DataFrame, model: dict, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns."""
    sent, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def below(texts: pd.Series) -> pd.Series:
        scorer = built("toxicity", key, lambda: Scorer(sent.value))
        return pd.Series([scorer.score(t) < threshold for t in texts])

    return df.where(F.pandas_udf(below, "boolean")(text_or_empty(text_col)))
