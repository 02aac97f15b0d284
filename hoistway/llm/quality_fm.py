"""Quality by a factorisation machine.

A text's features are its distinct hashed words (each with value 1/sqrt(how many)), structure statistics (lengths, repetition, capitals, digits,
signs, lines) and metadata (its length class), the last two cut into steps and one-hot. The machine adds a bias, a weight for each feature and
the inner products of the features' factors for all pairs, scored in linear time as half of (square of the sum - sum of the squares). It is
trained in numpy by Adagrad on the log loss over small batches.

Defined results: null and empty texts have the structure of an empty text and no words. Any length of text is scored whole. Rows that repeat
give repeated scores. Without labelled rows of both classes the score is constant.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import built, map_columns, text_or_empty
from .labelled import held_out

#: Production parameters: buckets of words, factors, passes, texts of a batch, first step, decay of words' factors; steps of a statistic.
WORD_BUCKETS, FACTORS, PASSES, BATCH, STEP, DECAY, STEPS = 1 << 16, 6, 12, 64, 0.1, 1e-3, 12
KEPT_WORDS = 400_000
STATISTICS = ("words", "distinct share", "letters share", "capitals share", "digits share", "spaces share", "signs share", "mean word", "words a line", "distinct lines share", "ends with sign share", "repeats of the last word share", "length class")
FEATURES = WORD_BUCKETS + len(STATISTICS) * STEPS


def _step(share: float) -> int:
    return min(STEPS - 1, max(0, int(share * STEPS)))


def structure(text: str, words: list[str], distinct: int) -> list[int]:
    """One feature of each statistic."""
    n, k = len(text), len(words)
    sample = text.encode("utf-8", "surrogatepass")
    m = max(1, len(sample))
    counts = np.bincount(np.frombuffer(sample, "u1"), minlength=256)
    capitals, digits, spaces = int(counts[65:91].sum()), int(counts[48:58].sum()), int(counts[[9, 10, 13, 32]].sum())
    letters = int(counts[97:123].sum()) + capitals + int(counts[128:].sum())
    lines = text.split("\n")
    log = lambda x, top: _step(np.log1p(x) / np.log1p(top))
    values = [
        log(k, 50_000),
        _step(distinct / max(1, k)),
        _step(letters / m),
        _step(capitals / m),
        _step(10 * digits / m),
        _step(2 * spaces / m),
        _step((m - letters - digits - spaces) / m),
        _step(n / max(1, k) / 24),
        log(k / len(lines), 2000),
        _step(len(set(lines)) / len(lines)),
        _step(sum(not w[-1].isalnum() for w in words) / max(1, k)),
        _step(4 * sum(map(str.__eq__, words, words[1:])) / max(1, k)),
        log(n, 1_000_000),
    ]
    return [WORD_BUCKETS + i * STEPS + v for i, v in enumerate(values)]


class Buckets(dict):
    """Hashed buckets of the words met so far."""

    def __missing__(self, word: str) -> int:
        out = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


def features(text: str, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values."""
    words = text.split()
    distinct = set(words)
    hashed = np.unique(np.fromiter(map(buckets.__getitem__, distinct), dtype="i8", count=len(distinct)))
    own = structure(text, words, len(distinct))
    return np.concatenate([hashed, own]), np.concatenate([np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed)))), np.full(len(own), 0.5)])


def raw_score(model: dict, index: np.ndarray, value: np.ndarray) -> float:
    """Bias, linear part and pairs by the sum-of-squares identity: linear in the number of features."""
    scaled = model["factors"][index] * value[:, None]
    sums = scaled.sum(axis=0)
    return float(model["bias"] + model["linear"][index] @ value + 0.5 * (sums @ sums - (scaled * scaled).sum()))


def train(texts: list[str], y: list[int], seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    y = np.asarray(y, dtype="f8")
    linear, factors = np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS))
    if not len(y) or y.min() == y.max():
        return {"bias": 4.0 if len(y) and y.max() > 0 else -4.0, "linear": linear, "factors": factors * 0}
    buckets, bias = Buckets(), float(np.log(y.mean() / (1 - y.mean())))
    rows = [features(t, buckets) for t in texts]
    s_bias, s_linear, s_factors = 1e-6, np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6)
    for at in range(PASSES):
        step = STEP * (1 - at / PASSES)
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            chosen = order[lo : lo + BATCH]
            index = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            text_of = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            starts = np.flatnonzero(np.diff(text_of, prepend=-1))
            scaled = factors[index] * value[:, None]
            sums = np.add.reduceat(scaled, starts, axis=0)
            raw = bias + np.add.reduceat(linear[index] * value, starts) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((scaled**2).sum(axis=1), starts))
            err = (1 / (1 + np.exp(-np.clip(raw, -60, 60))) - y[chosen]) / len(chosen)
            used, inverse = np.unique(index, return_inverse=True)
            pull = err[text_of] * value
            g_linear = np.bincount(inverse, pull, len(used)) + DECAY / len(rows) * linear[used]
            g = pull[:, None] * (sums[text_of] - scaled)
            g_factors = np.stack([np.bincount(inverse, g[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * factors[used] / BATCH
            s_bias += err.sum() ** 2
            s_linear[used] += g_linear**2
            s_factors[used] += g_factors**2
            bias -= step * err.sum() / np.sqrt(s_bias)
            linear[used] -= step * g_linear / np.sqrt(s_linear[used])
            factors[used] -= 0.3 * step * g_factors / np.sqrt(s_factors[used])
    return {"bias": bias, "linear": linear, "factors": factors}


def scores(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, held_out, score, predicted. The model's size is set by its parameters, not by the corpus."""
    sent = df.sparkSession.sparkContext.broadcast({"bias": model["bias"], "linear": model["linear"].astype("f4"), "factors": model["factors"].astype("f4")})
    key = uuid.uuid4().hex

    def run(ids, held, texts):
        model, buckets = built("quality", key, lambda: (sent.value, Buckets()))
        s = [float(1 / (1 + np.exp(-np.clip(raw_score(model, *features(t, buckets)), -60, 60)))) for t in texts.to_pylist()]
        return {id_col: ids, "held_out": held, "score": s, "predicted": [int(x >= threshold) for x in s]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, held_out(id_col).alias("h"), text_or_empty(text_col).alias("t")), run, f"{id_col} {kind}, held_out boolean, score double, predicted int", 1000, "quality")
