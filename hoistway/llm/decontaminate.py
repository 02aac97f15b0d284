"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case with white space runs as one space. An item of m characters may occur in a document with at most k edits (its budget,
a share of m). Such an occurrence shares at least m + 1 - q(k + 1) q-grams with the item, all on diagonals (document position less item position) of a
band k + 1 wide; half-overlapping bands of twice that width hold every such set. Bands that reach the bound are first held to the lemma's sharper bound for short
q-grams (of the item's FINE-grams, how many stand anywhere in the band's stretch of text), which ends what shares a common opening alone. The rest are
verified by alignments limited to the bands' diagonals, all candidates of a batch at once, which gives the distance and the place. Short items have a
smaller q, so that the budget is the same share at every length.

The benchmark is read in blocks of bounded size; each block's q-gram table is broadcast and documents are scanned in batches, so nothing shuffles. What the
q-grams met lead to is worked through in pieces of at most ENTRIES (parted by text, then by item, then by place), so memory stays bounded however many items
share a q-gram.

Defined results: null and empty texts match nothing; items that are null or empty are ignored; items without an edit and shorter than Q are matched as plain
substrings; clean() drops a document by such a short item only where it stands at word boundaries, as leaks() reports
it inside words too. clean() uses items without an id as well. Repeated rows of either table give repeated rows; only the columns asked for are read, so others
can't clash. Places are positions in the compared form of the text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import built, map_columns, stored, text_or_empty

#: Production parameters: longest q-grams, edits allowed as a share of the item's length, characters of the items of a broadcast block.
Q, BUDGET, BLOCK_CHARS = 8, 0.1, 1_000_000
#: Length of the second filter's q-grams, characters of text that share its look-up, q-gram entries and alignments worked on at a time.
FINE, STRETCH, ENTRIES, ALIGNED = 4, 128, 1 << 20, 512
#: Blocks that one scan of clean() looks for, so that a task holds no more tables.
TOGETHER = 4
#: Odd multiplier of the rolling code; bits of the first filter's index and of the second's.
STEP, FILTER_BITS, FINE_BITS = np.uint64(0x9E3779B97F4A7C15), 22, 16


def compared(text: str) -> str:
    return " ".join(text.lower().split())


def budget(m: int) -> int:
    """Edits allowed for an item of m characters."""
    return int(BUDGET * m)


def gram_length(m: int) -> int:
    """The q of an item of m characters: the lemma's bound is at least 1."""
    return max(1, min(Q, m // (budget(m) + 1)))


def codes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code for each q-gram of code points, by doubling; two overlapping halves make lengths that are no power of 2."""
    h, power, width = points.astype("u8") + np.uint64(1), STEP, 1
    with np.errstate(over="ignore"):
        while 2 * width <= q:
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2
        if width < q:
            h = h[: len(h) - (q - width)] * power + h[q - width :]
        return h * STEP


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range after another."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def top_bits(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype("i8")


class Grams:
    """The table of the q-grams of some items, all with the same q."""

    def __init__(self, q: int, which: list[int], points: list[np.ndarray]) -> None:
        self.q, self.which, self.points = q, np.array(which), points
        self.lengths = np.array([len(p) for p in points], "i8")
        self.edits = np.array([budget(len(p)) for p in points], "i8")
        self.need = self.lengths + 1 - q * (self.edits + 1)
        grams = [codes(p, q) for p in points]
        all_codes = np.concatenate(grams)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(all_codes, kind="stable")
        self.codes, run = np.unique(all_codes[order], return_inverse=True)
        self.at = at[order]
        self.entry_of = run * len(points) + item[order]  # sorted: by q-gram, then by item
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[top_bits(self.codes, FILTER_BITS)] = True
        self.fine_need = self.lengths + 1 - FINE * (self.edits + 1)
        self.fine_counts = np.maximum(0, self.lengths - FINE + 1)
        self.fine_starts = np.cumsum(self.fine_counts) - self.fine_counts
        self.fine = np.concatenate([top_bits(codes(p, FINE), FINE_BITS) if len(p) >= FINE else np.zeros(0, "i8") for p in points])
        self.flat = np.concatenate(points)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose q-gram is in the table, and its number there."""
        found = codes(points, self.q) if len(points) >= self.q else np.zeros(0, "u8")
        place = np.flatnonzero(self.filter[top_bits(found, FILTER_BITS)])
        gram = np.minimum(np.searchsorted(self.codes, found[place]), len(self.codes) - 1)
        real = self.codes[gram] == found[place]
        return place[real], gram[real]

    def bands(self, place: np.ndarray, gram: np.ndarray, starts: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, band) of the double bands that reach the bound, for items lo to hi, in pieces. starts: where each text starts."""
        n = len(self.points)
        first, last = (np.searchsorted(self.entry_of, gram * n + x) for x in (lo, hi))
        counts = last - first
        total = int(counts.sum())
        if not total:
            return
        text = np.searchsorted(starts, place, side="right") - 1
        if total > ENTRIES and text[0] != text[-1]:
            cut = int(np.searchsorted(np.cumsum(counts), total // 2))
            cut = np.searchsorted(text, text[cut] if text[cut] != text[0] else text[0] + 1)
            yield from self.bands(place[:cut], gram[:cut], starts, lo, hi)
            yield from self.bands(place[cut:], gram[cut:], starts, lo, hi)
            return
        if total > ENTRIES and hi - lo > 1:
            yield from self.bands(place, gram, starts, lo, (lo + hi) // 2)
            yield from self.bands(place, gram, starts, (lo + hi) // 2, hi)
            return
        longest, span = int(self.lengths.max()), int(starts[-1]) + 2 * int(self.lengths.max()) + 3
        parts, upto = [], np.cumsum(counts)
        for at in range(0, total, ENTRIES):
            some = slice(np.searchsorted(upto, at, side="right"), np.searchsorted(upto, min(total, at + ENTRIES), side="left") + 1)
            entry = ranges(first[some], counts[some])
            t, p = np.repeat(text[some], counts[some]), np.repeat(place[some], counts[some])
            item = self.entry_of[entry] % n
            band = np.floor_divide(p - self.at[entry] - starts[t], self.edits[item] + 1) + longest + 1
            parts.append(np.unique(((t * n + item) * span + band) * longest + self.at[entry]))  # a q-gram of the item counts once in a band
        distinct = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        keys, counts = np.unique(distinct // longest, return_counts=True)
        after = np.minimum(np.searchsorted(keys, keys + 1), len(keys) - 1)
        pair = counts + np.where(keys[after] == keys + 1, counts[after], 0)
        item = keys // span % n
        enough = pair >= self.need[item]
        keys = keys[enough][np.argsort(-pair[enough], kind="stable")]
        if len(keys):
            yield keys // span // n, keys // span % n, keys % span - longest - 1

    def fine_enough(self, points: np.ndarray, item: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Which (item, band) of one text have enough of the item's FINE-grams in the band's stretch."""
        keep = np.ones(len(item), bool)
        if len(points) < FINE:
            return keep
        own = top_bits(codes(points, FINE), FINE_BITS)
        stretch = band * (self.edits[item] + 1) // STRETCH
        order = np.argsort(stretch, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(stretch[order])) + 1):
            i = item[part]
            slack = int(self.edits[i].max()) + 1
            lo = int(stretch[part[0]]) * STRETCH - slack
            seen = np.zeros(1 << FINE_BITS, bool)
            seen[own[max(0, lo) : max(0, lo + STRETCH + 4 * slack + int(self.lengths[i].max()))]] = True
            filled = self.fine_counts[i] > 0
            found = np.zeros(len(i), "i8")
            if filled.any():
                n = self.fine_counts[i[filled]]
                found[filled] = np.add.reduceat(seen[self.fine[ranges(self.fine_starts[i[filled]], n)]].astype("i8"), np.cumsum(n) - n)
            keep[part] = found >= self.fine_need[i]
        return keep


class Items:
    """The distinct texts of a block of items, with their q-gram tables."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        ids: dict[str, list[int]] = {}
        for i, t in items:
            if t := compared(t):
                ids.setdefault(t, []).append(i)
        self.texts, self.ids = list(ids), list(ids.values())
        self.short = [n for n, t in enumerate(self.texts) if len(t) < Q and not budget(len(t))]
        by_q: dict[int, list[int]] = {}
        for n, t in enumerate(self.texts):
            if len(t) >= Q or budget(len(t)):
                by_q.setdefault(gram_length(len(t)), []).append(n)
        self.grams = [Grams(q, which, [points_of(self.texts[n]) for n in which]) for q, which in sorted(by_q.items())]


def aligned(g: Grams, points: np.ndarray, text_lo: np.ndarray, text_hi: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, start, end) of each candidate: the best occurrence of its item in points[text_lo:text_hi] along diagonals low..high (places less text_lo); the
    distance is -1 if it is above the item's budget."""
    n, width = len(item), int((high - low).max()) + 1
    out = np.full(n, -1), np.zeros(n, "i8"), np.zeros(n, "i8")
    size, m, most, who, far = (text_hi - text_lo)[:, None], g.lengths[item], g.edits[item], np.arange(n), 1 << 30
    diag = low[:, None] + np.arange(width)
    open_ = diag <= high[:, None]
    cost = np.where((diag >= 0) & (diag <= size) & open_, 0, far)  # row 0: an occurrence may start anywhere
    start, steps = diag.copy(), np.arange(width)
    base_at, item_at = text_lo[:, None], g.starts[item]
    for i in range(1, int(m.max(initial=0)) + 1):
        j = diag + i
        room = (j >= 0) & (j <= size) & open_
        inside = room & (j >= 1)
        same = points[np.where(inside, base_at + j - 1, 0)] == g.flat[item_at + i - 1][:, None]
        best, began = np.where(inside, cost + ~same, far), start
        up = np.concatenate([cost[:, 1:], np.full((len(cost), 1), far)], axis=1) + 1
        take = (up < best) & room
        best, began = np.where(take, up, best), np.where(take, np.concatenate([start[:, 1:], np.zeros((len(cost), 1), "i8")], axis=1), began)
        base = best - steps  # insertions run along the row
        low_at = np.maximum.accumulate(np.where(base == np.minimum.accumulate(base, axis=1), steps, 0), axis=1)
        best, began = np.take_along_axis(base, low_at, 1) + steps, np.take_along_axis(began, low_at, 1)
        cost, start = np.where(room, np.minimum(best, far), far), began
        least = cost.min(axis=1)
        ends = m == i
        if ends.any():
            for c in np.flatnonzero(ends & (least <= most)).tolist():
                at = int(cost[c].argmin())
                out[0][who[c]], out[1][who[c]], out[2][who[c]] = cost[c, at], start[c, at], diag[c, at] + i
        stay = ~ends & (least <= most)
        if not stay.all():
            cost, start, diag, open_, size, m, most, who, base_at, item_at = (x[stay] for x in (cost, start, diag, open_, size, m, most, who, base_at, item_at))
            if not len(who):
                break
    return out


#: Ranges of code points of scripts that are written without spaces between words (fixed values): Thai to Myanmar, Khmer, Han with kana and bopomofo, Yi, Han supplements.
SPACELESS = re.compile("[\u0e00-\u109f\u1780-\u17ff\u2e80-\u312f\u31a0-\u9fff\ua000-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]")


def at_words(text: str, item: str) -> int:
    """Where the item first stands in the text with no letter or digit going on across its ends; -1 if nowhere. Scripts without spaces have no such ends."""
    goes_on = lambda a, b: a.isalnum() and b.isalnum() and not SPACELESS.match(a) and not SPACELESS.match(b)
    at = text.find(item)
    while at >= 0 and (goes_on(text[max(0, at - 1) : at], item[0]) or goes_on(item[-1], text[at + len(item) : at + len(item) + 1])):
        at = text.find(item, at + 1)
    return at


def find(texts: list[str], items: Items, whole_words: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(text, item id, start, end, distance): the best place of each item in each text that holds it within its budget; short items at word boundaries only, if so asked."""
    texts = [compared(t) for t in texts]
    place = at_words if whole_words else str.find
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for n in items.short:
        s = items.texts[n]
        best |= {(d, n): (0, at, at + len(s)) for d, t in enumerate(texts) if s in t and (at := place(t, s)) >= 0}
    if items.grams and any(texts):
        gap = np.full(Q, 0x110000, "<u4")
        parts = [points_of(t) for t in texts]
        starts = np.cumsum([0] + [len(p) + Q for p in parts])
        points = np.concatenate([x for p in parts for x in (p, gap)])
        for g in items.grams:
            hits, gram = g.hits(points)
            for t, i, b in g.bands(hits, gram, starts, 0, len(g.points)):
                order = np.argsort(t, kind="stable")
                keep = np.ones(len(t), bool)
                for part in np.split(order, np.flatnonzero(np.diff(t[order])) + 1):
                    keep[part] = g.fine_enough(parts[t[part[0]]], i[part], b[part])
                _verify(g, items, texts, points, starts, t[keep], i[keep], b[keep], best)
    return [(d, i, s, e, c) for (d, n), (c, s, e) in sorted(best.items()) for i in items.ids[n]]


def _verify(g: Grams, items: Items, texts: list[str], points: np.ndarray, starts: np.ndarray, t: np.ndarray, i: np.ndarray, b: np.ndarray, best: dict) -> None:
    """Adds to best the (distance, start, end) of each (text, item) that has an occurrence in one of the bands."""
    left = []
    for c, (d, k, band) in enumerate(zip(t.tolist(), i.tolist(), b.tolist())):
        n, m, w = int(g.which[k]), int(g.lengths[k]), int(g.edits[k]) + 1
        if best.get((d, n), (1,))[0]:
            exact = texts[d].find(items.texts[n], max(0, band * w), (band + 2) * w + m)
            if exact >= 0:
                best[d, n] = (0, exact, exact + m)
            else:
                left.append(c)
    left = [c for c in left if best.get((int(t[c]), int(g.which[i[c]])), (1,))[0]]
    for at in range(0, len(left), ALIGNED):
        some = np.array(left[at : at + ALIGNED])
        d, k, w = t[some], i[some], g.edits[i[some]] + 1
        low, high = b[some] * w - g.edits[k], (b[some] + 2) * w - 1 + g.edits[k]
        cost, begin, end = aligned(g, points, starts[d], starts[d + 1] - Q, k, low, high)
        for c in np.flatnonzero(cost >= 0).tolist():
            key = int(d[c]), int(g.which[k[c]])
            if cost[c] < best.get(key, (1 << 30,))[0]:
                best[key] = (int(cost[c]), int(begin[c]), int(end[c]))


def _built(key: str, sent) -> Items:
    """One table for each Python worker and block."""
    return built("items", key, lambda: Items(sent.value), TOGETHER)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, item_id, start, end, distance, passage: the items that occur in each document within their edit budget."""
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("__doc"), text_or_empty(text_col).alias("__text"))
    out = None
    for key, sent in _blocks(benchmark):

        def scan(ids, texts, key=key, sent=sent):
            texts, ids = texts.to_pylist(), ids.to_pylist()
            found = find(texts, _built(key, sent))
            return {
                id_col: [ids[d] for d, *_ in found],
                "item_id": [i for _, i, *_ in found],
                "start": [s for _, _, s, _, _ in found],
                "end": [e for *_, e, _ in found],
                "distance": [c for *_, c in found],
                "passage": [compared(texts[d])[s:e] for d, _, s, e, _ in found],
            }

        part = map_columns(read, scan, f"{id_col} {kind}, item_id long, start int, end int, distance int, passage string", 300, "items")
        out = part if out is None else out.unionByName(part)
    return out


def _judge(key: str, sent):
    """A pandas UDF: does an item of the broadcast block occur in the text?"""

    def leaked(texts: pd.Series) -> pd.Series:
        hit, all_texts = np.zeros(len(texts), bool), texts.tolist()
        for lo in range(0, len(all_texts), 300):
            hit[[lo + d for d, *_ in find(all_texts[lo : lo + 300], _built(key, sent), whole_words=True)]] = True
        return pd.Series(hit)

    return F.pandas_udf(leaked, "boolean")


def _blocks(benchmark: DataFrame):
    """(key, broadcast) of the usable items in blocks of about BLOCK_CHARS characters."""
    usable = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    blocks = max(1, -(-(usable.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    for b in range(blocks):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast([(int(r[0]), r[1]) for r in rows])


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs in which no item occurs, with all their columns."""
    for n, (key, sent) in enumerate(_blocks(benchmark.withColumn("item_id", F.coalesce(F.col("item_id").cast("long"), F.lit(-1))))):
        if n and n % TOGETHER == 0:
            docs = stored(docs, "clean")
        docs = docs.where(~_judge(key, sent)(text_or_empty(text_col)))
    return docs
