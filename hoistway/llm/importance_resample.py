"""Target-distribution importance resampling by hashed n-grams, with n-gram CRCs from prefix CRCs.

A text is lower-cased (A-Z only) and brought to words joined by one space. It is scanned once: the running CRC-32 before and behind every word is kept. CRC-32 is
linear over GF(2), so for the n-gram that starts behind prefix p and ends with prefix q, L bytes long, crc32(n-gram) = crc(q) XOR shift(crc(p), L), where shift multiplies
by x**(8 L) modulo the CRC's polynomial. Shifts are table lookups, one table for each L up to ``SHORT`` and one for each power of two above, so an n-gram costs the
same however long its words are, and its bytes are never copied or read again.

Bucket counts of raw and target texts are summed in each task and added up by Spark; the gains of all buckets (their number is a parameter, whatever the corpus)
are a small model that scores every document in a second scan. Scores plus Gumbel noise, seeded by the id, are ranked by a range shuffle of narrow rows: each range
knows how many rows stand before it, so no task sees more than its range, and the highest share is drawn without replacement.

Defined results: null texts have no words; a document without words has no features and weight 0. Any length of text is read whole, a window of words at a time.
Rows that repeat a doc_id are documents of their own (with the same noise, and stable order among equal scores); a null doc_id counts as the empty text in the seed and
comes after other ids. Empty tables give no rows (an empty target has T = 0). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, stored, text_or_empty

#: Production parameters: buckets, longest n-gram in words, share drawn in percent, least words of a drawn document, seed of the noise.
BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42
#: Rows and words taken at a time; shifts with a table of their own, in bytes.
ROWS, WINDOW, SHORT = 500, 20_000, 128
#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
#: What words consist of, after lower-casing: digits, a-z and every byte of characters beyond ASCII; all else separates.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo POLYNOMIAL, both reflected: bit 31 is x**0."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def _tables(factor: int) -> np.ndarray:
    """For each byte of a CRC, its part of the product with factor: 4 x 256."""
    bits = [_times(1 << k, factor) for k in range(32)]
    out = np.zeros((4, 256), "u4")
    for byte in range(4):
        for k in range(8):
            half = 1 << k
            out[byte, half : 2 * half] = out[byte, :half] ^ np.uint32(bits[8 * byte + k])
    return out


@lru_cache(maxsize=1)
def shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables that shift by 0 to SHORT - 1 bytes (4 x 256 each, flat), and by 2**k bytes for k to 47."""
    x8, factor, short, powers = 1 << 23, 1 << 31, [], []
    for _ in range(SHORT):
        short.append(_tables(factor))
        factor = _times(factor, x8)
    factor = x8
    for _ in range(48):
        powers.append(_tables(factor))
        factor = _times(factor, factor)
    return np.stack(short, axis=1).reshape(4, -1), np.stack(powers)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc moved on by length zero bytes, elementwise."""
    short, powers = shift_tables()
    at = np.minimum(length, SHORT - 1).astype("i4") << 8
    out = short[0][at | (crc & 255)] ^ short[1][at | (crc >> 8 & 255)] ^ short[2][at | (crc >> 16 & 255)] ^ short[3][at | (crc >> 24)]
    for i in np.flatnonzero(length >= SHORT):
        c, n, k = int(crc[i]), int(length[i]), 0
        while n:
            if n & 1:
                c = int(powers[k, 0, c & 255] ^ powers[k, 1, c >> 8 & 255] ^ powers[k, 2, c >> 16 & 255] ^ powers[k, 3, c >> 24])
            n, k = n >> 1, k + 1
        out[i] = c
    return out


def _behind(crc: int, word: bytes) -> int:
    return crc32(word, crc32(b" ", crc))


class Scan:
    """Prefix CRCs of consecutive words: before and behind each word, and the byte at which it starts. ``of`` is the document of each word.

    The scan starts with a space, as does every word; what stands before cancels out in any n-gram.
    """

    def __init__(self, docs: list[list[bytes]]) -> None:
        words = list(chain.from_iterable(docs))
        self.behind = np.fromiter(accumulate(words, _behind, initial=0), "u4", len(words) + 1)
        self.of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.size = np.fromiter(map(len, words), "i8", len(words))
        self.before = shifted(self.behind[:-1], np.ones(len(words), "i8")) ^ np.uint32(crc32(b" "))
        self.end = np.cumsum(self.size + 1)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """CRC-32 and document of every run of n words within a document."""
        if len(self.of) < n:
            return np.zeros(0, "u4"), np.zeros(0, "i8")
        first = np.flatnonzero(self.of[: len(self.of) - n + 1] == self.of[n - 1 :])
        last = first + n - 1
        length = self.end[last] - self.end[first] + self.size[first]
        return self.behind[1:][last] ^ shifted(self.before[first], length), self.of[first]


def scanned(texts: list[str]) -> Iterator[tuple[Scan, list[int]]]:
    """Scans of at most about WINDOW words, with the places of their documents in texts. A longer text comes in windows that overlap, so that each of its n-grams of
    LONGEST words stands in one of them; ``Scan.of`` numbers windows."""
    docs, places, held = [], [], 0
    for place, text in enumerate(texts):
        words = words_of(text)
        if held + len(words) > WINDOW and docs:
            yield Scan(docs), places
            docs, places, held = [], [], 0
        if len(words) <= WINDOW:
            docs.append(words)
            places.append(place)
            held += len(words)
            continue
        for lo in range(0, len(words), WINDOW):
            yield Scan([words[lo : lo + WINDOW]]), [place]
            if lo:  # n-grams of two and more words that cross from the window before
                left, right = words[max(0, lo - LONGEST + 1) : lo], words[lo : lo + LONGEST - 1]
                yield Crossing([left + right], len(left)), [place]
    if docs:
        yield Scan(docs), places


class Crossing(Scan):
    """The n-grams that begin in the first ``cut`` words and end behind them."""

    def __init__(self, docs: list[list[bytes]], cut: int) -> None:
        super().__init__(docs)
        self.cut = cut

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        crc, of = super().grams(n)
        starts = np.arange(len(crc))
        keep = (starts < self.cut) & (starts + n > self.cut)
        return crc[keep], of[keep]


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("resample")
        total = np.zeros(buckets, "i8")
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                for scan, _ in scanned(batch.column(0).slice(lo, ROWS).to_pylist()):
                    for n in range(1, LONGEST + 1):
                        total += np.bincount(scan.grams(n)[0] % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(total[used])], names=["bucket", "n"])

    parts = df.select(text_or_empty(text_col).alias("t")).mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) of every bucket. Reads two rows a bucket at most."""
    s, t = np.zeros(buckets, "i8"), np.zeros(buckets, "i8")
    for counts, to in ((raw, s), (target, t)):
        for bucket, n in counts.collect():
            to[bucket] = n
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (all_s + buckets) / ((int(a) + 1) * (all_t + buckets)))) for a, b in zip(s, t)], "i8")


def weights(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_features, weight of every row. The model's size is the number of buckets."""
    sent, kind = df.sparkSession.sparkContext.broadcast(gain), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("resample")
        own = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                rows = batch.slice(lo, ROWS)
                n_words, n_features, weight = (np.zeros(rows.num_rows, "i8") for _ in range(3))
                for scan, places in scanned(rows.column(1).to_pylist()):
                    at = np.array(places, "i8")
                    if not isinstance(scan, Crossing):
                        np.add.at(n_words, at, np.bincount(scan.of, minlength=len(at)))
                    for n in range(1, LONGEST + 1):
                        crc, of = scan.grams(n)
                        np.add.at(n_features, at, np.bincount(of, minlength=len(at)))
                        sums = np.zeros(len(at), "i8")
                        if len(of):  # rows of a document stand together
                            starts = np.flatnonzero(np.diff(of, prepend=-1))
                            sums[of[starts]] = np.add.reduceat(own[crc % np.uint32(len(own))], starts)
                        np.add.at(weight, at, sums)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    out = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")
    return out.withColumnRenamed("id", id_col)


def with_noise(scored: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Adds score: the weight plus floor(1000 Gumbel noise), the noise being a function of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return scored.withColumn("score", F.col("weight") + noise)


def drawn(scored: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank to a stored table with n_words and score: 1, 2, ... for the floor(percent N / 100) highest scores of the N rows of enough words, null for others."""
    row = scored.select("*", F.monotonically_increasing_id().alias("__row"))
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("__row")]
    ranges = row.where(F.col("n_words") >= least_words).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranges.select("*", F.monotonically_increasing_id().alias("__at")), "placed", keep=True)
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # a row for each shuffle partition
    most, offsets, seen = percent * sum(n for _, n in sizes) // 100, [], 0
    for p, n in sizes:
        offsets.append((p, seen))
        seen += n
    before = F.broadcast(scored.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    at = F.col("__before") + within + 1
    ranked = placed.join(before, part == F.col("__part")).withColumn("rank", F.when(at <= most, at)).drop("__row", "__at", "__part", "__before")
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_features, weight, score, rank of every row of docs, drawn towards the n-grams of target."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    scored = stored(with_noise(weights(docs, gain, id_col, text_col), id_col), "scored", keep=True)
    return drawn(scored, id_col).select(id_col, "n_features", "weight", "score", "rank")


def _oracle() -> str:
    """The same from the bytes of each n-gram, without prefixes."""
    words = "list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    grams = " UNION ALL ".join(f"SELECT side, row, array_to_string(w[i : i + {n - 1}], ' ') AS g FROM (SELECT side, row, w, unnest(range(1, len(w) - {n - 2})) AS i FROM texts)" for n in range(1, LONGEST + 1))
    return f"""
WITH crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, (c & 1) * {POLYNOMIAL})) ORDER BY b) AS t FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
texts AS (SELECT 'raw' AS side, row, {words.format("text")} AS w FROM docs UNION ALL SELECT 'target', 0, {words.format("text")} FROM benchmark),
grams AS ({grams}),
hexes AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)),
bytes AS (SELECT g, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM hexes),
buckets AS (SELECT g, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc),
found AS (SELECT side, row, bucket FROM grams JOIN buckets USING (g)),
sums AS (SELECT bucket, count(*) FILTER (side = 'raw') AS s, count(*) FILTER (side = 'target') AS t FROM found GROUP BY bucket),
alls AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((sums.t + 1) * (alls.s + {BUCKETS}) AS DOUBLE) / CAST((sums.s + 1) * (alls.t + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain FROM sums, alls),
weighed AS (SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM found JOIN gain USING (bucket) WHERE side = 'raw' GROUP BY row),
scored AS (
  SELECT docs.row, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score,
    len(w) >= {LEAST_WORDS} AS enough
  FROM docs JOIN texts ON texts.side = 'raw' AND texts.row = docs.row LEFT JOIN weighed ON weighed.row = docs.row),
ranked AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST, row) AS r, count(*) OVER (PARTITION BY enough) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND r <= {PERCENT} * n // 100 THEN r END AS rank FROM ranked
"""


ORACLE = _oracle()
