"""Sets of hashed five-word shingles of whole texts, in numpy over a batch of texts at once."""

from __future__ import annotations

import numpy as np

#: What separates words; A-Z are lower-cased, nothing else is.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORDS = 5
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_RANDOM = np.random.default_rng(20240501)
#: A random number for each byte at each of the first positions of a word (tabulation hashing); later positions reuse them, turned.
POSITIONS = 64
_TABLE = _RANDOM.integers(0, 2**64, (POSITIONS, 256), dtype="u8").reshape(-1)
_MULTIPLIERS = _RANDOM.integers(0, 2**63, WORDS, dtype="u8") * np.uint64(2) + np.uint64(1)
_TURN = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word in UTF-8 bytes."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype("i1"))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, "u8"), starts
    keep = np.flatnonzero(~space)
    lengths = ends - starts
    at = np.arange(len(keep)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = _TABLE[(at % POSITIONS) * 256 + _LOWER[data[keep]]]
    if lengths.max() > POSITIONS:
        with np.errstate(over="ignore"):
            values = mixed(values + (at // POSITIONS).astype("u8") * _TURN)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
        return mixed(sums + lengths.astype("u8") * _TURN), starts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes: every five consecutive words, or all words of a shorter text as one."""
    data = np.frombuffer(b" ".join(texts), "u1")
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    hashes, starts = word_hashes(data)
    first = np.searchsorted(starts, bounds)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashes) - WORDS + 1), "u8")
        for k in range(WORDS):
            rolled += hashes[k : k + len(rolled)] * _MULTIPLIERS[k]
        rolled = mixed(rolled)
        out = []
        for lo, hi in zip(first[:-1], first[1:]):
            if hi - lo >= WORDS:
                out.append(np.unique(rolled[lo : hi - WORDS + 1]))
            elif hi > lo:
                out.append(mixed((hashes[lo:hi] * _MULTIPLIERS[: hi - lo]).sum(keepdims=True, dtype="u8") + np.uint64(hi - lo)))
            else:
                out.append(np.zeros(0, "u8"))
    return out
