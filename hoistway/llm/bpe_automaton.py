"""Byte-level BPE as a tokenization automaton.

The automaton over token ids starts with one state and a loop for each byte. Each merge (a, b) -> c, in order, adds one gadget: the state behind
arc a is copied without its arc b, arc a now leads to the copy, and every state that has arc a gets an arc c to the state that b led to. After the last merge,
the state behind an arc depends on the arc's label alone, and a sequence of ids is a path if and only if it is the tokenization that the
merges give. A copy differs from its original by one missing arc, so states are kept as these differences; an arc is looked up along the
copies once and then kept.

Encoding reads bytes, so the automaton is made deterministic over them. A state of the byte table is the set of what may be going on: (how far into the
labels' trie, label of the arc before). A byte moves each of these on; where a label ends and its arc leaves the state before, it is the last label of the
tokenization up to here. Just one is, as each prefix has one tokenization: the transition emits it. A word takes one lookup a byte; its ids are the
emitted labels met backwards from its end, each as long as its label. Transitions are made when first met (the whole table would
have billions) and kept in a bounded table. Decoding emits the labels of arcs.

Defined results: null and empty texts have no ids and decode to the empty text; the special token's own string is one id.
Repeated rows give repeated results; only the columns asked for are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import built, map_columns, text_or_empty

# The published pre-split pattern of this byte-level tokenizer; \p{White_Space} is what \s means in the tokenizers library.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Finds a space beside white space or an end of the text.
WIDE = re.compile(r" \s|\s |\A | \Z").search
#: Words whose ids a Python worker keeps; beyond it the table starts anew, which changes no result.
KEPT_WORDS = 250_000
KEPT_ARCS = 500_000
#: Transitions of the byte table that a worker keeps; beyond it the table starts anew between words.
KEPT_STEPS = 500_000


def byte_letters() -> dict[str, int]:
    """The published letter for each byte: printable Latin-1 stands for itself, the others for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def read_merges(path: str) -> dict:
    """What a tokenizer file holds, as plain bytes and numbers: labels by id, (left, right) of each merge in order, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    vocab = spec["model"]["vocab"]
    labels: list[bytes] = [b""] * (1 + max(*vocab.values(), *(x["id"] for x in spec["added_tokens"]), 0))
    for token, i in vocab.items():
        labels[i] = bytes(letters[c] for c in token)
    merges = []
    for pair in spec["model"]["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    for content, i in special.items():
        labels[i] = content.encode()
    return {"labels": labels, "merges": merges, "special": special}


class MergeAutomaton:
    """The automaton of a list of merges, and its transition table."""

    def __init__(self, spec: dict) -> None:
        self.labels: list[bytes] = spec["labels"]
        self.special: dict[str, int] = spec["special"]
        in_merges = {i for m in spec["merges"] for i in m}
        singles = {i for i, x in enumerate(self.labels) if len(x) == 1 and i not in self.special.values()}
        self.left, self.right = list(range(len(self.labels))), list(range(len(self.labels)))
        self.made = [0] * len(self.labels)  # the merge that added the arc; 0 for bytes
        self.gone: dict[int, int] = {}  # (a, b): the merge that took arc b from the state behind a
        for when, (a, b, c) in enumerate(spec["merges"], 1):
            self.gadget(when, a, b, c)
        self.arcs: dict[int, bool] = {}
        self.nodes: dict[int, int] = {}  # node << 8 | byte: the next node of the labels' trie; 0 is its root
        self.ends: dict[int, int] = {}  # the label that ends at a node
        for i in sorted(singles | in_merges):
            node = 0
            for byte in self.labels[i]:
                node = self.nodes.setdefault(node << 8 | byte, len(self.nodes) + 1)
            self.ends[node] = i
        self.goes_on = {key >> 8 for key in self.nodes}  # nodes that a longer label passes
        self._empty_table()
        self.words = _Kept(self.word)
        self.chunks = _Kept(self.chunk)
        self.split = regex.compile(PRE_SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def gadget(self, when: int, a: int, b: int, c: int) -> None:
        """One merge: the copy behind arc a lacks arc b; arc c leads where b led and leaves every state that a leaves."""
        self.gone.setdefault(a << 20 | b, when)
        if not self.made[c]:
            self.made[c], self.left[c], self.right[c] = when, a, b

    def has_arc(self, x: int, y: int) -> bool:
        """Has the state behind arc x an arc y? Follows the copies back to the first state, which has all bytes."""
        key = x << 20 | y
        known = self.arcs.get(key)
        if known is None:
            known = self._look(x, y, 1 << 30)
            if len(self.arcs) >= KEPT_ARCS:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def _look(self, x: int, y: int, before: int) -> bool:
        """The same among the merges up to ``before``, that one not included."""
        made, gone = self.made, self.gone
        while True:
            taken = gone.get(x << 20 | y)
            if taken is not None and taken < before:
                return False
            mx, my = made[x], made[y]
            if mx == 0 and my == 0:
                return True
            if mx > my:  # the state behind c was, before that merge, the one behind its right part
                x, before = self.right[x], mx
            elif my > mx:  # arc c leaves the states that arc a leaves once the copy has lost its arc b
                y, before = self.left[y], my + 1
            else:  # c behind c: arc c was added to the state that its right part led to, if that has arc a
                x, y, before = self.right[x], self.left[y], mx

    def _empty_table(self) -> None:
        """The byte table with its first state alone: at the trie's root, behind no label."""
        self.table: dict[int, int] = {}  # state << 8 | byte: next state << 20 | emitted label + 1
        self.members: list[tuple] = [(0,)]  # of each state: node << 20 | label before + 1
        self.numbers: dict[tuple, int] = {self.members[0]: 0}

    def _step(self, state: int, byte: int) -> int:
        """Makes one transition of the byte table."""
        after, emitted = [], -1
        for member in self.members[state]:
            node, before = self.nodes.get(member >> 20 << 8 | byte, -1), member & 0xFFFFF
            if node < 0:
                continue
            if node in self.goes_on:
                after.append(node << 20 | before)
            label = self.ends.get(node, -1)
            if label >= 0 and (not before or self.has_arc(before - 1, label)):
                emitted = label
        if emitted >= 0:
            after.append(emitted + 1)
        members = tuple(after)
        number = self.numbers.setdefault(members, len(self.members))
        if number == len(self.members):
            self.members.append(members)
        self.table[state << 8 | byte] = out = number << 20 | emitted + 1
        return out

    def path(self, word: bytes) -> list[int]:
        """The labels of the one path that spells the word."""
        if len(self.table) >= KEPT_STEPS:
            self._empty_table()
        state, emitted, table = 0, [], self.table
        for byte in word:
            step = table.get(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
            state = step >> 20
            emitted.append(step & 0xFFFFF)
        at, out, labels = len(word), [], self.labels
        while at:
            label = emitted[at - 1] - 1
            if label < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(label)
            at -= len(labels[label])
        return out[::-1]

    def word(self, word: str) -> bytes:
        return np.array(self.path(word.encode()), dtype="<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        """What follows a space up to the next; most are letters alone, or with one sign behind, and need no pattern."""
        get = self.words.__getitem__
        if chunk.isalpha():
            return get(" " + chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ".,":
            return get(" " + chunk[:-1]) + get(chunk[-1])
        return b"".join(map(get, self.split(" " + chunk)))

    def plain(self, text: str) -> bytes:
        """A text without special strings. A space between two characters that aren't white space always starts a pre-split word, so such texts are cut there."""
        if WIDE(text):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.words.__getitem__, self.split(first))) + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else self.plain(part) for part in self.cut.split(text))

    def decode(self, ids: Iterable[int]) -> str:
        """The text that the arcs' labels spell; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class _Kept(dict):
    """Results of a function for the short strings met last."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, key: str) -> bytes:
        out = self.of(key)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(key) <= 64:
            self[key] = out
        return out


def _automaton(key: str, spec) -> MergeAutomaton:
    """One automaton for each Python worker and vocabulary."""
    return built("bpe", key, lambda: MergeAutomaton(spec.value))


def _shared(df: DataFrame, path: str):
    """The vocabulary, read on the driver and sent to the executors: its size is that of the file, whatever the corpus."""
    spec = read_merges(path)
    key = hashlib.sha256(repr(spec["merges"]).encode()).hexdigest()
    return key, df.sparkSession.sparkContext.broadcast(spec)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, tokens array<int>."""
    key, spec = _shared(df, path)

    def run(ids, texts):
        a = _automaton(key, spec)
        return {id_col: ids, "tokens": [np.frombuffer(a.encode(t), dtype="<u4").astype("int32") for t in texts.to_pylist()]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, text_or_empty(text_col).alias("t")), run, f"{id_col} {kind}, tokens array<int>", 500, "bpe")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """id_col, text: the inverse of encode. Null tokens decode to the empty text."""
    key, spec = _shared(df, path)

    def run(ids, tokens):
        a = _automaton(key, spec)
        return {id_col: ids, "text": [a.decode(t or ()) for t in tokens.to_pylist()]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, tokens_col), run, f"{id_col} {kind}, text string", 500, "bpe")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, and SHA-256 of the ids and of the decoded text, from one pass that encodes and decodes."""
    key, spec = _shared(df, path)

    def run(ids, texts):
        a = _automaton(key, spec)
        n, by_ids, by_text = [], [], []
        for t in texts.to_pylist():
            out = a.encode(t)
            n.append(len(out) // 4)
            by_ids.append(hashlib.sha256(out).hexdigest())
            by_text.append(hashlib.sha256(a.decode(np.frombuffer(out, dtype="<u4").tolist()).encode()).hexdigest())
        return {id_col: ids, "n_tokens": n, "ids_sha256": by_ids, "decoded_sha256": by_text}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, text_or_empty(text_col).alias("t")), run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", 500, "bpe")


def with_tokens(df: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep, n_tokens and tokens of each row."""
    key, spec = _shared(df, path)

    def run(*columns):
        a = _automaton(key, spec)
        tokens = [np.frombuffer(a.encode(t), dtype="<u4").astype("int32") for t in columns[-1].to_pylist()]
        return dict(zip(keep, columns)) | {"n_tokens": [len(t) for t in tokens], "tokens": tokens}

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_columns(df.select(*keep, text_or_empty(text_col).alias("__t")), run, f"{kinds}, n_tokens long, tokens array<int>", 500, "bpe")
