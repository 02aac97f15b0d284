"""Token counts under a unigram vocabulary, without making tokens.

Texts are cut before each space, as a metaspace pre-tokenizer does (every space becomes the piece mark, one is put in front of a
text without one). For each word an Aho-Corasick automaton enumerates the vocabulary's pieces by where they end, and the Viterbi pass
keeps, for each position, the best score and the number of tokens of the path that has it; no path is written down.

Ties are the tokenizers library's: of equal scores the piece that starts first (the longest) stays, and a character without
a piece of its own costs the lowest score less 10. Runs of such characters count as one unknown token, or, with byte fallback, as
their UTF-8 bytes if all byte pieces are there.

Defined results: null and empty texts have 0 tokens. Words may have any length; time grows with length alone.
"""

from __future__ import annotations

import hashlib

import ahocorasick
from pyspark.sql import DataFrame

from .common import built, map_columns, text_or_empty

#: The mark of a word's start, and what an unknown character costs beyond the lowest score.
MARK, UNKNOWN_COST = "▁", 10.0
#: Words whose count a Python worker keeps; beyond it the table starts anew, which changes no result.
KEPT_WORDS = 400_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class UnigramCounter(dict):
    """Counts of the words met so far, by word; a missing word is counted."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        super().__init__()
        self.trie = ahocorasick.Automaton()
        for piece, score in dict(vocab).items():
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_COST
        pieces = {p for p, _ in vocab}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))

    def __missing__(self, word: str) -> int:
        n = self.count(MARK + word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, word: str) -> int:
        """Tokens of the best path over one word, its mark included."""
        n = len(word)
        best, tokens, unknown, done = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1), 0
        reached = [False] * (n + 1)
        reached[0] = True
        single = [False] * (n + 1)
        for end, (length, score) in self.trie.iter(word):
            end += 1
            while done < end - 1:  # positions at which no piece ends
                done += 1
                self._close(word, done, best, tokens, unknown, reached, single[done])
            start = end - length
            if length == 1:
                single[end] = True
            value = best[start] + score
            if not reached[end] or value > best[end]:
                best[end], tokens[end], unknown[end], reached[end] = value, tokens[start] + 1, False, True
            if length == 1:
                done = max(done, end - 1)
        while done < n:
            done += 1
            self._close(word, done, best, tokens, unknown, reached, single[done])
        return tokens[n]

    def _close(self, word, end, best, tokens, unknown, reached, single) -> None:
        """The unknown token for a character without a piece, tried last as it starts last."""
        if single:
            return
        value = best[end - 1] + self.unknown
        if not reached[end] or value > best[end]:
            best[end], unknown[end], reached[end] = value, True, True
            if self.bytes:
                tokens[end] = tokens[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            else:
                tokens[end] = tokens[end - 1] + (not unknown[end - 1])

    def total(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        return sum(map(self.__getitem__, words[not words[0] :]))


def token_counts(df: DataFrame, vocab: list[tuple[str, float]], byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens. The vocabulary is sent to the executors: its size doesn't depend on the corpus."""
    key = hashlib.sha256(repr((vocab, byte_fallback)).encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(vocab)

    def run(ids, texts):
        counter = built("unigram", key, lambda: UnigramCounter(sent.value, byte_fallback))
        return {id_col: ids, "n_tokens": [counter.total(t) for t in texts.to_pylist()]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, text_or_empty(text_col).alias("t")), run, f"{id_col} {kind}, n_tokens long", 1000, "unigram")
