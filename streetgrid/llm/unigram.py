"""Token counts of a unigram vocabulary without making the tokens (operator 4).

An Aho-Corasick automaton lists the vocabulary entries that end at each position; a forward pass carries the best score
and the number of tokens on the best way there. Ties go to the entry that starts first, unknown characters cost the
lowest score less 10, unknown runs are one piece, written as byte tokens where the vocabulary has all of these.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunk_cache import ChunkCache
from .common import add_columns, strings

#: What an unknown character costs below the lowest score; fixed by the tokenizer.
UNKNOWN_PENALTY = 10.0
#: The sign that stands for a blank; fixed by the tokenizer.
BLANK = "▁"


class UnigramCounter:
    """Counts the tokens of texts under ``vocab``, a list of (piece, score) by id."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool):
        self._lowest = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        self._matches = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self._matches.add_word(piece, (len(piece), score))
        self._matches.make_automaton()
        have = {p for p, _ in vocab}
        self._bytes = have if byte_fallback else set()
        self._of_word = ChunkCache(self.count_word)

    def _as_bytes(self, run: str) -> int:
        """Tokens that an unknown run gives."""
        raw = run.encode("utf-8", "surrogatepass")
        return len(raw) if self._bytes and all(f"<0x{b:02X}>" in self._bytes for b in raw) else 1

    def count_word(self, word: str) -> int:
        """Tokens of one word with its blank sign."""
        n = len(word)
        if not n:
            return 0
        score, pieces, unknown_from = [0.0] + [None] * n, [0] * (n + 1), [-1] * (n + 1)
        at: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self._matches.iter(word):
            at[end + 1].append(found)
        for end in range(1, n + 1):
            best = None
            for size, value in at[end]:  # longest first, that is by ascending start
                s = score[end - size] + value
                if best is None or s > best:
                    best, begin, known = s, end - size, True
            if not at[end] or at[end][-1][0] != 1:
                s = score[end - 1] + self._lowest
                if best is None or s > best:
                    best, begin, known = s, end - 1, False
            score[end] = best
            if known:
                pieces[end] = pieces[begin] + 1
            else:
                first = unknown_from[begin] if unknown_from[begin] >= 0 else begin
                unknown_from[end] = first
                pieces[end] = pieces[first] + self._as_bytes(word[first:end])
        return pieces[n]

    def count(self, text: str) -> int:
        """Tokens of a whole text; an empty one has none."""
        if not text:
            return 0
        text = text.replace(BLANK, " ")
        words = text.split(" ")
        if text[0] == " ":
            words = words[1:]
        return sum(map(self._of_word.__getitem__, [BLANK + w for w in words]))


@lru_cache(maxsize=2)
def _counter(vocab: tuple, byte_fallback: bool) -> UnigramCounter:
    return UnigramCounter(list(vocab), byte_fallback)


def read_pieces(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size()))


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", n_tokens: str = "n_tokens", byte_fallback: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Add the number of tokens of ``text`` under the unigram vocabulary of a model file.

    A null or empty text has 0 tokens. Rows stay as they are; a column already named ``n_tokens`` is replaced. The
    vocabulary, of fixed size, is broadcast; nothing is shuffled and no text is cut.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))

    def make():
        count = _counter(vocab.value, byte_fallback).count
        return lambda texts: [pa.array([count(t) for t in strings(texts)], pa.int64())]

    return add_columns(docs, make, [text], [T.StructField(n_tokens, T.LongType())], keep)
