"""BPE encoding and decoding by dynamic programming over prefixes (operator 3).

For each prefix of a pre-token there is exactly one last token in the encoding of that prefix. A suffix automaton of the
vocabulary lists the tokens that end at a position; the one whose predecessor (the last token of the shorter prefix) it
is compatible with is stored; following these back from the end gives the ids. No merge queue is run.

Two adjacent tokens are compatible when merging, by rank, what lies left and right of their border never joins
symbols across it.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .chunk_cache import REMEMBERED, ChunkCache, chunks
from .common import add_columns, lists, strings

#: A word's last symbol is another symbol than the same letter inside; it is held as one character in this private range.
_FINAL = 0xE000
#: Chunks of these letters, with or without such marks behind, need no normaliser but lower-casing.
_MARKS = ".,;:!?$%&*#|()+=/-"
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įĲ-ĶĹ-ňŊ-ſ]+")


def _byte_symbols() -> dict[int, str]:
    """byte -> character of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_symbols()


def plain_pieces(chunk: str) -> list[str] | None:
    """Word and marks of a chunk that needs no normaliser but lower-casing; None for any other."""
    word = chunk.rstrip(_MARKS)
    if not (word.isascii() and word.isalpha() or _LETTERS.fullmatch(word)):
        return None
    return [word.lower()] if word == chunk else [word.lower(), chunk[len(word) :]]


def byte_symbols_of(piece: str) -> str:
    """A piece in the symbols of byte-level vocabularies."""
    return piece if piece.isascii() else "".join(map(_BYTES.__getitem__, piece.encode()))


class SuffixAutomaton:
    """All factors of a set of words; ``out`` leads from a state to the longest whole word that is a suffix of it."""

    def __init__(self, words: dict[str, int]):
        step, link, length = [{}], [-1], [0]
        word_at: dict[int, int] = {}

        def split(p: int, c: str, q: int) -> int:
            step.append(dict(step[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            new = len(step) - 1
            link[q] = new
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = new
                p = link[p]
            return new

        for word, value in words.items():
            last = 0
            for c in word:
                p, q = last, step[last].get(c)
                if q is not None:
                    last = q if length[q] == length[p] + 1 else split(p, c, q)
                    continue
                step.append({})
                link.append(0)
                length.append(length[last] + 1)
                new = len(step) - 1
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
                last = new
            word_at[last] = value
        self.step, self.link, self.length, self.word_at = step, link, length, word_at
        self.out = [0] * len(step)
        for s in sorted(range(1, len(step)), key=length.__getitem__):
            up = link[s]
            self.out[s] = up if up in word_at else self.out[up]


class PrefixBpe:
    """The encoder and decoder for one word-level BPE vocabulary, given as the text of its JSON file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self._library = Tokenizer.from_str(spec)
        self._suffix = model.get("end_of_word_suffix") or ""
        self._special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self._split_special = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        vocab = model["vocab"]
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self._special.items()}
        self._names = np.array([self.token_of.get(i, "") for i in range(max(self.token_of) + 1)], dtype=object)

        symbols = {t: self._symbols(t) for t in vocab}
        self._id_of = {s: vocab[t] for t, s in symbols.items()}
        self._pair: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self._pair[left, right] = rank
            if whole not in self._parts:
                self._parts[whole], self._rank[whole] = (left, right), rank
        self._compatible: dict[int, bool] = {}
        usable = {s: i for s, i in self._id_of.items() if len(s) == 1 or self._reachable(i)}
        self._automaton = SuffixAutomaton(usable)
        self._whole = usable
        self._len_of = {i: len(s) for s, i in usable.items()}
        self._of_piece = ChunkCache(self._encode_piece, REMEMBERED)

    def _symbols(self, token: str) -> str:
        """A vocabulary entry as one character for each symbol."""
        if self._suffix and token.endswith(self._suffix) and len(token) > len(self._suffix):
            body = token[: -len(self._suffix)]
            return body[:-1] + chr(_FINAL + ord(body[-1]))
        return token

    def _border_holds(self, left: int, right: int, until: int) -> bool:
        """No merge of rank below ``until`` joins symbols across the border of two tokens."""
        rank, pair, parts = self._rank, self._pair, self._parts
        a_spine, b_spine = [left], [right]
        while a_spine[-1] in parts:
            a_spine.append(parts[a_spine[-1]][1])
        while b_spine[-1] in parts:
            b_spine.append(parts[b_spine[-1]][0])
        i, j = len(a_spine) - 1, len(b_spine) - 1
        while True:
            next_a = rank[a_spine[i - 1]] if i else until
            next_b = rank[b_spine[j - 1]] if j else until
            r = pair.get((a_spine[i], b_spine[j]))
            # Of equal ranks the leftmost pair is merged first: the border's before one on its right, after one on its left.
            if r is not None and r < until and r < next_a + (0 if i else 1) and r <= next_b:
                return False
            if not i and not j:
                return True
            if i and (not j or next_a <= next_b):
                i -= 1
            else:
                j -= 1

    def _reachable(self, token: int) -> bool:
        """The token's own text is encoded as the token."""
        if token not in self._parts:
            return False
        left, right = self._parts[token]
        return self._border_holds(left, right, self._rank[token]) and all(
            t not in self._parts or self._reachable_part(t) for t in (left, right)
        )

    @lru_cache(maxsize=None)  # noqa: B019 - one encoder lives in each task
    def _reachable_part(self, token: int) -> bool:
        return self._reachable(token)

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        if self._suffix and piece:
            piece = piece[:-1] + chr(_FINAL + ord(piece[-1]))
        whole = self._whole.get(piece)
        if whole is not None:
            return (whole,)
        auto = self._automaton
        step, link, length, word_at, out = auto.step, auto.link, auto.length, auto.word_at, auto.out
        known, border = self._compatible, self._border_holds
        last = [-1] * (len(piece) + 1)
        state = matched = 0
        for end, c in enumerate(piece, 1):
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            nxt = step[state].get(c)
            if nxt is None:
                state = matched = 0
                continue
            state, matched = nxt, matched + 1
            s = state if matched == length[state] and state in word_at else out[state]
            while s:
                begin, token = end - length[s], word_at[s]
                if begin == 0:
                    last[end] = token
                    break
                before = last[begin]
                if before >= 0:
                    key = before << 20 | token
                    fits = known.get(key)
                    if fits is None:
                        if len(known) > 1_000_000:
                            known.clear()
                        fits = known[key] = border(before, token, 1 << 40)
                    if fits:
                        last[end] = token
                        break
                s = out[s]
        ids, at = [], len(piece)
        while at > 0:
            token = last[at]
            if token < 0:  # a symbol outside the vocabulary: dropped, as the library does without an unknown token
                at -= 1
                continue
            ids.append(token)
            at -= self._len_of[token]
        return tuple(reversed(ids))

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without special tokens, in byte symbols."""
        if plain := plain_pieces(chunk):
            plain[0] = byte_symbols_of(plain[0])
            return plain
        normal = self._library.normalizer.normalize_str(chunk)
        return [p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without blanks; special tokens in it count as such."""
        ids: list[int] = []
        parts = self._split_special.split(chunk) if self._split_special and "<" in chunk else [chunk]
        for part in parts:
            if part in self._special:
                ids.append(self._special[part])
            elif part:
                for piece in self.pieces(part):
                    ids += self._of_piece[piece]
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for c in chunks(text) for i in self.encode_chunk(c)]

    def decode(self, ids) -> str:
        """The text the library gives for ids of a vocabulary without a decoder: tokens joined by blanks."""
        return " ".join(self._names[np.asarray(ids, dtype=np.int64)])


@lru_cache(maxsize=2)
def encoder(spec: str) -> PrefixBpe:
    """One encoder for each vocabulary and Python worker."""
    return PrefixBpe(spec)


def _packed(bpe: PrefixBpe) -> ChunkCache:
    return ChunkCache(lambda chunk: np.array(bpe.encode_chunk(chunk), dtype="<i4").tobytes())


_IDS = T.ArrayType(T.IntegerType(), False)


def read_spec(path: str) -> str:
    """The vocabulary file; of fixed size whatever the corpus, so tasks get it with their code."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add the token ids of ``text`` as an array column.

    A null or empty text gives an empty array. Rows stay as they are: repeated rows repeat, an empty table stays empty;
    a column that is already named as the new one is replaced. Nothing is shuffled and no text is cut.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocab_path))

    def make():
        cache = _packed(encoder(spec.value))
        get = cache.__getitem__
        return lambda texts: [lists([b"".join(map(get, chunks(t))) for t in strings(texts)], pa.int32(), 4)]

    return add_columns(docs, make, [text], [T.StructField(ids, _IDS)], keep)


def decode(tokens: DataFrame, vocab_path: str, ids: str = "ids", text: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Add the text of an array column of ids; null or empty arrays give an empty text, unknown ids nothing."""
    spec = tokens.sparkSession.sparkContext.broadcast(read_spec(vocab_path))

    def make():
        bpe = encoder(spec.value)
        return lambda rows: [pa.array(_texts(bpe, rows), pa.string())]

    return add_columns(tokens, make, [ids], [T.StructField(text, T.StringType())], keep)


def round_trip(docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``encode`` and then ``decode`` of its ids, in one pass over the texts."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocab_path))

    def make():
        bpe = encoder(spec.value)
        get = _packed(bpe).__getitem__

        def work(texts):
            rows = lists([b"".join(map(get, chunks(t))) for t in strings(texts)], pa.int32(), 4)
            return [rows, pa.array(_texts(bpe, rows), pa.string())]

        return work

    return add_columns(docs, make, [text], [T.StructField(ids, _IDS), T.StructField(decoded, T.StringType())], keep)


def _texts(bpe: PrefixBpe, rows: pa.ListArray) -> list[str]:
    rows = rows.cast(pa.list_(pa.int32()))
    offsets, values = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
    return [bpe.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
