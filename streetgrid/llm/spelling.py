"""Groups of spelling variants by Bloom-guided neighbourhoods (operator 12).

Two words are near when one code point is inserted, deleted or replaced. Every word generates its edits: all words with one
letter less, and all with one letter replaced by a greater one (the remaining edits are these, seen from the other word).
They are looked up in blocked Bloom filters of the vocabulary, one shard for each length, which are broadcast; only what the
filters hold is shuffled to an exact join with the vocabulary, where false positives end.

A broadcast has a fixed size. Shards are cut into slices by hash, and as many slices as fit go out together; a vocabulary
that needs more than one broadcast is probed once for each of them. All words of the vocabulary are probed, whatever its size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, new_path, slices
from .jaccard import mix64

#: Letters of words; all of them are one byte in Latin-1.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Shortest word and least count of the vocabulary; a form has so many times the word's count.
MIN_LETTERS, MIN_COUNT, FORM_TIMES = 7, 2, 10
#: Bits of the filters for each word: two words to a block of 64 bits, each with four bits set.
WORD_BITS = 32
#: Blocks of a slice, and slices of one broadcast: 8 MB, whatever the vocabulary.
SLICE_BLOCKS, SLICES = 1 << 14, 64
#: Words that a task counts in Python before it hands them on.
COUNTED = 200_000
#: Edits that a task looks up at once.
PROBES = 1 << 19
_UPPER = bytes(range(65, 91))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: Factor of a word's hash from letter to letter (odd), and its inverse modulo 2 ** 64.
_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 1 << 64)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of whole texts: runs of letters, A-Z in lower case, some with a letter deleted.

    A letter goes where 31 divides the crc32 of ``<doc_id>:<run>``: that at the crc32 modulo the length. A null text has no
    words, and a null id counts as empty. Shorter words than ``MIN_LETTERS`` are left out here.
    """
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def rows(counted: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words of other letters end a run, so longer text never joins what they part.
        find = re.compile(LETTERS).findall
        counted: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    here: dict[str, int] = {}
                    for w in find(text or ""):
                        if len(w) >= MIN_LETTERS:
                            here[w] = here.get(w, 0) + 1
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for w, n in here.items():
                        low = w.encode("latin-1").translate(_LOWERED).decode("latin-1")
                        h = zlib.crc32(low.encode(), start)
                        if h % 31 == 0:
                            k = h % len(low)
                            low = low[:k] + low[k + 1 :]
                            if len(low) < MIN_LETTERS:
                                continue
                        counted[low] = counted.get(low, 0) + n
                    if len(counted) >= COUNTED:
                        yield rows(counted)
                        counted = {}
        yield rows(counted)

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, schema)
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def _powers(length: int, base: int = _STEP) -> np.ndarray:
    return np.array([pow(base, k, 1 << 64) for k in range(length)], np.uint64)


_LETTER_HASH = mix64(np.arange(256, dtype=np.uint64) * _SEED + _SEED)


def _hashes(codes: np.ndarray) -> np.ndarray:
    return (_LETTER_HASH[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _mask(h: np.ndarray) -> np.ndarray:
    """Four bits of a block, by the highest bits of a hash."""
    one, six = np.uint64(1), np.uint64(63)
    return (one << (h >> np.uint64(58))) | (one << ((h >> np.uint64(52)) & six)) | (one << ((h >> np.uint64(46)) & six)) | (one << ((h >> np.uint64(40)) & six))


class Filters:
    """Slices of the length-sharded filters: blocks of 64 bits, by (length, slice of the length)."""

    def __init__(self, slices_of: dict[int, int], place: dict[tuple[int, int], int], blocks: np.ndarray):
        self._slices, self._place, self._blocks = slices_of, place, blocks

    def holds(self, h: np.ndarray, length: int) -> np.ndarray:
        """Whether the words of ``length`` with these hashes may be among those of this broadcast."""
        if length not in self._slices:
            return np.zeros(h.shape, bool)
        n = self._slices[length]
        at = np.array([self._place.get((length, k), -1) for k in range(n)])
        h = mix64(h)
        where = at[_slice(h, n)] if n > 1 else np.full(h.shape, at[0])
        mask = _mask(h)
        block = self._blocks[np.maximum(where, 0) * SLICE_BLOCKS + (h & np.uint64(SLICE_BLOCKS - 1)).astype(np.int64)]
        return (block & mask == mask) & (where >= 0)


def _slice(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(14)) & np.uint64((1 << 26) - 1)).astype(np.int64) % n


def _filter_bits(words: DataFrame, slices_of: dict[int, int]) -> DataFrame:
    """(length, slice, bits): the filter of every slice of the vocabulary, as bytes."""
    schema = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("slice", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("bit", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for w in batch.column(0).to_pylist():
                by_length.setdefault(len(w), []).append(w)
            for length, found in by_length.items():
                h = mix64(_hashes(_codes(found, length)))
                at = (h & np.uint64(SLICE_BLOCKS - 1)).astype(np.int64) * 64
                bits = np.concatenate([at + ((h >> np.uint64(s)) & np.uint64(63)).astype(np.int64) for s in (58, 52, 46, 40)])
                part = np.tile(_slice(h, slices_of[length]), 4)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), length, np.int32)), pa.array(part.astype(np.int32)), pa.array((bits >> 15).astype(np.int32)), pa.array(bits & 32767)], names=schema.names)

    each = words.select("word").mapInArrow(run, schema)
    return each.groupBy("length", "slice", "piece").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _broadcasts(words: DataFrame) -> Iterator[Filters]:
    """Filters of the whole vocabulary, as many slices at a time as one broadcast takes."""
    counts = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    slices_of = {length: -(-n * WORD_BITS // (SLICE_BLOCKS * 64)) for length, n in counts.items()}
    todo = [(length, k) for length in sorted(slices_of) for k in range(slices_of[length])]
    bits = _filter_bits(words, slices_of)
    if len(todo) > SLICES:
        bits = cut(bits)
    for start in range(0, len(todo), SLICES):
        chosen = todo[start : start + SLICES]
        place = {s: i for i, s in enumerate(chosen)}
        blocks = np.zeros((len(chosen), SLICE_BLOCKS), np.uint64)
        wanted = F.array(*(F.lit(length * (1 << 32) + k) for length, k in chosen))
        # One broadcast's pieces, of fixed size in all.
        for r in bits.filter(F.array_contains(wanted, F.col("length").cast("long") * (1 << 32) + F.col("slice"))).collect():
            got = np.frombuffer(r["bits"], np.uint64)
            blocks[place[r["length"], r["slice"]], r["piece"] * len(got) : (r["piece"] + 1) * len(got)] = got
        yield Filters({length: slices_of[length] for length, _ in chosen}, place, blocks.ravel())


def _candidates(words: DataFrame, filters, letters: np.ndarray) -> DataFrame:
    """(word, n, other): edits of every word that the filters hold."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("other", T.StringType())])

    def found(words: list[str], counts: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
        known = filters.value
        codes, powers = _codes(words, length), _powers(length)
        each = _LETTER_HASH[codes] * powers
        whole = each.sum(axis=1, dtype=np.uint64)
        # A letter less: what follows it moves one place to the front.
        upto = np.cumsum(each, axis=1, dtype=np.uint64)
        less = upto - each + (whole[:, None] - upto) * np.uint64(_BACK)
        hit = known.holds(less, length - 1)
        hit[:, 1:] &= codes[:, 1:] != codes[:, :-1]
        row, at = np.nonzero(hit)
        others = [words[r][:k] + words[r][k + 1 :] for r, k in zip(row.tolist(), at.tolist(), strict=True)]
        yield made(words, counts, row, others)
        # A greater letter in place of another.
        put = (_LETTER_HASH[letters][None, :] * powers[:, None])[None, :, :]
        hit = known.holds(whole[:, None, None] - each[:, :, None] + put, length)
        hit &= letters[None, None, :] > codes[:, :, None]
        row, at, which = np.nonzero(hit)
        others = [words[r][:k] + chr(c) + words[r][k + 1 :] for r, k, c in zip(row.tolist(), at.tolist(), letters[which].tolist(), strict=True)]
        yield made(words, counts, row, others)

    def made(words, counts, row, others):
        return pa.RecordBatch.from_arrays([pa.array([words[r] for r in row.tolist()], pa.string()), pa.array(counts[row], pa.int64()), pa.array(others, pa.string())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[tuple[str, int]]] = {}
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_length.setdefault(len(w), []).append((w, n))
            for length, rows in by_length.items():
                step = max(1, PROBES // (length * max(1, len(letters))))
                for k in range(0, len(rows), step):
                    some = rows[k : k + step]
                    yield from found([w for w, _ in some], np.array([n for _, n in some], np.int64), length)

    return words.select("word", "n").mapInArrow(run, schema)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all near pairs of a vocabulary (word, n), each from both sides."""
    spark = words.sparkSession
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()
    letters = np.array(sorted(ord(r["c"]) for r in letters if r["c"]), np.uint8)
    parts = None
    for filters in _broadcasts(words):
        found = _candidates(words, spark.sparkContext.broadcast(filters), letters)
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    pairs = parts.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    ends = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return pairs.select(F.explode(ends).alias("e")).select("e.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): the end of the way from form to form, by doubling the steps.

    A form has many times the count of its word, so there are no circles, and a way of any length ends in few rounds.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")))
        now = moved.select("word", "root")
        if moved.filter("more").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text) that is long and frequent enough.

    ``form`` is the near word of largest count (ties: first in code-point order) where that is ``FORM_TIMES`` times the
    word's or more, else null, ``form_n`` its count, ``root`` the last form on the way from form to form, the word itself
    where there is none, ``n_near`` the number of near words. Null and empty texts have no words, rows that repeat count
    each time, columns besides doc_id and text are not read, and an empty table gives an empty one.
    """
    path = new_path(docs.sparkSession, "vocabulary")
    count_words(docs).filter(F.col("n") >= MIN_COUNT).write.parquet(path)
    words = docs.sparkSession.read.schema("word string, n long").parquet(path)
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    often: Column = -F.col("best.minus") >= FORM_TIMES * F.col("n")
    out = cut(out.select("word", F.when(often, F.col("best.form")).alias("form"), "n", "n_near", F.when(often, -F.col("best.minus")).alias("form_n")))
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
