"""Periodic runs of words, and texts without their repetitions (operator 11).

A run is a stretch of words with a smallest period that no neighbouring word extends. Every run holds Lyndon words of the
length of its period under one of two orders of words that are each other's reverse, and each of these is the longest
Lyndon word from its place. The lengths of the longest Lyndon words come from phase one of Baier's grouping suffix sort,
once for each order; what lies a period apart is then extended to both sides by longest common extensions.

Only stretches that can hold a run are sorted: in a run of L words with L / period >= e, the first L - L / e words come
again a period later, so stretches where no word sequence of that length comes again are left out. This loses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns
from .jaccard import mix64

#: Shortest run, in words, and how often a run holds its period at least.
MIN_WORDS, MIN_TIMES = 24, 3
_M1 = np.uint64(0x9E3779B97F4A7C15)
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def lyndon_lengths(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word from each place, by phase one of Baier's grouping suffix sort.

    Suffixes are grouped by their first code. From the highest group down, every suffix of a group points to the nearest
    place before it whose group is lower. A suffix to which l suffixes point gets l times the group's word behind its own,
    and leaves its group for a new one just above it. What a suffix has as its word in the end is its longest Lyndon word.
    """
    n = len(codes)
    members: list[list[int]] = []
    group, length = [0] * n, [1] * n
    for rank, places in enumerate(_by_code(codes)):
        members.append(places)
        for i in places:
            group[i] = rank
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    # lower[i + 1]: a place, counted from 1, at or before i that no handled group holds; 0 where there is none.
    lower = list(range(n + 1))
    at = len(members) - 1
    while at >= 0:
        here = [i for i in members[at] if group[i] == at]
        members[at] = here
        for i in here:
            lower[i + 1] = i
        if here:
            word, pointed = length[here[0]], {}
            for i in here:
                p = lower[i]
                while lower[p] != p:
                    lower[p] = lower[lower[p]]
                    p = lower[p]
                lower[i + 1] = p
                if p:
                    pointed[p - 1] = pointed.get(p - 1, 0) + 1
            for times, old, moved in _subsets(pointed, group):
                for j in moved:
                    length[j] += times * word
                if len(moved) < size[old]:
                    new = len(members)
                    members.append(moved)
                    size.append(len(moved))
                    size[old] -= len(moved)
                    for j in moved:
                        group[j] = new
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up < len(below) - 1:
                        below[up] = new
        at = below[at]
    return length


def _by_code(codes: list[int]) -> list[list[int]]:
    places: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        places.setdefault(c, []).append(i)
    return [places[c] for c in sorted(places)]


def _subsets(pointed: dict[int, int], group: list[int]) -> list[tuple[int, int, list[int]]]:
    """(times, group, places) of what was pointed to, most times first."""
    if len(pointed) == 1:
        ((j, times),) = pointed.items()
        return [(times, group[j], [j])]
    found: dict[tuple[int, int], list[int]] = {}
    for j, times in pointed.items():
        found.setdefault((times, group[j]), []).append(j)
    return [(times, old, found[times, old]) for times, old in sorted(found, reverse=True)]


class Extensions:
    """Longest common extensions of places, by fingerprints of all blocks of 1, 2, 4, ... codes."""

    def __init__(self, codes: np.ndarray):
        self._n = len(codes)
        self._levels = [mix64(codes.astype(np.uint64) + _M1)]
        while 2 << (len(self._levels) - 1) <= self._n:
            last, half = self._levels[-1], 1 << (len(self._levels) - 1)
            self._levels.append(mix64(last[:-half] * _M1 + mix64(last[half:])))

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Codes that agree from i and from j on; i < j."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self._levels) - 1, -1, -1):
            level = self._levels[k]
            fits = np.flatnonzero(j + done + (1 << k) <= self._n)
            same = fits[level[i[fits] + done[fits]] == level[j[fits] + done[fits]]]
            done[same] += 1 << k
        return done

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Codes that agree just before i and just before j; i < j."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self._levels) - 1, -1, -1):
            level = self._levels[k]
            fits = np.flatnonzero(i - done - (1 << k) >= 0)
            same = fits[level[i[fits] - done[fits] - (1 << k)] == level[j[fits] - done[fits] - (1 << k)]]
            done[same] += 1 << k
        return done


def _stretches(codes: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Stretches, as (start, end), outside which no ``words`` codes in a row come again later."""
    n = len(codes)
    if n <= words:
        return []
    grams, width = mix64(codes.astype(np.uint64) + _M1), 1
    while width < words:
        step = min(width, words - width)
        grams = mix64(grams[:-step] * _M1 + mix64(grams[step:]))
        width += step
    order = np.argsort(grams, kind="stable")
    again = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if not len(again):
        return []
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, order[again], 1)
    np.add.at(delta, order[again + 1] + words, -1)
    covered = np.concatenate([[0], np.cumsum(delta[:-1]) > 0, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(covered))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def runs_of(codes: np.ndarray, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> np.ndarray:
    """(start, length, period) rows, by start and then period, of all runs that are long and periodic enough."""
    found = [np.zeros((0, 3), np.int64)]
    for start, end in _stretches(codes, min_words - min_words // min_times):
        if end - start >= min_words:
            part = _stretch_runs(np.unique(codes[start:end], return_inverse=True)[1], min_words, min_times)
            found.append(part + np.array([start, 0, 0]))
    return np.concatenate(found)


def _stretch_runs(codes: np.ndarray, min_words: int, min_times: int) -> np.ndarray:
    n, extend = len(codes), Extensions(codes)
    pairs = []
    for order in (codes, codes.max() - codes):
        period = np.array(lyndon_lengths(order.tolist()), np.int64)
        at = np.flatnonzero((period * min_times <= n) & (np.arange(n) + period < n))
        if min_times > 2:
            # A run that holds its period three times has a Lyndon word that is followed by itself.
            at = at[codes[at] == codes[at + period[at]]]
        pairs.append(np.stack([at, period[at]]))
    i, p = np.concatenate(pairs, axis=1)
    more = extend.after(i, i + p)
    if min_times > 2:
        i, p, more = (x[more >= p] for x in (i, p, more))
    back = extend.before(i, i + p)
    runs = np.unique(np.stack([i - back, back + p + more, p], axis=1), axis=0)
    runs = runs[(runs[:, 1] >= min_words) & (runs[:, 1] >= min_times * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Words that no run holds after its first period."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, runs[:, 0] + runs[:, 2], 1)
    np.add.at(delta, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(delta[:-1]) == 0


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES, keep: list[str] | None = None) -> DataFrame:
    """Add runs (array of start, length, period, by start and then period) and collapsed (the words that are left).

    Words are what lies between ASCII white space in ``text``, numbered from 0; a null text has none. A run has
    ``min_words`` words and ``min_times`` periods (2 or more) at least; a word goes if any run holds it after that run's
    first period. Texts without runs have an empty array and their words joined by one space. Each row stands alone: rows
    may repeat, ids may be null, nothing is shuffled, and an empty table gives an empty one. A column of ``docs`` that is
    named runs or collapsed is replaced.
    """
    if min_times < 2 or min_words <= min_times:
        raise ValueError("a run holds its period twice at least, and more words than periods")
    fields = [T.StructField("runs", RUNS, False), T.StructField("collapsed", T.StringType(), False)]

    def make():
        def work(texts):
            offsets, rows, left = [0], [], []
            for text in texts.to_pylist():
                words = (text or "").encode().split()
                runs = np.zeros((0, 3), np.int64)
                if len(words) >= min_words:
                    number: dict[bytes, int] = {}
                    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
                    if len(number) < len(words):
                        runs = runs_of(codes, min_words, min_times)
                if len(runs):
                    rows.append(runs)
                    words = [words[k] for k in np.flatnonzero(_kept(len(words), runs)).tolist()]
                left.append(b" ".join(words).decode())
                offsets.append(offsets[-1] + len(runs))
            flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
            values = pa.StructArray.from_arrays([pa.array(flat[:, k].copy(), pa.int64()) for k in range(3)], ["start", "length", "period"])
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(left, pa.string())]

        return work

    return add_columns(docs, make, ["text"], fields, keep)


def with_periodic_tail(docs: DataFrame) -> DataFrame:
    """Texts of every tenth document, by crc32 of its id, with a tail that repeats: what the query looks for besides."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("_words").cast("long"), F.floor(F.col("_h") / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    tail = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))).cast("int"))))
    chosen = docs.select("doc_id", "text", h.alias("_h")).withColumn("_words", F.when((F.col("_h") % 10 == 0) & (F.length("text") > 0), words))
    chosen = chosen.withColumn("_a", a).withColumn("_p", p)
    return chosen.select("doc_id", F.when(F.size("_words") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run that holds its period most often; of equal ones the first, then that of the least period."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))
