"""Exact similarity join on word n-grams by filtering under several global orders (operator 9).

Two sets of Jaccard similarity t share a token among the first floor((1 - t) n) + 1 of each, whatever the global order of
tokens. Two orders are used, both rare tokens first, with different ties, so that a prefix is mostly tokens that no other
document has. A pair is a candidate when it shares a prefix token under both orders; only candidates are verified, on the
whole sets. Texts with one set are one class throughout.

Sets that share a rare prefix token are listed as pairs, order by order, and the lists are intersected. What frequent
prefix tokens join is not listed: sets that these reach from each other under both orders are one part, and parts are
compared block by block, where the same test on prefix tokens goes before the whole sets. Listed candidates travel once
to their own component of candidates, not once for each pair.

Frequencies are counted over all documents, for a fixed part of all tokens that every order puts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, cut_clean, new_path, release, slices
from .components import components

#: The tokens that come first in every order, rare before frequent, are so many times what a prefix takes of all.
FIRST_TIMES = 1.6
#: Sets that share a prefix token are listed as pairs where so many sets have the token at most; beyond, they are one part.
RARE = 32
#: Tokens and sets that a block of a part may hold, about; larger parts are compared block by block.
BLOCK_TOKENS, BLOCK_SETS = 1 << 19, 4096
#: Bits of the map by which texts that take no part are left out before the others are dealt; 8 MB, whatever the corpus.
TEXT_MAP_BITS = 1 << 26
#: Bits of the parity maps by which unlike pairs are told without reading their sets.
MAP_BITS = 1024
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word n-grams of texts, as sorted 64-bit hashes. Words are what lies between blanks, A-Z in lower case."""

    def __init__(self, words: int):
        self._n = words

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = min(self._n, len(h))
        rows = len(h) - n + 1
        out = np.full(rows, n, np.uint64)
        for k in range(n):
            out = mix64(out * _M1 + h[k : k + rows])
        return np.unique(out)


def prefix_size(n: int, num: int, den: int) -> int:
    """Tokens of a set of n among which one is shared with any set of similarity num / den or more."""
    return n - -(-num * n // den) + 1


def first_sixteenths(num: int, den: int) -> int:
    """Tokens whose lowest 4 bits are below this come first: a part of all that leaves room to pass over frequent ones."""
    return max(1, min(16, round(16 * FIRST_TIMES * (den - num) / den)))


def _summaries(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, key (hash of the set; null if empty), n_first, and the tokens that can be in a prefix."""
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("n_first", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.LongType())),
    ]

    sixteenths = np.uint64(first_sixteenths(num, den))

    def make():
        shingles = Shingler(words)

        def work(texts):
            sizes, keys, firsts, tokens = [], [], [], []
            for text in texts.to_pylist():
                s = shingles(text)
                early = (s & np.uint64(15)) < sixteenths
                first, late = s[early].view(np.int64), s[~early].view(np.int64)
                missing = prefix_size(len(s), num, den) - len(first) if len(s) else 0
                sizes.append(len(s))
                keys.append(_key(s))
                firsts.append(len(first))
                if missing > 0:
                    first = np.concatenate([first, np.sort(late)[:missing]])
                tokens.append(first)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            return [pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(firsts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))]

        return work

    return add_columns(docs, make, ["text"], fields, keep=["doc_id"])


def _key(s: np.ndarray) -> int | None:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64)) if len(s) else None


def _prefixes(rows: DataFrame, num: int, den: int) -> DataFrame:
    """key, n and both prefixes (token, df), as far as other sets have their tokens, of the sets that have such tokens."""
    token = Window.partitionBy("token")
    each = rows.select("key", F.explode("tokens").alias("token"))
    each = each.withColumn("new", F.lag("key").over(token.orderBy("key")).isNull() | (F.lag("key").over(token.orderBy("key")) != F.col("key")))
    each = each.withColumn("df", F.sum(F.col("new").cast("int")).over(token)).filter("new and df > 1")
    first = (F.col("token").bitwiseAND(15) < first_sixteenths(num, den)).cast("int")
    lists = each.withColumn("late", 1 - first).groupBy("key").agg(F.collect_list(F.struct("late", "df", "token")).alias("shared"))
    sizes = rows.groupBy("key").agg(F.max("n_shingles").alias("n"), F.max("n_first").alias("n_first"))
    both = lists.join(sizes, "key")
    # Tokens that no other set has are the rarest: they fill the beginning of the prefix.
    alone = F.col("n_first") - F.size(F.filter("shared", lambda s: s["late"] == 0))
    room = (F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(den)) + 1 - alone).cast("int")
    by_count = lambda s: (s["late"], F.when(s["late"] == 0, s["df"]).alias("d"), s["token"].alias("t"))
    by_scale = lambda s: (s["late"], F.when(s["late"] == 0, F.floor(F.log2(s["df"]))).alias("d"), F.when(s["late"] == 0, F.xxhash64(s["token"])).otherwise(s["token"]).alias("t"))

    def prefix(order) -> Column:
        ranked = F.array_sort(F.transform("shared", lambda s: F.struct(*order(s), s["token"], s["df"])))
        return F.transform(F.slice(ranked, F.lit(1), F.col("room")), lambda x: F.struct(x["token"], x["df"]))

    both = both.withColumn("room", room).filter("room > 0")
    return both.select("key", "n", prefix(by_count).alias("prefix0"), prefix(by_scale).alias("prefix1"))


def _each_token(sets: DataFrame, keep: list[str], rare: bool) -> DataFrame:
    """One row for each order, set and prefix token that is rare, or frequent."""
    chosen = lambda c: F.filter(c, lambda x: (x["df"] <= RARE) if rare else (x["df"] > RARE))
    orders = F.array(*(F.struct(F.lit(k).alias("kind"), chosen(f"prefix{k}").alias("prefix")) for k in (0, 1)))
    return sets.select(*keep, F.explode(orders).alias("o")).select(*keep, "o.kind", F.explode("o.prefix.token").alias("token"))


def _with_parts(sets: DataFrame) -> DataFrame:
    """Add part0 and part1: what frequent prefix tokens reach from a set under each order; null where that is nothing."""
    each = _each_token(sets, ["key"], rare=False)
    lists = each.groupBy("kind", "token").agg(F.min("key").alias("v"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    edges = each.join(lists, ["kind", "token"]).select("kind", F.col("key").alias("u"), "v").filter("u <> v").distinct()
    reached = components(edges, by=("kind",)).groupBy(F.col("node").alias("key"))
    part = lambda k: F.max(F.when(F.col("kind") == k, F.col("component"))).alias(f"part{k}")
    return sets.join(reached.agg(part(0), part(1)), "key", "left")


def _listed(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): pairs that share a prefix token under both orders, without those of one part under both.

    Under an order, two sets of one part may share a frequent token, so this order lets their pair pass.
    """
    each = _each_token(sets, ["key", "n", "part0", "part1"], rare=True)
    lists = each.groupBy("kind", "token").agg(F.array_sort(F.collect_list(F.struct("key", "n", "part0", "part1"))).alias("s")).filter(F.size("s") > 1)
    later = lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = lists.select("kind", F.explode(F.flatten(F.transform("s", later))).alias("p"))
    same = [F.coalesce(F.col(f"p.a.part{k}") == F.col(f"p.b.part{k}"), F.lit(False)) for k in (0, 1)]
    alike = (F.col("p.a.n") * den >= F.col("p.b.n") * num) & (F.col("p.b.n") * den >= F.col("p.a.n") * num)
    passed = [(F.col("kind") == k) | same[k] for k in (0, 1)]
    found = pairs.filter(alike & ~(same[0] & same[1])).groupBy(F.col("p.a.key").alias("u"), F.col("p.b.key").alias("v"))
    return found.agg(F.max(passed[0]).alias("in0"), F.max(passed[1]).alias("in1")).filter("in0 and in1").select("u", "v")


def _blocks(sets: DataFrame, group: list[str]) -> DataFrame:
    """Number of blocks of each group of at least two sets (key, n)."""
    sizes = sets.groupBy(*group).agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total")).filter("sets > 1")
    return sizes.select(*group, F.greatest(F.ceil(F.col("total") / BLOCK_TOKENS), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int").alias("blocks"))


def _block(key: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.col("blocks")).cast("int")


#: What a task compares: listed pairs of a component of candidates (``partners``), or all of a part (``partners`` null).
_PLACE = ["part0", "part1", "i", "j"]


def _placed_lists(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Every set of a listed pair at the block pairs where it has one, with its partners there (those of larger key)."""
    reached = cut_clean(components(pairs))
    sized = reached.join(sets.select("key", "n"), F.col("node") == F.col("key")).select("key", "n", "component")
    of = reached.join(_blocks(sized, ["component"]), "component").select("node", "component", "blocks")
    ends = pairs.join(of, F.col("u") == F.col("node")).withColumn("bu", _block("u")).withColumn("bv", _block("v"))
    ends = ends.select("component", F.least("bu", "bv").alias("i"), F.greatest("bu", "bv").alias("j"), F.explode(F.array(F.struct(F.col("u").alias("key"), F.col("v").alias("to")), F.struct(F.col("v").alias("key"), F.lit(None).cast("long").alias("to")))).alias("e"))
    placed = ends.groupBy("component", "i", "j", "e.key").agg(F.collect_list("e.to").alias("partners"))
    nothing = F.lit(None).cast("array<long>")
    return placed.select(F.col("component").alias("part0"), F.lit(None).cast("long").alias("part1"), "i", "j", "key", F.lit(0).alias("side"), "partners", nothing.alias("prefix0"), nothing.alias("prefix1"))


def _placed_parts(sets: DataFrame) -> DataFrame:
    """Every set of a part at the pairs of its own block and each block of the part."""
    own = sets.filter("part0 is not null and part1 is not null")
    placed = own.join(_blocks(own, ["part0", "part1"]), ["part0", "part1"]).withColumn("b", _block("key"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tokens = [F.col(f"prefix{k}.token").alias(f"prefix{k}") for k in (0, 1)]
    return placed.select("part0", "part1", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "key", (F.col("b") > F.col("other")).cast("int").alias("side"), F.lit(None).cast("array<long>").alias("partners"), *tokens)


def _parity(sets: list[np.ndarray]) -> np.ndarray:
    bits = np.zeros((len(sets), MAP_BITS), np.uint8)
    for i, s in enumerate(sets):
        bits[i] = np.bincount((mix64(s) % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS) & 1
    return np.packbits(bits, axis=1).view(np.uint64)


class _Marks:
    """Counts the members that one set shares with others of a block."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        ids = np.unique(flat, return_inverse=True)[1].astype(np.int32)
        self._ids = np.split(ids, np.cumsum([len(s) for s in sets])[:-1])
        self._mark = np.zeros(len(flat) + 1, np.int8)

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        parts = [self._ids[j] for j in others]
        sizes = np.array([len(p) for p in parts])
        out = np.zeros(len(parts), np.int64)
        if sizes.any():
            self._mark[self._ids[i]] = 1
            full = np.flatnonzero(sizes)
            starts = np.cumsum(sizes[full]) - sizes[full]
            out[full] = np.add.reduceat(self._mark[np.concatenate([parts[k] for k in full])], starts, dtype=np.int64)
            self._mark[self._ids[i]] = 0
        return out


def linked(sides: np.ndarray, sets: list[np.ndarray], prefixes: list[list[np.ndarray]], num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of a block, the later ones that it is similar to. With two sides, only pairs across these."""
    n = np.array([len(s) for s in sets])
    maps, members, orders = _parity(sets), _Marks(sets), [_Marks(p) for p in prefixes]
    two = sides.min() != sides.max()
    for i in range(len(sets) - 1):
        others = np.arange(i + 1, len(sets))
        keep = (n[others] * den >= num * n[i]) & (n[i] * den >= num * n[others])
        if two:
            keep &= sides[others] != sides[i]
        others = others[keep]
        # |x ^ y| is at most (1 - t) / (1 + t) (|x| + |y|), and no parity map differs in more bits.
        apart = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
        others = others[apart * (den + num) <= (den - num) * (n[others] + n[i])]
        for order in orders:
            if len(others):
                others = others[order.shared(i, others) > 0]
        if len(others):
            both = members.shared(i, others)
            yield i, others[den * both >= num * (n[others] + n[i] - both)]


def listed_links(sets: list[np.ndarray], partners: list[list[int]], num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, those of its listed partners that it is similar to."""
    for i, others in enumerate(partners):
        if others:
            both = np.array([len(np.intersect1d(sets[i], sets[k], assume_unique=True)) for k in others])
            total = np.array([len(sets[k]) for k in others]) + len(sets[i])
            yield i, np.array(others)[den * both >= num * (total - both)]


class _Row(NamedTuple):
    """A set at the place where it is compared."""

    place: tuple
    key: int
    side: int
    rep: int
    copies: int
    partners: np.ndarray | None
    prefix0: np.ndarray | None
    prefix1: np.ndarray | None
    members: np.ndarray


def _arrays(column: pa.ListArray) -> list[np.ndarray | None]:
    """The rows of a list column as arrays of their own, without nulls inside."""
    return [None if not x.is_valid else x.values.drop_null().to_numpy(zero_copy_only=False).copy() for x in column]


_FOUND = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("n", T.LongType())])


def _verify(rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links among rows (_PLACE, key, side, partners, prefix0, prefix1, rep, copies, text).

    Gives (u, v, null) for a forest of links in each task's group, one for each merge at most, and (u, null, n) with the
    number of documents that u is linked with. Texts of another set than ``key`` (ids may repeat) are passed over.
    """
    columns = [*_PLACE, "key", "side", "partners", "prefix0", "prefix1", "rep", "copies", "text"]

    def links(rows: list[_Row]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        root = list(range(len(rows)))

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = a = root[root[a]]
            return a

        copies = np.array([r.copies for r in rows])
        count = np.zeros(len(rows), np.int64)
        sets = [r.members for r in rows]
        if rows[0].partners is not None:
            at = {r.key: i for i, r in enumerate(rows)}
            found = listed_links(sets, [[at[k] for k in r.partners.tolist()] for r in rows], num, den)
        else:
            sides = np.array([r.side for r in rows])
            # Pairs of one side belong to the block itself, where they are counted.
            if rows[0].place[2] != rows[0].place[3] and sides.min() == sides.max():
                return
            found = linked(sides, sets, [[r.prefix0 for r in rows], [r.prefix1 for r in rows]], num, den)
        for i, others in found:
            count[i] += copies[others].sum()
            count[others] += copies[i]
            for k in others:
                a, b = find(i), find(int(k))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    yield rows[i].rep, rows[k].rep, None
        for i in np.flatnonzero(count):
            yield rows[i].rep, None, int(count[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        held: list[_Row] = []
        out: list[tuple] = []
        for batch in batches:
            for part in slices(batch):
                column = lambda name: part.column(columns.index(name))  # noqa: E731, B023
                places = list(zip(*(column(c).to_pylist() for c in _PLACE), strict=True))
                keys, sides, reps, copies = (column(c).to_pylist() for c in ("key", "side", "rep", "copies"))
                arrays = [_arrays(column(c)) for c in ("partners", "prefix0", "prefix1")]
                for k, place in enumerate(places):
                    if held and held[0].place != place:
                        out += links(held)
                        held = []
                    members = shingles(column("text")[k].as_py())
                    if _key(members) == keys[k] and not (held and held[-1].key == keys[k]):
                        held.append(_Row(place, keys[k], sides[k], reps[k], copies[k], *(a[k] for a in arrays), members))
                if len(out) > 10_000:
                    yield _rows(out)
                    out = []
        out += links(held)
        held = []
        if out:
            yield _rows(out)
        release()

    def _rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v", "n"])

    return rows.select(*columns).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "key").mapInArrow(run, _FOUND)


def similarity_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of documents (doc_id, text) under links of Jaccard >= num / den.

    A text with fewer than ``words`` words is one shingle, one without words has none and is linked with nothing. The
    component is the smallest id that links reach, n_links the number of other documents that one is linked with. One row
    for each row of ``docs``; rows repeated under one id count as copies of each other. Rows with a null id take no part:
    their component is null. An empty table gives an empty one. Copies, however many, are one set in all comparisons.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "text")
    path = new_path(spark, "shingles")
    _summaries(base, words, num, den).write.parquet(path)
    summaries = spark.read.parquet(path)
    known = summaries.filter("key is not null and doc_id is not null")
    sets = cut_clean(_with_parts(cut_clean(_prefixes(known, num, den))))
    pairs = cut_clean(_listed(sets, num, den))
    placed = cut_clean(_placed_lists(pairs, sets).unionByName(_placed_parts(sets)))

    classes = known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    rows = placed.join(classes, "key")
    texts = _among(base, classes.join(placed.select("key").distinct(), "key", "left_semi").select("rep"))
    found = cut_clean(_verify(rows.join(texts, F.col("rep") == F.col("doc_id")), words, num, den))

    reached = components(found.filter("v is not null").select("u", "v"))
    links = found.filter("n is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    named = classes.join(reached.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    named = named.select("key", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = summaries.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    alone = F.col("key").isNull() | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is among ``ids`` (rep), and few others.

    The ids set bits of a map of fixed size, which is broadcast in pieces. What shares a bit passes too; a join decides.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(TEXT_MAP_BITS))
    piece, bit = (lambda p: F.shiftright(p, 15)), (lambda p: p.bitwiseAND(32767))
    pieces = ids.groupBy(piece(place("rep")).alias("_piece")).agg(F.bitmap_construct_agg(bit(place("rep"))).alias("_bits"))
    found = docs.join(F.broadcast(pieces), piece(place("doc_id")) == F.col("_piece"))
    at = bit(place("doc_id"))
    byte = F.conv(F.hex(F.substr("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.filter(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1).drop("_piece", "_bits")


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that links join to a smaller id; of rows repeated under one id, one stays. Columns stay."""
    found = similarity_join(docs, words, num, den)
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    unknown = docs.filter("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]).unionByName(unknown)
