"""Document fingerprints by randomised edit embedding (operator 7).

All texts are walked with the same random bits: at each step the character under the cursor is written to the embedded
text, and the bit of that step and character tells whether the cursor moves on. Texts that differ by few edits fall back
into step soon after each, so their edit distance becomes a Hamming distance. The fingerprint holds the embedded text at
positions drawn with random priorities: of two embedded texts, the shorter's positions are the longer's where they fit,
so equal symbols at equal positions estimate likeness at any length. Bands of positions find candidates, the whole
fingerprints verify them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, cut, slices, strings
from .components import components

#: Positions in a fingerprint, one byte each.
SAMPLES = 64
#: Steps after which the random bits repeat, and classes that characters are hashed to.
PERIOD, CLASSES = 4096, 256
#: Characters whose hash is the symbol at a position.
GRAM = 3
#: Characters that one task walks together, about.
WALK_CHARS = 6_000_000
#: With so few texts left, each is walked alone.
FEW = 8
#: Fingerprints of one bucket that are compared with another such block in one task, about.
BLOCK = 8192
_SEED = 20_240_607


@lru_cache(maxsize=1)
def _steps() -> np.ndarray:
    """CLASSES times the steps that a character of a class takes, by (step modulo PERIOD, class)."""
    bits = np.random.default_rng(_SEED).random((PERIOD, CLASSES)) < 0.5
    steps = np.ones((2 * PERIOD, CLASSES), np.int64)
    for at in range(2 * PERIOD - 2, -1, -1):
        steps[at] = np.where(bits[at % PERIOD], 1, steps[at + 1] + 1)
    return (steps[:PERIOD] * CLASSES).ravel()


@lru_cache(maxsize=1)
def _positions() -> list[np.ndarray]:
    """For each sample the positions that have the least priority so far, up to 2**48; that of a text is the last within it."""
    rng = np.random.default_rng(_SEED + 1)
    out = []
    for _ in range(SAMPLES):
        at, least, found = 0, rng.random(), [0]
        while at < 1 << 48:
            at += int(rng.geometric(max(least, 1e-16)))
            least *= rng.random()
            found.append(at)
        out.append(np.array(found))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _hash(code: np.ndarray) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)


def walk(classes: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, the step after which the cursor has left each of its characters."""
    order = sorted(range(len(classes)), key=lambda i: -len(classes[i]))
    size = np.array([len(classes[i]) for i in order], np.int64)
    steps, mask = _steps(), PERIOD * CLASSES - 1
    longest = int(size[0]) if len(size) else 0
    active = len(size) - np.searchsorted(size[::-1], np.arange(longest), side="right")
    base = np.concatenate([[0], np.cumsum(active)])
    # Character i of all texts that have one lies together.
    flat = np.zeros(int(base[-1]), np.int64)
    for rank, i in enumerate(order):
        flat[base[: len(classes[i])] + rank] = classes[i]
    left = np.zeros_like(flat)
    place, step = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    now = np.zeros(len(size), np.int64)
    together = int(np.searchsorted(-active, -FEW, side="left")) if longest else 0
    for i in range(together):
        a, b = int(active[i]), int(base[i])
        t, s = place[:a], step[:a]
        np.bitwise_and(now[:a], mask, out=t)
        np.add(t, flat[b : b + a], out=t)
        np.take(steps, t, out=s)
        now = np.add(now[:a], s, out=left[b : b + a])
    plain = steps.tolist() if together < longest else []
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(classes)
    for rank, i in enumerate(order):
        n = len(classes[i])
        own = left[base[:n] + rank]
        if n > together:
            at = int(own[together - 1]) if together else 0
            rest = []
            for c in classes[i][together:].tolist():
                at += plain[(at & mask) + c]
                rest.append(at)
            own[together:] = rest
        out[i] = own // CLASSES
    return out


def fingerprints(codes: list[np.ndarray]) -> np.ndarray:
    """One row of SAMPLES bytes for each text of code points; an empty text has zeros."""
    classes = [_hash(c) for c in codes]
    out = np.zeros((len(codes), SAMPLES), np.uint8)
    places = _positions()
    for i, (left, c) in enumerate(zip(walk(classes), codes, strict=True)):
        if not len(left):
            continue
        at = np.array([p[np.searchsorted(p, left[-1]) - 1] for p in places])
        char = np.searchsorted(left, at, side="right")
        gram = np.zeros(SAMPLES, np.uint64)
        for k in range(GRAM):
            gram = gram * np.uint64(0x100000001B3) + np.where(char + k < len(c), c[np.minimum(char + k, len(c) - 1)], 0).astype(np.uint64) + np.uint64(1)
        out[i] = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)).astype(np.uint8) + 1
    return out


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """Add the fingerprint of the whole text as lower-case hex; null texts are empty, rows stay as they are."""

    def make():
        return lambda texts: [pa.array([r.tobytes().hex() for r in fingerprints([_codes(t) for t in strings(texts)])], pa.string())]

    return add_columns(docs, make, [text], [T.StructField(name, T.StringType())], keep)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Part of the positions with equal symbols, row by row."""
    return (a == b).mean(axis=1)


_EDITED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def against_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document, and how like they are.

    The next document is that of the next smaller id; after the last one comes the first. The edit replaces the last half
    (rounded down) of the code points by as many of the next text's first ones, or all of them. Null ids come last; rows
    that share an id follow each other by text. A single row is next to itself; an empty table gives an empty one.

    Texts are dealt once, to ranges of ids with the range's next document behind it, so no text goes elsewhere whole.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), key.alias("key"))
    cuts = sorted(set(base.approxQuantile("key", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    bounds = F.array(*(F.lit(int(c)) for c in cuts)).cast("array<bigint>")
    base = base.withColumn("range", F.size(F.filter(bounds, lambda b: b > F.col("key"))))
    # One row for each range.
    tops = base.select("range", "key").groupBy("range").agg(F.max("key").alias("top")).orderBy("range").collect()
    before = {tops[(i + 1) % len(tops)]["top"]: r["range"] for i, r in enumerate(tops)}
    behind = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map().cast("map<bigint,int>")
    guests = base.filter(F.col("key").isin(list(before))).withColumn("range", behind[F.col("key")]).withColumn("guest", F.lit(1))
    rows = base.withColumn("guest", F.lit(0)).unionByName(guests).repartitionById(n, "range")
    rows = rows.sortWithinPartitions("range", "guest", F.desc("key"), "text")

    def made(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows for all texts but the last, which is next to the one before."""
        codes = [_codes(t) for t in texts]
        edited, digests = [], []
        for t, u, c, d in zip(texts, texts[1:], codes, codes[1:]):  # noqa: B905 - the last has no next
            half = len(c) // 2
            edited.append(np.concatenate([c[: len(c) - half], d[:half]]))
            digests.append(hashlib.sha256((t[: len(t) - half] + u[:half]).encode("utf-8", "surrogatepass")).hexdigest())
        prints = fingerprints([*codes, *edited])
        own, other = prints[: len(texts)], prints[len(texts) :]
        columns = [ids[:-1], [len(c) for c in codes[:-1]], digests, [r.tobytes().hex() for r in own[:-1]], [r.tobytes().hex() for r in other], likeness(own[:-1], other), likeness(own[:-1], own[1:])]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_EDITED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        held, at, done = 0, None, False
        for batch in batches:
            for part in slices(batch):
                for r in part.to_pylist():
                    if r["range"] != at:
                        if len(texts) > 1:
                            yield made(ids, texts)
                        ids, texts, held, at, done = [], [], 0, r["range"], False
                    if done:
                        continue
                    ids.append(r["doc_id"])
                    texts.append(r["text"] or "")
                    held += 2 * len(texts[-1])
                    done = bool(r["guest"])
                    if held > WALK_CHARS and len(texts) > 1:
                        yield made(ids, texts)
                        ids, texts = ids[-1:], texts[-1:]
                        held = 2 * len(texts[0])
        if len(texts) > 1:
            yield made(ids, texts)

    return rows.select("doc_id", "text", "range", "guest").mapInArrow(run, _EDITED)


def _linked(least: int):
    """For one pair of blocks of a bucket: links (u, v) that join its groups as far as verified likeness does."""

    def work(rows: pa.Table) -> pa.Table:
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        prints = np.frombuffer(b"".join(rows.column("print").to_pylist()), np.uint8).reshape(-1, SAMPLES)
        own, block = np.array(rows.column("group")), np.array(rows.column("block"))
        label = own.copy()
        u, v = [], []
        for r in np.flatnonzero(block == i):
            others = np.flatnonzero((label != label[r]) & (block == j))
            near = others[(prints[others] == prints[r]).sum(axis=1) >= least]
            # Each group once: what is linked now is one group from here on, so links stay fewer than rows.
            found, first = np.unique(label[near], return_index=True)
            u += [own[r]] * len(found)
            v += own[near[first]].tolist()
            label[np.isin(label, found)] = label[r]
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return work


def groups(prints: DataFrame, least: float = 0.8, bands: int = 16, block: int = BLOCK) -> DataFrame:
    """(fingerprint, group_id) for each different fingerprint of rows (doc_id, fingerprint).

    ``group_id`` is the smallest id that links reach; a link joins fingerprints with at least ``least`` equal positions, and
    equal ones are one from the start. It is null where no row of the group has an id; null fingerprints are left out.

    Fingerprints equal in a whole band of sampled positions are candidates. More bands than positions may differ are needed
    (else ValueError), so that every link has a band in common. Each band's bucket is first held against its least
    fingerprint, which costs its rows. Where the rest of a bucket is still in several groups, it is compared block by block,
    each row sent once for each block of the bucket; a task holds two blocks, whatever the bucket.
    """
    need = math.ceil(least * SAMPLES - 1e-9)
    if SAMPLES % bands or SAMPLES - need >= bands:
        raise ValueError(f"{bands} bands of {SAMPLES} positions cannot find every link of {least}")
    classes = prints.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    # Numbers are stored with their fingerprints, so buckets are pairs of two numbers; only candidates get their bytes back.
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), F.unhex("fingerprint").alias("print"), "rep"))
    width = SAMPLES // bands
    each = classes.select("node", F.explode(F.array(*(F.xxhash64(F.lit(k), F.substring("print", k * width + 1, width)) for k in range(bands)))).alias("key"))
    hubs = each.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    spokes = cut(each.join(hubs, "key").filter("node <> hub"))
    known = classes.select("node", "print")
    pairs = spokes.select("node", "hub").distinct().join(known, "node").join(known.select(F.col("node").alias("hub"), F.col("print").alias("other")), "hub")
    at = lambda c, i: F.substring(F.col(c), i + 1, F.lit(1))
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: at("print", i) == at("other", i)))
    near_hubs = cut(components(pairs.filter(equal >= need).select(F.col("node").alias("u"), F.col("hub").alias("v"))))
    # The hubs are done; of the rest, only buckets of several groups can hold a link that is not known.
    rest = spokes.filter("n > 2").drop("hub", "n").join(near_hubs, "node", "left")
    rest = rest.withColumn("group", F.coalesce("component", "node"))
    unsettled = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("a"), F.max("group").alias("b")).filter("a < b")
    rest = rest.join(unsettled.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "key")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(known, "node")
    rest = rest.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "group", "print")
    more = rest.groupBy("key", "i", "j").applyInArrow(_linked(need), "u long, v long")
    reached = components(near_hubs.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    named = classes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("group_id"))
    return named.select(F.lower(F.hex("print")).alias("fingerprint"), "component").join(least_id, "component").select("fingerprint", "group_id")


def near_groups(prints: DataFrame, least: float = 0.8, bands: int = 16, block: int = BLOCK) -> DataFrame:
    """(doc_id, group_id) for rows (doc_id, fingerprint) with both, by ``groups``; rows without id take part in links."""
    named = groups(prints, least, bands, block)
    return prints.filter("doc_id is not null").select("doc_id", "fingerprint").join(named, "fingerprint").select("doc_id", "group_id")
