"""Resampling inference: bootstraps by points and by cells, paired tests, corrections and verdicts.

A replicate gives every unit (a point or a cell) a Poisson weight of mean 1, which is what drawing n of n units with
replacement tends to. The weight is a fixed function of unit and replicate, so it is worked out beside each row, in any
engine alike: no draw is a row, nothing is joined or broadcast, and rows of one unit agree wherever they lie.

Areas of all replicates come from one pass over rows in order of score: tasks sum blocks of rows, and blocks are then
strung together by carried sums. No task holds more than a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import metrics
from .near import tasks

#: Weights come from squares modulo a prime; what a unit and a replicate are multiplied with. Fixed values.
PRIME, OF_UNIT, OF_REPLICATE = 2147483647, 48271, 69621
#: Borders of the weights 0, 1, 2, ... on the scale of the prime.
BORDERS = [math.ceil(PRIME * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(10)]
#: Rows of a block, and rows whose weights are worked out at once: few, so that all replicates of them stay in a core's cache.
BLOCK_ROWS, ROWS_AT_ONCE = 1 << 15, 32


class _Weigher:
    """Weights of a few units in all replicates from ``first`` to ``last`` - 1, in buffers that are used again."""

    def __init__(self, first: int, last: int):
        shape = (ROWS_AT_ONCE, last - first)
        self._replicates = np.arange(first, last, dtype=np.uint64)
        self._of_replicate = self._replicates * np.uint64(OF_REPLICATE) % np.uint64(PRIME)
        self._x0, self._x, self._y = (np.empty(shape, np.uint64) for _ in range(3))
        self._whole, self._over, self._weights = np.empty(shape, np.int32), np.empty(shape, bool), np.empty(shape, np.uint8)

    def __call__(self, units: np.ndarray) -> np.ndarray:
        """One row for each of at most ``ROWS_AT_ONCE`` units; valid until the next call."""
        prime, bits, m = np.uint64(PRIME), np.uint64(PRIME.bit_length()), len(units)
        x0, x, y, whole, over, weights = (b[:m] for b in (self._x0, self._x, self._y, self._whole, self._over, self._weights))
        units = units.astype(np.uint64)[:, None]
        np.add((units * np.uint64(OF_UNIT) + np.uint64(12345)) % prime, self._of_replicate, out=x0)
        # What is below twice the prime: taking the prime away runs around where it is below, so the least is the remainder.
        np.minimum(x0, np.subtract(x0, prime, out=y), out=x0)
        last = x0
        for added in (units, self._replicates, x0):
            np.add(np.multiply(last, last, out=x), added, out=x)
            # The prime is a power of two less one: high bits count as ones.
            np.right_shift(x, bits, out=y)
            np.add(np.bitwise_and(x, prime, out=x), y, out=x)
            last = np.minimum(x, np.subtract(x, prime, out=y), out=x)
        whole[...] = last
        np.greater_equal(whole, np.int32(BORDERS[0]), out=weights.view(bool))
        for border in BORDERS[1:]:
            np.add(weights, np.greater_equal(whole, np.int32(border), out=over).view(np.uint8), out=weights)
        return weights


def replicate_weights(units: np.ndarray, first: int, last: int) -> np.ndarray:
    """Weights of units (numbers below ``PRIME``) in replicates ``first`` to ``last`` - 1: one row for each unit."""
    weigh, out = _Weigher(first, last), np.empty((len(units), last - first))
    for k in range(0, len(units), ROWS_AT_ONCE):
        out[k : k + ROWS_AT_ONCE] = weigh(units[k : k + ROWS_AT_ONCE])
    return out


def _pieces(score: np.ndarray, y: np.ndarray, units: np.ndarray, times: np.ndarray, replicates: int, weigh: _Weigher | None = None) -> list[tuple[float, bool, np.ndarray]]:
    """Sums of a block in order of score (rows that stand for ``times`` rows): its first score's rows, those between, its last score's rows.

    Each piece is (least score, one score only, sums); sums are the replicates' positive weights, negative weights, and
    pairs of a positive above a negative (half where they tie), which are left to later where the score is one only.
    """
    weigh = weigh or _Weigher(0, replicates)
    starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    cuts = [0] if len(starts) == 1 else [0, *([starts[1]] if len(starts) > 2 else []), starts[-1]]
    out = [np.zeros((3, replicates)) for _ in cuts]
    # Rows of one score and label lie side by side, so few sums are made where many tie.
    order = np.lexsort((y, score))
    score, y, units, times = score[order], y[order], units[order], times[order]
    number, several = np.cumsum(np.r_[False, score[1:] != score[:-1]]), bool((times != 1).any())
    last, held, positive, negative = len(starts) - 1, 0, np.zeros(replicates), np.zeros(replicates)

    def close(piece: int, p: np.ndarray, n: np.ndarray) -> None:
        sums = out[piece]
        sums[2] += (p * (sums[1] + np.cumsum(n, axis=0) - n / 2)).sum(axis=0)
        sums[0] += p.sum(axis=0)
        sums[1] += n.sum(axis=0)

    for k in range(0, len(score), ROWS_AT_ONCE):
        here, label = number[k : k + ROWS_AT_ONCE], y[k : k + ROWS_AT_ONCE] == 1
        w = weigh(units[k : k + ROWS_AT_ONCE])
        w = w * times[k : k + ROWS_AT_ONCE, None] if several else w
        edges = np.flatnonzero(np.r_[True, (here[1:] != here[:-1]) | (label[1:] != label[:-1])])
        made = w if len(edges) == len(w) else np.stack([w[i:j].sum(axis=0, dtype=np.float64 if several else np.uint16) for i, j in zip(edges, [*edges[1:], len(w)], strict=True)])
        of, label = here[edges] - held, label[edges]
        p, n = np.zeros((2, of[-1] + 1, replicates))
        p[of[label]], n[of[~label]] = made[label], made[~label]
        p[0] += positive
        n[0] += negative
        # The last score may go on in the next rows.
        positive, negative, done, first, held = p[-1], n[-1], of[-1], int(held == 0), here[-1]
        if done and first:
            close(0, p[:1], n[:1])
        if done > first:
            close(1, p[first:done], n[first:done])
    close(0 if last == 0 else len(cuts) - 1, positive[None], negative[None])
    return [(float(s), last <= 2 or i != 1, sums) for i, (s, sums) in enumerate(zip(score[cuts], out, strict=True))]


_PIECE = [T.StructField("_score", T.DoubleType()), T.StructField("_sums", T.BinaryType())]


def replicate_areas(df: DataFrame, by: list[str], y: str, score: str, unit: Column, replicates: int, name: str = "auroc", shared: bool = False) -> DataFrame:
    """(*by, rep, area under the ROC curve) of every replicate; null where it has one class only.

    ``unit`` numbers what is drawn. Rows are range-partitioned by group and score, ties spread by their unit; what comes
    back of a block are three sums for each replicate. ``shared``: many rows have one unit, so those that also have one score are
    counted first and weighed once.
    """
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in by))
    rows = metrics.finite(df, y, score).select(*by, key.alias("_key"), F.col(score).cast("double").alias("_s"), (F.col(y) == 1).cast("double").alias("_y"), F.pmod(unit.cast("long"), F.lit(PRIME)).alias("_u"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("_m")) if shared else rows.withColumn("_m", F.lit(1.0))
    rows = rows.repartitionByRange(tasks(df.sparkSession), *by, "_s", "_u").sortWithinPartitions("_key", "_s")
    fields = [rows.schema[c] for c in by]
    names = [*by, "_score", "_sums"]

    def sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weigh = _Weigher(0, replicates)

        def flush() -> Iterator[pa.RecordBatch]:
            block = pa.Table.from_batches(held)
            keys = block.column("_key").to_numpy()
            edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
            values = [block.column(c).to_numpy() for c in ("_s", "_y", "_u", "_m")]
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                found = _pieces(*(v[i:j] for v in values), replicates, weigh)
                group = [pa.array([block.column(c)[i].as_py()] * len(found), block.schema.field(c).type) for c in by]
                yield pa.RecordBatch.from_arrays([*group, pa.array([f[0] for f in found], pa.float64()), pa.array([f[2].tobytes() for f in found], pa.binary())], names=names)

        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(k, BLOCK_ROWS)
                if held and sum(b.num_rows for b in held) + part.num_rows > BLOCK_ROWS:
                    yield from flush()
                    held = []
                held.append(part)
        if held:
            yield from flush()

    blocks = rows.mapInArrow(sum_blocks, T.StructType([*fields, *_PIECE]))

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = at = None
        total, same = np.zeros((3, replicates)), np.zeros((3, replicates))

        def close(group: tuple) -> pa.RecordBatch:
            _string(total, same)
            p, n, pairs = total
            values = [v if ok else None for v, ok in zip((pairs / np.maximum(p * n, 1)).tolist(), (p * n > 0).tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([*(pa.array([g] * replicates, t) for g, t in zip(group, types, strict=True)), pa.array(np.arange(replicates)), pa.array(values, pa.float64())], names=[*by, "rep", name])

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            groups = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            for g, s, raw in zip(groups, batch.column("_score").to_pylist(), batch.column("_sums").to_pylist(), strict=True):
                sums = np.frombuffer(raw).reshape(3, replicates)
                if group is not None and g != group:
                    yield close(group)
                    total, same = np.zeros((3, replicates)), np.zeros((3, replicates))
                elif group is not None and s != at:
                    _string(total, same)
                    same = np.zeros((3, replicates))
                # Pieces of one score add up and tie with each other.
                pairs = same[2] + sums[2] + (same[0] * sums[1] + same[1] * sums[0]) / 2
                same = np.stack([same[0] + sums[0], same[1] + sums[1], pairs])
                group, at = g, s
        if group is not None:
            yield close(group)

    strung = blocks.repartition(*by).sortWithinPartitions(*by, "_score") if by else blocks.coalesce(1).sortWithinPartitions("_score")
    return strung.mapInArrow(string, T.StructType([*fields, T.StructField("rep", T.LongType()), T.StructField(name, T.DoubleType())]))


def _string(total: np.ndarray, same: np.ndarray) -> None:
    """Put sums of higher scores behind those of all lower ones."""
    total[2] += same[2] + same[0] * total[1]
    total[0] += same[0]
    total[1] += same[1]


def bootstrap(df: DataFrame, by: list[str], y: str, scores: list[str], unit: Column, replicates: int, shared: bool = False) -> DataFrame:
    """(*by, rep, m_<score> for each of ``scores``): areas of all replicates, on the same weights. Rows of one unit go together."""
    rows, out = metrics.finite(df, y, *scores), None
    for s in scores:
        found = replicate_areas(rows, by, y, s, unit, replicates, name=f"m_{s}", shared=shared)
        out = found if out is None else out.join(found, [*by, "rep"])
    return out


def interval(values: DataFrame, by: list[str], value: str, prefix: str = "") -> DataFrame:
    """Percentile interval, mean and deviation of replicates."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy(*by).agg(q[0].alias(prefix + "lo"), q[1].alias(prefix + "hi"), F.avg(value).alias(prefix + "mean"), F.stddev_samp(value).alias(prefix + "std"), F.count(value).alias(prefix + "n"))


def settled_interval(values: DataFrame, rows: DataFrame, by: list[str], value: str, least: int, least_rows: int = 30) -> DataFrame:
    """As ``interval`` for each group of ``rows`` (those that were drawn from): all null, with n = 0, under ``least_rows`` rows; ends and deviation null under ``least`` known replicates."""
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).join(interval(values, by, value), by, "left")
    enough = F.col("_rows") >= least_rows
    ends = {c: F.when(enough & (F.col("n") >= least), F.col(c)) for c in ("lo", "hi", "std")}
    return found.withColumns(ends | {"mean": F.when(enough, F.col("mean")), "n": F.when(enough, F.coalesce("n", F.lit(0))).otherwise(0)}).drop("_rows")


def paired_p(diff: Column) -> Column:
    """Two-sided share of replicates on the other side of 0, as an aggregate."""
    share = lambda c: F.avg(c.cast("double"))
    return F.least(2 * F.least(share(diff >= 0), share(diff <= 0)), F.lit(1.0))


def normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal, by a rational approximation good to 1e-7 (fixed coefficients)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def delong(df: DataFrame, by: list[str], y: str, a: str, b: str) -> DataFrame:
    """Paired test of two scores' areas: both areas, variance of their difference, z and p (null without variance)."""
    rows = metrics.finite(df, y, a, b)
    sizes = rows.groupBy(*by).agg(F.sum((F.col(y) == 1).cast("double")).alias("m"), F.sum((F.col(y) != 1).cast("double")).alias("n"))
    v = rows.join(sizes, by)
    for s in (a, b):
        v = v.join(metrics.placements(rows, by, y, s, f"_{s}"), [*by, s])
    for name, s in (("va", a), ("vb", b)):
        v = v.withColumn(name, F.when(F.col(y) == 1, F.col(f"_{s}_neg") / F.col("n")).otherwise(1 - F.col(f"_{s}_pos") / F.col("m")))
    own = lambda c, k: F.when(F.col(y) == k, F.col(c))
    spread = lambda k: F.var_samp(own("va", k)) + F.var_samp(own("vb", k)) - 2 * F.covar_samp(own("va", k), own("vb", k))
    out = v.groupBy(*by).agg(F.avg(own("va", 1)).alias("auc_a"), F.avg(own("vb", 1)).alias("auc_b"), (spread(1) / F.max("m") + spread(0) / F.max("n")).alias("variance"))
    z = F.when(F.col("variance") > 1e-15, (F.col("auc_a") - F.col("auc_b")) / F.sqrt("variance"))
    return out.withColumn("z", z).withColumn("p", normal_tail(F.col("z")))


def holm(df: DataFrame, p: str, ties: list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``p_holm``: running largest of (m - rank) p, at most 1; null p stay out."""
    family = Window.partitionBy(*(by or []))
    known = df.filter(F.col(p).isNotNull())
    ranked = known.withColumn("_k", F.row_number().over(family.orderBy(p, *ties)) - 1).withColumn("_m", F.count(F.lit(1)).over(family))
    run = family.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = ranked.withColumn("p_holm", F.least(F.max((F.col("_m") - F.col("_k")) * F.col(p)).over(run), F.lit(1.0)))
    return stepped.drop("_k", "_m").unionByName(df.filter(F.col(p).isNull()), allowMissingColumns=True)


def verdict(lo: Column, hi: Column, eps: float = 0.02, clear: float = 0.0) -> Column:
    """What an interval of a difference says at a margin; better or worse is what lies beyond ``clear``."""
    return F.when(lo.isNull() | hi.isNull(), "inconclusive").when(lo > clear, "better").when(hi < -clear, "worse").when((lo > -eps) & (hi < eps), "equivalent").when(hi < eps, "not_better").otherwise("inconclusive")


def rung(backbone: Column) -> Column:
    """Step of the ladder that a backbone is on."""
    return F.when(backbone.startswith("siglip_lora_loco"), "loco").when(backbone.startswith("siglip"), "siglip").otherwise("clip")
