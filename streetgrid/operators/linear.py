"""Linear models from sufficient statistics: one pass over the rows sums products, folds apart; fits need no rows.

The sums of a fold are a (d + 2) x (d + 2) matrix of the products of features, target and 1. Means, covariances, every fit
of a path of penalties and its error on a fold that it has not seen follow from these matrices, which are all that comes to
the driver. Penalties are those of the usual definitions: ridge adds alpha |b|^2 to the sum of squares; the elastic net
minimises sum / (2 n) + alpha (l1 |b|_1 + (1 - l1) / 2 |b|^2). The intercept is never penalised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Penalties of the searched path and of the probes; fixed values.
RIDGE_PATH = tuple(np.logspace(-3, 4, 30).tolist())
PROBE_ALPHAS = (0.1, 1.0, 10.0, 100.0)
FOLDS = 5


@dataclass(frozen=True)
class Fit:
    """Coefficients and intercept."""

    coef: np.ndarray
    intercept: float

    def predict(self, features: str) -> Column:
        """The prediction from an array column, as an expression."""
        parts = F.zip_with(F.col(features), F.array(*map(F.lit, self.coef.tolist())), lambda x, b: x * b)
        return F.aggregate(parts, F.lit(float(self.intercept)), lambda a, x: a + x)


class Sums:
    """Weighted sums of products of (features, target, 1)."""

    def __init__(self, products: np.ndarray):
        self.products = products
        self.n, self.d = float(products[-1, -1]), len(products) - 2

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.products + other.products)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.products - other.products)

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """X'X and X'y around the means, and the means."""
        p, d = self.products, self.d
        mx, my = p[:d, -1] / self.n, float(p[d, -1] / self.n)
        return p[:d, :d] - self.n * np.outer(mx, mx), p[:d, d] - self.n * mx * my, mx, my

    def squared_error(self, fit: Fit) -> float:
        v = np.r_[fit.coef, -1.0, fit.intercept]
        return float(v @ self.products @ v)

    def r2(self, fit: Fit) -> float:
        """1 - error / variance; null (NaN) where the target does not vary."""
        p, d = self.products, self.d
        total = p[d, d] - p[d, -1] ** 2 / self.n
        return 1 - self.squared_error(fit) / total if total > 0 else float("nan")


def sums(df: DataFrame, features: str, y: str, weight: str | None = None, fold: str | None = None) -> dict[int, Sums]:
    """Sums by fold (0 without one) of rows whose features (an array), target and weight are all finite numbers.

    Rows are summed in their tasks, as matrix products; only the matrices are shuffled and added up.
    """
    one = F.lit(1.0)
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else one).alias("w"), (F.col(fold).cast("long") if fold else F.lit(0).cast("long")).alias("fold"))
    rows = rows.filter("fold IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL")
    schema = T.StructType([T.StructField("fold", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, w, folds = _augmented(batch)
            fit = np.isfinite(z).all(axis=1) & np.isfinite(w)
            for k in np.unique(folds[fit]).tolist():
                own = fit & (folds == k)
                held[k] = held.get(k, 0.0) + z[own].T @ (z[own] * w[own, None])
        for k, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(m), pa.int64()), pa.array(range(len(m)), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], names=schema.names)

    each = rows.mapInArrow(run, schema).select("fold", "row", F.posexplode("s").alias("col", "s"))
    found: dict[int, dict] = {}
    for r in each.groupBy("fold", "row", "col").agg(F.sum("s").alias("s")).collect():
        found.setdefault(r["fold"], {})[r["row"], r["col"]] = r["s"]
    out = {}
    for k, cells in sorted(found.items()):
        m = np.zeros([1 + max(c[0] for c in cells)] * 2)
        for at, s in cells.items():
            m[at] = s
        out[k] = Sums((m + m.T) / 2)
    return out


def _augmented(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (features, target, 1), weights and folds of a batch; null components are NaN."""
    x = batch.column("x")
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    y = batch.column("y").to_numpy(zero_copy_only=False)
    z = np.column_stack([flat.reshape(batch.num_rows, -1), y, np.ones(batch.num_rows)])
    return z, batch.column("w").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)


def least_squares(s: Sums) -> Fit:
    """Without a penalty; of several solutions the shortest."""
    xx, xy, mx, my = s.centred()
    coef = np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ xy
    return Fit(coef, my - float(mx @ coef))


def ridge_path(s: Sums, alphas) -> list[Fit]:
    """Fits for all penalties, from one decomposition."""
    xx, xy, mx, my = s.centred()
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    coefs = [vectors @ ((vectors.T @ xy) / (values + a)) for a in alphas]
    return [Fit(c, my - float(mx @ c)) for c in coefs]


def elastic_net(s: Sums, alpha: float, l1: float, start: np.ndarray | None = None, tolerance: float = 1e-12, rounds: int = 20_000) -> Fit:
    """Coordinate descent on the sums, from ``start``."""
    xx, xy, mx, my = s.centred()
    xx, xy = xx / s.n, xy / s.n
    b = np.zeros(s.d) if start is None else start.copy()
    slope = xy - xx @ b
    for _ in range(rounds):
        moved = 0.0
        for j in range(s.d):
            if xx[j, j] <= 0:
                continue
            rho = slope[j] + xx[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / (xx[j, j] + alpha * (1 - l1))
            if new != b[j]:
                slope -= xx[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]) * np.sqrt(xx[j, j]))
                b[j] = new
        if moved <= tolerance:
            break
    return Fit(b, my - float(mx @ b))


def elastic_path(s: Sums, alphas, l1: float) -> list[Fit]:
    """Fits from the largest penalty down, each from the one before it; in the order of ``alphas``."""
    found, start = {}, None
    for a in sorted(alphas, reverse=True):
        found[a] = elastic_net(s, a, l1, start)
        start = found[a].coef
    return [found[a] for a in alphas]


@dataclass(frozen=True)
class Search:
    """Mean score of every penalty on folds left out, the chosen penalty, and the fit on all rows."""

    alphas: tuple[float, ...]
    scores: np.ndarray
    alpha: float
    fit: Fit


def ridge_by_folds(of_fold: dict[int, Sums], alphas=RIDGE_PATH) -> Search:
    """The penalty of the best mean R² over folds, each scored by the fit on the others; ties to the smaller penalty."""
    whole = _total(of_fold)
    scores = np.array([[held.r2(f) for f in ridge_path(whole - held, alphas)] for held in of_fold.values()])
    mean = np.nanmean(scores, axis=0)
    best = int(np.flatnonzero(mean >= np.nanmax(mean) - 1e-12)[0])
    return Search(tuple(alphas), scores, alphas[best], ridge_path(whole, [alphas[best]])[0])


def _total(of_fold: dict[int, Sums]) -> Sums:
    out = None
    for s in of_fold.values():
        out = s if out is None else out + s
    return out


def ridge_leave_one_out(df: DataFrame, features: str, y: str, alphas=PROBE_ALPHAS) -> Search:
    """The penalty of the least squared error when each row is left out in turn, exactly, in a second pass over the rows.

    A row's error without it is its residual over 1 - h, h its leverage, which the sums give for all penalties.
    """
    s = sums(df, features, y)[0]
    xx, _, mx, _ = s.centred()
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    fits = ridge_path(s, alphas)
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(0).cast("long").alias("fold")).filter("x IS NOT NULL AND y IS NOT NULL")
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("e", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(alphas))
        for batch in batches:
            if batch.num_rows:
                z = _augmented(batch)[0]
                z = z[np.isfinite(z).all(axis=1)]
                turned = ((z[:, :-2] - mx) @ vectors) ** 2
                for k, (a, f) in enumerate(zip(alphas, fits, strict=True)):
                    h = 1 / s.n + turned @ (1 / (values + a))
                    total[k] += (((z[:, -2] - z[:, :-2] @ f.coef - f.intercept) / (1 - h)) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(alphas)), pa.int32()), pa.array(total)], names=schema.names)

    errors = {r["k"]: r["e"] for r in rows.mapInArrow(run, schema).groupBy("k").agg(F.sum("e").alias("e")).collect()}
    scores = np.array([errors[k] / s.n for k in range(len(alphas))])
    best = int(np.flatnonzero(scores <= scores.min() * (1 + 1e-12))[0])
    return Search(tuple(alphas), scores, alphas[best], fits[best])
