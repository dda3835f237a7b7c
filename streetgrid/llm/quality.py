"""Quality classifier by co-training (operator 2).

Two views of a document are classified apart: its text (hashed words and word shapes) and the page's metadata (source,
language, length, layout). In each round both views score every unlabelled document in Spark, and what one is sure of
trains the other. A view is sure where it is right on labelled rows put aside: a view that tells nothing gives nothing.
At the end both are calibrated on these rows, which never train a view nor get a pseudo-label, and their log odds are
combined.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunk_cache import REMEMBERED, ChunkCache
from .common import add_columns, new_path, strings
from .labelled import first_of_each, labelled_sample, learnable

#: Labelled rows of each class that the views are fitted on, at most.
PER_CLASS = 2500
#: Rounds of co-training, and how many pseudo-labels a view gives the other in a round at most.
ROUNDS, GIVEN = 2, 400
#: A view is sure from the log odds on where, of the rows put aside, so many are right: lower bound, at so many deviations.
SURE, DEVIATIONS = 0.98, 1.64
#: Documents with at least this score are kept.
KEEP_FROM = 0.5
#: Buckets of words and of word shapes, and the symbols of a shape.
WORDS, SHAPES, SHAPE_SYMBOLS = 512, 256, 6
_HASHED_SOURCES, _HASHED_LANGUAGES = 32, 8
METADATA = _HASHED_SOURCES + _HASHED_LANGUAGES + 4
COLUMNS = ["text", "source", "lang", "n_chars"]


def shape(chunk: str) -> str:
    """Runs of small letters, capitals and digits as one symbol each, other characters as they are, without repetition."""
    word = chunk.rstrip(_MARKS)
    return _shape_of(word) + (_runs(chunk[len(word) : len(word) + 64]) if len(word) < len(chunk) else "")


def _shape_of(word: str) -> str:
    if word.isalpha():
        if word.islower():
            return "a"
        if word.isupper():
            return "A"
        if word[0].isupper() and word[1:].islower():
            return "Aa"
    return _runs("".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in word[:64]))


def _runs(text: str) -> str:
    return "".join(k for k, _ in groupby(text))[:SHAPE_SYMBOLS]


_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def _bucket(unit: str, buckets: int) -> int:
    return zlib.crc32(unit.encode("utf-8", "surrogatepass")) % buckets


#: Most words are small letters only; their shape is known.
_SMALL = _bucket("a", SHAPES)


def _buckets(chunk: str) -> int:
    if chunk.isalpha() and chunk.islower():
        return _bucket(chunk.lower(), WORDS) * SHAPES + _SMALL
    return _bucket(chunk.strip(_MARKS).lower(), WORDS) * SHAPES + _bucket(shape(chunk), SHAPES)


class TextView:
    """Features of whole texts: square roots of the parts of words and of shapes in each bucket, length and variety."""

    size = WORDS + SHAPES + 2

    def __init__(self):
        self._of = ChunkCache(_buckets, REMEMBERED).__getitem__

    def __call__(self, texts: list[str]) -> np.ndarray:
        """One row for each text; an empty text has zeros."""
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = text.split()
            if words:
                both = np.fromiter(map(self._of, words), np.int64, len(words))
                row[:WORDS] = np.bincount(both // SHAPES, minlength=WORDS)
                row[WORDS:-2] = np.bincount(both % SHAPES, minlength=SHAPES)
                row[:-2] = np.sqrt(row[:-2] / len(words))
                row[-2:] = np.log1p(len(words)), len(set(words)) / len(words)
        return out


def metadata_features(texts: list[str], source: list, lang: list, n_chars: list) -> np.ndarray:
    """One row for each document: hashed source and language, length as given, and the lines of its layout."""
    out = np.zeros((len(texts), METADATA), np.float32)
    for i, (t, s, g, n) in enumerate(zip(texts, source, lang, n_chars, strict=True)):
        if s is not None:
            out[i, zlib.crc32(s.encode("utf-8", "surrogatepass")) % _HASHED_SOURCES] = 1
        if g is not None:
            out[i, _HASHED_SOURCES + zlib.crc32(g.encode("utf-8", "surrogatepass")) % _HASHED_LANGUAGES] = 1
        lines = t.count("\n") + 1
        size = max(0, n) if n is not None else len(t)
        out[i, -4:] = np.log1p(size), np.log1p(lines), np.log1p(size / lines), n is None
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features."""

    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) / len(self.mean) ** 0.5
        return np.hstack([z, np.ones((len(z), 1), z.dtype)])

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> Logistic:
        self.mean, spread = x.mean(0), x.std(0)
        self.scale = np.maximum(spread, 1e-3)
        a = self._design(x).astype(np.float64)
        self.weights = np.zeros(a.shape[1])
        penalty = np.full(a.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(20):
            p = _sigmoid(a @ self.weights)
            slope = a.T @ (p - y) + penalty * self.weights
            curve = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(penalty)
            move = np.linalg.solve(curve, slope)
            self.weights = self.weights - move
            if np.abs(move).max() < 1e-4:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.weights, -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class CoTrained:
    """Both views, their calibration (slope, offset) and the weights of their combination."""

    text: Logistic
    metadata: Logistic
    calibration: np.ndarray
    combination: np.ndarray

    def scores(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.calibration[0, 0] * self.text.logit(x_text) + self.calibration[0, 1]
        b = self.calibration[1, 0] * self.metadata.logit(x_meta) + self.calibration[1, 1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.combination[0] * a + self.combination[1] * b + self.combination[2])


def _platt(columns: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and offset of a logistic model of few columns that never turns a column's sign, shrunk to their mean."""
    w = np.append(np.full(columns.shape[1], 1.0 / columns.shape[1]), 0.0)
    start = w.copy()
    a = np.hstack([columns, np.ones((len(y), 1))])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    pull = np.append(np.full(columns.shape[1], 0.5), 0.01)
    for _ in range(100):
        p = _sigmoid(a @ w)
        slope = a.T @ (weight * (p - target)) + pull * (w - start)
        curve = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(pull)
        move = np.clip(np.linalg.solve(curve, slope), -1, 1)
        w = w - move
        w[:-1] = np.maximum(w[:-1], 0.0)
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class CoTraining:
    """The labelled rows' views, parted into those to train on and those put aside, and what the rounds add."""

    views: tuple[np.ndarray, np.ndarray]
    y: np.ndarray
    share: float
    seed: int = 0

    def __post_init__(self):
        self.aside = np.random.default_rng(self.seed).random(len(self.y)) < 0.3
        for label in (0, 1):
            own = np.flatnonzero(self.y == label)
            self.aside[own[0]], self.aside[own[-1]] = True, len(own) == 1
        own = ~self.aside if len(np.unique(self.y[~self.aside])) == 2 else np.ones(len(self.y), bool)
        self._sets = [(v[own], self.y[own].astype(float)) for v in self.views]
        self.models = [Logistic().fit(*s) for s in self._sets]

    def wanted(self, giver: int, label: int) -> int:
        """Pseudo-labels that a view may give of a label: of each so many as keep the shares of the labelled rows."""
        return max(1, round(GIVEN * float((self._sets[giver][1] == label).mean())))

    def cut(self, giver: int, label: int) -> float | None:
        """Log odds from which (for label 0: below which, negated) the view is sure; None where it never is."""
        y, z = self.y[self.aside], self.models[giver].logit(self.views[giver][self.aside])
        z, right = (z, y == 1) if label else (-z, y == 0)
        order = np.argsort(-z, kind="stable")
        z, n = z[order], np.arange(1, len(z) + 1)
        weight = self._weights(y)[order]
        precision = np.cumsum(weight * right[order]) / np.cumsum(weight)
        d = DEVIATIONS**2
        bound = (precision + d / (2 * n) - DEVIATIONS * np.sqrt(precision * (1 - precision) / n + d / (4 * n * n))) / (1 + d / n)
        bound[:-1][z[1:] == z[:-1]] = 0
        sure = np.flatnonzero(bound >= SURE)
        return float(z[sure[-1]]) if len(sure) else None

    def _weights(self, y: np.ndarray) -> np.ndarray:
        """Each label weighs as much as it does among all labelled rows."""
        good = y.mean()
        return np.where(y == 1, self.share / good, (1 - self.share) / (1 - good)) if 0 < self.share < 1 and 0 < good < 1 else np.ones(len(y))

    def add(self, taker: int, rows: np.ndarray, labels: np.ndarray) -> bool:
        """Train a view on further rows too; it goes back to what it was where that makes it worse on the rows put aside."""
        x, t = self._sets[taker]
        grown = np.vstack([x, rows]), np.append(t, labels.astype(float))
        model = Logistic().fit(*grown)
        better = self._loss(taker, model) <= self._loss(taker, self.models[taker])
        if better:
            self._sets[taker], self.models[taker] = grown, model
        return better

    def _loss(self, view: int, model: Logistic) -> float:
        y, z = self.y[self.aside], model.logit(self.views[view][self.aside])
        slope, offset = _platt(z[:, None], y, self._weights(y))
        z = slope * z + offset
        return float((self._weights(y) * np.logaddexp(0, np.where(y == 1, -z, z))).sum())

    def finish(self) -> CoTrained:
        """Calibrate and combine on the rows put aside."""
        y = self.y[self.aside]
        weight = self._weights(y)
        logits = [m.logit(v[self.aside]) for m, v in zip(self.models, self.views, strict=True)]
        calibration = np.array([_platt(z[:, None], y, weight) for z in logits])
        columns = np.column_stack([c[0] * z + c[1] for c, z in zip(calibration, logits, strict=True)])
        return CoTrained(*self.models, calibration, _platt(columns, y, weight))


def _views(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Add both views, _x0 and _x1, made where the texts are."""
    fields = [T.StructField("_x0", T.BinaryType()), T.StructField("_x1", T.BinaryType())]

    def make():
        text_view = TextView()

        def work(text, source, lang, n_chars):
            texts = strings(text)
            both = text_view(texts), metadata_features(texts, source.to_pylist(), lang.to_pylist(), n_chars.to_pylist())
            return [pa.array([row.tobytes() for row in x], pa.binary()) for x in both]

        return work

    return add_columns(rows, make, COLUMNS, fields, keep=keep)


def _viewed(rows: DataFrame, keep: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
    """Both views of few rows, and the rows in order of their ids."""
    found = sorted(_views(rows, keep).collect(), key=lambda r: r["doc_id"])
    views = [np.frombuffer(b"".join(r[c] for r in found), np.float32).reshape(len(found), size) for c, size in (("_x0", TextView.size), ("_x1", METADATA))]
    return *views, found


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rounds: int = ROUNDS) -> CoTrained | None:
    """Co-train on at most ``per_class`` labelled rows of each class outside the held-out third and all other documents.

    Each round scores every document that is not in the labelled sample; of those that a view is sure of, ``GIVEN`` at
    most, the first in hash order, are fetched. The views of all documents are written before the first round, so that
    no round reads the texts again. None without both labels.
    """
    spark = docs.sparkSession
    x_text, x_meta, rows = _viewed(labelled_sample(docs, labels, "quality", per_class, COLUMNS), ["doc_id", "_y"])
    y = np.array([r["_y"] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    share = learnable(labels, "quality").agg(F.avg("_y")).first()[0]
    work = CoTraining((x_text, x_meta), y, float(share))
    taken = {r["doc_id"] for r in rows}
    viewed = None
    for _ in range(rounds):
        cuts = [(giver, label, work.cut(giver, label)) for giver in (0, 1) for label in (0, 1)]
        cuts = [c for c in cuts if c[2] is not None]
        if not cuts:
            break
        known = spark.createDataFrame([(i,) for i in sorted(taken)], "doc_id long")  # the sample and what rounds fetched
        if viewed is None:
            path = new_path(spark, "views")
            free = docs.filter(F.col("doc_id").isNotNull()).join(F.broadcast(known), "doc_id", "left_anti")
            _views(free, ["doc_id"]).write.parquet(path)
            viewed = spark.read.parquet(path)
        path = new_path(spark, "logits")
        _view_logits(viewed.join(F.broadcast(known), "doc_id", "left_anti"), work.models).write.parquet(path)
        scored = spark.read.parquet(path)
        given = []
        for giver, label, cut in cuts:
            sure = F.col(f"z{giver}") if label else -F.col(f"z{giver}")
            own = scored.filter(sure >= cut).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(work.wanted(giver, label))
            given += own.distinct().select("doc_id", F.lit(1 - giver).alias("taker"), F.lit(label).alias("label")).collect()
        # A document that the views label differently is left to neither.
        by_id: dict[int, set] = {}
        for r in given:
            by_id.setdefault(r["doc_id"], set()).add(r["label"])
        given = [r for r in given if len(by_id[r["doc_id"]]) == 1]
        if not given:
            break
        ids = spark.createDataFrame([(i,) for i in sorted({r["doc_id"] for r in given})], "doc_id long")
        new_text, new_meta, fetched = _viewed(first_of_each(docs, ids, COLUMNS), ["doc_id"])
        at = {r["doc_id"]: i for i, r in enumerate(fetched)}
        grew = False
        for taker, new in ((0, new_text), (1, new_meta)):
            own = sorted((at[r["doc_id"]], r["label"]) for r in given if r["taker"] == taker)
            if own:
                grew |= work.add(taker, new[[i for i, _ in own]], np.array([label for _, label in own]))
        taken |= set(at)
        if not grew:  # the next round would score alike
            break
    return work.finish()


def _view_logits(viewed: DataFrame, models: list[Logistic]) -> DataFrame:
    """doc_id and the log odds of each view, z0 and z1, not calibrated, of documents with both views."""
    shared = viewed.sparkSession.sparkContext.broadcast(models)

    def make():
        own = shared.value

        def work(*views):
            x = [np.frombuffer(b"".join(v.to_pylist()), np.float32).reshape(len(v), size) for v, size in zip(views, (TextView.size, METADATA), strict=True)]
            return [pa.array(m.logit(v), pa.float64()) for m, v in zip(own, x, strict=True)]

        return work

    return add_columns(viewed, make, ["_x0", "_x1"], [T.StructField("z0", T.DoubleType()), T.StructField("z1", T.DoubleType())], ["doc_id"])


SCORES = ("p_text", "p_metadata", "quality_score")


def score(docs: DataFrame, model: CoTrained | None, keep: list[str] | None = None) -> DataFrame:
    """Add p_text, p_metadata and quality_score, each 0 to 1; without a model all are 1.

    Null texts are empty, null metadata are unknown values; rows stay as they are and nothing is shuffled.
    """
    if model is None:
        return docs.select(*(docs.columns if keep is None else keep), *(F.lit(1.0).alias(n) for n in SCORES))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own, text_view = shared.value, TextView()

        def work(text, source, lang, n_chars):
            texts = strings(text)
            x = text_view(texts), metadata_features(texts, source.to_pylist(), lang.to_pylist(), n_chars.to_pylist())
            return [pa.array(p, pa.float64()) for p in own.scores(*x)]

        return work

    return add_columns(docs, make, COLUMNS, [T.StructField(n, T.DoubleType()) for n in SCORES], keep)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score says good, with their own columns."""
    kept = score(docs.withColumnsRenamed({n: f"_{n}" for n in SCORES if n in docs.columns}), train(docs, labels))
    kept = kept.filter(F.col("quality_score") >= KEEP_FROM).drop(*SCORES)
    return kept.withColumnsRenamed({f"_{n}": n for n in SCORES if n in docs.columns})
