"""Convolutional text classifier for toxicity (operator 8).

A word's embedding is the sum of hashed ones: of the word and of its beginnings. Filters of several widths run over the
words of the whole text, each keeps its largest response, and a linear layer makes a logit of these. The net starts at
random and is trained here in numpy on a bounded sample of labelled rows, whose words are hashed in Spark tasks. At first
a softmax over the words stands in for the maximum, so that every word is tried, then the maximum itself is trained.

Rows without their label in training only calibrate: for each language, told from the text's most frequent words, the
logit at the best border between the labels is moved to the score of the fixed threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunk_cache import REMEMBERED
from .common import add_columns, strings
from .labelled import held_out, labelled_sample

__all__ = ["held_out"]

#: A score from here on is predicted toxic.
THRESHOLD = 0.7
#: Labelled rows of each class that the net is fitted on, at most.
PER_CLASS = 2000
#: Rows of the hashed embeddings and their width, the filter widths, and the filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 16
#: Letters of the beginnings of longer words that are hashed beside the whole word.
PREFIXES = (4, 5, 6)
#: Epochs with a softmax of these temperatures, then epochs with the maximum.
SOFT, HARD = (1.0, 0.5), 3
#: Texts and words of a batch, step length, part of the words left out in a step, decay of the weights.
BATCH, BATCH_WORDS, RATE, DROP, DECAY = 64, 1 << 15, 0.02, 0.3, 1e-4
#: Frequent words that tell the languages apart; fixed values.
MARKERS = {
    "en": ("the", "and", "of", "to", "is", "that", "it", "was"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "mit"),
    "fr": ("le", "les", "des", "et", "est", "une", "dans", "pour"),
    "es": ("el", "los", "que", "las", "por", "del", "con", "su"),
}
LANGUAGES = (*MARKERS, "other")
_STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»“”‘’…—–"
_MARKER_OF = {w: i for i, ws in enumerate(MARKERS.values()) for w in ws}
_UNITS = 1 + len(PREFIXES)
#: Bucket of nothing; its embedding is zero.
_NONE = 0


def normal(chunk: str) -> str:
    """A word as the net sees it: lower case, without marks around it."""
    return chunk.strip(_STRIP).lower()


def _bucket(unit: str) -> int:
    return 1 + zlib.crc32(unit.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)


def units(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    return (_bucket(word), *(_bucket("^" + word[:n]) if n < len(word) else _NONE for n in PREFIXES))


class Words:
    """Numbers the words of texts; ``units_of`` and ``marker_of`` hold what is known of each. -1 is no word."""

    def __init__(self):
        self._number: dict[str, int] = {}
        self._units: list[tuple[int, ...]] = []
        self._markers: list[int] = []

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self._number) > REMEMBERED:
            self.__init__()
        return [np.fromiter(map(self._of, t.split()), np.int32) for t in texts]

    def _of(self, chunk: str) -> int:
        found = self._number.get(chunk)
        if found is None:
            word, found = normal(chunk), -1
            if word:
                found = len(self._units)
                self._units.append(units(word))
                self._markers.append(_MARKER_OF.get(word, -1))
            self._number[chunk] = found
        return found

    def units_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.array([self._units[i] for i in numbers], np.uint16).reshape(-1, _UNITS)

    def language(self, words: np.ndarray) -> int:
        """The language whose markers are most frequent in a text."""
        marks = np.fromiter((m for m in map(self._markers.__getitem__, words) if m >= 0), np.int64)
        return int(np.bincount(marks, minlength=len(MARKERS)).argmax()) if len(marks) else len(MARKERS)


def _laid_out(rows: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each with so much padding behind that no filter reads across; and where each starts."""
    gap = np.full(max(WIDTHS), pad, dtype=np.int64)
    parts = [p for r in rows for p in (r, gap)]
    lengths = np.array([len(r) + len(gap) for r in rows])
    return np.concatenate(parts), np.cumsum(lengths) - lengths


def _responses(table: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """Responses of a width's filters at each place; ``table``: (width, words, filters)."""
    n = len(ids) - width + 1
    out = table[0][ids[:n]]
    for k in range(1, width):
        out += table[k][ids[k : n + k]]
    return out


@dataclass
class Net:
    """The net: hashed embeddings, filters (width, DIM, FILTERS) and bias by width, the last layer, borders by language."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    weights: np.ndarray
    offset: float
    borders: np.ndarray
    scale: float = 1.0

    @classmethod
    def random(cls, rng: np.random.Generator) -> Net:
        embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        embedding[_NONE] = 0
        filters = {w: rng.normal(0, (DIM * w) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        weights = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        return cls(embedding, filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, weights, 0.0, np.zeros(len(LANGUAGES)))

    def tables(self, own: np.ndarray) -> dict[int, np.ndarray]:
        return {w: own @ self.filters[w] for w in WIDTHS}

    def logits(self, rows: list[np.ndarray], units: np.ndarray) -> np.ndarray:
        """Logits of texts given as word numbers; ``units``: buckets of each word. A text without words has padding only."""
        ids, starts = _laid_out(rows, len(units))
        tables = self.tables(np.vstack([self.embedding[units].sum(1), np.zeros((1, DIM), np.float32)]))
        pooled = [np.maximum.reduceat(_responses(tables[w], ids, w), starts, axis=0) + self.bias[w] for w in WIDTHS]
        return np.maximum(np.hstack(pooled), 0) @ self.weights + self.offset

    def scores(self, logits: np.ndarray, language: np.ndarray) -> np.ndarray:
        z = self.scale * (logits - self.borders[language]) + np.log(THRESHOLD / (1 - THRESHOLD))
        return _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _batches(order: np.ndarray, rows: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Texts in order, so many or so many words at a time; a longer text alone."""
    at = 0
    while at < len(order):
        sizes = np.cumsum([len(rows[i]) for i in order[at : at + BATCH]])
        n = max(1, int(np.searchsorted(sizes, BATCH_WORDS, side="right")))
        yield order[at : at + n]
        at += n


def _sum_by(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values' rows by key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = np.zeros((size, values.shape[1]), np.float32)
    out[ordered[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class _Steps:
    """Adam for the shared weights; AdaGrad, one rate for a row, for the embeddings."""

    def __init__(self):
        self._past: dict[str, list] = {}
        self._rows = np.full(BUCKETS, 1e-8, np.float32)

    def shared(self, name: str, value: np.ndarray, slope: np.ndarray) -> None:
        past = self._past.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
        past[0], past[1], past[2] = 0.9 * past[0] + 0.1 * slope, 0.999 * past[1] + 0.001 * slope**2, past[2] + 1
        value -= 0.5 * RATE * (past[0] / (1 - 0.9 ** past[2])) / (np.sqrt(past[1] / (1 - 0.999 ** past[2])) + 1e-6)

    def embedding(self, value: np.ndarray, buckets: np.ndarray, slope: np.ndarray) -> None:
        self._rows[buckets] += (slope**2).mean(1)
        value[buckets] -= RATE * (2 * slope / np.sqrt(self._rows[buckets])[:, None] + DECAY * value[buckets])


def _train_batch(net: Net, steps: _Steps, rows: list[np.ndarray], units: np.ndarray, label: np.ndarray, balance: np.ndarray, heat: float | None, rng: np.random.Generator) -> None:
    ids, starts = _laid_out(rows, len(units))
    ids[rng.random(len(ids)) < DROP] = len(units)
    own, ids = np.unique(ids, return_inverse=True)
    own_units = np.vstack([units, np.zeros((1, _UNITS), units.dtype)])[own]
    embedded = net.embedding[own_units].sum(1)
    tables, pooled, places = net.tables(embedded), [], []
    for w in WIDTHS:
        response = _responses(tables[w], ids, w)
        text = np.repeat(np.arange(len(starts)), np.diff([*starts, len(response)]))
        top = np.maximum.reduceat(response, starts, axis=0)
        if heat:
            part = np.exp((response - top[text]) / heat)
            part /= np.add.reduceat(part, starts, axis=0)[text]
            pooled.append(np.add.reduceat(part * response, starts, axis=0))
            places.append((text, part))
        else:
            at, f = np.nonzero(response == top[text])
            first = np.zeros(top.shape, np.int64)
            first[text[at[::-1]], f[::-1]] = at[::-1]
            pooled.append(top)
            places.append((None, first))
    hidden = np.maximum(np.hstack([p + net.bias[w] for p, w in zip(pooled, WIDTHS, strict=True)]), 0)
    error = ((_sigmoid(hidden @ net.weights + net.offset) - label) * balance / len(label)).astype(np.float32)
    back = np.outer(error, net.weights) * (hidden > 0)
    lost = np.zeros_like(embedded)
    for j, w in enumerate(WIDTHS):
        slope, (text, place) = back[:, j * FILTERS : (j + 1) * FILTERS], places[j]
        filters = np.zeros_like(net.filters[w])
        for k in range(w):
            if heat:
                by_word = _sum_by(ids[k : len(text) + k], place * slope[text], len(own))
            else:
                by_word = np.zeros((len(own), FILTERS), np.float32)
                np.add.at(by_word, (ids[place + k], np.arange(FILTERS)), slope)
            filters[k] = embedded.T @ by_word
            lost += by_word @ net.filters[w][k].T
        steps.shared(f"filters{w}", net.filters[w], filters + DECAY * net.filters[w])
        steps.shared(f"bias{w}", net.bias[w], slope.sum(0))
    steps.shared("weights", net.weights, hidden.T @ error + DECAY * net.weights)
    net.offset -= RATE * float(error.sum())
    flat = own_units.ravel()
    buckets, at = np.unique(flat[flat != _NONE], return_inverse=True)
    if len(buckets):
        steps.embedding(net.embedding, buckets, _sum_by(at, np.repeat(lost, _UNITS, axis=0)[flat != _NONE], len(buckets)))


def fit(texts: list[np.ndarray], labels: np.ndarray, language: np.ndarray, seed: int = 0, soft: tuple = SOFT, hard: int = HARD) -> Net:
    """Train on texts given as the buckets (words, units) of their words; with one class or none every score is low."""
    rng = np.random.default_rng(seed)
    net = Net.random(rng)
    if not len(texts) or labels.min() == labels.max():
        net.weights, net.offset = net.weights * 0, -1.0
        return net
    sizes = np.cumsum([0, *map(len, texts)])
    packed = np.ascontiguousarray(np.vstack(texts), np.uint16).view(np.uint64).ravel()
    words, numbers = np.unique(packed, return_inverse=True)
    units = words.view(np.uint16).reshape(-1, _UNITS)
    rows = [numbers[a:b] for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    aside = rng.random(len(rows)) < 0.2
    train, steps = np.flatnonzero(~aside), _Steps()
    share = labels.mean()
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for heat in (*soft, *[None] * hard):
        rng.shuffle(train)
        for own in _batches(train, rows):
            _train_batch(net, steps, [rows[i] for i in own], units, labels[own], balance[own], heat, rng)
    _calibrate(net, rows, units, labels, language, aside)
    return net


def _best_border(logit: np.ndarray, label: np.ndarray) -> float:
    """The middle of the gap that parts the labels with fewest errors, each class weighing alike."""
    order = np.argsort(logit, kind="stable")
    x, y = logit[order], label[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    alarms = np.concatenate([[0], np.cumsum(1 - y)])
    cost = missed + (alarms[-1] - alarms) / max(1, (1 - y).sum())
    cost[1:-1][x[1:] == x[:-1]] = np.inf
    ends = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    width = np.concatenate([[0], np.diff(x), [0]])
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(ends[best[np.argmax(width[best])]])


def _calibrate(net: Net, rows: list, units: np.ndarray, labels: np.ndarray, language: np.ndarray, aside: np.ndarray) -> None:
    """Borders from rows held out of training, by language where both labels are frequent enough, else from all."""
    chosen = np.flatnonzero(aside)
    if not len(chosen) or labels[chosen].min() == labels[chosen].max():
        chosen = np.arange(len(rows))
    logit = np.concatenate([net.logits([rows[i] for i in part], units) for part in _batches(chosen, rows)])
    y, spoken = labels[chosen], language[chosen]
    net.borders[:] = _best_border(logit, y)
    for j in range(len(LANGUAGES)):
        own = spoken == j
        if min(y[own].sum(), (1 - y[own]).sum()) >= 20:
            net.borders[j] = _best_border(logit[own], y[own])
    net.scale = float(4.0 / max(1e-3, np.median(np.abs(logit - net.borders[spoken]))))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed words, labels and languages of the labelled sample; the words are hashed where the texts are."""
    rows = labelled_sample(docs, labels, "toxic", per_class, ["text"])
    fields = [T.StructField("words", T.BinaryType()), T.StructField("spoken", T.IntegerType())]

    def make():
        words = Words()

        def work(texts):
            numbers = [n[n >= 0] for n in words(strings(texts))]
            return [pa.array([words.units_of(n).tobytes() for n in numbers], pa.binary()), pa.array([words.language(n) for n in numbers], pa.int32())]

        return work

    found = sorted(add_columns(rows, make, ["text"], fields, keep=["doc_id", "_y"]).collect(), key=lambda r: r["doc_id"])
    hashed = [np.frombuffer(r["words"], np.uint16).reshape(-1, _UNITS) for r in found]
    return hashed, np.array([r["_y"] for r in found], np.int64), np.array([r["spoken"] for r in found], np.int64)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Net:
    """Fit the net on at most ``per_class`` labelled rows of each class outside the held-out third."""
    return fit(*sample(docs, labels, per_class))


def score(docs: DataFrame, net: Net, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the score, 0 to 1, of the whole text; it depends on the text alone.

    Null and empty texts are scored as texts without words. Rows stay as they are; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        own, words = shared.value, Words()

        def work(texts):
            rows = [n[n >= 0] for n in words(strings(texts))]
            language = np.array([words.language(n) for n in rows])
            used, at = np.unique(np.concatenate(rows), return_inverse=True)
            cuts = np.cumsum([len(r) for r in rows])[:-1]
            return [pa.array(own.scores(own.logits(np.split(at, cuts), words.units_of(used)), language).astype(np.float64), pa.float64())]

        return work

    return add_columns(docs, make, [text], [T.StructField(name, T.DoubleType())], keep)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    scored = score(docs, train(docs, labels), name=name)
    return scored.filter(scored[name] < THRESHOLD).select(*docs.columns)
