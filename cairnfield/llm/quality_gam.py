"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is described by a few shape features (lengths, shares of byte classes, repetition).
Training bins every feature at quantiles and boosts shallow trees on one feature after the
other, round by round; their leaf values add up in one lookup table for each feature. Then
the pairs of features that explain most of what is left get two-way tables, boosted likewise.
A score is the logistic of the sum of table entries, so scoring is a few vectorised additions.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hash of
their id over the whole label table. Every row is scored.

Defined results: a null text is an empty one, and gets the score of its (zero) features;
without labelled rows each score is 0.5; rows with a null label are not learned from; repeated
rows are scored alike and learned from once, and of an id with several texts the smallest is learned. Columns of the input stay, except one that has the name of a result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm import textops
from cairnfield.llm.common import ship

#: Most labelled rows that the model is fitted on.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 80, 0.1

FEATURES = ("log_bytes", "log_words", "word_length", "capitals", "digits", "symbols", "exclamations", "stops", "punctuation", "line_ends", "non_ascii", "distinct_words", "short_words", "longest_word")


def _byte_class() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 symbol, 4 exclamation, 5 full stop, 6 other punctuation, 7 line end, 8 non-ASCII, 9 rest."""
    kind = np.full(256, 6, dtype=np.uint8)
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[list(b"#*$%&|<>")] = 3
    kind[ord("!")] = 4
    kind[ord(".")] = 5
    kind[:33] = 9
    kind[ord("\n")] = 7
    kind[128:] = 8
    return kind


BYTE_CLASS = _byte_class()


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)), dtype=np.float64)
    for first, last in textops.chunks(texts):
        data, at = textops.raw(texts.slice(first, last - first))
        n = last - first
        if not len(data):
            continue
        owner = np.repeat(np.arange(n), np.diff(at))
        count = np.bincount(owner * 10 + BYTE_CLASS[data], minlength=n * 10).reshape(n, 10).astype(float)
        starts, ends, of = textops.words(data, at)
        n_words = np.diff(of).astype(float)
        owner = np.repeat(np.arange(n), np.diff(of))
        length = (ends - starts).astype(float)
        per_word = np.maximum(n_words, 1)
        letters = np.maximum(count[:, 0] + count[:, 1] + count[:, 8] / 2, 1)
        size = np.maximum(np.diff(at), 1).astype(float)
        key = np.sort((textops.word_hashes(data, starts, ends) >> np.uint64(24)) | (owner.astype(np.uint64) << np.uint64(40)))
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
        longest = np.zeros(n)
        np.maximum.at(longest, owner, length)
        out[first:last] = np.column_stack(
            [
                np.log1p(np.diff(at)),
                np.log1p(n_words),
                np.bincount(owner, length, minlength=n) / per_word,
                count[:, 1] / letters,
                count[:, 2] / size,
                count[:, 3] / per_word,
                count[:, 4] / per_word,
                count[:, 5] / per_word,
                count[:, 6] / size,
                count[:, 7] / per_word,
                count[:, 8] / size,
                distinct / per_word,
                np.bincount(owner, length <= 1, minlength=n) / per_word,
                np.log1p(longest),
            ]
        )
    return out


@dataclass
class Gam:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The cut of a histogram that lowers the loss most (entries before it go left), and by how much."""
    if len(g) < 2:
        return 0, 0.0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    best = int(np.argmax(gain))
    return (best + 1, float(gain[best])) if gain[best] > 1e-12 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of each bin of a shallow tree on one feature."""
    cut, _ = _cut(g, h) if depth else (0, 0.0)
    if not cut:
        return np.full(len(g), -g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values of the best tree that cuts both features once into four quadrants; its gain.

    All pairs of cuts are compared at once, by sums over the quadrants.
    """
    gs, hs = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((h.shape[0] + 1, h.shape[1] + 1))
    gs[1:, 1:], hs[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gain = np.zeros_like(gs)
    values = []
    for top in (True, False):
        for left in (True, False):
            parts = []
            for s in (gs, hs):
                rows = s if top else s[-1:, :] - s
                edge = rows[:, -1:]
                parts.append(rows if left else edge - rows)
            values.append(-parts[0] / (parts[1] + 1))
            gain += parts[0] ** 2 / (parts[1] + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = (v[i, j] for v in values)
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting on binned features; y holds 0 and 1."""
    model = Gam()
    if not len(x):
        return model
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.intercept = float(np.log(share / (1 - share)))
    width = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(len(x), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            grad, hess = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], grad, size), np.bincount(bins[j], hess, size))
            model.tables[j] += step
            total += step[bins[j]]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(width)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        grad, hess = slopes()
        shape = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        cell = coarse[a] * shape[1] + coarse[b]
        return np.bincount(cell, grad, shape[0] * shape[1]).reshape(shape), np.bincount(cell, hess, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(combinations(range(width), 2), key=lambda p: -_tree_2d(*grid(*p))[1])
    model.pairs = [(a, b, np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1))) for a, b in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            step = RATE * _tree_2d(*grid(a, b))[0]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled rows with the smallest hashes, at most ``rows`` of them.

    The chosen ids have a fixed bound, so they are broadcast and no text is shuffled.
    """
    ship(docs.sparkSession)
    chosen = (
        labels.where(F.col(f"`{label}`").isNotNull())
        .select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").cast("int").alias("__label"))
        .distinct()  # repeated rows don't fill the bound; an id with both labels is learned with both
        .orderBy(F.xxhash64("__key"), "__key", "__label")
        .limit(rows)
    )
    found = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).join(F.broadcast(chosen), "__key")
    # an id has one text and each of its labels once, however often its row is repeated
    found = found.groupBy("__key", "__label").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text"))

    def describe(batches):
        for batch in batches:
            x = features(textops.as_strings(batch.column("__text")))
            yield pa.RecordBatch.from_arrays([batch.column("__label"), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    got = found.select("__label", "__text").mapInArrow(describe, "y int, x binary").toArrow()
    x = np.array([np.frombuffer(v, dtype=np.float64) for v in got["x"].to_pylist()]).reshape(-1, len(FEATURES))
    return x, got["y"].to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Gam:
    x, y = labelled_features(docs, labels, label, text, key, rows)
    order = np.lexsort(x.T) if len(x) else []  # the rows come in any order; sums then don't depend on it
    return fit(x[order], y[order]) if len(x) else Gam()


def score(docs: DataFrame, model: Gam, text: str = "text", out: str = "score") -> DataFrame:
    """Add the model's probability of label 1 to each row."""
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(textops.as_strings(texts))))

    return docs.withColumn(out, scored(_text(text)))


def _text(name: str) -> Column:
    return F.col(f"`{name}`")
