"""Quality classifier: naive Bayes log-count ratios times n-gram indicators, in a linear model with hinge loss.

Features are indicators of hashed byte n-grams of a whole text, and one indicator of how large a share of its word
bigrams are a word twice (repeated words look harmless to byte n-grams). A feature's value is the log of the ratio between its
smoothed share of the good texts' indicators and of the bad texts'; rows have unit length. The weights minimise hinge
loss by coordinate descent in the dual, are drawn towards their mean size, and margins become probabilities by a logistic
curve that is fitted on sample rows the weights haven't seen.

The fit uses a bounded sample: at most about FIT_ROWS labelled rows, in seeded hash order; one executor task fits it.
Scores cover all rows. Null, empty and repeated texts are scored like any other; null ids are never learned from; without
labels, or with labels of one kind only, all rows have one score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm._bytes import pieces, texts, word_hashes
from tarnsearch.llm.langid import remainder

BITS = 18
LENGTHS = (1, 2, 3, 4)
FIT_ROWS = 6_000
THRESHOLD = 0.3
SHARES = 16
REPEAT_WEIGHT = 8.0
_PIECE = 1 << 19  # bytes of text at a time: each has tens of bytes of temporaries, and a worker keeps much of what it once took
_FACTORS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


class Grams:
    """Distinct hashed n-grams of each text of a batch."""

    def __init__(self):
        self.last = np.zeros((1 << BITS) + SHARES, dtype=np.int32)

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        wide = raw.astype(np.uint32)
        codes, gram = [], np.zeros(len(raw), dtype=np.uint32)
        for n in LENGTHS:
            size = max(0, len(raw) - n + 1)
            gram = gram[:size] | wide[n - 1 : n - 1 + size] << np.uint32(8 * (n - 1))
            codes.append(((gram ^ np.uint32(n * 0x01010101)) * np.uint32(_FACTORS[n - 1]) >> np.uint32(32 - BITS)).astype(np.int32))
        h, first = word_hashes(raw, off)
        twice = np.concatenate([[0], np.cumsum(h[1:] == h[:-1]), [0]])
        for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            own = np.concatenate([c[a : max(a, b - n + 1)] for n, c in zip(LENGTHS, codes, strict=True)])
            if (pairs := int(first[k + 1] - first[k] - 1)) > 0:
                share = int(twice[first[k + 1] - 1] - twice[first[k]]) / pairs
                own = np.append(own, np.int32(len(self.last) - 1 - math.ceil(share * (SHARES - 1))))
            place = np.arange(len(own), dtype=np.int32)
            self.last[own] = place  # the last of equal ones wins
            yield own[self.last[own] == place]


def gram_pieces(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    """Slices of batches, each with the n-grams of the texts in its column ``at``."""
    grams = Grams()
    for batch in batches:
        for part in pieces(batch, batch.schema.names[at], _PIECE):
            yield part, grams(*texts(part.column(at)))


@dataclass
class Model:
    weight: np.ndarray  # of a feature's indicator
    square: np.ndarray  # of a feature's value
    bias: float
    slope: float
    shift: float

    def margin(self, own: np.ndarray) -> float:
        length = math.sqrt(float(self.square[own].sum())) if len(own) else 0.0
        return (float(self.weight[own].sum()) / length if length else 0.0) + self.bias

    def score(self, own: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * self.margin(own) + self.shift))))


def dual_descent(flat: np.ndarray, values: np.ndarray, to: np.ndarray, chosen: np.ndarray, y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 12, seed: int = 5, least: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model over the chosen rows; cost bounds each row's dual variable.

    Row i has the features flat[to[i]:to[i + 1]] and their values. It ends when no variable moved by ``least`` in a round.
    """
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(to) - 1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in chosen[rng.permutation(len(chosen))]:
            own, v = flat[to[i] : to[i + 1]], values[to[i] : to[i + 1]]
            gradient = y[i] * (float(w[own] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / (float(v @ v) + 1.0), 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                alpha[i] = new
                w[own] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < least:
            break
    return w, bias


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0, cost: float = 1.0, mean_share: float = 0.6) -> Model:
    """A model from distinct features and labels 0 or 1. Without both labels it scores the labels' mean. ``rows`` is emptied."""
    size, y = (1 << BITS) + SHARES, np.where(labels > 0, 1.0, -1.0)
    if not len(rows) or len(set(y.tolist())) < 2:
        share = (float((y > 0).sum()) + 1.0) / (len(y) + 2.0)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, math.log(share / (1 - share)))
    to = np.concatenate([[0], np.cumsum([len(own) for own in rows])])
    good, bad = np.full(size, smooth), np.full(size, smooth)
    for own, s in zip(rows, y.tolist(), strict=True):
        (good if s > 0 else bad)[own] += 1.0
    flat = np.concatenate(rows)
    rows.clear()
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    ratio[1 << BITS :] *= REPEAT_WEIGHT
    values, narrow = np.empty(len(flat), dtype=np.float32), ratio.astype(np.float32)
    for a, b in zip(to[:-1], to[1:], strict=True):
        values[a:b] = narrow[flat[a:b]]
        if n := float(np.linalg.norm(values[a:b])):
            values[a:b] /= n
    seen = np.arange(len(y)) % 4 != 3
    balance = np.where(y > 0, cost, cost * max(1.0, (y > 0).sum() / max(1, (y < 0).sum())))

    def weights(chosen: np.ndarray) -> tuple[np.ndarray, float]:
        w, bias = dual_descent(flat, values, to, chosen, y, size, balance)
        used = np.abs(w) > 0
        mean = np.abs(w[used]).mean() if used.any() else 0.0
        return (1 - mean_share) * mean * (w != 0) + mean_share * w if mean_share < 1 else w, bias

    # The interpolation's first part gives all features the same weight: the naive Bayes direction.
    w, bias = weights(np.flatnonzero(seen))
    rest = np.flatnonzero(~seen)
    margins = np.array([float(w[flat[to[i] : to[i + 1]]] @ values[to[i] : to[i + 1]]) + bias for i in rest])
    slope, shift = logistic(margins, y[rest])
    w, bias = weights(np.arange(len(y)))
    return Model(w * ratio, ratio * ratio, bias, slope, shift)


def logistic(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the curve from margins to probabilities, by damped Newton steps on smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1.0) / (up + 2.0), 1.0 / (down + 2.0))
    scale = margins.std() or 1.0
    x = np.stack([margins / scale, np.ones_like(margins)], 1)
    c = np.array([1.0, math.log((up + 1.0) / (down + 1.0))])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ c, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * c
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        c -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(c[0]), 1e-6) / scale, float(c[1])


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = FIT_ROWS, held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled documents outside the held-out remainder.

    The sample's ids are bounded, so they are sent to the documents, not the documents to them.
    """
    named = labels.select(F.col("doc_id").alias("id_"), F.col(label_col).cast("int").alias("label"))
    fit_for = named.where(F.col("id_").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("id_"), held_out[0]) != held_out[1]))
    n = fit_for.count()
    share = min(1.0, rows / max(1, n))
    chosen = fit_for.where(F.pmod(F.xxhash64("id_", F.lit(8)), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = chosen.groupBy("id_").agg(F.max("label").alias("label")).limit(2 * rows)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    return found.join(F.broadcast(chosen), F.col("doc_id") == F.col("id_")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Features are made on the executors, one task fits the bounded sample, and the driver gets the model only."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in gram_pieces(batches, 1):
            own = [np.sort(x).astype("<i4").tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(own, pa.binary())], ["doc_id", "label", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            found += zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            batch = None  # its bytes go before the fit
        found.sort()
        order = np.random.default_rng(3).permutation(len(found)).tolist()
        rows, labels = [np.frombuffer(found[i][2], "<i4") for i in order], np.array([found[i][1] for i in order], dtype=int)
        found.clear()
        m = fit_rows(rows, labels)
        parts = [np.asarray(x, "<f8").tobytes() for x in (m.weight, m.square, [m.bias, m.slope, m.shift])]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["weight", "square", "rest"])

    sent = sample(docs, labels, label_col).mapInArrow(features, "doc_id long, label int, own binary").repartition(1)
    found = sent.mapInArrow(run, "weight binary, square binary, rest binary").first()
    if found is None:  # an empty table needs no task
        return fit_rows([], np.zeros(0, dtype=int))
    weight, square, rest = (np.frombuffer(bytes(x), "<f8") for x in found)
    return Model(weight, square, *map(float, rest))


def score_column(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score``, 0 to 1, higher for label 1. Null is scored as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in gram_pieces(batches, len(keep)):
            got = [model.score(own) for own in found]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(got, pa.float64())], [*keep, "score"])

    kinds = dict(docs.dtypes)
    chosen = docs.select(*keep, docs[text_col].cast("string").alias("__text"))
    return chosen.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "score double"]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for all documents."""
    out = score_column(docs, fit(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that the classifier doesn't reject."""
    model, at = fit(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in gram_pieces(batches, at):
            yield part.filter(pa.array([model.score(own) >= threshold for own in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
