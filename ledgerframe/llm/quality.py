"""Quality classifier: naive-Bayes support vectors.

Features are indicators of hashed n-grams: words and word pairs, and 1- to 3-grams of word shapes (case, length class, attached
symbols, repetition of the word before), which carry over to words never seen. Class log-count ratios r come from the
indicator counts of ALL training rows, summed by Spark. Each indicator is scaled by r, and a linear hinge-loss (squared) model
is fitted by dual coordinate descent on a bounded sample of whole rows: those of smallest hash of id and text, SAMPLE at most, and no more than hold
SAMPLE_INDICATORS indicators together (one row always). Every indicator of a sampled row takes part. The margin becomes a
probability by a logistic fit on that sample's margins.

Texts are read in pieces that hand their last words on, so that the indicators are those of the whole text.

Defined cases. Null and empty texts have the bias feature alone and still get a score. Null or repeated labels:
null labels are no training rows, repeated ones count as often as they stand in the ratios, and once in the sample. Null doc_id: held_out false, no training row. No training
row of one class: every score is the share of label 1 (0.5 without any). Extra columns pass through untouched. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _word_hashes, discard, mix64, pieces, staged

DIMENSIONS = 1 << 18
#: Most rows that the hinge-loss fit sees, and most indicators of all of them; ratios and scores use all rows.
SAMPLE, SAMPLE_INDICATORS = 8192, 1 << 23
SMOOTHING, PENALTY, EPOCHS = 1.0, 0.1, 12
#: Bytes of a text that are taken apart at once: numpy arrays of a task stay at a few megabytes, however long the text.
_PIECE = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Shape class of a byte: 0 lower, 1 upper, 2 digit, 3 symbol, 4 part of a longer code point.
_CLASS = np.full(256, 3, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature indices of a whole text; index 0 is the bias."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    found = [np.zeros(1, dtype=np.int64)]
    last = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)  # hashes and shapes of the two words before
    for piece in pieces(data, _SPACE, _PIECE):
        words, shapes, again = _words(piece, last[0])
        if len(words):
            found.append(_features(words, shapes, again, last))
            last = tuple(np.concatenate([x, y])[-2:] for x, y in zip(last, (words, shapes), strict=True))
    return np.unique(np.concatenate(found))


def _words(data: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of every word of data, and whether it repeats the word before; before: hashes of the words before data."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return (np.empty(0, dtype=np.uint64),) * 3
    words = _word_hashes(data, _SPACE)
    kinds = _CLASS[data]
    shape = np.zeros(len(starts), dtype=np.uint64)
    for c in range(1, 5):
        total = np.concatenate([[0], np.cumsum(kinds == c)])
        n = np.minimum(total[ends] - total[starts], 3).astype(np.uint64)
        shape = shape * np.uint64(4) + n
    length = np.minimum(np.log2(ends - starts + 1), 5).astype(np.uint64)
    again = np.zeros(len(starts), dtype=np.uint64)
    again[1:] = words[1:] == words[:-1]
    again[0] = len(before) > 0 and before[-1] == words[0]
    return words, mix64(((shape * np.uint64(8) + length) * np.uint64(2) + again) * np.uint64(5) + kinds[ends - 1]), again


def _features(words: np.ndarray, shapes: np.ndarray, again: np.ndarray, before: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = [mix64(words + np.uint64(11)), mix64(shapes + np.uint64(13)), mix64(again + np.uint64(12345))]
    w, s = (np.concatenate([x, y]) for x, y in zip(before, (words, shapes), strict=True))
    if len(w) > 1:
        out += [mix64(w[:-1] * np.uint64(3) + w[1:]), mix64(s[:-1] * np.uint64(5) + s[1:])]
    if len(w) > 2:
        out.append(mix64(s[:-2] * np.uint64(7) + s[1:-1] * np.uint64(9) + s[2:]))
    return np.unique((np.concatenate(out) % np.uint64(DIMENSIONS - 1)).astype(np.int64) + 1)


def indicator_counts(train: DataFrame) -> DataFrame:
    """(feature, n0, n1): training texts of label 0 and 1 that hold the feature, over all rows of train(text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, DIMENSIONS), dtype=np.int64)
        for batch in batches:
            for label, text in zip(batch.column("label"), batch.column("text"), strict=True):  # one text at a time leaves Arrow
                sums[label.as_py()][features(text.as_py())] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["feature", "n0", "n1"])

    rows = train.select("text", F.col("label").cast("int").alias("label"))
    return rows.mapInArrow(run, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a linear model of squared hinge loss; rows are (indices, values), y is +1 or -1. Classes weigh alike."""
    share = np.array([max(1, (y == s).sum()) for s in (-1, 1)], dtype=float)
    cost = {s: penalty * len(y) / (2 * share[(s + 1) // 2]) for s in (-1, 1)}
    diagonal = np.array([0.5 / cost[int(s)] for s in y])
    square = np.array([float(v @ v) for _, v in rows]) + diagonal
    weights, alpha = np.zeros(DIMENSIONS), np.zeros(len(rows))
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, values = rows[i]
            gradient = y[i] * float(weights[at] @ values) - 1 + diagonal[i] * alpha[i]
            step = min(gradient, 0.0) if alpha[i] == 0 else gradient
            if step and square[i]:
                worst = max(worst, abs(step))
                before, alpha[i] = alpha[i], max(alpha[i] - gradient / square[i], 0.0)
                weights[at] += (alpha[i] - before) * y[i] * values
        if worst < 0.01:
            break
    return weights


def _sample(train: DataFrame) -> pd.DataFrame:
    """(label, at) of the sampled rows: at holds all indicators of the row as little-endian int32."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [features(t.as_py()).astype(np.int32) for t in batch.column("text")]
            keys = [batch.column(c) for c in ("h", "t", "label")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([len(f) for f in own], pa.int64()), pa.array([f.tobytes() for f in own], pa.binary())], names=["h", "t", "label", "n", "at"])

    keyed = train.select(F.xxhash64("doc_id").alias("h"), F.xxhash64(F.lit(1), "text").alias("t"), F.col("label").cast("int").alias("label"), "text")
    # The last key of the sample, then all rows up to it: texts do not pass through the sort. Equal rows have equal keys and are taken once.
    last = keyed.select("h", "t", "label").distinct().orderBy("h", "t", "label").limit(SAMPLE).agg(F.max(F.struct("h", "t", "label")).alias("k")).select("k.*").first()
    upto = (F.col("h") < last.h) | (F.col("h") == last.h) & ((F.col("t") < last.t) | (F.col("t") == last.t) & (F.col("label") <= last.label))
    rows = staged(keyed.filter(upto).mapInArrow(some, "h long, t long, label int, n long, at binary").dropDuplicates(["h", "t", "label"]), "quality-sample")
    sizes = rows.select("h", "t", "label", "n").toPandas().sort_values(["h", "t", "label"])  # SAMPLE rows at most
    n = max(1, int((sizes["n"].cumsum() <= SAMPLE_INDICATORS).sum()))
    last = sizes.iloc[n - 1]
    upto = (F.col("h") < int(last.h)) | (F.col("h") == int(last.h)) & ((F.col("t") < int(last.t)) | (F.col("t") == int(last.t)) & (F.col("label") <= int(last.label)))
    out = rows.filter(upto).toPandas().sort_values(["h", "t", "label"])
    discard(rows)
    return out


def fit(train: DataFrame) -> tuple[np.ndarray, float, float]:
    """(weight of every indicator, slope, offset) from train(doc_id, text, label): score = logistic(slope * sum of weights + offset)."""
    found = indicator_counts(train).toPandas()  # at most DIMENSIONS rows
    n = np.zeros((2, DIMENSIONS))
    if len(found):
        n[0][found["feature"]], n[1][found["feature"]] = found["n0"], found["n1"]
    rows_of = n[:, 0]  # the bias stands in every text
    if not rows_of.all():
        share = rows_of[1] / rows_of.sum() if rows_of.sum() else 0.5
        return np.zeros(DIMENSIONS), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    positive, negative = n[1] + SMOOTHING, n[0] + SMOOTHING
    ratio = np.log(positive / positive.sum()) - np.log(negative / negative.sum())
    seen = n.sum(axis=0) >= 2
    ratio[~seen] = 0
    ratio[0] = 1.0

    sample = _sample(train)
    at = [np.frombuffer(x, dtype=np.int32) for x in sample["at"]]
    y = np.where(sample["label"].to_numpy() == 1, 1, -1)
    rows = []
    for x in at:
        v = ratio[x]
        rows.append((x, v / max(1e-12, np.sqrt(v @ v))))
    weights = dual_coordinate_descent(rows, y) if len({*y}) == 2 else np.zeros(DIMENSIONS)
    margin = np.array([float(weights[a] @ v) for a, v in rows])
    slope, offset = _logistic(margin, (y + 1) // 2)
    return np.vstack([weights, ratio]), slope, offset


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and offset of a logistic fit of y in {0, 1} on x, classes weighing alike."""
    slope, offset = 1.0, 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        error, curve = weight * (p - y), weight * p * (1 - p)
        gradient = np.array([error @ x + 1e-4 * slope, error.sum()])
        hessian = np.array([[curve @ (x * x) + 1e-4, curve @ x], [curve @ x, curve.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope - float(np.clip(step[0], -2, 2)), offset - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return max(slope, 0.0), offset


def score_texts(texts: Iterable[str | None], model: tuple[np.ndarray, float, float]) -> np.ndarray:
    weights, slope, offset = model
    out = []
    for text in texts:
        margin = 0.0
        if weights.ndim == 2:
            at = features(text)
            v = weights[1][at]
            margin = float(weights[0][at] @ v) / max(1e-12, float(np.sqrt(v @ v)))
        out.append(1 / (1 + np.exp(-np.clip(slope * margin + offset, -35, 35))))
    return np.array(out, dtype=float)


def classify(docs: DataFrame, model: tuple[np.ndarray, float, float], keep_text: bool = True) -> DataFrame:
    """docs with score (0 to 1) added; a column of that name is replaced. docs needs text, which is left out unless keep_text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score")
    names = [c for c in kept.columns if keep_text or c != "text"]
    schema = kept.select(*[F.col(f"`{c}`") for c in names]).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # the other columns pass through as they are
        for batch in batches:
            scores = score_texts((x.as_py() for x in batch.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(scores, pa.float64())], names=[*names, "score"])

    return kept.mapInArrow(run, schema)
