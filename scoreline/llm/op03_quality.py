"""Quality classifier: a support vector machine on naive-Bayes features.

Features are indicators of hashed byte n-grams, of the bytes themselves and of their
kinds (case, digits, signs). Each is scaled by the log ratio of its smoothed counts in
the two classes; a linear hinge-loss model is fitted on them by dual coordinate
descent, and a logistic fit on documents that it has not seen puts margins on a 0-1
scale.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .learning import fit_logistic, sigmoid
from .ngrams import SHAPES, hashed
from .tokens import text_buffers

BITS = 16
#: Share of the sample that calibrates instead of training, by position; epochs; cost.
CALIBRATION, EPOCHS, COST = 5, 8, 1.0


def indicators(text: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Feature numbers of a whole text's bytes. ``flags`` is a zeroed scratch array."""
    shape = SHAPES[text]
    for n in (2, 3, 4):
        flags[hashed(shape, n, BITS, 1)] = True
    flags[hashed(text, 3, BITS, 2)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def _texts(column: pa.Array):
    data, offsets = text_buffers(column)
    for r in range(len(offsets) - 1):
        yield data[offsets[r] : offsets[r + 1]]


@dataclass
class NaiveBayesSvm:
    """Weights of the indicators (ratio times hinge weight), the bias and the scale."""

    weights: np.ndarray
    bias: float
    scale: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        flags, out = np.zeros(1 << BITS, bool), np.zeros(len(column))
        for r, text in enumerate(_texts(column)):
            found = indicators(text, flags)
            out[r] = self.weights[found].sum() / np.sqrt(max(1, len(found))) + self.bias
        return sigmoid(out * self.scale[0] + self.scale[1])


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise half their squared norm plus ``cost`` times the
    hinge losses, class-balanced, over rows of indicators scaled by ``ratio`` and the
    square root of their number; y is 0 or 1."""
    sign = np.where(y > 0, 1.0, -1.0)
    upper = cost * len(y) / (2.0 * np.maximum(1, np.where(y > 0, (y > 0).sum(), (y == 0).sum())))
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    squared = np.array([float(v @ v) + 1.0 for v in values])
    w, bias, alpha, rng = np.zeros(len(ratio)), 0.0, np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / squared[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def _fit(batches):
    """mapInArrow over one partition with the whole sample: one row with the model."""
    flags, rows, y = np.zeros(1 << BITS, bool), [], []
    for batch in batches:
        rows += [indicators(t, flags).astype(np.uint16) for t in _texts(batch.column("text"))]
        y += batch.column("label").to_pylist()
    y = (np.array(y, float) > 0).astype(float)
    spare = np.arange(len(y)) % CALIBRATION == 0 if len(y) >= 5 * CALIBRATION else np.zeros(len(y), bool)
    counts = np.ones((2, 1 << BITS))
    for r, label in zip(rows, y, strict=True):
        counts[int(label), r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    train = np.flatnonzero(~spare)
    w, bias = dual_coordinate_descent([rows[i] for i in train], ratio, y[train]) if len(y) else (np.zeros(1 << BITS), 0.0)
    weights = w * ratio
    check = np.flatnonzero(spare) if spare.any() else train
    margin = np.array([weights[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + bias for i in check])
    scale = fit_logistic(margin, y[check], ridge=1e-2) if len(y) else np.zeros(2)
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.float64())) for x in (weights, np.append(scale, bias))], names=["weights", "rest"])


def fit_quality(sample: DataFrame) -> NaiveBayesSvm:
    """Fit on (text, label) rows, which the caller bounds: the sample goes to one task.
    Null texts count as empty. With rows of one class, or none, every text gets the
    smoothed share of label 1."""
    rows = sample.select("text", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("text"), "label").coalesce(1)
    found = rows.mapInArrow(_fit, "weights array<double>, rest array<double>").first()
    if found is None:  # no partition at all
        return NaiveBayesSvm(np.zeros(1 << BITS), 0.0, np.zeros(2))
    return NaiveBayesSvm(np.array(found["weights"]), found["rest"][2], np.array(found["rest"][:2]))


def score_quality(docs: DataFrame, model: NaiveBayesSvm, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1: likelier label 1); null counts as empty. An
    existing column of that name is replaced."""
    docs = docs.drop("quality_score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = held.value.score(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("quality_score", DoubleType())]))
