"""Folds, bounded samples of labelled rows, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def thinned(df: DataFrame, column: str, most: int, total: int) -> DataFrame:
    """``df`` without most rows beyond ``most``: those stay whose ``column`` hashes into a
    share that holds about 1.5 times ``most`` of ``total`` rows. What is ordered and
    limited afterwards then doesn't grow with the table or its partitions."""
    share = min(1.0, 1.5 * (most + 100) / max(1, total))
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(column, F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, left_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``most`` labelled rows whose fold isn't ``left_out``:
    those that come first by a hash of the id. Null ids and labels are left out; an
    id that is labelled twice counts with its larger label. ``most`` bounds the
    rows that are broadcast to find their texts."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.where(fold("_id", parts) != left_out)
    picked = thinned(known, "_id", most, known.count()).orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id").select("text", "label")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the intercept last, of a ridge-penalised logistic fit by Newton steps.
    Without rows of both classes only the intercept is set, from smoothed counts."""
    x = np.column_stack([np.asarray(x, float).reshape(len(y), -1), np.ones(len(y))])
    w = np.zeros(x.shape[1])
    n1 = float(y.sum())
    w[-1] = np.log((n1 + 0.5) / (len(y) - n1 + 0.5))
    if not 0 < n1 < len(y):
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
