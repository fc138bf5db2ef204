"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit a binary classifier tells the languages whose
bit is 1 from the others by the log ratio of their hashed byte n-gram frequencies, which
are counted over all training documents. A text's bits are predicted as calibrated
margins; decoding takes the codeword with the smallest summed logistic loss, weighted
by how well each bit did, and flags a text whose two best codewords are close.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .learning import fit_logistic, thinned
from .ngrams import LETTERS, hashed
from .tokens import chunks, text_buffers

BITS, SIZES = 15, (1, 2, 3)
#: Documents that calibrate the bits at most; languages that a model may have.
CALIBRATION_ROWS, MOST_LANGUAGES = 4000, 500
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n codewords of bits: all ways to split up to 6 languages in two; beyond that,
    8 bits for each doubling, drawn so that the closest two differ as much as found."""
    if n <= 1:
        return np.ones((n, 1), bool)
    if n <= 6:
        splits = [[(k >> i) & 1 for i in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(splits, bool).T
    rng, best, width = np.random.default_rng(n), None, 8 * int(np.ceil(np.log2(n)))
    for _ in range(50):
        code = rng.random((n, width)) < 0.5
        apart = min(int((code[i] ^ code[j]).sum()) for i in range(n) for j in range(i)) if n <= 60 else 0
        if code.any(0).all() and not code.all(0).any() and (best is None or apart > best[0]):
            best = apart, code
    return best[1]


def _features(data: np.ndarray) -> list[np.ndarray]:
    low = LETTERS[data]
    return [hashed(low, n, BITS) for n in SIZES]


@dataclass
class LanguageCodes:
    """Languages, their codewords and, for each bit, n-gram weights, scale and weight in
    decoding."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    trust: np.ndarray

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """By row, the mean weight of its n-grams for each bit, and whether it has a letter."""
        data, offsets = text_buffers(column)
        out, letters = np.zeros((len(column), len(self.weights))), np.zeros(len(column), bool)
        for lo, hi in chunks(offsets):
            at = offsets[lo : hi + 1] - offsets[lo]
            part = data[offsets[lo] : offsets[hi]]
            if not len(part):
                continue
            grams, full = _features(part), np.flatnonzero(np.diff(at))
            ascii_letter = np.add.reduceat(((part | 0x20) >= 0x61) & ((part | 0x20) <= 0x7A), at[full], dtype=np.int64) > 0
            other = np.add.reduceat(part >= 0x80, at[full], dtype=np.int64) > 0
            letters[lo + full] = ascii_letter
            for r in full[~ascii_letter & other]:
                letters[lo + r] = any(c.isalpha() for c in part[at[r] : at[r + 1]].tobytes().decode())
            for b, w in enumerate(self.weights):
                total, number = np.zeros(len(full)), np.zeros(len(full))
                for n, g in zip(SIZES, grams, strict=True):
                    # n-grams that reach into the next text are taken off again
                    value = np.zeros(len(part))
                    value[: len(g)] = w[g]
                    for j in range(1, n):
                        value[at[full + 1] - j] = 0.0
                    total += np.add.reduceat(value, at[full])
                    number += np.maximum(at[full + 1] - at[full] - n + 1, 0)
                out[lo + full, b] = total / np.maximum(number, 1)
        return out, letters

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, probability and whether the decision is ambiguous."""
        z = margins * self.scale + self.shift
        sign = np.where(self.codes, 1.0, -1.0)
        loss = (np.logaddexp(0, -z[:, None, :] * sign[None]) * self.trust).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        top = p[np.arange(len(p)), best]
        return best, top, top - second < 0.2


def _counts(languages: list[str]):
    """mapInArrow over (lang, text): n-gram counts of each language."""
    number = {v: i for i, v in enumerate(languages)}

    def run(batches):
        total = np.zeros((len(languages), 1 << BITS), np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for row, lang in enumerate(batch.column("lang").to_pylist()):
                for g in _features(data[offsets[row] : offsets[row + 1]]):
                    total[number[lang]] += np.bincount(g, minlength=1 << BITS)
        which, feature = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(total[which, feature])], names=["which", "feature", "n"])

    return run


def fit_languages(train: DataFrame) -> LanguageCodes:
    """Learn from all (text, lang) rows with both; a language is any value of lang. More
    than MOST_LANGUAGES values raise. Without rows no language is learned."""
    train = train.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    languages = sorted(r["lang"] for r in train.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    codes = codewords(len(languages))
    rows = train.mapInArrow(_counts(languages), "which int, feature int, n long").groupBy("which", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(languages), 1 << BITS), 0.5)
    counts[rows["which"], rows["feature"]] += rows["n"]
    share = counts / counts.sum(axis=1, keepdims=True)
    weights = []
    for code in codes.T:
        one, zero = (share[side].mean(axis=0) if side.any() else np.full(1 << BITS, 2.0**-BITS) for side in (code, ~code))
        weights.append(np.log(one / zero))
    model = LanguageCodes(languages, codes, np.array(weights), np.full(codes.shape[1], 4.0), np.zeros(codes.shape[1]), np.ones(codes.shape[1]))
    if len(languages) < 2:
        return model

    def margins(batches):
        for batch in batches:
            m, _ = model.margins(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(m), pa.list_(pa.float64()))], names=["lang", "m"])

    # copies of a text count once; of what the thinning leaves, the first by hash
    sample = thinned(train, "text", CALIBRATION_ROWS, train.count()).groupBy("text").agg(F.min("lang").alias("lang"))
    got = sample.orderBy(F.xxhash64("text")).limit(CALIBRATION_ROWS).mapInArrow(margins, "lang string, m array<double>").collect()
    m, y = np.array([r["m"] for r in got]), np.array([languages.index(r["lang"]) for r in got])
    for b in range(codes.shape[1]):
        truth = codes[y, b].astype(float)
        model.scale[b], model.shift[b] = fit_logistic(m[:, b : b + 1], truth, ridge=1e-3)
        right = ((m[:, b] * model.scale[b] + model.shift[b] > 0) == (truth > 0.5)).mean()
        model.trust[b] = max(0.05, 2 * right - 1)
    model.trust /= model.trust.mean()
    return model


def identify_language(docs: DataFrame, model: LanguageCodes, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``. A null text, a text
    without a letter and any text under a model without languages get "und", 0 and
    false. Columns of these names that ``docs`` has are replaced."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            own = held.value
            names, score, doubt = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if own.languages and batch.num_rows:
                m, letters = own.margins(batch.column(batch.schema.get_field_index(text_col)))
                best, p, close = own.decode(m)
                names[letters] = np.array(own.languages, object)[best[letters]]
                score[letters], doubt[letters] = p[letters], close[letters]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(doubt)], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]))
