"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and a multiple of the identity. The
score is the logistic of the difference of the class log-densities (Mahalanobis distance and log-determinant) and
log-priors. Cholesky factors are computed once and shipped with the model, so a batch is scored by one product a class.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from marketspark.llm.common import fold, settled

SYMBOLS = frozenset("#*$%&|<>")
LEAST_SCORE = 0.3
FEATURES = (
    "words", "word_length", "distinct_words", "top_word", "same_as_before", "repeated_windows", "repeated_lines", "line_words",
    "upper_case", "digits", "symbols", "symbol_words", "exclamations", "other_marks", "ends_of_sentence", "capital_words",
)


def _share(part: float, whole: float) -> float:
    """Log-odds of a share, smoothed so that 0 and 1 are finite."""
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; a null text is empty."""
    text = text or ""
    w = text.split()
    n = len(w)
    counts = Counter(w)
    windows = Counter(zip(w, w[1:], w[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, w))
    marks = Counter({c: k for c, k in Counter(text).items() if not c.isalpha() and not c.isspace()})
    upper = sum(map(str.isupper, text))
    letters = chars - sum(marks.values())
    digits = sum(k for c, k in marks.items() if c.isdigit())
    symbols = sum(k for c, k in marks.items() if c in SYMBOLS)
    other = sum(marks.values()) - digits - symbols - marks["!"] - marks["."] - marks[","]
    return [
        math.log1p(n),
        math.log1p(chars / n if n else 0),
        _share(len(counts), n),
        _share(max(counts.values(), default=0), n),
        _share(sum(a == b for a, b in zip(w, w[1:])), n),
        _share(sum(k for k in windows.values() if k > 1), max(0, n - 2)),
        _share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / len(lines) if lines else 0),
        _share(upper, letters),
        _share(digits, chars),
        _share(symbols, chars),
        _share(sum(x[-1] in SYMBOLS for x in w), n),
        _share(marks["!"], chars),
        _share(other, chars),
        _share(marks["."], n),
        _share(sum(map(str.istitle, w)), n),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return texts.map(statistics, na_action=None)


@dataclass(frozen=True)
class Shrinkage:
    pooled: float = 0.1
    identity: float = 0.02


@dataclass
class Model:
    """Per class 0 and 1: log-prior, mean, inverse Cholesky factor and log-determinant; `constant` replaces them where there is one class or none."""

    classes: list[tuple[float, np.ndarray, np.ndarray, float]]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        parts = [prior - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) - 0.5 * logdet for prior, mean, inverse, logdet in self.classes]
        return 1 / (1 + np.exp(np.clip(parts[0] - parts[1], -700, 700)))


def _class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition, as rows (label, place, value): the number of rows and the sums of x and of x xᵀ."""
    d = len(FEATURES)
    sums = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for batch in batches:
        labels, x = batch.column(0).to_numpy(), np.array(batch.column(1).flatten()).reshape(-1, d)
        for label, total in sums.items():
            own = x[labels == label]
            total += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
    for label, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), label), pa.int32()), pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["label", "place", "value"])


def fit(rows: DataFrame, shrinkage: Shrinkage = Shrinkage()) -> Model:
    """From all rows (label 0 or 1, x); sums are added up in Spark and a fixed number of them reaches the driver."""
    d = len(FEATURES)
    sums = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in rows.select("label", "x").mapInArrow(_class_sums, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        sums[r.label][r.place] = r.value
    counts = {k: s[0] for k, s in sums.items()}
    if not counts[0] or not counts[1]:
        return Model([], 1.0 if counts[1] else 0.0 if counts[0] else 0.5)
    means = {k: s[1 : 1 + d] / s[0] for k, s in sums.items()}
    scatter = {k: s[1 + d :].reshape(d, d) - s[0] * np.outer(means[k], means[k]) for k, s in sums.items()}
    n = counts[0] + counts[1]
    pooled = (scatter[0] + scatter[1]) / n
    classes = []
    for k in (0, 1):
        own = (1 - shrinkage.pooled) * scatter[k] / counts[k] + shrinkage.pooled * pooled
        own = (1 - shrinkage.identity) * own + shrinkage.identity * max(np.trace(own) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(own)
        classes.append((math.log(counts[k] / n), means[k], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    return Model(classes)


def classify(docs: DataFrame, labels: DataFrame, shrinkage: Shrinkage = Shrinkage()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents (doc_id, text), learnt from labels (doc_id, quality).

    Labels teach whose crc32 of the id modulo 5 is not 0; other values than 0 and 1, and ids without a document, teach
    nothing. Null and blank texts are scored by the statistics of an empty text. Without labels every score is 0.5,
    with labels of one class it is that class.
    """
    held = F.coalesce(fold(F.col("doc_id"), 5), F.lit(1)) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), _statistics("text").alias("x"))
    rows = settled(rows, "quality-statistics")  # every text is read once
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where(~F.col("held_out")).join(marks, "doc_id"), shrinkage))

    @F.pandas_udf(DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    scored = rows.select("doc_id", "held_out", score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))
