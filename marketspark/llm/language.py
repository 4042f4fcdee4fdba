"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of distinct letter n-grams (n = 1 to 3)
that both have, divided by the root of the product of their own numbers. Texts are lower-cased, and everything but
letters and the marks that combine with them is a gap. Letters of all scripts stand for themselves: an n-gram is the
code points of its letters in one number, so there is no alphabet to fit. Landmarks are a bounded number
of training texts per language; with them the Nyström features of a text x are k(x, landmarks) * K^(-1/2), and one
kernel ridge regression per language (against the rest) is solved in that space from sums that partitions add up.
As presence kernels are inner products, landmarks and solution fold into one matrix, and a batch of whole texts is
scored by one product of its presence matrix with it.

The score compares languages and says nothing of texts in none of them: without kernels it is near a half. Whether a
text is like the landmarks at all is told by the share of its n-grams that they know. What share is usual is learnt
from the landmarks, each held against the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marketspark.llm.common import fold, joined_spread, settled

NONE = "und"
GAP = 1  # no letter, and not 0: so an n-gram is at least 2**(21 * (n - 1)), and those of two lengths are never one number
BITS = 21
BATCH = 256
CELLS = 1 << 24  # of the presence matrix of a batch


@dataclass(frozen=True)
class Settings:
    """The sample that the model is fitted on: texts per language, on the average, with the lowest hashes of their ids."""

    landmarks: int = 48
    training: int = 1500
    ridge: float = 1e-3


@lru_cache(maxsize=1)
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every code point, and which are letters."""
    letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    symbols = np.full(0x110000, GAP, np.int64)
    for i in np.flatnonzero(letters):
        low = chr(i).lower()
        symbols[i] = ord(low) if len(low) == 1 else i
    marks = [i for i in np.flatnonzero(~letters) if category(chr(i))[0] == "M"]
    symbols[marks] = marks
    return symbols, letters


def counted_grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct n-grams of a whole text in order, and how often each stands there; None for a text without a letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols, letters = _symbols()
    if not letters[points].any():
        return None
    found = np.concatenate([[GAP], symbols[points], [GAP]])
    found = found[np.concatenate([[True], (found[1:] != GAP) | (found[:-1] != GAP)])]  # one gap between words
    two = found[:-1] << BITS | found[1:]
    return np.unique(np.concatenate([found, two, two[:-1] << BITS | found[2:]]), return_counts=True)


def grams(text: str | None) -> np.ndarray | None:
    """The distinct n-grams of a whole text in order; None for a text without a letter."""
    found = counted_grams(text)
    return None if found is None else found[0]


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # n-grams of the landmarks in order
    weights: np.ndarray  # a row for each of them
    unknown: float = 1.0  # largest share of n-grams unknown to the landmarks in a long text like them

    @property
    def batch(self) -> int:
        """Texts whose presence matrix stays within its bound."""
        return max(1, min(BATCH, CELLS // len(self.vocabulary)))

    def _held(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of a batch, which texts have a letter, and which are like the landmarks.

        Unknown n-grams are counted both once each and as often as they stand: the first shows words of another
        language in the same letters, the second another script with a few known words in between.
        """
        presence = np.zeros((len(texts), len(self.weights)), np.float32)
        norms, letters, like = np.ones(len(texts)), np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            found = counted_grams(text)
            if found is not None:
                codes, times = found
                at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
                known = self.vocabulary[at] == codes
                presence[i, at[known]] = 1
                norms[i], letters[i] = len(codes) ** 0.5, True
                share = min(known.mean(), times[known].sum() / times.sum())
                like[i] = share >= 1 - self.unknown - len(codes) ** -0.5  # the share of a short text varies by as much
        return presence @ self.weights / norms[:, None], letters, like

    def products(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of a batch, and which texts have a letter."""
        return self._held(texts)[:2]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and whether it is like the landmarks."""
        names, scores, like = [], [], []
        for at in range(0, len(texts), self.batch):
            values, letters, alike = self._held(texts[at : at + self.batch])
            best = values.argmax(axis=1)
            names += [self.languages[b] if ok else NONE for b, ok in zip(best, letters)]
            scores.append(np.where(letters, np.clip((values.max(axis=1) + 1) / 2, 0, 1), 0.0))
            like.append(alike)
        return (names, np.concatenate(scores), np.concatenate(like)) if scores else (names, np.empty(0), np.empty(0, bool))


def _usual_unknown(places: list[np.ndarray], n: int) -> float:
    """The share of unknown n-grams that a text like the landmarks may have.

    Six times the share that all but a twentieth of the landmarks stay below, each held against the others, and at
    least 0.2. Few landmarks know little, so that then hardly any text is unlike them.
    """
    holders = np.zeros(n, np.int32)
    for at in places:
        holders[at] += 1
    return max(0.2, 6 * float(np.quantile([np.mean(holders[at] < 2) for at in places], 0.95)))


def _lowest(rows: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """Of each language the rows with the lowest hashes, n of them on the average or all there are.

    The share n / rows of the range of hashes is the cut, so one count per language is all that is gathered, and
    texts are not shuffled: the counts, a row for each output of the model, go to all tasks.
    """
    whole = F.col("rows") <= n
    cut = counts.select("lang", F.when(whole, F.lit((1 << 63) - 1)).otherwise((F.lit(float(n)) / F.col("rows") * 2.0**64 - 2.0**63).cast("long")).alias("cut"))
    return joined_spread(rows, cut, ["lang"]).where("hash <= cut").select("lang", "text")


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [grams(t) for t in batch.column(1).to_pylist()]
        codes = pa.array([b"" if g is None else g.tobytes() for g in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), codes], ["lang", "codes"])


def _sums(model: Model, languages: list[str]):
    """Per partition the sums of k kᵀ and k yᵀ over its texts, k being the kernels with the landmarks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.weights.shape[1]
        inner, outer, n = np.zeros((m, m)), np.zeros((m, len(languages))), 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(names), model.batch):
                k, letters = model.products(texts.slice(at, model.batch).to_pylist())
                y = np.where(np.array(names[at : at + model.batch])[:, None] == np.array(languages), 1.0, -1.0)
                inner, outer, n = inner + k[letters].T @ k[letters], outer + k[letters].T @ y[letters], n + int(letters.sum())
        yield pa.RecordBatch.from_arrays([pa.array([inner.tobytes()]), pa.array([outer.tobytes()]), pa.array([n])], ["inner", "outer", "n"])

    return run


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learns from the rows (doc_id, text, lang) of documents; rows without a language or a letter teach nothing.

    None if there is nothing to learn from. The driver gets the landmarks' n-grams and 8 rows of sums.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang"), "text", F.xxhash64("doc_id").alias("hash"))
    counts = settled(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "language-counts")
    marks = _lowest(rows, counts, settings.landmarks)
    marked = marks.mapInArrow(_codes, "lang string, codes binary").collect()
    found = [(r.lang, np.frombuffer(r.codes, np.int64)) for r in marked if r.codes]
    if not found:
        return None
    found.sort(key=lambda x: (x[0], x[1].tolist()))
    languages = sorted({x[0] for x in found})
    vocabulary = np.unique(np.concatenate([codes for _, codes in found]))
    places = [np.searchsorted(vocabulary, codes) for _, codes in found]
    landmarks = np.zeros((len(vocabulary), len(found)), np.float32)
    for j, at in enumerate(places):
        landmarks[at, j] = len(at) ** -0.5
    kernels = docs.sparkSession.sparkContext.broadcast(Model(languages, vocabulary, landmarks))

    def sums(batches):
        return _sums(kernels.value, languages)(batches)

    parts = _lowest(rows, counts, settings.training).repartition(8).mapInArrow(sums, "inner binary, outer binary, n long").collect()
    m = len(found)
    inner = sum(np.frombuffer(p.inner).reshape(m, m) for p in parts)
    outer = sum(np.frombuffer(p.outer).reshape(m, len(languages)) for p in parts)
    n = sum(p.n for p in parts)
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # K^(-1/2), Nyström features are k @ root
    solved = np.linalg.solve(root.T @ inner @ root + settings.ridge * n * np.eye(root.shape[1]), root.T @ outer)
    return Model(languages, vocabulary, (landmarks @ (root @ solved)).astype(np.float32), _usual_unknown(places, len(vocabulary)))


def predicted(docs: DataFrame, model: Model | None, text: Column) -> Column:
    """struct(lang, score, alike) of a text; `und` with score 0 and not alike for a text that is null or has no letter, or without a model."""
    if model is None:
        return F.struct(F.lit(NONE).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("alike"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, alike boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores, alike = shared.value.predict(texts.where(texts.notna(), None).tolist())
        return pd.DataFrame({"lang": names, "score": scores, "alike": alike})

    return predict(text)


def training(docs: DataFrame) -> DataFrame:
    """Rows that may teach: crc32 of the id modulo 3 is not 1. A null id is no held-out row."""
    return docs.where(F.coalesce(fold(F.col("doc_id"), 3), F.lit(0)) != 1)


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of documents (doc_id, text, lang); see predicted for odd texts."""
    answer = predicted(docs, fit(training(docs), settings), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(fold(F.col("doc_id"), 3), F.lit(0)) == 1).alias("held_out"), answer.alias("answer"))
    return rows.select("doc_id", "held_out", F.col("answer.lang").alias("lang_pred"), F.col("answer.score").cast("double").alias("score"))


def keep_known(docs: DataFrame, least_score: float = 0.25, settings: Settings = Settings()) -> DataFrame:
    """Documents without those of no language: null or without a letter, unlike the landmarks, or scored below `least_score` for every language."""
    answer = predicted(docs, fit(training(docs), settings), F.col("text"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), answer.alias("answer"))
    return rows.where((F.col("answer.lang") != NONE) & F.col("answer.alike") & (F.col("answer.score") >= least_score)).select("doc.*")
