"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers, so counts and sums are exact and a centred entry is (n * x - S) / n of whole numbers,
rounded once. The covariance V is never built: a pass over all vectors gives V Q for a block Q of a few columns, from
centred rows Z as Zt (Z Q) / n. Tasks add up their batches and Spark adds up the tasks, so the driver gets d times the
number of columns, whatever the number of vectors.

The block holds the wanted components and some more (`GUARD`). Each round applies a Chebyshev polynomial of V to it, by the three-term
recurrence and one pass a degree: it is small on the interval [low, high] of the unwanted eigenvalues and grows fast
above it. `high` is the smallest Ritz value of the block; `low` comes from some steps of Lanczos, whose vector rides
along in the passes of the first round. Then the block is made orthonormal (QR), one more pass gives V Q, and
Rayleigh-Ritz turns the block to the eigenvectors. A round also filters one new random column, so that a direction that the block had missed
would come up. It ends when, for all wanted components, the residual |V q - e q| is as small as rounding lets it be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketspark.llm.common import settled

COMPONENTS = 8
GUARD = 24
DEGREE = 10
ROUNDS = 60
LARGEST = float(1 << 52)  # entries from here on (times SCALE) have no exact place value and count as not finite
SCALE, SHIFT = 1024, 100_000
#: Residuals in units of the largest eigenvalue: certified below TOLERANCE; given up as rounding below ROUNDING when a round gains nothing.
TOLERANCE, ROUNDING = 2e-15, 1e-12
#: Components whose share of the trace is below this have no variance.
NO_VARIANCE = 1e-13
_ROWS = 4096
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and x (whole numbers) of the rows (vec_id, embedding) that take part, written once."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * SCALE) < F.lit(LARGEST)))
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0))
    found = found.where(F.coalesce(finite, F.lit(False)))
    found = settled(found.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x")), "whitening-vectors")
    common = found.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found.where(F.size("x") == (common.d if common else 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            x = batch.column(column).slice(at, _ROWS)
            yield x.flatten().to_numpy().reshape(len(x), -1)


def _summed(rows: DataFrame, kind: str, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all vectors of what `part` makes of a matrix of some of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches, 0):
            total = part(x) if total is None else total + part(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    found = rows.select("x").mapInArrow(run, f"i long, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect()
    result = np.zeros(int(np.prod(shape)), np.int64 if kind == "long" else float)
    for r in found:
        result[r.i] = r.v
    return result.reshape(shape)


class Fit:
    """Number and sums of the vectors, and products with their covariance."""

    def __init__(self, rows: DataFrame, d: int):
        self.rows, self.d = rows, d
        self.n = rows.count()
        self.sums = _summed(rows, "long", lambda x: x.sum(axis=0), (d,))
        size = rows.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()[0]
        # n * x - S as machine numbers, or as Python's where these would not hold it.
        self.wide = 2 * self.n * int(size) >= 1 << 62
        self.passes = 0
        self.trace = float(_summed(rows, "double", self.apart()._square, (1,))[0])

    def apart(self) -> Fit:
        """Itself without the table, to be sent to tasks."""
        other = object.__new__(Fit)
        other.__dict__ = {k: v for k, v in self.__dict__.items() if k != "rows"}
        return other

    def whole(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if self.wide:
            return x.astype(object) * self.n - self.sums.astype(object)
        return x * self.n - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.whole(x) / self.n).astype(float)

    def _square(self, x: np.ndarray) -> np.ndarray:
        z = self.centred(x)
        return np.array([np.einsum("ij,ij->", z, z) / self.n])

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q of a block of columns, in one pass."""
        own, n = self.apart(), self.n
        self.passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            z = own.centred(x)
            return z.T @ (z @ q) / n

        return _summed(self.rows, "double", part, q.shape)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of n * x - S; null beyond a long."""
        u = self.whole(x)
        if not self.wide and float(np.abs(u).max(initial=0)) ** 2 * self.d < 2.0**62:
            return (u * u).sum(axis=1).tolist()
        found = [sum(int(v) ** 2 for v in row) for row in u]
        return [v if v < 1 << 63 else None for v in found]


class Lanczos:
    """Steps from one random vector; low() is at or below nearly all of the spectrum."""

    def __init__(self, start: np.ndarray):
        self.basis, self.diagonal, self.off = [start / np.linalg.norm(start)], [], []

    def step(self, product: np.ndarray) -> None:
        v = self.basis[-1]
        self.diagonal.append(float(v @ product))
        rest = product.copy()
        for _ in range(2):
            for b in self.basis:
                rest -= (b @ rest) * b
        size = float(np.linalg.norm(rest))
        self.off.append(size)
        self.basis.append(rest / size if size > 1e-12 * abs(self.diagonal[0]) else np.zeros_like(v))

    def low(self) -> float:
        steps = len(self.diagonal)
        t = np.diag(self.diagonal) + np.diag(self.off[: steps - 1], 1) + np.diag(self.off[: steps - 1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, float(values[0]) - self.off[-1] * abs(float(vectors[-1, 0])))


def components(fit: Fit, k: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the covariance and their unit eigenvectors (columns), falling."""
    d = fit.d
    k, size = min(k, d), min(d, k + guard)
    rng = np.random.default_rng(12)
    lanczos = Lanczos(rng.standard_normal(d))
    low, last = 0.0, np.inf

    def ritz(block: np.ndarray, extra: np.ndarray):
        """Ritz values and vectors of the block with their products, and the product of the extra columns."""
        q, _ = np.linalg.qr(block)
        y = fit.product(np.column_stack([q, extra]))
        y, more = y[:, : q.shape[1]], y[:, q.shape[1] :]
        h = q.T @ y
        values, turn = np.linalg.eigh((h + h.T) / 2)
        turn = turn[:, np.argsort(-values)][:, :size]
        return np.sort(values)[::-1][:size], q @ turn, y @ turn, more

    fresh = rng.standard_normal((d, 1))
    values, q, y, more = ritz(rng.standard_normal((d, size)), np.column_stack([fresh, lanczos.basis[-1]]))
    lanczos.step(more[:, 1])
    for turn in range(rounds):
        top = float(values[0])
        wrong = np.linalg.norm(y[:, :k] - q[:, :k] * values[:k], axis=0).max(initial=0.0)
        if top <= 0 or size == d or (turn and (wrong <= TOLERANCE * top or (wrong <= ROUNDING * top and wrong > last / 2))):
            break
        last = wrong
        # The filter: block and new random column by the recurrence scaled to 1 at the largest eigenvalue.
        high = max(float(values[-1]), 1e-6 * top)
        floor = min(low, 0.9 * high)
        middle, half = (high + floor) / 2, (high - floor) / 2
        sigma = half / (top - middle) if top > high else 1.0
        tau = 2 / sigma
        before, product = np.column_stack([q, fresh]), np.column_stack([y, more[:, :1]])
        now = (product - middle * before) * (sigma / half)
        for _ in range(degree - 1):
            ride = lanczos.basis[-1][:, None] if turn == 0 else np.empty((d, 0))
            product = fit.product(np.column_stack([now, ride]))
            if turn == 0:
                lanczos.step(product[:, -1])
                product = product[:, :-1]
            step = 1 / (tau - sigma)
            now, before, sigma = (product - middle * now) * (2 * step / half) - sigma * step * before, now, step
        low = lanczos.low()
        fresh = rng.standard_normal((d, 1))
        values, q, y, more = ritz(now / np.linalg.norm(now, axis=0), fresh)
    else:
        raise RuntimeError(f"not certified after {rounds} rounds: residual {wrong / top:.1e} of the largest eigenvalue")
    return np.maximum(values[:k], 0.0), q[:, :k]


def whitened(rows: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row (vec_id, embedding) that takes part.

    Rows whose vector is null, empty or holds null, non-finite or huge (2^42 and more) entries are dropped, and so are those of another number
    of entries than most rows have (the larger of equally frequent ones). Repeated rows count as often as they stand
    there; null ids stay null. A component without variance has no whitened value. A deviation beyond a long is null.
    Without a usable vector there are no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    rows = usable(rows)
    head = rows.first()
    if head is None:
        return spark.createDataFrame([], _RESULT)
    fit = Fit(rows, len(head.x))
    values, vectors = components(fit, k)
    k, sent = len(values), fit.apart()
    alive = values > NO_VARIANCE * fit.trace
    scaled = vectors[:, alive] / np.sqrt(values[alive])
    m = scaled.shape[1]
    # Whitened values have mean zero as the centred entries have, up to their rounding.
    spread = _summed(rows, "double", lambda x: (w := sent.centred(x) @ scaled).T @ w / sent.n, (m, m))
    error = float(np.abs(spread - np.eye(m)).max(initial=0.0))
    explained = values / fit.trace if fit.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            at = 0
            for x in _matrices([batch], 1):
                b = len(x)
                values = np.full((b, k), np.nan)
                values[:, alive] = sent.centred(x) @ scaled
                each = np.repeat(np.arange(b), k)
                columns = [
                    ids.slice(at, b).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b)), pa.array(np.full(b * k, sent.n)),
                    pa.array(sent.deviation(x), pa.int64()).take(pa.array(each)), pa.array(values.ravel(), mask=np.tile(~alive, b)), pa.array(np.tile(explained, b)), pa.array(np.full(b * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RESULT.split(", ")])
                at += b

    return rows.select("vec_id", "x").mapInArrow(run, _RESULT)
