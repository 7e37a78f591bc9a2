"""Whitening of embeddings on their leading principal components, found by spectrum slicing.

The components are eigenvectors of the covariance of the distinct fixed-point vectors. Spark adds up the covariance (whole
numbers, centred on the rounded mean before they are multiplied, so that the sums are exact as long as they stay below 2^53); the
dimension-by-dimension matrix alone comes to the driver. There

- an LDL' factorisation with symmetric pivoting of the covariance less a shift counts the eigenvalues above the shift (inertia),
- bisection on these counts isolates each leading eigenvalue in an interval of its own,
- inverse iteration within the interval and then Rayleigh quotient iteration converge (cubically) to its vector,
- two more counts, closely below and above the value found, certify its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from changeproof.llm.common import written

#: Units of the fixed-point vectors in one.
UNITS = 256
COMPONENTS = 4
_EPS = float(np.finfo(float).eps)
#: Largest growth of a pivot that 1 x 1 steps may cause before a 2 x 2 step is taken (Bunch and Parlett).
_PIVOT = (1 + 17**0.5) / 8
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above shift: the positive pivots of matrix - shift = L D L'."""
    a, above = matrix - shift * np.eye(len(matrix)), 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        k, off = int(diagonal.argmax()), np.abs(a)
        np.fill_diagonal(off, -1.0)
        i, j = divmod(int(off.argmax()), len(a))
        if diagonal[k] == 0 and off[i, j] <= 0:
            break
        if diagonal[k] >= _PIVOT * off[i, j]:
            above += bool(a[k, k] > 0)
            rest = np.delete(np.arange(len(a)), k)
            column = a[rest, k]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[k, k])
        else:
            # A block whose off-diagonal entry outweighs its diagonal has one eigenvalue of each sign.
            above += 1
            rest = np.delete(np.arange(len(a)), [i, j])
            columns = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_([i, j], [i, j])], columns.T)
        a = (a + a.T) / 2
    return above


class Slices:
    """Counts of a matrix at shifts that were asked for, and intervals that hold one eigenvalue each."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.counts = matrix, {}
        self.bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
        # What rounding may move an eigenvalue by.
        self.blur = 4 * _EPS * max(len(matrix), 1) * self.bound

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_above(self.matrix, shift)
        return self.counts[shift]

    def interval(self, k: int) -> tuple[float, float]:
        """(low, high) that holds the k-th eigenvalue alone, with no other as near as its width on either side.

        Eigenvalues that are equal up to blur share an interval of that width.
        """
        self.above(-self.bound - self.blur), self.above(self.bound + self.blur)
        low = max(s for s, c in self.counts.items() if c >= k)
        high = min(s for s, c in self.counts.items() if c < k and s > low)
        while high - low > self.blur and (self.above(2 * low - high) > k or self.above(2 * high - low) < k - 1):
            middle = (low + high) / 2
            if self.above(middle) >= k:
                low = middle
            else:
                high = middle
        return low, high


def _apart(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            v = v - u * (u @ v)
    return v / np.linalg.norm(v)


def _step(matrix: np.ndarray, shift: float, v: np.ndarray, found: list[np.ndarray], blur: float) -> np.ndarray:
    for nudge in (0.0, blur / 8, blur):
        try:
            new = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(v)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(new).all() and new.any():
            return _apart(new, found)
    return v


def leading(matrix: np.ndarray, most: int) -> list[tuple[float, np.ndarray]]:
    """The eigenvalues above rounding and their unit vectors, at most ``most``, largest first."""
    slices, out = Slices(matrix), []
    for k in range(1, min(most, slices.above(16 * slices.blur)) + 1):
        low, high = slices.interval(k)
        found = [v for _, v in out]
        v = _apart(np.random.default_rng(k).normal(size=len(matrix)), found)
        rest = lambda v: float(np.linalg.norm(matrix @ v - (v @ matrix @ v) * v))
        for _ in range(200):
            # No other eigenvalue is nearer to the middle than three times this one, so each step shrinks what is left of the others to a third.
            v = _step(matrix, (low + high) / 2, v, found, slices.blur)
            value = float(v @ matrix @ v)
            if low < value < high and rest(v) <= max(min(value - low, high - value), slices.blur):
                break
        best = rest(v)
        for _ in range(20):
            new = _step(matrix, float(v @ matrix @ v), v, found, slices.blur)
            if rest(new) >= best:
                break
            v, best = new, rest(new)
        value = float(v @ matrix @ v)
        near = max(2 * best, 4 * slices.blur)
        if slices.above(value - near) < k or slices.above(value + near) >= k and high - low > 4 * near:
            raise ArithmeticError(f"eigenvalue {k} was not certified")
        out.append((value, v))
    return out


def fixed_point(vector: Column) -> Column:
    """floor(256 * c) of each entry as a long; null for a vector that is null or holds a null or non-finite entry."""
    entries = vector.cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(sound, F.transform(entries, lambda c: F.floor(c * F.lit(float(UNITS))).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(vectors: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over vectors(x) of an array of numbers that ``part`` makes of some of them; one array a task goes to Spark's sum."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = part(_matrix(batch.column(0), width))
                total = new if total is None else total + new
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "value"])

    kind = "long" if part(np.zeros((0, width), np.int64)).dtype == np.int64 else "double"
    rows = vectors.select("x").mapInArrow(made, f"place long, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = part(np.zeros((0, width), np.int64))
    shape, flat = out.shape, out.ravel()
    for row in rows:
        flat[row.place] = row.value
    return flat.reshape(shape)


def covariance(vectors: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sum of each dimension, covariance with divisor n) of vectors(x), each an array of ``width`` longs."""
    counted = _summed(vectors, lambda x: np.concatenate((x.sum(axis=0), [len(x)])).astype(np.int64), width).tolist()
    n, sums = counted[-1], counted[:-1]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - centre).astype(np.float64)
        return y.T @ y

    about = _summed(vectors, products, width)
    left = [s - n * c for s, c in zip(sums, centre.tolist(), strict=True)]
    # Whole numbers of any size, so the move from the rounded to the true mean loses nothing.
    cov = [[(n * int(about[i, j]) - left[i] * left[j]) / (n * n) for j in range(width)] for i in range(width)]
    return n, sums, np.array(cov).reshape(width, width)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    most = max(n * int(np.abs(x).max(initial=0)), max(map(abs, sums)))
    exact = 4 * most * most * x.shape[1] < 1 << 63
    t = x * n - np.array(sums, np.int64) if exact else x.astype(object) * n - np.array(sums, object)
    return [int(d) if d < 1 << 63 else None for d in (t * t).sum(axis=1).tolist()]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """embeddings(vec_id, embedding) to SCHEMA: one row for each sound vector and component, at most ``components``.

    Rows whose vector is null or holds null or non-finite entries are dropped, and so are vectors of another length than the
    most frequent one (of several the shortest) and empty ones. Each entry becomes x = floor(256 * c). The covariance is over the distinct
    x vectors, of which there are n with sums S. deviation is the sum of (n * x - S)^2, null if it exceeds a long. Components are numbered
    from 1 by falling eigenvalue; those whose eigenvalue is 0 up to rounding have no rows, so vectors that are all equal give none.
    Of equal eigenvalues any orthonormal vectors serve. identity_error is measured on the distinct vectors. Repeated rows and
    null ids are kept as they are. An empty table gives an empty one. Other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), fixed_point(F.col("embedding")).alias("x")).where(F.size("x") > 0)
    # One row for each length that occurs.
    usual = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "width").first()
    if usual is None:
        return spark.createDataFrame([], SCHEMA)
    width = usual.width
    rows = rows.where(F.size("x") == width)
    vectors = written(rows.select("x").distinct())
    n, sums, cov = covariance(vectors, width)
    found = leading(cov, components)
    if not found:
        return spark.createDataFrame([], SCHEMA)
    scaled = np.stack([v / e**0.5 for e, v in found], axis=1)
    explained, mean = [e / float(np.trace(cov)) for e, _ in found], np.array([s / n for s in sums])
    many = len(found)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = (_matrix(batch.column(0), width) - mean) @ scaled
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(many)], [f"w{k}" for k in range(many)])

    each = vectors.mapInArrow(projected, ", ".join(f"w{k} double" for k in range(many)))
    pairs = [(i, j) for i in range(many) for j in range(i, many)]
    cells = each.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(cells[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            again = np.repeat(np.arange(len(x)), many)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))), pa.array(np.full(len(again), n)),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(again)), pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(again), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(made, SCHEMA)
