"""Whitening of embeddings by their leading components, found by slicing the spectrum of the covariance.

Vectors become whole numbers, floor(256 c). The mean and the covariance are those of the distinct vectors. Each task sums
up the outer products of vectors less the mean, rounded to whole numbers; these sums are exact, so the covariance is the
exact one, rounded once, whatever the number and order of tasks.

The k-th largest eigenvalue is isolated by counting: as many eigenvalues lie above s as the LDL^T factors of V - s I have
positive pivots. Rayleigh quotient iteration, which converges cubically, starts in that interval; counts right above and
below its result certify that it is the k-th one. If they don't, the interval is halved and it starts again. The matrix
has one row for each dimension, so this part runs on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.llm.common import stored, table

SCALE = 256
COMPONENTS = 4
#: Entries have to be under this; whole numbers are longs.
LARGEST = 2.0**54
#: Sums of whole numbers are passed on in LIMBS digits of LIMB bits.
LIMB, LIMBS = 40, 4
#: Eigenvalues up to this share of the trace count as zero, and are nearer to each other than this share as equal.
TINY = 1e-12
BUNCH = (1 + 17**0.5) / 8


def whole(vector: Column) -> Column:
    """floor(256 c) of each entry as longs; null if the vector or an entry is null, not finite, or LARGEST or more."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    fits = F.coalesce(F.forall(wide, lambda c: F.abs(c) < LARGEST), F.lit(False))  # NaN counts as larger than any number
    return F.when(fits, F.transform(wide, lambda c: F.floor(c * SCALE).cast("long")))


def lattice(df: DataFrame, vector_col: str, x_col: str) -> tuple[DataFrame, int]:
    """(rows of df with x_col, their vectors as whole numbers, number of dimensions).

    Rows whose vector whole() can't take are left out, and so are those of another number of dimensions than most have
    (of equally frequent ones the largest).
    """
    rows = df.withColumn(x_col, whole(F.col(vector_col))).where(F.col(x_col).isNotNull() & (F.size(x_col) > 0))
    most = rows.groupBy(F.size(x_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.where(F.size(x_col) == d), d


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _digits(n: int) -> list[int]:
    """n in LIMBS digits, the last of which has the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(n & ((1 << LIMB) - 1))
        n >>= LIMB
    return [*out, n]


def _number(digits: list[int]) -> int:
    return sum(n << (LIMB * k) for k, n in enumerate(digits))


def exact_sums(rows: DataFrame, d: int, center: list[int] | None = None) -> dict[tuple[int, int], int]:
    """Sums over the vectors of (x): by (i, i) of each entry, or with a center by (i, j), i <= j, of products of the entries less the center's."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d) if center else d, object)
        for batch in batches:
            x = _matrix(batch, d)
            if not len(x):
                continue
            if center is None:
                near = len(x) * max(abs(int(x.max())), abs(int(x.min()))) < 1 << 62
                total += (x.sum(axis=0) if near else x.astype(object).sum(axis=0)).astype(object)
                continue
            middle = np.array(center, object)
            z = x - middle.astype(np.int64) if max(map(abs, center)) < 1 << 62 and abs(x).max() < 1 << 62 else x.astype(object) - middle
            most = int(abs(z).max())
            if most * most * len(z) < 1 << 53:  # sums of doubles are exact up to there
                z = z.astype(np.float64)
                total += (z.T @ z).astype(np.int64).astype(object)
            else:
                z = z.astype(object)
                total += z.T @ z
        cells = [(i, i, int(total[i])) for i in range(d)] if center is None else [(i, j, int(total[i, j])) for i in range(d) for j in range(i, d)]
        out = {"i": [c[0] for c in cells], "j": [c[1] for c in cells]} | {f"n{k}": [_digits(c[2])[k] for c in cells] for k in range(LIMBS)}
        yield pa.RecordBatch.from_pydict(out, pa.schema([(n, pa.int64()) for n in out]))

    names = [f"n{k}" for k in range(LIMBS)]
    parts = rows.select("x").mapInArrow(add, ", ".join(f"{n} bigint" for n in ("i", "j", *names)))
    got = parts.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names]).collect()  # d * d rows at most
    return {(r["i"], r["j"]): _number([r[n] for n in names]) for r in got}


def covariance(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, V): number of vectors of (x), their sums in each dimension, and their covariance with divisor n."""
    n = fit.count()
    sums = exact_sums(fit, d)
    s = [sums[i, i] for i in range(d)]
    center = [(2 * t + n) // (2 * n) for t in s]
    rest = [t - n * c for t, c in zip(s, center, strict=True)]
    products = exact_sums(fit, d, center)
    v = np.zeros((d, d))
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n)  # whole numbers, so the quotient is the nearest double
    return n, s, v


def positive_pivots(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, from the pivots of its LDL^T factors (Bunch and Kaufman's choice)."""
    a = a.copy()
    found = 0
    while len(a):
        below = np.abs(a[1:, 0])
        lam = below.max(initial=0.0)
        step, swap = 1, 0
        if abs(a[0, 0]) < BUNCH * lam:
            r = int(below.argmax()) + 1
            row = np.abs(a[r])
            row[r] = 0
            sigma = row.max()
            if abs(a[0, 0]) * sigma < BUNCH * lam * lam:
                if abs(a[r, r]) >= BUNCH * sigma:
                    swap = r
                else:
                    step, swap = 2, r
        if swap:
            order = np.arange(len(a))
            order[[step - 1, swap]] = order[[swap, step - 1]]
            a = a[np.ix_(order, order)]
        if step == 1:
            p = a[0, 0]
            found += int(p > 0)
            a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:]) / p if p else a[1:, 1:]
        else:
            found += 1  # such a block has one pivot of either sign
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
    return found


def _solve(v: np.ndarray, shift: float, b: np.ndarray, scale: float) -> np.ndarray:
    for off in (0.0, 1e-16, 1e-15, 1e-14):
        try:
            x = np.linalg.solve(v - (shift + off * scale) * np.eye(len(v)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x / np.linalg.norm(x)
    return b


def leading(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of the k largest eigenvalues above TINY times the trace, falling."""
    d, scale = len(v), float(np.trace(v))
    if not scale > 0:
        return np.zeros(0), np.zeros((0, d))
    above = lambda s: positive_pivots(v - s * np.eye(d))
    least = TINY * scale
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)  # no eigenvalue is larger
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for number in range(1, min(k, above(least)) + 1):
        lo, hi, n_lo, n_hi = least, top, above(least), 0
        while True:
            alone = n_lo == number and n_hi == number - 1
            close = hi - lo <= TINY * scale  # equal as far as doubles go: any basis of their space will do
            if alone or close:
                x = np.cos(1.0 + np.arange(d) * (1 + number))  # no eigenvector of ordinary data
                shift = (lo + hi) / 2
                for turn in range(40):
                    for y in vectors:
                        x = x - (x @ y) * y
                    x = _solve(v, shift, x / np.linalg.norm(x), scale)
                    value = float(x @ v @ x)
                    miss = float(np.linalg.norm(v @ x - value * x))
                    if miss <= 4e-16 * scale:
                        break
                    if turn and not close:
                        shift = value
                near = max(4 * miss, 1e-14 * scale)
                if close or (lo <= value <= hi and miss < 1e-13 * scale and above(value + near) == number - 1 and above(value - near) >= number):
                    if close:
                        for y in vectors:
                            x = x - (x @ y) * y
                        x /= np.linalg.norm(x)
                    values.append(value)
                    vectors.append(x)
                    break
            middle = (lo + hi) / 2
            n = above(middle)
            if n >= number:
                lo, n_lo = middle, n
            else:
                hi, n_hi = middle, n
    return np.array(values), np.array(vectors).reshape(-1, d)


@dataclass
class Whitening:
    """n vectors were fitted, with sums S; values and vectors: the components; explained: each one's share of the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        center = np.array([s / self.n for s in self.sums])
        return (x - center) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Of each row: the sum over dimensions of (n x - S)^2, exact."""
        most = self.n * int(abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, len(self.sums)) < 1 << 63:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * x.astype(object) - np.array(self.sums, object)
        return (y * y).sum(axis=1).tolist()


def fit(rows: DataFrame, d: int, k: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """(whitening, the distinct vectors (x)) of rows (x) of d entries."""
    distinct = stored(rows.select("x").distinct())
    n, sums, v = covariance(distinct, d)
    values, vectors = leading(v, k)
    return Whitening(n, sums, values, vectors, values / max(float(np.trace(v)), 1e-300)), distinct


def identity_error(distinct: DataFrame, d: int, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity, over (x)."""
    k = len(w.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            y = np.hstack([np.ones((batch.num_rows, 1)), w.project(_matrix(batch, d))])
            total += y.T @ y
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    got = distinct.select("x").mapInArrow(add, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # (k + 1)^2 rows at most
    m = np.zeros((k + 1, k + 1))
    for r in got:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"] / w.n
    return float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k)).max(initial=0.0))


RESULT = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
PER_ROW = T.StructType().add("deviation", T.StringType()).add("whitened", T.ArrayType(T.DoubleType()))


def whiten(df: DataFrame, vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """df without vector_col, a row for each component (from 1) of each vector, with RESULT; deviation is text, as it has any number of digits.

    Left out are rows that lattice() leaves out. Repeated vectors count once in the fit and stay rows of their own.
    Components whose eigenvalue is zero are not returned, as nothing can be divided by it: a table of equal vectors, or
    an empty one, gives no rows. The caller's columns keep their names and values, but for those named like RESULT's,
    which are replaced.
    """
    spark = df.sparkSession
    own = [c for c in df.columns if c not in (vector_col, *RESULT)]
    packed = df.select(F.struct(*[F.col(c) for c in own] or [F.lit(None).alias("nothing")]).alias("own"), F.col(vector_col).alias("vector"))
    rows, d = lattice(packed, "vector", "x")
    rows = rows.select("own", "x")
    kept = [F.col("own")[c].alias(c) for c in own]
    schema = "component int, n bigint, deviation string, whitened double, explained double, identity_error double"
    w, distinct = fit(rows, d, k) if d else (None, None)
    if w is None or not len(w.values):
        nothing = spark.createDataFrame([], schema)
        return rows.where(F.lit(False)).select(*kept).crossJoin(nothing)  # two empty tables
    error = identity_error(distinct, d, w)

    @F.pandas_udf(PER_ROW)
    def per_row(vectors: pd.Series) -> pd.DataFrame:
        x = np.array(vectors.tolist(), np.int64).reshape(-1, d)
        return pd.DataFrame({"deviation": list(map(str, w.deviations(x))), "whitened": list(w.project(x))})

    shares = F.array(*[F.lit(float(e)) for e in w.explained])
    got = rows.select("own", per_row("x").alias("r")).select("own", "r.deviation", F.posexplode("r.whitened").alias("i", "whitened"))
    return got.select(
        *kept, (F.col("i") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
        "whitened", shares[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is a long here: null where it is beyond one, which takes some 10^8 distinct vectors of unit length."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
