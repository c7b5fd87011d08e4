"""Logistic regression on the driver, for bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Sparse:
    """Rows of (columns, values), one after the other; ends[i] is where row i ends."""

    #: Entries that a product turns to wide numbers at once.
    SLICE = 1 << 20

    def __init__(self, sizes: np.ndarray, columns: np.ndarray, values: np.ndarray, n_columns: int) -> None:
        self.shape = (len(sizes), n_columns)
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.col, self.val = columns.astype(np.int32, copy=False), values.astype(np.float32, copy=False)

    @classmethod
    def of(cls, columns: pa.ChunkedArray, values: pa.ChunkedArray, n_columns: int) -> Sparse:
        """From two Arrow columns of lists."""
        sizes = pc.list_value_length(columns).to_numpy()
        return cls(sizes, pc.list_flatten(columns).to_numpy(), pc.list_flatten(values).to_numpy(), n_columns)

    def _slices(self) -> list[slice]:
        return [slice(i, i + self.SLICE) for i in range(0, len(self.row), self.SLICE)]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0])
        for s in self._slices():
            out += np.bincount(self.row[s], self.val[s] * w[self.col[s]], self.shape[0])
        return out

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1])
        for s in self._slices():
            out += np.bincount(self.col[s], self.val[s] * r[self.row[s]], self.shape[1])
        return out


def fit_sparse(
    x: Sparse, y: np.ndarray, pairs: Sparse | None = None, pair_times: np.ndarray | None = None, pair_weight: float = 0.0, ridge: float = 1e-4, steps: int = 400, rate: float = 0.1
) -> tuple[np.ndarray, float]:
    """(weights, intercept) that minimise mean log loss + ridge |w|^2 + pair_weight * mean (pairs . w)^2.

    Each row of pairs is the difference of two inputs whose scores should be the same; the mean counts it pair_times
    times. Adam steps over all rows.
    """
    n, k = x.shape
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    rate_of = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w[-1] = np.log(rate_of / (1 - rate_of))
    for t in range(1, steps + 1):
        miss = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) / n
        grad = np.append(x.t_dot(miss) + 2 * ridge * w[:-1], miss.sum())
        if pairs is not None and pairs.shape[0]:
            grad[:-1] += pairs.t_dot(pair_times * pairs.dot(w[:-1])) * (2 * pair_weight / pair_times.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])
