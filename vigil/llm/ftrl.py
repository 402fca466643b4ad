"""FTRL-proximal training of sparse (multinomial) logistic regression.

Per-coordinate learning rates, L1 and L2 penalties (elastic net): a weight is
zero until its accumulated gradient exceeds the L1 penalty. The learner takes a
bounded sample of rows in CSR form (numpy); its state has one entry per feature
and class, whatever the number of rows is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row ends, numbers) of a binary column of little-endian int32 arrays; the
    numbers are a view of the column's memory."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):  # no chunk at all
        return np.zeros(1, np.int64), np.zeros(0, np.int32)
    _, ends, data = array.buffers()
    ends = np.frombuffer(ends, "<i4")[array.offset:array.offset + len(array) + 1].astype(np.int64) // 4
    return ends - ends[0], np.frombuffer(data, "<i4")[ends[0]:ends[-1]] if data else np.zeros(0, np.int32)


class Rows:
    """A CSR matrix: row k holds features ``idx[ptr[k]:ptr[k + 1]]``, each once,
    with the values ``val`` (all 1 if None)."""

    def __init__(self, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray | None = None):
        self.ptr, self.idx, self.val = ptr, idx, val

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def take(self, rows: np.ndarray) -> "Rows":
        sizes = (self.ptr[1:] - self.ptr[:-1])[rows]
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.ptr[:-1][rows] - ptr[:-1], sizes) + np.arange(ptr[-1])
        return Rows(ptr, self.idx[at], None if self.val is None else self.val[at])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Rows times a (features, classes) matrix."""
        parts = weights[self.idx] if self.val is None else self.val[:, None] * weights[self.idx]
        total = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(parts, axis=0, dtype=np.float64)])
        return total[self.ptr[1:]] - total[self.ptr[:-1]]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    def __init__(self, features: int, classes: int, alpha: float = 0.1, beta: float = 1.0,
                 l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.bias = np.zeros(classes)
        self._bias_n = np.zeros(classes)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n)

    def step(self, rows: Rows, target: np.ndarray, weight: np.ndarray) -> None:
        """One mini-batch; ``target`` is (rows, classes)."""
        feats, inverse = np.unique(rows.idx, return_inverse=True)
        z, n = self.z[feats], self.n[feats]
        w = self._weights(z, n)
        local = Rows(rows.ptr, inverse, rows.val)
        error = (softmax(local.dot(w) + self.bias) - target) * weight[:, None]
        per = np.repeat(error, rows.ptr[1:] - rows.ptr[:-1], axis=0)
        if rows.val is not None:
            per *= rows.val[:, None]
        g = np.stack([np.bincount(inverse, per[:, c], len(feats)) for c in range(per.shape[1])], axis=1)
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[feats] = z + g - sigma * w
        self.n[feats] = n + g * g
        b = error.sum(axis=0)  # the bias is not penalised
        self._bias_n += b * b
        self.bias -= self.alpha * b / (self.beta + np.sqrt(self._bias_n))

    def fit(self, rows: Rows, labels: np.ndarray, weight: np.ndarray, epochs: int = 3,
            batch: int = 32, seed: int = 7, subset: np.ndarray | None = None) -> "Ftrl":
        target = np.eye(self.z.shape[1])[labels]
        rng = np.random.default_rng(seed)
        subset = np.arange(len(rows)) if subset is None else subset
        for _ in range(epochs):
            order = rng.permutation(subset)
            for k in range(0, len(order), batch):
                part = order[k:k + batch]
                self.step(rows.take(part), target[part], weight[part])
        return self


def temperature(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that were not
    trained on (golden-section search over its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-(weight * np.log(np.maximum(p, 1e-12))).sum())

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = loss(a), loss(b)
    for _ in range(40):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = loss(b)
    return float(np.exp((lo + hi) / 2))
