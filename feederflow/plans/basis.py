"""Sparse columns, and the factors of a basis: a triangular factorisation kept up to date by product-form etas."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Columns:
    """A matrix by columns: the entries of column ``j`` stand from ``starts[j]`` to ``starts[j + 1]``."""

    shape: tuple[int, int]
    starts: np.ndarray
    index: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray | Columns) -> Columns:
        if isinstance(a, Columns):
            return a
        j, i = np.nonzero(a.T)
        return cls.from_triplets(a.shape, i, j, a[i, j])

    @classmethod
    def from_triplets(cls, shape: tuple[int, int], row: np.ndarray, col: np.ndarray, val: np.ndarray) -> Columns:
        """Entries at the same place are added up."""
        key, where = np.unique(col.astype(np.int64) * max(1, shape[0]) + row, return_inverse=True)
        value = np.bincount(where, val, len(key)) if len(key) else np.zeros(0)
        starts = np.searchsorted(key, np.arange(shape[1] + 1) * max(1, shape[0]))
        return cls(shape, starts, key % max(1, shape[0]), value)

    @property
    def column_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.shape[1]), np.diff(self.starts))

    def column(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[j], self.starts[j + 1]
        return self.index[a:b], self.value[a:b]

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * np.repeat(x, np.diff(self.starts)), self.shape[0])

    def dual(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.column_of, self.value * y[self.index], self.shape[1])

    def with_rows(self, rows: np.ndarray) -> Columns:
        """More rows below, dense."""
        i, j = np.nonzero(rows)
        m, n = self.shape
        parts = ((self.index, i + m), (self.column_of, j), (self.value, rows[i, j]))
        return Columns.from_triplets((m + len(rows), n), *map(np.concatenate, parts))

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape)
        out[self.index, self.column_of] = self.value
        return out


class Factors:
    """``B = L U`` up to the order of rows and columns.

    Columns are taken from the shortest on; of the rows whose entry is at least ``threshold`` of the largest, the
    one with the fewest entries in the basis is the pivot, so that singletons come first and fill stays small.
    """

    def __init__(self, m: int, columns: list[tuple[np.ndarray, np.ndarray]], threshold: float = 0.1, least: float = 1e-11):
        self.m, self.ok, self.etas = m, True, []
        count = np.bincount(np.concatenate([c[0] for c in columns]), minlength=m).tolist() if m else []
        self.order = sorted(range(m), key=lambda k: len(columns[k][0]))  # basis position by pivot
        place = [-1] * m  # pivot of a row
        self.row = []  # row by pivot
        self.lower: list[list[tuple[int, float]]] = []
        self.upper: list[list[tuple[int, float]]] = []
        self.diagonal: list[float] = []
        for at, k in enumerate(self.order):
            work = dict(zip(columns[k][0].tolist(), columns[k][1].tolist(), strict=True))
            todo = [place[r] for r in work if place[r] >= 0]
            heapq.heapify(todo)
            above: list[tuple[int, float]] = []
            last = -1
            while todo:
                p = heapq.heappop(todo)
                if p == last:
                    continue
                last = p
                x = work.pop(self.row[p])
                if x == 0.0:
                    continue
                above.append((p, x))
                for r, v in self.lower[p]:
                    if r in work:
                        work[r] -= x * v
                    else:
                        work[r] = -x * v
                        if place[r] >= 0:
                            heapq.heappush(todo, place[r])
            most = max(map(abs, work.values()), default=0.0)
            if most <= least:
                self.ok = False
                return
            r = min((r for r, v in work.items() if abs(v) >= threshold * most), key=lambda r: (count[r], r))
            pivot = work.pop(r)
            place[r] = at
            self.row.append(r)
            self.upper.append(above)
            self.diagonal.append(pivot)
            self.lower.append([(i, v / pivot) for i, v in work.items() if v != 0.0])
        self.some_lower = [p for p in range(m) if self.lower[p]]
        self._order, self._row, self._diagonal = np.array(self.order, np.int64), np.array(self.row, np.int64), np.array(self.diagonal)
        self.fill = sum(map(len, self.lower)) + sum(map(len, self.upper))

    def column(self, b: np.ndarray) -> np.ndarray:
        """``x`` with ``B x = b``, by basis position."""
        w = b.tolist()
        row, lower, upper, diagonal = self.row, self.lower, self.upper, self.diagonal
        for p in self.some_lower:
            x = w[row[p]]
            if x:
                for r, v in lower[p]:
                    w[r] -= x * v
        z = [w[r] for r in row]
        for p in range(self.m - 1, -1, -1):
            x = z[p]
            if x:
                x = z[p] = x / diagonal[p]
                for q, u in upper[p]:
                    z[q] -= u * x
        out = np.empty(self.m)
        out[self._order] = z
        for r, w_, at in self.etas:
            x = out[r] / w_[at]
            out -= w_ * x
            out[r] = x
        return out

    def row_of(self, c: np.ndarray) -> np.ndarray:
        """``y`` with ``y B = c``."""
        c = c.copy()
        for r, w_, at in reversed(self.etas):
            c[r] = (c[r] - (w_ @ c - w_[at] * c[r])) / w_[at]
        v = c[self._order].tolist()
        upper, diagonal = self.upper, self.diagonal
        for p in range(self.m):
            x = v[p]
            for q, u in upper[p]:
                x -= u * v[q]
            v[p] = x / diagonal[p] if x else 0.0
        y = [0.0] * self.m
        for r, x in zip(self.row, v, strict=True):
            y[r] = x
        for p in reversed(self.some_lower):
            y[self.row[p]] -= sum(x * y[r] for r, x in self.lower[p])
        return np.array(y)

    def replace(self, r: int, w: np.ndarray) -> None:
        """The column at position ``r`` gives way to one that is ``B w``."""
        self.etas.append((r, w.copy(), r))


class Inverse:
    """The same for a small basis, as a dense inverse."""

    def __init__(self, m: int, columns: list[tuple[np.ndarray, np.ndarray]]):
        b = np.zeros((m, m))
        for k, (i, v) in enumerate(columns):
            b[i, k] = v
        self.ok = True
        try:
            self.inverse = np.linalg.inv(b)
        except np.linalg.LinAlgError:
            self.ok = False
        self.ok = self.ok and bool(np.isfinite(self.inverse).all())

    def column(self, b: np.ndarray) -> np.ndarray:
        return self.inverse @ b

    def row_of(self, c: np.ndarray) -> np.ndarray:
        return c @ self.inverse

    def replace(self, r: int, w: np.ndarray) -> None:
        row = self.inverse[r] / w[r]
        self.inverse -= np.outer(w, row)
        self.inverse[r] = row
