"""Linear query operators over data vectors: identity, ones, scalings, sums and products.

Measurements use their diagonals only (``Measurement.q``); these serve queries that users build.
"""

from __future__ import annotations

from functools import reduce

import numpy as np


class Query:
    """A matrix known by its action; ``dense`` is for small ones."""

    shape: tuple[int, int]

    def apply(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    @property
    def T(self) -> Query:
        return Dense(self.dense().T)

    def dense(self) -> np.ndarray:
        return self.apply(np.eye(self.shape[1]))

    def gram(self) -> Query:
        return Product(self.T, self)

    def l1_sensitivity(self) -> float:
        """Greatest column sum of absolute weights."""
        return float(np.abs(self.dense()).sum(axis=0).max())

    def l2_sensitivity(self) -> float:
        return float(np.sqrt((self.dense() ** 2).sum(axis=0).max()))

    def sum(self, axis: int | None = None):
        return self.dense().sum(axis=axis)

    def trace(self) -> float:
        return float(np.trace(self.dense()))

    def diag(self) -> np.ndarray:
        return np.diag(self.dense())

    def inverse(self) -> Query:
        return Dense(np.linalg.inv(self.dense()))

    def pseudo_inverse(self) -> Query:
        return Dense(np.linalg.pinv(self.dense()))

    def row(self, i: int) -> np.ndarray:
        unit = np.zeros(self.shape[0])
        unit[i] = 1
        return self.T.apply(unit)

    def __matmul__(self, other: Query | np.ndarray):
        return Product(self, other) if isinstance(other, Query) else self.apply(other)

    def __add__(self, other: Query) -> Query:
        return Sum(self, other)

    def __mul__(self, weight: float) -> Query:
        return Weighted(self, weight)

    __rmul__ = __mul__

    def __neg__(self) -> Query:
        return Weighted(self, -1.0)

    def __sub__(self, other: Query) -> Query:
        return Sum(self, -other)


class Dense(Query):
    def __init__(self, values: np.ndarray):
        self.values = np.atleast_2d(np.asarray(values, float))
        self.shape = self.values.shape

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.values @ x

    def dense(self) -> np.ndarray:
        return self.values


class Identity(Query):
    def __init__(self, n: int):
        self.shape = (n, n)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x

    @property
    def T(self) -> Query:
        return self

    def gram(self) -> Query:
        return self

    def inverse(self) -> Query:
        return self

    pseudo_inverse = inverse


class Ones(Query):
    """All ones: every answer is the total."""

    def __init__(self, rows: int, columns: int):
        self.shape = (rows, columns)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.broadcast_to(x.sum(axis=0), (self.shape[0], *x.shape[1:])).copy()

    @property
    def T(self) -> Query:
        return Ones(self.shape[1], self.shape[0])


class Weighted(Query):
    def __init__(self, base: Query, weight: float):
        self.base, self.weight, self.shape = base, float(weight), base.shape

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.weight * self.base.apply(x)

    @property
    def T(self) -> Query:
        return Weighted(self.base.T, self.weight)

    def inverse(self) -> Query:
        return Weighted(self.base.inverse(), 1 / self.weight)


class Sum(Query):
    def __init__(self, *parts: Query):
        if len({p.shape for p in parts}) != 1:
            raise ValueError("shapes differ")
        self.parts, self.shape = parts, parts[0].shape

    def apply(self, x: np.ndarray) -> np.ndarray:
        return reduce(np.add, (p.apply(x) for p in self.parts))

    @property
    def T(self) -> Query:
        return Sum(*(p.T for p in self.parts))


class Product(Query):
    def __init__(self, left: Query, right: Query):
        if left.shape[1] != right.shape[0]:
            raise ValueError("shapes do not fit")
        self.left, self.right, self.shape = left, right, (left.shape[0], right.shape[1])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.left.apply(self.right.apply(x))

    @property
    def T(self) -> Query:
        return Product(self.right.T, self.left.T)
