"""The marginals of a model and their distance to measurements, as functions of one short vector.

Mirror descent moves potentials along gradients, and a gradient is a sum of tables of the measured cliques. So
potentials are kept as one number for each measured cell; the cliques of the junction tree, which may have many more
cells, are only built to be summed again. Measurements of one clique are merged into a precision-weighted mean, which
has the same gradient. A clique of the tree is a matrix (its first attributes by its last ones); all tables within it
are put in by two products of small matrices and read by two more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from marginalia.plans.factors import CliqueVector, Factor, GraphicalModel
from marginalia.types import Clique

#: Cells of one side of a table up to which it is read by products; larger ones are summed along their axes.
SIDE = 512


@dataclass
class Target:
    """What the measurements of one clique say together: precision and mean of each cell, and the loss at the mean."""

    clique: Clique
    precision: np.ndarray
    mean: np.ndarray
    least: float


def merged(model: GraphicalModel, measurements: Sequence) -> list[Target]:
    """A Target for each set of attributes, in the order of the domain."""
    sums: dict[Clique, list] = {}
    for m in measurements:
        own = model.domain.canonical(m.clique)
        shaped = lambda v, m=m, own=own: Factor(model.domain.project(m.clique), v).transpose(own).datavector()
        q, y = shaped(m.diagonal()), shaped(m.y)
        now = sums.setdefault(own, [np.zeros(len(q)), np.zeros(len(q)), 0.0])
        now[0] += q * q / m.sigma**2
        now[1] += q * y / m.sigma**2
        now[2] += float(y @ y) / m.sigma**2
    out = []
    for c, (a, b, yy) in sums.items():
        mean = np.divide(b, a, out=np.zeros(len(a)), where=a > 0)
        out.append(Target(c, a, mean, 0.5 * max(0.0, yy - float(b @ mean))))
    return out


class _Block:
    """The tables within one clique of the tree, where they lie in the vector, and how they are put in and read."""

    def __init__(self, model: GraphicalModel, clique: Clique, tables: list[tuple[Clique, int]]):
        shape = model.domain.project(clique).shape
        self.shape, half = shape, 0
        while half < len(shape) and np.prod(shape[: half + 1], dtype=float) <= np.sqrt(np.prod(shape, dtype=float)) * 1.5:
            half += 1
        sides = (clique[:half], clique[half:])
        self.rows, self.columns = int(np.prod(shape[:half])), int(np.prod(shape[half:]))
        self.summed: list[tuple[slice, tuple[int, ...], tuple[int, ...]]] = []
        across: list[tuple[np.ndarray, Clique, Clique]] = []
        inside: tuple[list, list] = ([], [])  # tables of the first or of the last attributes alone
        for c, start in tables:
            own = tuple(tuple(a for a in side if a in c) for side in sides)
            sizes = [model.domain.size(o) for o in own]
            where = np.arange(start, start + sizes[0] * sizes[1])
            if max(sizes) > SIDE:
                keep = tuple(n if a in c else 1 for a, n in zip(clique, shape, strict=True))
                self.summed.append((slice(start, start + len(where)), keep, tuple(k for k, a in enumerate(clique) if a not in c)))
            elif own[0] and own[1]:
                across.append((where, *own))
            else:
                k = 0 if own[0] else 1
                inside[k].append((where, _marks(model, sides[k], own[k])))
        stacked = lambda ms, n: np.concatenate(ms) if ms else np.zeros((0, n))
        self.inside = [(np.concatenate([w for w, _ in own]).astype(np.int64) if own else np.zeros(0, np.int64), stacked([m for _, m in own], n)) for own, n in zip(inside, (self.rows, self.columns), strict=True)]
        place: tuple[dict, dict] = ({}, {})
        marks: tuple[list, list] = ([], [])
        for _, *own in across:
            for side, o, there, known in zip(sides, own, place, marks, strict=True):
                if o not in there:
                    before = sum(map(len, known))
                    known.append(_marks(model, side, o))
                    there[o] = slice(before, before + len(known[-1]))
        self.left, self.right = (stacked(m, n) for m, n in zip(marks, (self.rows, self.columns), strict=True))
        width = len(self.right)
        spots = [(place[0][i], place[1][j]) for _, i, j in across]
        self.near = np.concatenate([w for w, _, _ in across]) if across else np.zeros(0, np.int64)
        self.at = np.concatenate([(np.arange(r.start, r.stop)[:, None] * width + np.arange(c.start, c.stop)).ravel() for r, c in spots]) if spots else np.zeros(0, np.int64)

    def put(self, t: np.ndarray) -> np.ndarray:
        """The sum of the tables, spread over the clique."""
        small = np.zeros((len(self.left), len(self.right)))
        small.ravel()[self.at] = t[self.near]
        (rows, by_row), (columns, by_column) = self.inside
        # what hangs on rows or on columns alone goes with the same product
        first = np.vstack((self.left, t[rows] @ by_row, np.ones(self.rows)))
        last = np.vstack((small @ self.right, np.ones(self.columns), t[columns] @ by_column))
        out = (first.T @ last).reshape(self.shape)
        for where, keep, _ in self.summed:
            out += t[where].reshape(keep)
        return out

    def read(self, table: np.ndarray, out: np.ndarray) -> None:
        """The sums of the clique's cells for each table."""
        flat = table.reshape(self.rows, self.columns)
        (rows, by_row), (columns, by_column) = self.inside
        if len(self.near):
            out[self.near] = ((self.left @ flat) @ self.right.T).ravel()[self.at]
        if len(rows):
            out[rows] = by_row @ flat.sum(axis=1)
        if len(columns):
            out[columns] = by_column @ flat.sum(axis=0)
        for where, _, gone in self.summed:
            out[where] = table.sum(axis=gone).ravel()


def _marks(model: GraphicalModel, side: Clique, own: Clique) -> np.ndarray:
    """1 where a cell of ``own`` (rows) holds a cell of ``side`` (columns)."""
    shape = model.domain.project(side).shape
    codes = np.indices(shape).reshape(len(shape), -1) if shape else np.zeros((0, 1), np.int64)
    cell = np.zeros(codes.shape[1], np.int64)
    for a in own:
        cell = cell * model.domain[a] + codes[side.index(a)]
    out = np.zeros((model.domain.size(own), len(cell)))
    out[cell, np.arange(len(cell))] = 1.0
    return out


class Dual:
    """Marginals, loss and gradient at a vector of potentials of the tables, on top of the model's own potentials."""

    def __init__(self, model: GraphicalModel, measurements: Sequence, metric: str | Callable = "L2"):
        self.model, self.metric, self.measurements = model, metric, list(measurements)
        self.targets = [] if callable(metric) else merged(model, measurements)
        tables = model.cliques if callable(metric) else [t.clique for t in self.targets]
        starts = np.cumsum([0, *[model.domain.size(c) for c in tables]])
        self.size, self.tables = int(starts[-1]), list(zip(tables, starts[:-1].tolist(), strict=True))
        own: dict[Clique, list[tuple[Clique, int]]] = {c: [] for c in model.cliques}
        for c, start in self.tables:
            own[min((k for k in model.cliques if set(c) <= set(k)), key=model.domain.size)].append((c, start))
        self.blocks = [_Block(model, c, own[c]) for c in model.cliques]
        self.base = [model.potentials[c].values for c in model.cliques]
        self.precision, self.mean = (np.concatenate([getattr(t, n) for t in self.targets]) if self.targets else np.zeros(0) for n in ("precision", "mean"))
        self.least = sum(t.least for t in self.targets)
        self.passing = []
        shapes = [b.shape for b in self.blocks]
        for i, j in model.tree.messages():
            sep = model.tree.separator(i, j)
            gone = tuple(k for k, a in enumerate(model.cliques[i]) if a not in sep)
            self.passing.append((i, j, gone, tuple(n if a in sep else 1 for a, n in zip(model.cliques[j], shapes[j], strict=True))))

    def potentials(self, t: np.ndarray) -> list[np.ndarray]:
        return [base + b.put(t) for base, b in zip(self.base, self.blocks, strict=True)]

    def marginals(self, t: np.ndarray) -> list[np.ndarray]:
        """Clique marginals of the potentials, by two sweeps over the tree; separators are divided out on the way back."""
        mu = []
        for x in self.potentials(t):
            top = x.max()
            mu.append(np.exp(x - (top if np.isfinite(top) else 0.0)))
        sent: dict[tuple[int, int], np.ndarray] = {}
        for i, j, gone, shape in self.passing:
            new = mu[i].sum(axis=gone)
            scale = new.max()
            new = new / scale if scale > 0 else new
            out = new
            if (j, i) in sent:
                old = sent[j, i]
                out = np.divide(new, old, out=np.zeros_like(new), where=old > 0)
            sent[i, j] = new
            mu[j] = mu[j] * out.reshape(shape)
        return [x * (self.model.total / max(float(x.sum()), 1e-300)) for x in mu]

    def read(self, mu: Sequence[np.ndarray]) -> np.ndarray:
        out = np.zeros(self.size)
        for b, x in zip(self.blocks, mu, strict=True):
            b.read(x, out)
        return out

    def loss(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss and gradient at the tables' marginals."""
        if callable(self.metric):
            loss, grad = self.metric(self.vector([p[s : s + self.model.domain.size(c)].reshape(self.model.domain.project(c).shape) for c, s in self.tables]))
            return loss, np.concatenate([grad[c].datavector() for c in self.model.cliques])
        if self.metric == "L1":
            loss, grad = 0.0, np.zeros(self.size)
            place = dict(self.tables)
            for m in self.measurements:
                own = self.model.domain.canonical(m.clique)
                q, y = (Factor(self.model.domain.project(m.clique), v).transpose(own).datavector() for v in (m.diagonal(), m.y))
                where = slice(place[own], place[own] + len(q))
                far = (q * p[where] - y) / m.sigma
                loss += float(np.abs(far).sum())
                grad[where] += np.sign(far) * q / m.sigma
            return loss, grad
        far = p - self.mean
        grad = self.precision * far
        return 0.5 * float(far @ grad) + self.least, grad

    def bend(self) -> float:
        """How much the loss can bend over a move of a whole table, against its size: the greatest precision, times the rows."""
        most = max((float((m.diagonal() ** 2).max(initial=0.0)) / m.sigma**2 for m in self.measurements), default=0.0)
        return max(most * self.model.total, 1e-12)

    def bent(self, move: np.ndarray) -> float:
        """What the loss bends by over a move of the tables (of a loss that isn't quadratic: nothing is known)."""
        return float((self.precision * move) @ move) if self.metric == "L2" else 0.0

    def vector(self, values: Sequence[np.ndarray]) -> CliqueVector:
        return CliqueVector({c: Factor(self.model.domain.project(c), v) for c, v in zip(self.model.cliques, values, strict=True)})
