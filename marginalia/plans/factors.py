"""Factor algebra, junction trees and graphical models over small discrete domains (NumPy, driver)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import combinations

import numpy as np

from marginalia.types import Clique, Domain


class Factor:
    """A dense table over a domain: counts, probabilities or log-potentials."""

    def __init__(self, domain: Domain, values: np.ndarray):
        self.domain, self.values = domain, np.asarray(values, float).reshape(domain.shape)

    @classmethod
    def full(cls, domain: Domain, value: float) -> Factor:
        return cls(domain, np.full(domain.shape, float(value)))

    zeros = classmethod(lambda cls, d: cls.full(d, 0.0))
    ones = classmethod(lambda cls, d: cls.full(d, 1.0))
    uniform = classmethod(lambda cls, d: cls.full(d, 1.0 / d.size()))
    random = classmethod(lambda cls, d, rng=None: cls(d, (rng or np.random.default_rng()).random(d.shape)))

    @classmethod
    def active(cls, domain: Domain, impossible: Mapping[str, Iterable[int]]) -> Factor:
        """Zero where a cell may be, minus infinity where an attribute has an impossible code."""
        out = cls.zeros(domain)
        for a, codes in impossible.items():
            if a in domain:
                out.values[(slice(None),) * domain.attrs.index(a) + (list(codes),)] = -np.inf
        return out

    def expand(self, domain: Domain) -> Factor:
        mine = [a for a in domain if a in self.domain]
        values = self.values.transpose(self.domain.axes(mine)).reshape([n if a in self.domain else 1 for a, n in domain.sizes.items()])
        return Factor(domain, np.broadcast_to(values, domain.shape))

    def transpose(self, attrs: Sequence[str]) -> Factor:
        return Factor(self.domain.project(attrs), self.values.transpose(self.domain.axes(attrs)))

    def _reduce(self, attrs: Iterable[str] | None, fn: Callable) -> Factor | float:
        attrs = self.domain.attrs if attrs is None else tuple(attrs)
        left = self.domain.marginalize(attrs)
        values = fn(self.values, self.domain.axes(attrs))
        return Factor(left, values) if len(left) else float(values)

    def sum(self, attrs: Iterable[str] | None = None):
        return self._reduce(attrs, lambda v, ax: v.sum(axis=ax))

    def max(self, attrs: Iterable[str] | None = None):
        return self._reduce(attrs, lambda v, ax: v.max(axis=ax))

    def logsumexp(self, attrs: Iterable[str] | None = None):
        return self._reduce(attrs, log_sum_exp)

    def project(self, attrs: Iterable[str], how: str = "sum") -> Factor:
        attrs = (attrs,) if isinstance(attrs, str) else tuple(attrs)
        gone = self.domain.invert(attrs)
        out = self if not gone else {"sum": self.sum, "max": self.max, "logsumexp": self.logsumexp}[how](gone)
        return out.transpose(attrs)

    def condition(self, evidence: Mapping[str, int]) -> Factor:
        at = tuple(evidence.get(a, slice(None)) for a in self.domain)
        return Factor(self.domain.marginalize(a for a in self.domain if a in evidence), self.values[at])

    def _with(self, other: Factor | float, fn: Callable) -> Factor:
        if not isinstance(other, Factor):
            return Factor(self.domain, fn(self.values, other))
        if self.domain == other.domain:
            return Factor(self.domain, fn(self.values, other.values))
        both = self.domain.merge(other.domain)
        return Factor(both, fn(self.expand(both).values, other.expand(both).values))

    def __add__(self, other):
        return self._with(other, np.add)

    def __mul__(self, other):
        return self._with(other, np.multiply)

    __radd__, __rmul__ = __add__, __mul__

    def __sub__(self, other):
        def minus(a, b):
            return np.where(np.isneginf(a), -np.inf, a - np.where(np.isneginf(b), 0.0, b))

        return self._with(other, minus)

    def __truediv__(self, other):
        def ratio(a, b):
            b = np.broadcast_to(b, np.shape(a))
            return np.divide(a, b, out=np.zeros(np.shape(a)), where=b > 0)

        return self._with(other, ratio)

    def exp(self) -> Factor:
        return Factor(self.domain, np.exp(self.values))

    def log(self) -> Factor:
        return Factor(self.domain, np.log(self.values + 1e-100))

    def logaddexp(self, other: Factor) -> Factor:
        return self._with(other, np.logaddexp)

    def copy(self) -> Factor:
        return Factor(self.domain, self.values.copy())

    def datavector(self) -> np.ndarray:
        return self.values.ravel()


class SparseFactor:
    """A table by its occupied cells: their numbers (mixed radix, sorted) and values; every other cell is 0."""

    def __init__(self, domain: Domain, cells: np.ndarray, numbers: np.ndarray):
        order = np.argsort(cells, kind="stable")
        self.domain, self.cells, self.numbers = domain, np.asarray(cells, np.int64)[order], np.asarray(numbers, float)[order]

    @property
    def total(self) -> float:
        return float(self.numbers.sum())

    def sum(self, attrs: Iterable[str] | None = None) -> SparseFactor | float:
        """The total, or sums over some attributes."""
        return self.total if attrs is None else self.project(self.domain.invert(attrs))

    def codes(self) -> dict[str, np.ndarray]:
        """The code of each attribute in each occupied cell."""
        out, rest = {}, self.cells
        for a in reversed(self.domain.attrs):
            rest, out[a] = np.divmod(rest, self.domain[a])
        return out

    def project(self, attrs: Iterable[str] | str) -> SparseFactor:
        """Sums over the other attributes; only occupied cells are touched."""
        attrs = (attrs,) if isinstance(attrs, str) else tuple(attrs)
        codes, cell = self.codes(), np.zeros(len(self.cells), np.int64)
        for a in attrs:
            cell = cell * self.domain[a] + codes[a]
        own, at = np.unique(cell, return_inverse=True)
        return SparseFactor(self.domain.project(attrs), own, np.bincount(at, self.numbers, len(own)))

    def datavector(self) -> np.ndarray:
        out = np.zeros(self.domain.size())
        out[self.cells] = self.numbers
        return out

    def dense(self) -> Factor:
        return Factor(self.domain, self.datavector())

    @property
    def values(self) -> np.ndarray:
        return self.dense().values

    def l1(self, expected: Callable[[np.ndarray], np.ndarray], mass: float) -> float:
        """L1 distance to a table of ``mass`` in all that ``expected`` tells by cell: what lies in the empty cells
        is what the occupied ones leave of the mass."""
        e = expected(self.cells)
        return float(np.abs(self.numbers - e).sum() + max(0.0, mass - e.sum()))


def log_sum_exp(v: np.ndarray, axis=None) -> np.ndarray:
    top = v.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(v - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


class CliqueVector(dict):
    """Factors by clique, with vector arithmetic."""

    @classmethod
    def make(cls, domain: Domain, cliques: Iterable[Clique], how: Callable[[Domain], Factor] = Factor.zeros) -> CliqueVector:
        return cls({c: how(domain.project(c)) for c in cliques})

    @classmethod
    def normal(cls, domain: Domain, cliques: Iterable[Clique], seed: int = 0) -> CliqueVector:
        rng = np.random.default_rng(seed)
        return cls.make(domain, cliques, lambda d: Factor(d, rng.normal(size=d.shape)))

    def combine(self, other: CliqueVector) -> CliqueVector:
        """Add each factor of the other to a clique that holds it."""
        for c, f in other.items():
            home = next((k for k in sorted(self, key=lambda k: self[k].domain.size()) if set(c) <= set(k)), None)
            if home is not None:
                self[home] = (self[home] + f).transpose(self[home].domain.attrs)
        return self

    def _each(self, other, fn) -> CliqueVector:
        return CliqueVector({c: fn(f, other[c] if isinstance(other, dict) else other) for c, f in self.items()})

    def __add__(self, other):
        return self._each(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._each(other, lambda a, b: a - b)

    def __mul__(self, scale: float):
        return self._each(scale, lambda a, b: a * b)

    def exp(self) -> CliqueVector:
        return CliqueVector({c: f.exp() for c, f in self.items()})

    def log(self) -> CliqueVector:
        return CliqueVector({c: f.log() for c, f in self.items()})

    def dot(self, other: CliqueVector) -> float:
        return float(sum((np.where(np.isfinite(f.values), f.values, 0) * other[c].values).sum() for c, f in self.items()))

    def size(self) -> int:
        return sum(f.domain.size() for f in self.values())


def elimination_order(domain: Domain, cliques: Iterable[Clique], attrs: Iterable[str] | None = None) -> list[str]:
    """Greedy: next goes the attribute whose new clique has the fewest cells; ties in domain order."""
    groups = [set(c) for c in cliques]
    left = list(domain.attrs if attrs is None else domain.canonical(attrs))
    order = []
    while left:

        def cost(a: str) -> int:
            return domain.size(set().union({a}, *[g for g in groups if a in g]))

        a = min(left, key=lambda a: (cost(a), domain.attrs.index(a)))
        joined = set().union(*[g for g in groups if a in g]) - {a}
        groups = [g for g in groups if a not in g] + ([joined] if joined else [])
        left.remove(a)
        order.append(a)
    return order


def best_order(domain: Domain, cliques: Iterable[Clique], tries: int = 10, seed: int = 0) -> list[str]:
    """The elimination order of the fewest cells among the greedy one and ``tries`` random ones, in which an attribute
    comes next the likelier the fewer cells its new clique has."""
    cliques = list(cliques)
    rng = np.random.default_rng(seed)

    def draw() -> tuple[int, list[str]]:
        groups, left, order, cells = [set(c) for c in cliques], list(domain.attrs), [], 0
        while left:
            joined = [set().union({a}, *[g for g in groups if a in g]) for a in left]
            costs = np.array([domain.size(j) for j in joined], float)
            k = int(rng.choice(len(left), p=(1 / costs) / (1 / costs).sum()))
            a, own = left.pop(k), joined[k]
            groups = [g for g in groups if a not in g] + [own - {a}]
            order.append(a)
            cells += int(costs[k])
        return cells, order

    def cost(order: list[str]) -> int:
        groups, cells = [set(c) for c in cliques], 0
        for a in order:
            own = set().union({a}, *[g for g in groups if a in g])
            groups = [g for g in groups if a not in g] + [own - {a}]
            cells += domain.size(own)
        return cells

    greedy = elimination_order(domain, cliques)
    return min([(cost(greedy), greedy), *(draw() for _ in range(tries))], key=lambda x: x[0])[1]


class JunctionTree:
    """Maximal cliques of the triangulated graph and a tree of greatest separators over them."""

    def __init__(self, domain: Domain, cliques: Iterable[Clique], order: Sequence[str] | None = None):
        self.domain = domain
        near: dict[str, set[str]] = {a: set() for a in domain}
        for c in cliques:
            for a, b in combinations(c, 2):
                near[a].add(b)
                near[b].add(a)
        self.order = list(order or elimination_order(domain, cliques))
        made: list[frozenset[str]] = []
        for a in self.order:
            made.append(frozenset({a} | near[a]))
            for b, c in combinations(near[a], 2):
                near[b].add(c)
                near[c].add(b)
            for b in near.pop(a):
                near[b].discard(a)
        largest = [c for k, c in enumerate(made) if not any(c < d or (c == d and k > j) for j, d in enumerate(made))]
        self.cliques: list[Clique] = sorted((domain.canonical(c) for c in largest), key=lambda c: [domain.attrs.index(a) for a in c])
        # Kruskal over the sizes of the separators
        root = list(range(len(self.cliques)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        pairs = sorted(((-len(set(a) & set(b)), i, j) for (i, a), (j, b) in combinations(enumerate(self.cliques), 2)))
        self.edges: list[tuple[int, int]] = []
        for _, i, j in pairs:
            if find(i) != find(j):
                root[find(i)] = find(j)
                self.edges.append((i, j))
        self.neighbours: dict[int, list[int]] = {i: [] for i in range(len(self.cliques))}
        for i, j in self.edges:
            self.neighbours[i].append(j)
            self.neighbours[j].append(i)

    def separator(self, i: int, j: int) -> Clique:
        return self.domain.canonical(set(self.cliques[i]) & set(self.cliques[j]))

    def messages(self) -> list[tuple[int, int]]:
        """Order of messages: leaves to root, then back."""
        up, seen, stack = [], {0} if self.cliques else set(), [0] if self.cliques else []
        while stack:
            i = stack.pop()
            for j in self.neighbours[i]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
                    up.append((j, i))
        return [*reversed(up), *((i, j) for j, i in up)]

    def between(self, attrs: Iterable[str]) -> set[int]:
        """The part of the tree that joins cliques which hold the attributes: a leaf goes if its neighbour holds all that is
        asked of it."""
        need = set(attrs)
        part = set(range(len(self.cliques)))
        near = {i: set(self.neighbours[i]) for i in part}
        leaves = [i for i in part if len(near[i]) <= 1]
        while leaves:
            i = leaves.pop()
            if i not in part or len(part) == 1 or len(near[i]) > 1:
                continue
            held = set(self.cliques[next(iter(near[i]))]) if near[i] else set()
            if need & set(self.cliques[i]) <= held:
                part.remove(i)
                for j in near[i]:
                    near[j].discard(i)
                    leaves.append(j)
        return part

    def cells(self) -> int:
        return sum(self.domain.size(c) for c in self.cliques)


def model_mb(domain: Domain, cliques: Iterable[Clique]) -> float:
    """Size of the model that these cliques make, in MB of eight-byte cells."""
    return JunctionTree(domain, list(cliques)).cells() * 8 / 2**20


def clique_mb(domain: Domain, clique: Clique) -> float:
    """Size of one table, in MB of eight-byte cells."""
    return domain.size(clique) * 8 / 2**20


def measured_mb(domain: Domain, cliques: Iterable[Clique]) -> float:
    """Size of the answers of measured cliques."""
    return sum(clique_mb(domain, c) for c in cliques)


def eliminate(factors: Sequence[Factor], order: Iterable[str], log: bool = False) -> Factor:
    """Product (sum of logs) of factors with attributes summed out one after the other."""
    left = list(factors)
    for a in order:
        own = [f for f in left if a in f.domain]
        left = [f for f in left if a not in f.domain]
        if own:
            joined = own[0]
            for f in own[1:]:
                joined = joined + f if log else joined * f
            out = joined.logsumexp([a]) if log else joined.sum([a])
            left.append(out if isinstance(out, Factor) else Factor(Domain((), ()), np.array(out)))
    joined = left[0]
    for f in left[1:]:
        joined = joined + f if log else joined * f
    return joined


class GraphicalModel:
    """Log-potentials over a junction tree, scaled to a total."""

    def __init__(self, domain: Domain, cliques: Iterable[Clique], total: float = 1.0, impossible: Mapping[str, Iterable[int]] | None = None, order: Sequence[str] | None = None):
        self.domain, self.total = domain, float(total)
        self.tree = JunctionTree(domain, [domain.canonical(c) for c in cliques], order)
        self.cliques = self.tree.cliques
        self.impossible = {a: list(v) for a, v in (impossible or {}).items()}
        self.potentials = CliqueVector.make(domain, self.cliques, lambda d: Factor.active(d, self.impossible))
        self.marginals = self.belief_propagation(self.potentials)

    def belief_propagation(self, potentials: CliqueVector, log_z: bool = False):
        """Clique marginals of exp(potentials), scaled to the total, by two passes of messages."""
        belief = [potentials[c].values for c in self.cliques]
        doms = [self.domain.project(c) for c in self.cliques]
        sent: dict[tuple[int, int], np.ndarray] = {}
        for i, j in self.tree.messages():
            sep = self.tree.separator(i, j)
            inner = belief[i]
            if (j, i) in sent:
                back = np.where(np.isneginf(sent[j, i]), 0.0, sent[j, i])
                inner = inner - _spread(back, sep, doms[i])
            out = log_sum_exp(inner, tuple(k for k, a in enumerate(doms[i]) if a not in sep)) if len(sep) < len(doms[i]) else inner
            sent[i, j] = out
            belief[j] = belief[j] + _spread(out, sep, doms[j])
        z = float(log_sum_exp(belief[0])) if belief else 0.0
        if log_z:
            return z
        shift = np.log(self.total) - z
        return CliqueVector({c: Factor(d, np.exp(b + shift)) for c, d, b in zip(self.cliques, doms, belief, strict=True)})

    def project(self, attrs: Iterable[str]) -> Factor:
        """Marginal over any attributes: from a clique that holds them, else by elimination."""
        attrs = (attrs,) if isinstance(attrs, str) else tuple(attrs)
        homes = [c for c in self.cliques if set(attrs) <= set(c)]
        if homes:
            return self.marginals[min(homes, key=self.domain.size)].project(attrs)
        gone = elimination_order(self.domain, self.cliques, self.domain.invert(attrs))
        f = eliminate([self.potentials[c] for c in self.cliques], gone, log=True)
        f = f.expand(self.domain.project(attrs)) if set(f.domain.attrs) != set(attrs) else f.transpose(attrs)
        return Factor(f.domain, np.exp(f.values - log_sum_exp(f.values) + np.log(self.total)))

    def project_many(self, wanted: Iterable[Clique]) -> dict[Clique, Factor]:
        """Marginals of many sets of attributes. One that no clique holds comes from the part of the tree between the
        cliques that do: clique marginals over separator marginals there, the rest of the tree is not touched."""
        return {w: self._between(tuple(w)) for w in wanted}

    def _between(self, attrs: Clique) -> Factor:
        need = set(attrs)
        if any(need <= set(c) for c in self.cliques):
            return self.project(attrs)
        part = self.tree.between(need)
        near = {i: {j for j in self.tree.neighbours[i] if j in part} for i in part}
        factors, seen = [], set()
        with np.errstate(divide="ignore"):
            for i in sorted(part):
                f = self.marginals[self.cliques[i]].log()
                # each separator is divided out once, in the clique that is met second
                for j in near[i] & seen:
                    if sep := self.tree.separator(i, j):
                        shared = self.marginals[self.cliques[i]].project(sep).expand(f.domain).values
                        f = Factor(f.domain, np.where(shared > 0, f.values - np.log(np.where(shared > 0, shared, 1.0)), -np.inf))
                seen.add(i)
                factors.append(f)
        inside = set().union(*(self.cliques[i] for i in part))
        gone = elimination_order(self.domain, [self.cliques[i] for i in part], inside - need)
        out = eliminate(factors, gone, log=True).transpose(attrs)
        return Factor(out.domain, np.exp(out.values - log_sum_exp(out.values) + np.log(self.total)))

    def krondot(self, matrices: Sequence[np.ndarray]) -> np.ndarray:
        """Answers of a Kronecker product of query matrices, one for each attribute."""
        factors = []
        for c in self.cliques:
            factors.append(self.potentials[c].exp())
        for a, m in zip(self.domain.attrs, matrices, strict=True):
            factors.append(Factor(Domain((f"{a}'", a), m.shape), m))
        out = eliminate(factors, self.domain.attrs)
        z = np.exp(self.belief_propagation(self.potentials, log_z=True))
        return out.transpose([f"{a}'" for a in self.domain]).values * self.total / z

    def datavector(self) -> np.ndarray:
        return self.project(self.domain.attrs).datavector()

    def mle(self, marginals: CliqueVector) -> CliqueVector:
        """Potentials of the maximum-likelihood model with these (consistent) clique marginals."""
        out, done = CliqueVector(), set()
        order = [0, *(j for i, j in self.tree.messages()[len(self.cliques) - 1 :])] if self.cliques else []
        for i in order:
            c = self.cliques[i]
            parent = next((j for j in self.tree.neighbours[i] if j in done), None)
            f = marginals[c]
            if parent is not None and (sep := self.tree.separator(i, parent)):
                f = f / marginals[c].project(sep)
            out[c] = f.transpose(c).log()
            done.add(i)
        return out

    def fit(self, counts: Mapping[Clique, Factor]) -> GraphicalModel:
        self.potentials = self.mle(CliqueVector({c: counts[c] for c in self.cliques}))
        self.marginals = self.belief_propagation(self.potentials)
        return self


def _spread(values: np.ndarray, attrs: Clique, domain: Domain) -> np.ndarray:
    return np.reshape(values, [n if a in attrs else 1 for a, n in domain.sizes.items()])
