"""The three strategies that choose which marginals to measure: spanning tree, adaptive, network.

Each asks ``counts`` for true marginals of coded rows (one Spark job a call) and adds noise to what it publishes.
``Noise`` is drawn here, once, on the driver. With ``public`` nothing is noisy and every choice is the best one.

Spanning tree and adaptive rounds count twice: the one-way marginals first, whose noisy answers decide which codes
are worth a cell of their own, and larger marginals after that over the compressed codes.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

from marginalia.contract import Chooser, Chosen
from marginalia.operators.marginals import TableCounts, mutual_information
from marginalia.plans.compression import Compressor
from marginalia.plans.factors import Factor, SparseFactor, model_mb
from marginalia.plans.inference import Measurement, estimate
from marginalia.plans.privacy import Ledger, Noise, exponential_mechanism, mutual_information_sensitivity, rho_of
from marginalia.types import Clique, Domain

Zeros = Mapping[str, Sequence[int]]
#: Deviations that a code's count has to reach to keep a cell of its own.
KEPT_FROM = 3.0
EXACT_SIGMA = 1e-2  # stands for no noise in a measurement


def powerset(items: Sequence[str]) -> list[Clique]:
    """Non-empty subsets, small ones first."""
    return [c for k in range(1, len(items) + 1) for c in combinations(items, k)]


def downward_closure(cliques: Iterable[Clique]) -> list[Clique]:
    """All non-empty subsets of the cliques, by length and then name."""
    return sorted({s for c in cliques for s in powerset(tuple(sorted(c)))}, key=lambda s: (len(s), s))


def workload_scores(workload: Iterable[Clique]) -> dict[Clique, int]:
    """For each subset of a workload clique, how many attributes it shares with the workload's cliques in all."""
    cliques = [tuple(c) for c in workload]
    return {c: sum(len(set(c) & set(w)) for w in cliques) for c in downward_closure(cliques)}


@dataclass
class Strategy(Chooser):
    """What all strategies share. epsilon None is the noise-free mode."""

    epsilon: float | None = 1.0
    delta: float = 1e-5
    iters: int = 1000
    max_model_size: float | None = None
    compress: bool = True
    seed: int | None = None
    ledger: Ledger = field(default_factory=Ledger)

    def __post_init__(self) -> None:
        self.noise = Noise(self.seed)

    def set_random_state(self, seed: int | None) -> None:
        self.seed, self.noise = seed, Noise(seed)

    @property
    def rho(self) -> float:
        return rho_of(self.epsilon, self.delta)

    def measure(self, true: Mapping[Clique, Factor | SparseFactor], cliques: Sequence[Clique], sigma: float | None, weights: Sequence[float] | None = None, of: int | None = None, coded: bool = False) -> list[Measurement]:
        """Noisy answers; weights are normalised to length one and the deviation that is recorded is the true one.

        of: how many equal cliques share ``sigma``, if these are only some of them. coded: the tables are compressed.
        """
        w = np.ones(len(cliques)) if weights is None else np.asarray(weights, float)
        w = w / (math.sqrt(of) if of else np.linalg.norm(w)) if len(w) else w
        out = []
        for c, own in zip(cliques, w, strict=True):
            x = true[c].datavector()
            dev = 0.0 if sigma is None else sigma / own
            out.append(Measurement(c, x + self.noise.gaussian(dev, len(x)) if dev else x.copy(), max(dev, EXACT_SIGMA), coded=coded))
        return out

    def compression(self, domain: Domain, first: Sequence[Measurement], impossible: Zeros | None) -> Compressor:
        """The codes that keep cells of their own: those of enough rows, or (uncompressed) all possible ones."""
        return Compressor.fit(domain, first, impossible, KEPT_FROM if self.compress else None)

    def fits(self, domain: Domain, cliques: Iterable[Clique]) -> bool:
        return self.max_model_size is None or model_mb(domain, list(cliques)) <= self.max_model_size

    def remeasure(self, domain: Domain, counts: TableCounts, cliques: Sequence[Clique], impossible: Zeros | None = None) -> Chosen:
        """All of the budget for cliques that were chosen on public data, the one-way ones first."""
        sigma = None if self.epsilon is None else math.sqrt(1 / (2 * self.rho))
        if sigma:
            self.ledger.spend("measure", rho=self.rho)
        ones = [c for c in cliques if len(c) == 1]
        first = self.measure(counts(ones), ones, sigma, of=len(cliques)) if ones else []
        found = self.compression(domain, first, impossible)
        larger = [c for c in cliques if len(c) > 1]
        second = self.measure(counts.compressed(found)(larger), larger, sigma, of=len(cliques), coded=True) if larger else []
        return Chosen(first + second, found)


@dataclass
class Mst(Strategy):
    """Maximum spanning tree of pairwise error against the model of the one-way marginals."""

    iters: int = 5000

    def select(self, domain: Domain, counts: TableCounts, public: bool = False, impossible: Zeros | None = None) -> Chosen:
        noisy = not public and self.epsilon is not None
        rho = self.rho if noisy else None
        sigma = math.sqrt(3 / (2 * rho)) if noisy else None
        ones = [(a,) for a in domain]
        first = self.measure(counts(ones), ones, sigma)
        found = self.compression(domain, first, impossible)
        small, counts = found.small, counts.compressed(found)
        pairs = [p for p in combinations(small.attrs, 2) if self.fits(small, [*ones, p])]
        weights = self.weights(small, counts, [found.measurement(m) for m in first], pairs)
        chosen = self.tree(small, weights, rho / 3 if noisy else None)
        if noisy:
            self.ledger.spend("spanning tree", rho=rho)
        second = self.measure(counts(chosen), chosen, sigma, coded=True) if chosen else []
        return Chosen(first + second, found)

    def weights(self, domain: Domain, counts: TableCounts, ones: Sequence[Measurement], pairs: Sequence[Clique]) -> dict[Clique, float]:
        """L1 error of the model of the one-way measurements (half of the iterations) on each pair.

        The model has no pairs: its answer is the product of its one-way tables, so the tables of the pairs stay in Spark.
        """
        model = estimate(domain, list(ones), iters=self.iters // 2)
        alone = model.project_many([(a,) for a in domain])
        return counts.pair_errors(pairs, {a: f.datavector() for (a,), f in alone.items()}, model.total)

    def tree(self, domain: Domain, weights: dict[Clique, float], rho: float | None) -> list[Clique]:
        """Grow a spanning forest, each edge drawn by the exponential mechanism from those that join two parts."""
        part = {a: a for a in domain}
        chosen: list[Clique] = []
        eps = math.sqrt(8 * rho / max(1, len(domain) - 1)) if rho is not None else None
        left = dict(weights)
        while left:
            left = {p: w for p, w in left.items() if part[p[0]] != part[p[1]] and self.fits(domain, [*chosen, p])}
            if not left:
                break
            p = exponential_mechanism(left, eps, 1.0, self.noise)
            chosen.append(p)
            old, new = part[p[1]], part[p[0]]
            part = {a: new if g == old else g for a, g in part.items()}
        return chosen


@dataclass
class Aim(Strategy):
    """Adaptive: measure what the model answers worst, round by round, with annealed noise."""

    degree: int = 2
    rounds: int | None = None
    max_cells: int = 10_000
    num_marginals: int | None = None
    workload: Sequence | None = None  # cliques, or (clique, weight) pairs
    max_model_size: float | None = 80.0

    def candidates(self, domain: Domain) -> dict[Clique, float]:
        if self.workload is not None:
            given = [w if isinstance(w[0], (tuple, list)) else (w, 1.0) for w in self.workload]
            work = {domain.canonical(c): float(x) for c, x in given}
        else:
            work = {c: 1.0 for c in combinations(domain.attrs, min(self.degree, len(domain)))}
        work = {c: x for c, x in work.items() if domain.size(c) <= self.max_cells}
        if self.num_marginals is not None and len(work) > self.num_marginals:
            keys = sorted(work, key=lambda c: (-math.log(self.noise.uniform() or 1e-300), c))[: self.num_marginals]
            work = {c: work[c] for c in work if c in keys}
        out: dict[Clique, float] = {}
        for c in downward_closure(work):
            c = domain.canonical(c)
            out[c] = sum(x * len(set(c) & set(w)) for w, x in work.items())
        return out

    def select(self, domain: Domain, counts: TableCounts, public: bool = False, impossible: Zeros | None = None) -> Chosen:
        noisy = not public and self.epsilon is not None
        rounds = self.rounds or 16 * len(domain)
        rho = self.rho if noisy else math.inf
        # with few rounds the one-way marginals, which cost as much as a round each, count as well
        steps = rounds if rounds >= 2 * len(domain) else rounds + len(domain)
        sigma = math.sqrt(steps / (1.8 * rho)) if noisy else None
        eps = math.sqrt(0.8 * rho / steps) if noisy else None
        work = self.candidates(domain)
        ones = [(a,) for a in domain]
        true = counts(ones)
        first = [m for c in ones for m in self.measure(true, [c], sigma)]
        spent = len(ones) * 0.5 / sigma**2 if noisy else 0.0
        found = self.compression(domain, first, impossible)
        small = found.small
        true = counts.compressed(found)(work)  # the rounds below ask for nothing else of the rows
        out = [found.measurement(m) for m in first]
        rest: list[Measurement] = []
        model = estimate(small, out, iters=self.iters)
        for t in range(rounds):
            last = t == rounds - 1
            if noisy and rho - spent < 2 * (0.5 / sigma**2 + eps**2 / 8):
                left = rho - spent
                if left <= 1e-12:
                    break
                sigma, eps, last = math.sqrt(1 / (2 * 0.9 * left)), math.sqrt(8 * 0.1 * left), True
            share = (t + 1) / rounds if not noisy else min(1.0, (spent + 0.5 / sigma**2) / rho)
            have = {frozenset(s) for c in model.cliques for s in powerset(c)}
            size = self.max_model_size
            fitting = {c: w for c, w in work.items() if frozenset(c) in have or size is None or model_mb(small, [*model.cliques, c]) <= max(size * share, model_mb(small, ones))}
            if not fitting:
                break
            bias = math.sqrt(2 / math.pi) * (sigma or 0.0)
            answers = model.project_many(fitting)
            errors = {c: w * (true[c].l1(answers[c].datavector().__getitem__, float(answers[c].values.sum())) - bias * small.size(c)) for c, w in fitting.items()}
            c = exponential_mechanism(errors, eps, max(map(abs, fitting.values())) or 1.0, self.noise)
            if not noisy and errors[c] <= 1e-6:
                break
            rest += self.measure(true, [c], sigma, coded=True)
            spent += 0.5 / sigma**2 + eps**2 / 8 if noisy else 0.0
            model = estimate(small, [*out, *rest], iters=self.iters, warm=model.potentials)
            if last:
                break
            if noisy and float(np.abs(model.project(c).datavector() - answers[c].datavector()).sum()) <= sigma * math.sqrt(2 / math.pi) * small.size(c):
                sigma, eps = sigma / 2, 2 * eps
        if noisy:
            self.ledger.spend("adaptive rounds", rho=spent)
        return Chosen(first + rest, found)


@dataclass
class PrivBayes(Strategy):
    """A Bayesian network: each next attribute with the parents that tell most about it."""

    iters: int = 5000
    degree: int = 2
    max_candidates: int = 20

    def remeasure(self, domain: Domain, counts: TableCounts, cliques: Sequence[Clique], impossible: Zeros | None = None) -> Chosen:
        """All at once: a network has no one-way marginals that would tell the codes to keep before the others."""
        sigma = None if self.epsilon is None else math.sqrt(1 / (2 * self.rho))
        if sigma:
            self.ledger.spend("measure", rho=self.rho)
        measured = self.measure(counts(cliques), cliques, sigma)
        return Chosen(measured, self.compression(domain, measured, impossible))

    def select(self, domain: Domain, counts: TableCounts, public: bool = False, impossible: Zeros | None = None) -> Chosen:
        noisy = not public and self.epsilon is not None
        order = list(domain.attrs)
        root = order[int(self.noise.uniform() * len(order))] if noisy else order[0]
        used, cliques = [root], [(root,)]
        left = [a for a in order if a != root]
        known: dict[Clique, float] = {}
        rows = None
        while left:
            k = max(1, min(len(used), self.degree - 1))
            options = []
            for a in left:
                sets = [domain.canonical((*p, a)) for p in combinations(used, k)]
                fit = [c for c in sets if self.fits(domain, [*cliques, c])] or [min(sets, key=domain.size)]
                if not self.fits(domain, [*cliques, fit[0]]):
                    warnings.warn(f"no parents of {a} fit the model size; the smallest are taken", stacklevel=2)
                if len(fit) > self.max_candidates:
                    fit = sorted(fit, key=lambda c: (self.noise.uniform() if noisy else 0, c))[: self.max_candidates]
                options += [(c, a) for c in fit]
            fresh = [c for c, _ in options if c not in {k2 for k2, _ in known}]
            if fresh:
                true = counts(fresh)
                for c, f in true.items():
                    rows = f.total if rows is None else rows
                    for a in c:
                        known[c, a] = mutual_information(f, a)
            scores = {o: known[o] for o in options}
            if noisy:
                eps = self.epsilon / 2 / max(1, len(domain) - 1)
                c, a = exponential_mechanism(scores, eps, mutual_information_sensitivity(max(2, int(rows or 2))), self.noise)
            else:
                c, a = exponential_mechanism(scores, None)
            cliques.append(c)
            used.append(a)
            left.remove(a)
        cliques = list(dict.fromkeys(cliques))
        rho = rho_of(self.epsilon / 2, self.delta) if noisy else None
        if noisy:
            self.ledger.spend("network", eps=self.epsilon / 2)
            self.ledger.spend("network marginals", rho=rho)
        measured = self.measure(counts(cliques), cliques, math.sqrt(1 / (2 * rho)) if noisy else None)
        return Chosen(measured, self.compression(domain, measured, impossible))


STRATEGIES = {"mst": Mst, "aim": Aim, "priv-bayes": PrivBayes}
