"""Estimate a graphical model from noisy marginals: mirror descent, dual averaging, interior gradient."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np

from marginalia.plans.dual import Dual
from marginalia.plans.factors import CliqueVector, Factor, GraphicalModel, best_order
from marginalia.types import Clique, Domain


@dataclass
class Measurement:
    """A noisy marginal: y = q * (true cells) + noise of deviation sigma; q is the diagonal of the query. coded: whether
    its cells are those of compressed codes."""

    clique: Clique
    y: np.ndarray
    sigma: float
    q: np.ndarray | None = None
    coded: bool = False

    def diagonal(self) -> np.ndarray:
        return np.ones(len(self.y)) if self.q is None else self.q

    def checked(self, domain: Domain) -> Measurement:
        clique = (self.clique,) if isinstance(self.clique, str) else tuple(self.clique)
        y = np.asarray(self.y, float).ravel()
        if not self.sigma > 0:
            raise ValueError(f"sigma of {clique} must be over 0")
        if len(y) != domain.size(clique) or (self.q is not None and len(self.q) != len(y)):
            raise ValueError(f"{clique} has {domain.size(clique)} cells and {len(y)} answers")
        return Measurement(clique, y, float(self.sigma), self.q, self.coded)


def estimate_total(measurements: Sequence[Measurement]) -> float:
    """Inverse-variance mean of the measurements' own totals, 1 at least."""
    weights, totals = [], []
    for m in measurements:
        q = m.diagonal()
        if (q > 0).all():
            weights.append(1 / (m.sigma**2 * float((1 / q**2).sum())))
            totals.append(float((m.y / q).sum()))
    return max(1.0, float(np.average(totals, weights=weights))) if totals else 1.0


#: A descent has come to rest when so many steps in a row leave the loss where doubles can't tell it from before.
STILL, DIGITS = 10, 1e-13


def estimate(domain: Domain, measurements: Iterable[Measurement], iters: int = 1000, total: float | None = None, engine: str = "MD", metric: str | Callable = "L2", impossible: Mapping[str, Iterable[int]] | None = None, warm: CliqueVector | None = None, callback: Callable | None = None, cliques: Sequence[Clique] = (), step: float | Callable[[int], float] | None = None) -> GraphicalModel:
    """Model whose marginals are nearest to the measurements. engine: MD, RDA or IG. step: of MD, a number or a schedule
    by iteration; None searches for it."""
    ms = [m.checked(domain) for m in measurements]
    total = estimate_total(ms) if total is None else total
    wanted = [m.clique for m in ms] + list(cliques)
    model = GraphicalModel(domain, wanted, total, impossible, order=best_order(domain, wanted))
    if warm:
        model.potentials.combine(warm)
    dual = Dual(model, ms, metric)
    watch = (lambda mu: callback(dual.vector(mu))) if callback else (lambda mu: None)
    if engine == "MD" and step is not None:
        t, mu = _given_steps(dual, iters, step if callable(step) else lambda _: step, watch)
    elif engine == "MD":
        t, mu = _mirror_descent(dual, iters, watch)
    else:
        mu = {"RDA": _dual_averaging, "IG": _interior_gradient}[engine](dual, iters, watch)
        model.potentials = model.mle(dual.vector(mu))
        model.marginals = model.belief_propagation(model.potentials)
        return model
    model.potentials, model.marginals = dual.vector(dual.potentials(t)), dual.vector(mu)
    return model


def _given_steps(dual: Dual, iters: int, step: Callable[[int], float], watch: Callable) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mirror descent with given steps; an iteration is one belief propagation."""
    t = np.zeros(dual.size)
    mu = dual.marginals(t)
    for k in range(iters):
        t = t - step(k) * dual.loss(dual.read(mu))[1]
        mu = dual.marginals(t)
        watch(mu)
    return t, mu


def _mirror_descent(dual: Dual, iters: int, watch: Callable) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mirror descent; a step is halved until it gains half of what its slope promises, and tried longer every few steps.

    It ends after ``iters`` iterations, or where no step gains anything that doubles can tell.
    """
    t = np.zeros(dual.size)
    mu = dual.marginals(t)
    p = dual.read(mu)
    loss, grad = dual.loss(p)
    step, still, eased = 2.0 / dual.model.total**2, 0, 0
    for _ in range(iters):
        if loss <= dual.least + 1e-12 or still == STILL:
            break
        for _ in range(40):
            trial = t - step * grad
            mu2 = dual.marginals(trial)
            p2 = dual.read(mu2)
            loss2, grad2 = dual.loss(p2)
            if np.isfinite(loss2) and loss - loss2 >= 0.5 * step * float(grad @ (p - p2)):
                break
            step, eased = step / 2, 0
        else:
            break
        still = still + 1 if loss - loss2 <= DIGITS * loss else 0
        t, mu, p, loss, grad = trial, mu2, p2, loss2, grad2
        watch(mu)
        eased += 1
        if eased % 4 == 0 or eased == 1 and step < 1e-3 / dual.model.total**2:
            step *= 2
    return t, mu


def _dual_averaging(dual: Dual, iters: int, watch: Callable) -> list[np.ndarray]:
    """Dual averaging (Xiao, "Dual averaging methods for regularized stochastic learning", 2010) with growing weights.

    All gradients so far, the k-th with weight k, decide the next proposal from the start; gradients are taken at the
    weighted mean of the proposals. Proposals are tied to the start by how much the loss has bent between two of
    them, so the tie only ever gets closer. It ends where the mean has come to rest.
    """
    tie = dual.bend() / 32
    proposal = mean = dual.marginals(np.zeros(dual.size))
    at_proposal = at = dual.read(mean)
    sums, weight, last, still = np.zeros(dual.size), 0.0, np.inf, 0
    for k in range(1, iters + 1):
        share = k / (weight + k)
        _, gradient = dual.loss(at + share * (at_proposal - at))
        sums += k * gradient
        weight += k
        while True:
            new = dual.marginals(-sums / tie)
            at_new = dual.read(new)
            far = max(float(np.abs(x - y).sum()) for x, y in zip(new, proposal, strict=True))
            if 2 * dual.bent(at_new - at_proposal) <= tie * far**2 / dual.model.total * (1 + 1e-9) or tie > 1e30:
                break
            tie *= 2
        proposal, at_proposal = new, at_new
        mean = [m + share * (x - m) for m, x in zip(mean, proposal, strict=True)]
        at = at + share * (at_proposal - at)
        watch(mean)
        loss = dual.loss(at)[0]
        still = still + 1 if abs(last - loss) <= DIGITS * abs(loss) else 0
        if still == 10 * STILL:
            break
        last = loss
    return mean


def _interior_gradient(dual: Dual, iters: int, watch: Callable) -> list[np.ndarray]:
    """Interior gradient with momentum (Auslender & Teboulle, "Interior gradient and proximal methods for convex and conic
    optimization", 2006): the point that moves is multiplied, never subtracted from.

    A step's length comes from how much the loss bends over the step before it, against how far the tables moved
    (Pinsker's bound of their divergence); it is doubled in turn while steps are too long. It ends with the loss at rest.
    """
    bend, share, held = dual.bend() / 64, 1.0, np.zeros(dual.size)
    moving = mean = dual.marginals(held)
    at_moving = at = dual.read(mean)
    last, still = np.inf, 0
    for _ in range(iters):
        _, gradient = dual.loss(at + share * (at_moving - at))
        while True:
            trial = held - gradient / (share * bend)
            new = dual.marginals(trial)
            at_new = dual.read(new)
            far = max(float(np.abs(x - y).sum()) for x, y in zip(new, moving, strict=True))
            if dual.bent(at_new - at_moving) <= bend * far**2 / dual.model.total * (1 + 1e-9) or bend > 1e30:
                break
            bend *= 2
        held, moving, at_moving = trial, new, at_new
        mean = [m + share * (x - m) for m, x in zip(mean, moving, strict=True)]
        at = at + share * (at_moving - at)
        watch(mean)
        loss = dual.loss(at)[0]
        still = still + 1 if abs(last - loss) <= DIGITS * abs(loss) else 0
        if still == 10 * STILL:
            break
        last, share = loss, share * (np.sqrt(share * share + 4) - share) / 2
    return mean


def distances(marginals: CliqueVector, measurements: Iterable[Measurement]) -> tuple[float, float]:
    """L1 and half the squared L2 distance of the measurements to the marginals, in their deviations."""
    far = [(m.diagonal() * min((f for c, f in marginals.items() if set(m.clique) <= set(c)), key=lambda f: f.domain.size()).project(m.clique).datavector() - m.y) / m.sigma for m in measurements]
    return float(sum(np.abs(x).sum() for x in far)), float(sum(0.5 * (x @ x) for x in far))


class Progress:
    """Callback that keeps a row for each call: iteration, L1, L2, greatest disagreement of shared marginals, seconds
    since it was made and, given ``true`` counts, the mean variation distance of the model to them."""

    def __init__(self, homes: Mapping[Clique, list[Measurement]], every: int = 1, true: Mapping[Clique, Factor] | None = None):
        self.homes, self.every, self.true, self.rows, self.n = homes, every, true or {}, [], 0
        self.start = time.perf_counter()

    def __call__(self, mu: CliqueVector) -> None:
        if self.n % self.every == 0:
            gap = 0.0
            for a, f in mu.items():
                for b, g in mu.items():
                    if a < b and (shared := tuple(x for x in a if x in b)):
                        gap = max(gap, float(np.abs(f.project(shared).values - g.project(shared).values).max()))
            far = [self._distance(mu, c, f) for c, f in self.true.items()]
            far = [x for x in far if x is not None]
            self.rows.append((self.n, *distances(mu, [m for ms in self.homes.values() for m in ms]), gap, time.perf_counter() - self.start, float(np.mean(far)) if far else None))
        self.n += 1

    @staticmethod
    def _distance(mu: CliqueVector, clique: Clique, true: Factor) -> float | None:
        """Half the L1 distance of the two distributions; None where no clique of the model holds the attributes."""
        home = next((f for c, f in mu.items() if set(clique) <= set(c)), None)
        if home is None:
            return None
        p, q = home.project(clique).values, true.transpose(clique).values
        return float(np.abs(p / max(p.sum(), 1e-300) - q / max(q.sum(), 1e-300)).sum() / 2)
