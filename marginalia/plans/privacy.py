"""Privacy core: zero-concentrated accounting, exact discrete noise, selection and the ledger.

Noise is drawn on the driver, once, on collected counts. Nothing here touches Spark.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from fractions import Fraction

import numpy as np


def delta_standard(rho: float, eps: float) -> float:
    """The simple conversion of rho-zCDP to delta."""
    return 1.0 if rho <= 0 and eps < 0 else 0.0 if rho <= 0 else math.exp(-((eps - rho) ** 2) / (4 * rho)) if eps > rho else 1.0


def delta_of(rho: float, eps: float) -> float:
    """Least delta of (eps, delta) for rho-zCDP: the Rényi order that minimises the bound of arXiv:2004.00010."""
    if rho <= 0:
        return 0.0

    def slope(order: float) -> float:
        return (2 * order - 1) * rho - eps + math.log1p(-1 / order)

    low, high = 1.0 + 1e-12, max(2.0, (eps + 1) / (2 * rho) + 2)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) < 0 else (low, mid)
    a = (low + high) / 2
    log_delta = (a - 1) * (a * rho - eps) + a * math.log1p(-1 / a) - math.log(a - 1)
    return min(1.0, math.exp(min(log_delta, 0.0)))


def _bisect(holds, low: float, high: float) -> float:
    """Largest x in [low, high] for which ``holds``, a condition that fails from some point on."""
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def epsilon_of(rho: float, delta: float) -> float:
    if delta >= 1 or rho == 0:
        return 0.0
    most = rho + 2 * math.sqrt(rho * math.log(1 / delta))
    return _bisect(lambda e: delta_of(rho, e) > delta, 0.0, most)


def rho_of(eps: float, delta: float) -> float:
    """Largest rho whose (eps, delta) guarantee holds; at most eps + 1."""
    if not 0 < delta:
        raise ValueError("delta must be over 0")
    return eps + 1 if delta_of(eps + 1, eps) <= delta else _bisect(lambda r: delta_of(r, eps) <= delta, 0.0, eps + 1)


def _rounded_up(x: Fraction) -> Fraction:
    """The next number of 21 significant bits or fewer: never less noise than was accounted for, whatever the scale."""
    shift = 20 - (x.numerator.bit_length() - x.denominator.bit_length())
    unit = Fraction(1, 1 << shift) if shift >= 0 else Fraction(1 << -shift)
    return math.ceil(x / unit) * unit


class Noise:
    """Exact discrete Laplace and Gaussian sampling in rationals (arXiv:2004.00010).

    With no seed it draws from the system's entropy; a seed is for tests only.
    """

    def __init__(self, seed: int | None = None):
        self.rng = random.SystemRandom() if seed is None else random.Random(seed)

    def _coin(self, p: Fraction) -> bool:
        return self.rng.randrange(p.denominator) < p.numerator

    def _exp_coin(self, x: Fraction) -> bool:
        """True with probability exp(-x), x at least 0."""
        while x > 1:
            if not self._exp_coin(Fraction(1)):
                return False
            x -= 1
        k = 1
        while self._coin(x / k):
            k += 1
        return k % 2 == 1

    def laplace_one(self, scale: Fraction) -> int:
        s, t = scale.denominator, scale.numerator
        while True:
            u = self.rng.randrange(t)
            if not self._exp_coin(Fraction(u, t)):
                continue
            v = 0
            while self._exp_coin(Fraction(1)):
                v += 1
            x = (u + t * v) // s
            negative = self.rng.randrange(2)
            if not (negative and x == 0):
                return -x if negative else x

    def gaussian_one(self, sigma2: Fraction) -> int:
        t = math.isqrt(int(sigma2)) + 1
        while True:
            y = self.laplace_one(Fraction(t))
            if self._exp_coin((abs(y) - sigma2 / t) ** 2 / (2 * sigma2)):
                return y

    def gaussian(self, sigma: float, size: int) -> np.ndarray:
        """Integer noise of deviation sigma."""
        if sigma <= 0:
            return np.zeros(size)
        s2 = _rounded_up(Fraction(sigma) ** 2)
        return np.array([self.gaussian_one(s2) for _ in range(size)], float)

    def laplace(self, scale: float, size: int) -> np.ndarray:
        if scale <= 0:
            return np.zeros(size)
        s = _rounded_up(Fraction(scale))
        return np.array([self.laplace_one(s) for _ in range(size)], float)

    def uniform(self) -> float:
        return self.rng.random()


def exponential_mechanism(qualities: Mapping | Sequence[float], eps: float | None, sensitivity: float = 1.0, noise: Noise | None = None, monotonic: bool = False, base: Sequence[float] | None = None):
    """Draws a key (or index) with probability proportional to exp(coef * eps * quality / sensitivity);
    the first maximum if eps is None (the noise-free mode)."""
    keys = list(qualities) if isinstance(qualities, Mapping) else list(range(len(qualities)))
    q = np.array(list(qualities.values()) if isinstance(qualities, Mapping) else list(qualities), float)
    if eps is None:
        return keys[int(q.argmax())]
    logits = (1.0 if monotonic else 0.5) * eps / sensitivity * (q - q.max())
    if base is not None:
        logits = logits + np.asarray(base, float)
    p = np.exp(logits - logits.max())
    u = (noise or Noise()).uniform() * p.sum()
    return keys[int(min(np.searchsorted(np.cumsum(p), u, side="right"), len(keys) - 1))]


def mutual_information_sensitivity(n: int) -> float:
    """Of mutual information on n rows."""
    return 2 / n * math.log((n + 1) / 2) + (1 - 1 / n) * math.log(1 + 2 / (n - 1)) if n > 1 else 1.0


class Ledger:
    """What has been spent: pure eps of processing and rho of models."""

    def __init__(self) -> None:
        self.entries: list[tuple[str, float, float]] = []

    def spend(self, what: str, eps: float = 0.0, rho: float = 0.0) -> None:
        self.entries.append((what, eps, rho))

    @property
    def epsilon(self) -> float:
        return sum(e for _, e, _ in self.entries)

    @property
    def rho(self) -> float:
        return sum(r for _, _, r in self.entries)

    def total(self, delta: float) -> float:
        """Epsilon of everything at delta, by basic composition."""
        return self.epsilon + (epsilon_of(self.rho, delta) if self.rho else 0.0)
