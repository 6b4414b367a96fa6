"""Domain compression: rare codes of an attribute are merged into one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.expressions import lookup, uniform
from marginalia.plans.inference import Measurement
from marginalia.types import Domain


@dataclass
class Compressor:
    """kept: codes by attribute that stay; all others share one last code."""

    domain: Domain
    kept: dict[str, list[int]]
    impossible: dict[str, list[int]]

    @classmethod
    def fit(cls, domain: Domain, measurements: Sequence[Measurement], impossible: Mapping[str, Sequence[int]] | None = None, threshold: float | None = 3.0) -> Compressor:
        """A code is kept if it is possible and its count in the attribute's first measurement (summed over the
        others of the clique) reaches ``threshold`` deviations, all possible ones if none does; None keeps these."""
        impossible = {a: list(v) for a, v in (impossible or {}).items()}
        kept = {}
        for a in domain:
            possible = np.setdiff1d(np.arange(domain[a]), np.asarray(impossible.get(a, ()), np.int64))
            m = min((m for m in measurements if a in m.clique and not m.coded), key=lambda m: len(m.clique), default=None)
            good = possible
            if m is not None and threshold is not None:
                y = m.y.reshape([domain[b] for b in m.clique]).sum(axis=tuple(k for k, b in enumerate(m.clique) if b != a))
                good = possible[y[possible] >= threshold * m.sigma * np.sqrt(len(m.y) / len(y))]
            kept[a] = (good if len(good) else possible).tolist()
        return cls(domain, kept, impossible)

    def merged(self, a: str) -> list[int]:
        """Possible codes that share the last one."""
        own = np.asarray([*self.kept[a], *self.impossible.get(a, ())], np.int64)
        return np.setdiff1d(np.arange(self.domain[a]), own).tolist()

    def codes(self, a: str) -> list[int]:
        """New code of each old one; an impossible old code counts with the merged ones, or the first kept."""
        out = np.full(self.domain[a], len(self.kept[a]) if self.merged(a) else 0)
        out[self.kept[a]] = np.arange(len(self.kept[a]))
        return out.tolist()

    @cached_property
    def small(self) -> Domain:
        return Domain.of({a: len(self.kept[a]) + bool(self.merged(a)) for a in self.domain})

    def measurement(self, m: Measurement) -> Measurement:
        """Sums of merged cells, each divided by the root of how many it holds, so all have the same noise.

        A measurement of compressed codes stays as it is.
        """
        if m.coded:
            return m
        y = m.y.reshape([self.domain[a] for a in m.clique])
        many = np.ones(y.shape)
        for axis, a in enumerate(m.clique):
            at = np.asarray(self.codes(a), np.int64)
            live = np.setdiff1d(np.arange(self.domain[a]), np.asarray(self.impossible.get(a, ()), np.int64))
            folded = []
            for v in (y, many):
                v = np.moveaxis(v, axis, 0)
                out = np.zeros((self.small[a], *v.shape[1:]))
                np.add.at(out, at[live], v[live])
                folded.append(np.moveaxis(out, 0, axis))
            y, many = folded
        q = 1 / np.sqrt(np.maximum(many, 1))
        return Measurement(m.clique, (y * q).ravel(), m.sigma, q.ravel(), coded=True)

    def transform(self, a: str) -> Column:
        """Compressed code of a column: a lookup in a literal array."""
        return lookup(F.col(f"`{a}`"), self.codes(a)).cast("int")

    def reverse(self, a: str, seed: int, row: str = "_row_id") -> Column:
        """Old code: the merged one becomes one of its codes, by a hash of the row."""
        rest = self.merged(a)
        c = F.col(f"`{a}`")
        kept = lookup(c, self.kept[a])
        if not rest:
            return kept.cast("int")
        pick = F.least(F.floor(uniform(seed, f"merged {a}", row) * len(rest)).cast("int"), F.lit(len(rest) - 1))
        return F.when(c < len(self.kept[a]), kept).otherwise(lookup(pick, rest)).cast("int")

