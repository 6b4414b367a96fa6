"""End to end: discretise, choose and measure marginals, infer a model, generate rows."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.contract import Synthesizer
from marginalia.operators.binning import TableBinner
from marginalia.operators.cut import cut
from marginalia.operators.generate import generate
from marginalia.operators.marginals import CELLS_FIRST, TableCounts, check_codes, check_types, occupied, redraw
from marginalia.plans.compression import Compressor
from marginalia.plans.factors import GraphicalModel
from marginalia.plans.inference import Measurement, estimate
from marginalia.plans.select import STRATEGIES, Strategy
from marginalia.sources.tables import exists, read_text, write_text
from marginalia.types import Domain


class GraphicalGenerator(Synthesizer):
    """A strategy and the model that it leads to, over coded rows. States: None, "pretrained", "trained"."""

    def __init__(self, strategy: str | Strategy = "mst", **params):
        self.strategy = STRATEGIES[strategy](**params) if isinstance(strategy, str) else strategy
        self.domain: Domain | None = None
        self.impossible: dict[str, list[int]] = {}
        self.measurements: list[Measurement] = []
        self.compressor: Compressor | None = None
        self.model: GraphicalModel | None = None
        self.state: str | None = None
        self.public = False  # whether the measurements are a public table's

    def set_random_state(self, seed: int | None) -> GraphicalGenerator:
        """The seed of all noise from here on; None: the system's entropy."""
        self.strategy.set_random_state(seed)
        return self

    def set_params(self, **params) -> GraphicalGenerator:
        """Parameters of the strategy by name; a name that it does not have is an error."""
        for name, value in params.items():
            if name in ("ledger", "noise") or not hasattr(self.strategy, name):
                raise ValueError(f"the strategy has no parameter {name}")
            setattr(self.strategy, name, value)
        return self

    def set_domain(self, domain: Domain | Mapping[str, int]) -> GraphicalGenerator:
        self.domain = domain if isinstance(domain, Domain) else Domain.of(domain)
        return self

    def set_structural_zeros(self, zeros: Mapping[str, list[int]]) -> GraphicalGenerator:
        self.impossible = {a: list(v) for a, v in zeros.items()}
        return self

    def fit(self, df: DataFrame, public: bool = False, marginals_only: bool = False, weight: str | None = None) -> GraphicalGenerator:
        """Select and measure, then infer unless marginals_only.

        public: what is chosen comes from a public table, without noise or budget. Such a fit ends "pretrained"
        and generates nothing; the next private fit measures the same cliques with all of the budget. A private
        fit after marginals_only infers from what was measured and paid for then. A trained model that is
        fitted again measures its cliques again and pays again.
        """
        if self.domain is None:
            raise ValueError("Domain must be provided")
        check_types(df, self.domain)
        few = 0 < len(self.domain) and self.domain.size() <= CELLS_FIRST
        drawn = any(self.impossible.values())
        if drawn or not few:
            check_codes(df, self.domain)
        rows = redraw(df, self.impossible, self.domain, self.strategy.seed)
        if few:  # the rows are read once, and the cells as often as the strategy asks
            rows, weight = occupied(rows, self.domain, weight)
            rows = rows.persist()
        try:
            if few and not drawn:
                check_codes(rows, self.domain)
            counts, chosen = TableCounts(rows, self.domain, weight), None
            if public or self.state is None:
                chosen, self.public = self.strategy.select(self.domain, counts, public, self.impossible), public
            elif self.public or self.state == "trained":
                cliques = list(dict.fromkeys(m.clique for m in self.measurements))
                chosen, self.public = self.strategy.remeasure(self.domain, counts, cliques, self.impossible), False
        finally:
            if few:
                rows.unpersist()
        if chosen:
            self.measurements, self.compressor = chosen.measurements, chosen.compressor
        self.state, self.model = "pretrained", None
        if not public and not marginals_only:
            self.infer()
        return self

    def infer(self, engine: str = "MD", callback=None) -> GraphicalGenerator:
        """Fit the model to the measurements, over compressed codes."""
        small = [self.compressor.measurement(m) for m in self.measurements]
        self.model = estimate(self.compressor.small, small, iters=self.strategy.iters, engine=engine, callback=callback)
        self.state = "trained"
        return self

    def generate(self, spark: SparkSession, n_records: int | None = None, condition: DataFrame | None = None, seed: int = 0, method: str = "round") -> DataFrame:
        """(_row_id and a code for each attribute). condition: coded columns, with _row_id."""
        if self.state != "trained":
            raise ValueError("the model is not trained")
        if condition is None and n_records is None:
            raise ValueError("give n_records or condition records")
        c = self.compressor
        if condition is None:
            rows, given = spark.range(n_records).withColumnRenamed("id", "_row_id"), []
        else:
            given = [a for a in self.domain if a in condition.columns]
            rows = condition.select("_row_id", *[c.transform(a).alias(a) for a in given])
        made = generate(self.model, rows, seed, method, numbered=n_records if condition is None else None)
        out = made.select("_row_id", *[c.reverse(a, seed).alias(a) for a in self.domain if a not in given])
        if condition is not None:
            out = out.join(condition.select("_row_id", *[F.col(f"`{a}`") for a in given]), "_row_id")
        return out.select("_row_id", *[F.col(f"`{a}`") for a in self.domain])

    def to_json(self, values: bool = True) -> str:
        """All that was learned; without ``values`` all but what ``values`` has."""
        s = self.strategy
        kind = next(k for k, t in STRATEGIES.items() if t is type(s))
        params = {k: v for k, v in vars(s).items() if k not in ("ledger", "noise")}
        listed = lambda x: [None if np.isneginf(v) else float(v) for v in x] if values else None
        return json.dumps({
            "strategy": kind, "params": params, "ledger": s.ledger.entries, "state": self.state, "public": self.public, "domain": self.domain.sizes if self.domain else None, "impossible": self.impossible,
            "measurements": [{"clique": m.clique, "y": listed(m.y), "sigma": m.sigma, "coded": m.coded} for m in self.measurements],
            "potentials": [{"clique": c, "values": listed(f.datavector())} for c, f in self.model.potentials.items()] if self.model else None,
            "kept": self.compressor.kept if self.compressor else None, "total": self.model.total if self.model else None, "order": self.model.tree.order if self.model else None,
        })

    def values(self) -> pa.Table:
        """(kind, number, cell, value): the answers of the measurements and, of a trained model, the potentials and
        marginals of its cliques."""
        parts = [("measurement", k, m.y) for k, m in enumerate(self.measurements)]
        for kind in ("potentials", "marginals") if self.model else ():
            parts += [(kind, k, f.datavector()) for k, f in enumerate(getattr(self.model, kind).values())]
        columns = [np.repeat([p[0] for p in parts], [len(p[2]) for p in parts]), np.repeat([p[1] for p in parts], [len(p[2]) for p in parts]), np.concatenate([np.arange(len(p[2])) for p in parts]), np.concatenate([p[2] for p in parts])] if parts else [np.zeros(0, str), np.zeros(0), np.zeros(0), np.zeros(0)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["kind", "number", "cell", "value"])

    @classmethod
    def from_json(cls, text: str, values: pa.Table | None = None) -> GraphicalGenerator:
        d = json.loads(text)
        out = cls(d["strategy"], **d["params"])
        for what, eps, rho in d["ledger"]:
            out.strategy.ledger.spend(what, eps, rho)
        out.state, out.public, out.impossible = d["state"], d.get("public", False), d["impossible"]
        known = _by_table(values) if values is not None else {}
        back = lambda kind, k, given: known[kind, k] if values is not None else np.array([-np.inf if x is None else x for x in given])
        if d["domain"]:
            out.set_domain(d["domain"])
        out.measurements = [Measurement(tuple(m["clique"]), back("measurement", k, m["y"]), m["sigma"], coded=m["coded"]) for k, m in enumerate(d["measurements"])]
        if d["kept"]:
            out.compressor = Compressor(out.domain, d["kept"], out.impossible)
        if d["potentials"]:
            out.model = GraphicalModel(out.compressor.small, [tuple(p["clique"]) for p in d["potentials"]], d["total"], order=d["order"])
            for k, p in enumerate(d["potentials"]):
                f = out.model.potentials[tuple(p["clique"])]
                f.values = back("potentials", k, p["values"]).reshape(f.domain.shape)
            out.model.marginals = out.model.belief_propagation(out.model.potentials)
        return out

    def store(self, spark: SparkSession, path: str) -> None:
        """model.json says what there is; its numbers are the rows of values.parquet."""
        write_text(spark, f"{path}/model.json", self.to_json(values=False))
        spark.createDataFrame(self.values()).write.mode("overwrite").parquet(f"{path}/values.parquet")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphicalGenerator:
        values = spark.read.parquet(f"{path}/values.parquet").where("kind <> 'marginals'").toArrow() if exists(spark, f"{path}/values.parquet") else None
        return cls.from_json(read_text(spark, f"{path}/model.json"), values)


def _by_table(values: pa.Table) -> dict[tuple[str, int], np.ndarray]:
    """The values of each (kind, number), by cell."""
    kind, number, cell, value = (values.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "number", "cell", "value"))
    order = np.lexsort((cell, number, kind))
    kind, number, value = kind[order], number[order], value[order]
    cuts = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (number[1:] != number[:-1]), [True]))) if len(kind) else [0]
    return {(kind[s], int(number[s])): value[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)}


class Pipeline(Synthesizer):
    """Fit on any DataFrame of mixed types and generate DataFrames of the same schema.

    epsilon and delta pay for the model, proc_epsilon for the discretisation; None is noise-free.
    """

    def __init__(self, strategy: str = "mst", epsilon: float | None = 1.0, delta: float = 1e-5, proc_epsilon: float | None = None, n_bins: int | str = "auto", binner: str | None = None, disable_processing: bool = False, seed: int | None = None, **params):
        self.binner = None if disable_processing else TableBinner(binner or ("priv-tree" if proc_epsilon else "uniform"), n_bins, proc_epsilon, seed=seed)
        self.generator = GraphicalGenerator(strategy, epsilon=epsilon, delta=delta, seed=seed, **params)

    def fit(self, df: DataFrame, domain: Mapping | None = None, structural_zeros: Mapping | None = None, public: bool = False, marginals_only: bool = False) -> Pipeline:
        g = self.generator
        if self.binner is None:
            if domain is not None:
                g.set_domain({a: n if isinstance(n, int) else len(n["categories"]) if "categories" in n else int(n["upper"]) + 1 for a, n in domain.items()})
            g.set_structural_zeros(structural_zeros or {}).fit(df, public, marginals_only)
            return self
        if g.state is None:
            self.binner.domain, self.binner.zeros = domain or self.binner.domain, structural_zeros or self.binner.zeros
            self.binner.fit(df, public)
            g.set_domain(self.binner.codes).set_structural_zeros(self.binner.impossible())
        coded = self.binner.transform(df).persist()
        try:
            g.fit(coded, public, marginals_only)
        finally:
            coded.unpersist()
        return self

    def set_random_state(self, seed: int | None) -> Pipeline:
        """One seed for the discretisation and the model."""
        if self.binner is not None:
            self.binner.set_random_state(seed)
        self.generator.set_random_state(seed)
        return self

    @property
    def spent_epsilon(self) -> float:
        """All that was spent at the strategy's delta, by basic composition."""
        return (self.binner.spent if self.binner else 0.0) + self.generator.strategy.ledger.total(self.generator.strategy.delta)

    def generate(self, spark: SparkSession, n_records: int | None = None, condition_records: DataFrame | None = None, seed: int = 0, method: str = "round") -> DataFrame:
        """A new table. Condition columns come back unchanged, one row for each condition record.

        method: "round" gives every code its exact share of rows (without a shuffle, but for groups that hold condition columns), "sample" draws
        each row by itself (no shuffle).
        """
        if condition_records is None:
            coded = self.generator.generate(spark, n_records, None, seed, method)
            return coded.drop("_row_id") if self.binner is None else self.binner.inverse(coded, seed=seed).drop("_row_id")
        given = condition_records.columns
        # written once: two joins below ask for the ids, which another reading of the source may give to other rows
        keyed = cut(condition_records.withColumn("_row_id", F.monotonically_increasing_id()))
        codes = keyed if self.binner is None else self.binner.transform(keyed, keep=("_row_id",))
        coded = self.generator.generate(spark, None, codes, seed, method)
        out = coded if self.binner is None else self.binner.inverse(coded, seed=seed)
        names = [c for c in out.columns if c != "_row_id"]
        joined = out.drop(*given).join(keyed, "_row_id")
        return joined.select(*[F.col(f"`{c}`") for c in [*names, *(c for c in given if c not in names)]])

    def store(self, spark: SparkSession, path: str) -> None:
        """Edges and categories as JSON, measurements, potentials and marginals as Parquet; never rows."""
        self.generator.store(spark, path)
        if self.binner is not None:
            write_text(spark, f"{path}/binner.json", self.binner.to_json())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Pipeline:
        out = cls()
        out.generator = GraphicalGenerator.load(spark, path)
        out.binner = TableBinner.from_json(read_text(spark, f"{path}/binner.json")) if exists(spark, f"{path}/binner.json") else None
        return out


#: A pipeline for each strategy, with the strategy's own defaults.
PIPELINES = {name: partial(Pipeline, name) for name in STRATEGIES}
