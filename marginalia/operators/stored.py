"""Stored models as tables: marginals over any attributes by joins and grouped sums, where the factors are."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.marginals import factor_divide, factor_product, factor_sum
from marginalia.plans.factors import JunctionTree
from marginalia.types import Clique, Domain


def clique_tables(values: DataFrame, domain: Domain, cliques: Sequence[Clique], kind: str = "marginals") -> dict[Clique, DataFrame]:
    """(attributes, value) of each clique, from rows (kind, number, cell, value) as a model stores them."""
    out = {}
    for k, c in enumerate(cliques):
        columns, left = [], domain.size(c)
        for a in c:
            left //= domain[a]
            columns.append(F.pmod(F.floor(F.col("cell") / F.lit(left)), F.lit(domain[a])).cast("int").alias(a))
        out[c] = values.where((F.col("kind") == kind) & (F.col("number") == k)).select(*columns, "value")
    return out


def table_marginal(tables: Mapping[Clique, DataFrame], tree: JunctionTree, attrs: Iterable[str]) -> DataFrame:
    """The marginal of any attributes from the clique marginals: of the part of the tree that joins the cliques that hold
    them, each clique over the separator to its parent, summed out from the leaves on.

    A step joins a clique with what its children sent on their separators and adds up what is asked for no more, so
    no table is larger than a clique with the asked attributes below it. Attributes of unconnected parts make the
    product of these parts, over the total.
    """
    need = tuple(dict.fromkeys(attrs))
    part = tree.between(need)
    root = min(part)
    parents, order, stack = {root: None}, [], [root]
    while stack:
        i = stack.pop()
        order.append(i)
        for j in tree.neighbours[i]:
            if j in part and j not in parents:
                parents[j] = i
                stack.append(j)
    sent: dict[int, list[DataFrame]] = {i: [] for i in part}
    for i in reversed(order):
        clique, parent = tree.cliques[i], parents[i]
        own = tables[clique]
        separator = tree.separator(i, parent) if parent is not None else ()
        if separator:
            own = factor_divide(own, factor_sum(own, separator))
        elif parent is not None:  # a part of its own: its distribution
            total = factor_sum(own, []).first()["value"]
            own = own.withColumn("value", F.col("value") / F.lit(float(total)))
        for below in sent[i]:
            own = factor_product(own, below)
        keep = [a for a in own.columns if a != "value" and (a in need or a in separator)]
        own = factor_sum(own, keep)
        if parent is None:
            return own.select(*need, "value")
        sent[parent].append(own)
    raise AssertionError("a tree has a root")
