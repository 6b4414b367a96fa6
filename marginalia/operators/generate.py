"""Rows from a graphical model: one column after the other, each given the columns it depends on."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.expressions import count_at_or_below, uniform
from marginalia.operators.cut import cut
from marginalia.plans.factors import GraphicalModel
from marginalia.types import Clique

#: Cells of a conditional table up to which it is broadcast (8 bytes a cell).
BROADCAST_CELLS = 4_000_000
#: Rows of a group, or of a cell of a table that is not broadcast, that one task takes; larger ones are cut.
ROWS_A_PART = 250_000
#: Columns after which the plan of the rows is cut.
COLUMNS_A_PLAN = 8


def plan(model: GraphicalModel, given: tuple[str, ...] = ()) -> list[tuple[str, Clique]]:
    """(attribute, what it is drawn from) in reverse elimination order; conditions are in domain order."""
    used, out = list(given), []
    for a in reversed(model.tree.order):
        if a in used:
            continue
        near = set().union(*[c for c in model.cliques if a in c])
        out.append((a, model.domain.canonical(near & set(used))))
        used.append(a)
    return out


def conditional(model: GraphicalModel, a: str, on: Clique) -> np.ndarray:
    """Rows: cells of ``on`` in order; columns: probabilities of a. A cell without mass takes the one-way marginal."""
    alone = model.project((a,)).datavector()
    alone = alone / alone.sum()
    if not on:
        return alone[None, :]
    table = model.project((*on, a)).values.reshape(-1, model.domain[a])
    mass = table.sum(axis=1, keepdims=True)
    return np.where(mass > 1e-12 * max(model.total, 1e-300), table / np.maximum(mass, 1e-300), alone[None, :])


def generate(model: GraphicalModel, rows: DataFrame, seed: int = 0, method: str = "sample", row: str = "_row_id", numbered: int | None = None) -> DataFrame:
    """``rows`` (the row id and any given columns) with a code for every other attribute of the model.

    "sample" draws each code by itself: a lookup and no shuffle. "round" gives each code its exact share
    of the rows of a group, leftovers by weight, and deals them by a hash. numbered: so many rows have the ids
    from 0 on, and need not be ranked.
    """
    given = tuple(c for c in rows.columns if c in model.domain)
    steps = plan(model, given)
    if method != "sample":
        return _round(rows, model, steps, seed, row, numbered)
    out = rows
    for a, on in steps:
        out = _sample(out, conditional(model, a, on), model, a, on, seed, row)
    return out


def _cell(model: GraphicalModel, on: Clique):
    cell = F.lit(0).cast("long")
    for b in on:
        cell = cell * F.lit(model.domain[b]) + F.col(f"`{b}`")
    return cell


def _codes(model: GraphicalModel, on: Clique) -> dict:
    """The codes that the number of a cell stands for."""
    return {b: F.expr(f"_cell div {model.domain.size(on[k + 1 :])}") % model.domain[b] for k, b in enumerate(on)}


def _frame(df: DataFrame, table: np.ndarray) -> DataFrame:
    """(_cell, _p): the rows of a table, as they lie in memory."""
    n, width = table.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int64) * width, pa.int64()).cast(pa.int32()), pa.array(np.ascontiguousarray(table).ravel()))
    return df.sparkSession.createDataFrame(pa.table([pa.array(np.arange(n)), lists], ["_cell", "_p"]))


def parted(df: DataFrame, key: str, counts: DataFrame, seed: int, salt: str, row: str) -> DataFrame:
    """df with _part: rows of a key with over ROWS_A_PART rows are dealt evenly into as many parts as that makes.

    counts: (key, m). The keys that are cut are at most one for ROWS_A_PART rows; they are broadcast.
    """
    large = F.broadcast(counts.where(F.col("m") > ROWS_A_PART).select(key, F.ceil(F.col("m") / ROWS_A_PART).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64(F.lit(seed), F.lit(f"part {salt}"), F.col(row)), F.coalesce("_parts", F.lit(1)))
    return df.join(large, key, "left").withColumn("_part", part).drop("_parts")


def looked_up(df: DataFrame, table: np.ndarray, seed: int, salt: str, row: str) -> DataFrame:
    """df (with _cell) with _p, the row of the table for its cell.

    A table of up to BROADCAST_CELLS cells is broadcast. Beyond that the rows are counted by cell, a cell's row of the
    table is repeated for every ROWS_A_PART rows that ask for it, and each asks in its own part, so that no key of
    the join has more rows than these.
    """
    frame = _frame(df, table)
    if table.size <= BROADCAST_CELLS:
        return df.join(F.broadcast(frame), "_cell", "left")
    counts = df.groupBy("_cell").agg(F.count(F.lit(1)).alias("m"))
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / ROWS_A_PART).cast("int") - 1))
    frame = frame.join(counts, "_cell").select("_cell", parts.alias("_part"), "_p")
    return parted(df, "_cell", counts, seed, f"lookup {salt}", row).join(frame, ["_cell", "_part"], "left").drop("_part")


def _sample(df: DataFrame, table: np.ndarray, model: GraphicalModel, a: str, on: Clique, seed: int, row: str) -> DataFrame:
    steps = np.cumsum(table, axis=1)[:, :-1]
    u = uniform(seed, a, row)
    last = model.domain[a] - 1
    if not on:
        return df.withColumn(a, F.least(count_at_or_below(u, [float(x) for x in steps[0]]), F.lit(last)).cast("int"))
    joined = looked_up(df.withColumn("_cell", _cell(model, on)), steps, seed, a, row)
    return joined.withColumn(a, F.least(F.size(F.filter("_p", lambda x: x <= u)), F.lit(last)).cast("int")).drop("_cell", "_p")


def quotas(groups: DataFrame, table: DataFrame, seed: int, salt: str) -> DataFrame:
    """(_cell, code, lo, hi): each code's range of ranks in a group of m rows: floors of m * p, and the rest of
    the rows one each to the codes with the least -ln(u) / fraction."""
    each = groups.join(table, "_cell").select("_cell", "m", F.posexplode("_p").alias("code", "p"))
    want = F.col("m") * F.col("p")
    each = each.withColumn("whole", F.floor(want + 1e-9)).withColumn("part", F.greatest(want - F.col("whole"), F.lit(0.0)))
    group = W.partitionBy("_cell")
    key = -F.ln(F.greatest(uniform(seed, salt, F.xxhash64("_cell", "code")), F.lit(1e-300))) / F.greatest(F.col("part"), F.lit(1e-12))
    each = each.withColumn("rest", F.col("m") - F.sum("whole").over(group)).withColumn("rank", F.row_number().over(group.orderBy(key, "code")))
    each = each.withColumn("n", F.col("whole") + (F.col("rank") <= F.col("rest")).cast("long"))
    upto = F.sum("n").over(group.orderBy("code").rowsBetween(W.unboundedPreceding, W.currentRow))
    return each.select("_cell", "code", (upto - F.col("n")).alias("lo"), upto.alias("hi")).where("hi > lo")


def sources(steps: Sequence[tuple[str, Clique]]) -> dict[Clique, str | None]:
    """For each set of columns that something is drawn from: the last of them that is drawn itself, if the others are
    all among what that one is drawn from. Each of its cells then lies in one group, and so do its places."""
    drawn, out = {}, {}
    for a, on in steps:
        last = next((b for b in reversed(drawn) if b in on), None)
        out.setdefault(on, last if last and set(on) <= {last, *drawn[last]} else None)
        drawn[a] = on
    return out


def permuted(df: DataFrame, at: Column, m: Column, key: Column, name: str) -> DataFrame:
    """df with the place that ``at``, of m places from 0 on, has in a permutation that ``key`` names.

    A turn by the key, then keyed Feistel rounds over x * y <= m places for whole x and y near the root of m: over the
    first of the m, then over the last, since the two leave out less than a root of m each. No row asks for another.
    """
    m = F.greatest(m, F.lit(1))  # no rows ask where there are none, but constants are worked out
    df = df.withColumns({"_key": key, "_of": m, "_y": F.floor(F.sqrt(m)).cast("long")})
    df = df.withColumn("_x", F.expr("_of div _y")).withColumn(name, F.pmod(at + F.pmod("_key", "_of"), "_of"))
    for k, first in enumerate(("0L", "_of - _x * _y")):
        df = df.withColumn("_o", F.expr(f"{name} - ({first})")).withColumn("_in", F.expr("_o >= 0 and _o < _x * _y"))
        df = df.withColumns({"_l": F.expr("_o div _x"), "_r": F.expr("_o % _x")})
        for turn in (2 * k, 2 * k + 1):
            left = F.expr(f"(_l + shiftrightunsigned(xxhash64({2 * turn}, _key, _r), 2)) % _y")
            right = (F.col("_r") + F.shiftrightunsigned(F.xxhash64(F.lit(2 * turn + 1), "_key", left), 2)) % F.col("_x")
            df = df.withColumns({"_l": left, "_r": right})
        df = df.withColumn(name, F.expr(f"if(_in, {first} + _l * _x + _r, {name})"))
    return df.drop("_key", "_of", "_x", "_y", "_o", "_in", "_l", "_r")


def reached(df: DataFrame, value: str, edges: str, most: int, name: str) -> DataFrame:
    """df with how many of the row's sorted edges, an array of up to ``most``, are at or below the value.

    A binary search with a column for each step: Spark compiles these with the rest of the stage, which it leaves where
    a lambda walks the array.
    """
    df = df.withColumn(name, F.lit(0))
    for step in (1 << k for k in reversed(range(most.bit_length()))):
        df = df.withColumn(name, F.expr(f"if({value} >= get({edges}, {name} + {step - 1}), {name} + {step}, {name})"))
    return df


def apart(df: DataFrame) -> DataFrame:
    """df, in as many partitions: what is asked of it later is compiled by itself.

    One method for several columns has over 8,000 bytes of code, beyond which the JVM interprets it.
    """
    return df.coalesce((1 << 31) - 1)


def placed(df: DataFrame, seed: int, salt: str, row: str) -> tuple[DataFrame, DataFrame]:
    """df (with _g) with each row's place in its group, _at, and the group's rows, _m; and the groups (_g, m).

    A distributed prefix sum: within parts of a group, after the rows of the parts before. Parts are as many as the
    group's counted rows ask for, so a group of all rows is as many tasks as that.
    """
    groups = df.groupBy("_g").agg(F.count(F.lit(1)).alias("m"))  # asked for more than once in one plan: its exchange is shared
    dealt = parted(df, "_g", groups, seed, salt, row)
    sizes = dealt.groupBy("_g", "_part").agg(F.count(F.lit(1)).alias("n"))
    group = W.partitionBy("_g")
    before = group.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sizes.select("_g", "_part", (F.sum("n").over(before) - F.col("n")).alias("_start"), F.sum("n").over(group).alias("_m"))
    rank = F.row_number().over(W.partitionBy("_g", "_part").orderBy(F.xxhash64(F.lit(seed), F.lit(salt), F.col(row)), row))
    ranked = dealt.withColumn("_rank", rank).join(starts, ["_g", "_part"])
    return ranked.withColumn("_at", F.col("_start") + F.col("_rank") - 1).drop("_part", "_rank", "_start"), groups


def _round(df: DataFrame, model: GraphicalModel, steps: Sequence[tuple[str, Clique]], seed: int, row: str, numbered: int | None) -> DataFrame:
    """A row's place in its group, permuted, is its rank there, which finds the code.

    The ranks of a code are consecutive, so a row's place in a group of what is drawn next follows from its rank and
    from the quotas' small tables: no row is shuffled, and the plan is cut from time to time only for its length. Only
    groups that hold given columns, or all rows if they have no numbers, are ranked by a shuffle.
    """
    source = sources(steps)
    sets = {on: k for k, on in enumerate(source)}
    groups: dict[Clique, DataFrame] = {}
    if numbered is not None and () in sets:
        df = df.withColumns({f"_at{sets[()]}": F.col(row), f"_m{sets[()]}": F.lit(numbered).cast("long")})
        groups[()] = df.sparkSession.createDataFrame([(0, numbered)], "_cell long, m long")
    made = 0
    for a, on in steps:
        k = sets[on]
        if on not in groups:
            # several plans read these rows: without the cut each would make them again
            df, counted = placed(cut(df).withColumn("_g", _cell(model, on)), seed, a, row)
            df, made = df.withColumnsRenamed({"_at": f"_at{k}", "_m": f"_m{k}"}), 0
            groups[on] = counted.select(F.col("_g").alias("_cell"), "m")
        elif made == COLUMNS_A_PLAN:
            df, made = cut(df), 0
        table = conditional(model, a, on)
        ranges = cut(quotas(groups[on], _frame(df, table), seed, a))
        # of each cell (group, code): where its rows begin in the groups that are drawn from next, and how many these hold
        codes = ranges.withColumns(_codes(model, on) | {a: F.col("code")})
        after = [s for s, b in source.items() if b == a]
        for s in after:
            own = W.partitionBy(f"_to{sets[s]}")
            upto = own.orderBy("_cell", "code").rowsBetween(W.unboundedPreceding, W.currentRow)
            n = F.col("hi") - F.col("lo")
            codes = codes.withColumn(f"_to{sets[s]}", _cell(model, s))
            codes = codes.withColumns({f"_from{sets[s]}": F.sum(n).over(upto) - F.col("hi"), f"_m{sets[s]}": F.sum(n).over(own)})
            groups[s] = codes.groupBy(F.col(f"_to{sets[s]}").alias("_cell")).agg(F.max(f"_m{sets[s]}").alias("m"))
        asked = [f"{c}{sets[s]}" for s in after for c in ("_from", "_m")]
        lists = codes.groupBy(F.col("_cell").alias("_g")).agg(F.sort_array(F.collect_list(F.struct("hi", "code", *asked))).alias("_q"), F.max("hi").alias("_rows"))
        lists = lists.select("_g", "_rows", *[F.col(f"_q.{c}").alias(f"_q_{c}") for c in ("hi", "code", *asked)])
        df = permuted(df.withColumn("_g", _cell(model, on)), F.col(f"_at{k}"), F.col(f"_m{k}"), F.xxhash64(F.lit(seed), F.lit(a), "_g"), "_rank")
        if table.size * (2 + len(asked)) <= BROADCAST_CELLS:
            df = df.join(F.broadcast(lists.drop("_rows")), "_g")
        else:  # ranks are dealt evenly: a group's list is repeated for every ROWS_A_PART of them
            parts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_rows - 1) div {ROWS_A_PART}")))
            df = df.withColumn("_part", F.expr(f"_rank div {ROWS_A_PART}")).join(lists.withColumn("_part", parts).drop("_rows"), ["_g", "_part"]).drop("_part")
        df = reached(df, "_rank", "_q_hi", model.domain[a], "_k")
        # every rank has a code; said to Spark, since it asks for keys that may be null whether they are, before it joins
        got = {c: F.coalesce(F.get(f"_q_{c}", F.col("_k")), F.lit(0)) for c in ("code", *asked)}
        places = {f"_at{sets[s]}": F.col("_rank") + got[f"_from{sets[s]}"] for s in after} | {f"_m{sets[s]}": got[f"_m{sets[s]}"] for s in after}
        df = df.withColumns({a: got["code"].cast("int")} | places)
        df, made = apart(df.drop("_g", "_rank", "_k", *[f"_q_{c}" for c in ("hi", *got)])), made + 1
    return df.drop(*[f"{c}{k}" for c in ("_at", "_m") for k in sets.values()])
