"""Expressions to lazy DataFrames, in one of three modes whose answers differ by design.

native: labelled pivot tables with arguments of extremes. pivot: what pivot SQL gives. simplified: tidy rows.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import units as U
from tessera.functions.sexpr import Aggregate, Expression, Join, Prop, Value, read
from tessera.operators import cube as C
from tessera.sources.catalog import Catalog, Cube

MODES = ("native", "pivot", "simplified")


def run(text: str | Expression, catalog: Catalog, mode: str = "native", **flags) -> DataFrame:
    """The answer of an expression. flags: compat_prop_filter=True leaves a comparison out of PROP in SQL modes;
    check_units=False skips the unit rules."""
    if mode not in MODES:
        raise ValueError(f"mode: {mode!r}")
    e = read(text) if isinstance(text, str) else text
    analyse(e, catalog, mode, flags.get("check_units", True))
    return {"native": _native, "pivot": _pivot, "simplified": _simplified}[mode](e, catalog, flags)


# -- analysis ----------------------------------------------------------------------------------------------------------


def values_of(e: Expression) -> list[Value]:
    if isinstance(e, Value):
        return [e]
    return list(e.parts) if isinstance(e, Join) else values_of(e.child)


def analyse(e: Expression, catalog: Catalog, mode: str, check_units: bool = True) -> None:
    """Columns exist and measures may be taken together; else KeyError or UnitCompatibilityError."""
    for v in values_of(e):
        cube = catalog[v.table]
        if missing := [m for m in v.measures if m not in cube.measures]:
            raise KeyError(f"{cube.name} has no measures {missing}")
        if missing := [g for g in v.groups if g not in cube.dims]:
            raise KeyError(f"{cube.name} has no dimensions {missing}")
    if not check_units or not isinstance(e, Aggregate):
        return
    if isinstance(e.child, Value) and e.group is None:
        U.check(_units(e.child, catalog), allow_scaling=mode == "native")
    elif isinstance(e.child, Join) and _on_measure(e.child):
        every = [(f"{v.table}.{m}", u) for v in e.child.parts for m, u in _units(v, catalog).items()]
        U.check(dict(every), allow_scaling=mode == "native")


def _units(v: Value, catalog: Catalog) -> dict[str, U.Unit]:
    cube = catalog[v.table]
    return {m: cube.units.get(m, U.Unit()) for m in v.measures}


def _on_measure(j: Join) -> bool:
    """Whether a join's keys are measures and not dimensions."""
    return all(k not in v.groups for k in j.keys for v in j.parts)


# -- shared pieces -----------------------------------------------------------------------------------------------------


def _cube(v: Value, catalog: Catalog) -> Cube:
    return catalog[v.table]


def _long(v: Value, catalog: Catalog) -> DataFrame:
    long = C.long_form(_cube(v, catalog).df, v.groups, v.measures)
    return long.where(C.compare(F.col("Value"), v.condition.op, v.condition.number)) if v.condition else long


def _with_codes(v: Value, without: tuple[str, ...] = ()) -> dict[str, tuple[str, ...]]:
    return {g: c for g, c in v.dims if c and g not in without}


def _open_groups(v: Value) -> list[str]:
    return [g for g, c in v.dims if not c]


def _tidy(v: Value, catalog: Catalog) -> DataFrame:
    df = C.chosen(_cube(v, catalog).df, dict(v.dims))
    return df.where(C.compare(C.col(v.measures[0]), v.condition.op, v.condition.number)) if v.condition else df


def _joined_part(v: Value, keys: tuple[str, ...], catalog: Catalog, op: str) -> DataFrame:
    """A child of a join on dimensions: a row per keys, a column per combination of the other dimensions' codes, or per
    measure if the keys are all of them."""
    long = C.chosen(_long(v, catalog), {k: v.codes(k) for k in keys})
    codes = _with_codes(v, keys)
    codes = codes | {"Measure": v.measures} if op == "AVG" or not codes else codes
    rows = [*keys, *(g for g in _open_groups(v) if g not in keys)]
    return C.pivoted(long, rows, codes, op)


# -- pivot SQL ---------------------------------------------------------------------------------------------------------


def _pivot(e: Expression, catalog: Catalog, flags: dict) -> DataFrame:
    if isinstance(e, Value):
        return C.pivoted(_long(e, catalog), ["Measure", *_open_groups(e)], _with_codes(e), "MAX")
    if isinstance(e, Prop):
        return _prop_sql(e, catalog, flags)
    if isinstance(e, Join):
        return _join_pivot(e, catalog)
    if isinstance(e.child, Join):
        return _stacked(e, catalog)
    return _aggregate_pivot(e, catalog)


def _aggregate_pivot(e: Aggregate, catalog: Catalog) -> DataFrame:
    v = e.child
    long = _long(v, catalog)
    if e.group is None:
        out = C.pivoted(long, _open_groups(v), _with_codes(v), e.op)
        return out.withColumn("Measure", F.lit(";".join(v.measures)))
    codes = _with_codes(v, (e.group,))
    if not codes:  # nothing else to pivot by
        codes = {"Measure": v.measures}
    long = C.chosen(long, {e.group: v.codes(e.group)})
    others = [g for g in _open_groups(v) if g != e.group]
    return C.pivoted(long, ["Measure", *others], codes, e.op)


def _prop_sql(e: Prop, catalog: Catalog, flags: dict) -> DataFrame:
    v = e.child
    if flags.get("compat_prop_filter"):
        v = Value(v.table, v.measures, v.dims)
    long = C.chosen(_long(v, catalog), dict(v.dims))
    keys = sorted([*(g for g in v.groups if g != e.group), "Measure"])
    long = long.withColumn("Dimension_Measure", F.concat_ws(", ", *map(C.col, keys)))
    out = C.proportion(long, ["Dimension_Measure"], e.group, e.codes, digits=2)
    return out.select("Dimension_Measure", F.col("total").alias(f"SUM[{e.group}]"), F.col("part").alias("_".join(e.codes)), F.col("share").alias("%"))


def _join_pivot(j: Join, catalog: Catalog) -> DataFrame:
    if _on_measure(j):
        parts = [C.pivoted(_long(v, catalog), ["Measure", *_open_groups(v)], _with_codes(v), "MAX") for v in j.parts]
        return C.full_join(parts, ["Measure"])
    out = C.full_join([_joined_part(v, j.keys, catalog, "MAX") for v in j.parts], list(j.keys))
    if len(j.keys) == 1:
        return out
    rest = [C.col(c) for c in out.columns if c not in j.keys]
    return out.select(F.concat_ws(", ", *map(C.col, j.keys)).alias("Dimension_Measure"), *rest)


def _stacked(e: Aggregate, catalog: Catalog) -> DataFrame:
    """An aggregate over a join: the cells of both tables below each other. Cells are the pivots' (the greatest value of
    each combination), which is what the long forms hold if tuples don't repeat."""
    parts = []
    for v in e.child.parts:
        keys = [g for g in v.groups if v.codes(g)]
        cells = C.chosen(_long(v, catalog), dict(v.dims)).groupBy("Measure", *map(C.col, [*keys, *_open_groups(v)])).agg(F.max("Value").alias("Value"))
        parts.append(cells.select("Measure", "Value"))
    return C.grouped(reduce(DataFrame.unionByName, parts), ["Measure"], e.op)


# -- simplified SQL ----------------------------------------------------------------------------------------------------


def _simplified(e: Expression, catalog: Catalog, flags: dict) -> DataFrame:
    if isinstance(e, Value):
        return _tidy(e, catalog).select(*map(C.col, e.groups), *map(C.col, e.measures))
    if isinstance(e, Prop):
        return _prop_sql(e, catalog, flags)
    if isinstance(e, Join):
        return _join_tidy(e, catalog)
    if isinstance(e.child, Join):
        m = e.child.parts[0].measures[0]
        out = _join_tidy(e.child, catalog).groupBy(F.lit(m).alias("Measure")).agg(C.AGGREGATE[e.op](C.col(m)).alias(e.op))
        return out
    v = e.child
    if e.op in ("SUM", "AVG"):  # the group stays in the keys, so measures are added up and nothing else is
        total = reduce(lambda a, b: a + b, (C.col(m).cast("double") for m in v.measures))
        return _tidy(v, catalog).groupBy(*map(C.col, v.groups)).agg(C.AGGREGATE[e.op](total).alias(e.op))
    if e.group is None:
        long = C.chosen(_long(v, catalog), dict(v.dims))
        out = C.rank_first(long, "Value", e.op)
        return out.select("rnk", "Measure", *map(C.col, v.groups), F.col("Value").alias(f"{e.op}[Value]"))
    if len(v.measures) > 1:
        warnings.warn(f"{e.op} over a group ranks by {v.measures[0]} only", stacklevel=2)
    out = C.rank_first(_tidy(v, catalog), v.measures[0], e.op)
    others = [C.col(g) for g in v.groups if g != e.group]
    return out.select("rnk", C.col(v.measures[0]), *others, C.col(e.group).alias(f"{e.op}[{e.group}]"))


def _join_tidy(j: Join, catalog: Catalog) -> DataFrame:
    """Two tables side by side on all dimensions that both have; with a measure as key, on equal values of the measures
    that both have as well. Without either, on the keys."""
    if len(j.parts) != 2:
        raise NotImplementedError("a simplified JOIN takes two expressions")
    a, b = (_tidy(v, catalog).select(*map(C.col, dict.fromkeys([*v.groups, *v.measures]))) for v in j.parts)
    x, y = j.parts
    common = [g for g in x.groups if g in y.groups]
    if _on_measure(j):
        common += [m for m in x.measures if m in y.measures]
    on = common or list(j.keys)
    met = a.alias("a").join(b.alias("b"), reduce(lambda p, q: p & q, (F.col(f"a.`{k}`") == F.col(f"b.`{k}`") for k in on)), "full")
    shown = [k for k in j.keys if k in a.columns and k in b.columns]
    out = {k: F.coalesce(F.col(f"a.`{k}`"), F.col(f"b.`{k}`")) for k in shown}
    for side, v in (("a", x), ("b", y)):
        for m in v.measures:
            out.setdefault(m, F.col(f"{side}.`{m}`"))
    for side, v in (("a", x), ("b", y)):
        for g in v.groups:
            out.setdefault(g, F.col(f"{side}.`{g}`"))
    return met.select(*(c.alias(n) for n, c in out.items()))


# -- native ------------------------------------------------------------------------------------------------------------


def _native(e: Expression, catalog: Catalog, flags: dict) -> DataFrame:
    if isinstance(e, Value):
        return C.pivoted(_long(e, catalog), ["Measure", *_open_groups(e)], _with_codes(e), "AVG")
    if isinstance(e, Prop):
        v = e.child
        long = _cells(v, catalog)
        out = C.proportion(long, ["Measure", *(g for g in v.groups if g != e.group)], e.group, e.codes)
        return out.withColumnsRenamed({"part": "_".join(e.codes), "share": "%"})
    if isinstance(e, Join):
        if _on_measure(e):
            parts = [C.pivoted(_long(v, catalog), ["Measure", *_open_groups(v)], _with_codes(v), "AVG") for v in e.parts]
            return C.full_join(parts, ["Measure"])
        return C.full_join([_joined_part(v, e.keys, catalog, "AVG") for v in e.parts], list(e.keys))
    if isinstance(e.child, Join):
        cells = reduce(DataFrame.unionByName, (_cells(v, catalog).select("Measure", "Value") for v in e.child.parts))
        return cells.agg(C.AGGREGATE[e.op]("Value").alias(e.op))
    return _aggregate_native(e, catalog)


def _cells(v: Value, catalog: Catalog) -> DataFrame:
    """The cells of a native pivot table in long form: the mean of each tuple and measure."""
    long = C.chosen(_long(v, catalog), dict(v.dims))
    return long.groupBy("Measure", *map(C.col, v.groups)).agg(F.avg("Value").alias("Value"))


def _aggregate_native(e: Aggregate, catalog: Catalog) -> DataFrame:
    v = e.child
    cells = _cells(v, catalog)
    if e.group is None:
        known = _units(v, catalog)
        multipliers = {m: u.multiplier or 1.0 for m, u in known.items()}
        scale = len({u.multiplier for u in known.values()}) > 1
        if scale:
            cells = C.scaled(cells, multipliers)
        unit = "number" if scale else next(iter(known.values())).text
        if e.op in ("MIN", "MAX"):
            keys = list(v.groups)
            return C.arg_extreme(cells, keys, e.op, ["Measure"]).withColumn("Unit", F.lit(unit))
        if len(v.measures) == 1:  # one row of cells: across all of them
            return cells.agg(C.AGGREGATE[e.op]("Value").alias(e.op)).withColumn("Measure", F.lit(v.measures[0]))
        return C.grouped(cells, v.groups, e.op).withColumns({"Measure": F.lit("\n".join(v.measures)), "Unit": F.lit(unit)})
    keys = ["Measure", *(g for g in v.groups if g != e.group)]
    if e.op in ("MIN", "MAX"):
        return C.arg_extreme(cells, keys, e.op, [e.group])
    return C.grouped(cells, keys, e.op, name=f"{e.op}[{e.group}]")
