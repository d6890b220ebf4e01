"""Cube operators on DataFrames: long form, pivots, aggregates with arguments, proportions, joins, ranks.

All are lazy. Only the columns that are asked for enter a plan, so a wide table's other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most columns that a pivot makes as conditional aggregates in one pass; beyond that Spark's own pivot is used.
ONE_PASS = 200
AGGREGATE = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def compare(c: Column, op: str, number: float) -> Column:
    return {"<": c < number, ">": c > number, "!=": c != number, "<=": c <= number, ">=": c >= number, "=": c == number}[op]


def long_form(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(*dims, Measure, Value): a row per tuple and measure that has a value."""
    narrow = df.select(*map(col, dims), *(col(m).cast("double").alias(m) for m in measures))
    return narrow.unpivot([col(d) for d in dims], [col(m) for m in measures], "Measure", "Value").where("Value IS NOT NULL")


def combos(codes: dict[str, Sequence[str]]) -> list[tuple[str, ...]]:
    """All combinations of codes, in the order of the dimensions."""
    return list(product(*codes.values()))


def chosen(df: DataFrame, codes: dict[str, Sequence[str]]) -> DataFrame:
    """Rows with one of the codes in each dimension; a dimension without codes keeps all."""
    for d, c in codes.items():
        if c:
            df = df.where(col(d).isin(list(c)))
    return df


def pivoted(long: DataFrame, rows: Sequence[str], codes: dict[str, Sequence[str]], op: str = "MAX", value: str = "Value") -> DataFrame:
    """A row per `rows` and a column per combination of codes, named by joining them with _; the column exists whether or
    not the combination occurs.

    Rows outside the codes are dropped before the shuffle if no other dimension keys the rows; else they stay, as a group
    must not vanish because none of its rows has a code.
    """
    if not set(rows) - {"Measure"}:
        long = chosen(long, codes)
    every = combos(codes)
    agg = AGGREGATE[op]
    if len(every) <= ONE_PASS:
        hits = [reduce(Column.__and__, (col(d) == c for d, c in zip(codes, combo, strict=True)), F.lit(True)) for combo in every]
        cells = [agg(F.when(h, col(value))).alias("_".join(combo)) for h, combo in zip(hits, every, strict=True)]
        return long.groupBy(*map(col, rows)).agg(*cells)
    # codes may hold any character, so combinations are told apart by their number and not by their name
    numbers = {combo: n for n, combo in enumerate(dict.fromkeys(every))}
    named = [f"\1{d}" for d in codes]
    told = long.sparkSession.createDataFrame([(*combo, n) for combo, n in numbers.items()], ", ".join([*(f"`{c}` string" for c in named), "`\1n` int"]))
    on = reduce(Column.__and__, (col(d) == col(c) for d, c in zip(codes, named, strict=True)))
    met = long.join(F.broadcast(told), on, "left").drop(*named)
    cells = met.groupBy(*map(col, rows)).pivot("\1n", list(numbers.values())).agg(agg(col(value)))
    return cells.select(*map(col, rows), *(col(str(numbers[combo])).alias("_".join(combo)) for combo in every))


def grouped(long: DataFrame, keys: Sequence[str], op: str, value: str = "Value", name: str | None = None) -> DataFrame:
    return long.groupBy(*map(col, keys)).agg(AGGREGATE[op](col(value)).alias(name or op))


def arg_extreme(long: DataFrame, keys: Sequence[str], op: str, arg: Sequence[str], value: str = "Value") -> DataFrame:
    """(*keys, *arg, value) of the row with the least or greatest value in each group of keys. Of equal values MIN takes
    the least argument and MAX the greatest, so ties have one answer."""
    order = F.struct(col(value), *map(col, arg))
    best = (F.min if op == "MIN" else F.max)(F.when(col(value).isNotNull(), order))
    out = long.groupBy(*map(col, keys)).agg(best.alias("\1"))
    return out.select(*map(col, keys), *(F.col("\1")[a].alias(a) for a in arg), F.col("\1")[value].alias(value))


def proportion(
    long: DataFrame, keys: Sequence[str], group: str, codes: Sequence[str], digits: int | None = None, value: str = "Value"
) -> DataFrame:
    """(*keys, total, part, share): values with one of the codes as a percentage of all, rounded if digits are given."""
    part = F.sum(F.when(col(group).isin(list(codes)), col(value)).otherwise(0.0))
    out = long.groupBy(*map(col, keys)).agg(F.sum(col(value)).alias("total"), part.alias("part"))
    share = F.try_divide(F.col("part") * 100.0, F.col("total"))
    return out.withColumn("share", F.round(share, digits) if digits is not None else share)


def full_join(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of any number of parts on keys that all of them have; a key is the first that isn't null. Columns
    that an earlier part has too get _1, _2 and so on."""
    taken, named = set(keys), []
    for p in parts:
        for c in [c for c in p.columns if c not in keys]:
            name, n = c, 0
            while name in taken:
                n += 1
                name = f"{c}_{n}"
            taken.add(name)
            if name != c:
                p = p.withColumnRenamed(c, name)
        named.append(p)
    return reduce(lambda a, b: a.join(b, list(keys), "full"), named)


def rank_first(df: DataFrame, order: str, op: str) -> DataFrame:
    """Rows of rank 1 by a column, with rnk: all that tie for the least or greatest value (for null, if there is no
    other). The extreme is found by an aggregate and met by an equi-join with its one row, so no task sorts the table."""
    best = df.agg((F.min if op == "MIN" else F.max)(col(order)).alias("\1"))
    first = df.join(F.broadcast(best), col(order).eqNullSafe(F.col("\1")))
    return first.drop("\1").withColumn("rnk", F.lit(1).cast("bigint"))


def ranked(df: DataFrame, order: str, op: str, partition: Sequence[str] = ()) -> DataFrame:
    """df with rnk, nulls last either way."""
    by = col(order).asc_nulls_last() if op == "MIN" else col(order).desc_nulls_last()
    window = W.partitionBy(*map(col, partition)).orderBy(by) if partition else W.orderBy(by)
    return df.withColumn("rnk", F.rank().over(window).cast("bigint"))


def scaled(long: DataFrame, multipliers: dict[str, float]) -> DataFrame:
    """Values times the multiplier of their measure."""
    factor = reduce(lambda out, m: out.when(F.col("Measure") == m[0], F.lit(float(m[1]))), multipliers.items(), F.when(F.lit(False), F.lit(1.0)))
    return long.withColumn("Value", F.col("Value") * F.coalesce(factor, F.lit(1.0)))
