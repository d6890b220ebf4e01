"""Shaping of answers: units, labels, names of pivot columns. Each step is a function from DataFrame to DataFrame."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.units import Unit
from tessera.operators.cube import col


class FormatWarning(UserWarning):
    """An answer that couldn't be shaped and is given as it is."""


@dataclass(frozen=True)
class ColumnName:
    """The codes that a pivot column's name is made of, and the dimension that owns each (None: unknown)."""

    name: str
    codes: tuple[str, ...]
    dims: tuple[str | None, ...]


def drop_null_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """df without columns that hold no value; one pass over all columns."""
    rest = [c for c in df.columns if c not in keep]
    counts = df.agg(*(F.count(col(c)).alias(f"n{k}") for k, c in enumerate(rest))).first()
    empty = {c for k, c in enumerate(rest) if not counts[k]}
    return df.select(*(col(c) for c in df.columns if c not in empty))


def drop_repeats(df: DataFrame) -> DataFrame:
    """df without columns named like another one with _ and up to two digits, as joins make them."""
    names = set(df.columns)
    out = [c for c in df.columns if not ((m := re.fullmatch(r"(.*)_(\d{0,2})", c)) and m[1] in names)]
    return df.select(*map(col, out))


def with_units(df: DataFrame, units: dict[str, Unit], measure: str = "Measure") -> DataFrame:
    """Adds Unit: the text of the measure's unit. Measures joined by ", " or ";" get those of all, each once, joined by
    the first separator; an unknown one gets an empty text."""
    texts = {m: u.text for m, u in units.items()}
    if not texts:
        return df.withColumn("Unit", F.lit(""))
    df, known = _with_map(df, texts)
    single = F.element_at(known, col(measure))
    parts = F.array_distinct(F.filter(F.transform(F.split(measure, ", |;|\n"), lambda m: F.element_at(known, m)), lambda u: u.isNotNull()))
    return df.withColumn("Unit", F.coalesce(single, F.array_join(parts, ", "), F.lit(""))).drop(known)


def _with_map(df: DataFrame, told: dict[str, str]) -> tuple[DataFrame, Column]:
    """df with a column that holds a map, from a table of one row: so the plan doesn't grow with the map."""
    name = "\1map"
    one = df.sparkSession.createDataFrame([(told,)], f"`{name}` map<string,string>")
    return df.crossJoin(F.broadcast(one)), F.col(f"`{name}`")


def split_name(name: str) -> tuple[str, ...]:
    """The codes in a pivot column's name: parts before which there is a _ and that have three characters or more, so
    that a code's own short ending stays with it."""
    out, start = [], 0
    for m in re.finditer("_", name):
        ahead = name[m.end() : m.end() + 3]
        if len(ahead) == 3 and "_" not in ahead and m.start() >= start:
            out.append(name[start : m.start()])
            start = m.end()
    return (*out, name[start:])


def column_names(names: Sequence[str], codes: dict[str, Sequence[str]]) -> list[ColumnName]:
    """Which codes and dimensions pivot columns stand for, given the codes of each dimension."""
    owner = {c: d for d, every in codes.items() for c in every}
    return [ColumnName(n, parts := split_name(n), tuple(owner.get(p) for p in parts)) for n in names]


def label_cells(df: DataFrame, columns: Sequence[str], labels: dict[str, str]) -> DataFrame:
    """Codes in cells become labels; parts of composites (joined by ";", ", " or a line's end) each on their own."""
    if not labels:
        return df
    df, known = _with_map(df, labels)
    out = {}
    for c in columns:
        one = F.element_at(known, col(c))
        for sep in (";", ", ", "\n"):
            many = F.array_join(F.transform(F.split(c, sep), lambda p: F.coalesce(F.element_at(known, p), p)), sep)
            one = F.coalesce(one, F.when(F.instr(col(c), sep) > 0, many))
        out[c] = F.coalesce(one, col(c))
    return df.withColumns(out).drop(known)


def label_columns(df: DataFrame, labels: dict[str, str], sep: str = " | ") -> DataFrame:
    """Pivot columns named by labels; a name that would occur twice keeps its codes, as labels aren't unique."""
    named = [sep.join(labels.get(p, p) for p in split_name(c)) for c in df.columns]
    named = [c if named.count(n) > 1 else n for c, n in zip(df.columns, named, strict=True)]
    return df.select(*(col(c).alias(n) for c, n in zip(df.columns, named, strict=True)))


def indexed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with keys first; one that isn't a column selects the rows of that measure."""
    here = [k for k in keys if k in df.columns]
    for k in keys:
        if k not in df.columns and "Measure" in df.columns:
            df = df.where(F.col("Measure") == k)
        elif k not in df.columns:
            warnings.warn(f"no column {k}", FormatWarning, stacklevel=2)
    return df.select(*map(col, here), *(col(c) for c in df.columns if c not in here))


def present(df: DataFrame, units: dict[str, Unit] | None = None, labels: dict[str, str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """All steps in order: empty columns and repeats go, Dimension_Measure becomes Measure, rnk goes, units and labels
    come, columns are sorted behind the keys. An answer without rows or values is only sorted."""
    plain = df.select(*map(col, sorted(df.columns)))
    shaped = drop_null_columns(df)
    if not shaped.columns or shaped.isEmpty():
        return plain
    shaped = drop_repeats(shaped).withColumnRenamed("Dimension_Measure", "Measure").drop("rnk")
    if units is not None and "Measure" in shaped.columns:
        shaped = with_units(shaped, units)
    shaped = indexed(shaped, keys or [c for c in ("Measure", "Unit") if c in shaped.columns])
    fixed = [c for c in (*keys, "Measure", "Unit") if c in shaped.columns]
    shaped = shaped.select(*map(col, dict.fromkeys(fixed)), *(col(c) for c in sorted(shaped.columns) if c not in fixed))
    if labels:
        texts = [c for c, t in shaped.dtypes if t == "string" and c != "Unit"]
        shaped = label_columns(label_cells(shaped, texts, labels), labels)
    return shaped


def grid(df: DataFrame, rows: int = 50) -> str:
    """The first rows as a text grid."""
    got = [df.columns, *([("" if v is None else str(v)) for v in r] for r in df.take(rows))]
    widths = [max(len(r[k]) for r in got) for k in range(len(df.columns))]
    line = "+".join("-" * (w + 2) for w in widths)
    body = ["|".join(f" {v:<{w}} " for v, w in zip(r, widths, strict=True)) for r in got]
    return "\n".join([f"+{line}+", *(f"|{b}|\n+{line}+" for b in body)])
