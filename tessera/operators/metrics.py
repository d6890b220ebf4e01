"""Comparison of answers and retrieval figures, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.cube import col

#: Decimals to which numbers are compared, and rows up to which strict comparison is made.
DIGITS, MOST_ROWS = 5, 1000


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _cell(df: DataFrame, c: str) -> Column:
    """A cell as text, tagged by kind, so that 1 and 1.0 are equal and "1" is something else; null for null and NaN."""
    if _is_number(df, c):
        v = col(c).cast("double")
        rounded = F.round(v, DIGITS) + F.lit(0.0)  # -0.0 is 0.0
        return F.when(~F.isnan(v), F.concat(F.lit("n:"), rounded.cast("string")))
    return F.concat(F.lit("s:"), col(c).cast("string"))


def records(df: DataFrame) -> DataFrame:
    """(record, n): rows as multisets of their cells, whatever the columns' names and order; nulls left out."""
    cells = F.filter(F.array(*(_cell(df, c) for c in df.columns)), lambda x: x.isNotNull())
    return df.select(F.array_sort(cells).alias("record")).groupBy("record").agg(F.count(F.lit(1)).alias("n"))


def cells(df: DataFrame, numbers_only: bool = False) -> DataFrame:
    """(cell, n)"""
    chosen = [c for c in df.columns if not numbers_only or _is_number(df, c)]
    every = F.array(*(_cell(df, c) for c in chosen)).cast("array<string>")
    return df.select(F.explode(every).alias("cell")).where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def _overlap(truth: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """One row: hits and total of truth, total of given, by counts per key."""
    met = truth.select(key, F.col("n").alias("a")).join(given.select(key, F.col("n").alias("b")), key, "full")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return met.agg(zero(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("hits"), zero("a").alias("truth"), zero("b").alias("given"))


def _share(both: DataFrame, name: str) -> DataFrame:
    value = F.when(F.col("truth") > 0, F.col("hits") / F.col("truth")).otherwise(F.when(F.col("given") == 0, 1.0).otherwise(0.0))
    return both.select(value.cast("double").alias(name))


def transposed(df: DataFrame) -> DataFrame:
    """Rows and columns of a small answer exchanged; rows are numbered in their given order."""
    rows = df.collect()
    spark = df.sparkSession
    kinds = {type(df.schema[c].dataType) for c in df.columns}
    number = all(issubclass(k, T.NumericType) for k in kinds)
    cast = (lambda v: None if v is None else float(v)) if number else (lambda v: None if v is None else str(v))
    data = [tuple(cast(r[c]) for r in rows) for c in df.columns]
    kind = "double" if number else "string"
    return spark.createDataFrame(data, ", ".join(f"c{k} {kind}" for k in range(len(rows)))) if rows else df


def record_accuracy(truth: DataFrame, given: DataFrame) -> DataFrame:
    """One row, record_accuracy: the share of truth's records that given has too, each used once."""
    return _share(_overlap(records(truth), records(given), "record"), "record_accuracy")


def record_accuracy_either_way(truth: DataFrame, given: DataFrame) -> float:
    """record_accuracy(), or, where truth isn't square and nothing fits, that of truth transposed."""
    plain = record_accuracy(truth, given).first()[0]
    n = truth.limit(MOST_ROWS + 1).count()
    if plain > 0 or n == len(truth.columns) or not 0 < n <= MOST_ROWS:
        return plain
    return max(plain, record_accuracy(transposed(truth), given).first()[0])


def numeric_recall(truth: DataFrame, given: DataFrame) -> DataFrame:
    """One row, numeric_recall: the share of truth's numbers that given has too, as multisets; without numbers in truth 1
    if given has none either."""
    return _share(_overlap(cells(truth, True), cells(given, True), "cell"), "numeric_recall")


def lenient_equal(truth: DataFrame, given: DataFrame) -> DataFrame:
    """One row, lenient: 1.0 if both hold the same cells, wherever they stand."""
    both = _overlap(cells(truth), cells(given), "cell")
    same = (F.col("hits") == F.col("truth")) & (F.col("hits") == F.col("given"))
    return both.select(same.cast("double").alias("lenient"))


def strict_equal(truth: DataFrame, given: DataFrame) -> DataFrame:
    """One row, strict: 1.0 if both hold the same rows, columns matched by name and order ignored; 0.0 where names differ
    or an answer has MOST_ROWS rows or more."""
    spark = truth.sparkSession
    if sorted(truth.columns) != sorted(given.columns):
        return spark.range(1).select(F.lit(0.0).alias("strict"))
    rows = lambda df: df.select(F.array(*(_cell(df, c) for c in sorted(df.columns))).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    a, b = rows(truth), rows(given)
    met = a.select("r", F.col("n").alias("a")).join(b.select(F.col("r").alias("q"), F.col("n").alias("b")), F.col("r") == F.col("q"), "full")
    whole = met.agg(
        F.coalesce(F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), 0).otherwise(1)), F.lit(0)).alias("off"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"),
    )
    same = (F.col("off") == 0) & (F.col("a") < MOST_ROWS) & (F.col("b") < MOST_ROWS)
    return whole.select(same.cast("double").alias("strict"))


def set_f1(truth: Column, given: Column) -> Column:
    """F1 of two arrays as sets; 1 if both are empty."""
    a, b = F.array_distinct(truth), F.array_distinct(given)
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def extra_missing(truth: Column, given: Column) -> tuple[Column, Column]:
    """Numbers of elements that only given, and that only truth has."""
    return F.size(F.array_except(given, truth)).cast("long"), F.size(F.array_except(truth, given)).cast("long")


def selection_f1(truth: DataFrame, given: DataFrame, hierarchy: DataFrame, key: str = "qid") -> DataFrame:
    """For each key, F1 of the selected items and how many are extra or missing. truth and given: (key, item); an item that
    has children in hierarchy (node, child), a group without codes, stands for all of them."""

    def items(df: DataFrame) -> DataFrame:
        opened = df.join(hierarchy, F.col("item") == F.col("node"), "left")
        return opened.groupBy(key).agg(F.collect_set(F.coalesce("child", "item")).alias("items"))

    met = items(truth).withColumnRenamed("items", "t").join(items(given).withColumnRenamed("items", "g"), key, "full")
    none = F.array().cast("array<string>")
    t, g = F.coalesce("t", none), F.coalesce("g", none)
    extra, missing = extra_missing(t, g)
    return met.select(key, set_f1(t, g).alias("f1"), extra.alias("extra"), missing.alias("missing"))


def component_f1(truth: dict[str, set], given: dict[str, set]) -> dict[str, float]:
    """F1 of two queries' components (see plans.sqlfront.components), by clause."""
    out = {}
    for clause in sorted(truth.keys() | given.keys()):
        a, b = truth.get(clause, set()), given.get(clause, set())
        out[clause] = 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
    return out


def accuracy_at(ranked: DataFrame, golden: DataFrame, k: int, key: str = "qid", item: str = "id") -> DataFrame:
    """For each key: recall of golden items among the first k, and exact (1.0 if the first as many as there are golden ones
    are just these). ranked has key, item, rank."""
    want = golden.select(key, item).distinct()
    n = want.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hits = want.join(ranked.select(key, item, "rank"), [key, item])
    per = hits.join(n, key).groupBy(key).agg(
        F.sum((F.col("rank") <= k).cast("long")).alias("at_k"), F.sum((F.col("rank") <= F.col("n")).cast("long")).alias("first")
    )
    out = n.join(per, key, "left")
    at_k = F.coalesce("at_k", F.lit(0)) / F.col("n")
    return out.select(key, at_k.alias("recall"), (F.coalesce("first", F.lit(0)) == F.col("n")).cast("double").alias("exact"))


def accuracy_until(ranked: DataFrame, golden: DataFrame, k: int, key: str = "qid", item: str = "id") -> DataFrame:
    """(k, recall): mean recall among the first 1, 2, ... k over all keys."""
    want = golden.select(key, item).distinct()
    n = want.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hits = want.join(ranked.select(key, item, "rank").where(F.col("rank") <= k), [key, item], "left")
    steps = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k")
    each = hits.select(key, "rank", steps).groupBy(key, "k").agg(F.sum(F.when(F.col("rank") <= F.col("k"), 1).otherwise(0)).alias("got"))
    return each.join(n, key).groupBy(F.col("k").cast("long").alias("k")).agg(F.avg(F.col("got") / F.col("n")).alias("recall"))


def per_type(results: DataFrame, types: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Means of scores and counts for each combination of types and each total over them (null: all)."""
    return results.rollup(*map(col, types)).agg(F.count(F.lit(1)).alias("n"), *(F.avg(col(s)).alias(s) for s in scores))


def error_counts(results: DataFrame, column: str = "error") -> DataFrame:
    """(error, n): how many answers failed for each kind of reason; null: none."""
    kind = reduce(
        lambda out, kv: out.when(F.col(column).rlike(kv[0]), kv[1]),
        (("(?i)unit", "unit"), ("(?i)syntax|pars", "syntax"), ("(?i)no such|not found|unresolved|binder", "missing"), ("(?i)time", "timeout")),
        F.when(F.col(column).isNull(), F.lit(None).cast("string")),
    ).otherwise("other")
    return results.groupBy(kind.alias("error")).agg(F.count(F.lit(1)).alias("n"))


def latency(results: DataFrame, column: str = "seconds") -> DataFrame:
    """One row: mean and median."""
    return results.agg(F.avg(col(column)).alias("mean"), F.percentile(col(column), 0.5).alias("median"))


def exact_match(a: str, b: str) -> bool:
    """Whether two queries are the same text but for case and white space."""
    return " ".join(a.lower().split()) == " ".join(b.lower().split())
