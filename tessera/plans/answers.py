"""Answers of expressions and SQL texts: run, checked, shaped, with few kinds of errors."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tessera.functions import units as U
from tessera.functions.sexpr import BracketError, ExpressionError, read
from tessera.operators import present as P
from tessera.plans.compile import run, values_of
from tessera.plans.sqlfront import SqlError, _at, _items, _walk, pivot_parts, run_sql, sql_question_type, tree
from tessera.sources.catalog import Catalog

#: Errors that say what is wrong with a question; others become AnswerError.
OWN = (U.UnitCompatibilityError, SqlError, ExpressionError, BracketError, ParseException, AnalysisException, KeyError, NotImplementedError, ValueError, TypeError)


class AnswerError(RuntimeError):
    """An answer that couldn't be made, for a reason that isn't the question's."""


def sql_measures(sql: str) -> list[str]:
    """Names that a text's UNPIVOTs list, in order, each once."""
    out: dict[str, None] = {}
    for level in _walk(tree(sql)):
        for k in range(len(level) - 1):
            if _at(level, k, "UNPIVOT") and isinstance(level[k + 1], list) and len(level[k + 1]) == 5 and isinstance(level[k + 1][4], list):
                out.update((x[0].bare, None) for x in _items(level[k + 1][4]) if not isinstance(x[0], list) and not x[0].is_("COLUMNS"))
    return list(out)


def check_sql(sql: str, catalog: Catalog) -> None:
    """The unit rules for a text that takes measures together: a SUM, AVG, MIN or MAX whose pivot doesn't keep them apart.
    UnitCompatibilityError if they don't fit."""
    if sql_question_type(sql) not in ("SUM", "AVG", "MIN", "MAX"):
        return
    for level in _walk(tree(sql)):
        for k in range(len(level) - 1):
            if _at(level, k, "PIVOT") and isinstance(level[k + 1], list):
                _, fors, group = pivot_parts(level[k + 1])
                if "Measure" in group or "Measure" in fors:
                    return
    units = {m: u for cube in catalog for m, u in cube.units.items()}
    U.check({m: units[m] for m in sql_measures(sql) if m in units}, allow_scaling=False)


def answer(text: str, spark: SparkSession, catalog: Catalog, mode: str = "pivot", shaped: bool = True) -> DataFrame:
    """The answer of an expression (in a mode) or of an SQL text, shaped by present(). Errors of the question come as they
    are (OWN), any other one as AnswerError."""
    try:
        if text.lstrip().startswith("("):
            e = read(text)
            out, cubes = run(e, catalog, mode), [catalog[v.table] for v in values_of(e)]
        else:
            check_sql(text, catalog)
            out, cubes = run_sql(text, spark, catalog), list(catalog)
        if not shaped:
            return out
        units = {m: u for c in cubes for m, u in c.units.items()}
        return P.present(out, None if mode == "simplified" else units, {k: v for c in cubes for k, v in c.labels.items()})
    except OWN:
        raise
    except Exception as e:
        raise AnswerError(f"no answer: {type(e).__name__}: {e}") from e


def error_kind(text: str, spark: SparkSession, catalog: Catalog, mode: str = "pivot") -> str:
    """The name of the error that a text ends in, or an empty text."""
    try:
        answer(text, spark, catalog, mode)
    except Exception as e:
        return type(e).__name__
    return ""
