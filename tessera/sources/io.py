"""Files that questions, collections and graphs come from and go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QA = "question string, sexp string, sql string, simplified_sql string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their expression and SQL texts, one JSON object per line."""
    return spark.read.schema(QA).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tabs and line ends inside texts become spaces, so that a row is a line."""
    flat = [F.regexp_replace(c, r"[\t\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def collection(docs: DataFrame, id_col: str, text_col: str, part_rows: int = 200_000) -> DataFrame:
    """(pid, node, body): documents numbered from 0 in the order of their ids, null first, then texts. They are dealt into
    ranges of about part_rows by bounds from a sample of the ids (by hash, so that every evaluation deals alike), numbered
    within each range, and the ranges' counts added up; so no task holds all rows."""
    rows = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("body"))
    total = rows.count()
    parts = -(-total // part_rows) or 1
    bounds = []
    if parts > 1:  # some 50 sampled ids for each range
        every = max(1, part_rows // 50)
        sample = rows.where(F.col("node").isNotNull() & (F.pmod(F.xxhash64("node"), F.lit(every)) == 0)).select("node").distinct().collect()
        found = sorted(r["node"] for r in sample)
        bounds = found[:: max(1, len(found) // parts)][1:]
    part = F.lit(0)
    if bounds:
        table = rows.sparkSession.createDataFrame([(bounds,)], f"bounds array<{rows.schema['node'].dataType.simpleString()}>")
        rows = rows.crossJoin(F.broadcast(table))  # one row
        part = F.size(F.filter("bounds", lambda b: b <= F.col("node")))
    rows = rows.select("node", "body", F.coalesce(part, F.lit(0)).alias("part"))
    starts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    nth = F.row_number().over(W.partitionBy("part").orderBy("node", "body")) - 1
    numbered = rows.withColumn("nth", nth).join(F.broadcast(starts), F.col("part") == F.col("p"))  # a row for each range
    return numbered.select((F.col("start") + F.col("nth")).cast("long").alias("pid"), "node", "body")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, g) of the N-Triples or N-Quads lines of a file."""
    return ntriples(spark.read.text(path))


def ntriples(lines: DataFrame) -> DataFrame:
    """(s, p, o, g) of lines (value); literals lose quotes, language tags and types; other lines are left out."""
    term = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)'
    line = rf"^\s*{term}\s+{term}\s+{term}(?:\s+{term})?\s*\.\s*$"
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r'^"((?:[^"\\]|\\.)*)".*$', "$1"), r"^<(.*)>$", "$1")
    rows = lines.where(F.col("value").rlike(line))
    return rows.select(*(bare(F.regexp_extract("value", line, k)).alias(n) for k, n in enumerate("spog", 1)))
