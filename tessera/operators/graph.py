"""Metadata graph: triples (s, p, o) and the questions that are asked of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.catalog import Catalog

#: Predicates, named like the vocabulary terms that they stand for.
MEASURE, DIMENSION, CONCEPT = "qb:measure", "qb:dimension", "qb:concept"
LABEL, ALT, DEFINITION, BROADER, NARROWER = "skos:prefLabel", "skos:altLabel", "skos:definition", "skos:broader", "skos:narrower"
ID, TITLE, DESCRIPTION, TYPE = "dct:identifier", "dct:title", "dct:description", "rdf:type"
UNIT, SYSTEM, MULTIPLIER, SCALING = "qudt:unit", "qudt:unitOfSystem", "qudt:conversionMultiplier", "qudt:scalingOf"
TIME, GEO = "TimeDimension", "GeoDimension"


def triples_of(spark: SparkSession, catalog: Catalog, codes: dict[str, dict[str, Sequence[str]]] | None = None) -> DataFrame:
    """Triples that describe cubes; codes: by cube and dimension, those that hang below it."""
    rows = []
    for cube in catalog:
        rows += [(cube.name, ID, cube.name), (cube.name, TITLE, f"Table {cube.name}"), (cube.name, DESCRIPTION, f"Cube {cube.name} of {len(cube.measures)} measures")]
        for m in cube.measures:
            node = f"{cube.name}#{m}"
            unit = cube.units.get(m)
            rows += [(cube.name, MEASURE, node), (node, ID, m), (node, LABEL, cube.labels.get(m, m))]
            if unit and unit.unit:
                rows.append((node, UNIT, unit.unit))
            if unit and unit.multiplier is not None:
                rows.append((node, MULTIPLIER, repr(unit.multiplier)))
        for d in cube.dims:
            node = f"{cube.name}#{d}"
            rows += [(cube.name, DIMENSION, node), (node, ID, d), (node, LABEL, cube.labels.get(d, d))]
            if d == "Periods":
                rows.append((node, TYPE, TIME))
            if d == "Region":
                rows.append((node, TYPE, GEO))
            for c in (codes or {}).get(cube.name, {}).get(d, ()):
                at = f"{node}={c}"
                rows += [(at, BROADER, node), (node, NARROWER, at), (at, ID, c)]
                if c in cube.labels:
                    rows.append((at, LABEL, cube.labels[c]))
    return spark.createDataFrame(rows, "s string, p string, o string")


def match(triples: DataFrame, predicates: str | Sequence[str], s: str = "s", o: str = "o") -> DataFrame:
    """(s, o) of triples with one of the predicates, under other names."""
    predicates = [predicates] if isinstance(predicates, str) else list(predicates)
    return triples.where(F.col("p").isin(predicates)).select(F.col("s").alias(s), F.col("o").alias(o))


def insert(triples: DataFrame, more: DataFrame) -> DataFrame:
    """Both, each triple once."""
    return triples.unionByName(more).distinct()


def members(triples: DataFrame) -> DataFrame:
    """(table, kind, node) of every measure and dimension."""
    kind = F.when(F.col("p") == MEASURE, "measure").otherwise("dimension")
    return triples.where(F.col("p").isin(MEASURE, DIMENSION)).select(F.col("s").alias("table"), kind.alias("kind"), F.col("o").alias("node"))


def children(triples: DataFrame) -> DataFrame:
    """(node, child): codes below a dimension or code, whichever direction is stated."""
    down = match(triples, NARROWER, "node", "child")
    up = match(triples, BROADER, "child", "node").select("node", "child")
    return down.unionByName(up).distinct()


def roots(triples: DataFrame) -> DataFrame:
    """(node): those with something below and nothing above."""
    below = children(triples)
    return below.select("node").distinct().join(below.select(F.col("child").alias("node")), "node", "left_anti")


def with_labels(triples: DataFrame) -> DataFrame:
    """(table, kind, node, code, label): members with their codes, and labels where there are any."""
    return (
        members(triples).join(match(triples, ID, "node", "code"), "node").join(match(triples, LABEL, "node", "label"), "node", "left")
        .select("table", "kind", "node", "code", "label")
    )


def having(triples: DataFrame, predicate: str, value: str | None = None) -> DataFrame:
    """Members for which a triple with that predicate (and object) exists."""
    hit = match(triples, predicate, "node", "o")
    hit = hit.where(F.col("o") == value) if value is not None else hit
    return members(triples).join(hit, "node", "left_semi").select("table", "kind", "node")


def table_graph(triples: DataFrame, table: str, time_geo: bool = True) -> DataFrame:
    """Measures and dimensions of a table, and codes of its dimensions: table, kind, node, code, label, parent, type, unit,
    multiplier, definition. Without time_geo, codes of time and geographic dimensions are left out."""
    own = members(triples).where(F.col("table") == table)
    types = match(triples, TYPE, "node", "type")
    dims = own.where(F.col("kind") == "dimension")
    if not time_geo:
        dims = dims.join(types.where(F.col("type").isin(TIME, GEO)), "node", "left_anti").select("table", "kind", "node")
    codes = dims.join(children(triples), "node").select("table", F.lit("code").alias("kind"), F.col("child").alias("node"), F.col("node").alias("parent"))
    every = own.withColumn("parent", F.lit(None).cast("string")).unionByName(codes)
    every = every.join(match(triples, ID, "node", "code"), "node")
    unit = match(triples, UNIT, "node", "u").join(match(triples, SYSTEM, "node", "v"), "node", "full").select("node", F.coalesce("u", "v").alias("unit"))
    more = [match(triples, LABEL, "node", "label"), types, unit, match(triples, MULTIPLIER, "node", "multiplier"), match(triples, DEFINITION, "node", "definition")]
    out = reduce(lambda a, b: a.join(b, "node", "left"), more, every)
    return out.select("table", "kind", "node", "code", "label", "parent", "type", "unit", "multiplier", "definition")


def dimension_codes(triples: DataFrame, table: str, kind: str) -> DataFrame:
    """(code, label) below a table's dimensions of a type (TIME or GEO)."""
    dims = having(triples, TYPE, kind).where(F.col("table") == table)
    below = dims.join(children(triples), "node").select(F.col("child").alias("node"))
    return below.join(match(triples, ID, "node", "code"), "node").join(match(triples, LABEL, "node", "label"), "node", "left").select("code", "label")


def titles(triples: DataFrame) -> DataFrame:
    """(table, title, description), the latter two where given."""
    out = members(triples).select("table").distinct()
    return out.join(match(triples, TITLE, "table", "title"), "table", "left").join(match(triples, DESCRIPTION, "table", "description"), "table", "left")


def explode(triples: DataFrame, nodes: Sequence[str], tables: int = 5, observations: int = 10) -> DataFrame:
    """Members of the first tables (by name) that are among nodes or contain one of them, at most `observations` each."""
    from pyspark.sql import Window as W

    every = members(triples)
    hit = every.where(F.col("table").isin(list(nodes)) | F.col("node").isin(list(nodes))).select("table").distinct()
    first = hit.orderBy("table").limit(tables)
    met = every.join(F.broadcast(first), "table", "left_semi")  # at most `tables` rows
    nth = F.row_number().over(W.partitionBy("table").orderBy("kind", "node"))
    return met.withColumn("nth", nth).where(F.col("nth") <= observations).drop("nth").select("table", "kind", "node")


def bodies(triples: DataFrame) -> DataFrame:
    """(table, body): the labels of a table's members in order, as one text per table."""
    named = with_labels(triples).where("label is not null")
    parts = F.array_sort(F.collect_list(F.struct("kind", "node", "label")))
    return named.groupBy("table").agg(F.array_join(F.transform(parts, lambda x: x["label"]), " ").alias("body"))


def units(triples: DataFrame) -> DataFrame:
    """(node, unit, scaling_of, multiplier) of measures; scaling_of is the unit itself where it isn't given; measures with
    neither unit nor multiplier are left out."""
    own = members(triples).where("kind = 'measure'").select("node")
    unit, system = match(triples, UNIT, "node", "u"), match(triples, SYSTEM, "node", "v")
    out = own.join(unit, "node", "left").join(system, "node", "left").select("node", F.coalesce("u", "v").alias("unit"))
    out = out.join(match(triples, SCALING, "unit", "base"), "unit", "left").join(match(triples, MULTIPLIER, "node", "m"), "node", "left")
    out = out.where("unit is not null or m is not null")
    return out.select("node", "unit", F.coalesce("base", "unit").alias("scaling_of"), F.col("m").cast("double").alias("multiplier"))
