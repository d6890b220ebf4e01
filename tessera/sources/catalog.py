"""Cubes and their metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.units import Unit


@dataclass
class Cube:
    """A wide table: one row per tuple of dimension codes (strings), and measures (numbers). labels: of codes, dimensions
    and measures; units: of measures."""

    name: str
    df: DataFrame
    dims: tuple[str, ...]
    measures: tuple[str, ...]
    labels: dict[str, str] = field(default_factory=dict)
    units: dict[str, Unit] = field(default_factory=dict)


class Catalog:
    """Cubes by name. Names may differ in case, as table ids do in practice. A cube may be given as a function that makes
    it, which is called when the cube is first asked for, so a query opens only the tables that it names."""

    def __init__(self, cubes: Iterable[Cube] = (), makers: dict[str, Callable[[], Cube]] | None = None):
        self._cubes = {c.name: c for c in cubes}
        self._makers = dict(makers or {})

    def add(self, cube: Cube) -> None:
        self._cubes[cube.name] = cube

    def _name(self, name: str) -> str | None:
        names = [*self._cubes, *self._makers]
        return name if name in names else next((k for k in names if k.lower() == name.lower()), None)

    def __getitem__(self, name: str) -> Cube:
        known = self._name(name)
        if known is None:
            raise KeyError(f"no cube named {name}")
        if known not in self._cubes:
            self._cubes[known] = self._makers[known]()
        return self._cubes[known]

    def __contains__(self, name: str) -> bool:
        return self._name(name) is not None

    def __iter__(self):
        return iter([self[k] for k in dict.fromkeys([*self._makers, *self._cubes])])


def cube_of(name: str, df: DataFrame, dims: Iterable[str] | None = None, measures: Iterable[str] | None = None, **given) -> Cube:
    """A cube; without dims or measures, strings are dimensions and numbers are measures."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    dims = tuple(dims) if dims is not None else tuple(n for n, t in kinds.items() if isinstance(t, T.StringType))
    measures = tuple(measures) if measures is not None else tuple(n for n, t in kinds.items() if isinstance(t, T.NumericType))
    if missing := [c for c in (*dims, *measures) if c not in kinds]:
        raise KeyError(f"{name} has no columns {missing}")
    return Cube(name, df, dims, measures, **given)


def parquet_cube(spark: SparkSession, path: str, **given) -> Cube:
    """A cube from a parquet file that is named after its table."""
    name = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")
    return cube_of(name, spark.read.parquet(path), **given)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _year(ts) -> F.Column:
    return F.concat(F.year(ts).cast("string"), F.lit("JJ00"))


def lineitem_cube(spark: SparkSession, sf_dir: str) -> Cube:
    df = _table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("ReturnFlag"), F.col("l_linestatus").alias("LineStatus"), _year("l_shipdate").alias("Periods")
    ).agg(
        F.round(F.sum("l_quantity"), 2).alias("Quantity_1"), F.round(F.sum("l_extendedprice"), 2).alias("Price_2"),
        F.round(F.sum("l_discount"), 2).alias("Discount_3"), F.count(F.lit(1)).alias("Count_4"),
    )
    units = {
        "Quantity_1": Unit("COUNT", 1.0, text="number"), "Price_2": Unit("EURO", 1.0, text="euro"),
        "Discount_3": Unit("EURO", 1000.0, text="1 000 euro"), "Count_4": Unit("COUNT", 1000.0, text="x 1 000"),
    }
    labels = {
        "ReturnFlag": "Return flag", "LineStatus": "Line status", "Periods": "Periods", "A": "Accepted", "N": "None", "R": "Returned",
        "F": "Filled", "O": "Open", "Quantity_1": "Quantity", "Price_2": "Extended price", "Discount_3": "Discount", "Count_4": "Lines",
        **{f"{y}JJ00": str(y) for y in range(1992, 2004)},
    }
    return Cube("L", df, ("ReturnFlag", "LineStatus", "Periods"), ("Quantity_1", "Price_2", "Discount_3", "Count_4"), labels, units)


def orders_cube(spark: SparkSession, sf_dir: str) -> Cube:
    df = _table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("OrderStatus"), F.col("o_orderpriority").alias("Priority"), _year("o_orderdate").alias("Periods")
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("TotalPrice_1"), F.count(F.lit(1)).alias("Orders_2"))
    units = {"TotalPrice_1": Unit("EURO", 1.0, text="euro"), "Orders_2": Unit("COUNT", 1.0, text="number")}
    labels = {"OrderStatus": "Order status", "TotalPrice_1": "Total price", "Orders_2": "Orders", "F": "Filled", "O": "Open", "P": "Pending"}
    return Cube("O", df, ("OrderStatus", "Priority", "Periods"), ("TotalPrice_1", "Orders_2"), labels, units)


def events_cube(spark: SparkSession, sf_dir: str) -> Cube:
    period = F.concat(F.year("ts").cast("string"), F.lit("MM"), F.lpad(F.month("ts").cast("string"), 2, "0"))
    df = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("EventType"), period.alias("Periods")).agg(
        F.round(F.sum("value"), 2).alias("Value_1"), F.count(F.lit(1)).alias("Events_2")
    )
    units = {"Value_1": Unit("EURO", 1.0, text="euro"), "Events_2": Unit("COUNT", 1.0, text="number")}
    return Cube("E", df, ("EventType", "Periods"), ("Value_1", "Events_2"), {"Value_1": "Value", "Events_2": "Events"}, units)


def nations_cube(spark: SparkSession, sf_dir: str) -> Cube:
    nations = F.broadcast(_table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    df = _table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("r_name").alias("Region"), F.col("c_mktsegment").alias("Segment")
    ).agg(F.round(F.sum("c_acctbal"), 2).alias("Balance_1"), F.count(F.lit(1)).alias("Customers_2"))
    units = {"Balance_1": Unit("EURO", 1.0, text="euro"), "Customers_2": Unit("COUNT", 1.0, text="number")}
    return Cube("N", df, ("Region", "Segment"), ("Balance_1", "Customers_2"), {"Balance_1": "Balance", "Customers_2": "Customers"}, units)


def driver_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The cubes of the driver's tables: lazy, so a query builds those that it names."""
    makers = {"L": lineitem_cube, "O": orders_cube, "E": events_cube, "N": nations_cube}
    return Catalog(makers={name: partial(f, spark, sf_dir) for name, f in makers.items()})
