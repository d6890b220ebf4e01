"""Registered queries of the cube engine and their SQL for DuckDB. Each query runs over whole tables; numbers are rounded
on both sides, as sums of doubles depend on their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cube as C
from tessera.operators import graph as G
from tessera.operators import metrics as M
from tessera.operators import present as P
from tessera.operators import retrieval as R
from tessera.plans.compile import run
from tessera.plans.sqlfront import run_sql
from tessera.sources.catalog import driver_catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CUBES = {
    "lc": """lc AS (SELECT l_returnflag AS ReturnFlag, l_linestatus AS LineStatus, year(l_shipdate) || 'JJ00' AS Periods,
  round(sum(l_quantity), 2) AS Quantity_1, round(sum(l_extendedprice), 2) AS Price_2, round(sum(l_discount), 2) AS Discount_3,
  count(*)::DOUBLE AS Count_4 FROM lineitem GROUP BY ALL)""",
    "oc": """oc AS (SELECT o_orderstatus AS OrderStatus, o_orderpriority AS Priority, year(o_orderdate) || 'JJ00' AS Periods,
  round(sum(o_totalprice), 2) AS TotalPrice_1, count(*)::DOUBLE AS Orders_2 FROM orders GROUP BY ALL)""",
    "ec": """ec AS (SELECT event_type AS EventType, year(ts) || 'MM' || lpad(month(ts)::VARCHAR, 2, '0') AS Periods,
  round(sum(value), 2) AS Value_1, count(*)::DOUBLE AS Events_2 FROM events GROUP BY ALL)""",
    "nc": """nc AS (SELECT r_name AS Region, c_mktsegment AS Segment, round(sum(c_acctbal), 2) AS Balance_1, count(*)::DOUBLE AS Customers_2
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)""",
}


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*(F.round(C.col(c), digits).alias(c) if t == "double" else C.col(c) for c, t in df.dtypes))


def _sql(text: str) -> str:
    """A text with the cubes that it names before it."""
    used = [c for name, c in CUBES.items() if name in text.replace("(", " ").replace(")", " ").split()]
    with_ = ", ".join(used)
    text = text.strip()
    if not used:
        return text
    return f"WITH {with_}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {with_} {text}"


def expression(name: str, text: str, mode: str, sql: str, digits: int = 2, **flags) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(run(text, driver_catalog(spark, sf_dir), mode, **flags), digits)
    SQL[name] = _sql(sql)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = _sql(sql)
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- VALUE -------------------------------------------------------------------------------------------------------------

L2 = "(DIM ReturnFlag (A R)) (DIM LineStatus (F))"
L_ALL = f"(MSR (Quantity_1 Price_2)) {L2} (DIM Periods (1996JJ00 1997JJ00))"
VALUE_L = f"(VALUE L {L_ALL})"
LONG_L = "SELECT Measure, Value, ReturnFlag, LineStatus, Periods FROM lc UNPIVOT(Value FOR Measure IN (Quantity_1, Price_2))"
FOR_L = "ReturnFlag IN ('A', 'R') LineStatus IN ('F') Periods IN ('1996JJ00', '1997JJ00')"

expression("value_pivot", VALUE_L, "pivot", f"SELECT * FROM ({LONG_L}) PIVOT(max(Value) FOR {FOR_L})")
expression("value_native_mean", VALUE_L, "native", f"SELECT * FROM ({LONG_L}) PIVOT(avg(Value) FOR {FOR_L})")
expression(
    "value_pivot_all_codes", "(VALUE L (MSR (Quantity_1)) (DIM ReturnFlag (A R)) (DIM LineStatus (F O)) (DIM Periods ()))", "pivot",
    "SELECT * FROM (SELECT Measure, Value, ReturnFlag, LineStatus, Periods FROM lc UNPIVOT(Value FOR Measure IN (Quantity_1))) PIVOT(max(Value) FOR ReturnFlag IN ('A', 'R') LineStatus IN ('F', 'O'))",
)
expression(
    "value_unmatched_code", "(VALUE L (MSR (Quantity_1)) (DIM ReturnFlag (A Z)) (DIM LineStatus (F)) (DIM Periods (1996JJ00)))", "pivot",
    "SELECT * FROM (SELECT Measure, Value, ReturnFlag, LineStatus, Periods FROM lc UNPIVOT(Value FOR Measure IN (Quantity_1))) PIVOT(max(Value) FOR ReturnFlag IN ('A', 'Z') LineStatus IN ('F') Periods IN ('1996JJ00'))",
)
for _name, _op, _least in (("lt", "<", 250), ("gt", ">", 60), ("ne", "!=", 60), ("le", "<=", 250), ("ge", ">=", 60), ("eq", "=", 150)):
    expression(
        f"value_pivot_filter_{_name}", f"(VALUE O (MSR (Orders_2 {_op} {_least})) (DIM OrderStatus (F O P)) (DIM Priority (1-URGENT 5-LOW)) (DIM Periods ()))", "pivot",
        f"SELECT * FROM (SELECT Measure, Value, OrderStatus, Priority, Periods FROM oc UNPIVOT(Value FOR Measure IN (Orders_2)) WHERE Value {_op} {_least}) PIVOT(max(Value) FOR OrderStatus IN ('F', 'O', 'P') Priority IN ('1-URGENT', '5-LOW'))",
    )
expression(
    "value_simplified", VALUE_L, "simplified",
    "SELECT ReturnFlag, LineStatus, Periods, Quantity_1, Price_2 FROM lc WHERE ReturnFlag IN ('A', 'R') AND LineStatus IN ('F') AND Periods IN ('1996JJ00', '1997JJ00')",
)
expression(
    "value_simplified_filter", "(VALUE E (MSR (Value_1 >= 1000)) (DIM EventType ()) (DIM Periods ()))", "simplified",
    "SELECT EventType, Periods, Value_1 FROM ec WHERE Value_1 >= 1000",
)


@query("value_long", "SELECT EventType, Periods, Measure, Value FROM ec UNPIVOT(Value FOR Measure IN (Value_1, Events_2))")
def value_long(spark, sf_dir):
    cube = driver_catalog(spark, sf_dir)["E"]
    return rounded(C.long_form(cube.df, cube.dims, cube.measures))


# -- SUM, AVG, MIN, MAX ------------------------------------------------------------------------------------------------

INNER_L = "SELECT Value, ReturnFlag, LineStatus, Periods FROM lc UNPIVOT(Value FOR Measure IN (Price_2, Discount_3))"
MSR_L = f"(VALUE L (MSR (Quantity_1 Count_4)) {L2} (DIM Periods (1996JJ00 1997JJ00)))"
INNER_Q = "SELECT Value, ReturnFlag, LineStatus, Periods FROM lc UNPIVOT(Value FOR Measure IN (Quantity_1, Count_4))"
N_VAL = "(VALUE N (MSR (Balance_1 Customers_2)) (DIM Region (ASIA EUROPE)) (DIM Segment (BUILDING MACHINERY)))"
N_WHERE = "WHERE Region IN ('ASIA', 'EUROPE') AND Segment IN ('BUILDING', 'MACHINERY')"
N_LONG = "SELECT Measure, Value, Region, Segment FROM nc UNPIVOT(Value FOR Measure IN (Balance_1, Customers_2))"
N_FOR = "Region IN ('ASIA', 'EUROPE') Segment IN ('BUILDING', 'MACHINERY')"
O_VAL = "(VALUE O (MSR (TotalPrice_1)) (DIM OrderStatus (F O P)) (DIM Priority (1-URGENT 2-HIGH)) (DIM Periods (1996JJ00 1997JJ00 1998JJ00)))"
O_LONG = "SELECT Measure, Value, OrderStatus, Priority, Periods FROM oc UNPIVOT(Value FOR Measure IN (TotalPrice_1))"
O_WHERE = "OrderStatus IN ('F', 'O', 'P') AND Priority IN ('1-URGENT', '2-HIGH') AND Periods IN ('1996JJ00', '1997JJ00', '1998JJ00')"
O_FOR = "OrderStatus IN ('F', 'O', 'P') Priority IN ('1-URGENT', '2-HIGH')"

for _op in ("SUM", "AVG", "MIN", "MAX"):
    expression(
        f"{_op.lower()}_msr_pivot", f"({_op} () {N_VAL})", "pivot",
        f"SELECT * REPLACE ({', '.join(f'round({c}, 2) AS {c}' for c in ('ASIA_BUILDING', 'ASIA_MACHINERY', 'EUROPE_BUILDING', 'EUROPE_MACHINERY'))}), 'Balance_1;Customers_2' AS Measure FROM (SELECT Value, Region, Segment FROM ({N_LONG})) PIVOT({_op}(Value) FOR {N_FOR})",
        check_units=False,
    )
    expression(
        f"{_op.lower()}_dim", f"({_op} (Periods) {O_VAL})", "pivot",
        f"SELECT Measure, {', '.join(f'round({chr(34)}{a}_{b}{chr(34)}, 2) AS {chr(34)}{a}_{b}{chr(34)}' for a in 'FOP' for b in ('1-URGENT', '2-HIGH'))} FROM ({O_LONG} WHERE Periods IN ('1996JJ00', '1997JJ00', '1998JJ00')) PIVOT({_op}(Value) FOR {O_FOR} GROUP BY Measure)",
    )
    expression(
        f"aggjoin_{_op.lower()}", f"({_op} () (JOIN (TotalPrice_1) (VALUE O (MSR (TotalPrice_1)) (DIM OrderStatus (F O)) (DIM Periods (1996JJ00)) (DIM Priority (1-URGENT))) (VALUE O (MSR (TotalPrice_1)) (DIM OrderStatus (P)) (DIM Periods (1997JJ00)) (DIM Priority (2-HIGH 3-MEDIUM)))))", "pivot",
        f"SELECT Measure, round({_op}(Value), 2) AS {_op} FROM ({O_LONG} WHERE (OrderStatus IN ('F', 'O') AND Periods = '1996JJ00' AND Priority = '1-URGENT') OR (OrderStatus = 'P' AND Periods = '1997JJ00' AND Priority IN ('2-HIGH', '3-MEDIUM'))) GROUP BY Measure",
    )
for _op in ("SUM", "AVG"):
    expression(
        f"{_op.lower()}_msr_simplified", f"({_op} () {N_VAL})", "simplified",
        f"SELECT Region, Segment, round({_op}(Balance_1 + Customers_2), 2) AS {_op} FROM nc {N_WHERE} GROUP BY ALL", check_units=False,
    )
    expression(
        f"{_op.lower()}_dim_simplified", f"({_op} (Periods) {O_VAL})", "simplified",
        f"SELECT OrderStatus, Priority, Periods, round({_op}(TotalPrice_1), 2) AS {_op} FROM oc WHERE {O_WHERE} GROUP BY ALL",
    )
    expression(
        f"{_op.lower()}_dim_native", f"({_op} (Periods) {O_VAL})", "native",
        f"SELECT Measure, OrderStatus, Priority, round({_op}(Value), 2) AS \"{_op}[Periods]\" FROM ({O_LONG} WHERE {O_WHERE}) GROUP BY ALL",
    )
expression(
    "sum_msr_scaled", f"(SUM () (VALUE L (MSR (Price_2 Discount_3)) {L2} (DIM Periods (1996JJ00 1997JJ00))))", "native",
    "SELECT ReturnFlag, LineStatus, Periods, round(sum(CASE WHEN Measure = 'Discount_3' THEN Value * 1000 ELSE Value END), 2) AS SUM, 'Price_2' || chr(10) || 'Discount_3' AS Measure, 'number' AS Unit FROM (SELECT * FROM lc UNPIVOT(Value FOR Measure IN (Price_2, Discount_3))) WHERE ReturnFlag IN ('A', 'R') AND LineStatus = 'F' AND Periods IN ('1996JJ00', '1997JJ00') GROUP BY ALL",
)
expression(
    "sum_single_dim", "(SUM (Region) (VALUE N (MSR (Balance_1)) (DIM Region (ASIA AFRICA EUROPE))))", "pivot",
    "SELECT 'Balance_1' AS Measure, round(sum(Balance_1), 2) AS Balance_1 FROM nc WHERE Region IN ('ASIA', 'AFRICA', 'EUROPE')",
)
expression(
    "avg_single_measure_native", "(AVG () (VALUE N (MSR (Balance_1)) (DIM Region (ASIA EUROPE)) (DIM Segment ())))", "native",
    "SELECT 'Balance_1' AS Measure, round(avg(Balance_1), 2) AS AVG FROM nc WHERE Region IN ('ASIA', 'EUROPE')",
)
for _op, _fn in (("MIN", "arg_min"), ("MAX", "arg_max")):
    expression(
        f"arg{_op.lower()}_dim", f"({_op} (Periods) (VALUE O (MSR (TotalPrice_1 Orders_2)) (DIM OrderStatus (F O P)) (DIM Priority ()) (DIM Periods ())))", "native",
        f"SELECT Measure, OrderStatus, Priority, {_fn}(Periods, row(Value, Periods)) AS Periods, round({_op}(Value), 2) AS Value FROM (SELECT * FROM oc UNPIVOT(Value FOR Measure IN (TotalPrice_1, Orders_2))) WHERE OrderStatus IN ('F', 'O', 'P') GROUP BY Measure, OrderStatus, Priority",
    )
    expression(
        f"arg{_op.lower()}_msr", f"({_op} () {MSR_L})", "native",
        f"SELECT ReturnFlag, LineStatus, Periods, {_fn}(Measure, row(v, Measure)) AS Measure, round({_op}(v), 2) AS Value, 'number' AS Unit FROM (SELECT *, CASE WHEN Measure = 'Count_4' THEN Value * 1000 ELSE Value END AS v FROM (SELECT * FROM lc UNPIVOT(Value FOR Measure IN (Quantity_1, Count_4)))) WHERE ReturnFlag IN ('A', 'R') AND LineStatus = 'F' AND Periods IN ('1996JJ00', '1997JJ00') GROUP BY ReturnFlag, LineStatus, Periods",
    )
    _way = "DESC" if _op == "MAX" else "ASC"
    expression(
        f"{_op.lower()}_rank", f"({_op} (Periods) {O_VAL})", "simplified",
        f"SELECT rnk, TotalPrice_1, OrderStatus, Priority, Periods AS \"{_op}[Periods]\" FROM (SELECT *, rank() OVER (ORDER BY TotalPrice_1 {_way} NULLS LAST) AS rnk FROM oc WHERE {O_WHERE}) WHERE rnk = 1",
    )
    expression(
        f"{_op.lower()}_rank_msr", f"({_op} () {N_VAL})", "simplified",
        f"SELECT rnk, Measure, Region, Segment, Value AS \"{_op}[Value]\" FROM (SELECT *, rank() OVER (ORDER BY Value {_way} NULLS LAST) AS rnk FROM ({N_LONG} {N_WHERE})) WHERE rnk = 1",
        check_units=False,
    )


@query("max_rank_ties", "SELECT rnk, EventType, least(Events_2, 3) AS Events_2 FROM (SELECT EventType, Events_2, rank() OVER (ORDER BY least(Events_2, 3) DESC NULLS LAST) AS rnk FROM ec) WHERE rnk = 1")
def max_rank_ties(spark, sf_dir):
    cube = driver_catalog(spark, sf_dir)["E"]
    df = cube.df.select("EventType", F.least(F.col("Events_2").cast("double"), F.lit(3.0)).alias("Events_2"))
    return C.rank_first(df, "Events_2", "MAX").select("rnk", "EventType", "Events_2")


# -- PROP and JOIN -----------------------------------------------------------------------------------------------------


def _prop_sql(codes: list[str], where: str, key: str, long: str, group: str, digits: str = "round({}, 2)") -> str:
    listed = ", ".join(f"'{c}'" for c in codes)
    part = f"sum(CASE WHEN {group} IN ({listed}) THEN Value ELSE 0 END)"
    return f"""SELECT {key} AS Dimension_Measure, round(sum(Value), 2) AS "SUM[{group}]", round({part}, 2) AS "{'_'.join(codes)}", round({part} * 100.0 / nullif(sum(Value), 0), 2) AS "%" FROM ({long}) WHERE {where} GROUP BY Dimension_Measure"""


O_KEY = "concat_ws(', ', Measure, OrderStatus, Priority)"
expression("prop_single", f"(PROP (DIM Periods (1996JJ00)) {O_VAL})", "pivot", _prop_sql(["1996JJ00"], O_WHERE, O_KEY, O_LONG, "Periods"))
expression("prop_multi_codes", f"(PROP (DIM Periods (1996JJ00 1997JJ00)) {O_VAL})", "simplified", _prop_sql(["1996JJ00", "1997JJ00"], O_WHERE, O_KEY, O_LONG, "Periods"))
expression(
    "prop_with_filter", "(PROP (DIM Periods (1997JJ00)) (VALUE O (MSR (Orders_2 > 50)) (DIM OrderStatus (F O P)) (DIM Priority (1-URGENT 2-HIGH)) (DIM Periods (1996JJ00 1997JJ00 1998JJ00))))", "pivot",
    _prop_sql(["1997JJ00"], f"{O_WHERE} AND Value > 50", O_KEY, O_LONG.replace("TotalPrice_1", "Orders_2"), "Periods"),
)
expression(
    "prop_native_unrounded", f"(PROP (DIM Periods (1996JJ00)) {O_VAL})", "native",
    f"SELECT Measure, OrderStatus, Priority, round(sum(Value), 2) AS total, round(sum(CASE WHEN Periods = '1996JJ00' THEN Value ELSE 0 END), 2) AS \"1996JJ00\", round(sum(CASE WHEN Periods = '1996JJ00' THEN Value ELSE 0 END) * 100.0 / nullif(sum(Value), 0), 2) AS \"%\" FROM ({O_LONG} WHERE {O_WHERE}) GROUP BY ALL",
)

PERIODS3 = "(DIM Periods (1996JJ00 1997JJ00 1998JJ00 1999JJ00))"
JOIN_DIM = f"(JOIN (Periods) (VALUE L (MSR (Quantity_1)) {PERIODS3} (DIM ReturnFlag (A)) (DIM LineStatus (F))) (VALUE O (MSR (TotalPrice_1)) (DIM Periods (1997JJ00 1998JJ00 2005JJ00)) (DIM OrderStatus (F)) (DIM Priority (1-URGENT))))"
P4 = "('1996JJ00', '1997JJ00', '1998JJ00', '1999JJ00')"
JA = f"SELECT Periods, max(Quantity_1) FILTER (ReturnFlag = 'A' AND LineStatus = 'F') AS A_F FROM lc WHERE Periods IN {P4} GROUP BY Periods"
JB = "SELECT Periods, max(TotalPrice_1) FILTER (OrderStatus = 'F' AND Priority = '1-URGENT') AS \"F_1-URGENT\" FROM oc WHERE Periods IN ('1997JJ00', '1998JJ00', '2005JJ00') GROUP BY Periods"
expression("join_dim", JOIN_DIM, "pivot", f"SELECT coalesce(a.Periods, b.Periods) AS Periods, A_F, \"F_1-URGENT\" FROM ({JA}) a FULL JOIN ({JB}) b ON a.Periods = b.Periods")
expression(
    "join_multi_dim",
    "(JOIN (Periods OrderStatus) (VALUE O (MSR (TotalPrice_1)) (DIM Periods (1996JJ00 1997JJ00)) (DIM OrderStatus (F O)) (DIM Priority (1-URGENT))) (VALUE O (MSR (Orders_2)) (DIM Periods (1997JJ00 1998JJ00)) (DIM OrderStatus (F O)) (DIM Priority (2-HIGH))))", "pivot",
    "SELECT concat_ws(', ', coalesce(a.p, b.p), coalesce(a.s, b.s)) AS Dimension_Measure, \"1-URGENT\", \"2-HIGH\" FROM (SELECT Periods AS p, OrderStatus AS s, max(TotalPrice_1) FILTER (Priority = '1-URGENT') AS \"1-URGENT\" FROM oc WHERE Periods IN ('1996JJ00', '1997JJ00') AND OrderStatus IN ('F', 'O') GROUP BY ALL) a FULL JOIN (SELECT Periods AS p, OrderStatus AS s, max(Orders_2) FILTER (Priority = '2-HIGH') AS \"2-HIGH\" FROM oc WHERE Periods IN ('1997JJ00', '1998JJ00') AND OrderStatus IN ('F', 'O') GROUP BY ALL) b ON a.p = b.p AND a.s = b.s",
)
expression(
    "join_measure", "(JOIN (TotalPrice_1) (VALUE O (MSR (TotalPrice_1)) (DIM OrderStatus (F)) (DIM Priority (1-URGENT)) (DIM Periods (1996JJ00 1997JJ00))) (VALUE O (MSR (TotalPrice_1)) (DIM OrderStatus (O)) (DIM Priority (1-URGENT)) (DIM Periods (1996JJ00 1997JJ00))))", "pivot",
    f"SELECT * FROM (SELECT * FROM ({O_LONG}) PIVOT(max(Value) FOR OrderStatus IN ('F') Priority IN ('1-URGENT') Periods IN ('1996JJ00', '1997JJ00'))) a FULL JOIN (SELECT * FROM ({O_LONG}) PIVOT(max(Value) FOR OrderStatus IN ('O') Priority IN ('1-URGENT') Periods IN ('1996JJ00', '1997JJ00'))) b USING (Measure)",
)
expression(
    "join_three_way",
    f"(JOIN (Periods) (VALUE L (MSR (Quantity_1)) {PERIODS3} (DIM ReturnFlag (A)) (DIM LineStatus (F))) (VALUE L (MSR (Price_2)) (DIM Periods (1997JJ00)) (DIM ReturnFlag (N)) (DIM LineStatus (F))) (VALUE O (MSR (TotalPrice_1)) (DIM Periods (1997JJ00 2005JJ00)) (DIM OrderStatus (F)) (DIM Priority (1-URGENT))))", "pivot",
    f"SELECT coalesce(a.Periods, b.Periods, c.Periods) AS Periods, A_F, N_F, \"F_1-URGENT\" FROM ({JA}) a FULL JOIN (SELECT Periods, max(Price_2) FILTER (ReturnFlag = 'N' AND LineStatus = 'F') AS N_F FROM lc WHERE Periods = '1997JJ00' GROUP BY Periods) b ON a.Periods = b.Periods FULL JOIN ({JB.replace(', ' + chr(39) + '1998JJ00' + chr(39), '')}) c ON coalesce(a.Periods, b.Periods) = c.Periods",
)
expression(
    "join_simplified", JOIN_DIM, "simplified",
    f"SELECT coalesce(a.Periods, b.Periods) AS Periods, a.Quantity_1, b.TotalPrice_1, a.ReturnFlag, a.LineStatus, b.OrderStatus, b.Priority FROM (SELECT * FROM lc WHERE Periods IN {P4} AND ReturnFlag = 'A' AND LineStatus = 'F') a FULL JOIN (SELECT * FROM oc WHERE Periods IN ('1997JJ00', '1998JJ00', '2005JJ00') AND OrderStatus = 'F' AND Priority = '1-URGENT') b ON a.Periods = b.Periods",
)
expression(
    "aggjoin_simplified", "(AVG () (JOIN (Orders_2) (VALUE O (MSR (Orders_2)) (DIM OrderStatus (F)) (DIM Periods ())) (VALUE O (MSR (Orders_2)) (DIM Priority (1-URGENT)) (DIM OrderStatus ()))))", "simplified",
    "SELECT 'Orders_2' AS Measure, round(avg(coalesce(a.Orders_2, b.Orders_2)), 2) AS AVG FROM (SELECT * FROM oc WHERE OrderStatus = 'F') a FULL JOIN (SELECT * FROM oc WHERE Priority = '1-URGENT') b ON a.OrderStatus = b.OrderStatus AND a.Orders_2 = b.Orders_2",
)
expression(
    "join_native", JOIN_DIM, "native",
    f"SELECT coalesce(a.Periods, b.Periods) AS Periods, A_F AS A_F_Quantity_1, \"F_1-URGENT\" AS \"F_1-URGENT_TotalPrice_1\" FROM ({JA}) a FULL JOIN ({JB}) b ON a.Periods = b.Periods",
)

# -- SQL texts ---------------------------------------------------------------------------------------------------------


def text_query(name: str, text: str, sql: str, digits: int = 2) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(run_sql(text, spark, driver_catalog(spark, sf_dir)), digits)
    SQL[name] = _sql(sql)


_row_number = "SELECT OrderStatus, Periods, TotalPrice_1 FROM (SELECT OrderStatus, Periods, TotalPrice_1, CAST(ROW_NUMBER() OVER (PARTITION BY OrderStatus ORDER BY TotalPrice_1 DESC, Periods) AS BIGINT) AS rn FROM {} WHERE Priority = '1-URGENT') AS t WHERE rn = 1"
text_query("sql_row_number", _row_number.format("'data/O.parquet'"), _row_number.format("oc"))
_limit = "SELECT Region, Segment, Balance_1 FROM {} ORDER BY Balance_1 DESC, Region, Segment LIMIT 1"
text_query("sql_order_limit", _limit.format("'data/N.parquet'"), _limit.format("nc"))
_case = "SELECT Periods, ROUND(MAX(CASE WHEN ReturnFlag = 'A' THEN Quantity_1 END), 2) AS \"A\", ROUND(MAX(CASE WHEN ReturnFlag = 'R' THEN Quantity_1 END), 2) AS \"R\" FROM {} WHERE LineStatus = 'F' GROUP BY Periods"
text_query("sql_case_pivot", _case.format("'L.parquet'"), _case.format("lc"))
_concat = "SELECT CONCAT_WS(', ', EventType, Periods) AS Dimension_Measure, ROUND(SUM(Value_1), 2) AS {} FROM {} GROUP BY CONCAT_WS(', ', EventType, Periods)"
text_query("sql_concat_ws", _concat.format("'SUM'", "'E.parquet'"), _concat.format('"SUM"', "ec"))
for _word in ("UNION", "INTERSECT"):
    _set = f"SELECT Periods FROM {{}} {_word} SELECT Periods FROM {{}}"
    text_query(f"sql_{_word.lower()}", _set.format("'L.parquet'", "'O.parquet'"), _set.format("lc", "oc"))
_set = "SELECT Periods FROM {} EXCEPT SELECT Periods FROM {}"
text_query("sql_except", _set.format("'E.parquet'", "'O.parquet'"), _set.format("ec", "oc"))
text_query(
    "sql_pivot", "SELECT * FROM (SELECT Measure, Value, ReturnFlag, LineStatus, Periods FROM 'L.parquet' UNPIVOT(Value FOR Measure IN ('Quantity_1', \"Price_2\"))) PIVOT(MAX(Value) FOR ReturnFlag IN ('A', 'R') LineStatus IN ('F') Periods IN ('1996JJ00', '1997JJ00'))",
    f"SELECT * FROM ({LONG_L}) PIVOT(max(Value) FOR {FOR_L})",
)
text_query(
    "sql_pivot_group_by", "SELECT * FROM (SELECT Measure, Value, Region, Segment FROM 'N.parquet' UNPIVOT(Value FOR Measure IN (Balance_1, Customers_2)) WHERE Region IN ('ASIA', 'EUROPE')) PIVOT(SUM(Value) FOR Segment IN ('BUILDING', 'MACHINERY') GROUP BY Measure)",
    f"SELECT Measure, round(sum(Value) FILTER (Segment = 'BUILDING'), 2) AS BUILDING, round(sum(Value) FILTER (Segment = 'MACHINERY'), 2) AS MACHINERY FROM ({N_LONG} WHERE Region IN ('ASIA', 'EUROPE')) GROUP BY Measure",
)
text_query(
    "sql_columns", "SELECT name, ROUND(SUM(Value), 2) AS 'SUM' FROM (SELECT Region, Segment, Balance_1, Customers_2 FROM 'N.parquet') UNPIVOT(Value FOR name IN (COLUMNS(c -> contains(c, '_')))) GROUP BY name",
    'SELECT Measure AS name, round(sum(Value), 2) AS "SUM" FROM (' + N_LONG + ") GROUP BY Measure",
)

# -- shaping -----------------------------------------------------------------------------------------------------------


@query("present_units", f"SELECT Measure, CASE Measure WHEN 'Quantity_1' THEN 'number' ELSE 'euro' END AS Unit, COLUMNS(* EXCLUDE (Measure)) FROM ({LONG_L}) PIVOT(max(Value) FOR {FOR_L})")
def present_units(spark, sf_dir):
    catalog = driver_catalog(spark, sf_dir)
    return rounded(P.with_units(run(VALUE_L, catalog, "pivot"), catalog["L"].units))


@query("present_labels", "SELECT CASE ReturnFlag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' ELSE 'None' END AS ReturnFlag, CASE LineStatus WHEN 'F' THEN 'Filled' ELSE 'Open' END AS LineStatus, left(Periods, 4) AS Periods, Quantity_1 FROM lc")
def present_labels(spark, sf_dir):
    cube = driver_catalog(spark, sf_dir)["L"]
    df = cube.df.select("ReturnFlag", "LineStatus", "Periods", "Quantity_1")
    return rounded(P.label_cells(df, ["ReturnFlag", "LineStatus", "Periods"], cube.labels))


@query("present_drop_null_cols", f"SELECT Measure, A_F_1996JJ00 FROM ({LONG_L}) PIVOT(max(Value) FOR ReturnFlag IN ('A') LineStatus IN ('F') Periods IN ('1996JJ00'))")
def present_drop_null_cols(spark, sf_dir):
    text = "(VALUE L (MSR (Quantity_1 Price_2)) (DIM ReturnFlag (A Z)) (DIM LineStatus (F)) (DIM Periods (1996JJ00)))"
    return rounded(P.drop_null_columns(run(text, driver_catalog(spark, sf_dir), "pivot")))


@query("present_all", f"SELECT CASE Measure WHEN 'Quantity_1' THEN 'Quantity' ELSE 'Extended price' END AS Measure, CASE Measure WHEN 'Quantity_1' THEN 'number' ELSE 'euro' END AS Unit, " + ", ".join(f'{a}_F_{y}JJ00 AS "{a}_F | {y}JJ00"' for a in "AR" for y in (1996, 1997)) + f" FROM ({LONG_L}) PIVOT(max(Value) FOR {FOR_L})")
def present_all(spark, sf_dir):
    catalog = driver_catalog(spark, sf_dir)
    cube = catalog["L"]
    labels = {m: cube.labels[m] for m in cube.measures}
    return rounded(P.present(run(VALUE_L, catalog, "pivot"), cube.units, labels))


@query("unit_lookup", """SELECT * FROM (VALUES ('L', 'Count_4', 'COUNT', 'COUNT', 1000.0::DOUBLE), ('L', 'Discount_3', 'EURO', 'EURO', 1000.0), ('L', 'Price_2', 'EURO', 'EURO', 1.0), ('L', 'Quantity_1', 'COUNT', 'COUNT', 1.0)) t("table", code, unit, scaling_of, multiplier)""")
def unit_lookup(spark, sf_dir):
    parts = F.split("node", "#")
    units = G.units(_triples(spark, sf_dir)).select(parts[0].alias("table"), parts[1].alias("code"), "unit", "scaling_of", "multiplier")
    return units.where(F.col("table") == "L")


# -- graph -------------------------------------------------------------------------------------------------------------

CODES = {
    "L": {"ReturnFlag": ["A", "N", "R"], "LineStatus": ["F", "O"], "Periods": [f"{y}JJ00" for y in range(1995, 2002)]},
    "O": {"OrderStatus": ["F", "O", "P"]},
    "N": {"Region": ["AFRICA", "ASIA", "EUROPE"]},
}
_MEMBERS = """(VALUES ('L', 'measure', 'Quantity_1'), ('L', 'measure', 'Price_2'), ('L', 'measure', 'Discount_3'), ('L', 'measure', 'Count_4'),
 ('L', 'dimension', 'ReturnFlag'), ('L', 'dimension', 'LineStatus'), ('L', 'dimension', 'Periods'), ('O', 'measure', 'TotalPrice_1'), ('O', 'measure', 'Orders_2'),
 ('O', 'dimension', 'OrderStatus'), ('O', 'dimension', 'Priority'), ('O', 'dimension', 'Periods'), ('E', 'measure', 'Value_1'), ('E', 'measure', 'Events_2'),
 ('E', 'dimension', 'EventType'), ('E', 'dimension', 'Periods'), ('N', 'measure', 'Balance_1'), ('N', 'measure', 'Customers_2'), ('N', 'dimension', 'Region'), ('N', 'dimension', 'Segment')) m("table", kind, code)"""
_LABELS = "CASE code " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in {
    "Quantity_1": "Quantity", "Price_2": "Extended price", "Discount_3": "Discount", "Count_4": "Lines", "ReturnFlag": "Return flag", "LineStatus": "Line status",
    "TotalPrice_1": "Total price", "Orders_2": "Orders", "OrderStatus": "Order status", "Value_1": "Value", "Events_2": "Events", "Balance_1": "Balance", "Customers_2": "Customers",
}.items()) + " ELSE code END"
_CODES = "(VALUES " + ", ".join(f"('{t}#{d}', '{t}#{d}={c}')" for t, ds in CODES.items() for d, cs in ds.items() for c in cs) + ") c(node, child)"


def _triples(spark, sf_dir):
    return G.triples_of(spark, driver_catalog(spark, sf_dir), CODES)


@query("graph_table_members", f"""SELECT "table", kind, "table" || '#' || code AS node FROM {_MEMBERS}""")
def graph_table_members(spark, sf_dir):
    return G.members(_triples(spark, sf_dir))


@query("graph_hierarchy_children", f"SELECT * FROM {_CODES}")
def graph_hierarchy_children(spark, sf_dir):
    return G.children(_triples(spark, sf_dir))


@query("graph_roots", f"SELECT DISTINCT node FROM {_CODES}")
def graph_roots(spark, sf_dir):
    return G.roots(_triples(spark, sf_dir))


@query("graph_labels_left", f"""SELECT "table", kind, "table" || '#' || code AS node, code, {_LABELS} AS label FROM {_MEMBERS}""")
def graph_labels_left(spark, sf_dir):
    return G.with_labels(_triples(spark, sf_dir))


@query("graph_exists_semi", f"""SELECT "table", kind, "table" || '#' || code AS node FROM {_MEMBERS} WHERE code = 'Periods'""")
def graph_exists_semi(spark, sf_dir):
    return G.having(_triples(spark, sf_dir), G.TYPE, G.TIME)


@query("graph_node_body", f"""SELECT "table", string_agg({_LABELS}, ' ' ORDER BY kind, "table" || '#' || code) AS body FROM {_MEMBERS} GROUP BY "table" """)
def graph_node_body(spark, sf_dir):
    return G.bodies(_triples(spark, sf_dir))


@query("graph_time_codes", "SELECT y || 'JJ00' AS code, y::VARCHAR AS label FROM range(1995, 2002) t(y)")
def graph_time_codes(spark, sf_dir):
    return G.dimension_codes(_triples(spark, sf_dir), "L", G.TIME)


@query("graph_titles", """SELECT * FROM (VALUES ('L', 'Table L', 'Cube L of 4 measures'), ('O', 'Table O', 'Cube O of 2 measures'), ('E', 'Table E', 'Cube E of 2 measures'), ('N', 'Table N', 'Cube N of 2 measures')) t("table", title, description)""")
def graph_titles(spark, sf_dir):
    return G.titles(_triples(spark, sf_dir))


@query("graph_explode", f"""SELECT "table", kind, "table" || '#' || code AS node FROM {_MEMBERS} WHERE "table" IN ('L', 'O')""")
def graph_explode(spark, sf_dir):
    return G.explode(_triples(spark, sf_dir), ["L#Price_2", "O"])


@query("graph_table", f"""WITH m AS (SELECT kind, 'O#' || code AS node, code, {_LABELS} AS label FROM {_MEMBERS} WHERE "table" = 'O')
SELECT 'O' AS "table", kind, node, code, label, NULL::VARCHAR AS parent, CASE code WHEN 'Periods' THEN 'TimeDimension' END AS type,
 CASE code WHEN 'TotalPrice_1' THEN 'EURO' WHEN 'Orders_2' THEN 'COUNT' END AS unit, CASE kind WHEN 'measure' THEN '1.0' END AS multiplier, NULL::VARCHAR AS definition FROM m
UNION ALL SELECT 'O', 'code', 'O#OrderStatus=' || c, c, l, 'O#OrderStatus', NULL, NULL, NULL, NULL FROM (VALUES ('F', 'Filled'), ('O', 'Open'), ('P', 'Pending')) t(c, l)""")
def graph_table(spark, sf_dir):
    return G.table_graph(_triples(spark, sf_dir), "O")


# -- retrieval ---------------------------------------------------------------------------------------------------------

_TOK = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS["en"])


@query("tokenize_df", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term")
def tokenize_df(spark, sf_dir):
    terms = R.term_counts(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


_BM25 = f"""WITH t AS (SELECT doc_id AS id, {_TOK.format('text')} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM t),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM t) GROUP BY ALL),
q AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
i AS (SELECT term, ln((s.n + 1) / count(*)) AS idf FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, s.n),
f AS (SELECT qid, sum(times * idf) AS flr FROM q JOIN i USING (term) GROUP BY qid),
o AS (SELECT qid, tf.id, sum(times * idf * tf * 2.5 / (1.5 * (0.25 + 0.75 * len(t.ws) / s.avgdl) + tf)) AS own FROM tf JOIN q USING (term) JOIN i USING (term) JOIN t ON t.id = tf.id, s GROUP BY qid, tf.id),
b AS (SELECT qid, id, round(own + flr, 4) AS score FROM o JOIN f USING (qid) WHERE own + flr > 0)"""


def _bm25(spark, sf_dir):
    docs, asked = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return rounded(R.bm25(docs, asked, "doc_id", "text", "item_id", "text"), 4)


@query("bm25_scores", f"{_BM25} SELECT qid, count(*) AS n, round(sum(score), 1) AS total, round(max(score), 2) AS best FROM b GROUP BY qid")
def bm25_scores(spark, sf_dir):
    out = _bm25(spark, sf_dir).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.max("score").alias("best"))
    return out.select("qid", "n", F.round("total", 1).alias("total"), F.round("best", 2).alias("best"))


@query("bm25_topk", f"{_BM25} SELECT qid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    return R.top_k(_bm25(spark, sf_dir), 5).select("qid", "id", "rank")


@query("score_fusion", """WITH n AS (SELECT l_orderkey % 50 AS qid, 't' || (l_partkey % 7) AS "table", l_discount AS score FROM lineitem),
t AS (SELECT DISTINCT o_orderkey % 50 AS qid, 't' || (o_custkey % 9) AS "table", 1.0::DOUBLE AS own FROM orders),
m AS (SELECT qid, "table", avg(score) AS nodes FROM n WHERE score >= 0.01 GROUP BY ALL)
SELECT qid, "table", round(coalesce(own, 0) + 0.8 * coalesce(nodes, 0), 4) AS score FROM t FULL JOIN m USING (qid, "table")""")
def score_fusion(spark, sf_dir):
    items, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    table = lambda c, n: F.concat(F.lit("t"), (F.col(c) % n).cast("string"))
    nodes = items.select((F.col("l_orderkey") % 50).alias("qid"), F.concat(table("l_partkey", 7), F.lit("#x")).alias("id"), F.col("l_discount").alias("score"))
    tables = orders.select((F.col("o_orderkey") % 50).alias("qid"), table("o_custkey", 9).alias("id")).distinct().withColumn("score", F.lit(1.0))
    return rounded(R.fuse(tables, nodes), 4)


_COS = "SELECT q.vec_id AS qid, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0"


def _cosines(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return rounded(R.cosine_pairs(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding"), 4)


@query("cosine_topk", f"SELECT qid, id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({_COS})) WHERE rank <= 5")
def cosine_topk(spark, sf_dir):
    return R.top_k(_cosines(spark, sf_dir), 5)


@query("hard_negatives", f"""WITH r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({_COS}))
SELECT qid, id, nth FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS nth FROM r WHERE rank <= 40 AND id % 3 <> 0) WHERE nth <= 5""")
def hard_negatives(spark, sf_dir):
    ranked = R.top_k(_cosines(spark, sf_dir), 40)
    return R.hard_negatives(ranked, ranked.where("id % 3 = 0"), 5)


@query("alternating_negatives", f"""WITH r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS hi, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS lo FROM ({_COS}) WHERE score < 0.95)
SELECT qid, id, nth FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN hi <= lo THEN 2 * hi - 1 ELSE 2 * lo END, id) AS nth FROM r) WHERE nth <= 6""")
def alternating_negatives(spark, sf_dir):
    return R.alternating(_cosines(spark, sf_dir), 6)


def _halves_sql() -> str:
    dots = [[f"list_inner_product(q.embedding[{a}]::DOUBLE[], v.embedding[{b}]::DOUBLE[])" for b in ("1:32", "33:64")] for a in ("1:32", "33:64")]
    return " + ".join(f"greatest({', '.join(d)})" for d in dots)


@query("max_sim", f"SELECT q.vec_id AS qid, v.vec_id AS id, round({_halves_sql()}, 4) AS score FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0")
def max_sim(spark, sf_dir):
    halves = F.array(F.slice("e", 1, 32), F.slice("e", 33, 32))
    v = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("l"), halves.alias("q"))
    met = v.join(q, F.col("label") == F.col("l"))
    return met.select("qid", F.col("vec_id").alias("id"), F.round(R.max_sim(F.col("q"), halves), 4).alias("score"))


@query("group_split", "SELECT o_orderkey, o_custkey, CASE WHEN ('0x' || substr(md5(o_custkey || ':42'), 1, 8))::BIGINT % 10000 / 10000.0 < 0.1 THEN 'test' ELSE 'train' END AS fold FROM orders")
def group_split(spark, sf_dir):
    return R.group_split(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query("enriched_body", f"""WITH m AS (SELECT *, "table" || '#' || code AS node, {_LABELS} AS label FROM {_MEMBERS}),
k AS (SELECT "table", string_agg(label, ', ' ORDER BY node) FILTER (kind = 'measure') AS ms, string_agg(label, ', ' ORDER BY node) FILTER (kind = 'dimension') AS ds FROM m GROUP BY "table")
SELECT "table" AS id, 'Table ' || "table" || ' ' || ms || ' ' || ds AS body FROM k UNION ALL SELECT "table" || '#' || node, '[Table ' || "table" || '] ' || label || '. More.' FROM m""")
def enriched_body(spark, sf_dir):
    t = _triples(spark, sf_dir)
    nodes = G.with_labels(t).select("table", "kind", "node", F.concat("label", F.lit(". More.")).alias("body"))
    tables = G.titles(t).select(F.col("table").alias("id"), "title", F.col("title").alias("body"))
    return R.enriched(tables, nodes)


@query("positives", """SELECT * FROM (VALUES (0, 'L'), (0, 'L#Quantity_1'), (0, 'L#A'), (0, 'L#1996JJ00'), (1, 'O'), (1, 'O#TotalPrice_1'), (1, 'O#F'), (1, 'O#O')) t(qid, id)""")
def positives(spark, sf_dir):
    rows = [(0, "(VALUE L (MSR (Quantity_1)) (DIM ReturnFlag (A)) (DIM Periods (1996JJ00)))"), (1, "(SUM (OrderStatus) (VALUE O (MSR (TotalPrice_1 > 10)) (DIM OrderStatus (F O))))")]
    return R.positives(spark.createDataFrame(rows, "qid int, sexp string"))


@query("length_percentiles", f"""WITH n AS (SELECT len({_TOK.format('text')}) AS n FROM documents) SELECT quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.95)::DOUBLE AS p95, quantile_cont(n, 0.99)::DOUBLE AS p99, max(n) AS longest, pow(2, ceil(log2(greatest(quantile_cont(n, 0.99), 1))))::BIGINT AS maxlen FROM n""")
def length_percentiles(spark, sf_dir):
    return R.length_stats(_table(spark, sf_dir, "documents"), "text")


@query("clean_space", r"SELECT conv_id, turn, regexp_replace(text, '((\r|\\r)?(\n|\\n))|\s+', ' ', 'g') AS body FROM conversations")
def clean_space(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", R.clean_space(F.col("text")).alias("body"))


# -- metrics -----------------------------------------------------------------------------------------------------------

_TRUTH = "SELECT l_returnflag, l_linestatus, year(l_shipdate)::BIGINT AS y, count(*) AS n FROM lineitem GROUP BY ALL"
_GIVEN = "SELECT count(*) AS n, l_linestatus AS s, l_returnflag AS f, year(l_shipdate)::BIGINT AS y FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL"


def _truth(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def _given(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    df = df.groupBy(F.col("l_linestatus").alias("s"), F.col("l_returnflag").alias("f"), F.year("l_shipdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return df.select("n", "s", "f", "y")


@query("record_accuracy", f"SELECT round((SELECT count(*) FROM ({_GIVEN})) / (SELECT count(*) FROM ({_TRUTH}))::DOUBLE, 4) AS record_accuracy")
def record_accuracy(spark, sf_dir):
    return rounded(M.record_accuracy(_truth(spark, sf_dir), _given(spark, sf_dir)), 4)


@query("numeric_recall", f"""WITH a AS (SELECT v, count(*) AS n FROM (SELECT y AS v FROM ({_TRUTH}) UNION ALL SELECT n FROM ({_TRUTH})) GROUP BY v),
b AS (SELECT v, count(*) AS n FROM (SELECT y AS v FROM ({_GIVEN}) UNION ALL SELECT n FROM ({_GIVEN})) GROUP BY v)
SELECT round(sum(least(a.n, coalesce(b.n, 0))) / sum(a.n)::DOUBLE, 4) AS numeric_recall FROM a LEFT JOIN b USING (v)""")
def numeric_recall(spark, sf_dir):
    return rounded(M.numeric_recall(_truth(spark, sf_dir), _given(spark, sf_dir)), 4)


def _cells_sql(t: str) -> str:
    return f"(SELECT list_sort(list(c)) FROM (SELECT unnest([a::VARCHAR, b::VARCHAR, y::VARCHAR, n::VARCHAR]) AS c FROM ({t})))"


_T4 = f"SELECT l_returnflag AS a, l_linestatus AS b, y, n FROM ({_TRUTH})"
_G4 = f"SELECT f AS a, s AS b, y, n FROM ({_GIVEN})"


@query("lenient_exec", f"SELECT ({_cells_sql(_T4)} = {_cells_sql('SELECT b AS a, a AS b, n AS y, y AS n FROM (' + _T4 + ')')})::INT::DOUBLE AS same, ({_cells_sql(_T4)} = {_cells_sql(_G4)})::INT::DOUBLE AS other")
def lenient_exec(spark, sf_dir):
    t = _truth(spark, sf_dir)
    same = M.lenient_equal(t, t.select("n", "y", "l_linestatus", "l_returnflag")).withColumnRenamed("lenient", "same")
    other = M.lenient_equal(t, _given(spark, sf_dir)).withColumnRenamed("lenient", "other")
    return same.withColumn("k", F.lit(1)).join(other.withColumn("k", F.lit(1)), "k").drop("k")


@query("strict_exec", f"SELECT (NOT EXISTS (({_T4}) EXCEPT ALL ({_T4})))::INT::DOUBLE AS strict, (NOT EXISTS (({_T4}) EXCEPT ALL ({_G4})) AND NOT EXISTS (({_G4}) EXCEPT ALL ({_T4})))::INT::DOUBLE AS other")
def strict_exec(spark, sf_dir):
    t = _truth(spark, sf_dir)
    g = _given(spark, sf_dir).withColumnsRenamed({"s": "l_linestatus", "f": "l_returnflag"})
    same = M.strict_equal(t, t.select("y", "n", "l_linestatus", "l_returnflag")).withColumn("k", F.lit(1))
    return same.join(M.strict_equal(t, g).withColumnRenamed("strict", "other").withColumn("k", F.lit(1)), "k").drop("k")


_SETS = """WITH a AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS t FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL),
b AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS g FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL)"""


@query("set_f1", f"""{_SETS} SELECT o_custkey, round(2.0 * len(list_intersect(t, g)) / (len(t) + len(g)), 4) AS f1,
 len(list_filter(g, lambda x: NOT list_contains(t, x))) AS extra, len(list_filter(t, lambda x: NOT list_contains(g, x))) AS missing FROM a JOIN b USING (o_custkey)""")
def set_f1(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    of = lambda status, name: o.where(F.col("o_orderstatus") != status).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias(name))
    met = of("F", "t").join(of("O", "g"), "o_custkey")
    extra, missing = M.extra_missing(F.col("t"), F.col("g"))
    return rounded(met.select("o_custkey", M.set_f1(F.col("t"), F.col("g")).alias("f1"), extra.alias("extra"), missing.alias("missing")), 4)


@query("selection_f1", """WITH h AS (SELECT r_name AS node, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT DISTINCT c_custkey AS qid, r_name AS item FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT c_custkey AS qid, n_name AS item FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT c_custkey, 'FRANCE' FROM customer WHERE c_custkey % 3 = 0),
ti AS (SELECT DISTINCT qid, coalesce(child, item) AS item FROM t LEFT JOIN h ON item = node),
j AS (SELECT coalesce(ti.qid, g.qid) AS qid, ti.item AS a, g.item AS b FROM ti FULL JOIN g ON ti.qid = g.qid AND ti.item = g.item)
SELECT qid, round(2.0 * count(a) FILTER (b IS NOT NULL) / (count(a) + count(b)), 4) AS f1, count(b) FILTER (a IS NULL) AS extra, count(a) FILTER (b IS NULL) AS missing FROM j GROUP BY qid""")
def selection_f1(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = _table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    truth = own.select(F.col("c_custkey").alias("qid"), F.col("r_name").alias("item"))
    given = own.select(F.col("c_custkey").alias("qid"), F.col("n_name").alias("item"))
    given = given.unionByName(own.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("qid"), F.lit("FRANCE").alias("item")))
    return rounded(M.selection_f1(truth, given, nation.select(F.col("r_name").alias("node"), F.col("n_name").alias("child"))), 4)


_RANKED = f"SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({_COS})"


@query("acc_at_k", f"""WITH r AS ({_RANKED}), g AS (SELECT qid, id, rank FROM r WHERE id % 7 = 0 AND rank <= 60), n AS (SELECT qid, count(*) AS n FROM g GROUP BY qid)
SELECT qid, round(count(*) FILTER (rank <= 10) / any_value(n.n)::DOUBLE, 4) AS recall, (count(*) FILTER (rank <= n.n) = any_value(n.n))::INT::DOUBLE AS exact FROM g JOIN n USING (qid) GROUP BY qid""")
def acc_at_k(spark, sf_dir):
    ranked = R.top_k(_cosines(spark, sf_dir), 60)
    return rounded(M.accuracy_at(ranked, ranked.where("id % 7 = 0"), 10), 4)


@query("acc_until_k", f"""WITH r AS ({_RANKED}), g AS (SELECT qid, id, rank FROM r WHERE id % 7 = 0 AND rank <= 60), n AS (SELECT qid, count(*) AS n FROM g GROUP BY qid),
e AS (SELECT qid, k, count(*) FILTER (rank <= k) / any_value(n.n)::DOUBLE AS x FROM g JOIN n USING (qid), range(1, 11) t(k) GROUP BY qid, k)
SELECT k, round(avg(x), 4) AS recall FROM e GROUP BY k""")
def acc_until_k(spark, sf_dir):
    ranked = R.top_k(_cosines(spark, sf_dir), 60)
    return rounded(M.accuracy_until(ranked, ranked.where("id % 7 = 0"), 10), 4)


@query("per_type_average", "SELECT event_type, (user_id % 3) AS theme, count(*) AS n, round(avg(value), 4) AS value FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def per_type_average(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("theme"), "value")
    return rounded(M.per_type(rows, ["event_type", "theme"], ["value"]), 4)


@query("latency", "SELECT round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median FROM events")
def latency(spark, sf_dir):
    return rounded(M.latency(_table(spark, sf_dir, "events"), "value"), 4)


@query("error_counts", "SELECT CASE event_type WHEN 'error' THEN 'other' WHEN 'click' THEN 'unit' WHEN 'view' THEN 'syntax' END AS error, count(*) AS n FROM events GROUP BY 1")
def error_counts(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "boom").when(F.col("event_type") == "click", "different Unit").when(F.col("event_type") == "view", "ParserError")
    return M.error_counts(_table(spark, sf_dir, "events").select(text.alias("error")))


# -- stream ------------------------------------------------------------------------------------------------------------


@query("stream_period_cube", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS EventType, round(sum(value), 2) AS Value_1, count(*) AS Events_2 FROM events GROUP BY ALL")
def stream_period_cube(spark, sf_dir):
    from tessera.streaming.cubes import period_cube

    return period_cube(_table(spark, sf_dir, "events"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tessera.plans import catalogue_texts  # noqa: F401  registers further ones

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
