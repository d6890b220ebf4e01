"""Registered queries on texts of the cube language and of SQL, units, prompts, sources and shaping, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import sexpr as S
from tessera.functions import units as U
from tessera.operators import graph as G
from tessera.operators import metrics as M
from tessera.operators import present as P
from tessera.operators import retrieval as R
from tessera.plans.catalogue import (
    _CODES, _LABELS, _MEMBERS, _TOK, JA, JB, JOIN_DIM, O_KEY, O_LONG, O_VAL, O_WHERE, _prop_sql, _table, _triples, expression, query, rounded,
)
from tessera.plans.compile import run
from tessera.plans.sqlfront import components, run_sql, sql_question_type, to_sql
from tessera.sources.catalog import driver_catalog
from tessera.sources.io import collection, ntriples


def over(df: DataFrame, column: str, f: Callable, schema: str) -> DataFrame:
    """df with what f, a function of one text, gives for a column, as columns of schema; texts go in Arrow batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(t) for t in texts], columns=names)

    return df.withColumn("_", each(F.col(column))).select(*df.columns, "_.*")


# -- the language ------------------------------------------------------------------------------------------------------

_ORDERS = "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority, year(o_orderdate)::INT AS y FROM orders"


def _orders(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("y")).distinct()


def _told(text: str) -> tuple:
    e = S.read(text)
    labels = {"TotalPrice_1": "Total price", "P": "Pending"}
    return S.show(e), S.question_type(text), ",".join(S.table_ids(text)), ",".join(S.golden_codes(text)), S.friendly(e, labels)


_FORM = "'(' || op || ' (Periods) (VALUE O (MSR (' || {m} || ' Orders_2)) (DIM Periods (' || y || 'JJ00)) (DIM Priority (' || {p} || ')) (DIM OrderStatus (' || {s} || '))))'"
_QUOTED = """CASE WHEN priority LIKE '% %' THEN '"' || priority || '"' ELSE priority END"""
_SHOWN = _FORM.format(m="'TotalPrice_1'", p=_QUOTED, s="status")
_FRIENDLY = _FORM.format(m="chr(39) || 'Total price' || chr(39)", p="priority", s="CASE status WHEN 'P' THEN chr(39) || 'Pending' || chr(39) ELSE status END")


@query("language_texts", f"""WITH o AS ({_ORDERS}), t AS (SELECT *, CASE status WHEN 'F' THEN 'SUM' WHEN 'O' THEN 'AVG' ELSE 'MAX' END AS op FROM o)
SELECT status, priority, y, {_SHOWN} AS shown, op AS kind, 'O' AS tables,
 'TotalPrice_1,Orders_2,Periods,' || y || 'JJ00,Priority,' || priority || ',OrderStatus,' || status AS codes, {_FRIENDLY} AS friendly FROM t""")
def language_texts(spark, sf_dir):
    op = F.when(F.col("status") == "F", "SUM").when(F.col("status") == "O", "AVG").otherwise("MAX")
    form = '  (%s (Periods)\n (VALUE  O (MSR (TotalPrice_1   Orders_2)) (DIM Periods (%dJJ00)) (DIM Priority ("%s"))\t(DIM OrderStatus (%s))))'
    rows = _orders(spark, sf_dir).withColumn("text", F.format_string(form, op, "y", "priority", "status"))
    return over(rows, "text", _told, "shown string, kind string, tables string, codes string, friendly string").drop("text")


def _error(text: str) -> tuple:
    try:
        S.read(text)
    except Exception as e:
        return (type(e).__name__,)
    return ("",)


@query("language_errors", f"""WITH o AS ({_ORDERS}) SELECT *, CASE priority WHEN '1-URGENT' THEN 'BracketError' WHEN '2-HIGH' THEN 'ExpressionError' WHEN '3-MEDIUM' THEN 'ValueError'
 WHEN '4-NOT SPECIFIED' THEN 'TypeError' ELSE CASE WHEN y % 2 = 0 THEN 'NotImplementedError' ELSE '' END END AS error FROM o""")
def language_errors(spark, sf_dir):
    value = F.concat(F.lit("(VALUE O (MSR ({})) (DIM Periods ("), "y", F.lit("JJ00)) (DIM OrderStatus ("), "status", F.lit(")))"))
    with_ = lambda m: F.replace(value, F.lit("{}"), F.lit(m))
    text = (
        F.when(F.col("priority") == "1-URGENT", F.concat(F.lit("("), with_("Orders_2"))).when(F.col("priority") == "2-HIGH", with_(""))
        .when(F.col("priority") == "3-MEDIUM", with_("Orders_2 > many")).when(F.col("priority") == "4-NOT SPECIFIED", with_("Orders_2 TotalPrice_1 > 3"))
        .when(F.col("y") % 2 == 0, F.concat(F.lit("(SUM (Periods OrderStatus) "), with_("Orders_2"), F.lit(")"))).otherwise(with_("Orders_2 > 3"))
    )
    return over(_orders(spark, sf_dir).withColumn("text", text), "text", _error, "error string").drop("text")


# -- units -------------------------------------------------------------------------------------------------------------

_UNITS = """SELECT n_name AS name, CASE n_nationkey % 7 WHEN 0 THEN 'COUNT' WHEN 1 THEN 'EURO' WHEN 2 THEN 'EURO' WHEN 3 THEN 'PERCENT' WHEN 4 THEN 'KG' WHEN 5 THEN 'TON' END AS unit,
 CASE n_nationkey % 7 WHEN 2 THEN 1000.0::DOUBLE WHEN 6 THEN NULL ELSE 1.0 END AS multiplier, CASE WHEN n_nationkey % 7 IN (4, 5) THEN 'GRAM' END AS scaling_of FROM nation"""


def _verdict_sql(scaling: bool) -> str:
    fixed = "" if scaling else "WHEN x.unit = y.unit AND x.multiplier <> y.multiplier THEN 'multipliers'"
    scaled = "WHEN coalesce(x.scaling_of, x.unit) = coalesce(y.scaling_of, y.unit) THEN 'ok'" if scaling else ""
    return f"""WITH u AS ({_UNITS}) SELECT x.name AS a, y.name AS b, (x.unit IS NOT NULL)::BIGINT + (y.unit IS NOT NULL)::BIGINT AS n,
CASE WHEN x.unit IS NULL OR y.unit IS NULL THEN 'ok' WHEN 'PERCENT' IN (x.unit, y.unit) THEN 'dimensionless' {fixed} WHEN x.unit = y.unit AND x.unit = 'COUNT' THEN 'counts'
 WHEN x.unit = y.unit THEN 'ok' {scaled} ELSE 'units' END AS verdict FROM u x JOIN u y ON x.name < y.name"""


def _verdicts(spark, sf_dir, scaling: bool) -> DataFrame:
    k = F.col("n_nationkey") % 7
    unit = F.when(k == 0, "COUNT").when(k.isin(1, 2), "EURO").when(k == 3, "PERCENT").when(k == 4, "KG").when(k == 5, "TON")
    n = _table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), unit.alias("unit"), F.when(k == 2, 1000.0).when(k < 6, 1.0).alias("multiplier"), F.when(k.isin(4, 5), "GRAM").alias("scaling_of")
    )
    pairs = n.select(F.col("name").alias("a")).join(n.select(F.col("name").alias("b")), F.col("a") < F.col("b"))
    each = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("name")).join(n, "name")
    return U.verdicts(each, ["a", "b"], scaling)


@query("unit_rules_scaling", _verdict_sql(True))
def unit_rules_scaling(spark, sf_dir):
    return _verdicts(spark, sf_dir, True)


@query("unit_rules_fixed", _verdict_sql(False))
def unit_rules_fixed(spark, sf_dir):
    return _verdicts(spark, sf_dir, False)


_FACTORS = {
    "": 1.0, "x 1 000 ": 1e3, "1 000 ": 1e3, "x 1000 ": 1e3, "1,000 ": 1e3, "x 1.000 ": 1e3, "mln ": 1e6, "x mln ": 1e6, "x million ": 1e6, "Mld ": 1e9, "billion ": 1e9,
    "10 000 ": 1e4, "1 000 mln ": 1e9,
}
_NOUNS = {
    "euro": "EURO", "euros": "EURO", "kg": "KG", "kgs": "KG", "tonnes": "TON", "km": "KM", "m3": "M3", "m³": "M3", "uren": "HOUR", "labour years": "YEAR", "kWh": "KWH",
    "personen": "COUNT", "Number": "COUNT", "TEU": None, "per 1 000 inwoners": None, "index 2015=100": None,
}
_FACTORS_SQL = ", ".join(f"('{f}', {m}::DOUBLE)" for f, m in _FACTORS.items())
_NOUNS_SQL = ", ".join(f"('{w}', {'NULL' if u is None else repr(u)})" for w, u in _NOUNS.items())


@query("unit_texts", f"""SELECT f || w AS text, unit, CASE WHEN unit IS NOT NULL THEN multiplier END AS multiplier FROM (VALUES {_FACTORS_SQL}) a(f, multiplier), (VALUES {_NOUNS_SQL}) b(w, unit)
 UNION ALL SELECT '% van ' || n_name, 'PERCENT', 1.0 FROM nation UNION ALL SELECT 'per ' || r_name, NULL, NULL FROM region""")
def unit_texts(spark, sf_dir):
    texts = spark.createDataFrame([(f + w,) for f in _FACTORS for w in _NOUNS], "text string")
    texts = texts.union(_table(spark, sf_dir, "nation").select(F.concat(F.lit("% van "), "n_name"))).union(_table(spark, sf_dir, "region").select(F.concat(F.lit("per "), "r_name")))

    def told(text: str) -> tuple:
        u = U.normalise(text)
        return u.unit, u.multiplier

    return over(texts, "text", told, "unit string, multiplier double")


# -- joins and SQL texts -----------------------------------------------------------------------------------------------

for _op in ("SUM", "AVG", "MIN", "MAX"):
    expression(
        f"aggjoin_native_{_op.lower()}", f"({_op} () (JOIN (TotalPrice_1) (VALUE O (MSR (TotalPrice_1)) (DIM OrderStatus (F O)) (DIM Periods (1996JJ00)) (DIM Priority ())) (VALUE O (MSR (TotalPrice_1)) (DIM OrderStatus (P)) (DIM Periods ()) (DIM Priority (2-HIGH 3-MEDIUM)))))", "native",
        f"SELECT round({_op}(Value), 2) AS {_op} FROM ({O_LONG} WHERE (OrderStatus IN ('F', 'O') AND Periods = '1996JJ00') OR (OrderStatus = 'P' AND Priority IN ('2-HIGH', '3-MEDIUM')))",
    )


def _text_of(name: str, e: str, mode: str, sql: str) -> None:
    """A query that runs the SQL text which an expression is written as."""
    text = to_sql(S.read(e), mode)

    @query(name, sql)
    def told(spark, sf_dir):
        out = rounded(run_sql(text, spark, driver_catalog(spark, sf_dir)))
        return out.withColumn("rnk", F.col("rnk").cast("bigint")) if "rnk" in out.columns else out


def _rank_sql(op: str, way: str, columns: str) -> str:
    inner = f"SELECT *, rank() OVER (ORDER BY TotalPrice_1 {way} NULLS LAST) AS rnk FROM oc WHERE {O_WHERE}"
    return f'SELECT {columns}TotalPrice_1, OrderStatus, Priority, Periods AS "{op}[Periods]" FROM ({inner}) WHERE rnk = 1'


for _op, _way in (("MAX", "DESC"), ("MIN", "ASC")):
    _text_of(f"sql_cte_rank_{_op.lower()}", f"({_op} (Periods) {O_VAL})", "simplified", _rank_sql(_op, _way, "rnk, "))
_text_of("sql_full_join", JOIN_DIM, "pivot", f'SELECT coalesce(a.Periods, b.Periods) AS Periods, A_F, "F_1-URGENT" FROM ({JA}) a FULL JOIN ({JB}) b ON a.Periods = b.Periods')
_text_of("sql_group_by_alias", f"(PROP (DIM Periods (1996JJ00)) {O_VAL})", "pivot", _prop_sql(["1996JJ00"], O_WHERE, O_KEY, O_LONG, "Periods"))


@query("sql_question_types", f"""WITH o AS ({_ORDERS}) SELECT *, CASE priority WHEN '1-URGENT' THEN 'JOIN' WHEN '2-HIGH' THEN 'PROP' WHEN '3-MEDIUM' THEN CASE status WHEN 'F' THEN 'SUM' WHEN 'O' THEN 'AVG' ELSE 'MAX' END
 WHEN '4-NOT SPECIFIED' THEN NULL ELSE CASE WHEN status = 'P' THEN 'AGGJOIN' ELSE 'VALUE' END END AS kind FROM o""")
def sql_question_types(spark, sf_dir):
    where = F.concat(F.lit(" FROM t WHERE s = '"), "status", F.lit("' AND y = "), "y")
    op = F.when(F.col("status") == "F", "SUM").when(F.col("status") == "O", "avg").otherwise("MAX")
    text = (
        F.when(F.col("priority") == "1-URGENT", F.concat(F.lit("SELECT a"), where, F.lit(" UNION SELECT b FROM u")))
        .when(F.col("priority") == "2-HIGH", F.concat(F.lit("SELECT a / b"), where)).when(F.col("priority") == "3-MEDIUM", F.concat(F.lit("SELECT "), op, F.lit("(a) AS 'JOIN'"), where))
        .when(F.col("priority") == "4-NOT SPECIFIED", F.concat(F.lit("SELECT (a"), where))
        .when(F.col("status") == "P", F.lit("SELECT SUM(a) FROM t JOIN u ON t.k = u.k")).otherwise(F.concat(F.lit("SELECT a"), where))
    )
    return over(_orders(spark, sf_dir).withColumn("text", text), "text", lambda t: (sql_question_type(t),), "kind string").drop("text")


@query("component_f1", f"""WITH o AS ({_ORDERS}) SELECT *, CASE WHEN y = 1996 THEN 1.0 ELSE 0.5 END::DOUBLE AS in_where, CASE WHEN status = 'P' THEN 0.0 ELSE 1.0 END::DOUBLE AS in_select,
 CASE WHEN priority = '1-URGENT' THEN 0.6667 ELSE 1.0 END::DOUBLE AS in_group, y = 1996 AND status <> 'P' AND priority <> '1-URGENT' AS same FROM o""")
def component_f1(spark, sf_dir):
    """A text against one that differs by year, aggregate and grouping, as sets of components and as text."""
    year, grouped = F.col("y").cast("string"), F.when(F.col("priority") == "1-URGENT", ", z").otherwise("")
    a = F.concat(F.lit("SELECT SUM(v) AS s FROM t WHERE s = '"), "status", F.lit("' AND y = '"), year, F.lit("' GROUP BY s"), grouped)
    b = F.concat(F.lit("select  "), F.when(F.col("status") == "P", "AVG").otherwise("sum"), F.lit("(v) as s\nfrom t where s = '"), "status", F.lit("' and y = '1996' group by s"))

    def told(text: str) -> tuple:
        x, y = text.split("|")
        f1 = M.component_f1(components(x), components(y))
        return f1["where"], f1["select"], round(f1["group"], 4), M.exact_match(x, y)

    rows = _orders(spark, sf_dir).withColumn("text", F.concat_ws("|", a, b))
    return over(rows, "text", told, "in_where double, in_select double, in_group double, same boolean").drop("text")


# -- shaping -----------------------------------------------------------------------------------------------------------


@query("present_repeats", "SELECT Region, Segment, Balance_1, Customers_2 FROM nc")
def present_repeats(spark, sf_dir):
    df = driver_catalog(spark, sf_dir)["N"].df.withColumn("Customers_2", F.col("Customers_2").cast("double"))
    return rounded(P.drop_repeats(df.select("*", F.col("Balance_1").alias("Balance_1_1"), F.col("Segment").alias("Segment_2"))))


@query("present_rank", _rank_sql("MAX", "DESC", ""))
def present_rank(spark, sf_dir):
    return rounded(P.present(run(f"(MAX (Periods) {O_VAL})", driver_catalog(spark, sf_dir), "simplified")))


@query("present_prop", f"SELECT Dimension_Measure AS Measure, COLUMNS(* EXCLUDE (Dimension_Measure)) FROM ({_prop_sql(['1996JJ00'], O_WHERE, O_KEY, O_LONG, 'Periods')})")
def present_prop(spark, sf_dir):
    return rounded(P.present(run(f"(PROP (DIM Periods (1996JJ00)) {O_VAL})", driver_catalog(spark, sf_dir), "pivot")))


@query("present_code_dims", """SELECT f || '_' || s || '_' || y || 'JJ00' AS name, unnest([f, s, y || 'JJ00']) AS code, unnest(['ReturnFlag', 'LineStatus', 'Periods']) AS dim
 FROM (VALUES ('A-1'), ('Returned')) a(f), (VALUES ('Open'), ('Filled')) b(s), range(1995, 1998) c(y)""")
def present_code_dims(spark, sf_dir):
    codes = {"ReturnFlag": ["A-1", "Returned"], "LineStatus": ["Open", "Filled"], "Periods": [f"{y}JJ00" for y in range(1995, 1998)]}
    names = ["_".join((f, s, y)) for f in codes["ReturnFlag"] for s in codes["LineStatus"] for y in codes["Periods"]]
    return spark.createDataFrame([(n.name, c, d) for n in P.column_names(names, codes) for c, d in zip(n.codes, n.dims, strict=True)], "name string, code string, dim string")


# -- graph -------------------------------------------------------------------------------------------------------------

_CODE_LABEL = """CASE split_part(child, '=', 2) WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'None' WHEN 'R' THEN 'Returned' WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Pending'
 ELSE left(split_part(child, '=', 2), 4) END"""


@query("graph_select", f"""SELECT "table" || '#' || code AS node, {_LABELS} AS label FROM {_MEMBERS} UNION ALL SELECT child, {_CODE_LABEL} FROM {_CODES} WHERE node NOT LIKE 'N#%'""")
def graph_select(spark, sf_dir):
    return G.match(_triples(spark, sf_dir), [G.LABEL, G.ALT], "node", "label")


@query("graph_construct", f"""WITH m AS (SELECT count(*) AS n FROM {_MEMBERS}), k AS (SELECT count(*) AS n FROM {_CODES})
SELECT '{G.BROADER}' AS p, n FROM k UNION ALL SELECT '{G.NARROWER}', n FROM k UNION ALL SELECT '{G.CONCEPT}', n FROM m""")
def graph_construct(spark, sf_dir):
    """Concept triples are made of members and inserted twice; the graph holds each once."""
    t = _triples(spark, sf_dir)
    made = G.members(t).select(F.col("table").alias("s"), F.lit(G.CONCEPT).alias("p"), F.col("node").alias("o"))
    every = G.insert(G.insert(t, made), made)
    return every.where(F.col("p").isin(G.CONCEPT, G.BROADER, G.NARROWER)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("graph_explode_members", f"""SELECT "table", kind, "table" || '#' || code AS node FROM {_MEMBERS} WHERE "table" IN ('L', 'N', 'O')""")
def graph_explode_members(spark, sf_dir):
    return G.explode(_triples(spark, sf_dir), ["N#Region", "L", "O#Priority"], tables=5, observations=20)


@query("graph_geo_codes", "SELECT r_name AS code, NULL::VARCHAR AS label FROM region WHERE r_name IN ('AFRICA', 'ASIA', 'EUROPE')")
def graph_geo_codes(spark, sf_dir):
    return G.dimension_codes(_triples(spark, sf_dir), "N", G.GEO)


# -- retrieval and prompts ---------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS["en"])
_STEM = "CASE " + " ".join(f"WHEN ends_with(t, '{e}') AND length(t) >= {len(e) + 3} THEN substr(t, 1, length(t) - {len(e)})" for e in R.ENDINGS["en"]) + " ELSE t END"


@query("stemmed_terms", f"SELECT {_STEM} AS term, count(*) AS n FROM (SELECT unnest({_TOK.format('text')}) AS t FROM conversations) WHERE t NOT IN ({_STOP}) GROUP BY 1")
def stemmed_terms(spark, sf_dir):
    terms = _table(spark, sf_dir, "conversations").select(F.explode(R.query_tokens(F.col("text"), stemmed=True)).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("bm25_three_pools", f"""WITH d AS (SELECT 't' || (doc_id - doc_id % 3) || CASE doc_id % 3 WHEN 0 THEN '' ELSE '#' || doc_id END AS id, doc_id % 3 AS pool, {_TOK.format('text')} AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT pool, count(*) AS n, avg(len(ws)) AS avgdl FROM d GROUP BY pool), tf AS (SELECT pool, id, term, count(*) AS tf FROM (SELECT pool, id, unnest(ws) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id AS qid, {_STEM} AS term, count(*) AS times FROM (SELECT item_id, unnest({_TOK.format('text')}) AS t FROM benchmark) WHERE t NOT IN ({_STOP}) GROUP BY ALL),
i AS (SELECT pool, term, ln((any_value(s.n) + 1) / count(*)) AS idf FROM tf JOIN s USING (pool) WHERE term IN (SELECT term FROM q) GROUP BY pool, term),
f AS (SELECT pool, qid, sum(times * idf) AS flr FROM q JOIN i USING (term) GROUP BY ALL),
o AS (SELECT pool, qid, id, sum(times * idf * tf * 2.5 / (1.5 * (0.25 + 0.75 * len(d.ws) / s.avgdl) + tf)) AS own FROM tf JOIN q USING (term) JOIN i USING (pool, term) JOIN d USING (pool, id) JOIN s USING (pool) GROUP BY ALL),
b AS (SELECT pool, qid, id, own + flr AS score FROM o JOIN f USING (pool, qid) WHERE own + flr > 0),
m AS (SELECT qid, split_part(id, '#', 1) AS "table", avg(score) AS nodes FROM b WHERE pool > 0 AND score >= 0.01 GROUP BY ALL),
u AS (SELECT qid, "table", coalesce(score, 0) + 0.8 * coalesce(nodes, 0) AS score FROM (SELECT qid, id AS "table", score FROM b WHERE pool = 0) FULL JOIN m USING (qid, "table"))
SELECT qid, count(*) AS n, round(sum(score), 1) AS total, round(max(score), 2) AS best FROM u GROUP BY qid""")
def bm25_three_pools(spark, sf_dir):
    docs, k = _table(spark, sf_dir, "documents").where("doc_id is not null"), F.col("doc_id") % 3
    table = F.concat(F.lit("t"), (F.col("doc_id") - k).cast("string"))
    nodes = docs.select(
        F.when(k == 0, table).otherwise(F.concat_ws("#", table, F.col("doc_id").cast("string"))).alias("id"),
        F.when(k == 0, "table").when(k == 1, "dimension").otherwise("measure").alias("kind"), F.col("text").alias("body"),
    )
    scores = R.bm25_pools(nodes, _table(spark, sf_dir, "benchmark"), query_id="item_id", query_text="text", stemmed=True)
    out = scores.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.max("score").alias("best"))
    return out.select("qid", "n", F.round("total", 1).alias("total"), F.round("best", 2).alias("best"))


_NODES = """SELECT 't' || (s_nationkey % 5) AS "table", ['measure', 'dimension', 'code'][(s_suppkey % 3)::INT + 1] AS kind, 'n' || s_suppkey AS node, CASE WHEN s_suppkey % 6 = 2 THEN 'g' || s_nationkey END AS parent,
 s_name AS label, CASE WHEN s_suppkey % 3 = 0 THEN 'EURO' END AS unit, (s_suppkey * 37 % 101) / 101.0::DOUBLE AS score FROM supplier"""


@query("prompt_lines", f"""WITH n AS ({_NODES}), k AS (SELECT *, max(score) OVER (PARTITION BY "table", coalesce(parent, node)) AS best, CASE WHEN kind = 'measure' THEN 0 WHEN kind = 'dimension' OR parent IS NOT NULL THEN 1 ELSE 2 END AS part FROM n WHERE score >= 0.1),
r AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY part, best DESC, coalesce(parent, node), parent IS NOT NULL, score DESC, node) AS place FROM k)
SELECT "table", place, '- ' || CASE kind WHEN 'measure' THEN 'Measure' WHEN 'dimension' THEN 'DimensionGroup' ELSE 'Dimension' END || ': ' || node || ' (label: "' || label || '")' || CASE WHEN unit IS NULL THEN '' ELSE ' (unit: ' || unit || ')' END
 || printf(' (relevance: %.4f)', score) AS line FROM r WHERE place <= 500""")
def prompt_lines(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    nodes = _table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("t"), n % 5).alias("table"), F.when(k % 3 == 0, "measure").when(k % 3 == 1, "dimension").otherwise("code").alias("kind"), F.concat(F.lit("n"), k).alias("node"),
        F.when(k % 6 == 2, F.concat(F.lit("g"), n)).alias("parent"), F.col("s_name").alias("label"), F.when(k % 3 == 0, "EURO").alias("unit"), ((k * 37 % 101) / 101.0).alias("score"),
    )
    return R.prompt_lines(R.prompt_order(nodes))


@query("model_responses", f"""WITH o AS ({_ORDERS}) SELECT *, CASE WHEN priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'SELECT ' || y || ' FROM "' || status || '"' ELSE '' END AS query FROM o""")
def model_responses(spark, sf_dir):
    """Answers as plain JSON, in a code fence, among words, broken, and without a query."""
    told = F.concat(F.lit('{"query": "SELECT '), "y", F.lit(' FROM \\"'), "status", F.lit('\\""}'))
    raw = (
        F.when(F.col("priority") == "1-URGENT", told).when(F.col("priority") == "2-HIGH", F.concat(F.lit("```json\n"), told, F.lit("\n```")))
        .when(F.col("priority") == "3-MEDIUM", F.concat(F.lit("Here it is: "), told, F.lit(" as asked")))
        .when(F.col("priority") == "5-LOW", F.when(F.col("y") % 2 == 0, F.lit('{"answer": 3}'))).otherwise(F.concat(told, F.lit("}")))
    )
    return over(_orders(spark, sf_dir).withColumn("raw", raw), "raw", lambda t: (R.response_query(t),), "query string").drop("raw")


@query("record_accuracy_transposed", "SELECT 0.6667::DOUBLE AS plain_or_turned, count(DISTINCT l_returnflag) AS flags FROM lineitem")
def record_accuracy_transposed(spark, sf_dir):
    """Counts of flags side by side, against those of two of them below each other."""
    items = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    truth = items.groupBy().pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("n"))
    share = M.record_accuracy_either_way(truth, items.where("l_returnflag <> 'N'").select("n"))
    return items.agg(F.count(F.lit(1)).alias("flags")).select(F.round(F.lit(share), 4).alias("plain_or_turned"), "flags")


# -- sources -----------------------------------------------------------------------------------------------------------


@query("collection_pids", "SELECT row_number() OVER (ORDER BY p_name || '#' || p_partkey) - 1 AS pid, p_name || '#' || p_partkey AS node, p_type AS body FROM part")
def collection_pids(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select(F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("node"), "p_type")
    return collection(parts, "node", "p_type")


@query("ntriples_lines", "SELECT 'http://x/' || n_nationkey AS s, 'http://x/name' AS p, n_name AS o, CASE WHEN n_regionkey = 0 THEN '' ELSE 'http://g/' || n_regionkey END AS g FROM nation")
def ntriples_lines(spark, sf_dir):
    """Lines with plain, tagged and typed literals, with and without a graph; remarks among them."""
    n = _table(spark, sf_dir, "nation")
    tail = F.element_at(F.array(F.lit(""), F.lit("@en"), F.lit("^^<http://x/s>")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    graph = F.when(F.col("n_regionkey") == 0, "").otherwise(F.concat(F.lit(" <http://g/"), "n_regionkey", F.lit(">")))
    line = F.concat(F.lit("<http://x/"), "n_nationkey", F.lit('> <http://x/name>  "'), "n_name", F.lit('"'), tail, graph, F.lit(" ."))
    return ntriples(n.select(line.alias("value")).union(n.select(F.concat(F.lit("# "), "n_name"))))
