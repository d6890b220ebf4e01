"""Golden answers of expressions on small cubes, in each mode, and shaping."""

import pytest

from tessera.functions.units import Unit, UnitCompatibilityError
from tessera.operators import cube as C
from tessera.operators import present as P
from tessera.plans.compile import run
from tessera.plans.sqlfront import components, run_sql, sql_question_type, to_sql
from tessera.sources.catalog import Catalog, Cube, cube_of

HOLIDAYS = [
    ("2021JJ00", "T001047", 31685.0, None, 205.2, 446.0, 973.0), ("2022JJ00", "T001047", 35933.0, None, 265.4, 571.0, 1401.0),
    ("2021JJ00", "L008691", 21440.0, 8957.0, None, None, None), ("2022JJ00", "L008691", 16498.0, 7792.0, None, None, None),
    ("2021JJ00", "L999996", 10245.0, 6498.0, None, None, None), ("2022JJ00", "L999996", 19436.0, 9172.0, None, None, None),
]
FREIGHT = [("2016JJ00", 19379.0), ("2017JJ00", 17946.0), ("2021JJ00", 11003.0), ("2022JJ00", 9659.0)]
DIMS = "(DIM Perioden (2021JJ00 2022JJ00)) (DIM Seizoen (T001047))"
REGIONS = "(DIM Perioden (2021JJ00 2022JJ00)) (DIM Seizoen (L008691 L999996))"


@pytest.fixture(scope="module")
def catalog(spark):
    measures = ("D004645", "M005005_1", "D006211_2", "M001339", "M001860")
    df = spark.createDataFrame(HOLIDAYS, "Perioden string, Seizoen string, " + ", ".join(f"{m} double" for m in measures))
    units = {"D004645": Unit("COUNT", 1000.0, text="x 1 000"), "M005005_1": Unit("COUNT", 1000.0, text="x 1 000"), "D006211_2": Unit("COUNT", 1e6, text="mln"), "M001339": Unit("EURO", 1.0), "M001860": Unit("EURO", 1.0)}
    labels = {"D004645": "Totaal vakanties", "2021JJ00": "2021", "2022JJ00": "2022", "T001047": "Totaal"}
    freight = spark.createDataFrame([(p, "A045747", v, v / 2, 1.0) for p, v in FREIGHT], "Perioden string, Stromen string, M004367 double, M004369 double, M9 double")
    pigs = [(f"{y}JJ00", "NL01", t / 2, t / 2) for y, t in ((2020, 48579668), (2021, 48329610), (2022, 47359417))]
    return Catalog([
        Cube("85302NED", df, ("Perioden", "Seizoen"), measures, labels, units),
        Cube("84957NED", freight, ("Perioden", "Stromen"), ("M004367", "M004369", "M9"), {}, {"M004367": Unit("TON-KM", 1e6), "M004369": Unit("TON", 1.0), "M9": Unit("PERCENT")}),
        Cube("80781ned", spark.createDataFrame(pigs, "Perioden string, RegioS string, A1 double, A2 double"), ("Perioden", "RegioS"), ("A1", "A2"), {}, {"A1": Unit("COUNT", 1.0), "A2": Unit("COUNT", 1.0)}),
    ])


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def one(df):
    got = rows(df)
    assert len(got) == 1
    return got[0]


V = f"(VALUE 85302NED (MSR (D004645)) {DIMS})"


def test_value(catalog):
    for mode in ("native", "pivot"):
        assert one(run(V, catalog, mode)) == {"Measure": "D004645", "2021JJ00_T001047": 31685.0, "2022JJ00_T001047": 35933.0}
    assert [r["D004645"] for r in rows(run(V, catalog, "simplified"))] == [31685.0, 35933.0]
    low = one(run(V.replace("(D004645)", "(D004645 < 35000)"), catalog, "pivot"))
    assert low["2021JJ00_T001047"] == 31685.0 and low["2022JJ00_T001047"] is None


def test_sum(catalog):
    pigs = "(SUM () (VALUE 80781ned (MSR (A1 A2)) (DIM Perioden (2020JJ00 2021JJ00 2022JJ00)) (DIM RegioS (NL01))))"
    want = [48579668.0, 48329610.0, 47359417.0]
    got = one(run(pigs, catalog, "pivot"))
    assert [got[f"{y}JJ00_NL01"] for y in (2020, 2021, 2022)] == want and got["Measure"] == "A1;A2"
    assert sorted(r["SUM"] for r in rows(run(pigs, catalog, "native"))) == sorted(want)
    assert sorted(r["SUM"] for r in rows(run(pigs, catalog, "simplified"))) == sorted(want)
    dim = f"(SUM (Perioden) (VALUE 85302NED (MSR (D004645 M005005_1)) {REGIONS}))"
    got = {r["Measure"]: r for r in rows(run(dim, catalog, "pivot"))}
    assert (got["D004645"]["L008691"], got["D004645"]["L999996"], got["M005005_1"]["L008691"], got["M005005_1"]["L999996"]) == (37938.0, 29681.0, 16749.0, 15670.0)
    assert sorted(r["SUM"] for r in rows(run(dim, catalog, "simplified"))) == [16743.0, 24290.0, 28608.0, 30397.0]


def test_average(catalog):
    text = f"(AVG (Perioden) {V})"
    assert one(run(text, catalog, "pivot"))["T001047"] == 33809.0
    assert one(run(text, catalog, "native"))["AVG[Perioden]"] == 33809.0
    assert sorted(r["AVG"] for r in rows(run(text, catalog, "simplified"))) == [31685.0, 35933.0]


def test_extremes(catalog):
    for op, year, value in (("MAX", "2022JJ00", 35933.0), ("MIN", "2021JJ00", 31685.0)):
        text = f"({op} (Perioden) {V})"
        got = one(run(text, catalog, "native"))
        assert (got["Perioden"], got["Value"]) == (year, value)
        assert one(run(text, catalog, "pivot"))["T001047"] == value
        got = one(run(text, catalog, "simplified"))
        assert (got["rnk"], got["D004645"], got[f"{op}[Perioden]"]) == (1, value, year)
    both = f"(MAX () (VALUE 85302NED (MSR (D004645 D006211_2)) {DIMS}))"
    with pytest.warns(UserWarning):
        got = {r["Perioden"]: r for r in rows(run(both, catalog, "native"))}
    assert (got["2021JJ00"]["Measure"], got["2021JJ00"]["Unit"]) == ("D006211_2", "number")
    assert got["2021JJ00"]["Value"] == pytest.approx(205200000) and got["2022JJ00"]["Value"] == pytest.approx(265400000)
    per = f"(MAX () (VALUE 85302NED (MSR (M001339 M001860)) {DIMS}))"
    assert {k: v for k, v in one(run(per, catalog, "pivot")).items() if k != "Measure"} == {"2021JJ00_T001047": 973.0, "2022JJ00_T001047": 1401.0}
    got = one(run(per, catalog, "simplified"))
    assert (got["MAX[Value]"], got["Measure"], got["Perioden"]) == (1401.0, "M001860", "2022JJ00")


def test_proportion(catalog):
    text = f"(PROP (DIM Perioden (2021JJ00)) {V})"
    got = one(run(text, catalog, "pivot"))
    assert (got["SUM[Perioden]"], got["2021JJ00"], got["%"]) == (67618.0, 31685.0, 46.86)
    assert one(run(text, catalog, "native"))["%"] == pytest.approx(46.8588, rel=1e-5)
    low = text.replace("(D004645)", "(D004645 < 32000)")
    assert one(run(low, catalog, "pivot"))["%"] == 100.0
    assert one(run(low, catalog, "pivot", compat_prop_filter=True))["%"] == 46.86


def test_join(catalog):
    dim = f"(JOIN (Perioden) (VALUE 84957NED (MSR (M004367)) (DIM Perioden (2021JJ00 2022JJ00)) (DIM Stromen (A045747))) (VALUE 85302NED (MSR (D006211_2)) {DIMS}))"
    assert rows(run(dim, catalog, "pivot")) == [{"Perioden": "2021JJ00", "A045747": 11003.0, "T001047": 205.2}, {"Perioden": "2022JJ00", "A045747": 9659.0, "T001047": 265.4}]
    side = lambda a, b: f"(VALUE 84957NED (MSR (M004367)) (DIM Perioden ({a} {b})) (DIM Stromen (A045747)))"
    msr = f"(JOIN (M004367) {side('2021JJ00', '2022JJ00')} {side('2016JJ00', '2017JJ00')})"
    for mode in ("native", "pivot"):
        assert sorted(v for k, v in one(run(msr, catalog, mode)).items() if k != "Measure") == [9659.0, 11003.0, 17946.0, 19379.0]
    assert one(run(f"(SUM () {msr})", catalog, "pivot"))["SUM"] == 57987.0
    assert one(run(f"(SUM () {msr})", catalog, "native"))["SUM"] == 57987.0
    assert len(rows(run(dim, catalog, "simplified"))) == 2


def test_units_are_checked(catalog):
    for mode in ("native", "pivot", "simplified"):
        with pytest.raises(UnitCompatibilityError, match="different unit"):
            run("(SUM () (VALUE 84957NED (MSR (M004367 M004369)) (DIM Perioden (2021JJ00))))", catalog, mode)
        with pytest.raises(UnitCompatibilityError, match="dimensionless"):
            run("(AVG () (VALUE 84957NED (MSR (M004367 M9)) (DIM Perioden (2021JJ00))))", catalog, mode)
    text = f"(SUM () (VALUE 85302NED (MSR (D004645 D006211_2)) {DIMS}))"
    with pytest.warns(UserWarning):
        got = {r["Perioden"]: r["SUM"] for r in rows(run(text, catalog, "native"))}
    assert got["2021JJ00"] == pytest.approx(31685000 + 205200000)
    with pytest.warns(UserWarning), pytest.raises(UnitCompatibilityError, match="conversion multipliers"):
        run(text, catalog, "pivot")
    with pytest.raises(KeyError):
        run("(VALUE 85302NED (MSR (nope)))", catalog)


@pytest.mark.parametrize("mode", ["pivot", "simplified"])
@pytest.mark.parametrize("text", [V, f"(SUM (Perioden) {V})", f"(SUM () (VALUE 85302NED (MSR (M001339 M001860)) {DIMS}))", f"(MAX (Perioden) {V})", f"(PROP (DIM Perioden (2021JJ00)) {V})", f"(MIN () (VALUE 85302NED (MSR (M001339 M001860)) {DIMS}))"])
def test_texts_say_what_expressions_do(spark, catalog, mode, text):
    from tessera.functions.sexpr import read

    sql = to_sql(read(text), mode)
    assert rows(run_sql(sql, spark, catalog)) == rows(run(text, catalog, mode)), sql


def test_wide_pivots_match_narrow_ones(spark, monkeypatch):
    data = [(f"a{k % 9}", f"b{k % 5}", float(k)) for k in range(200)] + [(None, "b1", 1.0)]
    df = spark.createDataFrame(data, "x string, y string, m double")
    codes = {"x": [f"a{k}" for k in range(9)], "y": [f"b{k}" for k in range(5)]}
    long = C.long_form(df, ["x", "y"], ["m"])
    plain = rows(C.pivoted(long, ["Measure"], codes, "SUM"))
    monkeypatch.setattr(C, "ONE_PASS", 10)
    assert rows(C.pivoted(long, ["Measure"], codes, "SUM")) == plain


def test_codes_may_hold_the_separator(spark, monkeypatch):
    df = spark.createDataFrame([("a_b", "c", 1.0), ("a", "b_c", 2.0), ("a", "c", 4.0), ("a", None, 8.0), ("z", "c", 16.0)], "x string, y string, m double")
    codes = {"x": ["a_b", "a"], "y": ["c", "b_c"]}
    long = C.long_form(df, ["x", "y"], ["m"])
    plain = C.pivoted(long, ["Measure"], codes, "SUM")
    monkeypatch.setattr(C, "ONE_PASS", 1)
    wide = C.pivoted(long, ["Measure"], codes, "SUM")
    assert wide.columns == plain.columns == ["Measure", "a_b_c", "a_b_b_c", "a_c", "a_b_c"]
    assert [tuple(r) for r in wide.collect()] == [tuple(r) for r in plain.collect()] == [("m", 1.0, None, 4.0, 2.0)]
    open_rows = C.pivoted(long, ["Measure", "y"], {"x": ["a", "a_b"]}, "SUM")
    assert sorted(map(str, open_rows.collect())) == ["Row(Measure='m', y='b_c', a=2.0, a_b=None)", "Row(Measure='m', y='c', a=4.0, a_b=1.0)", "Row(Measure='m', y=None, a=8.0, a_b=None)"]


def test_literals_stay_as_they_are(spark, catalog):
    sql = "SELECT t.Perioden AS p, 'x . y' AS a, 'p .q' AS b, 'a''b' AS c, 1.5 AS d FROM '85302NED.parquet' AS t WHERE t . Seizoen = 'T001047' AND t.Perioden <> ' . '"
    got = rows(run_sql(sql, spark, catalog))
    assert [(r["p"], r["a"], r["b"], r["c"], float(r["d"])) for r in got] == [("2021JJ00", "x . y", "p .q", "a'b", 1.5), ("2022JJ00", "x . y", "p .q", "a'b", 1.5)]


def test_group_stays_when_its_codes_do_not_occur(spark):
    df = spark.createDataFrame([("g1", "A", 1.0), ("g2", "B", 2.0)], "g string, d string, m double")
    got = rows(C.pivoted(C.long_form(df, ["g", "d"], ["m"]), ["Measure", "g"], {"d": ["A"]}))
    assert [(r["g"], r["A"]) for r in got] == [("g1", 1.0), ("g2", None)]


def test_present(spark, catalog):
    cube = catalog["85302NED"]
    got = P.present(run(V.replace("2022JJ00", "2029JJ00"), catalog, "pivot"), cube.units, cube.labels)
    assert one(got) == {"Measure": "Totaal vakanties", "Unit": "x 1 000", "2021 | Totaal": 31685.0}
    assert P.split_name("D006211_2_T001047") == ("D006211_2", "T001047") and P.split_name("A_F") == ("A_F",)
    assert P.column_names(["T001047_2021JJ00"], {"Seizoen": ["T001047"]})[0].dims == ("Seizoen", None)
    df = spark.createDataFrame([("a;b", 1, 2)], "Measure string, X int, X_1 int")
    assert P.drop_repeats(df).columns == ["Measure", "X"]
    assert one(P.label_cells(df, ["Measure"], {"a": "Alpha"}))["Measure"] == "Alpha;b"
    assert one(P.with_units(df, {"a": Unit(text="kg"), "b": Unit(text="m")}))["Unit"] == "kg, m"
    assert "Alpha" in P.grid(P.label_cells(df, ["Measure"], {"a": "Alpha"}))
    assert cube_of("t", df).measures == ("X", "X_1")
    assert P.indexed(df, ["X"]).columns[0] == "X"
    with pytest.warns(P.FormatWarning):
        P.indexed(df.drop("Measure"), ["nope"])


def test_texts_taken_apart():
    pivot = "SELECT * FROM (SELECT Measure, Value, d FROM 'T.parquet' UNPIVOT(Value FOR Measure IN ('m'))) PIVOT({}(Value) FOR d IN ('a') e IN ('b') {})"
    assert components(pivot.format("SUM", ""))["pivot"] == components(pivot.format("MAX", ""))["pivot"]
    got = components("SELECT SUM(x) AS s, y FROM t WHERE a = 'q' AND b IN ('r', 's') GROUP BY y ORDER BY y DESC")
    assert got["select"] == {("sum", "x"), ("y",)} and got["where"] == {("a", "=", "'q'".strip("'")), ("b", "in", "r"), ("b", "in", "s")}
    assert got["group"] == {"y"} and got["order"] == {("y", "desc")}
    kinds = [sql_question_type(t) for t in (pivot.format("MAX", ""), pivot.format("MAX", "GROUP BY Measure"), "select a/b from t", "select a from t join u", "select sum(a) from t join u", "select avg(a) from t", "select (a from t")]
    assert kinds == ["VALUE", "MAX", "PROP", "JOIN", "AGGJOIN", "AVG", None]
