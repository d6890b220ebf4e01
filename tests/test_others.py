"""Metrics, sources, retrieval, streams, and the driver contract."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions.sexpr import read
from tessera.operators import metrics as M
from tessera.operators import retrieval as R
from tessera.sources import io, odata
from tessera.streaming.cubes import period_cube


def frame(spark, **columns):
    kinds = {str: "string", float: "double", int: "long"}
    kind = lambda v: next((kinds[type(x)] for x in v if x is not None), "double")
    schema = ", ".join(f"{k} {kind(v)}" for k, v in columns.items())
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema)


def test_record_accuracy(spark):
    f = lambda **c: frame(spark, **c)
    truth = f(A=[1, 2], B=[3, 4])
    wide = f(A=[1, 2, 3], B=[4, 5, 6])
    for given, want in (
        (truth, 1), (f(A=[5, 6], B=[7, 8]), 0), (f(X=[4, 3], Y=[2, 1]), 1), (f(A=[1, 3], B=[2, 4]), 0), (truth.limit(0), 0),
    ):
        assert M.record_accuracy_either_way(truth, given) == want
    assert M.record_accuracy_either_way(wide, f(A=[1], B=[4])) == pytest.approx(1 / 3)
    assert M.record_accuracy_either_way(wide, f(A=[1, 4], B=[2, 5], C=[3, 6])) == 1
    assert M.record_accuracy_either_way(truth.limit(0), truth) == 0 and M.record_accuracy_either_way(truth.limit(0), truth.limit(0)) == 1
    assert M.record_accuracy_either_way(f(A=[1, 1, 2], B=[3, 3, 4]), f(A=[1, 2], B=[3, 4])) == pytest.approx(2 / 3)
    assert M.record_accuracy_either_way(f(A=[1.0, None], B=[3.0, 4.0]), f(A=[1.0, 4.0], B=[3.0, None])) == 1


def test_numeric_recall_and_equality(spark):
    f = lambda **c: frame(spark, **c)
    recall = lambda a, b: M.numeric_recall(a, b).first()[0]
    assert recall(f(A=[1, 2], B=[3, 4]), f(A=[1, 3], B=[9, 9])) == 0.5
    assert recall(f(A=[1, 1, 2]), f(A=[1, 2, 3])) == pytest.approx(2 / 3)
    assert recall(f(A=["foo"]), f(A=["foo"])) == 1 and recall(f(A=["foo"]), f(A=[1])) == 0
    assert M.lenient_equal(f(A=[1, 2], B=["x", "y"]), f(B=["y", "x"], C=[1.0, 2.0])).first()[0] == 1
    assert M.strict_equal(f(A=[1, 2], B=["x", "y"]), f(B=["y", "x"], A=[2, 1])).first()[0] == 1
    assert M.strict_equal(f(A=[1, 2]), f(A=[1, 1])).first()[0] == 0 and M.strict_equal(f(A=[1]), f(B=[1])).first()[0] == 0
    assert M.component_f1({"a": {1, 2}, "b": set()}, {"a": {2, 3}, "b": set()}) == {"a": 0.5, "b": 1.0}
    assert M.exact_match("SELECT  a\nFROM t", "select a from t")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("q", "(VALUE t (MSR (m)))", "s", None)], io.QA)
    io.write_json(df, str(tmp_path / "qa"))
    assert io.read_questions(spark, str(tmp_path / "qa")).first().sexp == "(VALUE t (MSR (m)))"
    docs = spark.createDataFrame([(f"n{k:02}", f'a\t"b"\n{k}') for k in range(20)], "node string, body string").repartition(3)
    rows = io.collection(docs, "node", "body")
    assert [(r.pid, r.node) for r in rows.orderBy("pid").collect()] == [(k, f"n{k:02}") for k in range(20)]
    io.write_tsv(rows, str(tmp_path / "c"))
    back = io.read_tsv(spark, str(tmp_path / "c"), "pid long, node string, body string").orderBy("pid").collect()
    assert back[3].body == 'a "b" 3' and len(back) == 20
    (tmp_path / "g.nq").write_text('<http://a> <http://p> "x \\"y\\""@nl <http://g> .\n# no\n_:b <http://p> <http://c> .\n')
    got = {tuple(r) for r in io.read_ntriples(spark, str(tmp_path / "g.nq")).collect()}
    assert got == {("http://a", "http://p", 'x \\"y\\"', "http://g"), ("_:b", "http://p", "http://c", "")}


def test_odata(spark):
    v = read("(VALUE 1ENG (MSR (m1 m2)) (DIM g (a b)) (DIM h ()))")
    assert "substringof" in odata.v3_url("http://h", v) and "$select=g,h,m1,m2" in odata.v3_url("http://h", v)
    assert "Measure%20in" in odata.v4_url("http://h", v)
    pages = {"http://x.org/1": (200, {"value": [{"g": "a", "h": "k", "m1": 1, "m2": None}], "@odata.nextLink": "http://x.org/2"}), "http://x.org/2": (200, {"value": [{"g": "ab", "h": "k", "m1": 5}]})}
    busy = iter([429])

    def fetch(url, timeout):
        return (next(busy, 0), {}) if (status := next(busy, None)) else pages[url] if status is None else None

    got = odata.rows("http://x.org/1", lambda u, t: pages[u], ["x.org"])
    assert len(got) == 2
    assert [tuple(r) for r in odata.long_rows(spark, v, got).collect()] == [("a", "k", "m1", 1.0)]
    with pytest.raises(PermissionError):
        odata.get("http://evilx.org", fetch, ["x.org"])
    with pytest.raises(odata.Busy):
        odata.get("http://x.org", lambda u, t: (429, {}), ["x.org"], tries=2, wait=0)
    assert odata.get("http://x.org", lambda u, t: (404, {}), ["x.org"]) is None
    assert odata.code_parts("2007KW04") == ("2007", "KW", "04")


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "green")], "id long, text string")
    ask = spark.createDataFrame([(7, "the red fox")], "qid long, query string")
    got = R.top_k(R.bm25(docs, ask), 5).collect()
    assert [r.id for r in got] == [1, 2]
    split = R.group_split(spark.range(500).select((F.col("id") % 50).alias("g")), "g")
    assert split.distinct().count() == 50 and 0 < split.where("fold = 'test'").count() < 150
    assert spark.range(1).select(R.query_tokens(F.lit("The Walking dogs"), stemmed=True)).first()[0] == ["walk", "dog"]
    nodes = spark.createDataFrame([("t", "measure", "m", None, 0.5), ("t", "dimension", "g", None, 0.2), ("t", "code", "c", "g", 0.9), ("t", "code", "z", None, 0.05)], "table string, kind string, node string, parent string, score double")
    assert [r.node for r in R.prompt_order(nodes).orderBy("place").collect()] == ["m", "g", "c"]


def test_english_stems(spark):
    from tessera.functions.stemmer import english

    pairs = {
        "consigned": "consign", "consignment": "consign", "consistency": "consist", "consolation": "consol", "consolidating": "consolid", "knackeries": "knackeri", "knaves": "knave", "kneaded": "knead",
        "kneeling": "kneel", "generally": "general", "generate": "generat", "communication": "communic", "happily": "happili", "happy": "happi", "say": "say", "cries": "cri", "ties": "tie", "caresses": "caress",
        "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "hopping": "hop", "hoping": "hope", "luxuriating": "luxuri", "agreed": "agre", "feed": "feed", "relational": "relat", "conditional": "condit",
        "skies": "sky", "dying": "die", "proceed": "proceed", "succeeds": "succeed", "adoption": "adopt", "controll": "control", "rate": "rate", "by": "by", "news": "news", "yes": "yes", "sized": "size",
        "national": "nation", "statistics": "statist", "enterprises": "enterpris", "employees": "employe", "households": "household", "vacations": "vacat", "effective": "effect", "useful": "use",
    }
    assert {w: english(w) for w in pairs} == pairs
    got = spark.createDataFrame([("The Employees of national households",), (None,)], "q string").select(R.query_tokens(F.col("q"), stemmed="snowball")).collect()
    assert [r[0] for r in got] == [["employe", "nation", "household"], []]


def test_negatives(spark):
    golden = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "qid long, id long")
    have = spark.createDataFrame([(1, 12, 1), (1, 13, 2), (1, 14, 3), (2, 21, 1)], "qid long, id long, nth long")
    items = spark.range(10, 200)
    got = R.padded(have, items, golden, 3).collect()
    per = {q: sorted((r.nth, r.id) for r in got if r.qid == q) for q in (1, 2, 3)}
    assert all([n for n, _ in per[q]] == [1, 2, 3] and len({i for _, i in per[q]}) == 3 for q in per)
    assert per[1] == [(1, 12), (2, 13), (3, 14)] and per[2][0] == (1, 21)
    assert not {i for _, i in per[2]} & {20} and not {i for _, i in per[3]} & {30}
    assert sorted(map(tuple, got)) == sorted(map(tuple, R.padded(have, items.repartition(5), golden, 3).collect()))

    old = spark.range(1000).selectExpr("id as qid", "id + 1 as positive", "id + 2 as negative")
    new = spark.createDataFrame([(0, 1, 2), (5000, 1, 2), (5000, 1, 2)], "qid long, positive long, negative long")
    mixed = R.mixed_triples(new, old, share=0.3).collect()
    assert len(set(mixed)) == len(mixed) and 200 < len(mixed) < 400 and (5000, 1, 2) in mixed

    texts = spark.createDataFrame([(1, "births by region and year"), (2, "year and region, births by"), (3, "deaths by region"), (4, None)], "id long, body string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 9)], "positive long, negative long")
    assert sorted(map(tuple, R.unlike(pairs, texts).collect())) == [(1, 3), (1, 4), (1, 9)]


def test_prompts_and_responses(spark):
    system, user = R.prompt("How many?", [("T1", "Births", ["- Measure: M1 (label: \"Births\")"]), ("T2", "Deaths", [])])
    assert "JSON" in system and user.splitlines()[:3] == ["Table: T1 (Births)", "Nodes:", '- Measure: M1 (label: "Births")'] and user.endswith("Question: How many?")
    for raw, want in (
        ('{"query": "SELECT 1"}', "SELECT 1"), ('```json\n{"query": "a"}\n```', "a"), ('```\n{"query": "a"}\n```', "a"), ('so: {"query": "a {b}"} ok', "a {b}"), ('{"query": 3}', ""),
        ("{", ""), (None, ""), ("[1]", ""), ('{"other": "x"}', ""),
    ):
        assert R.response_query(raw) == want, raw


def test_collections_of_many_ranges(spark):
    rows = [(f"n{k % 700:03}", str(k)) for k in range(1000)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "id string, text string").repartition(4)
    got = io.collection(docs, "id", "text", part_rows=60).orderBy("pid").collect()
    assert [(r.pid, r.node, r.body) for r in got] == [(k, *r) for k, r in enumerate(sorted(rows, key=lambda r: (r[0] or "", r[1])))]


def test_answers_and_their_errors(spark):
    from tessera.plans.answers import answer, error_kind
    from tessera.sources.catalog import driver_catalog

    catalog = driver_catalog(spark, "/root/testdata/sf0.001")
    pivot = "SELECT *, 'x' AS Measure FROM (SELECT Value, Region, Segment FROM 'N.parquet' UNPIVOT(Value FOR Measure IN ({}))) PIVOT(SUM(Value) FOR Region IN ('ASIA', 'EUROPE') Segment IN ('BUILDING'))"
    kinds = {
        "(SUM () (VALUE N (MSR (Balance_1 Customers_2)) (DIM Region (ASIA)) (DIM Segment (BUILDING))))": "UnitCompatibilityError", pivot.format("Balance_1, Customers_2"): "UnitCompatibilityError",
        pivot.format("Balance_1"): "", "(VALUE N (MSR (Nope)))": "KeyError", "(VALUE N (MSR (Balance_1))": "BracketError", "SELECT nope FROM 'N.parquet'": "AnalysisException",
        "SELEC 1": "ParseException", "SELECT (1": "SqlError",
    }
    assert {t: error_kind(t, spark, catalog) for t in kinds} == kinds
    got = answer("(VALUE N (MSR (Balance_1)) (DIM Region (ASIA)) (DIM Segment (BUILDING)))", spark, catalog)
    assert got.columns == ["Measure", "Unit", "ASIA | BUILDING"] and got.first()[:2] == ("Balance", "euro")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = period_cube(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), delay="400 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("cube_rows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("cube_rows").collect())) == sorted(map(tuple, period_cube(events).collect()))


def test_entry_without_what_training_data_needs(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # its import then fails
    names = set(__spark_entry__.queries())
    assert len(names) > 90 and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(__spark_entry__.oracle_sql()) <= names


def test_driver_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 90 and set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0
