"""Parser, typed tree, printer, question types."""

import pytest

from tessera.functions import sexpr as S
from tessera.functions.units import Unit, UnitCompatibilityError, check, normalise, verdicts

VALUE = "(VALUE 85302NED (MSR (D004645)) (DIM Perioden (2021JJ00 2022JJ00)) (DIM BestemmingEnSeizoen (T001047)))"


def test_parse_gives_nested_lists():
    assert S.parse('(A (b "c d" ()) e) f') == [["A", ["b", "c d", []], "e"], "f"]
    assert S.parse(VALUE) == [["VALUE", "85302NED", ["MSR", ["D004645"]], ["DIM", "Perioden", ["2021JJ00", "2022JJ00"]], ["DIM", "BestemmingEnSeizoen", ["T001047"]]]]


@pytest.mark.parametrize("text", ["(A (b)", "A)", "((", ")"])
def test_brackets_must_match(text):
    with pytest.raises(AssertionError):
        S.parse(text)


@pytest.mark.parametrize("text", [VALUE, f"(SUM () {VALUE})", f"(MAX (Perioden) {VALUE})", f"(PROP (DIM Perioden (2021JJ00)) {VALUE})", f"(JOIN (Perioden) {VALUE} {VALUE})", "(VALUE t (MSR (m >= 2.5)) (DIM g ()))"])
def test_show_and_read_are_inverse(text):
    e = S.read(text)
    assert S.show(e) == text and S.read(S.show(e)) == e


@pytest.mark.parametrize(
    "text, error",
    [
        ("(VALUE t (MSR ()))", SyntaxError), ("(VALUE t (MSR (m < x)))", ValueError), ("(VALUE t (MSR (m n < 3)))", TypeError), ("(FOO x)", SyntaxError),
        ("(SUM (z) (VALUE t (MSR (m)) (DIM g (a))))", ValueError), ("(JOIN () (VALUE t (MSR (m))))", SyntaxError), ("(JOIN (g) (SUM () (VALUE t (MSR (m)))))", SyntaxError),
        ("(SUM (g) (JOIN (g) (VALUE t (MSR (m)) (DIM g (a)))))", NotImplementedError), ("(VALUE t (MSR (m)) (DIM g))", SyntaxError), ("(SUM () (SUM () (VALUE t (MSR (m)))))", SyntaxError),
    ],
)
def test_forms_that_are_not_in_the_language(text, error):
    with pytest.raises(error):
        S.read(text)


def test_names_of_tables_codes_and_kinds():
    join = f"(SUM () (JOIN (M) {VALUE} (VALUE 84957NED (MSR (M > 3)) (DIM P ()))))"
    assert S.table_ids(join) == ["85302NED", "84957NED"]
    assert S.table_ids("select 1 from 'a/b/X1.parquet' join 'Y2.parquet'") == ["X1"]
    assert S.golden_codes(join)[:3] == ["D004645", "Perioden", "2021JJ00"] and "3" not in S.golden_codes(join)
    assert [S.question_type(t) for t in (VALUE, f"(MIN () {VALUE})", f"(JOIN (P) {VALUE})", join, f"(PROP (DIM P (a)) {VALUE})")] == ["VALUE", "MIN", "JOIN", "AGGJOIN", "PROP"]
    assert "'2021'" in S.friendly(S.read(VALUE), {"2021JJ00": "2021"})


def test_units():
    euro, k = Unit("EURO", 1.0), Unit("EURO", 1000.0)
    check({"a": euro, "b": k})
    check({"a": euro, "b": Unit()}, allow_scaling=False)
    for units, scaling, words in (
        ({"a": euro, "b": k}, False, "different conversion multipliers"), ({"a": euro, "b": Unit("KG", 1.0)}, True, "measures with a different unit"),
        ({"a": euro, "b": Unit("PERCENT")}, True, "two or more measures with a dimensionless unit"),
    ):
        with pytest.raises(UnitCompatibilityError, match=words):
            check(units, scaling)
    check({"a": Unit("TON", 1.0, scaling_of="GRAM"), "b": Unit("KG", 1.0, scaling_of="GRAM")})
    with pytest.warns(UserWarning, match="counts"):
        check({"a": Unit("COUNT", 1.0), "b": Unit("COUNT", 1.0)})
    assert normalise("x 1 000").multiplier == 1000 and normalise("x 1 000").unit == "COUNT"
    assert (normalise("1 000 euro").unit, normalise("mln kg").multiplier, normalise("%").unit) == ("EURO", 1e6, "PERCENT")
    for text in ("2015 = 100", "volume-index 2021=100", "per 1 000 inwoners", "euro/inwoner", "1000 TEU", "zie eenheid"):
        assert (normalise(text).unit, normalise(text).multiplier) == (None, None), text
    for text, unit, multiplier in (
        ("x mln ton", "TON", 1e6), ("x 1, 000", "COUNT", 1e3), ("x 1.000", "COUNT", 1e3), ("1000m3", "M3", 1e3), ("Mln tonkilometer", "TON-KM", 1e6), ("% van bedrijven", "PERCENT", 1.0),
        ("in % bbp", "PERCENT", 1.0), ("‰", "PERMILLE", 1.0), ("km²", "KM2", 1.0), ("x 1 000 arbeidsjaren", "YEAR", 1e3), ("billion passenger kilometres ", "KM", 1e9), ("Number", "COUNT", 1.0),
    ):
        assert (normalise(text).unit, normalise(text).multiplier) == (unit, multiplier), text


def test_verdicts_say_what_check_does(spark):
    import itertools
    import warnings

    kinds = [Unit(), Unit("COUNT", 1.0), Unit("COUNT", 1000.0), Unit("EURO", 1.0), Unit("EURO", 1000.0), Unit("PERCENT", 1.0), Unit(None, 1000.0), Unit("KG", 1.0, "GRAM"), Unit("TON", 1.0, "GRAM"), Unit("GRAM", None)]
    groups = list(itertools.combinations_with_replacement(kinds, 2)) + list(itertools.combinations(kinds, 3))
    rows = [(g, u.unit, u.multiplier, u.scaling_of) for g, us in enumerate(groups) for u in us]
    df = spark.createDataFrame(rows, "g int, unit string, multiplier double, scaling_of string")
    words = {"dimensionless": "dimensionless", "multipliers": "conversion multipliers", "units": "different unit"}
    for scaling in (True, False):
        got = {r.g: r.verdict for r in verdicts(df, ["g"], scaling).collect()}
        for g, us in enumerate(groups):
            with warnings.catch_warnings(record=True) as said:
                warnings.simplefilter("always")
                try:
                    check({str(k): u for k, u in enumerate(us)}, scaling)
                    want = "counts" if said else "ok"
                except UnitCompatibilityError as e:
                    want = next(k for k, w in words.items() if w in str(e))
            assert got[g] == want, (us, scaling)
