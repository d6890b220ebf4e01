import random

import pytest

WORDS = [f"w{k}" for k in range(400)]


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty, blank and long texts, ties, repeats, in four languages' letters."""
    rng = random.Random(5)
    base = [" ".join(rng.choices(WORDS, k=n)) for n in (1, 3, 4, 5, 6, 30, 80, 200, 3000)]
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(base)]
    near = base[7].split()
    for k in range(6):
        cut = list(near)
        for _ in range(k * 3):
            cut[rng.randrange(len(cut))] = "x" + str(rng.random())
        rows.append((20 + k, " ".join(cut), "en", "s0"))
    rows += [(40, None, None, None), (41, "", "en", "s1"), (42, " \n\t ", "en", "s1"), (43, base[6].upper(), "en", None), (44, base[6], "fr", "é")]
    rows += [(45, base[6], "fr", "s2"), (None, base[5], "en", "s1"), (46, "É un été\u00a0çà", "fr", "s1")]
    return rows


@pytest.fixture()
def odd_docs(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string")
    names = "h size row part n s c id component count _id _at _row _hash _sha _source _size _place _nth _again sha at ats again weight kept key score label place p_id k x y a b".split()
    extra = {c: df["lang"] for c in names}
    return df.withColumns(extra)  # names that operators might use themselves


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
