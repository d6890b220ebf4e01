"""Operators 2, 4 and 6 and the pipeline against brute force."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import embedding_dedup, mixing, ngram_join, shared, substring_dedup
from tessera.llm.hnsw import Graph
from tessera.llm.shared import components, stored
from tessera.llm.shingles import Words, shingle_set


def words_of(t):
    return (t or "").encode().lower().split()


def sets_of(rows, n=5):
    out = {}
    for i, t in rows:
        w = words_of(t)
        k = min(n, len(w))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    return out


def reach(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def near_copies(seed, families=6, copies=14):
    rng = random.Random(seed)
    rows = []
    shared = " ".join(f"p{k}" for k in range(60))
    for f in range(families):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 12, 40, 90, 200]))]
        for c in range(copies):
            cut = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 18))):
                cut[rng.randrange(len(cut))] = f"e{rng.randrange(10**6)}"
            if c % 5 == 0:
                cut = cut[: max(1, len(cut) - rng.randrange(0, len(cut) // 4 + 1))]
            rows.append((len(rows), " ".join(cut) + (" " + shared if f % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize("threshold, frequent", [(Fraction(4, 5), 3), (Fraction(4, 5), 64), (Fraction(1, 2), 3), (Fraction(1), 2)])
def test_ngram_join_finds_every_link(spark, monkeypatch, threshold, frequent):
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = near_copies(int(frequent))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(docs, threshold=threshold, frequent=frequent).collect()}
    sets = sets_of(rows)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    want = reach(sets, links)
    assert len({want[i] for i in want}) < len(rows)
    for i in sets:
        assert got[i]["n_shingles"] == len(sets[i]) and got[i]["component_id"] == want[i]


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for t in (Fraction(4, 5), Fraction(2, 3), Fraction(9, 10)):
        for _ in range(300):
            n = int(rng.integers(2, 60))
            x = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
            y = x[rng.random(len(x)) < rng.uniform(0.75, 1)]
            y = np.unique(np.r_[y, rng.integers(0, 1 << 62, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)])
            same = len(np.intersect1d(x, y))
            if not len(y) or np.array_equal(x, y) or same * t.denominator < (len(x) + len(y) - same) * t.numerator:
                continue
            often = np.uint64(int(rng.integers(0, 1 << 62)))  # tokens over a bound are frequent, those in both are shared
            in_both = np.intersect1d(x, y)
            a, b = (ngram_join.prefix(z, np.isin(z, in_both), z > often, t) for z in (x, y))
            assert len(np.intersect1d(a, b)), (t, x, y)


def test_ngram_join_on_odd_rows(odd_docs, odd_rows, no_docs):
    got = ngram_join.ngram_join(odd_docs).collect()
    assert len(got) == len(odd_rows) and ngram_join.ngram_join(no_docs).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[40]["n_shingles"] == by[41]["n_shingles"] == by[42]["n_shingles"] == 0
    assert by[43]["component_id"] == by[44]["component_id"] == by[45]["component_id"] == 6
    assert by[40]["component_id"] == 40 and by[None]["component_id"] is None


def test_word_hashes_agree_with_words():
    w = Words()
    texts = ["a b  c\ta", "A B c a", " ", "", "ab c", "a bc", "É é", "x" * 100_000 + " y"]
    seen = {}
    for t in texts:
        hashes = w(t)
        assert len(hashes) == len(words_of(t))
        for h, word in zip(hashes.tolist(), words_of(t), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(shingle_set(w("a b c d e f a b c d e f"), 5)) == len(sets_of([(0, "a b c d e f a b c d e f")])[0])


@pytest.mark.parametrize("forest", [10**6, 40])
def test_components(spark, monkeypatch, forest):
    monkeypatch.setattr(shared, "FOREST", forest)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500 + k) for k in range(80)]
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == reach(nodes, [e for e in edges if e[0] != e[1]])
    assert components(df.limit(0)).count() == 0
    names = components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")).collect()
    assert {r["node"]: r["component"] for r in names} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


# -- substrings --------------------------------------------------------------------------------------------------------


def test_substrings_are_found(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage, long_one = fresh(60), fresh(120)
    fuzzy = list(long_one)
    for k in (20, 55, 90):
        fuzzy[k] = "changed"
    del fuzzy[70]
    short = fresh(40)
    rows = {0: fresh(30) + passage + fresh(20), 1: fresh(5) + passage, 2: passage + fresh(9), 3: fresh(7) + long_one + fresh(3), 4: fuzzy + fresh(80),
            5: fresh(200), 6: fresh(30) + short, 7: short + fresh(30), 8: fresh(70), 9: None, 10: ""}
    rows = {k: None if v is None else " ".join(v) for k, v in rows.items()} | {11: None}
    rows[12] = rows[8].upper().replace(" ", "\n")
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = substring_dedup.substring_dups(docs).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in got}
    assert {(1, 0), (2, 0)} <= pairs and (4, 3) in pairs and (12, 8) in pairs
    assert not {5, 6, 7, 9, 10, 11} & {x for p in pairs for x in p}
    by = {(r["doc_id"], r["other_id"]): r for r in got}
    assert (by[1, 0]["start"], by[1, 0]["end"], by[1, 0]["other_start"], by[1, 0]["other_end"], by[1, 0]["matched"]) == (5, 65, 30, 90, 60)
    assert (by[4, 3]["start"], by[4, 3]["end"], by[4, 3]["other_start"], by[4, 3]["other_end"]) == (0, 119, 7, 127)
    assert by[4, 3]["matched"] == 116


def test_substrings_of_many_documents(spark):
    rng = random.Random(6)
    passage = [f"q{k}" for k in range(55)]
    rows = []
    for k in range(120):
        own = [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(20, 90))]
        at = rng.randrange(len(own))
        rows.append((k, " ".join(own[:at] + (passage if k % 2 else []) + own[at:])))
    got = substring_dedup.substring_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x for r in got for x in (r["doc_id"], r["other_id"])} == set(range(1, 120, 2))
    assert len(got) <= 2 * 60


def test_passages_apart_are_all_found(spark):
    rng = random.Random(14)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for k, (size, gap) in enumerate([(60, 40), (60, 65), (60, 90), (200, 130), (200, 240), (200, 350)]):
        p, q = fresh(size), fresh(size)
        for j in (0, 1):
            rows.append((2 * k + j, " ".join(fresh(7 + j) + p + fresh(gap) + q + fresh(9))))
        at = 8 + size + gap
        want |= {(2 * k + 1, 8, 8 + size), (2 * k + 1, at, at + size)}
    got = substring_dedup.substring_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want == {(r["doc_id"], r["start"], r["end"]) for r in got}


def test_ends_go_on_over_changed_words(spark):
    rng = random.Random(15)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(20):
        p = fresh(60)
        q = [*p[:12], "changed", *p[13:48], "changed", *p[49:]]
        rows += [(2 * k, " ".join(fresh(9) + p + fresh(5))), (2 * k + 1, " ".join(fresh(4) + q + fresh(8)))]
    got = substring_dedup.substring_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["matched"]) for r in got) == [(2 * k + 1, 4, 64, 58) for k in range(20)]


def test_passages_of_frequent_lines_are_found(spark):
    rng = random.Random(16)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    one, two = fresh(30), fresh(30)
    parts = {0: one, 1: two, 2: one[10:] + two[:20], 10: one + two, 11: one + two, 20: one, 21: two, 22: one[10:] + two[:20]}
    docs = spark.createDataFrame([(k, " ".join(fresh(9) + p + fresh(12))) for k, p in parts.items()], "doc_id long, text string")
    got = [(r["doc_id"], r["other_id"], r["start"], r["end"]) for r in substring_dedup.substring_dups(docs).collect()]
    assert got == [(11, 10, 9, 69)]


def test_passage_among_holders_of_its_parts(spark):
    rng = random.Random(17)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(60)
    rows = []
    for k in range(48):
        at = rng.randrange(46)
        rows.append((k, " ".join(fresh(40) + (passage if k in (23, 24) else passage[at : at + 15]) + fresh(30))))
    got = substring_dedup.substring_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start, r.end, r.other_id, r.other_start, r.other_end, r.matched) for r in got] == [(24, 40, 100, 23, 40, 100, 60)]


def test_rows_follow_the_words_that_repeat(spark):
    rng = random.Random(21)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    whole = fresh(300)
    texts = [fresh(5) + whole + fresh(5)]
    for _ in range(40):
        at = rng.randrange(220)
        texts.append(fresh(30) + whole[at : at + rng.randrange(60, 80)] + fresh(30))
    texts.append(fresh(9) + whole + fresh(9))
    got = substring_dedup.substring_dups(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {x for r in got for x in (r.doc_id, r.other_id)} == set(range(42)) and {r.component_id for r in got} == {0}
    assert len(got) <= 42


def test_substrings_match_brute_force(spark):
    rng = random.Random(18)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    parts = [fresh(n) for n in (12, 15, 20, 25, 30, 35, 40, 48, 55, 60, 75, 90, 140)]
    texts = []
    for _ in range(150):
        text = fresh(rng.randrange(20))
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(parts)
            a = rng.choice([0, 0, 0, rng.randrange(len(p))])
            text += p[a : rng.choice([len(p), len(p), rng.randrange(a, len(p)) + 1])] + fresh(rng.choice([0, 0, 3, 30]))
        texts.append(text)
    least = substring_dedup.LEAST + substring_dedup.WINDOW - 1
    holders = {}
    for i, t in enumerate(texts):
        for a in range(len(t) - least + 1):
            holders.setdefault(tuple(t[a : a + least]), set()).add(i)
    got = substring_dedup.substring_dups(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    told = [set() for _ in texts]
    for r in got:
        told[r.doc_id] |= set(range(r.start, r.end))
        told[r.other_id] |= set(range(r.other_start, r.other_end))
        assert substring_dedup.matches(*(np.array([hash(w) for w in t]) for t in (texts[r.doc_id][r.start : r.end], texts[r.other_id][r.other_start : r.other_end]))) >= r.matched
        assert r.matched >= 0.8 * max(r.end - r.start, r.other_end - r.other_start) and min(r.end - r.start, r.other_end - r.other_start) >= 50
    runs = [(i, a) for i, t in enumerate(texts) for a in range(len(t) - least + 1) if len(holders[tuple(t[a : a + least])]) > 1]
    assert len(runs) > 500 and all(set(range(a, a + least)) <= told[i] for i, a in runs)


def test_recall_of_changed_passages(spark):
    rng = random.Random(19)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], Counter()
    for rate in (0.02, 0.05, 0.1):
        for size in (60, 100, 300):
            for _ in range(20):
                p = fresh(size)
                changed = [w for x in p for w in ([x], ["new"], [], [x, "more"])[rng.choices(range(4), (1 - rate, 0.6 * rate, 0.2 * rate, 0.2 * rate))[0]]]
                rows += [(len(rows), " ".join(fresh(30) + p + fresh(30))), (len(rows) + 1, " ".join(fresh(20) + changed + fresh(25)))]
                want[rate, len(rows) - 1] = 1
    got = {r.doc_id for r in substring_dedup.substring_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for rate, least in ((0.02, 0.98), (0.05, 0.95), (0.1, 0.9)):
        ids = [i for x, i in want if x == rate]
        assert np.mean([i in got for i in ids]) >= least, rate
    assert got <= {i for _, i in want}


def test_substrings_of_odd_rows(odd_docs, no_docs):
    got = substring_dedup.substring_dups(odd_docs).collect()
    assert {(43, 6), (44, 6), (45, 6)} <= {(r["doc_id"], r["other_id"]) for r in got}
    assert substring_dedup.substring_dups(no_docs).count() == 0


def test_long_gaps_part_chains():
    chain = np.array([[0, 60, 5, 65], [80, 140, 85, 145], [2000, 2060, 160, 220], [5000, 5060, 3000, 3060]])
    assert [len(x) for x in substring_dedup.parted(chain)] == [3, 1]
    rng = np.random.default_rng(20)
    a, b = rng.integers(0, 10**9, 20_000), rng.integers(0, 10**9, 20_000)
    assert substring_dedup.matches(a, b) == 0 and substring_dedup.matches(np.r_[a, b], np.r_[b, a]) == 20_000


def test_chains_are_best():
    rng = random.Random(8)
    for _ in range(60):
        blocks = sorted({(x := rng.randrange(60), x + (n := rng.randrange(4, 9)), y := rng.randrange(60), y + n) for _ in range(rng.randrange(1, 8))})
        b = np.array(blocks)

        def score(chain, b=b):
            own = sum(min(b[i][1] - b[i][0], b[i][3] - b[i][2]) for i in chain)
            return own - 0.25 * sum((b[j][0] - b[i][1]) + (b[j][2] - b[i][3]) for i, j in zip(chain, chain[1:], strict=False))

        def best(chain, b=b):
            out = [score(chain)]
            for j in range(chain[-1] + 1, len(b)):
                if b[j][0] >= b[chain[-1]][1] and b[j][2] >= b[chain[-1]][3]:
                    out.append(best([*chain, j]))
            return max(out)

        got = substring_dedup.chains(b, 0.25)
        assert sorted(i for c in got for i in c) == list(range(len(b)))
        assert abs(score(got[0]) - max(best([i]) for i in range(len(b)))) < 1e-9


def test_matches_is_the_longest_common_subsequence():
    rng = np.random.default_rng(9)
    for _ in range(50):
        a, b = rng.integers(0, 5, int(rng.integers(0, 12))), rng.integers(0, 5, int(rng.integers(0, 12)))
        t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert substring_dedup.matches(a, b) == t[-1, -1]


# -- embeddings --------------------------------------------------------------------------------------------------------


def clustered(n=900, width=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, width))
    return centres[rng.integers(0, 30, n)] + rng.normal(size=(n, width)) * rng.choice([0.05, 0.2, 0.5], n)[:, None]


def test_graph_recall():
    x = clustered()
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = Graph(x)
    truth = x @ x.T >= 0.93
    q, v, _ = g.search(x, 0.93, 32)
    found = np.zeros_like(truth)
    found[q, v] = True
    assert (found & truth).sum() / truth.sum() >= 0.97
    assert len(Graph(x[:1]).search(x[:1], 0.9, 8)[0]) == 1


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 150)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    x = clustered(420, 16)
    rows = [(k, x[k].tolist(), k % 3) for k in range(400)]
    rows += [(400 + k, x[5].tolist(), 5 % 3) for k in range(25)]  # one common vector
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] + [1.0] * 15, 0), (503, [None] + [1.0] * 15, 0), (504, x[0].tolist(), None), (505, [float("inf")] + [1.0] * 15, 1), (506, [], 0), (507, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_dups(df).collect()}
    assert len(got) == len(rows)
    good = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if i < 500}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and good[a][0] @ good[b][0] >= 0.93]
    count = dict.fromkeys(got, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert sum(got[i]["n_links"] for i in got) >= 0.97 * 2 * len(links)
    assert all(got[i]["n_links"] <= count[i] for i in got)
    want = reach(got, links)
    assert np.mean([got[i]["component_id"] == want[i] for i in got]) >= 0.97
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    assert embedding_dedup.near_dups(df.limit(0)).count() == 0


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1.0, 1.0], 0), (3, [1e-200, 1e-200], 0), (4, [1.0, 0.01], 0), (5, [5e-324, 5e-324], 0), (6, [1.7e308, 1e292], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (1, 4), 6: (1, 4)}


def test_hot_keys_meet_their_row(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 3 if k < 60 else k, k) for k in range(90)] + [(None, 99)], "k long, v long")
    one = stored(rows.groupBy("k").count().withColumnRenamed("count", "weight").withColumn("twice", F.col("weight") * 2))
    for least in (5, 1000):
        monkeypatch.setattr(shared, "HOT_ROWS", least)
        got = shared.with_key(rows, one, ["k"]).collect()
        assert sorted((r.v, r.twice) for r in got) == [(k, 40 if k < 60 else 2) for k in range(90)]


def test_intermediate_tables_need_a_shared_folder():
    class Remote:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Remote())


# -- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "ngram_join", "mixing", "packing"]
    kept, columns = docs, docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = stored(stage(spark, kept, sf_dir))
        after = [r for r in kept.collect()]
        assert kept.columns == columns and {r.doc_id for r in after} <= before.keys()
        if name == "quality":
            good = [i for i, q in labels.items() if q == 1]
            assert np.mean([i in {r.doc_id for r in after} for i in good]) > 0.9
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(before[i].text, i)
            assert sorted(r.doc_id for r in after) == sorted(first.values())
        if name == "ngram_join":
            sets = sets_of([(i, r.text) for i, r in before.items()])
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            assert sorted(r.doc_id for r in after) == sorted(set(reach(sets, links).values()))
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    n = kept.select(F.sum(F.lit(1))).first()[0]
    assert out.where("piece = 0").count() == n


def test_stages_take_odd_rows_and_clashing_names(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 1), (6, 1, None), (None, 1, 1), (7, 0, 1), (40, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, ids = odd_docs, {r.doc_id for r in odd_docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0, name
        out = stage(spark, odd_docs, str(tmp_path))
        rows = out.collect()
        assert {r.doc_id for r in rows} <= ids and (name == "packing" or out.columns == docs.columns), name
        if name == "exact_dedup":
            assert len(rows) == len({r.text or "" for r in odd_docs.collect()})
        if name == "packing":
            assert len(rows) >= odd_docs.count()
    hidden = odd_docs.withColumn("extra", F.create_map(F.lit("a"), F.lit(1)))
    twice = hidden.unionByName(hidden)
    assert corpus_pipeline.exact_stage(spark, twice, str(tmp_path)).count() == corpus_pipeline.exact_stage(spark, odd_docs, str(tmp_path)).count()
    assert corpus_pipeline.mix_stage(spark, twice, str(tmp_path)).columns == twice.columns


def test_stages_keep_repeated_rows_and_null_ids(spark, sf_dir):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "d e f g", "s"), (3, "d e f g", "t"), (3, "own text", "t"), (None, "n one", "s"),
            (None, "n two x", "s"), (None, "a b c", "s"), (4, None, "t"), (4, "", "t"), (5, "k l m n o", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text or "", r.source) for r in corpus_pipeline.exact_stage(spark, docs, sf_dir).collect()]
    want = [(1, "a b c", "s"), (2, "d e f g", "s"), (3, "own text", "t"), (4, "", "t"), (5, "k l m n o", None), (None, "n one", "s"), (None, "n two x", "s")]
    assert sorted(got, key=str) == sorted(want, key=str)

    plan = mixing.mix(docs, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0).collect()
    times = sum(round(r.taken / r.size) for r in plan if r.size)
    mixed = [(r.doc_id, r.text) for r in corpus_pipeline.mix_stage(spark, docs, sf_dir).collect()]
    by_id = Counter()
    for r in plan:
        by_id[r.doc_id] += round(r.taken / r.size) if r.size else 0
    assert len(mixed) == times and Counter(i for i, _ in mixed) == +by_id
    sizes = Counter()
    for r in plan:
        sizes[r.doc_id, r.size] += round(r.taken / r.size) if r.size else 0
    assert Counter((i, len(t.split())) for i, t in mixed) == +sizes
