"""Operators 1, 3, 9 and 10 against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, pii, queries, shared, url_filter


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup_matches_brute_force(odd_docs, odd_rows):
    for keep, pick in (("largest", max), ("smallest", min)):
        got = rows_of(exact_dedup.exact_dedup(odd_docs, keep=keep))
        groups = defaultdict(list)
        for i, t, *_ in odd_rows:
            groups[t or ""].append(i)
        assert len(got) == len(odd_rows)
        by = {r["doc_id"]: r for r in got}
        for t, ids in groups.items():
            known = [i for i in ids if i is not None]
            for i in ids:
                assert by[i]["group_size"] == len(ids)
                assert by[i]["keep_id"] == (pick(known) if known else None)
                assert by[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_parts_colliding_hashes(odd_docs, odd_rows):
    weak = exact_dedup.exact_dedup(odd_docs, hash128=lambda c: F.substring(F.md5(c), 1, 1))
    strong = exact_dedup.exact_dedup(odd_docs)
    key = lambda r: (str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"])
    assert sorted(map(key, rows_of(weak)), key=str) == sorted(map(key, rows_of(strong)), key=str)


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "a")], "doc_id long, text string")
    got = rows_of(exact_dedup.exact_dedup(df, keep="largest"))
    assert [r["group_size"] for r in got] == [4] * 4 and sum(r["kept"] for r in got) == 1
    assert all(r["keep_id"] == 2 for r in got)


def test_empty_tables(no_docs, spark):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert pii.find_pii(no_docs).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(pages, url_filter.rule_table(spark, queries.URL_RULES)).count() == 0
    none = url_filter.rule_table(spark, [])
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert rows_of(url_filter.judge_urls(one, none))[0]["verdict"] == "allow"


def test_mix_meets_targets(odd_docs, odd_rows):
    got = rows_of(mixing.mix(odd_docs))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s in odd_rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = dict(zip(order, (5, 2, 1) * 9, strict=False))
    target, left, budget = {}, set(order), 1.5 * sum(sizes.values())
    while left:  # share out, cap, share the excess again
        level = budget / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level >= 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in left}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        left -= over
    assert len(got) == len(odd_rows)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert len(r["positions"]) == (0 if not r["taken"] else -(-r["taken"] // r["size"]))
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    again = rows_of(mixing.mix(odd_docs.repartition(3)))
    key = lambda r: (str(r["doc_id"]), r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_follows_a_schedule(spark):
    docs = spark.createDataFrame([(k, "a b c d", s) for k, s in enumerate(["x", "y"] * 200)], "doc_id long, text string, source string")
    early = mixing.schedule_table(spark, {"x": [(0.0, 2.0), (0.5, 2.0), (0.5, 0.0), (1.0, 0.0)], "y": [(0.0, 0.0), (1.0, 2.0)]})
    got = rows_of(mixing.mix(docs, weights=(1.0,), share=1.0, most=1.0, schedules=early))
    x = sorted(p for r in got if r["source"] == "x" for p in r["positions"])
    y = sorted(p for r in got if r["source"] == "y" for p in r["positions"])
    assert x[-1] <= 0.5 and abs(x[len(x) // 2] - 0.25) < 0.01
    assert abs(y[len(y) // 2] - 0.5**0.5) < 0.01  # half of the area under a rising line


def test_curves_keep_weights_and_order_the_mix(spark, odd_docs):
    flat, curved = (sorted((str(r.doc_id), r.target, r.taken) for r in mixing.mix(odd_docs, curves=c).collect()) for c in ((mixing.FLAT,), mixing.CURVES))
    assert flat == curved
    docs = spark.createDataFrame([(k, "a b c d", "xyz"[k % 3]) for k in range(900)], "doc_id long, text string, source string")
    got = rows_of(mixing.mix(docs, weights=(1.0,), share=1.0, most=1.0, curves=mixing.CURVES))
    middle = {s: sorted(p for r in got if r["source"] == s for p in r["positions"])[150] for s in "xyz"}
    # where the integral of 0.5 + t, of 1 and of 1.5 - t is half
    assert all(abs(middle[s] - t) < 0.01 for s, t in (("x", (1.25**0.5) - 0.5), ("y", 0.5), ("z", 1.5 - 1.25**0.5)))
    out = mixing.mixed(docs, weights=(1.0,), share=1.0, most=1.0, curves=mixing.CURVES).collect()
    early = [r.source for r in out[:200]]
    assert len(out) == 900 and early.count("z") > 1.5 * early.count("x")


def test_sources_without_words(spark):
    docs = spark.createDataFrame([(1, None, "e"), (2, " ", "e"), (3, "a b", "f"), (None, "", None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rows_of(mixing.mix(docs))}
    assert [got[i]["taken"] for i in (1, 2, 3, None)] == [0, 0, 3, 0] and got[1]["target"] == 0.0
    assert [r.doc_id for r in mixing.mixed(docs).collect()] == [3, 3]


def test_mixed_repeats_rows(odd_docs):
    docs = odd_docs.where("doc_id is not null")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    plan = {r["doc_id"]: r for r in rows_of(mixing.mix(docs))}
    counts = Counter(r["doc_id"] for r in rows_of(got))
    for i, r in plan.items():
        assert counts[i] == (round(r["taken"] / r["size"] + 1e-9) if r["size"] else 0)


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", max(most, 1024))
    monkeypatch.setattr(url_filter, "KEY_BYTES", 256 if most else 1 << 20)
    monkeypatch.setattr(shared, "HOT_ROWS", 1000 if most else 3)
    urls = [
        None, "", "no scheme", "http://Example.COM/en/x?y#z", "https://www.example.com/en/a", "https://a.www.example.com/en/", "ftp://b.net/es/q", "http://net/fr/",
        "http://xnet/fr/", "http://example.com", "http://example.com?en/", "a://b://c.com/", "http://é.com/x", "http://listed.org/p?q=1", "http://u@h.net:8/es/",
    ]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(3, urls[3], "x")], "page_id long, url string, key string")
    listed = spark.createDataFrame([("https://LISTED.org/p",), (None,)], "url string")
    got = rows_of(url_filter.judge_urls(pages, url_filter.rule_table(spark, queries.URL_RULES), listed))
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[r["page_id"]]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        assert (r["host"], r["path"]) == (host, path), u
        fit = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit)[1:] if fit else (None, "block" if host == "listed.org" else "allow")
        assert (r["rule"], r["verdict"]) == want, u


TEXTS = [
    None, "", "a@b.co a@b.co..x@y.zz_q@r.st, a@b@c.de x@y", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 01.002.3.4 é9.9.9.9", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111",
    "call +1 (017) 555-7713 or +12 now +1234567890123456 + 1", "IBAN GB82WEST12345698765432, GB82WEST12345698765433 xGB82WEST12345698765432", "😀 a@b.co 😀 1.1.1.1", "a" * 20000 + "@" + "b." * 5000,
    "1" * 30000, "1.1.1.1 " * 300,
]


def test_pii_matches_brute_force(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    found = pii.find_pii(docs)
    got = {r["doc_id"]: r for r in rows_of(pii.digest(found, queries.PII_BASE))}
    base = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    holds = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m)), "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    for k, t in enumerate(TEXTS):
        if t and len(t) > 19000:  # quadratic for the plain pattern
            assert got[k]["n_ip"] == got[k]["n_card"] == 0
            continue
        spans = [(kind, m.start(), m.end()) for kind, p in base.items() for m in re.finditer(p, t or "") if holds[kind](m[0])]
        told = ",".join(f"{a}:{b}:{c}" for a, b, c in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), (t, told, got[k])
        assert got[k]["spans"].startswith(told)
        for kind in base:
            assert got[k][f"n_{kind}"] == sum(s[0] == kind for s in spans)
    assert got[6]["spans"] == "iban:5:27" and got[6]["n_iban"] == 1 and got[6]["found"] and got[6]["score"] == 0.9
    assert not got[0]["found"] and got[0]["score"] == 0.0
    near = {r["doc_id"]: r for r in rows_of(found)}
    assert near[6]["iban"][0]["score"] == 0.9 and near[5]["phone"][0]["score"] == 0.7


def test_context_decides_on_added_spans(spark):
    run = "9f86d081884c7d659a2feaa0c55ad015"
    texts = [f'api_key = "{run}"', f"commit {run}", f"test token {run}", f"{run} token", f"ip 1.1.1.1 test dummy 2.2.2.2 {run[:19]} key {'a' * 30}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["spans"] for r in rows_of(pii.digest(pii.find_pii(docs), queries.PII_BASE).orderBy("doc_id"))]
    assert got == ["secret:11:43", "", "", "", "ip:3:10,ip:22:29"]
    scores = pii.find_pii(docs).where("doc_id = 4").first()["ip"]
    assert [s["score"] for s in scores] == [0.7, 0.4]
    every = rows_of(pii.find_pii(docs, least_score=0.0).orderBy("doc_id"))
    assert [[s["score"] for s in r["secret"]] for r in every] == [[0.55], [0.45], [0.45], [0.45], []]


def test_many_matches_in_one_text(spark):
    import time

    docs = spark.createDataFrame([(1, "a@b.co " * 20_000), (2, "x " * 7 + "a@b.co")], "doc_id long, text string")
    pii.find_pii(docs).collect()
    start = time.time()
    got = {r["doc_id"]: r["email"] for r in rows_of(pii.find_pii(docs))}
    assert time.time() - start < 120  # minutes, if an array were copied for each match
    assert [(s["start"], s["end"]) for s in got[1]] == [(7 * k, 7 * k + 6) for k in range(20_000)] and got[2][0]["start"] == 14
