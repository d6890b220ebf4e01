"""Retrieval: tokens, BM25+, late interaction, fused scores, training negatives."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.stemmer import english

#: Most bytes of a block of queries that is broadcast.
BLOCK_BYTES = 32 << 20
#: BM25+ parameters.
K1, B, DELTA = 1.5, 0.75, 1.0
#: Function words that queries lose.
STOPWORDS = {
    "en": ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"],
    "nl": ["aan", "al", "bij", "dat", "de", "den", "der", "die", "dit", "een", "en", "het", "in", "is", "met", "naar", "of", "om", "op", "te", "van", "voor"],
}
#: Endings that stem() takes off, longest first, by language.
ENDINGS = {"en": ["ations", "ation", "ings", "ing", "ies", "ed", "es", "s"], "nl": ["heden", "heid", "ingen", "ing", "en", "e", "s"]}


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def stem(token: Column, language: str = "en") -> Column:
    """A token without the longest ending that leaves three characters; a light stemmer, built in so that it stays in
    generated code."""
    out = F.when(F.lit(False), token)
    for e in ENDINGS[language]:
        out = out.when(token.endswith(e) & (F.length(token) >= len(e) + 3), F.substring(token, F.lit(1), F.length(token) - len(e)))
    return out.otherwise(token)


@F.pandas_udf(T.ArrayType(T.StringType()))
def snowball(words: pd.Series) -> pd.Series:
    """Each array of words as Snowball's English stems; questions are few, so Python does for them."""
    return words.map(lambda each: None if each is None else [english(w) for w in each])


def query_tokens(text: Column, language: str = "en", stemmed: bool | str = False) -> Column:
    """Tokens without function words; stemmed: True takes endings off (see stem()), "snowball" stems English by the
    published algorithm."""
    kept = F.filter(tokens(text), lambda t: ~t.isin(STOPWORDS[language]))
    if stemmed == "snowball":
        return snowball(kept) if language == "en" else F.transform(kept, lambda t: stem(t, language))
    return F.transform(kept, lambda t: stem(t, language)) if stemmed else kept


def clean_space(text: Column) -> Column:
    """Line ends, written out or not, and runs of white space become one space."""
    return F.regexp_replace(text, r"(?:(?:\r|\\r)?(?:\n|\\n)|\s+)", " ")


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)"""
    terms = docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(
    docs: DataFrame, queries: DataFrame, id_col: str = "id", text_col: str = "text", query_id: str = "qid", query_text: str = "query", stemmed: bool | str = False
) -> DataFrame:
    """(qid, id, score) of documents that share a term with the query. BM25+: each query term of the corpus adds
    idf * (DELTA + tf (K1 + 1) / (K1 (1 - B + B dl / avgdl) + tf)), idf = ln((N + 1) / df), so also DELTA * idf to
    documents without it, which is added as one amount per query instead of a row per document. A query's repeated term
    counts as often as it occurs."""
    sized = docs.select(F.col(id_col).alias("id"), F.size(tokens(F.col(text_col))).alias("dl"))
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    asked = queries.select(F.col(query_id).alias("qid"), F.explode(query_tokens(F.col(query_text), stemmed=stemmed)).alias("term"))
    asked = asked.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    # only terms that a query asks for go on from the corpus
    counts = term_counts(docs, id_col, text_col).join(asked.select("term").distinct(), "term", "left_semi")
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    first = totals.first()
    n, avgdl = float(first["n"] or 0), float(first["avgdl"] or 1.0)
    idf = df.select("term", F.log((n + 1) / F.col("df")).alias("idf"))
    weighed = asked.join(idf, "term")
    floor = weighed.groupBy("qid").agg(F.sum(F.col("times") * F.col("idf") * DELTA).alias("floor"))
    norm = K1 * (1 - B + B * F.col("dl") / avgdl)
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (norm + F.col("tf"))
    met = counts.join(sized, "id").join(weighed, "term")
    scores = met.groupBy("qid", "id").agg(F.sum(part).alias("own"))
    return scores.join(floor, "qid").select("qid", "id", (F.col("own") + F.col("floor")).alias("score")).where("score > 0")


def bm25_pools(nodes: DataFrame, queries: DataFrame, pools: Sequence[str] = ("table", "dimension", "measure"), **given) -> DataFrame:
    """(qid, table, score): each pool of nodes (kind, id, body) is an index of its own, with its own counts and lengths;
    scores of table#node are added to their table's by fuse()."""
    parts = [bm25(nodes.where(F.col("kind") == k), queries, "id", "body", **given) for k in pools]
    everything = reduce(DataFrame.unionByName, parts)
    own = everything.where(~F.contains("id", F.lit("#")))
    return fuse(own, everything.where(F.contains("id", F.lit("#"))))


def top_k(scores: DataFrame, k: int, by: str = "score", query_id: str = "qid", tie: str = "id") -> DataFrame:
    """The k best of each query, with rank; ties by id."""
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.col(by).desc_nulls_last(), tie))
    best = scores.withColumn("rank", rank).where(F.col("rank") <= k)  # so stated, each task keeps k before the shuffle
    return best.withColumn("rank", F.col("rank").cast("long"))


def fuse(tables: DataFrame, nodes: DataFrame, weight: float = 0.8, least: float = 0.01) -> DataFrame:
    """(qid, table, score): a table's score plus weight times the mean of its nodes' scores that reach `least`. Nodes are
    named table#node; tables and nodes have qid, id, score; either alone is enough."""
    of = nodes.where(F.col("score") >= least).select("qid", F.substring_index("id", "#", 1).alias("table"), "score")
    means = of.groupBy("qid", "table").agg(F.avg("score").alias("nodes"))
    out = tables.select("qid", F.col("id").alias("table"), F.col("score").alias("own")).join(means, ["qid", "table"], "full")
    return out.select("qid", "table", (F.coalesce("own", F.lit(0.0)) + weight * F.coalesce("nodes", F.lit(0.0))).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null if one is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_pairs(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """(qid, id, score) of every query with every other vector that agrees in keys. Queries are a stated set; they are
    broadcast in blocks of at most BLOCK_BYTES by the length of the longest one, so each broadcast is bounded."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *keys)
    q = queries.select(F.col(id_col).alias("qid"), F.col(vector_col).cast("array<double>").alias("q"), *(F.col(k).alias(f"q_{k}") for k in keys))
    told = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width")).first()
    blocks = max(1, -(-told["n"] * (8 * (told["width"] or 0) + 64) // BLOCK_BYTES))
    on = F.col("id") != F.col("qid")
    for k in keys:
        on = on & (F.col(k) == F.col(f"q_{k}"))
    parts = [q if blocks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, (v.join(F.broadcast(p), on).select("qid", "id", cosine(F.col("q"), F.col("v")).alias("score")) for p in parts))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: each query vector's best dot product with a vector of the document, added up."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)


def enriched(tables: DataFrame, nodes: DataFrame, most: int = 15) -> DataFrame:
    """(id, body): tables (id, title, body) with the first sentences of up to `most` measures and as many dimensions, by
    node; nodes (table, kind, node, body) with their table's title before them, as table#node."""
    first = F.trim(F.substring_index("body", ".", 1))
    listed = nodes.groupBy("table", "kind").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("node", first.alias("first")))), lambda x: x["first"]), 1, most).alias("firsts")
    )
    text = F.array_join("firsts", ", ")
    per = listed.groupBy("table").agg(
        F.max(F.when(F.col("kind") == "measure", text)).alias("measures"), F.max(F.when(F.col("kind") == "dimension", text)).alias("dimensions")
    )
    head = tables.join(per, F.col("id") == F.col("table"), "left")
    a = head.select("id", F.concat_ws(" ", "body", "measures", "dimensions").alias("body"))
    titled = nodes.join(tables.select(F.col("id").alias("t"), "title"), F.col("table") == F.col("t"))
    b = titled.select(F.concat_ws("#", "table", "node").alias("id"), F.concat(F.lit("["), "title", F.lit("] "), "body").alias("body"))
    return a.unionByName(b)


def positives(questions: DataFrame, question_id: str = "qid", sexp: str = "sexp") -> DataFrame:
    """(qid, id): a question's tables, and table#code for the codes in its MSR and DIM forms."""
    table = F.regexp_extract_all(sexp, F.lit(r"\(VALUE\s+([A-Za-z0-9]+)"), F.lit(1))
    lists = F.regexp_extract_all(sexp, F.lit(r"\((?:MSR|DIM\s+\S+)\s+\(([^)]*)\)"), F.lit(1))
    codes = F.filter(F.flatten(F.transform(lists, lambda x: F.split(F.trim(x), r"\s+"))), lambda c: c.rlike("^[A-Za-z0-9_]*[A-Za-z][A-Za-z0-9_]*$"))
    q = questions.select(F.col(question_id).alias("qid"), F.array_distinct(table).alias("tables"), F.array_distinct(codes).alias("codes"))
    q = q.select("qid", F.explode("tables").alias("table"), "codes")
    own = q.select("qid", F.col("table").alias("id"))
    coded = q.select("qid", "table", F.explode("codes").alias("code"))
    return own.unionByName(coded.select("qid", F.concat_ws("#", "table", "code").alias("id"))).distinct()


def hard_negatives(ranked: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """The k best-ranked of each query that aren't among its golden ones: qid, id, nth."""
    left = ranked.join(golden.select("qid", "id"), ["qid", "id"], "left_anti")
    nth = F.row_number().over(W.partitionBy("qid").orderBy("rank", "id"))
    return left.withColumn("nth", nth.cast("long")).where(F.col("nth") <= k).select("qid", "id", "nth")


def alternating(scores: DataFrame, k: int, same: float = 0.95) -> DataFrame:
    """k negatives of each query by turns from the most and the least similar, without near duplicates (score >= same):
    qid, id, nth."""
    left, w = scores.where(F.col("score") < same), W.partitionBy("qid")
    # the k first from either end are enough; so stated, each task keeps k before the shuffle
    hi = left.withColumn("hi", F.row_number().over(w.orderBy(F.col("score").desc(), "id"))).where(F.col("hi") <= k).select("qid", "id", "hi")
    lo = left.withColumn("lo", F.row_number().over(w.orderBy("score", "id"))).where(F.col("lo") <= k).select("qid", "id", "lo")
    left = hi.join(lo, ["qid", "id"], "full")
    turn = F.when(F.col("lo").isNull() | (F.col("hi") <= F.col("lo")), 2 * F.col("hi") - 1).otherwise(2 * F.col("lo"))
    nth = F.row_number().over(w.orderBy(turn, "id"))
    return left.withColumn("nth", nth.cast("long")).where(F.col("nth") <= k).select("qid", "id", "nth")


def padded(negatives: DataFrame, items: DataFrame, golden: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """negatives (qid, id, nth) with further ones for queries that have fewer than k: items (id) that aren't among them or
    golden, in the order of a hash of query and item. Each query looks at 2 * k + its golden ones' number of the items
    that follow its own place on a circle of hashes, so no query meets all items."""
    have = negatives.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    asked = golden.select("qid").union(negatives.select("qid")).distinct()
    short = asked.join(have, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    gold = golden.groupBy("qid").agg(F.count_distinct("id").alias("g"))
    short = short.join(gold, "qid", "left").withColumn("need", 2 * k + F.coalesce("g", F.lit(0)))
    total = max(1, items.count())
    # items lie in slots of about k; a query takes whole slots from its own on
    slots = max(1, total // max(1, k))
    slot = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(slots))
    dealt = items.select("id", slot("id").alias("slot"))
    wide = F.least(F.lit(slots), F.ceil(F.col("need") / max(1, k)) * 4)
    looked = short.select("qid", "n", F.explode(F.sequence(F.lit(0), wide - 1)).alias("step"), slot("qid").alias("first"))
    looked = looked.select("qid", "n", F.pmod(F.col("first") + F.col("step"), F.lit(slots)).alias("slot"))
    met = looked.join(dealt, "slot").join(golden.select("qid", "id"), ["qid", "id"], "left_anti").join(negatives.select("qid", "id"), ["qid", "id"], "left_anti")
    nth = F.row_number().over(W.partitionBy("qid").orderBy(F.xxhash64("qid", "id", F.lit(seed)), "id")) + F.col("n")
    more = met.withColumn("nth", nth.cast("long")).where(F.col("nth") <= k).select("qid", "id", "nth")
    return negatives.select("qid", "id", "nth").unionByName(more)


def mixed_triples(new: DataFrame, old: DataFrame, share: float = 0.5, seed: int = 42) -> DataFrame:
    """new triples (qid, positive, negative) and about `share` of the old ones, by hash, each once."""
    kept = old.where(F.pmod(F.xxhash64("qid", "positive", "negative", F.lit(seed)), F.lit(10_000)) < int(share * 10_000))
    columns = ["qid", "positive", "negative"]
    return new.select(columns).unionByName(kept.select(columns)).distinct()


def unlike(pairs: DataFrame, texts: DataFrame, id_a: str = "positive", id_b: str = "negative", least: float = 0.9) -> DataFrame:
    """pairs without those whose texts (id, body) share `least` or more of their distinct tokens (Jaccard); pairs of which
    a text isn't known stay."""
    sets = texts.select("id", F.array_distinct(tokens(F.col("body"))).alias("set"))
    met = pairs.join(sets.select(F.col("id").alias(id_a), F.col("set").alias("_a")), id_a, "left")
    met = met.join(sets.select(F.col("id").alias(id_b), F.col("set").alias("_b")), id_b, "left")
    both = F.size(F.array_intersect("_a", "_b"))
    alike = F.try_divide(both, F.size(F.array_union("_a", "_b"))) >= least
    return met.where(~F.coalesce(alike, F.lit(False))).select(*pairs.columns)


def group_split(rows: DataFrame, group: str, test: float = 0.1, seed: int = 42) -> DataFrame:
    """rows with fold ("train" or "test"); all rows of a group have the same, by its hash."""
    told = F.md5(F.concat(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit(f":{seed}")))
    share = F.conv(F.substring(told, 1, 8), 16, 10).cast("long") % 10_000 / 10_000
    return rows.withColumn("fold", F.when(share < test, "test").otherwise("train"))


def length_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """Exact p50, p95, p99 and greatest number of tokens, and the power of two that holds p99."""
    n = docs.select(F.size(tokens(F.col(text_col))).alias("n"))
    p = [F.percentile("n", q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    out = n.agg(*p, F.max("n").cast("long").alias("longest"))
    return out.withColumn("maxlen", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("p99", F.lit(1.0))))).cast("long"))


def prompt_order(nodes: DataFrame, least: float = 0.1, most: int = 500) -> DataFrame:
    """Nodes (table, kind, node, parent, score) in the order in which a prompt lists them, with place: measures by score,
    groups by their best child with the children after them, then codes without a group. Scores under `least` go."""
    kept = nodes.where(F.col("score") >= least)
    best = F.max("score").over(W.partitionBy("table", F.coalesce("parent", "node")))
    kept = kept.withColumn("best", best)
    part = F.when(F.col("kind") == "measure", 0).when((F.col("kind") == "dimension") | F.col("parent").isNotNull(), 1).otherwise(2)
    kept = kept.withColumn("part", part)
    order = ["part", F.col("best").desc(), F.coalesce("parent", "node"), F.col("parent").isNotNull(), F.col("score").desc(), "node"]
    place = F.row_number().over(W.partitionBy("table").orderBy(*order))
    return kept.withColumn("place", place.cast("long")).where(F.col("place") <= most).drop("best", "part")


def prompt_lines(nodes: DataFrame) -> DataFrame:
    """(table, place, line): what a prompt says of each node of prompt_order()'s rows (table, place, kind, node, label,
    unit, score; kind is measure, dimension, group or code)."""
    names = {"measure": "Measure", "dimension": "DimensionGroup", "group": "DimensionGroup", "code": "Dimension"}
    kind = reduce(lambda out, kv: out.when(F.col("kind") == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    unit = F.when(F.col("unit").isNotNull(), F.concat(F.lit(" (unit: "), "unit", F.lit(")"))).otherwise("")
    score = F.when(F.col("score").isNotNull(), F.concat(F.lit(" (relevance: "), F.format_string("%.4f", "score"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), kind, F.lit(": "), "node", F.lit(' (label: "'), F.coalesce("label", "node"), F.lit('")'), unit, score)
    return nodes.select("table", "place", line.alias("line"))


def prompt(question: str, tables: Sequence[tuple[str, str, Sequence[str]]], form: str = "SQL", system: str | None = None) -> tuple[str, str]:
    """(system text, user text) of a request to a language model: what it is to write, the tables (id, title, lines of
    nodes) in order, and the question. It is to answer with JSON that has the query under "query"."""
    system = system or (
        f"You write one {form} query that answers a question about statistical tables. Use only the codes that are listed. "
        'Answer with a JSON object {"query": "..."} and nothing else.'
    )
    parts = []
    for name, title, lines in tables:
        parts += [f"Table: {name} ({title})", "Nodes:", *lines, ""]
    return system, "\n".join([*parts, f"Question: {question}"])


def response_query(raw: str | None) -> str:
    """The query in a model's answer: the text under "query" of its JSON object, with or without a code fence or words
    around it; empty where there is none."""
    text = (raw or "").strip()
    if fence := re.search(r"```(?:json|JSON)?\s*\n(.*?)```", text, re.S):
        text = fence[1].strip()
    for given in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            told = json.loads(given)
        except ValueError:
            continue
        query = told.get("query") if isinstance(told, dict) else None
        return query if isinstance(query, str) else ""
    return ""
