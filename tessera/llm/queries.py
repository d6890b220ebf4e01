"""Registered queries of the training-data operators and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, exact_dedup, mixing, ngram_join, packing, pii, quality, substring_dedup, toxicity, url_filter
from tessera.llm.labelled import fold

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
PII_BASE = list(pii.BASE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the order of the curriculum: by the time at which a row's first word is read, rows that are never read last."""
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, most=2.0, curves=mixing.CURVES)
    first = F.round(F.try_element_at("positions", F.lit(1)), 9).alias("first_position")
    out = out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", first)
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def _held_out(scores: DataFrame, of: int, rest: int) -> DataFrame:
    return scores.select("doc_id", (fold(F.col("doc_id"), of) == rest).alias("held_out"), "score", "predicted")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dups(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _held_out(quality.classify_quality(docs, labels, lambda i: fold(i, 4) != 2, threshold=0.7), 4, 2)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dups(table(spark, sf_dir, "embeddings"), threshold=0.93)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), most=1024, end_id=2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _held_out(toxicity.classify_toxicity(docs, labels, lambda i: fold(i, 3) != 1, threshold=0.7), 3, 1)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, URL_RULES)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")), PII_BASE)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (pipeline, op1_mix_sources, op2_ngram_join, op3_exact_dedup, op4_substring_dedup, op5_quality, op6_embedding_dedup, op7_packing, op8_toxicity, op9_url_filter, op10_pii)}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(nth % 3)::INT + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, row_number() OVER o AS step, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT *, (total - caps) / rest AS level FROM r),
f AS (SELECT *, min(CASE WHEN level < ratio THEN step END) OVER () AS first FROM l),
t AS (SELECT source, nth, source_size, CASE WHEN first IS NULL THEN cap ELSE least(cap, weight * max(CASE WHEN step = first THEN level END) OVER ()) END AS target FROM f),
p AS (SELECT doc_id, size, nth, source_size, target, floor(target / nullif(source_size, 0)) AS rounds,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, coalesce(rounds * size + greatest(0, least(size, round(target - rounds * source_size) - place)), 0)::BIGINT AS taken, place / target AS x FROM p)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken, CASE WHEN taken > 0 THEN round(CASE nth % 3 WHEN 0 THEN 2 * x / (0.5 + sqrt(0.25 + 2 * x))
  WHEN 1 THEN x ELSE 2 * x / (1.5 + sqrt(2.25 - 2 * x)) END, 9) END AS first_position FROM k
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

OP9_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT p.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fit f ON f.n = p.n AND f.k = 1
"""


def _pii_sql() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
        "secret": r"[A-Za-z0-9_+/=-]{20,}",
    }
    luhn = """list_sum(list_transform(range(length({d})), lambda i: CASE WHEN i % 2 = 1 THEN
      (2 * CAST(substr({d}, length({d}) - i, 1) AS INT)) // 10 + (2 * CAST(substr({d}, length({d}) - i, 1) AS INT)) % 10
      ELSE CAST(substr({d}, length({d}) - i, 1) AS INT) END)) % 10 = 0"""
    digits = r"regexp_replace(m, '[^0-9]', '', 'g')"
    iban = "regexp_replace(m, ' ', '', 'g')"
    moved = f"(substr({iban}, 5) || substr({iban}, 1, 4))"
    rest = f"""list_reduce(list_transform(range(1, length({moved}) + 1), lambda i: CAST(CASE WHEN ascii(substr({moved}, i, 1)) >= 65
      THEN ascii(substr({moved}, i, 1)) - 55 ELSE ascii(substr({moved}, i, 1)) - 48 END AS BIGINT)),
      lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END)"""
    holds = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(right(x, 3) AS INT), 0) <= 255))",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn.format(d=digits)}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"length({iban}) BETWEEN 15 AND 34 AND {rest} = 1",
        "secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
    }
    seen = lambda words: "least(2, " + " + ".join(f"(strpos(near, '{w}') > 0)::INT" for w in words) + ")"
    each = []
    for nth, (kind, pattern) in enumerate(patterns.items()):
        score = f"greatest(0, least(100, {pii.PRIOR[kind]} + {pii.STEP} * ({seen(pii.CONTEXT[kind])} - {seen(pii.AGAINST)})))::DOUBLE / 100"
        least = 0 if kind in pii.BASE else pii.LEAST_SCORE
        each.append(f"""
SELECT * FROM (SELECT n, '{kind}' AS kind, {nth} AS nth, b AS b, b + length(m) AS e, {score} AS score FROM (
  SELECT n, ms[i] AS m, translate(right(ps[i], {pii.NEAR}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS near,
  CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS b
  FROM (SELECT n, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT n, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS ps FROM docs)))
WHERE {holds[kind]}) WHERE score >= {least}""")
    told = "string_agg(kind || ':' || b || ':' || e, ',' ORDER BY nth, b)"
    counts = lambda kinds: ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({' UNION ALL '.join(each)}),
told AS (SELECT n, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in patterns)}, max(score) AS score,
  {told} FILTER (nth < 4) AS base, {told} AS spans FROM spans GROUP BY n)
SELECT doc_id, {counts(pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  {counts(k for k in patterns if k not in pii.BASE)}, coalesce(score, 0) > 0 AS found, coalesce(score, 0) AS score
FROM docs LEFT JOIN told USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_ngram_join": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op6_embedding_dedup": OP6_SQL, "op9_url_filter": OP9_SQL, "op10_pii": _pii_sql()}
