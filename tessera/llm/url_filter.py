"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import BROADCAST_BYTES, stored, with_key

#: Bits set in the one 64-bit block of a key.
PROBES = 6
#: Bytes that a row of the list takes, about.
KEY_BYTES = 256
#: Bits of filter for a listed key, rounded up to a power of two of blocks.
BITS_A_KEY = 16

RULES = T.StructType([T.StructField(n, T.StringType()) for n in ("verdict", "host", "path")])


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or
    the end. Null, or no ://: both empty."""
    at = F.instr(url, "://")
    after = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*+)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*+([^?#]*+)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _mask(key: Column) -> Column:
    """PROBES bits of a 64-bit word, drawn from one hash."""
    h = F.xxhash64(F.lit(7), key)
    places = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int") for i in range(PROBES)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def bloom(keys: DataFrame, key: str, most_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """(block, mask) rows of a blocked Bloom filter over keys[key], and the number of blocks. The number follows the
    count of keys up to most_bytes, so the filter's size is bounded; beyond that it passes more rows, never fewer."""
    n, blocks = keys.count(), 64
    while blocks * 64 < n * BITS_A_KEY and blocks * 2 * 16 <= most_bytes:
        blocks *= 2
    rows = keys.select(block_of(F.col(key), blocks).alias("block"), _mask(F.col(key)).alias("mask"))
    return stored(rows.groupBy("block").agg(F.bit_or("mask").alias("mask"))), blocks


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule (host followed by path, or null), verdict.

    rules has verdict, host and path. A rule fits its host and all subdomains where the url's path starts with the
    rule's; the longest rule wins, of equal length the first by code points. listed has urls that are blocked where no
    rule fits; a url is listed if its host and path are those of a listed one, whatever its scheme, query and fragment.
    Everything else gets default.

    A url asks for its host's suffixes, each with the path's prefixes of those lengths that rules have, and for itself.
    These keys pass the blocked Bloom filter, which is broadcast (its size is bounded) and joined by block; what it
    passes meets the list in an exact hash join: with all of it broadcast where its counted size allows that, else with
    the rows of the keys that very many pages ask for broadcast and the others shuffled.

    Null urls and urls without :// have empty host and path, fit no rule and get default. Null rules or listed urls are
    ignored; repeated rules count once (block before allow if both are given for one key). Repeated pages each get a
    row. Empty tables are fine, and other columns of pages are ignored.
    """
    keyed = rules.where("host is not null and path is not null and verdict is not null").select(
        F.concat("host", "path").alias("rule"),
        F.concat(F.lit("r"), "host", F.lit("\n"), "path").alias("key"),
        "verdict",
        F.length("path").alias("n"),
    )
    wanted = keyed.groupBy("key").agg(F.first("rule").alias("rule"), F.max("verdict").alias("verdict"), F.first("n").alias("n"))
    if listed is not None:
        host, path = url_parts(listed[url_col])
        exact = listed.where(listed[url_col].isNotNull()).select(F.concat(F.lit("u"), host, F.lit("\n"), path).alias("key"))
        wanted = wanted.unionByName(
            exact.distinct().select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(0).alias("n"))
        )
    wanted = stored(wanted)
    lengths = sorted(r[0] for r in wanted.where("rule is not null").select("n").distinct().collect())
    filt, blocks = bloom(wanted, "key")

    host, path = url_parts(pages[url_col])
    page = stored(
        pages.select(
            F.monotonically_increasing_id().alias("row"), pages[id_col].alias("id"), host.alias("host"), path.alias("path")
        )
    )
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )

    def with_prefix(n: int) -> Column:
        keys = F.transform(suffixes, lambda s: F.concat(F.lit("r"), s, F.lit("\n"), F.substring("path", 1, n)))
        return F.when(F.length("path") >= n, keys).otherwise(F.array().cast("array<string>"))

    asked = [F.array(F.concat(F.lit("u"), "host", F.lit("\n"), "path")), *map(with_prefix, lengths)]
    probes = page.where("host <> '' or path <> ''").select("row", F.explode(F.array_distinct(F.flatten(F.array(*asked)))).alias("key"))
    probes = probes.select("row", "key", block_of(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("need"))
    passed = probes.join(F.broadcast(filt), "block").where(F.col("mask").bitwiseAND(F.col("need")) == F.col("need"))
    hits = _exact(passed.select("row", "key"), wanted)
    # rules before the list, then the longest, then the first by code points
    order = F.struct(F.col("rule").isNull(), -F.coalesce(F.length("rule"), F.lit(0)), "rule", "verdict")
    best = hits.groupBy("row").agg(F.min(order).alias("best"))
    return page.join(best, "row", "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def _exact(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """hits (row, key) that wanted really holds, with its columns."""
    if wanted.count() * KEY_BYTES <= BROADCAST_BYTES:
        return hits.join(F.broadcast(wanted), "key")
    hits = stored(hits)
    asked = hits.groupBy("key").agg(F.count(F.lit(1)).alias("weight"))
    return with_key(hits, stored(wanted.join(asked, "key")), ["key"])


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)
