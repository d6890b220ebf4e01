"""Exact dedup: 128-bit content hash, stable keeper, byte comparison inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import fresh, sized, stored, whole, with_key


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    hash128: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of docs: id_col, keep_id (of the row that stays), group_size, kept, text_sha256 (lowercase hex of
    the normalised text in UTF-8).

    Rows group by hash128 of the normalised text. Where a hash has more than one row, its texts are compared byte by
    byte (grouped with the hash, copies combined before the shuffle); texts that only share the hash part again.
    keep: "smallest" or "largest" id stays.

    Null text counts as empty. Null ids group like others; one stays only in a group without other ids. Of repeated
    rows (same id and text) one is kept. Columns of docs other than the two are ignored, so names can't clash. An empty
    table gives an empty result. Texts of any length are read whole.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep!r}")
    text = (normalise or (lambda c: c))(whole(docs[text_col]))
    base = docs.select(docs[id_col].alias("id"), text.alias("text")).withColumn("h", hash128(F.col("text")))

    many = stored(base.groupBy("h").count().where("count > 1").select("h"))
    texts = base.join(sized(many, 64), "h", "left_semi").groupBy("h", "text").agg(F.count(F.lit(1)).alias("n"))
    apart = stored(texts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    if apart.isEmpty():
        keyed = base.withColumn("part", F.lit(""))
    else:  # equal hashes of different bytes: the text itself joins the key of those rows
        flagged = apart.withColumn("hit", F.lit(True))
        keyed = base.join(sized(flagged, 64), "h", "left").withColumn(
            "part", F.when(F.col("hit"), F.col("text")).otherwise(F.lit(""))
        )
    rows = stored(
        keyed.select("id", "h", "part", F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("row"))
    )
    given = F.struct(F.col("id").isNotNull().alias("known"), "id", "row")
    first = F.struct(F.col("id").isNull().alias("unknown"), "id", "row")
    best = F.min(first) if keep == "smallest" else F.max(given)
    groups = stored(rows.groupBy("h", "part").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")))
    return with_key(rows, groups.withColumn("weight", F.col("group_size")), ["h", "part"]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, **given) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns. Ids may repeat and be null: an id goes where none
    of its rows is kept; where some are, rows are told apart by id and text, and of those that share both, the one whose
    columns hash least stands for the kept one."""
    id_col, text_col = given.get("id_col", "doc_id"), given.get("text_col", "text")
    key, sha = fresh(docs, "id", "sha")  # names that the columns of docs can't clash with
    found = exact_dedup(docs, **given).select(F.col(id_col).alias(key), F.col("text_sha256").alias(sha), "kept")
    found = stored(found.groupBy(key, sha).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")))
    ids = found.groupBy(key).agg(F.sum("n").alias("n"), F.count_if(F.col("kept")).alias("stay"))
    out = stored(ids.where("stay < n").select(key, "stay"))
    same = docs[id_col].eqNullSafe(F.col(key))
    whole_ids = docs.join(sized(out.select(key), 16), same, "left_anti")
    part = stored(out.where("stay > 0").select(key))
    if part.isEmpty():
        return whole_ids
    normalise = given.get("normalise") or (lambda c: c)
    some = docs.join(sized(part, 16), same, "left_semi").select(
        F.col(id_col).alias("id"),
        F.sha2(normalise(whole(F.col(text_col))), 256).alias("sha"),
        F.struct(*docs.columns).alias("row"),
        F.xxhash64(F.to_json(F.struct(*docs.columns))).alias("hash"),
    )
    some = some.groupBy("id", "sha").agg(F.min_by("row", "hash").alias("row"))
    kept = found.where("kept").select(F.col(key).alias("k"), F.col(sha).alias("s"))
    some = some.join(kept, F.col("id").eqNullSafe(F.col("k")) & (F.col("sha") == F.col("s")), "left_semi")
    return whole_ids.unionByName(some.select("row.*"))
