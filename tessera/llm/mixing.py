"""Mixing sources to target weights: a curriculum that varies with time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import sized, stored, whole

#: Knots (time from 0 to 1, rate) between which a source's rate is linear; its integral multiplies the weight.
FLAT = ((0.0, 1.0), (1.0, 1.0))
#: A curriculum whose integrals are 1: of three sources one comes late, one evenly, one early.
CURVES = (((0.0, 0.5), (1.0, 1.5)), FLAT, ((0.0, 1.5), (1.0, 0.5)))
#: Rows that one part of a source's order holds on average.
PART_ROWS = 20_000
#: Bytes of text that a range of the mixed documents holds, about.
PART_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; null: 0."""
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def schedule_table(spark: SparkSession, schedules: dict[str | None, list[tuple[float, float]]]) -> DataFrame:
    """(source, knots) rows; the knots of each must go from time 0 to 1 with rates of at least 0."""
    kind = T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("knots", T.ArrayType(T.StructType([T.StructField("t", T.DoubleType()), T.StructField("w", T.DoubleType())]))),
    ])
    return spark.createDataFrame(list(schedules.items()), kind)


def _segments(knots: Column) -> Column:
    """Of each stretch between knots: its start, length, rates at both ends, and demand before and in it."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            F.element_at(knots, i)["t"].alias("t"),
            (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"]).alias("dt"),
            F.element_at(knots, i)["w"].alias("w0"),
            F.element_at(knots, i + 1)["w"].alias("w1"),
        ),
    )
    area = lambda s: s["dt"] * (s["w0"] + s["w1"]) / 2
    return F.transform(
        pieces,
        lambda s, i: F.struct(
            s["t"].alias("t"), s["dt"].alias("dt"), s["w0"].alias("w0"), s["w1"].alias("w1"), area(s).alias("area"),
            F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0.0), lambda a, x: a + area(x)).alias("before"),
        ),
    )


def _time(segments: Column, demand: Column) -> Column:
    """When the integrated rate reaches demand: the stretch is looked up and its trapezoid inverted."""
    fit = F.filter(segments, lambda s: (s["area"] > 0) & (s["before"] <= demand))
    s = F.element_at(fit, -1)
    rest = F.greatest(F.lit(0.0), F.least(demand - s["before"], s["area"])) / s["dt"]
    x = 2 * rest / (s["w0"] + F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * (s["w1"] - s["w0"]) * rest)))
    return F.when(F.size(fit) > 0, s["t"] + s["dt"] * F.coalesce(F.when(rest > 0, x), F.lit(0.0)))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    schedules: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    curves: tuple = (FLAT,),
) -> DataFrame:
    """One row per row of docs: id_col, source_col, size (words), source_size, target, taken (words of the row that the
    mix takes, repeats counted), positions (times from 0 to 1 at which its first word is read, one per reading).

    Sources by code point, null last, get weights in turn; each is multiplied by the integral of the source's rate in
    schedules (see schedule_table); sources without one get curves in turn, lists of knots. The sources share `share` times all
    words; a target stops at `most` times its source's words, and the excess is shared out again by weight until none
    is above. A source's rows stand in the order of a hash and are read round and round until the target is met: whole
    rounds, then the first words of one more, so the last row may give part of its words. A word's position is the time
    at which the source's integrated rate has reached its place in that stream.

    The place of a row is a sum over all rows of the source before it. It is built from sums over many parts of the
    source's order, so no task holds a source; reruns agree as the order is a hash of id and text, then the id.

    Null text has size 0; null sources are one source; null ids are kept. Rows of size 0 take nothing. Repeated rows
    each count. A source without words has target 0. Other columns are ignored. An empty table gives no rows. Sources are
    ordered in one task, one small row each.
    """
    return _placed(docs, weights, share, most, schedules, id_col, text_col, source_col, curves).drop("place")


def _place(id_: Column, text: Column) -> Column:
    """Where a row stands in its source's order, of 60 bits."""
    told = F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.md5(whole(text))))
    return F.conv(F.substring(told, 1, 15), 16, 10).cast("long")


def _placed(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    schedules: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    curves: tuple = (FLAT,),
) -> DataFrame:
    """mix()'s rows with their place."""
    spark = docs.sparkSession
    rows = stored(
        docs.select(
            docs[id_col].alias("id"),
            docs[source_col].cast("string").alias("source"),
            words(docs[text_col]).alias("size"),
            _place(docs[id_col], docs[text_col]).alias("place"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    bits = max(4, (rows.count() // PART_ROWS).bit_length())
    part = F.shiftright("place", 60 - bits).cast("int")
    rows = rows.withColumn("part", part)
    sums = stored(rows.groupBy("source", "part").agg(F.sum("size").alias("words")))

    # targets: one row per source from here on
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    sizes = sizes.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    given = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    if schedules is not None:
        known = schedules.select(F.col("source").alias("s"), "knots")
        sizes = sizes.join(known, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    else:
        sizes = sizes.withColumn("knots", F.lit(None).cast("array<struct<t:double,w:double>>"))
    turns = F.array(*(F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in knots)) for knots in curves))
    knots = F.coalesce("knots", F.element_at(turns, (F.col("nth") % len(curves) + 1).cast("int")))
    sizes = sizes.withColumn("segments", _segments(knots))
    sizes = sizes.withColumn("integral", F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["area"]))
    sizes = sizes.withColumn("weight", given * F.col("integral")).withColumn("cap", F.col("source_size") * F.lit(most))
    targets = stored(_shared(sizes, share).drop("knots", "nth"))

    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    starts = starts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    starts = starts.withColumnsRenamed({"source": "s", "part": "p"})
    met = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p")
    inside = W.partitionBy("source", "part").orderBy("place", "id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    met = met.withColumn("at", at)
    rounds = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    rest = F.round(F.col("target") - rounds * F.col("source_size")).cast("long")
    part_taken = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
    taken = F.when(F.col("source_size") > 0, rounds.cast("long") * F.col("size") + part_taken).otherwise(F.lit(0)).cast("long")
    met = met.withColumn("taken", taken)
    reads = rounds.cast("int") + F.when(part_taken > 0, 1).otherwise(0)
    stream = lambda k: F.col("at") + k * F.col("source_size")
    positions = F.transform(
        F.sequence(F.lit(0), reads - 1), lambda k: _time(F.col("segments"), F.try_divide(stream(k), F.col("target")) * F.col("integral"))
    )
    positions = F.when(F.col("taken") > 0, positions).otherwise(F.array().cast("array<double>"))
    return met.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", positions.alias("positions"), "place"
    )


def _shared(sizes: DataFrame, share: float) -> DataFrame:
    """Adds target: least(cap, weight * level), the level being such that the targets make up share times all words (or
    all caps, if those are less). With the sources in order of cap / weight, those up to the first whose share of what
    is left stays under its cap are at their caps."""
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    s = sizes.withColumn("ratio", ratio)
    ordered = W.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    s = s.withColumn("caps", F.coalesce(F.sum("cap").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(ordered.rowsBetween(W.currentRow, W.unboundedFollowing)))
    s = s.withColumn("all", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("level", F.when(F.col("left") > 0, (F.col("all") - F.col("caps")) / F.col("left")))
    s = s.withColumn("step", F.row_number().over(ordered))
    s = s.withColumn("level", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("step", "level"))).over(everything)["level"])
    reached = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return s.select(*sizes.columns, reached.cast("double").alias("target"))


def mixed(docs: DataFrame, partitions: int | None = None, **given) -> DataFrame:
    """docs as the mix takes them, range-sorted by position: a row comes as often as the rounded number of times that its
    words are taken, each time at its position; columns are those of docs. Ids may repeat and be null: rows of one id are
    matched one to one by source, size and place, those that share these too in the order of a hash of all columns."""
    id_col, text_col, source_col = (given.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    spark = docs.sparkSession
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    plan = _placed(docs, **given).select(
        F.col(id_col).alias("p_id"), F.col(source_col).alias("p_source"), F.col("size").alias("p_size"), F.col("place").alias("p_place"),
        F.slice("positions", F.lit(1), times).alias("ats"),
    )
    plan = stored(plan)
    again = stored(plan.groupBy("p_id").count().where("count > 1").select(F.col("p_id").alias("again")))
    # whole rows in one column, so that the names of docs can't clash with others
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), docs[text_col].alias("text"))
    at = F.explode("ats").alias("at")
    if again.isEmpty():
        met = rows.join(plan.select("p_id", at), F.col("id").eqNullSafe(F.col("p_id"))).select("row", "at", "id")
    else:
        again = sized(again, 16)
        repeats = F.col("p_id").eqNullSafe(F.col("again"))
        once = plan.join(again, repeats, "left_anti").select("p_id", at)
        met = rows.join(once, F.col("id").eqNullSafe(F.col("p_id"))).select("row", "at", "id")
        key = ["id", "source", "size", "place"]
        nth = lambda keys, by: F.row_number().over(W.partitionBy(*keys).orderBy(by))
        many = plan.join(again, repeats, "left_semi").withColumn("p_nth", nth([f"p_{c}" for c in key], "ats"))
        some = rows.join(again, F.col("id").eqNullSafe(F.col("again")), "left_semi").select(
            "row", "id", "source", words(F.col("text")).alias("size"), _place(F.col("id"), F.col("text")).alias("place"), F.xxhash64(F.to_json("row")).alias("hash")
        )
        some = some.withColumn("nth", nth(key, "hash"))
        on = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in [*key, "nth"]]
        met = met.unionByName(some.join(many, on).select("row", at, "id"))
    if partitions is None:  # ranges of about PART_BYTES, at 8 bytes a word
        read = plan.agg(F.sum(F.col("p_size") * F.size("ats"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read * 8 // PART_BYTES))
    return met.repartitionByRange(partitions, "at", "id").sortWithinPartitions("at", "id").select("row.*")
