"""What the training-data operators share: cut lineage, sized broadcasts, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that a broadcast side may hold; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Rows of a key from which it may count as hot, and most hot keys.
HOT_ROWS, HOT_KEYS = 1_000, 100_000
#: Setting under which Spark deletes a query's shuffle files at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges that one task joins to stars, on average.
FOREST = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset, a new one of this machine, which only
    serves a local master; on a cluster the setting is needed."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark, "_tessera_dir", None)
    if own is None:
        own = spark._tessera_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return own


def stored(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: lineage ends here, and a lost executor costs
    no recomputation of what came before. Shuffle files of the write go as soon as it is done, as nothing reads them any
    more; the setting for that is put back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    was = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(TIDY) if was is None else spark.conf.set(TIDY, was)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000, most_bytes: int = 16 << 20) -> None:
    """Batches between the JVM and Python workers hold so many rows and bytes at most from now on in this session, as rows
    are whole texts here; smaller settings stay. The setting is read when a plan runs, which for a lazy result is after
    the operator has returned, so it isn't set back."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        now = spark.conf.get(key)
        number = int(re.sub(r"\D", "", now) or 0) * (1 << {"k": 10, "m": 20, "g": 30}.get(now.lower().rstrip("b")[-1:], 0))
        if number <= 0 or number > most:
            spark.conf.set(key, str(most))


def dropped(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows times row_bytes stay within most; else df, to be shuffled.
    df should be a stored table, as it is counted."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def with_key(rows: DataFrame, one: DataFrame, key: list[str], weight: str = "weight") -> DataFrame:
    """rows joined on key with `one`, a stored table of one small row for each key whose column `weight` (dropped) says how
    many rows have that key. Keys of more than HOT_ROWS rows and more than a HOT_KEYS-th of all are broadcast, at most
    HOT_KEYS by that rule; so no task gets all rows of a hot key. The others meet in a shuffle. Null keys meet nothing."""
    total = one.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(HOT_ROWS, int(total) // HOT_KEYS)
    few = one.where(hot).drop(weight)
    if few.isEmpty():
        return rows.join(one.drop(weight), key)
    told = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(*key)), key, "left_anti")
    return told.unionByName(rest.join(one.where(~hot).drop(weight), key))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def beside(ids: pa.Array, /, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of ids as they came, so that 64-bit ids stay whole beside null ones, and other columns."""
    return pa.RecordBatch.from_arrays([ids, *columns.values()], names=["id", *columns])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, made of the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def spanning(a: list, b: list) -> list[int]:
    """Places of those pairs (a, b) that join two parts which the pairs before them don't."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[rx] = ry
            out.append(k)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's part) of the graph of edges (a, b). Roots hang themselves on smaller roots that an
    edge leads to, all at once, until none is left; each time at least half of those that can do so."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    up = np.arange(len(nodes))
    while True:
        p, q = up[x], up[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[up]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up = up[up]


def _forests(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Stars (node a, least node b of its part) of parts of about FOREST edges, and whether all edges were in one."""
    parts = -(-edges.count() // FOREST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column("a").to_numpy(zero_copy_only=False), x.column("b").to_numpy(zero_copy_only=False)) for x in batches]
        if held and sum(len(x) for x, _ in held):
            node, root = forest(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    dealt = edges.coalesce(1) if parts <= 1 else edges.repartition(parts, "a")
    return stored(dealt.mapInArrow(run, edges.schema)), parts <= 1


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, component) per node that has an edge to another,
    component being its least reachable node.

    In each round, tasks of about FOREST edges make them stars; then alternating large-star and small-star steps join the
    stars of different tasks. These keep the edges of a node apart from the minimum that is found by an aggregate with
    map-side combine, so no node's neighbours meet in one task. Rounds go on until one task has all edges or nothing
    changes. Null ends and loops are left out; repeated edges count once; no edges give no rows.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        met = both.join(least, both["a"] == least["u"])
        if small:  # every neighbour is smaller than a
            moved = met.select(F.col("b").alias("a"), F.col("m").alias("b"))
            out = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = met.where(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where(F.col("a") != F.col("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    was = None
    for _ in range(rounds):
        stars, done = _forests(now)
        dropped(now)
        if done:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        now = stored(star(star(stars.where("a <> b"), False), True))
        dropped(stars)
        if was == (was := mark(now)):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
