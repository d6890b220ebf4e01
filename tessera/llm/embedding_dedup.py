"""Embedding near-dedup: a navigable small-world graph per shard, every shard queried, cosines verified, links joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.hnsw import Graph
from tessera.llm.shared import bounded_batches, components, spanning, stored, with_key

#: Vectors of a shard at most, bytes of its vectors at most, vectors of a block of queries, and blocks that one task asks.
SHARD, SHARD_BYTES, BLOCK, SLICE = 16_000, 64 << 20, 1_000, 200
#: Most tasks that shards are dealt to.
PARTITIONS = 20_000
#: First beam; queries of each block and shard that an audit compares with all vectors of the shard at a time, links that
#: audits of a shard must have seen; the share of them that must be found, else the beam doubles (a beam as wide as the
#: shard compares everything).
BEAM, AUDIT, EVIDENCE, RECALL = 32, 24, 50, 0.99
#: Cosines of 32-bit floats this much under the threshold are computed again in double precision.
MARGIN = 1e-4


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1)[:, None]  # squares of very large or small components aren't in range
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def near_dups(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label"
) -> DataFrame:
    """One row per row of vectors: id_col, n_links (other rows linked directly), component_id (least id reachable over
    links, itself included), kept (id = component_id).

    Two rows link if their labels are equal and not null (label_col None: any two) and the cosine in double precision is
    at least threshold. Equal vectors of a label make one class first, so a vector that is very common is compared once.

    Classes are dealt by hash into shards of their label, as large as a task may hold, with a graph per shard. Every block
    of classes queries every shard of its label: a task gets a shard's vectors, builds the graph and then streams the
    blocks past it (SLICE at most; further ones go to a task that builds the same graph), so graphs never travel. Audits
    compare some queries of each block with the whole shard, more until EVIDENCE links to others were seen; the beam
    widens until the share of them that is found is at least RECALL. Found pairs are verified in double precision. A block
    and shard pass on counts and a spanning set of links, never all pairs.

    Vectors that are null, zero, or with null or non-finite components link with nothing; likewise null labels. Vectors of
    different dimensions don't link. Null ids have component null. Rows that share an id are one node. Other columns are
    ignored. An empty table gives no rows.
    """
    bounded_batches(vectors.sparkSession)
    label = vectors[label_col].cast("string") if label_col else F.lit("")
    e = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"), label.alias("label"))
    sound = F.coalesce(
        F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    e = stored(e.withColumn("sound", sound).withColumn("row", F.monotonically_increasing_id()))
    hashes = [F.xxhash64(F.lit(n), "label", "v").alias(f"h{n}") for n in (1, 2)]  # together they stand for the vector
    good = e.where("sound").select("id", "row", "label", "v", *hashes)
    same = good.groupBy("h1", "h2").agg(
        F.min("id").alias("c"), F.min(F.struct("row", "label", "v")).alias("r"), F.count(F.lit(1)).alias("times")
    )
    classes = stored(same.select("h1", "h2", "c", "times", F.col("r.row").alias("key"), "r.label", "r.v", F.size("r.v").alias("width")))

    # a group for each shard and slice of blocks, numbered from the first one of its label and width
    kinds = classes.groupBy("label", "width").agg(F.count(F.lit(1)).alias("n"))
    most = F.greatest(F.lit(1), F.least(F.lit(SHARD), F.floor(F.lit(SHARD_BYTES) / (F.col("width") * 8))))
    kinds = kinds.select("label", "width", F.ceil(F.col("n") / most).alias("shards"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    kinds = kinds.withColumn("slices", F.ceil(F.col("blocks") / SLICE))
    before = W.orderBy("label", "width").rowsBetween(W.unboundedPreceding, -1)
    firsts = stored(kinds.withColumn("first", F.coalesce(F.sum(F.col("shards") * F.col("slices")).over(before), F.lit(0))))
    n = firsts.agg(F.sum(F.col("shards") * F.col("slices"))).first()[0] or 1
    parts = int(min(n, PARTITIONS))

    met = classes.select("label", "width", "v", "key", "times").join(firsts, ["label", "width"])
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    shard, block = F.pmod(F.xxhash64("key", F.lit(3)), "shards"), F.pmod(F.xxhash64("key", F.lit(5)), "blocks")
    held = met.withColumn("shard", shard).withColumn("slice", every("slices"))
    held = held.select(*_place(), F.lit(-1).cast("long").alias("block"), "key", "times", "v")
    asked = met.withColumn("block", block).withColumn("slice", F.pmod("block", "slices")).withColumn("shard", every("shards"))
    asked = asked.select(*_place(), "block", "key", "times", "v")
    work = held.unionByName(asked).repartitionById(parts, F.pmod("group", F.lit(parts)).cast("int")).sortWithinPartitions("group", "block", "key")

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for (group, block), (key, times, v) in _blocks(batches):
            if block < 0:
                now, shard = group, Shard(key, times, v, threshold)
            elif group == now:
                yield shard.links(key, v)

    found = stored(work.mapInArrow(query, "a long, b long, links long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    linked = components(found.where("b is not null").select("a", "b"))
    # a class's least id, and the least of its component
    keys = classes.select("key", "h1", "h2", "c", "times")
    node = keys.where("c is not null").select(F.col("key").alias("node"), "c")
    least = linked.join(node, "node").groupBy("component").agg(F.min("c").alias("least"))
    top = linked.join(least, "component").select(F.col("node").alias("key"), "least")
    told = keys.join(counts, "key", "left").join(top, "key", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("least", "c").alias("least"), F.col("times").alias("weight")
    )
    rows = with_key(good.select("id", "h1", "h2"), stored(told), ["h1", "h2"]).select("id", "n_links", "least")
    rest = e.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("least"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return rows.unionByName(rest).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _place() -> list:
    return [(F.col("first") + F.col("shard") * F.col("slices") + F.col("slice")).cast("long").alias("group")]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((group, block), (keys, times, vectors)) of rows that are sorted by group and block."""
    now, held = None, []

    def whole() -> tuple:
        return now, tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for b in batches:
        where = np.stack([b.column("group").to_numpy(), b.column("block").to_numpy()], axis=1)
        cut = np.r_[0, np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1, len(where)]
        for s, e in zip(cut, cut[1:], strict=False):
            if e == s:
                continue
            if (at := (int(where[s, 0]), int(where[s, 1]))) != now:
                if held:
                    yield whole()
                now, held = at, []
            v = b.column("v").slice(s, e - s).flatten().to_numpy(zero_copy_only=False)
            held.append((b.column("key").to_numpy()[s:e], b.column("times").to_numpy()[s:e], v.reshape(e - s, -1)))
    if held:
        yield whole()


class Shard:
    """A shard's vectors and graph, and what audits have seen of it so far."""

    def __init__(self, keys: np.ndarray, times: np.ndarray, vectors: np.ndarray, threshold: float):
        self.keys, self.times, self.unit, self.threshold = keys, times, _unit(vectors), threshold
        self.graph = Graph(self.unit)
        self.beam, self.wanted, self.found = BEAM, 0, 0

    def _search(self, keys: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of links to others that the beam finds."""
        q, w, _ = self.graph.search(unit, self.threshold - MARGIN, self.beam)
        ok = (np.einsum("ij,ij->i", unit[q], self.unit[w]) >= self.threshold) & (keys[q] != self.keys[w])
        return q[ok], w[ok]

    def _compare(self, keys: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all links to others."""
        parts = [np.nonzero(unit[a : a + 256] @ self.unit.T >= self.threshold) for a in range(0, len(unit), 256)]
        q = np.concatenate([x + 256 * k for k, (x, _) in enumerate(parts)])
        w = np.concatenate([y for _, y in parts])
        other = keys[q] != self.keys[w]
        return q[other], w[other]

    def _audit(self, keys: np.ndarray, unit: np.ndarray) -> bool:
        """Widens the beam as audits ask for; whether they have compared everything."""
        step = max(1, len(keys) // AUDIT)
        order = np.concatenate([np.arange(k, len(keys), step) for k in range(step)])
        at, wanted = 0, 0
        while at < len(order):
            part = order[at : at + AUDIT]
            at += AUDIT
            true = len(self._compare(keys[part], unit[part])[0])
            wanted += true
            self.wanted += true
            if true:
                self.found += len(self._search(keys[part], unit[part])[0])
            if self.wanted >= EVIDENCE:
                break
        while self.found < RECALL * self.wanted and self.beam < len(self.keys):
            self.beam *= 2
            part = order[:at]
            self.wanted, self.found = wanted, len(self._search(keys[part], unit[part])[0])
        return at >= len(order)

    def links(self, keys: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        """Rows (a, null, number of rows linked to a in this shard) and a spanning set (a, b, null) of the links found."""
        unit = _unit(vectors)
        all_ = self._audit(keys, unit) or self.beam >= len(self.keys)
        q, w = (self._compare if all_ else self._search)(keys, unit)
        links = np.bincount(q, self.times[w], len(keys)).astype(np.int64)
        some = np.flatnonzero(links)
        tree = spanning(keys[q].tolist(), self.keys[w].tolist())
        none = lambda k: pa.nulls(k, pa.int64())
        columns = [(keys[some], keys[q[tree]]), (none(len(some)), self.keys[w[tree]]), (links[some], none(len(tree)))]
        joined = [pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in c]) for c in columns]
        return pa.RecordBatch.from_arrays(joined, names=["a", "b", "links"])
