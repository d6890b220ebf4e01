"""N-gram Jaccard join: prefixes of token combinations find candidates, exact sets verify them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import beside, components, sized, spanning, stored, texts_of
from tessera.llm.shingles import Common, Words, count_common, of_ids, shingle_set

#: Documents that a token may occur in before combinations of two stand for it.
FREQUENT = 64
#: Members of a group that meet as pairs at most, and members and bytes of a block in larger ones, on average.
SMALL, BLOCK, BLOCK_BYTES = 24, 96, 1 << 20

_COMBINED = np.uint64(0xD6E8FEB86659FD93)


def prefix(tokens: np.ndarray, shared: np.ndarray, frequent: np.ndarray, t: Fraction) -> np.ndarray:
    """Signatures of a set (tokens in order of hash; shared: the token occurs elsewhere; frequent: in many documents).

    All sets order tokens alike: first those that occur once, then rare, then frequent ones, each by hash. Let x have n
    tokens and y be as similar as t. At most T = n - ceil(t n) tokens of x are not in y, and at most D tokens are in one
    of them only. Let x's prefix end no later than y's in that order.
    - If x has more than T tokens that aren't frequent, its prefix is the first T + 1: one of them is in y, in y's prefix.
    - Else its prefix is its r other tokens and the first T + D - 2 r + 2 frequent ones. If none of the r is in y, at most
      T - r of the frequent ones are not, and at most D - r tokens of either set separate shared ones: too few to part
      all of them, so two shared tokens follow each other in both prefixes.
    Signatures are therefore single tokens of the first kind and pairs of neighbours among the frequent ones of a prefix.
    Tokens that occur once need none. Sets of one token are only similar to equal sets, which need none either.
    """
    n = len(tokens)
    if n < 2:
        return tokens[:0]
    away = n - -(-t.numerator * n // t.denominator)
    union = n * t.denominator // t.numerator
    either = union - -(-t.numerator * union // t.denominator)
    single = tokens[~shared & ~frequent]
    rare = tokens[shared & ~frequent]
    if len(single) + len(rare) > away:
        return rare[: max(0, away + 1 - len(single))]
    often = tokens[frequent][: away + either - 2 * (len(single) + len(rare)) + 2]
    pairs = (often[:-1] * _COMBINED) ^ often[1:]
    return np.r_[rare, pairs]


def ngram_join(
    docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """One row per row of docs: id_col, n_shingles (distinct runs of n words; of a shorter text, the whole run), and
    component_id, the least id that is reachable over links, itself included. Two documents link when the Jaccard
    similarity of their sets is at least threshold.

    Equal sets make one class, named by its least id, before anything else. Classes that share a signature (see
    prefix()) are candidates: members of a signature's group meet a pivot of the group; then those that are still in
    different components meet each other. Only pairs inside one component are left out, so no component lacks a link. Each
    pair is verified on whole sets.

    Null and empty texts have no words: 0 shingles, and link with nothing. Null ids get component null. Rows that share
    an id count as one document that has all their links. Other columns are ignored. An empty table gives no rows.
    """
    frequent = frequent if threshold >= Fraction(2, 3) else 1 << 30  # below, pairs of neighbours may miss a link
    words = Words()
    common = count_common(docs, lambda texts: (shingle_set(w, n) for w in words.each(texts)), (1, frequent), text_col)
    sets = stored(_signatures(docs, common, words, n, threshold, id_col, text_col))

    classes = sets.where("id is not null and n_shingles > 0").groupBy("fp").agg(F.min("id").alias("c"))
    links = stored(sets.where("id is not null and n_shingles > 0").select("id", "fp").join(classes, "fp").select("id", "c"))
    rows = sets.where("id is not null").select(F.explode("signatures").alias("s"), "fp", "id", F.col("n_shingles").alias("n"))
    rows = rows.groupBy("s", "fp").agg(F.min("id").alias("c"), F.first("n").alias("n")).drop("fp")
    rows = _groups(stored(rows))

    members = stored(rows.select(F.col("c").alias("id")).distinct())
    packed = stored(of_ids(docs, members, id_col, text_col, lambda texts: (shingle_set(w, n).tobytes() for w in words.each(texts)), "tokens"))
    packed = packed.groupBy("id").agg(F.first("tokens").alias("tokens"))
    edges = links.where("id <> c").select(F.col("id").alias("a"), F.col("c").alias("b"))
    edges = _linked(rows, packed, edges, threshold)
    nodes = components(edges)
    met = sets.select("id", "n_shingles").join(nodes, sets["id"] == nodes["node"], "left")
    return met.select(F.col("id").alias(id_col), F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _signatures(docs: DataFrame, common: Common, words: Words, n: int, t: Fraction, id_col: str, text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            n_shingles, fp, signatures = [], [], []
            for w in words.each(texts_of(b)):
                tokens = shingle_set(w, n)
                n_shingles.append(len(tokens))
                fp.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                signatures.append(prefix(tokens, known.over(tokens, 0), known.over(tokens, 1), t).astype(np.int64))
            yield beside(
                b.column("id"), n_shingles=pa.array(n_shingles, pa.int32()), fp=pa.array(fp, pa.binary()), signatures=pa.array(signatures, pa.list_(pa.int64()))
            )

    kind = docs.schema[id_col].dataType.simpleString()
    cols = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return cols.mapInArrow(run, f"id {kind}, n_shingles int, fp binary, signatures array<bigint>")


def _groups(rows: DataFrame) -> DataFrame:
    """rows (s, c, n) of those signatures that more than one class has; of signatures with just the same classes, which
    near copies have by the hundred, one is kept. The classes are told apart by their number and two 64-bit sums."""
    own = rows.groupBy("s").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(2))).alias("y")
    )
    kept = own.where("k > 1").groupBy("k", "x", "y").agg(F.min("s").alias("s")).select("s")
    return stored(rows.join(kept, "s", "left_semi"))


def _linked(rows: DataFrame, packed: DataFrame, edges: DataFrame, t: Fraction) -> DataFrame:
    """edges and, for all classes in rows (s, c, n), verified ones that join every component.

    First every member of a group meets the group's pivot, which joins most of what belongs together. What is open then
    meets group by group: all members of different components, in small groups as pairs, in large ones block by block.
    """
    pivots = rows.groupBy("s").agg(F.min(F.struct(F.xxhash64("c"), "c", "n")).alias("p")).select("s", F.col("p.c").alias("b"), F.col("p.n").alias("nb"))
    pairs = rows.join(pivots, "s").where((F.col("c") != F.col("b")) & _fits(t, "n", "nb"))
    pairs = pairs.select(F.greatest("c", "b").alias("a"), F.least("c", "b").alias("b")).distinct()
    found = stored(_verified(pairs, packed, t))

    now = _merged(_open(rows, found))
    sizes = now.groupBy("s").agg(F.count(F.lit(1)).alias("size"), (8 * F.sum(F.col("n").cast("long"))).alias("bytes"))
    now = stored(now.join(sizes, "s"))
    small = now.where(F.col("size") <= SMALL)
    other = small.select("s", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb"))
    pairs = small.join(other, "s").where((F.col("c") < F.col("b")) & (F.col("k") != F.col("kb")) & _fits(t, "n", "nb"))
    found = found.unionByName(stored(_verified(pairs.select("c", "b").withColumnRenamed("c", "a").distinct(), packed, t)))
    found = found.unionByName(stored(_between_blocks(now.where(F.col("size") > SMALL), packed, t)))
    return edges.unionByName(found)


def _fits(t: Fraction, a: str, b: str) -> F.Column:
    """Whether sets of these sizes can be as similar as t."""
    return F.least(a, b) * t.denominator >= F.greatest(a, b) * t.numerator


def _open(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(s, c, n, k) of groups that aren't inside one component k of the links found."""
    nodes = components(found)
    now = rows.join(nodes, rows["c"] == nodes["node"], "left").select("s", "c", "n", F.coalesce("component", "c").alias("k"))
    now = stored(now)
    left = now.groupBy("s").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("s")
    return stored(now.join(left, "s", "left_semi"))


def _merged(now: DataFrame) -> DataFrame:
    """Groups with much the same members made one, as near copies have hundreds of such groups: first those that are
    connected by shared members, then those whose member of least hash is the same, under two hashes."""
    firsts = now.groupBy("s").agg(F.min("c").alias("b"))
    nodes = stored(components(now.join(firsts, "s").where("c <> b").select(F.col("c").alias("a"), "b")))
    now = _one(now, firsts.join(nodes, firsts["b"] == nodes["node"]).select("s", F.col("component").alias("g")))
    for salt in (21, 22):
        now = _one(now, now.groupBy("s").agg(F.min(F.xxhash64("c", F.lit(salt))).alias("g")))
    return now


def _one(now: DataFrame, to: DataFrame) -> DataFrame:
    """Groups s of the same g in to (s, g) made one where the square of their members is at most the sum of theirs."""
    to = stored(to)
    each = now.groupBy("s").agg(F.count(F.lit(1)).alias("m")).join(to, "s").groupBy("g").agg(F.sum(F.col("m") * F.col("m")).alias("each"))
    whole = now.join(to, "s").select("g", "c").distinct().groupBy("g").agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("all"))
    one = whole.join(each, "g").where(F.col("all") <= F.col("each")).select("g", F.xxhash64("g", F.lit(9)).alias("one"))
    named = to.join(one, "g", "left").select("s", F.coalesce("one", "s").alias("to"))
    return stored(now.join(named, "s").groupBy(F.col("to").alias("s"), "c").agg(F.first("n").alias("n"), F.first("k").alias("k")))


def _between_blocks(now: DataFrame, packed: DataFrame, t: Fraction) -> DataFrame:
    """Links between members of different components in large groups (s, c, n, k, size, bytes). Members are dealt into
    blocks of about BLOCK members and BLOCK_BYTES; every two blocks of a group meet as one row, whose sets are compared by
    a product of 0/1 matrices. A block's row tells which others it meets, so no task gets all pairs of a group."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))
    met = now.select("s", "c", "k", blocks.alias("blocks"), F.pmod(F.xxhash64("c", F.lit(4)), blocks).alias("block"))
    met = met.join(packed, met["c"] == packed["id"])
    held = stored(met.groupBy("s", "blocks", "block").agg(F.collect_list(F.struct("c", "k", "tokens")).alias("x")))
    pairs = held.select("s", "block", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("block2"))
    work = pairs.join(held.select("s", "block", "x"), ["s", "block"])
    work = work.join(held.select("s", F.col("block").alias("block2"), F.col("x").alias("y")), ["s", "block2"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x, y in zip(b["x"], b["y"], strict=True):
                yield _links_between(x, y, t)

    kind = now.schema["c"].dataType.simpleString()
    return work.select("x", "y").mapInPandas(run, f"a {kind}, b {kind}")


def _links_between(x: list, y: list, t: Fraction) -> pd.DataFrame:
    sets = [np.frombuffer(r["tokens"], dtype=np.uint64) for r in [*x, *y]]
    sizes = np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    same = np.zeros((len(x), len(y)))
    for start in range(0, int(column.max()) + 1, 4096):  # a slice of the tokens at a time
        here = (column >= start) & (column < start + 4096)
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[row[here], column[here] - start] = 1
        same += m[: len(x)] @ m[len(x) :].T
    same = same.astype(np.int64)
    union = sizes[: len(x), None] + sizes[None, len(x) :] - same
    c, d = (np.array([r["c"] for r in z]) for z in (x, y))
    k, m = (np.array([r["k"] for r in z]) for z in (x, y))
    hit = (same * t.denominator >= union * t.numerator) & (k[:, None] != m[None, :])
    i, j = np.nonzero(hit)
    tree = spanning(c[i].tolist(), d[j].tolist())  # links inside what is joined already add nothing
    i, j = i[tree], j[tree]
    return pd.DataFrame({"a": np.maximum(c[i], d[j]), "b": np.minimum(c[i], d[j])})


def _verified(pairs: DataFrame, packed: DataFrame, t: Fraction) -> DataFrame:
    met = pairs.join(packed.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    met = met.join(packed.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = np.zeros(len(b), dtype=bool)
            for k, (x, y) in enumerate(zip(b["x"], b["y"], strict=True)):
                both = np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep[k] = same * t.denominator >= (len(both) - same) * t.numerator
            yield b.loc[keep, ["a", "b"]]

    return met.mapInPandas(run, pairs.select("a", "b").schema)


def keep_one(docs: DataFrame, **given) -> DataFrame:
    """docs without those rows whose id isn't the least of its component. Rows that share an id are one document here and
    stay or go together; rows with a null id stay; so do those without words. An empty table gives no rows."""
    id_col = given.get("id_col", "doc_id")
    out = stored(ngram_join(docs, **given).where(f"component_id <> `{id_col}`").select(id_col))
    return docs.join(sized(out, 16), id_col, "left_anti")
