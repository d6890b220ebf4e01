"""What the two text classifiers share: folds, a bounded labelled sample, calibration, scoring of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import beside, bounded_batches, stored, texts_of


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null ids: of 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of, F.lit(0))


def sample(
    docs: DataFrame, labels: DataFrame, label_col: str, usable: Callable[[Column], Column], rows: int, most_bytes: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[list[str], list[str]]:
    """(texts labelled 0, texts labelled 1) for fitting, on the driver: of each label, the rows whose id has the least
    hashes, at most `rows` and at most `most_bytes` of UTF-8 (both bounds are the caller's documented parameters).

    Only rows of labels for which usable(id) holds are looked at. Null ids, labels and texts are left out. An id that is
    labelled both ways counts once per label; of an id that is repeated in docs, the shortest text counts, the first by
    hash of equal ones. So the driver gets at most 2 * rows ids and 2 * most_bytes of text, whatever the tables hold."""
    known = labels.where(labels[id_col].isNotNull() & labels[label_col].isin(0, 1) & usable(labels[id_col]))
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    picked = None
    for y in (0, 1):  # each a top-n of ids: bounded
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    picked = stored(picked)
    met = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null and text <> ''")
    met = met.withColumn("n", F.octet_length("text")).where(F.col("n") <= most_bytes)
    met = met.join(F.broadcast(picked.select("id").distinct()), "id", "left_semi")
    met = met.groupBy("id").agg(F.min(F.struct("n", F.xxhash64("text").alias("h"), "text")).alias("t"))
    met = stored(met.join(F.broadcast(picked), "id").select("id", "y", F.col("t.n").alias("n"), F.col("t.text").alias("text")))
    out = []
    for y in (0, 1):
        took, wanted = 0, []
        for r in met.where(F.col("y") == y).select("id", "n").orderBy(F.xxhash64("id", F.lit(11)), "id").collect():
            if took + r.n <= most_bytes:
                took += r.n
                wanted.append(r.id)
        got = met.where((F.col("y") == y) & F.col("id").isin(wanted)).select("id", "text").collect() if wanted else []
        by_id = {r.id: r.text for r in got}
        out.append([by_id[i] for i in wanted])
    return out[0], out[1]


def odds(labels: DataFrame, label_col: str, usable: Callable[[Column], Column], id_col: str = "doc_id") -> float:
    """Number of usable rows labelled 1 for each labelled 0, over all of labels."""
    n = {r[0]: r[1] for r in labels.where(usable(labels[id_col])).groupBy(labels[label_col].cast("int")).count().collect()}
    return (n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the constant last) of a ridge logistic regression on standardised features, by
    Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge * len(x)), 0.0]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + keep * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def probability(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """(id_col, score) of each row of docs in one pass without a shuffle; null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b)
            yield beside(b.column("id"), score=pa.array(score(texts) if texts else np.zeros(0), pa.float64()))

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)


def fit_split(texts0: list[str], texts1: list[str], parts: int = 4) -> tuple[list[list[str]], list[list[str]]]:
    """Each label's texts cut in two by place: three in four to build from, one in four to calibrate on."""
    build = [[t for i, t in enumerate(x) if i % parts] or x for x in (texts0, texts1)]
    check = [[t for i, t in enumerate(x) if i % parts == 0] or x for x in (texts0, texts1)]
    return build, check
