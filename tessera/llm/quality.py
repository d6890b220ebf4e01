"""Quality classifier by compression: which of two dictionaries, of good or of bad text, shortens a text more."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import fit_split, logistic, odds, probability, sample, scored
from tessera.llm.shared import bounded_batches

#: Bounds of the labelled sample: rows and bytes for each label.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 8 << 20
#: Bytes of a dictionary, bytes of a text that are compressed at once, compression level.
DICTIONARY, PIECE, LEVEL = 1 << 16, 512, 3
#: Bytes of text at which its features count half.
FAINT = 64


def _pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def _dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary trained on the pieces of texts; where they are too few for training, their plain bytes."""
    pieces = [p for t in texts for p in _pieces(t.encode("utf-8", "surrogatepass"))]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-size:]


def _features(good: bytes, bad: bytes) -> Callable[[list[str]], np.ndarray]:
    """Compressed-size features of whole texts. Every piece of a text is compressed with either dictionary; the
    difference is divided by the piece's bytes."""

    def compressor(raw: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    g, b = compressor(good), compressor(bad)

    def features(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 5))  # the last one says how much the others are worth
        for k, t in enumerate(texts):
            pieces = _pieces(t.encode("utf-8", "surrogatepass"))
            if not pieces:
                continue
            n = np.array([len(p) for p in pieces])
            cg = np.array([len(g.compress(p)) for p in pieces])
            cb = np.array([len(b.compress(p)) for p in pieces])
            each = (cb - cg) / np.maximum(n, 32)
            rate = (cb.sum() + cg.sum()) / (2 * n.sum())
            out[k] = (cb - cg).sum() / max(n.sum(), 32), np.median(each), rate, rate * rate, n.sum() / (n.sum() + FAINT)
        return out

    return features


def _weighed(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Features of short texts drawn towards the mean; an empty text is at the mean."""
    return mean + (x[:, :-1] - mean) * x[:, -1:]


class Model:
    """From whole texts to the probability of label 1, by dictionaries of good and of bad text, the mean features and a
    calibration."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = good, bad
        self.mean: np.ndarray | None = None
        self.calibration: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:  # dictionaries can't be pickled: each worker loads them once
        return {k: v for k, v in vars(self).items() if k != "_loaded"}

    def features(self, texts: list[str]) -> np.ndarray:
        if "_loaded" not in vars(self):
            self._loaded = _features(self.good, self.bad)
        return self._loaded(texts)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return probability(_weighed(self.features(texts), self.mean), self.calibration)


def fit(bad: list[str], good: list[str], ones: float | None = None) -> Callable[[list[str]], np.ndarray]:
    """The Model of labelled texts; without texts of either label a constant. The dictionaries are built from three quarters
    of the texts, without lines that several of them share (copies and boilerplate say nothing about a label); the
    calibration is a logistic regression on the rest, moved to the odds `ones` of label 1 (by default those of the
    texts)."""
    if not bad or not good:  # one label only, or none: there is nothing to tell apart
        p = 0.5 if not bad and not good else float(bool(good))
        return lambda texts: np.full(len(texts), p)
    (b0, g0), (b1, g1) = fit_split(bad, good)
    lines = Counter(line for t in [*b0, *g0] for line in set(t.split("\n")))
    own = lambda texts: ["\n".join(x for x in t.split("\n") if lines[x] == 1) for t in texts]
    model = Model(_dictionary(own(g0)), _dictionary(own(b0)))
    x = model.features([*b1, *g1])
    y = np.r_[np.zeros(len(b1)), np.ones(len(g1))]
    model.mean = x[:, :-1].mean(0)
    model.calibration = logistic(_weighed(x, model.mean), y)
    if ones is not None:
        model.calibration[2][-1] += np.log(ones * len(b1) / len(g1))
    return model


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    usable: Callable[[Column], Column] = lambda i: F.lit(True),
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows: int = SAMPLE_ROWS,
    most_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1; higher: label 1 likelier), predicted (1 if score >= threshold).

    The model is fitted on the driver on a bounded sample of labelled rows for which usable(id) holds (rows and
    most_bytes per label) and applied to every whole text in one pass; nothing but the text enters a score.

    Null and empty texts get the score of the mean features. Null ids and repeated rows are scored like others.
    Without labels every score is 0.5; with one label only it is that label. Other columns are ignored.
    """
    bad, good = sample(docs, labels, label_col, usable, rows, most_bytes, id_col, text_col)
    ones = odds(labels, label_col, usable, id_col)
    out = scored(docs, fit(bad, good, ones), id_col, text_col)
    return out.select(id_col, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    usable: Callable[[Column], Column] = lambda i: F.lit(True),
    threshold: float = 0.7,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    rows: int = SAMPLE_ROWS,
    most_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores threshold or more; one pass without a shuffle.

    Null and empty texts get the score of the mean features. Repeated and null ids keep or lose each row by its own text.
    Where no usable label is known, or only one of the two, nothing can be told apart and all rows stay. An empty table
    gives no rows."""
    bounded_batches(docs.sparkSession)
    bad, good = sample(docs, labels, label_col, usable, rows, most_bytes, id_col, text_col)
    if not bad or not good:
        return docs
    score = fit(bad, good, odds(labels, label_col, usable, id_col))

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(score([t if isinstance(t, str) else "" for t in texts]))

    return docs.where(scores(docs[text_col]) >= threshold)
