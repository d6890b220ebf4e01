"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import fit_split, logistic, probability, sample, scored

#: Bounds of the labelled sample: rows and bytes for each label.
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 10 << 20
#: Lengths of n-grams in code points, and the number of buckets that they are hashed to.
GRAMS, BUCKETS = (4, 5, 6), 1 << 20
#: Buckets with a weight: those whose log-count ratio is the most standard errors from 0, and at least so many.
FEATURES, ERRORS = 3000, 3.5
#: Added to each count, strength of the ridge, steps of the fit.
SMOOTH, RIDGE, STEPS = 1.0, 2e-3, 300


def _grams(text: str) -> np.ndarray:
    """The bucket of every n-gram of a whole text. Runs of white space count as one space; case is folded."""
    folded = " " + " ".join(text.lower().split()) + " "
    code = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype="<u4") * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    out, h = [], np.zeros(len(code), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            out.append(mixed >> np.uint32(12))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def _ratios(clean: list[np.ndarray], toxic: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratio of every bucket, and how many standard errors it is from 0; counts are of texts."""
    seen = []
    for rows in (clean, toxic):
        seen.append(np.full(BUCKETS, SMOOTH))
        for r in rows:
            seen[-1][r] += 1
    ratio = np.log(seen[1] / (len(toxic) + 2 * SMOOTH)) - np.log(seen[0] / (len(clean) + 2 * SMOOTH))
    return ratio, np.abs(ratio) / np.sqrt(1 / seen[0] + 1 / seen[1])


def _fit_linear(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and constant of a ridge logistic regression in which both labels weigh the same (Nesterov's method)."""
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(8):  # the curvature's bound by power steps
        v = x.T @ (share * (x @ v))
        bound = float(np.linalg.norm(v)) + 1e-9
        v /= bound
    step = np.float32(1 / (bound / 4 + 0.25 + RIDGE))
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    b = bahead = 0.0
    for k in range(STEPS):
        z = np.clip(x @ ahead + np.float32(bahead), -30, 30)
        miss = share * (1 / (1 + np.exp(-z)) - y).astype(np.float32)
        new, bnew = ahead - step * (x.T @ miss + np.float32(RIDGE) * ahead), bahead - float(step) * float(miss.sum())
        momentum = np.float32(k / (k + 3))
        ahead, bahead = new + momentum * (new - w), bnew + float(momentum) * (bnew - b)
        w, b = new, bnew
    return w, b


@dataclass
class Model:
    """From whole texts to the probability of label 1: the weight of each bucket that an n-gram of the text is in, added up
    once, and calibrated. A bucket's weight is its log-count ratio times what the fit gave it; most are 0."""

    weights: np.ndarray
    constant: float
    calibration: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def sums(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), 1))
        for k, t in enumerate(texts):
            grams = _grams(t)
            out[k, 0] = self.weights[np.unique(grams[self.weights[grams] != 0])].sum(dtype=np.float64) + self.constant
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        return probability(self.sums(texts), self.calibration)


def fit(clean: list[str], toxic: list[str]) -> Callable[[list[str]], np.ndarray]:
    """The Model of labelled texts; without texts of either label a constant. Three quarters of the texts give the weights,
    the rest calibrates the sum."""
    if not clean or not toxic:
        p = 0.5 if not clean and not toxic else float(bool(toxic))
        return lambda texts: np.full(len(texts), p)
    (clean, toxic), (clean_check, toxic_check) = fit_split(clean, toxic)
    rows = [np.unique(_grams(t)) for t in [*clean, *toxic]]
    y = np.r_[np.zeros(len(clean)), np.ones(len(toxic))].astype(np.float32)
    ratio, errors = _ratios(rows[: len(clean)], rows[len(clean) :])
    chosen = np.argsort(-errors, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[errors[chosen] >= ERRORS])
    at = np.full(BUCKETS, -1, dtype=np.int32)
    at[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), dtype=np.float32)
    for k, r in enumerate(rows):
        hit = at[r]
        x[k, hit[hit >= 0]] = 1
    x *= ratio[chosen].astype(np.float32)
    w, b = _fit_linear(x, y)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[chosen] = w * ratio[chosen].astype(np.float32)
    model = Model(weights, float(b))
    held = np.r_[np.zeros(len(clean_check)), np.ones(len(toxic_check))]
    model.calibration = logistic(model.sums([*clean_check, *toxic_check]), held, ridge=1e-4)
    return model


def classify_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    usable: Callable[[Column], Column] = lambda i: F.lit(True),
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = SAMPLE_ROWS,
    most_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1; higher: label 1 likelier), predicted (1 if score >= threshold).

    The model is fitted on the driver on a bounded sample of labelled rows for which usable(id) holds (rows and
    most_bytes per label) and applied to every whole text in one pass; nothing but the text enters a score.

    Null and empty texts have no n-grams and get the constant's score. Null ids and repeated rows are scored like
    others. Without labels every score is 0.5; with one label only it is that label. Other columns are ignored.
    """
    clean, toxic = sample(docs, labels, label_col, usable, rows, most_bytes, id_col, text_col)
    out = scored(docs, fit(clean, toxic), id_col, text_col)
    return out.select(id_col, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
