"""Toxicity grades by cumulative-link ordinal regression on sparse words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
#: Fitted documents that a word must be in, and the z-score of its log-odds between toxic documents and others.
LEAST_DOCS = 5
TIED_Z = 4.0
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class OrdinalModel:
    """P(grade > k) = 1 / (1 + exp(cut[k] - w.x)), with the same w for every k."""

    weights: dict[str, float]
    cuts: np.ndarray

    def above(self, text: str | None) -> np.ndarray:
        found = self.weights.keys() & words(text)
        return 1 / (1 + np.exp(np.clip(self.cuts - sum(self.weights[w] for w in found), -500, 500)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, n: int, m: int, grade: np.ndarray, levels: int, l2: float = 1e-5, rounds: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising cut points by full gradient with adaptive steps (Adam).

    ``rows`` and ``cols`` are the places of the ones in an ``n`` by ``m``
    matrix.  Cut points are the first and logarithms of the steps to the next,
    so their order holds throughout.
    """
    k = levels - 1
    share = np.array([(grade > j).mean() for j in range(k)]).clip(1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    gaps = np.maximum(np.diff(start), 0.05)
    p = np.concatenate([np.zeros(m), start[:1], np.log(gaps)])
    first, second = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(n)
    for t in range(1, rounds + 1):
        w, cuts = p[:m], p[m] + np.append(0, np.cumsum(np.exp(p[m + 1 :])))
        score = np.bincount(rows, w[cols], n) if len(rows) else np.zeros(n)
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -30, 30)))  # P(grade <= j)
        full = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))], axis=1)
        hi, lo = full[at, grade + 1], full[at, grade]
        like = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = slope[at, grade + 1] / like, slope[at, grade] / like
        d_score = (d_hi - d_lo) / n  # of the negative log-likelihood
        d_cut = np.zeros(k)
        for j in range(k):
            d_cut[j] = (-d_hi[grade == j].sum() + d_lo[grade == j + 1].sum()) / n
        tail = np.cumsum(d_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, d_score[rows], m) + l2 * w if len(rows) else l2 * w, tail[:1], tail[1:] * np.exp(p[m + 1 :])])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        p = p - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return p[:m], p[m] + np.append(0, np.cumsum(np.exp(p[m + 1 :])))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS, seed: int = 7) -> OrdinalModel:
    """A model of severity grades from labelled documents.

    ``labels`` has ``doc_id`` and ``label``: integer grades from 0 up, as many
    as there are; gaps between them are closed.  At most ``fit_rows`` labelled
    rows are used, those with the lowest hash of ``doc_id``; a document with
    several labels has the highest.  Every word of ``LEAST_DOCS`` or more of
    these documents whose log-odds between grades above 0 and 0 have a z-score
    of ``TIED_Z`` or more, either way, is a feature.  Where labels are 0 and 1 there is one
    threshold, and the expected severity is the probability of 1.  Grades are
    taken from labels only.

    Null ids and labels teach nothing; a null or empty text is a document
    without words.  Without labels of two grades nothing is toxic.
    """
    sample = (
        labels.where(f"doc_id is not null and {label} >= 0").groupBy("doc_id").agg(F.max(label).cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(fit_rows)
    )
    taken = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def exploded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 500):
                own = part.iloc[lo : lo + 500]
                found = [sorted(words(t)) for t in own["text"]]
                n = [len(x) for x in found]
                yield pd.DataFrame({"doc_id": np.repeat(own["doc_id"].to_numpy(), n), "grade": np.repeat(own["grade"].to_numpy(), n), "word": [w for x in found for w in x]})

    rows = taken.mapInPandas(exploded, "doc_id long, grade int, word string").distinct().persist()
    try:
        graded = {r["doc_id"]: r["grade"] for r in sample.collect()}  # at most fit_rows
        n1 = sum(g > 0 for g in graded.values())
        n0 = len(graded) - n1
        if not n1 or not n0:
            return OrdinalModel({}, np.array([np.inf]))
        seen = rows.groupBy("word").agg(F.count_if(F.col("grade") > 0).cast("double").alias("a"), F.count("*").cast("double").alias("c")).where(F.col("c") >= LEAST_DOCS)
        a, b = F.col("a") + 0.5, F.col("c") - F.col("a") + 0.5
        z = (F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b))) / F.sqrt(1 / a + 1 / b)
        chosen = sorted(r["word"] for r in seen.where(F.abs(z) >= TIED_Z).select("word").collect())  # words of fit_rows documents
        picked = sample.sparkSession.createDataFrame([(w, i) for i, w in enumerate(chosen)], "word string, col int")
        cells = rows.join(F.broadcast(picked), "word").select("doc_id", "col").toPandas()  # their distinct words
    finally:
        rows.unpersist()
    ids = {d: i for i, d in enumerate(sorted(graded))}
    r, c = cells["doc_id"].map(ids).to_numpy(np.int64), cells["col"].to_numpy(np.int64)
    grade = np.unique([graded[d] for d in sorted(graded)], return_inverse=True)[1]
    weights, cuts = fit_ordinal(r, c, len(ids), len(chosen), grade, int(grade.max()) + 1)
    return OrdinalModel({w: float(x) for w, x in zip(chosen, weights)}, cuts)


def grade(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, severity, p_toxic, grade, toxic`` of every row, from its whole text.

    ``severity`` is the expected grade, the sum over thresholds of the
    probability to lie above; ``p_toxic`` the probability to lie above 0;
    ``toxic`` whether that is 0.5 or more; ``grade`` the number of thresholds
    that are more likely passed than not.  A null or empty text, or one
    without a word of the model, is judged by the thresholds alone.  Repeated
    rows and null ids are judged like others, whole texts however long; other
    columns are ignored, an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words of the fitted rows

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in parts:
            above = np.array([own.above(t) for t in part["text"]]).reshape(len(part), -1)
            yield pd.DataFrame({
                "doc_id": part["doc_id"], "severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": (above >= 0.5).sum(axis=1), "toxic": above[:, 0] >= 0.5,
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
