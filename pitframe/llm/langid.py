"""Language identification by nearest centroids of TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-gram slots, n-gram length in bytes, centroids per language and the
#: labelled rows per language that the centroids are clustered from, at most.
SLOTS = 4096
NGRAM = 3
CENTROIDS = 4
FIT_ROWS = 1500
#: A text is rejected when its cosine lies below this share of the lowest that
#: a learning text of its language and length has to its own language; lengths
#: go by powers of two of the number of n-grams, as short texts lie far off.
REJECT_SHARE = 0.6
LENGTHS = 32
#: Learning texts that a language and length needs, else all languages' nearest lengths serve.
LEAST_TEXTS = 30
_ROUNDS = 12


def counts(text: str, slots: int = SLOTS) -> np.ndarray:
    """Counts of hashed byte n-grams of the lower-cased text, white space and digits as one blank."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    data[(data < 65) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 128))] = 32
    grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    grams = grams[(data[1:-1] != 32)]
    return np.bincount(((grams * np.uint32(2654435761)) >> np.uint32(20)) % slots, minlength=slots)


def vector(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def length_of(tf: np.ndarray) -> int:
    return min(LENGTHS - 1, int(tf.sum()).bit_length())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = _ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; seeds are spread by farthest-first choice."""
    centres = x.mean(axis=0, keepdims=True)
    centres /= max(np.linalg.norm(centres), 1e-12)
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    reach: dict[str, np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        tf = counts(text, len(self.idf))
        near = self.centroids @ vector(tf, self.idf)
        at = int(near.argmax())
        return self.languages[at], float(min(1.0, max(0.0, near[at]))), bool(near[at] < self.reach[self.languages[at]][length_of(tf)])


def _document_frequencies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, seen = 0, np.zeros(SLOTS, np.int64)
    for part in parts:
        for text in part["text"]:
            if has_letter(text):
                n += 1
                seen += counts(text) > 0
    slots = np.append(np.flatnonzero(seen), -1)
    yield pd.DataFrame({"slot": slots, "n": np.append(seen[slots[:-1]], n)})


def _reaches(lows: dict[str, np.ndarray], sizes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The least cosine that is not rejected, by language and length.

    Texts shorter than any that taught are not rejected, as nothing tells how
    far off they lie; for longer ones the longest lengths seen serve.
    """
    pooled = np.min(list(lows.values()), axis=0) if lows else np.full(LENGTHS, np.inf)
    every = sum(sizes.values()) if sizes else np.zeros(LENGTHS)
    seen = np.flatnonzero(np.isfinite(pooled))
    out = {}
    for lang, low in lows.items():
        own = low.copy()
        for c in np.flatnonzero(sizes[lang] < LEAST_TEXTS):
            near = seen[np.abs(seen - c) <= max(1, np.abs(seen - c).min())]
            enough = every[: c + 1].sum() >= LEAST_TEXTS
            own[c] = pooled[near].min() if enough else 0.0
        out[lang] = REJECT_SHARE * own
    return out


def fit_language(labelled: DataFrame, fit_rows: int = FIT_ROWS, k: int = CENTROIDS) -> LanguageModel:
    """The model from rows with ``doc_id``, ``text`` and ``lang``.

    Document frequencies are counted over all the labelled rows, a partial
    vector per task.  Centroids are clustered from at most ``fit_rows`` rows
    of each language, those with the lowest hash of ``doc_id`` and text, one
    task for each language; the number of languages does not grow with the
    data.  The same rows give the cosines below which texts are rejected.
    Repeated rows teach centroids once.  Rows with a null language, or with a
    text that is null or has no letter, teach nothing; with no rows left every
    text is ``und``.  Other columns are ignored.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    found = rows.mapInPandas(_document_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(SLOTS)
    total = sum(r["n"] for r in found if r["slot"] == -1)
    for r in found:
        if r["slot"] >= 0:
            df[r["slot"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 0.1

    def clustered(part: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in part.sort_values("h")["text"] if has_letter(t)][:fit_rows]
        if not texts:
            return pd.DataFrame({"lang": [], "centroid": [], "low": [], "n": []})
        tf = [counts(t) for t in texts]
        x = np.array([vector(c, idf) for c in tf], dtype=np.float32)
        centres = spherical_kmeans(x, k)
        best, length = (x @ centres.T).max(axis=1), np.array([length_of(c) for c in tf])
        low, n = np.full(LENGTHS, np.inf), np.bincount(length, minlength=LENGTHS)
        np.minimum.at(low, length, best)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centroid": [c.astype(float).tolist() for c in centres], "low": [low.tolist()] * len(centres), "n": [n.tolist()] * len(centres)})

    # The hash threshold keeps a little over the rows wanted without a sort of
    # all texts; equal rows become one before they move, and the exact choice
    # follows per language.
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * fit_rows / n + 50 / n))).otherwise(share)
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    sample = rows.withColumn("h", h).where(F.col("h") < share * (1 << 40)).groupBy("lang", "h").agg(F.min("text").alias("text"))
    model = sample.groupBy("lang").applyInPandas(clustered, "lang string, centroid array<double>, low array<double>, n array<long>").collect()
    model.sort(key=lambda r: (r["lang"], r["centroid"]))
    lows, held = {r["lang"]: np.array(r["low"]) for r in model}, {r["lang"]: np.array(r["n"]) for r in model}
    return LanguageModel(idf.astype(np.float32), np.array([r["centroid"] for r in model], dtype=np.float32).reshape(len(model), SLOTS), [r["lang"] for r in model], _reaches(lows, held))


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``.

    ``lang_pred`` is the language of the nearest centroid, ``score`` the
    cosine to it.  A text that is null or has no letter has ``und``, 0 and is
    rejected; one farther from every centroid than its reach is rejected but
    keeps the nearest language; of equally near centroids the first by name
    counts.  A row for each row, with its columns; earlier columns of these
    names are replaced.  Whole texts are read, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred KB, whatever the data

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in texts:
            yield pd.DataFrame([own.predict(t) for t in part], columns=["lang_pred", "score", "rejected"])

    new = ("lang_pred", "score", "rejected")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    own = "_" + "_".join(docs.columns)  # a name that no column has
    out = docs.select(*kept, predicted("text").alias(own))
    return out.select(*kept, *(F.col(f"`{own}`.{c}").alias(c) for c in new))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: its id's checksum leaves 1 by three."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


__all__ = ["LanguageModel", "fit_language", "held_out", "predict_language"]
