"""Document quality by hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pitframe.llm.common import cut

#: Labelled rows that the document classifier is fitted on, at most.
FIT_ROWS = 20_000
#: Rows of the site tables that may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
FEATURES = ("symbols", "upper", "repeated", "long_words", "digits", "distinct", "stops")
_SYMBOLS = np.array([c for c in range(33, 127) if chr(c) in "!#$%&*+<=>@[\\]^_`{|}~"])
#: Pseudo-words at typical rates, so that a text of a few words is little evidence.
_PRIOR = 12.0


def _features(text: str) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size, letters = byte.sum() + 6 * _PRIOR, byte[65:91].sum() + byte[97:123].sum() + 5 * _PRIOR
    short = sum(map((4).__gt__, map(len, words)))
    triples = max(0, n - 2)
    return (
        byte[_SYMBOLS].sum() / size,
        (byte[65:91].sum() + 0.1 * _PRIOR) / letters,
        (triples - len(set(zip(words, words[1:], words[2:])))) / (triples + _PRIOR),
        1 - (short + 0.31 * _PRIOR) / (n + _PRIOR),
        byte[48:58].sum() / size,
        (len(set(words)) + 0.8 * _PRIOR) / (n + _PRIOR),
        (byte[44] + byte[46] + 0.1 * _PRIOR) / (n + _PRIOR),
    )


@F.pandas_udf(ArrayType(DoubleType()))
def text_features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([_features(x) if x else None for x in part], dtype=object)


@dataclass
class QualityModel:
    """A fitted classifier and the posteriors of hosts and paths."""

    weights: list[float]
    intercept: float
    prior: float
    host_strength: float
    path_strength: float
    sample: DataFrame = field(repr=False)
    sites: DataFrame = field(repr=False)
    sites_rows: int = 0

    def evidence(self, features: Column) -> Column:
        """The classifier's log-odds, held within what a document alone may claim."""
        dot = sum((F.element_at(features, i + 1) * F.lit(w) for i, w in enumerate(self.weights)), F.lit(self.intercept))
        return F.when(features.isNotNull(), F.greatest(F.lit(-12.0), F.least(F.lit(12.0), dot)))

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs``, which has ``doc_id, _host, _path, _features``, with probabilities.

        A document's own part is taken out of its site's sums, so it counts once.
        """
        sites = F.broadcast(self.sites) if self.sites_rows <= BROADCAST_ROWS else self.sites
        odds = lambda p: F.log(p / (1 - p))
        within = lambda x: F.greatest(F.lit(0.001), F.least(F.lit(0.999), x))
        known = with_labels(docs, self.sample).join(sites, ["_host", "_path"], "left")
        own = contribution(self)
        others = lambda c: F.greatest(F.coalesce(c, F.lit(1.0)) - 1, F.lit(0.0))
        rest = lambda c: F.greatest(F.coalesce(c, own) - own, F.lit(0.0))
        p_host = within((F.lit(self.host_strength * self.prior) + rest(F.col("host_s"))) / (F.lit(self.host_strength) + others(F.col("host_n"))))
        p_path = within((F.lit(self.path_strength) * F.col("p_host") + rest(F.col("path_s"))) / (F.lit(self.path_strength) + others(F.col("path_n"))))
        logit = self.evidence(F.col("_features")) + odds(F.col("p_path")) - F.lit(math.log(self.prior / (1 - self.prior)))
        return (
            known.withColumn("p_document", F.coalesce(1 / (1 + F.exp(-self.evidence(F.col("_features")))), F.lit(0.0)))
            .withColumn("p_host", p_host).withColumn("p_path", p_path)
            .withColumn("p_quality", F.coalesce(1 / (1 + F.exp(-logit)), F.lit(0.0)))
            .withColumn("kept", F.col("p_quality") >= 0.5)
            .drop("_label", "host_s", "host_n", "path_s", "path_n")
        )


def with_labels(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``docs`` with ``_label`` of the sampled labels, which are at most ``fit_rows``."""
    return docs.join(F.broadcast(sample.select("doc_id", F.col("label").alias("_label"))), "doc_id", "left")


def contribution(model: QualityModel) -> Column:
    """What a document adds to its site: its label where it is known, else the classifier's probability; without text nothing."""
    p = 1 / (1 + F.exp(-model.evidence(F.col("_features"))))
    return F.coalesce(F.when(F.col("_features").isNotNull(), F.coalesce(F.col("_label"), p)), F.lit(0.0))


def _strength(groups: DataFrame, p: str, n: str, mean: float) -> float:
    """Pseudo-count of the Beta prior from the spread of group means (moments)."""
    k, total, squares, spread = groups.agg(
        F.count("*"), F.sum(n), F.sum(F.col(n) * F.col(n)), F.sum(F.col(n) * F.pow(F.col(p) / F.col(n) - mean, 2))
    ).first()
    if not total or k < 2 or total * total <= squares:
        return 100.0
    between = max(1e-6, (spread - (k - 1) * mean * (1 - mean)) / (total - squares / total))
    return min(1e4, max(2.0, mean * (1 - mean) / between - 1))


def with_sites(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """``docs`` with ``_host``, ``_path`` and ``_features``; a null site is the site ''."""
    return docs.select(
        "*", F.coalesce(host.cast("string"), F.lit("")).alias("_host"), F.coalesce(path.cast("string"), F.lit("")).alias("_path"), text_features("text").alias("_features")
    )


def fit_quality(featured: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 7) -> QualityModel:
    """The model from all documents' features and a bounded sample of labels.

    ``featured`` comes from :func:`with_sites`; ``labels`` has ``doc_id`` and
    ``quality`` (0 or 1; other rows are left out).  The logistic classifier is
    fitted on at most ``fit_rows`` labelled rows, those with the lowest hash of
    ``doc_id``.  Hosts and paths gather what all their documents add, a label
    where the sample has it and else the classifier's probability: sums per path first, hosts from paths, so a host with a
    third of all rows is summed before it is shuffled.  A path's posterior
    leans on its host's, a host's on the global mean, each by a strength found
    from the spread between groups.  Without labels of both classes every
    document with text has the evidence 0.
    """
    sample = cut(
        labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(fit_rows)
    )
    rows = featured.where("_features is not null").select("doc_id", "_features").join(F.broadcast(sample), "doc_id")
    rows = rows.select(array_to_vector("_features").alias("features"), "label").cache()
    try:
        if rows.select("label").distinct().count() == 2:
            fitted = LogisticRegression(regParam=1e-4, maxIter=60).fit(rows)
            weights, intercept = [float(x) for x in fitted.coefficients], float(fitted.intercept)
        else:
            weights, intercept = [0.0] * len(FEATURES), 0.0
    finally:
        rows.unpersist()
    model = QualityModel(weights, intercept, 0.5, 100.0, 100.0, sample, featured)
    added = with_labels(featured, sample).select("_host", "_path", contribution(model).alias("p"))
    paths = cut(added.groupBy("_host", "_path").agg(F.sum("p").alias("path_s"), F.count("*").cast("double").alias("path_n")))
    hosts = paths.groupBy("_host").agg(F.sum("path_s").alias("host_s"), F.sum("path_n").alias("host_n"))
    s, n = hosts.agg(F.sum("host_s"), F.sum("host_n")).first()
    model.prior = min(0.99, max(0.01, s / n)) if n else 0.5
    model.host_strength = _strength(hosts, "host_s", "host_n", model.prior)
    model.path_strength = _strength(paths, "path_s", "path_n", model.prior)
    model.sites = paths.join(hosts, "_host")
    model.sites_rows = paths.count()
    return model


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Every document's posterior probability of good quality.

    Returns a row per input row: ``doc_id, p_document, p_host, p_path,
    p_quality, kept``.  A document whose text is null or empty has
    ``p_quality`` 0 and is not kept.  A null host or path is the site ''; a
    null ``doc_id`` has no label.  Repeated rows are scored alike and each adds
    to its site.  An empty table gives an empty one; other columns are ignored.
    """
    featured = cut(with_sites(docs.select("doc_id", "text", host.alias("_h"), path.alias("_p")), F.col("_h"), F.col("_p")).select("doc_id", "_host", "_path", "_features"))
    model = fit_quality(featured, labels, fit_rows)
    return model.score(featured).select("doc_id", "p_document", "p_host", "p_path", "p_quality", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with their columns; nulls, ties, repeats and empty tables as there.

    Texts are not shuffled: the features are taken again in the pass that
    filters, which costs less than moving whole texts to a join.
    """
    rows = with_sites(docs.select("doc_id", "text", host.alias("_h"), path.alias("_p"), F.struct("*").alias("_row")), F.col("_h"), F.col("_p"))
    model = fit_quality(cut(rows.select("doc_id", "_host", "_path", "_features")), labels, fit_rows)
    return model.score(rows.select("doc_id", "_row", "_host", "_path", "_features")).where("kept").select("_row.*")
