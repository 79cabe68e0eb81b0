"""Learners: Spark ML for large fits, small boosted trees for many small ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` over all shuffle partitions: few bytes that mean much fitting are not to be coalesced into few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


LEAST_TRAIN = 100
ASOF_TRAIN, ASOF_LEAST = 120, 60


def classifier(features: Sequence[str], label: str, trees: int = 40, depth: int = 5, step: float = 0.05, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)])


def regressor(features: Sequence[str], label: str, trees: int = 40, depth: int = 5, step: float = 0.05, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)])


def logistic(features: Sequence[str], label: str, rounds: int = 400) -> Pipeline:
    """Medians for gaps, unit scale, logistic regression."""
    filled = [f"{c}__filled" for c in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, maxIter=rounds),
    ])


def probability(model: PipelineModel, rows: DataFrame, out: str = "prob") -> DataFrame:
    """``rows`` with the probability of class 1 only."""
    return model.transform(rows).select(*rows.columns, vector_to_array("probability")[1].alias(out))


def predicted(model: PipelineModel, rows: DataFrame, out: str = "predicted") -> DataFrame:
    return model.transform(rows).select(*rows.columns, F.col("prediction").alias(out))


def train(rows: DataFrame, features: Sequence[str], label: str, path: str | None = None, least: int = LEAST_TRAIN, learner: Callable[..., Pipeline] | None = None, **kw) -> tuple[str, PipelineModel | None]:
    """Status and model: no_data, insufficient_data, or trained (and saved at ``path``).

    ``learner`` makes the pipeline of features and label, :func:`classifier`
    by default; :func:`logistic` and :func:`regressor` are others.
    """
    n, lo, hi = rows.agg(F.count("*"), F.min(label), F.max(label)).first()
    if not n:
        return "no_data", None
    if n < least or lo == hi:
        return "insufficient_data", None
    model = (learner or classifier)(features, label, **kw).fit(rows)
    if path:
        model.write().overwrite().save(path)
    return "trained", model


class Stumps:
    """Boosted depth-1 trees on quantile cuts, for fits of a hundred rows inside a task."""

    def __init__(self, rounds: int = 40, rate: float = 0.1, cuts: int = 8) -> None:
        self.rounds, self.rate, self.cuts = rounds, rate, cuts

    def fit(self, x: np.ndarray, y: np.ndarray, binary: bool) -> Stumps:
        x = np.nan_to_num(x)
        self.binary, self.trees = binary, []
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if binary else float(y.mean())
        self.base = float(np.log(p / (1 - p))) if binary else p
        score = np.full(len(y), self.base)
        at = [np.unique(np.quantile(c, np.linspace(0.1, 0.9, self.cuts))) for c in x.T]
        sides = [(j, t, x[:, j] <= t) for j, ts in enumerate(at) for t in ts]
        sides = [s for s in sides if 0 < s[2].sum() < len(y)]
        if not sides:
            return self
        left = np.array([s[2] for s in sides], float)
        for _ in range(self.rounds):
            now = 1 / (1 + np.exp(-score)) if binary else score
            grad, hess = y - now, now * (1 - now) if binary else np.ones(len(y))
            gl, hl = left @ grad, left @ hess + 1.0
            gr, hr = grad.sum() - gl, hess.sum() - hl + 2.0
            best = int((gl * gl / hl + gr * gr / hr).argmax())
            j, t, mask = sides[best]
            a, b = self.rate * gl[best] / hl[best], self.rate * gr[best] / hr[best]
            self.trees.append((j, t, a, b))
            score = score + np.where(mask, a, b)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(x)
        score = np.full(len(x), self.base)
        for j, t, a, b in self.trees:
            score += np.where(x[:, j] <= t, a, b)
        return 1 / (1 + np.exp(-score)) if self.binary else score


class Logit:
    """Logistic regression on medians for gaps and unit scale, by Newton steps with a small ridge."""

    def __init__(self, ridge: float = 1.0, rounds: int = 25) -> None:
        self.ridge, self.rounds = ridge, rounds

    def fit(self, x: np.ndarray, y: np.ndarray, binary: bool = True) -> Logit:
        if not binary:
            raise ValueError("Logit has two classes")
        seen = np.where(np.isfinite(x), x, np.nan)
        self.median = np.array([np.median(c[np.isfinite(c)]) if np.isfinite(c).any() else 0.0 for c in seen.T])
        z = np.where(np.isfinite(x), x, self.median)
        self.mean, self.scale = z.mean(0), np.where(z.std(0) > 0, z.std(0), 1.0)
        z = self._design(x)
        penalty = np.full(z.shape[1], self.ridge)
        penalty[0] = 0.0
        self.w = np.zeros(z.shape[1])
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w = self.w + step
            if np.abs(step).max() < 1e-10:
                break
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = (np.where(np.isfinite(x), x, self.median) - self.mean) / self.scale
        return np.column_stack([np.ones(len(z)), z])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -30, 30)))


def chosen(fit: pd.DataFrame, features: Sequence[str], label: str, k: int, least: int = 30) -> list[str]:
    """The ``k`` features of most absolute correlation with the label in ``fit``, ties by name from the last; the first ``k`` where none has any.

    A feature needs ``least`` rows on which both are known, and more than one value on these.
    """
    found = []
    for c in features:
        pair = fit[[c, label]].astype(float).replace([np.inf, -np.inf], np.nan).dropna()
        if len(pair) >= least and pair[c].std() > 0 and pair[label].std() > 0:
            found.append((abs(float(np.corrcoef(pair[c], pair[label])[0, 1])), c))
    return [c for _, c in sorted(found, reverse=True)[:k]] or list(features)[:k]


def fold_scores(rows: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ("fold",), keep: Sequence[str] = ("rn",), learners: Mapping[str, Callable] | None = None, choose: int | None = None) -> DataFrame:
    """Out-of-sample probabilities of each fold's test rows: ``by``, ``keep``, ``y``, and a column per learner.

    ``learners`` names what makes each learner, an object with ``fit(x, y,
    binary)`` and ``predict(x)``; by default ``prob`` by :class:`Stumps`.
    ``rows`` has the fold's rows with ``part``; a fold is a window of rows, so
    a task's group is bounded.  Folds whose training rows have one class are
    left out.  With ``choose``, a fold uses that many features only, those
    most correlated with the label on its own training rows.
    """
    learners = dict(learners or {"prob": Stumps})
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, *keep]) + ", y int, " + ", ".join(f"{c} double" for c in learners)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        fit, test = part[part["part"] == "train"], part[part["part"] == "test"]
        if fit[label].nunique() < 2 or test.empty:
            return pd.DataFrame(columns=[*by, *keep, "y", *learners])
        names = chosen(fit, features, label, choose) if choose else list(features)
        x, y, at = fit[names].to_numpy(float), fit[label].to_numpy(float), test[names].to_numpy(float)
        return test[[*by, *keep]].assign(y=test[label].astype(int), **{c: make().fit(x, y, True).predict(at) for c, make in learners.items()})

    return spread(rows.select(*dict.fromkeys([*by, *keep, "part", label, *features])), *by).groupBy(*by).applyInPandas(run, schema)


def fold_metrics(scored: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    from pitframe.operators.stats import accuracy, auc

    return auc(scored, "y", "prob", by).join(scored.groupBy(*by).agg(accuracy(F.col("y"), F.col("prob")).alias("accuracy")), list(by))


def asof_scores(frame: DataFrame, features: Sequence[str], every: int | None = None, train_rows: int = ASOF_TRAIN, least: int = ASOF_LEAST, binary: Callable = Stumps, numeric: Callable = Stumps) -> DataFrame:
    """Scores of chosen dates from models that know only rows an embargo before.

    ``frame`` has ``entity, horizon_days, rn, date, y, alpha, ret`` and the
    features; ``rn`` numbers the rows of each entity and horizon by date, the
    label columns being null where the future is missing.  Each ``every``-th
    row (by default each horizon-th) and the last are scored: the model for
    row ``rn`` is fitted on the rows from ``rn - horizon - train_rows`` to
    ``rn - horizon - 1``.  Each row joins the few tasks whose window holds it,
    found by arithmetic and not by a search; a task's group is the window.
    Tasks with too few rows or one class give no score.  ``binary`` makes the
    learner of the probability, ``numeric`` that of returns.
    """
    h = F.col("horizon_days")
    step = F.lit(every) if every else h
    rows = frame.withColumn("_top", F.max("rn").over(Window.partitionBy("entity", "horizon_days")))
    # Tasks are rows t with t % step = 0, or the last; this row trains t in rn + h + 1 .. rn + h + train_rows.
    first = (F.floor((F.col("rn") + h) / step) + 1) * step
    last = F.least(F.col("rn") + h + train_rows, F.col("_top"))
    regular = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), step.cast("long"))).otherwise(F.array().cast("array<long>"))
    final = F.when((F.col("_top") % step != 0) & (F.col("_top") > F.col("rn") + h) & (F.col("_top") <= F.col("rn") + h + train_rows), F.array(F.col("_top").cast("long"))).otherwise(F.array().cast("array<long>"))
    train = rows.where("y is not null").withColumn("t", F.explode(F.concat(regular, final))).withColumn("part", F.lit("train"))
    score = rows.where((F.col("rn") % step == 0) | (F.col("rn") == F.col("_top"))).withColumn("t", F.col("rn").cast("long")).withColumn("part", F.lit("score"))
    cols = ["entity", "horizon_days", "t", "part", "date", "y", "alpha", "ret", *features]
    tasks = train.select(*cols).unionByName(score.select(*cols))
    names = list(features)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        fit, at = part[part["part"] == "train"].sort_values("date"), part[part["part"] == "score"]
        out = ["entity", "horizon_days", "date", "prob", "expected_return", "expected_alpha", "n_train"]
        if at.empty or len(fit) < least or fit["y"].nunique() < 2:
            return pd.DataFrame(columns=out)
        x, one = fit[names].to_numpy(float), at[names].to_numpy(float)[:1]
        p = binary().fit(x, fit["y"].to_numpy(float), True).predict(one)[0]
        ret = numeric().fit(x, fit["ret"].to_numpy(float), False).predict(one)[0]
        alpha = numeric().fit(x, fit["alpha"].to_numpy(float), False).predict(one)[0]
        return pd.DataFrame([(at["entity"].iloc[0], at["horizon_days"].iloc[0], at["date"].iloc[0], p, ret, alpha, len(fit))], columns=out)

    schema = "entity string, horizon_days int, date date, prob double, expected_return double, expected_alpha double, n_train int"
    got = spread(tasks, "entity", "horizon_days", "t").groupBy("entity", "horizon_days", "t").applyInPandas(run, schema)
    return got.withColumn("model_version", F.concat(F.lit("asof_h"), F.col("horizon_days").cast("string")))


def expected_returns(rows: DataFrame, features: Sequence[str], label: str, trailing: str, by: Sequence[str], at: str = "date", least: int = 60, top: int = 60) -> DataFrame:
    """What each series is expected to return from its last row: ``by``, ``date``, ``expected_return``, ``source``.

    Fitted on the rows with a label and the ``top`` features of most variance;
    below ``least`` such rows it is the last row's ``trailing`` move.  A
    series has a row per date, which bounds a task's group.
    """
    kinds, names = dict(rows.dtypes), list(features)
    out = [*by, "date", "expected_return", "source"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at)
        last, fit = part.iloc[-1:], part[part[label].notna()]
        if len(fit) < least:
            value, source = last[trailing].iloc[0], "trailing"
        else:
            used = fit[names].var().sort_values(ascending=False, kind="stable").index[:top]
            value, source = Stumps(rounds=60).fit(fit[used].to_numpy(float), fit[label].to_numpy(float), False).predict(last[used].to_numpy(float))[0], "model"
        return pd.DataFrame([(*last[list(by)].iloc[0], last[at].iloc[0], value, source)], columns=out)

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + f", date {kinds[at]}, expected_return double, source string"
    return rows.select(*by, at, label, trailing, *[c for c in names if c != trailing]).groupBy(*by).applyInPandas(run, schema)


def stability(a: DataFrame, b: DataFrame, on: Sequence[str], p: str = "prob") -> DataFrame:
    """How often two models call alike, and how often each calls the entity."""
    j = a.select(*on, F.col(p).alias("_a")).join(b.select(*on, F.col(p).alias("_b")), list(on))
    x, y = F.col("_a") > 0.5, F.col("_b") > 0.5
    return j.agg(F.avg((x == y).cast("double")).alias("agreement"), F.avg(x.cast("double")).alias("rate_full"), F.avg(y.cast("double")).alias("rate_reduced"), F.count("*").alias("n"))


