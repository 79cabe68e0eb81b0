"""Aggregates over scores, labels and portfolios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitframe.operators.scans import SLICES, sums_before

#: The right edges of five equal bins as floating point has them.
BIN_EDGES = (0.2, 0.4, 0.6000000000000001, 0.8, 1.0)
LEAST_SCORES = 5


def calibration(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Predicted and realised rates in five bins on [0, 1], the last closed; empty bins are left out.

    A group of fewer than five rows has no bins.
    """
    low = F.lit(None).cast("double")
    for i in range(4, -1, -1):
        top = F.col(p) <= 1.0 if i == 4 else F.col(p) < BIN_EDGES[i]
        low = F.when((F.col(p) >= (0.0 if i == 0 else BIN_EDGES[i - 1])) & top, F.lit(round(i * 0.2, 2))).otherwise(low)
    binned = df.withColumn("bin_low", low)
    got = binned.groupBy(*by, "bin_low").agg(F.count("*").alias("n"), F.sum(p).alias("_p"), F.sum(y).alias("_y"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(0)))
    got = got.withColumn("_all", total).where(F.col("bin_low").isNotNull() & (F.col("_all") >= LEAST_SCORES))
    return got.select(
        *by, "bin_low", F.round(F.col("bin_low") + 0.2, 2).alias("bin_high"), "n", F.round(F.col("_p") / F.col("n"), 3).alias("mean_predicted"), F.round(F.col("_y") / F.col("n"), 3).alias("realized_rate")
    )


def auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by the Mann-Whitney count, ties half.

    Scores are grouped by value first, and negatives below each value are
    summed over slices of the scores, so that no task holds a group's scores:
    slices of equal width between 0 and 1, as scores mostly are probabilities;
    others come out right all the same.
    Null with fewer than five rows or one class; rows without a score or a
    label do not count.
    """
    scored = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    at = scored.groupBy(*by, p).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.sum(1 - F.col(y).cast("double")).alias("neg"))
    below = F.col("_below")
    place = F.least(F.greatest(F.floor(F.nanvl(F.col(p).cast("double"), F.lit(2.0)) * SLICES), F.lit(-1)), F.lit(SLICES))
    won = sums_before(at, by, [p], {"_below": "neg"}, slice_=place).withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    got = won.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    ok = (F.col("np") > 0) & (F.col("nn") > 0) & (F.col("np") + F.col("nn") >= LEAST_SCORES)
    return got.select(*by, (F.col("np") + F.col("nn")).cast("long").alias("n"), F.when(ok, F.col("won") / (F.col("np") * F.col("nn"))).alias("auc"))


def accuracy(y: Column, p: Column, cut: float = 0.5) -> Column:
    return F.avg(((p > cut) == (y == 1)).cast("double"))


def concentration(df: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """Herfindahl index, effective number, share of the three largest, the largest."""
    w = F.col(weight)
    got = df.groupBy(*by).agg(F.sum(w * w).alias("hhi"), F.max(w).alias("max_weight"))
    # The three largest, by a rank that keeps three rows a group and task before the shuffle.
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(weight)))
    top = df.select(*by, weight).withColumn("_place", place).where(F.col("_place") <= 3).groupBy(*by).agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("top3"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    got = got.join(top.withColumnsRenamed({c: f"_k_{c}" for c in by}), same)
    return got.select(*by, "hhi", F.try_divide(F.lit(1.0), "hhi").alias("effective_n"), "top3", "max_weight")


def covariance(long: DataFrame, at: str, name: str, value: str) -> DataFrame:
    """Sample covariances of every pair of series on the times both have, and how many those are.

    A blocked Gramian: each task turns the times that it holds into a matrix,
    adds up products of its columns, and passes on one row per pair of series;
    these are summed.  Values are first drawn to their series' mean, so that
    no digits are lost in the sums.  A time has a value per series at most;
    null and NaN values are gaps; a pair with one common time has a null
    covariance, a pair with none has no row.  A task holds three square
    matrices over the series that it meets.
    """
    x = F.col(value).cast("double")
    rows = long.where(x.isNotNull() & ~F.isnan(x) & F.col(name).isNotNull()).select(F.col(at).alias("t"), F.col(name).alias("s"), x.alias("x"))
    centred = rows.select("t", "s", (F.col("x") - F.avg("x").over(Window.partitionBy("s"))).alias("x"))
    wide = centred.groupBy("t").agg(F.collect_list(F.struct("s", "x")).alias("v")).select(F.col("v.s").alias("s"), F.col("v.x").alias("x"))
    kind = rows.schema["s"].dataType.simpleString()

    def gram(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: dict = {}
        n = sx = xy = np.zeros((0, 0))
        for part in parts:
            for names in part["s"]:
                for s in names:
                    place.setdefault(s, len(place))
            k = len(place)
            grow = lambda m: np.pad(m, (0, k - len(m)))  # noqa: B023, E731
            n, sx, xy = grow(n), grow(sx), grow(xy)
            for lo in range(0, len(part), 256):
                own = part.iloc[lo : lo + 256]
                there, x = np.zeros((len(own), k)), np.zeros((len(own), k))
                for i, (names, values) in enumerate(zip(own["s"], own["x"])):
                    at = [place[s] for s in names]
                    there[i, at], x[i, at] = 1, values
                n, sx, xy = n + there.T @ there, sx + x.T @ there, xy + x.T @ x
        names = np.array(list(place), object)
        for i, a in enumerate(names):
            met = np.flatnonzero(n[i])
            yield pd.DataFrame({"a": a, "b": names[met], "n": n[i, met].astype(np.int64), "sx": sx[i, met], "sy": sx[met, i], "xy": xy[i, met]})

    sums = wide.mapInPandas(gram, f"a {kind}, b {kind}, n long, sx double, sy double, xy double")
    total = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "xy")])
    cov = (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)
    return total.select("a", "b", F.when(F.col("n") > 1, cov).alias("cov"), "n")


def label_correlation(long: DataFrame, feature: str, value: str, label: str, by: Sequence[str] = (), least: int = 30) -> DataFrame:
    """Pearson correlation of each feature with the label; too few pairs or a constant feature are left out."""
    x, y = F.col(value).cast("double"), F.col(label).cast("double")
    both = x.isNotNull() & y.isNotNull()
    got = long.where(both).groupBy(*by, feature).agg(F.corr(x, y).alias("corr"), F.count("*").alias("n"), F.stddev_samp(x).alias("sd"))
    return got.where((F.col("n") >= least) & (F.col("sd") > 0) & F.col("corr").isNotNull())


def newey_west(df: DataFrame, by: Sequence[str], order: str, x: str, lags: int) -> DataFrame:
    """Bartlett-weighted variance of the mean of each series, ``lags`` lags at most."""
    w = Window.partitionBy(*by)
    d = df.select(*by, order, (F.col(x) - F.avg(x).over(w)).alias("d"), F.count("*").over(w).alias("n"))
    ordered = Window.partitionBy(*by).orderBy(order)
    terms = [F.sum(F.col("d") * F.col("d")).alias("g0")]
    for k in range(1, lags + 1):
        d = d.withColumn(f"l{k}", F.lag("d", k).over(ordered))
        terms.append(F.coalesce(F.sum(F.col("d") * F.col(f"l{k}")), F.lit(0.0)).alias(f"g{k}"))
    got = d.groupBy(*by).agg(F.max("n").alias("n"), *terms)
    used = F.least(F.lit(lags), F.col("n") - 1)
    total = F.col("g0")
    for k in range(1, lags + 1):
        total = total + F.when(F.lit(k) <= used, 2 * (1 - F.lit(float(k)) / (used + 1)) * F.col(f"g{k}")).otherwise(F.lit(0.0))
    return got.select(*by, "n", F.when(F.col("n") >= 2, total / F.col("n") / F.col("n")).alias("nw_var"))


def holm(df: DataFrame, by: Sequence[str], index: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values within each group."""
    keys = list(by) or [F.lit(0)]
    w = Window.partitionBy(*keys).orderBy(p, index)
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = df.withColumn("rank", F.row_number().over(w)).withColumn("_raw", F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(w) + 1)))
    adjusted = F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_adjusted", adjusted).withColumn("significant", F.col("p_adjusted") < alpha).drop("_raw")
