"""Inference for dependent series: block bootstrap, Diebold-Mariano, Holm, books."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitframe.operators.stats import holm, newey_west
from pitframe.operators.windows import Series

REPLICATIONS = 2000
LEAST_FOR_CI, LEAST_FOR_DM = 3, 4


def normal_cdf(x: Column) -> Column:
    """The normal distribution function by Hart's rational form of erfc, within 1e-15 of it; no Python."""
    # Continued fraction beyond 7.07, rational below (Hart, Computer Approximations, 5666).
    num = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    den = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
    a = F.abs(x)
    tail = F.exp(-a * a / 2)

    def horner(c: Sequence[float]) -> Column:
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * a + k
        return out

    far = tail / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / 2.506628274631
    low = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, tail * horner(num) / horner(den)).otherwise(far)
    return F.when(x > 0, 1 - low).otherwise(low)


def block_length(n: int, horizon: int) -> int:
    """The horizon, but short enough for eight blocks."""
    return max(1, min(horizon, n // 8))


def block_length_of(n: Column, horizon: Column) -> Column:
    """:func:`block_length` for columns."""
    return F.greatest(F.lit(1), F.least(horizon, F.floor(n / 8)))


def stationary_indices(n: int, mean_block: int, rng: np.random.Generator) -> np.ndarray:
    """A circular resample in blocks of geometric length (Politis and Romano, 1994)."""
    fresh = rng.random(n) < 1 / mean_block
    fresh[0] = True
    starts = rng.integers(0, n, n)
    at = np.arange(n)
    begun = np.maximum.accumulate(np.where(fresh, at, 0))
    return (starts[begun] + at - begun) % n


def moving_indices(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """A resample in whole blocks of one length, without wrapping."""
    starts = rng.integers(0, n - block + 1, -(-n // block))
    return (starts[:, None] + np.arange(block)[None, :]).reshape(-1)[:n]


def statistic(x: np.ndarray, kind: str) -> float:
    return float(np.prod(1 + x) - 1) if kind == "total" else float(x.mean())


def bootstrap(spark: SparkSession, x: Sequence[float], kind: str = "mean", block: int = 1, reps: int = REPLICATIONS, level: float = 0.95, seed: int = 42, moving: bool = False) -> DataFrame:
    """Percentile interval of the mean, hit rate or total return of one series.

    Replications are rows of a range and are dealt to tasks; each draws from a
    generator seeded by ``seed`` and its number, so the result does not depend
    on how they are dealt.  Fewer than three values, or a missing one, give
    NaN.  ``x`` is a series of a study and travels with the task.
    """
    data = np.asarray(x, float)
    if len(data) < LEAST_FOR_CI or not np.isfinite(data).all():
        nan = float("nan")
        return spark.createDataFrame([(nan, nan, nan, len(data))], "point double, low double, high double, n int")
    draw = moving_indices if moving else stationary_indices

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"s": [statistic(data[draw(len(data), block, np.random.default_rng([seed, int(i)]))], kind) for i in part["id"]]})

    a = (1 - level) / 2
    got = spark.range(reps).mapInPandas(run, "s double").agg(F.percentile("s", F.lit(a)).alias("low"), F.percentile("s", F.lit(1 - a)).alias("high"))
    return got.select(F.lit(statistic(data, kind)).alias("point"), "low", "high", F.lit(len(data)).alias("n"))


def grouped_bootstrap(df: DataFrame, by: Sequence[str], order: str, x: str, kind: str, horizon: int, reps: int = REPLICATIONS, level: float = 0.95, seed: int = 42, moving: bool = False, draws: int = 200) -> DataFrame:
    """As :func:`bootstrap`, for many series at once: each with its block length; ``moving`` draws whole blocks of it, without wrapping.

    ``draws`` replications of a series are a row of work, so those of one
    series are dealt over tasks; each is seeded by its number alone.
    """
    packed = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(x).cast("double").alias("v")))), lambda r: r["v"]).alias("x"))
    draw = moving_indices if moving else stationary_indices

    def usable(raw) -> np.ndarray | None:
        data = np.array(raw, float)
        return data if len(data) >= LEAST_FOR_CI and np.isfinite(data).all() else None

    @F.pandas_udf("double")
    def point(xs: pd.Series) -> pd.Series:
        found = [usable(raw) for raw in xs]
        return pd.Series([math.nan if data is None else statistic(data, kind) for data in found], dtype=float)

    @F.pandas_udf("array<double>")
    def drawn(xs: pd.Series, first: pd.Series) -> pd.Series:
        out = []
        for raw, lo in zip(xs, first):
            data = usable(raw)
            block = block_length(len(raw), horizon)
            out.append([] if data is None else [statistic(data[draw(len(data), block, np.random.default_rng([seed, i]))], kind) for i in range(lo, min(reps, lo + draws))])
        return pd.Series(out)

    work = packed.withColumn("_lo", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(draws))))
    work = work.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_lo")
    a = (1 - level) / 2
    spans = work.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.explode(drawn("x", "_lo")).alias("s")).groupBy(*[f"_k_{c}" for c in by])
    spans = spans.agg(F.percentile("s", F.lit(a)).alias("low"), F.percentile("s", F.lit(1 - a)).alias("high"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    nan = F.lit(math.nan)
    got = packed.select(*by, point("x").alias("point"), F.size("x").alias("n")).join(spans, same, "left")
    return got.select(*by, F.coalesce("point", nan).alias("point"), F.coalesce("low", nan).alias("low"), F.coalesce("high", nan).alias("high"), "n")


def diebold_mariano(df: DataFrame, by: Sequence[str], order: str, model: str, baseline: str, h: int = 1, alternative: str = "two-sided") -> DataFrame:
    """Test of equal accuracy of two loss columns of the same rows, for each group.

    The variance of the mean difference takes h - 1 lags; the statistic has
    the small-sample factor and a normal p-value.  Fewer than four rows, or no
    variance, give nulls.
    """
    if alternative not in ("two-sided", "less", "greater"):
        raise ValueError("alternative is two-sided, less or greater")
    d = df.withColumn("_d", F.col(model) - F.col(baseline))
    mean = d.groupBy(*by).agg(F.avg("_d").alias("mean_loss_diff"))
    var = newey_west(d, by, order, "_d", max(0, h - 1))
    both = mean.join(var, list(by)) if by else mean.join(F.broadcast(var))
    n = F.col("n")
    factor = F.sqrt(F.greatest((n + 1 - 2 * h + F.lit(h * (h - 1.0)) / n) / n, F.lit(0.0)))
    ok = (n >= LEAST_FOR_DM) & (F.col("nw_var") > 0)
    stat = F.when(ok, F.col("mean_loss_diff") / F.sqrt("nw_var") * factor)
    p = {"less": normal_cdf(F.col("statistic")), "greater": 1 - normal_cdf(F.col("statistic")), "two-sided": 2 * (1 - normal_cdf(F.abs("statistic")))}[alternative]
    out = both.withColumn("statistic", stat).withColumn("p_value", F.when(F.col("statistic").isNotNull(), p))
    return out.select(*by, "statistic", "p_value", F.when(n >= LEAST_FOR_DM, F.col("mean_loss_diff")).alias("mean_loss_diff"), F.when(ok, F.sqrt("nw_var")).alias("se"), n.cast("int").alias("n_obs"), F.lit(max(0, h - 1)).alias("hac_lags"))


def books(oos: DataFrame, cost_bps: float = 10.0, at: str = "date") -> DataFrame:
    """Wealth of five strategies that hold an entity or its benchmark, with the cost of each flip.

    ``oos`` has ``date, y, boosted, logistic, momentum, entity_fwd,
    bench_fwd``: a row per out-of-sample date.  Returns a row per strategy
    and date: ``position, net, wealth, drawdown, hit``.
    """
    call = lambda c, cut: F.when(F.col(c) > cut, 1).otherwise(0)
    strategies = {"gradient_boosting": call("boosted", 0.5), "logistic_macro": call("logistic", 0.5), "momentum": call("momentum", 0.0), "always_entity": F.lit(1), "always_benchmark": F.lit(0)}
    wide = oos.select(at, "y", "entity_fwd", "bench_fwd", *[c.cast("int").alias(k) for k, c in strategies.items()])
    long = wide.unpivot([at, "y", "entity_fwd", "bench_fwd"], list(strategies), "strategy", "position")
    s = Series(("strategy",), (at,))
    pos = F.col("position")
    net = pos * F.col("entity_fwd") + (1 - pos) * F.col("bench_fwd") - s.turnover_cost(pos, cost_bps / 10_000)
    return (
        long.withColumn("net", net).withColumn("wealth", s.wealth(F.col("net"))).withColumn("drawdown", F.col("wealth") / s.peak(F.col("wealth")) - 1)
        .withColumn("hit", F.when(~F.col("strategy").startswith("always"), (pos == F.col("y")).cast("int")))
        .select("strategy", at, "position", "net", "wealth", "drawdown", "hit")
    )


def book_summary(rows: DataFrame, at: str = "date") -> DataFrame:
    final = F.max_by("wealth", at)
    return rows.groupBy("strategy").agg(
        F.round(final, 4).alias("final_wealth"), F.round(final - 1, 4).alias("total_return"), F.round(F.min("drawdown"), 4).alias("max_drawdown"),
        F.round(F.avg("hit"), 4).alias("hit_rate"), F.round(F.avg("net"), 4).alias("avg_period_return"), F.count("*").alias("n_periods"),
    )


def study_report(oos: DataFrame, horizon: int, at: str = "date", model: str = "gradient_boosting") -> DataFrame:
    """A row per strategy of :func:`books`: its summary, the interval of its total return, and the test against ``model``.

    The loss of a book is its negative return; p-values are adjusted within
    the study (the model itself has none).
    """
    rows = books(oos, at=at)
    spans = grouped_bootstrap(rows, ["strategy"], at, "net", "total", horizon).select("strategy", F.col("low").alias("total_low"), F.col("high").alias("total_high"))
    losses = rows.select("strategy", at, (-F.col("net")).alias("_loss"))
    own = losses.where(F.col("strategy") == model).select(at, F.col("_loss").alias("_model"))
    tests = diebold_mariano(losses.where(F.col("strategy") != model).join(own, at), ["strategy"], at, "_model", "_loss", h=horizon)
    adjusted = holm(tests.withColumn("p", F.coalesce("p_value", F.lit(1.0))), [], "strategy", "p").select("strategy", "statistic", "mean_loss_diff", "p_value", "p_adjusted")
    return book_summary(rows, at).join(spans, "strategy").join(adjusted, "strategy", "left")


def interval_text(low: Column, high: Column, null_value: float, name: str) -> Column:
    """What an interval says of a null value."""
    inside = (low <= null_value) & (high >= null_value)
    shown = F.format_string("[%.4f, %.4f]", low, high)
    return (
        F.when(low.isNull() | F.isnan(low), F.lit(f"{name}: too few observations."))
        .when(inside, F.concat(F.lit(f"{name}: the interval "), shown, F.lit(f" holds {null_value:g}.")))
        .otherwise(F.concat(F.lit(f"{name}: the interval "), shown, F.lit(f" lies away from {null_value:g}.")))
    )


def dm_text(p_value: Column, mean_loss_diff: Column, model: str, baseline: Column | str) -> Column:
    """What a test of equal accuracy says: who loses less, by how much, and how surely (at 1, 5 and 10 %)."""
    base = F.lit(baseline) if isinstance(baseline, str) else baseline
    sure = F.when(p_value < 0.01, "surely so: p below 0.01").when(p_value < 0.05, "p below 0.05").when(p_value < 0.10, "perhaps: p below 0.10").otherwise("which may be chance")
    better = F.when(mean_loss_diff < 0, "less").otherwise("more")
    told = F.concat(F.lit(f"{model} loses "), F.format_string("%.4f ", F.abs(mean_loss_diff)), better, F.lit(" a period than "), base, F.lit(" ("), sure, F.format_string(", p = %.3f).", p_value))
    return F.when(p_value.isNull() | F.isnan(p_value), F.concat(F.lit(f"{model} against "), base, F.lit(": too few observations."))).otherwise(told)
