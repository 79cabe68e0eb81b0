"""Forward-return labels, embargoed walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitframe.operators.windows import Series


@dataclass(frozen=True)
class Walk:
    """Lengths in rows of a walk-forward test; the embargo keeps labels from reaching into the test."""

    train: int
    test: int
    step: int
    embargo: int


def targets(prices: DataFrame, entity: str, gold: str, peer: str, horizon: int, at: str = "date", name: str = "symbol", value: str = "close") -> DataFrame:
    """Forward return of an entity, and whether it beats gold and a peer; a missing rival counts as not beaten."""
    f = prices.where(F.col(name).isin(entity, gold, peer)).select(at, name, Series(by=(name,), order=(at,)).forward(F.col(value), horizon).alias("f"))
    rival = lambda s, c: f.where(F.col(name) == s).select(at, F.col("f").alias(c))
    own = f.where((F.col(name) == entity) & F.col("f").isNotNull()).select(at, F.col("f").alias("forward_return"))
    joined = own.join(rival(gold, "_g"), at, "left").join(rival(peer, "_p"), at, "left")
    beats = lambda c: F.coalesce(F.col("forward_return") > F.col(c), F.lit(False)).cast("int")
    return joined.select(at, "forward_return", beats("_g").alias("outperform_gold"), beats("_p").alias("beat_peer"))


def series_folds(sizes: DataFrame, walk: Walk, n: str = "n") -> DataFrame:
    """Row bounds, upper ones open, of each fold of series of ``n`` rows: training ends an embargo before its test begins.

    One row of ``sizes`` per series; one that is too short, or has a null
    length, has no folds.
    """
    first, last = F.lit(walk.train + walk.embargo), F.col(n) - walk.test
    start = F.col("_start")
    starts = F.when(last >= first, F.sequence(first.cast("long"), F.greatest(first, last).cast("long"), F.lit(walk.step).cast("long")))
    rows = sizes.withColumn("_start", F.explode(starts))
    return rows.select(
        *[c for c in sizes.columns if c != n], ((start - walk.train - walk.embargo) / walk.step).cast("int").alias("fold"), (start - walk.embargo - walk.train).alias("train_lo"), (start - walk.embargo).alias("train_hi"),
        start.alias("test_lo"), (start + walk.test).alias("test_hi"),
    )


def folds(spark, n: int, walk: Walk) -> DataFrame:
    """The folds of one series of ``n`` rows."""
    return series_folds(spark.range(1).select(F.lit(n).alias("n")), walk)


def fitted_walk(n: int, horizon: int) -> Walk | None:
    """Lengths scaled to the rows there are; None where no test fits."""
    if n < 80:
        return None
    train, test, step = min(252, max(40, int(n * 0.55))), min(42, max(10, int(n * 0.12))), min(21, max(5, int(n * 0.08)))
    while train > 30 and train + horizon + test > n:
        train, test = train - 10, max(8, test - 2)
    return Walk(train, test, step, horizon) if train + horizon + test <= n else None


def fitted_lengths(n: Column, horizon: Column) -> Column:
    """:func:`fitted_walk` for columns: a struct of ``train``, ``test`` and ``step``, null where no test fits."""
    within = lambda low, share, high: F.least(F.lit(high), F.greatest(F.lit(low), F.floor(n * share)))
    train, test, step = within(40, 0.55, 252), within(10, 0.12, 42), within(5, 0.08, 21)
    fits = lambda x: x["train"] + horizon + x["test"] <= n
    shorter = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: F.struct((train - 10 * k).alias("train"), F.greatest(F.lit(8), test - 2 * k).alias("test"), step.alias("step")))
    first = F.get(F.filter(shorter, lambda x: (x["train"] <= 30) | fits(x)), F.lit(0))
    return F.when((n >= 80) & fits(first), first)


def walk_rows(rows: DataFrame, walk: Walk, by: Sequence[str], at: str = "date") -> DataFrame:
    """``rows`` once for each ``fold`` of their series that holds them, with ``rn`` and ``part`` (train or test).

    Folds run over each series' whole length, as :func:`folds` has them.  A
    row finds its folds by arithmetic on its number, so there is no join and
    one shuffle by series; a series too short for a fold gives no rows, and
    rows of one date are numbered in no fixed order.
    """
    series = Window.partitionBy(*by)
    r = F.row_number().over(series.orderBy(at)) - 1
    lead, step = walk.train + walk.embargo, walk.step
    numbered = rows.withColumns({"rn": r, "_last": F.floor((F.count("*").over(series) - walk.test - lead) / step)})

    def holding(start, length: int, part: str):
        """Folds whose part, ``length`` rows long, holds the row that is ``start`` rows into that of fold 0."""
        first, last = F.greatest(F.floor((start - length) / step) + 1, F.lit(0)), F.least(F.floor(start / step), F.col("_last"))
        held = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
        return F.transform(held, lambda k: F.struct(k.cast("int").alias("fold"), F.lit(part).alias("part")))

    rn = F.col("rn")
    parts = [holding(rn, walk.train, "train"), holding(rn - lead, walk.test, "test")]
    return numbered.select(*[F.col(c) for c in rows.columns], "rn", F.inline(F.concat(*parts)))
