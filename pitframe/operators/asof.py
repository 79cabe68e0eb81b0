"""Reads as of a time: vintages, validity intervals, backward joins, release dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitframe.operators.scans import last_before


def known_at(df: DataFrame, release: str, as_of: date | str | None) -> DataFrame:
    """Rows released by ``as_of``; a null release is never known.  None: all rows."""
    return df if as_of is None else df.where(F.col(release) <= F.lit(as_of).cast("date"))


def latest_vintage(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], release: str, as_of: date | str | None = None) -> DataFrame:
    """One row per key: the last by ``order``, nulls first, among those known.

    An aggregate of a struct and not a window: each task keeps one row per
    key before the shuffle, so keys with many vintages cost little.
    """
    last = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_last")
    return known_at(df, release, as_of).groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


def vintage_intervals(df: DataFrame, keys: Sequence[str], order: Sequence[str], release: str) -> DataFrame:
    """``df`` with ``valid_from`` and ``valid_to``: when each vintage is the one in force.

    A vintage that another of the same release date follows at once is in
    force for no time and is left out.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    spans = df.where(F.col(release).isNotNull()).withColumn("valid_to", F.lead(release).over(w))
    return spans.withColumn("valid_from", F.col(release)).where("valid_to is null or valid_to > valid_from")


#: Times that may be written into a plan.
FEW_TIMES = 1_000


def history_at(intervals: DataFrame, times: DataFrame, time: str, width: int = 32) -> DataFrame:
    """The rows in force at each of ``times``, distinct dates; null times have none.

    Up to ``FEW_TIMES`` times, each interval is spread over those within it,
    without a join.  More are joined by stretches of ``width`` days: an
    interval meets only the times of the stretches that it touches.
    """
    kind = times.schema[time].dataType
    some = sorted(r[0] for r in times.select(time).where(F.col(time).isNotNull()).limit(FEW_TIMES + 1).collect())
    open_end = F.col("valid_to").isNull()
    if len(some) <= FEW_TIMES:
        known = F.array(*[F.lit(t).cast(kind) for t in some]) if some else F.array().cast(f"array<{kind.simpleString()}>")
        within = F.filter(known, lambda t: (F.col("valid_from") <= t) & (open_end | (t < F.col("valid_to"))))
        return intervals.withColumn(time, F.explode(within))
    stretch = lambda c: F.floor(F.datediff(c, F.lit(date(1970, 1, 1))) / width)
    latest = times.agg(F.max(time)).first()[0]
    ends = F.least(F.coalesce("valid_to", F.lit(latest)), F.lit(latest))
    spread = intervals.where(F.col("valid_from") <= F.lit(latest)).withColumn("_stretch", F.explode(F.sequence(stretch(F.col("valid_from")), F.greatest(stretch(ends), stretch(F.col("valid_from"))))))
    wanted = times.where(F.col(time).isNotNull()).select(time, stretch(F.col(time)).alias("_stretch"))
    in_force = (F.col("valid_from") <= F.col(time)) & (open_end | (F.col(time) < F.col("valid_to")))
    return spread.join(wanted, "_stretch").where(in_force).drop("_stretch")


def asof_many(left: DataFrame, left_time: str, rights: Sequence[tuple[DataFrame, str, Sequence[str]]], by: Sequence[str] = (), every: str | None = "month") -> DataFrame:
    """``left`` with the values of the last row at or before its time of each of ``rights``: a table, its time, its values.

    A right table has one row per key and time; a row whose values are all
    null is passed over.  All sides are stacked and gone through once.  Time
    is dealt into slices of ``every`` (a unit of ``date_trunc``), so that a
    key, or no key at all, may have more rows than a task holds; None keeps a
    key's rows together, which is cheaper where keys are many and short.
    Left rows that share key and time stay in one task.  Null times have no
    values.
    """
    own = [c for c in left.columns if c not in by]
    stacked = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_o"), F.struct(*own).alias("_l"))
    names = [f"_r{i}" for i in range(len(rights))]
    for name, (right, time, values) in zip(names, rights):
        present = F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(True)) for v in values])
        rows = right.where(present).where(F.col(time).isNotNull())
        stacked = stacked.unionByName(rows.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_o"), F.struct(*values).alias(name)), allowMissingColumns=True)
    if by and every is None:
        w = Window.partitionBy(*by).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
        carried = stacked.select(*by, "_o", "_l", *[F.last(n, ignorenulls=True).over(w).alias(n) for n in names])
    else:
        stacked = stacked.withColumn("_slice", F.date_trunc(every or "month", "_t"))
        carried = last_before(stacked, by, "_slice", ["_t", "_o"], names)
    values = [F.col(f"{n}.{v}").alias(v) for n, (_, _, own_values) in zip(names, rights) for v in own_values]
    return carried.where("_o = 1").select(*by, *[F.col(f"_l.{c}").alias(c) for c in own], *values)


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], every: str | None = None) -> DataFrame:
    """``left`` with the values of the last ``right`` row at or before its time; as :func:`asof_many` with one table."""
    return asof_many(left, left_time, [(right, right_time, values)], by, every)


def release_date(observed: Column, series: Column, lags: Mapping[str, int], default: int = 1) -> Column:
    """When an observation could first be traded on: its date and the series' publication lag."""
    if not lags:
        return F.date_add(observed, F.lit(default))
    known = F.create_map(*[F.lit(x) for kv in lags.items() for x in kv])
    return F.date_add(observed, F.coalesce(F.element_at(known, series), F.lit(default)))


def vintages_of(raw: DataFrame, observed: str, value: str, realtime_start: str, series: Column, lags: Mapping[str, int]) -> DataFrame:
    """Revision rows of a feed in warehouse form: vintage, release date, and whether that is assumed."""
    start = F.col(realtime_start)
    return raw.select(
        F.col(observed).alias("date"), F.col(value).cast("decimal(18,6)").alias("close"), F.coalesce(F.date_format(start, "yyyy-MM-dd"), F.lit("initial")).alias("vintage"),
        F.coalesce(start, release_date(F.col(observed), series, lags)).alias("release_date"), start.isNull().alias("lag_assumed"),
    )
