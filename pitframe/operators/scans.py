"""Running totals and last values over an order that no single task holds.

Rows are dealt into slices of the order.  Within a slice a window does the
work; what comes before a slice is one total, or one last value, per slice,
so that only these few are gone through one after another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of an order, and rows drawn for each to place the cuts between them.
SLICES = 64
DRAWN = 20


def cut_points(df: DataFrame, order: Sequence[str], slices: int = SLICES, drawn: int = DRAWN) -> list[tuple]:
    """Values of ``order`` that part the rows about evenly, from a sample of ``slices * drawn`` rows.

    Cuts decide who does the work and not what comes out.  Equal rows fall
    into one slice; aggregate repeated ones first.
    """
    sample = df.select(*order).orderBy(F.rand(7)).limit(slices * drawn).orderBy(*[F.col(c).asc_nulls_first() for c in order]).collect()
    return sorted({tuple(sample[i]) for i in range(drawn, len(sample), drawn)}, key=lambda t: tuple((x is not None, x) for x in t))


def slice_of(df: DataFrame, order: Sequence[str], points: Sequence[tuple]) -> Column:
    """The number of ``points`` at or below a row, found by halving.  Nulls are below all."""
    kinds = [df.schema[c].dataType for c in order]

    def reached(point: tuple) -> Column:
        """Whether the row is at or above the point, column by column."""
        out = F.lit(True)
        for c, x, kind in reversed(list(zip(order, point, kinds))):
            if x is None:
                out = F.col(c).isNotNull() | out
            else:
                here = F.lit(x).cast(kind)
                out = F.coalesce((F.col(c) > here) | ((F.col(c) == here) & out), F.lit(False))
        return out

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(reached(points[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(points))


def sums_before(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, str], slices: int = SLICES, slice_: Column | None = None) -> DataFrame:
    """``df`` with, for each ``new: column`` of ``sums``, the column's total over the rows before this one in its group.

    ``by`` and ``order`` together name a row.  Slices are placed by a sample,
    which costs a pass over ``df``, unless ``slice_`` gives a number for each
    row that never falls as ``order`` rises.  Totals per slice are summed in a
    window by group, ``slices`` rows a group at most; without ``by`` they are
    one array.  An empty table gives none; null summands count as nothing.
    """
    dealt = df.withColumn("_slice", slice_of(df, order, cut_points(df, order, slices)) if slice_ is None else slice_.cast("int"))
    within = Window.partitionBy(*by, "_slice").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(new) for new, c in sums.items()])
    totals = dealt.groupBy(*by, "_slice").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_t_{new}") for new, c in sums.items()])
    if by:
        ahead = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, "_slice")], *[F.coalesce(F.sum(f"_t_{new}").over(ahead), F.lit(0)).alias(f"_t_{new}") for new in sums])
        got = local.join(offsets, _same_keys((*by, "_slice")))
        return got.select(*df.columns, *[(F.col(new) + F.col(f"_t_{new}")).alias(new) for new in sums])
    one = totals.agg(F.collect_list(F.struct("_slice", *[f"_t_{new}" for new in sums])).alias("a")).scalar()
    out = local.withColumn("_totals", one)
    for new in sums:
        nothing = F.lit(0).cast(totals.schema[f"_t_{new}"].dataType)
        before = F.aggregate("_totals", nothing, lambda t, e: F.when(e["_slice"] < F.col("_slice"), t + e[f"_t_{new}"]).otherwise(t))  # noqa: B023
        out = out.withColumn(new, F.col(new) + F.coalesce(before, nothing))
    return out.drop("_slice", "_totals")


def _same_keys(names: Sequence[str]) -> Column:
    """Null-safe equality of each name with its ``_k_`` twin."""
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return same


def rank_shares(df: DataFrame, x: str, share: str, slices: int = SLICES) -> DataFrame:
    """``df`` with the average rank of ``x`` over the number of rows that have one, ties sharing their mean.

    Values are counted first, so a value that a third of all rows share is one
    row of the scan.  A null has no rank and does not count.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    before = sums_before(values, (), ["_x"], {"_below": "_c"}, slices)
    n = values.agg(F.sum("_c")).scalar()
    ranks = before.select("_x", ((F.col("_below") + (F.col("_c") + 1) / 2.0) / n).alias(share))
    return df.join(ranks, F.col(x) == F.col("_x"), "left").drop("_x")


def row_ranks(df: DataFrame, order: Sequence[str], rank: str, slices: int = SLICES) -> DataFrame:
    """``df`` with each row's place, from 1, among all rows in ascending ``order``, which names a row; nulls come first."""
    got = sums_before(df.withColumn("_one", F.lit(1).cast("long")), (), order, {rank: "_one"}, slices)
    return got.withColumn(rank, F.col(rank) + 1).drop("_one")


def last_before(stacked: DataFrame, by: Sequence[str], slice_: str, order: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """``stacked`` with each of ``carried`` replaced by its last value that is not null, here or earlier in the group.

    ``slice_`` must not fall as ``order`` rises; equal places of the order
    must not have two values.  Where a slice has none yet, the last of the
    slices before it is taken: an array of one value per slice without ``by``,
    a window over such rows with it.
    """
    within = Window.partitionBy(*by, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = stacked.select(*[c for c in stacked.columns if c not in carried], *[F.last(c, ignorenulls=True).over(within).alias(c) for c in carried])
    ends = stacked.groupBy(*by, slice_).agg(*[F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in carried])
    if by:
        ahead = Window.partitionBy(*by).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
        seeds = ends.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, slice_)], *[F.last(c, ignorenulls=True).over(ahead)["v"].alias(f"_s_{c}") for c in carried])
        got = local.join(seeds, _same_keys((*by, slice_)), "left")
        return got.select(*[F.coalesce(c, f"_s_{c}").alias(c) if c in carried else F.col(c) for c in stacked.columns])
    one = ends.select(F.col(slice_).alias("_s"), *carried).agg(F.collect_list(F.struct("_s", *carried)).alias("a")).scalar()
    out = local.withColumn("_ends", one)
    for c in carried:
        earlier = F.filter("_ends", lambda e: (e["_s"] < F.col(slice_)) & e[c].isNotNull())  # noqa: B023
        latest = F.array_max(F.transform(earlier, lambda e: e["_s"]))
        out = out.withColumn(c, F.coalesce(c, F.get(F.filter("_ends", lambda e: e["_s"] == latest), F.lit(0))[c]["v"]))  # noqa: B023
    return out.select(*stacked.columns)
