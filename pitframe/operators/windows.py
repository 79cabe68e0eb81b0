"""Windows over the rows of a series: every length counts rows, not days.

``Series`` names the key and order columns once; all its windows share one
partitioning, so any number of features costs one shuffle.  A series has a row
per date at most, so its length is bounded by the calendar.  Values must hold
NULL and not NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252
TINY = 1e-8


class Series:
    def __init__(self, by: Sequence[str] = ("symbol",), order: Sequence[str] = ("date",)) -> None:
        self.by, self.order = tuple(by), tuple(order)

    @property
    def base(self):
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def last_rows(self, n: int):
        return self.base.rowsBetween(1 - n, 0)

    def full(self, agg: Column, x: Column, n: int, least: int | None = None) -> Column:
        """``agg`` over the last n rows, null unless ``least`` (n) of them hold x."""
        w = self.last_rows(n)
        return F.when(F.count(x).over(w) >= F.lit(n if least is None else least), agg.over(w))

    def change(self, x: Column, n: int) -> Column:
        """x over its value n rows back, less 1; null where that is null or 0."""
        return F.try_divide(x, F.lag(x, n).over(self.base)) - 1

    def filled_change(self, x: Column, n: int) -> Column:
        """As :meth:`change`, with gaps carried forward first.  ``x`` must be a plain column."""
        carried = F.last(x, ignorenulls=True).over(self.base.rowsBetween(Window.unboundedPreceding, 0))
        before = F.last(x, ignorenulls=True).over(self.base.rowsBetween(Window.unboundedPreceding, -n))
        return F.try_divide(carried, before) - 1

    def diff(self, x: Column, n: int) -> Column:
        return x - F.lag(x, n).over(self.base)

    def forward(self, x: Column, n: int) -> Column:
        """Return over the next n rows."""
        return F.try_divide(F.lead(x, n).over(self.base), x) - 1

    def volatility(self, ret: Column, n: int) -> Column:
        return self.full(F.stddev_samp(ret), ret, n) * F.sqrt(F.lit(float(TRADING_DAYS)))

    def from_mean(self, x: Column, n: int = 200, least: int = 100) -> Column:
        return F.try_divide(x, self.full(F.avg(x), x, n, least)) - 1

    def zscore(self, x: Column, n: int = 60) -> Column:
        return (x - self.full(F.avg(x), x, n)) / (self.full(F.stddev_samp(x), x, n) + TINY)

    def beta(self, r: Column, bench: Column, n: int = 60) -> Column:
        both = F.when(r.isNotNull() & bench.isNotNull(), F.lit(1))
        w = self.last_rows(n)
        # Without covar_samp over windows of nulls: pairs with a gap count for neither side.
        rr, bb = F.when(both == 1, r), F.when(both == 1, bench)
        return F.when(F.count(both).over(w) >= n, F.covar_samp(rr, bb).over(w) / (F.var_samp(bb).over(w) + TINY))

    def wealth(self, r: Column) -> Column:
        """Running product of 1 + r."""
        return F.exp(F.sum(F.log1p(r)).over(self.base.rowsBetween(Window.unboundedPreceding, 0)))

    def peak(self, x: Column) -> Column:
        return F.max(x).over(self.base.rowsBetween(Window.unboundedPreceding, 0))

    def every(self, k: int) -> Column:
        """Each k-th row and the last."""
        n = F.count(F.lit(1)).over(self.base.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rn = F.row_number().over(self.base)
        return ((rn - 1) % k == 0) | (rn == n)

    def turnover_cost(self, position: Column, cost: float) -> Column:
        """The cost where a position differs from the one before; the first is free."""
        before = F.lag(position, 1).over(self.base)
        return F.when(before.isNotNull() & (position != before), F.lit(cost)).otherwise(F.lit(0.0))


#: What an oscillator carries from row to row, in a slice as well as in a series.
_AVERAGES = ("fast", "slow", "up", "down", "range")


def oscillators(df: DataFrame, by: Sequence[str], order: str, x: str, n: int = 14, fast: int = 12, slow: int = 26, signal: int = 9, every: str = "year") -> DataFrame:
    """Wilder RSI / 100, mean true range over price, and MACD histogram over price.

    Exponential averages have no window form, but a stretch of a series maps
    the averages before it to those after it by ``a * before + b``, whatever
    came before.  So a series is dealt into slices of ``every`` (a unit of
    ``date_trunc``), each slice is folded into its map, the maps of a series,
    a row per slice, are put together, and each slice is folded again from
    its true start.  A task holds a slice, and one row per slice of a series.

    The first ``n`` rows have no RSI or range, the first ``slow + signal - 2``
    no MACD.  True range is the absolute change, since only closes exist;
    averages start at their first value.  Null values are left out; ``by`` and
    ``order`` name a row.
    """
    wilder, af, as_, ag = 1.0 / n, 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)
    rate = {"fast": af, "slow": as_, "up": wilder, "down": wilder, "range": wilder}
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(order).alias("_t"), F.col(x).cast("double").alias("_x"), F.date_trunc(every, F.col(order)).alias("_slice"))
    slices = rows.groupBy(*by, "_slice").agg(F.array_sort(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_x").alias("x")))).alias("rows"))
    ends = slices.select(*by, "_slice", F.size("rows").alias("_n"), F.element_at("rows", -1)["x"].alias("_end"))
    ahead = Window.partitionBy(*by).orderBy("_slice")
    ends = ends.select(*_twins(by), F.coalesce(F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_k"), F.lag("_end").over(ahead).alias("_before"))
    numbered = slices.join(ends, _same(by)).select(*by, "_slice", "rows", "_k", "_before")

    # Each row as what the folds take in: its place in the series, its value, and its change.
    place = F.sequence(F.lit(0), F.size("rows") - 1)
    value = lambda i: F.get("rows", i)["x"]
    inputs = F.transform(place, lambda i: F.struct((F.col("_k") + i).alias("k"), value(i).alias("x"), (value(i) - F.when(i == 0, F.col("_before")).otherwise(value(i - 1))).alias("d")))
    numbered = numbered.withColumn("_in", inputs)

    def taken(r: Column) -> dict[str, Column]:
        return {"fast": r["x"], "slow": r["x"], "up": F.greatest(r["d"], F.lit(0.0)), "down": F.greatest(-r["d"], F.lit(0.0)), "range": F.abs(r["d"])}

    #: The row at which an average starts.
    start = {"fast": 0, "slow": 0, "up": 1, "down": 1, "range": 1}
    zero = F.lit(0.0)

    def mapped(m: Column, r: Column) -> Column:
        """The maps ``a * before + b`` after one more row; the signal's takes in fast and slow as well."""
        a, b = {}, {}
        for c, v in taken(r).items():
            a[c] = F.when(r["k"] <= start[c], zero).otherwise(m[f"a_{c}"] * (1 - rate[c]))
            b[c] = F.when(r["k"] < start[c], zero).when(r["k"] == start[c], v).otherwise(m[f"b_{c}"] * (1 - rate[c]) + v * rate[c])
        keep, add = F.when(r["k"] <= slow - 1, zero).otherwise(F.lit(1 - ag)), F.when(r["k"] < slow - 1, zero).when(r["k"] == slow - 1, F.lit(1.0)).otherwise(F.lit(ag))
        line = {"p": m["p"] * keep, "q": m["q"] * keep + a["fast"] * add, "r": m["r"] * keep - a["slow"] * add, "s": m["s"] * keep + (b["fast"] - b["slow"]) * add}
        return F.struct(*[a[c].alias(f"a_{c}") for c in _AVERAGES], *[b[c].alias(f"b_{c}") for c in _AVERAGES], *[v.alias(c) for c, v in line.items()])

    same_map = F.struct(*[F.lit(1.0).alias(f"a_{c}") for c in _AVERAGES], *[zero.alias(f"b_{c}") for c in _AVERAGES], F.lit(1.0).alias("p"), zero.alias("q"), zero.alias("r"), zero.alias("s"))
    maps = numbered.select(*by, "_slice", F.aggregate("_in", same_map, mapped).alias("m"))

    def onward(states: Column, e: Column) -> Column:
        z, m = F.element_at(states, -1)["z"], e["m"]
        after = [(m[f"a_{c}"] * z[c] + m[f"b_{c}"]).alias(c) for c in _AVERAGES]
        line = (m["p"] * z["line"] + m["q"] * z["fast"] + m["r"] * z["slow"] + m["s"]).alias("line")
        return F.concat(states, F.array(F.struct(e["_slice"].alias("s"), F.struct(*after, line).alias("z"))))

    nothing = F.struct(*[zero.alias(c) for c in (*_AVERAGES, "line")])
    series = maps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_slice", "m"))).alias("e"))
    states = F.aggregate("e", F.array(F.struct(F.get("e", F.lit(0))["_slice"].alias("s"), nothing.alias("z"))), onward)
    starts = series.withColumn("_s", states).select(*by, F.explode(F.arrays_zip(F.col("e._slice").alias("_slice"), F.slice(F.col("_s.z"), F.lit(1), F.size("e")).alias("z"))).alias("_e"))
    starts = starts.select(*_twins(by, {"_slice": F.col("_e._slice")}), F.col("_e.z").alias("_z"))

    def stepped(out: Column, r: Column) -> Column:
        z = F.when(F.size(out) == 0, F.col("_z")).otherwise(F.element_at(out, -1)["z"])
        v = taken(r)
        now = {c: F.when(r["k"] < start[c], zero).when(r["k"] == start[c], v[c]).otherwise(z[c] * (1 - rate[c]) + v[c] * rate[c]) for c in _AVERAGES}
        macd = now["fast"] - now["slow"]
        line = F.when(r["k"] < slow - 1, zero).when(r["k"] == slow - 1, macd).otherwise(z["line"] * (1 - ag) + macd * ag)
        return F.concat(out, F.array(F.struct(r["k"].alias("k"), F.struct(*[now[c].alias(c) for c in _AVERAGES], line.alias("line")).alias("z"))))

    state = "struct<" + ",".join(f"{c}:double" for c in (*_AVERAGES, "line")) + ">"
    full = numbered.join(starts, _same(by)).withColumn("_out", F.aggregate("_in", F.array().cast(f"array<struct<k:bigint,z:{state}>>"), stepped))
    flat = full.select(*by, F.explode(F.arrays_zip("rows", "_out")).alias("e")).select(*by, F.col("e.rows.t").alias(order), F.col("e.rows.x").alias(x), F.col("e._out.k").alias("k"), F.col("e._out.z").alias("z"))
    price, down = F.col(x), F.col("z.down")
    return flat.select(
        *by, order, x,
        F.when(F.col("k") >= n, F.when(down == 0, F.lit(1.0)).otherwise(1 - F.try_divide(F.lit(1.0), 1 + F.try_divide(F.col("z.up"), down)))).alias("rsi"),
        F.when(F.col("k") >= n, F.try_divide(F.col("z.range"), price)).alias("atr"),
        F.when(F.col("k") >= slow + signal - 2, F.try_divide(F.col("z.fast") - F.col("z.slow") - F.col("z.line"), price)).alias("macd_diff"),
    )


def _twins(by: Sequence[str], more: dict[str, Column] | None = None) -> list[Column]:
    """The keys of a slice under names of their own, for :func:`_same`."""
    return [*[F.col(c).alias(f"_k_{c}") for c in by], (more or {}).get("_slice", F.col("_slice")).alias("_k__slice")]


def _same(by: Sequence[str]) -> Column:
    same = F.col("_slice") == F.col("_k__slice")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return same
