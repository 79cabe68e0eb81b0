"""The daily load: landed feeds into the warehouse's tables, step by step."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitframe.operators.risk import COMPONENT_SHARE, rolling_risk
from pitframe.operators.windows import Series
from pitframe.sources import seeds
from pitframe.sources.feeds import estimated_flows, keep_last
from pitframe.sources.warehouse import SCHEMAS, UPDATES, conform, insert_absent, scan, upsert

#: ``report(current, total, message)``.
Report = Callable[..., None]


@dataclass(frozen=True)
class Landed:
    """What feeds have landed; None where one has not.

    ``macro`` has ``date, symbol, close, release_date, vintage, lag_assumed``
    and may have the other columns of ``macro_daily``; ``bars`` daily bars
    with ``symbol``; ``shares`` a symbol's shares outstanding; ``purchases``
    ``month, country, purchase_tonnes``; ``quarterly`` the columns of
    ``miner_quarterly``.
    """

    macro: DataFrame | None = None
    bars: DataFrame | None = None
    shares: DataFrame | None = None
    purchases: DataFrame | None = None
    quarterly: DataFrame | None = None


def flow_table(bars: DataFrame, shares: DataFrame | None) -> DataFrame:
    """``etf_flows`` of funds from their bars: daily flows, their sum over 5 rows and their means over 30 and 60."""
    s, x = Series(("ticker",)), F.col("daily_flow")
    return estimated_flows(bars, shares).select(
        "date", "ticker", "aum", "daily_flow", s.full(F.sum(x), x, 5, 1).alias("weekly_flow"), s.full(F.avg(x), x, 30, 5).alias("flow_30d"), s.full(F.avg(x), x, 60, 10).alias("flow_60d")
    )


def purchase_table(purchases: DataFrame) -> DataFrame:
    """``central_bank_purchases`` with the sum of the last 12 rows of each country and its growth over 12 rows."""
    s, x = Series(("country",), ("month",)), F.col("purchase_tonnes").cast("double")
    return purchases.select("month", "country", "purchase_tonnes", s.full(F.sum(x), x, 12, 1).alias("rolling_12m_tonnes"), (s.change(x, 12) * 100).alias("yoy_growth_pct"))


def risk_table(macro: DataFrame, fear: str, oil: str, first: date, last: date) -> DataFrame:
    """``geopolitical_risk`` of each day from the latest vintages of the two symbols."""
    latest = keep_last(macro.where(F.col("symbol").isin(fear, oil)).where("close is not null"), "release_date", ("date", "symbol"))
    close = lambda s: F.max(F.when(F.col("symbol") == s, F.col("close").cast("double")))
    got = rolling_risk(latest.groupBy("date").agg(close(fear).alias("fear"), close(oil).alias("oil")), first, last)
    return got.select(F.col("day").alias("date"), "gpr_index", *COMPONENT_SHARE, "oil_disruption", F.lit("market proxies").alias("source"))


def daily(spark: SparkSession, root: str, landed: Landed, first: date, last: date, funds: Sequence[str] = ("GLD", "IAU"), fear: str = "VIX", oil: str = "CL=F", report: Report | None = None) -> dict[str, int]:
    """Brings the tables under ``root``, which :func:`create` has made, up to what has landed; rows written by table.

    Loading twice changes nothing: rows are known by their tables' keys.  Each
    table is read, merged, written beside itself, and then put in place.
    """
    total, done = 5, 0
    counts: dict[str, int] = {}

    def step(name: str, rows: DataFrame | None, update: Sequence[str] | None = None, only_new: bool = False) -> None:
        nonlocal done
        if rows is not None:
            keys = SCHEMAS[name][1]
            new = keep_last(conform(rows, name), next(c for c in conform(rows, name).columns if c not in keys), keys)
            old = scan(spark, root, name)
            kept = insert_absent(old, new, keys) if only_new else upsert(old, new, keys, update or UPDATES[name])
            kept.write.mode("overwrite").parquet(f"{root}/_next/{name}")
            scan(spark, f"{root}/_next", name).write.mode("overwrite").parquet(f"{root}/{name}")
            counts[name] = scan(spark, root, name).count()
        done += 1
        if report:
            report(done, total, f"{name}: {counts.get(name, 'not landed')}")

    values = [c for c in ("open", "high", "low", "close", "volume", "source", "release_date", "lag_assumed")]
    step("macro_daily", landed.macro, values)
    step("etf_flows", None if landed.bars is None else flow_table(landed.bars.where(F.col("symbol").isin(*funds)), landed.shares))
    step("central_bank_purchases", None if landed.purchases is None else purchase_table(landed.purchases))
    step("geopolitical_risk", None if landed.macro is None else risk_table(scan(spark, root, "macro_daily"), fear, oil, first, last), ["gpr_index", *COMPONENT_SHARE, "oil_disruption", "source"])
    total_before = done
    step("miner_companies", seeds.companies(spark), only_new=True)
    done = total_before
    step("miner_quarterly", landed.quarterly if landed.quarterly is not None else seeds.quarterly(spark))
    return counts


def etl_stage(spark: SparkSession, root: str, landed: Landed, first: date, last: date, **more) -> Callable:
    """:func:`daily` as the stage ``etl`` of a run."""
    return lambda run, report: daily(spark, root, landed, first, last, report=report, **more)
