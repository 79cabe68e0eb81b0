"""Risk indexes from market proxies."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far each component follows the index.
COMPONENT_SHARE = {
    "conflict_intensity": 0.9,
    "sanctions_score": 0.7,
    "military_escalation": 0.8,
    "shipping_disruption": 0.5,
    "trade_restrictions": 0.6,
    "election_uncertainty": 0.4,
}
NEUTRAL = 0.3


def _index(df: DataFrame) -> DataFrame:
    """Adds the index and its components to rows with ``z`` and ``vol``."""
    gpr = F.greatest(F.lit(0.0), F.least(F.lit(1.0), NEUTRAL + 0.15 * F.col("z") + 0.1 * F.col("vol")))
    out = df.withColumn("gpr_index", gpr)
    for name, share in COMPONENT_SHARE.items():
        out = out.withColumn(name, F.col("gpr_index") * share)
    return out.withColumn("oil_disruption", F.least(F.lit(1.0), F.col("vol") / 5))


def rolling_risk(panel: DataFrame, first: date, last: date, rows: int = 30) -> DataFrame:
    """The index of each calendar day from the trailing ``rows`` rows of ``panel``.

    ``panel`` has ``date``, ``fear`` and ``oil``.  The windows are computed on
    the panel's own rows and carried to calendar days; a day before the first
    row has no row in the result.  The volatility takes changes within the
    window only; where it has too few, it is 0.
    """
    one = Window.partitionBy("k").orderBy("date")
    w, inner = one.rowsBetween(1 - rows, 0), one.rowsBetween(2 - rows, 0)
    p = panel.withColumn("k", F.lit(0))
    p = p.withColumn("change", F.try_divide("oil", F.lag("oil").over(one)) - 1)
    sd = F.stddev_samp("fear").over(w)
    z = F.when(F.count("fear").over(w) > 1, (F.last("fear", ignorenulls=True).over(w) - F.avg("fear").over(w)) / (sd + 1e-6)).otherwise(F.lit(0.0))
    vol = F.coalesce(F.stddev_samp("change").over(inner) * 100, F.lit(0.0))
    daily = p.select("k", "date", z.alias("z"), vol.alias("vol"), F.lead("date").over(one).alias("next"))
    until = F.least(F.coalesce(F.date_sub("next", 1), F.lit(last)), F.lit(last))
    days = daily.withColumn("from", F.greatest("date", F.lit(first))).withColumn("until", until).where("from <= until")
    return _index(days.select(F.explode(F.sequence("from", "until")).alias("day"), "z", "vol"))


def risk_on(panel: DataFrame, day: date, back: int = 30) -> DataFrame:
    """The single-day index over a window of calendar days; without rows all parts are neutral."""
    rows = panel.where(F.col("date").between(F.date_sub(F.lit(day), back), F.lit(day))).withColumn("k", F.lit(0))
    w = Window.partitionBy("k").orderBy("date")
    rows = rows.withColumn("change", F.try_divide("oil", F.lag("oil").over(w)) - 1)
    got = rows.agg(
        F.count("*").alias("n"), F.max_by("fear", "date").alias("last"), F.avg("fear").alias("mean"), F.stddev_samp("fear").alias("sd"), F.stddev_samp("change").alias("sd_oil")
    ).select(F.lit(day).alias("day"), "n", F.coalesce((F.col("last") - F.col("mean")) / (F.col("sd") + 1e-6), F.lit(0.0)).alias("z"), F.coalesce(F.col("sd_oil") * 100, F.lit(0.0)).alias("vol"))
    names = ["gpr_index", *COMPONENT_SHARE, "oil_disruption"]
    return _index(got).select("day", *[F.when(F.col("n") == 0, F.lit(NEUTRAL)).otherwise(F.col(c)).alias(c) for c in names])
