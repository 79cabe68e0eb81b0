"""The feature store: what each series, each pair of markets and each miner is described by, point in time.

Prices come in as known at a date, so every feature is as of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitframe.operators.windows import Series, oscillators

#: Rows of each return, and the least closes of a series that has oscillators.
RETURNS = (5, 10, 20, 63, 126)
LEAST_CLOSES = 30
PRICE_FEATURES = (*[f"ret_{n}d" for n in RETURNS], "vol_20d", "vol_63d", "dist_200dma", "momentum_60d", "zscore_60d", "atr_14", "rsi_14", "macd")


def price_features(prices: DataFrame, by: str = "symbol", at: str = "date", x: str = "close") -> DataFrame:
    """``by, at`` and the thirteen of :data:`PRICE_FEATURES`: ten in one pass of windows, three by the folds of oscillators.

    A series with ``LEAST_CLOSES`` closes or fewer has no oscillators.
    """
    s, c = Series((by,), (at,)), F.col(x)
    rows = prices.select(by, at, c.cast("double").alias(x)).withColumn("_ret", s.change(c, 1))
    whole = F.count(c).over(Window.partitionBy(by))
    made = rows.select(
        by, at, *[s.change(c, n).alias(f"ret_{n}d") for n in RETURNS], s.volatility(F.col("_ret"), 20).alias("vol_20d"), s.volatility(F.col("_ret"), 63).alias("vol_63d"),
        s.from_mean(c).alias("dist_200dma"), s.change(c, 60).alias("momentum_60d"), s.zscore(c).alias("zscore_60d"), whole.alias("_n"),
    )
    swings = oscillators(rows.select(by, at, x), [by], at, x).select(F.col(by).alias("_by"), F.col(at).alias("_at"), "atr", "rsi", "macd_diff")
    both = made.join(swings, (F.col(by) == F.col("_by")) & (F.col(at) == F.col("_at")), "left")
    enough = lambda c: F.when(F.col("_n") > LEAST_CLOSES, F.col(c))
    return both.select(*[c for c in made.columns if c != "_n"], enough("atr").alias("atr_14"), enough("rsi").alias("rsi_14"), enough("macd_diff").alias("macd"))


def market_features(prices: DataFrame, roles: Mapping[str, str], by: str = "symbol", at: str = "date", x: str = "close") -> DataFrame:
    """``at`` and the ratios, rates and levels of the market: of the roles gold, oil, copper, spx, real, dollar, vix and breakeven, those that name a symbol.

    Without gold there are none.  One row per date, so one calendar.
    """
    names = sorted(set(roles.values()))
    wide = prices.where(F.col(by).isin(*names)).groupBy(at).pivot(by, names).agg(F.max(F.col(x).cast("double"))).withColumn("_k", F.lit(0))
    c = {r: F.col(f"`{n}`") for r, n in roles.items()}
    if "gold" not in c:
        return wide.select(at).limit(0)
    pairs = [r for r in ("oil", "copper", "spx") if r in c]
    wide = wide.withColumns({f"gold_{r}_ratio": F.try_divide(c["gold"], c[r]) for r in pairs})
    s, made = Series(("_k",), (at,)), {}
    for r in pairs:
        ratio = F.col(f"gold_{r}_ratio")
        made |= {f"gold_{r}_ratio": ratio, f"gold_{r}_ratio_zscore": s.zscore(ratio)}
    if "real" in c:
        made |= {"real_yield": c["real"], "real_yield_trend_20d": s.diff(c["real"], 20), "real_yield_zscore": s.zscore(c["real"])}
    if "dollar" in c:
        made |= {"dxy_trend_20d": s.change(c["dollar"], 20), "dxy_zscore": s.zscore(c["dollar"])}
    if "vix" in c:
        made |= {"vix_level": c["vix"], "vix_zscore": s.zscore(c["vix"])}
    if "breakeven" in c:
        made |= {"breakeven_inflation": c["breakeven"], "inflation_trend_20d": s.diff(c["breakeven"], 20)}
    return wide.select(at, *[v.alias(k) for k, v in made.items()])


def miner_features(prices: DataFrame, miners: Sequence[str], gold: str, quarterly: DataFrame | None = None, by: str = "symbol", at: str = "date", x: str = "close") -> DataFrame:
    """``by, at, beta_to_gold_60d`` and, on a miner's last date, what its last quarter surprised with.

    ``quarterly`` has ``ticker, quarter_end, production_oz, aisc_per_oz,
    analyst_eps_revision``; a miner of one quarter has no surprise; lower
    costs count as good.
    """
    s, c = Series((by,), (at,)), F.col(x).cast("double")
    ret = prices.where(F.col(by).isin(*miners, gold)).select(by, at, s.change(c, 1).alias("_r"))
    bench = ret.where(F.col(by) == gold).select(at, F.col("_r").alias("_g"))
    out = ret.where(F.col(by).isin(*miners)).join(bench, at, "left").select(by, at, s.beta(F.col("_r"), F.col("_g")).alias("beta_to_gold_60d"))
    if quarterly is None:
        return out
    q = Series(("ticker",), ("quarter_end",))
    filled = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    each = quarterly.select("ticker", "quarter_end", filled("production_oz").alias("p"), filled("aisc_per_oz").alias("a"), filled("analyst_eps_revision").alias("m"))
    told = each.select("ticker", "quarter_end", q.change(F.col("p"), 1).alias("prod_surprise"), (-q.change(F.col("a"), 1)).alias("aisc_surprise"), F.col("m").alias("revision_momentum"))
    last = told.groupBy("ticker").agg(F.count("*").alias("n"), *[F.max_by(c, "quarter_end").alias(c) for c in ("prod_surprise", "aisc_surprise", "revision_momentum")]).where("n > 1").drop("n")
    end = out.groupBy(F.col(by).alias("ticker")).agg(F.max(at).alias("_end"))
    final = last.join(end, "ticker")
    got = out.join(final, (F.col(by) == F.col("ticker")) & (F.col(at) == F.col("_end")), "left")
    return got.select(by, at, "beta_to_gold_60d", "prod_surprise", "aisc_surprise", "revision_momentum")


def store(prices: DataFrame, roles: Mapping[str, str], miners: Sequence[str] = (), quarterly: DataFrame | None = None, by: str = "symbol", at: str = "date", x: str = "close", market: str = "MACRO") -> DataFrame:
    """All features as rows ``entity, at, feature_name, feature_value``; values that are null or not finite are left out."""

    def rows(wide: DataFrame, entity: Column) -> DataFrame:
        names = [c for c in wide.columns if c not in (by, at)]
        long = wide.select(entity.alias("entity"), at, *names).unpivot(["entity", at], names, "feature_name", "feature_value")
        return long.where("feature_value is not null and not isnan(feature_value)").where(F.abs("feature_value") < F.lit(float("inf")))

    out = rows(price_features(prices, by, at, x), F.col(by))
    if "gold" in roles:
        out = out.unionByName(rows(market_features(prices, roles, by, at, x), F.lit(market)))
        if miners:
            out = out.unionByName(rows(miner_features(prices, miners, roles["gold"], quarterly, by, at, x), F.col(by)))
    return out
