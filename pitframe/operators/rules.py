"""Rule-based reads: snapshot, allocation, signal book, playbooks, agents, tiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitframe.functions import labels as fl
from pitframe.operators.paper import GOLD_BUDGET


def _met(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def snapshot(prices: DataFrame, roles: Mapping[str, str | Sequence[str]], days: int = 30) -> DataFrame:
    """One row: the latest close of each role, trends over calendar days, labels.

    A role may list symbols; the first with a close counts.  One pass over
    the latest rows per symbol replaces a query for each.  The real yield is
    the stored one, else nominal less breakeven, else nominal less 2.25.
    Breakevens above 8 are void.  Trends run over ``days`` days to the last
    date of the panel.
    """
    chains = {r: [s] if isinstance(s, str) else list(s) for r, s in roles.items()}
    symbols = sorted({s for c in chains.values() for s in c})
    p = prices.where(F.col("symbol").isin(*symbols) & F.col("close").isNotNull())
    last = p.groupBy("symbol").agg(F.max("date").alias("d"), F.max_by("close", "date").alias("c"), F.array_sort(F.collect_list(F.struct("date", "close"))).alias("s"))
    last = last.withColumn("end", F.max("d").over(Window.partitionBy(F.lit(0))))
    recent = F.filter("s", lambda r: r["date"] >= F.date_sub(F.col("end"), days))
    last = last.select("symbol", "c", "end", F.when(F.size(recent) > 1, F.try_divide(F.element_at(recent, -1)["close"], F.element_at(recent, 1)["close"]) - 1).alias("t"))
    wide = last.agg(F.max("end").alias("as_of"), *[F.max(F.when(F.col("symbol") == s, F.col("c"))).alias(f"c_{i}") for i, s in enumerate(symbols)], *[F.max(F.when(F.col("symbol") == s, F.col("t"))).alias(f"t_{i}") for i, s in enumerate(symbols)])
    at = {s: i for i, s in enumerate(symbols)}
    close = lambda r: F.coalesce(*[F.col(f"c_{at[s]}") for s in chains[r]]) if r in chains else F.lit(None).cast("double")
    trend = lambda r: F.coalesce(*[F.col(f"t_{at[s]}") for s in chains[r]]) if r in chains else F.lit(None).cast("double")
    raw = close("breakeven")
    real = F.coalesce(close("real"), close("nominal") - raw, close("nominal") - 2.25)
    source = F.when(close("real").isNotNull(), "tips").when((close("nominal") - raw).isNotNull(), "breakeven_spread").when(close("nominal").isNotNull(), "estimated").otherwise("unavailable")
    breakeven = F.when(raw <= 8, raw)
    return wide.select(
        "as_of", close("gold").alias("gold_price"), close("spx").alias("spx"), close("dollar").alias("dxy"), close("vix").alias("vix"), close("nominal").alias("nominal_10y"), breakeven.alias("breakeven_10y"),
        real.alias("real_yields"), source.alias("real_yield_source"), F.round(trend("dollar") * 100, 2).alias("dxy_trend_20d_pct"), F.round(trend("gold") * 100, 2).alias("gold_trend_20d_pct"),
        fl.fed_bias(real).alias("fed_probability"), fl.dollar_strength(trend("dollar")).alias("dollar_strength"), fl.inflation_label(breakeven).alias("inflation"),
    )


def allocation(inputs: DataFrame, horizon: int = 10) -> DataFrame:
    """Stance, roles and reasons from ``gold_ret, equity_ret, real_yield, dollar_trend, gold_bias, regime_name``.

    A comparison with a missing number is not met.  Reasons that do not apply
    are left out of the list.
    """
    spread, y, d = F.col("gold_ret") - F.col("equity_ret"), F.col("real_yield"), F.col("dollar_trend")
    head_y, help_y = _met(y > 2.0), _met(y < 1.0)
    head_d, help_d = _met(d > 1.0), _met(d < -1.0)
    call = (
        F.when(_met(spread > 0) & ~head_y & ~head_d & (_met(F.col("gold_bias") == "bullish") | help_d), "add")
        .when(_met(spread < 0) & (head_y | head_d), "reduce").otherwise("keep")
    )
    points = F.array(
        F.when(F.col("gold_ret").isNull(), F.lit("No gold return forecast is stored yet.")),
        F.when(spread > 0, F.format_string(f"Gold is forecast to beat stocks over {horizon} rows by %.1f points.", spread * 100)).when(
            spread <= 0, F.format_string(f"Stocks are forecast to beat gold over {horizon} rows by %.1f points.", F.abs(spread) * 100)
        ),
        F.when(head_y, F.format_string("Real yields of %.2f%% weigh on gold.", y)).when(help_y, F.format_string("Real yields of %.2f%% favour gold.", y)).when(
            y.isNotNull(), F.format_string("Real yields of %.2f%% decide nothing.", y)
        ),
        F.when(head_d, F.format_string("The dollar rose %.1f%%, against gold.", d)).when(help_d, F.format_string("The dollar fell %.1f%%, in favour of gold.", F.abs(d))),
        F.when(F.col("regime_name").isNotNull(), F.concat(F.lit("The regime is "), "regime_name", F.lit("; its bias on gold is "), "gold_bias", F.lit("."))),
    )
    role = lambda a, b: F.when(a, "headwind").when(b, "support").otherwise("neutral")
    return inputs.withColumns({
        "spread": spread, "stance": call, "yield_role": role(head_y, help_y), "dollar_role": role(head_d, help_d), "reasons": F.filter(points, lambda s: s.isNotNull()),
    })


def signal_book(predictions: DataFrame, names: DataFrame, horizon: int) -> DataFrame:
    """The latest live score of each known name with its call, best alpha first."""
    live = predictions.where(fl.is_live("model_version") & (F.col("horizon_days") == horizon))
    last = live.groupBy("entity").agg(F.max(F.struct("date", "id", "prob", "expected_return", "expected_alpha")).alias("m"))
    got = last.join(F.broadcast(names), "entity").select("entity", "label", "tier", "m.date", "m.prob", "m.expected_return", "m.expected_alpha")
    return got.withColumn("signal", fl.signal("prob", "expected_alpha")).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("expected_alpha"), "entity")))


def confidence(base: Column, bias: Column, stance: Column, names: Column, paper: Column) -> Column:
    """A base raised by agreement of regime and stance, breadth and paper record, within bounds."""
    agree = ((bias == "bullish") & (stance == "add")) | ((bias == "bearish") & (stance == "reduce"))
    clash = ((bias == "bullish") & (stance == "reduce")) | ((bias == "bearish") & (stance == "add"))
    part = lambda c, x: F.when(_met(c), x).otherwise(0.0)
    total = base + part(agree, 0.12) - part(clash, 0.08) + part(names >= 4, 0.05) + part(paper, 0.08)
    return F.round(F.least(F.greatest(total, F.lit(0.15)), F.lit(0.92)), 2)


def playbooks(state: DataFrame) -> DataFrame:
    """Playbooks of each state with confidence and score, best first and the best at 100.

    ``state`` has ``state_id, stance, gold_bias, n_sleeve, has_picks,
    paper_rebalances, paper_score, paper_return, yield_role, dollar_role``.
    ``n_sleeve`` counts the names held, the fallback among them; a null
    ``paper_rebalances`` means no paper book.  The defensive playbook exists
    only under a reduce stance or a headwind.
    """
    stance, bias, n, picks = F.col("stance"), F.col("gold_bias"), F.col("n_sleeve"), F.col("has_picks")
    record = _met(F.col("paper_rebalances") >= 2)
    book = F.col("paper_rebalances").isNotNull()
    tag_stance = F.when(stance == "add", "constructive").when(stance == "reduce", "defensive").otherwise("neutral")
    budget = F.element_at(F.create_map(*[F.lit(x) for kv in GOLD_BUDGET.items() for x in kv]), stance)
    conf = lambda base, s, k, p: confidence(base, bias, s, k, p)
    one = lambda name, tag, c, g, score, keep: F.struct(
        F.lit(name).alias("id"), tag.alias("tag"), c.alias("confidence"), g.alias("gold_budget"), score.cast("double").alias("score"), keep.alias("keep")
    )
    yes = F.lit(True)
    defensive = (stance == "reduce") | _met(F.col("yield_role") == "headwind") | _met(F.col("dollar_role") == "headwind")
    rows = F.array(
        one("gold_budget", tag_stance, conf(F.lit(0.55), stance, n, record), budget, 70 + F.when(stance == "add", 15).when(stance == "reduce", -10).otherwise(0), yes),
        one("miner_sleeve", F.when(_met(F.col("has_long")), "constructive").otherwise("neutral"), conf(F.when(picks, 0.5).otherwise(0.35), stance, F.when(picks, n).otherwise(0), record), budget, 60 + F.least(n, F.lit(8)) * 3, yes),
        one(
            "horizon_pick", F.when(~book, "neutral").when(F.coalesce("paper_return", F.lit(0.0)) >= 0, "constructive").otherwise("defensive"),
            F.when(book, conf(F.lit(0.48), stance, n, yes)).otherwise(0.3), budget, F.when(book, 55 + (100 * F.coalesce("paper_score", F.lit(0.0))).cast("int")).otherwise(25), yes,
        ),
        one(
            "regime_overlay", F.when(bias == "bullish", "constructive").when(bias == "bearish", "defensive").otherwise("neutral"), conf(F.lit(0.42), stance, n, record), budget,
            45 + F.when(bias == "bullish", 10).when(bias == "bearish", 5).otherwise(0), yes,
        ),
        one("defensive", F.lit("defensive"), conf(F.lit(0.58), F.lit("reduce"), n, record), F.lit(GOLD_BUDGET["reduce"]), F.when(stance == "reduce", 65).otherwise(50), defensive),
    )
    kept = state.select("state_id", F.explode(F.filter(rows, lambda r: r["keep"])).alias("p")).select("state_id", "p.*").drop("keep")
    w = Window.partitionBy("state_id")
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(("gold_budget", "miner_sleeve", "horizon_pick", "regime_overlay", "defensive")) for x in (k, i)]), F.col("id"))
    ranked = kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), order)))
    return ranked.withColumn("score", F.round(100 * F.col("score") / F.max("score").over(w), 1))


def macro_agent(df: DataFrame) -> DataFrame:
    """Score of ``real_yield, dxy_trend, inflation_trend``, missing ones being neutral."""
    y, d, i = F.coalesce("real_yield", F.lit(2.0)), F.coalesce("dxy_trend", F.lit(0.0)), F.coalesce("inflation_trend", F.lit(0.0))
    score = 0.5 + F.when(y < 1.5, 0.15).when(y > 2.5, -0.15).otherwise(0.0) + F.when(d < -0.02, 0.1).when(d > 0.02, -0.1).otherwise(0.0) + F.when(i > 0.1, 0.05).otherwise(0.0)
    return df.withColumn("macro_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def geopolitical_agent(df: DataFrame) -> DataFrame:
    g, o, c = fl.finite("gpr_index", 0.3), fl.finite("oil_disruption", 0.2), fl.finite("conflict_intensity", 0.2)
    cap = lambda x: F.least(F.lit(1.0), x)
    return df.withColumns({"conflict_score": cap(c * 1.2), "energy_risk": cap(o * 1.5), "gold_bullishness": cap(0.3 + g * 0.5 + c * 0.2)})


def mining_agent(df: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = 0.5 + z("prod_surprise") * 0.2 - z("aisc_trend") * 0.15 + z("eps_revision") * 0.3
    return df.withColumn("fundamental", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def quant_agent(df: DataFrame) -> DataFrame:
    s = F.least(F.lit(1.0), F.coalesce("mean_auc", F.lit(0.5)))
    return df.withColumns({"signal_stability": s, "model_confidence": s * 0.9})


def risk_tiles(df: DataFrame) -> DataFrame:
    """Tiles of a dashboard from ``gpr_index, oil_disruption, purchases, etf_flow``."""
    level = lambda c, on, off: F.when(_met(c), on).otherwise(off)
    return df.withColumns({
        "geopolitical": level(F.col("gpr_index") > 0.5, "elevated", "normal"), "energy": level(F.col("oil_disruption") > 0.4, "elevated", "normal"),
        "official_demand": level(F.col("purchases") > 30, "strong", "soft"), "fund_flows": level(F.col("etf_flow") < 0, "outflow", "inflow"),
    })
