"""Reads over a warehouse folder, one function per question; each returns a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitframe.functions import labels as fl
from pitframe.operators import graph, paper, regime, rules, stats
from pitframe.operators.asof import latest_vintage
from pitframe.operators.windows import Series
from pitframe.pipeline import HORIZONS, PRESETS, WEIGHTS, Tracker
from pitframe.sources import seeds, warehouse

#: Symbols of the snapshot's roles; a list is a chain of fallbacks.
ROLES = {"gold": ["GC=F", "GLD"], "spx": "SPX", "dollar": "DX-Y.NYB", "vix": "VIX", "nominal": "US10Y", "breakeven": "T10YIE", "real": "US10Y_REAL"}


class Desk:
    """A warehouse as of a date, which is always given, so reads can be repeated."""

    def __init__(self, spark: SparkSession, root: str, as_of: date, tracker: Tracker | None = None) -> None:
        self.spark, self.root, self.as_of, self.tracker = spark, root, as_of, tracker or Tracker()

    def table(self, name: str) -> DataFrame:
        return warehouse.scan(self.spark, self.root, name)

    def prices(self) -> DataFrame:
        got = latest_vintage(self.table("macro_daily"), ["date", "symbol"], ["release_date", "vintage"], ["close", "volume"], "release_date", self.as_of)
        return got.withColumns({"close": F.col("close").cast("double"), "volume": F.col("volume").cast("double")})

    def predictions(self, horizon: int | None = None) -> DataFrame:
        p = self.table("model_predictions").withColumnRenamed("prob_outperform_gold", "prob").where(F.col("date") <= F.lit(self.as_of))
        return p if horizon is None else p.where(F.col("horizon_days") == horizon)

    def health(self) -> DataFrame:
        return self.table("macro_daily").agg(F.count("*").alias("rows"), F.max("date").alias("latest"))

    def macro_snapshot(self) -> DataFrame:
        return rules.snapshot(self.prices(), ROLES)

    def knowledge_graph(self) -> tuple[DataFrame, DataFrame]:
        return seeds.graph_nodes(self.spark), graph.latest_edges(seeds.graph_edges(self.spark), "edge_id")

    def hypotheses(self, target: str) -> DataFrame:
        return graph.causes_of(seeds.graph_edges(self.spark), target)

    def transmission(self, start: str, end: str) -> DataFrame:
        return graph.simple_paths(seeds.graph_edges(self.spark), self.spark.createDataFrame([(start,)], "start string"), end)

    def regimes(self) -> DataFrame:
        return seeds.regime_hypotheses(self.spark)

    def current_regime(self) -> DataFrame:
        now = regime.current(self.table("market_regimes").where(F.col("date") <= F.lit(self.as_of)))
        return now.join(F.broadcast(self.regimes().select("regime_id", "gold_bias", "miner_bias")), "regime_id", "left")

    def regime_history(self, days: int) -> DataFrame:
        return warehouse.lookback(self.table("market_regimes"), days, self.as_of).orderBy("date")

    def macro_series(self, symbols: Sequence[str], days: int) -> DataFrame:
        return warehouse.lookback(self.prices().where(F.col("symbol").isin(*symbols)), days, self.as_of).orderBy("date", "symbol")

    def etf_flows(self, ticker: str | None = None, n: int = 60) -> DataFrame:
        f = self.table("etf_flows")
        return (f if ticker is None else f.where(F.col("ticker") == ticker)).orderBy(F.desc("date"), "ticker").limit(n)

    def central_banks(self, n: int = 100) -> DataFrame:
        return self.table("central_bank_purchases").orderBy(F.desc("month"), "country").limit(n)

    def names(self) -> DataFrame:
        return seeds.instruments(self.spark).where("scored").select(F.col("symbol").alias("entity"), F.col("name").alias("label"), "tier")

    def signals(self, horizon: int) -> DataFrame:
        return rules.signal_book(self.predictions(), self.names(), horizon)

    def model_catalog(self) -> DataFrame:
        live = self.predictions().where(fl.is_live("model_version")).groupBy("entity", "horizon_days").agg(F.max(F.struct("date", "id", "prob")).alias("m"))
        every = self.names().select("entity", "label", F.explode(F.array(*map(F.lit, HORIZONS))).alias("horizon_days"))
        got = every.join(live, ["entity", "horizon_days"], "left")
        return got.select("entity", "label", "horizon_days", fl.horizon_label("horizon_days").alias("horizon"), "m.date", "m.prob").orderBy("entity", "horizon_days")

    def universe(self) -> DataFrame:
        p = self.prices()
        ranked = p.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
        at = lambda k: F.max(F.when(F.col("rn") == k, F.col("close")))
        last = ranked.groupBy("symbol").agg(at(1).alias("last"), F.when(F.count("*") > 21, at(1) / at(21) - 1).alias("change_20"))
        scored = self.predictions().select(F.col("entity").alias("symbol"), F.lit(True).alias("_m")).distinct()
        got = seeds.instruments(self.spark).join(last, "symbol", "left").join(scored, "symbol", "left")
        return got.withColumn("modeled", F.col("_m").isNotNull()).drop("_m")

    def allocation(self, horizon: int = 10) -> DataFrame:
        """Gold against equities; where equities have no score, their trailing move of ``horizon`` rows stands in."""
        gold = self.predictions(horizon).where(fl.is_live("model_version") & (F.col("entity") == "GLD")).groupBy().agg(F.max_by("expected_return", F.struct("date", "id")).alias("gold_ret"))
        s = Series()
        spx = self.prices().where("symbol = 'SPX'").select("date", s.change(F.col("close"), horizon).alias("m")).groupBy().agg(F.max_by("m", "date").alias("equity_ret"))
        now = self.current_regime().groupBy().agg(F.max("gold_bias").alias("gold_bias"), F.max("regime_name").alias("regime_name"))
        one = self.macro_snapshot().groupBy().agg(F.max("as_of").alias("as_of"), F.max("real_yields").alias("real_yield"), F.max("dxy_trend_20d_pct").alias("dollar_trend"))
        row = one.join(F.broadcast(gold)).join(F.broadcast(spx)).join(F.broadcast(now))  # a row each
        return rules.allocation(row.withColumn("gold_bias", F.coalesce("gold_bias", F.lit("neutral"))), horizon)

    def strategies(self, horizon: int = 10) -> DataFrame:
        a = self.allocation(horizon).select(F.lit(0).alias("state_id"), "stance", "gold_bias", "yield_role", "dollar_role")
        picks = self.signals(horizon).where(F.col("signal").isin("long", "overweight")).groupBy().agg(F.least(F.count("*"), F.lit(8)).alias("_n"), F.coalesce(F.max((F.col("signal") == "long").cast("int")), F.lit(0)).alias("_l"))
        best = self.paper_stats().withColumn("s", F.round(F.col("total_return") - 0.5 * F.abs("max_drawdown"), 4)).groupBy().agg(F.max(F.struct("s", (-F.col("horizon_days")).alias("h"), "total_return", "rebalances")).alias("b"))
        row = a.join(F.broadcast(picks)).join(F.broadcast(best)).select(
            "state_id", "stance", "gold_bias", "yield_role", "dollar_role", F.greatest("_n", F.lit(1)).alias("n_sleeve"), (F.col("_n") > 0).alias("has_picks"), (F.col("_l") > 0).alias("has_long"),
            F.col("b.rebalances").alias("paper_rebalances"), F.col("b.s").alias("paper_score"), F.col("b.total_return").alias("paper_return"),
        )
        return rules.playbooks(row)

    def paper_stats(self) -> DataFrame:
        days = self.table("paper_orders").groupBy("horizon_days").agg(F.count_distinct("date").alias("rebalances"))
        return paper.nav_stats(self.table("paper_nav")).join(days, "horizon_days", "left").withColumn("rebalances", F.coalesce("rebalances", F.lit(0)))

    def paper(self) -> dict[str, DataFrame]:
        nav = self.table("paper_nav")
        return {"stats": self.paper_stats(), "curve": paper.curve(nav), "orders": paper.recent_orders(self.table("paper_orders")), "positions": self.table("paper_positions")}

    def history(self, days: int, horizon: int, entity: str | None = None) -> DataFrame:
        p = warehouse.lookback(self.predictions(horizon).where(fl.is_asof("model_version")), days, self.as_of)
        p = p if entity is None else p.where(F.col("entity") == entity)
        last = p.groupBy("date", "entity").agg(F.max(F.struct("id", "prob", "expected_return", "expected_alpha")).alias("m"))
        return last.select("date", "entity", "m.prob", "m.expected_return", "m.expected_alpha").orderBy("entity", "date")

    def portfolio_analytics(self) -> DataFrame:
        r = self.table("portfolio_recommendations").where(F.col("date") <= F.lit(self.as_of))
        last = r.withColumn("_d", F.max("date").over(Window.partitionBy(F.lit(0)))).where("date = _d").withColumn("book", F.lit("latest"))
        return stats.concentration(last, ["book"], "weight").join(last.groupBy("book").agg(F.sum(F.col("weight") * F.col("expected_alpha")).alias("expected_alpha"), F.count("*").alias("n")), "book")

    def dashboard(self) -> DataFrame:
        """The snapshot with risk tiles in one row."""
        g = self.table("geopolitical_risk").groupBy().agg(F.max_by("gpr_index", "date").alias("gpr_index"), F.max_by("oil_disruption", "date").alias("oil_disruption"))
        p = self.table("central_bank_purchases").orderBy(F.desc("month"), "country").limit(12).groupBy().agg(F.sum(F.coalesce("purchase_tonnes", F.lit(0).cast("decimal(12,4)"))).cast("double").alias("purchases"))
        f = self.table("etf_flows").groupBy().agg(F.max_by("weekly_flow", "date").cast("double").alias("etf_flow"))
        snap = self.macro_snapshot()
        return rules.risk_tiles(snap.join(F.broadcast(g)).join(F.broadcast(p)).join(F.broadcast(f)))  # a row each

    def explain(self) -> DataFrame:
        part = lambda name: self.table(name).agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n")
        out = part("macro_daily")
        for name in ("features_daily", "market_regimes", "model_predictions", "paper_nav"):
            out = out.unionByName(part(name))
        return out

    def pipeline_options(self) -> DataFrame:
        return self.spark.createDataFrame([(k, list(v["stages"]), sum(WEIGHTS[s] for s in v["stages"])) for k, v in PRESETS.items()], "preset string, stages array<string>, weight int")

    def pipeline_status(self) -> dict:
        return self.tracker.snapshot()
