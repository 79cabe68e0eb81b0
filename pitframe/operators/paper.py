"""Paper books: an account per horizon that trades stored as-of scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitframe.functions.labels import finite, is_asof, signal, stance
from pitframe.operators.asof import asof_many
from pitframe.operators.windows import Series

STARTING_CASH = 100_000.0
COST_BPS = 10.0
LEAST_TRADE = 1.0
SLEEVE = 8
#: Share of the book that each stance gives to gold.
GOLD_BUDGET = {"add": 0.60, "keep": 0.30, "reduce": 0.10}


def market_scores(predictions: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """As-of scores, the last id per date, horizon and entity; a missing or zero probability is 0.5."""
    p = predictions.where(is_asof("model_version") & F.col("horizon_days").isin(*horizons))
    last = p.groupBy("date", "horizon_days", "entity").agg(F.max(F.struct("id", "prob", "expected_alpha", "expected_return")).alias("m"))
    prob = finite(F.col("m.prob"))
    return last.select(
        "date", "horizon_days", "entity", F.when(prob.isNull() | (prob == 0), 0.5).otherwise(prob).alias("prob"), finite(F.col("m.expected_alpha"), 0.0).alias("alpha"), finite(F.col("m.expected_return")).alias("ret")
    )


def sleeves(scores: DataFrame, prices: DataFrame, excluded: Sequence[str], fallback: Sequence[str], top: int = SLEEVE) -> DataFrame:
    """Equal weights of the best long and overweight names of each day and horizon.

    Names need a price at or before the day.  A day whose scores choose nobody
    holds the first of ``fallback`` that has a price.
    """
    first = prices.where("close is not null").groupBy("symbol").agg(F.min("date").alias("_first"))
    priced = scores.join(first.withColumnRenamed("symbol", "entity"), "entity").where(F.col("date") >= F.col("_first"))
    good = priced.where(~F.col("entity").isin(*excluded) & signal("prob", "alpha").isin("long", "overweight"))
    w = Window.partitionBy("date", "horizon_days")
    chosen = good.withColumn("_k", F.row_number().over(w.orderBy(F.desc("alpha"), F.desc("entity")))).where(F.col("_k") <= top)
    chosen = chosen.select("date", "horizon_days", F.col("entity").alias("symbol"), (1.0 / F.count("*").over(w)).alias("weight"))
    order = F.create_map(*[F.lit(x) for i, s in enumerate(fallback) for x in (s, i)])
    spare = F.broadcast(first.where(F.col("symbol").isin(*fallback)).withColumn("_o", F.element_at(order, F.col("symbol"))))
    empty = scores.select("date", "horizon_days").distinct().join(chosen, ["date", "horizon_days"], "left_anti")
    parked = empty.join(spare, F.col("date") >= F.col("_first")).groupBy("date", "horizon_days").agg(F.min(F.struct("_o", "symbol")).alias("m"))
    return chosen.unionByName(parked.select("date", "horizon_days", F.col("m.symbol").alias("symbol"), F.lit(1.0).alias("weight")))


def contexts(scores: DataFrame, prices: DataFrame, regimes: DataFrame, gold: str, bench: str, real: str, dollar: str) -> DataFrame:
    """Stance and gold budget of each day and horizon with a score.

    ``regimes`` has ``date`` and ``gold_bias``.  Trailing moves count each
    symbol's own rows and are carried to the day.
    """
    days = scores.groupBy("date", "horizon_days").agg(F.max(F.when(F.col("entity") == gold, F.col("ret"))).alias("gold_ret"))
    s = Series()
    p = prices.where("close is not null")
    lengths = [r["horizon_days"] for r in scores.select("horizon_days").distinct().collect()]  # a handful
    moves = F.create_map(*[x for h in lengths for x in (F.lit(h), s.change(F.col("close"), h))]) if lengths else F.lit(None).cast("map<int,double>")

    def of(symbol: str, x: Column, name: str) -> tuple[DataFrame, str, list[str]]:
        return p.where(F.col("symbol") == symbol).select(F.col("date").alias("_d"), x.alias(name)), "_d", [name]

    rights = [of(real, F.col("close"), "real_yield"), of(dollar, s.change(F.col("close"), 20) * 100, "dollar_20"), of(bench, moves, "_moves"), (regimes, "date", ["gold_bias"])]
    out = asof_many(days, "date", rights).withColumn("bench_trail", F.element_at("_moves", F.col("horizon_days"))).drop("_moves")
    out = out.withColumn("gold_bias", F.coalesce("gold_bias", F.lit("neutral")))
    call = stance(F.col("gold_ret"), F.col("bench_trail"), F.col("real_yield"), F.col("dollar_20"), F.col("gold_bias"))
    budgets = F.create_map(*[F.lit(x) for kv in GOLD_BUDGET.items() for x in kv])
    return out.withColumn("stance", call).withColumn("gold_budget", F.element_at(budgets, F.col("stance")))


def rebalance(shares: dict[str, float], cash: float, price: dict[str, float], targets: dict[str, float], cost_bps: float = COST_BPS) -> tuple[float, list[tuple]]:
    """Trades towards target dollars: sales first, then purchases as far as cash goes; names in alphabetical order.

    Changes ``shares``; returns the cash left and orders of (symbol, side,
    shares, price, dollars, fee).
    """
    rate = cost_bps / 10_000
    orders = []
    names = sorted(s for s in shares.keys() | targets.keys() if price.get(s, 0) > 0)
    for s in names:
        excess = shares.get(s, 0.0) * price[s] - targets.get(s, 0.0)
        sold = min(shares.get(s, 0.0), excess / price[s])
        if excess >= LEAST_TRADE and sold > 0:
            dollars = sold * price[s]
            shares[s] -= sold
            cash += dollars * (1 - rate)
            orders.append((s, "sell", sold, price[s], dollars, dollars * rate))
    for s in names:
        wanted = targets.get(s, 0.0) - shares.get(s, 0.0) * price[s]
        dollars = min(wanted, cash / (1 + rate))
        if wanted >= LEAST_TRADE and dollars >= LEAST_TRADE:
            shares[s] = shares.get(s, 0.0) + dollars / price[s]
            cash -= dollars * (1 + rate)
            orders.append((s, "buy", dollars / price[s], price[s], dollars, dollars * rate))
    return cash, orders


@dataclass
class Account:
    """One book from day to day: cash, shares, and how many days ago it last traded."""

    horizon: int
    bench: str
    cash: float = STARTING_CASH
    cost_bps: float = COST_BPS
    shares: dict[str, float] = field(default_factory=dict)
    since: int | None = None
    stance: str = "keep"
    budget: float = GOLD_BUDGET["keep"]

    @property
    def begun(self) -> bool:
        return self.since is not None

    def worth(self, price: dict[str, float]) -> float:
        return self.cash + sum(n * price[s] for s, n in self.shares.items() if price.get(s) is not None)

    def day(self, price: dict[str, float], sleeve: dict[str, float] | None, stance: str | None, budget: float | None) -> list[tuple]:
        """The day's orders: a book trades on its first day with a sleeve, and then on such days a horizon or more after it last did."""
        if self.begun:
            self.since += 1
        if sleeve is None or self.begun and self.since < self.horizon:
            return []
        worth = self.worth(price)
        self.stance, self.budget, self.since = stance, budget, 0
        targets = {s: worth * budget * w for s, w in sleeve.items()}
        targets[self.bench] = targets.get(self.bench, 0.0) + worth * (1 - budget)
        self.cash, orders = rebalance(self.shares, self.cash, price, targets, self.cost_bps)
        return orders


_EVENT = "horizon_days int, seq int, date date, kind string, symbol string, side string, shares double, price double, dollars double, fee double, nav double, cash double, stance string, gold_budget double, benchmark_gold double, benchmark_spx double"


def simulate(days: DataFrame, bench: str, starting_cash: float = STARTING_CASH, cost_bps: float = COST_BPS) -> DataFrame:
    """The books day by day, one task per horizon, since cash depends on every trade before.

    ``days`` has a row per horizon and trading day: ``horizon_days, date,
    gold, spx``, ``prices`` (map of the closes in force), ``stance``,
    ``gold_budget`` and ``sleeve`` (map of weights; null on days without a
    score).  A book is as long as its calendar.  Returns order rows and a net
    value row per day; :func:`orders`, :func:`navs` and :func:`holdings` take
    them apart.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date", ignore_index=True)
        h = int(part["horizon_days"].iloc[0])
        account, seq, out = Account(h, bench, starting_cash, cost_bps), 0, []
        start_gold = start_spx = gold = spx = None
        for row in part.itertuples(index=False):
            price, sleeve = dict(row.prices) if row.prices is not None else {}, None if row.sleeve is None else dict(row.sleeve)
            if not account.begun and sleeve is None:
                continue
            if not account.begun:
                start_gold, start_spx = row.gold, row.spx
            for o in account.day(price, sleeve, row.stance, row.gold_budget):
                seq += 1
                out.append((h, seq, row.date, "order", *o, None, None, None, None, None, None))
            gold = row.gold if pd.notna(row.gold) else gold
            spx = row.spx if pd.notna(row.spx) else spx
            nav = account.worth(price)
            out.append((h, None, row.date, "nav", None, None, None, None, None, None, nav, account.cash, account.stance, account.budget, starting_cash * gold / start_gold, starting_cash * spx / start_spx))
        for s, n in sorted(account.shares.items()):
            if n > 1e-8:
                out.append((h, None, part["date"].iloc[-1], "position", s, None, n, None, None, None, None, None, None, None, None, None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _EVENT.split(", ")])

    return days.groupBy("horizon_days").applyInPandas(run, _EVENT)


def orders(events: DataFrame) -> DataFrame:
    return events.where("kind = 'order'").select("horizon_days", "seq", "date", "symbol", "side", "shares", "price", "dollars", "fee", F.lit("rebalance").alias("reason"))


def navs(events: DataFrame) -> DataFrame:
    return events.where("kind = 'nav'").select("horizon_days", "date", "nav", "cash", "stance", "gold_budget", "benchmark_gold", "benchmark_spx")


def holdings(events: DataFrame) -> DataFrame:
    return events.where("kind = 'position'").select("horizon_days", "symbol", "shares")


def trading_days(prices: DataFrame, scores: DataFrame, sleeve: DataFrame, context: DataFrame, horizons: Sequence[int], gold: Sequence[str], bench: str) -> DataFrame:
    """The input of :func:`simulate`: for each horizon the days on which gold's market and the benchmark both closed.

    Closes in force are carried forward per symbol and packed into a map, so
    the simulation needs no lookups.
    """
    p = prices.where("close is not null").select("date", "symbol", "close")
    calendar = p.where(F.col("symbol").isin(gold[-1], bench)).groupBy("date").agg(F.count_distinct("symbol").alias("_n")).where("_n = 2").select("date")
    symbols = sleeve.select("symbol").union(p.where(F.col("symbol").isin(*gold, bench)).select("symbol")).distinct()
    # A close is in force until the day before the symbol's next one; the last, until the calendar ends.
    following = F.lead("date").over(Window.partitionBy("symbol").orderBy("date"))
    last = calendar.agg(F.max("date").alias("m")).scalar()
    spans = p.join(symbols, "symbol", "left_semi").withColumn("_to", F.coalesce(F.date_sub(following, 1), F.greatest(last, F.col("date"))))
    in_force = spans.select("symbol", "close", F.explode(F.sequence("date", "_to")).alias("date"))
    carried = in_force.join(calendar, "date")
    maps = carried.groupBy("date").agg(
        F.map_from_entries(F.collect_list(F.struct("symbol", "close"))).alias("prices"), F.max(F.when(F.col("symbol") == bench, F.col("close"))).alias("spx"),
        *[F.max(F.when(F.col("symbol") == g, F.col("close"))).alias(f"_g{i}") for i, g in enumerate(gold)],
    )
    maps = maps.withColumn("gold", F.coalesce(*[F.col(f"_g{i}") for i in range(len(gold))])).drop(*[f"_g{i}" for i in range(len(gold))])
    weights = sleeve.groupBy("date", "horizon_days").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "weight"))).alias("sleeve"))
    each = maps.withColumn("horizon_days", F.explode(F.array(*[F.lit(h).cast("int") for h in horizons])))
    return each.join(weights, ["date", "horizon_days"], "left").join(context.select("date", "horizon_days", "stance", "gold_budget"), ["date", "horizon_days"], "left")


def marked(cash: DataFrame, positions: DataFrame, prices: DataFrame) -> DataFrame:
    """``horizon_days, date, nav``: the cash of each book and day with its shares at the closes in force.

    ``cash`` has ``horizon_days, date, cash``, ``positions`` ``horizon_days,
    date, symbol, shares``.  A symbol without a close so far counts nothing.
    """
    closes = prices.where("close is not null").select("symbol", F.col("date").alias("_t"), "close")
    held = asof_many(positions.select("horizon_days", "date", "symbol", "shares"), "date", [(closes, "_t", ["close"])], ["symbol"])
    worth = held.groupBy("horizon_days", "date").agg(F.sum(F.col("shares") * F.col("close")).alias("_w"))
    return cash.join(worth, ["horizon_days", "date"], "left").select("horizon_days", "date", (F.col("cash") + F.coalesce("_w", F.lit(0.0))).alias("nav"))


def nav_stats(nav: DataFrame, starting_cash: float = STARTING_CASH) -> DataFrame:
    s = Series(("horizon_days",))
    last = lambda c: F.max_by(c, "date")
    ret = lambda c: F.round(last(c) / starting_cash - 1, 4)
    return nav.withColumn("_dd", F.col("nav") / s.peak(F.col("nav")) - 1).groupBy("horizon_days").agg(
        F.max("date").alias("as_of"), F.round(last("nav"), 2).alias("nav"), ret("nav").alias("total_return"), F.round(F.least(F.min("_dd"), F.lit(0.0)), 4).alias("max_drawdown"),
        F.round(last("benchmark_gold"), 2).alias("benchmark_gold"), ret("benchmark_gold").alias("benchmark_gold_return"), F.round(last("benchmark_spx"), 2).alias("benchmark_spx"),
        ret("benchmark_spx").alias("benchmark_spx_return"), last("stance").alias("stance"),
    )


def missing_books(horizons: DataFrame, accounts: DataFrame, force: bool = False) -> DataFrame:
    return horizons if force else horizons.join(accounts.select("horizon_days"), "horizon_days", "left_anti")


def curve(nav: DataFrame, points: int = 180) -> DataFrame:
    """About ``points`` evenly spaced rows of each book, with the last."""
    w = Window.partitionBy("horizon_days").orderBy("date")
    n = F.count("*").over(Window.partitionBy("horizon_days"))
    step = F.greatest(F.lit(1), F.floor(n / points))
    rn = F.row_number().over(w)
    return nav.withColumn("_t", ((rn - 1) % step == 0) | (rn == n)).where("_t").drop("_t")


def recent_orders(orders: DataFrame, n: int = 40) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("horizon_days").orderBy(F.desc("date"), F.desc("seq")))
    return orders.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")
