"""Portfolio weights and risk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitframe.operators.stats import covariance
from pitframe.operators.windows import TINY, TRADING_DAYS, Series
from pitframe.sources.artifacts import stored

BLEND = (0.6, 0.4)


def return_matrix(prices: DataFrame, symbols: Sequence[str], rows: int = 252, at: str = "date", name: str = "symbol", value: str = "close") -> DataFrame:
    """One-row returns, long, of the last ``rows`` dates on which every symbol has one."""
    r = prices.where(F.col(name).isin(*symbols)).select(at, name, Series((name,), (at,)).change(F.col(value), 1).alias("ret")).where("ret is not null")
    whole = r.groupBy(at).agg(F.count("*").alias("_n")).where(F.col("_n") == len(symbols)).orderBy(F.desc(at)).limit(rows).select(at)
    return r.join(whole, at, "left_semi")


def inverse_volatility(returns: DataFrame, name: str = "symbol", ret: str = "ret") -> DataFrame:
    inverse = returns.groupBy(name).agg((1 / (F.stddev_samp(ret) + TINY)).alias("_i"))
    return inverse.select(name, (F.col("_i") / F.sum("_i").over(Window.partitionBy(F.lit(0)))).alias("weight"))


def kelly(stats: DataFrame, mu: str, vol: str) -> DataFrame:
    """Growth-optimal shares, none below zero; equal ones where none is above.

    A fraction of Kelly would cancel in the normalisation.
    """
    edge = F.greatest(F.col(mu) / (F.col(vol) * F.col(vol) + TINY), F.lit(0.0))
    every = Window.partitionBy(F.lit(0))
    k = stats.withColumn("_k", edge)
    total = F.sum("_k").over(every)
    return k.withColumn("weight", F.when(total > 0, F.col("_k") / total).otherwise(1.0 / F.count("*").over(every))).drop("_k")


def blend(weights: DataFrame, forecast: str, weight: str = "weight", name: str = "symbol", top: int = 10) -> DataFrame:
    """Risk weights tilted by the rank of the forecast, the largest kept, with sum 1."""
    every = Window.partitionBy(F.lit(0))
    ranked = weights.withColumn("_r", _share(forecast))
    mixed = ranked.withColumn("_m", BLEND[0] * F.col(weight) + BLEND[1] * F.col("_r") / F.sum("_r").over(every))
    mixed = mixed.withColumn("_m", F.col("_m") / F.sum("_m").over(every))
    best = mixed.withColumn("rank", F.row_number().over(every.orderBy(F.desc("_m"), name))).where(F.col("rank") <= top)
    return best.select(name, (F.col("_m") / F.sum("_m").over(every)).alias("weight"), "rank")


def _share(x: str) -> Column:
    every = Window.partitionBy(F.lit(0))
    ties = F.count("*").over(Window.partitionBy(x))
    return (F.rank().over(every.orderBy(x)) + (ties - 1) / 2.0) / F.count("*").over(every)


def portfolio_risk(returns: DataFrame, weights: DataFrame, at: str, name: str, ret: str, weight: str, mu: str) -> DataFrame:
    """Annual volatility and implied Sharpe ratio of a weighted book."""
    cov = covariance(returns, at, name, ret)
    w = F.broadcast(weights.select(F.col(name).alias("s"), F.col(weight).alias("w")))
    pairs = cov.join(w.withColumnsRenamed({"s": "a", "w": "wa"}), "a").join(w.withColumnsRenamed({"s": "b", "w": "wb"}), "b")
    var = pairs.agg(F.sum(F.col("wa") * F.col("wb") * F.col("cov")).alias("v"))
    gain = weights.agg((F.sum(F.col(weight) * F.col(mu)) * TRADING_DAYS).alias("g"))
    both = var.join(F.broadcast(gain))  # a row each
    vol = F.sqrt(F.greatest(F.col("v"), F.lit(0.0)) * TRADING_DAYS)
    return both.select(vol.alias("vol"), F.try_divide("g", vol).alias("sharpe"))


def _cluster_order(dist: np.ndarray) -> list[int]:
    """Leaves in the order of a single-linkage tree."""
    groups = [[i] for i in range(len(dist))]
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while len(groups) > 1:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        groups[i] = groups[i] + groups[j]
        d[i] = np.minimum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        del groups[j]
    return groups[0]


def hierarchical_parity(cov: np.ndarray) -> np.ndarray:
    """Risk parity by recursive bisection along the tree of correlation distances."""
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-16))
    corr = np.clip(cov / np.outer(sd, sd), -1, 1)
    weights = np.ones(len(cov))
    todo = [_cluster_order(np.sqrt((1 - corr) / 2))]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        halves = part[: len(part) // 2], part[len(part) // 2 :]
        risk = []
        for h in halves:
            sub = cov[np.ix_(h, h)]
            w = 1 / np.maximum(np.diag(sub), 1e-16)
            w /= w.sum()
            risk.append(w @ sub @ w)
        share = 1 - risk[0] / max(sum(risk), 1e-16)
        weights[halves[0]] *= share
        weights[halves[1]] *= 1 - share
        todo += halves
    return weights / weights.sum()


def spanning_forest(edges: DataFrame, parts: int = 32) -> DataFrame:
    """The least spanning forest of ``a, b, d`` (each pair once, ``a < b``): those of tasks' edges, then of groups of these, then of all.

    An edge that is not in the forest of some of the edges is not in that of
    all, so each step passes on fewer edges than there are names.  Equal
    distances go by names.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.select("a", "b", "d").schema)

    def least(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["d", "a", "b"], ignore_index=True)
        root: dict = {}

        def top(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        keep = []
        for a, b in zip(rows["a"], rows["b"]):
            x, y = top(a), top(b)
            keep.append(x != y)
            if x != y:
                root[y] = x
        return rows[keep]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = least(batch if held is None else pd.concat([held, batch]))
        if held is not None:
            yield held

    found = edges.select("a", "b", "d").mapInPandas(task, schema)
    grouped = found.groupBy(F.pmod(F.spark_partition_id(), F.lit(parts)).alias("_g"))
    return grouped.applyInPandas(least, schema).groupBy(F.lit(True).alias("_all")).applyInPandas(least, schema)


def leaf_order(tree: DataFrame) -> DataFrame:
    """``name, place``: the leaves of the single-linkage tree, from the edges of a spanning tree, which are one fewer than its names.

    Clusters are joined by growing distance; the one with the least name comes first.
    """
    kind = tree.schema["a"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        groups = {n: [n] for n in [*rows["a"], *rows["b"]]}
        for r in rows.sort_values(["d", "a", "b"]).itertuples():
            x, y = sorted((groups[r.a], groups[r.b]), key=lambda g: g[0])
            both = x + y
            for n in both:
                groups[n] = both
        order = next(iter(groups.values())) if groups else []
        return pd.DataFrame({"name": order, "place": range(len(order))})

    return tree.groupBy(F.lit(True).alias("_all")).applyInPandas(run, f"name {kind}, place int")


def hierarchical_weights(returns: DataFrame, name: str = "symbol", ret: str = "ret", at: str = "date") -> DataFrame:
    """``name, weight, place``: hierarchical risk parity of one book whose names have a return on the same times.

    Covariances, distances and the risk of every half of every split are
    tables of pairs; the single-linkage order comes from their spanning tree.
    No task or driver holds a matrix of all names: the largest group is the
    tree's edges, one per name.  A book of one name has all weight; one of
    none has no rows.
    """
    cov = stored(covariance(returns, at, name, ret).withColumn("cov", F.coalesce("cov", F.lit(0.0))), "covariances")
    var = cov.where("a = b").select(F.col("a").alias("name"), F.greatest("cov", F.lit(1e-16)).alias("var"))
    side = lambda c: var.select(F.col("name").alias(c), F.col("var").alias(f"v{c}"))
    pairs = cov.select("a", "b", "cov").join(side("a"), "a").join(side("b"), "b")
    corr = F.least(F.greatest(F.col("cov") / F.sqrt(F.col("va") * F.col("vb")), F.lit(-1.0)), F.lit(1.0))
    order = leaf_order(spanning_forest(pairs.where("a < b").select("a", "b", F.sqrt((1 - corr) / 2).alias("d"))))
    placed = var.join(order, "name", "left").withColumn("place", F.coalesce("place", F.lit(0)))
    n = placed.agg(F.count("*").alias("n")).first()["n"]
    if not n:
        return placed.select("name", F.lit(1.0).alias("weight"), "place").withColumnRenamed("name", name)
    at_level = _halves(placed, n)
    inverse = at_level.select("name", "half", (1 / F.col("var")).alias("i"))
    total = inverse.groupBy("half").agg(F.sum("i").alias("t"))
    left, right = (inverse.select(F.col("name").alias(c), "half", F.col("i").alias(f"i{c}")) for c in "ab")
    inside = pairs.select("a", "b", "cov").join(left, "a").join(right, ["b", "half"])
    risk = inside.groupBy("half").agg(F.sum(F.col("ia") * F.col("ib") * F.col("cov")).alias("r")).join(total, "half").select("half", (F.col("r") / F.col("t") / F.col("t")).alias("risk"))
    # A half's share is what its twin has of the risk of both.
    twin = risk.select(F.struct(F.col("half.level").alias("level"), F.col("half.whole").alias("whole"), (1 - F.col("half.side")).alias("side")).alias("half"), F.col("risk").alias("other"))
    both = risk.join(twin, "half")
    share = F.when(F.col("half.side") == 0, 1 - F.col("risk") / F.greatest(F.col("risk") + F.col("other"), F.lit(1e-16))).otherwise(F.col("other") / F.greatest(F.col("risk") + F.col("other"), F.lit(1e-16)))
    shares = at_level.join(both.select("half", share.alias("share")), "half").groupBy("name").agg(F.collect_list("share").alias("s"))
    raw = placed.join(shares, "name", "left").select("name", "place", F.aggregate(F.coalesce("s", F.array().cast("array<double>")), F.lit(1.0), lambda w, x: w * x).alias("w"))
    whole = raw.agg(F.sum("w").alias("t")).scalar()
    return raw.select(F.col("name").alias(name), (F.col("w") / whole).alias("weight"), "place")


def _halves(placed: DataFrame, n: int) -> DataFrame:
    """``name, var, half``: the splits of the order that a name takes part in, a row for each: level, the first place of what is split, which half (0 or 1)."""
    kind = placed.schema["name"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, var, place in zip(batch["name"], batch["var"], batch["place"]):
                lo, hi, level = 0, n, 0
                while hi - lo > 1:
                    mid = lo + (hi - lo) // 2
                    side = int(place >= mid)
                    out.append((name, var, level, lo, side))
                    lo, hi, level = (mid, hi, level + 1) if side else (lo, mid, level + 1)
            yield pd.DataFrame(out, columns=["name", "var", "level", "whole", "side"])

    rows = placed.select("name", "var", "place").mapInPandas(run, f"name {kind}, var double, level int, whole int, side int")
    return rows.select("name", "var", F.struct("level", "whole", "side").alias("half"))


def mean_variance(cov: np.ndarray, mu: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Long-only weights with sum 1 that maximise mu.w - w.C.w / 2, by projected gradient."""
    n = len(mu)
    w = np.full(n, 1 / n)
    step = 1 / max(np.linalg.eigvalsh(cov).max(), 1e-9)
    for _ in range(rounds):
        v = w + step * (mu - cov @ w)
        u = np.sort(v)[::-1]
        tops = (np.cumsum(u) - 1) / np.arange(1, n + 1)
        w = np.maximum(v - tops[np.flatnonzero(u > tops)[-1]], 0)
    return w / w.sum()


def solved(returns: DataFrame, method: str, by: str | None = None, name: str = "symbol", ret: str = "ret", at: str = "date") -> DataFrame:
    """Weights by ``hrp`` or ``mean_variance`` for each book ``by``; a task per book, books being small.

    The matrix of a book is its symbols by the rows kept for it, so a group
    is bounded by the lookback and not by the data.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        m = part.pivot_table(index=at, columns=name, values=ret).dropna()
        if len(m) < 3 or m.shape[1] < 2:
            w = np.full(m.shape[1], 1 / max(1, m.shape[1]))
        else:
            cov = np.cov(m.to_numpy(), rowvar=False)
            w = hierarchical_parity(cov) if method == "hrp" else mean_variance(cov * TRADING_DAYS, m.mean().to_numpy() * TRADING_DAYS)
        return pd.DataFrame({"book": str(part[by].iloc[0]) if by else "all", name: m.columns.astype(str), "weight": w})

    rows = returns.select(*([by] if by else []), at, name, ret)
    return rows.groupBy(by if by else F.lit(0).alias("_all")).applyInPandas(run, f"book string, {name} string, weight double")
