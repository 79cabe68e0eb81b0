"""Market regimes: features, a hidden Markov model per market, rule labels."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitframe.operators.windows import Series
from pitframe.sources.artifacts import stored

LEAST_ROWS = 100
#: The least variance of a state, and the gain in likelihood below which fitting ends.
LEAST_VAR, CLOSE = 1e-3, 1e-4
#: Markets that go through a round's steps together.
TOGETHER = 32
#: Regime ids of the rules' names.
CRISIS, TIGHTENING, RECESSION, EASING = 3, 1, 4, 2


def features(prices: DataFrame, roles: Mapping[str, str], market: str = "market") -> DataFrame:
    """Regime features by date, for the roles whose symbols are named.

    ``roles`` maps breakeven, real, dollar, vix, oil, gold, spx and miners to
    symbols.  Levels, 20-row differences of rates, 20-row changes of prices
    with gaps carried forward.  Rows without any feature are left out.
    """
    names = sorted(set(roles.values()))
    wide = prices.where(F.col("symbol").isin(*names)).groupBy("date").pivot("symbol", names).agg(F.max("close")).withColumn("_k", F.lit(0))
    s = Series(("_k",))
    c = {r: F.col(f"`{x}`") for r, x in roles.items()}
    made = {}
    if "breakeven" in c:
        made |= {"inflation_level": c["breakeven"], "inflation_trend": s.diff(c["breakeven"], 20)}
    if "real" in c:
        made |= {"real_yield": c["real"], "real_yield_trend": s.diff(c["real"], 20)}
    if "dollar" in c:
        made["dxy_trend"] = s.filled_change(c["dollar"], 20)
    if "vix" in c:
        made["vix"] = c["vix"]
    for role in ("oil", "gold", "spx"):
        if role in c:
            made[f"{role}_trend"] = s.filled_change(c[role], 20)
    if "miners" in c and "gold" in c:
        made["miner_gold_spread"] = s.filled_change(c["miners"], 20) - s.filled_change(c["gold"], 20)
    out = wide.select("date", *[x.cast("double").alias(k) for k, x in made.items()])
    return out.na.drop("all", subset=list(made)).withColumn(market, F.lit("all"))


@dataclass
class Hidden:
    """Gaussian hidden Markov models with diagonal covariances, one for each start: axes are starts, states, features."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    @classmethod
    def begun(cls, x: np.ndarray, states: int, starts: int, seed: int) -> Hidden:
        """Models whose means are clustered from as many random rows."""
        means, spread = [], []
        for i in range(starts):
            rng = np.random.default_rng(seed + i)
            m = x[rng.choice(len(x), states, replace=len(x) < states)]
            for _ in range(20):
                home = ((x[:, None, :] - m[None]) ** 2).sum(2).argmin(1)
                m = np.array([x[home == k].mean(0) if (home == k).any() else m[k] for k in range(states)])
            means.append(m)
            spread.append([x[home == k].var(0) + 1e-2 if (home == k).sum() > 1 else np.ones(x.shape[1]) for k in range(states)])
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * 0.9
        return cls(np.full((starts, states), 1 / states), np.repeat((move / move.sum(1, keepdims=True))[None], starts, 0), np.array(means), np.maximum(np.array(spread), LEAST_VAR))

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Log densities: rows, starts, states."""
        diff = (x[:, None, None, :] - self.mean[None]) ** 2 / self.var[None]
        return -0.5 * (diff.sum(3) + np.log(2 * np.pi * self.var).sum(2)[None])

    def forward_backward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors (rows, starts, states), expected moves (starts, states, states) and log likelihoods of one sequence."""
        log = self.emissions(x)
        top = log.max(2, keepdims=True)
        b = np.exp(log - top)
        alpha, beta, scale = np.empty_like(b), np.ones_like(b), np.empty(b.shape[:2])
        a = self.start * b[0]
        for t in range(len(x)):
            if t:
                a = (alpha[t - 1][:, None, :] @ self.move)[:, 0, :] * b[t]
            scale[t] = np.maximum(a.sum(1), 1e-300)
            alpha[t] = a / scale[t][:, None]
        for t in range(len(x) - 2, -1, -1):
            beta[t] = (self.move @ (b[t + 1] * beta[t + 1])[:, :, None])[:, :, 0] / scale[t + 1][:, None]
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        moves = np.einsum("tsi,tsj->sij", alpha[:-1] / scale[1:, :, None], b[1:] * beta[1:]) * self.move
        return post, moves, np.log(scale).sum(0) + top[:, :, 0].sum(0)

    def statistics(self, x: np.ndarray) -> np.ndarray:
        """What one sequence adds to the next model, as one row of numbers: likelihoods, starts, moves, weights, sums, squares."""
        post, moves, like = self.forward_backward(x)
        return np.concatenate([like, post[0].ravel(), moves.ravel(), post.sum(0).ravel(), np.einsum("tsk,td->skd", post, x).ravel(), np.einsum("tsk,td->skd", post, x * x).ravel()])

    def statistics_of_all(self, found: Sequence[np.ndarray]) -> np.ndarray:
        """The sum of :meth:`statistics` over sequences, which take each step of time together.

        The longest come first, so those that a step still concerns are the
        first ``live[t]``.
        """
        found = sorted(found, key=len, reverse=True)
        n = np.array([len(x) for x in found])
        steps, m = n[0], len(found)
        (s, k, d), live = self.mean.shape, (n[:, None] > np.arange(n[0])).sum(0).tolist()
        inside = np.arange(steps)[:, None] < n  # steps, sequences
        x = np.zeros((steps, m, d))
        for i, own in enumerate(found):
            x[: len(own), i] = own
        log = self.emissions(x.reshape(-1, d)).reshape(steps, m, s, k)
        top = log.max(3, keepdims=True)
        b = np.exp(log - top)
        alpha, beta, scale = np.zeros_like(b), np.ones_like(b), np.ones((steps, m, s, 1))
        a = self.start * b[0]
        for t in range(steps):
            h = live[t]
            if t:
                a = (alpha[t - 1, :h, :, None, :] @ self.move)[..., 0, :] * b[t, :h]
            c = np.maximum(a.sum(2, keepdims=True), 1e-300)
            scale[t, :h] = c
            alpha[t, :h] = a / c
        for t in range(steps - 2, -1, -1):
            h = live[t + 1]
            beta[t, :h] = (self.move @ (b[t + 1, :h] * beta[t + 1, :h])[..., None])[..., 0] / scale[t + 1, :h]
        post = alpha * beta
        post = np.divide(post, post.sum(3, keepdims=True), out=np.zeros_like(post), where=inside[:, :, None, None])
        after = np.where(inside[1:, :, None, None], b[1:] * beta[1:] / scale[1:], 0.0)
        moves = (alpha[:-1].reshape(-1, s, k).transpose(1, 2, 0) @ after.reshape(-1, s, k).transpose(1, 0, 2)) * self.move
        like = (np.log(scale[..., 0]) + np.where(inside[:, :, None], top[..., 0], 0.0)).sum((0, 1))
        weights, flat = post.reshape(-1, s * k).T, x.reshape(-1, d)
        return np.concatenate([like, post[0].sum(0).ravel(), moves.ravel(), weights.sum(1), (weights @ flat).ravel(), (weights @ (flat * flat)).ravel()])

    def updated(self, total: np.ndarray) -> tuple[Hidden, np.ndarray]:
        """The model that the summed statistics make most likely, and the likelihoods under this one."""
        s, k, d = self.mean.shape
        like, start, move, weight, sums, squares = np.split(total, np.cumsum([s, s * k, s * k * k, s * k, s * k * d]))
        start, move = start.reshape(s, k), move.reshape(s, k, k)
        weight, sums, squares = np.maximum(weight.reshape(s, k, 1), 1e-9), sums.reshape(s, k, d), squares.reshape(s, k, d)
        mean = sums / weight
        return Hidden(start / start.sum(1, keepdims=True), move / np.maximum(move.sum(2, keepdims=True), 1e-300), mean, np.maximum(squares / weight - mean**2, LEAST_VAR)), like

    def best(self, like: np.ndarray) -> Hidden:
        i = int(like.argmax())
        return Hidden(*(a[i : i + 1] for a in (self.start, self.move, self.mean, self.var)))

    def path(self, x: np.ndarray) -> np.ndarray:
        """The likeliest states of a sequence under the first model."""
        log, move = self.emissions(x)[:, 0], np.log(np.maximum(self.move[0], 1e-300))
        back, v = np.zeros(log.shape, int), np.log(np.maximum(self.start[0], 1e-300)) + log[0]
        for t in range(1, len(x)):
            s = v[:, None] + move
            back[t] = s.argmax(0)
            v = s.max(0) + log[t]
        at = np.empty(len(x), int)
        at[-1] = v.argmax()
        for t in range(len(x) - 1, 0, -1):
            at[t - 1] = back[t, at[t]]
        return at


def fit_hidden(x: np.ndarray, states: int = 4, rounds: int = 200, starts: int = 3, seed: int = 42) -> tuple[Hidden, list[np.ndarray]]:
    """The likeliest of ``starts`` models of one sequence, and the likelihoods of each round."""
    model, course = Hidden.begun(x, states, starts, seed), []
    for _ in range(rounds):
        model, like = model.updated(model.statistics(x))
        course.append(like)
        if len(course) > 1 and (like - course[-2] < CLOSE).all():
            break
    return model.best(model.forward_backward(x)[2]), course


def _scaled(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)


def detect(rows: DataFrame, names: Sequence[str], market: str = "market", states: int = 4, rounds: int = 200, seed: int = 42, starts: int = 3) -> DataFrame:
    """``date, state, confidence`` of each market's complete rows by a model of its own, a task per market.

    A market is one calendar of rows, so its group is bounded.  Features are
    standardised; fewer than 100 complete rows give no states.  State numbers
    have no meaning across runs; labels do.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date", ignore_index=True)
        x = part[list(names)].to_numpy(float)
        if len(x) < LEAST_ROWS:
            return pd.DataFrame(columns=[market, "date", "state", "confidence"])
        x = _scaled(x)
        model, _ = fit_hidden(x, states, rounds, starts, seed)
        return _states(part[[market, "date"]], model, x)

    return rows.na.drop("any", subset=list(names)).select(market, "date", *names).groupBy(market).applyInPandas(run, f"{market} string, date date, state int, confidence double")


def _states(keys: pd.DataFrame, model: Hidden, x: np.ndarray) -> pd.DataFrame:
    at = model.path(x)
    return keys.assign(state=at, confidence=model.forward_backward(x)[0][np.arange(len(x)), 0, at])


def detect_pooled(rows: DataFrame, names: Sequence[str], market: str = "market", states: int = 4, rounds: int = 200, seed: int = 42, starts: int = 3, drawn: int = 20_000) -> DataFrame:
    """As :func:`detect`, by one model of all markets together, so that a state means the same in each.

    Expectation and maximisation over the cluster: in each round tasks run
    forward and backward through the markets that they hold, ``TOGETHER`` at
    a time, and add up statistics of a fixed size; the driver gathers these
    sums, one row of them, and sends the next model out.  ``rows`` are read
    once; their complete series are kept in the folder of
    ``spark.checkpoint.dir`` for the states.  Means start from a sample of
    ``drawn`` rows; every market counts in every round.  Markets are
    standardised each by itself; those with fewer than 100 complete rows have
    no states.
    """
    whole = rows.na.drop("any", subset=list(names))
    each = whole.groupBy(market).agg(F.sort_array(F.collect_list(F.struct("date", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]))).alias("s")).where(F.size("s") >= LEAST_ROWS)
    flat = F.flatten(F.transform("s", lambda r: F.array(*[r[f"x{i}"] for i in range(len(names))])))
    each = each.select(F.col(market).cast("string").alias(market), F.col("s.date").alias("dates"), flat.alias("x")).persist()
    wide = len(names)
    as_matrix = lambda x: _scaled(np.asarray(x, float).reshape(-1, wide))

    def scaled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for x in part["x"]:
                yield pd.DataFrame({"r": list(as_matrix(x))})

    def summed(model: Hidden):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for part in parts:
                for lo in range(0, len(part), TOGETHER):
                    own = model.statistics_of_all([as_matrix(x) for x in part["x"][lo : lo + TOGETHER]])
                    total = own if total is None else total + own
            if total is not None:
                yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        return run

    try:
        kept = stored(each, "series")  # from the memory that the rounds read
        sample = each.select("x").mapInPandas(scaled, "r array<double>").orderBy(F.rand(seed)).limit(drawn).toPandas()
        if sample.empty:
            return rows.select(F.col(market).cast("string").alias(market), "date", F.lit(None).cast("int").alias("state"), F.lit(None).cast("double").alias("confidence")).limit(0)
        # As many tasks as there are lots of markets: a round's tasks cost more than its sums.
        each.unpersist()
        each = kept.select("x").repartition(-(-kept.count() // TOGETHER)).persist()
        model, old = Hidden.begun(np.vstack(sample["r"]), states, starts, seed), None
        for _ in range(rounds):
            sums = each.mapInPandas(summed(model), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
            before, (model, like) = model, model.updated(sums)
            if old is not None and (like - old < CLOSE).all():
                break
            old = like
        model = before.best(like)
    finally:
        each.unpersist()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, dates, x in zip(part[market], part["dates"], part["x"]):
                yield _states(pd.DataFrame({market: name, "date": list(dates)}), model, as_matrix(x))

    return kept.mapInPandas(run, f"{market} string, date date, state int, confidence double")


def label(profiles: DataFrame) -> DataFrame:
    """``profiles``, the mean features of each state, with the regime that its rules name first.

    A feature that is missing takes its neutral value; several states may
    have one name.
    """

    def at(name: str, neutral: float = 0.0):
        return F.coalesce(F.col(name), F.lit(neutral)) if name in profiles.columns else F.lit(neutral)

    real, dollar = at("real_yield_trend"), at("dxy_trend")
    rule = (
        F.when((at("vix", 15.0) > 25) | (at("oil_trend") > 0.05), CRISIS)
        .when((at("inflation_trend") > 0) & (real > 0) & (dollar > 0), TIGHTENING)
        .when((at("spx_trend") < -0.03) & (real < 0), RECESSION)
        .when((real < 0) & (dollar < 0), EASING)
        .when(at("miner_gold_spread") > 0.02, RECESSION)
        .otherwise(EASING)
    )
    return profiles.withColumn("regime_id", rule)


def current(regimes: DataFrame) -> DataFrame:
    return regimes.orderBy(F.desc("date")).limit(1)
