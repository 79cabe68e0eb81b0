"""Known answers and invariants."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitframe.functions import labels as fl
from pitframe.operators import asof, graph, inference, labels, models, paper, portfolio, regime, risk, stats
from pitframe.operators.windows import Series
from pitframe.pipeline import PRESETS, Run, Tracker, execute, resolve
from pitframe.sources import feeds, seeds, warehouse


def d(n: int) -> date:
    return date(2026, 1, n)


@pytest.fixture(scope="module")
def yields(spark):
    rows = [(d(i), "US10Y", 4.0 + 0.05 * (i - 1), d(i) + timedelta(days=1), "initial") for i in range(1, 11)]
    rows.append((d(5), "US10Y", 4.25, d(8), "2026-01-08"))
    return spark.createDataFrame(rows, "date date, symbol string, close double, release_date date, vintage string")


def known(yields, as_of):
    got = asof.latest_vintage(yields, ["date", "symbol"], ["release_date", "vintage"], ["close"], "release_date", as_of)
    return {r["date"]: round(r["close"], 6) for r in got.collect()}


@pytest.mark.parametrize(("as_of", "value"), [(d(6), 4.20), (d(9), 4.25)])
def test_revision_is_read_once_released(yields, as_of, value):
    assert known(yields, as_of)[d(5)] == value


def test_future_releases_are_unknown(yields):
    got = known(yields, d(5))
    assert d(5) not in got and d(4) in got


def test_null_release_is_never_known(spark):
    df = spark.createDataFrame([(d(1), "A", 1.0, None)], "date date, symbol string, close double, release_date date")
    assert asof.known_at(df, "release_date", d(9)).count() == 0


def test_intervals_agree_with_reads_at_each_time(spark, yields):
    spans = asof.vintage_intervals(yields, ["date", "symbol"], ["release_date", "vintage"], "release_date")
    times = spark.createDataFrame([(d(i),) for i in range(1, 12)], "as_of date")
    got = {(r["as_of"], r["date"]): round(r["close"], 6) for r in asof.history_at(spans, times, "as_of").collect()}
    for i in range(1, 12):
        assert {k[1]: x for k, x in got.items() if k[0] == d(i)} == known(yields, d(i))


def test_features_do_not_see_later_releases(spark, yields):
    """Changing every row released after T leaves the features at T as they are."""
    s, t = Series(), d(6)

    def features(df):
        p = asof.latest_vintage(df, ["date", "symbol"], ["release_date", "vintage"], ["close"], "release_date", t)
        return sorted(tuple(r) for r in p.select("date", s.change(F.col("close"), 1), s.diff(F.col("close"), 2)).collect())

    changed = yields.withColumn("close", F.when(F.col("release_date") > t, F.col("close") * 9).otherwise(F.col("close")))
    assert features(yields) == features(changed)


def test_release_dates(spark):
    df = spark.createDataFrame([("DGS10", date(2026, 6, 15)), ("CPIAUCSL", date(2026, 6, 15)), ("other", date(2026, 6, 15))], "s string, day date")
    got = {r["s"]: r["r"] for r in df.select("s", asof.release_date(F.col("day"), F.col("s"), seeds.PUBLICATION_LAG).alias("r")).collect()}
    assert got == {"DGS10": date(2026, 6, 16), "CPIAUCSL": date(2026, 7, 30), "other": date(2026, 6, 16)}


def test_backward_join_prefers_same_day_and_passes_nulls(spark):
    left = spark.createDataFrame([("A", d(1)), ("A", d(3)), ("A", d(5)), ("B", d(3))], "s string, day date")
    right = spark.createDataFrame([("A", d(3), 1.0), ("A", d(4), None)], "s string, date date, x double")
    got = {(r["s"], r["day"]): r["x"] for r in asof.asof_backward(left, right, ["s"], "day", "date", ["x"]).collect()}
    assert got == {("A", d(1)): None, ("A", d(3)): 1.0, ("A", d(5)): 1.0, ("B", d(3)): None}


def test_signal_and_versions(spark):
    df = spark.createDataFrame([(0.62, 0.01, "asof_h5"), (0.38, -0.01, "h5"), (0.56, 0.0, None), (0.44, 0.0, ""), (0.5, 0.0, "asof")], "p double, a double, v string")
    got = df.select(fl.signal("p", "a").alias("s"), fl.is_live("v").alias("live"), fl.scoring_path("v").alias("path")).collect()
    assert [r["s"] for r in got] == ["long", "short", "overweight", "underweight", "neutral"]
    assert [r["live"] for r in got] == [False, True, True, True, True]
    assert got[0]["path"] == "asof_embargo"


@pytest.mark.parametrize(("gold", "want"), [((0.02, 0.01, 1.0, 0.0, "bullish"), "add"), ((0.0, 0.01, 2.5, 0.0, "neutral"), "reduce"), ((None, 0.01, 2.5, 0.0, "bullish"), "keep"), ((0.02, 0.01, 2.5, 0.0, "bullish"), "keep")])
def test_stance(spark, gold, want):
    df = spark.createDataFrame([gold], "g double, b double, y double, x double, bias string")
    assert df.select(fl.stance(*[F.col(c) for c in ("g", "b", "y", "x", "bias")]).alias("s")).first()["s"] == want


def test_folds_keep_the_embargo(spark):
    walk = labels.Walk(40, 1, 10, 10)
    got = labels.folds(spark, 120, walk).collect()
    assert len(got) >= 3
    assert all(r["train_hi"] <= r["test_lo"] - 10 and r["train_hi"] - r["train_lo"] == 40 for r in got)
    assert labels.folds(spark, 40, walk).count() == 0


def test_walk_rows_agree_with_folds(spark):
    walk = labels.Walk(20, 7, 5, 3)
    lengths = {"a": 61, "b": 30, "c": 29}
    rows = spark.createDataFrame([(k, i * 2) for k, n in lengths.items() for i in range(n)], "k string, at int")
    got = sorted(tuple(r) for r in labels.walk_rows(rows, walk, ["k"], "at").select("k", "fold", "part", "rn", (F.col("at") / 2).cast("int")).collect())
    want = []
    for k, n in lengths.items():
        for f in labels.folds(spark, n, walk).collect():
            want += [(k, f["fold"], "train", i, i) for i in range(f["train_lo"], f["train_hi"])] + [(k, f["fold"], "test", i, i) for i in range(f["test_lo"], f["test_hi"])]
    assert got == sorted(want) and {k for k, *_ in got} == {"a", "b"}


def test_learners(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    x[::17, 1] = np.nan
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    for make in (models.Stumps, models.Logit):
        p = make().fit(x[:300], y[:300], True).predict(x[300:])
        assert ((p > 0.5) == y[300:]).mean() > 0.85 and p.min() >= 0 and p.max() <= 1
    flat = models.Logit().fit(np.zeros((10, 2)), np.array([0.0, 1.0] * 5)).predict(np.zeros((1, 2)))
    assert abs(flat[0] - 0.5) < 1e-9


def test_expected_returns_fall_back_on_the_trailing_move(spark):
    rows = [("long", i, 0.1 if i % 2 else -0.1, None if i == 99 else (0.1 if i % 2 else -0.1)) for i in range(100)] + [("short", i, 0.5, 0.2) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, date int, m double, fwd double")
    got = {r["symbol"]: r for r in models.expected_returns(df, ["m"], "fwd", "m", ["symbol"]).collect()}
    assert got["long"]["source"] == "model" and got["long"]["date"] == 99 and abs(got["long"]["expected_return"] - 0.1) < 0.02
    assert got["short"]["source"] == "trailing" and got["short"]["expected_return"] == 0.5


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.005)], "i int, p double")
    got = {r["i"]: (r["rank"], round(r["p_adjusted"], 6), r["significant"]) for r in stats.holm(df, [], "i", "p").collect()}
    assert got == {3: (1, 0.02, True), 0: (2, 0.03, True), 2: (3, 0.06, False), 1: (4, 0.06, False)}


def test_bootstrap(spark):
    x = np.random.default_rng(42).normal(5, 1, 100)
    a, b = (inference.bootstrap(spark, x, reps=200).first() for _ in range(2))
    assert a == b
    assert a["low"] < 5 < a["high"] and a["low"] <= a["point"] <= a["high"]
    flat = inference.bootstrap(spark, [5.0] * 20, reps=50).first()
    assert flat["low"] == flat["high"] == 5.0
    assert math.isnan(inference.bootstrap(spark, [1.0, 2.0]).first()["point"])
    assert round(inference.bootstrap(spark, [0.1] * 3, "total", reps=20).first()["point"], 6) == 0.331


@pytest.mark.parametrize("draw", [inference.stationary_indices, inference.moving_indices])
def test_resamples_are_blocks(draw):
    at = draw(60, 6, np.random.default_rng(1))
    assert len(at) == 60 and at.min() >= 0 and at.max() < 60
    assert (np.diff(at) % 60 == 1).mean() > 0.6


def losses(spark, a, b):
    return spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "k string, t int, a double, b double")


def test_diebold_mariano(spark):
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, 50) ** 2, rng.normal(0, 2, 50) ** 2
    less = inference.diebold_mariano(losses(spark, good, bad), ["k"], "t", "a", "b", 1, "less").first()
    assert less["statistic"] < 0 and less["p_value"] < 0.05 and less["hac_lags"] == 0
    more = inference.diebold_mariano(losses(spark, bad, good), ["k"], "t", "a", "b", 1, "greater").first()
    assert more["statistic"] > 0 and more["p_value"] < 0.05
    assert inference.diebold_mariano(losses(spark, good[:3], bad[:3]), ["k"], "t", "a", "b").first()["statistic"] is None
    assert inference.diebold_mariano(losses(spark, good, good), ["k"], "t", "a", "b").first()["p_value"] is None
    for h, lags in ((1, 0), (5, 4), (10, 9)):
        assert inference.diebold_mariano(losses(spark, good, bad), ["k"], "t", "a", "b", h).first()["hac_lags"] == lags


def test_newey_west_exceeds_independence_under_persistence(spark):
    rng, x = np.random.default_rng(42), [0.0]
    for _ in range(199):
        x.append(0.7 * x[-1] + rng.normal())
    got = {k: stats.newey_west(losses(spark, x, x), ["k"], "t", "a", k).first()["nw_var"] for k in (0, 10)}
    assert got[10] > got[0]
    c = np.array(x) - np.mean(x)
    assert got[0] == pytest.approx((c @ c) / 200 / 200, rel=1e-9)


def test_normal_cdf(spark):
    xs = [-9.0, -3.0, -1.0, 0.0, 0.5, 2.0, 8.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(inference.normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=1e-12)


def test_rebalance_accounts():
    rng = np.random.default_rng(3)
    shares, cash = {}, 100_000.0
    for _ in range(60):
        price = {s: float(rng.uniform(5, 50)) for s in "ABCD"}
        worth = cash + sum(n * price[s] for s, n in shares.items())
        w = rng.dirichlet(np.ones(4))
        cash, orders = paper.rebalance(shares, cash, price, {s: worth * x for s, x in zip("ABCD", w)})
        after = cash + sum(n * price[s] for s, n in shares.items())
        assert cash >= -1e-6 and min(shares.values()) >= -1e-9
        assert after == pytest.approx(worth - sum(o[5] for o in orders), abs=1e-6)
        assert [o[1] for o in orders] == sorted((o[1] for o in orders), reverse=True)


def test_simulation_waits_for_the_horizon(spark):
    days = [(5, d(i), 10.0, 20.0, {"G": 10.0, "S": 20.0}, "keep", 0.3, {"G": 1.0}) for i in range(2, 22)]
    days.insert(0, (5, d(1), 10.0, 20.0, {"G": 10.0, "S": 20.0}, None, None, None))
    df = spark.createDataFrame(days, "horizon_days int, date date, gold double, spx double, prices map<string,double>, stance string, gold_budget double, sleeve map<string,double>")
    ev = paper.simulate(df, "S").cache()
    navs = paper.navs(ev).orderBy("date").collect()
    assert navs[0]["date"] == d(2) and len(navs) == 20
    assert {r["date"] for r in paper.orders(ev).collect()} <= {d(2), d(7), d(12), d(17)}
    assert navs[-1]["nav"] < 100_000 and navs[-1]["benchmark_gold"] == 100_000


def test_weights(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, [0.01, 0.02, 0.04], (200, 3))
    cov = np.cov(x, rowvar=False)
    w = portfolio.hierarchical_parity(cov)
    assert w.sum() == pytest.approx(1) and (w > 0).all() and w[0] > w[2]
    m = portfolio.mean_variance(np.eye(3), np.array([0.3, 0.0, -0.5]))
    assert m == pytest.approx([0.65, 0.35, 0.0], abs=1e-6)


def test_upsert_changes_only_the_columns_named(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, x double")
    new = spark.createDataFrame([(2, "z", 9.0), (3, "c", None)], "k int, name string, x double")
    once = warehouse.upsert(old, new, ["k"], ["x"])
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a", 1.0), (2, "b", 9.0), (3, "c", None)]
    assert sorted(map(tuple, warehouse.upsert(once, new, ["k"], ["x"]).collect())) == sorted(map(tuple, once.collect()))


def test_tables_round_trip(spark, tmp_path):
    root = str(tmp_path)
    warehouse.create(spark, root)
    warehouse.write_table(seeds.purchases(spark), root, "central_bank_purchases")
    got = warehouse.scan(spark, root, "central_bank_purchases")
    assert got.count() == 21 and dict(got.dtypes)["purchase_tonnes"] == "decimal(12,4)"
    warehouse.export_csv(got, f"{root}/csv")
    assert spark.read.option("header", True).csv(f"{root}/csv").count() == 21


def test_feeds(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("Date,Open,High,Low,Close,Adj Volume\n2026-01-02,1,2,0.5,1.5,10\n2026-01-03,x,2,0.5,1.6,11\n")
    got = feeds.bars(spark, str(tmp_path / "bars.csv"), "A").orderBy("date").collect()
    assert [r["close"] for r in got] == [1.5, 1.6] and got[1]["open"] is None
    (tmp_path / "rev.csv").write_text("date,value,realtime_start\n2026-01-02,4.0,2026-01-09\n2026-01-03,4.1,\n")
    rev = {r["date"]: (r["vintage"], r["release_date"], r["lag_assumed"]) for r in feeds.revisions(spark, str(tmp_path / "rev.csv"), "DGS10").collect()}
    assert rev == {d(2): ("2026-01-09", d(9), False), d(3): ("initial", d(4), True)}


def test_graph(spark):
    nodes, edges = seeds.graph_nodes(spark), seeds.graph_edges(spark)
    assert nodes.count() > 10 and edges.count() > 10 and seeds.regime_hypotheses(spark).count() == 4
    assert graph.causes_of(edges, "Gold").count() >= 3
    cyclic = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")], "source string, target string")
    got = {tuple(r["path"]) for r in graph.simple_paths(cyclic, spark.createDataFrame([("a",)], "start string"), "c").collect()}
    assert got == {("a", "b", "c")}
    assert graph.simple_paths(edges, spark.createDataFrame([("nowhere",)], "start string"), "Gold").count() == 0


def test_neutral_risk_without_rows(spark):
    panel = spark.createDataFrame([], "date date, fear double, oil double")
    assert set(risk.risk_on(panel, d(9)).drop("day").first()) == {0.3}


def test_hidden_states_need_rows_and_split_levels(spark):
    rng = np.random.default_rng(2)
    rows = [("all", d(1) + timedelta(days=i), float((5 if i // 60 % 2 else -5) + rng.normal()), float(rng.normal())) for i in range(240)]
    df = spark.createDataFrame(rows, "market string, date date, x double, z double")
    got = regime.detect(df, ["x", "z"], states=2, rounds=40).orderBy("date").collect()
    assert len(got) == 240 and all(0 <= r["confidence"] <= 1 + 1e-9 for r in got)
    first, second = {r["state"] for r in got[5:55]}, {r["state"] for r in got[65:115]}
    assert len(first) == 1 and len(second) == 1 and first != second
    assert regime.detect(df.limit(50), ["x", "z"]).count() == 0


def asof_frame(spark, n, bump=0.0):
    rng = np.random.default_rng(7)
    x = rng.normal(size=n)
    rows = [("A", 10, i, d(1) + timedelta(days=i), int(x[i] > 0) if i < n - 10 else None, float(x[i]) + (bump if i > n - 25 else 0) if i < n - 10 else None, float(x[i]) if i < n - 10 else None, float(x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "entity string, horizon_days int, rn int, date date, y int, alpha double, ret double, f double")


def test_asof_scores(spark):
    got = models.asof_scores(asof_frame(spark, 200), ["f"]).collect()
    assert got and all(r["model_version"] == "asof_h10" and 0 <= r["prob"] <= 1 and r["n_train"] <= 120 for r in got)
    assert models.asof_scores(asof_frame(spark, 40), ["f"]).count() == 0
    before = {r["date"]: r["expected_alpha"] for r in got}
    after = {r["date"]: r["expected_alpha"] for r in models.asof_scores(asof_frame(spark, 200, 5.0), ["f"]).collect()}
    early = [k for k in before if k <= d(1) + timedelta(days=180)]
    assert early and all(before[k] == after[k] for k in early)


def test_runs():
    assert resolve("full").stages == tuple(resolve().stages)
    assert resolve("train_short", horizons=[5, 999]).horizons == (5,)
    assert resolve("refresh_prices", stages=["nonsense"]).stages == PRESETS["refresh_prices"]["stages"]
    assert Run(entities=("B", "A")).names(["A", "B", "C"], []) == ["A", "B"]


def test_tracker():
    t = Tracker(lines=3)
    run = Run(stages=("etl", "features"))
    assert t.begin(run) and not t.begin(run)
    t.report("etl", message="x")
    assert t.percent() == pytest.approx(100 * 0.15 * 10 / 22, abs=0.1)
    t.report("features", 1, 2)
    assert t.percent() == pytest.approx(100 * (10 + 6) / 22, abs=0.1)
    for i in range(9):
        t.report("features", message=str(i))
    assert len(t.snapshot()["log"]) == 3
    t.finish()
    assert t.percent() == 100
    done = []
    execute(run, {s: lambda r, say, s=s: done.append(s) for s in run.stages}, Tracker())
    assert done == ["etl", "features"]
    failing = Tracker()
    with pytest.raises(ZeroDivisionError):
        execute(run, {"etl": lambda r, say: 1 / 0}, failing)
    assert failing.status == "failed"
