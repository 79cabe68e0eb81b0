"""Learners by choice, features by fold, dealt bootstraps, texts of tests, marked books, the daily load."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitframe import etl
from pitframe.operators import features, inference, models, paper
from pitframe.pipeline import Run, Tracker, execute
from pitframe.sources import warehouse


def d(n: int) -> date:
    return date(2026, 1, 1) + timedelta(days=n)


def test_features_are_chosen_by_training_rows():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    fit = pd.DataFrame({"flat": 1.0, "weak": y + rng.normal(0, 5, 200), "strong": -y + rng.normal(0, 0.2, 200), "rare": np.where(np.arange(200) < 20, y, np.nan), "wild": np.where(np.arange(200) == 3, np.inf, y * 1.0), "y": y})
    assert models.chosen(fit, ["flat", "weak", "strong", "rare", "wild"], "y", 2) == ["wild", "strong"]
    assert models.chosen(fit.head(10), ["flat", "weak", "strong"], "y", 2) == ["flat", "weak"]


def test_a_fold_uses_its_own_features(spark):
    rng = np.random.default_rng(2)
    rows = []
    for fold in (0, 1):
        for i in range(120):
            y = int(rng.integers(0, 2))
            told = (float(y), float(rng.normal())) if fold == 0 else (float(rng.normal()), float(y))
            rows.append((fold, i, "train" if i < 90 else "test", y, *told))
    df = spark.createDataFrame(rows, "fold int, rn int, part string, y int, a double, b double")
    got = models.fold_scores(df, ["a", "b"], "y", learners={"s": models.Stumps, "l": models.Logit}, choose=1).collect()
    assert len(got) == 60 and all((r["s"] > 0.5) == (r["y"] == 1) == (r["l"] > 0.5) for r in got)


def test_training_takes_a_learner(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i), int(i % 7 > 3)) for i in range(150)], "a double, b double, y int")
    status, model = models.train(rows, ["a", "b"], "y", learner=models.logistic)
    assert status == "trained" and models.probability(model, rows).where((F.col("prob") > 0.5) != (F.col("y") == 1)).count() == 0
    assert models.train(rows.limit(3), ["a"], "y", learner=models.logistic)[0] == "insufficient_data"


@pytest.mark.parametrize("moving", [False, True])
def test_grouped_draws_agree_with_single_ones_however_dealt(spark, moving):
    rng = np.random.default_rng(3)
    x = rng.normal(0.01, 0.1, 60)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0), ("c", 0, 1.0), ("c", 1, None), ("c", 2, 1.0)]
    df = spark.createDataFrame(rows, "g string, t int, x double")
    one, other = ({r["g"]: r for r in inference.grouped_bootstrap(df, ["g"], "t", "x", "total", 5, reps=300, moving=moving, draws=n).collect()} for n in (300, 70))
    single = inference.bootstrap(spark, x, "total", inference.block_length(60, 5), 300, moving=moving).first()
    for got in (one, other):
        assert all(math.isclose(got["a"][c], single[c], rel_tol=1e-12) for c in ("point", "low", "high"))
        assert got["b"]["n"] == 1 and math.isnan(got["b"]["low"]) and math.isnan(got["c"]["point"]) and got["c"]["n"] == 3
    assert one["a"]["low"] < one["a"]["point"] < one["a"]["high"]


def test_moving_blocks_do_not_wrap():
    at = inference.moving_indices(20, 6, np.random.default_rng(1))
    assert len(at) == 20 and at.max() < 20 and all((np.diff(at[i : i + 6]) == 1).all() for i in (0, 6, 12))


def test_texts_of_tests(spark):
    df = spark.createDataFrame([(0.004, -0.02), (0.03, 0.02), (0.07, -0.001), (0.4, 0.5), (None, 0.1), (float("nan"), 0.1)], "p double, m double")
    got = [r[0] for r in df.select(inference.dm_text(F.col("p"), F.col("m"), "trees", "momentum")).collect()]
    assert got == [
        "trees loses 0.0200 less a period than momentum (surely so: p below 0.01, p = 0.004).", "trees loses 0.0200 more a period than momentum (p below 0.05, p = 0.030).",
        "trees loses 0.0010 less a period than momentum (perhaps: p below 0.10, p = 0.070).", "trees loses 0.5000 more a period than momentum (which may be chance, p = 0.400).",
        "trees against momentum: too few observations.", "trees against momentum: too few observations.",
    ]


def test_marked_books(spark):
    prices = spark.createDataFrame([("G", d(0), 10.0), ("G", d(40), 20.0), ("G", d(41), None)], "symbol string, date date, close double")
    cash = spark.createDataFrame([(5, d(1), 7.0), (5, d(50), 1.0), (9, d(1), 3.0)], "horizon_days int, date date, cash double")
    held = spark.createDataFrame([(5, d(1), "G", 2.0), (5, d(50), "G", 3.0), (5, d(50), "unpriced", 4.0)], "horizon_days int, date date, symbol string, shares double")
    got = {(r["horizon_days"], r["date"]): r["nav"] for r in paper.marked(cash, held, prices).collect()}
    assert got == {(5, d(1)): 27.0, (5, d(50)): 61.0, (9, d(1)): 3.0}


def test_the_store_has_every_feature_as_of_a_day(spark):
    rng = np.random.default_rng(4)
    rows = [(s, d(i), float(v)) for s in ("gold", "spx", "miner", "short") for i, v in enumerate(100 + np.cumsum(rng.normal(0, 1, 20 if s == "short" else 300)))]
    prices = spark.createDataFrame(rows, "symbol string, date date, close double")
    quarterly = spark.createDataFrame([("miner", d(-90), 10.0, 4.0, 0.1), ("miner", d(0), 12.0, 5.0, 0.3), ("gold", d(0), 1.0, 1.0, 0.0)], "ticker string, quarter_end date, production_oz double, aisc_per_oz double, analyst_eps_revision double")
    roles = {"gold": "gold", "spx": "spx", "vix": "spx", "real": "spx", "dollar": "spx", "breakeven": "spx"}
    made = lambda p: features.store(p, roles, ["miner"], quarterly)
    got = {(r["entity"], r["date"], r["feature_name"]): r["feature_value"] for r in made(prices).collect()}
    assert {k[2] for k in got if k[0] == "gold"} == set(features.PRICE_FEATURES)
    assert {k[2] for k in got if k[0] == "short"} == {"ret_5d", "ret_10d"}
    assert {k[2] for k in got if k[0] == "miner"} - set(features.PRICE_FEATURES) == {"beta_to_gold_60d", "prod_surprise", "aisc_surprise", "revision_momentum"}
    assert [(k[1], round(x, 6)) for k, x in got.items() if k[2] == "prod_surprise"] == [(d(299), 0.2)]
    assert {k[2] for k in got if k[0] == "MACRO"} == {"gold_spx_ratio", "gold_spx_ratio_zscore", "real_yield", "real_yield_trend_20d", "real_yield_zscore", "dxy_trend_20d", "dxy_zscore", "vix_level", "vix_zscore", "breakeven_inflation", "inflation_trend_20d"}
    # What comes later does not change what was.
    later = prices.withColumn("close", F.when(F.col("date") > d(250), F.col("close") * 3).otherwise(F.col("close")))
    after = {(r["entity"], r["date"], r["feature_name"]): r["feature_value"] for r in made(later).where(F.col("date") <= d(250)).collect()}
    assert after == {k: x for k, x in got.items() if k[1] <= d(250)}


def test_the_daily_load(spark, tmp_path):
    root = str(tmp_path)
    warehouse.create(spark, root)
    macro = [(s, d(i), 20.0 + i % 5, d(i + 1), "initial", True) for s in ("VIX", "CL=F") for i in range(40)]
    bars = [(s, d(i), 100.0 + i, 1e6) for s in ("GLD", "other") for i in range(40)]
    month = lambda i: date(2024 + i // 12, i % 12 + 1, 1)
    landed = lambda extra=(): etl.Landed(
        spark.createDataFrame(macro + list(extra), "symbol string, date date, close double, release_date date, vintage string, lag_assumed boolean"),
        spark.createDataFrame(bars, "symbol string, date date, close double, volume double"), None,
        spark.createDataFrame([(month(i), c, 10.0 + i) for c in ("CN", "PL") for i in range(15)], "month date, country string, purchase_tonnes double"),
    )
    tracker = Tracker()
    load = lambda x: execute(Run(stages=("etl",)), {"etl": etl.etl_stage(spark, root, x, d(0), d(39))}, tracker)["etl"]
    first = load(landed())
    assert first["macro_daily"] == 80 and first["etf_flows"] == 40 and first["central_bank_purchases"] == 30 and first["geopolitical_risk"] == 40
    assert first["miner_companies"] > 5 and first["miner_quarterly"] > 0 and any("etf_flows: 40" in x for x in tracker.snapshot()["log"])
    read = lambda name: sorted(map(str, warehouse.scan(spark, root, name).collect()))
    before = {n: read(n) for n in first}
    assert load(landed()) == first and {n: read(n) for n in first} == before
    last = warehouse.scan(spark, root, "central_bank_purchases").where("country = 'CN'").orderBy(F.desc("month")).first()
    assert float(last["rolling_12m_tonnes"]) == sum(10.0 + i for i in range(3, 15)) and float(last["yoy_growth_pct"]) == round((24 / 12 - 1) * 100, 4)
    second = load(landed([("VIX", d(3), 99.0, d(9), "2026-01-10", False)]))
    assert second["macro_daily"] == 81 and {n: x for n, x in second.items() if n != "macro_daily"} == {n: x for n, x in first.items() if n != "macro_daily"}
