"""Shapes of physical plans that scale depends on."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pitframe.operators import asof, stats
from pitframe.operators.windows import Series
from pitframe.plans import catalog
from pitframe.sources import views


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_windows_of_a_series_share_one_exchange(spark, sf_dir, tmp_path):
    path = str(tmp_path / "p")
    views.prices(spark, sf_dir).write.parquet(path)
    s, x = Series(), F.col("close")
    p = spark.read.parquet(path).withColumn("ret", s.change(x, 1))
    f = p.select("symbol", "date", s.change(x, 5), s.volatility(F.col("ret"), 20), s.zscore(x), s.from_mean(x), s.forward(x, 10))
    assert plan(f).count("Exchange hashpartitioning") == 1


def test_vintages_are_reduced_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(10).selectExpr("id as k", "date '2026-01-01' as r", "1.0d as x", "'wide' as unused").write.parquet(path)
    text = plan(asof.latest_vintage(spark.read.parquet(path), ["k"], ["r"], ["x"], "r", "2026-06-01"))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_max" in text
    assert "PushedFilters: [IsNotNull(r), LessThanOrEqual(r," in text and "unused" not in text


def test_scans_read_only_what_they_need(spark, sf_dir):
    text = plan(catalog.queries()["a18_calibration"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in text


def test_no_query_needs_a_cartesian_product(spark, sf_dir):
    for name in ("j22_all_paths", "m1_fold_rows"):
        assert "CartesianProduct" not in plan(catalog.queries()[name](spark, sf_dir)), name
    for name in ("m1_fold_rows", "j2_feature_targets", "w11_rolling_beta", "j3_price_at_or_before", "j4_regime_in_force", "j5_many_asof", "b3_contexts", "b5_marked", "a10_covariance"):
        text = plan(catalog.queries()[name](spark, sf_dir))
        assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text, name


def test_no_window_holds_all_rows(spark, sf_dir):
    one_task = re.compile(r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition")
    plans = {n: plan(catalog.queries()[n](spark, sf_dir)) for n in ("w22_rank_share", "w23_rank_of_all", "a19_auc", "j3_price_at_or_before", "j4_regime_in_force", "b3_contexts", "w5_w6_w7_oscillators", "a10_covariance")}
    plans["auc of all"] = plan(stats.auc(views.scores(spark, sf_dir), "y", "p"))
    for name, text in plans.items():
        assert not one_task.search(text), name
        assert not re.search(r"windowspecdefinition\(0,", text), name  # no constant key either
    for name in ("w22_rank_share", "a19_auc", "j3_price_at_or_before", "w5_w6_w7_oscillators", "a10_covariance"):
        assert "SinglePartition" not in plans[name].split("Subquery", 1)[0], name


def test_covariance_is_one_aggregation_of_tasks_sums(spark, sf_dir, tmp_path):
    path = str(tmp_path / "r")
    views.prices(spark, sf_dir).select("date", "symbol", "close").write.parquet(path)
    text = plan(stats.covariance(spark.read.parquet(path), "date", "symbol", "close"))
    assert text.count("Exchange hashpartitioning") == 3 and "Join" not in text and text.count("MapInPandas") == 1  # by series, by time, by pair
