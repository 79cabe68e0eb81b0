"""Every desk read works on an empty warehouse and on a small one."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pitframe.desk import Desk
from pitframe.operators import models
from pitframe.sources import artifacts, seeds, warehouse

END = date(2026, 3, 1)
READS = (
    ("health", ()), ("macro_snapshot", ()), ("hypotheses", ("Gold",)), ("transmission", ("Fed Policy", "Gold")), ("regimes", ()), ("current_regime", ()), ("regime_history", (30,)), ("macro_series", (("SPX",), 30)),
    ("predictions", (10,)), ("etf_flows", ("GLD",)), ("central_banks", ()), ("signals", (10,)), ("model_catalog", ()), ("universe", ()), ("allocation", ()), ("strategies", ()), ("paper_stats", ()), ("history", (30, 10)),
    ("portfolio_analytics", ()), ("dashboard", ()), ("explain", ()), ("pipeline_options", ()),
)


@pytest.fixture(scope="module")
def roots(spark, tmp_path_factory):
    empty, full = (str(tmp_path_factory.mktemp(x)) for x in ("empty", "full"))
    warehouse.create(spark, empty)
    warehouse.create(spark, full)
    days = [END - timedelta(days=i) for i in range(40)]
    macro = [(day, s, base + i * step, day, "initial") for s, base, step in (("GC=F", 100.0, -1.0), ("SPX", 50.0, 0.5), ("US10Y", 4.0, 0.0), ("DX-Y.NYB", 100.0, 0.5)) for i, day in enumerate(days)]
    macro.append((END, "SPX", 1.0, END + timedelta(days=9), "later"))
    w = lambda rows, schema, name: warehouse.write_table(spark.createDataFrame(rows, schema), full, name)
    w(macro, "date date, symbol string, close double, release_date date, vintage string", "macro_daily")
    w([(1, END, "GLD", 10, "h10", 0.7, 0.04, 0.03), (2, END, "NEM", 10, None, 0.62, 0.02, 0.01), (3, END, "GLD", 10, "asof_h10", 0.1, -0.5, -0.5)], "id long, date date, entity string, horizon_days int, model_version string, prob_outperform_gold double, expected_return double, expected_alpha double", "model_predictions")
    w([(END, 2, "Easing / Dollar Weak", 0.8)], "date date, regime_id int, regime_name string, confidence double", "market_regimes")
    w([(END, "GLD", 5.0)], "date date, ticker string, weekly_flow double", "etf_flows")
    w([(10, END - timedelta(days=1), 100_000.0, 0.0), (10, END, 101_000.0, 0.0)], "horizon_days int, date date, nav double, cash double", "paper_nav")
    w([(END, 1, "GLD", 0.7, 0.02), (END, 2, "NEM", 0.3, 0.01)], "date date, rank int, ticker string, weight double, expected_alpha double", "portfolio_recommendations")
    warehouse.write_table(seeds.purchases(spark), full, "central_bank_purchases")
    return empty, full


@pytest.mark.parametrize(("name", "args"), READS)
def test_reads(spark, roots, name, args):
    for root in roots:
        getattr(Desk(spark, root, END), name)(*args).collect()


def test_answers(spark, roots):
    desk = Desk(spark, roots[1], END)
    snap = desk.macro_snapshot().first()
    assert snap["gold_price"] == 100.0 and snap["spx"] == 50.0 and snap["real_yields"] == 1.75 and snap["real_yield_source"] == "estimated"
    call = desk.allocation().first()
    assert call["stance"] == "add" and call["dollar_role"] == "support" and len(call["reasons"]) == 4
    assert [(r["entity"], r["signal"]) for r in desk.signals(10).orderBy("rank").collect()] == [("GLD", "long"), ("NEM", "long")]
    assert desk.strategies().where("rank = 1").first()["id"] == "gold_budget"
    assert desk.dashboard().first()["official_demand"] == "strong"
    assert round(desk.portfolio_analytics().first()["hhi"], 6) == 0.58
    assert desk.history(30, 10).count() == 1
    nodes, edges = desk.knowledge_graph()
    assert (nodes.count(), edges.count()) == (21, 19)
    assert set(desk.paper()) == {"stats", "curve", "orders", "positions"} and desk.pipeline_status()["status"] == "idle"


def test_artifacts(spark, tmp_path):
    rows = spark.range(200).selectExpr("id % 7 as a", "id % 2 as y", "id % 3 as b").withColumn("y", F.col("y").cast("double"))
    status, model = models.train(rows, ["a", "b"], "y", trees=2, depth=2)
    assert status == "trained"
    artifacts.save_model(model, str(tmp_path), "GC=F", 20)
    got = artifacts.registry(spark, str(tmp_path)).first()
    assert (got["entity"], got["kind"], got["horizon_days"]) == ("GC=F", "clf", 20)
    assert models.probability(artifacts.load_model(got["path"]), rows).count() == 200
    data, table = artifacts.report(spark.createDataFrame([("m", 0.5, None)], "book string, auc double, n int"), "Study")
    assert "| m | 0.5000 | — |" in table and '"title": "Study"' in data
    text = artifacts.splice("intro\n<a>\nold\n</a>\nend", "<a>", "</a>", "new")
    assert text == "intro\n<a>\nnew\n</a>\nend" and artifacts.splice("x", "<a>", "</a>", "y").endswith("<a>\ny\n</a>\n")
    assert artifacts.Settings.of(spark).horizon == 10
