"""Rules that exist for one value and for a table of values agree; queries about them read the given tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pitframe.operators import inference, labels
from pitframe.pipeline import HORIZONS, PRESETS, resolve, resolve_rows
from pitframe.plans import catalog


def test_fitted_lengths_are_those_of_one_series(spark):
    sizes = [(n, h) for n in (0, 1, 79, 80, 81, 99, 150, 259, 263, 459, 600, 5000) for h in (1, 5, 10, 20, 63, 126)]
    got = spark.createDataFrame(sizes, "n long, h int").withColumn("w", labels.fitted_lengths(F.col("n"), F.col("h"))).collect()
    for r in got:
        want = labels.fitted_walk(r["n"], r["h"])
        assert (None if r["w"] is None else tuple(r["w"])) == (None if want is None else (want.train, want.test, want.step)), r
    assert {r["w"] is None for r in got if r["n"] >= 80} == {True, False}


def test_folds_of_many_series_are_those_of_each(spark):
    walk = labels.Walk(40, 10, 10, 5)
    sizes = [("a", 120), ("b", 54), ("c", 55), ("d", 0), ("e", None)]
    got = labels.series_folds(spark.createDataFrame(sizes, "symbol string, n long"), walk)
    assert got.columns[0] == "symbol" and "n" not in got.columns
    for symbol, n in sizes:
        want = [] if n is None else sorted(map(tuple, labels.folds(spark, n, walk).collect()))
        assert sorted(tuple(r)[1:] for r in got.where(F.col("symbol") == symbol).collect()) == want
    assert labels.series_folds(spark.createDataFrame([], "symbol string, n long"), walk).count() == 0


def test_block_lengths_are_those_of_one_series(spark):
    sizes = [(n, h) for n in (0, 3, 41, 80, 200) for h in (1, 5, 10, 20)]
    for r in spark.createDataFrame(sizes, "n long, h int").withColumn("b", inference.block_length_of(F.col("n"), F.col("h"))).collect():
        assert r["b"] == inference.block_length(r["n"], r["h"])


def test_requests_resolve_as_one_does(spark):
    requests = [
        (p, s, h) for p in (*PRESETS, "unknown", None) for s in (None, [], ["train", "etl"], ["nothing"], [None, "paper"]) for h in (None, [], [10, 5, 7], [8], [126, 126])
    ]
    got = resolve_rows(spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], "i int, preset string, stages array<string>, horizons array<int>")).collect()
    assert len(got) == len(requests)
    for r in got:
        preset, stages, horizons = requests[r["i"]]
        want = resolve(preset, stages=stages, horizons=horizons)
        assert (tuple(r["stages"]), tuple(r["horizons"])) == (want.stages, want.horizons), requests[r["i"]]
    assert set(HORIZONS) == {h for r in got for h in r["horizons"]}


@pytest.mark.parametrize(
    "name", ["s6_seed_purchases", "s7_seed_quarterly", "s8_universe", "s12_evidence", "s13_graph_tables", "k9_insert_absent", "m1_walk_forward", "m2_fitted_walk", "i3_block_length", "i7_holm", "g1_edges", "g2_causes", "g4_graph_counts", "g5_top_hypotheses", "b9_missing_books", "c1_c2_runs"]
)
def test_queries_read_the_tables(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).inputFiles()
