"""Forms that no single task holds agree with plain ones: scans, risk parity, Markov models, paths, progress, feeds."""

from __future__ import annotations

import itertools
import json
import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pitframe.operators import asof, graph, portfolio, regime, scans, stats, windows
from pitframe.pipeline import Run, Tracker, execute
from pitframe.progress import Counted, StreamProgress, watched
from pitframe.sources import vendor


def d(n: int) -> date:
    return date(2026, 1, 1) + timedelta(days=n)


def near(a, b) -> bool:
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_rank_shares_average_ties_across_slices(spark, slices):
    rnd = random.Random(slices)
    values = [None] * 4 + [rnd.choice([0.5, float(i)]) for i in range(60)] + [0.5] * 30
    got = {r["id"]: r["share"] for r in scans.rank_shares(spark.createDataFrame(list(enumerate(values)), "id int, x double"), "x", "share", slices).collect()}
    known = [x for x in values if x is not None]
    for i, x in enumerate(values):
        assert near(got[i], None if x is None else (sum(y < x for y in known) + (known.count(x) + 1) / 2) / len(known))
    assert scans.rank_shares(spark.createDataFrame([], "id int, x double"), "x", "share").count() == 0


@pytest.mark.parametrize("slices", [1, 4, 40])
def test_sums_before_with_and_without_groups(spark, slices):
    rnd = random.Random(slices)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([None, *range(5)])) for i in rnd.sample(range(1000), 80)] + [("a", None, 7)]
    df = spark.createDataFrame(rows, "g string, t int, v int")
    before = lambda r, all_rows: sum(q[2] or 0 for q in all_rows if (q[1] is not None, q[1] or 0) < (r[1] is not None, r[1] or 0))
    got = {(r["g"], r["t"]): r["s"] for r in scans.sums_before(df, ["g"], ["t"], {"s": "v"}, slices).collect()}
    assert got == {r[:2]: before(r, [q for q in rows if q[0] == r[0]]) for r in rows}
    got = {(r["g"], r["t"]): r["s"] for r in scans.sums_before(df, [], ["t"], {"s": "v"}, slices).collect()}
    assert got == {r[:2]: before(r, rows) for r in rows}
    ranks = {(r["g"], r["t"]): r["rank"] for r in scans.row_ranks(df, ["t"], "rank", slices).collect()}
    assert sorted(ranks.values()) == list(range(1, 82)) and ranks["a", None] == 1


def test_auc_of_all_rows_and_of_groups(spark):
    rnd = random.Random(5)
    rows = [(i % 3, rnd.randrange(2), rnd.choice([0.1, 0.2, 0.5, rnd.random()])) for i in range(300)] + [(0, None, 0.4), (1, 1, None)]
    df = spark.createDataFrame(rows, "g int, y int, p double")

    def plain(part):
        pos, neg = ([p for _, y, p in part if y == k and p is not None] for k in (1, 0))
        return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))

    assert near(stats.auc(df, "y", "p").first()["auc"], plain(rows))
    for r in stats.auc(df, "y", "p", ["g"]).collect():
        assert near(r["auc"], plain([x for x in rows if x[0] == r["g"]]))


@pytest.mark.parametrize("every", [None, "month", "day"])
@pytest.mark.parametrize("keyed", [True, False])
def test_backward_reads_by_slices(spark, every, keyed):
    rnd = random.Random(3)
    key = lambda: rnd.choice(["a", "b", None]) if keyed else "k"
    left = sorted({(key(), rnd.randrange(200)) for _ in range(60)}, key=str)
    right = {(key(), rnd.randrange(30, 200)): rnd.choice([None, rnd.random()]) for _ in range(40)}
    other = {(key(), rnd.randrange(200)): {"x": rnd.randrange(9)} for _ in range(15)}
    ldf = spark.createDataFrame([(k, d(t)) for k, t in left], "k string, day date")
    rdf = spark.createDataFrame([(k, d(t), x) for (k, t), x in right.items()], "k string, at date, x double")
    odf = spark.createDataFrame([(k, d(t), x) for (k, t), x in other.items()], "k string, at date, m map<string,int>")
    by = ["k"] if keyed else []
    got = asof.asof_many(ldf, "day", [(rdf, "at", ["x"]), (odf, "at", ["m"])], by, every).collect()
    assert len(got) == len(left)
    last = lambda table, k, t: max(((s, x) for (q, s), x in table.items() if q == k and s <= t and x is not None), default=(0, None), key=lambda p: p[0])[1]
    for r in got:
        t = (r["day"] - d(0)).days
        assert (r["x"], r["m"]) == (last(right, r["k"], t), last(other, r["k"], t))


def test_many_times_are_joined_by_stretches(spark, monkeypatch):
    spans = spark.createDataFrame([("a", d(0), d(40)), ("b", d(40), None), ("c", d(5), d(6)), ("e", d(900), None)], "v string, valid_from date, valid_to date")
    times = spark.createDataFrame([(d(i),) for i in range(0, 120, 3)] + [(None,)], "as_of date")
    few = sorted((r["v"], r["as_of"]) for r in asof.history_at(spans, times, "as_of").collect())
    monkeypatch.setattr(asof, "FEW_TIMES", 5)
    for width in (1, 7, 500):
        assert sorted((r["v"], r["as_of"]) for r in asof.history_at(spans, times, "as_of", width).collect()) == few
    assert few == sorted([("a", d(i)) for i in range(0, 40, 3)] + [("b", d(i)) for i in range(42, 120, 3)])


@pytest.mark.parametrize("every", ["day", "week", "year"])
def test_oscillators_do_not_depend_on_slices(spark, every):
    rnd = random.Random(1)
    x, rows = 50.0, []
    for i in range(90):
        x *= 1 + rnd.uniform(-0.03, 0.03)
        rows.append(("s", d(i), x if i % 11 else None))
    rows += [("one", d(0), 5.0), (None, d(3), 1.0), (None, d(4), 2.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    got = {(r["symbol"], r["date"]): r for r in windows.oscillators(df, ["symbol"], "date", "close", every=every).collect()}
    v = [(t, c) for s, t, c in rows if s == "s" and c is not None]
    up = down = rng = fast = slow = line = None
    assert len(got) == len(v) + 3 and got["one", d(0)]["rsi"] is None
    for k, (t, c) in enumerate(v):
        step = lambda old, new, a: new if old is None else old * (1 - a) + new * a
        if k:
            change = c - v[k - 1][1]
            up, down, rng = step(up, max(change, 0), 1 / 14), step(down, max(-change, 0), 1 / 14), step(rng, abs(change), 1 / 14)
        fast, slow = step(fast, c, 2 / 13), step(slow, c, 2 / 27)
        line = step(line, fast - slow, 2 / 10) if k >= 25 else None
        r = got["s", t]
        assert near(r["rsi"], 1 - 1 / (1 + up / down) if k >= 14 else None) and near(r["atr"], rng / c if k >= 14 else None)
        assert near(r["macd_diff"], (fast - slow - line) / c if k >= 33 else None)


def test_covariance_with_gaps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5)) * 0.01 + 1e4
    gone = rng.random(x.shape) < 0.3
    rows = [(d(t), f"s{i}", None if i == 4 and t > 3 else float("nan") if gone[t, i] else float(x[t, i])) for t in range(40) for i in range(5)]
    got = {(r["a"], r["b"]): r for r in stats.covariance(spark.createDataFrame(rows, "t date, s string, x double").repartition(7), "t", "s", "x").collect()}
    for i, j in itertools.product(range(5), repeat=2):
        both = [(a, b) for (_, s, a), (_, q, b) in ((rows[5 * t + i], rows[5 * t + j]) for t in range(40)) if None not in (a, b) and not (math.isnan(a) or math.isnan(b))]
        if not both:
            assert (f"s{i}", f"s{j}") not in got
            continue
        r = got[f"s{i}", f"s{j}"]
        assert r["n"] == len(both)
        want = np.cov(np.array(both).T)[0, 1] if len(both) > 1 else None
        assert r["cov"] is None if want is None else math.isclose(r["cov"], want, rel_tol=1e-6, abs_tol=1e-12)


@pytest.mark.parametrize(("n", "rows"), [(1, 30), (2, 30), (7, 60), (60, 200)])
def test_tree_parity_agrees_with_the_matrix(spark, n, rows):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(rows, n)) @ rng.normal(size=(n, n))
    df = spark.createDataFrame([(t, f"s{i:03d}", float(x[t, i])) for t in range(rows) for i in range(n)], "date int, symbol string, ret double")
    got = {r["symbol"]: (r["weight"], r["place"]) for r in portfolio.hierarchical_weights(df).collect()}
    if n == 1:
        assert got == {"s000": (1.0, 0)}
        return
    cov = np.cov(x, rowvar=False)
    sd = np.sqrt(np.diag(cov))
    order = portfolio._cluster_order(np.sqrt((1 - np.clip(cov / np.outer(sd, sd), -1, 1)) / 2))
    assert [got[f"s{i:03d}"][1] for i in order] == list(range(n))
    assert np.allclose([got[f"s{i:03d}"][0] for i in range(n)], portfolio.hierarchical_parity(cov), atol=1e-12)
    assert portfolio.hierarchical_weights(df.limit(0)).count() == 0


def brute_hidden(model: regime.Hidden, x: np.ndarray):
    """Likelihood, posteriors and likeliest path by going through all paths."""
    log, k = model.emissions(x)[:, 0], model.mean.shape[1]
    total, post, best = 0.0, np.zeros(log.shape), (-np.inf, None)
    for path in itertools.product(range(k), repeat=len(x)):
        p = model.start[0, path[0]] * np.prod([model.move[0, a, b] for a, b in zip(path, path[1:])]) * np.exp(sum(log[t, s] for t, s in enumerate(path)))
        total += p
        for t, s in enumerate(path):
            post[t, s] += p
        best = max(best, (p, path))
    return np.log(total), post / total, best[1]


def test_hidden_markov_models_agree_with_all_paths():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (4, 2)), rng.normal(3, 0.5, (3, 2))])
    model, course = regime.fit_hidden(x, states=3, rounds=5, starts=2)
    like, post, path = brute_hidden(model, x)
    own, _, found = model.forward_backward(x)
    assert np.allclose(found[0], like) and np.allclose(own[:, 0], post) and model.path(x).tolist() == list(path)


def test_likelihood_never_falls_over_all_rounds():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(m, s, (60, 3)) for m, s in ((0, 1), (4, 0.5), (0, 1), (-3, 2))])
    _, course = regime.fit_hidden(x, states=4, rounds=200, starts=3)
    assert len(course) > 5 and all((b >= a - 1e-6).all() for a, b in zip(course, course[1:]))


def test_one_model_of_all_markets(spark):
    rng = np.random.default_rng(6)
    rows = []
    for m in range(4):
        at, level = 0, 0
        for i in range(150 if m < 3 else 50):
            at = at if rng.random() < 0.95 else 1 - at
            level = (0.0, 5.0)[at]
            rows.append((f"m{m}", d(i), float(rng.normal(level, 0.5)), float(rng.normal(-level, 0.5)), at))
    df = spark.createDataFrame(rows, "market string, date date, a double, b double, truth int")
    got = regime.detect_pooled(df, ["a", "b"], states=2, rounds=30, starts=2).collect()
    truth = {(r[0], r[1]): r[4] for r in rows}
    assert len(got) == 450 and {r["market"] for r in got} == {"m0", "m1", "m2"}
    same = np.mean([r["state"] == truth[r["market"], r["date"]] for r in got])
    assert max(same, 1 - same) > 0.97  # one numbering for all markets
    assert all(0.4 <= r["confidence"] <= 1.0 + 1e-9 for r in got)
    assert regime.detect_pooled(df.limit(0), ["a", "b"]).count() == 0


@pytest.mark.parametrize("cutoff", [1, 2, 3, 6])
def test_paths_meet_in_the_middle(spark, cutoff):
    rnd = random.Random(cutoff)
    pairs = [(rnd.choice("abcdefgh"), rnd.choice("abcdefgh")) for _ in range(22)] + [("a", None), (None, "b")]
    edges = spark.createDataFrame(pairs + pairs[:3], "source string, target string")
    known = {p for p in pairs if None not in p}

    def walk(path):
        for a, b in known:
            if a == path[-1] and b not in path and len(path) <= cutoff:
                yield (*path, b)
                yield from walk((*path, b))

    every = sorted(walk(("a",)))
    starts = spark.createDataFrame([("a",), ("nowhere",), (None,)], "start string")
    got = sorted(tuple(r["path"]) for r in graph.simple_paths(edges, starts, cutoff=cutoff).collect())
    assert got == every
    for end in "bh":
        got = graph.simple_paths(edges, starts, end, cutoff).collect()
        assert sorted(tuple(r["path"]) for r in got) == [p for p in every if p[-1] == end]
        assert all(r["edges"] == len(r["path"]) - 1 and r["start"] == "a" and r["end"] == end for r in got)


def test_progress_comes_from_the_work_itself(spark, tmp_path):
    said = []
    tracker, before = Tracker(), spark.sparkContext.statusTracker()

    def features(run, report):
        counted = Counted(spark.range(0, 1000, 1, 8), "rows", highest=F.max("id"))
        with watched(spark, lambda current, total: (said.append((current, total)), report(current, total)), every_s=0.05):
            spark.sparkContext.setLocalProperty("spark.job.description", "features")
            counted.df.write.parquet(str(tmp_path / "out"))
        return counted.report(report)

    got = execute(Run(stages=("features",)), {"features": features}, tracker)
    assert got == {"features": {"rows": 1000, "highest": 999}}
    assert said[-1] == (8, 8)  # the one job's tasks: counting took none
    assert before.getJobIdsForGroup("no such group") == [] and tracker.snapshot()["status"] == "finished"
    assert any("rows 1000" in line for line in tracker.snapshot()["log"])


def test_streams_report_their_batches(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(10)], "k int").repartition(2).write.parquet(str(tmp_path / "in"))
    said, listener = [], None
    listener = StreamProgress(lambda current, total, message: said.append((current, message)))
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema("k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        rows.observe("seen", F.count(F.lit(1)).alias("n")).writeStream.format("noop").queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if any("ends" in m for _, m in said):
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.rows == 10 and [c for c, m in said if "batch" in m][-1] >= 2 and any("n 5" in m for _, m in said)


def test_vendor_feed(spark, tmp_path):
    vendor.register(spark)

    def land(symbol, day, *observations):
        (tmp_path / "feed" / symbol).mkdir(parents=True, exist_ok=True)
        (tmp_path / "feed" / symbol / f"{day}.json").write_text(json.dumps({"observations": [dict(zip(("date", "value", "realtime_start"), o)) for o in observations]}))

    read = lambda **o: spark.read.format("vendor_feed").options(path=str(tmp_path / "feed"), lags='{"CPI": 45}', **o).load()
    known: set = set()

    def run():
        rows = spark.readStream.format("vendor_feed").options(path=str(tmp_path / "feed"), lags='{"CPI": 45}').load()
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    land("US10Y", "2026-01-05", ("2026-01-02", "4.1", "2026-01-05"), ("2026-01-03", ".", "2026-01-05"), ("bad", "1", None))
    land("CPI", "2026-01-05", ("2025-11-01", "300.5"))
    assert read().rdd.getNumPartitions() == 2
    first = run().collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, read().collect()))
    assert {(r["symbol"], r["release_date"], r["vintage"], r["lag_assumed"]) for r in first} == {("US10Y", date(2026, 1, 5), "2026-01-05", False), ("CPI", date(2025, 12, 16), "initial", True)}
    land("US10Y", "2026-01-08", ("2026-01-02", "4.1", "2026-01-05"), ("2026-01-02", "4.15", "2026-01-08"), ("2026-01-06", "4.2", "2026-01-07"))
    land("CPI", "2026-01-08", ("2025-11-01", "300.5"), ("2025-12-01", "301.0"))
    second = run()
    assert second.where("symbol = 'US10Y'").count() == 3  # each release once
    assert {tuple(r) for r in second.distinct().collect()} == {tuple(r) for r in read().distinct().collect()} and known == set()
    assert read(symbols="CPI").select("symbol").distinct().collect() == [Row(symbol="CPI")]


def test_pooled_statistics_are_those_of_each_market():
    rng = np.random.default_rng(8)
    found = [rng.normal(i % 2, 1, (n, 3)) for i, n in enumerate((120, 1, 2, 300, 120))]
    model = regime.Hidden.begun(np.vstack(found), 4, 3, 42)
    for _ in range(4):
        total = model.statistics_of_all(found)
        assert np.allclose(total, sum(model.statistics(x) for x in found), rtol=1e-9, atol=1e-9)
        model, _ = model.updated(total)


def test_pooled_states_read_their_rows_once(spark):
    rng, met = np.random.default_rng(9), spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(f"m{m}", d(i), float(rng.normal(i // 60 % 2 * 4, 1))) for m in range(2) for i in range(120)], "market string, date date, a double")

    def counted(parts):
        for part in parts:
            met.add(len(part))
            yield part

    got = regime.detect_pooled(df.mapInPandas(counted, df.schema), ["a"], states=2, rounds=5, starts=2).collect()
    assert len(got) == met.value == 240
