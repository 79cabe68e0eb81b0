"""Streams agree with batch, and a batch that runs twice changes nothing."""

from __future__ import annotations

from datetime import date, timedelta
from pathlib import Path

import pytest

from pitframe.operators import paper
from pitframe.streaming import vintages as sv


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def parts_of(root: str) -> dict[str, list[tuple]]:
    """Files of each part, with the time and size of each."""
    return {p.name: sorted((f.name, f.stat().st_mtime_ns, f.stat().st_size) for f in p.glob("*.parquet")) for p in Path(root).glob("month=*")}


def test_upsert_stream(spark, tmp_path):
    schema = "month int, k int, x double, y double, seq int"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        sv.upsert_stream(stream(spark, src, schema), out, "month", ["month", "k"], ["x", "seq"], "seq", str(tmp_path / "c")).awaitTermination()
        return sorted((tuple(r) for r in spark.read.schema(schema).parquet(out).select("month", "k", "x", "y").collect()), key=str)

    spark.createDataFrame([(m, k, 1.0 * k, 0.5, k) for m in (1, 2, 3, None) for k in range(50)], schema).coalesce(1).write.parquet(src)
    first = run()
    assert len(first) == 200
    before = parts_of(out)
    spark.createDataFrame([(2, 5, 50.0, 9.9, 60), (2, 99, 3.0, 1.0, 61), (2, 99, 4.0, 1.0, 62), (4, 1, 7.0, None, 63)], schema).coalesce(1).write.mode("append").parquet(src)
    second, after = run(), parts_of(out)
    want = {r[:2]: r for r in first} | {(2, 5): (2, 5, 50.0, 0.5), (2, 99): (2, 99, 4.0, 1.0), (4, 1): (4, 1, 7.0, None)}
    assert second == sorted(want.values(), key=str)
    assert {m for m in before if before[m] == after[m]} == {"month=1", "month=3", "month=__HIVE_DEFAULT_PARTITION__"}
    ledger = sorted(tuple(r) for r in spark.read.parquet(f"{out}/_ledger").collect())
    assert ledger == [(0, "merged", 4, 200), (0, "staged", 4, 200), (1, "merged", 2, 52), (1, "staged", 2, 52)]
    # Null parts are merged as well, and only they are written.
    assert sv.merge_batch(spark.createDataFrame([(None, 3, -1.0, 0.0, 70)], schema), 2, out, "month", ["month", "k"], ["x", "seq"], "seq")
    assert spark.read.schema(schema).parquet(out).where("month is null and k = 3").select("x", "y").collect() == [(-1.0, 0.5)]
    assert parts_of(out)["month=2"] == after["month=2"]


def test_a_batch_again_changes_nothing_and_a_broken_one_goes_on(spark, tmp_path, monkeypatch):
    schema, out = "month int, k int, x double, seq int", str(tmp_path / "out")
    merge = lambda rows, i: sv.merge_batch(spark.createDataFrame(rows, schema), i, out, "month", ["month", "k"], ["x"], "seq")
    read = lambda: sorted(tuple(r) for r in spark.read.schema(schema).parquet(out).select("month", "k", "x").collect())
    assert merge([(1, 1, 1.0, 1), (2, 1, 2.0, 1)], 0)
    files = parts_of(out)
    assert not merge([(1, 1, 8.0, 1)], 0) and parts_of(out) == files
    gone = sv.remove
    monkeypatch.setattr(sv, "remove", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        merge([(2, 1, 3.0, 2), (2, 2, 4.0, 2)], 1)
    monkeypatch.setattr(sv, "remove", gone)
    assert not merge([(2, 1, 3.0, 2), (2, 2, 4.0, 2)], 1)  # it had been merged
    # Lost after the merged parts were written, with an old part gone: the batch goes on from these.
    monkeypatch.setattr(sv, "remove", lambda *a: None)
    merge([(1, 2, 5.0, 3)], 2)
    monkeypatch.setattr(sv, "remove", gone)
    gone(spark, f"{out}/month=1")
    kept = spark.read.parquet(f"{out}/_ledger").where("not (batch = 2 and state = 'merged')").collect()
    spark.createDataFrame(kept, sv._LEDGER).write.mode("overwrite").parquet(f"{out}/_ledger")
    assert merge([(1, 2, 5.0, 3)], 2)
    assert read() == [(1, 1, 1.0), (1, 2, 5.0), (2, 1, 3.0), (2, 2, 4.0)]


def test_latest_stream(spark, tmp_path):
    schema = "date date, symbol string, release_ts timestamp, close double"
    src = str(tmp_path / "in")
    spark.sql("select date '2026-01-05' as date, 'A' as symbol, timestamp '2026-01-06 00:00:00' as release_ts, 4.2d as close").write.parquet(src)
    spark.sql("select date '2026-01-05' as date, 'A' as symbol, timestamp '2026-01-08 00:00:00' as release_ts, 4.25d as close").write.mode("append").parquet(src)
    latest = sv.latest_stream(stream(spark, src, schema), ["date", "symbol"], "release_ts", "close")
    latest.writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [r["close"] for r in spark.table("latest").collect()] == [4.25]
    once = sv.without_repeats(stream(spark, src, schema), ["date", "symbol"], "release_ts")
    once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 1
    daily = sv.daily_counts(stream(spark, src, schema), "release_ts", "symbol")
    daily.writeStream.format("memory").queryName("daily").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("daily").count() == 2


DAYS = "horizon_days int, date date, gold double, spx double, prices map<string,double>, stance string, gold_budget double, sleeve map<string,double>"


def market(n: int) -> list[tuple]:
    rows = []
    for h in (2, 5):
        for i in range(n):
            price = {"G": 10.0 + (i * 7) % 5, "M": 5.0 + (i * 3) % 4, "S": 20.0 + i % 3}
            sleeve = None if i == 0 or i % 7 == 3 else {"G": 0.5, "M": 0.5} if i % 2 else {"M": 1.0}
            rows.append((h, date(2026, 1, 1) + timedelta(days=i), price["G"], price["S"], price, "keep", 0.3 if i % 3 else 0.6, sleeve))
    return rows


def test_carried_books(spark, tmp_path):
    """Days that come out of order and in several runs give the batch's accounts."""
    spark.conf.set(*sv.STATE_STORE)
    try:
        rows, src = market(24), str(tmp_path / "in")
        want = {(r["horizon_days"], r["date"]): (round(r["nav"], 6), round(r["cash"], 6)) for r in paper.navs(paper.simulate(spark.createDataFrame(rows, DAYS), "S")).collect()}
        late = [r for r in rows if r[1].day == 9]
        chunks = [[r for r in rows if r[1].day <= 6], [r for r in rows if 6 < r[1].day <= 10 and r[1].day != 9], late, [r for r in rows if r[1].day > 10]]
        table = str(tmp_path / "navs")
        for chunk in chunks:  # each a run of its own, which goes on from the checkpoint
            spark.createDataFrame(chunk, DAYS).coalesce(1).write.mode("append").parquet(src)
            books = sv.carried_books(stream(spark, src, DAYS), "S")
            books.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        got = {(r["horizon_days"], r["date"]): (round(r["nav"], 6), round(r["cash"], 6)) for r in spark.read.parquet(table).collect()}
        assert got == {k: x for k, x in want.items() if k[1] <= date(2026, 1, 22)} and len(got) == 42  # two days wait for the watermark
        # From stored accounts: cash and shares go on.
        stored = spark.createDataFrame([(2, 500.0, 1, {"G": 3.0})], "horizon_days int, cash double, since int, shares map<string,double>")
        books = sv.carried_books(stream(spark, src, DAYS), "S", books=stored)
        books.writeStream.format("memory").queryName("went_on").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
        first = spark.table("went_on").where("horizon_days = 2").orderBy("date").first()
        assert (first["date"], first["nav"], first["cash"]) == (date(2026, 1, 1), 530.0, 500.0)
    finally:
        spark.conf.unset(sv.STATE_STORE[0])
