"""Structured Streaming forms: arriving vintages, idempotent upserts, carried books."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pitframe.operators.paper import STARTING_CASH, Account
from pitframe.sources.artifacts import exists, remove
from pitframe.sources.warehouse import upsert


def latest_stream(vintages: DataFrame, keys: Sequence[str], release_ts: str, value: str) -> DataFrame:
    """The running latest vintage of each key; use it in update or complete mode.

    State is one row per key, whatever number of vintages arrives.
    """
    last = F.max(F.struct(release_ts, value)).alias("m")
    return vintages.groupBy(*keys).agg(last).select(*keys, F.col(f"m.{release_ts}").alias(release_ts), F.col(f"m.{value}").alias(value))


def without_repeats(vintages: DataFrame, keys: Sequence[str], release_ts: str, late: str = "30 days") -> DataFrame:
    """Arriving rows less those seen before; keys are forgotten once the watermark has passed them."""
    return vintages.withWatermark(release_ts, late).dropDuplicatesWithinWatermark(list(keys))


def daily_counts(vintages: DataFrame, release_ts: str, key: str, late: str = "2 days") -> DataFrame:
    """Vintages per key and day of release, late ones within the watermark included."""
    return vintages.withWatermark(release_ts, late).groupBy(F.window(release_ts, "1 day").alias("day"), key).agg(F.count("*").alias("n"))


_LEDGER = "batch long, state string, parts long, rows long"


def merge_batch(batch: DataFrame, batch_id: int, path: str, part: str, keys: Sequence[str], update: Sequence[str], order: str) -> bool:
    """Merges a batch into the parts of the table at ``path`` that it touches; False, and nothing changes, if it was merged before.

    The table is partitioned by ``part``, a column of the rows that each key
    keeps for good.  Of a key's rows the last by ``order`` counts; known keys
    take the ``update`` columns only.  The merged parts are written beside the
    table first, then put in place of the old ones, and both steps are noted
    in a ledger: a batch that failed on the way goes on from the step that it
    had reached, and finds the merged parts even where the old ones are gone.
    The driver gathers the names of the parts touched; a null part is one.
    """
    spark = batch.sparkSession
    ledger, staged = f"{path}/_ledger", f"{path}/_staged/batch={batch_id}"

    def note(state: str, parts: int, rows: int) -> None:
        spark.createDataFrame([(batch_id, state, parts, rows)], _LEDGER).coalesce(1).write.mode("append").parquet(ledger)

    known = spark.read.schema(_LEDGER).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], _LEDGER)
    states = {r["state"]: r for r in known.where(F.col("batch") == batch_id).collect()}
    if "merged" in states:
        return False
    if "staged" not in states:
        last = F.max(F.struct(order, *[c for c in batch.columns if c not in (*keys, order)])).alias("m")
        new = batch.groupBy(*keys).agg(last).select(*keys, "m.*").select(*batch.columns)
        touched = [r[0] for r in new.select(part).distinct().collect()]
        if exists(spark, path) and known.where("state = 'merged'").limit(1).count():
            hit = F.col(part).isin([t for t in touched if t is not None])
            hit = hit | F.col(part).isNull() if None in touched else hit
            new = upsert(spark.read.schema(batch.schema).parquet(path).where(hit), new, keys, update)
        new.write.mode("overwrite").parquet(staged)
        note("staged", len(touched), spark.read.parquet(staged).count())
    merged = spark.read.schema(batch.schema).parquet(staged)
    merged.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    done = states.get("staged") or spark.read.schema(_LEDGER).parquet(ledger).where((F.col("batch") == batch_id) & (F.col("state") == "staged")).first()
    note("merged", done["parts"], done["rows"])
    remove(spark, staged)
    return True


def upsert_stream(rows: DataFrame, path: str, part: str, keys: Sequence[str], update: Sequence[str], order: str, checkpoint: str, name: str = "upserts") -> StreamingQuery:
    """Applies each micro-batch to a Parquet table by :func:`merge_batch`: what is written follows the batch and not the table."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, path, part, keys, update, order)

    return rows.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()


class Books(StatefulProcessor):
    """Accounts by horizon, a day at a time in the order of days.

    A day waits until the watermark has passed it, so one that arrives late,
    but within the watermark, is traded in its place.  State: the account's
    numbers, its shares by symbol, and the days that wait.
    """

    def __init__(self, bench: str, starting_cash: float) -> None:
        self.bench, self.starting_cash = bench, starting_cash

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", "cash double, since int, stance string, budget double")
        self.shares = handle.getMapState("shares", "symbol string", "shares double")
        self.waiting = handle.getMapState("waiting", "day long", "row string")

    def _account(self, key: tuple) -> Account:
        account = Account(int(key[0]), self.bench, self.starting_cash)
        if self.book.exists():
            cash, since, stance, budget = self.book.get()
            account.cash, account.since, account.stance, account.budget = cash, None if since is None else int(since), stance, budget
            account.shares = {k[0]: v[0] for k, v in self.shares.iterator()}
        return account

    def _keep(self, account: Account) -> None:
        self.book.update((account.cash, account.since, account.stance, account.budget))
        for symbol, n in account.shares.items():
            self.shares.updateValue((symbol,), (n,))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self._keep(Account(int(key[0]), self.bench, float(row["cash"]), shares=json.loads(row["shares"] or "{}"), since=None if pd.isna(row["since"]) else int(row["since"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for day, row in zip(part["at"], part["row"]):
                at = int(pd.Timestamp(day).value // 1_000_000)
                if at > passed:  # what is later than the watermark allows is not traded
                    self.waiting.updateValue((at,), (row,))
                    self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] <= upto)
        if not due:
            return
        account, out = self._account(key), []
        for at, text in due:
            row = json.loads(text)
            price = row.get("prices") or {}
            if account.begun or row.get("sleeve") is not None:
                account.day(price, row.get("sleeve"), row.get("stance"), row.get("gold_budget"))
                out.append((account.horizon, pd.Timestamp(at, unit="ms").date(), account.worth(price), account.cash))
            self.waiting.removeKey((at,))
        self._keep(account)
        yield pd.DataFrame(out, columns=["horizon_days", "date", "nav", "cash"])

    def close(self) -> None:
        pass


def carried_books(days: DataFrame, bench: str, late: str = "2 days", starting_cash: float = STARTING_CASH, books: DataFrame | None = None) -> DataFrame:
    """Accounts carried from batch to batch: ``horizon_days, date, nav, cash`` of each day once the watermark has passed it.

    ``days`` are as for the batch simulation: ``horizon_days, date, prices,
    stance, gold_budget, sleeve``, one row per horizon and day; of repeated
    ones the last to arrive counts.  ``books``, if given, are stored accounts
    to go on from: ``horizon_days, cash, since`` (days since the last trade)
    and ``shares`` (a map by symbol).  Needs the RocksDB state store, which
    :data:`STATE_STORE` sets.
    """
    at = F.col("date").cast("timestamp")
    rows = days.select("horizon_days", at.alias("at"), F.to_json(F.struct("prices", "stance", "gold_budget", "sleeve")).alias("row")).withWatermark("at", late)
    first = None if books is None else books.select("horizon_days", "cash", "since", F.to_json("shares").alias("shares")).groupBy("horizon_days")
    return rows.groupBy("horizon_days").transformWithStateInPandas(Books(bench, starting_cash), "horizon_days int, date date, nav double, cash double", "append", "eventTime", first)


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
