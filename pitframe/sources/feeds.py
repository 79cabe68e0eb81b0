"""Vendor feeds as files: bars, rates with revisions, share counts, research evidence.

Downloading is left to whatever lands the files; what the readers do with them
is here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitframe.operators.asof import vintages_of
from pitframe.operators.windows import Series
from pitframe.sources.seeds import PUBLICATION_LAG

BARS = "date date, open double, high double, low double, close double, volume double"
REVISIONS = "date date, value double, realtime_start date"


def bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Daily bars from CSV files, names lower-cased with underscores."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.withColumnsRenamed({c: c.strip().lower().replace(" ", "_") for c in raw.columns})
    kinds = dict(c.split() for c in BARS.split(", "))
    return named.select(F.lit(symbol).alias("symbol"), *[F.col(c).try_cast(t).alias(c) for c, t in kinds.items() if c in named.columns])


def revisions(spark: SparkSession, path: str, series: str, lags: Mapping[str, int] = PUBLICATION_LAG) -> DataFrame:
    """Revision files of a rates series, a row per vintage."""
    raw = spark.read.schema(REVISIONS).option("header", True).csv(path)
    return vintages_of(raw.where("value is not null"), "date", "value", "realtime_start", F.lit(series), lags)


def preferred(first: DataFrame, second: DataFrame, symbol: str) -> DataFrame:
    """Rows of the symbol from the first source, or from the second where the first has none."""
    have = first.where(F.col("symbol") == symbol)
    mark = have.limit(1).select(F.lit(symbol).alias("symbol"))
    return have.unionByName(second.where(F.col("symbol") == symbol).join(F.broadcast(mark), "symbol", "left_anti"), allowMissingColumns=True)


def keep_last(rows: DataFrame, arrival: str, keys=("date", "symbol", "vintage")) -> DataFrame:
    """One row per key, the last to arrive."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(arrival))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def latest_prices(prices: DataFrame) -> DataFrame:
    return prices.where("close is not null").groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


def estimated_flows(prices: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Fund flows from price changes: scaled by shares outstanding where they are known, else by volume."""
    s = Series()
    r = prices.withColumn("_r", s.change(F.col("close"), 1)).withColumn("_m", F.avg("close").over(Window.partitionBy("symbol")))
    r = r.withColumn("shares", F.lit(None).cast("double")) if shares is None else r.join(shares.select("symbol", F.col("shares").cast("double")), "symbol", "left")
    by_shares = F.coalesce("_r", F.lit(0.0)) * F.col("shares") * F.col("_m") / 1e9
    by_volume = F.col("_r") * F.col("volume") * F.col("close") / 1e6
    aum = F.col("close") * F.coalesce("shares", F.lit(1e8)) / 1e9
    return r.select("date", F.col("symbol").alias("ticker"), F.when(F.col("shares").isNotNull(), by_shares).otherwise(by_volume).alias("daily_flow"), aum.alias("aum"))


EVIDENCE = (
    "generated string, studies array<struct<name: string, entity: string, benchmark: string, n_oos: int, auc: double, accuracy: double, "
    "books: map<string, struct<final_wealth: double, total_return: double, max_drawdown: double, hit_rate: double>>>>"
)


def evidence(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Studies and their books from JSON documents of research results."""
    parsed = texts.select(F.from_json(column, EVIDENCE).alias("e")).select(F.col("e.generated").alias("generated"), F.explode("e.studies").alias("s"))
    studies = parsed.select("generated", "s.name", "s.entity", "s.benchmark", "s.n_oos", "s.auc", "s.accuracy")
    books = parsed.select(F.col("s.name").alias("study"), F.explode("s.books").alias("book", "b")).select("study", "book", "b.*")
    return studies, books
