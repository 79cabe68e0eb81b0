"""The warehouse's tables: schemas, upserts, melts, clean-up and exports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each table, and the columns that name a row.
SCHEMAS = {
    "macro_daily": (
        "date date, symbol string, open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), volume decimal(20,2), source string, "
        "release_date date, vintage string, lag_assumed boolean, ingested_at timestamp_ntz, created_at timestamp_ntz",
        ("date", "symbol", "vintage"),
    ),
    "etf_flows": ("date date, ticker string, aum decimal(20,2), daily_flow decimal(18,4), weekly_flow decimal(18,4), flow_30d decimal(18,4), flow_60d decimal(18,4)", ("date", "ticker")),
    "central_bank_purchases": ("month date, country string, purchase_tonnes decimal(12,4), rolling_12m_tonnes decimal(14,4), yoy_growth_pct decimal(8,4)", ("month", "country")),
    "geopolitical_risk": (
        "date date, gpr_index double, conflict_intensity double, sanctions_score double, oil_disruption double, military_escalation double, shipping_disruption double, "
        "trade_restrictions double, election_uncertainty double, source string",
        ("date",),
    ),
    "miner_companies": ("ticker string, name string, tier string, exchange string, is_active boolean", ("ticker",)),
    "miner_quarterly": (
        "ticker string, quarter_end date, production_oz decimal(14,2), aisc_per_oz decimal(10,2), cash_millions decimal(14,2), debt_millions decimal(14,2), operating_cash_flow decimal(14,2), "
        "free_cash_flow decimal(14,2), reserve_life_years decimal(6,2), mine_locations string, political_risk_score double, management_guidance string, analyst_eps_revision double",
        ("ticker", "quarter_end"),
    ),
    "features_daily": ("date date, entity string, feature_name string, feature_value double", ("date", "entity", "feature_name")),
    "market_regimes": ("date date, regime_id int, regime_name string, confidence double, model_version string", ("date",)),
    "model_predictions": (
        "id long, date date, entity string, horizon_days int, model_version string, prob_outperform_gold double, prob_beat_gdx double, expected_return double, expected_alpha double, regime_id int",
        ("date", "entity", "horizon_days", "model_version"),
    ),
    "paper_accounts": ("horizon_days int, starting_cash double, cost_bps double, inception date, note string", ("horizon_days",)),
    "paper_positions": ("horizon_days int, symbol string, shares double, avg_cost double", ("horizon_days", "symbol")),
    "paper_orders": ("horizon_days int, seq int, date date, symbol string, side string, shares double, price double, dollars double, fee double, reason string", ("horizon_days", "seq")),
    "paper_nav": ("horizon_days int, date date, nav double, cash double, stance string, gold_budget double, benchmark_gold double, benchmark_spx double", ("horizon_days", "date")),
    "portfolio_recommendations": ("date date, rank int, ticker string, weight double, expected_alpha double, method string", ("date", "rank")),
}


def create(spark: SparkSession, root: str) -> None:
    """Every table that is not there yet, empty, under ``root``."""
    for name, (schema, _) in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with its declared schema, so no file is read to infer one."""
    return spark.read.schema(SCHEMAS[name][0]).parquet(f"{root}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order and type; missing ones are null, numbers become exact decimals."""
    types = dict(c.strip().split(" ", 1) for c in _columns(SCHEMAS[name][0]))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def _columns(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in schema:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new``: known keys take only the ``update`` columns, others come whole.

    Both sides have the same columns; ``new`` has one row per key.  One full
    outer join on the key.  Keys compare as equal when both are null.
    """
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = o.join(n, on, "full_outer")

    def value(c: str) -> Column:
        fresh = F.col("_n").isNotNull() & (F.col("_o").isNull() | F.lit(c in update))
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*[value(c) for c in old.columns])


#: What a repeated arrival may change, by table; the keys stand in ``SCHEMAS``.
UPDATES = {
    "etf_flows": ("aum", "daily_flow", "weekly_flow", "flow_30d", "flow_60d"),
    "central_bank_purchases": ("purchase_tonnes", "rolling_12m_tonnes", "yoy_growth_pct"),
    "miner_quarterly": (
        "production_oz", "aisc_per_oz", "cash_millions", "debt_millions", "operating_cash_flow", "free_cash_flow", "reserve_life_years", "mine_locations",
        "political_risk_score", "management_guidance", "analyst_eps_revision",
    ),
    "market_regimes": ("regime_id", "regime_name", "confidence", "model_version"),
    "model_predictions": ("prob_outperform_gold", "prob_beat_gdx", "expected_return", "expected_alpha"),
}


def sink(stored: DataFrame, arrived: DataFrame, name: str) -> DataFrame:
    """The table ``name`` after rows arrived: known keys take what may change, other rows come whole."""
    return upsert(conform(stored, name), conform(arrived, name), SCHEMAS[name][1], UPDATES[name])


def write_table(df: DataFrame, root: str, name: str, partition: str | None = None) -> None:
    """Replaces a table, or with ``partition`` only the parts that ``df`` has."""
    w = conform(df, name).write.mode("overwrite")
    if partition:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    w.parquet(f"{root}/{name}")


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def without(rows: DataFrame, key: str, values: Sequence | None) -> DataFrame:
    """``rows`` less those of the key values given; None removes all."""
    return rows.limit(0) if values is None else rows.where(~F.coalesce(F.col(key).isin(*values), F.lit(False)) if values else F.lit(True))


def derived_real_yields(macro: DataFrame, anchor: float = 2.25) -> DataFrame:
    """Real yields as nominal less an anchor, from first vintages, only where no real yield is stored.

    A row released on an unknown date counts as released the next day.
    """
    stored = macro.where("symbol = 'US10Y_REAL'").limit(1).select(F.lit(1).alias("_any"))
    nominal = macro.where("symbol = 'US10Y' and vintage = 'initial'").withColumn("_any", F.lit(1)).join(F.broadcast(stored), "_any", "left_anti").drop("_any")
    return nominal.withColumns({
        "symbol": F.lit("US10Y_REAL"), "close": F.round(F.col("close") - F.lit(anchor).cast("decimal(18,6)"), 4).cast("decimal(18,6)"), "source": F.lit("derived"),
        "release_date": F.coalesce("release_date", F.date_add("date", 1)),
    })


def risk_record(scores: DataFrame, components: Sequence[str]) -> DataFrame:
    """A risk row: without an index of its own it has the mean of its components, missing ones being 0."""
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in components]
    mean = sum(parts[1:], parts[0]) / len(parts)
    return scores.select("date", F.coalesce("gpr_index", mean).alias("gpr_index"), *[p.alias(c) for p, c in zip(parts, components)], F.coalesce("source", F.lit("composite")).alias("source"))


def melt(wide: DataFrame, at: str = "date", entity: str = "MACRO") -> DataFrame:
    """Features as rows: the first part of a column's name is its entity, the last its feature; only finite values.

    A name without an entity belongs to ``entity``.
    """
    names = [c for c in wide.columns if c != at]
    long = wide.select(at, *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot([at], [F.col(f"`{c}`") for c in names], "name", "feature_value")
    long = long.where("feature_value is not null and not isnan(feature_value)").where(F.abs("feature_value") < F.lit(float("inf")))
    own = F.when(F.contains("name", F.lit("__")), F.element_at(F.split("name", "__"), 1)).otherwise(F.lit(entity))
    return long.select(at, own.alias("entity"), F.element_at(F.split("name", "__"), -1).alias("feature_name"), "feature_value")


def matrix(features: DataFrame, names: Sequence[str] | None = None, at: str = "date") -> DataFrame:
    """Stored features as one row per date, columns ``entity__feature``.

    Without ``names`` the distinct names are read first; they are a schema,
    and few.
    """
    keyed = features.select(at, F.concat_ws("__", "entity", "feature_name").alias("name"), "feature_value")
    if names is None:
        names = [r["name"] for r in keyed.select("name").distinct().orderBy("name").collect()]
    return keyed.groupBy(at).pivot("name", list(names)).agg(F.max("feature_value"))


def last_buy_cost(positions: DataFrame, orders: DataFrame, navs: DataFrame) -> DataFrame:
    """Positions with the price of each symbol's last purchase; without one, the last net value."""
    last = orders.where("side = 'buy'").groupBy("horizon_days", "symbol").agg(F.max_by("price", "seq").alias("_p"))
    nav = navs.groupBy("horizon_days").agg(F.max_by("nav", "date").alias("_v"))
    got = positions.join(last, ["horizon_days", "symbol"], "left").join(F.broadcast(nav), "horizon_days", "left")
    return got.select("horizon_days", "symbol", "shares", F.coalesce("_p", "_v").alias("avg_cost"))


def export_csv(df: DataFrame, path: str) -> None:
    """Files with a header; only fields that need quotes have them."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as the lines that :func:`export_csv` writes."""
    return df.select(F.to_csv(F.struct(*df.columns), {"quoteAll": "false", "escape": '"'}).alias("line"))


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON texts; numbers that JSON lacks become null."""
    kinds = dict(df.dtypes)
    clean = [F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    return df.select(*clean).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def backfill_release(macro: DataFrame, lag: int = 1) -> DataFrame:
    """Rows from before release dates were kept: known the day after, as assumed first vintages."""
    return macro.withColumns({
        "lag_assumed": F.coalesce("lag_assumed", F.col("release_date").isNull()), "release_date": F.coalesce("release_date", F.date_add("date", lag)), "vintage": F.coalesce("vintage", F.lit("initial")),
    })


def lookback(rows: DataFrame, days: int, as_of: date, at: str = "date") -> DataFrame:
    """Rows of the last ``days`` calendar days to ``as_of``, which is always given."""
    return rows.where(F.col(at).between(F.date_sub(F.lit(as_of), days), F.lit(as_of)))
