"""Binding views: the driver's tables in the shape of the warehouse's.

Each view is a DataFrame function and a text of the same meaning, ``SQL``, for
the oracle's ``WITH`` clause.  Operators take column names; only the plans
know these views.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitframe.operators.asof import latest_vintage

AS_OF = date(1998, 6, 30)
HORIZONS = (5, 10, 20, 63, 126)
#: What makes the order of vintages total.
VINTAGE_ORDER = ("release_date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "close")
GOLD, BENCHMARK = "ECONOMY", "STANDARD"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal observations: several vintages for a date and symbol."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("symbol"))
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "date", "symbol", (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.col("l_quantity").alias("volume"),
            F.date_add("date", F.col("l_linenumber").cast("int")).alias("release_date"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        )
    )


def prices(spark: SparkSession, sf_dir: str, as_of: date | None = AS_OF) -> DataFrame:
    """One row for a date and symbol: the latest vintage known at ``as_of``."""
    return latest_vintage(obs(spark, sf_dir), ["date", "symbol"], VINTAGE_ORDER, ["close", "volume", "release_date"], "release_date", as_of)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("ticker"))
        .agg(F.sum("value").alias("daily_flow"), F.count("*").alias("n"))
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("month", "country").agg(F.sum("o_totalprice").alias("purchase"))
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return labels.join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), ((F.col("n_chars") * 37) % 1000 / 1000.0).cast("double").alias("p"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    region = n.join(r, "n_regionkey").select(F.col("r_name").alias("source"), F.col("n_name").alias("target"))
    supplier = s.join(n, "n_nationkey").select(F.col("n_name").alias("source"), F.col("s_name").alias("target"))
    return region.unionByName(supplier)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per date, entity and horizon in several versions, from ``events``."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("date"), F.col("event_type").alias("entity"))
    h = F.element_at(F.array(*map(F.lit, HORIZONS)), (F.col("user_id") % 5 + 1).cast("int"))
    version = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("asof_h"), "horizon_days")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("lgbm_h"), "horizon_days"))
    return e.withColumn("horizon_days", h).select(
        F.col("event_id").alias("id"), "date", "entity", "horizon_days", version.alias("model_version"),
        (F.col("event_id") * 13 % 1000 / 1000.0).cast("double").alias("prob"), ((F.col("event_id") * 7 % 201 - 100) / 1000.0).cast("double").alias("expected_alpha"),
        ((F.col("event_id") * 11 % 301 - 150) / 1000.0).cast("double").alias("expected_return"),
    )


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state for every third day with orders."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    day = F.datediff("date", F.lit(date(1970, 1, 1)))
    return d.where(day % 3 == 0).select("date", (F.pmod(F.floor(day / 9), F.lit(4)) + 1).cast("int").alias("regime_id"), ((day % 50) / 100.0 + 0.5).cast("double").alias("confidence"))


_DAY = "datediff('day', date '1970-01-01', cast(o_orderdate as date))"
SQL: dict[str, str] = {
    "obs": """obs as (select cast(o_orderdate as date) as date, p_type as symbol, l_extendedprice / l_quantity as close, l_quantity as volume,
  cast(o_orderdate as date) + cast(l_linenumber as integer) as release_date, l_orderkey, l_linenumber, l_partkey, l_suppkey
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)""",
    "prices": f"""prices as (select date, symbol, close, volume, release_date from (select *, row_number() over (partition by date, symbol order by
  release_date desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, close desc) as rn
  from obs where release_date <= date '{AS_OF}') where rn = 1)""",
    "flows": """flows as (select cast(ts as date) as date, event_type as ticker, sum(value) as daily_flow, count(*) as n from events group by 1, 2)""",
    "monthly": """monthly as (select cast(date_trunc('month', o_orderdate) as date) as month, n_name as country, sum(o_totalprice) as purchase
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)""",
    "scores": """scores as (select doc_id as id, quality as y, cast(((n_chars * 37) % 1000) / 1000.0 as double) as p from labels join documents using (doc_id))""",
    "vectors": """vectors as (select vec_id, label, i - 1 as feature, cast(embedding[i] as double) as value from embeddings, (select unnest(range(1, 65)) as i))""",
    "edges": """edges as (select r_name as source, n_name as target from nation join region on n_regionkey = r_regionkey
  union all select n_name, s_name from supplier join nation on s_nationkey = n_nationkey)""",
    "predictions": """predictions as (select event_id as id, cast(ts as date) as date, event_type as entity, [5, 10, 20, 63, 126][user_id % 5 + 1] as horizon_days,
  case event_id % 3 when 0 then 'asof_h' || [5, 10, 20, 63, 126][user_id % 5 + 1] when 1 then 'lgbm_h' || [5, 10, 20, 63, 126][user_id % 5 + 1] end as model_version,
  cast((event_id * 13 % 1000) / 1000.0 as double) as prob, cast((event_id * 7 % 201 - 100) / 1000.0 as double) as expected_alpha,
  cast((event_id * 11 % 301 - 150) / 1000.0 as double) as expected_return from events)""",
    "regimes": f"""regimes as (select distinct cast(o_orderdate as date) as date, cast(floor({_DAY} / 9) % 4 + 1 as integer) as regime_id,
  cast(({_DAY} % 50) / 100.0 + 0.5 as double) as confidence from orders where {_DAY} % 3 = 0)""",
}
_NEEDS = {"prices": ("obs",)}


def with_views(*names: str) -> str:
    """The ``WITH`` clause that defines the views named, and those they need."""
    wanted = dict.fromkeys(v for n in names for v in (*_NEEDS.get(n, ()), n))
    return "with " + ",\n".join(SQL[n] for n in wanted) + "\n"
