"""Named sinks, exports and texts over the binding views."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitframe.operators.inference import dm_text, interval_text
from pitframe.operators.windows import Series
from pitframe.plans.registry import Registry
from pitframe.sources import views as v
from pitframe.sources import warehouse as w
from pitframe.sources.views import with_views

query = Registry()


def _merged(views: str, stored: str, arrived: str, keys: str, update: str, rest: str = "") -> str:
    """The same upsert in SQL: a full join on the keys."""
    names = keys.split(", ")
    on = " and ".join(f"o.{k} is not distinct from n.{k}" for k in names)
    parts = [f"case when n.here then n.{k} else o.{k} end as {k}" for k in names]
    parts += [f"case when n.here then n.{c} else o.{c} end as {c}" for c in update.split(", ")]
    parts += [f"case when o.here then o.{c} else n.{c} end as {c}" for c in rest.split(", ") if c]
    return f"{views}, o as (select true as here, * from ({stored})), n as (select true as here, * from ({arrived})) select {', '.join(parts)} from o full join n on {on}"


@query("k5_flow_sink", _merged(
    with_views("flows"), "select date, ticker, cast(cast(round(n, 2) as decimal(20,2)) as double) as aum, 0.0::double as daily_flow from flows where n % 2 = 0",
    "select date, ticker, null::double as aum, cast(cast(round(daily_flow, 4) as decimal(18,4)) as double) as daily_flow from flows where n % 3 > 0", "date, ticker", "aum, daily_flow",
))
def flow_sink(spark, d):
    f = v.flows(spark, d)
    none = {c: F.lit(None).cast("double") for c in ("weekly_flow", "flow_30d", "flow_60d")}
    stored = f.where("n % 2 = 0").select("date", "ticker", F.col("n").alias("aum"), F.lit(0.0).alias("daily_flow")).withColumns(none)
    arrived = f.where("n % 3 > 0").select("date", "ticker", F.lit(None).cast("double").alias("aum"), F.round("daily_flow", 4).alias("daily_flow")).withColumns(none)
    return w.sink(stored, arrived, "etf_flows").select("date", "ticker", F.col("aum").cast("double").alias("aum"), F.col("daily_flow").cast("double").alias("daily_flow"))


_YEAR = "sum(purchase / 1e6) over (partition by country order by month rows 11 preceding)"


@query("k6_purchase_sink", _merged(
    with_views("monthly") + f", r as (select month, country, round(purchase / 1e6, 4) as purchase_tonnes, round({_YEAR}, 4) as rolling_12m_tonnes from monthly)",
    "select month, country, 0.0::double as purchase_tonnes, null::double as rolling_12m_tonnes from r where month(month) % 2 = 0", "select * from r where month(month) % 3 > 0", "month, country", "purchase_tonnes, rolling_12m_tonnes",
))
def purchase_sink(spark, d):
    from pyspark.sql import Window

    year = Window.partitionBy("country").orderBy("month").rowsBetween(-11, 0)
    tonnes = F.col("purchase") / 1e6
    r = v.monthly(spark, d).select("month", "country", F.round(tonnes, 4).alias("purchase_tonnes"), F.round(F.sum(tonnes).over(year), 4).alias("rolling_12m_tonnes"), F.lit(None).cast("double").alias("yoy_growth_pct"))
    stored = r.where("month(month) % 2 = 0").withColumns({"purchase_tonnes": F.lit(0.0), "rolling_12m_tonnes": F.lit(None).cast("double")})
    got = w.sink(stored, r.where("month(month) % 3 > 0"), "central_bank_purchases")
    return got.select("month", "country", F.col("purchase_tonnes").cast("double").alias("purchase_tonnes"), F.col("rolling_12m_tonnes").cast("double").alias("rolling_12m_tonnes"))


@query("k8_quarterly_sink", _merged(
    "with q as (select s_name as ticker, last_day(cast(date_trunc('quarter', o_orderdate) as date) + interval 2 month) as quarter_end, count(*) as n from supplier, orders where s_suppkey = o_custkey group by 1, 2)",
    "select ticker, quarter_end, 1.0::double as production_oz, 'old' as management_guidance from q where n % 2 = 1", "select ticker, quarter_end, n::double as production_oz, 'new' as management_guidance from q",
    "ticker, quarter_end", "production_oz, management_guidance",
))
def quarterly_sink(spark, d):
    o = v.table(spark, d, "orders").select("o_custkey", F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("quarter_end"))
    q = o.join(v.table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("ticker")), F.col("o_custkey") == F.col("s_suppkey")).groupBy("ticker", "quarter_end").agg(F.count("*").cast("double").alias("production_oz"))
    rest = {c: F.lit(None) for c in w.UPDATES["miner_quarterly"] if c not in ("production_oz", "management_guidance")}
    arrived = q.withColumns(rest | {"management_guidance": F.lit("new")})
    stored = q.where("production_oz % 2 = 1").withColumns(rest | {"production_oz": F.lit(1.0), "management_guidance": F.lit("old")})
    return w.sink(stored, arrived, "miner_quarterly").select("ticker", "quarter_end", F.col("production_oz").cast("double").alias("production_oz"), "management_guidance")


@query("k11_regime_sink", _merged(
    with_views("regimes"), "select date, regime_id, 'hmm_v0' as model_version, 0.5::double as confidence from regimes where regime_id < 3",
    "select date, 5 - regime_id as regime_id, 'hmm_v1' as model_version, confidence from regimes where regime_id > 1", "date", "regime_id, model_version, confidence",
))
def regime_sink(spark, d):
    r = v.regimes(spark, d).withColumn("regime_name", F.lit("n"))
    stored = r.where("regime_id < 3").withColumns({"model_version": F.lit("hmm_v0"), "confidence": F.lit(0.5)})
    arrived = r.where("regime_id > 1").withColumns({"regime_id": 5 - F.col("regime_id"), "model_version": F.lit("hmm_v1")})
    return w.sink(stored, arrived, "market_regimes").select("date", "regime_id", "model_version", "confidence")


_LAST = "select date, entity, horizon_days, model_version, {0} as prob_outperform_gold, {0} * 0.95 as prob_beat_gdx, {1} as expected_return, {1} - 0.01 as expected_alpha from (select *, row_number() over (partition by date, entity, horizon_days, model_version order by id desc) as k from predictions where {2}) where k = 1"


@query("k12_prediction_sinks", _merged(
    with_views("predictions"), _LAST.format("0.5::double", "0.0::double", "id % 2 = 0"), _LAST.format("prob", "expected_return", "id % 4 > 0"),
    "date, entity, horizon_days, model_version", "prob_outperform_gold, prob_beat_gdx, expected_return, expected_alpha",
))
def prediction_sinks(spark, d):
    keys = ["date", "entity", "horizon_days", "model_version"]

    def last(rows, prob, ret):
        one = rows.groupBy(*keys).agg(F.max_by(F.struct("prob", "expected_return"), "id").alias("x")).select(*keys, "x.*")
        p, r = prob(F.col("prob")), ret(F.col("expected_return"))
        return one.select(
            F.lit(None).cast("long").alias("id"), *keys, p.alias("prob_outperform_gold"), (p * 0.95).alias("prob_beat_gdx"), r.alias("expected_return"), (r - 0.01).alias("expected_alpha"), F.lit(None).cast("int").alias("regime_id")
        )

    p = v.predictions(spark, d)
    got = w.sink(last(p.where("id % 2 = 0"), lambda c: F.lit(0.5), lambda c: F.lit(0.0)), last(p.where("id % 4 > 0"), lambda c: c, lambda c: c), "model_predictions")
    return got.select(*keys, "prob_outperform_gold", "prob_beat_gdx", "expected_return", "expected_alpha")


@query("k18_csv_lines", """select p_partkey || ',' || p_brand || ',"' || p_name || ', ' || p_type || '"' as line from part""")
def csv_lines(spark, d):
    p = v.table(spark, d, "part").select("p_partkey", "p_brand", F.concat("p_name", F.lit(", "), "p_type").alias("label"))
    return w.csv_lines(p)


_W = "over (partition by symbol order by date)"


@query("j2_features_forward", with_views("prices") + f""", f as (select symbol, date, close / nullif(lag(close, 20) {_W}, 0) - 1 as momentum from prices), y as (select symbol, date, lead(close, 20) {_W} / nullif(close, 0) - 1 as forward from prices)
  select f.symbol, f.date, round(momentum, 6) as momentum, round(forward, 6) as forward from f join y on f.symbol = y.symbol and f.date = y.date where forward is not null""")  # fmt: skip
def features_forward(spark, d):
    s = Series()
    both = v.prices(spark, d).select("symbol", "date", s.change(F.col("close"), 20).alias("momentum"), s.forward(F.col("close"), 20).alias("forward"))
    return both.where("forward is not null").select("symbol", "date", F.round("momentum", 6).alias("momentum"), F.round("forward", 6).alias("forward"))


@query("t13_table_sorts", with_views("predictions") + """, last as (select entity, horizon_days, arg_max(prob, id) as prob, arg_max(expected_alpha, id) as alpha from predictions group by 1, 2)
  select entity, horizon_days, rank() over (order by entity, horizon_days) as by_entity, rank() over (order by alpha desc, entity, horizon_days) as by_alpha, rank() over (order by prob desc, entity, horizon_days) as by_prob from last""")  # fmt: skip
def table_sorts(spark, d):
    from pyspark.sql import Window

    last = v.predictions(spark, d).groupBy("entity", "horizon_days").agg(F.max_by("prob", "id").alias("prob"), F.max_by("expected_alpha", "id").alias("alpha"))
    place = lambda *order: F.rank().over(Window.partitionBy(F.lit(0)).orderBy(*order, "entity", "horizon_days")).cast("long")
    return last.select("entity", "horizon_days", place().alias("by_entity"), place(F.desc("alpha")).alias("by_alpha"), place(F.desc("prob")).alias("by_prob"))


@query("i11_interval_texts", with_views("predictions") + """, m as (select entity, count(*) as n, sum(cast(round(expected_alpha * 1000) as bigint)) as s from predictions group by 1),
  b as (select entity, case when n >= 30 then round(s / 1000.0 / n - 0.01, 3) end as low, case when n >= 30 then round(s / 1000.0 / n + 0.01, 3) end as high from m)
  select entity, case when low is null then 'alpha: too few observations.' when low <= 0 and high >= 0 then 'alpha: the interval ' || printf('[%.4f, %.4f]', low, high) || ' holds 0.'
  else 'alpha: the interval ' || printf('[%.4f, %.4f]', low, high) || ' lies away from 0.' end as text from b""")  # fmt: skip
def interval_texts(spark, d):
    m = v.predictions(spark, d).groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.round(F.col("expected_alpha") * 1000).cast("long")).alias("s"))
    mean = F.col("s") / 1000.0 / F.col("n")
    low, high = F.when(F.col("n") >= 30, F.round(mean - 0.01, 3)), F.when(F.col("n") >= 30, F.round(mean + 0.01, 3))
    return m.select("entity", interval_text(low, high, 0.0, "alpha").alias("text"))


@query("i11_test_texts", with_views("predictions") + """, m as (select entity, horizon_days, count(*) % 120 / 1000.0 as p, (sum(cast(round(expected_alpha * 1000) as bigint)) % 50) / 1000.0 as dif, count(*) as n from predictions group by 1, 2)
  select entity, horizon_days, case when n % 5 = 0 then 'boosted against ' || entity || ': too few observations.' else 'boosted loses ' || printf('%.4f', abs(dif)) || ' ' || case when dif < 0 then 'less' else 'more' end || ' a period than ' || entity || ' (' ||
  case when p < 0.01 then 'surely so: p below 0.01' when p < 0.05 then 'p below 0.05' when p < 0.1 then 'perhaps: p below 0.10' else 'which may be chance' end || ', p = ' || printf('%.3f', p) || ').' end as text from m""")  # fmt: skip
def test_texts(spark, d):
    m = v.predictions(spark, d).groupBy("entity", "horizon_days").agg(F.count("*").alias("n"), F.sum(F.round(F.col("expected_alpha") * 1000).cast("long")).alias("s"))
    p, dif = F.when(F.col("n") % 5 != 0, F.col("n") % 120 / 1000.0), (F.col("s") % 50) / 1000.0
    return m.select("entity", "horizon_days", dm_text(p, dif, "boosted", F.col("entity")).alias("text"))


QUERIES, ORACLES = query.queries, query.oracles
