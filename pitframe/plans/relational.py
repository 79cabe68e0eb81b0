"""Filters, joins, aggregates, top-k, sets and scalar functions over the binding views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitframe.functions import labels as fl
from pitframe.functions import text as ft
from pitframe.operators import stats
from pitframe.operators.windows import Series
from pitframe.plans.registry import Registry
from pitframe.sources import views as v
from pitframe.sources.views import with_views

query = Registry()
PX = with_views("prices")
PREDS = with_views("predictions")
TWO = f"('{v.GOLD}', '{v.BENCHMARK}')"
_W = "over (partition by symbol order by date)"


@query("p1_symbols_in", PX + f"select symbol, count(*) as n from prices where symbol in {TWO} group by 1")
def symbols_in(spark, d):
    return v.prices(spark, d).where(F.col("symbol").isin(v.GOLD, v.BENCHMARK)).groupBy("symbol").agg(F.count("*").alias("n"))


@query("p2_date_range", PX + "select date, symbol, round(close, 6) as close from prices where date between date '1995-01-01' and date '1995-03-31'")
def date_range(spark, d):
    return v.prices(spark, d).where("date between date '1995-01-01' and date '1995-03-31'").select("date", "symbol", F.round("close", 6).alias("close"))


@query("p3_lookback", PX + f"select symbol, count(*) as n, min(date) as first from prices where date >= date '{v.AS_OF}' - 90 group by 1")
def lookback(spark, d):
    return v.prices(spark, d).where(F.col("date") >= F.date_sub(F.lit(v.AS_OF), 90)).groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first"))


@query("p5_live_or_asof", PREDS + """select coalesce(model_version, '') as model_version, case when coalesce(starts_with(model_version, 'asof_h'), false) then 'asof_embargo' else 'full_sample_live' end as path, count(*) as n from predictions group by 1, 2""")
def live_or_asof(spark, d):
    return v.predictions(spark, d).groupBy(F.coalesce("model_version", F.lit("")).alias("model_version"), fl.scoring_path("model_version").alias("path")).agg(F.count("*").alias("n"))


@query("p6_horizon", PREDS + "select horizon_days, count(*) as n, round(avg(prob), 6) as prob from predictions where horizon_days in (5, 63) group by 1")
def horizon(spark, d):
    return v.predictions(spark, d).where("horizon_days in (5, 63)").groupBy("horizon_days").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("prob"))


_GAPS = "g as (select id, y, case when id % 7 = 0 then cast('nan' as double) when id % 11 = 0 then cast('inf' as double) when id % 13 = 0 then null else p end as p from scores)"


def _gaps(spark, d):
    i = F.col("id")
    return v.scores(spark, d).withColumn("p", F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 11 == 0, F.lit(float("inf"))).when(i % 13 == 0, F.lit(None)).otherwise(F.col("p")))


@query("p7_finite_only", with_views("scores") + f", {_GAPS} select id, p from g where p is not null and not isnan(p) and not isinf(p)")
def finite_only(spark, d):
    return _gaps(spark, d).where(fl.finite("p").isNotNull()).select("id", "p")


@query("p8_drop_missing", with_views("scores") + f", {_GAPS} select count(*) as complete from g where p is not null and not isnan(p) and y is not null")
def drop_missing(spark, d):
    return _gaps(spark, d).na.drop("any", subset=["y", "p"]).agg(F.count("*").alias("complete"))


@query("p9_infinite_to_null", with_views("scores") + f", {_GAPS} select id, case when isinf(p) or isnan(p) then null else p end as p from g")
def infinite_to_null(spark, d):
    return _gaps(spark, d).select("id", fl.finite("p").alias("p"))


@query("p10_covered_features", with_views("vectors") + """select feature, round(avg(case when value > -0.1 then 1.0 else 0.0 end), 6) as coverage from vectors group by 1 having avg(case when value > -0.1 then 1.0 else 0.0 end) >= 0.7""")
def covered(spark, d):
    x = v.vectors(spark, d).withColumn("x", F.when(F.col("value") > -0.1, F.col("value")))
    return x.groupBy("feature").agg(F.round(F.avg(F.col("x").isNotNull().cast("double")), 6).alias("coverage"), F.avg(F.col("x").isNotNull().cast("double")).alias("c")).where("c >= 0.7").drop("c")


@query("p11_p12_columns_by_name", """select p_brand, k from (select p_brand, row_number() over (order by p_brand) as k from (select distinct p_brand from part where regexp_matches(p_brand, '[1-3]') and not regexp_matches(p_brand, '2'))) where k <= 12""")
def columns_by_name(spark, d):
    names = v.table(spark, d, "part").where(F.col("p_brand").rlike("[1-3]") & ~F.col("p_brand").rlike("2")).select("p_brand").distinct()
    return names.orderBy("p_brand").limit(12).withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p_brand")))


@query("p13_safe_default", with_views("scores") + f", {_GAPS} select id, case when p is null or isnan(p) or isinf(p) then 0.5 else p end as p from g")
def safe_default(spark, d):
    return _gaps(spark, d).select("id", fl.finite("p", 0.5).alias("p"))


@query("p14_rescale_series", PX + f"""select symbol, date, round(case when symbol in {TWO} and max(close) over (partition by symbol) > 20 then close / 10 else close end, 6) as close from prices""")
def rescale(spark, d):
    large = F.col("symbol").isin(v.GOLD, v.BENCHMARK) & (F.max("close").over(Window.partitionBy("symbol")) > 20)
    return v.prices(spark, d).select("symbol", "date", F.round(F.when(large, F.col("close") / 10).otherwise(F.col("close")), 6).alias("close"))


@query("p15_fallback_chain", PX + f""", w as (select date, max(close) filter (symbol = '{v.GOLD}') as a, max(close) filter (symbol = 'PROMO') as b, max(close) filter (symbol = 'SMALL') as c from prices group by 1)
  select date, round(coalesce(a, b, c), 6) as close, case when a is not null then '{v.GOLD}' when b is not null then 'PROMO' when c is not null then 'SMALL' end as source from w""")  # fmt: skip
def fallback(spark, d):
    chain = (v.GOLD, "PROMO", "SMALL")
    w = v.prices(spark, d).groupBy("date").pivot("symbol", list(chain)).agg(F.max("close"))
    source = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in chain])
    return w.select("date", F.round(F.coalesce(*chain), 6).alias("close"), source.alias("source"))


@query("p16_outlier_to_null", PX + "select date, symbol, round(case when close > 1500 then null else close end, 6) as close from prices")
def outlier(spark, d):
    return v.prices(spark, d).select("date", "symbol", F.round(F.when(F.col("close") > 1500, F.lit(None)).otherwise(F.col("close")), 6).alias("close"))


@query("p17_book_search", "select p_partkey, p_name from part where p_type = 'ECONOMY' and p_brand = 'Brand#11' or lower(p_name) like '%7%'")
def book_search(spark, d):
    p = v.table(spark, d, "part")
    return p.where(((F.col("p_type") == "ECONOMY") & (F.col("p_brand") == "Brand#11")) | F.lower("p_name").contains("7")).select("p_partkey", "p_name")


@query("p18_existing_only", PX + "select distinct p_type as symbol from part where p_type in (select symbol from prices)")
def existing_only(spark, d):
    return v.table(spark, d, "part").select(F.col("p_type").alias("symbol")).distinct().join(v.prices(spark, d).select("symbol").distinct(), "symbol", "left_semi")


@query("p19_enough_rows", with_views("flows") + "select date, ticker, round(daily_flow, 4) as daily_flow from (select *, count(*) over (partition by ticker) as k from flows) where k >= 20")
def enough_rows(spark, d):
    k = F.count("*").over(Window.partitionBy("ticker"))
    return v.flows(spark, d).withColumn("k", k).where("k >= 20").select("date", "ticker", F.round("daily_flow", 4).alias("daily_flow"))


# Joins


@query("j1_features_targets", PX + f""", f as (select symbol, date, close / nullif(lag(close, 5) {_W}, 0) - 1 as ret, lead(close, 5) {_W} / nullif(close, 0) - 1 as fwd from prices)
  select a.symbol, a.date, round(a.ret, 6) as ret, round(b.fwd, 6) as fwd from f a join f b on a.symbol = b.symbol and a.date = b.date where a.ret is not null and b.fwd is not null""")  # fmt: skip
def features_targets(spark, d):
    s, p = Series(), v.prices(spark, d)
    got = p.select("symbol", "date", s.change(F.col("close"), 5).alias("ret"), s.forward(F.col("close"), 5).alias("fwd"))
    return got.where("ret is not null and fwd is not null").select("symbol", "date", F.round("ret", 6).alias("ret"), F.round("fwd", 6).alias("fwd"))


@query("j6_label_lookup", PREDS + """select p.id, coalesce(r.r_name, 'unknown') as tier, case horizon_days when 5 then '5d' when 10 then '10d' when 20 then '1m' when 63 then '3m' when 126 then '6m' end as label
  from predictions p left join region r on p.id % 7 = r.r_regionkey""")  # fmt: skip
def label_lookup(spark, d):
    r = F.broadcast(v.table(spark, d, "region"))
    got = v.predictions(spark, d).join(r, F.col("id") % 7 == F.col("r_regionkey"), "left")
    return got.select("id", F.coalesce("r_name", F.lit("unknown")).alias("tier"), fl.horizon_label("horizon_days").alias("label"))


@query("j8_j9_aligned_weights", """with w as (select n_nationkey, n_name, sum(s_acctbal) as bal from nation left join supplier on s_nationkey = n_nationkey group by 1, 2),
  a as (select *, coalesce(greatest(bal, 0), 0) as c from w) select n_name, round(c / nullif(sum(c) over (), 0), 8) as weight, round(coalesce(bal, avg(bal) over ()), 4) as filled from a""")  # fmt: skip
def aligned(spark, d):
    s = v.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("bal"))
    a = v.table(spark, d, "nation").join(s, "n_nationkey", "left").withColumn("c", F.coalesce(F.greatest("bal", F.lit(0.0)), F.lit(0.0)))
    every = Window.partitionBy(F.lit(0))
    return a.select("n_name", F.round(F.try_divide("c", F.sum("c").over(every)), 8).alias("weight"), F.round(F.coalesce("bal", F.avg("bal").over(every)), 4).alias("filled"))


@query("j10_left_features", PX + f"""select a.date, round(a.close, 6) as close, round(b.close, 6) as bench from prices a left join prices b on b.symbol = '{v.BENCHMARK}' and a.date = b.date where a.symbol = '{v.GOLD}'""")
def left_features(spark, d):
    p = v.prices(spark, d).select("date", "symbol", F.round("close", 6).alias("close"))
    b = p.where(F.col("symbol") == v.BENCHMARK).select("date", F.col("close").alias("bench"))
    return p.where(F.col("symbol") == v.GOLD).drop("symbol").join(b, "date", "left")


@query("j11_full_outer", """with a as (select s_nationkey as k, count(*) as held from supplier where s_suppkey % 2 = 0 group by 1), b as (select c_nationkey as k, count(*) as wanted from customer where c_custkey % 5 = 0 group by 1)
  select coalesce(a.k, b.k) as k, coalesce(held, 0) as held, coalesce(wanted, 0) as wanted from a full outer join b on a.k = b.k""")  # fmt: skip
def full_outer(spark, d):
    a = v.table(spark, d, "supplier").where("s_suppkey % 2 = 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("held"))
    b = v.table(spark, d, "customer").where("c_custkey % 5 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("wanted"))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("wanted", F.lit(0)).alias("wanted"))


@query("j12_days_with_forecast", with_views("flows", "predictions") + "select date, ticker, n from flows f where exists (select 1 from predictions p where p.date = f.date and p.entity = f.ticker and p.horizon_days = 20 and starts_with(p.model_version, 'asof_h'))")
def semi(spark, d):
    p = v.predictions(spark, d).where((F.col("horizon_days") == 20) & fl.is_asof("model_version")).select("date", F.col("entity").alias("ticker"))
    return v.flows(spark, d).join(p, ["date", "ticker"], "left_semi").select("date", "ticker", "n")


@query("j13_absent_only", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def anti(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey").join(v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("j14_mark", "select n_name, n_nationkey in (select s_nationkey from supplier where s_acctbal > 0) as modeled from nation")
def mark(spark, d):
    s = v.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("m")).distinct()
    return v.table(spark, d, "nation").join(s, "n_nationkey", "left").select("n_name", F.col("m").isNotNull().alias("modeled"))


@query("j15_common_days", PX + f"select date from prices where symbol in {TWO} group by 1 having count(distinct symbol) = 2")
def common_days(spark, d):
    p = v.prices(spark, d).where(F.col("symbol").isin(v.GOLD, v.BENCHMARK))
    return p.groupBy("date").agg(F.count("*").alias("n")).where("n = 2").select("date")


@query("j17_last_close_upto", PX + "select symbol, max(date) as date, round(arg_max(close, date), 6) as close from prices where date <= date '1997-06-15' group by 1")
def last_close(spark, d):
    p = v.prices(spark, d).where("date <= date '1997-06-15'")
    return p.groupBy("symbol").agg(F.max("date").alias("date"), F.round(F.max_by("close", "date"), 6).alias("close"))


@query("j18_latest_per_key", """select c_custkey, o_orderkey, cast(o_orderdate as date) as date from customer left join (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) o
  on o_custkey = c_custkey and rn = 1""")  # fmt: skip
def latest_per_key(spark, d):
    last = v.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return v.table(spark, d, "customer").join(last, "c_custkey", "left").select("c_custkey", F.col("m.o_orderkey").alias("o_orderkey"), F.col("m.o_orderdate").cast("date").alias("date"))


@query("j20_catalog", PREDS + """, c as (select ticker as entity, h as horizon_days from (select distinct entity as ticker from predictions), (values (5), (10), (20), (63), (126), (252)) t(h)),
  l as (select *, row_number() over (partition by entity, horizon_days order by date desc, id desc) as rn from predictions where not coalesce(starts_with(model_version, 'asof_h'), false))
  select entity, horizon_days, id, prob, id is not null as scored from c left join (select * from l where rn = 1) using (entity, horizon_days)""")  # fmt: skip
def catalog(spark, d):
    p = v.predictions(spark, d)
    c = p.select("entity").distinct().select("entity", F.explode(F.array(*map(F.lit, (*v.HORIZONS, 252)))).alias("horizon_days"))
    last = p.where(fl.is_live("model_version")).groupBy("entity", "horizon_days").agg(F.max(F.struct("date", "id", "prob")).alias("m"))
    return c.join(last, ["entity", "horizon_days"], "left").select("entity", "horizon_days", F.col("m.id").alias("id"), F.col("m.prob").alias("prob"), F.col("m.id").isNotNull().alias("scored"))


@query("j21_merged_series", PX + f"select date, round(max(close) filter (symbol = '{v.GOLD}'), 6) as gold, round(max(close) filter (symbol = '{v.BENCHMARK}'), 6) as bench from prices group by 1")
def merged(spark, d):
    w = v.prices(spark, d).groupBy("date").pivot("symbol", [v.GOLD, v.BENCHMARK]).agg(F.max("close"))
    return w.select("date", F.round(v.GOLD, 6).alias("gold"), F.round(v.BENCHMARK, 6).alias("bench"))


# Aggregates


@query("a1_counts", "select 'orders' as name, count(*) as n from orders union all select 'open', count(*) from orders where o_orderstatus = 'O'")
def counts(spark, d):
    o = v.table(spark, d, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return o.unpivot([], ["orders", "open"], "name", "n")


@query("a2_a3_distinct", "select o_custkey % 10 as account, count(distinct cast(o_orderdate as date)) as rebalances from orders group by 1")
def distinct_days(spark, d):
    return v.table(spark, d, "orders").groupBy((F.col("o_custkey") % 10).alias("account")).agg(F.count_distinct(F.col("o_orderdate").cast("date")).alias("rebalances"))


@query("a4_latest_rows_sum", with_views("monthly") + "select round(sum(coalesce(purchase, 0)), 2) as tonnes from (select * from monthly order by month desc, country limit 12)")
def latest_rows_sum(spark, d):
    return v.monthly(spark, d).orderBy(F.desc("month"), "country").limit(12).agg(F.round(F.sum(F.coalesce("purchase", F.lit(0.0))), 2).alias("tonnes"))


@query("a5_mean_score", PREDS + "select horizon_days, round(avg(prob), 3) as mean_auc from predictions where model_version is not null group by 1")
def mean_score(spark, d):
    return v.predictions(spark, d).where("model_version is not null").groupBy("horizon_days").agg(F.round(F.avg("prob"), 3).alias("mean_auc"))


@query("a6_a7_concentration", """with w as (select p_brand, p_type, sum(p_retailprice) as x from part group by 1, 2), s as (select p_brand, p_type, x / sum(x) over (partition by p_brand) as w from w),
  r as (select *, row_number() over (partition by p_brand order by w desc) as k from s)
  select p_brand, round(sum(w * w), 8) as hhi, round(1 / sum(w * w), 6) as effective_n, round(sum(w) filter (k <= 3), 8) as top3, round(max(w), 8) as max_weight from r group by 1""")  # fmt: skip
def concentration(spark, d):
    x = v.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("x"))
    w = x.withColumn("w", F.col("x") / F.sum("x").over(Window.partitionBy("p_brand")))
    got = stats.concentration(w, ["p_brand"], "w")
    return got.select("p_brand", *[F.round(c, 6 if c == "effective_n" else 8).alias(c) for c in ("hhi", "effective_n", "top3", "max_weight")])


@query("a8_expected_alpha", PREDS + "select entity, round(sum(prob * expected_alpha) / sum(prob), 8) as alpha from predictions group by 1")
def expected_alpha(spark, d):
    return v.predictions(spark, d).groupBy("entity").agg(F.round(F.sum(F.col("prob") * F.col("expected_alpha")) / F.sum("prob"), 8).alias("alpha"))


@query("a9_conditional_counts", "select p_type, count(*) as n, count(*) filter (p_size > 25) as large, count(*) filter (p_retailprice > 1200) as dear from part group by 1")
def conditional_counts(spark, d):
    return v.table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_if(F.col("p_retailprice") > 1200).alias("dear"))


_RET = PX + f", r as (select symbol, date, close / nullif(lag(close) {_W}, 0) - 1 as ret from prices), q as (select * from r where ret is not null)\n"


def _returns(spark, d):
    return v.prices(spark, d).select("symbol", "date", Series().change(F.col("close"), 1).alias("ret")).where("ret is not null")


@query("a10_covariance", _RET + "select x.symbol as a, y.symbol as b, round(covar_samp(x.ret, y.ret), 8) as cov, count(*) as n from q x join q y using (date) group by 1, 2")
def covariance(spark, d):
    return stats.covariance(_returns(spark, d), "date", "symbol", "ret").withColumn("cov", F.round("cov", 8))


@query("a11_portfolio_risk", _RET + """, c as (select x.symbol as a, y.symbol as b, covar_samp(x.ret, y.ret) as cov from q x join q y using (date) group by 1, 2),
  w as (select symbol, count(*) * 1.0 / sum(count(*)) over () as w, avg(ret) as mu from q group by 1),
  t as (select sum(p.w * r.w * cov) as var from c join w p on a = p.symbol join w r on b = r.symbol)
  select round(sqrt(var * 252), 6) as vol, round((select sum(w * mu) * 252 from w) / sqrt(var * 252), 6) as sharpe from t""")  # fmt: skip
def portfolio_risk(spark, d):
    from pitframe.operators.portfolio import portfolio_risk as risk

    r = _returns(spark, d)
    w = r.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("ret").alias("mu")).withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
    got = risk(r, w, "date", "symbol", "ret", "w", "mu")
    return got.select(F.round("vol", 6).alias("vol"), F.round("sharpe", 6).alias("sharpe"))


@query("a12_label_correlation", with_views("vectors") + """, c as (select feature, corr(value, case when label = 3 then 1.0 else 0.0 end) as c from vectors group by 1 having count(*) >= 30 and stddev_samp(value) > 0)
  select feature, round(c, 6) as corr, row_number() over (order by abs(c) desc, feature desc) as rank from c qualify row_number() over (order by abs(c) desc, feature desc) <= 20""")  # fmt: skip
def label_correlation(spark, d):
    long = v.vectors(spark, d).withColumn("y", (F.col("label") == 3).cast("double"))
    top = stats.label_correlation(long, "feature", "value", "y").orderBy(F.desc(F.abs("corr")), F.desc("feature")).limit(20)
    return top.select("feature", F.round("corr", 6).alias("corr"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("corr")), F.desc("feature"))).alias("rank"))


@query("a13_top_variance", with_views("vectors") + "select feature, round(var_samp(value), 8) as variance from vectors group by 1 order by var_samp(value) desc, feature limit 20")
def top_variance(spark, d):
    got = v.vectors(spark, d).groupBy("feature").agg(F.var_samp("value").alias("x")).orderBy(F.desc("x"), "feature").limit(20)
    return got.select("feature", F.round("x", 8).alias("variance"))


@query("t8_top_sixty", with_views("vectors") + "select feature, round(var_samp(value), 8) as variance from vectors group by 1 order by var_samp(value) desc, feature limit 60")
def top_sixty(spark, d):
    got = v.vectors(spark, d).groupBy("feature").agg(F.var_samp("value").alias("x")).orderBy(F.desc("x"), "feature").limit(60)
    return got.select("feature", F.round("x", 8).alias("variance"))


@query("a14_mean_profile", with_views("vectors") + "select label, feature, round(avg(value), 6) as mean from vectors where feature < 8 group by 1, 2")
def mean_profile(spark, d):
    return v.vectors(spark, d).where("feature < 8").groupBy("label", "feature").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("a15_series_summary", PX + """select symbol, round(arg_max(close, date), 1) as latest, round(min(close), 1) as low, round(max(close), 1) as high, round(avg(close), 1) as mean, round(arg_max(close, date) - arg_min(close, date), 1) as change, count(*) as n from prices group by 1""")
def series_summary(spark, d):
    latest, first = F.max_by("close", "date"), F.min_by("close", "date")
    return v.prices(spark, d).groupBy("symbol").agg(
        F.round(latest, 1).alias("latest"), F.round(F.min("close"), 1).alias("low"), F.round(F.max("close"), 1).alias("high"), F.round(F.avg("close"), 1).alias("mean"),
        F.round(latest - first, 1).alias("change"), F.count("*").alias("n"),
    )


@query("a16_change_20_rows", PX + "select symbol, round(max(close) filter (rn = 1), 6) as last, round(max(close) filter (rn = 1) / max(close) filter (rn = 21) - 1, 6) as change from (select *, row_number() over (partition by symbol order by date desc) as rn from prices) group by 1 having count(*) > 21")
def change_20(spark, d):
    p = v.prices(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("close")))
    return p.groupBy("symbol").agg(F.round(at(1), 6).alias("last"), F.round(at(1) / at(21) - 1, 6).alias("change"), F.count("*").alias("n")).where("n > 21").drop("n")


@query("a17_two_classes", with_views("scores") + "select id % 50 as grp, count(distinct y) = 2 as usable from scores group by 1")
def two_classes(spark, d):
    return v.scores(spark, d).groupBy((F.col("id") % 50).alias("grp")).agg((F.min("y") != F.max("y")).alias("usable"))


@query("a18_calibration", with_views("scores") + """, b as (select case when p < 0.2 then 0.0 when p < 0.4 then 0.2 when p < 0.6000000000000001 then 0.4 when p < 0.8 then 0.6 else 0.8 end as bin_low, p, y from scores where p between 0 and 1)
  select cast(bin_low as double) as bin_low, cast(round(bin_low + 0.2, 2) as double) as bin_high, count(*) as n, round(avg(p), 3) as mean_predicted, round(avg(y), 3) as realized_rate from b group by 1, 2""")  # fmt: skip
def calibration(spark, d):
    return stats.calibration(v.scores(spark, d), "y", "p")


@query("a19_auc", with_views("scores") + """, r as (select id % 5 as fold, y, rank() over (partition by id % 5 order by p) + (count(*) over (partition by id % 5, p) - 1) / 2.0 as r from scores)
  select fold, count(*) as n, round(case when count(*) >= 5 and min(y) <> max(y) then (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)) end, 8) as auc from r group by 1""")  # fmt: skip
def auc(spark, d):
    s = v.scores(spark, d).withColumn("fold", F.col("id") % 5)
    return stats.auc(s, "y", "p", ["fold"]).withColumn("auc", F.round("auc", 8))


@query("a20_a21_accuracy", with_views("scores") + ", f as (select id % 5 as fold, avg(case when (p > 0.5) = (y = 1) then 1.0 else 0.0 end) as acc from scores group by 1) select round(avg(acc), 8) as mean_accuracy, count(*) as folds from f")
def accuracy(spark, d):
    f = v.scores(spark, d).groupBy(F.col("id") % 5).agg(stats.accuracy(F.col("y"), F.col("p")).alias("acc"))
    return f.agg(F.round(F.avg("acc"), 8).alias("mean_accuracy"), F.count("*").alias("folds"))


@query("a22_agreement", with_views("scores") + "select round(avg(case when (p > 0.5) = (p > 0.45) then 1.0 else 0.0 end), 8) as agreement, round(avg(case when p > 0.5 then 1.0 else 0.0 end), 8) as rate_a, round(avg(case when p > 0.45 then 1.0 else 0.0 end), 8) as rate_b from scores")
def agreement(spark, d):
    a, b = F.col("p") > 0.5, F.col("p") > 0.45
    share = lambda c: F.round(F.avg(c.cast("double")), 8)
    return v.scores(spark, d).agg(share(a == b).alias("agreement"), share(a).alias("rate_a"), share(b).alias("rate_b"))


@query("a23_total_return", PREDS + "select entity, round(product(1 + expected_return / 1000) - 1, 8) as total_return, round(avg(expected_return), 8) as mean_return from predictions group by 1")
def total_return(spark, d):
    r = F.col("expected_return")
    p = v.predictions(spark, d)
    return p.groupBy("entity").agg(F.round(F.product(1 + r / 1000) - 1, 8).alias("total_return"), F.round(F.avg(r), 8).alias("mean_return"))


@query("a24_max_drawdown", _RET + f", w as (select symbol, date, exp(sum(ln(1 + ret / 100)) {_W}) as x from q), p as (select symbol, x / max(x) {_W} - 1 as dd from w) select symbol, round(min(dd), 6) as max_drawdown from p group by 1")
def max_drawdown(spark, d):
    s = Series()
    w = _returns(spark, d).withColumn("x", s.wealth(F.col("ret") / 100))
    return w.withColumn("dd", F.col("x") / s.peak(F.col("x")) - 1).groupBy("symbol").agg(F.round(F.min("dd"), 6).alias("max_drawdown"))


@query("a25_a26_rates", PREDS + "select horizon_days, round(avg(case when expected_alpha > 0 then 1.0 else 0.0 end), 6) as positive_rate, count(*) filter (prob >= 0.6 and expected_alpha > 0 or prob >= 0.55 and not (prob <= 0.4 and expected_alpha < 0)) as n_long from predictions group by 1")
def rates(spark, d):
    long = fl.signal("prob", "expected_alpha").isin("long", "overweight")
    return v.predictions(spark, d).groupBy("horizon_days").agg(F.round(F.avg((F.col("expected_alpha") > 0).cast("double")), 6).alias("positive_rate"), F.count_if(long).alias("n_long"))


@query("a27_latest_date", PX + "select max(date) as as_of from prices")
def latest_date(spark, d):
    return v.prices(spark, d).agg(F.max("date").alias("as_of"))


@query("a28_mean_or_default", "select r_name, coalesce(round(avg(s_acctbal), 4), 0.5) as score from region left join nation on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey group by 1")
def mean_or_default(spark, d):
    r, n, s = (v.table(spark, d, t) for t in ("region", "nation", "supplier"))
    j = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("r_name").agg(F.coalesce(F.round(F.avg("s_acctbal"), 4), F.lit(0.5)).alias("score"))


def _hits(words) -> str:
    return "least((" + " + ".join(f"cast(contains(lower(coalesce(text, '')), '{w}') as int)" for w in words) + f") / {len(words)}.0, 1.0)"


@query("a29_news_components", "select source, " + ", ".join(f"round(avg({_hits(w)}), 6) as {c}" for c, w in ft.RISK_WORDS.items()) + " from documents group by 1")
def news_components(spark, d):
    return v.table(spark, d, "documents").groupBy("source").agg(*[F.round(F.avg(ft.keyword_score(F.col("text"), w)), 6).alias(c) for c, w in ft.RISK_WORDS.items()])


# Sorts, limits, top-k


@query("t1_t2_latest_row", PX + "select date, symbol, round(close, 6) as close from prices order by date desc, symbol limit 1")
def latest_row(spark, d):
    return v.prices(spark, d).orderBy(F.desc("date"), "symbol").limit(1).select("date", "symbol", F.round("close", 6).alias("close"))


@query("t3_limit_sorted", "select o_orderkey, round(o_totalprice, 2) as o_totalprice from orders order by orders.o_totalprice desc, o_orderkey limit 40")
def limit_sorted(spark, d):
    return v.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("t4_top_renormalised", "with w as (select p_brand, sum(p_retailprice) as x from part group by 1), t as (select * from w order by x desc, p_brand limit 8) select p_brand, round(x / sum(x) over (), 8) as weight from t")
def top_renormalised(spark, d):
    t = v.table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("x")).orderBy(F.desc("x"), "p_brand").limit(8)
    return t.select("p_brand", F.round(F.col("x") / F.sum("x").over(Window.partitionBy(F.lit(0))), 8).alias("weight"))


@query("t5_t6_top_sleeve", PREDS + """select date, horizon_days, entity, rank from (select date, horizon_days, entity, row_number() over (partition by date, horizon_days order by max(expected_alpha) desc, entity desc) as rank from predictions group by 1, 2, 3) where rank <= 3""")
def top_sleeve(spark, d):
    best = v.predictions(spark, d).groupBy("date", "horizon_days", "entity").agg(F.max("expected_alpha").alias("a"))
    rank = F.row_number().over(Window.partitionBy("date", "horizon_days").orderBy(F.desc("a"), F.desc("entity")))
    return best.withColumn("rank", rank).where("rank <= 3").drop("a")


@query("t9_tail", PX + "select symbol, date from (select symbol, date, row_number() over (partition by symbol order by date desc) as rn from prices) where rn <= 30")
def tail(spark, d):
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return v.prices(spark, d).select("symbol", "date", rn.alias("rn")).where("rn <= 30").drop("rn")


@query("t10_scaled_scores", "with s as (select p_type, avg(p_retailprice) as score from part group by 1) select p_type, round(100 * score / max(score) over (), 1) as score, row_number() over (order by score desc, p_type) as rank from s")
def scaled(spark, d):
    s = v.table(spark, d, "part").groupBy("p_type").agg(F.avg("p_retailprice").alias("s"))
    every = Window.partitionBy(F.lit(0))
    return s.select("p_type", F.round(100 * F.col("s") / F.max("s").over(every), 1).alias("score"), F.row_number().over(every.orderBy(F.desc("s"), "p_type")).alias("rank"))


@query("t11_t16_best_book", PREDS + """select entity, horizon_days as best_horizon, round(score, 8) as score from (select entity, horizon_days, avg(expected_return) - 0.5 * abs(min(expected_alpha)) as score, row_number() over (partition by entity order by
  avg(expected_return) - 0.5 * abs(min(expected_alpha)) desc, horizon_days) as rn from predictions group by 1, 2) where rn = 1""")  # fmt: skip
def best_book(spark, d):
    s = v.predictions(spark, d).groupBy("entity", "horizon_days").agg((F.avg("expected_return") - 0.5 * F.abs(F.min("expected_alpha"))).alias("s"))
    best = s.groupBy("entity").agg(F.max(F.struct("s", (-F.col("horizon_days")).alias("h"))).alias("m"))
    return best.select("entity", (-F.col("m.h")).alias("best_horizon"), F.round("m.s", 8).alias("score"))


@query("t14_top_per_target", with_views("edges") + "select source, target, k from (select source, target, row_number() over (partition by source order by target) as k from edges) where k <= 3")
def top_per_target(spark, d):
    k = F.row_number().over(Window.partitionBy("source").orderBy("target"))
    return v.edges(spark, d).withColumn("k", k).where("k <= 3")


# Sets


@query("u1_union_all", "select 'c' as kind, c_nationkey as k from customer union all select 's', s_nationkey from supplier")
def union_all(spark, d):
    c = v.table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("k"))
    return c.unionByName(v.table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("k")))


@query("u2_u3_u4_sets", """select 'union' as op, k from (select c_nationkey as k from customer union select s_nationkey from supplier) union all select 'intersect', k from (select c_nationkey as k from customer intersect select s_nationkey from supplier)
  union all select 'except', k from (select c_nationkey as k from customer except select s_nationkey from supplier)""")  # fmt: skip
def sets(spark, d):
    c = v.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return named("union", c.union(s).distinct()).unionByName(named("intersect", c.intersect(s))).unionByName(named("except", c.distinct().join(s, "k", "left_anti")))


@query("u5_u6_distinct_merge", "select distinct p_brand, p_type from part")
def distinct_pairs(spark, d):
    return v.table(spark, d, "part").select("p_brand", "p_type").distinct()


# Scalar functions


@query("f1_f2_f4_strings", "select p_partkey, split_part(p_type || '__' || p_brand, '__', 1) as entity, split_part(p_type || '__' || p_brand, '__', -1) as feature, p_type || '_clf_h' || p_size as model_key, starts_with(p_name, 'part') as is_part, replace(lower(p_type), 'o', '0') as low from part")
def strings(spark, d):
    name = ft.feature_key(F.col("p_type"), F.col("p_brand"))
    return v.table(spark, d, "part").select(
        "p_partkey", ft.entity_of(name).alias("entity"), ft.feature_of(name).alias("feature"), F.concat("p_type", F.lit("_clf_h"), F.col("p_size").cast("string")).alias("model_key"),
        F.col("p_name").startswith("part").alias("is_part"), F.replace(F.lower("p_type"), F.lit("o"), F.lit("0")).alias("low"),
    )


@query("f3_keyword_score", "select doc_id, " + ", ".join(f"round({_hits(w)}, 6) as {c}" for c, w in ft.RISK_WORDS.items()) + " from documents")
def keyword_score(spark, d):
    return v.table(spark, d, "documents").select("doc_id", *[F.round(ft.keyword_score(F.col("text"), w), 6).alias(c) for c, w in ft.RISK_WORDS.items()])


@query("f5_horizon_label", "select p_partkey, case p_size when 5 then '5d' when 10 then '10d' when 20 then '1m' when 63 then '3m' when 126 then '6m' else p_size || 'd' end as label from part")
def horizon_label(spark, d):
    return v.table(spark, d, "part").select("p_partkey", fl.horizon_label(F.col("p_size").cast("int")).alias("label"))


@query("f6_f9_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, cast(o_orderdate as date) + 45 as later, date_diff('second', timestamp '1992-01-01 00:00:00', o_orderdate) as seconds from orders")
def dates(spark, d):
    day = F.col("o_orderdate")
    return v.table(spark, d, "orders").select(
        "o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("iso"), F.date_add(day.cast("date"), 45).alias("later"), F.timestamp_diff("SECOND", F.lit("1992-01-01 00:00:00").cast("timestamp_ntz"), day).alias("seconds")
    )


@query("f7_release_date", "select o_orderkey, cast(o_orderdate as date) + case o_orderpriority when '1-URGENT' then 45 when '2-HIGH' then 30 else 1 end as release from orders")
def release(spark, d):
    from pitframe.operators.asof import release_date

    return v.table(spark, d, "orders").select("o_orderkey", release_date(F.col("o_orderdate").cast("date"), F.col("o_orderpriority"), {"1-URGENT": 45, "2-HIGH": 30}).alias("release"))


@query("f8_calendar", "select cast(unnest(generate_series(min(cast(o_orderdate as date)), max(cast(o_orderdate as date)), interval 1 day)) as date) as day from orders")
def calendar(spark, d):
    day = F.col("o_orderdate").cast("date")
    return v.table(spark, d, "orders").agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))


@query("f10_f12_math", "select p_partkey, round(sqrt(p_retailprice), 6) as root, round(least(greatest(p_size / 50.0, 0.1), 0.9), 6) as clipped, floor(p_retailprice / 7) as f, sign(p_size - 25) as s, round(p_retailprice * 10 / 10000, 6) as cost, round(power(p_size, 1.5), 6) as pw from part")
def math(spark, d):
    x, s = F.col("p_retailprice"), F.col("p_size")
    return v.table(spark, d, "part").select(
        "p_partkey", F.round(F.sqrt(x), 6).alias("root"), F.round(F.least(F.greatest(s / 50.0, F.lit(0.1)), F.lit(0.9)), 6).alias("clipped"), F.floor(x / 7).cast("double").alias("f"),
        F.sign(s - 25).alias("s"), F.round(x * 10 / 10000, 6).alias("cost"), F.round(F.pow(s, F.lit(1.5)), 6).alias("pw"),
    )


_SIGNAL = "case when prob >= 0.6 and expected_alpha > 0 then 'long' when prob <= 0.4 and expected_alpha < 0 then 'short' when prob >= 0.55 then 'overweight' when prob <= 0.45 then 'underweight' else 'neutral' end"


@query("f13_signal", PREDS + f"select id, {_SIGNAL} as signal from predictions")
def signal(spark, d):
    return v.predictions(spark, d).select("id", fl.signal("prob", "expected_alpha").alias("signal"))


@query("f14_f16_labels", PREDS + """select id, case when prob * 4 > 2 then 'hawkish / higher-for-longer' when prob * 4 < 1 then 'dovish / easing bias' else 'neutral' end as fed, case when expected_alpha > 0.02 then 'strong' when expected_alpha < -0.02 then 'weak' else 'moderate' end as dollar,
  case when prob * 4 > 2.5 then 'elevated' when prob * 4 < 2 then 'cooling' else 'moderate' end as inflation, case when prob > 0.55 then 'bullish' when prob < 0.45 then 'bearish' else 'neutral' end as gold from predictions""")  # fmt: skip
def labels(spark, d):
    y = F.col("prob") * 4
    gold = F.when(F.col("prob") > 0.55, "bullish").when(F.col("prob") < 0.45, "bearish").otherwise("neutral")
    return v.predictions(spark, d).select("id", fl.fed_bias(y).alias("fed"), fl.dollar_strength(F.col("expected_alpha")).alias("dollar"), fl.inflation_label(y).alias("inflation"), gold.alias("gold"))


@query("f17_f18_collections", "select p_brand, list_sum(list_slice(list_reverse_sort(list(p_size)), 1, 4)) as top4, coalesce(max(p_size) filter (p_type = 'PROMO'), 0) as promo from part group by 1")
def collections(spark, d):
    got = v.table(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list("p_size"), False).alias("s"), F.max(F.when(F.col("p_type") == "PROMO", F.col("p_size"))).alias("p"))
    m = F.create_map(F.lit("PROMO"), F.col("p"))
    return got.select("p_brand", F.aggregate(F.slice("s", 1, 4), F.lit(0).cast("long"), lambda a, x: a + x).alias("top4"), F.coalesce(F.element_at(m, F.lit("PROMO")), F.lit(0)).alias("promo"))


@query("f19_json", "select event_id, cast(json_extract(props, '$.k') as integer) as k from events")
def json(spark, d):
    return v.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("f20_display", "select id, (case when expected_return >= 0 then '+' else '' end) || format('{:.1f}', expected_return * 100) || '%' as shown from predictions where abs(expected_return * 1000 - round(expected_return * 1000)) < 1e-9".replace("select id", PREDS + "select id"))
def display(spark, d):
    return v.predictions(spark, d).select("id", ft.percent(F.col("expected_return")).alias("shown"))


QUERIES, ORACLES = query.queries, query.oracles
