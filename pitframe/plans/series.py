"""Point-in-time reads, as-of joins and row windows over the binding views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitframe.operators import asof, features, scans, windows
from pitframe.operators.windows import Series
from pitframe.plans.registry import Registry
from pitframe.sources import views as v
from pitframe.sources.views import with_views

query = Registry()
S = Series()
PX = with_views("prices")
_W = "over (partition by symbol order by date)"


def _frame(n: int) -> str:
    return f"over (partition by symbol order by date rows between {n - 1} preceding and current row)"


@query("j5_prices_asof", PX + "select date, symbol, round(close, 6) as close, release_date from prices")
def prices_asof(spark, d):
    return v.prices(spark, d).select("date", "symbol", F.round("close", 6).alias("close"), "release_date")


@query("j5_latest_return_asof", PX + f"""select symbol, date, round(r, 6) as ret_20 from (select symbol, date, close / nullif(lag(close, 20) {_W}, 0) - 1 as r,
  row_number() over (partition by symbol order by date desc) as rn from prices) where rn = 1""")  # fmt: skip
def latest_return(spark, d):
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return v.prices(spark, d).select("symbol", "date", S.change(F.col("close"), 20).alias("r"), last.alias("rn")).where("rn = 1").select("symbol", "date", F.round("r", 6).alias("ret_20"))


TIMES = ("1994-06-30", "1996-06-30", "1998-06-30")
_TIMES_SQL = "(values " + ", ".join(f"(date '{t}')" for t in TIMES) + ") t(as_of)"


@query("j5_many_asof", with_views("obs") + f"""select as_of, symbol, count(*) as n, round(sum(close), 2) as total from (select as_of, o.*, row_number() over (partition by as_of, date, symbol order by
  release_date desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, close desc) as rn from obs o join {_TIMES_SQL} on release_date <= as_of) where rn = 1 group by 1, 2""")  # fmt: skip
def many_asof(spark, d):
    times = spark.createDataFrame([(date.fromisoformat(t),) for t in TIMES], "as_of date")
    spans = asof.vintage_intervals(v.obs(spark, d), ["date", "symbol"], v.VINTAGE_ORDER, "release_date")
    return asof.history_at(spans, times, "as_of").groupBy("as_of", "symbol").agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("total"))


@query("j5_vintage_intervals", with_views("obs") + """, s as (select date, symbol, release_date as valid_from, lead(release_date) over (partition by date, symbol order by
  release_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, close) as valid_to, close from obs)
  select date, symbol, valid_from, valid_to, round(close, 6) as close from s where valid_to is null or valid_to > valid_from""")  # fmt: skip
def intervals(spark, d):
    spans = asof.vintage_intervals(v.obs(spark, d), ["date", "symbol"], v.VINTAGE_ORDER, "release_date")
    return spans.select("date", "symbol", "valid_from", "valid_to", F.round("close", 6).alias("close"))


@query("p4_known_at", with_views("obs") + f"select symbol, count(*) as n, max(release_date) as latest from obs where release_date <= date '{v.AS_OF}' group by 1")
def known(spark, d):
    return asof.known_at(v.obs(spark, d), "release_date", v.AS_OF).groupBy("symbol").agg(F.count("*").alias("n"), F.max("release_date").alias("latest"))


@query("w1_returns", PX + "select symbol, date, " + ", ".join(f"round(close / nullif(lag(close, {n}) {_W}, 0) - 1, 6) as ret_{n}" for n in (5, 10, 20, 60, 63, 126)) + " from prices")
def returns(spark, d):
    return v.prices(spark, d).select("symbol", "date", *[F.round(S.change(F.col("close"), n), 6).alias(f"ret_{n}") for n in (5, 10, 20, 60, 63, 126)])


_R1 = PX + f", r as (select symbol, date, close, close / nullif(lag(close) {_W}, 0) - 1 as ret from prices)\n"


@query("w2_volatility", _R1 + "select symbol, date, " + ", ".join(f"round(case when count(ret) {_frame(n)} >= {n} then stddev_samp(ret) {_frame(n)} end * sqrt(252.0), 6) as vol_{n}" for n in (20, 63)) + " from r")
def volatility(spark, d):
    r = v.prices(spark, d).withColumn("ret", S.change(F.col("close"), 1))
    return r.select("symbol", "date", *[F.round(S.volatility(F.col("ret"), n), 6).alias(f"vol_{n}") for n in (20, 63)])


@query("w3_distance_from_mean", PX + f"select symbol, date, round(close / case when count(close) {_frame(200)} >= 100 then avg(close) {_frame(200)} end - 1, 6) as dist_200 from prices")
def distance(spark, d):
    return v.prices(spark, d).select("symbol", "date", F.round(S.from_mean(F.col("close")), 6).alias("dist_200"))


_Z = f"(close - case when count(close) {_frame(60)} >= 60 then avg(close) {_frame(60)} end) / (case when count(close) {_frame(60)} >= 60 then stddev_samp(close) {_frame(60)} end + 1e-8)"


@query("w4_zscore", PX + f"select symbol, date, round({_Z}, 6) as z_60 from prices")
def zscore(spark, d):
    return v.prices(spark, d).select("symbol", "date", F.round(S.zscore(F.col("close")), 6).alias("z_60"))


@query("w8_difference", PX + f"select symbol, date, round(close - lag(close, 20) {_W}, 6) as diff_20 from prices")
def difference(spark, d):
    return v.prices(spark, d).select("symbol", "date", F.round(S.diff(F.col("close"), 20), 6).alias("diff_20"))


_WIDE = PX + f""", wide as (select date, max(close) filter (symbol = '{v.GOLD}') as gold, max(close) filter (symbol = '{v.BENCHMARK}') as bench from prices group by 1)\n"""


def wide(spark: SparkSession, d: str, names: tuple[str, ...] = (v.GOLD, v.BENCHMARK)) -> DataFrame:
    """A row per date with the closes of a few symbols; the pivot's values are given, so nothing is scanned for them."""
    return v.prices(spark, d).groupBy("date").pivot("symbol", list(names)).agg(F.max("close"))


_FF = "last_value({0} ignore nulls) over (order by date rows between unbounded preceding and {1})"


@query("w9_filled_trend", _WIDE + f"""select date, round({_FF.format('gold', 'current row')} / nullif({_FF.format('gold', '20 preceding')}, 0) - 1, 6) as gold_20,
  round({_FF.format('gold', 'current row')} / nullif({_FF.format('gold', '20 preceding')}, 0) - {_FF.format('bench', 'current row')} / nullif({_FF.format('bench', '20 preceding')}, 0), 6) as spread_20 from wide""")  # fmt: skip
def filled_trend(spark, d):
    w = wide(spark, d).withColumn("k", F.lit(0))
    one = Series(by=("k",))
    gold, bench = one.filled_change(F.col(v.GOLD), 20), one.filled_change(F.col(v.BENCHMARK), 20)
    return w.select("date", F.round(gold, 6).alias("gold_20"), F.round(gold - bench, 6).alias("spread_20"))


def _f1(n: int) -> str:
    return f"over (order by date rows between {n - 1} preceding and current row)"


@query("w10_ratio_zscore", _WIDE + f""", q as (select date, gold / nullif(bench, 0) as ratio from wide)
  select date, round(ratio, 6) as ratio, round((ratio - case when count(ratio) {_f1(60)} >= 60 then avg(ratio) {_f1(60)} end) / (case when count(ratio) {_f1(60)} >= 60 then stddev_samp(ratio) {_f1(60)} end + 1e-8), 6) as ratio_z from q""")  # fmt: skip
def ratio(spark, d):
    q = wide(spark, d).select("date", F.try_divide(v.GOLD, v.BENCHMARK).alias("ratio"), F.lit(0).alias("k"))
    return q.select("date", F.round("ratio", 6).alias("ratio"), F.round(Series(by=("k",)).zscore(F.col("ratio")), 6).alias("ratio_z"))


_B = "over (partition by symbol order by date rows between 59 preceding and current row)"


@query("w11_rolling_beta", _R1 + f""", b as (select r.symbol, r.date, case when r.ret is not null and g.ret is not null then r.ret end as ret, case when r.ret is not null and g.ret is not null then g.ret end as gr
  from r left join r g on g.symbol = '{v.GOLD}' and g.date = r.date where r.symbol <> '{v.GOLD}')
  select symbol, date, round(case when count(ret) {_B} >= 60 then covar_samp(ret, gr) {_B} / (var_samp(gr) {_B} + 1e-8) end, 6) as beta_60 from b""")  # fmt: skip
def beta(spark, d):
    r = v.prices(spark, d).select("symbol", "date", S.change(F.col("close"), 1).alias("ret"))
    g = r.where(F.col("symbol") == v.GOLD).select("date", F.col("ret").alias("gr"))
    j = r.where(F.col("symbol") != v.GOLD).join(g, "date", "left")
    return j.select("symbol", "date", F.round(S.beta(F.col("ret"), F.col("gr")), 6).alias("beta_60"))


@query("w12_forward_return", PX + "select symbol, date, " + ", ".join(f"round(lead(close, {h}) {_W} / nullif(close, 0) - 1, 6) as fwd_{h}" for h in v.HORIZONS) + " from prices")
def forward(spark, d):
    return v.prices(spark, d).select("symbol", "date", *[F.round(S.forward(F.col("close"), h), 6).alias(f"fwd_{h}") for h in v.HORIZONS])


_M = "over (partition by country order by month rows between 11 preceding and current row)"


@query("w14_rolling_year", with_views("monthly") + f"""select month, country, round(sum(purchase) {_M}, 2) as rolling_12, round((purchase / nullif(lag(purchase, 12) over (partition by country order by month), 0) - 1) * 100, 4) as yoy_pct from monthly""")
def rolling_year(spark, d):
    m = Series(by=("country",), order=("month",))
    x = F.col("purchase")
    return v.monthly(spark, d).select("month", "country", F.round(F.sum(x).over(m.last_rows(12)), 2).alias("rolling_12"), F.round(m.change(x, 12) * 100, 4).alias("yoy_pct"))


def _fl(n: int) -> str:
    return f"over (partition by ticker order by date rows between {n - 1} preceding and current row)"


@query("w15_rolling_flows", with_views("flows") + f"""select date, ticker, round(sum(daily_flow) {_fl(5)}, 4) as weekly, round(case when count(daily_flow) {_fl(30)} >= 5 then avg(daily_flow) {_fl(30)} end, 4) as avg_30,
  round(case when count(daily_flow) {_fl(60)} >= 10 then avg(daily_flow) {_fl(60)} end, 4) as avg_60 from flows""")  # fmt: skip
def rolling_flows(spark, d):
    f, x = Series(by=("ticker",)), F.col("daily_flow")
    return v.flows(spark, d).select(
        "date", "ticker", F.round(F.sum(x).over(f.last_rows(5)), 4).alias("weekly"),
        F.round(f.full(F.avg(x), x, 30, 5), 4).alias("avg_30"), F.round(f.full(F.avg(x), x, 60, 10), 4).alias("avg_60"),
    )


@query("w16_flow_proxy", PX + f""", r as (select *, close / nullif(lag(close) {_W}, 0) - 1 as ret, avg(close) over (partition by symbol) as mean_close from prices)
  select symbol, date, round(ret * volume * close / 1e6, 8) as flow_by_volume, round(coalesce(ret, 0) * 1e8 * mean_close / 1e9, 6) as flow_by_shares, round(close * 1e8 / 1e9, 6) as aum from r""")  # fmt: skip
def flow_proxy(spark, d):
    shares = 1e8
    r = v.prices(spark, d).select("*", S.change(F.col("close"), 1).alias("ret"), F.avg("close").over(Window.partitionBy("symbol")).alias("mean_close"))
    return r.select(
        "symbol", "date", F.round(F.col("ret") * F.col("volume") * F.col("close") / 1e6, 8).alias("flow_by_volume"),
        F.round(F.coalesce("ret", F.lit(0.0)) * shares * F.col("mean_close") / 1e9, 6).alias("flow_by_shares"), F.round(F.col("close") * shares / 1e9, 6).alias("aum"),
    )


@query("w17_first_per_key", with_views("obs") + """select date, symbol, release_date, round(close, 6) as close from (select *, row_number() over (partition by date, symbol order by release_date desc nulls last,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, close) as rn from obs) where rn = 1""")  # fmt: skip
def first_per_key(spark, d):
    w = Window.partitionBy("date", "symbol").orderBy(F.desc_nulls_last("release_date"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "close")
    return v.obs(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("date", "symbol", "release_date", F.round("close", 6).alias("close"))


_LIVE = "(model_version is null or model_version not like 'asof\\_h%' escape '\\')"


@query("w18_latest_live", with_views("predictions") + f"""select entity, horizon_days, id, date, prob from (select *, row_number() over (partition by entity, horizon_days order by date desc, id desc) as rn
  from predictions where {_LIVE}) where rn = 1""")  # fmt: skip
def latest_live(spark, d):
    from pitframe.functions.labels import is_live

    w = Window.partitionBy("entity", "horizon_days").orderBy(F.desc("date"), F.desc("id"))
    return v.predictions(spark, d).where(is_live("model_version")).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("entity", "horizon_days", "id", "date", "prob")


_T30 = """k as (select date, row_number() over (order by date) as rn, gold, bench, bench / nullif(lag(bench) over (order by date), 0) - 1 as br from wide),
  cal as (select cast(unnest(generate_series(date '1996-01-01', date '1996-03-31', interval 1 day)) as date) as day),
  upto as (select day, max(rn) as rn from cal join k on k.date <= cal.day group by 1),
  win as (select upto.day, upto.rn as end_rn, k.rn, gold, case when k.rn > upto.rn - 29 then bench / nullif(b0, 0) - 1 end as br from upto join (select *, lag(bench) over (order by date) as b0 from k) k on k.rn between upto.rn - 29 and upto.rn),
  agg as (select day, arg_max(gold, rn) filter (gold is not null) as last_gold, avg(gold) as mean_gold, stddev_samp(gold) as sd_gold, count(gold) as n_gold, stddev_samp(br) * 100 as vol from win group by 1),
  s as (select day, case when n_gold > 1 then (last_gold - mean_gold) / (sd_gold + 1e-6) else 0 end as z, coalesce(vol, 0) as vol from agg),
  g as (select day, greatest(0.0, least(1.0, 0.3 + 0.15 * z + 0.1 * vol)) as gpr, vol from s)"""


@query("w19_risk_proxy", _WIDE + f""", {_T30}
  select day, round(gpr, 6) as gpr_index, round(gpr * 0.9, 6) as conflict_intensity, round(least(1.0, vol / 5), 6) as oil_disruption from g""")  # fmt: skip
def risk_proxy(spark, d):
    from pitframe.operators.risk import rolling_risk

    panel = wide(spark, d).select("date", F.col(v.GOLD).alias("fear"), F.col(v.BENCHMARK).alias("oil"))
    got = rolling_risk(panel, date(1996, 1, 1), date(1996, 3, 31))
    return got.select("day", *[F.round(c, 6).alias(c) for c in ("gpr_index", "conflict_intensity", "oil_disruption")])


@query("w20_wealth_drawdown", _R1 + f""", w as (select symbol, date, exp(sum(ln(1 + ret / 100)) {_W}) as wealth from r where ret is not null),
  p as (select *, max(wealth) {_W} as peak from w) select symbol, date, round(wealth, 6) as wealth, round(peak, 6) as peak, round(wealth / peak - 1, 6) as drawdown from p""")  # fmt: skip
def wealth(spark, d):
    r = v.prices(spark, d).select("symbol", "date", (S.change(F.col("close"), 1) / 100).alias("ret")).where("ret is not null")
    w = r.withColumn("wealth", S.wealth(F.col("ret"))).withColumn("peak", S.peak(F.col("wealth")))
    return w.select("symbol", "date", F.round("wealth", 6).alias("wealth"), F.round("peak", 6).alias("peak"), F.round(F.col("wealth") / F.col("peak") - 1, 6).alias("drawdown"))


@query("w21_turnover", _R1 + f""", p as (select symbol, date, case when ret > 0 then 1 else 0 end as pos from r where ret is not null)
  select symbol, date, pos, case when lag(pos) {_W} is not null and pos <> lag(pos) {_W} then 0.001 else 0.0 end as cost from p""")  # fmt: skip
def turnover(spark, d):
    p = v.prices(spark, d).select("symbol", "date", S.change(F.col("close"), 1).alias("ret")).where("ret is not null").withColumn("pos", (F.col("ret") > 0).cast("int"))
    return p.select("symbol", "date", "pos", S.turnover_cost(F.col("pos"), 0.001).alias("cost"))


@query("w22_rank_share", with_views("scores") + """select id, round(case when p is not null then (rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0) / count(p) over () end, 8) as share from scores""")
def rank_share(spark, d):
    return scans.rank_shares(v.scores(spark, d), "p", "share").select("id", F.round("share", 8).alias("share"))


@query("w23_rank_of_all", PX + "select symbol, date, row_number() over (order by close desc, symbol, date) as rank from prices")
def rank_of_all(spark, d):
    p = v.prices(spark, d).select("symbol", "date", (-F.col("close")).alias("down"))
    return scans.row_ranks(p, ["down", "symbol", "date"], "rank").select("symbol", "date", "rank")


@query("w23_row_rank", PX + "select date, symbol, row_number() over (partition by date order by close desc, symbol) as rank from prices")
def row_rank(spark, d):
    return v.prices(spark, d).select("date", "symbol", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("close"), "symbol")).alias("rank"))


@query("w24_rebase", PX + f""", t as (select *, row_number() over (partition by symbol order by date desc) as back from prices)
  select symbol, date, round(100 * close / first_value(close ignore nulls) over (partition by symbol order by date rows between unbounded preceding and unbounded following), 6) as indexed from t where back <= 120""")  # fmt: skip
def rebase(spark, d):
    last = v.prices(spark, d).withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("back <= 120")
    start = F.first("close", ignorenulls=True).over(S.base.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return last.select("symbol", "date", F.round(100 * F.col("close") / start, 6).alias("indexed"))


@query("w25_carry_forward", _WIDE + "select date, round(last_value(gold ignore nulls) over (order by date rows between unbounded preceding and current row), 6) as gold from wide")
def carry(spark, d):
    w = Window.partitionBy("k").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return wide(spark, d).withColumn("k", F.lit(0)).select("date", F.round(F.last(v.GOLD, ignorenulls=True).over(w), 6).alias("gold"))


@query("w26_trailing_own_rows", PX + f"""select symbol, max(date) as date, round(arg_max(close / c10 - 1, date), 6) as trail_10, round(arg_max((close / c20 - 1) * 100, date), 6) as pct_20 from
  (select *, lag(close, 10) {_W} as c10, lag(close, 20) {_W} as c20 from prices) where c20 is not null group by 1""")  # fmt: skip
def trailing(spark, d):
    t = v.prices(spark, d).select("symbol", "date", S.change(F.col("close"), 10).alias("a"), (S.change(F.col("close"), 20) * 100).alias("b")).where("b is not null")
    return t.groupBy("symbol").agg(F.max("date").alias("date"), F.round(F.max_by("a", "date"), 6).alias("trail_10"), F.round(F.max_by("b", "date"), 6).alias("pct_20"))


@query("w27_every_kth", PX + f"select symbol, date from (select symbol, date, row_number() {_W} as rn, count(*) over (partition by symbol) as n from prices) where (rn - 1) % 10 = 0 or rn = n")
def every_kth(spark, d):
    return v.prices(spark, d).select("symbol", "date", S.every(10).alias("taken")).where("taken").drop("taken")


@query("w28_momentum", _R1 + f""", m as (select symbol, date, close / nullif(lag(close, 20) {_W}, 0) - 1 as m20 from prices)
  select a.symbol, a.date, round(a.m20 - b.m20, 6) as momentum from m a join m b on b.symbol = '{v.BENCHMARK}' and a.date = b.date where a.symbol <> '{v.BENCHMARK}'""")  # fmt: skip
def momentum(spark, d):
    m = v.prices(spark, d).select("symbol", "date", S.change(F.col("close"), 20).alias("m"))
    b = m.where(F.col("symbol") == v.BENCHMARK).select("date", F.col("m").alias("b"))
    return m.where(F.col("symbol") != v.BENCHMARK).join(b, "date").select("symbol", "date", F.round(F.col("m") - F.col("b"), 6).alias("momentum"))


@query("w29_quarter_surprise", """with q as (select o_custkey % 50 as ticker, cast(date_trunc('quarter', o_orderdate) as date) as quarter_end, sum(o_totalprice) as production, avg(o_totalprice) as aisc from orders group by 1, 2),
  l as (select *, production / nullif(lag(production) over w, 0) - 1 as ps, -(aisc / nullif(lag(aisc) over w, 0) - 1) as cs, row_number() over (partition by ticker order by quarter_end desc) as back from q window w as (partition by ticker order by quarter_end))
  select ticker, quarter_end, round(ps, 6) as production_surprise, round(cs, 6) as cost_surprise from l where back = 1""")  # fmt: skip
def surprise(spark, d):
    q = v.table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("ticker"), F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("quarter_end"))
    q = q.agg(F.sum("o_totalprice").alias("production"), F.avg("o_totalprice").alias("aisc"))
    s = Series(by=("ticker",), order=("quarter_end",))
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("quarter_end")))
    got = q.select("ticker", "quarter_end", F.round(s.change(F.col("production"), 1), 6).alias("production_surprise"), F.round(-s.change(F.col("aisc"), 1), 6).alias("cost_surprise"), back.alias("back"))
    return got.where("back = 1").drop("back")


@query("w30_calendar_change", PX + f"""select symbol, round(arg_max(close, date) / nullif(arg_min(close, date), 0) - 1, 6) as change from prices where date >= date '{v.AS_OF}' - 30 and date <= date '{v.AS_OF}' group by 1""")
def calendar_change(spark, d):
    p = v.prices(spark, d).where(F.col("date").between(F.date_sub(F.lit(v.AS_OF), 30), F.lit(v.AS_OF)))
    return p.groupBy("symbol").agg(F.round(F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1, 6).alias("change"))


_EMA = """with recursive {views}, n as (select symbol, date, close, row_number() over (partition by symbol order by date) as k, close - lag(close) over (partition by symbol order by date) as d from prices),
  e as (select symbol, date, k, close, cast(null as double) as up, cast(null as double) as down, cast(null as double) as rng, close as f, close as s, 0.0::double as macd, cast(null as double) as sig from n where k = 1
  union all select n.symbol, n.date, n.k, n.close, case when n.k = 2 then greatest(d, 0) else e.up * 13 / 14 + greatest(d, 0) / 14 end, case when n.k = 2 then greatest(-d, 0) else e.down * 13 / 14 + greatest(-d, 0) / 14 end,
    case when n.k = 2 then abs(d) else e.rng * 13 / 14 + abs(d) / 14 end, e.f * 11 / 13 + n.close * 2 / 13, e.s * 25 / 27 + n.close * 2 / 27,
    (e.f * 11 / 13 + n.close * 2 / 13) - (e.s * 25 / 27 + n.close * 2 / 27),
    case when n.k < 26 then null when n.k = 26 then (e.f * 11 / 13 + n.close * 2 / 13) - (e.s * 25 / 27 + n.close * 2 / 27) else e.sig * 8 / 10 + ((e.f * 11 / 13 + n.close * 2 / 13) - (e.s * 25 / 27 + n.close * 2 / 27)) * 2 / 10 end
    from e join n on n.symbol = e.symbol and n.k = e.k + 1)
  select symbol, date, round(case when k > 14 then case when down = 0 then 1.0 else 1 - 1 / (1 + up / down) end end, 6) as rsi, round(case when k > 14 then rng / close end, 6) as atr,
    round(case when k > 33 then (macd - sig) / close end, 6) as macd_diff from e""".replace("{views}", with_views("prices").removeprefix("with "))  # fmt: skip


@query("w5_w6_w7_oscillators", _EMA)
def oscillators(spark, d):
    got = windows.oscillators(v.prices(spark, d), ["symbol"], "date", "close")
    return got.select("symbol", "date", *[F.round(c, 6).alias(c) for c in ("rsi", "atr", "macd_diff")])


@query("w5_w6_w7_all_series", _EMA.replace("select symbol, date, round(case", "select symbol, date, round(close, 6) as close, round(case"))
def oscillators_all(spark, d):
    """The same averages, dealt into slices of a month."""
    got = windows.oscillators(v.prices(spark, d), ["symbol"], "date", "close", every="month")
    return got.select("symbol", "date", *[F.round(c, 6).alias(c) for c in ("close", "rsi", "atr", "macd_diff")])


_ROLES = {"gold": v.GOLD, "oil": "MEDIUM", "copper": "SMALL", "spx": v.BENCHMARK, "real": "SMALL", "dollar": "LARGE", "vix": "PROMO", "breakeven": "MEDIUM"}
_MINERS = ("LARGE", "MEDIUM")


def _full(agg: str, x: str, n: int, least: int | None = None, by: str = "partition by symbol ") -> str:
    w = f"over ({by}order by date rows between {n - 1} preceding and current row)"
    return f"(case when count({x}) {w} >= {least or n} then {agg}({x}) {w} end)"


def _zs(x: str, by: str = "partition by symbol ") -> str:
    return f"({x} - {_full('avg', x, 60, by=by)}) / ({_full('stddev_samp', x, 60, by=by)} + 1e-8)"


def _lagged(x: str, n: int, by: str = "partition by symbol ") -> str:
    return f"{x} / nullif(lag({x}, {n}) over ({by}order by date), 0) - 1"


_PRICE_SQL = {
    **{f"ret_{n}d": _lagged("close", n) for n in features.RETURNS}, **{f"vol_{n}d": _full("stddev_samp", "ret", n) + " * sqrt(252)" for n in (20, 63)},
    "dist_200dma": f"close / nullif({_full('avg', 'close', 200, 100)}, 0) - 1", "momentum_60d": _lagged("close", 60), "zscore_60d": _zs("close"),
}
_MARKET_SQL = {
    **{f"gold_{r}_ratio": f"gold_{r}" for r in ("oil", "copper", "spx")}, **{f"gold_{r}_ratio_zscore": _zs(f"gold_{r}", "") for r in ("oil", "copper", "spx")},
    "real_yield": "real", "real_yield_trend_20d": "real - lag(real, 20) over (order by date)", "real_yield_zscore": _zs("real", ""), "dxy_trend_20d": _lagged("dollar", 20, ""), "dxy_zscore": _zs("dollar", ""),
    "vix_level": "vix", "vix_zscore": _zs("vix", ""), "breakeven_inflation": "breakeven", "inflation_trend_20d": "breakeven - lag(breakeven, 20) over (order by date)",
}
_B60 = "over (partition by symbol order by date rows between 59 preceding and current row)"
_STORE = PX + f""", rr as (select symbol, date, close, {_lagged('close', 1)} as ret from prices), pf as (select symbol, date, count(close) over (partition by symbol) as n, {", ".join(f"{x} as {k}" for k, x in _PRICE_SQL.items())} from rr),
  os as ({_EMA}), w as (select date, {", ".join(f"max(close) filter (symbol = '{s}') as {r}" for r, s in _ROLES.items())} from prices where symbol in ({", ".join(f"'{s}'" for s in sorted(set(_ROLES.values())))}) group by 1),
  wr as (select *, {", ".join(f"gold / nullif({r}, 0) as gold_{r}" for r in ("oil", "copper", "spx"))} from w), mf as (select date, {", ".join(f"{x} as {k}" for k, x in _MARKET_SQL.items())} from wr),
  mb as (select m.symbol, m.date, case when m.ret is not null and g.ret is not null then m.ret end as a, case when m.ret is not null and g.ret is not null then g.ret end as b from rr m left join rr g on g.symbol = '{v.GOLD}' and g.date = m.date where m.symbol in {_MINERS}),
  bt as (select symbol, date, case when count(a) {_B60} >= 60 then covar_samp(a, b) {_B60} / (var_samp(b) {_B60} + 1e-8) end as beta from mb),
  q as (select case o_custkey % 3 when 0 then 'LARGE' when 1 then 'MEDIUM' else 'OTHER' end as ticker, cast(date_trunc('quarter', o_orderdate) as date) as quarter_end, cast(sum(o_totalprice) as double) as p, cast(avg(o_totalprice) as double) as a, count(*) % 7 as m from orders group by 1, 2),
  qs as (select ticker, p / nullif(lag(p) over (partition by ticker order by quarter_end), 0) - 1 as ps, -(a / nullif(lag(a) over (partition by ticker order by quarter_end), 0) - 1) as cs, m, row_number() over (partition by ticker order by quarter_end desc) as back, count(*) over (partition by ticker) as n from q),
  ql as (select q.ticker, e.date, ps, cs, m from qs q join (select symbol, max(date) as date from prices group by 1) e on e.symbol = q.ticker where back = 1 and n > 1 and ticker in {_MINERS}),
  al as (select symbol as entity, date, unnest([{", ".join(f"'{k}'" for k in _PRICE_SQL)}]) as feature_name, unnest([{", ".join(_PRICE_SQL)}]) as x from pf
  union all select os.symbol, os.date, unnest(['atr_14', 'rsi_14', 'macd']), unnest([atr, rsi, macd_diff]) from os join (select distinct symbol, n from pf where n > 30) using (symbol)
  union all select 'MACRO', date, unnest([{", ".join(f"'{k}'" for k in _MARKET_SQL)}]), unnest([{", ".join(_MARKET_SQL)}]) from mf
  union all select symbol, date, 'beta_to_gold_60d', beta from bt union all select ticker, date, unnest(['prod_surprise', 'aisc_surprise', 'revision_momentum']), unnest([ps, cs, m]) from ql)
  select entity, date, feature_name, round(x, 6) as feature_value from al where x is not null"""


@query("m11_m12_whole_store", _STORE)
def whole_store(spark, d):
    """Every feature of every series, of the market and of two miners, with their last quarters."""
    ticker = F.when(F.col("o_custkey") % 3 == 0, "LARGE").when(F.col("o_custkey") % 3 == 1, "MEDIUM").otherwise("OTHER")
    q = v.table(spark, d, "orders").groupBy(ticker.alias("ticker"), F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("quarter_end"))
    q = q.agg(F.sum("o_totalprice").alias("production_oz"), F.avg("o_totalprice").alias("aisc_per_oz"), (F.count("*") % 7).alias("analyst_eps_revision"))
    got = features.store(v.prices(spark, d), _ROLES, _MINERS, q)
    return got.withColumn("feature_value", F.round("feature_value", 6))


@query("j3_price_at_or_before", PX + """, days as (select distinct p_type as symbol, cast(l_shipdate as date) as day from lineitem join part on l_partkey = p_partkey)
  select d.symbol, d.day, p.close from days d asof left join prices p on p.symbol = d.symbol and d.day >= p.date""")  # fmt: skip
def price_at(spark, d):
    """Closes in force on the days on which something of the symbol was shipped."""
    shipped = v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_shipdate").cast("date").alias("day"))
    probes = shipped.join(v.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("symbol")), "p_partkey").select("symbol", "day").distinct()
    return asof.asof_backward(probes, v.prices(spark, d), ["symbol"], "day", "date", ["close"]).select("symbol", "day", "close")


@query("j4_regime_in_force", with_views("regimes") + """, days as (select distinct cast(o_orderdate as date) as day from orders)
  select day, coalesce(case regime_id when 1 then 'bearish' when 2 then 'bullish' when 3 then 'bullish' when 4 then 'bullish' end, 'neutral') as bias from days d asof left join regimes r on d.day >= r.date""")  # fmt: skip
def regime_at(spark, d):
    from pitframe.sources.seeds import regime_hypotheses

    days = v.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    got = asof.asof_backward(days, v.regimes(spark, d), [], "day", "date", ["regime_id"])
    bias = F.broadcast(regime_hypotheses(spark).select("regime_id", "gold_bias"))
    return got.join(bias, "regime_id", "left").select("day", F.coalesce("gold_bias", F.lit("neutral")).alias("bias"))


QUERIES, ORACLES = query.queries, query.oracles
