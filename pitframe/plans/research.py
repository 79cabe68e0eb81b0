"""Labels, folds, inference, books, portfolios, graphs and paper accounts over the binding views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitframe.operators import graph, inference, labels, paper, portfolio, stats
from pitframe.operators.windows import Series
from pitframe.plans.registry import Registry
from pitframe.sources import seeds
from pitframe.sources import views as v
from pitframe.sources.views import with_views

query = Registry()
PX = with_views("prices")
_W = "over (partition by symbol order by date)"
PEER = "PROMO"
_TARGETS = f"""f as (select symbol, date, lead(close, 10) {_W} / nullif(close, 0) - 1 as f from prices),
  t as (select a.date, a.f as forward_return, cast(coalesce(a.f > g.f, false) as int) as outperform_gold, cast(coalesce(a.f > p.f, false) as int) as beat_peer from f a left join f g on g.symbol = '{v.GOLD}' and g.date = a.date
  left join f p on p.symbol = '{PEER}' and p.date = a.date where a.symbol = '{v.BENCHMARK}' and a.f is not null)"""


@query("w13_targets", PX + f", {_TARGETS} select date, round(forward_return, 6) as forward_return, outperform_gold, beat_peer from t")
def targets(spark, d):
    return labels.targets(v.prices(spark, d), v.BENCHMARK, v.GOLD, PEER, 10).withColumn("forward_return", F.round("forward_return", 6))


_SIZES = "z as (select symbol, year(date) as year, count(*) as n from prices group by 1, 2)"


def _sizes(spark, d):
    """Rows of each series and year, at each horizon."""
    n = v.prices(spark, d).groupBy("symbol", F.year("date").cast("long").alias("year")).agg(F.count("*").alias("n"))
    return n.withColumn("horizon_days", F.explode(F.array(*map(F.lit, v.HORIZONS))))


_FOLDS = "select cast((s - 50) / 10 as int) as fold, s - 50 as train_lo, s - 10 as train_hi, s as test_lo, s + 1 as test_hi from (select unnest(range(50, 120, 10)) as s)"


@query("m1_walk_forward", PX + """select symbol, cast((s - 50) / 10 as int) as fold, s - 50 as train_lo, s - 10 as train_hi, s as test_lo, s + 1 as test_hi from (select symbol, unnest(range(50, n, 10)) as s from (select symbol, count(*) as n from prices group by 1))""")
def walk_forward(spark, d):
    return labels.series_folds(v.prices(spark, d).groupBy("symbol").agg(F.count("*").alias("n")), labels.Walk(40, 1, 10, 10))


@query("m2_fitted_walk", PX + f""", {_SIZES}, h as (select *, unnest({list(v.HORIZONS)}) as horizon_days from z),
  c as (select *, unnest(range(24)) as k, least(252, greatest(40, floor(n * 0.55))) as a, least(42, greatest(10, floor(n * 0.12))) as b, least(21, greatest(5, floor(n * 0.08))) as step from h),
  f as (select symbol, year, n, horizon_days, a - 10 * k as train, greatest(8, b - 2 * k) as test, step, k, a - 10 * k + horizon_days + greatest(8, b - 2 * k) <= n as fits from c)
  select symbol, cast(year as bigint) as year, n, horizon_days, cast(case when n >= 80 and fits then train end as bigint) as train, cast(case when n >= 80 and fits then test end as bigint) as test, cast(case when n >= 80 and fits then step end as bigint) as step
  from f where fits or train <= 30 qualify row_number() over (partition by symbol, year, horizon_days order by k) = 1""")  # fmt: skip
def fitted_walk(spark, d):
    return _sizes(spark, d).withColumn("w", labels.fitted_lengths(F.col("n"), F.col("horizon_days"))).select("symbol", "year", "n", "horizon_days", "w.*")


@query("m1_fold_rows", PX + f""", {_TARGETS}, r as (select *, row_number() over (order by date) - 1 as rn from t), b as ({_FOLDS.replace("120", "(select count(*) from t)")})
  select fold, case when rn < train_hi then 'train' else 'test' end as part, count(*) as n, sum(outperform_gold) as wins from r join b on rn >= train_lo and rn < train_hi or rn >= test_lo and rn < test_hi group by 1, 2""")  # fmt: skip
def fold_rows(spark, d):
    t = labels.targets(v.prices(spark, d), v.BENCHMARK, v.GOLD, PEER, 10)
    rows = labels.walk_rows(t.withColumn("symbol", F.lit(v.BENCHMARK)), labels.Walk(40, 1, 10, 10), ["symbol"])
    return rows.groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("outperform_gold").alias("wins"))


_FRAME = f"""p as (select symbol, date, close / nullif(lag(close, 20) {_W}, 0) - 1 as m, lead(close, 10) {_W} / nullif(close, 0) - 1 as f from prices),
  s as (select a.date, a.f as entity_fwd, b.f as bench_fwd, a.m - b.m as momentum, case when a.f > b.f then 1 else 0 end as y, (datediff('day', date '1970-01-01', a.date) * 37 % 100) / 100.0 as boosted,
  (datediff('day', date '1970-01-01', a.date) * 53 % 100) / 100.0 as logistic from p a join p b on b.symbol = '{v.BENCHMARK}' and a.date = b.date where a.symbol = '{v.GOLD}' and a.f is not null and b.f is not null and a.m is not null and b.m is not null)"""


def study_frame(spark, d, entity: str = v.GOLD, bench: str = v.BENCHMARK):
    """A study's rows with stand-in forecasts, which depend on the date alone."""
    s = Series()
    p = v.prices(spark, d).select("symbol", "date", s.change(F.col("close"), 20).alias("m"), s.forward(F.col("close"), 10).alias("f"))
    a = p.where(F.col("symbol") == entity).select("date", F.col("m").alias("am"), F.col("f").alias("entity_fwd"))
    b = p.where(F.col("symbol") == bench).select("date", F.col("m").alias("bm"), F.col("f").alias("bench_fwd"))
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    j = a.join(b, "date").na.drop()
    return j.select("date", "entity_fwd", "bench_fwd", (F.col("am") - F.col("bm")).alias("momentum"), (F.col("entity_fwd") > F.col("bench_fwd")).cast("int").alias("y"), (day * 37 % 100 / 100.0).alias("boosted"), (day * 53 % 100 / 100.0).alias("logistic"))


@query("m19_study_frame", PX + f", {_FRAME} select date, round(entity_fwd, 6) as entity_fwd, round(bench_fwd, 6) as bench_fwd, round(momentum, 6) as momentum, y from s")
def frame(spark, d):
    return study_frame(spark, d).select("date", *[F.round(c, 6).alias(c) for c in ("entity_fwd", "bench_fwd", "momentum")], "y")


_SMALL = "sc as (select date, y, boosted, logistic, momentum, entity_fwd / 1000 as entity_fwd, bench_fwd / 1000 as bench_fwd from s)"
_BOOKS = f"""{_SMALL}, u as (select date, y, entity_fwd, bench_fwd, 'gradient_boosting' as strategy, case when boosted > 0.5 then 1 else 0 end as pos from sc union all select date, y, entity_fwd, bench_fwd, 'logistic_macro', case when logistic > 0.5 then 1 else 0 end from sc
  union all select date, y, entity_fwd, bench_fwd, 'momentum', case when momentum > 0 then 1 else 0 end from sc union all select date, y, entity_fwd, bench_fwd, 'always_entity', 1 from sc union all select date, y, entity_fwd, bench_fwd, 'always_benchmark', 0 from sc),
  n as (select *, pos * entity_fwd + (1 - pos) * bench_fwd - case when lag(pos) over w is not null and pos <> lag(pos) over w then 0.001 else 0 end as net from u window w as (partition by strategy order by date)),
  x as (select *, exp(sum(ln(1 + net)) over (partition by strategy order by date)) as wealth from n), y as (select *, wealth / max(wealth) over (partition by strategy order by date) - 1 as dd from x)"""


def _books(spark, d):
    small = study_frame(spark, d).withColumns({"entity_fwd": F.col("entity_fwd") / 1000, "bench_fwd": F.col("bench_fwd") / 1000})
    return inference.books(small)


@query("i12_books", PX + f", {_FRAME}, {_BOOKS} select strategy, round(arg_max(wealth, date), 4) as final_wealth, round(arg_max(wealth, date) - 1, 4) as total_return, round(min(dd), 4) as max_drawdown, round(avg(case when strategy not like 'always%' then case when pos = y then 1.0 else 0.0 end end), 4) as hit_rate, round(avg(net), 4) as avg_period_return, count(*) as n_periods from y group by 1")
def books(spark, d):
    return inference.book_summary(_books(spark, d))


def _nw(lags: int) -> str:
    terms = " + ".join(f"2 * (1 - {k}.0 / (least({lags}, n - 1) + 1)) * coalesce(sum(d * l{k}), 0)" for k in range(1, lags + 1))
    lagged = ", ".join(f"lag(d, {k}) over (partition by symbol order by date) as l{k}" for k in range(1, lags + 1))
    return f"e as (select *, {lagged} from c), w as (select symbol, n, (sum(d * d) + {terms}) / n / n as nw from e group by symbol, n)"


_CENTRED = f"r as (select symbol, date, (close / nullif(lag(close) {_W}, 0) - 1) / 10 as ret from prices), c as (select symbol, date, ret - avg(ret) over (partition by symbol) as d, count(*) over (partition by symbol) as n from r where ret is not null)"


@query("i5_newey_west", PX + f", {_CENTRED}, {_nw(4)} select symbol, n, round(nw, 10) as nw_var from w")
def newey_west(spark, d):
    r = v.prices(spark, d).select("symbol", "date", (Series().change(F.col("close"), 1) / 10).alias("ret")).where("ret is not null")
    return stats.newey_west(r, ["symbol"], "date", "ret", 4).withColumn("nw_var", F.round("nw_var", 10))


@query("i6_diebold_mariano", None)
def diebold_mariano(spark, d):
    f = study_frame(spark, d).withColumn("symbol", F.lit(v.GOLD))
    f = f.withColumn("lm", F.pow(F.col("y") - F.col("boosted"), 2)).withColumn("lb", F.pow(F.col("y") - F.col("logistic"), 2))
    return inference.diebold_mariano(f, ["symbol"], "date", "lm", "lb", h=5)


@query("i6_statistic", PX + f""", {_FRAME}, l as (select '{v.GOLD}' as symbol, date, (y - boosted) * (y - boosted) - (y - logistic) * (y - logistic) as x from s),
  c as (select symbol, date, x, x - avg(x) over () as d, count(*) over () as n from l), {_nw(4)}, m as (select avg(x) as m from l)
  select symbol, n, round(m, 8) as mean_loss_diff, round(m / sqrt(nw) * sqrt(greatest((n + 1 - 10 + 20.0 / n) / n, 0)), 6) as statistic from w, m""")  # fmt: skip
def dm_statistic(spark, d):
    """As above, without the p-value, which SQL here has no function for."""
    got = diebold_mariano(spark, d)
    return got.select("symbol", F.col("n_obs").cast("long").alias("n"), F.round("mean_loss_diff", 8).alias("mean_loss_diff"), F.round("statistic", 6).alias("statistic"))


@query("i3_block_length", PX + f", {_SIZES} select symbol, cast(year as bigint) as year, n, h as horizon_days, greatest(1, least(h, n // 8)) as block from (select *, unnest({list(v.HORIZONS)}) as h from z)")
def block(spark, d):
    return _sizes(spark, d).withColumn("block", inference.block_length_of(F.col("n"), F.col("horizon_days")))


@query("i7_holm", with_views("predictions") + """, r as (select id, date, entity, prob as p, row_number() over (partition by date, entity order by prob, id) as rank, count(*) over (partition by date, entity) as n from predictions)
  select id, rank, round(max(least(1.0, p * (n - rank + 1))) over (partition by date, entity order by rank), 6) as p_adjusted from r""")  # fmt: skip
def holm(spark, d):
    """The probabilities of a day and entity as a family of p-values."""
    p = v.predictions(spark, d).select("id", "date", "entity", "prob")
    return stats.holm(p, ["date", "entity"], "id", "prob").select("id", "rank", F.round("p_adjusted", 6).alias("p_adjusted"))


@query("i8_losses", with_views("scores") + "select id, round((y - p) * (y - p), 8) as squared, round(-(y - p), 8) as economic from scores")
def losses(spark, d):
    e = F.col("y") - F.col("p")
    return v.scores(spark, d).select("id", F.round(e * e, 8).alias("squared"), F.round(-e, 8).alias("economic"))


@query("i4_bootstrap_books", None)
def bootstrap_books(spark, d):
    return inference.grouped_bootstrap(_books(spark, d), ["strategy"], "date", "net", "total", 10)


@query("i2_i4_bootstrap_mean", None)
def bootstrap_mean(spark, d):
    """Mean returns of every strategy by moving blocks."""
    return inference.grouped_bootstrap(_books(spark, d), ["strategy"], "date", "net", "mean", 5, moving=True)


@query("i9_i10_study_tests", None)
def study_tests(spark, d):
    """The boosted book against each baseline: losses are negative returns; p-values adjusted within the study."""
    rows = _books(spark, d).select("strategy", "date", (-F.col("net")).alias("loss"))
    model = rows.where("strategy = 'gradient_boosting'").select("date", F.col("loss").alias("lm"))
    paired = rows.where("strategy <> 'gradient_boosting'").join(model, "date")
    tests = inference.diebold_mariano(paired.withColumnRenamed("loss", "lb"), ["strategy"], "date", "lm", "lb", h=10)
    filled = tests.withColumn("p", F.coalesce("p_value", F.lit(1.0)))
    return stats.holm(filled, [], "strategy", "p")


@query("f11_normal_cdf", None)
def normal_cdf(spark, d):
    return v.scores(spark, d).select("id", inference.normal_cdf((F.col("p") - 0.5) * 16).alias("cdf"))


# Portfolios

SYMBOLS = (v.GOLD, v.BENCHMARK, PEER)
_IN = ", ".join(f"'{s}'" for s in SYMBOLS)
_RM = f"""r as (select symbol, date, close / nullif(lag(close) {_W}, 0) - 1 as ret from prices where symbol in ({_IN})), k as (select date from r where ret is not null group by 1 having count(*) = 3 order by date desc limit 252), m as (select r.* from r join k using (date))"""


def _matrix(spark, d):
    return portfolio.return_matrix(v.prices(spark, d), SYMBOLS)


@query("o1_return_matrix", PX + f", {_RM} select date, symbol, round(ret, 6) as ret from m")
def return_matrix(spark, d):
    return _matrix(spark, d).withColumn("ret", F.round("ret", 6))


@query("o2_inverse_volatility", PX + f", {_RM}, i as (select symbol, 1 / (stddev_samp(ret) + 1e-8) as i from m group by 1) select symbol, round(i / sum(i) over (), 8) as weight from i")
def inverse_volatility(spark, d):
    return portfolio.inverse_volatility(_matrix(spark, d)).withColumn("weight", F.round("weight", 8))


@query("o2_hierarchical_parity", None)
def hierarchical(spark, d):
    return portfolio.hierarchical_weights(_matrix(spark, d)).select(F.lit("all").alias("book"), "symbol", "weight")


@query("o3_mean_variance", None)
def mean_variance(spark, d):
    return portfolio.solved(_matrix(spark, d), "mean_variance")


@query("o4_kelly", PX + f", {_RM}, s as (select symbol, avg(ret) - 0.3 as mu, stddev_samp(ret) as vol from m group by 1), kl as (select symbol, greatest(mu / (vol * vol + 1e-8), 0) as k from s) select symbol, round(case when sum(k) over () > 0 then k / sum(k) over () else 1.0 / count(*) over () end, 8) as weight from kl")
def kelly(spark, d):
    s = _matrix(spark, d).groupBy("symbol").agg((F.avg("ret") - 0.3).alias("mu"), F.stddev_samp("ret").alias("vol"))
    return portfolio.kelly(s, "mu", "vol").select("symbol", F.round("weight", 8).alias("weight"))


@query("o5_blend", PX + f""", {_RM}, i as (select symbol, 1 / (stddev_samp(ret) + 1e-8) as i, avg(ret) as mu from m group by 1), w as (select symbol, i / sum(i) over () as w, rank() over (order by mu) * 1.0 / count(*) over () as r from i),
  b as (select symbol, 0.6 * w + 0.4 * r / sum(r) over () as b from w), n as (select symbol, b / sum(b) over () as b from b), t as (select *, row_number() over (order by b desc, symbol) as rank from n)
  select symbol, round(b / sum(b) over (), 8) as weight, rank from t where rank <= 2""")  # fmt: skip
def blended(spark, d):
    m = _matrix(spark, d)
    w = portfolio.inverse_volatility(m).join(m.groupBy("symbol").agg(F.avg("ret").alias("mu")), "symbol")
    return portfolio.blend(w, "mu", top=2).withColumn("weight", F.round("weight", 8))


@query("o6_portfolio_analytics", """with w as (select p_brand as ticker, p_type as tier, sum(p_retailprice) as x, avg(p_size) / 100.0 as alpha from part group by 1, 2), s as (select *, x / sum(x) over () as w from w)
  select tier, round(sum(w), 8) as exposure, round(sum(w * alpha), 8) as alpha, round(sum(w * w), 10) as hhi_part from s group by 1""")  # fmt: skip
def analytics(spark, d):
    w = v.table(spark, d, "part").groupBy(F.col("p_brand").alias("ticker"), F.col("p_type").alias("tier")).agg(F.sum("p_retailprice").alias("x"), (F.avg("p_size") / 100.0).alias("alpha"))
    s = w.withColumn("w", F.col("x") / F.sum("x").over(Window.partitionBy(F.lit(0))))
    return s.groupBy("tier").agg(F.round(F.sum("w"), 8).alias("exposure"), F.round(F.sum(F.col("w") * F.col("alpha")), 8).alias("alpha"), F.round(F.sum(F.col("w") * F.col("w")), 10).alias("hhi_part"))


# Graphs


def _edge_values() -> str:
    return "(values " + ", ".join(f"({i}, '{e[0]}', '{e[1]}', '{e[2]}', {str(i < 5).lower()})" for i, e in enumerate(seeds.EDGES)) + ") x(edge_id, source, target, direction, core)"


def _node_values() -> str:
    return "(values " + ", ".join(f"('{n[0]}')" for n in seeds.NODES) + ") x(name)"


_GRAPH = f"""with g as (select edge_id, source, target, direction, core from {_edge_values()}
  union all select 1000 + o_orderkey, n_name, o_orderpriority, o_orderstatus, false from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def _graph(spark, d):
    """The seed's edges, and one for each order from its customer's country to its priority."""
    o = v.table(spark, d, "orders").select((F.col("o_orderkey") + 1000).alias("edge_id"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("direction"))
    c = v.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(v.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("source")), "n_nationkey")
    orders = o.join(c, "c_custkey").withColumn("core", F.lit(False))
    kept = ("edge_id", "source", "target", "direction", "core")
    return seeds.graph_edges(spark).select(*kept).unionByName(orders.select(*kept))


@query("g1_edges", _GRAPH + "select source, target, direction from g qualify row_number() over (partition by source, target order by edge_id desc) = 1")
def edges(spark, d):
    return graph.latest_edges(_graph(spark, d), "edge_id").select("source", "target", "direction")


@query("g2_causes", _GRAPH + "select edge_id, source from g where target in ('Gold', '1-URGENT')")
def causes(spark, d):
    g = _graph(spark, d)
    return graph.causes_of(g, "Gold").unionByName(graph.causes_of(g, "1-URGENT")).select("edge_id", "source")


_PATHS = """with recursive e as (select distinct source, target from {edges}), p as (select source as start, target as last, [source, target] as path from e where source <> target {first}
  union all select p.start, e.target, list_append(p.path, e.target) from p join e on p.last = e.source where not list_contains(p.path, e.target) and len(p.path) < 7)
  select start, last as "end", array_to_string(path, ' > ') as path, len(path) - 1 as edges from p where {final}"""


@query("g3_transmission", _PATHS.format(edges="a", first="and source = 'Fed Policy'", final="last in ('Mining Stocks', (select max(s_name) from supplier))").replace("with recursive e", "with recursive " + with_views("edges").removeprefix("with ").rstrip() + f", a as (select * from edges union all select 'Gold', r_name from region union all select source, target from {_edge_values()}), e"))
def transmission(spark, d):
    """All ways from policy to mining stocks, and through gold and its regions to the last supplier."""
    gold = v.table(spark, d, "region").select(F.lit("Gold").alias("source"), F.col("r_name").alias("target"))
    e = v.edges(spark, d).unionByName(gold).unionByName(seeds.graph_edges(spark).select("source", "target"))
    starts = spark.createDataFrame([("Fed Policy",)], "start string")
    last = v.table(spark, d, "supplier").agg(F.max("s_name")).first()[0]
    ways = [graph.simple_paths(e, starts, end) for end in ("Mining Stocks", last) if end is not None]
    return reduce(DataFrame.unionByName, ways).withColumn("path", F.array_join("path", " > "))


@query("j22_all_paths", _PATHS.format(edges="edges", first="", final="true").replace("with recursive e", "with recursive " + with_views("edges").removeprefix("with ").rstrip() + ", e"))
def all_paths(spark, d):
    e = v.edges(spark, d)
    return graph.simple_paths(e, e.select(F.col("source").alias("start")).distinct()).withColumn("path", F.array_join("path", " > "))


_HUB = "EUROPE"


@query("g3_paths_to_suppliers", _PATHS.format(edges="edges", first=f"and source = '{_HUB}'", final="last = (select min(target) from edges where target like 'Supplier%')").replace("with recursive e", "with recursive " + with_views("edges").removeprefix("with ").rstrip() + ", e"))
def paths_to_supplier(spark, d):
    """All ways from a region to the first supplier."""
    e = v.edges(spark, d)
    end = e.where(F.col("target").like("Supplier%")).agg(F.min("target")).first()[0]
    return graph.simple_paths(e, spark.createDataFrame([(_HUB,)], "start string"), end).withColumn("path", F.array_join("path", " > "))


@query("g4_graph_counts", _GRAPH + f", n as (select source as name from g union select target from g union select name from {_node_values()}) select (select count(*) from n) as nodes, count(*) as edges, count(*) filter (core) as core from g")
def graph_counts(spark, d):
    g = _graph(spark, d)
    ends = g.select(F.explode(F.array("source", "target")).alias("name")).unionByName(seeds.graph_nodes(spark).select("name")).distinct()
    counted = lambda df, nodes, edges, core: df.select(F.lit(nodes).alias("nodes"), F.lit(edges).alias("edges"), core.cast("int").alias("core"))
    parts = counted(ends, 1, 0, F.lit(0)).unionByName(counted(g, 0, 1, F.col("core")))
    return parts.agg(*[F.sum(c).alias(c) for c in ("nodes", "edges", "core")])


@query("g5_top_hypotheses", _GRAPH + "select target, source, k from (select target, source, row_number() over (partition by target order by edge_id) as k from g where target in ('Gold', 'Mining Stocks', 'Senior Gold Miners', 'GDX', '1-URGENT', '2-HIGH')) where k <= 3")
def top_hypotheses(spark, d):
    e = _graph(spark, d).where(F.col("target").isin("Gold", "Mining Stocks", "Senior Gold Miners", "GDX", "1-URGENT", "2-HIGH"))
    return e.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("edge_id"))).where("k <= 3").select("target", "source", "k")


# Paper accounts

_SHIFT = "1461"  # events are of 2024, prices end in 1998: days between
_SCORES = """sc as (select date, horizon_days, entity, case when prob is null or prob = 0 then 0.5 else prob end as prob, expected_alpha as alpha, expected_return as ret from
  (select *, row_number() over (partition by date, horizon_days, entity order by id desc) as k from predictions where starts_with(model_version, 'asof_h')) where k = 1)"""


@query("b1_market_scores", with_views("predictions") + f", {_SCORES} select date, horizon_days, entity, prob, alpha, ret from sc")
def market_scores(spark, d):
    return paper.market_scores(v.predictions(spark, d), v.HORIZONS)


def _paper_prices(spark, d):
    """Prices of what is scored: cumulated flows of each event type, by day."""
    f = v.flows(spark, d)
    return f.select("date", F.col("ticker").alias("symbol"), (F.col("daily_flow") / F.col("n") + 50).alias("close"))


_PP = "px as (select date, ticker as symbol, daily_flow / n + 50 as close from flows)"


@query("b4_sleeves", with_views("predictions", "flows") + f""", {_SCORES}, {_PP}, first as (select symbol, min(date) as f from px group by 1),
  c as (select s.date, s.horizon_days, entity as symbol, row_number() over (partition by s.date, s.horizon_days order by alpha desc, entity desc) as k from sc s join first on entity = symbol and s.date >= f
    where entity not in ('view', 'purchase') and (prob >= 0.6 and alpha > 0 or prob >= 0.55 and not (prob <= 0.4 and alpha < 0))), t as (select * from c where k <= 8),
  e as (select distinct date, horizon_days from sc s where not exists (select 1 from t where t.date = s.date and t.horizon_days = s.horizon_days))
  select date, horizon_days, symbol, round(1.0 / count(*) over (partition by date, horizon_days), 8) as weight from t union all select date, horizon_days, 'purchase', 1.0 from e where date >= (select f from first where symbol = 'purchase')""")  # fmt: skip
def sleeves(spark, d):
    got = paper.sleeves(paper.market_scores(v.predictions(spark, d), v.HORIZONS), _paper_prices(spark, d), ["view", "purchase"], ["purchase", "view"])
    return got.withColumn("weight", F.round("weight", 8))


@query("b2_stance", with_views("predictions") + """, x as (select id, expected_return as g, case when id % 5 = 0 then null else expected_alpha end as b, prob * 4 as y, expected_alpha * 30 as dl, case id % 3 when 0 then 'bullish' when 1 then 'bearish' else 'neutral' end as bias from predictions)
  select id, case when g > b and not (coalesce(y > 2, false) or coalesce(dl > 1, false)) and (bias = 'bullish' or dl < -1) then 'add' when g < b and (y > 2 or dl > 1) then 'reduce' else 'keep' end as stance from x""")  # fmt: skip
def stance(spark, d):
    from pitframe.functions.labels import stance as call

    i = F.col("id")
    bench = F.when(i % 5 != 0, F.col("expected_alpha"))
    bias = F.when(i % 3 == 0, "bullish").when(i % 3 == 1, "bearish").otherwise("neutral")
    return v.predictions(spark, d).select("id", call(F.col("expected_return"), bench, F.col("prob") * 4, F.col("expected_alpha") * 30, bias).alias("stance"))


def _paper_events(spark, d):
    scores, px = paper.market_scores(v.predictions(spark, d), v.HORIZONS), _paper_prices(spark, d)
    sleeve = paper.sleeves(scores, px, ["view", "purchase"], ["purchase", "view"])
    bias = F.broadcast(seeds.regime_hypotheses(spark).select("regime_id", "gold_bias"))
    regimes = v.regimes(spark, d).join(bias, "regime_id").select("date", "gold_bias")
    context = paper.contexts(scores, px, regimes, "purchase", "view", "click", "signup")
    return paper.simulate(paper.trading_days(px, scores, sleeve, context, v.HORIZONS, ["purchase"], "view"), "view")


_MOVES = ", ".join(f"close / nullif(lag(close, {h}) over (order by date), 0) - 1 as m{h}" for h in v.HORIZONS)
_CONTEXTS = with_views("predictions", "flows", "regimes") + f""", {_SCORES}, {_PP}, dy as (select date, horizon_days, max(ret) filter (entity = 'purchase') as gold_ret from sc group by 1, 2),
  re as (select date, close from px where symbol = 'click'), do_ as (select * from (select date, (close / nullif(lag(close, 20) over (order by date), 0) - 1) * 100 as x from px where symbol = 'signup') where x is not null),
  be as (select date, {_MOVES} from px where symbol = 'view'),
  x as (select d.*, re.close as real_yield, do_.x as dollar_20, case horizon_days {" ".join(f"when {h} then m{h}" for h in v.HORIZONS)} end as bench_trail, case when r.date is null then 'neutral' else 'bullish' end as gold_bias
    from dy d asof left join re on d.date >= re.date asof left join do_ on d.date >= do_.date asof left join be on d.date >= be.date asof left join regimes r on d.date >= r.date),
  y as (select *, coalesce(real_yield > 2, false) or coalesce(dollar_20 > 1, false) as bad, gold_bias = 'bullish' or coalesce(dollar_20 < -1, false) as good from x),
  z as (select *, case when coalesce(gold_ret > bench_trail, false) and not bad and good then 'add' when coalesce(gold_ret < bench_trail, false) and bad then 'reduce' else 'keep' end as stance from y)
  select date, horizon_days, round(gold_ret, 6) as gold_ret, round(real_yield, 6) as real_yield, round(dollar_20, 6) as dollar_20, round(bench_trail, 6) as bench_trail, gold_bias, stance, case stance when 'add' then 0.6 when 'keep' then 0.3 else 0.1 end::double as gold_budget from z"""


@query("b3_contexts", _CONTEXTS)
def contexts(spark, d):
    scores = paper.market_scores(v.predictions(spark, d), v.HORIZONS)
    regimes = v.regimes(spark, d).select("date", F.lit("bullish").alias("gold_bias"))
    got = paper.contexts(scores, _paper_prices(spark, d), regimes, "purchase", "view", "click", "signup")
    return got.select("date", "horizon_days", *[F.round(c, 6).alias(c) for c in ("gold_ret", "real_yield", "dollar_20", "bench_trail")], "gold_bias", "stance", "gold_budget")


@query("b5_marked", PX + """, po as (select o_custkey % 5 as horizon_days, date_trunc('month', o_orderdate)::date as date, p_type as symbol, cast(sum(l_quantity) as double) as shares from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2, 3),
  h as (select po.*, p.close from po asof left join prices p on p.symbol = po.symbol and po.date >= p.date)
  select horizon_days, date, round(1000.0 * horizon_days + coalesce(sum(shares * close), 0), 4) as nav from h group by 1, 2""")  # fmt: skip
def marked(spark, d):
    """Books of the shares bought in each month, marked at the month's first day."""
    li = v.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 5).alias("horizon_days"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"))
    p = v.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("symbol"))
    positions = li.join(o, "l_orderkey").join(p, "l_partkey").groupBy("horizon_days", "date", "symbol").agg(F.sum("l_quantity").cast("double").alias("shares"))
    cash = positions.select("horizon_days", "date").distinct().withColumn("cash", F.col("horizon_days") * 1000.0)
    return paper.marked(cash, positions, v.prices(spark, d)).withColumn("nav", F.round("nav", 4))


@query("b6_b7_orders", None)
def orders(spark, d):
    return paper.orders(_paper_events(spark, d))


@query("b7_navs", None)
def navs(spark, d):
    return paper.navs(_paper_events(spark, d))


@query("b8_nav_stats", with_views("flows") + """, n as (select case ticker when 'view' then 5 when 'purchase' then 10 else 20 end as horizon_days, date, sum(daily_flow) as nav from flows group by 1, 2),
  dd as (select *, nav / max(nav) over (partition by horizon_days order by date) - 1 as dd from n)
  select horizon_days, max(date) as as_of, round(arg_max(nav, date), 2) as nav, round(arg_max(nav, date) / 100000 - 1, 4) as total_return, round(least(min(dd), 0), 4) as max_drawdown from dd group by 1""")  # fmt: skip
def nav_stats(spark, d):
    t = F.col("ticker")
    n = v.flows(spark, d).groupBy(F.when(t == "view", 5).when(t == "purchase", 10).otherwise(20).alias("horizon_days"), "date").agg(F.sum("daily_flow").alias("nav"))
    got = paper.nav_stats(n.select("*", F.col("nav").alias("benchmark_gold"), F.col("nav").alias("benchmark_spx"), F.lit("keep").alias("stance")))
    return got.select("horizon_days", "as_of", "nav", "total_return", "max_drawdown")


@query("b9_missing_books", "select distinct o_custkey as horizon_days from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def missing_books(spark, d):
    """Each customer's orders as a book; one with a pending order is there already."""
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("horizon_days"), "o_orderstatus")
    return paper.missing_books(o.select("horizon_days").distinct(), o.where("o_orderstatus = 'P'").select("horizon_days").distinct())


@query("b10_recent_orders", "select horizon_days, date, seq from (select o_custkey % 5 as horizon_days, cast(o_orderdate as date) as date, o_orderkey as seq, row_number() over (partition by o_custkey % 5 order by cast(o_orderdate as date) desc, o_orderkey desc) as k from orders) where k <= 40")
def recent_orders(spark, d):
    o = v.table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("horizon_days"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("seq"))
    return paper.recent_orders(o)


@query("b10_curve", "select horizon_days, date from (select *, row_number() over (partition by horizon_days order by date) as rn, count(*) over (partition by horizon_days) as n from (select distinct o_custkey % 5 as horizon_days, cast(o_orderdate as date) as date from orders)) where (rn - 1) % greatest(1, n // 180) = 0 or rn = n")
def curve(spark, d):
    n = v.table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("horizon_days"), F.col("o_orderdate").cast("date").alias("date")).distinct()
    return paper.curve(n)


QUERIES, ORACLES = query.queries, query.oracles
