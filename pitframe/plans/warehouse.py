"""Sources and sinks over the binding views."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitframe.functions.text import RISK_WORDS
from pitframe.plans.registry import Registry
from pitframe.sources import feeds, seeds
from pitframe.sources import views as v
from pitframe.sources import warehouse as w
from pitframe.sources.views import with_views

query = Registry()
PX = with_views("prices")


def _values(rows) -> str:
    def lit(x):
        if x is None:
            return "null"
        if isinstance(x, bool):
            return str(x).lower()
        return "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


@query("s3_vintages", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date) as date, cast(l_extendedprice as decimal(18,6)) as close, coalesce(case when l_linenumber % 2 = 0 then strftime(l_shipdate + interval 9 day, '%Y-%m-%d') end, 'initial') as vintage,
  coalesce(case when l_linenumber % 2 = 0 then cast(l_shipdate as date) + 9 end, cast(l_shipdate as date) + 45) as release_date, l_linenumber % 2 <> 0 as lag_assumed from lineitem""")  # fmt: skip
def vintages(spark, d):
    from pitframe.operators.asof import release_date

    day = F.col("l_shipdate").cast("date")
    raw = v.table(spark, d, "lineitem").withColumn("date", day).withColumn("start", F.when(F.col("l_linenumber") % 2 == 0, F.date_add(day, 9)))
    return raw.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "date", F.col("l_extendedprice").cast("decimal(18,6)").alias("close"),
        F.coalesce(F.date_format("start", "yyyy-MM-dd"), F.lit("initial")).alias("vintage"), F.coalesce("start", release_date(F.col("date"), F.lit("CPIAUCSL"), seeds.PUBLICATION_LAG)).alias("release_date"),
        F.col("start").isNull().alias("lag_assumed"),
    )


@query("s4_source_preference", PX + f"""select symbol, date, round(close, 6) as close from prices where symbol = '{v.GOLD}' and exists (select 1 from prices where symbol = '{v.GOLD}')
  union all select symbol, date, round(close, 6) from prices where symbol = 'ABSENT'""")  # fmt: skip
def preference(spark, d):
    p = v.prices(spark, d).select("symbol", "date", F.round("close", 6).alias("close"))
    have, none = feeds.preferred(p, p.withColumn("close", F.lit(0.0)), v.GOLD), feeds.preferred(p, p, "ABSENT")
    return have.unionByName(none)


_PURCHASES = _values([(f"2024-0{i + 1}-01", c, t) for c, ts in seeds.PURCHASES_2024.items() for i, t in enumerate(ts)])


@query("s6_seed_purchases", with_views("monthly") + f""", o as (select cast(month + interval 26 year as date) as month, country, round(purchase, 2) as purchase_tonnes from monthly)
  select * from o union all select cast(m as date), upper(c), cast(t as double) from {_PURCHASES} x(m, c, t) where not exists (select 1 from o where o.month = cast(m as date) and o.country = upper(c))""")  # fmt: skip
def seed_purchases(spark, d):
    """The tables' monthly purchases, 26 years on, with the seed rows of months and countries that they lack."""
    have = v.monthly(spark, d).select(F.add_months("month", 12 * 26).alias("month"), "country", F.round("purchase", 2).alias("purchase_tonnes"))
    return w.insert_absent(have, seeds.purchases(spark).withColumn("country", F.upper("country")), ["month", "country"])


@query("s7_seed_quarterly", "with o as (select p_brand as ticker, sum(l_quantity) as production_oz, round(avg(l_extendedprice / l_quantity), 4) as aisc_per_oz from lineitem join part on l_partkey = p_partkey group by 1) select * from o union all select t, cast(p as double), cast(a as double) from " + _values([r[:3] for r in seeds.QUARTERLY]) + " x(t, p, a) where t not in (select ticker from o)")
def seed_quarterly(spark, d):
    """Output and unit cost by brand, with the seed rows of companies that the tables lack."""
    li = v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity", "l_extendedprice").join(v.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ticker")), "p_partkey")
    have = li.groupBy("ticker").agg(F.sum("l_quantity").alias("production_oz"), F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("aisc_per_oz"))
    return w.insert_absent(have, seeds.quarterly(spark).select("ticker", "production_oz", "aisc_per_oz"), ["ticker"])


@query("s8_universe", "with u as (select tier, scored, priced from " + _values(seeds.INSTRUMENTS) + " x(symbol, name, metal, instrument, tier, priced, scored) union all select p_brand, p_size > 25, p_retailprice > 0 from part) select tier, count(*) as n, count(*) filter (scored) as scored from u where priced group by 1")
def universe(spark, d):
    """Instruments by tier: the seed's, and the parts as further ones."""
    text = lambda name: F.lit(name).cast("string")
    parts = v.table(spark, d, "part").select(
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_name").alias("name"), text(None).alias("metal"), text("part").alias("instrument"), F.col("p_brand").alias("tier"),
        (F.col("p_retailprice") > 0).alias("priced"), (F.col("p_size") > 25).alias("scored"),
    )
    return w.insert_absent(parts, seeds.instruments(spark), ["symbol"]).where("priced").groupBy("tier").agg(F.count("*").alias("n"), F.count_if("scored").alias("scored"))


@query("s9_latest_prices", PX + "select symbol, max(date) as date, round(arg_max(close, date), 6) as close from prices group by 1")
def latest(spark, d):
    return feeds.latest_prices(v.prices(spark, d)).withColumn("close", F.round("close", 6))


@query("s10_scan", "select p_partkey, p_name, p_size from part")
def scan(spark, d):
    return v.table(spark, d, "part").select("p_partkey", "p_name", "p_size")


@query("s12_evidence", """with s as (select o_custkey, cast(count(*) as integer) as n, round(sum(o_totalprice) / 1e6, 6) as total from orders group by 1)
  select 'customer ' || o_custkey as study, b as book, n as n_oos, case when b = 'boosted' then total else total / 2 end as total_return from s, (values ('boosted'), ('always')) x(b)""")  # fmt: skip
def evidence(spark, d):
    """Results of research as JSON texts, one for each customer, read back as studies and books."""
    o = v.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("n"), F.round(F.sum("o_totalprice") / 1e6, 6).alias("total"))
    book = lambda x: F.struct((x + 1).alias("final_wealth"), x.alias("total_return"))
    study = F.struct(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("name"), F.lit("X").alias("entity"), F.col("n").alias("n_oos"), F.create_map(F.lit("boosted"), book(F.col("total")), F.lit("always"), book(F.col("total") / 2)).alias("books"))
    studies, books = feeds.evidence(o.select(F.to_json(F.struct(F.lit("2026-01-02").alias("generated"), F.array(study).alias("studies"))).alias("value")))
    return studies.select(F.col("name").alias("study"), "n_oos").join(books, "study").select("study", "book", "n_oos", "total_return")


@query("s13_graph_tables", "select category, count(*) as n from (select category from " + _values(seeds.NODES) + " x(name, category, description, source) union all select 'region' from region union all select 'country' from nation union all select 'supplier' from supplier) group by 1")
def graph_tables(spark, d):
    """Nodes of the causal graph by category: the seed's, and the tables' places and suppliers."""
    named = lambda t, name, category: v.table(spark, d, t).select(F.col(name).alias("name"), F.lit(category).alias("category"))
    places = named("region", "r_name", "region").unionByName(named("nation", "n_name", "country")).unionByName(named("supplier", "s_name", "supplier"))
    return w.insert_absent(seeds.graph_nodes(spark).select("name", "category"), places, ["name"]).groupBy("category").agg(F.count("*").alias("n"))


_NEW = "n as (select s_suppkey as c_custkey, s_name as c_name, s_nationkey as c_nationkey, s_acctbal as c_acctbal, 'NEW' as c_mktsegment from supplier where s_suppkey % 2 = 0 union all select 1000000 + s_suppkey, s_name, s_nationkey, s_acctbal, 'NEW' from supplier where s_suppkey % 3 = 0)"


@query("k1_upsert", f"with {_NEW} select coalesce(c.c_custkey, n.c_custkey) as c_custkey, coalesce(c.c_name, n.c_name) as c_name, coalesce(c.c_nationkey, n.c_nationkey) as c_nationkey, round(coalesce(n.c_acctbal, c.c_acctbal), 2) as c_acctbal, coalesce(c.c_mktsegment, n.c_mktsegment) as c_mktsegment from customer c full outer join n on c.c_custkey = n.c_custkey")
def upsert(spark, d):
    s = v.table(spark, d, "supplier")
    new = lambda df, key: df.select(key.alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    incoming = new(s.where("s_suppkey % 2 = 0"), F.col("s_suppkey")).unionByName(new(s.where("s_suppkey % 3 = 0"), F.col("s_suppkey") + 1000000))
    return w.upsert(v.table(spark, d, "customer"), incoming, ["c_custkey"], ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("k3_exact_decimals", PX + "select symbol, date, cast(round(close, 6) as decimal(18,6)) as close, cast(volume as decimal(20,2)) as volume from prices")
def decimals(spark, d):
    got = w.conform(v.prices(spark, d).withColumn("close", F.round("close", 6)), "macro_daily")
    return got.select("symbol", "date", "close", "volume")


@query("k4_derived_real_yield", PX + f"select date, cast(round(cast(round(close, 6) as decimal(18,6)) - cast(2.25 as decimal(18,6)), 4) as double) as close, release_date from prices where symbol = '{v.GOLD}'")
def derived(spark, d):
    macro = v.prices(spark, d).where(F.col("symbol") == v.GOLD).select("date", F.lit("US10Y").alias("symbol"), F.round("close", 6).cast("decimal(18,6)").alias("close"), F.lit("initial").alias("vintage"), "release_date", F.lit("x").alias("source"))
    return w.derived_real_yields(macro).select("date", F.col("close").cast("double").alias("close"), "release_date")


_PARTS = list(RISK_WORDS)


@query("k7_risk_record", "select date, round(coalesce(case when k % 2 = 0 then k / 10.0 end, (" + " + ".join(f"coalesce(case when k % {i + 2} > 0 then k / {i + 9}.0 end, 0)" for i in range(7)) + ") / 7), 6) as gpr_index from (select cast(ts as date) as date, count(*) % 10 as k from events group by 1)")
def risk_record(spark, d):
    days = v.table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("date")).agg((F.count("*") % 10).alias("k"))
    k = F.col("k")
    scored = days.select("date", F.when(k % 2 == 0, k / 10.0).alias("gpr_index"), *[F.when(k % (i + 2) > 0, k / float(i + 9)).alias(c) for i, c in enumerate(_PARTS)], F.lit(None).cast("string").alias("source"))
    return w.risk_record(scored, _PARTS).select("date", F.round("gpr_index", 6).alias("gpr_index"))


@query("k9_insert_absent", "select ticker, exchange from " + _values([(s, "NYSE" if s in seeds.NYSE else "TSX") for s, _, _, kind, _, priced, _ in seeds.INSTRUMENTS if priced and kind in seeds.EQUITY_KINDS]) + " x(ticker, exchange) union all select s_name, case when s_suppkey % 2 = 0 then 'OLD' else 'NEW' end from supplier")
def insert_absent(spark, d):
    """Every second supplier and some companies are there; all come in, and those there stay as they are."""
    s, c = v.table(spark, d, "supplier"), seeds.companies(spark).select("ticker", "exchange")
    suppliers = lambda rows, exchange: rows.select(F.col("s_name").alias("ticker"), F.lit(exchange).alias("exchange"))
    return w.insert_absent(c.where("exchange = 'NYSE'").unionByName(suppliers(s.where("s_suppkey % 2 = 0"), "OLD")), c.unionByName(suppliers(s, "NEW")), ["ticker"])


@query("k10_melt", PX + f"""select date, split_part(name, '__', 1) as entity, split_part(name, '__', 2) as feature_name, round(x, 6) as feature_value from (select date, symbol || '__close' as name, close as x from prices where symbol in ('{v.GOLD}', '{v.BENCHMARK}'))""")
def melt(spark, d):
    wide = v.prices(spark, d).groupBy("date").pivot("symbol", [v.GOLD, v.BENCHMARK]).agg(F.max("close"))
    named = wide.withColumnsRenamed({v.GOLD: f"{v.GOLD}__close", v.BENCHMARK: f"{v.BENCHMARK}__close"})
    return w.melt(named).withColumn("feature_value", F.round("feature_value", 6))


@query("m13_feature_matrix", with_views("vectors") + "select vec_id, " + ", ".join(f"round(max(value) filter (feature = {i} and label = {j}), 6) as L{j}__f{i}" for i in range(2) for j in range(2)) + " from vectors where feature < 2 and label < 2 group by 1")
def feature_matrix(spark, d):
    x = v.vectors(spark, d).where("feature < 2 and label < 2").select("vec_id", F.concat(F.lit("L"), "label").alias("entity"), F.concat(F.lit("f"), "feature").alias("feature_name"), F.round("value", 6).alias("feature_value"))
    return w.matrix(x, [f"L{j}__f{i}" for i in range(2) for j in range(2)], "vec_id")


@query("k13_ranked_sink", "select row_number() over (order by p_retailprice desc, p_partkey) as rank, p_partkey from part qualify row_number() over (order by p_retailprice desc, p_partkey) <= 25")
def ranked_sink(spark, d):
    from pyspark.sql import Window

    top = v.table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)
    return top.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"), "p_partkey")


@query("k14_last_buy_cost", """with o as (select o_custkey % 5 as horizon_days, o_orderstatus as symbol, o_orderkey as seq, case when o_orderkey % 3 = 0 then 'sell' else 'buy' end as side, o_totalprice as price from orders)
  select horizon_days, symbol, count(*) as shares, round(coalesce(arg_max(price, seq) filter (side = 'buy'), -1), 2) as avg_cost from o group by 1, 2""")  # fmt: skip
def last_buy(spark, d):
    o = v.table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("horizon_days"), F.col("o_orderstatus").alias("symbol"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, "sell").otherwise("buy").alias("side"), F.col("o_totalprice").alias("price"))
    positions = o.groupBy("horizon_days", "symbol").agg(F.count("*").alias("shares"))
    navs = o.select("horizon_days", F.col("seq").alias("date"), F.lit(-1.0).alias("nav"))
    return w.last_buy_cost(positions, o, navs).withColumn("avg_cost", F.round("avg_cost", 2))


@query("k15_delete_books", "select o_orderpriority, count(*) as n from orders where o_orderpriority not in ('1-URGENT', '2-HIGH') group by 1")
def delete_books(spark, d):
    return w.without(v.table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("k19_json_safe", with_views("scores") + """select '{"id":' || id || ',"y":' || y || ',"p":' || (case when id % 3 = 0 then 'null' else '0.5' end) || '}' as json from scores""")
def json_safe(spark, d):
    s = v.scores(spark, d).select("id", "y", F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(0.5)).alias("p"))
    return w.json_rows(s)


@query("k20_backfill", "select o_orderkey, coalesce(case when o_orderkey % 4 = 0 then cast(o_orderdate as date) + 9 end, cast(o_orderdate as date) + 1) as release_date, 'initial' as vintage, o_orderkey % 4 <> 0 as lag_assumed from orders")
def backfill(spark, d):
    day = F.col("o_orderdate").cast("date")
    o = v.table(spark, d, "orders").select("o_orderkey", day.alias("date"), F.when(F.col("o_orderkey") % 4 == 0, F.date_add(day, 9)).alias("release_date"), F.lit(None).cast("string").alias("vintage"), F.lit(None).cast("boolean").alias("lag_assumed"))
    return w.backfill_release(o).select("o_orderkey", "release_date", "vintage", "lag_assumed")


@query("r12_with_availability", PX + "select date, symbol, round(close, 6) as close, release_date, release_date - date as lag_days from prices")
def availability(spark, d):
    return v.prices(spark, d).select("date", "symbol", F.round("close", 6).alias("close"), "release_date", F.datediff("release_date", "date").cast("long").alias("lag_days"))


QUERIES, ORACLES = query.queries, query.oracles
