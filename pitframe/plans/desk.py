"""Models, regimes, rules and composite reads over the binding views."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitframe.functions import labels as fl
from pitframe.operators import features, inference, labels, models, regime, rules, stats
from pitframe.operators.windows import Series
from pitframe.plans.registry import Registry
from pitframe.plans.research import study_frame
from pitframe.sources import seeds
from pitframe.sources import views as v
from pitframe.sources.artifacts import stored
from pitframe.sources.views import with_views

query = Registry()
PX = with_views("prices")
PREDS = with_views("predictions")
_W = "over (partition by symbol order by date)"
FEATURES = ("ret_5", "ret_20", "vol_20", "z_60")


def feature_rows(spark, d):
    """Price features of every symbol in one window pass, complete rows only."""
    s, x = Series(), F.col("close")
    p = v.prices(spark, d).withColumn("ret", s.change(x, 1))
    return p.select("symbol", "date", s.change(x, 5).alias("ret_5"), s.change(x, 20).alias("ret_20"), s.volatility(F.col("ret"), 20).alias("vol_20"), s.zscore(x, 60).alias("z_60"), s.forward(x, 10).alias("fwd")).na.drop("any", subset=list(FEATURES))


def labelled_rows(spark, d):
    """Features with the label whether the next ten rows beat gold."""
    f = feature_rows(spark, d)
    g = f.where(F.col("symbol") == v.GOLD).select("date", F.col("fwd").alias("g"))
    return f.where(F.col("symbol") != v.GOLD).join(g, "date").where("fwd is not null and g is not null").withColumn("y", (F.col("fwd") > F.col("g")).cast("int"))


@query("m11_m12_feature_store", PX + f""", r as (select *, close / nullif(lag(close) {_W}, 0) - 1 as ret from prices)
  select symbol as entity, date, 'ret_5' as feature_name, round(close / nullif(lag(close, 5) {_W}, 0) - 1, 6) as feature_value from prices where true qualify close / nullif(lag(close, 5) {_W}, 0) - 1 is not null""")  # fmt: skip
def feature_store(spark, d):
    from pitframe.sources.warehouse import melt

    f = v.prices(spark, d).select("date", "symbol", F.round(Series().change(F.col("close"), 5), 6).alias("x"))
    names = [r["symbol"] for r in v.table(spark, d, "part").select(F.col("p_type").alias("symbol")).distinct().orderBy("symbol").collect()]
    wide = f.groupBy("date").pivot("symbol", names).agg(F.max("x"))
    return melt(wide.withColumnsRenamed({n: f"{n}__ret_5" for n in names}))


@query("m3_m5_classifier", None)
def classifier(spark, d):
    rows = labelled_rows(spark, d).cache()
    model = models.classifier(FEATURES, "y").fit(rows)
    return models.probability(model, rows).select("symbol", "date", "prob")


@query("m4_m17_regressor", None)
def regressor(spark, d):
    rows = labelled_rows(spark, d).cache()
    model = models.regressor(FEATURES, "fwd").fit(rows)
    return models.predicted(model, rows, "expected_return").select("symbol", "date", "expected_return")


@query("m18_logistic", None)
def logistic(spark, d):
    rows = labelled_rows(spark, d).cache()
    return models.probability(models.logistic(FEATURES, "y").fit(rows), rows).select("symbol", "date", "prob")


@query("m7_training_status", None)
def training_status(spark, d):
    rows = labelled_rows(spark, d).cache()
    few = rows.orderBy("date", "symbol").limit(50)
    got = [(name, models.train(x, FEATURES, "y")[0]) for name, x in (("all", rows), ("few", few), ("none", rows.where("false")))]
    return spark.createDataFrame(got, "rows string, status string")


WALK = labels.Walk(120, 42, 42, 10)


def _folds(spark, d):
    """Labelled rows of every symbol in the folds of its whole series."""
    return labels.walk_rows(labelled_rows(spark, d), WALK, ["symbol"])


@query("m6_walk_forward_scores", None)
def walk_forward_scores(spark, d):
    return models.fold_metrics(models.fold_scores(_folds(spark, d), FEATURES, "y", ("symbol", "fold")), ("symbol", "fold"))


@query("m6_chosen_features", None)
def chosen_feature_scores(spark, d):
    """As above, with the two features of each fold that tell most of its training rows, by boosted stumps and a logistic regression."""
    return models.fold_scores(_folds(spark, d), FEATURES, "y", ("symbol", "fold"), learners={"boosted": models.Stumps, "logistic": models.Logit}, choose=2)


@query("m8_m9_m10_asof_scores", None)
def asof_scores(spark, d):
    """Every symbol but gold at every horizon; the rows whose future is missing are scored and not trained on."""
    s, x = Series(), F.col("close")
    ahead = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon_days"), F.col(f"_f{h}").alias("ret")) for h in v.HORIZONS]))
    p = v.prices(spark, d).withColumn("ret", s.change(x, 1)).select(
        "symbol", "date", s.change(x, 5).alias("ret_5"), s.change(x, 20).alias("ret_20"), s.volatility(F.col("ret"), 20).alias("vol_20"), s.zscore(x, 60).alias("z_60"), *[s.forward(x, h).alias(f"_f{h}") for h in v.HORIZONS]
    )
    f = p.na.drop("any", subset=list(FEATURES)).select(F.col("symbol").alias("entity"), "date", *FEATURES, ahead.alias("a")).select("entity", "date", *FEATURES, "a.*")
    gold = f.where(F.col("entity") == v.GOLD).select("date", "horizon_days", F.col("ret").alias("g"))
    rows = f.where(F.col("entity") != v.GOLD).join(gold, ["date", "horizon_days"]).withColumn("alpha", F.col("ret") - F.col("g"))
    rn = F.row_number().over(Window.partitionBy("entity", "horizon_days").orderBy("date")) - 1
    return models.asof_scores(rows.withColumns({"y": (F.col("alpha") > 0).cast("int"), "rn": rn}), FEATURES)


@query("m17_expected_return", None)
def expected_return(spark, d):
    s, x = Series(), F.col("close")
    names = [c for c in features.PRICE_FEATURES if c not in ("atr_14", "rsi_14", "macd")]
    made = features.price_features(v.prices(spark, d)).join(v.prices(spark, d).select("symbol", "date", s.forward(x, 10).alias("fwd")), ["symbol", "date"])
    rows = made.na.drop("any", subset=names)
    return models.expected_returns(rows.na.fill(0.0, ["atr_14", "rsi_14", "macd"]), features.PRICE_FEATURES, "fwd", "ret_10d", ["symbol"])


@query("j2_feature_targets", PX + f""", f as (select symbol, date, close / nullif(lag(close, 5) {_W}, 0) - 1 as ret_5, lead(close, 10) {_W} / nullif(close, 0) - 1 as fwd from prices)
  select symbol, date, round(ret_5, 6) as ret_5, round(fwd, 6) as fwd from f where ret_5 is not null and fwd is not null""")  # fmt: skip
def feature_targets(spark, d):
    """Features joined with forward returns on date and symbol; rows that lack either go."""
    s, p = Series(), v.prices(spark, d)
    f = p.select("symbol", "date", F.round(s.change(F.col("close"), 5), 6).alias("ret_5")).where("ret_5 is not null")
    t = p.select("symbol", "date", F.round(s.forward(F.col("close"), 10), 6).alias("fwd")).where("fwd is not null")
    return f.join(t, ["symbol", "date"])


@query("m20_stability", None)
def stability(spark, d):
    rows = _folds(spark, d)
    keys = ("symbol", "fold", "rn")
    full, less = (models.fold_scores(rows, cols, "y", ("symbol", "fold")) for cols in (FEATURES, FEATURES[:2]))
    return models.stability(full, less, keys)


@query("m21_purged_study", None)
def purged_study(spark, d):
    """Calibration of out-of-sample scores, pooled over the folds."""
    return stats.calibration(models.fold_scores(_folds(spark, d), FEATURES, "y", ("symbol", "fold")), "y", "prob")


#: Studies by name: what is held, and what instead.
STUDIES = {"gold_vs_equities": (v.GOLD, v.BENCHMARK), "miners_vs_gold": ("LARGE", v.GOLD)}


def _out_of_sample(spark, d, entity, bench):
    """A study's rows with the scores of two learners out of sample, each date once, from the two features that tell most of each fold."""
    rows = study_frame(spark, d, entity, bench).drop("boosted", "logistic").join(feature_rows(spark, d).where(F.col("symbol") == entity).drop("fwd"), "date")
    small = stored(rows.withColumns({"entity_fwd": F.col("entity_fwd") / 1000, "bench_fwd": F.col("bench_fwd") / 1000}), "study")
    walk = labels.fitted_walk(small.count(), 10) or WALK
    folds = labels.walk_rows(small, replace(walk, step=walk.test), ["symbol"])
    return models.fold_scores(folds, [*FEATURES, "momentum"], "y", ("symbol", "fold"), ("date", "entity_fwd", "bench_fwd", "momentum"), {"boosted": models.Stumps, "logistic": models.Logit}, choose=3)


@query("m21_study_report", None)
def study_report(spark, d):
    """Gold against the benchmark: scores of two learners out of sample feed the books, their intervals and tests."""
    return inference.study_report(stored(_out_of_sample(spark, d, *STUDIES["gold_vs_equities"]), "scored"), 10)


@query("m21_both_studies", None)
def both_studies(spark, d):
    """The report of each study, and what the tests against its model say."""
    out = None
    for name, (entity, bench) in STUDIES.items():
        got = inference.study_report(stored(_out_of_sample(spark, d, entity, bench), "scored"), 10)
        got = got.select(F.lit(name).alias("study"), "*").withColumn("text", F.when(F.col("strategy") != "gradient_boosting", inference.dm_text(F.col("p_value"), F.col("mean_loss_diff"), "gradient_boosting", F.col("strategy"))))
        out = got if out is None else out.unionByName(got)
    return out


@query("m22_catalog", PREDS + """, l as (select entity, horizon_days, date, prob, row_number() over (partition by entity, horizon_days order by date desc, id desc) as k from predictions where not coalesce(starts_with(model_version, 'asof_h'), false))
  select entity, horizon_days, entity || '_clf_h' || horizon_days as model, date, prob from l where k = 1""")  # fmt: skip
def model_catalog(spark, d):
    live = v.predictions(spark, d).where(fl.is_live("model_version"))
    last = live.groupBy("entity", "horizon_days").agg(F.max(F.struct("date", "id", "prob")).alias("m"))
    return last.select("entity", "horizon_days", F.concat("entity", F.lit("_clf_h"), F.col("horizon_days").cast("string")).alias("model"), "m.date", "m.prob")


# Regimes

ROLES = {"breakeven": "MEDIUM", "real": "SMALL", "dollar": "LARGE", "vix": v.BENCHMARK, "gold": v.GOLD}
_FF = "last_value({0} ignore nulls) over (order by date rows between unbounded preceding and {1})"


def _wide_sql() -> str:
    return "wide as (select date, " + ", ".join(f"max(close) filter (symbol = '{s}') as {r}" for r, s in ROLES.items()) + " from prices where symbol in (" + ", ".join(f"'{s}'" for s in ROLES.values()) + ") group by 1)"


def _trend(c: str) -> str:
    return f"{_FF.format(c, 'current row')} / nullif({_FF.format(c, '20 preceding')}, 0) - 1"


_REGIME = f"""{_wide_sql()}, x as (select date, breakeven as inflation_level, breakeven - lag(breakeven, 20) over (order by date) as inflation_trend, real as real_yield, real - lag(real, 20) over (order by date) as real_yield_trend,
  {_trend('dollar')} as dxy_trend, vix, {_trend('gold')} as gold_trend from wide)"""  # fmt: skip


@query("m14_regime_features", PX + f", {_REGIME} select date, " + ", ".join(f"round({c}, 6) as {c}" for c in ("inflation_level", "inflation_trend", "real_yield", "real_yield_trend", "dxy_trend", "vix", "gold_trend")) + " from x where coalesce(inflation_level, inflation_trend, real_yield, real_yield_trend, dxy_trend, vix, gold_trend) is not null")
def regime_features(spark, d):
    f = regime.features(v.prices(spark, d), ROLES)
    return f.select("date", *[F.round(c, 6).alias(c) for c in f.columns if c not in ("date", "market")])


def _market_features(spark, d):
    """What each symbol's states are told by: its trend, its volatility and its distance from its mean."""
    s, x = Series(), F.col("close")
    p = v.prices(spark, d).withColumn("ret", s.change(x, 1))
    return p.select("symbol", "date", s.change(x, 20).alias("trend"), s.volatility(F.col("ret"), 20).alias("vol"), s.zscore(x).alias("z"))


@query("m15_hidden_states", None)
def hidden_states(spark, d):
    """States of every market by a model of its own."""
    return regime.detect(_market_features(spark, d), ["trend", "vol", "z"], market="symbol")


@query("m15_pooled_states", None)
def pooled_states(spark, d):
    """States of every market by one model of all."""
    return regime.detect_pooled(_market_features(spark, d), ["trend", "vol", "z"], market="symbol")


@query("m16_regime_labels", with_views("vectors") + """, p as (select label, avg(value) filter (feature = 0) * 1 as inflation_trend, avg(value) filter (feature = 1) as real_yield_trend, avg(value) filter (feature = 2) as dxy_trend, 15 + 100 * avg(value) filter (feature = 3) as vix,
  avg(value) filter (feature = 4) as spx_trend, avg(value) filter (feature = 5) as miner_gold_spread from vectors group by 1)
  select label, case when vix > 25 then 3 when inflation_trend > 0 and real_yield_trend > 0 and dxy_trend > 0 then 1 when spx_trend < -0.03 and real_yield_trend < 0 then 4 when real_yield_trend < 0 and dxy_trend < 0 then 2 when miner_gold_spread > 0.02 then 4 else 2 end as regime_id from p""")  # fmt: skip
def regime_labels(spark, d):
    at = lambda i: F.avg(F.when(F.col("feature") == i, F.col("value")))
    p = v.vectors(spark, d).groupBy("label").agg(
        at(0).alias("inflation_trend"), at(1).alias("real_yield_trend"), at(2).alias("dxy_trend"), (15 + 100 * at(3)).alias("vix"), at(4).alias("spx_trend"), at(5).alias("miner_gold_spread")
    )
    return regime.label(p).select("label", "regime_id")


@query("r11_current_regime", with_views("regimes") + "select date, regime_id, round(confidence, 4) as confidence from regimes order by date desc limit 1")
def current_regime(spark, d):
    return regime.current(v.regimes(spark, d)).withColumn("confidence", F.round("confidence", 4))


# Rules

_SNAP = {"gold": ["ABSENT", v.GOLD], "spx": v.BENCHMARK, "dollar": "LARGE", "vix": "PROMO", "nominal": "MEDIUM", "breakeven": "SMALL"}


@query("r1_snapshot", PX + f""", e as (select max(date) as e from prices where symbol in ('{v.GOLD}', '{v.BENCHMARK}', 'LARGE', 'PROMO', 'MEDIUM', 'SMALL')), l as (select symbol, arg_max(close, date) as c from prices group by 1),
  t as (select symbol, case when count(*) > 1 then arg_max(close, date) / nullif(arg_min(close, date), 0) - 1 end as t from prices, e where date >= e - 30 group by 1),
  x as (select (select e from e) as as_of, (select c from l where symbol = '{v.GOLD}') as gold, (select c from l where symbol = '{v.BENCHMARK}') as spx, (select c from l where symbol = 'MEDIUM') as nom, (select c from l where symbol = 'SMALL') as be,
    (select t from t where symbol = 'LARGE') as dt, (select t from t where symbol = '{v.GOLD}') as gt)
  select as_of, round(gold, 4) as gold_price, round(spx, 4) as spx, case when be <= 8 then round(be, 4) end as breakeven_10y, round(nom - be, 4) as real_yields, 'breakeven_spread' as real_yield_source, round(dt * 100, 2) as dxy_trend_20d_pct, round(gt * 100, 2) as gold_trend_20d_pct,
    case when nom - be > 2 then 'hawkish / higher-for-longer' when nom - be < 1 then 'dovish / easing bias' else 'neutral' end as fed_probability, case when dt > 0.02 then 'strong' when dt < -0.02 then 'weak' else 'moderate' end as dollar_strength from x""")  # fmt: skip
def snapshot(spark, d):
    s = rules.snapshot(v.prices(spark, d), _SNAP)
    return s.select("as_of", F.round("gold_price", 4).alias("gold_price"), F.round("spx", 4).alias("spx"), F.round("breakeven_10y", 4).alias("breakeven_10y"), F.round("real_yields", 4).alias("real_yields"), "real_yield_source", "dxy_trend_20d_pct", "gold_trend_20d_pct", "fed_probability", "dollar_strength")


_STATE = """x as (select id, case when id % 11 = 0 then null else expected_return end as g, expected_alpha as b, prob * 4 as y, expected_alpha * 30 as dl, case id % 3 when 0 then 'bullish' when 1 then 'bearish' else 'neutral' end as bias from predictions),
  a as (select *, case when g > b and not (y > 2 or dl > 1) and (bias = 'bullish' or dl < -1) then 'add' when g < b and (y > 2 or dl > 1) then 'reduce' else 'keep' end as stance,
    case when y > 2 then 'headwind' when y < 1 then 'support' else 'neutral' end as yield_role, case when dl > 1 then 'headwind' when dl < -1 then 'support' else 'neutral' end as dollar_role from x)"""  # fmt: skip


def _states(spark, d):
    i = F.col("id")
    bias = F.when(i % 3 == 0, "bullish").when(i % 3 == 1, "bearish").otherwise("neutral")
    inputs = v.predictions(spark, d).select(
        "id", F.when(i % 11 != 0, F.col("expected_return")).alias("gold_ret"), F.col("expected_alpha").alias("equity_ret"), (F.col("prob") * 4).alias("real_yield"), (F.col("expected_alpha") * 30).alias("dollar_trend"),
        bias.alias("gold_bias"), F.lit("Easing").alias("regime_name"),
    )
    return rules.allocation(inputs)


@query("r2_allocation", PREDS + f", {_STATE} select id, round(g - b, 6) as spread, stance, yield_role, dollar_role, 2 + case when g is null then 1 else 1 end + case when dollar_role = 'neutral' then 0 else 1 end as n_reasons from a")
def allocation(spark, d):
    return _states(spark, d).select("id", F.round("spread", 6).alias("spread"), "stance", "yield_role", "dollar_role", F.size("reasons").alias("n_reasons"))


@query("r3_signal_book", PREDS + """, l as (select *, row_number() over (partition by entity order by date desc, id desc) as k from predictions where not coalesce(starts_with(model_version, 'asof_h'), false) and horizon_days = 20)
  select entity, upper(entity) as label, date, prob, expected_alpha, case when prob >= 0.6 and expected_alpha > 0 then 'long' when prob <= 0.4 and expected_alpha < 0 then 'short' when prob >= 0.55 then 'overweight' when prob <= 0.45 then 'underweight' else 'neutral' end as signal,
  row_number() over (order by expected_alpha desc, entity) as rank from l where k = 1""")  # fmt: skip
def signal_book(spark, d):
    p = v.predictions(spark, d)
    names = p.select("entity").distinct().select("entity", F.upper("entity").alias("label"), F.lit("all").alias("tier"))
    return rules.signal_book(p, names, 20).select("entity", "label", "date", "prob", "expected_alpha", "signal", "rank")


_CONF = "round(least(greatest({0} + case when bias = 'bullish' and {1} = 'add' or bias = 'bearish' and {1} = 'reduce' then 0.12 else 0 end - case when bias = 'bullish' and {1} = 'reduce' or bias = 'bearish' and {1} = 'add' then 0.08 else 0 end + case when n >= 4 then 0.05 else 0 end + case when reb >= 2 then 0.08 else 0 end, 0.15), 0.92), 2)"


@query("r4_playbooks", PREDS + f""", {_STATE}, s as (select *, id % 9 + 1 as n, case when id % 4 = 0 then null else id % 5 end as reb from a),
  p as (select id, 0 as o, 'gold_budget' as pid, {_CONF.format('0.55', 'stance')} as confidence, 70 + case stance when 'add' then 15 when 'reduce' then -10 else 0 end as score from s
  union all select id, 1, 'miner_sleeve', {_CONF.format('0.5', 'stance')}, 60 + least(n, 8) * 3 from s union all select id, 2, 'horizon_pick', case when reb is null then 0.3 else {_CONF.format('0.48', 'stance').replace('reb >= 2', 'true')} end, case when reb is null then 25 else 55 + reb end from s
  union all select id, 3, 'regime_overlay', {_CONF.format('0.42', 'stance')}, 45 + case bias when 'bullish' then 10 when 'bearish' then 5 else 0 end from s
  union all select id, 4, 'defensive', {_CONF.format('0.58', "'reduce'")}, case when stance = 'reduce' then 65 else 50 end from s where stance = 'reduce' or yield_role = 'headwind' or dollar_role = 'headwind')
  select id as state_id, pid as id, cast(confidence as double) as confidence, row_number() over (partition by p.id order by score desc, o) as rank, cast(round(100.0 * score / max(score) over (partition by p.id), 1) as double) as score from p""")  # fmt: skip
def playbooks(spark, d):
    i = F.col("id")
    reb = F.when(i % 4 != 0, i % 5)
    s = _states(spark, d).select(
        F.col("id").alias("state_id"), "stance", "gold_bias", "yield_role", "dollar_role", (i % 9 + 1).alias("n_sleeve"), F.lit(True).alias("has_picks"), F.lit(True).alias("has_long"),
        reb.alias("paper_rebalances"), (reb / 100.0).alias("paper_score"), F.lit(0.1).alias("paper_return"),
    )
    return rules.playbooks(s).select("state_id", "id", "confidence", "rank", "score")


@query("r5_agents", PREDS + """select id, round(greatest(0, least(1, 0.5 + case when prob * 4 < 1.5 then 0.15 when prob * 4 > 2.5 then -0.15 else 0 end + case when expected_alpha < -0.02 then 0.1 when expected_alpha > 0.02 then -0.1 else 0 end + case when expected_return > 0.1 then 0.05 else 0 end)), 6) as macro_score,
  round(least(1, prob * 1.2), 6) as conflict_score, round(least(1, abs(expected_alpha) * 10 * 1.5), 6) as energy_risk, round(greatest(0, least(1, 0.5 + expected_alpha * 0.2 - expected_return * 0.15 + prob * 0.3)), 6) as fundamental, round(least(1, prob + 0.2) * 0.9, 6) as model_confidence from predictions""")  # fmt: skip
def agents(spark, d):
    p = v.predictions(spark, d).withColumns({"real_yield": F.col("prob") * 4, "dxy_trend": F.col("expected_alpha"), "inflation_trend": F.col("expected_return"), "gpr_index": F.lit(0.3), "conflict_intensity": F.col("prob"),
        "oil_disruption": F.abs("expected_alpha") * 10, "prod_surprise": F.col("expected_alpha"), "aisc_trend": F.col("expected_return"), "eps_revision": F.col("prob"), "mean_auc": F.col("prob") + 0.2})
    got = rules.quant_agent(rules.mining_agent(rules.geopolitical_agent(rules.macro_agent(p))))
    return got.select("id", *[F.round(c, 6).alias(c) for c in ("macro_score", "conflict_score", "energy_risk", "fundamental", "model_confidence")])


@query("r6_risk_tiles", "select c_custkey, case when c_acctbal > 5000 then 'elevated' else 'normal' end as geopolitical, case when c_acctbal > 4000 then 'elevated' else 'normal' end as energy, case when c_nationkey > 30 then 'strong' else 'soft' end as official_demand, case when c_acctbal < 0 then 'outflow' else 'inflow' end as fund_flows from customer")
def tiles(spark, d):
    b = F.col("c_acctbal")
    c = v.table(spark, d, "customer").select("c_custkey", (b / 10000).alias("gpr_index"), (b / 10000).alias("oil_disruption"), F.col("c_nationkey").alias("purchases"), b.alias("etf_flow"))
    return rules.risk_tiles(c).select("c_custkey", "geopolitical", "energy", "official_demand", "fund_flows")


@query("r7_universe_book", PX + """, l as (select symbol, max(close) filter (rn = 1) as last, max(close) filter (rn = 1) / max(close) filter (rn = 21) - 1 as change, count(*) as n from (select *, row_number() over (partition by symbol order by date desc) as rn from prices) group by 1)
  select p_type as symbol, count(*) as parts, round(max(last), 4) as last, round(max(case when n > 21 then change end), 6) as change, p_type in (select symbol from prices where close > 1200) as modeled from part left join l on symbol = p_type group by 1""")  # fmt: skip
def universe_book(spark, d):
    p = v.prices(spark, d)
    ranked = p.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("close")))
    last = ranked.groupBy("symbol").agg(at(1).alias("last"), F.when(F.count("*") > 21, at(1) / at(21) - 1).alias("change"))
    modeled = p.where("close > 1200").select("symbol", F.lit(True).alias("m")).distinct()
    counts = v.table(spark, d, "part").groupBy(F.col("p_type").alias("symbol")).agg(F.count("*").alias("parts"))
    return counts.join(last, "symbol", "left").join(modeled, "symbol", "left").select("symbol", "parts", F.round("last", 4).alias("last"), F.round("change", 6).alias("change"), F.col("m").isNotNull().alias("modeled"))


@query("r8_history", PREDS + """, l as (select *, row_number() over (partition by date, entity order by id desc) as k from predictions where starts_with(model_version, 'asof_h') and horizon_days = 10) select date, entity, prob, expected_alpha from l where k = 1""")
def history(spark, d):
    p = v.predictions(spark, d).where(fl.is_asof("model_version") & (F.col("horizon_days") == 10))
    return p.groupBy("date", "entity").agg(F.max(F.struct("id", "prob", "expected_alpha")).alias("m")).select("date", "entity", "m.prob", "m.expected_alpha")


@query("r9_research_desk", with_views("predictions", "regimes") + f"""select 'regimes' as part, count(*) as n from regimes where date >= date '{v.AS_OF}' - 365 and date <= date '{v.AS_OF}' union all select 'signals', count(distinct entity) from predictions where not coalesce(starts_with(model_version, 'asof_h'), false) union all select 'hypotheses', 19""")
def research_desk(spark, d):
    from pitframe.sources.warehouse import lookback

    part = lambda name, df: df.select(F.lit(name).alias("part"), F.col("n").cast("long").alias("n"))
    r = lookback(v.regimes(spark, d), 365, v.AS_OF).agg(F.count("*").alias("n"))
    s = v.predictions(spark, d).where(fl.is_live("model_version")).agg(F.count_distinct("entity").alias("n"))
    return part("regimes", r).unionByName(part("signals", s)).unionByName(part("hypotheses", seeds.graph_edges(spark).agg(F.count("*").alias("n"))))


@query("r10_explain", with_views("obs", "predictions") + "select 'obs' as name, count(*) as n from obs union all select 'predictions', count(*) from predictions union all select 'nodes', 21 union all select 'core edges', 5")
def explain(spark, d):
    part = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    got = part("obs", v.obs(spark, d)).unionByName(part("predictions", v.predictions(spark, d)))
    return got.unionByName(part("nodes", seeds.graph_nodes(spark))).unionByName(part("core edges", seeds.graph_edges(spark).where("core").limit(8)))


@query("c1_c2_runs", """with r as (select ['refresh_prices', 'rescore_signals', 'train_short', 'rebuild_paper', 'full', 'unknown', null][event_id % 7 + 1] as preset, event_id % 4 = 0 as own_stages, user_id % 3 = 0 as own_horizons, user_id % 2 = 0 as even from events)
  select preset, cast(case when own_stages then 1 when preset = 'refresh_prices' then 3 when preset in ('rescore_signals', 'train_short', 'rebuild_paper') then 2 else 8 end as integer) as stages,
    cast(case when own_horizons then case when even then 2 else 1 end when preset in ('train_short', 'rebuild_paper') then 3 else 5 end as integer) as horizons, count(*) as requests from r group by 1, 2, 3""")  # fmt: skip
def runs(spark, d):
    """What runs are asked for by events: a preset that may be unknown, with stages and horizons of which some are."""
    from pitframe.pipeline import PRESETS, resolve_rows

    e = v.table(spark, d, "events").select("event_id", "user_id", "event_type")
    preset = F.element_at(F.array(*map(F.lit, [*PRESETS, "unknown", None])), (F.col("event_id") % 7 + 1).cast("int"))
    stages = F.when(F.col("event_id") % 4 == 0, F.array("event_type", F.lit("train")))
    horizons = F.when(F.col("user_id") % 3 == 0, F.array(F.lit(5), F.lit(7), (F.lit(20) + F.col("user_id") % 2).cast("int")))
    got = resolve_rows(e.select(preset.alias("preset"), stages.alias("stages"), horizons.alias("horizons")))
    return got.select("preset", F.size("stages").alias("stages"), F.size("horizons").alias("horizons")).groupBy("preset", "stages", "horizons").agg(F.count("*").alias("requests"))


@query("c5_study_rows", with_views("prices") + f""", p as (select symbol, date, close / nullif(lag(close, 20) {_W}, 0) - 1 as m, lead(close, 10) {_W} / nullif(close, 0) - 1 as f from prices)
  select count(*) as n, min(a.date) as first, max(a.date) as last from p a join p b on b.symbol = '{v.BENCHMARK}' and a.date = b.date where a.symbol = '{v.GOLD}' and a.f is not null and b.f is not null and a.m is not null and b.m is not null""")  # fmt: skip
def study_rows(spark, d):
    return study_frame(spark, d).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


QUERIES, ORACLES = query.queries, query.oracles
