"""Labels and versions: conditional columns over scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASOF_PREFIX = "asof_h"
HORIZON_LABELS = {5: "5d", 10: "10d", 20: "1m", 63: "3m", 126: "6m"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_asof(version: Column | str) -> Column:
    return F.coalesce(_c(version).startswith(ASOF_PREFIX), F.lit(False))


def is_live(version: Column | str) -> Column:
    """A version that is null or empty counts as live."""
    return ~is_asof(version)


def scoring_path(version: Column | str) -> Column:
    return F.when(is_asof(version), "asof_embargo").otherwise("full_sample_live")


def asof_version(horizon: Column | str) -> Column:
    return F.concat(F.lit(ASOF_PREFIX), _c(horizon).cast("string"))


def signal(prob: Column | str, alpha: Column | str) -> Column:
    """The call on a name; conviction needs the sign of alpha, and comes first."""
    p, a = _c(prob), _c(alpha)
    return (
        F.when((p >= 0.6) & (a > 0), "long").when((p <= 0.4) & (a < 0), "short")
        .when(p >= 0.55, "overweight").when(p <= 0.45, "underweight").otherwise("neutral")
    )


def horizon_label(days: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in HORIZON_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(names, _c(days)), F.concat(_c(days).cast("string"), F.lit("d")))


def finite(x: Column | str, default: float | None = None) -> Column:
    """x, or the default where it is null, not a number or infinite."""
    ok = _c(x).isNotNull() & ~F.isnan(_c(x)) & (F.abs(_c(x)) < F.lit(float("inf")))
    return F.when(ok, _c(x)).otherwise(F.lit(default).cast("double"))


def fed_bias(real_yield: Column) -> Column:
    return F.when(real_yield > 2.0, "hawkish / higher-for-longer").when(real_yield < 1.0, "dovish / easing bias").otherwise("neutral")


def dollar_strength(trend: Column) -> Column:
    return F.when(trend > 0.02, "strong").when(trend < -0.02, "weak").otherwise("moderate")


def inflation_label(breakeven: Column) -> Column:
    return F.when(breakeven > 2.5, "elevated").when(breakeven < 2.0, "cooling").otherwise("moderate")


def stance(gold_ret: Column, bench_ret: Column, real_yield: Column, dollar_20: Column, gold_bias: Column) -> Column:
    """add, keep or reduce; a comparison with a null is not met."""
    met = lambda c: F.coalesce(c, F.lit(False))
    headwind = met(real_yield > 2) | met(dollar_20 > 1)
    support = met(gold_bias == "bullish") | met(dollar_20 < -1)
    return F.when(met(gold_ret > bench_ret) & ~headwind & support, "add").when(met(gold_ret < bench_ret) & headwind, "reduce").otherwise("keep")
