"""String columns: keyword scores, feature names, display formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of each risk component.
RISK_WORDS = {
    "conflict_intensity": ("war", "invasion", "missile", "airstrike", "casualties", "conflict"),
    "sanctions_score": ("sanction", "embargo", "blacklist", "export ban", "tariff"),
    "oil_disruption": ("pipeline", "opec", "oil disruption", "refinery", "strait"),
    "military_escalation": ("troops", "mobilization", "nato", "deployment", "military exercise"),
    "shipping_disruption": ("red sea", "suez", "shipping lane", "port closure", "houthi"),
    "trade_restrictions": ("trade war", "export restriction", "import ban", "decoupling"),
    "election_uncertainty": ("election", "ballot", "referendum", "political uncertainty"),
}


def keyword_score(text: Column, words: Sequence[str]) -> Column:
    """Share of the words that the text holds anywhere, in any case; 0 without words."""
    if not words:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.least(hits / float(len(words)), F.lit(1.0))


def entity_of(name: Column) -> Column:
    return F.element_at(F.split(name, "__"), 1)


def feature_of(name: Column) -> Column:
    return F.element_at(F.split(name, "__"), -1)


def feature_key(entity: Column, feature: Column) -> Column:
    return F.concat_ws("__", entity, feature)


def percent(x: Column, digits: int = 1) -> Column:
    """A share shown as a percentage with its sign; a dash for null."""
    shown = F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string(f"%.{digits}f", x * 100), F.lit("%"))
    return F.when(x.isNull(), "—").otherwise(shown)


def money(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.concat(F.lit("$"), F.format_number(x, 2)))
