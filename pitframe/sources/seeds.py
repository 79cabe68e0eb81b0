"""Seed data and reference dimensions as small DataFrames."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

# Market context (symbol, price feed code, rate series, name, category).
MACRO_CONTEXT = (
    ('DX-Y.NYB', 'DX-Y.NYB', 'DTWEXBGS', 'US Dollar Index', 'fx'),
    ('US02Y', '^IRX', 'DGS2', '2-Year Treasury Yield', 'rates'),
    ('US10Y', '^TNX', 'DGS10', '10-Year Treasury Yield', 'rates'),
    ('US10Y_REAL', None, 'DFII10', '10-Year Real Yield (TIPS)', 'rates'),
    ('T10YIE', None, 'T10YIE', '10-Year Breakeven Inflation', 'rates'),
    ('NG=F', 'NG=F', None, 'Natural Gas', 'energy'),
    ('CL=F', 'CL=F', None, 'WTI Crude Oil', 'energy'),
    ('VIX', '^VIX', 'VIXCLS', 'VIX', 'volatility'),
    ('SPX', '^GSPC', None, 'S&P 500', 'equity'),
)

# Instruments (symbol, name, metal, instrument, tier, priced, scored).
INSTRUMENTS = (
    ('GC=F', 'Gold Futures', 'gold', 'future', 'gold', True, True),
    ('MGC=F', 'Micro Gold Futures', 'gold', 'future', 'gold', True, True),
    ('SI=F', 'Silver Futures', 'silver', 'future', 'silver', True, True),
    ('SIL=F', 'Micro Silver Futures', 'silver', 'future', 'silver', True, True),
    ('PL=F', 'Platinum Futures', 'platinum', 'future', 'pgm', True, True),
    ('PA=F', 'Palladium Futures', 'palladium', 'future', 'pgm', True, True),
    ('HG=F', 'Copper Futures', 'copper', 'future', 'copper', True, True),
    ('ALI=F', 'Aluminum Futures', 'aluminum', 'future', 'base', True, True),
    ('GLD', 'SPDR Gold Shares', 'gold', 'bullion_etf', 'gold', True, True),
    ('IAU', 'iShares Gold Trust', 'gold', 'bullion_etf', 'gold', True, True),
    ('SGOL', 'abrdn Physical Gold', 'gold', 'bullion_etf', 'gold', True, True),
    ('GLDM', 'SPDR Gold MiniShares', 'gold', 'bullion_etf', 'gold', True, True),
    ('BAR', 'GraniteShares Gold Trust', 'gold', 'bullion_etf', 'gold', True, True),
    ('OUNZ', 'VanEck Merk Gold Trust', 'gold', 'bullion_etf', 'gold', True, True),
    ('SLV', 'iShares Silver Trust', 'silver', 'bullion_etf', 'silver', True, True),
    ('SIVR', 'abrdn Physical Silver', 'silver', 'bullion_etf', 'silver', True, True),
    ('PPLT', 'abrdn Physical Platinum', 'platinum', 'bullion_etf', 'pgm', True, True),
    ('PALL', 'abrdn Physical Palladium', 'palladium', 'bullion_etf', 'pgm', True, True),
    ('GLTR', 'abrdn Physical Precious Metals Basket', 'basket', 'bullion_etf', 'gold', True, True),
    ('CPER', 'United States Copper Index', 'copper', 'bullion_etf', 'copper', True, True),
    ('GDX', 'VanEck Gold Miners', 'gold', 'miner_etf', 'senior', True, True),
    ('GDXJ', 'VanEck Junior Gold Miners', 'gold', 'miner_etf', 'junior', True, True),
    ('RING', 'iShares MSCI Global Gold Miners', 'gold', 'miner_etf', 'royalty', True, True),
    ('GOAU', 'US Global GO Gold and Precious Metal Miners', 'gold', 'miner_etf', 'senior', True, True),
    ('SGDJ', 'Sprott Junior Gold Miners', 'gold', 'miner_etf', 'junior', True, True),
    ('SIL', 'Global X Silver Miners', 'silver', 'miner_etf', 'silver', True, True),
    ('SILJ', 'Amplify Junior Silver Miners', 'silver', 'miner_etf', 'silver', True, True),
    ('COPX', 'Global X Copper Miners', 'copper', 'miner_etf', 'copper', True, True),
    ('NUGT', 'Direxion Daily Gold Miners Bull 2x', 'gold', 'leveraged', 'leveraged', True, False),
    ('DUST', 'Direxion Daily Gold Miners Bear 2x', 'gold', 'leveraged', 'leveraged', True, False),
    ('JNUG', 'Direxion Daily Junior Gold Miners Bull 2x', 'gold', 'leveraged', 'leveraged', True, False),
    ('JDST', 'Direxion Daily Junior Gold Miners Bear 2x', 'gold', 'leveraged', 'leveraged', True, False),
    ('AGQ', 'ProShares Ultra Silver', 'silver', 'leveraged', 'leveraged', True, False),
    ('ZSL', 'ProShares UltraShort Silver', 'silver', 'leveraged', 'leveraged', True, False),
    ('NEM', 'Newmont', 'gold', 'producer', 'senior', True, True),
    ('AEM', 'Agnico Eagle Mines', 'gold', 'producer', 'senior', True, True),
    ('B', 'Barrick Mining', 'gold', 'producer', 'senior', True, True),
    ('KGC', 'Kinross Gold', 'gold', 'producer', 'senior', True, True),
    ('AU', 'AngloGold Ashanti', 'gold', 'producer', 'senior', True, True),
    ('GFI', 'Gold Fields', 'gold', 'producer', 'senior', True, True),
    ('HMY', 'Harmony Gold', 'gold', 'producer', 'senior', True, True),
    ('AGI', 'Alamos Gold', 'gold', 'producer', 'mid', True, True),
    ('EGO', 'Eldorado Gold', 'gold', 'producer', 'mid', True, True),
    ('BTG', 'B2Gold', 'gold', 'producer', 'mid', True, True),
    ('EQX', 'Equinox Gold', 'gold', 'producer', 'mid', True, True),
    ('IAG', 'IAMGOLD', 'gold', 'producer', 'mid', True, True),
    ('SSRM', 'SSR Mining', 'gold', 'producer', 'mid', True, True),
    ('SA', 'Seabridge Gold', 'gold', 'developer', 'junior', True, True),
    ('NG', 'Novagold', 'gold', 'developer', 'junior', True, True),
    ('PAAS', 'Pan American Silver', 'silver', 'producer', 'silver', True, True),
    ('HL', 'Hecla Mining', 'silver', 'producer', 'silver', True, True),
    ('CDE', 'Coeur Mining', 'silver', 'producer', 'silver', True, True),
    ('AG', 'First Majestic Silver', 'silver', 'producer', 'silver', True, True),
    ('FSM', 'Fortuna Mining', 'silver', 'producer', 'silver', True, True),
    ('EXK', 'Endeavour Silver', 'silver', 'producer', 'silver', True, True),
    ('MAG', 'MAG Silver', 'silver', 'producer', 'silver', True, False),
    ('FNV', 'Franco-Nevada', 'gold', 'royalty', 'royalty', True, True),
    ('WPM', 'Wheaton Precious Metals', 'silver', 'royalty', 'royalty', True, True),
    ('RGLD', 'Royal Gold', 'gold', 'royalty', 'royalty', True, True),
    ('OR', 'OR Royalties', 'gold', 'royalty', 'royalty', True, True),
    ('TFPM', 'Triple Flag Precious Metals', 'gold', 'royalty', 'royalty', True, True),
    ('SAND', 'Sandstorm Gold', 'gold', 'royalty', 'royalty', True, False),
    ('SBSW', 'Sibanye Stillwater', 'pgm', 'producer', 'pgm', True, True),
    ('FCX', 'Freeport-McMoRan', 'copper', 'producer', 'copper', True, True),
    ('SCCO', 'Southern Copper', 'copper', 'producer', 'copper', True, True),
    ('TECK', 'Teck Resources', 'copper', 'producer', 'copper', True, True),
    ('HBM', 'Hudbay Minerals', 'copper', 'producer', 'copper', True, True),
    ('BHP', 'BHP Group', 'diversified', 'producer', 'base', True, True),
    ('RIO', 'Rio Tinto', 'diversified', 'producer', 'base', True, True),
    ('VALE', 'Vale', 'diversified', 'producer', 'base', True, True),
    ('CCJ', 'Cameco', 'uranium', 'producer', 'uranium', True, True),
    ('UEC', 'Uranium Energy', 'uranium', 'producer', 'uranium', True, True),
    ('URNM', 'Sprott Uranium Miners', 'uranium', 'miner_etf', 'uranium', True, True),
    ('LME_ZINC', 'LME Zinc', 'zinc', 'future', 'base', False, False),
    ('LME_NICKEL', 'LME Nickel', 'nickel', 'future', 'base', False, False),
    ('LME_LEAD', 'LME Lead', 'lead', 'future', 'base', False, False),
    ('LME_TIN', 'LME Tin', 'tin', 'future', 'base', False, False),
    ('LME_COBALT', 'Cobalt', 'cobalt', 'future', 'base', False, False),
    ('LEASE', 'Gold lease rate / GOFO', 'gold', 'otc_rate', 'gold', False, False),
    ('SHFE_PREM', 'Shanghai gold premium', 'gold', 'physical', 'gold', False, False),
    ('COIN_PREM', 'Coin and bar premiums', 'gold', 'physical', 'gold', False, False),
    ('OPTIONS', 'Listed options on futures and ETFs', 'basket', 'option', 'leveraged', False, False),
    ('STREAM', 'Private streams and offtake', 'basket', 'private', 'royalty', False, False),
)

# Causal edges (source, target, direction, hypothesis, lag in days, magnitude, evidence);
# the first five are the core chain.
EDGES = (
    ('Fed Policy', 'Real Interest Rates', 'positive', 'Hawkish Fed guidance raises real yields via higher nominal rates and inflation expectations.', 1, '+25bp Fed hike → +15-30bp real yields', 'strong'),
    ('Real Interest Rates', 'Dollar (DXY)', 'positive', 'Higher real yields attract foreign capital, strengthening USD.', 1, '+40bp real yields → DXY +1-2%', 'strong'),
    ('Dollar (DXY)', 'Gold', 'negative', "Gold is priced in USD; stronger dollar reduces foreign demand and gold's appeal.", 0, 'DXY +1% → Gold -0.5 to -1.5%', 'strong'),
    ('Gold', 'Mining Margins', 'positive', 'Higher gold prices expand revenue while AISC is relatively fixed short-term.', 0, 'Gold +10% → margins expand 15-25% for low-cost producers', 'strong'),
    ('Mining Margins', 'Mining Stocks', 'positive', 'Margin expansion drives earnings revisions and equity re-rating.', 5, 'Margin +5% → equity +8-15% with operating leverage', 'moderate'),
    ('China Demand', 'Gold', 'positive', 'Chinese retail and institutional demand (jewelry, savings) supports gold prices.', 30, 'Strong China PMI → gold +2-4% over 3 months', 'moderate'),
    ('Central Bank Purchases', 'Gold', 'positive', 'Structural CB buying removes supply from market, creating persistent bid.', 0, '+100t annual CB buying → ~$8B structural demand', 'strong'),
    ('Inflation', 'Gold', 'positive', "Gold serves as inflation hedge when real yields don't fully compensate.", 5, 'CPI surprise +0.3% → gold +1-2% if real yields flat', 'moderate'),
    ('Oil', 'Gold', 'mixed', 'Oil spikes signal inflation/stagflation (gold bid) but can tighten financial conditions.', 2, 'Oil +10% → gold +1-3% in risk-off; neutral in growth scare', 'moderate'),
    ('Treasury Yields', 'Real Interest Rates', 'positive', 'Nominal yield moves drive real yield when breakevens are sticky.', 0, '10Y +50bp with flat breakevens → real yields +50bp', 'strong'),
    ('VIX', 'Gold', 'positive', 'Risk-off episodes drive safe-haven gold demand.', 0, 'VIX spike +10 → gold +0.5-1.5%', 'moderate'),
    ('Wars', 'Gold', 'positive', 'Geopolitical conflict increases safe-haven and de-dollarization demand.', 0, 'Major conflict onset → gold +3-8% in first week', 'strong'),
    ('Sanctions', 'Central Bank Purchases', 'positive', 'Sanctioned nations accelerate gold reserves to bypass USD system.', 60, 'New sanctions regime → CB buying +20-50t annually', 'moderate'),
    ('ETF Flows', 'Gold', 'positive', 'GLD/IAU inflows represent marginal price-setting demand.', 1, '+$1B weekly inflows → gold +1-2%', 'moderate'),
    ('Real Interest Rates', 'Mining Stocks', 'negative', 'If real yields rise 40bp, GDX underperforms gold due to discount rate effect.', 5, '+40bp real yields → GDX underperforms gold by 3-8%', 'strong'),
    ('S&P 500', 'Mining Stocks', 'positive', 'Risk-on lifts beta-sensitive miners; risk-off hurts despite gold bid.', 0, 'SPX +1% → GDX +1.2-2x beta', 'moderate'),
    ('Copper', 'Mining Stocks', 'positive', 'Copper reflects global growth; rising copper signals risk-on for miners.', 2, 'Copper +5% → miners +2-4% on growth optimism', 'weak'),
    ('AISC', 'Mining Margins', 'negative', 'Rising all-in sustaining costs compress margins even at stable gold prices.', 90, 'AISC +$50/oz → margins -3-5%', 'strong'),
    ('Political Risk', 'Mining Stocks', 'negative', 'Jurisdiction risk discounts NAV and increases cost of capital.', 30, 'Political risk +1σ → miner discount widens 5-10%', 'moderate'),
)

# Nodes (name, category, description, data source).
NODES = (
    ('Fed Policy', 'monetary', 'FOMC decisions, dot plot, Fed speeches', 'FRED, Fed'),
    ('Real Interest Rates', 'monetary', '10Y TIPS yield', 'FRED'),
    ('Treasury Yields', 'monetary', '2Y and 10Y nominal yields', 'FRED'),
    ('Dollar (DXY)', 'fx', 'Trade-weighted USD index', 'FRED/yfinance'),
    ('Inflation', 'macro', 'CPI, PCE, breakevens', 'FRED'),
    ('Gold', 'commodity', 'COMEX gold futures', 'CME/yfinance'),
    ('Silver', 'commodity', 'Precious/industrial metal', 'yfinance'),
    ('Copper', 'commodity', 'Industrial demand proxy', 'yfinance'),
    ('Oil', 'commodity', 'WTI crude', 'yfinance'),
    ('Natural Gas', 'commodity', 'Energy input costs', 'yfinance'),
    ('VIX', 'volatility', 'Equity implied volatility', 'FRED/yfinance'),
    ('S&P 500', 'equity', 'US equity benchmark', 'yfinance'),
    ('China Demand', 'demand', 'Chinese gold imports and consumption', 'WGC, customs'),
    ('Central Bank Purchases', 'demand', 'Official sector gold buying', 'WGC'),
    ('ETF Flows', 'demand', 'GLD, IAU, SGOL flows', 'ETF providers'),
    ('Wars', 'geopolitical', 'Active military conflicts', 'GDELT, ACLED'),
    ('Sanctions', 'geopolitical', 'Trade and financial restrictions', 'GDELT, OFAC'),
    ('Mining Margins', 'fundamental', 'Revenue - AISC per ounce', 'Company filings'),
    ('AISC', 'fundamental', 'All-in sustaining cost per oz', 'Company filings'),
    ('Political Risk', 'fundamental', 'Mine jurisdiction risk score', 'Composite'),
    ('Mining Stocks', 'equity', 'GDX, individual miners', 'yfinance'),
)

# Regimes (id, name, description, drivers, gold bias, miner bias).
REGIMES = (
    (1, "Stagflation / Tightening", "Inflation rising, rates rising, USD rising → gold weak", ["Inflation", "Real Interest Rates", "Dollar (DXY)"], "bearish", "bearish"),
    (2, "Easing / Dollar Weak", "Inflation falling, Fed easing, dollar falling → gold strong", ["Fed Policy", "Real Interest Rates", "Dollar (DXY)"], "bullish", "bullish"),
    (3, "Geopolitical Crisis", "War, oil spike, risk-off → gold bid", ["Wars", "Oil", "VIX"], "bullish", "mixed"),
    (4, "Recession / Rate Cuts", "Recession, rate cuts, weak dollar → miners outperform", ["Fed Policy", "S&P 500", "Real Interest Rates"], "bullish", "bullish"),
)

# Tonnes that countries bought in the first three months of 2024.
PURCHASES_2024 = {
    "China": (15.0, 12.0, 18.0),
    "India": (8.0, 6.0, 7.0),
    "Turkey": (10.0, 5.0, 8.0),
    "Russia": (6.0, 4.0, 5.0),
    "Kazakhstan": (3.0, 2.0, 4.0),
    "Singapore": (2.0, 1.5, 2.5),
    "Poland": (5.0, 4.0, 6.0),
}

# Fundamentals of the quarter to 2024-09-30 (ticker, ounces, cost per ounce, cash, debt,
# operating and free cash flow, reserve years, political risk, EPS revision).
QUARTERLY = (
    ("NEM", 1_580_000.0, 1285.0, 3200.0, 5400.0, 890.0, 420.0, 12.0, 0.35, 0.02),
    ("AEM", 890_000.0, 1150.0, 1100.0, 800.0, 520.0, 310.0, 14.0, 0.20, 0.05),
    ("B", 1_020_000.0, 1320.0, 2800.0, 4200.0, 650.0, 280.0, 10.0, 0.55, -0.01),
    ("KGC", 520_000.0, 1180.0, 680.0, 1200.0, 280.0, 150.0, 8.0, 0.60, 0.03),
    ("AGI", 145_000.0, 1095.0, 320.0, 0.0, 95.0, 72.0, 11.0, 0.25, 0.08),
)

# Days from observation to release by series; 1 for others.
PUBLICATION_LAG = {"DGS2": 1, "DGS10": 1, "DFII10": 1, "T10YIE": 1, "VIXCLS": 1, "DTWEXBGS": 1, "CPIAUCSL": 45, "PCEPI": 30}

EQUITY_KINDS = ("producer", "royalty", "developer")
NYSE = ("NEM", "B", "KGC", "AGI")


def macro_context(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MACRO_CONTEXT), "symbol string, feed string, series string, name string, category string")


def instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INSTRUMENTS), "symbol string, name string, metal string, instrument string, tier string, priced boolean, scored boolean")


def companies(spark: SparkSession) -> DataFrame:
    """Listed companies of the universe, with the exchange rule."""
    rows = [(s, n, t, "NYSE" if s in NYSE else "TSX", True) for s, n, _, kind, t, priced, _ in INSTRUMENTS if priced and kind in EQUITY_KINDS]
    return spark.createDataFrame(rows, "ticker string, name string, tier string, exchange string, is_active boolean")


def purchases(spark: SparkSession) -> DataFrame:
    rows = [(date(2024, m + 1, 1), c, t) for c, months in PURCHASES_2024.items() for m, t in enumerate(months)]
    return spark.createDataFrame(rows, "month date, country string, purchase_tonnes double")


def quarterly(spark: SparkSession) -> DataFrame:
    schema = (
        "ticker string, production_oz double, aisc_per_oz double, cash_millions double, debt_millions double, operating_cash_flow double, "
        "free_cash_flow double, reserve_life_years double, political_risk_score double, analyst_eps_revision double"
    )
    return spark.createDataFrame(list(QUARTERLY), schema).selectExpr("*", "date '2024-09-30' as quarter_end")


def graph_edges(spark: SparkSession) -> DataFrame:
    rows = [(i, *e, i < 5) for i, e in enumerate(EDGES)]
    return spark.createDataFrame(
        rows, "edge_id int, source string, target string, direction string, hypothesis string, lag_days int, magnitude_hint string, evidence_strength string, core boolean"
    )


def graph_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NODES), "name string, category string, description string, data_source string")


def regime_hypotheses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGIMES), "regime_id int, name string, description string, key_drivers array<string>, gold_bias string, miner_bias string")
