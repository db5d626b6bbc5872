"""Names, weights, lists and texts that results must agree on."""

# --- Fixed values: input series ------------------------------------------------
SERIES = ("FEDFUNDS", "UNRATE", "CPI", "GDP", "TREASURY", "VIX")

SERIES_LABELS = {
    "FEDFUNDS": "Federal Funds Rate",
    "UNRATE": "Unemployment Rate",
    "CPIAUCSL": "Consumer Price Index",
    "GDP": "Gross Domestic Product",
    "DGS10": "10-Year Treasury Yield",
    "VIXCLS": "VIX Volatility Index",
}

# File name of a series -> column it becomes.
SERIES_COLUMNS = {
    "FEDFUNDS": "FEDFUNDS",
    "UNRATE": "UNRATE",
    "CPIAUCSL": "CPI",
    "GDP": "GDP",
    "DGS10": "TREASURY",
    "VIXCLS": "VIX",
}

# How each series becomes monthly: last observation or mean of the month.
MONTHLY_RULES = {
    "FEDFUNDS": "last",
    "UNRATE": "last",
    "CPI": "last",
    "GDP": "last",
    "TREASURY": "mean",
    "VIX": "mean",
}

# --- Fixed values: index -------------------------------------------------------
Z_INPUTS = {
    "Z_FEDFUNDS": "FEDFUNDS",
    "Z_UNRATE": "UNRATE",
    "Z_INFLATION": "INFLATION_RATE",
    "Z_GDP_GROWTH": "GDP_GROWTH",
    "Z_VIX": "VIX",
}

INDEX_WEIGHTS = {
    "Z_FEDFUNDS": 0.15,
    "Z_UNRATE": 0.25,
    "Z_INFLATION": 0.25,
    "Z_GDP_GROWTH": -0.20,
    "Z_VIX": 0.15,
}

MIN_PERIODS = 24
HORIZON_MONTHS = 3
RISE_POINTS = 5.0

# --- Fixed values: historical periods, in listing order (later wins) -----------
CRISIS_PERIODS = (
    ("1973-10-01", "1975-03-01", "Oil Crisis"),
    ("1987-09-01", "1987-12-01", "Black Monday"),
    ("2000-03-01", "2002-10-01", "Dot-com Crash"),
    ("2007-12-01", "2009-06-01", "Global Financial Crisis"),
    ("2020-02-01", "2020-06-01", "COVID Crash"),
    ("2022-03-01", "2023-01-01", "Inflation Shock"),
)

# --- Fixed values: model inputs ------------------------------------------------
TARGET = "TARGET_RISK_RISING_3M"
LEVEL_TARGET = "TARGET_STRESS_3M"

NOT_FEATURES = (
    "date",
    "TARGET_STRESS_3M",
    "TARGET_STRESS_CHANGE_3M",
    "TARGET_RISK_RISING_3M",
    "TARGET_CRISIS_3M",
    "CRISIS",
    "CRISIS_NAME",
    "RAW_ECON_STRESS",
)

CURATED_FEATURES = (
    "ECON_STRESS", "STRESS_CHANGE_1M", "STRESS_CHANGE_3M", "STRESS_GAP_3M",
    "STRESS_VOLATILITY_6M", "STRESS_ACCELERATION",
    "INFLATION_RATE", "GDP_GROWTH", "GDP_MOMENTUM",
    "UNRATE", "UNRATE_CHANGE", "UNRATE_MOMENTUM",
    "FEDFUNDS", "FED_CHANGE", "FED_MOMENTUM",
    "TREASURY", "TREASURY_CHANGE",
    "VIX", "VIX_CHANGE", "VIX_VOLATILITY", "VIX_MOMENTUM",
)

FEATURE_GROUPS = {
    "Labour Market": (
        "UNRATE", "UNRATE_CHANGE", "UNRATE_3M_AVG", "UNRATE_LAG1",
        "UNRATE_MOMENTUM", "Z_UNRATE",
    ),
    "Inflation": (
        "CPI", "CPI_3M_AVG", "CPI_LAG1", "INFLATION_RATE", "Z_INFLATION",
    ),
    "Economic Growth": (
        "GDP", "GDP_3M_AVG", "GDP_LAG1", "GDP_GROWTH", "GDP_MOMENTUM",
        "Z_GDP_GROWTH",
    ),
    "Monetary Policy": (
        "FEDFUNDS", "FED_CHANGE", "FED_3M_AVG", "FED_6M_AVG", "FED_LAG1",
        "FED_VOLATILITY", "FED_MOMENTUM", "Z_FEDFUNDS",
    ),
    "Treasury Conditions": (
        "TREASURY", "TREASURY_CHANGE", "TREASURY_LAG1",
    ),
    "Market Volatility": (
        "VIX", "VIX_CHANGE", "VIX_3M_AVG", "VIX_LAG1", "VIX_VOLATILITY",
        "VIX_MOMENTUM", "Z_VIX",
    ),
    "Stress Dynamics": (
        "ECON_STRESS", "STRESS_CHANGE_1M", "STRESS_CHANGE_3M", "STRESS_3M_AVG",
        "STRESS_GAP_3M", "STRESS_VOLATILITY_6M", "STRESS_ACCELERATION",
    ),
}
OTHER_GROUP = "Other Indicators"

ALL_FEATURES = tuple(f for group in FEATURE_GROUPS.values() for f in group)

THRESHOLDS = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
ALERT_THRESHOLD = 0.35
CORRELATION_THRESHOLD = 0.90

# --- Fixed values: country-year panel ------------------------------------------
PANEL_YEARS = (2000, 2025)

PANEL_COUNTRIES = {
    "IND": "India",
    "PAK": "Pakistan",
    "LKA": "Sri Lanka",
    "ARG": "Argentina",
    "EGY": "Egypt",
    "USA": "United States",
}

PANEL_INDICATORS = {
    "NY.GDP.MKTP.KD.ZG": "gdp_growth",
    "NY.GDP.PCAP.CD": "gdp_per_capita_usd",
    "FP.CPI.TOTL.ZG": "inflation",
    "SL.UEM.TOTL.ZS": "unemployment",
    "BN.CAB.XOKA.GD.ZS": "current_account_gdp",
    "FI.RES.TOTL.MO": "reserves_months_imports",
    "PA.NUS.FCRF": "official_exchange_rate",
    "NE.TRD.GNFS.ZS": "trade_gdp",
    "BX.KLT.DINV.WD.GD.ZS": "fdi_inflows_gdp",
    "DT.DOD.DECT.GN.ZS": "external_debt_gni",
}

# --- Fixed values: document texts ----------------------------------------------
TARGET_TEXT = (
    "Economic stress increases by at least five points within three months."
)
VALIDATION_METHOD = "Five-fold chronological walk-forward validation"
REACHED_TEXT = "The warning threshold has been reached."
NOT_REACHED_TEXT = "The warning threshold has not been reached."
LIMITATIONS = (
    "This is an experimental early-warning model, not financial advice.",
    "The probability has not yet undergone formal probability calibration.",
    "SHAP values describe model contributions and do not prove economic causation.",
    "The current U.S. model produces a relatively high number of false alarms.",
)
HISTORY_NOTES = (
    "Economic stress is displayed on a zero-to-one-hundred index.",
    "Crisis overlays are historical labels and are not model predictions.",
    "Missing indicator values are represented as null.",
)
EXPLANATION_NOTE = (
    "The contributions describe model behaviour and do not prove economic causation."
)
CRISES_NOTE = "These are historical labels, not future crisis predictions."
