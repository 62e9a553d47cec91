"""Registries as plain constants and as small DataFrames.

Everything here is a fixed, known-size table (at most ~100 rows), which is why
these are the only tables the library broadcasts without a size check.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = "financial_metrics_2025"
CONTEXT = "_document_context"

# KPI registry in order -- key, label, path below the metrics root, unit type.
KPI_REGISTRY = [
    ("revenue_growth", "Revenue Growth", ["revenue_growth"], "pct"),
    ("gross_profit_margin", "Gross Profit Margin", ["profit_margins", "gross_profit_margin"], "pct"),
    ("ebitda_margin", "EBITDA Margin", ["profit_margins", "ebitda_margin"], "pct"),
    ("cash_in_bank_end_of_year", "Cash in Bank", ["cash_flow_indicators", "cash_in_bank_end_of_year"], "usd"),
    ("annual_cash_flow", "Annual Cash Flow", ["cash_flow_indicators", "annual_cash_flow"], "usd"),
    ("working_capital_debt", "Working Capital Debt", ["debt_ratios", "working_capital_debt"], "usd"),
    ("revenue", "Total Revenue", ["base_metrics", "revenue"], "usd"),
    ("ebitda", "EBITDA", ["base_metrics", "ebitda"], "usd"),
    ("cogs", "Cost of Goods Sold", ["base_metrics", "cogs"], "usd"),
    ("mrr", "Monthly Recurring Revenue", ["sector_metrics", "mrr"], "usd"),
    ("churn_rate", "Churn Rate", ["sector_metrics", "churn_rate"], "pct"),
    ("cac", "Customer Acquisition Cost", ["sector_metrics", "cac"], "usd"),
    ("portfolio_size", "Loan Portfolio Size", ["sector_metrics", "portfolio_size"], "usd"),
    ("npl_ratio", "Non-Performing Loan Ratio", ["sector_metrics", "npl_ratio"], "pct"),
    ("gmv", "Gross Merchandise Value", ["sector_metrics", "gmv"], "usd"),
    ("loss_ratio", "Loss Ratio", ["sector_metrics", "loss_ratio"], "pct"),
]

# Alternative names under which a KPI appears in reports.
KPI_ALIASES = {
    "gmv": [
        "Gross Merchandise Value",
        "Total Sales Volume",
        "Total Transaction Value",
        "GMV",
        "Valor Total de Transacciones",
        "Volumen de Ventas",
    ],
}

# The one sector each sector-only metric belongs to ("ALL" otherwise).
METRIC_BUCKET = {
    "mrr": "SAAS",
    "churn_rate": "SAAS",
    "portfolio_size": "LEND",
    "npl_ratio": "LEND",
    "gmv": "ECOM",
    "loss_ratio": "INSUR",
}

# KPIs a report must contain, per sector, in order.
SECTOR_REQUIREMENTS = {
    "SAAS": ["revenue", "mrr", "churn_rate", "cac"],
    "LEND": ["revenue", "portfolio_size", "npl_ratio"],
    "ECOM": ["revenue", "gmv", "cac"],
    "INSUR": ["revenue", "loss_ratio", "cac"],
    "OTH": ["revenue", "ebitda"],
}

# Sector names used in messages.
SECTOR_LABELS = {
    "SAAS": "SaaS",
    "LEND": "Lending",
    "ECOM": "E-Commerce",
    "INSUR": "Insurance",
    "OTH": "General",
}

# KPIs shown for every sector, and those shown per sector.
BASE_VISIBLE = [
    "revenue", "ebitda", "cogs",
    "revenue_growth", "gross_profit_margin", "ebitda_margin",
    "cash_in_bank_end_of_year", "annual_cash_flow", "working_capital_debt",
]
SECTOR_VISIBLE = {
    "SAAS": ["mrr", "churn_rate", "cac"],
    "ECOM": ["gmv", "cac"],
    "LEND": ["portfolio_size", "npl_ratio"],
    "INSUR": ["loss_ratio", "cac"],
    "OTH": [],
}

# Display labels of the checklist.
KPI_DISPLAY_LABELS = {
    "revenue": "Revenue Total",
    "ebitda": "EBITDA",
    "cogs": "Costo de Ventas",
    "revenue_growth": "Crecimiento de Revenue",
    "gross_profit_margin": "Margen Bruto",
    "ebitda_margin": "Margen EBITDA",
    "cash_in_bank_end_of_year": "Caja Final",
    "annual_cash_flow": "Flujo de Caja Anual",
    "working_capital_debt": "Deuda Capital Trabajo",
    "mrr": "MRR",
    "churn_rate": "Churn Rate",
    "cac": "CAC",
    "portfolio_size": "Cartera de Créditos",
    "npl_ratio": "NPL Ratio",
    "gmv": "GMV",
    "loss_ratio": "Loss Ratio",
}

# Unit words that mean "money" and "percentage".
MONEY_UNITS = ["usd", "dollars", "usd_amount", "us dollars", "mxn", "eur", "brl", "cop"]
PERCENT_UNITS = ["pct", "percentage", "ratio", "decimal", "rate"]

# Companies in registry order -- key, fund, sector.
COMPANIES = [
    ("conekta", "VII", "SAAS"),
    ("kueski", "VII", "LEND"),
    ("mpower", "VII", "LEND"),
    ("bnext", "VII", "SAAS"),
    ("yotepresto", "VII", "LEND"),
    ("ivoy", "VII", "ECOM"),
    ("bewe", "VII", "SAAS"),
    ("skydropx", "VII", "ECOM"),
    ("bitso", "VII", "SAAS"),
    ("cabify", "VII", "ECOM"),
    ("simetrik", "CIII", "SAAS"),
    ("guros", "CIII", "INSUR"),
    ("quinio", "CIII", "ECOM"),
    ("hackmetrix", "CIII", "SAAS"),
    ("hunty", "CIII", "SAAS"),
    ("atani", "CIII", "OTH"),
    ("cluvi", "CIII", "SAAS"),
    ("kuona", "CIII", "SAAS"),
    ("prometeo", "CIII", "OTH"),
    ("territorium", "CIII", "SAAS"),
    ("m1", "CIII", "INSUR"),
    ("morgana", "CIII", "INSUR"),
    ("duppla", "CIII", "LEND"),
    ("kala", "CIII", "OTH"),
    ("pulsar", "CIII", "SAAS"),
    ("solvento", "CIII", "LEND"),
    ("numia", "CIII", "SAAS"),
    ("r2", "CIII", "LEND"),
    ("dapta", "CIII", "SAAS"),
    ("rintin", "CIII", "ECOM"),
]

# Annual average rates, units of currency per 1 USD, for 2019 to 2025.
FX_FIRST_YEAR = 2019
FX_RATES = {
    "MXN": [19.26, 21.49, 20.27, 20.12, 17.18, 17.15, 17.80],
    "BRL": [3.94, 5.39, 5.40, 5.17, 4.99, 5.10, 5.25],
    "COP": [3281.0, 3694.0, 3743.0, 4255.0, 4325.0, 4150.0, 4350.0],
    "ARS": [48.2, 70.5, 95.1, 130.8, 350.0, 900.0, 1100.0],
    "CLP": [703.0, 792.0, 759.0, 874.0, 840.0, 920.0, 960.0],
    "PEN": [3.34, 3.49, 3.88, 3.84, 3.74, 3.80, 3.85],
    "EUR": [0.893, 0.877, 0.846, 0.951, 0.924, 0.925, 0.910],
    "GBP": [0.784, 0.780, 0.727, 0.812, 0.804, 0.790, 0.785],
    "CAD": [1.327, 1.341, 1.254, 1.301, 1.350, 1.360, 1.380],
    "JPY": [109.0, 106.8, 109.8, 131.5, 140.5, 149.7, 152.0],
}
USD_YEARS = range(2019, 2031)

# Sections a document must have, and the KPI paths that make it "financial".
REQUIRED_SECTIONS = [
    "revenue_growth", "profit_margins", "cash_flow_indicators",
    "debt_ratios", "base_metrics", "sector_metrics",
]
CORE_FINANCIAL_KPIS = [
    "revenue_growth", "revenue", "ebitda", "gross_profit_margin", "ebitda_margin",
    "cash_in_bank_end_of_year", "annual_cash_flow", "working_capital_debt",
    "mrr", "gmv", "portfolio_size", "loss_ratio",
]
# The six headline metrics of a dashboard, in order.
HEADLINE_KPIS = [
    "revenue_growth", "gross_profit_margin", "ebitda_margin",
    "cash_in_bank_end_of_year", "annual_cash_flow", "working_capital_debt",
]

# Confidence limits.
CONF_REVIEW = 0.85
CONF_CRITICAL = 0.70
CONF_BUCKET_MISMATCH = 0.95

KPI_KEYS = [k for k, *_ in KPI_REGISTRY]
KPI_PATHS = {k: [ROOT, *path] for k, _, path, _ in KPI_REGISTRY}
MONETARY_KPIS = [k for k, _, _, unit in KPI_REGISTRY if unit == "usd"]
FUNDS = list(dict.fromkeys(fund for _, fund, _ in COMPANIES))


def portfolio_names() -> list[tuple[str, str]]:
    """(company name, fund) in registry order."""
    return [(name, fund) for name, fund, _ in COMPANIES]


def bucket_names() -> list[tuple[str, str]]:
    """(company name, sector) in registry order."""
    return [(name, bucket) for name, _, bucket in COMPANIES]


def fx_rows() -> list[tuple[str, int, float]]:
    rows = [
        (cur, FX_FIRST_YEAR + i, float(rate))
        for cur, series in FX_RATES.items()
        for i, rate in enumerate(series)
    ]
    return rows + [("USD", y, 1.0) for y in USD_YEARS]


def _table(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    """A LocalRelation with exact statistics, so Catalyst plans it as the tiny table it is."""
    arrays = [pa.array(values, types[name]) for name, values in columns.items()]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(columns)))


def dim_kpi(spark: SparkSession) -> DataFrame:
    return _table(
        spark,
        {
            "ordinal": list(range(1, len(KPI_REGISTRY) + 1)),
            "kpi_key": KPI_KEYS,
            "kpi_label": [r[1] for r in KPI_REGISTRY],
            "path": [KPI_PATHS[k] for k in KPI_KEYS],
            "unit_type": [r[3] for r in KPI_REGISTRY],
            "aliases": [KPI_ALIASES.get(k, []) for k in KPI_KEYS],
        },
        {
            "ordinal": pa.int32(), "kpi_key": pa.string(), "kpi_label": pa.string(),
            "path": pa.list_(pa.string()), "unit_type": pa.string(), "aliases": pa.list_(pa.string()),
        },
    )


def dim_metric(spark: SparkSession) -> DataFrame:
    return _table(
        spark,
        {
            "kpi_key": KPI_KEYS,
            "label": [r[1] for r in KPI_REGISTRY],
            "unit_expected": ["%" if r[3] == "pct" else "$" for r in KPI_REGISTRY],
            "metric_bucket": [METRIC_BUCKET.get(k, "ALL") for k in KPI_KEYS],
        },
        dict.fromkeys(["kpi_key", "label", "unit_expected", "metric_bucket"], pa.string()),
    )


def dim_company(spark: SparkSession) -> DataFrame:
    return _table(
        spark,
        {
            "ordinal": list(range(1, len(COMPANIES) + 1)),
            "company_key": [c[0] for c in COMPANIES],
            "company_name": [c[0].capitalize() for c in COMPANIES],
            "portfolio_id": [c[1] for c in COMPANIES],
            "portfolio_name": [f"Fondo {c[1]}" for c in COMPANIES],
            "bucket_id": [c[2] for c in COMPANIES],
        },
        {"ordinal": pa.int32()} | dict.fromkeys(
            ["company_key", "company_name", "portfolio_id", "portfolio_name", "bucket_id"], pa.string()
        ),
    )


def dim_requirement(spark: SparkSession) -> DataFrame:
    rows = [(b, k, i) for b, keys in SECTOR_REQUIREMENTS.items() for i, k in enumerate(keys, 1)]
    return _table(
        spark,
        {"bucket_id": [r[0] for r in rows], "kpi_key": [r[1] for r in rows], "ordinal": [r[2] for r in rows]},
        {"bucket_id": pa.string(), "kpi_key": pa.string(), "ordinal": pa.int32()},
    )


def dim_visible(spark: SparkSession) -> DataFrame:
    rows = [
        (bucket, key, group)
        for bucket, sector in SECTOR_VISIBLE.items()
        for group, keys in (("base", BASE_VISIBLE), ("sector", sector))
        for key in keys
    ]
    return _table(
        spark,
        {"bucket_id": [r[0] for r in rows], "kpi_key": [r[1] for r in rows], "kpi_group": [r[2] for r in rows]},
        dict.fromkeys(["bucket_id", "kpi_key", "kpi_group"], pa.string()),
    )


def dim_unit_synonym(spark: SparkSession) -> DataFrame:
    words = MONEY_UNITS + PERCENT_UNITS
    return _table(
        spark,
        {"unit_text": words, "unit": ["$"] * len(MONEY_UNITS) + ["%"] * len(PERCENT_UNITS)},
        {"unit_text": pa.string(), "unit": pa.string()},
    )


def dim_fx(spark: SparkSession) -> DataFrame:
    rows = fx_rows()
    return _table(
        spark,
        {"currency": [r[0] for r in rows], "year": [r[1] for r in rows], "rate": [r[2] for r in rows]},
        {"currency": pa.string(), "year": pa.int32(), "rate": pa.float64()},
    )
