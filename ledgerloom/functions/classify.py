"""Status, tier and band columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.dims import CONF_CRITICAL, CONF_REVIEW


def calc_origin(source: Column) -> Column:
    """Whether a value was derived or came from the extraction model (fixed names)."""
    return F.when(F.coalesce(source, F.lit("")).contains("calculated"), "calculated").otherwise("gemini")


def is_present(is_valid: Column, value: Column) -> Column:
    return F.coalesce(is_valid, F.lit(False)) & value.isNotNull()


def kpi_traffic_light(is_valid: Column, value: Column, source: Column, confidence: Column) -> Column:
    return (
        F.when(~is_present(is_valid, value), "missing")
        .when(calc_origin(source) == "calculated", "calculated")
        .when(confidence < CONF_CRITICAL, "low_conf")
        .otherwise("ok")
    )


def checklist_dot(present: Column, confidence: Column) -> Column:
    return F.when(~present, "missing").when(confidence < CONF_CRITICAL, "warn").otherwise("ok")


def confidence_tier(confidence: Column) -> Column:
    return (
        F.when(confidence >= CONF_REVIEW, "high")
        .when(confidence >= CONF_CRITICAL, "medium")
        .when(confidence.isNotNull(), "low")
    )


def needs_review(confidence: Column) -> Column:
    return F.coalesce(confidence < CONF_REVIEW, F.lit(False))


# Band limits per metric (above the first is green, above the second is yellow).
COLOR_LIMITS = {"revenue_growth": (20, 0), "ebitda_margin": (10, 0), "gross_profit_margin": (50, 20)}
FOUNDER_LIMITS = {"revenue_growth": 40, "gross_profit_margin": 50, "ebitda_margin": 15}


def metric_color_band(kpi: Column, value: Column) -> Column:
    band = F.when(
        kpi.isin("cash_in_bank_end_of_year", "annual_cash_flow"), F.when(value > 0, "green").otherwise("red")
    ).when(
        kpi == "working_capital_debt",
        F.when(value < 5, "green").when(value < 10, "yellow").otherwise("red"),
    )
    for key, (green, yellow) in COLOR_LIMITS.items():
        band = band.when(
            kpi == key, F.when(value > green, "green").when(value > yellow, "yellow").otherwise("red")
        )
    return band.otherwise("white")


def founder_color_band(kpi: Column, value: Column) -> Column:
    """Founder view: one limit per metric, gray without a value, cash always cyan."""
    band = F.when(value.isNull(), "gray").when(kpi == "cash_in_bank_end_of_year", "cyan")
    for key, limit in FOUNDER_LIMITS.items():
        band = band.when(kpi == key, F.when(value >= limit, "green").otherwise("yellow"))
    return band


def completeness_color(missing: Column) -> Column:
    return F.when(missing == 0, "green").when(missing <= 1, "yellow").otherwise("red")
