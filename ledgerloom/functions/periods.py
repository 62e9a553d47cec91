"""Reporting periods, years and ages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.values import let, strip

# Accepted period texts and the year pattern.
PERIOD_PATTERN = r"(?i)^(FY\d{4}|H[12]\s?\d{4}|Q[1-4]\s?\d{4}|\d{4}M\d{2})$"
YEAR_PATTERN = r"(20\d{2})"
BOUNDED_YEAR_PATTERN = r"(?U)\b(20\d{2})\b"


def valid_period(period: Column) -> Column:
    return F.coalesce(strip(period).rlike(PERIOD_PATTERN), F.lit(False))


def period_year(period: Column, as_of_year: Column) -> Column:
    """First 20XX in the text, else the year of the run (passed in, so reruns agree)."""
    found = F.regexp_extract(period, YEAR_PATTERN, 1)
    return F.coalesce(F.when(found != "", found.cast("int")), as_of_year.cast("int"))


def most_common_year(text: Column) -> Column:
    """Most frequent free-standing 20XX of a text, the first seen on a tie; null without any.

    Works inside the row: at most 100 different years exist, so no shuffle is needed.
    """
    years = F.regexp_extract_all(text, F.lit(BOUNDED_YEAR_PATTERN), F.lit(1))

    def winner(found: Column) -> Column:
        ranked = F.transform(
            F.array_distinct(found),
            lambda y: F.struct(
                F.size(F.filter(found, lambda x: x == y)).alias("n"),
                (-F.array_position(found, y)).alias("first"),
                y.alias("year"),
            ),
        )
        return F.array_max(ranked)["year"]

    return F.when(text.contains("20"), let(years, winner))  # the pattern costs a pass over all characters


def infer_period(text: Column, as_of_year: Column, declared: Column | None = None, mode: str = "reference") -> Column:
    """``FY<most common year>``; ``mode="intended"`` prefers a valid declared period."""
    inferred = F.concat(F.lit("FY"), F.coalesce(most_common_year(text), as_of_year.cast("string")))
    if mode == "intended" and declared is not None:
        return F.coalesce(F.when(valid_period(declared), strip(declared)), inferred)
    return inferred


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def relative_age(ts: Column, as_of: Column) -> Column:
    """Age wording against an explicit reference time; 30 days and more show the date."""
    hours = F.floor(F.timestamp_diff("SECOND", ts, as_of) / 3600)
    days = F.floor(hours / 24)
    return (
        F.when(hours < 1, "hace menos de 1 hora")
        .when(hours < 24, F.concat(F.lit("hace "), hours.cast("string"), F.when(hours == 1, " hora").otherwise(" horas")))
        .when(days < 30, F.concat(F.lit("hace "), days.cast("string"), F.when(days == 1, " día").otherwise(" días")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
