"""Unit texts and their canonical symbols."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.dims import MONEY_UNITS, PERCENT_UNITS
from ledgerloom.functions.values import strip


def _symbol(word: Column) -> Column:
    return F.when(word.isin(MONEY_UNITS), "$").when(word.isin(PERCENT_UNITS), "%")


def normalize_unit(unit: Column) -> Column:
    """Synonym -> symbol; a trailing M/K/B is kept; anything else comes back trimmed."""
    text = strip(unit)
    lower = F.lower(text)
    last = F.upper(F.right(text, F.lit(1)))
    scaled = F.when(last.isin("M", "K", "B"), F.concat(_symbol(F.substring(lower, F.lit(1), F.length(lower) - 1)), last))
    return F.coalesce(_symbol(lower), scaled, text)


def unit_or_default(unit: Column, unit_type: Column) -> Column:
    return F.coalesce(F.when(unit != "", unit), unit_type)


def unit_mismatch(unit: Column, expected: Column) -> Column:
    """True when a non-empty unit and the expected one do not contain each other (scale ignored)."""
    base = F.translate(F.coalesce(unit, F.lit("")), "MKB", "")
    return F.coalesce(
        (expected != "") & (base != "") & ~base.contains(expected) & ~expected.contains(base), F.lit(False)
    )
