"""Text to number: the value grammars of documents, dashboards and forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\r\x0b\x0c"

# Four separate lists of texts that mean "no value".
NO_VALUE_PARSER = ["null", "n/a", "---", "", "none"]
NO_VALUE_GATE = ["", "null", "n/a", "--", "0", "none"]
NO_VALUE_DASHBOARD = ["", "0", "--", "N/A", "null"]

# Fixed value: the number grammar (digit groups may be joined with "_").
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)"
WHOLE_NUMBER = rf"(?i)^\s*({_NUMBER})\s*$"
NUMBER_PREFIX = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"
SCALES = {"B": 1e9, "M": 1e6, "K": 1e3}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def nullif_blank(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for bodies that refer to it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scale_letter(text: Column) -> Column:
    """Trailing B, M or K in upper case, else an empty text."""
    return F.upper(F.regexp_extract(text, "([bBmMkK])$", 1))


def _multiplier(letter: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair], F.lit(""), F.lit(1.0))
    return F.try_element_at(table, letter)


def _bare(raw: Column) -> Column:
    """Text without leading signs and without its first-choice symbol (% before $)."""
    body = F.ltrim(strip(raw), F.lit("+-"))
    symbol = F.when(raw.contains("%"), "%").otherwise("$")
    return F.replace(body, symbol, F.lit(""))


def numeric_value(raw: Column, mode: str = "reference") -> Column:
    """Number of a financial text, null when it is none; K, M and B scale it.

    Percentages stay in percent points. ``mode="intended"`` also rejects nan and inf. The
    "no value" texts need no test of their own: none of them is a number.
    """
    bare = _bare(raw)
    last = _last(bare)
    return _scaled(raw, last, _unscaled(bare, last), mode)


def _last(bare: Column) -> Column:
    """Last letter of a bare text; k, m and b in upper case."""
    return F.translate(F.right(bare, F.lit(1)), "kmb", "KMB")


def _unscaled(bare: Column, last: Column) -> Column:
    """Bare text without its scale letter and without commas."""
    cut = F.when(last.isin("K", "M", "B"), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)
    return F.replace(cut, F.lit(","), F.lit(""))


def _scaled(raw: Column, last: Column, text: Column, mode: str) -> Column:
    """Number of an unscaled text with scale and sign; one of digits and points only needs no pattern, the cast judges it alike."""
    scale = F.when(last == "K", 1e3).when(last == "M", 1e6).when(last == "B", 1e9).otherwise(1.0)
    matched = F.replace(F.regexp_extract(text, WHOLE_NUMBER, 1), F.lit("_"), F.lit(""))
    number = F.when(F.translate(text, "0123456789.", "") == "", text).otherwise(matched).try_cast("double")
    if mode == "intended":
        number = F.when(F.abs(number) < float("inf"), number)
    return number * scale * F.when(strip(raw).startswith("-"), -1.0).otherwise(1.0)


def numeric_unit(raw: Column, value: Column) -> Column:
    """Symbol and scale letter of a text that is a number (``value`` not null), null without any."""
    return _unit(raw, _last(_bare(raw)), value)


def _unit(raw: Column, last: Column, value: Column) -> Column:
    symbol = F.when(raw.contains("%"), "%").when(raw.contains("$"), "$").otherwise("")
    unit = F.concat(symbol, F.when(last.isin("K", "M", "B"), last).otherwise(""))
    return F.when(value.isNotNull(), F.nullif(unit, F.lit("")))


def parse_numeric(raw: Column, mode: str = "reference") -> Column:
    """struct(value double, unit string); both null when the text is not a number."""
    value = numeric_value(raw, mode)
    return F.struct(value.alias("value"), numeric_unit(raw, value).alias("unit"))


def with_parsed(df: DataFrame, raw: Column, value: str = "numeric_value", unit: str = "unit", mode: str = "reference") -> DataFrame:
    """Adds number and unit of a text column in steps, so that bare text, scale letter and number are each computed once."""
    bare, last, text = F.col("__bare"), F.col("__last"), F.col("__unscaled")
    cut = df.withColumn("__bare", _bare(raw)).withColumns({"__last": _last(bare), "__unscaled": _unscaled(bare, _last(bare))})
    return cut.withColumn(value, _scaled(raw, last, text, mode)).withColumn(unit, _unit(raw, last, F.col(value))).drop("__bare", "__last", "__unscaled")


def number_prefix(text: Column) -> Column:
    """Leading number of a text, null when there is none (browser ``parseFloat`` rule)."""
    return F.regexp_extract(text, NUMBER_PREFIX, 1).try_cast("double")


def parse_display_value(raw: Column) -> Column:
    """struct(value, unit) as a dashboard shows it: no scaling, failure is 0."""
    text = strip(raw)
    first_comma_to_dot = F.regexp_replace(text, r"^([^,]*),", r"$1.")
    percent_text = F.regexp_replace(first_comma_to_dot, r"^([^%]*)%", r"$1")
    money_text = strip(
        F.regexp_replace(F.regexp_replace(text, r"^([^$]*)\$", r"$1"), r"^([^,]*),", r"$1")
    )
    money = text.contains("$") & money_text.rlike(r"^-?\d+\.?\d*[A-Z]?$")
    value = (
        F.when(text.contains("%"), number_prefix(percent_text))
        .when(money, F.regexp_extract(money_text, r"^(-?\d+\.?\d*)", 1).try_cast("double"))
        .otherwise(number_prefix(first_comma_to_dot))
    )
    unit = F.when(text.contains("%"), "%").when(money, F.regexp_extract(money_text, r"([A-Z])$", 1))
    return F.struct(F.coalesce(value, F.lit(0.0)).alias("value"), unit.alias("unit"))


def parse_scaled_display(raw: Column) -> Column:
    """Number of a displayed text with its K/M/B scale applied; a number prefix is enough."""
    text = strip(raw)
    body = F.regexp_replace(F.regexp_replace(text, r"^[+-]", ""), r"[$%,]", "")
    number = number_prefix(F.regexp_replace(body, "[bBmMkK]$", ""))
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return F.when(raw != "", number * sign * _multiplier(_scale_letter(body)))


def sanitize_kpi_input(raw: Column) -> Column:
    """Form input reduced to a plain number text, or null (scale letters are rejected)."""
    cleaned = F.regexp_replace(raw, r"[$,%\s]", "")
    plain = cleaned.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    radix = cleaned.rlike(r"^0([xX][0-9a-fA-F]+|[bB][01]+|[oO][0-7]+)$")
    return F.when(plain | radix | cleaned.rlike(r"^[+-]?Infinity$"), cleaned)


def is_visible(raw: Column) -> Column:
    """Whether a dashboard shows this metric text (case-sensitive list)."""
    return F.coalesce(~strip(raw).isin(NO_VALUE_DASHBOARD), F.lit(False))


def has_financial_value(raw: Column) -> Column:
    return F.coalesce(~F.lower(strip(raw)).isin(NO_VALUE_GATE), F.lit(False))
