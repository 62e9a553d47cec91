"""Numbers and documents rendered as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.values import let, number_prefix


def fixed_even(value: Column, digits: int) -> Column:
    """Fixed decimals of the exact binary value, an exact half to even."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def _fixed(value: Column, digits: int) -> Column:
    """Fixed decimals as a browser writes them: an exact half goes up.

    Only k / 2**(digits + 1) with odd k is an exact half; a quarter unit more decides it.
    """
    half = F.pmod(value * F.lit(float(2 ** (digits + 1))), F.lit(2.0)) == 1.0
    return fixed_even(F.when(half, value + 0.25 * 10.0**-digits).otherwise(value), digits)


def format_usd(value: Column) -> Column:
    def wording(v: Column) -> Column:
        size = F.abs(v)
        text = (
            F.when(size >= 1e9, F.concat(_fixed(size / 1e9, 2), F.lit("B")))
            .when(size >= 1e6, F.concat(_fixed(size / 1e6, 1), F.lit("M")))
            .when(size >= 1e3, F.concat(_fixed(size / 1e3, 1), F.lit("K")))
            .otherwise(_fixed(size, 2))
        )
        return F.when(v.isNotNull(), F.concat(F.when(v < 0, "-").otherwise(""), F.lit("$"), text))

    return let(value, wording)


def format_metric(value: Column, unit: Column) -> Column:
    plain = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")).otherwise(
        value.cast("string")
    )
    return (
        F.when(unit == "%", F.concat(_fixed(value, 2), F.lit("%")))
        .when(unit == "M", F.concat(F.lit("$"), _fixed(value, 1), F.lit("M")))
        .when(unit == "K", F.concat(F.lit("$"), _fixed(value, 0), F.lit("K")))
        .when(unit == "B", F.concat(F.lit("$"), _fixed(value, 2), F.lit("B")))
        .otherwise(plain)
    )


def format_card(value: Column, kind: str) -> Column:
    """Card wording of a number: ``percentage`` 1 decimal, ``multiplier`` 2 decimals with "x"."""
    if kind == "percentage":
        return F.concat(_fixed(value, 1), F.lit("%"))
    if kind == "multiplier":
        return F.concat(_fixed(value, 2), F.lit("x"))
    raise ValueError(f"unknown card format: {kind}")


def _worded(text: Column, wording: str) -> Column:
    return F.when(text != "", F.concat(F.lit(wording), text))


# The sentences below.
def executive_summary(m: dict[str, Column], has_metrics: Column) -> Column:
    """One sentence from up to six headline metric texts (dashboard wording)."""
    growth = m["revenue_growth"]
    n = number_prefix(F.regexp_replace(growth, r"[^-\d.]", ""))
    wording = (
        F.when(n >= 40, "crecimiento excepcional del ")
        .when(n >= 20, "crecimiento sólido del ")
        .when(n > 0, "crecimiento del ")
        .otherwise("contracción del ")
    )
    parts = F.concat_ws(
        ", ",
        F.when(growth != "", F.concat(wording, growth)),
        _worded(m["gross_profit_margin"], "margen bruto de "),
        _worded(m["ebitda_margin"], "EBITDA de "),
        _worded(m["cash_in_bank_end_of_year"], "posición de caja de "),
        _worded(m["annual_cash_flow"], "flujo de caja anual de "),
        _worded(m["working_capital_debt"], "deuda de capital de trabajo de "),
    )
    return (
        F.when(~has_metrics, "No hay suficientes datos para generar un resumen ejecutivo.")
        .when(parts == "", "El análisis procesado no encontró métricas suficientes. Verifica el documento subido.")
        .otherwise(
            F.concat(
                F.lit("La empresa reporta "),
                parts,
                F.lit(". Los indicadores financieros presentan una base consolidada para el proceso de debida diligencia."),
            )
        )
    )


def founder_summary(m: dict[str, Column], has_metrics: Column) -> Column:
    """The founder's variant: four metrics, margins only when they are strong."""

    def plain(key: str) -> Column:
        return number_prefix(F.regexp_replace(m[key], r"^([^%]*)%", "$1"))

    growth, n = m["revenue_growth"], plain("revenue_growth")
    wording = (
        F.when(n >= 40, "crecimiento excepcional del ")
        .when(n >= 20, "crecimiento sólido del ")
        .when(n > 0, "crecimiento moderado del ")
        .otherwise("contracción del ")
    )
    gross, ebitda, cash = m["gross_profit_margin"], m["ebitda_margin"], m["cash_in_bank_end_of_year"]
    parts = F.concat_ws(
        ", ",
        F.when(growth != "", F.concat(wording, growth)),
        F.when(
            plain("gross_profit_margin") >= 50,
            F.concat(F.lit("márgenes saludables con "), gross, F.lit(" de margen bruto")),
        ),
        F.when(
            plain("ebitda_margin") >= 15,
            F.concat(F.lit("rentabilidad operativa fuerte con "), ebitda, F.lit(" de margen EBITDA")),
        ),
        F.when(
            (cash != "") & (cash != "---"),
            F.concat(F.lit("posición de caja sólida con "), cash, F.lit(" en banco")),
        ),
    )
    return (
        F.when(~has_metrics, "No hay datos financieros disponibles para generar un resumen ejecutivo.")
        .when(
            parts == "",
            "El análisis financiero muestra una empresa estable pero con oportunidades de mejora en rentabilidad y crecimiento.",
        )
        .otherwise(
            F.concat(
                F.lit("La empresa muestra "),
                parts,
                F.lit(". Los indicadores sugieren una base financiera sólida con potencial para optimización operativa."),
            )
        )
    )
