"""Value grammars, units, periods, names and formats against tables of cases."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import classify, formats, periods, text, units, values
from ledgerloom.operators import resolve

PARSE_CASES = [
    ("36%", 36.0, "%"), ("-0.74%", -0.74, "%"), ("$9.7M", 9.7e6, "$M"), ("-$3.2M", -3.2e6, "$M"), ("$1.1K", 1100.0, "$K"),
    ("$4.2B", 4.2e9, "$B"), ("$-3.2M", -3.2e6, "$M"), ("1,200.50", 1200.5, None), ("1,2", 12.0, None), ("--5", -5.0, None),
    ("+-5", 5.0, None), ("-+5", -5.0, None), ("--", None, None), ("(880)K", None, None), ("MXN 5", None, None),
    ("$9.7M%", None, None), ("9.7m", 9.7e6, "M"), ("1.2 M", 1.2e6, "M"), ("5%M", 5e6, "%M"), ("1e5", 1e5, None),
    ("1_000", 1000.0, None), ("1__0", None, None), ("1d", None, None), ("1f", None, None), ("0x10", None, None), ("0x1p3", None, None),
    ("inf", math.inf, None), ("null", None, None), ("N/A", None, None), ("---", None, None), ("", None, None), ("none", None, None),
    (None, None, None), ("texto_no_numerico", None, None), (" \t-5 % ", -5.0, "%"), ("5M ", 5e6, "M"), ("$5M x", None, None), (".5", 0.5, None),
]


def run(spark, cases, build):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r["y"] for r in rows.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse_numeric_cases(spark):
    got = run(spark, [c[0] for c in PARSE_CASES], values.parse_numeric)
    for (raw, value, unit), row in zip(PARSE_CASES, got):
        assert (row["value"], row["unit"]) == (value, unit), raw


def test_nan_is_valid_only_in_reference_mode(spark):
    assert math.isnan(run(spark, ["nan"], values.parse_numeric)[0]["value"])
    strict = run(spark, ["nan", "inf", "-inf", "7"], lambda c: values.parse_numeric(c, "intended"))
    assert [r["value"] for r in strict] == [None, None, None, 7.0]


def python_parse(raw):
    """Brute-force reading of the grammar, one text at a time."""
    if raw is None or raw.strip().lower() in ("null", "n/a", "---", "", "none"):
        return None, None
    body = raw.strip()
    negative = body.startswith("-")
    body = body.lstrip("+-")
    unit = "%" if "%" in body else "$" if "$" in body else ""
    body = body.replace(unit, "") if unit else body
    scale = {"B": 1e9, "M": 1e6, "K": 1e3}.get(body[-1:].upper())
    if scale:
        unit, body = unit + body[-1].upper(), body[:-1]
    try:
        number = float(body.replace(",", "").strip()) * (scale or 1.0)
    except ValueError:
        return None, None
    return (-number if negative else number), unit or None


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.,+-$%KMBkmbe _", max_size=8), min_size=40, max_size=80))
def test_parse_numeric_equals_brute_force(spark, texts):
    got = run(spark, texts, values.parse_numeric)
    for raw, row in zip(texts, got):
        assert (row["value"], row["unit"]) == python_parse(raw), repr(raw)


def test_display_parsers(spark):
    shown = run(spark, ["36%", "$9.7M", "-0.74%", "$1,200K", "abc", None, "12,5%", "-$5M", "1.5x"], values.parse_display_value)
    assert [(r["value"], r["unit"]) for r in shown] == [
        (36.0, "%"), (9.7, "M"), (-0.74, "%"), (1200.0, "K"), (0.0, None), (0.0, None), (12.5, "%"), (-5.0, "M"), (1.5, None)]
    scaled = run(spark, ["$9.7M", "-$3.2K", "5%", "12abc", "", "x"], values.parse_scaled_display)
    assert scaled == [9.7e6, -3200.0, 5.0, 12.0, None, None]


def test_sanitize_rejects_scale_letters(spark):
    got = run(spark, ["$8.5M", "$1,200", " 12 % ", "", "-", "-3.5", "1e3"], values.sanitize_kpi_input)
    assert got == [None, "1200", "12", None, None, "-3.5", "1e3"]


def test_units(spark):
    got = run(spark, ["usd", "pct", "usdm", "percentage", "MXN", "$M", " kg ", "", None, "M", "US Dollars"], units.normalize_unit)
    assert got == ["$", "%", "$M", "%", "$", "$M", "kg", "", None, "M", "$"]


def test_periods(spark):
    got = run(spark, ["FY2025", "H1 2025", "q42025", "2025M01", "2025", "FY25", " fy2025 ", None], periods.valid_period)
    assert got == [True, True, True, True, False, False, True, False]
    years = run(spark, ["in 2024, 2025 and 2024", "FY2025", "2025 2024", "x2023 12024 2026M"], periods.most_common_year)
    assert years == ["2024", None, "2025", None]


def test_period_modes(spark):
    row = spark.createDataFrame([("FY2025 says 2023", " FY2024 ")], "t string, d string")
    as_is = periods.infer_period(F.col("t"), F.lit(2020), F.col("d"))
    declared = periods.infer_period(F.col("t"), F.lit(2020), F.col("d"), "intended")
    assert row.select(as_is, declared).first() == ("FY2023", "FY2024")


def test_file_names(spark):
    assert run(spark, ["a b & c, (1).v2.pdf", "plain", "x.y"], text.clean_filename) == ["a_b_and_c_1_v2.pdf", "plain", "x.y"]
    assert run(spark, ["a1b2_report.pdf", "Report.pdf", "zz_x"], text.strip_hash_prefix) == ["report.pdf", "Report.pdf", "zz_x"]
    assert run(spark, ["a/b.PDF", ".bashrc", "x.tar.gz", "a..b", "none"], text.file_extension) == [".pdf", "", ".gz", ".b", ""]
    long = "a" * 40 + ".pdf"
    assert run(spark, [long, "short.pdf"], text.truncate_filename) == ["a" * 23 + "...pdf", "short.pdf"]


def test_labels_and_domains(spark):
    assert run(spark, ["mrr", "net_working_capital"], text.title_kpi_label) == ["MRR", "Net Working Capital"]
    assert run(spark, ["mPower", "x"], text.capitalize) == ["Mpower", "X"]
    got = run(spark, ["a@b@c.com", "nobody", None], lambda c: text.company_domain(F.lit(None).cast("string"), c))
    assert got == ["c.com", "pending_detection", "pending_detection"]


def test_formats(spark):
    rows = spark.createDataFrame([(v,) for v in (-1.25e9, 9.7e6, 1100.0, 12.0, 0.125, -2250.0)], "v double")
    assert [r[0] for r in rows.select(formats.format_usd(F.col("v"))).collect()] == ["-$1.25B", "$9.7M", "$1.1K", "$12.00", "$0.13", "-$2.3K"]
    assert rows.limit(1).select(formats.fixed_even(F.lit(0.835), 2), formats.fixed_even(F.lit(0.125), 2)).first() == ("0.83", "0.12")


def test_confidence_tiers(spark):
    rows = spark.createDataFrame([(0.85,), (0.84,), (0.7,), (0.69,), (None,)], "c double")
    got = rows.select(classify.confidence_tier(F.col("c")), classify.needs_review(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("high", False), ("medium", True), ("medium", True), ("low", True), (None, False)]


def test_company_lookups(spark):
    assert run(spark, ["simetrik.com", "conekta.com", "acme-corp", "m1-insurtech"], resolve.lookup_portfolio) == ["CIII", "VII", "unknown", "CIII"]
    found = run(spark, ["Sky-drop_x _ board", "nothing", "yo te presto", "Bnext & Conekta"], resolve.detect_company)
    assert [r["company_key"] for r in found] == ["skydropx", "unknown", "yotepresto", "conekta"]
    assert run(spark, ["m1-insurtech", "yote_presto"], resolve.company_bucket_substr) == ["INSUR", "LEND"]


def test_company_label_modes(spark):
    rows = spark.createDataFrame([("cfo@kueski.com", "ab_x.pdf"), (None, "ab_bitso report.pdf"), ("a@acme.io", "zz.pdf")], "e string, f string")
    label = lambda mode: [r[0] for r in rows.select(resolve.company_label(F.col("e"), F.col("f"), mode=mode)).collect()]
    assert label("reference") == ["Kueski", "Conekta", "Acme"]
    assert label("intended") == ["Kueski", "Bitso", "Acme"]


def test_normalize_company(spark):
    from ledgerloom import dims

    ids = ["simetrik.com", "yote_presto", "m1-insurtech", "bnext-mx", "acme-corp", "M1"]
    rows = spark.createDataFrame([(i,) for i in ids], "company_id string")
    got = {r[0]: r[1] for r in resolve.normalize_company(rows, dims.dim_company(spark)).collect()}
    assert got == {"simetrik.com": "simetrik", "yote_presto": "yotepresto", "m1-insurtech": "m1", "bnext-mx": "bnext", "acme-corp": "acmecorp", "M1": "m1"}


def test_fx(spark):
    rows = spark.createDataFrame([("MXN", 2025), ("MXN", 2030), ("MXN", 2001), ("usd ", 2031), ("XXX", 2024)], "currency string, report_year int")
    assert [r["fx_rate"] for r in resolve.fx_rate_join(rows).orderBy("report_year", "currency").collect()] == [19.26, None, 17.8, 17.8, 1.0]
    sparse = spark.createDataFrame([("MXN", 2020, 10.0), ("MXN", 2024, 20.0), ("ZRO", 2020, 0.0)], "currency string, year int, rate double")
    amounts = spark.createDataFrame([("MXN", 2022, 5.0), ("MXN", 2023, 5.0), ("ZRO", 2020, 5.0)], "currency string, report_year int, a double")
    assert [r["usd"] for r in resolve.to_usd(amounts, "a", sparse).orderBy("currency", "report_year").collect()] == [0.5, 0.25, None]


def test_fx_modes(spark):
    rows = spark.createDataFrame([("revenue", 36.4), ("churn_rate", 36.4)], "kpi_key string, numeric_value double").withColumns(
        {"currency": F.lit("EUR"), "report_year": F.lit(2025)})
    both = [{r["kpi_key"]: r["normalized_value_usd"] for r in resolve.fx_normalize(rows, mode=m).collect()} for m in ("reference", "intended")]
    assert both == [{"revenue": 40.0, "churn_rate": 40.0}, {"revenue": 40.0, "churn_rate": None}]
