"""Lines, texts and documents are shuffled and worked out once, with the same results."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import units, values
from ledgerloom.plans.fixtures import Tables

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver data absent")


def shuffles_of_lines(frame):
    """How many shuffles lie above the scan of lineitem in the plan."""
    above = []
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        at = line.find("- ")
        if "lineitem.parquet" in line:
            return sum("Exchange" in text for depth, text in above if depth < at)
        above = [(depth, text) for depth, text in above if depth < at or at < 0] + ([(at, line)] if at >= 0 else [])
    raise AssertionError("no scan of lineitem")


@pytest.fixture
def large(spark):
    """Plans as for tables that are too large to broadcast."""
    limit, fields = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(limit), spark.conf.get(fields)
    spark.conf.set(limit, "-1")
    spark.conf.set(fields, "2000")
    yield Tables(spark, SF_DIR)
    spark.conf.set(limit, before[0])
    spark.conf.set(fields, before[1])


@needs_data
def test_lines_are_shuffled_once(large):
    assert shuffles_of_lines(large.kpi) == 1


@needs_data
def test_lines_are_shuffled_once_for_documents(large):
    assert shuffles_of_lines(large.raw_docs.select("submission_id", "raw_json")) == 1


@needs_data
def test_rows_by_submission_are_the_same(spark):
    t = Tables(spark, SF_DIR)
    assert t.kpi.columns == t.kpi_by_submission.columns
    assert t.kpi.exceptAll(t.kpi_by_submission).isEmpty() and t.kpi_by_submission.exceptAll(t.kpi).isEmpty()


def test_bare_text_is_worked_out_once(spark):
    raws = ["$1.5K", "-$2,000M", "5%", "1_000", "1.2.3", ".", "", "5.", ".5", "+-3k", "1e3", "nan", "-inf", "٣", "12d", "0x1", " 7 B", "K", "k%", "1\n", None, "--4", "1e400", "9" * 400]
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    got = values.with_parsed(rows, F.col("raw"))
    pattern = F.replace(F.regexp_extract(values._unscaled(values._bare(F.col("raw")), values._last(values._bare(F.col("raw")))), values.WHOLE_NUMBER, 1), F.lit("_"), F.lit(""))
    plain = rows.select("id", pattern.try_cast("double").alias("number")).collect()
    assert {r["id"] for r in plain if r["number"] is not None} == {r["id"] for r in got.filter("numeric_value IS NOT NULL").collect()}
    assert got.select("id", F.struct(F.col("numeric_value").alias("value"), "unit").alias("p")).exceptAll(rows.select("id", values.parse_numeric(F.col("raw")).alias("p"))).isEmpty()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ltrim(") == 1


def test_scaled_units_as_by_the_pattern(spark):
    words = ["$K", "usdm", " Dollars b", "%M", "k", "kgK", "a\nK", "", None, "eurK"]
    rows = spark.createDataFrame([(w,) for w in words], "u string")
    lower = F.lower(values.strip(F.col("u")))
    cut = F.regexp_replace(lower, ".$", "")
    last = F.upper(F.right(values.strip(F.col("u")), F.lit(1)))
    old = F.coalesce(units._symbol(lower), F.when(last.isin("M", "K", "B"), F.concat(units._symbol(cut), last)), values.strip(F.col("u")))
    assert rows.filter(~units.normalize_unit(F.col("u")).eqNullSafe(old)).isEmpty()
