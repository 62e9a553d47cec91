"""Names of a table found in texts, and rates of the nearest year, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.operators import names, resolve


def plan_of(df):
    return df._jdf.queryExecution().toString()


NAMES = [("m1", "A"), ("r2", "B"), ("a", "C"), ("acme", "D"), ("acme-labs", "E"), ("two words", "F"), ("ünïcode", "G"), ("a.b*c", "H"), ("acmelabs", "I"), ("zz", "J"), ("", "K"), ("...", "L")]


@pytest.fixture(scope="module")
def listed(spark):
    rows = [(n, f, f, k) for k, (n, f) in enumerate(NAMES)]
    return spark.createDataFrame(rows, "name string, portfolio_id string, bucket_id string, ordinal int").repartition(3)


def texts(n=300):
    rng = random.Random(5)
    parts = [name for name, _ in NAMES] + ["ACME LABS", "Acme_labs", "two   words", "a.b*", "M-1", "x", "qq", "\n", " ", "É", "1", "long " * 50]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(n)]
    return [*out, None, "", "  ", out[0], out[0]]


def rows_of(spark):
    return spark.createDataFrame(list(enumerate(texts())), "id int, text string").withColumns({"kind": F.lit("k"), "needle": F.lit("n")}).repartition(4)


def collected(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_funds_and_sectors_equal_brute_force(spark, listed):
    def first(text, squeeze_name):
        bare = re.sub(r"[.\-_]", "", (text or "").lower())
        found = [f for n, f in NAMES if n and (n.replace("-", "") if squeeze_name else n) in bare]
        return found[0] if found else None

    rows = rows_of(spark)
    funds = names.lookup_portfolio(rows, listed, "text")
    assert collected(funds, "portfolio_id") == {k: first(t, True) or "unknown" for k, t in enumerate(texts())}
    sectors = names.company_bucket(rows, listed, "text")
    assert collected(sectors, "bucket_id") == {k: first(t, False) or "UNKNOWN" for k, t in enumerate(texts())}
    assert set(rows.columns) < set(funds.columns)


@pytest.mark.parametrize("unique", [None, "id"])
def test_longest_name_equals_brute_force(spark, listed, unique):
    def longest(text):
        low = (text or "").lower()
        spaced, packed = re.sub("[^a-z0-9]+", " ", low).strip(), re.sub("[^a-z0-9]", "", low)
        for n, f in sorted((p for p in NAMES if p[0]), key=lambda p: -len(p[0])):
            bare = re.sub("[^a-z0-9]", "", n)
            if n in low or n in spaced or (bare and bare in packed):
                return n, f
        return "unknown", "unknown"

    found = names.detect_company(rows_of(spark), listed, unique=unique)
    assert collected(found, "company_key", "portfolio_id") == {k: longest(t) for k, t in enumerate(texts())}
    assert "NestedLoop" not in plan_of(found) and "CartesianProduct" not in plan_of(found)


def test_the_registry_as_a_table_equals_its_branches(spark):
    registry = spark.createDataFrame([(n, f, k) for k, (n, f) in enumerate(dims.portfolio_names())], "name string, portfolio_id string, ordinal int")
    rng = random.Random(2)
    words = [n for n, _ in dims.portfolio_names()] + ["x", " ", "-", "board", "Q4"]
    rows = spark.createDataFrame([(k, "".join(rng.choice(words) for _ in range(rng.randint(0, 4))).upper()) for k in range(300)], "id int, text string")
    branches = rows.withColumn("c", resolve.detect_company(F.col("text"))).select("id", "c.*")
    assert collected(names.detect_company(rows, registry), "company_key", "portfolio_id") == collected(branches, "company_key", "portfolio_id")
    funds = rows.withColumn("f", resolve.lookup_portfolio(F.col("text")))
    assert collected(names.lookup_portfolio(rows, registry, "text"), "portfolio_id") == collected(funds, "f")


@pytest.mark.parametrize("mode", ["reference", "intended"])
def test_labels_equal_the_branches(spark, mode):
    shown = ["Acme", "Acmelabs", "Zeta", "Me", "Q"]
    listed = spark.createDataFrame([(n, k) for k, n in enumerate(shown)], "name string, ordinal int")
    mails = ["cfo@acme.com", "a@zetagroup.mx", "x@me.com", "x@unrelated.org", "broken", None, "x@", "x@Q.com", "x@e.com"]
    files = ["ab12_Acme_Q4.pdf", "zetas report.pdf", None, "", "other.pdf"]
    rows = spark.createDataFrame([(k, m, f) for k, (m, f) in enumerate((m, f) for m in mails for f in files)], "id int, founder_email string, original_filename string")
    branches = rows.withColumn("label", resolve.company_label(F.col("founder_email"), F.col("original_filename"), shown, mode))
    assert collected(names.company_label(rows, listed, mode=mode), "label") == collected(branches, "label")


def test_no_names_and_no_rows(spark, listed):
    rows = rows_of(spark)
    assert set(collected(names.detect_company(rows, listed.limit(0)), "company_key").values()) == {"unknown"}
    assert names.detect_company(rows.limit(0), listed).count() == 0


def test_a_long_text_is_cut_into_pieces_in_one_pass(spark, listed):
    rows = spark.createDataFrame([(1, "é" * 300_000 + " two words")], "id int, text string")
    assert collected(names.detect_company(rows, listed), "company_key") == {1: "two words"}


# ---- rates ----------------------------------------------------------------------------------

RATES = [("mxn ", 2018, 18.0), ("MXN", 2021, 21.0), ("MXN", 2021, 20.5), ("MXN", 2030, 30.0), ("BRL", 2024, 5.0), ("EUR", 2019, 0.9), ("EUR", 2020, 0.8), ("EUR", 2025, 0.7), ("CLP", 2020, None)]


def nearest(code, year):
    own = {}
    for c, y, r in RATES:
        if c.strip().upper() == (code or "").strip().upper() and r is not None:
            own[y] = min(r, own.get(y, r))
    return own[min(own, key=lambda y: (abs(y - year), y))] if own and year is not None else None


def test_rates_of_the_nearest_year_equal_brute_force(spark):
    rates = spark.createDataFrame(RATES, "currency string, year int, rate double")
    asked = [(c, y) for c in ("MXN", " mxn", "BRL", "EUR", "CLP", "XXX", None) for y in [*range(2010, 2041), None, -5, 99999]]
    rows = spark.createDataFrame([(k, c, y) for k, (c, y) in enumerate(asked)], "id int, currency string, report_year int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = resolve.fx_rate_join(rows, rates)
        assert collected(found, "fx_rate") == {k: nearest(c, y) for k, (c, y) in enumerate(asked)}
        assert "Broadcast" not in plan_of(found) and found.columns == [*rows.columns, "fx_rate"]
        none = resolve.fx_rate_join(rows, rates.limit(0))
        assert set(collected(none, "fx_rate").values()) == {None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_one_currency_are_spread(spark):
    rates = spark.createDataFrame(RATES, "currency string, year int, rate double")
    rows = spark.range(20_000).select("id", F.lit("MXN").alias("currency"), F.lit(2022).alias("report_year"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = resolve.fx_rate_join(rows, rates)
        parts = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 1 and found.filter("fx_rate = 20.5").count() == 20_000
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
