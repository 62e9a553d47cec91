"""Reports and flags that read the rows once, against the operators they replace or brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit, contract, fidelity, skew

FACT = "id string, submission_id string, kpi_key string, raw_value string, numeric_value double, source_description string, is_valid boolean, confidence double, period_id string, row_seq long"


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(8)
    keys = ["revenue", "cogs", "ebitda", "gross_profit_margin", "ebitda_margin", "mrr", "churn_rate", "made_up"]
    rows = []
    for n in range(1500):
        value = rng.choice([None, 0.0, 10.0, 10.2, 4.0, 0.4, 0.6, 60.0, 0.593, 0.575])
        raw = rng.choice([None, "60%", "$1", "x"])
        rows.append((str(n), f"S{rng.randint(0, 120)}", rng.choice(keys), raw, value, rng.choice([None, "calculated", "page 1"]),
                     rng.choice([True, False, None, value is not None]), rng.choice([None, 0.5, 0.8, 0.95]), rng.choice(["FY1", "FY2", None]), n))
    return spark.createDataFrame(rows, FACT).repartition(4)


@pytest.fixture(scope="module")
def submissions(spark):
    rows = [(f"S{k}", f"c{k % 7}", f"c{k % 7}", k % 3 > 0, ["SAAS", "LEND", "OTH", "NONE"][k % 4]) for k in range(125)]
    return spark.createDataFrame(rows, "submission_id string, company_id string, company_key string, is_latest_version boolean, bucket string")


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame([("c1", "SAAS"), ("c2", ""), ("c3", None), ("c4", "LEND")], "company_key string, bucket_id string")


def report(df):
    return {r["submission_id"]: tuple(r[c] for c in ("is_complete", "discrepancies", "errors", "warnings", "overall_status")) for r in df.collect()}


@pytest.mark.parametrize("mode", ["reference", "intended"])
def test_fidelity_report_equals_the_three_audits(facts, submissions, companies, mode):
    expected = F.col("bucket")
    heads = submissions.join(contract.submission_rollup(facts, mode), "submission_id")
    identity = fidelity.fidelity_identity(heads, companies, expected)
    checklist = fidelity.fidelity_checklist(facts, identity).select("submission_id", "is_complete", "checklist_warnings")
    calculator = fidelity.fidelity_calculator(facts, mode=mode)
    joined = identity.join(checklist, "submission_id").join(calculator, "submission_id")
    errors, warnings = F.col("identity_errors") + F.col("calc_errors"), F.col("identity_warnings") + F.col("calc_warnings") + F.col("checklist_warnings")
    apart = joined.select("submission_id", "is_complete", "discrepancies", errors.alias("errors"), warnings.alias("warnings"), fidelity.fidelity_verdict(errors, warnings).alias("overall_status"))
    once = report(fidelity.fidelity_report(facts, submissions, companies, mode=mode, expected=expected))
    assert once == report(apart)
    assert once == report(fidelity.fidelity_report(facts, heads, companies, mode=mode, expected=expected))
    assert {v[4] for v in once.values()} >= {"FAIL", "WARN"} and sum(v[1] for v in once.values()) > 20


def test_submissions_without_rows_keep_their_stored_status(facts, submissions, companies):
    stored = submissions.withColumns({"status": F.lit("processed"), "avg_confidence": F.lit(0.9)})
    found = report(fidelity.fidelity_report(facts.limit(0), stored, companies, expected=F.col("bucket")))
    assert len(found) == 125 and all(v[1] == 0 for v in found.values()) and sum(not v[0] for v in found.values()) > 60


def test_facts_are_scanned_once(spark, facts, submissions, companies, tmp_path):
    facts.write.parquet(str(tmp_path / "facts"))
    stored = spark.read.parquet(str(tmp_path / "facts"))
    plan = fidelity.fidelity_report(stored, submissions, companies, expected=F.col("bucket"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def brute_flags(rows):
    seen, out = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["row_seq"], r["id"])):
        key = (r["submission_id"], r["kpi_key"], r["period_id"])
        out[r["id"]] = seen[key] > 0
        seen[key] += 1
    return out, seen


def test_duplicates_are_flagged_and_found(facts):
    flags, seen = brute_flags(facts.collect())
    assert {r["id"]: r["is_duplicate"] for r in audit.in_batch_duplicate(facts).collect()} == flags
    found = Counter((r["submission_id"], r["kpi_key"]) for r in audit.audit_duplicate(facts).collect())
    expected = Counter()
    for (sub, kpi, _), n in seen.items():
        expected[sub, kpi] += n - 1
    assert found == +expected


def test_findings_of_a_hot_key_are_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(audit, "COPIES", 1000)
    rows = spark.range(20_001).select(F.lit("S").alias("submission_id"), F.lit("mrr").alias("kpi_key"), F.lit(None).cast("string").alias("period_id"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = [r["count"] for r in audit.audit_duplicate(rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(per_task) == 20_000 and len(per_task) > 1


def test_rows_are_worked_out_once_for_counting_and_joining(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).select((F.col("id") % 10).alias("k"), "id").mapInArrow(counted, "k long, id long")
    per_key = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for hot in (10, 10_000):
        found = skew.attach_by_key(rows, per_key, ["k"], hot_rows=hot)
        assert found.agg(F.count("v"), F.count(F.lit(1))).first() == (500, 1000)
    assert runs.value == 2000
