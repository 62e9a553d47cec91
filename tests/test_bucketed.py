"""Contracts are staged in buckets by submission_id and judged without their texts, with the same results."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions import periods
from ledgerloom.operators import audit, contract, documents, skew
from ledgerloom.plans import ingest


def text(revenue, cogs, confidence=0.99):
    base = {"revenue": {"value": revenue, "confidence": confidence}, "cogs": {"value": cogs, "confidence": 0.5}}
    return json.dumps({"financial_metrics_2025": {"base_metrics": base, "sector_metrics": {"npl_ratio": {"value": "3%", "confidence": confidence}}}})


def uploaded(spark):
    rows = [(f"S{k}", f"h{k // 2}", f"cust{k}.com", None, "deck.pdf", dt.datetime(2025, 1, 1 + k), "", text(f"${k + 1}M", "$1M")) for k in range(12)]
    rows.append(("S3", "other", "cust3.com", None, "deck.pdf", dt.datetime(2025, 2, 1), "", text("$7M in 2023", "$1M")))  # an id that came twice, for two periods
    schema = "submission_id string, file_hash string, company_id string, founder_email string, original_filename string, submitted_at timestamp_ntz, portfolio_id string, raw_json string"
    return documents.decoded_only(spark.createDataFrame(rows, schema))


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_staged_rows_are_grouped_and_joined_without_a_shuffle(spark, tmp_path):
    built = ingest.build_contracts(uploaded(spark), path=str(tmp_path / "staged"))
    for grouped in (contract.submission_rollup(built.rows), contract.base_values(built.rows, "ordinal"), contract.present_kpis(built.rows),
                    audit.contract_verdicts(built.rows, audit.with_audit_bucket(built.headers))):
        assert "Exchange hashpartitioning" not in plan_of(grouped)
    plain = ingest.build_contracts(uploaded(spark))
    assert built.rows.select(*plain.rows.columns).exceptAll(plain.rows).isEmpty() and built.rows.count() == plain.rows.count()
    named = [c for c in plain.headers.columns if c != "raw_gemini"]
    assert sorted(map(tuple, built.headers.select(named).collect()), key=repr) == sorted(map(tuple, plain.headers.select(named).collect()), key=repr)
    assert sorted(map(tuple, built.warnings.collect())) == sorted(map(tuple, plain.warnings.collect()))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("ledgerloom_")]


def test_texts_are_not_carried_through_the_audit(spark, tmp_path, monkeypatch):
    carried = {}

    def watched(df, name):
        carried[name] = df.columns
        return skew.written(df, name)

    monkeypatch.setattr(ingest, "written", watched)
    stored = spark.createDataFrame([("old", "h2", "cust4.com", "FY2025", True)], "submission_id string, file_hash string, company_id string, period_id string, is_latest_version boolean")
    result = ingest.insert_contracts(ingest.build_contracts(uploaded(spark), path=str(tmp_path / "staged")), stored)
    assert carried and not [name for name, columns in carried.items() if "raw_gemini" in columns]
    got = {r["submission_id"]: r["raw_gemini"] for r in result.headers.collect()}
    # S3 came twice and is rejected, so its copy S2 is alone; S4 and S5 are stored already; of other pairs the first counts
    assert got == {f"S{k}": text(f"${k + 1}M", "$1M") for k in (0, 2, 6, 8, 10)}
    assert {r["submission_id"] for r in result.rejected.collect()} == {"S3"}
    assert {r["submission_id"] for r in result.duplicates.collect()} == {"S4", "S5"}
    rows = {(r["submission_id"], r["kpi_key"]) for r in result.rows.filter("ordinal IS NULL").collect()}
    assert rows == set() and result.rows.count() == 16 * 5


def test_verdicts_before_and_after_rows_meet_their_headers(spark):
    rng = random.Random(5)
    keys = ["revenue", "mrr", "npl_ratio", "gmv", "made_up", "invented", None]
    rows = spark.createDataFrame(
        [(f"S{rng.randint(0, 60)}", rng.choice(keys), rng.choice(["FY2024", "FY2025", None]), rng.choice([None, 0.5, 0.99]), rng.choice([None, "$", "%", "kg", "$K"])) for _ in range(700)],
        "submission_id string, kpi_key string, period_id string, confidence double, unit string").repartition(5)
    heads = [(f"S{k}", rng.choice(["SAAS", "LEND", "OTH", "UNKNOWN", None]), rng.choice(["FY2024", "Q9", None])) for k in range(70)]
    subs = spark.createDataFrame([*heads, heads[7]], "submission_id string, bucket_id string, period_id string")  # one header came twice
    met = rows.join(subs.select("submission_id", F.col("submission_id").alias("contract_id"), "bucket_id"), "submission_id")
    for mode in ("reference", "intended"):
        apart = audit.contract_verdicts(rows, subs, mode)
        assert sorted(map(tuple, apart.collect()), key=repr) == sorted(map(tuple, audit.contract_verdicts(met, subs, mode).select(apart.columns).collect()), key=repr)


def test_present_kpis_of_the_registry_and_others(spark):
    rng = random.Random(6)
    made = [(f"S{rng.randint(0, 20)}", rng.choice([*dims.KPI_KEYS[:5], "zz_top", "a_first", None]), rng.choice([True, False, None]), rng.choice([None, 0.0, 1.5])) for _ in range(300)]
    rows = spark.createDataFrame(made, "submission_id string, kpi_key string, is_valid boolean, numeric_value double")
    want = {s: sorted({k for i, k, v, n in made if i == s and k is not None and v and n is not None}) for s in {m[0] for m in made}}
    assert {r[0]: r[1] for r in contract.present_kpis(rows).collect()} == want


def test_rows_are_grouped_by_hash_before_their_texts(spark, tmp_path):
    spark.createDataFrame([("S", "revenue", "FY1", "USD", 1.0, True, 0.5, 1)], "submission_id string, kpi_key string, period_id string, currency string, numeric_value double, is_valid boolean, confidence double, row_seq int").write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    for grouped in (contract.submission_rollup(rows), contract.base_values(rows), contract.present_kpis(rows)):
        first = [line for line in plan_of(grouped).splitlines() if "Aggregate" in line][-1]
        assert "HashAggregate" in first and "ObjectHash" not in first


def test_documents_in_parts_from_one_pass(spark):
    rows = [("a", 1, "revenue", "1", False), ("a", 2, "cac", "2", True), ("b", 1, "cac", "3", False), ("c", 1, "made_up", "4", False)]
    kpis = spark.createDataFrame(rows, "id string, row_seq int, kpi_key string, raw_value string, is_scalar boolean").withColumns({"confidence": F.lit(0.5), "source_description": F.lit("x")})
    parts = {"first": dims.KPI_KEYS[:8], "later": dims.KPI_KEYS[8:]}
    got = {r["id"]: (r["first"], r["later"]) for r in documents.build_documents(kpis, "id", parts=parts).collect()}
    alone = {name: {r[0]: r[1] for r in documents.build_documents(kpis.filter(F.col("kpi_key").isin(keys)), "id").collect()} for name, keys in parts.items()}
    assert got == {i: tuple(alone[name].get(i, "{}") for name in parts) for i in "abc"}


def test_financial_flag_is_the_gate(spark):
    texts = [text("$1M", "x"), text("N/A", "0"), text("0", "--"), json.dumps({"financial_metrics_2025": {}}), json.dumps({"other": 1})]
    docs = documents.decoded_only(spark.createDataFrame(list(enumerate(texts)), "id int, raw_json string"))
    flagged = documents.with_financial(docs)
    assert flagged.filter(F.col("financial") != documents.is_financial(F.col("doc"))).isEmpty() and flagged.filter("financial").count() == 1


def test_years_are_looked_for_only_where_one_can_be(spark):
    texts = ["in 2024", "x2024", "19 20", "20٢٣", "2023 2024 2024", "", None, "1999", "120 201 2020."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(periods.most_common_year(F.col("t"))).collect()] == ["2024", None, None, "20٢٣", "2024", None, None, None, "2020"]


def test_documents_are_taken_apart_once(spark):
    docs = documents.decoded_only(spark.createDataFrame([("d", 0, text("$1M", "$2M")), ("d", 1, '{"financial_metrics_2025": {"base_metrics": null, "debt_ratios": 3}}')], "doc_id string, chunk_id int, raw_json string"))
    merged = documents.merge_chunk_documents(docs)
    assert "schema_of_variant" not in merged._jdf.queryExecution().optimizedPlan().toString().lower().replace("schemaofvariant", "schema_of_variant")
    assert json.loads(merged.first()["raw_json"])["financial_metrics_2025"]["base_metrics"]["revenue"]["value"] == "$1M"
    rows = documents.explode_kpis(docs, "doc", ["doc_id"])
    assert "Generate" in plan_of(rows) and "kpi_label" not in next(line for line in plan_of(rows).splitlines() if "Generate" in line)
    assert {(r["kpi_key"], r["kpi_label"]) for r in rows.collect()} == {(key, label) for key, label, _, _ in dims.KPI_REGISTRY}
