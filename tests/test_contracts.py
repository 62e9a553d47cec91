"""Documents, contracts, audits and stored tables on small made-up fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.operators import analytics, audit, contract, documents, fidelity, resolve, skew, store
from ledgerloom.plans import ingest
from ledgerloom.sources import catalog, files, vault
from ledgerloom.streaming import ingest as streams


def node(value, confidence=0.9, description="page 1"):
    return {"value": value, "confidence": confidence, "description": description}


GOLDEN = {
    "_document_context": {"currency": "USD", "period": "FY2024"},
    "financial_metrics_2025": {
        "revenue_growth": node("36%"),
        "profit_margins": {"gross_profit_margin": node("18.68%"), "ebitda_margin": node("-0.74%")},
        "cash_flow_indicators": {"cash_in_bank_end_of_year": node("$9.7M"), "annual_cash_flow": node("$1.8M")},
        "debt_ratios": {"working_capital_debt": node("$12.0M")},
        "base_metrics": {"revenue": node("$4.2M"), "ebitda": 5.0, "cogs": None},
        "sector_metrics": {"mrr": True, "cac": "120"},
    },
}


def docs_of(spark, *objects):
    rows = [(f"S{i}", o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)]
    return spark.createDataFrame(rows, "submission_id string, raw_json string")


def test_explode_gives_sixteen_rows_and_survives_scalars(spark):
    docs = documents.decoded_only(docs_of(spark, GOLDEN, json.dumps(json.dumps(GOLDEN)), "{broken", "[1]", "```json\n{}\n```"), fenced=True)
    rows = documents.explode_kpis(docs, "doc", ["submission_id"])
    by = {(r["submission_id"], r["kpi_key"]): r for r in rows.collect()}
    assert len(by) == 3 * 16
    assert by["S0", "ebitda"]["raw_value"] == "5.0" and by["S0", "ebitda"]["numeric_value"] == 5.0
    assert by["S0", "ebitda"]["node_warning"].endswith("float") and by["S0", "mrr"]["raw_value"] == "True"
    assert by["S0", "mrr"]["node_warning"].endswith("bool") and not by["S0", "mrr"]["is_valid"]
    assert by["S0", "cogs"]["raw_value"] is None and by["S0", "cogs"]["unit"] == "$" and by["S0", "cogs"]["node_warning"] is None
    assert by["S1", "revenue"]["numeric_value"] == 4.2e6 and by["S1", "revenue"]["unit"] == "$M"
    assert [by["S0", k]["ordinal"] for k in dims.KPI_KEYS] == list(range(1, 17))


def test_financial_gate_and_sections(spark):
    empty = {"financial_metrics_2025": {"revenue_growth": node("--"), "base_metrics": {"revenue": node("0")}, "sector_metrics": {"churn_rate": node("5%")}}}
    docs = documents.decoded_only(docs_of(spark, GOLDEN, empty, {}))
    assert [r[0] for r in documents.filter_financial_docs(docs).select("submission_id").collect()] == ["S0"]
    missing = {r[0]: r[1] for r in documents.ensure_sections(docs).select("submission_id", "missing_sections").collect()}
    assert missing["S0"] == [] and missing["S1"] == ["profit_margins", "cash_flow_indicators", "debt_ratios"] and len(missing["S2"]) == 6


def test_detect_currency(spark):
    objects = [{"_document_context": {"currency": c}} for c in (" mxn ", "pesos", 5, None)] + [{}]
    docs = documents.decoded_only(docs_of(spark, *objects))
    got = [r[0] for r in docs.orderBy("submission_id").select(documents.detect_currency(F.col("doc"))).collect()]
    assert got == ["MXN", "USD", "USD", "USD", "USD"]


def test_patch_keeps_siblings(spark):
    docs = documents.decoded_only(docs_of(spark, GOLDEN)).select("submission_id", "doc")
    patches = spark.createDataFrame([("S0", "revenue", '9 "new"')], "submission_id string, kpi_key string, value string")
    out = json.loads(documents.patch_document(docs, patches, "submission_id").select(F.to_json("doc")).first()[0])
    assert out["financial_metrics_2025"]["base_metrics"]["revenue"] == node('9 "new"')
    assert out["financial_metrics_2025"]["profit_margins"] == GOLDEN["financial_metrics_2025"]["profit_margins"]
    assert out["_document_context"] == GOLDEN["_document_context"]


ODD_DOC = {
    "financial_metrics_2025": {
        "base_metrics": {"revenue": node("1"), 'own "kpi"': {"value": 5}, "note": None},
        "extra_section": {"x": [1, 2]}, "profit_margins": "n/a"},
    'root "key"': {"a": 1}, "other": True}


def test_patch_keeps_what_the_registry_does_not_name(spark):
    docs = documents.decoded_only(docs_of(spark, ODD_DOC, ODD_DOC)).select("submission_id", "doc")
    patches = spark.createDataFrame([("S0", "revenue", "2"), ("S0", "ebitda", "3")], "submission_id string, kpi_key string, value string")
    out = {r[0]: json.loads(r[1]) for r in documents.patch_document(docs, patches, "submission_id").select("submission_id", F.to_json("doc")).collect()}
    expected = json.loads(json.dumps(ODD_DOC))
    expected["financial_metrics_2025"]["base_metrics"] |= {"revenue": node("2"), "ebitda": {"value": "3"}}
    assert out == {"S0": expected, "S1": ODD_DOC}


def test_merge_keeps_the_first_document_and_adds_sections(spark):
    rows = [("d", 0, json.dumps(ODD_DOC)), ("d", 1, json.dumps(chunk(node("9", 1.0)))), ("e", 0, json.dumps({"only": 1}))]
    chunks = documents.decode_json_doc(spark.createDataFrame(rows, "doc_id string, chunk_id int, raw_json string"))
    out = {r["doc_id"]: json.loads(r["raw_json"]) for r in documents.merge_chunk_documents(chunks).collect()}
    expected = json.loads(json.dumps(ODD_DOC))
    if (node("1")["confidence"] or 0) < 1.0:
        expected["financial_metrics_2025"]["base_metrics"]["revenue"] = node("9", 1.0)
    for section in ("revenue_growth", "profit_margins", "cash_flow_indicators", "debt_ratios", "base_metrics", "sector_metrics"):
        expected["financial_metrics_2025"].setdefault(section, {})
    assert out["d"] == expected
    assert out["e"] == {"only": 1, "financial_metrics_2025": {k: {} for k in ("revenue_growth", "profit_margins", "cash_flow_indicators", "debt_ratios", "base_metrics", "sector_metrics")}}


def chunk(revenue, context=None):
    doc = {"financial_metrics_2025": {"base_metrics": {"revenue": revenue}}}
    return doc | ({"_document_context": context} if context else {})


def test_merge_chunks_rules(spark):
    cases = {
        "tie": [chunk(node("1", 0.5)), chunk(node("2", 0.5))],
        "higher": [chunk(node("1", 0.5)), chunk(node("2", 0.9))],
        "null_conf": [chunk(node("1", None)), chunk(node("2", 0.1))],
        "scalar_first": [chunk("7"), chunk(node(None, 0.9))],
        "scalar_loses": [chunk("7"), chunk(node("2", 0.0))],
        "context": [chunk(node("1")), chunk(node("2", 0.1), {"currency": "EUR"})],
    }
    rows = [(d, i, json.dumps(o)) for d, parts in cases.items() for i, o in enumerate(parts)]
    chunks = documents.decode_json_doc(spark.createDataFrame(rows, "doc_id string, chunk_id int, raw_json string"))
    merged = documents.decoded_only(documents.merge_chunk_documents(chunks))
    kpis = documents.explode_kpis(merged, "doc", ["doc_id"]).filter("kpi_key = 'revenue'")
    got = {r["doc_id"]: r["raw_value"] for r in kpis.collect()}
    assert got == {"tie": "1", "higher": "2", "null_conf": "2", "scalar_first": "7", "scalar_loses": "2", "context": "1"}
    context = lambda mode: {r[0]: r[1] for r in documents.decoded_only(documents.merge_chunk_documents(chunks, mode=mode)).select(
        "doc_id", documents.detect_currency(F.col("doc"))).collect()}["context"]
    assert (context("reference"), context("intended")) == ("USD", "EUR")


def kpi_rows(spark, rows):
    """(submission, kpi, value, confidence, source) to parsed rows."""
    data = [(f"F{i}", i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "id string, row_seq long, submission_id string, kpi_key string, raw_value string, confidence double, source_description string")
    from ledgerloom.functions.values import with_parsed

    return with_parsed(df, F.col("raw_value")).withColumns(
        {"is_valid": F.col("numeric_value").isNotNull(), "period_id": F.lit("FY2025"), "currency": F.lit("USD")})


def test_derived_margins_examples_and_modes(spark):
    rows = kpi_rows(spark, [
        ("A", "revenue", "$4.2M", 0.9, None), ("A", "cogs", "$1.3M", 0.9, None), ("A", "ebitda", "-$0.8M", 0.9, None),
        ("A", "gross_profit_margin", None, None, None), ("Z", "revenue", "0", 1.0, None), ("Z", "cogs", "5", 1.0, None)])
    ref = {(r["submission_id"], r["kpi_key"]): r for r in contract.derive_margins(rows).collect()}
    assert set(ref) == {("A", "ebitda_margin")} and ref["A", "ebitda_margin"]["numeric_value"] == -0.190476
    assert ref["A", "ebitda_margin"]["raw_value"] == "-19.0476%"
    meant = {r["kpi_key"]: r["numeric_value"] for r in contract.derive_margins(rows, mode="intended").collect()}
    assert meant == {"ebitda_margin": -0.190476, "gross_profit_margin": 0.690476}


def test_rollup_status_and_modes(spark):
    rows = kpi_rows(spark, [("A", "revenue", "5", 0.9, None), ("A", "cogs", "x", 0.5, None), ("B", "cogs", "x", None, None), ("C", "cogs", "1", None, None)])
    got = {r["submission_id"]: r for r in contract.submission_rollup(rows).collect()}
    assert (got["A"]["avg_confidence"], got["A"]["status"], got["A"]["valid_ratio"]) == (0.7, "pending_human_review", 0.5)
    assert (got["B"]["status"], got["C"]["status"]) == ("empty", "processed")
    meant = {r["submission_id"]: r["status"] for r in contract.submission_rollup(rows, "intended").collect()}
    assert meant["A"] == "processed"


def test_checklist_messages(spark):
    rows = kpi_rows(spark, [("A", "revenue", "5", 0.9, None), ("A", "mrr", "5", 0.9, None), ("B", "revenue", "1", 1.0, None), ("B", "ebitda", "2", 1.0, None)])
    heads = spark.createDataFrame([("A", "SAAS"), ("B", "OTH"), ("C", "UNKNOWN")], "submission_id string, bucket_id string")
    got = {r["submission_id"]: r for r in contract.completeness(contract.sector_checklist(rows, heads)).collect()}
    assert got["A"]["display_message"] == "Atencion: Reporte SaaS incompleto. Faltan: churn_rate, cac."
    assert (got["A"]["completeness_pct"], got["A"]["completeness_color"]) == (50, "red")
    assert got["B"]["is_complete"] and got["B"]["display_message"].startswith("Reporte OTH completo.")
    assert got["C"]["display_message"].startswith("Sector 'UNKNOWN' sin checklist")


def test_recalculation_modes(spark):
    rows = kpi_rows(spark, [("A", "revenue", "100", 1.0, None), ("A", "cogs", "31", 1.0, None), ("A", "gross_profit_margin", "68%", 1.0, "page 2"), ("A", "mrr", "5", 1.0, "calculated")])
    status = lambda mode: {r["kpi_key"]: (r["calc_status"], r["delta_pct_points"]) for r in fidelity.recalc_margins(rows, mode=mode).collect()}
    assert status("reference")["gross_profit_margin"] == ("ERROR", 6731.0)
    assert status("intended")["gross_profit_margin"] == ("WARN", 1.0)
    assert status("reference")["mrr"][0] == "WARN" and status("reference")["revenue"][0] == "OK"


def test_post_load_audit_three_valued_logic(spark):
    facts = spark.createDataFrame(
        [("1", "A", "k", "P", True, 0.9), ("2", "A", "k", "P", True, 0.9), ("3", "A", "m", "P", None, 0.9), ("4", "A", "n", "P", False, 0.1),
         ("5", "A", "o", "P", True, 0.69), ("6", "A", "p", "P", True, 0.8), ("7", "A", "q", "P", True, None), ("8", "B", "q", "P", False, None)],
        "id string, submission_id string, kpi_key string, period_id string, is_valid boolean, confidence double")
    subs = spark.createDataFrame([("A", "c", "F", True), ("B", "c", "F", False)], "submission_id string, company_id string, portfolio_id string, is_latest_version boolean")
    got = {r["id"]: r["audit_status"] for r in audit.post_load_audit(facts, subs).collect()}
    assert got == {"1": audit.AUDIT_DUPLICATE, "2": audit.AUDIT_DUPLICATE, "4": audit.AUDIT_INVALID, "5": audit.AUDIT_CRITICAL, "6": audit.AUDIT_LOW}


def test_hot_keys_are_split_without_changing_results(spark):
    """One key with a third of all rows, null keys, and a limit of 10 rows per task."""
    rows = spark.range(0, 600, 1, 6).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 70).cast("string"))).alias("key"))
    counts = skew.count_by(rows, ["key"], "n")
    split = skew.attach_by_key(rows, counts, ["key"], weight="n", hot_rows=10)
    expected = {}
    for r in rows.collect():
        expected[r["key"]] = expected.get(r["key"], 0) + 1
    got = split.collect()
    assert len(got) == 600 and all(r["n"] == expected[r["key"]] for r in got)
    # rows that come out of a join on the key lie in one task; the salt still spreads them
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = rows.join(counts.withColumnsRenamed({"n": "before"}), "key").join(rows.select(F.col("id").alias("id2"), F.col("id")), "id")
        again = skew.attach_by_key(joined.repartition(4, "key"), counts, ["key"], weight="n", hot_rows=10)
        spread = again.filter("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert spread > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert split.select("id", "n").exceptAll(skew.attach_by_key(rows, counts, ["key"], hot_rows=10**6).select("id", "n")).count() == 0


def test_contract_verdicts_count_what_the_findings_list(spark):
    rows = spark.createDataFrame(
        [("1", 1, "A", "A", "c", "SAAS", "revenue", "FY2024", 1.0, "$"), ("2", 2, "A", "A", "c", "SAAS", "revenue", "FY2024", 1.0, "%"),
         ("3", 3, "A", "B", "c", "SAAS", "revenue", "FY2024", 1.0, "$"), ("4", 4, "B", "B", "c", "LEND", "mrr", "FY2024", 0.99, "$"),
         ("5", 5, "B", "B", "c", "LEND", "own", None, 0.5, "x"), ("6", 6, "B", "B", "c", "LEND", "own", None, None, None), ("7", 7, "Z", "A", "c", "SAAS", "cogs", "FY2024", None, "%")],
        "id string, row_seq int, submission_id string, contract_id string, company_id string, bucket_id string, kpi_key string, period_id string, confidence double, unit string")
    subs = spark.createDataFrame([("A", "SAAS", "FY2024"), ("B", "LEND", "soon"), ("C", "OTH", None)], "submission_id string, bucket_id string, period_id string")
    for mode in ("reference", "intended"):
        listed = audit.contract_audit(audit.contract_findings(rows, subs, mode), subs)
        counted = audit.contract_verdicts(rows, subs, mode).select(*listed.columns)
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, listed.collect()))


def test_latest_version_one_per_key(spark):
    subs = spark.createDataFrame([("1", "c", "P", 1), ("2", "c", "P", 2), ("3", "c", "P", 2), ("4", "c", "", 1), ("5", "", "P", 1), ("6", "d", "P", 9)],
                                 "submission_id string, company_id string, period_id string, submitted_at int")
    got = {r["submission_id"]: r["is_latest_version"] for r in store.latest_version(subs).collect()}
    assert got == {"1": False, "2": False, "3": True, "4": True, "5": True, "6": True}


def test_edits_keep_the_previous_text(spark):
    facts = kpi_rows(spark, [("A", "revenue", "5", 1.0, None), ("A", "cogs", "3", 1.0, None)])
    edits = spark.createDataFrame([("A", "revenue", "$6K", 1), ("A", "revenue", "x", 2), ("Z", "revenue", "1", 1)],
                                  "submission_id string, kpi_key string, value string, edited_at int").withColumn("edited_at", F.timestamp_seconds("edited_at").cast("timestamp_ntz"))
    got = {r["kpi_key"]: r for r in store.apply_kpi_edits(facts, edits).collect()}
    assert (got["revenue"]["raw_value"], got["revenue"]["edited_raw_value"], got["revenue"]["is_valid"], got["revenue"]["numeric_value"]) == ("x", "$6K", False, None)
    assert got["cogs"]["is_manually_edited"] is None and got["cogs"]["numeric_value"] == 3.0
    assert [r[0] for r in store.edits_not_found(facts, edits).select("submission_id").collect()] == ["Z"]


def test_analytics_modes(spark):
    facts = kpi_rows(spark, [("1", "revenue_growth", "10%", 1.0, None), ("2", "revenue_growth", "30%", 1.0, None)])
    subs = spark.createDataFrame([("1", "c", "F", False), ("2", "c", "F", True)], "submission_id string, company_id string, portfolio_id string, is_latest_version boolean").withColumn(
        "submitted_at", F.lit("2025-03-01").cast("timestamp_ntz"))
    one = lambda mode: analytics.portfolio_analytics(facts, subs, "F", mode=mode).first()
    assert (one("reference")["submission_count"], one("reference")["revenue_growth"], one("reference")["month"]) == (2, 20.0, "2025-03")
    assert (one("intended")["submission_count"], one("intended")["revenue_growth"]) == (1, 30.0)


def test_anomaly_modes(spark):
    rows = spark.createDataFrame([(100.0, 151.0), (100.0, 150.0), (0.0, 9.0), (-100.0, 100.0)], "old double, new double")
    flags = lambda mode: [r[0] for r in rows.select(analytics.anomaly_flag(F.col("new"), F.col("old"), mode)).collect()]
    assert flags("reference") == [True, False, False, False] and flags("intended") == [True, False, False, True]


def test_rule_of_40_and_net_margin(spark):
    row = spark.range(1).select(analytics.rule_of_40(F.lit(36.0), F.lit(-0.74)).alias("a"), analytics.net_margin_proxy(F.lit(18.68), F.lit(-0.74)).alias("b")).first()
    assert row["a"] == pytest.approx(35.26) and row["b"] == pytest.approx(17.94)


def contract_docs(spark):
    raw = docs_of(spark, GOLDEN, GOLDEN, {"financial_metrics_2025": {"base_metrics": {"revenue": node("5 in 2023")}}})
    head = raw.withColumns({
        "file_hash": F.when(F.col("submission_id") == "S2", "h2").otherwise("h0"), "company_id": F.lit("conekta.com"), "founder_email": F.lit("a@conekta.com"),
        "original_filename": F.lit("x.pdf"), "submitted_at": F.lit("2025-03-01").cast("timestamp_ntz"), "portfolio_id": F.lit("")})
    return documents.decoded_only(head)


def test_insert_contracts(spark, tmp_path):
    built = ingest.build_contracts(contract_docs(spark), path=str(tmp_path / "staged"))
    assert {r["submission_id"]: r["period_id"] for r in built.headers.collect()} == {"S0": "FY2025", "S1": "FY2025", "S2": "FY2023"}
    stored = spark.createDataFrame([("old", "h2", "conekta.com", "FY2025", True)], "submission_id string, file_hash string, company_id string, period_id string, is_latest_version boolean")
    result = ingest.insert_contracts(built, stored)
    heads = result.headers.collect()
    assert [(r["submission_id"], r["portfolio_id"], r["is_latest_version"]) for r in heads] == [("S0", "VII", True)]
    assert result.rows.count() == 16 and result.duplicates.collect()[0]["stored_submission_id"] == "old"
    assert result.retired.collect()[0]["is_latest_version"] is False and result.rejected.count() == 0


def test_static_dims_are_whole(spark):
    counts = dims.dim_company(spark).groupBy("portfolio_id", "bucket_id").count().collect()
    got = {(r[0], r[1]): r[2] for r in counts}
    assert got == {("VII", "SAAS"): 4, ("VII", "LEND"): 3, ("VII", "ECOM"): 3, ("CIII", "SAAS"): 9, ("CIII", "LEND"): 3, ("CIII", "ECOM"): 2, ("CIII", "INSUR"): 3, ("CIII", "OTH"): 3}
    assert dims.dim_fx(spark).count() == 82 and dims.dim_requirement(spark).count() == 15 and dims.dim_kpi(spark).count() == 16


def test_catalog_csv_forward_fill(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Portco,Current,Proposed,Rationale,\nStd,Revenue,Revenue,Keep,\n,NA,NDR,"a, b",\nAcme,MRR,Rule,"x",note\n')
    got = [tuple(r) for r in catalog.catalog_from_csv(spark, str(tmp_path / "c.csv")).orderBy("company", "position").collect()]
    assert got == [("Acme", 1, "MRR", "Rule", "x"), ("Std", 1, "Revenue", "Revenue", "Keep"), ("Std", 2, "NA", "NDR", "a, b")]


def test_json_vault_files(spark, tmp_path):
    root = tmp_path / "vault"
    for company, name, body in [("acme", "h1_result.json", json.dumps(GOLDEN)), ("acme", "bad.json", "{"), ("beta", "h2_result.json", json.dumps(json.dumps(GOLDEN))), ("beta", "n.txt", "x")]:
        (root / company).mkdir(parents=True, exist_ok=True)
        (root / company / name).write_text(body)
    every = {(r["company_domain"], r["id"]) for r in vault.scan_json_files(spark, str(root)).collect()}
    assert every == {("acme", "h1_result"), ("beta", "h2_result")}
    assert vault.scan_json_files(spark, str(root), "beta").count() == 1


def test_csv_cap_keeps_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n\n" + "\n".join(str(i) for i in range(700)) + "\n")
    capped = files.scan_csv(spark, str(tmp_path / "a.csv"), "n int", limit=500)
    assert sorted(r["n"] for r in capped.collect()) == list(range(500))
    assert files.scan_csv(spark, str(tmp_path / "a.csv")).count() == 700


def test_required_value_stops_an_append(spark, tmp_path):
    bad = spark.createDataFrame([(None, "S", "k")], "id string, submission_id string, kpi_key string")
    with pytest.raises(Exception, match="required value missing"):
        store.append_rows(bad, str(tmp_path / "t"), store.FACT_LAYOUT)


def test_stream_dedup_over_batches_and_repeat(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "submission_id string, file_hash string, submitted_at int"
    for wave in ([("1", "a", 1), ("2", "a", 2)], [("3", "a", 0), ("4", "b", 4)]):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema).parquet(source)
        streams.stream_dedup_hash(arriving, path, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r["file_hash"], r["submission_id"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", "1"), ("b", "4")]


def test_default_rules_of_any_size_are_dealt_out(spark):
    """3,000 default rules for companies without rules (a repeated and a null one among them), never one list."""
    default = [("Standard_KPIs", f"rule {k % 2_999}", k) for k in range(3_000)]
    catalog = spark.createDataFrame([("a", "own", 1), ("a", "own", 1), ("b", None, 2), (None, "nobody's", 3), *default], "company string, rule string, n int")
    companies = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 3), (None, 4), ("d", 5)], "company string, id int")
    found = resolve.catalog_with_default(companies, catalog)
    assert found.columns == ["company", "id", "rule_set", "rule", "n"]
    expected = [("a", 1, "a", "own", 1)] * 2 + [("b", 2, "b", None, 2)] + [(c, i, *r) for c, i in [("c", 3), ("c", 3), (None, 4), ("d", 5)] for r in default]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert resolve.catalog_with_default(companies, catalog.where("company <> 'Standard_KPIs'")).count() == 3
