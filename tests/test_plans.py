"""Scans in splits, CSV sheets, result files, manual documents and the ingest plan."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.operators import documents, scans, store
from ledgerloom.plans import ingest
from ledgerloom.session import work_path
from ledgerloom.sources import catalog, vault


# ---- scans ----------------------------------------------------------------------------------


@pytest.fixture
def narrow_splits(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_fill_and_numbers_equal_brute_force(spark, narrow_splits):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), k, rng.choice([None, "", "", None, f"v{k}"])) for k in range(3000)]
    rows += [("empty", k, None) for k in range(10)]
    df = spark.createDataFrame(rows, "sheet string, pos long, cell string").repartition(7)
    last, count, filled, numbers = {}, {}, {}, {}
    for sheet, pos, cell in rows:
        last[sheet] = cell or last.get(sheet)
        count[sheet] = count.get(sheet, 0) + 1
        filled[sheet, pos], numbers[sheet, pos] = last[sheet], count[sheet]
    found = scans.forward_fill(df, "cell", ["sheet"], "pos")
    assert {(r["sheet"], r["pos"]): r["cell"] for r in found.collect()} == filled and found.columns == df.columns
    numbered = scans.row_numbers(df, ["sheet"], "pos")
    assert {(r["sheet"], r["pos"]): r["position"] for r in numbered.collect()} == numbers
    split = scans.in_splits(df, ["sheet"], "pos")
    assert split.filter("sheet = 'hot'").select(scans.SPLIT).distinct().count() > 1  # a long sheet is no single task
    assert scans.row_numbers(df.limit(0), ["sheet"], "pos").count() == 0


def test_csv_sheets(spark, tmp_path):
    one = 'Company,Legacy,Target,Logic,Notes\nAcme,"Net ""rev""\n(all)",revenue,a,\n,EBITDA,ebitda,,x\n,"",cogs,c,\nZeta,MRR,mrr,d,\nAcme,late,cac,e,\n'
    two = "Company,Legacy,Target,Logic,Notes\n,orphan,x,y,\nBeta,Churn,churn_rate,f,\n"
    (tmp_path / "one.csv").write_text(one)
    (tmp_path / "two.csv").write_text(two)
    found = {(r["company"], r["position"]): (r["legacy_kpi"], r["target_kpi"]) for r in catalog.catalog_from_csv(spark, str(tmp_path)).collect()}
    assert found == {
        ("Acme", 1): ('Net "rev"\n(all)', "revenue"), ("Acme", 2): ("EBITDA", "ebitda"), ("Acme", 3): (None, "cogs"), ("Zeta", 1): ("MRR", "mrr"),
        ("Acme", 4): ("late", "cac"), (None, 1): ("orphan", "x"), ("Beta", 1): ("Churn", "churn_rate"),
    }


# ---- result files ---------------------------------------------------------------------------


def test_result_files(spark, tmp_path):
    root = str(tmp_path / "my results")
    rows = [("acme", "1_result", '{"a": 1}'), ("acme", "x y+z%", json.dumps('{"a": 2}')), ("zeta", "3_result", "{broken"), ("zeta", "4_result", "[1]"), ("zeta", "5", None), ("acmeco", "6", '{"a": 6}')]
    results = spark.createDataFrame(rows, "company_domain string, id string, raw_json string").repartition(3)
    for _ in range(2):  # a repeated write replaces the files
        vault.write_json_files(results, root)
    (tmp_path / "my results" / "acme" / "raw").mkdir()
    (tmp_path / "my results" / "acme" / "notes.txt").write_text("{}")
    (tmp_path / "my results" / "acme" / "raw" / "deep.json").write_text('{"a": 7}')

    def items(df):
        return {(r["company_domain"], r["id"], r["a"]) for r in df.select("company_domain", "id", documents.dig(F.col("doc"), ["a"], "int").alias("a")).collect()}

    everything = {("acme", "1_result", 1), ("acme", "x y+z%", 2), ("acmeco", "6", 6), ("acme", "raw/deep", 7)}
    assert items(vault.scan_json_files(spark, root)) == everything
    assert items(vault.scan_json_files(spark, root, "acme")) == {i for i in everything if i[0] == "acme"}
    assert items(vault.scan_json_files(spark, root, "nobody")) == set()
    bad = {(r["gcs_path"], r["reason"]) for r in vault.scan_json_quarantine(spark, root).collect()}
    assert bad == {("my results/zeta/3_result.json", "json_error"), ("my results/zeta/4_result.json", "not_object")}  # an empty file is not read at all


def test_one_company_reads_its_own_files(spark, tmp_path):
    root = str(tmp_path / "vault")
    rows = [(f"c{k % 5}", str(k), "{}") for k in range(50)]
    vault.write_json_files(spark.createDataFrame(rows, "company_domain string, id string, raw_json string"), root)
    read = vault.json_texts(spark, root, "c3").inputFiles()
    assert len(read) == 10 and all("/c3/" in f for f in read)


def test_result_files_as_a_stream(spark, tmp_path):
    root, sink, checkpoint = str(tmp_path / "vault"), work_path(spark, "sink"), work_path(spark, "checkpoint")
    schema = "company_domain string, id string, raw_json string"
    for wave in range(2):
        vault.write_json_files(spark.createDataFrame([(f"c{k}", str(wave), f'{{"a": {k}}}') for k in range(3)] + [("bad", str(wave), "{")], schema), root)
        arriving = documents.decoded_only(vault.json_texts(spark, root, stream=True), "value").select("company_domain", "id")
        arriving.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == sorted((f"c{k}", str(w)) for k in range(3) for w in range(2))


def test_copies_land_in_the_company_partition(spark, tmp_path):
    path = str(tmp_path / "vault")
    stored = spark.createDataFrame([("acme", "h1", "a.pdf", '{"x": 1}'), ("zeta", "h2", None, "{}")], "company_domain string, file_hash string, original_filename string, raw_json string")
    vault.write_result_vault(stored, path)
    wanted = spark.createDataFrame([("beta", "h1", "b@b"), ("beta", "h1", "a@b"), ("acme", "h1", "c"), ("beta", "h2", None), ("beta", "h9", None)], "company_domain string, file_hash string, founder_email string")
    vault.copy_to_vault(wanted, path)
    assert os.path.isdir(f"{path}/company_domain=beta")
    read = spark.read.option("mergeSchema", True).parquet(path).filter("company_domain = 'beta'")
    rows = {(r["file_hash"], r["founder_email"], r["original_filename"], r["raw_json"], r["copied_from_general"]) for r in read.collect()}
    assert rows == {("h1", "a@b", "a.pdf", '{"x": 1}', True), ("h2", None, "unknown", "{}", True)}
    vault.copy_to_vault(wanted, path)  # nothing is copied twice
    assert spark.read.parquet(path).count() == 4


def test_a_vault_of_many_companies_lies_in_slots(spark, tmp_path):
    path = str(tmp_path / "vault")
    stored = spark.createDataFrame([("acme", "h1", "a.pdf", '{"x": 1}'), ("7", "h2", None, "{}")], "company_domain string, file_hash string, original_filename string, raw_json string")
    vault.write_result_vault(stored, path, digits=2)
    wanted = spark.range(2000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("company_domain"), F.lit("h1").alias("file_hash"), F.lit(None).cast("string").alias("founder_email"))
    for _ in range(2):  # nothing is copied twice
        vault.copy_to_vault(wanted, path)
        folders = [name for name in os.listdir(path) if "=" in name]
        assert len(folders) <= 256 and all(name.startswith("slot=s") and len(name) == 8 for name in folders)
        read = spark.read.option("mergeSchema", True).parquet(path)
        assert read.count() == 2002 and read.select("company_domain").distinct().count() == 2002
    for company in ("c17", "7"):
        found = vault.of_company(read, company)
        assert [r["company_domain"] for r in found.collect()] == [company]
        scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters: [" in line]
        assert scans and all("PartitionFilters: []" not in line for line in scans)


# ---- documents and ingest -------------------------------------------------------------------


def test_manual_documents(spark):
    kpis = ", ".join(f"{k} string" for k in dims.KPI_KEYS)
    values = {"revenue": "$2M", "churn_rate": " 3% ", "mrr": "  "}
    row = ("acme", "H1 2024", "VII", None, dt.datetime(2025, 5, 1), *[values.get(k) for k in dims.KPI_KEYS])
    wide = spark.createDataFrame([row], f"company_id string, period_id string, portfolio_id string, founder_email string, submitted_at timestamp_ntz, {kpis}")
    docs = documents.manual_documents(wide, F.lit("salt"))
    first = docs.select("*", F.to_json("doc").alias("text")).first()
    tree, text = json.loads(first["text"]), json.loads(first["raw_json"])
    assert tree == text and list(text) == [dims.CONTEXT, dims.ROOT]
    assert text[dims.CONTEXT] == {"currency": "USD", "period": "H1 2024", "scale": "units", "scale_notes": documents.MANUAL_NOTE}
    assert text[dims.ROOT]["base_metrics"]["revenue"] == {"value": "$2M", "confidence": 1.0, "description": documents.MANUAL_NOTE}
    rows = {r["kpi_key"]: r for r in documents.explode_kpis(docs, "doc", ["submission_id"]).collect()}
    assert len(rows) == 16 and rows["revenue"]["numeric_value"] == 2_000_000.0 and rows["mrr"]["raw_value"] is None and rows["mrr"]["confidence"] == 1.0
    assert documents.manual_documents(wide.union(wide)).select("file_hash").distinct().count() == 2  # a repeated entry is no copy


DOC = '{{"_document_context": {{"currency": "USD", "period": "FY2024"}}, "financial_metrics_2025": {{"base_metrics": {{"revenue": {{"value": "{0}", "confidence": {1}}}}}}}}}'


def test_documents_are_worked_out_once(spark, tmp_path):
    """Rows are extracted from the staged documents, so what the documents come from is read once."""
    text = '{"financial_metrics_2025": {"base_metrics": {"revenue": {"value": "$1M", "confidence": 0.9}}}}'
    seen = spark.sparkContext.accumulator(0)

    def passed(rows):
        for row in rows:
            seen.add(1)
            yield row

    ids = spark.createDataFrame(spark.sparkContext.parallelize([("S1",), ("S2",)], 1).mapPartitions(passed), "submission_id string")
    docs = documents.decoded_only(ids.select(
        "submission_id", *[F.lit("x").alias(c) for c in ingest.HEADER_INPUT if c not in ("submission_id", "submitted_at")],
        F.lit("2025-01-01").cast("timestamp_ntz").alias("submitted_at"), F.lit(text).alias("raw_json")))
    built = ingest.build_contracts(docs, path=str(tmp_path / "staged"))
    assert built.rows.count() == 32 and built.headers.count() == 2
    assert seen.value == 2


def test_code_fences_and_blanks(spark):
    fence = "```"
    texts = ["{}", f"{fence}json\n{{}}\n{fence}", f" \t\x0b{fence}json {{}} {fence}\x0c\n", f"{{}}{fence}", f"{fence}{{}}", '\n"{}"\x0b', "\x0c{}\x0b", f"a {fence} b", "", " \n", None, f"{fence}json{fence}"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    plain = F.regexp_replace(F.btrim("t", F.lit(" \t\n\r\x0b\x0c")), r"^```json\s*|\s*```$", "")
    assert all(r["a"] == r["b"] for r in rows.select(documents.strip_code_fence(F.col("t")).alias("a"), plain.alias("b")).collect())


def test_ingest_of_chunks(spark, tmp_path):
    root = str(tmp_path / "out")
    chunks = [
        ("S1", 0, DOC.format("$1M", 0.8)), ("S1", 1, "```json\n" + DOC.format("$2M", 0.9) + "\n```"), ("S2", 0, DOC.format("$3M", 0.9)), ("S2", 1, "{broken"),
        ("S3", 0, "[]"), ("S4", 0, DOC.format("N/A", 0.9)), ("S5", 0, DOC.format("$5M", 0.9)), ("S6", 0, DOC.format("$6M", 0.9)),
    ]
    uploads = [(f"S{k}", f"h{min(k, 5)}", "someone.com", None, "Conekta deck.pdf" if k == 1 else "deck.pdf", dt.datetime(2025, 1, k)) for k in range(1, 7)]
    stored = spark.createDataFrame([("S0", "h2", "conekta", "FY2025", dt.datetime(2024, 1, 1), True)], "submission_id string, file_hash string, company_id string, period_id string, submitted_at timestamp_ntz, is_latest_version boolean")
    done = ingest.ingest_chunks(
        spark.createDataFrame(chunks, "submission_id string, chunk_id int, raw_json string"),
        spark.createDataFrame(uploads, "submission_id string, file_hash string, company_id string, founder_email string, original_filename string, submitted_at timestamp_ntz"),
        stored, root,
    )
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    heads = {r["submission_id"]: (r["company_id"], r["portfolio_id"]) for r in read("submissions").collect()}
    assert heads == {"S1": ("conekta", "VII"), "S5": ("someone.com", "unknown")}  # S2 is stored, S6 is a copy of S5
    revenue = {r["submission_id"]: r["numeric_value"] for r in read("facts").filter("kpi_key = 'revenue'").collect()}
    assert revenue == {"S1": 2_000_000.0, "S5": 5_000_000.0}
    quarantined = {(r["submission_id"], r["stage"], r["reason"]) for r in read("quarantine").collect()}
    assert quarantined == {("S2", "decode", "chunk 1: json_error"), ("S3", "decode", "chunk 0: not_object"), ("S4", "gate", "not_financial")}
    assert [r["submission_id"] for r in read("duplicates").collect()] == ["S2"]
    assert {r["submission_id"] for r in read("retired").collect()} == {"S0"}
    assert {(r["company_domain"], r["file_hash"]) for r in read("vault").collect()} == {("conekta", "h1"), ("someone.com", "h2"), ("someone.com", "h5")}
    assert done.counts == {"submissions": 2, "facts": 32, "rejected": 0, "duplicates": 1, "retired": 1, "quarantine": 3, "checklist": 4, "vault": 4}


def test_a_batch_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "submission_id string, chunk_id int, raw_json string")
    uploads = spark.createDataFrame([], "submission_id string, file_hash string, company_id string, founder_email string, original_filename string, submitted_at timestamp_ntz")
    stored = spark.createDataFrame([], store.layout_schema(store.SUBMISSIONS_LAYOUT))
    done = ingest.ingest_chunks(empty, uploads, stored, str(tmp_path / "out"))
    assert set(done.counts.values()) == {0}
