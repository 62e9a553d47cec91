"""Audits, fidelity, stored tables, sources and streaming over the driver's tables."""

from __future__ import annotations

import functools

from pyspark.sql import Window, functions as F

from ledgerloom import dims
from ledgerloom.operators import audit, documents, fidelity, resolve, store, touched
from ledgerloom.operators.skew import written
from ledgerloom.plans import ingest
from ledgerloom.plans.fixtures import Tables
from ledgerloom.plans.registry import query
from ledgerloom.session import work_path
from ledgerloom.sources import catalog, files, vault
from ledgerloom.streaming import ingest as streams

C = F.col


# ---- audit rules ----------------------------------------------------------------------------

@query("audit_period_format", """
SELECT submission_id, 'error' AS level, 'period_format' AS "check", '*' AS kpi_key, 'period_id ''' || period_id || ''' does not match expected formats (FY2025, H1 2025, Q4 2025, 2025M01).' AS detail
FROM subs WHERE seq % 20 = 3""")
def _(t: Tables):
    return audit.audit_period_format(t.subs)


@query("audit_orphan", """
SELECT submission_id, 'error' AS level, 'orphan' AS "check", kpi_key, 'kpi_row.submission_id ''' || submission_id || ''' does not match contract submission_id ''S' || l_suppkey || '''.' AS detail
FROM kpi WHERE l_partkey % 50 = 1 AND submission_id <> 'S' || l_suppkey""")
def _(t: Tables):
    moved = F.when(C("l_partkey") % 50 == 1, F.concat(F.lit("S"), C("l_suppkey").cast("string"))).otherwise(C("submission_id"))
    return audit.audit_orphan(t.kpi.select("submission_id", "kpi_key", moved.alias("contract_id")))


@query("audit_duplicate", """
SELECT submission_id, 'error' AS level, 'duplicate' AS "check", kpi_key, 'Duplicate row detected for (kpi_key=''' || kpi_key || ''', period_id=''' || period_id || '''). Only one row per metric per period allowed.' AS detail
FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, kpi_key, period_id ORDER BY row_seq) AS rn FROM kpi) WHERE rn > 1""")
def _(t: Tables):
    return audit.audit_duplicate(t.kpi)


@query("audit_unknown_metric", """
SELECT submission_id, 'error' AS level, 'unknown_metric' AS "check", kpi_key, 'Metric ''' || kpi_key || ''' is not registered in DIM_METRIC. It will be discarded (not persisted).' AS detail FROM kpi WHERE kpi_key = 'unregistered_kpi'""")
def _(t: Tables):
    return audit.audit_unknown_metric(t.kpi)


@query("audit_bucket_mismatch", """
SELECT submission_id, 'error' AS level, 'bucket_mismatch' AS "check", kpi_key, 'Metric ''' || kpi_key || ''' belongs to bucket ''' || metric_bucket || ''' but company ''' || company_id || ''' is classified as ''' || bucket_id || '''. (confidence=' || CAST(confidence AS VARCHAR) || ')' AS detail
FROM parsed WHERE metric_bucket <> 'ALL' AND metric_bucket <> bucket_id AND confidence > 0.95""")
def _(t: Tables):
    return audit.audit_bucket_mismatch(t.kpi.select("submission_id", "kpi_key", "company_id", "bucket_id", "confidence"))


UNIT_CHECK = "CASE WHEN l_partkey % 7 = 0 THEN 'kg' ELSE unit END"


@query("audit_unit", f"""
SELECT submission_id, 'warning' AS level, 'unit_mismatch' AS "check", kpi_key, 'Expected unit ''' || unit_expected || ''' for ''' || kpi_key || ''', got ''' || u || '''.' AS detail
FROM (SELECT *, {UNIT_CHECK} AS u FROM parsed) WHERE unit_expected IS NOT NULL AND NOT contains(replace(replace(replace(u, 'M', ''), 'K', ''), 'B', ''), unit_expected) AND replace(replace(replace(u, 'M', ''), 'K', ''), 'B', '') <> ''
  AND NOT contains(unit_expected, replace(replace(replace(u, 'M', ''), 'K', ''), 'B', ''))""")
def _(t: Tables):
    return audit.audit_unit(t.parsed.select("submission_id", "kpi_key", F.expr(UNIT_CHECK).alias("unit")))


@query("contract_audit", f"""
WITH f AS (
  SELECT submission_id, 'error' AS level, true AS blocking FROM subs WHERE seq % 20 = 3
  UNION ALL SELECT submission_id, 'error', true FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, kpi_key, period_id ORDER BY row_seq) AS rn FROM kpi) WHERE rn > 1
  UNION ALL SELECT submission_id, 'error', true FROM kpi WHERE kpi_key = 'unregistered_kpi'
  UNION ALL SELECT submission_id, 'error', false FROM parsed WHERE metric_bucket <> 'ALL' AND metric_bucket <> bucket_id AND confidence > 0.95
  UNION ALL SELECT submission_id, 'warning', false FROM (SELECT *, {UNIT_CHECK} AS u FROM parsed) WHERE unit_expected IS NOT NULL AND NOT contains(replace(replace(replace(u, 'M', ''), 'K', ''), 'B', ''), unit_expected)
    AND replace(replace(replace(u, 'M', ''), 'K', ''), 'B', '') <> '')
SELECT s.submission_id, s.bucket_id, count(f.level) FILTER (f.level = 'error') = 0 AS passed, count(f.level) FILTER (f.level = 'error') AS errors,
  count(f.level) FILTER (f.level = 'warning') AS warnings, count(f.level) FILTER (f.blocking) AS blocking_errors
FROM subs s LEFT JOIN f ON s.submission_id = f.submission_id GROUP BY 1, 2""")
def _(t: Tables):
    rows = t.parsed.select(
        "id", "row_seq", "submission_id", C("submission_id").alias("contract_id"), "company_id", "bucket_id", "kpi_key",
        "period_id", "confidence", F.expr(UNIT_CHECK).alias("unit"),
    )
    return audit.contract_verdicts(rows, t.subs)


# ---- fidelity -------------------------------------------------------------------------------

def _expected():
    return F.when(C("seq") % 10 == 0, "OTH").otherwise(C("bucket_id"))


def _fidelity_facts(t: Tables):
    return t.parsed.select("id", "submission_id", "kpi_key", "raw_value", "numeric_value", "source_description", "is_valid", "row_seq")


@query("fidelity_identity", """
SELECT submission_id, company_key, in_dim_company, bucket_in_db, bucket_expected, coalesce(bucket_in_db = bucket_expected, false) AS bucket_match, CAST(identity_errors AS INTEGER) AS identity_errors, CAST(identity_warnings AS INTEGER) AS identity_warnings,
  CASE WHEN identity_errors + identity_warnings = 0 THEN 'OK: Identidad verificada — empresa en portafolio oficial con bucket correcto.' ELSE concat_ws('; ',
    CASE WHEN NOT in_dim_company THEN 'ERROR: company_id ''' || company_id || ''' (key=''' || company_key || ''') no encontrado en dim_company.' END,
    CASE WHEN bucket_in_db <> bucket_expected THEN 'ERROR: Bucket mismatch — dim_company tiene ''' || bucket_in_db || ''' pero el registro tiene ''' || bucket_expected || '''.' END,
    CASE WHEN NOT is_latest_version THEN 'WARN: Esta submission no es la version mas reciente (is_latest_version=FALSE).' END,
    CASE WHEN status = 'pending_human_review' THEN 'WARN: Submission marcada como pending_human_review (avg_confidence=' || CAST(avg_confidence AS VARCHAR) || ').' END) END AS findings
FROM identity2""")
def _(t: Tables):
    found = fidelity.fidelity_identity(t.heads, t.dim_company, _expected())
    return found.select(
        "submission_id", "company_key", "in_dim_company", "bucket_in_db", "bucket_expected", "bucket_match",
        "identity_errors", "identity_warnings", F.array_join("identity_findings", "; ").alias("findings"),
    )


@query("fidelity_calculator", "SELECT * FROM calc")
def _(t: Tables):
    return fidelity.fidelity_calculator(_fidelity_facts(t))


@query("fidelity_checklist", """
SELECT f.submission_id, f.bucket_id, array_to_string(missing, ',') AS missing_kpis, len(missing) = 0 AS is_complete,
  CASE WHEN len(missing) = 0 THEN 'Reporte ' || s.label || ' COMPLETO — todos los KPIs criticos presentes: ' || array_to_string(required, ', ') || '.'
       ELSE 'Reporte ' || s.label || ' INCOMPLETO — faltan: ' || array_to_string(missing, ', ') || '.' END AS display_message
FROM fid_check f JOIN sector s ON f.bucket_id = s.bucket_id""")
def _(t: Tables):
    identity = fidelity.fidelity_identity(t.heads, t.dim_company, _expected())
    listed = fidelity.fidelity_checklist(t.parsed, identity)
    return listed.select("submission_id", "bucket_id", F.array_join("missing_kpis", ",").alias("missing_kpis"), "is_complete", "display_message")


REPORT = """
SELECT i.submission_id, i.company_id, len(f.missing) = 0 AS is_complete, c.discrepancies, i.identity_errors + c.calc_errors AS errors,
  i.identity_warnings + c.calc_warnings + CAST(len(f.missing) > 0 AS INT) AS warnings,
  i.identity_errors + c.calc_errors + i.identity_warnings + c.calc_warnings + CAST(len(f.missing) > 0 AS INT) AS total_findings,
  CASE WHEN i.identity_errors + c.calc_errors > 0 THEN 'FAIL' WHEN i.identity_warnings + c.calc_warnings + CAST(len(f.missing) > 0 AS INT) > 0 THEN 'WARN' ELSE 'PASS' END AS overall_status
FROM identity2 i JOIN fid_check f ON i.submission_id = f.submission_id JOIN calc c ON c.submission_id = i.submission_id"""


def _report(t: Tables, mode: str = "reference"):
    facts = t.parsed.select("submission_id", "kpi_key", "raw_value", "numeric_value", "source_description", "is_valid", "row_seq", "confidence", "period_id")
    return fidelity.fidelity_report(facts, t.latest, t.dim_company, expected=_expected(), mode=mode)


@query("fidelity_report", REPORT)
def _(t: Tables):
    return _report(t)


@query("fidelity_verdict", f"SELECT overall_status, count(*) AS n, CAST(sum(total_findings) AS BIGINT) AS findings FROM ({REPORT}) GROUP BY 1")
def _(t: Tables):
    return _report(t).groupBy("overall_status").agg(F.count(F.lit(1)).alias("n"), F.sum("total_findings").alias("findings"))


# ---- stored tables --------------------------------------------------------------------------

@query("dedup_against_store", """
SELECT i.submission_id, i.file_hash, min(s.submission_id) AS stored_submission_id FROM subs i JOIN subs s ON i.file_hash = s.file_hash AND s.seq % 3 = 0 WHERE i.seq % 3 <> 0 GROUP BY 1, 2""")
def _(t: Tables):
    incoming, stored = t.subs.filter(C("seq") % 3 != 0), t.subs.filter(C("seq") % 3 == 0)
    return store.dedup_against_store(incoming, stored)[1].select("submission_id", "file_hash", "stored_submission_id")


@query("dedup_against_store_new", "SELECT submission_id FROM subs WHERE seq % 3 <> 0 AND file_hash NOT IN (SELECT file_hash FROM subs WHERE seq % 3 = 0)")
def _(t: Tables):
    incoming, stored = t.subs.filter(C("seq") % 3 != 0), t.subs.filter(C("seq") % 3 == 0)
    return store.dedup_against_store(incoming, stored)[0].select("submission_id")


@query("retire_versions", """
SELECT l.submission_id, l.is_latest_version AND n.company_id IS NULL AS is_latest_version
FROM (SELECT *, row_number() OVER (PARTITION BY company_id, period_id ORDER BY submitted_at DESC, submission_id DESC) = 1 AS is_latest_version FROM subs WHERE seq % 4 <> 0) l
LEFT JOIN (SELECT DISTINCT company_id, period_id FROM subs WHERE seq % 4 = 0) n ON l.company_id = n.company_id AND l.period_id = n.period_id""")
def _(t: Tables):
    stored = store.latest_version(t.subs.filter(C("seq") % 4 != 0))
    return store.retire_versions(stored, t.subs.filter(C("seq") % 4 == 0)).select("submission_id", "is_latest_version")


EDITED = """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY submission_id, kpi_key ORDER BY edited_at DESC, value DESC) AS rn FROM edits),
l AS (SELECT a.submission_id, a.kpi_key, a.value AS new_raw, b.value AS before_raw, b.submission_id IS NOT NULL AS twice FROM e a LEFT JOIN e b ON a.submission_id = b.submission_id AND a.kpi_key = b.kpi_key AND b.rn = 2 WHERE a.rn = 1)
SELECT p.id, p.kpi_key, CASE WHEN l.new_raw IS NULL THEN p.raw_value ELSE l.new_raw END AS raw_value,
  CASE WHEN l.new_raw IS NULL THEN p.numeric_value ELSE TRY_CAST(replace(replace(trim(l.new_raw), '$', ''), 'K', '') AS DOUBLE) * 1000 END AS numeric_value,
  CASE WHEN l.new_raw IS NULL THEN p.unit WHEN l.new_raw = 'pending' THEN NULL ELSE '$K' END AS unit, CASE WHEN l.new_raw IS NULL THEN p.is_valid ELSE l.new_raw <> 'pending' END AS is_valid,
  CASE WHEN l.new_raw IS NOT NULL THEN true END AS is_manually_edited, CASE WHEN l.new_raw IS NULL THEN NULL WHEN l.twice THEN l.before_raw ELSE p.raw_value END AS edited_raw_value
FROM parsed p LEFT JOIN l ON p.submission_id = l.submission_id AND p.kpi_key = l.kpi_key"""


@query("apply_kpi_edits", EDITED)
def _(t: Tables):
    facts = t.parsed.select("id", "submission_id", "kpi_key", "raw_value", "numeric_value", "unit", "is_valid")
    return store.apply_kpi_edits(facts, t.edits).drop("edited_at", "submission_id")


@query("update_kpi_value", EDITED)
def _(t: Tables):
    """Facts stored in slots of the submission; the edits rewrite the slots they touch, and the table is read back."""
    path = work_path(t.spark, "facts")
    facts = store.conform(t.parsed, store.FACT_LAYOUT)
    touched.write_slots(facts, path, ["submission_id"], 1)
    touched.edit_facts(path, t.edits, "edits", facts.schema, 1)
    return t.spark.read.parquet(path).select("id", "kpi_key", "raw_value", "numeric_value", "unit", "is_valid", "is_manually_edited", "edited_raw_value")


@query("edits_not_found", """
SELECT submission_id, kpi_key, value FROM edits e WHERE NOT EXISTS (SELECT 1 FROM kpi k WHERE k.submission_id = e.submission_id AND k.kpi_key = e.kpi_key)""")
def _(t: Tables):
    return store.edits_not_found(t.kpi, t.edits).select("submission_id", "kpi_key", "value")


@query("changed_metrics", """
WITH e AS (SELECT submission_id, kpi_key, value, row_number() OVER (PARTITION BY submission_id, kpi_key ORDER BY edited_at DESC, value DESC) AS rn FROM edits)
SELECT e.submission_id, e.kpi_key, f.raw_value AS old_value, e.value AS new_value FROM e LEFT JOIN first_kpi f ON f.submission_id = e.submission_id AND f.kpi_key = e.kpi_key
WHERE e.rn = 1 AND e.value <> coalesce(f.raw_value, '')""")
def _(t: Tables):
    stored = resolve.nearest_rank(t.kpi, ["submission_id", "kpi_key"], [C("row_seq")]).select("submission_id", "kpi_key", C("raw_value").alias("value"))
    edited = store.last_edits(t.edits).select("submission_id", "kpi_key", C("new_raw").alias("value"))
    return store.changed_metrics(stored, edited, ["submission_id", "kpi_key"])


@query("delete_by_hash", """
SELECT submission_id FROM subs s WHERE NOT EXISTS (SELECT 1 FROM subs d WHERE d.seq % 11 = 0 AND d.company_id = s.company_id AND d.file_hash = s.file_hash)""")
def _(t: Tables):
    stored = t.subs.select("submission_id", "seq", C("company_id").alias("company_domain"), "file_hash")
    targets = stored.filter(C("seq") % 11 == 0).select("company_domain", "file_hash")
    return store.delete_by_hash(stored, targets).select("submission_id")


@query("delete_by_hash_count", """
SELECT company_id AS company_domain, file_hash, count(*) AS deleted FROM subs WHERE (company_id, file_hash) IN (SELECT (company_id, file_hash) FROM subs WHERE seq % 11 = 0) GROUP BY ALL""")
def _(t: Tables):
    stored = t.subs.select("seq", C("company_id").alias("company_domain"), "file_hash")
    return store.deleted_counts(stored, stored.filter(C("seq") % 11 == 0).select("company_domain", "file_hash"))


@query("merge_dim", """
SELECT coalesce(s.s_suppkey, p.p_partkey + 3) AS company_key, CASE WHEN p.p_partkey IS NOT NULL THEN p.p_name ELSE s.s_name END AS company_name,
  CASE WHEN p.p_partkey IS NOT NULL THEN p.p_brand ELSE CAST(s.s_nationkey AS VARCHAR) END AS portfolio_id FROM supplier s FULL JOIN part p ON s.s_suppkey = p.p_partkey + 3""")
def _(t: Tables):
    """All parts merged into all suppliers; keys are shifted by three, so that some are new, some replace and some stay."""
    target = t.raw("supplier").select(C("s_suppkey").alias("company_key"), C("s_name").alias("company_name"), C("s_nationkey").cast("string").alias("portfolio_id"))
    source = t.raw("part").select((C("p_partkey") + 3).alias("company_key"), C("p_name").alias("company_name"), C("p_brand").alias("portfolio_id"))
    return store.merge_dim(target, source)


@query("append_rows", "SELECT id, submission_id, kpi_key, numeric_value, CAST(NULL AS BOOLEAN) AS is_manually_edited, confidence FROM parsed UNION ALL SELECT id || 'x', submission_id, kpi_key, numeric_value, NULL, confidence FROM parsed")
def _(t: Tables):
    path = work_path(t.spark, "facts")
    rows = t.parsed.select("id", "submission_id", "kpi_key", "numeric_value", "confidence", "l_partkey")
    store.append_rows(rows, path, store.FACT_LAYOUT)
    store.append_rows(rows.withColumn("id", F.concat("id", F.lit("x"))), path, store.FACT_LAYOUT)
    stored = store.read_or_empty(t.spark, path, store.FACT_LAYOUT)
    return stored.select("id", "submission_id", "kpi_key", "numeric_value", "is_manually_edited", "confidence")


@query("evolve_schema", "SELECT id, submission_id, kpi_key, CAST(NULL AS VARCHAR) AS edited_raw_value, CAST(NULL AS DOUBLE) AS fx_rate FROM parsed")
def _(t: Tables):
    old = t.kpi.select("id", "submission_id", "kpi_key")
    once = store.evolve_schema(old, store.FACT_LAYOUT)
    return store.evolve_schema(once, store.FACT_LAYOUT).select("id", "submission_id", "kpi_key", "edited_raw_value", "fx_rate")


@query("replace_dim", "SELECT company_key, company_name, portfolio_id, portfolio_name, bucket_id FROM dim_company")
def _(t: Tables):
    path = work_path(t.spark, "dim_company")
    store.replace_dim(t.dim_company.limit(0), path)
    store.replace_dim(t.dim_company, path)
    return t.spark.read.parquet(path).drop("updated_at")


@query("truncate_insert_dim", "SELECT bucket_id, count(*) AS companies FROM dim_company GROUP BY 1")
def _(t: Tables):
    path = work_path(t.spark, "dim_company")
    store.replace_dim(t.dim_company, path)
    return t.spark.read.parquet(path).groupBy("bucket_id").agg(F.count(F.lit(1)).alias("companies"))


NAMES = [("cust11", "SAAS"), ("cust2", "LEND")]


@query("infer_period", """
SELECT d.submission_id, 'FY' || coalesce(y.year, CAST(year(d.submitted_at) AS VARCHAR)) AS period_id FROM docset d LEFT JOIN docyear y ON d.submission_id = y.submission_id""")
def _(t: Tables):
    period = documents.document_period(C("doc"), C("raw_json"), F.year("submitted_at"))
    return t.docs.select("submission_id", period.alias("period_id"))


@query("insert_contract", """
WITH ok AS (SELECT d.*, 'FY' || coalesce(y.year, CAST(year(d.submitted_at) AS VARCHAR)) AS per FROM docset d LEFT JOIN docyear y ON d.submission_id = y.submission_id
  WHERE d.file_hash NOT IN (SELECT file_hash FROM subs WHERE seq % 7 = 0)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY submitted_at, submission_id) AS rn FROM ok) WHERE rn = 1)
SELECT submission_id, company_id, per AS period_id, row_number() OVER (PARTITION BY company_id, per ORDER BY submitted_at DESC, submission_id DESC) = 1 AS is_latest_version, portfolio_id FROM one""")
def _(t: Tables):
    return _inserted(t).headers.select("submission_id", "company_id", "period_id", "is_latest_version", "portfolio_id")


def _inserted(t: Tables):
    """The driver's documents inserted into a store that holds every seventh submission."""
    staged = ingest.build_contracts(t.docs, path=work_path(t.spark, "staged"))
    stored = store.latest_version(t.subs.filter(C("seq") % 7 == 0))
    return ingest.insert_contracts(staged, stored, NAMES)


@query("insert_contract_rows", """
WITH ok AS (SELECT * FROM docset WHERE file_hash NOT IN (SELECT file_hash FROM subs WHERE seq % 7 = 0)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY submitted_at, submission_id) AS rn FROM ok) WHERE rn = 1)
SELECT r.submission_id || '-' || r.kpi_key || '-' || r.ordinal AS id, r.submission_id, r.kpi_key, r.numeric_value, CASE WHEN r.numeric_value IS NULL THEN NULL WHEN r.currency = 'USD' THEN 1.0 ELSE x.rate END AS fx_rate
FROM docrows r JOIN one o ON o.submission_id = r.submission_id LEFT JOIN docyear y ON r.submission_id = y.submission_id
LEFT JOIN dim_fx x ON x.currency = r.currency AND x.year = least(greatest(coalesce(CAST(y.year AS INTEGER), CAST(year(r.submitted_at) AS INTEGER)), 2019), 2025)""")
def _(t: Tables):
    """Documents to stored facts: the inserted rows appended to a fact table and read back."""
    path = work_path(t.spark, "facts")
    store.append_rows(_inserted(t).rows, path, store.FACT_LAYOUT)
    stored = store.read_or_empty(t.spark, path, store.FACT_LAYOUT).filter("created_at IS NOT NULL")
    return stored.select("id", "submission_id", "kpi_key", "numeric_value", "fx_rate")


@query("insert_contract_duplicates", """
SELECT d.submission_id, min(s.submission_id) AS stored_submission_id FROM docset d JOIN subs s ON d.file_hash = s.file_hash AND s.seq % 7 = 0 GROUP BY 1""")
def _(t: Tables):
    return _inserted(t).duplicates.select("submission_id", "stored_submission_id")


def _blocked(t: Tables):
    """As ``_inserted``, with a period that the sender got wrong in every twentieth document, which the audit does not let pass."""
    built = ingest.build_contracts(t.docs, path=work_path(t.spark, "staged"))
    wrong = C("submission_id").substr(2, 20).cast("bigint") % 20 == 3
    built.headers = built.headers.withColumn("period_id", F.when(wrong, "2025-Q9").otherwise(C("period_id")))
    return ingest.insert_contracts(built, store.latest_version(t.subs.filter(C("seq") % 7 == 0)), NAMES)


JUDGED = """
b AS (SELECT d.submission_id, d.seq, CASE WHEN contains(replace(replace(replace(lower(d.company_id), '.', ''), '-', ''), '_', ''), 'cust11') THEN 'SAAS'
    WHEN contains(replace(replace(replace(lower(d.company_id), '.', ''), '-', ''), '_', ''), 'cust2') THEN 'LEND' ELSE 'UNKNOWN' END AS bucket FROM docset d),
rejected AS (SELECT b.submission_id, 1 + count(*) FILTER (k.metric_bucket <> 'ALL' AND b.bucket <> 'UNKNOWN' AND k.metric_bucket <> b.bucket AND r.confidence > 0.95) AS errors,
    count(*) FILTER (translate(coalesce(r.unit, ''), 'MKB', '') <> '' AND NOT contains(translate(r.unit, 'MKB', ''), k.unit_expected) AND NOT contains(k.unit_expected, translate(r.unit, 'MKB', ''))) AS warnings, CAST(1 AS BIGINT) AS blocking_errors
  FROM b JOIN docrows r ON r.submission_id = b.submission_id JOIN dim_kpi k ON k.kpi_key = r.kpi_key WHERE b.seq % 20 = 3 GROUP BY 1),
passed AS (SELECT d.*, 'FY' || coalesce(y.year, CAST(year(d.submitted_at) AS VARCHAR)) AS per FROM docset d LEFT JOIN docyear y ON d.submission_id = y.submission_id WHERE d.seq % 20 <> 3),
known AS (SELECT p.submission_id, min(s.submission_id) AS stored_submission_id FROM passed p JOIN subs s ON s.file_hash = p.file_hash AND s.seq % 7 = 0 GROUP BY 1),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY submitted_at, submission_id) AS rn FROM passed WHERE submission_id NOT IN (SELECT submission_id FROM known)) WHERE rn = 1),
old AS (SELECT *, row_number() OVER (PARTITION BY company_id, period_id ORDER BY submitted_at DESC, submission_id DESC) = 1 AS was FROM subs WHERE seq % 7 = 0),
retired AS (SELECT submission_id FROM old WHERE was AND (company_id, period_id) IN (SELECT (company_id, per) FROM fresh))"""


@query("insert_contract_rejected", f"WITH {JUDGED} SELECT * FROM rejected")
def _(t: Tables):
    return _blocked(t).rejected.select("submission_id", "errors", "warnings", "blocking_errors")


@query("insert_contract_retired", f"WITH {JUDGED} SELECT o.submission_id, o.was AND r.submission_id IS NULL AS is_latest_version FROM old o LEFT JOIN retired r ON r.submission_id = o.submission_id")
def _(t: Tables):
    return _blocked(t).retired.select("submission_id", "is_latest_version")


@query("insert_contract_counts", f"""
WITH {JUDGED} SELECT 'submissions' AS name, count(*) AS observed, count(*) AS stored FROM fresh UNION ALL SELECT 'facts', count(*), count(*) FROM fresh f JOIN docrows r ON r.submission_id = f.submission_id
UNION ALL SELECT 'rejected', count(*), count(*) FROM rejected UNION ALL SELECT 'duplicates', count(*), count(*) FROM known UNION ALL SELECT 'retired', count(*), count(*) FROM retired""")
def _(t: Tables):
    """Rows counted while a batch was written, beside those of the tables read back."""
    return _counted(t, ingest.write_batch(_blocked(t), work_path(t.spark, "batch")))


def _counted(t: Tables, loaded):
    """(name, observed, stored) of a loaded batch."""
    observed = t.spark.createDataFrame([(k, n) for k, n in loaded.counts.items()], "name string, observed bigint")
    stored = [t.spark.read.parquet(f"{loaded.root}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("stored")) for name in loaded.counts]
    return observed.join(functools.reduce(lambda a, b: a.union(b), stored), "name")


LATER_CHUNK = ", ".join(f"'{k}'" for k in dims.KPI_KEYS[8:])
DETECTED = [("urgent", "FU"), ("high", "FH")]
FUNDS = [("cust1", "F1"), ("cust22", "F2"), ("cust3", "F3")]


def _ingested(t: Tables):
    """Two chunks a document (KPIs dealt by their key), some malformed or without metrics, ingested into a store that holds every seventh submission."""
    context = F.concat(F.lit('{"_document_context":'), F.to_json(F.struct("currency", F.col("period_id").alias("period"))))
    some = t.subs.select("submission_id", "currency", "period_id", "form")
    parts = {"first": dims.KPI_KEYS[:8], "later": dims.KPI_KEYS[8:]}
    built = some.join(documents.build_documents(t.kpi_by_submission, "submission_id", parts=parts), "submission_id")
    pair = F.inline(F.array(*[F.struct(F.lit(n).alias("chunk_id"), F.col(name).alias("metrics")) for n, name in enumerate(parts)]))
    whole = F.concat(context, F.lit(',"financial_metrics_2025":'), F.col("metrics"), F.lit("}"))
    text = (
        F.when(C("form") == "broken", F.substring(whole, F.lit(1), F.length(whole) - 2)).when(C("form") == "array", "[1, 2]")
        .when(C("form") == "fenced", F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(C("form").isin("no_metrics", "empty"), F.concat(context, F.lit("}"))).otherwise(whole)
    )
    chunks = built.select(*some.columns, pair).select("submission_id", "chunk_id", text.alias("raw_json"))
    uploads = t.subs.select("submission_id", "file_hash", "company_id", "founder_email", "original_filename", "submitted_at")
    stored = store.latest_version(t.subs.filter(C("seq") % 7 == 0))
    return ingest.ingest_chunks(chunks, uploads, stored, work_path(t.spark, "ingested"), DETECTED, FUNDS, NAMES)


INGESTED = f"""
mrows AS (SELECT r.submission_id, r.kpi_key, r.ordinal, r.confidence, CASE WHEN r.is_scalar AND r.kpi_key IN ({LATER_CHUNK}) THEN NULL ELSE r.raw_value END AS raw_value,
    CASE WHEN r.is_scalar AND r.kpi_key IN ({LATER_CHUNK}) THEN NULL ELSE r.numeric_value END AS numeric_value, r.is_scalar FROM docrows r),
gate AS (SELECT submission_id, coalesce(bool_or(NOT is_scalar AND kpi_key IN ({", ".join(f"'{k}'" for k in dims.CORE_FINANCIAL_KPIS)}) AND lower(trim(raw_value)) NOT IN ('', 'null', 'n/a', '--', '0', 'none')), false) AS financial FROM mrows GROUP BY 1),
placed AS (SELECT d.submission_id, d.file_hash, d.submitted_at, d.seq, CASE WHEN contains(lower(d.original_filename), 'urgent') THEN 'urgent' WHEN contains(lower(d.original_filename), 'high') THEN 'high' ELSE d.company_id END AS company_id,
    CASE WHEN contains(lower(d.original_filename), 'urgent') THEN 'FU' WHEN contains(lower(d.original_filename), 'high') THEN 'FH'
      WHEN contains(translate(lower(d.company_id), '.-_', ''), 'cust1') THEN 'F1' WHEN contains(translate(lower(d.company_id), '.-_', ''), 'cust22') THEN 'F2' WHEN contains(translate(lower(d.company_id), '.-_', ''), 'cust3') THEN 'F3' ELSE 'unknown' END AS portfolio_id
  FROM docset d JOIN gate g ON g.submission_id = d.submission_id AND g.financial),
known AS (SELECT p.submission_id FROM placed p JOIN subs s ON s.file_hash = p.file_hash AND s.seq % 7 = 0 GROUP BY 1),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY submitted_at, submission_id) AS rn FROM placed WHERE submission_id NOT IN (SELECT submission_id FROM known)) WHERE rn = 1)"""


@query("ingest_chunks", f"WITH {INGESTED} SELECT f.submission_id, f.company_id, f.portfolio_id, m.kpi_key, m.raw_value, m.numeric_value FROM fresh f JOIN mrows m ON m.submission_id = f.submission_id")
def _(t: Tables):
    """Chunks to stored submissions and facts, read back."""
    root = _ingested(t).root
    heads = store.read_or_empty(t.spark, f"{root}/submissions", store.SUBMISSIONS_LAYOUT).select("submission_id", "company_id", "portfolio_id")
    facts = store.read_or_empty(t.spark, f"{root}/facts", store.FACT_LAYOUT).select("submission_id", "kpi_key", "raw_value", "numeric_value")
    return heads.join(facts, "submission_id")


@query("ingest_chunks_quarantine", f"""
WITH {INGESTED} SELECT s.submission_id, 'decode' AS stage, 'chunk ' || c.n || ': ' || CASE WHEN s.form = 'broken' THEN 'json_error' ELSE 'not_object' END AS reason
FROM subs s, (SELECT unnest([0, 1]) AS n) c WHERE s.form IN ('broken', 'array') AND s.submission_id IN (SELECT submission_id FROM kpi)
UNION ALL SELECT submission_id, 'gate', 'not_financial' FROM gate WHERE NOT financial""")
def _(t: Tables):
    return t.spark.read.parquet(f"{_ingested(t).root}/quarantine").select("submission_id", C("stage").cast("string").alias("stage"), "reason")


@query("ingest_chunks_vault", f"""
WITH {INGESTED} SELECT p.company_id AS company_domain, p.file_hash, p.portfolio_id, m.raw_value AS revenue FROM placed p JOIN mrows m ON m.submission_id = p.submission_id AND m.kpi_key = 'revenue'""")
def _(t: Tables):
    """The vault that ingestion fills, read as documents."""
    stored = documents.decoded_only(t.spark.read.parquet(f"{_ingested(t).root}/vault"))
    rows = documents.explode_kpis(stored, "doc", ["company_domain", "file_hash", "portfolio_id"]).filter("kpi_key = 'revenue'")
    return rows.select("company_domain", "file_hash", "portfolio_id", C("raw_value").alias("revenue"))


@query("ingest_chunks_counts", f"""
WITH {INGESTED}, q AS (SELECT 2 * count(*) AS n FROM subs WHERE form IN ('broken', 'array') AND submission_id IN (SELECT submission_id FROM kpi))
SELECT 'submissions' AS name, count(*) AS observed, count(*) AS stored FROM fresh UNION ALL SELECT 'facts', 16 * count(*), 16 * count(*) FROM fresh UNION ALL SELECT 'duplicates', count(*), count(*) FROM known
UNION ALL SELECT 'quarantine', (SELECT n FROM q) + count(*), (SELECT n FROM q) + count(*) FROM gate WHERE NOT financial
UNION ALL SELECT 'checklist', count(*), count(*) FROM placed UNION ALL SELECT 'vault', count(*), count(*) FROM placed UNION ALL SELECT 'rejected', 0, 0""")
def _(t: Tables):
    return _counted(t, _ingested(t)).filter("name <> 'retired'")


@query("manual_entry_documents", """
WITH w AS (SELECT c_custkey, 'cust' || c_custkey AS company_id, 'FY' || (2021 + c_custkey % 5) AS period_id,
    substr(sha256('cust' || c_custkey || ':FY' || (2021 + c_custkey % 5) || ':' || c_custkey), 1, 16) AS file_hash FROM customer),
v AS (SELECT w.*, CAST(c.c_acctbal AS VARCHAR) AS rev, CAST(c.c_custkey AS VARCHAR) AS cac, k.kpi_key, k.unit_expected, k.ordinal, CASE k.kpi_key WHEN 'revenue' THEN CAST(c.c_acctbal AS VARCHAR) WHEN 'cac' THEN CAST(c.c_custkey AS VARCHAR) WHEN 'churn_rate' THEN CAST(c.c_nationkey AS VARCHAR) || '%' END AS raw_value
  FROM w JOIN customer c USING (c_custkey), dim_kpi k)
SELECT 'M' || file_hash || '-' || kpi_key || '-' || ordinal AS id, kpi_key, 'FY' || coalesce(nullif(regexp_extract(rev, '\\b(20[0-9][0-9])\\b', 1), ''), nullif(regexp_extract(cac, '\\b(20[0-9][0-9])\\b', 1), ''), '2025') AS period_id, raw_value, CAST(replace(raw_value, '%', '') AS DOUBLE) AS numeric_value, raw_value IS NOT NULL AS is_valid, CAST(1 AS DOUBLE) AS confidence,
  'Entrada manual del Analista' AS source_description, 'USD' AS original_currency, CASE WHEN raw_value IS NOT NULL THEN CAST(1 AS DOUBLE) END AS fx_rate FROM v""")
def _(t: Tables):
    """Analysts' entries, one wide row a customer, as documents: through contracts, audit and insert to stored facts.

    Their period is inferred like that of any document (a year in the text, else that of the entry)."""
    given = {"revenue": C("c_acctbal"), "cac": C("c_custkey"), "churn_rate": F.concat(C("c_nationkey").cast("string"), F.lit("%"))}
    # a small file is one task, and each customer becomes 16 rows: dealt out first
    customers = t.raw("customer").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    wide = customers.select(
        "c_custkey", F.concat(F.lit("cust"), C("c_custkey").cast("string")).alias("company_id"), F.concat(F.lit("FY"), (C("c_custkey") % 5 + 2021).cast("string")).alias("period_id"),
        F.lit(None).cast("string").alias("founder_email"), F.lit("VII").alias("portfolio_id"), F.lit("2025-06-30").cast("timestamp_ntz").alias("submitted_at"),
        *[given.get(k, F.lit("  ")).alias(k) for k in dims.KPI_KEYS],
    )
    built = ingest.build_contracts(documents.manual_documents(wide, C("c_custkey").cast("string")), path=work_path(t.spark, "staged"))
    stored = t.spark.createDataFrame([], store.layout_schema(store.SUBMISSIONS_LAYOUT))
    path = work_path(t.spark, "facts")
    store.append_rows(ingest.insert_contracts(built, stored).rows, path, store.FACT_LAYOUT)
    facts = store.read_or_empty(t.spark, path, store.FACT_LAYOUT)
    return facts.select("id", "kpi_key", "period_id", "raw_value", "numeric_value", "is_valid", "confidence", "source_description", "original_currency", "fx_rate")


@query("quarantine_documents", """
SELECT submission_id, CASE WHEN form = 'broken' THEN 'json_error' ELSE 'not_object' END AS reason FROM subs
WHERE form IN ('broken', 'array') AND submission_id IN (SELECT submission_id FROM kpi)""")
def _(t: Tables):
    return documents.quarantine(t.raw_docs, fenced=True).select("submission_id", "reason")


# ---- sources and sinks ----------------------------------------------------------------------

@query("scan_csv", """
SELECT p_partkey, p_name, p_size, p_retailprice FROM part""")
def _(t: Tables):
    path = work_path(t.spark, "csv")
    parts = t.raw("part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    parts.repartition(8, "p_partkey").write.option("header", True).csv(path)
    rows = files.scan_csv(t.spark, path, "p_partkey bigint, p_name string, p_size int, p_retailprice double")
    return rows.select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("scan_csv_uncapped", "SELECT p_partkey, p_name FROM part")
def _(t: Tables):
    path = work_path(t.spark, "csv")
    t.raw("part").select("p_partkey", "p_name").write.option("header", True).csv(path)
    return files.scan_csv(t.spark, path, "p_partkey bigint, p_name string", limit=None).select("p_partkey", "p_name")


@query("scan_parquet", "SELECT c_custkey AS key, 'customer' AS src FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def _(t: Tables):
    def rows_of(name: str, key: str):
        rows = files.scan_parquet(t.spark, f"{t.sf_dir}/{name}.parquet")
        return rows.select(C(key).alias("key"), F.lit(name).alias("src"))

    return rows_of("customer", "c_custkey").unionByName(rows_of("supplier", "s_suppkey"))


def _vault(t: Tables) -> str:
    """All raw documents written as a result vault; the path."""
    path = work_path(t.spark, "vault")
    results = t.raw_docs.select(
        "file_hash", C("portfolio_id").alias("company_domain"), "submission_id", "raw_json", "original_filename", "founder_email",
        F.when(C("seq") % 6 != 0, C("portfolio_id")).alias("portfolio_id"), "processed_at",
    )
    vault.write_result_vault(results, path)
    return path


@query("write_result_vault", "SELECT portfolio_id AS company_domain, count(*) AS results FROM subs WHERE submission_id IN (SELECT submission_id FROM kpi) GROUP BY 1")
def _(t: Tables):
    return t.spark.read.parquet(_vault(t)).groupBy("company_domain").agg(F.count(F.lit(1)).alias("results"))


@query("scan_result_vault", """
SELECT file_hash || '_result' AS id, portfolio_id AS company_domain, coalesce(founder_email, 'unknown') AS founder_email, coalesce(processed_at, 'unknown') AS date,
  CASE WHEN seq % 6 <> 0 THEN portfolio_id ELSE 'unknown' END AS portfolio_id FROM docset WHERE form <> 'fenced'""")
def _(t: Tables):
    return vault.scan_result_vault(t.spark, _vault(t)).select("id", "company_domain", "founder_email", "date", "portfolio_id")


@query("vault_partition_scan", "SELECT file_hash FROM docset WHERE form <> 'fenced' AND portfolio_id = 'EUROPE'")
def _(t: Tables):
    return vault.scan_result_vault(t.spark, _vault(t), "EUROPE").select("file_hash")


@query("result_by_hash", """
SELECT file_hash, submission_id, kpis FROM (
  SELECT s.file_hash, s.submission_id, count(DISTINCT k.kpi_key) AS kpis, s.portfolio_id, s.original_filename FROM subs s JOIN kpi k ON k.submission_id = s.submission_id
  WHERE s.file_hash = (SELECT min(file_hash) FROM subs WHERE submission_id IN (SELECT submission_id FROM kpi)) GROUP BY ALL ORDER BY s.portfolio_id, s.original_filename LIMIT 1)""")
def _(t: Tables):
    """The document stored under the smallest hash, looked up by a scalar subquery and read as a document."""
    path = work_path(t.spark, "vault")
    named = t.kpi.groupBy("submission_id").agg(F.count_distinct("kpi_key").alias("n"))
    results = t.subs.join(named, "submission_id").select("file_hash", C("portfolio_id").alias("company_domain"), "submission_id", "original_filename", F.to_json(F.struct("n")).alias("raw_json"))
    vault.write_result_vault(results, path)
    stored = t.spark.read.parquet(path)
    found = vault.result_by_hash(stored, stored.select(F.min("file_hash")).scalar())
    return documents.decoded_only(found).select("file_hash", "submission_id", documents.dig(C("doc"), ["n"], "bigint").alias("kpis"))


@query("copy_to_vault", """
WITH st AS (SELECT portfolio_id AS company_domain, file_hash, submission_id, original_filename FROM subs WHERE seq % 2 = 0), inc AS (SELECT company_id AS company_domain, file_hash, min(founder_email) AS founder_email FROM subs GROUP BY 1, 2),
src AS (SELECT file_hash, min(company_domain) AS first_company FROM st GROUP BY 1)
SELECT company_domain, file_hash, NULL AS founder_email, NULL AS copied_from_general, count(*) AS results FROM st GROUP BY 1, 2
UNION ALL SELECT i.company_domain, i.file_hash, i.founder_email, true, 1 FROM inc i JOIN src USING (file_hash)""")
def _(t: Tables):
    """Half of the submissions stored by region; what companies sent is copied into their slots, and the whole vault read back."""
    path = work_path(t.spark, "vault")
    stored = t.subs.filter(C("seq") % 2 == 0).select(
        C("portfolio_id").alias("company_domain"), "file_hash", "original_filename", F.lit("{}").alias("raw_json"))
    vault.write_result_vault(stored, path, ingest.VAULT_DIGITS)
    vault.copy_to_vault(t.subs.select(C("company_id").alias("company_domain"), "file_hash", "founder_email"), path)
    read = t.spark.read.option("mergeSchema", True).parquet(path)
    return read.groupBy("company_domain", "file_hash", "founder_email", "copied_from_general").agg(F.count(F.lit(1)).alias("results"))


SUPPLIER_FORM = "CASE s_suppkey % 10 WHEN 3 THEN 'broken' WHEN 5 THEN 'array' WHEN 7 THEN 'double' ELSE 'plain' END"


def _json_vault(t: Tables) -> str:
    """One .json file for each supplier, in the directory of its nation; the path. Some are cut off, no object, or encoded twice."""
    root = work_path(t.spark, "json vault")
    rows = t.raw("supplier").join(t.raw("nation"), C("s_nationkey") == C("n_nationkey"))
    node = F.struct(C("s_acctbal").cast("string").alias("value"), F.lit(0.9).alias("confidence"))
    whole = F.to_json(F.struct(F.struct(F.struct(node.alias("revenue")).alias("base_metrics")).alias(dims.ROOT), C("s_name").alias("name")))
    form = F.expr(SUPPLIER_FORM)
    text = F.when(form == "broken", F.substring(whole, F.lit(1), F.length(whole) - 3)).when(form == "array", "[1, 2]").when(form == "double", documents.json_string(whole)).otherwise(whole)
    results = rows.select(C("n_name").alias("company_domain"), F.concat(C("s_name"), F.lit(" 100%+_result")).alias("id"), text.alias("raw_json"))
    vault.write_json_files(results, root)
    return root


JSON_ITEMS = f"""
SELECT s_name || ' 100%+_result' AS id, n_name AS company_domain, CAST(s_acctbal AS DOUBLE) AS revenue FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE {SUPPLIER_FORM} IN ('plain', 'double')"""


def _items(found):
    value = documents.dig(C("doc"), [dims.ROOT, "base_metrics", "revenue", "value"], "string").cast("double")
    return found.select("id", "company_domain", value.alias("revenue"))


@query("scan_json_files", JSON_ITEMS)
def _(t: Tables):
    return _items(vault.scan_json_files(t.spark, _json_vault(t)))


@query("scan_json_company", JSON_ITEMS + " AND n_name = 'NATION_19'")
def _(t: Tables):
    return _items(vault.scan_json_files(t.spark, _json_vault(t), "NATION_19"))


@query("scan_json_quarantine", f"""
SELECT s_name || ' 100%+_result' AS id, n_name AS company_domain, n_name || '/' || s_name || ' 100%+_result.json' AS path, CASE {SUPPLIER_FORM} WHEN 'broken' THEN 'json_error' ELSE 'not_object' END AS reason
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE {SUPPLIER_FORM} IN ('broken', 'array')""")
def _(t: Tables):
    found = vault.scan_json_quarantine(t.spark, _json_vault(t))
    return found.select("id", "company_domain", F.regexp_replace("gcs_path", "^[^/]*/", "").alias("path"), "reason")


@query("stream_json_files", JSON_ITEMS)
def _(t: Tables):
    """The same files as they arrive: decoded by a stream and stored."""
    sink, checkpoint = work_path(t.spark, "items"), work_path(t.spark, "checkpoint")
    arriving = vault.json_texts(t.spark, _json_vault(t), stream=True)
    rows = _items(documents.decoded_only(arriving, "value"))
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(sink)


@query("audit_vault_files", """
WITH n AS (SELECT s.submission_id, s.form, count(DISTINCT r.section) FILTER (r.has_node AND r.section IN ('revenue_growth', 'profit_margins', 'cash_flow_indicators', 'debt_ratios')) AS secs, count(*) FILTER (r.has_node) AS nodes
  FROM subs s LEFT JOIN docrows r ON s.submission_id = r.submission_id WHERE s.submission_id IN (SELECT submission_id FROM kpi) GROUP BY 1, 2)
SELECT submission_id, CASE WHEN form IN ('broken', 'fenced') THEN 'json_error' WHEN form = 'array' THEN 'not_object' WHEN form = 'no_metrics' THEN 'missing_metrics'
  WHEN form = 'empty' OR nodes = 0 THEN 'empty_metrics' WHEN secs < 2 THEN 'insufficient_metrics' ELSE 'valid' END AS file_status FROM n""")
def _(t: Tables):
    return vault.audit_vault_files(t.raw_docs).select("submission_id", "file_status")


@query("audit_vault_counts", """
WITH n AS (SELECT s.submission_id, s.form, count(DISTINCT r.section) FILTER (r.has_node AND r.section IN ('revenue_growth', 'profit_margins', 'cash_flow_indicators', 'debt_ratios')) AS secs, count(*) FILTER (r.has_node) AS nodes
  FROM subs s LEFT JOIN docrows r ON s.submission_id = r.submission_id WHERE s.submission_id IN (SELECT submission_id FROM kpi) GROUP BY 1, 2)
SELECT CASE WHEN form IN ('broken', 'fenced') THEN 'json_error' WHEN form = 'array' THEN 'not_object' WHEN form = 'no_metrics' THEN 'missing_metrics'
  WHEN form = 'empty' OR nodes = 0 THEN 'empty_metrics' WHEN secs < 2 THEN 'insufficient_metrics' ELSE 'valid' END AS file_status, count(*) AS files FROM n GROUP BY 1""")
def _(t: Tables):
    return vault.vault_file_counts(vault.audit_vault_files(t.raw_docs))


@query("load_kpi_catalog", """
SELECT 'Co' || (p_partkey // 40) AS company, CAST(p_partkey % 40 + 1 AS INTEGER) AS position, p_name AS legacy_kpi, p_type AS target_kpi, CAST(p_size AS VARCHAR) AS audit_logic FROM part""")
def _(t: Tables):
    """Catalogues of 40 rules per company written from the parts, in both shapes, and read back."""
    group = F.floor(C("p_partkey") / 40)
    rules = t.raw("part").select(group.alias("g"), "p_partkey", F.struct(
        C("p_name").alias("legacy_kpi"), C("p_type").alias("target_kpi"), C("p_size").cast("string").alias("audit_logic")).alias("rule"))
    listed = rules.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "rule"))).alias("l"))

    def column(name: str):
        return F.transform("l", lambda r: r["rule"][name])

    arrays = F.struct(
        column("legacy_kpi").alias("legacy_kpis"), column("target_kpi").alias("target_kpis"), column("audit_logic").alias("audit_logic")
    )
    body = F.when(C("g") % 2 == 0, F.to_json(F.transform("l", lambda r: r["rule"]))).otherwise(F.to_json(arrays))
    company = documents.json_string(F.concat(F.lit("Co"), C("g").cast("string")))
    path = work_path(t.spark, "catalog")
    listed.select(F.concat(F.lit("{"), company, F.lit(":"), body, F.lit("}")).alias("value")).write.text(path)
    return catalog.catalog_from_json(t.spark, path, whole_file=False)


@query("load_kpi_catalog_csv", """
SELECT 'Co "' || (p_partkey // 40) || '"' AS company, CAST(row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) AS INTEGER) AS position,
  CASE WHEN p_partkey % 3 = 0 THEN p_name || chr(10) || 'second "line", end' ELSE p_name END AS legacy_kpi, p_type AS target_kpi, CAST(p_size AS VARCHAR) AS audit_logic FROM part""")
def _(t: Tables):
    """Sheets of 25 companies of 40 rules, a company named on its first row only, cells with line breaks and quotes."""
    path = work_path(t.spark, "sheets")
    group = F.floor(C("p_partkey") / 40)
    first = F.lag(group).over(Window.partitionBy("sheet").orderBy("p_partkey"))
    named = F.concat(F.lit('Co "'), group.cast("string"), F.lit('"'))
    lines = F.when(C("p_partkey") % 3 == 0, F.concat(C("p_name"), F.lit('\nsecond "line", end'))).otherwise(C("p_name"))
    rows = t.raw("part").withColumn("sheet", F.floor(C("p_partkey") / 1000)).select(
        "sheet", "p_partkey", F.when(first.isNull() | (first != group), named).alias("company"), lines.alias("legacy_kpi"), C("p_type").alias("target_kpi"),
        C("p_size").cast("string").alias("audit_logic"), F.lit(None).cast("string").alias("note"),
    )
    in_order = rows.repartition("sheet").sortWithinPartitions("sheet", "p_partkey").drop("p_partkey")
    in_order.write.option("header", True).option("escape", '"').partitionBy("sheet").csv(path)
    return catalog.catalog_from_csv(t.spark, path)


# ---- streaming ------------------------------------------------------------------------------

@query("stream_ingest_results", "SELECT submission_id, kpi_key, raw_value, numeric_value, is_valid FROM docrows WHERE form <> 'fenced'")
def _(t: Tables):
    source, sink, checkpoint = (work_path(t.spark, n) for n in ("arriving", "rows", "checkpoint"))
    # four micro-batches of four files, whose small row groups let all cores share a file
    t.raw_docs.select("submission_id", "raw_json").repartition(16, "submission_id").write.option("parquet.block.size", 4 << 20).parquet(source)
    arriving = t.spark.readStream.schema("submission_id string, raw_json string").option("maxFilesPerTrigger", 4).parquet(source)
    rows = streams.stream_ingest_results(arriving)
    done = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()
    return t.spark.read.parquet(sink).select("submission_id", "kpi_key", "raw_value", "numeric_value", "is_valid")


ARRIVING = "submission_id string, file_hash string, company_id string, period_id string, submitted_at timestamp_ntz"


def _wave(t: Tables):
    """Submissions with the wave they arrive in."""
    return t.subs.select("submission_id", "seq", "file_hash", "company_id", "period_id", "submitted_at", (C("seq") % 4).alias("wave"))


def _in_waves(t: Tables, arriving, start) -> None:
    """Each wave's files put into the source folder, then ``start(stream)`` run until they are read: a micro-batch a wave."""
    source = work_path(t.spark, "arriving")
    names = [part.split(" ")[0] for part in ARRIVING.split(", ")]
    for wave in range(4):
        arriving.filter(C("wave") == wave).select(*names).write.mode("append").parquet(source)
        start(t.spark.readStream.schema(ARRIVING).parquet(source)).awaitTermination()


@query("stream_dedup_hash", """
SELECT submission_id, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY seq % 4, submitted_at, submission_id) AS rn FROM subs) WHERE rn = 1""")
def _(t: Tables):
    """Four waves; every fifth submission is delivered again in the next wave, and copies come as late as they like."""
    path, checkpoint = work_path(t.spark, "hashes"), work_path(t.spark, "checkpoint")
    waves = _wave(t)
    again = waves.filter((C("seq") % 5 == 0) & (C("wave") < 3)).withColumn("wave", C("wave") + 1)
    _in_waves(t, waves.union(again), lambda stream: streams.stream_dedup_hash(stream, path, checkpoint, digits=1))
    return t.spark.read.parquet(path).select("submission_id", "file_hash")


@query("stream_dedup_watermark", """
WITH w AS (SELECT *, CASE WHEN seq % 10 = 3 THEN 3 ELSE (year(submitted_at) - 1995) // 2 END AS wave FROM subs),
m AS (SELECT wave, max(submitted_at) AS top FROM w GROUP BY 1),
marks AS (SELECT a.wave, max(b.top) - INTERVAL 400 DAY AS mark FROM m a LEFT JOIN m b ON b.wave < a.wave GROUP BY 1)
SELECT DISTINCT file_hash FROM w JOIN marks USING (wave) WHERE mark IS NULL OR submitted_at > mark""")
def _(t: Tables):
    """Duplicates dropped by the state of the stream alone, two years a wave; a tenth of the rows comes in the last one, most of them too late."""
    path, checkpoint = work_path(t.spark, "hashes"), work_path(t.spark, "checkpoint")
    waves = _wave(t).withColumn("wave", F.when(C("seq") % 10 == 3, 3).otherwise(F.floor((F.year("submitted_at") - 1995) / 2)))

    def start(stream):
        arriving = stream.select("file_hash", C("submitted_at").cast("timestamp").alias("submitted_at"))
        unique = streams.dedup_within_watermark(arriving, "400 days")
        return unique.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    _in_waves(t, waves, start)
    return t.spark.read.parquet(path).select("file_hash")


@query("stream_upsert_latest", "SELECT submission_id, company_id, period_id, is_latest_version FROM latest")
def _(t: Tables):
    path, checkpoint = work_path(t.spark, "submissions"), work_path(t.spark, "checkpoint")
    _in_waves(t, _wave(t), lambda stream: streams.stream_upsert_latest(stream, path, checkpoint, 1))
    return touched.read_latest(t.spark, path).select("submission_id", "company_id", "period_id", "is_latest_version")


@query("upsert_latest_waves", """
SELECT w.wave, s.submission_id, row_number() OVER (PARTITION BY w.wave, s.company_id, s.period_id ORDER BY s.submitted_at DESC, s.submission_id DESC) = 1 AS is_latest_version
FROM (SELECT DISTINCT seq % 4 AS wave FROM subs) w JOIN subs s ON s.seq % 4 <= w.wave""")
def _(t: Tables):
    """The stored flags after each wave; the second wave is repeated, as after a failure."""
    path, after = work_path(t.spark, "submissions"), work_path(t.spark, "after")
    for wave in (0, 1, 1, 2, 3):
        touched.upsert_latest(path, _wave(t).filter(C("wave") == wave).drop("wave", "seq"), wave, 1)
        touched.read_latest(t.spark, path).write.mode("overwrite").parquet(f"{after}/wave={wave}")
    return t.spark.read.parquet(after).select(C("wave").cast("bigint").alias("wave"), "submission_id", "is_latest_version")


LAST_DAY = "submitted_at = (SELECT max(submitted_at) FROM subs)"


@query("upsert_touched_slots", f"""
WITH s AS (SELECT *, left(md5(company_id || '|' || period_id), 2) AS slot, {LAST_DAY} AS late FROM subs)
SELECT slot, count(*) AS rows, bool_or(late) AS rewritten FROM s GROUP BY 1""")
def _(t: Tables):
    """All submissions but those of the last day are stored, then the last day arrives: which slots have other files than before."""
    path, listed = work_path(t.spark, "submissions"), work_path(t.spark, "files")
    subs = t.subs.select("submission_id", "company_id", "period_id", "submitted_at")
    late = subs.agg(F.max("submitted_at").alias("day"))
    touched.upsert_latest(path, subs.join(late, C("submitted_at") < C("day"), "left_semi"), "first")
    touched.slot_files(t.spark, path).write.parquet(listed)
    touched.upsert_latest(path, subs.join(late, C("submitted_at") == C("day"), "left_semi"), "last")
    before = t.spark.read.schema("slot string, file string").parquet(listed).withColumn("known", F.lit(True))
    now = touched.slot_files(t.spark, path).join(before, ["slot", "file"], "left")
    return now.groupBy("slot").agg(F.sum("rows").alias("rows"), F.bool_or(C("known").isNull()).alias("rewritten"))
