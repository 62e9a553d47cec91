"""Documents, joins, aggregates, windows and top-k over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ledgerloom import dims
from ledgerloom.functions import text, values
from ledgerloom.operators import analytics, audit, contract, documents, fidelity, names, resolve, store
from ledgerloom.operators.skew import written
from ledgerloom.plans.fixtures import FX_BUCKETS, FX_COMPANIES, FX_NAMES, Tables
from ledgerloom.plans.oracles import exact_avg
from ledgerloom.plans.registry import query
from ledgerloom.sources import files

C = F.col


# ---- documents ------------------------------------------------------------------------------

@query("explode_kpis", """
SELECT submission_id, ordinal, kpi_key, kpi_label, raw_value, numeric_value, unit, is_valid, confidence, source_description,
  CASE WHEN is_scalar THEN 'KPI ''' || kpi_key || ''' node is not a dict: str' END AS node_warning FROM docrows""")
def _(t: Tables):
    return documents.explode_kpis(t.docs, "doc", ["submission_id"])


@query("ensure_sections", """
SELECT submission_id, concat_ws(',', CASE WHEN NOT bool_or(has_node AND section = 'revenue_growth') THEN 'revenue_growth' END,
  CASE WHEN NOT bool_or(has_node AND section = 'profit_margins') THEN 'profit_margins' END, CASE WHEN NOT bool_or(has_node AND section = 'cash_flow_indicators') THEN 'cash_flow_indicators' END,
  CASE WHEN NOT bool_or(has_node AND section = 'debt_ratios') THEN 'debt_ratios' END, CASE WHEN NOT bool_or(has_node AND section = 'base_metrics') THEN 'base_metrics' END,
  CASE WHEN NOT bool_or(has_node AND section = 'sector_metrics') THEN 'sector_metrics' END) AS missing_sections FROM docrows GROUP BY submission_id""")
def _(t: Tables):
    rows = documents.ensure_sections(t.docs)
    return rows.select("submission_id", F.array_join("missing_sections", ",").alias("missing_sections"))


CORE = ", ".join(f"'{k}'" for k in dims.CORE_FINANCIAL_KPIS)


@query("filter_financial_docs", f"""
SELECT submission_id FROM docrows GROUP BY submission_id
HAVING bool_or(has_node AND NOT is_scalar AND kpi_key IN ({CORE}) AND lower(trim(raw_value)) NOT IN ('', 'null', 'n/a', '--', '0', 'none'))""")
def _(t: Tables):
    return documents.filter_financial_docs(t.docs).select("submission_id")


HEAD = ", ".join(f"'{k}'" for k in dims.HEADLINE_KPIS)


@query("visible_metrics", f"""
SELECT submission_id, kpi_key, raw_value, confidence FROM docrows WHERE kpi_key IN ({HEAD}) AND has_node AND NOT is_scalar
  AND trim(raw_value) NOT IN ('', '0', '--', 'N/A', 'null')""")
def _(t: Tables):
    return documents.visible_metrics(t.docs, keep=["submission_id"])


@query("missing_or_low_conf", f"""
SELECT submission_id, kpi_key, CASE WHEN is_scalar THEN NULL ELSE raw_value END AS raw_value, confidence FROM docrows
WHERE kpi_key IN ({HEAD}) AND (NOT has_node OR is_scalar OR confidence < 0.70)""")
def _(t: Tables):
    return documents.missing_or_low_conf(t.docs, keep=["submission_id"])


@query("patch_document", """
SELECT submission_id, kpi_key, CASE WHEN (seq % 3 = 0 AND kpi_key = 'revenue') OR (seq % 5 = 0 AND kpi_key = 'mrr') THEN '$' || seq || 'K' ELSE raw_value END AS raw_value,
  CASE WHEN (seq % 3 = 0 AND kpi_key = 'revenue') OR (seq % 5 = 0 AND kpi_key = 'mrr') THEN CASE WHEN is_scalar THEN NULL ELSE confidence END ELSE confidence END AS confidence FROM docrows""")
def _(t: Tables):
    docs = written(t.docs.select("submission_id", "seq", "doc"), "docs")  # read three times, built once
    ids = docs.select("submission_id", "seq")
    value = F.concat(F.lit("$"), C("seq").cast("string"), F.lit("K"))
    patches = ids.filter(C("seq") % 3 == 0).select("submission_id", F.lit("revenue").alias("kpi_key"), value.alias("value")).unionByName(
        ids.filter(C("seq") % 5 == 0).select("submission_id", F.lit("mrr").alias("kpi_key"), value.alias("value")))
    patched = documents.patch_document(docs.select("submission_id", "doc"), patches, "submission_id")
    return documents.explode_kpis(patched, "doc", ["submission_id"]).select("submission_id", "kpi_key", "raw_value", "confidence")


@query("merge_chunks", """
SELECT doc_id, kpi_key, chunk_id, raw_value, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, kpi_key ORDER BY coalesce(confidence, 0) DESC, chunk_id, seq) AS rn FROM chunks WHERE raw_value IS NOT NULL) WHERE rn = 1""")
def _(t: Tables):
    return documents.merge_chunks(t.chunks).select("doc_id", "kpi_key", "chunk_id", "raw_value", "confidence")


@query("merge_chunk_documents", """
SELECT company_key, kpi_key, raw_value, confidence FROM (
  SELECT s.company_key, r.kpi_key, r.raw_value, r.confidence, r.is_scalar, row_number() OVER (PARTITION BY s.company_key, r.kpi_key
     ORDER BY CASE WHEN r.has_node AND NOT r.is_scalar THEN coalesce(r.confidence, 0) END DESC NULLS LAST, r.seq) AS rn
  FROM docrows r JOIN subs s ON s.submission_id = r.submission_id) WHERE rn = 1""")
def _(t: Tables):
    merged = documents.merge_chunk_documents(t.docs, "company_key", "seq")
    return documents.explode_kpis(documents.decoded_only(merged), "doc", ["company_key"]).select(
        "company_key", "kpi_key", "raw_value", "confidence"
    )


@query("assign_chunks", """
WITH numbered AS (SELECT string_split(url, '/')[4] AS site, row_number() OVER (PARTITION BY string_split(url, '/')[4] ORDER BY page_id) AS page_no FROM pages)
SELECT site, (page_no - 1) // 90 AS block, min(page_no) AS first_page, max(page_no) AS last_page FROM numbered GROUP BY ALL""")
def _(t: Tables):
    pages = t.raw("pages").select(F.get(F.split("url", "/"), F.lit(3)).alias("site"), "page_id")
    return documents.assign_chunks(pages, "site", "page_id")


@query("assign_chunks_lines", """
WITH numbered AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY k) AS page_no FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS k FROM lineitem GROUP BY ALL))
SELECT l_suppkey, (page_no - 1) // 90 AS block, min(page_no) AS first_page, max(page_no) AS last_page FROM numbered GROUP BY ALL""")
def _(t: Tables):
    lines = t.raw("lineitem").select("l_suppkey", (C("l_orderkey") * 10 + C("l_linenumber")).alias("k")).distinct()
    return documents.assign_chunks(lines, "l_suppkey", "k", bucket_width=50_000)


@query("manual_entry_source", """
SELECT p_partkey, 'revenue' AS kpi_key, CAST(p_retailprice AS VARCHAR) AS raw_value, 1.0::DOUBLE AS confidence, 'Entrada manual del Analista' AS source_description, 'USD' AS original_currency FROM part
UNION ALL SELECT p_partkey, 'cac', CAST(p_size AS VARCHAR), 1.0, 'Entrada manual del Analista', 'USD' FROM part
UNION ALL SELECT p_partkey, k.kpi_key, NULL, 1.0, 'Entrada manual del Analista', 'USD' FROM part, dim_kpi k WHERE k.kpi_key NOT IN ('revenue', 'cac')""")
def _(t: Tables):
    blank = {k: F.lit("  ") for k in dims.KPI_KEYS}
    wide = t.raw("part").select(
        "p_partkey", *[({"revenue": C("p_retailprice"), "cac": C("p_size")}.get(k, blank[k])).alias(k) for k in dims.KPI_KEYS]
    )
    return documents.manual_entry(wide, ["p_partkey"])


# ---- joins ----------------------------------------------------------------------------------

@query("join_fact_submission", "SELECT p.id, p.kpi_key, s.submission_id, s.company_id, s.portfolio_id FROM parsed p JOIN subs s ON p.submission_id = s.submission_id")
def _(t: Tables):
    heads = t.subs.select("submission_id", "company_id", "portfolio_id")
    return resolve.join_fact_submission(t.parsed.select("id", "kpi_key", "submission_id"), heads)


@query("orphan_companies", """
SELECT DISTINCT k.submission_id, k.kpi_key, s.company_key AS company_id, s.portfolio_id FROM kpi k JOIN subs s ON k.submission_id = s.submission_id
LEFT JOIN dim_company d ON s.company_key = d.company_key WHERE d.company_key IS NULL""")
def _(t: Tables):
    heads = t.subs.select("submission_id", C("company_key").alias("company_id"), "portfolio_id")
    return resolve.orphan_companies(t.kpi, heads, t.dim_company)


@query("audit_referential", """
SELECT s.company_key AS company_id, count(DISTINCT k.submission_id || k.kpi_key) AS orphan_rows FROM kpi k JOIN subs s ON k.submission_id = s.submission_id
LEFT JOIN dim_company d ON s.company_key = d.company_key WHERE d.company_key IS NULL GROUP BY 1""")
def _(t: Tables):
    heads = t.subs.select("submission_id", C("company_key").alias("company_id"), "portfolio_id")
    orphans = resolve.orphan_companies(t.kpi, heads, t.dim_company, ordered=False)
    return orphans.groupBy("company_id").agg(F.count(F.lit(1)).alias("orphan_rows"))


@query("orphan_kpi_rows", "SELECT id, submission_id FROM kpi WHERE submission_id NOT IN (SELECT submission_id FROM subs WHERE seq % 9 <> 0)")
def _(t: Tables):
    return resolve.orphan_kpi_rows(t.kpi.select("id", "submission_id"), t.subs.filter(C("seq") % 9 != 0))


@query("normalize_company", """
SELECT s.submission_id, s.company_id, CASE WHEN s.seq % 4 >= 0 AND split_part(s.company_id, '.', 1) LIKE '%-mx' AND d.company_key IS NOT NULL THEN s.company_key
  WHEN split_part(s.company_id, '.', 1) LIKE '%\\_co' ESCAPE '\\' AND d.company_key IS NOT NULL THEN s.company_key
  ELSE replace(replace(split_part(s.company_id, '.', 1), '-', ''), '_', '') END AS company_key
FROM subs s LEFT JOIN dim_company d ON s.company_key = d.company_key""")
def _(t: Tables):
    return resolve.normalize_company(t.subs.select("submission_id", "company_id"), t.dim_company)


@query("lookup_portfolio", """
SELECT s.submission_id, s.company_id, coalesce(arg_min(n.portfolio_id, n.ordinal), 'unknown') AS fund FROM subs s
LEFT JOIN co_names n ON contains(replace(replace(replace(lower(s.company_id), '.', ''), '-', ''), '_', ''), n.name) GROUP BY 1, 2""")
def _(t: Tables):
    return t.subs.select("submission_id", "company_id", resolve.lookup_portfolio(C("company_id"), FX_COMPANIES).alias("fund"))


@query("company_bucket_substr", """
SELECT s.submission_id, s.company_id, coalesce(arg_min(n.bucket_id, n.ordinal), 'UNKNOWN') AS bucket FROM subs s
LEFT JOIN bk_names n ON contains(replace(replace(replace(lower(s.company_id), '.', ''), '-', ''), '_', ''), n.name) GROUP BY 1, 2""")
def _(t: Tables):
    return t.subs.select("submission_id", "company_id", resolve.company_bucket_substr(C("company_id"), FX_BUCKETS).alias("bucket"))


@query("detect_company", """
SELECT d.doc_id, coalesce(arg_min(n.name, 100 * (100 - length(n.name)) + n.ordinal), 'unknown') AS company_key,
       coalesce(arg_min(n.portfolio_id, 100 * (100 - length(n.name)) + n.ordinal), 'unknown') AS portfolio_id
FROM documents d LEFT JOIN names n ON contains(lower(d.text), n.name) OR contains(regexp_replace(lower(d.text), '[^a-z0-9]', '', 'g'), n.name) GROUP BY d.doc_id""")
def _(t: Tables):
    found = t.raw("documents").select("doc_id", resolve.detect_company(C("text"), FX_NAMES).alias("c"))
    return found.select("doc_id", "c.company_key", "c.portfolio_id")


@query("company_label", """
SELECT submission_id, CASE WHEN founder_email IS NULL THEN 'Cust1' WHEN contains(company_key, 'cust1') OR contains('cust1', company_key) THEN 'Cust1' WHEN contains(company_key, 'cust22') OR contains('cust22', company_key) THEN 'Cust22'
   ELSE upper(left(company_key, 1)) || substr(company_key, 2) END AS label FROM subs""")
def _(t: Tables):
    names = ["Cust1", "Cust22"]
    return t.subs.select("submission_id", resolve.company_label(C("founder_email"), C("original_filename"), names).alias("label"))


@query("lookup_portfolio_table", """
WITH ids AS (SELECT DISTINCT company_id FROM subs), f AS (
  SELECT i.company_id, arg_min(d.portfolio_id, d.company_key) AS fund FROM ids i JOIN dim_company d ON contains(replace(replace(replace(lower(i.company_id), '.', ''), '-', ''), '_', ''), d.company_key) GROUP BY 1)
SELECT s.submission_id, coalesce(f.fund, 'unknown') AS fund FROM subs s LEFT JOIN f ON s.company_id = f.company_id""")
def _(t: Tables):
    """The fund look-up against the company table instead of the registry."""
    found = names.lookup_portfolio(t.subs.select("submission_id", "company_id"), _company_names(t), order="name", out="fund")
    return found.select("submission_id", "fund")


def _company_names(t: Tables):
    return t.dim_company.select(C("company_key").alias("name"), "portfolio_id", "bucket_id")


@query("company_bucket_table", """
WITH ids AS (SELECT DISTINCT company_id FROM subs), f AS (
  SELECT i.company_id, arg_min(d.bucket_id, d.company_key) AS bucket FROM ids i JOIN dim_company d ON contains(replace(replace(replace(lower(i.company_id), '.', ''), '-', ''), '_', ''), d.company_key) GROUP BY 1)
SELECT s.submission_id, coalesce(f.bucket, 'UNKNOWN') AS bucket FROM subs s LEFT JOIN f ON s.company_id = f.company_id""")
def _(t: Tables):
    found = names.company_bucket(t.subs.select("submission_id", "company_id"), _company_names(t), order="name", out="bucket")
    return found.select("submission_id", "bucket")


@query("detect_company_table", """
WITH ids AS (SELECT DISTINCT upper(company_id) || ' Board' AS txt FROM subs), f AS (
  SELECT txt, arg_min(d.company_key, lpad(CAST(100 - length(d.company_key) AS VARCHAR), 3, '0') || d.company_key) AS k, arg_min(d.portfolio_id, lpad(CAST(100 - length(d.company_key) AS VARCHAR), 3, '0') || d.company_key) AS p
  FROM ids JOIN dim_company d ON contains(regexp_replace(lower(txt), '[^a-z0-9]', '', 'g'), d.company_key) GROUP BY 1)
SELECT s.submission_id, coalesce(f.k, 'unknown') AS company_key, coalesce(f.p, 'unknown') AS portfolio_id FROM subs s LEFT JOIN f ON upper(s.company_id) || ' Board' = f.txt""")
def _(t: Tables):
    rows = t.subs.select("submission_id", F.concat(F.upper("company_id"), F.lit(" Board")).alias("txt"))
    return names.detect_company(rows, _company_names(t), "txt", "name").drop("txt")


PASSAGE_NAMES = "SELECT DISTINCT lower(substr(text, 1, 16)) AS name, 'P' || CAST(length(text) % 7 AS STRING) AS portfolio_id, item_id AS ordinal FROM {benchmark}"


@query("detect_company_documents", f"""
WITH n AS (SELECT *, regexp_replace(name, '[^a-z0-9]', '', 'g') AS bare FROM ({PASSAGE_NAMES.format(benchmark='benchmark')})),
d AS (SELECT doc_id, lower(text) AS l, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS s, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS p FROM documents),
f AS (SELECT d.doc_id, n.name, n.portfolio_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(n.name) DESC, n.ordinal) AS rn FROM d JOIN n ON contains(d.l, n.name) OR contains(d.s, n.name) OR (n.bare <> '' AND contains(d.p, n.bare)))
SELECT d.doc_id, coalesce(f.name, 'unknown') AS company_key, coalesce(f.portfolio_id, 'unknown') AS portfolio_id FROM d LEFT JOIN f ON f.doc_id = d.doc_id AND f.rn = 1""")
def _(t: Tables):
    """Names of several words (the beginnings of the benchmark passages) looked for in whole documents."""
    listed = t.spark.sql(PASSAGE_NAMES, benchmark=t.raw("benchmark"))
    return names.detect_company(t.raw("documents").select("doc_id", "text"), listed, unique="doc_id").drop("text")


REGISTRY = "(VALUES " + ", ".join(f"('{n}', '{f}', {k})" for k, (n, f) in enumerate(dims.portfolio_names(), 1)) + ") AS r(name, portfolio_id, ordinal)"
REGISTRY_TEXT = """CASE s.seq % 6 WHEN 0 THEN upper(a.name) || '_Q4' WHEN 1 THEN substr(a.name, 1, 2) || '_' || substr(a.name, 3) || ' deck'
  WHEN 2 THEN 'the' || a.name || 's and ' || b.name WHEN 3 THEN 'no company' WHEN 4 THEN a.name || ' ' || b.name ELSE 'x' || b.name || '.com' END"""


@query("detect_company_registry", f"""
WITH r AS (SELECT * FROM {REGISTRY}),
x AS (SELECT s.submission_id, {REGISTRY_TEXT} AS txt FROM subs s JOIN r a ON a.ordinal = s.seq % 30 + 1 JOIN r b ON b.ordinal = s.seq % 7 * 4 + 1),
f AS (SELECT x.submission_id, r.name, r.portfolio_id, row_number() OVER (PARTITION BY x.submission_id ORDER BY length(r.name) DESC, r.ordinal) AS rn FROM x JOIN r ON contains(regexp_replace(lower(x.txt), '[^a-z0-9]', '', 'g'), r.name))
SELECT x.submission_id, coalesce(f.name, 'unknown') AS company_key, coalesce(f.portfolio_id, 'unknown') AS portfolio_id FROM x LEFT JOIN f ON f.submission_id = x.submission_id AND f.rn = 1""")
def _(t: Tables):
    """The whole registry, as a table, in file names that spell companies in several ways."""
    listed = t.spark.sql(f"SELECT * FROM {REGISTRY}")
    rows = t.spark.sql(
        f"SELECT s.submission_id, {REGISTRY_TEXT} AS txt FROM {{subs}} s JOIN {{r}} a ON a.ordinal = s.seq % 30 + 1 JOIN {{r}} b ON b.ordinal = s.seq % 7 * 4 + 1",
        subs=t.subs, r=listed,
    )
    return names.detect_company(rows, listed, "txt", unique="submission_id").drop("txt")


@query("company_label_table", """
WITH n AS (SELECT upper(left(company_key, 1)) || substr(company_key, 2) AS name, company_key AS low FROM dim_company),
c AS (SELECT DISTINCT company_key AS low FROM subs),
f AS (SELECT c.low, min(n.name) AS match FROM c JOIN n ON contains(c.low, n.low) OR contains(n.low, c.low) GROUP BY 1)
SELECT s.submission_id, CASE WHEN s.founder_email IS NULL THEN (SELECT min(name) FROM n) ELSE coalesce(f.match, upper(left(s.company_key, 1)) || substr(s.company_key, 2)) END AS label
FROM subs s LEFT JOIN f ON s.company_key = f.low""")
def _(t: Tables):
    listed = t.dim_company.select(F.concat(F.upper(F.substring("company_key", 1, 1)), F.expr("substr(company_key, 2)")).alias("name"))
    rows = t.subs.select("submission_id", "founder_email", "original_filename")
    return names.company_label(rows, listed, order="name").select("submission_id", "label")


@query("metric_dim_join", "SELECT id, kpi_key, kpi_label AS label, unit_expected, metric_bucket FROM parsed")
def _(t: Tables):
    return resolve.metric_dim_join(t.kpi.select("id", "kpi_key")).select("id", "kpi_key", "label", "unit_expected", "metric_bucket")


@query("bucket_mismatch", """
SELECT id, kpi_key, bucket_id, metric_bucket, confidence FROM parsed WHERE metric_bucket <> 'ALL' AND metric_bucket <> bucket_id AND confidence > 0.95""")
def _(t: Tables):
    rows = resolve.metric_dim_join(t.kpi.select("id", "kpi_key", "bucket_id", "confidence"))
    return resolve.bucket_mismatch(rows).select("id", "kpi_key", "bucket_id", "metric_bucket", "confidence")


@query("dim_identity_join", """
SELECT s.submission_id, s.company_key, d.company_key IS NOT NULL AS in_dim_company, d.bucket_id AS bucket_in_db FROM subs s LEFT JOIN dim_company d ON s.company_key = d.company_key""")
def _(t: Tables):
    return resolve.dim_identity_join(t.subs.select("submission_id", "company_key"), t.dim_company)


CATALOG = """
SELECT 'cust' || CAST(p_partkey AS STRING) AS company, p_name AS legacy_kpi, p_type AS target_kpi, p_brand AS audit_logic
FROM {part} WHERE p_size % 10 <> 0
UNION ALL SELECT 'Standard_KPIs', max(p_name), min(p_type), p_brand || ' ' || CAST(p_size AS STRING) FROM {part} GROUP BY p_brand, p_size"""


@query("catalog_with_default", f"""
WITH cat AS ({CATALOG.format(part='part')}), co AS (SELECT company_key AS company FROM dim_company),
tagged AS (SELECT company, CASE WHEN company IN (SELECT company FROM cat WHERE company <> 'Standard_KPIs') THEN company ELSE 'Standard_KPIs' END AS rule_set FROM co)
SELECT t.company, t.rule_set, c.legacy_kpi, c.target_kpi, c.audit_logic FROM tagged t JOIN cat c ON t.rule_set = c.company""")
def _(t: Tables):
    catalog = t.spark.sql(CATALOG, part=t.raw("part"))
    companies = t.dim_company.select(C("company_key").alias("company"))
    return resolve.catalog_with_default(companies, catalog)


@query("static_dims", """
SELECT k.ordinal, k.kpi_key, k.kpi_label, k.unit_type, k.metric_bucket, count(p.id) AS fact_rows FROM dim_kpi k LEFT JOIN kpi p ON p.kpi_key = k.kpi_key GROUP BY ALL""")
def _(t: Tables):
    used = t.kpi.groupBy("kpi_key").agg(F.count(F.lit(1)).alias("fact_rows"))
    registry = dims.dim_kpi(t.spark).join(dims.dim_metric(t.spark).select("kpi_key", "metric_bucket"), "kpi_key")
    return registry.join(used, "kpi_key", "left").select(
        "ordinal", "kpi_key", "kpi_label", "unit_type", "metric_bucket", F.coalesce("fact_rows", F.lit(0).cast("bigint")).alias("fact_rows")
    )


# ---- aggregates -----------------------------------------------------------------------------

@query("portfolio_analytics", "SELECT * FROM series WHERE portfolio_id = 'EUROPE'")
def _(t: Tables):
    return analytics.portfolio_analytics(t.parsed, t.subs, "EUROPE")


@query("portfolio_analytics_all", "SELECT * FROM series")
def _(t: Tables):
    return analytics.portfolio_analytics(t.parsed, t.subs)


@query("portfolio_summary", """
SELECT CAST(sum(submission_count) AS BIGINT) AS total_submissions, count(DISTINCT company_id) AS companies_count, min(month) AS min_month, max(month) AS max_month FROM series WHERE portfolio_id = 'ASIA'""")
def _(t: Tables):
    return analytics.portfolio_summary(analytics.portfolio_analytics(t.parsed, t.subs, "ASIA", ordered=False))


@query("portfolio_summary_companies", "SELECT DISTINCT company_id FROM series WHERE portfolio_id = 'ASIA'")
def _(t: Tables):
    return analytics.summary_companies(analytics.portfolio_analytics(t.parsed, t.subs, "ASIA", ordered=False))


CHART = ["revenue_growth", "gross_profit_margin", "ebitda_margin"]


@query("company_metric_avg", "SELECT * FROM cavg")
def _(t: Tables):
    return analytics.company_metric_avg(analytics.portfolio_analytics(t.parsed, t.subs, metrics=CHART, ordered=False), CHART)


@query("scaled_bars", """
WITH top AS (SELECT greatest(1.0::DOUBLE, max(abs(revenue_growth)), max(abs(gross_profit_margin)), max(abs(ebitda_margin))) AS m FROM cavg),
long AS (SELECT company_id, 'revenue_growth' AS kpi_key, revenue_growth AS mean FROM cavg UNION ALL SELECT company_id, 'gross_profit_margin', gross_profit_margin FROM cavg UNION ALL SELECT company_id, 'ebitda_margin', ebitda_margin FROM cavg)
SELECT company_id, kpi_key, mean, CASE WHEN mean IS NOT NULL THEN least(abs(mean) / m, 1.0::DOUBLE) * 100 ELSE 100.0 END AS pct, mean < 0 AS is_negative FROM long, top WHERE mean IS NOT NULL""")
def _(t: Tables):
    series = analytics.portfolio_analytics(t.parsed, t.subs, metrics=CHART, ordered=False)
    bars = analytics.scaled_bars(analytics.company_metric_avg(series, CHART), CHART)
    return bars.filter(C("mean").isNotNull())


@query("submission_rollup", "SELECT * FROM rollup2")
def _(t: Tables):
    return contract.submission_rollup(t.parsed)


@query("submission_status", "SELECT status, count(*) AS n FROM rollup2 GROUP BY status")
def _(t: Tables):
    return contract.submission_rollup(t.parsed).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("integrity_warnings", """
SELECT submission_id, kpi_key, warning, count(*) AS n FROM (
  SELECT submission_id, kpi_key, 'KPI ''' || kpi_key || ''' value ''' || raw_value || ''' is not numeric — stored with is_valid=False' AS warning FROM facts WHERE NOT is_valid
  UNION ALL SELECT submission_id, kpi_key, 'KPI ''' || kpi_key || ''': no FX rate for ' || currency || '/' || report_year || ' — normalized_value_usd is null. Add the currency to RATE_TABLE.' FROM facts WHERE is_valid AND currency <> 'USD' AND fx_rate IS NULL
  UNION ALL SELECT submission_id, '*', 'No numeric KPI values were extracted. The document may not contain financial statements in a parseable format.' FROM rollup2 WHERE kpi_count_valid = 0
  UNION ALL SELECT submission_id, '*', 'Average confidence ' || printf('%.2f', avg_confidence) || ' is below threshold 0.85. Submission flagged for human review.' FROM rollup2 WHERE avg_confidence < 0.85
  UNION ALL SELECT submission_id, '*', 'Multiple period_ids detected: {' || string_agg(p, ', ' ORDER BY p) || '}. Check that the document covers a single fiscal year.'
    FROM (SELECT DISTINCT submission_id, CASE WHEN l_partkey % 50 = 7 THEN 'None' WHEN l_partkey % 50 = 8 THEN chr(39) || 'FY' || year(l_shipdate) || chr(39) ELSE chr(39) || period_id || chr(39) END AS p FROM facts)
    GROUP BY submission_id HAVING count(*) > 1) GROUP BY ALL""")
def _(t: Tables):
    """Some rows with another period than their submission, some without one."""
    period = F.when(C("l_partkey") % 50 == 7, None).when(C("l_partkey") % 50 == 8, F.concat(F.lit("FY"), F.year("l_shipdate").cast("string"))).otherwise(C("period_id"))
    found = contract.integrity_warnings(t.facts.withColumn("period_id", period), contract.submission_rollup(t.parsed))
    return found.groupBy("submission_id", "kpi_key", "warning").agg(F.count(F.lit(1)).alias("n"))


@query("period_consistency", "SELECT submission_id, count(DISTINCT year(l_shipdate)) <= 1 AS period_consistent FROM kpi GROUP BY submission_id")
def _(t: Tables):
    rows = t.kpi.select("submission_id", F.year("l_shipdate").cast("string").alias("period_id"))
    return contract.period_consistency(rows)


@query("bucket_counts", """
SELECT portfolio_id, portfolio_name, count(*) AS total_companies, count(*) FILTER (bucket_id = 'SAAS') AS saas, count(*) FILTER (bucket_id = 'LEND') AS lend,
  count(*) FILTER (bucket_id = 'ECOM') AS ecom, count(*) FILTER (bucket_id = 'INSUR') AS insur, count(*) FILTER (bucket_id = 'OTH') AS oth FROM dim_company GROUP BY ALL""")
def _(t: Tables):
    return analytics.bucket_counts(t.dim_company)


@query("portfolio_companies", "SELECT portfolio_id, 'Fondo ' || portfolio_id AS portfolio_name, upper(left(company_key, 1)) || substr(company_key, 2) AS company FROM dim_company")
def _(t: Tables):
    return analytics.portfolio_companies(t.dim_company)


MESSAGE = """CASE WHEN len(missing) = 0 THEN 'Reporte ' || c.bucket_id || ' completo. Todos los KPIs criticos presentes.'
  ELSE 'Atencion: Reporte ' || s.label || ' incompleto. Faltan: ' || array_to_string(missing, ', ') || '.' END"""


@query("sector_checklist", f"""
SELECT submission_id, c.bucket_id, array_to_string(present_kpis, ',') AS present_kpis, array_to_string(missing, ',') AS missing_kpis, len(missing) = 0 AS is_complete, {MESSAGE} AS display_message
FROM checklist c JOIN sector s ON c.bucket_id = s.bucket_id""")
def _(t: Tables):
    listed = contract.sector_checklist(t.parsed, t.subs)
    return listed.select(
        "submission_id", "bucket_id", F.array_join("present_kpis", ",").alias("present_kpis"),
        F.array_join("missing_kpis", ",").alias("missing_kpis"), "is_complete", "display_message",
    )


@query("checklist_missing", """
SELECT s.submission_id, s.bucket_id, r.kpi_key, CAST(r.ordinal AS INTEGER) AS ordinal FROM subs s JOIN req r ON s.bucket_id = r.bucket_id
ANTI JOIN (SELECT submission_id, kpi_key FROM parsed WHERE is_valid) v ON v.submission_id = s.submission_id AND v.kpi_key = r.kpi_key""")
def _(t: Tables):
    return contract.checklist_missing(t.parsed, t.subs)


@query("completeness_pct", """
SELECT submission_id, CAST(floor((len(required) - len(missing)) * 100.0 / len(required) + 0.5) AS INTEGER) AS completeness_pct,
  CASE WHEN len(missing) = 0 THEN 'green' WHEN len(missing) <= 1 THEN 'yellow' ELSE 'red' END AS completeness_color FROM checklist""")
def _(t: Tables):
    rows = contract.completeness(contract.sector_checklist(t.parsed, t.subs))
    return rows.select("submission_id", "completeness_pct", "completeness_color")


@query("extra_kpis", "SELECT submission_id, array_to_string(list_filter(present_kpis, lambda x: NOT list_contains(required, x)), ',') AS extra FROM checklist")
def _(t: Tables):
    rows = contract.sector_checklist(t.parsed, t.subs)
    return rows.select("submission_id", F.array_join(contract.extra_kpis(C("required_kpis"), C("present_kpis")), ",").alias("extra"))


@query("key_difference", "SELECT submission_id, array_to_string(missing, ',') AS missing FROM checklist")
def _(t: Tables):
    rows = contract.sector_checklist(t.parsed, t.subs)
    return rows.select("submission_id", F.array_join(contract.key_difference(C("required_kpis"), C("present_kpis")), ",").alias("missing"))


@query("union_distinct_keys", """
SELECT submission_id, array_to_string(list_concat(required, list_filter(present_kpis, lambda x: NOT list_contains(required, x))), ',') AS all_keys FROM checklist""")
def _(t: Tables):
    rows = contract.sector_checklist(t.parsed, t.subs)
    return rows.select("submission_id", F.array_join(contract.union_distinct_keys(C("required_kpis"), C("present_kpis")), ",").alias("all_keys"))


@query("checklist_dot", """
SELECT c.submission_id, r.kpi_key, CASE WHEN list_contains(c.missing, r.kpi_key) THEN 'missing' WHEN m.conf < 0.70 THEN 'warn' ELSE 'ok' END AS dot
FROM checklist c JOIN req r ON c.bucket_id = r.bucket_id LEFT JOIN (SELECT submission_id, kpi_key, min(confidence) AS conf FROM parsed GROUP BY ALL) m
ON m.submission_id = c.submission_id AND m.kpi_key = r.kpi_key""")
def _(t: Tables):
    from ledgerloom.functions.classify import checklist_dot

    listed = contract.sector_checklist(t.parsed, t.subs).select(
        "submission_id", "missing_kpis", F.explode("required_kpis").alias("kpi_key")
    )
    conf = t.kpi.groupBy("submission_id", "kpi_key").agg(F.min("confidence").alias("conf"))
    rows = listed.join(conf, ["submission_id", "kpi_key"], "left")
    dot = checklist_dot(~F.array_contains("missing_kpis", C("kpi_key")), C("conf"))
    return rows.select("submission_id", "kpi_key", dot.alias("dot"))


@query("bucket_visible_kpis", "SELECT p.id, p.kpi_key, p.bucket_id, v.kpi_group FROM parsed p JOIN visible v ON p.bucket_id = v.bucket_id AND p.kpi_key = v.kpi_key")
def _(t: Tables):
    return contract.bucket_visible_kpis(t.kpi.select("id", "kpi_key", "bucket_id"))


@query("duplicate_filenames", """
SELECT submission_id, substr(original_filename, 10) AS clean_name, count(*) OVER (PARTITION BY substr(original_filename, 10)) AS name_count,
  count(*) OVER (PARTITION BY substr(original_filename, 10)) > 1 AS is_duplicate FROM subs""")
def _(t: Tables):
    rows = analytics.duplicate_filenames(t.subs.select("submission_id", "original_filename"))
    return rows.select("submission_id", "clean_name", "name_count", "is_duplicate")


FUNDS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("filter_portfolio_results", """
SELECT submission_id, fund FROM (SELECT submission_id, coalesce(stored_fund, CASE WHEN contains(company_key, 'cust1') THEN 'ASIA' WHEN contains(company_key, 'cust22') THEN 'EUROPE' END) AS fund, founder_email FROM
  (SELECT submission_id, stored_fund, founder_email, CASE WHEN founder_email IS NULL THEN '' ELSE company_key END AS company_key FROM subs))
WHERE fund = 'ASIA' OR fund IS NULL OR fund NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')""")
def _(t: Tables):
    fund = analytics.result_fund(C("stored_fund"), C("founder_email"), [("cust1", "ASIA"), ("cust22", "EUROPE")])
    return analytics.filter_portfolio_results(t.subs.select("submission_id", fund.alias("fund")), "ASIA", FUNDS)


@query("fund_result_count", """
SELECT f.fund, count(*) AS results FROM subs s JOIN (VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE'), ('MIDDLE EAST')) AS f(fund)
ON s.stored_fund = f.fund OR s.stored_fund IS NULL OR s.stored_fund = 'unknown' GROUP BY 1""")
def _(t: Tables):
    return analytics.fund_result_count(t.subs.select(C("stored_fund").alias("fund")), FUNDS)


@query("all_null_columns", """
SELECT 'submission_id' AS column_name, count(submission_id) AS non_null FROM subs UNION ALL SELECT 'founder_email', count(founder_email) FROM subs
UNION ALL SELECT 'processed_at', count(processed_at) FROM subs UNION ALL SELECT 'nothing', count(NULL) FROM subs""")
def _(t: Tables):
    return files.all_null_columns(t.subs.select("submission_id", "founder_email", "processed_at", F.lit(None).cast("string").alias("nothing")))


@query("drop_all_null_columns", "SELECT submission_id, founder_email, processed_at FROM subs")
def _(t: Tables):
    return files.drop_all_null_columns(
        t.subs.select("submission_id", F.lit(None).cast("string").alias("nothing"), "founder_email", "processed_at")
    )


@query("comparison_table", """
SELECT s.submission_id, substr(s.original_filename, 10, 20) || '...' AS label, coalesce(TRY_CAST(replace(max(d.raw_value) FILTER (d.kpi_key = 'revenue_growth' AND NOT d.is_scalar), '%', '') AS DOUBLE), 0) AS growth_value,
   coalesce(TRY_CAST(replace(max(d.raw_value) FILTER (d.kpi_key = 'ebitda_margin' AND NOT d.is_scalar), '%', '') AS DOUBLE), 0) AS margin_value
FROM subs s JOIN docrows d ON s.submission_id = d.submission_id GROUP BY ALL""")
def _(t: Tables):
    m = documents.dashboard_extract(C("doc"))
    rows = t.docs.select("submission_id", "original_filename", m["revenue_growth"].alias("revenue_growth"), m["ebitda_margin"].alias("ebitda_margin"))
    return analytics.comparison_table(rows).select("submission_id", "label", "growth_value", "margin_value")


# ---- windows and top-k ----------------------------------------------------------------------

@query("dup_count", "SELECT p.id, d.dup_count FROM parsed p JOIN dups d ON d.submission_id = p.submission_id AND d.kpi_key = p.kpi_key AND d.period_id = p.period_id")
def _(t: Tables):
    return audit.dup_count(t.kpi.select("id", "submission_id", "kpi_key", "period_id")).select("id", "dup_count")


@query("in_batch_duplicate", """
SELECT id, row_number() OVER (PARTITION BY submission_id, kpi_key, period_id ORDER BY row_seq, id) > 1 AS is_duplicate FROM kpi""")
def _(t: Tables):
    rows = t.kpi.select("id", "submission_id", "kpi_key", "period_id", "row_seq")
    return audit.in_batch_duplicate(rows).select("id", "is_duplicate")


@query("post_load_audit", "SELECT * FROM flagged")
def _(t: Tables):
    facts = t.parsed.select("id", "submission_id", "kpi_key", "period_id", "confidence", "is_valid")
    flagged = audit.post_load_audit(facts, t.latest)
    return flagged.drop("period_id", "is_latest_version")


@query("audit_post_load", "SELECT audit_status, count(*) AS n FROM flagged WHERE portfolio_id = 'AMERICA' GROUP BY 1")
def _(t: Tables):
    facts = t.parsed.select("id", "submission_id", "kpi_key", "period_id", "confidence", "is_valid")
    flagged = audit.post_load_audit(facts, t.latest, "AMERICA", ordered=False)
    return flagged.groupBy("audit_status").agg(F.count(F.lit(1)).alias("n"))


@query("audit_counts", """
SELECT count(*) AS total_rows, count(*) FILTER (audit_status LIKE 'ERROR%') AS errors, count(*) FILTER (audit_status LIKE 'ADVERTENCIA%') AS warnings FROM flagged""")
def _(t: Tables):
    facts = t.parsed.select("id", "submission_id", "kpi_key", "period_id", "confidence", "is_valid")
    return audit.audit_counts(audit.post_load_audit(facts, t.latest, ordered=False))


@query("dedup_by_hash", """
SELECT submission_id, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY submitted_at, submission_id) AS rn FROM subs) WHERE rn = 1""")
def _(t: Tables):
    return store.dedup_by_hash(t.subs.select("submission_id", "file_hash", "submitted_at")).select("submission_id", "file_hash")


@query("dedup_by_hash_text", "SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash FROM documents GROUP BY sha256(text)")
def _(t: Tables):
    docs = t.raw("documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return store.dedup_by_hash(docs, ["doc_id"])


@query("latest_version", "SELECT submission_id, company_id, period_id, is_latest_version FROM latest")
def _(t: Tables):
    return t.latest.select("submission_id", "company_id", "period_id", "is_latest_version")


HISTORY = f"""SELECT company_id, kpi_key, strftime(l_shipdate, '%Y-%m') AS period,
  {exact_avg("numeric_value")} AS value FROM parsed WHERE is_valid GROUP BY 1, 2, 3"""


def _history(t: Tables):
    rows = t.parsed.filter("is_valid").select(
        "company_id", "kpi_key", F.date_format("l_shipdate", "yyyy-MM").alias("period"), C("numeric_value").alias("value")
    )
    return analytics.kpi_history(rows, ["company_id", "kpi_key"], "period")


@query("history_tail", f"""
SELECT company_id, kpi_key, period, value, CAST(5 - rn AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY company_id, kpi_key ORDER BY period DESC) AS rn FROM ({HISTORY})) WHERE rn <= 4""")
def _(t: Tables):
    return analytics.history_tail(_history(t), ["company_id", "kpi_key"], "period")


@query("anomaly_vs_history", f"""
SELECT *, CASE WHEN previous = 0 THEN false ELSE coalesce(abs(value - previous) / previous > 0.5, false) END AS is_anomaly
FROM (SELECT *, lag(value) OVER (PARTITION BY company_id, kpi_key ORDER BY period) AS previous FROM ({HISTORY}))""")
def _(t: Tables):
    return analytics.anomaly_vs_history(_history(t), ["company_id", "kpi_key"], "period")


@query("first_result_per_portfolio", """
SELECT portfolio_id, submission_id, processed_at FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY coalesce(processed_at, 'unknown') DESC, submission_id) AS rn FROM subs) WHERE rn = 1""")
def _(t: Tables):
    rows = t.subs.select("portfolio_id", "submission_id", "processed_at")
    return analytics.first_result_per_portfolio(rows, tie="submission_id")


@query("rag_context_topk", """
SELECT p.id, s.company_id, s.portfolio_id, p.period_id, p.kpi_label, p.raw_value, p.unit FROM parsed p JOIN subs s ON p.submission_id = s.submission_id
WHERE p.is_valid AND s.portfolio_id = 'AFRICA' AND lower(s.company_id) LIKE '%cust1%' ORDER BY s.submitted_at DESC, p.id LIMIT 400""")
def _(t: Tables):
    rows = analytics.rag_context_topk(t.parsed, t.subs, "AFRICA", "CUST1")
    return rows.select("id", "company_id", "portfolio_id", "period_id", "kpi_label", "raw_value", "unit")


@query("context_text", """
SELECT 'empresa | fondo | período | kpi | valor | unidad' || chr(10) || string_agg(line, chr(10) ORDER BY submitted_at DESC, id) AS context_text FROM (
  SELECT p.id, s.submitted_at, concat_ws(' | ', s.company_id, s.portfolio_id, p.period_id, coalesce(p.kpi_label, '—'), p.raw_value, p.unit) AS line
  FROM parsed p JOIN subs s ON p.submission_id = s.submission_id WHERE p.is_valid ORDER BY s.submitted_at DESC, p.id LIMIT 400)""")
def _(t: Tables):
    return analytics.context_text(analytics.rag_context_topk(t.parsed, t.subs))


@query("results_newest_first", "SELECT submission_id, coalesce(processed_at, 'unknown') AS date FROM subs")
def _(t: Tables):
    rows = analytics.results_newest_first(t.subs.select("submission_id", "processed_at"), tie="submission_id")
    return rows.select("submission_id", "date")


@query("recent_results", """
SELECT submission_id, coalesce(processed_at, 'unknown') AS date FROM subs WHERE stored_fund = 'ASIA' OR stored_fund IS NULL OR stored_fund = 'unknown'
ORDER BY coalesce(processed_at, 'unknown') DESC, submission_id LIMIT 10""")
def _(t: Tables):
    rows = t.subs.select("submission_id", "processed_at", C("stored_fund").alias("fund"))
    return analytics.recent_results(rows, "ASIA", FUNDS, tie="submission_id").select("submission_id", "date")


@query("recent_results_fallback", """
SELECT submission_id, coalesce(processed_at, 'unknown') AS date FROM subs WHERE stored_fund = 'ASIA' ORDER BY coalesce(processed_at, 'unknown') DESC, submission_id LIMIT 10""")
def _(t: Tables):
    rows = t.subs.filter(C("stored_fund") == "ASIA").select("submission_id", "processed_at", C("stored_fund").alias("fund"))
    return analytics.recent_results(rows, "EUROPE", FUNDS, tie="submission_id").select("submission_id", "date")


@query("rows_per_sheet_cap", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(rn AS INTEGER) AS row_no FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 500""")
def _(t: Tables):
    rows = t.raw("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return files.rows_per_sheet_cap(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query("ordered_findings", """
SELECT submission_id, string_agg(kpi_key || '=' || n, ';' ORDER BY kpi_key) AS findings FROM (SELECT submission_id, kpi_key, count(*) AS n FROM flagged GROUP BY ALL) GROUP BY submission_id""")
def _(t: Tables):
    facts = t.parsed.select("id", "submission_id", "kpi_key", "period_id", "confidence", "is_valid")
    return audit.ordered_findings(audit.post_load_audit(facts, t.latest, ordered=False))


@query("render_markdown", """
SELECT p_brand, '| p_partkey | p_name | p_type |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 7 = 0 THEN 'a\\|b' ELSE p_name END || ' | ' || p_type || ' |', chr(10) ORDER BY rn) AS markdown
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 500 GROUP BY p_brand""")
def _(t: Tables):
    size = C("p_size")
    rows = t.raw("part").select(
        "p_brand", "p_partkey", F.when(size % 5 == 0, F.lit(None)).when(size % 7 == 0, "a|b").otherwise(C("p_name")).alias("p_name"), "p_type"
    )
    capped = files.rows_per_sheet_cap(rows, ["p_brand"], ["p_partkey"])
    return files.render_markdown(capped, ["p_brand"], ["p_partkey", "p_name", "p_type"])


# ---- derived margins and history metrics ----------------------------------------------------

DERIVED = """
SELECT b.submission_id, b.kpi_key, round(ratio, 6) AS numeric_value, CASE WHEN p.currency = 'USD' THEN round(ratio, 6) END AS normalized_value_usd, p.currency AS original_currency
FROM (SELECT r.submission_id, 'gross_profit_margin' AS kpi_key, (r.numeric_value - c.numeric_value) / r.numeric_value AS ratio FROM last_ok r JOIN last_ok c ON r.submission_id = c.submission_id WHERE r.kpi_key = 'revenue' AND c.kpi_key = 'cogs' AND r.numeric_value <> 0
  UNION ALL SELECT r.submission_id, 'ebitda_margin', c.numeric_value / r.numeric_value FROM last_ok r JOIN last_ok c ON r.submission_id = c.submission_id WHERE r.kpi_key = 'revenue' AND c.kpi_key = 'ebitda' AND r.numeric_value <> 0) b
JOIN subs p ON p.submission_id = b.submission_id"""


@query("derive_margins", f"SELECT * FROM ({DERIVED}) d WHERE NOT EXISTS (SELECT 1 FROM kpi k WHERE k.submission_id = d.submission_id AND k.kpi_key = d.kpi_key)")
def _(t: Tables):
    return contract.derive_margins(t.parsed).select("submission_id", "kpi_key", "numeric_value", "normalized_value_usd", "original_currency")


@query("derive_margins_intended", f"SELECT * FROM ({DERIVED}) d WHERE NOT EXISTS (SELECT 1 FROM parsed k WHERE k.submission_id = d.submission_id AND k.kpi_key = d.kpi_key AND k.is_valid)")
def _(t: Tables):
    return contract.derive_margins(t.parsed, mode="intended").select("submission_id", "kpi_key", "numeric_value", "normalized_value_usd", "original_currency")


@query("append_derived", f"""
SELECT kpi_key, source, count(*) AS n FROM (SELECT kpi_key, 'extracted' AS source FROM kpi UNION ALL
  SELECT kpi_key, 'derived' FROM ({DERIVED}) d WHERE NOT EXISTS (SELECT 1 FROM kpi k WHERE k.submission_id = d.submission_id AND k.kpi_key = d.kpi_key)) GROUP BY ALL""")
def _(t: Tables):
    rows = t.parsed.select("id", "submission_id", "row_seq", "kpi_key", "numeric_value", "is_valid", "period_id", "currency")
    both = contract.append_derived(rows, contract.derive_margins(rows))
    return both.groupBy("kpi_key", F.when(C("id").isNull(), "derived").otherwise("extracted").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("recalc_margins", """
SELECT id, kpi_key, origin, round(recalculated, 6) AS recalculated_value, round(delta, 4) AS delta_pct_points, calc_status FROM recalc2""")
def _(t: Tables):
    facts = t.parsed.select("id", "submission_id", "kpi_key", "raw_value", "numeric_value", "source_description", "is_valid", "row_seq")
    return fidelity.recalc_margins(facts).select("id", "kpi_key", "origin", "recalculated_value", "delta_pct_points", "calc_status")


@query("calc_row_split", """
SELECT count(*) FILTER (origin = 'gemini' AND is_valid) AS extracted_valid, count(*) FILTER (origin = 'calculated') AS calculated,
  count(*) FILTER (recalculated IS NOT NULL) AS recalculable, count(*) FILTER (is_valid OR recalculated IS NOT NULL) AS significant FROM recalc2""")
def _(t: Tables):
    facts = t.parsed.select("id", "submission_id", "kpi_key", "raw_value", "numeric_value", "source_description", "is_valid", "row_seq")
    split = fidelity.calc_row_split(fidelity.recalc_margins(facts))
    return split.agg(
        F.count_if("is_extracted_valid").alias("extracted_valid"), F.count_if("is_calculated").alias("calculated"),
        F.count_if("is_recalculable").alias("recalculable"), F.count_if("is_significant").alias("significant"),
    )


MONTHLY = """SELECT l_suppkey, (year(l_shipdate) * 12 + month(l_shipdate)) AS month_index, CAST(sum(CAST(l_extendedprice AS DECIMAL(38,6))) AS DOUBLE) AS value,
  CAST(sum(CAST(l_quantity AS DECIMAL(38,6))) AS DOUBLE) AS spend FROM lineitem GROUP BY 1, 2"""


def _monthly(t: Tables):
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    exact = lambda c: F.sum(C(c).cast(contract.EXACT)).cast("double")
    return t.raw("lineitem").groupBy("l_suppkey", month.cast("bigint").alias("month_index")).agg(
        exact("l_extendedprice").alias("value"), exact("l_quantity").alias("spend")
    )


@query("burn_multiple", f"""
SELECT l_suppkey, month_index, value - lag(value) OVER w AS net_new_arr, spend / nullif(value - lag(value) OVER w, 0) AS burn_multiple
FROM ({MONTHLY}) WINDOW w AS (PARTITION BY l_suppkey ORDER BY month_index)""")
def _(t: Tables):
    rows = _monthly(t).withColumnsRenamed({"value": "arr", "spend": "net_burn"})
    return analytics.burn_multiple(rows, ["l_suppkey"], "month_index").select("l_suppkey", "month_index", "net_new_arr", "burn_multiple")


@query("magic_number", f"""
SELECT l_suppkey, month_index, (value - lag(value) OVER w) / nullif(lag(spend) OVER w, 0) AS magic_number FROM ({MONTHLY}) WINDOW w AS (PARTITION BY l_suppkey ORDER BY month_index)""")
def _(t: Tables):
    rows = _monthly(t).withColumnRenamed("value", "arr")
    return analytics.magic_number(rows, ["l_suppkey"], "month_index").select("l_suppkey", "month_index", "magic_number")


@query("l3m_cmgr", f"""
WITH m AS ({MONTHLY}) SELECT a.l_suppkey, a.month_index, round(pow(a.value / b.value, 1.0 / 3.0) - 1, 9) AS l3m_cmgr FROM m a LEFT JOIN m b ON a.l_suppkey = b.l_suppkey AND b.month_index = a.month_index - 3""")
def _(t: Tables):
    rows = analytics.l3m_cmgr(_monthly(t), ["l_suppkey"], "month_index")
    return rows.select("l_suppkey", "month_index", F.round("l3m_cmgr", 9).alias("l3m_cmgr"))


@query("net_dollar_retention", """
WITH r AS (SELECT o_custkey AS customer, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS period_index, sum(CAST(o_totalprice AS DECIMAL(38,6))) AS v FROM orders GROUP BY 1, 2)
SELECT b.period_index + 1 AS period_index, CAST(sum(b.v) AS DOUBLE) AS base_revenue, CAST(coalesce(sum(a.v), 0) AS DOUBLE) AS retained_revenue,
  CAST(coalesce(sum(a.v), 0) AS DOUBLE) / CAST(sum(b.v) AS DOUBLE) AS ndr FROM r b LEFT JOIN r a ON a.customer = b.customer AND a.period_index = b.period_index + 1 GROUP BY b.period_index""")
def _(t: Tables):
    quarter = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("bigint")
    rows = t.raw("orders").select(C("o_custkey").alias("customer"), quarter.alias("period_index"), C("o_totalprice").alias("value"))
    return analytics.net_dollar_retention(rows)
