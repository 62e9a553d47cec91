"""Independent SQL for every registered query, as text for an embedded SQL engine.

``oracle_query`` puts the common table expressions a query names in front of it.
"""

from __future__ import annotations

import re

from ledgerloom import dims
from ledgerloom.plans.fixtures import FX_BUCKETS, FX_COMPANIES, FX_NAMES, TABLES, fixture_sql


def _values(rows: list[tuple], names: str) -> str:
    def lit(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    body = ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


_PLAIN = {t: t for t in TABLES}

NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"

CTES: dict[str, str] = {name: fixture_sql(name, _PLAIN, "sha256(") for name in ("dim_company", "subs", "kpi", "edits")}
CTES["chunks"] = f"""SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence
  FROM ({fixture_sql("chunks", _PLAIN, "sha256(")})"""
CTES["dim_kpi"] = _values(
    [(i, k, label, unit, "%" if unit == "pct" else "$", dims.METRIC_BUCKET.get(k, "ALL"), path[0])
     for i, (k, label, path, unit) in enumerate(dims.KPI_REGISTRY, 1)],
    "ordinal, kpi_key, kpi_label, unit_type, unit_expected, metric_bucket, section",
)
CTES["dim_fx"] = _values(dims.fx_rows(), "currency, year, rate").replace("SELECT *", "SELECT currency, year, CAST(rate AS DOUBLE) AS rate")
CTES["req"] = _values(
    [(b, k, i) for b, keys in dims.SECTOR_REQUIREMENTS.items() for i, k in enumerate(keys, 1)],
    "bucket_id, kpi_key, ordinal",
)
CTES["sector"] = _values(list(dims.SECTOR_LABELS.items()), "bucket_id, label")
CTES["visible"] = _values(
    [(b, k, g) for b, sec in dims.SECTOR_VISIBLE.items() for g, keys in (("base", dims.BASE_VISIBLE), ("sector", sec)) for k in keys],
    "bucket_id, kpi_key, kpi_group",
)
CTES["names"] = _values([(n, f, i) for i, (n, f) in enumerate(FX_NAMES, 1)], "name, portfolio_id, ordinal")
CTES["co_names"] = _values([(n, f, i) for i, (n, f) in enumerate(FX_COMPANIES, 1)], "name, portfolio_id, ordinal")
CTES["bk_names"] = _values([(n, f, i) for i, (n, f) in enumerate(FX_BUCKETS, 1)], "name, bucket_id, ordinal")
CTES["piece1"] = """SELECT *, trim(raw_value) AS t, ltrim(trim(raw_value), '+-') AS body FROM kpi"""
CTES["piece2"] = """SELECT *, CASE WHEN contains(body, '%') THEN replace(body, '%', '') ELSE replace(body, '$', '') END AS bare FROM piece1"""
CTES["piece3"] = """SELECT *, CASE WHEN upper(right(bare, 1)) IN ('B', 'M', 'K') THEN upper(right(bare, 1)) ELSE '' END AS letter FROM piece2"""
CTES["piece4"] = """SELECT *, trim(replace(CASE WHEN letter = '' THEN bare ELSE left(bare, length(bare) - 1) END, ',', '')) AS digits FROM piece3"""
CTES["parsed"] = f"""
SELECT p.id, p.submission_id, p.row_seq, p.kpi_key, k.kpi_label, p.raw_value, p.confidence, p.source_description, p.is_scalar,
       p.period_id, p.currency, p.report_year, p.company_id, p.bucket_id, p.l_shipdate, p.l_partkey, p.l_suppkey, v.numeric_value,
       v.numeric_value IS NOT NULL AS is_valid, k.unit_type, k.unit_expected, k.metric_bucket,
       CASE WHEN v.numeric_value IS NOT NULL AND (contains(p.body, '%') OR contains(p.body, '$') OR p.letter <> '')
            THEN CASE WHEN contains(p.body, '%') THEN '%' WHEN contains(p.body, '$') THEN '$' ELSE '' END || p.letter
            ELSE coalesce(k.unit_expected, '$') END AS unit
FROM piece4 p LEFT JOIN dim_kpi k ON p.kpi_key = k.kpi_key,
     LATERAL (SELECT CASE WHEN regexp_full_match(p.digits, '{NUMBER}') THEN CAST(p.digits AS DOUBLE)
                     * CASE p.letter WHEN 'B' THEN 1e9 WHEN 'M' THEN 1e6 WHEN 'K' THEN 1e3 ELSE 1.0 END
                     * CASE WHEN p.t LIKE '-%' THEN -1.0 ELSE 1.0 END END AS numeric_value) v"""
CTES["facts"] = """
SELECT p.*, CASE WHEN NOT is_valid THEN NULL WHEN p.currency = 'USD' THEN 1.0 ELSE r.rate END AS fx_rate,
       CASE WHEN p.currency = 'USD' THEN numeric_value ELSE round(numeric_value / r.rate, 6) END AS normalized_value_usd
FROM parsed p LEFT JOIN dim_fx r ON p.currency = r.currency
  AND r.year = least(greatest(p.report_year, 2019), CASE WHEN p.currency = 'USD' THEN 2030 ELSE 2025 END)"""
CTES["rollup"] = """
SELECT submission_id, count(*) AS kpi_count_total, count(*) FILTER (is_valid) AS kpi_count_valid,
       ((200 * count(*) FILTER (is_valid) + count(*)) // (2 * count(*))) / 100.0 AS valid_ratio,
       CAST((2 * sum(CAST(round(confidence * 1000000) AS BIGINT)) + 1000 * count(confidence)) // nullif(2000 * count(confidence), 0) AS BIGINT) / 1000.0 AS avg_confidence,
       count(DISTINCT period_id) <= 1 AS period_consistent
FROM parsed GROUP BY submission_id"""
CTES["rollup2"] = """
SELECT *, CASE WHEN avg_confidence < 0.85 THEN 'pending_human_review' WHEN kpi_count_valid > 0 THEN 'processed' ELSE 'empty' END AS status FROM rollup"""
CTES["latest"] = """
SELECT *, row_number() OVER (PARTITION BY company_id, period_id ORDER BY submitted_at DESC, submission_id DESC) = 1 AS is_latest_version FROM subs"""
CTES["heads"] = "SELECT l.*, r.* EXCLUDE (submission_id) FROM latest l JOIN rollup2 r ON l.submission_id = r.submission_id"
CTES["first_kpi"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY submission_id, kpi_key ORDER BY row_seq) AS rn FROM parsed) WHERE rn = 1"""
CTES["docset"] = "SELECT * FROM subs WHERE form NOT IN ('broken', 'array') AND submission_id IN (SELECT submission_id FROM kpi)"
CTES["docrows"] = """
SELECT d.submission_id, d.seq, d.form, d.currency, d.report_year, d.period_id, d.bucket_id, d.company_id, d.file_hash, d.submitted_at,
       k.ordinal, k.kpi_key, k.kpi_label, k.section, k.unit_type, f.raw_value, coalesce(f.numeric_value, NULL) AS numeric_value,
       coalesce(f.unit, k.unit_expected) AS unit, coalesce(f.is_valid, false) AS is_valid,
       CASE WHEN f.is_scalar THEN NULL ELSE f.confidence END AS confidence,
       CASE WHEN f.is_scalar THEN NULL ELSE f.source_description END AS source_description,
       coalesce(f.is_scalar, false) AS is_scalar, f.id IS NOT NULL AS has_node
FROM docset d CROSS JOIN dim_kpi k
LEFT JOIN first_kpi f ON f.submission_id = d.submission_id AND f.kpi_key = k.kpi_key AND d.form NOT IN ('no_metrics', 'empty')"""
CTES["docyear"] = r"""
SELECT submission_id, year FROM (
  SELECT submission_id, year, row_number() OVER (PARTITION BY submission_id ORDER BY count(*) DESC, min(pos)) AS rn FROM (
    SELECT submission_id, 0 AS pos, unnest(regexp_extract_all(period_id, '\b(20[0-9][0-9])\b', 1)) AS year FROM docset
    UNION ALL SELECT submission_id, ordinal, unnest(regexp_extract_all(raw_value, '\b(20[0-9][0-9])\b', 1)) FROM docrows WHERE raw_value IS NOT NULL)
  GROUP BY submission_id, year) WHERE rn = 1"""
CTES["present"] = """
SELECT submission_id, list_sort(list(DISTINCT kpi_key)) AS present_kpis FROM parsed
WHERE is_valid GROUP BY submission_id"""
CTES["req_list"] = "SELECT bucket_id, list(kpi_key ORDER BY ordinal) AS required FROM req GROUP BY bucket_id"
CTES["checklist"] = """
SELECT h.submission_id, h.bucket_id, coalesce(p.present_kpis, []) AS present_kpis, r.required,
       list_filter(r.required, lambda x: NOT list_contains(coalesce(p.present_kpis, []), x)) AS missing
FROM (SELECT DISTINCT submission_id, bucket_id FROM subs) h LEFT JOIN present p ON h.submission_id = p.submission_id
JOIN req_list r ON h.bucket_id = r.bucket_id"""
CTES["last_any"] = """
SELECT submission_id, kpi_key, numeric_value FROM (
  SELECT *, row_number() OVER (PARTITION BY submission_id, kpi_key ORDER BY row_seq DESC) AS rn FROM parsed) WHERE rn = 1"""
CTES["last_ok"] = """
SELECT submission_id, kpi_key, numeric_value FROM (
  SELECT *, row_number() OVER (PARTITION BY submission_id, kpi_key ORDER BY row_seq DESC) AS rn FROM parsed WHERE is_valid) WHERE rn = 1"""
CTES["recalc"] = """
SELECT p.*, CASE WHEN contains(coalesce(p.source_description, ''), 'calculated') THEN 'calculated' ELSE 'gemini' END AS origin,
       s.numeric_value AS stored_value,
       p.kpi_key IN ('gross_profit_margin', 'ebitda_margin') AS derivable,
       rv.numeric_value IS NOT NULL AND dp.numeric_value IS NOT NULL AS has_deps,
       CASE WHEN rv.numeric_value <> 0 AND p.kpi_key = 'gross_profit_margin' THEN (rv.numeric_value - dp.numeric_value) / rv.numeric_value
            WHEN rv.numeric_value <> 0 AND p.kpi_key = 'ebitda_margin' THEN dp.numeric_value / rv.numeric_value END AS recalculated
FROM parsed p
LEFT JOIN last_any s ON s.submission_id = p.submission_id AND s.kpi_key = p.kpi_key
LEFT JOIN last_any rv ON rv.submission_id = p.submission_id AND rv.kpi_key = 'revenue'
LEFT JOIN last_any dp ON dp.submission_id = p.submission_id
  AND dp.kpi_key = CASE p.kpi_key WHEN 'gross_profit_margin' THEN 'cogs' WHEN 'ebitda_margin' THEN 'ebitda' END"""
CTES["recalc2"] = """
SELECT *, abs(stored_value - recalculated) * 100 AS delta,
       CASE WHEN derivable AND NOT has_deps THEN CASE WHEN origin = 'gemini' AND stored_value IS NOT NULL THEN 'OK' ELSE 'N/A' END
            WHEN derivable AND recalculated IS NULL THEN 'N/A'
            WHEN derivable AND stored_value IS NULL THEN 'WARN'
            WHEN derivable AND abs(stored_value - recalculated) * 100 > 2.0 THEN 'ERROR'
            WHEN derivable AND abs(stored_value - recalculated) * 100 > 0.5 THEN 'WARN'
            WHEN derivable THEN 'OK'
            WHEN origin = 'calculated' THEN 'WARN' WHEN is_valid THEN 'OK' ELSE 'WARN' END AS calc_status
FROM recalc"""
CTES["calc"] = """
SELECT submission_id, count(*) FILTER (calc_status = 'OK') AS ok_rows, count(*) FILTER (calc_status = 'WARN') AS warn_rows,
       count(*) FILTER (calc_status = 'ERROR') AS error_rows,
       count(*) FILTER (derivable AND delta > 0.5) AS discrepancies,
       count(*) FILTER (derivable AND delta > 2.0) AS calc_errors,
       count(*) FILTER ((derivable AND has_deps AND recalculated IS NOT NULL AND (stored_value IS NULL OR (delta > 0.5 AND delta <= 2.0)))
                        OR (NOT derivable AND origin = 'calculated')) AS calc_warnings
FROM recalc2 GROUP BY submission_id"""
CTES["identity"] = """
SELECT h.submission_id, h.company_id, h.company_key, h.is_latest_version, h.status, h.avg_confidence,
       d.company_key IS NOT NULL AS in_dim_company, d.bucket_id AS bucket_in_db,
       CASE WHEN h.seq % 10 = 0 THEN 'OTH' ELSE h.bucket_id END AS bucket_expected
FROM heads h LEFT JOIN dim_company d ON h.company_key = d.company_key"""
CTES["identity2"] = """
SELECT *, CAST(NOT in_dim_company AS INT) + CAST(coalesce(bucket_in_db <> bucket_expected, false) AS INT) AS identity_errors,
       CAST(NOT is_latest_version AS INT) + CAST(status = 'pending_human_review' AS INT) AS identity_warnings
FROM identity"""
CTES["fid_check"] = """
SELECT i.submission_id, coalesce(i.bucket_in_db, i.bucket_expected) AS bucket_id, r.required, coalesce(p.present_kpis, []) AS present_kpis,
       list_filter(r.required, lambda x: NOT list_contains(coalesce(p.present_kpis, []), x)) AS missing
FROM identity i LEFT JOIN present p ON i.submission_id = p.submission_id
JOIN req_list r ON r.bucket_id = coalesce(i.bucket_in_db, i.bucket_expected)"""
CTES["dups"] = "SELECT submission_id, kpi_key, period_id, count(*) AS dup_count FROM parsed GROUP BY ALL"
CTES["flagged"] = """
SELECT * FROM (
SELECT p.id, p.submission_id, p.kpi_key, l.company_id, l.portfolio_id, p.confidence, p.is_valid, d.dup_count,
       CASE WHEN dup_count > 1 THEN 'ERROR: Duplicado' WHEN NOT is_valid THEN 'ERROR: Valor no numérico'
            WHEN confidence < 0.70 THEN 'ERROR: Confianza crítica (<0.70)' WHEN confidence < 0.85 THEN 'ADVERTENCIA: Confianza baja (<0.85)'
            ELSE 'PASS' END AS audit_status
FROM parsed p JOIN latest l ON p.submission_id = l.submission_id AND l.is_latest_version
JOIN dups d ON d.submission_id = p.submission_id AND d.kpi_key = p.kpi_key AND d.period_id = p.period_id) WHERE audit_status <> 'PASS'"""


def exact_avg(value: str) -> str:
    """Average of doubles whose first six places are added up as decimals, the rest as doubles."""
    exact = f"CAST({value} AS DECIMAL(38,6))"
    return f"(CAST(sum({exact}) AS DOUBLE) + sum({value} - CAST({exact} AS DOUBLE))) / nullif(count({value}), 0)"


_SERIES = ["revenue_growth", "gross_profit_margin", "ebitda_margin", "cash_in_bank_end_of_year", "annual_cash_flow", "working_capital_debt"]
CTES["series"] = f"""
SELECT strftime(s.submitted_at, '%Y-%m') AS month, s.company_id, s.portfolio_id, count(DISTINCT s.submission_id) AS submission_count,
       {", ".join(f"{exact_avg(f"(CASE WHEN kpi_key = '{k}' THEN numeric_value END)")} AS {k}" for k in _SERIES)}
FROM subs s JOIN parsed k ON s.submission_id = k.submission_id WHERE k.is_valid GROUP BY 1, 2, 3"""
CTES["cavg"] = f"""
SELECT company_id, {", ".join(f"{exact_avg(k)} AS {k}" for k in _SERIES[:3])}
FROM series GROUP BY company_id"""


def _uses(text: str) -> set[str]:
    words = set(re.findall(r"[a-z_0-9]+", re.sub(r"'[^']*'", "", text)))
    return words & CTES.keys()


def oracle_query(sql: str) -> str:
    """The query with every table expression it needs, in dependency order."""
    ordered: list[str] = []
    seen: set[str] = set()

    def need(name: str) -> None:
        if name not in seen:
            seen.add(name)
            for inner in sorted(_uses(CTES[name]) - {name}):
                need(inner)
            ordered.append(name)

    for name in sorted(_uses(sql)):
        need(name)
    if not ordered:
        return sql
    # the dear ones are computed once, however often they are used
    once = {"parsed", "first_kpi", "docrows", "docyear"}
    head = ", ".join(f"{name} AS {'MATERIALIZED ' * (name in once)}({CTES[name]})" for name in ordered)
    stripped = sql.strip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {head}, {stripped[5:]}"
    return f"WITH {head} {stripped}"
