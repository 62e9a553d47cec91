"""Column functions over whole columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import dims
from ledgerloom.functions import classify, formats, periods, text, units, values
from ledgerloom.operators import analytics, contract, documents, resolve
from ledgerloom.plans.fixtures import Tables
from ledgerloom.plans.registry import query

C = F.col


@query("parse_numeric", "SELECT id, raw_value, numeric_value, CASE WHEN is_valid AND (contains(raw_value, '%') OR contains(raw_value, '$')) THEN unit END AS unit FROM parsed")
def _(t: Tables):
    return t.kpi.select("id", "raw_value", values.parse_numeric(C("raw_value")).alias("p")).select(
        "id", "raw_value", C("p.value").alias("numeric_value"), C("p.unit").alias("unit")
    )


UNIT_TEXT = """CASE l_partkey % 12 WHEN 0 THEN 'usd' WHEN 1 THEN ' USDm ' WHEN 2 THEN 'pct' WHEN 3 THEN 'Percentage' WHEN 4 THEN 'MXN'
  WHEN 5 THEN 'us dollars' WHEN 6 THEN 'ratioK' WHEN 7 THEN '$M' WHEN 8 THEN 'clients' WHEN 9 THEN '' WHEN 10 THEN 'brlb' ELSE NULL END"""


@query("normalize_unit", f"""
SELECT l_orderkey, l_linenumber, l_partkey, u AS unit_text,
       CASE WHEN lower(trim(u)) IN ('usd','dollars','usd_amount','us dollars','mxn','eur','brl','cop') THEN '$'
            WHEN lower(trim(u)) IN ('pct','percentage','ratio','decimal','rate') THEN '%'
            WHEN trim(u) = 'USDm' THEN '$M' WHEN u = 'ratioK' THEN '%K' WHEN u = 'brlb' THEN '$B' ELSE trim(u) END AS unit
FROM (SELECT *, {UNIT_TEXT} AS u FROM lineitem)""")
def _(t: Tables):
    rows = t.raw("lineitem").withColumn("unit_text", F.expr(UNIT_TEXT))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "unit_text", units.normalize_unit(C("unit_text")).alias("unit"))


@query("unit_synonym_join", f"""
SELECT u AS unit_text, s.unit, count(*) AS n FROM (SELECT {UNIT_TEXT} AS u FROM lineitem) l
LEFT JOIN (SELECT * FROM (VALUES ('usd','$'),('dollars','$'),('usd_amount','$'),('us dollars','$'),('mxn','$'),('eur','$'),('brl','$'),('cop','$'),
  ('pct','%'),('percentage','%'),('ratio','%'),('decimal','%'),('rate','%')) AS v(word, unit)) s ON lower(trim(l.u)) = s.word GROUP BY ALL""")
def _(t: Tables):
    rows = t.raw("lineitem").select(F.expr(UNIT_TEXT).alias("unit_text"))
    words = F.broadcast(dims.dim_unit_synonym(t.spark)).withColumnRenamed("unit_text", "word")
    return rows.join(words, F.lower(F.trim("unit_text")) == C("word"), "left").groupBy("unit_text", "unit").agg(F.count(F.lit(1)).alias("n"))


@query("unit_or_default", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN u IS NULL OR u = '' THEN CASE WHEN l_linenumber IN (4, 6) THEN 'pct' ELSE 'usd' END ELSE u END AS unit
FROM (SELECT *, {UNIT_TEXT} AS u FROM lineitem)""")
def _(t: Tables):
    kind = F.when(C("l_linenumber").isin(4, 6), "pct").otherwise("usd")
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", units.unit_or_default(F.expr(UNIT_TEXT), kind).alias("unit")
    )


@query("unit_matches", """
SELECT id, kpi_key, unit, NOT (contains(unit_expected, replace(replace(replace(unit, 'M', ''), 'K', ''), 'B', ''))
   OR contains(replace(replace(replace(unit, 'M', ''), 'K', ''), 'B', ''), unit_expected)) AND replace(replace(replace(unit, 'M', ''), 'K', ''), 'B', '') <> '' AS mismatch
FROM parsed WHERE unit_expected IS NOT NULL""")
def _(t: Tables):
    rows = resolve.metric_dim_join(t.parsed).filter(C("unit_expected").isNotNull())
    return rows.select("id", "kpi_key", "unit", units.unit_mismatch(C("unit"), C("unit_expected")).alias("mismatch"))


@query("parse_display_value", """
SELECT id, raw_value, CASE WHEN contains(raw_value, '%') THEN coalesce(TRY_CAST(replace(raw_value, '%', '') AS DOUBLE), 0)
   WHEN raw_value LIKE '-$%' THEN coalesce(TRY_CAST('-' || regexp_extract(raw_value, '([0-9.]+)', 1) AS DOUBLE), 0)
   WHEN contains(raw_value, '$') THEN coalesce(TRY_CAST(regexp_extract(raw_value, '([0-9.]+)', 1) AS DOUBLE), 0)
   ELSE coalesce(TRY_CAST(raw_value AS DOUBLE), 0) END AS value,
   CASE WHEN contains(raw_value, '%') THEN '%' WHEN contains(raw_value, '$') THEN 'K' END AS unit FROM kpi""")
def _(t: Tables):
    parsed = t.kpi.select("id", "raw_value", values.parse_display_value(C("raw_value")).alias("p"))
    return parsed.select("id", "raw_value", C("p.value").alias("value"), C("p.unit").alias("unit"))


@query("parse_scaled_display", "SELECT id, raw_value, numeric_value AS value FROM parsed")
def _(t: Tables):
    return t.kpi.select("id", "raw_value", values.parse_scaled_display(C("raw_value")).alias("value"))


@query("format_usd", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v < 0 THEN '-' ELSE '' END || '$' ||
  CASE WHEN abs(v) >= 1e9 THEN printf('%.2f', abs(v) / 1e9) || 'B' WHEN abs(v) >= 1e6 THEN printf('%.1f', abs(v) / 1e6) || 'M'
       WHEN abs(v) >= 1e3 THEN printf('%.1f', abs(v) / 1e3) || 'K' ELSE printf('%.2f', abs(v)) END AS text
FROM (SELECT *, CASE l_linenumber WHEN 1 THEN l_extendedprice * 32768 WHEN 2 THEN -l_extendedprice * 64 WHEN 3 THEN l_extendedprice ELSE -l_quantity END AS v FROM lineitem)""")
def _(t: Tables):
    n, price = C("l_linenumber"), C("l_extendedprice")
    v = F.when(n == 1, price * 32768).when(n == 2, -price * 64).when(n == 3, price).otherwise(-C("l_quantity"))
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", formats.format_usd(v).alias("text"))


@query("format_metric", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN printf('%.2f', l_quantity) || '%' WHEN 2 THEN '$' || printf('%.1f', l_quantity) || 'M'
  WHEN 3 THEN '$' || printf('%.0f', l_quantity) || 'K' WHEN 4 THEN '$' || printf('%.2f', l_quantity) || 'B'
  ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS text FROM lineitem""")
def _(t: Tables):
    n = C("l_linenumber")
    unit = F.when(n == 1, "%").when(n == 2, "M").when(n == 3, "K").when(n == 4, "B")
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", formats.format_metric(C("l_quantity"), unit).alias("text"))


@query("sanitize_kpi_input", """
SELECT id, raw_value, CASE WHEN regexp_full_match(regexp_replace(raw_value, '[$,%\\s]', '', 'g'), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')
  THEN regexp_replace(raw_value, '[$,%\\s]', '', 'g') END AS cleaned FROM kpi""")
def _(t: Tables):
    return t.kpi.select("id", "raw_value", values.sanitize_kpi_input(C("raw_value")).alias("cleaned"))


@query("clean_filename", """
SELECT submission_id, CASE WHEN contains(s, '.') THEN replace(left(s, length(s) - length(split_part(s, '.', -1)) - 1), '.', '_') || '.' || split_part(s, '.', -1) ELSE s END AS name
FROM (SELECT submission_id, replace(replace(replace(replace(replace(original_filename, ' ', '_'), '&', 'and'), ',', ''), '(', ''), ')', '') AS s FROM subs)""")
def _(t: Tables):
    return t.subs.select("submission_id", text.clean_filename(C("original_filename")).alias("name"))


@query("strip_hash_prefix", "SELECT submission_id, substr(original_filename, 10) AS name FROM subs")
def _(t: Tables):
    return t.subs.select("submission_id", text.strip_hash_prefix(C("original_filename")).alias("name"))


@query("truncate_filename", """
SELECT submission_id, CASE WHEN length(f) <= 30 OR length(stem) <= 26 - length(ext) THEN f
   ELSE left(stem, greatest(26 - length(ext), 0)) || '...' || ext END AS name
FROM (SELECT submission_id, original_filename AS f, split_part(original_filename, '.', -1) AS ext,
  left(original_filename, length(original_filename) - length(split_part(original_filename, '.', -1)) - 1) AS stem FROM subs)""")
def _(t: Tables):
    return t.subs.select("submission_id", text.truncate_filename(C("original_filename")).alias("name"))


@query("safe_filename", "SELECT submission_id, replace(original_filename, ' ', '_') AS name FROM subs")
def _(t: Tables):
    return t.subs.select("submission_id", text.safe_filename(C("original_filename")).alias("name"))


@query("email_domain", """
SELECT submission_id, CASE WHEN seq % 5 = 0 THEN company_id WHEN founder_email IS NULL THEN 'pending_detection' ELSE split_part(founder_email, '@', -1) END AS domain FROM subs""")
def _(t: Tables):
    header = F.when(C("seq") % 5 == 0, C("company_id"))
    return t.subs.select("submission_id", text.company_domain(header, C("founder_email")).alias("domain"))


@query("title_kpi_label", """
SELECT kpi_key, CASE kpi_key WHEN 'revenue' THEN 'Revenue Total' WHEN 'cogs' THEN 'Costo de Ventas' WHEN 'ebitda' THEN 'EBITDA' WHEN 'mrr' THEN 'MRR'
  WHEN 'cac' THEN 'CAC' WHEN 'gmv' THEN 'GMV' WHEN 'churn_rate' THEN 'Churn Rate' WHEN 'npl_ratio' THEN 'NPL Ratio' WHEN 'loss_ratio' THEN 'Loss Ratio'
  WHEN 'gross_profit_margin' THEN 'Margen Bruto' WHEN 'ebitda_margin' THEN 'Margen EBITDA' WHEN 'revenue_growth' THEN 'Crecimiento de Revenue'
  WHEN 'portfolio_size' THEN 'Cartera de Créditos' WHEN 'annual_cash_flow' THEN 'Flujo de Caja Anual' WHEN 'unregistered_kpi' THEN 'Unregistered Kpi' END AS label,
  count(*) AS n FROM kpi GROUP BY ALL""")
def _(t: Tables):
    return t.kpi.groupBy("kpi_key").agg(F.count(F.lit(1)).alias("n")).select(
        "kpi_key", text.title_kpi_label(C("kpi_key")).alias("label"), "n"
    )


@query("capitalize", "SELECT p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS name FROM part")
def _(t: Tables):
    return t.raw("part").select("p_partkey", text.capitalize(C("p_type")).alias("name"))


@query("company_from_path", """
SELECT page_id, CASE WHEN len(string_split(url, '/')) >= 3 THEN string_split(url, '/')[2] ELSE 'unknown' END AS company FROM pages""")
def _(t: Tables):
    return t.raw("pages").select("page_id", text.company_from_path(C("url")).alias("company"))


@query("filter_supported_files", """
SELECT submission_id, original_filename, ext AS extension FROM
  (SELECT submission_id, original_filename, '.' || lower(split_part(original_filename, '.', -1)) AS ext FROM subs)
WHERE ext IN ('.pdf', '.csv', '.xlsx', '.xls', '.parquet', '.docx', '.doc')""")
def _(t: Tables):
    from ledgerloom.sources.files import filter_supported_files

    return filter_supported_files(t.subs.select("submission_id", "original_filename"), "original_filename")


@query("file_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS file_hash, substr(sha256(text), 1, 8) AS short_hash FROM documents")
def _(t: Tables):
    return t.raw("documents").select(
        "doc_id", text.file_hash(C("text")).alias("file_hash"), text.file_hash(C("text"), 8).alias("short_hash")
    )


@query("salted_hash", "SELECT submission_id, substr(sha256(company_id || ':' || period_id || ':' || CAST(seq AS VARCHAR)), 1, 16) AS file_hash FROM subs")
def _(t: Tables):
    return t.subs.select(
        "submission_id", text.salted_hash(C("company_id"), C("period_id"), C("seq").cast("string")).alias("file_hash")
    )


@query("detect_currency", "SELECT submission_id, CASE form WHEN 'empty' THEN currency ELSE currency END AS currency FROM docset")
def _(t: Tables):
    return t.docs.select("submission_id", documents.detect_currency(C("doc")).alias("currency"))


@query("period_year", "SELECT submission_id, period_id, report_year AS year FROM subs")
def _(t: Tables):
    return t.subs.select("submission_id", "period_id", periods.period_year(C("period_id"), F.lit(1999)).alias("year"))


@query("valid_period", "SELECT submission_id, period_id, seq % 20 <> 3 AS is_valid_period FROM subs")
def _(t: Tables):
    return t.subs.select("submission_id", "period_id", periods.valid_period(C("period_id")).alias("is_valid_period"))


@query("month_key", "SELECT submission_id, strftime(submitted_at, '%Y-%m') AS month FROM subs")
def _(t: Tables):
    return t.subs.select("submission_id", periods.month_key(C("submitted_at")).alias("month"))


@query("relative_age", """
SELECT event_id, CASE WHEN h < 1 THEN 'hace menos de 1 hora' WHEN h < 24 THEN 'hace ' || h || CASE WHEN h = 1 THEN ' hora' ELSE ' horas' END
   WHEN h // 24 < 30 THEN 'hace ' || (h // 24) || CASE WHEN h // 24 = 1 THEN ' día' ELSE ' días' END ELSE strftime(ts, '%Y-%m-%d') END AS age
FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2024-02-05 00:00:00') - epoch_us(ts)) / 3600000000) AS BIGINT) AS h FROM events)""")
def _(t: Tables):
    as_of = F.lit("2024-02-05 00:00:00").cast("timestamp_ntz")
    return t.raw("events").select("event_id", periods.relative_age(C("ts"), as_of).alias("age"))


@query("most_common_year", """
SELECT doc_id, year FROM (
  SELECT doc_id, year, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rn FROM (
    SELECT doc_id, unnest(ys) AS year, generate_subscripts(ys, 1) AS pos FROM (
      SELECT doc_id, regexp_extract_all(text || ' ' || CAST(2000 + doc_id % 100 AS VARCHAR), '\\b(20[0-9][0-9])\\b', 1) AS ys FROM documents))
  GROUP BY doc_id, year) WHERE rn = 1""")
def _(t: Tables):
    whole = F.concat_ws(" ", C("text"), (C("doc_id") % 100 + 2000).cast("string"))
    return t.raw("documents").select("doc_id", periods.most_common_year(whole).alias("year"))


@query("calc_origin", "SELECT id, CASE WHEN contains(coalesce(source_description, ''), 'calculated') THEN 'calculated' ELSE 'gemini' END AS origin FROM kpi")
def _(t: Tables):
    return t.kpi.select("id", classify.calc_origin(C("source_description")).alias("origin"))


@query("kpi_traffic_light", """
SELECT id, CASE WHEN NOT is_valid THEN 'missing' WHEN contains(coalesce(source_description, ''), 'calculated') THEN 'calculated'
   WHEN confidence < 0.70 THEN 'low_conf' ELSE 'ok' END AS status FROM parsed""")
def _(t: Tables):
    light = classify.kpi_traffic_light(C("is_valid"), C("numeric_value"), C("source_description"), C("confidence"))
    return t.parsed.select("id", light.alias("status"))


@query("confidence_tier", "SELECT id, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.70 THEN 'medium' WHEN confidence IS NOT NULL THEN 'low' END AS tier FROM kpi")
def _(t: Tables):
    return t.kpi.select("id", classify.confidence_tier(C("confidence")).alias("tier"))


@query("needs_review", "SELECT id, coalesce(confidence < 0.85, false) AS needs_review FROM kpi")
def _(t: Tables):
    return t.kpi.select("id", classify.needs_review(C("confidence")).alias("needs_review"))


@query("metric_color_band", """
SELECT id, kpi_key, CASE kpi_key WHEN 'revenue_growth' THEN CASE WHEN v > 20 THEN 'green' WHEN v > 0 THEN 'yellow' ELSE 'red' END
  WHEN 'ebitda_margin' THEN CASE WHEN v > 10 THEN 'green' WHEN v > 0 THEN 'yellow' ELSE 'red' END
  WHEN 'gross_profit_margin' THEN CASE WHEN v > 50 THEN 'green' WHEN v > 20 THEN 'yellow' ELSE 'red' END
  WHEN 'annual_cash_flow' THEN CASE WHEN v > 0 THEN 'green' ELSE 'red' END ELSE 'white' END AS band,
  CASE WHEN kpi_key = 'revenue_growth' THEN CASE WHEN v >= 40 THEN 'green' ELSE 'yellow' END
       WHEN kpi_key = 'gross_profit_margin' THEN CASE WHEN v >= 50 THEN 'green' ELSE 'yellow' END
       WHEN kpi_key = 'ebitda_margin' THEN CASE WHEN v >= 15 THEN 'green' ELSE 'yellow' END END AS founder_band
FROM (SELECT id, kpi_key, numeric_value * 9 AS v FROM parsed WHERE is_valid)""")
def _(t: Tables):
    rows = t.parsed.filter("is_valid").select("id", "kpi_key", (C("numeric_value") * 9).alias("v"))
    return rows.select(
        "id", "kpi_key", classify.metric_color_band(C("kpi_key"), C("v")).alias("band"),
        classify.founder_color_band(C("kpi_key"), C("v")).alias("founder_band"),
    )


@query("fx_normalize", "SELECT id, kpi_key, numeric_value, fx_rate, normalized_value_usd FROM facts")
def _(t: Tables):
    return t.facts.select("id", "kpi_key", "numeric_value", "fx_rate", "normalized_value_usd")


@query("fx_rate_join", """
SELECT s.submission_id, s.currency, s.report_year, (SELECT r.rate FROM dim_fx r WHERE r.currency = s.currency ORDER BY abs(r.year - s.report_year), r.year LIMIT 1) AS fx_rate FROM subs s""")
def _(t: Tables):
    return resolve.fx_rate_join(t.subs.select("submission_id", "currency", "report_year"))


TABLE_RATES = """
SELECT CASE s_nationkey % 3 WHEN 0 THEN 'MXN' WHEN 1 THEN 'BRL' ELSE 'EUR' END AS currency,
       CAST(2018 + 3 * (s_suppkey % 4) AS INT) AS year, max(1 + s_suppkey % 9 + s_nationkey / 100.0) AS rate
FROM {supplier} GROUP BY 1, 2"""


@query("to_usd_table_rates", f"""
WITH rates AS ({TABLE_RATES.format(supplier='supplier')})
SELECT id, currency, report_year, round(numeric_value / (SELECT r.rate FROM rates r WHERE r.currency = p.currency ORDER BY abs(r.year - p.report_year), r.year LIMIT 1), 6) AS usd FROM parsed p""")
def _(t: Tables):
    rates = t.spark.sql(TABLE_RATES, supplier=t.raw("supplier")).withColumn("rate", C("rate").cast("double"))
    rows = t.parsed.select("id", "currency", "report_year", "numeric_value")
    return resolve.to_usd(rows, "numeric_value", rates).drop("numeric_value")


@query("fx_rate_join_table", f"""
WITH rates AS ({TABLE_RATES.format(supplier='supplier')} UNION ALL SELECT 'mxn ', 2030, 99.5),
r AS (SELECT upper(trim(currency)) AS currency, year, min(rate) AS rate FROM rates GROUP BY 1, 2),
asked AS (SELECT DISTINCT currency, CASE WHEN submission_id LIKE '%7' THEN NULL ELSE report_year END AS y FROM subs),
known AS (SELECT a.currency, a.y, arg_min(r.rate, abs(r.year - a.y) * 10000 + r.year) AS rate FROM asked a JOIN r ON r.currency = a.currency GROUP BY 1, 2)
SELECT s.submission_id, s.currency, CAST(k.rate AS DOUBLE) AS fx_rate FROM subs s
LEFT JOIN known k ON k.currency = s.currency AND k.y = CASE WHEN s.submission_id LIKE '%7' THEN NULL ELSE s.report_year END""")
def _(t: Tables):
    """Nearest year in a table with gaps of three years, ties within them, an odd spelling, and rows without a year."""
    rates = t.spark.sql(TABLE_RATES + " UNION ALL SELECT 'mxn ', 2030, 99.5", supplier=t.raw("supplier")).withColumn("rate", C("rate").cast("double"))
    rows = t.subs.select("submission_id", "currency", F.when(~C("submission_id").endswith("7"), C("report_year")).alias("report_year"))
    return resolve.fx_rate_join(rows, rates).drop("report_year")


@query("supported_currencies", f"SELECT DISTINCT currency FROM ({TABLE_RATES.format(supplier='supplier')})")
def _(t: Tables):
    return resolve.supported_currencies(t.spark.sql(TABLE_RATES, supplier=t.raw("supplier")))


@query("to_usd_display", """
SELECT id, raw_value, CASE WHEN k.unit_type = 'usd' AND p.currency <> 'USD' AND u IS NOT NULL THEN
    CASE WHEN u < 0 THEN '-' ELSE '' END || '$' || CASE WHEN abs(u) >= 1e9 THEN printf('%.2f', abs(u) / 1e9) || 'B' WHEN abs(u) >= 1e6 THEN printf('%.1f', abs(u) / 1e6) || 'M'
    WHEN abs(u) >= 1e3 THEN printf('%.1f', abs(u) / 1e3) || 'K' ELSE printf('%.2f', abs(u)) END ELSE raw_value END AS display
FROM (SELECT f.id, f.raw_value, f.kpi_key, f.currency, f.numeric_value / f.fx_rate AS u FROM facts f) p LEFT JOIN dim_kpi k ON p.kpi_key = k.kpi_key""")
def _(t: Tables):
    rows = t.kpi.select("id", "raw_value", "kpi_key", "currency", "report_year")
    return resolve.to_usd_display(rows).select("id", "raw_value", "display")


@query("dashboard_extract", "SELECT submission_id, " + ", ".join(
    f"max(raw_value) FILTER (kpi_key = '{k}' AND NOT is_scalar) AS {k}" for k in dims.HEADLINE_KPIS) + " FROM docrows GROUP BY submission_id")
def _(t: Tables):
    return t.docs.select("submission_id", *[c.alias(k) for k, c in documents.dashboard_extract(C("doc")).items()])


HEADLINES = ", ".join(f"max(raw_value) FILTER (kpi_key = '{k}' AND NOT is_scalar) AS {k}" for k in dims.HEADLINE_KPIS)


@query("executive_summary", f"""
SELECT submission_id, CASE WHEN form = 'no_metrics' THEN 'No hay suficientes datos para generar un resumen ejecutivo.'
  WHEN parts = '' THEN 'El análisis procesado no encontró métricas suficientes. Verifica el documento subido.'
  ELSE 'La empresa reporta ' || parts || '. Los indicadores financieros presentan una base consolidada para el proceso de debida diligencia.' END AS summary
FROM (SELECT submission_id, form, concat_ws(', ',
    CASE WHEN revenue_growth <> '' THEN CASE WHEN n >= 40 THEN 'crecimiento excepcional del ' WHEN n >= 20 THEN 'crecimiento sólido del '
      WHEN n > 0 THEN 'crecimiento del ' ELSE 'contracción del ' END || revenue_growth END,
    'margen bruto de ' || gross_profit_margin, 'EBITDA de ' || ebitda_margin, 'posición de caja de ' || cash_in_bank_end_of_year,
    'flujo de caja anual de ' || annual_cash_flow, 'deuda de capital de trabajo de ' || working_capital_debt) AS parts
  FROM (SELECT *, TRY_CAST(replace(revenue_growth, '%', '') AS DOUBLE) AS n FROM (SELECT submission_id, any_value(form) AS form, {HEADLINES} FROM docrows GROUP BY submission_id)))""")
def _(t: Tables):
    has = documents.dig(C("doc"), [dims.ROOT]).isNotNull()
    rows = t.docs.select("submission_id", has.alias("has"), *[c.alias(k) for k, c in documents.dashboard_extract(C("doc")).items()])
    return rows.select("submission_id", formats.executive_summary({k: C(k) for k in dims.HEADLINE_KPIS}, C("has")).alias("summary"))


@query("founder_summary", f"""
SELECT submission_id, CASE WHEN form = 'no_metrics' THEN 'No hay datos financieros disponibles para generar un resumen ejecutivo.'
  WHEN parts = '' THEN 'El análisis financiero muestra una empresa estable pero con oportunidades de mejora en rentabilidad y crecimiento.'
  ELSE 'La empresa muestra ' || parts || '. Los indicadores sugieren una base financiera sólida con potencial para optimización operativa.' END AS summary
FROM (SELECT submission_id, form, concat_ws(', ',
    CASE WHEN revenue_growth <> '' THEN CASE WHEN n >= 40 THEN 'crecimiento excepcional del ' WHEN n >= 20 THEN 'crecimiento sólido del '
      WHEN n > 0 THEN 'crecimiento moderado del ' ELSE 'contracción del ' END || revenue_growth END,
    CASE WHEN TRY_CAST(replace(gross_profit_margin, '%', '') AS DOUBLE) >= 50 THEN 'márgenes saludables con ' || gross_profit_margin || ' de margen bruto' END,
    CASE WHEN TRY_CAST(replace(ebitda_margin, '%', '') AS DOUBLE) >= 15 THEN 'rentabilidad operativa fuerte con ' || ebitda_margin || ' de margen EBITDA' END,
    'posición de caja sólida con ' || cash_in_bank_end_of_year || ' en banco') AS parts
  FROM (SELECT *, TRY_CAST(replace(revenue_growth, '%', '') AS DOUBLE) AS n FROM (SELECT submission_id, any_value(form) AS form, {HEADLINES} FROM docrows GROUP BY submission_id)))""")
def _(t: Tables):
    has = documents.dig(C("doc"), [dims.ROOT]).isNotNull()
    rows = t.docs.select("submission_id", has.alias("has"), *[c.alias(k) for k, c in documents.dashboard_extract(C("doc")).items()])
    return rows.select("submission_id", formats.founder_summary({k: C(k) for k in dims.HEADLINE_KPIS}, C("has")).alias("summary"))


@query("rule_of_40", """
SELECT g.submission_id, g.numeric_value + e.numeric_value AS rule_of_40 FROM last_ok g JOIN last_ok e ON g.submission_id = e.submission_id
WHERE g.kpi_key = 'revenue_growth' AND e.kpi_key = 'ebitda_margin'""")
def _(t: Tables):
    wide = analytics.pivot_latest(t.parsed, ["submission_id"], ["revenue_growth", "ebitda_margin"], "row_seq")
    score = analytics.rule_of_40(C("revenue_growth"), C("ebitda_margin"))
    return wide.select("submission_id", score.alias("rule_of_40")).filter(C("rule_of_40").isNotNull())


@query("net_margin_proxy", """
SELECT g.submission_id, greatest(0.0, g.numeric_value - abs(e.numeric_value)) AS net_margin FROM last_ok g JOIN last_ok e ON g.submission_id = e.submission_id
WHERE g.kpi_key = 'gross_profit_margin' AND e.kpi_key = 'ebitda_margin'""")
def _(t: Tables):
    wide = analytics.pivot_latest(t.parsed, ["submission_id"], ["gross_profit_margin", "ebitda_margin"], "row_seq")
    both = wide.filter(C("gross_profit_margin").isNotNull() & C("ebitda_margin").isNotNull())
    return both.select("submission_id", analytics.net_margin_proxy(C("gross_profit_margin"), C("ebitda_margin")).alias("net_margin"))


@query("array_sorted_present", "SELECT submission_id, array_to_string(present_kpis, ',') AS present_kpis FROM present")
def _(t: Tables):
    rows = contract.present_kpis(t.parsed).filter(F.size("present_kpis") > 0)
    return rows.select("submission_id", F.array_join("present_kpis", ",").alias("present_kpis"))


@query("json_serialize", """
SELECT submission_id, count(*) FILTER (has_node) AS nodes, max(raw_value) FILTER (kpi_key = 'revenue') AS revenue FROM docrows GROUP BY submission_id""")
def _(t: Tables):
    again = t.docs.select("submission_id", F.to_json("doc").alias("raw_json"))
    parsed = documents.decoded_only(again)
    nodes = [documents.dig(C("doc"), p).isNotNull().cast("bigint") for p in dims.KPI_PATHS.values()]
    rev = documents.dig(C("doc"), dims.KPI_PATHS["revenue"])
    value = F.when(documents.is_object(rev), F.try_variant_get(rev, "$.value", "string")).otherwise(F.try_variant_get(rev, "$", "string"))
    return parsed.select("submission_id", sum(nodes[1:], nodes[0]).alias("nodes"), value.alias("revenue"))


@query("decode_json_doc", """
SELECT submission_id, form NOT IN ('broken', 'array', 'fenced') AS is_decoded FROM subs WHERE submission_id IN (SELECT submission_id FROM kpi)""")
def _(t: Tables):
    decoded = documents.decode_json_doc(t.raw_docs)
    return decoded.select("submission_id", C("doc").isNotNull().alias("is_decoded"))


@query("strip_code_fence", """
SELECT submission_id, form NOT IN ('broken', 'array') AS is_decoded FROM subs WHERE submission_id IN (SELECT submission_id FROM kpi)""")
def _(t: Tables):
    decoded = documents.decode_json_doc(t.raw_docs, fenced=True)
    return decoded.select("submission_id", C("doc").isNotNull().alias("is_decoded"))


@query("dig_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS below FROM events")
def _(t: Tables):
    doc = F.try_parse_json(C("props"))
    return t.raw("events").select(
        "event_id", documents.dig(doc, ["k"], "bigint").alias("k"), documents.dig(doc, ["k", "deeper"], "string").alias("below")
    )


@query("coerce_manual_fields", """
SELECT p_partkey, nullif(trim(CASE WHEN p_size % 7 = 0 THEN '  ' ELSE p_name END), '') AS p_name, CAST(p_size AS VARCHAR) AS p_size FROM part""")
def _(t: Tables):
    rows = t.raw("part").select("p_partkey", F.when(C("p_size") % 7 == 0, "  ").otherwise(C("p_name")).alias("p_name"), "p_size")
    return documents.coerce_manual_fields(rows, ["p_name", "p_size"])
