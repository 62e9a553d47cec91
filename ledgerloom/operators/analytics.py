"""Portfolio analytics, dashboards, top-k reports and history metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import dims
from ledgerloom.functions import text, values
from ledgerloom.functions.periods import month_key
from ledgerloom.operators.contract import exact_avg, exact_parts, exact_total
from ledgerloom.operators.skew import attach_by_key, count_by, written


def portfolio_analytics(facts: DataFrame, submissions: DataFrame, portfolio_id: str | None = None,
                        metrics: list[str] | None = None, mode: str = "reference", ordered: bool = False) -> DataFrame:
    """Per (month, company, fund): number of submissions and the average of each metric over valid rows.

    The facts are summed per submission before the join, so what meets the submissions is one
    narrow row each and counting distinct submissions becomes counting rows. ``intended`` looks
    at the latest versions only.
    """
    metrics = metrics or dims.HEADLINE_KPIS
    heads = submissions
    if portfolio_id is not None:
        heads = heads.filter(F.col("portfolio_id") == portfolio_id)
    if mode == "intended":
        heads = heads.filter(F.col("is_latest_version"))
    sums: list[Column] = []
    for m in metrics:
        exact, rest = exact_parts(F.when(F.col("kpi_key") == m, F.col("numeric_value")))
        sums += [F.sum(exact).alias("s_" + m), F.sum(rest).alias("r_" + m), F.count(rest).alias("n_" + m)]
    per_submission = facts.filter("is_valid").groupBy("submission_id").agg(*sums)
    joined = per_submission.join(heads.select("submission_id", "submitted_at", "company_id", "portfolio_id"), "submission_id")
    series = joined.groupBy(month_key(F.col("submitted_at")).alias("month"), "company_id", "portfolio_id").agg(
        F.count(F.lit(1)).alias("submission_count"),
        *[
            F.try_divide(exact_total(F.col("s_" + m), F.col("r_" + m)), F.sum("n_" + m).cast("double")).alias(m)
            for m in metrics
        ],
    )
    return series.orderBy("month", "company_id") if ordered else series


def portfolio_summary(series: DataFrame) -> DataFrame:
    """One row: submissions, companies and month range. The list of companies is its own table."""
    return series.agg(
        F.sum("submission_count").alias("total_submissions"),
        F.count_distinct("company_id").alias("companies_count"),
        F.min("month").alias("min_month"),
        F.max("month").alias("max_month"),
    )


def summary_companies(series: DataFrame) -> DataFrame:
    return series.select("company_id").filter(F.col("company_id") != "").distinct().orderBy("company_id")


def company_metric_avg(series: DataFrame, metrics: list[str]) -> DataFrame:
    """Per company the mean of the monthly means (months without a value are skipped)."""
    return series.groupBy("company_id").agg(*[exact_avg(F.col(m)).alias(m) for m in metrics])


def scaled_bars(averages: DataFrame, metrics: list[str]) -> DataFrame:
    """Each mean as a percentage of the largest absolute mean (at least 1), with its sign.

    The maximum is a scalar subquery, not a window over all rows.
    """
    largest = averages.select(
        F.greatest(F.lit(1.0), F.max(F.greatest(*[F.coalesce(F.abs(F.col(m)), F.lit(0.0)) for m in metrics]))).alias("top")
    ).scalar()
    bars = F.array(*[F.struct(F.lit(m).alias("kpi_key"), F.col(m).alias("mean")) for m in metrics])
    return (
        averages.select("company_id", F.inline(bars))
        .withColumn("largest", largest)
        .select(
            "company_id", "kpi_key", "mean",
            (F.least(F.abs("mean") / F.col("largest"), F.lit(1.0)) * 100).alias("pct"),
            (F.col("mean") < 0).alias("is_negative"),
        )
    )


def bucket_counts(dim: DataFrame) -> DataFrame:
    return dim.groupBy("portfolio_id", "portfolio_name").agg(
        F.count(F.lit(1)).alias("total_companies"),
        *[F.count_if(F.col("bucket_id") == b).alias(b.lower()) for b in dims.SECTOR_REQUIREMENTS],
    )


def portfolio_companies(dim: DataFrame, portfolio_id: str | None = None) -> DataFrame:
    """Companies of every fund by name, one row each (a fund may hold any number of them)."""
    chosen = dim if portfolio_id is None else dim.filter(F.col("portfolio_id") == portfolio_id)
    return chosen.select(
        "portfolio_id", F.concat(F.lit("Fondo "), F.col("portfolio_id")).alias("portfolio_name"),
        text.capitalize(F.col("company_key")).alias("company"),
    ).orderBy("portfolio_id", "company")


def duplicate_filenames(results: DataFrame, name: str = "original_filename", row_limit: int | None = None) -> DataFrame:
    """Adds the cleaned file name, how often it occurs and whether it is repeated."""
    cleaned = written(results.withColumn("clean_name", text.strip_hash_prefix(F.col(name))), "results")
    extra = {} if row_limit is None else {"hot_rows": row_limit}
    counted = attach_by_key(cleaned, count_by(cleaned, ["clean_name"], "name_count"), ["clean_name"],
                            weight="name_count", staged=True, **extra)
    return counted.withColumn("is_duplicate", F.col("name_count") > 1)


def result_fund(stored: Column, email: Column, names: list[tuple[str, str]] | None = None) -> Column:
    """Stored fund, else the fund of the company named in the e-mail; null when none is."""
    from ledgerloom.operators.resolve import lookup_portfolio

    found = lookup_portfolio(email, names)
    return F.coalesce(stored, F.when(found != "unknown", found))


def filter_portfolio_results(results: DataFrame, active: str, known: list[str] | None = None,
                             fund: str = "fund") -> DataFrame:
    """Results of the active fund and those whose fund is not a known one."""
    known = dims.FUNDS if known is None else known
    pid = F.col(fund)
    return results.filter((pid == active) | pid.isNull() | ~pid.isin(known))


def fund_result_count(results: DataFrame, funds: list[str], fund: str = "fund") -> DataFrame:
    """Results shown per fund (its own plus the unassigned ones), in one aggregation."""
    pid = F.col(fund)
    unassigned = pid.isNull() | ~pid.isin(funds)
    counts = results.agg(*[F.count_if((pid == f) | unassigned).alias(f) for f in funds])
    pairs = F.array(*[F.struct(F.lit(f).alias("fund"), F.col(f).alias("results")) for f in funds])
    return counts.select(F.inline(pairs))


def results_newest_first(results: DataFrame, date: str = "processed_at", tie: str = "id") -> DataFrame:
    """Sorted by date text, newest first; a missing date reads ``unknown`` and so comes first."""
    dated = results.withColumn("date", F.coalesce(F.col(date).cast("string"), F.lit("unknown")))
    return dated.orderBy(F.col("date").desc(), tie)


def recent_results(results: DataFrame, active: str | None, known: list[str] | None = None, limit: int = 10,
                   date: str = "processed_at", tie: str = "id", fund: str = "fund") -> DataFrame:
    """First ``limit`` results of the filtered list, of all results when the filter leaves none.

    Both cases are one top-k: rows of the filtered list sort before the rest, and the rest is
    kept only when the filtered list is empty.
    """
    known = dims.FUNDS if known is None else known
    pid = F.col(fund)
    shown = F.lit(True) if active is None else (pid == active) | pid.isNull() | ~pid.isin(known)
    dated = results.withColumns(
        {"date": F.coalesce(F.col(date).cast("string"), F.lit("unknown")), "__shown": F.coalesce(shown, F.lit(False))}
    )
    top = dated.orderBy(F.col("__shown").desc(), F.col("date").desc(), tie).limit(limit)
    any_shown = F.max("__shown").over(Window.partitionBy(F.lit(1)))  # at most `limit` rows
    return top.withColumn("__any", any_shown).filter(F.col("__shown") | ~F.col("__any")).drop("__shown", "__any")


def first_result_per_portfolio(results: DataFrame, fund: str = "portfolio_id", date: str = "processed_at",
                               tie: str = "id") -> DataFrame:
    """Newest result of every fund; one candidate per task and fund is shuffled."""
    window = Window.partitionBy(fund).orderBy(F.coalesce(F.col(date).cast("string"), F.lit("unknown")).desc(), tie)
    return results.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") == 1).drop("__rank")


CONTEXT_ROWS = 400


def rag_context_topk(facts: DataFrame, submissions: DataFrame, portfolio_id: str | None = None,
                     company: str | None = None, limit: int = CONTEXT_ROWS, mode: str = "reference",
                     tie: str = "id") -> DataFrame:
    """Valid KPI rows with a text of the newest submissions, at most ``limit`` (a top-k report).

    The company filter is a case-insensitive pattern between wildcards.
    """
    heads = submissions
    if portfolio_id:
        heads = heads.filter(F.col("portfolio_id") == portfolio_id)
    if company:
        heads = heads.filter(F.lower("company_id").like(f"%{company.lower()}%"))
    if mode == "intended":
        heads = heads.filter(F.col("is_latest_version"))
    valid = facts.filter(F.col("is_valid") & F.col("raw_value").isNotNull()).select(
        "submission_id", tie, "kpi_label", "raw_value", "unit", "period_id"
    )
    joined = valid.join(heads.select("submission_id", "company_id", "portfolio_id", "submitted_at"), "submission_id")
    return joined.orderBy(F.col("submitted_at").desc(), tie).limit(limit)


def context_text(rows: DataFrame, tie: str = "id") -> DataFrame:
    """Header and one line per context row, newest first, as one text (the input is the top-k report)."""
    cells = [F.coalesce(F.col(c), F.lit("—")) for c in
             ("company_id", "portfolio_id", "period_id", "kpi_label", "raw_value", "unit")]
    line = F.concat_ws(" | ", *cells)
    # sort key first: the newest line leads, ties by row id
    lines = F.sort_array(
        F.collect_list(F.struct((-F.unix_micros(F.col("submitted_at").cast("timestamp"))).alias("age"), F.col(tie).alias("tie"), line.alias("line")))
    )
    body = F.array_join(F.transform(lines, lambda r: r["line"]), "\n")
    header = F.lit("empresa | fondo | período | kpi | valor | unidad\n")
    return rows.agg(
        F.when(F.count(F.lit(1)) > 0, F.concat(header, body))
        .otherwise("No hay datos financieros para el contexto solicitado.")
        .alias("context_text")
    )


def comparison_table(results: DataFrame, name: str = "original_filename", growth: str = "revenue_growth",
                     margin: str = "ebitda_margin") -> DataFrame:
    """Growth and margin as displayed numbers with a 20-character label."""
    short = F.concat(F.substring(text.strip_hash_prefix(F.col(name)), 1, 20), F.lit("..."))
    return results.withColumns(
        {
            "label": short,
            "growth_value": values.parse_display_value(F.col(growth))["value"],
            "margin_value": values.parse_display_value(F.col(margin))["value"],
        }
    )


def rule_of_40(growth: Column, ebitda_margin: Column) -> Column:
    return growth + ebitda_margin


def net_margin_proxy(gross: Column, ebitda: Column) -> Column:
    return F.greatest(F.lit(0.0), gross - F.abs(ebitda))


def pivot_latest(rows: DataFrame, keys: list[str], metrics: list[str], order: str) -> DataFrame:
    """One column per metric: the last valid value of each per key."""
    return rows.filter("is_valid").groupBy(*keys).agg(
        *[
            F.max_by("numeric_value", F.when(F.col("kpi_key") == m, F.col(order))).alias(m)
            for m in metrics
        ]
    )


def kpi_history(rows: DataFrame, keys: list[str], period: str, value: str = "value") -> DataFrame:
    """One value per key and period (the average), so a history is as short as its calendar."""
    return rows.groupBy(*keys, period).agg(exact_avg(F.col(value)).alias(value))


def history_tail(history: DataFrame, keys: list[str], period: str, n: int = 4) -> DataFrame:
    """Last ``n`` periods of every key, oldest first."""
    window = Window.partitionBy(*keys).orderBy(F.col(period).desc())
    tail = history.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= n)
    return tail.withColumn("position", (F.lit(n + 1) - F.col("__rank")).cast("int")).drop("__rank")


def anomaly_flag(new: Column, old: Column, mode: str = "reference") -> Column:
    """Change of more than half; 0 before is never an anomaly, nor (``reference``) a negative value before."""
    base = F.abs(old) if mode == "intended" else old
    return F.when(old == 0, F.lit(False)).otherwise(F.try_divide(F.abs(new - old), base) > 0.5)


def anomaly_vs_history(history: DataFrame, keys: list[str], period: str, value: str = "value",
                       mode: str = "reference") -> DataFrame:
    """Each period against the one before. ``history`` has one row per key and period."""
    window = Window.partitionBy(*keys).orderBy(period)
    with_old = history.withColumn("previous", F.lag(value).over(window))
    flag = anomaly_flag(F.col(value), F.col("previous"), mode)
    return with_old.withColumn("is_anomaly", F.coalesce(flag, F.lit(False)))


def burn_multiple(history: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Net burn over net new recurring revenue since the period before (columns net_burn, arr)."""
    window = Window.partitionBy(*keys).orderBy(period)
    new = F.col("arr") - F.lag("arr").over(window)
    return history.withColumn("net_new_arr", new).withColumn(
        "burn_multiple", F.try_divide(F.col("net_burn"), F.col("net_new_arr"))
    )


def magic_number(history: DataFrame, keys: list[str], period: str) -> DataFrame:
    """New recurring revenue per unit of the spend of the period before (columns arr, spend)."""
    window = Window.partitionBy(*keys).orderBy(period)
    new = F.col("arr") - F.lag("arr").over(window)
    return history.withColumn("net_new_arr", new).withColumn(
        "magic_number", F.try_divide(F.col("net_new_arr"), F.lag("spend").over(window))
    )


def l3m_cmgr(history: DataFrame, keys: list[str], month_index: str, value: str = "value") -> DataFrame:
    """Compound monthly growth over three months; null without a positive value three months back."""
    window = Window.partitionBy(*keys).orderBy(month_index).rangeBetween(-3, -3)
    past = F.max(value).over(window)
    ratio = F.when((past > 0) & (F.col(value) > 0), F.col(value) / past)
    return history.withColumn("l3m_cmgr", F.pow(ratio, F.lit(1.0 / 3.0)) - 1)


def net_dollar_retention(revenue: DataFrame, period: str = "period_index", customer: str = "customer",
                         value: str = "value") -> DataFrame:
    """Per period: revenue of the customers of the period before over their revenue then.

    Revenue is summed per customer and period, shifted by one period and joined by equality.
    """
    exact, rest = exact_parts(F.col(value).cast("double"))
    per_customer = revenue.groupBy(customer, period).agg(F.sum(exact).alias("v"), F.sum(rest).alias("r"))
    before = per_customer.select(customer, (F.col(period) + 1).alias(period), F.col("v").alias("v_before"), F.col("r").alias("r_before"))
    joined = before.join(per_customer, [customer, period], "left")
    return joined.groupBy(period).agg(
        exact_total(F.col("v_before"), F.col("r_before")).alias("base_revenue"),
        F.coalesce(exact_total(F.col("v"), F.col("r")), F.lit(0.0)).alias("retained_revenue"),
    ).withColumn("ndr", F.try_divide(F.col("retained_revenue"), F.col("base_revenue")))
