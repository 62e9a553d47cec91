"""From KPI rows to submissions: roll-up, derived margins, checklist and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import dims
from ledgerloom.functions.classify import completeness_color, is_present
from ledgerloom.functions.formats import fixed_even

EXACT = "decimal(38,6)"


def exact_parts(value: Column) -> tuple[Column, Column]:
    """A double as the decimal of its first six places and the rest; the two sum up to it.

    Decimals add up alike in any order, and the rest is below their last place for all values that
    they can hold. Others (nan, inf, beyond 1e20) are all rest, so no value is left out.
    """
    exact = F.when(F.abs(value) < 1e20, value.try_cast(EXACT))
    return exact, value - F.coalesce(exact.cast("double"), F.when(value.isNotNull(), F.lit(0.0)))


def exact_total(exact: Column, rest: Column) -> Column:
    """Sum of values given in parts (columns to be summed up); null when there is none."""
    return F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.sum(rest)


def exact_avg(value: Column) -> Column:
    """Average of every value by one rule: the sum of its parts over its count."""
    return F.try_divide(exact_total(*exact_parts(value)), F.count(value).cast("double"))


def rounded_avg(value: Column, digits: int) -> Column:
    """Average rounded half up on its decimal form; of values no decimal can hold, as a double."""
    return _rounded(*_sums(value), digits)


def _sums(value: Column) -> list[Column]:
    """What an average takes from its values: the sums of their two parts, and their count."""
    return [*(F.sum(part) for part in exact_parts(value)), F.count(value)]


def _rounded(exact: Column, rest: Column, count: Column, digits: int) -> Column:
    whole = F.coalesce(exact, F.lit(0).cast(EXACT)) + F.coalesce(rest.try_cast(EXACT), F.lit(0).cast(EXACT))
    as_double = F.try_divide(F.coalesce(exact.cast("double"), F.lit(0.0)) + rest, count.cast("double"))
    return F.when(F.abs(rest) < 1e20, _ratio(whole, count, digits)).otherwise(F.round(as_double, digits))


def _ratio(total: Column, count: Column, digits: int) -> Column:
    return F.round(F.try_divide(total, count.cast("decimal(20,0)")), digits).cast("double")


def _judged_values(mode: str) -> tuple[Column, Column]:
    """Whether a row is valid, and the confidence that counts."""
    valid = F.coalesce(F.col("is_valid"), F.lit(False))
    return valid, F.when(valid, F.col("confidence")) if mode == "intended" else F.col("confidence")


def rollup_aggregates(mode: str = "reference") -> list[Column]:
    """What a submission's roll-up takes from its rows; ``rollup_columns`` makes the roll-up of it."""
    valid, conf = _judged_values(mode)
    # distinct periods are told apart by min and max, which needs no second shuffle
    periods = (F.min("period_id") == F.max("period_id")) & (F.count("period_id") == F.count(F.lit(1)))
    return [
        F.count(F.lit(1)).alias("kpi_count_total"),
        F.count_if(valid).alias("kpi_count_valid"),
        rounded_avg(conf, 3).alias("avg_confidence"),
        F.coalesce(periods, F.count("period_id") == 0).alias("period_consistent"),
    ]


def rollup_columns() -> list[Column]:
    return [
        F.col("kpi_count_total"),
        F.col("kpi_count_valid"),
        _ratio(F.col("kpi_count_valid").cast("decimal(20,0)"), F.col("kpi_count_total"), 2).alias("valid_ratio"),
        F.col("avg_confidence"),
        F.col("period_consistent"),
        submission_status(F.col("avg_confidence"), F.col("kpi_count_valid")).alias("status"),
    ]


def submission_rollup(rows: DataFrame, mode: str = "reference") -> DataFrame:
    """Per submission: counts, valid ratio, average confidence, period consistency and status.

    ``intended`` averages the confidence of valid rows only. Rows are counted per period first: numbers alone are grouped by hash,
    and texts, which are grouped by sorting, are those of one row per submission and period.
    """
    valid, conf = _judged_values(mode)
    exact, rest, count = _sums(conf)
    parts = rows.groupBy("submission_id", "period_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("valid"), exact.alias("exact"), rest.alias("rest"), count.alias("count")
    )
    named = F.coalesce(F.sum(F.when(F.col("period_id").isNotNull(), F.col("n"))), F.lit(0).cast("bigint"))
    periods = (F.min("period_id") == F.max("period_id")) & (named == F.sum("n"))
    whole = parts.groupBy("submission_id").agg(
        F.sum("n").alias("kpi_count_total"),
        F.sum("valid").alias("kpi_count_valid"),
        _rounded(F.sum("exact"), F.sum("rest"), F.sum("count"), 3).alias("avg_confidence"),
        F.coalesce(periods, named == 0).alias("period_consistent"),
    )
    return whole.select("submission_id", *rollup_columns())


def submission_status(avg_confidence: Column, valid_count: Column) -> Column:
    return (
        F.when(avg_confidence < dims.CONF_REVIEW, "pending_human_review")
        .when(valid_count > 0, "processed")
        .otherwise("empty")
    )


def period_consistency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("submission_id").agg((F.count_distinct("period_id") <= 1).alias("period_consistent"))


def row_warnings(rows: DataFrame) -> DataFrame:
    """Warning texts of single KPI rows, one row each: submission, order, text.

    Needs raw_value, is_valid, numeric_value, currency, report_year, fx_rate and, if present, node_warning.
    """
    key = F.col("kpi_key")
    node = F.col("node_warning") if "node_warning" in rows.columns else F.lit(None).cast("string")
    texts = F.array_compact(
        F.array(
            node,
            F.when(
                F.col("raw_value").isNotNull() & ~F.col("is_valid"),
                F.concat(
                    F.lit("KPI '"), key, F.lit("' value '"), F.col("raw_value"),
                    F.lit("' is not numeric — stored with is_valid=False"),
                ),
            ),
            F.when(
                F.col("is_valid") & (F.col("currency") != "USD") & F.col("fx_rate").isNull(),
                F.concat(
                    F.lit("KPI '"), key, F.lit("': no FX rate for "), F.col("currency"), F.lit("/"),
                    F.col("report_year").cast("string"), F.lit(" — normalized_value_usd is null. Add the currency to RATE_TABLE."),
                ),
            ),
        )
    )
    return rows.select("submission_id", key, F.explode(texts).alias("warning"))


def submission_warnings(rollup: DataFrame) -> DataFrame:
    """Warning texts of whole submissions, one row each."""
    texts = F.array_compact(
        F.array(
            F.when(
                F.col("kpi_count_valid") == 0,
                "No numeric KPI values were extracted. "
                "The document may not contain financial statements in a parseable format.",
            ),
            F.when(
                F.col("avg_confidence") < dims.CONF_REVIEW,
                F.concat(
                    F.lit("Average confidence "), fixed_even(F.col("avg_confidence"), 2),
                    F.lit(" is below threshold 0.85. Submission flagged for human review."),
                ),
            ),
        )
    )
    return rollup.select("submission_id", F.lit("*").alias("kpi_key"), F.explode(texts).alias("warning"))


def period_warnings(rows: DataFrame) -> DataFrame:
    """Submissions of more than one period, with the periods in order (an absent one is None)."""
    named = F.coalesce(F.concat(F.lit("'"), F.col("period_id"), F.lit("'")), F.lit("None"))
    periods = rows.groupBy("submission_id").agg(F.array_sort(F.collect_set(named)).alias("periods")).filter(F.size("periods") > 1)
    text = F.concat(
        F.lit("Multiple period_ids detected: {"), F.array_join("periods", ", "),
        F.lit("}. Check that the document covers a single fiscal year."),
    )
    return periods.select("submission_id", F.lit("*").alias("kpi_key"), text.alias("warning"))


def integrity_warnings(rows: DataFrame, rollup: DataFrame) -> DataFrame:
    """All warnings, one row per text; a list per submission could grow without bound."""
    return row_warnings(rows).unionByName(submission_warnings(rollup)).unionByName(period_warnings(rows))


def base_values(rows: DataFrame, order: str = "row_seq") -> DataFrame:
    """Per submission: the last valid value of each margin input and which margins have a row.

    Grouped with period and currency first: numbers alone are grouped by hash, and the texts are compared among few rows.
    """
    present = is_present(F.col("is_valid"), F.col("numeric_value"))
    inputs = ["revenue", "cogs", "ebitda"]

    def last_valid(key: str) -> list[Column]:
        chosen = present & (F.col("kpi_key") == key)
        value, place = F.when(chosen, F.col("numeric_value")), F.when(chosen, F.col(order))
        return [F.max_by(value, place).alias(key), F.max(place).alias("__" + key)]

    def any_row(key: str, only_valid: bool) -> Column:
        hit = F.col("kpi_key") == key
        return F.coalesce(F.bool_or(hit & present if only_valid else hit), F.lit(False))

    flags = {
        "gross_row": any_row("gross_profit_margin", False),
        "ebitda_row": any_row("ebitda_margin", False),
        "gross_valid": any_row("gross_profit_margin", True),
        "ebitda_valid": any_row("ebitda_margin", True),
    }
    parts = rows.groupBy("submission_id", "period_id", "currency").agg(
        *[c for key in inputs for c in last_valid(key)], *[flag.alias(name) for name, flag in flags.items()]
    )
    return parts.groupBy("submission_id").agg(
        *[F.max_by(key, "__" + key).alias(key) for key in inputs],
        *[F.bool_or(name).alias(name) for name in flags],
        F.max("period_id").alias("period_id"),
        F.max("currency").alias("original_currency"),
    )


def derive_margins(rows: DataFrame, order: str = "row_seq", mode: str = "reference") -> DataFrame:
    """Margins computed from revenue, cogs and ebitda where the submission has none.

    ``reference`` skips a margin that has any row, ``intended`` one that has a valid row.
    """
    suffix = "valid" if mode == "intended" else "row"
    base = base_values(rows, order).filter(F.col("revenue") != 0)
    gross = F.when(~F.col("gross_" + suffix), (F.col("revenue") - F.col("cogs")) / F.col("revenue"))
    ebitda = F.when(~F.col("ebitda_" + suffix), F.col("ebitda") / F.col("revenue"))
    derived = base.select(
        "submission_id", "period_id", "original_currency",
        F.inline(
            F.array(
                F.struct(F.lit("gross_profit_margin").alias("kpi_key"),
                         F.lit("Gross Profit Margin (calc)").alias("kpi_label"), gross.alias("ratio")),
                F.struct(F.lit("ebitda_margin").alias("kpi_key"),
                         F.lit("EBITDA Margin (calc)").alias("kpi_label"), ebitda.alias("ratio")),
            )
        ),
    ).filter(F.col("ratio").isNotNull())
    usd = F.col("original_currency") == "USD"
    value = F.round("ratio", 6)
    return derived.select(
        "submission_id", "kpi_key", "kpi_label",
        F.concat(F.round(F.col("ratio") * 100, 4).cast("string"), F.lit("%")).alias("raw_value"),
        value.alias("numeric_value"),
        F.lit("%").alias("unit"),
        "period_id",
        F.lit("calculated").alias("source_description"),
        F.lit(True).alias("is_valid"),
        "original_currency",
        F.when(usd, F.lit(1.0)).alias("fx_rate"),
        F.when(usd, value).alias("normalized_value_usd"),
        F.lit(1.0).alias("confidence"),
    )


def append_derived(rows: DataFrame, derived: DataFrame) -> DataFrame:
    return rows.unionByName(derived, allowMissingColumns=True)


def required_kpis(bucket: Column) -> Column:
    """Required KPI keys of a sector, in order; empty for an unknown one."""
    chosen = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, keys in dims.SECTOR_REQUIREMENTS.items():
        chosen = chosen.when(bucket == name, F.array(*[F.lit(k) for k in keys]))
    return chosen.otherwise(F.array().cast("array<string>"))


def sector_label(bucket: Column) -> Column:
    label = F.when(F.lit(False), F.lit(""))
    for name, text in dims.SECTOR_LABELS.items():
        label = label.when(bucket == name, text)
    return label.otherwise(bucket)


def present_kpis(rows: DataFrame) -> DataFrame:
    """Per submission the sorted valid KPIs, of the registry or not; a document names a bounded number of them.

    Those of the registry are flags, grouped by hash; only other names are collected, from one row per submission and name.
    """
    key = F.col("kpi_key")
    present = F.coalesce(is_present(F.col("is_valid"), F.col("numeric_value")), F.lit(False))
    other = F.when(present & ~key.isin(dims.KPI_KEYS), key).alias("__other")
    flags = rows.groupBy("submission_id", other).agg(*[F.coalesce(F.bool_or(present & (key == k)), F.lit(False)).alias(k) for k in dims.KPI_KEYS])
    whole = flags.groupBy("submission_id").agg(*[F.bool_or(k).alias(k) for k in dims.KPI_KEYS], F.collect_set("__other").alias("__others"))
    named = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in dims.KPI_KEYS]))
    return whole.select("submission_id", F.array_sort(F.concat(named, "__others")).alias("present_kpis"))


def key_difference(required: Column, present: Column) -> Column:
    return F.array_except(required, present)


def extra_kpis(required: Column, present: Column) -> Column:
    return F.array_except(present, required)


def union_distinct_keys(required: Column, present: Column) -> Column:
    return F.array_union(required, present)


def checklist_columns(df: DataFrame, bucket: str = "bucket_id") -> DataFrame:
    """required_kpis, missing_kpis, is_complete and display_message for rows with present_kpis."""
    sector = F.col(bucket)
    df = df.withColumn("present_kpis", F.coalesce("present_kpis", F.array().cast("array<string>")))
    df = df.withColumn("required_kpis", required_kpis(sector))
    df = df.withColumn("missing_kpis", key_difference(F.col("required_kpis"), F.col("present_kpis")))
    missing = F.array_join("missing_kpis", ", ")
    message = (
        F.when(
            F.size("required_kpis") == 0,
            F.concat(F.lit("Sector '"), sector, F.lit("' sin checklist definido — revisa SECTOR_REQUIREMENTS.")),
        )
        .when(
            F.size("missing_kpis") == 0,
            F.concat(F.lit("Reporte "), sector, F.lit(" completo. Todos los KPIs criticos presentes.")),
        )
        .otherwise(
            F.concat(F.lit("Atencion: Reporte "), sector_label(sector), F.lit(" incompleto. Faltan: "), missing, F.lit("."))
        )
    )
    return df.withColumns({"is_complete": F.size("missing_kpis") == 0, "display_message": message})


def sector_checklist(rows: DataFrame, submissions: DataFrame, bucket: str = "bucket_id") -> DataFrame:
    """Checklist of every submission (submission_id and its sector)."""
    heads = submissions.select("submission_id", bucket)
    return checklist_columns(heads.join(present_kpis(rows).hint("merge"), "submission_id", "left"), bucket)


def checklist_missing(rows: DataFrame, submissions: DataFrame, bucket: str = "bucket_id") -> DataFrame:
    """One row per required KPI without a valid value: submission, kpi, position in the checklist."""
    listed = sector_checklist(rows, submissions, bucket)
    return listed.select(
        "submission_id", bucket, "required_kpis", F.explode("missing_kpis").alias("kpi_key")
    ).select(
        "submission_id", bucket, "kpi_key", F.array_position("required_kpis", F.col("kpi_key")).cast("int").alias("ordinal")
    )


def completeness(df: DataFrame) -> DataFrame:
    """Percentage of required KPIs present and its colour, for checklist rows."""
    total = F.size("required_kpis")
    ok = total - F.size("missing_kpis")
    return df.withColumns(
        {
            "completeness_pct": F.when(total > 0, F.floor(ok * 100 / total + 0.5).cast("int")).otherwise(0),
            "completeness_color": completeness_color(F.size("missing_kpis")),
        }
    )


def bucket_visible_kpis(rows: DataFrame, bucket: str = "bucket_id") -> DataFrame:
    """Rows of KPIs a sector's view shows, with their group (base or sector)."""
    visible = F.broadcast(dims.dim_visible(rows.sparkSession)).withColumnRenamed("bucket_id", "__bucket")
    known = F.when(F.col(bucket).isin(list(dims.SECTOR_VISIBLE)), F.col(bucket)).otherwise("OTH")
    return rows.withColumn("__b", known).join(
        visible, (F.col("__b") == F.col("__bucket")) & (rows["kpi_key"] == visible["kpi_key"]), "inner"
    ).drop("__b", "__bucket", visible["kpi_key"])
