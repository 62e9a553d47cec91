"""Fidelity report: identity, recalculation and checklist of every submission in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import dims
from ledgerloom.functions.classify import calc_origin, is_present
from ledgerloom.functions.formats import fixed_even
from ledgerloom.operators.contract import key_difference, present_kpis, required_kpis, rollup_aggregates, rollup_columns, sector_label
from ledgerloom.operators.resolve import bucket_of, dim_identity_join
from ledgerloom.operators.skew import attach_by_key, written

DERIVABLE = {"gross_profit_margin": "(revenue - cogs) / revenue", "ebitda_margin": "ebitda / revenue"}


def fidelity_identity(submissions: DataFrame, dim: DataFrame, expected: Column | None = None) -> DataFrame:
    """Identity findings per submission (company_key, status, avg_confidence, is_latest_version given)."""
    joined = dim_identity_join(submissions, dim)
    joined = joined.withColumn("bucket_expected", bucket_of(F.col("company_key")) if expected is None else expected)
    differs = (F.col("bucket_in_db") != "") & (F.col("bucket_in_db") != F.col("bucket_expected"))
    stale = ~F.coalesce("is_latest_version", F.lit(False))
    findings = F.array_compact(
        F.array(
            F.when(
                ~F.col("in_dim_company"),
                F.concat(
                    F.lit("ERROR: company_id '"), F.col("company_id"), F.lit("' (key='"), F.col("company_key"),
                    F.lit("') no encontrado en dim_company."),
                ),
            ),
            F.when(
                differs,
                F.concat(
                    F.lit("ERROR: Bucket mismatch — dim_company tiene '"), F.col("bucket_in_db"),
                    F.lit("' pero el registro tiene '"), F.col("bucket_expected"), F.lit("'."),
                ),
            ),
            F.when(stale, "WARN: Esta submission no es la version mas reciente (is_latest_version=FALSE)."),
            F.when(
                F.col("status") == "pending_human_review",
                F.concat(
                    F.lit("WARN: Submission marcada como pending_human_review (avg_confidence="),
                    F.coalesce(F.col("avg_confidence").cast("string"), F.lit("None")), F.lit(")."),
                ),
            ),
        )
    )
    joined = joined.withColumn("identity_findings", findings)
    return joined.withColumns(
        {
            "bucket_match": F.coalesce(F.col("bucket_in_db") == F.col("bucket_expected"), F.lit(False)),
            "identity_errors": F.size(F.filter("identity_findings", lambda x: x.startswith("ERROR"))),
            "identity_warnings": F.size(F.filter("identity_findings", lambda x: x.startswith("WARN"))),
            "identity_findings": F.when(
                F.size("identity_findings") == 0,
                F.array(F.lit("OK: Identidad verificada — empresa en portafolio oficial con bucket correcto.")),
            ).otherwise(F.col("identity_findings")),
        }
    )


def stored_aggregates(order: str = "row_seq") -> list[Column]:
    """The stored number of each margin and its inputs (the last row of a repeated KPI)."""

    def last(key: str) -> Column:
        seq = F.when(F.col("kpi_key") == key, F.col(order))
        return F.max_by("numeric_value", seq).alias("v_" + key)

    return [last(k) for k in ("revenue", "cogs", "ebitda", *DERIVABLE)]


def stored_values(facts: DataFrame, order: str = "row_seq") -> DataFrame:
    """``stored_aggregates`` per submission, and its number of rows."""
    return facts.groupBy("submission_id").agg(*stored_aggregates(order), F.count(F.lit(1)).alias("__rows"))


def margin_columns(stored: DataFrame) -> DataFrame:
    """Recalculated margins next to the stored values, and whether their inputs are all there."""
    rev = F.col("v_revenue")
    recalculated = {
        "gross_profit_margin": F.when(rev != 0, (rev - F.col("v_cogs")) / rev),
        "ebitda_margin": F.when(rev != 0, F.col("v_ebitda") / rev),
    }
    needs = {"gross_profit_margin": F.col("v_cogs"), "ebitda_margin": F.col("v_ebitda")}
    columns: dict[str, Column] = {}
    for key, value in recalculated.items():
        columns["r_" + key] = value
        columns["deps_" + key] = rev.isNotNull() & needs[key].isNotNull()
    return stored.withColumns(columns)


def recalc_margins(facts: DataFrame, order: str = "row_seq", mode: str = "reference") -> DataFrame:
    """Every KPI row with origin, recalculated value, difference in percentage points and status.

    More than 2 points is ERROR, more than 0.5 WARN. ``reference`` compares the stored number as
    it is; ``intended`` first turns extracted percentages ("68%") into ratios.
    """
    facts = written(facts, "facts")
    per_submission = margin_columns(stored_values(facts, order))
    rows = attach_by_key(facts, per_submission, ["submission_id"], weight="__rows", staged=True).drop("__rows")
    key = F.col("kpi_key")

    def pick(prefix: str) -> Column:
        chosen = F.when(key == "gross_profit_margin", F.col(prefix + "gross_profit_margin"))
        return chosen.when(key == "ebitda_margin", F.col(prefix + "ebitda_margin"))

    origin = calc_origin(F.col("source_description"))
    rows = rows.withColumns({"origin": origin, "__value": pick("r_"), "__deps": pick("deps_"), "__stored": pick("v_")})
    stored = F.col("__stored")
    if mode == "intended":
        percent = F.col("raw_value").contains("%") & (F.col("origin") != "calculated")
        stored = F.when(percent, stored / 100).otherwise(stored)
    delta = F.abs(stored - F.col("__value")) * 100
    extracted_ok = F.when((F.col("origin") == "gemini") & F.col("__stored").isNotNull(), "OK").otherwise("N/A")
    status = (
        F.when(
            key.isin(list(DERIVABLE)),
            F.when(~F.col("__deps"), extracted_ok)
            .when(F.col("__value").isNull(), "N/A")
            .when(stored.isNull(), "WARN")
            .when(delta > 2.0, "ERROR")
            .when(delta > 0.5, "WARN")
            .otherwise("OK"),
        )
        .when(F.col("origin") == "calculated", "WARN")
        .when(F.col("is_valid"), "OK")
        .otherwise("WARN")
    )
    formula = F.create_map(*[F.lit(x) for pair in DERIVABLE.items() for x in pair])
    pair_text = F.concat(
        F.lit("pp — almacenado="), fixed_even(stored, 4), F.lit(" vs recalculado="), fixed_even(F.col("__value"), 4)
    )
    finding = (
        F.when(
            key.isin(list(DERIVABLE)) & F.col("__deps") & F.col("__value").isNotNull(),
            F.when(
                stored.isNull(),
                F.concat(
                    F.lit("WARN ["), key, F.lit("]: Valor no almacenado pero recalculable = "),
                    fixed_even(F.col("__value"), 4), F.lit("."),
                ),
            )
            .when(
                delta > 2.0,
                F.concat(
                    F.lit("ERROR ["), key, F.lit("]: Discrepancia alta de "), fixed_even(delta, 2), pair_text,
                    F.lit(" ("), F.try_element_at(formula, key), F.lit(")."),
                ),
            )
            .when(
                delta > 0.5,
                F.concat(F.lit("WARN ["), key, F.lit("]: Discrepancia menor de "), fixed_even(delta, 2), pair_text, F.lit(".")),
            ),
        )
        .when(
            ~key.isin(list(DERIVABLE)) & (F.col("origin") == "calculated"),
            F.concat(F.lit("WARN ["), key, F.lit("]: source='calculated' pero no es un KPI derivable conocido.")),
        )
    )
    return rows.select(
        *facts.columns,
        "origin",
        F.round("__value", 6).alias("recalculated_value"),
        F.round(delta, 4).alias("delta_pct_points"),
        status.alias("calc_status"),
        finding.alias("calc_finding"),
        (delta > 0.5).alias("__large"),
    ).withColumn("is_discrepancy", F.coalesce("__large", F.lit(False))).drop("__large")


def fidelity_calculator(facts: DataFrame, order: str = "row_seq", mode: str = "reference") -> DataFrame:
    """Calculator audit per submission: rows by status, discrepancies, errors and warnings found."""
    rows = recalc_margins(facts, order, mode)
    return rows.groupBy("submission_id").agg(
        F.count_if(F.col("calc_status") == "OK").alias("ok_rows"),
        F.count_if(F.col("calc_status") == "WARN").alias("warn_rows"),
        F.count_if(F.col("calc_status") == "ERROR").alias("error_rows"),
        F.count_if("is_discrepancy").alias("discrepancies"),
        F.count_if(F.col("calc_finding").startswith("ERROR")).alias("calc_errors"),
        F.count_if(F.col("calc_finding").startswith("WARN")).alias("calc_warnings"),
    )


def calc_row_split(rows: DataFrame) -> DataFrame:
    """Adds the row groups of the report: extracted & valid, calculated, recalculable, significant."""
    valid = F.coalesce(F.col("is_valid"), F.lit(False))
    recalculable = F.col("recalculated_value").isNotNull()
    return rows.withColumns(
        {
            "is_extracted_valid": (F.col("origin") == "gemini") & valid,
            "is_calculated": F.col("origin") == "calculated",
            "is_recalculable": recalculable,
            "is_significant": valid | recalculable,
        }
    )


def fidelity_checklist(facts: DataFrame, identity: DataFrame) -> DataFrame:
    """Checklist diagnosis per submission; the sector comes from the company table, else the registry."""
    bucket = F.coalesce(F.when(F.col("bucket_in_db") != "", F.col("bucket_in_db")), F.col("bucket_expected"))
    heads = identity.select("submission_id", bucket.alias("bucket_id"))
    df = heads.join(present_kpis(facts), "submission_id", "left")
    df = df.withColumn("present_kpis", F.coalesce("present_kpis", F.array().cast("array<string>")))
    df = df.withColumn("required_kpis", required_kpis(F.col("bucket_id")))
    df = df.withColumn("missing_kpis", key_difference(F.col("required_kpis"), F.col("present_kpis")))
    label, none = sector_label(F.col("bucket_id")), F.size("required_kpis") == 0
    complete = F.size("missing_kpis") == 0
    message = (
        F.when(none, F.concat(F.lit("Sector '"), F.col("bucket_id"), F.lit("' sin checklist definido en SECTOR_REQUIREMENTS.")))
        .when(
            complete,
            F.concat(
                F.lit("Reporte "), label, F.lit(" COMPLETO — todos los KPIs criticos presentes: "),
                F.array_join("required_kpis", ", "), F.lit("."),
            ),
        )
        .otherwise(F.concat(F.lit("Reporte "), label, F.lit(" INCOMPLETO — faltan: "), F.array_join("missing_kpis", ", "), F.lit(".")))
    )
    return df.withColumns(
        {"is_complete": complete, "display_message": message, "checklist_warnings": (none | ~complete).cast("int")}
    )


def fidelity_verdict(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "FAIL").when(warnings > 0, "WARN").otherwise("PASS")


#: KPIs that some sector requires, in one order: bit k of a mask stands for the k-th.
REQUIRED = sorted({key for keys in dims.SECTOR_REQUIREMENTS.values() for key in keys})


def _required_mask(bucket: Column) -> Column:
    masks = {sector: sum(1 << REQUIRED.index(k) for k in keys) for sector, keys in dims.SECTOR_REQUIREMENTS.items()}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in masks.items() for x in pair]), bucket), F.lit(0)).cast("long")


def _percent(mode: str) -> Column:
    """Rows whose margin was extracted as a percentage, which ``intended`` turns into a ratio."""
    if mode != "intended":
        return F.lit(False)
    return F.coalesce(F.col("raw_value").contains("%") & (calc_origin(F.col("source_description")) != "calculated"), F.lit(False))


def fidelity_aggregates(order: str = "row_seq", mode: str = "reference") -> list[Column]:
    """All that the report takes from the rows of a submission, as one aggregate.

    Rows of a margin differ for the report only in whether they are percentages, so they are counted by that; whether they
    are findings follows from the submission's stored values. Required KPIs with a valid value are bits of one number.
    """
    key, percent = F.col("kpi_key"), _percent(mode)
    present = is_present(F.col("is_valid"), F.col("numeric_value"))
    bits = F.create_map(*[F.lit(x) for k, name in enumerate(REQUIRED) for x in (name, 1 << k)])
    mask = F.when(present, F.try_element_at(bits, key).cast("long"))
    counts = [F.count_if((key == k) & (percent == p)).alias(f"n_{k}_{p}") for k in DERIVABLE for p in (False, True)]
    other = ~key.isin(list(DERIVABLE)) & (calc_origin(F.col("source_description")) == "calculated")
    return [*stored_aggregates(order), F.bit_or(mask).alias("present_mask"), *counts, F.count_if(other).alias("n_other")]


def _margin_counts() -> dict[str, Column]:
    """Discrepancies, errors and warnings of a submission from ``fidelity_aggregates``."""
    zero = F.lit(0).cast("bigint")
    large, errors, warnings = zero, zero, F.coalesce("n_other", zero)
    for key in DERIVABLE:
        value, known = F.col("r_" + key), F.col("deps_" + key) & F.col("r_" + key).isNotNull()
        for percent in (False, True):
            stored = F.col("v_" + key) / 100 if percent else F.col("v_" + key)
            delta = F.abs(stored - value) * 100
            rows = F.coalesce(f"n_{key}_{percent}", zero)
            large = large + F.when(delta > 0.5, rows).otherwise(zero)
            errors = errors + F.when(known & (delta > 2.0), rows).otherwise(zero)
            warnings = warnings + F.when(known & (stored.isNull() | ((delta > 0.5) & ~(delta > 2.0))), rows).otherwise(zero)
    return {"discrepancies": large, "calc_errors": errors, "calc_warnings": warnings}


def fidelity_report(facts: DataFrame, submissions: DataFrame, dim: DataFrame, order: str = "row_seq",
                    mode: str = "reference", expected: Column | None = None) -> DataFrame:
    """One verdict per submission from the three audits; a filter on submission_id is pushed down.

    The facts are read once and meet the submissions as one row each: all three audits are worked out from that row.
    Submissions stored without status and average confidence get them from the same pass (facts then need
    confidence and period_id; a submission without rows has no roll-up and is left out).
    """
    stored = "status" in submissions.columns
    aggregates = fidelity_aggregates(order, mode) + ([] if stored else rollup_aggregates(mode))
    per_submission = facts.groupBy("submission_id").agg(*aggregates)
    if not stored:
        kept = [c for c in per_submission.columns if c not in ("submission_id", "kpi_count_total", "kpi_count_valid", "avg_confidence", "period_consistent")]
        per_submission = per_submission.select("submission_id", *kept, *rollup_columns())
    heads = submissions.drop(*[c for c in per_submission.columns if c != "submission_id"]).join(per_submission, "submission_id", "left" if stored else "inner")
    identity = margin_columns(fidelity_identity(heads, dim, expected)).withColumns(_margin_counts())
    bucket = F.coalesce(F.when(F.col("bucket_in_db") != "", F.col("bucket_in_db")), F.col("bucket_expected"))
    required = _required_mask(bucket)
    complete = required.bitwiseAND(F.coalesce("present_mask", F.lit(0).cast("long"))) == required
    incomplete = ((required == 0) | ~complete).cast("int")
    errors = F.col("identity_errors") + F.col("calc_errors")
    warnings = F.col("identity_warnings") + F.col("calc_warnings") + incomplete
    return identity.select(
        "submission_id", "company_id", complete.alias("is_complete"), "discrepancies",
        errors.alias("errors"), warnings.alias("warnings"), (errors + warnings).alias("total_findings"),
        fidelity_verdict(errors, warnings).alias("overall_status"),
    )
