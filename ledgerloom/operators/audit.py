"""Data-quality rules before and after loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import dims
from ledgerloom.functions.periods import valid_period
from ledgerloom.functions.units import unit_mismatch
from ledgerloom.operators.resolve import company_bucket_substr, metric_dim_join, wrong_bucket
from ledgerloom.operators.skew import attach_by_key, count_by, written

#: Sectors that some metric belongs to.
SECTORS = sorted(set(dims.METRIC_BUCKET.values()))

FINDING = ["submission_id", "level", "check", "kpi_key", "detail"]


def _finding(df: DataFrame, level: str, check: str, kpi, detail) -> DataFrame:
    return df.select(
        "submission_id", F.lit(level).alias("level"), F.lit(check).alias("check"),
        kpi.alias("kpi_key"), detail.alias("detail"),
    )


def audit_period_format(submissions: DataFrame) -> DataFrame:
    period = F.coalesce("period_id", F.lit(""))
    return _finding(
        submissions.filter(~valid_period(period)), "error", "period_format", F.lit("*"),
        F.concat(
            F.lit("period_id '"), period,
            F.lit("' does not match expected formats (FY2025, H1 2025, Q4 2025, 2025M01)."),
        ),
    )


def orphan_detail(contract_id: str) -> Column:
    return F.concat(
        F.lit("kpi_row.submission_id '"), F.coalesce("submission_id", F.lit("None")),
        F.lit("' does not match contract submission_id '"), F.col(contract_id), F.lit("'."),
    )


def audit_orphan(rows: DataFrame, contract_id: str = "contract_id") -> DataFrame:
    """Rows whose submission_id is not the one of the contract they came with."""
    wrong = rows.filter(~F.col("submission_id").eqNullSafe(F.col(contract_id)))
    return _finding(wrong, "error", "orphan", F.col("kpi_key"), orphan_detail(contract_id))


def in_batch_duplicate(rows: DataFrame, order: str = "row_seq", row_id: str = "id") -> DataFrame:
    """Adds is_duplicate: true for the 2nd and later row of a (submission, kpi, period).

    The rows are worked out once, into a table; their keys alone are ranked there (one candidate per task and key
    reaches the shuffle), and the first rows are found again by their unique id.
    """
    rows = written(rows, "rows")
    window = Window.partitionBy("submission_id", "kpi_key", "period_id").orderBy(order, row_id)
    firsts = (
        rows.select("submission_id", "kpi_key", "period_id", order, row_id)
        .withColumn("__rank", F.row_number().over(window))
        .filter(F.col("__rank") == 1)
        .select(F.col(row_id).alias("__first"))
    )
    return (
        rows.join(firsts, F.col(row_id) == F.col("__first"), "left")
        .withColumn("is_duplicate", F.col("__first").isNull())
        .drop("__first")
    )


#: Copies of one finding that a task writes out at most.
COPIES = 100_000


def audit_duplicate(rows: DataFrame) -> DataFrame:
    """One finding per 2nd and later row of a (submission, kpi, period).

    These findings differ in their key only, so the rows are counted (before the shuffle too) and not ranked: a key of n
    rows gives n - 1 findings, written out in portions by as many tasks as it takes.
    """
    keys = ["submission_id", "kpi_key", "period_id"]
    repeated = count_by(rows, keys, "__n").filter("__n > 1").withColumn("__n", F.col("__n") - 1)
    portions = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPIES))
    dealt = repeated.withColumn("__portion", F.explode(portions)).repartition(*keys, "__portion")
    size = F.least(F.lit(COPIES).cast("long"), F.col("__n") - F.col("__portion") * COPIES)
    each = dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), size)))
    return _finding(
        each, "error", "duplicate", F.col("kpi_key"),
        F.concat(
            F.lit("Duplicate row detected for (kpi_key='"), F.col("kpi_key"), F.lit("', period_id='"),
            F.coalesce("period_id", F.lit("")), F.lit("'). Only one row per metric per period allowed."),
        ),
    )


def unknown_detail() -> Column:
    return F.concat(
        F.lit("Metric '"), F.col("kpi_key"),
        F.lit("' is not registered in DIM_METRIC. It will be discarded (not persisted)."),
    )


def audit_unknown_metric(rows: DataFrame) -> DataFrame:
    return _finding(
        rows.filter(~F.col("kpi_key").isin(dims.KPI_KEYS)), "error", "unknown_metric", F.col("kpi_key"), unknown_detail()
    )


def bucket_detail(company: str, bucket: str) -> Column:
    return F.concat(
        F.lit("Metric '"), F.col("kpi_key"), F.lit("' belongs to bucket '"), F.col("metric_bucket"),
        F.lit("' but company '"), F.col(company), F.lit("' is classified as '"), F.col(bucket),
        F.lit("'. (confidence="), F.col("confidence").cast("string"), F.lit(")"),
    )


def audit_bucket_mismatch(rows: DataFrame, company: str = "company_id", bucket: str = "bucket_id") -> DataFrame:
    """Metrics of another sector with a confidence above 0.95 (others are noise of the extraction)."""
    wrong = metric_dim_join(rows).filter(wrong_bucket(bucket))
    return _finding(wrong, "error", "bucket_mismatch", F.col("kpi_key"), bucket_detail(company, bucket))


def unit_detail() -> Column:
    return F.concat(
        F.lit("Expected unit '"), F.col("unit_expected"), F.lit("' for '"), F.col("kpi_key"),
        F.lit("', got '"), F.col("unit"), F.lit("'."),
    )


def audit_unit(rows: DataFrame) -> DataFrame:
    wrong = metric_dim_join(rows).filter(unit_mismatch(F.col("unit"), F.col("unit_expected")))
    return _finding(wrong, "warning", "unit_mismatch", F.col("kpi_key"), unit_detail())


def contract_findings(rows: DataFrame, submissions: DataFrame, mode: str = "reference") -> DataFrame:
    """All pre-load findings, one row each.

    ``rows``: KPI rows with contract_id, company_id, bucket_id, period_id, row_seq and a unique id. ``intended`` lets an
    unknown metric only be dropped (it becomes a warning).
    """
    joined = metric_dim_join(rows).withColumn("__contract", F.col("contract_id"))
    unknown_level = "warning" if mode == "intended" else "error"

    def entry(test: Column, level: str, check: str, detail: Column) -> Column:
        return F.when(
            test, F.struct(F.lit(level).alias("level"), F.lit(check).alias("check"), detail.alias("detail"))
        )

    # the rules that look at a single row share one pass over the rows
    per_row = F.array_compact(
        F.array(
            entry(~F.col("submission_id").eqNullSafe(F.col("contract_id")), "error", "orphan", orphan_detail("contract_id")),
            entry(F.col("unit_expected").isNull(), unknown_level, "unknown_metric", unknown_detail()),
            entry(wrong_bucket("bucket_id"), "error", "bucket_mismatch", bucket_detail("company_id", "bucket_id")),
            entry(unit_mismatch(F.col("unit"), F.col("unit_expected")), "warning", "unit_mismatch", unit_detail()),
        )
    )
    single = joined.select(F.col("__contract").alias("submission_id"), "kpi_key", F.explode(per_row).alias("f")).select(
        "submission_id", "f.level", "f.check", "kpi_key", "f.detail"
    )
    return single.unionByName(audit_duplicate(rows)).unionByName(audit_period_format(submissions))


def contract_audit(findings: DataFrame, submissions: DataFrame) -> DataFrame:
    """Verdict per submission: passed, counts by level, blocking errors (all but bucket_mismatch)."""
    error = F.col("level") == "error"
    counts = findings.groupBy("submission_id").agg(
        F.count_if(error).alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
        F.count_if(error & (F.col("check") != "bucket_mismatch")).alias("blocking_errors"),
    )
    zero = F.lit(0).cast("bigint")
    return submissions.select("submission_id", "bucket_id").join(counts, "submission_id", "left").select(
        "submission_id", "bucket_id",
        (F.coalesce("errors", zero) == 0).alias("passed"),
        F.coalesce("errors", zero).alias("errors"),
        F.coalesce("warnings", zero).alias("warnings"),
        F.coalesce("blocking_errors", zero).alias("blocking_errors"),
    )


def contract_verdicts(rows: DataFrame, submissions: DataFrame, mode: str = "reference", keep: list[str] | None = None) -> DataFrame:
    """``contract_audit`` of ``contract_findings`` from one pass over the rows: findings are counted, not listed.

    Rows without a contract_id and a bucket_id belong to the contract of their submission, whose bucket_id counts. ``keep``
    names columns of the submissions that go with the verdict.

    Rows are counted per submission and period first, with a number for each metric of the registry, before anything is
    shuffled or joined; only other metrics are told apart by name. A repeated metric is its count less one.
    """
    own = "contract_id" not in rows.columns
    metric = F.col("kpi_key")
    joined = metric_dim_join(rows)
    unknown = F.col("unit_expected").isNull()
    blocking = unknown.cast("long") if mode != "intended" else F.lit(0).cast("long")
    warning = F.coalesce(unit_mismatch(F.col("unit"), F.col("unit_expected")), F.lit(False)).cast("long")
    warning = warning + (unknown.cast("long") if mode == "intended" else F.lit(0))
    if own:
        # the sector is that of the contract, so confident rows are counted for each sector that a metric can have
        wrong = {s: F.count_if(F.coalesce((F.col("metric_bucket") == s) & (F.col("confidence") > dims.CONF_BUCKET_MISMATCH), F.lit(False))) for s in SECTORS}
    else:
        blocking = blocking + (~F.col("submission_id").eqNullSafe(F.col("contract_id"))).cast("long")
        wrong = {"wrong": F.count_if(F.coalesce(wrong_bucket("bucket_id"), F.lit(False)))}
    registered = F.coalesce(metric.isin(dims.KPI_KEYS), F.lit(False))
    key = ["period_id", "__registered", "__other"]
    named = joined.withColumns({"__registered": registered, "__other": F.when(~registered, metric)})
    numbers = {"n_" + k: F.count_if(metric == k) for k in dims.KPI_KEYS} | {"n_other": F.count_if(~registered)}
    found = {"blocking": F.sum(blocking), "warnings": F.sum(warning), **wrong}
    grouped = named.groupBy("submission_id", *([] if own else ["contract_id"]), *key).agg(*[c.alias(n) for n, c in (numbers | found).items()])
    zero = F.lit(0).cast("bigint")
    if own:
        per_key = grouped
    else:
        # what a row itself shows belongs to its contract, a repeated key to its submission; nearly always these are one
        def owned(owner: str, shows: set[str]) -> Column:
            return F.struct(F.col(owner).alias("owner"), *[(F.col(n) if n in shows else zero).alias(n) for n in numbers | found])

        one = F.array(owned("contract_id", {*numbers, *found}))
        apart = F.array(owned("contract_id", {*found}), owned("submission_id", {*numbers}))
        owners = F.when(F.col("submission_id").eqNullSafe(F.col("contract_id")), one).otherwise(apart)
        per_key = grouped.select(*key, F.inline(owners)).repartition("owner").groupBy("owner", *key).agg(*[F.sum(n).alias(n) for n in numbers | found])
        per_key = per_key.withColumnRenamed("owner", "submission_id")
    rows_of = sum((F.col(n) for n in numbers), zero)
    keys_of = sum(((F.col(n) > 0).cast("long") for n in numbers), zero)
    counts = per_key.groupBy("submission_id").agg(
        F.sum(rows_of).alias("__rows"), F.sum(keys_of).alias("__keys"), *[F.sum(n).alias("__" + n) for n in found]
    )
    bad_period = (~valid_period(F.coalesce("period_id", F.lit("")))).cast("long")
    # the rows of a contract that came twice count twice
    times = F.count(F.lit(1)).over(Window.partitionBy("submission_id")) if own else F.lit(1).cast("long")
    heads = submissions.select("submission_id", "bucket_id", *(keep or []), bad_period.alias("__bad_period"), times.alias("__times"))
    joint = heads.join(counts.hint("merge"), "submission_id", "left")

    def counted(name: str) -> Column:
        return F.coalesce(F.col("__times") * F.col("__" + name), zero)

    if own:
        sector = F.col("bucket_id")
        misplaced = sum((F.when((sector != "UNKNOWN") & (sector != s), counted(s)).otherwise(zero) for s in SECTORS), zero)
    else:
        misplaced = counted("wrong")
    repeated = F.greatest(counted("rows") - F.coalesce("__keys", zero), zero)
    blocking_errors = repeated + counted("blocking") + F.col("__bad_period")
    errors = blocking_errors + misplaced
    return joint.select(
        "submission_id", "bucket_id", *(keep or []), (errors == 0).alias("passed"), errors.alias("errors"),
        counted("warnings").alias("warnings"), blocking_errors.alias("blocking_errors"),
    )


def with_audit_bucket(submissions: DataFrame, names: list[tuple[str, str]] | None = None) -> DataFrame:
    return submissions.withColumn("bucket_id", company_bucket_substr(F.col("company_id"), names))


def dup_count(rows: DataFrame, keys: list[str] | None = None, row_limit: int | None = None) -> DataFrame:
    """Adds the number of rows with the same (submission, kpi, period); hot groups are split.

    The rows are worked out once, into a table, and counted there.
    """
    keys = keys or ["submission_id", "kpi_key", "period_id"]
    rows = written(rows, "rows")
    counts = count_by(rows, keys, "dup_count")
    extra = {} if row_limit is None else {"hot_rows": row_limit}
    return attach_by_key(rows, counts, keys, weight="dup_count", staged=True, **extra)


# Audit verdicts.
AUDIT_DUPLICATE = "ERROR: Duplicado"
AUDIT_INVALID = "ERROR: Valor no numérico"
AUDIT_CRITICAL = "ERROR: Confianza crítica (<0.70)"
AUDIT_LOW = "ADVERTENCIA: Confianza baja (<0.85)"


def post_load_audit(facts: DataFrame, submissions: DataFrame, portfolio_id: str | None = None,
                    ordered: bool = False) -> DataFrame:
    """Flagged rows of the latest submissions; a row gets the first status that applies.

    A null is_valid is neither valid nor invalid (three-valued logic). Facts meet their submissions once: the joined rows
    are written, and their duplicates counted there.
    """
    latest = submissions.filter(F.col("is_latest_version"))
    if portfolio_id is not None:
        latest = latest.filter(F.col("portfolio_id") == portfolio_id)
    heads = latest.select("submission_id", "company_id", "portfolio_id", "is_latest_version")
    rows = dup_count(facts.join(heads, "submission_id"))
    dup, invalid = F.col("dup_count") > 1, ~F.col("is_valid")
    flagged = rows.filter(dup | invalid | (F.col("confidence") < dims.CONF_REVIEW)).withColumn(
        "audit_status",
        F.when(dup, AUDIT_DUPLICATE)
        .when(invalid, AUDIT_INVALID)
        .when(F.col("confidence") < dims.CONF_CRITICAL, AUDIT_CRITICAL)
        .otherwise(AUDIT_LOW),
    )
    return flagged.orderBy(F.col("audit_status").desc(), "company_id", "kpi_key") if ordered else flagged


def ordered_findings(flagged: DataFrame) -> DataFrame:
    """Per submission its flagged rows as one text, ``kpi=count`` in the order of the KPIs.

    Rows are counted per KPI first, so a text has one entry for each KPI that the submission names, however many rows it has.
    """
    per_kpi = flagged.groupBy("submission_id", "kpi_key").agg(F.count(F.lit(1)).alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("kpi_key", "n")))
    entry = F.transform(listed, lambda r: F.concat(r["kpi_key"], F.lit("="), r["n"].cast("string")))
    return per_kpi.groupBy("submission_id").agg(F.array_join(entry, ";").alias("findings"))


def audit_counts(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("audit_status").startswith("ERROR")).alias("errors"),
        F.count_if(F.col("audit_status").startswith("ADVERTENCIA")).alias("warnings"),
    )
