"""Stored tables: schemas, appends, duplicates, versions, edits and dimension upserts.

Built-in file tables have no row-level MERGE, so every change is a DataFrame that is then
written as a new snapshot (or appended), never an in-place update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ledgerloom.functions.values import with_parsed
from ledgerloom.operators.resolve import lookup_portfolio
from ledgerloom.operators.skew import attach_by_key

# Stored table layouts (name, type, required).
SUBMISSIONS_LAYOUT = [
    ("submission_id", "string", True), ("file_hash", "string", True), ("company_id", "string", True),
    ("founder_email", "string", False), ("original_filename", "string", False),
    ("submitted_at", "timestamp", True), ("period_id", "string", False), ("period_consistent", "boolean", False),
    ("kpi_count_total", "bigint", False), ("kpi_count_valid", "bigint", False), ("status", "string", False),
    ("avg_confidence", "double", False), ("is_latest_version", "boolean", False), ("raw_gemini", "string", False),
    ("created_at", "timestamp", False), ("detected_currency", "string", False), ("portfolio_id", "string", False),
]
FACT_LAYOUT = [
    ("id", "string", True), ("submission_id", "string", True), ("kpi_key", "string", True),
    ("kpi_label", "string", False), ("raw_value", "string", False), ("numeric_value", "double", False),
    ("unit", "string", False), ("period_id", "string", False), ("source_description", "string", False),
    ("is_valid", "boolean", False), ("created_at", "timestamp", False), ("is_manually_edited", "boolean", False),
    ("edited_at", "timestamp", False), ("edited_raw_value", "string", False), ("original_currency", "string", False),
    ("fx_rate", "double", False), ("normalized_value_usd", "double", False), ("confidence", "double", False),
]
DIM_COMPANY_LAYOUT = [
    ("company_key", "string", True), ("company_name", "string", True), ("portfolio_id", "string", True),
    ("portfolio_name", "string", False), ("bucket_id", "string", False), ("updated_at", "timestamp", False),
]


def layout_schema(layout: list[tuple[str, str, bool]]) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{n} {t}" for n, t, _ in layout))


def conform(rows: DataFrame, layout: list[tuple[str, str, bool]]) -> DataFrame:
    """Exactly the target columns: cast, absent ones null, unknown ones dropped."""
    have = set(rows.columns)
    return rows.select(
        *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t, _ in layout]
    )


def missing_required(rows: DataFrame, layout: list[tuple[str, str, bool]]) -> Column:
    """True for a row that lacks a required value."""
    tests = F.lit(False)
    for name, _, required in layout:
        if required:
            tests = tests | F.col(name).isNull()
    return tests


def append_rows(rows: DataFrame, path: str, layout: list[tuple[str, str, bool]],
                partition_by: list[str] | None = None) -> None:
    """Append with the target layout; a row without a required value stops the write."""
    ready = conform(rows, layout)
    checked = ready.withColumn(
        layout[0][0],
        F.when(missing_required(ready, layout), F.raise_error(F.lit("required value missing")).cast(layout[0][1]))
        .otherwise(F.col(layout[0][0])),
    )
    writer = checked.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def evolve_schema(stored: DataFrame, layout: list[tuple[str, str, bool]]) -> DataFrame:
    """Add only the missing columns, as nulls; existing ones stay in place. Running it again changes nothing."""
    have = set(stored.columns)
    return stored.select("*", *[F.lit(None).cast(t).alias(n) for n, t, _ in layout if n not in have])


def read_or_empty(spark: SparkSession, path: str, layout: list[tuple[str, str, bool]]) -> DataFrame:
    """A stored table with the full layout, or an empty one when nothing was written yet."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
    if not exists:
        return spark.createDataFrame([], layout_schema(layout))
    return spark.read.schema(layout_schema(layout)).parquet(path)


def replace_dim(dim: DataFrame, path: str) -> None:
    """Truncate and reload a dimension."""
    conform(dim, DIM_COMPANY_LAYOUT).write.mode("overwrite").parquet(path)


def dedup_by_hash(submissions: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First submission per content hash. Only one candidate per hash and input task is shuffled."""
    order = order or ["submitted_at", "submission_id"]
    window = Window.partitionBy("file_hash").orderBy(*order)
    ranked = submissions.withColumn("__rank", F.row_number().over(window))
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def dedup_against_store(incoming: DataFrame, stored: DataFrame, staged: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, duplicate report with the stored id) by content hash (``staged``: the incoming rows are a written table)."""
    known = stored.groupBy("file_hash").agg(F.min("submission_id").alias("stored_submission_id"))
    marked = attach_by_key(incoming, known, ["file_hash"], staged=staged)
    stored_id = F.col("stored_submission_id")
    return marked.filter(stored_id.isNull()).drop("stored_submission_id"), marked.filter(stored_id.isNotNull()).select(
        "submission_id", "file_hash", "stored_submission_id"
    )


def latest_ids(submissions: DataFrame) -> DataFrame:
    """Id of the newest submission of every (company, period); empty company or period is left out."""
    window = Window.partitionBy("company_id", "period_id").orderBy(
        F.col("submitted_at").desc(), F.col("submission_id").desc()
    )
    named = submissions.filter((F.col("company_id") != "") & (F.col("period_id") != ""))
    return (
        named.select("submission_id", "company_id", "period_id", "submitted_at")
        .withColumn("__rank", F.row_number().over(window))
        .filter(F.col("__rank") == 1)
        .select("submission_id")
    )


def latest_version(submissions: DataFrame) -> DataFrame:
    """Adds is_latest_version: true for the newest of its (company, period), and where one is empty.

    The newest ids are found first (one candidate per task and key reaches the shuffle) and
    joined by id, which is unique, so a company with very many submissions is not one task.
    """
    newest = latest_ids(submissions).withColumnRenamed("submission_id", "__newest")
    unnamed = ~F.coalesce((F.col("company_id") != "") & (F.col("period_id") != ""), F.lit(False))
    return (
        submissions.join(newest, F.col("submission_id") == F.col("__newest"), "left")
        .withColumn("is_latest_version", F.col("__newest").isNotNull() | unnamed)
        .drop("__newest")
    )


def retire_versions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored submissions with the flag dropped where a new one arrived for the same (company, period)."""
    touched = (
        incoming.filter((F.col("company_id") != "") & (F.col("period_id") != ""))
        .groupBy("company_id", "period_id")
        .agg(F.lit(True).alias("__touched"))
    )
    marked = attach_by_key(stored, touched, ["company_id", "period_id"])
    return marked.withColumn(
        "is_latest_version", F.when(F.col("__touched"), F.lit(False)).otherwise(F.col("is_latest_version"))
    ).drop("__touched")


def last_edits(edits: DataFrame) -> DataFrame:
    """Per (submission, kpi): the last edit and the text of the one before it."""
    window = Window.partitionBy("submission_id", "kpi_key").orderBy(
        F.col("edited_at").desc(), F.col("value").desc_nulls_last()
    )
    two = edits.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= 2)
    last, before = F.col("__rank") == 1, F.col("__rank") == 2
    return two.groupBy("submission_id", "kpi_key").agg(
        F.max(F.when(last, F.col("value"))).alias("new_raw"),
        F.max(F.when(last, F.col("edited_at"))).alias("new_edited_at"),
        F.bool_or(before).alias("edited_before"),
        F.max(F.when(before, F.col("value"))).alias("before_raw"),
    )


def apply_kpi_edits(facts: DataFrame, edits: DataFrame) -> DataFrame:
    """Facts after the corrections: text, number, unit, validity, edit flag, time and previous text.

    Every row of an edited (submission, kpi) changes; of several edits the last one counts and
    the text before it is kept.
    """
    # a (submission, kpi) holds a handful of rows
    joined = attach_by_key(facts, last_edits(edits), ["submission_id", "kpi_key"], small_keys=True)
    edited = F.col("new_edited_at").isNotNull()
    present = set(facts.columns)

    def keep(name: str, kind: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast(kind)

    return (
        with_parsed(joined, F.col("new_raw"), "__value", "__unit")
        .withColumns(
            {
                "edited_raw_value": F.when(
                    edited, F.when(F.col("edited_before"), F.col("before_raw")).otherwise(F.col("raw_value"))
                ).otherwise(keep("edited_raw_value", "string")),
                "is_manually_edited": F.when(edited, F.lit(True)).otherwise(keep("is_manually_edited", "boolean")),
                "edited_at": F.when(edited, F.col("new_edited_at")).otherwise(keep("edited_at", "timestamp_ntz")),
                "raw_value": F.when(edited, F.col("new_raw")).otherwise(F.col("raw_value")),
                "numeric_value": F.when(edited, F.col("__value")).otherwise(F.col("numeric_value")),
                "unit": F.when(edited, F.col("__unit")).otherwise(F.col("unit")),
                "is_valid": F.when(edited, F.col("__value").isNotNull()).otherwise(F.col("is_valid")),
            }
        )
        .drop("__value", "__unit", "new_raw", "new_edited_at", "edited_before", "before_raw")
    )


def edits_not_found(facts: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits whose (submission, kpi) has no row."""
    return edits.join(facts.select("submission_id", "kpi_key"), ["submission_id", "kpi_key"], "left_anti")


def changed_metrics(stored: DataFrame, edited: DataFrame, keys: list[str]) -> DataFrame:
    """Edited values that differ from the stored ones (null counts as empty): keys, old and new text."""
    old = stored.select(*keys, F.col("value").alias("old_value"))
    new = edited.select(*keys, F.col("value").alias("new_value"))
    both = new.join(old, keys, "left")
    return both.filter(~F.col("new_value").eqNullSafe(F.coalesce("old_value", F.lit(""))))


def delete_by_hash(stored: DataFrame, targets: DataFrame) -> DataFrame:
    """Stored results without the (company_domain, file_hash) pairs to delete; facts stay."""
    return stored.join(targets, ["company_domain", "file_hash"], "left_anti")


def deleted_counts(stored: DataFrame, targets: DataFrame) -> DataFrame:
    """How many stored results each target removes (0 when it is not found)."""
    found = stored.groupBy("company_domain", "file_hash").agg(F.count(F.lit(1)).alias("deleted"))
    return targets.distinct().join(found, ["company_domain", "file_hash"], "left").withColumn(
        "deleted", F.coalesce("deleted", F.lit(0).cast("bigint"))
    )


def merge_dim(target: DataFrame, source: DataFrame, key: str = "company_key") -> DataFrame:
    """Upsert: a source row replaces the target row with its key, other target rows stay."""
    columns = [c for c in target.columns if c != key]
    new = source.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias("__n_" + c) for c in columns])
    both = target.join(new, key, "full_outer")
    return both.select(key, *[F.when(F.col("__new"), F.col("__n_" + c)).otherwise(F.col(c)).alias(c) for c in columns])


def fill_portfolio(submissions: DataFrame, names: list[tuple[str, str]] | None = None) -> DataFrame:
    """Fund from the company id where none was given."""
    given = F.when(F.col("portfolio_id") != "", F.col("portfolio_id"))
    return submissions.withColumn("portfolio_id", F.coalesce(given, lookup_portfolio(F.col("company_id"), names)))
