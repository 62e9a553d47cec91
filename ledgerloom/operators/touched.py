"""Stored tables kept in slots: a batch rewrites only the slots that its keys fall into.

A slot is the head of the MD5 of the key, a directory of the table. A batch reads the slots it touches (the file
listing is pruned to them), works out their new rows, writes these beside the table under the batch's name, and then
puts them in place by dynamic partition overwrite. Files of other slots are not read, moved or written. If the job or
the driver is lost, a repeated batch finds its complete result and puts the same rows in place again; the table is
never read once its own overwrite may have begun.

The number of slots, 16 ** digits, is chosen once for a table (2 digits: 256; 3: 4,096). Slots are balanced as they are
written (rebalance hint), so one with a hot key becomes several files from several tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerloom.operators.store import apply_kpi_edits, latest_version

SLOT = "slot"


def slot_of(keys: list[str], digits: int = 2) -> Column:
    """Slot of a row: the first ``digits`` hexadecimal digits of the MD5 of its keys (null counts as empty)."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.substring(F.md5(text.cast("binary")), 1, digits)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _fs(spark, path)
    return files.exists(hadoop)


def _others_deleted(spark: SparkSession, folder: str, keep: str) -> None:
    """Results of earlier batches, already in place, are taken away."""
    files, hadoop = _fs(spark, folder)
    for entry in files.listStatus(hadoop):
        if entry.getPath().getName() != keep:
            files.delete(entry.getPath(), True)


def with_slot(schema: T.StructType) -> T.StructType:
    return T.StructType([*[f for f in schema.fields if f.name != SLOT], T.StructField(SLOT, T.StringType())])


def read_slots(spark: SparkSession, path: str, schema: T.StructType, slots: list[str] | None = None) -> DataFrame:
    """Rows of the named slots (None: all), with their slot; no rows where nothing is stored yet."""
    schema = with_slot(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(schema).parquet(path)
    return stored if slots is None else stored.filter(F.col(SLOT).isin(slots))


def write_slots(rows: DataFrame, path: str, keys: list[str], digits: int = 2) -> None:
    """A new table in slots."""
    rows.withColumn(SLOT, slot_of(keys, digits)).hint("rebalance", F.col(SLOT)).write.partitionBy(SLOT).parquet(path)


def rewrite_touched(
    path: str,
    batch: DataFrame,
    batch_id: str | int,
    schema: T.StructType,
    keys: list[str],
    change: Callable[[DataFrame, DataFrame], DataFrame],
    digits: int = 2,
) -> None:
    """``change(stored, batch)`` gives all rows of the touched slots anew, from their stored rows and the batch.

    A change keeps at least one row in every touched slot, as inserts, flags and edits do.
    """
    spark = batch.sparkSession
    schema = with_slot(schema)
    folder = f"{path}/_batches"
    result = f"{folder}/{batch_id}"
    if not exists(spark, f"{result}/_SUCCESS"):
        batch = batch.withColumn(SLOT, slot_of(keys, digits)).persist()
        try:
            touched = [row[SLOT] for row in batch.select(SLOT).distinct().collect()]  # at most 16 ** digits
            changed = change(read_slots(spark, path, schema, touched), batch).select(*schema.names)
            changed.hint("rebalance", F.col(SLOT)).write.mode("overwrite").partitionBy(SLOT).parquet(result)
        finally:
            batch.unpersist()
    ready = spark.read.schema(schema).parquet(result)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SLOT).parquet(path)
    _others_deleted(spark, folder, str(batch_id))


# ---- submissions: versions ------------------------------------------------------------------

VERSION_KEYS = ["company_id", "period_id"]


def upsert_latest(path: str, batch: DataFrame, batch_id: str | int, digits: int = 2) -> None:
    """Submissions inserted, or replaced under their id, with is_latest_version right for every stored row.

    All versions of a (company, period) lie in one slot, so the flags of the touched slots are all that can change.
    """
    schema = T.StructType([*[f for f in batch.schema.fields if f.name not in ("is_latest_version", SLOT)], T.StructField("is_latest_version", T.BooleanType())])

    def change(stored: DataFrame, incoming: DataFrame) -> DataFrame:
        incoming = incoming.drop("is_latest_version").dropDuplicates(["submission_id"])
        kept = stored.drop("is_latest_version").join(incoming.select("submission_id"), "submission_id", "left_anti")
        return latest_version(kept.unionByName(incoming))

    rewrite_touched(path, batch, batch_id, schema, VERSION_KEYS, change, digits)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Stored submissions; the flags are stored, nothing is ranked."""
    return spark.read.parquet(path).drop(SLOT)


# ---- facts: edits ---------------------------------------------------------------------------


def edit_facts(path: str, edits: DataFrame, batch_id: str | int, schema: T.StructType, digits: int = 2) -> None:
    """KPI corrections applied to a fact table in slots of submission_id; ``schema`` is that of the stored rows.

    Edits of a slot that holds no facts find nothing and change nothing.
    """
    rewrite_touched(path, edits, batch_id, schema, ["submission_id"], lambda stored, new: apply_kpi_edits(stored, new.drop(SLOT)), digits)


def slot_files(spark: SparkSession, path: str) -> DataFrame:
    """slot, file, rows: the files of a table in slots and what they hold."""
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col(SLOT).cast("string").alias(SLOT), F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
