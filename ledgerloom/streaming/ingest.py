"""Arriving results: the batch operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.documents import decoded_only, explode_kpis
from ledgerloom.operators.store import dedup_by_hash
from ledgerloom.operators.touched import exists, upsert_latest


def stream_ingest_results(arriving: DataFrame, raw: str = "raw_json", keep: list[str] | None = None) -> DataFrame:
    """Stateless: every arriving document becomes its 16 KPI rows; undecodable ones are left out."""
    keep = keep if keep is not None else [c for c in arriving.columns if c != raw]
    return explode_kpis(decoded_only(arriving, raw), "doc", keep)


def dedup_within_watermark(arriving: DataFrame, delay: str, time: str = "submitted_at") -> DataFrame:
    """Duplicate hashes dropped while the watermark remembers them (for sinks without a store to look up).

    The state holds the hashes of one delay. Rows that are later than that are dropped, whatever their hash.
    """
    return arriving.withWatermark(time, delay).dropDuplicatesWithinWatermark(["file_hash"])


PREFIX = "prefix"


def known_hashes(spark: SparkSession, path: str, prefixes: list[str], before_batch: int) -> DataFrame:
    """Hashes stored by earlier batches, read from the directories of these prefixes only."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file_hash string")
    stored = spark.read.schema(f"file_hash string, {PREFIX} string, batch_id long").parquet(path)
    return stored.filter(F.col(PREFIX).isin(prefixes) & (F.col("batch_id") < before_batch)).select("file_hash")


def stream_dedup_hash(arriving: DataFrame, path: str, checkpoint: str, order: list[str] | None = None,
                      delay: str = "1 hour", digits: int = 2) -> StreamingQuery:
    """Each new content hash is stored once, however late its copies arrive.

    First tier: a source that delivers a submission again within ``delay`` of its first arrival is met by the state of the
    stream. The watermark is on the time of arrival, so no row is too late, and the state holds the submissions of one
    delay, not all there ever were. Second tier: a micro-batch is reduced to the first submission (by ``order``) of each
    hash, and compared with the stored hashes of the prefixes it brings: the store lies in directories by the first
    ``digits`` digits of the hash, and only those are read. Of a hash the submission of the earliest batch stays, of
    one batch the first by ``order``.

    A repeated batch overwrites its own directories, so the store is the same after a failure.
    """
    names = arriving.columns
    arrived = arriving.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", delay)
    once = arrived.dropDuplicatesWithinWatermark(["file_hash", "submission_id"])

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(*names, F.substring("file_hash", 1, digits).alias(PREFIX)).persist()
        try:
            prefixes = [row[PREFIX] for row in batch.select(PREFIX).distinct().collect()]  # at most 16 ** digits
            known = known_hashes(batch.sparkSession, path, prefixes, batch_id)
            fresh = dedup_by_hash(batch, order).join(known, "file_hash", "left_anti").withColumn("batch_id", F.lit(batch_id))
            fresh.select(*names, PREFIX, "batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                PREFIX, "batch_id"
            ).parquet(path)
        finally:
            batch.unpersist()

    return (
        once.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_upsert_latest(arriving: DataFrame, path: str, checkpoint: str, digits: int = 2) -> StreamingQuery:
    """Every micro-batch of submissions is upserted: the slots it touches are rewritten with the right flags."""
    names = arriving.columns

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            upsert_latest(path, batch.select(*names), batch_id, digits)

    return (
        arriving.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
