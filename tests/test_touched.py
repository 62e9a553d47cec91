"""Tables in slots, versions and edits by touched slot, and deduplication of a stream in two tiers."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import touched
from ledgerloom.operators.store import FACT_LAYOUT, conform
from ledgerloom.session import work_path
from ledgerloom.streaming import ingest as streams

SUBMISSION = "submission_id string, company_id string, period_id string, submitted_at timestamp_ntz"


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


@pytest.fixture
def path(spark):
    return work_path(spark, "touched")


def flags(spark, path):
    return {r["submission_id"]: r["is_latest_version"] for r in touched.read_latest(spark, path).collect()}


def files(spark, path):
    return {(r["slot"], r["file"]) for r in touched.slot_files(spark, path).collect()}


def test_versions_after_each_batch(spark, path):
    first = [("a", "acme", "FY2024", day(1)), ("b", "acme", "FY2025", day(2)), ("c", "", "FY2025", day(1)), ("d", "", "FY2025", day(3)), ("e", None, None, day(1))]
    touched.upsert_latest(path, spark.createDataFrame(first, SUBMISSION), 0)
    assert flags(spark, path) == {k: True for k in "abcde"}  # an empty company or period is a version of nothing
    second = [("f", "acme", "FY2025", day(5)), ("g", "acme", "FY2025", day(4))]
    touched.upsert_latest(path, spark.createDataFrame(second, SUBMISSION), 1)
    assert flags(spark, path) == {"a": True, "b": False, "c": True, "d": True, "e": True, "f": True, "g": False}


def test_a_repeated_batch_changes_nothing(spark, path):
    touched.upsert_latest(path, spark.createDataFrame([("a", "acme", "FY", day(1))], SUBMISSION), 0)
    batch = spark.createDataFrame([("b", "acme", "FY", day(2))] * 2 + [("a", "acme", "FY", day(1))], SUBMISSION)
    for _ in range(2):
        touched.upsert_latest(path, batch, 1)
        assert flags(spark, path) == {"a": False, "b": True} and touched.read_latest(spark, path).count() == 2
    again = spark.createDataFrame([("a", "acme", "FY", day(1))], SUBMISSION)
    touched.upsert_latest(path, again, 2)  # the same submission delivered later
    assert flags(spark, path) == {"a": False, "b": True}


def test_files_of_other_slots_stay(spark, path):
    rows = [(f"s{k}", f"company{k}", "FY", day(1)) for k in range(300)]
    touched.upsert_latest(path, spark.createDataFrame(rows, SUBMISSION), "first")
    before = files(spark, path)
    touched.upsert_latest(path, spark.createDataFrame([("new", "company7", "FY", day(2))], SUBMISSION), "second")
    now = files(spark, path)
    slot = spark.createDataFrame([("company7", "FY")], "company_id string, period_id string").select(touched.slot_of(touched.VERSION_KEYS)).first()[0]
    assert {s for s, _ in now ^ before} == {slot} and len(before & now) > 100
    assert flags(spark, path)["s7"] is False and sum(flags(spark, path).values()) == 300


def test_a_batch_lost_while_it_is_put_in_place(spark, path):
    """Its complete result lies beside the table: a repeat uses that, whatever the overwrite has left of the slots."""
    rows = [(f"s{k}", f"company{k}", "FY", day(1)) for k in range(40)]
    touched.upsert_latest(path, spark.createDataFrame(rows, SUBMISSION), 0, 1)
    batch = spark.createDataFrame([(f"n{k}", f"company{k}", "FY", day(2)) for k in range(40)], SUBMISSION)
    touched.upsert_latest(path, batch, 1, 1)
    store, folder = touched._fs(spark, path)
    gone = next(e.getPath() for e in store.listStatus(folder) if e.getPath().getName().startswith("slot="))
    store.delete(gone, True)
    assert touched.read_latest(spark, path).count() < 80
    touched.upsert_latest(path, batch, 1, 1)
    found = flags(spark, path)
    assert len(found) == 80 and all(v == k.startswith("n") for k, v in found.items())


def test_a_hot_key_is_written_by_several_tasks(spark, path):
    rows = spark.range(200_000).select(
        F.concat(F.lit("s"), "id").alias("submission_id"), F.lit("acme").alias("company_id"), F.lit("FY").alias("period_id"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("submitted_at"), F.sha2(F.col("id").cast("string"), 512).alias("load"),
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        touched.upsert_latest(path, rows, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(files(spark, path)) > 1
    assert [r["submission_id"] for r in touched.read_latest(spark, path).filter("is_latest_version").collect()] == ["s199999"]


def test_edits_rewrite_their_slots_only(spark, path):
    facts = conform(spark.createDataFrame([(f"{k}", f"S{k}", "revenue", "$1K", 1000.0) for k in range(100)], "id string, submission_id string, kpi_key string, raw_value string, numeric_value double"), FACT_LAYOUT)
    touched.write_slots(facts, path, ["submission_id"])
    before = files(spark, path)
    edits = spark.createDataFrame([("S5", "revenue", "$2M", day(1)), ("S5", "revenue", "$3M", day(2)), ("S5", "cogs", "$9M", day(1)), ("nobody", "revenue", "$1M", day(1))], "submission_id string, kpi_key string, value string, edited_at timestamp_ntz")
    for _ in range(2):
        touched.edit_facts(path, edits, "e1", facts.schema)
        rows = {r["submission_id"]: r for r in spark.read.parquet(path).collect()}
        assert len(rows) == 100 and rows["S5"]["numeric_value"] == 3_000_000.0 and rows["S5"]["edited_raw_value"] == "$2M" and rows["S6"]["raw_value"] == "$1K"
    slots = edits.select(touched.slot_of(["submission_id"]).alias("slot")).distinct()
    assert {s for s, _ in files(spark, path) ^ before} <= {r["slot"] for r in slots.collect()}


ARRIVING = "submission_id string, file_hash string, submitted_at timestamp_ntz"


def arrive(spark, source, rows):
    spark.createDataFrame(rows, ARRIVING).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(ARRIVING).parquet(source)


def test_which_submission_of_a_hash_survives(spark, path):
    source, checkpoint = work_path(spark, "source"), work_path(spark, "checkpoint")
    waves = [
        [("b", "11aa", day(9)), ("a", "11aa", day(9)), ("c", "22bb", day(1))],
        [("d", "11aa", day(0)), ("c", "22bb", day(1)), ("e", "33cc", day(2)), ("f", "33cc", day(1))],
        [("g", "33cc", day(0)), ("h", "11dd", day(400)), ("h", "11dd", day(400))],
        [("i", "11dd", day(-4000)), ("j", "22ee", day(-4000))],
    ]
    for wave in waves:
        streams.stream_dedup_hash(arrive(spark, source, wave), path, checkpoint).awaitTermination()
    found = {(r["file_hash"], r["submission_id"]) for r in spark.read.parquet(path).collect()}
    assert found == {("11aa", "a"), ("22bb", "c"), ("33cc", "f"), ("11dd", "h"), ("22ee", "j")}  # ten years late is not too late


def test_a_batch_reads_only_its_prefixes(spark, path):
    source, checkpoint = work_path(spark, "source"), work_path(spark, "checkpoint")
    rows = [(f"s{k}", uuid.UUID(int=k << 120).hex, day(1)) for k in range(200)]
    streams.stream_dedup_hash(arrive(spark, source, rows), path, checkpoint).awaitTermination()
    known = streams.known_hashes(spark, path, ["07", "a1"], 99)
    assert known.count() == 2
    assert "PartitionFilters: [" in (plan := known._jdf.queryExecution().toString()) and "prefix" in plan
    read = known.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) == 2 and all("prefix=07" in r["f"] or "prefix=a1" in r["f"] for r in read)
    assert streams.known_hashes(spark, path, ["07"], 0).count() == 0


def test_the_state_of_the_first_tier_is_let_go(spark, path):
    source, checkpoint = work_path(spark, "source"), work_path(spark, "checkpoint")
    states = []
    for wave in range(3):
        done = streams.stream_dedup_hash(arrive(spark, source, [(f"{wave}-{k}", f"{wave}{k:04}", day(wave)) for k in range(50)]), path, checkpoint, delay="0 seconds")
        done.awaitTermination()
        states.append(done.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert spark.read.parquet(path).count() == 150 and max(states) <= 50
