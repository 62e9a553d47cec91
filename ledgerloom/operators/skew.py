"""Per-key values attached to rows without sending a hot key to one task.

A window over a key, or a plain join with a per-key aggregate, puts every row of the
key into one task. Here the per-key table is aggregated first (map-side combine) and
written to shared storage, so that the rows are planned once for it; keys that hold very
many rows, however many such keys there are, are found from its counts, and their rows
are dealt out by a hash of the row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import work_path

HOT_ROWS = 2_000_000  # a key with more rows than this is split


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right["__" + k]) for k in keys])


def _prefixed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: "__" + k for k in keys})


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows in a table on shared storage: worked out once for all that read them."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, key: str) -> DataFrame:
    """The rows with those of a key in one partition, and ``__times``, how many the key has.

    A count over the key asks for this only, so rows that come from a join or a grouping by the key are not shuffled again.
    """
    return df.withColumn("__times", F.count(F.lit(1)).over(Window.partitionBy(key)))


#: While a table in buckets is written: files that a task keeps open at most, and buckets read, and shuffled to, one by one.
BUCKET_SETTINGS = {"spark.sql.maxConcurrentOutputFileWriters": "32", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
                   "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def bucketed(df: DataFrame, path: str, key: str, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows in a table at ``path`` in as many buckets by ``key`` as a shuffle has partitions: groupings by the key, and joins
    with tables written so, shuffle nothing. ``more`` makes rows of those written, which are added to the table.

    Rows should lie by key (``gathered``), or each task writes a file for every bucket. The session's catalogue knows the table
    under a name of its own while it is written, and forgets it then; the files stay. Meanwhile a task keeps a file open for each
    of its few buckets, so rows are not sorted by bucket first, and a table in buckets is read by as many tasks, a bucket each.
    """
    spark, name = df.sparkSession, f"ledgerloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = {setting: spark.conf.get(setting) for setting in BUCKET_SETTINGS}

    def save(rows: DataFrame) -> None:
        rows.write.format("parquet").mode("append").bucketBy(buckets, key).option("path", path).saveAsTable(name)

    try:
        for setting, value in BUCKET_SETTINGS.items():
            spark.conf.set(setting, value)
        save(df)
        if more is not None:
            save(more(spark.table(name)))
            spark.catalog.refreshTable(name)
        return spark.table(name)
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def count_by(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def row_hash(rows: DataFrame) -> Column:
    """Hash of a row: the same in every run, and spread within a key wherever the row lies."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind])


def attach_by_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    weight: str | None = None,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    small_keys: bool = False,
    staged: bool = False,
) -> DataFrame:
    """Join ``per_key`` (one row per key; nulls are equal) to ``rows``, splitting hot keys.

    The rows are written to shared storage first, so that they are worked out once however often they are read
    (``staged``: the caller has done so). ``weight`` names the column of ``per_key`` that counts the key's rows in
    ``rows``; without it they are counted here. ``small_keys`` says that no key can hold many rows: nothing is written or
    counted then. Tables are written while the plan is built: even ``explain`` starts these jobs.
    """
    per_key = written(per_key, "per-key")
    if not small_keys and not staged:
        rows = written(rows, "rows")
    names = ["__" + k for k in keys]
    hot = None
    if not small_keys:
        counts = per_key if weight else count_by(rows, keys, "__n")
        over = counts.filter(F.col(weight or "__n") > hot_rows)
        hot = written(over.select(*keys, F.ceil(F.col(weight or "__n") / hot_rows).cast("int").alias("__splits")), "hot-keys")
    if hot is None or hot.isEmpty():
        right = _prefixed(per_key, keys)
        return rows.join(right, _same_keys(rows, right, keys), how).drop(*names)
    # written tables: Spark broadcasts the list if its size allows, and else can split the shuffle
    hot = _prefixed(hot, keys)
    # dealt out by their place in the written table, so that rows equal in every column part as well
    placed = rows.withColumn("__place", F.monotonically_increasing_id())
    left = placed.join(hot, _same_keys(placed, hot, keys), "left").drop(*names)
    left = left.withColumn("__salt", F.coalesce(F.pmod("__place", F.col("__splits")), F.lit(0))).drop("__splits", "__place")
    right = per_key.join(hot, _same_keys(per_key, hot, keys), "left").drop(*names)
    right = right.withColumn(
        "__salt2", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__splits"), F.lit(1)) - 1))
    ).drop("__splits")
    right = _prefixed(right, keys)
    joined = left.join(right, _same_keys(left, right, keys) & (left["__salt"] == right["__salt2"]), how)
    return joined.drop("__salt", "__salt2", *names)
