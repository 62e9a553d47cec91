"""Running values along an order, without putting a whole sequence into one task.

The rows are range-partitioned by key and order into splits and written; a split holds a stretch of a key's sequence,
and a long sequence lies in many splits. Each split is scanned by itself, and one small row per key and split (its last
value, its number of rows) gives what the splits before it hand on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators.skew import written

SPLIT = "__split"


def in_splits(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows with the number of their split; splits follow one another by key and order. ``order`` is unique within a key."""
    spread = rows.repartitionByRange(*keys, order).withColumn(SPLIT, F.spark_partition_id())
    return written(spread, "splits")


def _handed_on(split: DataFrame, keys: list[str], per_split: Column, carried) -> DataFrame:
    """One row per key and split with what the earlier splits of the key hand on."""
    own = split.groupBy(*keys, SPLIT).agg(per_split.alias("__own"))
    earlier = Window.partitionBy(*keys).orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    return own.select(*[F.col(k).alias("__k_" + k) for k in keys], F.col(SPLIT).alias("__k_split"), carried(F.col("__own")).over(earlier).alias("__before"))


def _with_before(split: DataFrame, keys: list[str], before: DataFrame) -> DataFrame:
    same = split[SPLIT] == before["__k_split"]
    for k in keys:
        same = same & split[k].eqNullSafe(before["__k_" + k])
    return split.join(before, same).drop("__k_split", *["__k_" + k for k in keys])


def forward_fill(rows: DataFrame, column: str, keys: list[str], order: str, splits: DataFrame | None = None) -> DataFrame:
    """Empty or null cells from the last filled one above, per key. ``splits``: the rows as ``in_splits`` gave them."""
    split = in_splits(rows, keys, order) if splits is None else splits
    filled = F.when(F.col(column) != "", F.col(column))
    last = F.max_by(filled, F.when(filled.isNotNull(), F.col(order)))
    before = _handed_on(split, keys, last, lambda own: F.last(own, ignorenulls=True))
    stretch = Window.partitionBy(*keys, SPLIT).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = split.withColumn("__here", F.last(filled, ignorenulls=True).over(stretch))
    return _with_before(here, keys, before).withColumn(column, F.coalesce("__here", "__before")).drop("__here", "__before", SPLIT)


def row_numbers(rows: DataFrame, keys: list[str], order: str, out: str = "position") -> DataFrame:
    """Adds the row number, from 1, within each key."""
    split = in_splits(rows, keys, order)
    before = _handed_on(split, keys, F.count(F.lit(1)), F.sum)
    here = split.withColumn("__here", F.row_number().over(Window.partitionBy(*keys, SPLIT).orderBy(order)))
    number = F.col("__here") + F.coalesce("__before", F.lit(0))
    return _with_before(here, keys, before).withColumn(out, number.cast("int")).drop("__here", "__before", SPLIT)
