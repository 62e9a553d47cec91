"""Exact deduplication by sorting content.

Texts are equal when identical after lower-casing A-Z. Rows are range-partitioned by the first bytes of the normalised
text, its SHA-256 and the doc_id (sampled splitters, each of bounded size), sorted in each partition, and compared with
their neighbour in full. As the doc_id is part of the splitters, a group of copies of any size is spread over several
partitions; the runs at their edges (two per partition) are matched by their text afterwards.

Defined cases: a null text is an empty text; null doc_ids sort below all others; of rows that tie for the largest doc_id
one stays; an empty table gives no rows; other columns, whatever their names, are not looked at and are kept by
``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ledgerloom.llm.common import raw_bytes, slices, staged

HEAD_BYTES = 64

META = "part int, run int, is_head boolean, digest binary, local_keep long, local_size long, edge_text string"


def _with_digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lowered = [x.lower() for x in raw_bytes(batch.column("text"))]
        head = pa.array([x[:HEAD_BYTES] for x in lowered], pa.binary())
        sha = pa.array([hashlib.sha256(x).digest() for x in lowered], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, head, sha], names=[*batch.schema.names, "head", "digest"])


def _runs(heads_only: bool):
    """Of rows in sorted order: the run of equal texts each belongs to, its largest doc_id and its size."""

    def emit(rows: pa.Table, ends: bool, part: int, run: int, text: pa.Scalar) -> pa.Table:
        """``rows``: all of one run; ``ends``: it is the first or last of the partition."""
        n = 1 if heads_only else rows.num_rows
        out = {"doc_id": rows["doc_id"][:n]} | ({"row": rows["row"][:1]} if heads_only else {})
        out |= {
            "part": pa.array(np.full(n, part, np.int32)),
            "run": pa.array(np.full(n, run, np.int32)),
            "is_head": pa.array(np.arange(n) == 0),
            "digest": rows["digest"][:n],
            "local_keep": pa.array([rows["doc_id"][0].as_py()] * n, pa.int64()),
            "local_size": pa.array(np.full(n, rows.num_rows, np.int64)),
            "edge_text": pa.array([text.as_py() if ends else None] + [None] * (n - 1), pa.string()),
        }
        return pa.table(out)

    def bulk(rows: pa.Table, first: np.ndarray, part: int, run: int) -> pa.Table:
        """Whole runs that neither begin nor end the partition; ``first``: where each starts."""
        size = np.diff([*first, rows.num_rows])
        of = np.repeat(np.arange(len(first)), size)
        pick = pa.array(first) if heads_only else pa.array(np.arange(rows.num_rows))
        of = np.arange(len(first)) if heads_only else of
        taken = rows.take(pick)
        out = {"doc_id": taken["doc_id"]} | ({"row": taken["row"]} if heads_only else {})
        out |= {
            "part": pa.array(np.full(len(of), part, np.int32)),
            "run": pa.array((run + of).astype(np.int32)),
            "is_head": pa.array(np.isin(pick.to_numpy(), first)),
            "digest": taken["digest"],
            "local_keep": rows["doc_id"].take(pa.array(first[of])),
            "local_size": pa.array(size[of].astype(np.int64)),
            "edge_text": pa.nulls(len(of), pa.string()),
        }
        return pa.table(out)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), 0
        held: list[pa.Table] = []  # rows of the run that may go on: their ids, and of its first one all columns
        last: pa.Scalar | None = None
        for batch in slices(batches):
            text = pc.ascii_lower(batch.column("text"))
            names = ["doc_id", "digest"] + (["row"] if heads_only else [])
            rows = pa.Table.from_batches([batch]).select(names)
            new = np.ones(len(text), bool)
            new[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
            if last is not None:
                new[0] = text[0].as_py() != last.as_py()
            first = np.flatnonzero(new)
            if not len(first):  # the whole batch goes on with the held run
                held.append(rows if not heads_only else rows.drop_columns(["row"]))
                continue
            if first[0] > 0:
                held.append(rows.slice(0, first[0]) if not heads_only else rows.slice(0, first[0]).drop_columns(["row"]))
            if held:
                yield from emit(pa.concat_tables(held, promote_options="default"), run == 0, part, run, last).to_batches()
                run += 1
            if run == 0 and len(first) > 1:  # the partition's first run ends here
                yield from emit(rows.slice(0, first[1]), True, part, 0, text[0]).to_batches()
                run, first = 1, first[1:]
            if len(first) > 1:
                whole = rows.slice(first[0], first[-1] - first[0])
                yield from bulk(whole, first[:-1] - first[0], part, run).to_batches()
                run += len(first) - 1
            held, last = [rows.slice(first[-1])], text[-1]
            if heads_only and held[0].num_rows > 1:
                held = [held[0].slice(0, 1), held[0].slice(1).drop_columns(["row"])]
        if held:
            yield from emit(pa.concat_tables(held, promote_options="default"), True, part, run, last).to_batches()

    return scan


def _sorted_runs(docs: DataFrame, heads_only: bool) -> DataFrame:
    """One row per document (or per head of a run, with all its columns in ``row``): its run, with those at edges joined up."""
    row = [F.struct("*").alias("row")] if heads_only else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *row)
    keyed = rows.mapInArrow(_with_digest, StructType([*rows.schema, StructField("head", BinaryType()), StructField("digest", BinaryType())]))
    ordered = keyed.repartitionByRange("head", "digest", "doc_id").sortWithinPartitions("head", "digest", F.col("doc_id").desc())
    fields = [StructField("doc_id", rows.schema["doc_id"].dataType)] + ([rows.schema["row"]] if heads_only else [])
    meta = StructType.fromDDL(META)
    runs = staged(ordered.mapInArrow(_runs(heads_only), StructType([*fields, *meta])), "runs")

    edges = runs.where("edge_text IS NOT NULL").select("part", "run", "edge_text", "local_keep", "local_size")
    groups = edges.groupBy("edge_text").agg(F.max("local_keep").alias("group_keep"), F.sum("local_size").alias("group_size"))
    joined = edges.join(groups, "edge_text").select("part", "run", "group_keep", "group_size")
    # At most two rows of four numbers per partition of the sort.
    return runs.drop("edge_text").join(F.broadcast(joined), ["part", "run"], "left").select(
        *[f.name for f in fields],
        F.when(F.col("group_size").isNull(), F.col("local_keep")).otherwise(F.col("group_keep")).alias("keep_id"),
        F.coalesce("group_size", "local_size").alias("group_size"),
        F.col("is_head"),
        F.col("local_keep"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def groups_of_equals(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    runs = _sorted_runs(docs, heads_only=False)
    kept = F.col("is_head") & F.col("local_keep").eqNullSafe(F.col("keep_id"))
    return runs.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    runs = _sorted_runs(docs, heads_only=True)
    return runs.where(F.col("local_keep").eqNullSafe(F.col("keep_id"))).select("row.*")
