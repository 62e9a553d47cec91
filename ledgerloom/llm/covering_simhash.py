"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits. With radius r, each bit is given a non-zero vector of r + 1 bits; mask v, of 2**(r+1) - 1,
keeps the bits whose vector has odd overlap with v. Any r differing bits span at most r dimensions, so some v overlaps
none of their vectors oddly: under that mask the two fingerprints are equal. Every pair within the radius thus shares a
bucket in some table, and only equal buckets are looked at.

Hot groups: documents with equal fingerprints are one row before any bucket is formed. Up to BUCKET distinct fingerprints
of a bucket are compared in place, and only a spanning forest leaves the task. Fingerprints of larger buckets are linked
through the points around them instead: x and y are within 3 if some point is within 1 of x and 2 of y. A point has at
most 2081 fingerprints within 2, whatever the bucket, so no group is unbounded and no pair is listed.

Defined cases: a null text is empty; texts without words have fingerprint zero and are linked to each other; null doc_ids
are smaller than none (a component of nulls alone has a null id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, digest, forest, id_and_text, mixed, raw_bytes, slices, staged

RADIUS = 3
SHINGLE = 3
BUCKET = 256
#: Parts that the points around fingerprints are dealt into.
POINT_PARTS = 64

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """uint64 of each text: a bit is set if set in more than half of the shingles' hashes."""
    hashed, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if len(words) < SHINGLE:
            shingles = [b" ".join(words)] if words else []
        else:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
        found = b"".join(map(xxhash.xxh64_digest, shingles, repeat(42)))
        hashed.append(found)
        counts[i] = len(found) // 8
    octets = np.frombuffer(b"".join(hashed), np.uint8).reshape(-1, 8)
    out = np.zeros((len(texts), 8), np.uint8)
    step = 512
    ends = np.concatenate([[0], np.cumsum(counts)])
    for low in range(0, len(texts), step):
        n = counts[low : low + step]
        of = np.repeat(np.arange(len(n)), n) * 256
        mine = octets[ends[low] : ends[low + len(n)]]
        for k in range(8):
            seen = np.bincount(of + mine[:, k], minlength=len(n) * 256).reshape(len(n), 256)
            out[low : low + step, k] = np.packbits(2 * (seen @ BITS) > n[:, None], axis=1)[:, 0]
    return out.reshape(-1).view(">u8").astype(np.uint64)


def masks(radius: int = RADIUS) -> list[int]:
    """The bit masks of the tables, one for each non-zero vector of radius + 1 bits."""
    size = (1 << (radius + 1)) - 1
    return [sum(1 << bit for bit in range(64) if ((bit % size + 1) & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprint_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = fingerprints(raw_bytes(batch.column("text"))).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(found)], names=["doc_id", "digest", "fp"])


def _bucket_links(radius: int, limit: int):
    """Rows sorted by bucket: a forest of the links inside buckets, and the buckets with more than ``limit`` rows."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "tab", "bucket"]
        low = high = np.zeros(0, np.int64)
        held = np.zeros((3, 0), np.int64)
        for batch in [*batches, None]:
            if batch is not None:
                new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tab", "bucket", "fp")])
                held = np.concatenate([held, new], axis=1)
            if not held.shape[1]:
                continue
            first = np.flatnonzero(np.concatenate([[True], (held[:2, 1:] != held[:2, :-1]).any(axis=0)]))
            whole = held.shape[1] if batch is None else first[-1]
            rows, held = held[:, :whole], held[:, whole:]
            first = first[first < whole]
            if not whole:
                continue
            size = np.diff([*first, whole])
            hot = size > limit
            if hot.any():
                at = first[hot]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64())] * 2 + [pa.array(rows[0, at].astype(np.int32)), pa.array(rows[1, at])], names=names)
            left = np.repeat(np.where(hot, 0, first + size), size) - np.arange(whole) - 1  # rows of the bucket after this one
            fp, at, far = rows[2], np.flatnonzero(left > 0), 1
            while len(at):
                near = np.bitwise_count(fp[at] ^ fp[at + far]) <= radius
                low, high = np.concatenate([low, fp[at][near]]), np.concatenate([high, fp[at + far][near]])
                if len(low) > 1_000_000:
                    low, high = forest(low, high)
                far += 1
                at = at[left[at] >= far]
            if len(low) > 100_000:
                low, high = forest(low, high)
        low, high = forest(low, high)
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.nulls(len(low), pa.int32()), pa.nulls(len(low), pa.int64())], names=names)

    return scan


def _point_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points within 2 of each fingerprint, dealt to parts: packed (point, fingerprint, whether within 1)."""
    one = [1 << i for i in range(64)]
    shifts = np.array([0, *one, *(x | y for x, y in combinations(one, 2))], np.uint64)
    for batch in batches:
        every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for low in range(0, len(every), 2048):
            fp = every[low : low + 2048]
            point = (fp[:, None] ^ shifts[None, :]).reshape(-1)
            own, inner = np.repeat(fp, len(shifts)), np.tile(np.arange(len(shifts)) <= 64, len(fp))
            part = mixed(point) % np.uint64(POINT_PARTS)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(POINT_PARTS + 1, dtype=np.uint64))
            blocks = [np.stack([point[x], own[x], inner[x].astype(np.uint64)]).tobytes() for x in (order[a:b] for a, b in zip(ends, ends[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(POINT_PARTS, dtype=np.int32)), pa.array(blocks, pa.binary())], names=["part", "block"])


def _point_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each point with a fingerprint within 1: all fingerprints within 2 are linked to it."""
    low = high = np.zeros(0, np.int64)
    parts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True):
            parts.setdefault(part, []).append(np.frombuffer(block, np.uint64).reshape(3, -1))
    for blocks in parts.values():
        point, fp, inner = np.concatenate(blocks, axis=1)
        order = np.lexsort([fp, 1 - inner.astype(np.int8), point])  # those within 1 first
        point, fp, inner = point[order], fp[order].view(np.int64), inner[order].astype(bool)
        first = np.concatenate([[True], point[1:] != point[:-1]]) if len(point) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(point)), 0))
        linked = inner[start] & ~first
        low, high = forest(np.concatenate([low, fp[linked]]), np.concatenate([high, fp[start][linked]]))
    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])


def link_fingerprints(distinct: DataFrame, limit: int = BUCKET) -> DataFrame:
    """Links (a, b) among the distinct values of column fp that span the same components as all pairs within RADIUS."""
    tables = F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket")) for i, m in enumerate(masks())])
    keyed = distinct.select("fp", F.explode(tables).alias("k")).select("fp", "k.tab", "k.bucket")
    # The limit holds before the shuffle as well: a hot bucket reaches it as limit + 1 rows per task at most.
    rank = F.row_number().over(Window.partitionBy("tab", "bucket").orderBy("fp"))
    found = staged(
        keyed.withColumn("rank", rank).where(F.col("rank") <= limit + 1).mapInArrow(_bucket_links(RADIUS, limit), "a long, b long, tab int, bucket long"),
        "bucket-links",
    )
    hot = staged(found.where("tab IS NOT NULL").select("tab", "bucket"), "hot-buckets")
    crowded = keyed.join(hot, ["tab", "bucket"], "left_semi").select("fp").distinct()
    around = crowded.mapInArrow(_point_blocks, "part int, block binary").repartition(POINT_PARTS, "part").mapInArrow(_point_links, "a long, b long")
    return found.where("tab IS NULL").select("a", "b").union(around)


def near_duplicates(docs: DataFrame, limit: int = BUCKET) -> DataFrame:
    """doc_id, digest, fp (signed long), root (smallest fp of the component) and component_id (smallest doc_id) of every row."""
    rows = staged(id_and_text(docs, digest().alias("digest")).mapInArrow(_fingerprint_rows, "doc_id long, digest long, fp long"), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(link_fingerprints(distinct.select("fp"), limit))
    rooted = staged(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = staged(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = staged(rooted.join(lowest, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: that with the smallest doc_id (of several texts under it,
    that with the smallest digest). Rows that repeat both its doc_id and its text stay with it.
    """
    lowest = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = staged(lowest.groupBy("root", "doc_id").agg(F.min("digest").alias("digest")), "kept")
    same = docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["digest"])
    return docs.join(kept, same, "left_semi")
