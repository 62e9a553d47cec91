"""Best-fit packing with several permitted sequence lengths.

Documents longer than the largest length are cut into pieces of it; every token is packed. The pieces are dealt into
groups of about GROUP pieces, so that one task packs a bounded number. In a group, pieces go in decreasing length to the
open bin, of whatever length, that they fill best. Where none has room, the bin length is opened that costs least per
token: its cost over what the pieces still to come can fill of it. In the end each bin is cut down to the shortest
permitted length that holds its contents.

A document has one token per word and one end token, so null and empty texts are one token and are packed too. Repeated
rows and doc_ids are packed as they are; an empty table gives no bins; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, raw_bytes, slices, staged

CAPACITIES = (512, 1024, 2048, 4096)
GROUP = 20_000

PACKED = "bin_id long, capacity int, used int, doc_id long, piece int, start int, length int, offset int"


def sequence_cost(capacity: int) -> float:
    """What training on a sequence costs: in proportion to its length, and to its square for attention, plus a constant."""
    return capacity + capacity * capacity / 16_384 + 16


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (in decreasing order, none above the largest capacity), and the bins' final capacities."""
    capacities = sorted(capacities)
    cost = {c: sequence_cost(c) for c in capacities}
    left = np.bincount(np.asarray(lengths, np.int64), minlength=capacities[-1] + 1).tolist()
    sizes = sum(1 << n for n, count in enumerate(left) if count)  # bit n: pieces of length n are still to come
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # open bins by what is free in them
    rooms = 0
    bins, offsets, used, opened = [], [], [], []

    def filled(space: int) -> int:
        """Of ``space``, what the pieces still to come fill, the largest first."""
        rest, usable = space, sizes
        while rest and (usable := usable & ((1 << (rest + 1)) - 1)):
            n = usable.bit_length() - 1
            rest -= n * min(left[n], rest // n)
            usable ^= 1 << n
        return space - rest

    for n in lengths:
        left[n] -= 1
        if not left[n]:
            sizes ^= 1 << n
        if fitting := rooms >> n:
            free = n + (fitting & -fitting).bit_length() - 1
            own = room[free].pop()
            if not room[free]:
                rooms ^= 1 << free
        else:
            free = min((c for c in capacities if c >= n), key=lambda c: cost[c] / (n + filled(c - n)))
            own = len(used)
            used.append(0)
            opened.append(free)
        bins.append(own)
        offsets.append(used[own])
        used[own] += n
        free -= n
        if free:
            room[free].append(own)
            rooms |= 1 << free
    return bins, offsets, [next(c for c in capacities if c >= n) for n in used]


def _pieces(largest: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens = np.array([len(x.split()) + 1 for x in raw_bytes(batch.column("text"))], np.int64)
            n = -(-tokens // largest)
            of = np.repeat(np.arange(len(tokens)), n)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * largest
            columns = [batch.column("doc_id").take(pa.array(of)), *(pa.array(x.astype(np.int32)) for x in (piece, start, np.minimum(tokens[of] - start, largest)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length"])

    return scan


def _packed(capacities: Sequence[int]):
    """Rows sorted by group and falling length; a group is held until it ends."""

    def close(rows: pa.Table) -> pa.RecordBatch:
        bins, offsets, final = pack(rows["length"].to_pylist(), capacities)
        bins = np.array(bins, np.int64)
        used = np.bincount(bins, rows["length"].to_numpy()).astype(np.int32)
        out = {
            "bin_id": pa.array((rows["grp"].to_numpy() << 32) | bins),
            "capacity": pa.array(np.array(final, np.int32)[bins]),
            "used": pa.array(used[bins]),
        } | {c: rows[c] for c in ("doc_id", "piece", "start", "length")} | {"offset": pa.array(offsets, pa.int32())}
        return pa.table(out).combine_chunks().to_batches()[0]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if held and low < high and held[-1].column("grp")[0].as_py() != grp[low]:
                    yield close(pa.Table.from_batches(held))
                    held = []
                if low < high:
                    held.append(batch.slice(low, high - low))
        if held:
            yield close(pa.Table.from_batches(held))

    return scan


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, group: int = GROUP) -> DataFrame:
    """One row per piece: its bin, the bin's final length and contents, and the piece's place in document and bin."""
    pieces = id_and_text(docs).mapInArrow(_pieces(max(capacities)), "doc_id long, piece int, start int, length int")
    pieces = staged(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group))
    # The number of a row in the written table deals rows evenly, whatever repeats in them.
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    ordered = dealt.repartition("grp").sortWithinPartitions("grp", F.col("length").desc(), "doc_id", "start")
    return ordered.mapInArrow(_packed(capacities), PACKED)
