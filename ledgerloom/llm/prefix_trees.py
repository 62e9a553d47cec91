"""Substring deduplication by prefix-partitioned suffix trees over words.

A word is removed if some window of WINDOW words covering it also starts earlier: in a smaller doc_id, or earlier in the
same document. Windows are judged on the input. The work is on suffixes, each standing for the window it begins with:

1. Pruning. Every window is given an anchor, the GRAM words in it with the smallest hash. Equal windows have equal
   anchors, so a suffix matters only if its anchor occurs twice. Anchors (about every seventh place) are counted once
   over all documents; two bitmaps of fixed size say which occur twice, and which more than HEAVY times.
2. Partitioning. The remaining suffixes are dealt out by a prefix: its first 16 words, or 20 where the anchor is heavy
   and the subtree below 16 words would be large. A suffix carries the fingerprint of its prefix and, as the labels of
   the edges below, the hashes of the next word pairs. Within a slice of input only the earliest suffix of equal windows
   is sent, so a passage shared by any share of all documents reaches its subtree once per slice.
3. Subtrees. Each part sorts its suffixes along their paths and takes the length that neighbours share: runs sharing 20
   words or more are the leaves below the deep internal nodes. All but the earliest leaf are repeats; windows that
   follow one another make maximal spans.

This is thinner than a suffix tree. A suffix ends after WINDOW words, known by fingerprints alone, so neighbours share 0,
16, 18 or 20 words, there are no deeper nodes and maximal spans come from merging windows, not from subtrees. Prefixes
have two lengths, chosen by HEAVY; they are not lengthened until a group fits memory. Removal depends on windows of
WINDOW words only, so deeper nodes would change no result.

Fingerprints have 64 bits. The number of parts follows the bytes of text, so a part fits a task's memory at any size.

Defined cases: null and empty texts have no words; null doc_ids come before all others; rows that share a doc_id are one
document, in which windows that start at the same place are the same occurrence; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rolling, Words, digest, id_and_text, mixed, raw_bytes, slices, staged

WINDOW = 20
GRAM = 8
PREFIX = 16
HEAVY = 100_000
#: Bits of the map of anchors that occur twice; a fuller map prunes less and loses nothing.
MAP_BITS, HEAVY_BITS = 28, 24
SLICE_BYTES = 8 << 20
#: Bytes of text for each part of the anchors (256 to 65,536 of them) and of the suffixes (64 or more).
PART_BYTES = 16 << 20

NULL_ID = -(1 << 63)


def _slide(x: np.ndarray, width: int, of: Callable) -> np.ndarray:
    """``of`` (minimum or maximum) over each run of ``width`` values."""
    have = 1
    while 2 * have <= width:
        x = of(x[:-have], x[have:])
        have *= 2
    return of(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Suffixes:
    """The windows of a slice of texts: where they are, and the hash of the anchor of each."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        self.doc, self.start, hashes = words.doc, words.start, words.hashes()
        n = len(hashes)
        self.rolling, self.hashes = Rolling(hashes), hashes
        if n < WINDOW:
            self.at, self.anchor, self.anchors = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        whole = self.doc[: n - WINDOW + 1] == self.doc[WINDOW - 1 :]
        gram = self.rolling.of(GRAM)
        reach = WINDOW - GRAM + 1
        least = _slide(gram, reach, np.minimum)
        edge = np.zeros(reach - 1, np.uint64)
        chosen = _slide(np.concatenate([edge, np.where(whole, least, np.uint64(0)), edge]), reach, np.maximum) == gram
        self.at = np.flatnonzero(whole)
        self.anchor = least[self.at]
        self.anchors = gram[chosen]


def _dealt(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indexes of its rows) of the parts that have any."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, order[ends[k] : ends[k + 1]]


def _anchor_blocks(parts: int):
    """Anchors of a slice and how often each occurs, dealt by their leading bits; ``parts`` is a power of two."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            anchors, counts = np.unique(Suffixes(batch.column("text")).anchors, return_counts=True)
            part = (anchors >> np.uint64(65 - parts.bit_length())).astype(np.int64)
            rows = [(k, anchors[i].tobytes(), counts[i].astype(np.uint32).tobytes()) for k, i in _dealt(part, parts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "anchors", "counts"])

    return scan


def _anchor_maps(parts: int, heavy_count: int):
    """Per part of the anchors: its piece of the map, and of the map of the heavy ones."""

    def piece(anchors: np.ndarray, bits: int) -> bytes:
        marks = np.zeros((1 << bits) // parts, bool)
        marks[(anchors >> np.uint64(64 - bits)) & np.uint64(len(marks) - 1)] = True
        return zlib.compress(np.packbits(marks).tobytes(), 1)

    def close(part: int, blocks: list) -> pa.RecordBatch:
        anchors, counts = (np.concatenate(x) for x in zip(*blocks, strict=True))
        own, at = np.unique(anchors, return_inverse=True)
        total = np.bincount(at, counts)
        maps = piece(own[total > 1], MAP_BITS), piece(own[total > heavy_count], HEAVY_BITS)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in maps)], names=["part", "twice", "heavy"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = -1, []
        for batch in batches:
            for part, anchors, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "anchors", "counts")), strict=True):
                if held and part != last:
                    yield close(last, held)
                    held = []
                last = part
                held.append((np.frombuffer(anchors, np.uint64), np.frombuffer(counts, np.uint32)))
        if held:
            yield close(last, held)

    return scan


class AnchorMap:
    def __init__(self, rows: list, parts: int):
        self.twice = np.zeros((1 << MAP_BITS) // 8, np.uint8).reshape(parts, -1)
        self.heavy = np.zeros((1 << HEAVY_BITS) // 8, np.uint8).reshape(parts, -1)
        for r in rows:
            self.twice[r["part"]] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
            self.heavy[r["part"]] = np.frombuffer(zlib.decompress(r["heavy"]), np.uint8)

    @staticmethod
    def _has(bits: np.ndarray, anchors: np.ndarray, width: int) -> np.ndarray:
        slot = anchors >> np.uint64(64 - width)
        return (bits.reshape(-1)[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def occurs_twice(self, anchors: np.ndarray) -> np.ndarray:
        return self._has(self.twice, anchors, MAP_BITS)

    def is_heavy(self, anchors: np.ndarray) -> np.ndarray:
        return self._has(self.heavy, anchors, HEAVY_BITS)


_BLOCK = ["prefix", "upper", "lower", "at", "pos", "ids", "digests"]


def _block(part: int, columns: list[np.ndarray], at: np.ndarray, pos: np.ndarray, ids: np.ndarray, digests: np.ndarray) -> list:
    """A row of packed columns; documents are numbered within the block."""
    docs, at = np.unique(at, return_inverse=True)
    return [part, *(x.tobytes() for x in columns), *[None] * (3 - len(columns)), at.astype(np.uint32).tobytes(), pos.astype(np.uint32).tobytes(), ids[docs].tobytes(), digests[docs].tobytes()]


def _suffix_blocks(shared, parts: int):
    """Suffixes whose anchor occurs twice, dealt by prefix; those later than an equal window of their slice go apart."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: AnchorMap = shared.value
        for batch in slices(batches, SLICE_BYTES):
            found = Suffixes(batch.column("text"))
            alive = known.occurs_twice(found.anchor)
            at, anchor = found.at[alive], found.anchor[alive]
            if not len(at):
                continue
            ids, digests = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "digest"))
            doc = found.doc[at]
            pos = at - found.start[doc]
            own = found.rolling.of(WINDOW)[at]
            order = np.lexsort([pos, ids[doc], own])
            new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
            earliest = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            later = (ids[doc[order]] != ids[doc[earliest]]) | (pos[order] != pos[earliest])
            gone, kept = order[later], order[~later]
            rows = []
            if len(gone):
                rows.append(_block(parts + int(digests[0] % parts), [], doc[gone], pos[gone], ids, digests))
            heavy = known.is_heavy(anchor[kept])
            at, doc, pos = at[kept], doc[kept], pos[kept]
            pair = found.rolling.of(2)
            prefix = np.where(heavy, own[kept], found.rolling.of(PREFIX)[at])
            upper, lower = (np.where(heavy, np.uint64(0), pair[at + k]) for k in (PREFIX, PREFIX + 2))
            for k, i in _dealt((mixed(prefix) % np.uint64(parts)).astype(np.int64), parts):
                rows.append(_block(k, [prefix[i], upper[i], lower[i]], doc[i], pos[i], ids, digests))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(8)], names=["part", *_BLOCK])

    return scan


def _subtree_repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part. Of each part's suffixes: places where a window starts that starts earlier too, by document."""

    def close(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        columns = {c: [np.frombuffer(r[c], t) for r in rows if r[c] is not None] for c, t in zip(_BLOCK, (np.uint64,) * 3 + (np.uint32,) * 2 + (np.int64,) * 2, strict=True)}
        shift = np.cumsum([0] + [len(x) for x in columns["ids"]][:-1])
        at = np.concatenate([x.astype(np.int64) + s for x, s in zip(columns["at"], shift, strict=True)])
        pos, ids, digests = (np.concatenate(columns[c]) for c in ("pos", "ids", "digests"))
        if columns["prefix"]:
            path = [np.concatenate(columns[c]) for c in ("lower", "upper", "prefix")]
            order = np.lexsort([pos, ids[at], *path])
            lower, upper, prefix = (x[order] for x in path)
            same = prefix[1:] == prefix[:-1]
            shared = np.where(same, PREFIX, 0)
            same &= upper[1:] == upper[:-1]
            shared += np.where(same, 2, 0)
            same &= lower[1:] == lower[:-1]
            shared += np.where(same, 2, 0)
            first = np.concatenate([[True], shared < WINDOW])  # a leaf not below the deep node of the one before
            earliest = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            repeat = (ids[at[order]] != ids[at[earliest]]) | (pos[order] != pos[earliest])
            at, pos = at[order[repeat]], pos[order[repeat]]
        if not len(at):
            return
        order = np.lexsort([pos, digests[at], ids[at]])
        key = np.stack([ids[at[order]], digests[at[order]]])
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        places = pos[order].astype(np.uint32).tobytes()
        packed = [places[4 * a : 4 * b] for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(key[0, starts]), pa.array(key[1, starts]), pa.array(packed, pa.binary())], names=["id", "digest", "places"])

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["part"] != row["part"]:
                yield from close(held)
                held = []
            held.append(row)
    if held:
        yield from close(held)


def repeated_windows(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """id (NULL_ID for null), digest and places (lists of packed uint32): starts of windows that also start earlier."""
    spark = docs.sparkSession
    texts = id_and_text(docs, digest().alias("digest")).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "digest", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    map_parts = 1 << min(16, max(8, (size // PART_BYTES).bit_length()))
    anchors = texts.select("text").mapInArrow(_anchor_blocks(map_parts), "part int, anchors binary, counts binary")
    maps = anchors.repartition("part").sortWithinPartitions("part").mapInArrow(_anchor_maps(map_parts, heavy), "part int, twice binary, heavy binary")
    shared = spark.sparkContext.broadcast(AnchorMap(maps.collect(), map_parts))  # two bitmaps of fixed size
    parts = max(64, size // PART_BYTES)
    suffixes = texts.mapInArrow(_suffix_blocks(shared, parts), f"part int, {', '.join(f'{c} binary' for c in _BLOCK)}")
    repeats = suffixes.repartition("part").sortWithinPartitions("part").mapInArrow(_subtree_repeats, "id long, digest long, places binary")
    return staged(repeats.groupBy("id", "digest").agg(F.collect_list("places").alias("places")), "repeats")


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        kept_texts, spans, n_words, n_removed = [], [], [], []
        for text, places in zip(raw_bytes(batch.column("text")), batch.column("places").to_pylist(), strict=True):
            words = text.split()
            n = len(words)
            if places:
                starts = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in places])).astype(np.int64)
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, starts, 1)
                np.add.at(depth, starts + WINDOW, -1)
                covered = np.cumsum(depth)[:n] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))).reshape(-1, 2)
                words = [words[i] for i in np.flatnonzero(~covered).tolist()]
                spans.append([{"start": a, "end": b} for a, b in turns.tolist()])
            else:
                spans.append([])
            kept_texts.append(b" ".join(words))
            n_words.append(n)
            n_removed.append(n - len(words))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        arrays = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept_texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_words, n_removed, spans (maximal runs of removed words) and kept (the other words) of every row."""
    texts = id_and_text(docs, digest().alias("digest")).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "doc_id", "digest", "text")
    joined = texts.join(repeated_windows(docs, heavy), ["id", "digest"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(_without, "doc_id long, n_words long, n_removed long, spans array<struct<start int, end int>>, kept string")
