"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and stripped of marks at their ends. Fixed masks name the token positions that a seed looks at and
ignore the others; equal seed hashes of a document and a benchmark item give an alignment, and the alignment counts if
some stretch of 13 tokens (the whole item, if shorter) has at least 80 % equal tokens in place. The masks are chosen so
that every stretch of 13 with two substitutions anywhere still has a seed (for items of 5 to 12 tokens: all places but
one of 5), so a verified overlap is never missed. Items of fewer than five tokens are no evidence and are left out.

The benchmark is read in blocks of at most about BLOCK_TOKENS tokens, each of them broadcast and held against all
documents: the broadcast is bounded whatever the benchmark's size, and no row is shuffled. Equal items are one item under
their smallest item_id.

Defined cases: null or empty texts match nothing, on either side; an empty benchmark matches nothing; a passage found
twice in a document is two rows; rows that repeat a document repeat its matches; other columns are kept by ``clean_only``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Words, id_and_text, mixed, slices, staged

STRETCH = 13
SHORTEST = 5
SHARE = 0.8
#: Token positions that seeds look at; for items of STRETCH tokens or more, and for shorter ones.
LONG_MASKS = [(0, 1, 2, 4, 5, 6, 7), (0, 1, 2, 3, 5, 8, 9), (0, 1, 3, 6, 7, 8, 11)]
SHORT_MASKS = [(0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4), (1, 2, 3, 4)]
#: Tokens of a benchmark block; 8 bytes each are broadcast.
BLOCK_TOKENS = 1_000_000

MATCH = "doc_id long, item_id long, doc_start int, doc_end int, item_start int, n_equal int, item_tokens int"

_MARKS = re.compile(r"^\W+|\W+$")
_PLACE = mixed(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def token(word: str) -> str:
    return _MARKS.sub("", word.lower())


def seed_hashes(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the seed at each position; position p looks at p + each place of the mask."""
    n = len(hashes) - max(mask)
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mixed(reduce(np.add, (hashes[place : place + n] * _PLACE[k] for k, place in enumerate(mask))))


class Followed:
    """Known seeds in order of hash and of the hash before it: where those of one hash behind a given one lie."""

    def __init__(self, hashes: np.ndarray, before: np.ndarray, inner: np.ndarray):
        changes = np.append(True, (hashes[1:] != hashes[:-1]) | (before[1:] != before[:-1]) | (inner[1:] != inner[:-1]))
        low = np.flatnonzero(changes)
        high = np.append(low[1:], len(hashes))
        low, high = low[inner[low]], high[inner[low]]
        keys = self._key(hashes[low], before[low])
        order = np.argsort(keys)
        self.keys, self.low, self.high = keys[order], low[order], high[order]
        self.hashes, self.before = hashes[self.low], before[self.low]

    @staticmethod
    def _key(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
        return mixed(hashes ^ mixed(before + np.uint64(1)))

    def of(self, hashes: np.ndarray, before: np.ndarray, inner: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, behind the last) place of the known seeds with this hash and predecessor; ``none`` twice where there are none."""
        if not len(self.keys):
            return none, none
        k = np.minimum(np.searchsorted(self.keys, self._key(hashes, before)), len(self.keys) - 1)
        same = inner & (self.hashes[k] == hashes) & (self.before[k] == before)
        return np.where(same, self.low[k], none), np.where(same, self.high[k], none)


class Block:
    """Some benchmark items and their seeds."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.tokens = [np.frombuffer(t, np.uint64) for _, t in items]

    def __getstate__(self):
        return {"ids": self.ids, "tokens": self.tokens}

    @cached_property
    def seeds(self) -> list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray, np.ndarray, Followed]]:
        """For each mask: the hashes in order, their items, their positions, whether a hash's leading bits occur, and what precedes them."""
        out = []
        for masks, wanted in ((LONG_MASKS, lambda n: n >= STRETCH), (SHORT_MASKS, lambda n: SHORTEST <= n < STRETCH)):
            own = [k for k, t in enumerate(self.tokens) if wanted(len(t))]
            for mask in masks if own else []:
                found = [seed_hashes(self.tokens[k], mask) for k in own]
                item = np.repeat(own, [len(x) for x in found])
                place = np.concatenate([np.arange(len(x)) for x in found])
                hashes = np.concatenate(found)
                before = np.concatenate([np.append(np.zeros(1, np.uint64), x[:-1])[: len(x)] for x in found])
                order = np.lexsort((before, place > 0, hashes))
                bits = min(26, max(16, (32 * len(hashes)).bit_length()))
                seen = np.zeros(1 << bits, bool)
                seen[hashes >> np.uint64(64 - bits)] = True
                out.append((mask, hashes[order], item[order], place[order], seen, Followed(hashes[order], before[order], place[order] > 0)))
        return out

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int, int]]:
        """(text, item, start and end in the text, start in the item, equal tokens, tokens of the item), each alignment once."""
        words = Words(texts, token)
        hashes, doc, start = words.hashes(), words.doc, words.start
        found = set()
        for mask, known, item, place, seen, followed in self.seeds:
            own = seed_hashes(hashes, mask)
            if not len(own):
                continue
            bits = seen.size.bit_length() - 1
            at = np.flatnonzero(seen[own >> np.uint64(64 - bits)] & (doc[: len(own)] == doc[max(mask) :]))
            low, high = np.searchsorted(known, own[at]), np.searchsorted(known, own[at], side="right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            # equal seeds whose predecessors are equal too lie on an alignment that an earlier pair has given
            inner = (at > 0) & (doc[at] == doc[np.maximum(at, 1) - 1])
            skip, until = followed.of(own[at], own[np.maximum(at, 1) - 1], inner, high)
            first = (skip - low) + (high - until)
            each = np.repeat(np.arange(len(at)), first)
            hit = np.arange(len(each)) - np.repeat(np.cumsum(first) - first, first) + low[each]
            hit += np.where(hit >= skip[each], until[each] - skip[each], 0)
            found.update(zip(doc[at[each]].tolist(), item[hit].tolist(), (at[each] - place[hit]).tolist(), strict=True))
        out = []
        for text, k, shift in sorted(found):
            tokens = self.tokens[k]
            low, high = max(int(start[text]), shift), min(int(start[text + 1]), shift + len(tokens))
            stretch = min(STRETCH, len(tokens))
            if high - low < stretch:
                continue
            equal = np.concatenate([[0], np.cumsum(hashes[low:high] == tokens[low - shift : high - shift])])
            good = np.flatnonzero(equal[stretch:] - equal[:-stretch] >= np.ceil(SHARE * stretch))
            if len(good):
                a, b = int(good[0]), int(good[-1]) + stretch
                first = low - int(start[text])
                out.append((text, self.ids[k], first + a, first + b, low - shift + a, int(equal[b] - equal[a]), len(tokens)))
        return out


def _item_tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = Words(batch.column("text"), token)
        hashes = words.hashes()
        tokens = [hashes[a:b].tobytes() for a, b in zip(words.start, words.start[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(tokens, pa.binary()), pa.array(np.diff(words.start))], names=["item_id", "tokens", "n"])


def blocks(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> Iterator[Block]:
    """The benchmark's items, in blocks."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = texts.mapInArrow(_item_tokens, "item_id long, tokens binary, n long").where(F.col("n") >= SHORTEST)
    items = staged(items.groupBy("tokens", "n").agg(F.min("item_id").alias("item_id")), "benchmark")
    total = items.agg(F.sum("n")).first()[0] or 0
    n = -(-total // block_tokens)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("tokens"), F.lit(n)) == k).orderBy("item_id").collect()
        yield Block([(r["item_id"], bytes(r["tokens"])) for r in part])


def contaminated(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each verified overlap of a document and an item; starts and ends count tokens."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], MATCH)
    for block in blocks(benchmark, block_tokens):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = shared.value.matches(batch.column("text"))
                ids = batch.column("doc_id")
                columns = [ids.take(pa.array([r[0] for r in rows], pa.int64()))] + [pa.array([r[k] for r in rows], pa.int64() if k == 1 else pa.int32()) for k in range(1, 7)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "doc_start", "doc_end", "item_start", "n_equal", "item_tokens"])

        out = out.union(id_and_text(docs).mapInArrow(scan, MATCH))
    return out


def clean_only(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, with all their columns."""
    for block in blocks(benchmark, block_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in shared.value.matches(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
