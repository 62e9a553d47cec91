"""Line deduplication by pairwise alignment.

Lines are compared without white space at their ends. A line of a document is deleted if it lies in a run of consecutive
lines, of RUN_WORDS words or more together, that an earlier document (smaller doc_id) has as well: any line of that many
words, and any block of shorter lines. This holds against all earlier documents, wherever the run stands in them and
however often it occurs in either.

Documents are linked by the shortest runs that reach RUN_WORDS words: of each line, the one that begins with it and the
one that ends with it. Every line of a longer common run lies in such a run inside it, so these links are enough. Each
run links its documents to its earliest holder alone: a run shared by any number of documents gives each later one a
single partner, and no pairs among them; no run or partner is left out for being frequent. Each pair is aligned by
patience diff (lines that occur once in both, longest rising chain, then the same again between and around the chain's
lines). Aligned blocks of RUN_WORDS words or more are deleted from the later document, and so are the linking runs that
stand in another order, or more often, and cannot be aligned. Every deleted line is still in an earlier document.

``delete_shared_blocks`` is the narrower first form: single lines link, to their first holder, and only aligned blocks of
BLOCK_WORDS words are deleted. No query uses it.

Defined cases: null and empty texts have no lines; null doc_ids come before all others; rows that share a doc_id are
never partners of each other; repeated rows get the same result each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rolling, digest, id_and_text, mixed, slices, staged

RUN_WORDS = 5
RARE_WORDS = 5
BLOCK_WORDS = 10
NULL_ID = -(1 << 63)


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and word counts of each document's lines, and the hashes that may link it."""
    for batch in slices(batches):
        hashes, words, rare = [], [], []
        for text in batch.column("text").to_pylist():
            lines = [x.strip() for x in text.split("\n")] if text else []
            own = [xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines]
            count = [len(x.split()) for x in lines]
            times = Counter(own)
            hashes.append(own)
            words.append(count)
            rare.append([h for h, n in zip(own, count, strict=True) if n >= RARE_WORDS and times[h] == 1])
        arrays = [batch.column("id"), batch.column("digest"), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(rare, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "digest", "lines", "words", "rare"])


def runs(own: Sequence[int], count: Sequence[int], least: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and fingerprint of the shortest runs of ``least`` words that begin or end with each line."""
    before = np.concatenate([[0], np.cumsum(np.asarray(count, np.int64))]).astype(np.int64)
    place = np.arange(len(before))
    end = np.searchsorted(before, before + least)
    start = np.searchsorted(before, before - least, side="right") - 1
    ahead, behind = end < len(before), start >= 0
    both = np.stack([np.concatenate([place[ahead], start[behind]]), np.concatenate([end[ahead], place[behind]])])
    low, high = np.unique(both, axis=1) if both.shape[1] else both
    rolling = Rolling(np.asarray(own, np.int64).view(np.uint64))
    return low, high, mixed((rolling.sums[high] - rolling.sums[low]) * rolling.back[low] + (high - low).astype(np.uint64)).view(np.int64)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and word counts of each document's lines, and its runs with their places (start and end in one long)."""
    for batch in slices(batches):
        hashes, words, linking, places = [], [], [], []
        for text in batch.column("text").to_pylist():
            lines = [x.strip() for x in text.split("\n")] if text else []
            hashes.append([xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines])
            words.append([len(x.split()) for x in lines])
            low, high, found = runs(hashes[-1], words[-1])
            linking.append(found)
            places.append(low << 32 | high)
        lists = [pa.array(x, pa.list_(t)) for x, t in ((hashes, pa.int64()), (words, pa.int32()), (linking, pa.int64()), (places, pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *lists], names=["id", "digest", "lines", "words", "runs", "places"])


def align(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of two sequences, rising in both, by patience diff."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        pairs = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in where]
        tops: list[int] = []  # piles' top cards
        at: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            pile = bisect_left(tops, j)
            back.append(at[pile - 1] if pile else -1)
            tops[pile : pile + 1], at[pile : pile + 1] = [j], [k]
        chain, k = [], at[-1] if at else -1
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        if not chain:
            continue
        out.extend(chain)
        edges = [(a0 - 1, b0 - 1), *reversed(chain), (a1, b1)]
        open_.extend((i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:], strict=False))
    return sorted(out)


def common_blocks(later: Sequence[int], words: Sequence[int], earlier: Sequence[int], least: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """[start, end) of the lines of ``later`` in aligned blocks that go on in both and have ``least`` words or more."""
    blocks: list[list[int]] = []
    last = (-2, -2)
    for i, j in align(later, earlier):
        if (i - 1, j - 1) == last:
            blocks[-1][1] = i + 1
        else:
            blocks.append([i, i + 1])
        last = i, j
    return [(a, b) for a, b in blocks if sum(words[a:b]) >= least]


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            found = common_blocks(r["lines"], r["words"], r["other_lines"])
            if found:
                rows.append((r["id"], r["digest"], r["partner"], [x for block in found for x in block]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["id", "digest", "partner", "blocks"])


def _run_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligned blocks of each pair, and the linking runs outside of them."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            found = common_blocks(r["lines"], r["words"], r["other_lines"], RUN_WORDS)
            inside = {k for a, b in found for k in range(a, b)}
            for place in sorted(r["places"]):
                a, b = place >> 32, place & 0xFFFFFFFF
                if a not in inside or b - 1 not in inside or any(k not in inside for k in range(a, b)):
                    found.append((a, b))
                    inside.update(range(a, b))
            rows.append((r["id"], r["digest"], r["partner"], [x for block in found for x in block]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["id", "digest", "partner", "blocks"])


def shared_runs(docs: DataFrame) -> DataFrame:
    """id (NULL_ID for null), digest, partner and blocks (starts and ends of lines, in turn) of each linked pair."""
    texts = id_and_text(docs, digest().alias("digest")).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "digest", "text")
    # Written without repeated rows: a join right behind the aggregate could not split a partner of very many documents.
    lines = texts.mapInArrow(_runs, "id long, digest long, lines array<long>, words array<int>, runs array<long>, places array<long>")
    lines = staged(lines.dropDuplicates(["id", "digest"]), "lines")
    links = lines.select("id", "digest", F.explode(F.arrays_zip("runs", "places")).alias("k")).select("id", "digest", F.col("k.runs").alias("run"), F.col("k.places").alias("place"))
    # The earliest holder of each run: partial minima before the shuffle. Runs of one document only link nothing.
    first = links.groupBy("run").agg(F.min(F.struct("id", "digest")).alias("first"), F.max("id").alias("last"))
    first = staged(first.where(F.col("first.id") < F.col("last")).select("run", F.col("first.id").alias("partner"), F.col("first.digest").alias("partner_digest")), "first-holders")
    held = links.join(first, "run").where("id > partner")
    # A document has at most two runs per line of its own.
    pairs = staged(held.groupBy("id", "digest", "partner", "partner_digest").agg(F.collect_list("place").alias("places")), "pairs")
    later = lines.select("id", "digest", "lines", "words")
    other = lines.select(F.col("id").alias("partner"), F.col("digest").alias("partner_digest"), F.col("lines").alias("other_lines"))
    both = pairs.join(other, ["partner", "partner_digest"]).join(later, ["id", "digest"])
    return both.select("id", "digest", "partner", "places", "lines", "words", "other_lines").mapInArrow(_run_blocks, "id long, digest long, partner long, blocks array<int>")


def shared_blocks(docs: DataFrame) -> DataFrame:
    """id (NULL_ID for null), digest, partner and blocks (starts and ends of lines, in turn) of each pair with any."""
    texts = id_and_text(docs, digest().alias("digest")).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "digest", "text")
    lines = staged(texts.mapInArrow(_lines, "id long, digest long, lines array<long>, words array<int>, rare array<long>"), "lines")
    lines = lines.dropDuplicates(["id", "digest"])
    links = lines.select("id", "digest", F.explode("rare").alias("line"))
    # The earliest holder of each line: partial minima before the shuffle. Lines of one document only link nothing.
    first = links.groupBy("line").agg(F.min(F.struct("id", "digest")).alias("first"), F.max("id").alias("last"))
    first = staged(first.where(F.col("first.id") < F.col("last")).select("line", F.col("first.id").alias("partner"), F.col("first.digest").alias("partner_digest")), "first-holders")
    pairs = links.join(first, "line").where("id > partner").select("id", "digest", "partner", "partner_digest").distinct()
    pairs = staged(pairs, "pairs")
    later = lines.select("id", "digest", "lines", "words")
    other = lines.select(F.col("id").alias("partner"), F.col("digest").alias("partner_digest"), F.col("lines").alias("other_lines"))
    both = pairs.join(other, ["partner", "partner_digest"]).join(later, ["id", "digest"])
    return both.select("id", "digest", "partner", "lines", "words", "other_lines").mapInArrow(_blocks, "id long, digest long, partner long, blocks array<int>")


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        total, gone, texts = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
            lines = text.split("\n") if text else []
            deleted = {k for blocks in found or [] for a, b in zip(blocks[::2], blocks[1::2], strict=True) for k in range(a, b)}
            total.append(len(lines))
            gone.append(sorted(deleted))
            texts.append("\n".join(x for k, x in enumerate(lines) if k not in deleted) if deleted else text)
        arrays = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array([len(x) for x in gone], pa.int64()), pa.array(gone, pa.list_(pa.int32())), batch.column("partners"), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_deleted", "deleted", "partners", "text"])


def _left(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted, partners and text of every row, without the lines of its blocks."""
    # A document has no more partners than links of its own.
    found = blocks.groupBy("id", "digest").agg(F.collect_list("blocks").alias("found"), F.array_sort(F.collect_set("partner")).alias("partners"))
    texts = id_and_text(docs, digest().alias("digest")).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "doc_id", "digest", "text")
    # A sort-merge join at any size: a small list would be broadcast, a large one not, and plan and disk would jump.
    joined = texts.join(staged(found, "blocks").hint("merge"), ["id", "digest"], "left")
    kept = joined.select("doc_id", "text", "found", F.coalesce("partners", F.array().cast("array<long>")).alias("partners"))
    return kept.mapInArrow(_without, "doc_id long, n_lines long, n_deleted long, deleted array<int>, partners array<long>, text string")


def delete_shared_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (line numbers), partners (earlier documents) and the text left of every row."""
    return _left(docs, shared_runs(docs))


def delete_shared_blocks(docs: DataFrame) -> DataFrame:
    """The same columns by the narrower first form."""
    return _left(docs, shared_blocks(docs))
