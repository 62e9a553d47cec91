"""Token ids as raw binary shards, and a minimal perfect hash index of document keys over them.

A shard file holds the ids of its documents end to end, little-endian, 2 bytes each where the vocabulary allows (else 4),
each document closed by END_ID; behind them its table of documents (an Arrow stream) and a trailer of five 8-byte
numbers: shard, id width, bytes of ids, bytes of the table, MAGIC. Shards follow one another in ascending doc_id order.
Files are written and read by Spark, so they can lie in any store that Spark reaches.

The index is dealt into buckets by key hash. In a bucket, levels of bit arrays give each key a slot of its own among
exactly as many slots as keys; a slot stores a fingerprint of its key, the shard, the offset and the length. A lookup
takes a few probes whatever the number of documents; the fingerprint turns foreign keys away.

Defined cases: a null text is empty and has the end id only; rows that share a doc_id are keyed by their occurrence
(order of their texts) and share a shard; null doc_ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, mixed, slices, staged
from ledgerloom.session import work_path

END_ID = 0
SHARD_BYTES = 16 << 20
BUCKET_KEYS = 50_000
KNOWN_WORDS = 800_000
SLICE_BYTES = 6 << 20
MAGIC = 0x0058444E49444954
NULL_ID = -(1 << 63)

_MARKS = ".,;:!?#$%&*"


class Encoder:
    """A tokenizer of the tokenizers library that encodes each distinct word of a slice of texts once, and remembers words.

    With a byte-level pre-tokenizer a lone space between other characters always begins a new pre-token, so the ids of a
    text are those of its space-separated words, each with the space before it; likewise marks after a letter begin a new
    pre-token, so words that differ in the marks behind them are encoded once. Texts in which a space has white space or
    nothing beside it are encoded whole. Words are told apart, cut and put together again in Arrow.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word = self.library.normalizer is None and str(self.library.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        self.opens = np.zeros(self.library.get_vocab_size(), bool)
        self.opens[[i for token, i in self.library.get_vocab().items() if token.startswith("Ġ")]] = True
        self.known = (pa.array([], pa.string()), pa.array([], pa.binary()))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(self, words: list[str]) -> pa.Array:
        """Ids of words that neither begin nor end with white space, with a space before each."""
        parts = []
        for low in range(0, len(words), 1000):
            some = words[low : low + 1000]
            found = self.whole([" " + " ".join(some)])[0]
            starts = np.flatnonzero(self.opens[np.frombuffer(found, self.dtype)])
            if len(starts) == len(some):
                cuts = np.append(starts * self.dtype.itemsize, len(found)).astype(np.int32)
                parts.append(pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(cuts), pa.py_buffer(found)]))
            else:
                parts.append(pa.array(self.whole([f" {w}" for w in some]), pa.binary()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def remembered(self, words: pa.Array) -> pa.Array:
        """As ``spaced``; words that this process has met before, up to KNOWN_WORDS of them, are not encoded again."""
        at = pc.index_in(words, value_set=self.known[0])
        place, unseen = at.fill_null(0).to_numpy().astype(np.int64), at.is_null().to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(unseen))
        place[unseen] = len(self.known[0]) + np.arange(len(new))
        found = self.spaced(new.to_pylist())
        both = (pa.concat_arrays([self.known[0], new]), pa.concat_arrays([self.known[1], found]))
        out = both[1].take(pa.array(place))
        if len(new):
            over = len(both[0]) > KNOWN_WORDS
            self.known = tuple(pa.concat_arrays([x[-KNOWN_WORDS // 2 :]]) for x in both) if over else both  # the older half is forgotten
        return out

    def words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct words, and which of them only a whole text can be encoded with (their ids are empty)."""

        def of_char(start: int, stop: int | None, test, of: pa.Array) -> np.ndarray:
            coded = pc.utf8_slice_codeunits(of, start, stop).dictionary_encode()
            known = np.array([test(c) for c in coded.dictionary.to_pylist()], bool)
            return known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, bool)

        blank = lambda c: not c or c.isspace()
        odd = of_char(0, 1, blank, words) | of_char(-1, None, blank, words)
        plain = words.filter(pa.array(~odd))
        stems = pc.utf8_rtrim(plain, characters=_MARKS)
        marked = of_char(-1, None, str.isalpha, stems) & pc.not_equal(stems, plain).to_numpy(zero_copy_only=False)
        mask = pa.array(marked)
        marks = pc.replace_substring_regex(plain.filter(mask), f"(?s)^.*?([{re.escape(_MARKS)}]*)$", r"\1").dictionary_encode()
        stems = pc.if_else(mask, stems, plain).dictionary_encode()
        tail_of = pa.array([b"", *self.whole(marks.dictionary.to_pylist())], pa.binary())
        tail = np.zeros(len(plain), np.int64)
        tail[marked] = 1 + marks.indices.to_numpy(zero_copy_only=False)
        ids = pc.binary_join_element_wise(self.remembered(stems.dictionary).take(stems.indices), tail_of.take(pa.array(tail)), b"")
        place = np.full(len(words), len(plain), np.int64)
        place[~odd] = np.arange(len(plain))
        return pa.concat_arrays([ids, pa.array([b""], pa.binary())]).take(pa.array(place)), odd

    def encode_slice(self, texts: pa.Array, end: bytes = b"") -> tuple[bytes, np.ndarray]:
        """Little-endian ids of all texts, each with ``end`` behind it, and the number of ids of each."""
        n = len(texts)
        if not n:
            return b"", np.zeros(0, np.int64)
        lists = pc.split_pattern(texts, " ") if self.by_word else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), texts)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        leads = np.zeros(len(flat), bool)
        leads[np.cumsum(lengths) - lengths] = True
        first = flat.filter(pa.array(leads))
        coded = flat.filter(pa.array(~leads)).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, odd = self.words(coded.dictionary) if len(code) else (pa.array([], pa.binary()), np.zeros(0, bool))
        doc = np.repeat(np.arange(n), lengths - 1)
        in_one = np.zeros(n, bool)  # these are encoded whole
        in_one[doc[odd[code]]] = True
        in_one |= np.array([not w or w[-1].isspace() for w in first.to_pylist()], bool) & (lengths > 1)
        own = pa.array(self.whole(pc.if_else(pa.array(in_one), texts, first).to_pylist()), pa.binary())
        pieces = np.where(in_one, 1, lengths) + 1
        starts = np.cumsum(pieces) - pieces
        order = np.full(int(pieces.sum()), -1, np.int64)
        order[starts] = len(ids) + np.arange(n)
        order[starts + pieces - 1] = len(ids) + n
        order[order < 0] = code[~in_one[doc]]
        laid = pa.concat_arrays([ids, own, pa.array([end], pa.binary())]).take(pa.array(order))
        at = np.frombuffer(laid.buffers()[1], np.int32)[laid.offset : laid.offset + len(laid) + 1]
        payload = laid.buffers()[2].to_pybytes()[at[0] : at[-1]] if laid.buffers()[2] else b""
        return payload, (at[starts + pieces] - at[starts]).astype(np.int64) // self.dtype.itemsize

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        payload, counts = self.encode_slice(pa.array(texts, pa.string()))
        ends = (np.cumsum(counts) * self.dtype.itemsize).tolist()
        return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _shard_file(path: str):
    """The rows of a shard file: Spark's text writer puts a zero byte, the separator, where each row leaves its last off."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        end = np.array([END_ID], one.dtype).tobytes()
        ids, lengths, payload = [], [], 0
        for batch in slices(batches, SLICE_BYTES):
            joined, counts = one.encode_slice(batch.column("text"), end)
            ids.append(batch.column("doc_id"))
            lengths.append(counts)
            payload += len(joined)
            if joined:
                yield pa.RecordBatch.from_arrays([pa.array([joined[:-1]], pa.binary())], names=["value"])
            pa.default_memory_pool().release_unused()
        if not ids:
            return
        keys = pa.chunked_array(ids).combine_chunks()
        numbers = keys.fill_null(NULL_ID).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        occurrence = np.arange(len(numbers)) - np.repeat(first, np.diff([*first, len(numbers)]))
        table = pa.table({"doc_id": keys, "occurrence": occurrence, "n_tokens": np.concatenate(lengths)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        docs = sink.getvalue().to_pybytes()
        tail = np.array([TaskContext.get().partitionId(), one.dtype.itemsize, payload, len(docs), MAGIC], "<u8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([(docs + tail)[:-1]], pa.binary())], names=["value"])

    return scan


def write_shards(docs: DataFrame, tokenizer: str, location: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode all texts, in ascending doc_id order, into shard files below ``location``."""
    texts = id_and_text(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    ordered = texts.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(_shard_file(tokenizer), "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(location)


def open_shard(content: bytes) -> tuple[int, np.ndarray, pa.Table]:
    """Number, ids and table of documents of a shard file."""
    shard, width, payload, table, magic = np.frombuffer(content[-40:], "<u8").tolist()
    if magic != MAGIC:
        raise ValueError("not a shard file")
    docs = pa.ipc.open_stream(content[payload : payload + table]).read_all()
    return shard, np.frombuffer(content, f"<u{width}", payload // width), docs


def shard_files(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.format("binaryFile").load(location).where("length > 0").select("content")


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content").to_pylist():
            shard, _, docs = open_shard(content)
            n = docs["n_tokens"].to_numpy()
            columns = {"doc_id": docs["doc_id"], "occurrence": docs["occurrence"], "shard": np.full(len(n), shard), "place": np.cumsum(n) - n, "n_tokens": n}
            yield from pa.table(columns).to_batches()


def key_hash(doc_id: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return mixed(doc_id.view(np.uint64) ^ (occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _bucketed(buckets: int):
    """Rows with the bucket of their key in front."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = key_hash(batch.column("doc_id").fill_null(NULL_ID).to_numpy(), batch.column("occurrence").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(buckets)).astype(np.int64)), *batch.columns], names=["bucket", *batch.schema.names])

    return scan


class PerfectHash:
    """Slots 0 .. n - 1 of n distinct keys. A level's bits mark the places that one remaining key alone fell on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        self.before = np.cumsum([0] + [int(r[-1]) for r in self.ranks])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * 0xD1342543DE82EF95 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) > 60:
                raise ValueError("two keys have one hash")
            size = max(8, -(-2 * len(left) // 8) * 8)
            place = cls._place(left, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[place]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for some that are not in the set."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            place = self._place(keys[open_], level, len(bits))
            hit = bits[place]
            out[open_[hit]] = self.before[level] + self.ranks[level][place[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        at, levels = 4 + 4 * n, []
        for size in np.frombuffer(data, "<u4", n, 4).tolist():
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size // 8, at)).astype(bool))
            at += size // 8
        return cls(levels)


def _fingerprint(key: np.ndarray) -> np.ndarray:
    return (mixed(key ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


INDEX = "bucket long, levels binary, fingerprints binary, shards binary, places binary, lengths binary"


def _index_bucket(table: pa.Table) -> pa.Table:
    key = key_hash(table["doc_id"].combine_chunks().fill_null(NULL_ID).to_numpy(), table["occurrence"].to_numpy())
    perfect = PerfectHash.build(key)
    order = np.argsort(perfect.slots(key))
    columns = [_fingerprint(key), *(table[c].to_numpy().astype(t) for c, t in (("shard", "<u4"), ("place", "<u8"), ("n_tokens", "<u8")))]
    names = [x.split()[0] for x in INDEX.split(", ")]
    values = [[table["bucket"][0].as_py()], [perfect.to_bytes()], *([x[order].tobytes()] for x in columns)]
    return pa.table([pa.array(v, pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(values)], names=names)


def build_index(spark: SparkSession, location: str, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """The index of the shard files below ``location``, one row per bucket, and the number of buckets."""
    entries = staged(shard_files(spark, location).mapInArrow(_documents, "doc_id long, occurrence long, shard long, place long, n_tokens long"), "shard-documents")
    buckets = max(1, -(-entries.count() // bucket_keys))
    schema = f"bucket long, {', '.join(f'{n} long' for n in entries.columns)}"
    index = entries.mapInArrow(_bucketed(buckets), schema).groupBy("bucket").applyInArrow(_index_bucket, INDEX)
    return staged(index, "index"), buckets


LOCATED = "doc_id long, occurrence long, shard long, place long, n_tokens long"


def _look_up(keys: pa.Table, index: pa.Table) -> pa.Table:
    names = [x.split()[0] for x in LOCATED.split(", ")]
    if not keys.num_rows or not index.num_rows:
        return pa.table([pa.array([], pa.int64())] * 5, names=names)
    row = index.to_pylist()[0]
    key = key_hash(keys["doc_id"].combine_chunks().fill_null(NULL_ID).to_numpy(), keys["occurrence"].to_numpy())
    slot = PerfectHash.from_bytes(row["levels"]).slots(key)
    own = (slot >= 0) & (np.frombuffer(row["fingerprints"], np.uint32)[slot] == _fingerprint(key))
    found = [np.frombuffer(row[c], t)[slot[own]].astype(np.int64) for c, t in (("shards", "<u4"), ("places", "<u8"), ("lengths", "<u8"))]
    kept = keys.filter(pa.array(own))
    return pa.table([kept["doc_id"], kept["occurrence"], *map(pa.array, found)], names=names)


def locate(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Shard, place and length of the documents with the given (doc_id, occurrence); keys that are not there have no row."""
    keys = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("occurrence").cast("long").alias("occurrence"))
    keyed = keys.mapInArrow(_bucketed(buckets), "bucket long, doc_id long, occurrence long")
    return keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_look_up, LOCATED)


def _shard_content(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content").to_pylist():
            shard, ids, _ = open_shard(content)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([ids.dtype.itemsize]), pa.array([ids.tobytes()], pa.binary()), pa.array([len(ids)])], names=["shard", "width", "ids", "n_ids"])


def _read(located: pa.Table, shards: pa.Table) -> pa.Table:
    ids = np.zeros(0, "<u2")
    if shards.num_rows:
        ids = np.frombuffer(shards["ids"][0].as_py(), f"<u{shards['width'][0].as_py()}")
    sums = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(located["place"].to_pylist(), located["n_tokens"].to_pylist(), strict=True)]
    return located.select(["doc_id", "shard", "place", "n_tokens"]).append_column("ids_crc32", pa.array(sums, pa.int64()))


def read_back(spark: SparkSession, location: str, located: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the located documents, from the ids in the files."""
    shards = shard_files(spark, location).mapInArrow(_shard_content, "shard long, width long, ids binary, n_ids long")
    read = located.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(_read, "doc_id long, shard long, place long, n_tokens long, ids_crc32 long")
    # One row per shard file: running totals over a few numbers.
    sizes = staged(shards.select("shard", "n_ids"), "shard-sizes")
    before = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")
    bases = sizes.select(F.col("shard").alias("base_shard"), before.alias("base"))
    joined = read.join(bases, F.col("shard") == F.col("base_shard"))
    return joined.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def keys_of(docs: DataFrame) -> DataFrame:
    """The key of every row: doc_id and its occurrence."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.withColumn("occurrence", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id")) - 1)


def encoded_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write shards and index of all documents, then find each through the index and read its ids back."""
    spark = docs.sparkSession
    location = work_path(spark, "shards")
    write_shards(docs, tokenizer, location)
    index, buckets = build_index(spark, location)
    return read_back(spark, location, locate(keys_of(docs), index, buckets))
