"""What the operators share: reading and staging tables, text batches, word hashes, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import work_path

#: Bytes of text that one step inside a task holds at once; a single longer document is held whole.
BATCH_BYTES = 4 << 20

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the folder the cluster shares and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, *columns) -> DataFrame:
    """doc_id as long and text as string without nulls; other columns of ``docs`` are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *columns)


def digest(text: str = "text"):
    """A long that tells apart rows which share a doc_id; rows equal in both are one document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def slices(batches: Iterable[pa.RecordBatch], size: int = BATCH_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``size`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        step = np.cumsum(sizes, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                yield batch.slice(low, high - low)


def raw_bytes(texts: pa.Array) -> list[bytes]:
    return pc.fill_null(texts, "").cast(pa.binary()).to_pylist()


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, laid end to end.

    ``start[i] : start[i + 1]`` are those of text i; ``code`` numbers the words within ``distinct``.
    """

    def __init__(self, texts: pa.Array, keep: Callable[[str], str] | None = None):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        if keep:
            words = [keep(w) for w in words]
        filled = np.fromiter(map(bool, words), bool, len(words))[code] if len(words) else np.zeros(0, bool)
        before = np.concatenate([[0], np.cumsum(filled)]).astype(np.int64)
        self.start = before[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
        self.code, self.distinct = code[filled], words
        self.doc = np.repeat(np.arange(len(lengths)), np.diff(self.start))

    def hashes(self) -> np.ndarray:
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.distinct), np.uint64, len(self.distinct))
        return own[self.code] if len(self.distinct) else np.zeros(0, np.uint64)


class Rolling:
    """Polynomial fingerprints, modulo 2**64, of runs of hashes: ``of(n)[p]`` is that of ``hashes[p : p + n]``."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.full(n + 1, MULTIPLIER, np.uint64)
        power[0] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(power[:n] if n else power[:0]), dtype=np.uint64)])
        back = np.full(n + 1, INVERSE, np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)

    def of(self, n: int) -> np.ndarray:
        return mixed((self.sums[n:] - self.sums[: len(self.sums) - n]) * self.back[: len(self.sums) - n] + np.uint64(n))


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of each value spread over all 64 places, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among values reduced to one (value, smallest value linked to it) per value, those to itself left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(pu, pv)[apart], np.minimum(pu, pv)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node reachable.

    Alternating large and small stars: each round links the neighbours of a node to the smallest of them. The state is
    written to shared storage in each round. A hub's rows are joined to one row of minima that was written before, so
    that adaptive execution can split the hub.
    """
    links = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(links)
    while now[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("low")), "least")
        large = both.where("v > u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = staged(large, "links")
        least = staged(large.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "node"), "least")
        small = large.join(least, F.col("u") == F.col("node")).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        links = staged(small.union(least.select(F.col("node").alias("u"), F.col("low").alias("v"))).distinct(), "links")
        before, now = now, state(links)
        if before == now:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
