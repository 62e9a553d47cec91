"""Quality classifier: Naive Bayes support vectors.

A word counts as its letters (lower case, without marks at the ends) and as its shape (case, digits, marks around it).
Indicators of unigrams and bigrams of both are hashed to 2**18 features, scaled by the class log-count ratios of Naive
Bayes and brought to length 1. A linear model with hinge loss is fitted by dual coordinate descent on each of SHARDS
parts of the sample and averaged; a logistic curve, fitted on a fifth of the sample kept apart, turns margins into scores.

The fit sees a sample of at most SAMPLE labelled documents (those with the smallest hash of doc_id); scoring sees every
row and whole texts. The model has 2**18 weights at any input size.

Defined cases: null and empty texts have no indicator and get the score of the bare curve; without both classes among
the labels every score is the share of label 1, or 0.5 without labels; rows without doc_id are scored, not learned from;
a doc_id labelled more than once has the largest label; other columns are kept by ``keep_good``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Words, id_and_text, mixed, slices, staged

BITS = 18
SAMPLE = 20_000
SHARDS = 8
EPOCHS = 12
COST = 1.0
PIECES = 32

_PARTS = re.compile(r"^(\W*)(.*?)(\W*)$", re.DOTALL)


def letters_and_shape(word: str) -> tuple[str, str]:
    if word.isalpha():
        return word.lower(), "l" if word.islower() else "T" if word[1:].islower() or len(word) == 1 else "U" if word.isupper() else "m"
    before, core, after = _PARTS.match(word).groups()
    case = "d" if core.isdigit() else "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "m" if core != core.lower() else "l"
    return core.lower(), f"{before[:3]}{case if core else ''}{after[:3]}"


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every indicator that is set, in order, each once."""
    words = Words(texts)
    parts = [letters_and_shape(w) for w in words.distinct]
    marks = [np.fromiter((xxhash.xxh64_intdigest(p[k], k) for p in parts), np.uint64, len(parts))[words.code] if parts else np.zeros(0, np.uint64) for k in (0, 1)]
    doc, found = words.doc, []
    for k, own in enumerate(marks):
        found.append((doc, mixed(own + np.uint64(2 * k))))
        if len(own) > 1:
            inside = doc[1:] == doc[:-1]
            found.append((doc[1:][inside], mixed(own[:-1] * np.uint64(3) + own[1:] + np.uint64(2 * k + 1))[inside]))
    keys = np.sort(np.concatenate([(d << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64) for d, h in found]))
    keys = keys[np.concatenate([keys[:1] >= 0, keys[1:] != keys[:-1]])]
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        scaled = self.ratio[feature]
        length = np.sqrt(np.bincount(doc, scaled * scaled, n))
        return np.bincount(doc, scaled * self.weight[feature], n) / np.maximum(length, 1e-9) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.margins(*features(texts), len(texts)) + self.offset)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``fold`` modulo ``folds``; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, sample: int) -> DataFrame:
    """doc_id, text and label of at most ``sample`` labelled documents outside the held-out fold."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~in_fold(F.col("doc_id"), folds, held_out))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return id_and_text(docs).join(F.broadcast(own), "doc_id")  # at most ``sample`` pairs of numbers


def _sampled_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        doc, feature = features(batch.column("text"))
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        packed = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], names=["doc_id", "label", "packed"])


def _class_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that have each feature, in pieces of the feature range."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for label, packed in zip(batch.column("label").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            counts[label][np.frombuffer(packed, np.int32)] += 1
    pieces = [x.tobytes() for x in np.split(counts, PIECES, axis=1)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(pieces, pa.binary())], names=["piece", "counts"])


def _summed_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[piece] = sums.get(piece, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "counts"])


def descend(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model of (label, features) rows, by dual coordinate descent; classes weigh alike."""
    weight, bias = np.zeros(len(ratio)), 0.0
    data = []
    share = max(1, sum(label for label, _ in rows)), max(1, sum(1 - label for label, _ in rows))
    for label, feature in rows:
        x = ratio[feature]
        x = x / max(np.sqrt(x @ x), 1e-9)
        data.append((feature, x, 2 * label - 1, cost * len(rows) / (2 * share[1 - label]), x @ x + 1))
    dual = np.zeros(len(data))
    random = np.random.default_rng(8)
    for _ in range(epochs):
        for i in random.permutation(len(data)):
            feature, x, y, most, square = data[i]
            slope = y * (weight[feature] @ x + bias) - 1
            step = min(max(dual[i] - slope / square, 0), most) - dual[i]
            if step:
                dual[i] += step
                weight[feature] += step * y * x
                bias += step * y
    return weight, bias


def curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of labels over margins, by Newton steps with a light prior."""
    if not len(label):
        return 4.0, 0.0
    # Smoothed targets keep the curve finite where the classes are apart.
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, at = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ at)
        at = at - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * at)
    return float(at[0]), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    rows = labelled_sample(docs, labels, label, folds, held_out, sample).mapInArrow(_sampled_features, "doc_id long, label int, packed binary")
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5 * SHARDS))
    rows = staged(rows.withColumn("shard", (part % SHARDS).cast("int")).withColumn("apart", part < SHARDS), "quality-sample")
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        flat = np.zeros(1 << BITS)
        share = (seen.get(1, 0) + 1e-9) / (sum(seen.values()) + 2e-9)
        return Model(flat, flat, 0.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else 30.0 * (1 if share else -1))
    counts = rows.mapInArrow(_class_counts, "piece int, counts binary").repartition(PIECES, "piece").mapInArrow(_summed_counts, "piece int, counts binary")
    pieces = {r["piece"]: np.frombuffer(r["counts"], np.int64).reshape(2, -1) for r in counts.collect()}
    none, all_ = np.concatenate([pieces[k] for k in range(PIECES)], axis=1) + 1.0
    ratio = np.log((all_ / all_.sum()) / (none / none.sum()))
    shared = spark.sparkContext.broadcast(ratio)

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        for batch in batches:
            for shard, y, packed in zip(batch.column("shard").to_pylist(), batch.column("label").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                shards.setdefault(shard, []).append((y, np.frombuffer(packed, np.int32)))
        for own in shards.values():
            if len({y for y, _ in own}) == 2:
                weight, bias = descend(own, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([weight.astype(np.float32).tobytes()]), pa.array([bias])], names=["weight", "bias"])

    ordered = rows.where("NOT apart").repartition(SHARDS, "shard").sortWithinPartitions("shard", "doc_id", F.xxhash64("packed"))
    fitted = [(np.frombuffer(r["weight"], np.float32).astype(np.float64), r["bias"]) for r in ordered.mapInArrow(train, "weight binary, bias double").collect()]
    if not fitted:  # no shard has both classes: the whole sample, itself bounded, is fitted at once
        whole = [(r["label"], np.frombuffer(r["packed"], np.int32)) for r in rows.orderBy("doc_id").collect()]
        fitted = [descend(whole, ratio)]
    model = Model(ratio, np.mean([w for w, _ in fitted], axis=0), float(np.mean([b for _, b in fitted])), 1.0, 0.0)
    learned = spark.sparkContext.broadcast(model)

    def margins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.int32) for x in batch.column("packed").to_pylist()]
            doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            found = learned.value.margins(doc, np.concatenate([*sets, np.zeros(0, np.int32)]), len(sets))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found)], names=["label", "margin"])

    apart = rows.where("apart").mapInArrow(margins, "label int, margin double").orderBy("margin", "label").collect()
    model.slope, model.offset = curve(np.array([r["margin"] for r in apart]), np.array([r["label"] for r in apart]))
    return model


def score(docs: DataFrame, model: Model, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")))], names=["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(scan, "doc_id long, score double")
    return scored.select("doc_id", in_fold(F.col("doc_id"), folds, held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.scores(batch.column("text")) >= 0.5))

    return docs.mapInArrow(scan, docs.schema)
