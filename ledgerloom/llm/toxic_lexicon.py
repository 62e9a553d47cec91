"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding takes compatibility forms apart, drops accents and invisible characters, lower-cases, and turns look-alike letters
of other scripts and digits or signs within words into the letters they stand for; lexicon and text are folded alike.

The lexicon is learned from labelled documents: beginnings of words (4 to 8 letters, or the whole word) whose log odds of
standing in toxic documents are above zero by Z standard errors. Documents are counted by a signature, so that copies of
one document count once. A beginning is kept if no shorter one says as much. Phrases around a lexicon word that mostly
stand in documents that are not toxic become exceptions: a match within one does not count. The weights of a document's
matches are added up, divided by a power of its number of words that is chosen on the sample, and turned into a score by
a logistic curve.

The fit sees at most SAMPLE labelled documents (those with the smallest hash of doc_id), and keeps at most LEXICON
entries and as many exceptions; scoring sees every row and whole texts.

Defined cases: null and empty texts have no match; without both labels the score is the share of label 1, or 0 without
labels; rows without doc_id are scored, not learned from; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, slices, staged
from ledgerloom.llm.nbsvm import curve, in_fold, labelled_sample, sigmoid

SAMPLE = 20_000
LEXICON = 5_000
Z = 3.0
LEAST_WEIGHT = 1.5
STEMS = range(4, 9)
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)

#: Letters of other scripts that look like Latin ones, and digits and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

_DROPPED = [*range(0x0300, 0x0370), 0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
_TABLE = {ord(k): v for k, v in LOOK_ALIKES.items()} | dict.fromkeys(_DROPPED)
_DISGUISED = re.compile(r"(?<=[^\W\d_])[0134578@$!|€9]+(?=[^\W\d_])|(?<![^\W_])[0134578@$€9]+(?=[^\W\d_])")
_SUBSTITUTES = str.maketrans(SUBSTITUTES)


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_TABLE).lower().translate(_TABLE)
    return _DISGUISED.sub(lambda m: m[0].translate(_SUBSTITUTES), text.lower())


def _words(folded: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", folded)


@dataclass
class Lexicon:
    """Weights of beginnings of words ("idio"), of whole words ("idiot " with a blank) and phrases that are exceptions."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        entries = defaultdict(list)
        for entry, weight in self.weights.items():
            entries[entry.strip()].append((entry.endswith(" "), weight))
        for phrase in self.exceptions:
            entries[phrase].append((True, None))
        for key, value in entries.items():
            out.add_word(key, (len(key), value))
        if entries:
            out.make_automaton()
        return out

    def find(self, automaton: ahocorasick.Automaton, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches at word starts, the heaviest at each start, without those in exceptions."""
        found: dict[int, tuple[int, float]] = {}
        excepted = []
        for last, (length, values) in automaton.iter(folded) if len(automaton) else ():
            start, end = last + 1 - length, last + 1
            if start and folded[start - 1].isalpha():
                continue
            closed = end == len(folded) or not folded[end].isalpha()
            for whole, weight in values:
                if whole and not closed:
                    continue
                if weight is None:
                    excepted.append((start, end))
                elif weight > found.get(start, (0, 0.0))[1]:
                    found[start] = end, weight
        return [(s, e, w) for s, (e, w) in sorted(found.items()) if not any(a <= s and e <= b for a, b in excepted)]

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of weights and number of words of each text."""
        automaton = self.automaton()
        sums = [sum(w for _, _, w in self.find(automaton, fold(x))) for x in texts]
        return np.array(sums, float), np.array([len(x.split()) for x in texts], float)

    def scores(self, texts: list[str]) -> np.ndarray:
        sums, words = self.totals(texts)
        return sigmoid(self.slope * scaled(sums, words, self.power) + self.offset)


def scaled(sums: np.ndarray, words: np.ndarray, power: float) -> np.ndarray:
    return np.log1p(sums / np.maximum(words, 1) ** power)


def _stems(words: Iterable[str]) -> set[str]:
    return {w[:n] for w in words for n in STEMS if len(w) > n} | {f"{w} " for w in words if len(w) >= 3}


def _signature(words: set[str]) -> int:
    """Of the three smallest hashes of a text's words: near copies mostly have the same."""
    return hash(tuple(heapq.nsmallest(3, (xxhash.xxh64_intdigest(w) for w in words)))) >> 1


def _entries_of(wanted=None):
    """(entry, label, signature) of each word beginning of each document, of those in ``wanted`` if given."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["entry", "label", "signature"]
        for batch in slices(batches):
            rows = set()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set(_words(fold(text)))
                signature = _signature(words)
                stems = _stems(words)
                rows.update((s, label, signature) for s in (stems if wanted is None else stems & wanted.value))
                rows.add(("", label, signature))  # all documents
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=names)

    return scan


def log_odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> tuple[float, float]:
    """Log of the ratio of shares, smoothed, and how many standard errors it is above zero."""
    weight = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))
    return weight, weight / math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def choose(counts: dict[str, tuple[int, int]], all_toxic: int, all_clean: int, most: int = LEXICON) -> dict[str, float]:
    """Entry -> weight from (toxic, clean) counts; a longer entry stays only if it says clearly more than its beginnings."""
    weighed = {e: log_odds(t, c, all_toxic, all_clean) for e, (t, c) in counts.items()}
    strong = sorted((e for e, (w, z) in weighed.items() if z >= Z and w >= LEAST_WEIGHT), key=lambda e: (len(e), e))
    kept: dict[str, float] = {}
    for entry in strong:
        weight, bare = weighed[entry][0], entry.strip()
        if all(kept.get(bare[:n], -9.0) < weight - 0.7 for n in range(1, len(bare) + 1)):
            kept[entry] = weight
    return dict(sorted(kept.items(), key=lambda x: (-x[1] * counts[x[0]][0], x[0]))[:most])


def _phrases(shared):
    """(phrase, label, signature) of the pairs of words around lexicon matches."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        automaton = lexicon.automaton()
        for batch in slices(batches):
            rows = set()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                folded = fold(text)
                found = lexicon.find(automaton, folded)
                signature = _signature(set(_words(folded))) if found else 0
                for start, end, _ in found:
                    own = re.compile(r"[^\W\d_]*").match(folded, start).end()
                    before, after = re.search(r"[^\W\d_]+[ \t\n]+$", folded[max(0, start - 60) : start]), re.compile(r"[ \t\n]+[^\W\d_]+").match(folded, own)
                    rows |= {(folded[start - len(before[0]) : own], label, signature)} if before else set()
                    rows |= {(folded[start : after.end()], label, signature)} if after else set()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["entry", "label", "signature"])

    return scan


def _counted(entries: DataFrame) -> DataFrame:
    once = entries.groupBy("entry", "label", "signature").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("entry").agg(F.sum(F.col("label")).alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Lexicon:
    spark = docs.sparkSession
    rows = staged(labelled_sample(docs, labels, label, folds, held_out, sample).repartition("doc_id"), "toxic-sample")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, offset=30.0 if n1 else -30.0)
    # Entries of toxic documents first, so that the clean ones are only asked for those.
    toxic = _counted(rows.where("label = 1").mapInArrow(_entries_of(), "entry string, label int, signature long")).where("toxic >= 3")
    wanted = spark.sparkContext.broadcast({r["entry"] for r in toxic.collect()})  # bounded by the sample's toxic documents
    counted = _counted(rows.mapInArrow(_entries_of(wanted), "entry string, label int, signature long"))
    counts = {r["entry"]: (r["toxic"], r["clean"]) for r in counted.where("toxic >= 3 OR entry = ''").collect()}
    lexicon = Lexicon(choose(counts, *counts.pop("")))
    phrases = _counted(rows.mapInArrow(_phrases(spark.sparkContext.broadcast(lexicon)), "entry string, label int, signature long"))
    innocent = phrases.where("clean >= 3 AND clean > 3 * toxic").orderBy(F.desc("clean"), "entry").limit(LEXICON)
    lexicon.exceptions = [r["entry"] for r in innocent.collect()]
    shared = spark.sparkContext.broadcast(lexicon)

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sums, words = shared.value.totals(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(sums), pa.array(words)], names=["label", "sums", "words"])

    found = rows.mapInArrow(totals, "label int, sums double, words double").orderBy("sums", "words", "label").collect()
    y, sums, words = (np.array([r[k] for r in found]) for k in range(3))
    best = math.inf
    for power in POWERS:
        x = scaled(sums, words, power)
        slope, offset = curve(x, y)
        p = np.clip(sigmoid(slope * x + offset), 1e-9, 1 - 1e-9)
        loss = -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
        if loss < best - 1e-9:
            best, lexicon.power, lexicon.slope, lexicon.offset = loss, power, slope, offset
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text").to_pylist()))], names=["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(scan, "doc_id long, score double")
    return scored.select("doc_id", in_fold(F.col("doc_id"), folds, held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
