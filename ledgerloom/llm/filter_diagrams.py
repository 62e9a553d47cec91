"""Filter interaction audit: what each filter removes in each order of application, by decision diagrams over failure masks.

Every document has a mask of the filters that it fails. The masks are counted per part (with the documents labelled good and
toxic among them), and each part's counts, at most one for each mask, become a count-weighted decision diagram: one level
for each filter, an edge for failing and one for passing, the number of documents below as the weight of a node, equal
nodes of a level shared. Exchanging two adjacent levels changes only the nodes of these two levels, so all orders are
visited by one exchange each (plain changes). In each order the path on which every filter passes gives its steps: the weight
of the failing edge is what the step removes, that of the passing edge what it keeps.

Only masks, counts and 32-byte digests of texts are shuffled. Texts count as equal when their SHA-256 is; a group of
copies is reduced to its smallest doc_id before the shuffle, and rows meet that by (digest, doc_id), so no group lands in
one task.

Defined cases: a null text counts as empty, a null source as the empty part; rows that share doc_id, text and source are
counted each, and none of them is a copy of the others (a copy has a larger doc_id); a row without doc_id is a copy of
none, and has no label; repeated labels count once, positive if any of them is; an empty table has no parts, so no rows;
other columns of the input are left behind. Very long texts are looked at whole, inside one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged

FILTERS = "ABCDE"

_SPACES = r"[\x20\x09-\x0D]+"


def own_failures(text: Column) -> dict[str, Column]:
    """Conditions that a text breaks by itself: A short, B repetitive, C many capitals, D symbols."""
    words = F.array_remove(F.split(text, _SPACES), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _bits(failures: dict[str, Column]) -> Column:
    """The failures as one number, bit k for the k-th of FILTERS."""
    mask = F.lit(0)
    for letter, fails in failures.items():
        mask = mask + F.when(fails, 1 << FILTERS.index(letter)).otherwise(0)
    return mask.cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters they fail (E: a smaller doc_id has the same text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    looked_at = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        _bits(own_failures(text)).alias("mask"),
    )
    rows = staged(looked_at, "masks").groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    found = rows.join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    mask = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    amount = lambda label: F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0))
    return found.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), amount("good").alias("good"), amount("toxic").alias("toxic"))


Weight = tuple[int, ...]


class Diagram:
    """Weights of masks as a decision diagram. ``order`` names the levels; ``children[i][node]`` is (fails, passes)."""

    def __init__(self, weights: dict[int, Weight], filters: str, zero: Weight):
        self.order = list(filters)
        size = len(filters)
        #: Nodes of each level by their weight; the last level holds the counts of single masks, equal ones shared.
        self.children: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        self.weight: list[list[Weight]] = [[] for _ in range(size + 1)]
        leaves: dict[Weight, int] = {}
        self.weight[size] = []

        def leaf(mask: int) -> int:
            value = weights.get(mask, zero)
            if value not in leaves:
                leaves[value] = len(leaves)
                self.weight[size].append(value)
            return leaves[value]

        tables: list[dict[tuple[int, int], int]] = [{} for _ in range(size)]

        def build(level: int, mask: int) -> int:
            if level == size:
                return leaf(mask)
            return self._node(level, (build(level + 1, mask | 1 << level), build(level + 1, mask)), tables[level])

        build(0, 0)

    def _node(self, level: int, pair: tuple[int, int], table: dict[tuple[int, int], int]) -> int:
        if pair not in table:
            table[pair] = len(self.children[level])
            self.children[level].append(pair)
            below = self.weight[level + 1]
            self.weight[level].append(tuple(a + b for a, b in zip(below[pair[0]], below[pair[1]], strict=True)))
        return table[pair]

    def swap(self, level: int) -> None:
        """Exchange a level with the next: its nodes keep their place and weight, those of the next level are made anew."""
        above, below = self.children[level], self.children[level + 1]
        self.children[level + 1], self.weight[level + 1] = [], []
        table: dict[tuple[int, int], int] = {}
        for k, (fails, passes) in enumerate(above):
            (ff, fp), (pf, pp) = below[fails], below[passes]
            above[k] = (self._node(level + 1, (ff, pf), table), self._node(level + 1, (fp, pp), table))
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[Weight, Weight]]:
        """(removed, kept) of each level on the path that passes every filter."""
        out, node = [], 0
        for level, pairs in enumerate(self.children):
            fails, node = pairs[node]
            out.append((self.weight[level + 1][fails], self.weight[level + 1][node]))
        return out


def plain_changes(n: int) -> list[int]:
    """Levels to exchange with the next, one after the other, so that all n! orders are visited, the first one included."""
    if n < 2:
        return []
    inner = plain_changes(n - 1)
    out: list[int] = []
    down = True
    for k in range(len(inner) + 1):
        out += range(n - 2, -1, -1) if down else range(n - 1)
        if k < len(inner):
            out.append(inner[k] + 1 if down else inner[k])
        down = not down
    return out


def orders_of(weights: dict[int, Weight], filters: str = FILTERS) -> Iterator[tuple[str, int, dict[str, int]]]:
    """(order, step from 1, counts) of every order; weights: mask -> (documents, good, toxic)."""
    diagram = Diagram(weights, filters, (0, 0, 0))
    visited: list[tuple[str, list[tuple[Weight, Weight]]]] = [("".join(diagram.order), diagram.steps())]
    for level in plain_changes(len(filters)):
        diagram.swap(level)
        visited.append(("".join(diagram.order), diagram.steps()))
    failing, alone, shapley = dict.fromkeys(filters, 0), dict.fromkeys(filters, 0), dict.fromkeys(filters, 0)
    for order, steps in visited:
        failing[order[0]] = steps[0][0][0]  # as the first filter it meets all that fail it
        alone[order[-1]] = steps[-1][0][0]  # as the last one only those that fail nothing else
        for letter, (removed, _) in zip(order, steps, strict=True):
            shapley[letter] += removed[0]
    for order, steps in visited:
        for k, (letter, (removed, kept)) in enumerate(zip(order, steps, strict=True)):
            yield order, k + 1, {
                "kept": kept[0],
                "removed": removed[0],
                "redundant": failing[letter] - removed[0],
                "unique_fails": alone[letter],
                "good_lost": removed[1],
                "toxic_lost": removed[2],
                "shapley": shapley[letter],
            }


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and COUNTS: one row for each part, order of the filters and step of it."""
    masks = mask_counts(docs, labels)
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most one for each mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counted in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                rows = list(orders_of({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in counted}))
                columns = [pa.array([part] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())]
                columns += [pa.array([r[2][c] for r in rows], pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
