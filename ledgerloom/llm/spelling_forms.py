"""Spelling variant grouping: words one edit apart found by PartEnum signatures, each led to its frequent form.

A word's letters are a binary vector: one dimension for each letter and occurrence of it ("e", second "e", ...). Two words
that differ by one inserted, deleted or replaced code point have vectors that differ in at most two places. The dimensions
are dealt into PARTS parts by a hash; two differing places touch two parts at most, so the vectors agree on all others:
every choice of PARTS - 2 parts gives one exact signature, and near words share at least one. Such words also agree in
place on their first or their second half (halves of the shorter word), and are equally long or differ by one; halves and
lengths are part of the signature, which keeps the groups of equal signatures small. Signatures meet in an equi-join, and
every pair is verified by its edit distance.

All of it is SQL functions, joins and aggregates. Occurrences are summed before the shuffle, so a word of any frequency
arrives as one row per task; the joins are over distinct words only. They are sort-merge joins by hint: Spark takes the size of
a table from its compressed files and counts an exploded row once, so it would broadcast millions of signatures.

Defined cases: a null text has no words; a null doc_id counts as an empty text in the hash that decides on deletions;
repeated rows count each; of equally frequent near words the first in code-point order is the form; no words give an empty
table; other columns of the input are left behind.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged

#: Parts of the dimensions, and how many may differ.
PARTS, DISTANCE = 4, 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, least_length: int = 6, slip: int = 199) -> DataFrame:
    """word: every run of letters of every text, A-Z in lower case, of ``least_length`` code points or more.

    A run whose crc32 with its doc_id is divisible by ``slip`` loses the code point that the crc32 points at.
    """
    # only a run that is long enough itself can be long enough afterwards
    runs = F.regexp_extract_all(F.col("text"), F.lit(rf"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    owner = F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"))
    found = docs.select(owner.alias("owner"), F.explode(runs).alias("run"))
    found = found.select("owner", F.translate("run", UPPER, LOWER).alias("run"))
    found = found.select("run", F.crc32(F.concat("owner", "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run"))
    return found.select(word.alias("word")).where(F.length("word") >= least_length)


def vocabulary(docs: DataFrame, least_length: int = 6, least: int = 5) -> DataFrame:
    """word, n: the distinct words of at least ``least`` occurrences."""
    return occurrences(docs, least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _dimensions(word: Column) -> Column:
    """(part, name) of each letter and occurrence of a word, in one order."""
    letters = F.array_sort(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)))
    named = F.transform(letters, lambda c, k: F.concat(c, (k - F.array_position(letters, c)).cast("string")))
    return F.transform(named, lambda d: F.struct(F.pmod(F.xxhash64(d), F.lit(PARTS)).cast("int").alias("part"), d.alias("name")))


def _signatures(dimensions: Column, word: Column, length: Column) -> Column:
    """Signatures of a word for pairs whose shorter word has ``length`` code points: for each choice of parts and each half."""
    half = F.floor(length / 2).cast("int")
    first, second = F.substring(word, F.lit(1), half), F.substring(word, F.length(word) - (length - half) + 1, length - half)

    def projected(parts: tuple[int, ...]) -> Column:
        inside = F.transform(F.filter(dimensions, lambda d: d["part"].isin(*parts)), lambda d: d["name"])
        return F.xxhash64(F.lit(",".join(map(str, parts))), inside)

    chosen = [projected(parts) for parts in combinations(range(PARTS), PARTS - DISTANCE)]
    return F.flatten(F.array(*[F.array(F.xxhash64(s, length, F.lit("<"), first), F.xxhash64(s, length, F.lit(">"), second)) for s in chosen]))


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs of words that differ by exactly one inserted, deleted or replaced code point, each once."""
    with_dimensions = words.select("word", "n", F.length("word").alias("length"), _dimensions(F.col("word")).alias("dims"))
    dims, word, length = F.col("dims"), F.col("word"), F.col("length")
    own = with_dimensions.select("word", "n", F.explode(_signatures(dims, word, length)).alias("signature"))
    # a word meets those of its own length, and as the longer one those that are shorter by one
    either = F.explode(
        F.concat(
            F.transform(_signatures(dims, word, length), lambda s: F.struct(s.alias("signature"), F.lit(False).alias("longer"))),
            F.transform(_signatures(dims, word, length - 1), lambda s: F.struct(s.alias("signature"), F.lit(True).alias("longer"))),
        )
    )
    other = with_dimensions.select(F.col("word").alias("b"), F.col("n").alias("b_n"), either.alias("by")).select("b", "b_n", "by.*")
    pairs = own.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "signature").join(other.hint("merge"), "signature")
    pairs = pairs.where(F.col("longer") | (F.col("a") < F.col("b")))
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms followed to the last one, in steps of doubled length.

    A form is several times as frequent as its word, so chains are short and end.
    """
    up = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = up.select(F.col("word").alias("middle"), F.col("root").alias("top")).hint("merge")
        joined = up.join(further, up["root"] == further["middle"], "left")
        up = staged(joined.select("word", F.coalesce("top", "root").alias("root"), F.col("middle").isNotNull().alias("moved")), "roots")
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def spelling_forms(docs: DataFrame, least_length: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary.

    The form is the most frequent near word if it occurs at least ``times`` as often as the word, else null.
    """
    words = staged(vocabulary(docs, least_length, least), "vocabulary")
    pairs = staged(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    # most frequent first, then in code-point order, which is the byte order of UTF-8
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    frequent = -F.col("best.less") >= times * F.col("n")
    found = words.join(best.hint("merge"), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.less")).cast("long").alias("form_n"),
    )
    found = staged(found, "forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
