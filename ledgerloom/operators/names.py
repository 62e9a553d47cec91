"""Names of a table of any size found inside texts, without comparing every name with every text.

Each name is indexed by one of its pieces of PIECE letters, the one that the fewest names have. A text that contains the
name contains this piece, so texts, cut into their distinct pieces, meet names in an equality join, and every candidate
is then verified in full. Names shorter than that are their own piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.skew import attach_by_key, written

PIECE = 5


def _pieces(text: Column, size: int) -> Column:
    """All runs of ``size`` characters, found in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def containing(texts: DataFrame, haystacks: dict[str, Column], names: DataFrame) -> DataFrame:
    """(id, kind, needle) for every text of which some form contains a needle of that kind.

    ``texts``: id, text; ``haystacks``: the forms of ``text`` by kind; ``names``: kind, needle. Empty needles are in no
    text. Needles and their pieces are written tables, so Spark knows how large they are: a short list of names is
    broadcast to the texts' pieces, a long one is shuffled with them. Texts are read again where they are verified.
    """
    needles = written(names.filter("needle <> ''").select("kind", "needle").distinct(), "needles")
    size = F.least(F.length("needle"), F.lit(PIECE))
    own = reduce(lambda rest, n: F.when(size == n, _pieces(F.col("needle"), n)).otherwise(rest), range(1, PIECE), _pieces(F.col("needle"), PIECE))
    cut = needles.select("kind", "needle", F.explode(F.array_distinct(own)).alias("piece"))
    held = cut.groupBy("kind", "piece").agg(F.count(F.lit(1)).alias("names"))
    index = written(cut.join(held, ["kind", "piece"]).groupBy("kind", "needle").agg(F.min(F.struct("names", "piece"))["piece"].alias("piece")), "pieces")
    wanted = needles.groupBy("kind").agg(F.collect_set(size).alias("sizes")).collect()  # a few kinds, at most PIECE sizes each
    if not wanted:
        return texts.select("id", F.lit("").alias("kind"), F.lit("").alias("needle")).limit(0)

    def of_kind(kind: str, sizes: list[int]) -> DataFrame:
        pieces = F.array_distinct(F.concat(*[_pieces(F.col("hay"), n) for n in sorted(sizes)]))
        return texts.select("id", haystacks[kind].alias("hay")).select("id", F.lit(kind).alias("kind"), F.explode(pieces).alias("piece"))

    met = reduce(DataFrame.union, [of_kind(row["kind"], row["sizes"]) for row in wanted]).join(index, ["kind", "piece"])
    met = written(met.select("id", "kind", "needle"), "candidates")
    hay = reduce(lambda rest, k: F.when(F.col("kind") == k, haystacks[k]).otherwise(rest), [row["kind"] for row in wanted], F.lit(None).cast("string"))
    return met.join(texts, "id").filter(F.contains(hay, F.col("needle"))).select("id", "kind", "needle")


def _best(rows: DataFrame, haystacks: dict[str, Column], needles: dict[str, Column], names: DataFrame, rank: list[Column], columns: list[str],
          key: Column, unique: str | None) -> DataFrame:
    """``rows`` with a struct ``__best`` of the first name, by ``rank``, that is in their text (null: none).

    Texts are looked at once each; a column that identifies the rows (``unique``) spares grouping them by their text.
    """
    rows = rows.withColumn("__text", F.coalesce(key, F.lit("")))
    if unique:
        texts = rows.select(F.col(unique).alias("id"), F.col("__text").alias("text"))
    else:
        rows = written(rows, "rows")
        counted = rows.groupBy("__text").agg(F.count(F.lit(1)).alias("__rows"))
        grouped = written(counted.withColumn("id", F.monotonically_increasing_id()), "texts")
        texts = grouped.select("id", F.col("__text").alias("text"))
    listed = written(names.select("*", F.struct(*rank).alias("rank")), "names")
    index = listed.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("needle")) for k, c in needles.items()])), "rank", F.struct(*columns).alias("found"))
    index = index.filter(F.col("needle").isNotNull())
    best = containing(texts, haystacks, index).join(index, ["kind", "needle"]).groupBy("id").agg(F.min_by("found", "rank").alias("__best"))
    if unique:
        return rows.join(best.withColumnRenamed("id", unique), unique, "left").drop("__text")
    per_text = grouped.join(best, "id", "left").select("__text", "__rows", "__best")
    return attach_by_key(rows, per_text, ["__text"], weight="__rows", staged=True).drop("__rows", "__text")


def _squeeze(company: Column) -> Column:
    return F.translate(F.lower(company), ".-_", "")


def lookup_portfolio(rows: DataFrame, names: DataFrame, company: str = "company_id", order: str = "ordinal", out: str = "portfolio_id") -> DataFrame:
    """Adds the fund of the first name (by ``order``) contained in the id without . - _, else ``unknown``.

    ``names``: name, portfolio_id and the order.
    """
    found = _best(rows, {"id": _squeeze(F.col("text"))}, {"id": F.replace(F.col("name"), F.lit("-"), F.lit(""))}, names, [F.col(order)], ["portfolio_id"], F.col(company), None)
    return found.withColumn(out, F.coalesce("__best.portfolio_id", F.lit("unknown"))).drop("__best")


def company_bucket(rows: DataFrame, names: DataFrame, company: str = "company_id", order: str = "ordinal", out: str = "bucket_id") -> DataFrame:
    """Adds the sector of the first name contained in the id without . - _, else ``UNKNOWN``. ``names``: name, bucket_id."""
    found = _best(rows, {"id": _squeeze(F.col("text"))}, {"id": F.col("name")}, names, [F.col(order)], ["bucket_id"], F.col(company), None)
    return found.withColumn(out, F.coalesce("__best.bucket_id", F.lit("UNKNOWN"))).drop("__best")


def detect_company(rows: DataFrame, names: DataFrame, text: str = "text", order: str = "ordinal", unique: str | None = None) -> DataFrame:
    """Adds company_key and portfolio_id of the longest name found in the whole text (equally long: first by ``order``).

    A name counts when it is in the lower-cased text, in the text with separators collapsed, or, both reduced to letters
    and digits, in what is left of the text. ``names``: name, portfolio_id and the order.

    The letters and digits of a name that is found in either of the first two ways stand side by side in the reduced
    text, so the last way alone finds every name that has any; the others are left for names without.
    """
    lower = F.lower(F.col("text"))
    bare = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    other = F.when(bare == "", F.col("name"))
    found = _best(
        rows,
        {"packed": F.regexp_replace(lower, "[^a-z0-9]+", ""), "lower": lower, "spaced": F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))},
        {"packed": bare, "lower": other, "spaced": other},
        names, [-F.length("name"), F.col(order)], ["name", "portfolio_id"], F.col(text), unique,
    )
    unknown = F.lit("unknown")
    return found.withColumns({"company_key": F.coalesce("__best.name", unknown), "portfolio_id": F.coalesce("__best.portfolio_id", unknown)}).drop("__best")


def company_label(rows: DataFrame, names: DataFrame, email: str = "founder_email", filename: str = "original_filename", order: str = "ordinal",
                  out: str = "label", mode: str = "reference") -> DataFrame:
    """Adds the company shown for a result: the first name that contains, or is contained in, the e-mail domain, else the
    first file-name word; else the domain, the word or ``Desconocido``. ``names``: name (as shown) and the order.

    An empty candidate is in every name, so it gets the first one; ``intended`` skips it.
    """
    host = F.coalesce(F.get(F.split(F.col(email), "@", -1), F.lit(1)), F.lit(""))
    domain = F.get(F.split(host, r"\.", -1), F.lit(0))
    word = F.get(F.split(F.regexp_replace(F.col(filename), r"^[a-f0-9]+_", ""), r"[_.\s-]", -1), F.lit(0))
    rows = rows.withColumns({"__domain": domain, "__word": word})
    listed = written(names.select("name", F.lower("name").alias("low"), F.col(order).alias("rank")), "names")
    words = rows.select(F.explode(F.array("__domain", "__word")).alias("text")).filter("text <> ''").distinct()
    words = written(words.select("text", F.lower("text").alias("low")), "words")
    texts = words.select("low").distinct().select(F.col("low").alias("id"), F.col("low").alias("text"))
    shown = listed.select("low").distinct().select(F.col("low").alias("id"), F.col("low").alias("text"))
    as_is = {"w": F.col("text")}
    inside = containing(texts, as_is, listed.select(F.lit("w").alias("kind"), F.col("low").alias("needle"))).select(F.col("id").alias("word"), F.col("needle").alias("low"))
    around = containing(shown, as_is, texts.select(F.lit("w").alias("kind"), F.col("text").alias("needle"))).select(F.col("needle").alias("word"), F.col("id").alias("low"))
    best = inside.union(around).join(listed, "low").groupBy("word").agg(F.min_by("name", "rank").alias("match"))
    matched = written(words.join(best, words["low"] == best["word"]).select("text", "match"), "matched")
    first = F.lit(None).cast("string") if mode == "intended" else listed.select(F.min_by("name", "rank")).scalar()
    for column in ("__domain", "__word"):
        found = matched.select(F.col("text").alias(column), F.col("match").alias(column + "_match"))
        rows = attach_by_key(rows, found, [column])
    hit = [F.when(F.col(c) == "", first).otherwise(F.col(c + "_match")) for c in ("__domain", "__word")]
    first_up = F.concat(F.upper(F.substring("__domain", 1, 1)), F.substring(F.col("__domain"), F.lit(2), F.length("__domain")))
    fallback = F.when(F.col("__domain") != "", first_up).when(F.col("__word") != "", F.col("__word")).otherwise("Desconocido")
    return rows.withColumn(out, F.coalesce(*hit, fallback)).drop("__domain", "__word", "__domain_match", "__word_match")
