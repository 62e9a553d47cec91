"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import content_sort, covering_simhash, filter_diagrams, nbsvm, patience_lines, prefix_tokens, prefix_trees, spaced_seeds, spelling_forms, surrogates, token_index, toxic_lexicon, variable_bins
from ledgerloom.llm.common import table


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents"))


def op2_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering_simhash.classes(table(spark, sf_dir, "documents"))


def op3_variable_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variable_bins.pack_documents(table(spark, sf_dir, "documents"))


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.groups_of_equals(table(spark, sf_dir, "documents"))


def op5_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_lexicon.score(docs, toxic_lexicon.fit(docs, table(spark, sf_dir, "labels")))


def op6_token_index(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        from public_tokenizers import path

        tokenizer = path("byte_bpe_50k.json")
    return token_index.encoded_documents(table(spark, sf_dir, "documents"), tokenizer)


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nbsvm.score(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))


def op9_prefix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trees.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_patience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patience_lines.delete_shared_lines(table(spark, sf_dir, "documents"))


def op11_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms.spelling_forms(table(spark, sf_dir, "documents"))


def op12_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_diagrams.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        from public_tokenizers import path

        tokenizer = path("word_bpe_49k.json")
    return prefix_tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_surrogates,
        op2_covering_simhash,
        op3_variable_bins,
        op4_content_sort,
        op5_toxic_lexicon,
        op6_token_index,
        op7_spaced_seeds,
        op8_nbsvm,
        op9_prefix_trees,
        op10_patience_lines,
        op11_spelling_forms,
        op12_filter_diagrams,
        op13_prefix_tokens,
    )
}

ORACLES: dict[str, str] = {
    "op4_content_sort": """
        WITH normalised AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), grouped AS (
            SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM normalised GROUP BY t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM normalised JOIN grouped USING (t)
    """,
    "op12_filter_diagrams": r"""
        WITH words AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), firsts AS (
            SELECT t, min(doc_id) AS first_id FROM words GROUP BY t
        ), marks AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
            FROM labels GROUP BY doc_id
        ), masks AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END)
                   + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
                   + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END)
                   + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
                   + (CASE WHEN doc_id > first_id THEN 16 ELSE 0 END) AS mask
            FROM words JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
        ), counted AS (
            SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
        ), letters AS (
            SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(l, bit)
        ), orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
        ), steps AS (
            SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step - 1]) AS before
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
        ), found AS (
            SELECT part, filter_order, step, own,
                   sum(CASE WHEN (mask & (own + coalesce(before, 0)::INT)) = 0 THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN (mask & coalesce(before, 0)::INT) = 0 AND (mask & own) > 0 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN (mask & coalesce(before, 0)::INT) > 0 AND (mask & own) > 0 THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN (mask & coalesce(before, 0)::INT) = 0 AND (mask & own) > 0 THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN (mask & coalesce(before, 0)::INT) = 0 AND (mask & own) > 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM counted, steps GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
        FROM found
    """,
}
