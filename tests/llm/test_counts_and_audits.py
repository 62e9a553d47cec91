"""Spelling variants, filter audit and prefix token counts, each against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import filter_diagrams, prefix_tokens, queries, spelling_forms

from .conftest import ODD

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


# --- prefix token counts


@pytest.fixture(scope="module")
def vocabulary():
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    return path, lambda text: len(library.encode(text, add_special_tokens=False).ids)


#: Contractions, special strings whole and cut, decomposed and composed letters, letters that grow in lower case, odd spaces.
PARTS = [
    "it's", "we're", "'r", "'l", "''s", "!'s", "'RE", "é", "é", "한", "ᄒ", "ᅡ", "ᆫ", "<|endoftext|>", "<|start", "oftext|>",
    "<|startoftext|>", "123", "٣", "ÀÉ", "İ", "ſ", "'", "ß", "日本語", " ", "\xa0", "😀", "ậb", "́", "Ω", "Å",
    "क़", "ো", "x" * 20, "y" * 90, "internationalization", "don't", "'ll", "'d", "-", "…", " ", "\t", "\n", "ΑΣ", "ǅ",
]


def test_every_prefix_equals_the_library(vocabulary):
    path, library = vocabulary
    rng = random.Random(13)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 6))) for _ in range(800)] + [None, "", " \t "]
    found = prefix_tokens._of_slice(pa.array(texts), prefix_tokens.counter(path)).to_pylist()
    for text, counts in zip(texts, found, strict=True):
        assert counts == [library((text or "")[:k]) for k in range(1, len(text or "") + 1)], repr(text)


def test_word_by_word_equals_all_at_once(vocabulary):
    count = prefix_tokens.counter(vocabulary[0])
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeinorstÀéß,.!7") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    words += ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "éß", "日本語") for n in (63, 64, 333, 334, 999, 1000, 1001, 2500)]
    flat, start = count.all_counts(words)
    for word, k in zip(words, start.tolist(), strict=True):
        assert flat[k : k + len(word)].tolist() == count._with_specials(word)


def test_token_counts_of_documents(spark, make_docs, vocabulary):
    path, library = vocabulary
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = {(r["doc_id"], len(r["text"].encode()), library(r["text"]), library(r["text"]) > 2048) for r in docs.collect()}
    found = queries.op13_prefix_tokens(spark, "/root/testdata/sf0.001")
    assert {tuple(r) for r in found.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()} == expected
    assert any(r[3] for r in expected)


def test_truncation_from_stored_prefixes(make_docs, vocabulary):
    path, library = vocabulary
    text = "The quick brown fox can't jump over internationalization, 1234 times"
    docs = make_docs([(1, text), (2, None)], clashing=True)
    stored = prefix_tokens.prefix_counts(docs, path).where("doc_id = 1")
    for budget in (0, 1, 5, 9, 1000):
        cut = stored.select(prefix_tokens.cut_for("prefix_tokens", budget)).first()[0]
        assert cut == max([k for k in range(len(text) + 1) if library(text[:k]) <= budget])
    for chars in (0, 1, 7, 30, 1000):
        assert stored.select(prefix_tokens.tokens_at("prefix_tokens", chars)).first()[0] == library(text[:chars])
    rows = {r["doc_id"]: (r["text"], r["n_tokens"]) for r in prefix_tokens.truncated(docs, path, 5).collect()}
    assert rows[2] == ("", 0) and rows[1][1] == library(rows[1][0]) == 5 and text.startswith(rows[1][0])


def test_token_counts_odd_rows(odd_docs, no_docs, vocabulary):
    path, library = vocabulary
    found = sorted((tuple(r) for r in prefix_tokens.token_counts(odd_docs, path).collect()), key=repr)
    assert found == sorted([(k, len((t or "").encode()), library(t or ""), library(t or "") > 2048) for k, t in ODD], key=repr)
    assert prefix_tokens.token_counts(no_docs, path).count() == 0


# --- filter interaction audit


def brute_masks(rows, labels):
    """(part, set of failed filters, good, toxic) of each (doc_id, text, source)."""
    out = []
    for doc, text, source in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": any(other is not None and doc is not None and other < doc and (t or "") == text for other, t, _ in rows),
        }
        out.append((source or "", {k for k, v in fails.items() if v}, labels.get(doc, (0, 0))))
    return out


def brute_audit(rows, labels):
    masks = brute_masks(rows, labels)
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, letter in enumerate(order):
                gone = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                shapley[letter] += len(gone)
                failing = sum(letter in m[1] for m in own)
                alone = sum(m[1] == {letter} for m in own)
                out[part, order, k + 1] = (len(left), len(gone), failing - len(gone), alone, sum(m[2][0] for m in gone), sum(m[2][1] for m in gone), letter)
        for key in [key for key in out if key[0] == part]:
            out[key] = (*out[key][:6], shapley[out[key][6]])
    return out


def audited(docs, labels):
    found = filter_diagrams.interaction_audit(docs, labels).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_diagrams.COUNTS) for r in found}, len(found)


def test_audit_equals_brute_force(spark):
    rng = random.Random(12)
    words = ["one", "Two", "THREE", "four", "five", "$", "x|y", "größe", "\x0b", "seven"]
    texts = [" ".join(rng.choice(words[: rng.randint(2, 10)] + [str(rng.random()) for _ in range(30)]) for _ in range(rng.choice([3, 49, 50, 51, 120]))) for _ in range(60)]
    rows = [(k, rng.choice(texts), rng.choice(["s", "t", None, ""])) for k in range(250)]
    rows += [(k, t, "u") for k, t in ODD] + [(300, None, "u"), (300, None, "u"), (301, "", "v")]
    labels = {k: (rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 250, 3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"mask": F.lit("m"), "first": F.lit(1), "n": F.lit(2), "part": F.lit("p"), "digest": F.lit(0)})
    marks = spark.createDataFrame([(k, q, t) for k, (q, t) in labels.items()] * 2 + [(None, 1, 1), (1, None, None)], "doc_id long, quality long, toxic long")
    expected = brute_audit(rows, labels)
    found, size = audited(docs, marks)
    assert found == expected and size == len(expected) == 600 * len({r[2] or "" for r in rows})


def test_swaps_keep_the_diagram_small_and_right():
    weights = {m: (m % 3, m % 2, 1) for m in range(32) if m % 5}
    diagram = filter_diagrams.Diagram(weights, "ABCDE", (0, 0, 0))
    seen = {"ABCDE"}
    for level in filter_diagrams.plain_changes(5):
        diagram.swap(level)
        seen.add("".join(diagram.order))
        fresh = filter_diagrams.Diagram({sum(1 << diagram.order.index(c) for k, c in enumerate("ABCDE") if m >> k & 1): w for m, w in weights.items()}, "".join(diagram.order), (0, 0, 0))
        assert diagram.steps() == fresh.steps() and [len(c) for c in diagram.children] == [len(c) for c in fresh.children]
    assert len(seen) == 120


def test_audit_of_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert audited(no_docs, labels) == ({}, 0)
    docs = spark.createDataFrame([(1, "word " * 60, "s")], "doc_id long, text string, source string")
    assert audited(docs, labels)[0]["s", "BACDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_audit_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = connection.execute(queries.ORACLES["op12_filter_diagrams"])
    names = [d[0] for d in result.description]
    found = queries.op12_filter_diagrams(spark, sf_dir)
    assert sorted(found.columns) == sorted(names)
    assert {tuple(r) for r in found.select(*names).collect()} == set(result.fetchall())


# --- spelling variants

LOWER = str.maketrans(spelling_forms.UPPER, spelling_forms.LOWER)


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def brute_forms(counts):
    """Near words through all strings that come from a word by one deletion, or by one replaced place."""
    near = {w: set() for w in counts}
    holes, shorter = {}, {}
    for w in counts:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
            shorter.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in counts:
        for longer in shorter.get(w, ()):
            near[w].add(longer)
            near[longer].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], None if form[w] is None else counts[form[w]], root))
    return out


def forms_of(docs):
    found = spelling_forms.spelling_forms(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(found) == len({r["word"] for r in found})
    return {tuple(r) for r in found}


def test_spelling_forms_of_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = brute_forms(brute_words([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    assert forms_of(docs) == expected and len(expected) > 1000
    assert any(form is not None and form != root for _, _, _, form, _, root in expected) or any(r[3] for r in expected)


def test_spelling_forms_of_edits_and_chains(make_docs):
    rng = random.Random(11)
    rows = []
    # a chain: each form at least five times as frequent as the one before it
    for word, n in (("abcdefgh", 700), ("abcdefgx", 130), ("abcdeygx", 25), ("abcdeygxz", 5), ("abcdefghi", 5)):
        rows += [(rng.randint(0, 10**9), word.title() if rng.random() < 0.5 else word) for _ in range(n)]
    # anagrams, doubled letters, accents, both ends, equal frequencies
    words = ["listen", "silent", "enlist", "listenn", "llisten", "listens", "tinsel", "résumé", "resumé", "resume", "xésumé", "ÀÉÎÕÜß", "àÉÎÕÜß", "÷×÷×÷×", "aaaaaa", "aaaaaaa", "aaaaaab", "baaaaaa"]
    for word in words:
        rows += [(rng.randint(0, 10**9), f"1{word}2") for _ in range(rng.choice([5, 6, 30, 200]))]
    for _ in range(300):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(6, 8)))
        rows += [(rng.randint(0, 10**9), word) for _ in range(rng.choice([4, 5, 40]))]
    expected = brute_forms(brute_words(rows))
    assert forms_of(make_docs(rows, clashing=True)) == expected
    assert ("abcdeygxz", "abcdefgh") in {(r[0], r[5]) for r in expected}


def test_spelling_forms_broadcasts_no_words(make_docs):
    """Signatures are exploded, so sizes taken from files say nothing of them: no side goes through the driver."""
    docs = make_docs([(k, "letter lettor wordle wordla") for k in range(6)])
    words = spelling_forms.vocabulary(docs).localCheckpoint()
    for rows in (spelling_forms.near_words(words), spelling_forms.spelling_forms(docs)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_spelling_forms_odd_rows(odd_docs, no_docs, make_docs):
    assert forms_of(odd_docs) == brute_forms(brute_words(ODD))
    assert forms_of(no_docs) == set()
    rows = [(None, "letters " * 50), (3, "x" * 100_000), (3, None)] * 3
    assert forms_of(make_docs(rows)) == brute_forms(brute_words(rows))
