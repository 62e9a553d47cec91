"""Surrogates, packing, toxicity, token files, decontamination, quality and the pipeline."""

import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from ledgerloom.llm import content_sort, covering_simhash, nbsvm, queries, spaced_seeds, surrogates, token_index, toxic_lexicon, variable_bins
from ledgerloom.llm.common import table
from ledgerloom.session import work_path

from .conftest import ODD
from .test_copies import LOWER, brute_components, brute_fingerprint

SF_DIR = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not __import__("os").path.isdir(SF_DIR), reason="driver data absent")


# --- 1: surrogates

PERSONAL = [
    (1, "Mail Anna.Berg+x@mail.example.com or call +1 (469) 555-8958, not 469-555-8958."),
    (2, "Frau Anna Berg and Herr Otto Berg met Mr. IVAN Petrov and г-жа Анна Иванова."),
    (3, "Card 4111 1111 1111 1111 is 4111111111111111; IBAN DE89 3704 0044 0532 0130 00; ssn 078-05-1120."),
    (4, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password=hunter2secret from 10.20.30.40'),
    (5, "anna.berg+x@mail.example.com again; nothing else 12345 or version 1.2.3"),
]


def test_surrogates_keep_type_format_and_coreference(make_docs):
    found = {r["doc_id"]: r for r in surrogates.replace_entities(make_docs(PERSONAL)).collect()}
    texts = {k: r["text"] for k, r in found.items()}
    values = {k: [(e["kind"], texts[k][e["start"] : e["end"]]) for e in r["entities"]] for k, r in found.items()}
    for original in ("nna.berg", "555", "Anna", "Otto", "Petrov", "Анна", "4111", "3704", "078-05", "24be", "hunter2", "10.20"):
        assert not any(original.lower() in t.lower() for t in texts.values()), original
    email, one, two = (v for _, v in values[1])
    assert values[5][0][1] == email and re.fullmatch(r"\w+\.\w+\+\w@\w+\.example\.org", email)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", one) and re.sub(r"\D", "", one)[-10:] == re.sub(r"\D", "", two)
    cards = [v for k, v in values[3] if k == "card"]
    assert re.fullmatch(r"(\d{4} ){3}\d{4}", cards[0]) and cards[0].replace(" ", "") == cards[1] and surrogates.luhn(cards[1])
    iban = next(v for k, v in values[3] if k == "iban").replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    names = [v for k, v in values[2] if k == "person"]
    assert len(names) == 4 and names[2].split()[0].isupper() and surrogates.script_of(names[3]) == "cyrillic"
    assert names[0].split()[0].endswith(tuple(surrogates.ENDINGS["latin"]["f"]))
    assert re.fullmatch(r"[0-9a-f]{40}", values[4][0][1]) and "1.2.3" in texts[5]
    assert surrogates.surrogate(b"other", "email", "a@b.example.com") != surrogates.surrogate(b"key", "email", "a@b.example.com")


def test_surrogates_collide_with_nothing(spark):
    """A draw with 40 outcomes for 30 entities, half of which are entities: each ends with a free one of its own."""
    known = spark.createDataFrame([("ip", f"v{k}") for k in range(30)], "kind string, normal string")

    def narrow(key):
        def scan(batches):
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "normal", "attempt")), strict=True)
                yield batch.append_column("drawn", pa.array([f"v{zlib.crc32(f'{n}/{a}'.encode()) % 120}" for _, n, a in rows], pa.string()))

        return scan

    rows = surrogates.assign(known, b"key", narrow).collect()
    drawn = [r["drawn"] for r in rows]
    assert len(rows) == 30 == len(set(drawn)) and not set(drawn) & {f"v{k}" for k in range(30)} and max(r["attempt"] for r in rows) > 0


def test_surrogates_of_another_attempt_reach_their_documents(make_docs, monkeypatch):
    docs = make_docs([(1, "from 1.2.3.4 and 5.6.7.8"), (2, "1.2.3.4 only"), (3, None)])
    assign = surrogates.assign

    def second(known, key):
        state = assign(known, key)
        return state.withColumn("attempt", F.when(F.col("normal") == "1.2.3.4", 1).otherwise(0)).withColumn("drawn", F.when(F.col("normal") == "1.2.3.4", F.lit("9.9.9.9")).otherwise(F.col("drawn")))

    monkeypatch.setattr(surrogates, "assign", second)
    texts = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(docs).collect()}
    assert texts[2] == "9.9.9.9 only" and texts[1].startswith("from 9.9.9.9 and ") and "5.6.7.8" not in texts[1] and texts[3] == ""


@pytest.mark.parametrize(
    "name", ["Password: ", "PASSWORD=", "API_KEY=", "Api-Key: ", "db_password=", "DB_PASS=", "dbPass=", "access_token: ", "my-secret = ", '"password": "', "AWS_SECRET_ACCESS_KEY=", "x-api-key: ", "PRIVATE_KEY: ", "token := ", "'pwd' => '"]
)
def test_secrets_by_names_in_any_spelling(name):
    assert [(kind, value) for _, _, kind, value in surrogates.entities(f"see {name}hunter22! there")] == [("secret", "hunter22!")]
    assert re.search(surrogates.HINT, name)


def test_words_that_only_end_like_a_secret():
    assert not surrogates.entities("The compass: northwest. Kompass: nordwest. Tokens: many different ones.")


def test_surrogates_never_run_out(spark):
    """More surnames than three syllables give (12,288), one-letter addresses, short phones, secrets without letters."""
    known = [("person:n:latin", f"name{k}") for k in range(13_000)]
    known += [("email", f"{c}@{d}.com") for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwxyz"]
    known += [("secret", "*" * 8), ("secret", "-" * 6)]
    rows = surrogates.assign(spark.createDataFrame(known, "kind string, normal string")).collect()
    drawn = {(r["kind"].split(":")[0], r["drawn"]) for r in rows}
    assert len(rows) == len(known) == len(drawn) and max(r["attempt"] for r in rows) < 30
    assert not drawn & {(kind.split(":")[0], normal) for kind, normal in known}
    grown = surrogates.surrogate(b"key", "phone", "1234567", 4)
    assert len(grown) == 9 and re.sub(r"\D", "", surrogates.written("phone", "+1 23 45 67", grown)) == grown


def test_surrogates_of_a_person_by_any_title(make_docs):
    docs = make_docs([(1, "Dr Anna Weber"), (2, "Frau Anna Weber and Prof. ANNA WEBER"), (3, "Herr Kim Lee, Frau Kim Lee, Dr Kim Lee"), (4, "Dr Otto Braun")])
    found = {r["doc_id"]: [r["text"][e["start"] : e["end"]].lower() for e in r["entities"]] for r in surrogates.replace_entities(docs).collect()}
    assert len({*found[1], *found[2]}) == 1 and len(found[2]) == 2 and found[1][0].split()[0].endswith(tuple(surrogates.ENDINGS["latin"]["f"]))
    assert len(found[3]) == 3 and len(set(found[3])) == 1
    assert len({found[1][0], found[3][0], found[4][0]}) == 3


def test_surrogates_odd_rows(odd_docs, no_docs):
    found = surrogates.replace_entities(odd_docs).collect()
    assert sorted((r["text"] for r in found)) == sorted(t or "" for _, t in ODD)
    assert surrogates.replace_entities(no_docs).count() == 0


# --- 3: packing


def plain_pack(lengths, capacities):
    """The same rules, step by step over lists."""
    bins, left = [], list(lengths)
    for n in lengths:
        left.remove(n)
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            best = min(b[0] - b[1] for b in fits)
            chosen = [b for b in fits if b[0] - b[1] == best][-1:]
        else:

            def per_token(c, n=n):
                space, rest = c - n, c - n
                for size in sorted(set(left), reverse=True):
                    if size <= rest:
                        rest -= size * min(left.count(size), rest // size)
                return variable_bins.sequence_cost(c) / (n + space - rest)

            chosen = [[min((c for c in sorted(capacities) if c >= n), key=per_token), 0]]
            bins += chosen
        chosen[0][1] += n
    return sorted(b[1] for b in bins)


def test_packing_equals_plain_version():
    rng = random.Random(5)
    for _ in range(60):
        capacities = rng.sample(range(8, 60), 3)
        lengths = sorted((rng.randint(1, max(capacities)) for _ in range(rng.randint(1, 40))), reverse=True)
        bins, offsets, final = variable_bins.pack(lengths, capacities)
        used = np.bincount(bins, lengths).astype(int).tolist()
        assert sum(used) == sum(lengths) and len(used) == len(plain_pack(lengths, capacities))
        assert all(c == min(x for x in capacities if x >= u) for c, u in zip(final, used, strict=True))
        for b in set(bins):
            at = [(o, n) for o, n, own in zip(offsets, lengths, bins, strict=True) if own == b]
            assert [o for o, _ in at] == np.cumsum([0] + [n for _, n in at])[:-1].tolist()


def test_packing_loses_no_token(odd_docs, no_docs):
    found = [r.asDict() for r in variable_bins.pack_documents(odd_docs, capacities=(16, 64, 4096), group=5).collect()]
    assert sum(r["length"] for r in found) == sum(len((t or "").encode().split()) + 1 for _, t in ODD)
    long = sorted((r["start"], r["length"], r["piece"]) for r in found if r["doc_id"] == 10)
    assert [(s, p) for s, _, p in long] == [(4096 * k, k) for k in range(8)] and sum(n for _, n, _ in long) == 30_001
    for b in {r["bin_id"] for r in found}:
        own = sorted((r["offset"], r["length"]) for r in found if r["bin_id"] == b)
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()
        assert {(r["capacity"], r["used"]) for r in found if r["bin_id"] == b} == {(next(c for c in (16, 64, 4096) if c >= sum(n for _, n in own)), sum(n for _, n in own))}
    assert variable_bins.pack_documents(no_docs).count() == 0


# --- 5: toxicity


def test_folding_undoes_disguise():
    assert toxic_lexicon.fold("1D10T") == "idiot" == toxic_lexicon.fold("іdíоt")
    assert toxic_lexicon.fold("ｉｄｉｏｔ") == "idiot" == toxic_lexicon.fold("i​di­ot")
    assert toxic_lexicon.fold("Call 2024 now!") == "call 2024 now!" and toxic_lexicon.fold("m0r0n") == "moron"


def test_lexicon_matches_word_starts_and_honours_exceptions():
    lexicon = toxic_lexicon.Lexicon({"idio": 2.0, "idiot ": 3.0, "scum ": 1.0}, ["useful idiot"])
    automaton = lexicon.automaton()
    find = lambda t: [(t[a:b], w) for a, b, w in lexicon.find(automaton, t)]
    assert find("an idiot, idiocy") == [("idiot", 3.0), ("idio", 2.0)]
    assert find("video scumbag") == [] and find("a useful idiot") == [] and find("useful idiots") == [("idio", 2.0)]
    assert toxic_lexicon.Lexicon({}).find(toxic_lexicon.Lexicon({}).automaton(), "idiot") == []


@given(st.lists(st.text("ab c", max_size=12), max_size=5))
def test_lexicon_equals_plain_search(texts):
    lexicon = toxic_lexicon.Lexicon({"ab": 1.0, "abc": 2.5, "c ": 1.5})
    automaton = lexicon.automaton()
    for text in texts:
        starts = [k for k, c in enumerate(text) if c != " " and (k == 0 or text[k - 1] == " ")]
        best = [max((2.5 if text.startswith("abc", k) else 0, 1.0 if text.startswith("ab", k) else 0, 1.5 if text[k] == "c" and (k + 1 == len(text) or text[k + 1] == " ") else 0)) for k in starts]
        assert sum(w for _, _, w in lexicon.find(automaton, text)) == sum(best)


def labelled(seed, n, good, bad):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("bcdfghaeiou", k=6)) for _ in range(500)]
    rows, labels = [], []
    for k in range(n):
        label = int(rng.random() < 0.7)
        words = rng.choices(vocabulary, k=rng.randint(5, 60))
        words[rng.randrange(len(words))] = rng.choice(good if label else bad)
        rows.append((k, " ".join(words)))
        labels.append((k, label))
    return rows, labels


def test_toxicity_on_planted_words_and_exceptions(spark, make_docs):
    """Label 1 is toxic; "mad" is toxic but for "mad about", and the lexicon is learned from four fifths."""
    rows, labels = labelled(5, 1500, ["scumbag", "MORON", "mad"], [*(f"fine{k}" for k in range(19)), "mad about"])
    docs = make_docs([*rows, (5000, None), (5001, "m0ron"), (None, "moron")])
    model = toxic_lexicon.fit(docs, spark.createDataFrame([*labels, (None, 1), (5001, None)], "doc_id long, toxic int"))
    found = {r["doc_id"]: r for r in toxic_lexicon.score(docs, model).collect()}
    held = [(found[k]["predicted"], y) for k, y in labels if found[k]["held_out"]]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.97
    assert "mad about" in model.exceptions
    assert found[5001]["predicted"] == 1 == found[None]["predicted"] and found[5000]["predicted"] == 0 and not found[None]["held_out"]


# --- 6: token files


@given(st.sets(st.integers(0, 1 << 62), max_size=300))
def test_perfect_hash_is_minimal_and_turns_others_away(keys):
    keys = np.array(sorted(keys), np.uint64)
    perfect = token_index.PerfectHash.from_bytes(token_index.PerfectHash.build(keys).to_bytes())
    assert sorted(perfect.slots(keys).tolist()) == list(range(len(keys)))


@pytest.fixture(scope="module")
def tokenizer():
    path = pytest.importorskip("public_tokenizers").path
    return path("byte_bpe_50k.json")


def test_words_put_together_encode_as_the_library_does(tokenizer):
    encoder = token_index.Encoder(tokenizer)
    texts = ["", " ", "a b", " lead", "trail ", "two  blanks", "tab\tand\nline", "it's don't I'LL", "x<|endoftext|>y <|endoftext|> z", "é À 日本 語 x", "1 23 .. !! a b", "a᠎b c"]
    assert encoder.by_word and encoder.encode(texts) == encoder.whole(texts) == encoder.encode(texts)
    rng = np.random.default_rng(6)
    parts = ["a", " ", "  ", "b.", "c!?", "\t", "\n", "é", "日本", "'s", "don't", "I'LL", "<|endoftext|>", "1", "23", "…", "\xa0", "\u2003", "x-y", "&*", "#tag", "É.", ".", "\x1c", "ß,"]
    mixes = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(5000)]
    assert encoder.encode(mixes) == encoder.whole(mixes) and encoder.encode([]) == []


def test_token_files_round_trip(spark, odd_docs, no_docs, tokenizer):
    encoder = token_index.Encoder(tokenizer)
    ordered = sorted(((k if k is not None else -1, t or "") for k, t in ODD))
    start, expected = 0, []
    for k, t in ordered:
        ids = np.append(np.frombuffer(encoder.whole([t])[0], "<u2"), 0).astype("<u4")
        expected.append((None if k == -1 else k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    location = work_path(spark, "shards")
    token_index.write_shards(odd_docs, tokenizer, location, shard_bytes=60_000)
    index, buckets = token_index.build_index(spark, location, bucket_keys=3)
    keys = token_index.keys_of(odd_docs)
    located = token_index.locate(keys.union(spark.createDataFrame([(77, 0), (9, 5)], "doc_id long, occurrence int")), index, buckets)
    assert located.count() == len(ODD) and located.select("shard").distinct().count() > 1
    found = [tuple(r) for r in token_index.read_back(spark, location, located).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert token_index.encoded_documents(no_docs, tokenizer).count() == 0


# --- 7: decontamination


def brute_overlaps(rows, items):
    """(doc_id, item_id) with a stretch in place of 13 tokens (the item, if shorter) of which 80 % are equal."""
    tokens = lambda t: [x for x in (spaced_seeds.token(w) for w in re.split(r"[\x20\x09-\x0D]+", t or "")) if x]
    out = set()
    for item, text in items:
        b = tokens(text)
        if len(b) < 5:
            continue
        n = min(13, len(b))
        for doc, words in ((k, tokens(t)) for k, t in rows):
            for i in range(len(words) - n + 1):
                for j in range(len(b) - n + 1):
                    if sum(x == y for x, y in zip(words[i : i + n], b[j : j + n], strict=True)) >= 0.8 * n:
                        out.add((doc, item))
    return out


def test_every_two_substitutions_leave_a_seed():
    for size, masks in ((13, spaced_seeds.LONG_MASKS), (12, spaced_seeds.SHORT_MASKS), (10, spaced_seeds.SHORT_MASKS), (9, spaced_seeds.SHORT_MASKS), (5, spaced_seeds.SHORT_MASKS)):
        allowed = size - int(np.ceil(0.8 * size))
        for a in range(size):
            for b in range(a, size) if allowed == 2 else [a]:
                assert any({a, b}.isdisjoint({s + p for p in mask}) for mask in masks for s in range(size - max(mask)))


def test_spaced_seeds_equal_brute_force(spark, make_docs):
    rng = random.Random(7)
    words = [f"t{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(3, 30)))) for k in range(12)] + [(50, None), (51, "")]
    rows = []
    for k in range(60):
        text = rng.choices(words, k=rng.randint(0, 30))
        if k % 2:
            passage = items[rng.randrange(12)][1].split()
            for _ in range(rng.randint(0, 5)):
                passage[rng.randrange(len(passage))] = "changed"
            text[3:3] = [w.upper() + "," for w in passage]
        rows.append((k, " ".join(text)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_overlaps(rows, items)
    for block in (1_000_000, 60):
        found = spaced_seeds.contaminated(make_docs(rows), benchmark, block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == expected and expected
        assert all(r["n_equal"] >= 0.7 * (r["doc_end"] - r["doc_start"]) for r in found)
    clean = spaced_seeds.clean_only(make_docs(rows, clashing=True), benchmark, 60)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted({k for k, _ in rows} - {k for k, _ in expected})


def test_spaced_seeds_odd_rows(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "here and some more of them to make it long"), (0, "HERE and some more of them to make it long!")], "item_id long, text string")
    found = spaced_seeds.contaminated(odd_docs, benchmark).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["8", "9", "9", "None"] and {r["item_id"] for r in found} == {0}
    assert spaced_seeds.clean_only(odd_docs, benchmark).columns == odd_docs.columns
    assert spaced_seeds.clean_only(odd_docs, benchmark).count() == len(ODD) - 4
    assert spaced_seeds.contaminated(no_docs, benchmark).count() == 0
    assert spaced_seeds.contaminated(odd_docs, benchmark.where("item_id > 9")).count() == 0
    assert spaced_seeds.clean_only(odd_docs, benchmark.where("item_id > 9")).count() == len(ODD)


# --- 8: quality


def test_descent_separates_and_weighs_classes_alike():
    rng = np.random.default_rng(2)
    rows = [(int(k % 10 > 0), np.array([k % 10 == 0, 2 + k % 5]).astype(int)) for k in rng.permutation(300)]
    weight, bias = nbsvm.descend(rows, np.ones(8))
    assert all((weight[f].sum() / np.sqrt(len(f)) + bias > 0) == bool(y) for y, f in rows)


def test_quality_on_planted_marks(spark, make_docs):
    rows, labels = labelled(8, 700, ["fine words", "Sunny days"], ["BUY$$$ NOW!!!", "### click"])
    docs = make_docs([*rows, (5000, None), (5001, ""), (None, "BUY$$$ NOW!!!")], clashing=True)
    truth = spark.createDataFrame([*labels, (None, 1), (5001, None)], "doc_id long, quality int")
    model = nbsvm.fit(docs, truth)
    scored = nbsvm.score(docs, model).collect()
    found = {r["doc_id"]: r for r in scored}
    held = [(found[k]["predicted"], y) for k, y in labels if found[k]["held_out"]]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.95
    assert {k for k, r in found.items() if r["held_out"]} == {k for k in [*dict(rows), 5000, 5001] if zlib.crc32(str(k).encode()) % 3 == 1}
    assert found[5000]["score"] == found[5001]["score"] and found[None]["predicted"] == 0
    good = nbsvm.keep_good(docs, model)
    assert good.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in good.collect()))) == sorted(str(r["doc_id"]) for r in scored if r["predicted"])


def test_models_without_labels_or_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ones = spark.createDataFrame([(k, 1, 1) for k in range(5, 13)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in nbsvm.score(odd_docs, nbsvm.fit(odd_docs, none)).collect()} == {0.5}
    assert nbsvm.keep_good(odd_docs, nbsvm.fit(odd_docs, ones)).count() == len(ODD)
    assert nbsvm.score(no_docs, nbsvm.fit(no_docs, ones)).count() == 0
    assert {r["predicted"] for r in toxic_lexicon.score(odd_docs, toxic_lexicon.fit(odd_docs, none)).collect()} == {0}
    assert {r["predicted"] for r in toxic_lexicon.score(odd_docs, toxic_lexicon.fit(odd_docs, ones)).collect()} == {1}
    assert toxic_lexicon.score(no_docs, toxic_lexicon.fit(no_docs, ones)).count() == 0


# --- registered queries


@needs_data
def test_registered_queries_and_their_sql(spark):
    added = set(driver.queries())
    assert {"pipeline", *queries.QUERIES} <= added and len(queries.QUERIES) == 10
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        found = queries.QUERIES[name](spark, SF_DIR)
        result = connection.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(map(repr, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(repr, result.fetchall()))


@needs_data
@pytest.mark.parametrize(("name", "label"), [("op8_nbsvm", "quality"), ("op5_toxic_lexicon", "toxic")])
def test_held_out_accuracy(spark, name, label):
    found = queries.QUERIES[name](spark, SF_MORE).join(table(spark, SF_MORE, "labels").select("doc_id", label), "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found[label]).mean() > 0.93


@needs_data
def test_pipeline_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF_DIR, "documents").collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF_DIR, "benchmark").collect()]
    frame, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    good = {r["doc_id"] for r in nbsvm.score(frame, nbsvm.fit(frame, labels)).collect() if r["predicted"]}
    last = {docs[k].translate(LOWER): k for k in sorted(good)}
    named = brute_components({k: brute_fingerprint(docs[k]) for k in last.values()})
    kept = {k: docs[k] for k, root in named.items() if k == root}
    leaked = {k for k, _ in brute_overlaps([(k, t) for k, t in kept.items()], items)}
    expected = {k: len(t.encode().split()) + 1 for k, t in kept.items() if k not in leaked}
    found = corpus_pipeline.run(spark, SF_DIR).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in found} == expected and leaked
    assert len(good) < len(docs) and len(last) < len(good)


def test_pipeline_stages_keep_the_columns(spark, odd_docs, no_docs, monkeypatch):
    small = {"labels": spark.createDataFrame([(k, 1) for k in range(12)], "doc_id long, quality int"), "benchmark": spark.createDataFrame([(1, "here and some more of them to make it long")], "item_id long, text string")}
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: small[name])
    for docs in (odd_docs, no_docs):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            rows = corpus_pipeline.staged(stage(spark, rows, "unused"), name)
            assert name == "packing" or rows.columns == docs.columns
        assert rows.columns[0] == "bin_id" and (rows.count() > 0) == (docs is odd_docs)
    assert content_sort.keep_one(covering_simhash.keep_one(odd_docs)).columns == odd_docs.columns


def test_seeds_of_repetitive_texts_give_each_alignment_once():
    """Every alignment that some seed supports, as the product of all equal seeds gives it, without that product."""
    rng = np.random.default_rng(7)
    names = ["a", "b", "c"]
    texts = [" ".join(rng.choice(names, rng.integers(0, 60))) for _ in range(40)] + ["a " * 50, "a b " * 40, "x " + "a " * 30 + "y"]
    items = [" ".join(rng.choice(names, rng.integers(5, 30))) for _ in range(25)] + ["a " * 20, "a b " * 12, "a " * 7]
    hashed = lambda t: spaced_seeds.Words(pa.array([t]), spaced_seeds.token).hashes()
    block = spaced_seeds.Block([(k, hashed(t).tobytes()) for k, t in enumerate(items)])
    found = {(text, item, start - at) for text, item, start, _, at, _, _ in block.matches(pa.array(texts))}
    expected = set()
    for text, words in enumerate(map(hashed, texts)):
        for k, tokens in enumerate(map(hashed, items)):
            masks = spaced_seeds.LONG_MASKS if len(tokens) >= 13 else spaced_seeds.SHORT_MASKS
            shifts = {p - q for mask in masks for p in range(len(words) - max(mask)) for q in range(len(tokens) - max(mask)) if all(words[p + m] == tokens[q + m] for m in mask)}
            stretch = min(13, len(tokens))
            for shift in shifts:
                low, high = max(0, shift), min(len(words), shift + len(tokens))
                equal = (words[low:high] == tokens[low - shift : high - shift]).astype(int)
                if any(equal[p : p + stretch].sum() >= 0.8 * stretch for p in range(high - low - stretch + 1)):
                    expected.add((text, k, shift))
    assert found == expected
    assert len(found) > 200


def test_one_word_repeated_does_not_multiply_out():
    block = spaced_seeds.Block([(1, spaced_seeds.Words(pa.array(["word " * 3_000]), spaced_seeds.token).hashes().tobytes())])
    assert len(block.matches(pa.array(["word " * 20_000]))) == 20_000 + 3_000 - 25  # all shifts that leave 13 tokens
