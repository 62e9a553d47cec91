"""Exact and near copies: content sort, covering SimHash, substring and line dedup, each against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from ledgerloom.llm import content_sort, covering_simhash, patience_lines, prefix_trees
from ledgerloom.llm.common import components, forest

from .conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- exact copies


def test_content_sort_equals_brute_force(make_docs):
    rng = random.Random(4)
    rows = [(k, rng.choice(["A text", "a TEXT", "a text ", "É", "é", "x" * rng.randint(60, 70)])) for k in range(400)]
    groups = {}
    for k, t in rows:
        groups.setdefault(t.translate(LOWER), []).append(k)
    expected = [
        (k, max(g), len(g), k == max(g), hashlib.sha256(t.translate(LOWER).encode()).hexdigest())
        for k, t in rows
        for g in [groups[t.translate(LOWER)]]
    ]
    found = content_sort.groups_of_equals(make_docs(rows))
    assert rows_of(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(expected, key=repr)


def test_content_sort_spreads_one_group_over_partitions(spark, make_docs):
    """A single group: the splitters hold the doc_id, so its rows lie in several partitions and are joined up again."""
    docs = make_docs([(k, "same") for k in range(5000)])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = content_sort._sorted_runs(docs, heads_only=False)
        assert {(r["keep_id"], r["group_size"]) for r in runs.collect()} == {(4999, 5000)}
        assert runs.where("is_head").count() > 1
        assert [r["doc_id"] for r in content_sort.keep_one(docs).collect()] == [4999]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_content_sort_odd_rows(odd_docs, no_docs):
    found = content_sort.groups_of_equals(odd_docs).collect()
    assert len(found) == len(ODD)
    same = [r for r in found if r["group_size"] == 4]
    assert {r["keep_id"] for r in same} == {9} and sum(r["kept"] for r in same) == 1
    assert {r["doc_id"]: r["keep_id"] for r in found}[5] == 6  # null counts as empty
    kept = content_sort.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({(t or "").translate(LOWER) for _, t in ODD})
    assert content_sort.groups_of_equals(no_docs).count() == 0 == content_sort.keep_one(no_docs).count()


# --- near copies


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)][: len(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def near_copies(n):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(n):
        text = rng.choices(words, k=400) if k % 10 == 0 else list(rows[k - k % 10][1])
        if k % 10:
            text[rng.randrange(400)] = "changed"
        rows.append((k, text))
    return [(k, " ".join(t)) for k, t in rows]


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    masks = np.array(covering_simhash.masks(), np.uint64)
    for _ in range(3000):
        differ = np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)))
        assert ((masks & differ) == 0).any()


def test_simhash_equals_brute_force(make_docs):
    rows = near_copies(120) + [(500, "two words"), (501, "Two  WORDS"), (502, ""), (503, None), (504, "\n")]
    prints = {k: brute_fingerprint(t) for k, t in rows}
    named = brute_components(prints)
    assert len(set(named.values())) < len(set(prints.values()))  # links beyond equal fingerprints
    expected = sorted(((k, f"{prints[k]:016x}", named[k]) for k in prints), key=repr)
    docs = make_docs(rows)
    assert rows_of(covering_simhash.classes(docs), "doc_id", "fingerprint", "component_id") == expected
    # Buckets above the limit go by the points around their fingerprints, with the same result.
    crowded = covering_simhash.near_duplicates(docs, limit=1)
    assert rows_of(crowded, "doc_id", "component_id") == sorted(named.items(), key=repr)
    assert sorted(r["doc_id"] for r in covering_simhash.keep_one(docs).collect()) == sorted(set(named.values()))


def test_simhash_odd_rows(odd_docs, no_docs):
    found = covering_simhash.classes(odd_docs).collect()
    assert len(found) == len(ODD)
    assert {r["component_id"] for r in found if r["fingerprint"] == "0" * 16} == {5}
    kept = covering_simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in found}
    assert covering_simhash.classes(no_docs).count() == 0 == covering_simhash.keep_one(no_docs).count()


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, 51)}, **{k: 100 for k in range(101, 160)}}


def test_forest_of_links():
    nodes, roots = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {3: 1, 5: 1, 9: 8}


# --- repeated windows


def brute_removal(rows):
    """Per row (doc_id, n_words, n_removed, kept); rows that share a doc_id share their window places."""
    seen = {}
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0])
    texts = [(-(1 << 63) if k is None else k, k, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for k, t in order]
    for key, _, words in texts:
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            seen[window] = min(seen.get(window, (key, p)), (key, p))
    out = []
    for key, doc_id, words in texts:
        gone = set()
        for p in range(len(words) - 19):
            if seen[tuple(words[p : p + 20])] < (key, p):
                gone.update(range(p, p + 20))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc_id, len(words), len(gone), kept.decode()))
    return sorted(out, key=repr)


def test_prefix_trees_equal_brute_force(make_docs):
    rng = random.Random(9)
    passages = [" ".join(rng.choices("abcdefgh", k=rng.randint(15, 60))) for _ in range(8)]
    rows = []
    for k in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(200, "x " * 100), (201, "x " * 19), (202, "x " * 20), (203, "y " * 21 + "é")]
    expected = brute_removal(rows)
    for heavy in (prefix_trees.HEAVY, 1):  # prefixes of 16 words, and of 20 for anchors that occur more than once
        found = prefix_trees.remove_repeats(make_docs(rows), heavy)
        assert rows_of(found, "doc_id", "n_words", "n_removed", "kept") == expected
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found.collect()}
    assert spans[200] == [(1, 100)] and spans[201] == []


def test_prefix_trees_odd_rows(odd_docs, no_docs):
    found = prefix_trees.remove_repeats(odd_docs)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept") == brute_removal(ODD)
    assert prefix_trees.remove_repeats(no_docs).count() == 0


# --- shared lines


def test_align_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (rng.choices(range(12), k=rng.randint(0, 14)) for _ in range(2))
        pairs = patience_lines.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
    assert patience_lines.align([1, 2, 3, 4], [0, 1, 2, 9, 4]) == [(0, 1), (1, 2), (3, 4)]
    assert patience_lines.align([7, 1, 7, 2], [7, 2, 7, 1]) in ([(0, 0), (1, 3)], [(0, 0), (3, 1)])


def brute_lines(rows):
    lines = {k: [x.strip() for x in t.split("\n")] if t else [] for k, t in rows}
    out = {}
    for k, own in lines.items():
        rare = [x for x in own if len(x.split()) >= 5 and own.count(x) == 1]
        holders = {min(j for j, other in lines.items() if x in other and other.count(x) == 1) for x in rare}
        gone = set()
        for j in holders - {k}:
            for a, b in patience_lines.common_blocks(own, [len(x.split()) for x in own], lines[j]):
                gone.update(range(a, b))
        out[k] = sorted(gone)
    return out


def test_patience_lines_equal_brute_force(make_docs):
    rng = random.Random(6)
    pool = [" ".join(rng.choices("abcdefghijkl", k=rng.randint(1, 9))) for _ in range(60)]
    rows = []
    for k in range(80):
        at = rng.randrange(50)
        rows.append((k, "\n".join([*rng.choices(pool, k=rng.randint(0, 3)), *pool[at : at + rng.randint(0, 8)], f"own line number {k} of this text"])))
    docs = make_docs(rows)
    found = patience_lines.delete_shared_blocks(docs).collect()
    expected = brute_lines(rows)
    assert {r["doc_id"]: r["deleted"] for r in found} == expected and any(expected.values())
    texts = dict(rows)
    for r in found:
        lines = texts[r["doc_id"]].split("\n")
        assert r["text"].split("\n") == [x for k, x in enumerate(lines) if k not in r["deleted"]] or r["deleted"] == list(range(len(lines)))
        earlier = {x.strip() for k in texts if k < r["doc_id"] for x in texts[k].split("\n")}
        assert all(lines[k].strip() in earlier for k in r["deleted"])


def test_patience_lines_odd_rows(odd_docs, no_docs):
    found = patience_lines.delete_shared_blocks(odd_docs).collect()
    assert len(found) == len(ODD)
    assert {(r["doc_id"], r["n_deleted"]) for r in found if r["n_lines"] and r["n_deleted"]} == {(9, 1)}
    assert patience_lines.delete_shared_blocks(no_docs).count() == 0


def brute_runs(rows):
    """Lines in any run of consecutive lines, 5 words or more, that any earlier document has too: all pairs, all places."""
    lines = {k: [x.strip() for x in t.split("\n")] if t else [] for k, t in rows}
    out = {k: set() for k in lines}
    for k, own in lines.items():
        for other in (lines[j] for j in lines if j < k):
            for i in range(len(own)):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in own[i : i + n]) >= 5:
                        out[k].update(range(i, i + n))
    return {k: sorted(v) for k, v in out.items()}


def test_shared_lines_equal_brute_force(make_docs):
    rng = random.Random(16)
    pool = ["", *(" ".join(rng.choices("abcdefghijkl", k=rng.randint(1, 7))) for _ in range(50))]
    rows = []
    for k in range(90):
        parts = [pool[at : at + rng.randint(0, 6)] for at in rng.choices(range(45), k=rng.randint(0, 3))]
        rows.append((k, "\n".join([*(x for part in parts for x in part), f"own {k}", *rng.choices(pool, k=2)])))
    docs = make_docs(rows)
    found = {r["doc_id"]: r["deleted"] for r in patience_lines.delete_shared_lines(docs).collect()}
    assert found == brute_runs(rows) != brute_lines(rows)


def test_shared_lines_that_the_cut_offs_left(make_docs):
    """One 8-word line between own lines; a block whose lines have other first holders; short lines; repeats; other order."""
    line, other = "all rights of this text are reserved here", "written by nobody at any time"
    rows = [
        (1, f"first text\n{line}\nits end"),
        (2, f"second text\n{line}\nnot its end"),
        (3, f"{other}\nown three\n{line}"),
        (4, f"own four\n{line}\n{other}\nyes"),
        (5, "one two\nthree\nfour five\nown words of five"),
        (6, "own six\none two\nthree\nfour five"),
        (7, f"{line}\nown seven\n{line}"),
        (8, "a b c\nd e\nown eight\nd e\na b c"),
        (9, "own nine\na b c\nd e"),
        (10, "a b c\nown ten\nd e"),
    ]
    found = {r["doc_id"]: r["deleted"] for r in patience_lines.delete_shared_lines(make_docs(rows)).collect()}
    assert found == {1: [], 2: [1], 3: [2], 4: [1, 2], 5: [], 6: [1, 2, 3], 7: [0, 2], 8: [], 9: [1, 2], 10: []}


def test_shared_lines_odd_rows(odd_docs, no_docs):
    found = patience_lines.delete_shared_lines(odd_docs).collect()
    assert len(found) == len(ODD)
    assert {(r["doc_id"], r["n_deleted"]) for r in found if r["n_lines"] and r["n_deleted"]} == {(9, 1)}
    assert patience_lines.delete_shared_lines(no_docs).count() == 0


def test_a_block_meets_its_own_earliest_holder(make_docs):
    """The block of 3 and 9 in document 3 was first held by 2; its lines were first held, singly, by 1 and 0."""
    head, body = "these three words", "a line of nine words in all of it"
    rows = [(0, f"zero\n{body}\nmore of zero"), (1, f"one\n{head}\nmore of one"), (2, f"two\n{head}\n{body}\nmore of two"), (3, f"three\n{head}\n{body}\nend"), (4, "a b c d\ne f g\nh"), (5, "five\ne f g\nh\nv"), (6, "six\na b c d\ne f g\nh")]
    found = {r["doc_id"]: (r["deleted"], r["partners"]) for r in patience_lines.delete_shared_lines(make_docs(rows)).collect()}
    assert {k: v[0] for k, v in found.items()} == brute_runs(rows)
    assert found[3] == ([1, 2], [0, 2]) and found[6] == ([1, 2, 3], [4])
