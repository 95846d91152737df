import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tallybook.llm import fingerprints, graph, neardup, substrings
from tallybook.llm.words import text_buffers

from .conftest import LONG

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACED.findall(text or "")


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def components(sets, part, whole):
    """Least id reachable, by comparing all pairs that share a shingle."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for a, b in {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}:
        shared = len(sets[a] & sets[b])
        if whole * shared >= part * (len(sets[a]) + len(sets[b]) - shared):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}


# ------------------------------------------------------------------- op 1

@pytest.mark.parametrize("k, part, leaf", [(3, 85, 512), (5, 80, 512), (5, 80, 4)])
def test_components_are_those_of_all_pairs(spark, table, texts, monkeypatch, k, part, leaf):
    monkeypatch.setattr(neardup, "MANY", 2)
    monkeypatch.setattr(neardup, "DEPTH", 3)
    rows = neardup.near_duplicates(table("documents"), k, (part, 100), leaf=leaf).collect()
    sets = {i: shingles(t, k) for i, t in texts}
    want = components(sets, part, 100)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert len(set(want.values())) < len(want)


def test_a_large_group_of_near_copies_is_one_class(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MANY", 2)
    base = [f"w{i}" for i in range(200)]
    rows = [(n, " ".join(base[:n % 150] + [f"edit{n}"] + base[n % 150 + 1:])) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, 5, (80, 100), leaf=16).collect()
    assert {r.component_id for r in got} == {0}


def near_copies(spark, n):
    base = [f"w{i}" for i in range(200)]
    return spark.createDataFrame(
        [(k, " ".join(base[:k % 150] + [f"edit{k}"] + base[k % 150 + 1:])) for k in range(n)],
        "doc_id long, text string")


def test_leaf_rows_grow_with_a_group_of_near_copies_and_not_with_its_square(spark, monkeypatch):
    seen = []
    confirm = neardup._confirmed_links

    def counting(docs, leaders, parts, leaves, *rest):
        seen.append(leaves.count())
        return confirm(docs, leaders, parts, leaves, *rest)

    monkeypatch.setattr(neardup, "_confirmed_links", counting)
    totals = []
    for n in (500, 1000):
        seen.clear()
        got = neardup.near_duplicates(near_copies(spark, n), 5, (80, 100), leaf=64).collect()
        assert {r.component_id for r in got} == {0}
        totals.append(sum(seen))
    assert totals[1] < 2.6 * totals[0]


def test_a_few_unlike_documents_of_large_nodes_are_not_compared_in_chunks(spark, monkeypatch):
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(n, " ".join(f"w{n}x{i}" for i in range(20))) for n in range(800)]
    rows += [(n, line + " " + " ".join(f"w{n // 2}y{i}" for i in range(30)) + f" end{n}")
             for n in range(1000, 1014)]  # pairs of near copies, which share a line
    calls, large = [], []
    confirm, against = neardup._confirmed_links, neardup._against_parts
    monkeypatch.setattr(neardup, "_confirmed_links", lambda *a: calls.append(1) or confirm(*a))
    monkeypatch.setattr(neardup, "_against_parts", lambda *a: large.append(1) or against(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id
           for r in neardup.near_duplicates(docs, 3, (85, 100), leaf=4).collect()}
    assert got == components({n: shingles(t, 3) for n, t in rows}, 85, 100)
    assert got[1013] == 1012 and got[1011] == 1010
    assert large and len(calls) == 1


@pytest.mark.parametrize("rest, part", [(70, 0), (0, 90), (1, 200), (40, 200), (9, 5)])
def test_all_but_pairs_of_the_part_meet_in_a_leaf(rest, part):
    n, leaf = rest + part, 16
    batch = pa.RecordBatch.from_pydict({
        "node": pa.array([5] * n, pa.int64()), "doc_id": pa.array(range(n), pa.int64()),
        "joined": [i >= rest for i in range(n)], "n_part": pa.array([part] * n, pa.int64()),
        "n_rest": pa.array([rest] * n, pa.int64())})
    held = defaultdict(set)
    for out in neardup._deal(leaf)([batch]):
        for node, doc in zip(*(c.to_pylist() for c in out.columns)):
            held[node].add(doc)
    met = {(a, b) for docs in held.values() for a in docs for b in docs if a < b}
    assert met >= {(a, b) for a in range(rest) for b in range(a + 1, n)}
    assert max(map(len, held.values()), default=0) <= 3 * leaf
    if not rest:
        assert not held


def test_parts_of_linked_rows():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 200, (2, 120))
    want = components({i: {f"link{k}" for k in range(120) if i in (a[k], b[k])}
                       for i in range(200)}, 0, 1)
    assert neardup.linked_parts(200, a, b).tolist() == [want[i] for i in range(200)]


def test_pairs_with_low_estimates_are_linked(spark):
    rows = []
    for n in range(20_000):  # 34 shared shingles of 40
        same = " ".join(f"w{n}x{i}" for i in range(36))
        rows += [f"{same} a b c", f"{same} d e f"]
    marks = neardup.signatures(neardup.ShingleSets(*text_buffers(pa.array(rows)), 3))
    agree = (marks[::2] == marks[1::2]).sum(1)
    low = np.flatnonzero(agree < 45)  # 3.5 standard errors below 0.85
    assert len(low) > 5
    docs = spark.createDataFrame([(int(i), rows[i]) for n in low for i in (2 * n, 2 * n + 1)],
                                 "doc_id long, text string")
    got = {r.doc_id: r.component_id
           for r in neardup.near_duplicates(docs, 3, (85, 100)).collect()}
    assert got == {int(i): int(2 * n) for n in low for i in (2 * n, 2 * n + 1)}


def test_roots_of_the_trees_share_no_position(spark):
    nodes = np.array(neardup.roots(spark, neardup.TREES, neardup.BRANCHES)).view(np.uint64)
    picked = neardup.picks(nodes, neardup.BRANCHES, neardup.POSITIONS)
    assert len(nodes) == neardup.TREES
    assert len(set(np.concatenate(picked).tolist())) == neardup.TREES * neardup.BRANCHES


def test_near_duplicates_of_odd_rows(odd, nothing):
    got = defaultdict(list)
    for r in neardup.near_duplicates(odd).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(8, 1, True)] * 2
    assert got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)] and got[4] == [(0, 4, True)]
    assert got[5] == [(1, 5, True)]
    assert got[6] == [(4, 6, True)]
    assert sorted(got[7]) == [(3, 1, False), (8, 1, False)]
    assert sorted(got[None]) == [(0, None, True), (1, None, True)]
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 2, 3, 4, 5, 6, 8]
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.keep_one(nothing).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {
        **{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert len(got) == 81


def test_components_of_repeated_links(spark):
    rng = np.random.default_rng(5)
    edges = rng.integers(0, 300, (220, 2)).tolist() * 3 + [(n, 400 + n % 3) for n in range(50)]
    frame = spark.createDataFrame([tuple(e) for e in edges], "a long, b long").repartition(7)
    got = graph.components(frame).collect()
    used = {n for e in edges if e[0] != e[1] for n in e}
    want = neardup.linked_parts(500, *np.array(edges).T).tolist()
    assert len(got) == len(used)
    assert {r.node: r.component for r in got} == {n: want[n] for n in used}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = [f"x{i}" for i in range(1200)]
    rows = [" ".join(pool[lo:lo + 400]) for lo in rng.integers(0, 60, 60)]
    sets = neardup.ShingleSets(*text_buffers(pa.array(rows)), 3)
    marks = neardup.signatures(sets)
    errors = []
    for a in range(0, 60, 2):
        x, y = (set(sets.values[sets.first[i]:sets.first[i + 1]].tolist()) for i in (a, a + 1))
        errors.append((marks[a] == marks[a + 1]).mean() - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


# ------------------------------------------------------------------- op 5

def removed(rows, size=20):
    """Per (id, text) in order: which words a window covers that also starts earlier."""
    first = {}
    places = []
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - size + 1):
            key = tuple(w[s:s + size])
            places.append((key, i, s))
            first[key] = min(first.get(key, (i, s)), (i, s))
    gone = defaultdict(set)
    for key, i, s in places:
        if first[key] != (i, s):
            gone[i].update(range(s, s + size))
    return gone


@pytest.mark.parametrize("block", [20_000, 8 << 20])
def test_removed_words_are_those_of_later_windows(table, texts, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    gone = removed(texts)
    got = {r.doc_id: r for r in substrings.removal_counts(table("documents")).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        kept = " ".join(w for n, w in enumerate(words(t)) if n not in gone[i])
        assert (got[i].n_words, got[i].n_removed) == (len(words(t)), len(gone[i]))
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert any(gone.values())


def test_factors_point_at_equal_earlier_words(table, texts):
    by_id = {i: words(t) for i, t in texts}
    for r in substrings.duplicate_factors(table("documents")).collect():
        for f in substrings.join_factors([c.asDict() for c in r.copies]):
            assert (f["ref_doc"], f["ref_start"]) < (r.doc_id, f["start"])
            size = f["end"] - f["start"]
            assert size >= 20
            assert by_id[r.doc_id][f["start"]:f["end"]] == \
                by_id[f["ref_doc"]][f["ref_start"]:f["ref_start"] + size]


def test_removal_of_odd_rows(spark, odd, nothing):
    got = defaultdict(list)
    for r in substrings.removal_counts(odd).collect():
        got[r.doc_id].append((r.n_words, r.n_removed))
    assert got[1] == [(12, 0)] * 2 and got[2] == got[3] == got[4] == [(0, 0)]
    n = len(words(LONG))
    assert got[6] == [(n, n - 4)]  # only the first period has no earlier window
    assert sorted(got[None]) == [(0, 0), (5, 0)]
    assert substrings.removal_counts(nothing).count() == 0
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(1, line), (1, line), (2, "x " + line), (None, line)]
    twice = substrings.removal_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 9, r.n_removed) for r in twice.collect()) == [
        (1, 0), (1, 0), (2, 30), (9, 30)]


# ------------------------------------------------------------------ op 10

def test_edited_texts_and_order(table, texts, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_ROWS", 37)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(table("documents")).collect()}
    by_text = {}
    for n, (i, t) in enumerate(texts):
        following = texts[(n + 1) % len(texts)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + following[:cut]
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        if edited == t:
            assert r.near_edited == 1 and r.edited_fingerprint == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
    clear = [r for r in got.values() if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in clear]) > 0.99
    assert np.mean([r.near_edited for r in clear]) > 0.6


def test_peeling_finds_the_difference_of_digests(texts):
    column = pa.array([t for _, t in texts], pa.large_string())
    p = fingerprints.Paragraphs(*text_buffers(column))
    first = np.searchsorted(p.text_of, np.arange(p.n + 1))
    keys = [set(p.keys[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    a, b = np.arange(0, p.n - 1), np.arange(1, p.n)
    only = fingerprints.differences(p, a, p, b)
    assert only[0].tolist() == [len(keys[i] - keys[j]) for i, j in zip(a, b)]
    assert only[1].tolist() == [len(keys[j] - keys[i]) for i, j in zip(a, b)]


def test_fingerprints_of_odd_rows(spark, odd, nothing):
    got = defaultdict(list)
    for r in fingerprints.edited_fingerprints(odd).collect():
        got[r.doc_id].append(r)
    assert {i: len(r) for i, r in got.items()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2, 8: 1,
                                                  None: 2}
    empty = got[2][0]
    assert (empty.n_chars, empty.near_edited, empty.near_next) == (0, 1, 1)
    assert empty.fingerprint == got[3][0].fingerprint
    assert got[1][0].fingerprint == got[1][1].fingerprint
    assert got[6][0].n_chars == len(LONG)
    assert fingerprints.edited_fingerprints(nothing).count() == 0
    alone = spark.createDataFrame([(5, "only one text here")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(alone).first().near_next == 1
