"""Rows of one id with different texts, and rows without an id, keep results of their own."""

import hashlib
import re
from collections import Counter, defaultdict

from tallybook.llm import decontaminate, licenses, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_removal(rows, window=20):
    """Rows of one id are one document; a place is (id, word number), null ids last."""
    places = defaultdict(set)
    split = [(float("inf") if d is None else d, WORDS.findall(t or "")) for d, t in rows]
    for doc, words in split:
        for i in range(len(words) - window + 1):
            places[tuple(words[i:i + window])].add((doc, i))
    out = []
    for (doc, words), (own, _) in zip(split, rows):
        gone = set()
        for i in range(len(words) - window + 1):
            if min(places[tuple(words[i:i + window])]) < (doc, i):
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((own, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_removal_where_ids_repeat_with_other_texts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    ten = " ".join(f"t{i}" for i in range(10))
    for rows in (
            [(1, passage), (2, passage), (2, ten), (3, passage + " " + passage)],
            [(1, passage), (None, passage), (None, " ".join(f"v{i}" for i in range(30)))],
            [(2, passage + " " + ten), (2, ten + " " + passage), (2, passage + " " + ten), (None, None),
             (None, passage), (5, ""), (5, ten + passage + " " + passage)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = Counter(map(tuple, substrings.removal_counts(docs).collect()))
        assert got == brute_removal(rows)


def test_many_benchmark_blocks_keep_every_row(spark):
    items = [(f"i{n}", " ".join(f"b{n}x{i}" for i in range(14))) for n in range(6)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = ["a b " + items[0][1] + " c " + items[3][1], items[1][1] + " tail", "clean words", None,
             items[0][1][:40] + " x", items[5][1] + " " + items[4][1]]
    rows = [(d, t) for d in (1, 1, None, None, 2) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = Counter(map(str, decontaminate.contamination(docs, bench).collect()))
    many = Counter(map(str, decontaminate.contamination(docs, bench, block_bytes=1).collect()))
    assert one == many and sum(many.values()) == len(rows)
    assert sum(n for row, n in many.items() if "contaminated=True" in row) == 15


def test_rows_without_an_id_are_scanned(spark):
    text = "some words. Released under the MIT License. more words"
    docs = spark.createDataFrame([(None, text), (None, "nothing"), (3, text)], "doc_id long, text string")
    found = licenses.license_matches(docs, licenses.template_table(spark)).collect()
    assert sorted((r.doc_id is None, r.license, r.containment) for r in found) == [
        (False, "MIT", 1.0), (True, "MIT", 1.0)]
