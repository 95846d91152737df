import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallybook.llm import decontaminate, licenses
from tallybook.llm.fmindex import FMIndex, WaveletMatrix, suffix_array

from .conftest import LONG

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40),
       st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=4), max_size=6))
def test_the_index_finds_every_occurrence(symbols, phrases):
    text = np.array(symbols)
    index = FMIndex(text, sample=3)
    flat = np.array([s for p in phrases for s in p], np.int64)
    first = np.concatenate([[0], np.cumsum([len(p) for p in phrases])]).astype(np.int64)
    which, where = index.locate(*index.search(flat, first))
    want = {(n, i) for n, p in enumerate(phrases) for i in range(len(symbols))
            if symbols[i:i + len(p)] == p}
    assert sorted(zip(which.tolist(), where.tolist())) == sorted(want)


def test_suffixes_and_ranks():
    text = np.array([3, 1, 2, 1, 2, 1, 0])
    order = suffix_array(text)
    assert order.tolist() == sorted(range(7), key=lambda i: text[i:].tolist())
    tree = WaveletMatrix(text, 3)
    for symbol in range(4):
        for upto in range(8):
            got = tree.rank(np.array([symbol]), np.array([upto]))[0]
            assert got == (text[:upto] == symbol).sum()


def windows(items, size=10):
    out = {}
    for name, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            out.setdefault(tuple(w[i:i + n]), set()).add(name)
    return out


@pytest.mark.parametrize("block", [200, 8 << 20])
def test_hits_are_those_of_all_windows(spark, table, texts, block):
    items = [(str(r.item_id), r.text) for r in table("benchmark").collect()]
    short = [("900", "the"), ("901", "of the"), ("902", None), ("903", " .,- "), ("900", "and")]
    more = spark.createDataFrame([(int(i), t) for i, t in short], "item_id long, text string")
    phrases = windows(items + short)
    sizes = {len(p) for p in phrases}
    spans = decontaminate.benchmark_spans(table("documents"), table("benchmark").union(more),
                                          block_bytes=block)
    got = {r.doc_id: r for r in spans.collect()}
    for i, t in texts:
        w = words(t)
        hit, names = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if owners := phrases.get(tuple(w[s:s + n])):
                    hit.update(range(s, s + n))
                    names |= owners
        assert got[i].n_words == len(w)
        assert {p for a in got[i].spans for p in range(a.start, a.end)} == hit
        assert got[i]["items"] == sorted(names)


def test_contamination_of_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame(
        [(1, "Three four FIVE six seven eight nine ten eleven twelve thirteen", 5),
         (2, "text of the same", 5), (3, None, 5), (None, "word", 5)],
        "item_id long, text string, n long")
    rows = decontaminate.contamination(odd, items).collect()
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.contaminated) for r in rows}
    assert got[(1, 12)] == got[(7, 12)] == (10, 1, True)
    assert got[(7, 7)] == (4, 1, True) and got[(5, 1)] == (1, 1, True)
    assert got[(2, 0)] == got[(3, 0)] == got[(4, 0)] == (0, 0, False)
    assert got[(6, len(words(LONG)))] == (0, 0, False)
    clean = decontaminate.drop_contaminated(odd, items, block_bytes=10)
    assert clean.schema == odd.schema
    assert sorted(r.doc_id or 0 for r in clean.collect()) == [0, 0, 2, 3, 4, 6, 8]
    assert decontaminate.contamination(nothing, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, items.limit(0)).collect())


# ------------------------------------------------------------------- op 7

def test_licenses_are_found_by_containment(spark, odd, nothing):
    mit = dict(licenses.TEMPLATES[2:4][1:])["MIT"]
    cut = " ".join(mit.split()[2:])
    rows = [(1, f"code\n# {mit.upper()}\nmore words"), (2, "released under THE mit license!"),
            (3, "released under the license mit"), (4, f"so {cut} and on"), (5, None),
            (6, "Licensed under the Apache License, Version 2.0. " * 2),
            (7, " ".join(mit.split()[:9])), (8, "x " * 5 + "Licensed under CC BY-NC 4.0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    templates = licenses.template_table(spark)
    got = {(r.doc_id, r.license): r.containment
           for r in licenses.license_matches(docs, templates).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (4, "MIT"), (6, "Apache-2.0"), (8, "CC-BY-NC-4.0")}
    assert got[(1, "MIT")] == 1 and 0.8 <= got[(4, "MIT")] < 1
    assert licenses.license_matches(odd, templates).count() == 0
    assert licenses.license_matches(nothing, templates).count() == 0
    assert licenses.license_matches(docs, templates.limit(0)).count() == 0


def test_the_plan_has_no_python(spark, table):
    plan = licenses.license_matches(table("documents"), licenses.template_table(spark))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)
