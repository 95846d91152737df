import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallybook.llm import collocations

FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(rows, longest=3, least=10, covered=50, top=2000):
    """What ``collocations`` should give, by loops."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        found = []
        for p, a in candidates.items():
            if longer[p] and 100 * longer[p] >= covered * a:
                continue
            cuts = [(10 ** 6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_hot_pair_and_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 500)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 2000)
    pick = np.random.default_rng(5)
    rows = []
    for n in range(400):
        words = [f"w{int(x)}" for x in pick.zipf(1.6, 20) % 50]
        words[3:3] = ["Hot", "pair"] * int(pick.integers(0, 4))
        text = " ".join(words).replace("w7 ", "w7. ").replace("w9 ", "w9\t ")
        rows.append((["en", "de", None, "und"][n % 7 % 4], text))
    rows += rows[:50]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = rows_of(collocations.collocations(docs))
    assert got == brute(rows)
    assert any(p == "hot pair" or "hot pair" in p for _, _, p, *_ in got)
    four = rows_of(collocations.collocations(docs, longest=4, least=6, covered=80, top=30))
    assert four == brute(rows, 4, 6, 80, 30)


def test_words_that_share_a_code_take_another_seed(spark, monkeypatch):
    rows = [("en", f"one two w{n % 6} one two w{n % 5}") for n in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    real, seeds = collocations.dictionary, []

    def poor(docs, seed):
        seeds.append(seed)
        words = real(docs, seed)
        return words.withColumn("code", words["code"] % 3) if seed == 0 else words

    monkeypatch.setattr(collocations, "dictionary", poor)
    assert rows_of(collocations.collocations(docs)) == brute(rows)
    assert seeds == [0, 1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 3), st.integers(0, 3)), max_size=60),
       st.integers(1, 6))
def test_equal_partitions(suffixes, least):
    suffixes = [(a, b, c if b else 0) for a, b, c in suffixes]
    codes = np.array(suffixes, np.uint64).reshape(-1, 3).T
    weights = np.arange(len(suffixes)) % 3 + 1.0
    want = Counter()
    for s, w in zip(suffixes, weights):
        for d in range(1, 4):
            if s[d - 1]:
                want[s[:d]] += int(w)
    got = {}
    for depth, at, total in collocations.equal_partitions(codes, weights, least):
        for d, i, n in zip(depth.tolist(), at.tolist(), total.tolist()):
            assert suffixes[i][:d] not in got
            got[suffixes[i][:d]] = n
    assert got == {p: n for p, n in want.items() if n >= least}


def test_scores_of_great_counts_are_exact(spark):
    big = 10 ** 12 + 7
    by_length = {1: spark.createDataFrame([(1, big + 5), (2, big + 11)], "c0 long, f long"),
                 2: spark.createDataFrame([(1, 2, big)], "c0 long, c1 long, f long")}
    row = collocations._cut_scores(2, by_length).first()
    assert row["score"] == 10 ** 6 * big * big // ((big + 5) * (big + 11))


def test_phrases_of_odd_rows(odd, nothing):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert rows_of(collocations.collocations(odd, least=2)) == brute(rows, least=2)
    assert collocations.collocations(nothing).collect() == []


@pytest.mark.parametrize("text", ["", None, "one", ". , !"])
def test_tables_without_phrases(spark, text):
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    assert collocations.collocations(docs, least=1).collect() == []
