import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tallybook.llm.words import (ALNUM, LOWER, NOT_SPACE, Words, gram_hashes, gram_starts, pieces,
                                 text_buffers)

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SIGNS = st.text(st.sampled_from("abAB 09\t\n.-é文\x00\x1f~"), max_size=30)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.none(), SIGNS), max_size=8))
def test_words_are_those_of_the_patterns(texts):
    column = pa.array(texts, pa.string())
    for letters, pattern, fold in ((NOT_SPACE, SPACED, None), (ALNUM, PLAIN, LOWER)):
        words = Words(*text_buffers(column), letters)
        # folding may not change what is a word: A-Z is a letter in both
        want = [pattern.findall(lower(t or "") if fold is not None else t or "") for t in texts]
        assert words.counts.tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        seen = {}
        for word, code in zip(flat, words.hashes(fold).tolist()):
            assert seen.setdefault(word, code) == code
        assert len(set(seen.values())) == len(seen)


@settings(deadline=None, max_examples=60)
@given(st.lists(SIGNS, max_size=6), st.integers(1, 7))
def test_runs_of_words_hash_alike_only_if_equal(texts, size):
    words = Words(*text_buffers(pa.array(texts, pa.string())))
    codes = gram_hashes(words.hashes(), size)[gram_starts(words.first, size)].tolist()
    want = [tuple(w[i:i + size]) for t in texts for w in [SPACED.findall(t)]
            for i in range(len(w) - size + 1)]
    assert len(want) == len(codes)
    assert len(set(want)) == len(set(codes)) == len(set(zip(want, codes)))


def test_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(3000))
    alone = Words(*text_buffers(pa.array(["w7"]))).hashes()[0]
    monkeypatch.setattr("tallybook.llm.words.HASH_BYTES", 100)
    hashes = Words(*text_buffers(pa.array(["x", text]))).hashes()
    assert (hashes[1:][np.arange(3000) % 50 == 7] == alone).all()


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(SIGNS, st.text("aB\u00e9 ", max_size=90)), max_size=6))
def test_codes_are_alike_only_for_words_alike_but_for_case(texts):
    words = Words(*text_buffers(pa.array(texts, pa.string())))
    flat = [lower(w) for t in texts for w in SPACED.findall(t)]
    codes = words.codes().tolist()
    assert len(codes) == len(flat)
    assert len(set(flat)) == len(set(codes)) == len(set(zip(flat, codes)))


def test_codes_of_each_length_and_place():
    flat = ["x" * n + e for n in range(140) for e in "ab"]
    first = Words(*text_buffers(pa.array([" ".join(flat)]))).codes()
    assert len(set(first.tolist())) == len(flat)
    for shift in range(1, 9):
        again = Words(*text_buffers(pa.array([" " * shift + " ".join(flat).upper()]))).codes()
        assert (again == first).all()


def test_pieces_hold_every_row_once_within_the_limit():
    texts = ["a" * n for n in (0, 5, 50, 0, 3, 3, 3, 200, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["doc_id", "text"])
    cut = list(pieces([batch.slice(0, 4), batch.slice(4, 0), batch.slice(4)], limit=10))
    assert [i for p in cut for i in p.column("doc_id").to_pylist()] == list(range(9))
    for p in cut:
        assert p.num_rows == 1 or sum(map(len, p.column("text").to_pylist())) <= 10
    assert all(a.num_rows for a, _ in pairwise(cut))
