import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallybook.llm import packing
from tallybook.llm.queries import op12_packing, tokenizer_path

from .conftest import SMALL


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.json")


def encode(path, texts):
    from tokenizers import Tokenizer
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def check_packed(rows, length):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert 0 < at <= length
    return len(bins)


def test_pieces_of_whole_documents(spark, path, texts):
    rows = op12_packing(spark, SMALL).collect()
    ids = {d: [*x, 0] for (d, _), x in zip(texts, encode(path, [t for _, t in texts]))}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        own = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(own)
    assert by_doc.keys() == ids.keys()
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) == len(ids[doc])
        assert all(r.length == 2048 for r in own[1:])
    used = check_packed(rows, 2048)
    least = -(-sum(map(len, ids.values())) // 2048)
    assert least <= used <= least + 2


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \t\n\r.,'sé  　文<|>\U0001f600́", max_size=60))
def test_runs_give_the_ids_of_whole_texts(path, text):
    tokenizer = packing.ByteTokenizer(path)
    assert tokenizer.by_run
    samples = [text, "", f"{text} <|endoftext|> {text}", "  " + text]
    ids, first = tokenizer.texts(pa.array(samples))
    got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert got == encode(path, samples)


def reachable(room, lengths):
    sums = {0}
    for v in lengths:
        sums |= {s + v for s in sums if s + v <= room}
    return max(sums)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=12), st.integers(0, 60))
def test_the_fullest_combination(lengths, room):
    left = defaultdict(int)
    for v in lengths:
        left[v] += 1
    chosen = packing.fullest(room, sorted(left, reverse=True), left)
    assert sum(chosen) == reachable(room, lengths)
    assert all(chosen.count(v) <= left[v] for v in chosen)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_a_plan_seats_every_piece_once(counts):
    plan = packing.bin_plan(counts, 64)
    rows = [(v, r) for v, n in counts.items() for r in range(n)]
    if not rows:
        assert plan == []
        return
    batch = pa.RecordBatch.from_arrays(
        [pa.array([v for v, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.int64())],
        ["length", "rank"])
    out = next(packing._seated(plan)(iter([batch])))
    bins = defaultdict(list)
    for v, s, o in zip(*(out.column(c).to_pylist() for c in ("length", "sequence_id", "offset"))):
        bins[s].append((o, v))
    assert len(bins) == sum(times for times, _ in plan)
    for own in bins.values():
        at = 0
        for offset, v in sorted(own):
            assert offset == at
            at += v
        assert at <= 64


def test_odd_rows(odd, nothing, path):
    table = packing.token_pieces(odd, path, 100)
    rows = packing.pack(table, 100).collect()
    check_packed(rows, 100)
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = sorted((-1 if d is None else d, len(x) + 1)
                  for (d, _), x in zip(texts, encode(path, [t for _, t in texts])))
    total, starts = defaultdict(int), defaultdict(int)
    for r in rows:
        total[-1 if r.doc_id is None else r.doc_id] += r.length
        starts[-1 if r.doc_id is None else r.doc_id] += r.piece == 0
    expected, rows_of = defaultdict(int), defaultdict(int)
    for d, n in want:
        expected[d] += n
        rows_of[d] += 1
    assert total == expected and starts == rows_of
    assert packing.pack(packing.token_pieces(nothing, path)).collect() == []


def test_sequences_hold_the_pieces_ids(spark, path):
    docs = spark.createDataFrame([(n, f"word {n} " * n) for n in range(30)], "doc_id long, text string")
    table = packing.token_pieces(docs, path, 64)
    whole = {r.sequence_id: r for r in packing.sequences(table, 64).collect()}
    ids = {(r.doc_id, r.piece): bytes(r.ids) for r in table.collect()}
    for r in packing.pack(table, 64).collect():
        at = 4 * r.offset
        assert bytes(whole[r.sequence_id].ids)[at:at + 4 * r.length] == ids[r.doc_id, r.piece]
    assert all(len(r.ids) == 4 * r.length for r in whole.values())
