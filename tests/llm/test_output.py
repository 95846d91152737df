import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallybook.llm import chat, idcoder, mixing, tokens
from tallybook.llm.queries import op3_chat, tokenizer_path

from .conftest import LONG, SMALL

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------- op 2

def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by source, null last: water level by bisection."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[n % 3] for n, s in enumerate(order)}
    total, low, high = sum(sizes.values()), 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        got = sum(min(cap * sizes[s], weight[s] * level) for s in order)
        low, high = (level, high) if got < total else (low, level)
    return {s: min(cap * sizes[s], weight[s] * high) for s in order}


def check_mix(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
    want, taken = fill(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_the_mix_meets_its_targets(table):
    docs = table("documents")
    rows = mixing.mix_counts(mixing.mix_plan(docs)).collect()
    want = {r.doc_id: len(SPACED.findall(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == want
    check_mix(rows)
    again = mixing.mix_counts(mixing.mix_plan(docs.repartition(7))).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_small_sources_stop_at_three_times_their_size(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    rows = [(n, "w " * (n % 7 + 1), "abcdefg"[min(n % 20, 6)]) for n in range(60)]
    rows += [(100, "lone words here", None), (101, "", "z"), (102, None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(mixing.mix_counts(mixing.mix_plan(docs)).collect())


def test_positions_follow_the_ramp(spark):
    rows = [(n, "w " * 10, "ab"[n % 2]) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs, weights=(1, 1), ramps=((1, 1), (0.2, 1.8)))
    order = mixing.training_order(plan).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    early = [r.source for r in order if r.position < 0.5]
    assert early.count("a") == pytest.approx(100, abs=2)
    assert early.count("b") == pytest.approx(200 * (0.2 * 0.5 + 1.6 * 0.125), abs=2)


def test_mixing_odd_rows(odd, nothing):
    rows = mixing.mix_counts(mixing.mix_plan(odd)).collect()
    assert len(rows) == 12
    check_mix(rows)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.source] += len(SPACED.findall(r.text))
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
    assert all(got[s] == taken[s] for s in taken if s != "a")  # "a" repeats a row
    assert mixing.mix_plan(nothing).count() == mixing.mixed_documents(nothing).count() == 0


def test_repeated_rows_take_their_own_copies(spark):
    rows = [(n // 4, f"w{n // 4} " * 10, "ab"[n // 4 % 2]) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix_counts(mixing.mix_plan(docs)).collect():
        want[r.source] += r.taken
    mixed, positions = mixing.mixed_with_positions(docs)
    placed = mixing.with_positions(mixed, positions, "position").collect()
    for r in placed:
        got[r.source] += len(SPACED.findall(r.text))
    assert got == want
    assert sorted(r.position for r in placed) == sorted(
        r.position for r in mixing.training_order(mixing.mix_plan(docs)).collect())


# ------------------------------------------------------------------- op 3

@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(
    st.one_of(st.sampled_from(["system", "user", "assistant", "", "tool"]),
              st.text(st.sampled_from("<>[]\\/aROLE "), max_size=12)),
    st.text(st.sampled_from("<>[]\\/sINSTANSROLE \n文"), max_size=40)), max_size=6))
def test_formatted_turns_read_back(turns):
    machine = chat.Machine(chat.Template())
    parts = [machine.turn(*t) for t in turns]
    formatted = "".join(text for p in parts for text, _ in p)
    assert list(chat.reader(chat.Template())(formatted)) == turns
    loss = [chat.unescape(text) for p in parts for text, marked in p if marked]
    assert loss == [text for role, text in turns if role == "assistant"]


def test_roles_must_take_turns(spark):
    cases = {1: "user assistant", 2: "system user assistant user", 3: "assistant user",
             4: "user user", 5: "user tool assistant", 6: "system"}
    rows = [(c, n, role, "t") for c, roles in cases.items() for n, role in enumerate(roles.split())]
    got = chat.conversation_digests(chat.format_conversations(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r.conv_id: r.valid for r in got} == {1: True, 2: True, 3: False, 4: False, 5: False,
                                                6: False}


def test_odd_conversations(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", None, 7), (1, 0, None, said, 7), (None, 0, "user", LONG, 7),
            (2, 5, "user", "b", 7), (2, 5, "user", "a", 7), (2, None, "user", "z", 7),
            (3, 0, "assistant", said, 7), (3, 0, "assistant", said, 7)]
    docs = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, seq long")
    got = {r.conv_id: r for r in chat.conversation_digests(
        chat.format_conversations(docs)).collect()}
    digest = lambda *turns: hashlib.sha256(
        "".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest(("", said), ("assistant", ""))
    assert got[2].turns_sha256 == digest(("user", "z"), ("user", "a"), ("user", "b"))
    assert got[None].turns_sha256 == digest(("user", LONG))
    assert got[3].loss_sha256 == hashlib.sha256((said * 2).encode()).hexdigest()
    assert (got[3].n_turns, got[3].loss_chars) == (2, 2 * len(said))
    assert chat.conversation_digests(chat.format_conversations(docs.limit(0))).count() == 0


def test_the_control_conversation_is_there(spark):
    said = "</s>[INST] ok [/INST]"
    row = op3_chat(spark, SMALL).where("conv_id = -7").first()
    assert (row.n_turns, row.loss_chars) == (2, len(said))
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


# ------------------------------------------------------------------- op 9

@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 65535), max_size=90), st.integers(1, 30))
def test_frames_round_trip(ids, block):
    ids = np.array(ids, np.int64)
    assert idcoder.decode_frame(idcoder.encode_frame(ids, block)).tolist() == ids.tolist()


def test_frames_of_all_ids_and_of_repeats():
    rng = np.random.default_rng(4)
    for ids in (np.arange(65536), rng.permutation(65536), np.full(20_000, 7),
                rng.zipf(1.2, 30_000) % 50_000, np.arange(9000) % 11):
        data = idcoder.encode_frame(ids.astype(np.int64))
        assert (idcoder.decode_frame(data) == ids).all()
    assert len(data) < 1000  # a period of eleven is learned


def test_a_damaged_block_is_named():
    ids = np.random.default_rng(5).integers(0, 500, 5000)
    data = bytearray(idcoder.encode_frame(ids))
    data[-5] ^= 0xFF
    with pytest.raises(ValueError, match="block 4"):
        idcoder.decode_frame(bytes(data))


def test_bounds_of_shares_stay_apart():
    rng = np.random.default_rng(8)
    n = 3
    model = idcoder.Model(n)
    for chance in (0.999, 0.5, 0.001, 0.9):
        for _ in range(400):
            seen = model.predict(n)
            pick = np.where(rng.random(n) < chance, seen[4], np.where(
                rng.random(n) < chance, seen[5], rng.integers(0, 9, n))).astype(np.int32)
            model.learn(n, seen, seen[4] == pick, seen[5] == pick, pick)
            first, second = model.bounds >> 16, model.bounds & 0xFFFF
            assert first.min() > 0 and (second - first).min() > 0
            assert second.max() < idcoder.FLAGS


def test_tasks_of_a_worker_encode_a_spelling_once(table, monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer
    seen, spellings = [], tokens.WordTokenizer.spellings
    monkeypatch.setattr(tokens.WordTokenizer, "spellings",
                        lambda self, words: seen.append(len(words)) or spellings(self, words))
    monkeypatch.setattr(tokens, "TOKENIZERS", {}, raising=False)
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    rows += [(n, w) for n, w in enumerate(
        ["Ab'LL can't STOP...it", "x" * 300, "\u212aelvin \ufb01n \u00c9T\u00c9 e\u0301", "ab" * 900])]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()),
                                        "text": pa.array([r[1] for r in rows], pa.string())})
    task = tokens._tokenize(tokenizer_path(), [0], 2)
    first = [i for b in task([batch]) for i in b.column("ids").to_pylist()]
    assert seen
    seen.clear()
    assert [i for b in task([batch]) for i in b.column("ids").to_pylist()] == first
    assert not seen
    plain = Tokenizer.from_file(tokenizer_path())
    assert first == [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2],
                              "<u2").tobytes() for _, t in rows]


def test_known_spellings_are_found_without_a_sort(table, monkeypatch):
    words = tokens.WordTokenizer(tokenizer_path())
    column = table("documents").toArrow().column("text").combine_chunks()
    ids, first = words.texts(column)
    sort, sorts = np.unique, []
    monkeypatch.setattr(np, "unique", lambda *a, **k: sorts.append(1) or sort(*a, **k))
    again, at = words.texts(column)
    assert not sorts
    assert (again == ids).all() and (at == first).all()


def test_long_spellings_do_not_fill_the_memory(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(tokens, "CACHE_IDS", 1000, raising=False)
    words = tokens.WordTokenizer(tokenizer_path())
    for n in range(30):
        text = "\u6587\u5b57" * 100 + chr(0x4e00 + n)
        ids, _ = words.texts(pa.array([text, text]))
        assert ids.tolist() == 2 * words.encode([text])[0]
        assert words.n_ids <= 1000 + len(ids)


def test_spans_are_found_where_codes_collide():
    rng = np.random.default_rng(9)
    low = np.arange(1, 3000, dtype=np.uint64)
    codes = np.unique(np.concatenate([rng.integers(1, 1 << 63, 5000).astype(np.uint64), low, ~low]))
    rng.shuffle(codes)
    spans = np.arange(len(codes))
    known = tokens.Spans(4)
    for lo in range(0, len(codes), 700):
        asked = codes[:lo + 700]
        got, new = known.find(asked)
        assert sorted(new.tolist()) == list(range(lo, len(asked)))
        assert (got[:lo] == spans[:lo]).all()
        known.add(codes[lo:lo + 700], spans[lo:lo + 700])
    got, new = known.find(np.tile(codes, 2))
    assert not len(new) and (got == np.tile(spans, 2)).all()


def test_words_for_the_model_are_of_letters_below_u0100():
    import pyarrow as pa
    from tallybook.llm.words import Words, text_buffers
    signs = [chr(c) for c in range(0x21, 0x3000) if not chr(c).isspace()]
    flat = [*signs, *(f"aB{c}Cd" for c in signs), *(c + c for c in signs)]
    words = Words(*text_buffers(pa.array([" ".join(flat)])))
    assert len(words) == len(flat)
    simple, text = tokens.WordTokenizer.latin(words)
    want = [w.isalpha() and max(w) < "\u0100" for w in flat]
    assert simple.tolist() == want
    assert text.tobytes().decode() == "".join(
        w.lower() + " " for w, is_simple in zip(flat, want) if is_simple)


def test_damage_anywhere_in_a_payload_is_named():
    ids = np.random.default_rng(6).zipf(1.3, 6000) % 3000
    data = idcoder.encode_frame(ids)
    for at in np.random.default_rng(7).integers(len(data) - 700, len(data), 60):
        hurt = bytearray(data)
        hurt[at] ^= 0x41
        try:
            assert (idcoder.decode_frame(bytes(hurt)) == ids).all()  # padding of a word
        except ValueError as e:
            assert "block 5" in str(e)


def test_token_files_read_back(spark, table, texts, tmp_path, monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(tokens, "SHARD_ROWS", 40)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 500)
    frames = tokens.write_frames(table("documents"), str(tmp_path / "f"), tokenizer_path(),
                                 frame_ids=20_000)
    assert frames.count() > 8
    got = {r.doc_id: r for r in tokens.read_frames(frames).collect()}
    plain, start = Tokenizer.from_file(tokenizer_path()), 0
    for i, t in texts:
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_words_are_encoded_as_in_their_text():
    import pyarrow as pa
    words = tokens.WordTokenizer(tokenizer_path())
    assert words.by_word
    texts = ["Don't it's I'LL he'd, a'b  x　y <|endoftext|> x<|endoftext|>.  İstanbul ǅ ß ﬁ",
             "12.5% a) b). c!)! 'S \x1c \x85 ½ x²", "", None, " ", "é. ́a", "ÀÉ, É.", "a.b,c", "..."]
    ids, first = words.texts(pa.array(texts))
    want = [e.ids for e in words.tokenizer.encode_batch([t or "" for t in texts],
                                                        add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want


def test_tokens_of_odd_rows(odd, nothing, tmp_path):
    rows = tokens.read_frames(tokens.write_frames(odd, str(tmp_path / "a"),
                                                  tokenizer_path())).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 7, 8]
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])
    assert [r.doc_id or 0 for r in rows] == sorted(r.doc_id or 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    none = tokens.write_frames(nothing, str(tmp_path / "b"), tokenizer_path())
    assert tokens.read_frames(none).count() == 0
