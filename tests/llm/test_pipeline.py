import re
import zlib

import numpy as np
import pytest
from tallybook.llm import mixing, toxicity
from tallybook.llm.queries import tokenizer_path

import corpus_pipeline

from .conftest import SMALL
from .test_dedup import components, shingles
from .test_scan import windows, words

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage makes of the last one's table, written and read again."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        function(spark, docs, SMALL).write.parquet(path)
        out.append((docs.collect(), docs.columns, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_toxic_documents_go(spark, stages):
    before, columns, after = stages[0]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores.collect()
                                                  if not r.predicted}
    assert after.columns == columns and after.count() < len(before)


def test_one_of_each_group_stays(stages):
    before, columns, after = stages[1]
    leaders = set(components({r.doc_id: shingles(r.text, 5) for r in before}, 80, 100).values())
    assert {r.doc_id for r in after.collect()} == leaders
    assert after.columns == columns and len(leaders) < len(before)


def test_contaminated_documents_go(spark, stages):
    before, columns, after = stages[2]
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    phrases = windows([(str(r.item_id), r.text) for r in items])
    sizes = {len(p) for p in phrases}
    clean = {r.doc_id for r in before for w in [words(r.text)]
             if not any(tuple(w[s:s + n]) in phrases for n in sizes
                        for s in range(len(w) - n + 1))}
    assert {r.doc_id for r in after.collect()} == clean
    assert after.columns == columns


def test_the_mix_takes_effect(stages):
    before, columns, after = stages[3]
    rows, text = after.collect(), {r.doc_id: r.text for r in before}
    assert after.columns == columns
    for r in rows:
        assert text[r.doc_id].startswith(r.text)
    total = sum(len(SPACED.findall(t)) for t in text.values())
    assert sum(len(SPACED.findall(r.text)) for r in rows) == pytest.approx(total, abs=20)
    assert max(list(map(lambda r: r.doc_id, rows)).count(i) for i in text) <= 3


def test_the_last_stage_reads_its_files_back(stages):
    from tokenizers import Tokenizer
    before, _, after = stages[4]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted((r.doc_id, zlib.crc32(np.array(
        [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()))
        for r in before)
    rows = sorted(after.collect(), key=lambda r: r.start)
    assert sorted((r.doc_id, r.ids_crc32) for r in rows) == want
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_the_files_carry_the_training_position_of_every_copy(stages):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = stages[2][2]
    ends = {r.doc_id: (r.text, [m.end() for m in SPACED.finditer(r.text)])
            for r in docs.collect()}
    want = []
    for r in mixing.training_order(mixing.mix_plan(docs)).collect():
        text, at = ends[r.doc_id]
        if r.words < r["size"]:
            text = text[:at[r.words - 1]]
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((r.position, r.doc_id, zlib.crc32(np.array(ids, "<u4").tobytes())))
    rows = stages[4][2].collect()
    assert sorted((r.position, r.doc_id, r.ids_crc32) for r in rows) == sorted(want)
    assert [r[1] for r in sorted(want)] != sorted(r[1] for r in want)


def test_run_is_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(
        map(tuple, stages[-1][2].collect()))


def test_stages_take_odd_and_no_rows(spark, odd, nothing):
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, odd, SMALL)
        assert function(spark, nothing, SMALL).count() == 0
        if name != "tokens":
            assert out.columns == odd.columns
        assert out.count() > 0
