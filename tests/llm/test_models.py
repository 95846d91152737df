import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tallybook.llm import quality, toxicity
from tallybook.llm.words import text_buffers

from .conftest import LONG

LARGER = "/root/testdata/sf0.1"


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def scored(rows, labels, name):
    marks = {r.doc_id: r[name] for r in labels.collect()}
    return [(r, marks[r.doc_id]) for r in rows if r.doc_id in marks and r.held_out]


@pytest.mark.parametrize("function, name, accuracy, threshold", [
    (toxicity.toxicity_scores, "toxic", 0.97, 0.5), (quality.quality_scores, "quality", 0.97, 0.3)])
def test_held_out_accuracy(table, function, name, accuracy, threshold):
    docs, labels = table("documents", LARGER), table("labels", LARGER)
    rows = function(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    pairs = scored(rows, labels, name)
    assert len(pairs) > 500
    assert np.mean([r.predicted == y for r, y in pairs]) > accuracy
    for y in (0, 1):  # neither class is given up
        assert np.mean([r.predicted == y for r, z in pairs if z == y]) > 0.8


@pytest.mark.parametrize("function, name", [
    (toxicity.toxicity_scores, "toxic"), (quality.quality_scores, "quality")])
def test_scores_of_odd_rows(spark, odd, nothing, function, name):
    labels = spark.createDataFrame(
        [(1, 1, 0, 9), (2, 0, 1, 9), (3, 0, 1, 9), (7, None, None, 9), (None, 1, 1, 9),
         (6, 1, 0, 9), (99, 1, 1, 9), (1, 1, 0, 9)],
        "doc_id long, quality int, toxic int, score long")
    for marks in (labels, labels.limit(0), labels.where(f"{name} = 1")):
        rows = function(odd, marks).collect()
        assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 7, 8]
        assert all(0 <= r.score <= 1 for r in rows)
        same = [r.score for r in rows if r.doc_id == 1]
        assert same[0] == same[1]
        empty = {r.score for r in rows if r.doc_id in (2, 3)}
        assert len(empty) == 1
    assert function(nothing, labels).count() == 0
    assert function(nothing, labels.limit(0)).count() == 0


def test_toxic_documents_go_with_all_their_columns(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.schema == odd.schema and kept.count() == odd.count()
    assert toxicity.drop_toxic(nothing, labels).count() == 0


def test_unseen_misspellings_share_character_vectors():
    rng = np.random.default_rng(1)
    plain = [f"{a}{b}" for a in ("ran", "tol", "mir", "sep", "lud") for b in ("do", "ka", "ni", "os")]
    rude = ["blockhead", "blokhead", "blockheads", "bl0ckhead"]
    texts, marks = [], []
    for n in range(400):
        words = list(rng.choice(plain, 12))
        if n % 4 == 0:
            words[rng.integers(12)] = rng.choice(rude[:3])
        texts.append(" ".join(words))
        marks.append(int(n % 4 == 0))
    weight, bias = toxicity.train(pa.array(texts, pa.large_string()), np.array(marks))
    score = lambda t: toxicity.text_scores(
        toxicity.Bags(*text_buffers(pa.array([t]))), weight, bias)[0]
    assert score("ran" + " tolka mirni BLOCKHEADED sepdo") > 0.5
    assert score("tolka mirni bl0ckhead") > 0.5
    assert score("tolka mirni sepdo ludos ranka") < 0.5
    assert score("") == 0 and score(LONG[:1000]) < 0.5


def plain_grams(word):
    """The bucket of every n-gram of a bordered word, in Python loops."""
    value = [int(v) >> 32 for v in toxicity.stream(3, 256)]
    text = b" " + word + b" "
    for size in toxicity.GRAMS:
        for i in range(len(text) - size + 1):
            code = value[text[i]]
            for k in range(1, size):
                code += value[text[i + k]] * pow(0x01000193, k, 1 << 32)
            code &= 0xFFFFFFFF
            code = (code ^ code >> 15) * 0x9E3779B1 & 0xFFFFFFFF
            yield code >> 32 - toxicity.BUCKET_BITS


def plain_odds(text, weight, bias):
    """The mean odds of the words of a text."""
    words = bytes(toxicity.FOLDED[b] for b in (text or "").encode()).split()
    total = 0.0
    for word in words:
        grams = list(plain_grams(word))
        logit = sum(weight[g] for g in grams) / max(len(grams), 1) + bias
        total += math.exp(min(max(logit, -toxicity.LARGEST), toxicity.LARGEST))
    return total / max(len(words), 1)


TEXTS = ["Rando tolka, mirni!", "", None, "blockhead tolka BLOCKHEAD", "é ñandú 文字 x", "a",
         "mirni mirni sepdo ludos"]


def test_scores_equal_those_of_plain_loops():
    weight = np.random.default_rng(2).normal(0, 2, 1 << toxicity.BUCKET_BITS).astype(np.float32)
    scores = toxicity.text_scores(toxicity.Bags(*text_buffers(pa.array(TEXTS))), weight, -1.5)
    plain = [plain_odds(t, weight.astype(float), -1.5) for t in TEXTS]
    assert np.allclose(scores, [p / (1 + p) for p in plain])
    assert scores[1] == scores[2] == 0


def test_a_training_step_follows_the_slope_of_the_plain_loss():
    texts = [TEXTS[i] for i in (0, 3, 4, 6)]
    toxic = np.array([0, 1, 1, 0])
    params = toxicity.start()
    slopes = toxicity.Sample(pa.array(texts, pa.large_string()), toxic).slopes(params)

    def loss():
        weight = params["vectors"] @ (params["softmax"][:, 1] - params["softmax"][:, 0])
        odds = [plain_odds(t, weight, params["bias"][0]) for t in texts]
        return -np.mean([math.log(p / (1 + p) if y else 1 / (1 + p)) for p, y in zip(odds, toxic)])

    gram = next(plain_grams(b"blockhead"))
    for name, place in (("bias", (0,)), ("softmax", (3, 0)), ("softmax", (3, 1)),
                        ("vectors", (gram, 0)), ("vectors", (gram, 5))):
        at, change = params[name][place], 1e-4
        params[name][place] = at + change
        above = loss()
        params[name][place] = at - change
        below = loss()
        params[name][place] = at
        assert slopes[name][place] == pytest.approx((above - below) / (2 * change), rel=1e-3,
                                                    abs=1e-9)


def test_length_alone_makes_no_text_toxic(spark, table):
    docs, labels = table("documents", LARGER), table("labels", LARGER)
    weight, bias = toxicity.fit(docs, labels)
    mine = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {y: [r.text for r in docs.where("text is not null").collect() if mine.get(r.doc_id) == y
                 and held_out(r.doc_id)] for y in (0, 1)}
    score = lambda t: toxicity.text_scores(
        toxicity.Bags(*text_buffers(pa.array([t], pa.large_string()))), weight, bias)[0]
    words = " ".join(texts[0]).split()
    for size in (20_000, 100_000, 400_000):
        assert score(" ".join((words * (size // len(words) + 1))[:size])) < 0.5
    caught = [t for t in texts[1] if score(t) >= 0.5]
    assert score("\n".join(caught * 200)) >= 0.5


def test_long_texts_are_learned_from_within_the_bound(spark):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in ((1, 10), (2, 60), (3, 10), (4, 9000),
                                                                 (5, 10), (6, 10), (1, 10))],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, toxic int")
    all_rows = toxicity.training_texts(docs, labels, folds=10**9)
    assert sorted(all_rows.column("doc_id").to_pylist()) == [1, 2, 3, 4, 5, 6]
    cut = toxicity.training_texts(docs, labels, folds=10**9, chars=6000)
    sizes = dict(zip(cut.column("doc_id").to_pylist(), map(len, cut.column("text").to_pylist())))
    assert 4 not in sizes and sizes[2] == 300  # whole, or not at all
    small = toxicity.training_texts(docs, labels, folds=10**9, rows=1)
    assert len(small) == 2


def test_the_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(3)
    spread = [np.diag([1.0, 4.0]), np.array([[2.0, 0.9], [0.9, 1.0]])]
    rows = [rng.multivariate_normal(m, s, 20_000) for m, s in zip(([0, 0], [2, 1]), spread)]
    model = quality.Discriminant([(len(r), r.sum(0), r.T @ r) for r in rows], 0.0, 0.0)
    at = rng.normal(0, 2, (50, 2))

    def density(x, m, s):
        d = x - m
        return np.exp(-0.5 * (d @ np.linalg.inv(s) * d).sum(1)) / np.sqrt(np.linalg.det(s))

    one, zero = density(at, [2, 1], spread[1]), density(at, [0, 0], spread[0])
    assert np.abs(model.scores(at) - one / (one + zero)).max() < 0.05


def test_statistics_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["", "A b b b.", None, "x" * 5000, "caps LOCK!!! 12\nline\nline", "ünï 文字"]
    whole = quality.text_statistics(*text_buffers(pa.array(texts)))
    assert whole.shape == (6, len(quality.STATISTICS)) and np.isfinite(whole).all()
    for n, t in enumerate(texts):
        alone = quality.text_statistics(*text_buffers(pa.array([t], pa.string())))
        assert np.allclose(whole[n], alone[0])
