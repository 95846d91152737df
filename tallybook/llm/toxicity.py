"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, borders included, embedded as the
mean of their vectors and put into a two-class softmax. A text is the average of
its words, taken of their odds: p / (1 - p) = mean over words of p(word) / (1 -
p(word)). A mean of vectors loses one toxic word among a hundred others; the mean
of odds does not, and like it does not grow with the length of a text. Vectors
and softmax are trained jointly in numpy on the text labels, and misspellings
never seen share the n-gram vectors of those seen. For scoring, vectors and
softmax fold into one number per n-gram.

The model is fitted on a bounded sample of whole texts outside the held-out fold:
of each class the first in an order by a hash of the id, up to ``SAMPLE_ROWS``
rows and ``SAMPLE_CHARS`` characters together; a text over a twentieth of that
is not learned from. Every whole text is scored. Null and empty texts have no
words and score 0. Rows with a null label are not learned from; without texts of
both classes every score is 0, or 1 if all are toxic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import ALNUM, LOWER, mix, pieces, ranges, stream, text_buffers

SAMPLE_ROWS = 2500
SAMPLE_CHARS = 6_000_000
GRAMS = (3, 4, 5)
BUCKET_BITS = 18
DIMENSIONS = 8
ROUNDS = 60
RATE = 0.05
DECAY = 1e-4
START_BIAS = -4.0
LARGEST = 8.0  # of the logit of a word, so that a single one turns no text of 3,000
SCORE_DIGITS = 9

FOLDED = np.where(ALNUM, LOWER, 0x20).astype(np.uint8)


class Bags:
    """Words with one border sign around each, and the n-gram buckets of every position."""

    def __init__(self, data, offsets):
        n = len(offsets) - 1
        size = np.diff(offsets)
        self.text = np.full(len(data) + n + 1, 0x20, np.uint8)
        self.text[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), size)] = FOLDED[data]
        change = np.flatnonzero(np.diff(self.text != 0x20))
        self.starts, self.ends = change[::2] + 1, change[1::2] + 1
        self.first = np.searchsorted(self.starts, offsets + np.arange(n + 1))
        self.n = n

    def buckets(self):
        """For each n-gram size, the bucket of the n-gram that begins at each position."""
        value = (stream(3, 256) >> np.uint64(32)).astype(np.uint32)[self.text]
        total, factor = value.copy(), np.uint32(1)
        for size in range(2, max(GRAMS) + 1):
            if len(value) < size:
                total = total[:0]
            else:
                factor = np.uint32(int(factor) * 0x01000193 & 0xFFFFFFFF)
                total = total[:len(value) - size + 1] + value[size - 1:] * factor
            if size in GRAMS:
                code = (total ^ (total >> np.uint32(15))) * np.uint32(0x9E3779B1)
                yield size, code >> np.uint32(32 - BUCKET_BITS)

    def counts(self, size):
        return np.maximum(self.ends - self.starts + 3 - size, 0)


def word_weights(bags: Bags, weight: np.ndarray) -> np.ndarray:
    """The mean weight of each word's n-grams, from running sums over the text."""
    total = np.zeros(len(bags.starts))
    count = np.zeros(len(bags.starts), np.int64)
    for size, bucket in bags.buckets():
        running = np.zeros(len(bucket) + 1)
        np.cumsum(weight[bucket], out=running[1:])
        own = bags.counts(size)
        lo = np.minimum(bags.starts - 1, len(bucket))
        total += np.where(own > 0, running[np.minimum(lo + own, len(bucket))] - running[lo], 0)
        count += own
    return total / np.maximum(count, 1)


def odds(logit: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(logit, -LARGEST, LARGEST))


def text_scores(bags: Bags, weight: np.ndarray, bias: float) -> np.ndarray:
    """The mean odds of the words of each text, as a probability; 0 without words."""
    total = np.concatenate([[0], np.cumsum(odds(word_weights(bags, weight) + bias))])
    words = np.diff(bags.first)
    mean = (total[bags.first[1:]] - total[bags.first[:-1]]) / np.maximum(words, 1)
    return mean / (1 + mean)


class Sample:
    """Labelled texts as counts of spellings, and each spelling once as its n-grams."""

    def __init__(self, texts: pa.Array, toxic: np.ndarray):
        bags = Bags(*text_buffers(texts))
        word_of, words = _distinct_words(bags)
        self.toxic, self.n_texts, self.n_words = toxic, bags.n, len(words)
        owner = np.repeat(np.arange(bags.n), np.diff(bags.first))
        pair, times = np.unique(owner * (len(words) + 1) + word_of, return_counts=True)
        self.text = (pair // (len(words) + 1)).astype(np.int32)
        self.word = (pair % (len(words) + 1)).astype(np.int32)
        self.part = times / np.maximum(np.diff(bags.first), 1)[self.text]  # of its text
        size = (bags.ends - bags.starts)[words]
        own = Bags(bags.text[ranges(bags.starts[words], size)],
                   np.concatenate([[0], np.cumsum(size)]))
        self.grams = []  # of each size, the buckets and the words they belong to
        for size, bucket in own.buckets():
            count = own.counts(size)
            self.grams.append((bucket[ranges(own.starts - 1, count)].astype(np.int32),
                               np.repeat(np.arange(self.n_words, dtype=np.int32), count)))
        n_grams = sum(np.bincount(of, minlength=self.n_words) for _, of in self.grams)
        self.share = 1 / np.maximum(n_grams, 1)

    def forward(self, params):
        """The odds of each spelling, and their mean in each text."""
        weight = params["vectors"] @ (params["softmax"][:, 1] - params["softmax"][:, 0])
        by_word = sum(np.bincount(of, weight[gram], self.n_words) for gram, of in self.grams)
        by_word = odds(by_word * self.share + params["bias"][0])
        return by_word, np.bincount(self.text, self.part * by_word[self.word], self.n_texts)

    def slopes(self, params) -> dict:
        """Of the mean cross-entropy by vectors, softmax and bias."""
        by_word, mean = self.forward(params)
        pull = (mean / (1 + mean) - self.toxic) / max(self.n_texts, 1) / np.maximum(mean, 1e-300)
        slope = by_word * np.bincount(self.word, pull[self.text] * self.part, self.n_words)
        by_word = slope * self.share
        by_gram = sum(np.bincount(gram, by_word[of], 1 << BUCKET_BITS) for gram, of in self.grams)
        turn = params["vectors"].T @ by_gram
        direction = params["softmax"][:, 1] - params["softmax"][:, 0]
        return {"vectors": by_gram[:, None] * direction,
                "softmax": np.column_stack([-turn, turn]), "bias": slope.sum(keepdims=True)}


def start(seed: int = 5) -> dict:
    random = np.random.default_rng(seed)
    return {"vectors": random.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)),
            "softmax": random.normal(0, 1, (DIMENSIONS, 2)), "bias": np.array([START_BIAS])}


def train(texts: pa.Array, toxic: np.ndarray, rounds: int = ROUNDS, seed: int = 5):
    """(weight per n-gram bucket, bias) of the folded model."""
    sample, params = Sample(texts, toxic), start(seed)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    for step in range(1, rounds + 1):
        slopes = sample.slopes(params)
        slopes["vectors"] += DECAY * params["vectors"]
        for name, g in slopes.items():
            first, second = state[name]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            params[name] -= (RATE * (first / (1 - 0.9 ** step))
                             / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-10))
    direction = params["softmax"][:, 1] - params["softmax"][:, 0]
    return (params["vectors"] @ direction).astype(np.float32), float(params["bias"][0])


def _distinct_words(bags: Bags):
    """For each word the number of its spelling, and one place of each spelling."""
    value = stream(9, 256)
    base = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    code = np.zeros(len(bags.starts), np.uint64)
    size = bags.ends - bags.starts
    for i in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > i)
        code[live] = mix(code[live] + value[bags.text[bags.starts[live] + i]] * base[i % 64])
    _, place, number = np.unique(code, return_index=True, return_inverse=True)
    return number, place


def training_texts(docs: DataFrame, labels: DataFrame, folds: int = 5,
                   rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS):
    """The bounded sample: whole texts and labels, chosen by a hash of the id."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
                          & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0))
    chosen = [usable.where(F.col("toxic") == y).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        for y in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * rows short rows
    texts = docs.select("doc_id", "text").where(F.length("text") <= chars // 20).join(ids, "doc_id")
    place = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    sizes = texts.select("doc_id", "toxic", F.xxhash64("text").alias("text_hash"),
                         F.length("text").alias("size"))
    in_order = Window.partitionBy("toxic").orderBy(
        F.xxhash64("doc_id"), "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    fitting = (sizes.groupBy("doc_id", "toxic", "text_hash").agg(F.max("size").alias("size"))
               .withColumn("total", F.sum("size").over(in_order))
               .where(F.col("total") <= chars).select("doc_id", "toxic", "text_hash"))
    return (texts.dropDuplicates(["doc_id", "text"])
            .withColumn("text_hash", F.xxhash64("text"))
            .join(F.broadcast(fitting), ["doc_id", "toxic", "text_hash"])
            .orderBy(*place).limit(2 * rows).select("doc_id", "text", "toxic").toArrow())


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5):
    table = training_texts(docs, labels, folds).combine_chunks()
    toxic = np.asarray(table.column("toxic").combine_chunks())
    if not len(toxic) or toxic.min() == toxic.max():
        return np.zeros(1 << BUCKET_BITS, np.float32), 50.0 if len(toxic) and toxic[0] else -50.0
    return train(table.column("text").combine_chunks(), toxic)


def _score(shared):
    def score(batches):
        weight, bias = shared.value
        for piece in pieces(batches):
            scores = text_scores(Bags(*text_buffers(piece.column("text"))), weight, bias)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()),
                 pa.array(np.round(scores, SCORE_DIGITS))], ["doc_id", "score"])
    return score


def _calm(shared, threshold):
    def calm(batches):
        weight, bias = shared.value
        for piece in pieces(batches):
            scores = text_scores(Bags(*text_buffers(piece.column("text"))), weight, bias)
            yield piece.filter(pa.array(scores < threshold))
    return calm


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5,
                    folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, for every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0
    return (docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")
            .select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5,
               folds: int = 5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds))
    return docs.mapInArrow(_calm(model, threshold), docs.schema)
