"""Quality classifier: a regularised quadratic discriminant over text statistics.

Every whole text becomes a few transformed statistics. Class means and
covariances are summed in Spark over all labelled rows; each covariance is
shrunk towards the pooled one and its diagonal. The score is the posterior of
label 1 from the Mahalanobis log-density difference, with Cholesky factors
computed once.

Null and empty texts have all statistics at their value for no bytes. Rows with
a null label are not learned from; a repeated row counts each time. Without
labels the score is 0.5, with labels of one class it is that class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import LOWER, NOT_SPACE, Words, pieces, text_buffers

STATISTICS = ("words", "word_length", "length_spread", "upper", "digits", "marks", "stops",
              "other", "wide", "distinct", "most_common", "repeats", "lines", "entropy")
SHRINK_POOLED = 0.1
SHRINK_DIAGONAL = 0.05
SCORE_DIGITS = 9


def _classes() -> np.ndarray:
    """Byte classes, one column each: upper, digit, mark, stop, other sign, wide, line end."""
    table = np.zeros((256, 7))
    for column, members in enumerate((range(0x41, 0x5B), range(0x30, 0x3A), b"!*#$%&@^~|=+_",
                                      b".,;:?", b"\"'()-/<>[]{}\\`", range(0x80, 0x100), b"\n")):
        table[list(members), column] = 1
    return table


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics per text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text_of = np.repeat(np.arange(n), size)
    histogram = np.bincount(text_of * 256 + data, minlength=n * 256).reshape(n, 256)
    per = histogram @ _classes()
    total = np.maximum(size, 1)[:, None]
    share = histogram / total
    entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(1)
    words = Words(data, offsets, NOT_SPACE)
    count = np.maximum(words.counts, 1)
    length = (words.ends - words.starts).astype(float)
    of_word = np.repeat(np.arange(n), words.counts)
    mean = np.bincount(of_word, length, n) / count
    spread = np.sqrt(np.maximum(np.bincount(of_word, length ** 2, n) / count - mean ** 2, 0))
    hashes = words.hashes(LOWER)
    same = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    repeats = np.bincount(of_word[1:][same], minlength=n) / count
    key = np.sort((of_word.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else \
        np.empty(0, np.int64)
    runs = np.diff(np.append(head, len(key)))
    owner = (key[head] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    common = np.zeros(n)
    np.maximum.at(common, owner, runs)
    rate = np.log((per[:, :6] + 0.5) / (total + 20))
    return np.column_stack([
        np.log1p(words.counts), np.log1p(mean), np.log1p(spread), rate,
        np.log((distinct + 1) / (count + 1)) / np.log(count + 3),
        np.log((common + 0.5) / (count + 1)), np.log(repeats + 0.002),
        np.log((per[:, 6] + 0.5) / (count + 5)), entropy])


def _measure(batches):
    for piece in pieces(batches):
        table = text_statistics(*text_buffers(piece.column("text")))
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id").cast(pa.int64()),
             *(pa.array(c) for c in table.T)], ["doc_id", *STATISTICS])


def measure(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(
        _measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


class Discriminant:
    """Two Gaussian classes; log-density difference by cached Cholesky factors."""

    def __init__(self, classes, pooled=SHRINK_POOLED, diagonal=SHRINK_DIAGONAL):
        """classes: (count, sums, sums of products) of label 0 and of label 1."""
        self.counts = [c[0] for c in classes]
        if not all(self.counts):
            return
        means = [c[1] / c[0] for c in classes]
        spreads = [c[2] / c[0] - np.outer(m, m) for c, m in zip(classes, means)]
        both = sum(c * s for c, s in zip(self.counts, spreads)) / sum(self.counts)
        self.parts = []
        for count, m, own in zip(self.counts, means, spreads):
            weight = min(1.0, pooled + len(m) / (count + len(m)))
            cov = (1 - weight) * own + weight * both
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov))
            cov += 1e-6 * np.eye(len(m))
            root = np.linalg.cholesky(cov)
            self.parts.append((m, np.linalg.inv(root), 2 * np.log(np.diag(root)).sum(),
                               np.log(count / sum(self.counts))))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not all(self.counts):
            return np.full(len(rows), 0.5 if not any(self.counts) else float(self.counts[1] > 0))
        density = [prior - 0.5 * (log_det + (((rows - m) @ root.T) ** 2).sum(1))
                   for m, root, log_det, prior in self.parts]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality",
        folds: int = 5) -> Discriminant:
    """Class moments over every labelled row outside the held-out fold, summed by Spark."""
    k = len(STATISTICS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = (measured.join(labels.select("doc_id", F.col(label).alias("_y")), "doc_id")
            .where(F.col("_y").isin(0, 1) & ~is_held_out(F.col("doc_id"), folds))
            .groupBy("_y").agg(
                F.count(F.lit(1)).alias("n"),
                F.array(*[F.sum(s) for s in STATISTICS]).alias("sums"),
                F.array(*[F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j]))
                          for i, j in pairs]).alias("products")).collect())
    classes = []
    for y in (0, 1):
        row = next((r for r in rows if r["_y"] == y), None)
        products = np.zeros((k, k))
        if row:
            for (i, j), v in zip(pairs, row["products"]):
                products[i, j] = products[j, i] = float(f"{v:.13g}")
        classes.append((row["n"] if row else 0,
                        np.array([float(f"{v:.13g}") for v in row["sums"]] if row else [0.0] * k),
                        products))
    return Discriminant(classes)


def _score(model):
    def score(batches):
        for batch in batches:
            rows = np.column_stack([np.asarray(batch.column(s)) for s in STATISTICS])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.round(model.scores(rows), SCORE_DIGITS))],
                ["doc_id", "score"])
    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
                   folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, for every document."""
    measured = materialize(measure(docs), "quality-statistics")
    model = fit(measured, labels, folds=folds)
    return (measured.mapInArrow(_score(model), "doc_id long, score double")
            .select("doc_id", F.coalesce(is_held_out(F.col("doc_id"), folds), F.lit(False))
                    .alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
