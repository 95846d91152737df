"""Phrase collocations: counts from a multikey quicksort of routed suffix pointers.

A text's lower-cased pieces are word sequences; the suffix at each word is read to
``longest`` words. Words stand for their 64-bit codes, in which the language is
mixed; that no two words share a code is checked over the whole dictionary, and
another seed is taken if two do.

Suffixes are summed where they are read and routed by their leading word to
buckets. A word that holds a large share of all words is *hot*; behind it the next
word takes part in the routing, and so on, so no bucket gathers a hot word or a hot
pair. A bucket's suffix pointers are sorted by a three-way multikey quicksort: the
size of an equal partition is the count of its phrase, and a partition whose whole
size is below ``least`` is abandoned, whatever it would still be split into. Phrases
of hot words alone that are shorter than ``longest`` are spread over buckets; the
readers count them apart, as suffixes cut there.

Null texts are empty, null languages are ``und``. Rows count as often as they
stand, also with equal or null ids; other columns are not read. Tables without
words give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .words import LOWER, U64, Words, mix, pieces, ranges, text_buffers

LONGEST = 3
LEAST = 10
COVERED = 50  # percent of a phrase that one longer candidate takes with it
TOP = 2000
CHUNK_BYTES = 4 << 20
BUCKET_WORDS = 512 * 1024
MOST_HOT = 65_536  # a word is hot from this share of all words at the least: so many words
SALTS = 64
UNKNOWN = "und"

CUTS = np.zeros(256, bool)
CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
LETTERS = ~CUTS
LETTERS[[0x20, 0x09]] = False


class CodedWords:
    """The words of some texts with their codes, and which follow on in one piece."""

    def __init__(self, batch, seed: int):
        data, offsets = text_buffers(batch.column("text"))
        self.words = words = Words(data, offsets, LETTERS)
        langs = pc.fill_null(batch.column("lang").cast(pa.string()), UNKNOWN).dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = np.repeat(langs.indices.to_numpy(), words.counts)
        salt = [hashlib.blake2b(f"{seed} {x}".encode(), digest_size=8).digest() for x in self.langs]
        salt = np.frombuffer(b"".join(salt), U64)
        # zero stands for the end of a piece
        self.codes = np.maximum(mix(words.hashes(LOWER) + salt[self.lang]), U64(1))
        ahead = np.zeros(len(data) + 1, np.int32)
        np.cumsum(CUTS[data], out=ahead[1:])
        here = ahead[words.starts]
        self.follows = here[1:] == here[:-1]
        self.follows[words.first[1:-1][(words.first[1:-1] > 0)
                                       & (words.first[1:-1] < len(words))] - 1] = False

    def suffixes(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, rows): suffixes of two words and more, a row per word, as places in codes.

        The first code, 0, is the end of a piece.
        """
        codes, place = np.unique(self.codes, return_inverse=True)
        place = (place + 1).astype(np.int32)
        n = len(place)
        rows = np.zeros((longest, n), np.int32)
        rows[0] = place
        on = np.ones(n, bool)
        for d in range(1, longest):
            on[max(n - d, 0):] = False
            on[:max(n - d, 0)] &= self.follows[d - 1:]
            at = np.flatnonzero(on)
            rows[d, at] = place[at + d]
        return np.concatenate([np.zeros(1, U64), codes]), rows[:, rows[1] > 0]


def _spellings(seed):
    """(lang, word, code, n): the words of a chunk, each once."""
    def run(batches):
        for chunk in pieces(batches, limit=CHUNK_BYTES):
            coded = CodedWords(chunk, seed)
            codes, first, count = np.unique(coded.codes, return_index=True, return_counts=True)
            lo, hi = coded.words.starts[first], coded.words.ends[first]
            text = LOWER[coded.words.data[ranges(lo, hi - lo)]]
            ends = np.concatenate([[0], np.cumsum(hi - lo)])
            words = pa.Array.from_buffers(
                pa.large_string(), len(codes),
                [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)])
            langs = pa.array(coded.langs, pa.string()).take(pa.array(coded.lang[first]))
            yield pa.RecordBatch.from_arrays(
                [langs, words.cast(pa.string()), pa.array(codes.view(np.int64)),
                 pa.array(count)], ["lang", "word", "code", "n"])
    return run


def dictionary(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, code, f) of all words."""
    rows = docs.select("lang", "text").mapInArrow(
        _spellings(seed), "lang string, word string, code long, n long")
    return rows.groupBy("lang", "word", "code").agg(F.sum("n").alias("f"))


def summed(suffixes: np.ndarray, words: int, weight=None) -> tuple[np.ndarray, np.ndarray]:
    """(first column, weight) of each different suffix; entries are below ``words``."""
    key, size = suffixes[0].astype(np.int64), words
    for row in suffixes[1:]:
        if size * words >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max(initial=0)) + 1
        key, size = key * words + row, size * words
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return first, np.bincount(inverse, weight, len(first)).astype(np.int64)


def _route(seed, longest, buckets, hot):
    """Rows of (bucket, cut, codes, index, weights): the suffixes of a chunk by bucket.

    ``index`` has ``longest`` places in ``codes`` for each suffix. ``cut`` is 0, or the
    length at which suffixes of hot words alone end.
    """
    hot = np.array(sorted(hot), U64)
    schema = pa.schema([("bucket", pa.int64()), ("cut", pa.int32()), ("codes", pa.binary()),
                        ("index", pa.binary()), ("weights", pa.binary())])

    def packed(codes, rows, weight, route, cut):
        bucket = (mix(route) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        place = np.zeros(len(codes), np.int64)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            part = order[lo:hi]
            own = rows[:, part]
            place[own] = 1
            used = np.flatnonzero(place)
            place[used] = np.arange(len(used))
            index = place[own].astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
            place[used] = 0
            yield {"bucket": int(bucket[part[0]]), "cut": cut, "codes": codes[used].tobytes(),
                   "index": index.tobytes(),
                   "weights": weight[part].astype(np.uint32).tobytes()}

    def run(batches):
        for chunk in pieces(batches, limit=CHUNK_BYTES):
            codes, rows = CodedWords(chunk, seed).suffixes(longest)
            first, weight = summed(rows, len(codes))
            rows = rows[:, first]
            is_hot = np.isin(codes, hot)
            route, alone = mix(codes[rows[0]]), is_hot[rows[0]]
            out = []
            for d in range(1, longest):
                if d > 1 and alone.any():
                    own = np.where(np.arange(longest)[:, None] < d, rows[:, alone], 0)
                    one, total = summed(own, len(codes), weight[alone])
                    out.extend(packed(codes, own[:, one], total, route[alone][one], d))
                route = np.where(alone, mix(route + codes[rows[d]]), route)
                alone = alone & is_hot[rows[d]]
            out.extend(packed(codes, rows, weight, route, 0))
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def equal_partitions(codes: np.ndarray, weights: np.ndarray, least: int):
    """(depth, suffix, weight) of each equal partition of ``least`` or more.

    A three-way multikey quicksort of pointers to the columns of ``codes``. The
    partitions of a round are split at the same time, each by the middle of three
    of its keys drawn at random; those lighter than ``least`` are not kept.
    """
    longest, n = codes.shape
    chance = np.random.default_rng(n)
    order = np.arange(n)
    starts, depth = np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)
    while len(order):
        size = np.diff(starts, append=len(order))
        part = np.repeat(np.arange(len(starts)), size)
        key = codes[depth[part], order]
        a, b, c = (key[starts + (chance.random(len(size)) * size).astype(np.int64)]
                   for _ in range(3))
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        own = pivot[part]
        side = (key >= own).astype(np.int8) + (key > own)
        slot = 3 * part + side
        total = np.bincount(slot, weights[order], 3 * len(starts))
        equal = np.tile([False, True, False], len(starts))
        deeper = np.repeat(depth, 3) + equal
        kept = (total >= least) & ~(equal & (np.repeat(pivot, 3) == 0))
        found = np.flatnonzero(kept & equal)
        if len(found):
            hit = np.flatnonzero(side == 1)
            at = hit[np.searchsorted(part[hit], found // 3)]
            yield deeper[found], order[at], total[found].astype(np.int64)
        active = kept & (deeper < longest)
        live = active[slot]
        order, side, slot = order[live], side[live], slot[live]
        count = np.bincount(slot, minlength=len(active))
        first = np.cumsum(count) - count
        moved = np.empty_like(order)
        for s in range(3):
            own = order[side == s]
            moved[ranges(first[s::3], count[s::3])] = own
        order = moved
        starts, depth = first[active], deeper[active]
        some = count[active] > 0
        starts, depth = starts[some], depth[some]


def _count(longest, least, hot):
    """(depth, c0, c1, ..., f) of the frequent phrases of each bucket."""
    hot = np.array(sorted(hot), U64)

    def rows(held):
        codes, weights, cut = [], [], []
        for known, index, weight, at in held:
            known, weight = np.frombuffer(known, U64), np.frombuffer(weight, np.uint32)
            small = np.uint16 if len(known) <= 1 << 16 else np.uint32
            codes.append(known[np.frombuffer(index, small).reshape(longest, -1)])
            weights.append(weight)
            cut.append(np.full(len(weight), at))
        codes, weights = np.concatenate(codes, axis=1), np.concatenate(weights).astype(np.float64)
        cut = np.concatenate(cut)
        for end in np.unique(cut).tolist():
            own, w = codes[:end or longest, cut == end], weights[cut == end]
            for depth, at, total in equal_partitions(own, w, least):
                phrase = own[:, at]
                phrase[np.arange(len(own))[:, None] >= depth] = 0
                if end:
                    good = depth == end
                else:  # phrases of hot words alone are counted by the suffixes cut there
                    good = (depth == longest) | ((depth > 1) & ~(
                        np.isin(phrase, hot) | (phrase == 0)).all(axis=0))
                n = int(good.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(depth[good], pa.int32()),
                     *(pa.array(phrase[d, good].view(np.int64) if d < len(own)
                                else np.zeros(n, np.int64)) for d in range(longest)),
                     pa.array(total[good])],
                    ["depth", *(f"c{d}" for d in range(longest)), "f"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in
                                      ("bucket", "codes", "index", "weights", "cut"))):
                if held and bucket != now:
                    yield from rows(held)
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield from rows(held)
    return run


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple:
    """(words, totals, phrases): the dictionary, n by language, counts of ``least`` and more.

    words: lang, word, code, f; totals: lang, n; phrases: depth, c0, c1, ..., f.
    """
    seed = 0
    while True:
        words = stage(dictionary(docs, seed), "collocation-words")
        if words.groupBy("code").count().where("count > 1").isEmpty():
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.agg(F.sum("f")).first()[0] or 0
    buckets = max(total // BUCKET_WORDS, 1)
    share = max(total // min(4 * buckets, MOST_HOT), least)
    hot = [r["code"] % (1 << 64) for r in words.where(F.col("f") > share).select("code").collect()]
    routed = docs.select("lang", "text").mapInArrow(
        _route(seed, longest, buckets, hot),
        "bucket long, cut int, codes binary, index binary, weights binary")
    columns = ", ".join(f"c{d} long" for d in range(longest))
    counted = stage(routed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _count(longest, least, hot), f"depth int, {columns}, f long"), "collocation-phrases")
    return words.where(F.col("f") >= least), totals, counted


def _cut_scores(length: int, by_length: dict[int, DataFrame]) -> DataFrame:
    """Phrases of a length with their lowest-scoring cut: ..., a, l, r, score."""
    own = [f"c{d}" for d in range(length)]
    rows = by_length[length].withColumnRenamed("f", "a")
    exact = "cast({} as decimal(16,0))"
    cuts = []
    for k in range(1, length):
        for side, columns in (("l", own[:k]), ("r", own[k:])):
            part = by_length[len(columns)]
            part = part.select(*(F.col(f"c{d}").alias(c) for d, c in enumerate(columns)),
                               F.col("f").alias(f"{side}{k}"))
            rows = rows.join(part, columns)
        score = F.expr(f"({exact.format('a')} * {exact.format('a')} * 1000000bd) div "
                       f"({exact.format(f'l{k}')} * {exact.format(f'r{k}')})")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"),
                             F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    return (rows.withColumn("cut", F.array_min(F.array(*cuts)))
            .select(*own, "a", "cut.l", "cut.r", "cut.score"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST,
                 covered: int = COVERED, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words that occurs ``least`` times is a candidate. It
    is dropped where a longer one that holds it has ``covered`` percent of its count.
    Order: score, then count, both descending, then the phrase's bytes.
    """
    words, totals, counted = phrase_counts(docs, longest, least)
    by_length = {1: words.select(F.col("code").alias("c0"), "f")}
    for n in range(2, longest + 1):
        by_length[n] = counted.where(F.col("depth") == n).select(
            *(f"c{d}" for d in range(n)), "f")
    found = None
    for n in range(2, longest + 1):
        own = [f"c{d}" for d in range(n)]
        rows = _cut_scores(n, by_length)
        for m in range(n + 1, longest + 1):
            inside = by_length[m].select("f", F.explode(F.array(*(
                F.struct(*(F.col(f"c{i + d}").alias(f"c{d}") for d in range(n)))
                for i in range(m - n + 1)))).alias("e"))
            inside = inside.groupBy(*(F.col(f"e.{c}").alias(c) for c in own)).agg(
                F.max("f").alias("longer"))
            rows = rows.join(inside, own, "left").where(
                F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True))).drop("longer")
        for d, c in enumerate(own):
            rows = rows.join(words.select(F.col("code").alias(c), F.col("word").alias(f"w{d}"),
                                          F.col("lang").alias(f"lang{d}")), c)
        rows = rows.select(F.col("lang0").alias("lang"),
                           F.concat_ws(" ", *(f"w{d}" for d in range(n))).alias("phrase"),
                           "a", "l", "r", "score")
        found = rows if found is None else found.union(rows)
    found = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for keys in (["lang", "salt"], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(
            Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return found.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
