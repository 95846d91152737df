"""Token-ID binary output: tokenized documents in id order, range coded in frames.

Ids of documents go to ranges of ids of about equal row counts; each range is a
shard. A shard's documents follow each other in order and are cut, between
documents, into frames of about ``FRAME_IDS`` ids. A frame stands alone: its
document table, and its ids in independently reset, checksummed blocks (see
``idcoder``). Frames are written as a Parquet table by Spark, so a lost executor
or a repeated task leaves no half-written file; ``frame_bytes`` gives each as the
bytes of a file of its own.

Null texts are empty and have only the end id. Rows without an id come first.
Rows of one id are ordered by their ids' bytes. Where the rows have a training
position, the document tables carry it, and equal rows are ordered by it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .idcoder import decode_frame, encode_frame
from .words import LOWER, NOT_SPACE, Words, pieces, ranges, text_buffers

END_ID = 2
FRAME_IDS = 8 << 20
SHARD_ROWS = 4096
MAX_SHARDS = 20_000
CACHE_WORDS = 3_000_000  # of a Python worker, about 16 bytes each and 2 for each id
CACHE_IDS = 1 << 24
TOKEN_PIECE = 1 << 20  # text bytes at a time: what one word passes through stays in the cache

TOKENS = "shard int, doc_id long, ids binary"
FRAMES = ("shard int, frame int, n_ids long, doc_ids array<long>, doc_sizes array<long>, "
          "data binary")
READ = "shard int, frame int, doc_id long, at long, n_tokens long, ids_crc32 long"


# Signs that may be parted from a letter or digit before them.
TRAIL = np.zeros(256, bool)
TRAIL[list(b".,;:!?*#$%&")] = True
PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


# Byte-level tokenizers write a byte as this sign; a space parts words here.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = np.arange(256, dtype="<u4")
BYTE_SIGNS[[b for b in range(256) if b not in SHOWN]] = range(256, 512 - len(SHOWN))
BYTE_SIGNS[0x20] = 0x20

# In words of letters below U+0100 alone, no byte may be one of these.
NO_LATIN = np.ones(256, bool)
NO_LATIN[[0x20, *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC2, 0xC3]] = False


class Spans:
    """A hash table of codes with open places, searched and filled many codes at a time.

    What it holds for a code is a span of an array: its start times 2 ** 32 and its length.
    """

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.codes = np.zeros(1 << bits, np.uint64)  # no code is 0
        self.spans = np.zeros(1 << bits, np.int64)

    def home(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(span of each code, which codes are not here); those have no span yet."""
        at = self.home(codes)
        spans, held = self.spans.take(at), self.codes.take(at)
        rest, missing = np.flatnonzero(held != codes), []
        at, held, codes = at[rest], held[rest], codes[rest]
        while len(rest):
            here = held == codes
            spans[rest[here]] = self.spans.take(at[here])
            missing.append(rest[held == 0])
            on = np.flatnonzero(~here & (held != 0))
            rest, codes, at = rest[on], codes[on], at[on] + 1 & len(self.codes) - 1
            held = self.codes.take(at)
        return spans, np.concatenate(missing) if missing else rest

    def add(self, codes: np.ndarray, spans: np.ndarray):
        """Codes that differ from each other and are not here."""
        self.used += len(codes)
        if 4 * self.used > 3 * len(self.codes):
            old = np.flatnonzero(self.codes)
            # those known first are the frequent ones, and get their places last, for good
            old = old[np.argsort(-self.spans[old])]
            more = Spans((self.used * 4 // 3).bit_length())
            more.add(self.codes[old], self.spans[old])
            self.bits, self.codes, self.spans = more.bits, more.codes, more.spans
        at = self.home(codes)
        while len(codes):
            free = self.codes.take(at) == 0
            self.codes[at[free]] = codes[free]  # of several, the last stays
            here = self.codes.take(at) == codes
            self.spans[at[here]] = spans[here]
            on = np.flatnonzero(~here)
            codes, spans, at = codes[on], spans[on], at[on] + 1 & len(self.codes) - 1


class WordTokenizer:
    """Whole texts to ids, each spelling encoded once for many texts.

    Where the tokenizer drops white space, ignores ASCII case and parts letters
    from signs, the ids of a text are those of its words one after the other,
    and those of a word are those of its stem and of the signs that trail it.
    ``by_word`` probes that; for other tokenizers whole texts are encoded.
    Spellings of letters below U+0100 alone go to the tokenizer's model, in lower
    case and with signs for bytes, where ``by_model`` finds that nothing else is
    done to them. Others of letters alone are encoded many in one text, and parted
    where a token ends a word. ``known`` has where in ``ids`` the ids of a spelling
    are; both start anew once they hold ``CACHE_WORDS`` or ``CACHE_IDS``.
    """

    TOGETHER = 2000

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = self.parts_words()
        self.by_model = self.models_words()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.known, self.n_ids = Spans(), 0
        self.ids = np.empty(1 << 16, np.uint16 if len(self.ends) <= 1 << 16 else np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts_words(self) -> bool:
        probe = "Don't  STOP, it\n\t's 12. \u00e9t\u00e9!? <|x|> a\u0301 b***"
        parts = "don't stop , it 's 12 . \u00e9t\u00e9 !? <|x|> a\u0301 b ***".split()
        return self.encode([probe])[0] == [i for p in self.encode(parts) for i in p]

    def models_words(self) -> bool:
        probe = ["Don", "stop", "s", "T", "unBelievableness", "zxqjv", "ll", "ofonstndble",
                 "internationalization" * 3]
        latin = "".join(c for c in map(chr, range(0x80, 0x100)) if c.isalpha())
        probe += [*latin, latin, "Stra\u00dfe", "\u00c9l\u00e8ve", "d\u00e9j\u00e0"]
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        rows = self.encode(probe)
        simple, text = self.latin(Words(*text_buffers(pa.array([" ".join(probe)]))))
        return not any(t.isalpha() for t in added) and simple.all() and self.model_ids(text) == (
            [i for r in rows for i in r], [len(r) for r in rows])

    def model_ids(self, text: np.ndarray) -> tuple[list[int], list[int]]:
        """(ids of all words, number of ids of each): lower-case bytes, a space after each word."""
        shown = BYTE_SIGNS[text].tobytes().decode("utf-32-le")
        size, tokenize = [], self.model.tokenize

        def tokens(word):
            found = tokenize(word)
            size.append(len(found))
            return found

        return [t.id for word in shown.split(" ")[:-1] for t in tokens(word)], size

    @staticmethod
    def latin(words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(which words are of letters below U+0100 alone, those as ``model_ids`` takes them)."""
        length = words.ends - words.starts
        first = np.cumsum(length + 1) - length - 1
        text = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
        text[ranges(first, length)] = words.data[ranges(words.starts, length)]
        bad = NO_LATIN[text]
        # U+0080 to U+00BF follow a byte C2, U+00C0 to U+00FF a byte C3.
        lead = np.flatnonzero(text == 0xC2)
        bad[lead] = ~np.isin(text[lead + 1], (0xAA, 0xB5, 0xBA))
        lead = np.flatnonzero(text == 0xC3)
        after = text[lead + 1]
        bad[lead] = (after == 0x97) | (after == 0xB7)
        text = LOWER[text]
        text[lead + 1] += (after <= 0x9E).astype(np.uint8) << 5
        simple = ~np.logical_or.reduceat(bad, first)
        return simple, text[np.repeat(simple, length + 1)]

    def spellings(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        ids, size = [], np.zeros(len(words), np.int64)
        simple, text = self.latin(words)
        if not self.by_model:
            simple[:] = False
        rest = np.flatnonzero(~simple)
        simple = np.flatnonzero(simple)
        if len(simple):
            row, size[simple] = self.model_ids(text)
            ids.append((simple, np.array(row, np.int32)))
        spelled = {i: words.data[a:b].tobytes().decode() for i, a, b in zip(
            rest.tolist(), words.starts[rest].tolist(), words.ends[rest].tolist())}
        plain = [i for i, w in spelled.items() if w.isalpha()]
        other = [i for i, w in spelled.items() if not w.isalpha()]
        for lo in range(0, len(plain), self.TOGETHER):
            part = plain[lo:lo + self.TOGETHER]
            row = np.array(self.encode([" ".join([spelled[i] for i in part])])[0], np.int32)
            stops = np.flatnonzero(self.ends[row]) + 1
            if len(stops) != len(part) or (len(row) and stops[-1] != len(row)):
                other.extend(part)
                continue
            size[part] = np.diff(stops, prepend=0)
            ids.append((part, row))
        if other:
            rows = self.encode([spelled[i] for i in other])
            size[other] = [len(r) for r in rows]
            ids.append((other, np.array([i for r in rows for i in r], np.int32)))
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        for part, row in ids:
            out[ranges(first[part], size[part])] = row
        return out, size

    def learn(self, codes: np.ndarray, words: Words) -> np.ndarray:
        """Spans of the ids of words whose codes are not known yet."""
        ids, size = self.spellings(words)
        end = self.n_ids + len(ids)
        if end > len(self.ids):
            grown = np.empty(max(end, 2 * len(self.ids)), self.ids.dtype)
            grown[:self.n_ids] = self.ids[:self.n_ids]
            self.ids = grown
        self.ids[self.n_ids:end] = ids
        spans = (self.n_ids + np.cumsum(size) - size) << 32 | size
        self.n_ids = end
        self.known.add(codes, spans)
        return spans

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text), without end ids."""
        if not self.by_word:
            rows = self.encode(pc.fill_null(column, "").to_pylist())
            first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            return np.array([i for r in rows for i in r], np.int64), first
        words = Words(*text_buffers(column), NOT_SPACE)
        data = words.data
        # Where signs trail a plain letter or digit, they are a word of their own.
        stem = words.ends.copy()
        signs = np.flatnonzero(TRAIL[data[stem - 1]])
        while len(signs):
            stem[signs] -= 1
            signs = signs[stem[signs] > words.starts[signs]]
            signs = signs[TRAIL[data[stem[signs] - 1]]]
        split = (stem > words.starts) & (stem < words.ends)
        split[split] = PLAIN[data[stem[split] - 1]]
        at = np.flatnonzero(split)
        number = np.arange(len(words)) + np.cumsum(split) - split
        parts = Words.__new__(Words)
        parts.data = data
        parts.starts = np.insert(words.starts, at + 1, stem[at])
        parts.ends = np.insert(words.ends, at, stem[at])
        first = np.append(number, len(parts.starts))[words.first]
        if self.known.used > CACHE_WORDS or self.n_ids > CACHE_IDS:
            self.clear()
        codes = np.maximum(parts.codes(), np.uint64(1))
        spans, new = self.known.find(codes)
        if len(new):
            spelled, place, which = np.unique(codes[new], return_index=True, return_inverse=True)
            spans[new] = self.learn(spelled, parts.select(new[place]))[which]
        size = spans & 0xFFFFFFFF
        ids = self.ids.take(ranges(spans >> 32, size))
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[first]


TOKENIZERS: dict[str, WordTokenizer] = {}  # of a Python worker, for all of its tasks


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in TOKENIZERS:
        TOKENIZERS[path] = WordTokenizer(path)
    return TOKENIZERS[path]


def _tokenize(path, bounds, end_id, more=()):
    def run(batches):
        edges = np.array(bounds, np.int64)
        tokenizer = word_tokenizer(path)
        for piece in pieces(batches, limit=TOKEN_PIECE):
            ids, first = tokenizer.texts(piece.column("text"))
            n = piece.num_rows
            if max(ids.max(initial=0), end_id) >= 1 << 16:
                raise ValueError("ids of 65,536 and more need a wider coder")
            out = np.insert(ids.astype("<u2", copy=False), first[1:], end_id)
            at = (first + np.arange(n + 1)) * 2
            doc = piece.column("doc_id").cast(pa.int64())
            shard = np.searchsorted(edges, pc.fill_null(doc, -1 << 63).to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.maximum(shard, 0), pa.int32()), doc,
                 pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)),
                                                        pa.py_buffer(out)]),
                 *(piece.column(c) for c in more)], ["shard", "doc_id", "ids", *more])
    return run


def _frames(frame_ids, more=()):
    """Frames of the documents of each shard, as they come."""
    schema = pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())),
                        ("data", pa.binary()),
                        *((f"{c}s", pa.list_(pa.float64())) for c in more)])

    def run(batches):
        shard, frame, docs, held, size, rest = None, 0, [], [], 0, []

        def close():
            ids = np.frombuffer(b"".join(held), "<u2").astype(np.int32)
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "frame": frame, "n_ids": len(ids), "doc_ids": docs,
                "doc_sizes": [len(h) // 2 for h in held], "data": encode_frame(ids),
                **{f"{c}s": [r[i] for r in rest] for i, c in enumerate(more)}}], schema)

        for batch in batches:
            for s, doc, ids, *others in zip(*(c.to_pylist() for c in batch.columns)):
                if docs and (s != shard or size >= frame_ids):
                    yield close()
                    frame, docs, held, size, rest = frame + 1, [], [], 0, []
                if s != shard:
                    shard, frame = s, 0
                docs.append(doc), held.append(ids), rest.append(others)
                size += len(ids) // 2
        if docs:
            yield close()
    return run


def write_frames(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                 frame_ids: int = FRAME_IDS, position: bool = False) -> DataFrame:
    """Tokenize ``docs``, write the frames as a table at ``path``, and return it as read.

    With ``position``, the frames keep that column (double) of each document.
    """
    spark = docs.sparkSession
    frames = _token_frames(docs, tokenizer, end_id, frame_ids, ["position"] * position)
    frames.write.mode("errorifexists").parquet(path)
    return spark.read.schema(frames.schema).parquet(path)


def _token_frames(docs, tokenizer, end_id, frame_ids, more=()):
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    shards = min(max(ids.count() // SHARD_ROWS, 1), MAX_SHARDS)
    bounds = sorted({int(q) for q in ids.approxQuantile(
        "doc_id", [i / shards for i in range(shards)], 1 / (4 * shards))}) or [0]
    tokens = docs.select("doc_id", "text", *more).mapInArrow(
        _tokenize(tokenizer, bounds, end_id, more),
        ", ".join([TOKENS, *(f"{c} double" for c in more)]))
    return (tokens.repartitionById(len(bounds), "shard")
            .sortWithinPartitions("shard", "doc_id", "ids", *more)
            .mapInArrow(_frames(frame_ids, more),
                        ", ".join([FRAMES, *(f"{c}s array<double>" for c in more)])))


def frame_bytes(frames: DataFrame) -> DataFrame:
    """(shard, frame, data): the coded bytes of each frame."""
    return frames.select("shard", "frame", "data")


def _read(batches):
    for batch in batches:
        more = [c for c in batch.schema.names if c == "positions"]
        schema = pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("doc_id", pa.int64()),
                            ("at", pa.int64()), ("n_tokens", pa.int64()),
                            ("ids_crc32", pa.int64()), *((c[:-1], pa.float64()) for c in more)])
        for shard, frame, docs, sizes, data, *rest in zip(
                *(batch.column(c).to_pylist()
                  for c in ("shard", "frame", "doc_ids", "doc_sizes", "data", *more))):
            raw = decode_frame(data).astype("<u4").tobytes()
            ends = np.cumsum(sizes)
            starts = ends - np.array(sizes)
            crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array([frame] * n, pa.int32()),
                 pa.array(docs, pa.int64()), pa.array(starts), pa.array(sizes, pa.int64()),
                 pa.array(crcs, pa.int64()), *(pa.array(r, pa.float64()) for r in rest)],
                schema=schema)


def read_frames(frames: DataFrame) -> DataFrame:
    """Per document of the frames: doc_id, start, n_tokens, ids_crc32, and position if kept.

    Offsets come from a sum per shard and one per frame inside it.
    """
    more = [c for c in frames.columns if c == "positions"]
    sizes = frames.select("shard", "frame", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("frame").rowsBetween(
        Window.unboundedPreceding, -1)
    first = (sizes.join(shards.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))),
                        "shard")
             .withColumn("first", F.col("ahead") + F.coalesce(F.sum("n_ids").over(inside),
                                                              F.lit(0)))
             .select("shard", "frame", "first"))
    rows = frames.select("shard", "frame", "doc_ids", "doc_sizes", "data", *more).mapInArrow(
        _read, ", ".join([READ, *("position double" for _ in more)]))
    return rows.join(first, ["shard", "frame"]).select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
        *(c[:-1] for c in more))
