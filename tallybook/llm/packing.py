"""Best-fit packing of documents into sequences, by minimum bin slack.

Documents are tokenized and get an end id. Only those longer than a sequence are
cut, into whole sequences; the first piece takes what is left over. How many pieces
there are of each length is all that packing needs, so the plan is made from that
histogram: the longest piece that is left opens a bin, and a subset-sum dynamic
program over the lengths that are left, in bitsets, finds the combination that
fills the bin most, with long pieces first. It is removed as often as its lengths
last, so the plan has at most a few thousand lines at any input size. A piece finds
its sequence by its rank among the pieces of its length.

Null texts are empty and have only the end id. Rows are documents of their own, also
with equal or null ids; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import setting, stage
from .words import Words, pieces, ranges, text_buffers

LENGTH = 2048
END_ID = 0
CACHE_IDS = 4 << 20
CHUNK_BYTES = 2 << 20
WRITE_BYTES = 16 << 20  # ids that a writing task holds

PIECES = ("doc_id long, piece int, start long, length int, ids binary, "
          "part int, place long")


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def ends_run(data: np.ndarray) -> np.ndarray:
    """Bytes behind which white space starts a run: the ends of signs known not to be white."""
    out = (data > 0x20) & (data < 0x7F)
    out[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    return out


class ByteTokenizer:
    """Whole texts to ids of a byte-level BPE, each spelling encoded once for many texts.

    Such tokenizers let a space or tab begin a token's word but never stand inside
    one after a visible sign, so a text's ids are those of its runs: a run starts at
    white space that follows a visible ASCII sign or a character of two bytes that is
    none of the white ones. ``by_run`` probes it; for others whole texts are encoded.
    """

    TOGETHER = 2000

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.by_run = self.parts_runs()
        self.clear()

    def clear(self):
        self.known = np.array([(1 << 64) - 1], np.uint64)
        self.slots, self.first = np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.ids = np.empty(0, np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts_runs(self) -> bool:
        runs = ["A", "  b's", "\tc,", "\n\n 12", " été", " <|endoftext|>x", " 文!?", "   "]
        return self.encode(["".join(runs)])[0] == [i for r in self.encode(runs) for i in r]

    @staticmethod
    def run_starts(data: np.ndarray) -> np.ndarray:
        """Where a run may start, by the bytes around it."""
        out = np.zeros(len(data), bool)
        out[1:] = WHITE[data[1:]] & ends_run(data)[:-1]
        return out

    def spellings(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs, number of ids of each).

        A token of such a tokenizer has a letter for each byte. So runs that start with
        white space and end where another may start are encoded as one text, and parted
        by their bytes.
        """
        size = np.zeros(len(starts), np.int64)
        alike = WHITE[data[starts]] & ends_run(data)[ends - 1]
        plain, other, ids = np.flatnonzero(alike), np.flatnonzero(~alike).tolist(), []
        for lo in range(0, len(plain), self.TOGETHER):
            part = plain[lo:lo + self.TOGETHER]
            long = ends[part] - starts[part]
            text = data[ranges(starts[part], long)].tobytes().decode()
            row = np.array(self.encode([text])[0], np.int32)
            stops = np.cumsum(self.bytes[row])
            at = np.searchsorted(stops, np.cumsum(long))
            if len(row) and at[-1] == len(row) - 1 and (stops[at] == np.cumsum(long)).all():
                size[part] = np.diff(at, prepend=-1)
                ids.append((part, row))
            else:
                other += part.tolist()
        if other:
            raw = [data[a:b].tobytes().decode() for a, b in zip(starts[other].tolist(),
                                                                ends[other].tolist())]
            rows = self.encode(raw)
            size[other] = [len(r) for r in rows]
            ids.append((np.array(other), np.array([i for r in rows for i in r], np.int32)))
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        for part, row in ids:
            out[ranges(first[part], size[part])] = row
        return out, size

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text), without end ids."""
        if not self.by_run:
            rows = self.encode(pc.fill_null(column, "").to_pylist())
            first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            return np.array([i for r in rows for i in r], np.int64), first
        data, offsets = text_buffers(column)
        cut = np.append(self.run_starts(data), False)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        runs = Words.__new__(Words)
        runs.data, runs.starts = data, np.flatnonzero(cut[:-1])
        runs.ends = np.append(runs.starts[1:], len(data))[:len(runs.starts)]
        codes = runs.hashes()
        spelled, place, which = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.ids) > CACHE_IDS:
            self.clear()
        at = np.searchsorted(self.known, spelled)
        slots = self.slots[np.minimum(at, len(self.slots) - 1)]
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != spelled)
        if len(new):
            ids, size = self.spellings(data, runs.starts[place[new]], runs.ends[place[new]])
            slots[new] = len(self.first) - 1 + np.arange(len(new))
            self.known = np.insert(self.known, at[new], spelled[new])
            self.slots = np.insert(self.slots, at[new], slots[new])
            self.first = np.append(self.first, self.first[-1] + np.cumsum(size)).astype(np.int32)
            self.ids = np.append(self.ids, ids)
        slot = slots[which]
        size = self.first[slot + 1] - self.first[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        return (self.ids[ranges(self.first[slot], size)],
                total[np.searchsorted(runs.starts, offsets)])


def _pieces(path, length, end_id):
    """A row per piece, with its place among the pieces of its length in the task."""
    def run(batches):
        tokenizer, part = ByteTokenizer(path), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in pieces(batches, limit=CHUNK_BYTES):
            ids, first = tokenizer.texts(batch.column("text"))
            n = batch.num_rows
            out = np.full(len(ids) + n, end_id, "<u4")
            size = np.diff(first)
            begin = first[:-1] + np.arange(n)
            out[ranges(begin, size)] = ids
            size = size + 1
            many = -(-size // length)
            doc = np.repeat(np.arange(n), many)
            number = ranges(np.zeros(n, np.int64), many)
            head = (size - (many - 1) * length)[doc]
            start = np.where(number > 0, head + (number - 1) * length, 0)
            long = np.where(number > 0, length, head)
            order = np.argsort(long, kind="stable")
            edge = np.flatnonzero(np.diff(long[order], prepend=-1))
            place = np.empty(len(long), np.int64)
            place[order] = np.arange(len(long)) - np.repeat(edge, np.diff(edge, append=len(long)))
            place += seen[long]
            seen += np.bincount(long, minlength=length + 1)
            ends = np.concatenate([[0], np.cumsum(long)]) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
                 pa.array(number, pa.int32()), pa.array(start), pa.array(long, pa.int32()),
                 pa.Array.from_buffers(pa.binary(), len(long), [
                     None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)]),
                 pa.array(np.full(len(long), part, np.int32)), pa.array(place)],
                ["doc_id", "piece", "start", "length", "ids", "part", "place"])
    return run


def fullest(room: int, lengths: list[int], left) -> list[int]:
    """Lengths whose sum comes nearest to ``room`` from below, none more often than it is left.

    ``lengths`` descend. The bitset after each length holds the sums that are reached.
    """
    reached, steps = 1, []
    mask = (1 << room + 1) - 1
    for v in lengths:
        if v > room:
            continue
        copies, step = min(left[v], room // v), 1
        before = reached
        while copies:
            step = min(step, copies)
            reached |= reached << v * step & mask
            copies -= step
            step *= 2
        steps.append((v, before))
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, []
    for v, before in reversed(steps):
        while not before >> total & 1:
            total -= v
            chosen.append(v)
    return chosen


def bin_plan(counts: dict[int, int], room: int) -> list[tuple[int, list[int]]]:
    """(times, lengths in the bin) for all pieces: minimum bin slack, the longest piece fixed."""
    left = dict(counts)
    lengths = sorted((v for v, n in left.items() if n), reverse=True)
    plan = []
    while lengths:
        v = lengths[0]
        left[v] -= 1
        own = [v, *fullest(room - v, lengths, left)]
        left[v] += 1
        uses = {x: own.count(x) for x in own}
        times = min(left[x] // k for x, k in uses.items())
        for x, k in uses.items():
            left[x] -= times * k
        lengths = [x for x in lengths if left[x]]
        plan.append((times, own))
    return plan


def _seats(plan):
    """For each length, the ranks at which a run of seats ends, and the seats' sequences.

    A plan line that uses a length k times seats k * times pieces: rank r of them sits
    in sequence base + r // k, in the (r % k)-th seat of that length.
    """
    seats, base = {}, 0
    for times, own in plan:
        offset, by_length = 0, {}
        for v in own:
            by_length.setdefault(v, []).append(offset)
            offset += v
        for v, offsets in by_length.items():
            runs = seats.setdefault(v, [])
            done = runs[-1][0] if runs else 0
            runs.append((done + times * len(offsets), done, base, offsets))
        base += times
    return seats


def _seated(plan):
    """(sequence_id, offset) of pieces by length and rank."""
    seats = {v: (np.array([r[0] for r in runs]), np.array([r[1] for r in runs]),
                 np.array([r[2] for r in runs]), np.array([len(r[3]) for r in runs]),
                 np.concatenate([[0], np.cumsum([len(r[3]) for r in runs])]),
                 np.array([x for r in runs for x in r[3]]))
             for v, runs in _seats(plan).items()}

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros((2, len(rank)), np.int64)
            for v in np.unique(length).tolist():
                ends, done, base, uses, first, offsets = seats[v]
                own = np.flatnonzero(length == v)
                at = np.searchsorted(ends, rank[own], "right")
                seat = rank[own] - done[at]
                sequence[own] = base[at] + seat // uses[at]
                offset[own] = offsets[first[at] + seat % uses[at]]
            yield batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)) \
                .append_column("offset", pa.array(offset))
    return run


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH,
                 end_id: int = END_ID) -> DataFrame:
    """A table of all pieces with their ids (little-endian 32 bits): doc_id, piece, start,
    length, ids, and part and place, the piece's place among those of its length in a part."""
    rows = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, length, end_id), PIECES)
    spark = docs.sparkSession
    with setting(spark, "spark.sql.parquet.compression.codec", "zstd"), \
            setting(spark, "parquet.block.size", str(WRITE_BYTES)):
        return stage(rows, "token-pieces")


def pack(table: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``token_pieces`` without ids, with sequence_id and offset.

    Sequences are numbered from 0; their pieces follow each other without a gap.
    """
    counts = table.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    counts = stage(counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))),
                   "piece-counts")
    # one number for each length: at most ``length`` rows
    plan = bin_plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(
        F.sum("n").alias("n")).collect()}, length)
    ranked = (table.drop("ids").join(counts.select("length", "part", "ahead").hint("merge"), ["length", "part"])
              .select("doc_id", "piece", "start", "length",
                      *(c for c in table.columns if c not in
                        ("doc_id", "piece", "start", "length", "ids", "part", "place")),
                      (F.col("ahead") + F.col("place")).alias("rank")))
    kept = ranked.drop("rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return ranked.mapInArrow(_seated(plan), f"{schema}, sequence_id long, offset long")


def sequences(table: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves."""
    packed = pack(table.withColumn("held", F.col("ids")), length)
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(
            "offset", F.hex("held").alias("ids")))), lambda x: x["ids"])).alias("ids")).select(
                "sequence_id", "length", F.unhex("ids").alias("ids"))
