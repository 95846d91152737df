"""MinHash near-dedup: chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one class, led by its least
id. Class leaders are branched by trees: a node picks ``BRANCHES`` of the
minhash positions by its own hash, and each of its documents goes on to the
child named by its minwise token there. Nodes of up to ``LEAF`` documents are
compared exhaustively by their minhash signatures; documents that may be
similar form a cluster, and a cluster's links are confirmed on the full sets.

A node with more is dealt to chunks, a row per document; some
``REPRESENTATIVES`` of its documents stand in every chunk. The links confirmed there
make parts, and two documents of one part need not meet again. What is left of
a node beside its largest part, the rest, goes on branching, for unlike documents
soon part; a rest of up to two leaves, one of up to ``MANY`` after ``TRIES`` levels
and any at ``DEPTH`` is dealt to leaves so that each two documents of the rest, and
each of the rest and each of the part, still meet in one. So a tight group costs rows in
proportion to its size, and no link between different parts is lost. Chunks only save
rows, and reading the texts again for them costs more than a row per document: a level
whose large nodes are branched or dealt with no more rows than there are documents
leaves them out. Only links that join two parts of a cluster are written.

A pair of similarity s shares a child of a node with probability
1 - (1 - s) ** BRANCHES, about 0.98 at 0.85. The roots of the ``TREES`` trees pick
positions of their own, so all miss it with (1 - s) ** (TREES * BRANCHES): 1.1e-5 at
0.85, 6.4e-5 at 0.8; however deep the trees go, 3e-5 and 2.4e-4. All trees compare
the same signatures: a pair that falls below ``SLACK`` there is lost in each, which
adds 6e-7 at 0.85 and 3e-7 at 0.8 (binomial tails).

Sets: the distinct runs of ``shingle`` words, ASCII letters in lower case; with
fewer words the whole text is one. Null texts and texts without words have
empty sets and are linked with nothing, as are rows without an id. Rows of one
id are one document that may have several texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .staging import stage
from .words import (LOWER, NOT_SPACE, U64, Words, gram_hashes, gram_starts, mix, pieces, ranges,
                    stream, text_buffers)

SHINGLE = 5
THRESHOLD = (80, 100)  # shared shingles to all shingles
TREES = 3
BRANCHES = 2
POSITIONS = 64
LEAF = 512
MANY = 16
TRIES = 3
DEPTH = 8
REPRESENTATIVES = 32
SET_BYTES = 64 << 20  # of shingles in one batch
SLACK = 5.5  # standard errors that an estimate may fall short; its miss is below the trees'

FACTS = "doc_id long, n_shingles long, high long, low long, signature binary"


class ShingleSets:
    """The distinct shingle hashes of each text, sorted."""

    def __init__(self, data, offsets, shingle: int):
        words = Words(data, offsets, NOT_SPACE)
        hashes = words.hashes(LOWER)
        at = gram_starts(words.first, shingle)
        text = np.searchsorted(words.first, at, "right") - 1
        values = gram_hashes(hashes, shingle)[at]
        short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
        whole = []
        for i in short.tolist():
            row = hashes[words.first[i]:words.first[i + 1]]
            whole.append(gram_hashes(row, len(row))[0] ^ U64(len(row)))
        n = len(words.counts)
        text = np.concatenate([text, short]).astype(np.uint16 if n < 1 << 16 else np.int64)
        values = np.concatenate([values, np.array(whole, U64)])
        order = np.argsort(values)
        order = order[np.argsort(text[order], kind="stable")]
        text, values = text[order], values[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        self.values = values[new]
        self.first = np.searchsorted(text[new], np.arange(n + 1))
        self.counts = np.diff(self.first)


def signatures(sets: ShingleSets, positions: int = POSITIONS) -> np.ndarray:
    """The least hash of each set under every position's function; a row per text."""
    out = np.zeros((len(sets.counts), positions), np.uint32)
    filled = np.flatnonzero(sets.counts)
    if len(filled):
        heads = sets.first[:-1][filled]
        for j, (flip, factor) in enumerate(zip(stream(21, positions),
                                               stream(22, positions) | U64(1))):
            row = (sets.values ^ flip) * factor
            row = (((row ^ (row >> U64(32))) * factor) >> U64(32)).astype(np.uint32)
            out[filled, j] = np.minimum.reduceat(row, heads)
    return out


def _per_text(sets: ShingleSets, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([[U64(0)], np.cumsum(values)])
    return total[sets.first[1:]] - total[sets.first[:-1]]


def _facts(shingle):
    def run(batches):
        for piece in pieces(batches):
            sets = ShingleSets(*text_buffers(piece.column("text")), shingle)
            rows = signatures(sets)
            flat = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.array(sets.counts, pa.int64()),
                 pa.array(_per_text(sets, mix(sets.values)).view(np.int64)),
                 pa.array(_per_text(sets, mix(sets.values ^ U64(0x5bd1e995))).view(np.int64)),
                 flat], ["doc_id", "n_shingles", "high", "low", "signature"])
    return run


def _matrix(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint32).reshape(len(column), -1)


def picks(node: np.ndarray, branches: int, positions: int) -> list[np.ndarray]:
    """The positions that each node picks."""
    out = []
    for b in range(branches):
        position = (mix(node + U64(0x9E37 + b)) % U64(positions)).astype(np.int64)
        if b:  # another one than the first
            position = np.where(position == out[0], (position + b) % positions, position)
        out.append(position)
    return out


def roots(spark, trees: int, branches: int) -> list[int]:
    """A node per tree, with positions that no other picks while there are any."""
    hashed = spark.range(16 * trees).select(F.xxhash64(F.lit(3), "id").alias("node")).orderBy("id")
    nodes = [r["node"] for r in hashed.collect()]
    rows = zip(*(p.tolist() for p in picks(np.array(nodes).view(U64), branches, POSITIONS)))
    used, own, other = set(), [], []
    for node, row in zip(nodes, rows):
        free = used.isdisjoint(row)
        (own if free else other).append(node)
        used.update(row if free else ())
    return (own + other)[:trees]


def _branch(branches):
    """Children of (node, doc_id, signature): the tokens at the positions the node picks."""
    def run(batches):
        for batch in batches:
            node = batch.column("node").to_numpy().view(U64)
            rows = _matrix(batch.column("signature"))
            if not len(node):
                continue
            out = []
            for position in picks(node, branches, rows.shape[1]):
                token = rows[np.arange(len(node)), position].astype(U64)
                out.append(mix(mix(node ^ (position.astype(U64) << U64(40))) + token))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out).view(np.int64)),
                 pa.array(np.tile(batch.column("doc_id").to_numpy(), branches))],
                ["node", "doc_id"])
    return run


def _chunks(large: DataFrame, leaf: int) -> DataFrame:
    """A row per document of large nodes to one of their chunks; representatives to all."""
    chunks = F.ceil(F.col("n") / leaf)
    chosen = F.pmod(F.xxhash64(F.lit(6), "node", "doc_id"), "n") < REPRESENTATIVES
    own = F.array(F.pmod(F.xxhash64(F.lit(5), "node", "doc_id"), chunks))
    return (large.select("node", "doc_id", F.explode(F.when(
        chosen, F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(own)).alias("chunk"))
        .select(F.xxhash64("node", "chunk").alias("node"), "doc_id"))


def _times(leaf: int):
    """How many leaves ``_deal`` puts a row into."""
    return F.ceil(F.col("n_rest") / leaf) + F.when(F.col("joined"), 0).otherwise(
        F.ceil(F.col("n_part") / leaf))


def _deal(leaf):
    """Rows of large nodes to leaves named by pairs of blocks.

    Each two documents of the rest meet, and each of the rest and each of the
    largest part; documents of the largest part do not meet each other for this.
    """
    def run(batches):
        for batch in batches:
            node = batch.column("node").to_numpy().view(U64)
            doc = batch.column("doc_id").to_numpy()
            joined = batch.column("joined").to_numpy(zero_copy_only=False)
            rest_blocks = -(-batch.column("n_rest").to_numpy() // leaf)
            part_blocks = -(-batch.column("n_part").to_numpy() // leaf)
            blocks = np.where(joined, part_blocks, rest_blocks)
            own = (mix(doc.view(U64)) % np.maximum(blocks, 1).astype(U64)).astype(np.int64)
            times = rest_blocks + np.where(joined, 0, part_blocks)
            row = np.repeat(np.arange(len(doc)), times)
            other = ranges(np.zeros(len(doc), np.int64), times)
            within = ~joined[row] & (other < rest_blocks[row])  # both of the rest
            low = np.where(within, np.minimum(own[row], other),
                           np.where(joined[row], other, own[row]))
            high = np.where(within, np.maximum(own[row], other),
                            np.where(joined[row], own[row], other - rest_blocks[row]))
            pair = (low.astype(U64) << U64(32)) + high.astype(U64)
            name = mix(node[row] + mix(pair + U64(1)) + within.astype(U64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(doc[row])], ["node", "doc_id"])
    return run


def groups(batches, column: str):
    """Whole groups of rows that follow each other with the same value of a column."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        if held and held[0].column(column)[0].as_py() != int(key[0]):
            yield held
            held = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo and held:
                yield held
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def linked_parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n rows, the least row that each reaches by the links (a, b)."""
    parent = np.arange(n)
    while len(a):
        low = np.minimum(parent[a], parent[b])
        up = parent.copy()
        np.minimum.at(up, parent[a], low)
        np.minimum.at(up, parent[b], low)
        up = _roots(up)
        if (up == parent).all():
            break
        parent = up
    return parent


def similar_rows(rows: np.ndarray, least: float, step: int = 64):
    """(a, b), a < b: rows that agree at this share of the positions or more."""
    for lo in range(0, len(rows), step):
        part = rows[lo:lo + step]
        same = np.zeros((len(part), len(rows)), np.int32)
        for j in range(rows.shape[1]):
            same += part[:, j:j + 1] == rows[None, :, j]
        a, b = np.nonzero(same >= least * rows.shape[1])
        a = a + lo
        yield a[a < b], b[a < b]


def _clusters(least):
    """Of each leaf, the documents of different parts that may be linked, as named clusters."""
    def run(batches):
        for group in groups(batches, "node"):
            doc = np.concatenate([g.column("doc_id").to_numpy() for g in group])
            if len(doc) < 2:
                continue
            rows = np.concatenate([_matrix(g.column("signature")) for g in group])
            part = np.concatenate([g.column("part").to_numpy() for g in group])
            if (part == part[0]).all():
                continue
            pairs = [(a[part[a] != part[b]], b[part[a] != part[b]])
                     for a, b in similar_rows(rows, least)]
            root = linked_parts(len(doc), *(np.concatenate(x) for x in zip(*pairs)))
            size = np.bincount(root, minlength=len(doc))
            member = np.flatnonzero(size[root] > 1)
            if not len(member):
                continue
            total = np.zeros(len(doc), U64)
            np.add.at(total, root[member], mix(doc[member].view(U64) + U64(77)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(total[root[member]]).view(np.int64)), pa.array(doc[member])],
                ["cluster", "doc_id"])
    return run


def _sets(shingle):
    """A row per cluster of each document, with its whole set."""
    def run(batches):
        for piece in pieces(batches):
            sets = ShingleSets(*text_buffers(piece.column("text")), shingle)
            listed = piece.column("clusters")
            size = pc.list_value_length(listed).to_numpy()
            row = np.repeat(np.arange(piece.num_rows), size)
            cluster, doc = pc.list_flatten(listed), piece.column("doc_id").take(pa.array(row))
            packed = pa.array([v.tobytes() for v in np.split(sets.values, sets.first[1:-1])],
                              pa.binary())
            # A long text in many clusters is repeated, so its rows go out in small batches.
            batch = np.cumsum(8 * sets.counts[row]) // SET_BYTES
            edges = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(row)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                yield pa.RecordBatch.from_arrays(
                    [cluster.slice(lo, hi - lo), doc.slice(lo, hi - lo),
                     packed.take(pa.array(row[lo:hi]))], ["cluster", "doc_id", "members"])
    return run


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each two sets share: products of 0/1 blocks of their matrix."""
    size = np.array([len(x) for x in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2 ** 24
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        first, last = np.searchsorted(column, [lo, lo + columns])
        block = np.zeros((len(sets), columns), np.float32)
        block[row[first:last], column[first:last] - lo] = 1
        out += block @ block.T
    return out.astype(np.int64)


def confirmed(ids, sets, part: int, whole: int):
    """Pairs (a, b) that join the parts of one cluster that exact similarity links."""
    size = np.array([len(x) for x in sets])
    shared = shared_counts(sets)
    linked = whole * shared >= part * (size[:, None] + size[None, :] - shared)
    root = linked_parts(len(ids), *np.nonzero(np.triu(linked, 1)))
    for b in np.flatnonzero(root != np.arange(len(ids))).tolist():
        yield ids[root[b]], ids[b]


def _confirm(part, whole):
    def run(batches):
        for group in groups(batches, "cluster"):
            ids = [i for g in group for i in g.column("doc_id").to_pylist()]
            sets = [np.sort(np.frombuffer(m, U64)) for g in group
                    for m in g.column("members").to_pylist()]
            links = list(confirmed(ids, sets, part, whole))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.int64()),
                 pa.array([y for _, y in links], pa.int64())], ["a", "b"])
    return run


def _confirmed_links(docs: DataFrame, leaders: DataFrame, parts: DataFrame | None,
                     leaves: DataFrame, shingle: int, threshold: tuple) -> DataFrame:
    """Confirmed links (a, b) between documents of different parts that share a leaf."""
    part, whole = threshold
    s = part / whole
    least = s - SLACK * (s * (1 - s) / POSITIONS) ** 0.5
    known = leaders.select("doc_id", "signature")
    known = (known.withColumn("part", F.col("doc_id")) if parts is None else
             known.join(parts, "doc_id", "left")
             .withColumn("part", F.coalesce("part", "doc_id")))
    clusters = (leaves.join(known, "doc_id")
                .repartition("node").sortWithinPartitions("node", "doc_id")
                .mapInArrow(_clusters(least), "cluster long, doc_id long"))
    of_doc = stage(clusters.distinct(), "clusters").groupBy("doc_id").agg(
        F.collect_set("cluster").alias("clusters"))
    # The candidates grow with the input, so they are never broadcast, however few.
    members = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .join(of_doc.hint("merge"), "doc_id").mapInArrow(
                   _sets(shingle), "cluster long, doc_id long, members binary"))
    return stage(members.repartition("cluster").sortWithinPartitions("cluster", "doc_id")
                 .mapInArrow(_confirm(part, whole), "a long, b long"), "confirmed")


def _against_parts(large: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Rows of large nodes with the sizes of the node's largest part and of its rest.

    ``joined`` tells whether the document is of that part.
    """
    if parts is None:
        return large.select("node", "doc_id", "n", F.lit(False).alias("joined"),
                            F.lit(0).cast("long").alias("n_part"), F.col("n").alias("n_rest"))
    rows = large.join(parts, "doc_id", "left")
    largest = (rows.where("part is not null").groupBy("node", "part")
               .agg(F.count(F.lit(1)).alias("n_part")).groupBy("node")
               .agg(F.max(F.struct("n_part", "part")).alias("most")))
    return stage(rows.join(largest, "node", "left").select(
        "node", "doc_id", "n",
        F.coalesce(F.col("part") == F.col("most.part"), F.lit(False)).alias("joined"),
        F.coalesce("most.n_part", F.lit(0).cast("long")).alias("n_part"),
        (F.col("n") - F.coalesce("most.n_part", F.lit(0).cast("long"))).alias("n_rest")),
        "node-parts")


def similar_links(docs: DataFrame, leaders: DataFrame, shingle: int, threshold: tuple,
                  trees: int = TREES, branches: int = BRANCHES, leaf: int = LEAF) -> DataFrame:
    """Confirmed links (a, b) between class leaders, enough to join all that are linked."""
    rows = leaders.select("doc_id", "signature").withColumn("node", F.explode(F.array(
        *[F.lit(node) for node in roots(docs.sparkSession, trees, branches)])))
    links = parts = leaves = None
    total = leaders.count()
    for level in range(1, DEPTH + 1):
        children = stage(rows.select("node", "doc_id", "signature").mapInArrow(
            _branch(branches), "node long, doc_id long").distinct(), "nodes")
        sizes = children.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = stage(children.join(sizes, "node"), "sized-nodes")
        small = sized.where(F.col("n") <= leaf).select("node", "doc_id")
        leaves = small if leaves is None else leaves.union(small)
        large = sized.where(F.col("n") > leaf)
        if large.isEmpty():
            break
        split = _against_parts(large, parts)
        ends = F.lit(level == DEPTH) | (
            F.col("n_rest") <= (2 if level < TRIES else MANY) * leaf)
        loose = split.where(F.col("n_rest") > leaf)
        cost = loose.agg(F.sum(F.when(ends, _times(leaf)).otherwise(branches))).first()[0] or 0
        if cost > total:
            found = _confirmed_links(docs, leaders, parts, _chunks(loose, leaf), shingle,
                                     threshold)
            links = found if links is None else links.union(found)
            parts = stage(components(links).select(
                F.col("node").alias("doc_id"), F.col("component").alias("part")), "parts")
            split = _against_parts(large, parts)
        leaves = leaves.union(split.where(ends).drop("n").mapInArrow(
            _deal(leaf), "node long, doc_id long"))
        further = split.where(~ends)
        if further.isEmpty():
            break
        rows = further.select("node", "doc_id").join(leaders.select("doc_id", "signature"),
                                                     "doc_id")
    found = _confirmed_links(docs, leaders, parts, leaves, shingle, threshold)
    return found if links is None else links.union(found)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple = THRESHOLD,
                    **options) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id, kept."""
    facts = stage(docs.select("doc_id", "text").mapInArrow(_facts(shingle), FACTS),
                  "shingle-facts")
    sets = ["high", "low", "n_shingles"]
    usable = facts.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stage(usable.groupBy(*sets).agg(F.min("doc_id").alias("leader")), "classes")
    leaders = stage(facts.join(classes, [facts[c] == classes[c] for c in sets]
                               + [facts["doc_id"] == classes["leader"]], "left_semi")
                    .select("doc_id", "signature").distinct(), "leaders")
    links = similar_links(docs, leaders, shingle, threshold, **options)
    rows = (facts.drop("signature").join(classes, sets, "left")
            .withColumn("leader", F.when(F.col("doc_id").isNotNull(), F.col("leader"))))
    own = (rows.where(F.col("leader").isNotNull() & (F.col("leader") < F.col("doc_id")))
           .select(F.col("doc_id").alias("a"), F.col("leader").alias("b")))
    # A repeated id may stand in several classes; through it they are one.
    twice = (usable.groupBy("doc_id").agg(F.countDistinct("high", "low").alias("n"))
             .where("n > 1").select("doc_id"))
    links = links.union(own.join(twice, own["a"] == twice["doc_id"], "left_semi"))
    found = components(links)
    return (rows.join(found, rows["leader"] == found["node"], "left")
            .select("doc_id", "n_shingles",
                    F.coalesce("component", "leader", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, with all columns; of rows equal in id, all or none."""
    gone = near_duplicates(docs, **options).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
