"""Hard negatives by exact window search in a multiway hyperplane tree (GNAT style).

Rows become integer vectors, and a score is an integer inner product. With one more
coordinate that brings every row to the largest norm M, the score s with an anchor
fixes their distance: d * d = |anchor|^2 + M^2 - 2 s, so a window of scores is an
annulus around the anchor. A node of the tree has split points, and each row goes
to the subtree of its nearest one. The split points come from a sample of
``SAMPLE_ROWS`` rows; every row is indexed, and for each pair of split points the
node keeps the range of distances from the one to all rows of the other's subtree.
A subtree is out as soon as one split point's range misses the anchor's annulus.
Leaves are compared exactly, so the results are exact whatever the tree prunes;
with vectors that have no structure, that is little.

Leaves are bundled to groups of rows of about equal size, large ones are cut. An
anchor goes to the bundles that hold one of its leaves; a task holds a bundle and
a block of anchors, and keeps the best of each anchor only. The score that the
sample's rows reach is where each anchor's window starts.

Rows with a null id, label or vector, or a null or non-finite component take no
part. Shorter vectors are filled up with zeros. Rows of one id are rows of their
own, also equal ones, and an anchor's other rows are all but itself. Vectors whose
squared norm passes 62 bits end the run with an error, as their scores would not
fit. Tables without anchors give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neardup import groups
from .staging import stage
from .words import U64, mix, ranges

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)  # percent of the positive's score
SAMPLE_ROWS = 4096
FAN = 16
LEAF_ROWS = 1024  # a node with more rows, by its share of the sample, is split
BUNDLE_ROWS = (4096, 65_536)
BUNDLES = 64
ANCHOR_ROWS = 65_536
BLOCK = 1024  # anchors compared with as many rows four times over at once
LEAST, MOST = -(1 << 62), 1 << 62

ROWS = "vec_id long, label int, vector binary, norm long"
FOUND = "anchor long, window int, score long, vec_id long, row long"


def integer_vectors(batches, scale=SCALE):
    """(vec_id, label, vector, norm) of the rows that take part."""
    for batch in batches:
        vectors = batch.column("vector")
        whole = pc.and_(pc.and_(batch.column("vec_id").is_valid(), batch.column("label").is_valid()),
                        vectors.is_valid())
        batch = batch.filter(whole)
        vectors = batch.column("vector")
        if not batch.num_rows:
            continue
        size = pc.list_value_length(vectors).to_numpy().astype(np.int64)
        flat = pc.cast(pc.list_flatten(vectors), pa.float64())
        flat = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        good = bad[ends] == bad[ends - size]
        with np.errstate(invalid="ignore", over="ignore"):
            flat = np.floor(scale * np.where(np.isfinite(flat), flat, 0))
            norm = np.concatenate([[0], np.cumsum(np.minimum(flat * flat, 2.0 ** 100))])
            if (good & ~(norm[ends] - norm[ends - size] < MOST)).any():
                raise ValueError("scores of these vectors would pass 64 bits")
            flat = np.where(np.abs(flat) < 2.0 ** 32, flat, 0).astype("<i8")
        squares = np.concatenate([[0], np.cumsum(flat.astype(object) ** 2 if norm[-1] >= MOST
                                                 else flat * flat)])
        at = np.flatnonzero(good)
        raw = [flat[ends[i] - size[i]:ends[i]].tobytes() for i in at.tolist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(at)).cast(pa.int64()),
             batch.column("label").take(pa.array(at)).cast(pa.int32()),
             pa.array(raw, pa.binary()),
             pa.array((squares[ends[at]] - squares[ends[at] - size[at]]).astype(np.int64))],
            ["vec_id", "label", "vector", "norm"])


def matrix(column, width: int) -> np.ndarray:
    """The vectors of a binary column as rows, filled up with zeros."""
    raw = column.to_pylist()
    if all(len(v) == 8 * width for v in raw):
        return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), width)
    out = np.zeros((len(raw), width), np.int64)
    for row, v in zip(out, raw):
        row[:len(v) // 8] = np.frombuffer(v, "<i8")
    return out


class Tree:
    """Nodes with split points; children are nodes, or leaves as negative numbers - 1."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray, most: int, total: int,
                 leaf_rows: int = LEAF_ROWS, fan: int = FAN):
        self.most, self.width = float(most), vectors.shape[1]
        # Beyond 53 bits, scores are taken in integers.
        self.kind = np.float64 if most < 1 << 53 else np.int64
        self.slack = 1e-6 * max(self.most, 1.0) ** 0.5
        self.points, self.children, self.leaves = [], [], 0
        rows = self.lifted(vectors, norms)
        pick = np.random.default_rng(len(rows))
        todo = [(None, 0, np.arange(len(rows)))]
        while todo:
            parent, place, own = todo.pop(0)
            split = None
            if len(own) >= 2 * fan and len(own) * total > leaf_rows * len(rows):
                split = self._spread(rows[pick.permutation(own)[:3 * fan]], fan)
            if split is None and parent is not None:
                self.children[parent][place] = -1 - self.leaves
                self.leaves += 1
                continue
            if split is None:
                split = rows[own[:1]] if len(own) else np.zeros((1, self.width + 1))
            node = len(self.points)
            self.points.append(split)
            self.children.append(np.zeros(len(split), np.int64))
            if parent is not None:
                self.children[parent][place] = node
            nearest = self._distances(rows[own], split).argmin(axis=1)
            todo += [(node, j, own[nearest == j]) for j in range(len(split))]
        self.near = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.far = [np.full((len(p), len(p)), -np.inf) for p in self.points]

    def lifted(self, vectors, norms) -> np.ndarray:
        more = np.sqrt(np.maximum(self.most - norms.astype(np.float64), 0))
        return np.concatenate([vectors.astype(np.float64), more[:, None]], axis=1)

    def _distances(self, rows, points) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.most - 2 * (rows @ points.T), 0))

    def _spread(self, rows, fan):
        """Up to ``fan`` of the rows, each the farthest from those before it."""
        chosen = [0]
        nearest = self._distances(rows, rows[:1])[:, 0]
        while len(chosen) < fan and nearest.max() > self.slack:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, self._distances(rows, rows[chosen[-1:]])[:, 0])
        return rows[chosen] if len(chosen) > 1 else None

    def descend(self, vectors, norms, seen=None) -> np.ndarray:
        """The leaf of each row; ``seen(node, choice, distances)`` is told of every step."""
        rows = self.lifted(vectors, norms)
        leaf = np.zeros(len(rows), np.int64)
        at = {0: np.arange(len(rows))}
        for node, points in enumerate(self.points):
            own = at.pop(node, None)
            if own is None or not len(own):
                continue
            distances = self._distances(rows[own], points)
            choice = distances.argmin(axis=1)
            if seen:
                seen(node, choice, distances)
            for j, child in enumerate(self.children[node].tolist()):
                if child < 0:
                    leaf[own[choice == j]] = -1 - child
                else:
                    at[child] = own[choice == j]
        return leaf

    def scores_between(self, vectors, norms) -> tuple[np.ndarray, np.ndarray]:
        """(least, most): what each anchor's score with a row of each leaf can be."""
        n = len(vectors)
        norms = norms.astype(np.float64)[:, None]
        least, most = np.zeros((n, self.leaves)), np.zeros((n, self.leaves))
        bounds = {0: (np.zeros((n, 1)), np.full((n, 1), np.inf))}
        for node, points in enumerate(self.points):
            low, high = bounds.pop(node)
            d = np.sqrt(np.maximum(norms + self.most - 2 * (vectors @ points[:, :-1].T), 0))
            low, high = np.repeat(low, len(points), 1), np.repeat(high, len(points), 1)
            for i in range(len(points)):
                own = d[:, i:i + 1]
                low = np.maximum(low, np.maximum(self.near[node][i] - own, own - self.far[node][i]))
                high = np.minimum(high, own + self.far[node][i])
            for j, child in enumerate(self.children[node].tolist()):
                if child >= 0:
                    bounds[child] = low[:, j:j + 1], high[:, j:j + 1]
                else:
                    out = norms[:, 0] + self.most
                    most[:, -1 - child] = (out - np.maximum(low[:, j] - self.slack, 0) ** 2) / 2 + 1
                    least[:, -1 - child] = (out - (high[:, j] + self.slack) ** 2) / 2 - 1
        return least, most


def _indexed(tree):
    def run(batches):
        for batch in batches:
            norms = batch.column("norm").to_numpy()
            leaf = tree.descend(matrix(batch.column("vector"), tree.width), norms)
            yield batch.append_column("leaf", pa.array(leaf))
    return run


def _measured(tree):
    """(node, i, j, near, far, n): distances from split point i to the rows of subtree j."""
    def run(batches):
        near = [np.full_like(x, np.inf) for x in tree.near]
        far = [np.full_like(x, -np.inf) for x in tree.far]
        count = [np.zeros(len(x), np.int64) for x in tree.near]

        def seen(node, choice, distances):
            for j in np.unique(choice).tolist():
                own = distances[choice == j]
                near[node][:, j] = np.minimum(near[node][:, j], own.min(axis=0))
                far[node][:, j] = np.maximum(far[node][:, j], own.max(axis=0))
                count[node][j] += len(own)

        for batch in batches:
            tree.descend(matrix(batch.column("vector"), tree.width),
                         batch.column("norm").to_numpy(), seen)
        for node in range(len(near)):
            i, j = np.nonzero(count[node][None, :] + 0 * count[node][:, None])
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), node)), pa.array(i), pa.array(j),
                     pa.array(near[node][i, j]), pa.array(far[node][i, j]),
                     pa.array(count[node][j])], ["node", "i", "j", "near", "far", "n"])
    return run


class Index:
    """The rows of a table in the leaves of a tree, and the bundles that hold them."""

    def __init__(self, rows: DataFrame, sample_rows: int = SAMPLE_ROWS,
                 leaf_rows: int = LEAF_ROWS, fan: int = FAN):
        total, most, width = rows.agg(F.count(F.lit(1)), F.max("norm"),
                                      F.max(F.length("vector"))).first()
        self.total, width = total, max((width or 0) // 8, 1)
        sample = rows.orderBy(F.xxhash64("row"), "row").limit(sample_rows).toArrow()
        self.sample_row = sample["row"].to_numpy()
        self.sample_label = sample["label"].to_numpy()
        vectors = matrix(sample["vector"], width)
        self.tree = Tree(vectors, sample["norm"].to_numpy(), most or 0, total, leaf_rows, fan)
        self.sample = vectors.astype(self.tree.kind)
        self.rows = stage(rows.mapInArrow(
            _indexed(self.tree), f"row long, {ROWS}, leaf long"), "gnat-leaves")
        measured = (self.rows.mapInArrow(_measured(self.tree),
                                         "node long, i long, j long, near double, far double, n long")
                    .groupBy("node", "i", "j").agg(F.min("near"), F.max("far"), F.sum("n")))
        counts = np.zeros(self.tree.leaves, np.int64)
        for node, i, j, near, far, n in measured.collect():  # a row per two split points
            self.tree.near[node][i, j], self.tree.far[node][i, j] = near, far
            if self.tree.children[node][j] < 0:
                counts[-1 - self.tree.children[node][j]] = n
        room = min(max(total // BUNDLES, BUNDLE_ROWS[0]), BUNDLE_ROWS[1])
        self.first, self.pieces = np.zeros((2, len(counts)), np.int64)
        bundle = held = 0
        for leaf, n in enumerate(counts.tolist()):
            if held and held + n > room:
                bundle, held = bundle + 1, 0
            self.first[leaf], self.pieces[leaf] = bundle, max(-(-n // room), 1)
            bundle, held = bundle + self.pieces[leaf] - 1, (held + n if n <= room else room)


def _place(index, parts):
    """Rows with the keys of all tasks that hold their bundle."""
    first, pieces = index.first, index.pieces

    def run(batches):
        for batch in batches:
            leaf, row = batch.column("leaf").to_numpy(), batch.column("row").to_numpy()
            bundle = first[leaf] + (mix(row.view(U64)) % pieces[leaf].astype(U64)).astype(np.int64)
            for part in range(parts):
                yield batch.append_column("key", pa.array(bundle * parts + part)) \
                    .append_column("kind", pa.array(np.zeros(len(row), np.int32))) \
                    .append_column("lows", pa.array([None] * len(row), pa.list_(pa.int64()))) \
                    .append_column("highs", pa.array([None] * len(row), pa.list_(pa.int64()))) \
                    .select(TASK_COLUMNS)
    return run


TASK_COLUMNS = ["key", "kind", "leaf", "row", "vec_id", "label", "vector", "norm", "lows", "highs"]
TASK = ("key long, kind int, leaf long, row long, vec_id long, label int, vector binary, "
        "norm long, lows array<long>, highs array<long>")


def windows(column, n: int, missing: int) -> np.ndarray:
    """A list column as a matrix; rows with fewer windows get the missing value."""
    lists = column.to_pylist()
    out = np.full((n, max((len(x) for x in lists), default=0)), missing, np.int64)
    for row, values in zip(out, lists):
        row[:len(values)] = values
    return out


def start(scores, allowed, low, high, k: int) -> np.ndarray:
    """Where a window of each anchor may start: its k-th best score so far, if it has k."""
    fits = np.where(allowed & (scores >= low[:, None]) & (scores <= high[:, None]), scores, LEAST)
    if fits.shape[1] < k:
        return low
    return np.maximum(np.partition(fits, -k, axis=1)[:, -k].astype(np.int64), low)


def _visits(index, same: bool, k: int, parts: int):
    """A row per anchor and bundle with a leaf that its windows' annuli meet."""
    tree, sample = index.tree, index.sample
    sample_row, sample_label = index.sample_row, index.sample_label
    first, pieces = index.first, index.pieces

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(lo, BLOCK)
                n = batch.num_rows
                row, label = batch.column("row").to_numpy(), batch.column("label").to_numpy()
                vectors = matrix(batch.column("vector"), tree.width).astype(tree.kind)
                low = windows(batch.column("lows"), n, MOST)
                high = windows(batch.column("highs"), n, LEAST)
                scores = vectors @ sample.T
                allowed = (label[:, None] == sample_label) == same
                allowed &= row[:, None] != sample_row
                for w in range(low.shape[1]):
                    low[:, w] = start(scores, allowed, low[:, w], high[:, w], k)
                least, most = tree.scores_between(vectors, batch.column("norm").to_numpy())
                meets = np.zeros(least.shape, bool)
                for w in range(low.shape[1]):
                    meets |= (most >= low[:, w:w + 1]) & (least <= high[:, w:w + 1])
                anchor, leaf = np.nonzero(meets)
                pair = np.repeat(anchor, pieces[leaf]), ranges(first[leaf], pieces[leaf])
                pair = np.unique(np.stack(pair), axis=1) if len(anchor) else np.zeros((2, 0), int)
                part = (mix(row.view(U64)) % U64(parts)).astype(np.int64)
                lows = pa.array(low.tolist(), pa.list_(pa.int64()))
                out = batch.drop_columns(["lows"]).append_column("lows", lows) \
                    .take(pa.array(pair[0]))
                yield out.append_column("key", pa.array(pair[1] * parts + part[pair[0]])) \
                    .append_column("kind", pa.array(np.ones(out.num_rows, np.int32))) \
                    .append_column("leaf", pa.array(np.zeros(out.num_rows, np.int64))) \
                    .select(TASK_COLUMNS)
    return run


def best(anchor, window, score, vec_id, row, k: int) -> np.ndarray:
    """Places of the first k of each anchor and window, by score, then id."""
    order = np.lexsort((row, vec_id, -score, window, anchor))
    a, w = anchor[order], window[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    head = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(head, np.diff(head, append=len(order)))
    return order[rank < k]


def _search(tree, same: bool, k: int):
    """(anchor, window, score, vec_id, row): the first k of each window in a bundle."""
    def blocks(leaf):
        """Runs of rows of one leaf, cut to a size."""
        edges = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for at in range(lo, hi, 4 * BLOCK):
                yield at, min(at + 4 * BLOCK, hi)

    def compared(rows, anchors):
        n = anchors.num_rows
        vectors = matrix(anchors.column("vector"), tree.width).astype(tree.kind)
        own_row, own_label = (anchors.column(c).to_numpy() for c in ("row", "label"))
        low = windows(anchors.column("lows"), n, MOST)
        high = windows(anchors.column("highs"), n, LEAST)
        least, most = tree.scores_between(vectors, anchors.column("norm").to_numpy())
        held = [np.empty(0, np.int64) for _ in range(5)]
        for lo, hi in blocks(rows["leaf"]):
            leaf = rows["leaf"][lo]
            for w in range(low.shape[1]):
                on = np.flatnonzero((most[:, leaf] >= low[:, w]) & (least[:, leaf] <= high[:, w]))
                if not len(on):
                    continue
                scores = vectors[on] @ rows["vector"][lo:hi].T
                fits = (scores >= low[on, w][:, None]) & (scores <= high[on, w][:, None])
                a, x = np.nonzero(fits)
                x += lo
                ok = ((own_label[on[a]] == rows["label"][x]) == same) & (own_row[on[a]] != rows["row"][x])
                a, x = a[ok], x[ok]
                found = [on[a], np.full(len(a), w), scores[a, x - lo].astype(np.int64),
                         rows["vec_id"][x], rows["row"][x]]
                held = [np.concatenate(p) for p in zip(held, found)]
                keep = best(*held, k)
                held = [p[keep] for p in held]
                mine = held[1] == w
                filled = np.bincount(held[0][mine], minlength=n) >= k
                worst = np.full(n, MOST)
                np.minimum.at(worst, held[0][mine], held[2][mine])
                low[filled, w] = np.maximum(low[filled, w], worst[filled])
        return pa.RecordBatch.from_arrays(
            [pa.array(own_row[held[0]]), pa.array(held[1].astype(np.int32)),
             *(pa.array(x) for x in held[2:])], ["anchor", "window", "score", "vec_id", "row"])

    def run(batches):
        for group in groups(batches, "key"):
            table = pa.Table.from_batches(group).combine_chunks()
            own = table.filter(pc.equal(table["kind"], 0))
            anchors = table.filter(pc.equal(table["kind"], 1)).combine_chunks()
            if not own.num_rows or not anchors.num_rows:
                continue
            rows = {c: own[c].to_numpy() for c in ("leaf", "row", "vec_id", "label")}
            rows["vector"] = matrix(own["vector"], tree.width).astype(tree.kind)
            for batch in anchors.to_batches(max_chunksize=BLOCK):
                yield compared(rows, batch)
    return run


def window_search(index: Index, anchors: DataFrame, same: bool, k: int,
                  anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """The first k rows of each window of each anchor: anchor, window, rank, score, vec_id, row.

    ``anchors``: row, vec_id, label, vector, norm, and the windows as lists of their
    least and largest scores, lows and highs. Rows of the anchor's label, or all others.
    """
    parts = max(-(-anchors.count() // anchor_rows), 1)
    rows = index.rows.mapInArrow(_place(index, parts), TASK)
    visits = anchors.select("row", "vec_id", "label", "vector", "norm", "lows", "highs").mapInArrow(
        _visits(index, same, k, parts), TASK)
    found = (rows.union(visits).repartition("key").sortWithinPartitions("key", "kind", "leaf", "vec_id")
             .mapInArrow(_search(index.tree, same, k), FOUND))
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, window: tuple = WINDOW, **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, vector (a list of numbers). A positive is one of an
    anchor's first rows of the same label, a negative one of the first of another
    label with a score in the window, in percent of the positive's.
    """
    low, high = window
    rows = stage(rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                             F.col("label").cast("int").alias("label"), "vector")
                 .mapInArrow(integer_vectors, ROWS)
                 .select(F.monotonically_increasing_id().alias("row"), "*"), "gnat-rows")
    index = Index(rows, **options)
    anchors = rows.where(is_anchor)
    first = stage(window_search(index, anchors.select(
        "*", F.array(F.lit(LEAST)).alias("lows"), F.array(F.lit(MOST)).alias("highs")),
        True, positives), "gnat-positives")
    wanted = (first.withColumn("low", F.expr(f"cast(ceil(cast(score as decimal(20,0)) * {low} / 100) as long)"))
              .withColumn("high", F.expr(f"cast(floor(cast(score as decimal(20,0)) * {high} / 100) as long)"))
              .groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(
                  "rank", "low", "high"))).alias("w"))
              .select(F.col("anchor").alias("row"), F.col("w.low").alias("lows"),
                      F.col("w.high").alias("highs")))
    found = window_search(index, anchors.join(wanted, "row"), False, negatives)
    return (found.select("anchor", (F.col("window") + 1).alias("place"), "rank",
                         F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(first.select("anchor", F.col("rank").alias("place"),
                               F.col("vec_id").alias("positive_id"),
                               F.col("score").alias("positive_score")), ["anchor", "place"])
            .join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")),
                  "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                    "negative_score"))
