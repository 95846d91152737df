import numpy as np
import pytest
from pyspark.sql import functions as F
from tallybook.llm import hardneg

SCHEMA = "vec_id long, label int, vector array<float>"


def brute(rows, anchor=lambda i: i % 5 == 0):
    """What ``hard_negatives`` should give, by loops over Python integers."""
    own = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in rows
           if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, label, v) in enumerate(own):
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, other == label)
                         for m, (j, other, w) in enumerate(own) if m != n))
        for p, pid, _ in [s for s in scored if s[2]][:5]:
            low, high = -50 * p, -95 * p
            good = [s for s in scored if not s[2] and low <= -100 * s[0] <= high]
            out += [(i, pid, k, j, -p, -s) for k, (s, j, _) in enumerate(good[:3], 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, hardneg.hard_negatives(df, F.col("vec_id") % 5 == 0, **options).collect()))


def some_rows(n, width, spread=0.15, groups=12, seed=1):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(groups, width))
    at = pick.integers(0, groups, n)
    rows = centres[at] + spread * pick.normal(size=(n, width))
    return [(i, int(at[i] + i % 3) % 4, [float(x) for x in r]) for i, r in enumerate(rows)]


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BUNDLE_ROWS", (60, 60))
    monkeypatch.setattr(hardneg, "BLOCK", 16)
    rows = some_rows(600, 6)
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(150)]  # one vector many times
    rows += [(7, 1, rows[3][2]), (10, 2, rows[3][2]), (10, 2, rows[3][2])]  # repeated ids
    got = found(spark, rows, sample_rows=200, leaf_rows=20, fan=4)
    assert got == brute(rows)


def test_blocks_of_anchors(spark, monkeypatch):
    rows = some_rows(120, 3, seed=4)
    search = hardneg.window_search
    monkeypatch.setattr(hardneg, "window_search", lambda *a: search(*a, anchor_rows=7))
    assert found(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = some_rows(30, 4) + [
        (100, None, [1.0] * 4), (None, 1, [1.0] * 4), (105, 2, None), (110, 1, [1.0, None, 0.0, 0.0]),
        (115, 1, [nan, 0.0, 0.0, 0.0]), (120, 1, [inf, 0.0, 0.0, 0.0]), (125, 1, []), (130, 2, [0.5]),
        (135, 2, [0.5, 0.25]), (140, 0, [0.0] * 4)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(5, 1, [1.0])]) == []
    assert found(spark, [(5, 1, []), (6, 1, []), (7, 2, [])]) == brute([(5, 1, []), (6, 1, []), (7, 2, [])])


def test_clashing_columns_and_scores_past_53_bits(spark):
    rows = [(i, lab, [x * 1e6 for x in v]) for i, lab, v in some_rows(60, 4, seed=9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "norm", "leaf", "key", "kind", "lows", "anchor", "rank"):
        df = df.withColumn(c, F.lit(1))
    got = hardneg.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_vectors_too_long_for_64_bits(spark):
    df = spark.createDataFrame([(5, 1, [1e30])], SCHEMA)
    with pytest.raises(Exception, match="would pass 64 bits"):
        hardneg.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()


def test_pruning_leaves_out_subtrees():
    pick = np.random.default_rng(2)
    rows = (256 * (pick.normal(size=(8, 5))[pick.integers(0, 8, 500)]
                   + 0.01 * pick.normal(size=(500, 5)))).astype(np.int64)
    norms = (rows * rows).sum(axis=1)
    tree = hardneg.Tree(rows, norms, int(norms.max()), 500, leaf_rows=10, fan=4)

    def seen(node, choice, distances):
        for j in np.unique(choice):
            own = distances[choice == j]
            tree.near[node][:, j] = np.minimum(tree.near[node][:, j], own.min(axis=0))
            tree.far[node][:, j] = np.maximum(tree.far[node][:, j], own.max(axis=0))

    leaf = tree.descend(rows, norms, seen)
    least, most = tree.scores_between(rows.astype(float), norms)
    scores = rows @ rows.T
    assert (scores <= most[:, leaf]).all() and (scores >= least[:, leaf]).all()
    top = np.sort(scores, axis=1)[:, -5]
    assert (most >= top[:, None]).mean() < 0.7
