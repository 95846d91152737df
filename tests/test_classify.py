"""Buckets: single cases, a row-by-row model on random data, hot keys."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tallybook import Rules, reconcile, reconcile_summary, summarize
from tallybook.operators.classify import bucket_items, bucket_label, bucket_rank
from tallybook.operators.lookup import SkewPolicy, salted_lookup
from tallybook.schemas import BUCKETS

RECORD = "source_file string, row_no long, uid string, amount string, order_no string, status string"
ENTRY = "commit_seq long, row_no long, uid string, order_no string, amount decimal(38,2), status string"


def records(spark, rows):
    """Rows (row_no, uid, amount[, order[, status[, file]]])."""
    full = []
    for row in rows:
        row_no, uid, amount, order, status, file = (*row, *(None, "正常", "f")[len(row) - 3:])
        full.append((file, row_no, uid, amount, order, status))
    return spark.createDataFrame(full, RECORD)


def entries(spark, rows):
    """Rows (uid, order, amount, status), oldest first."""
    return spark.createDataFrame(
        [(1, i, uid, order, None if amount is None else Decimal(amount), status)
         for i, (uid, order, amount, status) in enumerate(rows)], ENTRY)


def buckets(spark, rows, ledger=(), rules=Rules()):
    items = reconcile(records(spark, rows), entries(spark, ledger), rules).collect()
    return {r["row_no"]: r for r in items}


def test_single_cases(spark):
    got = buckets(spark, [
        (4, "10001", "120"), (5, None, "30"), (6, "  ", "30"), (7, "1", "5", "O1"),
        (8, "1", "6", "O1"), (9, "1", "7", "O2"), (10, "20001", "300", "ORD-8001"),
        (11, "10003", "58", "ORD-9007"), (12, "10004", "待定"), (13, "10005", "66.6", None, "异常-退款"),
        (14, "10007", "1234.567"), (15, None, "30")],
        [("20001", "ORD-8001", "300", "settled"), ("10003", "ORD-9007", "50", "pending")])
    want = {4: "to_settle", 5: "missing_uid", 6: "missing_uid", 7: "to_settle",
            8: "duplicate_in_batch", 9: "to_settle", 10: "already_settled", 11: "amount_mismatch",
            12: "manual_review", 13: "manual_review", 14: "to_settle", 15: "missing_uid"}
    assert {k: v["bucket"] for k, v in got.items()} == want
    assert str(got[4]["amount"]) == "120.00" and str(got[14]["amount"]) == "1234.57"
    assert got[8]["first_row"] == 7 and "row 7;" in got[8]["reason"]
    assert str(got[11]["ref_amount"]) == "50.00" and "58.00" in got[11]["reason"]
    assert got[12]["reason_code"] == "amount_unreadable" and "待定" in got[12]["reason"]
    assert got[13]["reason_code"] == "status_flagged" and "contains 异常;" in got[13]["reason"]
    assert str(got[5]["amount"]) == "30.00" and got[5]["first_row"] is None


def test_tolerance_is_strict(spark):
    ledger = [("1", "", "50.00", "pending")]
    assert buckets(spark, [(4, "1", "50.005")], ledger)[4]["bucket"] == "to_settle"
    assert buckets(spark, [(4, "1", "50.015")], ledger)[4]["bucket"] == "amount_mismatch"
    assert str(buckets(spark, [(4, "1", "50.005")], ledger)[4]["ref_amount"]) == "50.00"


@pytest.mark.parametrize("order,ledger,bucket,ref", [
    ("A", [("1", "A", "9", "settled")], "already_settled", None),
    ("A", [("1", "B", "9", "settled")], "to_settle", None),
    ("A", [("1", "", "9", "settled")], "already_settled", None),
    (None, [("1", "B", "9", "settled")], "already_settled", None),
    ("A", [("1", "A", "9", "quote"), ("1", "", "5", "pending")], "to_settle", "5.00"),
    ("A", [("1", "", "9", "quote"), ("1", "A", "5", "pending")], "to_settle", "5.00"),
    ("A", [("1", "A", "5", "quote"), ("1", "B", "9", "pending")], "to_settle", "5.00"),
    (None, [("1", "A", "9", "quote"), ("1", "B", "5", "pending")], "to_settle", "5.00"),
    ("A", [("1", "A", "9", "quote"), ("1", "A", None, "quote")], "to_settle", None),
    ("A", [("1", "A", "9", "other")], "to_settle", None),
    ("A", [("2", "A", "9", "settled")], "to_settle", None),
])
def test_order_wildcards_and_newest_reference(spark, order, ledger, bucket, ref):
    item = buckets(spark, [(4, "1", "5", order)], ledger)[4]
    assert (item["bucket"], item["ref_amount"] and str(item["ref_amount"])) == (bucket, ref)


def test_first_row_blocks_even_when_it_is_bad(spark):
    got = buckets(spark, [(4, "1", "待定", "A"), (5, "1", "9", "A")])
    assert [got[4]["bucket"], got[5]["bucket"]] == ["manual_review", "duplicate_in_batch"]


def test_repeats_are_judged_per_file(spark):
    got = reconcile(records(spark, [(4, "1", "1", "A", "", "f"), (4, "1", "1", "A", "", "g")]),
                    entries(spark, []))
    assert [r["bucket"] for r in got.collect()] == ["to_settle"] * 2


def test_optional_columns_and_typed_input(spark):
    df = spark.createDataFrame([(1, 10002.0, 45.0), (2, 10003.5, None)], "row_no int, uid double, amount double")
    got = {r["row_no"]: r for r in reconcile(df, entries(spark, [])).collect()}
    assert (got[1]["uid"], got[1]["bucket"], got[2]["bucket"]) == ("10002", "to_settle", "manual_review")
    with pytest.raises(ValueError):
        reconcile(df.drop("amount"), entries(spark, []))


def test_text_amounts_in_a_foreign_ledger(spark):
    ledger = spark.createDataFrame([("1", None, "¥5.00", "pending", 1), ("2", "A", "??", "quote", 2)],
                                   "uid string, order_no string, amount string, status string, row_no int")
    got = {r["uid"]: r for r in reconcile(records(spark, [(1, "1", "9", "A"), (2, "2", "9", "A")]),
                                          ledger).collect()}
    assert got["1"]["bucket"] == "amount_mismatch" and got["2"]["bucket"] == "to_settle"


# ------------------------------------------------ against a row-by-row model

def model(rows, ledger, rules):
    """What a clerk does with one file at a time: (file, row) -> bucket, ref, first."""
    cents = Decimal(1).scaleb(-rules.amount_places)
    rounded = lambda d: d.quantize(cents, rounding=ROUND_HALF_UP)
    first, out = {}, {}
    for row_no, uid, amount, order, status, file in rows:
        known = [e for e in ledger if e[0] == uid and (not order or e[1] in (order, ""))]
        refs = [e[2] for e in known if e[3] in ("pending", "quote")]
        value = None if amount == "?" else rounded(Decimal(amount))
        bucket, ref = "to_settle", None
        if uid is None:
            bucket = "missing_uid"
        elif (file, uid, order or "") in first:
            bucket = "duplicate_in_batch"
        else:
            first[file, uid, order or ""] = row_no
            if any(e[3] == "settled" for e in known):
                bucket = "already_settled"
            elif value is None or "冻结" in status:
                bucket = "manual_review"
            elif refs and refs[-1] is not None:
                ref = rounded(Decimal(refs[-1]))
                if abs(value - ref) > rules.amount_tolerance:
                    bucket = "amount_mismatch"
        out[file, row_no] = (bucket, ref, None if uid is None else first[file, uid, order or ""])
    return out


def random_case(seed):
    rnd = random.Random(seed)
    pick_uid = lambda: rnd.choice(["1", "1", "1", "2", "3", "4", "5", None])
    order = lambda: rnd.choice([None, "A", "B", "C"])
    amount = lambda: rnd.choice(["5", "5.004", "5.005", "5.015", "9", "?"])
    rows = [(i, pick_uid(), amount(), order(), rnd.choice(["正常"] * 5 + ["冻结"]), rnd.choice("fg"))
            for i in range(300)]
    ledger = [(pick_uid() or "6", order() or "", rnd.choice(["5.00", "5.01", "9.00", None]),
               rnd.choice(["settled", "pending", "quote", "pending", "quote", "x"]))
              for _ in range(seed % 4 * 4)]
    return rows, ledger


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("split_hot", [False, True])
def test_random_batches_match_the_model(spark, seed, split_hot):
    rows, ledger = random_case(seed)
    rules = Rules(anomaly_status_keywords=["冻结"])
    policy = SkewPolicy(hot_rows=5, hot_keys=3)
    r, e = records(spark, rows), entries(spark, ledger)
    items = reconcile(r, e, rules, policy=policy, split_hot=split_hot)
    got = {(i["source_file"], i["row_no"]): (i["bucket"], i["ref_amount"], i["first_row"])
           for i in items.collect()}
    assert got == model(rows, ledger, rules)
    direct = reconcile_summary(r, e, rules, policy=policy, split_hot=split_hot)
    counted = summarize(items, rules)
    assert sorted(direct.collect()) == sorted(counted.collect())
    for s in counted.collect():
        assert s["total_rows"] == sum(s[b] for b in BUCKETS)
    assert sum(s["total_rows"] for s in counted.collect()) == len(rows)


def test_hot_key_does_not_reach_one_task(spark):
    """A third of the rows share one key: the hot path answers them by broadcast."""
    df = spark.range(3000).select(
        F.lit("f").alias("source_file"), F.col("id").alias("row_no"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("uid"),
        F.lit("1").alias("amount"), F.lit("").alias("order_no"))
    items = reconcile(df, entries(spark, []), policy=SkewPolicy(hot_rows=100), split_hot=True)
    shape = items._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in shape
    assert items.filter("bucket = 'duplicate_in_batch'").count() == 999
    assert items.count() == 3000


def test_salted_lookup_beyond_broadcast(spark):
    left = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, v string")
    for policy in (SkewPolicy(salts=7, broadcast_bytes=-1), SkewPolicy()):
        got = salted_lookup(left, right, ["k"], spread_by=["id"], policy=policy)
        assert got.columns == ["k", "id", "v"]
        assert {(r["k"], r["v"]): r["count"] for r in got.groupBy("k", "v").count().collect()} == {
            (0, "a"): 500, (1, "b"): 500}


@pytest.mark.parametrize("limit", [0, 1000])
def test_small_batch_filters_a_large_ledger(spark, tmp_path, limit):
    rows, ledger = random_case(3)
    batch = [r for r in rows if r[1] in ("2", "3", None)]
    entries(spark, ledger).write.parquet(str(tmp_path / "l"))
    big = spark.read.parquet(str(tmp_path / "l"))
    records(spark, batch).write.parquet(str(tmp_path / "b"))
    small = spark.read.parquet(str(tmp_path / "b"))
    policy = SkewPolicy(small_input=1, ledger_ratio=0, broadcast_uids=limit)
    rules = Rules(anomaly_status_keywords=["冻结"])
    assert policy.ledger_dwarfs(small, big)
    items = reconcile(small, big, rules, policy=policy)
    got = {(i["source_file"], i["row_no"]): (i["bucket"], i["ref_amount"], i["first_row"])
           for i in items.collect()}
    assert got == model(batch, ledger, rules)
    direct = reconcile_summary(small, big, rules, policy=policy)
    assert sorted(direct.collect()) == sorted(summarize(items, rules).collect())


def test_shuffles_grow_with_the_input(spark, conf, monkeypatch):
    from tallybook import session

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    conf(key, "4")
    df = spark.range(10)
    with session.sized_shuffles(spark, df):
        assert spark.conf.get(key) == "4"
    monkeypatch.setattr(session, "input_bytes", lambda df: 100 << 40)
    with session.sized_shuffles(spark, df):
        assert spark.conf.get(key) == str((100 << 40) // session.SHUFFLE_BYTES)
    assert spark.conf.get(key) == "4"


def test_sizes_that_catalyst_does_not_know(spark, tmp_path):
    from tallybook import session
    from tallybook.sources.ledger import Ledger

    assert session.input_bytes(spark.createDataFrame([], RECORD)) is None
    ledger = Ledger(spark, str(tmp_path / "none"))
    assert ledger.entries().count() == 0 and session.input_bytes(ledger.entries()) < 1 << 20
    assert not SkewPolicy().needed_for(ledger.entries(), ledger.processed())


def test_every_hot_key_is_split_off(spark):
    from tallybook.operators.lookup import hottest

    keys = spark.range(3000).selectExpr("id", "if(id < 2000, 50L, 1L) AS n_rows")
    assert hottest(keys, "n_rows", SkewPolicy(hot_rows=10)).count() == 2000
    few = SkewPolicy(hot_rows=10, hot_share=1000)  # at most a thousand may be hot
    assert hottest(keys, "n_rows", few).count() == 0


def test_bucket_helpers(spark):
    df = spark.createDataFrame([(b,) for b in reversed(BUCKETS)], "bucket string")
    rows = df.select("bucket", bucket_rank(F.col("bucket")).alias("n"),
                     bucket_label(F.col("bucket")).alias("l")).orderBy("n").collect()
    assert [r["bucket"] for r in rows] == list(BUCKETS) and all(r["l"] for r in rows)
    assert bucket_items(df, "to_settle").count() == 1
    with pytest.raises(ValueError):
        bucket_items(df, "nope")
