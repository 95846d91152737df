"""Column layouts shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

FIELDS = ("uid", "amount", "order_no", "date", "name", "status")
REQUIRED_FIELDS = ("uid", "amount")

# Bucket codes in report order, and their display labels.
TO_SETTLE = "to_settle"
ALREADY_SETTLED = "already_settled"
DUPLICATE_IN_BATCH = "duplicate_in_batch"
MISSING_UID = "missing_uid"
AMOUNT_MISMATCH = "amount_mismatch"
MANUAL_REVIEW = "manual_review"
BUCKETS = (TO_SETTLE, ALREADY_SETTLED, DUPLICATE_IN_BATCH,
           MISSING_UID, AMOUNT_MISMATCH, MANUAL_REVIEW)
BUCKET_LABELS = {
    "to_settle": "待结算",
    "already_settled": "已结算跳过",
    "duplicate_in_batch": "批内重复",
    "missing_uid": "缺UID",
    "amount_mismatch": "金额不一致",
    "manual_review": "需人工复核",
}

# Ledger statuses.
SETTLED = "settled"
REFERENCE_STATUSES = ("pending", "quote")

MONEY = T.DecimalType(38, 2)
PARSED = T.DecimalType(38, 18)

# A sheet cell keeps what its source knew about the type:
# null, b(ool), i(nt), f(loat), dt (date and time), d(ate), s(tring).
CELL = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
])
SHEET = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("cells", T.ArrayType(CELL)),
])
ENTRIES = T.StructType([
    T.StructField("commit_seq", T.LongType()),
    T.StructField("file_seq", T.LongType()),
    T.StructField("row_no", T.LongType()),
    T.StructField("uid", T.StringType()),
    T.StructField("order_no", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("status", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
PROCESSED = T.StructType([
    T.StructField("commit_seq", T.LongType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
])
COMMITS = T.StructType([
    T.StructField("commit_seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("n_entries", T.LongType()),
    T.StructField("amount", MONEY),
    T.StructField("committed_at", T.TimestampType()),
])
