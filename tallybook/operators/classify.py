"""Put every record in exactly one of six buckets.

Priority: missing id, repeat inside its file, already settled, unreadable
amount or flagged status, amount differs from the ledger's reference, payable.

The ledger is asked once per distinct (file, uid, order) and not once per row:
only the first row of a key can get that far. ``key_facts`` therefore folds the
records to keys with map-side partial aggregates (a hot key costs one row per
task), the lookups run on these narrow keys, and only a caller who wants the
items themselves pays for one join back to the wide rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import cell_text, order_text
from ..functions.ids import first_keyword, normalize_uid
from ..functions.money import parse_amount, round_amount
from ..functions.text import blank_to_null
from ..rules import Rules
from ..schemas import (ALREADY_SETTLED, AMOUNT_MISMATCH, BUCKET_LABELS, BUCKETS,
                       DUPLICATE_IN_BATCH, MANUAL_REVIEW, MISSING_UID, PARSED,
                       REFERENCE_STATUSES, SETTLED, TO_SETTLE)
from ..session import materialize
from .lookup import SkewPolicy, hottest, hottest_values, unique_lookup

KEY = ["uid", "order_key", "source_file"]

ITEM_COLUMNS = ["source_file", "row_no", "bucket", "reason_code", "reason", "uid", "raw_uid",
                "order_no", "amount", "raw_amount", "ref_amount", "date", "name", "first_row"]


# ------------------------------------------------------------------ records

def clean_records(records: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Raw records to typed ones; absent optional fields count as missing."""
    types = {f.name: f.dataType for f in records.schema.fields}
    if "row_no" not in types:
        raise ValueError("records need a row_no column")
    missing = [f for f in ("uid", "amount") if f not in types]
    if missing:
        raise ValueError(f"records need the columns {missing}")
    col = lambda n: F.col(n) if n in types else F.lit(None).cast("string")
    of = lambda n: types.get(n, T.StringType())
    source = F.col("source_file") if "source_file" in types else F.lit("")
    typed = records.select(
        source.alias("source_file"),
        F.col("row_no").cast("bigint").alias("row_no"),
        normalize_uid(col("uid"), of("uid"), rules).alias("uid"),
        cell_text(col("uid"), of("uid")).alias("raw_uid"),
        order_text(col("order_no"), of("order_no")).alias("order_no"),
        parse_amount(col("amount"), of("amount")).alias("amount"),
        cell_text(col("amount"), of("amount")).alias("raw_amount"),
        cell_text(col("status"), of("status")).alias("status_text"),
        cell_text(col("date"), of("date")).alias("date"),
        cell_text(col("name"), of("name")).alias("name"),
    )
    return typed.withColumns({
        "amount": round_amount(F.col("amount"), rules.amount_places, rules.rounding),
        "order_key": F.coalesce("order_no", F.lit("")),
        "keyword": first_keyword(F.col("status_text"), rules.review_keywords),
    })


def key_facts(cleaned: DataFrame) -> DataFrame:
    """One row per (file, uid, order): its first row and how many rows it has.

    All rows without a uid of one file share one key. Every buffer is a
    fixed-width primitive, so the partial step is a hash aggregate.
    """
    return (
        cleaned.select("source_file", "uid", "row_no", "amount",
                       F.when(F.col("uid").isNotNull(), F.col("order_key")).otherwise("")
                       .alias("order_key"),
                       F.col("keyword").isNotNull().alias("flagged"))
        .groupBy(*KEY)
        .agg(F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("n_rows"),
             F.min_by("amount", "row_no").alias("amount"),
             F.min_by("flagged", "row_no").alias("flagged"))
    )


# ------------------------------------------------------------------- ledger

def entry_order(commit_seq: Column, file_seq: Column, row_no: Column) -> Column:
    """Ledger age as one sortable decimal: commit, file in it, row in that.

    8, 17 and 13 digits. A decimal is a fixed-width aggregation buffer, where
    a struct would force a sort-based aggregate.
    """
    wide = lambda c, p: F.coalesce(c, F.lit(0)).cast(f"decimal({p},0)")
    return (wide(commit_seq, 8) * F.lit(Decimal(10**30))
            + wide(file_seq, 17) * F.lit(Decimal(10**13))
            + wide(row_no, 13)).cast("decimal(38,0)")


def ledger_columns(entries: DataFrame, keep: list[str] = []) -> DataFrame:
    """Entries from any table: needs uid and status, fills in the rest."""
    types = {f.name: f.dataType for f in entries.schema.fields}
    zero = F.lit(0).cast("bigint")
    get = lambda n, d: F.col(n) if n in types else d
    amount = get("amount", F.lit(None).cast("string"))
    dtype = types.get("amount", T.StringType())
    if not isinstance(dtype, T.DecimalType):
        amount = parse_amount(amount, dtype)
    return entries.select(
        *keep, F.col("uid"), F.coalesce(get("order_no", F.lit("")), F.lit("")).alias("order_key"),
        amount.cast(PARSED).alias("amount"), F.col("status"),
        entry_order(get("commit_seq", zero), get("file_seq", zero),
                    get("row_no", zero)).alias("age"))


def ledger_by_order(entries: DataFrame, within: list[str] = []) -> DataFrame:
    """Per (uid, order): is it settled, and the newest reference amount.

    When the newest reference is unreadable its NULL amount wins: there is no
    falling back to an older one. ``within`` are columns to keep apart, too.
    """
    is_ref = F.col("status").isin(*REFERENCE_STATUSES)
    return (
        ledger_columns(entries, within)
        .filter((F.col("status") == SETTLED) | is_ref)
        .groupBy(*within, "uid", "order_key")
        .agg(F.bool_or(F.col("status") == SETTLED).alias("settled"),
             F.max_by("amount", F.when(is_ref, F.col("age"))).alias("ref"),
             F.max(F.when(is_ref, F.col("age"))).alias("ref_age"))
    )


def ledger_by_uid(by_order: DataFrame) -> DataFrame:
    """Per uid: facts over all its entries, and over those without an order."""
    blank = F.col("order_key") == ""
    return by_order.groupBy("uid").agg(
        F.bool_or("settled").alias("any_settled"),
        F.max_by("ref", "ref_age").alias("any_ref"),
        F.bool_or(F.col("settled") & blank).alias("blank_settled"),
        F.max_by("ref", F.when(blank, F.col("ref_age"))).alias("blank_ref"),
        F.max(F.when(blank, F.col("ref_age"))).alias("blank_age"),
    )


def attach_ledger(keys: DataFrame, entries: DataFrame | None, *,
                  facts: DataFrame | None = None,
                  hot_uids: DataFrame | None = None) -> DataFrame:
    """``keys`` (uid, order_key, source_file, ...) plus ``settled`` and ``ref``.

    An entry without an order number stands for any order of its uid, and a
    record without one is matched by any entry. Written as an OR this is one
    join on uid that fans out; as two lookups it is at most one row per key.
    ``hot_uids``, a bounded table, are answered by broadcast. ``facts`` are those
    the ledger keeps (``Ledger.facts``); then no entry is read.
    """
    by_order = ledger_by_order(entries) if facts is None else facts
    by_uid = ledger_by_uid(by_order)
    hot = None
    if hot_uids is not None:
        hot = by_uid.join(F.broadcast(hot_uids), "uid", "left_semi")
    exact = unique_lookup(keys, by_order, ["uid", "order_key"],
                          spread_by=["source_file", "order_key"],
                          values=["settled", "ref", "ref_age"])
    both = unique_lookup(exact, by_uid, ["uid"], spread_by=["source_file", "order_key"],
                         values=["any_settled", "any_ref", "blank_settled", "blank_ref",
                                 "blank_age"], hot=hot)
    blank = F.col("order_key") == ""
    none = F.lit(-1).cast("decimal(38,0)")
    exact_newer = F.coalesce("ref_age", none) >= F.coalesce("blank_age", none)
    settled = F.when(blank, F.col("any_settled")).otherwise(
        F.coalesce("settled", F.lit(False)) | F.coalesce("blank_settled", F.lit(False)))
    ref = F.when(blank, F.col("any_ref")).when(exact_newer, F.col("ref")).otherwise(
        F.col("blank_ref"))
    return both.select(*keys.columns, F.coalesce(settled, F.lit(False)).alias("settled"),
                       ref.alias("ref"))


def relevant_entries(cleaned: DataFrame, entries: DataFrame, *,
                     policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Entries that can matter to this batch.

    A day's batch against years of ledger: when the batch is small beside the
    ledger, its distinct ids, counted first, filter the ledger scan, so that
    the rest of the ledger is neither aggregated nor shuffled.
    """
    uids = materialize(
        cleaned.filter(F.col("uid").isNotNull()).select("uid").distinct(), "batch-uids")
    if uids.count() > policy.broadcast_uids:
        return entries
    return entries.join(F.broadcast(uids), "uid", "left_semi")


# ------------------------------------------------------------------ buckets

def exceeds(amount: Column, ref: Column, rules: Rules) -> Column:
    """Do two rounded amounts differ by more than the tolerance?"""
    return F.abs(amount - ref) > F.lit(rules.amount_tolerance)


def bucket_of(*, uid: Column, is_first: Column, settled: Column, amount: Column,
              flagged: Column, ref: Column, rules: Rules) -> Column:
    return (
        F.when(uid.isNull(), MISSING_UID)
        .when(~is_first, DUPLICATE_IN_BATCH)
        .when(settled, ALREADY_SETTLED)
        .when(amount.isNull() | flagged, MANUAL_REVIEW)
        .when(ref.isNotNull() & exceeds(amount, ref, rules), AMOUNT_MISMATCH)
        .otherwise(TO_SETTLE)
    )


def classified_keys(cleaned: DataFrame, entries: DataFrame | None, rules: Rules, *,
                    policy: SkewPolicy, split_hot: bool,
                    facts: DataFrame | None = None) -> DataFrame:
    """Key facts plus ledger facts, and the bucket of each key's first row.

    The sketch of frequent uids reads the one column; it needs no shuffle.
    """
    hot_uids = hottest_values(cleaned, "uid", policy) if split_hot else None
    known = attach_ledger(key_facts(cleaned), entries, facts=facts, hot_uids=hot_uids)
    known = known.withColumn("ref", round_amount(F.col("ref"), rules.amount_places, rules.rounding))
    return known.withColumn("bucket", bucket_of(
        uid=F.col("uid"), is_first=F.lit(True), settled=F.col("settled"),
        amount=F.col("amount"), flagged=F.col("flagged"), ref=F.col("ref"), rules=rules))


def _reason(rules: Rules) -> tuple[Column, Column]:
    """Our own message code and the sentence rendered from it."""
    bucket = F.col("bucket")
    unreadable = F.col("amount").isNull()
    code = (
        F.when(bucket == MANUAL_REVIEW,
               F.when(unreadable, "amount_unreadable").otherwise("status_flagged"))
        .otherwise(bucket))
    shown = F.coalesce(blank_to_null(F.col("raw_amount")), F.lit("blank"))
    text = (
        F.when(bucket == MISSING_UID, F.lit("no valid payee id; fill it in by hand"))
        .when(bucket == DUPLICATE_IN_BATCH,
              F.concat(F.lit("same payee and order as row "), F.col("first_row").cast("string"),
                       F.lit("; only the first is paid")))
        .when(bucket == ALREADY_SETTLED, F.lit("the ledger has this payee and order as settled"))
        .when((bucket == MANUAL_REVIEW) & unreadable,
              F.concat(F.lit("amount missing or unreadable: "), shown))
        .when(bucket == MANUAL_REVIEW,
              F.concat(F.lit("status "), F.col("status_text"), F.lit(" contains "),
                       F.col("keyword"), F.lit("; confirm by hand")))
        .when(bucket == AMOUNT_MISMATCH,
              F.concat(F.lit("amount "), F.col("amount").cast("string"),
                       F.lit(" differs from ledger reference "),
                       F.col("ref_amount").cast("string"),
                       F.lit(f" by more than {rules.amount_tolerance}")))
        .otherwise(F.lit("payable now")))
    return code, text


def reconcile(records: DataFrame, entries: DataFrame | None, rules: Rules = Rules(), *,
              policy: SkewPolicy = SkewPolicy(), split_hot: bool | None = None,
              facts: DataFrame | None = None) -> DataFrame:
    """Items: every record with its bucket, reason and reference amount.

    ``row_no`` must be unique within a ``source_file`` (sheet rows are); it
    decides which of several equal rows is the first.

    ``split_hot`` None decides by the size of the input. When hot keys are
    split off, the key table is written once to the shared folder and read
    back, so that neither the lookups nor the aggregate run twice. With the
    ledger's own ``facts``, ``entries`` are not read and may be None.
    """
    if split_hot is None:
        split_hot = policy.needed_for(records, entries if facts is None else facts)
    cleaned = clean_records(records, rules)
    if facts is None and policy.ledger_dwarfs(records, entries):
        entries = relevant_entries(cleaned, entries, policy=policy)
    with_uid = cleaned.filter(F.col("uid").isNotNull())
    keys = classified_keys(with_uid, entries, rules, policy=policy, split_hot=split_hot,
                           facts=facts)
    known = keys.select(*KEY, "first_row", "n_rows", "settled", "ref")
    hot = None
    if split_hot:
        known = materialize(known, "key-facts")
        hot = hottest(known, "n_rows", policy)
    rows = unique_lookup(cleaned, known, KEY, spread_by=["source_file", "row_no"],
                         values=["first_row", "settled", "ref"], hot=hot)
    rows = rows.withColumn("bucket", bucket_of(
        uid=F.col("uid"), is_first=F.col("row_no") == F.col("first_row"),
        settled=F.col("settled"), amount=F.col("amount"),
        flagged=F.col("keyword").isNotNull(), ref=F.col("ref"), rules=rules))
    rows = rows.withColumn(
        "ref_amount", F.when(F.col("bucket").isin(TO_SETTLE, AMOUNT_MISMATCH), F.col("ref")))
    code, text = _reason(rules)
    return rows.select(
        *[{"reason_code": code.alias("reason_code"), "reason": text.alias("reason")}.get(c, F.col(c))
          for c in ITEM_COLUMNS])


# ------------------------------------------------------------------ summary

def _money_sum(amount: Column, rules: Rules) -> Column:
    zero = F.lit(0).cast(T.DecimalType(38, rules.amount_places))
    return round_amount(F.coalesce(F.sum(amount), zero), rules.amount_places, rules.rounding)


def summarize(items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per file: total, count per bucket (zeros kept), payable total."""
    count = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    payable = F.when(F.col("bucket") == TO_SETTLE, F.col("amount"))
    return items.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("total_rows"), count(TO_SETTLE),
        _money_sum(payable, rules).alias("to_settle_amount"),
        *[count(b) for b in BUCKETS if b != TO_SETTLE])


def reconcile_summary(records: DataFrame, entries: DataFrame, rules: Rules = Rules(), *,
                      policy: SkewPolicy = SkewPolicy(),
                      split_hot: bool | None = None) -> DataFrame:
    """``summarize(reconcile(...))`` without building the items.

    Rows after a key's first are duplicates by definition, so counts follow
    from the key table alone and the wide rows are never shuffled.
    """
    if split_hot is None:
        split_hot = policy.needed_for(records, entries)
    cleaned = clean_records(records, rules)
    if policy.ledger_dwarfs(records, entries):
        entries = relevant_entries(cleaned, entries, policy=policy)
    keys = classified_keys(cleaned, entries, rules, policy=policy, split_hot=split_hot)
    known = F.col("uid").isNotNull()
    first_in = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    columns = {
        TO_SETTLE: first_in(TO_SETTLE),
        ALREADY_SETTLED: first_in(ALREADY_SETTLED),
        DUPLICATE_IN_BATCH: F.coalesce(F.sum(F.when(known, F.col("n_rows") - 1)), F.lit(0))
        .alias(DUPLICATE_IN_BATCH),
        MISSING_UID: F.coalesce(F.sum(F.when(~known, F.col("n_rows"))), F.lit(0))
        .alias(MISSING_UID),
        AMOUNT_MISMATCH: first_in(AMOUNT_MISMATCH),
        MANUAL_REVIEW: first_in(MANUAL_REVIEW),
    }
    payable = F.when(F.col("bucket") == TO_SETTLE, F.col("amount"))
    return keys.groupBy("source_file").agg(
        F.sum("n_rows").alias("total_rows"), columns.pop(TO_SETTLE),
        _money_sum(payable, rules).alias("to_settle_amount"), *columns.values())


def bucket_items(items: DataFrame, bucket: str) -> DataFrame:
    """The items of one bucket; a partition filter on stored reports."""
    if bucket not in BUCKETS:
        raise ValueError(f"unknown bucket {bucket!r}")
    return items.filter(F.col("bucket") == bucket)


def bucket_label(bucket: Column) -> Column:
    return F.try_element_at(
        F.create_map(*[F.lit(x) for pair in BUCKET_LABELS.items() for x in pair]), bucket)


def bucket_rank(bucket: Column) -> Column:
    return F.array_position(F.lit(list(BUCKETS)), bucket)
