"""The registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.cells import cell_text
from tallybook.functions.ids import first_keyword, normalize_status, normalize_uid
from tallybook.functions.money import parse_amount, round_amount
from tallybook.operators.classify import (attach_ledger, bucket_items, clean_records, exceeds,
                                          key_facts, reconcile, reconcile_summary, summarize)
from tallybook.operators.sheets import (apply_mapping, detect_headers, resolve_columns,
                                        suggest_mapping)
from tallybook.plans import pipelines
from tallybook.plans.pipelines import (apply_report, folder_records, history_entries,
                                       import_history, reconcile_folder, store_report)
from tallybook.rules import Rules
from tallybook.schemas import FIELDS, MISSING_UID
from tallybook.session import materialize, scratch_path
from tallybook.sources import audit
from tallybook.sources.facts import co_located
from tallybook.sources.inbox import content_hashes, list_inbox, pending_files, scan_inbox
from tallybook.sources.ledger import Ledger, ledger_stats, query_ledger
from tallybook.sources.report import (Report, batch_id, read_report, review_extract, short_hash,
                                      summary_facts, write_report)
from tallybook.sources.sheets import read_sheets
from tallybook.streaming.inbox_feed import start_inbox_feed

from . import derive
from .xlsx import workbook_bytes

RUN_AT = datetime(2024, 7, 23, 10, 0)
ITEM_VALUES = ["row_no", "bucket", "reason_code", "reason", "uid", "raw_uid", "order_no", "amount",
               "raw_amount", "ref_amount", "date", "name", "first_row"]


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    return derive.events_batch(spark, sf)


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return derive.events_ledger(spark, sf)


def _items(spark: SparkSession, sf: str, rules: Rules = Rules()) -> DataFrame:
    return reconcile(_batch(spark, sf), _entries(spark, sf), rules)


# -------------------------------------------------------- scalar functions

def uid_clean(spark, sf):
    return _batch(spark, sf).select("row_no", normalize_uid(F.col("uid")).alias("uid"))


def uid_regex(spark, sf):
    rules = Rules(uid_regex="[0-9]{2}")
    return _batch(spark, sf).select("row_no", normalize_uid(F.col("uid"), rules=rules).alias("uid"))


def uid_numeric(spark, sf):
    """Ids held as numbers, as a spreadsheet does."""
    price = F.col("o_totalprice")
    return derive.table(spark, sf, "orders").select(
        "o_orderkey", normalize_uid(F.col("o_custkey").cast("double"), T.DoubleType()).alias("whole"),
        normalize_uid(price, T.DoubleType()).alias("fraction"),
        normalize_uid(F.col("o_custkey"), T.LongType()).alias("number"))


def status_map(spark, sf):
    kind = F.col("event_type")
    word = (F.when(kind == "view", " 已结算").when(kind == "click", "待定")
            .when(kind == "purchase", "ＳＥＴＴＬＥＤ").when(kind == "error", "报价").otherwise("other"))
    events = derive.table(spark, sf, "events").select(
        F.lit("events").alias("source"), F.col("event_id").alias("id"), word.alias("word"))
    orders = derive.orders_history(spark, sf).select(
        F.lit("orders").alias("source"), F.col("row_no").alias("id"), F.col("status").alias("word"))
    return events.unionByName(orders).select(
        "source", "id", normalize_status(F.col("word"), default="pending").alias("status"))


def amount_parse(spark, sf):
    return _batch(spark, sf).select("row_no", F.col("amount").alias("raw_amount"),
                                    parse_amount(F.col("amount")).alias("amount"))


def _discounts(spark, sf):
    money = F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)")
    return derive.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", money.cast("decimal(38,18)").alias("exact"))


def round_half_up(spark, sf):
    return _discounts(spark, sf).select(
        "l_orderkey", "l_linenumber", round_amount(F.col("exact"), 2).alias("cents"),
        round_amount(F.col("exact"), 0).alias("units"))


def round_half_even(spark, sf):
    return _discounts(spark, sf).select(
        "l_orderkey", "l_linenumber", round_amount(F.col("exact"), 2, "half_even").alias("cents"),
        round_amount(F.col("exact"), 0, "half_even").alias("units"))


def cell_texts(spark, sf):
    orders = derive.table(spark, sf, "orders")
    types = {f.name: f.dataType for f in orders.schema.fields}
    text = lambda c: cell_text(F.col(c), types[c])
    days = orders.select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"),
                         text("o_orderdate").alias("moment"), text("o_totalprice").alias("number"),
                         text("o_orderpriority").alias("label"))
    events = derive.table(spark, sf, "events")
    types.update({f.name: f.dataType for f in events.schema.fields})
    return days.unionByName(events.select(
        F.lit("events").alias("source"), F.col("event_id").alias("id"), text("ts").alias("moment"),
        text("value").alias("number"), text("event_type").alias("label")))


def anomaly_hit(spark, sf):
    status = F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 7 == 0, "/退款")
                      .otherwise(""), F.when(F.col("o_orderkey") % 5 == 0, "/冻结").otherwise(""))
    words = ["冻结", "LOW", "退款", "HIGH"]
    texts = derive.table(spark, sf, "orders").select("o_orderkey", status.alias("status"))
    return texts.withColumn("keyword", first_keyword(F.col("status"), words))


# --------------------------------------------------------- joins, windows

def dup_first(spark, sf):
    """First row and number of rows per (payee, order) of the batch."""
    keys = key_facts(clean_records(_batch(spark, sf)))
    return keys.filter(F.col("uid").isNotNull()).select(
        "uid", F.col("order_key").alias("order_no"), "first_row", "n_rows")


def dup_first_lineitem(spark, sf):
    lines = derive.table(spark, sf, "lineitem").select(
        F.lit("lineitem").alias("source_file"), F.col("l_orderkey").alias("uid"),
        F.col("l_linenumber").alias("order_no"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("row_no"),
        F.col("l_extendedprice").alias("amount"))
    return key_facts(clean_records(lines)).select(
        "uid", F.col("order_key").alias("order_no"), "first_row", "n_rows")


def _ledger_facts(spark, sf):
    keys = key_facts(clean_records(_batch(spark, sf))).filter(F.col("uid").isNotNull())
    return attach_ledger(keys, _entries(spark, sf))


def settled_lookup(spark, sf):
    return _ledger_facts(spark, sf).select("uid", F.col("order_key").alias("order_no"), "settled")


def reference_amount(spark, sf):
    return _ledger_facts(spark, sf).select(
        "uid", F.col("order_key").alias("order_no"), F.col("ref").cast("decimal(38,2)").alias("ref"))


def ledger_facts(spark, sf):
    """The same answers from the facts that three commits have left."""
    entries = _entries(spark, sf)
    ledger = Ledger(spark, scratch_path(spark, "ledger"), fact_buckets=8)
    most = entries.agg(F.max("row_no")).first()[0]
    third = F.least(F.floor(F.col("row_no") * 3 / (most + 1)), F.lit(2))
    for n in range(3):
        ledger.append("import", f"part-{n}", entries.filter(third == n), at=RUN_AT)
    keys = key_facts(clean_records(_batch(spark, sf))).filter(F.col("uid").isNotNull())
    with co_located(spark):
        known = materialize(attach_ledger(keys, None, facts=ledger.facts()), "known")
    return known.select("uid", F.col("order_key").alias("order_no"), "settled",
                        F.col("ref").cast("decimal(38,2)").alias("ref"))


def tolerance(spark, sf):
    rules = Rules(amount_tolerance=Decimal("0.25"))
    known = _ledger_facts(spark, sf).filter(F.col("ref").isNotNull() & F.col("amount").isNotNull())
    ref = round_amount(F.col("ref"))
    return known.select("uid", F.col("order_key").alias("order_no"), "amount", ref.alias("ref"),
                        exceeds(F.col("amount"), ref, rules).alias("differs"))


# -------------------------------------------------------------- reconcile

def missing_uid(spark, sf):
    return bucket_items(_items(spark, sf), MISSING_UID).select("row_no", "raw_uid", "amount", "reason")


def reconcile_items(spark, sf):
    return _items(spark, sf).select(*ITEM_VALUES)


def reconcile_batch_summary(spark, sf):
    return reconcile_summary(_batch(spark, sf), _entries(spark, sf))


def reconcile_rules(spark, sf):
    """Other rules: whole units, half even, a wide tolerance, one keyword."""
    rules = Rules(amount_places=0, rounding="half_even", amount_tolerance="5",
                  anomaly_status_keywords=["正"], uid_prefixes=["UID"])
    return reconcile_summary(_batch(spark, sf), _entries(spark, sf), rules)


def reconcile_lineitem(spark, sf):
    """Line items as a batch of their suppliers, orders as the ledger."""
    lines = derive.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("date").cast("string").substr(1, 7).alias("source_file"),
        # every 37th line lacks its supplier; few suppliers, so orders repeat them
        F.when(F.col("l_partkey") % 37 != 0, F.col("l_suppkey") % 10).alias("uid"),
        F.col("l_orderkey").alias("order_no"),
        # the columns that together tell one line from another
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey"))
         * 100_000 + F.col("l_suppkey")).alias("row_no"),
        F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("status"))
    ledger = derive.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 10).cast("string").alias("uid"),
        F.when(F.col("o_orderkey") % 50 == 0, "").otherwise(F.col("o_orderkey").cast("string"))
        .alias("order_no"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("row_no"),
        F.when(F.col("o_orderstatus") == "F", "settled").otherwise("pending").alias("status"))
    rules = Rules(anomaly_status_keywords=["R"])
    return reconcile_summary(lines, ledger, rules)


def payable_total(spark, sf):
    summary = summarize(_items(spark, sf))
    return summary.select("source_file", "to_settle", "to_settle_amount")


def bucket_extract(spark, sf):
    return review_extract(_items(spark, sf)).drop("source_file")


# --------------------------------------------------- reports, ledger, apply

def _files(spark, sf):
    """The header of a run over the batch: one file."""
    when = F.lit(str(RUN_AT)).cast("timestamp")
    sha = F.sha2(F.lit("events").cast("binary"), 256)
    one = derive.table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"))
    return one.select(F.lit("events").alias("source_file"), sha.alias("file_sha256"),
                      batch_id(when, sha).alias("batch_id"), when.alias("generated_at"))


def _report(spark, sf) -> Report:
    items = materialize(_items(spark, sf), "items")
    return Report(items, summarize(items).join(_files(spark, sf), "source_file"))


def report_roundtrip(spark, sf):
    path = scratch_path(spark, "report")
    report = _report(spark, sf)
    write_report(report, path)
    return read_report(spark, path).items.select(*ITEM_VALUES)


def report_roundtrip_json(spark, sf):
    path = scratch_path(spark, "report")
    write_report(_report(spark, sf), path, "json")
    return read_report(spark, path, "json").items.select(*ITEM_VALUES)


def report_summary(spark, sf):
    facts = summary_facts(_report(spark, sf).summary)
    return facts.select("fact_no", "fact", "value")


def import_rows(spark, sf):
    rows = history_entries(derive.orders_history(spark, sf), default_status="pending")
    return rows.filter("kept").select(
        "row_no", "uid", "order_no", round_amount(F.col("amount"), 2).alias("amount"), "status")


def import_counts(spark, sf):
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    done = import_history(derive.orders_history(spark, sf), ledger, imported_at=RUN_AT)
    return ledger.commits().select(F.col("n_entries").alias("imported"),
                                   F.lit(done.skipped).cast("bigint").alias("skipped"))


def ledger_totals(spark, sf):
    return ledger_stats(derive.events_book(spark, sf), derive.pages_register(spark, sf))


def ledger_query_uid(spark, sf):
    return query_ledger(derive.events_book(spark, sf), "7", 50).select("row_no", "uid", "order_no", "amount",
                                                              "status")


def ledger_recent(spark, sf):
    return query_ledger(derive.events_book(spark, sf), None, 50).select("row_no", "uid", "order_no", "amount",
                                                              "status")


def _applied(spark, sf, force: bool) -> DataFrame:
    """The ledger after a history import and two applies of the same report."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    ledger.append("import", "history", _entries(spark, sf), at=RUN_AT)
    path = scratch_path(spark, "report")
    items = reconcile(_batch(spark, sf), ledger.entries())
    report = store_report(spark, items, _files(spark, sf), path)
    for _ in range(2):
        apply_report(report, ledger, confirmed=True, force=force, on_processed="skip",
                     applied_at=RUN_AT)
    return ledger_stats(ledger.entries(), ledger.processed())


def apply_recheck(spark, sf):
    """Two reports of one ledger state, both applied: with and without a second look."""
    out = None
    for recheck in (False, True):
        ledger = Ledger(spark, scratch_path(spark, "ledger"))
        ledger.append("import", "history", _entries(spark, sf), at=RUN_AT)
        items = materialize(reconcile(_batch(spark, sf), ledger.entries()), "items")
        for name in ("morning", "evening"):
            files = _files(spark, sf).withColumn("file_sha256", F.sha2(F.lit(name), 256)).withColumn(
                "ledger_commit", F.lit(1).cast("bigint"))
            report = store_report(spark, items, files, scratch_path(spark, "report"))
            apply_report(report, ledger, confirmed=True, recheck=recheck, applied_at=RUN_AT)
        stats = ledger_stats(ledger.entries(), ledger.processed()).withColumn(
            "recheck", F.lit(recheck))
        out = stats if out is None else out.unionByName(stats)
    return out


def apply_once(spark, sf):
    return _applied(spark, sf, force=False)


def apply_force(spark, sf):
    return _applied(spark, sf, force=True)


# ------------------------------------------------------------ inbox, sheets

def _write_files(path: str):
    system, root = fs.FileSystem.from_uri(path[len("file:"):] if path.startswith("file:") else path)

    def write(batches):
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(),
                                     batch.column("content").to_pylist()):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    return write


def _folder(spark, files: DataFrame) -> str:
    """Write files (name, content) as they are, for the engine to read."""
    path = scratch_path(spark, "folder")
    files.select("name", "content").mapInArrow(_write_files(path), "name string").agg(
        F.count(F.lit(1))).first()
    return path


def audit_events(spark, sf):
    """What the log says of a report and of applying it, one event per file."""
    log, path = scratch_path(spark, "audit"), scratch_path(spark, "report")
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    items = reconcile(_batch(spark, sf), _entries(spark, sf))
    report = store_report(spark, items, _files(spark, sf), path, audit_path=log)
    apply_report(report, ledger, confirmed=True, applied_at=RUN_AT, audit_path=log)
    facts = ["batch_id", "source_file", "total_rows", "to_settle", "to_settle_amount",
             "settled_count", "settled_amount"]
    return audit.audit_tail(spark, log, 10).select("action", *[
        F.get_json_object("detail", f"$.{f}").alias(f) for f in facts])


def file_facts(spark, sf):
    folder = _folder(spark, derive.page_files(spark, sf))
    when = F.lit(str(RUN_AT)).cast("timestamp")
    return list_inbox(spark, folder).join(content_hashes(spark, folder), "path").select(
        "name", "format", "sha256", short_hash(F.col("sha256")).alias("short_hash"),
        batch_id(when, F.col("sha256")).alias("batch_id"), "size_kb")


def _scanned(spark, sf):
    return scan_inbox(spark, _folder(spark, derive.page_files(spark, sf)),
                      derive.pages_register(spark, sf))


def processed_files(spark, sf):
    return _scanned(spark, sf).select("name", "sha256", "processed", "processed_batch", "warning")


def inbox_pending(spark, sf):
    return pending_files(_scanned(spark, sf)).select("name", "format")


def file_outcomes(spark, sf):
    """Every file of a folder with good and unusable ones, as the report lists it."""
    folder, path = _folder(spark, derive.mixed_files(spark, sf)), scratch_path(spark, "report")
    reconcile_folder(spark, folder, Ledger(spark, scratch_path(spark, "ledger")), path,
                     mapping=FILE_MAPPING, run_at=RUN_AT)
    files = spark.read.parquet(f"{path}/files")
    return files.select(F.regexp_extract("source_file", r"[^/]*\z", 0).alias("name"), "status",
                        "n_rows", "already_processed")


FILE_MAPPING = {"uid": "uid", "amount": "金额"}


def import_outcomes(spark, sf):
    """What an import says of every file of such a folder."""
    done = pipelines.import_folder(
        spark, _folder(spark, derive.mixed_files(spark, sf)),
        Ledger(spark, scratch_path(spark, "ledger")), FILE_MAPPING, imported_at=RUN_AT)
    return done.files.select(F.regexp_extract("source_file", r"[^/]*\z", 0).alias("name"),
                             "status", "n_rows", F.lit(done.imported).alias("imported"),
                             F.lit(done.skipped).alias("skipped"))


def suggest_outcomes(spark, sf):
    """The suggested columns of every file of such a folder, or why it has none."""
    found = pipelines.suggest(spark, _folder(spark, derive.mixed_files(spark, sf)))
    return found.select(F.regexp_extract("source_file", r"[^/]*\z", 0).alias("name"), "status",
                        *[F.try_element_at("mapping", F.lit(f))["column"].cast("bigint")
                          .alias(f"{f}_column") for f in FILE_MAPPING])


def status_overview(spark, sf):
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    ledger.append("import", "history", derive.events_book(spark, sf), at=RUN_AT,
                  processed=derive.pages_register(spark, sf))
    folder = _folder(spark, derive.page_files(spark, sf))
    status = pipelines.status_overview(spark, folder, ledger)
    names = ["entries", "settled", "settled_amount", "processed_files", "inbox_total",
             "inbox_pending"]
    return status.overview.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("fact"), F.col(n).cast("string").alias("value"))
        for n in names])))


def header_detect(spark, sf):
    return detect_headers(derive.document_sheets(spark, sf)).select("source_file", "header_idx", "score")


def mapping_suggest(spark, sf):
    maps = suggest_mapping(detect_headers(derive.document_sheets(spark, sf)))
    return maps.select("source_file", F.explode("mapping").alias("field", "m")).select(
        "source_file", "field", F.col("m.column").alias("column"), F.col("m.header").alias("header"))


def mapping_apply(spark, sf):
    sheets = derive.document_sheets(spark, sf)
    headers = materialize(detect_headers(sheets), "headers")
    columns = resolve_columns(headers, suggest_mapping(headers))
    records = apply_mapping(sheets, columns)
    types = {f.name: f.dataType for f in records.schema.fields}
    return records.select("source_file", "row_no",
                          *[cell_text(F.col(f), types[f]).alias(f) for f in FIELDS])


def mapping_fixed(spark, sf):
    """One mapping for all sheets: a header name, a name with a fallback, an index."""
    sheets = derive.document_sheets(spark, sf)
    mapping = {"uid": "uid", "amount": {"header": "佣金", "column": 1}, "name": {"column": 0},
               "date": {"column": -1}}
    records = apply_mapping(sheets, resolve_columns(detect_headers(sheets), mapping))
    text = lambda f: cell_text(F.col(f), records.schema[f].dataType).alias(f)
    return records.select("source_file", "row_no", text("uid"), text("amount"), text("name"),
                          text("date"))


def audit_tail(spark, sf):
    path = scratch_path(spark, "audit")
    derive.audit_log(spark, sf).orderBy("line_no").select("value").write.text(path)
    return audit.audit_tail(spark, path, 25).select("ts", "action", "detail", "raw")


# ------------------------------------------------------- files end to end

SHEET_COLUMNS = ["uid", "amount", "order_no", "date", "name", "status"]
SHEET_MAPPING = {f: f for f in SHEET_COLUMNS}


def _csv_inbox(spark, sf) -> str:
    path = scratch_path(spark, "inbox")
    (_batch(spark, sf).select(*SHEET_COLUMNS).write.option("header", "true")
     .option("escape", '"').option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").csv(path))
    return path


def _cleaned_folder(spark, path) -> DataFrame:
    found = folder_records(read_sheets(spark, path), SHEET_MAPPING)
    return clean_records(found.records).select("uid", "order_no", "amount", "raw_amount",
                                               "status_text", "name")


def csv_inbox(spark, sf):
    return _cleaned_folder(spark, _csv_inbox(spark, sf))


ROWS_PER_BOOK = 2000


def _write_books(path: str):
    system, root = fs.FileSystem.from_uri(path[len("file:"):] if path.startswith("file:") else path)

    def write(rows: pa.Table) -> pa.Table:
        book = rows.column("book")[0].as_py()
        table = rows.sort_by("row_no").select(SHEET_COLUMNS).to_pylist()
        content = workbook_bytes([["events"], SHEET_COLUMNS] + [list(r.values()) for r in table])
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/book-{book}.xlsx") as out:
            out.write(content)
        return pa.table({"book": [book], "n": [rows.num_rows]})

    return write


def workbook_inbox(spark, sf):
    """Workbooks written by Spark tasks, 2000 records each, and read back."""
    path = scratch_path(spark, "books")
    book = (F.col("row_no") / ROWS_PER_BOOK).cast("bigint")
    written = _batch(spark, sf).withColumn("book", book).groupBy("book").applyInArrow(
        _write_books(path), "book long, n long")
    written.agg(F.sum("n")).first()
    return _cleaned_folder(spark, path)


def inbox_stream(spark, sf):
    """The folder as a stream: totals over the stored reports."""
    folder, out = _csv_inbox(spark, sf), scratch_path(spark, "stream")
    query = start_inbox_feed(spark, folder, Ledger(spark, f"{out}/ledger"), f"{out}/reports",
                             f"{out}/checkpoint", mapping=SHEET_MAPPING)
    query.awaitTermination()
    reports = spark.read.parquet(f"{out}/reports/batch=*/summary")
    return reports.agg(F.sum("total_rows").alias("total_rows"),
                       F.sum(MISSING_UID).alias(MISSING_UID))


QUERIES = {f"q_{f.__name__}": f for f in (
    uid_clean, uid_regex, uid_numeric, status_map, amount_parse, round_half_up, round_half_even,
    cell_texts, anomaly_hit, dup_first, dup_first_lineitem, settled_lookup, reference_amount,
    tolerance, missing_uid, reconcile_items, reconcile_batch_summary, reconcile_rules,
    reconcile_lineitem, payable_total, bucket_extract, report_roundtrip, report_roundtrip_json,
    report_summary, import_rows, import_counts, ledger_totals, ledger_query_uid, ledger_recent,
    apply_once, apply_force, apply_recheck, ledger_facts, audit_events, file_facts, processed_files, inbox_pending, file_outcomes,
    import_outcomes, suggest_outcomes,
    status_overview,
    header_detect, mapping_suggest, mapping_apply, mapping_fixed, audit_tail, csv_inbox,
    workbook_inbox, inbox_stream)}
