"""The user-level jobs: scan, map, reconcile, apply, import, query, status."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import order_text
from ..functions.ids import normalize_status, normalize_uid
from ..functions.money import parse_amount
from ..operators.classify import attach_ledger, reconcile, summarize
from ..operators.lookup import SkewPolicy, salted_lookup
from ..operators.sheets import (apply_mapping, detect_headers, load_mapping, resolve_columns,
                                save_mapping, sheet_status, suggest_mapping, validate_mapping)
from ..rules import Rules
from ..schemas import BUCKETS, MONEY, TO_SETTLE
from ..session import counted, materialize, sized_shuffles
from ..sources.audit import append_audit, append_audit_rows, audit_tail
from ..sources.facts import co_located
from ..sources.inbox import (content_hashes, inbox_totals, list_inbox, pending_files,
                             scan_inbox)
from ..sources.ledger import (Commit, Ledger, ledger_stats, payable_entries, processed_lookup,
                              query_ledger)
from ..sources.report import Report, batch_id, read_report
from ..sources.sheets import SheetScan, read_sheets


class ConfirmationRequired(ValueError):
    """Writing to the ledger cannot be undone and needs ``confirmed=True``."""


class AlreadyProcessed(ValueError):
    """Some file's content was settled before; pass ``force=True`` to repeat."""


class NoMapping(ValueError):
    """No column mapping was given or stored."""


class NoData(ValueError):
    """No file gave a single record."""


class UnusableFiles(ValueError):
    """Some file gave no records; the files table of the report says why."""


# ---------------------------------------------------------------- scan, map

def scan(spark: SparkSession, folder: str, ledger: Ledger) -> DataFrame:
    return scan_inbox(spark, folder, ledger.processed())


def suggest(spark: SparkSession, folder: str) -> DataFrame:
    """Suggested mapping of every file; ``status`` says why one has none.

    A file that shows a header has the status ``ok`` here, with data below or not.
    """
    scan_ = read_sheets(spark, folder)
    headers = materialize(detect_headers(scan_.sheets), "headers")
    shown = headers.select("source_file", F.lit(1).alias("n"))
    return sheet_status(scan_.files, headers, shown).select("source_file", "status").join(
        suggest_mapping(headers), "source_file", "left")


def remember_mapping(spark: SparkSession, path: str, *, mapping: Mapping | str | None = None,
                     sheet_file: str | None = None, profile: str = "default",
                     audit_path: str | None = None) -> dict[str, dict]:
    """Store a given mapping, or the one suggested by a sheet, under a profile."""
    if mapping is None:
        if sheet_file is None:
            raise NoMapping("give a mapping or a sheet to take one from")
        hint = suggest(spark, sheet_file).filter(F.col("mapping").isNotNull()).first()
        if hint is None:
            raise NoMapping(f"no header found in {sheet_file}; give a mapping")
        mapping = {f: v.asDict() for f, v in hint["mapping"].items()}
    stored = save_mapping(spark, path, mapping, profile)
    if audit_path:
        append_audit(spark, audit_path, "mapping_saved", mapping=stored)
    return stored


@dataclass(frozen=True)
class FolderRecords:
    """Records of all files of a folder, and what became of each file."""

    records: DataFrame
    status: DataFrame


def folder_records(scan_: SheetScan, mapping: Mapping | str | DataFrame) -> FolderRecords:
    headers = materialize(detect_headers(scan_.sheets), "headers")
    records = apply_mapping(scan_.sheets, resolve_columns(headers, mapping))
    return FolderRecords(records, sheet_status(scan_.files, headers, records))


# ---------------------------------------------------------------- reconcile

def reconcile_folder(spark: SparkSession, folder: str, ledger: Ledger, report_path: str, *,
                     rules: Rules = Rules(), mapping: Mapping | str | DataFrame | None = None,
                     run_at: datetime | None = None, audit_path: str | None = None,
                     on_unusable: str = "report",
                     policy: SkewPolicy = SkewPolicy()) -> Report:
    """Classify every record of a folder and store the report.

    Reads the ledger, writes only the report (and an audit event). Each file
    is a batch of its own: repeats are judged within a file. Every file listed
    gets a row in the report's files table: ``ok``, or why it gave no records.
    ``on_unusable="raise"`` stops at such files once that table is written.
    """
    if on_unusable not in ("raise", "report"):
        raise ValueError("on_unusable is 'raise' or 'report'")
    mapping = mapping if mapping is not None else rules.mapping
    if mapping is None:
        raise NoMapping("give a mapping, or store one with save_mapping")
    if not isinstance(mapping, DataFrame):
        mapping = validate_mapping(mapping)
    run_at = run_at or datetime.now()
    before = materialize(list_inbox(spark, folder), "listing")
    found = folder_records(read_sheets(spark, folder), mapping)
    when = F.lit(run_at.isoformat(sep=" ", timespec="seconds")).cast("timestamp")
    known = json.dumps(mapping, ensure_ascii=False) if isinstance(mapping, Mapping) else None
    files = file_outcomes(spark, folder, before, found.status, ledger).select(
        "source_file", "status", "n_rows", F.col("sha256").alias("file_sha256"),
        batch_id(when, F.col("sha256")).alias("batch_id"), when.alias("generated_at"),
        F.col("processed").alias("already_processed"),
        F.lit(known).cast("string").alias("mapping"))
    files.write.mode("overwrite").parquet(f"{report_path}/files")
    files = spark.read.parquet(f"{report_path}/files")
    if on_unusable == "raise":
        unusable = files.filter("status <> 'ok'").select("source_file", "status").limit(20)
        if bad := [tuple(r) for r in unusable.collect()]:
            raise UnusableFiles(f"no records from {bad}")
    if files.filter("status = 'ok'").isEmpty():
        raise NoData(f"no data rows below any header in {folder}")
    records = found.records
    changed = files.filter(F.col("status") == CHANGED).select("source_file")
    if not changed.isEmpty():
        records = records.join(changed, "source_file", "left_anti")
    read = ledger.last_commit()
    facts = ledger.facts(read)
    files = files.drop("status", "n_rows").withColumn("ledger_commit", F.lit(read).cast("bigint"))
    with sized_shuffles(spark, records, facts), co_located(spark):
        items = reconcile(records, None, rules, policy=policy, facts=facts)
        return store_report(spark, items, files, report_path, rules=rules, audit_path=audit_path)


CHANGED = "changed_while_read"


def file_outcomes(spark: SparkSession, folder, before: DataFrame, status: DataFrame,
                  ledger: Ledger) -> DataFrame:
    """What became of every file, with its hash and whether it was settled before.

    A file that was replaced between its listing and its hash is not the file
    that was read; its rows must not be settled under the new hash.
    """
    hashes = content_hashes(spark, folder).withColumnRenamed("path", "source_file")
    facts = lambda df: df.select(F.col("path").alias("source_file"),
                                 F.struct("length", "modified").alias("facts"))
    after = facts(list_inbox(spark, folder)).withColumnRenamed("facts", "now")
    seen = (facts(before).join(status, "source_file", "left").join(hashes, "source_file", "left")
            .join(after, "source_file", "left"))
    same = F.col("facts").eqNullSafe(F.col("now"))
    return processed_lookup(seen, ledger.processed()).select(
        "source_file", F.when(~same, CHANGED).otherwise(F.col("status")).alias("status"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "sha256", "processed")


def store_report(spark: SparkSession, items: DataFrame, files: DataFrame, path: str, *,
                 rules: Rules = Rules(), audit_path: str | None = None) -> Report:
    """Write items, then the summary counted from what was written.

    ``files`` has (source_file, file_sha256, batch_id, generated_at), and may have
    ledger_commit, the last commit that the items were compared with.
    """
    items.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/items")
    stored = spark.read.parquet(f"{path}/items")
    summary = summarize(stored, rules).join(files, "source_file", "left")
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    report = read_report(spark, path, places=rules.amount_places)
    if audit_path:
        append_audit_rows(report.summary.select(
            "batch_id", "source_file", "file_sha256", "total_rows", *BUCKETS, "to_settle_amount"),
            audit_path, "reconcile_preview")
    return report


# -------------------------------------------------------------------- apply

@dataclass(frozen=True)
class Applied:
    """What one apply did. ``refused`` lists files left out as settled before."""

    commit: Commit | None
    settled_count: int
    settled_amount: Decimal
    refused: DataFrame


def apply_report(report: Report, ledger: Ledger, *, confirmed: bool, force: bool = False,
                 on_processed: str = "raise", recheck: bool = False,
                 applied_at: datetime | None = None,
                 audit_path: str | None = None) -> Applied:
    """Append the payable items of a report to the ledger, once per content.

    A content settled before is refused unless forced: ``on_processed="raise"``
    stops, ``"skip"`` leaves those files out. Two files of one report with the
    same content count once. With ``recheck``, what commits later than the one the
    report was compared with have settled is not paid again; otherwise the ledger
    is not asked whether a payee was settled meanwhile.
    """
    if not confirmed:
        raise ConfirmationRequired("writing to the ledger needs confirmed=True")
    if on_processed not in ("raise", "skip"):
        raise ValueError("on_processed is 'raise' or 'skip'")
    spark = ledger.spark
    at = applied_at or datetime.now()
    when = F.lit(at.isoformat(sep=" ", timespec="seconds")).cast("timestamp")
    files = report.summary.select("source_file", F.col("file_sha256").alias("sha256"), "batch_id")
    # one row per file, so this is small beside the items
    files = materialize(processed_lookup(files, ledger.processed()), "apply-files")
    refused = files.filter("processed")
    if not force and on_processed == "raise":
        names = [r["source_file"] for r in refused.select("source_file").limit(20).collect()]
        if names:
            raise AlreadyProcessed(f"settled before: {names}")
    todo = files if force else files.filter(~F.col("processed"))
    if not force:
        first = todo.groupBy("sha256").agg(F.min("source_file").alias("source_file"))
        todo = todo.join(first, ["sha256", "source_file"], "left_semi")
    batches = todo.select("source_file", "batch_id")
    payable = payable_entries(report.items.filter(F.col("bucket") == TO_SETTLE))
    if recheck:
        payable = not_settled_since(payable, report.summary, ledger)
    entries = salted_lookup(payable, with_file_seq(batches), ["source_file"],
                            spread_by=["row_no"], how="inner").withColumn("created_at", when)
    register = todo.filter(~F.col("processed")).groupBy("sha256").agg(
        F.min(F.struct("source_file", "batch_id")).alias("f")).select(
        "sha256", F.regexp_extract("f.source_file", r"[^/]*\z", 0).alias("filename"),
        F.col("f.batch_id").alias("batch_id"), when.alias("processed_at"))
    if todo.isEmpty():
        return Applied(None, 0, Decimal("0.00"), refused)
    commit = ledger.append("apply", f"apply-{at:%Y%m%d%H%M%S}", entries, at=at, processed=register)
    if audit_path:
        paid = (ledger.entries(commit.commit_seq)
                .filter(F.col("commit_seq") == commit.commit_seq).groupBy("source_file")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")))
        append_audit_rows(todo.join(paid, "source_file", "left").select(
            F.lit(commit.commit_seq).alias("commit_seq"), "batch_id", "source_file", "sha256",
            F.coalesce("n", F.lit(0)).alias("settled_count"),
            F.coalesce("amount", F.lit(0).cast(MONEY)).alias("settled_amount"),
            F.lit(force).alias("forced")), audit_path, "apply_settlement", at=at)
    return Applied(commit, commit.n_entries, commit.amount, refused)


def not_settled_since(payable: DataFrame, summary: DataFrame, ledger: Ledger) -> DataFrame:
    """Payable items without those that were settled after the report was made.

    Only the commits after the oldest one that a file of the report has seen are
    asked; a report that does not say is held against all. Whether an order is
    settled is decided as in ``reconcile``.
    """
    seen = 0
    if "ledger_commit" in summary.columns:
        seen = summary.agg(F.min(F.coalesce("ledger_commit", F.lit(0)))).first()[0] or 0
    last = ledger.last_commit()
    if last <= seen:
        return payable
    later = ledger.entries(last).filter(F.col("commit_seq") > seen)
    rows = payable.withColumn("order_key", F.coalesce("order_no", F.lit("")))
    return attach_ledger(rows, later).filter(~F.col("settled")).select(*payable.columns)


def with_file_seq(files: DataFrame) -> DataFrame:
    """Number files in name order: growing, not gapless, and sorted in parallel."""
    return files.orderBy("source_file").withColumn("file_seq", F.monotonically_increasing_id())


# ------------------------------------------------------------------- import

def history_entries(records: DataFrame, rules: Rules = Rules(), *,
                    default_status: str = "settled") -> DataFrame:
    """Ledger entries of old records, with ``kept`` false where one is unusable.

    An entry needs an id and an amount. Order numbers are read as in
    ``reconcile``, so 9001.0 in a sheet is order 9001 on both sides.
    """
    types = {f.name: f.dataType for f in records.schema.fields}
    col = lambda n: F.col(n) if n in types else F.lit(None).cast("string")
    of = lambda n: types.get(n, T.StringType())
    source = F.col("source_file") if "source_file" in types else F.lit("")
    typed = records.select(
        source.alias("source_file"), F.col("row_no").cast("bigint").alias("row_no"),
        normalize_uid(col("uid"), of("uid"), rules).alias("uid"),
        F.coalesce(order_text(col("order_no"), of("order_no")), F.lit("")).alias("order_no"),
        parse_amount(col("amount"), of("amount")).alias("amount"),
        normalize_status(col("status"), of("status"), default_status).alias("status"))
    return typed.withColumn("kept", F.col("uid").isNotNull() & F.col("amount").isNotNull())


@dataclass(frozen=True)
class Imported:
    commit: Commit
    batch_id: str
    imported: int
    skipped: int
    files: DataFrame | None = None  # of a folder: (source_file, status, n_rows)


def import_history(records: DataFrame, ledger: Ledger, rules: Rules = Rules(), *,
                   default_status: str = "settled", imported_at: datetime | None = None,
                   audit_path: str | None = None) -> Imported:
    """Append old records to the ledger. Importing twice adds them twice.

    The records are read once: cleaned rows are staged, and the job that stages
    them counts the unusable ones.
    """
    at = imported_at or datetime.now()
    batch = f"import-{at:%Y%m%d%H%M%S}"
    cleaned, seen = counted(history_entries(records, rules, default_status=default_status),
                            "history", skipped=F.count_if(~F.col("kept")))
    files = with_file_seq(cleaned.select("source_file").distinct())
    entries = (
        salted_lookup(cleaned.filter("kept"), files, ["source_file"], spread_by=["row_no"])
        .withColumn("source_file", F.regexp_extract("source_file", r"[^/]*\z", 0))
        .withColumn("batch_id", F.lit(batch))
        .withColumn("created_at", F.lit(at.isoformat(sep=" ", timespec="seconds"))
                    .cast("timestamp")))
    commit = ledger.append("import", batch, entries, at=at)
    if audit_path:
        counts = cleaned.groupBy("source_file").agg(
            F.count_if("kept").alias("imported"), F.count_if(~F.col("kept")).alias("skipped"))
        append_audit_rows(counts.select(F.lit(batch).alias("batch_id"), "source_file", "imported",
                                        "skipped"), audit_path, "ledger_imported", at=at)
    return Imported(commit, batch, commit.n_entries, seen["skipped"])


def import_folder(spark: SparkSession, folder: str, ledger: Ledger, mapping: Mapping | str,
                  rules: Rules = Rules(), **options) -> Imported:
    """``import_history`` over the sheets of a folder, with an explicit mapping.

    Files that give no records are not imported; ``files`` says why.
    """
    found = folder_records(read_sheets(spark, folder), validate_mapping(mapping))
    files = materialize(found.status, "outcomes")
    return replace(import_history(found.records, ledger, rules, **options), files=files)


# ------------------------------------------------------------ query, status

def ledger_view(ledger: Ledger, uid: str | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The newest entries and the totals."""
    upto = ledger.last_commit()
    entries = ledger.entries(upto)
    return query_ledger(entries, uid, limit), ledger_stats(entries, ledger.processed(upto))


@dataclass(frozen=True)
class Status:
    """``overview`` is one row of totals; ``pending`` the files still to do;
    ``recent`` the last three audit events."""

    overview: DataFrame
    pending: DataFrame
    recent: DataFrame | None


def status_overview(spark: SparkSession, folder: str, ledger: Ledger, *,
                    mapping_path: str | None = None, profile: str = "default",
                    audit_path: str | None = None) -> Status:
    """Is a mapping stored, what waits in the inbox, what is in the ledger."""
    upto = ledger.last_commit()
    stats = ledger_stats(ledger.entries(upto), ledger.processed(upto)).first().asDict()
    scanned = scan_inbox(spark, folder, ledger.processed(upto))
    ready = bool(mapping_path and load_mapping(spark, mapping_path, profile))
    overview = inbox_totals(scanned).select(
        F.lit(ready).alias("mapping_ready"), "*",
        *[F.lit(value).alias(name) for name, value in stats.items()])
    recent = audit_tail(spark, audit_path, 3) if audit_path else None
    return Status(overview, pending_files(scanned), recent)
