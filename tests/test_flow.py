"""Whole flows: import, reconcile, apply once, force, crash, status, stream."""

import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook import Rules
from tallybook.plans.pipelines import (AlreadyProcessed, ConfirmationRequired, NoData, NoMapping,
                                       apply_report, import_folder, ledger_view, reconcile_folder,
                                       remember_mapping, scan, status_overview, store_report, suggest)
from tallybook.sources.audit import audit_tail
from tallybook.sources.ledger import Ledger, query_ledger
from tallybook.sources.report import (NotAReport, in_report_order, read_report, review_extract,
                                      summary_facts, write_report, write_review)
from tallybook.streaming.inbox_feed import start_inbox_feed
from workload.xlsx import workbook_bytes

# The golden sample, twelve records that show every bucket, and the
# old entries they are compared with. The expected totals belong to these values.
RAW = [["供应链结算日报 2026-07-23"], ["说明：每日发送"],
       ["UID", "昵称", "订单号", "结算金额", "日期", "状态"],
       ["10001", "小七", "ORD-9001", 120.00, "2026-07-22", "正常"],
       [" 10002 ", "阿明", "ORD-9002", 88.50, "2026-07-22", "正常"],
       [10002.0, "阿明", "ORD-9003", 45.00, "2026-07-22", "正常"],
       ["Ｕ10086", "大壮", "ORD-9004", 200.00, "2026-07-22", "正常"],
       ["10001", "小七", "ORD-9001", 120.00, "2026-07-22", "正常"],
       [None, "无名", "ORD-9006", 30.00, "2026-07-22", "正常"],
       ["20001", "老王", "ORD-8001", 300.00, "2026-07-22", "正常"],
       ["10003", "莉莉", "ORD-9007", 58.00, "2026-07-22", "正常"],
       ["10004", "强子", "ORD-9008", "待定", "2026-07-22", "正常"],
       ["10005", "小芳", "ORD-9009", 66.60, "2026-07-22", "异常-退款"],
       ["UID:10006", "老赵", "ORD-9010", 99.90, "2026-07-22", "正常"],
       ["10007", "孙姐", "ORD-9011", 1234.567, "2026-07-22", "正常"]]
HISTORY = [["UID", "订单号", "金额", "状态", "结算日期"], [20001, "ORD-8001", 300.00, "已结算", "2026-07-15"],
           [20002, "ORD-8002", 150.00, "已结算", "2026-07-16"], [10003, "ORD-9007", 50.00, "待定", ""],
           [None, "ORD-1", 1, "待定", ""]]
MAPPING = {"uid": "UID", "amount": "结算金额", "order_no": "订单号", "status": "状态",
           "name": {"column": 1, "header": "昵称"}, "date": "日期"}
OLD_MAPPING = '{"uid": "UID", "order_no": "订单号", "amount": "金额", "status": "状态"}'
RUN_AT = datetime(2026, 7, 23, 10, 0)


@pytest.fixture
def world(spark, tmp_path):
    class World:
        inbox, old = tmp_path / "inbox", tmp_path / "old"
        report, audit, maps = (str(tmp_path / n) for n in ("report", "audit", "maps"))
        ledger = Ledger(spark, str(tmp_path / "ledger"))
        root = tmp_path

    World.inbox.mkdir()
    World.old.mkdir()
    (World.inbox / "raw_2026-07-23.xlsx").write_bytes(workbook_bytes(RAW))
    (World.old / "history.xlsx").write_bytes(workbook_bytes(HISTORY))
    return World


def totals(ledger):
    row = ledger_view(ledger)[1].first()
    return row["entries"], row["settled"], str(row["settled_amount"]), row["processed_files"]


def test_golden_flow(spark, world):
    assert totals(world.ledger) == (0, 0, "0.00", 0)
    done = import_folder(spark, str(world.old), world.ledger, OLD_MAPPING, imported_at=RUN_AT,
                         audit_path=world.audit)
    assert (done.imported, done.skipped, done.batch_id) == (3, 1, "import-20260723100000")
    assert not scan(spark, str(world.inbox), world.ledger).first()["processed"]
    hint = suggest(spark, str(world.inbox)).first()
    assert hint["header_idx"] == 2 and hint["mapping"]["amount"]["column"] == 3

    report = reconcile_folder(spark, str(world.inbox), world.ledger, world.report, mapping=MAPPING,
                              run_at=RUN_AT, audit_path=world.audit)
    s = report.summary.first()
    assert [s[c] for c in ("total_rows", "to_settle", "already_settled", "duplicate_in_batch",
                           "missing_uid", "amount_mismatch", "manual_review")] == [12, 6, 1, 1, 1, 1, 2]
    assert str(s["to_settle_amount"]) == "1787.97"
    assert s["batch_id"] == "20260723-" + s["file_sha256"][:8]
    odd = report.items.filter("bucket = 'amount_mismatch'").first()
    assert (odd["uid"], str(odd["ref_amount"]), odd["row_no"]) == ("10003", "50.00", 11)
    assert "row 4;" in report.items.filter("bucket = 'duplicate_in_batch'").first()["reason"]

    with pytest.raises(ConfirmationRequired):
        apply_report(report, world.ledger, confirmed=False)
    paid = apply_report(report, world.ledger, confirmed=True, audit_path=world.audit)
    assert (paid.settled_count, paid.settled_amount) == (6, Decimal("1787.97"))
    assert totals(world.ledger) == (9, 8, "2237.97", 1)
    mine = query_ledger(world.ledger.entries(), "10001").collect()
    assert [(r["status"], str(r["amount"])) for r in mine] == [("settled", "120.00")]
    assert [r["row_no"] for r in query_ledger(world.ledger.entries(), limit=2).collect()] == [15, 14]

    with pytest.raises(AlreadyProcessed, match="raw_2026"):
        apply_report(report, world.ledger, confirmed=True)
    skipped = apply_report(report, world.ledger, confirmed=True, on_processed="skip")
    assert skipped.settled_count == 0 and skipped.refused.count() == 1
    assert totals(world.ledger) == (9, 8, "2237.97", 1)

    assert scan(spark, str(world.inbox), world.ledger).first()["processed_batch"] == s["batch_id"]
    again = reconcile_folder(spark, str(world.inbox), world.ledger, world.report, mapping=MAPPING)
    assert not s["already_processed"] and again.summary.first()["already_processed"]
    assert again.summary.first()["to_settle"] == 0
    assert again.summary.first()["already_settled"] == 7
    nothing = apply_report(again, world.ledger, confirmed=True, force=True)
    assert nothing.settled_count == 0 and totals(world.ledger) == (9, 8, "2237.97", 1)
    kept = remember_mapping(spark, world.maps, sheet_file=str(world.inbox / "raw_2026-07-23.xlsx"),
                            audit_path=world.audit)
    assert kept["uid"] == {"column": 0, "header": "UID"} and set(kept) == set(MAPPING)
    status = status_overview(spark, str(world.inbox), world.ledger, mapping_path=world.maps,
                             audit_path=world.audit)
    st = status.overview.first()
    assert (st["mapping_ready"], st["inbox_total"], st["inbox_pending"], st["settled"]) == (True, 1, 0, 8)
    assert str(st["settled_amount"]) == "2237.97" and status.pending.count() == 0
    assert status.recent.count() == 3
    assert [r["action"] for r in audit_tail(spark, world.audit).collect()] == [
        "ledger_imported", "reconcile_preview", "apply_settlement", "mapping_saved"]
    facts = [json.loads(r["detail"]) for r in audit_tail(spark, world.audit).collect()]
    assert (facts[0]["imported"], facts[0]["skipped"]) == (3, 1)
    assert facts[0]["source_file"].endswith(".xlsx")
    assert facts[1]["batch_id"] == s["batch_id"] and facts[1]["file_sha256"] == s["file_sha256"]
    assert (facts[1]["total_rows"], facts[1]["to_settle"], facts[1]["manual_review"]) == (12, 6, 2)
    assert (facts[2]["settled_count"], facts[2]["settled_amount"], facts[2]["forced"]) == (
        6, "1787.97", False)
    assert facts[2]["sha256"] == s["file_sha256"] and facts[2]["commit_seq"] == 2


def test_force_appends_again_and_keeps_the_register(spark, world):
    report = reconcile_folder(spark, str(world.inbox), world.ledger, world.report, mapping=MAPPING,
                              run_at=RUN_AT)
    apply_report(report, world.ledger, confirmed=True, applied_at=RUN_AT)
    count, first = totals(world.ledger)[0], world.ledger.processed().first()
    apply_report(report, world.ledger, confirmed=True, force=True)
    assert totals(world.ledger)[0] == 2 * count
    assert world.ledger.processed().count() == 1
    assert world.ledger.processed().first()["processed_at"] == first["processed_at"] == RUN_AT


def test_a_copy_of_a_file_is_paid_once(spark, world):
    (world.inbox / "zz copy.xlsx").write_bytes(workbook_bytes(RAW))
    report = reconcile_folder(spark, str(world.inbox), world.ledger, world.report, mapping=MAPPING)
    assert report.summary.count() == 2
    paid = apply_report(report, world.ledger, confirmed=True)
    assert paid.settled_count == report.summary.orderBy("source_file").first()["to_settle"]
    assert world.ledger.processed().first()["filename"] == "raw_2026-07-23.xlsx"


def test_a_crash_before_the_commit_leaves_nothing(spark, world):
    report = reconcile_folder(spark, str(world.inbox), world.ledger, world.report, mapping=MAPPING)
    half = f"{world.ledger.root}/entries/commit_seq=1"
    spark.range(5).selectExpr("0L file_seq", "id row_no", "'x' uid", "'' order_no",
                              "cast(1 as decimal(38,2)) amount", "'settled' status", "'b' batch_id",
                              "'f' source_file", "'' note", "current_timestamp() created_at"
                              ).write.parquet(half)
    assert totals(world.ledger) == (0, 0, "0.00", 0)
    paid = apply_report(report, world.ledger, confirmed=True)
    assert paid.commit.commit_seq == 1
    assert totals(world.ledger)[0] == paid.settled_count == 8


def test_csv_flow_with_an_extra_keyword(spark, world):
    text = "\n".join([
        "包裹号,成交单号,摘要,应结金额,会员UID,会员称呼,流转状态",
        'P1,"\tT-310",茶杯,12.40,"\t880014",阿岚,完结',
        'P2,"\tT-311",雨伞,35.15,"\t880014",阿岚,完结',
        'P3,"\tT-312",茶杯,12.40,"\t880014",阿岚,作废'])
    folder = world.root / "csv"
    folder.mkdir()
    (folder / "raw.csv").write_bytes(text.encode("utf-8-sig"))
    rules = Rules(anomaly_status_keywords=[*Rules().anomaly_status_keywords, "作废"],
                  mapping={"uid": "会员UID", "amount": "应结金额", "order_no": "成交单号",
                           "status": "流转状态"})
    report = reconcile_folder(spark, str(folder), world.ledger, world.report, rules=rules)
    s = report.summary.first()
    assert (s["to_settle"], str(s["to_settle_amount"]), s["duplicate_in_batch"], s["manual_review"]) == (
        2, "47.55", 0, 1)
    assert {r["uid"] for r in report.items.collect()} == {"880014"}
    assert apply_report(report, world.ledger, confirmed=True).settled_count == 2


def test_refusals(spark, world):
    with pytest.raises(NoMapping):
        reconcile_folder(spark, str(world.inbox), world.ledger, world.report)
    with pytest.raises(NoMapping):
        remember_mapping(spark, world.maps)
    with pytest.raises(ValueError, match="amount"):
        reconcile_folder(spark, str(world.inbox), world.ledger, world.report, mapping={"uid": "UID"})
    with pytest.raises(ValueError, match="amount"):
        import_folder(spark, str(world.old), world.ledger, {"uid": "UID"})
    empty = world.root / "empty"
    empty.mkdir()
    (empty / "a.csv").write_text("uid,金额\n\n")
    with pytest.raises(NoData):
        reconcile_folder(spark, str(empty), world.ledger, world.report, mapping=MAPPING)
    with pytest.raises(NotAReport):
        read_report(spark, str(world.root / "nothing"))
    spark.range(1).write.parquet(f"{world.root}/odd/items")
    with pytest.raises(NotAReport, match="lack"):
        read_report(spark, f"{world.root}/odd")


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_stored_reports_come_back_equal(spark, world, fmt):
    report = reconcile_folder(spark, str(world.inbox), world.ledger, world.report, mapping=MAPPING)
    path = f"{world.root}/copy"
    write_report(report, path, fmt)
    back = read_report(spark, path, fmt)
    cols = sorted(report.items.columns)
    assert sorted(map(str, back.items.select(cols).collect())) == sorted(
        map(str, report.items.select(cols).collect()))
    s, b = report.summary.first(), back.summary.first()
    assert all(b[c] == s[c] for c in ("to_settle", "to_settle_amount", "batch_id", "missing_uid"))


def test_review_tables(spark, world):
    report = reconcile_folder(spark, str(world.inbox), world.ledger, world.report, mapping=MAPPING)
    write_review(report, f"{world.root}/review")
    rows = spark.read.option("header", "true").csv(f"{world.root}/review/items")
    assert rows.count() == 12 and "bucket" in rows.columns
    extract = review_extract(report.items)
    assert extract.filter("bucket = 'missing_uid'").first()["uid"] == ""
    facts = [r["fact"] for r in summary_facts(report.summary).orderBy("fact_no").collect()]
    assert len(facts) == 11 and facts[:3] == ["source_file", "batch_id", "generated_at"]
    order = [r["row_no"] for r in in_report_order(report.items).collect()]
    assert order[0] == 4 and sorted(order) == list(range(4, 16))


def test_stream_feed_takes_each_file_once(spark, world):
    out = f"{world.root}/stream"
    feed = lambda: start_inbox_feed(spark, str(world.inbox), world.ledger, f"{out}/reports",
                                    f"{out}/ck", mapping=MAPPING).awaitTermination()
    feed()
    (world.inbox / "late.csv").write_text("UID,结算金额\n5,6\n")
    feed()
    feed()
    reports = spark.read.parquet(f"{out}/reports/batch=*/summary")
    assert sorted(r["total_rows"] for r in reports.collect()) == [1, 12]


def test_two_files_in_one_commit_keep_their_order(spark, world):
    """The newest reference is the one of the later file, whatever its row."""
    for name, rows in {"a": [["uid", "金额", "状态"], ["x", 0, "待定"], ["1", 7, "待定"]],
                       "b": [["uid", "金额", "状态"], ["1", 9, "待定"]]}.items():
        (world.old / f"{name}.xlsx").write_bytes(workbook_bytes(rows))
    (world.old / "history.xlsx").write_bytes(workbook_bytes(HISTORY[:1]))
    import_folder(spark, str(world.old), world.ledger, {"uid": "uid", "amount": "金额", "status": "状态"})
    folder = world.root / "next"
    folder.mkdir()
    (folder / "n.csv").write_text("uid,金额\n1,9\n")
    items = reconcile_folder(spark, str(folder), world.ledger, world.report,
                             mapping={"uid": "uid", "amount": "金额"}).items
    assert [(r["bucket"], str(r["ref_amount"])) for r in items.collect()] == [("to_settle", "9.00")]


def test_report_of_a_table(spark, world):
    """Records may come from any table; the run header is given alongside."""
    from tallybook import reconcile

    records = spark.createDataFrame([("t", 1, "7", 5.0)], "source_file string, row_no long, uid string, amount double")
    header = spark.createDataFrame([("t", "ab" * 32, "b1", RUN_AT)],
                                   "source_file string, file_sha256 string, batch_id string, generated_at timestamp")
    report = store_report(spark, reconcile(records, world.ledger.entries()), header, world.report)
    paid = apply_report(report, world.ledger, confirmed=True)
    assert paid.settled_amount == Decimal("5.00")
    assert world.ledger.entries().agg(F.max("batch_id")).first()[0] == "b1"
