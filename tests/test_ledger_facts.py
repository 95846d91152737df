"""Facts kept per commit, the second look before paying, the newest lines of a long log."""

import json
import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook import reconcile
from tallybook.operators.classify import attach_ledger, ledger_by_order
from tallybook.plans.pipelines import apply_report, import_history, store_report
from tallybook.schemas import TO_SETTLE
from tallybook.sources.audit import append_audit, audit_tail, newest_lines
from tallybook.sources.facts import co_located
from tallybook.sources.ledger import Ledger

AT = datetime(2026, 1, 2, 3, 4)
ENTRY = "uid string, order_no string, amount double, status string, row_no long"


def entries(spark, *rows):
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], ENTRY)


def facts_of(df):
    return {(r.uid, r.order_key): (r.settled, r.ref, r.ref_age) for r in df.collect()}


@pytest.fixture
def ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "it's a ledger"), fact_buckets=4)
    ledger.append("import", "a", entries(
        spark, ("u1", "A", 5.0, "settled"), ("u1", "B", 7.0, "pending"), ("u2", None, 1.0, "quote"),
        ("u3", "C", 2.0, "other")), at=AT)
    ledger.append("import", "b", entries(
        spark, ("u1", "B", 8.0, "quote"), ("u2", "", 2.0, "settled"), ("u4", "D", None, "pending")), at=AT)
    ledger.append("import", "c", entries(spark, ("u1", "B", 9.0, "settled")), at=AT)
    return ledger


def test_facts_are_those_of_all_entries(spark, ledger):
    for upto in (1, 2, 3):
        assert facts_of(ledger.facts(upto)) == facts_of(ledger_by_order(ledger.entries(upto)))
    assert facts_of(ledger.facts())["u1", "B"][:2] == (True, Decimal(8))
    assert ("u3", "C") not in facts_of(ledger.facts())
    assert Ledger(spark, ledger.root + "/none").facts().count() == 0


def test_commits_without_facts_get_them(spark, ledger):
    old = Ledger(spark, ledger.root + "-old")
    for table in ("entries", "commits"):
        for n in (1, 2, 3):
            spark.read.parquet(f"{ledger.root}/{table}/commit_seq={n}").write.parquet(
                f"{old.root}/{table}/commit_seq={n}")
    assert facts_of(old.facts()) == facts_of(ledger.facts())
    assert old.fact_table.commits() == {1, 2, 3}


def test_a_crashed_commit_leaves_no_facts(spark, ledger):
    lost = entries(spark, ("u9", "X", 1.0, "settled")).withColumn("commit_seq", F.lit(4).cast("long"))
    ledger.fact_table.add(lost)
    assert ("u9", "X") not in facts_of(ledger.facts())
    ledger.append("import", "d", entries(spark, ("u8", "Y", 1.0, "settled")), at=AT)
    assert ("u9", "X") not in facts_of(ledger.facts()) and ("u8", "Y") in facts_of(ledger.facts())


def test_a_session_that_never_saw_the_ledger(spark, ledger):
    other = spark.newSession()
    spark.sql(f"DROP TABLE {ledger.fact_table.name}")
    again = Ledger(other, ledger.root, fact_buckets=99)  # the ledger's own number holds
    assert again.fact_table.buckets() == 4
    assert facts_of(again.facts()) == facts_of(ledger_by_order(ledger.entries()))


def scan_and_exchanges(plan):
    """(indentation, node) of the file scans and exchanges of a plan, top down."""
    tree = plan.split("(1)")[0] if "(1)" in plan.split("\n")[0] else plan
    return [(len(m[1]), m[2]) for line in tree.split("\n")
            if (m := re.match(r"([\s:+*|-]*)(?:\* )?(Exchange|Scan parquet|FileScan parquet)", line))]


def test_a_batch_meets_the_ledger_without_moving_it(spark, ledger, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    merged = ledger.facts()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in merged and "Bucketed: true" in merged
    keys = spark.createDataFrame(
        [("u1", "B", "f"), ("u2", "Z", "f"), ("u1", "", "f"), ("u9", "Q", "f")],
        "uid string, order_key string, source_file string")
    with co_located(spark):
        known = attach_ledger(keys, None, facts=ledger.facts())
        plan = known._jdf.queryExecution().executedPlan().toString()
        rows = {(r.uid, r.order_key): (r.settled, r.ref) for r in known.collect()}
    moved = [line for line in plan.split("\n") if "Exchange" in line]
    assert plan.count("Bucketed: true") == 2 and moved
    assert all("_probe" in line for line in moved)  # only the batch's keys are dealt out
    lines = plan.split("\n")
    for n, line in enumerate(lines):
        if "FileScan" in line:
            above = lines[:n][::-1]
            depth = line.index("FileScan")
            for up in above:
                at = len(up) - len(up.lstrip(" :+-"))
                if at < depth:
                    assert "Exchange" not in up
                    depth = at
                if "Join" in up and at <= depth:
                    break
    want = {(r.uid, r.order_key): (r.settled, r.ref) for r in
            attach_ledger(keys, ledger.entries()).collect()}
    assert rows == want


def report_of(spark, ledger, path, name, rows):
    records = spark.createDataFrame(rows, "source_file string, row_no long, uid string, order_no string, "
                                          "amount double")
    files = spark.createDataFrame([(name, name * 8, name, AT, ledger.last_commit())],
                                  "source_file string, file_sha256 string, batch_id string, "
                                  "generated_at timestamp, ledger_commit long")
    return store_report(spark, reconcile(records, None, facts=ledger.facts()), files, path)


def test_recheck_pays_a_key_once(spark, tmp_path):
    for recheck, total in ((False, 5), (True, 3)):
        ledger = Ledger(spark, str(tmp_path / f"ledger-{recheck}"))
        ledger.append("import", "old", entries(spark, ("P0", "O", 3.0, "settled")), at=AT)
        first = report_of(spark, ledger, f"{tmp_path}/{recheck}/a", "a",
                          [("a", 1, "p1", "A", 5.0), ("a", 2, "p2", None, 6.0)])
        second = report_of(spark, ledger, f"{tmp_path}/{recheck}/b", "b",
                           [("b", 1, "p1", "A", 5.0), ("b", 2, "p2", "X", 6.0), ("b", 3, "p3", "A", 7.0),
                            ("b", 4, "p0", "O", 3.0)])
        assert second.summary.first()[TO_SETTLE] == 3
        apply_report(first, ledger, confirmed=True, recheck=recheck)
        apply_report(second, ledger, confirmed=True, recheck=recheck)
        paid = [(r.uid, r.order_no) for r in ledger.entries().filter("commit_seq > 1").collect()]
        assert len(paid) == total, paid
        assert ledger.processed().count() == 2


def test_a_tail_opens_the_newest_files_only(spark, tmp_path):
    path = tmp_path / "audit"
    for n in range(300):
        (path / f"seq={n:020d}").mkdir(parents=True)
        (path / f"seq={n:020d}" / "part-0.txt").write_text(f'{{"ts": "{n}", "action": "a{n}"}}\n')
    assert len(newest_lines(spark, str(path), 5).inputFiles()) == 8
    assert [r.action for r in audit_tail(spark, str(path), 5).collect()] == [f"a{n}" for n in range(295, 300)]
    assert len(newest_lines(spark, str(path), 20).inputFiles()) == 32
    assert audit_tail(spark, str(path), 1000).count() == 300
    append_audit(spark, str(path), "last")
    assert audit_tail(spark, str(path), 1).first()["action"] == "last"


def test_an_import_reads_its_records_once(spark, tmp_path):
    """Counts come from the jobs that write; an empty import has counts too."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = [(f"f{i % 3}", i, str(i % 7) if i % 5 else None, "1.25") for i in range(1000)]
    schema = "source_file string, row_no bigint, uid string, amount string"
    records = spark.createDataFrame(rows, schema).repartition(4).mapInArrow(seen, schema)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    done = import_history(records, ledger, imported_at=datetime(2024, 1, 1),
                          audit_path=str(tmp_path / "log"))
    assert reads.value == 1000
    assert (done.imported, done.skipped) == (800, 200)
    assert done.commit.amount == Decimal("1000.00") and ledger.entries().count() == 800
    events = [json.loads(r["detail"]) for r in audit_tail(spark, str(tmp_path / "log")).collect()]
    assert {e["source_file"]: (e["imported"], e["skipped"]) for e in events} == {
        f: (sum(r[0] == f and r[2] is not None for r in rows),
            sum(r[0] == f and r[2] is None for r in rows)) for f in ("f0", "f1", "f2")}
    for nothing in (records.limit(0), records.filter("uid is null")):
        again = import_history(nothing, ledger, imported_at=datetime(2024, 1, 2))
        assert again.imported == 0 and again.commit.amount == Decimal("0.00")
    assert ledger.entries().count() == 800
