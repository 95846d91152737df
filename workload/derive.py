"""Batches, ledgers and sheets derived from the given tables.

Each rule is a plain expression over a whole table, so every derived input
grows with the tables. ``sql.py`` states the same rules for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_DIGITS = "0123456789"
WIDE_DIGITS = "０１２３４５６７８９"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_order() -> F.Column:
    return F.concat(F.col("event_type"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))


def events_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with messy ids, amounts and statuses, one per event."""
    e = F.col("event_id")
    uid = F.col("user_id").cast("string")
    value = F.col("value").cast("string")
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("source_file"),
        e.alias("row_no"),
        F.when(e % 29 == 0, F.lit(None).cast("string"))
        .when(e % 8 == 1, F.concat(F.lit(" "), uid, F.lit(" ")))
        .when(e % 8 == 2, F.concat(F.lit("UID:"), uid))
        .when(e % 8 == 3, F.translate(uid, ASCII_DIGITS, WIDE_DIGITS))
        .when(e % 8 == 4, F.concat(F.lit("uid："), uid))
        .when(e % 8 == 5, F.concat(F.lit("用户"), uid))
        .when(e % 8 == 6, F.concat(F.lit("\t"), uid))
        .otherwise(uid).alias("uid"),
        F.when(e % 13 == 0, F.lit("待定"))
        .when(e % 9 == 0, F.concat(F.lit("￥ "), value))
        .when(e % 7 == 0, F.concat(F.lit("1,"),
                                   F.lpad(F.floor("value").cast("string"), 3, "0"),
                                   F.lit(".125")))
        .otherwise(value).alias("amount"),
        F.when(e % 11 != 0, event_order()).alias("order_no"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.col("props").alias("name"),
        F.when((F.col("event_type") == "error") & (e % 3 == 0), "异常-退款")
        .otherwise("正常").alias("status"),
    )


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was settled before the batch: an entry for an event in ten of most users."""
    return events_book(spark, sf_dir).filter(
        (F.col("row_no") % 10 == 3) & (F.col("uid").cast("long") % 4 != 0))


def events_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an entry of a ledger."""
    e = F.col("event_id")
    value = F.col("value").cast("string").cast("decimal(38,2)")
    return (
        table(spark, sf_dir, "events")
        .select(
            F.lit(1).cast("bigint").alias("commit_seq"),
            e.alias("row_no"),
            F.col("user_id").cast("string").alias("uid"),
            F.when(e % 20 == 3, "").otherwise(event_order()).alias("order_no"),
            F.when(e % 3 == 0, value + F.expr("0.50BD")).otherwise(value)
            .cast("decimal(38,2)").alias("amount"),
            F.when(F.col("event_type").isin("view", "purchase"), "settled")
            .when(F.col("event_type") == "click", "pending")
            .otherwise("quote").alias("status"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )
    )



def orders_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an old settlement sheet: numeric ids, amounts and status words."""
    o = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(38,2)").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.lit("history/orders.csv").alias("source_file"),
        (o + 2).alias("row_no"),
        F.when(o % 31 == 0, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey")).alias("uid"),
        F.when(o % 17 == 0, F.lit("-")).when(o % 5 == 0, F.concat(F.lit("$"), price, F.lit("5")))
        .otherwise(price).alias("amount"),
        F.when(o % 6 != 0, F.concat(F.lit(" ORD-"), o.cast("string"))).alias("order_no"),
        F.when(F.col("o_orderstatus") == "F", "完成").when(F.col("o_orderstatus") == "O", " QUOTE ")
        .when(o % 2 == 0, "未结算").alias("status"))


# Header rows put into the documents, by doc_id % 5; the last shows
# no field.
HEADERS = ("UID,昵称,订单号,结算金额,日期,状态",
           "包裹编号,成交单号,摘要,订单应付金额,会员ID,会员昵称,订单状态,售后",
           " ＵＩＤ , Amount ,Order , DATE ",
           "Member,佣金,周期",
           "remark,note")


def document_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sheet: its lines are rows, cut at commas into cells.

    A header row is put in after the first doc_id % 18 lines, so some headers
    lie too deep to be found.
    """
    lines = F.split("text", "\n")
    above = (F.col("doc_id") % 18).cast("int")
    header = F.get(F.lit(list(HEADERS)), (F.col("doc_id") % 5).cast("int"))
    rows = F.concat(F.slice("lines", F.lit(1), above), F.array(header),
                    F.slice("lines", above + 1, F.greatest(F.size("lines") - above, F.lit(0))))
    exploded = (table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
                .select("doc_id", F.posexplode(rows).alias("row_idx", "row")))
    cells = F.transform(F.split("row", ","), lambda c: F.struct(
        F.lit("s").alias("kind"), c.alias("text")))
    return exploded.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
                           .alias("source_file"), F.col("row_idx").cast("bigint").alias("row_idx"),
                           cells.alias("cells"))


PAGES_PER_FILE = 10


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages each as an inbox file: name, format, content and its hash."""
    p = F.col("file_no")
    suffix = F.when(p % 7 == 0, ".xls").when(p % 2 == 0, ".csv").otherwise(".xlsx")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "page_id", F.coalesce("html", F.lit("")).alias("html")))), lambda r: r["html"]), "\n")
    return (table(spark, sf_dir, "pages")
            .groupBy(F.floor(F.col("page_id") / PAGES_PER_FILE).cast("bigint").alias("file_no"))
            .agg(text.alias("content"))
            .select("file_no", F.concat(F.lpad(p.cast("string"), 8, "0"), suffix).alias("name"),
                    F.col("content").cast("binary").alias("content"),
                    F.sha2(F.col("content").cast("binary"), 256).alias("sha256")))


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as inbox files that are good, lack a header or data, or cannot be read.

    Some are empty, some have names that Spark's own sources pass over, and some are
    no inbox files at all.
    """
    p, kind = F.col("file_no"), F.col("file_no") % 9
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("page_id")),
                                     lambda i: F.concat(i.cast("string"), F.lit(",1.5\n"))), "")
    head = F.when(kind == 1, "remark,note\n").otherwise("uid,金额\n")
    bad = F.concat(F.lit(bytearray(b"\xff\xff")), F.col("lines").cast("binary"))
    return (table(spark, sf_dir, "pages")
            .groupBy(F.floor(F.col("page_id") / PAGES_PER_FILE).cast("bigint").alias("file_no"))
            .agg(lines.alias("lines"))
            .select(F.concat(F.when(kind == 6, "_").when(kind == 7, ".").when(kind == 8, "~$")
                             .otherwise(""), F.lpad(p.cast("string"), 8, "0"),
                             F.when(kind == 3, ".xls").otherwise(".csv")).alias("name"),
                    F.when(kind == 5, F.lit(bytearray())).when(kind == 2, bad).when(kind == 4, head.cast("binary")).otherwise(
                        F.concat(head, "lines").cast("binary")).alias("content")))


def pages_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents settled before: those of every third file, each once."""
    return (page_files(spark, sf_dir).filter(F.col("file_no") % 3 == 0)
            .groupBy("sha256").agg(F.min("file_no").alias("first"), F.min("name").alias("filename"))
            .select("sha256", "filename", F.concat(F.lit("batch-"), F.col("first").cast("string"))
                    .alias("batch_id"),
                    F.lit("2024-01-01 00:00:00").cast("timestamp").alias("processed_at")))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line per event, some blank and some not JSON."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("line_no"),
        F.when(e % 10 == 4, "  ").when(e % 10 == 7, F.concat(F.lit("oops "), e.cast("string")))
        .otherwise(F.concat(F.lit('{"ts": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
                            F.lit('", "action": "'), F.col("event_type"),
                            F.lit('", "props": '), F.col("props"), F.lit("}"))).alias("value"))
