"""DuckDB statements for the registered queries.

Written the plain way (correlated lookups, EXISTS with OR, joins on unnested
cells), so that they check the Spark forms rather than repeat them. DuckDB has
no NFKC; the derived inputs use only the wide characters translated here.
"""

from __future__ import annotations

# The header rows of derive.HEADERS.
HEADERS = ("UID,昵称,订单号,结算金额,日期,状态",
           "包裹编号,成交单号,摘要,订单应付金额,会员ID,会员昵称,订单状态,售后",
           " ＵＩＤ , Amount ,Order , DATE ",
           "Member,佣金,周期",
           "remark,note")

# ---- the batch and the ledger, as derived from events
BATCH = """
ev AS (
  SELECT *, event_type || '-' || strftime(ts, '%Y-%m-%d') AS ord FROM events),
batch AS (
  SELECT event_id AS row_no,
    CASE WHEN event_id % 29 = 0 THEN NULL
         WHEN event_id % 8 = 1 THEN ' ' || user_id || ' '
         WHEN event_id % 8 = 2 THEN 'UID:' || user_id
         WHEN event_id % 8 = 3 THEN translate(user_id::VARCHAR, '0123456789', '０１２３４５６７８９')
         WHEN event_id % 8 = 4 THEN 'uid：' || user_id
         WHEN event_id % 8 = 5 THEN '用户' || user_id
         WHEN event_id % 8 = 6 THEN chr(9) || user_id
         ELSE user_id::VARCHAR END AS uid,
    CASE WHEN event_id % 13 = 0 THEN '待定'
         WHEN event_id % 9 = 0 THEN '￥ ' || value::VARCHAR
         WHEN event_id % 7 = 0 THEN '1,' || lpad(floor(value)::BIGINT::VARCHAR, 3, '0') || '.125'
         ELSE value::VARCHAR END AS amount,
    CASE WHEN event_id % 11 <> 0 THEN ord END AS order_no,
    strftime(ts, '%Y-%m-%d') AS date, props AS name,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN '异常-退款' ELSE '正常' END AS status
  FROM ev),
whole_ledger AS (
  SELECT event_id AS row_no, user_id::VARCHAR AS uid,
    CASE WHEN event_id % 20 = 3 THEN '' ELSE ord END AS order_no,
    (value::VARCHAR::DECIMAL(38,2)
       + CASE WHEN event_id % 3 = 0 THEN 0.50 ELSE 0 END)::DECIMAL(38,2) AS amount,
    CASE WHEN event_type IN ('view', 'purchase') THEN 'settled'
         WHEN event_type = 'click' THEN 'pending' ELSE 'quote' END AS status
  FROM ev),
ledger AS (SELECT * FROM whole_ledger WHERE row_no % 10 = 3 AND uid::BIGINT % 4 <> 0)
"""

_NARROW = "translate({}, '０１２３４５６７８９：￥', '0123456789:¥')"


def _uid(column: str, prefixes: str = "UID:|UID|用户|账号") -> str:
    bare = f"upper(regexp_replace({_NARROW.format(column)}, '\\s', '', 'g'))"
    return (f"nullif(regexp_replace(regexp_replace({bare}, '^({prefixes})', ''), "
            "'^[:：—_ -]+', ''), '')")


def _amount(column: str) -> str:
    return (f"try_cast(regexp_replace({_NARROW.format(column)}, '[¥$€,_\\s]', '', 'g') "
            "AS DECIMAL(38,18))")


def _cleaned(places: int = 2, rounding: str = "round", prefixes: str = "UID:|UID|用户|账号",
             keyword: str = "CASE WHEN status LIKE '%异常%' THEN '异常' END") -> str:
    return f"""{BATCH},
cleaned AS (
  SELECT row_no, {_uid('uid', prefixes)} AS uid, trim(coalesce(uid, ''), ' ' || chr(9)) AS raw_uid,
    order_no, coalesce(order_no, '') AS ok, amount AS raw_amount,
    {rounding}({_amount('amount')}, {places})::DECIMAL(38,{places}) AS amount,
    date, name, status, {keyword} AS keyword
  FROM batch)"""


def _classified(places: int = 2, rounding: str = "round", tolerance: str = "0.01", **kw) -> str:
    """One row per record, each fact looked up the naive way."""
    return f"""{_cleaned(places, rounding, **kw)},
firsts AS (
  SELECT c.*, CASE WHEN uid IS NOT NULL THEN min(row_no) OVER (PARTITION BY uid, ok) END AS first_row
  FROM cleaned c),
looked AS (
  SELECT f.*,
    EXISTS (SELECT 1 FROM ledger l WHERE l.uid = f.uid AND l.status = 'settled'
            AND (f.ok = '' OR l.order_no = f.ok OR l.order_no = '')) AS settled,
    (SELECT max_by(l.amount, l.row_no) FROM ledger l
     WHERE l.uid = f.uid AND l.status IN ('pending', 'quote')
       AND (f.ok = '' OR l.order_no = f.ok OR l.order_no = '')) AS ref0
  FROM firsts f),
bucketed AS (
  SELECT *, {rounding}(ref0, {places})::DECIMAL(38,{places}) AS ref,
    CASE WHEN uid IS NULL THEN 'missing_uid'
         WHEN row_no <> first_row THEN 'duplicate_in_batch'
         WHEN settled THEN 'already_settled'
         WHEN amount IS NULL OR keyword IS NOT NULL THEN 'manual_review'
         WHEN ref0 IS NOT NULL AND abs(amount - {rounding}(ref0, {places})::DECIMAL(38,{places}))
              > {tolerance} THEN 'amount_mismatch'
         ELSE 'to_settle' END AS bucket
  FROM looked),
items AS (
  SELECT row_no, bucket,
    CASE WHEN bucket = 'manual_review' AND amount IS NULL THEN 'amount_unreadable'
         WHEN bucket = 'manual_review' THEN 'status_flagged' ELSE bucket END AS reason_code,
    CASE bucket
      WHEN 'missing_uid' THEN 'no valid payee id; fill it in by hand'
      WHEN 'duplicate_in_batch' THEN
        'same payee and order as row ' || first_row || '; only the first is paid'
      WHEN 'already_settled' THEN 'the ledger has this payee and order as settled'
      WHEN 'manual_review' THEN
        CASE WHEN amount IS NULL THEN 'amount missing or unreadable: ' || raw_amount
             ELSE 'status ' || status || ' contains ' || keyword || '; confirm by hand' END
      WHEN 'amount_mismatch' THEN 'amount ' || amount || ' differs from ledger reference '
        || ref || ' by more than {tolerance}'
      ELSE 'payable now' END AS reason,
    uid, raw_uid, order_no, amount, raw_amount,
    CASE WHEN bucket IN ('to_settle', 'amount_mismatch') THEN ref END AS ref_amount,
    date, name, first_row
  FROM bucketed)"""


def _summary(places: int = 2) -> str:
    return f"""SELECT 'events' AS source_file, count(*) AS total_rows,
  count(*) FILTER (bucket = 'to_settle') AS to_settle,
  coalesce(sum(amount) FILTER (bucket = 'to_settle'), 0)::DECIMAL(38,{places}) AS to_settle_amount,
  count(*) FILTER (bucket = 'already_settled') AS already_settled,
  count(*) FILTER (bucket = 'duplicate_in_batch') AS duplicate_in_batch,
  count(*) FILTER (bucket = 'missing_uid') AS missing_uid,
  count(*) FILTER (bucket = 'amount_mismatch') AS amount_mismatch,
  count(*) FILTER (bucket = 'manual_review') AS manual_review
FROM items"""


_KEYS = f"""{_cleaned()},
keys AS (
  SELECT uid, ok, min(row_no) AS first_row, count(*) AS n_rows, first(amount ORDER BY row_no) AS amount
  FROM (SELECT uid, ok, row_no, amount FROM cleaned WHERE uid IS NOT NULL) GROUP BY uid, ok)"""

_REF = """(SELECT l.amount FROM ledger l WHERE l.uid = k.uid AND l.status IN ('pending', 'quote')
   AND (k.ok = '' OR l.order_no = k.ok OR l.order_no = '') ORDER BY l.row_no DESC LIMIT 1)"""

_HISTORY = """
hist AS (
  SELECT o_orderkey + 2 AS row_no,
    CASE WHEN o_orderkey % 31 <> 0 THEN o_custkey::VARCHAR END AS uid,
    CASE WHEN o_orderkey % 17 = 0 THEN '-'
         WHEN o_orderkey % 5 = 0 THEN '$' || o_totalprice::DECIMAL(38,2) || '5'
         ELSE o_totalprice::DECIMAL(38,2)::VARCHAR END AS amount,
    CASE WHEN o_orderkey % 6 <> 0 THEN 'ORD-' || o_orderkey ELSE '' END AS order_no,
    CASE WHEN o_orderstatus = 'F' THEN '完成' WHEN o_orderstatus = 'O' THEN ' QUOTE '
         WHEN o_orderkey % 2 = 0 THEN '未结算' END AS status
  FROM orders)"""


def _status(column: str, default: str) -> str:
    word = f"lower(trim(translate({column}, 'ＳＥＴＬＤ', 'SETLD')))"
    return (f"CASE WHEN {word} IN ('已结算', 'settled', '完成', '已付') THEN 'settled' "
            f"WHEN {word} IN ('待定', 'pending', '未结算') THEN 'pending' "
            f"WHEN {word} IN ('报价', 'quote') THEN 'quote' ELSE '{default}' END")


_NUMBER_TEXT = ("CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE {0}::VARCHAR END")
_MOMENT_TEXT = ("CASE WHEN {0} = date_trunc('day', {0}) THEN strftime({0}, '%Y-%m-%d') "
                "ELSE strftime({0}, '%Y-%m-%d %H:%M') END")

# ---- pages as inbox files
_PAGES = """
files AS (
  SELECT file_no, html, sha256(html) AS sha256, strlen(html) AS length,
    CASE WHEN file_no % 7 = 0 THEN '.xls' WHEN file_no % 2 = 0 THEN '.csv' ELSE '.xlsx' END AS format
  FROM (SELECT page_id // 10 AS file_no,
          string_agg(coalesce(html, ''), chr(10) ORDER BY page_id) AS html FROM pages GROUP BY 1)),
register AS (
  SELECT sha256, 'batch-' || min(file_no) AS batch_id FROM files
  WHERE file_no % 3 = 0 GROUP BY sha256),
scanned AS (
  SELECT lpad(f.file_no::VARCHAR, 8, '0') || f.format AS name, f.format, f.length,
    CASE WHEN f.format <> '.xls' THEN f.sha256 END AS sha256, f.sha256 AS any_sha,
    f.format <> '.xls' AND r.sha256 IS NOT NULL AS processed,
    CASE WHEN f.format <> '.xls' THEN r.batch_id END AS processed_batch,
    CASE WHEN f.format = '.xls' THEN 'old .xls format is not supported; save the file as .xlsx' END
      AS warning
  FROM files f LEFT JOIN register r ON r.sha256 = f.sha256)"""

_STATS = """SELECT count(*) AS entries, count(*) FILTER (status = 'settled') AS settled,
  coalesce(sum(amount) FILTER (status = 'settled'), 0)::DECIMAL(38,2) AS settled_amount,
  {} AS processed_files FROM {}"""

# ---- documents as sheets
# Header keywords per field.
_KEYWORDS = {
    "uid": ["uid", "用户id", "用户 id", "工会id", "主播id", "账号", "memberid", "member", "编号", "id"],
    "amount": ["结算金额", "应结金额", "金额", "佣金", "分成", "结算", "amount"],
    "order_no": ["订单号", "订单编号", "单号", "订单", "order"],
    "date": ["日期", "结算日期", "时间", "周期", "date"],
    "name": ["昵称", "姓名", "主播", "name"],
    "status": ["状态", "status"],
}
_KEYWORD_ROWS = ", ".join(f"('{f}', '{k}')" for f, ks in _KEYWORDS.items() for k in ks)
_TRIM = "trim({}, ' ' || chr(9) || chr(13) || chr(160) || chr(12288))"
_FOLD = f"lower({_TRIM.format('translate({}, ' + repr('ＵＩＤ') + ', ' + repr('UID') + ')')})"

_SHEETS = f"""
kw(field, word) AS (VALUES {_KEYWORD_ROWS}),
docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines, (doc_id % 18)::INT AS above,
  [{', '.join(f"'{h}'" for h in HEADERS)}][(doc_id % 5)::INT + 1] AS header FROM documents),
rws AS (SELECT doc_id, list_concat(list_concat(lines[1:above], [header]), lines[above + 1:]) AS r
  FROM docs),
sheet AS (
  SELECT 'doc-' || doc_id AS source_file, i - 1 AS row_idx, string_split(r[i], ',') AS cells
  FROM (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS i FROM rws)),
early AS (SELECT source_file, row_idx, unnest(range(len(cells))) AS col, unnest(cells) AS cell
  FROM sheet WHERE row_idx < 15),
scores AS (
  SELECT source_file, row_idx, count(DISTINCT field) AS score
  FROM early JOIN kw ON contains({_FOLD.format('cell')}, word) GROUP BY ALL),
header AS (
  SELECT source_file, row_idx AS header_idx, score FROM scores WHERE score >= 2
  QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY score DESC, row_idx) = 1),
hits AS (
  SELECT e.source_file, field, col AS "column", {_TRIM.format('cell')} AS header,
    {_FOLD.format('cell')} = word AS exact
  FROM early e JOIN header h ON e.source_file = h.source_file AND e.row_idx = h.header_idx
  JOIN kw ON contains({_FOLD.format('cell')}, word)),
mapping AS (
  SELECT source_file, field, "column", header FROM hits
  QUALIFY row_number() OVER (PARTITION BY source_file, field ORDER BY exact DESC, "column") = 1)"""


def _first_named(field: str) -> str:
    """Column whose header equals the mapped header, the leftmost one."""
    return (f"(SELECT min(e.col) FROM early e JOIN header h ON e.source_file = h.source_file "
            f"AND e.row_idx = h.header_idx JOIN mapping m ON m.source_file = e.source_file "
            f"AND m.field = '{field}' WHERE e.source_file = hd.source_file "
            f"AND {_FOLD.format('e.cell')} = {_FOLD.format('m.header')})")


def _cell_at(column: str) -> str:
    return f"coalesce({_TRIM.format(f's.cells[{column} + 1]')}, '')"


_DATA_ROWS = """sheet s JOIN cols c ON s.source_file = c.source_file AND s.row_idx > c.header_idx
  AND len(list_filter(s.cells, lambda x: """ + _TRIM.format("x") + " <> '')) > 0"

_AUDIT = """
lines AS (
  SELECT event_id AS line_no, CASE WHEN event_id % 10 = 4 THEN '  '
    WHEN event_id % 10 = 7 THEN 'oops ' || event_id
    ELSE '{"ts": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '", "action": "' || event_type
         || '", "props": ' || props || '}' END AS value FROM events),
tail AS (SELECT line_no, trim(value) AS line FROM (SELECT * FROM lines ORDER BY line_no DESC LIMIT 25))"""

_FILE_ROWS = f"""WITH {_cleaned()} SELECT uid, order_no, amount,
  trim(raw_amount) AS raw_amount, status AS status_text, name FROM cleaned"""


def _applied(times: int, files: int = 1) -> str:
    return f"""WITH {_classified()},
paid AS (SELECT amount, 'settled' AS status FROM items, range({times}) WHERE bucket = 'to_settle'),
book AS (SELECT amount, status FROM ledger UNION ALL SELECT amount, status FROM paid)
{_STATS.format(files, 'book')}"""


def _round_sql(function: str) -> str:
    return f"""SELECT l_orderkey, l_linenumber, {function}(x, 2)::DECIMAL(38,2) AS cents,
  {function}(x, 0)::DECIMAL(38,0) AS units FROM (SELECT l_orderkey, l_linenumber,
  (l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2))::DECIMAL(38,18) AS x FROM lineitem)"""


_ITEMS = f"WITH {_classified()} SELECT * FROM items"

# Files of ten pages that are good, lack something, or are shown without being opened.
_MIXED = """f AS (SELECT page_id // 10 AS n, count(*) AS pages FROM pages GROUP BY 1),
    mixed AS (SELECT CASE n % 9 WHEN 6 THEN '_' WHEN 7 THEN '.' ELSE '' END
        || lpad(n::VARCHAR, 8, '0') || CASE WHEN n % 9 = 3 THEN '.xls' ELSE '.csv' END AS name,
      CASE n % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_header' WHEN 2 THEN 'unreadable'
        WHEN 3 THEN 'unsupported_format' WHEN 4 THEN 'no_data' WHEN 5 THEN 'empty_file'
        ELSE 'hidden_name' END AS status,
      CASE WHEN n % 9 = 0 THEN pages ELSE 0 END AS n_rows FROM f WHERE n % 9 <> 8)"""

ORACLES = {
    "q_uid_clean": f"WITH {_cleaned()} SELECT row_no, uid FROM cleaned",
    "q_uid_regex": f"""WITH {_cleaned()} SELECT row_no,
      CASE WHEN regexp_full_match(uid, '[0-9]{{2}}') THEN uid END AS uid FROM cleaned""",
    "q_uid_numeric": f"""SELECT o_orderkey, o_custkey::VARCHAR AS whole,
      {_NUMBER_TEXT.format('o_totalprice')} AS fraction, o_custkey::VARCHAR AS number FROM orders""",
    "q_status_map": f"""WITH {_HISTORY}, words AS (
      SELECT 'events' AS source, event_id AS id, CASE event_type WHEN 'view' THEN ' 已结算'
        WHEN 'click' THEN '待定' WHEN 'purchase' THEN 'ＳＥＴＴＬＥＤ' WHEN 'error' THEN '报价'
        ELSE 'other' END AS word FROM events
      UNION ALL SELECT 'orders', row_no, status FROM hist)
      SELECT source, id, {_status('word', 'pending')} AS status FROM words""",
    "q_amount_parse": f"""WITH {BATCH} SELECT row_no, amount AS raw_amount,
      {_amount('amount')} AS amount FROM batch""",
    "q_round_half_up": _round_sql("round"),
    "q_round_half_even": _round_sql("round_even"),
    "q_cell_texts": f"""SELECT 'orders' AS source, o_orderkey AS id,
      {_MOMENT_TEXT.format('o_orderdate')} AS moment, {_NUMBER_TEXT.format('o_totalprice')} AS number,
      trim(o_orderpriority) AS label FROM orders
      UNION ALL SELECT 'events', event_id, {_MOMENT_TEXT.format('ts')},
      {_NUMBER_TEXT.format('value')}, event_type FROM events""",
    "q_anomaly_hit": """SELECT *, CASE WHEN contains(status, '冻结') THEN '冻结'
        WHEN contains(status, 'LOW') THEN 'LOW' WHEN contains(status, '退款') THEN '退款'
        WHEN contains(status, 'HIGH') THEN 'HIGH' END AS keyword
      FROM (SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN '/退款' ELSE '' END
        || CASE WHEN o_orderkey % 5 = 0 THEN '/冻结' ELSE '' END AS status FROM orders)""",
    "q_dup_first": f"""WITH {_KEYS} SELECT uid, ok AS order_no, first_row, n_rows FROM keys""",
    "q_dup_first_lineitem": """SELECT l_orderkey::VARCHAR AS uid, l_linenumber::VARCHAR AS order_no,
      min(l_partkey * 1000000 + l_suppkey) AS first_row, count(*) AS n_rows
      FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "q_settled_lookup": f"""WITH {_KEYS} SELECT uid, ok AS order_no,
      EXISTS (SELECT 1 FROM ledger l WHERE l.uid = k.uid AND l.status = 'settled'
        AND (k.ok = '' OR l.order_no = k.ok OR l.order_no = '')) AS settled FROM keys k""",
    "q_reference_amount": f"WITH {_KEYS} SELECT uid, ok AS order_no, {_REF} AS ref FROM keys k",
    "q_ledger_facts": f"""WITH {_KEYS} SELECT uid, ok AS order_no,
      EXISTS (SELECT 1 FROM ledger l WHERE l.uid = k.uid AND l.status = 'settled'
        AND (k.ok = '' OR l.order_no = k.ok OR l.order_no = '')) AS settled, {_REF} AS ref
      FROM keys k""",
    "q_tolerance": f"""WITH {_KEYS}, known AS (SELECT uid, ok AS order_no, amount, {_REF} AS ref
      FROM keys k) SELECT *, abs(amount - ref) > 0.25 AS differs FROM known
      WHERE amount IS NOT NULL AND ref IS NOT NULL""",
    "q_missing_uid": f"""WITH {_classified()} SELECT row_no, raw_uid, amount, reason FROM items
      WHERE bucket = 'missing_uid'""",
    "q_reconcile_items": _ITEMS,
    "q_reconcile_batch_summary": f"WITH {_classified()} {_summary()}",
    "q_reconcile_rules": "WITH " + _classified(
        0, "round_even", "5", prefixes="UID",
        keyword="CASE WHEN status LIKE '%正%' THEN '正' END") + _summary(0),
    "q_reconcile_lineitem": """WITH lines AS (
      SELECT strftime(l_shipdate, '%Y-%m') AS source_file, l_orderkey::VARCHAR AS ok,
        CASE WHEN l_partkey % 37 <> 0 THEN (l_suppkey % 10)::VARCHAR END AS uid,
        l_extendedprice::DECIMAL(38,2) AS amount, l_returnflag AS status,
        ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey
          AS row_no FROM lineitem),
      book AS (SELECT (o_custkey % 10)::VARCHAR AS uid, o_totalprice::DECIMAL(38,2) AS amount,
        CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE o_orderkey::VARCHAR END AS order_no,
        o_orderkey AS row_no, o_orderstatus = 'F' AS paid FROM orders),
      keys AS (SELECT source_file, uid, ok, min(row_no) AS first_row FROM lines
        WHERE uid IS NOT NULL GROUP BY ALL),
      pairs AS (SELECT k.source_file, k.uid, k.ok, b.paid, b.amount AS ref, b.row_no
        FROM keys k JOIN book b ON b.uid = k.uid AND b.order_no = k.ok
        UNION ALL SELECT k.source_file, k.uid, k.ok, b.paid, b.amount, b.row_no
        FROM keys k JOIN book b ON b.uid = k.uid AND b.order_no = ''),
      facts AS (SELECT source_file, uid, ok, bool_or(paid) AS settled,
        max_by(ref, row_no) FILTER (NOT paid) AS ref FROM pairs GROUP BY ALL),
      bucketed AS (SELECT l.*, CASE WHEN l.uid IS NULL THEN 'missing_uid'
          WHEN l.row_no <> k.first_row THEN 'duplicate_in_batch'
          WHEN f.settled THEN 'already_settled' WHEN l.status = 'R' THEN 'manual_review'
          WHEN abs(l.amount - f.ref) > 0.01 THEN 'amount_mismatch' ELSE 'to_settle' END AS bucket
        FROM lines l
        LEFT JOIN keys k ON k.source_file = l.source_file AND k.uid = l.uid AND k.ok = l.ok
        LEFT JOIN facts f ON f.source_file = l.source_file AND f.uid = l.uid AND f.ok = l.ok)
      SELECT source_file, count(*) AS total_rows,
        count(*) FILTER (bucket = 'to_settle') AS to_settle,
        coalesce(sum(amount) FILTER (bucket = 'to_settle'), 0)::DECIMAL(38,2) AS to_settle_amount,
        count(*) FILTER (bucket = 'already_settled') AS already_settled,
        count(*) FILTER (bucket = 'duplicate_in_batch') AS duplicate_in_batch,
        count(*) FILTER (bucket = 'missing_uid') AS missing_uid,
        count(*) FILTER (bucket = 'amount_mismatch') AS amount_mismatch,
        count(*) FILTER (bucket = 'manual_review') AS manual_review
      FROM bucketed GROUP BY source_file""",
    "q_payable_total": f"""WITH {_classified()} SELECT 'events' AS source_file,
      count(*) AS to_settle, sum(amount)::DECIMAL(38,2) AS to_settle_amount
      FROM items WHERE bucket = 'to_settle'""",
    "q_bucket_extract": f"""WITH {_classified()},
      labels(bucket_rank, bucket, bucket_label) AS (VALUES (1, 'to_settle', '待结算'),
        (2, 'already_settled', '已结算跳过'), (3, 'duplicate_in_batch', '批内重复'),
        (4, 'missing_uid', '缺UID'), (5, 'amount_mismatch', '金额不一致'),
        (6, 'manual_review', '需人工复核'))
      SELECT bucket_rank::BIGINT AS bucket_rank, bucket_label, bucket, row_no,
        coalesce(uid, raw_uid) AS uid, coalesce(order_no, '') AS order_no, amount, ref_amount,
        date, name, reason FROM items JOIN labels USING (bucket)""",
    "q_report_roundtrip": _ITEMS,
    "q_report_roundtrip_json": _ITEMS,
    "q_report_summary": f"""WITH {_classified()}, s AS ({_summary()}),
      facts AS (SELECT unnest([
        (1, 'source_file', source_file), (2, 'batch_id', '20240723-' || left(sha256('events'), 8)),
        (3, 'generated_at', '2024-07-23 10:00:00'), (4, 'total_rows', total_rows::VARCHAR),
        (5, 'to_settle', to_settle::VARCHAR), (6, 'to_settle_amount', to_settle_amount::VARCHAR),
        (7, 'already_settled', already_settled::VARCHAR),
        (8, 'duplicate_in_batch', duplicate_in_batch::VARCHAR),
        (9, 'missing_uid', missing_uid::VARCHAR), (10, 'amount_mismatch', amount_mismatch::VARCHAR),
        (11, 'manual_review', manual_review::VARCHAR)]) AS f FROM s)
      SELECT f[1] AS fact_no, f[2] AS fact, f[3] AS value FROM facts""",
    "q_import_rows": f"""WITH {_HISTORY} SELECT row_no, uid, order_no,
      round({_amount('amount')}, 2)::DECIMAL(38,2) AS amount, {_status('status', 'pending')} AS status
      FROM hist WHERE uid IS NOT NULL AND {_amount('amount')} IS NOT NULL""",
    "q_import_counts": f"""WITH {_HISTORY}, k AS (
      SELECT uid IS NOT NULL AND {_amount('amount')} IS NOT NULL AS kept FROM hist)
      SELECT count(*) FILTER (kept) AS imported, count(*) FILTER (NOT kept) AS skipped FROM k""",
    "q_ledger_totals": f"WITH {BATCH}, {_PAGES} "
                       + _STATS.format("(SELECT count(*) FROM register)", "whole_ledger"),
    "q_ledger_query_uid": f"""WITH {BATCH} SELECT row_no, uid, order_no, amount, status FROM whole_ledger
      WHERE uid = '7' ORDER BY row_no DESC LIMIT 50""",
    "q_ledger_recent": f"""WITH {BATCH} SELECT row_no, uid, order_no, amount, status FROM whole_ledger
      ORDER BY row_no DESC LIMIT 50""",
    "q_apply_once": _applied(1),
    "q_apply_force": _applied(2),
    "q_apply_recheck": f"""SELECT *, false AS recheck FROM ({_applied(2, 2)})
      UNION ALL SELECT *, true FROM ({_applied(1, 2)})""",
    "q_audit_events": f"""WITH {_classified()}, s AS ({_summary()}),
      b AS (SELECT *, '20240723-' || left(sha256('events'), 8) AS batch_id FROM s)
      SELECT 'reconcile_preview' AS action, batch_id, 'events' AS source_file,
        total_rows::VARCHAR AS total_rows, to_settle::VARCHAR AS to_settle,
        to_settle_amount::VARCHAR AS to_settle_amount, NULL AS settled_count,
        NULL AS settled_amount FROM b
      UNION ALL SELECT 'apply_settlement', batch_id, 'events', NULL, NULL, NULL,
        to_settle::VARCHAR, to_settle_amount::VARCHAR FROM b""",
    "q_file_facts": f"""WITH {_PAGES} SELECT name, format, any_sha AS sha256,
      left(any_sha, 8) AS short_hash, '20240723-' || left(any_sha, 8) AS batch_id,
      round_even(length / 1024, 1) AS size_kb FROM scanned""",
    "q_processed_files": f"""WITH {_PAGES}
      SELECT name, sha256, processed, processed_batch, warning FROM scanned""",
    "q_file_outcomes": f"""WITH {_MIXED}
      SELECT name, status, n_rows, false AS already_processed FROM mixed""",
    "q_import_outcomes": f"""WITH {_MIXED}
      SELECT name, status, n_rows, sum(n_rows) OVER ()::BIGINT AS imported, 0 AS skipped FROM mixed""",
    "q_suggest_outcomes": f"""WITH {_MIXED}, s AS (
      SELECT name, CASE status WHEN 'no_data' THEN 'ok' ELSE status END AS status FROM mixed)
      SELECT name, status, CASE status WHEN 'ok' THEN 0 END AS uid_column,
        CASE status WHEN 'ok' THEN 1 END AS amount_column FROM s""",
    "q_inbox_pending": f"""WITH {_PAGES} SELECT name, format FROM scanned
      WHERE format <> '.xls' AND NOT processed""",
    "q_status_overview": f"""WITH {BATCH}, {_PAGES},
      st AS ({_STATS.format("(SELECT count(*) FROM register)", "whole_ledger")}),
      ib AS (SELECT count(*) FILTER (format <> '.xls') AS total,
        count(*) FILTER (format <> '.xls' AND NOT processed) AS pending FROM scanned)
      SELECT 'entries' AS fact, entries::VARCHAR AS value FROM st
      UNION ALL SELECT 'settled', settled::VARCHAR FROM st
      UNION ALL SELECT 'settled_amount', settled_amount::VARCHAR FROM st
      UNION ALL SELECT 'processed_files', processed_files::VARCHAR FROM st
      UNION ALL SELECT 'inbox_total', total::VARCHAR FROM ib
      UNION ALL SELECT 'inbox_pending', pending::VARCHAR FROM ib""",
    "q_header_detect": f"""WITH {_SHEETS}
      SELECT source_file, header_idx, score::INT AS score FROM header""",
    "q_mapping_suggest": f"""WITH {_SHEETS}
      SELECT source_file, field, "column"::INT AS "column", header FROM mapping""",
    "q_mapping_apply": f"""WITH {_SHEETS}, cols AS (SELECT hd.source_file, hd.header_idx,
      {', '.join(f'{_first_named(f)} AS c_{f}' for f in _KEYWORDS)} FROM header hd)
      SELECT s.source_file, s.row_idx + 1 AS row_no,
      {', '.join(f"{_cell_at(f'c.c_{f}')} AS {f}" for f in _KEYWORDS)} FROM {_DATA_ROWS}""",
    "q_mapping_fixed": f"""WITH {_SHEETS}, cols AS (SELECT hd.source_file, hd.header_idx,
      (SELECT min(e.col) FROM early e WHERE e.source_file = hd.source_file
        AND e.row_idx = hd.header_idx AND {_FOLD.format('e.cell')} = 'uid') AS c_uid,
      coalesce((SELECT min(e.col) FROM early e WHERE e.source_file = hd.source_file
        AND e.row_idx = hd.header_idx AND {_FOLD.format('e.cell')} = '佣金'), 1) AS c_amount
      FROM header hd)
      SELECT s.source_file, s.row_idx + 1 AS row_no, {_cell_at('c.c_uid')} AS uid,
      {_cell_at('c.c_amount')} AS amount, {_cell_at('0')} AS name, '' AS date FROM {_DATA_ROWS}""",
    "q_audit_tail": f"""WITH {_AUDIT} SELECT
      CASE WHEN json_valid(line) THEN json_extract_string(line, '$.ts') END AS ts,
      CASE WHEN json_valid(line) THEN json_extract_string(line, '$.action') END AS action,
      CASE WHEN json_valid(line) THEN line END AS detail,
      CASE WHEN NOT json_valid(line) THEN line END AS raw FROM tail WHERE line <> ''""",
    "q_csv_inbox": _FILE_ROWS,
    "q_workbook_inbox": _FILE_ROWS,
    "q_inbox_stream": """SELECT count(*) AS total_rows,
      count(*) FILTER (event_id % 29 = 0) AS missing_uid FROM events""",
}
