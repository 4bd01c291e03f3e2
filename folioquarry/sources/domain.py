"""Circulation views over the star-schema tables, as projections that Spark and DuckDB read alike.

VIEWS is written once; spark_views() binds it to DataFrames over Parquet (scans stay lazy, so filters and columns are
pushed down), duckdb_views() gives it as common table expressions for the differential tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "1998-09-02 00:00:00"  # of loans, holds and payments
EBOOK_NOW = "2024-01-20 00:00:00"  # events lie in January 2024
FINE_PER_DAY = 5000

VIEWS = {
    "members": """SELECT c_custkey AS id, c_name AS full_name, lower(c_name) || '@example.com' AS email,
      CASE WHEN c_custkey % 10 = 0 THEN 'BANNED' WHEN c_custkey % 10 = 1 THEN 'INACTIVE' WHEN c_custkey % 10 = 2 THEN 'PENDING_VERIFICATION' ELSE 'ACTIVE' END AS status,
      CASE WHEN c_custkey % 50 = 3 THEN 'LIBRARIAN' ELSE 'MEMBER' END AS role,
      CASE WHEN c_custkey % 3 = 0 THEN CAST(60 AS BIGINT) WHEN c_custkey % 3 = 1 THEN CAST(8 AS BIGINT) END AS max_borrow_limit, '09' || lpad(CAST(c_custkey AS STRING), 8, '0') AS phone,
      CASE WHEN c_custkey % 13 = 0 THEN {ts}'1998-01-01 00:00:00' END AS membership_expires_at FROM {customer}""",
    "books": """SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 19 = 0 THEN 'X' ELSE '978' END || lpad(CAST(p_partkey % 1500 AS STRING), 10, '0') AS isbn,
      CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'vi' END AS language, p_type AS category, p_brand AS author, CAST(p_size % 4 AS BIGINT) AS available_copies,
      CAST(3 AS BIGINT) AS total_copies, p_partkey % 17 = 0 AS deleted, p_partkey % 30 AS category_id FROM {part}""",
    "loans": """SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber AS id, o_custkey AS member_id, l_partkey AS book_id, l_partkey * 100000 + l_suppkey AS copy_id,
      o_orderdate AS borrowed_at, o_orderdate + INTERVAL '14' DAY AS due_date, CASE WHEN l_linestatus = 'F' THEN greatest(l_shipdate, o_orderdate) END AS returned_at,
      CASE WHEN l_linestatus = 'F' THEN 'RETURNED' WHEN l_returnflag = 'R' THEN 'OVERDUE' WHEN l_returnflag = 'N' THEN 'BORROWED' ELSE 'LOST' END AS status,
      CAST(l_linenumber % 3 AS BIGINT) AS renew_count, CAST(2 AS BIGINT) AS max_renewals,
      CASE WHEN l_linestatus = 'F' THEN CAST(greatest({days}(greatest(l_shipdate, o_orderdate), o_orderdate + INTERVAL '14' DAY), 0) AS BIGINT) * 5000 ELSE CAST(0 AS BIGINT) END AS fine_amount,
      CASE WHEN l_quantity % 2 = 0 OR o_custkey % 4 > 0 THEN l_shipdate END AS fine_paid_at, CASE WHEN l_partkey % 11 = 0 THEN CAST(1 AS BIGINT) END AS fine_waived_by
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "ebook_loans": """SELECT event_id AS id, user_id AS member_id, event_id % 100 AS book_id, event_id % 100 + 7000 AS ebook_id, ts AS borrowed_at, ts + INTERVAL '14' DAY AS expired_at,
      CASE WHEN event_id % 9 = 0 THEN 'REVOKED' ELSE 'ACTIVE' END AS status, CASE WHEN event_id % 4 = 0 THEN event_id % 5000 END AS payment_id FROM {events} WHERE event_type IN ('signup', 'view')""",
    "holds": """SELECT o_orderkey AS id, o_custkey AS member_id, o_orderkey % 100 AS book_id, o_orderdate AS reserved_at, o_orderdate + INTERVAL '3' DAY AS expires_at,
      CASE WHEN o_orderpriority LIKE '1%' THEN 'READY_FOR_PICKUP' WHEN o_orderpriority LIKE '2%' THEN 'NOTIFIED' WHEN o_orderpriority LIKE '3%' THEN 'CANCELLED' WHEN o_orderpriority LIKE '4%' THEN 'FULFILLED' ELSE 'WAITING' END AS status,
      CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END AS queue_position, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN o_orderkey + 7000000000000 END AS assigned_copy_id FROM {orders}""",
    "payments": """SELECT o_orderkey AS id, 'PAY-' || CAST(o_orderkey AS STRING) AS payment_code, o_custkey AS member_id,
      CASE WHEN o_orderkey % 3 = 0 THEN 'MOMO' ELSE 'VNPAY' END AS provider, CASE WHEN o_orderkey % 5 < 4 THEN 'TX' || CAST(o_orderkey AS STRING) END AS provider_transaction_id,
      CASE WHEN o_orderstatus = 'F' THEN '00' ELSE '24' END AS provider_response_code, CASE WHEN o_orderkey % 2 = 0 THEN 'EBOOK_PAYMENT' ELSE 'OVERDUE_FINE' END AS purpose,
      CASE WHEN o_orderkey % 2 = 0 THEN 'BOOK_EBOOK' ELSE 'BORROW_RECORD' END AS target_type,
      CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3000 + 7000 ELSE coalesce(first_loan, o_orderkey) END AS target_id, CAST(floor(o_totalprice) AS BIGINT) AS amount, 'VND' AS currency,
      CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'P' THEN 'PENDING' ELSE 'FAILED' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS paid_at, o_orderdate AS created_at
      FROM {orders} LEFT JOIN (SELECT l_orderkey, min(l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber) AS first_loan FROM {lineitem} GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "authors": """SELECT s_suppkey AS id, s_name AS name FROM {supplier}""",
    "book_authors": """SELECT p_partkey AS book_id, p_partkey % 9 + 1 AS author_id FROM {part} UNION ALL SELECT p_partkey, p_partkey % 7 + 3 FROM {part} WHERE p_partkey % 3 = 0 AND p_partkey % 7 + 3 <> p_partkey % 9 + 1""",
    "categories": """SELECT n_nationkey AS id, n_name AS name FROM {nation}""",
    "copies": """SELECT l_partkey * 100000 + l_suppkey AS id, l_partkey AS book_id, 'LIB-' || CAST(l_partkey * 100000 + l_suppkey AS STRING) AS barcode,
      CASE (l_partkey + l_suppkey) % 8 WHEN 0 THEN 'AVAILABLE' WHEN 1 THEN 'AVAILABLE' WHEN 2 THEN 'ON_HOLD_SHELF' WHEN 3 THEN 'DAMAGED' WHEN 4 THEN 'RESERVED' ELSE 'BORROWED' END AS status,
      CASE l_suppkey % 3 WHEN 0 THEN 'GOOD' WHEN 1 THEN 'Worn' END AS condition, 'A-' || CAST(l_suppkey % 10 AS STRING) AS location, l_suppkey % 29 = 0 AS deleted FROM {lineitem} GROUP BY l_partkey, l_suppkey
      UNION ALL SELECT o_orderkey + 7000000000000, o_orderkey % 100, 'HOLD-' || CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 5 = 0 THEN 'AVAILABLE' ELSE 'ON_HOLD_SHELF' END, 'GOOD', 'SHELF', false FROM {orders} WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'""",
    "book_ebooks": """SELECT p_partkey + 7000 AS id, p_partkey AS book_id, 'file-' || CAST(p_partkey AS STRING) || '.pdf' AS original_filename, CASE WHEN p_partkey % 11 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
      CASE WHEN p_partkey % 2 = 0 THEN 'PAID' ELSE 'FREE' END AS access_type, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 45 = 0 THEN p_retailprice ELSE 0 END AS fee, 1 + p_partkey * 7 % 60 AS max_concurrent_loans, CAST(14 AS BIGINT) AS loan_days FROM {part}""",
    "requests": """SELECT event_id AS id, user_id AS member_id, event_id % 120 AS book_id, ts AS asked_at, event_id % 10 = 0 AS staff FROM {events} WHERE event_type IN ('click', 'signup')""",
    "images": """SELECT p_partkey AS id, p_partkey AS book_id, 'https://img/' || CASE WHEN p_partkey % 6 = 0 THEN 'v12/' ELSE '' END || CAST(p_partkey AS STRING) || '/a.jpg' AS url,
      CASE WHEN p_partkey % 4 = 0 THEN 'DELETE_PENDING' ELSE 'ACTIVE' END AS status, p_partkey % 5 > 0 AS is_primary, p_size AS age FROM {part}""",
    "callbacks": """SELECT event_id AS id, event_id % 400 AS payment_id, ts AS received_at, event_id % 23 > 0 AS signature_valid, user_id % 6 > 0 AS amount_matches,
      event_type IN ('purchase', 'view', 'click') AS provider_success, 'k' || CAST(event_id % 700 AS STRING) AS idempotency_key, event_type AS request_hash, user_id FROM {events}""",
    "reviews": """SELECT event_id AS id, event_id % 200 AS book_id, user_id AS member_id, CAST(1 + event_id % 5 AS BIGINT) AS rating, ts AS created_at FROM {events} WHERE event_type = 'purchase'""",
    "fine_configs": """SELECT CAST(1 AS BIGINT) AS id, CAST(3000 AS BIGINT) AS rate_per_day, DATE '1990-01-01' AS effective_from, DATE '1996-01-01' AS effective_until
      UNION ALL SELECT CAST(2 AS BIGINT), CAST(5000 AS BIGINT), DATE '1996-01-01', CAST(NULL AS DATE) UNION ALL SELECT CAST(3 AS BIGINT), CAST(7000 AS BIGINT), DATE '1997-06-01', DATE '1998-01-01'""",
}
TABLES = ("customer", "part", "lineitem", "orders", "events", "supplier", "nation")


def spark_views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views over the Parquet tables in sf_dir."""
    out = []
    for name in names:
        text = VIEWS[name].replace("{ts}", "timestamp_ntz").replace("{days}", "datediff")
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
        out.append(spark.sql(text, **used))
    return out


def duckdb_views(*names: str, recursive: bool = False) -> str:
    """WITH members AS (...), ... of the named views, for DuckDB, where the tables have the same names."""
    sql = {k: v.replace("{ts}", "timestamp ").replace("{days}", "datediff_days") for k, v in VIEWS.items() if k in names}
    for t in TABLES:
        sql = {k: v.replace("{" + t + "}", t) for k, v in sql.items()}
    days = "datediff_days(greatest(l_shipdate, o_orderdate), o_orderdate + INTERVAL '14' DAY)"
    if "loans" in sql:
        sql["loans"] = sql["loans"].replace(days, "date_diff('day', CAST(o_orderdate + INTERVAL '14' DAY AS DATE), CAST(greatest(l_shipdate, o_orderdate) AS DATE))")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{k} AS ({v})" for k, v in sql.items()) + "\n"
