"""Registered queries over the circulation views, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import columns as c
from folioquarry.operators import catalog, circulation, paging
from folioquarry.sources.domain import EBOOK_NOW, NOW, duckdb_views, spark_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
O = "(status = 'OVERDUE' OR (status = 'BORROWED' AND due_date < TIMESTAMP '1998-09-02'))"
UNPAID = "(fine_amount > 0 AND fine_paid_at IS NULL AND fine_waived_by IS NULL)"
LIVE = "status IN ('WAITING', 'NOTIFIED', 'READY_FOR_PICKUP')"
N, E = "TIMESTAMP '1998-09-02'", "TIMESTAMP '2024-01-20'"
ELAPSED = "CAST(greatest(floor(extract(epoch FROM ({end} - {due})) / 86400), 0) AS BIGINT)"


def now():
    return c.at(NOW)


def enow():
    return c.at(EBOOK_NOW)


def query(sql: str, recursive: bool = False):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*spark_views(spark, sf_dir, *names))
        SQL[f.__name__] = duckdb_views(*names, recursive=recursive) + sql
        return f

    return add


@query(f"""SELECT m.id AS member_id, full_name, CAST(count(*) FILTER (WHERE l.status IN ('BORROWED', 'OVERDUE')) AS BIGINT) AS active_count, CAST(count(*) FILTER (WHERE l.status IN ('BORROWED', 'OVERDUE', 'LOST')) AS BIGINT) AS open_count,
  CAST(count(*) FILTER (WHERE {O.replace('status', 'l.status')}) AS BIGINT) AS overdue_count, CAST(count(*) AS BIGINT) AS history_count FROM loans l JOIN members m ON m.id = l.member_id GROUP BY 1, 2""")
def member_loan_summary(loans, members):
    return circulation.borrow_counts(loans, now()).join(members.select(F.col("id").alias("member_id"), "full_name"), "member_id").select("member_id", "full_name", "active_count", "open_count", "overdue_count", "history_count")


@query(f"""SELECT member_id, count(*) FILTER (WHERE status = 'ACTIVE') AS ebook_active, count(*) FILTER (WHERE status = 'ACTIVE' AND expired_at < {E}) AS ebook_overdue, count(*) FILTER (WHERE status = 'ACTIVE' AND expired_at > {E}) AS ebook_entitled, count(*) AS ebook_history FROM ebook_loans GROUP BY 1""")
def member_ebook_counts(ebook_loans):
    return circulation.ebook_counts(ebook_loans, enow())


@query(f"SELECT member_id, CAST(sum(fine_amount) AS BIGINT) AS unpaid_total FROM loans WHERE {UNPAID} GROUP BY 1")
def member_unpaid_fines(loans):
    return circulation.unpaid_fines(loans)


@query(f"SELECT member_id, count(*) AS active_holds FROM holds WHERE {LIVE} GROUP BY 1")
def member_active_holds(holds):
    return circulation.active_holds(holds)


@query(f""", a AS (SELECT member_id, count(*) FILTER (WHERE status IN ('BORROWED', 'OVERDUE')) AS x, count(*) FILTER (WHERE {O}) AS o, count(*) AS h FROM loans GROUP BY 1),
 b AS (SELECT member_id, count(*) FILTER (WHERE status = 'ACTIVE') AS x, count(*) FILTER (WHERE status = 'ACTIVE' AND expired_at < {E}) AS o, count(*) AS h FROM ebook_loans GROUP BY 1),
 f AS (SELECT member_id, sum(fine_amount) AS t FROM loans WHERE {UNPAID} GROUP BY 1), r AS (SELECT member_id, count(*) AS n FROM holds WHERE {LIVE} GROUP BY 1)
 SELECT m.id AS member_id, full_name, CAST(coalesce(a.x, 0) + coalesce(b.x, 0) AS BIGINT) AS active_loans, CAST(coalesce(a.o, 0) + coalesce(b.o, 0) AS BIGINT) AS overdue_loans, CAST(coalesce(a.h, 0) + coalesce(b.h, 0) AS BIGINT) AS history,
 CAST(coalesce(f.t, 0) AS BIGINT) AS unpaid_total, CAST(coalesce(r.n, 0) AS BIGINT) AS active_holds FROM members m LEFT JOIN a ON a.member_id = m.id LEFT JOIN b ON b.member_id = m.id LEFT JOIN f ON f.member_id = m.id LEFT JOIN r ON r.member_id = m.id""")
def member_stats(members, loans, ebook_loans, holds):
    return circulation.member_stats(members, loans, ebook_loans, holds, now(), enow())


LOAN_SEARCH = f""", u AS (SELECT l.id AS borrow_id, member_id, l.book_id, copy_id AS book_copy_id, barcode AS item_barcode, c.status AS copy_status, borrowed_at, due_date, returned_at, l.status, renew_count, max_renewals, fine_amount,
  CASE WHEN fine_amount <= 0 THEN 'NONE' WHEN fine_paid_at IS NOT NULL THEN 'PAID' WHEN fine_waived_by IS NOT NULL THEN 'WAIVED' ELSE 'UNPAID' END AS fine_status, {O.replace('status', 'l.status')} AS overdue,
  CASE WHEN {O.replace('status', 'l.status')} THEN {ELAPSED.format(end=N, due='due_date')} ELSE 0 END AS days_overdue, 'PHYSICAL' AS loan_type, NULL AS ebook_loan_id, NULL AS book_ebook_id, NULL AS payment_id, NULL AS expired_at, NULL AS file, NULL AS code
  FROM loans l JOIN copies c ON c.id = copy_id
  UNION ALL SELECT NULL, e.member_id, e.book_id, NULL, NULL, NULL, borrowed_at, expired_at, NULL, e.status, NULL, NULL, 0, 'NONE', e.status = 'ACTIVE' AND expired_at < {E}, CASE WHEN e.status = 'ACTIVE' AND expired_at < {E} THEN {ELAPSED.format(end=E, due='expired_at')} ELSE 0 END,
  'EBOOK', e.id, ebook_id, payment_id, expired_at, original_filename, payment_code FROM ebook_loans e LEFT JOIN book_ebooks f ON f.id = ebook_id LEFT JOIN payments p ON p.id = payment_id)
  SELECT borrow_id, u.member_id, full_name AS member_name, email AS member_email, u.book_id, title AS book_title, book_copy_id, item_barcode, copy_status, borrowed_at, due_date, returned_at, u.status, renew_count, max_renewals, CAST(fine_amount AS BIGINT) AS fine_amount,
  fine_status, overdue, CAST(days_overdue AS BIGINT) AS days_overdue, loan_type, ebook_loan_id, book_ebook_id, payment_id, expired_at FROM u JOIN members m ON m.id = u.member_id JOIN books b ON b.id = u.book_id """


@query(LOAN_SEARCH + """WHERE overdue AND (lower(full_name) LIKE '%00001%' OR lower(email) LIKE '%00001%' OR phone LIKE '%00001%' OR lower(title) LIKE '%00001%' OR lower(isbn) LIKE '%00001%' OR lower(item_barcode) LIKE '%00001%'
  OR lower(file) LIKE '%00001%' OR lower(code) LIKE '%00001%' OR borrow_id = 1 OR ebook_loan_id = 1 OR u.member_id = 1 OR u.book_id = 1 OR book_copy_id = 1 OR book_ebook_id = 1 OR payment_id = 1)""")
def staff_loan_search(loans, ebook_loans, members, books, copies, book_ebooks, payments):
    return circulation.loan_search(loans, ebook_loans, members, books, copies, book_ebooks, payments, now(), enow(), q="00001 ", overdue=True, open_only=False)


@query(LOAN_SEARCH + """WHERE u.status = 'BORROWED' AND due_date >= TIMESTAMP '1997-01-01' AND due_date <= TIMESTAMP '1998-12-31'
  ORDER BY due_date ASC NULLS LAST, borrowed_at DESC, borrow_id, ebook_loan_id LIMIT 25 OFFSET 25""")
def staff_loan_page(loans, ebook_loans, members, books, copies, book_ebooks, payments):
    found = circulation.loan_search(loans, ebook_loans, members, books, copies, book_ebooks, payments, now(), enow(), status="BORROWED", due_from="1997-01-01", due_to="1998-12-31")
    return paging.page(found, [F.asc_nulls_last("due_date"), F.desc("borrowed_at"), F.col("borrow_id"), F.col("ebook_loan_id")], 1, 25)


@query("SELECT count(*) AS total_elements, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages, true AS first, 0 >= ceil(count(*) / 25.0) - 1 AS last FROM loans WHERE status = 'OVERDUE'")
def overdue_page_meta(loans):
    return paging.page_meta(loans.where("status = 'OVERDUE'"), 0, 25)


@query(f"SELECT id, full_name, email, status, role FROM members m WHERE EXISTS (SELECT 1 FROM loans WHERE member_id = m.id AND {O.replace('status', 'loans.status')})")
def members_with_overdue(members, loans):
    return circulation.members_with_overdue(members, loans, now()).select("id", "full_name", "email", "status", "role")


@query("SELECT id, member_id, fine_amount, CASE WHEN fine_waived_by IS NOT NULL THEN 'WAIVED' WHEN fine_paid_at IS NOT NULL THEN 'PAID' ELSE 'UNPAID' END AS fine_status FROM loans WHERE fine_amount > 0")
def fine_list(loans):
    return circulation.fine_list(loans)


@query(f""", a AS (SELECT count(*) FILTER (WHERE status IN ('BORROWED', 'OVERDUE')) AS a, count(*) FILTER (WHERE {O}) AS o, count(*) FILTER (WHERE {UNPAID}) AS u, coalesce(sum(fine_amount) FILTER (WHERE {UNPAID}), 0) AS t,
  count(*) FILTER (WHERE CAST(borrowed_at + INTERVAL '7' HOUR AS DATE) = DATE '1998-05-05') AS b, count(*) FILTER (WHERE status = 'RETURNED' AND CAST(returned_at + INTERVAL '7' HOUR AS DATE) = DATE '1998-05-05') AS r FROM loans),
  e AS (SELECT count(*) FILTER (WHERE status = 'ACTIVE') AS a, count(*) FILTER (WHERE status = 'ACTIVE' AND expired_at < {E}) AS o FROM ebook_loans)
  SELECT a.a + e.a AS active_loans, a.o + e.o AS overdue_loans, (SELECT count(*) FROM holds WHERE status = 'READY_FOR_PICKUP') AS ready_holds, u AS unpaid_fines, CAST(t AS BIGINT) AS unpaid_total, b AS borrowed_today, r AS returned_today FROM a, e""")
def dashboard_summary(loans, ebook_loans, holds):
    return circulation.dashboard(loans, ebook_loans, holds, now(), enow(), "1998-05-05")


PERIOD = """, d AS (SELECT CAST(unnest(generate_series(DATE '1998-05-01', DATE '1998-05-21', INTERVAL 1 DAY)) AS DATE) AS day), w AS (SELECT * FROM loans {where}),
  b AS (SELECT CAST(borrowed_at + INTERVAL '7' HOUR AS DATE) AS day, count(*) AS n FROM w GROUP BY 1), r AS (SELECT CAST(returned_at + INTERVAL '7' HOUR AS DATE) AS day, count(*) AS n FROM w WHERE status = 'RETURNED' GROUP BY 1),
  x AS (SELECT d.day, CAST(coalesce(b.n, 0) AS BIGINT) AS borrowed, CAST(coalesce(r.n, 0) AS BIGINT) AS returned FROM d LEFT JOIN b ON b.day = d.day LEFT JOIN r ON r.day = d.day)
  SELECT day, borrowed, returned, borrowed - returned AS net, borrowed > 0 AND day = (SELECT y.day FROM x y ORDER BY y.borrowed DESC, y.day LIMIT 1) AS is_peak FROM x"""


@query(PERIOD.format(where=""))
def period_statistics(loans, books):
    return circulation.period_statistics(loans, books, "1998-05-01", "1998-05-21")


@query(PERIOD.format(where="WHERE book_id IN (SELECT id FROM books WHERE lower(title) LIKE '%1%' AND language = 'en')"))
def period_statistics_filtered(loans, books):
    return circulation.period_statistics(loans, books, "1998-05-01", "1998-05-21", "title", "1", "EN")


@query(PERIOD.format(where="WHERE false"))
def period_statistics_unknown_filter(loans, books):
    return circulation.period_statistics(loans, books, "1998-05-01", "1998-05-21", "shelf", "1")


@query(""", l AS (SELECT id, fine_amount, CAST(greatest(date_diff('day', CAST(due_date + INTERVAL '7' HOUR AS DATE), CAST(returned_at + INTERVAL '7' HOUR AS DATE)), 0) AS BIGINT) AS days_late, CAST(returned_at + INTERVAL '7' HOUR AS DATE) AS d FROM loans WHERE returned_at IS NOT NULL)
  SELECT id, days_late, CAST(coalesce(days_late * (SELECT rate_per_day FROM fine_configs WHERE effective_from <= d AND (effective_until IS NULL OR effective_until > d) ORDER BY effective_from DESC, id DESC LIMIT 1), fine_amount) AS BIGINT) AS fine FROM l WHERE days_late > 0""")
def effective_dated_fines(loans, fine_configs):
    return circulation.effective_fines(loans, fine_configs)


@query(f"SELECT id, copy_id, 'OVERDUE' AS new_status, 'OVERDUE' AS new_copy_status, due_date FROM loans WHERE status = 'BORROWED' AND due_date < {N} ORDER BY due_date, id LIMIT 500")
def overdue_marking(loans):
    return circulation.mark_overdue(loans, now())


@query(f"SELECT book_id, (SELECT id FROM holds w WHERE w.book_id = h.book_id AND w.status = 'WAITING' ORDER BY queue_position NULLS LAST, reserved_at, id LIMIT 1) AS head_id, coalesce(max(queue_position), 0) + 1 AS next_position FROM holds h WHERE {LIVE} GROUP BY book_id")
def hold_queue_heads(holds):
    return circulation.hold_heads(holds)


@query("""SELECT b.id, title, isbn, language, author, available_copies, coalesce(avg(rating), 0.0) AS average, count(rating) AS n_reviews FROM books b LEFT JOIN reviews r ON r.book_id = b.id
  WHERE NOT deleted AND (lower(isbn) LIKE '%01%' OR lower(title) LIKE '%01%') AND language = 'en' AND available_copies > 0 GROUP BY 1, 2, 3, 4, 5, 6""")
def catalog_search(books, reviews):
    return catalog.book_search(books, reviews, q="01", language="EN", available_only=True)


@query("SELECT b.book_id, r.rating, CAST(count(v.id) AS BIGINT) AS n FROM (SELECT DISTINCT book_id FROM reviews) b CROSS JOIN (SELECT CAST(unnest(generate_series(1, 5)) AS BIGINT) AS rating) r LEFT JOIN reviews v ON v.rating = r.rating AND v.book_id = b.book_id GROUP BY 1, 2")
def rating_histogram(reviews):
    return catalog.rating_histograms(reviews)


@query("SELECT book_id, avg(rating) AS average, count(*) AS n_reviews FROM reviews GROUP BY 1")
def review_stats(reviews):
    return catalog.review_stats(reviews)


@query("SELECT category, string_agg(author || ':' || n, ',' ORDER BY author) AS authors FROM (SELECT category, author, count(*) AS n FROM books GROUP BY 1, 2) GROUP BY 1")
def category_authors(books):
    nested = catalog.category_authors(books)
    return nested.select("category", F.array_join(F.transform("authors", lambda a: F.concat(a["author"], F.lit(":"), a["n"].cast("string"))), ",").alias("authors"))


@query("SELECT id, title FROM books b WHERE NOT EXISTS (SELECT 1 FROM reviews WHERE book_id = b.id)")
def unreviewed_books(books, reviews):
    return catalog.unreviewed(books, reviews).select("id", "title")


@query(""", k AS (SELECT *, lower(regexp_replace(isbn, '[^0-9Xx]', '', 'g')) AS key FROM books) SELECT id, isbn, min(id) OVER (PARTITION BY key) AS first_id, count(*) OVER (PARTITION BY key) AS n FROM k QUALIFY n > 1""")
def isbn_clashes(books):
    return catalog.isbn_clashes(books)


@query("""SELECT currency, TIMESTAMP '1998-09-02' AS made_at, count(*) FILTER (WHERE status = 'SUCCESS') AS n_success, count(*) FILTER (WHERE status = 'PENDING') AS n_pending, count(*) FILTER (WHERE status = 'FAILED') AS n_failed, CAST(coalesce(sum(amount) FILTER (WHERE status = 'SUCCESS'), 0) AS BIGINT) AS amount_success,
  CAST(coalesce(sum(amount) FILTER (WHERE status = 'PENDING'), 0) AS BIGINT) AS amount_pending, count(*) FILTER (WHERE paid_at >= TIMESTAMP '1998-05-01' AND paid_at < TIMESTAMP '1998-06-01' AND status = 'SUCCESS') AS n_period, CAST(coalesce(sum(amount) FILTER (WHERE paid_at >= TIMESTAMP '1998-05-01' AND paid_at < TIMESTAMP '1998-06-01' AND status = 'SUCCESS'), 0) AS BIGINT) AS amount_period FROM payments GROUP BY 1""")
def payment_dashboard(payments):
    return catalog.payment_dashboard(payments, c.at("1998-05-01"), c.at("1998-06-01"), now())


@query(""", j AS (SELECT c.*, p.status AS state, CASE WHEN NOT signature_valid THEN 'BAD_SIGNATURE' WHEN p.id IS NULL THEN 'UNKNOWN_PAYMENT' WHEN NOT amount_matches THEN 'AMOUNT_MISMATCH' END AS bad FROM callbacks c LEFT JOIN payments p ON p.id = c.payment_id),
  k AS (SELECT *, sum(CASE WHEN bad IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY payment_id ORDER BY received_at, id ROWS UNBOUNDED PRECEDING) AS n FROM j)
  SELECT id, payment_id, coalesce(bad, CASE WHEN state <> 'PENDING' OR n > 1 THEN 'IGNORED' WHEN provider_success THEN 'SUCCESS' ELSE 'FAILED' END) AS outcome FROM k""")
def payment_callbacks(callbacks, payments):
    return catalog.callback_outcomes(callbacks, payments)


@query("SELECT coalesce(m.id, h.member_id) AS id, coalesce('HOLDS ' || CAST(h.n AS VARCHAR), full_name) AS full_name FROM members m FULL JOIN (SELECT member_id, count(*) AS n FROM holds GROUP BY 1) h ON h.member_id = m.id UNION ALL SELECT -id - 1, 'ADDED' FROM members")
def member_upsert(members, holds):
    new = holds.groupBy(F.col("member_id").alias("id")).agg(F.concat(F.lit("HOLDS "), F.count("*").cast("string")).alias("full_name"))
    new = new.unionByName(members.select((-F.col("id") - 1).alias("id"), F.lit("ADDED").alias("full_name")))
    return catalog.merged(members.select("id", "full_name"), new, "id")


@query("SELECT book_id, count(*) AS copies, CAST(sum(o) AS BIGINT) AS copies_out FROM (SELECT book_id, copy_id, max(CASE WHEN status IN ('BORROWED', 'OVERDUE', 'LOST') THEN 1 ELSE 0 END) AS o FROM loans GROUP BY 1, 2) GROUP BY 1")
def book_copy_counts(loans):
    return catalog.copy_counts(loans)


@query("SELECT payment_code, sha256(payment_code) AS code_hash, '{\"amount\":\"' || CAST(amount AS VARCHAR) || '\",\"provider\":\"' || provider || '\"}' AS json FROM payments")
def payment_digests(payments):
    fields = F.create_map(F.lit("provider"), "provider", F.lit("amount"), F.col("amount").cast("string"))
    return payments.select("payment_code", F.sha2("payment_code", 256).alias("code_hash"), c.canonical_json(fields).alias("json"))


from folioquarry.plans import lending  # noqa: E402, F401  more queries, in the same tables
