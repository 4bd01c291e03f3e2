"""Registered queries of the lending life cycle, payments, repairs and invariants, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquarry.functions import columns as c
from folioquarry.operators import catalog, circulation, lending, paging, search, sequences, transitions
from folioquarry.plans.registry import E, LIVE, N, PERIOD, UNPAID, enow, now, query
from folioquarry.sources import runs
from folioquarry.sources.work import saved, work_dir

# The state that rules look at, as SQL: st(member_id, account, unpaid, room, overdue).
STATE = f""", st AS (SELECT m.id AS mid, CASE WHEN role <> 'MEMBER' THEN 'NOT_A_MEMBER' WHEN m.status <> 'ACTIVE' THEN 'ACCOUNT_NOT_ACTIVE' WHEN membership_expires_at < {N} THEN 'MEMBERSHIP_EXPIRED' END AS account,
  coalesce(a.f, 0) > 0 AS unpaid, coalesce(max_borrow_limit, 5) - coalesce(a.n, 0) - coalesce(b.n, 0) AS room, coalesce(a.m, 0) > 0 AS overdue FROM members m
  LEFT JOIN (SELECT member_id, count(*) FILTER (WHERE status IN ('BORROWED', 'OVERDUE')) AS n, count(*) FILTER (WHERE status = 'OVERDUE') AS m, sum(fine_amount) FILTER (WHERE {UNPAID}) AS f FROM loans GROUP BY 1) a ON a.member_id = m.id
  LEFT JOIN (SELECT member_id, count(*) AS n FROM ebook_loans WHERE status = 'ACTIVE' AND expired_at > {E} GROUP BY 1) b ON b.member_id = m.id)"""
# Requests taken one by one: asks(k, t, id, m, i, p, room, free, able) in; out(k, had_m, had_i, had_p), what was granted before each.
TURNS = "PARTITION BY {} ORDER BY t NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
WINDOWS = f"WINDOW wm AS ({TURNS.format('m')}), wi AS ({TURNS.format('i')}), wp AS ({TURNS.format('p')})"
ALLOCATED = f""", a(step, k, t, id, m, i, p, room, free, g) AS (SELECT 0, k, t, id, m, i, p, room, free, CASE WHEN able THEN NULL ELSE false END FROM asks
  UNION ALL SELECT step + 1, k, t, id, m, i, p, room, free, CASE WHEN g IS NOT NULL THEN g WHEN gm >= room OR gi >= free OR gp > 0 THEN false WHEN gm + um < room AND gi + ui < free AND up = 0 THEN true END
    FROM (SELECT *, count(*) FILTER (WHERE g) OVER wm AS gm, count(*) FILTER (WHERE g IS NULL) OVER wm AS um, count(*) FILTER (WHERE g) OVER wi AS gi, count(*) FILTER (WHERE g IS NULL) OVER wi AS ui,
      count(*) FILTER (WHERE g) OVER wp AS gp, count(*) FILTER (WHERE g IS NULL) OVER wp AS up, count(*) FILTER (WHERE g IS NULL) OVER () AS n FROM a {WINDOWS}) WHERE n > 0),
  turns AS (SELECT k, count(*) FILTER (WHERE g) OVER wm AS had_m, count(*) FILTER (WHERE g) OVER wi AS had_i, count(*) FILTER (WHERE g) OVER wp AS had_p FROM (SELECT * FROM a WHERE step = (SELECT max(step) FROM a)) {WINDOWS})"""
QUEUE = "SELECT book_id, id AS next_id, row_number() OVER (PARTITION BY book_id ORDER BY queue_position NULLS LAST, reserved_at, id) AS place FROM {holds} WHERE status = 'WAITING'"


# Checkout and renewal


@query(STATE + f""", r AS (SELECT h.id, h.member_id, c.id AS copy_id, h.copy_no FROM (SELECT id, member_id, book_id * 100000 + id % 110 AS copy_no FROM holds) h LEFT JOIN copies c ON c.id = copy_no),
  x AS (SELECT r.id, list_filter([CASE WHEN mid IS NULL THEN 'RESOURCE_NOT_FOUND' ELSE account END, CASE WHEN unpaid THEN 'UNPAID_FINES' END, CASE WHEN room <= 0 THEN 'BORROW_LIMIT_REACHED' END, CASE WHEN overdue THEN 'OVERDUE_LOANS' END,
    CASE WHEN o.m IS NOT NULL AND mid IS NOT NULL THEN 'ALREADY_BORROWED_BOOK' END,
    CASE WHEN c.id IS NULL THEN 'COPY_NOT_FOUND' WHEN c.status <> 'AVAILABLE' OR coalesce(b.deleted, true) THEN 'COPY_NOT_AVAILABLE' END], lambda v: v IS NOT NULL) AS l
    FROM r LEFT JOIN st ON mid = r.member_id LEFT JOIN copies c ON c.id = r.copy_id LEFT JOIN books b ON b.id = c.book_id
    LEFT JOIN (SELECT DISTINCT member_id AS m, book_id AS b FROM loans WHERE status IN ('BORROWED', 'OVERDUE', 'LOST')) o ON o.m = r.member_id AND o.b = c.book_id)
  SELECT id, coalesce(array_to_string(l, ','), '') AS reasons, l[1] AS first_reason, CASE WHEN len(l) = 0 THEN {N} + INTERVAL '14' DAY END AS due_date FROM x""")
def checkout_block_reasons(holds, copies, books, members, loans, ebook_loans):
    requests = holds.select("id", "member_id", (F.col("book_id") * 100000 + F.col("id") % 110).alias("copy_id"))
    return lending.checkout_blocks(requests, copies, books, members, loans, ebook_loans, now(), enow())


@query(STATE + f""", r AS (SELECT h.id, h.member_id, reserved_at AS t, book_id * 100000 + h.id % 30 AS copy_id FROM holds h),
  j AS (SELECT r.*, mid, account, unpaid, room, overdue, c.id AS cid, c.book_id AS book, coalesce(c.status <> 'AVAILABLE', true) OR coalesce(b.deleted, true) AS away, o.m IS NOT NULL AS own
    FROM r LEFT JOIN st ON mid = r.member_id LEFT JOIN copies c ON c.id = r.copy_id LEFT JOIN books b ON b.id = c.book_id
    LEFT JOIN (SELECT DISTINCT member_id AS m, book_id AS b FROM loans WHERE status IN ('BORROWED', 'OVERDUE', 'LOST')) o ON o.m = r.member_id AND o.b = c.book_id),
  asks AS (SELECT id AS k, t, id, member_id AS m, copy_id AS i, member_id || ':' || coalesce(book, -1) AS p, room, 1 AS free, mid IS NOT NULL AND account IS NULL AND NOT unpaid AND NOT overdue AND NOT own AND cid IS NOT NULL AND NOT away AS able FROM j)
  {ALLOCATED}, x AS (SELECT j.*, CASE WHEN mid IS NULL THEN 'RESOURCE_NOT_FOUND' WHEN account IS NOT NULL THEN account WHEN unpaid THEN 'UNPAID_FINES' WHEN had_m >= room THEN 'BORROW_LIMIT_REACHED' WHEN overdue THEN 'OVERDUE_LOANS'
    WHEN own OR had_p > 0 THEN 'ALREADY_BORROWED_BOOK' WHEN cid IS NULL THEN 'COPY_NOT_FOUND' WHEN away OR had_i > 0 THEN 'COPY_NOT_AVAILABLE' ELSE 'OK' END AS code FROM j JOIN turns ON k = j.id)
  SELECT id, member_id, copy_id, code, CASE WHEN code = 'OK' THEN book END AS book_id, CASE WHEN code = 'OK' THEN {N} + INTERVAL '14' DAY END AS due_date FROM x""", recursive=True)
def checkout_loans(holds, copies, books, members, loans, ebook_loans):
    requests = holds.select("id", "member_id", (F.col("book_id") * 100000 + F.col("id") % 30).alias("copy_id"), F.col("reserved_at").alias("asked_at"))
    return lending.checkouts(requests, copies, books, members, loans, ebook_loans, now(), enow()).select("id", "member_id", "copy_id", "code", "book_id", "due_date")


@query(STATE + f""", r AS (SELECT id, id AS loan_id, CASE WHEN id % 3 = 0 THEN member_id + 1 ELSE member_id END AS actor_id, id % 5 = 0 AS staff FROM loans UNION ALL SELECT -id, -id, id, false FROM members),
  j AS (SELECT r.id, r.loan_id, due_date, renew_count, CASE WHEN l.id IS NULL OR mid IS NULL THEN 'RESOURCE_NOT_FOUND' WHEN account IS NOT NULL THEN account WHEN unpaid THEN 'UNPAID_FINES' WHEN NOT staff AND actor_id <> l.member_id THEN 'ACCESS_DENIED'
    WHEN l.status <> 'BORROWED' OR due_date < {N} OR renew_count >= max_renewals THEN 'NOT_RENEWABLE' WHEN l.book_id IN (SELECT book_id FROM holds WHERE {LIVE}) THEN 'BLOCKED_BY_HOLD' ELSE 'OK' END AS code
    FROM r LEFT JOIN loans l ON l.id = r.loan_id LEFT JOIN st ON mid = l.member_id)
  SELECT id, loan_id, code, CASE WHEN code = 'OK' THEN due_date + INTERVAL '7' DAY END AS new_due_date, CASE WHEN code = 'OK' THEN renew_count + 1 END AS new_renew_count FROM j""")
def manual_renewals(loans, members, ebook_loans, holds):
    whose = F.when(F.col("id") % 3 == 0, F.col("member_id") + 1).otherwise(F.col("member_id"))
    requests = loans.select("id", F.col("id").alias("loan_id"), whose.alias("actor_id"), (F.col("id") % 5 == 0).alias("staff"))
    requests = requests.unionByName(members.select((-F.col("id")).alias("id"), (-F.col("id")).alias("loan_id"), F.col("id").alias("actor_id"), F.lit(False).alias("staff")))
    return lending.manual_renewals(requests, loans, members, ebook_loans, holds, now(), enow())


@query(f""", d AS (SELECT * FROM loans WHERE status = 'BORROWED' AND due_date >= TIMESTAMP '1998-08-01' AND due_date < TIMESTAMP '1998-10-01' ORDER BY due_date, id LIMIT 5000),
  j AS (SELECT d.*, CASE WHEN m.id IS NULL THEN 'SYSTEM_ERROR' WHEN role <> 'MEMBER' THEN 'NOT_A_MEMBER' WHEN m.status <> 'ACTIVE' THEN 'ACCOUNT_NOT_ACTIVE' WHEN membership_expires_at < {N} THEN 'MEMBERSHIP_EXPIRED' WHEN due_date < {N} THEN 'BORROW_OVERDUE'
    WHEN renew_count >= max_renewals THEN 'MAX_RENEWALS_REACHED' WHEN coalesce(c.status, '') <> 'BORROWED' THEN 'BOOK_COPY_NOT_BORROWED' WHEN coalesce(b.deleted, true) THEN 'BOOK_DELETED'
    WHEN d.book_id IN (SELECT book_id FROM holds WHERE {LIVE}) THEN 'BLOCKED_BY_HOLD' ELSE 'SUCCESS' END AS reason_code FROM d LEFT JOIN members m ON m.id = d.member_id LEFT JOIN copies c ON c.id = d.copy_id LEFT JOIN books b ON b.id = d.book_id)
  SELECT id AS loan_id, member_id, CASE WHEN reason_code = 'SUCCESS' THEN 'SUCCESS' ELSE 'FAILED' END AS result, reason_code, due_date AS old_due_date, CASE WHEN reason_code = 'SUCCESS' THEN due_date + INTERVAL '7' DAY END AS new_due_date,
  renew_count AS count_before, renew_count + CASE WHEN reason_code = 'SUCCESS' THEN 1 ELSE 0 END AS count_after FROM j""")
def auto_renewals(loans, members, copies, books, holds):
    return lending.auto_renewal_attempts(loans, members, copies, books, holds, now(), c.at("1998-08-01"), c.at("1998-10-01"), most=5000)


# Holds and check-in


@query(f""", a AS (SELECT * FROM holds WHERE {LIVE}), j AS (SELECT r.*, CASE WHEN m.id IS NULL THEN 'RESOURCE_NOT_FOUND' WHEN role <> 'MEMBER' THEN 'NOT_A_MEMBER' WHEN m.status <> 'ACTIVE' THEN 'ACCOUNT_NOT_ACTIVE' WHEN membership_expires_at < {N} THEN 'MEMBERSHIP_EXPIRED'
    WHEN b.id IS NULL THEN 'RESOURCE_NOT_FOUND' WHEN coalesce(available_copies, 0) > 0 THEN 'BOOK_AVAILABLE_ON_SHELF' WHEN EXISTS (SELECT 1 FROM a WHERE a.member_id = r.member_id AND a.book_id = r.book_id) THEN 'HOLD_ALREADY_EXISTS' END AS pre
    FROM requests r LEFT JOIN members m ON m.id = r.member_id LEFT JOIN books b ON b.id = r.book_id AND NOT deleted),
  k AS (SELECT *, coalesce(pre, CASE WHEN row_number() OVER (PARTITION BY member_id, book_id, pre IS NULL ORDER BY asked_at NULLS LAST, id) > 1 THEN 'HOLD_ALREADY_EXISTS' ELSE 'WAITING' END) AS code FROM j)
  SELECT id, member_id, book_id, code, CASE WHEN code = 'WAITING' THEN coalesce((SELECT max(queue_position) FROM a WHERE a.book_id = k.book_id), 0) + CAST(sum(CASE WHEN code = 'WAITING' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY asked_at NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS queue_position,
  CASE WHEN code = 'WAITING' THEN {N} + INTERVAL '3' DAY END AS expires_at FROM k""")
def hold_placement(requests, members, books, holds):
    return lending.place_holds(requests, members, books, holds, now())


@query(STATE + f""", j AS (SELECT h.*, mid, account, unpaid, room, overdue, coalesce(c.status <> 'ON_HOLD_SHELF', true) AS away FROM holds h LEFT JOIN copies c ON c.id = assigned_copy_id LEFT JOIN st ON mid = h.member_id WHERE h.{LIVE}),
  asks AS (SELECT id AS k, reserved_at AS t, id, member_id AS m, assigned_copy_id AS i, id AS p, room, 1 AS free, status = 'READY_FOR_PICKUP' AND NOT away AND mid IS NOT NULL AND account IS NULL AND NOT unpaid AND NOT overdue AS able FROM j)
  {ALLOCATED}, x AS (SELECT j.*, CASE WHEN status <> 'READY_FOR_PICKUP' THEN 'HOLD_NOT_READY_FOR_PICKUP' WHEN away OR had_i > 0 THEN 'HOLD_ASSIGNED_COPY_INVALID' WHEN mid IS NULL THEN 'RESOURCE_NOT_FOUND' WHEN account IS NOT NULL THEN account
    WHEN unpaid THEN 'UNPAID_FINES' WHEN had_m >= room THEN 'BORROW_LIMIT_REACHED' WHEN overdue THEN 'OVERDUE_LOANS' ELSE 'FULFILLED' END AS code FROM j JOIN turns ON k = j.id)
  SELECT id, member_id, assigned_copy_id, code, CASE WHEN code = 'FULFILLED' THEN {N} + INTERVAL '14' DAY END AS due_date, CASE WHEN code = 'FULFILLED' THEN 'BORROWED' END AS copy_status FROM x""", recursive=True)
def hold_checkout(holds, copies, members, loans, ebook_loans):
    return lending.checkout_holds(holds, copies, members, loans, ebook_loans, now(), enow())


@query(f""", r AS (SELECT id, id AS hold_id, CASE WHEN id % 4 = 0 THEN member_id + 1 ELSE member_id END AS actor_id, id % 16 = 0 AS staff FROM holds WHERE id % 3 > 0 OR status = 'CANCELLED' UNION ALL SELECT -id, -id, id, true FROM members),
  j AS (SELECT r.id, r.hold_id, h.book_id, assigned_copy_id, c.status AS cs, CASE WHEN h.id IS NULL THEN 'RESOURCE_NOT_FOUND' WHEN NOT staff AND actor_id <> h.member_id THEN 'ACCESS_DENIED' WHEN NOT h.{LIVE} THEN 'HOLD_NOT_ACTIVE' ELSE 'CANCELLED' END AS code
    FROM r LEFT JOIN holds h ON h.id = r.hold_id LEFT JOIN copies c ON c.id = assigned_copy_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY hold_id) AS n FROM j WHERE code = 'CANCELLED' AND cs = 'ON_HOLD_SHELF'),
  rest AS (SELECT * FROM holds WHERE id NOT IN (SELECT hold_id FROM j WHERE code = 'CANCELLED')), q AS ({QUEUE.format(holds='rest')})
  SELECT j.id, j.hold_id, j.code, k.assigned_copy_id AS freed_copy_id, next_id AS next_hold_id, CASE WHEN next_id IS NOT NULL THEN 'ON_HOLD_SHELF' WHEN k.id IS NOT NULL THEN 'AVAILABLE' END AS copy_status, CASE WHEN next_id IS NOT NULL THEN {N} + INTERVAL '3' DAY END AS next_expires_at,
  CASE WHEN k.id IS NOT NULL THEN k.book_id END AS book_id, CAST(CASE WHEN k.id IS NOT NULL AND next_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS counter_delta FROM j LEFT JOIN k ON k.id = j.id LEFT JOIN q ON q.book_id = k.book_id AND q.place = k.n""")
def hold_cancellation(holds, copies, members):
    whose = F.when(F.col("id") % 4 == 0, F.col("member_id") + 1).otherwise(F.col("member_id"))
    requests = holds.where("id % 3 > 0 OR status = 'CANCELLED'").select("id", F.col("id").alias("hold_id"), whose.alias("actor_id"), (F.col("id") % 16 == 0).alias("staff"))
    requests = requests.unionByName(members.select((-F.col("id")).alias("id"), (-F.col("id")).alias("hold_id"), F.col("id").alias("actor_id"), F.lit(True).alias("staff")))
    return lending.cancel_holds(requests, holds, copies, now())


CHECKIN = f""", r AS (SELECT id, ' ' || lower(barcode) || ' ' AS barcode, {N} + CAST(id % 40 AS INTEGER) * INTERVAL '1' DAY AS returned_at, CASE WHEN id % 7 = 0 THEN 'damaged' WHEN id % 7 = 1 THEN ' ' END AS condition FROM copies UNION ALL SELECT -id, 'none', {N}, NULL FROM members),
  o AS (SELECT *, row_number() OVER (PARTITION BY copy_id ORDER BY borrowed_at DESC, id DESC) AS rn FROM loans WHERE status IN ('BORROWED', 'OVERDUE', 'LOST')),
  j AS (SELECT r.id, r.returned_at, c.book_id, c.id AS cid, o.id AS loan_id, o.fine_amount, upper(coalesce(nullif(trim(r.condition), ''), 'GOOD')) AS cond, CASE WHEN c.id IS NULL THEN 'RESOURCE_NOT_FOUND' WHEN o.id IS NULL THEN 'ACTIVE_BORROW_NOT_FOUND' ELSE 'RETURNED' END AS code,
    CASE WHEN o.id IS NOT NULL THEN CAST(greatest(date_diff('day', CAST(due_date + INTERVAL '7' HOUR AS DATE), CAST(r.returned_at + INTERVAL '7' HOUR AS DATE)), 0) AS BIGINT) END AS overdue_days, CAST(r.returned_at + INTERVAL '7' HOUR AS DATE) AS d
    FROM r LEFT JOIN copies c ON lower(trim(c.barcode)) = lower(trim(r.barcode)) LEFT JOIN o ON o.copy_id = c.id AND rn = 1),
  w AS (SELECT id, row_number() OVER (PARTITION BY book_id ORDER BY returned_at, id) AS n FROM j WHERE code = 'RETURNED' AND cond <> 'DAMAGED'), q AS ({QUEUE.format(holds='holds')})
  SELECT j.id, code, loan_id, overdue_days, CAST(CASE WHEN overdue_days > 0 THEN coalesce(overdue_days * (SELECT rate_per_day FROM fine_configs WHERE effective_from <= d AND (effective_until IS NULL OR effective_until > d) ORDER BY effective_from DESC, id DESC LIMIT 1), fine_amount) ELSE fine_amount END AS BIGINT) AS fine,
  CASE WHEN code = 'RETURNED' THEN CASE WHEN cond = 'DAMAGED' THEN 'DAMAGED' WHEN next_id IS NOT NULL THEN 'ON_HOLD_SHELF' ELSE 'AVAILABLE' END END AS copy_status, next_id AS next_hold_id, CASE WHEN next_id IS NOT NULL THEN returned_at + INTERVAL '3' DAY END AS next_expires_at,
  CASE WHEN code = 'RETURNED' THEN cid END AS copy_id, CASE WHEN code = 'RETURNED' THEN j.book_id END AS book_id, CAST(CASE WHEN code = 'RETURNED' AND cond <> 'DAMAGED' AND next_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS counter_delta
  FROM j LEFT JOIN w ON w.id = j.id LEFT JOIN q ON q.book_id = j.book_id AND q.place = w.n"""


@query(CHECKIN)
def check_ins(copies, loans, holds, fine_configs, members):
    when = now() + F.make_dt_interval((F.col("id") % 40).cast("int"))
    returns = copies.select("id", F.concat(F.lit(" "), F.lower("barcode"), F.lit(" ")).alias("barcode"), when.alias("returned_at"), F.when(F.col("id") % 7 == 0, "damaged").when(F.col("id") % 7 == 1, " ").alias("condition"))
    returns = returns.unionByName(members.select((-F.col("id")).alias("id"), F.lit("none").alias("barcode"), now().alias("returned_at"), F.lit(None).cast("string").alias("condition")))
    return lending.check_in(returns, copies, loans, holds, fine_configs)


@query(f""", x AS (SELECT h.*, c.id AS cid FROM (SELECT * FROM holds WHERE status IN ('NOTIFIED', 'READY_FOR_PICKUP') AND expires_at < {N} ORDER BY expires_at, id LIMIT 500) h LEFT JOIN copies c ON c.id = assigned_copy_id AND c.status = 'ON_HOLD_SHELF'),
  y AS (SELECT id, row_number() OVER (PARTITION BY book_id ORDER BY expires_at, id) AS n FROM x WHERE cid IS NOT NULL), q AS ({QUEUE.format(holds='holds')})
  SELECT x.id AS expired_id, x.book_id, cid AS copy_id, next_id, CASE WHEN next_id IS NOT NULL THEN 'ON_HOLD_SHELF' WHEN cid IS NOT NULL THEN 'AVAILABLE' END AS copy_status, CASE WHEN next_id IS NOT NULL THEN {N} + INTERVAL '3' DAY END AS next_expires_at,
  CAST(CASE WHEN cid IS NOT NULL AND next_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS counter_delta FROM x LEFT JOIN y ON y.id = x.id LEFT JOIN q ON q.book_id = x.book_id AND q.place = y.n""")
def hold_expiry(holds, copies):
    return lending.expired_hold_moves(holds, copies, now())


REMINDERS = f""", had AS (SELECT 'DUE_SOON_REMINDER' AS notification_type, CASE WHEN id % 6 = 0 THEN 'RESERVATION' ELSE 'BORROW_RECORD' END AS target_type, id AS target_id, CASE WHEN id % 9 = 0 THEN 'SMS' ELSE 'EMAIL' END AS channel FROM loans WHERE id % 3 = 0),
  d AS (SELECT * FROM loans WHERE status = 'BORROWED' AND due_date >= TIMESTAMP '1998-08-01' AND due_date < TIMESTAMP '1998-10-01' ORDER BY due_date, id LIMIT 500),
  n AS (SELECT d.*, title FROM d LEFT JOIN books b ON b.id = d.book_id WHERE NOT EXISTS (SELECT 1 FROM had WHERE target_type = 'BORROW_RECORD' AND channel = 'EMAIL' AND target_id = d.id)) """


def _queued(loans):
    return loans.where("id % 3 = 0").select(F.lit("DUE_SOON_REMINDER").alias("notification_type"), F.when(F.col("id") % 6 == 0, "RESERVATION").otherwise("BORROW_RECORD").alias("target_type"), F.col("id").alias("target_id"), F.when(F.col("id") % 9 == 0, "SMS").otherwise("EMAIL").alias("channel"))


@query(REMINDERS + "SELECT 'DUE_SOON_REMINDER' AS notification_type, 'BORROW_RECORD' AS target_type, id AS target_id, 'EMAIL' AS channel, 'PENDING' AS status, member_id FROM n")
def due_soon_reminders(loans, books):
    return lending.reminders(loans, books, _queued(loans), c.at("1998-08-01"), c.at("1998-10-01"))[1]


@query(REMINDERS + """SELECT id AS target_id, member_id, 'DUE_SOON_REMINDER' AS type, '"' || coalesce(title, 'N/A') || '" is due soon.' AS content FROM n""")
def due_soon_notifications(loans, books):
    return lending.reminders(loans, books, _queued(loans), c.at("1998-08-01"), c.at("1998-10-01"))[0]


# Copies, images, catalog


@query("SELECT id, book_id, barcode, status, condition, location FROM copies WHERE NOT deleted AND status = 'BORROWED' AND lower(barcode) LIKE '%1%' AND lower(condition) LIKE '%or%' AND lower(location) LIKE '%a-%' ORDER BY id")
def copy_search(copies):
    return lending.copy_search(copies, status="BORROWED", barcode="1", condition="OR", location="a-").select("id", "book_id", "barcode", "status", "condition", "location")


@query(f""", x AS (SELECT c.*, b.id IS NOT NULL AND NOT c.deleted AND c.status NOT IN ('BORROWED', 'ON_HOLD_SHELF') AS hit FROM copies c LEFT JOIN books b ON b.id = c.book_id AND b.deleted)
  SELECT id, book_id, status, deleted OR hit AS deleted, CASE WHEN hit THEN {N} END AS deleted_at, CASE WHEN hit THEN CAST(1 AS BIGINT) END AS deleted_by FROM x""")
def copies_soft_deleted(copies, books):
    return lending.soft_deleted(copies, books.where("deleted"), ("BORROWED", "ON_HOLD_SHELF"), now(), 1)


@query(f""", p AS (SELECT id FROM images WHERE status = 'DELETE_PENDING' ORDER BY age DESC, id LIMIT 25)
  SELECT id, CASE WHEN id IN (SELECT id FROM p) THEN 'PURGED' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM p) THEN {N} END AS deleted_at FROM images""")
def image_purge(images):
    return lending.purge(images, now())


@query("SELECT b.id, url FROM images i JOIN books b ON b.id = i.book_id WHERE is_primary AND url NOT LIKE '%/v%/%' UNION ALL SELECT id, NULL FROM books b WHERE NOT EXISTS (SELECT 1 FROM images WHERE book_id = b.id AND is_primary)")
def primary_image_urls(images, books):
    first = images.where("is_primary")
    good = first.where(~F.col("url").like("%/v%/%")).select(F.col("book_id").alias("id"), "url").join(books.select("id"), "id")
    without = books.select("id").join(first.select(F.col("book_id").alias("id")), "id", "left_anti")
    return good.unionByName(without.withColumn("url", F.lit(None).cast("string")))


@query("""SELECT b.id, title, isbn, language, author, available_copies, coalesce(avg(rating), 0.0) AS average, count(rating) AS n_reviews FROM books b LEFT JOIN reviews r ON r.book_id = b.id
  WHERE NOT deleted AND category_id = 3 AND b.id IN (SELECT book_id FROM book_authors JOIN authors a ON a.id = author_id WHERE lower(a.name) LIKE '%supplier%') GROUP BY 1, 2, 3, 4, 5, 6""")
def catalog_search_by_author(books, reviews, book_authors, authors):
    return catalog.book_search(books, reviews, category_id=3, author_name="Supplier", links=book_authors, authors=authors)


@query("SELECT id, title FROM books WHERE id IN (SELECT book_id FROM book_authors WHERE author_id = 4)")
def books_by_author(books, book_authors, authors):
    return catalog.books_by_author(books, book_authors, authors, author_id=4).select("id", "title")


@query("""SELECT b.id, title, c.name AS category_name, coalesce((SELECT string_agg(a.name || ':' || a.id, ',' ORDER BY a.name, a.id) FROM book_authors JOIN authors a ON a.id = author_id WHERE book_id = b.id), '') AS authors,
  coalesce((SELECT string_agg(k.barcode, ',' ORDER BY k.id) FROM copies k WHERE k.book_id = b.id AND NOT k.deleted), '') AS copies FROM books b LEFT JOIN categories c ON c.id = b.category_id WHERE NOT b.deleted""")
def book_details(books, book_authors, authors, categories, copies):
    d = catalog.book_details(books, book_authors, authors, categories, copies)
    names = F.array_join(F.transform("authors", lambda a: F.concat(a["name"], F.lit(":"), a["id"].cast("string"))), ",")
    return d.select("id", "title", "category_name", names.alias("authors"), F.array_join(F.transform("copies", lambda k: k["barcode"]), ",").alias("copies"))


@query("SELECT e.id, coalesce(title, 'N/A') AS title, left('Book cover for ' || coalesce(title, ''), 255) AS caption FROM book_ebooks e LEFT JOIN books b ON b.id = e.book_id AND NOT b.deleted")
def ebook_titles(book_ebooks, books):
    return catalog.ebook_titles(book_ebooks, lending.live(books))


@query("SELECT book_id, max(id) AS id, max_by(original_filename, id) AS original_filename FROM book_ebooks WHERE status = 'ACTIVE' GROUP BY 1")
def newest_ebooks(book_ebooks):
    return catalog.newest_ebooks(book_ebooks)


@query("SELECT id, name FROM categories WHERE lower(name) LIKE '%an%' ORDER BY name")
def category_names(categories):
    return categories.where(c.contains("AN", "name")).select("id", "name").orderBy("name", "id")


@query("SELECT id, title, isbn FROM books WHERE id >= coalesce(NULL, id) AND category_id <= coalesce(20, category_id) ORDER BY title DESC NULLS LAST, id LIMIT 30")
def sorted_book_page(books):
    kept = books.where(c.optional_bound("id", None, ">=") & c.optional_bound("category_id", 20, "<="))
    return paging.page(kept, paging.sort_order("title,desc", {"title": "title", "created": "id"}, "created,desc"), 0, 30).select("id", "title", "isbn")


UPDATES = """, u AS (SELECT id AS book_id, CASE WHEN id % 13 = 0 THEN 'other' ELSE isbn END AS old_isbn, CASE WHEN id % 11 = 0 THEN '12-3' WHEN id % 7 = 0 THEN '9780000000011' ELSE '979' || lpad(CAST(id AS VARCHAR), 10, '0') END AS new_isbn FROM books WHERE id % 5 = 0 UNION ALL SELECT -id, 'x', '978' || lpad(CAST(id AS VARCHAR), 10, '0') FROM categories) """


def _updates(books, categories):
    new = F.when(F.col("id") % 11 == 0, "12-3").when(F.col("id") % 7 == 0, "9780000000011").otherwise(F.concat(F.lit("979"), F.lpad(F.col("id").cast("string"), 10, "0")))
    u = books.where("id % 5 = 0").select(F.col("id").alias("book_id"), F.when(F.col("id") % 13 == 0, "other").otherwise(F.col("isbn")).alias("old_isbn"), new.alias("new_isbn"))
    return u.unionByName(categories.select((-F.col("id")).alias("book_id"), F.lit("x").alias("old_isbn"), F.concat(F.lit("978"), F.lpad(F.col("id").cast("string"), 10, "0")).alias("new_isbn")))


@query(UPDATES + """SELECT 'MISSING_OR_OLD_ISBN_MISMATCH' AS issue, book_id FROM u LEFT JOIN books b ON b.id = book_id WHERE b.id IS NULL OR isbn <> old_isbn UNION ALL
  SELECT 'NEW_ISBN_ALREADY_EXISTS_ON_OTHER_BOOK', book_id FROM u WHERE EXISTS (SELECT 1 FROM books b WHERE lower(b.isbn) = lower(new_isbn) AND b.id <> book_id) UNION ALL
  SELECT 'DUPLICATE_NEW_ISBN_IN_UPDATE_LIST', book_id FROM u WHERE lower(new_isbn) IN (SELECT lower(new_isbn) FROM u GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'NEW_ISBN_NOT_13_DIGITS', book_id FROM u WHERE NOT regexp_full_match(new_isbn, '[0-9]{13}')""")
def isbn_update_issues(books, categories):
    return catalog.isbn_repairs(books, _updates(books, categories))[0]


@query(UPDATES + "SELECT b.id, coalesce(n, isbn) AS isbn FROM books b LEFT JOIN (SELECT book_id, min(new_isbn) AS n FROM u GROUP BY 1) u ON u.book_id = b.id")
def isbn_updates(books, categories):
    return catalog.isbn_repairs(books, _updates(books, categories))[1]


# E-books, payments, sessions


RECEIPTS = """SELECT p.id AS payment_id, payment_code AS receipt_number, payment_code, p.member_id, full_name AS member_name, email AS member_email, provider, provider_transaction_id, provider_response_code, CAST(NULL AS VARCHAR) AS provider_transaction_status, purpose, target_type, target_id,
  coalesce(be.title, bf.title, target_type || ' #' || CAST(target_id AS VARCHAR)) AS item_title, amount, currency, p.status, paid_at, CAST(NULL AS TIMESTAMP) AS expired_at, p.created_at, CAST(NULL AS TIMESTAMP) AS updated_at FROM payments p JOIN members m ON m.id = p.member_id
  LEFT JOIN book_ebooks e ON target_type = 'BOOK_EBOOK' AND e.id = target_id LEFT JOIN books be ON be.id = e.book_id LEFT JOIN loans l ON target_type = 'BORROW_RECORD' AND l.id = target_id LEFT JOIN books bf ON bf.id = l.book_id """


@query(RECEIPTS)
def payment_receipts(payments, book_ebooks, books, loans, members):
    return catalog.receipts(payments, book_ebooks, books, loans, members)


@query(RECEIPTS + "WHERE provider = 'MOMO' AND p.status = 'SUCCESS' ORDER BY paid_at DESC NULLS LAST, p.created_at DESC, p.id LIMIT 20")
def payment_receipt_page(payments, book_ebooks, books, loans, members):
    found = catalog.receipts(payments.where("provider = 'MOMO' AND status = 'SUCCESS'"), book_ebooks, books, loans, members)
    return paging.page(found, [F.desc_nulls_last("paid_at"), F.desc("created_at"), F.col("payment_id")])


FULFILMENT = STATE + f""", ent AS (SELECT * FROM ebook_loans WHERE status = 'ACTIVE' AND expired_at > {E}),
  j AS (SELECT p.id, p.member_id, target_id AS ebook_id, paid_at, unpaid, room, loan_days, max_concurrent_loans - coalesce(u.n, 0) AS free, h.m IS NOT NULL AS own,
    CASE WHEN mid IS NULL THEN 'RESOURCE_NOT_FOUND' WHEN e.id IS NULL THEN 'EBOOK_NOT_FOUND' WHEN e.status <> 'ACTIVE' THEN 'EBOOK_NOT_AVAILABLE' END AS pre
    FROM payments p LEFT JOIN book_ebooks e ON e.id = target_id LEFT JOIN st ON mid = p.member_id LEFT JOIN (SELECT ebook_id, count(*) AS n FROM ent GROUP BY 1) u ON u.ebook_id = target_id
    LEFT JOIN (SELECT DISTINCT member_id AS m, ebook_id AS e FROM ent) h ON h.m = p.member_id AND h.e = target_id
    WHERE p.status = 'SUCCESS' AND target_type = 'BOOK_EBOOK' AND p.id NOT IN (SELECT payment_id FROM ebook_loans WHERE payment_id IS NOT NULL)),
  asks AS (SELECT id AS k, paid_at AS t, id, member_id AS m, ebook_id AS i, member_id || ':' || ebook_id AS p, room, free, pre IS NULL AND NOT own AND NOT unpaid AS able FROM j)
  {ALLOCATED}, o AS (SELECT j.*, coalesce(pre, CASE WHEN own OR had_p > 0 THEN 'ALREADY_HAS_ACTIVE_LOAN' WHEN unpaid THEN 'MEMBER_HAS_UNPAID_FINES' WHEN had_m >= room THEN 'BORROW_LIMIT_EXCEEDED' WHEN had_i >= free THEN 'LICENSE_UNAVAILABLE'
    ELSE 'FULFILLED' END) AS outcome FROM j JOIN turns ON k = j.id) """


@query(FULFILMENT + f"SELECT id, member_id, ebook_id, outcome, CASE WHEN outcome = 'FULFILLED' THEN {E} + CAST(loan_days AS INTEGER) * INTERVAL '1' DAY END AS expired_at FROM o", recursive=True)
def payment_fulfilment(payments, book_ebooks, members, loans, ebook_loans):
    return catalog.fulfilment(payments, book_ebooks, members, loans, ebook_loans, now(), enow())


_cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in catalog.MESSAGES.items())


@query(FULFILMENT + f""", t AS (SELECT id, outcome, CASE outcome {_cases} END AS message FROM o)
  SELECT p.id, CASE WHEN message IS NULL THEN CASE WHEN p.id % 3 = 0 THEN '{{"ebookFulfillmentStatus":"OLD","vnp_BankCode":"NCB"}}' END
    ELSE '{{"ebookFulfillmentAt":"2024-01-20T00:00:00Z","ebookFulfillmentMessage":"' || message || '","ebookFulfillmentStatus":"' || outcome || '"' || CASE WHEN p.id % 3 = 0 THEN ',"vnp_BankCode":"NCB"' ELSE '' END || '}}' END AS metadata
  FROM payments p LEFT JOIN t ON t.id = p.id""", recursive=True)
def payment_metadata(payments, book_ebooks, members, loans, ebook_loans):
    outcomes = catalog.fulfilment(payments, book_ebooks, members, loans, ebook_loans, now(), enow())
    old = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("vnp_BankCode"), F.lit("NCB"), F.lit("ebookFulfillmentStatus"), F.lit("OLD")))
    out = catalog.fulfilment_metadata(payments.select("id", old.alias("metadata")), outcomes, enow())
    return out.select("id", c.canonical_json(F.col("metadata")).alias("metadata"))


@query(RECEIPTS + """WHERE p.status = 'SUCCESS' AND paid_at >= TIMESTAMP '1995-01-01' AND paid_at <= TIMESTAMP '1998-01-01' AND (lower(payment_code) LIKE '%12%' OR lower(provider_transaction_id) LIKE '%12%' OR lower(full_name) LIKE '%12%'
  OR lower(email) LIKE '%12%' OR lower(be.title) LIKE '%12%' OR lower(bf.title) LIKE '%12%' OR p.id = 12 OR m.id = 12 OR target_id = 12)""")
def payment_receipt_search(payments, book_ebooks, books, loans, members):
    found = catalog.receipts(payments, book_ebooks, books, loans, members)
    return catalog.receipt_search(found, " 12 ", "SUCCESS", "1995-01-01", "1998-01-01")


@query(STATE + f""", ent AS (SELECT * FROM ebook_loans WHERE status = 'ACTIVE' AND expired_at > {E}), nw AS (SELECT * FROM book_ebooks WHERE status = 'ACTIVE' QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY id DESC) = 1),
  j AS (SELECT r.id, r.member_id, e.id AS ebook_id, asked_at, room, loan_days, max_concurrent_loans - coalesce(u.n, 0) AS free, x.until,
    CASE WHEN e.id IS NULL THEN 'EBOOK_NOT_FOUND' WHEN access_type <> 'FREE' THEN 'EBOOK_REQUIRES_PAYMENT' WHEN mid IS NULL THEN 'RESOURCE_NOT_FOUND' WHEN unpaid THEN 'UNPAID_FINES' END AS pre FROM requests r LEFT JOIN nw e ON e.book_id = r.book_id LEFT JOIN st ON mid = r.member_id
    LEFT JOIN (SELECT ebook_id, count(*) AS n FROM ent GROUP BY 1) u ON u.ebook_id = e.id LEFT JOIN (SELECT member_id, ebook_id, max(expired_at) AS until FROM ent GROUP BY 1, 2) x ON x.member_id = r.member_id AND x.ebook_id = e.id),
  asks AS (SELECT id AS k, asked_at AS t, id, member_id AS m, ebook_id AS i, member_id || ':' || coalesce(ebook_id, -1) AS p, room, free, pre IS NULL AND until IS NULL AS able FROM j)
  {ALLOCATED}, o AS (SELECT j.*, coalesce(pre, CASE WHEN had_m >= room THEN 'BORROW_LIMIT_REACHED' WHEN until IS NOT NULL OR had_p > 0 THEN 'EXISTING' WHEN had_i >= free THEN 'LICENSE_UNAVAILABLE' ELSE 'GRANTED' END) AS code FROM j JOIN turns ON k = j.id)
  SELECT id, member_id, ebook_id, code, CASE WHEN code = 'GRANTED' OR code = 'EXISTING' AND until IS NULL THEN {E} + CAST(loan_days AS INTEGER) * INTERVAL '1' DAY WHEN code = 'EXISTING' THEN until END AS expired_at FROM o""", recursive=True)
def ebook_grants(requests, book_ebooks, members, loans, ebook_loans):
    return lending.ebook_grants(requests, book_ebooks, members, loans, ebook_loans, now(), enow())


@query("""SELECT p.id, target_id AS loan_id, CASE WHEN l.id IS NULL THEN 'RESOURCE_NOT_FOUND' WHEN p.member_id <> l.member_id THEN 'ACCESS_DENIED' WHEN fine_amount <= 0 THEN 'FINE_NOT_FOUND' WHEN fine_paid_at IS NOT NULL THEN 'PAYMENT_ALREADY_SUCCESS' WHEN fine_waived_by IS NOT NULL THEN 'FINE_WAIVED' ELSE 'PAYABLE' END AS code,
  CASE WHEN p.member_id = l.member_id AND fine_amount > 0 AND fine_paid_at IS NULL AND fine_waived_by IS NULL THEN CAST(fine_amount AS BIGINT) END AS amount FROM (SELECT id, target_id, CASE WHEN id % 13 = 1 THEN member_id + 1 ELSE member_id END AS member_id FROM payments) p LEFT JOIN loans l ON l.id = target_id""")
def payable_fines(payments, loans):
    requests = payments.select("id", F.when(F.col("id") % 13 == 1, F.col("member_id") + 1).otherwise(F.col("member_id")).alias("member_id"), F.col("target_id").alias("loan_id"))
    return lending.payable_fines(requests, loans)


@query("SELECT id, access_type, fee FROM book_ebooks WHERE NOT ((access_type = 'FREE' AND fee = 0) OR (access_type = 'PAID' AND fee > 0))")
def ebook_policy_faults(book_ebooks):
    return lending.policy_faults(book_ebooks)


@query("""SELECT e.id, e.ebook_id, e.book_id, b.title, p.payment_code, c.name AS category_name FROM ebook_loans e LEFT JOIN payments p ON p.id = e.payment_id LEFT JOIN books b ON b.id = e.book_id LEFT JOIN categories c ON c.id = b.category_id""")
def ebook_loan_payments(ebook_loans, payments, books, categories):
    b = books.select(F.col("id").alias("book_id"), "title", "category_id")
    j = ebook_loans.select("id", "ebook_id", "book_id", "payment_id").join(payments.select(F.col("id").alias("payment_id"), "payment_code"), "payment_id", "left").join(b, "book_id", "left")
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return j.join(names, "category_id", "left").select("id", "ebook_id", "book_id", "title", "payment_code", "category_name")


@query("""SELECT DISTINCT m.id AS member_id, EXISTS (SELECT 1 FROM loans l WHERE l.member_id = m.id) AS has_history, (SELECT count(*) FROM holds h WHERE h.member_id = m.id) AS n_holds FROM members m""")
def member_existence(members, loans, holds):
    n = holds.groupBy("member_id").agg(F.count("*").alias("n_holds"))
    had = loans.select("member_id").distinct().withColumn("has_history", F.lit(True))
    return members.select(F.col("id").alias("member_id")).join(had, "member_id", "left").join(n, "member_id", "left").select("member_id", F.coalesce("has_history", F.lit(False)).alias("has_history"), F.coalesce("n_holds", F.lit(0)).alias("n_holds"))


_action = "CASE WHEN id % 10 IN (0, 1) THEN 'OPEN' WHEN id % 10 = 9 THEN CASE WHEN id % 20 = 9 THEN 'CLOSE' ELSE 'REVOKE' END WHEN id % 10 IN (2, 3) THEN 'READ' WHEN id % 10 = 8 AND id % 7 = 0 THEN 'PLAY' ELSE 'REFRESH' END"


@query(f""", e0 AS (SELECT id, member_id * 10 + id % 3 AS sid, CASE WHEN id % 23 = 0 THEN member_id + 1 ELSE member_id END AS member, id * 3 % 10 + 7001 AS ebook, {_action} AS action, {E} + CAST(id * 7 % 240 AS INTEGER) * INTERVAL '1' MINUTE + CAST(id % 2 AS INTEGER) * INTERVAL '30' SECOND AS t FROM requests),
  m AS (SELECT e0.id, max(expired_at) AS until FROM e0 JOIN ebook_loans l ON l.member_id = member AND l.ebook_id = ebook AND l.status = 'ACTIVE' AND borrowed_at <= t AND expired_at > t WHERE action = 'OPEN' GROUP BY 1),
  ev AS (SELECT e0.*, until, row_number() OVER (PARTITION BY sid ORDER BY t, e0.id) AS n FROM e0 LEFT JOIN m USING (id) WHERE action <> 'PLAY'),
  s(sid, n, id, code, fin, url, wrote, owner, loan_end, endd, written, state) AS (
    SELECT DISTINCT sid, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), false, CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR) FROM ev
    UNION ALL SELECT sid, n, id, code, CASE WHEN code = 'ACTIVE' THEN new_end END, CASE WHEN code = 'ACTIVE' AND action = 'READ' THEN least(t + INTERVAL '5' MINUTE, new_end) END, wrote, CASE WHEN begins THEN member ELSE owner END, CASE WHEN begins THEN until ELSE loan_end END,
      CASE WHEN code = 'ACTIVE' THEN new_end ELSE endd END, CASE WHEN wrote THEN t ELSE written END, CASE WHEN begins THEN 'ACTIVE' WHEN owner = member OR action = 'REVOKE' THEN CASE WHEN action IN ('CLOSE', 'REVOKE') AND owner IS NOT NULL THEN code ELSE state END ELSE state END
    FROM (SELECT *, code = 'ACTIVE' AND owner IS NULL AS begins, CASE WHEN code = 'ACTIVE' THEN CASE WHEN action = 'READ' THEN endd ELSE least(t + INTERVAL '15' MINUTE, coalesce(loan_end, until)) END END AS new_end,
        code = 'ACTIVE' AND action <> 'READ' AND (owner IS NULL OR written < t - INTERVAL '5' MINUTE) AS wrote
      FROM (SELECT ev.sid, ev.n, ev.id, ev.t, ev.member, ev.action, ev.until, x.owner, x.loan_end, x.endd, x.written, x.state, CASE WHEN x.owner IS NULL THEN CASE WHEN ev.action <> 'OPEN' THEN 'READING_SESSION_NOT_FOUND' WHEN ev.until IS NULL THEN 'EBOOK_LOAN_REQUIRED' ELSE 'ACTIVE' END
          WHEN ev.member <> x.owner AND ev.action <> 'REVOKE' THEN 'READING_SESSION_FORBIDDEN' WHEN ev.action IN ('CLOSE', 'REVOKE') THEN CASE WHEN x.state = 'ACTIVE' THEN CASE WHEN x.endd <= ev.t THEN 'EXPIRED' WHEN ev.action = 'CLOSE' THEN 'CLOSED' ELSE 'REVOKED' END ELSE x.state END
          WHEN x.state <> 'ACTIVE' OR x.endd <= ev.t THEN 'READING_SESSION_NOT_ACTIVE' ELSE 'ACTIVE' END AS code FROM s x JOIN ev ON ev.sid = x.sid AND ev.n = x.n + 1)))
  SELECT id, code, fin AS session_expires_at, url AS url_expires_at, wrote FROM s WHERE n > 0 UNION ALL SELECT id, 'BAD_REQUEST', NULL, NULL, false FROM e0 WHERE action = 'PLAY'""", recursive=True)
def reading_sessions(requests, ebook_loans):
    at = enow() + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 7 % 240).cast("int"), F.when(F.col("id") % 2 == 1, F.lit(30)).otherwise(F.lit(0)))
    who = F.when(F.col("id") % 23 == 0, F.col("member_id") + 1).otherwise(F.col("member_id"))
    events = requests.select("id", (F.col("member_id") * 10 + F.col("id") % 3).alias("session_id"), who.alias("member_id"), (F.col("id") * 3 % 10 + 7001).alias("ebook_id"), F.expr(_action).alias("action"), at.alias("at"))
    return sequences.reading_sessions(events, ebook_loans)


@query(""", ev AS (SELECT *, row_number() OVER (PARTITION BY k, who ORDER BY t, id) AS n FROM (SELECT id, idempotency_key AS k, user_id % 3 AS who, 'BEGIN' AS kind, request_hash AS q, received_at AS t, id AS request FROM callbacks
    UNION ALL SELECT -id - 1, idempotency_key, user_id % 3, CASE WHEN id % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END, NULL, received_at + CAST(id % 4 AS INTEGER) * INTERVAL '1' HOUR, id FROM callbacks WHERE id % 5 < 4)),
  s(k, who, n, id, answer, fin, q, status, running) AS (
    SELECT DISTINCT k, who, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM ev
    UNION ALL SELECT k, who, n, id, answer, CASE WHEN answer IN ('NEW', 'STORED') THEN t + INTERVAL '3' DAY ELSE fin END, CASE WHEN answer = 'NEW' THEN eq ELSE q END, CASE answer WHEN 'NEW' THEN 'PROCESSING' WHEN 'STORED' THEN kind ELSE status END,
      CASE answer WHEN 'NEW' THEN request WHEN 'STORED' THEN NULL ELSE running END
    FROM (SELECT ev.k, ev.who, ev.n, ev.id, ev.kind, ev.t, ev.request, ev.q AS eq, x.fin, x.q, x.status, x.running, CASE WHEN ev.kind <> 'BEGIN' THEN CASE WHEN ev.request = x.running THEN 'STORED' ELSE 'UNKNOWN_REQUEST' END WHEN x.fin IS NULL OR ev.t >= x.fin THEN 'NEW' WHEN x.q <> ev.q THEN 'CONFLICT'
        WHEN x.status = 'PROCESSING' THEN 'IN_PROGRESS' WHEN x.status = 'FAILED' THEN 'REPLAY_FAILURE' ELSE 'REPLAY' END AS answer FROM s x JOIN ev ON ev.k = x.k AND ev.who = x.who AND ev.n = x.n + 1))
  SELECT id, answer FROM s WHERE n > 0""", recursive=True)
def idempotent_requests(callbacks):
    began = callbacks.select("id", "idempotency_key", "request_hash", "received_at", (F.col("user_id") % 3).alias("actor_id"), F.lit("BEGIN").alias("kind"), F.col("id").alias("request_id"))
    kind = F.when(F.col("id") % 3 == 0, "FAILED").otherwise("COMPLETED")
    ended = began.where("id % 5 < 4").select((-F.col("id") - 1).alias("id"), "idempotency_key", F.lit(None).cast("string").alias("request_hash"), (F.col("received_at") + F.make_dt_interval(F.lit(0), (F.col("id") % 4).cast("int"))).alias("received_at"), "actor_id", kind.alias("kind"), "request_id")
    return sequences.idempotency(began.unionByName(ended), ttl=3 * 86_400)


@query(""", ev AS (SELECT id, user_id AS u, received_at AS t, row_number() OVER (PARTITION BY user_id ORDER BY received_at, id) AS n FROM callbacks),
  s(u, n, id, answer, begun, last, many) AS (SELECT DISTINCT u, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), 0 FROM ev
    UNION ALL SELECT u, n, id, answer, CASE WHEN answer = 'ALLOWED' THEN coalesce(begun, t) ELSE begun END, CASE WHEN answer = 'ALLOWED' THEN t ELSE last END, many + CASE WHEN answer = 'ALLOWED' THEN 1 ELSE 0 END
    FROM (SELECT *, CASE WHEN t < last + INTERVAL '6' HOUR THEN 'COOLDOWN' WHEN many >= 5 THEN 'LIMIT' ELSE 'ALLOWED' END AS answer FROM (SELECT ev.u, ev.n, ev.id, ev.t, x.last, CASE WHEN ev.t < x.begun + INTERVAL '4' DAY THEN x.begun END AS begun, CASE WHEN ev.t < x.begun + INTERVAL '4' DAY THEN many ELSE 0 END AS many
      FROM s x JOIN ev ON ev.u = x.u AND ev.n = x.n + 1)))
  SELECT id, answer FROM s WHERE n > 0""", recursive=True)
def rate_limited_sends(callbacks):
    return sequences.rate_limits(callbacks, cooldown=6 * 3600, most=5, window=4 * 86_400)


# Searches and pages by kept tables


@query("SELECT id, full_name, email, phone FROM members WHERE lower(full_name) LIKE '%0012_%' OR lower(email) LIKE '%0012_%' OR phone LIKE '%0012_%'")
def members_by_grams(members):
    folder = work_dir(members.sparkSession)
    search.write_grams(members, "id", ["full_name", "email", "phone"], f"{folder}/grams")
    return search.gram_search(members, "id", ["full_name", "email", "phone"], " 0012_ ", f"{folder}/grams").select("id", "full_name", "email", "phone")


@query("SELECT id, member_id, due_date, status FROM loans ORDER BY due_date DESC, id LIMIT 100 OFFSET 20000")
def deep_loan_page(loans):
    index = paging.PageIndex.build(loans.select("id", "member_id", "due_date", "status"), [F.desc_nulls_last("due_date"), F.col("id")])
    return index.page(200, 100)


@query("""SELECT id, CASE WHEN id % 13 = 0 THEN 'BAD_SIGNATURE' WHEN id % 11 = 0 THEN 'UNKNOWN_PAYMENT' WHEN id % 7 = 0 THEN 'AMOUNT_MISMATCH' WHEN status <> 'PENDING' THEN 'IGNORED' WHEN provider_response_code = '00' THEN 'SUCCESS' ELSE 'FAILED' END AS outcome,
  CASE WHEN id % 17 > 0 THEN date_trunc('second', created_at) END AS paid_at FROM payments""")
def signed_callbacks(payments):
    texts = {
        "vnp_TxnRef": F.when(F.col("id") % 11 == 0, "none").otherwise(F.col("payment_code")), "vnp_Amount": (F.col("amount") * 100 + F.when(F.col("id") % 7 == 0, 100).otherwise(0)).cast("string"),
        "vnp_ResponseCode": F.col("provider_response_code"), "vnp_TransactionStatus": F.lit("00"), "vnp_OrderInfo": F.lit("books & fines"),
        "vnp_PayDate": F.when(F.col("id") % 17 == 0, "soon").otherwise(F.date_format("created_at", "yyyyMMddHHmmss")),
    }
    params = F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), v)])
    signed = payments.select("id", F.col("created_at").alias("received_at"), params.alias("params")).withColumn("_hash", c.signature("secret")(F.col("params")))
    sent = F.when(F.col("id") % 13 == 0, F.reverse("_hash")).otherwise(F.upper("_hash"))
    events = signed.select("id", "received_at", F.map_concat("params", F.create_map(F.lit("vnp_SecureHash"), sent, F.lit("note"), F.lit("x"))).alias("params"))
    checked = catalog.verified(events, payments, "secret")
    return catalog.callback_outcomes(checked, payments, ("paid_at",)).select("id", "outcome", "paid_at")


# Counters


@query(""", after AS (SELECT book_id, CASE WHEN id % 5 = 0 THEN 'AVAILABLE' ELSE status END AS status FROM copies WHERE NOT (deleted OR id % 9 = 0) UNION ALL SELECT id, 'AVAILABLE' FROM books)
  SELECT book_id, count(*) AS total, count(*) FILTER (WHERE status = 'AVAILABLE') AS available FROM after GROUP BY 1""")
def counters_by_deltas(copies, books):
    """Counters kept from before a batch, with the batch's deltas; the SQL recounts the copies as they are after it."""
    changed = copies.where("id % 5 = 0 OR id % 9 = 0")
    new = changed.withColumns({"status": F.when(F.col("id") % 5 == 0, "AVAILABLE").otherwise(F.col("status")), "deleted": F.col("deleted") | (F.col("id") % 9 == 0)})
    added = books.select((-F.col("id")).alias("id"), F.col("id").alias("book_id"), F.lit("AVAILABLE").alias("status"), F.lit(False).alias("deleted"))
    names = ["id", "book_id", "status", "deleted"]
    deltas = transitions.book_deltas(changed.select(names), new.select(names).unionByName(added))
    return transitions.counted_on(transitions.book_counts(copies), deltas)


# Statistics, settings, invariants


@query(PERIOD.format(where="").replace("SELECT day, borrowed, returned, borrowed - returned AS net", ", z AS (SELECT day, borrowed, returned, borrowed - returned AS net") + """) SELECT CAST(sum(borrowed) AS BIGINT) AS borrowed, CAST(sum(returned) AS BIGINT) AS returned, CAST(sum(net) AS BIGINT) AS net, coalesce(CAST(max(day) FILTER (WHERE is_peak) AS VARCHAR), '') AS peak_day FROM z""")
def period_totals(loans, books):
    return circulation.period_totals(circulation.period_statistics(loans, books, "1998-05-01", "1998-05-21"))


@query("""SELECT 'S' || id AS key, CAST(least(greatest(coalesce(CASE WHEN id % 4 > 1 THEN id * 10 END, 7), 1), 150) AS BIGINT) AS number FROM categories""")
def setting_numbers(categories):
    key = F.concat(F.lit("S"), F.col("id").cast("string"))
    wanted = categories.select(key.alias("key"), F.lit(7).alias("fallback"), F.lit(1).alias("least"), F.lit(150).alias("most"))
    table = categories.where("id % 4 > 0").select(key.alias("key"), F.when(F.col("id") % 4 == 1, "ten").otherwise((F.col("id") * 10).cast("string")).alias("value"))
    return runs.setting_numbers(wanted, table)


def _in(*values: str) -> str:
    return "NOT IN (" + ", ".join(f"'{v}'" for v in values) + ")"


DOMAINS = {
    "loans": ("BORROWED", "RETURNED", "OVERDUE", "LOST"), "holds": ("WAITING", "NOTIFIED", "READY_FOR_PICKUP", "FULFILLED", "CANCELLED", "EXPIRED"),
    "ebook_loans": ("ACTIVE", "EXPIRED", "RETURNED", "REVOKED"), "payments": ("PENDING", "SUCCESS", "FAILED", "EXPIRED", "CANCELLED"), "members": ("PENDING_VERIFICATION", "ACTIVE", "INACTIVE", "BANNED"),
    "copies": ("AVAILABLE", "BORROWED", "RESERVED", "OVERDUE", "ON_HOLD_SHELF", "LOST", "DAMAGED", "REMOVED"), "book_ebooks": ("ACTIVE", "INACTIVE", "FAILED", "DELETED"),
}
ROW_RULES = {
    "books": {"available copies within total": "NOT (available_copies BETWEEN 0 AND total_copies)", "isbn is thirteen digits": "NOT {digits}"},
    "loans": {"due after borrowed, returned not before, fine not negative": "due_date <= borrowed_at OR returned_at < borrowed_at OR fine_amount < 0"},
    "ebook_loans": {"e-book loan ends after it begins": "expired_at <= borrowed_at"},
    "payments": {"positive amounts": "amount <= 0"},
    "reviews": {"ratings from 1 to 5": "rating < 1 OR rating > 5"},
    "holds": {}, "members": {}, "copies": {}, "book_ebooks": {"fee goes with access": "NOT ((access_type = 'FREE' AND fee = 0) OR (access_type = 'PAID' AND fee > 0))"},
}
for _t, _values in DOMAINS.items():
    ROW_RULES[_t][f"known states of {_t}"] = f"status {_in(*_values)}"
GROUPS = [
    ("one open loan per copy", "loans", "status IN ('BORROWED', 'OVERDUE', 'LOST')", ("copy_id",)),
    ("one active hold per member and book", "holds", LIVE, ("member_id", "book_id")),
    ("one active hold per assigned copy", "holds", f"{LIVE} AND assigned_copy_id IS NOT NULL", ("assigned_copy_id",)),
    ("one pending payment per target", "payments", "status = 'PENDING'", ("target_type", "target_id")),
    ("one successful payment per target", "payments", "status = 'SUCCESS'", ("target_type", "target_id")),
    ("one review per book and member", "reviews", "true", ("book_id", "member_id")),
    ("isbn is unique", "books", "true", ("lower(isbn)",)),
    ("one loan per payment", "ebook_loans", "payment_id IS NOT NULL", ("payment_id",)),
    ("one active e-book loan per member and e-book", "ebook_loans", "status = 'ACTIVE'", ("member_id", "ebook_id")),
    ("barcode is unique", "copies", "true", ("lower(barcode)",)),
]
PARENTS = [
    ("loans have members", "loans", "member_id", "members"), ("loans have books", "loans", "book_id", "books"), ("loans have copies", "loans", "copy_id", "copies"), ("holds have members", "holds", "member_id", "members"), ("holds have books", "holds", "book_id", "books"),
    ("assigned copies exist", "holds", "assigned_copy_id", "copies"), ("e-book loans have members", "ebook_loans", "member_id", "members"), ("e-book loans have e-books", "ebook_loans", "ebook_id", "book_ebooks"), ("e-book loans have books", "ebook_loans", "book_id", "books"), ("e-book loans have payments", "ebook_loans", "payment_id", "payments"),
    ("payments have members", "payments", "member_id", "members"), ("reviews have books", "reviews", "book_id", "books"), ("copies have books", "copies", "book_id", "books"), ("e-books have books", "book_ebooks", "book_id", "books"),
]
COUNTERS, AVAILABLE = "counters equal copies", "available counters equal copies on the shelf"


def _violation_sql() -> str:
    out = [f"SELECT '{r}' AS rule, count(*) FILTER (WHERE {x.format(digits="regexp_full_match(isbn, '[0-9]{13}')")}) AS violations FROM {t}" for t, rules in ROW_RULES.items() for r, x in rules.items()]
    out += [f"SELECT '{r}', count(*) FROM (SELECT 1 FROM {t} WHERE {w} GROUP BY {', '.join(k)} HAVING count(*) > 1)" for r, t, w, k in GROUPS]
    out += [f"SELECT '{r}', count(*) FROM {t} WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT id FROM {p})" for r, t, col, p in PARENTS]
    out.append(f"SELECT '{AVAILABLE}', count(*) FROM books b LEFT JOIN (SELECT book_id, count(*) FILTER (WHERE status = 'AVAILABLE') AS n FROM copies WHERE NOT deleted GROUP BY 1) c ON c.book_id = b.id WHERE available_copies <> coalesce(n, 0)")
    out.append(f"SELECT '{COUNTERS}', count(*) FROM books b LEFT JOIN (SELECT book_id, count(*) AS n FROM copies WHERE NOT deleted GROUP BY 1) c ON c.book_id = b.id WHERE total_copies <> coalesce(n, 0)")
    out.append("SELECT 'one reminder per target', count(*) FROM (SELECT 1 FROM (SELECT id % 1000 AS target, id % 3 AS channel FROM loans WHERE status = 'BORROWED') GROUP BY target, channel HAVING count(*) > 1)")
    return " UNION ALL ".join(out)


@query(_violation_sql())
def quality_violations(loans, holds, payments, reviews, members, books, copies, ebook_loans, book_ebooks):
    folder = work_dir(loans.sparkSession)
    # Both are joins, and every rule looks at them: they are made once, with the columns that rules name.
    loans = saved(loans.select("id", "member_id", "book_id", "copy_id", "status", "borrowed_at", "due_date", "returned_at", "fine_amount"), "loans", folder)
    payments = saved(payments.select("id", "member_id", "status", "target_type", "target_id", "amount"), "payments", folder)
    t = {"loans": loans, "holds": holds, "payments": payments, "reviews": reviews, "members": members, "books": books, "copies": copies, "ebook_loans": ebook_loans, "book_ebooks": book_ebooks}
    rows = [(t[name], {r: F.expr(x.format(digits="(isbn RLIKE '^[0-9]{13}$')")) for r, x in rules.items()}) for name, rules in ROW_RULES.items() if rules]
    actual = transitions.book_counts(copies).select(F.col("book_id").alias("_book"), "total", "available")
    counted = books.join(actual, F.col("id") == F.col("_book"), "left")
    rows.append((counted, {COUNTERS: F.col("total_copies") != F.coalesce("total", F.lit(0)), AVAILABLE: F.col("available_copies") != F.coalesce("available", F.lit(0))}))
    groups = [(r, t[name].where(w), [F.expr(k).alias(f"_k{i}") for i, k in enumerate(keys)]) for r, name, w, keys in GROUPS]
    sent = loans.where("status = 'BORROWED'").select((F.col("id") % 1000).alias("target"), (F.col("id") % 3).alias("channel"))
    groups.append(("one reminder per target", sent, ["target", "channel"]))
    return circulation.violations(rows, groups, [(r, t[name], col, t[p]) for r, name, col, p in PARENTS])
