import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from folioquarry.functions import columns as c  # noqa: E402
from folioquarry.operators import catalog, circulation, lending  # noqa: E402
from folioquarry.sources.domain import spark_views  # noqa: E402

TS = "TIMESTAMP_NTZ"


class Desk:
    """A small library: one member a rule, so that each outcome is read off the rules and not off another query."""

    def __init__(self, spark):
        self.members = spark.sql(f"""SELECT * FROM VALUES (1L, 'ok', 'MEMBER', 'ACTIVE', 2L, NULL), (2L, 'staff', 'LIBRARIAN', 'ACTIVE', 2L, NULL), (3L, 'banned', 'MEMBER', 'BANNED', 2L, NULL), (4L, 'old', 'MEMBER', 'ACTIVE', 2L, {TS} '2024-02-01'),
          (5L, 'owes', 'MEMBER', 'ACTIVE', NULL, NULL), (6L, 'full', 'MEMBER', 'ACTIVE', 1L, NULL), (7L, 'late', 'MEMBER', 'ACTIVE', 9L, NULL), (8L, 'today', 'MEMBER', 'ACTIVE', 3L, {TS} '2024-03-01') AS m(id, full_name, role, status, max_borrow_limit, membership_expires_at)""")
        self.books = spark.sql("SELECT * FROM VALUES (10L, 'a', 0L, false), (11L, 'b', 0L, false), (12L, 'c', 2L, false), (13L, 'gone', 0L, true) AS b(id, title, available_copies, deleted)")
        self.copies = spark.sql("""SELECT * FROM VALUES (100L, 10L, 'A-1', 'AVAILABLE', false), (101L, 10L, 'A-2', 'BORROWED', false), (102L, 13L, 'D-1', 'AVAILABLE', false), (103L, 11L, 'B-1', 'ON_HOLD_SHELF', false), (104L, 11L, 'B-2', 'BORROWED', false), (105L, 12L, 'C-1', 'BORROWED', NULL)
          AS c(id, book_id, barcode, status, deleted)""")
        self.loans = spark.sql(f"""SELECT *, CAST(NULL AS {TS}) AS fine_paid_at, CAST(NULL AS BIGINT) AS fine_waived_by, {TS} '2024-02-01' AS borrowed_at, CAST(NULL AS {TS}) AS returned_at, 2L AS max_renewals FROM VALUES
          (1000L, 1L, 12L, 105L, 'BORROWED', {TS} '2024-03-05', 0L, 0L), (1001L, 5L, 11L, 104L, 'RETURNED', {TS} '2024-02-10', 0L, 7L), (1002L, 6L, 11L, 104L, 'BORROWED', {TS} '2024-02-20', 2L, 0L), (1003L, 7L, 10L, 101L, 'OVERDUE', {TS} '2024-02-10', 0L, 0L)
          AS l(id, member_id, book_id, copy_id, status, due_date, renew_count, fine_amount)""")
        self.holds = spark.sql(f"""SELECT * FROM VALUES (500L, 8L, 11L, {TS} '2024-02-01', {TS} '2024-02-20', 'READY_FOR_PICKUP', 1L, 103L), (501L, 1L, 11L, {TS} '2024-02-02', NULL, 'WAITING', 2L, NULL), (502L, 7L, 11L, {TS} '2024-02-03', NULL, 'WAITING', NULL, NULL), (503L, 1L, 13L, {TS} '2024-02-03', NULL, 'CANCELLED', 1L, NULL)
          AS h(id, member_id, book_id, reserved_at, expires_at, status, queue_position, assigned_copy_id)""")
        self.files = spark.sql("SELECT * FROM VALUES (70L, 10L, 'ACTIVE', 'FREE', 0, 1L, 14L), (71L, 10L, 'INACTIVE', 'FREE', 0, 9L, 14L), (72L, 11L, 'ACTIVE', 'PAID', 5, 2L, 14L), (73L, 12L, 'ACTIVE', 'PAID', 0, 2L, 14L) AS e(id, book_id, status, access_type, fee, max_concurrent_loans, loan_days)")
        self.ebooks = spark.sql(f"SELECT * FROM VALUES (1L, 8L, 72L, 11L, 'ACTIVE', {TS} '2024-02-25', {TS} '2024-03-10', 40L), (2L, 8L, 70L, 10L, 'ACTIVE', {TS} '2024-01-01', {TS} '2024-01-15', NULL) AS l(id, member_id, ebook_id, book_id, status, borrowed_at, expired_at, payment_id)")
        self.configs = spark.sql("SELECT * FROM VALUES (1L, 3L, DATE '2020-01-01', NULL), (2L, 5L, DATE '2024-01-01', DATE '2025-01-01') AS f(id, rate_per_day, effective_from, effective_until)")


@pytest.fixture(scope="module")
def desk(spark):
    global NOW
    NOW = c.at("2024-03-01")  # a column needs a session
    return Desk(spark)


def codes(df, key="id", what="code"):
    return {r[key]: r[what] for r in df.collect()}


def test_checkout(spark, desk):
    ask = spark.createDataFrame([(k, k, 100) for k in (1, 2, 3, 4, 5, 6, 8, 99)] + [(17, 7, 100), (20, 1, 102), (21, 1, 999), (22, None, None), (23, 1, 101)], "id long, member_id long, copy_id long")
    got = codes(lending.checkout_blocks(ask, desk.copies, desk.books, desk.members, desk.loans, desk.ebooks, NOW, NOW), what="reasons")
    assert got == {1: "", 2: "NOT_A_MEMBER", 3: "ACCOUNT_NOT_ACTIVE", 4: "MEMBERSHIP_EXPIRED", 5: "UNPAID_FINES", 6: "BORROW_LIMIT_REACHED", 8: "", 99: "RESOURCE_NOT_FOUND", 17: "OVERDUE_LOANS,ALREADY_BORROWED_BOOK",
                   20: "COPY_NOT_AVAILABLE", 21: "COPY_NOT_FOUND", 22: "RESOURCE_NOT_FOUND,COPY_NOT_FOUND", 23: "COPY_NOT_AVAILABLE"}
    assert lending.checkout_blocks(ask.limit(0), desk.copies, desk.books, desk.members, desk.loans, desk.ebooks, NOW, NOW).count() == 0


def test_renewals(spark, desk):
    ask = spark.createDataFrame([(1, 1000, 1, False), (2, 1000, 2, False), (3, 1000, 2, True), (4, 1001, 5, False), (5, 1002, 6, False), (6, 1003, 7, True), (7, 5, 1, None)], "id long, loan_id long, actor_id long, staff boolean")
    out = lending.manual_renewals(ask, desk.loans, desk.members, desk.ebooks, desk.holds, NOW, NOW)
    assert codes(out) == {1: "OK", 2: "ACCESS_DENIED", 3: "OK", 4: "UNPAID_FINES", 5: "NOT_RENEWABLE", 6: "NOT_RENEWABLE", 7: "RESOURCE_NOT_FOUND"}
    assert str(out.where("id = 1").first().new_due_date) == "2024-03-12 00:00:00"
    held = desk.holds.unionByName(desk.holds.where("id = 501").withColumn("book_id", F.lit(12).cast("long")))
    assert codes(lending.manual_renewals(ask.where("id = 1"), desk.loans, desk.members, desk.ebooks, held, NOW, NOW)) == {1: "BLOCKED_BY_HOLD"}
    due = (c.at("2024-02-01"), c.at("2024-04-01"))
    run = lambda **more: codes(lending.auto_renewal_attempts(desk.loans, desk.members, desk.copies, desk.books, desk.holds, NOW, *due, **more), "loan_id", "reason_code")
    assert run() == {1000: "SUCCESS", 1002: "BORROW_OVERDUE"} and run(enabled=False) == {} and run(most=0) == {1002: "BORROW_OVERDUE"}
    assert run(overdue_allowed=True)[1002] == "MAX_RENEWALS_REACHED"


def test_holds(spark, desk):
    rows = [(1, 1, 10), (2, 1, 10), (3, 8, 10), (4, 1, 12), (5, 1, 11), (6, 1, 13), (7, 2, 10), (8, 99, 10), (9, 5, 11), (10, 8, 99)]
    ask = spark.createDataFrame(rows, "id long, member_id long, book_id long").withColumn("asked_at", F.when(F.col("id") != 1, c.at("2024-02-28")))
    out = lending.place_holds(ask, desk.members, desk.books, desk.holds, NOW)
    assert codes(out) == {1: "HOLD_ALREADY_EXISTS", 2: "WAITING", 3: "WAITING", 4: "BOOK_AVAILABLE_ON_SHELF", 5: "HOLD_ALREADY_EXISTS", 6: "RESOURCE_NOT_FOUND", 7: "NOT_A_MEMBER", 8: "RESOURCE_NOT_FOUND", 9: "WAITING", 10: "RESOURCE_NOT_FOUND"}
    assert codes(out, what="queue_position") | {} == {1: None, 2: 1, 3: 2, 4: None, 5: None, 6: None, 7: None, 8: None, 9: 3, 10: None}
    assert codes(lending.checkout_holds(desk.holds, desk.copies, desk.members, desk.loans, desk.ebooks, NOW, NOW)) == {500: "FULFILLED", 501: "HOLD_NOT_READY_FOR_PICKUP", 502: "HOLD_NOT_READY_FOR_PICKUP"}
    other = desk.copies.withColumn("status", F.lit("DAMAGED"))
    assert codes(lending.checkout_holds(desk.holds, other, desk.members, desk.loans, desk.ebooks, NOW, NOW))[500] == "HOLD_ASSIGNED_COPY_INVALID"
    ask = spark.createDataFrame([(1, 500, 8, False), (2, 501, 9, False), (3, 501, 9, True), (4, 503, 1, False), (5, 9, 1, False)], "id long, hold_id long, actor_id long, staff boolean")
    out = lending.cancel_holds(ask.where("id <> 3"), desk.holds, desk.copies, NOW)
    assert codes(out) == {1: "CANCELLED", 2: "ACCESS_DENIED", 4: "HOLD_NOT_ACTIVE", 5: "RESOURCE_NOT_FOUND"} and codes(out, what="next_hold_id")[1] == 501
    assert codes(lending.cancel_holds(ask.where("id in (1, 3)"), desk.holds, desk.copies, NOW), what="next_hold_id") == {1: 502, 3: None}  # 501 is cancelled with it
    (moved,) = lending.expired_hold_moves(desk.holds, desk.copies, NOW).collect()
    assert (moved.expired_id, moved.copy_id, moved.next_id, moved.copy_status, moved.counter_delta) == (500, 103, 501, "ON_HOLD_SHELF", 0)
    (freed,) = lending.expired_hold_moves(desk.holds.where("status <> 'WAITING'"), desk.copies, NOW).collect()
    assert (freed.copy_status, freed.counter_delta) == ("AVAILABLE", 1)


def test_check_in(spark, desk):
    rows = [(1, " a-2 ", None), (2, "B-2", "good"), (3, "C-1", "Damaged"), (4, "A-1", None), (5, "??", None), (6, None, None)]
    back = spark.createDataFrame(rows, "id long, barcode string, condition string").withColumn("returned_at", c.at("2024-03-02 18:00:00"))
    out = {r.id: r for r in lending.check_in(back, desk.copies, desk.loans, desk.holds, desk.configs).collect()}
    assert {k: r.code for k, r in out.items()} == {1: "RETURNED", 2: "RETURNED", 3: "RETURNED", 4: "ACTIVE_BORROW_NOT_FOUND", 5: "RESOURCE_NOT_FOUND", 6: "RESOURCE_NOT_FOUND"}
    assert (out[1].overdue_days, out[1].fine, out[1].copy_status) == (22, 110, "AVAILABLE")  # the local day is the third
    assert (out[2].copy_status, out[2].next_hold_id, out[2].overdue_days, out[2].fine) == ("ON_HOLD_SHELF", 501, 12, 60)
    assert (out[3].copy_status, out[3].overdue_days, out[3].fine) == ("DAMAGED", 0, 0) and out[5].copy_status is None


def test_ebooks_and_fines(spark, desk):
    ask = spark.createDataFrame([(1, 1, 10), (2, 7, 10), (3, 8, 11), (4, 5, 10), (5, 6, 10), (6, 99, 10), (7, 1, 99), (8, 1, 10)], "id long, member_id long, book_id long").withColumn("asked_at", NOW)
    got = codes(lending.ebook_grants(ask, desk.files, desk.members, desk.loans, desk.ebooks, NOW, NOW))
    assert got == {1: "GRANTED", 2: "LICENSE_UNAVAILABLE", 3: "EBOOK_REQUIRES_PAYMENT", 4: "UNPAID_FINES", 5: "BORROW_LIMIT_REACHED", 6: "RESOURCE_NOT_FOUND", 7: "EBOOK_NOT_FOUND", 8: "BORROW_LIMIT_REACHED"}  # member 1 had room for one, and the limit is looked at first
    assert [r.id for r in lending.policy_faults(desk.files).collect()] == [73]
    ask = spark.createDataFrame([(1, 5, 1001), (2, 1, 1001), (3, 1, 1000), (4, 1, 9), (5, None, 1001)], "id long, member_id long, loan_id long")
    assert codes(lending.payable_fines(ask, desk.loans)) == {1: "PAYABLE", 2: "ACCESS_DENIED", 3: "FINE_NOT_FOUND", 4: "RESOURCE_NOT_FOUND", 5: "ACCESS_DENIED"}
    paid = desk.loans.withColumn("fine_paid_at", NOW)
    assert codes(lending.payable_fines(ask, paid))[1] == "PAYMENT_ALREADY_SUCCESS"
    assert [r[0] for r in spark.sql("SELECT * FROM VALUES (2.5), (2.49), (NULL), (-0.5) AS t(x)").select(lending.whole_units(F.col("x"))).collect()] == [3, 2, 0, -1]


def test_fulfilment(spark, desk):
    pay = lambda rows: spark.createDataFrame(rows, "id long, member_id long, target_id long").selectExpr("*", "'SUCCESS' AS status", "'BOOK_EBOOK' AS target_type", f"{TS} '2024-02-28' AS paid_at")
    rows = [(1, 1, 72), (2, 7, 72), (3, 8, 72), (4, 1, 71), (5, 1, 999), (6, 5, 72), (7, 6, 72), (8, 99, 72), (9, 1, 72), (40, 1, 70), (10, 1, 70)]
    got = codes(catalog.fulfilment(pay(rows), desk.files, desk.members, desk.loans, desk.ebooks, NOW, NOW), what="outcome")
    # One licence of 72 is free: member 1 takes it; its second payment finds the loan, and its payment for 70 is over the limit.
    assert got == {1: "FULFILLED", 2: "LICENSE_UNAVAILABLE", 3: "ALREADY_HAS_ACTIVE_LOAN", 4: "EBOOK_NOT_AVAILABLE", 5: "EBOOK_NOT_FOUND", 6: "MEMBER_HAS_UNPAID_FINES", 7: "BORROW_LIMIT_EXCEEDED", 8: "RESOURCE_NOT_FOUND", 9: "ALREADY_HAS_ACTIVE_LOAN", 10: "BORROW_LIMIT_EXCEEDED"}


def test_copies_catalog_and_repairs(spark, desk):
    shelf = desk.copies.withColumns({"condition": F.when(F.col("id") < 103, "Good"), "location": F.lit("L1")})
    assert sorted(r.id for r in lending.copy_search(shelf, condition="OO", location=" ").collect()) == [100, 101, 102] and lending.copy_search(shelf, book_id=10, status="BORROWED", barcode="a-").first().id == 101
    gone = {r.id: r.deleted for r in lending.soft_deleted(desk.copies, desk.books.where("id in (10, 12)"), ("BORROWED",), NOW, 1).collect()}
    assert gone == {100: True, 101: False, 102: False, 103: False, 104: False, 105: False}
    images = spark.sql("SELECT * FROM VALUES (1L, 'DELETE_PENDING', 5), (2L, 'DELETE_PENDING', 9), (3L, 'ACTIVE', 9) AS i(id, status, age)")
    assert codes(lending.purge(images, NOW, 0), what="status") == {1: "DELETE_PENDING", 2: "PURGED", 3: "ACTIVE"}
    links, authors = spark.sql("SELECT * FROM VALUES (10L, 1L), (10L, 2L), (11L, 2L) AS l(book_id, author_id)"), spark.sql("SELECT * FROM VALUES (1L, 'Zed'), (2L, 'Zara') AS a(id, name)")
    assert sorted(r.id for r in catalog.books_by_author(desk.books, links, authors, author_name="z").collect()) == [10, 11]
    kinds = spark.sql("SELECT 1L AS id, 'k' AS name")
    d = {r.id: r for r in catalog.book_details(desk.books.withColumn("category_id", F.lit(None).cast("long")), links, authors, kinds, desk.copies).collect()}
    assert [a.name for a in d[10].authors] == ["Zara", "Zed"] and d[12].authors == [] and [k.barcode for k in d[10].copies] == ["A-1", "A-2"] and 13 not in d
    repair = spark.createDataFrame([(10, "a", "9790000000001"), (11, "zz", "9790000000001"), (99, "x", "12"), (12, "c", "B")], "book_id long, old_isbn string, new_isbn string")
    shelf = desk.books.withColumn("isbn", F.col("title"))
    issues, fixed = catalog.isbn_repairs(shelf, repair)
    assert sorted(map(tuple, issues.collect())) == [("DUPLICATE_NEW_ISBN_IN_UPDATE_LIST", 10), ("DUPLICATE_NEW_ISBN_IN_UPDATE_LIST", 11), ("MISSING_OR_OLD_ISBN_MISMATCH", 11), ("MISSING_OR_OLD_ISBN_MISMATCH", 99), ("NEW_ISBN_ALREADY_EXISTS_ON_OTHER_BOOK", 12), ("NEW_ISBN_NOT_13_DIGITS", 12), ("NEW_ISBN_NOT_13_DIGITS", 99)]
    assert codes(fixed, what="isbn") == {10: "9790000000001", 11: "9790000000001", 12: "B", 13: "gone"}


def test_receipts(spark, desk):
    p = spark.sql(f"""SELECT *, 'PAY' AS payment_code, 1L AS member_id, 5L AS amount, 'SUCCESS' AS status FROM VALUES (1L, 'BOOK_EBOOK', 72L), (2L, 'BORROW_RECORD', 1000L), (3L, 'BORROW_RECORD', 72L), (4L, 'BOOK_EBOOK', 1000L) AS p(id, target_type, target_id)""")
    out = catalog.receipts(p, desk.files, desk.books, desk.loans, desk.members.withColumn("email", F.lit("e")))
    assert len(out.columns) == 21 and codes(out, "payment_id", "item_title") == {1: "b", 2: "c", 3: "BORROW_RECORD #72", 4: "BOOK_EBOOK #1000"}
    said = lambda q, **more: sorted(r.payment_id for r in catalog.receipt_search(out, q, **more).collect())
    assert said("B") == [1] and said("72") == [1, 3] and said("record #") == [] and said(" pay ") == [1, 2, 3, 4] and said(None, status="FAILED") == [] and said("1") == [1, 2, 3, 4]
    assert said(None, paid_from="2024-01-01") == []  # none is paid


def test_metadata_is_merged(spark):
    old = spark.sql("SELECT * FROM VALUES (1L, map('bank', 'x', 'ebookFulfillmentStatus', 'OLD')), (2L, NULL), (3L, map('k', NULL)), (4L, NULL) AS p(id, metadata)")
    told = spark.createDataFrame([(1, "FULFILLED"), (2, "LICENSE_UNAVAILABLE"), (3, "RESOURCE_NOT_FOUND"), (9, "FULFILLED")], "id long, outcome string")
    out = codes(catalog.fulfilment_metadata(old, told, c.at("2024-03-01 01:02:03")), what="metadata")
    assert out[1] == {"bank": "x", "ebookFulfillmentStatus": "FULFILLED", "ebookFulfillmentMessage": "Ebook loan created", "ebookFulfillmentAt": "2024-03-01T01:02:03Z"}
    assert out[2]["ebookFulfillmentStatus"] == "LICENSE_UNAVAILABLE" and len(out[2]) == 3 and out[3] == {"k": None} and out[4] is None


def test_upsert_with_repeated_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "b2")], "id long, name string")
    new = spark.createDataFrame([(2, "z"), (2, "y"), (None, "n"), (3, None), (3, "t")], "id long, name string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(catalog.merged(old, new, "id")) == sorted([(1, "a"), (2, "y"), (None, "n"), (3, None)], key=str)
    assert rows(catalog.merged(old, new, "id", update=False)) == sorted([(1, "a"), (2, "b"), (None, "c"), (2, "b2"), (3, None)], key=str)
    assert rows(catalog.merged(old, new, "id", order=[F.desc("name")])) == sorted([(1, "a"), (2, "z"), (None, "n"), (3, "t")], key=str)


def test_statistics_span(spark, desk):
    with pytest.raises(ValueError):
        circulation.period_statistics(desk.loans, desk.books, "2024-01-01", "2024-01-22")
    days = circulation.period_statistics(desk.loans, desk.books, "2024-02-01", "2024-02-21")
    assert circulation.period_totals(days).first().asDict() == {"borrowed": 4, "returned": 0, "net": 4, "peak_day": "2024-02-01"}
    assert circulation.period_totals(circulation.period_statistics(desk.loans.limit(0), desk.books, "2024-02-01", "2024-02-01")).first().peak_day == ""


def test_nulls_empty_tables_repeats_and_clashing_columns(spark, desk):
    """Operators over empty tables, and over rows of nulls beside repeated ones with columns named like their work columns."""
    clash = {"_member": F.lit("x"), "_code": F.lit("x"), "_n": F.lit("x"), "state": F.lit("x"), "bad": F.lit("x"), "reason": F.lit("x"), "held": F.lit("x"), "count": F.lit("x")}

    def worse(df):
        nulls = df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        return df.unionByName(nulls).unionByName(df).withColumns(clash)

    d = desk
    ask = spark.createDataFrame([(1, 1, 10, 100, 1000, 1, 500, False)], "id long, member_id long, book_id long, copy_id long, loan_id long, actor_id long, hold_id long, staff boolean").withColumns({"asked_at": NOW, "returned_at": NOW, "barcode": F.lit("A-2"), "condition": F.lit(None).cast("string"), "ebook_id": F.lit(72).cast("long"), "at": NOW})
    for f in (worse, lambda df: df.limit(0)):
        m, b, k, l, h, e, v, g, a = map(f, (d.members, d.books, d.copies, d.loans, d.holds, d.files, d.ebooks, d.configs, ask))
        pay = f(spark.sql(f"SELECT 1L AS id, 1L AS member_id, 72L AS target_id, 'BOOK_EBOOK' AS target_type, 'SUCCESS' AS status, {TS} '2024-02-28' AS paid_at, 'c' AS payment_code, 5L AS amount"))
        reviews = f(spark.sql("SELECT 10L AS book_id, 3L AS rating"))
        calls = f(spark.sql(f"SELECT 1L AS id, 1L AS payment_id, {TS} '2024-02-28' AS received_at, true AS signature_valid, true AS amount_matches, true AS provider_success"))
        found = [
            lending.checkout_blocks(a, k, b, m, l, v, NOW, NOW), lending.manual_renewals(a, l, m, v, h, NOW, NOW), lending.auto_renewal_attempts(l, m, k, b, h, NOW, c.at("2024-01-01"), c.at("2024-12-01")), lending.place_holds(a, m, b, h, NOW),
            lending.checkout_holds(h, k, m, l, v, NOW, NOW), lending.cancel_holds(a, h, k, NOW), lending.check_in(a, k, l, h, g), lending.expired_hold_moves(h, k, NOW), lending.ebook_grants(a, e, m, l, v, NOW, NOW), lending.payable_fines(a, l),
            lending.checkouts(a, k, b, m, l, v, NOW, NOW), lending.policy_faults(e), lending.live(k), catalog.fulfilment(pay, e, m, l, v, NOW, NOW), catalog.callback_outcomes(calls, pay), catalog.receipts(pay, e, b, l, m.withColumn("email", F.lit("e"))), catalog.review_stats(reviews), catalog.rating_histograms(reviews),
            circulation.borrow_counts(l, NOW), circulation.ebook_counts(v, NOW), circulation.unpaid_fines(l), circulation.active_holds(h), circulation.fine_list(l), circulation.hold_heads(h), circulation.mark_overdue(l, NOW), circulation.effective_fines(l, g), circulation.member_stats(m, l, v, h, NOW, NOW),
        ]
        rows = [df.collect() for df in found]
        assert f is worse or not any(rows[:18])


def test_views_bind(spark):
    for df in spark_views(spark, "/root/testdata/sf0.001", "authors", "book_authors", "categories", "copies", "book_ebooks", "requests", "images"):
        assert df.count() > 0


def test_returns_are_dealt_out_by_book_once(spark, desk):
    """Ranks and the queue meet without a join of their own, and rows that free no copy have no partition in common."""
    back = spark.sql("SELECT * FROM VALUES (1L, 'x', TIMESTAMP_NTZ '2024-01-15', 'GOOD'), (2L, NULL, NULL, NULL) AS r(id, barcode, returned_at, condition)")
    plan = lending.check_in(back, desk.copies, desk.loans, desk.holds, desk.configs)._jdf.queryExecution().optimizedPlan().toString()
    assert "_place" not in "".join(line for line in plan.splitlines() if "Join" in line)
    rows = spark.sql("SELECT * FROM VALUES (1L, 7L, true), (2L, 7L, true), (3L, 7L, true), (4L, 7L, false), (5L, NULL, true), (6L, 8L, true) AS r(id, book, frees)")
    waiting = spark.sql("SELECT * FROM VALUES (7L, 71L, 1), (7L, 72L, 2), (9L, 91L, 1), (CAST(NULL AS LONG), 11L, 1) AS q(_queue_book, _next, _place)")
    got = lending.with_next(rows.repartition(4), F.col("frees"), "book", ["id"], waiting)
    assert {r.id: r._next for r in got.collect()} == {1: 71, 2: 72, 3: None, 4: None, 5: None, 6: None}


def test_only_renewable_loans_meet_the_holds(spark, desk):
    """A loan's book goes to the join with holds alone, and not with its requests."""
    ask = desk.loans.select("id", F.col("id").alias("loan_id"), F.col("member_id").alias("actor_id"), F.lit(False).alias("staff"))
    plan = lending.manual_renewals(ask, desk.loans, desk.members, desk.ebooks, desk.holds, NOW, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert [("LeftSemi" in line) for line in plan.splitlines() if "Join" in line and "_held_book" in line] == [True]
