import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))
from pyspark.sql import functions as F  # noqa: E402

from folioquarry.functions import columns as c  # noqa: E402
from folioquarry.operators import circulation  # noqa: E402


def test_search_looks_in_isbn_phone_barcode_files_codes_and_ids(spark):
    members = spark.sql("SELECT id, concat('m', chr(96 + id)) AS full_name, 'x@y' AS email, CASE WHEN id = 4 THEN '555-77' END AS phone FROM range(1, 6)")
    books = spark.sql("SELECT id, 'title' AS title, CASE WHEN id = 22 THEN '97800000077' ELSE 'X' END AS isbn FROM range(20, 26)")
    copies = spark.sql("SELECT * FROM VALUES (301L, 'a', 'OK'), (302L, 'b', 'OK'), (77L, 'c', 'OK'), (304L, 'd', 'OK'), (305L, 'bar77', 'OK'), (306L, NULL, 'OK') AS c(id, barcode, status)")
    at = "TIMESTAMP_NTZ '1998-01-01'"
    loans = spark.sql(f"""SELECT l.*, 'BORROWED' AS status, {at} AS borrowed_at, {at} AS due_date, {at} AS returned_at, 0L AS renew_count, 2L AS max_renewals, 0L AS fine_amount, CAST(NULL AS TIMESTAMP_NTZ) AS fine_paid_at, CAST(NULL AS BIGINT) AS fine_waived_by
      FROM VALUES (77L, 1L, 21L, 301L), (102L, 2L, 22L, 302L), (103L, 3L, 23L, 77L), (104L, 4L, 23L, 304L), (105L, 5L, 23L, 305L), (106L, 5L, 24L, 306L) AS l(id, member_id, book_id, copy_id)""")
    ebooks = spark.sql(f"SELECT e.*, 'ACTIVE' AS status, {at} AS borrowed_at, {at} AS expired_at FROM VALUES (900L, 3L, 22L, 8L), (901L, 3L, 23L, NULL), (902L, 3L, 25L, 9L) AS e(id, member_id, book_id, payment_id)").withColumn("ebook_id", F.col("book_id") + 500)
    files = spark.sql("SELECT 523L AS id, 'f-77.pdf' AS original_filename")
    payments = spark.sql("SELECT 9L AS id, 'PAY-77' AS payment_code")

    def found(q, **more):
        out = circulation.loan_search(loans, ebooks, members, books, copies, files, payments, c.at("1998-09-02"), c.at("1998-09-02"), q=q, **more)
        assert len(out.columns) == 24
        return sorted(r.borrow_id or r.ebook_loan_id for r in out.collect())

    everything = [77, 102, 103, 104, 105, 106, 900, 901, 902]
    assert found(" 77 ") == [77, 102, 103, 104, 105, 900, 901, 902]
    assert found("+5") == [105, 106] and found("21") == [77] and found("bar") == [105] and found("8") == [102, 900]
    assert found("77", fields=("full_name", "email", "title")) == []
    assert found("523") == [901]  # an e-book's id is not its book's
    out = circulation.loan_search(loans, ebooks, members, books, copies, files, payments, c.at("1998-09-02"), c.at("1998-09-02"))
    assert {(r.book_id, r.book_ebook_id) for r in out.where("loan_type = 'EBOOK'").collect()} == {(22, 522), (23, 523), (25, 525)}
    assert found(None) == everything and found(None, overdue=False, open_only=False) == everything and found(None, member_id=5) == [105, 106]
    assert [c.whole_number(q) for q in ("7_7", "9" * 19, str(2**63 - 1), "-3", None, "1.0")] == [None, None, 2**63 - 1, -3, None, None]
