import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))
import pyspark.sql.functions as F  # noqa: E402
import pytest  # noqa: E402

from folioquarry.functions.columns import fine_status, signature  # noqa: E402
from folioquarry.operators.catalog import callback_outcomes, verified  # noqa: E402
from folioquarry.operators.paging import bounds, head_of, page, sort_order  # noqa: E402
from folioquarry.operators.sequences import idempotency, rate_limits, reading_sessions  # noqa: E402
from folioquarry.sources import runs  # noqa: E402
from folioquarry.sources.catalog_csv import plan_import, read_rows, run_import  # noqa: E402
from folioquarry.sources.domain import spark_views  # noqa: E402
from folioquarry.streaming.callbacks import answered_requests, payment_decisions, rate_limited  # noqa: E402

CSV = '''Title,isbn,AUTHORS,Category,barcode,Published_Date,language
"Herons, A Field Year",9791000000017,"Ada ""Reed"" Marsh|Ben Fen; ben fen ","Nature, Birds",SHELF-9,2011-04-30,fr

Second Herons,9791000000017,Ben Fen,Nature,SHELF-10,,
Pair,9791000000024,C,,SHELF-11,,
Pair,9791000000024,C,,shelf-11 ,,
On Shelf,9791000000031,C,,Old-1,,
Nobody,9791000000048, ; ,,SHELF-12,,
Year Only,9791000000055,C,,SHELF-13,2011,
Gone,9791000000062,C,,SHELF-14,,
Known,9791000000079,D,Maps,SHELF-15,,
'''


def tables(spark):
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    return frame([("old-1",)], "barcode string"), frame([(7, "9791000000062", True), (9, "9791000000079", False)], "id long, isbn string, deleted boolean"), frame([(3, "BEN fen")], "id long, name string"), frame([(1, "maps")], "id long, name string")


def test_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    out = plan_import(read_rows(spark, str(tmp_path / "a.csv")), *tables(spark))
    assert out.summary.first().asDict() == {"total": 9, "success": 3, "failed": 6, "created_books": 1, "created_copies": 3}
    assert sorted((r.row_number, r.code) for r in out.errors.collect()) == [(4, "DUPLICATE_RESOURCE"), (5, "DUPLICATE_RESOURCE"), (6, "DUPLICATE_RESOURCE"), (7, "BAD_REQUEST"), (8, "BAD_REQUEST"), (9, "DUPLICATE_RESOURCE")]
    (book,) = out.books.collect()
    assert (book.id, book.title, book.language, str(book.day), book.category_id) == (10, "Herons, A Field Year", "fr", "2011-04-30", 2)
    assert [(r.id, r.name) for r in out.authors.collect()] == [(4, 'Ada "Reed" Marsh')] and [(r.id, r.name) for r in out.categories.collect()] == [(2, "Nature, Birds")]
    assert sorted(r.author_id for r in out.book_authors.collect()) == [3, 4]
    assert sorted((r.book_id, r.barcode, r.status) for r in out.copy_rows.collect()) == [(9, "SHELF-15", "AVAILABLE"), (10, "SHELF-10", "AVAILABLE"), (10, "SHELF-9", "AVAILABLE")]


def test_refused_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(CSV)
    for bad in (dict(most_rows=3), dict(most_bytes=40)):
        with pytest.raises(ValueError):
            read_rows(spark, str(path), **bad)
    with pytest.raises(ValueError):
        read_rows(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("title,isbn\nx,y\n")
    for name in ("b.csv", "c.csv"):
        with pytest.raises(ValueError):
            read_rows(spark, str(tmp_path / name))


def test_run_log_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    log, sink = str(tmp_path / "log"), str(tmp_path / "copies")
    run_import(spark, str(tmp_path / "a.csv"), log, "import", sink, *tables(spark))
    with pytest.raises(ValueError):
        run_import(spark, str(tmp_path), log, "import", sink, *tables(spark))
    said = {r.status: r for r in runs.runs(spark.read.parquet(log)).collect()}
    assert set(said) == {"COMPLETED", "FAILED"} and (said["COMPLETED"].total, said["COMPLETED"].succeeded, said["COMPLETED"].failed) == (9, 3, 6) and said["FAILED"].message
    assert spark.read.parquet(sink).count() == 3 and runs.cut("x" * 3000) == "x" * 2000 and runs.cut(None) is None
    good, bad = spark.range(4), spark.range(1)
    assert runs.progress("j", good, bad).first().asDict() == {"job_id": "j", "processed": 5, "succeeded": 4, "failed": 1}
    table = spark.createDataFrame([("A", "12"), ("B", "x"), ("C", "TRUE"), ("D", None)], "key string, value string")
    s = runs.Settings(table)
    assert (s.number("A", 1), s.number("A", 1, 0, 7), s.number("B", 5), s.number("Z", 5, 6), s.flag("C", False), s.flag("B", True), s.flag("Z", True)) == (12, 7, 5, 6, True, False, True)
    e = runs.received_events(spark.sql("SELECT 1 AS id, 'p' AS payment_code, 'IPN' AS event_type, map('vnp_b', '2', 'other', 'x', 'vnp_a', '1') AS params, CAST(NULL AS MAP<STRING, STRING>) AS headers")).first()
    assert e.payload == '{"vnp_a":"1","vnp_b":"2"}' and e.headers == "{}" and e.processing_status == "RECEIVED"


def test_small_rules(spark):
    df = spark.sql("SELECT * FROM VALUES (0, NULL, NULL), (5, NULL, NULL), (5, 1, 1), (5, NULL, 1) AS t(fine_amount, fine_paid_at, fine_waived_by)")
    assert [tuple(r) for r in df.select(fine_status(), fine_status(True)).collect()] == [("NONE", "NONE"), ("UNPAID", "UNPAID"), ("PAID", "WAIVED"), ("WAIVED", "WAIVED")]
    assert bounds(-1, 0) == (0, 20) and bounds(2, 500) == (2, 100) and bounds(0, 500, most=50) == (0, 50)
    with pytest.raises(ValueError):
        sort_order("x,desc", {"title": "title"}, "title,asc")
    rows = spark.sql("SELECT * FROM VALUES (1, 'b'), (2, NULL), (3, 'a'), (4, 'b') AS t(id, title)")
    assert [r.id for r in page(rows, sort_order("title,desc", {"title": "title"}, "title,asc"), 0, 10).collect()] == [1, 4, 3, 2]
    assert sorted(r.id for r in head_of(rows.withColumn("_n", F.lit(0)), ["title"], F.desc("id")).collect()) == [2, 3, 4]
    signed = spark.range(1).select(signature("key")(F.create_map(F.lit("b"), F.lit("2 3"), F.lit("a"), F.lit("1"))).alias("s")).first().s
    import hashlib
    import hmac

    assert signed == hmac.new(b"key", b"a=1&b=2+3", hashlib.sha512).hexdigest()


def test_callbacks_from_parameters(spark):
    payments = spark.sql("SELECT * FROM VALUES (1L, 'P1', 250L, 'PENDING'), (2L, 'P2', 100L, 'PENDING') AS p(id, payment_code, amount, status)")
    rows = [(1, "P1", "25000", "00", "00"), (2, "P1", "25000", "00", "00"), (3, "P2", "9900", "00", "00"), (4, "P2", "10000", "24", "00"), (5, "P9", "1", "00", "00"), (6, "P2", "x", "00", "00")]
    events = spark.createDataFrame([(k, f"2024-01-01 00:00:0{k}", {"vnp_TxnRef": ref, "vnp_Amount": a, "vnp_ResponseCode": r, "vnp_TransactionStatus": t, "note": "n"}) for k, ref, a, r, t in rows], "id long, received_at string, params map<string,string>")
    events = events.withColumn("received_at", F.col("received_at").cast("timestamp"))
    hashed = events.withColumn("params", F.map_concat("params", F.create_map(F.lit("vnp_SecureHash"), F.upper(signature("s")(F.map_filter("params", lambda k, v: k.startswith("vnp_")))))))
    assert {r.id: r.outcome for r in callback_outcomes(verified(hashed, payments, "s"), payments).collect()} == {1: "SUCCESS", 2: "IGNORED", 3: "AMOUNT_MISMATCH", 4: "FAILED", 5: "UNKNOWN_PAYMENT", 6: "AMOUNT_MISMATCH"}
    assert {r.outcome for r in callback_outcomes(verified(events, payments, "s"), payments).collect()} == {"BAD_SIGNATURE"}
    both = callback_outcomes(verified(hashed, payments, "s"), payments, ("paid_at",))
    assert {r.id: (r.outcome, r.paid_at) for r in both.collect()}[4] == ("FAILED", None)
    plan = callback_outcomes(verified(events, payments, "s"), payments, ("paid_at",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sign(") == 1 and plan.index("sign(") > plan.rindex("Join")  # signed once, below the joins


def stream(spark, df, tmp_path, f, name):
    df.repartition(1).write.parquet(str(tmp_path / name))
    q = f(spark.readStream.schema(df.schema).parquet(str(tmp_path / name))).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    if not q.awaitTermination(90):
        q.stop()
        raise AssertionError("the stream doesn't end")
    return spark.table(name).collect()


def test_streams_and_their_batch_twins(spark, tmp_path):
    callbacks, payments = spark_views(spark, "/root/testdata/sf0.001", "callbacks", "payments")
    pending = callbacks.join(payments.where("status = 'PENDING'").select(F.col("id").alias("payment_id")), "payment_id", "left_semi")
    want = {(r.id, r.payment_id, r.outcome) for r in callback_outcomes(pending, payments).collect()}
    assert {tuple(r) for r in stream(spark, pending, tmp_path, payment_decisions, "decisions")} == want
    times = [0, 30, 60, 130, 200, 270, 340, 86_399, 86_400, 86_430]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)] + [(None, 90, 5), (2, 91, 5)], "user_id long, id long, t long").select("user_id", "id", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("received_at"))
    want = ["ALLOWED", "COOLDOWN", "ALLOWED", "ALLOWED", "ALLOWED", "ALLOWED", "LIMIT", "LIMIT", "ALLOWED", "COOLDOWN"]
    got = [r.answer for r in sorted(stream(spark, df.where("user_id = 1"), tmp_path, rate_limited, "limits"), key=lambda r: r.id)]
    assert got == want
    assert [r.answer for r in rate_limits(df).orderBy("id").collect()] == [*want, "ALLOWED", "ALLOWED"]
    rows = [("a", 1, "x", 0), ("a", 2, "x", 3599), ("a", 3, "y", 3599), ("a", 4, "y", 3600), ("a", 5, "x", 7000), ("b", 6, "x", 1), (" a ", 7, "y", 7100)]
    ends = [("b", 8, None, 50, "FAILED", "6"), ("b", 9, "x", 3640, "BEGIN", None), ("b", 10, "x", 3650, "BEGIN", None), ("b", 11, None, 3651, "COMPLETED", "10"), ("b", 12, "x", 3652, "BEGIN", None), ("b", 13, None, 3653, "COMPLETED", "10"), ("b", 14, "z", 3654, "BEGIN", None)]
    asked = spark.createDataFrame([(*r, "BEGIN", None) for r in rows] + ends, "idempotency_key string, id long, request_hash string, t long, kind string, request_id string").withColumn("received_at", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
    want = {1: "NEW", 2: "IN_PROGRESS", 3: "CONFLICT", 4: "NEW", 5: "CONFLICT", 6: "NEW", 7: "IN_PROGRESS"}
    want |= {8: "STORED", 9: "REPLAY_FAILURE", 10: "NEW", 11: "STORED", 12: "REPLAY", 13: "UNKNOWN_REQUEST", 14: "CONFLICT"}
    assert {r.id: r.answer for r in idempotency(asked).collect()} == want
    assert {r.id: r.answer for r in stream(spark, asked, tmp_path, answered_requests, "answers")} == want
    scoped = asked.withColumn("actor_id", F.col("id"))
    assert {r.answer for r in idempotency(scoped.where("kind = 'BEGIN'")).collect()} == {"NEW"}
    blank = asked.withColumn("idempotency_key", F.when(F.col("id") > 3, " "))
    assert {r.answer for r in idempotency(blank).collect()} == {"KEY_REQUIRED"} and idempotency(asked.limit(0)).count() == 0
    # A null time, or an unknown kind, holds nothing.
    odd = asked.where("id < 4").withColumns({"received_at": F.when(F.col("id") > 1, F.col("received_at")), "kind": F.when(F.col("id") == 2, "PLAY").otherwise("BEGIN")})
    assert {r.id: r.answer for r in idempotency(odd).collect()} == {1: "TIME_REQUIRED", 2: "UNKNOWN_KIND", 3: "NEW"}
    assert {r.answer for r in rate_limits(df.withColumn("received_at", F.lit(None).cast("timestamp"))).collect()} == {"TIME_REQUIRED"}


def test_a_late_end_overwrites_the_next_holder(spark):
    rows = [(1, "x", 0, "BEGIN", "1"), (2, "y", 20, "BEGIN", "2"), (3, None, 21, "COMPLETED", "1"), (4, "y", 22, "BEGIN", "4"), (5, "x", 23, "BEGIN", "5"), (6, None, 24, "FAILED", "2"), (7, "y", 25, "BEGIN", "7")]
    df = spark.createDataFrame(rows, "id long, request_hash string, t long, kind string, request_id string").selectExpr("*", "'k' AS idempotency_key", "timestamp_seconds(t) AS received_at")
    assert [r.answer for r in idempotency(df, ttl=10).orderBy("id").collect()] == ["NEW", "NEW", "STORED", "CONFLICT", "REPLAY", "STORED", "REPLAY_FAILURE"]


def test_sessions(spark):
    at = "TIMESTAMP_NTZ '2024-03-01'"
    loans = spark.sql(f"SELECT * FROM VALUES (8L, 72L, 'ACTIVE', {at} - INTERVAL 1 DAY, {at} + INTERVAL 40 MINUTES), (8L, 72L, 'ACTIVE', {at} - INTERVAL 9 DAYS, {at} + INTERVAL 5 MINUTES), (8L, 73L, 'REVOKED', {at} - INTERVAL 1 DAY, {at} + INTERVAL 9 DAYS) AS l(member_id, ebook_id, status, borrowed_at, expired_at)")
    beats = [(0, "OPEN"), (6, "REFRESH"), (10.5, "REFRESH"), (11, "REFRESH"), (11.01, "REFRESH"), (20, "REFRESH"), (25, "REFRESH"), (30, "READ"), (38, "REFRESH"), (39, "READ"), (40, "REFRESH"), (41, "CLOSE")]
    rows = [(k, 1, 8, 72, a, t) for k, (t, a) in enumerate(beats)]
    rows += [(20, 2, 8, 73, "OPEN", 0.0), (21, 2, 8, 72, "OPEN", 1.0), (22, 2, 9, 72, "READ", 2.0), (23, 2, 9, None, "REVOKE", 3.0), (24, 2, 8, 72, "CLOSE", 4.0), (25, 2, 8, 72, "OPEN", 5.0), (30, 3, 8, 72, "REFRESH", 1.0), (31, None, 8, 72, "OPEN", 1.0), (32, 3, 8, 72, "PLAY", 1.0), (33, 3, 8, 72, "OPEN", None)]
    rows += [(40, 4, 8, 72, "OPEN", 0.0), (41, 4, 8, 72, "REFRESH", 15.0), (42, 4, 8, 72, "CLOSE", 16.0), (50, 5, 8, 72, "OPEN", 0.0), (51, 5, 8, 72, "CLOSE", 1.0), (52, 5, 8, 72, "READ", 2.0)]
    df = spark.createDataFrame([(*r[:5], None if r[5] is None else float(r[5])) for r in rows], "id long, session_id long, member_id long, ebook_id long, action string, m double")
    df = df.withColumn("at", F.expr(f"{at} + make_dt_interval(0, 0, 0, m * 60)"))
    out = {r.id: r for r in reading_sessions(df, loans).collect()}
    assert [out[k].code for k in range(12)] == ["ACTIVE"] * 10 + ["READING_SESSION_NOT_ACTIVE", "EXPIRED"]
    # Written: 0, 6, then the first one over five minutes after 6 (11 is five minutes sharp), 20, and 38; 25 is five minutes after 20.
    assert [k for k in range(12) if out[k].wrote] == [0, 1, 4, 5, 8]
    minutes = lambda x: None if x is None else (x.hour * 60 + x.minute)
    assert [minutes(out[k].session_expires_at) for k in (0, 1, 7, 8)] == [15, 21, 40, 40] and [minutes(out[k].url_expires_at) for k in (0, 7, 9)] == [None, 35, 40]
    want = {20: "EBOOK_LOAN_REQUIRED", 21: "ACTIVE", 22: "READING_SESSION_FORBIDDEN", 23: "REVOKED", 24: "REVOKED", 25: "READING_SESSION_NOT_ACTIVE", 30: "READING_SESSION_NOT_FOUND", 31: "BAD_REQUEST", 32: "BAD_REQUEST", 33: "BAD_REQUEST"}
    want |= {40: "ACTIVE", 41: "READING_SESSION_NOT_ACTIVE", 42: "EXPIRED", 51: "CLOSED", 52: "READING_SESSION_NOT_ACTIVE"}
    assert {k: out[k].code for k in want} == want and reading_sessions(df.limit(0), loans).count() == 0


def test_events_of_a_stream_are_stored_once(spark, tmp_path):
    """A stream that dies after a batch is written, but before that is noted, writes the batch again when it is restarted."""
    rows = spark.sql("SELECT id, concat('p', id) AS payment_code, 'IPN' AS event_type, map('vnp_a', string(id)) AS params, CAST(NULL AS MAP<STRING, STRING>) AS headers FROM range(10)")
    source, checkpoint = str(tmp_path / "in"), tmp_path / "checkpoint"
    rows.where("id < 6").coalesce(1).write.parquet(source)
    events = lambda: spark.readStream.schema(rows.schema).parquet(source)
    sink = runs.EventSink(str(tmp_path / "events"), "ipn")
    assert sink.start(events(), str(checkpoint)).awaitTermination(60)
    (checkpoint / "commits" / "0").unlink()
    for crc in (checkpoint / "commits").glob(".0.crc"):
        crc.unlink()
    rows.where("id >= 6").coalesce(1).write.mode("append").parquet(source)
    assert sink.start(events(), str(checkpoint)).awaitTermination(60)
    stored = sink.stored(spark)
    assert sorted(r.id for r in stored.collect()) == list(range(10)) and stored.select("batch").distinct().count() == 2
    # A batch that was left unfinished isn't read, and is written anew.
    (tmp_path / "events" / "stream=ipn" / "batch=1" / "_SUCCESS").unlink()
    assert sink.stored(spark).count() == 6
    sink(rows.where("id >= 6"), 1)
    assert sorted(r.id for r in sink.stored(spark).collect()) == list(range(10))
