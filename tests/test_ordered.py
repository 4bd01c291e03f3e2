import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from folioquarry.functions import columns as c  # noqa: E402
from folioquarry.operators import catalog, lending, transitions  # noqa: E402
from folioquarry.operators.ordered import allocated, earlier_sums, in_ranges, nearest, segments  # noqa: E402
from folioquarry.sources.snapshots import Snapshots  # noqa: E402

TS = "TIMESTAMP_NTZ"


def test_running_sums_and_nearest_rows_over_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(k, "hot" if rng.random() < 0.6 else rng.choice([None, "a", "b"]), rng.choice([None, *range(50)]), rng.randrange(5)) for k in range(900)]
    df = spark.createDataFrame(rows, "row long, key string, t long, v long")
    order = lambda r: (r[2] is None, r[2] or 0, r[0])
    got = {r.row: r.s for r in earlier_sums(in_ranges(df, "t", "row"), ["key"], ["t", "row"], {"s": F.col("v")}).collect()}
    assert got == {r[0]: sum(x[3] for x in rows if x[1] == r[1] and order(x) < order(r)) for r in rows}
    points = spark.createDataFrame([(k, key, t, k % 7, k) for k, (_, key, t, _) in enumerate(rows[:200]) if t is not None], "n long, key string, t long, tie long, v long")
    own = [tuple(p) for p in points.collect()]
    for forward in (False, True):
        for inclusive in (False, True):
            want = {}
            for row, key, t, _ in rows:
                there = [p for p in own if p[1] == key and t is not None and ((p[2] > t if forward else p[2] < t) or inclusive and p[2] == t)]
                if there:
                    want[row] = (min if forward else max)((p[2], p[3]) for p in there)
            found = {r.row: own_at(own, r.v) for r in nearest(df, points, ["key"], "v", forward, inclusive).collect()}
            assert found == want, (forward, inclusive)
    assert nearest(df, points.limit(0), ["key"], "v").count() == 0


def own_at(own, v):
    (p,) = [p for p in own if p[4] == v]
    return p[2], p[3]


def test_segments_of_nested_spans(spark):
    rng = random.Random(2)
    rows = [(key, k, since, None if rng.random() < 0.3 else since + rng.randrange(12), rng.randrange(100)) for k in range(60) for key in [rng.choice("ab")] for since in [rng.randrange(40)]]
    out = segments(spark.createDataFrame(rows, "key string, id long, since long, until long, value long"), ["key"]).collect()
    for key in "ab":
        steps = sorted((r.t, r.value) for r in out if r.key == key)
        assert len({t for t, _ in steps}) == len(steps)
        for t in range(60):
            here = [v for s, v in steps if s <= t]
            live = [(since, i, v) for k, i, since, until, v in rows if k == key and since <= t and (until is None or until > t)]
            assert (here[-1] if here else None) == (max(live)[2] if live else None), (key, t)


def replay(asks):
    had = {"m": {}, "i": {}, "p": {}}
    out = {}
    for row, at, id_, m, i, p, room, free, able in sorted(asks, key=lambda a: (a[1] is None, a[1] or 0, a[2], a[0])):
        counts = had["m"].get(m, 0), had["i"].get(i, 0), had["p"].get(p, 0)
        ok = bool(able) and counts[0] < room and counts[1] < free and not counts[2]
        out[row] = (ok, *counts)
        if ok:
            for what, key in zip("mip", (m, i, p), strict=True):
                had[what][key] = had[what].get(key, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_allocation_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    rooms, licences = {m: rng.randrange(4) for m in range(12)}, {i: rng.randrange(5) for i in range(6)}
    asks = []
    for k in range(200):
        m, i = rng.randrange(12), 0 if rng.random() < 0.4 else rng.randrange(6)
        asks.append((k, rng.choice([None, *range(30)]), rng.randrange(1000), m, i, f"{m}:{i}", rooms[m], licences[i], rng.choice([True, True, True, False, None])))
    df = spark.createDataFrame(asks, "row long, at long, id long, member long, item long, pair string, room long, free long, able boolean").withColumn("clash", F.lit(1))
    got = {r.row: (r.granted, r.had_member, r.had_item, r.had_pair) for r in allocated(df.repartition(5)).collect()}
    assert got == replay(asks)
    assert allocated(df.limit(0)).count() == 0


def test_repeats_use_up_nothing(spark):
    """Room for two, asks A, A, B: the repeat finds the first one's loan, and B is granted. With room for one, the limit is first."""
    members = spark.sql(f"SELECT id, 'm' AS full_name, 'MEMBER' AS role, 'ACTIVE' AS status, id AS max_borrow_limit, CAST(NULL AS {TS}) AS membership_expires_at FROM VALUES (1L), (2L) AS m(id)")
    files = spark.sql("SELECT id, id + 100 AS book_id, 'ACTIVE' AS status, 'FREE' AS access_type, 0 AS fee, 9L AS max_concurrent_loans, 14L AS loan_days FROM VALUES (70L), (71L) AS e(id)")
    none = f"CAST(NULL AS {TS}) AS"
    loans = spark.sql(f"SELECT 1L AS id, 1L AS member_id, 1L AS book_id, 1L AS copy_id, 'X' AS status, {none} borrowed_at, {none} due_date, {none} returned_at, 0L AS renew_count, 2L AS max_renewals, 0L AS fine_amount, {none} fine_paid_at, 1L AS fine_waived_by LIMIT 0")
    ebooks = spark.sql(f"SELECT 1L AS id, 1L AS member_id, 1L AS ebook_id, 'X' AS status, {none} borrowed_at, {none} expired_at, 1L AS payment_id LIMIT 0")
    now = c.at("2024-03-01")
    ask = spark.createDataFrame([(k, m, b) for m in (1, 2) for k, b in ((10 * m + 1, 170), (10 * m + 2, 170), (10 * m + 3, 171))], "id long, member_id long, book_id long").withColumn("asked_at", now)
    got = {r.id: r for r in lending.ebook_grants(ask, files, members, loans, ebooks, now, now).collect()}
    assert {k: r.code for k, r in got.items()} == {11: "GRANTED", 12: "BORROW_LIMIT_REACHED", 13: "BORROW_LIMIT_REACHED", 21: "GRANTED", 22: "EXISTING", 23: "GRANTED"}
    assert got[22].expired_at == got[21].expired_at
    pay = ask.selectExpr("id", "member_id", "book_id - 100 AS target_id", "'SUCCESS' AS status", "'BOOK_EBOOK' AS target_type", "asked_at AS paid_at")
    got = {r.id: r.outcome for r in catalog.fulfilment(pay, files, members, loans, ebooks, now, now).collect()}
    assert got == {11: "FULFILLED", 12: "ALREADY_HAS_ACTIVE_LOAN", 13: "BORROW_LIMIT_EXCEEDED", 21: "FULFILLED", 22: "ALREADY_HAS_ACTIVE_LOAN", 23: "FULFILLED"}


def desk(spark):
    none = f"CAST(NULL AS {TS})"
    return {
        "members": spark.sql(f"SELECT id, 'm' AS full_name, 'MEMBER' AS role, 'ACTIVE' AS status, 2L AS max_borrow_limit, {none} AS membership_expires_at FROM VALUES (1L), (2L), (3L) AS m(id)"),
        "books": spark.sql("SELECT id, 'b' AS title, 2L AS available_copies, false AS deleted FROM VALUES (10L), (11L) AS b(id)"),
        "copies": spark.sql("SELECT id, 10 + (id % 2) AS book_id, concat('C', id) AS barcode, CASE WHEN id = 104 THEN 'BORROWED' ELSE 'AVAILABLE' END AS status, false AS deleted FROM range(100, 105)"),
        "loans": spark.sql(f"SELECT 7L AS id, 3L AS member_id, 10L AS book_id, 104L AS copy_id, {TS} '2024-02-01' AS borrowed_at, {TS} '2024-02-20' AS due_date, {none} AS returned_at, 'BORROWED' AS status, 0L AS renew_count, 2L AS max_renewals, 0L AS fine_amount, {none} AS fine_paid_at, CAST(NULL AS BIGINT) AS fine_waived_by"),
        "holds": spark.sql(f"SELECT 50L AS id, 2L AS member_id, 10L AS book_id, {TS} '2024-02-10' AS reserved_at, {none} AS expires_at, 'WAITING' AS status, 1L AS queue_position, CAST(NULL AS BIGINT) AS assigned_copy_id"),
        "ebooks": spark.sql(f"SELECT 1L AS id, 1L AS member_id, 1L AS ebook_id, 'X' AS status, {none} AS borrowed_at, {none} AS expired_at LIMIT 0"),
        "configs": spark.sql("SELECT 1L AS id, 3L AS rate_per_day, DATE '2020-01-01' AS effective_from, CAST(NULL AS DATE) AS effective_until"),
    }


def test_checkout_and_return_change_all_tables(spark):
    d, now = desk(spark), c.at("2024-03-01")
    ask = spark.createDataFrame([(1, 1, 100), (2, 2, 100), (3, 1, 102), (4, 1, 101), (5, 1, 103), (6, 2, 103)], "id long, member_id long, copy_id long").withColumn("asked_at", now)
    out = lending.checkouts(ask, d["copies"], d["books"], d["members"], d["loans"], d["ebooks"], now, now)
    # Two ask for copy 100; member 1's next asks: the same book again, another one, then one over the limit, which member 2 may take.
    assert {r.id: r.code for r in out.collect()} == {1: "OK", 2: "COPY_NOT_AVAILABLE", 3: "ALREADY_BORROWED_BOOK", 4: "OK", 5: "BORROW_LIMIT_REACHED", 6: "OK"}
    new = transitions.desk_changes(d["loans"], d["copies"], d["holds"], d["books"], out=out)
    assert sorted((r.id, r.member_id, r.copy_id, r.status, str(r.due_date)) for r in new["loans"].where("id > 7").collect()) == [(8, 1, 100, "BORROWED", "2024-03-15 00:00:00"), (9, 1, 101, "BORROWED", "2024-03-15 00:00:00"), (10, 2, 103, "BORROWED", "2024-03-15 00:00:00")]
    assert {r.id: r.status for r in new["copies"].collect()} == {100: "BORROWED", 101: "BORROWED", 102: "AVAILABLE", 103: "BORROWED", 104: "BORROWED"}
    assert {r.id: r.available_copies for r in new["books"].collect()} == {10: 1, 11: 0}
    back = spark.createDataFrame([(1, "c104", None), (2, "C101", None), (3, "C103", "damaged"), (4, "C102", None)], "id long, barcode string, condition string").withColumn("returned_at", c.at("2024-03-02"))
    got = lending.check_in(back, new["copies"], new["loans"], new["holds"], d["configs"])
    end = transitions.desk_changes(new["loans"], new["copies"], new["holds"], new["books"], back=got, returned_at=back)
    assert {r.id: (r.status, r.fine_amount, str(r.returned_at)) for r in end["loans"].collect()} == {7: ("RETURNED", 33, "2024-03-02 00:00:00"), 8: ("BORROWED", 0, "None"), 9: ("RETURNED", 0, "2024-03-02 00:00:00"), 10: ("RETURNED", 0, "2024-03-02 00:00:00")}
    assert {r.id: r.status for r in end["copies"].collect()} == {100: "BORROWED", 101: "AVAILABLE", 102: "AVAILABLE", 103: "DAMAGED", 104: "ON_HOLD_SHELF"}
    assert {r.id: r.available_copies for r in end["books"].collect()} == {10: 1, 11: 1}
    hold = end["holds"].first()
    assert (hold.status, hold.assigned_copy_id, str(hold.expires_at)) == ("READY_FOR_PICKUP", 104, "2024-03-05 00:00:00")


def test_cancelled_holds_free_their_copies(spark):
    d, now = desk(spark), c.at("2024-03-01")
    shelf = d["copies"].withColumn("status", F.when(F.col("id").isin(102, 103), "ON_HOLD_SHELF").otherwise(F.col("status")))
    more = spark.sql(f"SELECT id, 1L AS member_id, book_id, {TS} '2024-02-01' AS reserved_at, {TS} '2024-03-03' AS expires_at, 'READY_FOR_PICKUP' AS status, 1L AS queue_position, copy AS assigned_copy_id FROM VALUES (60L, 10L, 102L), (61L, 11L, 103L) AS h(id, book_id, copy)")
    holds = d["holds"].unionByName(more)
    ask = spark.createDataFrame([(1, 60, 1, False), (2, 61, 1, False), (3, 50, 9, False)], "id long, hold_id long, actor_id long, staff boolean")
    said = lending.cancel_holds(ask, holds, shelf, now)
    end = transitions.desk_changes(d["loans"], shelf, holds, d["books"], cancelled=said)
    assert {r.id: (r.status, r.assigned_copy_id) for r in end["holds"].collect()} == {50: ("READY_FOR_PICKUP", 102), 60: ("CANCELLED", 102), 61: ("CANCELLED", 103)}
    assert {r.id: r.status for r in end["copies"].where("id in (102, 103)").collect()} == {102: "ON_HOLD_SHELF", 103: "AVAILABLE"}
    assert {r.id: r.available_copies for r in end["books"].collect()} == {10: 2, 11: 3}


def test_counters_by_deltas_equal_a_recount(spark):
    rng = random.Random(5)
    copies = {k: (rng.randrange(6), rng.choice(["AVAILABLE", "BORROWED", None]), rng.random() < 0.2) for k in range(60)}
    frame = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows.items()], "id long, book_id long, status string, deleted boolean")
    kept = transitions.book_counts(frame(copies))
    for turn in range(3):
        new = {k: (rng.randrange(8), rng.choice(["AVAILABLE", "LOST"]), rng.random() < 0.4) for k in [*rng.sample(sorted(copies), 20), *range(100 * turn + 100, 100 * turn + 105)]}
        deltas = transitions.book_deltas(frame({k: copies[k] for k in new if k in copies}), frame(new))
        kept = spark.createDataFrame(transitions.counted_on(kept, deltas).collect(), "book_id long, total long, available long")
        copies |= new
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, transitions.book_counts(frame(copies)).collect()))


def test_versions_switch_at_once(spark, tmp_path):
    tables = Snapshots(spark, str(tmp_path / "desk"))
    assert tables.version() is None and tables.folders() == {}
    assert tables.commit({"a": spark.range(3), "b": spark.range(5)}, None) == 0
    assert tables.change(lambda t: {"a": t[0].selectExpr("id + 10 AS id")}, "a") == 1
    a, b = tables.read("a", "b")
    assert sorted(r.id for r in a.collect()) == [10, 11, 12] and b.count() == 5
    assert sorted(r.id for r in tables.read("a", version=0)[0].collect()) == [0, 1, 2]

    def dies(t):
        fails = F.udf(lambda x: 1 // (x - x), "long")
        return {"b": t[0], "a": t[0].select(fails("id").alias("id"))}

    with pytest.raises(Exception, match="ZeroDivisionError"):
        tables.change(dies, "a")
    assert tables.version() == 1 and sorted(r.id for r in tables.read("a")[0].collect()) == [10, 11, 12] and tables.read("b")[0].count() == 5
    with pytest.raises(RuntimeError):  # another writer was first
        tables.commit({"a": spark.range(1)}, 0)
    assert tables.version() == 1

    def slow(t):
        if tables.version() == 1:
            tables.commit({"a": spark.range(100, 101)}, 1)
        return {"a": t[0].union(spark.range(1))}

    assert tables.change(slow, "a") == 3 and sorted(r.id for r in tables.read("a")[0].collect()) == [0, 100]


def test_earlier_sums_move_rows_once(spark):
    """A wide row meets its key's earlier ranges without a join, which would deal it out again; null keys are keys."""
    df = spark.sql("SELECT * FROM VALUES (CAST(NULL AS LONG), 1L, 4L), (NULL, 2L, 5L), (7L, 1L, 1L), (7L, 3L, 2L), (7L, 9L, 3L) AS t(key, t, v)")
    sums = earlier_sums(in_ranges(df.repartition(3), "t"), ["key"], ["t"], {"s": F.col("v")})
    assert {(r.key, r.t): r.s for r in sums.collect()} == {(None, 1): 0, (None, 2): 4, (7, 1): 0, (7, 3): 1, (7, 9): 3}
    assert "Join" not in sums._jdf.queryExecution().optimizedPlan().toString()
