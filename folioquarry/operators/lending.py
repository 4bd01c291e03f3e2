"""Lending life cycle as set operations: copies, holds, checkouts, check-ins, renewals, e-book loans, fines.

Each takes whole tables of requests and state and gives one row a request with the first rule that refuses it, or the new
state. Requests of one batch are judged against the state before it, unless a docstring says how they see each other.
Nulls: a request whose member, book or copy isn't there gets RESOURCE_NOT_FOUND; repeated requests are judged each by
itself; an empty table of requests gives an empty result; columns that aren't named here are not read, and work columns
have names of their own, so clashing names in the inputs don't matter.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions.columns import ACTIVE, ACTIVE_HOLD, OPEN, contains, days_overdue_calendar, is_unpaid_fine, local_day
from folioquarry.operators.circulation import account_reason, ebook_counts, filled, loan_totals, rates_on, zero
from folioquarry.operators.ordered import allocated

FULL_LIMIT = 5  # of members without one


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {n} DAYS")


def member_state(members: DataFrame, loans: DataFrame, ebook_loans: DataFrame, now: Column, ebook_now: Column) -> DataFrame:
    """_member, _account (the first reason why the account may not act), _unpaid, _limit (reached), _room, _overdue."""
    own = loan_totals(loans, now).select("member_id", "active_count", "marked", "unpaid_total")
    m = members.select(F.col("id").alias("member_id"), account_reason(now).alias("_account"), F.coalesce("max_borrow_limit", F.lit(FULL_LIMIT)).alias("most"))
    for part in (own, ebook_counts(ebook_loans, ebook_now).select("member_id", "ebook_entitled")):
        m = m.join(part, "member_id", "left")
    m = filled(m, "active_count", "ebook_entitled", "unpaid_total", "marked")
    room = F.col("most") - F.col("active_count") - F.col("ebook_entitled")
    return m.select(
        F.col("member_id").alias("_member"), "_account", (F.col("unpaid_total") > 0).alias("_unpaid"), (room <= 0).alias("_limit"), room.alias("_room"),
        (F.col("marked") > 0).alias("_overdue"),
    )


def with_member(requests: DataFrame, state: DataFrame) -> DataFrame:
    return requests.join(state, F.col("member_id") == F.col("_member"), "left")


def found(reason: Column | None = None) -> Column:
    """RESOURCE_NOT_FOUND without a member, else the account's own reason."""
    return F.when(F.col("_member").isNull(), "RESOURCE_NOT_FOUND").when(F.col("_account").isNotNull(), F.col("_account"))


def waiting_books(holds: DataFrame) -> DataFrame:
    return holds.where(F.col("status").isin(*ACTIVE_HOLD)).select(F.col("book_id").alias("_held_book")).distinct()


# Copies


def live(df: DataFrame, flag: str = "deleted") -> DataFrame:
    """Rows that aren't deleted; a null flag counts as not deleted."""
    return df.where(~F.coalesce(flag, F.lit(False)))


def copy_search(
    copies: DataFrame, book_id: int | None = None, status: str | None = None, barcode: str | None = None, condition: str | None = None,
    location: str | None = None,
) -> DataFrame:
    """Live copies, of one book if given, that meet each given condition; texts are looked for anywhere, in any case.
    Columns are null where unknown and then don't meet a text condition."""
    out = live(copies)
    if book_id is not None:
        out = out.where(F.col("book_id") == book_id)
    if status is not None:
        out = out.where(F.col("status") == status)
    for text, name in ((barcode, "barcode"), (condition, "condition"), (location, "location")):
        test = contains(text, name)
        if test is not None:
            out = out.where(test)
    return out


def soft_deleted(copies: DataFrame, books: DataFrame, kept: tuple[str, ...], now: Column, by: int) -> DataFrame:
    """copies after a bulk soft delete of those of `books` (id) whose status isn't in `kept`; others stay as they are."""
    gone = books.select(F.col("id").alias("_book")).distinct()
    hit = F.col("_book").isNotNull() & ~F.coalesce("deleted", F.lit(False)) & ~F.col("status").isin(*kept)
    out = copies.join(gone, F.col("book_id") == F.col("_book"), "left")
    return out.select(
        "id", "book_id", "status", F.when(hit, True).otherwise(F.coalesce("deleted", F.lit(False))).alias("deleted"),
        F.when(hit, now).alias("deleted_at"), F.when(hit, F.lit(by).cast("long")).alias("deleted_by"),
    )


# Checkout


def checkout_blocks(
    requests: DataFrame, copies: DataFrame, books: DataFrame, members: DataFrame, loans: DataFrame, ebook_loans: DataFrame, now: Column,
    ebook_now: Column, borrow_days: int = 14,
) -> DataFrame:
    """requests: id, member_id, copy_id. All reasons in the rules' order, the first, and a due date if there is none."""
    c = copies.select(F.col("id").alias("_copy"), F.col("book_id").alias("_copy_book"), F.col("status").alias("_copy_status"))
    b = books.select(F.col("id").alias("_book"), F.coalesce("deleted", F.lit(False)).alias("_deleted"))
    own = loans.where(F.col("status").isin(*OPEN)).select(F.col("member_id").alias("_has_member"), F.col("book_id").alias("_has_book")).distinct()
    j = with_member(requests.select("id", "member_id", "copy_id"), member_state(members, loans, ebook_loans, now, ebook_now))
    j = j.join(c, F.col("copy_id") == F.col("_copy"), "left").join(b, F.col("_copy_book") == F.col("_book"), "left")
    j = j.join(own, (F.col("member_id") == F.col("_has_member")) & (F.col("_copy_book") == F.col("_has_book")), "left")
    there = F.col("_member").isNotNull()
    reasons = F.array(
        found(),
        F.when(there & F.col("_unpaid"), "UNPAID_FINES"),
        F.when(there & F.col("_limit"), "BORROW_LIMIT_REACHED"),
        F.when(there & F.col("_overdue"), "OVERDUE_LOANS"),
        F.when(there & F.col("_has_book").isNotNull(), "ALREADY_BORROWED_BOOK"),
        F.when(F.col("_copy").isNull(), "COPY_NOT_FOUND").when((F.col("_copy_status") != "AVAILABLE") | F.coalesce("_deleted", F.lit(True)), "COPY_NOT_AVAILABLE"),
    )
    j = j.withColumn("_reasons", F.filter(reasons, lambda x: x.isNotNull()))
    return j.select(
        "id", F.array_join("_reasons", ",").alias("reasons"), F.try_element_at("_reasons", F.lit(1)).alias("first_reason"),
        F.when(F.size("_reasons") == 0, now + days(borrow_days)).alias("due_date"),
    )


def in_turn(asks: DataFrame, at: str, member: Column, item: Column, pair: Column, room: Column, free: Column, able: Column) -> DataFrame:
    """asks with granted, had_member, had_item and had_pair, as allocated() says, taken by the column `at` and id."""
    return allocated(asks.select("*", F.monotonically_increasing_id().alias("row"), F.col(at).alias("at"), member.alias("member"), item.alias("item"), pair.alias("pair"), room.alias("room"), free.alias("free"), able.alias("able")))


def checkouts(
    requests: DataFrame, copies: DataFrame, books: DataFrame, members: DataFrame, loans: DataFrame, ebook_loans: DataFrame, now: Column, ebook_now: Column,
    borrow_days: int = 14, max_renewals: int = 2,
) -> DataFrame:
    """requests: id, member_id, copy_id, asked_at. The first rule that refuses each checkout, else OK with its loan: book_id,
    borrowed_at, due_date, status, renew_count, max_renewals, fine_amount.

    Requests are taken one by one by asked_at and id: each that stands uses up room under its member's limit, its copy, and
    its member's right to that book; refused ones use up nothing."""
    c = copies.select(F.col("id").alias("_copy"), F.col("book_id").alias("_copy_book"), F.col("status").alias("_copy_status"))
    b = books.select(F.col("id").alias("_book"), F.coalesce("deleted", F.lit(False)).alias("_deleted"))
    own = loans.where(F.col("status").isin(*OPEN)).select(F.col("member_id").alias("_has_member"), F.col("book_id").alias("_has_book")).distinct()
    j = with_member(requests.select("id", "member_id", "copy_id", "asked_at"), member_state(members, loans, ebook_loans, now, ebook_now))
    j = j.join(c, F.col("copy_id") == F.col("_copy"), "left").join(b, F.col("_copy_book") == F.col("_book"), "left")
    j = j.join(own, (F.col("member_id") == F.col("_has_member")) & (F.col("_copy_book") == F.col("_has_book")), "left")
    away = F.coalesce(F.col("_copy_status") != "AVAILABLE", F.lit(True)) | F.coalesce("_deleted", F.lit(True))
    # What the rules still need, as flags: these rows move for each limit.
    j = j.select(
        "id", "member_id", "copy_id", "asked_at", "_copy_book", "_room", found().when(F.col("_unpaid"), "UNPAID_FINES").alias("_why"), "_overdue",
        F.col("_has_book").isNotNull().alias("_has"), F.col("_copy").isNull().alias("_lost"), away.alias("_away"),
    )
    able = F.col("_why").isNull() & ~F.col("_overdue") & ~F.col("_has") & ~F.col("_lost") & ~F.col("_away")
    j = in_turn(j, "asked_at", F.col("member_id"), F.col("copy_id"), F.struct("member_id", "_copy_book"), F.col("_room"), F.lit(1), able)
    code = (
        F.when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("had_member") >= F.col("_room"), "BORROW_LIMIT_REACHED").when(F.col("_overdue"), "OVERDUE_LOANS")
        .when(F.col("_has") | (F.col("had_pair") > 0), "ALREADY_BORROWED_BOOK").when(F.col("_lost"), "COPY_NOT_FOUND")
        .when(F.col("_away") | (F.col("had_item") > 0), "COPY_NOT_AVAILABLE").otherwise("OK")
    )
    ok = F.col("code") == "OK"
    new = {
        "borrowed_at": now, "due_date": now + days(borrow_days), "status": F.lit("BORROWED"), "renew_count": zero(),
        "max_renewals": F.lit(max_renewals).cast("long"), "fine_amount": zero(),
    }
    return j.withColumn("code", code).select(
        "id", "member_id", "copy_id", "code", F.when(ok, F.col("_copy_book")).alias("book_id"), *[F.when(ok, v).alias(k) for k, v in new.items()],
    )


# Renewal


def manual_renewals(
    requests: DataFrame, loans: DataFrame, members: DataFrame, ebook_loans: DataFrame, holds: DataFrame, now: Column, ebook_now: Column,
    renewal_days: int = 7, overdue_allowed: bool = False,
) -> DataFrame:
    """requests: id, loan_id, actor_id, staff. The first rule that refuses a renewal, else OK with the new due date."""
    r = requests.select("id", F.col("loan_id").alias("_loan"), "actor_id", F.coalesce("staff", F.lit(False)).alias("staff"))
    rules = [F.col("status") == "BORROWED", F.lit(True) if overdue_allowed else F.col("due_date") >= now, F.col("renew_count") < F.col("max_renewals")]
    can = reduce(and_, [F.coalesce(x, F.lit(True)) for x in rules])  # each may be tested where its column is read
    # A loan is judged before it meets its requests; what only renewable ones need is null in others, and only they meet the holds.
    l = loans.select(F.col("id").alias("_loan"), "member_id", can.alias("_can"), *[F.when(can, F.col(c)).alias(c) for c in ("due_date", "renew_count")])
    why = found().when(F.col("_unpaid"), "UNPAID_FINES")
    l = with_member(l, member_state(members, loans, ebook_loans, now, ebook_now)).select("_loan", "member_id", "_can", "due_date", "renew_count", why.alias("_why"))
    asked = loans.where(can).select(F.col("id").alias("_loan"), F.col("book_id").alias("_held_book"))
    blocked = asked.join(waiting_books(holds), "_held_book", "left_semi").select("_loan", F.lit(True).alias("_blocked")).distinct()
    j = r.join(l.join(blocked, "_loan", "left"), "_loan", "left")
    code = (
        F.when(F.col("_can").isNull(), "RESOURCE_NOT_FOUND")
        .when(F.col("_why").isNotNull(), F.col("_why"))
        .when(~F.col("staff") & ~F.col("actor_id").eqNullSafe(F.col("member_id")), "ACCESS_DENIED")
        .when(~F.col("_can"), "NOT_RENEWABLE")
        .when(F.col("_blocked"), "BLOCKED_BY_HOLD")
        .otherwise("OK")
    )
    ok = F.col("code") == "OK"
    return j.withColumn("code", code).select(
        "id", F.col("_loan").alias("loan_id"), "code", F.when(ok, F.col("due_date") + days(renewal_days)).alias("new_due_date"),
        F.when(ok, F.col("renew_count") + 1).alias("new_renew_count"),
    )


def auto_renewal_attempts(
    loans: DataFrame, members: DataFrame, copies: DataFrame, books: DataFrame, holds: DataFrame, now: Column, first: Column, until: Column,
    renewal_days: int = 7, most: int = 500, overdue_allowed: bool = False, enabled: bool = True,
) -> DataFrame:
    """An attempt row for each of the first `most` (1 to 5000) BORROWED loans due in [first, until), by due date and id.

    The code is the first rule that refuses, else SUCCESS; then the due date moves and the count grows. A job that isn't
    enabled attempts nothing."""
    due = loans.where((F.col("status") == "BORROWED") & (F.col("due_date") >= first) & (F.col("due_date") < until) & F.lit(enabled))
    due = due.select(
        "id", "member_id", "book_id", "copy_id", "status", "due_date", "renew_count", "max_renewals",
    ).orderBy("due_date", "id").limit(max(1, min(most, 5000)))
    m = members.select(F.col("id").alias("_member"), account_reason(now).alias("_account"))
    c = copies.select(F.col("id").alias("_copy"), F.col("status").alias("_copy_status"))
    b = books.select(F.col("id").alias("_book"), F.coalesce("deleted", F.lit(False)).alias("_deleted"))
    j = due.join(m, F.col("member_id") == F.col("_member"), "left").join(c, F.col("copy_id") == F.col("_copy"), "left")
    j = j.join(b, F.col("book_id") == F.col("_book"), "left").join(waiting_books(holds), F.col("book_id") == F.col("_held_book"), "left")
    late = F.lit(False) if overdue_allowed else F.col("due_date") < now
    code = (
        F.when(F.col("_member").isNull(), "SYSTEM_ERROR")
        .when(F.col("_account").isNotNull(), F.col("_account"))
        .when(late, "BORROW_OVERDUE")
        .when(F.col("renew_count") >= F.col("max_renewals"), "MAX_RENEWALS_REACHED")
        .when(F.col("_copy_status").isNull() | (F.col("_copy_status") != "BORROWED"), "BOOK_COPY_NOT_BORROWED")
        .when(F.coalesce("_deleted", F.lit(True)), "BOOK_DELETED")
        .when(F.col("_held_book").isNotNull(), "BLOCKED_BY_HOLD")
        .otherwise("SUCCESS")
    )
    ok = F.col("reason_code") == "SUCCESS"
    return j.withColumn("reason_code", code).select(
        F.col("id").alias("loan_id"), "member_id", F.when(ok, "SUCCESS").otherwise("FAILED").alias("result"), "reason_code", F.col("due_date").alias("old_due_date"),
        F.when(ok, F.col("due_date") + days(renewal_days)).alias("new_due_date"), F.col("renew_count").alias("count_before"), (F.col("renew_count") + ok.cast("int")).alias("count_after"),
    )


# Holds


def place_holds(requests: DataFrame, members: DataFrame, books: DataFrame, holds: DataFrame, now: Column, pickup_days: int = 3) -> DataFrame:
    """requests: id, member_id, book_id, asked_at. A new hold's place in the queue and expiry, or the rule that refuses it.

    Requests are taken by asked_at and id: of a member's requests for a book only the first can stand, and each one that
    stands takes the next place. Nulls in asked_at come last."""
    account = members.select(F.col("id").alias("_member"), account_reason(now).alias("_account"))
    shelf = live(books).select(F.col("id").alias("_book"), F.coalesce("available_copies", zero()).alias("_on_shelf"))
    active = holds.where(F.col("status").isin(*ACTIVE_HOLD))
    own = active.select(F.col("member_id").alias("_has_member"), F.col("book_id").alias("_has_book")).distinct()
    last = active.groupBy(F.col("book_id").alias("_queue_book")).agg(F.coalesce(F.max("queue_position"), F.lit(0)).alias("_last"))
    j = requests.select("id", "member_id", "book_id", "asked_at").join(account, F.col("member_id") == F.col("_member"), "left").join(shelf, F.col("book_id") == F.col("_book"), "left")
    j = j.join(
        own, (F.col("member_id") == F.col("_has_member")) & (F.col("book_id") == F.col("_has_book")), "left",
    ).join(last, F.col("book_id") == F.col("_queue_book"), "left")
    before = (
        found().when(F.col("_book").isNull(), "RESOURCE_NOT_FOUND").when(F.col("_on_shelf") > 0, "BOOK_AVAILABLE_ON_SHELF").when(F.col("_has_book").isNotNull(), "HOLD_ALREADY_EXISTS")
    )
    order = [F.asc_nulls_last("asked_at"), F.col("id")]
    j = j.withColumn("_code", before)
    j = j.withColumn("_turn", F.row_number().over(Window.partitionBy("member_id", "book_id", F.col("_code").isNull()).orderBy(*order)))
    j = j.withColumn("code", F.coalesce("_code", F.when(F.col("_turn") > 1, "HOLD_ALREADY_EXISTS").otherwise("WAITING")))
    stands = F.col("code") == "WAITING"
    place = F.sum(stands.cast("int")).over(Window.partitionBy("book_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return j.select(
        "id", "member_id", "book_id", "code", F.when(stands, F.coalesce("_last", F.lit(0)) + place).alias("queue_position"),
        F.when(stands, now + days(pickup_days)).alias("expires_at"),
    )


def checkout_holds(
    holds: DataFrame, copies: DataFrame, members: DataFrame, loans: DataFrame, ebook_loans: DataFrame, now: Column, ebook_now: Column, borrow_days: int = 14
) -> DataFrame:
    """Every active hold as a pickup: the loan's due date and the copy's and hold's new states, or what refuses it.

    Holds are taken one by one by reservation and id: each pickup that stands uses up room under its member's limit and its
    copy; one that is refused uses up nothing."""
    c = copies.select(F.col("id").alias("_copy"), F.col("status").alias("_copy_status"))
    h = holds.where(F.col("status").isin(*ACTIVE_HOLD)).select("id", "member_id", "book_id", "reserved_at", "status", "assigned_copy_id")
    j = with_member(h, member_state(members, loans, ebook_loans, now, ebook_now)).join(c, F.col("assigned_copy_id") == F.col("_copy"), "left")
    waits = F.col("status") != "READY_FOR_PICKUP"
    away = F.col("_copy_status").isNull() | (F.col("_copy_status") != "ON_HOLD_SHELF")
    able = ~waits & ~away & found().isNull() & ~F.col("_unpaid") & ~F.col("_overdue")
    j = in_turn(j, "reserved_at", F.col("member_id"), F.col("assigned_copy_id"), F.monotonically_increasing_id(), F.col("_room"), F.lit(1), able)
    code = (
        F.when(waits, "HOLD_NOT_READY_FOR_PICKUP").when(away | (F.col("had_item") > 0), "HOLD_ASSIGNED_COPY_INVALID").when(found().isNotNull(), found())
        .when(F.col("_unpaid"), "UNPAID_FINES").when(F.col("had_member") >= F.col("_room"), "BORROW_LIMIT_REACHED").when(F.col("_overdue"), "OVERDUE_LOANS").otherwise("FULFILLED")
    )
    ok = F.col("code") == "FULFILLED"
    j = j.withColumn("code", code)
    return j.select("id", "member_id", "assigned_copy_id", "code", F.when(ok, now + days(borrow_days)).alias("due_date"), F.when(ok, "BORROWED").alias("copy_status"))


def cancel_holds(requests: DataFrame, holds: DataFrame, copies: DataFrame, now: Column, pickup_days: int = 3) -> DataFrame:
    """requests: id, hold_id, actor_id, staff; one for each hold at most. The outcome and, where a copy lay on the hold
    shelf, the next waiting hold that gets it (by rank within the book, as copies are freed in order of hold ids)."""
    h = holds.select(F.col("id").alias("_hold"), F.col("member_id").alias("_owner"), "book_id", F.col("status").alias("_status"), "assigned_copy_id")
    j = requests.select("id", F.col("hold_id").alias("_hold"), "actor_id", F.coalesce("staff", F.lit(False)).alias("staff")).join(h, "_hold", "left")
    code = (
        F.when(F.col("_owner").isNull(), "RESOURCE_NOT_FOUND").when(~F.col("staff") & ~F.col("actor_id").eqNullSafe(F.col("_owner")), "ACCESS_DENIED")
        .when(~F.col("_status").isin(*ACTIVE_HOLD), "HOLD_NOT_ACTIVE").otherwise("CANCELLED")
    )
    j = j.withColumn("code", code).join(
        copies.select(F.col("id").alias("_copy"), F.col("status").alias("_copy_status")), F.col("assigned_copy_id") == F.col("_copy"), "left",
    )
    free = (F.col("code") == "CANCELLED") & (F.col("_copy_status") == "ON_HOLD_SHELF")
    j = j.withColumn("_free", F.coalesce(free, F.lit(False)))
    j = j.withColumn("_n", F.when(F.col("_free"), F.row_number().over(Window.partitionBy("book_id", "_free").orderBy("_hold"))))
    gone = j.where("code = 'CANCELLED'").select(F.col("_hold").alias("id"))
    j = j.join(queue(holds.join(gone, "id", "left_anti")), (F.col("book_id") == F.col("_queue_book")) & (F.col("_n") == F.col("_place")), "left")
    given = F.col("_next").isNotNull()
    return j.select(
        "id", F.col("_hold").alias("hold_id"), "code", F.when(F.col("_free"), F.col("assigned_copy_id")).alias("freed_copy_id"),
        F.col("_next").alias("next_hold_id"), F.when(given, "ON_HOLD_SHELF").when(F.col("_free"), "AVAILABLE").alias("copy_status"),
        F.when(given, now + days(pickup_days)).alias("next_expires_at"), F.when(F.col("_free"), F.col("book_id")).alias("book_id"),
        (F.col("_free") & ~given).cast("long").alias("counter_delta"),
    )


def queue(holds: DataFrame) -> DataFrame:
    """Waiting holds with their place in their book's queue: _queue_book, _next, _place."""
    order = Window.partitionBy("book_id").orderBy(F.asc_nulls_last("queue_position"), "reserved_at", "id")
    return holds.where("status = 'WAITING'").select(F.col("book_id").alias("_queue_book"), F.col("id").alias("_next"), F.row_number().over(order).alias("_place"))


def check_in(returns: DataFrame, copies: DataFrame, loans: DataFrame, holds: DataFrame, configs: DataFrame, pickup_days: int = 3) -> DataFrame:
    """returns: id, barcode, returned_at, condition. Closes the newest open loan of each copy; one return a copy at most.

    Late days are calendar days; their fine is by the rate in force on the local day. A DAMAGED copy leaves the shelf, any
    other goes to the next waiting hold of its book (copies by return time and id, holds by queue) or back on the shelf."""
    c = copies.select(F.lower(F.trim("barcode")).alias("_bar"), F.col("id").alias("_copy"), F.col("book_id").alias("_copy_book"))
    last = F.max(F.struct("borrowed_at", "id", "due_date", "fine_amount")).alias("_loan")
    newest = loans.where(F.col("status").isin(*OPEN)).groupBy(F.col("copy_id").alias("_loan_copy")).agg(last)
    damaged = F.coalesce(F.upper(F.trim("condition")) == "DAMAGED", F.lit(False))
    r = returns.select("id", F.lower(F.trim("barcode")).alias("_bar"), "returned_at", damaged.alias("_damaged"))
    day = local_day("returned_at")
    j = r.join(c, "_bar", "left").join(newest, F.col("_copy") == F.col("_loan_copy"), "left").withColumn("_day", day)
    j = j.join(rates_on(r.select(day.alias("on_day")), configs).select(F.col("on_day").alias("_day"), F.col("rate").alias("_rate")), "_day", "left")
    back = F.col("_loan").isNotNull()
    late = F.when(back, days_overdue_calendar(F.col("returned_at"), F.col("_loan.due_date")))
    own = F.col("_loan.fine_amount")
    # What a row still needs, as numbers: it moves to its book's other rows.
    j = j.select(
        "id", "returned_at", "_damaged", "_copy", "_copy_book", back.alias("_back"), F.col("_loan.id").alias("loan_id"), late.alias("overdue_days"),
        F.when(late > 0, F.coalesce(late * F.col("_rate"), own)).otherwise(own).alias("_fine"),
    )
    j = with_next(j, F.col("_back") & ~F.col("_damaged"), "_copy_book", ["returned_at", "id"], queue(holds))
    back, given = F.col("_back"), F.col("_next").isNotNull()
    code = F.when(F.col("_copy").isNull(), "RESOURCE_NOT_FOUND").when(~back, "ACTIVE_BORROW_NOT_FOUND").otherwise("RETURNED")
    status = F.when(~back, F.lit(None).cast("string")).when(F.col("_damaged"), "DAMAGED").when(given, "ON_HOLD_SHELF").otherwise("AVAILABLE")
    return j.select(
        "id", code.alias("code"), "loan_id", "overdue_days", F.when(back, F.col("_fine")).alias("fine"), status.alias("copy_status"), F.col("_next").alias("next_hold_id"),
        F.when(given, F.col("returned_at") + days(pickup_days)).alias("next_expires_at"), F.when(back, F.col("_copy")).alias("copy_id"),
        F.when(back, F.col("_copy_book")).alias("book_id"), (F.coalesce(status, F.lit("")) == "AVAILABLE").cast("long").alias("counter_delta"),
    )


def with_next(rows: DataFrame, frees: Column, book: str, order: list[str], waiting: DataFrame) -> DataFrame:
    """rows with _next: of those that free a copy (never null), the n-th of a book in `order` meets the n-th of `waiting`, as queue()
    gives it. Both are dealt out by book once; rows without a book, which meet nothing, are spread."""
    known = F.col(book).isNotNull()
    kind = F.when(frees & known, F.lit(1)).otherwise(F.lit(2))
    spread = F.when(~known, F.pmod(F.xxhash64(*order), F.lit(4096)).cast("int"))
    a = rows.withColumns({"_slot": F.col(book), "_spread": spread, "_kind": kind})
    b = waiting.select(F.col("_queue_book").alias("_slot"), F.lit(None).cast("int").alias("_spread"), F.lit(0).alias("_kind"), "_next", "_place")
    both = a.unionByName(b, allowMissingColumns=True).repartition("_slot", "_spread")
    turn = F.row_number().over(Window.partitionBy("_slot", "_spread", "_kind").orderBy(*order))
    both = both.withColumn("_place", F.when(F.col("_kind") == 1, turn).when(F.col("_kind") == 0, F.col("_place")))
    met = F.max("_next").over(Window.partitionBy("_slot", "_spread", "_place"))
    return both.withColumn("_next", F.when(F.col("_kind") == 1, met)).where("_kind > 0").select(*rows.columns, "_next")


def expired_hold_moves(holds: DataFrame, copies: DataFrame, now: Column, pickup_days: int = 3, most: int = 500) -> DataFrame:
    """The first `most` holds past their pickup, oldest expiry first, and what becomes of their copies.

    Only a copy on the hold shelf moves: to the next waiting hold of its book by rank, else back on the shelf, where the
    book's counter grows by one. Holds without an expiry never expire."""
    old = holds.where(F.col("status").isin("NOTIFIED", "READY_FOR_PICKUP") & (F.col("expires_at") < now)).orderBy("expires_at", "id").limit(most)
    c = copies.where("status = 'ON_HOLD_SHELF'").select(F.col("id").alias("_copy"))
    j = old.select("id", "book_id", "expires_at", "assigned_copy_id").join(c, F.col("assigned_copy_id") == F.col("_copy"), "left")
    j = j.withColumn("_n", F.when(F.col("_copy").isNotNull(), F.row_number().over(Window.partitionBy("book_id", F.col("_copy").isNull()).orderBy("expires_at", "id"))))
    j = j.join(queue(holds), (F.col("book_id") == F.col("_queue_book")) & (F.col("_n") == F.col("_place")), "left")
    freed = F.col("_copy").isNotNull() & F.col("_next").isNull()
    return j.select(
        F.col("id").alias("expired_id"), "book_id", F.col("_copy").alias("copy_id"), F.col("_next").alias("next_id"),
        F.when(freed, "AVAILABLE").when(F.col("_next").isNotNull(), "ON_HOLD_SHELF").alias("copy_status"),
        F.when(F.col("_next").isNotNull(), now + days(pickup_days)).alias("next_expires_at"), freed.cast("long").alias("counter_delta"),
    )


def reminders(loans: DataFrame, books: DataFrame, queued: DataFrame, first: Column, until: Column, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(notifications, queue rows) for BORROWED loans due in [first, until), the first `most` by due date and id, that
    have no queue row of the same type, target and channel. queued: notification_type, target_type, target_id, channel."""
    due = loans.where((F.col("status") == "BORROWED") & (F.col("due_date") >= first) & (F.col("due_date") < until)).select("id", "member_id", "book_id", "due_date").orderBy("due_date", "id").limit(most)
    had = queued.where("notification_type = 'DUE_SOON_REMINDER' AND target_type = 'BORROW_RECORD' AND channel = 'EMAIL'").select(F.col("target_id").alias("id"))
    new = due.join(had, "id", "left_anti").join(books.select(F.col("id").alias("book_id"), F.col("title").alias("_title")), "book_id", "left")
    notes = new.select(
        F.col("id").alias("target_id"), "member_id", F.lit("DUE_SOON_REMINDER").alias("type"),
        F.concat(F.lit('"'), F.coalesce("_title", F.lit("N/A")), F.lit('" is due soon.')).alias("content"),
    )
    rows = new.select(
        F.lit("DUE_SOON_REMINDER").alias("notification_type"), F.lit("BORROW_RECORD").alias("target_type"), F.col("id").alias("target_id"),
        F.lit("EMAIL").alias("channel"), F.lit("PENDING").alias("status"), "member_id",
    )
    return notes, rows


def purge(images: DataFrame, now: Column, most: int = 25) -> DataFrame:
    """images after one purge: the `most` (1 at least) oldest DELETE_PENDING ones, by age (oldest first) and id, are PURGED."""
    first = images.where("status = 'DELETE_PENDING'").orderBy(F.desc("age"), "id").limit(max(most, 1)).select(F.col("id").alias("_purged"))
    out = images.join(F.broadcast(first), F.col("id") == F.col("_purged"), "left")  # `most` ids
    hit = F.col("_purged").isNotNull()
    return out.select("id", F.when(hit, "PURGED").otherwise(F.col("status")).alias("status"), F.when(hit, now).alias("deleted_at"))


# E-books


def entitled(ebook_loans: DataFrame, ebook_now: Column) -> DataFrame:
    return ebook_loans.where((F.col("status") == "ACTIVE") & (F.col("expired_at") > ebook_now))


def ebook_grants(requests: DataFrame, ebooks: DataFrame, members: DataFrame, loans: DataFrame, ebook_loans: DataFrame, now: Column, ebook_now: Column) -> DataFrame:
    """requests: id, member_id, book_id, asked_at, for free e-books. The newest active e-book of the book is taken.

    EBOOK_NOT_FOUND, EBOOK_REQUIRES_PAYMENT, RESOURCE_NOT_FOUND (no member), UNPAID_FINES, BORROW_LIMIT_REACHED, EXISTING (an
    entitled loan, or one granted in this batch, is given back), LICENSE_UNAVAILABLE or GRANTED with its end. Requests are
    taken one by one by asked_at and id: a grant uses up room under its member's limit and a licence, other outcomes nothing."""
    what = F.struct(F.col("id").alias("id"), "access_type", "max_concurrent_loans", "loan_days")
    newest = ebooks.where("status = 'ACTIVE'").groupBy(F.col("book_id").alias("_ebook_book")).agg(F.max_by(what, "id").alias("_e"))
    has = entitled(ebook_loans, ebook_now)
    own = has.groupBy(F.col("member_id").alias("_own_member"), F.col("ebook_id").alias("_own_ebook")).agg(F.max("expired_at").alias("_own_until"))
    used = has.groupBy(F.col("ebook_id").alias("_used_ebook")).agg(F.count("*").alias("_used"))
    j = with_member(requests.select("id", "member_id", "book_id", "asked_at"), member_state(members, loans, ebook_loans, now, ebook_now))
    j = j.join(newest, F.col("book_id") == F.col("_ebook_book"), "left").withColumn("_ebook", F.col("_e.id"))
    j = j.join(
        own, (F.col("member_id") == F.col("_own_member")) & (F.col("_ebook") == F.col("_own_ebook")), "left",
    ).join(used, F.col("_ebook") == F.col("_used_ebook"), "left")
    before = (
        F.when(F.col("_ebook").isNull(), "EBOOK_NOT_FOUND").when(F.col("_e.access_type") != "FREE", "EBOOK_REQUIRES_PAYMENT")
        .when(F.col("_member").isNull(), "RESOURCE_NOT_FOUND").when(F.col("_unpaid"), "UNPAID_FINES")
    )
    free = F.col("_e.max_concurrent_loans") - F.coalesce("_used", zero())
    j = j.withColumn("_code", before)
    j = in_turn(
        j, "asked_at", F.col("member_id"), F.col("_ebook"), F.struct("member_id", "_ebook"), F.col("_room"), free,
        F.col("_code").isNull() & F.col("_own_until").isNull(),
    )
    mine = F.col("_own_until").isNotNull() | (F.col("had_pair") > 0)
    after = F.when(F.col("had_member") >= F.col("room"), "BORROW_LIMIT_REACHED").when(mine, "EXISTING").when(F.col("had_item") >= F.col("free"), "LICENSE_UNAVAILABLE").otherwise("GRANTED")
    end = ebook_now + F.make_dt_interval(F.col("_e.loan_days").cast("int"))
    j = j.withColumn("code", F.coalesce("_code", after))
    until = F.when(F.col("code") == "GRANTED", end).when(F.col("code") == "EXISTING", F.coalesce("_own_until", end))
    return j.select("id", "member_id", F.col("_ebook").alias("ebook_id"), "code", until.alias("expired_at"))


def payable_fines(requests: DataFrame, loans: DataFrame) -> DataFrame:
    """requests: id, member_id, loan_id. What refuses a fine's payment, else PAYABLE with the amount rounded half up."""
    l = loans.select(F.col("id").alias("_loan"), F.col("member_id").alias("_owner"), "fine_amount", "fine_paid_at", "fine_waived_by")
    j = requests.select("id", "member_id", "loan_id").join(l, F.col("loan_id") == F.col("_loan"), "left")
    code = (
        F.when(F.col("_loan").isNull(), "RESOURCE_NOT_FOUND").when(~F.col("member_id").eqNullSafe(F.col("_owner")), "ACCESS_DENIED").when(F.coalesce("fine_amount", F.lit(0)) <= 0, "FINE_NOT_FOUND")
        .when(F.col("fine_paid_at").isNotNull(), "PAYMENT_ALREADY_SUCCESS").when(F.col("fine_waived_by").isNotNull(), "FINE_WAIVED").otherwise("PAYABLE")
    )
    return j.select("id", "loan_id", code.alias("code"), F.when(code == "PAYABLE", F.round("fine_amount", 0).cast("long")).alias("amount"))


def whole_units(c: Column) -> Column:
    """An amount rounded half up to whole units; null is 0."""
    return F.coalesce(F.round(c.cast("decimal(20,4)"), 0).cast("long"), zero())


def policy_faults(ebooks: DataFrame) -> DataFrame:
    """E-books whose fee doesn't go with their access: FREE costs nothing, PAID something; null or other access is a fault."""
    fee = F.coalesce("fee", F.lit(0))
    good = ((F.col("access_type") == "FREE") & (fee == 0)) | ((F.col("access_type") == "PAID") & (fee > 0))
    return ebooks.where(~F.coalesce(good, F.lit(False))).select("id", "access_type", "fee")
