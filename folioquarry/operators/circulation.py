"""Loans, members, holds and fines: searches, per-member aggregates, rule chains and batch transitions."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions.columns import ACTIVE, ACTIVE_HOLD, OPEN, contains, days_overdue_calendar, days_overdue_elapsed, fine_status, is_overdue, is_unpaid_fine, local_day, matches, whole_number
from folioquarry.operators.ordered import nearest, segments

def zero() -> Column:
    return F.lit(0).cast("long")


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def filled(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.coalesce(n, zero()) for n in names})


# Per-member aggregates


def loan_totals(loans: DataFrame, now: Column) -> DataFrame:
    """Of each member that has any loans, in one pass: active, open, overdue and all loans, those marked OVERDUE, and the
    unpaid fines. A null status counts as a loan alone; null amounts are none."""
    status, owed = F.col("status"), F.when(is_unpaid_fine(), F.col("fine_amount"))
    return loans.groupBy("member_id").agg(
        count_if(status.isin(*ACTIVE)).alias("active_count"), count_if(status.isin(*OPEN)).alias("open_count"), count_if(is_overdue(now)).alias("overdue_count"),
        F.count("*").alias("history_count"), count_if(status == "OVERDUE").alias("marked"), F.coalesce(F.sum(owed), zero()).alias("unpaid_total"),
    )


def borrow_counts(loans: DataFrame, now: Column) -> DataFrame:
    """Active, open, overdue and all loans of each member that has any; a null status counts as a loan alone."""
    return loan_totals(loans, now).select("member_id", "active_count", "open_count", "overdue_count", "history_count")


def ebook_counts(ebooks: DataFrame, now: Column) -> DataFrame:
    """Active, overdue, entitled and all e-book loans of each member that has any; a loan without an end is neither late nor entitled."""
    active = F.col("status") == "ACTIVE"
    return ebooks.groupBy("member_id").agg(
        count_if(active).alias("ebook_active"), count_if(active & (F.col("expired_at") < now)).alias("ebook_overdue"),
        count_if(active & (F.col("expired_at") > now)).alias("ebook_entitled"), F.count("*").alias("ebook_history"),
    )


def unpaid_fines(loans: DataFrame) -> DataFrame:
    """The unpaid fines of each member that has any; null amounts are none."""
    return loans.where(is_unpaid_fine()).groupBy("member_id").agg(F.sum("fine_amount").alias("unpaid_total"))


def active_holds(holds: DataFrame) -> DataFrame:
    """The number of active holds of each member that has any."""
    return holds.where(F.col("status").isin(*ACTIVE_HOLD)).groupBy("member_id").agg(F.count("*").alias("active_holds"))


def member_stats(members: DataFrame, loans: DataFrame, ebooks: DataFrame, holds: DataFrame, now: Column, ebook_now: Column) -> DataFrame:
    """Physical and e-book loans, fines and holds of each member; members without any get zeros."""
    out = members.select(F.col("id").alias("member_id"), "full_name")
    for part in (loan_totals(loans, now), ebook_counts(ebooks, ebook_now), active_holds(holds)):
        out = out.join(part, "member_id", "left")
    c = filled(out, *out.columns[2:])
    both = lambda a, b, name: (F.col(a) + F.col(b)).alias(name)
    return c.select(
        "member_id", "full_name", both("active_count", "ebook_active", "active_loans"), both("overdue_count", "ebook_overdue", "overdue_loans"),
        both("history_count", "ebook_history", "history"), "unpaid_total", "active_holds",
    )


# Searches


def loan_search(
    loans: DataFrame, ebooks: DataFrame, members: DataFrame, books: DataFrame, copies: DataFrame, files: DataFrame, payments: DataFrame, now: Column, ebook_now: Column, q: str | None = None, status: str | None = None,
    overdue: bool | None = None, open_only: bool | None = None, due_from: str | None = None, due_to: str | None = None, member_id: int | None = None, fields: tuple[str, ...] | None = None,
) -> DataFrame:
    """Physical and e-book loans in one shape of 24 columns. A flag that is None or False filters nothing. ebooks: book_id is
    the book's id, ebook_id that of its file.

    files (id, original_filename) are the e-books' files. q is looked for in names, e-mails, phones, titles, ISBNs and, by
    kind, barcodes or file names and payment codes; if it is a whole number, also among the ids of loans, members, books,
    and copies or e-books and payments. With fields it is looked for in these alone. Unknown members, books and copies
    drop a loan; unknown files and payments don't. Null texts match nothing."""
    people = members.select(
        F.col("id").alias("member_id"), F.col("full_name").alias("member_name"), F.col("email").alias("member_email"), F.col("phone").alias("_phone"),
    )
    titles = books.select(F.col("id").alias("book_id"), F.col("title").alias("book_title"), F.col("isbn").alias("_isbn"))
    shelf = copies.select(F.col("id").alias("book_copy_id"), F.col("barcode").alias("item_barcode"), F.col("status").alias("copy_status"))
    names = files.select(F.col("id").alias("book_ebook_id"), F.col("original_filename").alias("_file"))
    codes = payments.select(F.col("id").alias("payment_id"), F.col("payment_code").alias("_code"))
    null = lambda kind: F.lit(None).cast(kind)
    late, elate = is_overdue(now), (F.col("status") == "ACTIVE") & (F.col("expired_at") < ebook_now)

    def kept(df: DataFrame, is_live: Column, is_late: Column, due: str) -> DataFrame:
        if member_id is not None:
            df = df.where(F.col("member_id") == member_id)
        if status:
            df = df.where(F.col("status") == status)
        if overdue:
            df = df.where(is_late)
        if open_only:
            df = df.where(is_live)
        if due_from:
            df = df.where(F.col(due) >= F.lit(due_from).cast("timestamp_ntz"))
        if due_to:
            df = df.where(F.col(due) <= F.lit(due_to).cast("timestamp_ntz"))
        return df

    physical = kept(loans, F.col("status").isin(*OPEN), late, "due_date").select(
        F.col("id").alias("borrow_id"), "member_id", "book_id", F.col("copy_id").alias("book_copy_id"), "borrowed_at", "due_date", "returned_at", "status", "renew_count", "max_renewals",
        F.coalesce("fine_amount", zero()).alias("fine_amount"), fine_status().alias("fine_status"), late.alias("overdue"), F.when(late, days_overdue_elapsed(now, F.col("due_date"))).otherwise(zero()).alias("days_overdue"),
        F.lit("PHYSICAL").alias("loan_type"), null("long").alias("ebook_loan_id"), null("long").alias("book_ebook_id"), null("long").alias("payment_id"), null("timestamp_ntz").alias("expired_at"),
    ).join(shelf, "book_copy_id").withColumns({"_file": null("string"), "_code": null("string")})
    digital = kept(ebooks, F.col("status") == "ACTIVE", elate, "expired_at").select(
        null("long").alias("borrow_id"), "member_id", "book_id", null("long").alias("book_copy_id"), null("string").alias("item_barcode"), null("string").alias("copy_status"), "borrowed_at",
        F.col("expired_at").alias("due_date"), null("timestamp_ntz").alias("returned_at"), "status", null("long").alias("renew_count"), null("long").alias("max_renewals"), zero().alias("fine_amount"), F.lit("NONE").alias("fine_status"),
        elate.alias("overdue"), F.when(elate, days_overdue_elapsed(ebook_now, F.col("expired_at"))).otherwise(zero()).alias("days_overdue"), F.lit("EBOOK").alias("loan_type"), F.col("id").alias("ebook_loan_id"), F.col("ebook_id").alias("book_ebook_id"), "payment_id", "expired_at",
    ).join(names, "book_ebook_id", "left").join(codes, "payment_id", "left")
    both = physical.unionByName(digital).join(people, "member_id").join(titles, "book_id")
    where = {"full_name": "member_name", "email": "member_email", "title": "book_title"}
    test = contains(q, *(where[f] for f in fields)) if fields else contains(
        q, "member_name", "member_email", "_phone", "book_title", "_isbn", "item_barcode", "_file", "_code",
    )
    number = whole_number(q) if fields is None else None
    if number is not None:
        test = reduce(
            or_,
            [F.coalesce(F.col(c) == number, F.lit(False)) for c in ("borrow_id", "ebook_loan_id", "member_id", "book_id", "book_copy_id", "book_ebook_id", "payment_id")],
            test,
        )
    out = both if test is None else both.where(test)
    return out.select(
        "borrow_id", "member_id", "member_name", "member_email", "book_id", "book_title", "book_copy_id", "item_barcode", "copy_status", "borrowed_at", "due_date", "returned_at", "status", "renew_count", "max_renewals",
        "fine_amount", "fine_status", "overdue", "days_overdue", "loan_type", "ebook_loan_id", "book_ebook_id", "payment_id", "expired_at",
    )


def members_with_overdue(members: DataFrame, loans: DataFrame, now: Column, q: str | None = None) -> DataFrame:
    """Members, all columns, that have an overdue loan and whose name or e-mail holds q; a blank q filters nothing, null texts
    hold nothing, and repeated members stay."""
    out = members.join(loans.where(is_overdue(now)).select("member_id"), F.col("id") == F.col("member_id"), "left_semi")
    found = contains(q, "full_name", "email")
    return out if found is None else out.where(found)


def fine_list(loans: DataFrame) -> DataFrame:
    """Loans with a fine and its state, waived before paid."""
    return loans.where("fine_amount > 0").select("id", "member_id", "fine_amount", fine_status(waived_first=True).alias("fine_status"))


# Dashboards


def dashboard(loans: DataFrame, ebooks: DataFrame, holds: DataFrame, now: Column, ebook_now: Column, day: str) -> DataFrame:
    """One row of tiles; each source is scanned once."""
    on = F.lit(day).cast("date")
    a = loans.agg(
        count_if(F.col("status").isin(*ACTIVE)).alias("a"), count_if(is_overdue(now)).alias("o"), count_if(is_unpaid_fine()).alias("unpaid_fines"), F.coalesce(F.sum(F.when(is_unpaid_fine(), F.col("fine_amount"))), zero()).alias("unpaid_total"),
        count_if(local_day("borrowed_at") == on).alias("borrowed_today"), count_if((local_day("returned_at") == on) & (F.col("status") == "RETURNED")).alias("returned_today"),
    )
    b = ebooks.agg(count_if(F.col("status") == "ACTIVE").alias("ea"), count_if((F.col("status") == "ACTIVE") & (F.col("expired_at") < ebook_now)).alias("eo"))
    c = holds.agg(count_if(F.col("status") == "READY_FOR_PICKUP").alias("ready_holds"))
    one = a.crossJoin(b).crossJoin(c)  # three rows of aggregates
    return one.select(
        (F.col("a") + F.col("ea")).alias("active_loans"), (F.col("o") + F.col("eo")).alias("overdue_loans"), "ready_holds", "unpaid_fines",
        "unpaid_total", "borrowed_today", "returned_today",
    )


def period_statistics(
    loans: DataFrame, books: DataFrame, first: str, last: str, kind: str | None = None, value: str | None = None, language: str | None = None,
) -> DataFrame:
    """A row for each day of a span of 21 days at most: borrowed, returned, net, and whether it is the first peak of borrowing.

    A longer span, or one that ends before it begins, raises. Loans are read once; loans without a book's row drop out only
    where a filter asks for books."""
    if not 0 <= (date.fromisoformat(last) - date.fromisoformat(first)).days <= 20:
        raise ValueError("a span of 1 to 21 days is asked for")
    days = loans.sparkSession.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day")
    test = matches(kind, value, {"category": "category", "isbn": "isbn", "title": "title"})
    wanted = books if test is None else books.where(test)
    if language:
        wanted = wanted.where(F.lower("language") == language.lower())
    if test is not None or language:
        loans = loans.join(wanted.select(F.col("id").alias("book_id")), "book_id", "left_semi")
    moved = F.array(
        F.struct(local_day("borrowed_at").alias("day"), F.lit(1).alias("b"), F.lit(0).alias("r")),
        F.when(F.col("status") == "RETURNED", F.struct(local_day("returned_at").alias("day"), F.lit(0).alias("b"), F.lit(1).alias("r"))),
    )
    each = loans.select(F.inline(F.filter(moved, lambda x: x.isNotNull()))).where(F.col("day").between(first, last))
    counts = each.groupBy("day").agg(F.sum("b").alias("borrowed"), F.sum("r").alias("returned"))
    out = filled(days.join(counts, "day", "left"), "borrowed", "returned")
    turn = F.row_number().over(Window.orderBy(F.desc("borrowed"), "day"))  # 21 rows at most
    return out.select("day", "borrowed", "returned", (F.col("borrowed") - F.col("returned")).alias("net"), ((turn == 1) & (F.col("borrowed") > 0)).alias("is_peak"))


def period_totals(days: DataFrame) -> DataFrame:
    """Totals of period_statistics(): borrowed, returned, net and the peak day as text, "" where nothing was borrowed."""
    return days.agg(
        F.sum("borrowed").alias("borrowed"), F.sum("returned").alias("returned"), F.sum("net").alias("net"),
        F.coalesce(F.max(F.when(F.col("is_peak"), F.col("day").cast("string"))), F.lit("")).alias("peak_day"),
    )


# Rules


def account_reason(now: Column) -> Column:
    """The first reason why an account may not act, else null."""
    return F.when(F.col("role") != "MEMBER", "NOT_A_MEMBER").when(F.col("status") != "ACTIVE", "ACCOUNT_NOT_ACTIVE").when(F.col("membership_expires_at") < now, "MEMBERSHIP_EXPIRED")


def rates_on(days: DataFrame, configs: DataFrame) -> DataFrame:
    """days: on_day. (on_day, rate) in force on each distinct day that has one: of several the one that began last, ties to the
    larger id. The dated rows are cut into stretches once and merged with the days in order, so that neither meets all rows
    of the other."""
    number = lambda c: F.unix_date(c).cast("long")
    spans = configs.select(
        F.lit(0).alias("_key"), F.col("id").cast("long").alias("id"), number("effective_from").alias("since"), number("effective_until").alias("until"),
        F.col("rate_per_day").cast("long").alias("value"),
    )
    points = segments(spans, ["_key"]).select("_key", "t", F.lit(0).cast("long").alias("tie"), "value")
    probes = days.where("on_day IS NOT NULL").select("on_day").distinct().select(F.lit(0).alias("_key"), number("on_day").alias("t"), number("on_day").alias("row"))
    return nearest(probes, points, ["_key"], "value").select(
        F.date_from_unix_date(F.col("row").cast("int")).alias("on_day"), F.col("value").alias("rate"),
    ).where("rate IS NOT NULL")


def effective_fines(loans: DataFrame, configs: DataFrame) -> DataFrame:
    """Days late times the rate in force on the local day of return, of several the newest; without one the fine stays."""
    late = loans.where("returned_at IS NOT NULL").withColumn("days_late", days_overdue_calendar(F.col("returned_at"), F.col("due_date")))
    late = late.where("days_late > 0").withColumn("on_day", local_day("returned_at"))
    fine = F.coalesce(F.col("days_late") * F.col("rate"), F.col("fine_amount"))
    return late.join(rates_on(late, configs), "on_day", "left").select("id", "days_late", fine.alias("fine"))


# Batch transitions


def mark_overdue(loans: DataFrame, now: Column, most: int = 500) -> DataFrame:
    """The first `most` BORROWED loans past due, by due date and id, with their new state."""
    late = loans.where((F.col("status") == "BORROWED") & (F.col("due_date") < now))
    return late.orderBy("due_date", "id").limit(most).select(
        "id", "copy_id", F.lit("OVERDUE").alias("new_status"), F.lit("OVERDUE").alias("new_copy_status"), "due_date",
    )


def hold_heads(holds: DataFrame) -> DataFrame:
    """Per book: the head of the queue and the next free position."""
    live = holds.where(F.col("status").isin(*ACTIVE_HOLD))
    order = F.struct(F.col("queue_position").isNull(), "queue_position", "reserved_at", "id")
    return live.groupBy("book_id").agg(
        F.min_by(F.when(F.col("status") == "WAITING", F.col("id")), F.when(F.col("status") == "WAITING", order)).alias("head_id"),
        (F.coalesce(F.max("queue_position"), F.lit(0)) + 1).alias("next_position"),
    )


def violations(
    rows: list[tuple[DataFrame, dict[str, Column]]], groups: list[tuple[str, DataFrame, list]], missing: list[tuple[str, DataFrame, str, DataFrame]],
) -> DataFrame:
    """(rule, violations). rows: per table, rules that a row breaks, all counted in one pass; a null condition isn't broken.
    groups: (rule, table, keys) of keys that stand more than once. missing: (rule, table, column, parents with id) of rows
    whose value, unless null, has no parent."""
    parts = []
    for df, rules in rows:
        one = df.agg(*[count_if(c).alias(f"r{k}") for k, c in enumerate(rules.values())])
        parts.append(one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{k}").alias("violations")) for k, r in enumerate(rules)]))))
    for rule, df, keys in groups:
        many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
        parts.append(many.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations"))
    for rule, df, column, parents in missing:
        lost = df.select(F.col(column).alias("_value")).where("_value IS NOT NULL").join(parents.select(F.col("id").alias("_value")), "_value", "left_anti")
        parts.append(lost.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts)
