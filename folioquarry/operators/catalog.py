"""Catalog searches, reviews, payments and receipts, callbacks, upserts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.functions.columns import contains, isbn_digits, signature, whole_number
from folioquarry.operators.circulation import count_if, filled, zero
from folioquarry.operators.lending import entitled, in_turn, live, member_state, with_member
from folioquarry.operators.paging import head_of


def book_search(
    books: DataFrame, reviews: DataFrame, q: str | None = None, title: str | None = None, isbn: str | None = None, category: str | None = None, language: str | None = None, author: str | None = None,
    available_only: bool | None = None, category_id: int | None = None, author_id: int | None = None, author_name: str | None = None, links: DataFrame | None = None, authors: DataFrame | None = None,
) -> DataFrame:
    """Books that aren't deleted and meet each given condition, with rating statistics (0 without reviews).

    links (book_id, author_id) and authors (id, name) are needed for conditions on authors: a book stays once, however
    many of its authors match. Null texts meet no condition on them; an empty table gives an empty result."""
    out = live(books)
    if category_id is not None:
        out = out.where(F.col("category_id") == category_id)
    if author_id is not None or author_name is not None:
        out = books_by_author(out, links, authors, author_id, author_name)
    for test in (contains(q, "title", "isbn"), contains(title, "title"), contains(isbn, "isbn"), contains(author, "author")):
        if test is not None:
            out = out.where(test)
    if category is not None:
        out = out.where(F.col("category") == category)
    if language is not None:
        out = out.where(F.lower("language") == language.lower())
    if available_only:
        out = out.where("available_copies > 0")
    return out.join(review_stats(reviews).withColumnRenamed("book_id", "id"), "id", "left").select(
        "id", "title", "isbn", "language", "author", "available_copies", F.coalesce("average", F.lit(0.0)).alias("average"),
        F.coalesce("n_reviews", zero()).alias("n_reviews"),
    )


def books_by_author(books: DataFrame, links: DataFrame, authors: DataFrame, author_id: int | None = None, author_name: str | None = None) -> DataFrame:
    """books of an author (by id or a part of the name, in any case): a semi-join, so no book comes twice."""
    who = authors if author_id is None else authors.where(F.col("id") == author_id)
    test = contains(author_name, "name")
    who = who if test is None else who.where(test)
    hit = links.join(who.select(F.col("id").alias("author_id")), "author_id", "left_semi").select(F.col("book_id").alias("_author_book"))
    return books.join(hit, F.col("id") == F.col("_author_book"), "left_semi")


def book_details(books: DataFrame, links: DataFrame, authors: DataFrame, categories: DataFrame, copies: DataFrame) -> DataFrame:
    """Live books with their category's name (null without one), authors sorted by name and copies sorted by id, both
    aggregated before the join; a book without any gets an empty list."""
    a = links.join(authors.select(F.col("id").alias("author_id"), "name"), "author_id").groupBy(F.col("book_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", F.col("author_id").alias("id")))).alias("authors"))
    c = live(copies).groupBy(F.col("book_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("id"), "barcode"))).alias("copies"))
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    b = live(books).select("id", "title", "category_id").join(a, "id", "left").join(c, "id", "left").join(names, "category_id", "left")
    return b.select("id", "title", "category_name", F.coalesce("authors", F.expr("array()")).alias("authors"), F.coalesce("copies", F.expr("array()")).alias("copies"))


def ebook_titles(ebooks: DataFrame, books: DataFrame) -> DataFrame:
    """E-books with the title of their book, "N/A" where it isn't there, and a caption cut to 255 characters."""
    t = books.select(F.col("id").alias("book_id"), F.col("title").alias("_title"))
    return ebooks.select("id", "book_id").join(t, "book_id", "left").select(
        "id", F.coalesce("_title", F.lit("N/A")).alias("title"),
        F.substring(F.concat(F.lit("Book cover for "), F.coalesce("_title", F.lit(""))), 1, 255).alias("caption"),
    )


def newest_ebooks(ebooks: DataFrame) -> DataFrame:
    """The ACTIVE e-book with the largest id of each book."""
    return head_of(ebooks.where("status = 'ACTIVE'"), ["book_id"], F.desc("id")).select("book_id", "id", "original_filename")


def isbn_repairs(books: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """updates: book_id, old_isbn, new_isbn. (issues: issue, book_id; books with the new ISBNs).

    Issues: the book isn't there or has another ISBN; the new ISBN is at another book; it is twice in the list; it isn't
    thirteen digits. Comparisons between books ignore case. Books without an update keep their ISBN; of several updates
    the smallest ISBN counts."""
    u = updates.select("book_id", "old_isbn", "new_isbn")
    own = books.select(F.col("id").alias("book_id"), F.col("isbn").alias("_isbn"))
    key = lambda c: F.lower(F.col(c))
    said = lambda issue, df: df.select(F.lit(issue).alias("issue"), F.col("book_id"))
    mismatch = u.join(own, "book_id", "left").where(F.col("_isbn").isNull() | (F.col("_isbn") != F.col("old_isbn")))
    other = books.select(F.col("id").alias("_id"), F.lower("isbn").alias("_key"))
    taken = u.join(other, (key("new_isbn") == F.col("_key")) & (F.col("book_id") != F.col("_id")), "left_semi")
    twice = u.groupBy(key("new_isbn").alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1")
    double = u.join(twice.select("_key"), key("new_isbn") == F.col("_key"), "left_semi")
    malformed = u.where(~F.coalesce(F.col("new_isbn").rlike("^[0-9]{13}$"), F.lit(False)))
    issues = said("MISSING_OR_OLD_ISBN_MISMATCH", mismatch).unionByName(said("NEW_ISBN_ALREADY_EXISTS_ON_OTHER_BOOK", taken)).unionByName(said("DUPLICATE_NEW_ISBN_IN_UPDATE_LIST", double)).unionByName(said("NEW_ISBN_NOT_13_DIGITS", malformed))
    new = updates.groupBy(F.col("book_id").alias("_book")).agg(F.min("new_isbn").alias("_new"))
    fixed = books.join(new, F.col("id") == F.col("_book"), "left").select("id", F.coalesce("_new", "isbn").alias("isbn"))
    return issues, fixed


def review_stats(reviews: DataFrame) -> DataFrame:
    """Mean rating and number of reviews of each book that has any; null ratings count as reviews, not in the mean."""
    return reviews.groupBy("book_id").agg(F.avg("rating").alias("average"), F.count("*").alias("n_reviews"))


def rating_histogram(reviews: DataFrame) -> DataFrame:
    """Counts of ratings 1 to 5, zeros included."""
    all_ = reviews.sparkSession.range(1, 6).withColumnRenamed("id", "rating")
    return filled(all_.join(reviews.groupBy("rating").agg(F.count("*").alias("n")), "rating", "left"), "n")


def rating_histograms(reviews: DataFrame) -> DataFrame:
    """rating_histogram() of each book that has reviews."""
    all_ = reviews.select("book_id").distinct().select("book_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("rating"))
    return filled(all_.join(reviews.groupBy("book_id", "rating").agg(F.count("*").alias("n")), ["book_id", "rating"], "left"), "n")


def category_authors(books: DataFrame) -> DataFrame:
    """Nested authors of each category, sorted by name, with the number of their books."""
    each = books.groupBy("category", "author").agg(F.count("*").alias("n"))
    return each.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("author", "n"))).alias("authors"))


def unreviewed(books: DataFrame, reviews: DataFrame) -> DataFrame:
    """Books without a review, all columns."""
    return books.join(reviews.select(F.col("book_id").alias("id")), "id", "left_anti")


def isbn_clashes(books: DataFrame) -> DataFrame:
    """Books whose ISBN, cleaned and lower-cased, stands at another book: each with the smallest id of its group.

    A group's minimum says it all; books of one ISBN aren't paired with each other."""
    key = books.withColumn("key", F.lower(isbn_digits(F.col("isbn"))))
    group = key.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return key.join(group, "key").select("id", "isbn", "first_id", "n")


def receipts(payments: DataFrame, ebooks: DataFrame, books: DataFrame, loans: DataFrame, members: DataFrame) -> DataFrame:
    """Payments of members with the title of what they are for: the book of an e-book or of a fined loan, else type and id."""
    titles = lambda x: books.select(F.col("id").alias(f"_{x}_book"), F.col("title").alias(f"_{x}_title"))
    e = ebooks.select(F.col("id").alias("_ebook"), F.col("book_id").alias("_e_book")).join(titles("e"), "_e_book", "left")
    l = loans.select(F.col("id").alias("_loan"), F.col("book_id").alias("_l_book")).join(titles("l"), "_l_book", "left")
    m = members.select(F.col("id").alias("member_id"), F.col("full_name").alias("member_name"), F.col("email").alias("member_email"))
    j = payments.join(m, "member_id")
    j = j.join(e, (F.col("target_type") == "BOOK_EBOOK") & (F.col("_ebook") == F.col("target_id")), "left").join(
        l, (F.col("target_type") == "BORROW_RECORD") & (F.col("_loan") == F.col("target_id")), "left",
    )
    title = F.coalesce("_e_title", "_l_title", F.concat("target_type", F.lit(" #"), F.col("target_id").cast("string")))
    names = ["provider", "provider_transaction_id", "provider_response_code", "provider_transaction_status", "purpose", "target_type", "target_id"]
    rest = ["amount", "currency", "status", "paid_at", "expired_at", "created_at", "updated_at"]
    kinds = {"paid_at": "timestamp_ntz", "expired_at": "timestamp_ntz", "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz"}
    col = lambda c: F.col(c) if c in payments.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c)
    return j.select(
        F.col("id").alias("payment_id"), F.col("payment_code").alias("receipt_number"), "payment_code", "member_id", "member_name", "member_email",
        *map(col, names), title.alias("item_title"), *map(col, rest),
    )


def receipt_search(found: DataFrame, q: str | None = None, status: str | None = None, paid_from: str | None = None, paid_to: str | None = None) -> DataFrame:
    """receipts() that meet each given condition. q is looked for in codes, transaction ids, names, e-mails and titles of e-books
    and fined books; if it is a whole number, also among the ids of payments, members and targets. Nulls match nothing."""
    if status:
        found = found.where(F.col("status") == status)
    for text, test in ((paid_from, lambda t: F.col("paid_at") >= t), (paid_to, lambda t: F.col("paid_at") <= t)):
        if text:
            found = found.where(test(F.lit(text).cast("timestamp_ntz")))
    named = found.withColumn(
        "_title", F.when(~F.col("item_title").eqNullSafe(F.concat("target_type", F.lit(" #"), F.col("target_id").cast("string"))), F.col("item_title")),
    )
    test = contains(q, "payment_code", "provider_transaction_id", "member_name", "member_email", "_title")
    number = whole_number(q)
    if number is not None:
        test = reduce(or_, [F.coalesce(F.col(c) == number, F.lit(False)) for c in ("payment_id", "member_id", "target_id")], test)
    return (named if test is None else named.where(test)).drop("_title")


def payment_dashboard(payments: DataFrame, first: Column, until: Column, now: Column | None = None) -> DataFrame:
    """A row for each currency, or one of zeros without any payment: counts and amounts by status, successes paid in [first, until),
    and, if given, the moment it was made. A null currency is VND."""
    is_ = lambda s: F.col("status") == s
    today = is_("SUCCESS") & (F.col("paid_at") >= first) & (F.col("paid_at") < until)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), zero())
    counts = {f"n_{n}": count_if(c) for n, c in (("success", is_("SUCCESS")), ("pending", is_("PENDING")), ("failed", is_("FAILED")), ("period", today))}
    amounts = {f"amount_{n}": total(c) for n, c in (("success", is_("SUCCESS")), ("pending", is_("PENDING")), ("period", today))}
    per = payments.groupBy(F.coalesce("currency", F.lit("VND")).alias("currency")).agg(*[c.alias(n) for n, c in (counts | amounts).items()])
    none = payments.agg(F.count("*").alias("_n")).where("_n = 0").select(  # one row at most
        F.lit("VND").alias("currency"), *[zero().alias(n) for n in (*counts, *amounts)],
    )
    out = per.unionByName(none)
    return out if now is None else out.withColumn("made_at", now)


def verified(events: DataFrame, payments: DataFrame, secret: str) -> DataFrame:
    """events: id, received_at, params (map). Callbacks as callback_outcomes() takes them, from the provider's parameters:
    the signature over all other vnp_ parameters, the amount in hundredths, and both codes "00" for success; paid_at is
    vnp_PayDate (yyyyMMddHHmmss), null if it can't be read."""
    get = lambda k: F.try_element_at("params", F.lit(k))
    signed = F.map_filter("params", lambda k, v: k.startswith("vnp_") & ~k.isin("vnp_SecureHash", "vnp_SecureHashType"))
    valid = F.lower(signature(secret)(signed)) == F.lower(get("vnp_SecureHash"))
    paid = F.try_to_number(get("vnp_Amount"), F.lit("999999999999999")).cast("long")
    success = (get("vnp_ResponseCode") == "00") & (get("vnp_TransactionStatus") == "00")
    paid_at = F.expr("try_to_timestamp(params['vnp_PayDate'], 'yyyyMMddHHmmss')").cast("timestamp_ntz").alias("paid_at")
    flags = ((valid, "signature_valid"), (success, "provider_success"))
    e = events.select("id", "received_at", get("vnp_TxnRef").alias("_ref"), F.floor(paid / 100).alias("_paid"), *(F.coalesce(c, F.lit(False)).alias(n) for c, n in flags), paid_at)
    p = payments.select(F.col("id").alias("payment_id"), F.col("payment_code").alias("_code"), F.col("amount").alias("_amount"))
    j = e.join(p, F.col("_ref") == F.col("_code"), "left")  # parameters are read before, so that they don't move
    amount = F.coalesce(F.col("_paid") == F.col("_amount"), F.lit(False)).alias("amount_matches")
    return j.select("id", "payment_id", "received_at", "signature_valid", amount, "provider_success", "paid_at")


def callback_outcomes(callbacks: DataFrame, payments: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """What each callback does, as if they were handled one after another: bad ones fail, the first good one of a pending
    payment decides it, later ones are ignored. `kept` columns of the callbacks stay beside it."""
    p = payments.select(F.col("id").alias("payment_id"), F.col("status").alias("_state"))
    c = callbacks.select("id", "payment_id", "received_at", "signature_valid", "amount_matches", "provider_success", *kept)
    j = c.join(p, "payment_id", "left")
    bad = F.when(~F.coalesce("signature_valid", F.lit(False)), "BAD_SIGNATURE").when(F.col("_state").isNull(), "UNKNOWN_PAYMENT").when(~F.coalesce("amount_matches", F.lit(False)), "AMOUNT_MISMATCH")
    j = j.withColumn("_bad", bad)
    n = F.sum(F.col("_bad").isNull().cast("int")).over(Window.partitionBy("payment_id").orderBy("received_at", "id").rowsBetween(Window.unboundedPreceding, 0))
    good = F.when((F.col("_state") != "PENDING") | (n > 1), "IGNORED").when(F.col("provider_success"), "SUCCESS").otherwise("FAILED")
    return j.select("id", "payment_id", F.coalesce("_bad", good).alias("outcome"), *kept)


MESSAGES = {  # fixed texts, kept with a payment
    "FULFILLED": "Ebook loan created", "LICENSE_UNAVAILABLE": "Payment succeeded but no ebook license was available",
    "BORROW_LIMIT_EXCEEDED": "Payment succeeded but member reached media borrow limit", "ALREADY_HAS_ACTIVE_LOAN": "Member already has an active ebook loan",
    "EBOOK_NOT_AVAILABLE": "Ebook is not active when payment succeeded",
}


def fulfilment(payments: DataFrame, ebooks: DataFrame, members: DataFrame, loans: DataFrame, ebook_loans: DataFrame, now: Column, ebook_now: Column) -> DataFrame:
    """The outcome of each successful e-book payment that has no loan yet, and the end of the loan it gives.

    In order: RESOURCE_NOT_FOUND (no member), EBOOK_NOT_FOUND, EBOOK_NOT_AVAILABLE, ALREADY_HAS_ACTIVE_LOAN,
    MEMBER_HAS_UNPAID_FINES, BORROW_LIMIT_EXCEEDED (physical and entitled e-book loans), LICENSE_UNAVAILABLE, FULFILLED.
    Payments are taken one by one by paid_at and id: each that is fulfilled uses up room under its member's limit and a
    licence, and is the loan that the member's later payments for the e-book find; others use up nothing."""
    paid = payments.where("status = 'SUCCESS' AND target_type = 'BOOK_EBOOK'").select("id", "member_id", F.col("target_id").alias("ebook_id"), "paid_at")
    paid = paid.join(ebook_loans.select(F.col("payment_id").alias("id")), "id", "left_anti")
    e = ebooks.select(F.col("id").alias("_ebook"), F.col("status").alias("_ebook_status"), "max_concurrent_loans", "loan_days")
    has = entitled(ebook_loans, ebook_now)
    own = has.select(F.col("member_id").alias("_own_member"), F.col("ebook_id").alias("_own_ebook")).distinct()
    used = has.groupBy(F.col("ebook_id").alias("_used_ebook")).agg(F.count("*").alias("_used"))
    j = with_member(paid, member_state(members, loans, ebook_loans, now, ebook_now)).join(e, F.col("ebook_id") == F.col("_ebook"), "left")
    j = j.join(
        own, (F.col("member_id") == F.col("_own_member")) & (F.col("ebook_id") == F.col("_own_ebook")), "left",
    ).join(used, F.col("ebook_id") == F.col("_used_ebook"), "left")
    free = F.col("max_concurrent_loans") - F.coalesce("_used", zero())
    before = F.when(F.col("_member").isNull(), "RESOURCE_NOT_FOUND").when(F.col("_ebook").isNull(), "EBOOK_NOT_FOUND").when(F.col("_ebook_status") != "ACTIVE", "EBOOK_NOT_AVAILABLE")
    has_one = F.col("_own_ebook").isNotNull()
    j = j.withColumn("_code", before)
    j = in_turn(
        j, "paid_at", F.col("member_id"), F.col("ebook_id"), F.struct("member_id", "ebook_id"), F.col("_room"), free,
        F.col("_code").isNull() & ~has_one & ~F.col("_unpaid"),
    )
    after = (
        F.when(has_one | (F.col("had_pair") > 0), "ALREADY_HAS_ACTIVE_LOAN").when(F.col("_unpaid"), "MEMBER_HAS_UNPAID_FINES")
        .when(F.col("had_member") >= F.col("room"), "BORROW_LIMIT_EXCEEDED").when(F.col("had_item") >= F.col("free"), "LICENSE_UNAVAILABLE").otherwise("FULFILLED")
    )
    j = j.withColumn("outcome", F.coalesce("_code", after))
    end = ebook_now + F.make_dt_interval(F.col("loan_days").cast("int"))
    return j.select("id", "member_id", "ebook_id", "outcome", F.when(F.col("outcome") == "FULFILLED", end).alias("expired_at"))


def fulfilment_metadata(payments: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """payments: id, metadata (map or null). (id, metadata) with what fulfilment() said, as status, message and moment; keys that
    are there already are replaced, others stay. Outcomes that have no message (errors) and payments without one change nothing."""
    text = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    told = outcomes.select(F.col("id").alias("_id"), F.col("outcome").alias("_outcome"), F.element_at(text, F.col("outcome")).alias("_text")).where("_text IS NOT NULL")
    new = F.create_map(
        F.lit("ebookFulfillmentStatus"), "_outcome", F.lit("ebookFulfillmentMessage"), "_text", F.lit("ebookFulfillmentAt"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    j = payments.select("id", "metadata").join(told, F.col("id") == F.col("_id"), "left")
    return j.select("id", F.when(F.col("_id").isNull(), F.col("metadata")).otherwise(F.map_concat(kept, new)).alias("metadata"))


def merged(old: DataFrame, new: DataFrame, key: str, update: bool = True, order: list[Column] | None = None) -> DataFrame:
    """An upsert: rows of new replace (or, without update, yield to) those of old with the same key; others are added.

    A key that stands in new more than once counts once: by its first row in `order`, by default that of all its columns,
    ascending. A null key is a key like others. Rows of old that share a key stay, or go, together."""
    once = head_of(new, [key], *(order or [F.col(c) for c in sorted(new.columns)]))
    same = old[key].eqNullSafe(once[key])
    if not update:
        return old.unionByName(once.join(old, same, "left_anti"))
    return old.join(once, same, "left_anti").unionByName(once)


def copy_counts(loans: DataFrame) -> DataFrame:
    """Copies of each book and those out on loan: counters recomputed rather than adjusted."""
    out = F.col("status").isin("BORROWED", "OVERDUE", "LOST")
    each = loans.groupBy("book_id", "copy_id").agg(F.max(out.cast("int")).alias("out"))
    return each.groupBy("book_id").agg(F.count("*").alias("copies"), F.sum("out").alias("copies_out"))
