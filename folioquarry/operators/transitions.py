"""What outcomes do to the tables: loans, copies, holds and counters changed together; counters kept by deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.operators.lending import live
from folioquarry.operators.ordered import numbered


def updated(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """table with the columns of `changes` (key, once each, and some of table's columns) where a row has a change."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_key"), F.struct(*names).alias("_new"))
    j = table.join(new, F.col(key) == F.col("_key"), "left")
    kept = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) for c in names}
    return j.select(*[kept.get(c, F.col(c)) for c in table.columns])


def book_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after: copies that changed (id, book_id, status, deleted), as they were and are; a new or removed copy stands in one
    of them. (book_id, total, available): what its counters grow by; books whose counters stay aren't there."""
    one = lambda df, sign: live(df).select(
        "book_id", F.lit(sign).cast("long").alias("total"), F.when(F.col("status") == "AVAILABLE", sign).otherwise(0).cast("long").alias("available"),
    )
    sums = one(before, -1).unionByName(one(after, 1)).groupBy("book_id").agg(F.sum("total").alias("total"), F.sum("available").alias("available"))
    return sums.where("total <> 0 OR available <> 0")


def book_counts(copies: DataFrame) -> DataFrame:
    """(book_id, total, available) recounted from live copies; a null status isn't available."""
    return live(copies).groupBy("book_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("status") == "AVAILABLE", F.lit(False))).alias("available"))


def counted_on(kept: DataFrame, deltas: DataFrame) -> DataFrame:
    """kept counters with deltas added: counters of new books begin at the delta, those that fall to no copies go. Both are
    (book_id, total, available) with one row a book; deltas of several batches are summed first."""
    both = kept.unionByName(deltas).groupBy("book_id").agg(F.sum("total").alias("total"), F.sum("available").alias("available"))
    return both.where("total <> 0 OR available <> 0")


def desk_changes(
    loans: DataFrame, copies: DataFrame, holds: DataFrame, books: DataFrame, out: DataFrame | None = None, back: DataFrame | None = None,
    returned_at: DataFrame | None = None, cancelled: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The tables loans, copies, holds and books after lending.checkouts() (out), lending.check_in() (back, with the returns it was
    given, for their moments) or lending.cancel_holds() (cancelled). Refused requests change nothing.

    A checkout adds a loan, with the next free ids in the order of requests' ids, takes its copy and one from its book's
    available copies. A return closes its loan with its fine, changes its copy, gives the copy to the hold that gets it, and
    adds one to the available copies where the copy goes back on the shelf; so does the copy of a cancelled hold."""
    deltas = []
    if out is not None:
        ok = out.where("code = 'OK'")
        new = numbered(ok.withColumnRenamed("id", "_request"), ["borrowed_at", "_request"], loans)
        missing = [c for c in loans.columns if c not in new.columns]
        new = new.withColumns({c: F.lit(None).cast(loans.schema[c].dataType) for c in missing})
        loans = loans.unionByName(new.select(*[F.col(c).cast(loans.schema[c].dataType).alias(c) for c in loans.columns]))
        copies = updated(copies, ok.select(F.col("copy_id").alias("id"), F.lit("BORROWED").alias("status")))
        deltas.append(ok.groupBy("book_id").agg((-F.count("*")).alias("_delta")))
    if back is not None:
        ok = back.where("code = 'RETURNED'").join(returned_at.select("id", F.col("returned_at").alias("_at")), "id")
        loans = updated(
            loans,
            ok.select(F.col("loan_id").alias("id"), F.lit("RETURNED").alias("status"), F.col("_at").alias("returned_at"), F.col("fine").alias("fine_amount")),
        )
        copies = updated(copies, ok.select(F.col("copy_id").alias("id"), F.col("copy_status").alias("status")))
        ready = ok.where("next_hold_id IS NOT NULL")
        holds = updated(
            holds,
            ready.select(
                F.col("next_hold_id").alias("id"), F.lit("READY_FOR_PICKUP").alias("status"), F.col("copy_id").alias("assigned_copy_id"),
                F.col("next_expires_at").alias("expires_at"),
            ),
        )
        deltas.append(ok.groupBy("book_id").agg(F.sum("counter_delta").alias("_delta")))
    if cancelled is not None:
        ok = cancelled.where("code = 'CANCELLED'")
        freed = ok.where("freed_copy_id IS NOT NULL")
        ready = freed.where("next_hold_id IS NOT NULL")
        holds = updated(holds, ok.select(F.col("hold_id").alias("id"), F.lit("CANCELLED").alias("status")))
        states = {"id": "next_hold_id", "assigned_copy_id": "freed_copy_id", "expires_at": "next_expires_at"}
        holds = updated(holds, ready.select(F.lit("READY_FOR_PICKUP").alias("status"), *[F.col(v).alias(k) for k, v in states.items()]))
        copies = updated(copies, freed.select(F.col("freed_copy_id").alias("id"), F.col("copy_status").alias("status")))
        deltas.append(freed.groupBy("book_id").agg(F.sum("counter_delta").alias("_delta")))
    for delta in deltas:
        j = books.join(delta.withColumnRenamed("book_id", "_book"), F.col("id") == F.col("_book"), "left")
        grown = F.col("available_copies") + F.coalesce("_delta", F.lit(0))
        books = j.select(*[grown.alias(c) if c == "available_copies" else F.col(c) for c in books.columns])
    return {"loans": loans, "copies": copies, "holds": holds, "books": books}
