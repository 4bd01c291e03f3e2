"""CSV ingestion: header-named rows, validation with a quarantine, duplicate rules, books, names and copies to add.

A file is read with its header (names in any case) and refused whole beyond the limits; rows get their record number from
the order of their file, and everything after that is joins and aggregates. Many files are read side by side, each by the
task that has it.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.operators.ordered import numbered
from folioquarry.sources.work import saved

REQUIRED = ("title", "isbn", "authors", "category", "barcode")
OPTIONAL = ("condition", "location", "language", "published_date", "edition")
MOST_BYTES, MOST_ROWS = 5 << 20, 5000


@dataclass
class Import:
    good: DataFrame  # rows to add
    errors: DataFrame  # row_number, code, message
    books: DataFrame  # new books, with ids: the first row of each ISBN
    authors: DataFrame  # new names, with ids
    categories: DataFrame  # new names, with ids
    book_authors: DataFrame  # (isbn_key, author_id) of new books
    copies: DataFrame  # copies added per ISBN
    copy_rows: DataFrame  # one row a copy, with its book's id
    summary: DataFrame  # total, success, failed, created_books, created_copies


def read_rows(spark: SparkSession, path: str, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of one file, lower-cased names, all optional columns there, row_number from 2 (1 is the header).

    A folder, an empty or too large file, missing columns or too many rows raise ValueError."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    if not status.isFile() or not 0 < status.getLen() <= most_bytes:
        raise ValueError(f"{path} is no file of 1 to {most_bytes} bytes")
    raw = spark.read.options(header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE").csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = lambda c: F.nullif(F.trim(c), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    # One file with multiLine is one partition, so these ids follow its records.
    rows = raw.select(*[text(c).alias(c) for c in (*REQUIRED, *OPTIONAL)], (F.monotonically_increasing_id() + 2).alias("row_number"))
    if rows.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    return rows


def records_of(content: bytes, most_rows: int) -> tuple[list[tuple], str | None]:
    """((row_number, REQUIRED and OPTIONAL values) of a file's records, or why it is refused)."""
    try:
        records = [r for r in csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), skipinitialspace=True, strict=True) if r]
    except (UnicodeDecodeError, csv.Error) as e:
        return [], f"can't be read: {e}"[:200]
    header = [c.strip().lower() for c in records[0]] if records else []
    missing = [c for c in REQUIRED if c not in header]
    if missing:
        return [], f"missing columns: {', '.join(missing)}"
    if len(records) - 1 > most_rows:
        return [], f"more than {most_rows} rows"
    places = [header.index(c) if c in header else None for c in (*REQUIRED, *OPTIONAL)]
    value = lambda r, at: (r[at].strip() or None) if at is not None and at < len(r) else None
    return [(k, *(value(r, at) for at in places)) for k, r in enumerate(records[1:], 2)], None


def read_files(spark: SparkSession, path: str, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """path: files, folders or patterns in any store. (rows of all files that can be read: file, row_number from 2, and the
    columns of read_rows(); file, reason of those that are refused whole). A file of `most_bytes` at most is one row of a
    task, so files are read side by side, and larger ones aren't opened. Spark doesn't list files without any byte, so they
    are in neither."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= most_bytes
    large = files.where(~fits).select(F.col("path").alias("file"), F.lit(f"over {most_bytes} bytes").alias("reason"))
    names = [*REQUIRED, *OPTIONAL]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                found, reason = records_of(content, most_rows)
                rows = [(file, None, *r) for r in found] if reason is None else [(file, reason, None, *[None] * len(names))]
                yield pd.DataFrame(rows, columns=["file", "reason", "row_number", *names]).astype({"row_number": "Int64"})

    schema = "file string, reason string, row_number long, " + ", ".join(f"{n} string" for n in names)
    told = saved(files.where(fits).select("path", "content").mapInPandas(run, schema), "records")
    refused = large.unionByName(told.where("reason IS NOT NULL").select("file", "reason"))
    return told.where("reason IS NULL").drop("reason"), refused


def plan_import(rows: DataFrame, existing_barcodes: DataFrame, existing_books: DataFrame, known_authors: DataFrame, known_categories: DataFrame) -> Import:
    """rows: of one file, or of many, then with file. existing_barcodes: barcode; existing_books: id, isbn, deleted; known_*: id,
    name. Comparisons ignore case, and look at all files together.

    All rows of a barcode that stands twice in the file are refused, and rows whose barcode or deleted ISBN exists. Dates
    are year-month-day in full. A blank category is none; a blank language is "vi". Blank authors, titles, ISBNs or
    barcodes are errors."""
    key = lambda c: F.lower(F.trim(c))
    names = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("authors", F.lit("")), "[;|]"), lambda x: F.trim(x)), lambda x: x != ""))
    rows = rows.withColumns({"names": names, "day": F.when(F.col("published_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.expr("try_cast(published_date AS DATE)")), "bar": key("barcode"), "isbn_key": key("isbn")})
    twice = rows.where("bar IS NOT NULL").groupBy("bar").count().where("count > 1").select("bar", F.lit(True).alias("twice"))
    held = existing_barcodes.select(key("barcode").alias("bar"), F.lit(True).alias("held")).distinct()
    gone = existing_books.where("deleted").select(key("isbn").alias("isbn_key"), F.lit(True).alias("gone")).distinct()
    j = rows.join(twice, "bar", "left").join(held, "bar", "left").join(gone, "isbn_key", "left")
    bad = F.when(F.size("names") == 0, "BAD_REQUEST").when(
        F.col("title").isNull() | F.col("isbn_key").isNull() | F.col("bar").isNull(), "BAD_REQUEST",
    ).when(F.col("published_date").isNotNull() & F.col("day").isNull(), "BAD_REQUEST")
    j = j.withColumn("code", bad.when(F.col("twice") | F.col("held") | F.col("gone"), "DUPLICATE_RESOURCE"))
    why = F.when(F.col("twice"), "barcode stands twice in the file").when(F.col("held"), "barcode exists").when(F.col("gone"), "ISBN belongs to a deleted book").otherwise("row can't be read")
    place = [c for c in ("file", "row_number") if c in rows.columns]
    errors = j.where("code IS NOT NULL").select(*place, "code", why.alias("message"))
    good = j.where("code IS NULL").drop("code", "twice", "held", "gone")
    live = existing_books.where("NOT deleted").select(F.col("id").alias("_book"), key("isbn").alias("isbn_key"))
    first = good.groupBy("isbn_key").agg(F.min_by(F.struct("title", "isbn", F.coalesce("language", F.lit("vi")).alias("language"), "day", "edition", "category", "names"), F.struct(*place)).alias("b"))
    fresh = lambda names, known: numbered(
        names.groupBy(key("name").alias("k")).agg(F.min("name").alias("name")).join(known.select(key("name").alias("k")), "k", "left_anti").select("name"),
        ["name"], known,
    )
    new = first.join(live, "isbn_key", "left_anti")
    # Names are made for new books alone: rows of a book that is there bring only their copies.
    authors = fresh(new.select(F.explode("b.names").alias("name")), known_authors)
    categories = fresh(new.where("b.category IS NOT NULL").select(F.col("b.category").alias("name")), known_categories)
    names_of = lambda known, new: known.select("id", key("name").alias("_k")).unionByName(new.select("id", key("name").alias("_k")))
    books = new.select("isbn_key", "b.*").join(
        names_of(known_categories, categories).withColumnRenamed("id", "category_id"), key("category") == F.col("_k"), "left",
    ).drop("_k")
    books = numbered(books, ["isbn_key"], existing_books)
    book_authors = new.select("isbn_key", F.explode("b.names").alias("name")).join(names_of(known_authors, authors), key("name") == F.col("_k")).select("isbn_key", F.col("id").alias("author_id")).distinct()
    copies = good.groupBy("isbn_key").agg(F.count("*").alias("copies"))
    of_isbn = live.unionByName(books.select(F.col("id").alias("_book"), "isbn_key"))
    copy_rows = good.join(of_isbn, "isbn_key").select(
        F.col("_book").alias("book_id"), F.trim("barcode").alias("barcode"), F.lit("AVAILABLE").alias("status"), "condition", "location", *place,
    )
    summary = j.agg(F.count("*").alias("total"), F.count_if(F.col("code").isNull()).alias("success"), F.count_if(F.col("code").isNotNull()).alias("failed"))
    summary = summary.crossJoin(new.agg(F.count("*").alias("created_books"))).withColumn("created_copies", F.col("success"))  # single rows
    return Import(good, errors, books, authors, categories, book_authors, copies, copy_rows, summary)


def run_import(spark: SparkSession, path: str, log: str, job: str, sink: str, *tables: DataFrame, remove: bool = False) -> Import:
    """A whole import under a run log: PENDING, PROCESSING, then COMPLETED with the numbers of rows or FAILED with the reason.
    Rows are read and planned, and copies are appended to `sink`. With remove the file goes at the end, whatever became of it.
    tables: as plan_import() takes them."""
    from folioquarry.sources.runs import append_copies, logged

    done: list[Import] = []

    def work() -> tuple[int, int]:
        plan = plan_import(read_rows(spark, path), *tables)
        now = F.current_timestamp()
        added = append_copies(plan.copy_rows.withColumns({"created_at": now, "updated_at": now}), sink)
        done.append(plan)
        return added, plan.errors.count()

    try:
        logged(spark, log, job, work, states=("PENDING", "PROCESSING"))
    finally:
        if remove:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, False)
    return done[0]
