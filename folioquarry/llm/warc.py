"""WARC archives: written by Spark's text writer, read back by verifying the chain of record boundaries.

A reader can't trust the magic line "WARC/1.1": payloads may hold it. Tasks cut their block of a file at every magic
line, take each place as a candidate and work out where its record, if it is one, would end, which is where its successor
must begin. Only what is reachable from the start of the file by successors is a record. Within a block (of
spark.sql.files.maxPartitionBytes at most) candidates jump along their successors by doubling until they leave it; across
blocks the few places where chains enter one are joined in the same way, until a step adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioquarry.llm.common import saved, slot_test, small_batches, work_dir

MAGIC, BLANK = b"WARC/1.1\r\n", b"\r\n\r\n"
HEAD = 1 << 16  # bytes of a header at most
LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", re.I)
FIELD = re.compile(rb"[!-9;-~]+:")
FIELDS = {name: re.compile(rb"\r\n" + name.encode() + rb":[ \t]*([^\r\n]*?)[ \t]*\r\n", re.I) for name in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest", "Content-Type")}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Writing


def record_uri(doc_id: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(doc_id.cast("string")), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def records(pages: DataFrame, least: int, moment: str, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """A record a row of pages, without the two empty lines that end it: a response, or a revisit of the row with the same
    payload of `least` bytes or more that comes first by id, nulls last (of rows repeated under it, the first of the table).

    Rows are numbered as they are read, so a table that isn't the same when it is read again must be written before."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    heads = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min(order).alias("head"), F.count("*").alias("copies")).where("copies > 1")
    heads = heads.select(F.col("digest").alias("shared"), "head")
    # Payloads that no other row has are written where they are read; the others, and few besides, move to meet their head.
    hit = slot_test(heads.select(F.col("shared").alias("digest")), "digest")
    may = F.lit(False) if hit is None else hit & (F.col("size") >= least)
    none = F.lit(None).cast(heads.schema["head"].dataType)
    alone = rows.where(~may).withColumn("head", none)
    j = alone.unionByName(rows.where(may).join(heads, F.col("digest") == F.col("shared"), "left").drop("shared"))
    again = F.col("head").isNotNull() & (F.col("head.row") != F.col("row"))
    uri = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20"), r"WARC/1\.1$", "WARC/1%2E1")  # no magic in a header
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    kind = F.when(again, F.concat(F.lit(f"revisit\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_uri(F.col("head.id"), F.col("head.row")))).otherwise("response")
    head = F.concat(
        F.lit("WARC/1.1\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_uri(F.col("id"), F.col("row")),
        F.lit(f"\r\nWARC-Date: {moment}\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nContent-Type: application/http;msgtype=response\r\n\r\n"),
    )
    return j.select(F.concat(head, block).alias("value"))


def write_archive(pages: DataFrame, path: str, least: int = 100, moment: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes records() as WARC files, one a task, under `path` in any store that Spark writes. Null html is empty; an empty
    table gives no record."""
    records(pages, least, moment, id_col, url_col, html_col).write.text(path, lineSep="\r\n\r\n")


# Reading


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what stands between magic lines, in order within a block. The first of a file stands before its
    first magic line; any other belongs to the block in which it begins."""
    return spark.read.text(path, lineSep=MAGIC.decode()).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def parsed(head: bytes) -> dict | None:
    """The fields of a record's header, which ends in an empty line; None if it is none."""
    lines = b"\r\n" + head
    length = LENGTH.search(lines)
    if length is None or not all(FIELD.match(x) for x in head[:-4].split(b"\r\n")):
        return None
    got = {k: (m := f.search(lines)) and m[1].decode("utf-8", "replace") for k, f in FIELDS.items()}
    return got | {"length": int(length[1])}


def payload_of(block: bytes, content_type: str | None) -> tuple[bytes, int | None] | None:
    """(payload, size that the HTTP header tells) of a record's block; None where its HTTP header doesn't end."""
    if not (content_type or "").startswith("application/http"):
        return block, None
    cut = block.find(BLANK)
    if cut < 0:
        return None
    told = LENGTH.search(b"\r\n" + block[: cut + 4])
    return block[cut + 4 :], int(told[1]) if told else None


def exits(at: np.ndarray, then: np.ndarray, end: int) -> np.ndarray:
    """Where the chain from each candidate leaves its block, or -1 where it breaks. at ascend; then: successors, -1 without."""
    if not len(at):
        return then
    k = np.minimum(np.searchsorted(at, then), len(at) - 1)
    inside = (then >= 0) & (then < end) & (at[k] == then)
    jump = np.where(inside, k, np.arange(len(at)))
    last = np.where(inside, -1, np.where(then >= end, then, -1))
    while (jump != (far := jump[jump])).any():
        jump = far
    return last[jump]


NAMES = ["file", "block", "at", "size", "then", "leaves", "type", "record_id", "refers_to", "digest", "payload_bytes", "payload_sha256", "length", "http"]
SCANNED = "file string, block long, at long, size long, then long, leaves long, type string, record_id string, refers_to string, digest string, payload_bytes long, payload_sha256 string, length long, http boolean"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a chunk: `at` is where it begins, after its magic line, counted from the first chunk of its block; `then` is
    where its successor would begin, if it is a candidate; the payload's digest, if the chunk holds it whole."""
    key, at, rows, waiting = None, 0, [], None

    def told() -> pa.RecordBatch:
        place, then = np.array([r[2] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        out = exits(place, then, at).tolist()
        columns = list(zip(*(r[:5] + [x] + r[6:] for r, x in zip(rows, out, strict=True)), strict=True))
        kinds = [pa.string(), *[pa.int64()] * 5, *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    def fill(row: list, head: bytes, rest: bytes) -> None:
        """row: of the chunk where a header begins; rest: what its chunk holds after it."""
        got = parsed(head)
        if got is None:
            return
        row[4] = row[2] + len(head) + got["length"] + len(BLANK) + len(MAGIC)
        row[6:10] = [got["WARC-Type"], got["WARC-Record-ID"], got["WARC-Refers-To"], got["WARC-Payload-Digest"]]
        row[12:14] = [got["length"], (got["Content-Type"] or "").startswith("application/http")]
        if len(rest) >= got["length"] and (found := payload_of(rest[: got["length"]], got["Content-Type"])):
            row[10] = found[1] if got["WARC-Type"] == "revisit" else len(found[0])
            row[11] = None if got["WARC-Type"] == "revisit" else hashlib.sha256(found[0]).hexdigest()

    for batch in batches:
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != key:
                if rows:
                    yield told()
                key, at, rows, waiting = (file, block), 0, [], None
            row = [file, block, at, len(value), -1, -1, *[None] * 7, False]
            if waiting is not None:  # a header that a magic line cut, read on
                waiting[1] += MAGIC + value
                if (cut := waiting[1].find(BLANK)) >= 0 or len(waiting[1]) > HEAD:
                    if 0 <= cut:
                        fill(waiting[0], waiting[1][: cut + 4], waiting[1][cut + 4 :])
                    waiting = None
            if block or rows:  # the first chunk of a file stands before the first magic line
                cut = value.find(BLANK)
                if 0 <= cut < HEAD:
                    fill(row, value[: cut + 4], value[cut + 4 :])
                elif cut < 0 and waiting is None and FIELD.match(value):
                    waiting = [row, value]
            rows.append(row)
            at += len(value) + len(MAGIC)
    if rows:
        yield told()


def reached(all_: DataFrame, folder: str) -> DataFrame:
    """all_: file, at (from the file's start), leaves. (file, at) of what chains from the files' starts enter blocks at."""
    start = all_.select("file").distinct().select("file", F.lit(len(MAGIC)).cast("long").alias("at"))
    goals = all_.where("leaves >= 0").select("file", F.col("leaves").alias("at")).union(start).distinct()
    jump = saved(all_.where("leaves >= 0").join(goals, ["file", "at"], "left_semi").select("file", "at", "leaves"), "jump-0", folder)
    here, step = saved(start, "here-0", folder), 0
    n = here.count()
    while True:
        step += 1
        more = here.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        here = saved(here.union(more).distinct(), f"here-{step}", folder)
        if (now := here.count()) == n:
            return here
        n = now
        twice = jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("beyond"))
        jump = saved(jump.join(twice, ["file", "leaves"], "left").select("file", "at", F.coalesce("beyond", "leaves").alias("leaves")), f"jump-{step}", folder)


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block in order: which are records (from where the file's chain enters the block), and whose bytes others are."""
    key, expected, owner = None, None, None
    for batch in batches:
        real, whose = [], []
        for file, block, at, then, enters in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "at", "then", "enters")), strict=True):
            if (file, block) != key:
                key, expected, owner = (file, block), None, None
            if enters or at == expected:
                real.append(True)
                expected, owner = then, at
            else:
                real.append(False)
            whose.append(owner)
        columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "enters"]
        names = [n for n in batch.schema.names if n != "enters"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(real), pa.array(whose, pa.int64())], names=[*names, "real", "owner"])


def read_archive(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """A row a record of the archives under path: file, at, type, record_id, refers_to, digest (as its header says),
    payload_bytes, payload_sha256 (of the bytes read; null for revisits, whose size is their HTTP header's).

    A file whose chain doesn't end where the file ends raises, and so does a digest that isn't its payload's. A header that
    a magic line cuts (a field ending in it) is read on within its block. An archive without records gives no row."""
    small_batches(spark)
    folder = folder or work_dir(spark)
    found = saved(chunks(spark, path).mapInArrow(scan, SCANNED), "scanned", folder)
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    base = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"))
    placed = found.join(base, ["file", "block"])
    moved = {c: F.when(F.col(c) >= 0, F.col(c) + F.col("base")).otherwise(-1) for c in ("at", "then", "leaves")}
    placed = saved(placed.withColumns(moved).drop("base"), "placed", folder)
    entries = reached(placed, folder)
    ends = placed.groupBy("file").agg(F.max(F.col("at") + F.col("size") + len(MAGIC)).alias("at"))
    broken = ends.join(entries, ["file", "at"], "left_anti").limit(3).collect()
    if broken:
        raise ValueError(f"the chain of records doesn't reach the end of {', '.join(r.file for r in broken)}")
    flagged = placed.join(entries.withColumn("enters", F.lit(True)), ["file", "at"], "left").withColumn("enters", F.coalesce("enters", F.lit(False)))
    in_order = flagged.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flagged.schema if f.name != "enters") + ", real boolean, owner long"
    told = saved(in_order.mapInArrow(marked, schema), "marked", folder)
    whole = told.where("real").select("file", "at", "type", "record_id", "refers_to", "digest", "payload_bytes", "payload_sha256")
    torn = told.where("real AND payload_sha256 IS NULL AND coalesce(type, '') <> 'revisit'").select("file", F.col("at").alias("owner"), "length", "http")
    if not torn.isEmpty():
        whole = saved(whole.join(glued(spark, path, told, torn, base), ["file", "at"], "left").select(*whole.columns[:6], F.coalesce("payload_bytes", "glued_bytes").alias("payload_bytes"), F.coalesce("payload_sha256", "glued_sha256").alias("payload_sha256")), "whole", folder)
    wrong = F.raise_error(F.concat(F.lit("not its payload's digest: "), "record_id")).cast("string")
    same = F.col("payload_sha256").isNull() | F.col("digest").isNull() | ~F.col("digest").startswith("sha256:") | (F.col("digest") == F.concat(F.lit("sha256:"), "payload_sha256"))
    return whole.withColumn("payload_sha256", F.when(same, F.col("payload_sha256")).otherwise(wrong))


def glued(spark: SparkSession, path: str, told: DataFrame, torn: DataFrame, base: DataFrame) -> DataFrame:
    """(file, at, glued_bytes, glued_sha256) of records whose payload holds magic lines: their chunks are read once more and
    put together. torn: file, owner (where the record begins), length, http. A record was one row, and is one again."""
    last = told.groupBy("file", "block").agg(F.max("owner").alias("last"))
    carried = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    owned = told.join(last.select("file", "block", carried.alias("carried")), ["file", "block"]).join(base, ["file", "block"])
    parts = owned.select("file", "block", (F.col("at") - F.col("base")).alias("place"), F.coalesce("owner", "carried").alias("owner")).join(torn, ["file", "owner"])

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for batch in batches:
            places = []
            for file, block, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pa.compute.binary_length(batch.column(2)).to_pylist(), strict=True):
                if (file, block) != key:
                    key, at = (file, block), 0
                places.append(at)
                at += size + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["file", "block", "value", "place"])

    names = ("file", "block", "place")
    pieces = chunks(spark, path).mapInArrow(located, "file string, block long, value binary, place long").where(slot_test(parts, *names))
    joined = pieces.join(parts, list(names)).select("file", "owner", "length", "http", "block", "place", F.col("value").cast("string").alias("value"))
    each = F.sort_array(F.collect_list(F.struct("block", "place", "value")))  # one record's
    texts = joined.groupBy("file", "owner", "length", "http").agg(F.array_join(F.transform(each, lambda x: x["value"]), MAGIC.decode()).cast("binary").alias("value"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shas = [], []
            for length, http, value in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                cut = value.find(BLANK) + 4
                payload, _ = payload_of(value[cut : cut + length], "application/http" if http else None) or (b"", None)
                sizes.append(len(payload))
                shas.append(hashlib.sha256(payload).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(shas)], names=["file", "at", "glued_bytes", "glued_sha256"])

    return texts.mapInArrow(digests, "file string, at long, glued_bytes long, glued_sha256 string")


def archived(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages written as WARC files and read back: page_id, payload_bytes, payload_digest (bare SHA-256), record_type, refers_to.

    As records() says which rows are revisits; repeated rows are records of their own. refers_to is the response's id (null
    if that is null); other columns are not read; an empty table gives an empty result."""
    spark = pages.sparkSession
    folder = work_dir(spark)
    kind = pages.schema[id_col].dataType.simpleString()
    write_archive(pages, f"{folder}/warc", least, id_col=id_col, url_col=url_col, html_col=html_col)
    read = read_archive(spark, f"{folder}/warc", folder)
    id_of = lambda c: F.url_decode(F.nullif(F.regexp_extract(c, "^<urn:page:(.*):[0-9]+>$", 1), F.lit(""))).cast(kind)
    digest = F.coalesce("payload_sha256", F.regexp_replace("digest", "^sha256:", ""))
    return read.select(id_of("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), id_of("refers_to").alias("refers_to"))
