"""Removal of repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A window is a string of `length` bytes. Its anchor is the position, among its first `length - GRAM + 1` ones, with the
least hash of the GRAM bytes there, the leftmost of equal ones; equal windows have their anchor at the same place. So
only suffixes at anchors are sorted, each with the bytes before it that its windows need. As in distributed prefix
doubling, a suffix whose first GRAM bytes stand nowhere else needs no more than these: it is dropped before the exchange.

The rest is cut into partitions by those first bytes. A task sorts its suffixes and sends each partition a front-coded
run: the length of the prefix shared with the one before, and the bytes after it. The receiving task merges runs with a
loser tree that knows, for each player, the prefix shared with the last winner, and compares bytes only beyond it. In
the merged order the common prefixes of neighbours give the classes of equal right parts at any depth, those of the
sorted left parts the classes of equal left parts; a window is repeated if both of its classes hold another suffix.

Equal texts are one text: what they hold is repeated if it is long enough. Equal suffixes of a task are sent once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.common import fmix, powers, prefix_hash, removed, saved, small_batches, span_hash, views, work_dir
from folioquarry.llm.common import INVERSE

SEGMENT = 1 << 20  # windows of one text handled at once
RUN = 24 << 20  # bytes of suffixes that a task sorts at once
BUCKET = 64 << 20  # bytes of texts meant for a bucket
PART = 24 << 20  # bytes of suffixes meant for a partition
SPAN = pa.struct([("a", pa.int64()), ("b", pa.int64())])
RECORD = np.dtype([("key", "V16"), ("at", "<i8"), ("lo", "<i2"), ("hi", "<i2"), ("done", "?")])


def gram(length: int) -> int:
    return length // 2 + 1


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of rows of bytes end to end: (row, anchor's byte in data, its hash, first and last of its windows' distances).

    A window at anchor - d belongs to the anchor for d from `lo` to `hi`."""
    g = gram(length)
    w = length - g + 1
    n = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty.view(np.uint64), empty, empty
    sums = prefix_hash(data)
    m = len(data) - g + 1
    hashes = fmix((sums[g:] - sums[:m]) * powers(m, INVERSE))
    low = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(m, dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[w - span : w - span + n])
    first = (low & np.uint64((1 << 24) - 1)).astype(np.int64)  # of each window
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    valid = np.flatnonzero(np.arange(n) + length <= offsets[1:][row])
    first, row = first[valid], row[valid]
    if not len(first):
        return empty, empty, empty.view(np.uint64), empty, empty
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(new[1:], len(first)) - 1
    at = first[new]
    return row[new], at, hashes[at], at - valid[last], at - valid[new]


def stretches(texts: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, byte of the first row's text where they begin); long texts come in overlapping segments."""
    for lo, hi, data, offsets in views(texts, SEGMENT):
        if hi == lo + 1 and len(data) > SEGMENT + length:
            for a in range(0, len(data) - length + 1, SEGMENT):
                part = data[a : a + SEGMENT + length - 1]
                yield lo, part, np.array([0, len(part)]), a
        else:
            yield lo, data, offsets, 0


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, given that `known` bytes agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class Run:
    """A sorted, front-coded list of suffixes with their records."""

    @staticmethod
    def packed(strings: list[bytes], records: np.ndarray) -> bytes:
        """strings ascend."""
        shared, rest, last = [], [], b""
        for s in strings:
            k = common(last, s, 0)
            shared.append(k)
            rest.append(s[k:])
            last = s
        n = np.array([len(strings)], "<i8").tobytes()
        return n + np.array(shared, "<u2").tobytes() + np.array([len(r) for r in rest], "<u2").tobytes() + records.tobytes() + b"".join(rest)

    def __init__(self, blob: bytes):
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        self.shared = np.frombuffer(blob, "<u2", n, 8).tolist()
        size = np.frombuffer(blob, "<u2", n, 8 + 2 * n)
        self.records = np.frombuffer(blob, RECORD, n, 8 + 4 * n)
        self.blob, self.n = blob, n
        self.cuts = (8 + 4 * n + RECORD.itemsize * n + np.concatenate([[0], np.cumsum(size, dtype=np.int64)])).tolist()
        self.at, self.string = -1, b""

    def advance(self) -> bool:
        self.at += 1
        if self.at >= self.n:
            return False
        self.string = self.string[: self.shared[self.at]] + self.blob[self.cuts[self.at] : self.cuts[self.at + 1]]
        return True


def merge(runs: list[Run]) -> tuple[list[bytes], list[int], list[tuple[int, int]]]:
    """(strings in order, prefix shared with the one before, (run, place) of each), by a loser tree.

    Each player has the prefix it shares with the last winner. The longer one wins without a comparison; with equal ones
    bytes are compared from there on, and the loser keeps what it shares with the winner."""
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    string: list[bytes | None] = [None] * k
    shared = [0] * k
    for i, r in enumerate(runs):
        if r.advance():
            string[i] = r.string

    def beats(a: int, b: int) -> bool:
        """Whether player a comes before b; sets what the loser shares with the winner."""
        x, y = string[a], string[b]
        if y is None:
            return True
        if x is None:
            return False
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        h = common(x, y, shared[a])
        first = h == len(x) or (h < len(y) and x[h] < y[h])
        shared[b if first else a] = h
        return first

    tree = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        first = beats(a, b)
        tree[node] = b if first else a
        return a if first else b

    win = play(1)
    out: list[bytes] = []
    prefix: list[int] = []
    where: list[tuple[int, int]] = []
    while (s := string[win]) is not None:
        out.append(s)
        prefix.append(shared[win])
        run = runs[win]
        where.append((win, run.at))
        if run.advance():
            string[win], shared[win] = run.string, run.shared[run.at]
        else:
            string[win] = None
        node = (win + k) // 2
        while node:
            other = tree[node]
            if not beats(win, other):
                tree[node], win = win, other
            node //= 2
    return out, prefix, where


def repeated(blobs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first byte, end byte) of stretches of bytes that repeated windows of merged runs cover."""
    runs = [Run(b) for b in blobs]
    strings, shared, where = merge(runs)
    n = len(strings)
    records = np.concatenate([r.records for r in runs])
    base = np.cumsum([0, *(r.n for r in runs)])
    records = records[[base[r] + p for r, p in where]]
    lo, hi = records["lo"].astype(np.int64), records["hi"].astype(np.int64)
    right = length - lo
    agree = np.minimum(np.array(shared, np.int64), right)
    agree[1:] = np.minimum(agree[1:], right[:-1])
    agree[:1] = 0
    lefts = [s[length + 2 :] for s in strings]
    by = sorted(range(n), key=lefts.__getitem__)
    agree_left = np.array([0, *(common(lefts[a], lefts[b], 0) for a, b in zip(by, by[1:], strict=False))], np.int64)
    place = np.empty(n, np.int64)
    place[by] = np.arange(n)
    least = int(lo.min(initial=0))
    most = int(hi.max(initial=0))
    found = np.zeros((n, most - least + 1), bool)
    for d in range(least, most + 1):
        on = np.flatnonzero((lo <= d) & (d <= hi))
        if len(on) < 2:
            continue
        pair = np.cumsum(agree < length - d)[on] * np.int64(n + 1) + np.cumsum(agree_left < d)[place[on]]
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        found[on, d - least] = count[inverse] > 1
    found[records["done"]] = False
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    at = records["at"][row]
    return records["key"][row], at - (last + least), at - (first + least) + length


def _grams(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for first, data, offsets, _ in stretches(batch.column(1), length):
                row, _, hashes, _, _ = anchors(data, offsets, length)
                order = np.lexsort((row, hashes))
                row, hashes = row[order], hashes[order]
                new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])[: len(row)])
                count = np.diff(np.append(new, len(row)))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), keys.take(pa.array(first + row[new], pa.int64())), pa.array(count, pa.int64())], names=["gram", "key", "n"])

    return run


def _runs(length: int, parts: int):
    """Front-coded runs for partitions; what a task knows to be repeated comes as a row a text: (key, spans)."""

    def flush(held: list[tuple[int, bytes, tuple]]) -> list[dict]:
        held.sort(key=lambda x: (x[0], x[1]))
        out, a = [], 0
        while a < len(held):
            b = a
            while b < len(held) and held[b][0] == held[a][0]:
                b += 1
            out.append({"part": held[a][0], "blob": Run.packed([h[1] for h in held[a:b]], np.array([h[2] for h in held[a:b]], RECORD)), "key": None, "spans": None})
            a = b
        return out

    schema = pa.schema([("part", pa.int32()), ("blob", pa.binary()), ("key", pa.binary()), ("spans", pa.list_(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, tuple]] = []
        size = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            wanted = batch.column(2)
            for first, data, offsets, start in stretches(batch.column(1), length):
                row, at, hashes, lo, hi = anchors(data, offsets, length)
                rows = len(offsets) - 1
                want = wanted.slice(first, rows)
                of = np.repeat(np.arange(rows), np.diff(want.offsets.to_numpy()))
                have = np.unique(fmix(want.flatten().to_numpy().view(np.uint64) ^ fmix(of.astype(np.uint64) + np.uint64(1))))
                keep = np.isin(fmix(hashes ^ fmix(row.astype(np.uint64) + np.uint64(1))), have)
                row, at, hashes, lo, hi = row[keep], at[keep], hashes[keep], lo[keep], hi[keep]
                if not len(row):
                    continue
                begin = start - offsets[row]  # of a row's text, seen from data
                whole = span_hash(prefix_hash(data), at - hi, at - lo + length) ^ fmix((lo << 16 | hi).astype(np.uint64))
                _, one, inverse, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                raw = data.tobytes()
                first_byte, end_byte = (at - hi).tolist(), (at - lo + length).tolist()
                alike = np.zeros(len(row), bool)  # bytes that stand elsewhere in this stretch too
                others = []
                for k in np.flatnonzero(count[inverse] > 1).tolist():
                    like = int(one[inverse[k]])
                    if k == like:
                        continue
                    if raw[first_byte[k] : end_byte[k]] == raw[first_byte[like] : end_byte[like]] and lo[k] == lo[like]:
                        alike[[k, like]] = True
                    else:  # one hash, other bytes
                        others.append(k)
                many = np.flatnonzero(alike)
                if len(many):
                    yield _marks([keys[first + r] for r in range(rows)], row[many], begin[many] + at[many] - hi[many], begin[many] + at[many] - lo[many] + length, schema)
                for k in [*one.tolist(), *others]:
                    i, d0, d1 = int(at[k]), int(lo[k]), int(hi[k])
                    r = raw[i : i + length - d0]
                    s = r.ljust(length, b"\0") + len(r).to_bytes(2, "big") + raw[i - d1 : i][::-1]
                    held.append((int(hashes[k] % np.uint64(parts)), s, (np.void(keys[first + int(row[k])]), int(begin[k]) + i, d0, d1, bool(alike[k]))))
                    size += len(s) + 200
                if size >= RUN:
                    yield from _table(flush(held), schema)
                    held, size = [], 0
        if held:
            yield from _table(flush(held), schema)

    def _table(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(rows), 16):
            yield pa.RecordBatch.from_pylist(rows[a : a + 16], schema=schema)

    def _marks(keys: list[bytes], row: np.ndarray, a: np.ndarray, b: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        """One row a text: what of it is known to be repeated."""
        who, spans = merged_spans(row, a, b)
        part = pa.array((fmix(who.astype(np.uint64) + np.uint64(len(row))) % np.uint64(parts)).astype(np.int32))
        return pa.RecordBatch.from_arrays([part, pa.nulls(len(who), pa.binary()), pa.array([keys[r] for r in who.tolist()], pa.binary()), spans], schema=schema)

    return run


def merged_spans(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(distinct rows, the union of each one's stretches from a to b as a list of (a, b))."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    far = int(b.max(initial=0)) + 1
    reach = np.maximum.accumulate(b + row * far)  # rows don't meet: a row's ends lie beyond those of rows before it
    new = np.concatenate([[True], (a[1:] + row[1:] * far > reach[:-1]) | (row[1:] != row[:-1])])[: len(row)]
    start = np.flatnonzero(new)
    end = reach[np.append(start[1:], len(row))[: len(start)] - 1] - row[start] * far
    who, count = np.unique(row[start], return_counts=True)
    pairs = pa.StructArray.from_arrays([pa.array(a[start], pa.int64()), pa.array(end, pa.int64())], fields=list(SPAN))
    return who, pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), pairs)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def changed(docs: DataFrame, lengths: tuple[int, ...], of: Callable[[bytes, list[list[tuple[int, int]]]], dict], kind: str, text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(key, columns of `kind`) of each distinct text that has repeated bytes; of: what to say of a text's bytes and, for
    each of `lengths`, of the stretches (a, b) of them that are repeated, which are all of them where the text has copies.

    Distinct texts are written once, whatever the number of lengths. Work tables are gone when it returns: the result is
    written."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark)
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= min(lengths))
    rows = rows.select(F.unhex(F.md5("text")).alias("key"), "text")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for k, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    # Equal keys are in one bucket, so later joins by key leave the texts where they are.
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BUCKET))
    name = f"texts_{uuid.uuid4().hex}"
    rows.mapInArrow(once, "key binary, text string").repartition(n, "key").mapInArrow(once, "key binary, text string").write.bucketBy(n, "key").option("path", f"{folder}/texts").saveAsTable(name)
    try:
        texts = spark.table(name)
        copies = saved(rows.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"), "copies", folder)

        cut = texts.join(copies, "key", "left").select("key", "text", F.coalesce("copies", F.lit(1)).alias("copies"))
        for length in lengths:
            spans = saved(_repeated_spans(texts if length == min(lengths) else texts.where(F.octet_length("text") >= length), length, n, folder), f"spans-{length}", folder)
            cut = cut.join(spans.withColumnRenamed("spans", f"spans_{length}"), "key", "left")
        names = [f"spans_{length}" for length in lengths]
        hit = reduce(or_, [F.col(c).isNotNull() for c in names], F.col("copies") > 1)
        out = saved(cut.where(hit).select("key", "text", "copies", *names).mapInArrow(_each(of, lengths), f"key binary, {kind}"), "cut", folder)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for part in ("texts", "copies", *(f"{x}-{length}" for x in ("wanted", "spans") for length in lengths)):
        removed(spark, f"{folder}/{part}")
    return out


def _repeated_spans(texts: DataFrame, length: int, n: int, folder: str) -> DataFrame:
    """(key, spans) of distinct texts that share strings of `length` bytes with others or within themselves."""
    grams = texts.mapInArrow(_grams(length), "gram long, key binary, n long")
    often = grams.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    wanted = saved(grams.join(often, "gram", "left_semi").groupBy("key").agg(F.collect_list("gram").alias("grams")), f"wanted-{length}", folder)  # one text's
    count = wanted.agg(F.sum(F.size("grams").cast("long"))).first()[0] or 0
    parts = max(n, -(-count * (length + 100) // PART))
    runs = texts.join(wanted, "key").select("key", "text", "grams").mapInArrow(_runs(length, parts), "part int, blob binary, key binary, spans array<struct<a: long, b: long>>")

    def merged(table: pa.Table) -> pa.Table:
        known = table.filter(table["blob"].is_null()).select(["key", "spans"])
        blobs = [b for b in table["blob"].to_pylist() if b is not None]
        if not blobs:
            return known
        keys, a, b = repeated(blobs, length)
        names, row = np.unique(keys, return_inverse=True)
        who, spans = merged_spans(row, a, b)
        return pa.concat_tables([known, pa.table({"key": pa.array([names[r].tobytes() for r in who.tolist()], pa.binary()), "spans": spans})])

    marks = runs.groupBy("part").applyInArrow(merged, "key binary, spans array<struct<a: long, b: long>>")
    return marks.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # one text's


def _each(of: Callable[[bytes, list[list[tuple[int, int]]]], dict], lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, copies, *each in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                gone = [([(0, len(raw))] if len(raw) >= n else []) if copies > 1 else _union([(s["a"], s["b"]) for s in spans or []]) for n, spans in zip(lengths, each, strict=True)]
                out.append({"key": key} | of(raw, gone))
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return run


def without_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", passage: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a string of `length` bytes that also starts anywhere else in the table. With passage,
    n_passage follows: the bytes covered by such strings of `passage` bytes, which are counted, not removed. Null and
    short texts lose nothing (null counts as empty). Repeated rows and equal texts repeat each other. Null ids stay. An
    empty table gives an empty result; other columns are not read.
    """
    lengths = (length,) if passage is None else (length, passage)

    def told(raw: bytes, gone: list[list[tuple[int, int]]]) -> dict:
        covered = [sum(b - a for a, b in g) for g in gone]
        return {"n_removed": covered[0], "n_spans": len(gone[0]), "sha": hashlib.sha256(_kept(raw, gone[0])).hexdigest(), "n_passage": covered[-1]}

    done = changed(docs, lengths, told, "n_removed long, n_spans long, sha string, n_passage long", text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return rows.join(done, "key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), *([F.coalesce("n_passage", zero).alias("n_passage")] if passage else []))


def kept_texts(docs: DataFrame, length: int = 400, text_col: str = "text") -> DataFrame:
    """docs, all its columns, with the removed bytes cut out of text_col; parts of characters left at a cut go too."""
    cut = changed(docs, (length,), lambda raw, gone: {"kept": _kept(raw, gone[0]).decode(errors="ignore")}, "kept string", text_col)
    key, kept = f"key_{uuid.uuid4().hex}", f"kept_{uuid.uuid4().hex}"
    left = docs.withColumn(key, F.unhex(F.md5(F.col(text_col).cast("string"))))
    both = left.join(cut.select(F.col("key").alias(key), F.col("kept").alias(kept)), key, "left")
    return both.select(*(F.coalesce(kept, F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns))


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in gone:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])
