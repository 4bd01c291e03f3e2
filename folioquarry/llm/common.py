"""Shared pieces: work folders, Arrow byte views, vectorised word splitting and hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M1, M2, BASE = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEPS = 60  # of components()
SHORT = 32  # bytes of a word that are hashed eight at a time
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight
CHUNK = 1 << 21  # bytes of text handled at once; a longer text is handled alone


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset (tests on one machine), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="work-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, folder: str | None = None, compression: str | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{folder or work_dir(spark)}/{name}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a work folder of this run."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a bounded size, so that long texts don't pile up in a Python worker; settings made by the user stay."""
    for key, usual, value in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", str(64 << 20), str(16 << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, usual).lower() in (usual, "64mb", "67108864b"):
            spark.conf.set(key, value)


OFTEN = 1 << 14  # rows that share a key before it is salted
WAYS = 32  # salts
SLOTS = 1 << 16  # bits that say which keys are salted


def slot_test(keys: DataFrame, *names: str) -> Column | None:
    """A condition that holds for rows whose columns `names` are in keys, and for few others; None if keys is empty.

    It looks up one of SLOTS bits by the columns' hash, so what goes to the driver and back is the same for any keys."""
    slot = F.pmod(F.xxhash64(*names), F.lit(SLOTS))
    on = [r.s for r in keys.select(slot.alias("s")).distinct().collect()]  # SLOTS rows at most
    if not on:
        return None
    bits = np.zeros(SLOTS, np.uint8)
    bits[on] = 1
    words = F.from_json(F.lit(str(np.packbits(bits, bitorder="little").view("<i4").tolist())), "array<int>")  # folded to a literal
    return F.getbit(F.element_at(words, (F.shiftright(slot, 5) + 1).cast("int")), F.pmod(slot, F.lit(32)).cast("int")) == 1


def salted_join(left: DataFrame, right: DataFrame, key: str, often: Column, salt: Column) -> DataFrame:
    """left, outer joined to right, whose keys are distinct. Rows of left whose key is `often` in right (a condition on right)
    are spread over WAYS tasks by `salt` (a column of left), and such rows of right are there once for each.

    Which keys these are is said by slot_test(), alike on both sides: a key that it takes for one of them is spread for
    nothing, and the result is the same."""
    hit = slot_test(right.where(often).select(key), key)
    if hit is None:
        return left.join(right, key, "left")
    spread = left.withColumn("_salt", F.when(hit, F.pmod(salt, F.lit(WAYS)).cast("int")).otherwise(0))
    copies = right.withColumn("_salt", F.explode(F.when(hit, F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))))
    return spread.join(copies, [key, "_salt"], "left").drop("_salt")


def frequent_from(table: DataFrame, size: Column, room: int) -> int:
    """table: n. The least n so that all rows with at least as much take `room` bytes by `size`; beyond any n if none fit.

    Read from sizes by n, below OFTEN one by one and beyond it by powers of two: OFTEN + 63 rows at most."""
    step = F.when(F.col("n") < OFTEN, F.col("n")).otherwise(F.pow(F.lit(2.0), F.length(F.bin("n")) - 1).cast("long"))
    least = 1 << 62
    for n, bytes_ in sorted(table.groupBy(step.alias("step")).agg(F.sum(size)).collect(), reverse=True):
        room -= bytes_
        if room < 0:
            break
        least = n
    return least


def fmix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(M1)
    h ^= h >> np.uint64(33)
    h *= np.uint64(M2)
    h ^= h >> np.uint64(33)
    return h


BYTE_HASH = fmix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, of: int) -> np.ndarray:
    """of ** 0, 1, ... n - 1 modulo 2 ** 64."""
    have = _powers.get(str(of))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), of, np.uint64)
        steps[0] = 1
        have = _powers[str(of)] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def views(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in them) for stretches of about `limit` bytes. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums for span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * powers(len(data), BASE), dtype=np.uint64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the same bytes stand."""
    h = (sums[ends] - sums[starts]) * powers(len(sums), INVERSE)[starts]
    return fmix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(M2)))


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of each word and the first word of each row and the end; no word crosses rows."""
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    last[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes: 8 bytes at a time are mixed in; spans over SHORT bytes go to xxHash.

    Each block is mixed before the next one comes in, so that no arrangement of blocks cancels out, as it can in a
    polynomial modulo a power of two."""
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    h = size.astype(np.uint64) * np.uint64(BASE) + np.uint64((M1 + seed * M2) % (1 << 64))
    rows = np.arange(len(size))
    for done in range(0, SHORT, 8):
        if done:
            rows = rows[size[rows] > done]
        if not len(rows):
            break
        block = eight[starts[rows] + done] & KEEP[np.minimum(size[rows] - done, 8)]
        h[rows] = fmix(h[rows] ^ block) * np.uint64(M2)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw = data.tobytes()
        h[long] = np.array([xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], np.uint64)
    return fmix(h)


def texts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of bytes as strings; they may overlap."""
    size = ends - starts
    cuts = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=cuts[1:])
    at = np.arange(cuts[-1]) + np.repeat(starts - cuts[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(cuts), pa.py_buffer(data[at]))


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each span has the bytes of the span with the number `like` has for it."""
    rows = np.flatnonzero(starts != starts[like])
    if not (ends - starts == ends[like] - starts[like]).all():
        return False
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    size, here, there = (ends - starts)[rows], starts[rows], starts[like[rows]]
    for done in range(0, SHORT, 8):
        some = np.flatnonzero(size > done)
        if ((eight[here[some] + done] ^ eight[there[some] + done]) & KEEP[np.minimum(size[some] - done, 8)]).any():
            return False
    return all((data[here[k] : here[k] + size[k]] == data[there[k] : there[k] + size[k]]).all() for k in np.flatnonzero(size > SHORT))


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, its start byte, first word of each row and the end)."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, separator)
    return word_hash(data, starts, ends), starts, first


def components(links: DataFrame, folder: str, tag: str) -> DataFrame:
    """links: (a long, b long). Returns (node, component), component the smallest node reachable, for all nodes in links.

    Alternates large-star and small-star steps until the links no longer change; each step's links are written to the
    shared folder, and no step gathers a node's neighbours in one place: their minimum is aggregated before the
    shuffle, and where a node's links meet it, a plain inner join, adaptive execution splits a node with very many links.
    The steps grow with the logarithm of the longest path; links that aren't settled after STEPS raise an error.
    """
    spark = links.sparkSession
    now = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0", folder)
    mark = None
    for step in range(1, STEPS + 1):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("p")).select(F.col("p.x").alias("a"), F.col("p.y").alias("b")).where("a <> b").distinct()
        now = saved(small, f"{tag}-{step}", folder)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components not settled after {STEPS} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
