"""Packing token sequences: a cutting-stock linear program solved by column generation.

Each document's ids are cut into full pieces of `size` and one remainder. The histogram of remainder lengths (at most
size - 1 numbers, whatever the corpus) is the demand of a cutting-stock program: its columns are patterns of lengths
that fit in one sequence, a knapsack by dynamic programming prices new ones, and a revised simplex takes them in. The
solution is rounded, and what is left is a smaller program of the same kind; the last few lengths are filled longest
first. Slots of each length are numbered; documents are ranked within their length, and rank says slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.llm.common import saved, small_batches, work_dir
from folioquarry.llm.tokens import RankedIds

PARTS = 256  # of each length, so that a length that many documents share is ranked in many tasks
FULL = 100_000  # full pieces, which grow with the corpus, meant for a part
COLUMNS, SURE, REFRESH = 60, 1e-4, 200  # patterns that a pricing gives; the least pivot that is trusted; steps between inverses


_loaded: dict[str, RankedIds] = {}


def id_bytes(text: str, path: str) -> bytes:
    """Little-endian 32-bit ids of a text."""
    table = _loaded.get(path) or _loaded.setdefault(path, RankedIds(path))
    return table.ids(text).astype("<u4").tobytes()


def priced(lengths: np.ndarray, worth: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack program: the most worth of each capacity and the last length taken there (-1: none). lengths ascend."""
    best, took = np.zeros(size + 1), np.full(size + 1, -1)
    most = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if most[c]:
            found = best[c - lengths[: most[c]]] + worth[: most[c]]
            k = int(found.argmax())
            if found[k] > best[c] + 1e-12:
                best[c], took[c] = found[k], k
    return best, took


def filled(lengths: np.ndarray, took: np.ndarray, room: int, counts: np.ndarray) -> np.ndarray:
    """counts with the most worthy lengths for `room` added."""
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= int(lengths[took[room]])
    return counts


def knapsack(lengths: np.ndarray, worth: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most worthy pattern: (worth, count of each length)."""
    best, took = priced(lengths, worth, size)
    return float(best[size]), filled(lengths, took, size, np.zeros(len(lengths), np.int64))


def first_fit(lengths: np.ndarray, demand: np.ndarray, size: int) -> np.ndarray:
    """Patterns, one a column, that together cover the demand: the longest lengths that are left and fit, each used until one
    of its lengths runs out."""
    left, on = demand.astype(float), np.ones(len(lengths), bool)
    patterns = np.zeros((len(lengths), len(lengths)))
    for column in range(len(lengths)):
        room, pattern = size, patterns[:, column]
        while len(fit := np.flatnonzero(on & (lengths <= room) & (pattern == 0))):
            pattern[fit[-1]] = min(room // lengths[fit[-1]], max(1, np.ceil(left[fit[-1]])))
            room -= int(pattern[fit[-1]] * lengths[fit[-1]])
        held = np.flatnonzero(pattern)
        times = left[held] / pattern[held]
        left[held] = np.maximum(left[held] - times.min() * pattern[held], 0)
        on[held[times.argmin()]] = False
    return patterns


def column_generation(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 3e-3) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, one a column; how often each is used) within `gap` of the program's lower bound; gap=0 goes to its optimum.

    A revised simplex over a pool of patterns, at first those of first_fit(). Where none of the pool improves the program,
    the knapsack prices new ones: the best pattern around each length, of which the COLUMNS best come to the pool."""
    nudge = np.random.default_rng(0).random(len(demand)) * 1e-6  # so that no step of the simplex stands still
    nudged = demand * (1 + nudge) + nudge
    basis = np.diag(size // lengths).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    x = inverse.sum(0) * nudged
    pool, barred = first_fit(lengths, demand, size), np.zeros(len(lengths), bool)
    bound, entered = float((lengths * demand).sum()) / size, 0
    while x.sum() > bound * (1 + gap):
        dual = inverse.sum(0)
        worth = np.where(barred, 0, dual @ pool)
        k = int(worth.argmax())
        if worth[k] <= 1 + 1e-9:
            dual = np.maximum(dual, 0)
            best, took = priced(lengths, dual, size)
            if best[size] <= 1 + 1e-9:
                break
            bound = max(bound, float((dual * demand).sum() / best[size]))  # Farley's bound
            around = dual + best[size - lengths]
            new = [k for k in np.argsort(-around, kind="stable")[:COLUMNS] if around[k] > 1 + 1e-9]
            fresh = np.zeros((len(lengths), len(new)))
            fresh[new, np.arange(len(new))] = 1
            for column, k in enumerate(new):
                filled(lengths, took, size - int(lengths[k]), fresh[:, column])
            pool, barred = fresh, np.zeros(len(new), bool)  # what was in the pool can't improve now
            if (inverse.sum(0) @ pool).max() <= 1 + 1e-9:
                break
            continue
        step = inverse @ pool[:, k]
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.where(ratio <= ratio.min() * (1 + 1e-9) + 1e-12, step, 0).argmax())  # of equal ones the surest pivot
        if step[out] < SURE:
            barred[k] = True
            continue
        basis[:, out] = pool[:, k]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        times = ratio[out]
        x = x - times * step
        x[out] = times
        entered += 1
        if entered % REFRESH == 0:
            inverse = np.linalg.inv(basis)
            x = inverse @ nudged
    return basis.round().astype(np.int64), np.maximum(np.linalg.solve(basis, demand), 0)


def plan(histogram: dict[int, int], size: int, gap: float = 3e-3) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern as (length, copies), times)] that holds each length as often as the histogram says.

    The program's patterns are used as often as it says, rounded down, and then, the largest fractions first, once more where
    the lengths that are left allow it. What is left then is a smaller program of the same kind, and so on; the last few
    lengths, of which no pattern can be used, are filled longest first."""
    return planned(histogram, size, gap)[0]


def planned(histogram: dict[int, int], size: int, gap: float = 3e-3) -> tuple[list[tuple[list[tuple[int, int]], int]], int]:
    """(plan(), how many of its sequences the program's patterns make, full ones aside)."""
    out: list[tuple[list[tuple[int, int]], int]] = []
    if histogram.get(size):
        out.append(([(size, 1)], histogram[size]))
    lengths = np.array(sorted(k for k, v in histogram.items() if v and k < size), np.int64)
    left = np.array([histogram[k] for k in lengths.tolist()], np.int64)

    def use(pattern: np.ndarray, most: int) -> int:
        on = np.flatnonzero(pattern)
        times = min(most, int((left[on] // pattern[on]).min()))
        if times > 0:
            left[on] -= pattern[on] * times
            out.append(([(int(lengths[k]), int(pattern[k])) for k in on[::-1]], times))
        return max(times, 0)

    solved, some = 0, 1
    while some and left.any():
        there, some = np.flatnonzero(left), 0
        patterns, x = column_generation(lengths[there], left[there].astype(float), size, gap)
        whole = np.floor(x + 1e-9).astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            wide = np.zeros(len(left), np.int64)
            wide[there] = patterns[:, k]
            some += use(wide, int(whole[k]))
        for k in np.argsort(whole - x, kind="stable"):
            if x[k] - whole[k] > 1e-6:
                wide = np.zeros(len(left), np.int64)
                wide[there] = patterns[:, k]
                some += use(wide, 1)
        solved += some
    while left.any():
        pattern, room = np.zeros(len(left), np.int64), size
        while len(fit := np.flatnonzero((lengths <= room) & (left > pattern))):
            pattern[fit[-1]] += 1
            room -= int(lengths[fit[-1]])
        use(pattern, 1 << 60)
    return out, solved


def slots(plans: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in each, offset of the first copy), by length and rank."""
    rows, used, base = [], {}, 0
    for pattern, times in plans:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used.get(length, 0), base, copies, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids on demand.

    A document's ids are those of its whole text and then end_id, so a null or empty text is one piece of length 1. Null
    ids and repeated rows are packed like any other row. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, start, length, crc, total, kept = [], [], [], [], [], []
            for k, text in enumerate(pc.fill_null(batch.column(1), "").to_pylist()):
                ids = id_bytes(text, path) + end_id.to_bytes(4, "little")
                n = len(ids) // 4
                for a in range(0, n, size):
                    piece = ids[4 * a : 4 * (a + size)]
                    which.append(k)
                    start.append(a)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        kept.append(np.frombuffer(piece, "<i4"))
            cols = [batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    extra = ", ids array<int>" if with_ids else ""
    pieces = rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + extra)
    pieces = saved(pieces, "pieces", work_dir(spark))
    wide = max(PARTS, pieces.where(F.col("length") == size).count() // FULL)
    parts = F.when(F.col("length") == size, F.lit(wide)).otherwise(F.lit(PARTS))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), parts))

    counts = np.array(pieces.groupBy("length", "part").count().orderBy("length", "part").collect(), np.int64).reshape(-1, 3)  # (size - 1) * PARTS + wide rows at most
    before = np.cumsum(counts[:, 2]) - counts[:, 2]
    first = before - before[np.searchsorted(counts[:, 0], counts[:, 0])]
    histogram = dict(zip(*(x.tolist() for x in np.unique(counts[:, 0], return_counts=True)), strict=True))
    for n in histogram:
        histogram[n] = int(counts[counts[:, 0] == n, 2].sum())
    table = spark.sparkContext.broadcast((counts[:, 0] * wide + counts[:, 1], first, slots(plan(histogram, size))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, slot = table.value
        for batch in batches:
            length, part, row = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "part", "row"))
            rank = row + first[np.searchsorted(keys, length * wide + part)]
            far = np.int64(1) << np.int64(40)
            at = slot[np.searchsorted(slot[:, 0] * far + slot[:, 1], length * far + rank, "right") - 1]
            k = rank - at[:, 1]
            names = [n for n in batch.schema.names if n not in ("part", "row")]
            cols = [batch.column(n) for n in names] + [pa.array(at[:, 2] + k // at[:, 3]), pa.array(at[:, 4] + k % at[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("row", F.row_number().over(order).cast("long") - 1)
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long{extra}, sequence_id long, offset long")
