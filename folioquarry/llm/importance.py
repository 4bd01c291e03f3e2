"""Importance resampling towards a target: a weight for each text from hashed n-gram statistics, and a draw with Gumbel noise.

Words get integer ids by a dictionary. The id of a word is a 64-bit number made from its bytes, and building the
dictionary proves that no two words of the tables share one (else all ids are made anew with the next seed), so any task
can name a word without a look-up. N-grams are tuples of ids. Each distinct tuple of corpus and target is counted once
over both, its bytes are rebuilt from the dictionary and hashed once, and buckets, with their gains, are joined back to
the tuples of each text: the most frequent words, a bounded number of bytes, by broadcast, the others by a salted shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.common import LOWER, NOT_ALNUM, OFTEN, frequent_from, salted_join, same_words, saved, small_batches, texts_of, views, word_hash, word_spans, work_dir

SEEDS = 20  # of ids, tried one after another
SHARED = 8 << 20  # bytes of gains that are broadcast, 16 a word


def grams(ids: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(row, ids of each place, count) of the distinct runs of n words within each row, by row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
    parts = [ids[at + k] for k in range(n)]
    order = np.lexsort((*parts[::-1], row[at]))
    row, parts = row[at][order], [p[order] for p in parts]
    new = np.ones(len(row), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in (row, *parts)], axis=0)
    begins = np.flatnonzero(new)
    return row[begins], [p[begins] for p in parts], np.diff(np.append(begins, len(row)))


def dictionary(texts: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """texts: text, target (whether it is the target's). ((id, word, s, t): occurrences in the corpus and in the target; seed)."""
    for seed in range(SEEDS):

        def scan(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                goal = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for lo, hi, data, offsets in views(batch.column(0)):
                    data = LOWER[data]
                    starts, ends, first = word_spans(data, offsets, NOT_ALNUM)
                    if not len(starts):
                        continue
                    ids = word_hash(data, starts, ends, seed)
                    of_goal = np.repeat(goal[lo:hi], np.diff(first))
                    each, rep, back = np.unique(ids, return_index=True, return_inverse=True)
                    if not same_words(data, starts, ends, rep[back]):  # two words share an id: each word by itself
                        each, rep, back = ids, np.arange(len(ids)), np.arange(len(ids))
                    t = np.bincount(back[of_goal], minlength=len(each))
                    s = np.bincount(back, minlength=len(each)) - t
                    columns = [pa.array(each.view(np.int64)), texts_of(data, starts[rep], ends[rep]), pa.array(s), pa.array(t)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "word", "s", "t"])

        counts = texts.mapInArrow(scan, "id long, word string, s long, t long").groupBy("id")
        counts = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.min("word").alias("word"), F.max("word").alias("last"))
        counts = saved(counts, f"words-{seed}", folder)
        if counts.where("word <> last").isEmpty():
            return counts.select("id", "word", "s", "t"), seed
    raise RuntimeError(f"{SEEDS} seeds give two words the same id")


def longer_features(texts: DataFrame, words: DataFrame, seed: int, most: int, folder: str) -> DataFrame:
    """(ids, s, t, text) of the distinct runs of 2 to `most` words, each text rebuilt once from the dictionary."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goal = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in views(batch.column(0)):
                data = LOWER[data]
                starts, ends, first = word_spans(data, offsets, NOT_ALNUM)
                ids = word_hash(data, starts, ends, seed).view(np.int64)
                for n in range(2, most + 1):
                    row, parts, times = grams(ids, first, n)
                    t = np.where(goal[lo:hi][row], times, 0)
                    cuts = pa.array(np.arange(len(row) + 1) * n, pa.int32())
                    lists = pa.ListArray.from_arrays(cuts, pa.array(np.stack(parts, 1).ravel() if len(row) else np.zeros(0, np.int64)))
                    yield pa.RecordBatch.from_arrays([lists, pa.array(times - t), pa.array(t)], names=["ids", "s", "t"])

    found = texts.mapInArrow(scan, "ids array<long>, s long, t long").groupBy("ids").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    found = saved(found, "runs", folder).withColumn("run", F.monotonically_increasing_id())
    each = found.select("run", F.posexplode("ids").alias("at", "id"))
    named = salted_join(each, words.select("id", "word", (F.col("s") + F.col("t")).alias("n")), "id", F.col("n") >= OFTEN, F.xxhash64("run", "at"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")  # `most` words
    return found.join(named.groupBy("run").agg(text.alias("text")), "run").select("ids", "s", "t", "text")


def gains(features: DataFrame, buckets: int) -> dict[int, int]:
    """features: bucket, s, t. The gain of each bucket that any feature is in: `buckets` numbers at most."""
    rows = features.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    all_s, all_t = sum(r.s for r in rows), sum(r.t for r in rows)
    return {r.bucket: math.floor(1000 * math.log(((r.t + 1) * (all_s + buckets)) / ((r.s + 1) * (all_t + buckets)))) for r in rows}


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a row's own uniform number; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, folder: str) -> DataFrame:
    """rows: row, doc_id, score. (row, rank) by score descending, then doc_id, nulls last, then row: a sort by ranges, numbered
    within its partitions, whose sizes are summed up; no task sees more than a range."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = rows.select("row", "doc_id", "score").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = saved(dealt.select("row", F.monotonically_increasing_id().alias("at")), "sorted", folder)
    part = F.shiftright("at", 33)
    sizes = sorted(tuple(r) for r in dealt.groupBy(part.alias("part")).count().collect())  # a row a partition
    if not sizes:
        return dealt.select("row", F.col("at").alias("rank"))
    count = np.zeros(sizes[-1][0] + 2, np.int64)
    count[[p + 1 for p, _ in sizes]] = [n for _, n in sizes]
    before = F.from_json(F.lit(str(np.cumsum(count).tolist())), "array<long>")
    return dealt.select("row", (F.element_at(before, (part + 1).cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))


def resampled(
    docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (null unless drawn).

    Features are runs of 1 to `most` words; weight is the floored mean of their buckets' gains, 0 without any. Of the rows
    with `least_words` words, `percent` in a hundred with the highest weight plus noise are drawn, ties to the smaller id,
    nulls last, then in the table's order. Null texts have no words; repeated rows are rows of their own, with equal scores;
    an empty table gives an empty result, and an empty target equal gains; other columns are not read."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = rows.select("text", F.lit(False).alias("target")).union(target.select(F.col(target_col).cast("string"), F.lit(True)))
    words, ids_seed = dictionary(texts, folder)
    in_bucket = lambda c: F.pmod(F.crc32(c), F.lit(buckets))
    single = words.select("id", (F.col("s") + F.col("t")).alias("n"), "s", "t", in_bucket("word").alias("bucket"))
    features = single.select("bucket", "s", "t")
    longer = None
    if most > 1:
        longer = longer_features(texts, words, ids_seed, most, folder)
        longer = saved(longer.select("ids", (F.col("s") + F.col("t")).alias("n"), "s", "t", in_bucket("text").alias("bucket")), "features", folder)
        features = features.union(longer.select("bucket", "s", "t"))
    gain_of = gains(features, buckets)
    worth = np.zeros(buckets, np.int64)
    worth[list(gain_of)] = list(gain_of.values())
    gain = F.element_at(F.from_json(F.lit(str(worth.tolist())), "array<int>"), (F.col("bucket") + 1).cast("int"))  # `buckets` numbers

    least = frequent_from(single, F.lit(16).cast("long"), SHARED)
    often = single.where(F.col("n") >= least).select("id", gain.alias("gain")).toArrow()
    ids, of = often["id"].to_numpy(), often["gain"].to_numpy()
    order = np.argsort(ids)
    known = spark.sparkContext.broadcast((ids[order], of[order].astype(np.int64)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, value = known.value
        for batch in batches:
            for lo, hi, data, offsets in views(batch.column(1)):
                data = LOWER[data]
                starts, ends, first = word_spans(data, offsets, NOT_ALNUM)
                ids = word_hash(data, starts, ends, ids_seed).view(np.int64)
                n_words = np.diff(first)
                row, (one,), times = grams(ids, first, 1)
                at = np.minimum(np.searchsorted(table, one), max(len(table) - 1, 0))
                hit = table[at] == one if len(table) else np.zeros(len(one), bool)
                # Sums stay below 2 ** 53: a stretch has fewer bytes.
                total = np.bincount(row[hit], value[at[hit]] * times[hit], hi - lo) if hit.any() else np.zeros(hi - lo)
                rest = (row[~hit], [one[~hit]], times[~hit])
                n_features = n_words.copy()
                out = [batch.column(0)[lo:hi], pa.array(n_words), None, pa.array(total.astype(np.int64)), *listed(*rest, hi - lo)]
                if most > 1:
                    found = [grams(ids, first, n) for n in range(2, most + 1)]
                    n_features += sum(np.maximum(n_words - n + 1, 0) for n in range(2, most + 1))
                    flat = [(r, tuple(int(p[k]) for p in parts), int(c[k])) for r_, parts, c in found for k, r in enumerate(r_.tolist())]
                    each = [[(g, c) for _, g, c in group] for group in split(flat, hi - lo)]
                    out += [pa.array([[g for g, _ in x] for x in each], pa.list_(pa.list_(pa.int64()))), pa.array([[c for _, c in x] for x in each], pa.list_(pa.int64()))]
                out[2] = pa.array(n_features)
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "n_words", "n_features", "known", "ids", "times"] + ["runs", "run_times"] * (most > 1)
    schema = f"doc_id {kind}, n_words long, n_features long, known long, ids array<long>, times array<long>"
    schema += ", runs array<array<long>>, run_times array<long>" * (most > 1)
    each = saved(rows.mapInArrow(weigh, schema), "weighed", folder).withColumn("row", F.monotonically_increasing_id())
    missing = F.coalesce("gain", F.raise_error(F.lit("a feature has no gain")).cast("int"))

    def joined(lists: str, times: str, table: DataFrame, key: str) -> DataFrame:
        rest = each.where(F.size(lists) > 0).select("row", F.explode(F.arrays_zip(F.col(lists).alias("k"), F.col(times).alias("f"))).alias("p"))
        rest = rest.select("row", F.col("p.k").alias(key), F.col("p.f").alias("f"))
        met = salted_join(rest, table.select(key, "n", gain.alias("gain")), key, F.col("n") >= OFTEN, F.xxhash64("row"))
        return met.groupBy("row").agg(F.sum(F.col("f") * missing).alias("more"))

    more = joined("ids", "times", single.where(F.col("n") < least), "id")
    if longer is not None:
        more = more.union(joined("runs", "run_times", longer, "ids")).groupBy("row").agg(F.sum("more").alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    n = F.col("n_features")
    mean = F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(0)  # exact: the remainder is taken off first
    scored = each.select("row", "doc_id", "n_words", "n_features", "known").join(more, "row", "left")
    scored = scored.select("row", "doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))
    scored = saved(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored", folder)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranks = ranked(able, folder).where(F.col("rank") <= drawn)
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def listed(row: np.ndarray, parts: list[np.ndarray], times: np.ndarray, n: int) -> list[pa.Array]:
    """Ids and counts as a list a row."""
    cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
    return [pa.ListArray.from_arrays(cuts, pa.array(parts[0])), pa.ListArray.from_arrays(cuts, pa.array(times))]


def split(flat: list[tuple], n: int) -> list[list[tuple]]:
    """Entries, each beginning with its row, as a list a row."""
    out: list[list[tuple]] = [[] for _ in range(n)]
    for entry in flat:
        out[entry[0]].append(entry)
    return out
