"""Phrase collocations, level by level: frequent runs of 2 to 4 words of a language, scored by their weakest cut.

A run of k words can only be frequent if both runs of k - 1 words in it are. The frequent ones of a level are sent to the
tasks as one bit each, at a place given by a hash (BITS places, the same for any corpus); the next pass over the texts
emits a run only where both bits are set. A bit that two runs share lets a run through for nothing, and its exact count,
taken afterwards, drops it. Scores come from joins of candidates' cuts with the level tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.llm.common import LOWER, M1, fmix, same_words, saved, small_batches, texts_of, views, word_hash, word_spans, work_dir

PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAK = PIECE.copy()
BREAK[[0x20, 0x09]] = True
BITS = 1 << 26  # 8 MB
STRETCH = 1 << 21  # bytes of text whose runs are counted at once
SALTS = 64  # parts of a language's candidates that are ranked before they meet
COUNTED = "lang string, phrase string, n long"


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang))


def longer(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of each run with one more word."""
    return fmix(run * np.uint64(M1) + word)


def is_set(bits: np.ndarray, run: np.ndarray) -> np.ndarray:
    at = run & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Stretch:
    """The words of some rows: hashes, whether each is followed by another in its piece, and all words joined by one space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, BREAK)
        self.hash = word_hash(data, starts, ends)
        row = np.repeat(np.arange(len(langs)), np.diff(first))
        names = sorted(set(langs))
        at = {x: k for k, x in enumerate(names)}
        self.names, self.lang = names, np.array([at[x] for x in langs], np.int64)[row]
        self.seed = np.array([lang_hash(x) for x in names], np.uint64)[self.lang]
        piece = np.cumsum(PIECE[data], dtype=np.int32)[starts] if len(starts) else starts
        self.next = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        size = ends - starts
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        self.text = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        inside = np.flatnonzero(~BREAK[data])
        self.text[np.repeat(self.start - starts, size) + inside] = data[inside]

    def counts(self, at: np.ndarray, k: int, run: np.ndarray) -> pa.RecordBatch:
        """(lang, phrase, n) of the runs of k words that begin at `at`, whose hashes are `run`."""
        _, rep, back, n = np.unique(run, return_index=True, return_inverse=True, return_counts=True)
        like = rep[back]
        starts, ends = self.start[at], self.end[at + k - 1]
        same = (self.lang[at] == self.lang[at[like]]).all() and same_words(self.text, starts, ends, like)  # equal hashes are equal runs
        names = pa.array(self.names, pa.string())
        if same:
            return pa.RecordBatch.from_arrays([names.take(pa.array(self.lang[at[rep]])), texts_of(self.text, starts[rep], ends[rep]), pa.array(n)], names=["lang", "phrase", "n"])
        each = pa.table({"lang": names.take(pa.array(self.lang[at])), "phrase": texts_of(self.text, starts, ends), "n": pa.array(np.ones(len(at), np.int64))})
        each = each.group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        return each.select(["lang", "phrase", "n"]).combine_chunks().to_batches()[0]


def level(texts: DataFrame, k: int, bits: bytes | None) -> DataFrame:
    """(lang, phrase, n): all occurrences of runs of k words whose parts of k - 1 words have their bits set."""
    known = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if known is None else np.frombuffer(known.value, np.uint8)
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, hi, data, offsets in views(batch.column(0), STRETCH):
                s = Stretch(data, offsets, langs[lo:hi])
                run, there = fmix(s.hash ^ s.seed), np.ones(len(s.hash), bool)
                for j in range(2, k + 1):
                    if len(run) < 2:
                        there = there[:0]
                        break
                    there = there[:-1] & s.next[j - 2 :]
                    if j == k:
                        there = there & is_set(bits, run[:-1]) & is_set(bits, run[1:])
                    run = longer(run[:-1], s.hash[j - 1 :])
                at = np.flatnonzero(there)
                if len(at):
                    yield s.counts(at, k, run[at])

    return texts.mapInArrow(scan, COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bits_of(frequent: DataFrame, k: int) -> bytes:
    """The bits of the runs (lang, phrase) of k words: BITS of them, gathered as 4 KB for each 32,768."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed = np.array([lang_hash(x) for x in batch.column(0).to_pylist()], np.uint64)
            for lo, hi, data, offsets in views(batch.column(1), STRETCH):
                starts, ends, _ = word_spans(data, offsets, BREAK)
                words = word_hash(data, starts, ends).reshape(hi - lo, k)
                run = fmix(words[:, 0] ^ seed[lo:hi])
                for j in range(1, k):
                    run = longer(run, words[:, j])
                yield pa.RecordBatch.from_arrays([pa.array((run & np.uint64(BITS - 1)).astype(np.int64))], names=["p"])

    p = frequent.select("lang", "phrase").mapInArrow(places, "p long").select((F.col("p") + 1).alias("p"))  # counted from 1
    rows = p.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        out[(r.b - 1) * 4096 : r.b * 4096] |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def top(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` of each language by score, a (both descending) and phrase, with their rank: parts of a language are
    ranked first, so that what meets in one task is SALTS times `most` rows at most."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    few = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("part")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2000, inside: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first `most` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the occurrences of the phrase and of both parts of its weakest cut, n those of all words; score is
    floor(2000000 a / (l + r)), equal ones at the shortest first part. Candidates have 2 to `longest` words and `least`
    occurrences; those that stand inside a longer one with `inside` percent of their occurrences are dropped. Null texts are
    empty and null languages "und" (and so one with that name); repeated rows count each; an empty table gives an empty
    result; other columns are not read."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    first = saved(level(texts, 1, None), "words", folder)
    totals = first.groupBy("lang").agg(F.sum("n").alias("total"))  # a row a language
    levels = [first.where(F.col("n") >= least)]
    for k in range(2, longest + 1):
        found = level(texts, k, bits_of(levels[-1], k - 1)).where(F.col("n") >= least)
        levels.append(saved(found, f"runs-{k}", folder))
    candidates = reduce(DataFrame.union, levels[1:]).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    # Candidates inside longer ones: the most occurrences of any longer one that holds them.
    part = lambda size: F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " "))
    held = [candidates.where(F.size("w") > k).select("lang", F.explode(part(k)).alias("phrase"), F.col("a").alias("more")) for k in range(2, longest)]
    if held:
        most_of = reduce(DataFrame.union, held).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
        candidates = candidates.join(most_of, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("more") < inside * F.col("a"), F.lit(True))).drop("more")

    counts = reduce(DataFrame.union, levels[:-1])
    cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", "a", "w", cut)
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.expr("slice(w, 1, cut)"), " ").alias("first"), F.array_join(F.expr("slice(w, cut + 1, size(w) - cut)"), " ").alias("rest"))
    both = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    both = both.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("cast(2000000 * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s"))
    out = top(best.select("lang", "phrase", "a", "s.l", "s.r", "s.score"), most)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
