"""Token counts by pre-token, without ids.

Each row's pre-token frequencies are written to the shared folder. The distinct pre-tokens of the whole table, with the
number of rows that have them, are counted into pieces once each. That table is joined to the frequencies in two parts: its
most frequent rows, a bounded number of bytes, are broadcast and joined where the frequencies lie; all others are joined by a
shuffle, in which those that stand in many rows are salted. A row's count is the sum of both.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.common import OFTEN, frequent_from, removed, salted_join, saved, small_batches, work_dir

HELD = 300_000  # distinct pre-tokens that a task holds before it passes them on
SHARED = 8 << 20  # bytes of the table that is broadcast, with 16 for each entry
STRETCH = 128  # rows whose frequencies are held at once


class PreTokens:
    """What a byte-level BPE file (tokenizers' JSON) does before its merges: added tokens, then pre-tokens."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre, added = conf["pre_tokenizer"], conf["added_tokens"]
        plain = lambda t: not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])
        if conf["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or not all(map(plain, added)):
            raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space is handled")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.path = path
        self.tokenizer = None  # loaded where pieces are counted, not where texts are cut

    def of(self, text: str) -> list[str]:
        """Pre-tokens in order; an added token stands as one."""
        if self.cut is None or not any(t in text for t in self.added):
            return self.find(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self.find(part)
        return out

    def count(self, pieces: list[str]) -> list[int]:
        """The number of tokens of each pre-token; no id is read."""
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would hold memory of its own
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return [len(x) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


class RankedIds:
    """Ids of whole texts for a byte-level BPE file whose merges are in the order of their ids: then ids are ranks, and a
    rank-based encoder gives what the file's own library gives, several times as fast."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.pre = PreTokens(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow 255
        letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = {bytes(letter[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in self.pre.added}
        order = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError(f"{path}: merges aren't in the order of ids")
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens=self.pre.added)

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())


_loaded: dict[str, PreTokens] = {}


def pre_tokens(path: str) -> PreTokens:
    return _loaded.get(path) or _loaded.setdefault(path, PreTokens(path))


def count_column(texts: list[str], path: str) -> list[int]:
    """Tokens of each of a few texts, in one place."""
    pre = pre_tokens(path)
    found = [Counter(pre.of(t)) for t in texts]
    each = list({p for f in found for p in f})
    table = dict(zip(each, pre.count(each), strict=True)) if each else {}
    return [sum(table[p] * n for p, n in f.items()) for f in found]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty, with no token. Null ids and repeated rows stay as they are; whole texts of any length are
    counted; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pre_tokens(path).of
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a in range(0, len(texts), STRETCH):
                found = [Counter(of(t)) for t in texts[a : a + STRETCH].to_pylist()]
                cuts = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                piece = pa.array([p for f in found for p in f], pa.string())
                times = pa.array([n for f in found for n in f.values()], pa.int32())
                n_bytes = pc.cast(pc.binary_length(texts[a : a + STRETCH]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + STRETCH], n_bytes, pa.ListArray.from_arrays(cuts, piece), pa.ListArray.from_arrays(cuts, times)], names=["doc_id", "n_bytes", "pieces", "times"])

    each = saved(rows.mapInArrow(frequencies, f"doc_id {kind}, n_bytes long, pieces array<string>, times array<int>"), "frequencies", folder, compression="zstd")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def told() -> pa.RecordBatch:
            t = pa.concat_tables(held).group_by("piece").aggregate([("n", "sum")])
            return pa.RecordBatch.from_arrays([t["piece"].combine_chunks(), t["n_sum"].combine_chunks()], names=["piece", "n"])

        for batch in batches:
            v = pc.value_counts(batch.column(0).flatten())
            held.append(pa.table({"piece": v.field("values"), "n": v.field("counts")}))
            size += len(v)
            if size > HELD:
                held = [pa.Table.from_batches([told()])]
                pa.default_memory_pool().release_unused()
                size = len(held[0])
                if size > HELD // 2:
                    yield held[0].combine_chunks().to_batches()[0]
                    held, size = [], 0
        if size:
            yield told()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = pre_tokens(path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count(batch.column(0).to_pylist()), pa.int64())], names=["piece", "n", "tokens"])
        pa.default_memory_pool().release_unused()

    once = each.select("pieces").mapInArrow(distinct, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    table = saved(once.mapInArrow(counted, "piece string, n long, tokens long"), "pieces", folder)  # each distinct pre-token once

    # The most frequent ones, SHARED bytes of them at most, are broadcast; all others are joined, salted where they are often.
    least = frequent_from(table, F.octet_length("piece") + F.lit(16).cast("long"), SHARED)
    frequent = table.where(F.col("n") >= least).select("piece", "tokens").toArrow()
    known = spark.sparkContext.broadcast((frequent["piece"].combine_chunks(), frequent["tokens"].to_numpy()))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, tokens = known.value
        for batch in batches:
            lists = batch.column(2)
            flat, times = lists.flatten(), batch.column(3).flatten()
            of = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            at = pc.index_in(flat, value_set=pieces).to_numpy(zero_copy_only=False) if len(pieces) else np.full(len(flat), np.nan)
            hit = ~np.isnan(at.astype(float))
            n = times.to_numpy()
            # Sums stay below 2 ** 53: a batch has fewer bytes.
            total = np.bincount(of[hit], tokens[at[hit].astype(np.int64)] * n[hit], len(lists)) if hit.any() else np.zeros(len(lists))
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[~hit], minlength=len(lists)))]), pa.int32())
            rest = pa.array(~hit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total.astype(np.int64)), pa.ListArray.from_arrays(cuts, flat.filter(rest)), pa.ListArray.from_arrays(cuts, times.filter(rest))], names=["doc_id", "n_bytes", "n", "pieces", "times"])

    part = each.mapInArrow(joined, f"doc_id {kind}, n_bytes long, n long, pieces array<string>, times array<int>").withColumn("row", F.monotonically_increasing_id())
    part = saved(part, "known", folder)
    removed(spark, f"{folder}/frequencies")
    rest = part.where(F.size("pieces") > 0).select("row", F.explode(F.arrays_zip("pieces", "times")).alias("p")).select("row", F.col("p.pieces").alias("piece"), F.col("p.times").alias("f"))
    met = salted_join(rest, table.where(F.col("n") < least).select("piece", F.col("n").alias("rows"), "tokens"), "piece", F.col("rows") >= OFTEN, F.xxhash64("row"))
    tokens = F.coalesce("tokens", F.raise_error(F.lit("a pre-token has no count")).cast("long"))
    more = met.groupBy("row").agg(F.sum(F.col("f") * tokens).alias("more"))
    total = F.col("n") + F.coalesce("more", F.lit(0).cast("long"))
    return part.select("row", "doc_id", "n_bytes", "n").join(more, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
