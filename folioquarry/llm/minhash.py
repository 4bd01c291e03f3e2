"""Near-duplicate groups by a signature-coordinate inverted join, each link confirmed on full shingle sets.

A text's set: its distinct word shingles. Rows with equal sets form one node. Each node has K minima; it is posted under
each (coordinate, value). A pair that agrees in at least MATCHES coordinates agrees in one of the K - MATCHES + 1 rarest
coordinates of either node (rarest over all nodes), so only that prefix is posted; the common values beyond it are
skipped over and only counted, from the signatures, for pairs that the prefix has brought up. Pairs with enough
collisions are confirmed on the full sets. Two nodes at the threshold of 0.75 agree in fewer than 27 of 64 coordinates
with a probability under 1e-6.

Groups need no pair more than connects them: in two rounds each posting list links its members to one of them, and
after each round only lists that still span several components stay. What these hold across components is compared
last, but for pairs that counts of shared shingles rule out exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.common import M1, M2, components, fmix, saved, small_batches, views, words, work_dir

WORDS, K, MATCHES = 5, 64, 27
BLOCK = 512  # members of a posting list that meet at once
OFTEN, LONG = 64, 32  # see across(): they weigh work against memory and don't change what is found
_seeds = fmix(np.arange(1, 2 * K + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
FACTORS = (_seeds[:K] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
TERMS = (_seeds[K:] >> np.uint64(32)).astype(np.uint32)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct hashed n-word shingles of each row, sorted; the whole sequence as one for shorter rows."""
    mult = np.uint64(M1)
    full = np.zeros(0, np.uint64)
    if len(hashes) >= n:
        full = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            full = full * mult + hashes[k : len(hashes) - n + 1 + k]
        full = fmix(full)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(full[a : b - n + 1])
        elif b == a:
            yield np.zeros(0, np.uint64)
        else:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in hashes[a:b]:
                    h = h * np.uint64(M2) + x
            yield fmix(np.array([h]))


def minima(values: np.ndarray) -> np.ndarray:
    small = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(small), 2048):
        out = np.minimum(out, (FACTORS[:, None] * small[None, a : a + 2048] + TERMS[:, None]).min(1))
    return out.view(np.int32)


def name_of(values: np.ndarray) -> bytes | None:
    """A 128-bit digest of a set, so that equal names mean equal sets."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in views(batch.column(1)):
            hashes, _, first = words(data, offsets)
            n, name, sig = [], [], []
            for s in shingles(hashes, first):
                n.append(len(s))
                name.append(name_of(s))
                sig.append(minima(s) if len(s) else None)
            cols = [batch.column(k)[lo:hi] for k in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], names=["doc_id", "key", "mark", "n_shingles", "name", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in views(batch.column(2)):
            hashes, _, first = words(data, offsets)
            found = list(shingles(hashes, first))
            same = pc.equal(pa.array([name_of(s) for s in found], pa.binary()), batch.column(1)[lo:hi])
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], same, pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["node", "same", "shingles"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id of the group), kept.

    Null or blank texts have no shingles and stand alone. Equal sets are one node, so copies are never paired. A null
    doc_id takes part and is never smallest unless its group has no other id; its kept is true then for all its rows.
    Repeated (doc_id, text) rows each get a row. An empty table gives an empty result. Other columns are not read.
    """
    scan, of = grouped(docs, id_col, text_col)
    full = scan.where("n_shingles > 0").join(of, "name").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    alone = scan.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_keys(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key_col numbers the rows of docs. Returns (key) of one row of each group: the smallest doc_id, nulls last, then the
    smallest key. Null or blank texts stand alone, so each such row is there."""
    scan, of = grouped(docs, id_col, text_col, key_col)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    one = scan.where("n_shingles > 0").join(of, "name").groupBy("component").agg(F.min(order).alias("row")).select("row.key")
    return one.union(scan.where("n_shingles = 0").select("key"))


def grouped(docs: DataFrame, id_col: str, text_col: str, key_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row per row of docs: doc_id, key, n_shingles, name of its set and signature; a row per set: its component and the
    component's least doc_id). A node is the number of a set in a written table."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(key_col) if key_col else F.lit(0)).cast("long").alias("key"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scan = saved(rows.mapInArrow(_scan, f"doc_id {kind}, key long, mark long, n_shingles long, name binary, sig array<int>"), "scan", folder)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("least")
    nodes = scan.where("n_shingles > 0").groupBy("name").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), least)
    nodes = nodes.select("name", "sig", "n", F.col("least.doc_id").alias("rep"), F.col("least.mark").alias("rep_mark"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", folder)

    posts = nodes.select("node", F.posexplode("sig").alias("at", "value")).select(F.xxhash64("at", "value").alias("key"), "node")
    common = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    ranked = posts.join(common, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("l"))  # at most K each
    kept = ranked.select("node", F.size("l").alias("common"), F.explode(F.slice("l", F.lit(1), F.greatest(F.lit(0), F.size("l") - F.lit(MATCHES - 1)))).alias("p"))
    lists = saved(kept.select("node", "common", F.col("p.key").alias("key")), "lists", folder)

    # The full sets of posted nodes: the texts are moved once, whatever the number of nodes.
    posted = lists.select("node").distinct().join(nodes, "node").select("node", "name", "rep", "rep_mark")
    sets = saved(sets_of(posted.hint("merge"), rows), "sets", folder)

    links = None
    own = nodes.select("node", "name", "n", "rep")
    label = own.withColumn("component", F.col("node"))
    tested = None
    for turn in (1, 2, 3):
        members = lists.join(label.drop("name"), "node")
        # First the member that has most in common with others, then another one for each third of the lists.
        first = (-F.col("common")).cast("long") if turn == 1 else F.xxhash64("node", F.pmod("key", F.lit(3)))
        order = F.struct(first.alias("first"), F.xxhash64("node").alias("h"), F.col("node").alias("node"), F.col("component").alias("component"), F.col("n").alias("n"))
        split = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(order).alias("head")).where("lo <> hi")
        if turn < 3:
            pairs = members.join(split, "key").where("component <> head.component and 100 * least(n, head.n) >= 75 * greatest(n, head.n)").select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))
        else:
            pairs = across(saved(members.join(split.select("key"), "key", "left_semi"), "rest", folder), sets, folder)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = saved(pairs, f"pairs-{turn}", folder)
        found = saved(confirmed(pairs, nodes, sets, f"{folder}/{turn}"), f"links-{turn}", folder)
        tested = pairs if tested is None else tested.union(pairs)
        if turn > 1 and found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        groups = components(links, folder, f"cc-{turn}")
        label = saved(own.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), f"label-{turn}", folder)

    least = label.groupBy("component").agg(F.min("rep").alias("least"))
    return scan, label.join(least, "component").select("name", "component", "least")


def sets_of(want: DataFrame, rows: DataFrame) -> DataFrame:
    """want: (node, name; rep and rep_mark: doc_id and text's hash of a row that has the set). Returns (node, shingles).

    Texts meet the sets of their own id and hash, so that different texts under one id (null is one) aren't multiplied; equal
    texts under one id have one set."""
    texts = rows.join(want, rows.doc_id.eqNullSafe(want.rep) & (rows.mark == want.rep_mark)).select("node", "name", "text")
    return texts.mapInArrow(_sets, "node long, same boolean, shingles array<long>").where("same").select("node", "shingles").dropDuplicates(["node"])


def across(rest: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Pairs (a, b) of different components in one posting list of rest (key, node, n, rep, component).

    A node shares with any other only those of its m shingles that another node of rest has too. Two sets thus have at
    most min(m) in common, which rules out, exactly, pairs that can't reach the threshold, and nodes that can't with any.
    In lists of LONG nodes and more the bound is closer: of shingles that OFTEN nodes or more have, two sets share at most
    what the one with fewer of these holds, and the others, few as they are, are compared as they stand.
    """
    each = sets.join(rest.select("node").distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    often = F.col("c") >= OFTEN
    of = each.join(shared, "s").groupBy("node").agg(F.count("*").alias("m"), F.count(F.when(often, 1)).alias("h"), F.collect_list(F.when(~often, F.col("s"))).alias("few"))  # a node's own set at most
    of = saved(of, "shared", folder)
    left = rest.join(of.select("node", "m", "h"), "node").where("100 * m >= 75 * n").select("key", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("h").alias("ha"))
    left = saved(left, "open", folder)
    keys = left.groupBy("a").agg(F.sort_array(F.collect_list("key")).alias("keys_a"))  # at most K each
    keys = keys.join(of.select(F.col("node").alias("a"), "few"), "a")
    long = left.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") >= LONG)
    left = left.join(long, "key", "left").join(keys, "a").withColumn("few_a", F.when(F.col("size").isNotNull(), F.col("few"))).drop("few")
    # The members of a long list are dealt into blocks; each pair of blocks meets by itself, so no task holds a long list.
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce("size", F.lit(1)) / BLOCK))
    left = saved(left.withColumns({"last": blocks - 1, "block": F.pmod(F.xxhash64("a"), blocks)}).drop("size"), "left", folder)
    right = left.select("key", "last", "block", *[F.col(f"{c}a").alias(f"{c}b") for c in ("", "c", "n", "m", "h", "keys_", "few_")])
    right = right.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"))
    left = left.select("*", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"))
    can = F.expr("(l.i < l.j or a < b) and ca <> cb and 175 * least(ma, mb) >= 75 * (na + nb) and 100 * least(na, nb) >= 75 * greatest(na, nb)")
    can = can & (F.col("l.key") == F.array_min(F.array_intersect("keys_a", "keys_b")))  # once, where the two meet first
    can = can & F.expr("few_a is null or few_b is null or 175 * (least(ha, hb) + size(array_intersect(few_a, few_b))) >= 75 * (na + nb)")
    met = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j")) & can)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """The pairs (a, b) with MATCHES collisions at least whose full sets reach the threshold."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}"))
    hits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(hits >= MATCHES).select("a", "b")
    likely = saved(likely, "likely", folder)
    both = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.where(100 * same >= 75 * (F.size("x") + F.size("y") - same)).select("a", "b")
