"""Exact top-k inner products through bounds from multi-resolution segment statistics.

|q - c|^2 is at least the sum over segments of len * ((mean_q - mean_c)^2 + (dev_q - dev_c)^2), so the inner product
(|q|^2 + |c|^2 - |q - c|^2) / 2 is bounded above. With few segments first and more for what survives, pairs whose bound is
below the query's k-th best so far are dropped, and the rest get their exact integer score.

Candidates stay where they are. Queries come to them in blocks of a bounded number of bytes, by broadcast, with the k-th
best score that each query has so far. Candidates are taken in rounds, each several times as many as all before it, so
a round finds only some k new ones a query, and what is shuffled grows with the queries, not with queries times candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.llm.common import saved, work_dir

LEVELS = (1, 4, 16)  # segments
QUERY_BYTES = 16 << 20  # of a block of queries
FIRST, GROWTH = 16384, 4  # candidates of the first round; how many times as many a round reaches than the one before
SIDE = 1024  # queries and candidates that meet at once
SAFE = 1 << 20  # components beyond it are scored with unbounded integers


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(length) * (means, deviations) of each row's segments."""
    dim = x.shape[1]
    cuts = np.unique(np.linspace(0, dim, min(segments, dim) + 1).astype(int))
    size = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], 1)
    square = np.add.reduceat(x * x, cuts[:-1], 1)
    mean = total / size
    return mean * np.sqrt(size), np.sqrt(np.maximum(square - mean * mean * size, 0))


def profile(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level (what a row adds to a bound by itself, the vector whose inner product with another row's is the rest)."""
    norm = (x * x).sum(1)
    out = []
    for s in LEVELS:
        f = np.concatenate(statistics(x, s), 1)
        out.append(((norm - (f * f).sum(1)) / 2 + 1e-9 * norm + 1e-6, f))
    return out


def best_in_block(q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best of each query that reach its `least`, ties to the smaller id.

    Integers held in doubles."""
    order = np.argsort(c_id, kind="stable")
    c, c_id = c[order], c_id[order]
    least = np.full(len(q), -np.inf) if least is None else least
    rows_out, cols_out, scores_out = [], [], []
    of_c = profile(c)
    for qa in range(0, len(q), SIDE):
        qs, ids = q[qa : qa + SIDE], q_id[qa : qa + SIDE]
        of_q = profile(qs)
        own, bar = least[qa : qa + SIDE].copy(), least[qa : qa + SIDE].copy()  # bar: reached; a tie with it needs a smaller id
        score_at, place_at, row_at = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for ca in range(0, len(c), SIDE):
            r, s = np.arange(len(qs)), np.arange(ca, min(ca + SIDE, len(c)))
            alive = ids[:, None] != c_id[None, s]
            for (ql, qf), (cl, cf) in zip(of_q, of_c, strict=True):
                alive &= ql[r, None] + cl[None, s] + qf[r] @ cf[s].T >= bar[r, None]
                keep_r, keep_s = alive.any(1), alive.any(0)
                r, s, alive = r[keep_r], s[keep_s], alive[keep_r][:, keep_s]
                if not len(r):
                    break
            if not len(r):
                continue
            if alive.mean() < 0.1:
                i, j = np.nonzero(alive)
                exact = np.concatenate([np.einsum("ij,ij->i", qs[r[i[b : b + 65536]]], c[s[j[b : b + 65536]]]) for b in range(0, len(i), 65536)])
                take = exact >= bar[r[i]]
                i, j, exact = i[take], j[take], exact[take]
            else:
                dense = np.where(alive, qs[r] @ c[s].T, -np.inf)
                cut = np.partition(dense, -k, 1)[:, -k] if dense.shape[1] > k else np.full(len(r), -np.inf)
                i, j = np.nonzero((dense >= np.maximum(cut, bar[r])[:, None]) & alive)
                exact = dense[i, j]
            row_at, place_at, score_at = np.concatenate([row_at, r[i]]), np.concatenate([place_at, s[j]]), np.concatenate([score_at, exact])
            by = np.lexsort((place_at, -score_at, row_at))
            row_at, place_at, score_at = row_at[by], place_at[by], score_at[by]
            rank = np.arange(len(row_at)) - np.searchsorted(row_at, row_at)
            keep = rank < k
            row_at, place_at, score_at, rank = row_at[keep], place_at[keep], score_at[keep], rank[keep]
            full = rank == k - 1
            bar[row_at[full]] = np.maximum(own[row_at[full]], score_at[full])
        rows_out.append(row_at + qa)
        cols_out.append(order[place_at])
        scores_out.append(score_at)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(rows_out, np.int64), cat(cols_out, np.int64), cat(scores_out, float)


def wide_in_block(q: list, q_id: np.ndarray, c: list, c_id: np.ndarray, k: int) -> tuple[list, list, list]:
    rows, cols, scores = [], [], []
    for i, x in enumerate(q):
        found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), int(c_id[j]), j) for j, y in enumerate(c) if c_id[j] != q_id[i])[:k]
        rows += [i] * len(found)
        cols += [f[2] for f in found]
        scores += [max(-(1 << 63), min((1 << 63) - 1, -f[0])) for f in found]
    return rows, cols, scores


def matched(q: dict[int, tuple], c_dim: np.ndarray, c_id: np.ndarray, c: list[np.ndarray], k: int) -> list[tuple]:
    """[(query numbers, candidate ids, scores)] of candidates against the queries of their length. q: by length (numbers,
    ids, matrix, least scores)."""
    out = []
    for dim in np.unique(c_dim).tolist():
        if dim not in q:
            continue
        number, q_id, qm, least = q[dim]
        on = np.flatnonzero(c_dim == dim)
        cm = np.stack([c[j] for j in on]) if dim else np.zeros((len(on), 0))
        limit = min(SAFE, (1 << 26) // max(1, dim) ** 0.5)
        wide_q, wide_c = (np.abs(qm) > limit).any(1), (np.abs(cm) > limit).any(1)
        for wq, wc in ((False, False), (False, True), (True, False), (True, True)):
            i, j = np.flatnonzero(wide_q == wq), np.flatnonzero(wide_c == wc)
            if len(i) and len(j):
                if wq or wc or not dim:
                    ints = lambda m: [[int(x) for x in r] for r in m]
                    a, b, s = wide_in_block(ints(qm[i]), q_id[i], ints(cm[j]), c_id[on[j]], k)
                else:
                    a, b, s = best_in_block(qm[i], q_id[i], cm[j], c_id[on[j]], k, least[i])
                out.append((number[i[np.asarray(a, int)]], c_id[on[j[np.asarray(b, int)]]], np.asarray(s).astype(np.int64)))
    return out


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query row.

    queries: a condition on id_col. Components become floor(scale * x). Null vectors, vectors with a null or non-finite
    component and rows with a null id take no part. A query meets only vectors of its length, and none with its own id;
    repeated rows of other ids each count, and a repeated query row gives its rows again. Ties go to the smaller id.
    Scores beyond a long are held at its ends. Empty tables give an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    folder = work_dir(spark)
    whole = F.transform(F.col("v"), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("query"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite).select("vec_id", "query", F.size("v").alias("dim"), whole.alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = saved(rows.withColumn("lot", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 30).cast("long"))), "vectors", folder)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("query"), 8 * F.col("dim") + 64)), F.lit(0))).first()
    blocks = max(1, -(-size // QUERY_BYTES))
    ends, reach = [], FIRST
    while reach < n:
        ends.append(int((1 << 30) * reach / n))
        reach *= GROWTH
    ends.append(1 << 30)
    parts = []
    for block in range(blocks):
        mine = rows.where(F.col("query") & (F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks).cast("long")) == block)).select("row", "vec_id", "dim", "v").toArrow()  # QUERY_BYTES, about
        number, ids, dims = (mine[c].to_numpy() for c in ("row", "vec_id", "dim"))
        flat, cuts = mine["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(dims))
        least = np.full(len(number), -np.inf)
        found = None
        for turn, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            by_dim = {}
            for dim in np.unique(dims).tolist():
                on = np.flatnonzero(dims == dim)
                by_dim[dim] = (number[on], ids[on], flat[(cuts[on][:, None] + np.arange(dim)).ravel()].reshape(len(on), dim), least[on])
            shared = spark.sparkContext.broadcast(by_dim)

            def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                kept: list[pa.Table] = []

                def best(tables: list[pa.Table]) -> pa.Table:
                    t = pa.concat_tables(tables)
                    row, vec, score = (t[c].to_numpy() for c in ("row", "vec_id", "score"))
                    by = np.lexsort((vec, -score, row))
                    rank = np.arange(len(by)) - np.searchsorted(row[by], row[by])
                    return t.take(pa.array(by[rank < k]))

                held, count = [], 0
                for batch in batches:
                    held.append(batch)
                    count += len(batch)
                    if count >= 8 * SIDE:
                        kept, held, count = [best([*kept, *_met(held, shared.value, k)])], [], 0
                if held:
                    kept = [best([*kept, *_met(held, shared.value, k)])]
                for t in kept:
                    yield from t.to_batches()

            near = rows.where((F.col("lot") >= a) & (F.col("lot") < b)).select("vec_id", "dim", "v").mapInArrow(scan, "row long, vec_id long, score long")
            near = near if found is None else near.unionByName(found)
            rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
            found = saved(near.withColumn("rank", rank).where(F.col("rank") <= k).select("row", "vec_id", "score", "rank"), f"found-{block}-{turn}", folder)
            if b < 1 << 30:
                kth = found.where(F.col("rank") == k).select("row", "score").toArrow()  # one a query of the block
                at = {r: s for r, s in zip(kth["row"].to_pylist(), kth["score"].to_pylist(), strict=True)}
                least = np.array([at.get(r, -np.inf) for r in number.tolist()], float)
                found = found.drop("rank")
        parts.append(found.join(rows.where("query").select("row", F.col("vec_id").alias("query_id")), "row"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", "rank", "vec_id", "score")


def _met(batches: list[pa.RecordBatch], queries: dict[int, tuple], k: int) -> list[pa.Table]:
    t = pa.Table.from_batches(batches)
    dims = t["dim"].to_numpy()
    flat, cuts = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(dims))
    vectors = [flat[cuts[j] : cuts[j + 1]] for j in range(len(dims))]
    found = matched(queries, dims, t["vec_id"].to_numpy(), vectors, k)
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("row", "vec_id", "score")})
    return [empty, *(pa.table({"row": a, "vec_id": b, "score": s}) for a, b, s in found)]
