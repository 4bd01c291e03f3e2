"""Language-model scores: a word-unigram base and a causal self-attention model on subword ids, trained in numpy.

Base. Words of training rows are counted per task before the counts are shuffled. The most frequent ones, at most
FREQUENT of them by a threshold read off a histogram, are broadcast; the rest are joined by a shuffle of per-row counts.

Model. P(id | past) = P(class | past) * P(id | class, past). Classes have about equal mass of training ids, and a binary
tree over the ids of each (Huffman's, of their counts) gives P(id | class, past) as a product of branches. A self-attention
layer over vectors of the last CONTEXT ids at least, one for each id, gives both; before training they are the counts'.
Training rows are dealt into shards by their hash; a copy of the model is trained on every window of each shard's rows, and
the copies are averaged, vectors of ids and branches by how often each was trained. Scoring cuts a text into windows that
overlap by the context, and scores each id, and the end, once.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.common import saved, small_batches, views, words, work_dir
from folioquarry.llm.packing import id_bytes

FREQUENT = 1 << 19
CLASSES, DIM, CONTEXT, STRIDE, RATE, ROW_RATE = 64, 8, 16, 16, 0.01, 0.1
BATCH = 128  # windows of a training step at least, fewer than twice as many at most
SHARD = 1 << 21  # ids of training rows that one copy of the model is trained on, about
FINE = 1 << 20  # averages are sums of whole numbers, so that they don't depend on the order of summing
WINDOW = CONTEXT + STRIDE
PAD = CLASSES
SLOT_BITS = 21  # of a word's hash, by which the broadcast words are found
END_WORD = np.uint64(0x5BD1E9955BD1E995)  # stands for the end among word hashes
SHAPES = [("E", (CLASSES + 1, DIM)), ("P", (WINDOW, DIM)), ("Q", (DIM, DIM)), ("K", (DIM, DIM)), ("V", (DIM, DIM)), ("O", (DIM, DIM)), ("W", (DIM, CLASSES)), ("b", (CLASSES,))]


def held_out(ids: list) -> list[bool]:
    """Of row ids; a null id has the empty text."""
    return [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids]


# The model


def initial(prior: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    out = {k: (rng.standard_normal(shape) * 0.3).astype(np.float32) for k, shape in SHAPES}
    out["b"] = np.where(prior > 0, np.log(np.maximum(prior, 1e-30)), -1e9).astype(np.float32)
    out["W"] *= 0.1
    return out


MASK = np.where(np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None], 0, -1e9).astype(np.float32)


def forward(p: dict[str, np.ndarray], x_class: np.ndarray) -> tuple[np.ndarray, tuple]:
    """log P(class) after each of a window's last STRIDE inputs; what backward() needs."""
    x = p["E"][x_class] + p["P"]
    top = x[:, CONTEXT:]
    q, k, v = top @ (p["Q"] / np.float32(DIM**0.5)), x @ p["K"], x @ p["V"]
    a = np.clip(q @ k.transpose(0, 2, 1), -60, 60) + MASK
    a = np.exp(a - a.max(2, keepdims=True))
    a /= a.sum(2, keepdims=True)
    mixed = a @ v
    h = np.tanh(mixed @ p["O"] + top)
    z = np.minimum(h @ p["W"] + p["b"], 60)
    z -= z.max(2, keepdims=True)
    z -= np.log(np.exp(z).sum(2, keepdims=True))
    return z, (x_class, x, top, q, k, v, a, mixed, h)


def backward(p: dict[str, np.ndarray], logp: np.ndarray, seen: tuple, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient of the weighted mean of -log P(target)."""
    g, dx = gradients(p, logp, seen, target, weight)
    at = seen[0].ravel()
    return g | {"E": np.stack([np.bincount(at, dx[..., d].ravel(), len(p["E"])) for d in range(DIM)], 1).astype(dx.dtype)}


def gradients(p: dict[str, np.ndarray], logp: np.ndarray, seen: tuple, target: np.ndarray, weight: np.ndarray, dh: np.ndarray | float = 0) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """backward() but for E, and the gradient of the inputs' vectors. dh: what else is lost by h."""
    x_class, x, top, q, k, v, a, mixed, h = seen
    dz = np.exp(logp)
    np.put_along_axis(dz, target[..., None], np.take_along_axis(dz, target[..., None], 2) - 1, 2)
    dz *= (weight / max(weight.sum(), 1))[..., None]
    flat = lambda m: m.reshape(-1, m.shape[-1])
    g = {"W": flat(h).T @ flat(dz), "b": flat(dz).sum(0)}
    ds = (dz @ p["W"].T + dh) * (1 - h * h)
    g["O"] = flat(mixed).T @ flat(ds)
    dmixed = ds @ p["O"].T
    da, dv = dmixed @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dmixed
    da = a * (da - (da * a).sum(2, keepdims=True))
    dq, dk = da @ k, da.transpose(0, 2, 1) @ q
    scale = np.float32(DIM**0.5)
    g["Q"] = flat(top).T @ flat(dq) / scale
    g["K"], g["V"] = flat(x).T @ flat(dk), flat(x).T @ flat(dv)
    dx = dk @ p["K"].T + dv @ p["V"].T
    dx[:, CONTEXT:] += ds + dq @ p["Q"].T / scale
    g["P"] = dx.sum(0)
    return g, dx


def windows(ids: np.ndarray, class_of: np.ndarray, end: int, pad: int = PAD) -> tuple[np.ndarray, np.ndarray]:
    """(input classes, target ids with -1 where there is none) of windows in which each id and the end is a target once."""
    n = len(ids) + 1
    count = -(-n // STRIDE)
    past = np.full(count * STRIDE + CONTEXT, pad, np.int64)
    past[CONTEXT] = class_of[end]
    past[CONTEXT + 1 : CONTEXT + n] = class_of[ids]
    target = np.full(count * STRIDE, -1, np.int64)
    target[: n - 1], target[n - 1] = ids, end
    return np.lib.stride_tricks.sliding_window_view(past, WINDOW)[::STRIDE], target.reshape(count, STRIDE)


def batched(rows: Iterable[np.ndarray], vocabulary: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All windows of all rows, each once; a long row is dealt over several batches."""
    xs, ts, n, each = [], [], 0, np.arange(vocabulary)
    for ids in rows:
        x, t = windows(ids, each, end, vocabulary)
        for a in range(0, len(x), BATCH):
            xs.append(x[a : a + BATCH])
            ts.append(t[a : a + BATCH])
            n += len(xs[-1])
            if n >= BATCH:
                yield np.concatenate(xs), np.concatenate(ts)
                xs, ts, n = [], [], 0
    if n:
        yield np.concatenate(xs), np.concatenate(ts)


def whole(prior: np.ndarray, class_of: np.ndarray, tree: tuple) -> dict[str, np.ndarray]:
    """The model before training: ids of one class have one vector, branches follow the counts."""
    p = initial(prior)
    return p | {"E": p["E"][np.append(class_of, PAD)], "U": np.concatenate([np.zeros((len(tree[3]), DIM)), tree[3][:, None]], 1).astype(np.float32)}


def grown(counts: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman tree over the ids of each class: (each id's first entry and the end, node and side of each entry, log odds
    of the nodes by counts, each raised by one)."""
    n = len(counts)
    parent, side, odds = np.full(2 * n, -1), np.zeros(2 * n, np.float32), []
    for k in range(CLASSES):
        heap = [(float(counts[i]) + 1, i) for i in np.flatnonzero(class_of == k).tolist()]
        heapq.heapify(heap)
        while len(heap) > 1:
            (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
            node = n + len(odds)
            parent[[a, b]], side[a], side[b] = node, -1, 1
            odds.append(np.log(wb / wa))
            heapq.heappush(heap, (wa + wb, node))
    ids, at, entries = np.arange(n), np.arange(n), []
    while len(ids):
        live = parent[at] >= 0
        ids, at = ids[live], at[live]
        entries.append((ids, parent[at] - n, side[at]))
        at = parent[at]
    of, node, way = (np.concatenate(x) for x in zip(*entries, strict=True))
    order = np.argsort(of, kind="stable")
    return np.append(0, np.cumsum(np.bincount(of, minlength=n))), node[order], way[order], np.array(odds, np.float32)


def branches(tree: tuple, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ids, node, side) of each branch on the way to each id."""
    first, node, way, _ = tree
    start = first.take(ids)
    n = first.take(ids + 1) - start
    of = np.repeat(np.arange(len(ids)), n)
    entry = np.repeat(start - np.cumsum(n) + n, n)
    entry += np.arange(len(of))
    return of, node.take(entry), way.take(entry)


def within_class(u: np.ndarray, h: np.ndarray, of: np.ndarray, node: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log P of each branch, the gradient of its sum's negative by u and by h, both a row a branch)."""
    hs, us = h[of], u[node]
    s = np.clip(way * ((hs * us[:, :DIM]).sum(1) + us[:, DIM]), -60, 60)
    e = np.exp(-s)
    d = (-way * e / (1 + e))[:, None]
    return -np.log1p(e), np.concatenate([d * hs, d], 1), d * us[:, :DIM]


def summed_at(at: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows of g at each of `size` places; numpy sums a column at a time faster than short rows."""
    out = np.empty((size, g.shape[1]), np.float32)
    for k, column in enumerate(g.T.astype(float, order="C")):
        out[:, k] = np.bincount(at, column, size)
    return out


def summed_rows(at: np.ndarray, g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct places, below size, the sum of g at each, how often it stands there)."""
    each = np.arange(len(at))
    last = np.empty(size, np.int64)
    last[at] = each
    rows = at[last.take(at) == each]
    last[rows] = np.arange(len(rows))
    rank = last.take(at)
    return rows, summed_at(rank, g, len(rows)), np.bincount(rank, minlength=len(rows))


def learned(p: dict[str, np.ndarray], x: np.ndarray, target: np.ndarray, class_of: np.ndarray, tree: tuple) -> tuple[dict[str, np.ndarray], list[tuple[str, np.ndarray, np.ndarray]], int]:
    """(gradients of the mean loss by what isn't looked up; (table, places, rows of gradients of the summed loss); targets).

    What forward(), gradients() and within_class() give, in fewer passes over what doesn't fit a cache: attention and classes
    stay unnormalised, and their sums are divided out of what has DIM columns."""
    n, t = len(x), target.ravel()
    live = np.flatnonzero(t >= 0)
    total, root = np.float32(max(len(live), 1)), np.float32(DIM**0.5)
    ids = x.ravel()
    x3 = p["E"].take(ids, axis=0).reshape(n, WINDOW, DIM)
    x3 += p["P"]
    flat, top = x3.reshape(-1, DIM), x3[:, CONTEXT:].reshape(-1, DIM)
    query = p["Q"] / root
    q, k, v = ((m @ w).reshape(n, -1, DIM) for m, w in ((top, query), (flat, p["K"]), (flat, p["V"])))
    e = attention(q, k)
    over = 1 / (e @ np.ones(WINDOW, np.float32))[..., None]
    mixed = ((e @ v) * over).reshape(-1, DIM)
    h1 = np.ones((len(top), DIM + 1), np.float32)
    h = np.tanh(mixed @ p["O"] + top, out=h1[:, :DIM])
    z = class_weights(p, h1)
    sums = z @ ONES
    weight = (t >= 0) / (total * sums)  # a row without a target weighs nothing
    own = class_of.take(np.maximum(t, 0))
    dh = z @ p["W"].T
    dh *= weight[:, None]
    dh -= p["W"].T.take(own, axis=0) * ((t >= 0) / total)[:, None]
    z.ravel()[np.arange(0, z.size, CLASSES) + own] -= sums
    by = z.T @ (h1 * weight[:, None])
    g = {"W": by[:, :DIM].T, "b": by[:, DIM]}
    of, node, way = branches(tree, t[live])
    changes = []
    if len(of):
        at = live.take(of)
        hs, us = h1.take(at, axis=0), p["U"].take(node, axis=0)
        s = np.einsum("ij,ij->i", hs, us)
        s *= way
        d = -way / (1 + np.exp(np.clip(s, -60, 60, out=s)))
        hs *= d[:, None]
        us *= (d / total)[:, None]
        dh += summed_at(at, us[:, :DIM], len(dh))
        changes.append(("U", node, hs))
    ds = dh * (1 - h * h)
    g["O"] = mixed.T @ ds
    dm = ds @ p["O"].T
    both = np.einsum("ij,ij->i", dm, mixed).reshape(n, STRIDE, 1) * over
    dm = dm.reshape(n, STRIDE, DIM) * over
    dv = (e.transpose(0, 2, 1) @ dm).reshape(-1, DIM)
    da = dm @ v.transpose(0, 2, 1)
    da -= both
    da *= e
    dq, dk = (da @ k).reshape(-1, DIM), (da.transpose(0, 2, 1) @ q).reshape(-1, DIM)
    g["Q"] = top.T @ dq / root
    g["K"], g["V"] = flat.T @ dk, flat.T @ dv
    dx = dk @ p["K"].T
    dx += dv @ p["V"].T
    dx = dx.reshape(n, WINDOW, DIM)
    dx[:, CONTEXT:] += (ds + dq @ query.T).reshape(n, STRIDE, DIM)
    g["P"] = (np.ones(n, np.float32) @ dx.reshape(n, -1)).reshape(WINDOW, DIM)
    dx *= total
    changes.append(("E", ids, dx.reshape(-1, DIM)))
    return g, changes, len(live)


def attention(q: np.ndarray, k: np.ndarray) -> np.ndarray:
    """exp of the products, 0 where a place comes later. Exponents end at 60, which they seldom reach."""
    e = q @ k.transpose(0, 2, 1)
    if max(e.max(initial=0), -e.min(initial=0)) > 60:
        np.clip(e, -60, 60, out=e)
    np.exp(e, out=e)
    e *= OPEN
    return e


def class_weights(p: dict[str, np.ndarray], h1: np.ndarray) -> np.ndarray:
    """P(class) but for a factor a row. h1: h, which lies in -1 to 1, and a column of ones. Exponents end at 60; as h is
    bounded, the weights say whether any can be over it."""
    z = h1 @ np.concatenate([p["W"], p["b"][None]])
    if (np.abs(p["W"]).sum(0) + p["b"]).max() > 60:
        np.minimum(z, 60, out=z)
    return np.exp(z, out=z)


def train(p: dict[str, np.ndarray], batches: Iterator[tuple[np.ndarray, np.ndarray]], class_of: np.ndarray, tree: tuple, often: dict[str, np.ndarray]) -> int:
    """Adam on p, but Adagrad on the rows of E and U, of which a batch has few; the number of targets seen.

    often: what counts how often each row of E and U was trained."""
    dense = [k for k, _ in SHAPES if k != "E"]
    flat = np.concatenate([p[k].ravel() for k in dense])
    cuts = np.cumsum([p[k].size for k in dense])[:-1]
    p.update((k, part.reshape(p[k].shape)) for k, part in zip(dense, np.split(flat, cuts), strict=True))  # views of flat
    m1, m2, t, seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0
    squares = {k: np.ones_like(p[k]) for k in "EU"}
    for x, target in batches:
        g, changes, n = learned(p, x, target, class_of, tree)
        t += 1
        seen += n
        step = np.concatenate([g[k].ravel() for k in dense])
        m1 += 0.1 * (step - m1)
        m2 += 0.01 * (step * step - m2)
        flat -= np.float32(RATE / (1 - 0.9**t)) * m1 / (np.sqrt(m2 / np.float32(1 - 0.99**t)) + np.float32(1e-8))
        for k, at, d in changes:
            rows, sums, n = summed_rows(at, d, len(p[k]))
            now = squares[k].take(rows, axis=0) + sums * sums
            squares[k][rows] = now
            p[k][rows] -= np.float32(ROW_RATE) * sums / np.sqrt(now)
            often[k][rows] += n
    return seen


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each id, log10 P(id | class), P(class)) from counts of ids, each raised by one."""
    c = counts.astype(float) + 1
    order = np.argsort(-c, kind="stable")
    class_of = np.empty(len(c), np.int64)
    mass = np.cumsum(c[order]) - c[order] / 2
    class_of[order] = np.minimum((mass / c.sum() * CLASSES).astype(np.int64), CLASSES - 1)
    total = np.bincount(class_of, c, CLASSES)
    return class_of, np.log10(c / total[class_of]), total / total.sum()  # a class without ids has no mass


def target_logs(p: dict[str, np.ndarray], x_class: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What forward() says of the targets' classes, and its h, with fewer passes over what doesn't fit a cache."""
    n = len(x_class)
    x = p["E"].take(x_class.ravel(), axis=0).reshape(n, WINDOW, DIM)
    x += p["P"]
    rows, top = x.reshape(-1, DIM), x[:, CONTEXT:].reshape(-1, DIM)
    q, k, v = ((m @ w).reshape(n, -1, DIM) for m, w in ((top, p["Q"] / np.float32(DIM**0.5)), (rows, p["K"]), (rows, p["V"])))
    a = attention(q, k)
    mixed = (a @ v) / (a @ np.ones(WINDOW, np.float32))[..., None]
    h1 = np.ones((len(top), DIM + 1), np.float32)
    h = np.tanh(mixed.reshape(-1, DIM) @ p["O"] + top, out=h1[:, :DIM])
    t = target.ravel()
    own = np.minimum(np.einsum("ij,ij->i", h, p["W"].T.take(t, axis=0)) + p["b"].take(t), 60)
    return (own - np.log(class_weights(p, h1) @ ONES)).reshape(target.shape), h


OPEN = (MASK == 0).astype(np.float32)
ONES = np.ones(CLASSES, np.float32)


def log_scores(p: dict[str, np.ndarray], rows: list[np.ndarray], class_of: np.ndarray, within: np.ndarray, end: int, tree: tuple | None = None) -> list[float]:
    """log10 of the model's probability of each row of ids. Without a tree, E is of classes and ids in them follow `within`."""
    given, pad = (class_of, PAD) if tree is None else (np.arange(len(class_of)), len(class_of))
    made = [windows(r, given, end, pad) for r in rows]
    if not made:
        return []
    # Steps of one shape, the last one filled up, so that what is said of a window doesn't depend on those beside it.
    count = sum(len(m[0]) for m in made)
    x = np.concatenate([*(m[0] for m in made), np.full((-count % 256, WINDOW), pad)])
    target = np.concatenate([*(m[1] for m in made), np.full((-count % 256, STRIDE), -1)])
    out = np.empty(len(x))
    for a in range(0, len(x), 256):
        t = target[a : a + 256].ravel()
        live = np.flatnonzero(t >= 0)
        ids, row = t[live], live // STRIDE
        own, h = target_logs(p, x[a : a + 256], class_of.take(np.maximum(t, 0)))
        logs = np.bincount(row, own.take(live), 256)
        if tree is None:
            logs += np.bincount(row, within.take(ids), 256) * np.log(10)
        else:
            of, node, way = branches(tree, ids)
            us = p["U"].take(node, axis=0)
            s = np.einsum("ij,ij->i", h.take(live.take(of), axis=0), us[:, :DIM])
            s += us[:, DIM]
            s *= -way
            logs -= np.bincount(row.take(of), np.log(1 + np.exp(np.clip(s, -60, 60, out=s), out=s)), 256)
        out[a : a + 256] = logs / np.log(10)
    cuts = np.cumsum([0, *(len(m[0]) for m in made)])
    return [float(out[a:b].sum()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


# The base


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    u, inverse = np.unique(k, return_inverse=True)
    return u, np.bincount(inverse, c, len(u)).astype(np.int64)


def first_places(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For the first SLOT_BITS bits of a hash the place in table of the hash with the largest value that has them, else -1."""
    out = np.full(1 << SLOT_BITS, -1, np.int32)
    order = np.argsort(values, kind="stable")
    out[(table >> np.uint64(64 - SLOT_BITS)).astype(np.int64)[order]] = order  # of equal ones, the last stays
    return out


def looked_up(table: np.ndarray, slots: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in table, which ascends, of each word; whether it is there). slots: from first_places(); only a word that isn't
    its slot's is looked for in the table."""
    at = slots.take((word >> np.uint64(64 - SLOT_BITS)).astype(np.int64)).astype(np.int64)
    hit = np.zeros(len(word), bool)
    some = np.flatnonzero(at >= 0)
    hit[some] = table.take(at.take(some)) == word.take(some)
    rest = some[~hit.take(some)]
    at[rest] = np.minimum(np.searchsorted(table, word.take(rest)), max(len(table) - 1, 0))
    hit[rest] = table.take(at.take(rest)) == word.take(rest) if len(rest) else False
    return at, hit


def scored(docs: DataFrame, path: str, end_id: int = 50257, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty and have the end alone. A null doc_id counts as the empty text for the fold. Repeated rows count
    as often as they stand there. end_id is a symbol of its own, beyond the vocabulary. The score is the same for any
    partitioning of docs, but for rounding below 1e-4: shards of training rows are dealt by rows' hashes and trained in the order of these. If no row is in training, N and V are 0 and no word is known: base_score is then null
    for the logarithm of 1/0 doesn't exist. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_dir(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for batch in batches:
            train_rows = ~np.array(held_out(batch.column(0).to_pylist()), bool)
            for lo, hi, data, offsets in views(batch.column(1)):
                hashes, _, first = words(data, offsets)
                of = np.repeat(train_rows[lo:hi], np.diff(first))
                n = int(train_rows[lo:hi].sum())
                u, c = np.unique(np.concatenate([hashes[of], np.full(n, END_WORD)]), return_counts=True)
                keys.append(u)
                counts.append(c)
                size += len(u)
                if size > 1_500_000:
                    u, c = _summed(keys, counts)
                    keys, counts, size = [u], [c], len(u)
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["word", "c"])
                        keys, counts, size = [], [], 0
        if keys:
            u, c = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["word", "c"])

    counts = saved(rows.mapInArrow(word_counts, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "words", folder)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    histogram = sorted(counts.groupBy(F.least("c", F.lit(1 << 14)).alias("c")).count().collect(), reverse=True)  # 1 << 14 rows at most
    least, held = (1 << 14) + 1, 0
    for c, n in histogram:
        if held + n > FREQUENT:
            break
        least, held = c, held + n
    if least > 1 << 14:  # all of them are too many: of words this frequent there are few for lack of mass
        least = max(1 << 14, total // FREQUENT + 1)
    top = counts.where(F.col("c") >= least).toPandas()  # at most FREQUENT rows
    hashes = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    frequent = spark.sparkContext.broadcast((hashes[order], top["c"].to_numpy()[order].astype(np.int64)))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A plain row for each row of docs, with what its frequent words sum to (its key in the place of a word, so that
        the join spreads these rows too); and a row for each of its other words."""
        table, values = frequent.value
        logs = np.log10(values + 1.0)
        slots = first_places(table, values)
        for batch in batches:
            for lo, hi, data, offsets in views(batch.column(1)):
                word, _, first = words(data, offsets)
                of = np.concatenate([np.repeat(np.arange(hi - lo), np.diff(first)), np.arange(hi - lo)])
                word = np.concatenate([word, np.full(hi - lo, END_WORD)])
                at, hit = looked_up(table, slots, word)
                sums = np.bincount(of[hit], logs[at[hit]], hi - lo) if hit.any() else np.zeros(hi - lo)
                n_known = np.bincount(of[hit], minlength=hi - lo)
                pair = np.stack([of[~hit], word[~hit].view(np.int64)])
                o = np.lexsort(pair[::-1])
                pair = pair[:, o]
                new = np.flatnonzero(np.concatenate([[True], (pair[:, 1:] != pair[:, :-1]).any(0)])[: pair.shape[1]])
                f = np.diff(np.append(new, pair.shape[1]))
                r = pair[0, new]
                m = len(r)
                base = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([base.column(0), base.column(0).take(pa.array(r))]),
                        pa.concat_arrays([base.column(2), base.column(2).take(pa.array(r))]),
                        pa.concat_arrays([base.column(2), pa.array(pair[1, new])]),
                        pa.array(np.concatenate([np.diff(first) + 1, f]).astype(np.int64)),
                        pa.array(np.concatenate([sums, np.zeros(m)])),
                        pa.array(np.concatenate([n_known, np.zeros(m)]).astype(np.int64)),
                        pa.array(np.arange(hi - lo + m) < hi - lo),
                    ],
                    names=["doc_id", "key", "word", "f", "sums", "n_known", "plain"],
                )

    each = keyed.mapInArrow(known, f"doc_id {kind}, key long, word long, f long, sums double, n_known long, plain boolean")
    both = each.join(counts.where(F.col("c") < least), "word", "left")
    c, plain = F.coalesce("c", F.lit(0)), F.col("plain")
    agg = both.groupBy("key", "doc_id").agg(
        F.sum(F.when(plain, F.col("sums")).otherwise(F.col("f") * F.log10(c + 1.0))).alias("sums"),
        F.sum(F.when(plain, F.col("n_known")).when(c > 0, F.col("f")).otherwise(0)).alias("n_known"),
        F.sum(plain.cast("long")).alias("n"),
        F.sum(F.when(plain, F.col("f")).otherwise(0)).alias("n_tokens"),
    )
    n = F.col("n")  # rows that are equal in doc_id and text
    space = float(total + distinct + 1)
    base = agg.select("key", F.col("doc_id").alias("id"), n, (F.col("n_tokens") / n).cast("long").alias("n_tokens"), (F.col("n_known") / n).cast("long").alias("n_known"), (F.col("sums") / n - F.col("n_tokens") / n * F.log10(F.lit(space))).alias("base_score"))

    # The model's part
    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.frombuffer(id_bytes(t, path), "<u4").astype("<u2").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(held_out(batch.column(0).to_pylist())), pa.array(out, pa.binary())], names=["doc_id", "key", "held_out", "ids"])

    ids = saved(keyed.mapInArrow(ids_of, f"doc_id {kind}, key long, held_out boolean, ids binary"), "ids", folder)

    def id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                c += np.bincount(np.frombuffer(x, "<u2"), minlength=1 << 16)
                c[end_id] += 1
        on = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(c[on])], names=["id", "c"])

    found = ids.where("not held_out").select("ids").mapInArrow(id_counts, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()  # the vocabulary at most
    vocabulary = np.zeros(end_id + 1, np.int64)
    vocabulary[found["id"].to_numpy(int)] = found["c"].to_numpy(int)
    class_of, within, prior = classes(vocabulary)
    tree = grown(vocabulary, class_of)
    shared = spark.sparkContext.broadcast((class_of, within, prior, tree))
    n_ids, n_nodes = len(class_of) + 1, len(tree[3])
    dense = [(k, shape) for k, shape in SHAPES if k != "E"]
    width = DIM + 1
    values = [f"v{d}" for d in range(width)]

    def trained(table: pa.Table) -> pa.Table:
        class_of, _, prior, tree = shared.value
        p = whole(prior, class_of, tree)
        often = {k: np.zeros(len(p[k])) for k in "EU"}
        raw = table["ids"].take(pc.sort_indices(table, sort_keys=[("key", "ascending")])).to_pylist()
        seen = train(p, batched((np.frombuffer(r, "<u2").astype(np.int64) for r in raw), len(class_of), end_id), class_of, tree, often)
        flat = np.concatenate([p[k].ravel() for k, _ in dense])
        flat = np.pad(flat, (0, -len(flat) % width)).reshape(-1, width)
        values_ = np.concatenate([np.pad(p["E"], ((0, 0), (0, 1))), p["U"], flat]).astype(float)
        weight = np.ceil(np.sqrt(np.concatenate([often["E"], often["U"], np.full(len(flat), float(seen))]))).astype(np.int64)
        on = np.flatnonzero(weight)  # what this shard has trained
        whole_numbers = np.round(np.clip(values_[on], -1000, 1000) * FINE).astype(np.int64) * weight[on][:, None]
        return pa.table([pa.array(on), pa.array(weight[on]), *(pa.array(whole_numbers[:, d]) for d in range(width))], names=["row", "weight", *values])

    shards = max(1, -(-int(vocabulary.sum()) // SHARD))  # by rows' own hash, so that partitions don't matter
    rows_of = ids.where("not held_out").select("key", "ids", F.pmod(F.xxhash64("key"), F.lit(shards).cast("long")).alias("shard"))
    copies = rows_of.groupBy("shard").applyInArrow(trained, "row long, weight long, " + ", ".join(f"{v} long" for v in values))
    # A row for each id and branch at most. Weights are square roots of how often a row was trained.
    mean = copies.groupBy("row").agg(*[(F.sum(v).cast("double") / F.sum("weight") / FINE).alias(v) for v in values]).toPandas()
    model = whole(prior, class_of, tree)
    if len(mean):
        flat = np.concatenate([model[k].ravel() for k, _ in dense])
        table = np.concatenate([np.pad(model["E"], ((0, 0), (0, 1))), model["U"], np.pad(flat, (0, -len(flat) % width)).reshape(-1, width)])
        table[mean["row"].to_numpy()] = mean[values].to_numpy()
        model["E"], model["U"], flat = table[:n_ids, :DIM].copy(), table[n_ids : n_ids + n_nodes], table[n_ids + n_nodes :].ravel()
        at = 0
        for k, shape in dense:
            size = int(np.prod(shape))
            model[k] = flat[at : at + size].reshape(shape)
            at += size
    final = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, within, _, tree = shared.value
        for batch in batches:
            raw = batch.column(3).to_pylist()
            out: list[float] = []
            a = size = 0
            for k, x in enumerate(raw):
                size += len(x)
                if size > 200_000 or k + 1 == len(raw):
                    out += log_scores(final.value, [np.frombuffer(y, "<u2").astype(np.int64) for y in raw[a : k + 1]], class_of, within, end_id, tree)
                    a, size = k + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.float64())], names=["doc_id", "key", "held_out", "score"])

    lm = ids.mapInArrow(score, f"doc_id {kind}, key long, held_out boolean, score double")
    return lm.join(base, (lm.key == base.key) & lm.doc_id.eqNullSafe(base.id)).select(
        lm.doc_id, "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.when(F.lit(total > 0), F.col("base_score")).alias("base_score"), "score"
    )
