"""Quality by ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good. P(grade <= j) = sigmoid(threshold_j - w . x) with one weight vector w for hashed
features of the text and ordered thresholds. Features are the text's words (lower-cased), their beginnings and, for each
shape of words (kind of the first, the last but one and the last byte, or a repeat of the word before), its share of the
words in steps. Features are hashed, and present or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.common import LOWER, NOT_ALNUM, fmix, prefix_hash, small_batches, span_hash, views, word_spans

BITS = 20
PREFIXES = (3, 4, 5, 6, 7)
COPIES = np.arange(8, dtype=np.uint64) << np.uint64(40)  # of a shape's feature, so that many words don't drown it
SAMPLE = 4_000  # labelled rows that a model is fitted on, at most
GRADES = 3
KIND = np.full(256, 97, np.int64)  # lower-case letters and bytes beyond ASCII
KIND[:128] = np.arange(128)
KIND[97:123], KIND[65:91], KIND[48:58] = 97, 65, 48


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted hashed features of each row."""
    bits = np.uint64(64 - BITS)
    lower = LOWER[data]
    sums = prefix_hash(lower)
    named = []  # (hash, first of each row): words, and their beginnings of PREFIXES bytes
    starts, ends, first = word_spans(lower, offsets, NOT_ALNUM)
    named.append((span_hash(sums, starts, ends), first))
    for size in PREFIXES:
        on = ends - starts > size
        before = np.concatenate([[0], np.cumsum(on)])
        named.append((fmix(span_hash(sums, starts[on], starts[on] + size) ^ np.uint64(size)), before[first]))
    starts, ends, first = word_spans(data, offsets)
    word = span_hash(sums, starts, ends)
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    shape = KIND[data[starts]] << 16 | KIND[data[np.maximum(ends - 2, starts)]] << 8 | KIND[data[ends - 1]]
    shape[again] = 1 << 24  # the word before once more
    out = []
    for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        kinds, n = np.unique(shape[a:b], return_counts=True)
        step = np.ceil(8 * n / max(b - a, 1)).astype(np.uint64)
        own = [h[f[r] : f[r + 1]] for h, f in named]
        shapes = (kinds.astype(np.uint64) << np.uint64(4) | step)[None] ^ COPIES[:, None]
        out.append(np.unique(np.concatenate([*own, fmix(shapes.ravel())]) >> bits).astype(np.int64))
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each row's features."""
        score = np.array([self.weights[r].sum() for r in rows])
        return sigmoid(score[:, None] - self.thresholds[None, :])


def likelihood(p: np.ndarray, flat: np.ndarray, of: np.ndarray, grades: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(mean negative log-likelihood plus ridge, its gradient) at p: weights, the first threshold, logs of the gaps.

    flat, of: the weight and the row of each feature that is present."""
    n, k = len(grades), len(p) - GRADES + 1
    w, free = p[:k], p[k:]
    theta = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])
    score = np.bincount(of, w[flat], n)
    edges = np.concatenate([np.full((n, 1), -np.inf), theta[None] - score[:, None], np.full((n, 1), np.inf)], 1)
    low, high = edges[np.arange(n), grades], edges[np.arange(n), grades + 1]
    s_low, s_high = np.where(np.isinf(low), 0, sigmoid(low)), np.where(np.isinf(high), 1, sigmoid(high))
    mass = np.maximum(s_high - s_low, 1e-9)
    d_high, d_low = s_high * (1 - s_high) / mass, s_low * (1 - s_low) / mass  # of log mass
    g_theta = np.array([d_high[grades == j].sum() - d_low[grades == j + 1].sum() for j in range(GRADES - 1)])
    g_free = np.concatenate([[g_theta.sum()], [np.exp(free[1 + j]) * g_theta[j + 1 :].sum() for j in range(GRADES - 2)]])
    g = np.concatenate([-np.bincount(flat, (d_low - d_high)[of], k) / n + ridge * w, -g_free / n])
    return float(-np.log(mass).mean() + ridge * (w * w).sum() / 2), g


def regress(rows: list[np.ndarray], grades: np.ndarray, turns: int = 150, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """Adam on the mean negative log-likelihood plus ridge; the gaps between thresholds are exponentials, so they stay ordered."""
    n = len(rows)
    flat = np.concatenate(rows) if n else np.zeros(0, np.int64)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    used, flat = np.unique(flat, return_inverse=True)
    share = np.array([(grades <= j).sum() + 1 for j in range(GRADES - 1)]) / (n + 2)
    cut = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(used)), [cut[0]], np.log(np.maximum(np.diff(cut), 0.1))])
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, turns + 1):
        g = likelihood(p, flat, of, grades, ridge)[1]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        p = p - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = p[: len(used)]
    return Model(weights, p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in views(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([f.astype(np.int32) for f in features(data, offsets)], pa.list_(pa.int32()))], names=["grade", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled rows of docs: labels has doc_id, quality 0/1, toxic 0/1.

    Fitted on at most `sample` labelled ids, those of least hash: a bounded sample, so that the features (which the
    driver holds) don't grow with the corpus. Labels with a null id or quality are left out, a null toxic counts as 0;
    of several labels of an id the lowest grade holds. Without labels every row gets the middle of the scale.
    """
    small_batches(docs.sparkSession)
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    ids = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("id"), grade.alias("grade")).groupBy("id").agg(F.min("grade").alias("grade"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id")  # `sample` rows at most
    rows = rows.select("grade", "text").mapInArrow(_featured, "grade int, x array<int>")
    held = rows.orderBy(F.xxhash64("x")).limit(sample).toArrow()  # an id that stands in many rows doesn't add to the bound
    if not len(held):
        return Model(np.zeros(1 << BITS), np.linspace(-1, 1, GRADES - 1))
    x = held["x"].combine_chunks()
    return regress(np.split(x.flatten().to_numpy(), np.cumsum(x.value_lengths().to_numpy())[:-1]), held["grade"].to_numpy().astype(np.int64))


def rated(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_at_least_1, p_at_least_2, kept (p_at_least_2 >= least) of each row of docs.

    Null, empty and blank texts have no words: their features are empty and the thresholds alone give their grade. Null
    ids and repeated rows stay; an empty table gives an empty result; other columns are not read.
    """
    docs_ = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs_.schema["doc_id"].dataType.simpleString()
    return docs_.mapInArrow(_rater(docs, model, least, [0]), f"doc_id {kind}, expected_grade double, p_at_least_1 double, p_at_least_2 double, kept boolean")


def good(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that rated() keeps."""
    names = [c for c in docs.columns if c != text_col]
    first = docs.select(F.struct(*[F.col(c) for c in names]).alias("rest"), F.col(text_col).cast("string").alias("text"), F.col(text_col).alias("own"))
    kinds = first.schema
    marked = first.mapInArrow(_rater(docs, model, least, [0, 2]), f"rest {kinds['rest'].dataType.simpleString()}, own {kinds['own'].dataType.simpleString()}, expected_grade double, p_at_least_1 double, p_at_least_2 double, kept boolean")
    return marked.where("kept").select(*(F.col("own").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))


def _rater(docs: DataFrame, model: Model, least: float, carried: list[int]):
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 2 ** BITS weights
    named = ["doc_id"] if carried == [0] else ["rest", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for lo, hi, data, offsets in views(batch.column(1)):
                p = m.tails(features(data, offsets)).astype(float)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in carried), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= least)], names=[*named, "expected_grade", "p_at_least_1", "p_at_least_2", "kept"])

    return run
