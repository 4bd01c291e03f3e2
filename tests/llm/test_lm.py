import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P

from folioquarry.llm import lm

PATH = P.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    fold = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2
    toks = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t in rows]
    c = Counter(w for (k, _), t in zip(rows, toks) if not fold(k) for w in t)
    n, v = sum(c.values()), len(c)
    return [(k, fold(k), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (k, _), t in zip(rows, toks)]


def got(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.scored(df, PATH).collect()]


def test_base_equals_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [rows[3], rows[3], (None, None), (None, "The"), (9999, ""), (10000, "new words " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS word", "3 AS c")
    want = sorted(brute(rows), key=str)
    assert sorted(got(df), key=str) == want
    monkeypatch.setattr(lm, "FREQUENT", 100)
    assert sorted(got(df), key=str) == want
    assert lm.scored(df.limit(0), PATH).count() == 0


def test_gradient():
    rng = np.random.default_rng(1)
    p = {k: v.astype(float) for k, v in lm.initial(np.full(lm.CLASSES, 1 / lm.CLASSES)).items()}
    x, t = rng.integers(0, lm.CLASSES, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.STRIDE))
    w = (rng.random((3, lm.STRIDE)) < 0.7).astype(float)
    loss = lambda: -(np.take_along_axis(lm.forward(p, x)[0], t[..., None], 2)[..., 0] * w).sum() / w.sum()
    g = lm.backward(p, *lm.forward(p, x), t, w)
    for k, shape in lm.SHAPES:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in shape)
            keep = p[k][at]
            p[k][at] = keep + 1e-5
            up = loss()
            p[k][at] = keep - 1e-5
            down = loss()
            p[k][at] = keep
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-5


def test_windows_score_each_token_once_and_causally():
    class_of, within, prior = lm.classes(np.arange(100))
    rng = np.random.default_rng(2)
    p = lm.initial(prior)
    p = {k: v + 0.3 * rng.standard_normal(v.shape).astype(np.float32) for k, v in p.items()}
    for n in (0, 1, 15, 16, 17, 100):
        ids = rng.integers(0, 99, n)
        _, target = lm.windows(ids, class_of, 99)
        assert target[target >= 0].tolist() == [*ids.tolist(), 99]
    # later ids don't change what is said of earlier ones
    a, b = rng.integers(0, 99, 40), None
    b = a.copy()
    b[30:] = (b[30:] + 7) % 99
    la, lb = (lm.forward(p, lm.windows(s, class_of, 99)[0])[0].reshape(-1, lm.CLASSES) for s in (a, b))
    assert np.allclose(la[:31], lb[:31], atol=1e-5) and not np.allclose(la[31:35], lb[31:35], atol=1e-5)
    # a proper distribution: texts of up to two ids and their longer ones sum to one
    logp = lm.forward(p, lm.windows(np.zeros(0, int), class_of, 99)[0])[0][0, 0]
    assert abs(sum(math.exp(logp[class_of[i]]) * 10 ** within[i] for i in range(100)) - 1) < 1e-4
    one = lm.log_scores(p, [a, b, a], class_of, within, 99)
    assert one[0] == one[2] and abs(one[0] - lm.log_scores(p, [a], class_of, within, 99)[0]) < 1e-4


def test_model_beats_its_prior_on_held_out_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    score = lambda: sum(r.score for r in lm.scored(docs, PATH).where("held_out").collect())
    trained = score()
    monkeypatch.setattr(lm, "train", lambda p, batches, *a: sum(0 for _ in batches))
    assert trained > 0.85 * score() and trained < 0


def test_every_window_of_training_rows_is_trained_on(spark, monkeypatch, tmp_path):
    rows = [(k, "some words of a text " * n) for k, n in enumerate([0, 1, 3, 10, 40, 400, 3000])] + [(4, "some words of a text " * 40)]
    folder = str(tmp_path)

    def counted(p, batches, *others):
        seen = [(len(x), int((t >= 0).sum())) for x, t in batches]
        with open(f"{folder}/{random.getrandbits(64)}", "w") as f:
            f.write(f"{max((n for n, _ in seen), default=0)} {sum(n for _, n in seen)}")
        return sum(n for _, n in seen)

    monkeypatch.setattr(lm, "train", counted)
    assert lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), PATH).count() == len(rows)
    found = [tuple(map(int, f.read_text().split())) for f in tmp_path.iterdir()]
    assert sum(n for _, n in found) == sum(len(lm.id_bytes(t, PATH)) // 4 + 1 for k, t in rows if not lm.held_out([k])[0])
    assert max(n for n, _ in found) < 2 * lm.BATCH  # a long row doesn't make one large step


def test_ids_of_one_class_are_told_apart_by_what_came_before():
    """Ids 0 to 7 share classes; each is always followed by one of its own. Classes and counts can't tell."""
    counts = np.array([1000] * 8 + [0] * 60 + [1])
    class_of = np.minimum(np.arange(69) // 8, lm.CLASSES - 1)
    total = np.bincount(class_of, counts + 1, lm.CLASSES)
    within = np.log10((counts + 1) / total[class_of])
    tree = lm.grown(counts, class_of)
    p = lm.whole(total / total.sum(), class_of, tree)
    first, last = np.arange(4), 68
    rows = [np.tile([k, k + 4], 20) for k in first]
    before = lm.log_scores(p, rows, class_of, within, last, tree)
    assert np.allclose(before, [sum(np.log10((counts[np.append(r, last)] + 1) / (counts + 1).sum())) for r in rows], atol=1e-2)
    often = {k: np.zeros(len(p[k])) for k in "EU"}
    assert lm.train(p, lm.batched(rows * 400, 69, last), class_of, tree, often) == 400 * 4 * 41
    own = lm.log_scores(p, rows, class_of, within, last, tree)
    swapped = lm.log_scores(p, [np.tile([k, 4 + (k + 1) % 4], 20) for k in first], class_of, within, last, tree)
    assert min(own) > max(swapped) + 5 and min(own) > max(before) + 5
    # still a distribution over ids
    one = lm.log_scores(p, [np.array([1, 5, k]) for k in range(69)], class_of, within, last, tree)
    base = lm.forward(p, lm.windows(np.array([1, 5, 0]), np.arange(69), last, 69)[0])
    h = base[1][-1].reshape(-1, lm.DIM)[2]
    of, node, way = lm.branches(tree, np.arange(69))
    logs = np.bincount(of, lm.within_class(p["U"], h[None], of * 0, node, way)[0], 69) + base[0].reshape(-1, lm.CLASSES)[2][class_of]
    assert abs(np.exp(logs).sum() - 1) < 1e-4 and len(set(np.round(one, 6))) > 8


def small():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, 300)
    class_of, within, prior = lm.classes(counts)
    tree = lm.grown(counts, class_of)
    p = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in lm.whole(prior, class_of, tree).items()}
    return rng, p, class_of, within, tree


def test_fast_gradients_and_scores_equal_the_plain_ones():
    rng, p, class_of, within, tree = small()
    p["b"] = np.where(p["b"] < -1e6, -1e9, p["b"]).astype(np.float32)
    for size in (1, 40):
        for large in (1, 4):
            big = dict(p, Q=p["Q"] * large)
            x, t = rng.integers(0, 301, (size, lm.WINDOW)), rng.integers(-1, 300, (size, lm.STRIDE))
            g, changes, n = lm.learned(big, x, t, class_of, tree)
            logp, kept = lm.forward(big, x)
            live = np.flatnonzero(t.ravel() >= 0)
            of, node, way = lm.branches(tree, t.ravel()[live])
            _, du, each = lm.within_class(big["U"], kept[-1].reshape(-1, lm.DIM), live[of], node, way)
            dh = np.zeros((t.size, lm.DIM))
            np.add.at(dh, live[of], each / n)
            w = (t >= 0).astype(np.float32)
            want, dx = lm.gradients(big, logp, kept, np.where(t >= 0, class_of[np.maximum(t, 0)], 0), w, dh.reshape(kept[-1].shape))
            assert n == len(live) and all(np.allclose(g[k], want[k], atol=2e-4) for k in want)
            assert np.allclose(changes[0][2], du, atol=1e-4) and np.allclose(changes[1][2], dx.reshape(-1, lm.DIM) * n, atol=2e-2)
            own, h = lm.target_logs(big, x, class_of[np.maximum(t, 0)])
            assert np.allclose(own, np.take_along_axis(logp, class_of[np.maximum(t, 0)][..., None], 2)[..., 0], atol=1e-3) and np.allclose(h, kept[-1].reshape(-1, lm.DIM), atol=1e-4)


def test_scores_equal_one_id_after_another():
    """log_scores against the plain forward pass, class and branches of one id at a time."""
    rng, p, class_of, within, tree = small()
    p["b"] = np.where(p["b"] < -1e6, -1e9, p["b"]).astype(np.float32)
    for n in (0, 1, 15, 16, 40):
        ids = rng.integers(0, 299, n)
        x, target = lm.windows(ids, np.arange(300), 299, 300)
        logp, kept = lm.forward(p, x)
        h, total = kept[-1].reshape(-1, lm.DIM), 0.0
        for at, i in enumerate([*ids.tolist(), 299]):
            of, node, way = lm.branches(tree, np.array([i]))
            total += logp.reshape(-1, lm.CLASSES)[at, class_of[i]] + lm.within_class(p["U"], h[at : at + 1], of, node, way)[0].sum()
        assert abs(lm.log_scores(p, [ids], class_of, within, 299, tree)[0] - total / math.log(10)) < 1e-3 * max(1, n)


def test_score_does_not_depend_on_partitions(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(lm, "SHARD", 20_000)
    one, eight, many = (sorted((r.doc_id, r.score, r.base_score) for r in lm.scored(docs.repartition(n), PATH).collect()) for n in (1, 8, 64))
    for a, b, d in zip(one, eight, many, strict=True):  # but for the rounding of sums in single precision
        assert a[0] == b[0] == d[0] and max(abs(a[k] - x[k]) for k in (1, 2) for x in (b, d)) < 1e-4


def test_long_words_alike_under_a_polynomial_are_told_apart(spark):
    """Two words of 1,024 letters that complement each other by the Thue-Morse rule."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    rows = [(k, a) for k in range(4)] + [(k, b) for k in range(100, 140) if zlib.crc32(str(k).encode()) % 7 == 2]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(got(df), key=str) == sorted(brute(rows), key=str)


def test_exponents_end_at_sixty_only_where_weights_reach_it():
    """The step leaves the clipping of scores and classes out where no exponent can be over 60, and keeps it elsewhere."""
    rng, p, class_of, within, tree = small()
    p["b"] = np.where(p["b"] < -1e6, -1e9, p["b"]).astype(np.float32)
    for more in ({"Q": 1}, {"Q": 60}, {"W": 60}, {"Q": 60, "W": 60}):
        big = dict(p, **{k: p[k] * np.float32(n) for k, n in more.items()})
        x, t = rng.integers(0, 301, (5, lm.WINDOW)), rng.integers(0, 300, (5, lm.STRIDE))
        logp, kept = lm.forward(big, x)
        own, h = lm.target_logs(big, x, class_of[t])
        want = np.take_along_axis(logp, class_of[t][..., None], 2)[..., 0]
        assert np.allclose(h, kept[-1].reshape(-1, lm.DIM), atol=1e-3) and np.allclose(own, want, rtol=1e-3, atol=2e-2)
        g, _, _ = lm.learned(big, x, t, class_of, tree)
        assert all(np.isfinite(v).all() for v in g.values())
    top = np.full((1, lm.DIM + 1), 1, np.float32)
    assert lm.class_weights(dict(p, W=p["W"] * 0 + 10), top).max() <= np.exp(np.float32(60)) * 1.001


def test_rows_are_summed_by_place():
    rng = np.random.default_rng(6)
    for n, size in ((0, 5), (1, 1), (500, 40), (500, 100_000)):
        at, g = rng.integers(0, size, n), rng.standard_normal((n, 9)).astype(np.float32)
        rows, sums, often = lm.summed_rows(at, g, size)
        want, count = np.zeros((size, 9)), np.bincount(at, minlength=size)
        np.add.at(want, at, g)
        assert sorted(rows.tolist()) == np.flatnonzero(count).tolist()
        assert np.allclose(sums, want[rows], atol=1e-4) and (often == count[rows]).all()


def test_words_that_share_a_slot_are_told_apart():
    rng = np.random.default_rng(8)
    shared = np.uint64(77) << np.uint64(64 - lm.SLOT_BITS)
    table = np.unique(np.concatenate([shared + np.arange(5, dtype=np.uint64), rng.integers(0, 1 << 64, 3000, np.uint64)]))
    absent = np.concatenate([shared + np.arange(5, 9, dtype=np.uint64), rng.integers(0, 1 << 64, 3000, np.uint64)])
    absent = absent[~np.isin(absent, table)]
    values = rng.integers(1, 10, len(table))
    word = rng.permutation(np.concatenate([table, table, absent]))
    at, hit = lm.looked_up(table, lm.first_places(table, values), word)
    assert (hit == np.isin(word, table)).all() and (table[at[hit]] == word[hit]).all() and hit.sum() == 2 * len(table)
    none = np.zeros(0, np.uint64)
    for t, w in ((none, word), (table, none), (none, none)):
        assert not lm.looked_up(t, lm.first_places(t, np.zeros(len(t))), w)[1].any()
