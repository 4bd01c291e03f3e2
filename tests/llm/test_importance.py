import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import folioquarry.llm.common as common
import folioquarry.llm.importance as m

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, most):
    w = WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return w, [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, most=1, buckets=10_000, percent=10, least_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for x in target:
        t.update(map(bucket, features(x, most)[1]))
    for _, x in docs:
        s.update(map(bucket, features(x, most)[1]))
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + buckets)) / ((s[b] + 1) * (t.total() + buckets)))) for b in s | t}
    out = []
    for row, (k, x) in enumerate(docs):
        w, fs = features(x, most)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w), row])
    able = sorted((x for x in out if x[5] >= least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for r, x in enumerate(able[: len(able) * percent // 100]):
        x[4] = r + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def made(seed, n=150):
    rng = random.Random(seed)
    vocab = ["The", "cat", "SAT", "é", "日本", "x" * 50, "y" * 33, "7up", *[f"w{k}" for k in range(200)]]
    text = lambda: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "-", "\n", "　"]) for _ in range(rng.randrange(60)))
    docs = [(k, text()) for k in range(n)]
    docs += [(None, docs[3][1]), (None, docs[3][1]), (5, docs[5][1]), (n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "the " * 60_000)]
    return docs, [text() for _ in range(20)] + [None, "only here zzz"]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, most):
    docs, target = made(most)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS score", "3 AS n", "4 AS gain")
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    for shared, buckets, percent in ((8 << 20, 10_000, 10), (160, 97, 100)):
        monkeypatch.setattr(m, "SHARED", shared)
        got = m.resampled(df.repartition(4), goal, most=most, buckets=buckets, percent=percent).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, target, most, buckets, percent), (shared, buckets)
    assert m.resampled(df.limit(0), goal, most=most).count() == 0
    assert {r.rank for r in m.resampled(df, goal.limit(0), percent=0).collect()} == {None}


def test_frequent_words_beyond_the_broadcast_are_salted(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARED", 0)
    monkeypatch.setattr(m, "OFTEN", 50)
    monkeypatch.setattr(common, "OFTEN", 50)
    docs, target = made(9, 120)
    docs = docs[:-1]
    got = m.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"), most=2)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, 2)


def test_words_that_share_an_id_get_new_ones(spark, monkeypatch, tmp_path):
    """With ids of few bits two words share one under the first seeds; a dictionary is made under the first that parts them."""
    real = common.word_hash
    texts = spark.createDataFrame([("aa bb cc", False), ("bb dd", True)], "text string, target boolean")
    monkeypatch.setattr(m, "word_hash", lambda data, a, b, seed=0: real(data, a, b, seed) % np.uint64(2 if seed < 2 else 1 << 60))
    words, seed = m.dictionary(texts, str(tmp_path))
    assert seed == 2 and sorted((r.word, r.s, r.t) for r in words.collect()) == [("aa", 1, 0), ("bb", 1, 1), ("cc", 1, 0), ("dd", 0, 1)]
    monkeypatch.setattr(m, "SEEDS", 2)
    with pytest.raises(RuntimeError):
        m.dictionary(texts, str(tmp_path / "again"))


def test_ranks_over_ranges(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, *range(40)]), rng.randrange(30)) for k in range(2000)]
    df = spark.createDataFrame(rows, "row long, doc_id long, score long").repartition(7)
    want = sorted(rows, key=lambda x: (-x[2], x[1] is None, x[1] or 0, x[0]))
    assert {r.row: r["rank"] for r in m.ranked(df, str(tmp_path)).collect()} == {x[0]: k + 1 for k, x in enumerate(want)}
