import hashlib
import random
from collections import Counter

from folioquarry.llm.suffix import Run, RECORD, kept_texts, merge, without_repeats
import numpy as np


def brute(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for (k, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((k, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, n):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(df, n).collect()], key=str)


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(3)
    runs, all_ = [], []
    for _ in range(7):
        strings = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(40)))
        all_ += strings
        runs.append(Run(Run.packed(strings, np.zeros(len(strings), RECORD))))
    out, prefix, where = merge(runs)
    assert out == sorted(all_) and len(set(where)) == len(all_)
    for a, b, p in zip(out, out[1:], prefix[1:]):
        assert p == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_equals_brute_force(spark):
    rng = random.Random(11)
    for n, letters in ((40, "ab"), (40, "abcdefgh é"), (400, "abcdefghijkl é")):
        part = lambda m: "".join(rng.choice(letters) for _ in range(m))
        shared = [part(rng.choice([n // 2, n - 1, n, n + 1, n + 7, 3 * n])) for _ in range(12)]
        rows = []
        for k in range(60):
            t = "".join(rng.choice([part(rng.randrange(2 * n)), rng.choice(shared), rng.choice(shared)[rng.randrange(9) :]]) for _ in range(rng.randrange(1, 6)))
            rows.append((k, t))
        rows += [(k + 100, rows[k][1]) for k in range(4)] + [(3, rows[3][1]), (None, None), (200, ""), (201, "x" * n), (202, "y" * (n + 1)), (203, "z" * 4 * n), (204, "ab" * 3 * n), (205, "\0" * (n + 3)), (206, "q" + "\0" * n)]
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS key", "1 AS spans")
        assert got(df, n) == brute(rows, n)
    assert got(df.limit(0), 40) == []


def test_long_text(spark, monkeypatch):
    import folioquarry.llm.suffix as s

    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(60_000))
    rows = [(1, long), (2, "start" + long[20_000:21_000] + "end"), (3, long[59_000:])]
    monkeypatch.setattr(s, "SEGMENT", 5000)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 400) == brute(rows, 400)


def test_kept_texts(spark):
    p = "é" * 30 + "passage " * 60
    rows = [(1, "a" + p + "b", 7), (2, p + "c", 8), (3, "alone", 9), (4, None, 1)]
    out = kept_texts(spark.createDataFrame(rows, "doc_id long, text string, key int"), 400)
    assert out.columns == ["doc_id", "text", "key"]
    assert {r.doc_id: (r.text, r.key) for r in out.collect()} == {1: ("ab", 7), 2: ("c", 8), 3: ("alone", 9), 4: (None, 1)}


def test_two_lengths_at_once(spark):
    rng = random.Random(12)
    part = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [part(rng.choice([30, 50, 90, 130])) for _ in range(8)]
    rows = [(k, "".join(rng.choice([part(rng.randrange(90)), rng.choice(shared)]) for _ in range(rng.randrange(1, 5)))) for k in range(60)] + [(70, "x" * 60), (71, "x" * 60), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = without_repeats(df, 80, passage=40).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out], key=str) == brute(rows, 80)
    assert sorted([(r.doc_id, r.n_passage) for r in out], key=str) == sorted([(k, n) for k, _, n, _, _ in brute(rows, 40)], key=str)
