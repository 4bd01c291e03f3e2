import math
import random

import pyspark.sql.functions as F

from folioquarry.llm.topk import exact_top_k


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, j) in enumerate(found)]
    return sorted(out)


def got(df, k=5):
    return sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % 10 == 0, k).select("query_id", "rank", "vec_id", "score").collect())


def test_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(40)] + [(13, rows[13][1]), (441, [0.0] * 12), (450, [0.0] * 12)]
    rows += [(None, rows[0][1]), (460, None), (461, [1.0, None] + [0.0] * 10), (470, [float("nan")] * 12), (471, [float("inf")] * 12), (480, []), (481, []), (490, [1.0] * 3), (491, [0.5] * 3)]
    rows += [(500, [3e7] * 12), (501, [-3e7] * 12), (502, [float(x) for x in range(12)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS row", "2 AS query", "3 AS v")
    assert got(df) == brute(rows, 5)
    assert got(df, 600) == brute(rows, 600)
    assert got(df.limit(0)) == []


def test_blocks(spark, monkeypatch):
    import folioquarry.llm.topk as t

    monkeypatch.setattr(t, "QUERY_BYTES", 6000)
    monkeypatch.setattr(t, "FIRST", 40)
    monkeypatch.setattr(t, "SIDE", 16)
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(33)]) for i in range(500)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows, 5)
