import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from folioquarry.llm.packing import column_generation, first_fit, knapsack, packed, plan, planned, slots

PATH = P.path("byte_bpe_50k.json")
tok = Tokenizer.from_file(PATH)


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 12), 3, replace=False))
        worth = rng.random(3)
        best = max(a * worth[0] + b * worth[1] + c * worth[2] for a in range(21) for b in range(21) for c in range(21) if np.array([a, b, c]) @ lengths <= 20)
        got, counts = knapsack(lengths, worth, 20)
        assert abs(got - best) < 1e-9 and abs(counts @ worth - best) < 1e-9 and counts @ lengths <= 20


def test_program_known_optimum():
    # widths 45, 36, 31, 14 of 100 with demands 97, 610, 395, 211: a classic with optimum 452.25
    patterns, x = column_generation(np.array([14, 31, 36, 45]), np.array([211.0, 395, 610, 97]), 100, gap=0)
    assert abs(x.sum() - 452.25) < 1e-6
    assert np.allclose(patterns @ x, [211, 395, 610, 97])


def test_program_against_the_bound_and_first_fit():
    rng = np.random.default_rng(3)
    for n, size in ((8, 60), (40, 200), (200, 1024)):
        lengths = np.sort(rng.choice(np.arange(1, size), n, replace=False))
        demand = rng.integers(1, 30, n).astype(float)
        start = first_fit(lengths, demand, size)
        assert (lengths @ start <= size).all() and (start.max(1) > 0).all()
        patterns, x = column_generation(lengths, demand, size)
        assert np.allclose(patterns @ x, demand, atol=1e-3) and (lengths @ patterns <= size).all()
        best, use = column_generation(lengths[:8], demand[:8], size, gap=0)
        dual = np.linalg.solve(best.T, np.ones(8))
        assert abs(dual @ demand[:8] - use.sum()) < 1e-6
        assert knapsack(lengths[:8], np.maximum(dual, 0), size)[0] <= 1 + 1e-6  # no pattern is worth more: the optimum


def test_sequences_come_from_the_program():
    rng = random.Random(7)
    for n in (1000, 20_000):
        histogram = Counter(int(rng.expovariate(1 / 300)) % 1023 + 1 for _ in range(n))
        plans, solved = planned(dict(histogram), 1024)
        total = sum(t for _, t in plans)
        assert solved >= 0.97 * total and total <= sum(k * v for k, v in histogram.items()) / 1024 * 1.01 + 2


def test_plan_covers_the_histogram():
    rng = random.Random(1)
    for n in (0, 1, 40, 3000, 200_000):
        histogram = Counter(min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(n))
        used = Counter()
        plans = plan(dict(histogram), 1024)
        for pattern, times in plans:
            assert sum(a * b for a, b in pattern) <= 1024
            for length, copies in pattern:
                used[length] += copies * times
        assert used == histogram
        need = sum(k * v for k, v in histogram.items()) / 1024
        assert sum(t for _, t in plans) <= need * 1.01 + 2
        assert len(slots(plans)) == sum(len(p) for p, _ in plans)


def verify(rows, out, total_slack=None):
    texts = defaultdict(list)
    for k, t in rows:
        texts[k].append(tok.encode(t or "", add_special_tokens=False).ids + [0])
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, lists in texts.items():
        want = [(a, len(i[a : a + 1024]), zlib.crc32(np.array(i[a : a + 1024], "<u4").tobytes()), len(i)) for i in lists for a in range(0, len(i), 1024)]
        assert sorted(want) == sorted(got[k])
    assert got.keys() == texts.keys()
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), sum(n for s in sequences.values() for _, n in s)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n, tokens = verify([(r.doc_id, r.text) for r in docs.collect()], packed(docs, PATH).collect())
    assert n * 1024 <= tokens * 1.01


def test_edges(spark):
    rows = [(None, "a b"), (None, "a b"), (1, None), (1, ""), (2, "x <|endoftext|> y"), (3, "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS row", "3 AS length")
    verify(rows, packed(df, PATH).collect())
    ids = packed(df, PATH, with_ids=True).where("doc_id = 2").first()
    assert list(ids.ids) == tok.encode("x <|endoftext|> y", add_special_tokens=False).ids + [0]
    assert packed(df.limit(0), PATH).count() == 0


def test_ids_equal_the_library():
    from test_tokens import HARD

    from folioquarry.llm.packing import id_bytes

    for t in HARD + [" " * 5000 + "x", "\n" * 3000, "é" * 5000, "a\u0000b ​　 x"]:
        assert np.frombuffer(id_bytes(t, PATH), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
