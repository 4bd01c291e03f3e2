import random
import re
from collections import Counter

import numpy as np
import pytest

import folioquarry.llm.phrases as p


def brute(rows, least=30, most=2000, inside=80, longest=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cand.items():
        if any(lo == lang and len(v) > len(w) and 100 * b >= inside * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (lo, v), b in cand.items()):
            continue
        s, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], s))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:most]
        ranked += [(x[0], r + 1, *x[1:]) for r, x in enumerate(own)]
    return sorted(ranked)


def got(df, **more):
    return sorted(tuple(r) for r in p.collocations(df, **more).collect())


def rows_of(seed, n=400):
    rng = random.Random(seed)
    vocab = ["The", "cat", "sat", "é", "x" * 40, "x" * 39 + "y", "日本", "a\u0000b", "on", "mat"]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(30))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\x0b", "\n\n", "\r", "!? "]) for w in words)
        if rng.random() < 0.3:
            text += "the cat sat on the mat"
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), ("...", "de"), (" \t", "en"), ("one", "nl")]


def test_equals_brute_force(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS phrase", "2 AS n", "3 AS rank")
    for more in ({"least": 8, "most": 40}, {"least": 5, "inside": 60, "longest": 3}, {"least": 3, "longest": 2}):
        assert got(df.repartition(5), **more) == brute(rows, **more), more
    assert got(df.limit(0)) == []


def test_a_very_long_text_and_production_parameters(spark):
    rows = rows_of(3, 200) + [("w v " * 100_000, "en"), ("w v. " * 20_000, None)]
    assert got(spark.createDataFrame(rows, "text string, lang string")) == brute(rows)


@pytest.mark.parametrize("what", ["bits", "hashes"])
def test_shared_bits_and_hashes_change_nothing(spark, monkeypatch, what):
    """With few bits, or with a hash that confuses words, runs pass for nothing or are told apart by their bytes."""
    rows = rows_of(2, 150)
    s = p.Stretch(np.frombuffer(b"aa bb aa bb cc", np.uint8), np.array([0, 14]), ["en"])
    at = np.array([0, 1, 2, 3])
    if what == "bits":
        bits = np.full(p.BITS // 8, 255, np.uint8)
        assert p.is_set(bits, s.hash).all() and not p.is_set(bits * 0, s.hash).any()
        monkeypatch.setattr(p, "bits_of", lambda frequent, k: bits.tobytes())
        assert got(spark.createDataFrame(rows, "text string, lang string"), least=6) == brute(rows, least=6)
    else:
        want = sorted(zip(*s.counts(at, 2, np.arange(4, dtype=np.uint64) % 2).to_pydict().values(), strict=True))
        assert want == [("en", "aa bb", 2), ("en", "bb aa", 1), ("en", "bb cc", 1)]


def test_bits_are_those_of_the_texts(spark):
    frequent = spark.createDataFrame([("en", "aa bb"), ("fr", "cc dd")], "lang string, phrase string")
    bits = np.frombuffer(p.bits_of(frequent, 2), np.uint8)
    s = p.Stretch(np.frombuffer(b"AA  bb cc\tdd", np.uint8), np.array([0, 12]), ["en"])
    run = p.longer(p.fmix(s.hash ^ s.seed)[:-1], s.hash[1:])
    assert p.is_set(bits, run).tolist() == [True, False, False] and np.unpackbits(bits).sum() == 2


def test_ranks_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(p, "SALTS", 3)
    rows = [("en", f"p{k}", (k * 7919) % 50, k % 5) for k in range(300)] + [("fr", "x", 1, 1)]
    df = spark.createDataFrame(rows, "lang string, phrase string, score long, a long")
    for most in (1, 20, 400):
        want = [(x[0], r + 1, x[1]) for lang in ("en", "fr") for r, x in enumerate(sorted((x for x in rows if x[0] == lang), key=lambda x: (-x[2], -x[3], x[1]))[:most])]
        assert sorted((r.lang, r["rank"], r.phrase) for r in p.top(df, most).collect()) == sorted(want)
