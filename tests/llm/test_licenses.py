import random
import re

from folioquarry.llm.licenses import PHRASES, TEMPLATES, Automaton, licence_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for label, p in PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in places]
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_matching_statistics_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        sequences = [[rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(4)]
        runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        automaton, v, length = Automaton(sequences), 0, 0
        text = [rng.randrange(5) for _ in range(80)]
        for k in range(len(text)):
            v, length = automaton.step(v, length, text[k])
            want = next((n for n in range(k + 1, 0, -1) if tuple(text[k + 1 - n : k + 1]) in runs), 0)
            assert length == want
            if length:
                ends = {(t, j) for t, s in enumerate(sequences) for j in range(length, len(s) + 1) if s[j - length : j] == text[k + 1 - length : k + 1]}
                assert ends == automaton.ends[v]


def test_base_equals_brute_force(spark):
    rng = random.Random(9)
    pool = [w for _, p in PHRASES for w in p.split()] * 3 + ["The", "licensed", "under", "é", "CC-BY", "MIT_License", "x1", ".", "\n"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for k in range(300)]
    rows += [(None, None), (7, ""), (8, "mit\x00LICENSE"), (9, "Émit license"), (10, "cc by " * 20000), (7, ""), (11, "cc"), (12, "by")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score")
    got = sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licence_scan(df).collect()], key=str)
    assert got == sorted([(k, *base(t)) for k, t in rows], key=str)
    assert licence_scan(df.limit(0)).count() == 0


def test_documents_and_templates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in licence_scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    rows = [(k, f"some words {t.upper()}, and more") for k, (_, t) in enumerate(TEMPLATES)] + [(99, "the software is here and that is the way"), (50, TEMPLATES[6][1].replace("charge", "cost").replace("publish", "print"))]
    out = {r.doc_id: r for r in licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, t) in enumerate(TEMPLATES):
        assert label in out[k].labels.split(",")
        whole = {(x.first_word, x.end_word) for x in out[k].spans if x.label == label and x.covered == 1}
        assert (2, 2 + len(t.split())) in whole
    assert out[99].labels == "" and out[99].score < 0.6 and "mit" in out[50].labels and 0.6 < out[50].score < 1


def test_chains_equal_brute_force():
    """The best chain against a longest common subsequence over the words that matches pair."""
    from functools import cache

    from folioquarry.llm.licenses import LEAST_MATCH, Scanner, shortest

    scanner, rng = Scanner(), random.Random(6)
    first = len(PHRASES)
    scanner.sequences = scanner.sequences[:first] + [[rng.randrange(6) for _ in range(rng.randrange(4, 16))] for _ in range(6)]
    scanner.automaton = Automaton(scanner.sequences)
    scanner.phrases, scanner.shortest = [()] * len(scanner.automaton.size), shortest(scanner.automaton)
    for _ in range(200):
        text = []
        while len(text) < 30:
            t = rng.choice(scanner.sequences[first:])
            a = rng.randrange(len(t))
            text += t[a : a + rng.randrange(1, 9)] + [rng.randrange(6)] * rng.randrange(2)
        matches = []
        scanner.scan(text, 0, [], matches)
        got = {}
        for t in range(first, len(scanner.sequences)):
            word = scanner.sequences[t]
            n = LEAST_MATCH  # pairs of words within common runs of that many
            paired = {(i + k, j + k) for i in range(len(text) - n + 1) for j in range(len(word) - n + 1) if text[i : i + n] == word[j : j + n] for k in range(n)}

            @cache
            def best(i, j):
                if i == len(text) or j == len(word):
                    return 0
                return max(best(i + 1, j), best(i, j + 1), 1 + best(i + 1, j + 1) if (i, j) in paired else 0)

            if paired:
                got[t] = best(0, 0) / len(word)
            best.cache_clear()
        assert sorted(got.values()) == sorted(c for _, _, _, c in scanner.chains(matches))
        for label, a, b, covered in scanner.chains(matches):
            assert 0 <= a < b <= len(text) and covered <= 1
