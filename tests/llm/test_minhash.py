import random
import re

from folioquarry.llm.minhash import near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        least = min(ids) if ids else None
        out.append((k, len(sets[i]), least, k == least))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"W{i}" for i in range(300)]
    rows, k = [], 0
    line = [rng.choice(vocab) for _ in range(40)]
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 30, 120]))]
        if rng.random() < 0.4:
            base += line
        for _ in range(rng.choice([1, 1, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \n\t"), (k + 3, "é\x0bB c"), (k + 4, "É\tb c"), (k + 5, "é b C"), (None, "one two"), (None, "One  two"), (3, rows[3][1]), (k + 6, "long " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS node", "'x' AS n_shingles")
    assert result(near_duplicates(df)) == brute(rows)


def test_chain_and_empty(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 100])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df)) == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_many_near_copies_of_one_text(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        copy = list(base)
        for _ in range(rng.choice([2, 3, 4, 5, 6])):
            copy[rng.randrange(120)] = rng.choice("abcdef")
        rows.append((k, " ".join(copy)))
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_long_words_and_ids_of_text(spark):
    """Words of 1,024 letters that a polynomial modulo a power of two takes for one another; ids needn't be numbers."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    rows = [(1, f"x {a} y"), (2, f"x {a} y"), (3, f"x {b} y"), (4, b), (5, a)]
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    named = [(f"d{k}", t) for k, t in rows]
    assert result(near_duplicates(spark.createDataFrame(named, "doc_id string, text string"))) == brute(named)


def test_all_links_of_sf001_are_found(spark):
    """Recall against an exact computation over the whole table: shared shingles counted by an inverted index."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_null_and_repeated_ids(spark):
    """Different texts under one id are no product: 2,000 rows without an id and 500 under one id."""
    rng = random.Random(2)
    rows = [(None if k < 2000 else 7, " ".join(rng.choice("abcdefghijklmnop") for _ in range(12))) for k in range(2500)]
    rows += [(k, t) for k, (_, t) in enumerate(rows[:60])] + rows[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows) and sum(r.component_id is None for r in got) > 1000
    small = rows[:50] + rows[2000:2050] + rows[2500:]
    assert result(near_duplicates(spark.createDataFrame(small, "doc_id long, text string"))) == brute(small)
