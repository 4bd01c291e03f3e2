import numpy as np

from folioquarry.llm.quality import BITS, fit, good, rated, regress

SF = "/root/testdata/sf0.1"


def test_gradient_of_known_data():
    rng = np.random.default_rng(0)
    truth, rows, grades = rng.standard_normal(30) * 2, [], []
    for _ in range(3000):
        x = np.sort(rng.choice(30, 6, replace=False))
        z = truth[x].sum() + rng.logistic()
        rows.append(x)
        grades.append(int(z > -2) + int(z > 2))
    model = regress(rows, np.array(grades), turns=600, ridge=0)
    found = model.weights[:30]
    assert np.corrcoef(found, truth)[0, 1] > 0.98 and model.thresholds[0] < model.thresholds[1]
    p = model.tails(rows)
    for j in (1, 2):
        assert abs(p[:, j - 1].mean() - (np.array(grades) >= j).mean()) < 0.01  # calibrated in the large


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(docs, labels.where("doc_id % 4 <> 1"))
    out = rated(docs, model).join(labels.where("doc_id % 4 = 1"), "doc_id").toPandas()
    clean, toxic, poor = (out[m] for m in ((out.quality == 1) & (out.toxic == 0), out.toxic == 1, (out.quality == 0) & (out.toxic == 0)))
    print("kept: clean", clean.kept.mean(), "toxic", toxic.kept.mean(), "poor", poor.kept.mean())
    assert clean.kept.mean() > 0.98 and toxic.kept.mean() < 0.15 and poor.kept.mean() < 0.12
    assert clean.expected_grade.mean() > poor.expected_grade.mean() > toxic.expected_grade.mean()


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "a b c", 6), (2, "x " * 50000, 7), (2, "x " * 50000, 7)], "doc_id long, text string, kept int")
    none = spark.createDataFrame([(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    model = fit(df, none)
    out = rated(df, model).collect()
    assert len(out) == 5 and all(abs(r.expected_grade - 1) < 1e-6 for r in out)
    assert good(df, model, 0.0).columns == df.columns and sorted(good(df, model, 0.0).collect(), key=str) == sorted(df.collect(), key=str)
    assert rated(df.limit(0), model).count() == 0 and good(df, model, 1.0).count() == 0
    assert len(model.weights) == 1 << BITS


def test_gradient_of_the_likelihood():
    from folioquarry.llm.quality import GRADES, likelihood

    rng = np.random.default_rng(3)
    rows = [rng.choice(12, rng.integers(0, 6), replace=False) for _ in range(60)]
    flat, of = np.concatenate(rows).astype(int), np.repeat(np.arange(60), [len(r) for r in rows])
    grades = rng.integers(0, GRADES, 60)
    p = rng.standard_normal(12 + GRADES - 1)
    g = likelihood(p, flat, of, grades, 0.01)[1]
    for k in range(len(p)):
        up, down = p.copy(), p.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert abs((likelihood(up, flat, of, grades, 0.01)[0] - likelihood(down, flat, of, grades, 0.01)[0]) / 2e-6 - g[k]) < 1e-6
    # the likelihood itself, from the definition
    theta = p[12] + np.concatenate([[0], np.cumsum(np.exp(p[13:]))])
    below = lambda j, z: 0.0 if j < 0 else 1.0 if j >= GRADES - 1 else 1 / (1 + np.exp(z - theta[j]))
    want = -np.mean([np.log(below(y, p[r].sum()) - below(y - 1, p[r].sum())) for r, y in zip(rows, grades)]) + 0.005 * (p[:12] ** 2).sum()
    assert abs(likelihood(p, flat, of, grades, 0.01)[0] - want) < 1e-9


def test_features_equal_a_plain_version():
    import re

    from folioquarry.llm.common import fmix, prefix_hash, span_hash
    from folioquarry.llm.quality import COPIES, KIND, PREFIXES, features

    def name(b):
        return span_hash(prefix_hash(np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(b)]))

    texts = ["", "  ", "The the THE end.", "word-word  x1 é ümlaut(s)", "a b a b a a a", "Longer words, prefixes 12345 #tag \t\n z" * 3]
    raw = [t.encode() for t in texts]
    got = features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    lower = lambda b: bytes(c + 32 if 65 <= c < 91 else c for c in b)
    for b, f in zip(raw, got, strict=True):
        want = set()
        for w in re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(b)):
            want.add(int(name(w)[0]))
            want |= {int(fmix(name(w[:n]) ^ np.uint64(n))[0]) for n in PREFIXES if len(w) > n}
        words = re.findall(rb"[^\x20\x09-\x0d]+", b)
        shapes = [1 << 24 if k and lower(w) == lower(words[k - 1]) else int(KIND[w[0]]) << 16 | int(KIND[w[-2 if len(w) > 1 else 0]]) << 8 | int(KIND[w[-1]]) for k, w in enumerate(words)]
        for shape in set(shapes):
            step = -(-8 * shapes.count(shape) // len(shapes))
            want |= {int(x) for x in fmix(np.uint64(shape << 4 | step) ^ COPIES)}
        assert f.tolist() == sorted({x >> 64 - BITS for x in want})
