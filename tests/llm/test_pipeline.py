import zlib
from collections import Counter, defaultdict

import corpus_pipeline as c
import numpy as np
import public_tokenizers as P
from test_minhash import brute
from test_suffix import brute as brute_spans
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    held = {}
    for name, stage in c.STAGES:
        docs = stage(spark, docs, SF).cache()
        held[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == names
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    clean = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
    q = held["quality"]
    assert len(clean & set(q.doc_id)) > 0.97 * len(clean)
    n = held["near_duplicates"]
    assert set(n.doc_id) == {r[0] for r in brute(list(zip(q.doc_id, q.text))) if r[3]}
    s = held["repeated_passages"]
    want = {r[0]: r[1] - r[2] for r in brute_spans(list(zip(n.doc_id, n.text)), c.PASSAGE)}
    assert set(s.doc_id) == set(n.doc_id) and all(0 <= want[k] - len(t.encode()) < 8 for k, t in zip(s.doc_id, s.text))
    assert (s.n_chars == s.text.str.len()).all()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in held["packing"].itertuples():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for k, t in zip(s.doc_id, s.text):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        assert sorted(pieces[k]) == [(a, len(ids[a : a + 1024]), zlib.crc32(np.array(ids[a : a + 1024], "<u4").tobytes())) for a in range(0, len(ids), 1024)]
    assert Counter(held["packing"].groupby("sequence_id").length.sum() <= 1024).keys() == {True}


def test_run(spark):
    assert c.run(spark, SF).count() > 0


def test_one_row_of_each_group_stays_and_keeps_its_text(spark):
    a, b, d, e = (" ".join(f"{w}{k}" for k in range(120)) for w in "abde")
    near = a + " more"
    rows = [(5, a), (5, a), (None, a), (9, near), (None, b), (None, b), (None, d), (None, e), (3, e), (5, e), (5, ""), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "x", len(t or "")) for k, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    out = c.near_duplicate_stage(spark, docs, SF)
    want = Counter([(5, a), (None, b), (None, d), (3, e), (5, ""), (None, None)])
    assert out.columns == docs.columns and Counter((r.doc_id, r.text) for r in out.collect()) == want
    assert Counter((r.doc_id, r.text) for r in c.repeated_passage_stage(spark, out, SF).collect()) == want


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    clean = spark.read.parquet(f"{SF}/documents.parquet").limit(5).collect()
    rows = [tuple(r) for r in clean] + [tuple(clean[0])] * 2 + [(None,) * 5, (None, "", None, None, 0), (7, None, "en", None, None), (8, "x " * 40_000, "en", "s", 80_000)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in c.STAGES:
            docs = stage(spark, docs, SF)
            if name != "packing":
                assert docs.columns == schema.names
        n = docs.count()
        assert n == 0 if not rows else n >= 0
        rows = []


def test_a_passage_of_300_bytes_that_many_documents_share_is_cut(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    passage = " ".join(f"shared{k:02d}" for k in range(34))
    assert 300 <= len(passage) < 400
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(60))
    rows = [(k, f"{own(k)} {passage} {own(k + 100)}", "en", "s", 1) for k in range(40)] + [(99, own(99), "en", "s", 1)]
    out = {r.doc_id: r.text for r in c.repeated_passage_stage(spark, spark.createDataFrame(rows, schema), SF).collect()}
    # what stands around the passage in all of them ("x59 " and " own1") goes with it
    assert out[99] == own(99) and all("shared" not in t and len(t) >= len(own(k) + own(k + 100)) - 20 for k, t in out.items() if k < 40)
