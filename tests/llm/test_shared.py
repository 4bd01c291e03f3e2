import random

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import folioquarry.llm.common as common
import folioquarry.llm.tokens as tokens
from folioquarry.llm.common import frequent_from, salted_join


def test_salted_join_is_a_left_join(spark):
    left = spark.range(5000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.pmod("id", F.lit(400)))).alias("key"))
    right = left.groupBy("key").agg(F.count("*").alias("n")).where("key <> 'k9'")
    want = sorted(map(tuple, left.join(right, "key", "left").collect()), key=str)
    for often in (F.lit(False), F.col("n") > 100, F.lit(True)):
        assert sorted(map(tuple, salted_join(left, right, "key", often, F.xxhash64("row")).collect()), key=str) == want


def test_frequent_from(spark):
    table = spark.createDataFrame([(1,), (5,), (5,), (20_000,), (40_000,), (70_000,)], "n long")
    assert [frequent_from(table, F.lit(10), room) for room in (5, 10, 29, 30, 49, 50, 60)] == [1 << 62, 65536, 32768, 16384, 16384, 5, 1]


def test_frequent_pre_tokens_that_are_not_broadcast(spark, monkeypatch):
    """Over OFTEN rows with the same words, and room in the broadcast for none, some or all of them."""
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = [f"the cat sat {k}" if rng.random() < 0.9 else f"a dog {k % 50} the" for k in range(common.OFTEN + 4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)))
    for shared in (8, 50, 8 << 20):
        monkeypatch.setattr(tokens, "SHARED", shared)
        out = tokens.token_counts(df, path)
        assert {r.doc_id: r.n_tokens for r in out.collect()} == want
        assert ("_salt" in out._jdf.queryExecution().analyzed().toString()) == (shared < 1 << 20)
