import random

import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioquarry.llm.pieces import decoded, encoded, pieces
from folioquarry.llm.tokens import count_column, token_counts

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
tok = Tokenizer.from_file(BYTE)
sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
HARD = ["", " ", "  ", "   x", "a  b   c    d" + " " * 50 + "e", "▁a ▁▁", "a▁b", "\n\ta\r\n", "<|endoftext|> x<|endoftext|><|endoftext|>", "I'll it's 'tis", "été çà œ", "\x00\x01", "日本語テキスト。🙂👍🏽", "ﬁ 　 \xa0", "x" * 3000, "aAbB" * 500, "=" * 700, "<s></s><unk><0x41>", "\U000e0001퟿", "é ال", "123456789 1,000.00%", " 's" + " " * 9 + "\n \n"]


def check(texts):
    assert count_column(texts, BYTE) == [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    p = pieces(PIECE)
    for t in texts:
        ids = sp.encode(t)
        assert p.encode(t) == ids, t
        assert p.decode(ids) == sp.decode(ids), t


def test_hard_texts():
    check(HARD)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    check([t, t.replace("0", " ") + " and the " + t])


def test_letters():
    rng = random.Random(3)
    check(["".join(rng.choice("abcdeinorst  ") for _ in range(rng.randrange(200))) for _ in range(300)])
    check(["".join(rng.choice(" ▁ab\n") for _ in range(rng.randrange(60))) for _ in range(300)])
    p = pieces(PIECE)
    for _ in range(300):
        ids = [rng.randrange(3, 32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(12)]
        assert p.decode(ids) == sp.decode(ids)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in token_counts(docs, BYTE).collect():
        n = len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    for r in encoded(docs, PIECE).collect():
        assert list(r.ids) == sp.encode(texts[r.doc_id]) and r.decoded == sp.decode(list(r.ids))


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, "")], "doc_id long, text string").selectExpr("*", "3 AS n_tokens")
    assert sorted(token_counts(df, BYTE).collect(), key=str) == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 3, 2, False), (2, 0, 0, False)], key=str)
    ids = encoded(df, PIECE)
    assert sorted((r.doc_id, list(r.ids)) for r in ids.where("doc_id = 1").collect()) == [(1, []), (1, [])]
    assert {r.text for r in decoded(ids, PIECE).collect()} == {"", "a b"}
    assert token_counts(df.limit(0), BYTE).count() == 0 and encoded(df.limit(0), PIECE, digests=True).count() == 0


def test_rare_pre_tokens_are_joined(spark, monkeypatch):
    """With room for few broadcast entries, most counts come through the shuffled join."""
    import folioquarry.llm.tokens as t

    rng = random.Random(8)
    rows = [(k % 40, " ".join(rng.choice(["the", "word", f"n{rng.randrange(900)}", "x" * 30, "é\n"]) for _ in range(rng.randrange(60)))) for k in range(300)] + [(None, None), (1, ""), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pieces", "2 AS n")
    want = sorted([(k, len((x or "").encode()), len(tok.encode(x or "", add_special_tokens=False).ids)) for k, x in rows], key=str)
    for shared in (0, 200, 1 << 20):
        monkeypatch.setattr(t, "SHARED", shared)
        assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(df, BYTE).collect()], key=str) == want
