"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.llm.common import saved, work_dir
from folioquarry.llm.flac import pcm_rows, read_back, stored
from folioquarry.llm.importance import resampled
from folioquarry.llm.licenses import licence_scan
from folioquarry.llm.lm import scored
from folioquarry.llm.minhash import near_duplicates
from folioquarry.llm.packing import packed
from folioquarry.llm.phrases import collocations
from folioquarry.llm.pieces import encoded
from folioquarry.llm.quality import fit, rated
from folioquarry.llm.suffix import without_repeats
from folioquarry.llm.tokens import token_counts
from folioquarry.llm.topk import exact_top_k
from folioquarry.llm.warc import archived


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rated(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(documents(spark, sf_dir)).drop("spans")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir), length=400, passage=200)


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # PCM blocks are written and read back. The streams go from encoder to decoder: written as well, they alone would take
    # 1.5 times the disk of the compressed texts.
    return read_back(saved(pcm_rows(stored(documents(spark, sf_dir))), "pcm", work_dir(spark), compression="zstd"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=50257)  # one beyond the vocabulary


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), least=30, longest=4, most=2000, inside=80)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), most=1, buckets=10_000, seed=2024, percent=10, least_words=20)


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=100)


OP1_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM d
), sized AS (SELECT r, doc_id, len(s) AS n, s FROM sets),
each AS (SELECT r, n, unnest(s) AS s FROM sized),
links AS (
  SELECT a.r AS a, b.r AS b FROM each a JOIN each b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, o) AS (SELECT r, r FROM sized UNION SELECT reach.r, e.b FROM reach JOIN both_ways e ON e.a = reach.o)
SELECT x.doc_id, CAST(x.n AS BIGINT) AS n_shingles, min(y.doc_id) AS component_id, x.doc_id IS NOT DISTINCT FROM min(y.doc_id) AS kept
FROM reach JOIN sized x ON x.r = reach.r JOIN sized y ON y.r = reach.o GROUP BY x.r, x.doc_id, x.n
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS r, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM (SELECT coalesce(lang, 'und') AS lang, {LOWERED} AS t FROM documents)
), words AS (SELECT r, lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (SELECT lang, k, phrase, count(*) AS n FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY 1),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
held AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS more FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY 1, 2
), cuts AS (
  SELECT c.lang, c.phrase, a, j, array_to_string(w[1 : j], ' ') AS x, array_to_string(w[j + 1 : k], ' ') AS y
  FROM (SELECT c.*, unnest(range(1, k)) AS j FROM c LEFT JOIN held USING (lang, phrase) WHERE more IS NULL OR 100 * more < 80 * a) c
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, f.n AS l, g.n AS r, CAST(CAST(2000000 AS HUGEINT) * a // (f.n + g.n) AS BIGINT) AS score, j FROM cuts JOIN f ON f.lang = cuts.lang AND f.phrase = x JOIN f g ON g.lang = cuts.lang AND g.phrase = y
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, rank, phrase, a, l, r, total.n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN total USING (lang) WHERE rank <= 2000
"""

OP12_SQL = f"""
WITH step AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS s),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
each AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY 1, 2),
words AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, sum(n) AS s, 0 AS t FROM each GROUP BY 1 UNION ALL SELECT word, 0, count(*) FROM (SELECT unnest(w) AS word FROM b) GROUP BY 1) GROUP BY 1),
coded AS (SELECT *, hex(encode(word)) AS h FROM words),
hashed AS (
  SELECT word, coded.s, t, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1)),
    lambda c, x: xor(c >> 8, step.s[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM coded, step
), gain AS (SELECT bucket, floor(1000 * ln(((sum(t) + 1) * ((SELECT sum(s) FROM words) + 10000)) / CAST((sum(s) + 1) * ((SELECT sum(t) FROM words) + 10000) AS DOUBLE))) AS g FROM hashed GROUP BY 1),
weight AS (SELECT r, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight FROM each JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT d.r, doc_id, len(w) AS n, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || CAST(doc_id AS VARCHAR)), 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d LEFT JOIN weight USING (r)
), ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank, count(*) OVER () AS total FROM scored WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= total * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""

OP13_SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT *, first_value(page_id) OVER w AS head, row_number() OVER w AS turn FROM p WINDOW w AS (PARTITION BY CASE WHEN n >= 100 THEN html ELSE CAST(r AS VARCHAR) END, n >= 100 ORDER BY page_id NULLS LAST, r))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN turn > 1 THEN head END AS refers_to FROM q
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op7_exact_top_k": OP7_SQL, "op11_phrase_collocations": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_warc_archive": OP13_SQL}
