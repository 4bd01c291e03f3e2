"""A corpus from documents: quality classifier, near-duplicate removal, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. No stage can be put in SQL (a trained model, hashed signatures with connected
components, byte windows, a linear program), so ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.llm.common import saved, work_dir
from folioquarry.llm.minhash import kept_keys
from folioquarry.llm.packing import packed
from folioquarry.llm.quality import fit, good
from folioquarry.llm.suffix import kept_texts

ORACLE_SQL = None
PASSAGE = 200  # bytes: 50 words of three letters and a space, so that a passage of over 50 words is longer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the classifier, fitted on the labels, rejects. Null texts count as empty; equal texts get equal
    grades, so repeated rows go or stay together; an empty table stays empty."""
    return good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: the smallest doc_id, nulls last; of rows repeated under it, one. Blank texts all stay.

    A second row of a text must not stay: the next stage would take both for repeated passages and empty them. Rows are
    numbered in a written copy, since the numbers would change if docs were computed again."""
    key = f"row_{uuid.uuid4().hex}"
    keyed = saved(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    kept = kept_keys(keyed, key).withColumnRenamed("key", key)
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes covered by strings of PASSAGE bytes that also start elsewhere; n_chars, where there is one, follows the
    text. Null texts stay null; rows that are emptied stay, with an empty text; ties don't occur; an empty table stays empty."""
    out = kept_texts(docs, length=PASSAGE)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 1024 ids, as packed() says; null texts count as empty, repeated rows are packed
    each by itself, and an empty table gives no piece."""
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=0)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("repeated_passages", repeated_passage_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name, folder)
    return docs
