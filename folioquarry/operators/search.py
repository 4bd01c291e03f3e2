"""Text search by n-grams: a table of the runs of letters of each text prunes rows before LIKE looks at them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions.columns import contains

N = 3
BUCKETS = 64  # folders of the table, of which a search reads those of its grams


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_grams(rows: DataFrame, key: str, columns: list[str], path: str, n: int = N) -> None:
    """Writes (bucket, gram, place, key): each distinct run of n letters of each lower-cased text, place the column's number.
    Nulls and texts under n letters have none. A gram that many rows have is dealt out by key before it is written."""
    texts = F.array(*[F.struct(F.lit(k).alias("place"), F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("text")) for k, c in enumerate(columns)])
    each = rows.select(F.col(key).alias("key"), F.explode(texts).alias("t")).select("key", "t.place", "t.text").where(F.length("text") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda at: F.substring("text", at, n))
    grams = each.select("key", "place", F.explode(F.array_distinct(runs)).alias("gram")).withColumn("bucket", bucket(F.col("gram")))
    dealt = grams.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("bucket", "gram")
    dealt.write.partitionBy("bucket").parquet(f"{path}/rows")
    dealt.limit(0).write.parquet(f"{path}/schema")  # a table without grams leaves no other file


def grams_of(q: str, n: int = N) -> list[str]:
    """The runs that any match of q holds: those of its parts between wildcards and escapes."""
    parts = re.split(r"[%_\\]+", q.strip().lower())
    return sorted({p[k : k + n] for p in parts for k in range(len(p) - n + 1)})


def matching(spark: SparkSession, path: str, q: str, n: int = N) -> DataFrame | None:
    """(key) of rows that may hold q: those with all its grams in one column. None if q has no gram, so that all may."""
    wanted = grams_of(q, n)
    if not wanted:
        return None
    table = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")
    folders = [r.b for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(bucket(F.col("g")).alias("b")).distinct().collect()]
    found = table.where(F.col("bucket").isin(folders) & F.col("gram").isin(wanted))
    return found.groupBy("key", "place").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("key").distinct()


def gram_search(rows: DataFrame, key: str, columns: list[str], q: str | None, path: str, n: int = N) -> DataFrame:
    """rows whose columns hold q, as contains() says, found by the grams of write_grams() under path. A blank q finds all rows;
    one without a run of n letters is looked for in all rows. Rows with a null key aren't found by grams."""
    test = contains(q, *columns)
    if test is None:
        return rows
    keys = matching(rows.sparkSession, path, q, n)
    some = rows if keys is None else rows.join(keys.withColumnRenamed("key", "_gram_key"), F.col(key) == F.col("_gram_key"), "left_semi")
    return some.where(test)
