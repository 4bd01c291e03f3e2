"""Pages with bounded sizes, metadata, whitelisted sorts and heads of groups. Every order ends in a key, so ties are settled."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioquarry.sources.work import work_dir


def bounds(page: int | None, size: int | None, most: int = 100, usual: int = 20) -> tuple[int, int]:
    return max(page or 0, 0), usual if not size or size <= 0 else min(size, most)


def page(df: DataFrame, order: list[Column], number: int | None = 0, size: int | None = 20, most: int = 100) -> DataFrame:
    number, size = bounds(number, size, most)
    return df.orderBy(*order).offset(number * size).limit(size)


def page_meta(df: DataFrame, number: int = 0, size: int = 20, most: int = 100) -> DataFrame:
    """One row: total_elements, total_pages, first, last. Pass the frame before dimension joins: the count is cheaper."""
    number, size = bounds(number, size, most)
    n = df.agg(F.count("*").alias("total_elements")).withColumn("total_pages", F.ceil(F.col("total_elements") / size).cast("long"))
    return n.withColumn("first", F.lit(number == 0)).withColumn("last", F.lit(number) >= F.col("total_pages") - 1)


def sort_order(text: str | None, allowed: dict[str, str], usual: str, key: str = "id") -> list[Column]:
    """'property,direction' by a whitelist; an unknown property raises."""
    name, _, direction = (text or usual).partition(",")
    if name not in allowed:
        raise ValueError(f"can't sort by {name}")
    c = F.col(allowed[name])
    return [c.desc_nulls_last() if direction.strip().lower() == "desc" else c.asc_nulls_last(), F.col(key)]


def head_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group; null keys are a group."""
    n = f"n_{uuid.uuid4().hex}"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


class PageIndex:
    """A result kept by ranges of its order, with the number of rows in each: any page is read from the range or two it lies in.

    Beyond the first pages, an offset sorts all rows before it each time; here they were sorted once."""

    def __init__(self, spark: SparkSession, path: str, order: list[Column]):
        self.spark, self.path, self.order = spark, path, order
        sizes = spark.read.parquet(f"{path}/sizes").orderBy("range").collect()  # a row a range
        self.sizes = [(r.range, r.n) for r in sizes]
        self.total = sum(n for _, n in self.sizes)

    @classmethod
    def build(cls, df: DataFrame, order: list[Column], path: str | None = None, ranges: int = 64) -> PageIndex:
        """df dealt into `ranges` by `order`, which ends in a key, so that ties are settled."""
        path = path or work_dir(df.sparkSession)
        dealt = df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
        dealt.sortWithinPartitions(*order).write.partitionBy("range").parquet(f"{path}/rows")
        df.limit(0).write.parquet(f"{path}/schema")  # an empty result leaves no other file
        rows = df.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
        rows.groupBy("range").agg(F.count("*").alias("n")).write.parquet(f"{path}/sizes")
        return cls(df.sparkSession, path, order)

    def page(self, number: int | None = 0, size: int | None = 20, most: int = 100) -> DataFrame:
        """As page() gives it; pages beyond the last are empty."""
        number, size = bounds(number, size, most)
        first, before, skip, here = number * size, 0, 0, []
        for k, n in self.sizes:
            if before < first + size and before + n > first:
                skip = first - before if not here else skip
                here.append(k)
            before += n
        schema = self.spark.read.parquet(f"{self.path}/schema").schema.add("range", "integer")
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        return rows.where(F.col("range").isin(here)).orderBy(*self.order).offset(max(skip, 0)).limit(size).drop("range")

    def meta(self, number: int = 0, size: int = 20, most: int = 100) -> DataFrame:
        """As page_meta() gives it, from the ranges' sizes."""
        number, size = bounds(number, size, most)
        pages = -(-self.total // size)
        return self.spark.createDataFrame([(self.total, pages, number == 0, number >= pages - 1)], "total_elements long, total_pages long, first boolean, last boolean")
