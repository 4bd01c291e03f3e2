"""Rows in an order within keys, however many rows a key has: running sums, nearest rows, allocation under limits.

A window over one key would put all its rows in one task. Here rows are first dealt into ranges of the order, whatever
their keys; what a key's earlier ranges hold comes as one row a range, and a window sees a key's rows of one range alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.sources.work import saved, work_dir

FIRST = Window.unboundedPreceding


def micros(c: Column | str) -> Column:
    """A moment as microseconds."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def in_ranges(df: DataFrame, *order: str, folder: str | None = None) -> DataFrame:
    """df, written once, with _range: rows of a later range are later in `order` (ascending, nulls last)."""
    by = [F.asc_nulls_last(c) for c in order]
    return saved(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges", folder)


def earlier_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df, as in_ranges() gives it, with a column for each of `sums`: over the rows of its keys that come before; 0 for none.
    Null keys are keys like others."""
    by = [F.asc_nulls_last(c) for c in order]
    rows = df.withColumns({f"_own_{n}": c for n, c in sums.items()} | {"_mark": F.lit(1)})
    totals = rows.groupBy(*keys, "_range").agg(*[F.sum(f"_own_{n}").alias(f"_own_{n}") for n in sums])
    ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(FIRST, -1)  # a row a range
    before = totals.select(*keys, "_range", F.lit(0).alias("_mark"), *[F.sum(f"_own_{n}").over(ranges).alias(f"_own_{n}") for n in sums])
    # What came before a range stands as its key's first row there: rows move once, and there is no join.
    within = Window.partitionBy(*keys, "_range").orderBy("_mark", *by).rowsBetween(FIRST, -1)
    both = rows.unionByName(before, allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    return both.select(*df.columns, "_mark", *[F.coalesce(F.sum(f"_own_{n}").over(within), zero).alias(f"_sum_{n}") for n in sums]).where("_mark = 1").select(
        *df.columns, *[F.col(f"_sum_{n}").alias(n) for n in sums],
    )


def nearest(probes: DataFrame, points: DataFrame, keys: list[str], value: str, forward: bool = False, inclusive: bool = True) -> DataFrame:
    """probes: keys, t, row (unique); points: keys, t, tie, value. (row, value) of the point at t or before it, the last by t and
    tie, or, forward, at t or after it, the first; not at t itself unless inclusive. Probes without one, or with a null t, get
    no row; a null key meets null keys. t and tie are longs."""
    sign = -1 if forward else 1
    first, last = (0, 1) if inclusive else (1, 0)
    null, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    at = (F.col("t") * sign).alias("_t")
    p = points.select(*keys, at, F.lit(first).alias("_side"), (F.col("tie") * sign).alias("_tie"), F.struct(F.col(value).alias("v")).alias("_v"), null.alias("_row"))
    none = F.lit(None).cast(p.schema["_v"].dataType)
    q = probes.where("t IS NOT NULL").select(*keys, at, F.lit(last).alias("_side"), zero.alias("_tie"), none.alias("_v"), F.col("row").alias("_row"))
    order = ["_t", "_side", "_tie"]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_range") == F.col("_at"))
    rows = in_ranges(p.union(q), *order)
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(FIRST, 0)
    ends = rows.where("_v IS NOT NULL").groupBy(*keys, "_range").agg(F.max_by("_v", F.struct(*order)).alias("_v"))
    there = rows.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_at")).distinct()
    all_ = ends.join(there, same, "right")
    ranges = Window.partitionBy(*[f"_of_{k}" for k in keys]).orderBy("_at").rowsBetween(FIRST, -1)  # a row a range
    before = all_.select(*[f"_of_{k}" for k in keys], "_at", F.last("_v", ignorenulls=True).over(ranges).alias("_before"))
    found = rows.withColumn("_found", F.last("_v", ignorenulls=True).over(within)).where("_row IS NOT NULL").join(before, same)
    return found.select(F.col("_row").alias("row"), F.coalesce("_found", "_before").alias("_f")).where("_f IS NOT NULL").select("row", F.col("_f.v").alias(value))


def numbered(rows: DataFrame, order: list[str], top: DataFrame) -> DataFrame:
    """rows with id: after the largest of top (id), in order, numbered range by range."""
    dealt = in_ranges(rows.withColumn("_one", F.lit(1)), *order)
    most = top.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))  # one row
    n = earlier_sums(dealt, ["_one"], order, {"_before": F.lit(1).cast("long")})
    return n.crossJoin(F.broadcast(most)).withColumn("id", F.col("_top") + F.col("_before") + 1).drop("_one", "_before", "_top", "_range")


LIMITS = ("member", "item", "pair")


def allocated(requests: DataFrame) -> DataFrame:
    """requests: row (unique), at, id, member, item, pair, room, free, able. All columns, with granted and, as it was when the
    request's turn came, how many requests were granted to its member, of its item and of its pair (had_member, had_item,
    had_pair). As if requests were taken one by one by at (nulls last), id and row: one that is able is granted if its member
    has had fewer than `room`, its item fewer than `free` and its pair none; refused ones use up nothing.

    In rounds: a request is granted once all that are open before it, granted or not, can't use up its limits, and refused
    once those granted before it have. The first open one is always decided, and as requests of other members and items
    don't wait for each other, rounds grow with the longest chain of requests that wait for one another."""
    folder = work_dir(requests.sparkSession)
    order = ["at", "id", "row"]
    rows = in_ranges(requests, *order, folder=folder)
    zero = F.lit(0).cast("long")
    open_ = rows.where(F.coalesce("able", F.lit(False))).select(
        "row", "at", "id", *LIMITS, "room", "free", "_range", *[zero.alias(f"had_{k}") for k in LIMITS], F.lit(None).cast("boolean").alias("granted"),
    )
    grants, step = [], 0
    while True:
        for k in LIMITS:
            sums = {f"_new_{k}": F.coalesce("granted", F.lit(False)).cast("long"), f"_open_{k}": F.col("granted").isNull().cast("long")}
            open_ = earlier_sums(open_, [k], order, sums)
        now = open_.where("granted IS NULL").withColumns({f"had_{k}": F.col(f"had_{k}") + F.col(f"_new_{k}") for k in LIMITS})
        no = (F.col("had_member") >= F.col("room")) | (F.col("had_item") >= F.col("free")) | (F.col("had_pair") > 0)
        yes = (F.col("had_member") + F.col("_open_member") < F.col("room")) & (F.col("had_item") + F.col("_open_item") < F.col("free")) & (F.col("_open_pair") == 0)
        decided = now.withColumn("granted", F.when(F.coalesce(no, F.lit(True)), False).when(yes, True))
        open_ = saved(decided.drop(*[f"_{w}_{k}" for w in ("new", "open") for k in LIMITS]), f"round-{step}", folder)
        grants.append(open_.where("granted").select("row"))
        step += 1
        if open_.where("granted IS NULL").isEmpty():
            break
    given = reduce(DataFrame.union, grants).withColumn("granted", F.lit(True))
    rows = rows.join(given, "row", "left").withColumn("granted", F.coalesce("granted", F.lit(False)))
    for k in LIMITS:
        rows = earlier_sums(rows, [k], order, {f"had_{k}": F.col("granted").cast("long")})
    return rows.drop("_range")


def segments(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans: keys, id, since, until (longs; until null: for ever), value (long). (keys, t, value): from t on, until the key's
    next t, the value of the span that began last, ties to the larger id; null where none is in force.

    Spans are streamed by key and time through a heap of those in force."""
    columns = ("id", "since", "until", "value")
    starts = spans.select(*keys, F.col("since").alias("t"), *columns)
    stops = spans.where("until IS NOT NULL").select(*keys, F.col("until").alias("t"), *[F.lit(None).cast("long").alias(c) for c in columns])
    dealt = starts.union(stops).where("t IS NOT NULL").repartition(*keys).sortWithinPartitions(*keys, "t")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spans.select(*keys).schema) + ", t long, value long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, heap, moment = None, [], None
        for pdf in frames:
            out = []
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                own, (t, id_, since, until, value) = row[: len(keys)], row[len(keys) :]
                if own != key:
                    key, heap = own, []
                if id_ is not None and (until is None or until > since):
                    heapq.heappush(heap, (-since, -id_, until, value))
                while heap and heap[0][2] is not None and heap[0][2] <= t:
                    heapq.heappop(heap)
                out.append((*own, t, heap[0][3] if heap else None))
            frame = pd.DataFrame(out, columns=[*keys, "t", "value"])
            yield frame.astype({"t": "Int64", "value": "Int64"})

    each = dealt.mapInPandas(run, schema).withColumn("_n", F.monotonically_increasing_id())
    return each.groupBy(*keys, "t").agg(F.max_by(F.struct("value"), "_n").alias("_v")).select(*keys, "t", "_v.value")  # the last word of a moment
