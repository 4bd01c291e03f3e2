"""Settings, append-only sinks and run logs as tables.

A run log is appended to, never changed: a run's row is the last one with its id, so writers don't lock each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = 1000  # keys at most that are read to the driver
LOG = "run_id string, job string, at timestamp, status string, total long, succeeded long, failed long, message string"


class Settings:
    """Key-value settings (key, value as text) with defaults: a missing or unreadable number falls back, then is clamped."""

    def __init__(self, table: DataFrame):
        rows = table.select("key", "value").limit(SETTINGS + 1).collect()
        if len(rows) > SETTINGS:
            raise ValueError(f"more than {SETTINGS} settings")
        self.values = {r.key: r.value for r in rows}

    def number(self, key: str, default: int, least: int | None = None, most: int | None = None) -> int:
        try:
            n = int(self.values[key])
        except (KeyError, TypeError, ValueError):
            n = default
        n = n if least is None else max(n, least)
        return n if most is None else min(n, most)

    def flag(self, key: str, default: bool) -> bool:
        """A value that isn't "true" in any case is false; only a missing key falls back."""
        return str(self.values[key]).lower() == "true" if key in self.values else default


def setting_numbers(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """Settings as a query. wanted: key, fallback, least, most. (key, number): the fallback where the text is no number."""
    j = wanted.join(table.select("key", "value"), "key", "left")
    number = F.coalesce(F.when(F.col("value").rlike("^[+-]?[0-9]+$"), F.expr("try_cast(value AS INT)")), F.col("fallback"))
    return j.select("key", F.least(F.greatest(number, F.col("least")), F.col("most")).cast("long").alias("number"))


def append(df: DataFrame, path: str) -> int:
    """Adds rows to a Parquet table; the number of rows added."""
    seen, watch = F.count(F.lit(1)), Observation()
    df.observe(watch, seen.alias("n")).write.mode("append").parquet(path)
    return int(watch.get["n"])


def append_copies(rows: DataFrame, path: str) -> int:
    """New copies as they are stored: book_id, barcode, status, condition, location, created_at, updated_at."""
    return append(rows.select("book_id", "barcode", "status", "condition", "location", "created_at", "updated_at"), path)


def received_events(callbacks: DataFrame) -> DataFrame:
    """callbacks: id, payment_code, event_type, params (map), headers (map). An event row as it is received: the provider's
    own parameters (vnp_...) as JSON with sorted keys, other parameters dropped. Null maps are empty."""
    ours = F.map_filter(F.coalesce("params", F.create_map().cast("map<string,string>")), lambda k, v: k.startswith("vnp_"))
    json = lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    return callbacks.select(
        "id", "payment_code", "event_type", json(ours).alias("payload"),
        json(F.coalesce("headers", F.create_map().cast("map<string,string>"))).alias("headers"), F.lit("RECEIVED").alias("processing_status"),
    )


class EventSink:
    """A table of received_events() that a stream writes with foreachBatch, each micro-batch once.

    A batch goes into a folder of its own, named by the stream and the batch's number. Spark marks the folder when it is
    whole; a batch that comes again, since its stream died before it was noted, finds the mark and is not written, and one
    that was left unfinished is written anew. A stream that begins with a new checkpoint counts from 0 again and so needs a
    name of its own."""

    def __init__(self, path: str, stream: str):
        self.path, self.stream = path.rstrip("/"), stream

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{self.path}/stream={self.stream}/batch={number}"
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            received_events(batch).write.mode("overwrite").parquet(folder)

    def start(self, callbacks: DataFrame, checkpoint: str):
        """Writes a stream of callbacks; availableNow, so that it ends with what is there."""
        return callbacks.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def stored(self, spark: SparkSession) -> DataFrame:
        """All events, with their stream and batch; folders that aren't marked as whole are left out."""
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stream=*/batch=*/_SUCCESS")
        found = top.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(top) or []
        whole = [f.getPath().getParent().toString() for f in found]
        return spark.read.option("basePath", self.path).parquet(*whole)


def progress(job_id: str, good: DataFrame, errors: DataFrame) -> DataFrame:
    """The deltas that a batch adds to its job: (job_id, processed, succeeded, failed)."""
    both = good.agg(F.count("*").alias("succeeded")).crossJoin(errors.agg(F.count("*").alias("failed")))  # two single rows
    return both.select(F.lit(job_id).alias("job_id"), (F.col("succeeded") + F.col("failed")).alias("processed"), "succeeded", "failed")


def cut(message: str | None, most: int = 2000) -> str | None:
    return message if message is None else message[:most]


def logged(spark: SparkSession, path: str, job: str, work: Callable[[], tuple[int, int]], states: tuple[str, ...] = ("RUNNING",)) -> tuple[int, int]:
    """Runs work() -> (succeeded, failed) between rows of `states` and a COMPLETED or FAILED one; errors are raised again."""
    run = uuid.uuid4().hex

    def say(status: str, good: int = 0, bad: int = 0, message: str | None = None) -> None:
        spark.createDataFrame([(run, job, datetime.now(timezone.utc), status, good + bad, good, bad, cut(message))], LOG).write.mode("append").parquet(path)

    for state in states:
        say(state)
    try:
        good, bad = work()
    except Exception as e:
        say("FAILED", message=str(e))
        raise
    say("COMPLETED", good, bad)
    return good, bad


def runs(log: DataFrame) -> DataFrame:
    """The state of each run: its last row, with when it began and, once it is over, ended."""
    over = F.col("status").isin("COMPLETED", "FAILED")
    rank = F.struct(over.alias("over"), (F.col("status") != "PENDING").alias("begun"), "at")
    done = F.max_by(F.struct("job", "status", "total", "succeeded", "failed", "message", "at", over.alias("over")), rank)
    g = log.groupBy("run_id").agg(F.min("at").alias("started_at"), done.alias("s"))
    return g.select(
        "run_id", "s.job", "started_at", F.when(F.col("s.over"), F.col("s.at")).alias("finished_at"), "s.status", "s.total", "s.succeeded", "s.failed",
        "s.message",
    )
