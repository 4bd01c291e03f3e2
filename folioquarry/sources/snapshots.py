"""Tables that change together: numbered versions, to which readers switch at once.

A version is a small file that says in which folder each table lies. New tables are written first, into folders that no
version names yet; then the version's file is moved into place under the next number, which fails if another writer was
first. A run that dies before that leaves folders that nobody reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """Versions of a set of tables under `path`, in any store that Spark writes and that moves files atomically."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _place(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def version(self) -> int | None:
        """The last version's number; None before the first."""
        folder = self._place("versions")
        files = folder.getFileSystem(self._conf)
        if not files.exists(folder):
            return None
        numbers = [int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit()]
        return max(numbers, default=None)

    def folders(self, version: int | None = None) -> dict[str, str]:
        """Table to folder in a version, the last one if none is given."""
        version = self.version() if version is None else version
        if version is None:
            return {}
        row = self.spark.read.text(f"{self.path}/versions/{version:012d}", wholetext=True).first()
        return json.loads(row.value)

    def read(self, *names: str, version: int | None = None) -> list[DataFrame]:
        """Tables of one version: all are as that version's writer left them."""
        at = self.folders(version)
        return [self.spark.read.parquet(at[n]) for n in names]

    def commit(self, tables: dict[str, DataFrame], based_on: int | None) -> int:
        """Writes tables, then makes them the version after `based_on` (None: the first), with that one's other tables.

        RuntimeError if there is a later version already: the caller reads anew and tries again."""
        at = {} if based_on is None else self.folders(based_on)
        run = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/data/{run}/{name}")
            at[name] = f"{self.path}/data/{run}/{name}"
        number = 0 if based_on is None else based_on + 1
        new = self._place(f"data/{run}/version")
        files = new.getFileSystem(self._conf)
        out = files.create(new, False)
        out.write(json.dumps(at).encode())
        out.close()
        files.mkdirs(self._place("versions"))
        none = self.spark._sc._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            self._fs.FileContext.getFileContext(files.getUri(), self._conf).rename(new, self._place(f"versions/{number:012d}"), none)
        except Exception as e:
            raise RuntimeError(f"version {number} is there already") from e
        return number

    def change(self, work: Callable[[list[DataFrame]], dict[str, DataFrame]], *names: str, tries: int = 5) -> int:
        """commit(work(tables)), with the tables of the last version, again from the start if another writer was faster."""
        for _ in range(tries):
            version = self.version()
            try:
                return self.commit(work(self.read(*names, version=version)), version)
            except RuntimeError:
                if self.version() == version:
                    raise
        raise RuntimeError(f"{tries} other writers were faster")
