"""State that outlives a run: numbered Parquet snapshots and a pointer that moves when one is whole."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """Versions of a table in a folder of any file system that Spark reads.

    A version is written to a folder of its own first; then a small pointer file ``v<number>`` that names
    the folder is put in place by a rename, which either happens or does not.  The highest pointer is the
    current version, so a write that breaks off leaves the one before.  A pointer also holds the batch
    that made it, and a batch is written once.  One writer at a time: a second one that takes the same
    number fails at its rename.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(f"{self.folder}/pointers").getFileSystem(spark._jsc.hadoopConfiguration())

    def pointers(self) -> list[tuple[int, str, str]]:
        """(number, folder, batch) of the versions, oldest first."""
        at = self.path(f"{self.folder}/pointers")
        if not self.files.exists(at):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(at)]
        found = (name.split("~", 2) for name in names if name.startswith("v"))
        return sorted((int(number[1:]), data, batch) for number, data, batch in found)

    def current(self) -> DataFrame:
        """The current version's rows; none before the first."""
        return self.version(-1)

    def version(self, place: int) -> DataFrame:
        """A version by its place in time, as in a list; no rows where there is none."""
        versions = self.pointers()
        if not versions or not -len(versions) <= place < len(versions):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{versions[place][1]}")

    def write(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Make ``rows`` the current version; False, and nothing done, where ``batch`` made one already."""
        batch, versions = batch or uuid.uuid4().hex, self.pointers()
        if "~" in batch or "/" in batch:
            raise ValueError("a batch's name holds neither ~ nor /")
        if any(b == batch for _, _, b in versions):
            return False
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{data}")
        self.point(versions[-1][0] + 1 if versions else 0, data, batch)
        return True

    def point(self, number: int, data: str, batch: str) -> None:
        waiting = self.path(f"{self.folder}/waiting/{uuid.uuid4().hex}")
        target = f"{self.folder}/pointers/v{number:012d}~{data}~{batch}"
        if any(n == number for n, _, _ in self.pointers()):
            raise RuntimeError(f"version {number} of {self.folder} was written by another run")
        self.files.mkdirs(self.path(posixpath.dirname(target)))
        self.files.create(waiting).close()
        if not self.files.rename(waiting, self.path(target)):
            raise RuntimeError(f"could not put {target} in place")


def progress(store: Snapshots, now: DataFrame, keys: list[str]) -> DataFrame:
    """``now`` (keys, synced, pending) beside the run before: before, delta and stalled.

    The run before is read from ``store``, and this one becomes its current version.  A run is stalled
    where something is pending and no more is synced than before; the first run never is, and its before
    and delta are null.  Without keys both are one row.
    """
    earlier = store.current().select(*keys, F.col("synced").alias("before"))
    joined = now.join(earlier, keys, "left") if keys else now.join(F.broadcast(earlier), how="left")
    delta = F.col("synced") - F.col("before")
    stalled = F.coalesce((delta <= 0) & (F.col("pending") > 0), F.lit(False))
    store.write(joined.select(*keys, "synced", "pending", "before", delta.alias("delta"), stalled.alias("stalled")))
    return store.current()
