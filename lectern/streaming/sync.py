"""Structured Streaming forms of the incremental operators.

* ``replay_stream``: a mutation log to the live state of each key, by foreachBatch
  upserts into a versioned table: each batch writes the next version, then the
  version's marker, so a reader never sees half a batch and a crash loses none.
* ``windowed_counts``: event-time windows with a watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, by: Sequence[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and key; events later than the watermark are left out, state older than it is dropped."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


class VersionedTable:
    """A folder of numbered table states. A version counts from the moment its marker file stands, which is written last
    and whole by a rename; markers are never taken away before a newer one stands, so a crash at any point leaves the
    last complete version in place."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(n[len("done-") :]) for n in names if n.startswith("done-") and n[len("done-") :].isdigit())

    def version(self) -> int | None:
        found = self.versions()
        return found[-1] if found else None

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/v{v}")

    def write(self, state: DataFrame, version: int) -> None:
        state.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self._fs.create(self._at(f"_next-{version}"), True).close()
        if not self._fs.exists(self._at(f"done-{version}")):
            self._fs.rename(self._at(f"_next-{version}"), self._at(f"done-{version}"))
        self._fs.delete(self._at(f"_next-{version}"), False)
        for old in self.versions()[: -self.keep]:
            self._fs.delete(self._at(f"done-{old}"), False)  # the marker first: a state is never readable in part
            self._fs.delete(self._at(f"v{old}"), True)


def replay_stream(log: DataFrame, target: VersionedTable, key: str, seq: Sequence[str], removing: Column, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the last operation of each key; ``removing`` marks operations that delete. Removed keys stay as markers, so late older operations don't revive them."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        order = F.struct(*seq)
        columns = [c for c in batch.columns if c != key]
        new = batch.withColumn("_gone", removing)
        old = target.read()
        # a batch that ran before is applied to the version it started from again; last-operation-wins makes that harmless
        both = new if old is None else old.unionByName(new)
        last = both.groupBy(key).agg(F.max_by(F.struct(*columns, "_gone"), order).alias("x")).select(key, "x.*")
        target.write(last, batch_id + 1 if (target.version() or 0) <= batch_id else (target.version() or 0) + 1)

    writer = log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live(target: VersionedTable) -> DataFrame:
    state = target.read()
    if state is None:
        raise ValueError("nothing has been written yet")
    return state.where(~F.coalesce("_gone", F.lit(False))).drop("_gone")
