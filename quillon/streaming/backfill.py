"""Backfills that can be stopped at any point: batches of new rows into a history by date, each committed once.

The history is a folder of ``date=.../version=<batch>`` partitions and a folder
of commits. A batch reads the newest committed version of the dates that it has
rows of, merges its rows, and writes these dates anew as its own version; its
commit, one file that appears by a rename, makes all of them visible at once. So

* a batch that is stopped before its commit has written nothing that anyone
  reads, and is done again from the same state;
* a batch that is delivered again after its commit is left out, as its number is
  known (a stream repeats its last batch when the driver was lost between the
  commit here and its own);
* readers during a batch see the state before it.

Only the dates of a batch are read and written, whatever the length of the
history. :func:`vacuum` removes versions that a newer one has replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "version"


@dataclass(frozen=True)
class History:
    """A table of one row per ``keys``: of rows with equal keys the one that is last by ``newest`` stays, of equal ones that of the later batch.

    ``schema`` has the keys, ``newest`` and ``date``, a date column by which the
    folder is partitioned. Rows without a date are left out.
    """

    path: str
    schema: str
    keys: tuple[str, ...]
    newest: tuple[str, ...]
    date: str = "date"

    def _path(self, spark: SparkSession, *parts: str) -> tuple[JavaObject, JavaObject]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path.rstrip("/"), *parts)))
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, spark: SparkSession, *parts: str) -> list[str]:
        fs, where = self._path(spark, *parts)
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def commits(self, spark: SparkSession) -> dict[int, list[str]]:
        """Batches that are committed, with the dates (as folder names) of each."""
        out = {}
        for name in self._names(spark, "commits"):
            if name.isdigit():
                fs, where = self._path(spark, "commits", name)
                stream = fs.open(where)
                try:
                    out[int(name)] = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return out

    def newest_versions(self, spark: SparkSession) -> dict[str, int]:
        """For each date's folder the last batch that committed it: a name and a number per date."""
        return {d: batch for batch, dates in sorted(self.commits(spark).items()) for d in dates}

    def read(self, spark: SparkSession, dates: set[str] | None = None) -> DataFrame:
        """The committed rows, of some dates' folders only if these are given."""
        chosen = [f"{self.path.rstrip('/')}/data/{d}/{VERSION}={v}" for d, v in self.newest_versions(spark).items() if dates is None or d in dates]
        fields = T.StructType.fromDDL(self.schema)
        if not chosen:
            return spark.createDataFrame([], fields)
        stored = T.StructType([*fields.fields, T.StructField(VERSION, T.LongType())])
        return spark.read.schema(stored).option("basePath", f"{self.path.rstrip('/')}/data").parquet(*chosen).select(*fields.names)

    def commit(self, fresh: DataFrame, batch: int) -> bool:
        """Merges a batch; false if it was committed before."""
        spark = fresh.sparkSession
        if str(batch) in self._names(spark, "commits"):
            return False
        fresh = fresh.where(F.col(self.date).isNotNull()).select(*T.StructType.fromDDL(self.schema).names)
        # One row per date of the batch.
        days = {f"{self.date}={r[0].isoformat()}" for r in fresh.select(self.date).distinct().collect()}
        both = self.read(spark, days).withColumn("_batch", F.lit(0)).unionByName(fresh.withColumn("_batch", F.lit(1)))
        rest = [c for c in both.columns if c not in (*self.keys, "_batch")]
        last = F.max_by(F.struct(*rest), F.struct(*self.newest, "_batch")) if rest else F.first("_batch")
        merged = both.groupBy(*self.keys).agg(last.alias("_row")).select(*self.keys, *([f"_row.{c}" for c in rest]))
        if days:
            # What an earlier attempt at this batch has left is replaced.
            # Rows of a date meet in a task, but a date that has more than the others is divided at run time.
            out = merged.withColumn(VERSION, F.lit(batch).cast("long")).hint("rebalance", F.col(self.date))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.date, VERSION).parquet(f"{self.path.rstrip('/')}/data")
        self._publish(spark, batch, sorted(days))
        return True

    def _publish(self, spark: SparkSession, batch: int, days: list[str]) -> None:
        fs, staged = self._path(spark, "commits", f"_{batch}")
        _, final = self._path(spark, "commits", str(batch))
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(days).encode()))
        out.close()
        if not fs.rename(staged, final):
            raise RuntimeError(f"batch {batch} is committed by another writer")

    def vacuum(self, spark: SparkSession) -> int:
        """Deletes versions that a newer committed one has replaced; returns how many. Not while someone reads."""
        newest, gone = self.newest_versions(spark), 0
        for day, last in newest.items():
            for name in self._names(spark, "data", day):
                v = name.removeprefix(f"{VERSION}=")
                if v.isdigit() and int(v) < last:
                    fs, where = self._path(spark, "data", day, name)
                    fs.delete(where, True)
                    gone += 1
        return gone


def backfill(stream: DataFrame, history: History, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
    """Takes what the stream's source has now, batch by batch, and stops; returns how many batches it took.

    Started again with the same checkpoint, it goes on after the last batch that
    it finished. ``prepare`` is applied to each batch.
    """
    query = stream.writeStream.foreachBatch(lambda df, batch: history.commit(prepare(df), batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)
