"""Sinks: Parquet, CSV, status JSON, upserts into a history that is partitioned by date."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession

from quillon.operators.universe import merge_sources


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the context's checkpoint folder; a temporary one on a single machine only."""
    sc = spark.sparkContext
    if root := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not (root := getattr(sc, "_quillon_scratch", None)):
        root = sc._quillon_scratch = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    return root


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/quillon-io-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a writer of Spark's has committed a table there."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that :func:`stored` made, once nothing that is still to be computed reads them."""
    for t in tables:
        discard(t.sparkSession, t._stored)


def rewritten(spark: SparkSession, path: str, change) -> str:
    """Replaces a table by ``change`` of it; the old one stays at the path that is returned, from which the new one is made."""
    old = f"{path.rstrip('/')}.bak"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here, there = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, old))
    fs = here.getFileSystem(conf)
    fs.delete(there, True)
    fs.rename(here, there)
    change(spark.read.parquet(old)).write.parquet(path)
    return old


def model(fitted: MLWritable, path: str) -> None:
    fitted.write().overwrite().save(path)


def parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """One file, for snapshots of a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def upsert(spark: SparkSession, fresh: DataFrame, path: str, keys: tuple[str, ...], date: str = "date") -> None:
    """Replaces the dates that ``fresh`` has, with the history's other rows of those dates kept unless their key is fresh.

    Only those dates' partitions are read and written. The merged rows go to a
    staging path first, as Spark can't overwrite what it reads.
    """
    staged = f"{path.rstrip('/')}.staged"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(conf).exists(where):
        old = spark.read.parquet(path).join(fresh.select(date).distinct(), date, "left_semi")
        merged = merge_sources(old.select(fresh.columns), fresh, keys=keys)
    else:
        merged = fresh
    merged.write.mode("overwrite").parquet(staged)
    spark.read.schema(merged.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)
    gone = jvm.org.apache.hadoop.fs.Path(staged)
    gone.getFileSystem(conf).delete(gone, True)


def status(df: DataFrame, path: str, **more: object) -> dict:
    """One aggregated row as a JSON object, written as text beside its table."""
    row = {k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in df.first().asDict().items()} | more
    df.sparkSession.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return row
