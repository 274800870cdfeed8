"""What the training-data operators share: tables, durable intermediates, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class body.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; ``lower`` would also fold other alphabets."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row.

    Catalyst inlines a column into each place that uses it, lambdas included;
    a lambda variable is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster: ``spark.checkpoint.dir``, or what the context was given.

    On one machine without either, a temporary folder; on a cluster executors
    couldn't share that, so it is an error there.
    """
    sc = spark.sparkContext
    if root := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return root
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not (root := getattr(sc, "_quillon_checkpoints", None)):
        root = sc._quillon_checkpoints = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    return root


def split_join(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``facts``, null where it has none (a left join on ``keys``; ``facts`` has each once).

    Column ``count`` of ``facts``, left out of the result, tells how many of
    the ``total`` rows have the key. Keys with more than one ``share``-th of all
    rows would each end in one task; there are fewer than ``share`` of them,
    so they are broadcast, and the other keys meet in a shuffle. Rows with a
    null key, of which a shuffle would make one group, take part in neither.
    """
    least = total // share
    more = [c for c in facts.columns if c not in (*keys, count)]
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    none = rows.where(~known).select("*", *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in more])
    rows = rows.where(known)
    heavy = facts.where(F.col(count) > least).select(*keys, *more)
    light = facts.where(F.col(count) <= least).select(*keys, *more)
    own = rows.join(F.broadcast(heavy), keys, "inner")
    return own.unionByName(rows.join(F.broadcast(heavy.select(keys)), keys, "left_anti").join(light, keys, "left")).unionByName(none)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows go to a table in the shared folder and are read again.

    A lost executor costs only the tasks that ran on it, as the files outlive it.
    The folder is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that :func:`written` made, once nothing that is still to be computed reads them."""
    for t in tables:
        remove(t.sparkSession, t._written)


def sifted(df: DataFrame, key: str, wanted: DataFrame, id_col: str, words: int = 1 << 18) -> DataFrame:
    """The rows of ``df`` whose ``key``, a long, may be among ``wanted``'s: all that are, and few others.

    Each wanted id sets one of 64 bits in one of ``words`` words, a table of
    bounded size that is broadcast. So a join that needs few of many wide rows
    shuffles few: of ids ``n``, one in ``64 * words / n`` others passes.
    """
    word = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(words))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(1), F.col(c)), F.lit(64)).cast("int"))
    marks = wanted.where(F.col(id_col).isNotNull()).groupBy(word(id_col).alias("_word")).agg(F.bit_or(bit(id_col)).alias("_bits"))
    return df.join(F.broadcast(marks), (word(key) == F.col("_word")) & (F.col("_bits").bitwiseAND(bit(key)) != 0), "left_semi")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that :func:`written` made; a stopped session keeps it."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered; bounded, as it starts anew when full."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8.

    ``bytes.lower`` folds and ``bytes.split`` splits at ASCII only.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    k = min(size, len(h))
    if not k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return acc
