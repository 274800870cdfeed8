"""Mixing sources to target weights by Poisson replication.

Each document is repeated a number of times drawn from a Poisson distribution
whose mean is the repetition rate of its source: the source's share of the
target size over its size in the corpus. The draw inverts the distribution at a
uniform number made from a hash of seed and document, so that it depends on no
partitioning and is the same after a retry. One aggregate finds the sizes (a row
per source and task is shuffled), one shuffle by the hash of document and copy
puts the copies in a random order over all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import let, written

#: A rate is split into parts of at most this mean, whose draws add up: exp(-mean) stays far from 0.
PART = 32
#: The inversion of a part stops here; the rest of the distribution is below 1e-15 for a mean of ``PART``.
STEPS = 128
#: Up to so many rates are broadcast.
MOST_SOURCES = 100_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the parts, joined by ``|``; a null part counts as ``~``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson(rate: Column, seed: int, *key: Column) -> Column:
    """A Poisson draw of mean ``rate`` by inversion, fixed by seed and key."""

    def invert(u: Column, mean: Column) -> Column:
        """The number of values whose distribution function is at most ``u``."""
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))

        def step(a: Column, _: Column) -> Column:
            p = a["p"] * mean / (a["n"] + 1)
            return F.when(u >= a["c"], F.struct(p.alias("p"), (a["c"] + p).alias("c"), (a["n"] + 1).alias("n"))).otherwise(a)

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda a: a["n"])

    def drawn(given: Column) -> Column:
        draws = F.transform(F.sequence(F.lit(1), given["parts"]), lambda k: let(uniform(seed, *[given[f"k{i}"] for i in range(len(key))], k), lambda u: invert(u, given["mean"])))
        return F.aggregate(draws, F.lit(0), lambda s, x: s + x)

    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    return let(F.struct(parts.alias("parts"), (rate / parts).alias("mean"), *[c.alias(f"k{i}") for i, c in enumerate(key)]), drawn)


def rates(docs: DataFrame, weights: dict[str, float], source: str = "source", text: str = "text", epochs: float = 1.0) -> DataFrame:
    """(``source``, ``size`` in characters, ``rate``) for each source.

    ``weights`` are relative to each other and set the shares of the target,
    ``epochs`` times the corpus. A source that isn't listed, the null source
    included, gets the weight of its natural share, as the listed ones' weights
    together stand for theirs. Sources without characters have rate 0.
    """
    # ``weights`` is written by hand, so that its size is that of a configuration.
    sizes = written(docs.groupBy(source).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("size")))
    listed = F.col(source).isin(*weights) if weights else F.lit(False)
    weight = F.coalesce(*[F.when(F.col(source) == k, F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    known = F.coalesce(listed, F.lit(False))
    total = sizes.agg(F.coalesce(F.sum(F.when(known, F.col("size"))), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(known & (F.col("size") > 0), weight)), F.lit(0.0)).alias("weight")).first()
    share = F.when(known, F.try_divide(weight * F.lit(total["size"]), F.lit(total["weight"]))).otherwise(F.col("size"))
    return sizes.select(source, "size", F.coalesce(F.try_divide(share * epochs, F.col("size")), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", source: str = "source", text: str = "text", epochs: float = 1.0, seed: int = 11) -> DataFrame:
    """``docs`` with each row repeated, in random order, and ``copy`` (from 0).

    Rows are told apart by id and text: repeated rows get one draw each, which
    is the same. Null and empty texts have no characters but are drawn like the
    rest of their source; a column named ``copy`` is replaced.
    """
    docs = docs.drop("copy")
    known = written(rates(docs, weights, source, text, epochs).select(F.col(source).alias("_q_source"), F.col("rate").alias("_q_rate")))
    # One row per source, sent to all if there are few; else joined by shuffle, where AQE splits a hot source.
    if known.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        known = F.broadcast(known)
    both = docs.join(known, docs[source].eqNullSafe(F.col("_q_source")), "left").drop("_q_source")
    n = poisson(F.coalesce("_q_rate", F.lit(0.0)), seed, F.col(id_col), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    # One explode, so that the draw is made once: an empty list drops the row.
    copies = let(n, lambda x: F.when(x > 0, F.sequence(F.lit(0), x - 1)).otherwise(F.array().cast("array<int>")))
    out = both.select(*docs.columns, F.explode(copies).alias("copy"))
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col("copy"), F.col(text))
    return out.withColumn("_q_order", order).repartition("_q_order").sortWithinPartitions("_q_order").drop("_q_order")
