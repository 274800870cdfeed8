"""The corpus pipeline: documents to a training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's input.
All but the last return the columns of ``documents``.

Ids are integers. Null and empty texts fail the quality rules and go there; a
row without an id is never a copy of another, and passes like any other. Rows
that repeat one id are repeats of one row: they get one verdict in each stage,
so they stay or go together, and are drawn alike. Extra columns, whatever
their names, pass through. An empty table gives an empty mix.

The near-dedup stage takes five-word shingles and a similarity of 0.8, as all
stages on word shingles do; the two-word shingles of ``op1_near_dedup`` are that
query's own setting.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, line_dedup, mix_sources, near_dedup, quality_rules
from quillon.llm.common import checkpoint_root, remove, table
from quillon.llm.queries import MIX_WEIGHTS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and of the others the lines above the limit."""
    out = quality_rules.apply_rules(docs, clean=True).where("kept").select(docs.columns)
    return sized(out)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents that this leaves without a word."""
    return sized(line_dedup.without_repeats(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id; ids are compared as they are."""
    gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the target weights and put in random order."""
    return mix_sources.mix(docs, MIX_WEIGHTS)


def sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where it was known."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind))).select(docs.columns)


STAGES = [
    ("9 quality rules", quality),
    ("7 line dedup", lines),
    ("1 MinHash near-dedup", near),
    ("2 benchmark decontamination", benchmark),
    ("5 mixing to target weights", mixing),
]

#: MinHash bands, components and edit distances are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{checkpoint_root(spark).rstrip('/')}/quillon-stage-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        atexit.register(remove, spark, path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
