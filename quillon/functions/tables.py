"""Table functions for SQL: a table and settings in, rows out; the schema follows from the arguments.

``register`` makes them known to a session::

    SELECT * FROM text_chunks(TABLE(filings), 'ticker', 'text', 1200, 5)
    SELECT * FROM latest_filings(TABLE(filings) PARTITION BY ticker ORDER BY filed_at DESC, '8-K')

Rows of a table argument stay in their partitions unless ``PARTITION BY`` asks
for groups; a function keeps nothing between rows but what its docstring says.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillon.operators.text import pieces


def constant(name: str, a: AnalyzeArgument, kind: type) -> object:
    if not a.isConstantExpression or not isinstance(a.value, kind):
        raise ValueError(f"{name} must be a constant {kind.__name__}")
    return a.value


def field(table: AnalyzeArgument, name: str) -> T.StructField:
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    if name not in table.dataType.names:
        raise ValueError(f"the table has no column {name}")
    return table.dataType[name]


class TextChunks:
    """(key, ``chunk``, ``text``): the pieces of a text column, for each row by itself. A null text has none."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        own = field(table, constant("key", key, str))
        if not isinstance(field(table, constant("text", text, str)).dataType, T.StringType):
            raise ValueError("text must be a string column")
        if constant("size", size, int) < 1 or constant("most", most, int) < 1:
            raise ValueError("size and most must be positive")
        return AnalyzeResult(T.StructType([own, T.StructField("chunk", T.IntegerType()), T.StructField("text", T.StringType())]))

    def eval(self, row: Row, key: str, text: str, size: int, most: int) -> Iterator[tuple]:
        for n, piece in enumerate(pieces(row[text], size, most)):
            yield row[key], n, piece


class LatestFilings:
    """The first row of each group whose ``form_type`` starts with a prefix, with ``seen``, the rows of the group up to there; nothing for a group without one.

    Call it with ``PARTITION BY`` and ``ORDER BY``; it keeps one number per group.
    """

    def __init__(self) -> None:
        self.seen, self.found = 0, False

    @staticmethod
    def analyze(table: AnalyzeArgument, prefix: AnalyzeArgument) -> AnalyzeResult:
        field(table, "form_type")
        constant("prefix", prefix, str)
        return AnalyzeResult(T.StructType([*table.dataType.fields, T.StructField("seen", T.IntegerType())]))

    def eval(self, row: Row, prefix: str) -> Iterator[tuple]:
        self.seen += 1
        if not self.found and (row["form_type"] or "").startswith(prefix):
            self.found = True
            yield (*row, self.seen)


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_chunks", udtf(TextChunks))
    spark.udtf.register("latest_filings", udtf(LatestFilings))
