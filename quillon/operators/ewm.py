"""Exponentially weighted means, a recursion that no single window frame expresses, as a scan of affine steps over blocks.

A value takes the mean ``y`` to ``A * y + B``. Such steps compose, so that within
a block of rows the mean is ``P * (carry + S)``: ``P`` the product of the ``A`` so
far, ``S`` the sum of each ``B`` over the product up to it, both running window
sums (of logarithms and of terms). The carry of a block is the fold of the blocks
before it, a handful of pairs. A block is as long as its product stays far from
underflow, some hundred to some thousand rows.

All windows stand on the one exchange by series, in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Products of a block stay above e**-RANGE, single steps above e**-STEP, whose share in a double's digits is nil.
RANGE, STEP = 230.0, 60.0


def block_rows(alphas: list[float]) -> int:
    return max(1, min(int(RANGE / -math.log1p(-a)) if a < 1 else 1 for a in alphas))


def ewm(df: DataFrame, specs: dict[str, tuple[str, float, int]], by: str = "ticker", order: str = "date") -> DataFrame:
    """Adds ``out: (column, alpha, least)``: the mean with weights ``(1 - alpha)**age``.

    Recursive form (``y = (1 - a) * y + a * x``), started by the first value; a
    gap ages the old weight; NULL until ``least`` values have come.
    """
    keep = [x for x in df.columns if x not in specs]
    series = Window.partitionBy(by).orderBy(order)
    so_far = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = block_rows([a for _, a, _ in specs.values()])
    values = {k: F.col(c).cast("double") for k, (c, _, _) in enumerate(specs.values())}
    at = F.row_number().over(series)
    df = df.select(*keep, at.alias("_at"), *[x.alias(f"_x{k}") for k, x in values.items()])
    df = df.withColumns({"_block": F.floor((F.col("_at") - 1) / size), **{f"_d{k}": F.col("_at") - F.last(F.when(F.col(f"_x{k}").isNotNull(), F.col("_at")), ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1)) for k in values}})
    block = Window.partitionBy(by, "_block").orderBy("_at")
    run = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    logs, terms, products = {}, {}, {}
    for k, (_, alpha, _) in enumerate(specs.values()):
        x, aged = F.col(f"_x{k}"), F.exp(F.col(f"_d{k}") * (math.log1p(-alpha) if alpha < 1 else -STEP))
        weight = aged + alpha
        # The first value is the mean itself; rows without a value leave it as it is.
        logs[f"_l{k}"] = F.when(x.isNull() | F.col(f"_d{k}").isNull(), 0.0).otherwise(F.greatest(F.ln(F.greatest(aged, F.lit(math.exp(-STEP))) / weight), F.lit(-STEP)))
        terms[f"_b{k}"] = F.when(x.isNull(), 0.0).when(F.col(f"_d{k}").isNull(), x).otherwise(alpha * x / weight)
        products[f"_p{k}"] = F.sum(f"_l{k}").over(run)
    df = df.withColumns(logs | terms).withColumns(products).withColumns({f"_s{k}": F.sum(F.col(f"_b{k}") * F.exp(-F.col(f"_p{k}"))).over(run) for k in values})
    last = F.when(F.col("_at") % size == 0, F.struct("_block", *[f"_{n}{k}" for k in values for n in "ps"]))
    df = df.withColumn("_done", F.collect_list(last).over(so_far))

    def mean(k: int, least: int) -> Column:
        earlier = F.filter("_done", lambda b: b["_block"] < F.col("_block"))
        carry = F.aggregate(earlier, F.lit(0.0), lambda y, b: F.exp(b[f"_p{k}"]) * (y + b[f"_s{k}"]))
        return F.when(F.count(f"_x{k}").over(so_far) >= max(1, least), F.exp(F.col(f"_p{k}")) * (carry + F.col(f"_s{k}")))

    return df.select(*keep, *[mean(k, least).alias(out) for k, (out, (_, _, least)) in enumerate(specs.items())])
