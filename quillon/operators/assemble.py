"""One wide panel from a base and its overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(base: DataFrame, overlays: dict[str, DataFrame], keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """Left-joins overlays on the keys, all hashed alike, so that the base is exchanged once.

    A column that the base or an earlier overlay has gets the overlay's name as
    a prefix. Overlay rows without a key match nothing.
    """
    out = base.repartition(*keys)
    for name, df in overlays.items():
        fresh = [x for x in df.columns if x not in keys]
        renamed = df.select(*keys, *[F.col(x).alias(f"{name}_{x}" if x in out.columns else x) for x in fresh])
        out = out.join(renamed, list(keys), "left")
    return out


def with_sector(base: DataFrame, master: DataFrame) -> DataFrame:
    """Sector and industry of the base, else of the reference master: one column each, never two with suffixes."""
    own = [x for x in ("sector", "industry") if x in base.columns]
    both = base.join(master.select("ticker", *[F.col(x).alias(f"_m_{x}") for x in ("sector", "industry")]), "ticker", "left")
    for x in ("sector", "industry"):
        both = both.withColumn(x, F.coalesce(x, f"_m_{x}") if x in own else F.col(f"_m_{x}"))
    return both.drop("_m_sector", "_m_industry")
