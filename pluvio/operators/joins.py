"""Join helpers (J rows).

Only literal and one-row tables are broadcast by hand; other joins are left to
the shuffle join that AQE may convert at runtime.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crossing(*dfs: DataFrame) -> DataFrame:
    """tidyr ``crossing``: de-duplicated Cartesian product of small sides.

    Sides are distinct value lists (parameter grids, coordinate axes); all but
    the first are broadcast.  Sorting is left to the caller's ``orderBy``.
    """
    first, *rest = [d.distinct() for d in dfs]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rest, first)


def expand_grid(*dfs: DataFrame) -> DataFrame:
    """Cartesian product keeping duplicates."""
    first, *rest = dfs
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rest, first)


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """%in% a computed key set."""
    return df.join(keys, on, "left_semi")


def deflate(df: DataFrame, cpi: DataFrame, value: str, year: str, ref_year: int, out_col: str) -> DataFrame:
    """Convert ``value`` to prices of ``ref_year`` with an index table.

    ``cpi`` has (year, cpi); the reference-year index is a one-row aggregate
    cross-joined back.  The index table is one row per year: broadcast.
    """
    ref = cpi.filter(F.col("year") == ref_year).select(F.col("cpi").alias("_cpi_ref"))
    c = cpi.select(F.col("year").alias(year), F.col("cpi").alias("_cpi_t"))
    return (
        df.join(F.broadcast(c), year, "inner")
        .crossJoin(F.broadcast(ref))
        .withColumn(out_col, F.col(value) * F.col("_cpi_ref") / F.col("_cpi_t"))
        .drop("_cpi_ref", "_cpi_t")
    )
