"""Block maxima (A1-A3).

``max`` is a monoid: hourly -> monthly -> yearly is a chain of partial +
final aggregations, and the monthly table is reused for the yearly one
instead of re-reading the hourly data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_maxima(hourly: DataFrame, keys: list[str], ts: str = "ts", value: str = "precip") -> DataFrame:
    """Hourly rows -> one max per (keys, month) with the month's date range (A1).

    from_date is the first of the month, to_date = from + 1 month - 1 day.
    A NULL reading makes the block NULL (R ``max`` without ``na.rm``).
    """
    from_date = F.trunc(F.to_date(F.col(ts)), "month")
    has_null = F.max(F.col(value).isNull().cast("int")) > 0
    return (
        hourly.groupBy(*keys, from_date.alias("from_date"))
        .agg(F.when(has_null, F.lit(None)).otherwise(F.max(value)).alias(value))
        .withColumn("to_date", F.date_sub(F.add_months("from_date", 1), 1))
    )


def yearly_maxima(
    monthly: DataFrame, keys: list[str], value: str = "precip", first_year: int | None = None
) -> DataFrame:
    """Monthly maxima -> yearly maxima, dropping years <= ``first_year`` (A2).

    The reference drops its first, one-month year; pass that year here.
    """
    year = F.year("from_date").alias("year")
    m = monthly.withColumn("year", year)
    if first_year is not None:
        m = m.filter(F.col("year") > first_year)
    has_null = F.max(F.col(value).isNull().cast("int")) > 0
    return m.groupBy("year", *keys).agg(
        F.when(has_null, F.lit(None)).otherwise(F.max(value)).alias(value)
    )


def array_block_max(cells: DataFrame, hours: str = "hours", out_col: str = "precip") -> DataFrame:
    """Max over an hours array per row (A1 when a cell's month is one array)."""
    return cells.withColumn(out_col, F.array_max(hours))


def station_extremes(values: DataFrame, key: str = "station", value: str = "precip") -> DataFrame:
    """Per-station overall max and min (A3)."""
    return values.groupBy(key).agg(
        F.max(value).alias(f"max_{value}"), F.min(value).alias(f"min_{value}")
    )
