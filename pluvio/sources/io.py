"""Parquet / CSV sources and sinks, partitioned layouts, nested tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet write (S5); with ``partition_by`` a Hive layout ``chain=i/``."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet read; lazy, with partition discovery for Hive layouts."""
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; an explicit schema when given, else inferred."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema else r.option("inferSchema", True)
    return r.csv(path)


def nest_estimates(long: DataFrame, key: str = "station", name: str = "name", value: str = "value") -> DataFrame:
    """(key, name, value) rows -> key, par array<struct<name, value>>.

    The array is sorted by name so the nested value is deterministic; a
    station has a handful of parameters, so each array is small.
    """
    return long.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(value).alias("value")))).alias("par")
    )


def unnest_estimates(nested: DataFrame, col: str = "par") -> DataFrame:
    """Inverse of :func:`nest_estimates`."""
    keep = [c for c in nested.columns if c != col]
    return nested.select(*keep, F.inline(col))


def to_sql_view(df: DataFrame, name: str) -> DataFrame:
    """Hand a lazy table to SQL (S14): register a temp view, return it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Inline literal table."""
    return spark.createDataFrame(rows, schema)
