"""Projection, filter and reshape operators (P, R, U rows).

Most are one DataFrame call; they are named here so pipelines read like the
dplyr/tidyr originals and the quirks (NULL handling, fixed pivot values,
first-match renames) are decided once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.dist import is_finite


def relocate(df: DataFrame, front: list[str]) -> DataFrame:
    """``select(front, everything())``."""
    return df.select(*front, *[c for c in df.columns if c not in front])


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` inclusive (``mu0:delta``)."""
    cols = df.columns
    return cols[cols.index(first): cols.index(last) + 1]


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """``select(-(first:last))``."""
    return df.drop(*column_range(df, first, last))


def rename_positions(df: DataFrame, mapping: dict[int, str]) -> DataFrame:
    """Rename by 1-based position (``rename(tekjur = 5)``)."""
    names = list(df.columns)
    for pos, new in mapping.items():
        names[pos - 1] = new
    return df.toDF(*names)


def filter_finite(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Keep rows where every named (default: every numeric) column is finite."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    if not cols:
        return df
    return df.filter(reduce(lambda a, b: a & b, [is_finite(c) for c in cols]))


def filter_vs_global(df: DataFrame, col: str, agg: str = "min", op: str = ">") -> DataFrame:
    """Filter against a one-row global aggregate (``ar > min(ar)``).

    The aggregate is one row, so it is broadcast to every partition.
    """
    g = df.agg(getattr(F, agg)(col).alias("_g"))
    cond = {">": F.col(col) > F.col("_g"), "<": F.col(col) < F.col("_g"),
            ">=": F.col(col) >= F.col("_g"), "<=": F.col(col) <= F.col("_g")}[op]
    return df.crossJoin(F.broadcast(g)).filter(cond).drop("_g")


def drop_incomplete_groups(df: DataFrame, keys: list[str], present: str) -> DataFrame:
    """Drop every row of a ``keys`` group that has a NULL in ``present``.

    The long-form equivalent of ``select(where(~!any(is.na(.x))))``: a
    left-anti join against the set of incomplete groups.
    """
    incomplete = df.filter(F.col(present).isNull()).select(*keys).distinct()
    return df.join(incomplete, keys, "left_anti")


def pivot_wider(
    df: DataFrame, ids: list[str], names_from: str, values_from: str, values: list, prefix: str = ""
) -> DataFrame:
    """``pivot_wider`` with an explicit value list.

    The list keeps the schema fixed and avoids the extra distinct job.
    """
    out = df.groupBy(*ids).pivot(names_from, values).agg(F.first(values_from))
    if prefix:
        out = out.toDF(*ids, *[f"{prefix}{v}" for v in values])
    return out


def pivot_longer(df: DataFrame, ids: list[str], cols: list[str] | None, names_to: str, values_to: str) -> DataFrame:
    """``pivot_longer``; NULL values are kept, as tidyr does (R2)."""
    cols = cols if cols is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(ids, cols, names_to, values_to)


def nest(df: DataFrame, keys: list[str], out_col: str = "data") -> DataFrame:
    """``nest(data = -keys)``: one array of row structs per key.

    Each nested group must be small (a station's years, a type's stations).
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias(out_col))


def unnest(df: DataFrame, col: str = "data") -> DataFrame:
    """``unnest(col)``: array of structs back to rows."""
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.inline(col))


def row_vectors(df: DataFrame, key: str, index: str, value: str, out_col: str = "x") -> DataFrame:
    """Wide matrix row as ``array<double>`` sorted by ``index``.

    A row is one key's D margins (D small), so the array is bounded by D.
    """
    return df.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))),
                    lambda s: s["v"]).alias(out_col)
    )


def spread_unit(df: DataFrame, group: list[str], unit_col: str, unit: str, value: str, out_col: str) -> DataFrame:
    """Put the value of the ``unit`` row of each group beside every row."""
    w = Window.partitionBy(*group)
    return df.withColumn(out_col, F.max(F.when(F.col(unit_col) == unit, F.col(value))).over(w))


def bind_rows(*dfs: DataFrame) -> DataFrame:
    """``bind_rows``: union by name, missing columns filled with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def tag(df: DataFrame, col: str, value) -> DataFrame:
    """Constant tag column (P20)."""
    return df.withColumn(col, F.lit(value))


def first_k_groups(df: DataFrame, group_stats: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """Worst/best-k groups by a statistic, then their rows.

    ``group_stats`` is one row per key; ties are broken by the key.
    """
    top = group_stats.orderBy(*order, F.col(key)).limit(k).select(key)
    return df.join(F.broadcast(top), key, "left_semi")
