"""Window operators (W rows of the survey).

Windows partitioned by a key with no natural bound on its size would put a
whole key into one task.  Every window here is partitioned by a key whose
group size is bounded by construction (station x years, chain x lags, one
block of ids) or runs on an aggregate that is already small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvio.operators.orderstats import average_ranks


def dense_row_number(
    df: DataFrame,
    partition_cols: list[str],
    order_col: str,
    out_col: str = "row_number",
    block_size: int = 1 << 20,
) -> DataFrame:
    """``row_number() over (partition by p order by o)`` without one task per key.

    ``order_col`` must be an integral key unique within each partition (an id).
    Rows are cut into blocks of ``block_size`` consecutive ids, numbered
    inside a block (a window bounded by ``block_size`` rows), and shifted by
    the number of rows in the earlier blocks of the same key (a running sum
    over the small per-block count table).  A hot key that holds a third of
    all rows is therefore spread over many tasks.  Ids should be roughly dense
    (event ids, iterations): with very sparse ids the block table approaches
    one row per id.
    """
    block = F.floor(F.col(order_col) / F.lit(block_size)).alias("_blk")
    with_blk = df.withColumn("_blk", block)
    keys = partition_cols + ["_blk"]
    local = with_blk.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys).orderBy(order_col))
    )
    counts = with_blk.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*partition_cols).orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(run), F.lit(0))).drop("_n")
    return (
        local.join(offsets, on=keys, how="inner")
        .withColumn(out_col, F.col("_off") + F.col("_local"))
        .drop("_blk", "_local", "_off")
    )


def average_rank_uniform(df: DataFrame, by: list[str], value: str, out_col: str = "u") -> DataFrame:
    """Empirical CDF with average ranks for ties: u = avg_rank / (n + 1).

    The average rank of a tie group is rank + (count_in_tie - 1) / 2, which
    needs only ``rank`` and a count over the tie, both windowed by ``by``.
    For groups bounded by construction (a station's months); for groups of
    any size use :func:`global_average_rank_uniform`.
    """
    w = Window.partitionBy(*by).orderBy(value)
    tie = Window.partitionBy(*by, value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    avg_rank = F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2.0
    return df.withColumn(out_col, avg_rank / (n + 1))


def ratio_to_base(df: DataFrame, by: list[str], period: str, value: str, out_col: str) -> DataFrame:
    """value / value at the first period of the group - 1.

    ``min_by`` over an unordered window needs no self-join.
    """
    base = F.min_by(F.col(value), F.col(period)).over(Window.partitionBy(*by))
    return df.withColumn(out_col, F.try_divide(F.col(value), base) - 1.0)


def global_average_rank_uniform(df: DataFrame, by: list[str], value: str, out_col: str = "u") -> DataFrame:
    """Empirical CDF u = average rank / (n + 1) for groups of any size (W11); NULL and NaN values are left out."""
    ranked = average_ranks(df, by, value, "_arank", "_n")
    return ranked.withColumn(out_col, F.col("_arank") / (F.col("_n") + 1)).drop("_arank", "_n")
