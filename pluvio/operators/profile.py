"""Aggregates, profiles, binning and winsorising.

Exact percentiles go through :func:`group_quantiles` so every caller gets
the same linear (type 7) definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.functions.dist import is_finite
from pluvio.operators.orderstats import order_statistics
from pluvio.operators.pairs import pair_sums


def group_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], prefix: str = "q"
) -> DataFrame:
    """Exact linear-interpolation (type 7) quantiles per group, columns ``prefix`` + index of the prob.

    The two order statistics around h = (n - 1) p come from ``orderstats.order_statistics`` and
    are interpolated as v_lo + (h - lo)(v_hi - v_lo).  NULL and NaN values are ignored.
    """
    at = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    low = [F.floor(h) for h in at]
    high = [F.least(lo + 1, F.col("_n") - 1) for lo in low]
    stats = order_statistics(df, keys, value, F.array(*low, *high))
    # a handful of rows per group
    picked = stats.groupBy(*keys, "_n").agg(
        *[F.max(F.when(F.col("_rank") == r, F.col("_value"))).alias(f"_{side}{i}")
          for side, ranks in (("lo", low), ("hi", high)) for i, r in enumerate(ranks)]
    )
    value_at = [
        F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise(
            F.col(f"_lo{i}") + (h - lo) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
        )
        for i, (h, lo) in enumerate(zip(at, low, strict=True))
    ]
    return picked.select(*keys, *[v.alias(f"{prefix}{i}") for i, v in enumerate(value_at)])


def mean_sd(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean and sd by key (A4)."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def mean_na_rm(df: DataFrame, by: list[str], value: str, out_col: str = "mean") -> DataFrame:
    """Mean ignoring NULL and NaN, like ``mean(x, na.rm = TRUE)``."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.avg(F.when(~F.isnan(v), v)).alias(out_col))


def symmetric_limit(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """max(|max|, |min|): a colour scale symmetric around zero."""
    by = by or []
    return df.groupBy(*by).agg(F.greatest(F.abs(F.max(value)), F.abs(F.min(value))).alias("limit"))


def bounding_box(df: DataFrame, x: str, y: str) -> DataFrame:
    """xmin, xmax, ymin, ymax."""
    return df.agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))


def correlation_long(df: DataFrame, key: str, var: str, value: str) -> DataFrame:
    """Pearson correlations of every pair of variables, long.

    ``df`` is long (key, var, value).  Pairwise-complete: a pair uses the keys
    where both variables are present and finite.  Values are taken from their variable's mean, so that
    the sums of products do not cancel; one pass then gives all pairs (``pairs.pair_sums``).  The diagonal is NULL
    as in the reference; so is the correlation of a constant variable.
    """
    rows = df.select(key, F.col(var).alias("_var"), F.col(value).cast("double").alias("_x")).filter(is_finite("_x"))
    centre = rows.groupBy("_var").agg(F.avg("_x").alias("_m"))
    rows = rows.join(centre, "_var").withColumn("_x", F.col("_x") - F.col("_m"))
    sums = pair_sums(
        rows, key, "_var", {"one": F.lit(1.0), "x": F.col("_x"), "xx": F.col("_x") * F.col("_x")},
        {"n": ("one", "one"), "s1": ("x", "one"), "s2": ("one", "x"), "s11": ("xx", "one"), "s22": ("one", "xx"), "s12": ("x", "x")},
    )
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    spread = F.sqrt(F.greatest(F.col("s11") - s1 * s1 / n, F.lit(0.0))) * F.sqrt(F.greatest(F.col("s22") - s2 * s2 / n, F.lit(0.0)))
    corr = F.try_divide(F.col("s12") - s1 * s2 / n, spread)
    return sums.where((n > 0) | (F.col("var1") == F.col("var2"))).select(
        "var1", "var2", F.when(F.col("var1") != F.col("var2"), corr).alias("corr")
    ).withColumn("corr", F.when(F.abs("corr") > 1.0, F.signum("corr")).otherwise(F.col("corr")))


def skim(df: DataFrame, cols: list[str]) -> DataFrame:
    """Column profile: n, missing, mean, sd, p0, p25, p50, p75, p100, distinct.

    Columns are unpivoted to (variable, value) so one grouped pass profiles
    them all.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "variable", "value")
    base = long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("value").isNull().cast("long")).alias("n_missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.countDistinct("value").alias("n_distinct"),
    )
    q = group_quantiles(long.filter(F.col("value").isNotNull()), ["variable"], "value", [0.0, 0.25, 0.5, 0.75, 1.0], "p")
    return base.join(q.toDF("variable", "p0000", "p0250", "p0500", "p0750", "p1000"), "variable", "left")


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins from the (group) min to max, last bin closed.

    bin = least(floor((x - min) / w), bins - 1) with w = (max - min) / bins;
    count and density = count / (N w).  The range is a per-group aggregate
    joined back (one row per group).
    """
    by = by or []
    rng = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    j = df.join(rng, by) if by else df.crossJoin(F.broadcast(rng))
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / w), F.lit(bins - 1)).cast("int")
    j = j.withColumn("bin", F.when(w > 0, b).otherwise(F.lit(0)))
    return j.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_n").alias("_n"),
    ).select(
        *by, "bin",
        (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"),
        "n",
        F.try_divide(F.col("n"), F.col("_n") * (F.col("_hi") - F.col("_lo")) / bins).alias("density"),
    )


def fixed_histogram(df: DataFrame, value: str, lo: float, width: float, by: list[str] | None = None) -> DataFrame:
    """Counts on fixed, caller-given bins floor((x - lo) / width)."""
    by = by or []
    b = F.floor((F.col(value) - lo) / width).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def binned_2d(df: DataFrame, x: str, y: str, wx: float, wy: float, by: list[str] | None = None) -> DataFrame:
    """2-D binned counts (the density-contour re-aim)."""
    by = by or []
    return df.groupBy(
        *by, F.floor(F.col(x) / wx).cast("int").alias("bin_x"), F.floor(F.col(y) / wy).cast("int").alias("bin_y")
    ).agg(F.count(F.lit(1)).alias("n"))


def winsorise(df: DataFrame, value: str, by: list[str], lo: float, hi: float, out_col: str | None = None) -> DataFrame:
    """Clip ``value`` to its group's [q_lo, q_hi] quantiles.

    The quantiles are one row per group, joined back (AQE broadcasts when the
    groups are few, as with the 12 neighbour types).
    """
    out_col = out_col or value
    q = group_quantiles(df, by, value, [lo, hi], "_q")
    lo_c, hi_c = "_q0", "_q1"
    v = F.col(value)
    clipped = F.when(v > F.col(hi_c), F.col(hi_c)).when(v < F.col(lo_c), F.col(lo_c)).otherwise(v)
    return df.join(q, by).withColumn(out_col, clipped).drop(lo_c, hi_c)


def zscore_then_pooled_winsorise(
    df: DataFrame, value: str, group: str, exempt: str, lo: float, hi: float
) -> DataFrame:
    """z-score within ``group``, then clip to quantiles of the pooled z
    values, except rows of the ``exempt`` group (W8).

    Group moments are a grouped aggregate joined back; the pooled quantiles
    are one row cross-joined to every row.
    """
    m = df.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = df.join(m, group).withColumn(value, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")
    q = group_quantiles(z.withColumn("_all", F.lit(1)), ["_all"], value, [lo, hi], "_q").drop("_all")
    lo_c, hi_c = "_q0", "_q1"
    v = F.col(value)
    clipped = (
        F.when(F.col(group) == exempt, v)
        .when(v < F.col(lo_c), F.col(lo_c))
        .when(v > F.col(hi_c), F.col(hi_c))
        .otherwise(v)
    )
    return z.crossJoin(F.broadcast(q)).withColumn(value, clipped).drop(lo_c, hi_c)


def parameter_errors(est: DataFrame, truth: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """estimate - truth and absolute error, averaged by ``by``."""
    j = est.join(truth, keys)
    j = j.withColumn("error", F.col("estimate") - F.col("truth")).withColumn("abs_error", F.abs(F.col("error")))
    return j.groupBy(*by).agg(F.avg("error").alias("mean_error"), F.avg("abs_error").alias("mean_abs_error"))
