"""Report tables: the income pipeline and the forest table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions import text
from pluvio.operators import joins, profile, shape, windows

INCOME_UNITS = [10, 20, 30, 40, 50, 60, 70, 80, 90]


def income_units(rows: DataFrame, keys: list[str], value: str, type_label: str | None = None) -> DataFrame:
    """Per-group income quantiles (units 10..90) and the mean as one more unit.

    Output long: (*keys, unit string, type, income).  With ``type_label`` the
    rows are one source and are tagged; without it ``keys`` already holds a
    ``type`` column, so several sources share one quantile pass.
    """
    probs = [u / 100 for u in INCOME_UNITS]
    units = [str(u) for u in INCOME_UNITS]
    q = profile.group_quantiles(rows, keys, value, probs, "q").toDF(*keys, *units)
    long = q.unpivot(keys, units, "unit", "income")
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("income")).withColumn("unit", F.lit("mean"))
    out = shape.bind_rows(long, mean)
    return shape.tag(out, "type", type_label) if type_label else out


def income_pipeline(sources: list[DataFrame], cpi: DataFrame, ref_year: int, age_labels: dict[str, str]) -> DataFrame:
    """Tagged sources -> deflated -> change vs first year -> translated.

    ``sources`` are long (year, age, unit, type, income) tables; the mean unit
    is spread beside the quantile rows (R9), both deflated to ``ref_year``
    prices (J12), compared with the group's first year (W6; groups are
    (age, unit, type), so windows hold one row per year), the first year
    dropped, labels translated.
    """
    d = shape.bind_rows(*sources)
    d = shape.spread_unit(d, ["year", "age", "type"], "unit", "mean", "income", "mean_income")
    d = d.filter(F.col("unit") != "mean")
    d = joins.deflate(d, cpi, "income", "year", ref_year, "group_income")
    d = joins.deflate(d.drop("income"), cpi, "mean_income", "year", ref_year, "mean_income")
    grp = ["age", "unit", "type"]
    d = windows.ratio_to_base(d, grp, "year", "group_income", "group_change")
    d = windows.ratio_to_base(d, grp, "year", "mean_income", "mean_change")
    d = shape.filter_vs_global(d, "year", "min", ">")
    d = d.withColumn("quantile", F.col("unit").cast("int"))
    d = d.withColumn("age", text.recode(F.initcap(F.lower("age")), age_labels))
    d = d.withColumn(
        "type", F.when(F.col("type") == "total", F.lit("Total Income")).otherwise(F.lit("Salary Income"))
    )
    return d.select("year", "age", "quantile", "type", "mean_income", "group_income", "group_change", "mean_change")


def forest_table(est: DataFrame, name: str = "term", mean: str = "estimate",
                 lower: str = "conf_low", upper: str = "conf_high") -> DataFrame:
    """Estimate table with ordering and text columns for a forest plot.

    order = rank by the estimate (``fct_reorder``; the table has one row per
    term, so the window is tiny); text columns are padded two-decimal
    numbers and the merged ``mean [lower, upper]``.
    """
    t = est.select(F.col(name).alias("name"), F.col(mean).alias("mean"), F.col(lower).alias("lower"),
                   F.col(upper).alias("upper"))
    t = t.withColumn("rank_order", F.dense_rank().over(Window.orderBy("mean", "name")))
    return t.select(
        "name", "rank_order",
        F.round("mean", 6).alias("mean"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"),
        text.pad_number_text("mean").alias("mean_text"),
        text.pad_number_text("lower").alias("lower_text"),
        text.pad_number_text("upper").alias("upper_text"),
        text.interval_text(F.round("mean", 2), F.round("lower", 2), F.round("upper", 2)).alias("interval_text"),
    )
