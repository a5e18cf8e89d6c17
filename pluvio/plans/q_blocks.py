"""Block-maximum queries (A1-A3) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvio.operators import blocks
from pluvio.plans.fixtures import Fixtures
from pluvio.plans.oracle_fixtures import with_ctes
from pluvio.plans.registry import query

# The fixture's first year; like the reference's one-month first year it is
# dropped from the yearly table.
FIRST_YEAR = 1995


@query(
    "monthly_maxima",
    "A1",
    with_ctes("SELECT station, from_date, to_date, precip FROM monthly", "monthly"),
)
def monthly_maxima(spark, sf):
    fx = Fixtures(spark, sf)
    return blocks.monthly_maxima(fx.hourly(), ["station"]).select("station", "from_date", "to_date", "precip")


@query(
    "yearly_maxima",
    "A2",
    with_ctes(
        "SELECT CAST(year(from_date) AS INTEGER) AS year, station, max(precip) AS precip "
        f"FROM monthly WHERE year(from_date) > {FIRST_YEAR} GROUP BY 1, 2",
        "monthly",
    ),
)
def yearly_maxima(spark, sf):
    fx = Fixtures(spark, sf)
    # the first-year cut restated on the raw timestamp, so it reaches the
    # Parquet scan as a pushed filter (row groups of dropped years are skipped)
    start = F.lit(f"{FIRST_YEAR + 1}-01-01 00:00:00").cast("timestamp_ntz")
    monthly = blocks.monthly_maxima(fx.hourly().filter(F.col("ts") >= start), ["station"])
    return blocks.yearly_maxima(monthly, ["station"], first_year=FIRST_YEAR)


@query(
    "station_extremes",
    "A3",
    with_ctes(
        "SELECT station, max(precip) AS max_precip, min(precip) AS min_precip FROM precip GROUP BY station",
        "precip",
    ),
)
def station_extremes(spark, sf):
    return blocks.station_extremes(Fixtures(spark, sf).precip())
