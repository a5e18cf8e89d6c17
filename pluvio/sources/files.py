"""File listings, file names and per-file scans.

Files are input splits: a directory is read by one ``spark.read`` and the
file each row came from is the hidden ``_metadata.file_path`` column, so the
reference's per-file loop becomes a single scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# The gridded source's file-name layout and its period token.
PERIOD_PATTERN = r"_([0-9]{8})-([0-9]{8})"
FILE_PREFIX = "pr_rcp85_land-cpm_uk_5km_01_1hr_"
FILE_SUFFIX = ".nc"


def split_listing(listing: DataFrame, text: str = "listing", out_col: str = "filename") -> DataFrame:
    """One newline-joined listing string -> one row per file name.

    Empty pieces (the trailing newline) are dropped.
    """
    keep = [c for c in listing.columns if c != text]
    return (
        listing.select(*keep, F.explode(F.split(F.col(text), "\n")).alias(out_col))
        .filter(F.col(out_col) != "")
    )


def parse_period(df: DataFrame, filename: str = "filename") -> DataFrame:
    """``..._YYYYMMDD-YYYYMMDD.nc`` -> from_date, to_date.

    to_date is recomputed as from_date + 1 month - 1 day (the source uses a
    360-day calendar in names; the real month end is kept, as in the code).
    """
    from_txt = F.regexp_extract(F.col(filename), PERIOD_PATTERN, 1)
    from_date = F.to_date(from_txt, "yyyyMMdd")
    return df.withColumn("from_date", from_date).withColumn(
        "to_date", F.date_sub(F.add_months(F.col("from_date"), 1), 1)
    )


def period_filename(from_date: Column, to_day: int = 30) -> Column:
    """The file name the gridded source uses for a month starting at ``from_date``."""
    start = F.date_format(from_date, "yyyyMMdd")
    end = F.concat(F.date_format(from_date, "yyyyMM"), F.lpad(F.lit(str(to_day)), 2, "0"))
    return F.concat(F.lit(FILE_PREFIX), start, F.lit("-"), end, F.lit(FILE_SUFFIX))


def scan_with_file(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read every file under ``path`` and tag rows with their file."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"))


def grid_to_long(
    grid: DataFrame, values: str, n_x: int, out_col: str = "precip", row_col: str | None = None
) -> DataFrame:
    """Column-major cells (x fastest) -> rows with proj_x, proj_y, station.

    ``values`` is an array column.  Without ``row_col`` it holds a whole grid:
    position k (0-based) is cell x = k % n_x + 1, y = k div n_x + 1.  With
    ``row_col`` it holds one lattice row y = row_col (1-based) and k gives x.
    station = (y - 1) n_x + x is the row number by (proj_y, proj_x),
    computed without a global sort.
    """
    keep = [c for c in grid.columns if c not in (values, row_col)]
    extra = [F.col(row_col).alias("_row")] if row_col else []
    cells = grid.select(*keep, *extra, F.posexplode(values).alias("_k", out_col))
    if row_col:
        x = (F.col("_k") + 1).cast("int")
        y = F.col("_row").cast("int")
    else:
        x = (F.col("_k") % n_x + 1).cast("int")
        y = (F.floor(F.col("_k") / n_x) + 1).cast("int")
    return (
        cells.withColumn("proj_x", x)
        .withColumn("proj_y", y)
        .withColumn("station", ((F.col("proj_y") - 1) * n_x + F.col("proj_x")).cast("int"))
        .drop("_k", "_row")
    )


def list_files(spark: SparkSession, path: str, name: str = "*") -> DataFrame:
    """The files under ``path`` as rows: path, length, modified.  Their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def latest_run(listing: DataFrame, run: Column) -> DataFrame:
    """The last run in name order of a file listing, one row (``run``); ``run`` is a file's run, null for other files."""
    return listing.agg(F.max(run).alias("run"))


def run_of(path: str | Column = "path") -> Column:
    """The run of a file written by :func:`write_sampler_csv`: its folder ``run=<name>``, else null."""
    name = F.regexp_extract(path, r"/run=([^/]+)/", 1)
    return F.when(name != "", name)


def write_sampler_csv(wide: DataFrame, path: str, run: str, file_col: str, order_col: str, settings: list[str]) -> None:
    """Write draws the way a sampler does (S11): a CSV per value of ``file_col`` under ``path/run=<run>``, with ``#`` lines
    of settings before the header and a closing ``#`` line.

    Rows stand in order of ``order_col``; NULLs are empty fields.  A file is written by one task,
    as it is one chain.
    """
    header = F.lit(",".join(wide.columns))
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in wide.columns])
    body = wide.select(F.col(file_col).alias("file"), F.lit(1).alias("_part"), F.col(order_col).cast("long").alias("_at"), text.alias("value"))
    head = F.array(*[F.lit(f"# {s}") for s in settings], header)
    names = wide.select(F.col(file_col).alias("file")).distinct()
    before = names.select("file", F.lit(0).alias("_part"), F.posexplode(head).alias("_at", "value"))
    after = names.select("file", F.lit(2).alias("_part"), F.lit(0).alias("_at"), F.lit("# done").alias("value"))
    lines = before.unionByName(body).unionByName(after).repartition("file").sortWithinPartitions("file", "_part", "_at")
    lines.select("file", "value").write.mode("overwrite").partitionBy("file").text(f"{path.rstrip('/')}/run={run}")


def read_latest_run(spark: SparkSession, path: str, id_cols: list[str], schema: str | None = None) -> DataFrame:
    """Long draws of the last run under ``path``; no other run's files are read.

    Only the run's name comes to the driver.  Raises when there is no run.
    """
    run = latest_run(list_files(spark, path), run_of()).first().run
    if run is None:
        raise FileNotFoundError(f"no run under {path}")
    return read_sampler_csv(spark, f"{path.rstrip('/')}/run={run}", id_cols, schema)


@udtf(returnType="chain int, iteration bigint, name string, value double")
class SamplerDraws:
    """The draws of one sampler file, given as its bytes: a row per iteration and parameter.

    ``#`` and empty lines are passed over; the columns ``chain`` and ``iteration`` identify a row; an empty
    field is a NULL draw.  A null file has no draws.
    """

    def eval(self, content: bytes):
        import csv
        import io

        if content is None:
            return
        lines = (x for x in io.TextIOWrapper(io.BytesIO(content), "utf-8", newline="") if x.strip() and not x.startswith("#"))
        for row in csv.DictReader(lines):
            chain, iteration = int(row.pop("chain")), int(row.pop("iteration"))
            for name, value in row.items():
                yield chain, iteration, name, float(value) if value else None


def sampler_draws(spark: SparkSession, path: str, name: str = "*") -> DataFrame:
    """Draws of every sampler file under ``path``, each file's by one call of :class:`SamplerDraws`, with
    the file they come from (X4)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path)
    draws = found.lateralJoin(SamplerDraws(F.col("content").outer()))
    return draws.select(F.col("path").alias("source_file"), "chain", "iteration", "name", "value")


def read_sampler_csv(spark: SparkSession, path: str, id_cols: list[str], schema: str | None = None) -> DataFrame:
    """Sampler CSV (``#`` comments, wide header) -> long draws.

    Every non-id column becomes a (name, value) row; NULLs are kept.  Files in folders below are read too.
    """
    reader = spark.read.option("header", True).option("comment", "#").option("recursiveFileLookup", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    wide = reader.csv(path)
    value_cols = [c for c in wide.columns if c not in id_cols]
    return wide.unpivot(id_cols, value_cols, "name", "value")
