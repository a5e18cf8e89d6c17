"""Model-shaped tables derived from the driver tables (FIXTURES.md part 2).

Each method is lazy: it returns a DataFrame plan over the Parquet scans, so
Catalyst prunes columns and pushes filters into the files.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.operators import lattice, windows


#: Entries of each vector of the embeddings table.
EMBEDDING_SIZE = 64


def _shared(fn):
    """One DataFrame per fixture and instance: every use of e.g. ``precip``
    in a query is the same logical subtree, so Spark reuses its exchange
    instead of scanning and aggregating the raw table twice."""

    @wraps(fn)
    def wrapper(self, *args):
        key = (fn.__name__, args)
        if key not in self._memo:
            self._memo[key] = fn(self, *args)
        return self._memo[key]

    return wrapper


def margin_pairs(unif: DataFrame) -> DataFrame:
    """(vec_id, pair, u1, u2): the margins (2k - 1, 2k) of every vector side by side."""
    first = F.col("dim") % 2 == 1
    return unif.groupBy("vec_id", F.floor((F.col("dim") + 1) / 2).cast("int").alias("pair")).agg(
        F.max(F.when(first, F.col("u"))).alias("u1"), F.max(F.when(~first, F.col("u"))).alias("u2")
    )


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._memo: dict = {}

    @_shared
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- lattice ----------------------------------------------------------
    @_shared
    def stations(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier").select(
            s.alias("station"),
            (s % 10).alias("proj_x"),
            F.floor(s / 10).alias("proj_y"),
        )

    @_shared
    def offsets(self) -> DataFrame:
        return lattice.offsets_table(self.spark)

    def edges(self, types: list[str] | None = None) -> DataFrame:
        return self._edges(tuple(types) if types else None)

    @_shared
    def _edges(self, types: tuple | None) -> DataFrame:
        return lattice.lattice_edges(self.stations(), self.offsets(), list(types) if types else None)

    # -- rain ---------------------------------------------------------------
    @_shared
    def hourly(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("station"),
            F.col("l_shipdate").alias("ts"),
            F.col("l_extendedprice").alias("precip"),
        )

    @_shared
    def precip(self) -> DataFrame:
        h = self.hourly()
        return h.groupBy("station", F.year("ts").alias("year")).agg(F.max("precip").alias("precip"))

    @_shared
    def precip_month(self) -> DataFrame:
        h = self.hourly()
        month = (F.year("ts") * 100 + F.month("ts")).alias("month")
        return h.groupBy("station", month).agg(F.max("precip").alias("precip"))

    @_shared
    def params(self) -> DataFrame:
        """Per-station transformed GEV parameters (psi, tau, phi, gamma)."""
        s = F.col("station")
        return (
            self.precip()
            .groupBy("station")
            .agg(F.avg("precip").alias("_m"), F.stddev_samp("precip").alias("_s"))
            .select(
                "station",
                F.log(F.col("_m")).alias("psi"),
                F.log(F.col("_s") / F.col("_m")).alias("tau"),
                ((s % 5 - 2) * 0.02).alias("phi"),
                ((s % 7 - 3) * 0.0005).alias("gamma"),
            )
        )

    # -- posterior draws ------------------------------------------------------
    @_shared
    def draw_values(self) -> DataFrame:
        """The draws without iteration numbers: chain, name, value."""
        return self.table("events").select(
            (F.col("event_id") % 4 + 1).cast("int").alias("chain"), F.col("event_type").alias("name"), "value"
        )

    @_shared
    def draws(self) -> DataFrame:
        """Long draws: chain, name, iteration, value (iteration dense per chain/name)."""
        ev = self.table("events").select(
            (F.col("event_id") % 4 + 1).cast("int").alias("chain"),
            F.col("event_type").alias("name"),
            "event_id",
            "value",
        )
        return windows.dense_row_number(ev, ["chain", "name"], "event_id", "iteration").select(
            "chain", "name", "iteration", "value"
        )

    # -- vectors ---------------------------------------------------------------
    @_shared
    def vectors(self) -> DataFrame:
        """(vec_id, dim, x) long margins, one row per embedding entry.

        The vectors are dealt out before they become long: a file of one row group is read by one task.
        """
        e = self.table("embeddings").select("vec_id", "embedding").repartition("vec_id")
        return e.select("vec_id", F.posexplode("embedding").alias("dim", "x")).select(
            "vec_id", (F.col("dim") + 1).cast("int").alias("dim"), F.col("x").cast("double").alias("x")
        )

    @_shared
    def catalogue(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id"), F.col("doc_id").alias("newest"), F.col("source").alias("category"), "lang"
        )

    @_shared
    def income(self) -> DataFrame:
        """(year, age, o_totalprice) rows for the income pipeline."""
        o = self.table("orders").select("o_custkey", "o_totalprice", "o_orderdate")
        c = self.table("customer").select("c_custkey", "c_mktsegment")
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.year("o_orderdate").alias("year"),
            F.col("c_mktsegment").alias("age"),
            F.col("o_totalprice").alias("income"),
        )

