"""Lattice neighbours and sparse graph matrices as tables.

A graph is an edge table (station, neighbor, type) and a sparse matrix is a
COO table (i, j, v).  Matrix products are equi-joins on the shared index
followed by ``sum`` - the shuffle is by the row index, and nothing dense is
ever built.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvio.functions import dist
from pluvio.operators.windows import dense_row_number

# ---------------------------------------------------------------------------
# The twelve neighbour types and their lattice offsets
# (type, diff_x, diff_y), in the order the reference lays them out.
# ---------------------------------------------------------------------------
NEIGHBOR_OFFSETS = [
    ("nn", 0, 2),
    ("nw", -1, 1),
    ("n", 0, 1),
    ("ne", 1, 1),
    ("ww", -2, 0),
    ("w", -1, 0),
    ("e", 1, 0),
    ("ee", 2, 0),
    ("sw", -1, -1),
    ("s", 0, -1),
    ("se", 1, -1),
    ("ss", 0, -2),
]
ROOK_TYPES = ["n", "s", "e", "w"]
QUEEN_TYPES = ["n", "s", "e", "w", "ne", "nw", "se", "sw"]

def offsets_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        NEIGHBOR_OFFSETS, "type string, diff_x bigint, diff_y bigint"
    )


def lattice_edges(
    stations: DataFrame, offsets: DataFrame, types: list[str] | None = None
) -> DataFrame:
    """Directed edges station -> neighbor for the given offset types.

    Each station is crossed with the (literal, <= 12 row) offset table and the
    shifted coordinates are equi-joined back onto the stations.
    """
    off = offsets if types is None else offsets.filter(F.col("type").isin(types))
    s = stations.select("station", "proj_x", "proj_y")
    shifted = s.crossJoin(F.broadcast(off)).select(
        "station",
        "type",
        (F.col("proj_x") + F.col("diff_x")).alias("nx"),
        (F.col("proj_y") + F.col("diff_y")).alias("ny"),
    )
    nb = s.select(F.col("station").alias("neighbor"), F.col("proj_x").alias("nx"), F.col("proj_y").alias("ny"))
    # The station table is a file-backed dimension: its file size drives the
    # static broadcast choice, and AQE revisits it with the real shuffle size.
    return shifted.join(nb, on=["nx", "ny"], how="inner").select("station", "neighbor", "type")


def undirected(edges: DataFrame) -> DataFrame:
    """Keep each pair once: neighbor > station."""
    return edges.filter(F.col("neighbor") > F.col("station"))


def restrict_and_renumber(edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges among a station subset, renumbered densely 1..N.

    ``keep`` has a ``station`` column.  The new names are a dense rank of the
    station id, numbered block-wise so no single task sees every station.
    """
    ks = keep.select("station").distinct()
    e = edges.join(ks, "station", "left_semi").join(
        ks.withColumnRenamed("station", "neighbor"), "neighbor", "left_semi"
    )
    new_names = dense_row_number(ks, [], "station", "new_name")
    return rekey(rekey(e, "station", new_names), "neighbor", new_names), new_names


def rekey(table: DataFrame, column: str, new_names: DataFrame) -> DataFrame:
    """Replace ``column`` by its new name from a (station, new_name) map."""
    m = new_names.select(F.col("station").alias("_old"), F.col("new_name").alias("_new"))
    cols = [F.col("_new").alias(column) if c == column else F.col(c) for c in table.columns]
    return table.join(m, table[column] == m["_old"], "inner").select(*cols)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("station").agg(F.count(F.lit(1)).alias("degree"))


def laplacian(edges: DataFrame, jitter: float = 0.0) -> DataFrame:
    """Graph Laplacian D - A as COO (i, j, v) from directed edges.

    ``jitter`` adds ``max(diag) * jitter`` to the diagonal.
    """
    deg = degrees(edges)
    diag = deg.select(F.col("station").alias("i"), F.col("station").alias("j"), F.col("degree").cast("double").alias("v"))
    if jitter:
        mx = deg.agg(F.max("degree").alias("_mx"))
        diag = diag.crossJoin(F.broadcast(mx)).select("i", "j", (F.col("v") + F.col("_mx") * jitter).alias("v"))
    off = edges.select(F.col("station").alias("i"), F.col("neighbor").alias("j"), F.lit(-1.0).alias("v"))
    return diag.unionByName(off)


def car_precision(edges: DataFrame, alpha: float) -> DataFrame:
    """CAR precision D(I - alpha D^-1 W) = D - alpha W as COO."""
    deg = degrees(edges)
    diag = deg.select(F.col("station").alias("i"), F.col("station").alias("j"), F.col("degree").cast("double").alias("v"))
    off = edges.select(F.col("station").alias("i"), F.col("neighbor").alias("j"), F.lit(-float(alpha)).alias("v"))
    return diag.unionByName(off)


def mean_degree(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """m-bar: average number of neighbours over all stations (isolated count 0)."""
    deg = stations.select("station").join(degrees(edges), "station", "left").fillna({"degree": 0})
    return deg.agg(F.avg("degree").alias("mean_degree"))


def path_laplacian(coords: DataFrame, axis: str) -> DataFrame:
    """1-D random-walk structure matrix over the distinct values of ``axis``.

    Neighbours are a +1 / -1 shift, so both pairings are equi-joins.
    """
    v = coords.select(F.col(axis).alias("a")).distinct()
    up = v.join(v.select((F.col("a") - 1).alias("a"), F.col("a").alias("b")), "a")
    down = v.join(v.select((F.col("a") + 1).alias("a"), F.col("a").alias("b")), "a")
    pairs = up.unionByName(down)
    deg = pairs.groupBy("a").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return deg.select(F.col("a").alias("i"), F.col("a").alias("j"), "v").unionByName(
        pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), F.lit(-1.0).alias("v"))
    )


def kronecker_sum_precision(stations: DataFrame) -> DataFrame:
    """R_x (+) R_y = R_x (x) I + I (x) R_y on the stations' lattice, as COO.

    Rows and columns are station ids; each axis term is joined onto the
    stations by both coordinates (the other axis held equal), so the result
    equals the rook-lattice Laplacian.
    """
    s = stations.select("station", "proj_x", "proj_y")
    rx = path_laplacian(s, "proj_x").select(F.col("i").alias("x"), F.col("j").alias("x2"), "v")
    ry = path_laplacian(s, "proj_y").select(F.col("i").alias("y"), F.col("j").alias("y2"), "v")
    a = s.select(F.col("station").alias("i"), F.col("proj_x").alias("x"), F.col("proj_y").alias("y"))
    bx = s.select(F.col("station").alias("j"), F.col("proj_x").alias("x2"), F.col("proj_y").alias("y"))
    by = s.select(F.col("station").alias("j"), F.col("proj_x").alias("x"), F.col("proj_y").alias("y2"))
    tx = a.join(rx, "x").join(bx, ["x2", "y"]).select("i", "j", "v")
    ty = a.join(ry, "y").join(by, ["y2", "x"]).select("i", "j", "v")
    return tx.unionByName(ty).groupBy("i", "j").agg(F.sum("v").alias("v"))


def lattice_log_det(stations: DataFrame, shift: float) -> DataFrame:
    """log|R_x (+) R_y + shift I| on a complete lattice, one row ``log_det``.

    The eigenvalues of the sum are sums of the axes' own, 2 - 2 cos(pi k / n) for a path of n cells, so every
    station gives one of them: a scan and a sum, no factorisation.  NULL when the stations are not a complete
    lattice of consecutive coordinates, and for an empty table.
    """
    xy = stations.select("proj_x", "proj_y")
    bounds = xy.agg(*[f(c).alias(f"_{n}_{c}") for c in ("proj_x", "proj_y") for n, f in (("lo", F.min), ("hi", F.max))])
    joined = xy.crossJoin(F.broadcast(bounds))  # one row

    def cells(axis: str) -> Column:
        return F.col(f"_hi_{axis}") - F.col(f"_lo_{axis}") + 1

    def eigenvalue(axis: str) -> Column:
        return 2.0 - 2.0 * F.cos(F.lit(math.pi) * (F.col(axis) - F.col(f"_lo_{axis}")) / cells(axis))

    total = joined.agg(
        F.sum(F.log(eigenvalue("proj_x") + eigenvalue("proj_y") + F.lit(float(shift)))).alias("_sum"),
        F.count(F.lit(1)).alias("_n"),
        F.max(cells("proj_x") * cells("proj_y")).alias("_cells"),
    )
    return total.select(F.when(F.col("_n") == F.col("_cells"), F.col("_sum")).alias("log_det"))


def icar_energy(values: DataFrame, edges: DataFrame, value: str, by: list[str] | None = None,
                n_stations: Column | None = None) -> DataFrame:
    """ICAR log density -1/2 sum over undirected edges (x_i - x_j)^2 plus the soft
    sum-to-zero term normal_lpdf(sum x | 0, 0.001 N) (G6).

    ``values`` has (station, value, *by); ``by`` (e.g. draw) groups the sums.
    """
    by = by or []
    ue = undirected(edges).select("station", "neighbor")
    xi = values.select(*by, "station", F.col(value).alias("_xi"))
    xj = values.select(*by, F.col("station").alias("neighbor"), F.col(value).alias("_xj"))
    pair = ue.join(xi, "station").join(xj, [*by, "neighbor"])
    quad = pair.groupBy(*by).agg((-0.5 * F.sum(F.pow(F.col("_xi") - F.col("_xj"), 2))).alias("pairwise"))
    tot = values.groupBy(*by).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    sd = 0.001 * F.col("_n")
    soft = tot.select(
        *by,
        (-0.5 * F.pow(F.col("_sum") / sd, 2) - F.log(sd) - 0.5 * math.log(2 * math.pi)).alias("soft"),
    )
    out = quad.join(soft, by, "inner") if by else quad.crossJoin(soft)
    return out.withColumn("energy", F.col("pairwise") + F.col("soft"))


def neighbour_moments(values: DataFrame, edges: DataFrame, value: str, sigma2: float = 1.0) -> DataFrame:
    """Conditional mean sum x_j / d_i and variance sigma^2 / d_i."""
    xj = values.select(F.col("station").alias("neighbor"), F.col(value).alias("_xj"))
    return (
        edges.join(xj, "neighbor")
        .groupBy("station")
        .agg(F.avg("_xj").alias("cond_mean"), (F.lit(sigma2) / F.count(F.lit(1))).alias("cond_var"))
    )


def local_moran(values: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """Local Moran's I with row-standardised weights.

    I_i = z_i sum_j w_ij z_j / m2 with z = x - mean, m2 = sum z^2 / n;
    E_i = -z_i^2 W_i / ((n - 1) m2);
    Var_i = (z_i / m2)^2 n/(n-2) (m2 - z_i^2/(n-1)) (W2_i - W_i^2/(n-1));
    Z_i = (I_i - E_i)/sqrt(Var_i); p = 1 - Phi(Z) (alternative "greater").
    Global moments are one-row aggregates cross-joined (broadcast).  A station without
    neighbours has NULL statistics.
    """
    x = values.select("station", F.col(value).alias("x"))
    glob = x.agg(F.avg("x").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    z = x.crossJoin(F.broadcast(glob)).withColumn("z", F.col("x") - F.col("_mean"))
    m2 = z.agg((F.sum(F.col("z") * F.col("z")) / F.count(F.lit(1))).alias("m2"))
    w = edges.select("station", "neighbor").withColumn(
        "w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("station"))
    )
    zj = z.select(F.col("station").alias("neighbor"), F.col("z").alias("zj"))
    lag = w.join(zj, "neighbor").groupBy("station").agg(
        F.sum(F.col("w") * F.col("zj")).alias("lag_z"),
        F.sum("w").alias("W_i"),
        F.sum(F.col("w") * F.col("w")).alias("W2_i"),
    )
    n = F.col("_n").cast("double")
    m2c = F.col("m2")
    out = (
        z.join(lag, "station", "left")
        .crossJoin(F.broadcast(m2))
        .select(
            "station",
            "x",
            F.try_divide(F.col("z") * F.col("lag_z"), m2c).alias("local_i"),
            F.try_divide(-(F.col("z") ** 2) * F.col("W_i"), (n - 1) * m2c).alias("expected_i"),
            (
                F.try_divide(F.col("z"), m2c) ** 2
                * F.try_divide(n, n - 2)
                * (m2c - F.col("z") ** 2 / (n - 1))
                * (F.col("W2_i") - F.col("W_i") ** 2 / (n - 1))
            ).alias("variance_i"),
        )
    )
    zscore = F.try_divide(F.col("local_i") - F.col("expected_i"), F.sqrt(F.col("variance_i")))
    out = out.withColumn("z_i", zscore).withColumn("p_value", 1.0 - dist.norm_cdf(F.col("z_i")))
    return out.withColumn(
        "significant", (F.col("z_i") > 1.65) & (F.col("p_value") < 0.05)
    )


def grid_cells(points: DataFrame, x: str = "proj_x", y: str = "proj_y") -> DataFrame:
    """Cell bounds around lattice points; cell size = smallest gap between
    distinct coordinates per axis (G11).

    The window runs over the distinct coordinate values of one axis (bounded
    by the lattice width), partitioned by axis.
    """
    coords = points.select(F.lit("x").alias("axis"), F.col(x).cast("double").alias("c")).unionByName(
        points.select(F.lit("y").alias("axis"), F.col(y).cast("double").alias("c"))
    ).distinct()
    gap = coords.withColumn("_next", F.lead("c").over(Window.partitionBy("axis").orderBy("c")))
    size = gap.groupBy().pivot("axis", ["x", "y"]).agg(F.min(F.col("_next") - F.col("c")))
    size = size.select(F.col("x").alias("dx"), F.col("y").alias("dy"))
    return points.crossJoin(F.broadcast(size)).select(
        *points.columns,
        (F.col(x) - F.col("dx") / 2).alias("xmin"),
        (F.col(x) + F.col("dx") / 2).alias("xmax"),
        (F.col(y) - F.col("dy") / 2).alias("ymin"),
        (F.col(y) + F.col("dy") / 2).alias("ymax"),
    )


def neighbour_pairs(values: DataFrame, edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Edge join twice: edges x values as y on station x values as x on neighbor.

    Values are pruned to (keys, station, value) before the join so the
    12-fold fan-out carries only what is needed.
    """
    y = values.select(*keys, "station", F.col(value).alias("y"))
    xv = values.select(*keys, F.col("station").alias("neighbor"), F.col(value).alias("x"))
    return edges.join(y, "station").join(xv, [*keys, "neighbor"])
