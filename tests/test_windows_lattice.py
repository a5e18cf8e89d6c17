"""Distributed row numbers, ranks and lattice identities."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pluvio.operators import lattice, windows


def test_dense_row_number_matches_window(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1009).alias("oid"))
    ours = windows.dense_row_number(df, ["k"], "oid", "rn", block_size=16)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("oid")))
    assert sorted(map(tuple, ours.select("k", "oid", "rn").collect())) == sorted(
        map(tuple, ref.select("k", "oid", "rn").collect())
    )


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, 1.0)], "g int, x double")
    u = {r.x: r.u for r in windows.average_rank_uniform(df, ["g"], "x").collect()}
    assert u[1.0] == 1 / 5 and u[5.0] == 2.5 / 5 and u[7.0] == 4 / 5


def _grid(spark, nx, ny):
    rows = [(y * nx + x, x, y) for y in range(ny) for x in range(nx)]
    return spark.createDataFrame(rows, "station bigint, proj_x bigint, proj_y bigint")


def test_rook_edges_and_laplacian(spark):
    st = _grid(spark, 3, 3)
    e = lattice.lattice_edges(st, lattice.offsets_table(spark), lattice.ROOK_TYPES)
    assert e.count() == 24
    q = lattice.laplacian(e)
    sums = q.groupBy("i").agg(F.sum("v").alias("s")).collect()
    assert all(abs(r.s) < 1e-12 for r in sums)


def test_kronecker_sum_equals_rook_laplacian(spark):
    st = _grid(spark, 4, 3)
    e = lattice.lattice_edges(st, lattice.offsets_table(spark), lattice.ROOK_TYPES)
    a = {(r.i, r.j): r.v for r in lattice.laplacian(e).collect()}
    b = {(r.i, r.j): r.v for r in lattice.kronecker_sum_precision(st).collect()}
    assert a == b


def test_icar_pairwise_is_quadratic_form(spark):
    st = _grid(spark, 3, 2)
    e = lattice.lattice_edges(st, lattice.offsets_table(spark), lattice.ROOK_TYPES)
    vals = st.select("station", (F.col("station") * 0.37 - 1.0).alias("phi"))
    pw = lattice.icar_energy(vals, e, "phi").first().pairwise
    q = lattice.laplacian(e)
    x = {r.station: r.phi for r in vals.collect()}
    quad = sum(r.v * x[r.i] * x[r.j] for r in q.collect())
    assert abs(pw - (-0.5 * quad)) < 1e-12


def test_exact_quantiles_and_global_ranks(spark):
    import duckdb

    from pluvio.operators import profile

    rows = [(0, float(i % 37)) for i in range(3000)] + [(g, float((i * 7919) % 101) / 3.0) for g in (1, 2) for i in range(50)]
    rows += [(3, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.002, 0.0025, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]
    ours = {r.g: r for r in profile.group_quantiles(df, ["g"], "v", probs).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(g INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    for g in (0, 1, 2, 3):
        for i, p in enumerate(probs):
            ref = con.execute("SELECT quantile_cont(v, ?) FROM t WHERE g = ?", [p, g]).fetchone()[0]
            assert abs(ours[g][f"q{i}"] - ref) < 1e-9
    a = {(r.g, r.v, r.u) for r in windows.global_average_rank_uniform(df, ["g"], "v").collect()}
    b = {(r.g, r.v, r.u) for r in windows.average_rank_uniform(df, ["g"], "v").collect()}
    assert a == b


def test_lattice_log_det_equals_dense(spark):
    import numpy as np

    from pluvio.operators import lattice

    for nx, ny in ((4, 3), (1, 5), (6, 1)):
        rows = [(y * nx + x + 1, x + 3, y + 1) for y in range(ny) for x in range(nx)]
        st = spark.createDataFrame(rows, "station long, proj_x long, proj_y long")
        path = lambda n: np.diag([(i > 0) + (i < n - 1.0) for i in range(n)]) - np.eye(n, k=1) - np.eye(n, k=-1)
        q = np.kron(np.eye(ny), path(nx)) + np.kron(path(ny), np.eye(nx)) + 0.3 * np.eye(nx * ny)
        assert abs(lattice.lattice_log_det(st, 0.3).first().log_det - np.linalg.slogdet(q)[1]) < 1e-9
    assert lattice.lattice_log_det(st.where("station != 3"), 0.3).first().log_det is None
    assert lattice.lattice_log_det(st.limit(0), 0.3).first().log_det is None
