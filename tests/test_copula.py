"""Copula identities: AR(1) three ways, Frank limit."""

import math

from pyspark.sql import functions as F

from pluvio.operators import copula


def _u(spark):
    rows = [(r, i, u) for r, us in enumerate([[0.2, 0.9, 0.55, 0.31], [0.7, 0.66, 0.12, 0.95]]) for i, u in enumerate(us, 1)]
    return spark.createDataFrame(rows, "rep int, id int, u double")


def test_ar1_equals_precision_cholesky_equals_dense(spark):
    u = _u(spark)
    rho = 0.45
    a = {r.rep: r.log_c for r in copula.ar1_copula_logc(u, ["rep"], "id", "u", rho).collect()}
    r_coo, ld = copula.ar1_precision_cholesky_table(u.select("id"), rho)
    b = {r.rep: r.log_c for r in copula.precision_cholesky_logc(u, ["rep"], "id", "u", r_coo, ld).collect()}
    linv, ldl = copula.cholesky_inverse_coo(spark, copula.ar1_correlation(4, rho))
    c = {r.rep: r.log_c for r in copula.gaussian_copula_logc(u, ["rep"], "id", "u", linv, ldl).collect()}
    for k in a:
        assert abs(a[k] - b[k]) < 1e-10 and abs(a[k] - c[k]) < 1e-10


def test_frank_tends_to_independence(spark):
    u = _u(spark)
    fr = {r.rep: math.exp(r.log_C) for r in copula.archimedean_log_cdf(u, ["rep"], "u", "frank", 1e-6).collect()}
    ind = {r.rep: math.exp(r.log_C) for r in copula.independence_log_cdf(u, ["rep"], "u").collect()}
    for k in fr:
        assert abs(fr[k] - ind[k]) < 1e-6


def test_frank_closed_form_matches_generator(spark):
    df = spark.createDataFrame([(0.3, 0.8), (0.5, 0.5)], "u1 double, u2 double")
    long = df.withColumn("rep", F.monotonically_increasing_id())
    pairs = long.select("rep", F.explode(F.array("u1", "u2")).alias("u"))
    gen = {r.rep: math.exp(r.log_C) for r in copula.archimedean_log_cdf(pairs, ["rep"], "u", "frank", 3.0).collect()}
    closed = {r.rep: r.C for r in long.select("rep", copula.frank_cdf_2d("u1", "u2", 3.0).alias("C")).collect()}
    for k in gen:
        assert abs(gen[k] - closed[k]) < 1e-12


def test_t_tail_dependence_known_value(spark):
    # rho = 0, nu = 1: lambda = 2 t_2(-sqrt 2) = 1 - sqrt(2)/2
    v = spark.range(1).select(copula.t_tail_dependence(F.lit(0.0), 1).alias("l")).first().l
    assert abs(v - (1 - math.sqrt(2) / 2)) < 1e-12


def test_t_copula_tends_to_gaussian(spark):
    u = _u(spark)
    sigma = copula.ar1_correlation(4, 0.45)
    linv, ld = copula.cholesky_inverse_coo(spark, sigma)
    g = {r.rep: r.log_c for r in copula.gaussian_copula_logc(u, ["rep"], "id", "u", linv, ld).collect()}
    t = {r.rep: r.log_c for r in copula.t_copula_logc(u, ["rep"], "id", "u", linv, ld, 400, 4).collect()}
    for k in g:
        assert abs(g[k] - t[k]) < 0.02


def test_dense_quadratic_form_equals_the_join_by_entries(spark):
    rows = [(1, 1, 0.5), (1, 2, -1.0), (1, 4, 2.0), (2, 3, 1.5), (2, 3, 0.25), (2, 9, 7.0), (3, 1, None), (4, 8, 1.0),
            (5, 2, float("inf")), (6, None, 1.0), (6, 1, 3.0)]
    df = spark.createDataFrame(rows, "rep int, id int, x double")
    linv, _ = copula.cholesky_inverse_coo(spark, copula.ar1_correlation(4, 0.45))
    want = {r.rep: r.qf for r in copula.quadratic_form(df, ["rep"], "id", "x", linv).collect()}
    dense = copula.dense_quadratic_form(df, ["rep"], "id", "x", linv, [F.count("x").alias("n")])
    got = {r.rep: r.qf for r in dense.collect()}
    assert got.keys() == want.keys() == {1, 2, 3, 5, 6} and got[3] is want[3] is None and got[5] == want[5]
    assert all(abs(got[k] - want[k]) < 1e-12 for k in (1, 2, 6))


def test_copulas_make_no_row_per_entry_of_the_factor(spark):
    u = _u(spark).unionByName(spark.createDataFrame([(None, 1, 0.4)], "rep int, id int, u double"))
    linv, ld = copula.cholesky_inverse_coo(spark, copula.ar1_correlation(4, 0.45))
    for c in (copula.gaussian_copula_logc(u, ["rep"], "id", "u", linv, ld), copula.t_copula_logc(u, ["rep"], "id", "u", linv, ld, 5, 4)):
        assert "Join" not in c._jdf.queryExecution().executedPlan().toString()
        assert {r.rep for r in c.collect()} == {0, 1}  # a null key has no row


def test_vectors_of_one_row_group_are_dealt_out(spark, tmp_path):
    from pluvio.plans.fixtures import Fixtures

    e = spark.range(64).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.col("id") / 64.0).cast("array<float>").alias("embedding"))
    e.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = Fixtures(spark, str(tmp_path)).vectors()
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        assert v.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set(setting, "true")
    assert v.count() == 128
