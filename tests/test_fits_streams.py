"""Grouped fits recover known parameters; the stream equals the batch."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from pluvio.functions import dist
from pluvio.operators import gev, regress
from tests.conftest import SMALL


def test_gev_fit_recovers_parameters(spark):
    mu, sigma, xi = 50.0, 10.0, 0.1
    n = 400
    ys = [mu + sigma * ((-math.log((i + 0.5) / n)) ** (-xi) - 1) / xi for i in range(n)]
    rows = [(1, 1981, y) for y in ys]
    df = spark.createDataFrame(rows, "station bigint, year int, precip double")
    fit = gev.fit_station_gev(df, t0=1981).first()
    par = {p["name"]: p["value"] for p in fit.par}
    assert abs(math.exp(par["psi"]) - mu) < 1.0
    assert abs(math.exp(par["psi"] + par["tau"]) - sigma) < 1.0
    xi_hat = spark.range(1).select(dist.shape_link_inverse(F.lit(par["phi"])).alias("x")).first().x
    assert abs(xi_hat - xi) < 0.05
    assert len(fit.hess) == 4 and fit.converged


def test_gev_score_and_hessian_by_differences():
    rng = np.random.default_rng(0)
    n = 200
    y, t = rng.gumbel(50, 10, (n, 12)), np.tile(np.arange(12.0) + 5, (n, 1))
    use = np.ones(y.shape, bool)
    use[:, 10:] = rng.random((n, 2)) < 0.5
    priors = {"psi": gev.normal_prior(4.0, 2.0), "phi": gev.normal_prior(0.0, 0.3)}
    theta = np.stack([np.full(n, np.log(50.0)), np.full(n, np.log(0.3)), rng.normal(0, 0.3, n), rng.normal(0, 0.004, n)], 1)
    theta[:50, 2] = rng.normal(0, 1e-6, 50)  # through the Gumbel limit
    value, score, hess = gev.gev_objective(theta, y, t, use, 0.8, 0.008, priors)
    for i in range(4):
        d = np.zeros(4)
        d[i] = 1e-5 * (0.008 if i == 3 else 1.0)
        up, s_up, _ = gev.gev_objective(theta + d, y, t, use, 0.8, 0.008, priors)
        down, s_down, _ = gev.gev_objective(theta - d, y, t, use, 0.8, 0.008, priors)
        ok = np.isfinite(value) & np.isfinite(up) & np.isfinite(down)
        assert ok.sum() > 150
        assert np.abs((up - down)[ok] / (2 * d[i]) - score[ok, i]).max() < 1e-4 * np.abs(score[ok, i]).max()
        assert np.abs((s_up - s_down)[ok] / (2 * d[i]) - hess[ok, i]).max() < 1e-4 * np.abs(hess[ok, i]).max()


def test_gev_fit_of_odd_stations(spark):
    rng = np.random.default_rng(1)
    rows = [(1, 1980 + k, float(v)) for k, v in enumerate(rng.gumbel(50, 10, 30))]
    rows += [(2, 1990, 5.0), (3, 1990, 5.0), (3, 1991, 5.0), (4, 1990, -3.0), (4, 1991, -4.0), (5, 1990, None), (6, 1990, float("nan")), (None, 1990, 3.0)]
    rows += [(1, None, 3.0), (1, 1999, float("inf"))]
    df = spark.createDataFrame(rows, "station long, year int, precip double")
    fits = {r.station: r for r in gev.fit_station_gev(df).collect()}
    assert set(fits) == {1, 2, 3, 4, None}
    assert fits[1].converged and not (fits[2].converged or fits[3].converged or fits[4].converged)
    tight = gev.fit_station_gev(df, priors={"phi": gev.normal_prior(0.0, 1e-4), "gamma": gev.normal_prior(0.0, 1e-6)})
    par = {p.name: p.value for p in tight.where("station = 1").first().par}
    assert abs(par["phi"]) < 1e-3 and abs(par["gamma"]) < 1e-4


def test_lagged_products_across_blocks(spark, monkeypatch):
    from pluvio.operators import draws as D

    monkeypatch.setattr(D, "LAG_BLOCK", 16)
    rng = np.random.default_rng(2)
    series = {("a", 1): rng.normal(size=100), ("a", 2): rng.normal(size=7), ("b", 1): rng.normal(size=33)}
    rows = [(n, c, t + 1, float(v), float(v) ** 2) for (n, c), x in series.items() for t, v in enumerate(x) if (n, t) != ("b", 9)]
    df = spark.createDataFrame(rows, "name string, chain int, t long, x double, y double").repartition(4)
    for first, last in ((0, 5), (5, 21), (21, 90)):
        got = {(r.name, r.chain, r.col, r.lag): r["product"] for r in D.lagged_products(df, ["name", "chain"], "t", ["x", "y"], first, last).collect()}
        for (n, c), x in series.items():
            x = np.where((np.arange(len(x)) == 9) & (n == "b"), 0.0, x)
            for k in range(first, last):
                for col, v in (("x", x), ("y", x * x)):
                    assert abs(got[n, c, col, k] - (v[: len(v) - k] * v[k:]).sum() if k < len(v) else got[n, c, col, k]) < 1e-9


def test_site_regression_recovers_coefficients(spark):
    rows = []
    for t in range(60):
        a, b = math.sin(t * 0.7), math.cos(t * 1.3)
        y = 0.6 * a - 0.25 * b
        rows += [(1, t, "a", y, a), (1, t, "b", y, b)]
    df = spark.createDataFrame(rows, "station bigint, t int, type string, y double, x double")
    gram = regress.gram_by_site(df, "station", "t", "type", "y", "x")
    est = {r.term: r.estimate for r in regress.site_regressions(gram, "station").collect()}
    assert abs(est["a"] - 0.6) < 1e-9 and abs(est["b"] + 0.25) < 1e-9


def test_gram_by_site_sums_all_pairs_of_a_cell(spark):
    rows = [(1, 1, "a", 2.0, 3.0), (1, 1, "b", 2.0, 5.0), (1, 1, "b", 2.0, 5.0), (1, 2, "a", -1.0, None), (1, 2, "b", -1.0, 4.0),
            (1, None, "a", 7.0, 1.0), (2, 1, "a", None, 2.0), (None, 1, "a", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "station bigint, t int, type string, y double, x double")
    got = {(r.station, r.a, r.b): (r.v, r.n) for r in regress.gram_by_site(df, "station", "t", "type", "y", "x").collect()}
    want = {(1, "a", "a"): 9.0, (1, "a", "b"): 30.0, (1, "b", "a"): 30.0, (1, "b", "b"): 100.0 + 16.0, (1, "a", "_y"): 6.0 + 7.0,
            (1, "b", "_y"): 20.0 - 4.0, (1, "_y", "_y"): 4.0 + 1.0 + 49.0, (2, "a", "a"): 4.0, (2, "a", "_y"): None, (2, "_y", "_y"): None}
    assert got == {k: (v, 3 if k[0] == 1 else 1) for k, v in want.items()}


def test_gram_of_rows_dealt_by_site_moves_no_row(spark):
    df = spark.createDataFrame([(1, 1, "a", 1.0, 2.0)], "station bigint, t int, type string, y double, x double").repartition("station")
    gram = regress.gram_by_site(df, "station", "t", "type", "y", "x")
    assert gram._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # the caller's own


def test_stream_equals_batch(spark):
    from pluvio.streaming.blockmax import stream_block_maxima

    s = stream_block_maxima(spark, SMALL, "user_id", "ts", "value", "1 day", "1 day", glob="events.parquet")
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    b = ev.groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("window_start")).agg(
        F.max("value").alias("value")
    )
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.select("user_id", "window_start", "value").collect()))


def test_stream_resumes_replays_and_compacts(spark, tmp_path):
    from pluvio.streaming import blockmax as B

    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id", "ts", "value")
    first, second = ev.where("value < 20"), ev.where("value >= 20")

    def run():
        return sorted(map(tuple, B.stream_block_maxima(spark, src, "user_id", "ts", "value", late="4000 days", out_dir=out, checkpoint=ckpt).collect()))

    def batch(df):
        w = F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("window_start")
        return sorted(map(tuple, df.groupBy("user_id", w).agg(F.max("value")).collect()))

    first.write.parquet(src)
    assert run() == batch(first)
    second.write.mode("append").parquet(src)
    assert run() == batch(ev)
    assert run() == batch(ev)  # nothing new
    # an epoch that is written again after it was compacted changes nothing, then goes into the table
    replayed = B.read_block_maxima(spark, out, "user_id", "value").limit(50)
    replayed.write.parquet(f"{out}/epoch=0")
    assert sorted(map(tuple, B.read_block_maxima(spark, out, "user_id", "value").collect())) == batch(ev)
    B.compact_block_maxima(spark, out, "user_id", "value")
    tables = B._tables(spark, out)
    assert len(tables) == 1 and spark.read.parquet(tables[0]).count() == len(batch(ev))
    # a table that was not finished is not read
    spark.read.parquet(tables[0]).withColumn("value", F.lit(1e9)).write.parquet(f"{out}/epoch=7")
    (tmp_path / "out" / "epoch=7" / "_SUCCESS").unlink()
    assert B._tables(spark, out) == tables


def _fft_ess(x):
    import numpy as np

    m, n = x.shape
    xc = x - x.mean(axis=1, keepdims=True)
    f = np.fft.rfft(xc, n=2 * n, axis=1)
    acov = np.fft.irfft(f * np.conj(f), axis=1)[:, :n] / n
    w = (acov[:, 0] * n / (n - 1)).mean()
    vp = w * (n - 1) / n + x.mean(axis=1).var(ddof=1)
    rho = 1 - (w - acov.mean(axis=0)) / vp
    rho[0] = 1
    ps, t = [], 0
    while 2 * t + 1 < n:
        s = rho[2 * t] + rho[2 * t + 1]
        if s < 0:
            break
        ps.append(s)
        t += 1
    for i in range(1, len(ps)):
        ps[i] = min(ps[i], ps[i - 1])
    tau = max(-1 + 2 * sum(ps), 1 / math.log10(m * n))
    return m * n / tau


def test_distributed_ess_matches_fft(spark):
    import statistics

    import numpy as np

    from pluvio.operators import draws as D

    rng = np.random.default_rng(3)
    rows = []
    for ch in range(1, 5):
        x = 0.0
        for it in range(1, 201):
            x = 0.8 * x + rng.normal()
            rows.append((ch, "a", it, float(x)))
    df = spark.createDataFrame(rows, "chain int, name string, iteration int, value double")
    got = D.ess(df).first().ess_bulk
    v = np.array([[r[3] for r in rows if r[0] == ch] for ch in range(1, 5)])
    halves = np.vstack([v[:, :100], v[:, 100:]])
    flat = halves.ravel()
    ranks = np.empty(len(flat))
    ranks[flat.argsort()] = np.arange(1, len(flat) + 1)
    nd = statistics.NormalDist()
    z = np.array([nd.inv_cdf((r - 0.375) / (len(flat) + 0.25)) for r in ranks]).reshape(halves.shape)
    assert abs(got - _fft_ess(z)) < 1e-6 * got


def test_t_tail_and_quantile_against_published_values():
    # fixed values: two-sided 5 % points of Student's t by degrees of freedom
    for nu, t in ((1, 12.7062047), (2, 4.3026527), (5, 2.5705818), (10, 2.2281389), (30, 2.0422725), (120, 1.9799304)):
        assert abs(regress.t_critical(0.95, nu) - t) < 1e-7
        assert abs(regress.t_two_sided(t, nu) - 0.05) < 1e-8
    assert abs(regress.t_critical(0.95, 3e9) - 1.959963985) < 1e-8  # degrees of freedom beyond 32 bits
    assert 0 < regress.t_two_sided(40.0, 200) < 1e-90  # no cancellation in the tail


def test_linear_model_matches_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    f, g, x = rng.choice(["a", "b", "c"], 300), rng.choice(["u", "v"], 300), rng.normal(1e4, 1, 300)
    y = 3 + 2 * x + (f == "b") - 4 * (g == "v") + rng.normal(size=300)
    rows = [(float(a), float(b), str(c), str(d)) for a, b, c, d in zip(y, x, f, g)]
    df = spark.createDataFrame([*rows, (None, 1.0, "a", "u"), (1.0, 1.0, "z", "u")], "y double, x double, f string, g string")
    out = {r.term: r for r in regress.linear_model(df, "y", ["x"], {"f": ["a", "b", "c"], "g": ["u", "v"]}).collect()}
    design = np.column_stack([np.ones(300), x - x.mean(), f == "b", f == "c", g == "v"]).astype(float)
    beta, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    se = np.sqrt(rss[0] / 295 * np.diag(np.linalg.inv(design.T @ design)))
    for i, t in enumerate(["x", "fb", "fc", "gv"], 1):
        assert out[t].n == 300
        assert abs(out[t].estimate - beta[i]) < 1e-7 and abs(out[t].std_error - se[i]) < 1e-7
        assert abs(out[t].conf_high - out[t].estimate - regress.t_critical(0.95, 295) * se[i]) < 1e-7


def test_penalised_sweep_reproduces_linear_signal(spark):
    xs = [1995.0 + 0.25 * i for i in range(25)]
    df = spark.createDataFrame([(x, 3.0 + 2.0 * (x - 1995.0)) for x in xs], "year double, precip double")
    gammas = spark.createDataFrame([(0.001,), (1.0,), (1000.0,)], "gamma double")
    out = regress.penalised_sweep(df, "year", "precip", [1995.0, 1997.0, 1999.0, 2001.0], gammas, df.select("year"))
    rows = out.collect()
    assert len(rows) == 3 * 25
    for r in rows:
        assert abs(r.fitted - (3.0 + 2.0 * (r.year - 1995.0))) < 1e-7


def test_station_draws_cover_all_stations(spark):
    from pluvio.plans.q_gev import station_draws

    vectors = spark.createDataFrame([(10 + 3 * v, d, 1000.0 * v + d) for v in range(7) for d in range(1, 65)], "vec_id long, dim int, x double")
    for n in (64, 150, 400):
        blocks = -(-n // 64)
        stations = spark.createDataFrame([(s * s,) for s in range(n)], "station long")  # sparse numbers
        got = {(r.draw, r.pos): r.x for r in station_draws(vectors, stations).collect()}
        draws = -(-7 // blocks)
        assert got == {
            (d, b * 64 + i - 1): 1000.0 * ((d * blocks + b) % 7) + i for d in range(draws) for b in range(blocks) for i in range(1, 65)
        }


def test_heldout_scores_every_station(spark):
    from pluvio.plans.q_gev import _heldout_test, station_draws

    test, vectors = _heldout_test(spark, "/root/testdata/sf0.01")
    n = test.count()
    assert n > 64 and sorted(r.pos for r in test.collect()) == list(range(n))
    assert station_draws(vectors, test).join(test, "pos").groupBy("draw").count().where(f"count != {n}").count() == 0


def _least_squares(x, y):
    """(estimates, standard errors, statistics, residual sum of squares) by numpy."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = float(((y - x @ beta) ** 2).sum())
    se = np.sqrt(rss / (len(y) - x.shape[1]) * np.diag(np.linalg.inv(x.T @ x)))
    return beta, se, beta / se, rss


def _two_sided(t, nu):
    """P(|T| > |t|) by the trapezoid rule over theta = atan(s / sqrt(nu)), where the density is cos(theta) ** (nu - 1)."""
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
    theta = np.linspace(math.atan(abs(t) / math.sqrt(nu)), math.pi / 2, 200_001)
    return 2 * c * float(np.trapezoid(np.cos(theta) ** (nu - 1), theta))


def test_fit_queries_match_numpy(spark):
    from pluvio.plans import q_spatial
    from pluvio.plans.catalog import REGISTRY

    rows = defaultdict(dict)
    for r in q_spatial._complete_neighbours(spark, SMALL)[0].collect():
        rows[r.station].setdefault(r.month, {})[r.type] = (r.y, r.x)
    fits = defaultdict(dict)
    for r in REGISTRY["site_regression_fits"].build(spark, SMALL).collect():
        fits[r.station][r.term] = r
    assert set(fits) == set(rows) and len(fits) > 0
    for station, got in fits.items():
        terms = sorted(got)
        months = list(rows[station].values())
        assert all(sorted(m) == terms for m in months)
        x = np.array([[m[t][1] for t in terms] for m in months])
        y = np.array([m[terms[0]][0] for m in months])
        beta, se, stat, rss = _least_squares(x, y)
        for i, t in enumerate(terms):
            r = got[t]
            assert r.n == len(y) and np.allclose([r.estimate, r.std_error, r.statistic, r.tau2], [beta[i], se[i], stat[i], rss / len(y)], rtol=1e-6)
            assert math.isclose(r.p_value, _two_sided(stat[i], len(y) - len(terms)), rel_tol=1e-5, abs_tol=1e-12)

    data = q_spatial._orders_model(spark, SMALL)[0].toPandas()
    fit = {r.term: r for r in REGISTRY["linear_model_fit"].build(spark, SMALL).collect()}
    design = {"(Intercept)": np.ones(len(data)), "c_acctbal": data.c_acctbal.astype(float)}
    design |= {f"c_mktsegment{v}": (data.c_mktsegment == v).astype(float) for v in q_spatial.SEGMENTS[1:]}
    design |= {f"o_orderpriority{v}": (data.o_orderpriority == v).astype(float) for v in q_spatial.PRIORITIES[1:]}
    assert list(design) == list(fit)
    beta, se, stat, _ = _least_squares(np.column_stack(list(design.values())), data.o_totalprice.astype(float).to_numpy())
    for i, t in enumerate(design):
        r = fit[t]
        assert r.n == len(data) and np.allclose([r.estimate, r.std_error, r.statistic], [beta[i], se[i], stat[i]], rtol=1e-6)
        assert math.isclose(r.p_value, _two_sided(stat[i], len(data) - len(beta)), rel_tol=1e-5, abs_tol=1e-12)
