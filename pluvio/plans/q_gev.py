"""GEV margins, distribution functions and copulas (E, N, C rows)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pluvio.functions import dist
from pluvio.functions import sqltext as S
from pluvio.operators import copula, gev, profile, windows
from pluvio.plans.fixtures import EMBEDDING_SIZE, Fixtures, margin_pairs
from pluvio.plans.oracle_fixtures import rnd, with_ctes
from pluvio.plans.registry import query
from pluvio.session import materialize

# The fixture's trend origin (FIXTURES.md: years 1995-2001, t0 = 1995).
T0 = 1995

_NAT = (
    "nat",
    "SELECT station, exp(psi) AS mu0, exp(psi + tau) AS sigma, "
    f"{S.shape_link_inverse('phi')} AS xi, {S.trend_link_inverse('gamma')} AS delta FROM params",
)
_SCORED = (
    "scored",
    "SELECT p.station, p.year, p.precip, n.mu0, n.sigma, n.xi, n.delta, "
    f"{S.trend_location('n.mu0', 'n.delta', 'p.year', T0)} AS mu FROM precip p JOIN nat n ON n.station = p.station",
)
_SCORED_P = (
    "scored_p",
    f"SELECT *, {S.gev_cdf('precip', 'mu', 'sigma', 'xi')} AS p FROM scored",
)


def _scored(fx: Fixtures):
    return gev.predictive_p(fx.precip(), fx.params(), t0=T0)


@query(
    "gev_scores",
    "E1 E2 E3 E4 E11 J1 J3",
    with_ctes(
        f"SELECT station, year, {rnd('mu', 3)} AS mu, {rnd('p', 9)} AS p, "
        f"{rnd(S.gev_logpdf('precip', 'mu', 'sigma', 'xi'), 9)} AS logpdf, "
        f"{rnd(S.gev_quantile('p', 'mu', 'sigma', 'xi'), 3)} AS q_back FROM scored_p",
        "params", "precip", extra=[_NAT, _SCORED, _SCORED_P],
    ),
)
def gev_scores(spark, sf):
    s = _scored(Fixtures(spark, sf))
    return s.select(
        "station", "year", F.round("mu", 3).alias("mu"), F.round("p", 9).alias("p"),
        F.round(dist.gev_logpdf("precip", "mu", "sigma", "xi"), 9).alias("logpdf"),
        F.round(dist.gev_quantile(F.col("p"), "mu", "sigma", "xi"), 3).alias("q_back"),
    )


@query(
    "gev_link_variants",
    "E6 E7 E8 F10",
    with_ctes(
        "SELECT station, "
        f"{rnd(S.shape_link_inverse('phi'), 9)} AS xi_power, "
        f"{rnd(S.inv_logit('phi') + ' - 0.5', 9)} AS xi_logit_centered, "
        f"{rnd('0.5 * ' + S.inv_logit('phi'), 9)} AS xi_logit_half, "
        f"{rnd('exp(phi) - 0.5', 9)} AS xi_exp_shift, "
        f"{rnd(S.trend_link_inverse('gamma'), 9)} AS delta_tanh, "
        f"{rnd('0.02 * ' + S.inv_logit('gamma') + ' - 0.01', 9)} AS delta_logit_centered, "
        f"{rnd('0.008 * ' + S.inv_logit('gamma'), 9)} AS delta_logit_scaled, "
        f"{rnd(S.shape_link(S.shape_link_inverse('phi')), 9)} AS phi_back, "
        f"{rnd(S.trend_link(S.trend_link_inverse('gamma')), 9)} AS gamma_back, "
        f"{rnd(S.shape_link_inverse('phi', 0.5), 9)} AS xi_power_c05 FROM params",
        "params",
    ),
)
def gev_link_variants(spark, sf):
    p = Fixtures(spark, sf).params()
    cols = {f"xi_{k}": f("phi") for k, f in dist.SHAPE_LINKS.items()}
    cols.update({f"delta_{k}": f("gamma") for k, f in dist.TREND_LINKS.items()})
    cols["phi_back"] = dist.shape_link(dist.shape_link_inverse("phi"))
    cols["gamma_back"] = dist.trend_link(dist.trend_link_inverse("gamma"))
    cols["xi_power_c05"] = dist.shape_link_inverse("phi", 0.5)
    return p.select("station", *[(F.round(c, 9) + F.lit(0.0)).alias(k) for k, c in cols.items()])


@query(
    "station_loglik",
    "E9",
    with_ctes(
        "SELECT station, count(*) AS n_years, bool_and(lp IS NOT NULL) AS feasible, "
        f"CASE WHEN bool_and(lp IS NOT NULL) THEN {rnd('-sum(lp)', 6)} END AS neg_log_lik "
        f"FROM (SELECT station, {S.gev_logpdf('precip', 'mu', 'sigma', 'xi')} AS lp FROM scored) GROUP BY station",
        "params", "precip", extra=[_NAT, _SCORED],
    ),
)
def station_loglik(spark, sf):
    ll = gev.station_loglik(_scored(Fixtures(spark, sf)))
    return ll.withColumn("neg_log_lik", F.round("neg_log_lik", 6))


#: Priors of the maximum-posterior fit: weak on location and scale, tight on shape and trend.
PRIORS = {"psi": (10.0, 4.0), "tau": (-1.0, 2.0), "phi": (0.0, 0.3), "gamma": (0.0, 0.004)}
_PRIORS = {n: gev.normal_prior(m, sd) for n, (m, sd) in PRIORS.items()}


def _prior_sql(name: str) -> str:
    m, sd = PRIORS[name]
    return f"(-0.5 * ln(2.0 * pi()) - ln({sd!r}) - ({name} - ({m!r})) * ({name} - ({m!r})) / (2.0 * {sd!r} * {sd!r}))"


@query(
    "station_posterior",
    "E9",
    with_ctes(
        "SELECT l.station, l.n_years, l.feasible, CASE WHEN l.feasible THEN "
        f"{rnd('-(l.ll + ' + ' + '.join(_prior_sql(n) for n in PRIORS) + ')', 6)} END AS neg_log_post FROM "
        "(SELECT station, count(*) AS n_years, bool_and(lp IS NOT NULL) AS feasible, sum(lp) AS ll "
        f"FROM (SELECT station, {S.gev_logpdf('precip', 'mu', 'sigma', 'xi')} AS lp FROM scored) GROUP BY station) l "
        "JOIN params USING (station)",
        "params", "precip", extra=[_NAT, _SCORED],
    ),
)
def station_posterior(spark, sf):
    """E9 with the priors added: likelihood and log priors per station."""
    fx = Fixtures(spark, sf)
    scored = gev.predictive_p(fx.precip(), fx.params(), T0, keep=list(PRIORS))
    ll = gev.station_loglik(scored, priors=_PRIORS)
    return ll.select("station", "n_years", "feasible", F.round("neg_log_lik", 6).alias("neg_log_post"))


@query("gev_fit", "E10 X1 S13")
def gev_fit(spark, sf):
    """Per-station maximum-likelihood and maximum-posterior fits; the nested par column unnested."""
    precip = Fixtures(spark, sf).precip()
    fits = [
        gev.fit_station_gev(precip, t0=T0, priors=priors).withColumn("model_type", F.lit(label))
        for label, priors in (("ml", None), ("map", _PRIORS))
    ]
    both = fits[0].unionByName(fits[1])
    return both.select("station", "model_type", "converged", "neg_log_lik", F.size("hess").alias("hess_dim"), F.inline("par"))


@query(
    "gev_fit_certificate",
    "E10 E9 X1",
    with_ctes(
        "SELECT station, model_type, count(*) AS n_years, true AS converged, 0.0::DOUBLE AS value_gap, "
        + ", ".join(f"0.0::DOUBLE AS score_{n}" for n in gev.PAR_NAMES)
        + " FROM precip, (VALUES ('ml'), ('map')) AS m(model_type) GROUP BY ALL",
        "precip",
    ),
)
def gev_fit_certificate(spark, sf):
    """The fits are minima: differences of the likelihood's own expressions (E9) at the fit round to zero."""
    precip = Fixtures(spark, sf).precip()
    parts = []
    for label, priors in (("ml", None), ("map", _PRIORS)):
        fits = materialize(gev.fit_station_gev(precip, t0=T0, priors=priors), "gev-fit")
        c = gev.fit_certificate(precip, fits, T0, priors).join(fits.select("station", "converged"), "station")
        parts.append(c.withColumn("model_type", F.lit(label)))
    both = parts[0].unionByName(parts[1])
    zero = ["value_gap", *[f"score_{n}" for n in gev.PAR_NAMES]]
    return both.select("station", "model_type", "n_years", "converged", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in zero])


_QQ = (
    "qq",
    "SELECT station, year, precip, p, q, sqrt(avg((p - q) * (p - q)) OVER (PARTITION BY station)) AS station_diff, "
    "sqrt(avg((p - q) * (p - q)) OVER (PARTITION BY year)) AS year_diff FROM "
    "(SELECT *, row_number() OVER (PARTITION BY station ORDER BY precip - mu, year) / "
    "(count(*) OVER (PARTITION BY station) + 1) AS q FROM scored_p)",
)


@query(
    "qq_table",
    "E12 W2 W3",
    with_ctes(
        f"SELECT station, year, precip, {rnd('p', 9)} AS p, {rnd('q', 9)} AS q, "
        f"{rnd('station_diff', 9)} AS station_diff, {rnd('year_diff', 9)} AS year_diff FROM qq",
        "params", "precip", extra=[_NAT, _SCORED, _SCORED_P, _QQ],
    ),
)
def qq_table(spark, sf):
    qq = gev.qq_table(_scored(Fixtures(spark, sf)))
    return qq.select("station", "year", "precip", *[F.round(c, 9).alias(c) for c in ["p", "q", "station_diff", "year_diff"]])


def _worst_sql(desc: bool) -> str:
    order = "DESC" if desc else "ASC"
    return with_ctes(
        f"SELECT station, year, {rnd('p', 9)} AS p, {rnd('q', 9)} AS q FROM qq WHERE station IN "
        f"(SELECT station FROM (SELECT DISTINCT station, station_diff FROM qq) "
        f"ORDER BY station_diff {order}, station LIMIT 9)",
        "params", "precip", extra=[_NAT, _SCORED, _SCORED_P, _QQ],
    )


@query("worst_fit_stations", "T2 R6 R7", _worst_sql(True))
def worst_fit_stations(spark, sf):
    qq = gev.qq_table(_scored(Fixtures(spark, sf)))
    return gev.worst_stations(qq, 9, worst=True).select("station", "year", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query("best_fit_stations", "T3", _worst_sql(False))
def best_fit_stations(spark, sf):
    qq = gev.qq_table(_scored(Fixtures(spark, sf)))
    return gev.worst_stations(qq, 9, worst=False).select("station", "year", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


def _t3_sql(base: str, p: str, keep: str = "*") -> str:
    return S.nest_steps(base, keep, S.t3_ppf_steps(p))


@query(
    "t_scores",
    "E13 N4 A6 P20",
    with_ctes(
        f"SELECT station, year, 'ml' AS model_type, {rnd('avg(CASE WHEN ' + S.is_finite('t3_val') + ' THEN t3_val END)', 9)} AS t_val "
        f"FROM ({_t3_sql('SELECT station, year, p FROM scored_p', 'p')}) GROUP BY station, year",
        "params", "precip", extra=[_NAT, _SCORED, _SCORED_P],
    ),
)
def t_scores(spark, sf):
    t = gev.t_scores(_scored(Fixtures(spark, sf)), 3)
    return t.select("station", "year", F.lit("ml").alias("model_type"), F.round("t_val", 9).alias("t_val"))


# Posterior draws of the stations' parameters: every order line of a station is a draw around its estimates.
_STATION_POSTERIOR = (
    "posterior",
    "SELECT l.l_suppkey AS station, l.l_linenumber AS chain, l.l_orderkey AS iteration, "
    "n.psi + (l.l_quantity - 25.0) / 2000.0 AS psi, n.tau + (l.l_discount - 0.05) AS tau, "
    "n.phi + (l.l_tax - 0.04) AS phi, n.gamma AS gamma FROM lineitem l JOIN params n ON n.station = l.l_suppkey",
)


def _station_posterior_draws(fx: Fixtures):
    line = fx.table("lineitem").select(
        F.col("l_suppkey").alias("station"), F.col("l_linenumber").alias("chain"), F.col("l_orderkey").alias("iteration"),
        "l_quantity", "l_discount", "l_tax",
    )
    return line.join(fx.params(), "station").select(
        "station", "chain", "iteration",
        (F.col("psi") + (F.col("l_quantity") - 25.0) / 2000.0).alias("psi"), (F.col("tau") + (F.col("l_discount") - 0.05)).alias("tau"),
        (F.col("phi") + (F.col("l_tax") - 0.04)).alias("phi"), "gamma",
    )


@query(
    "t_scores_by_model",
    "E13 U1 A6",
    with_ctes(
        f"SELECT station, year, 'ml' AS model_type, {rnd('avg(CASE WHEN ' + S.is_finite('t3_val') + ' THEN t3_val END)', 8)} AS t_val "
        f"FROM ({_t3_sql('SELECT station, year, p FROM scored_p', 'p')}) GROUP BY station, year UNION ALL "
        f"SELECT station, year, 'mcmc' AS model_type, {rnd('avg(CASE WHEN ' + S.is_finite('t3_val') + ' THEN t3_val END)', 8)} AS t_val "
        f"FROM ({_t3_sql('SELECT station, year, p FROM drawn_p', 'p')}) GROUP BY station, year",
        "params", "precip",
        extra=[
            _NAT, _SCORED, _SCORED_P, _STATION_POSTERIOR,
            ("drawn_nat", "SELECT station, exp(psi) AS mu0, exp(psi + tau) AS sigma, "
                          f"{S.shape_link_inverse('phi')} AS xi, {S.trend_link_inverse('gamma')} AS delta FROM posterior"),
            ("drawn", f"SELECT p.station, p.year, p.precip, n.sigma, n.xi, {S.trend_location('n.mu0', 'n.delta', 'p.year', T0)} AS mu "
                      "FROM precip p JOIN drawn_nat n ON n.station = p.station"),
            ("drawn_p", f"SELECT station, year, {S.gev_cdf('precip', 'mu', 'sigma', 'xi')} AS p FROM drawn"),
        ],
    ),
)
def t_scores_by_model(spark, sf):
    """t scores of the estimates ('ml') beside their means over all posterior draws ('mcmc')."""
    fx = Fixtures(spark, sf)
    ml = gev.t_scores(_scored(fx), 3).withColumn("model_type", F.lit("ml"))
    mcmc = gev.posterior_t_scores(fx.precip(), _station_posterior_draws(fx), T0, 3).withColumn("model_type", F.lit("mcmc"))
    both = ml.unionByName(mcmc)
    return both.select("station", "year", "model_type", F.round("t_val", 8).alias("t_val"))


# ---------------------------------------------------------------------------
# Uniforms from the embedding margins
# ---------------------------------------------------------------------------

_UNIF = (
    "unif",
    "SELECT vec_id, dim, x, (rank() OVER (PARTITION BY dim ORDER BY x) + "
    "(count(*) OVER (PARTITION BY dim, x) - 1) / 2.0) / (count(*) OVER (PARTITION BY dim) + 1) AS u FROM vectors",
)


def _unif(fx: Fixtures):
    # a margin is a whole column of the vectors table: ranks come from the
    # distributed sorted positions, not a window over the margin
    return windows.global_average_rank_uniform(fx.vectors(), ["dim"], "x", "u")


@query(
    "normal_exponential_functions",
    "N1 N2 N5 W11",
    with_ctes(
        f"SELECT vec_id, dim, {rnd('u', 9)} AS u, {rnd(S.norm_ppf('u'), 9)} AS z, "
        f"{rnd(S.norm_cdf(S.norm_ppf('u')), 9)} AS u_back, {rnd(S.exp_ppf('u', '2.0'), 9)} AS y_exp, "
        f"{rnd(S.exp_cdf(S.exp_ppf('u', '2.0'), '2.0'), 9)} AS u_exp_back, "
        f"{rnd(S.exp_logpdf(S.exp_ppf('u', '2.0'), '2.0'), 9)} AS exp_logpdf, "
        f"{rnd(S.norm_cdf('x * 10.0'), 9)} AS phi_x FROM unif",
        "vectors", extra=[_UNIF],
    ),
)
def normal_exponential_functions(spark, sf):
    u = _unif(Fixtures(spark, sf))
    y = dist.exp_ppf("u", 2.0)
    return u.select(
        "vec_id", "dim", F.round("u", 9).alias("u"), F.round(dist.norm_ppf("u"), 9).alias("z"),
        F.round(dist.norm_cdf(dist.norm_ppf("u")), 9).alias("u_back"), F.round(y, 9).alias("y_exp"),
        F.round(dist.exp_cdf(y, 2.0), 9).alias("u_exp_back"), F.round(dist.exp_logpdf(y, 2.0), 9).alias("exp_logpdf"),
        F.round(dist.norm_cdf(F.col("x") * 10.0), 9).alias("phi_x"),
    )


@query(
    "student_t_functions",
    "N3 N4",
    with_ctes(
        f"SELECT vec_id, dim, {rnd(S.t_ppf_closed('u', 1), 9)} AS t1, {rnd(S.t_ppf_closed('u', 2), 9)} AS t2, "
        f"{rnd('t3_val', 9)} AS t3, {rnd(S.t_cdf('t3_val', 3), 9)} AS u_back3, "
        f"{rnd(S.t_cdf(S.t_ppf_closed('u', 2), 2), 9)} AS u_back2, {rnd(S.t_cdf('x * 10.0', 1), 9)} AS cdf1_x, "
        f"{rnd(S.t_logpdf('t3_val', 3), 9)} AS logpdf3, {rnd(S.t_cdf_int('x * 10.0', '5'), 9)} AS cdf5_x "
        f"FROM ({_t3_sql('SELECT * FROM unif', 'u')})",
        "vectors", extra=[_UNIF],
    ),
)
def student_t_functions(spark, sf):
    u = _unif(Fixtures(spark, sf)).withColumn("t3", dist.t_ppf("u", 3))
    return u.select(
        "vec_id", "dim",
        F.round(dist.t_ppf("u", 1), 9).alias("t1"), F.round(dist.t_ppf("u", 2), 9).alias("t2"),
        F.round("t3", 9).alias("t3"), F.round(dist.t_cdf("t3", 3), 9).alias("u_back3"),
        F.round(dist.t_cdf(dist.t_ppf("u", 2), 2), 9).alias("u_back2"),
        F.round(dist.t_cdf(F.col("x") * 10.0, 1), 9).alias("cdf1_x"),
        F.round(dist.t_logpdf("t3", 3), 9).alias("logpdf3"),
        F.round(dist.t_cdf_real(F.col("x") * 10.0, 5), 9).alias("cdf5_x"),
    )


@query(
    "independence_copula",
    "C1",
    with_ctes(f"SELECT vec_id, {rnd('sum(ln(u))', 6)} AS log_C FROM unif GROUP BY vec_id", "vectors", extra=[_UNIF]),
)
def independence_copula(spark, sf):
    c = copula.independence_log_cdf(_unif(Fixtures(spark, sf)), ["vec_id"], "u")
    return c.select("vec_id", F.round("log_C", 6).alias("log_C"))


# Fixed copula parameters used by the copula queries.
GAUSS_RHO = 0.5
AR1_RHO = 0.3
T_NU = 3
DIMS = EMBEDDING_SIZE


def _linv_sql(sigma: np.ndarray) -> tuple[str, float]:
    L = np.linalg.cholesky(sigma)
    Li = np.linalg.inv(L)
    vals = ", ".join(
        f"({i + 1}, {j + 1}, {float(Li[i, j])!r})" for i in range(len(Li)) for j in range(i + 1) if Li[i, j] != 0.0
    )
    return f"SELECT * FROM (VALUES {vals}) AS t(i, j, v)", float(np.sum(np.log(np.diag(L))))


def _quadform_sql(src: str, key: str, index: str, value: str) -> str:
    return (
        f"SELECT {key}, sum(mx * mx) AS qf FROM (SELECT s.{key}, l.i, sum(l.v * s.{value}) AS mx "
        f"FROM {src} s JOIN linv l ON l.j = s.{index} GROUP BY s.{key}, l.i) GROUP BY {key}"
    )


def _t_general_sql() -> str:
    nu = 5
    linv, ld = _linv_sql(copula.equicorrelation(DIMS, GAUSS_RHO))
    const = math.lgamma((nu + DIMS) / 2) - math.lgamma(nu / 2) - DIMS / 2 * math.log(nu * math.pi) - ld
    tq = S.nest_steps("SELECT vec_id, dim, u FROM unif", "*", S.t_ppf_int_steps("u", nu))
    return with_ctes(
        f"SELECT t.vec_id, t.dim, {rnd('t.x', 9)} AS t5, {rnd(S.t_cdf_int('t.x', str(nu)) + ' - t.u', 12)} AS round_trip_error, "
        f"{rnd(f'{const!r} - {(nu + DIMS) / 2.0!r} * ln(1.0 + q.qf / {float(nu)!r}) - m.lm', 6)} AS log_c_nu5 "
        f"FROM xt t JOIN ({_quadform_sql('xt', 'vec_id', 'dim', 'x')}) q ON q.vec_id = t.vec_id JOIN "
        f"(SELECT vec_id, sum({S.t_logpdf('x', nu)}) AS lm FROM xt GROUP BY vec_id) m ON m.vec_id = t.vec_id",
        "vectors",
        extra=[_UNIF, ("xt", f"SELECT vec_id, dim, u, tb_val AS x FROM ({tq})"), ("linv", linv)],
    )


@query("student_t_general", "N3 N4 C5", _t_general_sql())
def student_t_general(spark, sf):
    """Integer-nu t quantiles (bisection) and their series CDF round trip on the
    embedding margins; the t copula with nu = 5 on the same uniforms."""
    u = _unif(Fixtures(spark, sf))
    t = u.select("vec_id", "dim", "u", dist.t_ppf_real("u", 5).alias("t5"))
    t = t.withColumn("u_back", dist.t_cdf_real("t5", 5))
    linv, ld = copula.cholesky_inverse_coo(spark, copula.equicorrelation(DIMS, GAUSS_RHO))
    lc = copula.t_copula_logc(u, ["vec_id"], "dim", "u", linv, ld, 5, DIMS)
    return t.join(lc, "vec_id").select(
        "vec_id", "dim", F.round("t5", 9).alias("t5"), F.round(F.col("u_back") - F.col("u"), 12).alias("round_trip_error"),
        F.round("log_c", 6).alias("log_c_nu5"),
    )


@query(
    "gaussian_copula",
    "C2",
    (lambda linv, ld: with_ctes(
        f"SELECT q.vec_id, {rnd(f'{-ld!r} - 0.5 * (q.qf - z.zz)', 6)} AS log_c FROM "
        f"({_quadform_sql('zt', 'vec_id', 'dim', 'z')}) q JOIN "
        "(SELECT vec_id, sum(z * z) AS zz FROM zt GROUP BY vec_id) z ON z.vec_id = q.vec_id",
        "vectors", extra=[_UNIF, ("zt", f"SELECT vec_id, dim, {S.norm_ppf('u')} AS z FROM unif"), ("linv", linv)],
    ))(*_linv_sql(copula.equicorrelation(DIMS, GAUSS_RHO))),
)
def gaussian_copula(spark, sf):
    linv, ld = copula.cholesky_inverse_coo(spark, copula.equicorrelation(DIMS, GAUSS_RHO))
    c = copula.gaussian_copula_logc(_unif(Fixtures(spark, sf)), ["vec_id"], "dim", "u", linv, ld)
    return c.select("vec_id", F.round("log_c", 6).alias("log_c"))


_PIT = (
    "pit",
    "SELECT station, year, CAST(year - 1994 AS INTEGER) AS id, p AS u FROM scored_p",
)


#: Sum over neighbours (z, nz) of the logarithm of the conditional density ratio f(nz | z) / f(nz).
_AR1_SQL = (
    f"coalesce(sum(nz * nz / 2.0 - power(nz - {AR1_RHO!r} * z, 2) / (2.0 * (1.0 - {AR1_RHO!r} * {AR1_RHO!r}))), 0.0)"
    f" - count(nz) * ln(1.0 - {AR1_RHO!r} * {AR1_RHO!r}) / 2.0"
)


@query(
    "ar1_copula",
    "C3 W10",
    with_ctes(
        "SELECT station, "
        f"{rnd(_AR1_SQL, 9)} AS log_c FROM (SELECT a.station, a.z, b.z AS nz FROM zs a LEFT JOIN zs b ON b.station = a.station AND b.rk = a.rk + 1) "
        "GROUP BY station",
        "params", "precip",
        extra=[_NAT, _SCORED, _SCORED_P, _PIT,
               ("zs", f"SELECT station, row_number() OVER (PARTITION BY station ORDER BY id) AS rk, {S.norm_ppf('u')} AS z FROM pit")],
    ),
)
def ar1_copula(spark, sf):
    s = _scored(Fixtures(spark, sf)).select("station", (F.col("year") - 1994).cast("int").alias("id"), F.col("p").alias("u"))
    c = copula.ar1_copula_logc(s, ["station"], "id", "u", AR1_RHO)
    return c.select("station", F.round("log_c", 9).alias("log_c"))


@query(
    "precision_cholesky_copula",
    "C4 C13",
    with_ctes(
        "SELECT station, "
        f"{rnd('max(ld) - 0.5 * sum(rz * rz) + 0.5 * max(zz)', 9)} AS log_c FROM ("
        "SELECT z.station, r.i, sum(r.v * z.z) AS rz, max(z2.zz) AS zz, max(nd.ld) AS ld FROM zt z "
        "JOIN rchol r ON r.j = z.id JOIN (SELECT station, sum(z * z) AS zz FROM zt GROUP BY station) z2 "
        "ON z2.station = z.station CROSS JOIN nd GROUP BY z.station, r.i) GROUP BY station",
        "params", "precip",
        extra=[_NAT, _SCORED, _SCORED_P, _PIT,
               ("zt", f"SELECT station, id, {S.norm_ppf('u')} AS z FROM pit"),
               ("ids", "SELECT DISTINCT id FROM pit"),
               ("nd", f"SELECT (count(*) - 1) * {math.log(1 / math.sqrt(1 - AR1_RHO ** 2))!r} AS ld, max(id) AS hi FROM ids"),
               ("rchol",
                f"SELECT id AS i, id AS j, CASE WHEN id = (SELECT hi FROM nd) THEN 1.0 ELSE {1 / math.sqrt(1 - AR1_RHO ** 2)!r} END AS v FROM ids "
                f"UNION ALL SELECT a.id AS i, b.id AS j, {-AR1_RHO / math.sqrt(1 - AR1_RHO ** 2)!r} AS v FROM ids a JOIN ids b ON b.id = a.id + 1")],
    ),
)
def precision_cholesky_copula(spark, sf):
    """AR(1) copula again, through the sparse precision-Cholesky path."""
    s = _scored(Fixtures(spark, sf)).select("station", (F.col("year") - 1994).cast("int").alias("id"), F.col("p").alias("u"))
    r, ld = copula.ar1_precision_cholesky_table(s.select("id"), AR1_RHO)
    c = copula.precision_cholesky_logc(s, ["station"], "id", "u", r, ld)
    return c.select("station", F.round("log_c", 9).alias("log_c"))


@query(
    "ar1_precision",
    "C13",
    with_ctes(
        f"SELECT i, j, {rnd('CAST(v AS DOUBLE)', 9)} AS v FROM (SELECT id AS i, id AS j, CASE WHEN id = lo OR id = hi THEN {1 / (1 - AR1_RHO ** 2)!r} "
        f"ELSE {(1 + AR1_RHO ** 2) / (1 - AR1_RHO ** 2)!r} END AS v FROM ids CROSS JOIN (SELECT min(id) AS lo, max(id) AS hi FROM ids) "
        f"UNION ALL SELECT a.id, b.id, {-AR1_RHO / (1 - AR1_RHO ** 2)!r} FROM ids a JOIN ids b ON abs(a.id - b.id) = 1)",
        "precip", extra=[("ids", "SELECT DISTINCT CAST(year - 1994 AS INTEGER) AS id FROM precip")],
    ),
)
def ar1_precision(spark, sf):
    ids = Fixtures(spark, sf).precip().select((F.col("year") - 1994).cast("int").alias("id"))
    q = copula.ar1_precision_coo(spark, ids, AR1_RHO)
    return q.select("i", "j", F.round("v", 9).alias("v"))


@query(
    "ar1_correlation",
    "C13",
    with_ctes(
        f"SELECT i, j, {rnd(f'pow({AR1_RHO!r}, abs(i - j))', 9)} AS v FROM (SELECT DISTINCT a.id AS i, b.id AS j FROM ids a JOIN ids b ON a.station = b.station)",
        "precip", extra=[("ids", "SELECT station, CAST(year - 1994 AS INTEGER) AS id FROM precip")],
    ),
)
def ar1_correlation(spark, sf):
    """Entries of the AR(1) correlation at the pairs of years that some station has."""
    ids = Fixtures(spark, sf).precip().select("station", (F.col("year") - 1994).cast("int").alias("id"))
    # a station has its years: the list is as long as the record, and its pairs are distinct before any shuffle of them
    years = ids.groupBy("station").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("ids").distinct()
    pairs = years.select(F.explode("ids").alias("i"), "ids").select("i", F.explode("ids").alias("j")).distinct()
    return copula.ar1_correlation_entries(pairs, AR1_RHO).select("i", "j", F.round("v", 9).alias("v"))


@query(
    "t_copula",
    "C5 N3 N4",
    (lambda linv, ld: with_ctes(
        f"SELECT q.vec_id, {rnd(f'{math.lgamma((T_NU + DIMS) / 2) - math.lgamma(T_NU / 2) - DIMS / 2 * math.log(T_NU * math.pi) - ld!r} - {(T_NU + DIMS) / 2.0!r} * ln(1.0 + q.qf / {float(T_NU)!r}) - m.lm', 6)} AS log_c "
        f"FROM ({_quadform_sql('xt', 'vec_id', 'dim', 'x')}) q JOIN "
        f"(SELECT vec_id, sum({S.t_logpdf('x', T_NU)}) AS lm FROM xt GROUP BY vec_id) m ON m.vec_id = q.vec_id",
        "vectors",
        extra=[_UNIF, ("xt", f"SELECT vec_id, dim, t3_val AS x FROM ({_t3_sql('SELECT vec_id, dim, u FROM unif', 'u')})"),
               ("linv", linv)],
    ))(*_linv_sql(copula.equicorrelation(DIMS, GAUSS_RHO))),
)
def t_copula(spark, sf):
    linv, ld = copula.cholesky_inverse_coo(spark, copula.equicorrelation(DIMS, GAUSS_RHO))
    c = copula.t_copula_logc(_unif(Fixtures(spark, sf)), ["vec_id"], "dim", "u", linv, ld, T_NU, DIMS)
    return c.select("vec_id", F.round("log_c", 6).alias("log_c"))


# Fixed Archimedean parameters.
ARCH_THETA = {"clayton": 2.0, "gumbel": 1.5, "frank": 3.0}


def _arch_sql() -> str:
    t = ARCH_THETA
    em = math.expm1(-t["frank"])
    parts = [
        f"SELECT vec_id, 'clayton' AS family, -ln(1.0 + sum(pow(u, -{t['clayton']!r}) - 1.0)) / {t['clayton']!r} AS lc "
        "FROM unif GROUP BY vec_id",
        f"SELECT vec_id, 'gumbel' AS family, -pow(sum(pow(-ln(u), {t['gumbel']!r})), 1.0 / {t['gumbel']!r}) AS lc "
        "FROM unif GROUP BY vec_id",
        # -ln(1 + y) by its series where y is small
        "SELECT vec_id, 'frank' AS family, ln((CASE WHEN abs(y) < 1e-3 THEN -y + y * y / 2 - y * y * y / 3 + y * y * y * y / 4 "
        f"ELSE -ln(1.0 + y) END) / {t['frank']!r}) AS lc FROM "
        f"(SELECT vec_id, exp(sum(ln((exp(-{t['frank']!r} * u) - 1.0) / {em!r}))) * {em!r} AS y FROM unif GROUP BY vec_id)",
    ]
    return f"SELECT vec_id, family, {rnd('lc', 6)} AS log_C FROM (" + " UNION ALL ".join(parts) + ")"


@query("archimedean_copulas", "C6", with_ctes(_arch_sql(), "vectors", extra=[_UNIF]))
def archimedean_copulas(spark, sf):
    u = _unif(Fixtures(spark, sf))
    out = None
    for fam, theta in ARCH_THETA.items():
        c = copula.archimedean_log_cdf(u, ["vec_id"], "u", fam, theta).withColumn("family", F.lit(fam))
        out = c if out is None else out.unionByName(c)
    return out.select("vec_id", "family", F.round("log_C", 6).alias("log_C"))


@query(
    "frank_bivariate",
    "C7",
    with_ctes(
        f"SELECT a.vec_id, CAST((a.dim + 1) // 2 AS INTEGER) AS pair, {rnd(f'-ln(1.0 + (exp(-3.0 * a.u) - 1.0) * (exp(-3.0 * b.u) - 1.0) / {math.expm1(-3.0)!r}) / 3.0', 9)} AS C "
        "FROM unif a JOIN unif b ON a.vec_id = b.vec_id AND a.dim % 2 = 1 AND b.dim = a.dim + 1",
        "vectors", extra=[_UNIF],
    ),
)
def frank_bivariate(spark, sf):
    pairs = margin_pairs(_unif(Fixtures(spark, sf)))
    return pairs.select("vec_id", "pair", F.round(copula.frank_cdf_2d("u1", "u2", 3.0), 9).alias("C"))


_MARG = (
    "marg",
    "SELECT v.vec_id, v.dim, (v.x - m.mean) / m.sd AS zs, m.sd FROM vectors v JOIN "
    "(SELECT dim, avg(x) AS mean, stddev_samp(x) AS sd FROM vectors GROUP BY dim) m ON m.dim = v.dim",
)


@query(
    "joint_density",
    "C8 A4",
    (lambda linv, ld: with_ctes(
        f"SELECT q.vec_id, {rnd('lc', 6)} AS log_c, {rnd('lm', 6)} AS log_margins, {rnd('lc + lm', 6)} AS log_joint FROM "
        f"(SELECT q.vec_id, {-ld!r} - 0.5 * (q.qf - z.zz) AS lc FROM ({_quadform_sql('zt', 'vec_id', 'dim', 'z')}) q "
        "JOIN (SELECT vec_id, sum(z * z) AS zz FROM zt GROUP BY vec_id) z ON z.vec_id = q.vec_id) q "
        f"JOIN (SELECT vec_id, sum(-0.5 * zs * zs - {0.5 * math.log(2 * math.pi)!r} - ln(sd)) AS lm FROM marg GROUP BY vec_id) m "
        "ON m.vec_id = q.vec_id",
        "vectors",
        extra=[_MARG, ("zt", f"SELECT vec_id, dim, {S.norm_ppf(S.norm_cdf('zs'))} AS z FROM marg"), ("linv", linv)],
    ))(*_linv_sql(copula.equicorrelation(DIMS, GAUSS_RHO))),
)
def joint_density(spark, sf):
    """Gaussian copula with fitted normal margins: log c + sum log f."""
    fx = Fixtures(spark, sf)
    v = fx.vectors()
    m = profile.mean_sd(v, ["dim"], "x")  # one row per entry of a vector: broadcast
    mv = v.join(F.broadcast(m), "dim").withColumn("zs", (F.col("x") - F.col("mean")) / F.col("sd"))
    mv = mv.withColumn("u", dist.norm_cdf("zs"))
    linv, ld = copula.cholesky_inverse_coo(spark, copula.equicorrelation(DIMS, GAUSS_RHO))
    margins = F.sum(dist.norm_logpdf("zs") - F.log("sd")).alias("log_margins")
    joint = copula.gaussian_copula_logc(mv, ["vec_id"], "dim", "u", linv, ld, [margins])
    return joint.select(
        "vec_id", F.round("log_c", 6).alias("log_c"), F.round("log_margins", 6).alias("log_margins"),
        F.round(F.col("log_c") + F.col("log_margins"), 6).alias("log_joint"),
    )


@query(
    "marginal_chain",
    "C9 X2 N5 E3",
    with_ctes(
        f"SELECT vec_id, dim, {rnd('u', 9)} AS u, {rnd(S.exp_ppf('u', '2.0'), 9)} AS y_exp, "
        f"{rnd(S.gev_quantile('u', '0.0', '1.0', '0.1'), 9)} AS y_gev FROM "
        f"(SELECT vec_id, dim, {S.norm_cdf('zs')} AS u FROM marg)",
        "vectors", extra=[_MARG],
    ),
)
def marginal_chain(spark, sf):
    v = Fixtures(spark, sf).vectors()
    m = profile.mean_sd(v, ["dim"], "x")  # one row per entry of a vector: broadcast
    u = v.join(F.broadcast(m), "dim").withColumn("u", dist.norm_cdf((F.col("x") - F.col("mean")) / F.col("sd")))
    return u.select(
        "vec_id", "dim", F.round("u", 9).alias("u"), F.round(dist.exp_ppf("u", 2.0), 9).alias("y_exp"),
        F.round(dist.gev_quantile(F.col("u"), 0.0, 1.0, 0.1), 9).alias("y_gev"),
    )


@query(
    "correlation_dependence",
    "A11 C10 C12",
    with_ctes(
        f"SELECT var1, var2, {rnd('c', 9)} AS corr, {rnd(f'2.0 / {math.pi!r} * asin(c)', 9)} AS kendall, "
        f"{rnd(f'6.0 / {math.pi!r} * asin(c / 2.0)', 9)} AS spearman, "
        f"{rnd('2.0 * ' + S.t_cdf('-sqrt(2.0 * (1.0 - c) / (1.0 + c))', 2), 9)} AS lambda_t1, "
        f"{rnd('2.0 * ' + S.t_cdf('-sqrt(3.0 * (1.0 - c) / (1.0 + c))', 3), 9)} AS lambda_t2 FROM "
        "(SELECT a.dim AS var1, b.dim AS var2, CASE WHEN a.dim = b.dim THEN NULL ELSE corr(a.x, b.x) END AS c "
        "FROM vectors a JOIN vectors b ON a.vec_id = b.vec_id GROUP BY a.dim, b.dim)",
        "vectors",
    ),
)
def correlation_dependence(spark, sf):
    c = profile.correlation_long(Fixtures(spark, sf).vectors(), "vec_id", "dim", "x")
    r = F.col("corr")
    return c.select(
        "var1", "var2", F.round(r, 9).alias("corr"),
        F.round(copula.kendall_from_rho(r), 9).alias("kendall"),
        F.round(copula.spearman_from_rho(r), 9).alias("spearman"),
        F.round(copula.t_tail_dependence(r, 1), 9).alias("lambda_t1"),
        F.round(copula.t_tail_dependence(r, 2), 9).alias("lambda_t2"),
    )


REAL_NU = 2.5
_SIMPSON = 400


def _t_cdf_simpson(x: str, nu: float) -> str:
    """Student-t CDF by Simpson's rule over theta = atan(x / sqrt(nu)), where the density is cos(theta) ** (nu - 1)."""
    th = f"atan({x} / sqrt({nu!r}))"
    const = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
    weight = f"CASE WHEN k IN (0, {_SIMPSON}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    total = f"list_sum(list_transform(range(0, {_SIMPSON + 1}), lambda k: {weight} * pow(cos({th} * k / {_SIMPSON}.0), {nu - 1!r})))"
    return f"(0.5 + {const!r} * {th} / {3.0 * _SIMPSON!r} * {total})"


@query(
    "student_t_real",
    "N3 N4",
    with_ctes(
        f"SELECT vec_id, dim, {rnd(_t_cdf_simpson('(x * 10.0)', REAL_NU), 8)} AS cdf_x, 0.0::DOUBLE AS round_trip_err FROM vectors",
        "vectors",
    ),
)
def student_t_real(spark, sf):
    """Student t with real degrees of freedom: the CDF of every entry, and the quantile's way back to every uniform."""
    u = _unif(Fixtures(spark, sf))
    back = dist.t_cdf_real(dist.t_ppf_real("u", REAL_NU), REAL_NU)
    return u.select(
        "vec_id", "dim", F.round(dist.t_cdf_real(F.col("x") * 10.0, REAL_NU), 8).alias("cdf_x"),
        (F.round(back - F.col("u"), 11) + F.lit(0.0)).alias("round_trip_err"),
    )


@query(
    "tail_dependence_grid",
    "C10",
    "SELECT nu, rho, (round(CASE WHEN rho <= -1.0 THEN 0.0 WHEN rho >= 1.0 THEN 1.0 ELSE "
    f"2.0 * {S.t_cdf_int('(-sqrt((nu + 1.0) * (1.0 - rho) / (1.0 + rho)))', '(nu + 1)')} END, 9) + 0.0) AS lambda FROM "
    "(SELECT DISTINCT CAST(o_orderkey % 127 + 2 AS INTEGER) AS nu FROM orders), "
    "(SELECT DISTINCT CAST(p_partkey % 401 - 200 AS DOUBLE) / 200.0 AS rho FROM part)",
)
def tail_dependence_grid(spark, sf):
    """t tail dependence over degrees of freedom 2 to 128 and correlations from -1 to 1 in steps of 1 / 200."""
    fx = Fixtures(spark, sf)
    # 127 and 401 values at most, whatever the tables hold
    nu = fx.table("orders").select((F.col("o_orderkey") % 127 + 2).cast("int").alias("nu")).distinct()
    rho = fx.table("part").select(((F.col("p_partkey") % 401 - 200).cast("double") / 200.0).alias("rho")).distinct()
    grid = nu.crossJoin(F.broadcast(rho))
    return grid.select("nu", "rho", (F.round(copula.t_tail_dependence("rho", F.col("nu").cast("double")), 9) + F.lit(0.0)).alias("lambda"))


@query(
    "empirical_tail_dependence",
    "C11",
    with_ctes(
        f"SELECT a.dim AS i, b.dim AS j, {rnd('sum(CASE WHEN a.u > 0.9 AND b.u > 0.9 THEN 1 ELSE 0 END) / sum(CASE WHEN a.u > 0.9 THEN 1 ELSE 0 END)', 9)} AS lambda_upper, "
        f"{rnd('sum(CASE WHEN a.u <= 0.1 AND b.u <= 0.1 THEN 1 ELSE 0 END) / sum(CASE WHEN a.u <= 0.1 THEN 1 ELSE 0 END)', 9)} AS lambda_lower "
        "FROM unif a JOIN unif b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY a.dim, b.dim",
        "vectors", extra=[_UNIF],
    ),
)
def empirical_tail_dependence(spark, sf):
    t = copula.empirical_tail_dependence(_unif(Fixtures(spark, sf)), "vec_id", "dim", "u", 0.9)
    return t.select("i", "j", F.round("lambda_upper", 9).alias("lambda_upper"), F.round("lambda_lower", 9).alias("lambda_lower"))


@query(
    "normal_scores",
    "C14 W11 N2",
    with_ctes(
        f"SELECT station, month, {rnd('u', 9)} AS u, {rnd(S.norm_ppf('u'), 9)} AS z FROM "
        "(SELECT station, month, (rank() OVER (PARTITION BY station ORDER BY precip) + "
        "(count(*) OVER (PARTITION BY station, precip) - 1) / 2.0) / (count(*) OVER (PARTITION BY station) + 1) AS u "
        "FROM precip_month)",
        "precip_month",
    ),
)
def normal_scores(spark, sf):
    # the window is one station's months: bounded by the record length
    u = windows.average_rank_uniform(Fixtures(spark, sf).precip_month(), ["station"], "precip", "u")
    return u.select("station", "month", F.round("u", 9).alias("u"), F.round(dist.norm_ppf("u"), 9).alias("z"))


# Held-out scoring: year 2001 is the test set.  A draw is as many vectors as the held-out stations,
# numbered densely, need; its entries are the shape parameters of the stations in order.
HELDOUT_YEAR = 2001


def _heldout_sql() -> str:
    xi = f"({S.shape_link_inverse('n.phi + d.x / 50.0')})"
    base = (
        f"SELECT d.draw, t.station, {S.gev_logpdf('t.precip', 't.mu', 't.sigma', xi)} AS lp, "
        f"{S.gev_cdf('t.precip', 't.mu', 't.sigma', xi)} AS u "
        f"FROM test t JOIN params n ON n.station = t.station JOIN draws d ON d.pos = t.pos"
    )
    cop = (
        f"SELECT draw, {_AR1_SQL} AS lc "
        "FROM (SELECT draw, z, lead(z) OVER (PARTITION BY draw ORDER BY station) AS nz FROM "
        f"(SELECT draw, station, {S.norm_ppf('u')} AS z FROM sc)) GROUP BY draw"
    )
    per_draw = (
        "SELECT 'iid' AS model, draw, sum(lp) AS ll FROM sc GROUP BY draw "
        "UNION ALL SELECT 'ar1' AS model, s.draw, s.ll + c.lc FROM "
        "(SELECT draw, sum(lp) AS ll FROM sc GROUP BY draw) s JOIN cop c ON c.draw = s.draw"
    )
    draws = (
        ("blocks", f"SELECT CAST(ceil(count(*) / {EMBEDDING_SIZE}.0) AS BIGINT) AS b FROM test"),
        ("slots", "SELECT vec_id, b, unnest(range(r, CAST(ceil(n / CAST(b AS DOUBLE)) AS BIGINT) * b, n)) AS slot FROM blocks, "
                  "(SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT vec_id FROM vectors))"),
        ("draws", f"SELECT slot // b AS draw, (slot % b) * {EMBEDDING_SIZE} + dim - 1 AS pos, x FROM slots JOIN vectors USING (vec_id)"),
    )
    body = (
        f"SELECT model, {rnd('lpd', 6)} AS lpd, {rnd('lpd - max(CASE WHEN model = ' + repr('iid') + ' THEN lpd END) OVER ()', 6)} AS lpd_diff "
        "FROM (SELECT model, max(m) + ln(avg(exp(ll - m))) AS lpd FROM "
        "(SELECT model, ll, max(ll) OVER (PARTITION BY model) AS m FROM pd) GROUP BY model)"
    )
    return with_ctes(
        body, "params", "precip", "vectors",
        extra=[_NAT, _SCORED,
               ("test", "SELECT station, precip, mu, sigma, row_number() OVER (ORDER BY station) - 1 AS pos "
                        f"FROM scored WHERE year = {HELDOUT_YEAR}"),
               *draws, ("sc", base), ("cop", cop), ("pd", per_draw)],
    )


@query("heldout_lpd", "C15 J13 X6 C3", _heldout_sql())
def heldout_lpd(spark, sf):
    """Log predictive density of the held-out year over every station, with independent and AR(1)-dependent
    stations, and the difference from the independent one."""
    test, vectors = _heldout_test(spark, sf)
    return _heldout_scores(test, station_draws(vectors, test))


def _heldout_test(spark, sf):
    """The held-out rows, their stations numbered 0, 1, ... in ``pos``, and the vectors."""
    fx = Fixtures(spark, sf)
    test = (
        _scored(fx).filter(F.col("year") == HELDOUT_YEAR).select("station", "precip", "mu", "sigma")
        .join(fx.params().select("station", "phi"), "station")
    )
    numbered = windows.dense_row_number(test, [], "station", "_r").withColumn("pos", F.col("_r") - 1).drop("_r")
    return materialize(numbered, "heldout-test"), fx.vectors()


def _heldout_scores(test, draws):
    """``draws`` are (draw, pos, x): the shape parameter of a draw for the station of that number."""
    j = draws.join(test, "pos")
    # xi as a column: it is referenced in every branch of the GEV formulas
    j = j.withColumn("xi", dist.shape_link_inverse(F.col("phi") + F.col("x") / 50.0)).select(
        "draw", "pos", F.floor(F.col("pos") / EMBEDDING_SIZE).alias("block"),
        dist.gev_logpdf("precip", "mu", "sigma", "xi").alias("lp"), dist.gev_cdf("precip", "mu", "sigma", "xi").alias("u"),
    )
    # successor in station order: inside a block of 64 stations by a window, over its border by a join with the blocks' firsts
    firsts = j.filter(F.col("pos") % EMBEDDING_SIZE == 0).select("draw", (F.col("block") - 1).alias("block"), F.col("u").alias("_first"))
    last = F.col("pos") % EMBEDDING_SIZE == EMBEDDING_SIZE - 1
    paired = j.withColumn("u_n", F.lead("u").over(Window.partitionBy("draw", "block").orderBy("pos")))
    paired = paired.join(firsts, ["draw", "block"], "left").withColumn("u_n", F.when(last, F.col("_first")).otherwise(F.col("u_n")))
    both = copula.ar1_copula_logc_paired(paired, ["draw"], "u", "u_n", AR1_RHO, extra=[F.sum("lp").alias("ll")])
    per_draw = both.select("draw", F.explode(F.array(
        F.struct(F.lit("iid").alias("model"), F.col("ll")),
        F.struct(F.lit("ar1").alias("model"), (F.col("ll") + F.col("log_c")).alias("ll")),
    )).alias("_s")).select("_s.model", "_s.ll")
    out = copula.log_mean_exp(per_draw, ["model"], "ll", "lpd")
    iid = out.filter("model = 'iid'").select(F.col("lpd").alias("_iid"))
    return out.crossJoin(F.broadcast(iid)).select(
        "model", F.round("lpd", 6).alias("lpd"), F.round(F.col("lpd") - F.col("_iid"), 6).alias("lpd_diff")
    )


def station_draws(vectors, stations):
    """Draws that have a shape parameter for every one of ``stations``: (draw, pos, x) by draw and station number.

    A draw is as many consecutive vectors as the stations need, in blocks of 64; every
    vector is used, and the last draw is filled up from the first vectors again.  The work is that of
    reading the vectors: each stands in one draw, but for the fill.
    """
    ids = windows.dense_row_number(vectors.select("vec_id").distinct(), [], "vec_id", "_r")
    size = ids.agg(F.count(F.lit(1)).alias("_n")).crossJoin(
        stations.agg(F.ceil(F.count(F.lit(1)) / EMBEDDING_SIZE).alias("_b"))
    )
    slots = ids.crossJoin(F.broadcast(size)).select(
        "vec_id", "_b", F.explode(F.sequence(F.col("_r").cast("long") - 1, F.ceil(F.col("_n") / F.col("_b")) * F.col("_b") - 1, F.col("_n"))).alias("_slot")
    )
    at = (F.pmod("_slot", "_b") * EMBEDDING_SIZE + F.col("dim") - 1).alias("pos")
    return vectors.join(slots, "vec_id").select(F.floor(F.col("_slot") / F.col("_b")).alias("draw"), at, "x")


@query(
    "posterior_predictive_bins",
    "C16 A13",
    with_ctes(
        "SELECT source, CAST(floor(v / 10000.0) AS INTEGER) AS bin, count(*) AS n FROM ("
        "SELECT 'y' AS source, precip AS v FROM qq UNION ALL "
        f"SELECT 'yrep' AS source, {S.gev_quantile('q', 'mu', 'sigma', 'xi')} AS v FROM qqx) GROUP BY 1, 2",
        "params", "precip",
        extra=[_NAT, _SCORED, _SCORED_P, _QQ,
               ("qqx", "SELECT s.mu, s.sigma, s.xi, q.q FROM qq q JOIN scored s ON s.station = q.station AND s.year = q.year")],
    ),
)
def posterior_predictive_bins(spark, sf):
    """Observed maxima vs model quantiles at the empirical probabilities, on common bins."""
    s = _scored(Fixtures(spark, sf))
    qq = gev.qq_table(s).select("station", "year", "precip", "q")
    rep = qq.join(s.select("station", "year", "mu", "sigma", "xi"), ["station", "year"])
    both = qq.select(F.lit("y").alias("source"), F.col("precip").alias("v")).unionByName(
        rep.select(F.lit("yrep").alias("source"), dist.gev_quantile(F.col("q"), "mu", "sigma", "xi").alias("v"))
    )
    return profile.fixed_histogram(both, "v", 0.0, 10000.0, ["source"])
