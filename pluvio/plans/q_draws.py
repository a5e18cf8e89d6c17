"""Posterior-draw tables, profiles, winsorising and the income report (D, A, W, I1 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvio.functions import dist
from pluvio.functions import sqltext as S
from pluvio.operators import draws as D
from pluvio.operators import profile, regress, report, shape
from pluvio.plans.fixtures import Fixtures, margin_pairs
from pluvio.plans.oracle_fixtures import rnd, with_ctes
from pluvio.plans.registry import query
from pluvio.plans.q_spatial import _PAIRS, _VALS, _pairs

KEEP_NAMES = ["click", "view", "error"]


@query(
    "parameter_means",
    "D1 P9 A5 F2 F4",
    with_ctes(
        f"SELECT name AS variable, chain AS station, {rnd('avg(value)', 9)} AS mean FROM draws "
        f"WHERE name IN ({', '.join(repr(n) for n in KEEP_NAMES)}) GROUP BY name, chain",
        "draws",
    ),
)
def parameter_means(spark, sf):
    d = Fixtures(spark, sf).draws()
    labelled = d.withColumn("name", F.concat("name", F.lit("["), F.col("chain").cast("string"), F.lit("]")))
    keep = labelled.select("name").distinct().filter(F.regexp_extract("name", r"^([^\[]+)", 1).isin(KEEP_NAMES))
    m = D.parameter_means(labelled, keep)
    return m.select("variable", "station", F.round("mean", 9).alias("mean"))


def _hyper_sql() -> str:
    return (
        "SELECT chain, iteration, max(CASE WHEN name = 'view' THEN value END) AS view, "
        "max(CASE WHEN name = 'click' THEN value END) AS click, "
        "max(CASE WHEN name = 'purchase' THEN value END) AS purchase FROM draws GROUP BY chain, iteration"
    )


@query(
    "hyper_draws_wide",
    "D2 R1 F10",
    with_ctes(
        "SELECT chain, iteration, "
        + ", ".join(f"{rnd(S.inv_logit(f'({n} - 25.0) / 10.0'), 9)} AS {n}" for n in ["view", "click", "purchase"])
        + " FROM hyper",
        "draws", extra=[("hyper", _hyper_sql())],
    ),
)
def hyper_draws_wide(spark, sf):
    wide = shape.pivot_wider(Fixtures(spark, sf).draws(), ["chain", "iteration"], "name", "value",
                             ["view", "click", "purchase"])
    return wide.select(
        "chain", "iteration",
        *[F.round(dist.inv_logit((F.col(n) - 25.0) / 10.0), 9).alias(n) for n in ["view", "click", "purchase"]],
    )


@query(
    "summarise_draws",
    "D3 A5",
    with_ctes(
        f"SELECT s.name, {rnd('mean', 9)} AS mean, {rnd('median', 9)} AS median, {rnd('sd', 9)} AS sd, "
        f"{rnd('mad', 9)} AS mad, {rnd('q5', 9)} AS q5, {rnd('q95', 9)} AS q95 FROM "
        "(SELECT name, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS sd, "
        "quantile_cont(value, 0.05) AS q5, quantile_cont(value, 0.95) AS q95 FROM draws GROUP BY name) s JOIN "
        f"(SELECT d.name, median(abs(d.value - m.med)) * {D.MAD_SCALE!r} AS mad FROM draws d JOIN "
        "(SELECT name, median(value) AS med FROM draws GROUP BY name) m ON m.name = d.name GROUP BY d.name) a "
        "ON a.name = s.name",
        "draws",
    ),
)
def summarise_draws(spark, sf):
    s = D.summarise_draws(Fixtures(spark, sf).draw_values())
    return s.select("name", *[F.round(c, 9).alias(c) for c in ["mean", "median", "sd", "mad", "q5", "q95"]])


def _rhat_sql() -> str:
    def ranknorm(col: str, alias: str) -> str:
        p = (
            f"((rank() OVER (PARTITION BY name ORDER BY {col}) + (count(*) OVER (PARTITION BY name, {col}) - 1) / 2.0 "
            f"- 0.375) / (count(*) OVER (PARTITION BY name) + 0.25))"
        )
        return f"{p} AS {alias}"

    def rh(w: str, b: str) -> str:
        return f"sqrt(((n - 1.0) / n * {w} + {b}) / {w})"

    def between(m: str) -> str:
        return f"sum(c.h * pow({m} - t.g{m}, 2)) / ((count(*) - 1) * avg(c.h))"

    return with_ctes(
        f"SELECT name, {rnd(rh('wb', 'bb'), 9)} AS rhat_bulk, {rnd(rh('wt', 'bt'), 9)} AS rhat_tail, "
        f"{rnd('greatest(' + rh('wb', 'bb') + ', ' + rh('wt', 'bt') + ')', 9)} AS rhat FROM g",
        "draws",
        extra=[
            ("sp", "SELECT name, chain, value, CASE WHEN iteration <= n // 2 THEN 1 WHEN iteration > n - n // 2 THEN 2 END AS half "
                   "FROM (SELECT *, count(*) OVER (PARTITION BY name, chain) AS n FROM draws)"),
            ("sp2", "SELECT name, chain * 2 + half - 1 AS split, value FROM sp WHERE half IS NOT NULL"),
            ("med", "SELECT name, median(value) AS med FROM sp2 GROUP BY name"),
            ("f", "SELECT s.*, abs(s.value - m.med) AS fold FROM sp2 s JOIN med m ON m.name = s.name"),
            ("pr", f"SELECT name, split, {ranknorm('value', 'pb')}, {ranknorm('fold', 'pt')} FROM f"),
            ("r", f"SELECT name, split, {S.norm_ppf('pb')} AS zb, {S.norm_ppf('pt')} AS zt FROM pr"),
            ("ch", "SELECT name, split, avg(zb) AS mb, var_samp(zb) AS vb, avg(zt) AS mt, var_samp(zt) AS vt, count(*) AS h "
                   "FROM r GROUP BY name, split"),
            ("gm", "SELECT name, sum(h * mb) / sum(h) AS gmb, sum(h * mt) / sum(h) AS gmt FROM ch GROUP BY name"),
            ("g", f"SELECT c.name, sum((h - 1) * vb) / sum(h - 1) AS wb, {between('mb')} AS bb, sum((h - 1) * vt) / sum(h - 1) AS wt, "
                  f"{between('mt')} AS bt, avg(h) AS n FROM ch c JOIN gm t ON t.name = c.name GROUP BY c.name"),
        ],
    )


@query("rhat", "D4 W11 N2", _rhat_sql())
def rhat(spark, sf):
    r = D.rhat(Fixtures(spark, sf).draws())
    return r.select("name", *[F.round(c, 9).alias(c) for c in ["rhat_bulk", "rhat_tail", "rhat"]])


def _ess_sql() -> str:
    """Lag self-joins of the split chains over every lag, then Geyer's pair sums."""
    pr = (
        "(rank() OVER (PARTITION BY name ORDER BY value) + (count(*) OVER (PARTITION BY name, value) - 1) / 2.0 - 0.375) "
        "/ (count(*) OVER (PARTITION BY name) + 0.25)"
    )
    between = "sum(n * pow(m - g, 2)) / nullif((count(*) - 1) * avg(n), 0)"
    return with_ctes(
        f"SELECT name, {rnd('max(CASE WHEN col = 1 THEN ess END)', 6)} AS ess_bulk, "
        f"{rnd('least(max(CASE WHEN col = 2 THEN ess END), max(CASE WHEN col = 3 THEN ess END))', 6)} AS ess_tail "
        "FROM (SELECT t.name, t.col, s / greatest(tau, 1 / log10(s)) AS ess FROM tau t) GROUP BY name",
        "draws",
        extra=[
            ("cnt", "SELECT *, count(*) OVER (PARTITION BY name, chain) AS n FROM draws"),
            ("sp", "SELECT name, chain * 2 + CASE WHEN iteration <= n // 2 THEN 0 ELSE 1 END AS split, value, "
                   "CASE WHEN iteration <= n // 2 THEN iteration ELSE iteration - (n - n // 2) END AS t "
                   "FROM cnt WHERE iteration <= n // 2 OR iteration > n - n // 2"),
            ("qs", "SELECT name, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95 FROM sp GROUP BY name"),
            ("pr", f"SELECT name, split, t, value, {pr} AS p FROM sp"),
            ("x", f"SELECT name, split, t, 1 AS col, {S.norm_ppf('p')} AS x FROM pr UNION ALL "
                  "SELECT name, split, t, 2, CAST(value <= q05 AS DOUBLE) FROM sp JOIN qs USING (name) UNION ALL "
                  "SELECT name, split, t, 3, CAST(value <= q95 AS DOUBLE) FROM sp JOIN qs USING (name)"),
            ("m", "SELECT name, col, split, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL"),
            ("c", "SELECT x.name, x.col, x.split, x.t, x.x - m.m AS xc FROM x JOIN m USING (name, col, split)"),
            ("lagged", "SELECT a.name, a.col, b.t - a.t AS lag, sum(a.xc * b.xc) AS p FROM c a JOIN c b "
                       "ON a.name = b.name AND a.col = b.col AND a.split = b.split AND b.t >= a.t GROUP BY ALL"),
            ("gm", "SELECT *, sum(n * m) OVER w / sum(n) OVER w AS g FROM m WINDOW w AS (PARTITION BY name, col)"),
            ("mom", f"SELECT name, col, sum(n) AS s, avg(n) AS nn, sum(n - 1) AS free, {between} AS b FROM gm GROUP BY ALL"),
            ("per", "SELECT mom.*, p / free AS w, (nn - 1) / nn * (p / free) + coalesce(b, 0) AS vp "
                    "FROM mom JOIN lagged l USING (name, col) WHERE l.lag = 0"),
            ("rho", "SELECT name, col, lag, CASE WHEN lag = 0 THEN 1.0::DOUBLE ELSE 1 - (w - p / s) / vp END AS r "
                    "FROM lagged JOIN per USING (name, col) WHERE vp > 0"),
            ("pair", "SELECT name, col, lag // 2 AS tp, sum(r) AS ps FROM rho GROUP BY ALL HAVING count(*) = 2"),
            ("stop", "SELECT name, col, min(tp) AS stop FROM pair WHERE ps < 0 GROUP BY ALL"),
            ("mono", "SELECT pair.name, pair.col, min(ps) OVER (PARTITION BY pair.name, pair.col ORDER BY tp) AS pm "
                     "FROM pair LEFT JOIN stop USING (name, col) WHERE stop IS NULL OR tp < stop"),
            ("tau", "SELECT mono.name, mono.col, max(per.s) AS s, -1 + 2 * sum(pm) AS tau FROM mono JOIN per USING (name, col) GROUP BY ALL"),
        ],
    )


@query("ess", "D4 D5 X1", _ess_sql())
def ess(spark, sf):
    e = D.ess(Fixtures(spark, sf).draws())
    return e.select("name", F.round("ess_bulk", 6).alias("ess_bulk"), F.round("ess_tail", 6).alias("ess_tail"))


MAX_LAG = 10


@query(
    "autocorrelation",
    "D5",
    with_ctes(
        f"SELECT a.chain, a.name, CAST(l.lag AS INTEGER) AS lag, {rnd('sum(a.xc * b.xc) / max(d.den)', 9)} AS acf "
        f"FROM c a CROSS JOIN range(0, {MAX_LAG + 1}) AS l(lag) JOIN c b ON b.chain = a.chain AND b.name = a.name "
        "AND b.iteration = a.iteration + l.lag JOIN den d ON d.chain = a.chain AND d.name = a.name "
        "GROUP BY a.chain, a.name, l.lag",
        "draws",
        extra=[("c", "SELECT chain, name, iteration, value - avg(value) OVER (PARTITION BY chain, name) AS xc FROM draws"),
               ("den", "SELECT chain, name, sum(xc * xc) AS den FROM c GROUP BY chain, name")],
    ),
)
def autocorrelation(spark, sf):
    a = D.autocorrelation(Fixtures(spark, sf).draws(), MAX_LAG)
    return a.select("chain", "name", "lag", F.round("acf", 9).alias("acf"))


ACCEPT_HALF_WIDTH = 25


@query(
    "acceptance",
    "D7 W4 W5 D6",
    with_ctes(
        f"SELECT chain, name, iteration, accept, {rnd(f'avg(accept) OVER (PARTITION BY chain, name ORDER BY iteration ROWS BETWEEN {ACCEPT_HALF_WIDTH} PRECEDING AND {ACCEPT_HALF_WIDTH} FOLLOWING)', 9)} AS accept_smooth "
        "FROM (SELECT chain, name, iteration, CASE WHEN lag(value) OVER w IS NULL THEN NULL "
        "WHEN value <> lag(value) OVER w THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accept FROM draws WHERE name = 'view' "
        "WINDOW w AS (PARTITION BY chain, name ORDER BY iteration))",
        "draws",
    ),
)
def acceptance(spark, sf):
    d = Fixtures(spark, sf).draws().filter(F.col("name") == "view")
    a = D.acceptance(d, ACCEPT_HALF_WIDTH)
    return a.select("chain", "name", "iteration", "accept", F.round("accept_smooth", 9).alias("accept_smooth"))


@query(
    "transformed_histogram",
    "D8 A13",
    with_ctes(
        f"SELECT chain, bin, {rnd('lo + bin * (hi - lo) / 10', 9)} AS bin_start, n, {rnd('n / (nn * (hi - lo) / 10)', 9)} AS density FROM "
        "(SELECT t.chain, CAST(CASE WHEN (r.hi - r.lo) / 10 > 0 THEN least(floor((t.x - r.lo) / ((r.hi - r.lo) / 10)), 9) ELSE 0 END AS INTEGER) AS bin, "
        "count(*) AS n, max(r.lo) AS lo, max(r.hi) AS hi, max(r.nn) AS nn FROM t JOIN "
        "(SELECT chain, min(x) AS lo, max(x) AS hi, count(*) AS nn FROM t GROUP BY chain) r ON r.chain = t.chain GROUP BY 1, 2)",
        "draws", extra=[("t", "SELECT chain, exp(-value / 20.0) AS x FROM draws")],
    ),
)
def transformed_histogram(spark, sf):
    d = Fixtures(spark, sf).draw_values().select("chain", F.exp(-F.col("value") / 20.0).alias("x"))
    h = profile.histogram(d, "x", 10, ["chain"])
    return h.select("chain", "bin", F.round("bin_start", 9).alias("bin_start"), "n", F.round("density", 9).alias("density"))


BYM2_SCALING = 0.5


_BYM2_HYPER = (
    "SELECT o_orderkey % 4 + 1 AS chain, o_orderkey // 4 AS iteration, o_totalprice / 100000.0 AS mu, "
    f"ln(1.0 + o_totalprice) / 10.0 AS sigma, {S.inv_logit('(o_custkey % 41 - 20) / 10.0')} AS rho FROM orders"
)
_BYM2_STATION = (
    "SELECT l_orderkey % 4 + 1 AS chain, l_orderkey // 4 AS iteration, l_suppkey AS station, "
    "avg((l_quantity - 25.5) / 14.4) AS spatial, avg((l_discount - 0.05) / 0.03) AS random FROM lineitem GROUP BY 1, 2, 3"
)


@query(
    "bym2_combine",
    "D9 J1",
    with_ctes(
        f"SELECT s.chain, s.iteration, s.station, {rnd(f'h.mu + h.sigma * (sqrt(h.rho / {BYM2_SCALING!r}) * s.spatial + sqrt(1.0 - h.rho) * s.random)', 9)} AS value "
        "FROM sd s JOIN h ON h.chain = s.chain AND h.iteration = s.iteration",
        extra=[("h", _BYM2_HYPER), ("sd", _BYM2_STATION)],
    ),
)
def bym2_combine(spark, sf):
    """Every order is a draw of the hyper-parameters, its lines are the station effects of that draw."""
    fx = Fixtures(spark, sf)

    def draw(key: str):
        return [(F.col(key) % 4 + 1).alias("chain"), F.floor(F.col(key) / 4).alias("iteration")]

    hyper = fx.table("orders").select(
        *draw("o_orderkey"), (F.col("o_totalprice") / 100000.0).alias("mu"), (F.log(1.0 + F.col("o_totalprice")) / 10.0).alias("sigma"),
        dist.inv_logit((F.col("o_custkey") % 41 - 20) / 10.0).alias("rho"),
    )
    sd = fx.table("lineitem").groupBy(*draw("l_orderkey"), F.col("l_suppkey").alias("station")).agg(
        F.avg((F.col("l_quantity") - 25.5) / 14.4).alias("spatial"), F.avg((F.col("l_discount") - 0.05) / 0.03).alias("random")
    )
    b = D.bym2_combine(hyper, sd, BYM2_SCALING)
    return b.select("chain", "iteration", "station", F.round("value", 9).alias("value"))


# ---------------------------------------------------------------------------
# ML vs "posterior mean" comparison (the monthly-maxima parameters stand in
# for the sampler's means)
# ---------------------------------------------------------------------------

_MCMC_SQL = (
    "SELECT station, ln(avg(precip)) AS psi, ln(stddev_samp(precip) / avg(precip)) AS tau, "
    "CAST(station % 5 - 2 AS DOUBLE) * 0.01 AS phi, CAST(station % 7 - 3 AS DOUBLE) * 0.00025 AS gamma "
    "FROM precip_month GROUP BY station"
)


def _mcmc_params(fx: Fixtures):
    s = F.col("station")
    return fx.precip_month().groupBy("station").agg(F.avg("precip").alias("_m"), F.stddev_samp("precip").alias("_s")).select(
        "station", F.log("_m").alias("psi"), F.log(F.col("_s") / F.col("_m")).alias("tau"),
        ((s % 5 - 2) * 0.01).alias("phi"), ((s % 7 - 3) * 0.00025).alias("gamma"),
    )


def _nat_sql(src: str) -> str:
    return (
        f"SELECT station, exp(psi) AS mu0, exp(psi + tau) AS sigma, {S.shape_link_inverse('phi')} AS xi, "
        f"{S.trend_link_inverse('gamma')} AS delta FROM {src}"
    )


def _long_sql(src: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT station, '{c}' AS variable, {c} AS value FROM {src}" for c in cols)


_TR = ["psi", "tau", "phi", "gamma"]
_NT = ["mu0", "sigma", "xi", "delta"]


def _cmp_round(col: str) -> str:
    return f"CASE WHEN variable IN ('mu0', 'sigma') THEN {rnd(col, 3)} ELSE {rnd(col, 9)} END"


@query(
    "ml_vs_mcmc",
    "D10 R2 R3",
    with_ctes(
        f"SELECT a.station, a.scale, a.variable, {_cmp_round('a.value').replace('variable', 'a.variable')} AS ml_estimate, "
        f"{_cmp_round('b.value').replace('variable', 'a.variable')} AS mcmc_mean FROM lml a JOIN lmc b "
        "ON a.station = b.station AND a.variable = b.variable",
        "params", "precip_month",
        extra=[("mc", _MCMC_SQL), ("nml", _nat_sql("params")), ("nmc", _nat_sql("mc")),
               ("lml", f"SELECT *, 'transformed' AS scale FROM ({_long_sql('params', _TR)}) UNION ALL "
                       f"SELECT *, 'natural' AS scale FROM ({_long_sql('nml', _NT)})"),
               ("lmc", f"SELECT *, 'transformed' AS scale FROM ({_long_sql('mc', _TR)}) UNION ALL "
                       f"SELECT *, 'natural' AS scale FROM ({_long_sql('nmc', _NT)})")],
    ),
)
def ml_vs_mcmc(spark, sf):
    fx = Fixtures(spark, sf)

    def both_scales(p, label):
        tr = shape.pivot_longer(p, ["station"], _TR, "variable", "value").withColumn("scale", F.lit("transformed"))
        wide = shape.pivot_wider(tr, ["station"], "variable", "value", _TR)
        nat = wide.select(
            "station", dist.location_from_psi("psi").alias("mu0"), dist.scale_from_psi_tau("psi", "tau").alias("sigma"),
            dist.shape_link_inverse("phi").alias("xi"), dist.trend_link_inverse("gamma").alias("delta"),
        )
        nl = shape.pivot_longer(nat, ["station"], _NT, "variable", "value").withColumn("scale", F.lit("natural"))
        return tr.unionByName(nl).withColumnRenamed("value", label)

    j = both_scales(fx.params(), "ml_estimate").join(both_scales(_mcmc_params(fx), "mcmc_mean"), ["station", "variable", "scale"])
    big = F.col("variable").isin("mu0", "sigma")

    def r(c):
        return F.when(big, F.round(c, 3)).otherwise(F.round(c, 9) + F.lit(0.0)).alias(c)

    return j.select("station", "scale", "variable", r("ml_estimate"), r("mcmc_mean"))


@query(
    "zscore_winsorise",
    "W8 P19",
    with_ctes(
        f"SELECT station, name, {rnd('CASE WHEN name = ' + repr('Posterior Mean') + ' THEN z WHEN z < lo THEN lo WHEN z > hi THEN hi ELSE z END', 9)} AS value "
        "FROM (SELECT station, name, (value - avg(value) OVER (PARTITION BY name)) / stddev_samp(value) OVER (PARTITION BY name) AS z "
        "FROM lng) CROSS JOIN (SELECT quantile_cont(z, 0.0025) AS lo, quantile_cont(z, 0.9975) AS hi FROM "
        "(SELECT (value - avg(value) OVER (PARTITION BY name)) / stddev_samp(value) OVER (PARTITION BY name) AS z FROM lng))",
        "params", "precip_month",
        extra=[("mc", _MCMC_SQL),
               ("lng", "SELECT station, 'Maximum Likelihood' AS name, psi AS value FROM params UNION ALL "
                       "SELECT station, 'Posterior Mean' AS name, psi AS value FROM mc")],
    ),
)
def zscore_winsorise(spark, sf):
    fx = Fixtures(spark, sf)
    a = fx.params().select("station", F.col("psi").alias("ml_estimate"))
    b = _mcmc_params(fx).select("station", F.col("psi").alias("mcmc_mean"))
    lng = shape.pivot_longer(a.join(b, "station"), ["station"], ["ml_estimate", "mcmc_mean"], "name", "value")
    from pluvio.functions import text

    lng = lng.withColumn("name", text.recode("name", {"ml_estimate": "Maximum Likelihood", "mcmc_mean": "Posterior Mean"}))
    w = profile.zscore_then_pooled_winsorise(lng, "value", "name", "Posterior Mean", 0.0025, 0.9975)
    return w.select("station", "name", F.round("value", 9).alias("value"))


@query(
    "prior_curves",
    "D11 J8",
    with_ctes(
        f"SELECT g.x, c.rate, {rnd(S.exp_pdf('g.x', 'c.rate'), 9)} AS density FROM "
        "(SELECT DISTINCT abs(phi) * 50.0 AS x FROM params) g CROSS JOIN "
        "(SELECT CAST(rate AS DOUBLE) AS rate FROM (VALUES (0.5), (1.0), (2.0)) t(rate)) c",
        "params",
    ),
)
def prior_curves(spark, sf):
    grid = Fixtures(spark, sf).params().select((F.abs("phi") * 50.0).alias("x"))
    curves = spark.createDataFrame([(0.5,), (1.0,), (2.0,)], "rate double")
    c = D.curves_on_grid(grid, curves, lambda g: dist.exp_pdf(F.col("x"), F.col("rate")))
    return c.select("x", "rate", F.round("density", 9).alias("density"))


# ---------------------------------------------------------------------------
# Profiles
# ---------------------------------------------------------------------------


@query(
    "mean_sd_by_year",
    "A4 A6",
    with_ctes(
        f"SELECT year, {rnd('avg(precip)', 6)} AS mean, {rnd('stddev_samp(precip)', 6)} AS sd, "
        f"{rnd('avg(CASE WHEN NOT isnan(v) THEN v END)', 6)} AS mean_na_rm FROM "
        "(SELECT year, precip, CASE WHEN station % 7 = 0 THEN sqrt(-1.0) ELSE precip END AS v FROM precip) GROUP BY year",
        "precip",
    ),
)
def mean_sd_by_year(spark, sf):
    p = Fixtures(spark, sf).precip()
    p = p.withColumn("v", F.when(F.col("station") % 7 == 0, F.sqrt(F.lit(-1.0))).otherwise(F.col("precip")))
    m = profile.mean_sd(p, ["year"], "precip").join(profile.mean_na_rm(p, ["year"], "v", "mean_na_rm"), "year")
    return m.select("year", *[F.round(c, 6).alias(c) for c in ["mean", "sd", "mean_na_rm"]])


@query(
    "limits_and_bbox",
    "A8 A9",
    with_ctes(
        f"SELECT {rnd('greatest(abs(max(psi - m)), abs(min(psi - m)))', 9)} AS limit, "
        "min(s.proj_x) AS xmin, max(s.proj_x) AS xmax, min(s.proj_y) AS ymin, max(s.proj_y) AS ymax "
        "FROM params p JOIN stations s ON s.station = p.station CROSS JOIN (SELECT avg(psi) AS m FROM params)",
        "params", "stations",
    ),
)
def limits_and_bbox(spark, sf):
    fx = Fixtures(spark, sf)
    p = fx.params().join(fx.stations(), "station")
    centred = shape.filter_vs_global(p, "psi", "avg", ">=").unionByName(shape.filter_vs_global(p, "psi", "avg", "<"))
    m = p.agg(F.avg("psi").alias("_m"))
    c = centred.crossJoin(F.broadcast(m)).withColumn("d", F.col("psi") - F.col("_m"))
    lim = profile.symmetric_limit(c, "d").select(F.round("limit", 9).alias("limit"))
    return lim.crossJoin(profile.bounding_box(c, "proj_x", "proj_y"))


@query(
    "raster_cells",
    "A15 R2",
    with_ctes(
        "SELECT s.proj_x, s.proj_y, 'max' AS facet, e.mx AS value FROM stations s JOIN "
        "(SELECT station, max(precip) AS mx, min(precip) AS mn FROM precip GROUP BY station) e ON e.station = s.station "
        "UNION ALL SELECT s.proj_x, s.proj_y, 'min', e.mn FROM stations s JOIN "
        "(SELECT station, max(precip) AS mx, min(precip) AS mn FROM precip GROUP BY station) e ON e.station = s.station",
        "stations", "precip",
    ),
)
def raster_cells(spark, sf):
    from pluvio.operators import blocks

    fx = Fixtures(spark, sf)
    e = blocks.station_extremes(fx.precip()).withColumnsRenamed({"max_precip": "max", "min_precip": "min"})
    long = shape.pivot_longer(e, ["station"], ["max", "min"], "facet", "value")
    return long.join(fx.stations(), "station").select("proj_x", "proj_y", "facet", "value")


@query(
    "skim_params",
    "A12",
    with_ctes(
        "SELECT variable, count(*) AS n, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
        f"{rnd('avg(value)', 9)} AS mean, {rnd('stddev_samp(value)', 9)} AS sd, count(DISTINCT value) AS n_distinct, "
        + ", ".join(f"{rnd(f'quantile_cont(value, {p})', 9)} AS p{round(p * 1000):04d}" for p in [0.0, 0.25, 0.5, 0.75, 1.0])
        + " FROM (UNPIVOT params ON psi, tau, phi, gamma INTO NAME variable VALUE value) GROUP BY variable",
        "params",
    ),
)
def skim_params(spark, sf):
    s = profile.skim(Fixtures(spark, sf).params(), ["psi", "tau", "phi", "gamma"])
    num = ["mean", "sd", "p0000", "p0250", "p0500", "p0750", "p1000"]
    return s.select("variable", "n", "n_missing", "n_distinct", *[F.round(c, 9).alias(c) for c in num])


@query(
    "histogram_by_year",
    "A13",
    with_ctes(
        f"SELECT year, bin, {rnd('lo + bin * (hi - lo) / 10', 6)} AS bin_start, n, {rnd('n / (nn * (hi - lo) / 10)', 12)} AS density FROM "
        "(SELECT t.year, CAST(CASE WHEN (r.hi - r.lo) / 10 > 0 THEN least(floor((t.precip - r.lo) / ((r.hi - r.lo) / 10)), 9) ELSE 0 END AS INTEGER) AS bin, "
        "count(*) AS n, max(r.lo) AS lo, max(r.hi) AS hi, max(r.nn) AS nn FROM precip t JOIN "
        "(SELECT year, min(precip) AS lo, max(precip) AS hi, count(*) AS nn FROM precip GROUP BY year) r ON r.year = t.year GROUP BY 1, 2)",
        "precip",
    ),
)
def histogram_by_year(spark, sf):
    h = profile.histogram(Fixtures(spark, sf).precip(), "precip", 10, ["year"])
    return h.select("year", "bin", F.round("bin_start", 6).alias("bin_start"), "n", F.round("density", 12).alias("density"))


@query(
    "binned_2d",
    "A14",
    with_ctes(
        "SELECT CAST(floor(a.u / 0.1) AS INTEGER) AS bin_x, CAST(floor(b.u / 0.1) AS INTEGER) AS bin_y, count(*) AS n "
        "FROM unif a JOIN unif b ON a.vec_id = b.vec_id AND a.dim % 2 = 1 AND b.dim = a.dim + 1 GROUP BY 1, 2",
        "vectors",
        extra=[("unif", "SELECT vec_id, dim, (rank() OVER (PARTITION BY dim ORDER BY x) + "
                        "(count(*) OVER (PARTITION BY dim, x) - 1) / 2.0) / (count(*) OVER (PARTITION BY dim) + 1) AS u FROM vectors")],
    ),
)
def binned_2d(spark, sf):
    from pluvio.operators import windows

    u = windows.global_average_rank_uniform(Fixtures(spark, sf).vectors(), ["dim"], "x", "u")
    return profile.binned_2d(margin_pairs(u), "u1", "u2", 0.1, 0.1)


@query(
    "parameter_errors",
    "A16",
    with_ctes(
        f"SELECT e.variable AS variable, {rnd('avg(e.value - t.value)', 9)} AS mean_error, {rnd('avg(abs(e.value - t.value))', 9)} AS mean_abs_error "
        f"FROM ({_long_sql('mc', _TR)}) e JOIN ({_long_sql('params', _TR)}) t ON t.station = e.station AND t.variable = e.variable "
        "GROUP BY e.variable",
        "params", "precip_month", extra=[("mc", _MCMC_SQL)],
    ),
)
def parameter_errors(spark, sf):
    fx = Fixtures(spark, sf)
    est = shape.pivot_longer(_mcmc_params(fx), ["station"], _TR, "variable", "estimate")
    truth = shape.pivot_longer(fx.params(), ["station"], _TR, "variable", "truth")
    e = profile.parameter_errors(est, truth, ["station", "variable"], ["variable"])
    return e.select("variable", F.round("mean_error", 9).alias("mean_error"), F.round("mean_abs_error", 9).alias("mean_abs_error"))


@query(
    "winsorise_statistics",
    "W7",
    with_ctes(
        f"SELECT u.station, u.type, {rnd('CASE WHEN u.statistic > q.hi THEN q.hi WHEN u.statistic < q.lo THEN q.lo ELSE u.statistic END', 9)} AS statistic "
        "FROM (SELECT station, type, estimate / std_error AS statistic FROM uni) u JOIN "
        "(SELECT type, quantile_cont(estimate / std_error, 0.005) AS lo, quantile_cont(estimate / std_error, 0.995) AS hi FROM uni GROUP BY type) q "
        "ON q.type = u.type",
        "edges", "precip_month",
        extra=[_VALS, _PAIRS,
               ("uni", "SELECT station, type, sxy / sxx AS estimate, sqrt((syy - sxy / sxx * sxy) / (n - 1) / sxx) AS std_error FROM "
                       "(SELECT station, type, count(*) AS n, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM pairs "
                       "GROUP BY station, type)")],
    ),
)
def winsorise_statistics(spark, sf):
    u = regress.univariate_ols(_pairs(Fixtures(spark, sf)), ["station", "type"]).select("station", "type", "statistic")
    w = profile.winsorise(u, "statistic", ["type"], 0.005, 0.995)
    return w.select("station", "type", F.round("statistic", 9).alias("statistic"))


# ---------------------------------------------------------------------------
# Income report
# ---------------------------------------------------------------------------

# The price index used to deflate (year, index).
CPI = [(1995, 100.0), (1996, 102.9), (1997, 105.3), (1998, 107.0), (1999, 109.3), (2000, 113.0), (2001, 116.2)]
CPI_REF_YEAR = 2001
AGE_LABELS = {"Automobile": "Car Owners", "Building": "Builders"}


def _income_sql() -> str:
    cpi = ", ".join(f"({y}, {v!r})" for y, v in CPI)
    probs = ", ".join(
        f"quantile_cont(income, {u / 100}) AS q{u}" for u in report.INCOME_UNITS
    )
    qcols = ", ".join(f"q{u}" for u in report.INCOME_UNITS)

    def src(where: str, label: str) -> str:
        return (
            f"SELECT year, age, CAST(regexp_extract(unit, '[0-9]+') AS VARCHAR) AS unit, '{label}' AS type, income FROM "
            f"(UNPIVOT (SELECT year, age, {probs} FROM inc {where} GROUP BY year, age) ON {qcols} INTO NAME unit VALUE income) "
            f"UNION ALL SELECT year, age, 'mean' AS unit, '{label}' AS type, avg(income) AS income FROM inc {where} GROUP BY year, age"
        )

    cap = "(upper(substr(age, 1, 1)) || lower(substr(age, 2)))"
    age = f"CASE {cap} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AGE_LABELS.items()) + f" ELSE {cap} END"
    return with_ctes(
        "SELECT year, " + age + " AS age, quantile, "
        "CASE WHEN type = 'total' THEN 'Total Income' ELSE 'Salary Income' END AS type, "
        f"{rnd('mean_income', 6)} AS mean_income, {rnd('group_income', 6)} AS group_income, "
        f"{rnd('group_change', 9)} AS group_change, {rnd('mean_change', 9)} AS mean_change FROM ("
        "SELECT year, age, CAST(unit AS INTEGER) AS quantile, type, mean_income, group_income, "
        "group_income / first_value(group_income) OVER (PARTITION BY age, unit, type ORDER BY year) - 1 AS group_change, "
        "mean_income / first_value(mean_income) OVER (PARTITION BY age, unit, type ORDER BY year) - 1 AS mean_change FROM ("
        "SELECT d.year, d.age, d.unit, d.type, d.income * r.cpi / c.cpi AS group_income, m.income * r.cpi / c.cpi AS mean_income "
        "FROM d JOIN d m ON m.year = d.year AND m.age = d.age AND m.type = d.type AND m.unit = 'mean' "
        f"JOIN cpi c ON c.year = d.year CROSS JOIN (SELECT cpi FROM cpi WHERE year = {CPI_REF_YEAR}) r WHERE d.unit <> 'mean')) "
        "WHERE year > (SELECT min(year) FROM d)",
        extra=[("inc", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS age, o_totalprice AS income, "
                       "o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey"),
               ("cpi", f"SELECT * FROM (VALUES {cpi}) t(year, cpi)"),
               ("d", src("", "total") + " UNION ALL " + src("WHERE status = 'F'", "salary"))],
    )


@query("income_report", "I1 U1 R9 J12 W6 P15 P18 P3", _income_sql())
def income_report(spark, sf):
    fx = Fixtures(spark, sf)
    o = fx.table("orders").select("o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    c = fx.table("customer").select("c_custkey", "c_mktsegment")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("age"),
        F.col("o_totalprice").alias("income"), F.col("o_orderstatus").alias("status"),
    )
    # both sources in one quantile pass, the source being part of the key
    sources = shape.bind_rows(
        shape.tag(rows, "type", "total"), shape.tag(rows.filter(F.col("status") == "F"), "type", "salary")
    )
    units = report.income_units(sources, ["year", "age", "type"], "income")
    cpi = spark.createDataFrame(CPI, "year int, cpi double")
    out = report.income_pipeline([units], cpi, CPI_REF_YEAR, AGE_LABELS)
    return out.select(
        "year", "age", "quantile", "type",
        *[F.round(c, 6).alias(c) for c in ["mean_income", "group_income"]],
        *[F.round(c, 9).alias(c) for c in ["group_change", "mean_change"]],
    )
