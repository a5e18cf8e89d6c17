"""Lattice matrices, spatial statistics and regressions (G, L, I2 rows)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pluvio.functions import sqltext as S
from pluvio.functions import text
from pluvio.operators import lattice, profile, regress, report, shape
from pluvio.plans.fixtures import Fixtures
from pluvio.plans.oracle_fixtures import rnd, with_ctes
from pluvio.plans.registry import query

CAR_ALPHA = 0.9


@query(
    "laplacian",
    "G3",
    with_ctes(
        "SELECT station AS i, station AS j, CAST(count(*) AS DOUBLE) AS v FROM rook_edges GROUP BY station "
        "UNION ALL SELECT station AS i, neighbor AS j, -1.0 AS v FROM rook_edges",
        "rook_edges",
    ),
)
def laplacian(spark, sf):
    return lattice.laplacian(Fixtures(spark, sf).edges(lattice.ROOK_TYPES))


@query(
    "car_precision",
    "G4",
    with_ctes(
        "SELECT station AS i, station AS j, CAST(count(*) AS DOUBLE) AS v FROM rook_edges GROUP BY station "
        f"UNION ALL SELECT station AS i, neighbor AS j, {-CAR_ALPHA!r} AS v FROM rook_edges",
        "rook_edges",
    ),
)
def car_precision(spark, sf):
    return lattice.car_precision(Fixtures(spark, sf).edges(lattice.ROOK_TYPES), CAR_ALPHA)


@query(
    "mean_degree",
    "G4 A10",
    with_ctes(
        f"SELECT {rnd('avg(coalesce(d.degree, 0))', 9)} AS mean_degree FROM stations s LEFT JOIN "
        "(SELECT station, count(*) AS degree FROM rook_edges GROUP BY station) d ON d.station = s.station",
        "stations", "rook_edges",
    ),
)
def mean_degree(spark, sf):
    fx = Fixtures(spark, sf)
    m = lattice.mean_degree(fx.edges(lattice.ROOK_TYPES), fx.stations())
    return m.select(F.round("mean_degree", 9).alias("mean_degree"))


@query(
    "kronecker_precision",
    "G5",
    with_ctes(
        "SELECT i, j, sum(v) AS v FROM (SELECT station AS i, station AS j, CAST(count(*) AS DOUBLE) AS v "
        "FROM rook_edges GROUP BY station UNION ALL SELECT station, neighbor, -1.0 FROM rook_edges) GROUP BY i, j",
        "rook_edges",
    ),
)
def kronecker_precision(spark, sf):
    """R_x (+) R_y on the lattice; the oracle is the rook Laplacian (they are equal)."""
    return lattice.kronecker_sum_precision(Fixtures(spark, sf).stations())


LATTICE_SHIFT = 0.1


@query(
    "lattice_log_det",
    "G5",
    # the pivots of the tridiagonal block that each eigenvalue of the x axis leaves on the y axis
    with_ctes(
        f"SELECT {rnd('sum(ln(r))', 6)} AS log_det FROM piv",
        "stations",
        extra=[
            ("ax", "SELECT CAST(max(proj_x) - min(proj_x) + 1 AS BIGINT) AS nx, CAST(max(proj_y) - min(proj_y) + 1 AS BIGINT) AS ny FROM stations"),
            ("lam", f"SELECT ny, 2.0 - 2.0 * cos({math.pi!r} * k / nx) + {LATTICE_SHIFT!r} AS s FROM (SELECT nx, ny, unnest(range(nx)) AS k FROM ax)"),
            ("piv", "SELECT ny, s, 1 AS step, CASE WHEN ny = 1 THEN s ELSE 1.0 + s END AS r FROM lam UNION ALL "
                    "SELECT ny, s, step + 1, CASE WHEN step + 1 = ny THEN 1.0 + s ELSE 2.0 + s END - 1.0 / r FROM piv WHERE step < ny"),
        ],
    ).replace("WITH", "WITH RECURSIVE", 1),
)
def lattice_log_det(spark, sf):
    """Log-determinant of the shifted Kronecker sum by its spectrum; the oracle eliminates along one axis."""
    d = lattice.lattice_log_det(Fixtures(spark, sf).stations(), LATTICE_SHIFT)
    return d.select(F.round("log_det", 6).alias("log_det"))


@query(
    "icar_energy",
    "G6 J11",
    with_ctes(
        f"SELECT {rnd('pw', 6)} AS pairwise, {rnd('soft', 3)} AS soft, {rnd('pw + soft', 3)} AS energy FROM "
        "(SELECT -0.5 * sum((a.psi - b.psi) * (a.psi - b.psi)) AS pw FROM rook_edges e "
        "JOIN params a ON a.station = e.station JOIN params b ON b.station = e.neighbor WHERE e.neighbor > e.station) "
        f"CROSS JOIN (SELECT -0.5 * pow(sum(psi) / (0.001 * count(*)), 2) - ln(0.001 * count(*)) - {0.5 * math.log(2 * math.pi)!r} AS soft FROM params)",
        "rook_edges", "params",
    ),
)
def icar_energy(spark, sf):
    fx = Fixtures(spark, sf)
    e = lattice.icar_energy(fx.params().select("station", "psi"), fx.edges(lattice.ROOK_TYPES), "psi")
    # the soft sum-to-zero term is of order (sum x / 0.001 N)^2: 3 decimals is
    # already ~10 significant digits
    return e.select(F.round("pairwise", 6).alias("pairwise"), F.round("soft", 3).alias("soft"),
                    F.round("energy", 3).alias("energy"))


@query(
    "neighbour_moments",
    "G7 X5",
    with_ctes(
        f"SELECT e.station, {rnd('avg(b.psi)', 9)} AS cond_mean, {rnd('1.0 / count(*)', 9)} AS cond_var FROM rook_edges e "
        "JOIN params b ON b.station = e.neighbor GROUP BY e.station",
        "rook_edges", "params",
    ),
)
def neighbour_moments(spark, sf):
    fx = Fixtures(spark, sf)
    # a column passed by name, applied with DataFrame.transform
    m = fx.params().select("station", "psi").transform(
        lattice.neighbour_moments, fx.edges(lattice.ROOK_TYPES), "psi"
    )
    return m.select("station", F.round("cond_mean", 9).alias("cond_mean"), F.round("cond_var", 9).alias("cond_var"))


# Standardised monthly maxima per station: the regressions' time series.
_VALS = (
    "vals",
    "SELECT station, month, (precip - avg(precip) OVER (PARTITION BY station)) / "
    "stddev_samp(precip) OVER (PARTITION BY station) AS v FROM precip_month",
)
_PAIRS = (
    "pairs",
    "SELECT e.station, e.neighbor, e.type, y.month, y.v AS y, x.v AS x FROM edges e "
    "JOIN vals y ON y.station = e.station JOIN vals x ON x.station = e.neighbor AND x.month = y.month",
)


def _vals(fx: Fixtures):
    pm = fx.precip_month()
    m = profile.mean_sd(pm, ["station"], "precip")
    return pm.join(m, "station").select(
        "station", "month", F.try_divide(F.col("precip") - F.col("mean"), F.col("sd")).alias("v")
    )


def _pairs(fx: Fixtures, types: list[str] | None = None):
    p = lattice.neighbour_pairs(_vals(fx), fx.edges(types), ["month"], "v")
    return p.select("station", "neighbor", "type", "month", "y", "x")


_UNI_SQL = (
    "SELECT station, type, n, est AS estimate, se AS std_error, est / se AS statistic FROM ("
    "SELECT station, type, n, sxy / sxx AS est, sqrt((syy - sxy / sxx * sxy) / (n - 1) / sxx) AS se FROM ("
    "SELECT station, type, count(*) AS n, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM pairs "
    "WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) GROUP BY station, type))"
)


@query(
    "univariate_ols",
    "L1 P12 X1",
    with_ctes(
        f"SELECT station, type, n, {rnd('estimate', 9)} AS estimate, {rnd('std_error', 9)} AS std_error, "
        f"{rnd('statistic', 9)} AS statistic, "
        f"{rnd('CASE WHEN n > 1 THEN 2.0 * (1.0 - ' + S.t_cdf_int('abs(statistic)', 'CAST(n - 1 AS INTEGER)') + ') END', 9)} AS p_value "
        "FROM uni",
        "edges", "precip_month", extra=[_VALS, _PAIRS, ("uni", _UNI_SQL)],
    ),
)
def univariate_ols(spark, sf):
    u = regress.univariate_ols(_pairs(Fixtures(spark, sf)), ["station", "type"])
    return u.select("station", "type", "n", *[F.round(c, 9).alias(c) for c in ["estimate", "std_error", "statistic", "p_value"]])


_P_SQL = "CASE WHEN n > 1 THEN 2.0 * (1.0 - " + S.t_cdf_int("abs(statistic)", "CAST(n - 1 AS INTEGER)") + ") END"


@query(
    "ols_texts",
    "F6",
    with_ctes(
        "SELECT station, type, CASE WHEN p < 0.001 THEN '< 0.001' ELSE printf('%.3f', floor(p * 1000 + 0.5) / 1000) END AS p_text, "
        "printf('%.1f', floor(r2 * 1000 + 0.5) / 10) || '%' AS r2_text FROM "
        f"(SELECT station, type, {rnd(_P_SQL, 9)} AS p, {rnd('statistic * statistic / nullif(statistic * statistic + n - 1, 0)', 9)} AS r2 FROM uni)",
        "edges", "precip_month", extra=[_VALS, _PAIRS, ("uni", _UNI_SQL)],
    ),
)
def ols_texts(spark, sf):
    """p-values and explained shares of the neighbour regressions as report text."""
    u = regress.univariate_ols(_pairs(Fixtures(spark, sf)), ["station", "type"])
    square = F.col("statistic") * F.col("statistic")
    r2 = F.round(F.try_divide(square, square + F.col("n") - 1), 9)
    p = F.round("p_value", 9)
    return u.select(
        "station", "type",
        F.when(p.isNotNull(), text.p_value_text(p)).alias("p_text"), F.when(r2.isNotNull(), text.percent_text(r2)).alias("r2_text"),
    )


def _complete_neighbours(spark, sf):
    """The rows of the neighbours present in all months of a station, and their Gram tables."""
    fx = Fixtures(spark, sf)
    # a station's months are one list: an edge carries its neighbour's list, and everything after is by station
    vals = _vals(fx).where(F.col("station").isNotNull())
    y = vals.groupBy("station").agg(F.collect_list(F.struct("month", F.col("v").alias("y"))).alias("_y"))
    entry = F.when(F.col("month").isNotNull(), F.struct("month", "v"))
    x = vals.groupBy(F.col("station").alias("neighbor")).agg(F.map_from_entries(F.collect_list(entry)).alias("_x"))
    sides = fx.edges().join(x, "neighbor", "left").join(y, "station").repartition("station")
    months = F.transform("_y", lambda e: F.struct(e["month"].alias("month"), e["y"].alias("y"), F.try_element_at("_x", e["month"]).alias("x")))
    pairs = sides.select("station", "neighbor", "type", F.inline(months))
    complete = shape.filter_finite(shape.drop_incomplete_groups(pairs, ["station", "type"], "x"), ["x", "y"])
    gram = regress.gram_by_site(complete, "station", "month", "type", "y", "x")
    return complete, gram


@query("site_regression_fits", "G8 L2 X1 P13 P14")
def site_regression_fits(spark, sf):
    """The fits that ``site_regressions`` certifies: one row per station and neighbour."""
    return regress.site_regressions(_complete_neighbours(spark, sf)[1], "station")


@query(
    "site_regressions",
    "G8 L2 X1 P13 P14",
    with_ctes(
        "SELECT station, type AS term, count(*) AS n, 0.0::DOUBLE AS normal_equation FROM (SELECT e.station, e.type, y.v AS y, x.v AS x, "
        "count(*) OVER w - count(x.v) OVER w AS gaps FROM edges e JOIN vals y ON y.station = e.station "
        "LEFT JOIN vals x ON x.station = e.neighbor AND x.month = y.month WINDOW w AS (PARTITION BY e.station, e.type)) "
        "WHERE gaps = 0 AND isfinite(x) AND isfinite(y) GROUP BY station, type",
        "edges", "precip_month", extra=[_VALS],
    ),
)
def site_regressions(spark, sf):
    """Multivariate neighbour regressions per station on the neighbours present in all its
    months; the certificate of a fit is that each neighbour's product with the residuals is zero."""
    complete, gram = _complete_neighbours(spark, sf)
    fit = regress.site_regressions(gram, "station").select("station", F.col("term").alias("type"), "n", "estimate")
    fits = fit.groupBy("station").agg(F.map_from_entries(F.collect_list(F.struct("type", F.struct("n", "estimate")))).alias("_fit"))
    cells = complete.repartition("station").groupBy("station", "month").agg(
        F.first("y").alias("y"), F.collect_list(F.struct("type", "x")).alias("_x")
    ).join(fits, "station")

    def fitted(e):
        return F.try_element_at("_fit", e["type"])

    resid = F.col("y") - F.aggregate("_x", F.lit(0.0), lambda s, e: s + fitted(e)["estimate"] * e["x"])
    terms = F.flatten(F.transform(F.array(resid), lambda r: F.transform(
        "_x", lambda e: F.struct(e["type"].alias("term"), fitted(e)["n"].alias("n"), (e["x"] * r).alias("v"))
    )))
    return cells.select("station", F.inline(terms)).groupBy("station", "term", "n").agg(
        (F.round(F.sum("v"), 6) + F.lit(0.0)).alias("normal_equation")
    )


@query(
    "precision_assembly",
    "G9",
    with_ctes(
        f"SELECT d.i, {rnd('d.q_ii', 9)} AS q_ii, {rnd('coalesce(o.off_abs, 0.0)', 9)} AS off_abs, "
        "d.q_ii > coalesce(o.off_abs, 0.0) AS dominant, "
        f"{rnd('CASE WHEN coalesce(o.off_abs, 0.0) > 0 THEN d.q_ii / o.off_abs END', 9)} AS lambda_bound "
        "FROM (SELECT i, 1.0 / tau2 AS q_ii FROM tau) d LEFT JOIN (SELECT i, sum(abs(q_sym)) AS off_abs FROM ("
        "SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, 0.5 * (coalesce(a.q, 0.0) + coalesce(b.q, 0.0)) AS q_sym "
        "FROM qb a FULL OUTER JOIN qb b ON a.i = b.j AND a.j = b.i) GROUP BY i) o ON o.i = d.i",
        "rook_edges", "precip_month",
        extra=[_VALS, ("rp", _PAIRS[1].replace("FROM edges e", "FROM rook_edges e")),
               ("beta", "SELECT station AS i, neighbor AS j, sum(x * y) / sum(x * x) AS beta FROM rp GROUP BY station, neighbor"),
               ("tau", "SELECT station AS i, sum(v * v) / count(*) AS tau2 FROM vals GROUP BY station"),
               ("qb", "SELECT b.i, b.j, -b.beta / t.tau2 AS q FROM beta b JOIN tau t ON t.i = b.i")],
    ),
)
def precision_assembly(spark, sf):
    fx = Fixtures(spark, sf)
    p = _pairs(fx, lattice.ROOK_TYPES)
    beta = p.groupBy(F.col("station").alias("i"), F.col("neighbor").alias("j")).agg(
        (F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("beta")
    )
    tau2 = _vals(fx).groupBy(F.col("station").alias("i")).agg((F.sum(F.col("v") * F.col("v")) / F.count(F.lit(1))).alias("tau2"))
    q = regress.assemble_precision(beta, tau2)
    return q.select("i", *[F.round(c, 9).alias(c) for c in ["q_ii", "off_abs"]], "dominant",
                    F.round("lambda_bound", 9).alias("lambda_bound"))


def _moran_sql() -> str:
    n = "g.n"
    body = (
        "SELECT z.station, z.x, z.z * l.lag_z / m.m2 AS local_i, -(z.z * z.z) * l.wi / ((g.n - 1) * m.m2) AS expected_i, "
        f"pow(z.z / m.m2, 2) * ({n} / ({n} - 2.0)) * (m.m2 - z.z * z.z / ({n} - 1)) * (l.w2 - l.wi * l.wi / ({n} - 1)) AS variance_i "
        "FROM zt z LEFT JOIN lag l ON l.station = z.station CROSS JOIN m2 m CROSS JOIN gstats g"
    )
    zsc = "(local_i - expected_i) / sqrt(variance_i)"
    return with_ctes(
        f"SELECT station, {rnd('x', 9)} AS x, {rnd('local_i', 9)} AS local_i, {rnd('expected_i', 9)} AS expected_i, "
        f"{rnd('variance_i', 9)} AS variance_i, {rnd(zsc, 6)} AS z_i, {rnd('1.0 - ' + S.norm_cdf(zsc), 6)} AS p_value, "
        f"({zsc} > 1.65 AND 1.0 - {S.norm_cdf(zsc)} < 0.05) AS significant FROM ({body})",
        "edges", "params",
        extra=[("qe", "SELECT * FROM edges WHERE type IN ('n', 's', 'e', 'w', 'ne', 'nw', 'se', 'sw')"),
               ("gstats", "SELECT avg(psi) AS mean, count(*) AS n FROM params"),
               ("zt", "SELECT station, psi AS x, psi - (SELECT mean FROM gstats) AS z FROM params"),
               ("m2", "SELECT sum(z * z) / count(*) AS m2 FROM zt"),
               ("w", "SELECT station, neighbor, 1.0 / count(*) OVER (PARTITION BY station) AS w FROM qe"),
               ("lag", "SELECT w.station, sum(w.w * z.z) AS lag_z, sum(w.w) AS wi, sum(w.w * w.w) AS w2 "
                       "FROM w JOIN zt z ON z.station = w.neighbor GROUP BY w.station")],
    )


@query("local_moran", "G10 W9 N1", _moran_sql())
def local_moran(spark, sf):
    fx = Fixtures(spark, sf)
    m = lattice.local_moran(fx.params().select("station", "psi"), fx.edges(lattice.QUEEN_TYPES), "psi")
    return m.select(
        "station", *[F.round(c, 9).alias(c) for c in ["x", "local_i", "expected_i", "variance_i"]],
        *[F.round(c, 6).alias(c) for c in ["z_i", "p_value"]],
        "significant",
    )


@query(
    "grid_cells",
    "G11 A9",
    with_ctes(
        "SELECT s.station, s.proj_x, s.proj_y, s.proj_x - g.dx / 2 AS xmin, s.proj_x + g.dx / 2 AS xmax, "
        "s.proj_y - g.dy / 2 AS ymin, s.proj_y + g.dy / 2 AS ymax FROM stations s CROSS JOIN "
        "(SELECT min(CASE WHEN axis = 'x' THEN gap END) AS dx, min(CASE WHEN axis = 'y' THEN gap END) AS dy FROM "
        "(SELECT axis, lead(c) OVER (PARTITION BY axis ORDER BY c) - c AS gap FROM "
        "(SELECT DISTINCT 'x' AS axis, CAST(proj_x AS DOUBLE) AS c FROM stations UNION SELECT DISTINCT 'y', "
        "CAST(proj_y AS DOUBLE) FROM stations))) g",
        "stations",
    ),
)
def grid_cells(spark, sf):
    return lattice.grid_cells(Fixtures(spark, sf).stations())


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

_OLS = (
    "ols",
    "SELECT CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN '(Intercept)' ELSE 'c_mktsegment' || c_mktsegment END AS term, "
    "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN m ELSE m - m0 END AS estimate, "
    "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN sqrt(s2 / n0) ELSE sqrt(s2 * (1.0 / n + 1.0 / n0)) END AS std_error, dfree "
    "FROM (SELECT c_mktsegment, count(*) AS n, avg(o_totalprice) AS m, sum(o_totalprice * o_totalprice) AS ss "
    "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment) g "
    "CROSS JOIN (SELECT n AS n0, m AS m0 FROM (SELECT c_mktsegment, count(*) AS n, avg(o_totalprice) AS m "
    "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment) WHERE c_mktsegment = 'AUTOMOBILE') b "
    "CROSS JOIN (SELECT sum(ss - n * m * m) / (sum(n) - 5) AS s2, CAST(sum(n) - 5 AS BIGINT) AS dfree FROM (SELECT count(*) AS n, avg(o_totalprice) AS m, "
    "sum(o_totalprice * o_totalprice) AS ss FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)) t",
)
# the t quantile of the interval, by the Cornish-Fisher expansion (error below 1e-12 from 1,000 degrees of freedom)
_OLS_T = ("olst", f"SELECT *, {S.t_ppf_expansion('CAST(0.975 AS DOUBLE)', 'dfree')} AS tq FROM ols")


def _ols(fx: Fixtures):
    o = fx.table("orders").select("o_custkey", "o_totalprice")
    c = fx.table("customer").select("c_custkey", "c_mktsegment")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    return regress.dummy_ols(rows, "o_totalprice", "c_mktsegment", SEGMENTS)


@query(
    "dummy_ols",
    "L3",
    with_ctes(
        f"SELECT term, {rnd('estimate', 6)} AS estimate, {rnd('std_error', 6)} AS std_error, "
        f"{rnd('estimate / std_error', 9)} AS statistic, {rnd('estimate - tq * std_error', 6)} AS conf_low, "
        f"{rnd('estimate + tq * std_error', 6)} AS conf_high FROM olst",
        extra=[_OLS, _OLS_T],
    ),
)
def dummy_ols(spark, sf):
    o = _ols(Fixtures(spark, sf))
    return o.select(
        "term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"),
        F.round("statistic", 9).alias("statistic"), F.round("conf_low", 6).alias("conf_low"),
        F.round("conf_high", 6).alias("conf_high"),
    )


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_LM_TERMS = ["(Intercept)", "c_acctbal", *[f"c_mktsegment{v}" for v in SEGMENTS[1:]], *[f"o_orderpriority{v}" for v in PRIORITIES[1:]]]


def _orders_model(spark, sf):
    fx = Fixtures(spark, sf)
    o = fx.table("orders").select("o_custkey", "o_totalprice", "o_orderpriority")
    c = fx.table("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    model = ("o_totalprice", ["c_acctbal"], {"c_mktsegment": SEGMENTS, "o_orderpriority": PRIORITIES})
    return rows, model


@query("linear_model_fit", "L3")
def linear_model_fit(spark, sf):
    """The fit that ``linear_model`` certifies: one row per term."""
    rows, model = _orders_model(spark, sf)
    return regress.linear_model(rows, *model)


@query(
    "linear_model",
    "L3",
    f"""
    SELECT t.term, o.n, 0.0::DOUBLE AS normal_equation FROM
      (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ({', '.join(map(repr, SEGMENTS))})
       AND o_orderpriority IN ({', '.join(map(repr, PRIORITIES))}) AND isfinite(c_acctbal) AND isfinite(o_totalprice)) o,
      (SELECT unnest([{', '.join(map(repr, _LM_TERMS))}]) AS term) t
    """,
)
def linear_model(spark, sf):
    """o_totalprice on a number and two factors; the certificate of the fit is that each design
    column's product with the residuals, over that with |y|, is zero."""
    rows, model = _orders_model(spark, sf)
    fit = regress.linear_model(rows, *model)
    terms = regress.model_terms(*model[1:])
    beta = fit.agg(F.map_from_entries(F.collect_list(F.struct("term", "estimate"))).alias("_b"))
    fitted = sum((F.col("_b")[t] * x for t, x in terms.items()), F.lit(0.0))
    r = regress.model_rows(rows, *model).crossJoin(F.broadcast(beta)).withColumn("_r", F.col("o_totalprice") - fitted)
    sums = r.agg(*[
        F.struct(F.lit(t).alias("term"), F.count(F.lit(1)).alias("n"), F.sum(x * F.col("_r")).alias("xr"), F.sum(F.abs(x * F.col("o_totalprice"))).alias("xy")).alias(f"t{i}")
        for i, (t, x) in enumerate(terms.items())
    ])
    return sums.select(F.inline(F.array(*sums.columns))).select(
        "term", "n", (F.round(F.col("xr") / F.col("xy"), 9) + F.lit(0.0)).alias("normal_equation")
    )


def _pad_sql(x: str) -> str:
    t = f"regexp_replace(regexp_replace(printf('%.2f', round({x}, 2)), '0+$', ''), '\\.$', '')"
    t2 = f"(CASE WHEN NOT contains({t}, '.') THEN {t} || '.00' ELSE {t} END)"
    return f"rpad({t2}, CAST(greatest(length({t2}), 4) AS INTEGER), '0')"


@query(
    "forest_table",
    "I2 F5 F6 F7 P19",
    with_ctes(
        "SELECT name, CAST(dense_rank() OVER (ORDER BY mean, name) AS INTEGER) AS rank_order, "
        f"{rnd('mean', 6)} AS mean, {rnd('lower', 6)} AS lower, {rnd('upper', 6)} AS upper, "
        f"{_pad_sql('mean')} AS mean_text, {_pad_sql('lower')} AS lower_text, {_pad_sql('upper')} AS upper_text, "
        "printf('%.2f [%.2f, %.2f]', round(mean, 2), round(lower, 2), round(upper, 2)) AS interval_text "
        "FROM (SELECT term AS name, estimate AS mean, estimate - tq * std_error AS lower, "
        "estimate + tq * std_error AS upper FROM olst)",
        extra=[_OLS, _OLS_T],
    ),
)
def forest_table(spark, sf):
    return report.forest_table(_ols(Fixtures(spark, sf)))


@query("penalised_sweep", "L4 X3 J8")
def penalised_sweep(spark, sf):
    """Smooth of yearly maxima against year for 15 penalties."""
    fx = Fixtures(spark, sf)
    p = fx.precip().select(F.col("year").cast("double").alias("year"), "precip")
    gammas = spark.createDataFrame([(10.0 ** (k / 2.0 - 3),) for k in range(15)], "gamma double")
    return regress.penalised_sweep(p, "year", "precip", [1995.0, 1997.0, 1999.0, 2001.0], gammas, p.select("year"))
