"""Regressions on neighbour tables and precision assembly.

Everything a fit needs is a sufficient statistic (sums of products) computed
with one distributed aggregation; the per-group solve then sees a k x k
table (k <= 12 neighbours), never the raw rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions import dist


def univariate_ols(df: DataFrame, keys: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """``lm(y ~ x - 1)`` per group, tidy: estimate, std_error, statistic, p_value (L1).

    Non-finite x or y rows are dropped first.  With Sxy, Sxx, Syy, n:
    beta = Sxy/Sxx, s^2 = (Syy - beta Sxy)/(n - 1), se = sqrt(s^2/Sxx),
    t = beta/se, p = P(|T| > |t|) with n - 1 degrees of freedom, the tail itself.
    """
    d = df.filter(dist.is_finite(y) & dist.is_finite(x))
    s = d.groupBy(*keys).agg(
        F.sum(F.col(x) * F.col(y)).alias("sxy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"),
        F.sum(F.col(y) * F.col(y)).alias("syy"),
        F.count(F.lit(1)).alias("n"),
    )
    beta = F.try_divide(F.col("sxy"), F.col("sxx"))
    s2 = F.try_divide(F.col("syy") - F.col("estimate") * F.col("sxy"), F.col("n") - 1)
    out = s.withColumn("estimate", beta).withColumn("std_error", F.sqrt(F.try_divide(s2, F.col("sxx"))))
    out = out.withColumn("statistic", F.try_divide(F.col("estimate"), F.col("std_error")))
    df_resid = F.col("n") - 1
    p = dist.t_two_sided("statistic", df_resid)
    return out.withColumn("p_value", F.when(F.col("n") > 1, p)).select(
        *keys, "n", "estimate", "std_error", "statistic", "p_value"
    )


def gram_by_site(pairs: DataFrame, site: str, t: str, type_col: str, y: str, x: str) -> DataFrame:
    """Sufficient statistics of the neighbour regressions of every site.

    ``pairs`` holds (site, t, type, y, x): one row per site, time and
    neighbour type.  Returns long rows (site, a, b, v) with v = sum_t x_a x_b
    for neighbour types a, b, plus rows (site, a, '_y', sum_t x_a y) and
    (site, '_y', '_y', sum_t y^2), and n = T per site.  Rows go to tasks by
    site once; a (site, t) cell's list holds its neighbours, and its products are
    summed by site where they are made.
    """
    entry = F.struct(F.col(type_col).alias("a"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = pairs.where(F.col(site).isNotNull()).select(site, t, type_col, y, x).repartition(site).groupBy(site, t).agg(
        F.collect_list(entry).alias("_e"), F.collect_set(F.struct((F.col(y).cast("double") + 0.0).alias("y"))).alias("_s")
    )

    def product(a, b, v):
        return F.struct(a.alias("a"), b.alias("b"), v.alias("v"))

    e, end = F.col("_e"), F.lit("_y")
    xx = F.flatten(F.transform(e, lambda l: F.transform(e, lambda r: product(l["a"], r["a"], l["x"] * r["x"]))))
    xy = F.transform(e, lambda l: product(l["a"], end, l["x"] * l["y"]))
    yy = F.transform(F.col("_s"), lambda s: product(end, end, s["y"] * s["y"]))
    # a NULL time has no partner
    xx = F.when(F.col(t).isNotNull(), xx).otherwise(F.slice(xy, 1, 0))
    sums = cells.select(site, F.inline(F.concat(xx, xy, yy))).groupBy(site, "a", "b").agg(
        F.sum("v").alias("v"), F.count(F.lit(1)).alias("_n")
    )
    n = F.max(F.when((F.col("a") == "_y") & (F.col("b") == "_y"), F.col("_n"))).over(Window.partitionBy(site))
    return sums.withColumn("n", n).select(site, "a", "b", "v", "n")


def _half_step(a: float) -> float:
    """ln(Gamma(a + 1/2) / Gamma(a)): the asymptotic series at a + 20, brought back to a."""
    s, b = 0.0, a
    while b < a + 20:
        s += math.log(b / (b + 0.5))
        b += 1
    return s + 0.5 * math.log(b) - 1 / (8 * b) + 1 / (192 * b**3) - 1 / (640 * b**5)


#: Exp-sinh quadrature of (0, inf): nodes and weights.
_V = np.arange(-390, 391) / 64
_NODES = np.exp(np.pi / 2 * np.sinh(_V))
_WEIGHTS = _NODES * np.pi / 2 * np.cosh(_V) / 64


def _t_log_constant(nu: float) -> float:
    return _half_step(nu / 2) - 0.5 * math.log(nu * math.pi)


def t_two_sided(t: float, nu: float) -> float:
    """P(|T| > |t|) of Student's t for any real nu > 0: the density integrated over the tail,
    so that small probabilities keep their digits."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else math.nan
    s = abs(t) + _NODES
    tail = np.exp(_t_log_constant(nu) - (nu + 1) / 2 * np.log1p(s * s / nu)) @ _WEIGHTS
    return min(1.0, 2 * float(tail))


def t_critical(level: float, nu: float) -> float:
    """t with P(|T| <= t) = level: Newton's method on ln P(|T| > t) over ln t, which is concave."""
    alpha, u = 1 - level, 0.0
    const = _t_log_constant(nu)
    for _ in range(100):
        t = math.exp(u)
        p = t_two_sided(t, nu)
        slope = -2 * math.exp(const - (nu + 1) / 2 * math.log1p(t * t / nu)) * t / p
        step = math.log(p / alpha) / slope
        u -= step
        if abs(step) < 1e-15:
            break
    return math.exp(u)


def site_regressions(gram: DataFrame, site: str = "station", divide_by_t: bool = True) -> DataFrame:
    """Solve each site's no-intercept regression from its Gram table.

    Output tidy rows: site, term, estimate, std_error, statistic, p_value,
    tau2 (residual variance, RSS / T as in the precision derivation, or
    RSS / (T - k) for the usual lm standard errors).  Sites whose Gram matrix
    is singular are returned with NULL estimates.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sid = pdf[site].iloc[0]
        n = int(pdf["n"].iloc[0])
        terms = sorted(set(pdf["a"]) - {"_y"})
        idx = {t: i for i, t in enumerate(terms)}
        k = len(terms)
        xtx = np.zeros((k, k))
        xty = np.zeros(k)
        yty = 0.0
        for a, b, v in zip(pdf["a"], pdf["b"], pdf["v"]):
            if a == "_y" and b == "_y":
                yty = v
            elif b == "_y":
                xty[idx[a]] = v
            else:
                xtx[idx[a], idx[b]] = v
        rows = []
        try:
            beta = np.linalg.solve(xtx, xty)
            rss = float(yty - 2 * beta @ xty + beta @ xtx @ beta)
            dfree = n - k
            s2 = rss / dfree if dfree > 0 else np.nan
            cov = s2 * np.linalg.inv(xtx)
            se = np.sqrt(np.diag(cov))
            stat = beta / se
            pv = np.array([t_two_sided(float(s), dfree) if dfree > 0 else np.nan for s in stat])
            tau2 = rss / n if divide_by_t else s2
            for t_, i in idx.items():
                rows.append((sid, t_, float(beta[i]), float(se[i]), float(stat[i]), float(pv[i]), tau2, n))
        except np.linalg.LinAlgError:
            for t_ in terms:
                rows.append((sid, t_, None, None, None, None, None, n))
        return pd.DataFrame(rows, columns=[site, "term", "estimate", "std_error", "statistic", "p_value", "tau2", "n"])

    schema = (
        f"{site} bigint, term string, estimate double, std_error double, statistic double, "
        "p_value double, tau2 double, n bigint"
    )
    return gram.groupBy(site).applyInPandas(solve, schema)


def assemble_precision(beta: DataFrame, tau2: DataFrame) -> DataFrame:
    """Q-hat from site regressions, symmetrised, with the dominance test.

    ``beta`` is (i, j, beta) with j a neighbour of i; ``tau2`` is (i, tau2).
    q_ii = 1/tau2_i, q_ij = -beta_ij / tau2_i, Q~_ij = (q_ij + q_ji)/2 (pairs
    missing a reverse entry count the missing side as 0).  Per site:
    off_abs = sum_j |Q~_ij|, dominant = q_ii > off_abs and
    lambda_bound = q_ii / off_abs, the largest lambda keeping row i
    strictly dominant.
    """
    b = beta.join(tau2, "i").select("i", "j", F.try_divide(-F.col("beta"), F.col("tau2")).alias("q"))
    rev = b.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("q").alias("q_rev"))
    sym = b.join(rev, ["i", "j"], "full_outer").select(
        "i", "j", (0.5 * (F.coalesce("q", F.lit(0.0)) + F.coalesce("q_rev", F.lit(0.0)))).alias("q_sym")
    )
    off = sym.groupBy("i").agg(F.sum(F.abs("q_sym")).alias("off_abs"))
    diag = tau2.select("i", F.try_divide(F.lit(1.0), F.col("tau2")).alias("q_ii"))
    return diag.join(off, "i", "left").fillna({"off_abs": 0.0}).select(
        "i", "q_ii", "off_abs",
        (F.col("q_ii") > F.col("off_abs")).alias("dominant"),
        F.when(F.col("off_abs") > 0, F.col("q_ii") / F.col("off_abs")).alias("lambda_bound"),
    )


def model_terms(numeric: list[str], factors: dict[str, list[str]]) -> dict[str, Column]:
    """Design columns of ``lm(y ~ numeric + factors)``: the first level of a factor is its base."""
    terms = {"(Intercept)": F.lit(1.0)} | {c: F.col(c).cast("double") for c in numeric}
    for f, levels in factors.items():
        terms |= {f"{f}{v}": F.when(F.col(f) == v, 1.0).otherwise(0.0) for v in levels[1:]}
    return terms


def model_rows(df: DataFrame, y: str, numeric: list[str], factors: dict[str, list[str]]) -> DataFrame:
    """The rows a fit uses: finite numbers and listed levels."""
    keep = dist.is_finite(y)
    for c in numeric:
        keep = keep & dist.is_finite(c)
    for f, levels in factors.items():
        keep = keep & F.col(f).isin(levels)
    return df.filter(keep)


def linear_model(df: DataFrame, y: str, numeric: list[str], factors: dict[str, list[str]], level: float = 0.95) -> DataFrame:
    """OLS of y on numeric columns and factors, tidy with p-value and interval (L3).

    One pass gives the sums of products of the design columns (numeric ones and y
    centred by their means, which a one-row aggregate before it gives); the k x k
    solve runs in one task on that single row.  Rows with non-finite numbers or
    levels that are not listed are left out of the whole fit.  The interval is
    estimate +- t_{(1+level)/2, n-k} se, as ``confint`` gives for ``lm``.  A singular
    design gives NULL estimates.
    """
    terms = list(model_terms(numeric, factors))
    k = len(terms)
    rows = model_rows(df, y, numeric, factors)
    means = rows.agg(F.avg(y).alias("_my"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(numeric, 1)])
    centred = {c: F.col(c) - F.col(f"_m{i}") for i, c in enumerate(numeric, 1)}
    design = [centred.get(t, x) for t, x in model_terms(numeric, factors).items()]
    x = rows.crossJoin(F.broadcast(means)).select(
        *[c.alias(f"x{i}") for i, c in enumerate(design)], (F.col(y) - F.col("_my")).alias("_y")
    )
    cols = [*[f"x{i}" for i in range(k)], "_y"]
    sums = x.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(a) * F.col(b)).alias(f"{a}:{b}") for i, a in enumerate(cols) for b in cols[i:]],
    ).crossJoin(F.broadcast(means))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        n = int(row["n"])
        g = np.array([[row[f"{cols[min(i, j)]}:{cols[max(i, j)]}"] for j in range(k + 1)] for i in range(k + 1)], float)
        back = np.eye(k)  # from centred columns to the given ones: only the intercept changes
        back[0, 1 : 1 + len(numeric)] = [-float(row[f"_m{i}"] or 0.0) for i in range(1, len(numeric) + 1)]
        out = pd.DataFrame({"term": terms, "n": n})
        names = ["estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"]
        try:
            beta = np.linalg.solve(g[:k, :k], g[:k, k])
            cov = np.linalg.inv(g[:k, :k])
        except np.linalg.LinAlgError:
            return out.assign(**dict.fromkeys(names, np.nan)).astype({c: "float64" for c in names})
        s2 = (g[k, k] - beta @ g[:k, k]) / (n - k) if n > k else np.nan
        est = back @ beta
        est[0] += float(row["_my"])
        se = np.sqrt(s2 * np.diag(back @ cov @ back.T))
        tq = t_critical(level, n - k) if n > k else np.nan
        p = [t_two_sided(float(s), n - k) if n > k else np.nan for s in est / se]
        return out.assign(estimate=est, std_error=se, statistic=est / se, p_value=p, conf_low=est - tq * se, conf_high=est + tq * se)

    schema = "term string, n bigint, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double"
    return sums.groupBy("n").applyInPandas(solve, schema)


def dummy_ols(df: DataFrame, y: str, factor: str, levels: list[str], level: float = 0.95) -> DataFrame:
    """``lm(y ~ factor)`` with the first of ``levels`` as base (L3)."""
    return linear_model(df, y, [], {factor: levels}, level)


def _hat(xc: Column, left: Column, mid: Column, right: Column) -> Column:
    """Piecewise-linear hat function on (left, mid, right); NULL ends are flat."""
    up = F.when(left.isNull(), F.lit(1.0)).otherwise((xc - left) / (mid - left))
    down = F.when(right.isNull(), F.lit(1.0)).otherwise((right - xc) / (right - mid))
    v = F.when(xc <= mid, up).otherwise(down)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def penalised_sweep(df: DataFrame, x: str, y: str, knots: list[float], gammas: DataFrame, grid: DataFrame) -> DataFrame:
    """P-spline style smoother over a grid of penalties (L4).

    Basis: piecewise-linear hat functions on ``knots``; penalty: squared
    second differences of the coefficients times gamma.  One aggregate gives
    B'B and B'y (a single small row); each gamma's k x k solve runs in a
    grouped-map task on that row, and the fitted curve on ``grid`` is the
    basis expansion evaluated in Spark.
    """
    k = len(knots)
    spark = df.sparkSession
    kn = spark.createDataFrame(
        [(i, knots[i - 1] if i > 0 else None, knots[i], knots[i + 1] if i < k - 1 else None) for i in range(k)],
        "i int, k_left double, k_mid double, k_right double",
    )
    knot = {i: (F.lit(knots[i - 1]) if i > 0 else F.lit(None).cast("double"), F.lit(knots[i]),
                F.lit(knots[i + 1]) if i < k - 1 else F.lit(None).cast("double")) for i in range(k)}
    xc = F.col(x)
    b = df.select(*[_hat(xc, *knot[i]).alias(f"b{i}") for i in range(k)], F.col(y).alias("_y"))
    sums = [F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]
    sums += [F.sum(F.col(f"b{i}") * F.col("_y")).alias(f"r{i}") for i in range(k)]
    stats = b.agg(*sums)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gam = float(pdf["gamma"].iloc[0])
        G = np.array([[pdf[f"g{i}_{j}"].iloc[0] for j in range(k)] for i in range(k)])
        r = np.array([pdf[f"r{i}"].iloc[0] for i in range(k)])
        D = np.diff(np.eye(k), n=2, axis=0)
        coef = np.linalg.solve(G + gam * D.T @ D, r)
        return pd.DataFrame({"gamma": gam, "i": np.arange(k, dtype="int32"), "coef": coef})

    coefs = gammas.select("gamma").crossJoin(F.broadcast(stats)).groupBy("gamma").applyInPandas(
        solve, "gamma double, i int, coef double"
    )
    basis = grid.select(x).distinct().crossJoin(F.broadcast(kn)).select(
        x, "i", _hat(xc, F.col("k_left"), F.col("k_mid"), F.col("k_right")).alias("_b")
    )
    return basis.join(coefs, "i").groupBy("gamma", x).agg(F.sum(F.col("coef") * F.col("_b")).alias("fitted"))
