"""Copula log-densities and dependence measures on long tables.

Data are long: one row per (replicate/vector, id/dim) with a uniform ``u``.
Quadratic forms with a dense D x D factor gather a key's D values and multiply
many keys at a time; a sparse precision Cholesky of any size is a COO table
(i, j, v) joined on the column index and summed by row.  Small matrix algebra on a
D x D parameter (Cholesky, inverse, determinant) happens on the driver with
numpy - it is a parameter, not data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pluvio.functions import dist
from pluvio.operators.pairs import pair_sums


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# Driver-side parameter algebra (D x D, D small)
# ---------------------------------------------------------------------------


def equicorrelation(d: int, rho: float) -> np.ndarray:
    return np.full((d, d), rho) + np.eye(d) * (1.0 - rho)


def ar1_correlation(d: int, rho: float) -> np.ndarray:
    idx = np.arange(d)
    return rho ** np.abs(idx[:, None] - idx[None, :])


def cholesky_inverse_coo(spark: SparkSession, sigma: np.ndarray) -> tuple[DataFrame, float]:
    """COO (i, j, v) of L^-1 for Sigma = L L^T (lower L), and sum(ln L_ii).

    Indices are 1-based to match ``dim`` / ``id`` columns.
    """
    L = np.linalg.cholesky(sigma)
    Li = np.linalg.inv(L)
    rows = [(i + 1, j + 1, float(Li[i, j])) for i in range(len(Li)) for j in range(i + 1) if Li[i, j] != 0.0]
    return spark.createDataFrame(rows, "i int, j int, v double"), float(np.sum(np.log(np.diag(L))))


# ---------------------------------------------------------------------------
# Uniforms and scores
# ---------------------------------------------------------------------------


def normal_scores(df: DataFrame, u: str = "u", out_col: str = "z") -> DataFrame:
    return dist.with_norm_ppf(df, F.col(u), out_col)


def quadratic_form(df: DataFrame, key: list[str], index: str, value: str, coo: DataFrame) -> DataFrame:
    """||M x||^2 per key for a sparse M given as COO (i, j, v), x long by index.

    sum_j v_ij x_j is an equi-join on j = index and a sum by (key, i); the
    result is one row per key with ``qf`` = sum_i (M x)_i^2.
    """
    x = df.select(*key, F.col(index).alias("j"), F.col(value).alias("_x"))
    mx = x.join(coo, "j").groupBy(*key, "i").agg(F.sum(F.col("v") * F.col("_x")).alias("_mx"))
    return mx.groupBy(*key).agg(F.sum(F.col("_mx") * F.col("_mx")).alias("qf"))


def _squared_lengths(index: pa.Array, values: pa.Array, factor: np.ndarray, columns: np.ndarray) -> pa.Array:
    """||M x||^2 of each row's list of (index, value); null where no index is a column of M."""
    j, x = index.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(index)), np.diff(index.offsets.to_numpy()))
    at = np.minimum(np.searchsorted(columns, j), len(columns) - 1)
    known = columns[at] == j
    dense = np.zeros((len(index), len(columns)))
    np.add.at(dense, (row[known], at[known]), x[known])
    finite = np.isfinite(dense).all(axis=1)
    out = np.full(len(index), np.nan)
    out[finite] = ((dense[finite] @ factor.T) ** 2).sum(axis=1)
    with np.errstate(invalid="ignore"):
        for r in np.flatnonzero(~finite):  # infinity times an entry that M does not have is nothing
            out[r] = (np.where(factor != 0, factor * dense[r], 0.0).sum(axis=1) ** 2).sum()
    return pa.array(out, mask=np.bincount(row[known], minlength=len(index)) == 0)


def dense_quadratic_form(df: DataFrame, key: list[str], index: str, value: str, coo: DataFrame, sums: list[Column]) -> DataFrame:
    """``qf`` = ||M x||^2 per key beside the aggregates ``sums`` of the key's rows, for a dense D x D parameter M as COO.

    A key's values are gathered once (D of them), and a task multiplies the
    vectors of many keys at a time: no row is made per entry of M.  Values at other
    indices and NULL values do not count; a NULL key or one without any index of M has no row.
    """
    entries = coo.select("i", "j", "v").collect()  # the parameter, made on the driver
    rows, columns = (np.unique([e[k] for e in entries]) for k in (0, 1))
    factor = np.zeros((len(rows), len(columns)))
    for i, j, v in entries:
        factor[np.searchsorted(rows, i), np.searchsorted(columns, j)] += v

    @F.arrow_udf(DoubleType())
    def squared(index: pa.Array, values: pa.Array) -> pa.Array:
        return _squared_lengths(index, values, factor, columns)

    x = df.withColumn("_j", F.col(index).cast("long")).withColumn("_x", F.col(value).cast("double"))
    entry = F.when(F.col("_x").isNotNull() & F.col("_j").isNotNull(), F.struct("_j", "_x"))
    found = x.groupBy(*key).agg(
        F.collect_list(entry).alias("_v"), F.count_if(F.col("_j").isin(columns.tolist())).alias("_known"), *sums
    )
    keep = [c for c in found.columns if c not in ("_v", "_known")]
    for k in key:
        found = found.where(F.col(k).isNotNull())
    return found.where("_known > 0").select(*keep, squared(F.col("_v._j"), F.col("_v._x")).alias("qf"))


def gaussian_copula_logc(df: DataFrame, key: list[str], index: str, u: str, linv: DataFrame, log_det_l: float,
                         extra: list[Column] | None = None) -> DataFrame:
    """Gaussian copula log-density per key (C2), for a factor of D x D numbers.

    log c = -sum ln L_ii - 1/2 (||L^-1 z||^2 - ||z||^2), z = Phi^-1(u).  ``extra``
    aggregates (e.g. the margins' log-likelihood) are computed in the same pass.
    """
    z = normal_scores(df, u, "z")
    zz = F.sum(F.col("z") * F.col("z")).alias("_zz")
    qf = dense_quadratic_form(z, key, index, "z", linv, [zz, *(extra or [])])
    keep = [c for c in qf.columns if c not in (*key, "_zz", "qf")]
    return qf.select(*key, (F.lit(-log_det_l) - 0.5 * (F.col("qf") - F.col("_zz"))).alias("log_c"), *keep)


def _ar1_pairs(z: Column, z_next: Column, rho: float) -> tuple[list[Column], Column]:
    """(aggregates, log-density) of a stationary AR(1) Gaussian copula from its neighbouring pairs.

    Such a chain is Markov, so its copula density is the product of the bivariate Gaussian
    copula densities of neighbours:
    sum over pairs of -ln(1 - rho^2)/2 - (rho^2 (x^2 + y^2) - 2 rho x y) / (2 (1 - rho^2)).
    """
    sums = [
        F.count(z_next).alias("_pairs"),
        F.coalesce(F.sum(z * z + z_next * z_next), F.lit(0.0)).alias("_squares"),
        F.coalesce(F.sum(z * z_next), F.lit(0.0)).alias("_products"),
    ]
    gap = 1.0 - rho * rho
    log_c = (
        -0.5 * math.log(gap) * F.col("_pairs")
        - (rho * rho * F.col("_squares") - 2.0 * rho * F.col("_products")) / (2.0 * gap)
    )
    return sums, log_c


def ar1_copula_logc(df: DataFrame, key: list[str], order: str, u: str, rho: float) -> DataFrame:
    """AR(1) Gaussian copula log-density per key, the elements in ``order``."""
    z = normal_scores(df, u, "z")
    z = z.withColumn("_zn", F.lead("z").over(Window.partitionBy(*key).orderBy(order)))
    sums, log_c = _ar1_pairs(F.col("z"), F.col("_zn"), rho)
    return z.groupBy(*key).agg(*sums).select(*key, log_c.alias("log_c"))


def ar1_copula_logc_paired(df: DataFrame, key: list[str], u: str, u_next: str, rho: float,
                           extra: list[Column] | None = None) -> DataFrame:
    """AR(1) Gaussian copula log-density from rows that carry their successor's
    uniform ``u_next`` (NULL for the last element) (C3).

    Same value as :func:`ar1_copula_logc`; when the order is fixed by a small
    table (e.g. test stations) the successor can be attached before a large
    fan-out, and every term is row-local: no window, no sort of the fan-out,
    only partial aggregation by ``key``.  ``extra`` aggregates (e.g. the
    margins' log-likelihood) are computed in the same pass.
    """
    z = normal_scores(normal_scores(df, u, "_z"), u_next, "_zn")
    sums, log_c = _ar1_pairs(F.col("_z"), F.col("_zn"), rho)
    agg = z.groupBy(*key).agg(*sums, *(extra or []))
    keep = [c for c in agg.columns if c not in (*key, "_pairs", "_squares", "_products")]
    return agg.select(*key, log_c.alias("log_c"), *keep)


def precision_cholesky_logc(df: DataFrame, key: list[str], index: str, u: str, chol: DataFrame,
                            log_det) -> DataFrame:
    """Gaussian copula with a sparse precision Cholesky factor as COO (C4).

    log c = log_det - 1/2 ||R z||^2 + 1/2 ||z||^2 where Q = R^T R.
    ``log_det`` is a number or a one-row DataFrame with a ``log_det`` column.
    """
    z = normal_scores(df, u, "z")
    qf = quadratic_form(z, key, index, "z", chol)
    zz = z.groupBy(*key).agg(F.sum(F.col("z") * F.col("z")).alias("zz"))
    j = qf.join(zz, key)
    if isinstance(log_det, DataFrame):
        j = j.crossJoin(F.broadcast(log_det.select("log_det")))
        ld = F.col("log_det")
    else:
        ld = F.lit(float(log_det))
    return j.select(*key, (ld - 0.5 * F.col("qf") + 0.5 * F.col("zz")).alias("log_c"))


def ar1_precision_cholesky_table(ids: DataFrame, rho: float, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Upper-bidiagonal R with R^T R = AR(1) precision over the ids present,
    as COO, and log|R| as a one-row table (C4, C13).

    Row i < n: R_ii = 1/sqrt(1-rho^2), R_i,i+1 = -rho/sqrt(1-rho^2); R_nn = 1.
    The ids are consecutive integers; the neighbour is an equi-join on i + 1.
    """
    s = 1.0 / math.sqrt(1.0 - rho * rho)
    v = ids.select(F.col(id_col).alias("i")).distinct()
    stats = v.agg(F.max("i").alias("_hi"), ((F.count(F.lit(1)) - 1) * math.log(s)).alias("log_det"))
    diag = v.crossJoin(F.broadcast(stats.select("_hi"))).select(
        "i", F.col("i").alias("j"), F.when(F.col("i") == F.col("_hi"), F.lit(1.0)).otherwise(F.lit(s)).alias("v")
    )
    up = v.join(v.select((F.col("i") - 1).alias("i"), F.col("i").alias("j")), "i").withColumn("v", F.lit(-rho * s))
    return diag.unionByName(up), stats.select("log_det")


def ar1_precision_coo(spark: SparkSession, ids: DataFrame, rho: float, id_col: str = "id") -> DataFrame:
    """Tridiagonal AR(1) precision as COO over the ids present.

    Q_ii = (1 + rho^2)/(1 - rho^2) inside, 1/(1 - rho^2) at both ends,
    Q_i,i+-1 = -rho/(1 - rho^2).  Neighbours are +-1 shifts: equi-joins.
    """
    s = 1.0 / (1.0 - rho * rho)
    v = ids.select(F.col(id_col).alias("i")).distinct()
    bounds = v.agg(F.min("i").alias("_lo"), F.max("i").alias("_hi"))
    diag = v.crossJoin(F.broadcast(bounds)).select(
        "i", F.col("i").alias("j"),
        F.when((F.col("i") == F.col("_lo")) | (F.col("i") == F.col("_hi")), F.lit(s))
        .otherwise(F.lit((1.0 + rho * rho) * s)).alias("v"),
    )
    up = v.join(v.select((F.col("i") - 1).alias("i"), F.col("i").alias("j")), "i")
    down = v.join(v.select((F.col("i") + 1).alias("i"), F.col("i").alias("j")), "i")
    off = up.unionByName(down).withColumn("v", F.lit(-rho * s))
    return diag.unionByName(off)


def ar1_correlation_entries(pairs: DataFrame, rho: float) -> DataFrame:
    """rho^|i - j| for the requested (i, j) pairs.

    The AR(1) correlation is dense, so it is evaluated on the pairs a caller
    asks for rather than materialised.
    """
    return pairs.withColumn("v", F.pow(F.lit(rho), F.abs(F.col("i") - F.col("j"))))


def t_copula_logc(df: DataFrame, key: list[str], index: str, u: str, linv: DataFrame, log_det_l: float,
                  nu: float, d: int) -> DataFrame:
    """t copula log-density per key.

    x = t_nu^-1(u); log c = log t_D(x; 0, LL^T, nu) - sum log t_1(x_i; nu) with
    log t_D = lgamma((nu+D)/2) - lgamma(nu/2) - D/2 ln(nu pi) - ln|L|
    - (nu+D)/2 ln(1 + ||L^-1 x||^2 / nu).  Gamma constants are folded here.
    """
    x = df.withColumn("x", dist.t_ppf(F.col(u), nu) if nu in (1, 2, 3) else dist.t_ppf_real(F.col(u), nu))
    qf = dense_quadratic_form(x, key, index, "x", linv, [F.sum(dist.t_logpdf(F.col("x"), nu)).alias("_lm")])
    const = math.lgamma((nu + d) / 2) - math.lgamma(nu / 2) - d / 2 * math.log(nu * math.pi) - log_det_l
    joint = F.lit(const) - (nu + d) / 2.0 * F.log1p(F.col("qf") / nu)
    return qf.select(*key, (joint - F.col("_lm")).alias("log_c"))


# ---------------------------------------------------------------------------
# Archimedean families
# ---------------------------------------------------------------------------


# Each family gives its generator phi and ln phi^-1: with many margins the CDF itself is
# too small for a double.


def _clayton(theta):
    return (lambda u: (F.pow(u, -theta) - 1.0) / theta, lambda s: F.log1p(theta * s) / -theta)


def _gumbel(theta):
    return (lambda u: F.pow(-F.log(u), theta), lambda s: -F.pow(s, 1.0 / theta))


def _frank(theta):
    em = math.expm1(-theta)
    return (
        lambda u: -F.log(F.expm1(-theta * u) / em),
        # -ln(1 + y) / theta with y = e^-s em; for s > 40 it is -y / theta to double precision
        lambda s: F.when(s > 40, math.log(-em / theta) - s).otherwise(F.log(-F.log1p(F.exp(-s) * em) / theta)),
    )


ARCHIMEDEAN = {"clayton": _clayton, "gumbel": _gumbel, "frank": _frank}


def archimedean_log_cdf(df: DataFrame, key: list[str], u: str, family: str, theta: float) -> DataFrame:
    """ln C(u) with C(u) = phi^-1(sum_i phi(u_i)) per key, any dimension."""
    gen, log_inv = ARCHIMEDEAN[family](theta)
    s = df.groupBy(*key).agg(F.sum(gen(F.col(u))).alias("_s"))
    return s.select(*key, log_inv(F.col("_s")).alias("log_C"))


def frank_cdf_2d(u, v, theta: float) -> Column:
    """Closed-form bivariate Frank copula."""
    u, v = _c(u), _c(v)
    return -F.log1p(F.expm1(-theta * u) * F.expm1(-theta * v) / math.expm1(-theta)) / theta


def independence_log_cdf(df: DataFrame, key: list[str], u: str) -> DataFrame:
    """ln C(u) = sum ln u_i."""
    return df.groupBy(*key).agg(F.sum(F.log(F.col(u))).alias("log_C"))


# ---------------------------------------------------------------------------
# Dependence measures
# ---------------------------------------------------------------------------


def t_tail_dependence(rho, nu) -> Column:
    """lambda = 2 t_{nu+1}(-sqrt((nu+1)(1-rho)/(1+rho))) for any real nu > 0, a Column or number."""
    r, v = _c(rho), _c(nu)
    arg = F.sqrt(F.try_divide((v + 1.0) * (1.0 - r), 1.0 + r))
    # at rho = -1 the argument is minus infinity
    return F.when(r <= -1.0, 0.0 * r).otherwise(dist.t_two_sided(arg, v + 1.0))


def kendall_from_rho(rho) -> Column:
    return 2.0 / math.pi * F.asin(_c(rho))


def spearman_from_rho(rho) -> Column:
    return 6.0 / math.pi * F.asin(_c(rho) / 2.0)


def empirical_tail_dependence(df: DataFrame, key: str, index: str, u: str, threshold: float) -> DataFrame:
    """Upper and lower tail dependence between every pair of margins (C11).

    lambda_U = P(u_j > t | u_i > t) and lambda_L = P(u_j <= 1-t | u_i <= 1-t) over the keys that have
    both margins (null and NaN are absent); the counts of all pairs come from one pass (``pairs.pair_sums``).
    """
    up, low = F.col(u) > threshold, F.col(u) <= 1.0 - threshold
    sums = pair_sums(
        df.where(dist.is_finite(u)), key, index, {"one": F.lit(1.0), "up": up.cast("int"), "low": low.cast("int")},
        {"n": ("one", "one"), "up_i": ("up", "one"), "low_i": ("low", "one"), "up_both": ("up", "up"), "low_both": ("low", "low")},
    )
    return sums.where("var1 < var2 AND n > 0").select(
        F.col("var1").alias("i"), F.col("var2").alias("j"),
        F.try_divide("up_both", "up_i").alias("lambda_upper"), F.try_divide("low_both", "low_i").alias("lambda_lower"),
    )


def log_mean_exp(df: DataFrame, key: list[str], value: str, out_col: str = "lpd") -> DataFrame:
    """log(mean(exp(x))) per key, stabilised by the key's max.

    The per-key max is a grouped aggregate joined back (one row per key).
    """
    m = df.groupBy(*key).agg(F.max(value).alias("_m"))
    return (
        df.join(m, key)
        .groupBy(*key, "_m")
        .agg(F.avg(F.exp(F.col(value) - F.col("_m"))).alias("_a"))
        .select(*key, (F.col("_m") + F.log("_a")).alias(out_col))
    )
