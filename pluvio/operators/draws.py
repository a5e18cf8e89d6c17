"""Posterior draws: summaries and chain diagnostics.

Draws are long: (chain, iteration, name, value), partitioned by chain on
disk.  A chain holds a quarter of all draws, so nothing here windows or
collects a whole chain or parameter: ranks and quantiles come from radix
refinement, lagged products from blocks of iterations, and moving averages
are block prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pluvio.functions import dist, text
from pluvio.operators import profile
from pluvio.operators.orderstats import average_ranks
from pluvio.session import materialize

MAD_SCALE = 1.4826


def split_name_index(df: DataFrame, col: str = "name") -> DataFrame:
    """``psi[17]`` -> variable = psi, station = 17."""
    var, idx = text.bracket_index(col)
    return df.withColumn("variable", var).withColumn("station", idx)


def parameter_means(draws: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Mean of each parameter's draws, split into (variable, station).

    ``keep`` is a key set of names (the reference's %in% list), applied as a
    semi-join before the scan is aggregated.
    """
    d = draws if keep is None else draws.join(keep.select("name"), "name", "left_semi")
    m = d.groupBy("name").agg(F.avg("value").alias("mean"))
    return split_name_index(m).select("variable", "station", "mean")


def summarise_draws(draws: DataFrame, by: list[str] | None = None) -> DataFrame:
    """mean, median, sd, mad, q5, q95 per parameter (D3, A5).

    Exact quantiles (linear interpolation) by radix refinement; mad = 1.4826
    median|x - median| needs the median first, so it is a second quantile
    pass over the absolute deviations.
    """
    by = by or ["name"]
    mom = draws.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    q = profile.group_quantiles(draws, by, "value", [0.05, 0.5, 0.95], "_q")
    # one row per parameter, read by every pass of the second one
    q = materialize(q.select(*by, F.col("_q0").alias("q5"), F.col("_q1").alias("median"), F.col("_q2").alias("q95")), "draw-quantiles")
    dev = draws.join(q.select(*by, "median"), by).withColumn("_dev", F.abs(F.col("value") - F.col("median")))
    mad = profile.group_quantiles(dev, by, "_dev", [0.5], "_m").select(*by, (F.col("_m0") * MAD_SCALE).alias("mad"))
    return mom.join(q, by).join(mad, by).select(*by, "mean", "median", "sd", "mad", "q5", "q95")


def _split_chains(draws: DataFrame) -> DataFrame:
    """Split chains: every chain halved by its own length (the middle draw of
    an odd length belongs to neither half), iterations numbered from 1 in ``_t``."""
    n = draws.groupBy("name", "chain").agg(F.count(F.lit(1)).alias("_n"))
    d = draws.join(n, ["name", "chain"])
    h = F.floor(F.col("_n") / 2)
    half = F.when(F.col("iteration") <= h, 1).when(F.col("iteration") > F.col("_n") - h, 2)
    return (
        d.withColumn("_half", half).filter(F.col("_half").isNotNull())
        .withColumn("_split", F.col("chain") * 2 + F.col("_half") - 1)
        .withColumn("_t", F.when(F.col("_half") == 1, F.col("iteration")).otherwise(F.col("iteration") - (F.col("_n") - h)))
        .drop("_n")
    )


def _rank_normal(df: DataFrame, value: str, out_col: str) -> DataFrame:
    """z = Phi^-1((r - 3/8) / (S + 1/4)) with average ranks r over the parameter.

    Ranks come from bins of bounded size, so a parameter with
    very many draws is not held by one task.
    """
    r = average_ranks(df, ["name"], value, "_arank", "_n")
    return dist.with_norm_ppf(r, (F.col("_arank") - 0.375) / (F.col("_n") + 0.25), out_col).drop("_arank", "_n")


def _between(n: str, m: str) -> Column:
    """Aggregate: variance of the split chains' means ``m``, weighted by their lengths ``n``
    (the plain sample variance when all lengths are equal)."""
    total, c = F.sum(n), F.count(F.lit(1))
    squares = F.sum(F.col(n) * F.col(m) * F.col(m)) - F.sum(F.col(n) * F.col(m)) * F.sum(F.col(n) * F.col(m)) / total
    return F.try_divide(squares * c, total * (c - 1))


def _rhat_of(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """sqrt(var+ / W) with W the pooled within-chain variance, var+ = (n - 1) / n W + B and n
    the mean length of the split chains, which may differ in length."""
    by = by or []
    chain = df.groupBy("name", *by, "_split").agg(
        F.avg(value).alias("_m"), F.var_samp(value).alias("_v"), F.count(F.lit(1)).alias("_len")
    )
    g = chain.groupBy("name", *by).agg(
        F.try_divide(F.sum(F.col("_v") * (F.col("_len") - 1)), F.sum(F.col("_len") - 1)).alias("_w"),
        _between("_len", "_m").alias("_vm"), F.avg("_len").alias("_n"),
    )
    var_plus = (F.col("_n") - 1) / F.col("_n") * F.col("_w") + F.col("_vm")
    return g.select("name", *by, F.sqrt(F.try_divide(var_plus, F.col("_w"))).alias("rhat"))


def rhat(draws: DataFrame) -> DataFrame:
    """Rank-normalised split R-hat: max of bulk and tail (folded) versions.

    The bulk values and the folded values are stacked into one long table
    keyed by (name, which), so a single distributed ranking serves both.
    """
    d = materialize(_split_chains(draws), "rhat-split")
    med = materialize(profile.group_quantiles(d, ["name"], "value", [0.5], "_q").select("name", F.col("_q0").alias("_med")), "draw-medians")
    d = d.join(med, "name")
    base = ["name", "_split"]
    both = d.select(*base, F.lit("bulk").alias("which"), F.col("value").alias("v")).unionByName(
        d.select(*base, F.lit("tail").alias("which"), F.abs(F.col("value") - F.col("_med")).alias("v"))
    )
    r = average_ranks(both, ["name", "which"], "v", "_arank", "_n")
    z = dist.with_norm_ppf(r, (F.col("_arank") - 0.375) / (F.col("_n") + 0.25), "_z").select(*base, "which", "_z")
    per = _rhat_of(z, "_z", ["which"])
    out = per.groupBy("name").agg(
        F.max(F.when(F.col("which") == "bulk", F.col("rhat"))).alias("rhat_bulk"),
        F.max(F.when(F.col("which") == "tail", F.col("rhat"))).alias("rhat_tail"),
    )
    return out.withColumn("rhat", F.greatest("rhat_bulk", "rhat_tail"))


#: Iterations of a block; a block and its halo are one Arrow table.
LAG_BLOCK = 4096


def lagged_products(rows: DataFrame, keys: list[str], time: str, cols: list[str], first: int, last: int) -> DataFrame:
    """(keys, col, lag, product): the sums of x_t x_{t + lag} over t for the lags first <= lag < last, per column.

    The times of a key (whole numbers, each at most once) are cut into blocks; a block gets the rows its own
    times need ``first`` to ``last - 1`` steps later as a halo, and all its lags are one correlation of two arrays.
    A row is sent to its block and the one or two blocks whose halo holds it; blocks are at
    least as long as the band of lags.  Missing times and NULL values contribute nothing.
    """
    block = max(LAG_BLOCK, last - first)
    t = F.col(time).cast("long")
    here = F.floor(t / block)
    # as a later partner the row serves the times t - last + 1 .. t - first
    serves = F.sequence(F.floor((t - (last - 1)) / block), F.floor((t - first) / block))
    sent = rows.select(*keys, t.alias("_at"), *[F.col(c).cast("double").alias(c) for c in cols],
                       F.explode(F.array_union(F.array(here), serves)).alias("_block"))

    def products(table: pa.Table) -> pa.Table:
        start = table.column("_block")[0].as_py() * block
        at = table.column("_at").to_numpy() - start
        own, later = (at >= 0) & (at < block), (at >= first) & (at < block + last - 1)
        lags = np.arange(first, last)
        out = {k: [table.column(k)[0].as_py()] * (len(lags) * len(cols)) for k in keys}
        sums = []
        for c in cols:
            x = np.nan_to_num(table.column(c).to_numpy())
            a, b = np.zeros(block), np.zeros(block + last - 1 - first)
            a[at[own]], b[at[later] - first] = x[own], x[later]
            end = int(at[own].max(initial=-1)) + 1  # a chain's last block may be short
            sums.append(np.correlate(b[: end + last - 1 - first], a[:end], "valid") if end else np.zeros(len(lags)))
        out |= {"col": np.repeat(cols, len(lags)), "lag": np.tile(lags, len(cols)), "product": np.concatenate(sums)}
        return pa.table({n: pa.array(v, schema.field(n).type) for n, v in out.items()})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    ddl = f"{kinds}, col string, lag int, product double"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    per = sent.groupBy(*keys, "_block").applyInArrow(products, ddl)
    return per.groupBy(*keys, "col", "lag").agg(F.sum("product").alias("product"))


def _chain_moments(x: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Centred split chains, and per (name, col) what the autocorrelation needs: W, var+, S draws, the longest chain."""
    keys = ["name", "_split"]
    m = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_N"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)])
    centred = x.join(m, keys).select(*keys, "_t", *[(F.col(c) - F.col(f"_m{i}")).alias(c) for i, c in enumerate(cols)])
    squares = centred.groupBy("name").agg(*[F.sum(F.col(c) * F.col(c)).alias(f"_p{i}") for i, c in enumerate(cols)])
    per = m.groupBy("name").agg(
        F.sum("_N").alias("_S"), F.avg("_N").alias("_n"), F.max("_N").alias("_longest"), F.sum(F.col("_N") - 1).alias("_free"),
        *[_between("_N", f"_m{i}").alias(f"_B{i}") for i in range(len(cols))],
    ).join(squares, "name")
    stacked = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"_p{i}").alias("_p0"), F.col(f"_B{i}").alias("_Bn")) for i, c in enumerate(cols)])
    per = per.select("name", "_S", "_n", "_longest", "_free", F.inline(stacked)).withColumn("_W", F.try_divide(F.col("_p0"), F.col("_free")))
    return centred, per.withColumn("_vp", (F.col("_n") - 1) / F.col("_n") * F.col("_W") + F.coalesce(F.col("_Bn"), F.lit(0.0)))


def _geyer_tau(products: DataFrame, per: DataFrame) -> DataFrame:
    """(name, col, ess, settled) from the lagged products known so far.

    rho(k) = 1 - (W - acov(k)) / var+; sums of the pairs (2 t, 2 t + 1) up to the first negative one, their running
    minimum, and tau = -1 + 2 sum P, all on the small (name, col, lag) table.  Settled: a negative pair sum was
    reached, all lags are there, or the column is constant (its ESS is NULL).
    """
    keys = ["name", "col"]
    # a column whose draws are all equal has no autocorrelation
    rho = products.join(per.filter(F.col("_vp") > 0), keys).withColumn(
        "_rho", F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(1.0 - (F.col("_W") - F.col("product") / F.col("_S")) / F.col("_vp"))
    ).filter(F.col("lag") < F.col("_longest"))
    pairs = rho.groupBy(*keys, F.floor(F.col("lag") / 2).alias("_tp")).agg(
        F.sum("_rho").alias("_P"), F.count(F.lit(1)).alias("_c")
    ).filter(F.col("_c") == 2)
    first_neg = pairs.filter(F.col("_P") < 0).groupBy(*keys).agg(F.min("_tp").alias("_stop"))
    kept = pairs.join(first_neg, keys, "left").filter(F.col("_stop").isNull() | (F.col("_tp") < F.col("_stop")))
    # running minimum over the pair index: a window over one parameter's few lags
    mono = kept.withColumn(
        "_Pm", F.min("_P").over(Window.partitionBy(*keys).orderBy("_tp").rowsBetween(Window.unboundedPreceding, 0))
    )
    tau = mono.groupBy(*keys).agg((-1.0 + 2.0 * F.sum("_Pm")).alias("_tau"))
    known = products.groupBy(*keys).agg((F.max("lag") + 1).alias("_lags"))
    tau_c = F.greatest(F.col("_tau"), F.try_divide(F.lit(1.0), F.log10(F.col("_S"))))
    settled = F.col("_stop").isNotNull() | (F.col("_lags") >= F.col("_longest")) | ~F.coalesce(F.col("_vp") > 0, F.lit(False))
    return per.join(tau, keys, "left").join(first_neg, keys, "left").join(known, keys, "left").select(
        *keys, F.when(F.col("_tau").isNotNull(), F.try_divide(F.col("_S"), tau_c)).alias("ess"), F.coalesce(settled, F.lit(True)).alias("settled")
    )


def _ess_of(x: DataFrame, cols: list[str], start_lag: int = 64) -> DataFrame:
    """(name, col, ess) of the split chains' columns: all of them in one pass over the blocks, and a further
    band of lags, four times as wide, only for the names that have not settled."""
    centred, per = _chain_moments(x, cols)
    centred, per = materialize(centred, "ess-centred"), materialize(per, "ess-moments")
    low, high, rest, products, done = 0, start_lag, centred, None, None
    while True:
        band = lagged_products(rest, ["name", "_split"], "_t", cols, low, high).groupBy("name", "col", "lag").agg(F.sum("product").alias("product"))
        known = band if products is None else products.unionByName(band)
        products = materialize(known, "ess-products")  # one row per name, column and lag
        step = materialize(_geyer_tau(products, per), "ess-step")
        settled = step.filter("settled").select("name", "col", "ess")
        done = settled if done is None else done.unionByName(settled)
        still = step.filter("NOT settled").select("name", "col")
        if still.isEmpty():
            return done
        per = per.join(still, ["name", "col"], "left_semi")
        products = products.join(still, ["name", "col"], "left_semi")
        rest = rest.join(still.select("name").distinct(), "name", "left_semi")
        low, high = high, high * 4


def ess(draws: DataFrame) -> DataFrame:
    """Bulk and tail effective sample sizes per parameter.

    ``iteration`` numbers every chain from 1.  Ranks come from bins of bounded size and the autocovariances
    from blocks of iterations, so no chain is held by one task; ess_tail is the smaller of
    the ESS of the 5% and 95% exceedance indicators.  A constant column's ESS is NULL.
    """
    d = materialize(_split_chains(draws), "ess-split")
    q = materialize(
        profile.group_quantiles(d, ["name"], "value", [0.05, 0.95], "_q").select("name", F.col("_q0").alias("_q05"), F.col("_q1").alias("_q95")),
        "ess-quantiles",
    )
    x = _rank_normal(d, "value", "_zb").join(q, "name").select(
        "name", "_split", "_t", "_zb",
        (F.col("value") <= F.col("_q05")).cast("double").alias("_lo"),
        (F.col("value") <= F.col("_q95")).cast("double").alias("_hi"),
    )
    e = _ess_of(materialize(x, "ess-input"), ["_zb", "_lo", "_hi"])

    def of(c: str) -> Column:
        return F.max(F.when(F.col("col") == c, F.col("ess")))

    return e.groupBy("name").agg(of("_zb").alias("ess_bulk"), F.least(of("_lo"), of("_hi")).alias("ess_tail"))


def autocorrelation(draws: DataFrame, max_lag: int) -> DataFrame:
    """Autocorrelation per (chain, name) for lags 0..max_lag (D5), up to the chain's length.

    Values are centred per chain; the lagged products come from blocks of iterations with a halo.
    """
    keys = ["chain", "name"]
    means = draws.groupBy(*keys).agg(F.avg("value").alias("_m"), (F.max("iteration") - F.min("iteration")).alias("_reach"))
    c = draws.join(means, keys).select(*keys, "iteration", (F.col("value") - F.col("_m")).alias("_xc"))
    num = lagged_products(c, keys, "iteration", ["_xc"], 0, max_lag + 1)
    den = num.filter("lag = 0").select(*keys, F.col("product").alias("_den"))
    reach = num.join(den, keys).join(means.select(*keys, "_reach"), keys).filter("lag <= _reach")
    return reach.select("chain", "name", "lag", (F.col("product") / F.col("_den")).alias("acf"))


def prefix_sums(df: DataFrame, keys: list[str], order: str, cols: list[str], block: int = 1 << 16) -> DataFrame:
    """Running sums of ``cols`` in ``order`` within ``keys``, without a window
    over a whole key: sums inside blocks of ``block`` consecutive order values
    plus the totals of earlier blocks (a small per-block table)."""
    b = df.withColumn("_blk", F.floor(F.col(order) / block))
    inside = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for c in cols:
        b = b.withColumn(f"_l_{c}", F.sum(c).over(inside))
    tot = b.groupBy(*keys, "_blk").agg(*[F.sum(c).alias(f"_b_{c}") for c in cols])
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    for c in cols:
        tot = tot.withColumn(f"_o_{c}", F.coalesce(F.sum(f"_b_{c}").over(earlier), F.lit(0)))
    out = b.join(tot.select(*keys, "_blk", *[f"_o_{c}" for c in cols]), [*keys, "_blk"])
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.col(f"_l_{c}"))
    return out.drop("_blk", *[f"_l_{c}" for c in cols], *[f"_o_{c}" for c in cols])


def acceptance(draws: DataFrame, half_width: int) -> DataFrame:
    """Accepted-move flag and its centred moving average per chain.

    accept = value != previous value (previous iteration found by an
    equi-join on iteration - 1; NULL for the first draw).  The average over
    iterations [i - k, i + k] ignores NULLs, so it is
    (S(min(i + k, N)) - S(i - k - 1)) / (C(min(i + k, N)) - C(i - k - 1)) with
    S, C running sums of the flags and of non-NULL counts.  Iterations are
    dense 1..N per (chain, name).
    """
    keys = ["chain", "name"]
    prev = draws.select(*keys, (F.col("iteration") + 1).alias("iteration"), F.col("value").alias("_prev"))
    a = draws.join(prev, [*keys, "iteration"], "left").withColumn(
        "accept", F.when(F.col("_prev").isNull(), F.lit(None)).otherwise((F.col("value") != F.col("_prev")).cast("double"))
    ).drop("_prev")
    flags = a.select(*keys, "iteration", F.coalesce("accept", F.lit(0.0)).alias("s"),
                     F.col("accept").isNotNull().cast("long").alias("c"))
    pre = prefix_sums(flags, keys, "iteration", ["s", "c"]).select(*keys, "iteration", "cum_s", "cum_c")
    n = draws.groupBy(*keys).agg(F.max("iteration").alias("_N"))
    k = half_width
    base = a.join(n, keys).withColumn("_u", F.least(F.col("iteration") + k, F.col("_N"))).withColumn(
        "_l", F.col("iteration") - k - 1
    )
    up = pre.select(*keys, F.col("iteration").alias("_u"), F.col("cum_s").alias("_su"), F.col("cum_c").alias("_cu"))
    lo = pre.select(*keys, F.col("iteration").alias("_l"), F.col("cum_s").alias("_sl"), F.col("cum_c").alias("_cl"))
    out = base.join(up, [*keys, "_u"]).join(lo, [*keys, "_l"], "left")
    smooth = F.try_divide(F.col("_su") - F.coalesce("_sl", F.lit(0.0)), F.col("_cu") - F.coalesce("_cl", F.lit(0)))
    return out.withColumn("accept_smooth", smooth).drop("_N", "_u", "_l", "_su", "_cu", "_sl", "_cl")


def bym2_combine(hyper: DataFrame, station_draws: DataFrame, scaling_factor: float) -> DataFrame:
    """mu + sigma (sqrt(rho / s) spatial + sqrt(1 - rho) random) per draw and station.

    ``hyper`` is one row per draw (chain, iteration, mu, sigma, rho);
    ``station_draws`` one row per (chain, iteration, station, spatial,
    random).  Joined on the draw key; s is the graph's scaling factor.
    """
    j = station_draws.join(hyper, ["chain", "iteration"])
    eff = F.sqrt(F.col("rho") / scaling_factor) * F.col("spatial") + F.sqrt(1.0 - F.col("rho")) * F.col("random")
    return j.select("chain", "iteration", "station", (F.col("mu") + F.col("sigma") * eff).alias("value"))


def curves_on_grid(grid: DataFrame, curves: DataFrame, density) -> DataFrame:
    """Evaluate ``density(x, curve columns)`` for every (x, curve) pair.

    ``grid`` (x) and ``curves`` (parameter rows) are small by construction;
    the curve table is broadcast.
    """
    g = grid.select("x").distinct().crossJoin(F.broadcast(curves))
    return g.withColumn("density", density(g))


def transformed(col: str, fn) -> Column:
    return fn(F.col(col))
