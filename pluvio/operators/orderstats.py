"""Exact order statistics and ranks by radix refinement.

A double becomes a 64-bit integer that keeps its order.  The rows of a group are counted by
the high bits of that key, a partial aggregate that is small whatever the rows are; the running
counts tell which bins hold the wanted ranks (or, for ranks of all rows, which bins are too
large to be sorted in one task), and only those are counted again by further bits.  A bin whose
least and greatest value are equal is settled, so a value that holds half of all rows is one
counter and no task's load.  No row is range-sorted or copied, and every window here
runs over at most ``2 ** BITS`` bins or ``LEAF_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.session import materialize

#: Bits of the key that one round of counting resolves.
BITS = 16
#: Rows of a bin that are few enough to be ordered together.
LEAF_ROWS = 1 << 16
#: Tasks over which the rows of one frequent value are dealt.
SPREAD = 1024

_KEY, _VALUE = "_key", "_v"


def order_key(value: Column) -> Column:
    """The 64-bit integer of a double (not NaN) that orders as the doubles do; equal for 0.0 and -0.0.

    It is the magnitude's bit pattern with the double's sign, by arithmetic: the exponent from the
    logarithm, put right where that rounds across a power of two, and the mantissa by
    an exact scaling.
    """

    def power(e: Column) -> Column:
        return F.pow(F.lit(2.0), e.cast("double"))

    size = F.abs(value)
    guess = F.floor(F.log2(size))
    exponent = F.when(power(guess) > size, guess - 1).when(size >= power(guess + 1), guess + 1).otherwise(guess)
    exponent = F.greatest(F.least(exponent, F.lit(1023)), F.lit(-1022))
    # |x| = (1 + m) 2 ** e
    normal = (exponent + 1023) * (1 << 52) + ((size * power(-exponent) - 1.0) * 2.0**52).cast("long")
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    magnitude = (
        F.when(size == 0.0, F.lit(0).cast("long"))
        .when(size == float("inf"), F.lit(2047 << 52).cast("long"))
        .when(size < 2.0**-1022, tiny)
        .otherwise(normal)
    )
    return F.when(value < 0.0, -magnitude).otherwise(magnitude)


def _present(value: str) -> Column:
    v = F.col(value).cast("double")
    return v.isNotNull() & ~F.isnan(v)


def _bin(shift: int) -> Column:
    return F.shiftright(_KEY, shift)


def _match(a: str, b: str, keys: Sequence[str]) -> Column:
    """Rows of one group: NULL keys are a group like any other."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def _counts(rows: DataFrame, keys: list[str], shift: int, within: list[str]) -> DataFrame:
    """Rows, least and greatest value of every bin (key without its ``shift`` low bits), and the rows before it inside ``within``."""
    c = rows.groupBy(*keys, *within, _bin(shift).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c"), F.min(_VALUE).alias("_lo"), F.max(_VALUE).alias("_hi")
    )
    order = Window.partitionBy(F.lit(0), *keys, *within).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("_before", F.coalesce(F.sum("_c").over(order), F.lit(0).cast("long")))


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: Column) -> DataFrame:
    """(keys, _n, _rank, _value): the values at the 0-based ranks ``wanted``, an array over the group size ``_n``.

    NULL and NaN values do not count; a NULL key is a group of its own; groups without values give no row.
    """
    rows = df.where(_present(value)).select(*keys, F.col(value).cast("double").alias(_VALUE)).withColumn(_KEY, order_key(F.col(_VALUE)))
    shift = 64 - BITS
    first = _counts(rows, keys, shift, [])
    sizes = first.withColumn("_n", F.sum("_c").over(Window.partitionBy(F.lit(0), *keys)))
    # a wanted rank falls into the bin whose rows reach beyond it
    picks = sizes.withColumn("_rank", F.explode(F.array_distinct(wanted))).where(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c"))
    )
    picks = materialize(picks.withColumn("_r", F.col("_rank") - F.col("_before")).drop("_before"), "order-picks")
    done = None
    while True:
        settled = picks.where("_lo = _hi").select(*keys, "_n", "_rank", F.col("_lo").alias("_value"))
        done = settled if done is None else done.unionByName(settled)
        rest = picks.where("_lo < _hi")
        most = rest.agg(F.max("_c")).first()[0]
        if most is None:
            return done
        # the bins to look into: a few per group, so the planner may broadcast them
        bins = rest.select(*keys, F.col("_bin").alias("_up")).distinct()
        here = rows.withColumn("_bin", _bin(shift)).alias("r").join(
            bins.alias("p"), _match("r", "p", keys) & (F.col("r._bin") == F.col("p._up"))
        ).select(*[F.col(f"r.{k}").alias(k) for k in keys], "p._up", f"r.{_VALUE}", f"r.{_KEY}")
        # bins of few rows are resolved to single keys at once
        shift = 0 if most <= LEAF_ROWS else max(shift - BITS, 0)
        inside = _counts(here, keys, shift, ["_up"])
        carried = rest.select(*keys, "_n", "_rank", F.col("_bin").alias("_up"), "_r")
        found = inside.alias("c").join(
            carried.alias("p"),
            _match("c", "p", keys) & (F.col("c._up") == F.col("p._up"))
            & (F.col("p._r") >= F.col("c._before")) & (F.col("p._r") < F.col("c._before") + F.col("c._c")),
        ).select(
            *[F.col(f"p.{k}").alias(k) for k in keys], "p._n", "p._rank", "c._bin", "c._c", "c._lo", "c._hi",
            (F.col("p._r") - F.col("c._before")).alias("_r"),
        )
        if shift == 0:
            return done.unionByName(found.select(*keys, "_n", "_rank", F.col("_lo").alias("_value")))
        picks = materialize(found, "order-picks")


def _rank_bins(rows: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Tables of bins by round: (keys, _bin, _c, _single, _start, _deeper), _start being the rows of the group
    before the bin.  Bins of more than ``LEAF_ROWS`` rows and several values go on to the next round."""
    shift, out = 64 - BITS, []
    counted = _counts(rows, keys, shift, []).withColumn("_start", F.col("_before"))
    while True:
        single = F.col("_lo") == F.col("_hi")
        level = materialize(
            counted.select(*keys, "_bin", "_c", single.alias("_single"), "_start", (~single & (F.col("_c") > LEAF_ROWS)).alias("_deeper")),
            "rank-bins",
        )
        out.append(level)
        up = level.where("_deeper").select(*keys, F.col("_bin").alias("_up"), F.col("_start").alias("_base"))
        if shift == 0 or up.isEmpty():
            return out
        rows = rows.withColumn("_bin", _bin(shift)).alias("r").join(
            up.alias("p"), _match("r", "p", keys) & (F.col("r._bin") == F.col("p._up"))
        ).select(*[F.col(f"r.{k}").alias(k) for k in keys], f"r.{_VALUE}", f"r.{_KEY}", "p._up", "p._base")
        shift -= BITS
        counted = _counts(rows, keys, shift, ["_up", "_base"]).withColumn("_start", F.col("_base") + F.col("_before"))
        rows = rows.drop("_up", "_base")


def average_ranks(df: DataFrame, keys: list[str], value: str, rank_col: str = "_rank", n_col: str = "_n") -> DataFrame:
    """The rows of ``df`` with their 1-based average rank within ``keys`` and the group size.

    Rows of NULL or NaN value are left out; a NULL key is a group of its own.  Rows of a settled bin (a
    frequent value) take their rank from the bin and are dealt over tasks; the others are ordered
    in their bin, which holds at most ``LEAF_ROWS`` rows.
    """
    v = F.col(value).cast("double")
    rows = df.where(_present(value)).withColumn(_VALUE, v).withColumn(_KEY, order_key(F.col(_VALUE)))
    levels = _rank_bins(rows.select(*keys, _VALUE, _KEY), keys)
    names = [f"_k{j}" for j in range(len(keys))]

    def same_group() -> Column:
        cond = F.lit(True)
        for n, k in zip(names, keys, strict=True):
            cond = cond & F.col(n).eqNullSafe(F.col(k))
        return cond

    found, leaf = rows, None
    for i, level in enumerate(levels):
        bins = level.select(
            *[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)], F.col("_bin").alias("_b"),
            F.struct("_bin", "_c", "_single", "_start", "_deeper").alias(f"_l{i}"),
        )
        found = found.join(bins, same_group() & (F.col("_b") == _bin(64 - BITS * (i + 1))), "inner" if i == 0 else "left").drop(*names, "_b")
        leaf = F.col(f"_l{i}") if leaf is None else F.when(leaf["_deeper"], F.col(f"_l{i}")).otherwise(leaf)
    found = found.withColumn("_leaf", leaf).drop(*[f"_l{i}" for i in range(len(levels))])
    # by the row's columns and its task, so that a task run again deals its rows alike
    spread = F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), F.lit(SPREAD))
    found = found.withColumn("_spread", F.when(F.col("_leaf._single"), spread).otherwise(F.lit(0).cast("long")))
    by = Window.partitionBy(*keys, "_leaf._start", "_spread")
    upto = F.count(F.lit(1)).over(by.orderBy(_VALUE).rangeBetween(Window.unboundedPreceding, 0))
    ties = F.count(F.lit(1)).over(by.orderBy(_VALUE).rangeBetween(0, 0))
    ranked = found.withColumn("_upto", upto).withColumn("_ties", ties)
    start = F.col("_leaf._start")
    rank = F.when(F.col("_leaf._single"), start + (F.col("_leaf._c") + 1) / 2).otherwise(start + F.col("_upto") - (F.col("_ties") - 1) / 2)
    ranked = ranked.withColumn(rank_col, rank).select(*df.columns, rank_col)
    sizes = levels[0].groupBy(*[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)]).agg(F.sum("_c").alias(n_col))
    if not keys:
        return ranked.crossJoin(F.broadcast(sizes))  # one row
    return ranked.join(sizes, same_group()).drop(*names)
