"""Order statistics and ranks by radix refinement against numpy, over hard values and small limits."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvio.operators import orderstats, profile


def _bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_order_key_is_the_bit_pattern(spark):
    rng = np.random.default_rng(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
              float("inf"), float("-inf"), 0.1, 1e-300, 4.0, 4.0 - 2**-51, 4.0 + 2**-50]
    values += [float(2.0**e) for e in range(-1074, 1024, 7)] + [float(np.nextafter(2.0**e, 0)) for e in range(-1021, 1024, 11)]
    values += struct.unpack("<500d", rng.bytes(4000))
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("k", orderstats.order_key(F.col("v")))
    assert all(r.k == _bits(r.v) for r in df.collect())


def _rows():
    rng = np.random.default_rng(2)
    rows = [("normal", float(v)) for v in rng.normal(size=700)]
    rows += [("near", 1.0 + float(v) * 1e-13) for v in rng.integers(0, 900, 600)]  # many rounds in one bin
    rows += [("hot", 3.25)] * 500 + [("hot", float(v)) for v in rng.normal(size=300)]
    rows += [("wide", float(s * 10.0**e)) for s, e in zip(rng.choice([-1, 1], 200), rng.uniform(-300, 300, 200), strict=True)]
    rows += [("one", 7.5), ("none", None), ("nan", float("nan")), ("nan", 1.0), (None, 2.0), (None, 4.0)]
    return rows


@pytest.mark.parametrize("leaf", [1 << 16, 20])
def test_quantiles_and_ranks(spark, monkeypatch, leaf):
    monkeypatch.setattr(orderstats, "LEAF_ROWS", leaf)
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.05, 0.31, 0.5, 0.95, 1.0]
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    got = {r.g: [r[f"q{i}"] for i in range(len(probs))] for r in profile.group_quantiles(df, ["g"], "v", probs).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        s = np.sort(values)
        for p, q in zip(probs, got[g], strict=True):
            h = (len(s) - 1) * p
            lo = int(np.floor(h))
            a, b = s[lo], s[min(lo + 1, len(s) - 1)]
            assert q == (a if a == b else a + (h - lo) * (b - a)), (g, p)
    want = set()
    for g, values in groups.items():
        x = np.array(values)
        for v in x:
            want.add((g, float(v), float((x < v).sum() + ((x == v).sum() + 1) / 2), len(x)))
    ranked = orderstats.average_ranks(df, ["g"], "v").collect()
    assert len(ranked) == sum(map(len, groups.values()))
    assert {(r.g, r.v, r["_rank"], r["_n"]) for r in ranked} == want
    alone = orderstats.average_ranks(df.where("g = 'hot'").drop("g"), [], "v").collect()
    assert {(r.v, r["_rank"]) for r in alone} == {(v, k) for g, v, k, _ in want if g == "hot"}
    assert orderstats.average_ranks(df.limit(0), ["g"], "v").count() == 0
    assert profile.group_quantiles(df.limit(0), ["g"], "v", probs).count() == 0
