"""Golden file names from the source listing, period parsing, and text helpers."""

import datetime as dt

from pyspark.sql import functions as F

from pluvio.functions import text
from pluvio.sources import files

# The first six names of the source's file listing.
GOLDEN = [
    "pr_rcp85_land-cpm_uk_5km_01_1hr_19801201-19801230.nc",
    "pr_rcp85_land-cpm_uk_5km_01_1hr_19810101-19810130.nc",
    "pr_rcp85_land-cpm_uk_5km_01_1hr_19810201-19810230.nc",
    "pr_rcp85_land-cpm_uk_5km_01_1hr_19810301-19810330.nc",
    "pr_rcp85_land-cpm_uk_5km_01_1hr_19810401-19810430.nc",
    "pr_rcp85_land-cpm_uk_5km_01_1hr_19810501-19810530.nc",
]


def test_split_listing_drops_trailing_empty(spark):
    listing = spark.createDataFrame([("\n".join(GOLDEN) + "\n",)], "listing string")
    names = [r.filename for r in files.split_listing(listing).collect()]
    assert names == GOLDEN


def test_parse_period_uses_real_month_end(spark):
    df = spark.createDataFrame([(n,) for n in GOLDEN], "filename string")
    got = {r.filename: (r.from_date, r.to_date) for r in files.parse_period(df).collect()}
    assert got[GOLDEN[0]] == (dt.date(1980, 12, 1), dt.date(1980, 12, 31))
    assert got[GOLDEN[2]] == (dt.date(1981, 2, 1), dt.date(1981, 2, 28))


def test_period_filename_round_trip(spark):
    df = spark.createDataFrame([(dt.date(1981, 3, 1),)], "d date")
    assert df.select(files.period_filename(F.col("d")).alias("f")).first().f == GOLDEN[3]


def test_grid_to_long_numbering(spark):
    grid = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "v array<double>")
    rows = {(r.proj_x, r.proj_y): (r.station, r.precip) for r in files.grid_to_long(grid, "v", 3).collect()}
    assert rows[(1, 1)] == (1, 1.0) and rows[(3, 1)] == (3, 3.0) and rows[(1, 2)] == (4, 4.0)


def test_text_helpers(spark):
    df = spark.createDataFrame([("psi[17]", 1.0, "a-b-a"), ("mu0", 12.345, "xx")], "s string, x double, t string")
    out = df.select(
        text.parse_number("s").alias("num"),
        text.pad_number_text("x").alias("pad"),
        text.replace_first("t", "a", "Z").alias("rep"),
        text.interval_text(F.lit(1.234), F.lit(0.5), F.lit(2.0)).alias("iv"),
    ).collect()
    assert out[0].num == 17.0 and out[1].num == 0.0
    assert out[0].pad == "1.00" and out[1].pad == "12.35"
    assert out[0].rep == "Z-b-a"
    assert out[0].iv == "1.23 [0.50, 2.00]"


def test_clean_names():
    assert text.clean_name(".Iteration") == "iteration"
    assert text.clean_name("Draw.click") == "draw_click"


def test_latest_run_alone_is_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    wide = spark.createDataFrame([(c, i, c + i / 4, None if i == 2 else -1e-9 * i) for c in (1, 2) for i in (1, 2, 3)], "chain int, iteration long, a double, b double")
    files.write_sampler_csv(wide.withColumn("a", F.col("a") + 100), path, "m-20230101", "chain", "iteration", ["old"])
    files.write_sampler_csv(wide, path, "m-20231101", "chain", "iteration", ["method = sample", "seed, 5"])
    want = sorted((r.chain, r.iteration, n, r[n]) for r in wide.collect() for n in "ab")
    got = files.read_latest_run(spark, path, ["chain", "iteration"], "chain int, iteration bigint, a double, b double")
    key = lambda r: r[:3]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert all("run=m-20231101" in f for f in got.inputFiles())
    # comment lines stand before the header and at the end of each chain's file
    one = [p for p in (tmp_path / "runs" / "run=m-20231101" / "file=1").iterdir() if p.suffix == ".txt"]
    lines = one[0].read_text().splitlines()
    assert len(one) == 1 and lines[:3] == ["# method = sample", "# seed, 5", "chain,iteration,a,b"] and lines[-1] == "# done"
    by_function = files.sampler_draws(spark, f"{path}/run=m-20231101").drop("source_file")
    assert sorted(map(tuple, by_function.collect()), key=key) == sorted(want, key=key)
    assert files.latest_run(files.list_files(spark, path), files.run_of()).first().run == "m-20231101"


def test_pair_sums_equal_the_self_join(spark, monkeypatch):
    from pluvio.operators import copula, pairs, profile

    monkeypatch.setattr(pairs, "BLOCK_ENTRIES", 20)
    rows = [(k, v, float((k * 7 + ord(v)) % 11) / 11 + 1e6 * (v == "b")) for k in range(60) for v in "abcd" if (k + ord(v)) % 5]
    rows += [(None, "a", 0.5), (3, None, 0.5), (1, "a", float("nan")), (1, "e", None), (2, "b", 1e6), (5, "f", 1.0), (6, "f", 1.0)]
    df = spark.createDataFrame(rows, "k int, v string, x double").repartition(3)
    a = df.where("x is not null and not isnan(x)").select("k", F.col("v").alias("v1"), F.col("x").alias("x1"))
    b = a.select("k", F.col("v1").alias("v2"), F.col("x1").alias("x2"))
    want = {(r.v1, r.v2): r.c for r in a.join(b, "k").where("v1 != v2 and v1 != 'f' and v2 != 'f'").groupBy("v1", "v2").agg(F.corr("x1", "x2").alias("c")).collect()}
    got = {(r.var1, r.var2): r["corr"] for r in profile.correlation_long(df, "k", "v", "x").collect()}
    assert {p: c for p, c in got.items() if p[0] == p[1]} == dict.fromkeys([(x, x) for x in "abcdf"])
    constant = {p: c for p, c in got.items() if "f" in p and p != ("f", "f")}
    assert constant and set(constant.values()) == {None}
    assert {p for p in got if p[0] != p[1] and "f" not in p} == set(want)
    for p, c in want.items():
        assert abs(got[p] - c) < 1e-7, p
    u = df.withColumn("x", F.col("x") % 1.0).where("k is not null and v is not null and x is not null and not isnan(x)")
    up = u.alias("s").join(u.alias("t"), "k").where("s.v < t.v").groupBy("s.v", "t.v").agg(
        F.try_divide(F.sum(((F.col("s.x") > 0.7) & (F.col("t.x") > 0.7)).cast("int")), F.sum((F.col("s.x") > 0.7).cast("int"))).alias("c")
    )
    tails = copula.empirical_tail_dependence(df.withColumn("x", F.col("x") % 1.0), "k", "v", "x", 0.7).collect()
    assert {(r.i, r.j): r.lambda_upper for r in tails} == {(r[0], r[1]): r.c for r in up.collect()}
    assert profile.correlation_long(df.limit(0), "k", "v", "x").count() == 0
