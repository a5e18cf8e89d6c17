"""Sources, projections, joins, reshapes, sorts and text functions (S, P, J, R, T, U, F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pluvio.functions import dist, text
from pluvio.operators import blocks, joins, lattice, shape
from pluvio.plans.fixtures import EMBEDDING_SIZE, Fixtures
from pluvio.plans.oracle_fixtures import with_ctes
from pluvio.plans.registry import query
from pluvio.session import ensure_checkpoint_dir, materialize
from pluvio.sources import files, io

DRAW_NAMES = ["click", "error", "purchase", "signup", "view"]
YEARS = list(range(1995, 2002))


def _listing(fx: Fixtures):
    """Per-year newline-joined listings of the month files the data covers."""
    months = blocks.monthly_maxima(fx.hourly(), []).select("from_date")
    names = months.select(F.year("from_date").alias("year"), files.period_filename(F.col("from_date")).alias("fn"))
    return names.groupBy("year").agg(
        F.concat(F.array_join(F.array_sort(F.collect_list("fn")), "\n"), F.lit("\n")).alias("listing")
    )


_FILENAME_SQL = (
    "'pr_rcp85_land-cpm_uk_5km_01_1hr_' || strftime(from_date, '%Y%m%d') || '-' || "
    "strftime(from_date, '%Y%m') || '30' || '.nc'"
)


@query(
    "split_listing",
    "S1 F3",
    with_ctes(f"SELECT DISTINCT CAST(year(from_date) AS INTEGER) AS year, {_FILENAME_SQL} AS filename FROM monthly",
              "monthly"),
)
def split_listing(spark, sf):
    return files.split_listing(_listing(Fixtures(spark, sf)))


@query(
    "parse_period",
    "S2 F8",
    with_ctes(
        f"SELECT DISTINCT {_FILENAME_SQL} AS filename, from_date, "
        "CAST(from_date + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS to_date FROM monthly",
        "monthly",
    ),
)
def parse_period(spark, sf):
    names = files.split_listing(_listing(Fixtures(spark, sf))).select("filename")
    return files.parse_period(names)


@query(
    "latest_listing_file",
    "S12",
    with_ctes(
        f"SELECT CAST(year(from_date) AS INTEGER) AS year, max({_FILENAME_SQL}) AS filename FROM monthly GROUP BY 1",
        "monthly",
    ),
)
def latest_listing_file(spark, sf):
    names = files.split_listing(_listing(Fixtures(spark, sf)))
    return names.groupBy("year").agg(F.max("filename").alias("filename"))


@query(
    "scan_with_file",
    "S3 S7",
    "SELECT 'lineitem.parquet' AS source_file, l_suppkey AS station, count(*) AS n_rows, "
    "max(l_extendedprice) AS precip FROM lineitem GROUP BY l_suppkey",
)
def scan_with_file(spark, sf):
    df = files.scan_with_file(spark, f"{sf.rstrip('/')}/lineitem.parquet")
    return df.groupBy(
        F.regexp_extract("source_file", r"([^/]+)$", 1).alias("source_file"), F.col("l_suppkey").alias("station")
    ).agg(F.count(F.lit(1)).alias("n_rows"), F.max("l_extendedprice").alias("precip"))


@query(
    "grid_to_long",
    "S4 W1",
    with_ctes(
        "SELECT m.month, CAST(s.proj_x + 1 AS INTEGER) AS proj_x, CAST(s.proj_y + 1 AS INTEGER) AS proj_y, "
        "CAST(s.proj_y * 10 + s.proj_x + 1 AS INTEGER) AS station, p.precip "
        "FROM stations s CROSS JOIN (SELECT DISTINCT month FROM precip_month) m "
        "LEFT JOIN precip_month p ON p.station = s.station AND p.month = m.month",
        "stations", "precip_month",
    ),
)
def grid_to_long(spark, sf):
    """Month grids stored as one array per lattice row, back to long rows."""
    fx = Fixtures(spark, sf)
    pm = fx.precip_month()
    months = pm.select("month").distinct()
    cells = fx.stations().crossJoin(F.broadcast(months)).join(pm, ["station", "month"], "left")
    rows = cells.groupBy("month", (F.col("proj_y") + 1).alias("row")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("proj_x", "precip"))), lambda s: s["precip"]
        ).alias("values")
    )
    return files.grid_to_long(rows, "values", 10, row_col="row").select("month", "proj_x", "proj_y", "station", "precip")


@query("parquet_roundtrip", "S5 S6", with_ctes("SELECT station, year, precip FROM precip", "precip"))
def parquet_roundtrip(spark, sf):
    return materialize(Fixtures(spark, sf).precip(), "precip").select("station", "year", "precip")


@query("hive_partitioned_draws", "S8", with_ctes("SELECT chain, name, iteration, value FROM draws", "draws"))
def hive_partitioned_draws(spark, sf):
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid

    path = f"{base}/draws-{uuid.uuid4().hex[:12]}"
    io.write_parquet(Fixtures(spark, sf).draws(), path, partition_by=["chain"])
    return io.read_parquet(spark, path).select("chain", "name", "iteration", "value")


@query("csv_roundtrip", "S9 S10", with_ctes("SELECT station, proj_x, proj_y FROM stations", "stations"))
def csv_roundtrip(spark, sf):
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stations-{uuid.uuid4().hex[:12]}"
    io.write_csv(Fixtures(spark, sf).stations(), path)
    return io.read_csv(spark, path, "station bigint, proj_x bigint, proj_y bigint")


_DRAW_LINES_SQL = (
    "SELECT w.chain, w.iteration, n.name, d.value FROM (SELECT DISTINCT chain, iteration FROM draws) w "
    "CROSS JOIN (SELECT DISTINCT name FROM draws) n LEFT JOIN draws d "
    "ON d.chain = w.chain AND d.iteration = w.iteration AND d.name = n.name"
)


@query(
    "sampler_csv_long",
    "S11 R2",
    with_ctes(_DRAW_LINES_SQL, "draws"),
)
def sampler_csv_long(spark, sf):
    """Wide per-iteration draw CSV (one column per parameter) back to long rows."""
    import uuid

    wide = shape.pivot_wider(Fixtures(spark, sf).draws(), ["chain", "iteration"], "name", "value", DRAW_NAMES)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sampler-{uuid.uuid4().hex[:12]}"
    io.write_csv(wide, path)
    schema = "chain int, iteration bigint, " + ", ".join(f"{n} double" for n in DRAW_NAMES)
    return files.read_sampler_csv(spark, path, ["chain", "iteration"], schema)


def _sampler_runs(spark, sf) -> str:
    """A folder with two sampler runs, a file per chain: the earlier one has the draws' negatives, the later one the draws."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex[:12]}"
    wide = shape.pivot_wider(Fixtures(spark, sf).draws(), ["chain", "iteration"], "name", "value", DRAW_NAMES)
    earlier = wide.select("chain", "iteration", *[(-F.col(n)).alias(n) for n in DRAW_NAMES])
    for run, draws in (("icar-202311052017", earlier), ("icar-202311101530", wide)):
        files.write_sampler_csv(draws, path, run, "chain", "iteration", ["method = sample", f"id = {run}"])
    return path


@query("latest_run_draws", "S11 S12 R2", with_ctes(_DRAW_LINES_SQL, "draws"))
def latest_run_draws(spark, sf):
    """Two runs of sampler files with ``#`` lines; the later one alone is read."""
    schema = "chain int, iteration bigint, " + ", ".join(f"{n} double" for n in DRAW_NAMES)
    return files.read_latest_run(spark, _sampler_runs(spark, sf), ["chain", "iteration"], schema)


@query(
    "sampler_files_draws",
    "X4 S11",
    with_ctes(
        f"SELECT run, chain, iteration, name, sign * value AS value FROM ({_DRAW_LINES_SQL}) "
        "CROSS JOIN (VALUES ('icar-202311052017', -1), ('icar-202311101530', 1)) AS r(run, sign)",
        "draws",
    ),
)
def sampler_files_draws(spark, sf):
    """All files of both runs, one file in and its draws out by a table function."""
    draws = files.sampler_draws(spark, _sampler_runs(spark, sf))
    return draws.select(files.run_of("source_file").alias("run"), "chain", "iteration", "name", "value")


@query(
    "nested_estimates",
    "S13 R6 R7",
    with_ctes(
        "SELECT station, name, round(value, 9) AS value FROM (UNPIVOT params ON psi, tau, phi, gamma "
        "INTO NAME name VALUE value)",
        "params",
    ),
)
def nested_estimates(spark, sf):
    long = shape.pivot_longer(Fixtures(spark, sf).params(), ["station"], ["psi", "tau", "phi", "gamma"], "name", "value")
    nested = materialize(io.nest_estimates(long), "estimates")
    return io.unnest_estimates(nested).select("station", "name", F.round("value", 9).alias("value"))


@query(
    "sql_view",
    "S14",
    with_ctes(
        "SELECT station, count(*) AS n_years, max(precip) AS precip FROM precip GROUP BY station", "precip"
    ),
)
def sql_view(spark, sf):
    io.to_sql_view(Fixtures(spark, sf).precip(), "precip_view")
    return spark.sql("SELECT station, count(*) AS n_years, max(precip) AS precip FROM precip_view GROUP BY station")


@query(
    "literal_offsets",
    "S15 J6 G1 J10",
    with_ctes(
        "SELECT o.type, o.diff_x, o.diff_y, count(e.station) AS n_edges FROM offsets o "
        "LEFT JOIN edges e ON e.type = o.type GROUP BY o.type, o.diff_x, o.diff_y",
        "edges", "offsets",
    ),
)
def literal_offsets(spark, sf):
    fx = Fixtures(spark, sf)
    per_type = fx.edges().groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))
    return (
        F.broadcast(fx.offsets())
        .join(per_type, "type", "left")
        .select("type", "diff_x", "diff_y", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
    )


# ---------------------------------------------------------------------------
# Projections and filters
# ---------------------------------------------------------------------------

_TRANSFORMED_SQL = (
    "SELECT station, exp(psi) AS mu0, exp(psi + tau) AS sigma, {xi} AS xi, {delta} AS delta FROM params"
)


def _transformed_sql():
    from pluvio.functions import sqltext as S

    return _TRANSFORMED_SQL.format(xi=S.shape_link_inverse("phi"), delta=S.trend_link_inverse("gamma"))


def transformed_params(fx: Fixtures):
    p = fx.params()
    t = p.withColumns(
        {
            "mu0": dist.location_from_psi("psi"),
            "sigma": dist.scale_from_psi_tau("psi", "tau"),
            "xi": dist.shape_link_inverse("phi"),
            "delta": dist.trend_link_inverse("gamma"),
        }
    )
    return shape.drop_range(t, "psi", "gamma")


@query(
    "transformed_params",
    "P1 P5 E5 E6 E7",
    with_ctes(
        "SELECT station, round(mu0, 3) AS mu0, round(sigma, 3) AS sigma, round(xi, 9) + 0.0 AS xi, "
        f"round(delta, 9) + 0.0 AS delta FROM ({_transformed_sql()})",
        "params",
    ),
)
def q_transformed_params(spark, sf):
    t = transformed_params(Fixtures(spark, sf))
    return t.select(
        "station", F.round("mu0", 3).alias("mu0"), F.round("sigma", 3).alias("sigma"),
        F.round("xi", 9).alias("xi"), F.round("delta", 9).alias("delta"),
    )


@query(
    "relocate_rename",
    "P2 P3",
    with_ctes("SELECT proj_y AS row_index, proj_x, station AS cell FROM stations", "stations"),
)
def relocate_rename(spark, sf):
    s = shape.relocate(Fixtures(spark, sf).stations(), ["proj_y", "proj_x"])
    return shape.rename_positions(s, {3: "cell"}).withColumnsRenamed({"proj_y": "row_index"})


@query(
    "clean_names",
    "P4 R1 R5",
    with_ctes(
        "SELECT chain, iteration, "
        + ", ".join(f"max(CASE WHEN name = '{n}' THEN value END) AS draw_{n}" for n in DRAW_NAMES)
        + " FROM draws GROUP BY chain, iteration",
        "draws",
    ),
)
def clean_names(spark, sf):
    wide = shape.pivot_wider(Fixtures(spark, sf).draws(), ["chain", "iteration"], "name", "value", DRAW_NAMES,
                             prefix="Draw.")
    wide = wide.withColumnsRenamed({"chain": ".Chain", "iteration": ".Iteration"})
    return text.clean_names(wide)


@query(
    "mutate_at_round",
    "P6",
    with_ctes("SELECT station, round(psi, 3) AS psi, round(tau, 3) AS tau, phi, gamma FROM params", "params"),
)
def mutate_at_round(spark, sf):
    p = Fixtures(spark, sf).params()
    return p.withColumns({c: F.round(c, 3) for c in ["psi", "tau"]})


@query(
    "filter_box",
    "P7 P8 P10",
    with_ctes(
        "SELECT p.station, p.year, p.precip FROM precip p JOIN stations s ON s.station = p.station "
        "WHERE s.proj_x BETWEEN 2 AND 7 AND p.year IN (1996, 1998, 2000) AND p.precip > 50000",
        "precip", "stations",
    ),
)
def filter_box(spark, sf):
    fx = Fixtures(spark, sf)
    box = fx.stations().filter(F.col("proj_x").between(2, 7)).select("station")
    p = fx.precip().filter(F.col("year").isin(1996, 1998, 2000) & (F.col("precip") > 50000))
    return p.join(box, "station", "left_semi").select("station", "year", "precip")


@query(
    "filter_semi_keys",
    "P9 J4",
    with_ctes(
        "SELECT chain, name, count(*) AS n FROM draws WHERE name IN "
        "(SELECT name FROM draws GROUP BY name HAVING avg(value) > (SELECT avg(value) FROM draws)) "
        "GROUP BY chain, name",
        "draws",
    ),
)
def filter_semi_keys(spark, sf):
    d = Fixtures(spark, sf).draws()
    overall = d.agg(F.avg("value").alias("_all"))
    keys = (
        d.groupBy("name").agg(F.avg("value").alias("_m")).crossJoin(F.broadcast(overall))
        .filter(F.col("_m") > F.col("_all")).select("name")
    )
    return joins.semi(d, keys, "name").groupBy("chain", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "regex_filter",
    "P11 F3 F4",
    "SELECT event_type, count(*) AS n, "
    "sum(CAST(regexp_extract(props, '-?[0-9]+(\\.[0-9]+)?', 0) AS DOUBLE)) AS k_sum, "
    "CAST(sum(len(regexp_extract_all(props, '[0-9]'))) AS BIGINT) AS n_digits "
    "FROM events WHERE regexp_matches(event_type, '^(cl|vi|pu)') GROUP BY event_type",
)
def regex_filter(spark, sf):
    ev = Fixtures(spark, sf).table("events").filter(F.col("event_type").rlike("^(cl|vi|pu)"))
    return ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(text.parse_number("props")).alias("k_sum"),
        F.sum(F.size(F.regexp_extract_all("props", F.lit("([0-9])"), 1))).cast("bigint").alias("n_digits"),
    )


@query(
    "finite_filters",
    "P12 P13",
    with_ctes(
        "SELECT station, round(ratio, 9) AS ratio, round(tau, 9) AS tau FROM "
        "(SELECT station, psi / phi AS ratio, tau FROM params) WHERE "
        "ratio IS NOT NULL AND NOT isnan(ratio) AND abs(ratio) < 'Infinity'::DOUBLE AND "
        "tau IS NOT NULL AND NOT isnan(tau) AND abs(tau) < 'Infinity'::DOUBLE",
        "params",
    ),
)
def finite_filters(spark, sf):
    p = Fixtures(spark, sf).params().select("station", F.try_divide("psi", "phi").alias("ratio"), "tau")
    return shape.filter_finite(p).select("station", F.round("ratio", 9).alias("ratio"), F.round("tau", 9).alias("tau"))


_PAIRS_MONTH_SQL = (
    "SELECT e.station, e.type, y.month, y.precip AS y, x.precip AS x FROM edges e "
    "JOIN precip_month y ON y.station = e.station "
    "LEFT JOIN precip_month x ON x.station = e.neighbor AND x.month = y.month"
)


@query(
    "drop_incomplete",
    "P14",
    with_ctes(
        "SELECT station, type, count(*) AS n FROM pairs p WHERE NOT EXISTS "
        "(SELECT 1 FROM pairs q WHERE q.x IS NULL AND q.station = p.station AND q.type = p.type) "
        "GROUP BY station, type",
        "edges", "precip_month", extra=[("pairs", _PAIRS_MONTH_SQL)],
    ),
)
def drop_incomplete(spark, sf):
    fx = Fixtures(spark, sf)
    pm = fx.precip_month()
    y = pm.select("station", "month", F.col("precip").alias("y"))
    x = pm.select(F.col("station").alias("neighbor"), "month", F.col("precip").alias("x"))
    pairs = fx.edges().join(y, "station").join(x, ["neighbor", "month"], "left")
    kept = shape.drop_incomplete_groups(pairs, ["station", "type"], "x")
    return kept.groupBy("station", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_global_min",
    "P15",
    with_ctes(
        "SELECT station, count(*) AS n FROM precip WHERE precip > (SELECT min(precip) FROM precip) GROUP BY station",
        "precip",
    ),
)
def filter_global_min(spark, sf):
    p = shape.filter_vs_global(Fixtures(spark, sf).precip(), "precip", "min", ">")
    return p.groupBy("station").agg(F.count(F.lit(1)).alias("n"))


@query(
    "distinct_counts",
    "P16 A7 A10",
    with_ctes(
        "SELECT station, count(DISTINCT year) AS n_years, count(*) AS n_rows, "
        "count(DISTINCT floor(precip / 10000)) AS n_levels FROM hourly_y GROUP BY station",
        "hourly",
        extra=[("hourly_y", "SELECT station, CAST(year(ts) AS INTEGER) AS year, precip FROM hourly")],
    ),
)
def distinct_counts(spark, sf):
    h = Fixtures(spark, sf).hourly().select("station", F.year("ts").alias("year"), "precip")
    return h.groupBy("station").agg(
        F.countDistinct("year").alias("n_years"),
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(F.floor(F.col("precip") / 10000)).alias("n_levels"),
    )


# Season bins by calendar month and a per-index label array.
SEASON_LABELS = ["winter", "spring", "summer", "autumn"]


@query(
    "period_bins",
    "P17 P18",
    with_ctes(
        "SELECT station, month, CASE WHEN month % 100 IN (12, 1, 2) THEN 'winter' "
        "WHEN month % 100 IN (3, 4, 5) THEN 'spring' WHEN month % 100 IN (6, 7, 8) THEN 'summer' "
        "ELSE 'autumn' END AS season, "
        "(['winter', 'spring', 'summer', 'autumn'])[CAST((month % 100) % 12 // 3 + 1 AS INTEGER)] AS season_idx, "
        "CASE WHEN precip >= 50000 THEN 'high' ELSE NULL END AS label FROM precip_month",
        "precip_month",
    ),
)
def period_bins(spark, sf):
    pm = Fixtures(spark, sf).precip_month()
    m = F.col("month") % 100
    season = (
        F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring")
        .when(m.isin(6, 7, 8), "summer").otherwise("autumn")
    )
    idx = (F.floor((m % 12) / 3) + 1).cast("int")
    labels = F.array(*[F.lit(s) for s in SEASON_LABELS])
    return pm.select(
        "station", "month", season.alias("season"), F.element_at(labels, idx).alias("season_idx"),
        F.when(F.col("precip") >= 50000, F.lit("high")).otherwise(F.lit(None)).alias("label"),
    )


# Display order and labels of the draw names.
NAME_LEVELS = ["view", "click", "purchase", "signup", "error"]
NAME_LABELS = {"view": "Viewed", "click": "Clicked", "purchase": "Bought"}


@query(
    "ordered_categories",
    "P19",
    with_ctes(
        "SELECT name, CASE name WHEN 'view' THEN 'Viewed' WHEN 'click' THEN 'Clicked' "
        "WHEN 'purchase' THEN 'Bought' ELSE name END AS label, "
        "CAST(CASE name WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 "
        "WHEN 'error' THEN 5 ELSE 6 END AS INTEGER) AS level, "
        "CAST(dense_rank() OVER (ORDER BY round(mean, 9), name) AS INTEGER) AS rank_by_mean, round(mean, 9) AS mean "
        "FROM (SELECT name, avg(value) AS mean FROM draws GROUP BY name)",
        "draws",
    ),
)
def ordered_categories(spark, sf):
    m = Fixtures(spark, sf).draw_values().groupBy("name").agg(F.round(F.avg("value"), 9).alias("mean"))
    return m.select(
        "name",
        text.recode("name", NAME_LABELS).alias("label"),
        text.ordered_levels("name", NAME_LEVELS).cast("int").alias("level"),
        # one row per name: the window runs over a handful of rows
        F.dense_rank().over(Window.orderBy("mean", "name")).alias("rank_by_mean"),
        "mean",
    )


@query(
    "tagged_union",
    "U1 P20",
    with_ctes(
        "SELECT station, year, precip, NULL::DOUBLE AS max_precip, 'year' AS source FROM precip "
        "UNION ALL SELECT station, NULL::INTEGER AS year, NULL::DOUBLE AS precip, max(precip) AS max_precip, "
        "'station' AS source FROM precip GROUP BY station",
        "precip",
    ),
)
def tagged_union(spark, sf):
    p = Fixtures(spark, sf).precip()
    a = shape.tag(p, "source", "year")
    b = shape.tag(p.groupBy("station").agg(F.max("precip").alias("max_precip")), "source", "station")
    return shape.bind_rows(a, b)


# ---------------------------------------------------------------------------
# Joins
# ---------------------------------------------------------------------------


@query(
    "neighbour_pairs",
    "J2 J5 T1",
    with_ctes(
        "SELECT y.year, e.station, e.neighbor, y.precip AS y, x.precip AS x, e.type FROM edges e "
        "JOIN precip y ON y.station = e.station JOIN precip x ON x.station = e.neighbor AND x.year = y.year",
        "edges", "precip",
    ),
)
def neighbour_pairs(spark, sf):
    fx = Fixtures(spark, sf)
    pairs = lattice.neighbour_pairs(fx.precip(), fx.edges(), ["year"], "precip")
    return pairs.select("year", "station", "neighbor", "y", "x", "type").orderBy("station", "year", "neighbor")


@query(
    "restrict_renumber",
    "G2 J4 J7",
    with_ctes(
        "SELECT a.new_name AS station, b.new_name AS neighbor, e.type FROM edges e "
        "JOIN nn a ON a.station = e.station JOIN nn b ON b.station = e.neighbor",
        "edges", "stations",
        extra=[("nn", "SELECT station, row_number() OVER (ORDER BY station) AS new_name "
                      "FROM stations WHERE proj_x BETWEEN 2 AND 7")],
    ),
)
def restrict_renumber(spark, sf):
    fx = Fixtures(spark, sf)
    keep = fx.stations().filter(F.col("proj_x").between(2, 7))
    e, _ = lattice.restrict_and_renumber(fx.edges(), keep)
    return e.select("station", "neighbor", "type")


@query(
    "crossing_grid",
    "J8",
    with_ctes(
        "SELECT y.year, o.type, count(e.station) AS n_edges FROM (SELECT DISTINCT year FROM precip) y "
        "CROSS JOIN offsets o LEFT JOIN edges e ON e.type = o.type GROUP BY y.year, o.type",
        "precip", "offsets", "edges",
    ),
)
def crossing_grid(spark, sf):
    fx = Fixtures(spark, sf)
    grid = joins.crossing(fx.precip().select("year"), fx.offsets().select("type"))
    per_type = fx.edges().groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))
    return grid.join(F.broadcast(per_type), "type", "left").select(
        "year", "type", F.coalesce("n_edges", F.lit(0)).alias("n_edges")
    )


@query(
    "expand_grid",
    "J9",
    with_ctes(
        "SELECT s.station, r.replicate FROM stations s CROSS JOIN "
        "(SELECT CAST(x AS INTEGER) AS replicate FROM (VALUES (1), (2), (2), (3)) t(x)) r",
        "stations",
    ),
)
def expand_grid(spark, sf):
    reps = spark.createDataFrame([(1,), (2,), (2,), (3,)], "replicate int")
    return joins.expand_grid(Fixtures(spark, sf).stations().select("station"), reps)


@query(
    "undirected_edges",
    "J11 G1",
    with_ctes(
        "SELECT type, count(*) AS n FROM edges WHERE neighbor > station GROUP BY type", "edges"
    ),
)
def undirected_edges(spark, sf):
    return lattice.undirected(Fixtures(spark, sf).edges()).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Reshape
# ---------------------------------------------------------------------------


@query(
    "pivot_wider_years",
    "R1 R5",
    with_ctes(
        "SELECT station, "
        + ", ".join(f"max(CASE WHEN year = {y} THEN precip END) AS y{y}" for y in YEARS)
        + " FROM precip GROUP BY station",
        "precip",
    ),
)
def pivot_wider_years(spark, sf):
    return shape.pivot_wider(Fixtures(spark, sf).precip(), ["station"], "year", "precip", YEARS, prefix="y")


@query(
    "pivot_longer_years",
    "R2 R4",
    with_ctes(
        "SELECT s.station, y.year, p.precip FROM (SELECT DISTINCT station FROM precip) s "
        f"CROSS JOIN (SELECT CAST(x AS INTEGER) AS year FROM range({YEARS[0]}, {YEARS[-1] + 1}) t(x)) y "
        "LEFT JOIN precip p ON p.station = s.station AND p.year = y.year",
        "precip",
    ),
)
def pivot_longer_years(spark, sf):
    wide = shape.pivot_wider(Fixtures(spark, sf).precip(), ["station"], "year", "precip", YEARS, prefix="y")
    long = shape.pivot_longer(wide, ["station"], None, "name", "precip")
    return long.select("station", F.regexp_extract("name", r"([0-9]+)", 1).cast("int").alias("year"), "precip")


@query(
    "row_vectors",
    "R8",
    with_ctes(
        "SELECT vec_id, " + ", ".join(f"max(CASE WHEN dim = {d} THEN x END) AS x_{d}" for d in range(1, EMBEDDING_SIZE + 1))
        + " FROM vectors GROUP BY vec_id",
        "vectors",
    ),
)
def row_vectors(spark, sf):
    rows = shape.row_vectors(Fixtures(spark, sf).vectors(), "vec_id", "dim", "x")
    return rows.select("vec_id", *[F.element_at("x", d).alias(f"x_{d}") for d in range(1, EMBEDDING_SIZE + 1)])


# ---------------------------------------------------------------------------
# Sort / limit / sample
# ---------------------------------------------------------------------------


@query(
    "first_k_per_group",
    "T4",
    with_ctes(
        "SELECT station, year, precip FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY year) AS rn "
        "FROM precip) WHERE rn <= 2",
        "precip",
    ),
)
def first_k_per_group(spark, sf):
    # the window is per station over its years: bounded by the number of years
    w = Window.partitionBy("station").orderBy("year")
    p = Fixtures(spark, sf).precip()
    return p.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2).drop("_rn")


# Knuth's multiplicative hash constant and the sample seed.
KNUTH = 2654435761
SAMPLE_SEED = 20240601


@query(
    "sample_keys",
    "T5",
    with_ctes(
        "SELECT station, year, precip FROM precip WHERE station IN (SELECT station FROM "
        f"(SELECT DISTINCT station FROM precip) ORDER BY (station * {KNUTH} + {SAMPLE_SEED}) % 4294967296, station LIMIT 3)",
        "precip",
    ),
)
def sample_keys(spark, sf):
    """Three stations picked by a seeded multiplicative-hash order, with all
    their rows (the hash is plain integer arithmetic, so any engine agrees)."""
    p = Fixtures(spark, sf).precip()
    h = (F.col("station") * KNUTH + SAMPLE_SEED) % 4294967296
    keys = p.select("station").distinct().orderBy(h, "station").limit(3)
    return p.join(F.broadcast(keys), "station", "left_semi").select("station", "year", "precip")


@query(
    "thin_draws",
    "T6 D6",
    with_ctes(
        "SELECT chain, name, count(*) AS n, max(iteration) AS max_iteration FROM draws "
        "WHERE iteration <= 100 AND chain IN (1, 2) GROUP BY chain, name",
        "draws",
    ),
)
def thin_draws(spark, sf):
    d = Fixtures(spark, sf).draws().filter((F.col("iteration") <= 100) & F.col("chain").isin(1, 2))
    return d.groupBy("chain", "name").agg(F.count(F.lit(1)).alias("n"), F.max("iteration").alias("max_iteration"))


@query(
    "listing_page",
    "T7",
    "SELECT doc_id, source AS category, lang FROM documents ORDER BY doc_id DESC LIMIT 10 OFFSET 10",
)
def listing_page(spark, sf):
    c = Fixtures(spark, sf).catalogue()
    return c.orderBy(F.col("newest").desc(), "doc_id").offset(10).limit(10).select("doc_id", "category", "lang")


@query(
    "listing_categories",
    "T7",
    "SELECT source AS category, count(*) AS n FROM documents GROUP BY source",
)
def listing_categories(spark, sf):
    return Fixtures(spark, sf).catalogue().groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Scalar functions
# ---------------------------------------------------------------------------


@query(
    "text_functions",
    "F1 F2 F3 F4 F12",
    with_ctes(
        "SELECT chain, name, label, regexp_extract(label, '^([^\\[]+)', 1) AS variable, "
        "CAST(regexp_extract(label, '\\[([0-9]+)\\]', 1) AS INTEGER) AS idx, "
        "regexp_replace(name, 'i', 'I') AS first_upper, n "
        "FROM (SELECT chain, name, name || '[' || CAST(chain AS VARCHAR) || ']' AS label, count(*) AS n "
        "FROM draws GROUP BY chain, name)",
        "draws",
    ),
)
def text_functions(spark, sf):
    d = Fixtures(spark, sf).draw_values().groupBy("chain", "name").agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumn("label", F.concat(F.col("name"), F.lit("["), F.col("chain").cast("string"), F.lit("]")))
    var, idx = text.bracket_index("label")
    return d.select(
        "chain", "name", "label", var.alias("variable"), idx.alias("idx"),
        text.replace_first("name", "i", "I").alias("first_upper"), "n",
    )


@query(
    "math_functions",
    "F9 F10 F11",
    with_ctes(
        "SELECT station, round(sqrt(abs(psi)), 9) AS root_abs_psi, round(pow(exp(tau), 2), 9) AS var_ratio, "
        f"round(1.0 / (1.0 + exp(-phi)), 9) AS inv_logit_phi, "
        f"round(exp(10.0 * {{delta}}) - 1.0, 9) AS decade_change, "
        "round(greatest(psi, 5.0), 9) AS psi_floor FROM params",
        "params",
    ).replace("{delta}", "(0.008 * tanh(gamma / 0.008))"),
)
def math_functions(spark, sf):
    p = Fixtures(spark, sf).params()
    return p.select(
        "station",
        F.round(F.sqrt(F.abs("psi")), 9).alias("root_abs_psi"),
        F.round(F.pow(F.exp("tau"), 2), 9).alias("var_ratio"),
        F.round(dist.inv_logit("phi"), 9).alias("inv_logit_phi"),
        F.round(dist.decade_change(dist.trend_link_inverse("gamma")), 9).alias("decade_change"),
        F.round(F.greatest(F.col("psi"), F.lit(5.0)), 9).alias("psi_floor"),
    )
