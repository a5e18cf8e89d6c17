"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver) and timed; one JSON line is printed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pluvio.plans.catalog import REGISTRY  # noqa: E402
from pluvio.session import build_session  # noqa: E402

HEADLINE = [
    "monthly_maxima",
    "yearly_maxima",
    "neighbour_pairs",
    "gev_scores",
    "station_loglik",
    "qq_table",
    "t_scores",
    "gaussian_copula",
    "heldout_lpd",
    "univariate_ols",
    "local_moran",
    "summarise_draws",
    "rhat",
    "autocorrelation",
    "income_report",
    "forest_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", app_name="pluvio-bench")
    # warm-up: JVM, codegen caches and file listing
    REGISTRY["yearly_maxima"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
