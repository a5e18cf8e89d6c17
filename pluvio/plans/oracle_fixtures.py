"""The FIXTURES.md part-2 tables as DuckDB common table expressions.

``with_ctes(body, *names)`` prepends the named CTEs and everything they
depend on, in dependency order.
"""

from __future__ import annotations

from pluvio.operators.lattice import NEIGHBOR_OFFSETS

_OFFSETS_VALUES = ", ".join(f"('{t}', {dx}, {dy})" for t, dx, dy in NEIGHBOR_OFFSETS)

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "stations": (
        "SELECT s_suppkey AS station, s_suppkey % 10 AS proj_x, s_suppkey // 10 AS proj_y FROM supplier",
        (),
    ),
    "offsets": (
        f"SELECT type, CAST(diff_x AS BIGINT) AS diff_x, CAST(diff_y AS BIGINT) AS diff_y "
        f"FROM (VALUES {_OFFSETS_VALUES}) AS o(type, diff_x, diff_y)",
        (),
    ),
    "edges": (
        "SELECT s.station, n.station AS neighbor, o.type FROM stations s CROSS JOIN offsets o "
        "JOIN stations n ON n.proj_x = s.proj_x + o.diff_x AND n.proj_y = s.proj_y + o.diff_y",
        ("stations", "offsets"),
    ),
    "rook_edges": (
        "SELECT * FROM edges WHERE type IN ('n', 's', 'e', 'w')",
        ("edges",),
    ),
    "hourly": (
        "SELECT l_suppkey AS station, l_shipdate AS ts, l_extendedprice AS precip FROM lineitem",
        (),
    ),
    "monthly": (
        "SELECT station, CAST(date_trunc('month', ts) AS DATE) AS from_date, max(precip) AS precip, "
        "CAST(date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS to_date "
        "FROM hourly GROUP BY station, date_trunc('month', ts)",
        ("hourly",),
    ),
    "precip": (
        "SELECT station, CAST(year(ts) AS INTEGER) AS year, max(precip) AS precip FROM hourly GROUP BY 1, 2",
        ("hourly",),
    ),
    "precip_month": (
        "SELECT station, CAST(year(ts) * 100 + month(ts) AS INTEGER) AS month, max(precip) AS precip "
        "FROM hourly GROUP BY 1, 2",
        ("hourly",),
    ),
    "params": (
        "SELECT station, ln(avg(precip)) AS psi, ln(stddev_samp(precip) / avg(precip)) AS tau, "
        "CAST(station % 5 - 2 AS DOUBLE) * 0.02 AS phi, CAST(station % 7 - 3 AS DOUBLE) * 0.0005 AS gamma "
        "FROM precip GROUP BY station",
        ("precip",),
    ),
    "draws": (
        "SELECT CAST(event_id % 4 + 1 AS INTEGER) AS chain, event_type AS name, "
        "row_number() OVER (PARTITION BY event_id % 4 + 1, event_type ORDER BY event_id) "
        "AS iteration, value FROM events",
        (),
    ),
    "vectors": (
        "SELECT vec_id, CAST(unnest(range(1, len(embedding) + 1)) AS INTEGER) AS dim, "
        "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
        (),
    ),
    "income": (
        "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS age, o_totalprice AS income "
        "FROM orders JOIN customer ON o_custkey = c_custkey",
        (),
    ),
}


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_ctes(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` the named fixture CTEs (plus ``extra`` (name, sql) pairs) ``body``."""
    parts = [f"{n} AS ({CTES[n][0]})" for n in _order(names)]
    parts += [f"{n} AS ({q})" for n, q in (extra or [])]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


def rnd(expr: str, digits: int) -> str:
    """round() for the oracle; ``+ 0.0`` turns DuckDB's -0.0 into 0.0 as Spark's round does."""
    return f"(round({expr}, {digits}) + 0.0)"
