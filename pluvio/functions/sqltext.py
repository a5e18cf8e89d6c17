"""SQL text for the same formulas as ``functions.dist``, for the DuckDB oracle.

Built from the same constants, written independently of the Column code so
the oracle checks the Spark expressions rather than echoing them.  Arguments
are SQL expressions (strings); results are parenthesised SQL expressions.
Only functions both DuckDB and ANSI SQL know are used (no log1p / expm1).
"""

from __future__ import annotations

import math

from pluvio.functions import dist as D


def _f(x: float) -> str:
    return repr(float(x))


def _horner(coefs: list[float], x: str) -> str:
    out = _f(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {_f(c)})"
    return out


def norm_cdf(x: str) -> str:
    ax = f"abs({x})"
    e = f"exp(-({ax}) * ({ax}) / 2.0)"
    inner = f"({e} * {_horner(D.HART_NUM, ax)} / {_horner(D.HART_DEN, ax)})"
    cf = f"({ax} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = f"({ax} + {k} / {cf})"
    outer = f"({e} / {cf} / {_f(D.SQRT_2PI)})"
    tail = (
        f"(CASE WHEN {ax} > {D.HART_CUTOFF} THEN 0.0 WHEN {ax} < {_f(D.HART_SPLIT)} "
        f"THEN {inner} ELSE {outer} END)"
    )
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) > 0 THEN 1.0 - {tail} ELSE {tail} END)"


def norm_ppf(p: str) -> str:
    q = f"(({p}) - 0.5)"
    r0 = f"(0.180625 - {q} * {q})"
    central = f"({q} * {_horner(D.AS241_A, r0)} / {_horner(D.AS241_B, r0)})"
    r = f"sqrt(-ln(least(({p}), 1.0 - ({p}))))"
    rm = f"({r} - 1.6)"
    rf = f"({r} - 5.0)"
    mid = f"({_horner(D.AS241_C, rm)} / {_horner(D.AS241_D, rm)})"
    far = f"({_horner(D.AS241_E, rf)} / {_horner(D.AS241_F, rf)})"
    tail = f"(CASE WHEN {r} <= 5.0 THEN {mid} ELSE {far} END)"
    return (
        f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN abs({q}) <= 0.425 THEN {central} "
        f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"
    )


def t_cdf(x: str, nu: int) -> str:
    if nu == 1:
        return f"(0.5 + atan({x}) / {_f(math.pi)})"
    if nu == 2:
        return f"(0.5 + ({x}) / (2.0 * sqrt(2.0 + ({x}) * ({x}))))"
    if nu == 3:
        s = f"(({x}) / {_f(math.sqrt(3.0))})"
        return f"(0.5 + (atan({s}) + {s} / (1.0 + {s} * {s})) / {_f(math.pi)})"
    raise ValueError(nu)


def t_logpdf(x: str, nu: float) -> str:
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    return f"({_f(const)} - {_f((nu + 1) / 2.0)} * ln(1.0 + ({x}) * ({x}) / {_f(nu)}))"


def t3_ppf_steps(p: str) -> list[tuple[str, str]]:
    """The nu = 3 quantile as a list of (alias, expression) steps.

    Newton iterates reference the previous alias, so the oracle nests them
    as sub-selects instead of repeating text.
    """
    pi = _f(math.pi)
    steps = [("t3_g", f"abs({pi} * (({p}) - 0.5))")]
    start = (
        f"CASE WHEN t3_g < 1.0 THEN t3_g / 2.0 ELSE {_f(math.pi / 2)} - "
        f"pow(1.5 * ({_f(math.pi / 2)} - t3_g), {_f(1.0 / 3.0)}) END"
    )
    steps.append(("t3_th0", start))
    for i in range(D.T3_NEWTON_STEPS):
        prev = f"t3_th{i}"
        steps.append(
            (f"t3_th{i + 1}", f"{prev} - ({prev} + 0.5 * sin(2.0 * {prev}) - t3_g) / (1.0 + cos(2.0 * {prev}))")
        )
    last = f"t3_th{D.T3_NEWTON_STEPS}"
    steps.append(
        (
            "t3_val",
            f"CASE WHEN ({p}) IS NULL OR ({p}) <= 0 OR ({p}) >= 1 THEN NULL "
            f"WHEN ({p}) < 0.5 THEN -{_f(math.sqrt(3.0))} * tan({last}) "
            f"ELSE {_f(math.sqrt(3.0))} * tan({last}) END",
        )
    )
    return steps


def t_ppf_closed(p: str, nu: int) -> str:
    if nu == 1:
        out = f"tan({_f(math.pi)} * (({p}) - 0.5))"
    elif nu == 2:
        out = f"((2.0 * ({p}) - 1.0) / sqrt(2.0 * ({p}) * (1.0 - ({p}))))"
    else:
        raise ValueError(nu)
    return f"(CASE WHEN ({p}) IS NULL OR ({p}) <= 0 OR ({p}) >= 1 THEN NULL ELSE {out} END)"


def nest_steps(base_sql: str, keep: str, steps: list[tuple[str, str]]) -> str:
    """A query over ``base_sql`` adding each step as a column of its own
    materialised CTE, so iterates are computed once rather than inlined.

    ``keep`` is the column list carried from the base (e.g. ``*``).
    """
    ctes = [f"s_base AS MATERIALIZED (SELECT {keep} FROM ({base_sql}) AS b)"]
    prev = "s_base"
    for alias, expr in steps:
        ctes.append(f"s_{alias} AS MATERIALIZED (SELECT *, {expr} AS {alias} FROM {prev})")
        prev = f"s_{alias}"
    return "WITH " + ", ".join(ctes) + f" SELECT * FROM {prev}"


def exp_cdf(x: str, lam: str) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN 0.0 ELSE 1.0 - exp(-({lam}) * ({x})) END)"


def exp_pdf(x: str, lam: str) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN 0.0 ELSE ({lam}) * exp(-({lam}) * ({x})) END)"


def exp_logpdf(x: str, lam: str) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN NULL ELSE ln({lam}) - ({lam}) * ({x}) END)"


def exp_ppf(u: str, lam: str) -> str:
    return f"(-ln(1.0 - ({u})) / ({lam}))"


def gev_cdf(y: str, mu: str, sigma: str, xi: str) -> str:
    z = f"((({y}) - ({mu})) / ({sigma}))"
    t = f"(1.0 + ({xi}) * {z})"
    return (
        f"(CASE WHEN abs({xi}) < {_f(D.GUMBEL_EPS)} THEN exp(-exp(-{z})) "
        f"WHEN {t} <= 0 THEN (CASE WHEN ({xi}) > 0 THEN 0.0 ELSE 1.0 END) "
        f"ELSE exp(-pow({t}, -1.0 / ({xi}))) END)"
    )


def gev_logpdf(y: str, mu: str, sigma: str, xi: str) -> str:
    z = f"((({y}) - ({mu})) / ({sigma}))"
    t = f"(1.0 + ({xi}) * {z})"
    return (
        f"(CASE WHEN abs({xi}) < {_f(D.GUMBEL_EPS)} THEN -ln({sigma}) - {z} - exp(-{z}) "
        f"WHEN {t} <= 0 THEN NULL "
        f"ELSE -ln({sigma}) - (1.0 + 1.0 / ({xi})) * ln({t}) - pow({t}, -1.0 / ({xi})) END)"
    )


def gev_quantile(p: str, mu: str, sigma: str, xi: str) -> str:
    lp = f"(-ln({p}))"
    return (
        f"(CASE WHEN abs({xi}) < {_f(D.GUMBEL_EPS)} THEN ({mu}) - ({sigma}) * ln({lp}) "
        f"ELSE ({mu}) + ({sigma}) * (pow({lp}, -({xi})) - 1.0) / ({xi}) END)"
    )


def trend_location(mu0: str, delta: str, t: str, t0=D.TREND_T0) -> str:
    return f"(({mu0}) * (1.0 + ({delta}) * (({t}) - ({t0}))))"


def shape_link_inverse(phi: str, c: float = D.SHAPE_LINK_C) -> str:
    a, b = D.shape_link_constants(c)
    return f"(pow(1.0 - exp(-exp((({phi}) - {_f(a)}) / {_f(b)})), {_f(1.0 / c)}) - 0.5)"


def shape_link(xi: str, c: float = D.SHAPE_LINK_C) -> str:
    a, b = D.shape_link_constants(c)
    return f"({_f(a)} + {_f(b)} * ln(-ln(1.0 - pow(({xi}) + 0.5, {_f(c)}))))"


def trend_link_inverse(gamma: str, d0: float = D.TREND_LINK_D0) -> str:
    return f"({_f(d0)} * tanh(({gamma}) / {_f(d0)}))"


def trend_link(delta: str, d0: float = D.TREND_LINK_D0) -> str:
    return f"(0.5 * {_f(d0)} * (ln({_f(d0)} + ({delta})) - ln({_f(d0)} - ({delta}))))"


def inv_logit(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def is_finite(x: str) -> str:
    return f"(({x}) IS NOT NULL AND NOT isnan({x}) AND abs({x}) < 'Infinity'::DOUBLE)"


def t_cdf_int(x: str, nu: str) -> str:
    """Integer-nu Student-t CDF by the same finite series, with the series
    coefficients in closed form through lgamma (DuckDB lists)."""
    th = f"atan(abs({x}) / sqrt(CAST({nu} AS DOUBLE)))"
    c2 = f"(cos({th}) * cos({th}))"
    ln4 = _f(math.log(4.0))
    odd_sum = (
        f"coalesce(list_sum(list_transform(range(0, CAST(({nu} - 1) // 2 AS BIGINT)), lambda k: "
        f"exp(k * {ln4} + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow({c2}, k))), 0.0)"
    )
    even_sum = (
        f"coalesce(list_sum(list_transform(range(0, CAST({nu} // 2 AS BIGINT)), lambda k: "
        f"exp(lgamma(2 * k + 1) - k * {ln4} - 2 * lgamma(k + 1)) * pow({c2}, k))), 0.0)"
    )
    a = (
        f"(CASE WHEN {nu} % 2 = 1 THEN 2.0 / {_f(math.pi)} * ({th} + sin({th}) * cos({th}) * {odd_sum}) "
        f"ELSE sin({th}) * {even_sum} END)"
    )
    return f"(CASE WHEN ({x}) >= 0 THEN 0.5 + {a} / 2.0 ELSE 0.5 - {a} / 2.0 END)"


#: Bisection steps on theta in [0, pi/2]: 2^-64 pi is below double resolution.
_BISECT_STEPS = 64


def t_ppf_int_steps(p: str, nu: int) -> list[tuple[str, str]]:
    """Integer-nu t quantile as (alias, expression) steps: the same fixed
    bisection on theta, with the series written out for
    the given nu.  Use with :func:`nest_steps`; the result is ``tb_val``."""
    c2 = "(cos({th}) * cos({th}))"
    if nu % 2 == 1:
        terms, term = ["1.0"], "1.0"
        for k in range(1, (nu - 1) // 2):
            term = f"({term} * {_f(2.0 * k / (2.0 * k + 1.0))} * {c2})"
            terms.append(term)
        series = " + ".join(terms)
        mass = (f"({_f(2.0 / math.pi)} * ({{th}} + " + (f"sin({{th}}) * cos({{th}}) * ({series})" if nu > 1 else "0.0") + "))")
    else:
        terms, term = ["1.0"], "1.0"
        for k in range(1, nu // 2):
            term = f"({term} * {_f((2.0 * k - 1.0) / (2.0 * k))} * {c2})"
            terms.append(term)
        mass = f"(sin({{th}}) * ({' + '.join(terms)}))"
    steps = [("tb_target", f"abs(2.0 * ({p}) - 1.0)"), ("tb_lo0", "0.0"), ("tb_hi0", _f(math.pi / 2))]
    for k in range(_BISECT_STEPS):
        mid = f"((tb_lo{k} + tb_hi{k}) / 2.0)"
        below = mass.format(th=f"tb_m{k}") + " < tb_target"
        steps += [
            (f"tb_m{k}", mid),
            (f"tb_lo{k + 1}", f"CASE WHEN {below} THEN tb_m{k} ELSE tb_lo{k} END"),
            (f"tb_hi{k + 1}", f"CASE WHEN {below} THEN tb_hi{k} ELSE tb_m{k} END"),
        ]
    last = _BISECT_STEPS
    mag = f"sqrt({float(nu)!r}) * tan((tb_lo{last} + tb_hi{last}) / 2.0)"
    steps.append(
        ("tb_val", f"CASE WHEN ({p}) IS NULL OR ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < 0.5 THEN -{mag} ELSE {mag} END")
    )
    return steps


def t_ppf_expansion(p: str, nu: str) -> str:
    x = f"({norm_ppf(p)})"
    n = f"CAST({nu} AS DOUBLE)"
    g1 = f"((pow({x}, 3) + {x}) / 4.0)"
    g2 = f"((5.0 * pow({x}, 5) + 16.0 * pow({x}, 3) + 3.0 * {x}) / 96.0)"
    g3 = f"((3.0 * pow({x}, 7) + 19.0 * pow({x}, 5) + 17.0 * pow({x}, 3) - 15.0 * {x}) / 384.0)"
    g4 = (f"((79.0 * pow({x}, 9) + 776.0 * pow({x}, 7) + 1482.0 * pow({x}, 5) - 1920.0 * pow({x}, 3) "
          f"- 945.0 * {x}) / 92160.0)")
    return f"({x} + {g1} / {n} + {g2} / ({n} * {n}) + {g3} / ({n} * {n} * {n}) + {g4} / ({n} * {n} * {n} * {n}))"
