"""String, number-format and category helpers as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: first number in a string (readr's parse_number: optional sign,
# digits, optional fraction).
NUMBER_PATTERN = r"-?[0-9]+(\.[0-9]+)?"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def replace_first(col, pattern: str, replacement: str) -> Column:
    """``str_replace``: replace only the first match (F2).

    ``regexp_replace`` replaces every match, so the pattern is extended to
    capture what precedes the first match and that prefix is kept.
    """
    return F.regexp_replace(_c(col), f"^(.*?){pattern}", f"$1{replacement}")


def parse_number(col) -> Column:
    """First number in the text as double (F4); NULL if none."""
    s = F.regexp_extract(_c(col), NUMBER_PATTERN, 0)
    return F.when(s == "", F.lit(None).cast("double")).otherwise(s.cast("double"))


def bracket_index(col) -> tuple[Column, Column]:
    """``psi[17]`` -> ("psi", 17) (the survey's string-with-index form)."""
    c = _c(col)
    return (
        F.regexp_extract(c, r"^([^\[]+)", 1),
        F.regexp_extract(c, r"\[([0-9]+)\]", 1).cast("int"),
    )


def short_number_text(x) -> Column:
    """``as.character(round(x, 2))``: two decimals with trailing zeros removed."""
    t = F.format_string("%.2f", F.round(_c(x), 2))
    return F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "")


def pad_number_text(x, width: int = 4) -> Column:
    """Number text right-padded with zeros to ``width``.

    Whole numbers get ".00" first (the reference's ``1`` -> ``1.00`` guard);
    R's str_pad never truncates, so the width is at least the text length.
    """
    t = short_number_text(x)
    t = F.when(~t.contains("."), F.concat(t, F.lit(".00"))).otherwise(t)
    return F.rpad(t, F.greatest(F.length(t), F.lit(width)), F.lit("0"))


def interval_text(mean, lower, upper) -> Column:
    """``mean [lower, upper]`` with two decimals."""
    return F.format_string("%.2f [%.2f, %.2f]", _c(mean), _c(lower), _c(upper))


def p_value_text(p) -> Column:
    """Formatted p-value with the ``< 0.001`` floor."""
    p = _c(p)
    return F.when(p < 0.001, F.lit("< 0.001")).otherwise(F.format_string("%.3f", p))


def percent_text(x, digits: int = 1) -> Column:
    """``label_percent``: 0.123 -> "12.3%" (F6)."""
    return F.concat(F.format_string(f"%.{digits}f", _c(x) * 100.0), F.lit("%"))


def clean_name(name: str) -> str:
    """``janitor::clean_names`` rule: lower case, runs of non-word chars -> '_'."""
    s = re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower()
    return s or "x"


def clean_names(df: DataFrame) -> DataFrame:
    """Apply :func:`clean_name` to every column."""
    return df.toDF(*[clean_name(c) for c in df.columns])


def rename_with(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """``rename_with(str_replace(...))`` over all column names."""
    return df.toDF(*[re.sub(pattern, replacement, c, count=1) for c in df.columns])


def ordered_levels(col, levels: list[str]) -> Column:
    """Sort key of ``col`` by a literal level order (P19); unknown levels last."""
    m = F.create_map(*[x for i, lv in enumerate(levels) for x in (F.lit(lv), F.lit(i + 1))])
    return F.coalesce(m[_c(col)], F.lit(len(levels) + 1))


def recode(col, mapping: dict[str, str]) -> Column:
    """``fct_recode``: relabel via a literal map, other labels unchanged."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[_c(col)], _c(col))
