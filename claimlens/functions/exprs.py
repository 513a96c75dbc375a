"""Scalar and aggregate expression helpers.

Money is summed as DECIMAL(24,6) and turned back into DOUBLE: parts of a cent count,
and the sum is exact,
so it does not depend on partitioning or on the order rows arrive in, and any
SQL engine that sums decimals produces the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "money", "money_sum", "money_mean", "rounded",
    "safe_div", "right_closed_bins",
]

MONEY = "decimal(24,6)"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    return col_of(c).cast(MONEY)


def money_sum(c: str | Column) -> Column:
    """Exact sum of a money column; an all-null group sums to NULL (caller coalesces)."""
    return F.sum(money(c)).cast("double")


def money_mean(c: str | Column) -> Column:
    """Mean of the values that are numbers: exact sum divided by their count (NaN, like
    NULL, is left out of both)."""
    return F.try_divide(F.sum(money(c)).cast("double"), F.count(money(c)).cast("double"))


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields NULL instead of raising on a zero divisor (ANSI mode)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def right_closed_bins(x: Column, edges: list[float], labels: list[str]) -> Column:
    """pandas.cut(x, edges, labels) with right-closed bins; outside the edges -> NULL."""
    assert len(labels) == len(edges) - 1
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr

