"""Association and ranking scores (X6-X10), all in double arithmetic (no integer wrap)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def lift(count, n, f1, f2) -> Column:
    """Count * N / (f1 * f2)."""
    return _d(count) * _d(n) / (_d(f1) * _d(f2))


def pmi(count, n, f1, f2) -> Column:
    """ln(count * N / (f1 * f2))."""
    return F.log(lift(count, n, f1, f2))


def edge_weight(method: str, count, n, f1, f2) -> Column:
    """X6/X7/X8: 'pmi', 'lift', anything else -> raw count."""
    if method == "pmi":
        return pmi(count, n, f1, f2)
    if method == "lift":
        return lift(count, n, f1, f2)
    return _d(count)


def opportunity(median, num_posts) -> Column:
    """Median - ln(posts)."""
    return _d(median) - F.log(_d(num_posts))
