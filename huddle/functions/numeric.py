"""Rounding as the reports do it: ``round(x * 10^n) / 10^n`` on doubles, half away from
zero. Spark's own ``round(x, n)`` rounds the shortest decimal text of ``x`` instead,
which differs on values such as 1.005. Sums and averages are in ``exact.py``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_ref(col: Column | str, n: int = 2) -> Column:
    """Round a double to ``n`` decimals as ``round(x * 10^n) / 10^n``.

    A value that rounds to zero keeps its sign (``-0.0`` for a small negative
    value), as the double arithmetic of that formula gives; Spark's ``round``
    goes through a decimal, which has no negative zero.
    """
    c = _c(col)
    f = float(10 ** n)
    r = F.round(c * F.lit(f)) / F.lit(f)
    return F.when(r == 0.0, c * F.lit(0.0)).otherwise(r)
