"""Windows over a split's own series. A split has one row per stride of its capture, so these sorts are bounded
by capture length (2,880 rows a day at 30 s), whatever the traffic; splits never see each other's rows."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def along(*extra: str) -> WindowSpec:
    """A split's windows in order (``extra`` names further keys, e.g. channel or run)."""
    return Window.partitionBy(*extra, "split").orderBy("w")


def before(n: int, *extra: str) -> WindowSpec:
    """The ``n`` windows strictly before the current one."""
    return along(*extra).rowsBetween(-n, -1)


def ahead(n: int, *extra: str) -> WindowSpec:
    """The next ``n`` windows, the current one left out."""
    return along(*extra).rowsBetween(1, n)


def history(*extra: str) -> WindowSpec:
    """Everything strictly before the current window."""
    return along(*extra).rowsBetween(Window.unboundedPreceding, -1)


def slope(value: Column, span: int, *extra: str) -> Column:
    """Least-squares slope over the last ``span`` windows, 0 until the span is full."""
    frame = along(*extra).rowsBetween(-(span - 1), 0)
    full = F.count(value).over(frame) == span
    return F.coalesce(F.when(full, F.regr_slope(value, F.col("w")).over(frame)), F.lit(0.0))


def clipped(value: Column, bound: float) -> Column:
    return F.greatest(F.least(value, F.lit(bound)), F.lit(-bound))
