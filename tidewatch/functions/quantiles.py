"""Exact quantiles of groups of any size, and prefix sums that are not one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 32


def _bounds(df: DataFrame, keys: list[str], value: str, pieces: int) -> DataFrame:
    """Approximate cut points of ``value`` per group (a bounded sketch); exactness never depends on them."""
    cuts = [i / pieces for i in range(1, pieces)]
    return df.groupBy(*keys).agg(F.percentile_approx(value, F.lit(cuts), F.lit(1000)).alias("_cuts"))


def range_pieces(df: DataFrame, keys: list[str], value: str, pieces: int = PIECES) -> DataFrame:
    """Adds ``_piece``: which stretch of its group's value range a row falls in.

    Equal values share a piece and pieces are ordered like values, so a group can be sorted piece by piece,
    by many tasks. The cut table has one row per group; an equi-join on the group keys brings it back.
    """
    joined = df.join(_bounds(df, keys, value, pieces), keys)
    below = F.size(F.filter(F.col("_cuts"), lambda cut: cut < F.col(value)))
    return joined.withColumn("_piece", below).drop("_cuts")


def running_totals(df: DataFrame, keys: list[str], value: str, sums: list[str], ascending: bool = True,
                   pieces: int = PIECES) -> DataFrame:
    """Adds ``cum_<c>`` for each of ``sums``: the total over rows of the group at or before this value.

    ``df`` must have one row per (keys, value). Sorted sums run inside a piece; totals of earlier pieces
    (at most ``pieces`` rows a group) are added on top.
    """
    placed = range_pieces(df, keys, value, pieces)
    if not ascending:
        placed = placed.withColumn("_piece", -F.col("_piece"))
    order = F.col(value).asc() if ascending else F.col(value).desc()
    inside = Window.partitionBy(*keys, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_piece").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    offsets = totals.select(*keys, "_piece", *(F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}")
                                               for c in sums))
    out = placed.join(offsets, [*keys, "_piece"])
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(inside) + F.col(f"_o_{c}"))
    return out.drop("_piece", *(f"_o_{c}" for c in sums))


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float],
                      weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group: ``wanted`` maps output name -> q.

    Values are counted first (equal values collapse), then ranked by running totals in pieces. A value covers
    ranks (cum - c, cum]; position q*(n-1) lies between the values holding its floor and its ceiling.
    """
    count = F.sum(weight) if weight else F.count("*")
    counted = (df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.alias("_c")))
    ranked = running_totals(counted, keys, value, ["_c"])
    size = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = ranked.join(size, keys)
    low, high = F.col("cum__c") - F.col("_c"), F.col("cum__c")
    aggs: list[Column] = []
    for name, q in wanted.items():
        at = F.lit(float(q)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((low <= rank) & (rank < high), F.col(value))).alias(f"_{side}_{name}"))
    picked = ranked.groupBy(*keys, "_n").agg(*aggs)
    out = [*keys]
    for name, q in wanted.items():
        at = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*out)
