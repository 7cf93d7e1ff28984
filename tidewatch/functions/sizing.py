"""Small sides of joins: a size that is checked, and another way when the check fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 50_000
SALTS = 64


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """``(local copy, True)`` when ``df`` has at most ``limit`` rows, else ``(df, False)``.

    At most ``limit + 1`` rows reach the driver, so the check itself is bounded.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def join_small(big: DataFrame, small: DataFrame, is_small: bool, on: list[str], spread: str,
               how: str = "inner") -> DataFrame:
    """Join a per-key table to a big one whose keys may be very uneven.

    Proven small: broadcast. Otherwise an equi-join on (key, salt): the big side's salt comes from
    ``spread``, and each small row is copied once per salt, so no key is held by one task.
    """
    if is_small:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spreaded = big.withColumn("_salt", F.pmod(F.hash(spread), F.lit(SALTS)))
    return spreaded.join(salted, [*on, "_salt"], how).drop("_salt")
