"""State scaling (N1-N7): log-standard, Gaussian ranks, relative views. Parameters are a small table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.normal import probit
from tidewatch.operators.series import along, slope

VIEWS = ("level", "rank", "delta", "slope")
VIEW_SLOPE = 5


@dataclass(frozen=True)
class Scaling:
    """Fitted parameters, one entry per column, in column order."""

    columns: tuple[str, ...]
    logged: tuple[bool, ...] = ()
    mean: tuple[float, ...] = ()
    std: tuple[float, ...] = ()
    rank_window: int | None = None
    rank_min: int = 10
    mode: str = field(default="log_standard")

    def __post_init__(self) -> None:
        if self.mode not in ("log_standard", "rank", "relative"):
            raise ValueError(f"unknown scaling mode {self.mode!r}")
        if self.rank_window is not None and self.rank_window < 1:
            raise ValueError("rank_window must be positive or None")
        if self.mode == "relative" and self.rank_window is None:
            raise ValueError("the relative mode needs a causal rank_window")

    def output_names(self) -> list[str]:
        if self.mode != "relative":
            return list(self.columns)
        return [c if v == "level" else f"{c}@{v}" for v in VIEWS for c in self.columns]


def fit(states: DataFrame, columns: list[str], skew_over: float = 2.0, mode: str = "log_standard",
        rank_window: int | None = None, rank_min: int = 10) -> Scaling:
    """Two aggregate passes, each returning one row. Columns with min >= 0 and bias-corrected skew over the
    limit are logged; a column that does not vary keeps std 1."""
    if mode == "rank":
        return Scaling(tuple(columns), mode=mode, rank_window=rank_window, rank_min=rank_min)
    first = states.agg(F.count("*").alias("n"), *(F.min(c).alias(f"lo_{i}") for i, c in enumerate(columns)),
                       *(F.skewness(c).alias(f"g_{i}") for i, c in enumerate(columns))).first()
    n = first["n"]
    correct = (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 else 0.0
    logged = tuple(first[f"lo_{i}"] is not None and first[f"lo_{i}"] >= 0 and (first[f"g_{i}"] or 0.0) * correct > skew_over
                   for i in range(len(columns)))
    x = [_logged(F.col(c), use) for c, use in zip(columns, logged)]
    second = states.agg(*(F.avg(v).alias(f"m_{i}") for i, v in enumerate(x)), *(F.stddev_pop(v).alias(f"s_{i}") for i, v in enumerate(x))).first()
    std = tuple(second[f"s_{i}"] if second[f"s_{i}"] >= 1e-6 else 1.0 for i in range(len(columns)))
    return Scaling(tuple(columns), logged, tuple(second[f"m_{i}"] for i in range(len(columns))), std, rank_window, rank_min, mode)


def _logged(x: Column, use: bool) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0))) if use else x.cast("double")


def transform(states: DataFrame, scaling: Scaling) -> DataFrame:
    """Scaled columns in place (relative mode adds views). Ranks never cross a split."""
    missing = [c for c in scaling.columns if c not in states.columns]
    if missing:
        raise ValueError(f"states lack scaled columns {missing[:5]}")
    if scaling.mode == "rank":
        ranks = {c: _rank(F.col(c), scaling) for c in scaling.columns}
        return states.withColumns(ranks)
    level = {c: (_logged(F.col(c), use) - F.lit(m)) / F.lit(s)
             for c, use, m, s in zip(scaling.columns, scaling.logged, scaling.mean, scaling.std)}
    if scaling.mode == "log_standard":
        return states.withColumns(level)
    ranked = states.withColumns({f"{c}@rank": _rank(F.col(c), scaling) for c in scaling.columns}).withColumns(level)
    return ranked.withColumns({f"{c}@delta": F.coalesce(F.col(c) - F.lag(c).over(along()), F.lit(0.0)) for c in scaling.columns}
                              | {f"{c}@slope": slope(F.col(c), VIEW_SLOPE) for c in scaling.columns})


def _rank(x: Column, scaling: Scaling) -> Column:
    return capture_rank(x) if scaling.rank_window is None else causal_rank(x, scaling.rank_window, scaling.rank_min)


def capture_rank(x: Column) -> Column:
    """Gaussian average-tie rank inside the split; a constant column is 0."""
    capture = Window.partitionBy("split")
    rank = F.rank().over(capture.orderBy(x)) + (F.count("*").over(Window.partitionBy("split", x)) - 1) / F.lit(2.0)
    return probit((rank - F.lit(0.5)) / F.count(x).over(capture))


def causal_rank(x: Column, window: int, min_periods: int = 10) -> Column:
    """The same, of the current row among its last ``window`` rows; 0 until ``min_periods`` rows exist."""
    past = F.collect_list(x).over(along().rowsBetween(-(window - 1), 0))
    n = F.size(past)
    less = F.size(F.filter(past, lambda v: v < x))
    equal = F.size(F.filter(past, lambda v: v == x))
    rank = less + (equal + F.lit(1)) / F.lit(2.0)
    return F.when(n >= min_periods, probit((rank - F.lit(0.5)) / n)).otherwise(F.lit(0.0))


def inverse(states: DataFrame, scaling: Scaling) -> DataFrame:
    """Back to feature units; a rank keeps no scale to undo."""
    if scaling.mode != "log_standard":
        raise NotImplementedError("rank-based scaling cannot be inverted")
    back = {}
    for c, use, m, s in zip(scaling.columns, scaling.logged, scaling.mean, scaling.std):
        value = F.col(c) * F.lit(s) + F.lit(m)
        back[c] = F.expm1(value) if use else value
    return states.withColumns(back)


def save(scaling: Scaling, spark: SparkSession, path: str) -> None:
    """One row per column."""
    rank = scaling.mode == "rank"
    rows = [(i, c, None if rank else scaling.logged[i], None if rank else scaling.mean[i], None if rank else scaling.std[i],
             scaling.rank_window, scaling.rank_min, scaling.mode) for i, c in enumerate(scaling.columns)]
    schema = "at int, name string, logged boolean, mean double, std double, rank_window int, rank_min int, mode string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Scaling:
    rows = spark.read.parquet(path).orderBy("at").collect()
    first = rows[0]
    fitted = first["mode"] != "rank"
    return Scaling(tuple(r["name"] for r in rows), tuple(r["logged"] for r in rows) if fitted else (),
                   tuple(r["mean"] for r in rows) if fitted else (), tuple(r["std"] for r in rows) if fitted else (),
                   first["rank_window"], first["rank_min"], first["mode"])
