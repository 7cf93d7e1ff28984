"""Table sinks and sources: state matrix, hourly staging, score store, analysis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_states(states: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """One partition folder per split, and the split metadata as a second small table beside it."""
    states.write.mode("overwrite").partitionBy("split").parquet(f"{path}/states")
    if meta is not None:
        meta.write.mode("overwrite").parquet(f"{path}/meta")


def _with_text_keys(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """A partitioned table whose folder names are read as text: inferred types would turn "01" into 1."""
    found = spark.read.parquet(path).schema
    kinds = [T.StructField(f.name, T.StringType() if f.name in keys else f.dataType) for f in found]
    return spark.read.schema(T.StructType(kinds)).parquet(path)


def read_states(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """The whole matrix or some splits of it (partition pruning; other splits' files are not opened)."""
    df = _with_text_keys(spark, f"{path}/states", "split")
    return df if splits is None else df.where(F.col("split").isin(*splits))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/meta")


def write_hourly(flows: DataFrame, path: str) -> None:
    """Flows staged by (split, hour), for sinks rebuilt a stretch at a time.

    A rebalance by (split, hour) splits a busy hour by its size, so it is as many files as it needs, written in parallel.
    """
    (flows.withColumn("hour", F.date_format("ts", "yyyyMMddHH")).hint("rebalance", F.col("split"), F.col("hour"))
     .write.mode("overwrite").partitionBy("split", "hour").parquet(path))


def read_hours(spark: SparkSession, path: str, start: str, stop: str) -> DataFrame:
    """Flows of the hours ``start`` .. ``stop`` (yyyyMMddHH, inclusive), pruned by folder."""
    hour = F.col("hour")
    return _with_text_keys(spark, path, "split", "hour").where((hour >= start) & (hour <= stop)).drop("hour")


_SERIES = "array<double>"
SCORE_SCHEMA = f"metrics struct<per_day: map<string, struct<scores: {_SERIES}, threat_scores: {_SERIES}>>>"


def explode_scores(store: DataFrame, run: Column, seed: Column) -> DataFrame:
    """Nested score arrays to (run, seed, split, w, channel, score); a missing channel is an error."""
    day = store.select(run.alias("run"), seed.alias("seed"), F.explode("metrics.per_day").alias("split", "d"))
    checked = F.when(F.col("d.scores").isNotNull() & F.col("d.threat_scores").isNotNull(),
                     F.arrays_zip(F.col("d.scores").alias("comp"), F.col("d.threat_scores").alias("threat"))).otherwise(
        F.raise_error(F.concat(F.lit("no threat scores for split "), F.col("split"))))
    rows = day.select("run", "seed", "split", F.posexplode(checked).alias("w", "s"))
    return rows.select("run", "seed", "split", F.col("w").cast("long").alias("w"), F.col("s.comp").alias("comp"), F.col("s.threat").alias("threat")) \
        .unpivot(["run", "seed", "split", "w"], ["comp", "threat"], "channel", "score")


def read_score_store(spark: SparkSession, path) -> DataFrame:
    """One JSON document per run; run and seed come from its folder's name (``...-s<seed>``)."""
    docs = spark.read.schema(SCORE_SCHEMA).option("multiLine", True).json(path)
    docs = docs.withColumn("_run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    seed = F.regexp_extract("_run", r"-s(\d+)(?:-|$)", 1).try_cast("int")
    return explode_scores(docs, F.col("_run"), seed)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """An analysis table as parquet, CSV (with header) or JSON lines."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown table format {fmt!r}")
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
