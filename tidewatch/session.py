"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings with a reason: UTC keeps window maths on one clock; AQE re-plans joins and splits skewed
#: partitions at run time; the redundant-cast-free Arrow path is what the grouped-map operators use.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # rows are copied into windows and facets after a shuffle, so a small shuffle can still be much work
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM leaves methods over 8,000 bytes of code uncompiled; a stage that large runs faster without being fused
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
#: static, so only for sessions made here: plans hold hundreds of expressions, and recording a Python call
#: site for each of them doubles the time it takes to build one
STATIC = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def local_session(cores: int | str = 8, name: str = "tidewatch", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    conf = {
        **SETTINGS,
        **STATIC,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        **extra,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Set the run-time settings on a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give Python workers this package, once per application: the folds and stateful operators run in them, and
    a worker's import path is not the driver's. A cluster that already installs the package is not affected."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return spark
    _SHIPPED.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidewatch-"), "tidewatch.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the folder the cluster names in ``spark.checkpoint.dir``.

    Only where no folder is configured (tests, a laptop) is one made; a cluster always names a shared one.
    """
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if folder:
            sc.setCheckpointDir(folder)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(os.path.join(tempfile.mkdtemp(prefix="tidewatch-"), "checkpoints"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return df.checkpoint(eager=True)


#: whether Spark deletes the files of a query's shuffles once the query has ended
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept_apart(df: DataFrame) -> DataFrame:
    """``df`` written, and the shuffles that took deleted, before anything else runs: for steps whose shuffles are as large as their input.

    A query reads the setting when it is made, and it is made here, so no other query counts on these shuffles. Spark
    versions that do not know the setting delete them some time later.
    """
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        return cut_lineage(df.select("*"))
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete checkpoints that no DataFrame refers to any more, where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    allows that: for the steps that leave as much as their input behind.

    Its cleaner learns of them when the driver collects garbage, which a driver with little to do may not for a long time. What
    one collection frees has held on to more, so there are three.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
