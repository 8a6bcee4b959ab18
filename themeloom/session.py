"""Session helpers: a sensible default session, the shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitted session is used instead."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def log_level(spark: SparkSession, level: str) -> Iterator[None]:
    """Another log level of the JVM for a block of code, WARN after it."""
    spark.sparkContext.setLogLevel(level)
    try:
        yield
    finally:
        spark.sparkContext.setLogLevel("WARN")


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per session; where it is installed on them this changes nothing."""
    sc = spark.sparkContext
    if getattr(sc, "_themeloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():
        archive = os.path.join(tempfile.mkdtemp(prefix="themeloom-code-"), "themeloom.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, f"{package.name}/{file.relative_to(package)}")
        sc.addPyFile(archive)
    sc._themeloom_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share. It is read from the session; a local master without one gets a temporary folder, a cluster without one is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set; a folder that all executors share is needed")
        path = tempfile.mkdtemp(prefix="themeloom-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint: written once to the shared folder, so a lost executor costs no recomputation.

    A checkpoint inherits the planner's guess of its size, and a join multiplies the guesses of its sides: in loops of joins the guess would soon have thousands of digits,
    each round taking twice as long over it as the last. A guess beyond any real size is dropped.
    """
    spark = df.sparkSession
    ship(spark)
    checkpoint_dir(spark)
    cut = df.checkpoint(eager=True)
    plan = cut._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() <= 62:
        return cut
    rows = spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), cut._jdf.schema(), False)
    return DataFrame(rows, spark)


def spread(df: DataFrame, small: int = 256 << 20) -> DataFrame:
    """A small input that lies in fewer files than there are cores, dealt out to all of them; any other as it is, without a shuffle."""
    ship(df.sparkSession)
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > small:
        return df
    files = len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df
