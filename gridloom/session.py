"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "gridloom", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must be set for local-cluster masters")
        shared = tempfile.mkdtemp(prefix="gridloom-checkpoint-")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Survives the loss of any executor, unlike an executor-local copy.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_past(spark: SparkSession) -> None:
    """Between rounds of an iteration: lets go of what past rounds left.

    Spark drops shuffle files, broadcasts and checkpoints only when the driver's
    collector finds that nothing refers to them; waiting for that to happen by itself
    lets many rounds pile up on disk and in the driver.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
