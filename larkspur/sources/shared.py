"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_runs: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder that checkpoints go to, else one in the warehouse.

    The first two are shared because they were set; a warehouse that lies on the driver's own disk is refused on a cluster.
    """
    asked = spark.conf.get("spark.checkpoint.dir", None)
    if not asked:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        asked = set_dir.get() if set_dir.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/.shared"
        if not set_dir.isDefined() and asked.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{asked} isn't shared by driver and executors: set spark.checkpoint.dir to a folder that is")
    return asked.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; what is left in it goes when the driver's Python ends."""
    folder = f"{shared_dir(spark)}/larkspur/{spark.sparkContext.applicationId}"
    if folder not in _runs:
        _runs[folder] = spark
    return folder


@atexit.register
def _drop_runs() -> None:
    for folder, spark in _runs.items():
        try:
            delete(spark, folder)
        except Exception:  # noqa: S110  the application has ended before its driver
            pass


def delete(spark: SparkSession, at: str) -> None:
    """Delete a folder, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more; others are left alone."""
    for t in tables:
        if at := t.__dict__.pop("shared_path", None):
            delete(t.sparkSession, at)
