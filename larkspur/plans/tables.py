"""Where input tables lie: one Parquet file or folder for each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """What tells a table's present files from earlier ones: path, number of files, bytes and time of the last change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*")) if files.getFileStatus(path).isDirectory() else [files.getFileStatus(path)]
    return str(path), len(found), sum(f.getLen() for f in found), max((f.getModificationTime() for f in found), default=0)


#: Bytes for each core up to which a table is dealt out anew.
LITTLE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows dealt out to all cores, since it may be a single split; of a large one Spark's splits will do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * LITTLE else df


#: Rows of a task where each row is a file to be made and parsed.
FILES_A_TASK = 25_000


def by_work(df: DataFrame, key: str, rows: int = FILES_A_TASK) -> DataFrame:
    """Rows that are little to read and much to work on, dealt out by ``key``: splits of the file would be few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), key)
