"""The folder that the driver and the executors share, and frames that are written there."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of our own only where all of them are this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; what follows survives lost executors without redoing them."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def replicated(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept on the disks of two executors each, until the frame is no longer used.

    For what lives no longer than an operator's next steps: it survives the loss of an executor, but not of all that hold a
    row. Nothing goes to the shared folder, where Spark starts processes for each file if that is a local one.
    """
    alone = df.sparkSession.sparkContext.master.split("[")[0] == "local"
    return df.localCheckpoint(True, StorageLevel.DISK_ONLY if alone else StorageLevel.DISK_ONLY_2)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, without what the optimiser knew of their making.

    For loops that build columns from columns: checkpoints keep the constraints of their plans, which grow with each turn.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that ``written`` gave."""
    spark = table.sparkSession
    for file in {x.rpartition("/")[0] for x in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of frames that are no longer used; in loops they pile up otherwise."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
