"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, one of our own, but only if executors are threads of the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-marketplace-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table, written once and read by all that follows; it stays until the folder is cleared."""
    path = f"{shared_folder(df.sparkSession)}/marketplace/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def not_broadcast(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is sorted and merged, never sent through the driver.

    Spark guesses a size from compressed files and a default length of texts, so a million rows that are put together by row pass for
    a few MB and would be broadcast.
    """
    return df.hint("merge")
