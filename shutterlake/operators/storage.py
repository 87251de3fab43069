"""Lineage cuts in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a
    local session gets a temporary one and a cluster an error."""
    context = spark.sparkContext._jsc.sc()
    held = context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not named:
        if not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shutterlake-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once; later steps read its files, even after executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
