"""Where intermediate results go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where the session names
    none, a local session gets a folder of its own and a cluster an error: no
    folder of one machine can be right there."""
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
    """``df`` computed once into the shared folder. Spark removes its files when
    no plan needs them any more if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set; else they stay until the folder is cleared."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession):
    """Gives ``save(df)``: writes a compressed table into the shared folder and
    reads it back; ``save(df, "column")`` keeps a folder for each of its values. The tables are removed when the block ends, so results must
    be ``settled`` inside it."""
    paths: list[str] = []

    def save(df: DataFrame, *by: str) -> DataFrame:
        path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        paths.append(path)
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield save
    finally:
        for path in paths:
            remove(spark, path)


def veiled(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """``docs`` with the columns ``keep`` under names that no operator uses inside,
    these names, and the columns that give them back their own."""
    names = {c: f"_kept_{i}" for i, c in enumerate(keep)}
    others = [c for c in docs.columns if c not in names]
    shown = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), *(F.col(f"`{c}`") for c in others))
    return shown, list(names.values()), [F.col(n).alias(c) for c, n in names.items()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
