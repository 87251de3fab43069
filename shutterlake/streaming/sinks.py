"""What a micro-batch leaves behind: several sinks of one pass, and a view kept up to date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _hadoop(spark, path)
    return system.exists(where)


def committed(spark: SparkSession, folder: str) -> bool:
    """Spark leaves this mark when all tasks of a write have ended well."""
    return exists(spark, f"{folder}/_SUCCESS")


@dataclass(frozen=True)
class Sink:
    """Which rows an event type has, and what it keeps of them."""

    wanted: Column
    columns: list[Column]


def fan_out(root: str, sinks: dict[str, Sink], write=None):
    """A ``foreachBatch`` function that gives every sink its rows of the batch, in
    ``root``/sink/batch_id=N.

    The source is read once a batch. A sink that fails does not hold up the
    others; the batch then fails as a whole and runs again, and sinks that had
    committed it are left as they are. ``write(rows, path)`` is how rows are
    written (Parquet by default).
    """
    write = write or (lambda rows, path: rows.write.mode("overwrite").parquet(path))

    def run(batch: DataFrame, batch_id: int) -> None:
        held, failed = batch.persist(), []
        try:
            for name, sink in sinks.items():
                at = f"{root}/{name}/batch_id={batch_id}"
                if committed(batch.sparkSession, at):
                    continue
                try:
                    write(held.where(sink.wanted).select(*sink.columns), at)
                except Exception as e:
                    failed.append((name, e))
        finally:
            held.unpersist()
        if failed:
            raise RuntimeError(f"batch {batch_id} is not in {', '.join(n for n, _ in failed)}") from failed[0][1]

    return run


@dataclass(frozen=True)
class View:
    """An aggregation that can be brought up to date: ``keys`` of its rows, and
    per column how rows of input make it and how two partial values join."""

    keys: list[str]
    made: dict[str, Column]
    joined: dict[str, Column]

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(c.alias(n) for n, c in self.made.items()))

    def both(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys).agg(*(c.alias(n) for n, c in self.joined.items()))


def current(spark: SparkSession, root: str, view: View, schema, before: int | None = None) -> DataFrame:
    """The view's rows: of each key what the last batch that touched it wrote."""
    if not exists(spark, root):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch_id", LongType())])).parquet(root)
    rows = rows if before is None else rows.where(F.col("batch_id") < before)
    newest = F.max_by(F.struct(*view.made), "batch_id").alias("_v")
    return rows.groupBy(*view.keys).agg(newest).select(*view.keys, *(F.col(f"_v.{n}").alias(n) for n in view.made))


def maintained(root: str, view: View, keyed):
    """A ``foreachBatch`` function that keeps ``view`` of ``keyed(batch)`` under ``root``.

    Only keys that the batch touches are read and written again, as
    ``root``/batch_id=N with one commit. A batch that runs again starts from
    the batches before it and replaces what it wrote, so nothing counts twice;
    rows that come late are rows like others.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        new = view.of(keyed(batch))
        held = new.persist()
        try:
            old = current(batch.sparkSession, root, view, held.schema, batch_id).join(held.select(*view.keys), view.keys, "left_semi")
            view.both(old.unionByName(held)).write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")
        finally:
            held.unpersist()

    return run
