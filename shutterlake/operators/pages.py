"""A page directory: pages of a large ordered table without ordering it again.

The table is stored in files that follow each other in the order of its pages.
The directory has a row per file: its number, how many rows it has and how many
lie before it. A page's number tells which rows it has, these tell the files,
and only those are read, however deep the page lies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


@dataclass(frozen=True)
class Directory:
    """``path``: rows and the directory below it; ``order``: how rows follow each other."""

    spark: SparkSession
    path: str
    order: tuple[Column, ...]

    def files(self) -> DataFrame:
        """file, n, first (number of its first row, from 0)."""
        return self.spark.read.parquet(f"{self.path}/directory")

    def rows(self) -> int:
        return self.files().agg(F.sum("n")).first()[0] or 0

    def files_of(self, first: int, rows: int) -> list[tuple[str, int]]:
        """Files that hold rows ``first`` to ``first`` + ``rows`` - 1, each with its first row's number."""
        hit = self.files().where((F.col("first") < first + rows) & (F.col("first") + F.col("n") > first)).orderBy("first")
        return [(r["file"], r["first"]) for r in hit.collect()]  # as many as a page has rows at most

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of page ``number`` (from 0) with ``position``; no rows behind the last page."""
        found = self.files_of(number * size, size)
        if not found:
            return self.spark.read.parquet(f"{self.path}/rows").limit(0).withColumn("position", F.lit(0).cast("long"))
        starts = F.coalesce(*(F.when(F.col("_file") == name, first) for name, first in found)) if len(found) < 100 else F.try_element_at(F.create_map(*(F.lit(x) for f in found for x in f)), F.col("_file"))
        read = self.spark.read.parquet(*(f"{self.path}/rows/{name}" for name, _ in found)).withColumn("_file", F.col("_metadata.file_name"))
        place = F.row_number().over(W.partitionBy("_file").orderBy(*self.order)) - 1 + starts
        return read.withColumn("position", place.cast("long")).where(F.col("position").between(number * size, number * size + size - 1)).drop("_file")


def build_directory(rows: DataFrame, path: str, order: list[Column], files: int | None = None) -> Directory:
    """Stores ``rows`` below ``path`` in about ``files`` files by ranges of ``order``
    (which no two rows share) and lists them. One shuffle; the directory is
    counted from the files."""
    spark = rows.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
    # a range is a task, and tasks number their files
    counted = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))
    listed = counted.withColumn("_no", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
    before = F.sum("n").over(W.orderBy("_no").rowsBetween(W.unboundedPreceding, -1))  # one row a file
    listed.select("file", "n", F.coalesce(before, F.lit(0)).alias("first")).write.mode("overwrite").parquet(f"{path}/directory")
    return Directory(spark, path, tuple(order))
