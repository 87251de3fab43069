"""Folders of media files as tables: Spark lists them, contents are not read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S

# Extensions that are catalogued.
MEDIA = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif",
    ".raw", ".cr2", ".nef", ".arw", ".dng", ".orf", ".rw2", ".pef", ".sr2",
    ".mp4", ".avi", ".mov", ".wmv", ".mkv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg", ".3gp",
)


def _all_under(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_utc"))


def files_under(spark: SparkSession, folder: str, extensions: tuple[str, ...] = MEDIA) -> DataFrame:
    """file_path, file_name, extension (lower case), file_size and modified_utc of
    all files below ``folder`` with one of ``extensions``, whatever their case.
    Empty files hold no picture; Spark leaves them out."""
    named = _all_under(spark, folder).select("file_path", S.file_name(F.col("file_path")).alias("file_name"), S.extension(F.col("file_path")).alias("extension"), "file_size", "modified_utc")
    return named.where(F.col("extension").isin(*extensions))


def data_sets_under(spark: SparkSession, folder: str, extension: str = ".parquet") -> DataFrame:
    """The columns of ``files_under`` for each data set below ``folder``: a file
    whose name has the ``extension``, or a folder whose name has it, with all its parts.

    Spark writes a large table as a folder of parts; that is one data set, and
    folders and files inside it are none. Its size is that of its parts
    together, its time that of the newest.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    names = F.split(F.substring("file_path", len(root) + 2, 2**31 - 1), "/")
    name = F.get(F.filter(names, lambda n: S.extension(n) == extension), F.lit(0))
    held = _all_under(spark, folder).withColumns({"_names": names, "file_name": name}).where("file_name IS NOT NULL")
    path = F.concat(F.lit(f"{root}/"), F.array_join(F.slice("_names", F.lit(1), F.array_position("_names", F.col("file_name")).cast("int")), "/"))
    sets = held.groupBy(path.alias("file_path"), "file_name").agg(F.sum("file_size").alias("file_size"), F.max("modified_utc").alias("modified_utc"))
    return sets.select("file_path", "file_name", S.extension(F.col("file_name")).alias("extension"), "file_size", "modified_utc")


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes each of ``rows`` (path below ``folder``, content: bytes) as a file of its own
    and gives their number. A path belongs to one row; a task that runs again
    writes the same files again. ``folder`` is one that all executors share."""
    root = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def run(batches):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name = f"{at}/{path.lstrip('/')}"
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(name) as out:
                    out.write(content.as_buffer())
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    return rows.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def storage_totals(files: DataFrame) -> DataFrame:
    """Number and bytes of files, or of data sets, per extension."""
    return files.groupBy("extension").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("total_size"))
