"""Substring search for batches of patterns by an index of three-byte pieces.

A piece's postings are bitmaps of row ids. A pattern's rows are among those that
all of its pieces have; the rarest pieces are enough to find few candidates, and
these are held against the text. Shorter patterns take all pieces that start
with them; a text ends with two bytes that are no text, so that its last letters
start pieces as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import bitmaps as B

#: Pieces of a pattern that are looked up.
RAREST = 4
_END = b"\xff\xff"


def folded(text: Column) -> Column:
    return F.lower(text)


def pieces(rows: DataFrame) -> DataFrame:
    """``(id, piece)``: the distinct three-byte pieces of each text of ``rows`` (id, text)."""

    def run(batches):
        for batch in batches:
            for k, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                raw = np.frombuffer(text.as_buffer(), np.uint8).astype(np.int32) if text.is_valid else np.zeros(0, np.int32)
                if len(raw):
                    raw = np.append(raw, list(_END))
                    found = np.unique(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])
                    yield pa.record_batch([pa.array(np.full(len(found), k)), pa.array(found.astype(np.int32))], ["id", "piece"])

    return rows.select(F.col("id").cast("long"), folded(F.col("text")).alias("text")).mapInArrow(run, "id long, piece int")


def build_index(rows: DataFrame) -> DataFrame:
    """piece, bucket, bits and n (rows that the bitmap has) over ``rows`` (id: a
    whole number, unique; text). Rows of ids that are near each other meet in
    the tasks that read them, so bitmaps come together before the shuffle."""
    return B.item_bitmaps(pieces(rows), {"piece": F.col("piece")}, "id").withColumn("n", F.bitmap_count("bits"))


def _asked(patterns: DataFrame) -> DataFrame:
    """pattern, len and its pieces as numbers; patterns of one or two bytes have the
    number that their pieces start with."""

    def run(batches):
        for batch in batches:
            text = batch.column("pattern").to_pylist()
            raw = [t.lower().encode() for t in text]
            found = [sorted({int.from_bytes(b[k : k + 3], "big") for k in range(max(1, len(b) - 2))}) for b in raw]
            yield pa.record_batch([batch.column("pattern"), pa.array([len(b) for b in raw], pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["pattern", "len", "pieces"])

    return patterns.where("pattern IS NOT NULL AND pattern <> ''").select("pattern").distinct().mapInArrow(run, "pattern string, len int, pieces array<int>")


def candidates(index: DataFrame, patterns: DataFrame, rarest: int = RAREST) -> DataFrame:
    """pattern, bucket, bits: the rows that may hold each of ``patterns`` (pattern)."""
    asked = _asked(patterns).select("pattern", "len", F.explode("pieces").alias("piece"))
    sizes = index.groupBy("piece").agg(F.sum("n").alias("rows"))
    long = asked.where("len >= 3").join(sizes, "piece", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    order = W.partitionBy("pattern").orderBy("rows", "piece")
    picked = long.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= rarest)
    picked = picked.withColumn("_needs", F.count("*").over(W.partitionBy("pattern"))).select("pattern", "piece", "_needs")
    whole = picked.join(index, "piece").groupBy("pattern", "bucket", "_needs").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_has")).where("_has = _needs")
    found = whole.select("pattern", "bucket", "bits")
    for n in (1, 2):
        start = F.shiftright("piece", 8 * (3 - n))
        short = asked.where(F.col("len") == n).withColumnRenamed("piece", "_start").join(index.withColumn("_start", start), "_start")
        found = found.unionByName(short.groupBy("pattern", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
    return found


def search(rows: DataFrame, index: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(pattern, id)`` of the ``rows`` (id, text) whose text holds the pattern,
    whatever its case. An empty pattern is in every text, null ones in none."""
    some = B.items(candidates(index, patterns), ["pattern"], "id")
    texts = rows.select(F.col("id").cast("long"), "text").where("text IS NOT NULL")
    found = some.join(texts, "id").where(F.contains(folded(F.col("text")), folded(F.col("pattern")))).select("pattern", "id")
    every = patterns.where("pattern = ''").select("pattern").distinct()
    return found if every.isEmpty() else found.unionByName(texts.select(F.lit("").alias("pattern"), "id"))
