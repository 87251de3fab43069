"""Duplicate files and similar pictures."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as S
from .graph import components
from .storage import settled


def duplicate_candidates(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files of more than no bytes that share all ``keys`` with another file.
    Keys compare null-safely, as in a grouping."""
    full = files.where("file_size > 0")
    shared = full.groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return full.join(shared, [c for c in same], "left_semi")


def content_hashes(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))


def duplicate_groups(hashed: DataFrame) -> DataFrame:
    """One row per content hash of two or more files: the largest file (then
    the smallest id) is the original, the others' bytes can be saved."""
    pick = F.struct(F.col("file_size"), (-F.col("id")).alias("k"))
    out = hashed.groupBy("content_hash").agg(
        F.count("*").alias("n_files"), F.max_by("id", pick).alias("original_id"), F.max("file_size").alias("file_size"), F.min("id").alias("group_id")
    )
    return out.where("n_files > 1").withColumn("savings", F.col("file_size") * (F.col("n_files") - 1))


def pick_original(members: DataFrame, group: str, date: str, key: str = "id") -> DataFrame:
    """``members`` with ``is_original``: the latest date (nulls last), then the highest id, of each group."""
    best = members.groupBy(group).agg(F.max(F.struct(F.col(date), F.col(key))).alias("_best")).select(F.col(group), F.col(f"_best.{key}").alias("_key"))
    return members.join(best, group).withColumn("is_original", F.col(key) == F.col("_key")).drop("_key")


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def hamming_pairs(hashes: DataFrame, most: int = 10, radius: int = 2, bits: int = 64) -> DataFrame:
    """``(a, b, distance)`` for all pairs a < b of ``(id, hash)`` at most ``most`` bits apart.

    The hash is cut into so many chunks that any such pair agrees in one chunk
    up to ``radius`` bits. One side is joined by that chunk's value, the other
    by all values within the radius: equality joins, whose candidates are only
    a small share of all pairs. A pair counts in the first chunk where it meets,
    so no distinct follows. Null hashes and 0 (no picture) are left out.
    """
    radius = min(radius, most)
    chunks = max(2, most // (radius + 1) + 1)
    edge = [bits * i // chunks for i in range(chunks + 1)]
    value = lambda h, i: F.shiftrightunsigned(h, edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1))
    good = hashes.where("hash IS NOT NULL AND hash <> 0").select("id", "hash")

    def keyed(df: DataFrame, names: tuple[str, str], around: bool) -> DataFrame:
        key = lambda i: F.transform(F.array(*[F.lit(m).cast("long") for m in (_masks(edge[i + 1] - edge[i], radius) if around else [0])]), lambda m: F.struct(F.lit(i).alias("chunk"), value(F.col("hash"), i).bitwiseXOR(m).alias("value")))
        keys = F.concat(*[key(i) for i in range(chunks)])
        return df.select(F.col("id").alias(names[0]), F.col("hash").alias(names[1]), F.explode(keys).alias("k")).select(*names, "k.chunk", "k.value")

    met = keyed(good, ("a", "ha"), False).join(keyed(good, ("b", "hb"), True), ["chunk", "value"]).where("a < b")
    first = F.lit(None)
    for i in reversed(range(chunks)):
        first = F.when(F.bit_count(value(F.col("ha"), i).bitwiseXOR(value(F.col("hb"), i))) <= radius, i).otherwise(first)
    found = met.where((F.col("chunk") == first) & (S.hamming(F.col("ha"), F.col("hb")) <= most))
    return found.select("a", "b", S.hamming(F.col("ha"), F.col("hb")).alias("distance"))


def hash_links(hashes: DataFrame, most: int = 10) -> DataFrame:
    """``hamming_pairs`` between hashes instead of pictures: a and b (the smallest
    ids that have them), distance, n_a and n_b (pictures that have them). A hash
    that n pictures share stands for its n x n pairs in one row, with itself
    at distance 0."""
    good = hashes.where("hash IS NOT NULL AND hash <> 0")
    nodes = settled(good.groupBy("hash").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    size = nodes.select("id", "n")
    pairs = hamming_pairs(nodes.select("id", "hash"), most)
    linked = pairs.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b").select("a", "b", "distance", "n_a", "n_b")
    own = nodes.where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    return linked.unionByName(own)


def candidates_by_size(files: DataFrame) -> DataFrame:
    """Candidates with known width and height by size and both, others by size
    alone; an id that both branches give counts once."""
    known = "width IS NOT NULL AND height IS NOT NULL"
    sized = duplicate_candidates(files.where(known), ["file_size", "width", "height"])
    return sized.unionByName(duplicate_candidates(files.where(f"NOT ({known})"), ["file_size"])).dropDuplicates(["id"])


def similar_groups(hashes: DataFrame, most: int = 10) -> DataFrame:
    """``(id, group_id)`` of pictures that chains of similar pairs connect; lone ones are left out.

    Equal hashes are one node, so that a hash that many pictures share costs no pairs among them.
    """
    good = settled(hashes.where("hash IS NOT NULL AND hash <> 0").select("id", "hash"))
    nodes = settled(good.groupBy("hash").agg(F.min("id").alias("id")))
    linked = components(nodes, hamming_pairs(nodes, most).select("a", "b"))
    by_hash = nodes.join(linked, "id").select("hash", F.col("component").alias("group_id"))
    out = good.join(by_hash, "hash").select("id", "hash", "group_id")
    big = out.groupBy("group_id").count().where("count > 1").select("group_id")
    return out.join(big, "group_id", "left_semi")


def similar_best(members: DataFrame) -> DataFrame:
    """``members`` (group_id, id, width, height, file_size, hash, …) with ``is_best``
    (widest, then highest, then largest, then smallest id) and the distance to the best."""
    order = F.struct(F.coalesce("width", F.lit(0)).alias("w"), F.coalesce("height", F.lit(0)).alias("h"), F.col("file_size"), (-F.col("id")).alias("k"), F.col("hash").alias("hash"))
    best = members.groupBy("group_id").agg(F.max(order).alias("_b")).select("group_id", (-F.col("_b.k")).alias("best_id"), F.col("_b.hash").alias("_hash"))
    out = members.join(best, "group_id")
    return out.withColumn("is_best", F.col("id") == F.col("best_id")).withColumn("distance", S.hamming(F.col("hash"), F.col("_hash"))).drop("_hash")


def similar_metrics(best: DataFrame) -> DataFrame:
    """Per group: size, savings of all but the best, level by the largest distance to the best."""
    far = F.max("distance")
    level = F.when(far == 0, "Exact").when(far <= 5, "VerySimilar").otherwise("Similar")
    return best.groupBy("group_id").agg(
        F.count("*").alias("n_photos"), F.min("best_id").alias("best_id"), F.coalesce(F.sum(F.expr("IF(is_best, NULL, file_size)")), F.lit(0)).alias("savings"), level.alias("level")
    )


def group_numbers(groups: DataFrame, *by: Column | str) -> DataFrame:
    """Numbers from 1 in order of ``by`` (default group_id): offsets of range-partitioned parts, no single task.

    The parts are stored once: dealt out again, for their sizes, from fewer
    columns, rows may fall into other parts than those which are numbered.
    """
    by = by or ("group_id",)
    parts = settled(groups.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count()
    before = sizes.withColumn("_before", F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*by))
    return parts.join(before, "_part").withColumn("group_no", place + F.col("_before")).drop("_part", "_before")
