"""Face vectors: centroids, nearest person, leader clusters, overlapping boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from . import angles
from .duplicates import group_numbers
from .storage import settled


def centroids(vectors: DataFrame, by: str = "person_id", vector: str = "embedding") -> DataFrame:
    """The unit vector of each group's mean. Sums are taken per position, so a
    group of any size is added up in parts on the map side."""
    parts = vectors.where(F.col(vector).isNotNull()).select(by, F.posexplode(vector).alias("pos", "x"))
    mean = parts.groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    return whole.select(by, S.l2_normalised(F.col("mean")).alias("centroid"))


def nearest(vectors: DataFrame, targets: DataFrame, threshold: float, strict: bool = False, key: str = "face_id", block: int | None = None) -> DataFrame:
    """``(key, target_id, similarity)`` of the most similar target; vectors with
    none above the threshold are left out. Ties go to the smallest target.

    Vectors and targets (``target_id``, ``vector``) are dealt into blocks of
    about ``block`` rows; without it, of a share of each between bounds. Each
    pair of blocks is one matrix product, so no row per pair is made; a vector
    goes to every block of targets and keeps one best target of each.
    """
    parts = lambda rows: max(1, -(-(n := rows.count()) // (block or angles.share(n))))
    lefts, rights = parts(vectors), parts(targets)
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.where("embedding IS NOT NULL").select(key, "embedding", dealt(key, lefts).alias("_i"), every(rights).alias("_j"))
    right = targets.select("target_id", "vector", dealt("target_id", rights).alias("_j"), every(lefts).alias("_i"))
    kind = f"{key} {vectors.schema[key].dataType.simpleString()}, target_id {targets.schema['target_id'].dataType.simpleString()}, similarity double"
    best = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(angles.best_of(key, threshold), kind)
    top = F.max(F.struct("similarity", (-F.col("target_id")).alias("_k"))).alias("_best")
    out = best.groupBy(key).agg(top).select(key, (-F.col("_best._k")).alias("target_id"), F.col("_best.similarity").alias("similarity"))
    return out.where(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold)


def similar_vectors(vectors: DataFrame, threshold: float, key: str = "id", block: int | None = None) -> DataFrame:
    """``(a, b, similarity)`` for all pairs a < b with a cosine of at least ``threshold``.

    Vectors are dealt into blocks; each pair of blocks that the angle between
    their pivots does not rule out is one unit of work, in which one matrix
    product gives all cosines; only pairs above the threshold leave. Vectors are
    of one length; a zero vector is like none.
    """
    return angles.near_pairs(angles.blocks(vectors, threshold, key, block), threshold)


def leader_clusters(vectors: DataFrame, threshold: float = 0.6, key: str = "id") -> DataFrame:
    """``(id, leader)``: in order of id, each free vector leads and takes all
    free ones at least ``threshold`` alike."""
    return angles.leader_clusters(vectors, threshold, key)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """One row per cluster, numbered -1, -2, … by falling size, then leader."""
    sizes = clusters.groupBy("leader").agg(F.count("*").alias("n"))
    return group_numbers(sizes, F.desc("n"), F.asc("leader")).select("leader", "n", (-F.col("group_no")).alias("cluster_id"))


def assign_or_cluster(vectors: DataFrame, targets: DataFrame, threshold: float, key: str = "face_id") -> DataFrame:
    """``(key, person_id, is_new)``: the nearest person strictly above the
    threshold, else a new person per leader cluster, numbered after the last."""
    old = settled(nearest(vectors, targets, threshold, strict=True, key=key).select(key, F.col("target_id").alias("person_id"), F.lit(False).alias("is_new")))
    rest = vectors.join(old, key, "left_anti")
    groups = leader_clusters(rest, threshold, key)
    numbers = group_numbers(groups.select("leader").distinct(), "leader").select("leader", F.col("group_no").alias("_n"))
    last = targets.agg(F.coalesce(F.max("target_id"), F.lit(-1)).alias("_last"))  # one row
    new = groups.join(numbers, "leader").crossJoin(last).select(F.col("id").alias(key), (F.col("_last") + F.col("_n")).alias("person_id"), F.lit(True).alias("is_new"))
    return old.unionByName(new)


def suppress_overlaps(boxes: DataFrame, most: float = 0.4) -> DataFrame:
    """Boxes of each photo that overlap no kept box of higher confidence by more
    than ``most``; ties go to the smaller id. A photo's boxes are few."""
    box = F.struct((-F.col("confidence")).alias("order"), "box_id", "x", "y", "w", "h")
    kind = "array<struct<order:double,box_id:bigint,x:double,y:double,w:double,h:double>>"
    kept = F.aggregate(
        F.array_sort(F.collect_list(box)),
        F.array().cast(kind),
        lambda acc, b: F.when(F.exists(acc, lambda k: S.iou(k, b) > most), acc).otherwise(F.array_append(acc, b)),
    )
    out = boxes.groupBy("photo_id").agg(kept.alias("_kept")).select("photo_id", F.explode("_kept").alias("_b"))
    return out.select("photo_id", F.col("_b.box_id").alias("box_id"), (-F.col("_b.order")).alias("confidence"))


def decode_anchors(cells: DataFrame, stride: int, size: int, least: float = 0.5) -> DataFrame:
    """Detector cells (cx, cy in grid units; score; distances l, t, r, b in
    strides) as boxes with sides from 0 to 1; scores under ``least`` go."""
    at = lambda c, d, sign: (F.col(c) * stride + sign * F.col(d) * stride) / size
    x, y, x2, y2 = at("cx", "l", -1), at("cy", "t", -1), at("cx", "r", 1), at("cy", "b", 1)
    return cells.where(F.col("score") >= least).withColumns({"x": x, "y": y, "w": x2 - x, "h": y2 - y})


def decode_grid(cells: DataFrame, stride: int, size: int, least: float = 0.5) -> DataFrame:
    """Detector cells (gx, gy; cls, obj; distances l, t, r, b in strides) as boxes
    with sides from 0 to 1. The score is class times objectness; outputs that lie
    outside 0 to 1 anywhere are taken as they come, others go through a sigmoid."""
    baked = cells.agg(F.coalesce(F.bool_or((F.greatest("cls", "obj") > 1) | (F.least("cls", "obj") < 0)), F.lit(False)).alias("_baked"))  # one row
    squash = lambda c: F.when(F.col("_baked"), F.col(c)).otherwise(1 / (1 + F.exp(-F.col(c))))
    centred = cells.crossJoin(baked).withColumns({"score": squash("cls") * squash("obj"), "cx": F.col("gx") + 0.5, "cy": F.col("gy") + 0.5})
    return decode_anchors(centred.drop("_baked"), stride, size, least)


def decode_flat(rows: DataFrame, width: float, height: float, least: float = 0.5) -> DataFrame:
    """Rows of corners x1, y1, x2, y2 in pixels and a score as boxes with sides from 0 to 1; empty boxes go."""
    kept = rows.where((F.col("score") >= least) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return kept.withColumns({"x": F.col("x1") / width, "y": F.col("y1") / height, "w": (F.col("x2") - F.col("x1")) / width, "h": (F.col("y2") - F.col("y1")) / height})


def clip_box(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes in pixels cut to the picture; those that leave nothing go."""
    left, top = F.greatest(F.lit(0), F.col("x")), F.greatest(F.lit(0), F.col("y"))
    right, bottom = F.least(F.lit(width), F.col("x") + F.col("w")), F.least(F.lit(height), F.col("y") + F.col("h"))
    return boxes.withColumns({"x": left, "y": top, "w": right - left, "h": bottom - top}).where("w > 0 AND h > 0")
