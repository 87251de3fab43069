"""Commands on faces and people, each as tables before and after.

Faces have face_id, photo_id, is_ignored and created; links have person_id and
face_id; people have person_id and name. Statistics of people count the faces
that are linked and not ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def statistics(links: DataFrame, faces: DataFrame) -> DataFrame:
    """person_id, face_count, photo_count and last_seen of every linked person;
    a person whose faces are all gone or ignored has counts of 0."""
    seen = faces.where("NOT is_ignored").select("face_id", "photo_id", "created")
    return links.join(seen, "face_id", "left").groupBy("person_id").agg(
        F.count("photo_id").alias("face_count"), F.count_distinct("photo_id").alias("photo_count"), F.max("created").alias("last_seen")
    )


def affected(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """The distinct people whose faces are among ``chosen`` (face_id)."""
    return links.join(chosen.select("face_id"), "face_id", "left_semi").select("person_id").distinct()


def recomputed(links: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """Statistics of ``people`` (person_id) only; those without a link have counts of 0."""
    found = statistics(links.join(people, "person_id", "left_semi"), faces)
    return people.select("person_id").join(found, "person_id", "left").fillna(0, ["face_count", "photo_count"])


def ignored(faces: DataFrame, chosen: DataFrame, flag: bool = True) -> DataFrame:
    """``faces`` with the ``chosen`` ones ignored, or no longer ignored."""
    marked = chosen.select("face_id").distinct().withColumn("_chosen", F.lit(True))
    out = faces.join(marked, "face_id", "left")
    return out.withColumn("is_ignored", F.when(F.col("_chosen"), F.lit(flag)).otherwise(F.col("is_ignored"))).select(*faces.columns)


def split(links: DataFrame, chosen: DataFrame, person_id: int, new_id: int) -> DataFrame:
    """``links`` after the ``chosen`` faces of ``person_id`` have gone to ``new_id``.
    Chosen faces of other people stay where they are; links that become equal count once."""
    marked = chosen.select("face_id").distinct().withColumn("_chosen", F.lit(True))
    moved = F.coalesce(F.col("_chosen"), F.lit(False)) & (F.col("person_id") == person_id)
    return links.join(marked, "face_id", "left").select(F.when(moved, F.lit(new_id).cast("long")).otherwise(F.col("person_id")).alias("person_id"), "face_id").distinct()


def unassigned_again(faces: DataFrame, links: DataFrame, person_id: int) -> tuple[DataFrame, DataFrame]:
    """(faces, links) ready to recognise a person's faces anew: the links are
    gone and the faces that had them are unassigned."""
    gone = links.where(F.col("person_id") == person_id).select("face_id").distinct().withColumn("_gone", F.lit(True))
    out = faces.join(gone, "face_id", "left").withColumn("is_unassigned", F.col("is_unassigned") | F.coalesce("_gone", F.lit(False)))
    return out.select(*faces.columns), links.where(F.col("person_id") != person_id)


def named(people: DataFrame, links: DataFrame, face_ids: DataFrame, name: str, new_id: int) -> tuple[DataFrame, DataFrame]:
    """(people, links) with a new person ``name`` who has the given faces."""
    person = people.sparkSession.createDataFrame([(new_id, name)], "person_id long, name string")
    return people.unionByName(person), links.unionByName(face_ids.select(F.lit(new_id).cast("long").alias("person_id"), "face_id"))


def renamed(people: DataFrame, person_id: int, name: str) -> DataFrame:
    return people.withColumn("name", F.when(F.col("person_id") == person_id, F.lit(name)).otherwise(F.col("name")))
