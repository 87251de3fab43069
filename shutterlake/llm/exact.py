"""Exact deduplication by an extendible-hash index kept on shared files.

Every text has a 64-bit key. The directory starts with as many leading key
bits as the number of entries suggests and doubles until no bucket is overfull;
buckets that need fewer bits keep their smaller local depth. It sends entries
to their buckets, and owner tasks take the buckets in key order, a range of keys
each. There the entries of a key are chained: neighbours in the order of their
texts are compared byte by byte, equal ones add up in one link, others open the
next. Every owner's buckets are a folder. Rows look their group up by going the
same way: key, directory, bucket, and bytes where a chain has several links; a
probe of few rows opens only the folders of their buckets' owners. Copies collapse before they are
shuffled, so a text that a third of all rows share is a few entries.

Only DataFrame operations are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import partitions, scratch, settled, veiled

BUCKET_ENTRIES = 50_000
SPREAD = 8
#: A directory of more slots is not sent to all tasks.
BROADCAST_SLOTS = 200_000
_SHIFT = str(10**20)
_TOP = str(2**63)


def normalised(text: Column) -> Column:
    """``text`` without the characters ``[\\x20\\x09-\\x0D]``; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _preference(text: Column, doc_id: Column) -> Column:
    """More code points win, then the smaller id; a null id comes last. One
    number, so that the aggregation can stay in hash tables."""
    size = F.length(F.coalesce(text, F.lit(""))).cast("decimal(10,0)")
    low = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(0))
    return (size * F.lit(_SHIFT).cast("decimal(21,0)") + low).cast("decimal(38,0)")


def _preferred_id(preference: Column) -> Column:
    low = preference % F.lit(_SHIFT).cast("decimal(21,0)")
    return F.when(low > 0, (F.lit(_TOP).cast("decimal(20,0)") - low).cast("long"))


def _slot(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def entries(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """key, norm, n, pref: what each distinct text brings to its bucket. Copies
    collapse in the tasks that read them and then in ``spread`` parts, so a text
    that a third of all rows share is at most ``spread`` entries."""
    norm = normalised(F.col("text"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    rows = docs.select(F.xxhash64(norm).alias("key"), norm.alias("norm"), part.alias("part"), _preference(F.col("text"), F.col("doc_id")).alias("pref"))
    return rows.groupBy("part", "key", "norm").agg(F.count(F.lit(1)).alias("n"), F.max("pref").alias("pref")).drop("part")


def directory(found: DataFrame, capacity: int = BUCKET_ENTRIES, owners: int = 1) -> tuple[DataFrame, int]:
    """The directory over ``found`` (with a column key), and its global depth.

    Rows: slot (the leading bits of a key), bucket (its first slot, so buckets
    are numbered in the order of their keys), local_depth, load, owner. The
    directory doubles until no bucket holds more than ``capacity`` distinct keys
    (or what gives each of ``owners`` a few buckets, if that is less); buckets
    that fit at fewer bits are not split and keep all the slots they had. Only
    counts leave the executors.
    """
    keys = settled(found.select("key").distinct())
    n = keys.count()
    capacity = max(1, min(capacity, n // (4 * owners))) if owners > 1 else capacity
    first = depth = max(0, (max(1, n) - 1) // capacity).bit_length()
    while depth < 62:
        loads = keys.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("load"))
        if (loads.agg(F.max("load")).first()[0] or 0) <= capacity:
            break
        depth += 1
    local, bucket = F.lit(depth), F.col("slot")
    for d in range(depth - 1, max(0, first - 2), -1):
        upper = F.shiftrightunsigned(F.col("slot"), depth - d)
        fits = F.sum("load").over(W.partitionBy(upper)) <= capacity
        local = F.when(fits, d).otherwise(local)
        bucket = F.when(fits, F.shiftleft(upper, depth - d)).otherwise(bucket)
    owner = F.floor(F.col("bucket") / F.lit(float(2**depth)) * owners).cast("int")
    return loads.select("slot", "load", local.alias("local_depth"), bucket.alias("bucket")).withColumn("owner", owner), depth


@dataclass
class Index:
    """``table`` on shared files, a folder per owner; ``slots`` (slot, bucket,
    local_depth, owner) is the directory of 2 ** ``depth`` slots, of which those
    that are in use are stored; ``small`` says that it may go to all tasks."""

    table: DataFrame
    slots: DataFrame
    depth: int
    small: bool

    def located(self, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
        """``rows`` with ``columns`` of the directory for their keys; rows whose slot is empty are left out."""
        at = rows.withColumn("slot", _slot(F.col(key), self.depth))
        found = self.slots.select("slot", *columns)
        return at.join(F.broadcast(found) if self.small else found, "slot").drop("slot")


def build_index(docs: DataFrame, save, capacity: int = BUCKET_ENTRIES) -> Index:
    """The index on shared files: owner, bucket, local_depth, key, chain (0 for the
    first text of a key, 1.. for others whose key collides), links (texts in the
    chain), text_sha256, group_size, keep_id, and norm where the chain has more
    than one link.

    The directory sends every entry to its bucket and the bucket's owner; an
    owner task has a range of keys. It sorts a key's entries by their texts and
    compares neighbours' bytes: equal ones are one link of the chain and add up,
    others open the next link.
    """
    owners = partitions(docs.sparkSession)
    found = save(entries(docs))
    slots, depth = directory(found, capacity, owners)
    slots = save(slots.drop("load"))
    # a large directory is dealt out by slot, and entries go to it
    index = Index(None, slots, depth, slots.count() <= BROADCAST_SLOTS)
    owned = index.located(found, "key", ["bucket", "local_depth", "owner"])
    of_key, of_text = W.partitionBy("owner", "bucket", "key"), W.partitionBy("owner", "bucket", "key", "norm")
    chained = owned.repartitionById(owners, F.col("owner")).withColumns(
        {
            "chain": F.dense_rank().over(of_key.orderBy("norm")) - 1,
            "opens": F.coalesce(F.lag("norm").over(of_key.orderBy("norm")) != F.col("norm"), F.lit(True)),
            "group_size": F.sum("n").over(of_text),
            "best": F.max("pref").over(of_text),
        }
    )
    chained = chained.where("opens").withColumn("links", F.max("chain").over(of_key) + 1)
    index.table = save(
        chained.select(
            "owner", "bucket", "local_depth", "key", "chain", "links", F.sha2("norm", 256).alias("text_sha256"), "group_size", _preferred_id(F.col("best")).alias("keep_id"),
            F.when(F.col("links") > 1, F.col("norm")).alias("norm"),
        ),
        "owner",
    )
    return index


def look_up(docs: DataFrame, index: Index, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with bucket, group_size, keep_id, text_sha256
    of each row's link in ``index``, found by its key's bucket. Where a key's
    chain has one link, its texts were all equal, so the key leads to the
    answer; rows whose key has several links are compared with these by their
    bytes."""
    norm, found, at = normalised(F.col("text")), ["group_size", "keep_id", "text_sha256"], ["owner", "bucket", "_key"]
    kept = [*keep, "bucket", *found]
    rows = index.located(docs.select(*keep, F.xxhash64(norm).alias("_key")), "_key", ["owner", "bucket"])
    table = index.table.withColumnRenamed("key", "_key")
    out = rows.join(table.where("links = 1").select(*at, *found), at).select(*kept)
    several = table.where("links > 1").select(*at, F.col("norm").alias("_norm"), *found)
    if several.isEmpty():
        return out
    rows = index.located(docs.select(*keep, F.xxhash64(norm).alias("_key"), norm.alias("_norm")), "_key", ["owner", "bucket"])
    return out.unionByName(rows.join(several, [*at, "_norm"]).select(*kept))


def probe(docs: DataFrame, index: Index, keep: list[str]) -> DataFrame:
    """``look_up`` for few rows, whose texts need not be in the index: only the
    folders that their keys lead to are opened."""
    keyed = docs.select(F.xxhash64(normalised(F.col("text"))).alias("_key"))
    owners = [r[0] for r in index.located(keyed, "_key", ["owner"]).select("owner").distinct().collect()]  # a folder's number each
    return look_up(docs, Index(index.table.where(F.col("owner").isin(owners)), index.slots, index.depth, index.small), keep)


def exact_groups(docs: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """Per row of ``docs``: its columns besides text, and keep_id, group_size,
    kept, text_sha256, bucket.

    Texts are equal when identical without white space. Of equal texts the row
    with the most code points stays, then the smallest doc_id. Null text counts
    as empty, and empty texts form a group like any other. A null doc_id comes
    last. Rows that repeat the staying doc_id with an equal text all count as
    kept. Own columns win over like-named ones of ``docs``. An empty table
    gives an empty result.
    """
    own = ["keep_id", "group_size", "kept", "text_sha256", "bucket"]
    rest = [c for c in docs.columns if c not in [*own, "text"]]
    with scratch(docs.sparkSession) as save:
        shown, names, back = veiled(docs.select(*rest, "text"), rest)
        answered = look_up(shown, build_index(docs.select("doc_id", "text"), save, capacity), names)
        kept = F.col(names[rest.index("doc_id")]).eqNullSafe(F.col("keep_id"))
        return settled(answered.withColumn("kept", kept).select(*back, *own))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with exactly one row of each group of equal texts, all columns
    as they were: the row that ``exact_groups`` keeps. Where several rows have
    its doc_id (or none has one), the most code points win, then a hash of all
    columns; of rows that repeat in all of that, one stays. Other rows with
    that doc_id are judged by their own texts."""
    order = _preference(F.col("text"), F.xxhash64(*(docs[c] for c in docs.columns)))
    slim = docs.select("doc_id", "text", order.alias("_order"))
    one = exact_groups(slim).where("kept").groupBy("text_sha256").agg(F.max("_order").alias("_order")).withColumnRenamed("text_sha256", "_sha")
    rows = docs.withColumns({"_sha": F.sha2(normalised(F.col("text")), 256), "_order": order})
    return rows.join(one, ["_sha", "_order"], "left_semi").dropDuplicates(["_sha", "_order"]).select(*docs.columns)
