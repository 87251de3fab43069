"""Numbers and running folds of ordered groups, however large one group is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import partitions

#: Rows of one group that a running fold keeps in one task.
CHUNK = 1024


def ranked(df: DataFrame, key: list[str], order: list[Column], save) -> DataFrame:
    """``df`` (files, read several times) with ``_rank`` (from 1) of each row in its ``key`` group by
    ``order``, and ``_size``, the group's rows. Null keys form a group.

    Rows are dealt out by ranges of key and order, so a large group takes
    several tasks; equal rows are told apart by their place in the input. Each
    range numbers its own rows. Only groups that go over a range's edge need
    what lies before them, and a range has at most two of these: that table has
    two rows a partition at most, which is why it can be sent to all tasks.
    """
    parts = partitions(df.sparkSession)
    keys = [F.col(k) for k in key]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = save(dealt.repartitionByRange(parts, *(k.asc_nulls_first() for k in keys), *order, F.col("_tie")).withColumn("_part", F.spark_partition_id()))
    held = dealt.groupBy("_part", *key).agg(F.count(F.lit(1)).alias("_here"))
    group = W.partitionBy(*keys)
    earlier = F.coalesce(F.sum("_here").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = held.select("_part", *key, earlier.alias("_before"), F.sum("_here").over(group).alias("_total"), F.count(F.lit(1)).over(group).alias("_ranges")).where("_ranges > 1")
    over = save(over.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), "_before", "_total"))
    local = W.partitionBy("_part", *keys)
    rows = dealt.withColumns({"_rank": F.row_number().over(local.orderBy(*order, "_tie")).cast("long"), "_size": F.count(F.lit(1)).over(local)})
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rank, size = F.col("_rank") + F.coalesce("_before", F.lit(0)), F.coalesce("_total", "_size")
    return rows.join(F.broadcast(over), same, "left").select(*df.columns, rank.alias("_rank"), size.alias("_size"))


def running(df: DataFrame, key: str, at: str, folds: dict[str, tuple[Column, Callable, Callable]], backwards: bool = False) -> DataFrame:
    """``df`` (files, read twice) with running folds over each ``key`` group in the order of the
    number ``at`` (unique in the group), or against it if ``backwards``.

    ``folds``: name -> (value, aggregate of values, how two folds join; the
    neutral fold is 0). A group is folded in chunks of ``CHUNK`` numbers; what
    the chunks before it come to is joined to each.
    """
    df = df.withColumn("_chunk", F.floor(F.col(at) / CHUNK))
    way = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    whole = df.groupBy(key, "_chunk").agg(*(agg(value).alias(f"_sum_{n}") for n, (value, agg, _) in folds.items()))
    before = W.partitionBy(key).orderBy(way("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    carried = whole.select(key, "_chunk", *(agg(F.col(f"_sum_{n}")).over(before).alias(f"_carry_{n}") for n, (_, agg, _) in folds.items()))
    carried = carried.where(F.col(f"_carry_{next(iter(folds))}").isNotNull())
    upto = W.partitionBy(key, "_chunk").orderBy(way(at)).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({n: agg(value).over(upto) for n, (value, agg, _) in folds.items()})
    both = local.join(carried, [key, "_chunk"], "left")
    return both.withColumns({n: joined(F.col(n), F.coalesce(f"_carry_{n}", F.lit(0))) for n, (_, _, joined) in folds.items()}).select(*df.columns, *folds).drop("_chunk")
