"""Sessions: runs of rows without too large a gap to the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as S
from .storage import settled


def _keys(by: list[str]) -> list[Column]:
    return [F.col(c) for c in by]


def sessions(df: DataFrame, by: list[str], at: Column, order: str, breaks, name: str = "session") -> DataFrame:
    """``df`` with the number of each row's session within its ``by`` group.

    ``at`` is the event time and ``order`` settles ties. ``breaks`` takes the
    window and gives the condition under which a row starts a new session. An
    empty ``by`` is one global order, which a single task must hold: use
    ``library_sessions`` for that.
    """
    run = W.partitionBy(*_keys(by)).orderBy(at.asc(), F.col(order).asc())
    starts = F.when(F.lag(F.lit(1)).over(run).isNull() | breaks(run), 1).otherwise(0)
    return df.withColumn("_starts", starts).withColumn(name, F.sum("_starts").over(run.rowsBetween(W.unboundedPreceding, 0))).drop("_starts")


def library_sessions(df: DataFrame, at: Column, order: str, seen: list[str], breaks, ranges: int | None = None) -> DataFrame:
    """``df`` with ``session`` (number in one order over all rows), ``session_rows``
    (rows of the session) and ``before``: time ``t`` and ``seen`` columns of the
    row before, null for the first of a session.

    ``breaks(before, t)`` says whether a row at time ``t`` starts a session; rows
    without a time are left out. Rows are dealt out by ranges of time and
    ``order`` (unique), a range per task. Each range numbers its own sessions;
    a row per range tells its last row, its starts, and how many rows its first
    and last sessions have, and a running fold over these few rows gives every
    range the row before it, the sessions before it, and the full size of
    sessions that go over a seam. The result does not depend on ``ranges``.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    timed = df.withColumn("_t", at).where("_t IS NOT NULL").repartitionByRange(ranges, "_t", order)
    dealt = settled(timed.withColumn("_range", F.spark_partition_id()))
    here = F.struct(F.col("_t").alias("t"), *seen)
    line = W.orderBy("_range")
    earlier = line.rowsBetween(W.unboundedPreceding, -1)

    # one row per range from here to each broadcast
    ends = dealt.groupBy("_range").agg(F.max_by(here, F.struct("_t", order)).alias("_end"))
    seams = ends.select("_range", F.lag("_end").over(line).alias("_seam"))
    run = W.partitionBy("_range").orderBy("_t", order)
    rows = dealt.join(F.broadcast(seams), "_range").repartitionById(ranges, F.col("_range")).withColumn("_before", F.coalesce(F.lag(here).over(run), F.col("_seam")))
    starts = F.col("_before").isNull() | F.coalesce(breaks(F.col("_before"), F.col("_t")), F.lit(False))
    rows = rows.withColumn("_starts", starts).withColumn("_local", F.sum(F.col("_starts").cast("long")).over(run.rowsBetween(W.unboundedPreceding, 0)))
    rows = settled(rows.withColumn("before", F.when(~F.col("_starts"), F.col("_before"))).drop("_before", "_seam"))

    parts = rows.groupBy("_range", "_local").agg(F.count("*").alias("_n"))
    # local session 0 goes on from the range before; the last one may go on into the next
    folded = parts.groupBy("_range").agg(F.max("_local").alias("_opened"), F.max_by("_n", "_local").alias("_tail"), F.coalesce(F.max(F.expr("IF(_local = 0, _n, NULL)")), F.lit(0)).alias("_head"))
    placed = folded.withColumn("_offset", F.coalesce(F.sum("_opened").over(earlier), F.lit(0)))
    # rows of a session by its number, from those ranges where it touches an edge
    heads = placed.where("_head > 0").select(F.col("_offset").alias("session"), F.col("_head").alias("n"))
    tails = placed.where("_opened > 0").select((F.col("_offset") + F.col("_opened")).alias("session"), F.col("_tail").alias("n"))
    over = heads.unionByName(tails).groupBy("session").agg(F.sum("n").alias("_whole"))
    out = rows.join(F.broadcast(placed.select("_range", "_offset")), "_range").withColumn("session", F.col("_local") + F.col("_offset"))
    out = out.withColumn("_own", F.count("*").over(W.partitionBy("_range", "_local"))).join(F.broadcast(over), "session", "left")
    return out.withColumn("session_rows", F.coalesce("_whole", "_own")).select(*df.columns, "session", "session_rows", "before")


def library_trips(photos: DataFrame, max_days: float = 3, max_km: float = 50.0, least: int = 3, ranges: int | None = None) -> DataFrame:
    """``trip_sessions`` over one order of the whole library: ``trip`` and ``step_km``."""
    placed = photos.where("date_taken IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    limit = int(max_days * 86_400_000_000)
    km = lambda before: S.haversine_km(before["lat"], before["lon"], F.col("lat"), F.col("lon"))
    out = library_sessions(placed, S.micros("date_taken"), "id", ["lat", "lon"], lambda before, t: (t - before["t"] > limit) | (km(before) > max_km), ranges)
    step = F.when(F.col("before").isNotNull(), km(F.col("before")))
    return out.where(F.col("session_rows") >= least).withColumn("step_km", step).withColumnRenamed("session", "trip").drop("session_rows", "before")


def library_activities(photos: DataFrame, gap_hours: float = 4, least: int = 3, ranges: int | None = None) -> DataFrame:
    """Photos of the whole library with the ``session`` they are in: runs of at
    least ``least`` photos with no gap above ``gap_hours`` between effective dates."""
    limit = int(gap_hours * 3_600_000_000)
    out = library_sessions(photos, S.micros(S.effective_date()), "id", [], lambda before, t: t - before["t"] > limit, ranges)
    return out.where(F.col("session_rows") >= least).drop("session_rows", "before")


def activity_summary(members: DataFrame) -> DataFrame:
    """One row per session: its span, size, first and last photo. No list of
    ids, so that a session may be as large as the library."""
    eff = S.effective_date()
    order = F.struct(S.micros(eff).alias("t"), "id")
    return members.groupBy("session").agg(F.min(eff).alias("date_start"), F.max(eff).alias("date_end"), F.count("*").alias("n"), F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"))


def trip_sessions(photos: DataFrame, by: list[str], max_days: float = 3, max_km: float = 50.0, least: int = 3) -> DataFrame:
    """Dated photos with coordinates, with ``trip`` (number in the group) and
    ``step_km`` (distance to the photo before in the trip; null for the first).
    A trip goes on while the next photo is at most ``max_days`` and ``max_km``
    from the one before; trips under ``least`` photos are left out. Rows
    without a date or a coordinate are in no trip."""
    placed = photos.where("date_taken IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    at, limit = S.micros("date_taken"), int(max_days * 86_400_000_000)

    def far(run):
        km = S.haversine_km(F.lag("lat").over(run), F.lag("lon").over(run), F.col("lat"), F.col("lon"))
        return (at - F.lag(at).over(run) > limit) | (km > max_km)

    out = sessions(placed, by, at, "id", far, "trip")
    within = W.partitionBy(*_keys(by), "trip")
    step = W.partitionBy(*_keys(by), "trip").orderBy(at, "id")
    out = out.withColumn("step_km", S.haversine_km(F.lag("lat").over(step), F.lag("lon").over(step), F.col("lat"), F.col("lon")))
    return out.withColumn("_n", F.count("*").over(within)).where(F.col("_n") >= least).drop("_n")


def trip_summary(trips: DataFrame, by: list[str]) -> DataFrame:
    """One row per trip: first and last photo, distance, counts, distinct cells of 0.01 degrees."""
    first, last = F.struct(S.micros("date_taken").alias("t"), "id"), F.struct(S.micros("date_taken").alias("t"), "id")
    cell = F.struct(F.bround("lat", 2), F.bround("lon", 2))
    return trips.groupBy(*_keys(by), "trip").agg(
        F.min("date_taken").alias("start_date"),
        F.max("date_taken").alias("end_date"),
        F.min_by("lat", first).alias("start_lat"),
        F.min_by("lon", first).alias("start_lon"),
        F.max_by("lat", last).alias("end_lat"),
        F.max_by("lon", last).alias("end_lon"),
        F.min_by("id", first).alias("cover_photo_id"),
        F.count("*").alias("photo_count"),
        F.count_if(S.is_video("ext")).alias("video_count"),
        F.count_distinct(cell).alias("place_count"),
        F.bround(F.coalesce(F.sum("step_km"), F.lit(0.0)), 1).alias("distance_km"),
    )


def activity_sessions(photos: DataFrame, by: list[str], gap_hours: float = 4, least: int = 3) -> DataFrame:
    """One row per run of photos with no gap above ``gap_hours`` between effective dates."""
    at, limit = S.micros(S.effective_date()), int(gap_hours * 3_600_000_000)
    runs = sessions(photos, by, at, "id", lambda run: at - F.lag(at).over(run) > limit)
    eff = S.effective_date()
    out = runs.groupBy(*_keys(by), "session").agg(
        F.min(eff).alias("date_start"), F.max(eff).alias("date_end"), F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("photo_ids")
    )
    return out.where(F.col("n") >= least)


def debounced(events: DataFrame, by: list[str], ts: str, order: str, gap_micros: int) -> DataFrame:
    """The events that are at least ``gap_micros`` after the last one kept for their key.

    An event that far after its predecessor is kept in any case, so the pass
    over kept events restarts there: only bursts are folded, not whole keys.
    """
    at = S.micros(ts)
    bursts = sessions(events, by, at, order, lambda run: at - F.lag(at).over(run) >= gap_micros, "_burst")
    rows = F.array_sort(F.collect_list(F.struct(at.alias("t"), F.col(order).alias("o"))))
    kept = F.aggregate(
        "_rows",
        F.array().cast("array<struct<t:bigint,o:bigint>>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x["t"] - F.element_at(acc, -1)["t"] >= gap_micros), F.array_append(acc, x)).otherwise(acc),
    )
    found = bursts.groupBy(*_keys(by), "_burst").agg(rows.alias("_rows")).select(F.explode(kept).alias("_k")).select(F.col("_k.o").alias(order))
    return events.join(found, order, "left_semi")
