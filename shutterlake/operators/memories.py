"""Past moments worth showing again: signals, candidates, scores, ranking.

``as_of`` always stands for the present and is an argument, so that a query
gives the same rows whenever it runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as S
from .graph import greedy_leaders
from .sessions import activity_sessions

# Fixed values.
DSLR_MAKES = ("canon", "nikon", "sony", "fuji", "panasonic", "olympus", "pentax")
HOLIDAYS = [("New Year", 1, 1, 2), ("Valentine's Day", 2, 14, 1), ("Halloween", 10, 31, 1), ("Christmas", 12, 25, 3), ("Christmas Eve", 12, 24, 1)]
WEIGHTS = {"temporal": 0.20, "social": 0.25, "quality": 0.15, "semantic": 0.10, "location": 0.08, "holiday": 0.15}


# Signals: one column expression each.


def years_ago(as_of, date: Column) -> Column:
    return F.year(F.lit(as_of)) - F.year(date)


def temporal_weight(date: Column, as_of) -> Column:
    """High near an anniversary, falling with the years; days are compared by
    their number in the year, without wrapping at its end."""
    y, d = years_ago(as_of, date), F.abs(F.dayofyear(F.lit(as_of)) - F.dayofyear(date))
    fade = F.exp(-0.15 * y)
    return F.when(y <= 0, 0.0).when(d <= 3, (1.0 - d / 3.0) * fade).when((y > 5) & (d <= 7), 0.3 * fade).otherwise(0.0)


def fixed_holiday(date: Column) -> Column:
    m, d = F.month(date), F.dayofmonth(date)
    return (
        F.when((m == 1) & (d == 1), "New Year").when((m == 2) & (d == 14), "Valentine's Day").when((m == 10) & (d == 31), "Halloween").when((m == 12) & d.isin(24, 25, 26), "Christmas")
    )


def quality(width: Column, height: Column) -> Column:
    return F.when((width > 2000) & (height > 1500), 0.9).when(width > 1000, 0.7).when(width > 500, 0.5).otherwise(0.3)


def photo_signals(photos: DataFrame, as_of) -> DataFrame:
    """``photos`` with a struct per signal; null where a signal needs what the photo lacks."""
    date, dated, placed = F.col("date_taken"), F.col("date_taken").isNotNull(), F.col("lat").isNotNull() & F.col("lon").isNotNull()
    q = quality(F.col("width"), F.col("height"))
    make = F.coalesce("camera_make", F.lit(""))
    dslr = F.lower(make).isin(*DSLR_MAKES)
    liked = F.when(F.col("is_favorite"), 1.0).otherwise(0.3)
    anniversary = (F.month(date) == F.month(F.lit(as_of))) & (F.dayofmonth(date) == F.dayofmonth(F.lit(as_of)))
    temporal = F.struct(
        F.year(date).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day"), F.hour(date).alias("hour"), years_ago(as_of, date).alias("year_delta"),
        S.season(date).alias("season"), fixed_holiday(date).alias("holiday"), anniversary.alias("is_anniversary"), temporal_weight(date, as_of).alias("weight"),
    )
    return photos.withColumns({
        "temporal": F.when(dated, temporal),
        "spatial": F.when(placed, F.struct(F.col("lat"), F.col("lon"), S.geohash(F.col("lat"), F.col("lon")).alias("geohash"), F.lit(0.5).alias("weight"))),
        "quality": F.struct(q.alias("sharpness"), F.lit(0.8).alias("exposure"), F.lit(0.7).alias("contrast"), F.lit(0.6).alias("composition"), (q * 0.35 + 0.8 * 0.25 + 0.7 * 0.2 + 0.6 * 0.15 + 0.05).alias("overall")),
        "camera": F.struct(make.alias("make"), dslr.alias("is_dslr"), F.when(dslr, 1.15).otherwise(1.0).alias("weight")),
        "behavior": F.struct(F.col("is_favorite"), liked.alias("engagement"), liked.alias("weight")),
        "weather": F.when(dated & placed, F.struct(F.lit("unknown").alias("condition"), F.lit(20).alias("temperature_c"), F.lit(0.5).alias("weight"))),
        "semantic": F.struct(F.lit("unknown").alias("scene_type"), F.lit(0.5).alias("scene_confidence")),
        "burst": F.when(dated, F.struct(F.lit(1).alias("group_count"), F.col("id").alias("best_photo_id"), F.lit(0.03).alias("weight"))),
    })


def social_signals(faces: DataFrame) -> DataFrame:
    """Per photo: faces, mean confidence, known persons, weight (0.15 a face, at most 1). No smiles are told."""
    n = F.count("*")
    return faces.groupBy("photo_id").agg(
        n.alias("total_faces"),
        F.avg("confidence").alias("avg_confidence"),
        F.array_sort(F.collect_list(F.when(~F.col("is_unassigned"), F.col("person_id")))).alias("known_person_ids"),
        F.least(F.lit(1.0), n * 0.15).alias("weight"),
    )


def signals_json(signals: DataFrame, names: list[str]) -> DataFrame:
    """All signals of a photo in one JSON text, null ones left out."""
    return signals.select("id", F.to_json(F.struct(*names)).alias("signals"))


def signal_field(json: Column, name: str, field: str) -> Column:
    return F.get_json_object(json, f"$.{name}.{field}")


# Candidates: batch, type, key, photo_ids, person_ids, dates, hints, score.


def _candidates(df: DataFrame, kind: str, key, n, score, person=None, activity=None, location=None, holiday=None, dated: bool = True) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    day = lambda c: F.col(c) if dated else F.lit(None).cast("timestamp_ntz")
    return df.select(
        "batch", F.lit(kind).alias("type"), F.concat_ws(":", F.lit(kind), F.col("batch").cast("string"), key.cast("string")).alias("id"), "photo_ids",
        (F.array(person) if person is not None else F.array().cast("array<bigint>")).alias("person_ids"),
        day("date_start").alias("date_start"), day("date_end").alias("date_end"),
        text(activity).alias("activity_hint"), text(location).alias("location_hint"), text(holiday).alias("holiday_hint"), (n * score).alias("score"),
    )


def batches(photos: DataFrame, size: int = 200) -> DataFrame:
    """``photos`` with ``batch``: ids in blocks of ``size``, a fixed range each."""
    return photos.withColumn("batch", F.floor(F.col("id") / size))


_IDS = F.array_sort
_EFF = S.effective_date


def on_this_day(photos: DataFrame, as_of, min_years: int = 2, least: int = 2, batch_least: int = 3) -> DataFrame:
    """Photos of this month and day, at least ``min_years`` years old; batches under ``batch_least`` dated photos give none."""
    now, date = F.lit(as_of), F.col("date_taken")
    day = (F.month(date) == F.month(now)) & (F.dayofmonth(date) == F.dayofmonth(now)) & (F.year(date) <= F.year(now) - min_years)
    hit = lambda c: F.when(day, F.col(c))
    out = photos.where(date.isNotNull()).groupBy("batch").agg(
        F.count("*").alias("dated"), F.count_if(day).alias("n"), _IDS(F.collect_list(hit("id"))).alias("photo_ids"), F.min(hit("date_taken")).alias("date_start"), F.max(hit("date_taken")).alias("date_end")
    )
    out = out.where((F.col("n") >= least) & (F.col("dated") >= batch_least))
    return _candidates(out, "Day", F.lit("day"), F.col("n"), 0.1, activity=F.lit("On This Day"))


def recent_period(photos: DataFrame, as_of, days: int, kind: str, hint: Column | None = None, least: int = 3) -> DataFrame:
    """Photos of the last ``days`` days before ``as_of``."""
    lit = F.lit(as_of)
    recent = photos.where((F.col("date_taken") >= lit - F.make_interval(days=F.lit(days))) & (F.col("date_taken") <= lit))
    out = recent.groupBy("batch").agg(F.count("*").alias("n"), _IDS(F.collect_list("id")).alias("photo_ids"), F.min("date_taken").alias("date_start"), F.max("date_taken").alias("date_end"))
    return _candidates(out.where(F.col("n") >= least), kind, F.lit(kind), F.col("n"), 0.1, activity=hint)


def person_candidates(photos: DataFrame, faces: DataFrame, least: int = 3) -> DataFrame:
    """Persons on at least ``least`` faces of a batch; each photo is listed once."""
    seen = photos.select("batch", F.col("id").alias("photo_id")).join(faces.where("NOT is_unassigned").select("photo_id", "person_id"), "photo_id")
    out = seen.groupBy("batch", "person_id").agg(F.count("*").alias("n"), _IDS(F.collect_set("photo_id")).alias("photo_ids")).where(F.col("n") >= least)
    person = F.col("person_id")
    return _candidates(out, "Person", person, F.col("n"), 0.12, person=person, activity=F.concat(F.lit("Moments with Person "), person.cast("string")), dated=False)


def location_candidates(photos: DataFrame, least: int = 3) -> DataFrame:
    """Photos of one cell of 0.01 degrees; the cell's name has its rounded coordinates in hundredths."""
    lat, lon = F.round(F.bround(F.col("lat"), 2) * 100).cast("int"), F.round(F.bround(F.col("lon"), 2) * 100).cast("int")
    placed = photos.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("cell", F.concat_ws(",", lat.cast("string"), lon.cast("string")))
    out = placed.groupBy("batch", "cell").agg(F.count("*").alias("n"), _IDS(F.collect_list("id")).alias("photo_ids"), F.min(_EFF()).alias("date_start"), F.max(_EFF()).alias("date_end"))
    return _candidates(out.where(F.col("n") >= least), "Location", F.col("cell"), F.col("n"), 0.08, location=F.col("cell"))


def activity_candidates(photos: DataFrame, gap_hours: float = 4, least: int = 3) -> DataFrame:
    out = activity_sessions(photos, ["batch"], gap_hours, least)
    return _candidates(out, "Activity", F.col("session"), F.col("n"), 0.07, activity=F.lit("Moments"))


def holiday_of(date: Column) -> Column:
    """The first holiday within whose days of the same month ``date`` lies."""
    near = lambda m, d, r: (F.month(date) == m) & (F.abs(F.dayofmonth(date) - d) <= r)
    return reduce(lambda rest, h: F.when(near(*h[1:]), h[0]).otherwise(rest), reversed(HOLIDAYS), F.lit(None))


def holiday_candidates(photos: DataFrame, least: int = 2) -> DataFrame:
    named = photos.where("date_taken IS NOT NULL").withColumn("holiday", holiday_of(F.col("date_taken"))).where("holiday IS NOT NULL")
    out = named.groupBy("batch", "holiday").agg(F.count("*").alias("n"), _IDS(F.collect_list("id")).alias("photo_ids")).where(F.col("n") >= least)
    weight = F.when(F.col("holiday") == "Christmas", 0.15).otherwise(0.1)
    return _candidates(out, "Holiday", F.col("holiday"), F.col("n"), weight, holiday=F.col("holiday"), dated=False)


def merged(candidates: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Candidates of a batch after merging: by falling score (then id) each
    absorbs the free ones whose photos overlap its own by a Jaccard above
    ``overlap``. Photos and persons are united, the leader's other fields stay.
    """
    ranked = candidates.withColumn("rank", F.struct("batch", (-F.col("score")).alias("k"), "id"))
    photo = candidates.select("batch", "id", F.size("photo_ids").alias("n"), F.explode("photo_ids").alias("photo"))
    left, right = photo.toDF("batch", "a", "na", "photo"), photo.toDF("batch", "b", "nb", "photo")
    shared = left.join(right, ["batch", "photo"]).where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    edges = shared.where(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")) > overlap).select("a", "b")
    led = greedy_leaders(ranked.select("id", "rank"), edges)
    whole = candidates.join(led, "id").groupBy("leader").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("photo_ids")))).alias("_photos"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("person_ids")))).alias("_persons")
    )
    out = candidates.join(whole, candidates["id"] == whole["leader"]).withColumn("photo_ids", F.col("_photos")).withColumn("person_ids", F.col("_persons"))
    return out.select(*candidates.columns)


def score(candidates: DataFrame) -> DataFrame:
    """``candidates`` with the final score, which replaces the detector's."""
    n, p, w = F.size("photo_ids"), F.size("person_ids"), WEIGHTS
    has = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 1.0).otherwise(0.0)
    total = (
        w["temporal"] * F.least(F.lit(1.0), n * 0.02) + w["social"] * F.least(F.lit(1.0), p * 0.15) + w["quality"] * F.least(F.lit(1.0), n * 0.01)
        + w["semantic"] * 0.5 * has("activity_hint") + w["location"] * 0.5 * has("location_hint") + w["holiday"] * has("holiday_hint")
    )
    scaled = total * (0.7 + 0.3 * F.log10(n + 1) / F.log10(F.lit(101.0)))
    return candidates.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))


def ranked(candidates: DataFrame, top: int = 50, per_day: int = 3, per_person: int = 2, per_place: int = 1) -> DataFrame:
    """The best ``top`` candidates of each batch, at most ``per_day`` of one start
    date, ``per_person`` with one person and ``per_place`` of one location;
    ``place`` counts from 0. A fold over the batch's candidates by falling score
    carries those taken, ``top`` at most."""
    persons = F.coalesce("person_ids", F.array().cast(candidates.schema["person_ids"].dataType))
    row = F.struct((-F.round("score", 12)).alias("k"), "id", F.to_date("date_start").alias("day"), persons.alias("persons"), F.col("location_hint").alias("spot"))
    count = lambda taken, holds: F.size(F.filter(taken, holds))

    def choose(taken, r):
        full = (
            (F.size(taken) >= top)
            | (count(taken, lambda t: t["day"].eqNullSafe(r["day"])) >= per_day)
            | F.exists(r["persons"], lambda p: count(taken, lambda t: F.array_contains(t["persons"], p)) >= per_person)
            | F.coalesce(count(taken, lambda t: t["spot"] == r["spot"]) >= per_place, F.lit(False))
        )
        return F.when(full, taken).otherwise(F.array_append(taken, r))

    rows = candidates.groupBy("batch").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    none = F.slice("_rows", F.lit(1), F.lit(0))
    chosen = rows.select("batch", F.posexplode(F.aggregate("_rows", none, choose)).alias("place", "_t")).select("batch", F.col("_t.id").alias("id"), "place")
    return candidates.join(chosen, ["batch", "id"])


def title(c: str = "type") -> Column:
    act, kind = F.col("activity_hint"), F.col(c)
    place = F.coalesce("location_hint", F.lit("Unknown Location"))
    return (
        F.when(kind == "Day", F.coalesce(act, F.lit("On This Day")))
        .when(kind == "Week", F.coalesce(act, F.lit("This Week")))
        .when(kind == "Month", F.coalesce(act, F.date_format("date_start", "MMMM yyyy")))
        .when(kind == "Trip", F.concat(F.lit("Trip to "), F.coalesce("location_hint", F.lit("Unknown"))))
        .when(kind.isin("Person", "Activity"), F.coalesce(act, F.lit("Moments")))
        .when(kind == "Location", F.concat(F.lit("At "), place))
        .when(kind == "Holiday", F.concat(F.coalesce("holiday_hint", F.lit("Holiday")), F.lit(" Memories")))
        .when(kind == "Season", F.concat_ws(" ", S.season(F.col("date_start")), F.year("date_start").cast("string")))
        .when(kind == "Video", "Video Highlights")
        .otherwise("Your Memories")
    )


def assembled(candidates: DataFrame, as_of) -> DataFrame:
    """Title, subtitle, cover and dates (``as_of`` where a candidate has none)."""
    start, end = F.coalesce("date_start", F.lit(as_of)), F.coalesce("date_end", F.lit(as_of))
    days = F.floor((S.micros(end) - S.micros(start)) / 86_400_000_000) + 1
    n = F.size("photo_ids")
    plural = lambda k, word: F.concat(k.cast("string"), F.lit(f" {word}"), F.when(k != 1, "s").otherwise(""))
    subtitle = F.concat(plural(n, "photo"), F.when(days > 1, F.concat(F.lit(" • "), plural(days, "day"))).otherwise(""))
    return candidates.select(
        "*", title().alias("title"), subtitle.alias("subtitle"), F.element_at("photo_ids", 1).alias("cover_photo_id"), start.alias("shown_start"), end.alias("shown_end"),
        F.when(F.size("person_ids") > 0, "With friends").alias("people_summary"),
    )


def memory_photos(candidates: DataFrame) -> DataFrame:
    """One row per photo of a memory: sort order, and the role of cover for the first."""
    out = candidates.select(F.col("id").alias("memory_id"), F.posexplode("photo_ids").alias("sort_order", "photo_id"))
    return out.withColumn("role", F.when(F.col("sort_order") == 0, "Cover").otherwise("Supporting"))


def due_schedules(schedules: DataFrame, as_of) -> DataFrame:
    """Schedules whose date has come and that were not shown today."""
    return schedules.where((F.col("schedule_date") <= F.lit(as_of)) & (F.col("last_shown_at").isNull() | (F.col("last_shown_at") < F.date_trunc("day", F.lit(as_of)))))


def stale_archived(memories: DataFrame, as_of, days: int = 90) -> DataFrame:
    """``memories`` with ``is_archived`` set for those last shown over ``days`` days ago; never shown ones stay."""
    old = F.col("last_shown_at") < F.lit(as_of) - F.make_interval(days=F.lit(days))
    return memories.withColumn("is_archived", F.col("is_archived") | F.coalesce(old, F.lit(False)))


def latest_per(rows: DataFrame, key: str, order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
