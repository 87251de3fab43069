"""Travel: statistics, years, places, modes, achievements, cards.

Tables: trips (trip_id, name, start_date, end_date, distance_km), trip_photos
(trip_id, photo_id, date_taken, ext), trip_places (trip_id, place_id), places
(place_id, name, lat, lon).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S

DAY = 86_400_000_000


def duration_days(start: str = "start_date", end: str = "end_date") -> Column:
    """Days from start to end with their fraction, plus one."""
    return (S.micros(end) - S.micros(start)) / DAY + 1


def whole_days(start: str = "start_date", end: str = "end_date") -> Column:
    return F.floor((S.micros(end) - S.micros(start)) / DAY) + 1


def photo_counts(trip_photos: DataFrame) -> DataFrame:
    return trip_photos.groupBy("trip_id").agg(F.count("*").alias("photo_count"), F.count_if(S.is_video("ext")).alias("video_count"))


def statistics(trips: DataFrame, trip_photos: DataFrame, places: DataFrame, photos: DataFrame) -> DataFrame:
    """One row of totals. A country, state and city count at least one as soon as there is a trip."""
    parts, low = S.filled_parts(F.col("name")), lambda c: F.lower(F.trim(c))
    comma = F.contains("name", F.lit(","))
    part = lambda least, at: F.when(comma & (F.size(parts) >= least), low(F.element_at(parts, at)))
    where = places.agg(
        F.count("*").alias("places_visited"), F.count_distinct(part(2, -1)).alias("_countries"), F.count_distinct(part(3, 2)).alias("_states"),
        F.count_distinct(F.coalesce(part(2, 1), F.when(~comma, F.lower("name")))).alias("_cities"),
    )
    went = trips.agg(
        F.count("*").alias("trips_completed"), F.coalesce(F.sum("distance_km"), F.lit(0.0)).alias("total_distance_km"), F.coalesce(F.avg(duration_days()), F.lit(0.0)).alias("avg_duration_days"),
        F.min("start_date").alias("first_travel_date"), F.max("end_date").alias("last_travel_date"),
    )
    shot = trip_photos.agg(F.count("*").alias("photos_travelling"), F.count_if(S.is_video("ext")).alias("videos_travelling"), F.count_distinct(F.to_date("date_taken")).alias("travel_days"))
    gps = photos.agg(F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("gps_photos"))
    one = F.when(F.col("trips_completed") > 0, 1).otherwise(0)
    per_trip = F.when(F.col("trips_completed") > 0, F.col("photos_travelling") / F.col("trips_completed")).otherwise(F.lit(0.0))
    # Each side is one row.
    out = went.crossJoin(where).crossJoin(shot).crossJoin(gps).withColumn("avg_photos_per_trip", per_trip)
    return out.withColumns({n: F.greatest(F.col(f"_{s}"), one) for n, s in (("countries_visited", "countries"), ("states_visited", "states"), ("cities_visited", "cities"))}).drop("_countries", "_states", "_cities")


def by_year(trips: DataFrame, trip_photos: DataFrame, trip_places: DataFrame, places: DataFrame) -> DataFrame:
    """Per year of a trip's start: trips, distinct place names and last name parts, photos, videos, distance."""
    dated = trips.select("trip_id", F.year("start_date").alias("year"), "distance_km")
    shot = dated.join(photo_counts(trip_photos), "trip_id", "left").groupBy("year").agg(
        F.count("*").alias("trip_count"), F.coalesce(F.sum("photo_count"), F.lit(0)).alias("photo_count"), F.coalesce(F.sum("video_count"), F.lit(0)).alias("video_count"), F.sum("distance_km").alias("total_distance_km")
    )
    named = dated.join(trip_places, "trip_id").join(places.select("place_id", "name"), "place_id")
    went = named.groupBy("year").agg(F.count_distinct("name").alias("city_count"), F.count_distinct(F.trim(F.element_at(F.split("name", ","), -1))).alias("country_count"))
    return shot.join(went, "year", "left").fillna(0, ["city_count", "country_count"])


def _visits(trips: DataFrame, trip_photos: DataFrame, trip_places: DataFrame, places: DataFrame) -> DataFrame:
    counted = trips.select("trip_id", "start_date", "end_date", "distance_km").join(photo_counts(trip_photos), "trip_id", "left")
    return trip_places.join(places.where("name IS NOT NULL"), "place_id").join(counted, "trip_id").withColumn("photo_count", F.coalesce("photo_count", F.lit(0)))


def top_countries(trips, trip_photos, trip_places, places, limit: int = 10) -> DataFrame:
    """Countries with the most photos; a trip counts once for each of its places."""
    v = _visits(trips, trip_photos, trip_places, places).withColumn("country", S.country(F.col("name"))).where("country <> ''")
    out = v.groupBy("country").agg(
        F.sum("photo_count").alias("photo_count"), F.count_distinct("trip_id").alias("visit_count"), F.count_distinct(F.trim(F.element_at(F.split("name", ","), 1))).alias("city_count"),
        F.min("start_date").alias("first_visit"), F.max("end_date").alias("last_visit"), F.sum("distance_km").alias("total_distance_km"),
    )
    return out.orderBy(F.desc("photo_count"), "country").limit(limit)


def top_cities(trips, trip_photos, trip_places, places, limit: int = 10) -> DataFrame:
    """Cities with the most photos, with the coordinates of their first place (by trip and place)."""
    v = _visits(trips, trip_photos, trip_places, places).withColumn("city", S.city(F.col("name"))).where("city <> ''")
    first = F.struct("trip_id", "place_id")
    spot = F.min_by(F.struct("lat", "lon"), first)
    out = v.groupBy("city").agg(
        F.sum("photo_count").alias("photo_count"), F.count_distinct("trip_id").alias("visit_count"), F.min("start_date").alias("first_visit"), F.max("end_date").alias("last_visit"), spot.alias("_spot")
    )
    return out.select("city", "photo_count", "visit_count", "first_visit", "last_visit", F.col("_spot.lat").alias("lat"), F.col("_spot.lon").alias("lon")).orderBy(F.desc("photo_count"), "city").limit(limit)


def most_frequent(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """One row: the most frequent value; ties go to the smallest. Nulls and empty texts are left out."""
    n = rows.select(column.alias(name)).where(F.coalesce(F.col(name).cast("string"), F.lit("")) != "").groupBy(name).count()
    return n.agg(F.min_by(name, F.struct(-F.col("count"), F.col(name))).alias(name))


def modes(trips: DataFrame, photos: DataFrame, trip_photos: DataFrame) -> DataFrame:
    """One row: busiest year and month, longest and shortest trip, mean duration, busiest camera."""
    span = S.micros("end_date") - S.micros("start_date")
    text = F.concat(whole_days().cast("string"), F.lit(" days ("), F.col("name"), F.lit(")"))
    spans = trips.agg(
        F.min_by(text, F.struct(-span, F.col("trip_id"))).alias("longest"), F.min_by(text, F.struct(F.when(span < 0, None).otherwise(span).isNull(), span, F.col("trip_id"))).alias("shortest"), F.bround(F.avg(duration_days()), 1).alias("avg_duration_days")
    )
    camera = trip_photos.select(F.col("photo_id").alias("id")).join(photos.select("id", "camera_make"), "id")
    return (
        spans.crossJoin(most_frequent(trips, F.year("start_date"), "best_year")).crossJoin(most_frequent(trips, F.month("start_date"), "best_month")).crossJoin(most_frequent(camera, F.col("camera_make"), "camera"))
    )


def trip_summaries(trips: DataFrame, trip_photos: DataFrame, trip_places: DataFrame, places: DataFrame) -> DataFrame:
    """Per trip: whole days, photos, videos, places, distinct city and country names in order of place."""
    named = trip_places.join(places.select("place_id", "name"), "place_id", "left")
    part = lambda at: F.array_distinct(F.array_compact(F.transform("_p", lambda p: F.trim(F.element_at(F.split(p["name"], ","), at)))))
    went = named.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("place_id", "name"))).alias("_p"))
    went = went.select("trip_id", F.size("_p").cast("bigint").alias("place_count"), part(1).alias("city_names"), part(-1).alias("country_names"))
    out = trips.join(photo_counts(trip_photos), "trip_id", "left").join(went, "trip_id", "left")
    return out.withColumn("duration_days", whole_days()).fillna(0, ["photo_count", "video_count", "place_count"])


#: Achievements as (id, title, statistic, target, fixed progress or None).
ACHIEVEMENTS = [
    ("first_trip", "First Trip", "trips_completed", 1, 1),
    ("10_trips", "Frequent Traveller", "trips_completed", 10, None),
    ("100_places", "Place Explorer", "places_visited", 100, None),
    ("1000_gps", "1000 GPS Photos", "gps_photos", 1000, None),
    ("10_cities", "City Hopper", "cities_visited", 10, None),
    ("5_states", "State Explorer", "states_visited", 5, None),
    ("3_countries", "International Traveller", "countries_visited", 3, None),
    ("10000km", "10,000 KM Club", "total_distance_km", 10000, None),
    ("longest_vacation", "Longest Vacation", "avg_duration_days", 7, None),
    ("weekend_explorer", "Weekend Explorer", "trips_completed", 1, 1),
    ("photo_collector", "Photo Collector", "photos_travelling", 500, None),
    ("world_citizen", "World Citizen", "countries_visited", 5, None),
]


def achievements(stats: DataFrame) -> DataFrame:
    """One row per achievement: reached or not, progress, and percent (at most 100)."""
    row = lambda key, name, stat, target, fixed: F.struct(
        F.lit(key).alias("achievement_id"), F.lit(name).alias("title"), (F.col(stat) >= target).alias("is_unlocked"),
        (F.lit(float(fixed)) if fixed is not None else F.col(stat).cast("double")).alias("progress"), F.lit(float(target)).alias("target"),
    )
    out = stats.select(F.inline(F.array(*[row(*a) for a in ACHIEVEMENTS])))
    return out.withColumn("percent", F.least(F.lit(100.0), F.col("progress") / F.col("target") * 100))


def cards(stats: DataFrame) -> DataFrame:
    """Six labelled values; the year and month are those of the last travel date."""
    none = F.lit("---")
    items = [
        ("Most Travelled Year", F.coalesce(F.year("last_travel_date").cast("string"), none)),
        ("Most Travelled Month", F.coalesce(F.date_format("last_travel_date", "MMMM"), none)),
        ("Longest Vacation", F.concat(F.round("avg_duration_days").cast("bigint").cast("string"), F.lit(" days avg"))),
        ("Photos Per Trip", F.round("avg_photos_per_trip").cast("bigint").cast("string")),
        ("Total Distance", F.concat(F.format_number("total_distance_km", 0), F.lit(" km"))),
        ("Travel Days", F.col("travel_days").cast("string")),
    ]
    return stats.select(F.inline(F.array(*[F.struct(F.lit(t).alias("title"), v.alias("value")) for t, v in items])))


def highlights(photos: DataFrame, trips: DataFrame, favorites: int = 5, recent: int = 3) -> DataFrame:
    """The latest favourite photos with a place, and the latest trips."""
    liked = photos.where("is_favorite AND lat IS NOT NULL").orderBy(F.desc_nulls_last("date_taken"), F.desc("id")).limit(favorites)
    a = liked.select(F.concat(F.lit("fav_"), F.col("id").cast("string")).alias("id"), F.lit("Favorite").alias("category"), F.lit("Favorite Memory").alias("title"), F.lit(None).cast("string").alias("description"), F.col("date_taken").alias("date"))
    went = trips.orderBy(F.desc("start_date"), F.desc("trip_id")).limit(recent)
    text = F.concat(F.date_format("start_date", "MMM yyyy"), F.lit(" · "), whole_days().cast("string"), F.lit(" days"))
    b = went.select(F.concat(F.lit("trip_"), F.col("trip_id").cast("string")).alias("id"), F.lit("Trip").alias("category"), F.col("name").alias("title"), text.alias("description"), F.col("start_date").alias("date"))
    return a.unionByName(b)
