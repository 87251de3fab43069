"""Queries over trips, activities, places and travel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import sessions as X, tables as T, travel as V
from ..sources.views import view
from .registry import query

EFF = "coalesce(date_taken, modified_utc)"


def _km(a: str, b: str) -> str:
    h = f"pow(sin(radians(lat - {a}) / 2), 2) + cos(radians({a})) * cos(radians(lat)) * pow(sin(radians(lon - {b}) / 2), 2)"
    return f"(2 * 6371.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - ({h}))))"


_TRIPS = f"""WITH p AS (SELECT *, lag(date_taken) OVER w AS d0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM photos_v WHERE date_taken IS NOT NULL AND lat IS NOT NULL
        WINDOW w AS (PARTITION BY folder_id ORDER BY date_taken, id)),
    k AS (SELECT *, {_km("lat0", "lon0")} AS km FROM p),
    s AS (SELECT *, sum(CASE WHEN d0 IS NULL OR date_taken - d0 > INTERVAL 3 DAY OR km > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY folder_id ORDER BY date_taken, id)::BIGINT AS trip FROM k),
    t AS (SELECT *, CASE WHEN lag(trip) OVER (PARTITION BY folder_id ORDER BY date_taken, id) = trip THEN km END AS step_km FROM s QUALIFY count(*) OVER (PARTITION BY folder_id, trip) >= 3)"""


def _trip_photos(spark, sf_dir):
    return X.trip_sessions(view(spark, sf_dir, "photos_v"), ["folder_id"])


@query(f"{_TRIPS} SELECT id, folder_id, trip FROM t")
def trip_sessions(spark, sf_dir):
    return _trip_photos(spark, sf_dir).select("id", "folder_id", "trip")


@query(f"""{_TRIPS} SELECT folder_id, trip, min(date_taken) AS start_date, max(date_taken) AS end_date, arg_min(lat, (date_taken, id)) AS start_lat, arg_min(lon, (date_taken, id)) AS start_lon,
    arg_max(lat, (date_taken, id)) AS end_lat, arg_max(lon, (date_taken, id)) AS end_lon, arg_min(id, (date_taken, id)) AS cover_photo_id, count(*) AS photo_count,
    count(*) FILTER (ext IN ('.mp4', '.mov')) AS video_count, count(DISTINCT (round_even(lat, 2), round_even(lon, 2))) AS place_count, round_even(coalesce(sum(step_km), 0), 1) AS distance_km FROM t GROUP BY 1, 2""")
def trip_summary(spark, sf_dir):
    return X.trip_summary(_trip_photos(spark, sf_dir), ["folder_id"])


@query(f"{_TRIPS} SELECT id, round(step_km, 3) AS step_km FROM t")
def trip_distance(spark, sf_dir):
    return _trip_photos(spark, sf_dir).select("id", F.round("step_km", 3).alias("step_km"))


@query(f"""WITH p AS (SELECT folder_id, id, {EFF} AS eff, lag({EFF}) OVER (PARTITION BY folder_id ORDER BY {EFF}, id) AS e0 FROM photos_v),
    s AS (SELECT *, sum(CASE WHEN e0 IS NULL OR eff - e0 > INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY folder_id ORDER BY eff, id)::BIGINT AS session FROM p)
    SELECT folder_id, session, min(eff) AS date_start, max(eff) AS date_end, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS photo_ids FROM s GROUP BY 1, 2 HAVING count(*) >= 3""")
def activity_sessions(spark, sf_dir):
    return X.activity_sessions(view(spark, sf_dir, "photos_v"), ["folder_id"]).withColumn("photo_ids", F.array_join(F.col("photo_ids").cast("array<string>"), ","))


#: Photos of all folders interleave here, so one order over the library needs a wider reach and a shorter pause than one folder.
_REACH_KM, _PAUSE_MINUTES = 6000, 15
_LIBRARY_TRIPS = f"""WITH p AS (SELECT *, lag(date_taken) OVER w AS d0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM photos_v WHERE date_taken IS NOT NULL AND lat IS NOT NULL
        WINDOW w AS (ORDER BY date_taken, id)),
    k AS (SELECT *, {_km("lat0", "lon0")} AS km FROM p),
    f AS (SELECT *, CASE WHEN d0 IS NULL OR date_taken - d0 > INTERVAL 3 DAY OR km > {_REACH_KM} THEN 1 ELSE 0 END AS starts FROM k),
    s AS (SELECT *, sum(starts) OVER (ORDER BY date_taken, id)::BIGINT AS trip FROM f),
    t AS (SELECT *, CASE WHEN starts = 0 THEN km END AS step_km FROM s QUALIFY count(*) OVER (PARTITION BY trip) >= 3)"""


def _library_trips(spark, sf_dir):
    return X.library_trips(view(spark, sf_dir, "photos_v").select("id", "date_taken", "lat", "lon", "ext"), max_km=_REACH_KM)


@query(f"{_LIBRARY_TRIPS} SELECT id, trip, round(step_km, 3) AS step_km FROM t")
def trip_sessions_library(spark, sf_dir):
    """Trips over one order of all photos, with the distance to the photo before."""
    return _library_trips(spark, sf_dir).select("id", "trip", F.round("step_km", 3).alias("step_km"))


@query(f"""{_LIBRARY_TRIPS} SELECT trip, min(date_taken) AS start_date, max(date_taken) AS end_date, arg_min(lat, (date_taken, id)) AS start_lat, arg_min(lon, (date_taken, id)) AS start_lon,
    arg_max(lat, (date_taken, id)) AS end_lat, arg_max(lon, (date_taken, id)) AS end_lon, arg_min(id, (date_taken, id)) AS cover_photo_id, count(*) AS photo_count,
    count(*) FILTER (ext IN ('.mp4', '.mov')) AS video_count, count(DISTINCT (round_even(lat, 2), round_even(lon, 2))) AS place_count, round_even(coalesce(sum(step_km), 0), 1) AS distance_km FROM t GROUP BY 1""")
def trip_summary_library(spark, sf_dir):
    return X.trip_summary(_library_trips(spark, sf_dir), [])


_LIBRARY_ACTIVITIES = f"""WITH p AS (SELECT id, {EFF} AS eff, lag({EFF}) OVER (ORDER BY {EFF}, id) AS e0 FROM photos_v),
    s AS (SELECT *, sum(CASE WHEN e0 IS NULL OR eff - e0 > INTERVAL {_PAUSE_MINUTES} MINUTE THEN 1 ELSE 0 END) OVER (ORDER BY eff, id)::BIGINT AS session FROM p),
    t AS (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY session) >= 3)"""


def _library_activities(spark, sf_dir):
    return X.library_activities(view(spark, sf_dir, "photos_v").select("id", "date_taken", "modified_utc"), _PAUSE_MINUTES / 60)


@query(f"{_LIBRARY_ACTIVITIES} SELECT id, session FROM t")
def activity_members_library(spark, sf_dir):
    return _library_activities(spark, sf_dir).select("id", "session")


@query(f"{_LIBRARY_ACTIVITIES} SELECT session, min(eff) AS date_start, max(eff) AS date_end, count(*) AS n, arg_min(id, (eff, id)) AS first_id, arg_max(id, (eff, id)) AS last_id FROM t GROUP BY 1")
def activity_sessions_library(spark, sf_dir):
    """Activities over one order of all photos."""
    return X.activity_summary(_library_activities(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT id, folder_id, modified_utc AS ts FROM photos_v),
    k(folder_id, ts, id) AS (SELECT folder_id, min(ts), arg_min(id, (ts, id)) FROM e GROUP BY 1 UNION ALL
        SELECT * FROM (SELECT e.folder_id, min(e.ts), arg_min(e.id, (e.ts, e.id)) FROM k JOIN e ON e.folder_id = k.folder_id AND e.ts >= k.ts + INTERVAL 6 HOUR GROUP BY e.folder_id))
    SELECT id, folder_id FROM k""")
def debounced_events(spark, sf_dir):
    events = view(spark, sf_dir, "photos_v").select("id", "folder_id", "modified_utc")
    return X.debounced(events, ["folder_id"], "modified_utc", "id", 6 * 3600 * 1_000_000).select("id", "folder_id")


# Places and travel.


def _travel(spark, sf_dir):
    return [view(spark, sf_dir, f"{n}_v") for n in ("trips", "tripphotos", "tripplaces", "places")]


_COUNTS = "SELECT trip_id, count(*) AS photo_count, count(*) FILTER (ext = '.mp4') AS video_count FROM tripphotos_v GROUP BY 1"


@query("SELECT place_id, any_value(name) AS name, count(*) AS n_photos, min(date_taken) AS first_date, max(date_taken) AS last_date FROM tripplaces_v JOIN tripphotos_v USING (trip_id) JOIN places_v USING (place_id) GROUP BY 1")
def place_stats(spark, sf_dir):
    _, photos, went, places = _travel(spark, sf_dir)
    # Photos are counted per trip before they meet its places.
    per_trip = photos.groupBy("trip_id").agg(F.count("*").alias("n"), F.min("date_taken").alias("a"), F.max("date_taken").alias("b"))
    out = went.join(per_trip, "trip_id").groupBy("place_id").agg(F.sum("n").alias("n_photos"), F.min("a").alias("first_date"), F.max("b").alias("last_date"))
    return out.join(places.select("place_id", "name"), "place_id")


_STATS = """WITH t AS (SELECT count(*) AS trips_completed, sum(distance_km) AS total_distance_km, avg((epoch_us(end_date) - epoch_us(start_date)) / 86400000000 + 1) AS avg_duration_days, min(start_date) AS first_travel_date, max(end_date) AS last_travel_date FROM trips_v),
    parts AS (SELECT name, list_filter(string_split(name, ','), lambda x: x <> '') AS p FROM places_v),
    w AS (SELECT count(*) AS places_visited, greatest(1, count(DISTINCT lower(trim(p[-1]))) FILTER (len(p) >= 2)) AS countries_visited, greatest(1, count(DISTINCT lower(trim(p[2]))) FILTER (len(p) >= 3)) AS states_visited,
        greatest(1, count(DISTINCT lower(trim(p[1]))) FILTER (len(p) >= 2)) AS cities_visited FROM parts),
    s AS (SELECT count(*) AS photos_travelling, count(*) FILTER (ext = '.mp4') AS videos_travelling, count(DISTINCT date_taken::DATE) AS travel_days FROM tripphotos_v),
    g AS (SELECT count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS gps_photos FROM photos_v),
    st AS (SELECT *, photos_travelling / trips_completed AS avg_photos_per_trip FROM t, w, s, g)"""


def _statistics(spark, sf_dir):
    trips, photos, _, places = _travel(spark, sf_dir)
    return V.statistics(trips, photos, places, view(spark, sf_dir, "photos_v"))


@query(f"{_STATS} SELECT * REPLACE (round(total_distance_km, 1) AS total_distance_km, round(avg_duration_days, 6) AS avg_duration_days, round(avg_photos_per_trip, 6) AS avg_photos_per_trip) FROM st")
def travel_stats(spark, sf_dir):
    return _statistics(spark, sf_dir).withColumns({c: F.round(c, n) for c, n in (("total_distance_km", 1), ("avg_duration_days", 6), ("avg_photos_per_trip", 6))})


@query(f"""{_STATS}, a(achievement_id, title, progress, target) AS (SELECT unnest(['first_trip', '10_trips', '100_places', '1000_gps', '10_cities', '5_states', '3_countries', '10000km', 'longest_vacation', 'weekend_explorer', 'photo_collector', 'world_citizen']),
        unnest(['First Trip', 'Frequent Traveller', 'Place Explorer', '1000 GPS Photos', 'City Hopper', 'State Explorer', 'International Traveller', '10,000 KM Club', 'Longest Vacation', 'Weekend Explorer', 'Photo Collector', 'World Citizen']),
        unnest([1, trips_completed, places_visited, gps_photos, cities_visited, states_visited, countries_visited, total_distance_km, avg_duration_days, 1, photos_travelling, countries_visited]::DOUBLE[]),
        unnest([1, 10, 100, 1000, 10, 5, 3, 10000, 7, 1, 500, 5]::DOUBLE[]) FROM st)
    SELECT achievement_id, title, progress >= target AS is_unlocked, round(progress, 3) AS progress, target, round(least(100, progress / target * 100), 3) AS percent FROM a""")
def achievements(spark, sf_dir):
    return V.achievements(_statistics(spark, sf_dir)).withColumns({"progress": F.round("progress", 3), "percent": F.round("percent", 3)})


@query(f"{_STATS} SELECT unnest(['Most Travelled Year', 'Most Travelled Month', 'Longest Vacation', 'Photos Per Trip', 'Total Distance', 'Travel Days']) AS title, unnest([year(last_travel_date)::VARCHAR, strftime(last_travel_date, '%B'), round(avg_duration_days)::BIGINT || ' days avg', round(avg_photos_per_trip)::BIGINT::VARCHAR, format('{{:,}}', round(total_distance_km)::BIGINT) || ' km', travel_days::VARCHAR]) AS value FROM st")
def analytics_cards(spark, sf_dir):
    return V.cards(_statistics(spark, sf_dir))


@query(f"""WITH c AS ({_COUNTS}), d AS (SELECT *, year(start_date)::INT AS year FROM trips_v),
    a AS (SELECT year, count(*) AS trip_count, coalesce(sum(photo_count), 0)::BIGINT AS photo_count, coalesce(sum(video_count), 0)::BIGINT AS video_count, round(sum(distance_km), 1) AS total_distance_km FROM d LEFT JOIN c USING (trip_id) GROUP BY 1),
    b AS (SELECT year, count(DISTINCT name) AS city_count, count(DISTINCT trim(string_split(name, ',')[-1])) AS country_count FROM d2 GROUP BY 1)
    SELECT a.*, coalesce(city_count, 0) AS city_count, coalesce(country_count, 0) AS country_count FROM a LEFT JOIN b USING (year)""".replace("FROM d2", "FROM (SELECT d.year, p.name FROM d JOIN tripplaces_v USING (trip_id) JOIN places_v p USING (place_id))"))
def travel_years(spark, sf_dir):
    return V.by_year(*_travel(spark, sf_dir)).withColumn("total_distance_km", F.round("total_distance_km", 1))


_VISITS = f"SELECT w.trip_id, w.place_id, p.name, p.lat, p.lon, t.start_date, t.end_date, t.distance_km, coalesce(photo_count, 0) AS photo_count FROM tripplaces_v w JOIN places_v p USING (place_id) JOIN trips_v t USING (trip_id) LEFT JOIN ({_COUNTS}) c USING (trip_id)"


@query(f"""SELECT trim(string_split(name, ',')[-1]) AS country, sum(photo_count)::BIGINT AS photo_count, count(DISTINCT trip_id) AS visit_count, count(DISTINCT trim(string_split(name, ',')[1])) AS city_count, min(start_date) AS first_visit, max(end_date) AS last_visit,
    round(sum(distance_km), 1) AS total_distance_km FROM ({_VISITS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_countries(spark, sf_dir):
    return V.top_countries(*_travel(spark, sf_dir)).withColumn("total_distance_km", F.round("total_distance_km", 1))


@query(f"""SELECT trim(string_split(name, ',')[1]) AS city, sum(photo_count)::BIGINT AS photo_count, count(DISTINCT trip_id) AS visit_count, min(start_date) AS first_visit, max(end_date) AS last_visit,
    max(lat) AS lat, max(lon) AS lon FROM ({_VISITS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_cities(spark, sf_dir):
    return V.top_cities(*_travel(spark, sf_dir))


def _mode(expr: str, table: str) -> str:
    return f"(SELECT v FROM (SELECT {expr} AS v, count(*) AS n FROM {table} GROUP BY 1) WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT 1)"


_SPAN = "floor((epoch_us(end_date) - epoch_us(start_date)) / 86400000000)::BIGINT + 1 || ' days (' || name || ')'"


@query(f"""SELECT {_mode('year(start_date)::INT', 'trips_v')} AS best_year, {_mode('month(start_date)::INT', 'trips_v')} AS best_month, {_mode('camera_make', 'tripphotos_v JOIN photos_v ON id = photo_id')} AS camera,
    (SELECT {_SPAN} FROM trips_v ORDER BY end_date - start_date DESC, trip_id LIMIT 1) AS longest, (SELECT {_SPAN} FROM trips_v WHERE end_date >= start_date ORDER BY end_date - start_date, trip_id LIMIT 1) AS shortest,
    (SELECT round_even(avg((epoch_us(end_date) - epoch_us(start_date)) / 86400000000 + 1), 1) FROM trips_v) AS avg_duration_days""")
def travel_modes(spark, sf_dir):
    trips, photos, *_ = _travel(spark, sf_dir)
    return V.modes(trips, view(spark, sf_dir, "photos_v"), photos)


@query(f"""WITH c AS ({_COUNTS}), w AS (SELECT trip_id, count(*) AS place_count, string_agg(trim(string_split(name, ',')[1]), '|' ORDER BY place_id) AS cities FROM tripplaces_v JOIN places_v USING (place_id) GROUP BY 1)
    SELECT trip_id, name, floor((epoch_us(end_date) - epoch_us(start_date)) / 86400000000)::BIGINT + 1 AS duration_days, coalesce(photo_count, 0) AS photo_count, coalesce(video_count, 0) AS video_count, coalesce(place_count, 0) AS place_count, coalesce(cities, '') AS cities
    FROM trips_v LEFT JOIN c USING (trip_id) LEFT JOIN w USING (trip_id)""")
def trip_summaries(spark, sf_dir):
    out = V.trip_summaries(*_travel(spark, sf_dir))
    return out.select("trip_id", "name", "duration_days", "photo_count", "video_count", "place_count", F.coalesce(F.array_join("city_names", "|"), F.lit("")).alias("cities"))


@query("SELECT trip_id, start_date FROM trips_v ORDER BY start_date DESC, trip_id DESC LIMIT 20")
def recent_trips(spark, sf_dir):
    return view(spark, sf_dir, "trips_v").orderBy(F.desc("start_date"), F.desc("trip_id")).limit(20).select("trip_id", "start_date")


@query("""(SELECT 'fav_' || id AS id, 'Favorite' AS category, 'Favorite Memory' AS title, NULL AS description, date_taken AS date FROM photos_v WHERE is_favorite AND lat IS NOT NULL ORDER BY date_taken DESC NULLS LAST, photos_v.id DESC LIMIT 5)
    UNION ALL (SELECT 'trip_' || trip_id, 'Trip', name, strftime(start_date, '%b %Y') || ' · ' || (floor((epoch_us(end_date) - epoch_us(start_date)) / 86400000000)::BIGINT + 1) || ' days', start_date FROM trips_v ORDER BY start_date DESC, trip_id DESC LIMIT 3)""")
def travel_highlights(spark, sf_dir):
    return V.highlights(view(spark, sf_dir, "photos_v"), view(spark, sf_dir, "trips_v"))


@query("SELECT trip_id, CASE WHEN trip_id = 7 THEN 'Renamed' ELSE name END AS name, CASE WHEN trip_id = 7 THEN NOT is_favorite ELSE is_favorite END AS is_favorite FROM trips_v")
def trip_edit(spark, sf_dir):
    trips = view(spark, sf_dir, "trips_v").select("trip_id", "name", "is_favorite")
    edit = trips.where("trip_id = 7").select("trip_id", F.lit("Renamed").alias("name"), (~F.col("is_favorite")).alias("is_favorite"))
    return T.keyed_update(trips, edit, "trip_id", ["name", "is_favorite"])


@query("SELECT name, trim(string_split(name, ',')[1]) AS city, trim(string_split(name, ',')[-1]) AS country FROM places_v")
def place_parts(spark, sf_dir):
    return view(spark, sf_dir, "places_v").select("name", S.city(F.col("name")).alias("city"), S.country(F.col("name")).alias("country"))
