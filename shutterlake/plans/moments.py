"""Queries of the chain signals, candidates, scores, ranking, memories, schedules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import memories as M
from ..operators.storage import settled
from ..sources.views import view
from .registry import AS_OF, query

EFF = "coalesce(date_taken, modified_utc)"
NOW = f"TIMESTAMP '{AS_OF}'"


def _now():
    return F.to_timestamp_ntz(F.lit(AS_OF))


def _photos(spark, sf_dir):
    return view(spark, sf_dir, "photos_v")


def _signals(spark, sf_dir):
    return M.photo_signals(_photos(spark, sf_dir), _now())


_SEASON = "CASE WHEN month(date_taken) IN (3, 4, 5) THEN 'Spring' WHEN month(date_taken) IN (6, 7, 8) THEN 'Summer' WHEN month(date_taken) IN (9, 10, 11) THEN 'Autumn' ELSE 'Winter' END"
_FADE = f"exp(-0.15 * (year({NOW}) - year(date_taken)))"
_DOY = f"abs(dayofyear({NOW}) - dayofyear(date_taken))"


@query(f"""SELECT id, year(date_taken)::INT AS year, (year({NOW}) - year(date_taken))::INT AS year_delta, {_SEASON} AS season, month(date_taken) = 1 AND day(date_taken) = 15 AS is_anniversary,
    CASE WHEN month(date_taken) = 1 AND day(date_taken) = 1 THEN 'New Year' WHEN month(date_taken) = 2 AND day(date_taken) = 14 THEN 'Valentine''s Day' WHEN month(date_taken) = 10 AND day(date_taken) = 31 THEN 'Halloween'
         WHEN month(date_taken) = 12 AND day(date_taken) IN (24, 25, 26) THEN 'Christmas' END AS holiday,
    round(CASE WHEN year({NOW}) <= year(date_taken) THEN 0 WHEN {_DOY} <= 3 THEN (1 - {_DOY} / 3) * {_FADE} WHEN year({NOW}) - year(date_taken) > 5 AND {_DOY} <= 7 THEN 0.3 * {_FADE} ELSE 0 END, 9) AS weight
    FROM photos_v WHERE date_taken IS NOT NULL""")
def temporal_signal(spark, sf_dir):
    t = F.col("temporal")
    out = _signals(spark, sf_dir).where("temporal IS NOT NULL")
    return out.select("id", *[t[c].alias(c) for c in ("year", "year_delta", "season", "is_anniversary", "holiday")], F.round(t["weight"], 9).alias("weight"))


def _geohash_sql(precision: int = 5) -> str:
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    cell = lambda v, span, n: f"greatest(0, least({2**n - 1}, ceil(({v} + {span / 2}) / {span} * {2**n}) - 1))::BIGINT"
    bit = lambda i: f"(({cell('lon', 360.0, nx)} >> {nx - 1 - i // 2}) & 1)" if i % 2 == 0 else f"(({cell('lat', 180.0, ny)} >> {ny - 1 - i // 2}) & 1)"
    digit = lambda k: "1 + " + " + ".join(f"{2 ** (4 - j)} * {bit(k + j)}" for j in range(5))
    return " || ".join(f"substr('{S.GEOHASH_DIGITS}', ({digit(k)})::INT, 1)" for k in range(0, bits, 5))


@query(f"SELECT id, {_geohash_sql()} AS geohash FROM photos_v WHERE lat IS NOT NULL AND lon IS NOT NULL")
def spatial_geohash(spark, sf_dir):
    return _signals(spark, sf_dir).where("spatial IS NOT NULL").select("id", "spatial.geohash")


_QUALITY = "CASE WHEN width > 2000 AND height > 1500 THEN 0.9 WHEN width > 1000 THEN 0.7 WHEN width > 500 THEN 0.5 ELSE 0.3 END::DOUBLE"


@query(f"SELECT id, {_QUALITY} AS sharpness, round({_QUALITY} * 0.35 + 0.48, 9) AS overall FROM photos_v")
def quality_signal(spark, sf_dir):
    return _signals(spark, sf_dir).select("id", "quality.sharpness", F.round("quality.overall", 9).alias("overall"))


@query("SELECT id, coalesce(camera_make, '') AS make, coalesce(camera_make, '') = 'Canon' AS is_dslr, CASE WHEN camera_make = 'Canon' THEN 1.15 ELSE 1.0 END::DOUBLE AS weight FROM photos_v")
def camera_signal(spark, sf_dir):
    return _signals(spark, sf_dir).select("id", "camera.make", "camera.is_dslr", "camera.weight")


@query("SELECT id, is_favorite, CASE WHEN is_favorite THEN 1.0 ELSE 0.3 END::DOUBLE AS engagement FROM photos_v")
def behavior_signal(spark, sf_dir):
    return _signals(spark, sf_dir).select("id", "behavior.is_favorite", "behavior.engagement")


@query("""SELECT photo_id, count(*) AS total_faces, round(avg(confidence), 9) AS avg_confidence, coalesce(string_agg(CAST(person_id AS VARCHAR), ',' ORDER BY person_id) FILTER (NOT is_unassigned), '') AS known,
    round(least(1.0, count(*) * 0.15), 9)::DOUBLE AS weight FROM faces_v GROUP BY 1""")
def social_signal(spark, sf_dir):
    out = M.social_signals(view(spark, sf_dir, "faces_v"))
    return out.select("photo_id", "total_faces", F.round("avg_confidence", 9).alias("avg_confidence"), F.array_join(F.col("known_person_ids").cast("array<string>"), ",").alias("known"), F.round("weight", 9).alias("weight"))


@query("SELECT id, CASE WHEN date_taken IS NOT NULL THEN year(date_taken)::VARCHAR END AS year, coalesce(camera_make, '') AS make, CASE WHEN date_taken IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL THEN 'unknown' END AS weather FROM photos_v")
def signals_json(spark, sf_dir):
    texts = M.signals_json(_signals(spark, sf_dir), ["temporal", "camera", "weather", "semantic", "burst"])
    field = lambda s, f: M.signal_field(F.col("signals"), s, f)
    return texts.select("id", field("temporal", "year").alias("year"), field("camera", "make").alias("make"), field("weather", "condition").alias("weather"))


# Candidates of batches of 200 ids.

_BATCH = "floor(id / 200)::BIGINT AS batch"


def _batched(spark, sf_dir):
    return M.batches(_photos(spark, sf_dir))


def _listed(out):
    return out.select("batch", "id", F.array_join(F.col("photo_ids").cast("array<string>"), ",").alias("photo_ids"), "date_start", "date_end", F.round("score", 6).alias("score"))


_IDS = "string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS photo_ids"


@query(f"""WITH p AS (SELECT *, {_BATCH}, month(date_taken) = 1 AND day(date_taken) = 15 AND year(date_taken) < year({NOW}) - 1 AS hit FROM photos_v WHERE date_taken IS NOT NULL)
    SELECT batch, 'Day:' || batch || ':day' AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (hit) AS photo_ids, min(date_taken) FILTER (hit) AS date_start, max(date_taken) FILTER (hit) AS date_end, round(count(*) FILTER (hit) * 0.1::DOUBLE, 6) AS score
    FROM p GROUP BY batch HAVING count(*) >= 3 AND count(*) FILTER (hit) >= 2""")
def on_this_day(spark, sf_dir):
    return _listed(M.on_this_day(_batched(spark, sf_dir), _now()))


@query(f"""WITH p AS (SELECT floor(p.id / 200)::BIGINT AS batch, p.id, person_id FROM photos_v p JOIN faces_v f ON f.photo_id = p.id WHERE NOT is_unassigned)
    SELECT batch, 'Person:' || batch || ':' || person_id AS id, string_agg(DISTINCT CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS photo_ids, NULL::TIMESTAMP AS date_start, NULL::TIMESTAMP AS date_end, round(count(*) * 0.12::DOUBLE, 6) AS score
    FROM p GROUP BY batch, person_id HAVING count(*) >= 3""")
def person_memories(spark, sf_dir):
    out = M.person_candidates(_batched(spark, sf_dir), view(spark, sf_dir, "faces_v"))
    return _listed(out.withColumn("photo_ids", F.array_sort(F.col("photo_ids").cast("array<string>"))))


@query(f"""WITH p AS (SELECT *, floor(id / 5000)::BIGINT AS batch, {EFF} AS eff, round(round_even(lat, 2) * 100)::INT || ',' || round(round_even(lon, 2) * 100)::INT AS cell FROM photos_v WHERE lat IS NOT NULL AND lon IS NOT NULL)
    SELECT batch, 'Location:' || batch || ':' || cell AS id, {_IDS}, min(eff) AS date_start, max(eff) AS date_end, round(count(*) * 0.08::DOUBLE, 6) AS score FROM p GROUP BY batch, cell HAVING count(*) >= 3""")
def location_memories(spark, sf_dir):
    """Batches of 200 hold too few photos of one cell; these have 5000."""
    return _listed(M.location_candidates(M.batches(_photos(spark, sf_dir), 5000)))


@query(f"""WITH p AS (SELECT *, {_BATCH}, {EFF} AS eff FROM photos_v), l AS (SELECT *, lag(eff) OVER (PARTITION BY batch ORDER BY eff, id) AS e0 FROM p),
    s AS (SELECT *, sum(CASE WHEN e0 IS NULL OR eff - e0 > INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY batch ORDER BY eff, id)::BIGINT AS session FROM l)
    SELECT batch, 'Activity:' || batch || ':' || session AS id, {_IDS}, min(eff) AS date_start, max(eff) AS date_end, round(count(*) * 0.07::DOUBLE, 6) AS score FROM s GROUP BY batch, session HAVING count(*) >= 3""")
def activity_memories(spark, sf_dir):
    return _listed(M.activity_candidates(_batched(spark, sf_dir)))


_HOLIDAY = """CASE WHEN month(date_taken) = 1 AND abs(day(date_taken) - 1) <= 2 THEN 'New Year' WHEN month(date_taken) = 2 AND abs(day(date_taken) - 14) <= 1 THEN 'Valentine''s Day'
    WHEN month(date_taken) = 10 AND abs(day(date_taken) - 31) <= 1 THEN 'Halloween' WHEN month(date_taken) = 12 AND abs(day(date_taken) - 25) <= 3 THEN 'Christmas' END"""


@query(f"""WITH p AS (SELECT *, {_BATCH}, {_HOLIDAY} AS holiday FROM photos_v)
    SELECT batch, 'Holiday:' || batch || ':' || holiday AS id, {_IDS}, NULL::TIMESTAMP AS date_start, NULL::TIMESTAMP AS date_end, round(count(*) * CASE WHEN holiday = 'Christmas' THEN 0.15 ELSE 0.1 END::DOUBLE, 6) AS score
    FROM p WHERE holiday IS NOT NULL GROUP BY batch, holiday HAVING count(*) >= 2""")
def holiday_memories(spark, sf_dir):
    return _listed(M.holiday_candidates(_batched(spark, sf_dir)))


@query(f"""WITH p AS (SELECT *, {_BATCH} FROM photos_v WHERE date_taken >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND date_taken <= TIMESTAMP '2024-01-20')
    SELECT batch, 'Week:' || batch || ':Week' AS id, {_IDS}, min(date_taken) AS date_start, max(date_taken) AS date_end, round(count(*) * 0.1::DOUBLE, 6) AS score FROM p GROUP BY batch HAVING count(*) >= 3""")
def week_memories(spark, sf_dir):
    return _listed(M.recent_period(_batched(spark, sf_dir), F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")), 7, "Week"))


def _candidates(spark, sf_dir):
    photos = _batched(spark, sf_dir)
    all_kinds = [M.on_this_day(photos, _now()), M.person_candidates(photos, view(spark, sf_dir, "faces_v")), M.location_candidates(photos), M.activity_candidates(photos), M.holiday_candidates(photos)]
    return settled(reduce(lambda a, b: a.unionByName(b), all_kinds))


_CELL = "round(round_even(lat, 2) * 100)::INT || ',' || round(round_even(lon, 2) * 100)::INT"
_HIT = f"month(date_taken) = 1 AND day(date_taken) = 15 AND year(date_taken) < year({NOW}) - 1"
#: All candidates (c), merged in one pass per batch (m), scored (s) and ranked in one pass per batch (r).
_CHAIN = f"""WITH RECURSIVE p AS (SELECT *, {_BATCH}, {EFF} AS eff, {_HOLIDAY} AS holiday, {_CELL} AS cell, coalesce({_HIT}, false) AS hit FROM photos_v),
    gap AS (SELECT *, lag(eff) OVER (PARTITION BY batch ORDER BY eff, id) AS e0 FROM p),
    act AS (SELECT *, sum(CASE WHEN e0 IS NULL OR eff - e0 > INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY batch ORDER BY eff, id)::BIGINT AS session FROM gap),
    c AS (SELECT batch, 'Day' AS type, 'Day:' || batch || ':day' AS id, list(id ORDER BY id) FILTER (hit) AS photos, []::BIGINT[] AS persons, min(date_taken) FILTER (hit) AS date_start, max(date_taken) FILTER (hit) AS date_end,
            'On This Day' AS act, NULL::VARCHAR AS spot, NULL::VARCHAR AS hol, count(*) FILTER (hit) * 0.1::DOUBLE AS score FROM p WHERE date_taken IS NOT NULL GROUP BY batch HAVING count(*) >= 3 AND count(*) FILTER (hit) >= 2
        UNION ALL SELECT batch, 'Person', 'Person:' || batch || ':' || person_id, list(DISTINCT p.id ORDER BY p.id), [person_id], NULL, NULL, 'Moments with Person ' || person_id, NULL, NULL, count(*) * 0.12::DOUBLE
            FROM p JOIN faces_v f ON f.photo_id = p.id WHERE NOT is_unassigned GROUP BY batch, person_id HAVING count(*) >= 3
        UNION ALL SELECT batch, 'Location', 'Location:' || batch || ':' || cell, list(id ORDER BY id), [], min(eff), max(eff), NULL, cell, NULL, count(*) * 0.08::DOUBLE FROM p WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY batch, cell HAVING count(*) >= 3
        UNION ALL SELECT batch, 'Activity', 'Activity:' || batch || ':' || session, list(id ORDER BY id), [], min(eff), max(eff), 'Moments', NULL, NULL, count(*) * 0.07::DOUBLE FROM act GROUP BY batch, session HAVING count(*) >= 3
        UNION ALL SELECT batch, 'Holiday', 'Holiday:' || batch || ':' || holiday, list(id ORDER BY id), [], NULL, NULL, NULL, NULL, holiday, count(*) * CASE WHEN holiday = 'Christmas' THEN 0.15 ELSE 0.1 END::DOUBLE
            FROM p WHERE holiday IS NOT NULL GROUP BY batch, holiday HAVING count(*) >= 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY score DESC, id) AS k FROM c),
    e AS (SELECT a.batch, a.k AS ak, b.k AS bk FROM o a JOIN o b ON a.batch = b.batch AND a.k < b.k, LATERAL (SELECT len(list_intersect(a.photos, b.photos)) AS n) WHERE n / (len(a.photos) + len(b.photos) - n) > 0.5),
    pass(batch, k, leads) AS (SELECT batch, 1::BIGINT, [1::BIGINT] FROM o WHERE k = 1 UNION ALL
        SELECT pass.batch, pass.k + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.batch = pass.batch AND bk = pass.k + 1 AND list_contains(leads, ak)) THEN leads ELSE list_append(leads, o.k) END
        FROM pass JOIN o ON o.batch = pass.batch AND o.k = pass.k + 1),
    led AS (SELECT o.batch, o.k, CASE WHEN list_contains(leads, o.k) THEN o.k ELSE (SELECT min(ak) FROM e WHERE e.batch = o.batch AND bk = o.k AND list_contains(leads, ak)) END AS leader
        FROM o JOIN (SELECT batch, arg_max(leads, k) AS leads FROM pass GROUP BY 1) USING (batch)),
    u AS (SELECT batch, leader AS k, list_sort(list_distinct(flatten(list(photos)))) AS photos, list_sort(list_distinct(flatten(list(persons)))) AS persons FROM o JOIN led USING (batch, k) GROUP BY batch, leader),
    m AS (SELECT o.* EXCLUDE (photos, persons, k), u.photos, u.persons FROM o JOIN u USING (batch, k)),
    t AS (SELECT *, 0.20 * least(1.0, len(photos) * 0.02) + 0.25 * least(1.0, len(persons) * 0.15) + 0.15 * least(1.0, len(photos) * 0.01)
        + CASE WHEN act IS NULL THEN 0.0 ELSE 0.05 END + CASE WHEN spot IS NULL THEN 0.0 ELSE 0.04 END + CASE WHEN hol IS NULL THEN 0.0 ELSE 0.15 END AS total FROM m),
    s AS (SELECT * EXCLUDE (score, total), least(1.0, total * (0.7 + 0.3 * log10(len(photos) + 1) / log10(101.0)))::DOUBLE AS score FROM t),
    q AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY round(score, 12) DESC, id) AS k FROM s),
    pick(batch, k, taken) AS (SELECT DISTINCT batch, 0::BIGINT, []::STRUCT(k BIGINT, d DATE, persons BIGINT[], spot VARCHAR)[] FROM q UNION ALL
        SELECT q.batch, q.k, CASE WHEN len(taken) >= 50 OR len(list_filter(taken, lambda t: t.d IS NOT DISTINCT FROM date_start::DATE)) >= 3
            OR len(list_filter(persons, lambda w: len(list_filter(taken, lambda t: list_contains(t.persons, w))) >= 2)) > 0 OR len(list_filter(taken, lambda t: coalesce(t.spot = q.spot, false))) >= 1
            THEN taken ELSE list_append(taken, {{'k': q.k, 'd': date_start::DATE, 'persons': persons, 'spot': q.spot}}) END FROM pick JOIN q ON q.batch = pick.batch AND q.k = pick.k + 1),
    r AS (SELECT q.*, list_position(list_transform(taken, lambda t: t.k), q.k)::INT - 1 AS place FROM q JOIN (SELECT batch, arg_max(taken, k) AS taken FROM pick GROUP BY 1) USING (batch) WHERE list_contains(list_transform(taken, lambda t: t.k), q.k))"""


@query(f"{_CHAIN} SELECT batch, id, array_to_string(photos, ',') AS photo_ids, date_start, date_end, round(score, 6) AS score FROM m")
def memory_candidates_merged(spark, sf_dir):
    return _listed(M.merged(_candidates(spark, sf_dir)))


@query(f"{_CHAIN} SELECT batch, id, type, round(score, 6) AS score FROM s")
def memory_scores(spark, sf_dir):
    return M.score(M.merged(_candidates(spark, sf_dir))).select("batch", "id", "type", F.round("score", 6).alias("score"))


@query(f"{_CHAIN} SELECT batch, id, type, place FROM r")
def memory_ranked(spark, sf_dir):
    return M.ranked(M.score(M.merged(_candidates(spark, sf_dir)))).select("batch", "id", "type", "place")


@query(f"""{_CHAIN}, d AS (SELECT *, len(photos) AS n, coalesce(date_start, {NOW}) AS shown_start, coalesce(date_end, {NOW}) AS shown_end FROM r),
    y AS (SELECT *, floor((epoch_us(shown_end) - epoch_us(shown_start)) / 86400000000.0)::BIGINT + 1 AS days FROM d)
    SELECT id, CASE type WHEN 'Location' THEN 'At ' || spot WHEN 'Holiday' THEN hol || ' Memories' ELSE act END AS title,
        n || ' photo' || CASE WHEN n <> 1 THEN 's' ELSE '' END || CASE WHEN days > 1 THEN ' • ' || days || ' days' ELSE '' END AS subtitle, photos[1] AS cover_photo_id, shown_start, shown_end FROM y""")
def memory_titles(spark, sf_dir):
    out = M.assembled(M.ranked(M.score(M.merged(_candidates(spark, sf_dir)))), _now())
    return out.select("id", "title", "subtitle", "cover_photo_id", "shown_start", "shown_end")


@query(f"""WITH p AS (SELECT *, {_BATCH}, {_HOLIDAY} AS holiday FROM photos_v),
    c AS (SELECT 'Holiday:' || batch || ':' || holiday AS memory_id, list(id ORDER BY id) AS ids FROM p WHERE holiday IS NOT NULL GROUP BY batch, holiday HAVING count(*) >= 2),
    u AS (SELECT memory_id, unnest(ids) AS photo_id, generate_subscripts(ids, 1)::INT - 1 AS sort_order FROM c)
    SELECT memory_id, photo_id, sort_order, CASE WHEN sort_order = 0 THEN 'Cover' ELSE 'Supporting' END AS role FROM u""")
def memory_photos(spark, sf_dir):
    return M.memory_photos(M.holiday_candidates(_batched(spark, sf_dir)))


def _score_sql(n: str, hint: str) -> str:
    return f"(0.20 * least(1, 0.02 * {n}) + 0.15 * least(1, 0.01 * {n}) + {hint}) * (0.7 + 0.3 * log10({n} + 1) / log10(101))"


@query(f"""WITH p AS (SELECT *, {_BATCH}, {_HOLIDAY} AS holiday FROM photos_v),
    c AS (SELECT 'Holiday:' || batch || ':' || holiday AS id, count(*) AS n FROM p WHERE holiday IS NOT NULL GROUP BY batch, holiday HAVING count(*) >= 2)
    SELECT id, round({_score_sql('n', '0.15')}, 6)::DOUBLE AS score FROM c""")
def holiday_scores(spark, sf_dir):
    return M.score(M.holiday_candidates(_batched(spark, sf_dir))).select("id", F.round("score", 6).alias("score"))


# Stored memories and their schedules, made from trips.

_MEM = "SELECT trip_id AS id, start_date AS date_start, distance_km / 500 AS score, trip_id % 9 = 0 AS dismissed, trip_id % 11 = 0 AS is_archived, CASE WHEN trip_id % 4 = 0 THEN NULL ELSE end_date END AS last_shown_at FROM trips_v"


def _memories(spark, sf_dir):
    return view(spark, sf_dir, "trips_v").selectExpr(
        "trip_id AS id", "start_date AS date_start", "distance_km / 500 AS score", "trip_id % 9 = 0 AS dismissed", "trip_id % 11 = 0 AS is_archived", "CASE WHEN trip_id % 4 = 0 THEN NULL ELSE end_date END AS last_shown_at"
    )


@query(f"SELECT id, round(score, 6) AS score FROM ({_MEM}) WHERE NOT dismissed AND NOT is_archived ORDER BY score DESC, id LIMIT 20")
def active_memories(spark, sf_dir):
    return _memories(spark, sf_dir).where("NOT dismissed AND NOT is_archived").orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, date_start FROM ({_MEM}) WHERE date_start >= TIMESTAMP '1996-03-01' AND date_start < TIMESTAMP '1996-03-02' AND NOT dismissed")
def memories_of_day(spark, sf_dir):
    day = F.to_timestamp_ntz(F.lit("1996-03-01 00:00:00"))
    return _memories(spark, sf_dir).where((F.col("date_start") >= day) & (F.col("date_start") < day + F.expr("INTERVAL 1 DAY")) & ~F.col("dismissed")).select("id", "date_start")


@query(f"SELECT id FROM ({_MEM}) WHERE month(date_start) = 1 AND day(date_start) = 15 AND year(date_start) < year({NOW}) - 1")
def memories_on_this_day(spark, sf_dir):
    d = F.col("date_start")
    return _memories(spark, sf_dir).where((F.month(d) == F.month(_now())) & (F.dayofmonth(d) == F.dayofmonth(_now())) & (F.year(d) < F.year(_now()) - 1)).select("id")


@query("SELECT id FROM (SELECT trip_id AS id, start_date AS schedule_date, CASE WHEN trip_id % 3 = 0 THEN NULL ELSE end_date END AS last_shown_at FROM trips_v) WHERE schedule_date <= TIMESTAMP '1996-06-01 12:00:00' AND (last_shown_at IS NULL OR last_shown_at < TIMESTAMP '1996-06-01')")
def due_schedules(spark, sf_dir):
    plans = view(spark, sf_dir, "trips_v").selectExpr("trip_id AS id", "start_date AS schedule_date", "CASE WHEN trip_id % 3 = 0 THEN NULL ELSE end_date END AS last_shown_at")
    return M.due_schedules(plans, F.to_timestamp_ntz(F.lit("1996-06-01 12:00:00"))).select("id")


@query(f"SELECT id, is_archived OR coalesce(last_shown_at < TIMESTAMP '1996-06-01' - INTERVAL 90 DAY, false) AS is_archived FROM ({_MEM})")
def archive_stale(spark, sf_dir):
    return M.stale_archived(_memories(spark, sf_dir), F.to_timestamp_ntz(F.lit("1996-06-01 00:00:00"))).select("id", "is_archived")


@query(f"SELECT id FROM ({_MEM}) WHERE last_shown_at IS NULL OR last_shown_at >= TIMESTAMP '1996-06-01'")
def cache_expired(spark, sf_dir):
    return _memories(spark, sf_dir).where(F.col("last_shown_at").isNull() | (F.col("last_shown_at") >= F.to_timestamp_ntz(F.lit("1996-06-01 00:00:00")))).select("id")


@query(f"SELECT id, date_start FROM ({_MEM}) ORDER BY date_start DESC, id DESC LIMIT 25")
def memory_history(spark, sf_dir):
    return _memories(spark, sf_dir).orderBy(F.desc("date_start"), F.desc("id")).limit(25).select("id", "date_start")
