"""Queries that run a stream over the input there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.views import view
from ..streaming import events as E, sinks as K, stateful as T
from .registry import query


def _events(spark, sf_dir):
    return E.table_stream(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")


@query("""WITH p AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t0 FROM events),
    s AS (SELECT *, sum(CASE WHEN t0 IS NULL OR ts - t0 > INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM p),
    g AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, first_ts, last_ts, n FROM g WHERE date_trunc('milliseconds', last_ts + INTERVAL 4 HOUR) <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark has passed."""
    out = E.drained(E.session_counts(_events(spark, sf_dir), "user_id", "ts"))
    return out.selectExpr("user_id", "CAST(first_ts AS TIMESTAMP_NTZ) AS first_ts", "CAST(last_ts AS TIMESTAMP_NTZ) AS last_ts", "n")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts FROM events),
    k(user_id, ts, event_id) AS (SELECT user_id, min(ts), arg_min(event_id, (ts, event_id)) FROM e GROUP BY 1 UNION ALL
        SELECT * FROM (SELECT e.user_id, min(e.ts), arg_min(e.event_id, (e.ts, e.event_id)) FROM k JOIN e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 6 HOUR GROUP BY e.user_id))
    SELECT CAST(user_id AS VARCHAR) AS user_id, event_id FROM k""")
def stream_debounce(spark, sf_dir):
    return E.drained(E.debounce(_events(spark, sf_dir), "user_id", "ts", "event_id", 6 * 3600 * 1_000_000))


@query("SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H') AS hour FROM events GROUP BY ALL")
def stream_dedup(spark, sf_dir):
    """One event of a kind per user and hour, from a stream that brings each event twice."""
    twice = _events(spark, sf_dir).selectExpr("*", "date_format(ts, 'yyyy-MM-dd HH') AS hour")
    return E.drained(E.first_seen(twice.unionAll(twice), ["user_id", "event_type", "hour"], "ts", "2 hours").select("user_id", "event_type", "hour"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    """Daily counts in complete mode: a table that later input corrects."""
    counts = E.tumbling_counts(_events(spark, sf_dir), "ts", "1 day", ["event_type"])
    return E.drained_complete(counts).selectExpr("CAST(window_start AS TIMESTAMP_NTZ) AS window_start", "event_type", "n")


@query("""WITH p AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t0 FROM events),
    s AS (SELECT *, sum(CASE WHEN t0 IS NULL OR ts - t0 > INTERVAL 90 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM p),
    g AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS items, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, first_ts, last_ts, items, n FROM g WHERE date_trunc('milliseconds', last_ts + INTERVAL 90 MINUTE) <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_quiet_batches(spark, sf_dir):
    out = E.drained(E.quiet_batches(_events(spark, sf_dir), "user_id", "ts", "event_id", "90 minutes"))
    return out.selectExpr("user_id", "CAST(first_ts AS TIMESTAMP_NTZ) AS first_ts", "CAST(last_ts AS TIMESTAMP_NTZ) AS last_ts", "array_join(CAST(items AS ARRAY<STRING>), ',') AS items", "CAST(size(items) AS BIGINT) AS n")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def stream_persisted(spark, sf_dir):
    """Every event once, committed batch by batch."""
    out = E.persisted(_events(spark, sf_dir))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.sum("user_id").alias("users"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts FROM events),
    k(user_id, ts, event_id, kept_no) AS (SELECT user_id, min(ts), arg_min(event_id, (ts, event_id)), 1::BIGINT FROM e GROUP BY 1 UNION ALL
        SELECT * FROM (SELECT e.user_id, min(e.ts), arg_min(e.event_id, (e.ts, e.event_id)), max(kept_no) + 1 FROM k JOIN e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 6 HOUR GROUP BY e.user_id))
    SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, kept_no FROM k""")
def stream_debounce_stateful(spark, sf_dir):
    """Debouncing in several micro-batches with state variables and timers."""
    events = view(spark, sf_dir, "photos_v").selectExpr("id AS event_id", "folder_id AS user_id", "modified_utc - INTERVAL 1 DAY AS ts")

    def use(stream, at):
        with T.large_state(spark):
            return E.drained(T.debounce(stream, "user_id", "ts", "event_id", 6 * 3600 * 1_000_000, forget_ms=400 * 86_400_000))

    return E.in_batches(spark, events, "ts", 3)(use)


def _sinks():
    """What each type of event leaves."""
    return {
        "purchase": K.Sink(F.col("event_type") == "purchase", [F.col("event_id"), F.round("value", 2).alias("amount")]),
        "signup": K.Sink(F.col("event_type") == "signup", [F.col("event_id"), F.col("user_id").cast("double").alias("amount")]),
        "seen": K.Sink(F.col("event_type").isin("view", "click"), [F.col("event_id"), F.get_json_object("props", "$.k").cast("double").alias("amount")]),
    }


@query("""SELECT 'purchase' AS sink, event_id, round(value, 2) AS amount FROM events WHERE event_type = 'purchase' UNION ALL
    SELECT 'signup', event_id, CAST(user_id AS DOUBLE) FROM events WHERE event_type = 'signup' UNION ALL
    SELECT 'seen', event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events WHERE event_type IN ('view', 'click')""")
def stream_fan_out(spark, sf_dir):
    """One pass over a stream into a sink per type of event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "props")

    def use(stream, at):
        sinks = _sinks()
        E.run_batches(stream, K.fan_out(f"{at}/sinks", sinks), f"{at}/log")
        parts = [spark.read.schema("event_id long, amount double").parquet(f"{at}/sinks/{n}").select(F.lit(n).alias("sink"), "event_id", "amount") for n in sinks]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    return E.in_batches(spark, events, "event_id", 3)(use)


def memory_candidates():
    """Candidates of memories by day of the year, place and folder."""
    return K.View(
        ["kind", "subject"],
        {"n": F.count("*"), "videos": F.count_if(S.is_video("ext")), "cover_id": F.min("id"), "first_date": F.min("eff"), "last_date": F.max("eff")},
        {"n": F.sum("n"), "videos": F.sum("videos"), "cover_id": F.min("cover_id"), "first_date": F.min("first_date"), "last_date": F.max("last_date")},
    )


def candidate_keys(photos):
    """A row for each day, place and folder that a photo counts for."""
    eff = S.effective_date()
    place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat_ws(",", F.floor("lat").cast("string"), F.floor("lon").cast("string")))
    subjects = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("subject")) for k, c in (("day", F.date_format(eff, "MM-dd")), ("place", place), ("folder", F.col("folder_id").cast("string")))))
    return photos.select("id", "ext", eff.alias("eff"), F.explode(subjects).alias("_s")).select("id", "ext", "eff", "_s.*").where("subject IS NOT NULL")


@query("""WITH p AS (SELECT id, ext, lat, lon, folder_id, coalesce(date_taken, modified_utc) AS eff FROM photos_v),
    k AS (SELECT id, ext, eff, 'day' AS kind, strftime(eff, '%m-%d') AS subject FROM p UNION ALL
        SELECT id, ext, eff, 'place', CAST(floor(lat) AS BIGINT) || ',' || CAST(floor(lon) AS BIGINT) FROM p WHERE lat IS NOT NULL AND lon IS NOT NULL UNION ALL
        SELECT id, ext, eff, 'folder', CAST(folder_id AS VARCHAR) FROM p)
    SELECT kind, subject, count(*) AS n, count(*) FILTER (ext IN ('.mp4', '.mov')) AS videos, min(id) AS cover_id, min(eff) AS first_date, max(eff) AS last_date FROM k GROUP BY 1, 2 HAVING count(*) >= 3""")
def stream_memory_candidates(spark, sf_dir):
    """Memory candidates kept up to date by micro-batches that touch only their days, places and folders."""
    photos = view(spark, sf_dir, "photos_v").select("id", "ext", "lat", "lon", "folder_id", "date_taken", "modified_utc")

    candidates = memory_candidates()

    def use(stream, at):
        E.run_batches(stream, K.maintained(f"{at}/rows", candidates, candidate_keys), f"{at}/log")
        return K.current(spark, f"{at}/rows", candidates, candidates.of(candidate_keys(photos)).schema).where("n >= 3")

    return E.in_batches(spark, photos, "id", 3)(use)
