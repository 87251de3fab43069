"""Queries over the photo catalogue: timeline, pages, filters, keyed reads and changes, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from ..operators import tables as T
from ..sources.views import read, view
from .registry import query

EFF = "coalesce(date_taken, modified_utc)"


def _photos(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "photos_v")


@query(f"SELECT CAST(year({EFF}) AS INT) AS year, count(*) AS n FROM photos_v GROUP BY 1")
def timeline_year(spark, sf_dir):
    return _photos(spark, sf_dir).groupBy(F.year(S.effective_date()).alias("year")).agg(F.count("*").alias("n"))


@query(f"SELECT CAST(year({EFF}) AS INT) AS year, CAST(month({EFF}) AS INT) AS month, count(*) AS n FROM photos_v GROUP BY 1, 2")
def timeline_month(spark, sf_dir):
    eff = S.effective_date()
    return _photos(spark, sf_dir).groupBy(F.year(eff).alias("year"), F.month(eff).alias("month")).agg(F.count("*").alias("n"))


@query(f"SELECT CAST(year({EFF}) AS INT) AS year, CAST(month({EFF}) AS INT) AS month, CAST(day({EFF}) AS INT) AS day, count(*) AS n FROM photos_v GROUP BY 1, 2, 3")
def timeline_day(spark, sf_dir):
    eff = S.effective_date()
    return _photos(spark, sf_dir).groupBy(F.year(eff).alias("year"), F.month(eff).alias("month"), F.dayofmonth(eff).alias("day")).agg(F.count("*").alias("n"))


@query(f"""
    WITH p AS (SELECT CAST(year({EFF}) AS INT) AS year, CAST(month({EFF}) AS INT) AS month, CAST(day({EFF}) AS INT) AS day FROM photos_v)
    SELECT year, month, day, CAST(grouping(year, month, day) AS BIGINT) AS level, count(*) AS n FROM p GROUP BY ROLLUP (year, month, day)""")
def timeline_rollup(spark, sf_dir):
    eff = S.effective_date()
    days = _photos(spark, sf_dir).select(F.year(eff).alias("year"), F.month(eff).alias("month"), F.dayofmonth(eff).alias("day"))
    return days.rollup("year", "month", "day").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query(f"""
    SELECT count(*) AS total, count(DISTINCT year({EFF})) AS n_years, count(DISTINCT year({EFF}) * 100 + month({EFF})) AS n_months,
           count(DISTINCT CAST({EFF} AS DATE)) AS n_days, CAST(min(year({EFF})) AS INT) AS first_year, CAST(max(year({EFF})) AS INT) AS last_year FROM photos_v""")
def timeline_stats(spark, sf_dir):
    # Days first: the distinct counts then run over few rows, not over every photo.
    days = _photos(spark, sf_dir).groupBy(F.to_date(S.effective_date()).alias("d")).agg(F.count("*").alias("n"))
    return days.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_distinct(F.year("d")).alias("n_years"), F.count_distinct(F.year("d") * 100 + F.month("d")).alias("n_months"),
        F.count("d").alias("n_days"), F.min(F.year("d")).alias("first_year"), F.max(F.year("d")).alias("last_year"),
    )


@query(f"SELECT id, folder_id, {EFF} AS eff, ext FROM photos_v WHERE {EFF} >= TIMESTAMP '2024-01-10' AND {EFF} < TIMESTAMP '2024-01-11'")
def photos_for_day(spark, sf_dir):
    eff = S.effective_date()
    day = F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))
    return _photos(spark, sf_dir).where((eff >= day) & (eff < day + F.expr("INTERVAL 1 DAY"))).select("id", "folder_id", eff.alias("eff"), "ext")


@query(f"SELECT id, {EFF} AS eff FROM photos_v ORDER BY {EFF} DESC, id DESC LIMIT 200 OFFSET 200")
def gallery_page_newest(spark, sf_dir):
    return T.page(_photos(spark, sf_dir), 200, 200).select("id", S.effective_date().alias("eff"))


@query(f"SELECT id, {EFF} AS eff FROM photos_v ORDER BY {EFF}, id LIMIT 200")
def gallery_page_oldest(spark, sf_dir):
    return T.page(_photos(spark, sf_dir), 0, 200, newest=False).select("id", S.effective_date().alias("eff"))


@query(f"SELECT id, {EFF} AS eff FROM photos_v WHERE id > 100 ORDER BY {EFF} DESC, id DESC LIMIT 200")
def gallery_after_id(spark, sf_dir):
    return T.after_id(_photos(spark, sf_dir), 100, 200).select("id", S.effective_date().alias("eff"))


@query(f"SELECT id, {EFF} AS eff FROM photos_v WHERE {EFF} < TIMESTAMP '2024-01-20' OR ({EFF} = TIMESTAMP '2024-01-20' AND id < 500) ORDER BY {EFF} DESC, id DESC LIMIT 200")
def gallery_after_cursor(spark, sf_dir):
    at = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    return T.after_cursor(_photos(spark, sf_dir), at, 500, 200).select("id", S.effective_date().alias("eff"))


@query("SELECT id, folder_id, state FROM photos_v WHERE folder_id = 7 AND state = 1")
def photos_by_folder_state(spark, sf_dir):
    return _photos(spark, sf_dir).where("folder_id = 7 AND state = 1").select("id", "folder_id", "state")


@query("SELECT id, state FROM photos_v WHERE state IN (1, 3)")
def photos_by_states(spark, sf_dir):
    return _photos(spark, sf_dir).where(F.col("state").isin(1, 3)).select("id", "state")


@query("SELECT id, date_taken FROM photos_v WHERE is_favorite")
def favorites(spark, sf_dir):
    return _photos(spark, sf_dir).where("is_favorite").select("id", "date_taken")


@query("SELECT id, date_taken FROM photos_v WHERE date_taken BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def date_range(spark, sf_dir):
    at = lambda d: F.to_timestamp_ntz(F.lit(f"{d} 00:00:00"))
    return _photos(spark, sf_dir).where(F.col("date_taken").between(at("2024-01-05"), at("2024-01-12"))).select("id", "date_taken")


@query("SELECT id, state FROM photos_v WHERE state <> 5")
def incomplete(spark, sf_dir):
    return _photos(spark, sf_dir).where("state <> 5").select("id", "state")


@query("SELECT id, lat, lon FROM photos_v WHERE lat IS NOT NULL AND lon IS NOT NULL AND date_taken IS NOT NULL")
def photos_with_gps(spark, sf_dir):
    return _photos(spark, sf_dir).where("lat IS NOT NULL AND lon IS NOT NULL AND date_taken IS NOT NULL").select("id", "lat", "lon")


@query("SELECT id, state, ext FROM photos_v WHERE state < 4 AND ext NOT IN ('.mp4', '.mov')")
def unprocessed_photos(spark, sf_dir):
    return _photos(spark, sf_dir).where((F.col("state") < 4) & ~S.is_video("ext")).select("id", "state", "ext")


@query("SELECT id, file_stem FROM photos_v WHERE contains(lower(file_stem), 'insta')")
def search_names(spark, sf_dir):
    return T.search(_photos(spark, sf_dir), "file_stem", " Insta ").select("id", "file_stem")


@query("""
    WITH f AS (SELECT id, '/lib/' || CASE id % 5 WHEN 0 THEN 'Cache/' WHEN 1 THEN '' ELSE 'a/' END || CASE id % 3 WHEN 0 THEN '.' WHEN 1 THEN '~$' ELSE '' END || file_stem || ext || CASE id % 7 WHEN 0 THEN '.tmp' ELSE '' END AS path FROM photos_v)
    SELECT id, path FROM f WHERE NOT (id % 5 = 0 OR id % 3 IN (0, 1) OR id % 7 = 0)""")
def watched_paths(spark, sf_dir):
    path = "concat('/lib/', CASE id % 5 WHEN 0 THEN 'Cache/' WHEN 1 THEN '' ELSE 'a/' END, CASE id % 3 WHEN 0 THEN '.' WHEN 1 THEN '~$' ELSE '' END, file_stem, ext, CASE id % 7 WHEN 0 THEN '.tmp' ELSE '' END)"
    files = _photos(spark, sf_dir).selectExpr("id", f"{path} AS path")
    return files.where(~T.ignored_path(F.col("path")))


@query("""
    WITH u AS (SELECT id, id % 3 AS new_state, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM (SELECT id, seq FROM photos_v, (VALUES (1), (2)) s(seq)) WHERE id % 4 = 0)
    SELECT p.id, CAST(CASE WHEN u.id IS NOT NULL THEN u.new_state ELSE p.state END AS INT) AS state FROM photos_v p LEFT JOIN u ON u.id = p.id AND rn = 1""")
def state_update(spark, sf_dir):
    photos = _photos(spark, sf_dir).select("id", "state")
    changes = photos.where("id % 4 = 0").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    changes = changes.withColumn("state", F.when(F.col("seq") == 1, (F.col("id") % 3).cast("int")).otherwise(99))
    return T.keyed_update(photos, changes, "id", ["state"], order="seq")


@query("SELECT id, coalesce(width, CAST(id % 100 AS INT)) AS width, coalesce(height, CAST(id % 50 AS INT)) AS height FROM photos_v")
def metadata_fill(spark, sf_dir):
    photos = _photos(spark, sf_dir).select("id", "width", "height")
    found = photos.select("id", (F.col("id") % 100).cast("int").alias("width"), (F.col("id") % 50).cast("int").alias("height"))
    return T.keyed_update(photos, found, "id", ["width", "height"], keep=True)


_SEEN = "SELECT file_stem AS file_path, CASE WHEN id % 6 = 0 THEN file_size + 1 ELSE file_size END AS file_size, CASE WHEN id % 10 = 0 THEN modified_utc + INTERVAL 1 HOUR ELSE modified_utc END AS modified_utc FROM photos_v WHERE id % 9 <> 0"


@query(f"""
    WITH known AS (SELECT file_stem AS file_path, file_size, modified_utc FROM photos_v WHERE id % 7 <> 0), seen AS ({_SEEN})
    SELECT s.file_path, CASE WHEN k.file_path IS NULL THEN 'insert' WHEN k.file_size = s.file_size AND k.modified_utc = s.modified_utc THEN 'skip' ELSE 'update' END AS action
    FROM seen s LEFT JOIN known k USING (file_path)""")
def index_diff(spark, sf_dir):
    photos = _photos(spark, sf_dir)
    known = photos.where("id % 7 <> 0").selectExpr("file_stem AS file_path", "file_size", "modified_utc")
    seen = photos.where("id % 9 <> 0").selectExpr("file_stem AS file_path", "CASE WHEN id % 6 = 0 THEN file_size + 1 ELSE file_size END AS file_size", "CASE WHEN id % 10 = 0 THEN modified_utc + INTERVAL 1 HOUR ELSE modified_utc END AS modified_utc")
    return T.index_actions(known, seen).select("file_path", "action")


@query(f"""
    WITH seen AS ({_SEEN})
    SELECT p.id, CASE WHEN c THEN s.file_size ELSE p.file_size END AS file_size, CASE WHEN c THEN 1 ELSE p.state END AS state, CASE WHEN c THEN NULL ELSE p.width END AS width
    FROM photos_v p LEFT JOIN (SELECT *, true AS there FROM seen) s ON s.file_path = p.file_stem,
    LATERAL (SELECT coalesce(there, false) AND (s.file_size <> p.file_size OR s.modified_utc <> p.modified_utc) AS c)""")
def modified_reset(spark, sf_dir):
    photos = _photos(spark, sf_dir).selectExpr("id", "file_stem AS file_path", "file_size", "modified_utc", "state", "width")
    seen = _photos(spark, sf_dir).where("id % 9 <> 0").selectExpr("file_stem AS file_path", "CASE WHEN id % 6 = 0 THEN file_size + 1 ELSE file_size END AS file_size", "CASE WHEN id % 10 = 0 THEN modified_utc + INTERVAL 1 HOUR ELSE modified_utc END AS modified_utc")
    return T.modified_reset(photos, seen, ["width"]).select("id", "file_size", "state", "width")


@query("""
    WITH k AS (SELECT lower(file_stem) AS path FROM photos_v WHERE id % 3 <> 0), s AS (SELECT lower(file_stem) AS path FROM photos_v WHERE id % 4 <> 0)
    SELECT path, 'new' AS change FROM (SELECT * FROM s EXCEPT SELECT * FROM k) UNION ALL SELECT path, 'deleted' FROM (SELECT * FROM k EXCEPT SELECT * FROM s)""")
def sync_diff(spark, sf_dir):
    paths = _photos(spark, sf_dir).select("id", F.col("file_stem").alias("file_path"))
    return T.file_diff(paths.where("id % 3 <> 0"), paths.where("id % 4 <> 0").withColumn("file_path", F.upper("file_path")))


@query("SELECT CASE WHEN id % 5 = 0 THEN 'new/' || file_stem ELSE file_stem END AS file_path FROM photos_v WHERE id % 8 <> 0 UNION ALL SELECT 'new/' || file_stem FROM photos_v WHERE id % 8 = 0 AND id % 5 = 0")
def renames(spark, sf_dir):
    photos = _photos(spark, sf_dir).select("id", F.col("file_stem").alias("file_path"))
    moves = photos.where("id % 5 = 0").select(F.col("file_path").alias("old_path"), F.concat(F.lit("new/"), F.col("file_path")).alias("new_path"))
    return T.renamed(photos.where("id % 8 <> 0"), moves).select("file_path")


@query("""
    WITH e AS (SELECT file_stem AS file_path, id % 3 AS batch, id AS seq, CASE id % 4 WHEN 0 THEN 'Created' WHEN 1 THEN 'Deleted' ELSE 'Modified' END AS kind FROM photos_v),
    k AS (SELECT file_stem AS file_path FROM photos_v WHERE id % 2 = 1),
    l AS (SELECT file_path, arg_max(kind, batch * 1000000000000 + (CASE kind WHEN 'Created' THEN 0 ELSE 1 END) * 100000000000 + seq) AS last FROM e WHERE kind <> 'Modified' GROUP BY 1)
    SELECT coalesce(k.file_path, l.file_path) AS file_path FROM k FULL JOIN l USING (file_path) WHERE coalesce(last = 'Created', true)""")
def event_replay(spark, sf_dir):
    photos = _photos(spark, sf_dir)
    kind = "CASE id % 4 WHEN 0 THEN 'Created' WHEN 1 THEN 'Deleted' ELSE 'Modified' END AS change_type"
    events = photos.selectExpr("file_stem AS file_path", "id % 3 AS batch", "id AS seq", kind)
    return T.apply_events(photos.where("id % 2 = 1").select(F.col("file_stem").alias("file_path")), events)


@query("""
    WITH f AS (SELECT id, folder_path || '/' || file_stem AS file_path FROM photos_v), r(root) AS (VALUES ('/lib'), ('/LIB/Memes'), ('/lib/DCIM'))
    SELECT id, (SELECT arg_max(root, length(root)) FROM r WHERE starts_with(lower(file_path), lower(root) || '/')) AS root FROM f""")
def watched_roots(spark, sf_dir):
    files = _photos(spark, sf_dir).select("id", F.concat_ws("/", "folder_path", "file_stem").alias("file_path"))
    roots = spark.createDataFrame([("/lib",), ("/LIB/Memes",), ("/lib/DCIM",)], "root string")
    return T.watched_root(files, roots).select("id", "root")


@query("SELECT folder_id, count(*) AS n_photos, sum(file_size)::BIGINT AS total_size FROM photos_v GROUP BY 1")
def folder_photo_counts(spark, sf_dir):
    return _photos(spark, sf_dir).groupBy("folder_id").agg(F.count("*").alias("n_photos"), F.sum("file_size").alias("total_size"))


@query("""
    WITH f AS (SELECT photo_id, count(*) AS n_faces, string_agg(DISTINCT CAST(person_id AS VARCHAR), ',' ORDER BY CAST(person_id AS VARCHAR)) FILTER (NOT is_unassigned) AS people FROM faces_v GROUP BY 1)
    SELECT id, folder_path, coalesce(n_faces, 0) AS n_faces, coalesce(people, '') AS people FROM photos_v LEFT JOIN f ON photo_id = id""")
def photo_details(spark, sf_dir):
    people = F.array_join(F.array_sort(F.collect_set(F.expr("IF(is_unassigned, NULL, CAST(person_id AS STRING))"))), ",")
    faces = view(spark, sf_dir, "faces_v").groupBy(F.col("photo_id").alias("id")).agg(F.count("*").alias("n_faces"), people.alias("people"))
    return _photos(spark, sf_dir).select("id", "folder_path").join(faces, "id", "left").fillna({"n_faces": 0, "people": ""})


@query("SELECT face_id, photo_id FROM faces_v WHERE face_id IN (SELECT face_id FROM personfaces_v WHERE person_id = 3)")
def person_faces_semi(spark, sf_dir):
    links = view(spark, sf_dir, "personfaces_v").where("person_id = 3")
    return view(spark, sf_dir, "faces_v").join(links, "face_id", "left_semi").select("face_id", "photo_id")


@query("SELECT face_id FROM faces_v f WHERE NOT is_ignored AND NOT EXISTS (SELECT 1 FROM personfaces_v p WHERE p.face_id = f.face_id) ORDER BY face_id LIMIT 1000")
def unassigned_faces_anti(spark, sf_dir):
    return view(spark, sf_dir, "faces_v").where("NOT is_ignored").join(view(spark, sf_dir, "personfaces_v"), "face_id", "left_anti").select("face_id").orderBy("face_id").limit(1000)


@query("SELECT count(*) AS n FROM personfaces_v p WHERE NOT EXISTS (SELECT 1 FROM faces_v f WHERE f.face_id = p.face_id AND NOT is_ignored)")
def orphan_personfaces(spark, sf_dir):
    kept = view(spark, sf_dir, "faces_v").where("NOT is_ignored")
    return view(spark, sf_dir, "personfaces_v").join(kept, "face_id", "left_anti").agg(F.count("*").alias("n"))


_PERSON_FACES = "SELECT * FROM faces_v WHERE NOT is_unassigned AND NOT is_ignored"


@query(f"""
    WITH f AS (SELECT f.*, p.date_taken FROM ({_PERSON_FACES}) f LEFT JOIN photos_v p ON p.id = f.photo_id)
    SELECT person_id, count(*) AS face_count, count(DISTINCT photo_id) AS photo_count, max(coalesce(date_taken, created)) AS last_seen FROM f GROUP BY 1""")
def person_stats(spark, sf_dir):
    faces = view(spark, sf_dir, "faces_v").where("NOT is_unassigned AND NOT is_ignored")
    taken = _photos(spark, sf_dir).select(F.col("id").alias("photo_id"), "date_taken")
    out = faces.join(taken, "photo_id", "left").groupBy("person_id")
    return out.agg(F.count("*").alias("face_count"), F.count_distinct("photo_id").alias("photo_count"), F.max(F.coalesce("date_taken", "created")).alias("last_seen"))


@query(f"SELECT person_id, face_id, photo_id, created FROM ({_PERSON_FACES}) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY created DESC, face_id DESC) = 1")
def person_latest_face(spark, sf_dir):
    faces = view(spark, sf_dir, "faces_v").where("NOT is_unassigned AND NOT is_ignored")
    # An aggregate keeps one row per key on the map side; a window would shuffle all.
    latest = faces.groupBy("person_id").agg(F.max_by(F.struct("face_id", "photo_id", "created"), F.struct("created", "face_id")).alias("f"))
    return latest.select("person_id", "f.face_id", "f.photo_id", "f.created")


@query("""SELECT count(*) AS total, count(*) FILTER (NOT is_unassigned) AS assigned, count(*) FILTER (is_ignored) AS ignored, count(DISTINCT photo_id) AS photos,
       count(DISTINCT person_id) FILTER (NOT is_unassigned) AS people FROM faces_v""")
def face_counters(spark, sf_dir):
    return view(spark, sf_dir, "faces_v").agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_unassigned")).alias("assigned"), F.count_if("is_ignored").alias("ignored"), F.count_distinct("photo_id").alias("photos"),
        F.count_distinct(F.when(~F.col("is_unassigned"), F.col("person_id"))).alias("people"),
    )


@query("SELECT person_id, count(*) AS n FROM personfaces_v GROUP BY 1 ORDER BY n DESC, person_id LIMIT 5")
def people_by_faces(spark, sf_dir):
    return view(spark, sf_dir, "personfaces_v").groupBy("person_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person_id").limit(5)


_MERGE = "SELECT DISTINCT CASE WHEN person_id IN (1, 2) THEN 0 ELSE person_id END AS person_id, face_id FROM personfaces_v"


@query(f"SELECT m.person_id, count(*) AS face_count, count(DISTINCT photo_id) AS photo_count FROM ({_MERGE}) m JOIN faces_v USING (face_id) WHERE NOT is_ignored GROUP BY m.person_id")
def people_merge(spark, sf_dir):
    mapping = spark.createDataFrame([(1, 0), (2, 0)], "old_id long, new_id long")
    links = T.merge_people(view(spark, sf_dir, "personfaces_v"), mapping)
    faces = view(spark, sf_dir, "faces_v").where("NOT is_ignored").select("face_id", "photo_id")
    return links.join(faces, "face_id").groupBy("person_id").agg(F.count("*").alias("face_count"), F.count_distinct("photo_id").alias("photo_count"))


@query("SELECT id, folder_id, file_size FROM photos_v WHERE id = 42")
def lookup_by_key(spark, sf_dir):
    return _photos(spark, sf_dir).where("id = 42").select("id", "folder_id", "file_size").limit(1)


@query("SELECT face_id, photo_id, confidence FROM faces_v WHERE photo_id = 7")
def children_by_parent(spark, sf_dir):
    return view(spark, sf_dir, "faces_v").where("photo_id = 7").select("face_id", "photo_id", "confidence")


@query("SELECT face_id, len(embedding)::INT AS dims FROM faces_v WHERE NOT is_ignored AND embedding IS NOT NULL ORDER BY face_id LIMIT 100")
def faces_with_embeddings(spark, sf_dir):
    faces = view(spark, sf_dir, "faces_v").where("NOT is_ignored AND embedding IS NOT NULL")
    return faces.orderBy("face_id").limit(100).select("face_id", F.size("embedding").alias("dims"))


@query("SELECT place_id, name FROM places_v WHERE lat IS NOT NULL AND lon IS NOT NULL")
def places_with_gps(spark, sf_dir):
    return view(spark, sf_dir, "places_v").where("lat IS NOT NULL AND lon IS NOT NULL").select("place_id", "name")


_TABLES = ("photos_v", "faces_v", "personfaces_v", "places_v", "trips_v")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, sf_dir):
    counts = [view(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in _TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


@query("SELECT id, ext FROM photos_v WHERE NOT (ext = '.png' AND id % 3 = 0)")
def delete_by_category(spark, sf_dir):
    photos = _photos(spark, sf_dir).select("id", "ext")
    chosen = photos.where("id % 3 = 0").select("id")
    return T.without(photos, photos.where("ext = '.png'").join(chosen, "id", "left_semi"), "id")


@query("SELECT face_id FROM faces_v WHERE photo_id NOT IN (SELECT id FROM photos_v WHERE id % 10 = 0)")
def delete_cascade(spark, sf_dir):
    gone = _photos(spark, sf_dir).where("id % 10 = 0")
    faces = view(spark, sf_dir, "faces_v").select("face_id", "photo_id")
    return T.without(faces, gone, "photo_id", "id").select("face_id")


@query("SELECT id, CASE WHEN folder_id = 7 THEN NULL ELSE folder_id END AS group_id FROM photos_v")
def ignore_group(spark, sf_dir):
    return _photos(spark, sf_dir).select("id", F.when(F.col("folder_id") != 7, F.col("folder_id")).alias("group_id"))


@query("SELECT id, file_size FROM photos_v WHERE id % 3 <> 0 UNION ALL SELECT id, file_size * 2 FROM photos_v WHERE id % 3 = 0 UNION ALL SELECT -1 - id, 0 FROM photos_v WHERE id < 10")
def upsert_rows(spark, sf_dir):
    rows = _photos(spark, sf_dir).select("id", "file_size")
    changed = rows.where("id % 3 = 0").selectExpr("id", "file_size * 2 AS file_size")
    new = rows.where("id < 10").selectExpr("-1 - id AS id", "CAST(0 AS BIGINT) AS file_size")
    return T.upsert(rows, changed.unionByName(new), "id")


@query("SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def repeated_keys(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").count().where("count > 1").agg(F.count("*").alias("n"))


@query("SELECT id, greatest(1, CAST(trunc(width * least(256.0 / width, 256.0 / height)) AS INT)) AS w, greatest(1, CAST(trunc(height * least(256.0 / width, 256.0 / height)) AS INT)) AS h FROM photos_v WHERE width IS NOT NULL")
def thumbnail_sizes(spark, sf_dir):
    w, h = S.fit_within(F.col("width"), F.col("height"), 256)
    return _photos(spark, sf_dir).where("width IS NOT NULL").select("id", w.alias("w"), h.alias("h"))


@query("SELECT event_type AS operation, count(*) AS calls, round(sum(value), 2) AS elapsed, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def timing_rollup(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("operation")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("elapsed"), F.round(F.avg("value"), 4).alias("mean"))
