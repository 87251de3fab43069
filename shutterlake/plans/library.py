"""Queries over duplicates, similar pictures, classes and face vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classify as C, duplicates as D, vectors as V
from ..sources.views import read, view
from .registry import query

# Duplicates.

_FILES = "SELECT id, file_size, sha256(content) AS h FROM files_v WHERE file_size > 0"


@query("SELECT id, file_size FROM files_v WHERE file_size > 0 AND file_size IN (SELECT file_size FROM files_v GROUP BY 1 HAVING count(*) > 1)")
def dup_candidates(spark, sf_dir):
    return D.duplicate_candidates(view(spark, sf_dir, "files_v").select("id", "file_size"), ["file_size"])


@query(f"SELECT h AS content_hash, count(*) AS n_files, min(id) AS group_id, max(file_size) AS file_size, arg_max(id, file_size * 1000000000 - id) AS original_id, max(file_size) * (count(*) - 1) AS savings FROM ({_FILES}) GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    files = view(spark, sf_dir, "files_v").select("id", "file_size", "content")
    return D.duplicate_groups(D.content_hashes(D.duplicate_candidates(files, ["file_size"])).drop("content"))


@query(f"SELECT h AS content_hash, id, id = max(id) OVER (PARTITION BY h) AS is_original FROM ({_FILES}) QUALIFY count(*) OVER (PARTITION BY h) > 1")
def dup_original(spark, sf_dir):
    files = D.content_hashes(D.duplicate_candidates(view(spark, sf_dir, "files_v"), ["file_size"])).select("content_hash", "id", F.lit(None).cast("timestamp_ntz").alias("date_taken"))
    shared = files.groupBy("content_hash").count().where("count > 1").select("content_hash")
    return D.pick_original(files.join(shared, "content_hash", "left_semi"), "content_hash", "date_taken").select("content_hash", "id", "is_original")


@query("SELECT round(file_size / 100.0) AS bucket, count(*) AS n, CASE WHEN sum(file_size) < 1024 THEN sum(file_size)::BIGINT || ' B' END AS small FROM files_v GROUP BY 1")
def size_texts(spark, sf_dir):
    files = view(spark, sf_dir, "files_v").groupBy(F.round(F.col("file_size") / 100.0).alias("bucket")).agg(F.count("*").alias("n"), F.sum("file_size").alias("total"))
    return files.select("bucket", "n", F.when(F.col("total") < 1024, S.size_text(F.col("total"))).alias("small"))


# Similar pictures.

_HASH = """SELECT vec_id AS id, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > m THEN (CASE WHEN i = 64 THEN -9223372036854775808 ELSE 1::BIGINT << (i - 1)::INT END) ELSE 0 END))::BIGINT AS hash
    FROM (SELECT *, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64 AS m FROM embeddings)"""
_PAIRS = f"SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 18"
_GROUPS = f"""WITH RECURSIVE h AS (SELECT * FROM ({_HASH}) WHERE hash <> 0), e AS ({_PAIRS}),
    r(id, g) AS (SELECT id, id FROM h UNION SELECT CASE WHEN e.a = r.id THEN e.b ELSE e.a END, g FROM r JOIN e ON e.a = r.id OR e.b = r.id),
    c AS (SELECT id, min(g) AS group_id FROM r GROUP BY 1), m AS (SELECT h.id, hash, group_id FROM h JOIN c USING (id) QUALIFY count(*) OVER (PARTITION BY group_id) > 1),
    s AS (SELECT m.*, id % 7 AS width, id % 3 AS height, id % 11 AS file_size FROM m),
    b AS (SELECT *, first_value(id) OVER w AS best_id, first_value(hash) OVER w AS best_hash FROM s WINDOW w AS (PARTITION BY group_id ORDER BY width DESC, height DESC, file_size DESC, id))"""
#: Mean hashes of these vectors have no pair within the 10 bits of the default.
_MOST = 18


def _hashes(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), S.mean_hash("embedding").alias("hash"))


@query(_HASH)
def mean_hash(spark, sf_dir):
    return _hashes(spark, sf_dir)


@query(f"WITH h AS (SELECT * FROM ({_HASH}) WHERE hash <> 0) {_PAIRS}")
def similar_pairs(spark, sf_dir):
    return D.hamming_pairs(_hashes(spark, sf_dir), _MOST)


#: Two of three pictures are taken for one of 25 others, so that hashes repeat.
_SHARED = "CASE WHEN vec_id % 3 = 0 THEN vec_id ELSE vec_id % 25 END"


@query(f"""WITH h AS (SELECT e.vec_id AS id, hash FROM embeddings e JOIN ({_HASH}) x ON x.id = {_SHARED.replace('vec_id', 'e.vec_id')} WHERE hash <> 0),
    g AS (SELECT hash, min(id) AS id, count(*) AS n FROM h GROUP BY hash)
    SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash))::INT AS distance, a.n AS n_a, b.n AS n_b FROM g a JOIN g b ON a.id < b.id OR (a.id = b.id AND a.n > 1) WHERE bit_count(xor(a.hash, b.hash)) <= 18""")
def similar_hash_links(spark, sf_dir):
    """Similar pictures as links between hashes, whatever the number of pictures that share one."""
    shared = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr(_SHARED).alias("_of"))
    return D.hash_links(shared.join(_hashes(spark, sf_dir).toDF("_of", "hash"), "_of").select("id", "hash"), _MOST)


@query(f"{_GROUPS} SELECT id, group_id FROM m")
def similar_components(spark, sf_dir):
    return D.similar_groups(_hashes(spark, sf_dir), _MOST).select("id", "group_id")


def _best(spark, sf_dir):
    groups = D.similar_groups(_hashes(spark, sf_dir), _MOST)
    return D.similar_best(groups.selectExpr("*", "id % 7 AS width", "id % 3 AS height", "id % 11 AS file_size"))


@query(f"{_GROUPS} SELECT group_id, id, best_id, id = best_id AS is_best, bit_count(xor(hash, best_hash))::INT AS distance FROM b")
def similar_best(spark, sf_dir):
    return _best(spark, sf_dir).select("group_id", "id", "best_id", "is_best", "distance")


@query(f"""{_GROUPS} SELECT group_id, count(*) AS n_photos, min(best_id) AS best_id, coalesce(sum(file_size) FILTER (id <> best_id), 0)::BIGINT AS savings,
    CASE WHEN max(bit_count(xor(hash, best_hash))) = 0 THEN 'Exact' WHEN max(bit_count(xor(hash, best_hash))) <= 5 THEN 'VerySimilar' ELSE 'Similar' END AS level,
    dense_rank() OVER (ORDER BY group_id) AS group_no FROM b GROUP BY 1""")
def similar_metrics(spark, sf_dir):
    return D.group_numbers(D.similar_metrics(_best(spark, sf_dir)))


# Classes.


def _rows(rules, start):
    return ", ".join(f"({start + i}, '{t}', '{c}', {s})" for i, (t, c, s) in enumerate(rules))


_CLASSED = f"""WITH fr(o, t, c, s) AS (VALUES {_rows(C.FOLDER_RULES, 0)}), pr(o, t, c, s) AS (VALUES {_rows(C.PREFIX_RULES, 100)}), cr(o, t, c, s) AS (VALUES {_rows(C.CONTAINS_RULES, 200)}),
    p AS (SELECT *, ext IN ('.mp4', '.mov') AS vid FROM photos_v),
    f AS (SELECT id, o, c, s, 'FolderPath' AS kind, t FROM p JOIN fr ON contains(lower(folder_path), t) QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) = 1),
    q AS (SELECT id, o, c, s, 'FilenamePrefix' AS kind, t FROM p JOIN pr ON starts_with(lower(file_stem), t) QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) = 1),
    k AS (SELECT id, o, c, s, 'FilenameContains' AS kind, t FROM p JOIN cr ON contains(lower(file_stem), t)),
    m AS (SELECT id, 300 AS o, CASE WHEN vid THEN 'CameraVideo' ELSE 'CameraPhoto' END AS c, 0.85 AS s, 'Metadata' AS kind, coalesce(camera_make, 'Unknown') AS t FROM p WHERE camera_make IS NOT NULL OR lat IS NOT NULL),
    sig AS (SELECT * FROM f UNION ALL SELECT * FROM q UNION ALL SELECT * FROM k UNION ALL SELECT * FROM m),
    cat AS (SELECT id, c, max(s) AS s, min(o) AS o FROM sig GROUP BY 1, 2),
    best AS (SELECT * FROM cat QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, o) = 1),
    cls AS (SELECT p.id, p.file_size, CAST(coalesce(s, 0) AS DOUBLE) AS confidence,
        coalesce(CASE WHEN vid THEN CASE c WHEN 'CameraPhoto' THEN 'CameraVideo' WHEN 'WhatsAppImage' THEN 'WhatsAppVideo' WHEN 'TelegramImage' THEN 'TelegramVideo'
            WHEN 'DownloadedImage' THEN 'DownloadedVideo' WHEN 'SocialMediaImage' THEN 'SocialMediaVideo' ELSE c END ELSE c END, 'Unknown') AS category
        FROM p LEFT JOIN best b ON b.id = p.id)"""


def _classified(spark, sf_dir):
    photos = view(spark, sf_dir, "photos_v").withColumn("camera_model", F.lit(None).cast("string"))
    return C.classify(photos)


@query(f"{_CLASSED} SELECT id, category, confidence FROM cls")
def classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("id", "category", "confidence")


@query(f"{_CLASSED} SELECT id, o::INT AS ord, kind, t AS value, c AS category, s::DOUBLE AS confidence FROM sig")
def classify_signals(spark, sf_dir):
    return _classified(spark, sf_dir).select("id", F.inline("signals")).select("id", "ord", F.col("type").alias("kind"), "value", "category", "confidence")


@query(f"{_CLASSED} SELECT category, count(*) AS file_count, sum(file_size)::BIGINT AS total_size FROM cls WHERE category <> 'Unknown' GROUP BY 1")
def category_rollup(spark, sf_dir):
    return C.cleanup_categories(_classified(spark, sf_dir))


@query(f"{_CLASSED} SELECT count(*) AS total_files, count(*) FILTER (category <> 'Unknown') AS classified_files, sum(file_size)::BIGINT AS total_size, coalesce(sum(file_size) FILTER (category <> 'Unknown'), 0)::BIGINT AS classifiable_size, count(*) FILTER (category <> 'Unknown') * 100.0::DOUBLE / count(*) AS rate FROM cls")
def cleanup_stats(spark, sf_dir):
    return C.cleanup_statistics(_classified(spark, sf_dir))


@query(f"""{_CLASSED}, n AS (SELECT count(*) FILTER (category IN ('WhatsAppImage', 'WhatsAppVideo', 'TelegramImage', 'TelegramVideo')) AS messaging, count(*) FILTER (category IN ('Meme', 'Screenshot', 'ScreenRecording')) AS clutter,
    count(*) FILTER (category IN ('DownloadedImage', 'DownloadedVideo', 'SocialMediaImage', 'SocialMediaVideo')) AS low_quality FROM cls) SELECT *, messaging + clutter + low_quality AS total_issues FROM n""")
def cleanup_buckets(spark, sf_dir):
    return C.cleanup_buckets(C.cleanup_categories(_classified(spark, sf_dir)))


@query(f"{_CLASSED} SELECT cls.id, category FROM cls JOIN photos_v p ON p.id = cls.id WHERE category = 'Screenshot' ORDER BY coalesce(date_taken, modified_utc) DESC, cls.id DESC LIMIT 100")
def category_page(spark, sf_dir):
    return _classified(spark, sf_dir).where("category = 'Screenshot'").orderBy(S.effective_date().desc(), F.col("id").desc()).limit(100).select("id", "category")


# Face vectors.

_CENTROIDS = """WITH x AS (SELECT person_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM faces_v WHERE NOT is_unassigned AND NOT is_ignored),
    m AS (SELECT person_id, pos, avg(v) AS v FROM x GROUP BY 1, 2), n AS (SELECT person_id, list(v ORDER BY pos) AS c, sqrt(sum(v * v)) AS norm FROM m GROUP BY 1)"""
#: Similar vectors of these tables have cosines of 0.25 to 0.5; the default of the operators is 0.6.
_ALIKE = 0.25


def _person_centroids(spark, sf_dir):
    return V.centroids(view(spark, sf_dir, "faces_v").where("NOT is_unassigned AND NOT is_ignored"))


@query(f"{_CENTROIDS} SELECT m.person_id, pos::INT AS pos, round(v / norm, 6) AS v FROM m JOIN n USING (person_id)")
def centroids(spark, sf_dir):
    return _person_centroids(spark, sf_dir).select("person_id", F.posexplode("centroid").alias("pos", "v")).select("person_id", (F.col("pos") + 1).alias("pos"), F.round("v", 6).alias("v"))


@query(f"""{_CENTROIDS}, s AS (SELECT face_id, n.person_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), c) AS s FROM faces_v f, n WHERE f.is_unassigned)
    SELECT face_id, person_id AS target_id, round(s, 6) AS similarity FROM s WHERE s >= {_ALIKE} QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY s DESC, person_id) = 1""")
def nearest_person(spark, sf_dir):
    people = _person_centroids(spark, sf_dir).select(F.col("person_id").alias("target_id"), F.col("centroid").alias("vector"))
    faces = view(spark, sf_dir, "faces_v").where("is_unassigned")
    return V.nearest(faces, people, _ALIKE).withColumn("similarity", F.round("similarity", 6))


@query(f"""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) >= {_ALIKE}""")
def similar_vectors(spark, sf_dir):
    return V.similar_vectors(read(spark, sf_dir, "embeddings"), _ALIKE, "vec_id").withColumn("similarity", F.round("similarity", 6))


def _led(nodes: str, key: str, alike: str) -> str:
    """SQL of one pass over ``nodes`` by ``key``: table led(id, leader)."""
    x = "list_transform(embedding, lambda x: x::DOUBLE)"
    return f"""v AS (SELECT {key} AS id, {x} AS x, row_number() OVER (ORDER BY {key}) AS k FROM {nodes}),
    e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.x, b.x) >= {alike}),
    pass(k, leads) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT pass.k + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.b = v.id AND list_contains(leads, e.a)) THEN leads ELSE list_append(leads, v.id) END FROM pass JOIN v ON v.k = pass.k + 1),
    leads AS (SELECT unnest(arg_max(leads, k)) AS id FROM pass),
    led AS (SELECT v.id, coalesce(l.id, (SELECT min(e.a) FROM e JOIN leads x ON x.id = e.a WHERE e.b = v.id)) AS leader FROM v LEFT JOIN leads l ON l.id = v.id)"""


@query(f"WITH RECURSIVE {_led('embeddings', 'vec_id', _ALIKE)} SELECT id, leader FROM led")
def leader_clusters(spark, sf_dir):
    return V.leader_clusters(read(spark, sf_dir, "embeddings"), _ALIKE, "vec_id")


@query(f"WITH RECURSIVE {_led('embeddings', 'vec_id', _ALIKE)} SELECT leader, count(*) AS n, -row_number() OVER (ORDER BY count(*) DESC, leader) AS cluster_id FROM led GROUP BY leader")
def cluster_sizes(spark, sf_dir):
    return V.cluster_sizes(V.leader_clusters(read(spark, sf_dir, "embeddings"), _ALIKE, "vec_id"))


@query(f"""WITH RECURSIVE {_CENTROIDS[5:]}, s AS (SELECT face_id, n.person_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), c) AS s FROM faces_v f, n WHERE f.is_unassigned),
    old AS (SELECT face_id, person_id FROM s WHERE s > {_ALIKE} QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY s DESC, person_id) = 1),
    rest AS (SELECT face_id, embedding FROM faces_v WHERE is_unassigned AND face_id NOT IN (SELECT face_id FROM old)), {_led('rest', 'face_id', _ALIKE)}
    SELECT face_id, person_id, false AS is_new FROM old UNION ALL
    SELECT id, (SELECT max(person_id) FROM n) + dense_rank() OVER (ORDER BY leader), true FROM led""")
def assign_or_cluster(spark, sf_dir):
    people = _person_centroids(spark, sf_dir).select(F.col("person_id").alias("target_id"), F.col("centroid").alias("vector"))
    return V.assign_or_cluster(view(spark, sf_dir, "faces_v").where("is_unassigned"), people, _ALIKE)


_OVER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY confidence DESC, box_id) AS k FROM boxes_v),
    hit AS (SELECT a.photo_id, a.k AS ak, b.k AS bk FROM o a JOIN o b ON a.photo_id = b.photo_id AND a.k < b.k WHERE {_OVER} / (a.w * a.h + b.w * b.h - {_OVER}) > 0.4),
    f(photo_id, k, kept) AS (SELECT photo_id, 1, [1::BIGINT] FROM o WHERE k = 1 UNION ALL
        SELECT f.photo_id, f.k + 1, CASE WHEN EXISTS (SELECT 1 FROM hit WHERE hit.photo_id = f.photo_id AND bk = f.k + 1 AND list_contains(kept, ak)) THEN kept ELSE list_append(kept, o.k) END
        FROM f JOIN o ON o.photo_id = f.photo_id AND o.k = f.k + 1)
    SELECT o.photo_id, box_id, confidence FROM o JOIN (SELECT photo_id, arg_max(kept, k) AS kept FROM f GROUP BY 1) l ON l.photo_id = o.photo_id AND list_contains(kept, o.k)""")
def nms(spark, sf_dir):
    return V.suppress_overlaps(view(spark, sf_dir, "boxes_v"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS first, round((embedding[1]::DOUBLE - 127.5) / 128, 6) AS pixel FROM embeddings")
def vector_norms(spark, sf_dir):
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(S.dot(e, e)), 6).alias("norm"), F.round(F.element_at(S.l2_normalised(e), 1), 6).alias("first"), F.round(F.element_at(S.pixel_normalised(e), 1), 6).alias("pixel"))


@query("SELECT box_id, round(greatest(0, x * 100 - 10), 6) AS x, round(least(90, x * 100 - 10 + 20) - greatest(0, x * 100 - 10), 6) AS w FROM boxes_v WHERE least(90, x * 100 - 10 + 20) > greatest(0, x * 100 - 10)")
def clip_boxes(spark, sf_dir):
    boxes = view(spark, sf_dir, "boxes_v").selectExpr("box_id", "x * 100 - 10 AS x", "y * 50 AS y", "CAST(20 AS DOUBLE) AS w", "CAST(20 AS DOUBLE) AS h")
    return V.clip_box(boxes, 90, 90).select("box_id", F.round("x", 6).alias("x"), F.round("w", 6).alias("w"))


@query("""SELECT vec_id, round((vec_id % 80 * 8 - 16) / 640.0, 6) AS x, round((vec_id % 60 * 8 - 8) / 640.0, 6) AS y, round(40 / 640.0, 6) AS w, round(24 / 640.0, 6) AS h FROM embeddings WHERE vec_id % 10 >= 5""")
def decode_anchors(spark, sf_dir):
    cells = read(spark, sf_dir, "embeddings").selectExpr("vec_id", "vec_id % 80 AS cx", "vec_id % 60 AS cy", "CAST(vec_id % 10 AS DOUBLE) / 10 AS score", "2.0D AS l", "1.0D AS t", "3.0D AS r", "2.0D AS b")
    return V.decode_anchors(cells, 8, 640).select("vec_id", *[F.round(c, 6).alias(c) for c in "xywh"])
