"""Operators against brute force, and their edges."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shutterlake.functions import scalars as S
from shutterlake.operators import classify, duplicates, graph, memories, people, sessions, tables, vectors
from shutterlake.plans import commands
from shutterlake.plans.library import leader_clusters as leader_query
from shutterlake.sources import files

T0 = datetime(2024, 1, 1)


def _greedy(order, links):
    leader = {}
    for i, x in enumerate(order):
        if x in leader:
            continue
        leader[x] = x
        for y in order[i + 1 :]:
            if y not in leader and frozenset((x, y)) in links:
                leader[y] = x
    return leader


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_leaders(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(i, i + 1) for i in range(50, 70)]
    ids = list(range(75))
    nodes = spark.createDataFrame([(i, i) for i in ids], "id long, rank long")
    edges = spark.createDataFrame(pairs, "a long, b long")
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()} == label
    links = {frozenset(p) for p in pairs if p[0] != p[1]}
    assert {r["id"]: r["leader"] for r in graph.greedy_leaders(nodes, edges).collect()} == _greedy(ids, links)


def test_graph_without_edges(spark):
    nodes, edges = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank long"), spark.createDataFrame([], "a long, b long")
    assert sorted(r["component"] for r in graph.components(nodes, edges).collect()) == [1, 2]
    assert sorted(r["leader"] for r in graph.greedy_leaders(nodes, edges).collect()) == [1, 2]


def test_leader_clusters_equal_one_pass(spark):
    got = {r["id"]: r["leader"] for r in leader_query(spark, "/root/testdata/sf0.001").collect()}
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect())
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = lambda a, b: dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5
    links = {frozenset((i, j)) for i, a in rows for j, b in rows if i < j and cos(a, b) >= 0.25}
    assert got == _greedy([i for i, _ in rows], links)


@pytest.mark.parametrize("most", [0, 5, 10])
def test_hamming_pairs(spark, most):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 2, 5, 6, 10, 11)] + [0]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    rows = spark.createDataFrame(list(enumerate(signed)) + [(99, None)], "id long, hash long")
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and a and b and (a ^ b).bit_count() <= most}
    assert {tuple(r) for r in duplicates.hamming_pairs(rows, most).collect()} == want


def test_session_gaps_are_inclusive(spark):
    at = [T0, T0 + timedelta(hours=4), T0 + timedelta(hours=8), T0 + timedelta(hours=12, seconds=1)]
    rows = spark.createDataFrame([(i, 1, None, t) for i, t in enumerate(at)], "id long, folder_id long, date_taken timestamp_ntz, modified_utc timestamp_ntz")
    out = sessions.activity_sessions(rows, ["folder_id"]).collect()
    assert [r["photo_ids"] for r in out] == [[0, 1, 2]]
    assert sessions.activity_sessions(rows.limit(0), ["folder_id"]).collect() == []


def test_trip_edges(spark):
    day = timedelta(days=3)
    rows = [(1, 1, T0, 0.0, 0.0), (2, 1, T0 + day, 0.0, 0.44), (3, 1, T0 + 2 * day, 0.0, 0.88), (4, 1, T0 + 3 * day + timedelta(seconds=1), 0.0, 0.88), (5, 1, None, 0.0, 0.0), (6, 1, T0, None, 0.0)]
    photos = spark.createDataFrame(rows, "id long, folder_id long, date_taken timestamp_ntz, lat double, lon double")
    assert sorted(r["id"] for r in sessions.trip_sessions(photos, ["folder_id"]).collect()) == [1, 2, 3]


def test_debounce_counts_from_the_last_kept(spark):
    ms = [0, 499, 500, 501, 999, 1000, 5000]
    rows = spark.createDataFrame([(i, "a", T0 + timedelta(milliseconds=m)) for i, m in enumerate(ms)], "id long, path string, ts timestamp_ntz")
    assert sorted(r["id"] for r in sessions.debounced(rows, ["path"], "ts", "id", 500_000).collect()) == [0, 2, 5, 6]


def test_originals(spark):
    rows = [(1, "x", None), (2, "x", T0), (3, "x", T0), (4, "y", None)]
    out = duplicates.pick_original(spark.createDataFrame(rows, "id long, h string, date timestamp_ntz"), "h", "date").where("is_original").collect()
    assert sorted(r["id"] for r in out) == [3, 4]


def test_classes(spark):
    cols = "id long, folder_path string, file_stem string, ext string, camera_make string, camera_model string, lat double, lon double"
    rows = [
        (1, "/a/DCIM", "Screenshot_1", ".mp4", None, None, None, None),  # 0.90 beats 0.80; screenshots have no video twin
        (2, "/a/Downloads", "whatsapp image 3", ".mp4", None, None, None, None),
        (3, "/a", "x", ".jpg", None, None, 1.0, 1.0),
        (4, "/a", "x", ".jpg", None, None, 1.0, None),
        (5, None, None, None, None, None, None, None),
        (6, "/a\\Memes", "snap", ".jpg", "", None, None, None),
    ]
    got = {r["id"]: (r["category"], r["confidence"]) for r in classify.classify(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: ("Screenshot", 0.9), 2: ("WhatsAppVideo", 0.9), 3: ("CameraPhoto", 0.85), 4: ("Unknown", 0.0), 5: ("Unknown", 0.0), 6: ("Meme", 0.9)}


_CAND = "batch bigint, type string, id string, photo_ids array<bigint>, person_ids array<bigint>, date_start timestamp_ntz, date_end timestamp_ntz, activity_hint string, location_hint string, holiday_hint string, score double"


def _candidate(i, photos, score, persons=(), day=0, place=None, batch=0):
    return (batch, "Day", f"c{i}", list(photos), list(persons), T0 + timedelta(days=day), T0 + timedelta(days=day), None, place, None, score)


def test_merge_needs_more_than_half(spark):
    rows = [_candidate(0, [1, 2, 3], 0.9), _candidate(1, [2, 3], 0.5, [7]), _candidate(2, [1, 9], 0.4), _candidate(3, [1, 2, 3], 0.9, batch=1)]
    got = {r["id"]: (r["photo_ids"], r["person_ids"]) for r in memories.merged(spark.createDataFrame(rows, _CAND)).collect()}
    assert got == {"c0": ([1, 2, 3], [7]), "c2": ([1, 9], []), "c3": ([1, 2, 3], [])}
    half = [_candidate(0, [1, 2], 0.9), _candidate(1, [1], 0.5)]
    assert memories.merged(spark.createDataFrame(half, _CAND)).count() == 2


def test_ranking_is_diverse(spark):
    rows = [_candidate(i, [i], 1 - i / 10) for i in range(4)] + [_candidate(10 + i, [i], 0.3 - i / 100, [5], day=i + 1) for i in range(3)] + [_candidate(20 + i, [i], 0.2, place="p", day=10 + i) for i in range(2)]
    got = [r["id"] for r in memories.ranked(spark.createDataFrame(rows, _CAND)).orderBy("place").collect()]
    assert got == ["c0", "c1", "c2", "c10", "c11", "c20"]


def test_holidays(spark):
    days = {(12, 22): "Christmas", (12, 24): "Christmas", (12, 28): "Christmas", (12, 29): None, (1, 1): "New Year", (1, 3): "New Year", (1, 4): None, (10, 31): "Halloween"}
    rows = spark.createDataFrame([(m, d, datetime(2020, m, d)) for m, d in days], "m int, d int, t timestamp_ntz")
    assert {(r["m"], r["d"]): r["h"] for r in rows.select("m", "d", memories.holiday_of(F.col("t")).alias("h")).collect()} == days


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(S.geohash(F.lit(57.64911), F.lit(10.40744))) == "u4pru"
    assert value(S.geohash(F.lit(None).cast("double"), F.lit(1.0))) is None
    assert [value(S.city(F.lit(n))) for n in ("Paris", "Paris,France", "Paris,,France", " a , B ")] == ["Paris", "Paris", "Paris", "a"]
    assert [value(S.country(F.lit(n))) for n in ("Paris", "Paris,France", "Paris,,France", " a , B ")] == ["Paris", "France", "France", "B"]
    assert value(S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert value(S.exif_time(F.lit("2020:01:02 03:04:05"))) == datetime(2020, 1, 2, 3, 4, 5)
    assert value(S.exif_time(F.lit("junk"))) is None
    assert value(S.dms_degrees(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("s"))) == -10.5
    assert [value(S.size_text(F.lit(n))) for n in (5, 2048, 3 * 1024**2, 1024**3)] == ["5 B", "2.0 KB", "3.0 MB", "1.00 GB"]
    assert value(S.extension(F.lit("C:\\x.y\\A.JPG"))) == ".jpg"


def test_updates(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    new = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (2, "z", 1), (3, "w", 1)], "id long, v string, seq int")
    assert sorted(map(tuple, tables.keyed_update(rows, new, "id", ["v"], order="seq").collect())) == [(1, "y"), (2, "z")]
    assert sorted(map(tuple, tables.keyed_update(rows, new, "id", ["v"], order="seq", keep=True).collect())) == [(1, "a"), (2, "z")]


def test_nearest_keeps_the_threshold(spark):
    faces = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, None)], "face_id long, embedding array<double>")
    people = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 0.0])], "target_id long, vector array<double>")
    assert {tuple(r) for r in vectors.nearest(faces, people, 0.6).collect()} == {(1, 7, 1.0), (2, 7, 0.6)}
    assert {tuple(r) for r in vectors.nearest(faces, people, 0.6, strict=True).collect()} == {(1, 7, 1.0)}
    new = {(r["face_id"], r["person_id"], r["is_new"]) for r in vectors.assign_or_cluster(faces.where("face_id < 3"), people, 0.6).collect()}
    assert new == {(1, 7, False), (2, 9, True)}


def test_filters_do_not_multiply_the_classifier(spark):
    cols = "id long, folder_path string, file_stem string, ext string, camera_make string, camera_model string, lat double, lon double, file_size long"
    photos = classify.classify(spark.createDataFrame([], cols))
    plain = len(photos._jdf.queryExecution().optimizedPlan().toString())
    rolled = len(classify.cleanup_categories(photos)._jdf.queryExecution().optimizedPlan().toString())
    one = len(photos.where("category = 'Meme'").select("id")._jdf.queryExecution().optimizedPlan().toString())
    assert rolled < 2 * plain and one < 2 * plain


def test_nearest_over_several_blocks(spark):
    rng = random.Random(4)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    f, t = [(i, vec()) for i in range(40)], [(i, vec()) for i in range(30)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {i: max(((cos(v, w), -j) for j, w in t))[1] * -1 for i, v in f if max(cos(v, w) for _, w in t) >= 0.3}
    got = vectors.nearest(spark.createDataFrame(f, "face_id long, embedding array<double>"), spark.createDataFrame(t, "target_id long, vector array<double>"), 0.3, block=7)
    assert {r["face_id"]: r["target_id"] for r in got.collect()} == want
    pairs = vectors.similar_vectors(spark.createDataFrame(f, "id long, embedding array<double>"), 0.3, block=9)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(i, j) for i, v in f for j, w in f if i < j and cos(v, w) >= 0.3}


def test_numbers_over_partitions(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(100)], "leader long, n long")
    got = [r["leader"] for r in duplicates.group_numbers(rows, F.desc("n"), F.asc("leader")).orderBy("group_no").collect()]
    assert got == sorted(range(100), key=lambda i: (-(i % 7), i))


def test_people_commands(spark):
    faces = spark.createDataFrame([(1, 10, False, False, T0), (2, 10, False, False, T0), (3, 11, False, True, T0), (4, None, False, False, None)], "face_id long, photo_id long, is_unassigned boolean, is_ignored boolean, created timestamp_ntz")
    links = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (7, 4), (9, 99)], "person_id long, face_id long")
    stats = lambda l, f: {r["person_id"]: (r["face_count"], r["photo_count"]) for r in people.statistics(l, f).collect()}
    assert stats(links, faces) == {7: (2, 1), 8: (0, 0), 9: (0, 0)}
    one = spark.createDataFrame([(2,), (2,), (50,)], "face_id long")
    assert stats(links, people.ignored(faces, one)) == {7: (1, 1), 8: (0, 0), 9: (0, 0)}
    assert stats(people.split(links, one, 7, 70), faces)[70] == (1, 1)
    assert {r["person_id"] for r in people.affected(links, one).collect()} == {7}
    gone = people.recomputed(links.where("face_id > 100"), faces, spark.createDataFrame([(7,)], "person_id long"))
    assert [tuple(r)[:3] for r in gone.collect()] == [(7, 0, 0)]
    again, left = people.unassigned_again(faces, links, 7)
    assert {r["face_id"] for r in again.where("is_unassigned").collect()} == {1, 2, 4} and left.count() == 2


def test_files_are_found_below_a_folder(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for name, size in (("x.JPG", 5), ("a/y.png", 7), ("a/b/z.txt", 9), ("a/b/w.jpg", 0)):
        (tmp_path / name).write_bytes(b"0" * size)
    found = files.files_under(spark, str(tmp_path))
    assert {(r["file_name"], r["file_size"]) for r in found.collect()} == {("x.JPG", 5), ("y.png", 7)}
    assert {tuple(r) for r in files.storage_totals(found).collect()} == {(".jpg", 1, 5), (".png", 1, 7)}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_watched_roots_neither_multiply_nor_group_files(spark):
    """F8: only folders meet the roots; a whole path, no folder, odd names and repeats."""
    paths = ["/lib/a/x.jpg", "/LIB/A/y.jpg", "/lib/ab/z.jpg", "/lib/a/x.jpg", "/lib/a/deep/x\ny/w.jpg", "/other/q", "alone", "Alone.x", "/top", "", None, "/lib/ab/z.jpg/"]
    roots = ["/Lib", "/lib/A", "/lib/ab/Z.jpg", "ALONE", "", "/lib/a/deep/X\nY"]
    df = spark.createDataFrame(list(enumerate(paths)), "id long, file_path string")
    out = tables.watched_root(df, spark.createDataFrame([(r,) for r in roots], "root string"))
    fits = lambda p, r: p.lower() == r.lower() or p.lower().startswith(r.lower() + "/")
    want = {(i, max((r for r in roots if p is not None and fits(p, r)), key=len, default=None)) for i, p in enumerate(paths)}
    assert out.columns == ["file_path", "id", "root"] and sorted(r["id"] for r in out.collect()) == list(range(len(paths)))
    assert {(r["id"], r["root"]) for r in out.collect()} == want
    assert "Aggregate [file_path" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_table_of_many_parts_is_one_data_set(spark, tmp_path):
    """names of tables, not of the parts that Spark writes."""
    at = tmp_path / "in.parquet"
    spark.range(100).repartition(5).write.parquet(str(at / "orders.parquet"))
    spark.range(100).withColumn("k", F.col("id") % 3).write.partitionBy("k").parquet(str(at / "deep/events.Parquet"))
    for name in ("nation.parquet", "notes.txt"):
        (at / name).write_bytes(b"0" * 7)
    found = {r["file_name"]: r for r in files.data_sets_under(spark, str(at)).collect()}
    assert found.keys() == {"orders.parquet", "events.Parquet", "nation.parquet"} and {r["extension"] for r in found.values()} == {".parquet"}
    assert found["orders.parquet"]["file_size"] == sum(p.stat().st_size for p in (at / "orders.parquet").glob("part-*"))
    assert found["events.Parquet"]["file_path"] == f"file:{at}/deep/events.Parquet" and found["nation.parquet"]["file_size"] == 7


def test_totals_count_tables_and_not_their_parts(spark, tmp_path):
    """the registered query over tables in one file and in folders of parts."""
    spark.range(100).repartition(5).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(9).coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    assert [tuple(r) for r in commands.storage_totals(spark, str(tmp_path)).collect()] == [(".parquet", 2, True)]


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    from shutterlake.streaming.events import batch_writer

    write = batch_writer(str(tmp_path / "out"))
    write(spark.range(5), 0)
    write(spark.range(5, 8), 1)
    write(spark.range(5), 0)
    assert sorted((r["batch_id"], r["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, i) for i in range(5)] + [(1, i) for i in (5, 6, 7)]
