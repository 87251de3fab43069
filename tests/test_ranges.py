"""Operators that cross the seams of ranges, blocks and cells."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import scalars as S
from shutterlake.operators import angles as A, duplicates as D, sessions as X, vectors as V


def photos(n=600, seed=3):
    rng = random.Random(seed)
    t, out = datetime(2024, 1, 1), []
    for k in range(n):
        t += timedelta(seconds=rng.choice([0, 5, 3600, 4 * 3600, 4 * 3600 + 1, 3 * 86400, 3 * 86400 + 1]))
        out.append((k * 7 % 1009, t if rng.random() < 0.9 else None, t + timedelta(days=1), rng.choice([10.0, 10.2, 10.44, 11.0, None]), 20.0, ".jpg"))
    return out


SCHEMA = "id long, date_taken timestamp_ntz, modified_utc timestamp_ntz, lat double, lon double, ext string"


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def brute_trips(rows, least=3):
    placed = sorted((r for r in rows if r[1] and r[3] is not None), key=lambda r: (r[1], r[0]))
    trips = []
    for k, r in enumerate(placed):
        step = None
        if k:
            p = placed[k - 1]
            step = km(p[3:5], r[3:5]) if r[1] - p[1] <= timedelta(days=3) and km(p[3:5], r[3:5]) <= 50 else None
        if step is None:
            trips.append([])
        trips[-1].append((r[0], step))
    return {i: (no, s) for no, t in enumerate(trips, 1) if len(t) >= least for i, s in t}


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_library_trips_at_any_number_of_ranges(spark, ranges):
    rows = photos()
    got = {r["id"]: (r["trip"], r["step_km"]) for r in X.library_trips(spark.createDataFrame(rows, SCHEMA), ranges=ranges).collect()}
    want = brute_trips(rows)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] for k in want)
    assert all((got[k][1] is None) == (want[k][1] is None) and (want[k][1] is None or abs(got[k][1] - want[k][1]) < 1e-9) for k in want)


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_library_activities_at_any_number_of_ranges(spark, ranges):
    rows = photos(seed=5)
    eff = sorted((r[1] or r[2], r[0]) for r in rows)
    runs = [[eff[0]]]
    for a, b in zip(eff, eff[1:]):
        runs.append([b]) if b[0] - a[0] > timedelta(hours=4) else runs[-1].append(b)
    want = [(no, r[0][0], r[-1][0], len(r), r[0][1], r[-1][1]) for no, r in enumerate(runs, 1) if len(r) >= 3]
    got = X.activity_summary(X.library_activities(spark.createDataFrame(rows, SCHEMA), ranges=ranges)).collect()
    assert sorted(map(tuple, got)) == want


def test_one_session_over_all_ranges_and_no_rows(spark):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=k), start, 1.0, 2.0, ".jpg") for k in range(500)]
    out = X.library_activities(spark.createDataFrame(rows, SCHEMA), ranges=16)
    assert [tuple(r) for r in X.activity_summary(out).collect()] == [(1, start, start + timedelta(minutes=499), 500, 0, 499)]
    assert X.library_trips(spark.createDataFrame([], SCHEMA), ranges=4).count() == 0


def test_a_range_is_a_task(spark):
    rows = photos(2000)
    out = X.library_sessions(spark.createDataFrame(rows, SCHEMA), F.unix_micros(F.col("modified_utc").cast("timestamp")), "id", [], lambda b, t: F.lit(False), 16)
    assert out.select("session", "session_rows").distinct().collect() == [(1, 2000)]


def faces(seed=1, people=6, each=60, dims=16, noise=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((people, dims))
    x = np.repeat(centres, each, axis=0) + noise * rng.standard_normal((people * each, dims))
    order = rng.permutation(len(x))
    return [(int(k), x[i].tolist()) for k, i in enumerate(order)]


def brute_leaders(rows, threshold):
    x = np.array([r[1] for r in rows])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    like, leader = x @ x.T >= threshold, {}
    for k in range(len(rows)):
        if k not in leader:
            leader[k] = k
            for j in np.flatnonzero(like[k]):
                leader.setdefault(int(j), k)
    return leader


VECTORS = "id long, embedding array<double>"


@pytest.mark.parametrize("noise,threshold,block", [(0.25, 0.6, 32), (0.6, 0.6, 50), (0.05, 0.9, 1024), (1.5, 0.5, 40)])
def test_leader_clusters_equal_one_pass(spark, noise, threshold, block):
    rows = faces(noise=noise) + [(5000, [0.0] * 16), (5001, [0.0] * 16)]
    rows = [(k, v) for k, (_, v) in enumerate(rows)]
    got = {r["id"]: r["leader"] for r in A.leader_clusters(spark.createDataFrame(rows, VECTORS), threshold, block=block).collect()}
    assert got == brute_leaders(rows, threshold)


def test_members_of_a_cell_are_within_the_angle(spark):
    rows = faces(noise=0.3)
    dealt = A.blocks(spark.createDataFrame(rows, VECTORS), 0.7, "id", 64)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    held = {}
    for r in A.cells(dealt, 0.7, 64).collect():
        held.setdefault(r["cell"], []).append(r["id"])
    assert sum(map(len, held.values())) == len(rows) and len(held) < len(rows)
    assert all((x[m] @ x[m].T >= 0.7).all() for m in held.values())


def test_block_pairs_are_skipped_and_no_pair_is_lost(spark):
    rows = faces(people=12, each=40, noise=0.05)
    df = spark.createDataFrame(rows, VECTORS)
    dealt = A.blocks(df, 0.8, "id", 16)
    assert dealt.skipped() > 0.5
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.8)) if a < b}
    assert {(r["a"], r["b"]) for r in V.similar_vectors(df, 0.8, block=16).collect()} == want


def test_vectors_that_skip_no_block_go_to_few(spark):
    """small balls share blocks, so a vector does not go to one per pivot."""
    rows = [(k, v.tolist()) for k, v in enumerate(np.random.default_rng(11).standard_normal((2500, 64)))] + [(9000, [0.0] * 64)]
    df = spark.createDataFrame(rows, VECTORS)
    dealt = A.blocks(df, 0.25, "id")
    assert dealt.skipped() == 0 and dealt.number <= 6
    x = np.array([r[1] for r in rows[:-1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = [(r["a"], r["b"]) for r in V.similar_vectors(df, 0.25).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.25)) if a < b}


def test_copies_of_one_face_make_few_pairs(spark):
    face = np.random.default_rng(2).standard_normal(8)
    rows = [(k, (face * (1 + k % 3)).tolist()) for k in range(5000)]
    df = spark.createDataFrame(rows, VECTORS)
    dealt = A.blocks(df, 0.6, "id", 512)
    cell = A.cells(dealt, 0.6, 512)
    heads = cell.groupBy("cell").agg(F.min("id").alias("id"))
    made = A.near_some(dealt.rows.join(heads.select("id"), "id", "left_semi"), dealt, 0.6).count()
    assert made <= 2 * len(rows)
    assert {r["leader"] for r in A.leader_clusters(df, 0.6, block=512).select("leader").distinct().collect()} == {0}


def test_leader_clusters_make_no_pairs(spark, monkeypatch):
    """vectors that lie at random skip no block pair, so pairs must not be made at all."""
    monkeypatch.setattr(A, "_compared", None)
    rows = [(k, v.tolist()) for k, v in enumerate(np.random.default_rng(8).standard_normal((400, 64)))]
    got = {r["id"]: r["leader"] for r in A.leader_clusters(spark.createDataFrame(rows, VECTORS), 0.25, block=12).collect()}
    assert got == brute_leaders(rows, 0.25) and len(set(got.values())) > 5 * 12


def test_cluster_sizes_make_no_pairs(spark, monkeypatch):
    """the sizes rest on the same clusters."""
    monkeypatch.setattr(A, "_compared", None)
    rows = [(k, v.tolist()) for k, v in enumerate(np.random.default_rng(9).standard_normal((200, 64)))]
    got = V.cluster_sizes(V.leader_clusters(spark.createDataFrame(rows, VECTORS), 0.25)).collect()
    want = sorted(Counter(brute_leaders(rows, 0.25).values()).items(), key=lambda x: (-x[1], x[0]))
    assert sorted(map(tuple, got), key=lambda r: -r[2]) == [(leader, n, -no) for no, (leader, n) in enumerate(want, 1)]


def test_numbers_of_wide_groups_have_no_gaps(spark):
    """sizes of parts are those of the parts that are numbered, also where rows have more columns than their order."""
    groups = spark.range(60000).select(F.xxhash64("id").alias("leader"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    got = sorted((r["group_no"], r["leader"]) for r in D.group_numbers(groups, "leader").collect())
    assert [n for n, _ in got] == list(range(1, 60001)) and [k for _, k in got] == sorted(k for _, k in got)


def test_assign_or_cluster_makes_no_pairs(spark, monkeypatch):
    """faces without a person form the same clusters as in one pass."""
    monkeypatch.setattr(A, "_compared", None)
    x = np.random.default_rng(12).standard_normal((150, 64))
    people = {4: x[0], 9: x[1]}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "face_id long, embedding array<double>")
    got = V.assign_or_cluster(df, spark.createDataFrame([(p, v.tolist()) for p, v in people.items()], "target_id long, vector array<double>"), 0.25).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {k: max((float(u[k] @ u[f]), -p) for p, f in ((4, 0), (9, 1))) for k in range(len(x))}
    rest = [k for k in best if best[k][0] <= 0.25]
    led = brute_leaders([(k, x[k].tolist()) for k in rest], 0.25)
    number = {leader: 10 + n for n, leader in enumerate(sorted(set(led.values())))}
    want = {(k, -best[k][1], False) for k in best if best[k][0] > 0.25} | {(rest[k], number[leader], True) for k, leader in led.items()}
    assert len(got) == len(x) and {tuple(r) for r in got} == want


def test_nearest_sends_a_vector_to_few_blocks(spark, monkeypatch):
    """blocks grow with the targets, so the rows that are shuffled grow no faster than the vectors."""
    monkeypatch.setattr(A, "BLOCK", 64)
    rng = np.random.default_rng(14)
    x, y = rng.standard_normal((120, 16)), rng.standard_normal((8192, 16))
    y[5000] = y[17]  # a tie: the smaller target stays
    x[3] = y[17]
    f = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "face_id long, embedding array<float>")
    t = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "target_id long, vector array<double>")
    seen = []
    grouped = type(f).groupBy
    monkeypatch.setattr(type(f), "groupBy", lambda self, *by: (by == ("_i", "_j") and seen.append(self), grouped(self, *by))[1])
    got = {r[0]: (r[1], r[2]) for r in V.nearest(f, t, 0.3).collect()}
    assert [d.count() for d in seen] == [120 * 16, 8192 * 2]
    u = x.astype(np.float32).astype(float)
    like = (u / np.linalg.norm(u, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    like[:, 5000] = -1
    assert {k: t for k, (t, _) in got.items()} == dict(enumerate(like.argmax(axis=1).tolist())) and all(abs(s - like[k].max()) < 1e-12 for k, (_, s) in got.items())


@pytest.mark.parametrize("least", [-1.0, 0.0, 0.3])
def test_nearest_of_odd_vectors(spark, least):
    """the cosines, bit by bit, and the ties are those of the column expression."""
    nan = float("nan")
    x = [[1.0, 2.0], [0.0, 0.0], [1.0], [], [None, 1.0], [nan, 1.0], [3.0, 6.0], [-1.0, -2.0], [0.1, 0.7], None]
    y = [[2.0, 4.0], [0.5, 1.0], [5.0], [1.0, None], [0.0, 0.0], [-0.3, 0.2], None, [0.1, 0.7]]
    f = spark.createDataFrame(list(enumerate(x)), "face_id long, embedding array<float>")
    t = spark.createDataFrame(list(enumerate(y)), "target_id long, vector array<double>")
    best = F.max(F.struct(S.cosine(F.col("embedding"), F.col("vector")).alias("s"), (-F.col("target_id")).alias("k"))).alias("b")
    want = f.where("embedding IS NOT NULL").crossJoin(t).groupBy("face_id").agg(best).where(F.col("b.s") >= least).select("face_id", -F.col("b.k"), "b.s").collect()
    got = V.nearest(f, t, least, block=3).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(tuple(r)) for r in want) and got


def test_a_hash_of_many_pictures_makes_one_row(spark):
    rng = np.random.default_rng(6)
    hashes = [int(h) for h in rng.integers(1, 2**62, 30)]
    near = hashes[0] ^ 0b111
    rows = [(k, hashes[0]) for k in range(3000)] + [(5000 + k, near) for k in range(40)] + [(6000 + k, h) for k, h in enumerate(hashes[1:])] + [(9000, 0), (9001, None)]
    got = D.hash_links(spark.createDataFrame(rows, "id long, hash long"), 3).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0, 3000, 3000), (0, 5000, 3, 3000, 40), (5000, 5000, 0, 40, 40)]


def test_no_vectors(spark):
    df = spark.createDataFrame([], VECTORS)
    assert A.leader_clusters(df, 0.6).collect() == [] and V.similar_vectors(df, 0.6).collect() == []
