"""Streams that stop, start again, fail between sinks, run a batch twice or forget."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shutterlake.plans.streams import candidate_keys, memory_candidates
from shutterlake.streaming import events as E, sinks as K, stateful as T

START = datetime(2024, 5, 1)
EVENTS = "event_id long, user_id long, ts timestamp_ntz"


def put(spark, folder, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema=EVENTS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, df, at, trigger={"availableNow": True}):
    with T.large_state(spark):
        df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(**trigger).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(df.schema).parquet(f"{at}/out").collect())


def event(k, user, minutes):
    return (k, user, START + timedelta(minutes=minutes))


GAP = 60 * 60_000_000


def test_debounce_goes_on_after_a_restart(spark, tmp_path):
    folder, at = str(tmp_path / "in"), str(tmp_path)
    put(spark, folder, [event(1, 7, 0), event(2, 7, 30), event(3, 8, 0)])
    made = lambda: T.debounce(stream(spark, folder), "user_id", "ts", "event_id", GAP, forget_ms=10**9)
    assert drain(spark, made(), at) == [("7", 1, 1), ("8", 3, 1)]
    put(spark, folder, [event(4, 7, 59), event(5, 7, 60), event(6, 8, 59)])
    assert drain(spark, made(), at) == [("7", 1, 1), ("7", 5, 2), ("8", 3, 1)]


def test_debounce_forgets_by_a_timer(spark, tmp_path):
    folder, at = str(tmp_path / "in"), str(tmp_path)
    # the last kept event of user 7 is an hour old when its state goes; its number starts anew
    put(spark, folder, [event(1, 7, 0)])
    made = lambda: T.debounce(stream(spark, folder), "user_id", "ts", "event_id", GAP, forget_ms=1000)
    drain(spark, made(), at)
    put(spark, folder, [event(2, 9, 600)])
    drain(spark, made(), at)
    put(spark, folder, [event(3, 9, 1200)])
    drain(spark, made(), at)
    put(spark, folder, [event(4, 7, 1300)])
    assert ("7", 4, 1) in drain(spark, made(), at)


def test_debounce_forgets_by_time_to_live(spark, tmp_path):
    folder, at = str(tmp_path / "in"), str(tmp_path)
    put(spark, folder, [event(1, 7, 0)])
    made = lambda ttl: T.debounce(stream(spark, folder), "user_id", "ts", "event_id", GAP, ttl_ms=ttl)
    once = {"once": True}  # the clock may always call for another batch
    assert drain(spark, made(1), at, once) == [("7", 1, 1)]
    put(spark, folder, [event(2, 7, 5)])
    # state written a moment ago is gone by the clock, so an event within the gap is kept
    assert drain(spark, made(1), at, once) == [("7", 1, 1), ("7", 2, 1)]


def test_debounce_starts_from_a_table(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [event(1, 7, 30), event(2, 7, 61), event(3, 8, 30)])
    start = spark.createDataFrame([(7, int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000, 4)], "user_id long, t long, n long")
    out = T.debounce(stream(spark, folder), "user_id", "ts", "event_id", GAP, forget_ms=10**9, initial=start)
    assert drain(spark, out, str(tmp_path)) == [("7", 2, 5), ("8", 3, 1)]


TYPED = "event_id long, kind string"


def sinks():
    return {n: K.Sink(F.col("kind") == n, [F.col("event_id")]) for n in ("a", "b", "c")}


def test_fan_out_fails_between_sinks_and_repeats_none(spark, tmp_path):
    folder, root, log = str(tmp_path / "in"), str(tmp_path / "sinks"), str(tmp_path / "log")
    put(spark, folder, [(1, "a"), (2, "b"), (3, "c"), (4, "a")], TYPED)
    written = []

    def write(rows, path, broken="b"):
        name = path.split("/")[-2]
        if name == broken:
            raise OSError("disk full")
        written.append(name)
        rows.write.mode("overwrite").parquet(path)

    with pytest.raises(Exception, match="batch 0 is not in b"):
        E.run_batches(stream(spark, folder, TYPED), K.fan_out(root, sinks(), write), log)
    assert written == ["a", "c"]
    E.run_batches(stream(spark, folder, TYPED), K.fan_out(root, sinks(), lambda rows, path: write(rows, path, None)), log)
    assert written == ["a", "c", "b"]
    assert {n: sorted(r[0] for r in spark.read.parquet(f"{root}/{n}").select("event_id").collect()) for n in sinks()} == {"a": [1, 4], "b": [2], "c": [3]}


PHOTOS = "id long, ext string, lat double, lon double, folder_id long, date_taken timestamp_ntz, modified_utc timestamp_ntz"


def photo(k, day, folder, place=(1.5, 2.5)):
    return (k, ".mp4" if k % 3 == 0 else ".jpg", *place, folder, START + timedelta(days=day), START)


def test_maintained_view_equals_the_batch_result(spark, tmp_path):
    root = str(tmp_path / "rows")
    view = memory_candidates()
    step = K.maintained(root, view, candidate_keys)
    batches = [[photo(k, k % 4, k % 2) for k in range(10)], [photo(20 + k, 2, 5, (None, 2.0)) for k in range(4)], [photo(40, -30, 0), photo(41, 0, 1)]]  # the last one comes late
    frames = [spark.createDataFrame(b, PHOTOS) for b in batches]
    whole = view.of(candidate_keys(spark.createDataFrame(sum(batches, []), PHOTOS)))
    read = lambda: sorted(tuple(r) for r in K.current(spark, root, view, whole.schema).select(*whole.columns).collect())
    assert read() == []
    for k, b in enumerate(frames):
        step(b, k)
        if k == 1:
            before = read()
            step(b, k)  # runs again
            assert read() == before
    assert read() == sorted(tuple(r) for r in whole.collect())
    # a batch writes only what it touches
    assert spark.read.parquet(f"{root}/batch_id=1").count() == 2
    assert sorted(os.listdir(root)) == ["batch_id=0", "batch_id=1", "batch_id=2"]


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    at = str(tmp_path / "rows")
    write = E.batch_writer(at)
    write(spark.createDataFrame([(1, "a"), (2, "b")], TYPED), 0)
    write(spark.createDataFrame([(3, "c")], TYPED), 1)
    write(spark.createDataFrame([(1, "a"), (2, "b")], TYPED), 0)
    assert sorted(r["event_id"] for r in spark.read.parquet(at).collect()) == [1, 2, 3]
