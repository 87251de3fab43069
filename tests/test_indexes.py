"""Stored indexes: page directory, bitmaps, text pieces; and the reduction of pictures."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.operators import bitmaps as B, pages as P, resize as Z, search as X, tables as T
from shutterlake.sources import files

PHOTOS = "id long, date_taken timestamp_ntz, modified_utc timestamp_ntz"


def test_pages_of_the_directory(spark, tmp_path):
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(hours=rng.randint(0, 50)) if k % 7 else None, start + timedelta(hours=rng.randint(0, 50))) for k in range(1003)]
    photos = spark.createDataFrame(rows, PHOTOS)
    held = P.build_directory(photos, str(tmp_path), T.newest_first(photos), 16)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] or r[2], r[0]), reverse=True)]
    assert held.rows() == 1003
    for number in (0, 7, 40, 50, 51):
        got = sorted((r["position"], r["id"]) for r in held.page(number, 20).collect())
        assert got == list(enumerate(want))[number * 20 : number * 20 + 20]
    # a page in the middle is read from the one or two files that have it
    n_files = held.files().count()
    assert n_files == 16 and all(len(held.files_of(k * 20, 20)) <= 2 for k in range(51))
    assert len(held.page(30, 20).inputFiles()) <= 2
    assert held.files_of(2000, 20) == [] and held.page(100, 20).columns == [*photos.columns, "position"]


def test_directory_of_nothing(spark, tmp_path):
    photos = spark.createDataFrame([], PHOTOS)
    held = P.build_directory(photos, str(tmp_path), T.newest_first(photos), 4)
    assert held.rows() == 0 and held.page(0, 10).collect() == []


def test_bitmaps_add_up_and_give_their_items_back(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 3), rng.choice([0, 1, 5, 32768, 32769, 70_000, -3, None, rng.randint(0, 10**6)])) for _ in range(900)]
    df = spark.createDataFrame(rows, "who string, day int, item long")
    days = B.item_bitmaps(df, {"who": F.col("who"), "day": F.col("day")}, "item")
    exact = lambda keys: {tuple(r)[:-1]: r["n"] for r in df.groupBy(*keys).agg(F.count_distinct("item").alias("n")).collect()}
    assert {tuple(r)[:-1]: r["n"] for r in B.distinct_items(days, ["who", "day"], "n").collect()} == exact(["who", "day"])
    whole = B.joined(days, {"who": F.col("who")})
    assert {tuple(r)[:-1]: r["n"] for r in B.distinct_items(whole, ["who"], "n").collect()} == exact(["who"])
    assert {(r["who"], r["item"]) for r in B.items(whole, ["who"], "item").collect()} == {(w, i) for w, _, i in rows if i is not None}


def test_words_of_sparse_groups_are_small_and_add_up(spark):
    """a row takes no more than a word where groups are sparse."""
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice([None, 200011, 200012, 200101]), rng.choice([0, 5, 63, 64, -3, -64, 2**40, rng.randint(0, 10**9)])) for _ in range(600)] + [("d", 200011, None), (None, 200011, 7)]
    df = spark.createDataFrame(rows, "who string, month int, item long")
    months = B.item_words(df, "who", F.col("month"), "item")
    assert months.schema["bits"].dataType.simpleString() == "bigint" and months.count() <= len(rows)
    years = B.joined_words(months, "who", F.floor(F.col("period") / 100).cast("int"))
    whole = B.joined_words(years, "who", F.lit(0))
    for words, period in ((months, lambda m: m), (years, lambda m: m and m // 100), (whole, lambda m: 0)):
        want = {}
        for who, month, item in rows:
            want.setdefault((who, period(month)), set()).update(() if item is None else (item,))
        got = [tuple(r) for r in B.counted_words(words, "who", "n").collect()]
        assert len(got) == len(want) and {r[:2]: r[2] for r in got} == {k: len(v) for k, v in want.items()}
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_search_equals_a_scan(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé ß\n.") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "A%_b", "tail", "x" * 200_000 + "needle"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "id long, text string")
    patterns = ["a", "é", "ab", "ß.", "aba", "b\n", "needle", "%_", "il", "l", "A%", "", "not there", "ÉA", None, "aaaaaa"]
    index = X.build_index(docs).cache()
    asked = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = {(p, k) for k, t in rows for p in patterns if p is not None and t is not None and p.lower() in t.lower()}
    got = X.search(docs, index, asked).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    few = {r["pattern"]: r["n"] for r in B.distinct_items(X.candidates(index, asked), ["pattern"], "n").collect()}
    assert few["needle"] == 1 and "not there" not in few and few["aba"] <= 305
    assert X.search(docs, index, asked.limit(0)).count() == 0


def test_weights_of_the_reduction():
    for n in (1, 5, 8, 13, 16, 200):
        w = Z.reduction(n)
        assert w.shape == (8, n) and np.allclose(w.sum(axis=1), 1)
    assert np.allclose(Z.reduction(8), np.eye(8))
    flat = np.full((1, 9, 7), 3.5)
    assert Z.mean_hashes(flat).tolist() == [0]


def test_hashes_of_pictures(spark):
    rng = np.random.default_rng(4)
    pictures = []
    for k, (w, h) in enumerate([(8, 8), (16, 12), (7, 9), (1, 1), (1, 30), (64, 64)]):
        pictures.append((k, w, h, rng.integers(0, 255, w * h).astype(float).tolist()))
    colours = rng.integers(0, 255, (5, 6, 3)).astype(float)
    pictures += [(10, 6, 5, colours.reshape(-1).tolist()), (11, 6, 5, (colours @ np.array(Z.LUMA)).reshape(-1).tolist()), (12, None, 5, [1.0]), (13, 2, 2, None), (14, 2, 2, [1.0])]
    got = {r["id"]: r["hash"] for r in Z.picture_hashes(spark.createDataFrame(pictures, "id long, width int, height int, pixels array<double>")).collect()}
    for k, w, h, pixels in pictures[:6]:
        grid = np.array(pixels).reshape(h, w)
        small = [sum(Z.reduction(h)[i, y] * grid[y, x] * Z.reduction(w)[j, x] for y in range(h) for x in range(w)) for i in range(8) for j in range(8)]
        want = sum(1 << b for b, v in enumerate(small) if v > np.mean(small) + 1e-9)
        assert got[k] == want - (1 << 64 if want >> 63 else 0)
    assert got[10] == got[11] and got[12] == got[13] == got[14] == got[3] == 0


@pytest.mark.parametrize("name", ["a.CR2", "b.dng", "c.mpeg", "d.jpg"])
def test_raw_pictures_are_catalogued(spark, tmp_path, name):
    (tmp_path / name).write_bytes(b"x")
    (tmp_path / "e.txt").write_bytes(b"x")
    assert [r["file_name"] for r in files.files_under(spark, str(tmp_path)).collect()] == [name]
