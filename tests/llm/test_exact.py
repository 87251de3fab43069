import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shutterlake.llm import exact

ROWS = [
    (1, "a b", "x"), (2, "ab", "x"), (3, " a\tb\n", None), (4, None, "x"), (5, "", None), (6, "\x0b \x0c", "z"),
    (7, "A b", "x"), (8, "ab ", "x"), (9, "é" * 50_000, "x"), (10, "é" * 50_000, "y"), (-3, "a b", "n"), (11, "w", "n"), (11, "w", "n"),
]


def brute(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(norm(text), []).append((-len(text or ""), doc_id))
    out = []
    for doc_id, text, _ in rows:
        g = groups[norm(text)]
        out.append((doc_id, min(g)[1], len(g), doc_id == min(g)[1], hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("capacity", [1, 2, 50])
def test_groups_equal_brute_force(spark, capacity):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string")
    got = exact.exact_groups(docs, capacity)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == brute(ROWS)


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(500).selectExpr("xxhash64(id) AS key")
    slots, depth = exact.directory(keys, 40)
    rows = slots.collect()
    assert max(r["load"] for r in rows) <= 40 and sum(r["load"] for r in rows) == 500
    assert depth >= 4 and all(r["local_depth"] <= depth for r in rows)
    per = {}
    for r in rows:
        per[r["bucket"]] = per.get(r["bucket"], 0) + r["load"]
    assert max(per.values()) <= 40


def test_empty_table(spark):
    assert exact.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_drop_copies_keeps_columns(spark):
    docs = spark.createDataFrame(ROWS[:8], "doc_id long, text string, lang string")
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {3, 6, 7, 8}


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "q"), (5, "q"), (None, "r")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["kept"]) for r in exact.exact_groups(docs).collect()) == [("5", "5", True), ("None", "5", False), ("None", "None", True)]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(None, "q"), (5, "q"), (None, "r")], [(5, "q"), (None, "r")]),
        ([(5, "A"), (5, "B"), (2, "B")], [(5, "A"), (2, "B")]),
        ([(7, "a b"), (7, "a b"), (8, None), (8, None)], [(7, "a b"), (8, None)]),
        ([(5, "a b"), (5, "ab"), (None, "x y"), (None, "xy"), (None, "x y")], [(5, "a b"), (None, "x y")]),
        ([(5, "ab"), (9, "a b"), (9, "c"), (9, "a b")], [(9, "a b"), (9, "c")]),
    ],
)
def test_drop_copies_leaves_one_row_of_each_text(spark, rows, want):
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string")
    assert sorted(map(str, exact.drop_copies(docs).select("doc_id", "text").collect())) == sorted(f"Row(doc_id={d}, text={t!r})" for d, t in want)


def test_colliding_keys_are_chained_and_compared(spark, monkeypatch):
    """With a key of few values nearly all texts collide; the chains still tell them apart."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.pmod(F.hash(*c), F.lit(3)).cast("long"))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string")
    assert sorted(tuple(r)[:5] for r in exact.exact_groups(docs, 2).collect()) == brute(ROWS)


def test_index_is_in_key_order_and_bounded(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 2000) AS text")
    with exact.scratch(spark) as save:
        index = exact.build_index(docs, save, 100).table.collect()
    assert len(index) == 2000 and sum(r["group_size"] for r in index) == 3000
    load, ordered = {}, sorted(index, key=lambda r: r["key"] % 2**64)
    for r in index:
        load[r["bucket"]] = load.get(r["bucket"], 0) + 1
    assert max(load.values()) <= 100 and len(load) > 20
    assert [r["bucket"] for r in ordered] == sorted(r["bucket"] for r in ordered)


def test_clashing_names(spark):
    rows = [(i, t, "mine", 1, "b") for i, t in ((1, "a b"), (2, "ab"), (3, "c"), (4, None))]
    out = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string, _key string, _norm int, bucket string"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["_key"], r["_norm"]) for r in out.collect()}
    assert got == {1: (1, 2, "mine", 1), 2: (1, 2, "mine", 1), 3: (3, 1, "mine", 1), 4: (4, 1, "mine", 1)}


def test_a_probe_opens_the_folders_of_its_keys(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 2000) AS text")
    asked = spark.createDataFrame([(1, "t e x t 5"), (2, "not there"), (3, "text1999")], "row int, text string")
    with exact.scratch(spark) as save:
        index = exact.build_index(docs, save, 100)
        folders = index.table.select("owner").distinct().count()
        got = sorted(tuple(r) for r in exact.probe(asked, index, ["row"]).select("row", "keep_id", "group_size").collect())
        assert got == [(1, 5, 2), (3, 1999, 1)]
        owners = [r[0] for r in index.located(asked.selectExpr("xxhash64(replace(text, ' ', '')) AS k"), "k", ["owner"]).select("owner").distinct().collect()]
        opened = index.table.where(F.col("owner").isin(owners)).select("_metadata.file_path").distinct().count()
        assert len(owners) <= 3 < folders and opened <= 3 < index.table.select("_metadata.file_path").distinct().count()
        assert exact.probe(asked.where("row = 2"), index, ["row"]).count() == 0
