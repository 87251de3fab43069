import importlib
import random

import pytest

import corpus_pipeline as P
from tests.llm.test_ngram_join import brute as near_groups
from tests.llm.test_substring import brute as cut


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    en = "the and ing tion her ous with that".split()
    de = "ung heit sch pf zu keit der ein".split()
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(1, 4)))
    passage = [word(en) for _ in range(60)]
    out = []
    for i in range(160):
        s = en if i % 2 else de
        w = [word(s) for _ in range(rng.randint(30, 160))]
        if i % 8 == 1:
            w[10:10] = passage
        out.append([i, " ".join(w), "en" if i % 2 else "de", "s", 0])
    out += [[200 + k, out[k][1], out[k][2], "t", 0] for k in range(10)]
    for k in range(10):
        w = out[k + 20][1].split(" ")
        w[len(w) // 2] = "changed"
        out.append([300 + k, " ".join(w), out[k + 20][2], "t", 0])
    out += [[400, None, "en", "u", 0], [401, "", "en", "u", 0], [402, "123 ... 45", "en", "u", 0]]
    return [(*r[:4], len(r[1] or "")) for r in out]


def test_stages_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.language_id(spark, docs, "").checkpoint()
    assert kept.columns == docs.columns
    assert {r[0] for r in rows} - {r["doc_id"] for r in kept.collect()} == {400, 401, 402}
    once = P.exact_dedup(spark, kept, "").checkpoint()
    assert {r["doc_id"] for r in kept.collect()} - {r["doc_id"] for r in once.collect()} == set(range(200, 210))
    apart = P.near_dedup(spark, once, "").checkpoint()
    left = sorted((r["doc_id"], r["text"]) for r in apart.collect())
    groups = near_groups([(r["doc_id"], r["text"]) for r in once.collect()])
    assert {d for d, _ in left} == {g[0] for g in groups if g[0] == g[1]}
    short = P.substring_dedup(spark, apart, "").checkpoint()
    assert short.columns == docs.columns
    want = {d: (t if not gone else new) for (d, t), (_, _, gone, new) in zip(left, cut(left))}
    assert {r["doc_id"]: r["text"] for r in short.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in short.collect())
    packed = P.best_fit_packing(spark, short, "").collect()
    assert {r["doc_id"] for r in packed} == set(want)


def test_run_writes_each_stage(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path))
    assert "sequence_id" in out.columns and out.count() > 100


def test_repeated_rows_reused_and_null_ids(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(5)]
    near = texts[0].replace(texts[0].split(" ")[40], "changed")
    rows = [(3, texts[0]), (5, near), (5, texts[1]), (7, texts[2]), (7, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (P.exact_dedup, P.near_dedup, P.substring_dedup):
        docs = stage(spark, docs, "").checkpoint()
    want = [(3, texts[0]), (5, texts[1]), (7, texts[2]), (None, texts[3]), (None, texts[4])]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in docs.collect()))) == sorted(map(str, want))


def test_entry_registers_all():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names


def test_stages_of_an_empty_table_and_null_columns(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)]):
        docs = spark.createDataFrame(rows, kinds)
        for _, stage in P.STAGES[1:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert P.best_fit_packing(spark, docs, "").count() == min(1, len(rows))
