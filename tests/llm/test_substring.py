import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from shutterlake.llm import arrays as A, substring as S


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def brute(rows, window=35):
    seen = {}
    for k, (_, t) in enumerate(rows):
        w = words(t)
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), []).append((k, p))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                gone[k].update(range(p, p + window))
    return [(d, len(words(t)), len(gone[k]), " ".join(x for i, x in enumerate(words(t)) if i not in gone[k])) for k, (d, t) in enumerate(rows)]


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"wé{i}" for i in range(60)]
    passage = [[rng.choice(vocab) for _ in range(n)] for n in (34, 35, 36, 37, 50, 80, 200)]
    texts = [None, "", "  \n", "x " * 34, "x " * 35, "x " * 36, "y " * 100, "a b " * 60, "a b " * 90, "a b c " * 40 + "end", "z q " * 40]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.7:
                parts += rng.choice(passage)
            if rng.random() < 0.2:
                parts += ["the"] * rng.randint(1, 50)
        texts.append("\t ".join(parts))
    texts += texts[-3:] + [texts[-1] + "  "]
    return list(enumerate(texts))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=20), st.lists(st.integers(0, 2), max_size=20), st.lists(st.integers(0, 2), min_size=35, max_size=60), st.lists(st.integers(0, 2), max_size=20), st.lists(st.integers(0, 2), max_size=20))
def test_equal_windows_have_equal_leaders(a, b, shared, c, d):
    text = [A.mix(np.array(x, A.U64) + A.U64(1)) for x in (a + shared + c, b + shared + d)]
    leaders = []
    for x, skip in zip(text, (len(a), len(b))):
        names, p, n, _ = S.stretches(x, np.array([0, len(x)]))
        by = dict(zip((np.repeat(p, n) + A.ramp(n)).tolist(), np.repeat(names, n).tolist()))
        leaders.append([by[skip + k] for k in range(len(shared) - 34)])
    assert leaders[0] == leaders[1]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "keep", 1) for d, t in rows], "doc_id long, text string, source string, n_words int")
    got = S.remove_repeats(docs)
    assert got.columns == ["doc_id", "source", "n_words", "n_removed", "kept_text"]
    assert sorted((r[0], *r[2:]) for r in got.collect()) == brute(rows)


def test_null_and_repeated_ids(spark):
    p = " ".join(f"v{i}" for i in range(40))
    rows = [(None, p), (1, "a " + p), (1, "b"), (1, "b"), (None, p + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.remove_repeats(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted((str(a), b, c, d) for a, b, c, d in brute(rows))


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_names(spark):
    rows = [(i, t, "mine", 1, 2.0, "k") for i, t in corpus(3)]
    out = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans string, _id int, _rk double, n_words string"))
    assert out.columns == ["doc_id", "spans", "_id", "_rk", "n_words", "n_removed", "kept_text"]
    plain = S.remove_repeats(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    own = ["doc_id", "n_words", "n_removed", "kept_text"]
    assert sorted(map(str, out.select(*own).collect())) == sorted(map(str, plain.select(*own).collect()))
    assert {(r["spans"], r["_id"], r["_rk"]) for r in out.collect()} == {("mine", 1, 2.0)}
