import random
import zlib

import numpy as np
import pyarrow as pa

from shutterlake.llm import arrays as A, quality as Q


def stats(*texts):
    return Q.statistics(*A.flat(pa.array(texts, pa.string())))


def of(text, name):
    return stats(text)[0, Q.STATISTICS.index(name)]


def clean(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def test_statistics_of_small_texts():
    assert not stats("").any() and not stats(None).any()
    assert np.isclose(of("ab cd\nab", "lines"), np.log1p(2)) and np.isclose(of("ab cd\nab", "words"), np.log1p(3))
    assert of("ab ab ab cd", "words_repeated") == 0.5
    assert of("AB CD ef", "shouted") == 2 / 3 and of("ABc De", "shouted") == 0
    assert of("a1 23", "digits") == 3 / 5
    assert of("x\nx\ny\nx", "lines_repeated") == 0.5
    assert np.isclose(of("éa", "chars"), np.log1p(2)) and of("éa", "wide") == 0.5
    assert of("a | b | c", "bare_signs") == 2 / 5
    assert of("one### two$$$ three", "signed") == 2 / 3
    assert np.isclose(of("ab abcd", "word_bytes"), 3) and np.isclose(of("ab abcd", "word_spread"), 1)


def test_statistics_do_not_depend_on_the_neighbours():
    rng = random.Random(1)
    texts = [clean(rng, rng.randint(0, 200)) if k % 5 else ["", None, "A\n\nB", "## $$", "é" * 3000][k // 5 % 5] for k in range(60)]
    together = stats(*texts)
    assert np.allclose(together, np.concatenate([stats(t) for t in texts]))
    assert np.isfinite(together).all()


def test_worst_passage_shows_a_short_junk_part():
    rng = random.Random(2)
    text = clean(rng, 3000) + " " + " ".join("NOW!! BUY!!" for _ in range(20))
    assert of(text, "shouted") < 0.05 and of(text, "worst_shouted") > 0.9


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 5))
    z = Q.Kernel.drawn(np.zeros(5), np.ones(5), features=20_000).features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * Q.WIDTH**2 * 5))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_isotonic_equals_the_minmax_formula():
    rng = np.random.default_rng(4)
    y, w = rng.random(30) + np.arange(30) / 30, rng.integers(1, 9, 30).astype(float)
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    brute = [max(min(mean(a, b) for b in range(k, 30)) for a in range(k + 1)) for k in range(30)]
    assert np.allclose(np.interp(np.arange(30), *Q.isotonic(np.arange(30.0), y, w)), brute)


def test_normal_equations_add_up_over_partitions(spark):
    rng = np.random.default_rng(5)
    k = len(Q.STATISTICS)
    x, y = rng.standard_normal((300, k)), rng.integers(0, 2, 300).astype(float)
    kernel = Q.Kernel.drawn(x.mean(axis=0), x.std(axis=0), features=16)
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "stats array<double>, y double")
    for n in (1, 7):
        a, b = Q.normal_equations(rows.repartition(n), kernel, 4)
        z = kernel.features(x)
        assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)


def corpus(n):
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        text = clean(rng, rng.randint(15, 120))
        if bad:
            text = [text.upper() + "!!", " ".join(w + "###" for w in text.split()), " | ".join(text.split()), "same " * 60][k // 4 % 4]
        docs.append((k, text, "en", 1.5))
        labels.append((k, 0 if bad else 1))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, score double", "doc_id long, quality int"


def test_held_out_rows_are_told_and_odd_rows_have_scores(spark):
    docs, labels = corpus(1600)
    odd = [(9000, None, "en", 0.0), (9001, "", "en", 0.0), (None, "ordinary words of a text", "en", 0.0), (9002, "BUY!! NOW!! " * 50_000, "en", 0.0), (9002, "BUY!! NOW!! " * 50_000, "fr", 1.0)]
    more = [(None, 1), (9000, None), (12345, 1), (4, 0), (4, 0)]
    out = Q.score_quality(spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + more, LABELS))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 1605
    truth = dict(labels)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 1600 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 300 and all(r["held_out"] for r in held)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (9000, 9001)}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] == 9002}) == 1 and {r["predicted"] for r in rows if r["doc_id"] == 9002} == {0}
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(400)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    a, b = (sorted(map(tuple, Q.score_quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(x, LABELS)).collect())) for x in (labels, turned))
    assert [r[0] for r in a] == [r[0] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b], atol=1e-6)


def test_empty_tables_and_one_kind_of_label(spark):
    docs, labels = corpus(40)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in Q.score_quality(spark.createDataFrame(docs, DOCS), none).collect()} == {0.5}
    assert Q.score_quality(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).collect() == []
    good = spark.createDataFrame([x for x in labels if x[1]], LABELS)
    assert all(r["score"] > 0.9 for r in Q.score_quality(spark.createDataFrame(docs, DOCS), good).collect() if r["doc_id"] % 4)
