import random
import zlib

import numpy as np
import pytest

from shutterlake.llm import arrays as A, toxicity as X
from tests.llm.shuffled import shuffled

BAD = ["blarg", "snorf", "zquint"]


def corpus(n=600):
    rng = random.Random(8)
    s = "ka lo mi tu re sa no".split()
    word = lambda: "".join(rng.choice(s) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(10, 200))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(s))
        docs.append((i, " ".join(w), "x"))
        if i % 3:
            labels.append((i, toxic))
        elif toxic:
            docs[-1] = (i, " ".join(w), "toxic, unlabelled")
    return docs, labels


def ngrams(text):
    """The n-grams of a text by definition: words with a blank behind each."""
    stream = b" " * (X.ORDER - 1) + b"".join(w.encode().lower() + b" " for w in (text or "").split())
    return [stream[i : i + X.ORDER] for i in range(len(stream) - X.ORDER + 1)]


def counted(rows):
    counts = {}
    for text, toxic in rows:
        for g in ngrams(text):
            counts.setdefault(g, [0, 0])[toxic] += 1
    return counts


class Brute:
    """Interpolated Kneser-Ney straight from the definition."""

    def __init__(self, counts):
        self.levels = {X.ORDER: counts}
        for k in range(X.ORDER - 1, 1, -1):
            low = {}
            for g, n in self.levels[k + 1].items():
                for c in (0, 1):
                    low.setdefault(g[1:], [0, 0])[c] += n[c] > 0
            self.levels[k] = low
        self.pairs = {g: sum(n) for g, n in self.levels[2].items()}
        self.types = {}
        for g in self.pairs:
            self.types[g[1:]] = self.types.get(g[1:], 0) + 1

    def pair(self, g):
        one = (self.types.get(g[1:], 0) + 1) / (len(self.pairs) + 256)
        same = [n for h, n in self.pairs.items() if h[:1] == g[:1]]
        return (max(self.pairs.get(g, 0) - 0.75, 0) + 0.75 * len(same) * one) / sum(same) if same else one

    def probability(self, gram, cls):
        p = self.pair(gram[-2:])
        for k in range(3, X.ORDER + 1):
            g, level = gram[-k:], self.levels[k]
            same = [n[cls] for h, n in level.items() if h[:-1] == g[:-1] and n[cls]]
            if same:
                p = (max(level.get(g, [0, 0])[cls] - 0.75, 0) + 0.75 * len(same) * p) / sum(same)
        return p


def test_model_equals_definition(spark):
    rows = [("abc abd xyz", 0), ("abc bad bad", 1), ("Badly  done\n", 1), (None, 0), ("", 1)]
    from shutterlake.llm.shared import scratch

    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, toxic int")
    with scratch(spark) as save:
        model = X.fit(frame, frame.limit(0), save)
    brute = Brute(counted(rows))
    for text in ("abc", "bad bad", "an unseen one", "x", "done abc"):
        want = [np.log(brute.probability(g, 1) / brute.probability(g, 0)) for g in ngrams(text)]
        assert model.byte_ratios(text) == pytest.approx(want, abs=1e-9)
    for context in (b" abc", b"bad ", b"zzzz"):  # what may follow a context has a probability of 1 in all
        for cls in (0, 1):
            assert sum(brute.probability(context + bytes([c]), cls) for c in range(256)) == pytest.approx(1)


def test_features_are_the_most_toxic_passages():
    texts = ["aa b ccc dd e ff", "one", "", "x y z", "aa b"]
    data, offsets = A.flat(X.pa.array(texts))
    rng = np.random.default_rng(5)
    grams = sorted({int.from_bytes(g) for t in texts for g in ngrams(t)})
    known = X.Ratios(np.array(grams), rng.normal(size=len(grams)))
    value = dict(zip(grams, known.ratio))
    got = known.features(data, offsets)
    for t, f in zip(texts, got):
        r, words = [value[int.from_bytes(g)] for g in ngrams(t)], t.split()
        at = np.cumsum([0] + [len(w) + 1 for w in words])
        want = [np.mean(r) if r else 0]
        for k in X.PASSAGES:
            means = [np.mean(r[at[i] : at[i + k]]) for i in range(len(words) - k + 1)]
            want.append(max(means) if means else want[0])
        assert f == pytest.approx(want)


def test_expressions_of_two_words(spark):
    """Both words are ordinary; only side by side do they mean anything."""
    rng = random.Random(1)
    base = "ab cd ef gh kl mn".split()
    docs, labels = [], []
    for i in range(500):
        w = [rng.choice(base) for _ in range(40)] + ["up", "it", "so"]
        rng.shuffle(w)
        toxic = int(i % 5 == 2)
        text = " ".join(w).replace("up it", "up so it")
        docs.append((i, text.replace("up ", "up it ", 1) if toxic else text))
        labels.append((i, toxic))
    rows = X.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == dict(labels)[r["doc_id"]] for r in held]) > 0.9


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    truth = {i: int("x" != s or any(b in t for b in BAD)) for i, t, s in docs}
    odd = [(9001, None, "x"), (9002, "", "x"), (9003, "ka lo " * 40_000, "x"), (9003, "ka lo " * 40_000, "x"), (None, "mi tu", "x")]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(5, None), (77777, 1), (None, 1)], "doc_id long, toxic int")
    rows = X.score_toxicity(frame, marks).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 9000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] is None or r["doc_id"] > 9000)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.score_toxicity(docs, none).count() == 1
    assert X.score_toxicity(docs.limit(0), none).count() == 0


def test_unseen_words_back_off_at_any_size(spark):
    """Of many distinct n-grams each has its own count, and one that was never
    counted has none."""
    from shutterlake.llm.shared import scratch

    rng = np.random.default_rng(3)
    letters = rng.integers(ord("a"), ord("m") + 1, (40, 4000, 7)).astype(np.uint8)
    texts = [(i, " ".join(bytes(w).decode() for w in row), i % 2) for i, row in enumerate(letters)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    with scratch(spark) as save:
        model = X.fit(frame, frame.limit(0), save)
    counts = counted(t[1:] for t in texts)
    assert len(counts) > 200_000
    # letters that no text has: only the shared counts speak, for both classes
    assert model.byte_ratios("nopqrst").sum() == pytest.approx(0, abs=0.3)
    (n,) = [r["n"] for r in model.count[X.ORDER].selectExpr("sum(n0 + n1) AS n").collect()]
    assert n == sum(map(sum, counts.values())) and model.count[X.ORDER].count() == len(counts)


def test_rows_in_another_order_each_time_and_clashing_names(spark):
    docs, labels = corpus(400)
    plain = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    named = spark.createDataFrame([(i, t, 1.5, "mine", 2, 0.5) for i, t, _ in docs], "doc_id long, text string, f0 double, _block string, f2 int, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = X.score_toxicity(shuffled(named), marks)
    assert out.columns == ["doc_id", "f0", "_block", "f2", "score", "predicted"]
    rows = out.collect()
    assert {(r["f0"], r["_block"], r["f2"]) for r in rows} == {(1.5, "mine", 2)}
    want = {r["doc_id"]: r["score"] for r in X.score_toxicity(plain, marks).collect()}
    assert {r["doc_id"] for r in rows} == set(want) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 for r in rows)
