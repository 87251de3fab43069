import random
import zlib

import numpy as np

from shutterlake.llm import langid as L

SYLLABLES = {"aa": "ka lo mi tu re", "bb": "sch ung heit zu pf", "cc": "été eux oi que à"}


def text(lang, rng, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(4)
    return [(i, text(lang, rng, rng.randint(5, 60)), lang, "x") for i in range(n) for lang in [sorted(SYLLABLES)[i % 3]]]


def test_gradients_match_differences():
    net = L.Network.fresh(["a", "b", "c"], hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    data, target = rng.integers(60, 70, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(data, target)
    for name, at in (("wx", (0, 4, 65)), ("wx", (1, 8, 61)), ("u", (0, 2, 1)), ("u", (1, 7, 2)), ("b", (1, 5, 0)), ("wo", (2, 4)), ("bo", (1, 0))):
        # states are kept in single precision, so the step is large
        step, was = 1e-2, net.p[name][at]
        net.p[name][at] = was + step
        up = net.gradients(data, target)[0]
        net.p[name][at] = was - step
        down = net.gradients(data, target)[0]
        net.p[name][at] = was
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-4, name


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(1000, None, None, "x"), (1001, "", "aa", "x"), (1002, "12 .. !", "bb", "x"), (1003, "ka lo " * 30_000, None, "x"), (1003, "ka lo " * 30_000, None, "x")]
    docs = spark.createDataFrame(corpus() + odd, "doc_id long, text string, lang string, score string")
    network = L.fit(docs, per_label=60, steps=120)
    assert network.labels == ["aa", "bb", "cc"]
    rows = L.label(docs, network).collect()
    assert len(rows) == 245
    held = [r for r in rows if r["doc_id"] < 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_pooling_covers_whole_texts():
    net = L.Network.fresh(["a", "b"], seed=2)
    one, two = b"x" * 64 * 3, b"y" * 64 * 2
    both = np.frombuffer(one + two, np.uint8)
    parts = net.text_probabilities(both, np.array([0, 192, 320]))
    whole = net.text_probabilities(both, np.array([0, 320]))
    assert np.allclose(whole[0], (3 * parts[0] + 2 * parts[1]) / 5)


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.label(docs, L.fit(docs)).first()["lang_pred"] == "und"
    assert L.label(docs.limit(0), L.fit(docs.limit(0))).count() == 0


def one_byte_at_a_time(net, raw):
    """Position probabilities of one segment by the definition of a gated recurrent unit."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h_n, states = net.p["u"].shape[2], []
    for way in (0, 1):
        wx, u, b = (net.p[k][way].astype(float) for k in ("wx", "u", "b"))
        h, seen = np.zeros(h_n), {}
        for t in range(len(raw)) if way == 0 else reversed(range(len(raw))):
            x = wx[:, raw[t]] + b[:, 0]
            update, reset = sigmoid(x[:h_n] + u[:h_n] @ h), sigmoid(x[h_n : 2 * h_n] + u[h_n : 2 * h_n] @ h)
            candidate = np.tanh(x[2 * h_n :] + reset * (u[2 * h_n :] @ h))
            h = update * h + (1 - update) * candidate
            seen[t] = h
        states.append(seen)
    out = []
    for t in range(len(raw)):
        score = net.p["wo"].astype(float) @ np.concatenate([states[0][t], states[1][t]]) + net.p["bo"][:, 0]
        out.append(np.exp(score - score.max()) / np.exp(score - score.max()).sum())
    return np.array(out)


def test_forward_pass_equals_definition():
    net = L.Network.fresh(["a", "b", "c"], seed=4)
    texts = [b"", b"x", bytes(range(64)), "Straße é ".encode() * 30, b"y" * 65]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = net.text_probabilities(data, offsets)
    assert not got[0].any()
    for k, raw in enumerate(texts):
        # a segment that is not full goes on with blanks, which are not pooled
        parts = [one_byte_at_a_time(net, raw[a : a + L.SEGMENT].ljust(L.SEGMENT))[: len(raw) - a] for a in range(0, len(raw), L.SEGMENT)]
        if parts:
            assert np.allclose(got[k], np.concatenate(parts).mean(axis=0), atol=1e-4)


def test_clashing_names_ties_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "ka lo", "aa", True, "t"), (None, "ka lo", "aa", False, "u"), (1, None, None, None, "v")], "doc_id long, text string, lang string, _letter boolean, _text string")
    net = L.Network.fresh(["aa", "bb"], seed=1)
    net.p["wo"][:] = 0  # both languages are as likely
    rows = L.label(docs, net).collect()
    assert [(r["doc_id"], r["_letter"], r["_text"], r["lang_pred"]) for r in rows] == [(1, True, "t", "aa"), (None, False, "u", "aa"), (1, None, "v", "und")]
    assert L.fit(docs.where("doc_id IS NULL")).labels == []
