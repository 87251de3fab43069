import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from shutterlake.llm import arrays as A, syncmers as S


def corpus():
    rng = random.Random(6)
    vocab = ["été", "word", "naïve", "x", "plum", "日本", "stone", "river"]
    texts = [None, "", "short", "é", "z" * 500, "ab" * 60_000] + [" ".join(rng.choice(vocab) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += [texts[-1], texts[-1] + " tail", texts[-1].replace("stone", "cloud", 1)]
    return [(3 * i - 40, t) for i, t in enumerate(texts)]


def edited(rows):
    out = {}
    for k, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        out[d] = t[: len(t) - h] + nxt[:h]
    return out


def brute_anchors(b):
    """Closed syncmers by definition."""
    mixed = lambda s: int(A.mix(np.array([int.from_bytes(s, "little")], A.U64))[0])
    out = []
    for i in range(len(b) - S.K + 1):
        inner = [mixed(b[i + j : i + j + S.S]) for j in range(S.K - S.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_anchors_equal_definition():
    rows = [(t or "").encode()[:300] for _, t in corpus()]
    data, offsets = A.flat(pa.array(rows, pa.binary()).cast(pa.string(), safe=False) if False else pa.array([r.decode(errors="ignore") for r in rows]))
    row, place, _ = S.closed_syncmers(data, offsets)
    for k in range(len(rows)):
        body = data[offsets[k] : offsets[k + 1]].tobytes()
        want = brute_anchors(body) or [0] * bool(body)
        assert sorted(place[row == k].tolist()) == want


@pytest.mark.parametrize("parts", [1, 8])
def test_rows_equal_brute_force(spark, parts):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, n_chars int").repartition(5)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["doc_id"]: r for r in S.fingerprints(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(got) == len(rows)
    other = edited(rows)
    text = {d: t or "" for d, t in rows}
    for d, t in rows:
        r = got[d]
        assert r["n_chars"] == len(t or "")
        assert r["edited_sha256"] == hashlib.sha256(other[d].encode()).hexdigest()
        both = S.sketches(*A.flat(pa.array([t or "", other[d]])))
        assert S.as_text(*both).to_pylist() == [r["fingerprint"], r["edited_fingerprint"]]
        back = S.from_text(r["fingerprint"])
        assert back[0].tolist() == both[0][:1].tolist() and back[1].tolist() == both[1][:1].tolist()
        nxt = rows[(rows.index((d, t)) + 1) % len(rows)][0]
        assert r["near_next"] == pytest.approx(S.likeness(back, S.from_text(got[nxt]["fingerprint"]))[0])
        assert 0 <= r["near_edited"] <= 1
        if text[nxt] == text[d]:
            assert r["near_next"] == 1
    long = [d for d, t in rows if t and 1500 < len(t) < 10_000]
    assert 0.15 < np.mean([got[d]["near_edited"] for d in long]) < 0.55
    assert got[rows[-2][0]]["near_next"] > 0.8 and np.mean([got[d]["near_next"] for d in long[:-4]]) < 0.1


def test_one_row_null_ids_and_empty(spark):
    one = spark.createDataFrame([(None, "abcd")], "doc_id long, text string")
    row = S.fingerprints(one).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and row["near_next"] == 1
    again = spark.createDataFrame([(1, "a" * 30), (1, "a" * 30), (None, "b")], "doc_id long, text string")
    assert S.fingerprints(again).count() == 3
    assert S.fingerprints(one.limit(0)).count() == 0


def test_every_length_has_an_anchor():
    """Texts of 0 to 64 bytes: only the empty one has an empty fingerprint, equal
    texts are alike and different ones without a common passage are not."""
    rng = random.Random(2)
    rows = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in range(65) for _ in range(12)]
    data, offsets = A.flat(pa.array(rows))
    sketched = S.sketches(data, offsets)
    prints = S.as_text(*sketched).to_pylist()
    assert all(bool(p) == bool(t) for p, t in zip(prints, rows))
    ahead = tuple(np.roll(x, -1, axis=0) for x in sketched)
    same = [t == n for t, n in zip(rows, rows[1:] + rows[:1])]
    assert (S.likeness(sketched, sketched) == 1).all()
    assert S.likeness(sketched, ahead).tolist() == [float(x) for x in same]


def test_places_beyond_16_mb():
    """Two texts that share a passage at places far apart, and at a common shift."""
    rng = np.random.default_rng(1)
    base = rng.integers(97, 123, 18_000_000, dtype=np.uint8)
    data, offsets = np.concatenate([base, base]), np.array([0, len(base), 2 * len(base)])
    row, place, _ = S.closed_syncmers(data, offsets)
    assert place.max() > 2**24 and (place[row == 0] == place[row == 1]).all()
    values, places = S.sketches(data, offsets)
    assert places.max() > 2**24
    back = S.from_text(S.as_text(values, places)[0].as_py())
    assert back[1].tolist() == places[:1].tolist()


def test_bounds_by_halving(spark):
    bounds = [-7, 0, 3, 3 + 2**40, 2**62]
    keys = [-(2**63), -8, -7, -1, 0, 2, 3, 4, 2**40, 2**40 + 3, 2**62, 2**63 - 1]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in range(len(bounds) + 1):
        got = [r[0] for r in rows.select(S._bounds_upto(S.F.col("k"), bounds[:n])).collect()]
        assert got == [sum(b <= k for b in bounds[:n]) for k in keys]


def test_all_anchors_give_the_exact_likeness(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(rng.randint(20, 3000))) for _ in range(30)]
    texts = [t for text in texts for t in (text, text[: len(text) * 3 // 4] + " " + word())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    exact = {r["doc_id"]: r for r in S.fingerprints(docs, kept=None).collect()}
    near = {r["doc_id"]: r for r in S.fingerprints(docs).collect()}
    for i, t in enumerate(texts):
        anchors = {int(exact[i]["fingerprint"][k : k + 8], 16) for k in range(0, len(exact[i]["fingerprint"]), 16)}
        hashed = S.closed_syncmers(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[2]
        assert anchors == {int(h) >> 32 for h in hashed}
    errors = [abs(exact[i][c] - near[i][c]) for i in exact for c in ("near_edited", "near_next")]
    assert np.mean(errors) < 0.06 and max(errors) < 0.3
