import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shutterlake.llm import ngram_join as N
from shutterlake.llm.components import connected


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def shingle_set(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, threshold=0.8):
    seqs = {}
    for d, t in rows:
        seqs.setdefault(tuple(words(t)), []).append(d)
    items = list(seqs)
    sets = [shingle_set(s) for s in items]
    group = list(range(len(items)))
    find = lambda x: x if group[x] == x else find(group[x])
    links = [0] * len(items)
    for i in range(len(items)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / u >= threshold:
                links[i] += 1
                links[j] += 1
                group[find(i)] = find(j)
    least = {}
    for i, s in enumerate(items):
        least[find(i)] = min(least.get(find(i), 10**9), min(seqs[s]))
    out = []
    for i, s in enumerate(items):
        for d in seqs[s]:
            out.append((d, least[find(i)] if s else d, min(seqs[s]), len(seqs[s]), links[i]))
    return sorted(out)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(400)]
    texts = [None, "", " \n ", "one", "one", "two words", "a b c d", "a b c d e", "x " * 60, "x " * 90, "long " + "tail " * 40_000]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 300))]
        texts += [" ".join(base), "\t".join(base)]
        for _ in range(rng.randint(0, 8)):
            other = list(base)
            for _ in range(rng.randint(1, 4)):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            texts.append(" ".join(other))
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [3, 128])
def test_equals_brute_force(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_links int")
    got = N.near_duplicates(docs, trees=40, target=0.9999, block=block)
    assert got.columns == ["doc_id", "class_id", "copy_of", "n_copies", "n_links"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_keep_one(spark):
    rows = corpus(2)
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows] + [(None, "one", "s")], "doc_id long, text string, source string")
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    want = {r[0] for r in brute(rows) if r[1] == r[0]} | {None}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_matched_depth_shortens_to_the_target():
    assert N.matched_depth(12, 8, 0.8, 0.998) == 4
    assert N.matched_depth(12, 3, 0.8, 0.998) == 3
    assert N.matched_depth(12, 8, 0.8, 0.5) > N.matched_depth(12, 8, 0.8, 0.9)
    with pytest.raises(ValueError):
        N.matched_depth(1, 4, 0.8, 0.99)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    group = {n: n for p in pairs for n in p}
    for _ in range(200):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    got = {r["node"]: r["group"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: g for n, g in group.items() if any(n in p and p[0] != p[1] for p in pairs)}


def edited(seed=6, groups=40):
    """Groups of copies of a text that has the largest id of its group: each
    copy has changes of its own, so it is near the text but not the others."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"v{g}x{i}" for i in range(200)]
        for k in range(3):
            other = list(base)
            for at in range(20 + 60 * k, 41 + 60 * k, 10):
                other[at] = f"new{g}x{k}x{at}"
            rows.append((10 * g + k, " ".join(other)))
        rows.append((10 * g + 5, " ".join(base)))
    rng.shuffle(rows)
    return rows


def test_copies_of_a_text_with_the_largest_id(spark):
    rows = edited()
    want = brute(rows)
    assert {w[4] for w in want} == {1, 3}  # copies link with their text only
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(docs).collect())) == want
    assert {r["doc_id"] for r in N.keep_one(docs).collect()} == {w[0] for w in want if w[0] == w[1]}


@pytest.mark.parametrize("cross", [False, True])
def test_meeting_connects_every_link(cross):
    # the path 1-4, 4-3, 3-2: each set shares nine of eleven hashes with the next
    sets = {c: np.arange(a, a + 10, dtype=np.uint64) for c, a in ((1, 0), (4, 1), (3, 2), (2, 3))}
    node = pa.array([[{"tree": 0, "node": 9}]] * 4, pa.list_(pa.struct([("tree", pa.int32()), ("node", pa.int64())])))
    members = pa.table({"cls": list(sets), "side": [0, 1, 0, 1], "tree": [0] * 4, "nodes": node, "set": [s.tobytes() for s in sets.values()]})
    out = N.meet(members, 0.8, cross).to_pydict()
    assert dict(zip(out["cls"], out["links"])) == {1: 1, 2: 1, 3: 2, 4: 2}
    assert set(out["least"]) == {1}


def test_recall_with_the_shipped_values(spark):
    """Pairs just above the threshold (57 of 71 shingles shared: 0.803), once as
    groups of two, and once with nodes so large that they keep their full depth."""
    rng = random.Random(9)
    rows, n = [], 1500
    for g in range(n):
        base = [f"p{rng.randrange(10**9)}" for _ in range(68)]
        other = base[:61] + [f"q{rng.randrange(10**9)}" for _ in range(7)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (N.BLOCK, 1):
        got = N.near_duplicates(docs, block=block).where("n_links = 1").count()
        assert got >= N.TARGET_RECALL * 2 * n - 6, got


def test_a_large_group_of_variants(spark):
    """Every variant differs from the text in one place: all pairs are links, in
    nodes of more classes than a block holds."""
    base = [f"w{i}" for i in range(150)]
    rows = [(k, " ".join(base[: k % 150] + [f"v{k}"] + base[k % 150 + 1 :])) for k in range(700)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=64).collect()
    assert {r["class_id"] for r in got} == {0}
    sets = [shingle_set(t.split(" ")) for _, t in rows]
    total = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert sum(r["n_links"] for r in got) >= N.TARGET_RECALL * 2 * total


def test_texts_that_share_an_id_are_not_linked(spark):
    a, b = ("a" + str(k) for k in range(30)), ("b" + str(k) for k in range(30))
    a, b = " ".join(a), " ".join(b)
    rows = [(1, a, "p"), (1, b, "q"), (2, a, "r"), (3, b, "s"), (3, b, "s"), (None, a, "t"), (4, a + " more", "u"), (1, None, "v"), (5, "", "w")]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, _row string")).collect()
    got = {r["_row"]: (r["class_id"], r["copy_of"], r["n_links"]) for r in out}
    assert len(out) == 9
    assert got == {"p": (1, 1, 1), "r": (1, 1, 1), "u": (1, 4, 1), "q": (1, 1, 0), "s": (1, 1, 0), "t": (None, None, None), "v": (1, 1, 0), "w": (5, 1, 0)}
    assert {r["_row"]: r["n_copies"] for r in out} == {"p": 2, "r": 2, "u": 1, "q": 3, "s": 3, "t": None, "v": 2, "w": 2}
    kept = N.keep_one(spark.createDataFrame([r[:2] for r in rows if r[0]], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], (r["text"] or "")[:1]) for r in kept) == [(1, ""), (1, "a"), (1, "b"), (5, "")]
