import hashlib
import random

from pyspark.sql import functions as F

from shutterlake.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, _group int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(hashes, fan):
    """Root, and each leaf's siblings (left, right) level by level."""
    proofs, spots = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, at in enumerate(spots):
            run = hashes[at // fan * fan : at // fan * fan + fan]
            proofs[k].append((run[: at % fan], run[at % fan + 1 :]))
        hashes = [sha("".join(hashes[a : a + fan])) for a in range(0, len(hashes), fan)]
        spots = [at // fan for at in spots]
    return hashes[0], proofs


def brute(rows, fan, tamper):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    out, subroots, kept = [], [], []
    for name in names:
        held = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, proofs = grown([leaf(r) for r in held], fan)
        subroots.append(sub)
        kept.append((held, proofs))
    root, tops = grown(subroots, fan)
    for k, (held, proofs) in enumerate(kept):
        for r, proof in zip(held, proofs):
            whole = proof + tops[k]
            h = leaf((*r[:4], tamper(r)))
            for left, right in whole:
                h = sha("".join([*left, h, *right]))
            out.append((r[0], leaf(r), subroots[k], root, sha("".join("".join([*a, *b]) for a, b in whole)), h, h == root))
    return sorted(out, key=str)


def rows(seed=5):
    rng = random.Random(seed)
    out = []
    for name, n in ((None, 4), ("a", 1), ("b", 28), ("ü", 9), ("", 2), ("=", 3), ("z", 10), ("hot", 120)):
        ids = rng.sample(range(-50, 1000), n)
        out += [(i, name, rng.choice([None, "en", "dé"]), rng.choice([None, 3, -1]), rng.choice([None, "", "x\ny", "é\n" * 50, "plain"])) for i in ids]
    out += [(None, "b", None, None, None), (None, "b", "en", 1, "q")]
    return out + out[20:24] + [(7, "hot", "en", 1, "t" * 200_000), (7, "hot", "en", 2, "\n")]


def result(spark, data, **more):
    docs = spark.createDataFrame([(*r, "mine", 1) for r in data], SCHEMA)
    changed = F.when(F.col("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = M.document_manifest(docs, changed, **more)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def tampered(r):
    return r[4].replace("\n", "") if r[4] and r[0] is not None and r[0] % 2 == 0 else r[4]


def test_equals_brute_force(spark):
    data = rows()
    got = result(spark, data)
    assert got == brute(data, 3, tampered)
    # a row is refused just where its text was changed
    changed = sum(tampered(r) != r[4] for r in data)
    assert sum(not g[-1] for g in got) == changed > 0


def test_other_fan_and_one_row(spark):
    data = rows(9)
    assert result(spark, data, fan=2) == brute(data, 2, tampered)
    one = [(5, None, None, None, None)]
    assert result(spark, one) == brute(one, 3, tampered)


def test_one_group_over_many_ranges(spark):
    data = [(k, "one", "en", k, f"text {k % 50}") for k in range(2000)] + [(3, "one", "en", 1, "same")] * 300
    assert result(spark, data) == brute(data, 3, tampered)


def test_nothing_in_nothing_out(spark):
    assert M.document_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_untampered_rows_all_verify(spark):
    out = M.document_manifest(spark.createDataFrame([(*r, "mine", 1) for r in rows(2)], SCHEMA)).collect()
    assert all(r["verified"] for r in out)
