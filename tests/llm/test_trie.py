import hashlib
import random
import zlib

from shutterlake.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    nodes, chains = {}, {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        family = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seq = own.get(family, [])[:h] + own[c][h:]
        key, path = b"", [b""]
        for t in seq:
            key = hashlib.sha256(key + repr(t).encode()).digest()
            path.append(key)
        chains[c] = path
        for d, k in enumerate(path):
            node = nodes.setdefault((d, k), {"conv": c, "n": 0, "kids": set(), "ends": [], "bytes": len(seq[d - 1][1].encode()) if d else 0, "up": path[d - 1] if d else None})
            node["n"] += 1
            if d:
                nodes[d - 1, path[d - 1]]["kids"].add(k)
        nodes[len(seq), path[-1]]["ends"].append(c)
    total = {}
    for d, k in sorted(nodes, key=lambda x: -x[0]):
        v = nodes[d, k]
        below = [total[d + 1, x] for x in v["kids"]]
        total[d, k] = (sum(b[0] for b in below) or (not below), (v["n"] - 1) * v["bytes"] + sum(b[1] for b in below))
    out = []
    for (d, k), v in nodes.items():
        up = nodes[d - 1, v["up"]]["conv"] if d else None
        ends = hashlib.sha256(",".join(map(str, v["ends"])).encode()).hexdigest()
        out.append((v["conv"], d, up, v["n"], len(v["kids"]), int(total[d, k][0]), total[d, k][1], ends))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame([(*r, 3, "mine") for r in rows], SCHEMA)
    out = T.prefix_trie(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def conversations(seed, n):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-60, 400), n):
        for turn in range(rng.randint(1, 12)):
            text = rng.choice(["yes", "no", "", None, "é", "more"]) if rng.random() < 0.9 else str(rng.random())
            out.append((c, turn if rng.random() < 0.9 else rng.choice([None, 3]), rng.choice(["user", "user", None, "assistant"]), text))
    return out


def test_equals_brute_force(spark):
    rows = conversations(1, 150)
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = conversations(2, 30)
    rows += rows[:20] + [(None, 1, "user", "lost"), (2**40, None, None, None), (2**40, None, None, None)]
    assert result(spark, rows) == brute(rows)


def test_many_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 6000, 5) for t in range(3)] + conversations(3, 20)
    got = result(spark, rows)
    assert got == brute(rows)
    assert max(r[3] for r in got if r[1] == 3) >= 1200


def test_pieces_of_a_digest(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 7)
    rows = [(c, 0, "user", "hello") for c in range(0, 500, 5)]
    assert result(spark, rows) == brute(rows)


def test_a_conversation_longer_than_a_chunk(spark):
    rows = [(10, t, "user", f"{t % 7}") for t in range(3000)] + [(11, t, "user", f"{t % 7}") for t in range(2500)] + [(12, 0, "user", "x" * 300_000)]
    assert result(spark, rows) == brute(rows)


def test_totals_of_nested_branches(spark):
    # each conversation leaves the one before a turn later: as many rounds of messages as conversations
    rows = [(5 * c, t, "user", "same" if t < c else f"own {c}") for c in range(12) for t in range(c + 10)]
    assert result(spark, rows) == brute(rows)


def test_nothing_in_nothing_out(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert T.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "")], SCHEMA)).collect() == []
