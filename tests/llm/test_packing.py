import random
import struct

import public_tokenizers as public
from tokenizers import Tokenizer

from shutterlake.llm import packing

ARGS = public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.PATTERN


def sequential(lengths, capacity):
    """Best-fit decreasing, one piece after the other, by looking at all bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        if fit:
            b = min(fit, key=lambda b: bins[b])
        else:
            b = len(bins)
            bins.append(capacity)
        bins[b] -= n
    return sorted(bins)


def test_plan_equals_sequential_best_fit():
    random.seed(3)
    for capacity in (10, 64, 1024):
        for n in (0, 1, 50, 400):
            lengths = [random.randint(1, capacity if n % 2 else max(1, capacity // 3)) for _ in range(n)]
            counts = {}
            for x in lengths:
                counts[x] = counts.get(x, 0) + 1
            plan = packing.best_fit_decreasing(counts, capacity)
            free = [capacity] * plan.bins
            for length, first, last, each, start, offset in plan.rows:
                for k in range(last - first + 1):
                    b = start + k // each
                    assert capacity - free[b] == offset + (k % each) * length
                    free[b] -= length
            assert sorted(free) == sequential(lengths, capacity)


def test_pieces_and_places(spark):
    texts = [None, "", "hello world", "don't <|endoftext|> stop", "é日本 \n\n x " * 3000, "a " * 900, "word " * 1022, "word " * 1023] + [f"doc {i} " * (i % 90) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, offset string")
    pieces = packing.token_pieces(docs, *ARGS).checkpoint()
    tok = Tokenizer.from_file(ARGS[1])
    got = {}
    for r in pieces.collect():
        ids = list(struct.unpack(f"<{r['length']}I", r["ids"]))
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], ids))
    for i, t in enumerate(texts):
        rows = sorted(got[i])
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert [x for r in rows for x in r[2]] == tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert all(len(r[2]) == 1024 for r in rows[1:])
        assert [r[1] for r in rows] == [sum(len(x[2]) for x in rows[:k]) for k in range(len(rows))]
    packed = packing.pack(pieces.drop("ids")).collect()
    assert len(packed) == pieces.count()
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) == len(sequential([r["length"] for r in packed], 1024))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.token_pieces(docs, *ARGS)).count() == 0
