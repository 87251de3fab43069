import hashlib

import numpy as np
import public_tokenizers as public
from hypothesis import given, settings, strategies as st

from shutterlake.llm import arrays as A, bpe, pretokens
from tests.llm.shuffled import shuffled

PATH = public.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "a", "don't it's we'll x're 'sx ''s  a  'd ' s", "\n\n\tx", "日本 語  123abc\r\n", "<|endoftext|>", "l'l'll 'll've ", "é" * 40_000, "same text", "same text", " "]


def tiktoken_ids(text):
    return pretokens.encoding(PATH, public.PATTERN).encode_ordinary(text or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("a'stlrevmd LL  \n\t1²½é日'!? \x85"), max_size=30), max_size=6))
def test_array_encoder_equals_tiktoken(texts):
    import pyarrow as pa

    data, offsets = A.flat(pa.array(texts, pa.string()))
    ids, at = pretokens.Encoder(PATH, public.PATTERN).encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tiktoken_ids(t) for t in texts]


def test_varint_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert bpe.unvarint(bpe.varint(values)[0]).tolist() == values.tolist()


def test_round_trip_equals_tiktoken(spark):
    docs = spark.createDataFrame([(i % 9, t, "x") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, ids string")
    rows = bpe.encode_decode(docs, PATH, public.PATTERN).collect()
    want = sorted((i % 9, np.array(tiktoken_ids(t), "<u4").tobytes(), (t or "").encode()) for i, t in enumerate(TEXTS * 2))
    assert sorted((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    digests = bpe.encode_decode(docs, PATH, public.PATTERN, digests=True).collect()
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in digests) == sorted((d, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()) for d, a, b in want)


def test_repeated_blocks(spark):
    docs = spark.createDataFrame([(1, "one two")] * 4, "doc_id long, text string").repartition(4)
    assert bpe.encode_decode(docs, PATH, public.PATTERN).count() == 4


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH, public.PATTERN).count() == 0


def test_rows_in_another_order_each_time(spark):
    texts = [f"text {i} of {i * 7919 % 1009}" for i in range(300)]
    docs = shuffled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert docs.collect() != docs.collect()
    got = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.encode_decode(docs, PATH, public.PATTERN).collect()}
    assert got == dict(enumerate(texts))
