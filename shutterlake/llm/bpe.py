"""Byte-level BPE of a whole corpus with each distinct word encoded once.

Texts are cut into pre-tokens in blocks (the rows of one slice of an Arrow
batch). A block keeps, for each of its documents, the positions: which of the
block's distinct words stands where. The distinct words of all blocks are
shuffled together and encoded once each; their ids are joined back to the
blocks, which put their documents together by position. Decoding joins the
documents' ids with the table of token bytes.

Words and positions are cut in two passes over the texts, which have to see
the same rows in the same order: rows read straight from files do, any others
are stored first. A block's name comes from its content, so a task that runs
again names it the same. Repeated blocks (the same documents twice) share one name and are told
apart by their place in the cogrouped rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .shared import partitions, scratch, settled

BLOCK_BYTES = 32_000_000


def _cut(table: pa.RecordBatch):
    """For each block: its name, doc ids, distinct words and positions."""
    from .pretokens import code_points, hashes, split

    data, offsets = A.flat(table.column("text"))
    for i, j in A.slices(offsets, BLOCK_BYTES):
        names, sizes, firsts, codes, bodies = [], [], [0], [], []
        for a, b in A.slices(offsets[i : j + 1] - offsets[i]):
            part = data[offsets[i + a] : offsets[i + b]]
            points, at = code_points(part, offsets[i + a : i + b + 1] - offsets[i + a])
            starts, first = split(points, at)
            local, distinct = pd.factorize(hashes(points, starts))
            where = np.zeros(len(distinct), np.int64)
            where[local[::-1]] = np.arange(len(local))[::-1]
            heads = starts if len(points) == len(part) else np.flatnonzero((part & 0xC0) != 0x80)[starts] if len(starts) else starts
            ends = np.append(heads, len(part))
            names.append(distinct)
            codes.append(local)
            firsts.extend(np.diff(first))
            length = ends[where + 1] - ends[where]
            sizes.append(length)
            bodies.append(part[np.repeat(ends[where], length) + A.ramp(length)])
        # one numbering for the block
        every = np.concatenate(names) if names else np.zeros(0, A.U64)
        number, distinct = pd.factorize(every)
        base = np.cumsum([0, *map(len, names)])
        codes = [number[base[k] : base[k + 1]][c] for k, c in enumerate(codes)]
        size, body = np.concatenate(sizes), np.concatenate(bodies)
        keep = np.zeros(len(distinct), np.int64)
        keep[number[::-1]] = np.arange(len(number))[::-1]
        end = np.cumsum(size)
        words = A.binary(body[np.repeat((end - size)[keep], size[keep]) + A.ramp(size[keep])], np.concatenate([[0], np.cumsum(size[keep])]))
        docs = table.column("doc_id").slice(i, j - i)
        codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        # common words get small numbers: their positions take few bytes
        rank = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        codes = place[codes].astype(np.uint32)
        tag = hashlib.blake2b(data[offsets[i] : offsets[j]].tobytes(), digest_size=8, key=repr(docs[:2].to_pylist() + [j - i]).encode()[:64])
        name = int.from_bytes(tag.digest(), "little", signed=True)
        yield name, docs, words.take(pa.array(rank)), np.cumsum(firsts), codes


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**28 as 7-bit groups, low first; and each one's size."""
    values = values.astype(np.uint32)
    size = 1 + (values >= 1 << 7).astype(np.int64) + (values >= 1 << 14) + (values >= 1 << 21)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k
        out[at[has] + k] = ((values[has] >> np.uint32(7 * k)) & 0x7F).astype(np.uint8) | np.where(size[has] > k + 1, 0x80, 0).astype(np.uint8)
    return out, size


def unvarint(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 0x80)
    start = np.concatenate([[0], last[:-1] + 1])
    shift = np.arange(len(data)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((data & 0x7F).astype(np.int64) << (7 * shift), start)


def block_words(docs: DataFrame) -> DataFrame:
    """block, number, word: the distinct pre-tokens of each block."""

    def run(batches):
        for batch in batches:
            for name, _, words, _, _ in _cut(batch):
                yield pa.record_batch([pa.array(np.full(len(words), name)), pa.array(np.arange(len(words)), pa.int32()), words], ["block", "number", "word"])

    return docs.select("doc_id", "text").mapInArrow(run, "block long, number int, word binary")


def block_positions(docs: DataFrame) -> DataFrame:
    """block, doc_id, positions: which word of the block stands where."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for name, ids, _, first, codes in _cut(batch):
                data, size = varint(codes)
                ends = np.concatenate([[0], np.cumsum(size)])
                yield pa.record_batch([pa.array(np.full(len(ids), name)), ids, A.binary(data, ends[first])], ["block", "doc_id", "positions"])

    return docs.select("doc_id", "text").mapInArrow(run, f"block long, doc_id {kind}, positions binary")


def encode_words(words: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """block, numbers, sizes, ids: the words of all blocks shuffled by word, so
    that each distinct one is in one place, where it is encoded once and its ids
    are joined to the blocks that hold it. A row has what one block gets from a
    run of words: their numbers, and each one's number of ids, and the ids, all
    as 7-bit groups."""

    def run(batches):
        from .pretokens import encoding

        enc = encoding(ranks_path, pattern)
        before, ids, held, rows = None, b"", [], 0

        def by_block():
            block, number, coded = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.lexsort((number, block))
            block, number, coded = block[order], number[order], coded[order]
            head = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            data, size = varint(number)
            counts = np.fromiter(map(len, coded), np.int64, len(coded))
            tokens = np.fromiter((sum(x < 0x80 for x in c) for c in coded), np.int64, len(coded))
            sizes, wide = varint(tokens)
            blob = np.frombuffer(b"".join(coded), np.uint8)
            cuts = [np.concatenate([[0], np.cumsum(x)])[np.append(head, len(block))] for x in (size, wide, counts)]
            return pa.record_batch([pa.array(block[head]), *(A.binary(x, c) for x, c in zip((data, sizes, blob), cuts))], ["block", "numbers", "sizes", "ids"])

        for batch in batches:
            column = pa.compute.run_end_encode(batch.column("word"))
            ends, out = column.run_ends.to_numpy(), []
            for word in column.values.to_pylist():
                if word != before:
                    before, ids = word, varint(np.array(enc.encode_ordinary(word.decode()), np.uint32))[0].tobytes()
                out.append(ids)
            coded = np.empty(len(out), object)
            coded[:] = out
            held.append((batch.column("block").to_numpy(), batch.column("number").to_numpy(), coded[np.repeat(np.arange(len(out)), np.diff(np.append(0, ends)))]))
            rows += batch.num_rows
            if rows >= 200_000:
                yield by_block()
                held, rows = [], 0
        if rows:
            yield by_block()

    n = partitions(words.sparkSession)
    return words.repartition(n, "word").sortWithinPartitions("word").mapInArrow(run, "block long, numbers binary, sizes binary, ids binary")


def token_bytes(ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary's bytes end to end, and each token's start (and the end)."""
    from .pretokens import ranks

    known = ranks(ranks_path)
    table = [b""] * (max(known.values()) + 1)
    for body, token in known.items():
        table[token] = body
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in table])])


def join_token_bytes(ids: np.ndarray, body: np.ndarray, at: np.ndarray) -> bytes:
    """The bytes of ``ids`` by look-up in the token-byte table."""
    size = at[ids + 1] - at[ids]
    return body[np.repeat(at[ids], size) + A.ramp(size)].tobytes() if len(ids) else b""


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False, from_files: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (binary, little-endian
    unsigned 32-bit) and decoded (the ids' bytes); with ``digests`` the lower-case
    hex SHA-256 of the last two in their place (ids_sha256, decoded_sha256).

    Null and empty texts have no tokens. Special tokens' strings are ordinary
    text. Rows are independent: repeated ids or texts give repeated results,
    and other columns of ``docs`` are ignored. An empty table gives no rows.
    The token-byte table is a vocabulary, the same at any input size, so every
    task holds it.

    ``from_files`` says that ``docs`` is read straight from files, with nothing
    but column choices and filters behind, and so gives its rows in the same
    order each time; else its doc_id and text are stored for the time of the
    run and the result is settled.
    """
    if not from_files:
        with scratch(docs.sparkSession) as save:
            return settled(encode_decode(save(docs.select("doc_id", "text")), ranks_path, pattern, digests, from_files=True))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def assemble(key, left, right):
        def together(name):
            column = right.column(name)
            return unvarint(np.frombuffer(b"".join(x for x in column.to_pylist()), np.uint8))

        number, size, ids = together("numbers"), together("sizes"), together("ids")
        # a block that occurs twice brings each of its words twice
        order = np.unique(number, return_index=True)[1]
        start, size = (np.cumsum(size) - size)[order], size[order]
        body, at = token_bytes(ranks_path)
        docs_, counts, coded, decoded = [], [], [], []
        for batch in left.to_batches():
            for doc, places in zip(batch.column("doc_id").to_pylist(), batch.column("positions")):
                words = unvarint(np.frombuffer(places.as_buffer(), np.uint8))
                n = size[words]
                own = ids[np.repeat(start[words], n) + A.ramp(n)] if len(words) else ids[:0]
                docs_.append(doc)
                counts.append(len(own))
                coded.append(own.astype("<u4").tobytes())
                decoded.append(join_token_bytes(own, body, at))
                if digests:
                    coded[-1], decoded[-1] = (hashlib.sha256(x).hexdigest() for x in (coded[-1], decoded[-1]))
        what = pa.string() if digests else pa.binary()
        names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
        return pa.table([pa.array(docs_, left.schema.field("doc_id").type), pa.array(counts, pa.int64()), pa.array(coded, what), pa.array(decoded, what)], names=["doc_id", "n_tokens", *names])

    shape = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"
    coded = encode_words(block_words(docs), ranks_path, pattern)
    return block_positions(docs).groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, f"doc_id {kind}, n_tokens long, {shape}")
