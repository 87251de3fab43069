"""Document fingerprints from closed syncmers.

A k-mer of bytes is an anchor if the least of its inner s-mers (by hash) stands
at its start or end, which the k-mer alone decides: the same passage has the
same anchors in any surroundings. A fingerprint keeps the ``KEPT`` anchors of
least hash with their places (or, if asked, all of them, whatever the length of
the text: then likeness is exact). Two fingerprints are alike as far as their
anchors agree and lie at a common shift.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import arrays as A
from .shared import partitions

K, S = 24, 8
KEPT = 48
DRIFT = 128
_LAST = np.uint64(2**64 - 1)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def closed_syncmers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and hash of every anchor. A row without a closed
    syncmer (always so below ``K`` bytes) has one anchor, its whole text; an
    empty one has none."""
    size = np.diff(offsets)

    def whole(rows):
        return np.array([int.from_bytes(hashlib.blake2b(data[offsets[r] : offsets[r + 1]].tobytes(), digest_size=8).digest(), "little") for r in rows], A.U64)

    n = len(data) - K + 1
    if n < 1:
        bare = np.flatnonzero(size > 0)
        return bare, np.zeros(len(bare), np.int64), whole(bare)
    inner = np.ndarray((len(data) - S + 1,), "<u8", np.ascontiguousarray(data).tobytes(), strides=(1,)).astype(A.U64)
    order = A.mix(inner)
    least, width = order, 1
    inside = K - S + 1
    while 2 * width <= inside:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < inside:
        least = np.minimum(least[:n], least[inside - width : inside - width + n])
    anchor = (order[:n] == least[:n]) | (order[inside - 1 : inside - 1 + n] == least[:n])
    at = np.flatnonzero(anchor)
    row = np.searchsorted(offsets, at, "right") - 1
    fits = at + K <= offsets[row + 1]
    at, row = at[fits], row[fits]
    f = A.odd_factors(3, 97)
    hashed = A.mix(inner[at] * f[0] + A.mix(inner[at + 8] * f[1] + A.mix(inner[at + 16] * f[2])))
    bare = np.flatnonzero((size > 0) & (np.bincount(row, minlength=len(size)) == 0))
    return np.concatenate([row, bare]), np.concatenate([at - offsets[row], np.zeros(len(bare), np.int64)]), np.concatenate([hashed, whole(bare)])


def sketches(data: np.ndarray, offsets: np.ndarray, kept: int | None = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``kept`` least anchors' hashes (all: None; 32 bits, ascending;
    filled up with the greatest 64-bit number) and places, each rows x kept."""
    row, place, hashed = closed_syncmers(data, offsets)
    hashed = hashed >> A.U64(32)
    order = np.lexsort((place, hashed, row))
    row, place, hashed = row[order], place[order], hashed[order]
    if len(row):
        new = np.append(True, (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1]))
        row, place, hashed = row[new], place[new], hashed[new]
    rank = A.ramp(np.bincount(row, minlength=len(offsets) - 1))
    width = kept or int(rank.max(initial=0)) + 1
    keep = rank < width
    values = np.full((len(offsets) - 1, width), _LAST)
    places = np.zeros((len(offsets) - 1, width), np.int64)
    values[row[keep], rank[keep]] = hashed[keep]
    places[row[keep], rank[keep]] = place[keep]
    return values, places


def as_text(values: np.ndarray, places: np.ndarray) -> pa.Array:
    """Fingerprint strings: 8 hex digits of hash and 8 of place per anchor (a
    text in Spark has less than 2**31 bytes)."""
    kept = values != _LAST
    packed = ((values[kept] << A.U64(32)) | places[kept].astype(A.U64))[:, None]
    digits = _HEX[((packed >> (A.U64(4) * np.arange(15, -1, -1, dtype=A.U64))) & A.U64(15)).astype(np.int64)]
    ends = np.concatenate([[0], np.cumsum(16 * kept.sum(axis=1))])
    return A.binary(digits.reshape(-1), ends).cast(pa.string())


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """One row's values and places from its fingerprint string."""
    parts = [int(fingerprint[k : k + 16], 16) for k in range(0, len(fingerprint), 16)]
    width = max(KEPT, len(parts))
    values, places = np.full((1, width), _LAST), np.zeros((1, width), np.int64)
    values[0, : len(parts)] = [p >> 32 for p in parts]
    places[0, : len(parts)] = [p & (2**32 - 1) for p in parts]
    return values, places


def likeness(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], kept: int | None = KEPT) -> np.ndarray:
    """Per row, of the ``kept`` least anchors (all: None) of both together the share that both have at
    a common shift (within ``DRIFT`` bytes); two empty fingerprints: 1."""
    values = np.concatenate([one[0], two[0]], axis=1)
    places = np.concatenate([one[1], two[1]], axis=1)
    order = np.argsort(values, axis=1, kind="stable")
    values, places = np.take_along_axis(values, order, 1), np.take_along_axis(places, order, 1)
    real = values != _LAST
    new = real.copy()
    new[:, 1:] &= values[:, 1:] != values[:, :-1]
    rank = np.cumsum(new, axis=1)
    size = np.minimum(rank[:, -1], kept or rank.shape[1])
    both = np.zeros_like(real)
    both[:, :-1] = real[:, :-1] & (values[:, 1:] == values[:, :-1]) & (rank[:, :-1] <= size[:, None])
    row, column = np.nonzero(both)
    shift = places[row, column + 1] - places[row, column]
    key = np.sort(row * np.int64(2**34) + shift + 2**32)
    together = np.searchsorted(key, key + DRIFT, "right") - np.arange(len(key))
    best = np.zeros(len(values))
    np.maximum.at(best, key // 2**34, together)
    return np.where(size > 0, best / np.maximum(size, 1), 1.0)


def _edited(data, offsets, rows: int):
    """For rows 0..rows-1: code points of each, and the bytes and offsets of the
    edited texts (the last half replaced by the next row's first code points)."""
    heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(heads, offsets)
    n = np.diff(first)
    half = n[:rows] // 2
    cut = heads[first[:rows] + n[:rows] - half]
    stop = heads[first[1 : rows + 1] + np.minimum(half, n[1 : rows + 1])]
    size = np.stack([cut - offsets[:rows], stop - offsets[1 : rows + 1]], axis=1).reshape(-1)
    start = np.stack([offsets[:rows], offsets[1 : rows + 1]], axis=1).reshape(-1)
    body = data[np.repeat(start, size) + A.ramp(size)] if size.sum() else data[:0]
    return n[:rows], body, np.concatenate([[0], np.cumsum(size)])[::2]


def _bounds_upto(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, by halving steps."""
    if not bounds:
        return F.lit(0)
    known = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def further(at, step):
        to = at + step
        return F.when((to <= len(bounds)) & (F.try_element_at(known, to) <= key), to).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def _with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt out by ranges of doc_id and sorted, each
    range followed by a copy of the row that comes after it (extra: true; after
    the last range, the first row). What reaches the driver is a bound and a
    head per range."""
    spark = docs.sparkSession
    parts = partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_key"))
    found = docs.agg(F.percentile_approx("_key", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    bounds = np.unique(np.array(found or [], np.int64))

    own = _bounds_upto(F.col("_key"), [int(b) for b in bounds])
    heads = sorted((r["_key"], r["b"]) for r in docs.select("_key", own.alias("b")).groupBy("b").agg(F.min("_key").alias("_key")).collect())
    if not heads:
        return docs.select(F.lit(0).alias("_bucket"), "_key", F.lit(False).alias("extra"), "doc_id", "text")
    before = spark.createDataFrame([(heads[k][0], heads[k - 1][1]) for k in range(len(heads))], "_key long, _bucket int")
    first = F.row_number().over(W.partitionBy("_key").orderBy(F.xxhash64("text")))
    extra = docs.join(F.broadcast(before), "_key").withColumn("_n", first).where("_n = 1")
    columns: list[Column | str] = ["_bucket", "_key", "extra", "doc_id", "text"]
    every = docs.withColumns({"_bucket": own, "extra": F.lit(False)}).select(*columns).unionByName(extra.withColumn("extra", F.lit(True)).select(*columns))
    return every.repartitionById(parts, F.col("_bucket")).sortWithinPartitions("_bucket", "extra", "_key", F.xxhash64("text"))


def fingerprints(docs: DataFrame, kept: int | None = KEPT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars (code points), fingerprint, and of
    its edited text (the last half of its code points replaced by as many first
    ones of the next row by doc_id, or all it has; the last row's next is the
    first) edited_sha256 and edited_fingerprint; near_edited and near_next: the
    likeness of its fingerprint to the edited text's and to the next row's.

    Null text counts as empty. A null doc_id comes first; rows of one doc_id
    are ordered by a hash of their texts. Other columns are ignored; an empty
    table gives an empty result.

    ``kept`` anchors of least hash make a fingerprint, whose likeness is an
    estimate from so many anchors for texts of any length; None keeps all
    anchors, about one for eight bytes of text, and gives the exact likeness.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def some(table: pa.RecordBatch):
        data, offsets = A.flat(table.column("text"))
        rows = table.num_rows - 1
        n, body, ends = _edited(data, offsets, rows)
        own, edited = sketches(data, offsets, kept), sketches(body, ends, kept)
        head, tail = tuple(x[:-1] for x in own), tuple(x[1:] for x in own)
        digest = [hashlib.sha256(body[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]
        out = pa.record_batch(
            [table.column("doc_id").slice(0, rows), pa.array(n), pa.array(digest, pa.string()), as_text(*head), as_text(*edited), pa.array(likeness(head, edited, kept)), pa.array(likeness(head, tail, kept))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
        return out.filter(pa.compute.invert(table.column("extra").slice(0, rows)))

    def run(batches):
        waiting = None
        for batch in batches:
            batch = batch.select(["doc_id", "text", "extra"])
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            offsets = A.flat(batch.column("text"))[1]
            last = batch.num_rows - 1
            for i, j in A.slices(offsets[: last + 1]):
                yield some(batch.slice(i, j - i + 1))
            waiting = batch.slice(last, 1)

    return _with_next(docs.select("doc_id", "text")).mapInArrow(run, schema)
