"""Best-fit-decreasing packing of token pieces into sequences of fixed capacity.

A piece's length decides where it may go, so the packing runs over the table
of how many pieces have each length, which has at most ``capacity`` rows at any
input size. A segment tree over remaining capacities finds the tightest open
bin; equal pieces that meet equal bins are placed in one step, which gives
just what placing them one after the other gives. Spark then numbers the pieces
of each length and looks their places up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from . import arrays as A
from .shared import partitions

CAPACITY = 1024
END = 2
#: A plan of more placements is not sent to all tasks.
BROADCAST_ROWS = 200_000


class OpenBins:
    """Segment tree: which remaining capacities have an open bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.leaves, bool)

    def mark(self, remaining: int, has: bool) -> None:
        node = remaining + self.leaves
        self.any[node] = has
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity of at least ``size`` with an open bin."""
        node = size + self.leaves
        while not self.any[node]:
            while node & 1:  # a right child: go up until there is a right neighbour
                node //= 2
            if node <= 1:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


@dataclass
class Plan:
    """Pieces of ``length`` numbered first..last go, ``each`` to a bin, to the
    bins from ``bin`` on, behind ``offset``."""

    capacity: int
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan, tree = Plan(capacity), OpenBins(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}

    def put(remaining: int, start: int, n: int) -> None:
        if n and remaining:
            open_bins.setdefault(remaining, []).append((start, n))
            tree.mark(remaining, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        left, number = counts[length], 0
        while left:
            space = tree.tightest(length)
            if space is None:
                space, start, have = capacity, plan.bins, -(-left // (capacity // length))
                plan.bins += have
            else:
                start, have = open_bins[space].pop()
                if not open_bins[space]:
                    tree.mark(space, False)
            each = space // length
            whole = min(have, left // each)
            for n_bins, per in ((whole, each), (1, left - whole * each if whole < have else 0)):
                per = min(per, each)
                if n_bins and per > 0:
                    plan.rows.append((length, number, number + n_bins * per - 1, per, start, capacity - space))
                    put(space - per * length, start, n_bins)
                    start, have = start + n_bins, have - n_bins
                    number, left = number + n_bins * per, left - n_bins * per
            put(space, start, have)
    return plan


def token_pieces(docs: DataFrame, ranks_path: str, tokenizer_path: str, pattern: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Token ids of whole texts, cut only where a text exceeds ``capacity``.

    Per piece: doc_id, piece (from 0), start, length, ids (binary, little-endian
    unsigned 32-bit). A text's ids are followed by ``end``. The first piece of a
    long text takes what is over after full pieces. Null text counts as empty
    and gives the piece [end]; rows are treated alike whether or not their
    doc_id repeats or is null. Only doc_id and text are read.
    ``ranks_path`` holds the vocabulary of ``tokenizer_path`` as merge ranks;
    texts that contain a special token's string go through the tokenizer.
    """

    def run(batches):
        from tokenizers import Tokenizer

        from .pretokens import Encoder

        encoder, tokenizer = Encoder(ranks_path, pattern), Tokenizer.from_file(tokenizer_path)
        special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        for batch in batches:
            data, offsets = A.flat(batch.column("text"))
            for i, j in A.slices(offsets):
                part = data[offsets[i] : offsets[j]]
                ids, at = encoder.encode(part, offsets[i : j + 1] - offsets[i])
                body = part.tobytes()
                if any(s in body for s in special):
                    rows = [ids[a:b] for a, b in zip(at, at[1:])]
                    for k, text in enumerate(A.texts(batch.column("text").slice(i, j - i)).to_pylist()):
                        if any(s in text.encode() for s in special):
                            rows[k] = np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                    ids = np.concatenate([np.zeros(0, np.uint32), *rows])
                total = np.diff(at) + 1
                n = -(-total // capacity)
                doc = np.repeat(np.arange(j - i), n)
                piece = A.ramp(n)
                over = (total - (n - 1) * capacity)[doc]
                start = np.where(piece == 0, 0, over + (piece - 1) * capacity)
                length = np.where(piece == 0, over, capacity)
                ended = np.insert(ids, at[1:], np.uint32(end)).astype("<u4")
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(i, j - i).take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        A.binary(ended.view(np.uint8), 4 * np.concatenate([[0], np.cumsum(length)])),
                    ],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: which sequence holds a piece, and
    where. ``pieces`` (doc_id, piece, length and more) is read twice, so it
    should be a stored table.

    Sequences are filled from offset 0 without gaps. Pieces of one length are
    numbered in parts by a hash, so a length that most pieces share is spread
    over all tasks. Pieces that tie may take each other's place. An empty table
    gives an empty result.
    """
    spark = pieces.sparkSession
    clash = ["sequence_id", "offset"]
    pieces = pieces.drop(*clash)
    parts = max(8, partitions(spark))
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).alias("_part")
    counts = pieces.groupBy("length", part).agg(F.count(F.lit(1)).alias("_n"))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    plan = best_fit_decreasing(lengths, capacity)
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_base"))
    order = W.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("_part", part).withColumn("_row", F.row_number().over(order) - 1)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("_length", "_first", "_last", "_each", "_bin", "_offset")])
    places = spark.createDataFrame(plan.rows, schema)
    if len(plan.rows) <= BROADCAST_ROWS:  # else the pieces go to the placements of their length
        places = F.broadcast(places)
    rank = F.col("_base") + F.col("_row")
    seat = rank - F.col("_first")
    return (
        ranked.join(bases, ["length", "_part"])
        .join(places, (F.col("length") == F.col("_length")) & rank.between(F.col("_first"), F.col("_last")))
        .withColumns({"sequence_id": F.col("_bin") + F.floor(seat / F.col("_each")), "offset": F.col("_offset") + (seat % F.col("_each")) * F.col("length")})
        .select(*pieces.columns, *clash)
    )
