"""The prefix trie of conversations, with totals by leaf-peeling messages.

A node is a distinct sequence of first turns. A prefix is named by folding its
turns' hashes with their places (128 bits, by exclusive or), so that names come
from running folds and no sequence is compared whole. Nodes are then known by
their smallest member and depth: nodes with one smallest member lie below each
other and form a run.

Totals go up by messages. A run waits with a counter of the runs that hang from
it; when the counter is 0 it sends its total to the node it hangs from, whose run
counts it off, until only the root's run is left. Runs make the rounds as few as
the branchings on one path, not as many as the turns of the longest
conversation. Inside a run the totals are a running fold from its lower end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .ranks import CHUNK, ranked, running
from .shared import partitions, scratch, settled

#: A conversation starts with fewer turns than this of its family's first one.
HEADS = 9
FAMILY = 5
#: Ids that a piece of a digest's input has.
PIECE = 4096
_NODE = ["depth", "k1", "k2"]
_XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
_SUM = (F.sum, lambda a, b: a + b)


def borrowed(conv_id: Column) -> Column:
    """How many turns ``conv_id`` takes from the first of its family."""
    return F.crc32(conv_id.cast("string")) % HEADS


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, tok (SHA-256 of role and text), bytes of the text. Null
    roles and texts are empty; rows without conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    tok = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", tok.alias("tok"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(rows: DataFrame, save, heads: Column | None = None, family: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations over ``turns``: conv_id, depth
    (place from 1), tok, bytes, ends (its last one); and conv_id, total.

    A conversation takes ``heads`` turns from conversation ``family`` (all if
    that has fewer, none if there is none) and then its own behind as many.
    Turns go by number, null first, ties by hash.
    """
    conv = F.col("conv_id")
    heads = borrowed(conv) if heads is None else heads
    family = conv - conv % FAMILY if family is None else family
    placed = save(ranked(save(rows), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("tok").asc()], save))
    convs = placed.where("_rank = 1").select("conv_id", "_size", heads.alias("h"), family.alias("of"))
    sizes = convs.select(F.col("conv_id").alias("of"), F.col("_size").alias("_there"))
    got = F.least("h", F.coalesce("_there", F.lit(0)))
    plan = save(convs.join(sizes, "of", "left").select("conv_id", "of", "h", got.alias("got"), "_size", (got + F.greatest(F.col("_size") - F.col("h"), F.lit(0))).alias("total")))

    # a conversation's plan goes to each chunk of its turns, so that a very long one is not one key
    chunk = F.floor(F.col("_rank") / CHUNK).alias("_chunk")
    dealt = plan.select("conv_id", "h", "got", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_size") / CHUNK))).alias("_chunk"))
    own = placed.select("conv_id", "_rank", "tok", "bytes", chunk).join(dealt, ["conv_id", "_chunk"]).where("_rank > h")
    own = own.select("conv_id", (F.col("_rank") - F.col("h") + F.col("got")).alias("depth"), "tok", "bytes", "total")
    first = placed.where(F.col("_rank") < HEADS).select(F.col("conv_id").alias("of"), "_rank", "tok", "bytes")
    taken = plan.where("got > 0").join(first, "of").where("_rank <= got").select("conv_id", F.col("_rank").alias("depth"), "tok", "bytes", "total")
    return own.unionByName(taken).withColumn("ends", F.col("depth") == F.col("total")).drop("total"), plan.select("conv_id", "total")


def members(placed: DataFrame) -> DataFrame:
    """``placed`` with the name of the node it reaches (k1, k2) and of that
    node's parent (p1, p2)."""
    parts = {"k1": F.xxhash64("tok", "depth"), "k2": F.xxhash64("depth", F.lit("second"), "tok")}
    named = running(placed.withColumns({f"x_{k}": v for k, v in parts.items()}), "conv_id", "depth", {k: (F.col(f"x_{k}"), *_XOR) for k in parts})
    return named.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("x_k1")), "p2": F.col("k2").bitwiseXOR(F.col("x_k2"))}).drop("x_k1", "x_k2", "tok")


def end_digests(ends: DataFrame) -> DataFrame:
    """``_NODE`` columns and ends_sha256 over ``ends`` (``_NODE``, conv_id; files): the hash of the ids
    that end at each node, ascending, joined by commas.

    Ids are sorted by ranges of node and id, so that those of one node may take
    many tasks; each joins its ids to pieces of ``PIECE``. A hash is a sequential
    thing: one task reads a node's pieces, one row for thousands of ids, as a
    stream and keeps nothing but the hash's state.
    """
    parts = partitions(ends.sparkSession)
    kinds = "depth long, k1 long, k2 long"

    def pieces(batches):
        for batch in batches:
            node = [batch.column(c).to_numpy() for c in _NODE]
            ids = batch.column("conv_id").to_numpy()
            new = np.zeros(len(ids), bool)
            for c in node:
                new[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), len(ids)]
            spans = [(a, min(a + PIECE, j)) for i, j in zip(edges, edges[1:]) for a in range(i, j, PIECE)]
            cuts, text = [a for a, _ in spans], [",".join(map(str, ids[a:b].tolist())) for a, b in spans]
            yield pa.record_batch([*(pa.array(c[cuts]) for c in node), pa.array(ids[cuts]), pa.array(text, pa.string())], [*_NODE, "first", "ids"])

    def digests(batches):
        node, state, done = None, None, []

        def flushed():
            out = pa.record_batch([*(pa.array([d[0][k] for d in done], pa.int64()) for k in range(3)), pa.array([d[1] for d in done], pa.string())], [*_NODE, "ends_sha256"])
            done.clear()
            return out

        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*_NODE, "ids"])):
                if key != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(done) > 4096:
                yield flushed()
        if node is not None:
            done.append((node, state.hexdigest()))
        yield flushed()

    run = [*_NODE, "conv_id"]
    joined = ends.select(*run).repartitionByRange(parts, *run).sortWithinPartitions(*run).mapInArrow(pieces, f"{kinds}, first long, ids string")
    return joined.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digests, f"{kinds}, ends_sha256 string")


def peeled(runs: DataFrame, save) -> DataFrame:
    """The messages over ``runs`` (conv_id, parent, at, waits, leaves, saved):
    each run's conv_id, parent, at, and leaves and saved with all that hangs
    from it. Only the question whether runs still wait reaches the driver."""
    waiting, sent = save(runs), None
    while True:
        done, rest = waiting.where("waits = 0"), waiting.where("waits > 0")
        sent = done if sent is None else sent.unionByName(done)
        if rest.isEmpty():
            return sent
        heard = done.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        more = lambda c: F.coalesce(c, F.lit(0))
        waiting = save(
            rest.join(heard, "conv_id", "left").select(
                "conv_id", "parent", "at", (F.col("waits") - more("_n")).alias("waits"), (F.col("leaves") + more("_leaves")).alias("leaves"), (F.col("saved") + more("_saved")).alias("saved")
            )
        )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over the rebuilt ``conversations`` (conv_id, turn,
    role, text): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Members of a node are the conversations that start with its sequence, those
    without turns too (of the root). Null roles and texts count as empty; null
    turns come first; turns of one number go by the SHA-256 of role and text,
    and repeated rows are turns each. Rows without conv_id are in no
    conversation. Other columns are ignored; an empty table has no nodes.
    """
    spark = conversations.sparkSession
    with scratch(spark) as save:
        placed, convs = rebuilt(turns(conversations), save)
        reached = save(members(save(placed)))
        convs = save(convs)
        root = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
        zero = F.lit(0).cast("long")
        top = spark.createDataFrame([(0, 0, 0, root[0], root[1], 0)] if root[1] else [], "depth long, k1 long, k2 long, conv_id long, n_convs long, bytes long")
        below = reached.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
        nodes = save(below.unionByName(top, allowMissingColumns=True))

        # who hangs from whom; a parent with very many children is a skewed join, which Spark splits
        parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
        first = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(root[0]).cast("long"))
        lower = nodes.where("depth > 1").join(parents.where("depth > 1"), ["depth", "p1", "p2"])
        tree = first.unionByName(lower).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
        tree = save(tree.drop("p1", "p2"))
        kids = tree.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
        own = tree.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
        own = save(own.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}))

        above = F.when(F.col("parent_conv_id") != F.col("conv_id"), F.col("parent_conv_id"))
        runs = own.groupBy("conv_id").agg(
            F.max(above).alias("parent"), (F.min("depth") - 1).alias("at"), (F.sum("n_children") - F.count(F.lit(1)) + 1).alias("waits"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        hung = peeled(runs, save).where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        held = own.join(hung, ["conv_id", "depth"], "left")
        held = save(held.withColumns({"leaves": F.col("leaves") + F.coalesce("_leaves", zero), "saved": F.col("saved") + F.coalesce("_saved", zero)}).drop("_leaves", "_saved"))
        totals = running(held, "conv_id", "depth", {"n_leaves": (F.col("leaves"), *_SUM), "saved_tokens": (F.col("saved"), *_SUM)}, backwards=True)

        bare = convs.where("total = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")
        digests = end_digests(save(reached.where("ends").select(*_NODE, "conv_id").unionByName(bare)))
        out = totals.join(digests, _NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
        return settled(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
