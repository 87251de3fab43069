"""N-gram Jaccard self-join: a MinHash LSH forest with exact verification.

Each text is the set of its five-word shingles. A forest has ``trees`` tries; a
text's path in one is ``depth`` MinHash values, and a node of the trie is a
prefix that texts share. Paths are kept sorted, so a node is a run of rows.

Matching starts at full depth. The prefix is first shortened for all nodes until
a pair at the threshold shares one in some tree with the target probability
(``matched_depth``). From there each node is shortened further for as long as
its parent has few members (``SHORTER`` levels at most): that finds nearly all
that the target may miss, and costs little. Large nodes keep their depth, so
texts that share some boilerplate do not meet in one place.

Copies collapse first: texts with the same word sequence are one class, and
only one row of a class goes on. Then
  * nodes of one class are dropped, and of nodes with the same members in
    several trees one remains (their members' nodes agree);
  * a node's members are dealt into blocks of bounded size and bytes; blocks of
    a large node meet pair by pair, each meeting a group of its own, so no task
    holds a whole node;
  * inside a meeting, exact Jaccard similarities come from one sparse-to-dense
    product; a pair counts only in the first tree in which its nodes agree, so
    it counts once. Meetings return a row per class, not per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import arrays as A
from .components import connected
from .shared import partitions, scratch, settled, veiled

WORDS = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
TARGET_RECALL = 0.998
#: Levels that a node of few members may be shortened beyond the target's depth.
SHORTER = 2
BLOCK = 256
BLOCK_BYTES = 8_000_000
_COLUMNS = 4096


def matched_depth(trees: int, depth: int, threshold: float, target: float) -> int:
    """Shortens the matched prefix until a pair at ``threshold`` shares one in
    some tree with probability ``target``."""
    for length in range(depth, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= target:
            return length
    raise ValueError(f"{trees} trees cannot reach a recall of {target} at {threshold}")


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows end to end, the rows' offsets
    among them, the word hashes and the rows' offsets among those. A row of
    fewer than ``n`` words has one shingle, all its words; one of none has none."""
    starts, ends, first = A.words(data, offsets)
    hashed = A.word_hashes(data, starts, ends)
    rows, count = A.rows_of(first), np.diff(first)
    sums = np.zeros(len(hashed), A.U64)
    for k, factor in enumerate(A.odd_factors(n, 41)):
        sums[: len(hashed) - k] += hashed[k:] * factor
    left = first[1:][rows] - np.arange(len(hashed))  # words from here to the row's end
    whole = left >= n
    short = np.flatnonzero((count > 0) & (count < n))
    for r in short:
        a, b = first[r], first[r + 1]
        sums[a] = (hashed[a:b] * A.odd_factors(n, 43)[: b - a]).sum()
        whole[a] = True
    sums, rows = A.mix(sums[whole]), rows[whole]
    order = np.lexsort((sums, rows))
    sums, rows = sums[order], rows[order]
    if len(sums):
        new = np.append(True, (sums[1:] != sums[:-1]) | (rows[1:] != rows[:-1]))
        sums, rows = sums[new], rows[new]
    return sums, np.searchsorted(rows, np.arange(len(offsets))), hashed, first


def sequence_hashes(hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's word sequence."""
    place = A.ramp(np.diff(first))
    out = []
    for seed in (47, 53):
        factors = A.mix((place + 1).astype(A.U64) * A.U64(0x9E3779B97F4A7C15) + A.U64(seed)) | A.U64(1)
        sums = np.concatenate([[A.U64(0)], np.cumsum(hashed * factors, dtype=A.U64)])
        out.append(A.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(A.U64)))
    return out[0], out[1]


def signatures(sums: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """MinHash values (32 bits) of the rows that have shingles: rows x k. The
    shingle hashes are well mixed already, so linear functions of their halves do."""
    full = first[:-1] < first[1:]
    heads = first[:-1][full]
    out = np.zeros((len(heads), k), np.uint32)
    high = (sums >> A.U64(32)).astype(np.uint32)
    low = sums.astype(np.uint32)
    for j in range(k if len(heads) else 0):
        a, b = (int(x) for x in A.odd_factors(2, 1000 + j))
        out[:, j] = np.minimum.reduceat(low * np.uint32(a & 0xFFFFFFFF) + high * np.uint32((b & 0xFFFFFFFF) | 1), heads)
    return out


def sketches(docs: DataFrame, trees: int, length: int, shorter: int) -> DataFrame:
    """doc_id, s1, s2 (word sequence), size (shingles), labels (a hash per tree of
    the shortest prefix) and tails (the values behind it, up to ``length``, 16
    bits each, the first one highest); both empty without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def lists(values, at):
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values.reshape(-1)))

    def run(batches):
        for batch in batches:
            data, offsets = A.flat(batch.column("text"))
            for i, j in A.slices(offsets):
                sums, first, hashed, words = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                s1, s2 = sequence_hashes(hashed, words)
                sig = signatures(sums, first, trees * length).astype(A.U64).reshape(-1, trees, length)
                head, rest = sig[:, :, : length - shorter], sig[:, :, length - shorter :]
                labels = A.mix((head * A.odd_factors(trees * (length - shorter), 59).reshape(trees, -1)).sum(axis=2, dtype=A.U64))
                tails = np.zeros(labels.shape, A.U64)
                for k in range(shorter):
                    tails = (tails << A.U64(16)) | (A.mix(rest[:, :, k]) & A.U64(0xFFFF))
                full = first[:-1] < first[1:]
                at = np.concatenate([[0], np.cumsum(full * trees)]).astype(np.int32)
                ids = batch.column("doc_id").slice(i, j - i)
                yield pa.record_batch(
                    [ids, pa.array(A.signed(s1)), pa.array(A.signed(s2)), pa.array(np.diff(first)), lists(A.signed(labels), at), lists(A.signed(tails), at)],
                    ["doc_id", "s1", "s2", "size", "labels", "tails"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, s1 long, s2 long, size long, labels array<long>, tails array<long>")


def shingles(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and set: the row's shingle hashes, packed."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            data, offsets = A.flat(batch.column("text"))
            for i, j in A.slices(offsets):
                sums, first, _, _ = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = [batch.column(c).slice(i, j - i) for c in keep]
                yield pa.record_batch([*own, A.binary(sums.view(np.uint8), 8 * first)], [*keep, "set"])

    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, set binary")


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """All similarities among a few shingle sets."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(n), size)
    code, distinct = _dense(np.concatenate(sets) if n else np.zeros(0, A.U64))
    shared = np.bincount(code, minlength=distinct) > 1
    place = np.cumsum(shared) - 1
    member, code = member[shared[code]], place[code[shared[code]]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    member, code = member[order], code[order]
    for c in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(code, [c, c + _COLUMNS])
        block = np.zeros((n, min(_COLUMNS, int(shared.sum()) - c)), np.float32)
        block[member[a:b], code[a:b] - c] = 1
        both += block @ block.T
    both = np.rint(both)
    np.fill_diagonal(both, size)
    union = size[:, None] + size[None, :] - both
    return np.divide(both, union, out=np.zeros((n, n)), where=union > 0)


def _dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    import pandas as pd

    code, distinct = pd.factorize(values)
    return code, len(distinct)


def meet(members: pa.Table, threshold: float, cross: bool) -> pa.Table:
    """Links within one meeting: cls, links (pairs that count here), least (the
    smallest class that this meeting's links connect it with, itself included).
    ``cross``: only links between the two sides count."""
    members = members.combine_chunks()
    cls = members.column("cls").to_numpy()
    cls, one = np.unique(cls, return_index=True)
    side = members.column("side").to_numpy()
    tree = members.column("tree")[0].as_py()
    at = members.column("nodes").combine_chunks().take(pa.array(one))
    flat = at.flatten()
    of = np.repeat(np.arange(len(one)), np.array(pa.compute.list_value_length(at)))
    nodes = np.repeat(cls[:, None], tree + 1, axis=1)  # where a class has no node it agrees with no other class
    t, node = flat.field("tree").to_numpy(), flat.field("node").to_numpy()
    early = t <= tree
    nodes[of[early], t[early]] = node[early]
    packed = members.column("set").take(pa.array(one))
    like = jaccard([np.frombuffer(x.as_buffer(), np.uint64) for x in packed])
    near = like >= threshold - 1e-9
    np.fill_diagonal(near, False)
    near &= nodes[:, None, tree] == nodes[None, :, tree]
    for t in range(tree):  # an earlier tree counts that pair
        near &= nodes[:, None, t] != nodes[None, :, t]
    mine = side[one]
    if cross:
        near &= mine[:, None] != mine[None, :]
    links = near.sum(axis=1)
    hit = links > 0
    return pa.table({"cls": cls[hit], "links": links[hit].astype(np.int64), "least": cls[_least_connected(near)][hit]})


def _least_connected(near: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix the least row that a path connects it with."""
    least = np.arange(len(near))
    while len(near):
        after = np.minimum(least, np.where(near, least[None, :], len(near)).min(axis=1))
        after = after[after]
        if (after == least).all():
            break
        least = after
    return least


def matched_nodes(leaves: DataFrame, shorter: int, few: int, save) -> DataFrame:
    """``leaves`` (cls, size, tree, label, tail, and _n: the classes that share
    tree and label) to cls, size, tree, node: the node at which a class is
    matched in a tree, if other classes share it. That is the shortest prefix
    whose node has at most ``few`` classes, or else the longest. Classes that
    share the longest prefix of a tree always share a node."""
    at, by, found = leaves, ["tree", "label"], None
    for level in range(shorter + 1):
        if level:
            at = at.drop("_n").withColumn(f"t{level}", F.shiftrightunsigned("tail", 16 * (shorter - level)).bitwiseAND(0xFFFF))
            by = [*by, f"t{level}"]
            # stored, so that adaptive execution can split the paths of a large node
            at = at.join(save(at.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")), by)
        ends = at if level == shorter else at.where(F.col("_n") <= few)
        node = ends.select("cls", "size", "tree", F.xxhash64(F.lit(level), *by).alias("node"))
        found = node if found is None else found.unionByName(node)
        at = at.where(F.col("_n") > few)
    return found


def forest_links(classes: DataFrame, docs: DataFrame, threshold: float, shorter: int, block: int, save) -> tuple[DataFrame, DataFrame]:
    """(cls, n_links), and edges (cls, least) that connect the two ends of
    every link: a star for each connected part of a meeting."""
    paths = F.posexplode(F.arrays_zip("labels", "tails")).alias("tree", "path")
    leaves = classes.select("cls", "size", paths).select("cls", "size", "tree", F.col("path.labels").alias("label"), F.col("path.tails").alias("tail"))
    # paths of a node that holds one class in every level go first; what is left is small and kept in the order of the tries
    shared = save(leaves.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    leaves = save(leaves.join(shared, ["tree", "label"]).sortWithinPartitions("tree", "label", "tail"))
    matched = save(matched_nodes(leaves, shorter, block, save))
    member = F.xxhash64("cls")
    nodes = matched.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.bit_xor(member).alias("x"), F.sum(F.shiftright(member, 20)).alias("s"))
    first = nodes.groupBy("n", "x", "s").agg(F.min("tree").alias("tree"))  # same members, several trees
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("size") * 8 / BLOCK_BYTES)).cast("int")
    nodes = nodes.join(first, ["n", "x", "s", "tree"]).select("tree", "node", blocks.alias("blocks"))
    seats = matched.join(nodes, ["tree", "node"]).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int"))
    # a block meets itself (or, alone in its node, only itself) and every other one
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    seats = save(seats.withColumn("other", other).select("cls", "tree", "node", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.col("own").alias("side")))
    needed = matched.groupBy("cls").agg(F.collect_list(F.struct("tree", "node")).alias("nodes"))
    texts = docs.select(F.col("doc_id").alias("cls"), "text").join(needed.hint("shuffle_hash"), "cls").dropDuplicates(["cls"])
    sets = save(shingles(texts, ["cls", "nodes"]))

    def each(key, members):
        return meet(members, threshold, key[2].as_py() != key[3].as_py())

    kinds = "cls long, links long, least long"
    met = settled(seats.join(sets, "cls").groupBy("tree", "node", "a", "b").applyInArrow(each, kinds))
    counted = met.groupBy("cls").agg(F.sum("links").alias("n_links"))
    return counted, met.select("cls", "least").where("cls != least").distinct()


def _near(
    known: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL, block: int = BLOCK
) -> DataFrame:
    """doc_id, class_id, copy_of, n_copies, n_links of ``known`` (doc_id, text), whose
    doc_ids are whole numbers and have one text each."""
    length = matched_depth(trees, depth, threshold, target)
    shorter = max(0, min(SHORTER, length - 1))
    with scratch(known.sparkSession) as save:
        drawn = save(sketches(known, trees, length, shorter))
        copies = drawn.groupBy("s1", "s2").agg(F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("n_copies"))
        member = save(drawn.select("doc_id", "s1", "s2", F.col("size") == 0).toDF("doc_id", "s1", "s2", "bare").join(copies, ["s1", "s2"]).drop("s1", "s2"))
        heads = member.where("doc_id = cls").select("cls").distinct()
        classes = save(drawn.withColumnRenamed("doc_id", "cls").join(heads, "cls", "left_semi").dropDuplicates(["cls"]).where("size > 0").select("cls", "size", "labels", "tails"))
        counted, edges = forest_links(classes, known, threshold, shorter, block, save)
        groups = connected(edges.toDF("a", "b"))
        return settled(
            member.dropDuplicates(["doc_id"])
            .join(counted, "cls", "left")
            .join(groups.toDF("cls", "group"), "cls", "left")
            .select(
                "doc_id",
                F.when(F.col("bare"), F.col("doc_id")).otherwise(F.coalesce("group", "cls")).alias("class_id"),
                F.col("cls").alias("copy_of"),
                "n_copies",
                F.coalesce("n_links", F.lit(0)).alias("n_links"),
            )
        )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs`` with its columns besides text: class_id (smallest
    doc_id of the group that links connect), copy_of (smallest doc_id with the
    same word sequence), n_copies (rows with that sequence, itself included),
    n_links (other word sequences with a similarity of ``threshold`` or more).

    Words are runs of other characters than ``[\\x20\\x09-\\x0D]``, compared as
    they are. Texts of one to four words have one shingle. Null, empty and
    blank texts have none: they form one class of copies but get no links, and
    each keeps its own class_id. A row without doc_id is no one's partner: its
    class_id and copy_of are null. doc_id has to be a whole number; where rows
    share it but not their text, each text is judged by itself. Options are
    those of ``_near``: threshold, trees, depth, target, block. Pairs at the
    threshold are found with probability ``target`` at least, closer ones and
    those in small nodes more surely; what is found is verified exactly on
    64-bit shingle hashes. An empty table gives an empty result.
    """
    own = ["class_id", "copy_of", "n_copies", "n_links"]
    rest = [c for c in docs.columns if c not in [*own, "text"]]
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    if known.groupBy("doc_id").agg((F.min(text) != F.max(text)).alias("several")).where("several").isEmpty():
        found = _near(known, **options)
        shown, names, back = veiled(docs.select(*rest), rest)
        return shown.join(found, F.col(names[rest.index("doc_id")]) == F.col("doc_id"), "left").select(*back, *own)
    found = settled(_near(_by_row(known), **options).withColumnRenamed("doc_id", "_row"))
    # a class, of links or of copies, goes by its smallest doc_id
    ids = settled(found.join(_by_row(known).select(F.col("doc_id").alias("_row"), F.col("own").alias("_id")).distinct(), "_row"))
    linked = ids.groupBy("class_id").agg(F.min("_id").alias("_class"))
    copied = ids.groupBy("copy_of").agg(F.min("_id").alias("_copy"))
    named = ids.join(linked, "class_id").join(copied, "copy_of").select("_row", F.col("_class").alias("class_id"), F.col("_copy").alias("copy_of"), "n_copies", "n_links")
    shown, names, back = veiled(docs.select(*rest, "text"), rest)
    row = F.when(F.col(names[rest.index("doc_id")]).isNotNull(), F.xxhash64(F.col(names[rest.index("doc_id")]).cast("long"), F.coalesce("text", F.lit(""))))
    return shown.withColumn("_row", row).join(named, "_row", "left").select(*back, *own)


def _by_row(known: DataFrame) -> DataFrame:
    """``known`` with a number for each doc_id and text as doc_id, and its doc_id as own."""
    return known.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("doc_id"), F.col("doc_id").alias("own"), "text")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one text of each group, that of the smallest doc_id; all
    columns as they were. Rows are told apart by doc_id and text, so texts that
    share a doc_id are judged each by itself, and rows that repeat both stay or
    go together. Rows without doc_id stay."""
    row = F.xxhash64("doc_id", "text")
    known = docs.where(F.col("doc_id").isNotNull()).select(row.alias("doc_id"), F.col("doc_id").alias("own"), "text")
    near = _near(known.select("doc_id", "text"), **options).select(F.col("doc_id").alias("_row"), "class_id")
    found = settled(known.select(F.col("doc_id").alias("_row"), "own").distinct().join(near, "_row"))
    first = found.groupBy("class_id").agg(F.min(F.struct("own", "_row")).alias("x")).select("x._row")
    gone = found.join(first, "_row", "left_anti").select("_row")
    return docs.withColumn("_row", row).join(gone, "_row", "left_anti").select(*docs.columns)
