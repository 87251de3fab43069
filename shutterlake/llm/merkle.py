"""Merkle manifest of a dataset: a tree of hashes per group, and one over these.

Levels are built by windows: partitioned by group and parent index, an ordered
``collect_list`` over the full frame is the parent's preimage and holds every
node's siblings at once; one row of each run goes on as the parent. Proofs then
come down from the root: a node's are its own siblings before its parent's, so
every level joins its parents once and all levels together are half as large
again as the leaves. Nothing is gathered beyond a run of ``FAN`` nodes; the
driver sees the size of the largest group and the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ranks import ranked
from .shared import scratch, settled

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts end to end."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(*(field(v) for v in values))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (siblings left and right of the node, level by level) come to."""
    return F.aggregate(proof, start, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def _grown(nodes: DataFrame, save, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all groups over ``nodes`` (_group, _at from 0, _n nodes in the
    group, _h, and more columns), and (_group, _root). Level k has the nodes
    that have siblings or would have: _group, _at, _n, _h, _left, _right, _up
    (the parent's hash); the lowest has the further columns as well. Groups of
    one node have no level."""
    most = nodes.agg(F.max("_n")).first()[0] or 0
    run = W.partitionBy("_group", F.floor(F.col("_at") / fan)).orderBy("_at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    roots = nodes.where("_n = 1").select("_group", F.col("_h").alias("_root"))
    levels: list[DataFrame] = []
    while most > 1:
        place = (F.col("_at") % fan).cast("int")
        runs = nodes.where("_n > 1").withColumn("_run", F.collect_list("_h").over(run))
        level = save(
            runs.withColumns(
                {
                    "_left": F.array_join(F.slice("_run", F.lit(1), place), ""),
                    "_right": F.array_join(F.slice("_run", place + 2, F.lit(fan)), ""),
                    "_up": digest(F.array_join("_run", "")),
                }
            ).drop("_run")
        )
        levels.append(level)
        up = level.where(F.col("_at") % fan == 0).select("_group", F.floor(F.col("_at") / fan).alias("_at"), F.ceil(F.col("_n") / fan).alias("_n"), F.col("_up").alias("_h"))
        roots = roots.unionByName(up.where("_n = 1").select("_group", F.col("_h").alias("_root")))
        nodes, most = up, -(-most // fan)
    return levels, roots


def _proven(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, save, fan: int) -> DataFrame:
    """``nodes`` with ``_proof``, and what ``tops`` (_group, _proof of the
    group's root, more columns) says of the group."""
    more = [c for c in tops.columns if c not in ("_group", "_proof")]
    last = tops.withColumnsRenamed({"_proof": "_above", "_group": "_g"})
    own = [c for c in nodes.columns]
    above = None
    for k in reversed(range(len(levels))):
        rows = levels[k].withColumn("_parent", F.floor(F.col("_at") / fan))
        here = rows.where(F.col("_n") <= fan).join(last, F.col("_group") == F.col("_g"))
        if above is not None:
            inner = rows.where(F.col("_n") > fan).join(above, (F.col("_group") == F.col("_g")) & (F.col("_parent") == F.col("_a")))
            here = here.unionByName(inner, allowMissingColumns=True)
        proof = F.concat(F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right"))), "_above")
        if k:
            above = save(here.select(F.col("_group").alias("_g"), F.col("_at").alias("_a"), proof.alias("_above"), *more))
        else:
            here = here.select(*own, proof.alias("_proof"), *more)
    alone = nodes.where("_n = 1").join(last, F.col("_group") == F.col("_g")).select(*own, F.col("_above").alias("_proof"), *more)
    return alone.unionByName(here) if levels else alone


def manifest(rows: DataFrame, group: Column, order: Column, leaf_hash: Column, keep: dict[str, Column], save, fan: int = FAN) -> DataFrame:
    """Per row of ``rows``: the ``keep`` columns, leaf, subroot (of its group),
    root, and proof (siblings from the leaf up to the root, left and right of
    the node on each level).

    In a group, leaves ascend by ``order`` (null first), equal ones by their
    hash; ``fan`` neighbours (the last run: fewer, even one) are hashed into a
    parent until one is left. Groups follow each other bytewise, null first,
    and their subroots are hashed alike. Rows that repeat are leaves of their
    own. An empty table gives no rows.
    """
    named = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))  # null first, and no key is null
    leaves = save(rows.select(*(c.alias(n) for n, c in keep.items()), named.alias("_group"), order.alias("_order"), leaf_hash.alias("_h")))
    placed = ranked(leaves, ["_group"], [F.col("_order").asc_nulls_first(), F.col("_h").asc()], save)
    nodes = save(placed.withColumn("_at", F.col("_rank") - 1).withColumnRenamed("_size", "_n").drop("_rank", "_order"))
    levels, subroots = _grown(nodes, save, fan)

    tops = save(subroots.select(F.lit("").alias("_all"), F.col("_group").alias("_name"), F.col("_root").alias("_h")))
    tops = ranked(tops, ["_all"], [F.col("_name").asc()], save)
    tops = save(tops.select(F.col("_all").alias("_group"), (F.col("_rank") - 1).alias("_at"), F.col("_size").alias("_n"), "_h", "_name"))
    upper, root = _grown(tops, save, fan)
    base = root.select("_group", F.array().cast(_PROOF).alias("_proof"), "_root")
    known = save(_proven(tops, upper, base, save, fan).select(F.col("_name").alias("_group"), "_proof", "_root", F.col("_h").alias("_subroot")))

    out = _proven(nodes, levels, known, save, fan)
    return out.select(*keep, F.col("_h").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_proof").alias("proof"))


def document_manifest(docs: DataFrame, tampered_text: Column | None = None, fan: int = FAN) -> DataFrame:
    """``manifest`` of documents by source, proven against ``tampered_text``
    (default: the text as it is): doc_id, leaf, subroot, root, proof_sha256,
    folded_root (what the leaf with the tampered text and the original siblings
    come to) and verified (folded_root equals root).

    Nulls in any column are a value of their own; a null source is the first
    group, a null doc_id comes first in its group; rows that share a doc_id
    follow each other by their leaves. Other columns are ignored; an empty
    table gives an empty result.
    """
    shown = F.col("text") if tampered_text is None else tampered_text
    values = [F.col(c) for c in FIELDS]
    keep = {"doc_id": F.col("doc_id"), "_shown": leaf(*values[:-1], shown)}
    with scratch(docs.sparkSession) as save:
        rows = manifest(docs.select(*FIELDS), F.col("source"), F.col("doc_id"), leaf(*values), keep, save, fan)
        out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("_shown"), F.col("proof")).alias("folded_root"))
        return settled(out.withColumn("verified", F.col("folded_root") == F.col("root")))
