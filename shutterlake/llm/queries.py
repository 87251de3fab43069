"""The llm queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact, langid, merkle, ngram_join, packing, quality, substring, syncmers, toxicity, trie, urlrules, warc
from .shared import remove, settled, shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = _read(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.PATTERN)
    stored = settled(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(stored)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = toxicity.score_toxicity(docs, labels, from_files=True)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") else f"file://{folder}"
    try:
        files = warc.write_archives(_read(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{folder}/streams")
        read = warc.read_archives(warc.normalise(files, f"{folder}/records"))
        return settled(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:
        remove(spark, folder)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.label(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_groups(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return bpe.encode_decode(_read(spark, sf_dir, "documents"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN, digests=True, from_files=True)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "quality"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    without_breaks = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.document_manifest(_read(spark, sf_dir, "documents"), without_breaks)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_best_fit_packing, op3_toxicity, op4_warc, op5_language_id,
        op6_fingerprints, op7_substring_dedup, op8_exact_dedup, op9_url_rules, op10_byte_bpe,
        op11_quality, op12_conversation_trie, op13_merkle_manifest, pipeline,
    )
}
