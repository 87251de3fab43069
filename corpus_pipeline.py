"""The corpus pipeline: language ID, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; its
result is written as Parquet and read again as the next stage's ``docs``. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from shutterlake.llm import exact, langid, ngram_join, packing, substring
from shutterlake.llm.shared import remove, settled, shared_dir

#: Language ID rejects texts without a letter, and texts of which no language
#: has half of the pooled probability. At sf0.1 these are 10 of 10,000: very short
#: texts, bare licence lines, and shouted or numeric junk, whose language is told
#: wrongly in 6 of 10 cases (of the 9,990 others in 20 in all).
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told. Null and empty texts and
    those without a letter go; repeated rows and ids are judged each by their
    text; an empty table stays empty."""
    network = langid.fit(docs.select("doc_id", "text", "lang"))
    told = langid.label(docs, network)
    return told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that n-gram similarity connects, that of
    the smallest doc_id. Texts without words and rows without doc_id stay."""
    return ngram_join.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that repeat; texts that lose nothing stay as they are."""
    whole = docs.withColumn("_whole", F.col("text"))
    cut = substring.remove_repeats(whole)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("_whole"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1024. Null and empty texts
    give a piece of one token; repeated rows are packed each by themselves."""
    import public_tokenizers as public

    pieces = packing.token_pieces(docs, public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.PATTERN)
    stored = settled(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(stored)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the trained stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read
    again; what they wrote is removed when the last one is done."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return settled(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        remove(spark, folder)
