"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Stages take (spark, docs, sf_dir).  All but the last return the columns of documents; each decides
on everything its predecessor kept:

1. language_id: documents without a language (no letters, or no language that holds at least
   ``LEAST_SHARE`` of the words) go; a missing lang is filled in with the prediction.
2. line_dedup: lines aligned with an earlier overlapping document go; documents of which nothing
   but blanks is left (copies) go.
3. jaccard_join: one document of each class of near duplicates stays.
4. decontamination: spans of benchmark items go; documents that are mostly benchmark go.
5. packing: the rest is packed into sequences of 2048 tokens.

There is no SQL for it (mixture inference, patience diff, tokenizer); tests compare run() with a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdesk.llm import contam, jaccard, langid, linealign, packing
from opsdesk.llm.common import carry, prepare, restore, shared_folder, table
from opsdesk.llm.queries import tokenizer_file

LEAST_SHARE = 0.35
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    found = langid.predict(carry(docs), model, ["text", "row"])
    kept = found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SHARE))
    return restore(kept, docs, lang=F.coalesce(F.col("row.lang"), F.col("lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linealign.remove_repeated_lines(carry(docs), ["doc_id", "text", "row"])
    return _resized(restore(found.where("n_removed = 0 or trim(text) <> ''"), docs), docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _resized(contam.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


def _resized(kept: DataFrame, docs: DataFrame) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return kept.withColumn("n_chars", F.length("text").cast(kind))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
          ("decontamination", decontamination), ("packing", sequence_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the shared folder."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
