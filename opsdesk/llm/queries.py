"""Registered queries of the training-data operators: one ``opN_<name>`` per operator, and the
pipeline.  Each applies its operator with production parameters to the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opsdesk.llm import contam, fmindex, jaccard, knn, langid, linealign, merkle, packing, patterns, \
    phrases, suffixblocks, tokens, toxicity
from opsdesk.llm.common import table
from opsdesk.llm.oracles import SQL  # noqa: F401  (read by the driver contract)


def tokenizer_file(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 50-word window that also starts in a smaller document."""
    return fmindex.remove_repeated_words(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by mixture inference, learned on four fifths of the rows."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole document."""
    return tokens.token_counts(table(spark, sf_dir, "documents"),
                               tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned on two thirds of the labelled rows."""
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document in blocks aligned with an earlier overlapping document."""
    return linealign.remove_repeated_lines(table(spark, sf_dir, "documents")).drop("text")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 50-byte string that also starts in a smaller document."""
    return suffixblocks.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op7_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows by integer inner product for every row whose vec_id is divisible by 20."""
    return knn.embedding_neighbours(table(spark, sf_dir, "embeddings"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a similarity of 0.8 on five-word shingles."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a 10-word window of a benchmark item."""
    return contam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and folded root of every document; every third one is tampered with."""
    return merkle.tamper_report(table(spark, sf_dir, "documents"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of two to four words of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens by fitted length patterns."""
    return patterns.pack_by_patterns(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_language_id, op3_token_counts, op4_toxicity, op5_line_dedup, op6_suffix_dedup,
    op7_knn_join, op8_jaccard_join, op9_contamination, op10_packing, op11_merkle_manifest,
    op12_phrase_mining, op13_pattern_packing)}
