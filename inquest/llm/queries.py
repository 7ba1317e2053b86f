"""Queries over the shared tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inquest.llm import byte_bpe, chunking, embeddings, jaccard, mixing, passages, pii, quality, ranking, spelling, style_tree, url_rules, warc
from inquest.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated to equal shares of the sources and shuffled globally."""
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that any two documents share."""
    return passages.repeated(table(spark, sf_dir, "documents"))


def op3_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return chunking.compare_edited(table(spark, sf_dir, "documents"))


def op4_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return style_tree.main_texts(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and round-trip digests of every document."""
    return byte_bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict about the URL of every page."""
    return url_rules.verdicts(table(spark, sf_dir, "pages"))


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every item of the benchmark."""
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with their near words and forms."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_passages": op2_passages,
        "op3_chunking": op3_chunking,
        "op4_style_tree": op4_style_tree,
        "op5_pii": op5_pii,
        "op6_warc": op6_warc,
        "op7_jaccard": op7_jaccard,
        "op8_embeddings": op8_embeddings,
        "op9_quality": op9_quality,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_urls": op11_urls,
        "op12_ranking": op12_ranking,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op6_warc": warc.SQL, "op11_urls": url_rules.SQL, "op12_ranking": ranking.SQL}
