"""Registered queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.llm import (
    chosen_path, decontam, entropy_mix, fertility, html_suffix, longest_match, nbsvm, pii_chain, ring, speculative_bpe, trie_pairs, warc, whitening,
)
from txnrisk.llm.common import table


def op1_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. A null or empty page has an empty text; null ids and urls and repeated rows are pages like others."""
    return html_suffix.main_text(table(spark, sf_dir, "pages"))


def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, counts at most one apart. A null text has size 1; null ids and repeated rows are placed like others."""
    return ring.sharded(table(spark, sf_dir, "documents"))


def op3_bayes_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from rows that are not held out. Null and empty texts have a score too; repeated rows get equal ones."""
    return nbsvm.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back. A null page is empty; null ids revisit a known equal page; repeated rows of the largest id are all stored."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. Null and empty texts have no words and are clean; items without words or id have no windows; repeated rows count each."""
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document. Null and empty texts have none; null ids and repeated rows are rows like others."""
    return pii_chain.personal_data(table(spark, sf_dir, "documents"))


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document. Texts without words are linked with nothing; null and shared ids take part by their texts."""
    return chosen_path.near_components(table(spark, sf_dir, "documents"))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdict of every document. Null and empty texts have no words and fail the base rules; a null language is one of its own."""
    found = fertility.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("row.doc_id", *counts, "base_failed", "kept", *fertility.METRICS, "script")


def op9_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document. Null and empty texts have no tokens; null ids and repeated rows are counted like others."""
    return longest_match.token_counts(table(spark, sf_dir, "documents"))


def op10_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes. Null texts have size 0; a null source is the last one; repeated rows get equal copies."""
    found = entropy_mix.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op11_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their near words; null texts, ids and empty tables as in ``spelling_variants``."""
    return trie_pairs.spelling_variants(table(spark, sf_dir, "documents"))


def op12_cholesky_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on their first eight components; nulls, odd lengths and empty tables as in ``whitened``."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and decoded text; a null text has no tokens, as in ``encoded``."""
    return speculative_bpe.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_host_suffix_array, op2_bounded_ring, op3_bayes_support_vectors, op4_chunked_records, op5_prefix_filter,
        op6_skip_chain, op7_chosen_path, op8_fertility, op9_longest_match, op10_entropy_balance,
        op11_trie_pairs, op12_cholesky_jacobi, op13_speculative_bpe,
    )
}

ORACLES: dict[str, str] = {}
