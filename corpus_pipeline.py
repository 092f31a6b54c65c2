"""Documents to training shards: quality rules, near-duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. ``run`` writes each stage's rows as Parquet and reads them again.

Every stage takes an empty table, null texts, ids and sources, repeated rows and texts of any length;
each docstring says what becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.llm import chosen_path, decontam, entropy_mix, fertility, ring
from txnrisk.llm.common import small, stored, table

#: Words of a shingle in the near-duplicate stage, and percent of shared shingles of a link.
WIDTH, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's fertility bands. Null, empty and short texts
    fail the base rules; repeated rows get equal verdicts."""
    return fertility.judged(docs).where("kept").select("row.*")


def _node() -> Column:
    """The document's id; without one, a number above all ids that equal texts share."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group; of repeated rows one. A document without
    an id stays if no document with one is like it."""
    nodes = docs.select(_node().alias("node"), "text")
    found = chosen_path.near_components(nodes, id_col="node", width=WIDTH, percent=PERCENT)
    nodes = stored(found.groupBy("node").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("times")), "nodes")
    # dropped documents are the fewer ones: if they are few enough they are broadcast, and no text moves
    dropped = small(nodes.where("not kept").select(F.col("node").alias("dropped")))
    left = docs.join(dropped, _node() == F.col("dropped"), "left_anti")
    if nodes.where("kept and times > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", "text"])
    return left


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; texts without words are clean."""
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: empty texts and sources may be left out, a null source is one."""
    found = entropy_mix.mixed(docs).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document of the mix; copies and documents without an id have slots of their own."""
    return ring.sharded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: The fertility bands, the components and the tilts can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole documents table. An empty table gives an empty result with the last stage's columns."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
