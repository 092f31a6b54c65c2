"""Laundering pattern files: blocks of BEGIN line, transactions, END line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.operators.ordering import WINDOW_ROWS, attach, running_sum
from txnrisk.session import settle

BEGIN, END = "BEGIN LAUNDERING ATTEMPT", "END LAUNDERING ATTEMPT"
# Header texts looked for, in this order.
KNOWN_TYPES = ["FAN-OUT", "CYCLE", "GATHER-SCATTER", "STACK"]
# All typologies the generator of such files names.
FULL_TYPES = ["FAN-OUT", "FAN-IN", "CYCLE", "GATHER-SCATTER", "SCATTER-GATHER", "STACK", "BIPARTITE", "RANDOM"]
# The fields of a transaction line, by position.
FIELDS = ["timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount", "amount_currency",
          "received_amount", "received_currency", "payment_format", "is_fraud"]


def _header_type(header: Column, types: list[str]) -> Column:
    out = F.when(header.contains(types[0]), types[0])
    for name in types[1:]:
        out = out.when(header.contains(name), name)
    return out.otherwise("UNKNOWN")


def pattern_lines(spark: SparkSession, path: str, limit: int = WINDOW_ROWS) -> DataFrame:
    """(file, block, closed, header, line) for each line between BEGIN and END.

    Lines are numbered in file order and the block is the running count of BEGIN lines,
    so a block of any size is spread over tasks; it is never read as one record.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.rtrim("value").alias("line"),
    )
    # the id depends on how the scan was split: fix it before it is used twice
    lines = settle(lines)
    starts = F.col("line").startswith(BEGIN).cast("int")
    ends = F.col("line").startswith(END).cast("int")
    numbered = running_sum(lines, ["file"], ["_start", "_id"], {"block": starts}, limit)
    marked = running_sum(numbered, ["file", "block"], ["_start", "_id"], {"_ended": ends}, limit)
    headers = marked.groupBy("file", "block").agg(
        F.max(F.when(starts == 1, F.col("line"))).alias("header"), F.max(ends).alias("closed")
    )
    inside = (F.col("block") > 0) & (F.col("_ended") == 0) & (starts == 0) & (F.length("line") > 0)
    body = attach(marked.filter(inside), headers, ["file", "block"])
    return body.select("file", "block", "closed", "_start", "_id", "header", "line")


def _transactions(lines: DataFrame) -> DataFrame:
    parts = F.split("line", ",")
    text = {name: F.get(parts, i) for i, name in enumerate(FIELDS)}
    typed = dict(text)
    typed["timestamp"] = F.coalesce(
        F.try_to_timestamp(text["timestamp"], F.lit("yyyy/MM/dd HH:mm")),
        F.try_to_timestamp(text["timestamp"], F.lit("yyyy-MM-dd HH:mm:ss")),
    ).cast("timestamp_ntz")
    typed["amount"] = F.trim(text["amount"]).try_cast("double")
    typed["received_amount"] = F.trim(text["received_amount"]).try_cast("double")
    typed["is_fraud"] = F.trim(text["is_fraud"]).try_cast("int")
    whole = (
        (F.size(parts) >= len(FIELDS))
        & typed["amount"].isNotNull()
        & typed["received_amount"].isNotNull()
        & typed["is_fraud"].isNotNull()
    )
    return lines.filter(whole).withColumns(typed)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Transactions with the pattern type found in the block header.

    ``pattern_type`` knows four types as listed; ``pattern_type_full`` tells the others
    apart too. Lines with too few fields or without numbers are dropped.
    """
    rows = _transactions(pattern_lines(spark, path))
    # a header such as SCATTER-GATHER contains no other full name except by prefix order
    return rows.select(
        "file",
        "block",
        *FIELDS,
        _header_type(F.col("header"), KNOWN_TYPES).alias("pattern_type"),
        _header_type(F.col("header"), FULL_TYPES).alias("pattern_type_full"),
    )


def read_pattern_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Transactions with the header split into ``type`` and ``characteristics``.

    The type ends at the first non-word character, so FAN-OUT gives FAN. Blocks without
    an END line are left out. The rows stay
    flat, with block and line order, instead of one nested list per block.
    """
    pattern = BEGIN + r" - (\w+):?\s*(.*)"
    rows = _transactions(pattern_lines(spark, path)).filter(F.col("header").rlike(pattern) & (F.col("closed") == 1))
    return rows.select(
        "file",
        "block",
        F.struct("_start", "_id").alias("line_order"),
        F.regexp_extract("header", pattern, 1).alias("type"),
        F.regexp_extract("header", pattern, 2).alias("characteristics"),
        *FIELDS,
    )


def write_pattern_file(df: DataFrame, path: str, block: list[str], order: list[str], header: Column, line: Column) -> None:
    """Write rows as blocks. A block stays in one part file; blocks spread over files."""
    own = F.struct(F.lit(1).alias("_part"), line.alias("value"))
    rows = df.select(*block, *order, F.inline(F.array(own)))
    heads = df.groupBy(*block).agg(F.first(header).alias("value"), *[F.min(c).alias(c) for c in order])
    tails = heads.withColumn("value", F.regexp_replace("value", "^BEGIN", "END")).withColumn("_part", F.lit(2))
    heads = heads.withColumn("_part", F.lit(0))
    everything = rows.unionByName(heads).unionByName(tails)
    everything.repartitionByRange(*block).sortWithinPartitions(*block, "_part", *order).select("value").write.text(path)
