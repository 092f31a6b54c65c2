"""Content hashes for integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the row's values with their names."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def table_hash(df: DataFrame) -> DataFrame:
    """Hash of a table that does not depend on the row order.

    The sum notices repeated rows, which cancel out in the xor; a decimal sum cannot overflow.
    """
    h = F.xxhash64(*df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(h).alias("xor_hash"),
        F.sum(h.cast("decimal(20,0)")).cast("string").alias("sum_hash"),
    )


def table_digest(df: DataFrame) -> DataFrame:
    """As ``table_hash``, from the first 60 bits of each row's MD5, which other engines have too.

    Values count as text after their length, nulls as ``-``, so no two rows share a text.
    """
    each = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in df.columns]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *each)), 1, 15), 16, 10).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(h).alias("xor_hash"),
        F.sum(h.cast("decimal(20,0)")).cast("string").alias("sum_hash"),
    )
