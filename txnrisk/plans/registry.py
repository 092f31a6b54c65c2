"""Decorator that collects queries and their oracle SQL, and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TRANSFERS = """transfers AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
         l.l_shipdate AS timestamp, c.c_nationkey AS from_bank, o.o_custkey AS source,
         s.s_nationkey AS to_bank, l.l_suppkey AS target, l.l_extendedprice AS amount,
         o.o_orderpriority AS payment_format,
         CASE WHEN l.l_returnflag = 'R' AND l.l_discount >= 0.09::DOUBLE THEN 1 ELSE 0 END AS is_fraud,
         l.l_quantity, l.l_discount, l.l_tax
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""

SCORES = """scored0 AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS timestamp,
         l_extendedprice AS amount,
         CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09::DOUBLE THEN 1 ELSE 0 END AS label,
         CAST(round(l_discount * 100) AS INT) * 50 + CAST(round(l_tax * 100) AS INT) * 25
           + CAST(l_quantity AS INT) AS score_int,
         CAST(l_quantity AS INT) / 50.0::DOUBLE AS score_b
  FROM lineitem),
scores AS (SELECT *, score_int / 750.0::DOUBLE AS score FROM scored0)"""

PATTERNS = """pattern_rows AS (
  SELECT *, CASE l_orderkey % 4 WHEN 0 THEN 'FAN-OUT' WHEN 1 THEN 'CYCLE'
                 WHEN 2 THEN 'GATHER-SCATTER' ELSE 'STACK' END AS pattern_type
  FROM transfers WHERE is_fraud = 1)"""

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, timestamp, amount"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def q(value: "Column | str", digits: int = 4) -> Column:
    """Round for comparison. Sums of doubles differ in the last bits with their order;
    the nudge moves exact ties (means over 8, 16, .. rows) off the rounding edge."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col + F.lit(1.3 * 10 ** -(digits + 3)), digits)


def sq(expr: str, digits: int = 4) -> str:
    """The same rounding as SQL text."""
    return f"round(CAST(({expr}) AS DOUBLE) + {1.3 * 10 ** -(digits + 3):.2e}, {digits})"


def with_transfers(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([TRANSFERS, *ctes]) + "\n" + body


def with_scores(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SCORES, *ctes]) + "\n" + body
