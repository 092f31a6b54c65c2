"""The first question end to end: recent outgoing activity and payment-format risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.operators.clean import clean_transactions
from txnrisk.operators.ordering import sized
from txnrisk.operators.windows import rolling_days
from txnrisk.plans.registry import q
from txnrisk.sources.canonical import ROW_KEY, transfers

FLAGSHIP_SQL = """, clean AS (SELECT DISTINCT * FROM transfers WHERE amount IS NOT NULL AND timestamp IS NOT NULL AND amount > 0),
r AS (SELECT *,
  sum(amount) OVER w7 AS s7, count(amount) OVER w7 AS n7,
  sum(amount) OVER w30 AS s30, count(amount) OVER w30 AS n30
  FROM clean
  WINDOW w7 AS (PARTITION BY source ORDER BY epoch_us(timestamp) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY source ORDER BY epoch_us(timestamp) RANGE BETWEEN 2591999999999 PRECEDING AND CURRENT ROW)),
f AS (SELECT payment_format, avg(is_fraud) AS rate FROM clean GROUP BY 1)
"""


def account_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_transactions(transfers(spark, sf_dir))
    recent = rolling_days(rows, "source")
    risk = sized(rows.groupBy("payment_format").agg(F.avg("is_fraud").alias("format_fraud_rate")))
    return recent.join(risk, "payment_format").select(
        *ROW_KEY,
        "source",
        "payment_format",
        q("source_amount_sum_7d").alias("source_amount_sum_7d"),
        q("source_amount_mean_7d").alias("source_amount_mean_7d"),
        F.col("source_amount_count_7d").alias("source_transaction_count_7d"),
        q("source_amount_sum_30d").alias("source_amount_sum_30d"),
        q("source_amount_mean_30d").alias("source_amount_mean_30d"),
        F.col("source_amount_count_30d").alias("source_transaction_count_30d"),
        q("format_fraud_rate", 6).alias("format_fraud_rate"),
    )
