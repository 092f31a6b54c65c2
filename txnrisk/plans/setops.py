"""Section G: set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators import setops
from txnrisk.plans.cleaning import DIRTY_SQL, dirty
from txnrisk.plans.registry import register, with_transfers
from txnrisk.sources.canonical import pattern_rows, table, transfers, user_events


@register("g1_distinct_ids", with_transfers("SELECT source AS id FROM transfers UNION SELECT target FROM transfers"))
def g1(spark, sf_dir):
    return setops.distinct_ids(transfers(spark, sf_dir), ["source", "target"])


@register(
    "g2_concat_rows",
    with_transfers("SELECT source, target, amount, NULL AS pattern_type FROM transfers WHERE is_fraud = 0 UNION ALL SELECT source, target, amount, CASE l_orderkey % 4 WHEN 0 THEN 'FAN-OUT' WHEN 1 THEN 'CYCLE' WHEN 2 THEN 'GATHER-SCATTER' ELSE 'STACK' END FROM transfers WHERE is_fraud = 1"),
)
def g2(spark, sf_dir):
    normal = transfers(spark, sf_dir).filter(F.col("is_fraud") == 0).select("source", "target", "amount")
    return setops.concat_rows([normal, pattern_rows(spark, sf_dir).select("source", "target", "amount", "pattern_type")])


@register("g3_shared_keys", with_transfers("SELECT DISTINCT source AS id FROM transfers INTERSECT SELECT target FROM transfers"))
def g3(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    return setops.shared_keys(rows.select(F.col("source").alias("id")), rows.select(F.col("target").alias("id")))


@register("g3_shared_hours", "SELECT CAST(hour(ts) AS INT) AS hour FROM events WHERE event_type = 'click' INTERSECT SELECT CAST(hour(ts) AS INT) FROM events WHERE event_type <> 'click'")
def g3_hours(spark, sf_dir):
    rows = user_events(spark, sf_dir)
    click = F.col("event_type") == "click"
    hour = F.hour("ts").alias("hour")
    return setops.shared_keys(rows.filter(click).select(hour), rows.filter(~click).select(hour))


@register("g4_missing_keys", with_transfers("SELECT c_custkey AS id FROM customer EXCEPT SELECT source FROM transfers WHERE is_fraud = 1"))
def g4(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return setops.missing_keys(known, transfers(spark, sf_dir).filter(F.col("is_fraud") == 1).select("source"))


@register(
    "g5_duplicate_report",
    f"WITH {DIRTY_SQL} SELECT (SELECT count(*) FROM dirty) AS rows, count(*) AS distinct_rows, (SELECT count(*) FROM dirty) - count(*) AS duplicates_removed FROM (SELECT DISTINCT * FROM dirty)",
)
def g5(spark, sf_dir):
    return setops.duplicate_report(dirty(spark, sf_dir))
