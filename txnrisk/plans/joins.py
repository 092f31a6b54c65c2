"""Section C: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators import joins, splits
from txnrisk.operators.graph import dictionary
from txnrisk.operators.windows import group_size
from txnrisk.plans.registry import KEY, q, register, sq, with_scores, with_transfers
from txnrisk.sources.canonical import ROW_KEY, line_scores, table, transfers

_ENTITIES = "ids AS (SELECT source AS entity FROM transfers UNION SELECT target FROM transfers)"


def _accounts(spark, sf_dir):
    """Two account rows per customer key with different names, to need the first one."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return c.withColumn("seq", F.lit(1.0)).unionByName(c.select("c_custkey", F.lit("other").alias("c_name"), "c_acctbal").withColumn("seq", F.lit(2.0)))


@register(
    "c1_master_entities",
    with_transfers("SELECT entity, c_name, c_acctbal, CASE WHEN c_name IS NOT NULL THEN 1.0::DOUBLE END AS seq FROM ids LEFT JOIN customer ON entity = c_custkey", _ENTITIES),
)
def c1(spark, sf_dir):
    return joins.master_entities(transfers(spark, sf_dir), _accounts(spark, sf_dir), "c_custkey", ["seq"])


@register(
    "c2_label_rollup",
    with_transfers(
        """SELECT entity, coalesce(m.y, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END, 0) AS entity_label
FROM ids LEFT JOIN (SELECT source, max(is_fraud) AS y FROM transfers GROUP BY 1) m ON entity = m.source
LEFT JOIN customer ON entity = c_custkey""",
        _ENTITIES,
    ),
)
def c2(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    entities = joins.master_entities(rows, _accounts(spark, sf_dir), "c_custkey", ["seq"])
    entities = entities.withColumn("own", F.when(F.col("c_acctbal").isNotNull(), (F.col("c_acctbal") < 0).cast("int")))
    return joins.label_rollup(entities, rows, "entity", "source", "is_fraud", "own").select("entity", "entity_label")


@register(
    "c3_lookup_count",
    with_transfers("SELECT c_custkey, coalesce(n, 0) AS n_sent FROM customer LEFT JOIN (SELECT source, count(*) AS n FROM transfers GROUP BY 1) t ON c_custkey = source"),
)
def c3(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return joins.lookup_count(c, transfers(spark, sf_dir), "c_custkey", "source", "n_sent")


@register("c4_pair_count", with_transfers(f"SELECT {KEY}, count(*) OVER (PARTITION BY source, target) AS pair_frequency FROM transfers"))
def c4(spark, sf_dir):
    return group_size(transfers(spark, sf_dir), ["source", "target"], "pair_frequency").select(*ROW_KEY, "pair_frequency")


@register(
    "c5_encode_endpoints",
    with_transfers(
        f"""SELECT {KEY}, a.code AS from_code, b.code AS to_code FROM transfers
JOIN codes a ON source = a.value JOIN codes b ON target = b.value""",
        "codes AS (SELECT c_custkey AS value, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS code FROM customer WHERE c_custkey % 10 <> 0)",
    ),
)
def c5(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 10 != 0)
    codes = dictionary(known, "c_custkey", ["c_acctbal", "c_custkey"])
    return joins.encode_endpoints(transfers(spark, sf_dir), codes).select(*ROW_KEY, "from_code", "to_code")


@register(
    "c6_key_overlap",
    with_transfers(
        f"""SELECT count(*) AS n_keys, count(b.k) AS n_shared, {sq('count(b.k)::DOUBLE / count(*)', 8)} AS overlap_rate
FROM (SELECT DISTINCT source AS k FROM transfers) a LEFT JOIN (SELECT DISTINCT target AS k FROM transfers) b ON a.k = b.k"""
    ),
)
def c6(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    return joins.key_overlap(rows, rows, "source", "target").withColumn("overlap_rate", q("overlap_rate", 8))


@register(
    "c7_frequency_lookup",
    with_transfers(
        f"""SELECT {KEY}, {sq("coalesce(freq, (SELECT avg(freq) FROM f))", 8)} AS format_freq FROM transfers LEFT JOIN f ON payment_format = value""",
        """f AS (SELECT payment_format AS value, count(*)::DOUBLE / sum(count(*)) OVER () AS freq FROM transfers
  WHERE payment_format <> '1-URGENT' AND timestamp < TIMESTAMP '1996-01-01' GROUP BY 1)""",
    ),
)
def c7(spark, sf_dir):
    from txnrisk.operators.encoding import frequency_map

    rows = transfers(spark, sf_dir)
    seen = rows.filter((F.col("payment_format") != "1-URGENT") & (F.col("timestamp") < F.lit("1996-01-01").cast("timestamp_ntz")))
    out = joins.map_frequency(rows, frequency_map(seen, "payment_format"), "payment_format", "format_freq")
    return out.select(*ROW_KEY, q("format_freq", 8).alias("format_freq"))


@register("c8_align_rows", with_scores(f"SELECT {KEY}, label, score, score_b FROM scores"))
def c8(spark, sf_dir):
    rows = line_scores(spark, sf_dir)
    return joins.align_rows(rows.select(*ROW_KEY, "label", "score"), rows.select(*ROW_KEY, "score_b"), ROW_KEY)


@register(
    "c9_threshold_counts",
    with_scores(
        """SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label = 0) AS tn
FROM scores, (SELECT unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]::DOUBLE[]) AS threshold) GROUP BY 1"""
    ),
)
def c9(spark, sf_dir):
    return joins.thresholds_met(line_scores(spark, sf_dir), "score", "label", [i / 10 for i in range(1, 10)])


DAY_PAIR_SQL = """day AS (SELECT CAST(floor((epoch(l_shipdate) - (SELECT min(epoch(l_shipdate)) FROM lineitem)) / 86400) AS BIGINT) AS d, count(*) AS n FROM lineitem GROUP BY 1),
alld AS (SELECT unnest(range((SELECT max(d) FROM day) + 1)) AS d),
cum AS (SELECT alld.d, coalesce(sum(coalesce(n, 0)) OVER (ORDER BY alld.d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM alld LEFT JOIN day ON day.d = alld.d),
tot AS (SELECT sum(n) AS n FROM day),
pairs AS (SELECT i.d AS i, j.d AS j, greatest(abs(i.before / tot.n::DOUBLE - 0.6::DOUBLE) / 0.6::DOUBLE, abs((j.before - i.before) / tot.n::DOUBLE - 0.2::DOUBLE) / 0.2::DOUBLE, abs((tot.n - j.before) / tot.n::DOUBLE - 0.2::DOUBLE) / 0.2::DOUBLE) AS err
 FROM cum i JOIN cum j ON i.d < j.d, tot)"""


@register("c10_day_pair_search", f"WITH {DAY_PAIR_SQL} SELECT i AS val_start_day, j AS test_start_day, {sq('err', 8)} AS error FROM pairs ORDER BY err, i, j LIMIT 1")
def c10(spark, sf_dir):
    cuts = splits.best_day_cuts(table(spark, sf_dir, "lineitem"), "l_shipdate")
    return cuts.withColumn("error", q("error", 8))
