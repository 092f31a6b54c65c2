"""Section B: projections, filters, cleaning, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators import clean
from txnrisk.plans.registry import KEY, q, register, sq, with_scores, with_transfers
from txnrisk.sources.canonical import ROW_KEY, line_scores, table, transfers

# Rows with injected duplicates, nulls, NaN and infinities, derived from the keys.
DIRTY_SQL = """dirty0 AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS timestamp,
    CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 11 = 1 THEN 'infinity'::DOUBLE
         WHEN l_orderkey % 11 = 2 THEN '-infinity'::DOUBLE WHEN l_orderkey % 11 = 3 THEN -l_extendedprice
         ELSE l_extendedprice END AS amount,
    CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity END AS quantity
  FROM lineitem),
dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE l_linenumber = 2)"""


def dirty(spark, sf_dir):
    k = F.col("l_orderkey") % 11
    price = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("timestamp"),
        F.when(k == 0, None).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 3, -price).otherwise(price).alias("amount"),
        F.when(F.col("l_partkey") % 13 == 0, None).otherwise(F.col("l_quantity")).alias("quantity"),
    )
    return rows.unionByName(rows.filter(F.col("l_linenumber") == 2))


@register(
    "b1_clean_data",
    f"WITH {DIRTY_SQL}, u AS (SELECT DISTINCT * FROM dirty) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, timestamp, "
    "CASE WHEN amount IS NULL OR isinf(amount) THEN 0 ELSE amount END AS amount, coalesce(quantity, 0) AS quantity FROM u",
)
def b1(spark, sf_dir):
    return clean.clean_data(dirty(spark, sf_dir))


@register(
    "b2_clean_transaction_data",
    f"WITH {DIRTY_SQL} SELECT DISTINCT * FROM dirty WHERE amount IS NOT NULL AND NOT isinf(amount) AND amount > 0",
)
def b2(spark, sf_dir):
    text = dirty(spark, sf_dir).withColumn("amount", F.coalesce(F.col("amount").cast("string"), F.lit("n/a")))
    return clean.clean_transaction_data(text)


@register("b3_validate_compliance", f"WITH {DIRTY_SQL} SELECT * FROM dirty WHERE amount > 0 AND quantity IS NOT NULL")
def b3(spark, sf_dir):
    return clean.validate_compliance(dirty(spark, sf_dir), ["timestamp", "amount", "quantity"])


@register("b4_clean_transactions", f"WITH {DIRTY_SQL} SELECT DISTINCT * FROM dirty WHERE amount > 0")
def b4(spark, sf_dir):
    return clean.clean_transactions(dirty(spark, sf_dir))


@register(
    "b5_quality_report",
    with_transfers(
        f"SELECT count(*) AS total_transactions, {sq('avg(is_fraud)', 8)} AS fraud_rate, min(timestamp) AS start, "
        'max(timestamp) AS "end", count(*) - count(amount) AS null_amount, count(*) - count(source) AS null_source FROM transfers'
    ),
)
def b5(spark, sf_dir):
    rows = transfers(spark, sf_dir).select("timestamp", "amount", "source", "is_fraud")
    report = clean.quality_report(rows).withColumn("fraud_rate", q("fraud_rate", 8))
    return report.drop("null_timestamp", "null_is_fraud")


@register(
    "b6_validate_frame",
    f"""WITH {DIRTY_SQL}, t AS (SELECT count(*) AS n, count(*) - count(amount) AS a, count(*) - count(quantity) AS k FROM dirty)
SELECT 'error' AS level, 'missing_column' AS finding, 'currency' AS "column", CAST(NULL AS DOUBLE) AS value FROM t
UNION ALL SELECT 'warning', 'null_percentage', NULL, {sq('(a + k) / (n * 7.0) * 100', 8)} FROM t""",
)
def b6(spark, sf_dir):
    report = clean.validate_frame(dirty(spark, sf_dir), ["amount", "currency"], min_rows=100)
    return report.withColumn("value", q("value", 8))


@register(
    "b7_validate_target",
    with_transfers(
        f"""SELECT 0::BIGINT AS null_count, count(*) AS n_classes, {sq('min(n)::DOUBLE / max(n)', 8)} AS minority_ratio,
count(*) >= 2 AS is_valid, min(n)::DOUBLE / max(n) < 0.01 AS is_imbalanced
FROM (SELECT is_fraud, count(*) AS n FROM transfers GROUP BY 1)"""
    ),
)
def b7(spark, sf_dir):
    return clean.validate_class_target(transfers(spark, sf_dir), "is_fraud").withColumn("minority_ratio", q("minority_ratio", 8))


@register(
    "b7_validate_numeric_target",
    f"SELECT 0::BIGINT AS null_count, {sq('var_samp(l_extendedprice)', 2)} AS variance, var_samp(l_extendedprice) <> 0 AS is_valid FROM lineitem",
)
def b7_numeric(spark, sf_dir):
    report = clean.validate_numeric_target(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return report.withColumn("variance", q("variance", 2))


@register(
    "b8_numeric_features",
    with_transfers(
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(epoch(timestamp) AS BIGINT) AS timestamp, from_bank, source, "
        "to_bank, target, amount, is_fraud, l_quantity, l_discount, l_tax FROM transfers"
    ),
)
def b8(spark, sf_dir):
    return clean.numeric_features(transfers(spark, sf_dir))


@register(
    "b9_impute_median",
    f"""WITH {DIRTY_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, timestamp,
 {sq('coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM dirty))')} AS amount,
 {sq('coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM dirty))')} AS quantity FROM dirty""",
)
def b9(spark, sf_dir):
    out = clean.impute_median(dirty(spark, sf_dir), ["amount", "quantity"])
    return out.withColumns({"amount": q("amount"), "quantity": q("quantity")})


@register(
    "b10_replace_infinite",
    f"""WITH {DIRTY_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, timestamp,
 CASE WHEN amount IS NULL THEN 0 WHEN amount = 'infinity'::DOUBLE THEN 1e10 WHEN amount = '-infinity'::DOUBLE THEN -1e10
      ELSE amount END AS amount, coalesce(quantity, 0) AS quantity FROM dirty""",
)
def b10(spark, sf_dir):
    return clean.replace_infinite(dirty(spark, sf_dir), ["amount", "quantity"])


@register(
    "b11_coerce_features",
    f"""WITH {DIRTY_SQL}, f AS (SELECT * REPLACE (CASE WHEN isinf(amount) THEN NULL ELSE amount END AS amount) FROM dirty)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, timestamp,
 {sq('CAST(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM f)) AS FLOAT)', 1)} AS amount,
 {sq('CAST(coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM f)) AS FLOAT)', 1)} AS quantity FROM f""",
)
def b11(spark, sf_dir):
    text = dirty(spark, sf_dir).withColumn("quantity", F.coalesce(F.col("quantity").cast("string"), F.lit("?")))
    out = clean.coerce_features(text, ["amount", "quantity"])
    return out.withColumns({c: q(F.col(c).cast("double"), 1) for c in ("amount", "quantity")})


@register(
    "b12_clamp_features",
    f"""WITH {DIRTY_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, timestamp,
 greatest(-10.0::DOUBLE, least(10.0::DOUBLE, coalesce(amount, 0))) AS amount,
 greatest(-10.0::DOUBLE, least(10.0::DOUBLE, coalesce(quantity, 0))) AS quantity FROM dirty""",
)
def b12(spark, sf_dir):
    return clean.clamp_features(dirty(spark, sf_dir), ["amount", "quantity"])


@register(
    "b13_align_columns",
    with_transfers("SELECT amount, 0.0::DOUBLE AS account_age, from_bank, to_bank, 0.0::DOUBLE AS risk FROM transfers"),
)
def b13(spark, sf_dir):
    return clean.align_columns(transfers(spark, sf_dir), ["amount", "account_age", "from_bank", "to_bank", "risk"])


_DECIDED = """decided AS (SELECT *, CAST(score >= 0.5 AS INT) AS prediction FROM scores)"""


@register("b14_threshold_decision", with_scores(f"SELECT {KEY}, prediction FROM decided", _DECIDED))
def b14(spark, sf_dir):
    return clean.decide(line_scores(spark, sf_dir)).select(*ROW_KEY, "prediction")


@register(
    "b15_risk_level",
    with_scores(
        f"SELECT {KEY}, CASE WHEN score < 0.3 THEN 'LOW' WHEN score < 0.6 THEN 'MEDIUM' WHEN score < 0.85 THEN 'HIGH' "
        "ELSE 'CRITICAL' END AS risk_level FROM scores"
    ),
)
def b15(spark, sf_dir):
    return clean.decide(line_scores(spark, sf_dir)).select(*ROW_KEY, "risk_level")


@register(
    "b16_confidence_status",
    with_scores(
        f"SELECT {KEY}, prediction, CASE WHEN prediction = 1 THEN 'SUSPEITA' ELSE 'APROVADA' END AS status, "
        f"{sq('CASE WHEN prediction = 1 THEN score ELSE 1 - score END', 8)} AS confidence FROM decided",
        _DECIDED,
    ),
)
def b16(spark, sf_dir):
    out = clean.decide(line_scores(spark, sf_dir))
    return out.select(*ROW_KEY, "prediction", "status", q("confidence", 8).alias("confidence"))


@register(
    "b17_suspicious_summary",
    with_scores(
        f"SELECT count(*) AS total, count(*) FILTER (prediction = 1) AS suspicious, {sq('avg(prediction) * 100', 6)} AS suspicious_pct FROM decided",
        _DECIDED,
    ),
)
def b17(spark, sf_dir):
    out = clean.suspicious_summary(clean.decide(line_scores(spark, sf_dir)))
    return out.withColumn("suspicious_pct", q("suspicious_pct", 6))


def _profile_sql(column, expr):
    return f"""SELECT '{column}' AS "column", count(*) AS n, {sq(f'avg(CAST({expr} IS NULL AS INT)) * 100', 6)} AS null_pct,
 {sq(f'avg(CAST(coalesce({expr} = 0, false) AS INT)) * 100', 6)} AS zero_pct, count(*) FILTER ({expr} <> 0) AS non_zero,
 {sq(f'avg({expr})')} AS mean, {sq(f'stddev_samp({expr})')} AS std, {sq(f'min({expr})')} AS min, {sq(f'max({expr})')} AS max FROM prof"""


_PROF = "prof AS (SELECT l_quantity, l_tax, l_discount, CASE WHEN l_orderkey % 5 < 3 THEN 0 ELSE l_quantity END AS sparse, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity END AS gappy FROM lineitem)"
_PROF_COLS = ["l_quantity", "l_tax", "l_discount", "sparse", "gappy"]


def _prof(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_tax", "l_discount",
        F.when(F.col("l_orderkey") % 5 < 3, 0.0).otherwise(F.col("l_quantity")).alias("sparse"),
        F.when(F.col("l_partkey") % 13 == 0, None).otherwise(F.col("l_quantity")).alias("gappy"),
    )


@register("b18_sparsity_profile", f"WITH {_PROF} " + " UNION ALL ".join(_profile_sql(c, c) for c in _PROF_COLS))
def b18(spark, sf_dir):
    out = clean.sparsity_profile(_prof(spark, sf_dir), _PROF_COLS)
    rounded = {c: q(c, 6) for c in ("null_pct", "zero_pct")} | {c: q(c) for c in ("mean", "std", "min", "max")}
    return out.withColumns(rounded)


@register(
    "b18_sparsity_summary",
    f"""WITH {_PROF}, p AS ({" UNION ALL ".join(_profile_sql(c, c) for c in _PROF_COLS)})
SELECT max(null_pct) AS max_null_pct, count(*) FILTER (zero_pct > 50) AS mostly_zero_columns FROM p""",
)
def b18_summary(spark, sf_dir):
    out = clean.sparsity_summary(clean.sparsity_profile(_prof(spark, sf_dir), _PROF_COLS))
    return out.withColumn("max_null_pct", q("max_null_pct", 6))
