"""Section H: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.functions import dates, hashing, labels, numeric
from txnrisk.operators.graph import account_key
from txnrisk.plans.registry import KEY, q, register, sq, with_transfers
from txnrisk.sources.canonical import ROW_KEY, table, transfers, user_events


@register(
    "h1_date_parts",
    "SELECT event_id, "
    + ", ".join(
        f"CAST({f} AS INT) AS {n}"
        for n, f in (
            ("year", "year(ts)"), ("month", "month(ts)"), ("day", "day(ts)"), ("dayofyear", "dayofyear(ts)"), ("weekday", "isodow(ts) - 1"),
            ("hour", "hour(ts)"), ("minute", "minute(ts)"), ("quarter", "quarter(ts)"), ("weekofyear", "week(ts)"),
        )
    )
    + " FROM events",
)
def h1(spark, sf_dir):
    return user_events(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in dates.date_parts(F.col("ts")).items()])


@register(
    "h2_date_flags",
    with_transfers(
        f"SELECT {KEY}, isodow(timestamp) >= 6 AS is_weekend, day(timestamp) = 1 AS is_month_start, CAST(timestamp AS DATE) = last_day(timestamp) AS is_month_end FROM transfers"
    ),
)
def h2(spark, sf_dir):
    return transfers(spark, sf_dir).select(*ROW_KEY, *[c.alias(n) for n, c in dates.date_flags(F.col("timestamp")).items()])


@register(
    "h3_season",
    with_transfers(
        f"SELECT {KEY}, CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'winter' WHEN month(timestamp) <= 5 THEN 'spring' WHEN month(timestamp) <= 8 THEN 'summer' ELSE 'fall' END AS season FROM transfers"
    ),
)
def h3(spark, sf_dir):
    return transfers(spark, sf_dir).select(*ROW_KEY, dates.season(F.col("timestamp")).alias("season"))


_CYCLE_SQL = (("month", "month(ts)", "12"), ("dayofyear", "dayofyear(ts)", "365.25"), ("weekday", "(isodow(ts) - 1)", "7"), ("hour", "hour(ts)", "24"))


@register(
    "h4_cyclical",
    "SELECT event_id, " + ", ".join(f"{sq(f'{f}(2 * pi() * {e} / {p}::DOUBLE)', 8)} AS {n}_{f}" for n, e, p in _CYCLE_SQL for f in ("sin", "cos")) + " FROM events",
)
def h4(spark, sf_dir):
    return user_events(spark, sf_dir).select("event_id", *[q(c, 8).alias(n) for n, c in dates.cyclical(F.col("ts")).items()])


@register("h5_business_hours", "SELECT event_id, CAST(hour(ts) BETWEEN 9 AND 17 AS INT) AS is_business_hours, CAST(isodow(ts) >= 6 AS INT) AS is_weekend FROM events")
def h5(spark, sf_dir):
    ts = F.col("ts")
    return user_events(spark, sf_dir).select(
        "event_id", dates.business_hours(ts).alias("is_business_hours"), dates.date_flags(ts)["is_weekend"].cast("int").alias("is_weekend")
    )


@register(
    "h6_risk_periods",
    "SELECT event_id, CAST(hour(ts) >= 22 OR hour(ts) <= 4 AS INT) AS is_late_night, CAST(isodow(ts) - 1 IN (2, 3) AS INT) AS is_high_risk_day, CAST(month(ts) IN (11, 12) AS INT) AS is_peak_month FROM events",
)
def h6(spark, sf_dir):
    return user_events(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in dates.risk_period_flags(F.col("ts")).items()])


@register(
    "h7_gaussian_similarity",
    with_transfers(
        f"SELECT {KEY}, {sq('(amount - m) / s', 6)} AS z, {sq('exp(-0.5 * ((amount - m) / s) ** 2)', 6)} AS similarity FROM transfers, (SELECT avg(amount) AS m, stddev_samp(amount) AS s FROM transfers WHERE is_fraud = 1)"
    ),
)
def h7(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    stats = rows.filter(F.col("is_fraud") == 1).agg(F.avg("amount").alias("m"), F.stddev_samp("amount").alias("s"))
    z = (F.col("amount") - stats.select("m").scalar()) / stats.select("s").scalar()
    out = rows.select(*ROW_KEY, z.alias("z"))
    return out.select(*ROW_KEY, q("z", 6).alias("z"), q(numeric.gaussian_similarity(F.col("z")), 6).alias("similarity"))


@register(
    "h8_row_max_mean",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, greatest(g, l_discount, l_tax) AS row_max, {sq('list_avg([g, l_discount, l_tax])', 8)} AS row_mean FROM (SELECT *, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity END AS g FROM lineitem)",
)
def h8(spark, sf_dir):
    gap = F.when(F.col("l_partkey") % 13 == 0, None).otherwise(F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").withColumn("g", gap)
    cols = [F.col(c) for c in ("g", "l_discount", "l_tax")]
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", numeric.row_max(cols).alias("row_max"), q(numeric.row_mean(cols), 8).alias("row_mean")
    )


@register(
    "h9_safe_ratios",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, {sq('CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount ELSE 0 END', 2)} AS safe, {sq('l_tax / (l_discount + 1)', 8)} AS plus_one, {sq('l_tax / (l_discount + 1e-6)', 2)} AS guarded FROM lineitem",
)
def h9(spark, sf_dir):
    price, d, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        q(numeric.safe_divide(price, d), 2).alias("safe"),
        q(numeric.guarded_ratio(tax, d, 1.0), 8).alias("plus_one"),
        q(numeric.guarded_ratio(tax, d, 1e-6), 2).alias("guarded"),
    )


@register("h10_same_bank", with_transfers(f"SELECT {KEY}, CAST(from_bank = to_bank AS INT) AS same_bank, CAST(source = target AS INT) AS same_entity FROM transfers"))
def h10(spark, sf_dir):
    return transfers(spark, sf_dir).select(
        *ROW_KEY,
        labels.same_value(F.col("from_bank"), F.col("to_bank")).alias("same_bank"),
        labels.same_value(F.col("source"), F.col("target")).alias("same_entity"),
    )


@register(
    "h12_row_hash",
    "SELECT o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS row_hash FROM orders",
)
def h12(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.row_hash(["o_orderkey", "o_custkey", "o_orderstatus"]).alias("row_hash"))


@register("h12_table_hash")
def h12_table(spark, sf_dir):
    return hashing.table_hash(table(spark, sf_dir, "lineitem"))


_DIGEST = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@register(
    "h12_table_digest",
    "SELECT count(*) AS rows, bit_xor(h) AS xor_hash, CAST(sum(h::HUGEINT) AS VARCHAR) AS sum_hash FROM (SELECT ('0x' || substr(md5("
    + " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in _DIGEST)
    + "), 1, 15))::BIGINT AS h FROM orders)",
)
def h12_digest(spark, sf_dir):
    return hashing.table_digest(table(spark, sf_dir, "orders").select(*_DIGEST))


@register(
    "h13_iv_strength",
    "SELECT o_orderkey, CASE WHEN v < 0.02 THEN 'Not predictive' WHEN v < 0.1 THEN 'Weak' WHEN v < 0.3 THEN 'Medium' WHEN v < 0.5 THEN 'Strong' ELSE 'Very strong' END AS strength FROM (SELECT o_orderkey, (o_orderkey % 700) / 1000.0::DOUBLE AS v FROM orders)",
)
def h13(spark, sf_dir):
    v = (F.col("o_orderkey") % 700) / F.lit(1000.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.iv_strength(v).alias("strength"))


@register("h14_composite_key", with_transfers(f"SELECT {KEY}, from_bank || '' || source AS plain_key, from_bank || '|' || source AS safe_key FROM transfers"))
def h14(spark, sf_dir):
    bank, account = F.col("from_bank"), F.col("source")
    return transfers(spark, sf_dir).select(*ROW_KEY, account_key(bank, account).alias("plain_key"), account_key(bank, account, "|").alias("safe_key"))


@register("h15_relative_seconds", "SELECT event_id, CAST(floor(epoch(ts)) - epoch(date_trunc('day', (SELECT min(ts) FROM events))) + 10 AS BIGINT) AS seconds FROM events")
def h15(spark, sf_dir):
    rows = user_events(spark, sf_dir)
    start = rows.agg(dates.seconds(F.date_trunc("day", F.min("ts").cast("timestamp")))).scalar()
    return rows.select("event_id", (dates.seconds(F.col("ts")) - start + 10).alias("seconds"))


@register(
    "h16_log_odds",
    with_transfers(
        f"""SELECT from_bank, {sq('greatest(-5::DOUBLE, least(5::DOUBLE, ln(((e + 0.5) / (ae + 1.0)::DOUBLE) / ((o + 0.5) / (ao + 1.0)::DOUBLE))))', 6)} AS woe FROM
(SELECT from_bank, count(*) FILTER (is_fraud = 1)::DOUBLE AS e, count(*) FILTER (is_fraud = 0)::DOUBLE AS o FROM transfers GROUP BY 1),
(SELECT count(*) FILTER (is_fraud = 1)::DOUBLE AS ae, count(*) FILTER (is_fraud = 0)::DOUBLE AS ao FROM transfers)"""
    ),
)
def h16(spark, sf_dir):
    from txnrisk.operators.aggregates import contingency

    counts = contingency(transfers(spark, sf_dir), "from_bank", "is_fraud")
    total = counts.agg(F.sum("events").alias("e"), F.sum("non_events").alias("o"))
    woe = numeric.log_odds(F.col("events"), F.col("non_events"), total.select("e").scalar(), total.select("o").scalar())
    return counts.select("from_bank", q(woe, 6).alias("woe"))
