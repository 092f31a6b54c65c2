"""Section E: window functions over time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators import windows as win
from txnrisk.operators.ordering import running_sum
from txnrisk.plans.flagship import FLAGSHIP_SQL, account_activity
from txnrisk.plans.registry import KEY, TRANSFERS, q, register, sq, with_scores, with_transfers
from txnrisk.sources.canonical import ROW_KEY, line_scores, transfers, user_events

TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "amount"]
ORDER = ["timestamp", *TIES]
ORDER_SQL = "timestamp, l_orderkey, l_linenumber, l_partkey, l_suppkey, amount"


@register(
    "flagship_account_activity",
    "WITH "
    + TRANSFERS
    + FLAGSHIP_SQL
    + f"""SELECT {KEY}, source, r.payment_format, {sq('s7')} AS source_amount_sum_7d, {sq('s7 / n7')} AS source_amount_mean_7d, n7 AS source_transaction_count_7d,
{sq('s30')} AS source_amount_sum_30d, {sq('s30 / n30')} AS source_amount_mean_30d, n30 AS source_transaction_count_30d, {sq('rate', 6)} AS format_fraud_rate
FROM r JOIN f ON r.payment_format = f.payment_format""",
)
def flagship(spark, sf_dir):
    return account_activity(spark, sf_dir)


def _rows_sql(group, w):
    over = f"OVER (PARTITION BY {group} ORDER BY {ORDER_SQL} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    n = f"{group}_amount"
    return (
        f"{sq(f'sum(amount) {over}')} AS {n}_sum_{w}d, {sq(f'avg(amount) {over}')} AS {n}_mean_{w}d, "
        f"count(amount) {over} AS {n}_count_{w}d, {sq(f'coalesce(stddev_samp(amount) {over}, 0)', 1)} AS {n}_std_{w}d"
    )


_E1_GROUPS, _E1_WINDOWS = ["source", "target", "from_bank"], [7, 30, 90]


@register(
    "e1_rolling_rows",
    with_transfers(f"SELECT {KEY}, " + ", ".join(_rows_sql(g, w) for g in _E1_GROUPS for w in _E1_WINDOWS) + " FROM transfers"),
)
def e1(spark, sf_dir):
    rows = transfers(spark, sf_dir, orders_first=True).select(*ROW_KEY, *_E1_GROUPS)
    out = win.rolling_rows(rows, _E1_GROUPS, ORDER, ["amount"], _E1_WINDOWS)
    made = [c for c in out.columns if c.endswith("d") and "_amount_" in c]
    shown = [F.col(c) if "_count_" in c else q(c, 1 if "_std_" in c else 4).alias(c) for c in made]
    return out.select(*ROW_KEY, *shown)


def _days_sql(entity, days, time, source, key, order=""):
    span = f"OVER (PARTITION BY {entity} ORDER BY epoch_us({time}) RANGE BETWEEN {{}} PRECEDING AND CURRENT ROW)"
    cols = []
    for d in days:
        over = span.format(d * 86_400_000_000 - 1)
        cols += [f"sum({order}) {over} AS s{d}", f"count({order}) {over} AS n{d}"]
    return f"SELECT {key}, {', '.join(cols)} FROM {source}"


def _days_out(prefix, days):
    return ", ".join(
        f"{sq(f'coalesce(s{d}, 0)')} AS {prefix}_sum_{d}d, {sq(f'coalesce(s{d} / n{d}, 0)')} AS {prefix}_mean_{d}d, n{d} AS {prefix}_count_{d}d"
        for d in days
    )


def _shown(out, keys):
    made = [c for c in out.columns if c not in keys]
    return out.select(*keys, *[F.col(c) if "_count_" in c else q(c).alias(c) for c in made])


@register(
    "e2_rolling_days",
    with_transfers(f"SELECT {KEY}, {_days_out('source_amount', [7, 30])} FROM (" + _days_sql("source", [7, 30], "timestamp", "transfers", KEY, "amount") + ")"),
)
def e2(spark, sf_dir):
    rows = transfers(spark, sf_dir).select(*ROW_KEY, "source")
    return _shown(win.rolling_days(rows, "source").drop("source"), ROW_KEY)


@register(
    "e2_rolling_days_rows_mode",
    with_transfers(
        f"""SELECT {KEY}, {sq("s7")} AS source_amount_sum_7d, {sq("s7 / n7")} AS source_amount_mean_7d, n7 AS source_amount_count_7d FROM (
SELECT {KEY}, sum(amount) OVER w - later.s AS s7, count(amount) OVER w - later.n AS n7 FROM transfers t,
 LATERAL (SELECT coalesce(sum(u.amount), 0) AS s, count(u.amount) AS n FROM transfers u WHERE u.source = t.source AND u.timestamp = t.timestamp
   AND (u.l_orderkey, u.l_linenumber, u.l_partkey, u.l_suppkey, u.amount) > (t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, t.amount)) later
 WINDOW w AS (PARTITION BY source ORDER BY epoch_us(timestamp) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW))"""
    ),
)
def e2_rows(spark, sf_dir):
    rows = transfers(spark, sf_dir).select(*ROW_KEY, "source")
    return _shown(win.rolling_days(rows, "source", days=[7], tie_mode="rows", tiebreak=TIES).drop("source"), ROW_KEY)


@register(
    "e2_rolling_days_swept",
    "SELECT event_id, user_id, "
    + _days_out("user_id_value", [1, 7])
    + " FROM ("
    + _days_sql("user_id", [1, 7], "ts", "events", "event_id, user_id", "value")
    + ")",
)
def e2_swept(spark, sf_dir):
    """The same range sums by the sweep that serves very active accounts."""
    rows = user_events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    out = win.rolling_days(rows, "user_id", "ts", "value", [1, 7], limit=0)
    return _shown(out.drop("ts", "value"), ["event_id", "user_id"])


@register(
    "e3_entity_days",
    f"SELECT event_id, user_id, {_days_out('user_id_amount', [7, 30])} FROM (" + _days_sql("user_id", [7, 30], "ts", "events", "event_id, user_id", "value") + ")",
)
def e3(spark, sf_dir):
    rows = user_events(spark, sf_dir).select("event_id", "user_id", "ts", F.col("value").alias("amount"))
    out = win.rolling_days(rows, "user_id", "ts", "amount", [7, 30])
    return _shown(out.drop("ts", "amount"), ["event_id", "user_id"])


@register(
    "e4_short_run",
    with_transfers(
        f"""SELECT {KEY}, {sq('m')} AS rolling_amount_mean_3, {sq('s', 2)} AS rolling_amount_std_3, {sq('s / (m + 1e-6)', 6)} AS amount_cv_3 FROM (
SELECT {KEY}, CASE WHEN count(amount) OVER w = 3 THEN avg(amount) OVER w END AS m, CASE WHEN count(amount) OVER w = 3 THEN stddev_samp(amount) OVER w END AS s
FROM transfers WINDOW w AS (PARTITION BY source ORDER BY {ORDER_SQL} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
    ),
)
def e4(spark, sf_dir):
    out = win.short_run_features(transfers(spark, sf_dir), "source", ORDER)
    return out.select(
        *ROW_KEY, q("rolling_amount_mean_3").alias("rolling_amount_mean_3"),
        q("rolling_amount_std_3", 2).alias("rolling_amount_std_3"), q("amount_cv_3", 6).alias("amount_cv_3"),
    )


def _lag_sql(partition):
    over = f"OVER ({partition} ORDER BY {ORDER_SQL})"
    return f"SELECT {KEY}, " + ", ".join(f"CAST(lag(is_fraud, {p}) {over} AS DOUBLE) AS is_fraud_lag_{p}" for p in (1, 7, 14, 30)) + " FROM transfers"


@register("e5_target_lags", with_transfers(_lag_sql("PARTITION BY source")))
def e5(spark, sf_dir):
    out = win.lags(transfers(spark, sf_dir), ["source"], ORDER, "is_fraud")
    return out.select(*ROW_KEY, *[F.col(f"is_fraud_lag_{p}").cast("double").alias(f"is_fraud_lag_{p}") for p in (1, 7, 14, 30)])


@register("e5_target_lags_global", with_transfers(_lag_sql("")))
def e5_global(spark, sf_dir):
    """One global time order, cut into chunks that carry their predecessors along."""
    out = win.lags(transfers(spark, sf_dir), [], ORDER, "is_fraud", limit=10_000)
    return out.select(*ROW_KEY, *[F.col(f"is_fraud_lag_{p}").cast("double").alias(f"is_fraud_lag_{p}") for p in (1, 7, 14, 30)])


@register(
    "e6_rolling_target",
    with_transfers(
        f"SELECT {KEY}, "
        + ", ".join(
            f"{sq(f'avg(is_fraud) OVER (PARTITION BY source ORDER BY {ORDER_SQL} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)', 6)} AS is_fraud_rolling_mean_{w}, "
            f"{sq(f'stddev_samp(is_fraud) OVER (PARTITION BY source ORDER BY {ORDER_SQL} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)', 6)} AS is_fraud_rolling_std_{w}"
            for w in (7, 14, 30)
        )
        + " FROM transfers"
    ),
)
def e6(spark, sf_dir):
    out = win.rolling_target(transfers(spark, sf_dir), ["source"], ORDER, "is_fraud")
    made = [f"is_fraud_rolling_{s}_{w}" for w in (7, 14, 30) for s in ("mean", "std")]
    return out.select(*ROW_KEY, *[q(c, 6).alias(c) for c in made])


@register(
    "e7_time_order_check",
    with_transfers(
        """SELECT source, count(*) FILTER (b > timestamp) = 0 AS is_ordered, count(*) FILTER (b > timestamp) AS n_breaks FROM (
SELECT source, timestamp, lag(timestamp) OVER (PARTITION BY source ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, timestamp, amount) AS b FROM transfers) GROUP BY 1"""
    ),
)
def e7(spark, sf_dir):
    return win.is_time_ordered(transfers(spark, sf_dir), ["source"], ROW_KEY, "timestamp")


@register(
    "e8_time_deltas",
    with_transfers(
        f"""SELECT {KEY}, coalesce(epoch(timestamp) - epoch(lag(timestamp) OVER (PARTITION BY target ORDER BY {ORDER_SQL})), 0) AS in_time_delta,
coalesce(epoch(timestamp) - epoch(lag(timestamp) OVER (PARTITION BY source ORDER BY {ORDER_SQL})), 0) AS out_time_delta FROM transfers"""
    ),
)
def e8(spark, sf_dir):
    return win.time_deltas(transfers(spark, sf_dir), tiebreak=TIES).select(*ROW_KEY, "in_time_delta", "out_time_delta")


@register(
    "e9_ports",
    with_transfers(
        f"""SELECT {KEY}, in_port, out_port FROM transfers JOIN p USING (source, target)""",
        f"""pairs AS (SELECT source, target, min(row({ORDER_SQL})) AS f FROM transfers GROUP BY 1, 2),
p AS (SELECT source, target, row_number() OVER (PARTITION BY target ORDER BY f, source) - 1 AS in_port,
 row_number() OVER (PARTITION BY source ORDER BY f, target) - 1 AS out_port FROM pairs)""",
    ),
)
def e9(spark, sf_dir):
    from txnrisk.operators.graph import ports

    return ports(transfers(spark, sf_dir), tiebreak=TIES).select(*ROW_KEY, "in_port", "out_port")


@register(
    "e10_group_size",
    with_transfers(f"SELECT {KEY}, count(target) OVER (PARTITION BY source) AS n_source, count(source) OVER (PARTITION BY target) AS n_target FROM transfers"),
)
def e10(spark, sf_dir):
    rows = win.group_sizes(transfers(spark, sf_dir), {"n_source": (["source"], "target"), "n_target": (["target"], "source")})
    return rows.select(*ROW_KEY, "n_source", "n_target")


_SCORE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "timestamp", "amount"]


@register(
    "e11_cumulative_hits",
    with_scores(f"SELECT {KEY}, CAST(sum(label) OVER (ORDER BY score DESC, {KEY} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_tp FROM scores"),
)
def e11(spark, sf_dir):
    rows = line_scores(spark, sf_dir)
    out = running_sum(rows, [], [F.col("score").desc(), *_SCORE_ORDER], {"cum_tp": F.col("label")}, limit=10_000)
    return out.select(*ROW_KEY, "cum_tp")


@register(
    "e12_first_drop",
    with_transfers(
        f"""SELECT CAST(year(timestamp) AS INT) AS year, {sq('v', 6)} AS rate, {sq('v / b', 6)} AS ratio, CAST((SELECT min(y) FROM r WHERE v / b < 0.97::DOUBLE) AS DOUBLE) AS first_drop
FROM (SELECT make_timestamp(y, 1, 1, 0, 0, 0.0) AS timestamp, v, b FROM r)""",
        """r AS (SELECT y, v, first_value(v) OVER (ORDER BY y) AS b FROM (SELECT CAST(year(timestamp) AS INT) AS y, avg(is_fraud) AS v FROM transfers GROUP BY 1))""",
    ),
)
def e12(spark, sf_dir):
    rates = transfers(spark, sf_dir).groupBy(F.year("timestamp").alias("year")).agg(F.avg("is_fraud").alias("rate"))
    out = win.first_drop(rates, [], "year", "rate", share=0.97)
    return out.select("year", q("rate", 6).alias("rate"), q("ratio", 6).alias("ratio"), F.col("first_drop").cast("double").alias("first_drop"))
