"""Section J: graph and pattern features."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators import graph, joins
from txnrisk.operators.encoding import apply_scale, standard_params
from txnrisk.operators.setops import distinct_ids
from txnrisk.plans.registry import KEY, PATTERNS, q, register, sq, with_transfers
from txnrisk.plans.windows import ORDER, ORDER_SQL, TIES
from txnrisk.sources.canonical import ROW_KEY, pattern_rows, transfers


@register(
    "j1_network_counts",
    with_transfers(
        f"SELECT {KEY}, count(*) OVER (PARTITION BY source) AS source_degree, count(*) OVER (PARTITION BY target) AS target_degree, count(*) OVER (PARTITION BY source, target) AS pair_frequency FROM transfers"
    ),
)
def j1(spark, sf_dir):
    out = graph.network_counts(transfers(spark, sf_dir).select(*ROW_KEY, "source", "target"))
    return out.select(*ROW_KEY, "source_degree", "target_degree", "pair_frequency")


def _degree_sql(edges, minus):
    return f"""d AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT source AS node, 0 AS i, 1 AS o FROM {edges} UNION ALL SELECT target, 1, 0 FROM {edges}) GROUP BY 1),
x AS (SELECT count(*) - {minus} AS n FROM d)"""


_DEGREE_OUT = f"""SELECT node, in_degree, out_degree, in_degree + out_degree AS degree, {sq('(in_degree + out_degree)::DOUBLE / n', 8)} AS degree_centrality,
{sq('in_degree::DOUBLE / n', 8)} AS in_degree_centrality, {sq('out_degree::DOUBLE / n', 8)} AS out_degree_centrality FROM d, x"""


def _rounded_degrees(out):
    return out.withColumns({c: q(c, 8) for c in ("degree_centrality", "in_degree_centrality", "out_degree_centrality")})


@register("j2_degree_table", with_transfers(_DEGREE_OUT, "e AS (SELECT DISTINCT source, target FROM transfers)", _degree_sql("e", 1)))
def j2(spark, sf_dir):
    return _rounded_degrees(graph.degree_table(transfers(spark, sf_dir)))


@register("j3_multi_degree_table", with_transfers(_DEGREE_OUT, _degree_sql("transfers", 0)))
def j3(spark, sf_dir):
    return _rounded_degrees(graph.degree_table(transfers(spark, sf_dir), distinct=False))


@register(
    "j4_fan_degrees",
    with_transfers(
        f"""SELECT {KEY}, fan_out_degree, fan_in_degree FROM transfers JOIN (SELECT source, count(DISTINCT target) AS fan_out_degree FROM transfers GROUP BY 1) USING (source)
JOIN (SELECT target, count(DISTINCT source) AS fan_in_degree FROM transfers GROUP BY 1) USING (target)"""
    ),
)
def j4(spark, sf_dir):
    return graph.fan_degrees(transfers(spark, sf_dir)).select(*ROW_KEY, "fan_out_degree", "fan_in_degree")


@register(
    "j5_degree_ratio",
    with_transfers(
        f"SELECT {KEY}, account_out_degree, account_in_degree, {sq('account_out_degree / (account_in_degree + 1.0::DOUBLE)', 6)} AS degree_ratio FROM (SELECT *, count(target) OVER (PARTITION BY source) AS account_out_degree, count(source) OVER (PARTITION BY target) AS account_in_degree FROM transfers)"
    ),
)
def j5(spark, sf_dir):
    out = graph.degree_ratio(transfers(spark, sf_dir))
    return out.select(*ROW_KEY, "account_out_degree", "account_in_degree", q("degree_ratio", 6).alias("degree_ratio"))


@register(
    "j6_bank_concentration",
    with_transfers(
        f"""SELECT {KEY}, {sq('f', 8)} AS from_bank_frequency, CAST(f < 0.04 AS INT) AS from_bank_is_rare, {sq('t', 8)} AS to_bank_frequency, CAST(t < 0.04 AS INT) AS to_bank_is_rare, CAST(from_bank = to_bank AS INT) AS same_bank_transfer
FROM (SELECT *, count(*) OVER (PARTITION BY from_bank)::DOUBLE / count(*) OVER () AS f, count(*) OVER (PARTITION BY to_bank)::DOUBLE / count(*) OVER () AS t FROM transfers)"""
    ),
)
def j6(spark, sf_dir):
    out = graph.bank_concentration(transfers(spark, sf_dir), rare=0.04)
    return out.select(
        *ROW_KEY, q("from_bank_frequency", 8).alias("from_bank_frequency"), "from_bank_is_rare",
        q("to_bank_frequency", 8).alias("to_bank_frequency"), "to_bank_is_rare", "same_bank_transfer",
    )


_TYPES = ["CYCLE", "FAN-OUT", "GATHER-SCATTER", "STACK"]
_SIM = "st AS (" + "SELECT " + ", ".join(
    f"round(avg(amount) FILTER (pattern_type = '{t}'), 2) AS m{i}, round(stddev_samp(amount) FILTER (pattern_type = '{t}'), 2) AS s{i}" for i, t in enumerate(_TYPES)
) + " FROM pattern_rows), sim AS (SELECT transfers.*, " + ", ".join(
    f"(amount - m{i}) / s{i} AS z{i}, exp(-0.5 * ((amount - m{i}) / s{i}) ** 2) AS g{i}" for i in range(4)
) + " FROM transfers, st)"


@register(
    "j7_amount_similarity",
    with_transfers(
        f"SELECT {KEY}, " + ", ".join(f"{sq(f'z{i}', 6)} AS \"amount_zscore_{t.lower()}\", {sq(f'g{i}', 6)} AS \"amount_similarity_{t.lower()}\"" for i, t in enumerate(_TYPES))
        + f", {sq('greatest(g0, g1, g2, g3)', 6)} AS amount_pattern_similarity_max, {sq('(g0 + g1 + g2 + g3) / 4', 6)} AS amount_pattern_similarity_mean FROM sim",
        PATTERNS, _SIM,
    ),
)
def j7(spark, sf_dir):
    out = graph.amount_similarity(transfers(spark, sf_dir), pattern_rows(spark, sf_dir))
    made = [c for c in out.columns if c.startswith("amount_")]
    return out.select(*ROW_KEY, *[q(f"`{c}`", 6).alias(c) for c in made])


@register(
    "j8_hour_similarity",
    f"""WITH a AS (SELECT hour(ts) AS h, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM events GROUP BY 1),
b AS (SELECT hour(ts) AS h, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(isodow(ts) >= 6 AS INT) AS is_weekend,
 (SELECT {sq('coalesce(sum(least(a.s, b.s)), 0)', 6)} FROM a JOIN b ON a.h = b.h) AS hour_pattern_similarity FROM events""",
)
def j8(spark, sf_dir):
    from txnrisk.sources.canonical import user_events

    rows = user_events(spark, sf_dir)
    out = graph.hour_similarity(rows, rows.filter(F.col("event_type") == "purchase"), "ts", "ts")
    return out.select("event_id", "hour", "day_of_week", "is_weekend", q("hour_pattern_similarity", 6).alias("hour_pattern_similarity"))


@register(
    "j9_pattern_graph_metrics",
    with_transfers(
        f"""SELECT pattern_type, n AS num_nodes, m AS num_edges, {sq('2 * m::DOUBLE / (n * (n - 1))', 8)} AS avg_degree, {sq('mx::DOUBLE / (n - 1)', 8)} AS max_degree, {sq('m::DOUBLE / (n * (n - 1))', 8)} AS network_density FROM
(SELECT pattern_type, count(*) AS n, max(deg) AS mx, CAST(sum(o) AS BIGINT) AS m FROM (SELECT pattern_type, node, count(*) AS deg, sum(o) AS o FROM
 (SELECT pattern_type, source AS node, 1 AS o FROM e UNION ALL SELECT pattern_type, target, 0 FROM e) GROUP BY 1, 2) GROUP BY 1)""",
        PATTERNS, "e AS (SELECT DISTINCT pattern_type, source, target FROM pattern_rows)",
    ),
)
def j9(spark, sf_dir):
    out = graph.pattern_graph_metrics(pattern_rows(spark, sf_dir))
    return out.withColumns({c: q(c, 8) for c in ("avg_degree", "max_degree", "network_density")})


@register(
    "j10_pattern_features",
    with_transfers(
        f"""SELECT {KEY}, {sq('greatest(g0, g1, g2, g3)', 6)} AS amount_pattern_similarity_max, {sq('count(target) OVER (PARTITION BY source) / (count(source) OVER (PARTITION BY target) + 1.0::DOUBLE)', 6)} AS degree_ratio,
 1.0::DOUBLE AS hour_pattern_similarity, CAST(from_bank = to_bank AS INT) AS same_bank_transfer,
 {sq(f'CASE WHEN count(amount) OVER w = 3 THEN avg(amount) OVER w END')} AS rolling_amount_mean_3, fan_out_degree, fan_in_degree
FROM sim JOIN (SELECT source, count(DISTINCT target) AS fan_out_degree FROM transfers GROUP BY 1) USING (source)
JOIN (SELECT target, count(DISTINCT source) AS fan_in_degree FROM transfers GROUP BY 1) USING (target)
WINDOW w AS (PARTITION BY source ORDER BY {ORDER_SQL} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
        PATTERNS, _SIM,
    ),
)
def j10(spark, sf_dir):
    rows = transfers(spark, sf_dir).select(*ROW_KEY, "source", "target", "from_bank", "to_bank")
    out = graph.pattern_features(rows, pattern_rows(spark, sf_dir), ORDER)
    return out.select(
        *ROW_KEY, q("amount_pattern_similarity_max", 6).alias("amount_pattern_similarity_max"), q("degree_ratio", 6).alias("degree_ratio"),
        "hour_pattern_similarity", "same_bank_transfer", q("rolling_amount_mean_3").alias("rolling_amount_mean_3"), "fan_out_degree", "fan_in_degree",
    )


EDGES = f"""r AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) - 1 AS edge_id, from_bank || '' || source AS f, to_bank || '' || target AS t FROM transfers),
acc AS (SELECT value, row_number() OVER (ORDER BY min(p)) - 1 AS code FROM (SELECT f AS value, edge_id * 2 AS p FROM r UNION ALL SELECT t, edge_id * 2 + 1 FROM r) GROUP BY 1),
fmt AS (SELECT payment_format AS value, row_number() OVER (ORDER BY min(edge_id)) - 1 AS code FROM r GROUP BY 1)"""


@register("j11_account_codes", with_transfers("SELECT value, code FROM acc", EDGES))
def j11(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    ends = graph.account_key(F.col("from_bank"), F.col("source")), graph.account_key(F.col("to_bank"), F.col("target"))
    return graph.first_seen_codes(rows, *ends, ORDER)


@register("j11_format_codes", with_transfers("SELECT value, code FROM fmt", EDGES))
def j11_formats(spark, sf_dir):
    return graph.dictionary(transfers(spark, sf_dir), "payment_format", ORDER)


EDGE_TABLE = """edges AS (SELECT edge_id, a.code AS from_id, b.code AS to_id, amount AS amount_sent, 0::BIGINT AS sent_currency, amount AS amount_received, 0::BIGINT AS received_currency, fmt.code AS payment_format, is_fraud,
 CAST(epoch(timestamp) - (SELECT epoch(date_trunc('day', min(timestamp))) FROM r) + 10 AS BIGINT) AS seconds
FROM r JOIN acc a ON f = a.value JOIN acc b ON t = b.value JOIN fmt ON payment_format = fmt.value)"""


def _edges(spark, sf_dir):
    return graph.edge_table(transfers(spark, sf_dir), ORDER)


@register("j12_edge_table", with_transfers("SELECT * FROM edges", EDGES, EDGE_TABLE))
def j12(spark, sf_dir):
    return _edges(spark, sf_dir)


@register("j13_sender_labels", with_transfers("SELECT entity, coalesce(y, 0) AS entity_label FROM (SELECT source AS entity FROM transfers UNION SELECT target FROM transfers) LEFT JOIN (SELECT source, max(is_fraud) AS y FROM transfers GROUP BY 1) ON entity = source"))
def j13(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    return joins.label_rollup(distinct_ids(rows, ["source", "target"], "entity"), rows, "entity", "source", "is_fraud")


@register(
    "j14_z_norm",
    with_transfers(f"SELECT {KEY}, {sq('(amount - (SELECT avg(amount) FROM transfers)) / (SELECT stddev_samp(amount) FROM transfers)', 6)} AS amount_z, {sq('(from_bank - (SELECT avg(from_bank) FROM transfers)) / (SELECT stddev_samp(from_bank) FROM transfers)', 6)} AS bank_z FROM transfers"),
)
def j14(spark, sf_dir):
    rows = transfers(spark, sf_dir).withColumns({"amount_z": F.col("amount"), "bank_z": F.col("from_bank")})
    out = apply_scale(rows, standard_params(rows, ["amount_z", "bank_z"], sample=True))
    return out.select(*ROW_KEY, q("amount_z", 6).alias("amount_z"), q("bank_z", 6).alias("bank_z"))


_PORTS = f"""pairs AS (SELECT source, target, min(row({ORDER_SQL})) AS f FROM transfers GROUP BY 1, 2),
p AS (SELECT source, target, row_number() OVER (PARTITION BY target ORDER BY f, source) - 1 AS in_port, row_number() OVER (PARTITION BY source ORDER BY f, target) - 1 AS out_port FROM pairs),
pe AS (SELECT source, target, amount, timestamp, in_port, out_port FROM transfers JOIN p USING (source, target))"""


@register(
    "j15_reverse_edges",
    with_transfers("SELECT *, 'to' AS direction FROM pe UNION ALL SELECT target, source, amount, timestamp, out_port, in_port, 'rev_to' FROM pe", _PORTS),
)
def j15(spark, sf_dir):
    rows = graph.ports(transfers(spark, sf_dir), tiebreak=TIES).select("source", "target", "amount", "timestamp", "in_port", "out_port")
    return graph.with_reverse(rows, "source", "target", in_port="in_port", out_port="out_port")


@register(
    "j16_edge_ids",
    with_transfers("SELECT edge_id, from_id, to_id, 'to' AS direction FROM edges UNION ALL SELECT edge_id + (SELECT count(*) FROM edges), to_id, from_id, 'rev_to' FROM edges", EDGES, EDGE_TABLE),
)
def j16(spark, sf_dir):
    edges, count = _edges(spark, sf_dir).select("edge_id", "from_id", "to_id"), transfers(spark, sf_dir).count()
    return graph.with_reverse(edges, "from_id", "to_id", edge_id="edge_id", count=count)


@register(
    "j17_ego_flags",
    with_transfers(
        "SELECT id, CAST(id IN (SELECT source FROM transfers WHERE is_fraud = 1 UNION SELECT target FROM transfers WHERE is_fraud = 1) AS INT) AS ego FROM (SELECT source AS id FROM transfers UNION SELECT target FROM transfers)"
    ),
)
def j17(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    return graph.ego_flags(distinct_ids(rows, ["source", "target"]), "id", rows.filter(F.col("is_fraud") == 1), "source", "target")


@register(
    "j18_neighbour_stats",
    with_transfers(
        f"""SELECT node, degree, {sq('mean')} AS mean, {sq('mn')} AS min, {sq('mx')} AS max, {sq('std', 2)} AS std, {sq('ln(degree + 1) / av', 8)} AS amplification, {sq('av / ln(degree + 1)', 8)} AS attenuation FROM s, (SELECT avg(ln(degree + 1)) AS av FROM s)""",
        "s AS (SELECT target AS node, count(*) AS degree, avg(amount) AS mean, min(amount) AS mn, max(amount) AS mx, coalesce(stddev_pop(amount), 0) AS std FROM transfers GROUP BY 1)",
    ),
)
def j18(spark, sf_dir):
    out = graph.neighbour_stats(transfers(spark, sf_dir), "source", "target", "amount")
    digits = {"std": 2, "amplification": 8, "attenuation": 8}
    return out.withColumns({c: q(c, digits.get(c, 4)) for c in ("mean", "min", "max", "std", "amplification", "attenuation")})


@register(
    "j18_two_hop_mean",
    with_transfers(
        f"SELECT target AS node, {sq('avg(v2)')} AS value FROM transfers JOIN h1 ON source = node GROUP BY 1",
        "h0 AS (SELECT source AS node, avg(amount) AS v FROM transfers GROUP BY 1)",
        "h1 AS (SELECT target AS node, avg(v) AS v2 FROM transfers JOIN h0 ON source = node GROUP BY 1)",
    ),
)
def j18_hops(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    nodes = rows.groupBy(F.col("source").alias("node")).agg(F.avg("amount").alias("value"))
    for _ in range(2):
        nodes = graph.neighbour_mean(rows, nodes, "source", "target", "node", "value")
    return nodes.select("node", q("value").alias("value"))


@register("j18_degree_histogram", with_transfers("SELECT degree, count(*) AS n_nodes FROM (SELECT target, count(*) AS degree FROM transfers GROUP BY 1) GROUP BY 1"))
def j18_histogram(spark, sf_dir):
    return graph.degree_histogram(transfers(spark, sf_dir), "target")
