import datetime as dt

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import graph, joins, topk

START = dt.datetime(2024, 1, 1, 5)
SCHEMA = "id int, source int, target int, timestamp timestamp_ntz, amount double"


@pytest.fixture(scope="module")
def edges(spark):
    """Parallel edges 1->2, a self-loop 3->3, a cycle 1->2->4->1, equal times."""
    pairs = [(1, 2), (1, 2), (3, 3), (2, 4), (4, 1), (5, 2), (1, 4)]
    rows = [(i, a, b, START + dt.timedelta(hours=i // 2), float(i + 1)) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA)


def test_simple_graph_degrees(edges):
    got = {r["node"]: (r["in_degree"], r["out_degree"], r["degree_centrality"]) for r in graph.degree_table(edges).collect()}
    assert got == {1: (1, 2, 0.75), 2: (2, 1, 0.75), 3: (1, 1, 0.5), 4: (2, 1, 0.75), 5: (0, 1, 0.25)}


def test_multigraph_degrees(edges):
    got = {r["node"]: (r["in_degree"], r["out_degree"], r["degree_centrality"]) for r in graph.degree_table(edges, distinct=False).collect()}
    assert got[1] == (1, 3, 0.8) and got[2] == (3, 1, 0.8)


@pytest.mark.parametrize("limit", [10_000, 1])
def test_ports_follow_first_appearance(edges, limit):
    got = {r["id"]: (r["in_port"], r["out_port"]) for r in graph.ports(edges, tiebreak=["id"], limit=limit).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (1, 0), 6: (1, 1)}


def test_reverse_edges_swap_ports_and_continue_ids(edges):
    rows = graph.ports(edges, tiebreak=["id"]).select("id", "source", "target", "in_port", "out_port")
    out = graph.with_reverse(rows, "source", "target", "id", "in_port", "out_port")
    back = {r["id"]: r for r in out.filter(F.col("direction") == "rev_to").collect()}
    assert (back[13]["source"], back[13]["target"], back[13]["in_port"], back[13]["out_port"]) == (4, 1, 1, 1)
    assert (back[12]["source"], back[12]["target"], back[12]["in_port"], back[12]["out_port"]) == (2, 5, 0, 1)
    assert out.count() == 14 and out.select("id").distinct().count() == 14


@pytest.mark.parametrize("limit", [10_000, 2])
def test_first_seen_codes_are_dense(edges, limit):
    codes = graph.first_seen_codes(edges, F.col("source"), F.col("target"), ["id"], limit)
    assert {r["value"]: r["code"] for r in codes.collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}


@pytest.mark.parametrize("limit", [10_000, 2])
def test_edge_table(spark, limit):
    rows = [
        (0, "b1", "x", "b2", "y", START, 10.0, 9.0, "EUR", "USD", "wire", 0),
        (1, "b2", "y", "b1", "x", START + dt.timedelta(minutes=1), 5.0, 5.0, "USD", "USD", "cash", 1),
    ]
    df = spark.createDataFrame(
        rows,
        "id int, from_bank string, source string, to_bank string, target string, timestamp timestamp_ntz, "
        "sent double, received double, sc string, rc string, payment_format string, is_fraud int",
    )
    out = graph.edge_table(df, ["id"], "sent", "received", F.col("sc"), F.col("rc"), limit).orderBy("edge_id").collect()
    a, b = out
    assert (a["from_id"], a["to_id"], b["from_id"], b["to_id"]) == (0, 1, 1, 0)
    assert (a["received_currency"], a["sent_currency"], b["sent_currency"]) == (0, 1, 0), "receiving currency comes first"
    assert (a["payment_format"], b["payment_format"]) == (0, 1)
    assert (a["seconds"], b["seconds"]) == (5 * 3600 + 10, 5 * 3600 + 70)


def test_amount_similarity_without_spread(edges, spark):
    patterns = spark.createDataFrame([("CYCLE", 3.0), ("CYCLE", 3.0), ("STACK", 1.0), ("STACK", 3.0)], "pattern_type string, amount double")
    out = {r["id"]: r for r in graph.amount_similarity(edges, patterns).collect()}
    assert out[2]["amount_similarity_cycle"] == 1.0 and out[3]["amount_similarity_cycle"] == 0.0
    z = (4.0 - 2.0) / 1.41
    assert out[3]["amount_zscore_stack"] == pytest.approx(z)
    assert out[2]["amount_pattern_similarity_max"] == 1.0


def test_pattern_graph_metrics(spark):
    df = spark.createDataFrame([("C", 1, 2), ("C", 1, 2), ("C", 2, 1), ("F", 1, 2), ("F", 1, 3)], "pattern_type string, source int, target int")
    got = {r["pattern_type"]: r for r in graph.pattern_graph_metrics(df).collect()}
    assert (got["C"]["num_nodes"], got["C"]["num_edges"], got["C"]["network_density"], got["C"]["avg_degree"]) == (2, 2, 1.0, 2.0)
    assert (got["F"]["num_nodes"], got["F"]["max_degree"]) == (3, 1.0) and got["F"]["network_density"] == pytest.approx(1 / 3)


def test_neighbour_stats_and_hops(edges):
    got = {r["node"]: r for r in graph.neighbour_stats(edges, "source", "target", "amount").collect()}
    assert (got[2]["degree"], got[2]["mean"], got[2]["max"]) == (3, 3.0, 6.0) and got[1]["std"] == 0.0
    nodes = edges.select(F.col("source").alias("node")).distinct().withColumn("v", F.col("node").cast("double"))
    hop = {r["node"]: r["v"] for r in graph.neighbour_mean(edges, nodes, "source", "target", "node", "v").collect()}
    assert hop == {1: 4.0, 2: pytest.approx(7 / 3), 3: 3.0, 4: 1.5}


def test_endpoint_codes_drop_unknown(edges, spark):
    codes = spark.createDataFrame([(1, 0), (2, 1)], "value int, code int")
    assert joins.encode_endpoints(edges, codes).count() == 2


def test_label_rollup_prefers_sent_then_own(edges, spark):
    entities = spark.createDataFrame([(1, 0), (9, 1), (8, None)], "entity int, own int")
    marked = edges.withColumn("is_fraud", (F.col("id") == 1).cast("int"))
    got = {r["entity"]: r["entity_label"] for r in joins.label_rollup(entities, marked, "entity", "source", "is_fraud", "own").collect()}
    assert got == {1: 1, 9: 1, 8: 0}


def test_sampling_is_repeatable_on_any_partitioning(spark):
    df = spark.range(500).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    a, b = topk.sample_rows(df, 20, ["id"]), topk.sample_rows(df.repartition(9), 20, ["id"])
    assert a.count() == 20 and a.exceptAll(b).count() == 0
    share = topk.sample_fraction(df, 0.3, ["id"]).count()
    assert 100 < share < 200
    for limit in (10_000, 10):
        sizes = {r["label"]: r["count"] for r in topk.stratified_sample(df, "label", 0.25, ["id"], limit=limit).groupBy("label").count().collect()}
        assert sizes == {0: 100, 1: 25}


def test_top_per_group_small_and_large_k(spark):
    df = spark.range(3000).withColumn("k", F.col("id") % 2)
    assert topk.top_per_group(df, ["k"], [F.col("id").desc()], 3).count() == 6
    assert topk.top_per_group(df, ["k"], [F.col("id").desc()], 1200, limit=100).count() == 2400


def test_first_row_needs_an_order(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, None)], "k int, seq int, name string")
    assert {r["k"]: r["name"] for r in joins.first_row(df, ["k"], ["seq"]).collect()} == {1: "a", 2: None}
