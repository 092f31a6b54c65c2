"""Operators that read their input several times store it first, and tasks get bounded shares of it."""

from datetime import datetime

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from txnrisk.operators import encoding, evaluate, graph, models, ordering, stats, windows
from txnrisk.session import stored
from txnrisk.sources.canonical import transfers

N = 400


def passes(spark, operator):
    """How often ``operator`` (and a read of its result, if it is a table) computes its input's rows."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    i = F.col("id")
    rows = spark.range(N).select(
        i, (i % 7).alias("source"), (i % 11).alias("target"), (i % 3).alias("from_bank"), (i % 5).alias("to_bank"),
        (i * 37 % 101).cast("double").alias("amount"), (i * 13 % 29).cast("double").alias("other"), (i * 37 % 101 > 60).cast("int").alias("y"),
        F.concat(F.lit("f"), (i % 4).cast("string")).alias("format"),
    )
    rows = rows.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    out = operator(rows.mapInPandas(counted, rows.schema))
    if hasattr(out, "collect"):
        out.collect()
    return seen.value / N


@pytest.mark.parametrize(
    "name, operator, most",
    [
        ("correlations", lambda df: stats.correlation_matrix(df, ["amount", "other"]), 1),
        ("components", lambda df: stats.principal_components(df, ["amount", "other"], "y"), 1),
        ("forest", lambda df: models.forest_selection(df, ["amount", "other"], "y", numTrees=2, maxDepth=2), 1),
        ("robust parameters", lambda df: encoding.robust_params(df, ["amount", "other"]), 1),
        ("encoder", lambda df: encoding.FeatureEncoder(["format"], ["amount"]).fit(df), 1),
        ("top shares", lambda df: evaluate.metrics_at_share(df, "amount", "y", ["id"], limit=10), 1),
        ("pattern features", lambda df: graph.pattern_features(df, patterns(df), ["id"]), 1),
        ("ports", lambda df: graph.ports(df, tiebreak=["id"]), 2),
    ],
)
def test_the_input_is_computed_once(spark, name, operator, most):
    assert passes(spark, operator) <= most


def patterns(df):
    rows = [("CYCLE", 1, 2, 10.0, datetime(2024, 1, 1)), ("CYCLE", 2, 3, 12.0, datetime(2024, 1, 1, 5))]
    return df.sparkSession.createDataFrame(rows, "pattern_type string, source long, target long, amount double, timestamp timestamp_ntz")


def test_lines_go_to_the_joins_with_the_flag(spark, tmp_path):
    at = datetime(2024, 1, 1)
    tables = {
        "lineitem": ([(1, 1, 5, 7, at, 10.0, 2.0, 0.09, 0.0, "R"), (2, 1, 5, None, at, 9.0, 2.0, 0.1, 0.0, None), (1, 1, 5, 7, at, 10.0, 2.0, None, 0.0, "R")], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string"),
        "orders": ([(1, 3, "1-URGENT"), (1, 3, "2-HIGH"), (None, 3, "1-URGENT"), (2, 9, "3-LOW")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "customer": ([(3, 4), (None, 4)], "c_custkey long, c_nationkey long"),
        "supplier": ([(7, 6)], "s_suppkey long, s_nationkey long"),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    out = transfers(spark, str(tmp_path))
    assert sorted((r["source"], r["payment_format"], r["is_fraud"]) for r in out.collect()) == [
        (3, "1-URGENT", 0), (3, "1-URGENT", 1), (3, "2-HIGH", 0), (3, "2-HIGH", 1),
    ]
    top = out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert "_flagged" in top and "l_returnflag" not in top


def test_stored_rows_are_files_of_columns(spark):
    df = spark.createDataFrame([(1, None, 0.5, "a"), (2, 3, float("nan"), None)], "k long, v int, x double, t string")
    kept = stored(df)
    assert kept.inputFiles() and kept.schema == df.schema and rows_of(kept.fillna(9.0)) == rows_of(df.fillna(9.0))
    nested = df.select(F.array("k").alias("a"), F.lit(None).alias("nothing"))
    assert rows_of(stored(nested)) == rows_of(nested)
    assert stored(df.select("k", F.col("v").alias("K"))).count() == 2


def test_rows_in_order_are_stored_as_files(spark):
    assert ordering.global_rank(spark.range(100), [F.col("id").desc()], "place").inputFiles()


def test_more_rows_get_more_tasks(spark):
    df = spark.range(100)
    assert ordering.spread(df, ["id"], 100, 5).rdd.getNumPartitions() == 20
    assert ordering.spread(df, ["id"], 100) is df and ordering.spread(df, [], 100, 5) is df


def test_long_frames_get_small_chunks_and_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 20)
    rows = spark.range(300).select(F.lit(1).alias("k"), "id")
    most = []

    def add(frame, by, order):
        most.append((frame.groupBy(*by).count().agg(F.max("count")).first()[0], frame.rdd.getNumPartitions()))
        return frame.withColumn("n", F.lit(1))

    assert ordering.framed_by(rows, ["k"], ["id"], add, 1, limit=100, task_rows=10).count() == 300
    # a chunk and its halo
    assert (21, 30) in most
    assert all(size <= 21 for size, _ in most if size)


def test_ports_of_small_accounts_take_no_join(spark):
    at = lambda n: datetime(2024, 1, n)
    rows = [(1, 5, at(1), 1), (2, 5, at(1), 2), (1, 5, at(3), 3), (1, 6, at(2), 4), (None, 5, at(2), 5), (1, None, at(4), 6), (None, 5, at(2), 5), (3, 5, None, 7)]
    df = spark.createDataFrame(rows, "source long, target long, timestamp timestamp_ntz, k long")
    fast, slow = graph.ports(df, tiebreak=["k"]), graph.ports(df, tiebreak=["k"], limit=0)
    assert "Join" not in fast._jdf.queryExecution().optimizedPlan().toString()
    assert fast.schema == slow.schema or fast.dtypes == slow.dtypes
    assert rows_of(fast) == rows_of(slow)


def test_group_sizes_of_rows_without_a_key(spark):
    rows = [(1, "a"), (1, None), (None, "a"), (None, "a"), (None, None), (2, None)]
    df = spark.createDataFrame(rows, "s long, t string")
    wanted = {"n_s": (["s"], "t"), "n_t": (["t"], None), "n_pair": (["s", "t"], None)}
    out = windows.group_sizes(df, wanted)
    for name, (keys, counted) in wanted.items():
        out = windows.group_size(out, keys, f"_{name}", counted)
    found = out.collect()
    assert len(found) == 6 and all(r[n] == r[f"_{n}"] for r in found for n in wanted)
    plan = windows.group_sizes(df, {"n": (["s"], None)})._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" not in plan
    assert windows.group_sizes(df.limit(0), wanted).count() == 0


def test_reverse_ids_continue_after_a_known_number(spark):
    edges = spark.createDataFrame([(0, 4, 5), (1, 5, 6)], "e long, f long, t long")
    known, counted = (graph.with_reverse(edges, "f", "t", edge_id="e", count=n) for n in (2, None))
    assert rows_of(known) == rows_of(counted) and known.dtypes == counted.dtypes
