"""Results that must not depend on the size of a key, the number of files or the partitioning, and null rules."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import aggregates, graph, monitor, quantiles, splits, stats, topk, windows
from txnrisk.streaming import jobs

START = dt.datetime(2024, 1, 1)
INF, NAN = float("inf"), float("nan")

ROLLING = {
    "null time": [("k", 0, 1.0), ("k", None, 4.0), ("k", None, 7.0), ("k", 3, 2.0), (None, 1, 5.0), (None, None, 6.0)],
    "nan": [("k", 0, 1.0), ("k", 1, NAN), ("k", 9, 2.0), ("j", 1, 3.0)],
    "infinite": [("k", 0, 1.0), ("k", 1, INF), ("k", 8, 5.0), ("k", 9, -INF), ("k", 20, 2.0), ("j", 0, INF), ("j", 1, -INF)],
    "tiny": [("k", 0, 1e-9), ("k", 1, 3e-9), ("k", 30, 2e-9), ("j", 0, 0.0), ("j", 1, None)],
    "huge": [("k", 0, 1e21), ("k", 1, 3e21), ("k", 12, 5e20), ("j", 2, 1e300), ("j", 3, 2e300)],
}


def same(a: float, b: float) -> bool:
    return math.isnan(a) and math.isnan(b) or a == b or math.isclose(a, b, rel_tol=1e-12)


def rolling_by_force(rows: list, days: int) -> list:
    out = []
    for key, t, _ in rows:
        seen = [v for k, s, v in rows if k == key and v is not None and (s is None and t is None or s is not None and t is not None and t - days < s <= t)]
        out.append((float(sum(seen)) if seen else 0.0, len(seen)))
    return out


@pytest.mark.parametrize("name", ROLLING)
@pytest.mark.parametrize(("limit", "chunk"), [(20_000, 1_000_000), (0, 1_000_000), (0, 1)])
def test_rolling_days_is_one_definition(spark, name, limit, chunk):
    rows = ROLLING[name]
    made = [(i, k, None if t is None else START + dt.timedelta(days=t), v) for i, (k, t, v) in enumerate(rows)]
    df = spark.createDataFrame(made, "i int, source string, timestamp timestamp_ntz, amount double")
    out = windows.rolling_days(df, "source", days=[7], limit=limit, chunk_rows=chunk)
    got = {r["i"]: (r["source_amount_sum_7d"], r["source_amount_count_7d"]) for r in out.collect()}
    assert set(out.columns) == {*df.columns, "source_amount_sum_7d", "source_amount_mean_7d", "source_amount_count_7d"}
    for i, (total, n) in enumerate(rolling_by_force(rows, 7)):
        assert got[i][1] == n and same(got[i][0], total), (i, got[i], total, n)


@pytest.mark.parametrize("name", ROLLING)
def test_rolling_days_row_by_row(spark, name):
    rows = ROLLING[name]
    made = [(i, k, None if t is None else START + dt.timedelta(days=t), v) for i, (k, t, v) in enumerate(rows)]
    df = spark.createDataFrame(made, "i int, source string, timestamp timestamp_ntz, amount double")
    out = windows.rolling_days(df, "source", days=[7], tie_mode="rows", tiebreak=["i"])
    assert set(out.columns) == {*df.columns, "source_amount_sum_7d", "source_amount_mean_7d", "source_amount_count_7d"}
    for r in out.collect():
        key, t, _ = rows[r["i"]]
        seen = [v for j, (k, s, v) in enumerate(rows) if k == key and v is not None and (s is None and t is None and j <= r["i"] or s is not None and t is not None and t - 7 < s and (s < t or s == t and j <= r["i"]))]
        assert r["source_amount_count_7d"] == len(seen)
        assert same(r["source_amount_sum_7d"], float(sum(seen)) if seen else 0.0)


@pytest.mark.parametrize("values", [[1.0, 2.0, INF, INF, INF], [-INF, 1.0, 2.0], [5.0], [1.0, 2.0, 4.0, 8.0]])
def test_quantile_routes_agree_on_infinite_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.25, 0.4, 0.5, 0.9, 1.0]
    built_in = quantiles.quantile_row(df, ["x"], probs)["x"]
    running = quantiles.quantile_row(df, ["x"], probs, limit=1)["x"]
    assert all(same(a, b) for a, b in zip(built_in, running, strict=True)), (built_in, running)


@pytest.fixture
def unordered(spark, tmp_path):
    """Four files of 200 rows, the newest first."""
    for k, hour in enumerate((9, 6, 3, 0)):
        rows = [(START + dt.timedelta(hours=hour, seconds=9 * i), float(i)) for i in range(200)]
        spark.createDataFrame(rows, "ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_stored_files_are_one_batch(spark, unordered, tmp_path):
    df = spark.read.parquet(unordered)
    stream = jobs.window_metric_stream(jobs.read_stream(spark, unordered, df.schema), "ts", "value", late="0 seconds")
    jobs.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = {r["window_start"]: r["sample_size"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["window_start"]: r["sample_size"] for r in monitor.window_metrics(df, "ts", "value").collect()}
    assert sum(got.values()) > 750
    assert all(want[w] == n for w, n in got.items())


def test_late_rows_are_an_error_unless_allowed(spark, unordered, tmp_path, monkeypatch):
    schema = spark.read.parquet(unordered).schema

    def stream():
        return jobs.window_metric_stream(jobs.read_stream(spark, unordered, schema, files_per_batch=1), "ts", "value", late="10 minutes")

    with pytest.raises(jobs.LateRows):
        jobs.run_to_parquet(stream(), str(tmp_path / "a"), str(tmp_path / "pa"))
    query = jobs.run_to_parquet(stream(), str(tmp_path / "b"), str(tmp_path / "pb"), allow_late=True)
    assert jobs.dropped_rows(query) > 0
    monkeypatch.setattr(jobs, "PROGRESS", 1)
    with pytest.raises(jobs.LateRows, match="unseen"):
        jobs.run_to_parquet(stream(), str(tmp_path / "c"), str(tmp_path / "pc"))


def test_patient_streams_give_batch_totals_file_by_file(spark, unordered, tmp_path):
    df = spark.read.parquet(unordered)
    stream = jobs.window_metric_stream(jobs.read_stream(spark, unordered, df.schema, files_per_batch=1), "ts", "value", late="12 hours")
    query = jobs.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert jobs.dropped_rows(query) == 0


def test_stream_scorer_is_checked(spark, unordered):
    stream = jobs.read_stream(spark, unordered, spark.read.parquet(unordered).schema)
    with pytest.raises(ValueError, match="lacks"):
        jobs.score_stream(stream, lambda df: df, needs=["amount"])
    with pytest.raises(ValueError, match="give"):
        jobs.score_stream(stream, lambda df: df, gives=["score"])
    with pytest.raises(ValueError, match="batch"):
        jobs.score_stream(stream, lambda df: spark.range(1))
    assert jobs.score_stream(stream, lambda df: df.withColumn("score", F.lit(1)), ["value"], ["score"]).isStreaming


def test_drift_score_uses_all_columns(spark):
    df = spark.range(20).select(*[(F.col("id") * (k + 1) + 100 * (k >= 10)).cast("double").alias(f"c{k}") for k in range(12)])
    every, ten = monitor.drift_score(df).first()[0], monitor.drift_score(df, first=10).first()[0]
    assert every != pytest.approx(ten)


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("label"))
    counts = {topk.bootstrap_positives(df.repartition(n), "label", ["id"]).count() for n in (1, 4, 8)}
    assert len(counts) == 1 and abs(counts.pop() - 10_000) < 300


def test_segments_and_histograms_of_missing_values(spark):
    df = spark.createDataFrame([(1.0, 0), (3.0, 1), (None, 1), (5.0, None)], "amount double, label int")
    got = {(r["amount"], r["segment"]) for r in aggregates.median_segments(df, "amount").collect()}
    assert got == {(1.0, "low"), (3.0, "high"), (5.0, "high"), (None, None)}
    rows = stats.class_histogram(df, "amount", "label", buckets=2).collect()
    assert sorted(((r["label"], r["count"]) for r in rows), key=repr) == [(0, 1), (1, 1), (None, 1)]
    assert stats.class_histogram(df.filter("amount IS NULL"), "amount", "label").collect() == []


@pytest.mark.parametrize("bad", [(10, 3, 0), (10, 3, -1), (100, 0, 5)])
def test_fold_bounds_refuse_what_they_cannot_give(bad):
    with pytest.raises(ValueError):
        splits.expanding_bounds(*bad)
    with pytest.raises(ValueError):
        splits.expanding_bounds(100, 2, 10, gap=-1)


@pytest.fixture
def ends(spark):
    return spark.createDataFrame([("a", "b"), ("a", None), (None, "b"), ("c", None)], "source string, target string")


def test_fan_degrees_keep_rows_with_unknown_ends(ends):
    got = sorted(map(tuple, graph.fan_degrees(ends).collect()), key=repr)
    assert got == sorted([("a", "b", 1, 1), ("a", None, 1, None), (None, "b", None, 1), ("c", None, 0, None)], key=repr)


def test_ports_and_edges_keep_rows_with_unknown_ends(spark, ends):
    rows = ends.select("*", F.monotonically_increasing_id().alias("i"), F.lit(START).cast("timestamp_ntz").alias("timestamp"))
    assert graph.ports(rows, tiebreak=["i"]).count() == 4
    table = rows.select(
        "i", "source", "target", "timestamp", F.when(F.col("i") % 2 == 0, 1).alias("from_bank"), F.lit(2).alias("to_bank"), F.lit(1.0).alias("amount"),
        F.when(F.col("i") > 0, F.lit("Cheque")).alias("payment_format"), F.lit(0).alias("is_fraud"),
    )
    assert graph.edge_table(table, ["i"]).count() == 4
