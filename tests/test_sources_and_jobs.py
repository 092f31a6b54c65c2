import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk import session
from txnrisk.operators import models, monitor, splits
from txnrisk.sources import pattern_files, readers, writers
from txnrisk.streaming import jobs

PATTERNS = """BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 2-degree Fan-Out
2022/09/01 00:06,021,A1,012,B1,2848.96,Euro,2848.96,Euro,ACH,1
2022/09/01 04:33,021,A1,020,B2,8630.40,Euro,8630.40,Euro,ACH,1
bad line
END LAUNDERING ATTEMPT - FAN-OUT

BEGIN LAUNDERING ATTEMPT - CYCLE:  Max 2 hops
2022/09/02 10:00,001,C1,002,C2,100.00,US Dollar,100.00,US Dollar,Wire,1
2022/09/02 11:00,002,C2,001,C1,100.00,US Dollar,100.00,US Dollar,Wire,1
END LAUNDERING ATTEMPT - CYCLE
2022/09/02 12:00,002,C2,001,C1,1.00,US Dollar,1.00,US Dollar,Wire,1
"""


@pytest.fixture()
def pattern_path(tmp_path):
    path = tmp_path / "patterns.txt"
    path.write_text(PATTERNS)
    return str(path)


def test_pattern_file_by_header_text(spark, pattern_path):
    out = pattern_files.read_patterns(spark, pattern_path).orderBy("timestamp").collect()
    assert [r["pattern_type"] for r in out] == ["FAN-OUT", "FAN-OUT", "CYCLE", "CYCLE"]
    assert out[0]["timestamp"] == dt.datetime(2022, 9, 1, 0, 6) and out[0]["from_bank"] == "021"
    assert len({r["block"] for r in out}) == 2


@pytest.mark.parametrize("limit", [10_000, 2])
def test_pattern_blocks_of_any_size_are_spread(spark, pattern_path, limit):
    lines = pattern_files.pattern_lines(spark, pattern_path, limit)
    assert {r["block"]: r["count"] for r in lines.groupBy("block").count().collect()} == {1: 3, 2: 2}


def test_pattern_blocks_by_regex(spark, pattern_path):
    out = pattern_files.read_pattern_blocks(spark, pattern_path).orderBy("timestamp").collect()
    assert [(r["type"], r["characteristics"]) for r in out][::2] == [("FAN", "-OUT:  Max 2-degree Fan-Out"), ("CYCLE", "Max 2 hops")]


def test_block_without_end(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text(PATTERNS.replace("END LAUNDERING ATTEMPT - FAN-OUT\n", ""))
    assert pattern_files.read_patterns(spark, str(path)).count() == 4
    assert {r["type"] for r in pattern_files.read_pattern_blocks(spark, str(path)).collect()} == {"CYCLE"}


def test_unknown_types_are_told_apart_in_the_full_column(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text(PATTERNS.replace("FAN-OUT:", "FAN-IN:").replace("CYCLE:", "SCATTER-GATHER:"))
    got = {(r["pattern_type"], r["pattern_type_full"]) for r in pattern_files.read_patterns(spark, str(path)).collect()}
    assert got == {("UNKNOWN", "FAN-IN"), ("UNKNOWN", "SCATTER-GATHER")}


def test_raw_transactions_with_repeated_header(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
        "2022/09/01 00:20,010,A,011,B,5.5,Euro,6.5,US Dollar,Wire,1\nnot a date,010,A,011,B,1,Euro,2,Euro,Cash,0\n"
    )
    good, bad = readers.read_transactions(spark, str(path)).orderBy(F.col("amount").desc()).collect()
    assert (good["source"], good["target"], good["amount"], good["is_fraud"]) == ("A", "B", 6.5, 1)
    assert good["timestamp"] == dt.datetime(2022, 9, 1, 0, 20) and bad["timestamp"] is None


def test_json_split_picks_columns_by_name(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"columns": ["b", "a"], "index": [0, 1], "data": [["x", 1], ["y", null]]}')
    (tmp_path / "b.json").write_text('{"columns": ["a"], "index": [0], "data": [[7]]}')
    schema = T.StructType().add("a", T.IntegerType()).add("b", T.StringType())
    got = {(r["a"], r["b"]) for r in readers.read_json_split(spark, str(tmp_path), schema).collect()}
    assert got == {(1, "x"), (None, "y"), (7, None)}


def test_json_records_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_json_records(spark, str(tmp_path / "a.json"), T.StructType().add("a", T.IntegerType())).count() == 2


def test_suffix_loader_falls_back_and_refuses(spark, tmp_path):
    schema = T.StructType().add("a", T.IntegerType())
    spark.createDataFrame([(1,)], schema).write.option("header", True).csv(str(tmp_path / "processed" / "t.csv"))
    assert readers.load_by_suffix(spark, "t.csv", str(tmp_path / "raw"), str(tmp_path / "processed"), schema).count() == 1
    with pytest.raises(ValueError, match="reader"):
        readers.load_by_suffix(spark, "t.xlsx", str(tmp_path), str(tmp_path), schema)


def test_database_arguments(spark):
    with pytest.raises(ValueError):
        readers.read_database(spark, "jdbc:sqlite:x", table="t", query="q")


def test_prediction_sink_keeps_other_dates(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "id int, score double")
    for day in ("2024-01-01", "2024-01-02"):
        writers.write_predictions(df, str(tmp_path / "p"), day)
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).count() == 2


def test_checkpoint_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir").replace("file:", "file:")) or "checkpoints" in session.shared_dir(spark)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, float(i % 17), float(i % 5), int(i % 17 > 11)) for i in range(300)]
    return spark.createDataFrame(rows, "id int, a double, b double, y int")


def test_models_learn_and_survive_saving(spark, labelled, tmp_path):
    model = models.train(labelled, ["a", "b"], "y", "random_forest", numTrees=5, maxDepth=3)
    scored = models.score(model, labelled)
    hits = scored.filter(F.col("prediction") == F.col("y")).count()
    assert hits == 300
    models.save_model(model, str(tmp_path / "m"), 0.3, {"auc": 1.0})
    saved = models.load_model(str(tmp_path / "m"))
    assert saved.threshold == 0.3 and saved.metrics == {"auc": 1.0}
    again = models.score(saved.model, labelled)
    assert scored.select("id", "probability").exceptAll(again.select("id", "probability")).count() == 0
    with pytest.raises(ValueError, match="unknown model"):
        models.train(labelled, ["a"], "y", "oracle")


def test_permutation_importance_finds_the_column_that_matters(labelled):
    model = models.train(labelled, ["a", "b"], "y", "random_forest", numTrees=5, maxDepth=3)
    drop = {r["variable"]: r["drop"] for r in models.permutation_importance(model, labelled, ["a", "b"], "y", ["id"], ["id"]).collect()}
    assert drop["a"] > 0.2 and abs(drop["b"]) < 0.05


def test_search_is_seeded_and_ranks(labelled):
    assert models.candidates("logistic", 3) == models.candidates("logistic", 3)
    out = models.search(labelled, ["a", "b"], "y", "logistic", splits.series_bounds(300, 2), ["id"], n=2).collect()
    assert sorted(r["rank"] for r in out) == [1, 2]


def test_folds_report_train_and_test(labelled):
    out = models.fit_folds(labelled, ["a", "b"], "y", "logistic", splits.series_bounds(300, 2), ["id"])
    assert {(r["fold"], r["role"]) for r in out.collect()} == {(0, "train"), (0, "test"), (1, "train"), (1, "test")}
    found = {r["metric"]: r for r in models.summarise_folds(out).collect()}
    assert set(found) == {*models.THRESHOLD_METRICS, *models.RANK_METRICS, "overall"}
    assert all(r["n_folds"] == 2 and abs(r["overfit"] - r["train_mean"] + r["test_mean"]) < 1e-9 for r in found.values())


def test_calibration_is_monotone_and_clipped(spark):
    fit = spark.createDataFrame([(i / 10, int(i >= 5 or i == 2)) for i in range(2, 9)], "score double, y int")
    model = models.fit_calibration(fit, "score", "y")
    probe = spark.createDataFrame([(0.0,), (0.2,), (0.45,), (0.8,), (1.0,)], "score double")
    got = [r["calibrated"] for r in models.apply_calibration(model, probe, "score").orderBy("score").collect()]
    assert got == sorted(got) and got[0] == got[1] and got[3] == got[4] == 1.0


def test_alert_rules_have_a_direction(spark):
    flat = spark.createDataFrame([(dt.datetime(2024, 1, 1), 0.1, 2000.0, 0.5, 0.02)], "timestamp timestamp_ntz, pr_auc double, latency_ms double, missing_data_rate double, error_rate double")
    assert {r["metric"] for r in monitor.check_alerts(flat, monitor.SERVICE_RULES).collect()} == {"pr_auc", "latency_ms", "missing_data_rate"}
    configured = {r["metric"]: r["level"] for r in monitor.check_alerts(flat, monitor.CONFIGURED_RULES).collect()}
    assert configured["error_rate"] == "critical", "a high error rate alerts"
    low = flat.withColumn("error_rate", F.lit(0.001))
    assert "error_rate" not in {r["metric"] for r in monitor.check_alerts(low, monitor.CONFIGURED_RULES).collect()}


def test_all_zero_scores_raise_an_alert(spark):
    df = spark.createDataFrame([(0.0, int(i % 10 == 0), float(i)) for i in range(100)], "score double, y int, f double")
    record = monitor.metric_record(df, "score", "y", ["f"], F.lit(50.0), F.lit("2024-01-01").cast("timestamp_ntz"))
    assert record.first()["operational"]["throughput_per_second"] == 2000.0
    flat = monitor.flat_record(record)
    assert flat.first()["pr_auc"] == pytest.approx((1 + 0.1) / 2), "one point: halfway between 1 and the prevalence"


def test_drift_needs_enough_values(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(11)], "a double, b double")
    assert monitor.drift_score(df).first()[0] == pytest.approx(5.0 / (3.3166247903554 + 1e-10))
    assert monitor.drift_score(df.limit(5)).first()[0] == 0.0


def test_health_report_without_records(spark):
    schema = "timestamp timestamp_ntz, pr_auc double, latency_ms double, throughput_per_second double"
    none = spark.createDataFrame([], schema)
    assert monitor.health_report(none, none, F.lit("2024-01-01").cast("date")).first()["status"] == "no_data"


def test_window_stream_emits_closed_windows_only(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.window_metric_stream(jobs.read_stream(spark, str(tmp_path / "in"), df.schema), "ts", "value", late="10 minutes")
    jobs.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "progress"), timeout=120)
    got = {r["window_start"]: (r["sample_size"], r["mean_value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["window_start"]: (r["sample_size"], r["mean_value"]) for r in monitor.window_metrics(df, "ts", "value").collect()}
    closed = {w for w in want if w + dt.timedelta(minutes=5) <= rows[-1][0] - dt.timedelta(minutes=10)}
    assert set(got) == closed and all(got[w] == want[w] for w in got)
