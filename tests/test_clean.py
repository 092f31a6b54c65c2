import math

import pytest
from pyspark.sql import functions as F

from txnrisk.functions import labels, numeric
from txnrisk.functions.hashing import table_hash
from txnrisk.operators import clean, setops

INF, NAN = float("inf"), float("nan")


def test_clean_data_drops_duplicates_and_fills_numbers(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, 1.0, "a"), (2, None, None), (3, INF, "c"), (None, NAN, "d")], "i int, x double, s string")
    got = sorted(clean.clean_data(df).collect(), key=lambda r: (r["i"], str(r["s"])))
    assert [(r["i"], r["x"], r["s"]) for r in got] == [(0, 0.0, "d"), (1, 1.0, "a"), (2, 0.0, None), (3, 0.0, "c")]


def test_text_amounts_are_coerced(spark):
    df = spark.createDataFrame([("5.5", 1), ("x", 1), ("-1", 1), ("0", 1), (None, 1), ("7", None)], "amount string, timestamp int")
    assert [r["amount"] for r in clean.clean_transaction_data(df).collect()] == [5.5]


def test_required_columns(spark):
    df = spark.createDataFrame([(1.0,)], "amount double")
    with pytest.raises(ValueError, match="currency"):
        clean.validate_compliance(df, ["amount", "currency"])


def test_validation_findings(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 4.0)], "a int, b double")
    found = {(r["level"], r["finding"], r["column"]): r["value"] for r in clean.validate_frame(df, ["c"], 5).collect()}
    assert found[("error", "too_few_rows", None)] == 3
    assert ("error", "missing_column", "c") in found
    assert found[("warning", "null_percentage", None)] == pytest.approx(100 * 2 / 6)
    assert found[("warning", "mostly_null", "b")] == pytest.approx(2 / 3)
    assert [r["finding"] for r in clean.validate_frame(df.limit(0)).collect()] == ["empty"]


def test_target_validation(spark):
    one = clean.validate_class_target(spark.createDataFrame([(1,), (1,)], "y int"), "y").first()
    assert (one["is_valid"], one["n_classes"]) == (False, 1)
    rare = clean.validate_class_target(spark.createDataFrame([(1,)] + [(0,)] * 200, "y int"), "y").first()
    assert rare["is_valid"] and rare["is_imbalanced"]
    flat = clean.validate_numeric_target(spark.createDataFrame([(2.0,), (2.0,)], "y double"), "y").first()
    assert not flat["is_valid"]


def test_median_imputation_and_all_null_column(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double")
    assert sorted(r["a"] for r in clean.impute_median(df, ["a", "b"]).collect()) == [1.0, 2.5, 4.0]
    assert {r["b"] for r in clean.impute_median(df, ["a", "b"]).collect()} == {0.0}


def test_infinity_helpers(spark):
    df = spark.createDataFrame([(INF,), (-INF,), (NAN,), (None,), (3.0,)], "x double")
    assert [r["x"] for r in clean.replace_infinite(df, ["x"]).collect()] == [1e10, -1e10, 0.0, 0.0, 3.0]
    assert [r["x"] for r in clean.clamp_features(df, ["x"]).collect()] == [10.0, -10.0, 0.0, 0.0, 3.0]


def test_alignment_adds_zero_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "b double, a double")
    out = clean.align_columns(df, ["a", "missing", "b"])
    assert out.columns == ["a", "missing", "b"] and out.first() == (2.0, 0.0, 1.0)


def test_labels(spark):
    df = spark.createDataFrame([(0.29,), (0.3,), (0.6,), (0.85,)], "s double")
    out = clean.decide(df, "s", 0.6).collect()
    assert [r["risk_level"] for r in out] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert [r["prediction"] for r in out] == [0, 0, 1, 1]
    assert out[0]["confidence"] == pytest.approx(0.71)
    ivs = spark.createDataFrame([(0.01,), (0.02,), (0.1,), (0.3,), (0.5,)], "v double").select(labels.iv_strength(F.col("v")).alias("l"))
    assert [r["l"] for r in ivs.collect()] == ["Not predictive", "Weak", "Medium", "Strong", "Very strong"]


def test_numeric_helpers(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (4.0, 2.0, 1.0)], "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    out = df.select(numeric.safe_divide(cols[0], cols[1], -1.0).alias("d"), numeric.row_mean(cols).alias("m"), numeric.row_max(cols).alias("x")).collect()
    assert [(r["d"], r["m"], r["x"]) for r in out] == [(-1.0, 0.5, 1.0), (2.0, 7 / 3, 4.0)]
    odds = spark.range(1).select(numeric.log_odds(F.lit(3), F.lit(1), F.lit(10), F.lit(20)).alias("w"), numeric.log_odds(F.lit(0), F.lit(10**9), F.lit(10), F.lit(10**9)).alias("c")).first()
    assert odds["w"] == pytest.approx(math.log((3.5 / 11) / (1.5 / 21))) and odds["c"] == pytest.approx(math.log((0.5 / 11) / ((10**9 + 0.5) / (10**9 + 1))))


def test_table_hash_ignores_order_but_not_repeats(spark):
    df = spark.range(50).withColumn("s", F.col("id").cast("string"))
    a, b = table_hash(df).first(), table_hash(df.orderBy(F.col("id").desc())).first()
    assert a == b
    assert table_hash(df.union(df.limit(1))).first() != a


def test_duplicate_report(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (2, "b")], "i int, s string")
    assert setops.duplicate_report(df).first() == (5, 3, 2)
