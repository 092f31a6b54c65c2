"""Metrics against direct computation on small frames with many tied scores."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import evaluate as ev


def make(spark, seed, n=120, levels=9):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(levels + 1) / levels
        rows.append((i, s, int(rng.random() < 0.1 + 0.5 * s), "a" if i % 3 else "b"))
    return rows, spark.createDataFrame(rows, "id int, score double, label int, model string")


def points(rows):
    """(threshold, tp, fp) at each distinct score, highest first."""
    out = []
    for t in sorted({r[1] for r in rows}, reverse=True):
        picked = [r for r in rows if r[1] >= t]
        out.append((t, sum(r[2] for r in picked), sum(1 - r[2] for r in picked)))
    return out


def expected(rows):
    pos = sum(r[2] for r in rows)
    ap = trapezoid = prev_r = 0.0
    prev_p = 1.0
    for _, tp, fp in points(rows):
        p, r = tp / (tp + fp), tp / pos
        ap += (r - prev_r) * p
        trapezoid += (r - prev_r) * (p + prev_p) / 2
        prev_p, prev_r = p, r
    pairs = [(a[1], b[1]) for a, b in itertools.product([r for r in rows if r[2]], [r for r in rows if not r[2]])]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    return ap, trapezoid, auc


@pytest.mark.parametrize("limit", [10_000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_areas(spark, seed, limit):
    rows, df = make(spark, seed)
    row = ev.ranking_metrics(df, "score", "label", limit=limit).first()
    assert (row["average_precision"], row["pr_auc"], row["roc_auc"]) == pytest.approx(expected(rows))
    assert 0 <= row["average_precision"] <= 1
    turned = ev.ranking_metrics(df.withColumn("score", 1 - F.col("score")), "score", "label").first()
    assert turned["roc_auc"] == pytest.approx(1 - row["roc_auc"])


def test_areas_by_key(spark):
    rows, df = make(spark, 3)
    got = {r["model"]: (r["average_precision"], r["pr_auc"], r["roc_auc"]) for r in ev.ranking_metrics(df, "score", "label", ["model"], limit=3).collect()}
    for m in ("a", "b"):
        assert got[m] == pytest.approx(expected([r for r in rows if r[3] == m]))


def test_single_class_gives_no_roc_area(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 0)], "score double, label int")
    row = ev.ranking_metrics(df, "score", "label").first()
    assert row["roc_auc"] is None and row["average_precision"] == 0.0
    c = ev.confusion(df, "score", "label").first()
    assert (c["precision"], c["recall"], c["f1"]) == (0.0, 0.0, 0.0)


def test_youden_prefers_the_highest_threshold(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.6, 0), (0.6, 0)], "score double, label int")
    row = ev.youden(ev.curve(df, "score", "label")).first()
    assert row["optimal_threshold"] == 0.8 and row["j_score"] == pytest.approx(2 / 3)


@pytest.mark.parametrize("limit", [10_000, 11])
def test_at_k_clamps_and_breaks_ties_by_key(spark, limit):
    rows, df = make(spark, 4)
    got = {r["k"]: (r["hits"], r["precision"], r["recall"]) for r in ev.metrics_at_k(df, "score", "label", [5, 50, 999, 500], ["id"], limit=limit).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    pos = sum(r[2] for r in rows)
    assert set(got) == {5, 50, 120}
    for k, (hits, p, r) in got.items():
        want = sum(x[2] for x in order[:k])
        assert (hits, p, r) == (want, pytest.approx(want / k), pytest.approx(want / pos))


@pytest.mark.parametrize("limit", [10_000, 11])
def test_alert_efficiency_walks_the_ranking(spark, limit):
    rows, df = make(spark, 5)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    pos = sum(r[2] for r in rows)
    for r in ev.alert_efficiency(df, "score", "label", ["id"], limit=limit).collect():
        found = alerts = 0
        for x in order:
            alerts += 1
            found += x[2]
            if found >= int(pos * r["level"]):
                break
        assert (r["n_alerts"], r["achieved"]) == (alerts, pytest.approx(found / pos))


@pytest.mark.parametrize("keys", [[], ["model"]])
def test_share_cuts(spark, keys):
    rows, df = make(spark, 6)
    out = ev.metrics_at_share(df, "score", "label", ["id"], [0.001, 0.25], keys, limit=13).collect()
    for r in out:
        mine = [x for x in rows if not keys or x[3] == r["model"]]
        k = max(1, int(len(mine) * r["share"]))
        want = sum(x[2] for x in sorted(mine, key=lambda x: (-x[1], x[0]))[:k])
        assert (r["k"], r["hits"]) == (k, want)


def test_threshold_table_and_cost_curve_agree(spark):
    rows, df = make(spark, 7)
    at = {r["threshold"]: r for r in ev.threshold_table(df, "score", "label", [1 / 9, 0.5], fp_cost=1, fn_cost=10).collect()}
    for t, r in at.items():
        tp = sum(x[2] for x in rows if x[1] >= t)
        fp = sum(1 - x[2] for x in rows if x[1] >= t)
        assert (r["tp"], r["fp"]) == (tp, fp)
        assert r["total_cost"] == fp + 10 * (sum(x[2] for x in rows) - tp)
    curve = {r["threshold"]: r["total_cost"] for r in ev.cost_curve(ev.curve(df, "score", "label"), 1, 10).collect()}
    assert curve[1 / 9] == at[1 / 9]["total_cost"]


def test_model_choice_reasons(spark):
    schema = "model string, recall double, compliant boolean"
    none = spark.createDataFrame([("a", 0.5, False), ("b", 0.7, False)], schema)
    one = spark.createDataFrame([("a", 0.5, True), ("b", 0.7, False)], schema)
    two = spark.createDataFrame([("a", 0.5, True), ("b", 0.7, True)], schema)
    got = [(r["model"], r["reason"]) for r in (ev.choose_model(t).first() for t in (none, one, two))]
    assert got == [("b", "fallback_recall"), ("a", "unique_compliant"), ("b", "best_recall_among_compliant")]


def test_calibration_tables(spark):
    df = spark.createDataFrame([(0.0, 0), (0.05, 1), (1.0, 1), (0.95, 0)], "score double, label int")
    table = ev.reliability(df, "score", "label")
    assert {r["bin"]: r["n"] for r in table.collect()} == {0: 2, 9: 2}
    assert ev.expected_calibration_error(table).first()["ece"] == pytest.approx((abs(0.025 - 0.5) + abs(0.975 - 0.5)) / 2)
    assert ev.brier(df, "score", "label").first()["brier"] == pytest.approx((0 + 0.95**2 + 0 + 0.95**2) / 4)


def test_segment_parity_skips_small_segments(spark):
    rows = [(i % 2, (i % 10) / 10, int(i % 10 > 5), "x" if i < 80 else "tiny") for i in range(90)]
    df = spark.createDataFrame(rows, "a int, score double, label int, seg string")
    row = ev.segment_parity(df, "seg", "score", "label").first()
    assert row["segments"] == 1 and row["verdict"] == "FAIR"


def test_comparison_normalisation(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "m string, v double")
    assert {r["m"]: r["v"] for r in ev.normalise_columns(df, ["v"]).collect()} == {"a": 0.0, "b": 1.0, "c": 0.5}
    assert {r["m"]: r["v"] for r in ev.normalise_columns(df, ["v"], "max").collect()} == pytest.approx({"a": 1 / 3, "b": 1.0, "c": 2 / 3})
