import itertools
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txnrisk.operators import aggregates, encoding, iv, stats


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.3)
        x = rng.randrange(0, 25) + 4 * y
        rows.append((i, y, float(x), rng.choice(["a", "b", None]), float(i % 2), None if i % 9 == 0 else rng.random(), 1.0))
    return rows, spark.createDataFrame(rows, "id int, y int, x double, c string, flag double, g double, const double")


def quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
    return low + (high - low) * (at - int(at))


def expected_iv(rows, column, bins=10, min_samples=10):
    events, others = sum(r[1] for r in rows), sum(1 - r[1] for r in rows)
    known = [r[column] for r in rows if r[column] is not None]
    groups = {}
    if isinstance(known[0], float) and len(set(known)) > bins:
        edges = sorted({quantile(known, i / bins) for i in range(bins + 1)})
        for r in rows:
            if r[column] is not None:
                groups.setdefault(max(1, sum(e < r[column] for e in edges)), []).append(r[1])
    else:
        for r in rows:
            groups.setdefault(r[column], []).append(r[1])
    total = 0.0
    for ys in groups.values():
        if len(ys) >= min_samples:
            a, b = (sum(ys) + 0.5) / (events + 1), (len(ys) - sum(ys) + 0.5) / (others + 1)
            total += (a - b) * max(-5, min(5, math.log(a / b)))
    return min(total, 10.0)


@pytest.mark.parametrize("limit", [10_000, 5])
def test_information_value(sample, limit):
    rows, df = sample
    out = {r["variable"]: r for r in iv.information_value(df, "y", ["x", "c", "flag", "g", "const", "id"], max_unique=399, limit=limit).collect()}
    assert set(out) == {"x", "c", "flag", "g"}, "constants and too many values are left out"
    for name, at in (("x", 2), ("c", 3), ("flag", 4), ("g", 5)):
        assert out[name]["iv"] == pytest.approx(expected_iv(rows, at)), name
    assert out["g"]["is_suspect"] and not out["x"]["is_suspect"]


def test_woe_bins_cover_every_row_once(sample):
    rows, df = sample
    out = iv.weight_of_evidence(df, "y", "x").collect()
    assert sum(r["events"] + r["others"] for r in out) == len(rows)
    missing = [r for r in iv.weight_of_evidence(df, "y", "c").collect() if r["label"] == iv.MISSING]
    assert missing[0]["events"] + missing[0]["others"] == sum(r[3] is None for r in rows)


def test_repeated_edges_fall_together(spark):
    df = spark.createDataFrame([(float(max(0, i - 80)), i % 2) for i in range(100)], "x double, y int")
    bins = iv.weight_of_evidence(df, "y", "x").collect()
    assert sum(r["events"] + r["others"] for r in bins) == 100 and len(bins) < 10


def test_monotonic_woe(spark):
    rows = [(float(i), float((i * 7919) % 100), int(i > 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "rising double, mixed double, y int")
    got = {r["variable"]: r["is_monotonic"] for r in iv.is_monotonic(df, "y", ["rising", "mixed"]).collect()}
    assert got == {"rising": True, "mixed": False}


@pytest.mark.parametrize("limit", [10_000, 4])
def test_ks_and_rank_sum(sample, limit):
    rows, df = sample
    one, zero = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    want = max(abs(sum(v <= t for v in one) / len(one) - sum(v <= t for v in zero) / len(zero)) for t in set(one + zero))
    ks = stats.ks_two_sample(df, ["x"], "y", limit).first()
    assert ks["ks"] == pytest.approx(want) and 0 <= ks["p_value"] < 0.1
    u = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(one, zero))
    mw = stats.mann_whitney(df, ["x"], "y", limit).first()
    assert mw["u"] == u
    n1, n0 = len(one), len(zero)
    n = n1 + n0
    ties = sum(t**3 - t for t in (sum(v == x for v in one + zero) for x in set(one + zero)))
    sd = math.sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert mw["z"] == pytest.approx((abs(u - n1 * n0 / 2) - 0.5) / sd)
    assert mw["p_value"] == pytest.approx(math.erfc(abs(mw["z"]) / math.sqrt(2)))


def test_equal_samples_have_no_distance(spark):
    df = spark.createDataFrame([(float(i // 2), i % 2) for i in range(40)], "x double, y int")
    row = stats.ks_two_sample(df, ["x"], "y").first()
    assert row["ks"] == 0.0 and row["p_value"] == 1.0


def test_cohens_d(sample):
    rows, df = sample
    one, zero = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    pooled = math.sqrt((statistics.stdev(one) ** 2 + statistics.stdev(zero) ** 2) / 2)
    got = {r["column"]: r["d"] for r in stats.cohens_d(df, ["x", "const"], "y").collect()}
    assert got["x"] == pytest.approx((statistics.mean(one) - statistics.mean(zero)) / pooled) and got["const"] == 0.0


def test_correlation_uses_pairwise_complete_rows(sample):
    rows, df = sample
    got = {(r["a"], r["b"]): r["r"] for r in stats.correlation_matrix(df, ["x", "g", "flag", "const"]).collect()}
    both = [(r[2], r[5]) for r in rows if r[5] is not None]
    assert got[("x", "g")] == pytest.approx(statistics.correlation(*zip(*both)))
    assert got[("x", "flag")] == pytest.approx(statistics.correlation([r[2] for r in rows], [r[4] for r in rows]))
    assert got[("flag", "const")] is None


def test_bias_corrected_moments(spark):
    values = [1.0, 2.0, 2.0, 3.0, 9.0]
    row = aggregates.distribution_summary(spark.createDataFrame([(v,) for v in values], "x double"), ["x"]).first()
    n, m = len(values), statistics.mean(values)
    m2, m3, m4 = (sum((v - m) ** k for v in values) / n for k in (2, 3, 4))
    g1, g2 = m3 / m2**1.5, m4 / m2**2 - 3
    assert row["skewness"] == pytest.approx(math.sqrt(n * (n - 1)) / (n - 2) * g1)
    assert row["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def test_single_row_group_has_no_deviation(spark):
    df = spark.createDataFrame([("a", 5.0, 1)], "source string, amount double, is_fraud int")
    assert aggregates.entity_profile(df, "source").first()["amount_std"] is None


def test_scalers_and_encoders(spark, tmp_path):
    df = spark.createDataFrame([("u", 1.0, 5.0), ("u", 2.0, 5.0), ("v", 10.0, 5.0), (None, 3.0, 5.0)], "c string, x double, k double")
    assert encoding.robust_params(df, ["x", "k"]) == {"x": (2.5, pytest.approx(3.0)), "k": (5.0, 1.0)}
    assert encoding.min_max_params(df, ["k"]) == {"k": (5.0, 1.0)}
    fitted = encoding.FeatureEncoder(["c"], ["x"]).fit(df)
    assert sorted(r["c"] for r in fitted._encode(df).collect()) == pytest.approx(sorted([2 / 3, 2 / 3, 1 / 3, 0.5]))
    fitted.save(spark, str(tmp_path / "enc"))
    again = encoding.FeatureEncoder.load(spark, str(tmp_path / "enc"), ["c"], ["x"])
    new = spark.createDataFrame([("unseen", 4.0, 1.0)], df.schema)
    assert again.transform(new).first() == fitted.transform(new).first()


def test_outliers_and_principal_components(sample):
    rows, df = sample
    values = [r[2] for r in rows]
    q1, q3 = quantile(values, 0.25), quantile(values, 0.75)
    row = stats.iqr_outliers(df, ["x"], 0.5).first()
    low, high = q1 - 0.5 * (q3 - q1), q3 + 0.5 * (q3 - q1)
    assert row["outliers"] == sum(v < low or v > high for v in values)
    pcs = stats.principal_components(df.select("y", "x", "flag"), ["x", "flag"], "y").orderBy("component").collect()
    assert pcs[-1]["cumulative"] == pytest.approx(1.0)
    assert stats.leakage_screen(df.withColumn("split", F.when(F.col("y") == 1, "test").otherwise("train")), ["x"], "split").first()["is_leaky"]


def test_correlations_of_many_columns_with_nulls(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 5))
    wide = np.concatenate([base @ rng.normal(size=(5, 58)) + rng.normal(size=(400, 58)) + 1e6, np.full((400, 1), 7.7), np.full((400, 1), 0.1)], 1)
    wide[rng.random(wide.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(60)]
    frame = pd.DataFrame(wide, columns=names)
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in wide.tolist()], ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r["a"], r["b"]): r["r"] for r in stats.correlation_matrix(df, names).collect()}
    want = frame.corr()
    assert len(got) == 60 * 59 // 2
    for (a, b), r in got.items():
        if "c58" in (a, b) or "c59" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_correlations_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 2.0, nan, None, 5.0), (2.0, 4.0, 1.0, None, 5.0), (3.0, 6.5, 2.0, None, 6.0), (None, 1.0, inf, None, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = {(r["a"], r["b"]): r["r"] for r in stats.correlation_matrix(df, list("abcde")).collect()}
    assert got["a", "b"] == pytest.approx(0.9979487, abs=1e-6) and got["a", "d"] is None and math.isnan(got["b", "c"]) and math.isnan(got["a", "c"])
    assert set(r["r"] for r in stats.correlation_matrix(df.limit(0), list("ab")).collect()) == {None}
    assert stats.correlation_matrix(df, ["a"]).count() == 0
