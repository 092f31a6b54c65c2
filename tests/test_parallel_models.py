"""Fits at the same time and the isotonic fit in ranges, against direct computation."""

import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk.operators import models, splits, windows


def max_min(points):
    """The isotonic fit by its formula: the largest, over starts, of the least mean up to an end."""
    n = len(points)
    mean = lambda i, j: sum(t for _, t, _ in points[i : j + 1]) / sum(w for *_, w in points[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def spread(blocks, points):
    return [next(t / w for a, b, t, w in blocks if a <= s <= b) for s, *_ in points]


def made_points(seed, n=60):
    rng = random.Random(seed)
    return [(float(s), float(rng.randrange(w + 1)), float(w)) for s in range(n) for w in [rng.randrange(1, 9)]]


@pytest.mark.parametrize("seed", range(4))
def test_pooling_is_the_isotonic_fit(seed):
    points = made_points(seed)
    blocks = models.pool_blocks(np.array([(s, s, t, w) for s, t, w in points]))
    assert spread(blocks.tolist(), points) == pytest.approx(max_min(points))
    values = blocks[:, 2] / blocks[:, 3]
    assert (np.diff(values) > 0).all() and blocks[:, 3].sum() == sum(w for *_, w in points)


@pytest.mark.parametrize("fan", [2, 16])
def test_ranges_merge_to_the_same_blocks(spark, fan, monkeypatch):
    monkeypatch.setattr(models, "FAN_IN", fan)
    points = made_points(9, 300)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = models.isotonic_blocks(spark.createDataFrame(points, "score double, total double, weight double").repartition(5)).orderBy("first").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = models.pool_blocks(np.array([(s, s, t, w) for s, t, w in points]))
    assert [tuple(r) for r in found] == [tuple(b) for b in want.tolist()]


def test_calibration_of_odd_rows(spark):
    rows = [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (None, 1), (float("nan"), 0), (0.5, None)]
    df = spark.createDataFrame(rows, "s double, y int")
    model = models.fit_calibration(df, "s", "y")
    assert model.scores == [0.1, 0.2, 0.3, 0.4] and model.values == [0.0, 0.5, 0.5, 1.0]
    got = [r["p"] for r in models.apply_calibration(model, spark.createDataFrame([(0.0,), (0.15,), (0.25,), (0.9,), (None,)], "s double"), "s", "p").collect()]
    assert got == [0.0, pytest.approx(0.25), 0.5, 1.0, None]
    with pytest.raises(ValueError, match="no row"):
        models.fit_calibration(df.limit(0), "s", "y")


def test_jobs_run_at_once_and_keep_their_order(spark):
    together, gate = [], threading.Barrier(3, timeout=60)

    def job(k):
        gate.wait()  # passes only if three run together
        together.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        return spark.range(k + 1).count()

    assert models.at_once(spark, [lambda k=k: job(k) for k in range(6)], 3) == [1, 2, 3, 4, 5, 6]
    assert set(together) == {"fit-0", "fit-1", "fit-2"}

    def fails():
        raise KeyError("this one")

    with pytest.raises(KeyError, match="this one"):
        models.at_once(spark, [lambda: time.sleep(0.1), fails, lambda: 1], 2)


def test_folds_fitted_together_are_those_fitted_in_turn(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, float(y), rng.gauss(y, 1.0)) for i in range(400) for y in [rng.random() < 0.4]], "t int, y double, x double")
    bounds = splits.series_bounds(400, 2)
    each = [sorted(map(str, models.fit_folds(df, ["x"], "y", "logistic", bounds, ["t"], parallel=p).collect())) for p in (1, 3)]
    assert each[0] == each[1] and len(each[0]) == 4


def test_counts_of_several_key_sets_in_one_pass(spark):
    rows = [(1, "a", 5), (1, "b", None), (1, "a", 7), (2, "a", None), (None, "b", 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "k int, z string, v int")
    out = windows.group_sizes(df, {"n_k": (["k"], None), "n_z": (["z"], "v"), "n_both": (["k", "z"], None)})
    want = windows.group_size(windows.group_size(windows.group_size(df, ["k"], "n_k"), ["z"], "n_z", "v"), ["k", "z"], "n_both")
    assert out.columns == want.columns and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, out.select("n_k").collect())) == sorted(map(str, df.withColumn("n_k", F.when(F.col("k") == 1, 3).when(F.col("k") == 2, 1).otherwise(2)).select("n_k").collect()))
