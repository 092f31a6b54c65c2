import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import splits

START = dt.datetime(2024, 1, 1)


def frame(spark, times, **more):
    rows = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(times)]
    cols = ", ".join(f"{c} int" for c in more)
    return spark.createDataFrame(rows, "id int, ts timestamp_ntz" + (", " + cols if cols else ""))


@pytest.mark.parametrize("limit", [10_000, 3])
def test_ratio_split_cuts_by_rank(spark, limit):
    df = frame(spark, [START + dt.timedelta(hours=i % 5) for i in range(11)])
    out = splits.ratio_split(df, ["ts", "id"], 0.3, limit=limit).orderBy("ts", "id").collect()
    assert [r["split"] for r in out] == ["train"] * 7 + ["test"] * 4


def test_time_span_split_leaves_gaps(spark):
    df = frame(spark, [START + dt.timedelta(days=i) for i in range(11)])
    out = [r["split"] for r in splits.time_span_split(df, "ts").orderBy("id").collect()]
    assert out == ["train"] * 7 + ["val"] * 2 + ["test"] * 2
    wide = [r["split"] for r in splits.time_span_split(df, "ts", gap_days=3).orderBy("id").collect()]
    assert wide == ["train"] * 7 + [None] * 4, "the gap swallows validation and test"


def test_short_span_uses_no_gap(spark):
    df = frame(spark, [START + dt.timedelta(hours=i) for i in range(11)])
    assert [r["split"] for r in splits.time_span_split(df, "ts").orderBy("id").collect()] == ["train"] * 7 + ["val"] * 2 + ["test"] * 2


def test_validation_finds_overlap(spark):
    df = frame(spark, [START + dt.timedelta(days=i) for i in range(6)], label=[0, 1, 0, 1, 0, 1])
    good = df.withColumn("split", F.when(F.col("id") < 2, "train").when(F.col("id") < 4, "val").otherwise("test"))
    bad = df.withColumn("split", F.when(F.col("id") % 2 == 0, "train").when(F.col("id") < 3, "val").otherwise("test"))
    assert splits.validate_splits(good, "split", "ts", "label").first()["is_ordered"]
    row = splits.validate_splits(bad, "split", "ts", "label").first()
    assert not row["is_ordered"] and row["overlap_val"] == 1


def test_expanding_bounds_skip_empty_training():
    assert splits.expanding_bounds(100, 3, 20) == [(0, 20, 20, 40), (1, 40, 40, 60), (2, 60, 60, 80)]
    assert splits.expanding_bounds(50, 3, 20, 5) == [(2, 5, 10, 30)]


def test_series_bounds_cover_the_end():
    assert splits.series_bounds(10, 4) == [(0, 2, 2, 4), (1, 4, 4, 6), (2, 6, 6, 8), (3, 8, 8, 10)]
    with pytest.raises(ValueError):
        splits.series_bounds(3, 5)


def test_assigned_folds_are_disjoint_and_ordered(spark):
    df = frame(spark, [START + dt.timedelta(hours=i) for i in range(40)])
    out = splits.assign_folds(df, ["ts"], splits.series_bounds(40, 3), limit=7)
    for fold in range(3):
        train = [r["id"] for r in out.filter((F.col("fold") == fold) & (F.col("role") == "train")).collect()]
        test = [r["id"] for r in out.filter((F.col("fold") == fold) & (F.col("role") == "test")).collect()]
        assert len(test) == 10 and max(train) < min(test)


def brute_cuts(counts, shares):
    n = sum(counts)
    best = None
    for i, j in itertools.combinations(range(len(counts)), 2):
        parts = [sum(counts[:i]) / n, sum(counts[i:j]) / n, sum(counts[j:]) / n]
        err = max(abs(p - s) / s for p, s in zip(parts, shares))
        if best is None or err < best[0] - 1e-12:
            best = (err, i, j)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_day_cuts_equal_the_full_pair_search(spark, seed):
    rng = random.Random(seed)
    counts = [rng.choice([0, 0, 1, 2, 5, 9]) for _ in range(rng.randrange(4, 14))]
    counts[0], counts[-1] = 1, 2
    times = [START + dt.timedelta(days=d, hours=h) for d, c in enumerate(counts) for h in range(c)]
    shares = (0.6, 0.2, 0.2) if seed % 2 else (0.5, 0.3, 0.2)
    row = splits.best_day_cuts(frame(spark, times), "ts", shares).first()
    err, i, j = brute_cuts(counts, shares)
    assert row["error"] == pytest.approx(err)
    assert (row["val_start_day"], row["test_start_day"]) == (i, j)


def test_cumulative_views_grow(spark):
    df = spark.createDataFrame([("train",), ("val",), ("test",), (None,)], "split string")
    got = {r["view"]: r["count"] for r in splits.cumulative_views(df, "split").groupBy("view").count().collect()}
    assert got == {"train": 1, "train_val": 2, "all": 3}


@pytest.mark.parametrize("limit", [10_000, 10])
def test_stratified_split_keeps_class_shares(spark, limit):
    df = spark.range(200).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    out = splits.stratified_split(df, "label", ["id"], ["id"], limit=limit)
    got = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert got == {(0, "train"): 108, (0, "val"): 36, (0, "test"): 36, (1, "train"): 12, (1, "val"): 4, (1, "test"): 4}
    again = splits.stratified_split(df.repartition(7), "label", ["id"], ["id"], limit=limit)
    assert out.exceptAll(again).count() == 0


def test_stratified_folds_balance_classes(spark):
    df = spark.range(103).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    sizes = splits.stratified_folds(df, "label", ["id"], 5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        n = [r["count"] for r in sizes if r["label"] == label]
        assert len(n) == 5 and max(n) - min(n) <= 1
