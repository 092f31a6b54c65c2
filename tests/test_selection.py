"""Cuts by counting, bracketed quantiles, bins on the scan and block-joined moving frames against direct computation."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txnrisk.operators import iv, ordering, quantiles, selection, splits, topk, windows

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def scored(spark):
    """One key holds most rows, one score most of its rows; nulls, NaN and infinities among the scores."""
    rng = random.Random(11)
    rows = []
    for i in range(1200):
        s = rng.choice([None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0]) if i % 40 == 0 else rng.choice([0.5, 0.5, 0.5, rng.random()])
        rows.append((i, "big" if i % 4 else rng.choice(["small", "tiny", None]), s, START + dt.timedelta(days=rng.randrange(9)), int(rng.random() < 0.2)))
    return spark.createDataFrame(rows, "id int, k string, s double, t timestamp_ntz, y int").repartition(5)


@pytest.mark.parametrize(("inside", "cells", "limit"), [(0, 20_000, 20), (20_000, 0, 100), (0, 0, 1_000_000)])
@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("descending", [False, True])
def test_cuts_agree_with_ranks(scored, keys, descending, inside, cells, limit, monkeypatch):
    monkeypatch.setattr(quantiles, "ALL_INSIDE", inside)
    monkeypatch.setattr(quantiles, "DRIVER_CELLS", cells)
    order = [F.col("s").desc() if descending else F.col("s").asc(), "id"]
    cuts = [F.lit(0), F.lit(1), F.floor(F.col("n") * 0.3), F.floor(F.col("n") * 0.31), F.col("n") - 1, F.col("n"), F.col("n") + 5]
    lead = selection.leading_number(scored, "s", descending)
    got = {r["id"]: r["cut"] for r in selection.cut_ranks(scored, keys, order, lead, cuts, limit=limit).collect()}
    spec = Window.partitionBy(*(keys or [F.lit(0)]))
    passed = [(F.row_number().over(spec.orderBy(*order)) > c).cast("int") for c in cuts]
    ranks = scored.withColumn("n", F.count(F.lit(1)).over(spec)).withColumn("want", sum(passed, F.lit(0)))
    assert got == {r["id"]: r["want"] for r in ranks.collect()} and len(got) == 1200


def test_cuts_of_times_texts_and_empty_tables(spark, scored):
    cut = [F.lit(100), F.lit(101)]
    lead = selection.leading_number(scored, "t")
    got = {r["id"]: r["cut"] for r in selection.cut_ranks(scored, [], ["t", "id"], lead, cut, limit=30).collect()}
    order = [r["id"] for r in scored.orderBy("t", "id").collect()]
    assert [got[i] for i in order] == [0] * 100 + [1] + [2] * 1099
    assert selection.leading_number(scored, "k") is None
    split = {r["id"]: r["split"] for r in splits.ratio_split(scored, ["k", "id"], 0.25).collect()}
    assert [split[r["id"]] for r in scored.orderBy("k", "id").collect()] == ["train"] * 900 + ["test"] * 300
    empty = scored.limit(0)
    assert selection.cut_ranks(empty, [], ["t"], lead, cut).count() == 0 == selection.cut_ranks(empty, ["k"], ["t"], lead, cut).count()
    assert splits.ratio_split(empty, ["t"]).count() == 0


def test_selection_sorts_no_whole_table(scored, monkeypatch):
    ranked = []
    monkeypatch.setattr(selection, "ranked", lambda df, *more, to=ordering.ranked: ranked.append(df.count()) or to(df, *more))
    out = splits.ratio_split(scored, ["s", "id"], 0.75, limit=50)
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    # only the rows whose score is the cut's are ranked
    at_cut = sorted((r["s"] if r["s"] is not None else float("-inf") for r in scored.collect()), key=lambda v: (v != v, v))[299]
    assert sizes == {"train": 300, "test": 900} and ranked == [scored.where(F.col("s") == at_cut).count()]


def test_stratified_pieces_have_the_shares(scored):
    out = splits.stratified_split(scored, "k", ["id"], ["id"], limit=100)
    sizes = {(r["k"], r["split"]): r["count"] for r in out.groupBy("k", "split").count().collect()}
    totals = {r["k"]: r["count"] for r in scored.groupBy("k").count().collect()}
    for k, n in totals.items():
        assert sizes[k, "train"] == math.floor(n * 0.6)
        assert sizes[k, "train"] + sizes[k, "val"] == math.floor(n * (0.6 + 0.2))
    sample = {r["k"]: r["count"] for r in topk.stratified_sample(scored, "k", 0.1, ["id"], limit=100).groupBy("k").count().collect()}
    assert sample == {k: math.floor(n * 0.1) for k, n in totals.items() if math.floor(n * 0.1)}


def interpolated(values, p):
    at = p * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high or at == math.floor(at) else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


@pytest.mark.parametrize("cells", [20_000, 0])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_bracketed_quantiles_of_large_groups(spark, keys, cells, monkeypatch):
    monkeypatch.setattr(quantiles, "DRIVER_CELLS", cells)
    monkeypatch.setattr(quantiles, "MAP_VALUES", 10)
    monkeypatch.setattr(quantiles, "ALL_INSIDE", 100)
    monkeypatch.setattr(quantiles, "RANK_ERROR", 1e-2)
    rng = random.Random(5)
    rows = [(("a", "b", None)[i % 3], rng.choice([7.0, rng.gauss(0, 1e6), -rng.random()])) for i in range(9000)] + [("c", 1.0), ("c", None), ("a", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {tuple(r[k] for k in keys): (r["n"], list(r["q"])) for r in quantiles.quantiles(df, ["v"], probs, keys).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault((k,) if keys else (), []).append(v)
    for key, values in groups.items():
        values = sorted(v for v in values if v is not None)
        assert got[key][0] == len(values)
        assert got[key][1] == pytest.approx([interpolated(values, p) for p in probs], rel=1e-12)


def test_brackets_that_miss_are_opened(spark):
    rows = spark.range(1000).select(F.lit("x").alias("column"), F.col("id").cast("double").alias("value"))
    wrong = spark.createDataFrame([("x", 1000, [900.0, 910.0, 0.0, 5.0])], "column string, n long, _grid array<double>")
    quantiles_inside = quantiles.ALL_INSIDE
    try:
        quantiles.ALL_INSIDE = 0
        found = quantiles.selected(rows, ["column"], F.broadcast(wrong), [F.lit(500), F.lit(2)], 10_000).first()
    finally:
        quantiles.ALL_INSIDE = quantiles_inside
    assert [(a["value"], a["before"]) for a in found["_at"]] == [(500.0, 500), (2.0, 2)]


def test_bins_on_the_scan_are_those_of_the_value_table(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice([None, float("nan"), 3.0, 3.0, rng.gauss(0, 9)]), float(rng.randrange(30)), rng.choice("abc"), int(rng.random() < 0.3)) for _ in range(3000)]
    df = spark.createDataFrame(rows + [(1.0, 1.0, "a", None)], "x double, y double, z string, t int").repartition(4)
    columns = ["column", "label", "bin", "low", "high", "events", "others", "is_binned", "all_events", "all_others"]
    want = sorted(map(str, iv.binned(df, "t", ["x", "y", "z"]).select(*columns).collect()))
    monkeypatch.setattr(iv, "TOLD_APART", 10)
    scan = iv.binned(df, "t", ["x", "y", "z"], exact_unique=True)
    assert sorted(map(str, scan.select(*columns).collect())) == want
    assert {r["column"]: r["unique_values"] for r in scan.collect()} == {"x": len({x for x, *_ in rows if x is not None and x == x}), "y": 30, "z": 3}
    kept = iv.information_value(df, "t", ["x", "y", "z"], max_unique=40)
    assert {r["variable"] for r in kept.collect()} == {"y", "z"}


@pytest.mark.parametrize("limit", [10_000, 40])
def test_moving_moments_of_any_length(spark, limit):
    rng = random.Random(8)
    rows = [(i, i % 5 % 2, rng.choice([None, 1e9 + rng.random(), rng.random()])) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, k int, v double").repartition(3)
    lengths = [2, 9, 10, 20, 45, 300]
    out = windows.rolling_rows(df, ["k"], ["id"], ["v"], lengths, limit)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 700 and not [c for c in out.columns if c.startswith("_")]
    for key in (0, 1):
        own = [r for r in rows if r[1] == key]
        for at, r in enumerate(own):
            for w in lengths:
                values = [x for _, _, x in own[max(0, at - w + 1) : at + 1] if x is not None]
                assert got[r[0]][f"k_v_count_{w}d"] == len(values)
                assert got[r[0]][f"k_v_sum_{w}d"] == pytest.approx(sum(values))
                assert got[r[0]][f"k_v_std_{w}d"] == pytest.approx(statistics.stdev(values) if len(values) > 1 else 0.0, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize(("limit", "chunk"), [(100, 1000), (0, 1000), (0, 2)])
@pytest.mark.parametrize("mode", ["peers", "rows"])
def test_sums_over_days_keep_small_amounts(spark, limit, chunk, mode):
    day = dt.timedelta(days=1)
    rows = [(1, START, 1e21), (2, START + 60 * day, 1e-6), (3, START + 61 * day, 2e-6), (4, START + 61 * day, float("inf")), (5, START + 80 * day, 5.0), (6, START + 87 * day, None), (7, None, 4.0), (8, None, 6.0)]
    df = spark.createDataFrame([(i, "k", t, v) for i, t, v in rows], "id int, source string, timestamp timestamp_ntz, amount double")
    out = windows.rolling_days(df, "source", days=[7, 30], limit=limit, chunk_rows=chunk, tie_mode=mode, tiebreak=["id"])
    got = {r["id"]: (r["source_amount_sum_7d"], r["source_amount_count_7d"], r["source_amount_sum_30d"]) for r in out.collect()}
    peers = mode == "peers"
    assert got[1] == (1e21, 1, 1e21) and got[2] == (1e-6, 1, 1e-6)
    assert got[3] == ((float("inf"), 3, float("inf")) if peers else (pytest.approx(3e-6), 2, pytest.approx(3e-6)))
    assert got[5] == (5.0, 1, float("inf")) and got[6] == (0.0, 0, 5.0 if not peers else 5.0) or got[6][1] == 0
    assert got[7] == ((10.0, 2, 10.0) if peers else (4.0, 1, 4.0)) and got[8] == (10.0, 2, 10.0)


def test_groups_are_counted_together(scored):
    assert ordering.largest_groups(scored, [["k"], ["k", "t"], []]) [:1] == [900]
    assert ordering.largest_groups(scored.limit(0), [["k"], ["t"]]) == [0, 0]
