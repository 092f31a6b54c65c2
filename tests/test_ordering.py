"""Order-dependent kernels: the route for hot keys must give what a plain window gives."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows_of
from txnrisk.operators import ordering
from txnrisk.operators.quantiles import quantiles

SCHEMA = "k string, t int, id int, v double"


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds over a third of all rows, one key is null, many times are equal."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 2 == 0 else (None if i % 7 == 0 else f"k{i % 20}")
        rows.append((key, rng.randrange(60), i, float(rng.randrange(1000)) / 4))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def ordered(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["k"], []).append(r)
    return {k: sorted(v, key=lambda r: (r["t"], r["id"])) for k, v in groups.items()}


def test_global_rank_is_dense_and_ordered(skewed):
    out = ordering.global_rank(skewed, ["t", "id"], "pos").orderBy("pos").collect()
    assert [r["pos"] for r in out] == list(range(900))
    assert [(r["t"], r["id"]) for r in out] == sorted((r["t"], r["id"]) for r in out)


def test_global_rank_descending_order(skewed):
    out = ordering.global_rank(skewed, [F.col("v").desc(), "id"], "pos").orderBy("pos").collect()
    assert [(-r["v"], r["id"]) for r in out] == sorted((-r["v"], r["id"]) for r in out)


def test_hot_keys_are_bounded_and_found(skewed):
    assert ordering.hot_keys(skewed, ["k"], 1000) is None
    assert [r["k"] for r in ordering.hot_keys(skewed, ["k"], 200).keys.collect()] == ["hot"]


@pytest.mark.parametrize("limit", [10_000, 100, 7, 1])
def test_ranked_same_for_every_limit(skewed, limit):
    out = ordering.ranked(skewed, ["k"], ["t", "id"], "rk", limit)
    want = [(r["id"], i + 1) for g in ordered(skewed).values() for i, r in enumerate(g)]
    assert rows_of(out, "id", "rk") == sorted(want, key=lambda t: tuple((False, str(v)) for v in t))


@pytest.mark.parametrize("limit", [10_000, 64, 3])
def test_ranked_without_keys(skewed, limit):
    out = ordering.ranked(skewed, [], ["t", "id"], "rk", limit).orderBy("rk").collect()
    assert [r["rk"] for r in out] == list(range(1, 901))


@pytest.mark.parametrize("limit", [10_000, 50, 2])
def test_framed_lookback_crosses_chunks(skewed, limit):
    def columns(spec):
        return {"lag2": F.lag("v", 2).over(spec), "sum5": F.sum("v").over(spec.rowsBetween(-4, 0))}

    out = {r["id"]: (r["lag2"], r["sum5"]) for r in ordering.framed(skewed, ["k"], ["t", "id"], columns, 4, limit).collect()}
    assert len(out) == 900
    for group in ordered(skewed).values():
        for i, r in enumerate(group):
            lag = group[i - 2]["v"] if i >= 2 else None
            assert out[r["id"]] == (lag, sum(x["v"] for x in group[max(0, i - 4) : i + 1]))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("limit", [10_000, 40, 3])
def test_running_sum(skewed, keys, limit):
    out = {r["id"]: (r["s"], r["n"]) for r in ordering.running_sum(skewed, keys, ["t", "id"], {"s": F.col("v"), "n": F.lit(1)}, limit).collect()}
    groups = ordered(skewed) if keys else {None: sorted(skewed.collect(), key=lambda r: (r["t"], r["id"]))}
    assert len(out) == 900
    for group in groups.values():
        total = 0.0
        for i, r in enumerate(group):
            total += r["v"]
            assert out[r["id"]] == (total, i + 1)


@pytest.mark.parametrize("limit", [10_000, 20, 2])
def test_quantiles_match_linear_interpolation(skewed, limit):
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {r["k"]: list(r["q"]) for r in quantiles(skewed, ["v"], probs, ["k"], limit=limit).collect()}
    for key, group in ordered(skewed).items():
        values = sorted(r["v"] for r in group)
        for p, q in zip(probs, got[key]):
            at = p * (len(values) - 1)
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert q == pytest.approx(low + (high - low) * (at - int(at)))


def test_quantiles_ignore_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    row = quantiles(df, ["v"], [0.5]).first()
    assert (row["n"], row["q"][0]) == (2, 2.0)


def test_approximate_quantiles_stay_near(skewed):
    exact = quantiles(skewed, ["v"], [0.5]).first()["q"][0]
    near = quantiles(skewed, ["v"], [0.5], approx=True).first()["q"][0]
    assert abs(exact - near) <= 2


def test_empty_input(spark):
    empty = spark.createDataFrame([], T.StructType.fromDDL(SCHEMA))
    assert ordering.ranked(empty, ["k"], ["t"], "rk").count() == 0
    assert ordering.ranked(empty, [], ["t"], "rk", limit=0).count() == 0
    assert ordering.running_sum(empty, [], ["t"], {"s": F.col("v")}).count() == 0
    assert quantiles(empty, ["v"], [0.5]).count() == 0


@pytest.mark.parametrize(("rows", "sent"), [(3, True), (2, False)])
def test_only_small_tables_are_broadcast(spark, rows, sent):
    small = ordering.sized(spark.createDataFrame([(1,), (2,), (None,)], "v int"), rows)
    assert ("Hint" in small._jdf.queryExecution().logical().toString()) == sent
    assert small.count() == 3
