import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import windows as win

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def moves(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        src = 1 if i % 3 == 0 else rng.randrange(2, 12)
        at = START + dt.timedelta(hours=rng.randrange(24 * 20) if i % 4 else 24 * rng.randrange(20))
        rows.append((i, src, rng.randrange(20, 25), at, rng.randrange(1, 4000) / 100))
    return spark.createDataFrame(rows, "id int, source int, target int, timestamp timestamp_ntz, amount double")


def by_source(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["source"], []).append(r)
    return out


@pytest.mark.parametrize("limit", [10_000, 0])
def test_range_sums_are_left_open_and_include_peers(moves, limit):
    got = {r["id"]: r for r in win.rolling_days(moves, "source", days=[1, 3], limit=limit, chunk_rows=25 if limit == 0 else 10_000).collect()}
    for group in by_source(moves).values():
        for r in group:
            for d in (1, 3):
                inside = [x["amount"] for x in group if r["timestamp"] - d * DAY < x["timestamp"] <= r["timestamp"]]
                assert got[r["id"]][f"source_amount_count_{d}d"] == len(inside)
                assert got[r["id"]][f"source_amount_sum_{d}d"] == pytest.approx(sum(inside))
                assert got[r["id"]][f"source_amount_mean_{d}d"] == pytest.approx(sum(inside) / len(inside))


@pytest.mark.parametrize("chunk_rows", [10_000, 30])
def test_range_sums_in_rows_mode_leave_out_later_peers(moves, chunk_rows):
    out = win.rolling_days(moves, "source", days=[2], tie_mode="rows", tiebreak=["id"], chunk_rows=chunk_rows)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 300
    for group in by_source(moves).values():
        for r in group:
            inside = [
                x["amount"]
                for x in group
                if r["timestamp"] - 2 * DAY < x["timestamp"] and (x["timestamp"], x["id"]) <= (r["timestamp"], r["id"])
            ]
            assert got[r["id"]]["source_amount_count_2d"] == len(inside)
            assert got[r["id"]]["source_amount_sum_2d"] == pytest.approx(sum(inside))


@pytest.mark.parametrize("limit", [10_000, 20])
def test_rolling_rows_counts_rows_and_fills_deviation(moves, limit):
    out = win.rolling_rows(moves, ["source"], ["timestamp", "id"], ["amount"], [7], limit)
    got = {r["id"]: r for r in out.collect()}
    for group in by_source(moves).values():
        group = sorted(group, key=lambda r: (r["timestamp"], r["id"]))
        for i, r in enumerate(group):
            last = [x["amount"] for x in group[max(0, i - 6) : i + 1]]
            assert got[r["id"]]["source_amount_count_7d"] == len(last)
            assert got[r["id"]]["source_amount_sum_7d"] == pytest.approx(sum(last))
            want = statistics.stdev(last) if len(last) > 1 else 0.0
            assert got[r["id"]]["source_amount_std_7d"] == pytest.approx(want)


@pytest.mark.parametrize("limit", [10_000, 200, 40])
def test_rolling_rows_of_several_keys_meet_again(spark, limit):
    # 200: only the key of smallest groups fits a task with its moments; 40: no key does
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice(["a", "b", None]), rng.randrange(40), rng.choice([None, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, t string, at int, v double").repartition(3)
    out = win.rolling_rows(df, ["t", "k"], ["at", "id"], ["v"], [3, 20], limit)
    assert out.columns[:5] == df.columns and len(out.columns) == 21 and not [c for c in out.columns if c.startswith("_")]
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 300
    for name, spot in (("k", 1), ("t", 2)):
        for value in {r[spot] for r in rows}:
            own = sorted((r for r in rows if r[spot] == value), key=lambda r: (r[3], r[0]))
            for i, r in enumerate(own):
                for w in (3, 20):
                    last = [x[4] for x in own[max(0, i - w + 1) : i + 1] if x[4] is not None]
                    assert got[r[0]][f"{name}_v_count_{w}d"] == len(last)
                    assert got[r[0]][f"{name}_v_sum_{w}d"] == pytest.approx(sum(last))
                    assert got[r[0]][f"{name}_v_mean_{w}d"] == pytest.approx(statistics.mean(last) if last else 0.0)
                    assert got[r[0]][f"{name}_v_std_{w}d"] == pytest.approx(statistics.stdev(last) if len(last) > 1 else 0.0)
    assert win.rolling_rows(df.limit(0), ["t", "k"], ["at", "id"], ["v"], [3, 20], limit).count() == 0


def test_rolling_rows_fill_little_disk(spark, request):
    # small tables are joined as large ones are
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    request.addfinalizer(lambda old=spark.conf.get(broadcast): spark.conf.set(broadcast, old))
    spark.conf.set(broadcast, "-1")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f.getName(): f.length() for f in blocks.getAllFiles().mkString("\n").split("\n") for f in [spark._jvm.java.io.File(f)] if f.getName().startswith("shuffle_")}

    n = 40_000
    random_rows = [F.xxhash64("id", F.lit(i)) for i in range(4)]
    df = spark.range(n).select("id", *[F.pmod(c, F.lit(m)).alias(name) for c, m, name in zip(random_rows, (900, 90, 9), ("a", "b", "c"))], (F.pmod(random_rows[3], F.lit(10**7)) / 100).alias("v"))
    # rows come from a shuffle
    df = df.repartition(4, "a", "b").withColumn("at", F.pmod("a", F.lit(7)))
    before = shuffled()
    out = win.rolling_rows(df, ["a", "b", "c"], ["at", "id"], ["v"])
    # what came before the last step has left nothing
    assert sum(size for name, size in shuffled().items() if name not in before) < n
    out.write.format("noop").mode("overwrite").save()
    # rows, moments of two keys and what they are made of; 309 bytes a row when all columns of all keys moved
    assert sum(size for name, size in shuffled().items() if name not in before) < 240 * n


@pytest.mark.parametrize("limit", [10_000, 15])
def test_short_run_needs_a_full_window(moves, limit):
    out = win.short_run_features(moves, "source", ["timestamp", "id"], limit=limit)
    got = {r["id"]: r for r in out.collect()}
    for group in by_source(moves).values():
        group = sorted(group, key=lambda r: (r["timestamp"], r["id"]))
        for i, r in enumerate(group):
            if i < 2:
                assert got[r["id"]]["rolling_amount_mean_3"] is None
            else:
                last = [x["amount"] for x in group[i - 2 : i + 1]]
                mean, std = statistics.mean(last), statistics.stdev(last)
                assert got[r["id"]]["amount_cv_3"] == pytest.approx(std / (mean + 1e-6))


@pytest.mark.parametrize("limit", [10_000, 15])
def test_time_deltas_start_at_zero(moves, limit):
    got = {r["id"]: r for r in win.time_deltas(moves, tiebreak=["id"], limit=limit).collect()}
    for key, col in (("source", "out_time_delta"), ("target", "in_time_delta")):
        groups = {}
        for r in moves.collect():
            groups.setdefault(r[key], []).append(r)
        for group in groups.values():
            group = sorted(group, key=lambda r: (r["timestamp"], r["id"]))
            for i, r in enumerate(group):
                want = (r["timestamp"] - group[i - 1]["timestamp"]).total_seconds() if i else 0.0
                assert got[r["id"]][col] == want


def test_time_order_check(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 5), ("b", 2, 4)], "k string, id int, t int")
    got = {r["k"]: (r["is_ordered"], r["n_breaks"]) for r in win.is_time_ordered(df, ["k"], ["id"], "t").collect()}
    assert got == {"a": (True, 0), "b": (False, 1)}
    assert win.is_time_ordered(df, [], ["id", "k"], "t", limit=1).first()["n_breaks"] == 1


def test_first_drop(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.97), (3, 0.90), (4, 0.5)], "period int, v double")
    out = win.first_drop(df, [], "period", "v").orderBy("period").collect()
    assert [r["first_drop"] for r in out] == [3, 3, 3, 3]
    assert out[1]["ratio"] == 0.97
