"""Joins. Strategies are Catalyst's and AQE's choice: no side is broadcast by hand unless
its row count is bounded by construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.ordering import as_columns, attach, sized


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row per key in an explicit order: a combinable minimum, no sort per key."""
    rest = [c for c in df.columns if c not in keys]
    lead = F.struct(*as_columns(order))
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), lead).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def master_entities(
    edges: DataFrame, accounts: DataFrame, account_key: str, order: Sequence, src: str = "source", dst: str = "target"
) -> DataFrame:
    """All ids on either end of a transfer, with the first account row of each."""
    ids = edges.select(F.col(src).alias("entity")).union(edges.select(dst)).distinct()
    info = first_row(accounts, [account_key], order)
    return ids.join(info, ids["entity"] == info[account_key], "left").drop(account_key)


def label_rollup(entities: DataFrame, edges: DataFrame, entity: str, src: str, label: str, own: str | None = None) -> DataFrame:
    """Entity label: worst label it sent, else its own label, else 0."""
    worst = edges.groupBy(F.col(src).alias("_sender")).agg(F.max(label).alias("_sent"))
    fallback = [F.col(own)] if own else []
    joined = entities.join(worst, F.col(entity) == F.col("_sender"), "left")
    return joined.withColumn("entity_label", F.coalesce("_sent", *fallback, F.lit(0))).drop("_sender", "_sent")


def lookup_count(df: DataFrame, events: DataFrame, key: str, event_key: str, out: str) -> DataFrame:
    """Number of ``events`` per key, 0 where there are none."""
    sizes = events.groupBy(F.col(event_key).alias("_k")).agg(F.count(F.lit(1)).alias(out))
    return df.join(sizes, F.col(key) == F.col("_k"), "left").drop("_k").na.fill({out: 0})


def encode_endpoints(edges: DataFrame, codes: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """Replace both ends by their code; edges with an unknown end are dropped.

    ``codes`` has (value, code).
    """
    a = codes.select(F.col("value").alias("_a"), F.col("code").alias("from_code"))
    b = codes.select(F.col("value").alias("_b"), F.col("code").alias("to_code"))
    return edges.join(a, F.col(src) == F.col("_a")).join(b, F.col(dst) == F.col("_b")).drop("_a", "_b")


def key_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct keys of ``left``, how many also occur in ``right``, and the share."""
    a = left.select(F.col(left_key).alias("k")).distinct()
    b = right.select(F.col(right_key).alias("k")).distinct().withColumn("_hit", F.lit(1))
    joined = a.join(b, "k", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count("_hit").alias("n_shared"),
        (F.count("_hit") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("overlap_rate"),
    )


def map_frequency(df: DataFrame, frequencies: DataFrame, column: str, out: str) -> DataFrame:
    """Apply a fitted (value, freq) map; values it does not know get the map's mean."""
    f = sized(frequencies.select(F.col("value").alias("_v"), F.col("freq").alias("_f")))
    mean = f.agg(F.avg("_f"))
    joined = df.join(f, F.col(column) == F.col("_v"), "left")
    return joined.withColumn(out, F.coalesce("_f", mean.scalar())).drop("_v", "_f")


def align_rows(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row alignment on the explicit row key (null-safe)."""
    return attach(left, right, keys)


def thresholds_met(df: DataFrame, score: str, label: str, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys..., threshold, tp, fp, fn, tn for a fixed list of thresholds.

    Rows are never paired with thresholds: each row falls into the band between two of
    them, the bands are counted once, and a threshold sums the bands above it.
    """
    cuts = sorted(set(float(t) for t in thresholds))
    met = sum(((F.col(score) >= F.lit(t)).cast("int") for t in cuts), F.lit(0))
    bands = df.groupBy(*keys, met.alias("_met")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_n")
    )
    flags = []
    for i, t in enumerate(cuts):
        above = F.col("_met") > i
        flags.append(
            F.struct(
                F.lit(t).alias("threshold"),
                F.sum(F.when(above, F.col("_p")).otherwise(0)).alias("tp"),
                F.sum(F.when(above, F.col("_n")).otherwise(0)).alias("fp"),
                F.sum(F.when(above, 0).otherwise(F.col("_p"))).alias("fn"),
                F.sum(F.when(above, 0).otherwise(F.col("_n"))).alias("tn"),
            )
        )
    return bands.groupBy(*keys).agg(F.array(*flags).alias("_rows")).select(*keys, F.inline("_rows"))
