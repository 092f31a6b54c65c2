"""Encoders and scalers. Fitted parameters are small tables or literals, applied as expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.operators.joins import map_frequency
from txnrisk.operators.ordering import sized
from txnrisk.operators.quantiles import quantile_row
from txnrisk.session import settle, stored


def frequency_map(df: DataFrame, column: str) -> DataFrame:
    """(value, freq): share of each non-null value."""
    known = df.filter(F.col(column).isNotNull())
    counts = known.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("value", (F.col("_n") / known.agg(F.count(F.lit(1))).scalar()).alias("freq"))


def robust_params(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(median, interquartile range) per column; a range of 0 becomes 1."""
    q = quantile_row(stored(df.select(*cols)), cols, [0.25, 0.5, 0.75])
    out = {}
    for c in cols:
        low, mid, high = q.get(c, [0.0, 0.0, 0.0])
        out[c] = (mid, (high - low) or 1.0)
    return out


def apply_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - centre) / scale for every fitted column that is present."""
    return df.withColumns(
        {c: (F.col(c) - F.lit(centre)) / F.lit(scale) for c, (centre, scale) in params.items() if c in df.columns}
    )


def robust_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_scale(df, robust_params(df, cols))


def min_max_params(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    return {c: (float(row[f"lo_{c}"]), float(row[f"hi_{c}"] - row[f"lo_{c}"]) or 1.0) for c in cols}


def standard_params(df: DataFrame, cols: Sequence[str], sample: bool = False, guard: float = 0.0) -> dict[str, tuple[float, float]]:
    """(mean, deviation); population deviation unless ``sample``; a deviation of 0 becomes 1."""
    std = F.stddev_samp if sample else F.stddev_pop
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[std(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (float(row[f"m_{c}"] or 0.0), ((row[f"s_{c}"] or 0.0) + guard) or 1.0) for c in cols}


def min_max_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_scale(df, min_max_params(df, cols))


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_scale(df, standard_params(df, cols))


def target_map(df: DataFrame, column: str, label: str) -> DataFrame:
    """(value, freq): mean label per value; named so that the frequency lookup can apply it."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.avg(label).alias("freq"))


def target_encode(df: DataFrame, fitted: DataFrame, column: str, out: str, default: float) -> DataFrame:
    """Mean label of the value, ``default`` for values without one."""
    f = sized(fitted.select(F.col("value").alias("_v"), F.col("freq").alias("_f")))
    return df.join(f, F.col(column) == F.col("_v"), "left").withColumn(out, F.coalesce("_f", F.lit(default))).drop("_v", "_f")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = n_total / (n_classes * n_class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    share = total.select(F.col("t") / F.col("k")).scalar()
    return sizes.withColumn("weight", share / F.col("n"))


@dataclass
class FeatureEncoder:
    """Frequency encoding and robust scaling, fitted once and applied to unseen rows."""

    categorical: Sequence[str]
    numeric: Sequence[str]
    maps: dict[str, DataFrame] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "FeatureEncoder":
        df = stored(df.select(*dict.fromkeys([*self.categorical, *self.numeric])))
        self.maps = {c: settle(frequency_map(df, c)) for c in self.categorical}
        encoded = self._encode(df)
        self.scales = robust_params(encoded, [*self.categorical, *self.numeric])
        return self

    def _encode(self, df: DataFrame) -> DataFrame:
        for c, fitted in self.maps.items():
            df = map_frequency(df.withColumnRenamed(c, "_raw"), fitted, "_raw", c).drop("_raw")
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        return apply_scale(self._encode(df), self.scales)

    def save(self, spark: SparkSession, path: str) -> None:
        for c, fitted in self.maps.items():
            fitted.withColumn("value", F.col("value").cast("string")).write.mode("overwrite").parquet(f"{path}/map={c}")
        rows = [(c, a, b) for c, (a, b) in self.scales.items()]
        spark.createDataFrame(rows, "column string, centre double, scale double").write.mode("overwrite").parquet(f"{path}/scales")

    @classmethod
    def load(cls, spark: SparkSession, path: str, categorical: Sequence[str], numeric: Sequence[str]) -> "FeatureEncoder":
        maps = {c: spark.read.parquet(f"{path}/map={c}") for c in categorical}
        scales = {r["column"]: (r["centre"], r["scale"]) for r in spark.read.parquet(f"{path}/scales").collect()}
        return cls(categorical, numeric, maps, scales)
