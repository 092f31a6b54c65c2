"""Weight of evidence and information value.

A sketch tells which numeric columns surely have many values. Those get exact quantile edges, which are
literals of one scan that counts a few bins per task. All other columns are counted per distinct value,
and their edges, bins and contingency tables come from that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions.numeric import log_odds
from txnrisk.operators.ordering import WINDOW_ROWS
from txnrisk.operators.quantiles import long_form, many_quantiles, quantile_row, quantiles_of_counts
from txnrisk.session import settle

MISSING = "**MISSING**"
# Most distinct values that a sketch is asked to tell apart.
TOLD_APART = 1000


def _numeric(df: DataFrame, cols: Sequence[str]) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in cols if isinstance(types[c], T.NumericType)]


def value_profile(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """(column, value, text, events, others): numbers in ``value``, categories in ``text``.

    Missing values have a null ``value`` and the text ``**MISSING**``.
    """
    known = df.filter(F.col(target).isin(0, 1))
    event = (F.col(target) == 1).cast("long")
    counts = [F.sum(event).alias("events"), F.sum(1 - event).alias("others")]
    numeric = _numeric(df, cols)
    text_cols = [c for c in cols if c not in numeric]
    parts = []
    if numeric:
        rows = long_form(known, numeric, [target])
        value = F.when(F.isnan("value"), None).otherwise(F.col("value"))
        parts.append(
            rows.groupBy("column", value.alias("value")).agg(*counts).withColumn(
                "text", F.coalesce(F.col("value").cast("string"), F.lit(MISSING))
            )
        )
    if text_cols:
        rows = known.select(target, *[F.col(c).cast("string").alias(c) for c in text_cols]).unpivot(
            [target], text_cols, "column", "text"
        )
        parts.append(
            rows.groupBy("column", F.coalesce("text", F.lit(MISSING)).alias("text")).agg(*counts).withColumn(
                "value", F.lit(None).cast("double")
            )
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return settle(out.select("column", "value", "text", "events", "others"))


def _totals(profile: DataFrame) -> DataFrame:
    """(column, unique_values, all_events, all_others): one row per column."""
    return profile.groupBy("column").agg(
        F.count_if(F.col("text") != MISSING).alias("unique_values"),
        F.count("value").alias("_numbers"),
        F.min("value").alias("_low"),
        F.max("value").alias("_high"),
        F.sum("events").alias("all_events"),
        F.sum("others").alias("all_others"),
    )


def _bin_of(value: Column, edges: Column) -> Column:
    """1-based right-closed interval; the first also holds the minimum."""
    return F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e < value)))


def _many_valued(known: DataFrame, numeric: Sequence[str], most: int) -> list[str]:
    """Numeric columns proven to have more than ``most`` distinct values: a sketch's quantiles are values
    of the column, so they are never more than its distinct values."""
    if not numeric:
        return []
    steps = 2 * most + 2
    grid = [i / steps for i in range(steps + 1)]
    values = known.select(*[F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"v{i}") for i, c in enumerate(numeric)])
    found = values.agg(*[F.size(F.array_distinct(many_quantiles(f"v{i}", grid, 2 * steps))) for i in range(len(numeric))]).first()
    return [c for c, distinct in zip(numeric, found, strict=True) if (distinct or 0) > most]


def binned(
    df: DataFrame, target: str, cols: Sequence[str], bins: int = 10, limit: int = WINDOW_ROWS, max_unique: int | None = None, exact_unique: bool = False
) -> DataFrame:
    """(column, bin, label, events, others, and the column's totals) per bin.

    Numbers with more than ``bins`` distinct values get quantile bins with repeated
    edges dropped (equal widths if fewer than two edges are left) and lose missing
    values; everything else is a category per value, missing included. Columns proven to have more
    than ``max_unique`` values are left out if that is given. ``unique_values`` is null for
    other columns proven to have many, unless ``exact_unique`` asks for the count.
    """
    # several passes read these columns, whatever it takes to make them
    df = settle(df.select(*dict.fromkeys([target, *cols])))
    known = df.filter(F.col(target).isin(0, 1))
    most = max(bins, min(TOLD_APART, TOLD_APART if max_unique is None else max_unique))
    many = _many_valued(known, _numeric(df, cols), most)
    others = [c for c in cols if c not in many]
    if max_unique is not None and max_unique <= most:
        many = []
    parts = [_binned_profile(value_profile(df, target, others), bins, limit)] if others else []
    if many:
        parts.append(_binned_scan(known, target, many, bins, limit, exact_unique))
    if not parts:
        # no column is left: the right columns, no rows
        return _binned_profile(value_profile(df.limit(0), target, cols), bins, limit)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _binned_scan(known: DataFrame, target: str, cols: Sequence[str], bins: int, limit: int, exact_unique: bool) -> DataFrame:
    """The bins of columns with many values, counted in one scan against literal edges."""
    edges = {c: sorted(set(q)) for c, q in quantile_row(known, cols, [i / bins for i in range(bins + 1)], limit).items()}
    event = (F.col(target) == 1).cast("long")
    cells = []
    for c in cols:
        value = F.col(c).cast("double")
        value = F.when(~F.isnan(value), value)
        # right-closed intervals; the first also holds the minimum
        place = sum(((value > e).cast("int") for e in edges[c][1:-1]), F.lit(1))
        cells.append(F.struct(F.lit(c).alias("column"), F.when(value.isNotNull(), place).alias("bin"), value.alias("value")))
    rows = known.select(event.alias("_e"), F.inline(F.array(*cells)))
    uniques = {}
    if exact_unique:
        uniques = {r["column"]: r["u"] for r in rows.groupBy("column").agg(F.count_distinct("value").alias("u")).collect()}
    table = settle(
        rows.groupBy("column", "bin").agg(
            F.min("value").alias("low"), F.max("value").alias("high"), F.sum("_e").alias("events"), F.sum(1 - F.col("_e")).alias("others")
        )
    )  # a few rows per column
    totals = table.groupBy("column").agg(F.sum("events").alias("all_events"), F.sum("others").alias("all_others"))
    listed = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(uniques.get(c)).cast("long"))])
    return (
        table.join(F.broadcast(totals), "column")
        .where("bin is not null")
        .select(
            "column", F.col("bin").cast("string").alias("label"), "bin", "low", "high", "events", "others", F.lit(True).alias("is_binned"),
            F.try_element_at(listed, F.col("column")).alias("unique_values"), "all_events", "all_others",
        )
    )


def _binned_profile(profile: DataFrame, bins: int, limit: int) -> DataFrame:
    """The bins of columns that are counted per value."""
    counts = profile.filter(F.col("value").isNotNull()).select(
        "column", "value", (F.col("events") + F.col("others")).alias("n")
    )
    probs = [i / bins for i in range(bins + 1)]
    edges = quantiles_of_counts(counts, probs, ["column"], limit).select(
        F.col("column").alias("_c"), F.array_sort(F.array_distinct("q")).alias("_q")
    )
    totals = _totals(profile).withColumnRenamed("column", "_t")
    per_column = totals.join(edges, F.col("_t") == F.col("_c"), "left").drop("_c")
    width = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    equal = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("_low") + width * i)
    per_column = per_column.withColumn("_edges", F.when(F.size("_q") >= 2, F.col("_q")).otherwise(equal))
    # one row per column: small whatever the number of transactions
    rows = profile.join(F.broadcast(per_column), F.col("column") == F.col("_t"))
    is_binned = (F.col("_numbers") > 0) & (F.col("unique_values") > bins)
    number = F.when(is_binned, _bin_of(F.col("value"), F.col("_edges")))
    rows = rows.filter(~is_binned | F.col("value").isNotNull()).withColumns(
        {
            "bin": number.cast("int"),
            "label": F.when(is_binned, number.cast("string")).otherwise(F.col("text")),
            "is_binned": is_binned,
        }
    )
    return rows.groupBy("column", "label").agg(
        F.first("bin").alias("bin"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.sum("events").alias("events"),
        F.sum("others").alias("others"),
        F.first("is_binned").alias("is_binned"),
        F.first("unique_values").alias("unique_values"),
        F.first("all_events").alias("all_events"),
        F.first("all_others").alias("all_others"),
    )


def _shares() -> tuple[Column, Column]:
    return (
        (F.col("events") + 0.5) / (F.col("all_events") + F.lit(1.0)),
        (F.col("others") + 0.5) / (F.col("all_others") + F.lit(1.0)),
    )


def _woe() -> Column:
    return log_odds(F.col("events"), F.col("others"), F.col("all_events"), F.col("all_others"))


def skipped_columns(
    df: DataFrame, target: str, cols: Sequence[str], min_samples: int = 10, max_unique: int = 1000, bins: int = 10, limit: int = WINDOW_ROWS
) -> DataFrame:
    """(variable, reason, unique_values) of the columns that ``information_value`` leaves out:
    high_cardinality, constant, single_class or few_samples (no bin has enough rows)."""
    rows = binned(df, target, cols, bins, limit, exact_unique=True)
    found = rows.groupBy(F.col("column").alias("variable")).agg(
        F.first("unique_values").alias("unique_values"), F.first("all_events").alias("_e"), F.first("all_others").alias("_o"),
        F.max(F.col("events") + F.col("others")).alias("_most"),
    )
    reason = (
        F.when(F.col("unique_values") > max_unique, "high_cardinality")
        .when(F.col("unique_values") <= 1, "constant")
        .when((F.col("_e") == 0) | (F.col("_o") == 0), "single_class")
        .when(F.col("_most") < min_samples, "few_samples")
    )
    return found.select("variable", reason.alias("reason"), "unique_values").filter("reason is not null")


def information_value(
    df: DataFrame,
    target: str,
    cols: Sequence[str],
    bins: int = 10,
    max_iv: float = 10.0,
    min_samples: int = 10,
    max_unique: int = 1000,
    smoothed: bool = True,
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """(variable, iv, unique_values, is_suspect), highest value first.

    Columns with too many distinct values or only one are left out, and all if the target has one
    class; ``skipped_columns`` names them. ``smoothed=False``
    uses plain shares with zero shares set to 0.0001 and no clipping.
    """
    rows = binned(df, target, cols, bins, limit, max_unique, exact_unique=True)
    rows = rows.filter((F.col("unique_values") <= max_unique) & (F.col("unique_values") > 1))
    rows = rows.filter((F.col("all_events") > 0) & (F.col("all_others") > 0) & (F.col("events") + F.col("others") >= min_samples))
    if smoothed:
        a, b = _shares()
        part = (a - b) * _woe()
    else:
        floor = F.lit(0.0001)
        a = F.col("events") / F.nullif(F.col("all_events").cast("double"), F.lit(0.0))
        b = F.col("others") / F.nullif(F.col("all_others").cast("double"), F.lit(0.0))
        a, b = F.when(a == 0, floor).otherwise(a), F.when(b == 0, floor).otherwise(b)
        part = (a - b) * F.log(a / b)
    out = rows.groupBy(F.col("column").alias("variable")).agg(
        F.least(F.lit(float(max_iv)), F.sum(part)).alias("iv"), F.first("unique_values").alias("unique_values")
    )
    suspect = (F.col("iv") == max_iv) | (F.col("unique_values") > max_unique * 0.5)
    return out.withColumn("is_suspect", suspect).orderBy(F.col("iv").desc(), "variable")


def weight_of_evidence(df: DataFrame, target: str, feature: str, bins: int = 10, limit: int = WINDOW_ROWS) -> DataFrame:
    """(label, bin, events, others, woe) of one feature."""
    rows = binned(df, target, [feature], bins, limit)
    return rows.select("label", "bin", "events", "others", _woe().alias("woe"))


def predictive_features(iv: DataFrame, min_iv: float = 0.02, exclude_suspect: bool = True) -> DataFrame:
    kept = iv.filter(F.col("iv") >= min_iv)
    return kept.filter(~F.col("is_suspect")) if exclude_suspect else kept


def is_monotonic(df: DataFrame, target: str, features: Sequence[str], bins: int = 10, limit: int = WINDOW_ROWS) -> DataFrame:
    """(variable, is_monotonic): does the weight of evidence only rise or only fall over the bins?

    The window runs over a column's bins, at most ``bins`` rows when it is binned.
    """
    rows = binned(df, target, _numeric(df, features), bins, limit).withColumn("woe", _woe())
    step = F.col("woe") - F.lag("woe").over(Window.partitionBy("column").orderBy("low"))
    return (
        rows.withColumn("_step", step)
        .groupBy(F.col("column").alias("variable"))
        .agg(
            (F.coalesce(F.bool_and(F.col("_step") >= 0), F.lit(True)) | F.coalesce(F.bool_and(F.col("_step") <= 0), F.lit(True))).alias("is_monotonic")
        )
    )


def value_by_bins(
    df: DataFrame, target: str, feature: str, bins: int = 10, min_rows: int = 5, limit: int = WINDOW_ROWS
) -> DataFrame:
    """(bin, low, high, count, fraud_rate, woe, iv) of one numeric feature."""
    rows = binned(df, target, [feature], bins, limit)
    n = F.col("events") + F.col("others")
    a, b = _shares()
    return rows.filter(n >= min_rows).select(
        "bin", "low", "high", n.alias("count"), (F.col("events") / n).alias("fraud_rate"),
        _woe().alias("woe"), ((a - b) * _woe()).alias("iv"),
    )


# A column whose name contains one of these counts as a pattern feature.
PATTERN_NAMES = ["pattern", "similarity", "degree", "concentration", "fan_", "temporal"]


def pattern_information_value(df: DataFrame, target: str, **options) -> DataFrame:
    cols = [c for c in df.columns if c != target and any(p in c.lower() for p in PATTERN_NAMES)]
    return information_value(df, target, cols, **options)
