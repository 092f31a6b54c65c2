"""Distributed Spark ML models: training, scoring, search, calibration, importance."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnrisk.operators.encoding import class_weights
from txnrisk.operators.evaluate import confusion, ranking_metrics
from txnrisk.operators.ordering import WINDOW_ROWS, ranked
from txnrisk.operators.splits import fold_role, stable_hash
from txnrisk.session import settle, stored

SEED = 42
# Most values of a label.
CLASSES = 1000
# Fits that run at the same time; their jobs share the cluster.
PARALLEL = 4
# Sorted score ranges whose pooled blocks one task merges in a round.
FAN_IN = 16
THRESHOLD_METRICS = ["recall", "precision", "f1", "accuracy"]
RANK_METRICS = ["average_precision", "pr_auc", "roc_auc"]
# Models by name with their default settings.
MODELS = {
    "logistic": (LogisticRegression, {"maxIter": 50, "regParam": 0.01}),
    "random_forest": (RandomForestClassifier, {"numTrees": 20, "maxDepth": 6, "seed": SEED}),
    "boosted_trees": (GBTClassifier, {"maxIter": 10, "maxDepth": 4, "seed": SEED}),
}
# Candidate settings searched per model.
SEARCH_SPACES = {
    "logistic": {"regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]},
    "random_forest": {"numTrees": [10, 20, 40], "maxDepth": [4, 6, 8]},
    "boosted_trees": {"maxIter": [5, 10, 20], "maxDepth": [3, 4, 5], "stepSize": [0.05, 0.1]},
}
SCALERS = {"standard": StandardScaler, "minmax": MinMaxScaler}


def build(kind: str, cols: Sequence[str], label: str, scaler: str | None = None, weight: str | None = None, **settings) -> Pipeline:
    """Assembler, optional scaler and classifier."""
    if kind not in MODELS:
        raise ValueError(f"unknown model {kind!r}; known: {sorted(MODELS)}")
    cls, defaults = MODELS[kind]
    stages = [VectorAssembler(inputCols=list(cols), outputCol="_features")]
    features = "_features"
    if scaler:
        stages.append(SCALERS[scaler](inputCol=features, outputCol="_scaled"))
        features = "_scaled"
    options = {**defaults, **settings, "featuresCol": features, "labelCol": label}
    if weight:
        options["weightCol"] = weight
    stages.append(cls(**options))
    return Pipeline(stages=stages)


def with_class_weights(df: DataFrame, label: str, out: str = "_weight") -> DataFrame:
    """Balanced weight of each row's class. Classes are few, so they become literals."""
    found = class_weights(df, label).limit(CLASSES + 1).collect()
    if len(found) > CLASSES:
        raise ValueError(f"{label} has more than {CLASSES} values and is no class")
    weights = {r[label]: float(r["weight"]) for r in found}
    pairs = itertools.chain.from_iterable((F.lit(k), F.lit(w)) for k, w in weights.items())
    return df.withColumn(out, F.element_at(F.create_map(*pairs), F.col(label)))


def train(
    df: DataFrame, cols: Sequence[str], label: str, kind: str = "random_forest", balanced: bool = True, scaler: str | None = None,
    is_stored: bool = False, **settings,
) -> PipelineModel:
    """A fit reads its rows many times: they are settled once, unless they are stored already.

    Not as files of columns: the rows that a tree draws follow from the partitions.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols], label)
    rows = rows if is_stored else settle(rows)
    if balanced:
        return build(kind, cols, label, scaler, "_weight", **settings).fit(with_class_weights(rows, label))
    return build(kind, cols, label, scaler, **settings).fit(rows)


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The input columns plus ``probability`` of the positive class and ``prediction``."""
    out = model.transform(df.drop("probability", "prediction", "rawPrediction"))
    p = vector_to_array("probability")[1]
    return out.withColumn("probability", p).withColumn("prediction", (F.col("probability") >= threshold).cast("int")).select(
        *[c for c in df.columns if c not in ("probability", "prediction")], "probability", "prediction"
    )


def importances(model: PipelineModel, cols: Sequence[str]) -> dict[str, float]:
    """Tree importances, or absolute coefficients of a linear model."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return dict(zip(cols, (float(v) for v in values)))


def _ranked_table(spark: SparkSession, values: dict[str, float], top_n: int | None = None) -> DataFrame:
    rows = sorted(values.items(), key=lambda kv: (-kv[1], kv[0]))[:top_n]
    return spark.createDataFrame([(v, float(i), r + 1) for r, (v, i) in enumerate(rows)], "variable string, importance double, rank int")


def forest_selection(df: DataFrame, cols: Sequence[str], label: str, top_n: int = 20, **settings) -> DataFrame:
    """(variable, importance, rank): the columns a forest finds most useful."""
    model = train(df, cols, label, "random_forest", **settings)
    return _ranked_table(df.sparkSession, importances(model, cols), top_n)


def mean_importances(models: Iterable[PipelineModel], cols: Sequence[str], spark: SparkSession) -> DataFrame:
    each = [importances(m, cols) for m in models]
    return _ranked_table(spark, {c: sum(e[c] for e in each) / len(each) for c in cols})


def ranked_rows(df: DataFrame, order: Sequence, limit: int = WINDOW_ROWS) -> DataFrame:
    """The rows with their place in time, stored once; every fold is a filter on the place."""
    count = df.count()
    placed = ranked(df, [], order, "_rank", limit, count)
    # ranks of more rows are stored already
    return placed if count > limit else stored(placed)


def fold_rows(rows: DataFrame, bounds: tuple[int, int, int, int]) -> DataFrame:
    """Rows of one fold with ``fold`` and ``role``."""
    fold, *cuts = bounds
    role = fold_role(F.col("_rank") - 1, *cuts)
    return rows.filter(role.isNotNull()).withColumns({"fold": F.lit(fold), "role": role}).drop("_rank")


def fold_metrics(scored: DataFrame, score_col: str, label: str, threshold: float = 0.5, limit: int = WINDOW_ROWS) -> DataFrame:
    """(fold, role, recall, precision, f1, accuracy, average_precision, pr_auc, roc_auc) of rows with fold and role."""
    rates = confusion(scored, score_col, label, threshold, ["fold", "role"]).select("fold", "role", *THRESHOLD_METRICS)
    areas = ranking_metrics(scored, score_col, label, ["fold", "role"], limit).select("fold", "role", *RANK_METRICS)
    return rates.join(areas, ["fold", "role"], "left")


def at_once(spark: SparkSession, jobs: Sequence[Callable[[], object]], parallel: int = PARALLEL) -> list:
    """Results of driver functions that start Spark jobs, ``parallel`` of them at a time, in their order.

    Each has a scheduler pool of its own: under the FAIR scheduler a short fit does not wait for a long one.
    The first failure is raised once those already running have ended.
    """

    def run(number: int, job: Callable[[], object]) -> object:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % max(1, parallel)}")
        return job()

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(partial(run, i, job))) for i, job in enumerate(jobs)]
        try:
            return [f.result() for f in started]
        except BaseException:
            for f in started:
                f.cancel()
            raise


def fit_folds(
    df: DataFrame, cols: Sequence[str], label: str, kind: str, bounds: Sequence[tuple[int, int, int, int]], order: Sequence,
    threshold: float = 0.5, limit: int = WINDOW_ROWS, parallel: int = PARALLEL, **settings,
) -> DataFrame:
    """``fold_metrics`` of the train and test rows of each time fold.

    Folds are fitted at the same time over one stored table; every fit and all scoring is
    distributed, and one evaluation covers all folds and roles.
    """
    rows = ranked_rows(df.select(*dict.fromkeys([*cols, label, *order])), order, limit)

    def fitted(bound: tuple[int, int, int, int]) -> DataFrame:
        part = fold_rows(rows, bound)
        model = train(part.filter(F.col("role") == "train"), cols, label, kind, is_stored=True, **settings)
        return score(model, part).select("fold", "role", "probability", label)

    scored = at_once(df.sparkSession, [partial(fitted, b) for b in bounds], parallel)
    return fold_metrics(stored(reduce(DataFrame.unionByName, scored)), "probability", label, threshold, limit)


def summarise_folds(metrics: DataFrame) -> DataFrame:
    """(metric, train_mean, train_std, test_mean, test_std, overfit, overfit_std, n_folds): means and
    deviations (ddof 0) over folds. The metric ``overall`` is the mean of those at the threshold."""
    overall = sum((F.col(m) for m in THRESHOLD_METRICS), F.lit(0.0)) / len(THRESHOLD_METRICS)
    long = metrics.withColumn("overall", overall).unpivot(["fold", "role"], [*THRESHOLD_METRICS, *RANK_METRICS, "overall"], "metric", "value")
    sides = [F.max(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in ("train", "test")]
    each = long.groupBy("metric", "fold").agg(*sides).withColumn("overfit", F.col("train") - F.col("test"))
    return each.groupBy("metric").agg(
        F.avg("train").alias("train_mean"), F.stddev_pop("train").alias("train_std"),
        F.avg("test").alias("test_mean"), F.stddev_pop("test").alias("test_std"),
        F.avg("overfit").alias("overfit"), F.stddev_pop("overfit").alias("overfit_std"),
        F.count("overfit").alias("n_folds"),
    )


def candidates(kind: str, n: int, seed: int = SEED) -> list[dict]:
    """A seeded random choice of distinct settings from the model's search space."""
    space = SEARCH_SPACES[kind]
    grid = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    return random.Random(seed).sample(grid, min(n, len(grid)))


def search(
    df: DataFrame, cols: Sequence[str], label: str, kind: str, bounds: Sequence[tuple[int, int, int, int]], order: Sequence,
    n: int = 3, seed: int = SEED, limit: int = WINDOW_ROWS, parallel: int = PARALLEL,
) -> DataFrame:
    """(trial, settings, mean_pr_auc, rank) of random settings under time folds.

    All trials and folds are fitted over one stored table, ``parallel`` at a time.
    """
    rows = ranked_rows(df.select(*dict.fromkeys([*cols, label, *order])), order, limit)
    tried = candidates(kind, n, seed)

    def fitted(trial: int, settings: dict, bound: tuple[int, int, int, int]) -> DataFrame:
        part = fold_rows(rows, bound)
        model = train(part.filter(F.col("role") == "train"), cols, label, kind, is_stored=True, **settings)
        test = score(model, part.filter(F.col("role") == "test"))
        return test.select(F.lit(trial).alias("trial"), F.lit(str(settings)).alias("settings"), "fold", "probability", label)

    scored = at_once(df.sparkSession, [partial(fitted, t, s, b) for t, s in enumerate(tried) for b in bounds], parallel)
    everything = reduce(DataFrame.unionByName, scored)
    keys = ["trial", "settings", "fold"]
    areas = ranking_metrics(everything, "probability", label, keys, limit)
    # one row per trial: the window is over the trials
    means = areas.groupBy("trial", "settings").agg(F.avg("average_precision").alias("mean_pr_auc"))
    best_first = Window.partitionBy(F.lit(0)).orderBy(F.col("mean_pr_auc").desc(), "trial")
    return means.withColumn("rank", F.row_number().over(best_first))


def permutation_importance(
    model: PipelineModel, df: DataFrame, cols: Sequence[str], label: str, order: Sequence, hash_cols: Sequence[str],
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """(variable, drop): loss of average precision when one column is shuffled.

    One shuffled partner row serves all columns: ranks by hash are joined to ranks by
    order, and each variant takes one column from the partner. All variants are
    evaluated in one job.
    """
    base = stored(df.select(*dict.fromkeys([*cols, label, *order, *hash_cols])))
    placed = ranked(base, [], order, "_at", limit)
    shuffled = ranked(base.withColumn("_hash", stable_hash(hash_cols, "permute")), [], ["_hash", *order], "_at", limit)
    partner = shuffled.select(F.col("_at").alias("_other"), *[F.col(c).alias(f"_p_{c}") for c in cols])
    paired = stored(placed.join(partner, F.col("_at") == F.col("_other")).select(*cols, label, *[f"_p_{c}" for c in cols]))
    variants = [score(model, paired.select(*cols, label)).select(F.lit("").alias("variable"), "probability", label)]
    for c in cols:
        changed = paired.select(*[F.col(f"_p_{c}").alias(c) if x == c else F.col(x) for x in cols], label)
        variants.append(score(model, changed).select(F.lit(c).alias("variable"), "probability", label))
    areas = settle(ranking_metrics(reduce(DataFrame.unionByName, variants), "probability", label, ["variable"], limit))
    whole = areas.filter(F.col("variable") == "").select("average_precision").scalar()
    return areas.filter(F.col("variable") != "").select("variable", (whole - F.col("average_precision")).alias("drop"))


_BLOCKS = "first double, last double, total double, weight double"


def pool_blocks(blocks: np.ndarray) -> np.ndarray:
    """Adjacent violators pooled: rows (first, last, total, weight) by score, means rising afterwards.

    Neighbours of equal mean are one block as well.
    """
    out: list[list[float]] = []
    for row in blocks.tolist():
        out.append(row)
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, last, total, weight = out.pop()
            out[-1][1] = last
            out[-1][2] += total
            out[-1][3] += weight
    return np.array(out, np.float64).reshape(-1, 4)


def _pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of one task's sorted rows; what is pooled is kept, what was read is not."""
    kept = np.zeros((0, 4))
    part = None
    for batch in batches:
        if len(batch):
            part = int(batch["part"].iloc[0])
            kept = pool_blocks(np.concatenate([kept, batch[["first", "last", "total", "weight"]].to_numpy(np.float64)]))
    if part is not None:
        yield pd.DataFrame(kept, columns=["first", "last", "total", "weight"]).assign(part=part)


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    ordered = group.sort_values("first")
    return pd.DataFrame(pool_blocks(ordered[["first", "last", "total", "weight"]].to_numpy(np.float64)), columns=["first", "last", "total", "weight"]).assign(
        part=int(ordered["part"].iloc[0]) // FAN_IN
    )


@dataclass
class Calibration:
    """A rising step function of blocks; scores between two blocks are interpolated."""

    scores: list[float]
    values: list[float]


def isotonic_blocks(points: DataFrame) -> DataFrame:
    """(first, last, total, weight): blocks of the isotonic fit to points (score, total, weight), by score.

    Score ranges are pooled in parallel; then the blocks of neighbouring ranges are merged as a tree, a
    few ranges per task. No task and not the driver sees points, but the blocks left of them.
    """
    spark = points.sparkSession
    ranges = points.repartitionByRange("score").sortWithinPartitions("score").withColumn("part", F.spark_partition_id())
    rows = ranges.select("part", F.col("score").alias("first"), F.col("score").alias("last"), "total", "weight")
    blocks = settle(rows.mapInPandas(_pooled, f"{_BLOCKS}, part long"))
    top = blocks.agg(F.max("part")).first()[0] or 0
    while top > 0:
        blocks = settle(blocks.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(_merged, f"{_BLOCKS}, part long"))
        top //= FAN_IN
    return blocks.drop("part") if blocks.columns else spark.createDataFrame([], _BLOCKS)


def fit_calibration(df: DataFrame, score_col: str, label: str) -> Calibration:
    """Isotonic map from score to probability, fitted on one weighted point per distinct score.

    Rows without a score or a label are left out; without any row there is nothing to fit.
    """
    score_of, y = F.col(score_col).cast("double"), F.col(label).cast("double")
    known = df.select((score_of + F.lit(0.0)).alias("score"), y.alias("y")).where("score is not null and not isnan(score) and y is not null")
    points = known.groupBy("score").agg(F.sum("y").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    rows = isotonic_blocks(points).orderBy("first").collect()
    if not rows:
        raise ValueError("no row has a score and a label")
    ends = [(e, r["total"] / r["weight"]) for r in rows for e in dict.fromkeys((r["first"], r["last"]))]
    return Calibration([e for e, _ in ends], [v for _, v in ends])


def apply_calibration(model: Calibration, df: DataFrame, score_col: str, out: str = "calibrated") -> DataFrame:
    """Interpolated between fitted points and constant outside them; without a score there is no value."""
    scores, values = np.array(model.scores), np.array(model.values)

    @F.pandas_udf("double")
    def calibrated(score: pd.Series) -> pd.Series:
        return pd.Series(np.interp(score, scores, values), index=score.index).where(score.notna())

    return df.withColumn(out, calibrated(F.col(score_col).cast("double")))


@dataclass
class SavedModel:
    model: PipelineModel
    threshold: float
    metrics: dict[str, float]


def save_model(model: PipelineModel, path: str, threshold: float, metrics: dict[str, float]) -> None:
    """The model plus one row with its decision threshold and metrics."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    row = [(float(threshold), {k: float(v) for k, v in metrics.items()})]
    spark.createDataFrame(row, "threshold double, metrics map<string,double>").write.mode("overwrite").json(f"{path}/meta")


def load_model(path: str) -> SavedModel:
    meta = SparkSession.active().read.schema("threshold double, metrics map<string,double>").json(f"{path}/meta").first()
    return SavedModel(PipelineModel.load(f"{path}/model"), meta["threshold"], dict(meta["metrics"] or {}))
