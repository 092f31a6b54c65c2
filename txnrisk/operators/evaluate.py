"""Evaluation of scored tables (key, score, label).

Threshold curves start from counts per distinct score, so ties are one point and the
running totals run over distinct scores. ``keys`` evaluates many models, folds or
segments in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.joins import align_rows, thresholds_met
from txnrisk.operators.ordering import WINDOW_ROWS, as_columns, attach, running_sum
from txnrisk.operators.selection import cut_ranks, leading_number
from txnrisk.session import settle, stored

# Costs of a false and a missed alert, and the regulatory limits.
FP_COST, FN_COST = 1.0, 100.0
MIN_RECALL, MAX_FLAGGED = 0.8, 0.05
# Weights of the composite score.
COMPLIANT_POINTS, RECALL_POINTS, COST_POINTS, PRECISION_POINTS = 1000.0, 100.0, 50.0, 25.0


def ratio(n: Column, d: Column) -> Column:
    """0 when the denominator is 0."""
    return F.when(d != 0, n / F.nullif(d.cast("double"), F.lit(0.0))).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and the rates derived from them, one row per key."""
    hit, bad = F.col(score) >= threshold, F.col(label) == 1
    counts = df.groupBy(*keys).agg(
        F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"),
        F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision": p,
            "recall": r,
            "f1": _f1(p, r),
            "specificity": ratio(tn, tn + fp),
            "false_discovery_rate": ratio(fp, tp + fp),
            "alerts_per_fraud": ratio(tp + fp, tp),
        }
    )


def curve(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), limit: int = WINDOW_ROWS) -> DataFrame:
    """keys..., score, p, n at the score; cum_tp, cum_fp at or above it; totals pos, neg."""
    keys = list(keys)
    counts = settle(
        df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(
            F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")
        )
    )
    totals = counts.groupBy(*keys).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    run = running_sum(counts, keys, [F.col("score").desc()], {"cum_tp": F.col("p"), "cum_fp": F.col("n")}, limit)
    return attach(run, totals, keys)


def curve_metrics(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average precision, trapezoidal precision-recall area and ROC area from a curve.

    The previous point follows from the point's own counts, so plain sums are enough.
    """
    tp, fp, p, n = (F.col(c).cast("double") for c in ("cum_tp", "cum_fp", "p", "n"))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    precision = tp / F.nullif(tp + fp, F.lit(0.0))
    seen_before = tp + fp - p - n
    before = F.when(seen_before > 0, (tp - p) / F.nullif(seen_before, F.lit(0.0))).otherwise(1.0)
    step = p / F.nullif(pos, F.lit(0.0))
    return points.groupBy(*keys).agg(
        F.first("pos").alias("positives"),
        F.first("neg").alias("negatives"),
        F.coalesce(F.sum(step * precision), F.lit(0.0)).alias("average_precision"),
        F.coalesce(F.sum(step * (precision + before) / 2), F.lit(0.0)).alias("pr_auc"),
        F.sum(n * (tp - p + p / 2) / F.nullif(pos * neg, F.lit(0.0))).alias("roc_auc"),
    )


def ranking_metrics(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), limit: int = WINDOW_ROWS) -> DataFrame:
    return curve_metrics(curve(df, score, label, keys, limit), keys)


def curve_table(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys..., threshold, tpr, fpr, precision, recall per distinct score."""
    tp, fp = F.col("cum_tp"), F.col("cum_fp")
    recall = ratio(tp, F.col("pos"))
    return points.select(
        *keys, F.col("score").alias("threshold"), recall.alias("tpr"), ratio(fp, F.col("neg")).alias("fpr"),
        ratio(tp, tp + fp).alias("precision"), recall.alias("recall"),
    )


def youden(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest TPR - FPR; the highest one on ties."""
    rows = curve_table(points, keys).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = F.min(F.struct((-F.col("j")).alias("a"), (-F.col("threshold")).alias("b"), "tpr", "fpr")).alias("_b")
    picked = rows.groupBy(*keys).agg(best)
    return picked.select(
        *keys, (-F.col("_b.b")).alias("optimal_threshold"), F.col("_b.tpr").alias("tpr"),
        F.col("_b.fpr").alias("fpr"), (-F.col("_b.a")).alias("j_score"),
    )


def recall_at_fpr(points: DataFrame, max_fpr: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    rows = curve_table(points, keys)
    return rows.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("fpr") <= max_fpr, F.col("tpr"))), F.lit(0.0)).alias("recall_at_fpr")
    )


def precision_near_recall(points: DataFrame, target: float = 0.8, keys: Sequence[str] = ()) -> DataFrame:
    """Precision at the curve point whose recall is nearest the target (higher score first)."""
    rows = curve_table(points, keys)
    near = F.struct(F.abs(F.col("recall") - target), -F.col("threshold"))
    return rows.groupBy(*keys).agg(
        F.min_by("precision", near).alias("precision"), F.min_by("recall", near).alias("recall"),
        F.min_by("threshold", near).alias("threshold"),
    )


def best_f1_point(points: DataFrame, keys: Sequence[str] = (), guard: float = 1e-10) -> DataFrame:
    """Precision and recall at the largest guarded F1; the lowest threshold on ties."""
    rows = curve_table(points, keys)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + guard)
    lead = F.struct((-f1).alias("f"), F.col("threshold"))
    return rows.groupBy(*keys).agg(F.min_by("precision", lead).alias("precision"), F.min_by("recall", lead).alias("recall"))


def _hits(
    df: DataFrame, score: str, label: str, order: Sequence, cuts: Sequence[Column], keys: Sequence[str], limit: int
) -> DataFrame:
    """keys..., _n, _pos, _hits: positives among the first rows by score, per ascending cut (of the size ``n``)."""
    by_score = [F.col(score).desc(), *as_columns(order)]
    lead = leading_number(df, score, descending=True)
    if lead is None:
        raise TypeError(f"{score} is not a number")
    # every pass reads the score from files, none computes it again
    names = [*keys, score, label, *[c for c in order if isinstance(c, str)]]
    if all(isinstance(c, str) for c in order):
        df = stored(df.select(*dict.fromkeys(names)))
    placed = cut_ranks(df, keys, by_score, lead, cuts, "_cut", limit)
    y = (F.col(label) == 1).cast("int")
    return placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_pos"),
        F.array(*[F.sum(F.when(F.col("_cut") <= k, y).otherwise(0)) for k in range(len(cuts))]).alias("_hits"),
    )


def metrics_at_k(
    df: DataFrame, score: str, label: str, ks: Sequence[int], order: Sequence, keys: Sequence[str] = (), limit: int = WINDOW_ROWS
) -> DataFrame:
    """keys..., k, hits, precision, recall; a k above the number of rows becomes that number."""
    keys = list(keys)
    ks = sorted({int(k) for k in ks})
    base = _hits(df, score, label, order, [F.lit(k).cast("long") for k in ks], keys, limit)
    rows = [F.struct(F.least(F.lit(k).cast("long"), F.col("_n")).alias("k"), F.col("_hits")[i].alias("hits")) for i, k in enumerate(ks)]
    flat = base.select(*keys, "_pos", F.inline(F.array_distinct(F.array(*rows))))
    return flat.select(*keys, "k", "hits", ratio(F.col("hits"), F.col("k")).alias("precision"), ratio(F.col("hits"), F.col("_pos")).alias("recall"))


def metrics_at_share(
    df: DataFrame, score: str, label: str, order: Sequence, shares: Sequence[float] = (0.01, 0.05, 0.1, 0.2, 0.5),
    keys: Sequence[str] = (), limit: int = WINDOW_ROWS,
) -> DataFrame:
    """keys..., share, k, hits, precision, recall at the top share of rows, at least one row."""
    keys = list(keys)
    shares = sorted({float(s) for s in shares})
    cut = lambda n, s: F.greatest(F.lit(1), F.floor(F.col(n) * F.lit(s))).cast("long")
    base = _hits(df, score, label, order, [cut("n", s) for s in shares], keys, limit)
    rows = [F.struct(F.lit(s).alias("share"), cut("_n", s).alias("k"), F.col("_hits")[i].alias("hits")) for i, s in enumerate(shares)]
    flat = base.select(*keys, "_pos", F.inline(F.array(*rows)))
    return flat.select(*keys, "share", "k", "hits", ratio(F.col("hits"), F.col("k")).alias("precision"), ratio(F.col("hits"), F.col("_pos")).alias("recall"))


def alert_efficiency(
    df: DataFrame, score: str, label: str, order: Sequence, levels: Sequence[float] = (0.5, 0.7, 0.8, 0.9, 0.95),
    keys: Sequence[str] = (), limit: int = WINDOW_ROWS,
) -> DataFrame:
    """keys..., level, n_alerts, alert_rate, achieved: alerts needed to find a share of the positives."""
    keys = list(keys)
    by_score = [F.col(score).desc(), *as_columns(order)]
    y = (F.col(label) == 1).cast("long")
    walked = settle(running_sum(df, keys, by_score, {"_tp": y, "_alerts": F.lit(1)}, limit).select(*keys, "_tp", "_alerts"))
    totals = walked.groupBy(*keys).agg(F.max("_tp").alias("_pos"), F.max("_alerts").alias("_n"))
    rows = attach(walked, totals, keys)
    goals = [F.floor(F.col("_pos") * F.lit(float(e))) for e in levels]
    first = [F.min(F.when(F.col("_tp") >= g, F.struct("_alerts", "_tp"))).alias(f"_a{i}") for i, g in enumerate(goals)]
    base = rows.groupBy(*keys).agg(F.first("_n").alias("_n"), F.first("_pos").alias("_pos"), *first)
    flat = base.select(
        *keys, "_n", "_pos",
        F.inline(F.array(*[F.struct(F.lit(float(e)).alias("level"), F.col(f"_a{i}").alias("_at")) for i, e in enumerate(levels)])),
    )
    return flat.filter(F.col("_at").isNotNull()).select(
        *keys, "level", F.col("_at._alerts").alias("n_alerts"), ratio(F.col("_at._alerts"), F.col("_n")).alias("alert_rate"),
        ratio(F.col("_at._tp"), F.col("_pos")).alias("achieved"),
    )


def threshold_table(
    df: DataFrame, score: str, label: str, thresholds: Sequence[float], keys: Sequence[str] = (),
    fp_cost: float = FP_COST, fn_cost: float = FN_COST, min_recall: float = MIN_RECALL, max_flagged: float = MAX_FLAGGED,
) -> DataFrame:
    """Rates, cost, compliance and composite score per threshold."""
    counts = thresholds_met(df, score, label, thresholds, keys)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    flagged = ratio(tp + fp, n)
    cost = fp * F.lit(fp_cost) + fn * F.lit(fn_cost)
    rated = counts.withColumns(
        {
            "recall": r,
            "precision": p,
            "f1": _f1(p, r),
            "flagged_rate": flagged,
            "total_cost": cost,
            "cost_per_transaction": ratio(cost, n),
            "recall_ok": r >= min_recall,
            "flagged_ok": flagged <= max_flagged,
            "compliant": (r >= min_recall) & (flagged <= max_flagged),
        }
    )
    points = (
        F.when(F.col("compliant"), COMPLIANT_POINTS).otherwise(0.0)
        + F.col("recall") * RECALL_POINTS
        + F.greatest(F.lit(0.0), F.lit(1.0) - F.col("cost_per_transaction")) * COST_POINTS
        + F.col("precision") * PRECISION_POINTS
    )
    return rated.withColumn("composite", points)


def best_threshold(table: DataFrame, by: str, keys: Sequence[str] = (), lowest: bool = False) -> DataFrame:
    """The threshold with the best value of a column; the lowest threshold on ties."""
    rest = [c for c in table.columns if c not in keys]
    value = F.col(by) if lowest else -F.col(by)
    picked = table.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(value, F.col("threshold"))).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def cost_curve(points: DataFrame, fp_cost: float = 50.0, fn_cost: float = 5000.0, keys: Sequence[str] = ()) -> DataFrame:
    """keys..., threshold, fp, fn, total_cost, cost_per_transaction at every distinct score."""
    fp, fn = F.col("cum_fp"), F.col("pos") - F.col("cum_tp")
    cost = fp * F.lit(fp_cost) + fn * F.lit(fn_cost)
    return points.select(
        *keys, F.col("score").alias("threshold"), fp.alias("fp"), fn.alias("fn"), cost.alias("total_cost"),
        (cost / (F.col("pos") + F.col("neg"))).alias("cost_per_transaction"),
    )


def choose_model(comparison: DataFrame) -> DataFrame:
    """The compliant model with the best recall, or the best recall overall, with the reason.

    ``comparison`` has one row per model: model, recall, compliant.
    """
    lead = F.struct((~F.col("compliant")).alias("a"), (-F.col("recall")).alias("b"), F.col("model"))
    picked = comparison.agg(F.min_by(F.struct("model", "recall", "compliant"), lead).alias("_m"), F.count_if("compliant").alias("_c"))
    reason = F.when(F.col("_c") == 0, "fallback_recall").when(F.col("_c") == 1, "unique_compliant").otherwise("best_recall_among_compliant")
    return picked.select("_m.model", "_m.recall", "_m.compliant", reason.alias("reason"))


def cheapest_model(comparison: DataFrame, cost: str = "total_cost") -> DataFrame:
    lead = F.struct(cost, "model")
    return comparison.agg(F.min_by("model", lead).alias("model"), F.min(cost).alias(cost))


def compare_models(
    df: DataFrame, model: str, score: str, label: str, baseline: str, threshold: float = 0.5, limit: int = WINDOW_ROWS
) -> DataFrame:
    """One row per model of a long score table, with the gain in average precision over a baseline."""
    areas = ranking_metrics(df, score, label, [model], limit)
    rates = confusion(df, score, label, threshold, [model]).select(F.col(model).alias("_m"), "precision", "recall", "f1")
    rows = areas.join(rates, F.col(model) == F.col("_m")).drop("_m", "positives", "negatives")
    base = areas.filter(F.col(model) == baseline).select("average_precision").scalar()
    gain = (F.col("average_precision") - base) / F.nullif(base, F.lit(0.0)) * 100
    return rows.withColumn("gain_pct", gain)


def normalise_columns(df: DataFrame, cols: Sequence[str], by: str = "minmax") -> DataFrame:
    """Column-wise min-max or maximum scaling of a comparison table."""
    bounds = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    lo = {c: F.lit(bounds[f"lo_{c}"]) for c in cols}
    hi = {c: F.lit(bounds[f"hi_{c}"]) for c in cols}
    if by == "max":
        return df.withColumns({c: F.col(c) / F.nullif(hi[c], F.lit(0.0)) for c in cols})
    return df.withColumns({c: ratio(F.col(c) - lo[c], hi[c] - lo[c]) for c in cols})


def brier(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    gap = F.col(score) - F.col(label)
    return df.groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def reliability(df: DataFrame, score: str, label: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """keys..., bin, n, mean_score, mean_label over equal bins of [0, 1]; 1.0 is in the last."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("mean_label")
    )


def expected_calibration_error(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    gap = F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_label")))
    return table.groupBy(*keys).agg((gap / F.sum("n")).alias("ece"))


def classification_report(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages."""
    c = confusion(df, score, label, threshold).select("tp", "fp", "fn", "tn")
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def line(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        p, r = ratio(hit, hit + wrong), ratio(hit, hit + missed)
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), (hit + missed).alias("support")
        )

    classes = c.select(F.inline(F.array(line("0", tn, fn, fp), line("1", tp, fp, fn))))
    means = ("precision", "recall", "f1")
    macro = classes.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in means], F.sum("support").alias("support"))
    weighted = classes.agg(
        F.lit("weighted avg").alias("class"),
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in means],
        F.sum("support").alias("support"),
    )
    return classes.unionByName(macro).unionByName(weighted)


def evasion(before: DataFrame, after: DataFrame, keys: Sequence[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Share of all positives that only the changed score misses, and the mean drop."""
    changed = after.select(*keys, F.col(score).alias("_after"))
    rows = align_rows(before, changed, keys).filter(F.col(label) == 1)
    caught = F.col(score) >= threshold
    lost = caught & (F.col("_after") < threshold)
    return rows.agg(
        F.count_if(caught).alias("detected"),
        F.count_if(lost).alias("evaded"),
        F.avg(lost.cast("double")).alias("evasion_rate"),
        F.avg(F.col(score) - F.col("_after")).alias("mean_drop"),
    )


def stability(before: DataFrame, after: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    changed = after.select(*keys, F.col(score).alias("_after"))
    gap = F.abs(F.col(score) - F.col("_after"))
    return align_rows(before, changed, keys).agg((1 - F.avg(gap)).alias("stability"), F.max(gap).alias("max_change"))


def segment_table(
    df: DataFrame, segment: str, score: str, label: str, threshold: float = 0.5, min_rows: int = 30, limit: int = WINDOW_ROWS
) -> DataFrame:
    """(segment, size, fraud_rate, roc_auc, average_precision, fpr) of segments with more than ``min_rows`` scored rows.

    Rows without a segment are in none.
    """
    areas = ranking_metrics(df, score, label, [segment], limit)
    rates = confusion(df, score, label, threshold, [segment])
    rows = areas.join(rates.select(F.col(segment).alias("_s"), (1 - F.col("specificity")).alias("fpr")), F.col(segment) == F.col("_s"))
    size = F.col("positives") + F.col("negatives")
    return rows.filter(size > min_rows).select(
        segment, size.alias("size"), (F.col("positives") / size).alias("fraud_rate"), "roc_auc", "average_precision", "fpr"
    )


def segment_parity(
    df: DataFrame, segment: str, score: str, label: str, threshold: float = 0.5, min_rows: int = 30, tolerance: float = 0.05,
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Largest differences of ROC area, average precision and false positive rate between segments."""
    rows = segment_table(df, segment, score, label, threshold, min_rows, limit)
    spread = rows.agg(
        F.count(F.lit(1)).alias("segments"),
        *[(F.max(c) - F.min(c)).alias(f"{c}_gap") for c in ("roc_auc", "average_precision", "fpr")],
    )
    # FAIR looks at the ROC area and the false positive rate
    fair = (F.col("roc_auc_gap") < tolerance) & (F.col("fpr_gap") < tolerance)
    return spread.withColumn("verdict", F.when(fair, "FAIR").otherwise("NEEDS REVIEW"))


def business_value(at_k: DataFrame, case_value: float, review_cost: float) -> DataFrame:
    """Prevented loss, review cost, net value and return for each k of ``metrics_at_k``."""
    prevented, spent = F.col("hits") * F.lit(case_value), F.col("k") * F.lit(review_cost)
    return at_k.select("k", "hits", prevented.alias("prevented_loss"), spent.alias("investigation_cost"), (prevented - spent).alias("net_value"), ratio(prevented - spent, spent).alias("roi"))


def baselines(df: DataFrame, label: str) -> DataFrame:
    """Long form of two reference scores: the prevalence for every row, and the majority class."""
    rate = df.agg(F.avg(label)).scalar()
    prevalence = F.struct(F.lit("random").alias("model"), rate.alias("baseline_score"))
    majority = F.struct(F.lit("majority").alias("model"), F.when(rate >= 0.5, 1.0).otherwise(0.0).alias("baseline_score"))
    return df.select("*", F.inline(F.array(prevalence, majority)))


def ensemble(df: DataFrame, scores: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted mean of several score columns, and the weighted vote of their decisions at 0.5."""
    w = list(weights or [1.0] * len(scores))
    mean = sum((F.col(s) * F.lit(float(x)) for s, x in zip(scores, w)), F.lit(0.0)) / F.lit(float(sum(w)))
    votes = sum(((F.col(s) >= 0.5).cast("int") * F.lit(float(x)) for s, x in zip(scores, w)), F.lit(0.0)) / F.lit(float(sum(w)))
    return df.withColumns({"ensemble_score": mean, "ensemble_vote": (votes >= 0.5).cast("int")})
