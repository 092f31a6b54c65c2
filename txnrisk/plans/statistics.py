"""Section I: feature statistics and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators import iv, models, stats
from txnrisk.operators.aggregates import outcome
from txnrisk.operators.graph import degree_ratio, fan_degrees
from txnrisk.plans.aggregates import rounded
from txnrisk.plans.registry import q, register, sq, with_scores, with_transfers
from txnrisk.sources.canonical import line_scores, transfers

IV_COLS = ["amount", "from_bank", "to_bank", "payment_format", "l_quantity", "l_tax", "gappy"]
_NUM = ["amount", "from_bank", "to_bank", "l_quantity", "gappy"]
_CAT = ["payment_format", "l_tax"]
# l_tax has 9 distinct values, so it is a category per value; gappy has nulls, which binning drops.
IV_BASE = """b AS (SELECT amount::DOUBLE AS amount, from_bank::DOUBLE AS from_bank, to_bank::DOUBLE AS to_bank, payment_format, l_quantity, l_tax,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity END AS gappy, is_fraud FROM transfers),
tot AS (SELECT count(*) FILTER (is_fraud = 1)::DOUBLE AS e, count(*) FILTER (is_fraud = 0)::DOUBLE AS o FROM b)"""
QS = "[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]"


def _binned_sql(c):
    """Quantile bins for more than ten distinct values, else a category per value."""
    edges = f"(SELECT list_sort(list_distinct(quantile_cont({c}, {QS}))) FROM b)"
    many = f"(SELECT count(DISTINCT {c}) > 10 FROM b)"
    number = f"CASE WHEN {many} THEN greatest(1, len(list_filter({edges}, lambda x: x < {c}))) END"
    return (
        f"SELECT '{c}' AS v, coalesce(CAST({number} AS VARCHAR), CAST({c} AS VARCHAR), '**MISSING**') AS bin, "
        f"{number} AS bin_no, {c} AS val, is_fraud FROM b WHERE {c} IS NOT NULL OR NOT {many}"
    )


def _cat_sql(c):
    return f"SELECT '{c}' AS v, coalesce(CAST({c} AS VARCHAR), '**MISSING**') AS bin, NULL AS bin_no, NULL AS val, is_fraud FROM b"


_LONG = "lng AS (" + " UNION ALL ".join([_binned_sql(c) for c in _NUM] + [_cat_sql(c) for c in _CAT]) + ")"
_UNIQ = "uniq AS (" + " UNION ALL ".join(f"SELECT '{c}' AS v, count(DISTINCT {c}) AS u FROM b" for c in _NUM + _CAT) + ")"
_CT = "ct AS (SELECT v, bin, any_value(bin_no) AS bin_no, min(val) AS low, max(val) AS high, count(*) FILTER (is_fraud = 1)::DOUBLE AS e, count(*) FILTER (is_fraud = 0)::DOUBLE AS o FROM lng GROUP BY 1, 2)"
_W = "w AS (SELECT ct.*, (ct.e + 0.5) / (tot.e + 1.0::DOUBLE) AS a, (ct.o + 0.5) / (tot.o + 1.0::DOUBLE) AS b, greatest(-5::DOUBLE, least(5::DOUBLE, ln(((ct.e + 0.5) / (tot.e + 1.0::DOUBLE)) / ((ct.o + 0.5) / (tot.o + 1.0::DOUBLE))))) AS woe FROM ct, tot)"
_IV = "ivt AS (SELECT w.v AS variable, least(10.0::DOUBLE, sum((a - b) * woe)) AS iv, any_value(u) AS unique_values FROM w JOIN uniq ON w.v = uniq.v WHERE e + o >= 10 GROUP BY 1)"


def _base(spark, sf_dir):
    gap = F.when(F.col("l_partkey") % 13 == 0, None).otherwise(F.col("l_quantity"))
    return transfers(spark, sf_dir).withColumn("gappy", gap).select(*IV_COLS, "is_fraud")


@register(
    "i1_information_value",
    with_transfers(f"SELECT variable, {sq('iv', 8)} AS iv, unique_values, unique_values > 500000 AS is_suspect FROM ivt", IV_BASE, _LONG, _UNIQ, _CT, _W, _IV),
)
def i1(spark, sf_dir):
    out = iv.information_value(_base(spark, sf_dir), "is_fraud", IV_COLS, max_unique=1_000_000)
    return rounded(out, "iv", digits=8)


@register(
    "i1_default_settings",
    with_transfers(f"SELECT variable, {sq('iv', 8)} AS iv, unique_values, unique_values > 500 AS is_suspect FROM ivt WHERE unique_values BETWEEN 2 AND 1000", IV_BASE, _LONG, _UNIQ, _CT, _W, _IV),
)
def i1_default(spark, sf_dir):
    return rounded(iv.information_value(_base(spark, sf_dir), "is_fraud", IV_COLS), "iv", digits=8)


@register(
    "i1_skipped_columns",
    with_transfers("SELECT v AS variable, CASE WHEN u > 8 THEN 'high_cardinality' ELSE 'constant' END AS reason, u AS unique_values FROM uniq WHERE u > 8 OR u <= 1", IV_BASE, _LONG, _UNIQ),
)
def i1_skipped(spark, sf_dir):
    return iv.skipped_columns(_base(spark, sf_dir), "is_fraud", IV_COLS, max_unique=8)


@register(
    "i2_weight_of_evidence",
    with_transfers(f"SELECT bin AS label, bin_no::DOUBLE AS bin, e::BIGINT AS events, o::BIGINT AS others, {sq('woe', 8)} AS woe FROM w WHERE v = 'amount'", IV_BASE, _LONG, _CT, _W),
)
def i2(spark, sf_dir):
    out = iv.weight_of_evidence(_base(spark, sf_dir), "is_fraud", "amount")
    return rounded(out.withColumn("bin", F.col("bin").cast("double")), "woe", digits=8)


@register(
    "i3_predictive_features",
    with_transfers(f"SELECT variable, {sq('iv', 8)} AS iv, unique_values, unique_values > 1000 AS is_suspect FROM ivt WHERE iv >= 0.0005 AND unique_values <= 1000", IV_BASE, _LONG, _UNIQ, _CT, _W, _IV),
)
def i3(spark, sf_dir):
    table = iv.information_value(_base(spark, sf_dir), "is_fraud", IV_COLS, max_unique=2000)
    return rounded(iv.predictive_features(table, 0.0005), "iv", digits=8)


@register(
    "i4_monotonicity",
    with_transfers(
        """SELECT v AS variable, coalesce(bool_and(d >= 0), true) OR coalesce(bool_and(d <= 0), true) AS is_monotonic FROM
(SELECT v, woe - lag(woe) OVER (PARTITION BY v ORDER BY low) AS d FROM w WHERE low IS NOT NULL) GROUP BY 1""",
        IV_BASE, _LONG, _CT, _W,
    ),
)
def i4(spark, sf_dir):
    return iv.is_monotonic(_base(spark, sf_dir), "is_fraud", _NUM)


@register(
    "i5_value_by_bins",
    with_transfers(
        f"SELECT CAST(bin_no AS INT) AS bin, low, high, CAST(e + o AS BIGINT) AS count, {sq('e / (e + o)', 8)} AS fraud_rate, {sq('woe', 8)} AS woe, {sq('(a - b) * woe', 8)} AS iv FROM w WHERE v = 'amount' AND e + o >= 5",
        IV_BASE, _LONG, _CT, _W,
    ),
)
def i5(spark, sf_dir):
    return rounded(iv.value_by_bins(_base(spark, sf_dir), "is_fraud", "amount"), "fraud_rate", "woe", "iv", digits=8)


@register(
    "i6_unsmoothed_value",
    with_transfers(
        f"""SELECT variable, {sq('iv', 8)} AS iv, unique_values, false AS is_suspect FROM (SELECT ct.v AS variable, any_value(u) AS unique_values,
 sum((greatest(ct.e / tot.e, CASE WHEN ct.e = 0 THEN 0.0001 ELSE 0 END) - greatest(ct.o / tot.o, CASE WHEN ct.o = 0 THEN 0.0001 ELSE 0 END))
  * ln(greatest(ct.e / tot.e, CASE WHEN ct.e = 0 THEN 0.0001 ELSE 0 END) / greatest(ct.o / tot.o, CASE WHEN ct.o = 0 THEN 0.0001 ELSE 0 END))) AS iv
FROM ct JOIN uniq ON ct.v = uniq.v, tot GROUP BY 1)""",
        IV_BASE, _LONG, _UNIQ, _CT,
    ),
)
def i6(spark, sf_dir):
    out = iv.information_value(
        _base(spark, sf_dir), "is_fraud", IV_COLS, max_unique=1_000_000, min_samples=1, smoothed=False
    )
    return rounded(out, "iv", digits=8)


_DEG = """deg AS (SELECT is_fraud, fo.n::DOUBLE AS fan_out_degree, fi.n::DOUBLE AS fan_in_degree FROM transfers
 JOIN (SELECT source, count(DISTINCT target) AS n FROM transfers GROUP BY 1) fo USING (source)
 JOIN (SELECT target, count(DISTINCT source) AS n FROM transfers GROUP BY 1) fi USING (target)),
b AS (SELECT *, is_fraud AS y FROM deg),
tot AS (SELECT count(*) FILTER (is_fraud = 1)::DOUBLE AS e, count(*) FILTER (is_fraud = 0)::DOUBLE AS o FROM b)"""
_DEG_COLS = ["fan_out_degree", "fan_in_degree"]


@register(
    "i7_pattern_value",
    with_transfers(
        f"SELECT variable, {sq('iv', 8)} AS iv, unique_values, unique_values > 500 AS is_suspect FROM ivt",
        _DEG,
        "lng AS (" + " UNION ALL ".join(_binned_sql(c) for c in _DEG_COLS) + ")",
        "uniq AS (" + " UNION ALL ".join(f"SELECT '{c}' AS v, count(DISTINCT {c}) AS u FROM b" for c in _DEG_COLS) + ")",
        _CT, _W, _IV,
    ),
)
def i7(spark, sf_dir):
    rows = fan_degrees(transfers(spark, sf_dir)).select("is_fraud", "amount", *_DEG_COLS)
    return rounded(iv.pattern_information_value(rows, "is_fraud"), "iv", digits=8)


def _iqr_sql(c):
    return f"""SELECT '{c}' AS "column", {sq('lo')} AS lower, {sq('hi')} AS upper, count(*) FILTER ({c} < lo OR {c} > hi) AS outliers,
{sq(f'avg(CAST({c} < lo OR {c} > hi AS INT)) * 100', 6)} AS outlier_pct FROM transfers, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM transfers)) GROUP BY lo, hi"""


@register("i8_iqr_outliers", with_transfers(" UNION ALL ".join(_iqr_sql(c) for c in ("amount", "l_quantity", "l_discount"))))
def i8(spark, sf_dir):
    out = stats.iqr_outliers(transfers(spark, sf_dir), ["amount", "l_quantity", "l_discount"])
    return rounded(rounded(out, "lower", "upper"), "outlier_pct", digits=6)


@register(
    "i9_extreme_amounts",
    with_transfers(
        f"""SELECT {sq('t')} AS threshold, count(*) FILTER (amount > t) AS large_count, {sq('avg(CAST(amount > t AS INT)) * 100', 6)} AS large_pct,
count(*) FILTER (from_bank = to_bank) AS same_bank_count, {sq('avg(CAST(from_bank = to_bank AS INT)) * 100', 6)} AS same_bank_pct
FROM transfers, (SELECT quantile_cont(amount, 0.999) AS t FROM transfers) GROUP BY t"""
    ),
)
def i9(spark, sf_dir):
    out = stats.extreme_amounts(transfers(spark, sf_dir), "amount", "from_bank", "to_bank")
    return rounded(rounded(out, "threshold"), "large_pct", "same_bank_pct", digits=6)


_COR = ["amount", "from_bank", "to_bank", "l_quantity", "l_discount", "l_tax", "is_fraud"]


@register(
    "i10_correlations",
    with_transfers(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {sq(f'corr({a}, {b})', 8)} AS r FROM transfers" for i, a in enumerate(_COR) for b in _COR[i + 1 :])),
)
def i10(spark, sf_dir):
    return rounded(stats.correlation_matrix(transfers(spark, sf_dir), _COR), "r", digits=8)


@register(
    "i10_strong_pairs",
    with_scores(f"SELECT * FROM (SELECT 'score' AS a, 'score_int' AS b, {sq('corr(score, score_int)', 8)} AS r FROM scores UNION ALL SELECT 'score', 'score_b', {sq('corr(score, score_b)', 8)} FROM scores UNION ALL SELECT 'score_int', 'score_b', {sq('corr(score_int, score_b)', 8)} FROM scores) WHERE abs(r) > 0.8"),
)
def i10_strong(spark, sf_dir):
    m = stats.correlation_matrix(line_scores(spark, sf_dir), ["score", "score_int", "score_b"])
    return rounded(stats.strong_pairs(m), "r", digits=8)


_TWO = ["amount", "l_quantity", "from_bank", "l_tax"]


def _ks_sql(c, cond1, cond0, source):
    return f"""SELECT '{c}' AS "column", max(n1) AS n1, max(n0) AS n0, {sq('max(abs(c1::DOUBLE / n1 - c0::DOUBLE / n0))', 8)} AS ks FROM
(SELECT DISTINCT {c}, count(*) FILTER ({cond1}) OVER (ORDER BY {c}) AS c1, count(*) FILTER ({cond0}) OVER (ORDER BY {c}) AS c0,
 count(*) FILTER ({cond1}) OVER () AS n1, count(*) FILTER ({cond0}) OVER () AS n0 FROM {source})"""


@register("i11_ks_two_sample", with_transfers(" UNION ALL ".join(_ks_sql(c, "is_fraud = 1", "is_fraud = 0", "transfers") for c in _TWO)))
def i11(spark, sf_dir):
    return rounded(stats.ks_two_sample(transfers(spark, sf_dir), _TWO, "is_fraud").drop("p_value"), "ks", digits=8)


def _mw_sql(c):
    return f"""SELECT '{c}' AS "column", {sq('u', 2)} AS u, {sq('sign(u - n1 * n0 / 2) * greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - tie / ((n1 + n0) * (n1 + n0 - 1))))', 6)} AS z FROM (
SELECT sum(r) FILTER (is_fraud = 1) - any_value(n1) * (any_value(n1) + 1) / 2 AS u, any_value(n1) AS n1, any_value(n0) AS n0, sum(t * t - 1) AS tie FROM
(SELECT is_fraud, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r, (count(*) OVER (PARTITION BY {c}))::DOUBLE AS t,
 (count(*) FILTER (is_fraud = 1) OVER ())::DOUBLE AS n1, (count(*) FILTER (is_fraud = 0) OVER ())::DOUBLE AS n0 FROM transfers))"""


@register("i12_mann_whitney", with_transfers(" UNION ALL ".join(_mw_sql(c) for c in _TWO)))
def i12(spark, sf_dir):
    out = stats.mann_whitney(transfers(spark, sf_dir), _TWO, "is_fraud", p_value=False)
    return rounded(rounded(out, "u", digits=2), "z", digits=6)


def _cohen_sql(c):
    return f"""SELECT '{c}' AS "column", {sq('m1')} AS mean1, {sq('m0')} AS mean0, {sq('d', 8)} AS d, CASE WHEN abs(d) > 0.8 THEN 'Strong' WHEN abs(d) > 0.5 THEN 'Medium' ELSE 'Weak' END AS effect
FROM (SELECT m1, m0, (m1 - m0) / sqrt((s1 * s1 + s0 * s0) / 2) AS d FROM (SELECT avg({c}) FILTER (is_fraud = 1) AS m1, avg({c}) FILTER (is_fraud = 0) AS m0,
stddev_samp({c}) FILTER (is_fraud = 1) AS s1, stddev_samp({c}) FILTER (is_fraud = 0) AS s0 FROM transfers))"""


@register("i13_cohens_d", with_transfers(" UNION ALL ".join(_cohen_sql(c) for c in [*_TWO, "l_discount"])))
def i13(spark, sf_dir):
    out = stats.cohens_d(transfers(spark, sf_dir), [*_TWO, "l_discount"], "is_fraud")
    return rounded(rounded(out, "mean1", "mean0"), "d", digits=8)


@register(
    "i14_class_histogram",
    with_scores(
        f"""SELECT label, bucket, {sq('lo + bucket * w')} AS low, count(*) AS count, {sq('count(*) / any_value(t) / w', 10)} AS density FROM
(SELECT label, CAST(least(19, floor((amount - lo) / w)) AS INT) AS bucket, lo, w, (count(*) OVER (PARTITION BY label))::DOUBLE AS t FROM scores,
(SELECT min(amount) AS lo, (max(amount) - min(amount)) / 20 AS w FROM scores)) GROUP BY label, bucket, lo, w"""
    ),
)
def i14(spark, sf_dir):
    out = stats.class_histogram(line_scores(spark, sf_dir), "amount", "label")
    return rounded(rounded(out, "low"), "density", digits=10)


@register("i15_principal_components")
def i15(spark, sf_dir):
    return stats.principal_components(transfers(spark, sf_dir), ["amount", "from_bank", "to_bank", "l_quantity", "l_discount", "l_tax"], "is_fraud")


def _side(y):
    return f"abs(avg(a + sign(r) * b) FILTER (is_fraud = {y}) / sqrt(2)) AS f{y}, abs(avg(a - sign(r) * b) FILTER (is_fraud = {y}) / sqrt(2)) AS s{y}"


@register(
    "i15_two_components",
    with_transfers(
        f"""SELECT component, {sq('explained', 8)} AS explained, {sq('cumulative', 8)} AS cumulative, {sq('m1', 6)} AS class1_mean, {sq('m0', 6)} AS class0_mean FROM (
SELECT 1 AS component, (1 + abs(r)) / 2 AS explained, (1 + abs(r)) / 2 AS cumulative, f1 AS m1, f0 AS m0 FROM w UNION ALL SELECT 2, (1 - abs(r)) / 2, 1, s1, s0 FROM w)""",
        f"""z AS (SELECT is_fraud, (amount - avg(amount) OVER ()) / stddev_pop(amount) OVER () AS a, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS b,
 corr(amount, l_quantity) OVER () AS r FROM transfers),
w AS (SELECT any_value(r) AS r, {_side(1)}, {_side(0)} FROM (SELECT *, r FROM z))""",
    ),
)
def i15_two(spark, sf_dir):
    """Two standardised columns: the components are their sum and difference, whatever the data; signs are free."""
    out = stats.principal_components(transfers(spark, sf_dir), ["amount", "l_quantity"], "is_fraud")
    means = {c: q(F.abs(c), 6) for c in ("class1_mean", "class0_mean")}
    return out.withColumns({"explained": q("explained", 8), "cumulative": q("cumulative", 8), **means})


def _diff_sql(c, a, b):
    m = lambda o: f"avg({c}) FILTER (outcome = '{o}')"
    s = lambda o: f"stddev_samp({c}) FILTER (outcome = '{o}')"
    return f"""SELECT '{c}' AS "column", {sq(m(a))} AS mean_a, {sq(m(b))} AS mean_b, {sq(s(a))} AS std_a, {sq(s(b))} AS std_b,
{sq(f'abs({m(a)} - {m(b)})')} AS abs_diff, {sq(f'({m(a)} - {m(b)}) / abs({m(b)}) * 100')} AS pct_diff FROM o"""


_OUT = "o AS (SELECT *, CASE WHEN score >= 0.6 AND label = 1 THEN 'TP' WHEN score >= 0.6 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM scores)"


@register("i16_false_positive_differences", with_scores(" UNION ALL ".join(_diff_sql(c, "FP", "TN") for c in ("amount", "score", "score_b")), _OUT))
def i16(spark, sf_dir):
    rows = line_scores(spark, sf_dir).withColumn("outcome", outcome("score", "label", 0.6))
    out = stats.outcome_differences(rows, ["amount", "score", "score_b"], "outcome", "FP", "TN")
    return rounded(out, "mean_a", "mean_b", "std_a", "std_b", "abs_diff", "pct_diff")


@register("i16_false_negative_differences", with_scores(" UNION ALL ".join(_diff_sql(c, "FN", "TP") for c in ("amount", "score", "score_b")), _OUT))
def i16_fn(spark, sf_dir):
    rows = line_scores(spark, sf_dir).withColumn("outcome", outcome("score", "label", 0.6))
    out = stats.outcome_differences(rows, ["amount", "score", "score_b"], "outcome", "FN", "TP")
    return rounded(out, "mean_a", "mean_b", "std_a", "std_b", "abs_diff", "pct_diff")


@register("i17_forest_selection")
def i17(spark, sf_dir):
    rows = degree_ratio(transfers(spark, sf_dir))
    cols = ["amount", "from_bank", "to_bank", "l_quantity", "l_discount", "l_tax", "degree_ratio"]
    return models.forest_selection(rows, cols, "is_fraud", top_n=4)


@register(
    "i17_informative_column",
    with_transfers(
        """SELECT variable, CASE WHEN u > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance, CAST(row_number() OVER (ORDER BY u > 1 DESC, variable) AS INT) AS rank FROM (
SELECT 'code' AS variable, count(DISTINCT payment_format) AS u FROM transfers UNION ALL SELECT 'steady', count(DISTINCT 1) FROM transfers UNION ALL SELECT 'still', count(DISTINCT 2) FROM transfers)"""
    ),
)
def i17_informative(spark, sf_dir):
    """Of one column that varies and two that don't, the first has all the importance."""
    rows = transfers(spark, sf_dir).select("is_fraud", F.substring("payment_format", 1, 1).cast("int").alias("code"), F.lit(1).alias("steady"), F.lit(2).alias("still"))
    out = models.forest_selection(rows, ["still", "steady", "code"], "is_fraud", top_n=3, numTrees=3, maxDepth=4)
    return out.withColumn("importance", q("importance", 8))


@register(
    "i18_leakage_screen",
    with_scores(
        " UNION ALL ".join(
            f'SELECT "column", ks, ks > 0.02 AS is_leaky FROM ({_ks_sql(c, "is_test = 1", "is_test = 0", "s")})' for c in ("amount", "score", "score_b")
        ),
        "s AS (SELECT *, CAST(timestamp >= TIMESTAMP '1999-01-01' AS INT) AS is_test FROM scores)",
    ),
)
def i18(spark, sf_dir):
    late = F.col("timestamp") >= F.lit("1999-01-01").cast("timestamp_ntz")
    rows = line_scores(spark, sf_dir).withColumn("split", F.when(late, "test").otherwise("train"))
    return rounded(stats.leakage_screen(rows, ["amount", "score", "score_b"], "split", 0.02), "ks", digits=8)
