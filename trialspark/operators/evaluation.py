"""Classifier and regressor evaluation as Spark aggregations.

Rank statistics work on counts per distinct score with two-level prefix totals, so no task sees all
scores. ``label`` is 1 (positive) or 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trialspark.functions.columns import stable_round
from trialspark.operators.ordered import exact_percentiles, prefix_sums, stratified_order


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 on an empty denominator."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2.0 * tp, 2 * tp + fp + fn)


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve by ranks, ties counting half; NULL with a single class."""
    d = prefix_sums(score_counts(df, label, score), "score", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.max("pos_total") * F.max("neg_total")
    return d.agg((wins / F.nullif(pairs.cast("double"), F.lit(0.0))).alias("roc_auc"),
                 F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def classification_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score taken as threshold (score >= threshold is positive)."""
    d = prefix_sums(score_counts(df, label, score), "score", ["pos", "neg"], descending=True)
    d = d.select(
        F.col("score").alias("threshold"), "pos", "pos_total", "neg_total",
        (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"))
    fn, tn = F.col("pos_total") - F.col("tp"), F.col("neg_total") - F.col("fp")
    return d.select(
        "threshold", "tp", "fp", fn.alias("fn"), tn.alias("tn"), "pos",
        _ratio(F.col("tp"), F.col("pos_total")).alias("recall"),
        _ratio(F.col("fp"), F.col("neg_total")).alias("false_positive_rate"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _f1(F.col("tp"), F.col("fp"), fn).alias("f1_pos"), _f1(tn, fn, F.col("fp")).alias("f1_neg"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    curve = classification_curve(df, label, score)
    step = F.col("pos") / F.nullif((F.col("tp") + F.col("fn")).cast("double"), F.lit(0.0))
    return curve.agg(F.sum(step * F.col("precision")).alias("average_precision"))


def confusion_at(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    return threshold_sweep(df, [threshold], label, score)


def threshold_sweep(
    df: DataFrame, thresholds: Sequence[float], label: str = "label", score: str = "score"
) -> DataFrame:
    """Confusion counts and class metrics per threshold, all thresholds in one pass."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    positive = F.col(label) == 1
    counts = known.agg(
        F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"),
        *[F.count_if(positive & (F.col(score) >= t)).alias(f"tp{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(~positive & (F.col(score) >= t)).alias(f"fp{i}") for i, t in enumerate(thresholds)])
    rows = counts.select("p", "n", F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
        for i, t in enumerate(thresholds)])))
    rows = rows.select("threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"),
                       (F.col("n") - F.col("fp")).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1_pos, f1_neg = _f1(tp, fp, fn), _f1(tn, fn, fp)
    return rows.select(
        "*", _ratio(tp, tp + fp).alias("precision_pos"), _ratio(tp, tp + fn).alias("recall_pos"), f1_pos.alias("f1_pos"),
        _ratio(tn, tn + fn).alias("precision_neg"), _ratio(tn, tn + fp).alias("recall_neg"), f1_neg.alias("f1_neg"),
        ((f1_pos + f1_neg) / 2).alias("f1_macro"), _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def best_threshold(sweep: DataFrame, metric: str = "f1_neg") -> DataFrame:
    """The threshold with the largest metric; the lowest one on a tie."""
    best = F.max_by("threshold", F.struct(F.col(metric), -F.col("threshold")))
    return sweep.agg(best.alias("threshold"), F.max(metric).alias(metric))


def regression_diagnostics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, R2 and bias = mean(actual - predicted), positive when predictions fall short."""
    d = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    r = F.col(actual) - F.col(predicted)
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"),
        (1 - F.avg(r * r) / F.nullif(F.var_pop(actual), F.lit(0.0))).alias("r2"), F.avg(r).alias("bias"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, bin_start, n) over [low, high); values outside go to the first and last bin."""
    width = (high - low) / bins
    index = F.floor((F.col(value) - low) / width)
    b = F.greatest(F.least(index, F.lit(bins - 1)), F.lit(0))
    rows = df.where(F.col(value).isNotNull()).groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("bin", (F.lit(low) + F.col("bin") * width).alias("bin_start"), "n")


def stratified_split(
    df: DataFrame, label: str, id_col: str = "nct_id", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: an exact share of every class, the same rows on every run."""
    d = stratified_order(df, [label], id_col, seed)
    return d.withColumn("is_test", F.col("_pos") < F.round(F.col("_size") * test_share)).drop("_pos", "_size")


def stratified_folds(df: DataFrame, label: str, id_col: str = "nct_id", folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..folds-1, every class spread evenly."""
    d = stratified_order(df, [label], id_col, seed)
    return d.withColumn("fold", (F.col("_pos") % folds).cast("int")).drop("_pos", "_size")


def fold_summary(per_fold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return per_fold.agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (
        ("mean", F.avg), ("std", F.stddev_pop))])


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, exact quartiles and max."""
    from trialspark.operators.ordered import join_on

    known = df.where(F.col(value).isNotNull())
    basic = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    quartiles = exact_percentiles(known, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    return join_on(basic, quartiles, list(by))


def label_coverage(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, labeled rows, their share and the positive rate, per split."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(label).alias("n_labeled"),
        stable_round(F.count(label) / F.count(F.lit(1)), 4).alias("labeled_share"),
        stable_round(F.avg(label), 4).alias("positive_rate"))
