"""Classification and calibration metrics from (label, probability) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import quantiles, running_sums


def _c(name: str) -> Column:
    return F.col(name)


def confusion(matched: DataFrame, trades: DataFrame) -> DataFrame:
    """Counts and rates of matching; ``accuracy`` is tp / (tp + fp + fn)."""
    m = matched.agg(F.count_if("is_match").alias("tp"), F.count(F.lit(1)).alias("predicted_events"))
    t = trades.agg(F.count(F.lit(1)).alias("actual_events"))
    tp, fp = _c("tp"), _c("predicted_events") - _c("tp")
    fn = _c("actual_events") - _c("tp")
    return m.join(F.broadcast(t)).select(  # one row each
        tp.alias("matched_events"), "predicted_events", "actual_events", fp.alias("fp"), fn.alias("fn"),
        F.coalesce(F.try_divide(tp, tp + fp + fn), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
    )


def auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """ROC-AUC with tied scores counted half, average precision and Brier score.

    Scores are reduced to distinct values before the ordered pass.
    """
    counts = df.groupBy(_c(p).alias("score")).agg(
        F.sum(_c(y)).alias("pos"), F.sum(1 - _c(y)).alias("neg"), F.sum(F.pow(_c(p) - _c(y), 2)).alias("_se")
    ).withColumn("_neg_score", -_c("score"))
    run = running_sums(counts, [], ["_neg_score"], {"tp": _c("pos"), "fp": _c("neg")})
    # Descending scores: positives at this score beat all negatives still to come.
    out = run.agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(_c("pos") * (-_c("fp") + _c("neg") / 2.0)).alias("_part"),
        F.sum(_c("pos") * _c("tp") / (_c("tp") + _c("fp"))).alias("_ap"),
        F.sum("_se").alias("_se"),
    )
    P, N = _c("P"), _c("N")
    both = (P > 0) & (N > 0)
    return out.select(
        F.when(both, (_c("_part") + P * N) / (P * N)).alias("roc_auc"),
        F.when(both, _c("_ap") / P).alias("pr_auc"),
        (_c("_se") / (P + N)).alias("brier_score"),
    )


def _bin(p: Column, bins: int) -> Column:
    """Right-closed equal bins of (0, 1]; 0 falls in the first."""
    return F.greatest(F.lit(0), F.ceil(p * bins).cast("int") - 1)


def reliability(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    return df.groupBy(_bin(_c(p), bins).alias("bin")).agg(
        F.avg(_c(y)).alias("prob_true"), F.avg(p).alias("prob_pred"), F.count(F.lit(1)).alias("n")
    )


def calibration_error(curve: DataFrame) -> DataFrame:
    return curve.agg(
        (F.sum(F.abs(_c("prob_true") - _c("prob_pred")) * _c("n")) / F.sum("n")).alias("ece")
    )


def conformal_coverage(df: DataFrame, recent: DataFrame, p: str) -> DataFrame:
    """Share of probabilities between the 5 % and 95 % quantiles of recent ones."""
    bounds = quantiles(recent, [], p, {"lower": 0.05, "upper": 0.95})
    rows = df.filter(_c(p).isNotNull()).join(F.broadcast(bounds))  # one row
    return rows.agg(
        F.max("lower").alias("conformal_lower"), F.max("upper").alias("conformal_upper"),
        F.avg(_c(p).between(_c("lower"), _c("upper")).cast("double")).alias("conformal_coverage"),
    )


def per_model_counts(matched: DataFrame, model: str) -> DataFrame:
    return matched.filter(_c(model).isNotNull()).groupBy(model).agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if("is_match").alias("matches")
    )
