"""Classifier metrics, threshold search, calibration and score distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from .ordering import exact_quantiles, running_totals, with_piece


def _or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _or_zero(2 * tp, 2 * tp + fp + fn)


def log_loss_term(y: Column, p: Column, clip: float) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1.0 - clip)) if clip > 0 else p
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1.0 - q))


def binary_metrics(
    df: DataFrame, y: str, p: str, threshold: float | Column = 0.5, groups: Sequence[str] = (), clip: float = 1e-15
) -> DataFrame:
    """Confusion counts and the metrics built on them, one row per group, in one pass."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    yes, said = F.col(y) == 1, F.col(p) >= t
    agg = df.groupBy(*groups).agg(
        F.count("*").alias("rows"),
        F.count_if(yes & said).alias("tp"),
        F.count_if(~yes & said).alias("fp"),
        F.count_if(yes & ~said).alias("fn"),
        F.count_if(~yes & ~said).alias("tn"),
        F.avg(log_loss_term(F.col(y), F.col(p), clip)).alias("log_loss"),
        F.max(t).alias("threshold"),
    )
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "rows"))
    recall_pos, recall_neg = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return agg.withColumns(
        {
            "label_positive_rate": ratio(tp + fn, n),
            "predicted_positive_rate": ratio(tp + fp, n),
            "accuracy": ratio(tp + tn, n),
            "balanced_accuracy": F.coalesce(
                (recall_pos + recall_neg) / 2.0, recall_pos, recall_neg
            ),
            "precision_positive": _or_zero(tp, tp + fp),
            "recall_positive": F.coalesce(recall_pos, F.lit(0.0)),
            "f1_positive": _f1(tp, fp, fn),
            "precision_negative": _or_zero(tn, tn + fn),
            "recall_negative": F.coalesce(recall_neg, F.lit(0.0)),
            "f1_negative": _f1(tn, fn, fp),
            "macro_f1": (_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2.0,
            "positive_support": tp + fn,
        }
    )


def _by_score(df: DataFrame, y: str, p: str, groups: Sequence[str]) -> DataFrame:
    """Counts per distinct score with running counts from low to high and the totals."""
    counts = df.groupBy(*groups, F.col(p).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    return running_totals(
        with_piece(counts, "score", *groups),
        [F.col("score")],
        {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
        groups,
        totals={"all_pos": "cum_pos", "all_neg": "cum_neg"},
    )


def auc_ap(df: DataFrame, y: str, p: str, groups: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with averaged ties and average precision; null where a class is missing."""
    cum = _by_score(df, y, p, groups)
    tp = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("all_neg") - F.col("cum_neg") + F.col("neg")
    return (
        cum.groupBy(*groups)
        .agg(
            F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)).alias("_rank"),
            F.sum(F.col("pos") * ratio(tp, tp + fp)).alias("_area"),
            F.max("all_pos").alias("_p"),
            F.max("all_neg").alias("_n"),
        )
        .select(
            *groups,
            ratio(F.col("_rank"), F.col("_p") * F.col("_n")).alias("roc_auc"),
            F.when(F.col("_n") > 0, ratio(F.col("_area"), F.col("_p"))).alias("average_precision"),
        )
    )


def threshold_sweep(df: DataFrame, y: str, p: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct score with the best macro-F1; ties go to the one nearest 0.5, then the higher."""
    cum = _by_score(df, y, p, groups)
    tp = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("all_neg") - F.col("cum_neg") + F.col("neg")
    fn, tn = F.col("all_pos") - tp, F.col("all_neg") - fp
    macro = (_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2.0
    best = F.max(
        F.struct(
            F.round(macro, 12).alias("f1"),
            (-F.round(F.abs(F.col("score") - 0.5), 12)).alias("near"),
            F.col("score").alias("score"),
        )
    )
    return (
        cum.groupBy(*groups)
        .agg(best.alias("b"), F.count("*").alias("candidate_thresholds"))
        .select(
            *groups,
            F.col("b.score").alias("best_threshold"),
            F.col("b.f1").alias("best_metric_value"),
            "candidate_thresholds",
        )
    )


def probability_metrics(df: DataFrame, y: str, p: str, groups: Sequence[str] = (), clip: float = 1e-6) -> DataFrame:
    """AUC, Brier score and log loss per model."""
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1.0 - clip)) if clip > 0 else F.col(p)
    clipped = df.withColumn("_q", q)
    base = clipped.groupBy(*groups).agg(
        F.avg(F.pow(F.col("_q") - F.col(y), 2)).alias("brier"),
        F.avg(log_loss_term(F.col(y), F.col("_q"), 0.0)).alias("log_loss"),
    )
    auc = auc_ap(clipped, y, "_q", groups).select(*groups, F.col("roc_auc").alias("auc"))
    if not groups:
        base, auc = base.withColumn("_one", F.lit(1)), auc.withColumn("_one", F.lit(1))
        return base.join(auc, "_one").drop("_one")
    return base.join(auc, list(groups))


def metric_deltas(metrics: DataFrame, model: str, baseline: str, metrics_of: Sequence[str]) -> DataFrame:
    """Difference of each model's metrics to the baseline model's; a handful of rows."""
    base = metrics.where(F.col(model) == baseline).select(
        F.lit(1).alias("_one"), *[F.col(m).alias(f"_{m}") for m in metrics_of]
    )
    return (
        metrics.withColumn("_one", F.lit(1))
        .join(F.broadcast(base), "_one")
        .select(model, *[(F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta") for m in metrics_of])
    )


def rank_models(metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """Best model by the listed metrics; a missing metric ranks last."""
    return metrics.orderBy(*[F.desc_nulls_last(m) for m in order], F.asc("model")).limit(1)


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean prediction and true rate per non-empty quantile bin."""
    names = {f"e{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(df, p, names).select(F.array(*names).alias("edges")).scalar()
    binned = df.withColumn("_edges", edges).withColumn(
        "bin", F.size(F.filter("_edges", lambda e: e < F.col(p)))
    )
    return binned.groupBy("bin").agg(
        F.avg(p).alias("pred_bin_mean"), F.avg(F.col(y).cast("double")).alias("true_rate"), F.count("*").alias("rows")
    )


def unpivoted(df: DataFrame, keep: Sequence[str], values: Sequence[str], name: str = "factor", value: str = "score") -> DataFrame:
    return df.select(*keep, *values).unpivot(list(keep), list(values), name, value)


def five_numbers(long: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    return exact_quantiles(
        long, value, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, groups
    )


def histogram(long: DataFrame, value: str, group: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and largest value of each group."""
    ends = long.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    at = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width) * bins), F.lit(0))
    return (
        long.where(F.col(value).isNotNull())
        .join(F.broadcast(ends), group)
        .groupBy(group, F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("rows"))
    )


def factor_extremes(long: DataFrame, key: str) -> DataFrame:
    """Highest and lowest record per factor; ties go to the lowest id."""
    both = long.groupBy("factor").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))).alias("high"),
        F.min(F.struct(F.col("score").alias("s"), F.col(key).alias("k"))).alias("low"),
    )
    return both.select(
        "factor",
        F.explode(
            F.array(
                F.struct(F.lit("high").alias("extreme"), F.col("high.k").alias(key), (-F.col("high.s")).alias("selected_score")),
                F.struct(F.lit("low").alias("extreme"), F.col("low.k").alias(key), F.col("low.s").alias("selected_score")),
            )
        ).alias("e"),
    ).select("factor", "e.*")


def representatives(df: DataFrame, score: str, key: str) -> DataFrame:
    """Rows at positions 0, n/2 and n-1 of the order by score, then id."""
    ranked = running_totals(
        with_piece(df, score, key), [F.col(score), F.col(key)], {"_r": F.lit(1).cast("bigint")}, totals={"_n": "_r"}
    )
    at = F.col("_r") - 1
    return (
        ranked.withColumn(
            "position",
            F.filter(
                F.array(
                    F.when(at == 0, "low"),
                    F.when(at == F.floor(F.col("_n") / 2), "median"),
                    F.when(at == F.col("_n") - 1, "high"),
                ),
                lambda v: v.isNotNull(),
            ),
        )
        .where(F.size("position") > 0)
        .withColumn("position", F.explode("position"))
        .drop("_r", "_n")
    )


def closest_mistakes(df: DataFrame, y: str, p: str, key: str, n: int = 20) -> DataFrame:
    wrong = df.withColumn("margin", F.abs(F.col(p) - 0.5)).where((F.col(p) >= 0.5).cast("int") != F.col(y))
    return wrong.orderBy("margin", key).limit(n)


def top_rows(df: DataFrame, order: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order), F.asc(key)).limit(n)


def domain_metrics(long: DataFrame, y: str, p: str, groups: Sequence[str]) -> DataFrame:
    """Rows, AUC, Brier score, log loss, accuracy and F1 by group; AUC and log loss are null where a group has one class."""
    clip = 1e-15
    base = binary_metrics(long, y, p, 0.5, groups, clip)
    brier = long.groupBy(*groups).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))
    both = (F.col("positive_support") > 0) & (F.col("positive_support") < F.col("rows"))
    joined = base.join(brier, list(groups)).join(auc_ap(long, y, p, groups), list(groups))
    return joined.select(
        *groups, "rows", F.when(both, F.col("roc_auc")).alias("auc"), F.when(both, F.col("log_loss")).alias("log_loss"), "brier", "accuracy",
        F.col("f1_positive").alias("f1"),
    )


def calibration_by(df: DataFrame, y: str, p: str, groups: Sequence[str], bins: int = 10) -> DataFrame:
    """``calibration`` with the quantile bins of each group."""
    names = {f"e{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(df, p, names, groups).select(*groups, F.array(*names).alias("_edges"))
    binned = df.join(edges, list(groups)).withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col(p))))
    return binned.groupBy(*groups, "bin").agg(
        F.avg(p).alias("pred_bin_mean"), F.avg(F.col(y).cast("double")).alias("true_rate"), F.count("*").alias("rows")
    )
