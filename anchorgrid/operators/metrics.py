"""Binary-classification metrics as aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anchorgrid.functions.values import softplus
from anchorgrid.operators.ordered import Ordered, join_on

COUNTS = ("tp", "fp", "tn", "fn")
THRESHOLD_METRICS = (
    "accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "negative_precision",
    "negative_recall", "negative_f1", "macro_f1", "weighted_f1", "mcc",
)
EPS32 = 2.0**-23  # fixed value: spacing of single-precision floats at 1


def confusion(df: DataFrame, by: list[str], label: str = "label", prediction: str = "prediction",
              weight: Column | None = None, extra: list[Column] = ()) -> DataFrame:
    """tp, fp, tn, fn per key, with any ``extra`` aggregates, in one hash aggregate."""
    w = F.lit(1) if weight is None else weight
    y, p = F.col(label) == 1, F.col(prediction) == 1
    cell = lambda test: F.sum(F.when(test, w).otherwise(0))
    return df.groupBy(*by).agg(cell(y & p).alias("tp"), cell(~y & p).alias("fp"), cell(~y & ~p).alias("tn"), cell(y & ~p).alias("fn"), *extra)


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero when the denominator is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metric_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """All threshold metrics as expressions of the four counts.

    F1 is written by counts, 2tp / (2tp + fp + fn), which equals the harmonic mean of
    precision and recall and is zero exactly when that one is.
    """
    tp, fp, tn, fn = [c.cast("double") for c in (tp, fp, tn, fn)]
    total = tp + fp + tn + fn
    recall, n_recall = ratio(tp, tp + fn), ratio(tn, tn + fp)
    f1, n_f1 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return {
        "accuracy": F.try_divide(tp + tn, total), "balanced_accuracy": (recall + n_recall) / 2, "precision": ratio(tp, tp + fp),
        "recall": recall, "specificity": n_recall, "f1": f1, "negative_precision": ratio(tn, tn + fn),
        "negative_recall": n_recall, "negative_f1": n_f1, "macro_f1": (f1 + n_f1) / 2,
        "weighted_f1": F.try_divide(f1 * (tp + fn) + n_f1 * (tn + fp), total),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "positive_support": tp + fn, "negative_support": tn + fp, "num_examples": total,
    }


def threshold_metrics(df: DataFrame, by: list[str], **columns) -> DataFrame:
    counts = confusion(df, by, **columns)
    made = metric_columns(*[F.col(c) for c in COUNTS])
    return counts.select(*by, *COUNTS, *[c.alias(n) for n, c in made.items()])


def ranking_metrics(df: DataFrame, by: list[str], score: str = "probability", label: str = "label",
                    weight: Column | None = None) -> DataFrame:
    """roc_auc and average_precision per key; null unless both classes occur.

    Rows are first reduced to distinct scores, then running counts go over those cells; ties
    therefore need no special care and a hot key is cut along the score.
    """
    w = F.lit(1) if weight is None else weight
    cells = df.groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("__pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("__neg"))
    cells = cells.withColumn("__down", -F.col(score))
    line = Ordered(cells, by, ["__down"]).running({"__tp": F.col("__pos"), "__fp": F.col("__neg")}).done()
    sums = line.groupBy(*by).agg(
        F.sum("__pos").alias("__all_pos"), F.sum("__neg").alias("__all_neg"),
        F.sum(F.col("__neg") * (F.col("__tp") - F.col("__pos") / 2)).alias("__u"),
        F.sum(F.col("__pos") * ratio(F.col("__tp").cast("double"), F.col("__tp") + F.col("__fp"))).alias("__a"))
    both = (F.col("__all_pos") > 0) & (F.col("__all_neg") > 0)
    return sums.select(
        *by, F.when(both, F.col("__u") / (F.col("__all_pos").cast("double") * F.col("__all_neg"))).alias("roc_auc"),
        F.when(both, F.col("__a") / F.col("__all_pos")).alias("average_precision"))


def bce(logit: Column, label: Column) -> Column:
    """Binary cross entropy of a logit; never takes the log of zero."""
    return softplus(logit) - label * logit


def log_loss(df: DataFrame, by: list[str], logit: str, label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(bce(F.col(logit), F.col(label))).alias("loss"))


def best_threshold(df: DataFrame, by: list[str], metric: str = "macro_f1", score: str = "probability", label: str = "label") -> DataFrame:
    """(by, threshold, value): best metric, then balanced accuracy, then nearest 0.5, then lowest.

    Candidates are the distinct scores and three fixed points, which enter the running counts
    as cells without rows.
    """
    cells = df.groupBy(*by, F.col(score).alias("__t")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("__pos"), F.sum((F.col(label) != 1).cast("bigint")).alias("__neg"))
    fixed = F.explode(F.array(F.lit(EPS32), F.lit(0.5), F.lit(1 - EPS32))).alias("__t")
    zero = F.lit(0).cast("bigint")
    extra = df.select(*by).distinct().select(*by, fixed, zero.alias("__pos"), zero.alias("__neg"))
    cells = cells.unionByName(extra).groupBy(*by, "__t").agg(F.sum("__pos").alias("__pos"), F.sum("__neg").alias("__neg"))
    cells = cells.withColumn("__down", -F.col("__t"))
    line = Ordered(cells, by, ["__down"]).running({"tp": F.col("__pos"), "fp": F.col("__neg")}).done()
    totals = line.groupBy(*by).agg(F.sum("__pos").alias("__all_pos"), F.sum("__neg").alias("__all_neg"))
    joined = join_on(line, totals, by)
    made = metric_columns(F.col("tp"), F.col("fp"), F.col("__all_neg") - F.col("fp"), F.col("__all_pos") - F.col("tp"))
    key = F.struct(made[metric].alias("m"), made["balanced_accuracy"].alias("b"), (-F.abs(F.col("__t") - 0.5)).alias("d"), (-F.col("__t")).alias("t"))
    return joined.groupBy(*by).agg(F.max(key).alias("k")).select(*by, (-F.col("k.t")).alias("threshold"), F.col("k.m").alias("value"))


def to_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value)."""
    return df.unpivot(keys, metrics, "metric", "value")


def fold_statistics(long: DataFrame, by: list[str]) -> DataFrame:
    """n, valid n, mean, sample deviation, standard error, median, min and max per metric.

    A group has one value per fold, so the exact median is cheap. Only finite values count;
    deviation and error are null when one value is left.
    """
    x = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    rows = long.withColumn("__x", x).groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_folds"), F.count("__x").alias("num_valid_folds"), F.avg("__x").alias("mean"),
        F.stddev_samp("__x").alias("standard_deviation"), F.median("__x").alias("median"), F.min("__x").alias("minimum"),
        F.max("__x").alias("maximum"))
    some = F.col("num_valid_folds") > 1
    return rows.withColumn("standard_deviation", F.when(some, F.col("standard_deviation"))).withColumn(
        "standard_error", F.when(some, F.col("standard_deviation") / F.sqrt(F.col("num_valid_folds").cast("double"))))


def pooled_metrics(df: DataFrame, by: list[str], score: str = "probability", prediction: str = "prediction", threshold: str = "threshold") -> DataFrame:
    """Out-of-fold metrics over all folds; a stored prediction is preferred to the threshold."""
    decided = df.withColumn("__y", F.coalesce(F.col(prediction), (F.col(score) >= F.col(threshold)).cast("int")))
    a = threshold_metrics(decided, by, prediction="__y")
    b = ranking_metrics(df, by, score)
    return join_on(a, b, by)


def cv_summary(df: DataFrame, by: list[str], id_column: str = "sample_id") -> DataFrame:
    """Folds, rows, distinct and duplicated samples, and a fold -> rows map per key."""
    cells = df.groupBy(*by, "fold", id_column).agg(F.count(F.lit(1)).alias("__neg"))
    ids = cells.groupBy(*by, id_column).agg(F.sum("__neg").alias("__neg"))
    dup = ids.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.sum((F.col("__neg") > 1).cast("bigint")).alias("duplicated_samples"),
        F.sum(F.when(F.col("__neg") > 1, F.col("__neg")).otherwise(0)).alias("duplicate_occurrences"))
    per_fold = cells.groupBy(*by, "fold").agg(F.sum("__neg").alias("__neg"))
    folds = per_fold.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"), F.sum("__neg").alias("predictions"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("fold").cast("string"), "__neg")))).alias("predictions_per_fold"))
    return join_on(dup, folds, by)


def seed_statistics(long: DataFrame, by: list[str], seed: str = "seed") -> DataFrame:
    """Statistics over seeds of the fold mean: (by, metric) rows."""
    per_seed = long.groupBy(*by, seed).agg(F.avg("value").alias("value"))
    return fold_statistics(per_seed, by)
