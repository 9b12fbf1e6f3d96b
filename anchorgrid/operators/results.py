"""Collecting cross-validation results over runs, and ranking models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorgrid.functions.naming import parse_family, window_label


def collect_results(runs: DataFrame, *, target: str = "cue", event_source: str | None = None,
                    symmetric: bool | None = None, windows: list[tuple[int, int]] | None = None,
                    excluded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(results, issues) of summary rows.

    runs: model, family, variant, seed, metric, mean, issue. The family name gives target,
    source and window; rows whose name cannot be read become issues instead of vanishing.
    """
    parsed = runs.withColumn("f", parse_family(F.col("family")))
    problem = F.coalesce("issue", "f.issue")
    issues = parsed.filter(problem.isNotNull()).select("model", "family", "variant", "seed", problem.alias("issue"))
    good = parsed.filter(problem.isNull() & (F.col("f.target") == target))
    if event_source is not None:
        good = good.filter(F.col("f.event_source") == event_source)
    if symmetric is not None:
        same = F.col("f.left_ms") == F.col("f.right_ms")
        good = good.filter(same if symmetric else ~same)
    if windows is not None:
        # the requested windows are a short argument list
        wanted = [(F.col("f.left_ms") == l) & (F.col("f.right_ms") == r) for l, r in windows]
        keep = wanted[0]
        for w in wanted[1:]:
            keep = keep | w
        good = good.filter(keep)
    if excluded:
        good = good.filter(~F.col("model").isin(*excluded))
    results = good.select(
        "model", "variant", "seed", "metric", "mean", F.col("f.event_source").alias("event_source"),
        F.col("f.source_inferred").alias("source_inferred"), F.col("f.left_ms").alias("left_ms"), F.col("f.right_ms").alias("right_ms"),
        window_label(F.col("f.left_ms"), F.col("f.right_ms")).alias("window"))
    return results, issues


def missing_windows(results: DataFrame, requested: list[tuple[int, int]]) -> DataFrame:
    """(model, window) combinations of the request that have no result."""
    wanted = F.explode(F.array(*[F.struct(F.lit(l).alias("l"), F.lit(r).alias("r")) for l, r in requested])).alias("w")
    pairs = results.select("model").distinct().select("model", wanted).select("model", window_label(F.col("w.l"), F.col("w.r")).alias("window"))
    return pairs.join(results.select("model", "window").distinct(), ["model", "window"], "left_anti")


def rank_models(results: DataFrame, metric: str) -> DataFrame:
    """Runs averaged within (model, window), windows averaged with equal weight, nulls last."""
    per_window = results.filter(F.col("metric") == metric).groupBy("model", "window").agg(F.avg("mean").alias("value"), F.count(F.lit(1)).alias("runs"))
    per_model = per_window.groupBy("model").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("windows"), F.sum("runs").alias("runs"))
    order = Window.orderBy(F.desc_nulls_last("value"), "model")  # one row per model
    return per_model.withColumn("rank", F.row_number().over(order))


def fold_result_issues(folds: DataFrame, required: list[str]) -> DataFrame:
    """(run, fold, issue): duplicate folds, missing or non-finite required metrics.

    folds: run, fold, metrics map<string,double>.
    """
    duplicate = folds.groupBy("run", "fold").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "run", "fold", F.lit("duplicate fold").alias("issue"))
    need = F.explode(F.array(*[F.lit(m) for m in required])).alias("metric")
    checked = folds.select("run", "fold", "metrics", need)
    value = F.try_element_at("metrics", F.col("metric"))
    issue = F.when(value.isNull(), F.concat(F.lit("missing "), "metric")).when(
        F.isnan(value) | (F.abs(value) == float("inf")), F.concat(F.lit("not finite "), "metric"))
    bad = checked.select("run", "fold", issue.alias("issue")).filter("issue is not null")
    return duplicate.unionByName(bad).distinct()


def selection_counts(selected: DataFrame, by: list[str], feature: str, fallback: Column) -> DataFrame:
    """(by, selected, features, fallbacks): rows, different features and rows chosen as a fallback."""
    return selected.groupBy(*by).agg(
        F.count(F.lit(1)).alias("selected"), F.countDistinct(feature).alias("features"), F.sum(fallback.cast("int")).alias("fallbacks"))


def selected_distribution(selected: DataFrame, attributes: list[str], none: str = "none") -> DataFrame:
    """(category, value, selected): how many selected features each value of each attribute has; null counts as ``none``.

    The rows are read and shuffled once: counts of whole attribute tuples are unpivoted, never the rows.
    """
    cells = selected.groupBy(*attributes).agg(F.count(F.lit(1)).alias("__n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("category"), F.coalesce(F.col(a).cast("string"), F.lit(none)).alias("value")) for a in attributes]))
    return cells.select(pairs.alias("p"), "__n").groupBy("p.category", "p.value").agg(F.sum("__n").alias("selected"))
