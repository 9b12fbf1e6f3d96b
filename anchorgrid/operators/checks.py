"""Set checks that return the offending rows, so an empty result means all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class CheckError(ValueError):
    """A check found offending rows."""


def require_empty(offending: DataFrame, what: str) -> None:
    first = offending.take(3)
    if first:
        raise CheckError(f"{what}: {[r.asDict() for r in first]}")


def duplicate_ids(df: DataFrame, id_column: str) -> DataFrame:
    return df.groupBy(id_column).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def shared_ids(a: DataFrame, b: DataFrame, id_column: str) -> DataFrame:
    return a.select(id_column).intersect(b.select(id_column))


def missing_ids(expected: DataFrame, existing: DataFrame, id_column: str) -> DataFrame:
    """Expected ids that do not exist; empty when expected is a subset."""
    return expected.join(existing.select(id_column), id_column, "left_anti")


def without_held_out(corpus: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Corpus rows whose group is in no validation or test split of the fold."""
    held = folds.filter(F.col("split").isin("validation", "test")).select(group).distinct()
    return corpus.join(held, group, "left_anti")


def dataset_inventory(configs: DataFrame, existing: DataFrame) -> DataFrame:
    """Config rows with the number of fold datasets present and whether all are.

    configs: family, splits, ambiguous; existing: dataset_id = family + '_fold-' + k. A config
    whose legacy name is ambiguous always counts as missing.
    """
    expected = configs.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    expected = expected.withColumn("dataset_id", F.concat("family", F.lit("_fold-"), F.col("fold").cast("string")))
    seen = existing.select("dataset_id").distinct().withColumn("__seen", F.lit(1))
    joined = expected.join(seen, "dataset_id", "left")
    return joined.groupBy("family", "splits", "ambiguous").agg(
        F.count("__seen").alias("present")
    ).withColumn("complete", (F.col("present") == F.col("splits")) & ~F.col("ambiguous"))
