"""Cross-validation folds: building them and proving they do not leak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorgrid.functions.hashing import draw60
from anchorgrid.operators.matching import hashed_rank
from anchorgrid.operators.ordered import Ordered, attach_row, with_group_size


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Add ``fold``: groups stay whole, positives are dealt evenly.

    Groups are ranked by positives, then size, then md5 and dealt in serpentine order, so each
    fold gets one group of every rank band. Only the group table is ordered, not the rows.
    """
    groups = df.groupBy(group).agg(
        F.sum(F.col(label).cast("bigint")).alias("__pos"), F.count(F.lit(1)).alias("__n"))
    # one sortable number: positives first, then group size, then the md5
    groups = groups.select(
        group, (-F.col("__pos")).alias("__a"), (-F.col("__n")).alias("__b"), draw60(seed, F.col(group)).alias("__h"))
    ranked = Ordered(groups, [], ["__a", "__b", "__h", group]).numbered("__r").done()
    at = F.col("__r") - 1
    band, place = F.floor(at / k), at % k
    fold = F.when(band % 2 == 0, place).otherwise(F.lit(k - 1) - place)
    return df.join(ranked.select(group, fold.cast("int").alias("fold")), group)


def rotate_splits(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Every row once per outer fold: test = its own, validation = the next, else train."""
    rows = df.withColumnRenamed(fold, "__own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    split = (F.when(F.col("__own") == F.col("fold"), "test")
             .when(F.col("__own") == (F.col("fold") + 1) % k, "validation").otherwise("train"))
    return rows.withColumn("split", split).drop("__own")


def leaking_groups(df: DataFrame, group: str) -> DataFrame:
    """(fold, group, splits) of groups found in more than one split of a fold."""
    return df.groupBy("fold", group).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


def groups_in_several_tests(df: DataFrame, group: str) -> DataFrame:
    return df.filter("split = 'test'").groupBy(group).agg(F.countDistinct("fold").alias("folds")).filter("folds > 1")


def duplicate_audit(df: DataFrame, id_column: str) -> DataFrame:
    """One row per occurrence of a duplicated sample with the reason and a unique key.

    Reasons: twice in one split of a fold, and in the test split of several folds.
    """
    per_split = df.groupBy("fold", "split", id_column).agg(F.count(F.lit(1)).alias("in_split"))
    per_id = per_split.filter("split = 'test'").groupBy(id_column).agg(
        F.countDistinct("fold").alias("test_folds"), F.sum("in_split").alias("test_occurrences"))
    bad = per_split.join(per_id, id_column, "left").withColumn("reason", F.concat_ws(
        ";",
        F.when(F.col("in_split") > 1, F.lit("within_split")),
        F.when((F.col("split") == "test") & (F.col("test_folds") > 1), F.lit("across_test_folds")),
    )).filter("reason <> ''")
    return bad.select(
        "fold", "split", id_column, "in_split", F.coalesce("test_occurrences", F.lit(0)).alias("test_occurrences"), "reason",
        F.concat_ws(":", F.lit("fold"), F.col("fold").cast("string"), F.col("split"), F.col(id_column).cast("string")).alias("sample_key"))


def fold_compatibility(runs: DataFrame, signature: list[str], name: str = "run_name", by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each key ``by``: number of folds, distinct signatures and names, and whether they fit."""
    row = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"), F.countDistinct(F.struct(*signature)).alias("signatures"),
        F.countDistinct(name).alias("names"))
    return row.withColumn("compatible", (F.col("folds") >= 2) & (F.col("signatures") == 1) & (F.col("names") == F.col("folds")))


def pool_folds(df: DataFrame, id_column: str, order: list[str], max_duplicate_share: float = 0.02) -> DataFrame:
    """First occurrence of every sample over the folds; too many duplicates are an error.

    The first row is a pre-aggregated min_by, so a sample repeated very often is no hot group.
    """
    kept = df.groupBy(id_column).agg(
        F.min_by(F.struct(*[c for c in df.columns if c != id_column]), F.struct(*order)).alias("r"),
        F.count(F.lit(1)).alias("__n"))
    total = kept.agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("ids"))
    share = (F.col("rows") - F.col("ids")) / F.col("rows")
    checked = total.select(F.when(share <= max_duplicate_share, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("share of duplicate samples is "), share.cast("string"))).cast("boolean")).alias("__ok"))
    return attach_row(kept, checked).filter("__ok").select(id_column, "r.*")


def repeated_stratified_folds(df: DataFrame, label: str, id_column: str, k: int, repeats: int, seed: int = 42) -> DataFrame:
    """(repeat, row, inner_fold): per repeat and label the rows are dealt round in md5 order."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.withColumn("__h", draw60(seed, F.col("repeat"), F.col(id_column)))
    ranked = Ordered(rows, ["repeat", label], ["__h", id_column]).numbered("__r").done()
    return ranked.withColumn("inner_fold", ((F.col("__r") - 1) % k).cast("int")).drop("__h", "__r")


def stratified_halves(df: DataFrame, label: str, id_column: str, repeats: int, seed: int = 42) -> DataFrame:
    """(repeat, row, part): per repeat and label the first half in md5 order is 'fit'."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.withColumn("__h", draw60(seed, F.col("repeat"), F.col(id_column)))
    ranked = Ordered(rows, ["repeat", label], ["__h", id_column]).numbered("__r").done()
    sized = with_group_size(ranked, ["repeat", label], "__n")
    return sized.withColumn("part", F.when(F.col("__r") * 2 <= F.col("__n"), "fit").otherwise("score")).drop("__h", "__r", "__n")


def pending_jobs(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that are not complete or were complete under another signature."""
    finished = done.filter("complete").select(*keys, "signature")
    return jobs.join(finished, [*keys, "signature"], "left_anti")
