"""Feature scores and selection on wide tables.

Features travel as one array per row. Class moments come from the vector summarizer, one
mergeable buffer per group, so rows are never multiplied by the number of features; only the
few summary rows are exploded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorgrid.operators.folds import repeated_stratified_folds
from anchorgrid.operators.ordered import attach_row

TOP_OF_FAMILY, BONUS = 16, 0.05  # fixed values of the stable ranking


def class_moments(df: DataFrame, by: list[str], features: str, label: str = "label") -> DataFrame:
    """(by, label, ix, n, s, ss): count, sum and centred sum of squares per class and feature."""
    stats = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(features)))
    rows = df.groupBy(*by, label).agg(stats.alias("m"))
    packed = F.arrays_zip(vector_to_array("m.mean").alias("mean"), vector_to_array("m.variance").alias("var"))
    long = rows.select(*by, label, F.col("m.count").alias("n"), F.posexplode(packed).alias("ix", "z"))
    return long.select(*by, label, "ix", "n", F.col("z.mean").alias("mean"), ((F.col("n") - 1) * F.col("z.var")).alias("ss"))


def f_from_moments(moments: DataFrame, by: list[str]) -> DataFrame:
    """(by, ix, f) from per-class n, mean, ss; null for a constant feature."""
    n, mean = F.col("n"), F.col("mean")
    sums = moments.groupBy(*by, "ix").agg(
        F.sum("n").alias("__n"), F.sum(n * mean).alias("__s"), F.sum("ss").alias("__w"), F.count(F.lit(1)).alias("__k"))
    joined = moments.join(sums, [*by, "ix"])
    gap = mean - F.col("__s") / F.col("__n")
    between = joined.groupBy(*by, "ix").agg(
        F.sum(n * gap * gap).alias("__b"), F.max("__w").alias("__w"), F.max("__n").alias("__n"), F.max("__k").alias("__k"))
    f = (F.col("__b") / (F.col("__k") - 1)) / (F.col("__w") / (F.col("__n") - F.col("__k")))
    return between.select(*by, "ix", F.when((F.col("__w") > 0) & (F.col("__k") > 1), f).alias("f"))


def anova_f(df: DataFrame, features: str, by: list[str] = (), label: str = "label") -> DataFrame:
    """F value of every feature position; the constant case is left to the caller as null."""
    by = list(by)
    return f_from_moments(class_moments(df, by, features, label), by)


def ranked_groups(scores: DataFrame, top: int, group_size: int) -> DataFrame:
    """Top features by F, dealt to groups round-robin so no group gets only weak ones.

    scores has one row per feature. Constant features rank last.
    """
    order = Window.orderBy(F.desc_nulls_last("f"), "ix")
    ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    count = ranked.agg(F.count(F.lit(1)).alias("__c"))
    groups = F.ceil(F.col("__c") / group_size).cast("int")
    return attach_row(ranked, count).withColumn("group_ix", ((F.col("rank") - 1) % groups).cast("int")).drop("__c")


def screen_channels(df: DataFrame, channel: str, frame: str, value: str, label: str, top: int, epsilon: float = 1e-8) -> DataFrame:
    """(channel, score, rank): mean squared class gap over time by the mean within variance."""
    cells = df.groupBy(channel, frame, label).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    per = cells.groupBy(channel, frame).agg(
        (F.max(F.when(F.col(label) == 1, F.col("m"))) - F.max(F.when(F.col(label) == 0, F.col("m")))).alias("d"), F.avg("v").alias("v"))
    scores = per.groupBy(channel).agg((F.avg(F.col("d") * F.col("d")) / (F.avg("v") + epsilon)).alias("score"))
    order = Window.orderBy(F.desc("score"), channel)  # one row per channel
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def vote_scores(df: DataFrame, features: str, label: str, id_column: str, *, folds: int, repeats: int, seed: int = 42) -> DataFrame:
    """(repeat, vote, ix, f): F values on the rows outside one inner fold.

    Moments are taken once per inner fold; a vote merges those of the other folds, so the data
    is read once for all votes.
    """
    dealt = repeated_stratified_folds(df, label, id_column, folds, repeats, seed)
    m = class_moments(dealt, ["repeat", "inner_fold"], features, label)
    votes = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda v: v != F.col("inner_fold"))).alias("vote")
    spread = m.select("*", votes)
    merged = spread.groupBy("repeat", "vote", label, "ix").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        (F.sum(F.col("ss") + F.col("n") * F.col("mean") * F.col("mean"))
         - F.pow(F.sum(F.col("n") * F.col("mean")), 2) / F.sum("n")).alias("ss"))
    f = f_from_moments(merged, ["repeat", "vote"])
    return f.withColumn("f", F.greatest(F.coalesce("f", F.lit(0.0)), F.lit(0.0)))


def stable_ranking(votes: DataFrame, families: DataFrame, screen: int) -> DataFrame:
    """(family, ix, score, rank): share of votes in the top ``screen`` plus a small F bonus."""
    rows = votes.join(F.broadcast(families), "ix")
    order = Window.partitionBy("family", "repeat", "vote").orderBy(F.desc("f"), "ix")
    marked = rows.withColumn("__in", (F.row_number().over(order) <= screen).cast("int"))
    per = marked.groupBy("family", "ix").agg(F.avg("__in").alias("frequency"), F.avg(F.log1p("f")).alias("mean_log_f"))
    top = F.greatest(F.max("mean_log_f").over(Window.partitionBy("family")), F.lit(2.220446049250313e-16))
    scored = per.withColumn("score", F.col("frequency") + BONUS * F.col("mean_log_f") / top)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("score"), "ix")))


def family_utilities(votes: DataFrame, families: DataFrame) -> DataFrame:
    """(family, utility, capacity): median over votes of the mean of the best 16 log1p(F)."""
    rows = votes.join(F.broadcast(families), "ix")
    order = Window.partitionBy("family", "repeat", "vote").orderBy(F.desc("f"), "ix")
    best = rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= TOP_OF_FAMILY)
    per_vote = best.groupBy("family", "repeat", "vote").agg(F.avg(F.log1p("f")).alias("u"))
    capacity = families.groupBy("family").agg(F.count(F.lit(1)).alias("capacity"))
    return per_vote.groupBy("family").agg(F.median("u").alias("utility")).join(capacity, "family")


def allocate_budget(utilities: DataFrame, total: int, *, active: int = 12, minimum: int = 8, temperature: float = 0.5) -> DataFrame:
    """(family, budget): a floor for the best families, the rest by softmax weight.

    Handing out one slot at a time to the largest weight / (slots so far + 1) equals taking
    the largest of all those quotients, so the slots are listed and ranked. One row per family.
    """
    order = Window.orderBy(F.desc("utility"), "family")
    keep = min(active, max(1, total // minimum))
    top = utilities.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    top = top.withColumn("base", F.least(F.col("capacity"), F.lit(minimum)))
    everything = Window.partitionBy(F.lit(0))
    w = F.exp((F.col("utility") - F.max("utility").over(everything)) / temperature)
    top = top.withColumn("w", w).withColumn("weight", F.col("w") / F.sum("w").over(everything))
    top = top.withColumn("left", F.greatest(F.lit(total) - F.sum("base").over(everything), F.lit(0)))
    slots = top.filter(F.col("capacity") > F.col("base")).withColumn(
        "slot", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("capacity") - F.col("base"))))
    taken = slots.withColumn("__r", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("weight") / F.col("slot")), "place", "slot"))).filter(F.col("__r") <= F.col("left"))
    extra = taken.groupBy("family").agg(F.count(F.lit(1)).alias("extra"))
    return top.join(extra, "family", "left").select("family", (F.col("base") + F.coalesce("extra", F.lit(0))).alias("budget"))


def suppress_redundant(df: DataFrame, features: str, ranking: DataFrame, budgets: DataFrame, *,
                       pool_factor: int = 4, threshold: float = 0.98) -> DataFrame:
    """(family, ix, place): walk the ranked pool, keep a feature unless it repeats a kept one.

    Correlations come from all rows: every task sums the products of a family's centred pool, the sums are added by
    position, and the walk sees one pool x pool matrix, whose size is fixed by the arguments. Constant features are left out.
    """
    pool = ranking.join(budgets, "family").filter(F.col("rank") <= F.greatest(F.col("budget"), F.col("budget") * pool_factor))
    listed = pool.groupBy("family").agg(
        F.max("budget").alias("budget"), F.array_sort(F.collect_list(F.struct("rank", "ix"))).alias("p")).select("family", "budget", F.col("p.ix").alias("pool"))
    mean = df.agg(Summarizer.mean(array_to_vector(F.col(features))).alias("m")).select(vector_to_array("m").alias("__mean"))
    packed = listed.agg(F.collect_list(F.struct("family", "pool")).alias("__f"))  # a row per family
    values = F.transform("pool", lambda i: F.get("__v", i).cast("double") - F.get("__mean", i))
    rows = attach_row(attach_row(df.select(F.col(features).alias("__v")), mean), packed).withColumn("__f", F.explode("__f")).select(
        "__v", "__mean", "__f.*").select("family", values.alias("x"))

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for family, group in frame.groupby("family"):
                x = np.stack(group["x"].to_numpy())
                sums[family] = sums.get(family, 0.0) + x.T @ x
        for family, s in sums.items():
            i, j = np.tril_indices(len(s))
            yield pd.DataFrame({"family": family, "i": i, "j": j, "s": s[i, j]})

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.asarray(group["pool"].iloc[0])
        gram = np.zeros((len(ids), len(ids)))
        gram[group["i"], group["j"]] = gram[group["j"], group["i"]] = group["s"]
        norm = np.sqrt(np.diag(gram))
        chosen: list[int] = []
        for j in np.flatnonzero(norm > np.finfo(float).eps):
            if len(chosen) == int(group["budget"].iloc[0]):
                break
            if not chosen or np.abs(gram[chosen, j] / (norm[chosen] * norm[j])).max() < threshold:
                chosen.append(int(j))
        return pd.DataFrame({"family": group["family"].iloc[0], "ix": ids[chosen], "place": range(len(chosen))})

    added = rows.mapInPandas(products, "family string, i int, j int, s double").groupBy("family", "i", "j").agg(F.sum("s").alias("s"))
    return added.join(listed, "family").groupBy("family").applyInPandas(keep, "family string, ix int, place int")


def assemble(df: DataFrame, features: str, order: list[int], name: str) -> DataFrame:
    """Selected positions as one array, in the given order; a narrow projection."""
    if not order:
        raise ValueError("no feature was selected")
    return df.withColumn(name, F.array(*[F.get(features, F.lit(i)) for i in order]))


def choose_candidate(scores: DataFrame, *, vote_top: int, vote_threshold: float, series_length: int, length_threshold: int) -> DataFrame:
    """(proposed, support, chosen): highest median score, checked by votes, else the fallback.

    scores: split, candidate, position, score; one row per split and candidate.
    """
    medians = scores.groupBy("candidate").agg(F.median("score").alias("m"), F.min("position").alias("p"))
    proposed = medians.agg(F.max_by(F.struct("candidate", "m"), F.struct("m", -F.col("p"))).alias("w")).select(
        F.col("w.candidate").alias("proposed"), F.col("w.m").alias("median_score"))
    order = Window.partitionBy("split").orderBy(F.desc("score"))
    cut = scores.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") == vote_top).select("split", F.col("score").alias("cut"))
    mine = scores.join(F.broadcast(proposed), scores["candidate"] == proposed["proposed"]).join(cut, "split")
    support = mine.groupBy("proposed", "median_score").agg(F.avg((F.col("score") >= F.col("cut")).cast("int")).alias("support"))
    long_series = F.lit(series_length) >= length_threshold
    return support.withColumn("chosen", F.when(F.col("support") >= vote_threshold, F.col("proposed")).when(long_series, "ZC_MIX").otherwise("PPV_MIX"))


# -- scalers ---------------------------------------------------------------------------------------


def fit_sparse_scaler(df: DataFrame, features: str, *, per_column: bool = True, exponent: int = 4) -> DataFrame:
    """One row (mean array, scale array) of square-rooted counts.

    per_column: sample deviation plus each column's own zero share to the exponent. Otherwise
    population deviation plus the zero share of the whole table.
    """
    root = F.transform(features, lambda x: F.sqrt(F.greatest(x.cast("double"), F.lit(0.0))))
    stats = Summarizer.metrics("mean", "variance", "count", "numNonZeros").summary(array_to_vector(root))
    m = df.agg(stats.alias("m")).select(
        F.col("m.count").cast("double").alias("n"), vector_to_array("m.mean").alias("mean"), vector_to_array("m.variance").alias("var"),
        vector_to_array("m.numNonZeros").alias("nz"))
    n = F.col("n")
    if per_column:
        scale = F.zip_with("var", "nz", lambda v, z: F.sqrt(v) + F.pow(1 - z / n, F.lit(exponent)) + 1e-8)
    else:
        share = 1 - F.aggregate("nz", F.lit(0.0), lambda s, x: s + x) / (n * F.size("nz"))
        scale = F.transform("var", lambda v: F.sqrt(v * (n - 1) / n) + F.pow(share, F.lit(exponent)) + 1e-8)
    return m.select(F.col("mean").alias("__mean"), scale.alias("__scale"))


def apply_sparse_scaler(df: DataFrame, features: str, fitted: DataFrame, *, mask: bool, name: str) -> DataFrame:
    """(root - mean) / scale; with the mask a zero count stays zero."""
    rows = attach_row(df, fitted)
    root = F.transform(features, lambda x: F.sqrt(F.greatest(x.cast("double"), F.lit(0.0))))
    keep = (lambda r: (r != 0).cast("double")) if mask else (lambda r: F.lit(1.0))
    scaled = F.zip_with(F.zip_with(root, "__mean", lambda r, m: (r - m) * keep(r)), "__scale", lambda x, s: x / s)
    return rows.withColumn(name, scaled).drop("__mean", "__scale")


def scale_without_centering(df: DataFrame, features: str, name: str) -> DataFrame:
    """Divide by the population deviation of every column; a constant column stays as it is."""
    stats = Summarizer.metrics("variance", "count").summary(array_to_vector(F.col(features)))
    m = df.agg(stats.alias("m")).select(F.col("m.count").alias("n"), vector_to_array("m.variance").alias("var"))
    scale = m.select(F.transform("var", lambda v: F.sqrt(v * (F.col("n") - 1) / F.col("n"))).alias("__scale"))
    rows = attach_row(df, scale)
    return rows.withColumn(name, F.zip_with(features, "__scale", lambda x, s: F.when(s > 0, x / s).otherwise(x.cast("double")))).drop("__scale")
