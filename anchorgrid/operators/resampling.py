"""Bootstrap intervals and paired tests.

A metric that is a function of counts never draws rows: how often a repetition draws each cell (label and predictions) is a
multinomial, taken cell by cell as a binomial of what is left. Its uniform is ``md5(seed:repetition:cell)`` with 60 bits, turned
into a count by the exact distribution, so a repetition costs as many rows as there are cells. Only ranking metrics and
clusters draw rows: draw ``i`` of repetition ``b`` is row ``md5(seed:b:i) mod n``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from anchorgrid.functions.hashing import draw60
from anchorgrid.operators.metrics import metric_columns, ranking_metrics
from anchorgrid.operators.ordered import Ordered, attach_row
from anchorgrid.session import cut_lineage

MAX_CELLS = 4096
BROADCAST_ROWS = 2_000_000  # of three numbers each


class ComparisonError(ValueError):
    """Two prediction sets cannot be compared."""


def draws(spark, n: int, reps: int, seed: int = 42) -> DataFrame:
    """(rep, ix): n draws for every repetition; slots are spread over the cluster."""
    slots = spark.range(n).select(F.col("id").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    return slots.select("rep", (draw60(seed, F.col("rep"), F.col("slot")) % n).alias("ix"))


def percentile_interval(values: DataFrame, by: list[str], value: str = "value", level: float = 0.95) -> DataFrame:
    """(by, lower, upper, dropped); one value per repetition, non-finite ones are counted."""
    low = (1 - level) / 2
    good = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return values.groupBy(*by).agg(
        F.percentile(good, F.array(F.lit(low), F.lit(1 - low))).alias("q"),
        (F.count(F.lit(1)) - F.count(good)).alias("dropped"),
    ).select(*by, F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "dropped")


_LOG_FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 32)))])
GRID = 1 << 20  # probabilities looked at together


def log_factorial(x: np.ndarray) -> np.ndarray:
    """ln x! of non-negative whole numbers, by Stirling's series from 32 on."""
    z = np.maximum(x, 32) + 1.0
    series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(x < 32, _LOG_FACTORIALS[np.minimum(x, 31).astype(int)], series)


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Smallest k with P(X <= k) >= u for X binomial of n and p, for each pair of u and n.

    Only twelve deviations around the mean are looked at; beyond them lies less than 1e-30.
    """
    if p >= 1:
        return n.copy()
    out = np.empty(len(u), dtype=np.int64)
    spread = 12 * np.sqrt(n * p * (1 - p)) + 12
    low = np.maximum(0, np.floor(n * p - spread)).astype(np.int64)
    width = int(min(n.max(initial=0), np.ceil(2 * spread.max(initial=0)) + 2)) + 1
    rows = max(1, GRID // width)
    for a in range(0, len(u), rows):
        m, start = n[a : a + rows, None], low[a : a + rows, None]
        k = start + np.arange(width)
        here = np.minimum(k, m)
        log = log_factorial(m) - log_factorial(here) - log_factorial(m - here) + here * math.log(p) + (m - here) * math.log1p(-p)
        reached = np.cumsum(np.where(k <= m, np.exp(log), 0.0), axis=1)
        out[a : a + rows] = np.minimum(m[:, 0], start[:, 0] + (reached < u[a : a + rows, None]).sum(axis=1))
    return out


def cell_draws(cells: DataFrame, keys: list[str], reps: int, seed: int = 42) -> DataFrame:
    """Per repetition how often each cell is drawn: (rep, keys, n).

    cells: keys and n, a handful of rows (label x predictions), checked against a limit. The counts of a repetition are one
    draw of as many rows as the cells hold, with replacement.
    """
    rows = cells.select(*keys, "n").limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ComparisonError("too many cells for counted draws")
    rows = sorted(rows, key=lambda r: tuple(r[k] for k in keys))
    sizes = [r["n"] for r in rows]
    total = sum(sizes)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reps_here = batch["rep"].to_numpy()
            left, rest = np.full(len(reps_here), total, dtype=np.int64), total
            for cell, size in enumerate(sizes):
                digits = [hashlib.md5(f"{seed}:{rep}:{cell}".encode()).hexdigest()[:15] for rep in reps_here]
                u = (np.array([int(d, 16) for d in digits], dtype=float) + 0.5) / 2.0**60
                taken = binomial_quantile(u, left, size / rest if rest else 1.0)
                yield pd.DataFrame({"rep": reps_here, "cell": cell, "n": taken})
                left, rest = left - taken, rest - size

    spark = cells.sparkSession
    counted = spark.range(reps).select(F.col("id").alias("rep")).mapInPandas(drawn, "rep bigint, cell int, n bigint")
    listed = spark.createDataFrame([(i, *[r[k] for k in keys]) for i, r in enumerate(rows)], "cell int, " + ", ".join(f"{k} bigint" for k in keys))
    return counted.join(F.broadcast(listed), "cell").drop("cell")


def _counts(df: DataFrame, by: list[str], prediction: str, suffix: str = "") -> list[Column]:
    y, p = F.col("label") == 1, F.col(prediction) == 1
    pick = lambda test, name: F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name + suffix)
    return [pick(y & p, "tp"), pick(~y & p, "fp"), pick(~y & ~p, "tn"), pick(y & ~p, "fn")]


def bootstrap_threshold_metric(df: DataFrame, metric: str, reps: int, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: point, lower, upper, dropped of a count metric."""
    cells = df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    per = cell_draws(cells, ["label", "prediction"], reps, seed).groupBy("rep").agg(*_counts(df, [], "prediction"))
    value = lambda t: t.select("*", metric_columns(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])[metric].alias("value"))
    point = value(cells.agg(*_counts(cells, [], "prediction"))).select(F.col("value").alias("point"))
    return attach_row(percentile_interval(value(per), [], level=level), point)


def indexed(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``ix``, the 0-based position in the given total order."""
    return Ordered(df, [], order).numbered("ix").done().withColumn("ix", F.col("ix") - 1)


def drawn_rows(drawn: DataFrame, df: DataFrame) -> DataFrame:
    """Draws joined to the rows of ``df`` (with ix) that they name.

    The planner takes draws for few, as it does not see how far a range is exploded, and would send all of them through the driver. So the side is
    named: the rows up to a checked number are broadcast, more are hashed after a shuffle.
    """
    return drawn.join(F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_hash"), "ix")


def row_draws(df: DataFrame, reps: int, seed: int = 42) -> DataFrame:
    """Rows of ``df`` (with ix) joined to how often each repetition draws them: + rep, n."""
    hit = draws(df.sparkSession, df.count(), reps, seed).groupBy("rep", "ix").agg(F.count(F.lit(1)).alias("n"))
    return drawn_rows(hit, df)


def bootstrap_ranking_metric(df: DataFrame, metric: str, reps: int, order: list[str], seed: int = 42, level: float = 0.95) -> DataFrame:
    rows = cut_lineage(indexed(df, order).select("ix", "probability", "label"))
    # draws are counted per score where they are made; read by the running counts and their count pass, so they are made once
    drawn = drawn_rows(draws(df.sparkSession, rows.count(), reps, seed), rows)
    cells = cut_lineage(drawn.groupBy("rep", "probability", "label").agg(F.count(F.lit(1)).alias("n")))
    per = ranking_metrics(cells, ["rep"], weight=F.col("n")).select("rep", F.col(metric).alias("value"))
    point = ranking_metrics(df, []).select(F.col(metric).alias("point"))
    # a repetition that drew one class only has no value and counts as dropped
    return attach_row(percentile_interval(per, [], level=level), point)


def align(first: DataFrame, second: DataFrame, min_coverage: float = 0.9) -> DataFrame:
    """Inner join of two models by sample id; too little overlap or other labels are errors."""
    a = first.select("sample_id", F.col("label"), F.col("probability").alias("probability_a"), F.col("prediction").alias("prediction_a"))
    b = second.select("sample_id", F.col("label").alias("__label"), F.col("probability").alias("probability_b"), F.col("prediction").alias("prediction_b"))
    outer = a.join(b, "sample_id", "full")
    both = F.col("label").isNotNull() & F.col("__label").isNotNull()
    n = outer.agg(
        F.count("label").alias("na"), F.count("__label").alias("nb"), F.sum(both.cast("bigint")).alias("shared"),
        F.sum((both & (F.col("label") != F.col("__label"))).cast("bigint")).alias("clash")).first()
    if not n["shared"]:
        raise ComparisonError("no shared samples")
    if n["shared"] / max(n["na"], n["nb"]) < min_coverage:
        raise ComparisonError(f"only {n['shared']} of {max(n['na'], n['nb'])} samples are shared")
    if n["clash"]:
        raise ComparisonError(f"{n['clash']} shared samples have two labels")
    return outer.filter(both).drop("__label")


def paired_bootstrap(aligned: DataFrame, metric: str, reps: int, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: difference of a count metric, its interval and the share of draws a wins."""
    keys = ["label", "prediction_a", "prediction_b"]
    cells = aligned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def both(df, by):
        out = df.groupBy(*by).agg(*_counts(df, by, "prediction_a", "_a"), *_counts(df, by, "prediction_b", "_b"))
        m = lambda s: metric_columns(*[F.col(c + s) for c in ("tp", "fp", "tn", "fn")])[metric]
        return out.select(*by, m("_a").alias("a"), m("_b").alias("b"))

    per = both(cell_draws(cells, keys, reps, seed), ["rep"]).withColumn("value", F.col("a") - F.col("b"))
    wins = per.agg(F.avg((F.col("a") > F.col("b")).cast("int")).alias("probability_a_better"))
    point = both(cells, []).select(F.col("a").alias("point_a"), F.col("b").alias("point_b"), (F.col("a") - F.col("b")).alias("difference"))
    return attach_row(attach_row(percentile_interval(per, [], level=level), wins), point)


def mcnemar(aligned: DataFrame, by: list[str] = ()) -> DataFrame:
    """Discordant counts, statistic with continuity correction and p value."""
    a, b = F.col("prediction_a") == F.col("label"), F.col("prediction_b") == F.col("label")
    n = lambda test, name: F.sum(test.cast("bigint")).alias(name)
    row = aligned.groupBy(*by).agg(n(a & ~b, "only_a"), n(~a & b, "only_b"), n(a & b, "both_correct"), n(~a & ~b, "both_wrong"))
    discordant = F.col("only_a") + F.col("only_b")
    gap = F.abs(F.col("only_a") - F.col("only_b")) - 1
    statistic = F.when(discordant == 0, F.lit(0.0)).otherwise(gap * gap / F.when(discordant == 0, F.lit(1)).otherwise(discordant))
    row = row.withColumn("statistic", statistic)

    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:  # erfc is missing in SQL; one value per compared pair
        return s.map(lambda x: math.erfc(math.sqrt(x / 2.0)))

    return row.withColumn("p_value", tail("statistic"))


def cluster_bootstrap(clusters: DataFrame, order: list[str], sums: list[str], statistic: Column, reps: int, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Interval of ``statistic`` (an expression over summed columns) when clusters are drawn.

    clusters: one pre-aggregated row per cluster. With one cluster or no repetitions both
    bounds are the plain value.
    """
    rows = indexed(clusters, order)
    point = rows.agg(*[F.sum(c).alias(c) for c in sums]).select(statistic.alias("point"))
    many = rows.count()
    if many <= 1 or reps == 0:
        return point.select("point", F.col("point").alias("lower"), F.col("point").alias("upper"))
    drawn = row_draws(rows, reps, seed)
    per = drawn.groupBy("rep").agg(*[F.sum(F.col(c) * F.col("n")).alias(c) for c in sums]).select("rep", statistic.alias("value"))
    return attach_row(percentile_interval(per, [], level=level), point).select("point", "lower", "upper")


def bootstrap_mean(folds: DataFrame, value: str, order: list[str], reps: int, seed: int = 42) -> DataFrame:
    """Interval of the mean over folds; non-finite folds are left out."""
    good = folds.filter(~F.isnan(value) & (F.abs(value) != float("inf"))).withColumn("__one", F.lit(1)).withColumn("__v", F.col(value))
    return cluster_bootstrap(good, order, ["__v", "__one"], F.col("__v") / F.col("__one"), reps, seed)


def comparison_matrix(models: dict[str, DataFrame], metric: str, reps: int, seed: int = 42) -> DataFrame:
    """All pairs i < j of named models; a pair that cannot be compared keeps the reason."""
    out, names = None, sorted(models)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            try:
                row = paired_bootstrap(align(models[a], models[b]), metric, reps, seed).withColumn("reason", F.lit(None).cast("string"))
            except ComparisonError as error:
                row = models[a].sparkSession.createDataFrame([(str(error),)], "reason string")
            row = row.withColumn("first", F.lit(a)).withColumn("second", F.lit(b))
            out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out
