"""Symbolic words of series, their counts, chi-square selection, and interval features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorgrid.functions.hashing import draw, draw60
from anchorgrid.functions.traces import difference, let, periodogram
from anchorgrid.operators.ordered import attach_row, exact_quantile

MIN_WINDOW = 4


def configurations(spark, channels: int, points: int, size: int, max_window: int, seed: int = 42) -> DataFrame:
    """One row per configuration: channel, window, dilation, word length, binning, difference.

    Channels cycle through md5 permutations, so each gets its equal share.
    """
    ids = spark.range(size).withColumnRenamed("id", "config")
    cycle = F.floor(F.col("config") / channels)
    place = ids.select("config", cycle.alias("cycle"), (F.col("config") % channels).alias("slot"))
    order = Window.partitionBy("cycle").orderBy(draw60(seed, "channel", F.col("cycle"), F.col("channel")))
    perms = spark.range(-(-size // channels)).withColumnRenamed("id", "cycle").withColumn(
        "channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))).withColumn("slot", (F.row_number().over(order) - 1).cast("bigint"))
    rows = place.join(perms, ["cycle", "slot"])
    key = F.col("config")
    window = MIN_WINDOW + draw(seed, "window", key) % (min(points, max_window) - MIN_WINDOW + 1)
    rows = rows.withColumn("window", window.cast("int"))
    # dilation is a power of two that keeps the window inside the series
    most = F.floor(F.log2(F.lit(float(points - 1)) / (F.col("window") - 1)))
    rows = rows.withColumn("dilation", F.pow(F.lit(2.0), draw(seed, "dilation", key) % (most + 1)).cast("int"))
    return rows.select(
        "config", "channel", "window", "dilation",
        F.least(F.col("window") - 2, (7 + draw(seed, "word", key) % 2).cast("int")).alias("word_length"),
        F.when(draw(seed, "bins", key) % 2 == 0, "depth").otherwise("width").alias("binning"))


def window_coefficients(traces: DataFrame, config: dict, by: list[str], values: str = "values") -> DataFrame:
    """(by, position, c0 .. ck): low Fourier coefficients of every dilated window, mean left out.

    The basis is a literal array, so a coefficient is a dot product; windows of a trace are
    exploded (a bounded number per trace).
    """
    size, step, many = config["window"], config["dilation"], config["word_length"]
    reach = (size - 1) * step
    starts = F.sequence(F.lit(0), F.size(values) - reach - 1)
    windows = traces.select(*by, values, F.explode(starts).alias("position")).select(
        *by, "position", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(values, F.col("position") + i * step)).alias("w"))

    def coefficient(j):
        f, wave = 1 + j // 2, (math.cos if j % 2 == 0 else math.sin)
        b = F.array(*[F.lit(wave(2 * math.pi * f * i / size)) for i in range(size)])
        return F.aggregate(F.zip_with("w", b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    return windows.select(*by, "position", *[coefficient(j).alias(f"c{j}") for j in range(many)])


def cut_points(coefficients: DataFrame, many: int, binning: str) -> DataFrame:
    """One row with the threshold of every coefficient: its median, or the middle of its range."""
    if binning == "width":
        return coefficients.agg(*[((F.min(f"c{j}") + F.max(f"c{j}")) / 2).alias(f"t{j}") for j in range(many)])
    names = [f"c{j}" for j in range(many)]
    medians = exact_quantile(coefficients.select(*names).unpivot([], names, "c", "x"), ["c"], "x", 0.5, "m")
    return medians.agg(*[F.max(F.when(F.col("c") == c, F.col("m"))).alias(f"t{c[1:]}") for c in names])


def words(coefficients: DataFrame, cuts: DataFrame, many: int, by: list[str]) -> DataFrame:
    """(by, position, word): two letters per coefficient as the bits of a number."""
    rows = attach_row(coefficients, cuts)
    word = sum((F.when(F.col(f"c{j}") > F.col(f"t{j}"), 2**j).otherwise(0) for j in range(1, many)),
               F.when(F.col("c0") > F.col("t0"), 1).otherwise(0))
    return rows.select(*by, "position", word.cast("bigint").alias("word"))


def word_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def word_grams(rows: DataFrame, by: list[str], length: int) -> DataFrame:
    """Subsequences of ``length`` words at neighbouring positions of a trace, as text."""
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("position", "word"))).alias("p"))
    text = lambda i: F.concat_ws("-", F.transform(F.slice("p", i, F.lit(length)), lambda z: z["word"].cast("string")))
    starts = F.sequence(F.lit(1), F.size("p") - length + 1)
    return packed.filter(F.size("p") >= length).select(*by, F.explode(F.transform(starts, text)).alias("word"))


def chi2_top_k(counts: DataFrame, labels: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, word, chi2, rank): chi-square of summed counts against the class shares.

    counts: by, sample_id, label, word, n; labels: label, rows (class sizes).
    """
    total = labels.agg(F.sum("rows").alias("__all"))
    shares = attach_row(labels, total).select("label", (F.col("rows") / F.col("__all")).alias("share"))
    seen = counts.groupBy(*by, "word", "label").agg(F.sum("n").alias("o"))
    whole = seen.groupBy(*by, "word").agg(F.sum("o").alias("t"))
    # every word meets every class, also those it never occurs in: at most two rows per word
    packed = shares.agg(F.collect_list(F.struct("label", "share")).alias("s"))
    cells = attach_row(whole, packed).select(*by, "word", "t", F.explode("s").alias("s")).select(*by, "word", "t", "s.label", "s.share")
    joined = cells.join(seen, [*by, "word", "label"], "left")
    expected = F.col("t") * F.col("share")
    gap = F.coalesce("o", F.lit(0)) - expected
    chi = joined.groupBy(*by, "word").agg(F.sum(gap * gap / expected).alias("chi2"))
    order = Window.partitionBy(*by).orderBy(F.desc("chi2"), "word")
    return chi.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# -- interval features -------------------------------------------------------------------------------

STATISTICS = ("mean", "std", "slope", "median", "iqr", "min", "max")


def interval_table(count: int, points: int, seed: int = 42, shortest: int = 3) -> list[tuple[int, int, int]]:
    """(interval, start, stop) drawn by md5; a small parameter list."""
    import hashlib

    def pick(text, n):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % n

    out = []
    for i in range(count):
        start = pick(f"{seed}:start:{i}", points - shortest + 1)
        out.append((i, start, start + shortest + pick(f"{seed}:length:{i}", points - start - shortest + 1)))
    return out


def interval_statistics(a: Column) -> Column:
    """Seven summary statistics of a short array; quantiles interpolate linearly."""
    from anchorgrid.functions.traces import mean, std

    def all_of(a):
        n = F.size(a)
        s = F.array_sort(a)

        def quantile(q):
            at = F.lit(q) * (n - 1)
            low = F.floor(at).cast("int")
            x, y = F.get(s, low), F.get(s, F.least(low + 1, n - 1))
            return x + (y - x) * (at - low)

        center = (n - 1) / 2.0
        top = F.aggregate(F.transform(a, lambda x, i: (i - center) * x), F.lit(0.0), lambda t, x: t + x)
        slope = F.when(n > 1, top / (n * (n * n - 1) / 12.0)).otherwise(F.lit(0.0))
        return F.struct(mean(a).alias("mean"), std(a).alias("std"), slope.alias("slope"), quantile(0.5).alias("median"),
                        (quantile(0.75) - quantile(0.25)).alias("iqr"), F.array_min(a).alias("min"), F.array_max(a).alias("max"))

    return let(a, all_of)


def interval_features(traces: DataFrame, keys: list[str], points: int, count: int, seed: int = 42, values: str = "values") -> DataFrame:
    """(keys, view, interval, statistics) over the raw, difference and periodogram views."""
    views = {"raw": (F.col(values), points), "diff": (difference(F.col(values)), points - 1),
             "periodogram": (periodogram(F.col(values), points), points // 2)}
    cuts = []
    for name, (trace, length) in views.items():
        for i, start, stop in interval_table(count, length, seed):
            cuts.append((name, i, start, stop))
    rows = traces.select(*keys, *[t.alias(f"__{n}") for n, (t, _) in views.items()])
    pieces = F.array(*[F.struct(F.lit(n).alias("view"), F.lit(i).alias("interval"), F.slice(f"__{n}", a + 1, b - a).alias("x")) for n, i, a, b in cuts])
    return rows.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.view", "p.interval", interval_statistics(F.col("p.x")).alias("s")).select(
        *keys, "view", "interval", "s.*")
