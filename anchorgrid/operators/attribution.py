"""Ablation, sampled Shapley values, retraining and timing-robustness tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorgrid.functions.hashing import draw60
from anchorgrid.functions.traces import let, mean, std
from anchorgrid.functions.values import sigmoid
from anchorgrid.operators.ordered import attach_row
from anchorgrid.operators.metrics import bce, confusion, metric_columns, ranking_metrics

COUNTS = ("tp", "fp", "tn", "fn")


def decrease(full: Column, changed: Column, metric: str) -> Column:
    """How much a change hurts: the sign of a loss is turned."""
    return changed - full if metric == "loss" else full - changed


def scored(df: DataFrame, by: list[str], logit: str) -> DataFrame:
    """macro_f1, balanced_accuracy, roc_auc, average_precision and loss per key."""
    rows = df.withColumn("__p", sigmoid(F.col(logit)))
    rows = rows.withColumn("__y", (F.col("__p") >= F.col("threshold")).cast("int"))
    made = metric_columns(*[F.col(c) for c in COUNTS])
    counts = confusion(rows, by, prediction="__y", extra=[F.avg(bce(F.col(logit), F.col("label"))).alias("loss")])
    picked = counts.select(*by, made["macro_f1"].alias("macro_f1"), made["balanced_accuracy"].alias("balanced_accuracy"), "loss")
    return picked.join(ranking_metrics(rows, by, "__p"), by)


METRICS = ("macro_f1", "balanced_accuracy", "roc_auc", "average_precision", "loss")


def fold_and_pooled(df: DataFrame) -> DataFrame:
    """Every row once for its fold and once for the pooled line."""
    scopes = F.array(F.concat(F.lit("fold-"), F.col("fold").cast("string")), F.lit("pooled"))
    return df.withColumn("scope", F.explode(scopes))


def ablation_table(logits: DataFrame) -> DataFrame:
    """(modality, scope, decreases, rank): full model against one modality left out.

    logits: fold, sample_id, label, threshold, modality, full_logit, ablated_logit. Rank is by
    the pooled macro-F1 decrease.
    """
    rows = fold_and_pooled(logits)
    by = ["modality", "scope"]
    full, cut = scored(rows, by, "full_logit"), scored(rows, by, "ablated_logit")
    joined = full.alias("f").join(cut.alias("c"), by)
    table = joined.select(*by, *[decrease(F.col(f"f.{m}"), F.col(f"c.{m}"), m).alias(f"{m}_decrease") for m in METRICS])
    pooled = table.filter("scope = 'pooled'").select("modality", "macro_f1_decrease")
    order = Window.orderBy(F.desc("macro_f1_decrease"), "modality")  # one row per modality
    ranked = pooled.select("modality", F.row_number().over(order).alias("rank"))
    return table.join(F.broadcast(ranked), "modality")


def orderings(spark, bits: int, count: int, seed: int = 42) -> DataFrame:
    """(ordering, unit, position, bit): random orders and their reverses, in pairs.

    The order of unit u is the md5 order of its bits; the reverse belongs to the same unit.
    """
    if count < 2 or count % 2:
        raise ValueError("the number of orderings is even and at least 2")
    grid = spark.range(count // 2).select(F.col("id").alias("unit"), F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy(draw60(seed, F.col("unit"), F.col("bit")))) - 1
    both = grid.withColumn("__r", rank).withColumn("reverse", F.explode(F.array(F.lit(0), F.lit(1))))
    place = F.when(F.col("reverse") == 0, F.col("__r")).otherwise(F.lit(bits - 1) - F.col("__r"))
    return both.select((F.col("unit") * 2 + F.col("reverse")).alias("ordering"), "unit", place.alias("position"), "bit")


def sampled_shapley(coalitions: DataFrame, bits: int, count: int, seed: int = 42, keys=("fold", "sample_id")) -> DataFrame:
    """(keys, bit, value, standard_error, n) of the full-minus-empty logit.

    coalitions: keys, coalition (bit mask), logit. A sample has at most 2**bits coalitions, so
    its logits travel as one array, every step of an ordering is a look-up in it, and the means
    are taken inside the row: one shuffle builds the arrays, none follows. The steps are a small
    fixed table.
    """
    keys = list(keys)
    steps = orderings(coalitions.sparkSession, bits, count, seed)
    line = Window.partitionBy("ordering").orderBy("position")
    own = F.pow(F.lit(2.0), F.col("bit")).cast("bigint")
    steps = steps.withColumn("after", F.sum(own).over(line)).withColumn("before", F.col("after") - own)
    packed = steps.agg(F.array_sort(F.collect_list(F.struct("bit", "unit", "ordering", "before", "after"))).alias("steps"))
    cells = F.array_sort(F.collect_list(F.struct("coalition", "logit")))
    rows = coalitions.groupBy(*keys).agg(cells.alias("p"))
    # with all coalitions there the position is the mask; otherwise they are looked up once
    sparse = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(2**bits - 1).cast("bigint")),
                         lambda c: F.try_element_at(F.map_from_entries("p"), c))
    dense = F.when(F.size("p") == 2**bits, F.col("p.logit")).otherwise(sparse)
    units = count // 2

    def differences(m):
        at = lambda c: F.get(m, c.cast("int"))
        return F.transform("steps", lambda s: at(s["after"]) - at(s["before"]))

    def pair_means(d):
        # steps are sorted by bit, unit, ordering: two neighbours are an order and its reverse
        halves = lambda i: (F.get(d, i * 2) + F.get(d, i * 2 + 1)) / 2
        flat = F.transform(F.sequence(F.lit(0), F.lit(bits * units - 1)), halves)
        return let(flat, lambda x: F.transform(
            F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.slice(x, b * units + 1, F.lit(units))))

    paired = let(let(dense, differences), pair_means)
    one = attach_row(rows, packed).select(*keys, F.posexplode(paired).alias("bit", "v"))
    error = std("v") * F.sqrt(F.lit(units / max(units - 1, 1))) / F.sqrt(F.lit(float(units))) if units > 1 else F.lit(0.0)
    return one.select(*keys, "bit", mean("v").alias("value"), error.alias("standard_error"), F.lit(units).alias("n"))


def efficiency_gap(values: DataFrame, coalitions: DataFrame, bits: int, keys=("fold", "sample_id")) -> DataFrame:
    """Sum of the values minus (full - empty) per sample; zero up to rounding."""
    keys = list(keys)
    ends = coalitions.groupBy(*keys).agg(
        F.sum(F.when(F.col("coalition") == 2**bits - 1, F.col("logit")).when(F.col("coalition") == 0, -F.col("logit")).otherwise(0.0)).alias("__e"))
    total = values.groupBy(*keys).agg(F.sum("value").alias("__v"))
    return total.join(ends, keys).select(*keys, (F.col("__v") - F.col("__e")).alias("gap"))


def sample_attributions(values: DataFrame, keys=("fold", "sample_id")) -> DataFrame:
    """Absolute share in percent of every modality in its sample."""
    keys = list(keys)
    total = values.groupBy(*keys).agg(F.sum(F.abs("value")).alias("__t"))
    share = F.when(F.col("__t") > 0, F.abs("value") / F.col("__t") * 100).otherwise(F.lit(0.0))
    return values.join(total, keys).withColumn("absolute_share_percent", share).drop("__t")


def modality_attributions(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean signed and absolute value per modality, and per channel (sizes: bit, channels)."""
    means = values.groupBy("bit").agg(F.avg("value").alias("mean_signed"), F.avg(F.abs("value")).alias("mean_absolute"))
    return means.join(F.broadcast(sizes), "bit").withColumn("absolute_per_channel", F.col("mean_absolute") / F.col("channels"))


def pooled_join(baseline: DataFrame, variants: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Variant rows with the baseline value of the same key and the difference."""
    base = baseline.select(*keys, F.col(value).alias("baseline"))
    return variants.join(base, keys).withColumn("difference", F.col("baseline") - F.col(value))


VARIANT_KINDS = ("modality_only", "leave_one_out")


def retraining_variants(spark, modalities: list[str], lower_face: bool = True) -> DataFrame:
    """(variant, kind, modality): one-modality and all-but-one runs, plus the lower-face run."""
    rows = [("full", "full", None)]
    rows += [(f"{kind}-{m}", kind, m) for kind in VARIANT_KINDS for m in modalities]
    if lower_face:
        rows.append(("lower-face", "lower_face", "Facial"))
    return spark.createDataFrame(rows, "variant string, kind string, modality string")


def retraining_rankings(scores: DataFrame) -> DataFrame:
    """Modality-only runs ranked by score, leave-one-out runs by what they lose to the full run.

    scores: variant, kind, modality, value; one row per variant.
    """
    full = scores.filter("kind = 'full'").select(F.col("value").alias("full_value"))
    rows = attach_row(scores.filter(F.col("kind").isin(*VARIANT_KINDS)), full)
    key = F.when(F.col("kind") == "modality_only", F.col("value")).otherwise(F.col("full_value") - F.col("value"))
    rows = rows.withColumn("ranking_value", key)
    order = Window.partitionBy("kind").orderBy(F.desc("ranking_value"), "modality")
    return rows.withColumn("rank", F.row_number().over(order)).drop("full_value")


CONDITION = ["target", "kind", "magnitude"]


def robustness_summary(rows: DataFrame, step_ms: float) -> DataFrame:
    """Per timing condition: decrease, flip rate, mean probability change, logit correlation.

    rows: target, kind, magnitude, label, threshold, baseline_logit, perturbed_logit. The
    correlation is null when one side is constant.
    """
    made = rows.withColumn("__b", sigmoid(F.col("baseline_logit"))).withColumn("__q", sigmoid(F.col("perturbed_logit")))
    flip = ((F.col("__b") >= F.col("threshold")) != (F.col("__q") >= F.col("threshold"))).cast("int")
    x, y = F.col("baseline_logit"), F.col("perturbed_logit")
    stats = made.groupBy(*CONDITION).agg(
        F.count(F.lit(1)).alias("n"), F.avg(flip).alias("flip_rate"), F.avg(F.abs(F.col("__q") - F.col("__b"))).alias("probability_change"),
        F.stddev_pop(x).alias("__sx"), F.stddev_pop(y).alias("__sy"), F.covar_pop(x, y).alias("__xy"))
    a, b = scored(rows, CONDITION, "baseline_logit"), scored(rows, CONDITION, "perturbed_logit")
    drop = a.alias("f").join(b.alias("c"), CONDITION).select(
        *CONDITION, *[decrease(F.col(f"f.{m}"), F.col(f"c.{m}"), m).alias(f"{m}_decrease") for m in METRICS])
    spread = F.col("__sx") * F.col("__sy")
    return stats.join(drop, CONDITION).withColumn(
        "logit_correlation", F.when(spread > 0, F.col("__xy") / spread)
    ).withColumn("shift_ms", F.when(F.col("kind") == "shift", F.col("magnitude") * step_ms)).drop("__sx", "__sy", "__xy")


def robustness_targets(summary: DataFrame) -> DataFrame:
    """Per target: mean changes, worst decrease and rank; the 'All' target has no rank."""
    rows = summary.groupBy("target").agg(
        F.avg("probability_change").alias("mean_probability_change"), F.avg("flip_rate").alias("mean_flip_rate"),
        F.max("macro_f1_decrease").alias("worst_macro_f1_decrease"))
    one = F.col("target") != "All"
    order = Window.partitionBy(one).orderBy(F.desc("mean_probability_change"), "target")
    return rows.withColumn("rank", F.when(one, F.row_number().over(order)))


def average_ranks(measures: DataFrame) -> DataFrame:
    """(measure, modality, value, rank): descending mid-ranks; one row per modality."""
    line = Window.partitionBy("measure").orderBy(F.desc("value"))
    ties = Window.partitionBy("measure", "value")
    return measures.withColumn("rank", F.rank().over(line) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def rank_concordance(ranks: DataFrame) -> DataFrame:
    """(left, right, rho, p_value) of all pairs of measures i < j over the modalities.

    ranks has one row per (measure, modality): a result table of fixed size.
    """
    import math

    import pandas as pd

    a = ranks.select("modality", F.col("measure").alias("left"), F.col("rank").alias("x"))
    b = ranks.select("modality", F.col("measure").alias("right"), F.col("rank").alias("y"))
    pairs = a.join(b, "modality").filter(F.col("left") < F.col("right"))
    stats = pairs.groupBy("left", "right").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    rho = stats.withColumn("rho", F.when(F.col("sx") * F.col("sy") > 0, F.col("c") / (F.col("sx") * F.col("sy"))))

    def two_sided(r, n):
        """Tail of the t distribution with n - 2 degrees of freedom, by its finite series."""
        df = n - 2
        if r is None or r != r or df < 1:
            return None
        if abs(r) >= 1:
            return 0.0
        angle, c = math.atan(abs(r) * math.sqrt(df / (1 - r * r)) / math.sqrt(df)), 0.0
        cos2, term = math.cos(angle) ** 2, 1.0
        if df % 2:
            term = math.cos(angle)
            for k in range(1, (df - 1) // 2 + 1):
                c += term
                term *= cos2 * 2 * k / (2 * k + 1)
            inside = 2 / math.pi * (angle + math.sin(angle) * c)
        else:
            for k in range(1, df // 2 + 1):
                c += term
                term *= cos2 * (2 * k - 1) / (2 * k)
            inside = math.sin(angle) * c
        return max(0.0, 1 - inside)

    def tails(batches):
        for b in batches:
            yield pd.DataFrame({"left": b["left"], "right": b["right"], "rho": b["rho"], "n": b["n"],
                                "p_value": [two_sided(r, int(n)) for r, n in zip(b["rho"], b["n"])]})

    return rho.select("left", "right", "rho", "n").mapInPandas(tails, "left string, right string, rho double, n bigint, p_value double")


def rank_ranges(ranks: DataFrame, limit: int = 4) -> DataFrame:
    rows = ranks.groupBy("modality").agg((F.max("rank") - F.min("rank")).alias("rank_range"))
    return rows.withColumn("interpretation", F.when(F.col("rank_range") >= limit, "discrepant").otherwise("concordant"))


def interval_overlap(a: DataFrame, b: DataFrame, tests: int, alpha: float = 0.05) -> DataFrame:
    """Do two unpaired intervals overlap; Bonferroni level and expected false positives."""
    x = a.select("key", F.col("lower").alias("lower_a"), F.col("upper").alias("upper_a"), F.col("point").alias("point_a"))
    y = b.select("key", F.col("lower").alias("lower_b"), F.col("upper").alias("upper_b"), F.col("point").alias("point_b"))
    overlap = (F.col("lower_a") <= F.col("upper_b")) & (F.col("lower_b") <= F.col("upper_a"))
    return x.join(y, "key").select(
        "key", (F.col("point_a") - F.col("point_b")).alias("difference"), overlap.alias("overlap"),
        F.lit(alpha / tests).alias("bonferroni_alpha"), F.lit(alpha * tests).alias("expected_false_positives"))
