"""From irregular event streams to fixed-grid traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorgrid.functions.traces import MINIMUM_SCALE
from anchorgrid.functions.values import clipped_seconds
from anchorgrid.operators.ordered import Ordered, attach_row


def step_gaps(df: DataFrame, sample: str, t: str, player: str, t_anchor: str, clip: float | None = 10.0) -> DataFrame:
    """Distinct (time, player) steps with relative time and gaps to their neighbours, in s."""
    steps = df.select(sample, t_anchor, t, player).distinct()
    near = Ordered(steps, [sample], [t, player]).neighbour([t], "__p", -1).neighbour([t], "__n", 1).done()
    gap = lambda c: clipped_seconds(F.coalesce(c, F.lit(0)), clip)
    return near.select(
        sample, t, player,
        clipped_seconds(F.col(t) - F.col(t_anchor), clip).alias("relative_s"),
        gap(F.col(t) - F.col(f"__p.{t}")).alias("previous_s"),
        gap(F.col(f"__n.{t}") - F.col(t)).alias("next_s"),
    )


def average_duplicates(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    return df.groupBy(*keys, t).agg(F.avg(value).alias(value))


def grid_steps(start_ms: int, stop_ms: int, points: int) -> float:
    return (stop_ms - start_ms) / (points - 1)


def resample(
    df: DataFrame, keys: list[str], t: str, value: str, *, start_ms: int, stop_ms: int, points: int
) -> DataFrame:
    """Covered grid points of every stream: (keys, frame, value).

    Linear interpolation between the first and the last observation; a stream of one
    observation fills its nearest grid point, the earlier one on a tie. Every observation
    writes the grid points up to its successor, so the grid is never joined to the data.
    ``t`` is the offset from the anchor in ms.
    """
    step = grid_steps(start_ms, stop_ms, points)
    one = average_duplicates(df, keys, t, value)
    line = Ordered(one, keys, [t]).neighbour([t, value], "__next", 1).neighbour([t], "__prev", -1).done()
    here = F.col(t).cast("double")
    following = F.col(f"__next.{t}").cast("double")
    alone = F.col("__next").isNull() & F.col("__prev").isNull()
    first = F.floor((here - start_ms) / step) - 1
    last = F.floor((F.coalesce(following, here) - start_ms) / step) + 1
    candidates = F.sequence(
        F.greatest(F.lit(0), first).cast("int"),
        F.greatest(F.greatest(F.lit(0), first), F.least(F.lit(points - 1), last)).cast("int"))
    at = lambda f: F.lit(float(start_ms)) + f * F.lit(step)
    # an observation owns [t, next); the last one owns its own instant as well
    owned = F.filter(candidates, lambda f: (f < points) & (at(f) >= here) & F.when(
        F.col("__next").isNull(), at(f) <= here).otherwise(at(f) < following))
    low = F.floor((here - start_ms) / step)
    below = F.greatest(F.lit(0), F.least(F.lit(points - 1), low))
    above = F.greatest(F.lit(0), F.least(F.lit(points - 1), low + 1))
    nearest = F.when(F.abs(at(below) - here) <= F.abs(at(above) - here), below).otherwise(above)
    frames = F.when(alone, F.array(nearest.cast("int"))).otherwise(owned)
    rows = line.withColumn("frame", F.explode(frames))
    mixed = F.col(value) + (F.col(f"__next.{value}") - F.col(value)) * (at(F.col("frame")) - here) / (following - here)
    filled = F.when(F.col("__next").isNull(), F.col(value)).otherwise(mixed)
    return rows.select(*keys, "frame", filled.alias(value))


def to_traces(covered: DataFrame, keys: list[str], value: str, points: int) -> DataFrame:
    """(keys, values, present): dense arrays of ``points`` doubles, zero where not covered."""
    cells = F.map_from_entries(F.collect_list(F.struct("frame", value)))
    frames = F.sequence(F.lit(0), F.lit(points - 1))
    return covered.groupBy(*keys).agg(cells.alias("__m")).select(
        *keys,
        F.transform(frames, lambda f: F.coalesce(F.try_element_at("__m", f), F.lit(0.0))).alias("values"),
        F.transform(frames, lambda f: F.map_contains_key("__m", f).cast("double")).alias("present"),
    )


def channel_matrix(traces: DataFrame, samples: DataFrame, channels: DataFrame, points: int) -> DataFrame:
    """Every channel of every sample, presence channels included, zeros for absent streams.

    traces: sample_id, modality, kind_ix, values, present; channels: the channel table.
    Streams and channels meet on (sample, modality, index); the channel list is small and
    fixed, so each sample carries it as one array.
    """
    listed = channels.agg(F.array_sort(F.collect_list(
        F.struct("channel_ix", "channel", "modality", "kind", "kind_ix"))).alias("__c"))
    wanted = attach_row(samples, listed).select("sample_id", F.explode("__c").alias("c")).select("sample_id", "c.*")
    seen = traces.groupBy("sample_id", "modality").agg(F.first("present").alias("__seen"))
    zeros = F.array_repeat(F.lit(0.0), points)
    out = (
        wanted.join(traces.select("sample_id", "modality", "kind_ix", "values").withColumn("kind", F.lit("feature")),
                    ["sample_id", "modality", "kind", "kind_ix"], "left")
        .join(seen, ["sample_id", "modality"], "left")
    )
    filled = F.when(F.col("kind") == "present", F.coalesce("__seen", zeros)).otherwise(F.coalesce("values", zeros))
    return out.select("sample_id", "channel_ix", "channel", filled.alias("values"))


# -- normalizer ---------------------------------------------------------------------------


def fit_normalizer(df: DataFrame, features: str = "features", by: str = "modality") -> DataFrame:
    """(modality, feature_ix, mean, std): population moments; a tiny deviation becomes 1."""
    flat = df.select(by, F.posexplode(features).alias("feature_ix", "__x"))
    fitted = flat.groupBy(by, "feature_ix").agg(F.avg("__x").alias("mean"), F.stddev_pop("__x").alias("__s"))
    return fitted.select(
        by, "feature_ix", "mean",
        F.when(F.col("__s") < MINIMUM_SCALE, F.lit(1.0)).otherwise(F.col("__s")).alias("std"))


def with_defaults(normalizer: DataFrame, channels: DataFrame, by: str = "modality") -> DataFrame:
    """One row per channel; a channel without training rows gets mean 0 and deviation 1."""
    return channels.join(normalizer, [by, "feature_ix"], "left").select(
        by, "feature_ix", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(1.0)).alias("std"))


def _as_arrays(normalizer: DataFrame, by: str) -> DataFrame:
    """Normalizer rows packed per modality: as many rows as modalities, so it is broadcast."""
    packed = F.array_sort(F.collect_list(F.struct("feature_ix", "mean", "std")))
    return normalizer.groupBy(by).agg(packed.alias("__norm"))


def apply_normalizer(df: DataFrame, normalizer: DataFrame, features: str = "features", by: str = "modality", invert: bool = False) -> DataFrame:
    joined = df.join(F.broadcast(_as_arrays(normalizer, by)), by)
    step = (lambda x, n: x * n["std"] + n["mean"]) if invert else (lambda x, n: (x - n["mean"]) / n["std"])
    return joined.withColumn(features, F.zip_with(features, "__norm", step)).drop("__norm")


def rescale(df: DataFrame, source: DataFrame, target: DataFrame, features: str = "features", by: str = "modality") -> DataFrame:
    """From the units of one normalizer to those of another."""
    return apply_normalizer(apply_normalizer(df, source, features, by, invert=True), target, features, by)
