"""Channel tables: the order, names and layout of grid channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: modality order and feature widths
MODALITIES = (
    "Eye", "Facial", "Head", "Body", "LeftHand", "RightHand", "LeftFinger", "RightFinger",
)
BASE_WIDTH = {"Eye": 18, "Facial": 67, "Head": 7, "Body": 7, "LeftHand": 7, "RightHand": 7,
              "LeftFinger": 130, "RightFinger": 130}
MOTION_WIDTH = {"Eye": 12, "Facial": 63, "Head": 6, "Body": 6, "LeftHand": 6, "RightHand": 6,
                "LeftFinger": 96, "RightFinger": 96}
FLAG_WIDTH = {"LeftFinger": 13, "RightFinger": 13}


def channel_table(
    spark: SparkSession, widths: dict[str, int] | None = None,
    flags: dict[str, int] | None = None, presence: bool = True,
) -> DataFrame:
    """(channel_ix, channel, modality, kind, kind_ix) in modality order.

    Without arguments this is the full channel list of the multimodal grid.
    """
    if widths is None:
        widths = {m: BASE_WIDTH[m] + MOTION_WIDTH[m] for m in MODALITIES}
        flags = FLAG_WIDTH
    flags = flags or {}
    blocks, start = [], 0
    for modality, width in widths.items():
        for kind, n in (("feature", width), ("flag", flags.get(modality, 0)), ("present", int(presence))):
            if n:
                blocks.append((modality, kind, start, n))
                start += n
    table = spark.createDataFrame(blocks, "modality string, kind string, start int, n int")
    named = F.when(F.col("kind") == "present", F.lit("present")).otherwise(
        F.concat("kind", F.lit("_"), F.col("kind_ix").cast("string"))
    )
    return (
        table.withColumn("kind_ix", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(
            (F.col("start") + F.col("kind_ix")).alias("channel_ix"),
            F.concat("modality", F.lit("."), named).alias("channel"), "modality", "kind", "kind_ix",
        )
    )


CHANNEL = r"^(.+)\.(feature|flag|present)(?:_([0-9]+))?$"


def parse_channel(name: Column) -> dict[str, Column]:
    """modality, kind and index of a channel name; nulls when the name is malformed."""
    part = lambda i: F.when(F.regexp_extract(name, CHANNEL, i) != "", F.regexp_extract(name, CHANNEL, i))
    return {"modality": part(1), "kind": part(2), "kind_ix": part(3).try_cast("int")}


def channel_layout(channels: DataFrame, base_widths: dict[str, int] | None = None) -> DataFrame:
    """Slices per (modality, block): raw, motion, flag, present.

    ``channels`` has channel_ix and channel. A block that is not contiguous, or whose local
    indices do not count up from zero, gets ``contiguous`` false.
    """
    base_widths = base_widths or BASE_WIDTH
    parsed = channels.select("channel_ix", *[c.alias(n) for n, c in parse_channel(F.col("channel")).items()])
    width = F.create_map(*[F.lit(x) for pair in base_widths.items() for x in pair])
    block = F.when(
        (F.col("kind") == "feature") & (F.col("kind_ix") >= width[F.col("modality")]), "motion"
    ).when(F.col("kind") == "feature", "raw").otherwise(F.col("kind"))
    return (
        parsed.withColumn("block", block)
        .groupBy("modality", "block")
        .agg(
            F.min("channel_ix").alias("start"), (F.max("channel_ix") + 1).alias("stop"),
            F.count(F.lit(1)).alias("width"),
            (F.max("kind_ix") - F.min("kind_ix") + 1).alias("__span"),
        )
        .select(
            "modality", "block", "start", "stop", "width",
            (
                (F.col("stop") - F.col("start") == F.col("width"))
                & (F.coalesce("__span", F.lit(1)) == F.col("width"))
            ).alias("contiguous"),
        )
    )


def modality_slices(channels: DataFrame, modalities: list[str] | None = None) -> DataFrame:
    """Contiguous channel range per modality; a gap raises an error."""
    if modalities is not None:
        channels = channels.filter(F.col("modality").isin(modalities))
    ranges = channels.groupBy("modality").agg(
        F.min("channel_ix").alias("start"), (F.max("channel_ix") + 1).alias("stop"),
        F.count(F.lit(1)).alias("width"),
    )
    checked = F.when(F.col("stop") - F.col("start") == F.col("width"), F.col("width")).otherwise(
        F.raise_error(F.concat(F.lit("channels of a modality are not contiguous: "), "modality")).cast("bigint")
    )
    return ranges.withColumn("width", checked)


def check_grouping(groups: list[list[str]], modalities=MODALITIES) -> list[tuple[str, ...]]:
    """Groups must split the modalities: every one in exactly one group."""
    flat = [m for g in groups for m in g]
    if sorted(flat) != sorted(modalities):
        raise ValueError(f"groups must hold each modality exactly once, got {flat}")
    return [tuple(m for m in modalities if m in g) for g in groups]


def mask_values(grid: DataFrame, masked: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Zero the values of masked channels and keep every row, so the layout stays."""
    flag = masked.select(*on).distinct().withColumn("__masked", F.lit(True))
    joined = grid.join(flag, on, "left")
    return joined.withColumn(
        value, F.when(F.col("__masked"), F.lit(0.0)).otherwise(F.col(value))
    ).drop("__masked")


def parse_masked_channel(name: Column, widths: dict[str, int]) -> dict[str, Column]:
    """modality and feature index of ``Modality.feature_i``; unknown names raise an error."""
    modality = F.regexp_extract(name, r"^(.+?)\.feature_([0-9]+)$", 1)
    index = F.regexp_extract(name, r"^(.+?)\.feature_([0-9]+)$", 2).try_cast("int")
    width = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair])
    known = F.coalesce(index < F.try_element_at(width, modality), F.lit(False))
    error = F.raise_error(F.concat(F.lit("unknown masked channel: "), name)).cast("int")
    return {"modality": modality, "feature_ix": F.when(known, index).otherwise(error)}
