"""Derived channels of the fixed grid.

A row is one channel of one sample: (sample_id, modality, block, ix, values, present) with
arrays over the grid. Block is raw, motion, flag, present or the name of a derived block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from anchorgrid.functions import face
from anchorgrid.functions.channels import BASE_WIDTH, FLAG_WIDTH, MOTION_WIDTH
from anchorgrid.functions.traces import MINIMUM_SCALE, masked_derivative, minus

# fixed values: where the xyz positions start inside the raw block
POSITIONS = {
    "Head": {"pose": 0}, "Body": {"pose": 0}, "LeftHand": {"pose": 0}, "RightHand": {"pose": 0},
    "Eye": {"left": 2, "right": 11}, "LeftFinger": {"pointer": 2, "root": 9},
    "RightFinger": {"pointer": 2, "root": 9},
}
AXES = ("x", "y", "z")


def _literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def root_relative(traces: DataFrame, reference: str = "Body", positions: dict | None = None) -> DataFrame:
    """Positions minus the reference position of the same sample and axis."""
    positions = positions or POSITIONS
    rows = [(m, start + a, f"relpos_{label}_{axis}", a)
            for m, starts in positions.items() if m != reference
            for label, start in starts.items() for a, axis in enumerate(AXES)]
    wanted = _literal_table(traces.sparkSession, rows, "modality string, ix int, name string, axis int")
    raw = traces.filter(F.col("block") == "raw")
    root = raw.filter((F.col("modality") == reference) & (F.col("ix") < 3)).select(
        "sample_id", F.col("ix").alias("axis"), F.col("values").alias("__v"), F.col("present").alias("__p"))
    joined = raw.join(wanted, ["modality", "ix"]).join(root, ["sample_id", "axis"])
    return joined.select(
        "sample_id", "modality", F.col("name").alias("block"), "ix", minus(F.col("values"), F.col("__v")).alias("values"),
        F.zip_with("present", "__p", lambda a, b: a * b).alias("present"))


def acceleration(traces: DataFrame, seconds: float, modalities: list[str] | None = None) -> DataFrame:
    """Masked derivative of every motion channel."""
    motion = traces.filter(F.col("block") == "motion")
    if modalities is not None:
        motion = motion.filter(F.col("modality").isin(modalities))
    return motion.withColumn("values", masked_derivative(F.col("values"), F.col("present"), seconds)).withColumn(
        "block", F.lit("accel"))


def action_units(traces: DataFrame, subset: str = "all", velocity: bool = False, members: dict | None = None,
                 modality: str = "Facial") -> DataFrame:
    """Mean trace of the member blendshapes per action unit, and of their rates if asked for."""
    members = members or face.unit_members(subset)
    rows = [(ix, unit, len(m)) for unit, m in members.items() for ix in m]
    table = _literal_table(traces.sparkSession, rows, "ix int, unit string, n int")
    blocks = ["raw", "motion"] if velocity else ["raw"]
    joined = traces.filter((F.col("modality") == modality) & F.col("block").isin(blocks)).join(table, "ix")
    # a unit has at most four members, so the group is bounded by the table
    grouped = joined.groupBy("sample_id", "modality", "block", "unit", "n").agg(
        F.array_sort(F.collect_list(F.struct("ix", "values", "present"))).alias("m"))
    zero = F.transform(F.col("m")[0]["values"], lambda _: F.lit(0.0))
    added = F.aggregate("m", zero, lambda acc, r: F.zip_with(acc, r["values"], lambda x, y: x + y))
    name = F.when(F.col("block") == "motion", F.concat("unit", F.lit("_velocity"))).otherwise(F.col("unit"))
    return grouped.select(
        "sample_id", "modality", name.alias("block"), F.lit(0).alias("ix"),
        F.transform(added, lambda x: x / F.col("n")).alias("values"), F.col("m")[0]["present"].alias("present"))


def dropped_channels(spark: SparkSession, *, positions: bool = True, keep_height_of: str | None = None,
                     blendshapes: bool = False, table: dict | None = None) -> DataFrame:
    """(modality, block, ix) of channels a representation leaves out."""
    rows = []
    if positions:
        for m, starts in (table or POSITIONS).items():
            for start in starts.values():
                rows += [(m, "raw", start + a) for a in range(3) if not (m == keep_height_of and a == 1)]
    if blendshapes:
        rows += [("Facial", block, i) for block in ("raw", "motion") for i in range(len(face.BLENDSHAPES))]
    return _literal_table(spark, rows, "modality string, block string, ix int")


def drop_channels(traces: DataFrame, dropped: DataFrame) -> DataFrame:
    return traces.join(dropped, ["modality", "block", "ix"], "left_anti")


def fit_derived(traces: DataFrame) -> DataFrame:
    """(modality, block, ix, mean, scale) over present frames; the scale is at least 1e-6."""
    frames = traces.select("modality", "block", "ix", F.explode(F.arrays_zip("values", "present")).alias("z"))
    seen = frames.filter(F.col("z.present") == 1).groupBy("modality", "block", "ix").agg(
        F.avg("z.values").alias("mean"), F.stddev_pop("z.values").alias("s"))
    return seen.select("modality", "block", "ix", "mean", F.greatest("s", F.lit(MINIMUM_SCALE)).alias("scale"))


def apply_derived(traces: DataFrame, fitted: DataFrame) -> DataFrame:
    """Standardise present frames; absent ones are zero. A block never seen keeps (0, 1)."""
    joined = traces.join(fitted, ["modality", "block", "ix"], "left")
    mean, scale = F.coalesce("mean", F.lit(0.0)), F.coalesce("scale", F.lit(1.0))
    scaled = F.zip_with("values", "present", lambda v, p: F.when(p == 1, (v - mean) / scale).otherwise(F.lit(0.0)))
    return joined.withColumn("values", scaled).drop("mean", "scale")


# -- left/right mirror ---------------------------------------------------------------------

PAIRS = {"LeftHand": "RightHand", "RightHand": "LeftHand", "LeftFinger": "RightFinger", "RightFinger": "LeftFinger"}


def _negated(modality: str, block: str) -> set[int]:
    """Indices whose sign turns: x of a position or velocity, y and z of a rotation."""
    poses, rotations = [], []
    if modality in ("Head", "Body", "LeftHand", "RightHand"):
        poses = [0]
    elif modality == "Eye":
        poses = [2, 11] if block == "raw" else [0, 6]
    elif modality.endswith("Finger"):
        poses = [2, 9] if block == "raw" else [1, 7]
        rotations = [16 + 4 * b for b in range(26)] if block == "raw" else [13 + 3 * b for b in range(26)]
    turned = set(poses)
    for start in [p + 3 for p in poses] + rotations:
        turned |= {start + 1, start + 2}
    return turned


def mirror_table(modalities=tuple(BASE_WIDTH)) -> list[tuple]:
    """(dst modality, block, dst ix, src modality, src ix, sign) for the whole grid.

    A pair with only one side on the grid is mirrored in place.
    """
    by_name = {n: i for i, n in enumerate(face.BLENDSHAPES)}
    rows = []
    for m in modalities:
        source = PAIRS.get(m, m)
        source = source if source in modalities else m
        for block, width in (("raw", BASE_WIDTH[m]), ("motion", MOTION_WIDTH[m]),
                             ("flag", FLAG_WIDTH.get(m, 0)), ("present", 1)):
            half = {"raw": 9, "motion": 6}.get(block)
            turned = _negated(m, block) if block in ("raw", "motion") else set()
            for ix in range(width):
                src = ix
                if m == "Eye" and half:
                    src = (ix + half) % (2 * half)
                if m == "Facial" and block in ("raw", "motion") and ix < len(face.BLENDSHAPES):
                    src = by_name[face.mirror_partner(face.BLENDSHAPES[ix])]
                rows.append((m, block, ix, source, src, -1.0 if ix in turned else 1.0))
    return rows


MIRROR_SCHEMA = "modality string, block string, ix int, src_modality string, src_ix int, sign double"


def mirror(traces: DataFrame, table: list[tuple] | None = None) -> DataFrame:
    """Left-right mirror image of standardised traces.

    The statistics of the source channel stay with the value, so mirroring is a channel
    exchange and a sign.
    """
    mapping = _literal_table(traces.sparkSession, table or mirror_table(), MIRROR_SCHEMA)
    source = traces.withColumnRenamed("modality", "src_modality").withColumnRenamed("ix", "src_ix")
    return source.join(mapping, ["src_modality", "block", "src_ix"]).withColumn(
        "values", F.transform("values", lambda x: x * F.col("sign"))
    ).select(*traces.columns)


def with_mirror_copies(traces: DataFrame, is_train: Column, table: list[tuple] | None = None) -> DataFrame:
    """Training rows plus their mirror images with ids ending in -mirror."""
    copies = mirror(traces.filter(is_train), table)
    copies = copies.withColumn("sample_id", F.concat(F.col("sample_id").cast("string"), F.lit("-mirror")))
    return traces.withColumn("sample_id", F.col("sample_id").cast("string")).unionByName(copies)
