"""Time warps of raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def warp_events(df: DataFrame, kinds: list[str], kind: str, magnitude: float, *, step_ms: float, t: str, t_anchor: str) -> DataFrame:
    """Shift by whole steps, or scale about the anchor, the times of the selected event types."""
    if kind == "shift":
        moved = F.col(t) + F.lit(float(magnitude * step_ms))
    elif kind == "scale":
        moved = F.col(t_anchor) + F.lit(float(magnitude)) * (F.col(t) - F.col(t_anchor))
    else:
        raise ValueError("kind is 'shift' or 'scale'")
    return df.withColumn(t, F.when(F.col("event_type").isin(kinds), moved).otherwise(F.col(t)))
