"""Seeded randomness: every draw is an md5 of text, so no result depends on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def text_key(*parts) -> Column:
    """Join values with ':' as the text to be hashed; plain Python values become literals."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in columns])


def draw(*parts) -> Column:
    """Non-negative integer below 2**32, the first 8 hex digits of the md5."""
    return F.conv(F.substring(F.md5(text_key(*parts)), 1, 8), 16, 10).cast("bigint")


def draw60(*parts) -> Column:
    """Non-negative integer below 2**60, for orders in which ties should not happen."""
    return F.conv(F.substring(F.md5(text_key(*parts)), 1, 15), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Double in [0, 1)."""
    return draw(*parts).cast("double") / F.lit(4294967296.0)
