"""Lenient value decoding: malformed input becomes zero, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

AXES = ("x", "y", "z")
QUATERNION_AXES = ("x", "y", "z", "w")
LOGIT_CLIP = 1e-7


def finite(value: Column, default: float = 0.0) -> Column:
    """Double value, or ``default`` when missing, unparsable, NaN or infinite."""
    number = value.try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(number)


def finite_or_null(value: Column) -> Column:
    """Non-finite doubles become null, as needed at every JSON or CSV sink."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def fixed_array(values: Column, size: int) -> Column:
    """Exactly ``size`` finite doubles: cut when longer, zero-padded when shorter."""
    padded = F.concat(
        F.coalesce(values.cast("array<string>"), F.array().cast("array<string>")),
        F.array_repeat(F.lit("0"), size),
    )
    return F.transform(F.slice(padded, 1, size), finite)


def position(value: Column) -> Column:
    """``array(x, y, z)`` of a struct, zeros for what is missing."""
    return F.array(*[F.coalesce(finite(value[a]), F.lit(0.0)) for a in AXES])


def unit_quaternion(x: Column, y: Column, z: Column, w: Column) -> Column:
    """``array(x, y, z, w)`` of norm one in the w >= 0 hemisphere; zeros if the norm is tiny."""
    parts = [finite(c) for c in (x, y, z, w)]
    norm = F.sqrt(sum((c * c for c in parts[1:]), parts[0] * parts[0]))
    sign = F.when(parts[3] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(norm < 1e-8, F.array(*[F.lit(0.0)] * 4)).otherwise(
        F.array(*[c / norm * sign for c in parts])
    )


def quaternion(value: Column) -> Column:
    return unit_quaternion(*[value[a] for a in QUATERNION_AXES])


def pose(*alternatives: tuple[Column, Column]) -> Column:
    """Seven pose values from the first alternative (position, orientation) that is present."""
    place = F.coalesce(*[p for p, _ in alternatives])
    turn = F.coalesce(*[o for _, o in alternatives])
    return F.concat(position(place), quaternion(turn))


def float_from_bits(bits: Column) -> Column:
    """IEEE-754 single stored as its unsigned 32-bit pattern; NaN and infinity give null."""
    bits = bits.cast("bigint")
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    fraction = bits.bitwiseAND(F.lit(8388607)).cast("double") / F.lit(8388608.0)
    sign = F.when(F.shiftright(bits, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    normal = (1.0 + fraction) * F.pow(F.lit(2.0), exponent - 127)
    tiny = fraction * F.lit(2.0**-126)
    return F.when(exponent < 255, sign * F.when(exponent == 0, tiny).otherwise(normal))


def decoded_confidence(value: Column, is_integer: Column | None = None) -> Column:
    """Confidence that may have been serialised as a bit pattern.

    Integers other than 0 and 1 that fit 32 unsigned bits are decoded; everything else,
    and every pattern that is not finite, is read as a plain number.
    """
    whole = value.try_cast("bigint")
    decodes = whole.isNotNull() & (whole > 1) & (whole <= F.lit(4294967295))
    decodes = decodes & (is_integer if is_integer is not None else whole.cast("string") == value.cast("string"))
    return F.coalesce(F.when(decodes, float_from_bits(whole)), finite(value))


def bit_flags(value: Column, width: int) -> Column:
    """Bits 0..width-1 of an integer as an array of doubles; unreadable values give zeros."""
    whole = F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))
    # shift counts are literals, so each bit is its own generated expression
    return F.array(
        *[F.shiftright(whole, b).bitwiseAND(F.lit(1).cast("bigint")).cast("double") for b in range(width)]
    )


def sigmoid(x: Column) -> Column:
    """Logistic function that never exponentiates a positive number."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column, clip: float = LOGIT_CLIP) -> Column:
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.log(p / (1 - p))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def clipped_seconds(millis: Column, limit: float | None = 10.0) -> Column:
    seconds = millis / F.lit(1000.0)
    if limit is None:
        return seconds
    return F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), seconds))


def half_even(x: Column) -> Column:
    """Round half to even, the rule of the index arithmetic."""
    return F.rint(x).cast("bigint")


def actor_relation(event_player: Column, anchor_player: Column) -> Column:
    """0 same actor as the anchor, 1 another actor, 2 unknown (either id is empty)."""
    event_player = F.coalesce(event_player.cast("string"), F.lit(""))
    anchor_player = F.coalesce(anchor_player.cast("string"), F.lit(""))
    return (
        F.when((event_player == "") | (anchor_player == ""), 2)
        .when(event_player == anchor_player, 0)
        .otherwise(1)
    )


ACTOR_SCOPES = {"anchor": 0, "other": 1}


def in_actor_scope(relation: Column, scope: str) -> Column:
    if scope == "all":
        return F.lit(True)
    return relation == ACTOR_SCOPES[scope]


# fixed values: event source of a dataset family -> actor scope of its grid
SCOPE_OF_SOURCE = {"speaker": "anchor", "listener": "other", "both": "all"}
