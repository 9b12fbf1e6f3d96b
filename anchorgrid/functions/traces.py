"""Functions on one trace: an array of doubles over a fixed time grid.

A trace has a fixed number of points (16 to 64), so it travels as one array value. All
functions here are narrow column expressions: they add no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MINIMUM_TRACE_STD = 1e-7
MINIMUM_SCALE = 1e-6


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a lambda variable is its name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def std(a: Column) -> Column:
    """Population standard deviation, from centred squares."""
    return let(a, lambda a: F.sqrt(centred_squares(a, mean(a)) / F.size(a)))


def centred_squares(a: Column, m: Column) -> Column:
    return F.aggregate(
        a, F.struct(F.lit(0.0).alias("s"), m.alias("m")),
        lambda acc, x: F.struct((acc["s"] + (x - acc["m"]) * (x - acc["m"])).alias("s"), acc["m"].alias("m")),
        lambda acc: acc["s"],
    )


def collapse_near_constant(a: Column) -> Column:
    """A trace whose deviation is at most 1e-7 but not zero range becomes its mean."""

    def leveled(a):
        flat = (std(a) <= MINIMUM_TRACE_STD) & (F.array_max(a) != F.array_min(a))
        return F.when(flat, F.array_repeat(mean(a), F.size(a))).otherwise(a)

    return let(a, leveled)


def difference(a: Column, times: int = 1) -> Column:
    def once(a):
        n = F.size(a)
        return F.zip_with(F.slice(a, F.lit(2), n - 1), F.slice(a, F.lit(1), n - 1), lambda x, y: x - y)

    for _ in range(times):
        a = let(a, once)
    return a


def reflect_pad(a: Column, p: int) -> Column:
    """Mirror ``p`` points at both ends without repeating the end point."""
    n = F.size(a)
    head = F.reverse(F.slice(a, F.lit(2), F.lit(p)))
    tail = F.reverse(F.slice(a, n - p, F.lit(p)))
    return F.concat(head, a, tail)


def moving_average(a: Column, window: int) -> Column:
    """Centred moving average of odd length with reflected ends."""
    if window < 3 or window % 2 == 0:
        raise ValueError("window must be odd and at least 3")
    return let(let(a, lambda a: reflect_pad(a, window // 2)), lambda padded: F.transform(
        F.sequence(F.lit(1), F.size(padded) - (window - 1)),
        lambda i: total(F.slice(padded, i, F.lit(window))) / window))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def temporal_view(a: Column, name: str, *, window: int = 5, epsilon: float = 1e-6) -> Column:
    """One of the six views of a trace, with flat residue collapsed."""
    if name == "raw":
        view = a
    elif name == "first_diff":
        view = difference(a)
    elif name == "second_diff":
        view = difference(a, 2)
    elif name == "smoothed":
        view = moving_average(a, window)
    elif name == "highpass":
        view = minus(a, moving_average(a, window))
    elif name == "local_norm":
        def scaled(rest):
            local = moving_average(F.transform(rest, lambda x: x * x), window)
            return F.zip_with(rest, local, lambda x, v: x / F.sqrt(v + F.lit(epsilon)))

        view = let(minus(a, moving_average(a, window)), scaled)
    else:
        raise ValueError(f"unknown view {name!r}")
    return collapse_near_constant(view)


VIEWS = ("raw", "first_diff", "second_diff", "smoothed", "highpass", "local_norm")


def masked_derivative(values: Column, present: Column, seconds: float) -> Column:
    """Time derivative from observed frames only.

    Both neighbours observed: central difference; one of them: one-sided; otherwise, or when
    the frame itself is absent, zero. ``present`` is an array of 0/1 integers.
    """
    n = F.size(values)

    def at(a, i):
        return F.get(a, i)

    def rate(x, i):
        here = at(present, i) == 1
        before = here & (i > 0) & (F.coalesce(at(present, i - 1), F.lit(0)) == 1)
        after = here & (i < n - 1) & (F.coalesce(at(present, i + 1), F.lit(0)) == 1)
        forward, backward = at(values, i + 1) - x, x - at(values, i - 1)
        return (
            F.when(before & after, (forward + backward) / F.lit(2.0 * seconds))
            .when(after, forward / F.lit(seconds))
            .when(before, backward / F.lit(seconds))
            .otherwise(F.lit(0.0))
        )

    return F.transform(values, rate)


def z_normalised(a: Column, epsilon: float = 1e-8) -> Column:
    moments = F.struct(mean(a).alias("m"), std(a).alias("s"))
    return let(moments, lambda z: F.transform(a, lambda x: (x - z["m"]) / (z["s"] + epsilon)))


def periodogram(a: Column, points: int) -> Column:
    """Magnitude spectrum |DFT| of a trace of ``points`` values, frequencies 0..points/2 - 1.

    The cosine and sine basis are literals, so this is a dot product per frequency.
    """
    import math

    def basis(f, wave):
        return F.array(*[F.lit(wave(2 * math.pi * f * i / points)) for i in range(points)])

    def dot(b):
        return total(F.zip_with(a, b, lambda x, y: x * y))

    out = []
    for f in range(points // 2):
        re, im = dot(basis(f, math.cos)), dot(basis(f, math.sin))
        out.append(F.sqrt(re * re + im * im))
    return F.array(*out)


def source_position(i: Column, points: int, kind: str, magnitude: float, center: float | None = None) -> Column:
    """Where output grid point ``i`` of a warped trace comes from."""
    if kind == "shift":
        return i - F.lit(float(magnitude))
    if kind != "scale" or magnitude <= 0:
        raise ValueError("kind is 'shift' or 'scale', a scale is positive")
    c = (points - 1) / 2.0 if center is None else float(center)
    return F.lit(c) + (i - F.lit(c)) / F.lit(float(magnitude))


def linear_warp(a: Column, points: int, kind: str, magnitude: float, center: float | None = None) -> Column:
    """Linear interpolation at the source positions; outside the trace the value is zero."""

    def value(x, i):
        p = source_position(i.cast("double"), points, kind, magnitude, center)
        low = F.floor(p).cast("int")
        v0 = F.get(a, F.greatest(low, F.lit(0)))
        v1 = F.get(a, F.least(low + 1, F.lit(points - 1)))
        inside = (p >= 0) & (p <= points - 1)
        return F.when(inside, v0 + (v1 - v0) * (p - low)).otherwise(F.lit(0.0))

    return F.transform(a, value)


def nearest_warp(a: Column, points: int, kind: str, magnitude: float, center: float | None = None) -> Column:
    """Nearest source point, half to even; for presence and flags."""

    def value(x, i):
        p = F.rint(source_position(i.cast("double"), points, kind, magnitude, center)).cast("int")
        inside = (p >= 0) & (p <= points - 1)
        return F.when(inside, F.get(a, F.greatest(p, F.lit(0)))).otherwise(F.lit(0.0))

    return F.transform(a, value)


def shift_without_wrap(a: Column, shift: Column) -> Column:
    """Move a trace by whole steps; the points that come free are zero."""
    return F.transform(a, lambda x, i: F.when(
        (i - shift >= 0) & (i - shift < F.size(a)), F.get(a, F.greatest(i - shift, F.lit(0)))
    ).otherwise(F.lit(0.0)))


def add_noise(a: Column, present: Column, std_dev: float, *key) -> Column:
    """Gaussian noise on observed points, drawn by the md5 of the key and the point number."""
    import math

    from anchorgrid.functions.hashing import uniform

    def noisy(x, i):
        u1, u2 = uniform(*key, "u", i), uniform(*key, "v", i)
        gauss = F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(2 * math.pi * u2)
        return x + F.lit(std_dev) * gauss * F.get(present, i)

    return F.transform(a, noisy)


REGIONS = ("pre", "post", "global")


def pooled(values: Column, present: Column, times: list[float], region: str) -> Column:
    """Struct (mean, maximum, std) over the observed frames of a region; zeros when empty."""
    t = F.array(*[F.lit(float(x)) for x in times])
    inside = {"global": lambda x: F.lit(True), "pre": lambda x: x < 0, "post": lambda x: x >= 0}[region]
    kept = F.transform(
        F.filter(F.arrays_zip(values.alias("v"), present.alias("p"), t.alias("t")),
                 lambda z: inside(z["t"]) & (z["p"] == 1)),
        lambda z: z["v"],
    )

    def statistics(kept):
        some, zero = F.size(kept) > 0, F.lit(0.0)
        return F.struct(
            F.when(some, mean(kept)).otherwise(zero).alias("mean"),
            F.when(some, F.array_max(kept)).otherwise(zero).alias("maximum"),
            F.when(some, std(kept)).otherwise(zero).alias("std"),
        )

    return let(kept, statistics)


def clips(a: Column, length: int) -> Column:
    """Array of consecutive clips; a length that does not divide the trace is an error."""
    whole = F.when(F.size(a) % length == 0, F.size(a) / length).otherwise(
        F.raise_error(F.lit(f"trace length is not a multiple of {length}")).cast("double")
    ).cast("int")
    return F.transform(F.sequence(F.lit(0), whole - 1), lambda c: F.slice(a, c * length + 1, F.lit(length)))
