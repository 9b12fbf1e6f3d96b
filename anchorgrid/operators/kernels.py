"""Random-convolution, competing-kernel and shapelet features.

Parameters are small arrays fixed by a seed (biases and shapelets come from a bounded md5
sample of training windows). Windows are transformed in Arrow batches where they lie: no
shuffle, one feature array per window.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from anchorgrid.functions.hashing import draw60
from anchorgrid.functions.traces import let

# fixed values: the 84 kernels put weight 2 on three of nine taps and -1 elsewhere
TAPS, HIGH = 9, 3
PATTERNS = list(combinations(range(TAPS), HIGH))
GOLDEN = (5**0.5 + 1) / 2
POOLINGS = ("PPV", "LSPV", "MPV", "MIPV", "ZC")


def sample_windows(df: DataFrame, values: str, id_column: str, rows: int, seed: int = 42) -> np.ndarray:
    """``rows`` windows in md5 order as [rows, channels, time]; a top-k, never a full sort."""
    picked = df.select(id_column, values).orderBy(draw60(seed, F.col(id_column)), id_column).limit(rows).collect()
    return np.array([np.atleast_2d(np.asarray(r[1], dtype=np.float64)) for r in picked])


def dilation_plan(length: int, per_kernel: int, limit: int = 32) -> list[tuple[int, int]]:
    """(dilation, biases) pairs: dilations spread on a log scale up to the series length."""
    many = max(1, min(per_kernel, limit))
    reach = np.log2((length - 1) / (TAPS - 1))
    steps, counts = np.unique((2.0 ** np.linspace(0, max(0.0, reach), many)).astype(int), return_counts=True)
    share = np.maximum(1, (counts * per_kernel / many).astype(int))
    while share.sum() < per_kernel:
        share[np.argmin(share)] += 1
    return [(int(d), int(n)) for d, n in zip(steps, share)]


def shifted(x: np.ndarray, offset: int) -> np.ndarray:
    """x moved along time by ``offset`` with zeros outside."""
    out = np.zeros_like(x)
    if offset == 0:
        out[:] = x
    elif 0 < offset < x.shape[-1]:
        out[..., :-offset] = x[..., offset:]
    elif 0 < -offset < x.shape[-1]:
        out[..., -offset:] = x[..., :offset]
    return out


def tap_stack(x: np.ndarray, dilation: int, taps: int = TAPS) -> np.ndarray:
    """[taps, ...]: the series seen by every tap of a centred dilated kernel."""
    return np.stack([shifted(x, (t - taps // 2) * dilation) for t in range(taps)])


def pattern_response(stack: np.ndarray, pattern) -> np.ndarray:
    """Response of a fixed kernel: minus the sum of all taps plus three times its high taps."""
    return 3.0 * stack[list(pattern)].sum(axis=0) - stack.sum(axis=0)


def pool(response: np.ndarray, bias: float, how: str) -> np.ndarray:
    """Pool [windows, time] around a bias."""
    above = response > bias
    count = above.sum(axis=1)
    length = response.shape[1]
    if how == "PPV":
        return count / length
    if how == "MPV":
        return np.where(count > 0, np.where(above, response - bias, 0.0).sum(axis=1) / np.maximum(count, 1), 0.0)
    if how == "MIPV":
        index = np.where(above, np.arange(length)[None, :], 0).sum(axis=1)
        return np.where(count > 0, index / np.maximum(count, 1), -1.0)
    if how == "LSPV":
        best = run = np.zeros(len(response))
        for t in range(length):
            run = np.where(above[:, t], run + 1, 0)
            best = np.maximum(best, run)
        return best
    if how == "ZC":
        left, right = response[:, :-1], response[:, 1:]
        crossing = ((left > bias) & (right < bias)) | ((left < bias) & (right > bias))
        return crossing.sum(axis=1) / length
    raise ValueError(f"unknown pooling {how!r}")


def zero_crossing_rate(trace: Column, bias: float = 0.0) -> Column:
    """Share of neighbours on opposite sides of the bias, as a column expression."""
    b = F.lit(float(bias))

    def rate(a):
        n = F.size(a)
        pairs = F.zip_with(F.slice(a, F.lit(1), n - 1), F.slice(a, F.lit(2), n - 1),
                           lambda l, r: (((l > b) & (r < b)) | ((l < b) & (r > b))).cast("int"))
        return F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / n

    return let(trace, rate)


def fit_patterns(windows: np.ndarray, features: int, seed: int = 42, poolings=("PPV",), views=("raw",)) -> dict:
    """Parameters of the fixed-kernel features.

    Every (view, dilation, kernel) gets a channel subset, and biases that are quantiles, spread
    by the golden ratio, of its response on one window of the sample.
    """
    rng = np.random.default_rng(seed)
    items, drawn = [], 0
    for view in views:
        x = np.diff(windows, axis=2) if view == "diff" else windows
        channels, length = x.shape[1], x.shape[2]
        per_kernel = max(1, features // (len(PATTERNS) * len(views)))
        for level, (dilation, biases) in enumerate(dilation_plan(length, per_kernel)):
            for number, pattern in enumerate(PATTERNS):
                size = min(channels, int(2 ** rng.uniform(0, np.log2(min(channels, TAPS) + 1))))
                subset = np.sort(rng.choice(channels, size, replace=False))
                one = x[int(rng.integers(len(x)))][None, subset].sum(axis=1)
                padded = (level + number) % 2 == 0
                response = _trim(pattern_response(tap_stack(one, dilation), pattern), dilation, padded)
                for _ in range(biases):
                    drawn += 1
                    bias = float(np.quantile(response, (drawn * GOLDEN) % 1.0))
                    items.append((view, dilation, pattern, tuple(int(c) for c in subset), padded, bias))
    return {"items": items, "poolings": tuple(poolings)}


def _trim(response: np.ndarray, dilation: int, padded: bool) -> np.ndarray:
    edge = (TAPS // 2) * dilation
    return response if padded or response.shape[1] <= 2 * edge else response[:, edge:-edge]


def pattern_features(x: np.ndarray, params: dict) -> np.ndarray:
    """[windows, items x poolings] of the fixed-kernel features."""
    views = {"raw": x, "diff": np.diff(x, axis=2)}
    out, cache = [], {}
    for view, dilation, pattern, subset, padded, bias in params["items"]:
        key = (view, dilation, subset)
        if key not in cache:
            if len(cache) > 64:
                cache.clear()
            cache[key] = tap_stack(views[view][:, list(subset)].sum(axis=1), dilation)
        response = _trim(pattern_response(cache[key], pattern), dilation, padded)
        out += [pool(response, bias, how) for how in params["poolings"]]
    return np.stack(out, axis=1)


def family_table(params: dict) -> list[tuple]:
    """(start, stop, view, dilation, pooling) of runs of equal family in the feature order."""
    rows, at = [], 0
    for view, dilation, *_ in params["items"]:
        for how in params["poolings"]:
            rows.append((at, at + 1, view, dilation, how))
            at += 1
    return rows


def fit_random(channels: int, length: int, kernels: int, seed: int) -> dict:
    """Independent random kernels: length 7, 9 or 11, centred normal weights, uniform bias."""
    rng = np.random.default_rng(seed)
    items = []
    for _ in range(kernels):
        taps = int(rng.choice([7, 9, 11]))
        weights = rng.normal(size=taps)
        weights -= weights.mean()
        dilation = int(2 ** rng.uniform(0, max(0.0, np.log2((length - 1) / (taps - 1)))))
        size = min(channels, int(2 ** rng.uniform(0, np.log2(channels + 1))))
        subset = tuple(int(c) for c in np.sort(rng.choice(channels, size, replace=False)))
        items.append((weights, float(rng.uniform(-1, 1)), dilation, bool(rng.integers(2)), subset))
    return {"items": items}


def random_features(x: np.ndarray, params: dict) -> np.ndarray:
    """PPV and maximum of every random kernel."""
    out = []
    for weights, bias, dilation, padded, subset in params["items"]:
        taps = len(weights)
        stack = tap_stack(x[:, list(subset)].sum(axis=1), dilation, taps)
        response = np.tensordot(weights, stack, axes=1) + bias
        edge = (taps // 2) * dilation
        if not padded and response.shape[1] > 2 * edge:
            response = response[:, edge:-edge]
        out += [(response > 0).mean(axis=1), response.max(axis=1)]
    return np.stack(out, axis=1)


def fit_competing(channels: int, length: int, groups: int, kernels: int, seed: int, max_channels: int = 8) -> dict:
    """Groups of centred, normalised random kernels per dilation and view, with channel subsets."""
    rng = np.random.default_rng(seed)
    top = max(0, int(np.log2((length - 1) / (TAPS - 1))))
    items = []
    for view in ("raw", "diff"):
        for dilation in [2**d for d in range(top + 1)]:
            for _ in range(groups):
                w = rng.normal(size=(kernels, TAPS))
                w -= w.mean(axis=1, keepdims=True)
                w /= np.abs(w).sum(axis=1, keepdims=True)
                size = int(rng.integers(1, min(max_channels, channels) + 1))
                items.append((view, dilation, w, tuple(int(c) for c in np.sort(rng.choice(channels, size, replace=False)))))
    return {"items": items, "kernels": kernels}


def competing_features(x: np.ndarray, params: dict) -> np.ndarray:
    """Per group and kernel: summed winning responses (max) and count of losing ones (min)."""
    views, k, out = {"raw": x, "diff": np.diff(x, axis=2)}, params["kernels"], []
    for view, dilation, weights, subset in params["items"]:
        stack = tap_stack(views[view][:, list(subset)].sum(axis=1), dilation)
        response = np.tensordot(weights, stack, axes=1)  # [kernels, windows, time]
        best, worst = response.argmax(axis=0), response.argmin(axis=0)
        top = response.max(axis=0)
        for j in range(k):
            out.append(np.where(best == j, top, 0.0).sum(axis=1))
        for j in range(k):
            out.append((worst == j).sum(axis=1))
    return np.stack(out, axis=1)


def fit_shapelets(windows: np.ndarray, groups: int, shapelets: int, size: int, seed: int, view: str = "raw") -> dict:
    """Dilated shapelets cut from sample windows, z-normalised, with a distance threshold each."""
    rng = np.random.default_rng(seed)
    x = np.diff(windows, axis=2) if view == "diff" else windows
    items = []
    for _ in range(groups):
        dilation = int(2 ** rng.uniform(0, max(0.0, np.log2((x.shape[2] - 1) / (size - 1)))))
        channel = int(rng.integers(x.shape[1]))
        group = []
        for _ in range(shapelets):
            w = x[int(rng.integers(len(x))), channel]
            start = int(rng.integers(len(w) - (size - 1) * dilation))
            shape = _unit(w[start:start + (size - 1) * dilation + 1:dilation][None])[0]
            other = x[int(rng.integers(len(x))), channel][None]
            group.append((shape, float(np.quantile(_profile(other, shape, dilation), rng.uniform(0.05, 0.1)))))
        items.append((dilation, channel, group))
    return {"items": items, "view": view}


def _unit(a: np.ndarray) -> np.ndarray:
    s = a.std(axis=-1, keepdims=True)
    return (a - a.mean(axis=-1, keepdims=True)) / np.where(s > 1e-7, s, 1.0)


def _profile(x: np.ndarray, shape: np.ndarray, dilation: int) -> np.ndarray:
    """[windows, positions] distances of a shapelet to every dilated piece of the series."""
    reach = (len(shape) - 1) * dilation
    pieces = np.stack([x[:, i:x.shape[1] - reach + i] for i in range(0, reach + 1, dilation)], axis=2)
    return np.sqrt(((_unit(pieces) - shape) ** 2).sum(axis=2))


def shapelet_features(x: np.ndarray, params: dict) -> np.ndarray:
    """Per group: smallest distance, soft wins at the minimum and the maximum, and hits."""
    x = np.diff(x, axis=2) if params["view"] == "diff" else x
    out = []
    for dilation, channel, group in params["items"]:
        d = np.stack([_profile(x[:, channel], shape, dilation) for shape, _ in group])
        near, far = d.argmin(axis=0), d.argmax(axis=0)
        for j, (_, threshold) in enumerate(group):
            out += [d[j].min(axis=1), np.where(near == j, d[j], 0).sum(axis=1), (far == j).sum(axis=1), (d[j] <= threshold).sum(axis=1)]
    return np.stack(out, axis=1)


EXTRACTORS = {"pattern": pattern_features, "random": random_features, "competing": competing_features, "shapelet": shapelet_features}


def features(values: Column, *blocks: tuple[str, dict], rows: int = 512) -> Column:
    """Feature array of every window: the blocks side by side, in float32."""

    @F.pandas_udf(ArrayType(FloatType()))
    def extract(batch: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(batch), rows):
            x = np.array([np.stack([np.asarray(c, dtype=np.float64) for c in w]) for w in batch.iloc[start:start + rows]])
            made = np.concatenate([EXTRACTORS[kind](x, params) for kind, params in blocks], axis=1)
            out += list(made.astype(np.float32))
        return pd.Series(out)

    return extract(values)
