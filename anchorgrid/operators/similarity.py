"""Trajectory distances, neighbours and separability scans.

Pairs of a query and a reference are never shuffled one by one. Both sides of a key are cut
into blocks of bounded size, a task gets one block of each, and sends back only the k nearest
references per query. A hot key is many block pairs, and the result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from anchorgrid.functions.traces import let
from anchorgrid.functions.values import logit
from anchorgrid.operators.attribution import scored
from anchorgrid.operators.metrics import confusion, metric_columns
from anchorgrid.operators.ordered import attach_row
from anchorgrid.operators.warping import QUERY_BLOCK, REFERENCE_BLOCK, blocked, nearest_by_warping
from anchorgrid.session import cut_lineage

ZERO_DISTANCE = 1e-12


def trajectories(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Observed frames only: (keys, values, time_ix); at least two frames are needed."""
    seen = F.filter(
        F.transform(F.arrays_zip("values", "present"), lambda z, i: F.struct(z["values"].alias("v"), z["present"].alias("p"), i.alias("i"))),
        lambda z: z["p"] > 0.5)
    rows = traces.withColumn("__z", seen).filter(F.size("__z") >= 2)
    return rows.select(*keys, F.col("__z.v").alias("values"), F.col("__z.i").alias("time_ix"))


def latent_statistics(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """Mean vector norm per key and the sample deviation of all components."""
    rows = df.withColumn("__n", F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)))
    spread = df.select(F.explode(vector).alias("x")).agg(F.stddev_samp("x").alias("s"))
    means = attach_row(rows.groupBy(*by).agg(F.avg("__n").alias("m")), spread)
    return means.select(*by, (F.round("m", 6) + 0.0).alias("mean_norm"), (F.round("s", 6) + 0.0).alias("latent_std"))


# -- euclidean distance: a block of queries against a block of references ---------------------------

EUCLIDEAN_QUERIES, EUCLIDEAN_REFERENCES = 16384, 32768  # rows of a block
TILE = 1 << 21  # distances of one matrix product
HEIGHT = 256  # queries of one matrix product
GROUP = 32  # references that share their least distance
LARGE = 1e150  # values beyond have no square
NOWHERE = np.float32(1e30)  # a place without a reference


def exact_distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.sqrt(((r - q) ** 2).sum(axis=-1))


def _kept(d: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest and of the nearest of each label, ties to the smaller id."""
    order = np.lexsort((ids, d))
    firsts = [same[:1] for y in (0, 1) if len(same := order[labels[order] == y])]
    return np.unique(np.concatenate([order[:k], *firsts]))


def _grouped(kinds: list[np.ndarray], width: int) -> tuple[np.ndarray, list[int]]:
    """[width, groups] places of references, -1 where there is none, and the edges between the groups of each kind."""
    parts, edges = [], [0]
    for kind in kinds:
        many = -(-len(kind) // width)
        part = np.full(width * many, -1)
        part[: len(kind)] = kind
        parts.append(part.reshape(width, many))
        edges.append(edges[-1] + many)
    return np.concatenate(parts, axis=1), edges


def _nearest_of_rows(row: np.ndarray, at: np.ndarray, d: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """What :func:`_kept` keeps of each row, for all rows of a tile at once."""
    order = np.lexsort((ids[at], d, row))
    row = row[order]
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    keep = np.arange(len(row)) - np.repeat(begins, np.diff(begins, append=len(row))) < k
    for y in (0, 1):
        same = np.flatnonzero(labels[at[order]] == y)
        keep[same[np.diff(row[same], prepend=-1) != 0]] = True
    return order[keep]


def nearest_in_block(q: np.ndarray, r: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, distance) of the k nearest references of each query and the nearest of each label.

    Squared distances come as matrix products of tiles in single precision. References of one label share a group and its least distance; the least distances of the
    groups bound the k-th and that of the label, and within the rounding only groups below a bound are looked into. Distances are then taken from the vectors. Rows with
    values that are not finite, or too large for a square, have no such product and are compared one by one.
    """
    # written so that what is not a number is not plain
    whole_q, whole_r = (np.abs(q) < LARGE).all(axis=1), (np.abs(r) < LARGE).all(axis=1)
    plain = np.flatnonzero(whole_r)
    kinds = [np.flatnonzero(whole_r & (labels == y)) for y in (0, 1)]
    if len(plain) < min(k, len(r)) or any((labels == y).any() and not len(kind) for y, kind in enumerate(kinds)):
        whole_q = np.zeros(len(q), bool)
    out: list = [[], [], []]

    def add(row: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
        for part, values in zip(out, (row, at, d)):
            part.append(values)

    for row in np.flatnonzero(~whole_q):
        d = exact_distances(q[row], r)
        best = _kept(d, ids, labels, k)
        add(np.full(len(best), row), best, d[best])
    rows = np.flatnonzero(whole_q)
    if len(rows) and len(plain):
        kinds.append(np.setdiff1d(plain, np.concatenate(kinds)))
        width = int(np.clip(len(plain) // (8 * k), 1, GROUP))
        places, edges = _grouped(kinds, width)
        groups, filled = places.shape[1], places.ravel() >= 0
        centre = r[plain].mean(axis=0)
        y = r[places.ravel()[filled]] - centre
        # the largest value becomes one, so that no square leaves single precision
        scale = max(np.abs(y).max(initial=0), np.abs(q[rows] - centre).max(initial=0)) or 1.0
        norms = ((y / scale) ** 2).sum(axis=1)
        right = np.zeros((q.shape[1] + 1, places.size), np.float32)
        right[:-1, filled], right[-1, filled], right[-1, ~filled] = -2 * (y / scale).T, norms, NOWHERE
        # a product is of many queries and few groups, so that it stays in the cache until its least distances are known
        right, step = right.reshape(-1, width, groups), max(1, TILE // (HEIGHT * width))
        tiles = [np.ascontiguousarray(right[:, :, g : g + step]).reshape(len(right), -1) for g in range(0, groups, step)]
        together = np.full((groups, width, q.shape[1]), np.sqrt(NOWHERE), np.float32)
        together[places.T >= 0] = ((r[places.T[places.T >= 0]] - centre) / scale).astype(np.float32)
        # of sums of so many products, each off by a rounding, and of what is too small for single precision
        error = 4 * (q.shape[1] + 4) * float(np.finfo(np.float32).eps)
        some = max(1, TILE // (width * q.shape[1]))  # groups looked into at a time
        for a in range(0, len(rows), HEIGHT):
            x = (q[rows[a : a + HEIGHT]] - centre) / scale
            own = (x**2).sum(axis=1)
            slack = (2 * error * (own + norms.max()) + 1e-30)[:, None]
            left = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
            least = np.concatenate([(left @ tile).reshape(len(x), width, -1).min(axis=1) for tile in tiles], axis=1)  # less the norm of the query
            # k groups hold k references, so the k-th is no further than their least ones
            limit = np.full((len(x), groups), np.inf)
            if k < groups:
                limit[:] = np.partition(least, k - 1, axis=1)[:, k - 1 : k]
            for first, last in zip(edges[:2], edges[1:3]):
                if last > first:
                    np.maximum(limit[:, first:last], least[:, first:last].min(axis=1, keepdims=True), out=limit[:, first:last])
            limit += slack
            all_rows, all_groups = np.nonzero(least <= limit)
            found: list = []
            for i in range(0, len(all_rows), some):
                row, group = all_rows[i : i + some], all_groups[i : i + some]
                apart = together[group] - left[row, None, :-1]
                near, member = np.nonzero((np.einsum("gmd,gmd->gm", apart, apart) <= (limit[row, group] + own[row])[:, None]) & (places[:, group].T >= 0))
                row, at = row[near], places[member, group[near]]
                found.append((row, at, exact_distances(q[rows[a + row]], r[at])))
            row, at, d = (np.concatenate(part) for part in zip(*found))
            best = _nearest_of_rows(row, at, d, ids, labels, k)
            add(rows[a + row[best]], at[best], d[best])
    return tuple(np.concatenate(part) if part else np.array([], dtype=int) for part in out)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_list()).astype(float)


def nearest_references(
    queries: DataFrame, references: DataFrame, keys: list[str], k: int, *, metric: str = "dtw", window: float = 1.0,
    query_block: int | None = None, reference_block: int | None = None,
) -> DataFrame:
    """(keys, query_id, reference_id, reference_label, distance, rank): k nearest, plus the
    nearest one of each label (rank may exceed k for those).

    queries: keys, query_id, values array<double> or array<array<double>>; references: keys,
    reference_id, label, values. For the euclidean metric all rows of a key are of one length.
    """
    if metric not in ("dtw", "euclidean"):
        raise KeyError(metric)
    if metric == "dtw":
        frames = lambda df: df.withColumn("values", F.transform("values", lambda x: F.array(x))) if dict(df.dtypes)["values"] == "array<double>" else df
        return nearest_by_warping(
            frames(queries).withColumn("window", F.lit(float(window))), frames(references), keys, k, query_block=query_block or QUERY_BLOCK, reference_block=reference_block or REFERENCE_BLOCK).drop("window")
    flat = lambda df: df if dict(df.dtypes)["values"] == "array<double>" else df.withColumn("values", F.flatten("values"))
    # both sides are read several times from here on
    q = cut_lineage(blocked(flat(queries), keys, "query_id", query_block or EUCLIDEAN_QUERIES, "qb"))
    r = cut_lineage(blocked(flat(references), keys, "reference_id", reference_block or EUCLIDEAN_REFERENCES, "rb"))
    grid_q = r.groupBy(*keys).agg(F.max("rbs").alias("rbs"))
    grid_r = q.groupBy(*keys).agg(F.max("qbs").alias("qbs"))
    q = q.join(grid_q, keys).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rbs") - 1)))
    r = r.join(grid_r, keys).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)))
    at = [*keys, "qb", "rb"]
    key_types = [(c, dict(queries.dtypes)[c]) for c in keys]
    schema = ", ".join(f"`{c}` {t}" for c, t in key_types) + ", query_id bigint, reference_id bigint, reference_label int, distance double"
    columns = [*keys, "query_id", "reference_id", "reference_label", "distance"]

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        labels, ids = right["label"].to_numpy(), right["reference_id"].to_numpy()
        row, at, distance = nearest_in_block(_matrix(left["q_values"]), _matrix(right["r_values"]), ids, labels, k)
        out = {c: [value] * len(row) for c, value in zip(keys, key)}
        out |= {"query_id": left["query_id"].to_numpy()[row], "reference_id": ids[at], "reference_label": labels[at], "distance": distance}
        return pd.DataFrame(out, columns=columns)

    # both sides may come from one table, so each gets column names of its own
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in at], "query_id", F.col("values").alias("q_values"))
    r = r.select(*[F.col(c).alias(f"r_{c}") for c in at], "reference_id", "label", F.col("values").alias("r_values"))
    # a pair of blocks is small in bytes and long in work, so the partitions are not to be coalesced by size
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, r = q.repartition(n, *[f"q_{c}" for c in at]), r.repartition(n, *[f"r_{c}" for c in at])
    found = q.groupBy(*[f"q_{c}" for c in at]).cogroup(r.groupBy(*[f"r_{c}" for c in at])).applyInPandas(search, schema)
    place = Window.partitionBy(*keys, "query_id").orderBy("distance", "reference_id")
    per_label = Window.partitionBy(*keys, "query_id", "reference_label").orderBy("distance", "reference_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).withColumn("__l", F.row_number().over(per_label))
    return ranked.filter((F.col("rank") <= k) | (F.col("__l") == 1)).drop("__l")


def knn_inverse_distance(neighbours: DataFrame, keys: list[str], k: int | Column) -> DataFrame:
    """Probability of label 1 from the k nearest, weighted by inverse distance; k may be a column of ``keys``.

    A neighbour at distance zero decides alone: the mean label of all such neighbours.
    """
    near = F.col("rank") <= k
    d, y = F.col("distance"), F.col("reference_label")
    zero = near & (d <= ZERO_DISTANCE)
    weight = F.when(near & (d > ZERO_DISTANCE), 1 / d)
    rows = neighbours.groupBy(*keys, "query_id").agg(
        F.avg(F.when(zero, y)).alias("__z"), F.sum(weight * y).alias("__wy"), F.sum(weight).alias("__w"),
        F.min(F.when(y == 0, d)).alias("nearest_negative"), F.min(F.when(y == 1, d)).alias("nearest_positive"),
        F.min_by("reference_id", "rank").alias("nearest_reference"))
    p = F.coalesce("__z", F.col("__wy") / F.col("__w"))
    return rows.select(*keys, "query_id", p.alias("probability"), (p >= 0.5).cast("int").alias("prediction"),
                       "nearest_negative", "nearest_positive", "nearest_reference")


def select_neighbour_settings(scored_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, window, k, macro_f1): best validation score, then smaller window, then smaller k.

    scored_rows: keys, window, k, label, prediction.
    """
    made = metric_columns(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])["macro_f1"]
    scores = confusion(scored_rows, [*keys, "window", "k"]).withColumn("macro_f1", made)
    best = F.struct((-F.col("macro_f1")).alias("s"), F.col("window").alias("window"), F.col("k").alias("k"))
    return scores.groupBy(*keys).agg(F.min(best).alias("b")).select(*keys, "b.window", "b.k", (-F.col("b.s")).alias("macro_f1"))


def presence_baseline(reference: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Positive rate of the query's presence state in the reference, else the base rate."""
    rates = reference.groupBy(*keys, "observed").agg(F.avg("label").alias("__r"))
    base = reference.groupBy(*keys).agg(F.avg("label").alias("__b"))
    joined = queries.join(rates, [*keys, "observed"], "left").join(base, keys)
    p = F.coalesce("__r", "__b")
    return joined.withColumn("probability", p).withColumn("prediction", (p >= 0.5).cast("int")).drop("__r", "__b")


def separability_summary(folds: DataFrame, predictions: DataFrame, total_samples: int) -> DataFrame:
    """Per modality: coverage, macro F1, margins, chosen settings, reasons, rank.

    folds: fold, modality, status, reason, window, k; predictions: modality, label,
    probability, prediction, nearest_negative, nearest_positive.
    """
    made = metric_columns(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])["macro_f1"]
    same = F.when(F.col("label") == 1, F.col("nearest_positive")).otherwise(F.col("nearest_negative"))
    other = F.when(F.col("label") == 1, F.col("nearest_negative")).otherwise(F.col("nearest_positive"))
    score = confusion(predictions, ["modality"]).select("modality", made.alias("macro_f1"))
    means = predictions.groupBy("modality").agg(
        F.count(F.lit(1)).alias("n"), F.avg(same).alias("mean_same_class"), F.avg(other).alias("mean_different_class"),
        F.avg(F.col("nearest_negative") - F.col("nearest_positive")).alias("mean_margin"))
    settings = folds.filter("status = 'complete'").groupBy("modality", "window", "k").agg(F.count(F.lit(1)).alias("c"))
    packed = settings.groupBy("modality").agg(F.array_sort(F.collect_list(F.struct("window", "k", "c"))).alias("settings"))
    state = folds.groupBy("modality").agg(
        F.sum((F.col("status") == "complete").cast("int")).alias("complete_folds"),
        F.array_sort(F.collect_set("reason")).alias("unavailable_reasons"))
    order = Window.orderBy(F.desc("macro_f1"), "modality")  # one row per modality
    return (score.join(means, "modality").join(state, "modality").join(packed, "modality", "left")
            .withColumn("coverage", F.col("n") / F.lit(total_samples)).withColumn("rank", F.row_number().over(order)))


def example_rows(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Most confident row per category: correct positive, correct control, error."""
    hit = F.col("prediction") == F.col("label")
    category = F.when(hit & (F.col("label") == 1), "correct_negation").when(hit, "correct_control").otherwise("high_confidence_error")
    rows = predictions.withColumn("category", category)
    best = F.max_by(F.struct(*predictions.columns), F.struct(F.abs(F.col("probability") - 0.5), -F.col("query_id")))
    return rows.groupBy(*keys, "category").agg(best.alias("r")).select(
        *keys, "category", *[F.col(f"r.{c}").alias(c) for c in predictions.columns if c not in keys])


# -- channel scan -----------------------------------------------------------------------------------


def point_biserial(df: DataFrame, keys: list[str], frame: str = "frame", value: str = "value", label: str = "label") -> DataFrame:
    """Best frame per key by |r| with the label; r is 0 without variance, the first frame wins.

    r comes from centred moments that merge across partitions.
    """
    stats = df.groupBy(*keys, frame).agg(
        F.covar_pop(value, label).alias("__c"), F.stddev_pop(value).alias("__s"), F.stddev_pop(label).alias("__l"),
        F.count(F.lit(1)).alias("__n"))
    spread = F.col("__s") * F.col("__l")
    r = stats.withColumn("r", F.when(spread * F.col("__n") > 1e-12, F.col("__c") / spread).otherwise(F.lit(0.0)))
    return r.groupBy(*keys).agg(F.max_by(F.struct(frame, "r"), F.struct(F.abs("r"), -F.col(frame))).alias("b")).select(*keys, f"b.{frame}", "b.r")


def best_channel_per_modality(scan: DataFrame, modality: str, channel: str) -> DataFrame:
    """The channel with the largest |r| of each modality."""
    pick = F.max_by(F.struct(channel, "frame", "r"), F.struct(F.abs("r"), -F.col("channel_ix")))
    return scan.groupBy(modality).agg(pick.alias("b")).select(modality, f"b.{channel}", "b.frame", "b.r")


def dtw_1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise univariate DTW, squared cost, root at the end; all rows have the same length."""
    n, m = a.shape[1], b.shape[1]
    cost = np.full((len(a), n + 1, m + 1), np.inf)
    cost[:, 0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            low = np.minimum(np.minimum(cost[:, i - 1, j], cost[:, i, j - 1]), cost[:, i - 1, j - 1])
            cost[:, i, j] = low + (a[:, i - 1] - b[:, j - 1]) ** 2
    return np.sqrt(cost[:, n, m])


@F.pandas_udf(DoubleType())
def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Univariate DTW distance of two trace columns, one Arrow batch at a time."""
    if a.empty:
        return pd.Series([], dtype="float64")
    return pd.Series(dtw_1d(np.stack(a.to_numpy()).astype(float), np.stack(b.to_numpy()).astype(float)))


def class_mean_accuracy(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Share of traces nearer by DTW to the mean trace of their own class, per key.

    Class means are over the full set, as a screening measure. Two rows per key are joined.
    """
    flat = traces.select(*keys, "label", F.posexplode("values").alias("f", "x")).groupBy(*keys, "label", "f").agg(F.avg("x").alias("x"))
    means = flat.groupBy(*keys, "label").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("m"))
    both = means.groupBy(*keys).agg(
        F.max(F.when(F.col("label") == 1, F.col("m.x"))).alias("__p"), F.max(F.when(F.col("label") == 0, F.col("m.x"))).alias("__n"))
    rows = traces.join(both, keys).withColumn("dp", dtw_distance("values", "__p")).withColumn("dn", dtw_distance("values", "__n"))
    hit = (F.when(F.col("dp") < F.col("dn"), 1).otherwise(0) == F.col("label")).cast("int")
    return rows.groupBy(*keys).agg(F.avg(hit).alias("dtw_accuracy"))


def scan_channels(traces: DataFrame, channel: str, top: int) -> DataFrame:
    """Point-biserial scan of all channels, then the DTW check on the ``top`` by |r|."""
    long = traces.select(channel, "label", F.posexplode("values").alias("frame", "value"))
    scan = point_biserial(long, [channel])
    best = scan.orderBy(F.desc(F.abs("r")), channel).limit(top).select(channel)
    return scan.join(class_mean_accuracy(traces.join(F.broadcast(best), channel, "left_semi"), [channel]), channel, "left")
