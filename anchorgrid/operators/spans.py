"""Token spans, BIO frame tags, span scoring and sequence decoding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from anchorgrid.functions.traces import let
from anchorgrid.operators.metrics import confusion, metric_columns, ranking_metrics, ratio
from anchorgrid.operators.ordered import attach_row, exact_quantile, join_on

# fixed values: tag order; cue wins over scope where spans overlap
TAGS = ("O", "B-CUE", "I-CUE", "B-SCOPE", "I-SCOPE")
DEFAULT_DURATION_MS = 300.0
IMPOSSIBLE = -1.0e4


def anchor_duration(duration_s: Column, time_ms: Column, end_ms: Column) -> Column:
    """Measured duration in ms: the recorded one if positive, else end - start if positive."""
    return F.when(duration_s > 0, duration_s * 1000.0).when(end_ms > time_ms, (end_ms - time_ms).cast("double"))


def assumed_duration(words: DataFrame, duration: str, default: float = DEFAULT_DURATION_MS) -> DataFrame:
    """One row ``assumed_ms``: median measured duration of the training anchors, else 300."""
    one = exact_quantile(words.filter(F.col(duration).isNotNull()), [], duration, 0.5, "assumed_ms")
    return one.agg(F.coalesce(F.max("assumed_ms"), F.lit(default)).alias("assumed_ms"))


def token_spans(tokens: DataFrame, assumed_ms: Column) -> DataFrame:
    """(sample_id, span_type, start_ms, end_ms, measured), one per (type, onset).

    tokens: sample_id, anchor_ms, measured_ms, span_type ('CUE', 'SCOPE'), onset_ms. The
    anchor's own token uses the measured duration, every other token the assumed one.
    """
    own = F.col("measured_ms").isNotNull() & (F.abs(F.col("onset_ms") - F.col("anchor_ms")) < 1e-6)
    unique = tokens.select("sample_id", "anchor_ms", "measured_ms", "span_type", "onset_ms").distinct()
    return unique.select(
        "sample_id", "anchor_ms", "span_type", F.col("onset_ms").alias("start_ms"),
        (F.col("onset_ms") + F.when(own, F.col("measured_ms")).otherwise(assumed_ms)).alias("end_ms"), own.alias("measured"))


def frame_tags(spans: DataFrame, samples: DataFrame, *, start_ms: float, step_ms: float, frames: int) -> DataFrame:
    """(sample_id, tags array<int>): BIO tag per grid frame.

    Frame f lies at anchor + start + f * step. A span covers [start, end); its first frame is
    B. Every span writes the few frames it covers, the frame keeps the one that wins: cue over
    scope, then the later span.
    """
    offset = lambda c: (F.col(c) - F.col("anchor_ms") - F.lit(float(start_ms))) / F.lit(float(step_ms))
    first = F.greatest(F.lit(0), F.ceil(offset("start_ms"))).cast("int")
    last = F.least(F.lit(frames - 1), F.ceil(offset("end_ms")) - 1).cast("int")
    placed = spans.withColumn("a", first).withColumn("b", last).filter(F.col("a") <= F.col("b"))
    cells = placed.withColumn("frame", F.explode(F.sequence("a", "b")))
    base = F.when(F.col("span_type") == "CUE", 1).otherwise(3)
    tag = base + F.when(F.col("frame") == F.col("a"), 0).otherwise(1)
    win = F.struct((F.col("span_type") == "CUE").cast("int"), F.col("start_ms"))
    kept = cells.groupBy("sample_id", "frame").agg(F.max_by(tag, win).alias("tag"))
    packed = kept.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("frame", "tag"))).alias("m"))
    joined = samples.select("sample_id").join(packed, "sample_id", "left")
    grid = F.sequence(F.lit(0), F.lit(frames - 1))
    tags = F.transform(grid, lambda f: F.coalesce(F.try_element_at("m", f), F.lit(0)))
    return joined.select("sample_id", tags.alias("tags"))


def label_statistics(tags: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Windows, frames, labelled frames, spans, measured and assumed durations per split."""
    a = tags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.size("tags")).alias("frames"),
        F.sum(F.size(F.filter("tags", lambda x: x > 0))).alias("labeled_frames"))
    b = spans.groupBy(*by).agg(
        F.countDistinct("sample_id").alias("windows_with_spans"), F.count(F.lit(1)).alias("spans"),
        F.sum(F.col("measured").cast("int")).alias("measured"), F.sum((~F.col("measured")).cast("int")).alias("assumed"))
    return a.join(b, by, "left") if by else attach_row(a, b)


def span_array(tags: Column) -> Column:
    """array<struct<span_type, start_frame, stop_frame>> of one tag array, lenient BIO decoding.

    A span opens at B, or at I of another type than the frame before. Stretches begin where that happens or where the type ends, and each ends where the
    next begins; a window has as many tags as its grid has frames, so this needs no shuffle.
    """
    kind = lambda tag: F.when(tag.isin(1, 2), F.lit(1)).when(tag.isin(3, 4), F.lit(2)).otherwise(F.lit(0))

    def stretches(x):
        begins = F.transform(x, lambda tag, i: F.when(tag.isin(1, 3) | (i == 0) | (kind(tag) != kind(F.get(x, i - 1))), i))
        return let(F.filter(begins, lambda i: i.isNotNull()), lambda at: F.transform(at, lambda start, j: F.struct(
            F.element_at(F.array(F.lit(None).cast("string"), F.lit("CUE"), F.lit("SCOPE")), kind(F.get(x, start)) + 1).alias("span_type"),
            start.alias("start_frame"), F.coalesce(F.get(at, j + 1), F.size(x)).alias("stop_frame"))))

    return F.filter(let(tags, stretches), lambda s: s["span_type"].isNotNull())


def decode_spans(tags: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(sample, span_type, start_frame, stop_frame) of tag arrays."""
    return tags.select(sample, F.explode(span_array(F.col("tags"))).alias("s")).select(sample, "s.*")


SPAN = ["span_type", "start_frame", "stop_frame"]


def _scores(counts: DataFrame) -> DataFrame:
    """tp, predicted, reference per type plus micro -> precision, recall, f1."""
    both = counts.withColumn("span_type", F.explode(F.array("span_type", F.lit("micro"))))
    sums = both.groupBy("span_type").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "reference")])
    p, r = ratio(F.col("tp").cast("double"), F.col("predicted")), ratio(F.col("tp").cast("double"), F.col("reference"))
    return sums.select("span_type", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("reference") - F.col("tp")).alias("fn"),
                       p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def _totals(predicted: DataFrame, reference: DataFrame, hits: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    parts = [
        hits.select("span_type", F.lit(1).cast("bigint").alias("tp"), zero.alias("predicted"), zero.alias("reference")),
        predicted.select("span_type", zero.alias("tp"), F.lit(1).cast("bigint").alias("predicted"), zero.alias("reference")),
        reference.select("span_type", zero.alias("tp"), zero.alias("predicted"), F.lit(1).cast("bigint").alias("reference")),
    ]
    return _scores(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def score_exact(predicted: DataFrame, reference: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Spans match when type and both boundaries agree; copies match as often as both have."""
    key = [sample, *SPAN]
    a = predicted.groupBy(*key).agg(F.count(F.lit(1)).alias("predicted"))
    b = reference.groupBy(*key).agg(F.count(F.lit(1)).alias("reference"))
    both = a.join(b, key, "full").na.fill(0, ["predicted", "reference"])
    return _scores(both.select("span_type", "predicted", "reference", F.least("predicted", "reference").alias("tp")))


def _matches(predicted: Column, reference: Column, tau: float) -> Column:
    """Types of the predicted spans that take a reference: each, in order, the free one of its type with the largest IoU >= tau, ties to the first."""
    span = "struct<start_frame:int,stop_frame:int,span_type:string>"
    state = f"struct<free:array<{span}>,hit:array<string>>"

    def step(acc, x):
        def judged(y, i):
            common = F.least(x["stop_frame"], y["stop_frame"]) - F.greatest(x["start_frame"], y["start_frame"])
            union = F.greatest(x["stop_frame"], y["stop_frame"]) - F.least(x["start_frame"], y["start_frame"])
            fits = (x["span_type"] == y["span_type"]) & (common > 0) & (common / F.greatest(union, F.lit(1)) >= tau)
            return F.when(fits, F.struct((common / union).alias("iou"), (-i).alias("at")))

        def take(best):
            rest = F.filter(acc["free"], lambda y, i: i != -best["at"])
            return F.when(best.isNotNull(), F.struct(rest.alias("free"), F.concat(acc["hit"], F.array(x["span_type"])).alias("hit")).cast(state)).otherwise(acc)

        return let(F.array_max(F.transform(acc["free"], judged)), take)

    first = F.struct(reference.alias("free"), F.array().cast("array<string>").alias("hit")).cast(state)
    return F.aggregate(predicted, first, step, lambda acc: acc["hit"])


def score_overlap(predicted: DataFrame, reference: DataFrame, tau: float, sample: str = "sample_id") -> DataFrame:
    """Each predicted span, in order, takes its best free reference of the type with IoU >= tau.

    Above one half disjoint references cannot compete, so a plain join decides. Otherwise the spans of a window (bounded by its frames) meet as two arrays of one row
    and are walked by array expressions.
    """
    if tau > 0.5:
        r = reference.select(sample, "span_type", F.col("start_frame").alias("rs"), F.col("stop_frame").alias("re"))
        met = predicted.join(r, [sample, "span_type"])
        common = F.least("stop_frame", "re") - F.greatest("start_frame", "rs")
        union = F.greatest("stop_frame", "re") - F.least("start_frame", "rs")
        return _totals(predicted, reference, met.filter((common > 0) & (common / union >= tau)))

    sided = lambda df, side: df.select(sample, F.lit(side).alias("side"), F.struct("start_frame", "stop_frame", "span_type").alias("span"))
    packed = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("span"))))
    both = sided(predicted, "p").unionByName(sided(reference, "r")).filter(F.col(sample).isNotNull()).groupBy(sample).agg(packed("p").alias("p"), packed("r").alias("r"))
    return _totals(predicted, reference, both.select(F.explode(_matches(F.col("p"), F.col("r"), tau)).alias("span_type")))


def frame_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Tag accuracy and in-span metrics from aligned tag arrays ``predicted`` and ``reference``."""
    long = df.select(*by, F.explode(F.arrays_zip("predicted", "reference")).alias("z"))
    rows = long.select(*by, (F.col("z.predicted") == F.col("z.reference")).cast("int").alias("same"),
                       (F.col("z.reference") > 0).cast("int").alias("label"), (F.col("z.predicted") > 0).cast("int").alias("prediction"))
    exact = rows.groupBy(*by).agg(F.avg("same").alias("tag_accuracy"))
    made = metric_columns(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    picked = confusion(rows, by).select(*by, *[made[m].alias(m) for m in ("precision", "recall", "f1", "balanced_accuracy", "positive_support")])
    return join_on(picked, exact, by)


def window_metrics(df: DataFrame, by: list[str], frame_probability: str, threshold: float = 0.5) -> DataFrame:
    """The score of a window is its largest frame probability."""
    rows = df.withColumn("probability", F.array_max(frame_probability))
    rows = rows.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))
    made = metric_columns(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    a = confusion(rows, by).select(*by, made["accuracy"].alias("window_accuracy"), made["f1"].alias("window_f1"))
    b = ranking_metrics(rows, by).select(*by, F.col("roc_auc").alias("window_roc_auc"))
    return join_on(a, b, by)


# -- decoding ---------------------------------------------------------------------------------------


def bio_constraints(transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition and start scores with the BIO-illegal ones set to a large negative number."""
    transitions, start = np.array(transitions, dtype=float), np.array(start, dtype=float)
    for target, name in enumerate(TAGS):
        if name.startswith("I-"):
            start[target] = IMPOSSIBLE
            for source, before in enumerate(TAGS):
                if before[2:] != name[2:]:
                    transitions[source, target] = IMPOSSIBLE
    return transitions, start


ROWS = 512  # sequences decoded together: what a task holds does not grow with its batch


def _by_length(emissions: pd.Series, tags: int, most: int = ROWS):
    """(positions, [n, T, tags]) of up to ``most`` sequences of one length; the scores of a sequence lie frame behind frame in one array."""
    lengths = emissions.map(len).to_numpy()
    for length in np.unique(lengths):
        same = np.flatnonzero(lengths == length)
        for at in range(0, len(same), most):
            where = same[at : at + most]
            yield where, np.stack([emissions.iloc[i] for i in where]).astype(float).reshape(len(where), length // tags, tags)


def viterbi(emissions: Column, transitions: np.ndarray, start: np.ndarray, end: np.ndarray) -> Column:
    """Best tag path of an array<array<double>> of emission scores."""
    trans, first = bio_constraints(transitions, start)
    last = np.asarray(end, dtype=float)

    @F.pandas_udf("array<int>")
    def decode(scores: pd.Series) -> pd.Series:
        out = [None] * len(scores)
        for where, e in _by_length(scores, len(first)):
            n, steps, _ = e.shape
            score, back = first + e[:, 0], []
            for t in range(1, steps):
                candidate = score[:, :, None] + trans[None]
                back.append(candidate.argmax(axis=1))
                score = candidate.max(axis=1) + e[:, t]
            path = np.zeros((n, steps), dtype=int)
            path[:, -1] = (score + last).argmax(axis=1)
            for t in range(steps - 1, 0, -1):
                path[:, t - 1] = back[t - 1][np.arange(n), path[:, t]]
            for i, row in zip(where, path):
                out[i] = row.tolist()
        return pd.Series(out)

    return decode(F.flatten(emissions))


def positive_marginal(emissions: Column, transitions: np.ndarray, start: np.ndarray, end: np.ndarray, positive=(1, 2, 3, 4)) -> Column:
    """Per-frame probability of the positive tags by forward and backward log sums."""
    trans, first = bio_constraints(transitions, start)
    last = np.asarray(end, dtype=float)
    keep = list(positive)

    def log_sum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    @F.pandas_udf("array<double>")
    def marginal(scores: pd.Series) -> pd.Series:
        out = [None] * len(scores)
        for where, e in _by_length(scores, len(first)):
            n, steps, tags = e.shape
            alpha, beta = np.empty((n, steps, tags)), np.empty((n, steps, tags))
            alpha[:, 0] = first + e[:, 0]
            for t in range(1, steps):
                alpha[:, t] = log_sum(alpha[:, t - 1, :, None] + trans[None], 1) + e[:, t]
            beta[:, -1] = last
            for t in range(steps - 2, -1, -1):
                beta[:, t] = log_sum(trans[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            joint = alpha + beta
            p = np.exp(joint - log_sum(joint, 2)[:, :, None])[:, :, keep].sum(axis=2)
            for i, row in zip(where, p):
                out[i] = row.tolist()
        return pd.Series(out)

    return marginal(F.flatten(emissions))
