"""Separability of modalities by warped trajectories: scaling and components per key, settings by validation, nearest references per fold."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from anchorgrid.operators.metrics import confusion, metric_columns
from anchorgrid.operators.similarity import knn_inverse_distance, select_neighbour_settings
from anchorgrid.operators.warping import nearest_by_warping
from anchorgrid.session import cut_lineage

KEYS_HELD = 1000  # of a task's partial products


def vector_trajectories(traces: DataFrame, keys: list[str], channel: str = "channel") -> DataFrame:
    """(keys, values array<array<double>>, time_ix): the frames in which all channels of a key are present, at least two of them.

    traces: keys, channel, values and present per channel; a key has as many rows as its modality has channels.
    """
    packed = traces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(channel, "values", "present"))).alias("__c"))
    frames = F.transform(F.sequence(F.lit(0), F.size(F.col("__c")[0]["values"]) - 1), lambda f: F.struct(
        f.alias("i"), F.transform("__c", lambda c: F.get(c["values"], f)).alias("v"), F.forall("__c", lambda c: F.get(c["present"], f) > 0.5).alias("seen")))
    rows = packed.select(*keys, F.filter(frames, lambda z: z["seen"]).alias("__z")).where(F.size("__z") >= 2)
    return rows.select(*keys, F.col("__z.v").alias("values"), F.col("__z.i").alias("time_ix"))


# -- scaling and components per key -----------------------------------------------------------------


def _partial_products(keys: list[str]):
    """Sums over the rows of a task of the products of centred frames, one row per key and cell of the upper triangle."""
    columns = [*keys, "cell", "product"]

    def rows(sums: dict) -> pd.DataFrame:
        out = []
        for key, total in sums.items():
            a, b = np.triu_indices(len(total))
            frame = pd.DataFrame({"cell": a * len(total) + b, "product": total[a, b]})
            out.append(frame.assign(**dict(zip(keys, key)))[columns])
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=columns)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for key, values, mean in zip(batch[keys].itertuples(index=False, name=None), batch["values"], batch["mean"]):
                centred = np.stack(values) - np.asarray(mean)
                part = centred.T @ centred
                sums[key] = sums[key] + part if key in sums else part
            if len(sums) > KEYS_HELD:
                yield rows(sums)
                sums = {}
        yield rows(sums)

    return task


def _decomposed(keys: list[str], variance: float, most: int):
    columns = [*keys, "n", "mean", "scale", "components", "explained"]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                d = len(row.mean)
                scatter = np.zeros((d, d))
                for cell, product in zip(row.cells, row.products):
                    a, b = divmod(int(cell), d)
                    scatter[a, b] = scatter[b, a] = product
                scale = np.sqrt(np.diag(scatter) / row.n)
                scale = np.where(scale > 0, scale, 1.0)
                values, vectors = np.linalg.eigh(scatter / row.n / np.outer(scale, scale))
                values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
                total = values.sum()
                ratio = values / total if total > 0 else np.zeros(d)
                limit = min(most, int(row.n), d)
                kept = min(limit, max(1, int(np.searchsorted(np.cumsum(ratio[:limit]), variance, side="left")) + 1))
                chosen = vectors[:kept]
                chosen = chosen * np.sign(chosen[np.arange(kept), np.abs(chosen).argmax(axis=1)])[:, None]  # the largest weight is positive
                out.append((*(getattr(row, k) for k in keys), int(row.n), list(row.mean), scale.tolist(), chosen.tolist(), float(ratio[:kept].sum())))
            yield pd.DataFrame(out, columns=columns)

    return task


def fit_components(rows: DataFrame, keys: list[str], *, variance: float = 0.95, max_components: int = 16) -> DataFrame:
    """(keys, n, mean, scale, components, explained) per key from rows of keys and values array<array<double>>.

    All frames of a key are scaled by mean and population deviation (1 where that is 0); components are the directions of most variance of the scaled
    frames, as many as reach the wanted share. Means first, then products centred on them: both are partial sums, so a hot key is as cheap as any, and only the d x d
    sums of a key are decomposed in one place.
    """
    types = dict(rows.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    frames = rows.select(*keys, F.explode("values").alias("__x")).select(*keys, F.posexplode("__x").alias("__p", "__v"))
    means = frames.groupBy(*keys, "__p").agg(F.avg("__v").alias("__m"), F.count(F.lit(1)).alias("__n"))
    means = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__p", "__m"))).alias("__s"), F.max("__n").alias("n")).select(*keys, "n", F.col("__s.__m").alias("mean"))
    centred = rows.select(*keys, "values").join(means, keys).select(*keys, "values", "mean")
    cells = centred.mapInPandas(_partial_products(keys), f"{named}, cell bigint, product double").groupBy(*keys, "cell").agg(F.sum("product").alias("product"))
    packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "product"))).alias("__c"))
    whole = packed.join(means, keys).select(*keys, "n", "mean", F.col("__c.cell").alias("cells"), F.col("__c.product").alias("products"))
    schema = f"{named}, n bigint, mean array<double>, scale array<double>, components array<array<double>>, explained double"
    return whole.mapInPandas(_decomposed(keys, variance, max_components), schema)


def project_components(rows: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with their frames scaled and projected by what was fitted for their key; keys without a fit go."""
    scaled = lambda x: F.zip_with(F.zip_with(x, "mean", lambda a, b: a - b), "scale", lambda a, b: a / b)
    dot = lambda z: F.transform("components", lambda c: F.aggregate(F.zip_with(z, c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    made = rows.join(fitted.select(*keys, "mean", "scale", "components"), keys)
    made = made.withColumn("values", F.transform("values", scaled))
    return made.withColumn("values", F.transform("values", dot)).drop("mean", "scale", "components")


# -- folds ----------------------------------------------------------------------------------------------


def _fold_state(rows: DataFrame, folds: DataFrame, by: list[str]) -> DataFrame:
    """(by, observed rows per split, share of the fold's test samples, reason why a key cannot be judged)."""
    split = lambda name: F.sum((F.col("split") == name).cast("int"))
    state = rows.groupBy(*by).agg(
        F.countDistinct(F.when(F.col("split") == "train", F.col("label"))).alias("__c"), *[split(s).alias(f"{s}_observed") for s in ("train", "validation", "test")])
    tests = folds.groupBy("fold").agg(split("test").alias("__t"))
    reason = (F.when(F.col("__c") < 2, "one_class_in_train")
              .when(F.col("validation_observed") == 0, "no_validation")
              .when(F.col("test_observed") == 0, "no_test"))
    return state.join(tests, "fold").select(
        *by, *[f"{s}_observed" for s in ("train", "validation", "test")], (F.col("test_observed") / F.col("__t")).alias("test_coverage"), reason.alias("reason"))


def fold_separability(
    trajectories: DataFrame, folds: DataFrame, keys: list[str], *, windows: Sequence[float] = (0.0, 0.1, 0.2), ks: Sequence[int] = (1, 3, 5),
    variance: float = 0.95, max_components: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """(fold rows, predictions): warped nearest neighbours with settings chosen on validation and references refitted on train plus validation.

    trajectories: sample_id, label 0 or 1, keys, values array<array<double>>; folds: sample_id, fold, split. Scaling and components are fitted on the training rows
    for the choice of window and k, then on train plus validation for the test rows; equal scores go to the smaller window, then the smaller k. All windows are
    asked in one search and all k in one pass over its result. A key that cannot be judged has one fold row with the reason.
    """
    by = ["fold", *keys]
    rows = cut_lineage(trajectories).join(folds, "sample_id")
    state = cut_lineage(_fold_state(rows, folds, by))
    usable = rows.join(state.where("reason IS NULL").select(*by), by, "left_semi")

    def side(splits: tuple[str, ...], fitted: DataFrame, ident: str) -> DataFrame:
        return project_components(usable.where(F.col("split").isin(*splits)).select(*by, F.col("sample_id").alias(ident), "label", "values"), fitted, by)

    def scored(near: DataFrame, at: list[str]) -> DataFrame:
        return knn_inverse_distance(near, at, F.col("k"))

    first = cut_lineage(fit_components(usable.where("split = 'train'"), by, variance=variance, max_components=max_components))
    asked = side(("validation",), first, "query_id")
    near = nearest_by_warping(
        asked.drop("label").withColumn("window", F.explode(F.array(*[F.lit(float(w)) for w in windows]))), side(("train",), first, "reference_id"), by, max(ks))
    tried = scored(near.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))), [*by, "window", "k"])
    best = cut_lineage(select_neighbour_settings(tried.join(asked.select(*by, "query_id", "label"), [*by, "query_id"]), by))

    final = cut_lineage(fit_components(usable.where("split IN ('train', 'validation')"), by, variance=variance, max_components=max_components))
    asked = side(("test",), final, "query_id")
    # read for its scores and for its nearest rows, so it is searched once
    near = cut_lineage(nearest_by_warping(asked.drop("label").join(best.select(*by, "window"), by), side(("train", "validation"), final, "reference_id"), by, max(ks)))
    found = scored(near.join(best.select(*by, "k"), by), [*by, "window", "k"])
    nearest = near.where("rank = 1").select(*by, "query_id", F.col("reference_label").alias("nearest_reference_label"))
    same = F.when(F.col("label") == 1, F.col("nearest_positive")).otherwise(F.col("nearest_negative"))
    other = F.when(F.col("label") == 1, F.col("nearest_negative")).otherwise(F.col("nearest_positive"))
    predictions = found.join(asked.select(*by, "query_id", "label"), [*by, "query_id"]).join(nearest, [*by, "query_id"]).select(
        *by, F.col("query_id").alias("sample_id"), "label", "probability", "prediction", "nearest_negative", "nearest_positive",
        (F.col("nearest_negative") - F.col("nearest_positive")).alias("margin"), same.alias("nearest_same_class"), other.alias("nearest_different_class"),
        "nearest_reference", "nearest_reference_label", "window", "k")
    predictions = cut_lineage(predictions)

    made = metric_columns(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    scores = confusion(predictions, by).select(*by, *[made[m].alias(m) for m in ("accuracy", "balanced_accuracy", "f1", "macro_f1")])
    means = predictions.groupBy(*by).agg(F.avg("nearest_same_class").alias("mean_same_class"), F.avg("nearest_different_class").alias("mean_different_class"))
    fits = [f.select(*by, F.size("components").alias(f"{n}_components"), F.col("explained").alias(f"{n}_explained")) for f, n in ((first, "selection"), (final, "final"))]
    out = state.join(best.withColumnRenamed("macro_f1", "validation_macro_f1"), by, "left")
    for part in (*fits, means, scores):
        out = out.join(part, by, "left")
    return out.withColumn("status", F.when(F.col("reason").isNull(), "complete").otherwise("unavailable")), predictions
