"""Classifier fitting on feature arrays with pyspark.ml, and probability ensembles.

Fits run distributed; the driver holds coefficients and the leaderboard, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from anchorgrid.functions.values import sigmoid
from anchorgrid.operators.folds import repeated_stratified_folds
from anchorgrid.operators.metrics import threshold_metrics
from anchorgrid.operators.ordered import attach_row
from anchorgrid.operators.selection import anova_f

# fixed values: ridge penalties, half decades from 1e-3 to 1e6
ALPHAS = tuple(10.0 ** (-3 + i / 2) for i in range(19))


def vectors(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("__x", array_to_vector(F.col(features)))


def ridge_grid(train: DataFrame, test: DataFrame, features: str, label: str = "label", alphas=ALPHAS) -> tuple[DataFrame, float]:
    """(test rows with score and prediction, chosen alpha) of class-balanced ridge on labels +-1 with an intercept.

    Features are divided by their deviation in ``train``. The alpha is the one with the least leave-one-out squared error of
    the training rows, weighted by class, the smaller one on a tie; ``test`` is only scored. One Gram matrix (features x
    features, the largest thing the driver holds) serves all alphas, a second pass over the rows sums their exact
    leave-one-out errors.
    """
    stats = Summarizer.metrics("variance", "count").summary(array_to_vector(F.col(features)))
    sizes = train.groupBy((F.col(label) == 1).alias("positive")).agg(F.count(F.lit(1)).alias("n")).collect()  # two rows
    spread = train.agg(stats.alias("m")).select("m.count", vector_to_array("m.variance").alias("v")).first()
    n, scale = spread["count"], np.sqrt(np.asarray(spread["v"]) * (spread["count"] - 1) / spread["count"])
    scale[scale == 0] = 1.0
    weight = {r["positive"]: n / (len(sizes) * r["n"]) for r in sizes}
    positive = F.col(label) == 1
    rows = train.select(
        F.col(features).alias("x"), F.when(positive, 1.0).otherwise(-1.0).alias("t"),
        F.when(positive, weight.get(True, 1.0)).otherwise(weight.get(False, 1.0)).alias("w"))
    root = F.sqrt("w")
    wide = F.concat(F.array(root, root * F.col("t")), F.transform("x", lambda v: v.cast("double") * root))
    matrix = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(wide).alias("v")), "v")
    gram = RowMatrix(matrix).computeGramianMatrix().toArray()
    total, middle, mean = gram[0, 0], gram[0, 1] / gram[0, 0], gram[0, 2:] / gram[0, 0] / scale
    centred = gram[2:, 2:] / np.outer(scale, scale) - total * np.outer(mean, mean)
    values, axes = np.linalg.eigh(centred)
    turned = axes.T @ (gram[1, 2:] / scale - total * middle * mean)
    shrunk = np.maximum(values, 0.0)[:, None] + np.asarray(alphas)

    def left_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            z = (np.stack(f["x"].to_numpy()) / scale - mean) @ axes
            w = f["w"].to_numpy()[:, None]
            error = f["t"].to_numpy()[:, None] - middle - z @ (turned[:, None] / shrunk)
            leverage = w * (1 / total + z**2 @ (1 / shrunk))
            yield pd.DataFrame({"place": range(len(alphas)), "loss": (w * (error / (1 - leverage)) ** 2).sum(axis=0)})

    losses = rows.mapInPandas(left_out, "place int, loss double").groupBy("place").agg(F.sum("loss").alias("loss")).collect()  # a row per alpha
    best = min(losses, key=lambda r: (r["loss"], alphas[r["place"]]))["place"]
    coefficients = axes @ (turned / shrunk[:, best]) / scale
    model = train.sparkSession.createDataFrame(
        [(coefficients.tolist(), float(middle - coefficients @ (mean * scale)))], "__c array<double>, __b double")
    dot = F.aggregate(F.zip_with(features, "__c", lambda x, c: x * c), F.lit(0.0), lambda acc, v: acc + v)
    scored = attach_row(test, model).withColumn("score", dot + F.col("__b")).drop("__c", "__b")
    return scored.withColumn("prediction", (F.col("score") >= 0).cast("int")), float(alphas[best])


def classifier(kind: str, c: float = 1.0, rows: int = 1, l1_ratio: float = 0.5, seed: int = 42):
    """Logistic (l2 or elastic net), linear SVM or forest with the inverse penalty ``c``."""
    reg = 1.0 / (c * rows)
    common = {"featuresCol": "__z", "labelCol": "label", "predictionCol": "prediction"}
    if kind == "logistic_l2":
        return LogisticRegression(regParam=reg, elasticNetParam=0.0, maxIter=100, tol=1e-4, standardization=False, **common)
    if kind == "elastic_net":
        return LogisticRegression(regParam=reg, elasticNetParam=l1_ratio, maxIter=100, tol=1e-4, standardization=False, **common)
    if kind == "linear_svm":
        return LinearSVC(regParam=reg, maxIter=100, tol=1e-4, standardization=False, **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, **common)
    raise ValueError(f"unknown classifier {kind!r}")


def fit_predict(train: DataFrame, test: DataFrame, features: str, kind: str, c: float = 1.0) -> DataFrame:
    """Test rows with probability and prediction; scaling is fitted on the training rows."""
    rows = vectors(train, features)
    scaler = StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True).fit(rows)
    fit_rows = scaler.transform(rows).cache()
    model = classifier(kind, c, fit_rows.count()).fit(fit_rows)
    fit_rows.unpersist()
    scored = model.transform(scaler.transform(vectors(test, features)))
    if "probability" in scored.columns:
        scored = scored.withColumn("probability", vector_to_array("probability")[1])
    else:
        scored = scored.withColumn("probability", sigmoid(vector_to_array("rawPrediction")[1]))
    return scored.withColumn("prediction", F.col("prediction").cast("int")).drop("__x", "__z", "rawPrediction")


def top_features(train: DataFrame, features: str, k: int) -> list[int]:
    """Positions of the k best F values on the training rows."""
    return [r["ix"] for r in anova_f(train, features).orderBy(F.desc_nulls_last("f"), "ix").limit(k).collect()]


def grid_search(df: DataFrame, features: str, id_column: str, *, kinds: dict[str, list[float]], ks: list[int], folds: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(leaderboard, diagnostics): scaling and selection are refitted on every inner fold.

    The loop runs over settings and folds only; every step is a distributed fit.
    """
    dealt = repeated_stratified_folds(df, "label", id_column, folds, 1, seed).cache()
    rows, picked = None, []
    for fold in range(folds):
        train, test = dealt.filter(F.col("inner_fold") != fold), dealt.filter(F.col("inner_fold") == fold)
        for k in ks:
            chosen = top_features(train, features, k)
            picked += [(fold, k, ix, place) for place, ix in enumerate(chosen)]
            narrow = F.array(*[F.get(features, F.lit(i)) for i in chosen])
            for kind, cs in kinds.items():
                for c in cs:
                    out = fit_predict(train.withColumn("__s", narrow), test.withColumn("__s", narrow), "__s", kind, c)
                    out = out.select("label", "prediction", F.lit(kind).alias("classifier"), F.lit(c).alias("c"), F.lit(k).alias("k"), F.lit(fold).alias("fold"))
                    rows = out if rows is None else rows.unionByName(out)
    scores = threshold_metrics(rows, ["classifier", "c", "k", "fold"])
    board = scores.groupBy("classifier", "c", "k").agg(F.avg("macro_f1").alias("macro_f1"), F.count(F.lit(1)).alias("folds"))
    diagnostics = df.sparkSession.createDataFrame(picked, "fold int, k int, ix int, place int")
    return board, diagnostics


def best_per_classifier(board: DataFrame) -> DataFrame:
    pick = F.max_by(F.struct("c", "k", "macro_f1"), F.struct(F.col("macro_f1"), -F.col("k"), -F.col("c")))
    return board.groupBy("classifier").agg(pick.alias("b")).select("classifier", "b.c", "b.k", "b.macro_f1")


def out_of_fold(df: DataFrame, features: str, id_column: str, experts: dict[str, tuple[str, list[int]]], folds: int = 3, seed: int = 42) -> DataFrame:
    """(id, label, expert, probability): every row scored by a fit that did not see it."""
    dealt = repeated_stratified_folds(df, "label", id_column, folds, 1, seed).cache()
    out = None
    for name, (kind, positions) in experts.items():
        narrow = dealt.withColumn("__s", F.array(*[F.get(features, F.lit(i)) for i in positions]))
        for fold in range(folds):
            scored = fit_predict(narrow.filter(F.col("inner_fold") != fold), narrow.filter(F.col("inner_fold") == fold), "__s", kind)
            part = scored.select(id_column, "label", F.lit(name).alias("expert"), "probability")
            out = part if out is None else out.unionByName(part)
    return out


def simplex_weights(oof: DataFrame, experts: list[str], id_column: str, *, l2: float = 0.01, steps: int = 60, rate: float = 2.0) -> dict[str, float]:
    """Non-negative weights with sum one that minimise log loss plus l2 distance to uniform.

    Exponentiated gradient: one distributed aggregate per step returns the gradient, a number
    per expert.
    """
    wide = oof.groupBy(id_column, "label").agg(*[
        F.max(F.when(F.col("expert") == e, F.col("probability"))).alias(f"p{i}") for i, e in enumerate(experts)]).cache()
    n = len(experts)
    w = [1.0 / n] * n
    for _ in range(steps):
        mixed = sum((F.col(f"p{i}") * w[i] for i in range(1, n)), F.col("p0") * w[0])
        p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), mixed))
        slope = (p - F.col("label")) / (p * (1 - p))
        g = wide.agg(*[F.avg(slope * F.col(f"p{i}")) for i in range(n)]).first()
        raw = [w[i] * math.exp(-rate * (g[i] + 2 * l2 * (w[i] - 1.0 / n))) for i in range(n)]
        w = [x / sum(raw) for x in raw]
    wide.unpersist()
    return dict(zip(experts, w))


def weighted_ensemble(predictions: DataFrame, keys: list[str], accuracy: str, alpha: float = 4.0) -> DataFrame:
    """Mean component probability with weights train_accuracy ** alpha."""
    w = F.pow(F.col(accuracy), F.lit(alpha))
    p = F.sum(w * F.col("probability")) / F.sum(w)
    return predictions.groupBy(*keys).agg(p.alias("probability"), F.count(F.lit(1)).alias("components")).withColumn(
        "prediction", (F.col("probability") >= 0.5).cast("int"))


def group_average(predictions: DataFrame, keys: list[str], prior: Column) -> DataFrame:
    """Mean over feature groups; a group without usable features counts with the prior."""
    return predictions.groupBy(*keys).agg(F.avg(F.coalesce("probability", prior)).alias("probability"))
