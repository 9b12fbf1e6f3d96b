"""Segmented windows must equal plain ones when a key is hot, for every operator."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorgrid.operators.ordered import Ordered, attach_row, centred_mean, exact_quantile


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 400
    frame = pd.DataFrame({
        "key": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n)).astype("int64"),
        "t": rng.integers(0, 60, n).astype("int64"), "id": np.arange(n, dtype="int64"), "x": rng.integers(0, 50, n).astype("int64")})
    frame["seen"] = np.where(rng.random(n) < 0.2, frame["x"], np.nan)
    return frame, spark.createDataFrame(frame).withColumn("seen", F.when(~F.isnan("seen"), F.col("seen")))


def both(df, keys, build):
    out = []
    for size in (1_000_000, 15):
        line = Ordered(df, keys, ["t", "id"], segment_rows=size)
        assert line.split == (size == 15)
        out.append(build(line).done().orderBy("id").toPandas())
    return out


@pytest.mark.parametrize("keys", [["key"], []])
def test_neighbour(rows, keys):
    frame, df = rows
    plain, cut = both(df, keys, lambda o: o.neighbour(["x", "id"], "p", -1).neighbour(["id"], "n", 1))
    assert plain["p"].tolist() == cut["p"].tolist() and plain["n"].tolist() == cut["n"].tolist()
    ordered = frame.sort_values(["t", "id"])
    want = (ordered.groupby("key") if keys else ordered)["id"].shift(1).sort_index()
    assert [np.nan if r is None else r["id"] for r in cut["p"]] == pytest.approx(want.tolist(), nan_ok=True)


@pytest.mark.parametrize("keys", [["key"], []])
def test_carried_and_running(rows, keys):
    frame, df = rows
    plain, cut = both(df, keys, lambda o: o.carried(F.col("seen"), "a", -1).carried(F.col("seen"), "b", 1).running({"s": F.col("x")}).numbered("rn"))
    for c in ("a", "b", "s", "rn"):
        assert plain[c].tolist() == pytest.approx(cut[c].tolist(), nan_ok=True), c
    ordered = frame.sort_values(["t", "id"])
    grouped = ordered.groupby("key") if keys else ordered
    assert cut["a"].tolist() == pytest.approx(grouped["seen"].ffill().sort_index().tolist(), nan_ok=True)
    assert cut["b"].tolist() == pytest.approx(grouped["seen"].bfill().sort_index().tolist(), nan_ok=True)
    assert cut["s"].tolist() == grouped["x"].cumsum().sort_index().tolist()


def test_quantile_and_centred_mean(rows, monkeypatch):
    import anchorgrid.operators.ordered as module

    frame, df = rows
    want = frame.groupby("key")["x"].quantile(0.3)
    smooth = frame.sort_values(["t", "id"]).groupby("key")["x"].rolling(5, center=True, min_periods=1).mean().droplevel(0).sort_index()
    for size in (1_000_000, 10):
        monkeypatch.setattr(module.Ordered, "segment_rows", size, raising=False)
        init = module.Ordered.__init__
        monkeypatch.setattr(module.Ordered, "__init__", lambda self, d, k, o, segment_rows=size: init(self, d, k, o, segment_rows))
        got = exact_quantile(df, ["key"], "x", 0.3, "q").toPandas().set_index("key")["q"].sort_index()
        assert got.tolist() == pytest.approx(want.tolist())
        mean = centred_mean(df, ["key"], ["t", "id"], "x", 2, "m").orderBy("id").toPandas()["m"]
        assert mean.tolist() == pytest.approx(smooth.tolist())
        monkeypatch.setattr(module.Ordered, "__init__", init)


def test_attach_row_rejects_more_than_one(spark):
    with pytest.raises(Exception):
        attach_row(spark.range(3), spark.range(2).withColumnRenamed("id", "b")).collect()


def test_ties_of_the_first_column_are_cut(spark):
    df = spark.range(2000).select(F.lit("same").alias("zero"), F.col("id"), (F.col("id") % 7).alias("x")).repartition(6)
    line = Ordered(df, [], ["zero", "id"], segment_rows=100)
    sizes = line.df.groupBy("__segment").count().toPandas()["count"]
    assert line.split and len(sizes) >= 20 and sizes.max() < 300
    got = line.numbered("rn").running({"s": F.col("x")}).neighbour(["id"], "p", -1).carried(F.when(F.col("x") == 0, F.col("id")), "c", 1).done().orderBy("id").toPandas()
    assert got["rn"].tolist() == list(range(1, 2001)) and got["s"].tolist() == np.cumsum(np.arange(2000) % 7).tolist()
    assert [None if r is None else r["id"] for r in got["p"]] == [None, *range(1999)]
    assert got["c"].fillna(-1).tolist() == [-(-i // 7) * 7 if -(-i // 7) * 7 < 2000 else -1 for i in range(2000)]


def test_text_order_and_nulls_in_the_order(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 != 0, F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), F.col("id"), (F.col("id") % 2).alias("key"))
    line = Ordered(df, ["key"], ["g", "id"], segment_rows=40)
    assert line.split and line.df.select("key", "__segment").distinct().count() >= 15
    got = line.numbered("rn").done().toPandas().sort_values(["key", "rn"])
    want = df.toPandas().assign(r=lambda x: x.g.fillna("")).sort_values(["key", "r", "id"])
    assert got["id"].tolist() == want["id"].tolist()


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.975, 1.0])
def test_quantile_of_continuous_values(spark, q):
    from anchorgrid.operators.ordered import quantile_bracket

    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"key": rng.integers(0, 3, 60_000), "x": np.where(rng.random(60_000) < 0.3, 0.5, rng.normal(size=60_000))})
    frame.loc[0, "key"] = 9  # a key of one row
    df = spark.createDataFrame(frame).repartition(5)
    want = frame.groupby("key")["x"].quantile(q).sort_index()
    assert exact_quantile(df, ["key"], "x", q, "q").toPandas().set_index("key")["q"].sort_index().tolist() == pytest.approx(want.tolist())
    assert exact_quantile(df, [], "x", q, "q").first()["q"] == pytest.approx(frame["x"].quantile(q))
    ordered = df.join(quantile_bracket(df, ["key"], "x", q), "key").where("x BETWEEN __low AND __high").select("key", "x").distinct().count()
    assert ordered < 0.01 * len(frame)
    assert exact_quantile(df.where("false"), ["key"], "x", q, "q").count() == 0
