"""Counted draws against exact probabilities and the distribution they stand for."""

import math

import numpy as np
import pytest

from anchorgrid.operators import resampling as rs


@pytest.mark.parametrize("n,p", [(0, 0.3), (1, 0.5), (7, 0.01), (40, 0.9), (300, 0.35), (300, 1.0)])
def test_binomial_quantile_is_the_smallest_count_that_reaches(n, p):
    u = np.concatenate([np.random.default_rng(1).random(300), [1e-12, 1 - 1e-12, 0.5]])
    below = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    want = [next((k for k in range(n + 1) if below[k] >= x * (1 - 1e-13)), n) for x in u]
    assert rs.binomial_quantile(u, np.full(len(u), n), p).tolist() == want


def test_log_factorial():
    x = np.array([0, 1, 5, 31, 32, 33, 170, 10**6, 10**9])
    assert rs.log_factorial(x) == pytest.approx([math.lgamma(v + 1) for v in x], rel=1e-13)


def test_large_counts_have_the_right_moments(monkeypatch):
    rng = np.random.default_rng(2)
    for grid in (1 << 20, 5000):
        monkeypatch.setattr(rs, "GRID", grid)
        n = rng.integers(900_000, 1_000_000, 400)
        z = (rs.binomial_quantile((np.arange(400) + 0.5) / 400, n, 0.2) - n * 0.2) / np.sqrt(n * 0.16)
        assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.02 and (np.diff(z) > -0.02).all()


def test_cell_draws_add_up_and_follow_the_shares(spark):
    sizes = [(0, 0, 600), (0, 1, 250), (1, 0, 3), (1, 1, 1147)]
    cells = spark.createDataFrame(sizes, "label long, prediction long, n long").repartition(3)
    got = rs.cell_draws(cells, ["label", "prediction"], 1500).toPandas()
    assert len(got) == 1500 * 4 and set(got.groupby("rep")["n"].sum()) == {2000}
    for label, prediction, n in sizes:
        part = got[(got.label == label) & (got.prediction == prediction)]["n"]
        deviation = math.sqrt(n * (1 - n / 2000))
        assert abs(part.mean() - n) < 4 * deviation / math.sqrt(1500) and abs(part.std() / deviation - 1) < 0.1
    a = got[(got.label == 0) & (got.prediction == 0)].sort_values("rep")["n"].to_numpy()
    b = got[(got.label == 1) & (got.prediction == 1)].sort_values("rep")["n"].to_numpy()
    assert np.cov(a, b)[0, 1] == pytest.approx(-600 * 1147 / 2000, rel=0.15)
    again = rs.cell_draws(cells.repartition(1), ["label", "prediction"], 1500).toPandas()
    order = ["rep", "label", "prediction"]
    assert again.sort_values(order)["n"].tolist() == got.sort_values(order)["n"].tolist()


def test_one_cell_and_empty_cells(spark):
    one = spark.createDataFrame([(1, 0, 5), (1, 1, 0)], "label long, prediction long, n long")
    got = rs.cell_draws(one, ["label", "prediction"], 3).toPandas()
    assert got[got.prediction == 0]["n"].tolist() == [5, 5, 5] and got[got.prediction == 1]["n"].tolist() == [0, 0, 0]
