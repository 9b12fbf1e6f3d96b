"""Kernels, distances, spans and statistics against brute force on small inputs."""

from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorgrid.operators import fitting as ft, kernels as ke, metrics as mt, resampling as rs, selection as se, similarity as sim, spans as sp, tokens as tk


def test_univariate_dtw():
    a, b = np.array([[0.0, 1, 2]]), np.array([[0.0, 0, 1, 2]])
    assert sim.dtw_1d(a, b)[0] == 0 and sim.dtw_1d(a, b + 1)[0] == pytest.approx(np.sqrt(2.0))  # the first 0-1 and the last 2-3 differ by one


def test_blocks_do_not_change_neighbours(spark):
    rng = np.random.default_rng(1)
    q = pd.DataFrame({"g": rng.integers(0, 2, 20), "query_id": range(20), "values": [rng.normal(size=4).tolist() for _ in range(20)]})
    r = pd.DataFrame({"g": rng.integers(0, 2, 50), "reference_id": range(50), "label": rng.integers(0, 2, 50), "values": [rng.normal(size=4).tolist() for _ in range(50)]})
    dq, dr = spark.createDataFrame(q), spark.createDataFrame(r).withColumn("label", F.col("label").cast("int"))
    runs = [sim.nearest_references(dq, dr, ["g"], 3, metric="euclidean", query_block=b, reference_block=c).orderBy("g", "query_id", "rank").toPandas()
            for b, c in ((100, 100), (4, 7))]
    pd.testing.assert_frame_equal(runs[0][runs[0]["rank"] <= 3].reset_index(drop=True), runs[1][runs[1]["rank"] <= 3].reset_index(drop=True))
    knn = [sim.knn_inverse_distance(spark.createDataFrame(x), ["g"], 3).orderBy("g", "query_id").toPandas() for x in runs]
    pd.testing.assert_frame_equal(knn[0], knn[1])


def test_zero_distance_decides(spark):
    df = spark.createDataFrame([(1, 10, 0, 0.0, 1), (1, 11, 1, 0.0, 2), (1, 12, 1, 0.5, 3)], "query_id bigint, reference_id bigint, reference_label int, distance double, rank int")
    assert sim.knn_inverse_distance(df.withColumn("g", F.lit(0)), ["g"], 3).first().probability == 0.5


def test_viterbi_and_marginals(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=(3, 4, 5)) * 2
    trans, start, end = rng.normal(size=(5, 5)), rng.normal(size=5), rng.normal(size=5)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)] + [(9, e[0][:2].tolist())], "id int, e array<array<double>>")
    got = {r.id: (r.t, r.p) for r in df.select("id", sp.viterbi(F.col("e"), trans, start, end).alias("t"), sp.positive_marginal(F.col("e"), trans, start, end).alias("p")).collect()}
    tr_, st = sp.bio_constraints(trans, start)
    for key, x in [*enumerate(e), (9, e[0][:2])]:
        paths = list(product(range(5), repeat=len(x)))
        score = np.array([st[p[0]] + end[p[-1]] + sum(x[i, t] for i, t in enumerate(p)) + sum(tr_[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert got[key][0] == list(paths[int(score.argmax())])
        w = np.exp(score - score.max())
        want = [sum(wi for wi, p in zip(w, paths) if p[i] > 0) / w.sum() for i in range(len(x))]
        assert got[key][1] == pytest.approx(want)


def test_span_decoding_and_overlap(spark):
    df = spark.createDataFrame([(1, [0, 2, 2, 1, 3, 4, 0, 4]), (2, [0, 0, 0, 0, 0, 0, 0, 0]), (3, [1, 1, 2, 2, 2, 2, 2, 2])], "sample_id int, tags array<int>")
    got = sorted(tuple(r) for r in sp.decode_spans(df).collect())
    assert got == [(1, "CUE", 1, 3), (1, "CUE", 3, 4), (1, "SCOPE", 4, 6), (1, "SCOPE", 7, 8), (3, "CUE", 0, 1), (3, "CUE", 1, 8)]
    spans = lambda rows: spark.createDataFrame(rows, "sample_id int, span_type string, start_frame int, stop_frame int")
    # two predictions on one reference: the first in order claims it, the second is false
    out = {r.span_type: (r.tp, r.fp, r.fn) for r in sp.score_overlap(spans([(1, "CUE", 0, 4), (1, "CUE", 4, 10)]), spans([(1, "CUE", 0, 10)]), 0.3).collect()}
    assert out == {"CUE": (1, 1, 0), "micro": (1, 1, 0)}
    exact = {r.span_type: (r.tp, r.fp, r.fn) for r in sp.score_exact(spans([(1, "CUE", 0, 4), (1, "CUE", 0, 4)]), spans([(1, "CUE", 0, 4)])).collect()}
    assert exact["CUE"] == (1, 1, 0)


def test_overlap_walks_windows_without_python_and_decodes_any_tags(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [None if x == 5 else int(x) for x in rng.integers(0, 6, rng.integers(0, 14))]) for i in range(150)] + [(150, None), (None, [1, 2])]
    tags = spark.createDataFrame(rows, "sample_id int, tags array<int>")

    def runs(x):
        out, before = [], None
        for f, tag in enumerate(x or []):
            kind = {1: "CUE", 2: "CUE", 3: "SCOPE", 4: "SCOPE"}.get(tag)
            if kind and tag in (2, 4) and kind == before:
                out[-1][2] = f + 1
            elif kind:
                out.append([kind, f, f + 1])
            before = kind
        return [tuple(s) for s in out]

    got = sp.decode_spans(tags)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((i, *s)) for i, x in rows for s in runs(x))
    other = sp.decode_spans(tags.withColumn("tags", F.transform("tags", lambda x: F.when(x == 2, 1).when(x == 0, 4).otherwise(x))))
    scores = sp.score_overlap(other, got, 0.3)
    assert "Python" not in scores._jdf.queryExecution().executedPlan().toString()
    want = 0
    left = {i: [r[1:] for r in rs] for i, rs in ((i, [tuple(r) for r in got.collect() if r.sample_id == i]) for i in range(150))}
    for i, kind, a, b in sorted((tuple(r) for r in other.collect() if r.sample_id is not None), key=lambda r: (r[0], r[2], r[3], r[1])):
        fits = [(-(min(b, y[2]) - max(a, y[1])) / (max(b, y[2]) - min(a, y[1])), y) for y in sorted(left[i], key=lambda y: (y[1], y[2])) if y[0] == kind and min(b, y[2]) > max(a, y[1])]
        fits = [(s, n, y) for n, (s, y) in enumerate(fits) if -s >= 0.3]
        if fits:
            want += 1
            left[i].remove(min(fits)[2])
    assert {r.span_type: r.tp for r in scores.collect()}["micro"] == want > 100


def test_fixed_kernel_responses():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 30))
    for dilation in (1, 3):
        stack = ke.tap_stack(x, dilation)
        for pattern in ke.PATTERNS[::20]:
            w = np.full(9, -1.0)
            w[list(pattern)] = 2.0
            padded = np.pad(x, ((0, 0), (4 * dilation, 4 * dilation)))
            want = sum(w[k] * padded[:, k * dilation:k * dilation + 30] for k in range(9))
            assert ke.pattern_response(stack, pattern) == pytest.approx(want)
    r = np.array([[1.0, -1, 2, 3, -1]])
    assert [float(ke.pool(r, 0.0, p)[0]) for p in ke.POOLINGS] == pytest.approx([0.6, 2.0, 2.0, 5 / 3, 0.6])
    assert len(ke.PATTERNS) == 84


def test_feature_extraction_is_independent_of_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(2, 20)).tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, values array<array<double>>")
    params = ke.fit_patterns(ke.sample_windows(df, "values", "id", 5), 168)
    a = df.repartition(1).select("id", ke.features(F.col("values"), ("pattern", params)).alias("f")).orderBy("id").collect()
    b = df.repartition(4).select("id", ke.features(F.col("values"), ("pattern", params), rows=2).alias("f")).orderBy("id").collect()
    assert a == b and len(a[0].f) == len(params["items"])


def test_span_corruption_invariants(spark):
    at = tk.Layout(50, 8)
    rows = [(i, list(range(n))) for i, n in enumerate([2, 3, 8, 16, 31, *[24] * 40])]
    out = tk.denoise_examples(spark.createDataFrame(rows, "id int, tokens array<bigint>"), at, "tokens", "id").collect()
    for r in out:
        n, body = len(r.tokens), r.encoder_input[2:-1]
        kept = [x for x in body if x < at.codes]
        target, groups = r.decoder_target[:-1], []
        for x in target:
            if x >= at.sentinel:
                groups.append([x])
            else:
                groups[-1].append(x)
        hidden = [x for g in groups for x in g[1:]]
        assert sorted(kept + hidden) == r.tokens and 1 <= len(hidden) < n
        assert [g[0] for g in groups] == [x for x in body if x >= at.sentinel] == list(range(at.sentinel, at.sentinel + len(groups)))
        assert all(b[1] > a[-1] + 1 for a, b in zip(groups, groups[1:]))  # disjoint, not adjacent


def test_single_class_and_ties(spark):
    df = spark.createDataFrame([("one", 1, 0.3), ("one", 1, 0.9), ("tie", 1, 0.5), ("tie", 0, 0.5)], "m string, label int, probability double")
    got = {r.m: (r.roc_auc, r.average_precision) for r in mt.ranking_metrics(df, ["m"]).collect()}
    assert got["one"] == (None, None) and got["tie"] == (0.5, 0.5)


def test_one_cluster_and_no_overlap(spark):
    c = spark.createDataFrame([("g", 3, 5)], "g string, a bigint, b bigint").withColumn("zero", F.lit(0))
    out = rs.cluster_bootstrap(c, ["zero", "g"], ["a", "b"], F.col("a") / F.col("b"), 50).first()
    assert (out.point, out.lower, out.upper) == (0.6, 0.6, 0.6)
    p = spark.createDataFrame([(1, 1, 0.5, 1)], "sample_id bigint, label int, probability double, prediction int")
    with pytest.raises(rs.ComparisonError):
        rs.align(p, p.withColumn("sample_id", F.lit(2).cast("bigint")))
    equal = rs.mcnemar(rs.align(p, p)).first()
    assert (equal.statistic, equal.p_value) == (0.0, 1.0)


def test_anova_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 2, 60)
    x[:, 2] = 1.0
    df = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "label int, features array<double>")
    got = {r.ix: r.f for r in se.anova_f(df, "features").collect()}
    for j in (0, 1):
        groups = [x[y == c, j] for c in (0, 1)]
        between = sum(len(g) * (g.mean() - x[:, j].mean()) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 58
        assert got[j] == pytest.approx(between / within)
    assert got[2] is None


def test_ridge_alpha_by_leave_one_out(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5)) + 1.0
    y = (x[:, 0] + rng.normal(size=40) > 1.3).astype(int)
    train = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, f array<double>, label int")
    scored, alpha = ft.ridge_grid(train, train, "f")
    z, t = x / x.std(axis=0), 2.0 * y - 1
    w = np.where(y == 1, 40 / (2 * y.sum()), 40 / (2 * (40 - y.sum())))

    def fit(rows, a):
        design = np.column_stack([np.ones(len(rows)), z[rows]])
        penalty = np.diag([0.0] + [a] * 5)
        return np.linalg.solve(design.T @ (w[rows, None] * design) + penalty, design.T @ (w[rows] * t[rows]))

    everyone = np.arange(40)
    score = lambda c, i: c[0] + z[i] @ c[1:]
    loss = [sum(w[i] * (t[i] - score(fit(everyone[everyone != i], a), i)) ** 2 for i in everyone) for a in ft.ALPHAS]
    assert alpha == ft.ALPHAS[int(np.argmin(loss))]
    best = fit(everyone, alpha)
    got = {r["id"]: r["score"] for r in scored.collect()}
    assert all(abs(got[i] - score(best, i)) < 1e-9 for i in range(40))


def test_redundancy_over_all_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(600, 3))
    x = np.column_stack([base[:, 0], base[:, 0] * 2 + 1, base[:, 1], np.full(600, 7.0), -base[:, 1], base[:, 2]])
    df = spark.createDataFrame([(a.tolist(),) for a in x], "f array<double>").repartition(5)
    ranking = spark.createDataFrame([("m", i, i + 1) for i in range(6)], "family string, ix int, rank int")
    budgets = spark.createDataFrame([("m", 3)], "family string, budget bigint")
    got = se.suppress_redundant(df, "f", ranking, budgets).orderBy("place").collect()
    assert [r["ix"] for r in got] == [0, 2, 5]


def test_products_of_blocks_find_what_single_distances_find():
    rng = np.random.default_rng(2)
    r = rng.normal(size=(400, 5)) + 1000
    r[200:250] = r[:50]  # copies: ties go to the smaller id
    q = np.vstack([r[:30], rng.normal(size=(30, 5)) + 1000])
    ids, labels = rng.permutation(400), (rng.random(400) < 0.02).astype(int)
    q[40, 1], r[7, 2] = np.nan, np.inf
    row, at, d = sim.nearest_in_block(q, r, ids, labels, 3)
    for i in range(60):
        want = sim._kept(sim.exact_distances(q[i], r), ids, labels, 3)
        assert sorted(at[row == i]) == want.tolist()
        assert np.array_equal(np.sort(d[row == i]), np.sort(sim.exact_distances(q[i], r[want])), equal_nan=True)
    row, at, _ = sim.nearest_in_block(q[:1], r[:2], ids[:2], labels[:2], 3)
    assert sorted(at) == [0, 1]


@pytest.mark.parametrize(("n", "k"), [(3, 5), (700, 1), (3000, 5)])
def test_whole_rows_are_searched_without_a_step_for_each(monkeypatch, n, k):
    rng = np.random.default_rng(n)
    r = np.round(rng.normal(size=(n, 4)), 1) * 1e-6 + 1e3  # far from zero, with ties
    q = np.vstack([r[:40], rng.normal(size=(40, 4)) * 1e-6 + 1e3, np.full((1, 4), 1e9)])
    ids, labels = rng.permutation(n), rng.choice([0, 1, 2], n, p=[0.01, 0.5, 0.49])
    want = [sim._kept(sim.exact_distances(x, r), ids, labels, k).tolist() for x in q]
    monkeypatch.setattr(sim, "_kept", None)
    row, at, d = sim.nearest_in_block(q, r, ids, labels, k)
    assert [sorted(at[row == i].tolist()) for i in range(len(q))] == want
    assert np.array_equal(d, sim.exact_distances(q[row], r[at]))


def test_draws_are_never_the_broadcast_side(spark):
    rows = spark.range(50).select(F.col("id").alias("ix"), (F.col("id") % 7).alias("x"))
    plan = rs.row_draws(rows, 10)._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert rs.row_draws(rows, 10).agg(F.sum("n")).first()[0] == 500


def test_marginals_do_not_depend_on_the_rows_taken_together(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(int(rng.integers(1, 5)), 5)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, e array<array<double>>").coalesce(1)
    trans, edge = np.full((5, 5), -0.5) + np.eye(5), np.zeros(5)
    seen = [n for n, _ in ((len(where), e) for where, e in sp._by_length(pd.Series([np.ravel(e) for _, e in rows]), 5, most=3))]
    assert max(seen) <= 3 and sum(seen) == 40
    got = {r.i: r.p for r in df.select("i", sp.positive_marginal(F.col("e"), trans, edge, edge).alias("p")).collect()}
    one = df.repartition(40).select("i", sp.positive_marginal(F.col("e"), trans, edge, edge).alias("p")).collect()
    assert all(got[r.i] == pytest.approx(r.p) and len(r.p) == len(rows[r.i][1]) for r in one)


def test_search_in_small_products(monkeypatch):
    """Products of few queries and few groups, looked into a few groups at a time, find what comparing every pair finds."""
    from anchorgrid.operators import similarity as sim

    monkeypatch.setattr(sim, "HEIGHT", 7)
    monkeypatch.setattr(sim, "TILE", 300)
    monkeypatch.setattr(sim, "GROUP", 8)
    rng = np.random.default_rng(21)
    for q, r in ((rng.normal(size=(40, 5)) + 50, rng.normal(size=(900, 5)) + 50), (rng.integers(0, 3, (40, 3)).astype(float), rng.integers(0, 3, (900, 3)).astype(float))):
        ids, labels = rng.permutation(900), (rng.random(900) < 0.03).astype(int)
        row, at, d = sim.nearest_in_block(q, r, ids, labels, 4)
        for i in range(len(q)):
            all_d = sim.exact_distances(q[i], r)
            order = np.lexsort((ids, all_d))
            want = {*order[:4].tolist(), *(int(order[labels[order] == y][0]) for y in (0, 1))}
            assert set(at[row == i].tolist()) == want and (row == i).sum() == len(want)
            assert d[row == i].tolist() == all_d[at[row == i]].tolist()
