"""Warped neighbours, components per key and fold separability against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorgrid.operators import separability as sep, similarity as sim, warping as wp


def brute_warp(a, b, window):
    """Plain dynamic program with the whole path kept."""
    n, m = len(a), len(b)
    inside = wp.band(n, np.array([m]), m, window)[0]
    best = {(0, 0): (0.0, 0)}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if inside[i - 1, j - 1]:
                options = [best[p] for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p in best and (p == (0, 0) or 0 not in p)]
                if options:
                    c, k = min(options, key=lambda o: o[0])
                    best[(i, j)] = (c + float(((a[i - 1] - b[j - 1]) ** 2).sum()), k + 1)
    c, k = best[(n, m)]
    return np.sqrt(c / k)


def walks(rng, count, d=2, classes=4):
    """Trajectories of 6 to 12 frames around one of a few shapes."""
    shapes = rng.normal(size=(classes, 12, d)) * 2
    return [(shapes[rng.integers(classes)] + rng.normal(size=(12, d)) * 0.3)[np.sort(rng.choice(12, rng.integers(6, 13), replace=False))] for _ in range(count)]


@pytest.mark.parametrize("window", [0.0, 0.1, 0.4, 1.0])
def test_warped_pairs(window):
    rng = np.random.default_rng(0)
    rows = walks(rng, 30)
    q, n = wp.padded(rows[:15])
    r, m = wp.padded(rows[15:])
    want = np.array([brute_warp(a, b, window) for a, b in zip(rows[:15], rows[15:])])
    assert wp.warp_pairs(q, r, n, m, window) == pytest.approx(want)
    limit = np.full(15, np.median(want))
    got = wp.warp_pairs(q, r, n, m, window, limit)
    assert got[want <= limit] == pytest.approx(want[want <= limit])
    assert all(np.isinf(got[i]) or got[i] == pytest.approx(want[i]) for i in range(15))
    bounds = wp.envelope_bounds(q, n, r, m, window)
    assert (np.diag(bounds) <= want + 1e-9).all() and (bounds > 0).any()


@pytest.mark.parametrize("window", [0.0, 0.2])
def test_search_skips_pairs_and_loses_none(window):
    rng = np.random.default_rng(3)
    rows = walks(rng, 260, classes=20)
    q, n = wp.padded(rows[:40])
    r, m = wp.padded(rows[40:])
    labels = rng.integers(0, 2, 220)
    whole, _ = wp.search(q, n, r, m, labels, 220, window, np.full((40, 3), np.inf))
    found, reached = wp.search(q, n, r, m, labels, 5, window, np.full((40, 3), np.inf))
    assert np.isfinite(whole).all() and reached < (0.6 if window == 0 else 0.8) * whole.size
    for i in range(40):
        assert np.argsort(found[i], kind="stable")[:5].tolist() == np.argsort(whole[i], kind="stable")[:5].tolist()
        assert all(found[i][labels == y].min() == whole[i][labels == y].min() for y in (0, 1))


@pytest.mark.parametrize("blocks", [(256, 2048), (4, 7)])
def test_blocks_and_windows_do_not_change_warped_neighbours(spark, blocks):
    rng = np.random.default_rng(5)
    rows = walks(rng, 70)
    q = [(i % 2, i, rows[i].tolist()) for i in range(20)]
    r = [(i % 2, i, int(rng.integers(0, 2)), rows[i].tolist()) for i in range(20, 70)] + [(0, 70, 1, rows[20].tolist()), (2, 71, 0, rows[1].tolist())]
    dq = spark.createDataFrame(q, "g int, query_id long, values array<array<double>>").withColumn("window", F.explode(F.array(F.lit(0.0), F.lit(0.3))))
    dr = spark.createDataFrame(r, "g int, reference_id long, label int, values array<array<double>>")
    got = wp.nearest_by_warping(dq, dr, ["g"], 3, query_block=blocks[0], reference_block=blocks[1]).toPandas()
    for (g, i, window), part in got.groupby(["g", "query_id", "window"]):
        ranked = sorted((brute_warp(rows[i], np.array(v), window), j, y) for h, j, y, v in r if h == g)
        near = part[part["rank"] <= 3].sort_values("rank")
        assert near["distance"].tolist() == pytest.approx([d for d, _, _ in ranked[:3]]) and near["reference_id"].tolist() == [j for _, j, _ in ranked[:3]]
        for y in (0, 1):
            assert part[part["reference_label"] == y]["distance"].min() == pytest.approx(min(d for d, _, x in ranked if x == y))
    assert len(got.groupby(["g", "query_id", "window"])) == 40


def fit(rows, variance=0.95, most=16):
    x = np.concatenate(rows)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - mean) / scale
    _, s, v = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    share = s**2 / (s**2).sum()
    kept = min(most, len(share), int(np.searchsorted(np.cumsum(share), variance)) + 1)
    v = v[:kept] * np.sign(v[np.arange(kept), np.abs(v[:kept]).argmax(axis=1)])[:, None]
    return mean, scale, v, share[:kept].sum()


def test_components_per_key(spark):
    rng = np.random.default_rng(7)
    mixed = rng.normal(size=(4, 4))
    rows = [(k, (rng.normal(size=(rng.integers(2, 9), 4)) @ mixed * (k + 1) + 1000 * k).tolist()) for k in (0, 1, 2) for _ in range(30)]
    rows += [(3, [[1.0, 2.0, 3.0, float(i)]]) for i in range(5)] + [(4, [[5.0, 5.0, 5.0, 5.0]])]
    df = spark.createDataFrame(rows, "k int, values array<array<double>>").repartition(7)
    got = {r.k: r for r in sep.fit_components(df, ["k"], variance=0.9).collect()}
    for k in range(4):
        mean, scale, parts, share = fit([np.array(v) for j, v in rows if j == k], 0.9)
        assert got[k].mean == pytest.approx(mean) and got[k].scale == pytest.approx(scale) and got[k].explained == pytest.approx(share)
        assert np.array(got[k].components) == pytest.approx(parts, abs=1e-6)
    assert got[4].scale == [1.0] * 4 and got[4].explained == 0.0 and len(got[4].components) == 1  # nothing varies
    made = sep.project_components(df.where("k = 1"), sep.fit_components(df, ["k"], variance=0.9), ["k"]).first()
    mean, scale, parts, _ = fit([np.array(v) for j, v in rows if j == 1], 0.9)
    inputs = [((np.array(v) - mean) / scale) @ parts.T for j, v in rows if j == 1]
    assert any(np.shape(made["values"]) == x.shape and np.allclose(made["values"], x, atol=1e-6) for x in inputs)


def test_vector_trajectories_need_all_channels(spark):
    rows = [(1, 0, [1.0, 2.0, 3.0], [1, 1, 0]), (1, 1, [4.0, 5.0, 6.0], [1, 1, 1]), (2, 0, [1.0, 2.0, 3.0], [1, 0, 0]), (2, 1, [1.0, 2.0, 3.0], [1, 1, 1])]
    got = sep.vector_trajectories(spark.createDataFrame(rows, "sample_id int, channel int, values array<double>, present array<int>"), ["sample_id"]).collect()
    assert [(r.sample_id, r["values"], r.time_ix) for r in got] == [(1, [[1.0, 4.0], [2.0, 5.0]], [0, 1])]


def test_fold_separability_against_the_whole_computation(spark):
    rng = np.random.default_rng(11)
    rows = walks(rng, 60, d=3, classes=2)
    labels = [int(x.mean() + rng.normal() * 0.4 > 0) for x in rows]
    split = {f: ["train" if (i + f) % 5 > 1 else "validation" if (i + f) % 5 else "test" for i in range(60)] for f in (0, 1)}
    data = spark.createDataFrame([(i, labels[i], m, (rows[i] if m == "all" else rows[i][:, :1]).tolist()) for i in range(60) for m in ("all", "one")]
                                 + [(i, 1, "single", rows[i].tolist()) for i in range(60)], "sample_id long, label int, modality string, values array<array<double>>")
    folds = spark.createDataFrame([(i, f, split[f][i]) for f in split for i in range(60)], "sample_id long, fold int, split string")
    windows, ks = (0.0, 0.1, 0.2), (1, 3, 5)
    state, predictions = sep.fold_separability(data, folds, ["modality"], windows=windows, ks=ks)
    state = {(r.fold, r.modality): r for r in state.collect()}
    predicted = {(r.fold, r.modality, r.sample_id): r for r in predictions.collect()}
    assert {state[(f, "single")].reason for f in split} == {"one_class_in_train"} and len(state) == 6

    def knn(distances, ys, k):
        order = np.argsort(distances, kind="stable")[:k]
        zero = distances[order] <= 1e-12
        return np.mean(ys[order[zero]]) if zero.any() else np.average(ys[order], weights=1 / distances[order])

    def macro(truth, guess):
        out = []
        for y in (0, 1):
            tp, wrong = sum(t == g == y for t, g in zip(truth, guess)), sum((t == y) != (g == y) for t, g in zip(truth, guess))
            out.append(2 * tp / (2 * tp + wrong) if 2 * tp + wrong else 0.0)
        return np.mean(out)

    for f in split:
        for m in ("all", "one"):
            x = [r if m == "all" else r[:, :1] for r in rows]
            ids = {s: [i for i in range(60) if split[f][i] == s] for s in ("train", "validation", "test")}

            def projected(on):
                mean, scale, parts, share = fit([x[i] for i in on])
                return [((r - mean) / scale) @ parts.T for r in x], len(parts), share

            z, count, share = projected(ids["train"])
            ys = np.array([labels[i] for i in ids["train"]])
            best = None
            for w in windows:
                d = [np.array([brute_warp(z[i], z[j], w) for j in ids["train"]]) for i in ids["validation"]]
                for k in ks:
                    score = macro([labels[i] for i in ids["validation"]], [int(knn(row, ys, k) >= 0.5) for row in d])
                    if best is None or (-round(score, 12), w, k) < best:
                        best = (-round(score, 12), w, k)
            got = state[(f, m)]
            assert (got.window, got.k, got.selection_components) == (best[1], best[2], count) and got.validation_macro_f1 == pytest.approx(-best[0])
            assert got.selection_explained == pytest.approx(share) and (got.train_observed, got.test_observed, got.test_coverage) == (36, 12, 1.0)
            among = ids["train"] + ids["validation"]
            z, count, _ = projected(among)
            assert got.final_components == count
            ys = np.array([labels[i] for i in sorted(among)])
            for i in ids["test"]:
                d = np.array([brute_warp(z[i], z[j], best[1]) for j in sorted(among)])
                r = predicted[(f, m, i)]
                assert r.probability == pytest.approx(knn(d, ys, best[2])) and r.nearest_reference == sorted(among)[int(d.argmin())]
                assert (r.nearest_negative, r.nearest_positive) == pytest.approx((d[ys == 0].min(), d[ys == 1].min()))
            assert got.macro_f1 == pytest.approx(macro([labels[i] for i in ids["test"]], [predicted[(f, m, i)].prediction for i in ids["test"]]))


def test_search_by_old_name_takes_plain_traces(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [0.0, 1.0])], "query_id long, values array<double>").withColumn("g", F.lit(0))
    refs = spark.createDataFrame([(10, 0, [0.0, 1.0, 2.0]), (11, 1, [5.0, 5.0])], "reference_id long, label int, values array<double>").withColumn("g", F.lit(0))
    got = sim.nearest_references(rows, refs, ["g"], 1, window=1.0).where("rank = 1").toPandas()
    assert isinstance(got, pd.DataFrame) and got.set_index("query_id")["distance"].to_dict() == pytest.approx({1: 0.0, 2: np.sqrt(1 / 3)})


@pytest.mark.parametrize("window", [0.0, 0.2])
@pytest.mark.parametrize("d", [1, 3])
def test_whole_costs_leave_few_pairs_of_noise(window, d):
    rng = np.random.default_rng(13)
    rows = [rng.normal(size=(rng.integers(9, 15), d)) * 1e-3 + 50 for _ in range(620)]
    q, n = wp.padded(rows[:20])
    r, m = wp.padded(rows[20:])
    whole = np.stack([wp.warp_pairs(q[[i] * 600], r, n[[i] * 600], m, window) for i in range(20)])
    assert (wp.cost_bounds(q, n, r, m, window) <= whole).all()
    labels = rng.integers(0, 2, 600)
    found, reached = wp.search(q, n, r, m, labels, 3, window, np.full((20, 3), np.inf))
    assert reached < 0.5 * whole.size
    for i in range(20):
        assert np.argsort(found[i], kind="stable")[:3].tolist() == np.argsort(whole[i], kind="stable")[:3].tolist()
        assert all(found[i][labels == y].min() == whole[i][labels == y].min() for y in (0, 1))


def test_long_pairs_and_pairs_along_the_band_agree():
    rng = np.random.default_rng(17)
    q, r = rng.normal(size=(30, 12, 2)), rng.normal(size=(30, 10, 2))
    n, m = np.full(30, 12), np.full(30, 10)
    for window in (0.0, 0.3, 1.0):
        assert wp._along_band(q, r, n, m, window, None).tolist() == wp._along_diagonals(q, r, n, m, window, None).tolist()
    q[3, 2], labels = np.nan, np.arange(30) % 2
    found, _ = wp.search(q, n, r, m, labels, 2, 0.3, np.full((30, 3), np.inf))
    assert np.isinf(found[3]).all() and (np.isfinite(np.delete(found, 3, axis=0)).sum(axis=1) >= 2).all()


@pytest.mark.parametrize("window", [0.0, 0.2, 1.0])
@pytest.mark.parametrize("d", [1, 3])
def test_limits_leave_out_no_near_pair_and_few_others(window, d):
    rng = np.random.default_rng(19)
    rows = [rng.normal(size=(rng.integers(4, 15), d)) * 1e-3 + 50 for _ in range(620)]
    rows[30] = rows[0]  # of distance zero
    q, n = wp.padded(rows[:20])
    r, m = wp.padded(rows[20:])
    whole = np.stack([wp.warp_pairs(q[[i] * 600], r, n[[i] * 600], m, window) for i in range(20)])
    kind = rng.integers(0, 3, 600)
    limit = np.stack([np.sort(np.where(kind == z, whole, np.inf), axis=1)[:, 3 * z] for z in range(3)], axis=1)  # itself a distance, which is to be found
    i, j = wp.near_places(q, n, r, m, kind, window, limit)
    within = whole <= limit[:, kind]
    found = np.zeros(whole.shape, int)
    np.add.at(found, (i, j), 1)
    assert found.max() == 1 and found[within].all() and found.sum() < 0.12 * whole.size
    i, j = wp.near_places(q, n, r, m, kind, window, np.full((20, 3), 1e9))
    assert len(i) == whole.size


def test_windows_searched_together_find_what_each_finds_alone(spark):
    rng = np.random.default_rng(23)
    rows = [rng.normal(size=(rng.integers(4, 12), 2)) for _ in range(1500)]
    rows[700][1, 1] = np.nan  # with these the windows are searched one by one
    q = [(g, i % 90, rows[i].tolist()) for g in (0, 1) for i in range(100)]  # some ids come twice
    r = [(g, i, i % 2, rows[i].tolist()) for g in (0, 1) for i in range(100, 1500) if g or i != 700]
    windows = (0.0, 0.1, 0.3)
    dq = spark.createDataFrame(q, "g int, query_id long, values array<array<double>>")
    dr = spark.createDataFrame(r, "g int, reference_id long, label int, values array<array<double>>")
    asked = dq.where("query_id >= 10").withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows])))
    names = ["g", "query_id", "window", "rank"]
    got = wp.nearest_by_warping(asked, dr, ["g"], 4, query_block=64, reference_block=600).where("rank <= 4").toPandas().sort_values(names)
    alone = [wp.nearest_by_warping(asked.where(F.col("window") == w), dr, ["g"], 4).where("rank <= 4").toPandas() for w in windows]
    alone = pd.concat(alone).sort_values(names)
    assert len(got) == 2 * 80 * 3 * 4 and got[[*names, "reference_id", "distance"]].to_numpy().tolist() == alone[[*names, "reference_id", "distance"]].to_numpy().tolist()


def test_folds_are_searched_once_for_validation_and_once_for_test(spark, monkeypatch):
    runs, search = spark.sparkContext.accumulator(0), wp.nearest_by_warping

    def counted(queries, *args):
        def seen(batches):
            for batch in batches:
                runs.add(len(batch))
                yield batch
        return search(queries, *args).mapInPandas(seen, "fold int, modality string, query_id long, window double, reference_id long, reference_label int, distance double, rank int")

    monkeypatch.setattr(sep, "nearest_by_warping", counted)
    rng = np.random.default_rng(29)
    data = spark.createDataFrame([(i, i % 2, "m", (rng.normal(size=(6, 1)) + i % 2).tolist()) for i in range(40)], "sample_id long, label int, modality string, values array<array<double>>")
    folds = spark.createDataFrame([(i, 0, ["test", "validation", "train", "train", "train"][i // 2 % 5]) for i in range(40)], "sample_id long, fold int, split string")
    _, predictions = sep.fold_separability(data, folds, ["modality"], windows=(0.0,), ks=(1,))
    assert predictions.count() == 8
    assert runs.value == 2 * 8 * 2  # of eight queries a time, the nearest of each label
