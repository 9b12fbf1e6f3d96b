import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorgrid.operators import matching, windows
from anchorgrid.operators.folds import group_folds, leaking_groups, rotate_splits


def h60(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_window_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    a = pd.DataFrame({"aid": range(30), "player": rng.integers(0, 3, 30), "t0": rng.integers(-500, 500, 30)})
    e = pd.DataFrame({"eid": range(200), "event_player": rng.integers(0, 3, 200), "t": rng.integers(-600, 600, 200)})
    for left, right in ((50, 70), (-20, 90), (100, -40)):
        for source in windows.SOURCES:
            got = windows.attach_windows(spark.createDataFrame(a), spark.createDataFrame(e), left=left, right=right, source=source, bucket_ms=64)
            cross = a.merge(e, how="cross")
            keep = (cross.t >= cross.t0 - left) & (cross.t < cross.t0 + right)
            if source != "both":
                keep &= (cross.player == cross.event_player) == (source == "speaker")
            want = sorted(map(tuple, cross[keep][["aid", "eid"]].to_numpy().tolist()))
            assert sorted((r.aid, r.eid) for r in got.select("aid", "eid").collect()) == want


@pytest.mark.parametrize("segment_rows", [1_000_000, 40])
def test_window_sums_equal_the_pairs(spark, monkeypatch, segment_rows):
    from anchorgrid.operators.ordered import Ordered

    rng = np.random.default_rng(8)
    a = pd.DataFrame({"anchor_id": range(30), "player": rng.integers(0, 3, 30), "t0": rng.integers(-500, 500, 30)})
    e = pd.DataFrame({"eid": range(300), "event_player": rng.integers(0, 3, 300), "t": rng.integers(-60, 60, 300) * 10})
    e.loc[:20, "t"] = a.t0[:21] + 40  # on a border
    sizes = [(50, 70), (-20, 90), (100, -40), (50, 40), (-40, 70)]
    init = Ordered.__init__
    monkeypatch.setattr(Ordered, "__init__", lambda self, d, k, o: init(self, d, k, o, segment_rows))
    cross = a.merge(e, how="cross")
    for source in windows.SOURCES:
        got = windows.window_sums(spark.createDataFrame(a), spark.createDataFrame(e), sizes, {"n": F.lit(1).cast("long"), "s": F.col("eid")}, source=source).toPandas()
        assert len(got) == 30 * len(sizes)
        for left, right in sizes:
            keep = (cross.t >= cross.t0 - left) & (cross.t < cross.t0 + right)
            if source != "both":
                keep &= (cross.player == cross.event_player) == (source == "speaker")
            want = cross[keep].groupby("anchor_id")["eid"].agg(["count", "sum"]).reindex(range(30), fill_value=0)
            part = got[(got.left_ms == left) & (got.right_ms == right)].set_index("anchor_id").sort_index()
            assert part.n.tolist() == want["count"].tolist() and part.s.tolist() == want["sum"].tolist()


def test_scope_controls_equal_the_sequential_choice(spark):
    rng = np.random.default_rng(3)
    edges = pd.DataFrame({"cue_id": rng.integers(0, 25, 90), "word_id": rng.integers(20, 50, 90)}).drop_duplicates()
    cues = pd.DataFrame({"cue_id": range(25)})
    got = matching.scope_controls(spark.createDataFrame(edges), spark.createDataFrame(cues)).toPandas()
    usable = edges[~edges.word_id.isin(cues.cue_id)]
    sizes = usable.groupby("cue_id").size()
    free, want = set(usable.word_id), {}
    for cue in sorted(sizes.index, key=lambda c: (sizes[c], h60(f"42:cue:{c}"))):
        options = [w for w in usable[usable.cue_id == cue].word_id if w in free]
        if options:
            best = min(options, key=lambda w: h60(f"42:control:{w}"))
            free.remove(best)
            want[cue] = best
    assert dict(zip(got.cue_id, got.control_id)) == want


@pytest.mark.parametrize("seed", [4, 5])
def test_strict_controls_invariants(spark, seed):
    rng = np.random.default_rng(seed)
    cues = pd.DataFrame({"cue_id": range(60), "g": rng.integers(0, 4, 60), "chunk": rng.integers(0, 3, 60), "time_ms": rng.integers(0, 30_000, 60)})
    pool = pd.DataFrame({"control_id": range(1000, 1040), "g": rng.integers(0, 4, 40), "chunk": rng.integers(0, 3, 40), "time_ms": rng.integers(0, 30_000, 40)})
    got = matching.strict_controls(spark.createDataFrame(cues), spark.createDataFrame(pool), group=["g"], chunk="chunk").toPandas()
    assert got.cue_id.is_unique and got.control_id.is_unique
    m = got.merge(cues, on="cue_id").merge(pool, on="control_id", suffixes=("", "_c"))
    assert (m.g == m.g_c).all() and ((m.time_ms - m.time_ms_c).abs() == m.distance_ms).all() and (m.distance_ms >= 1000).all()
    assert (m[m.stage == "chunk"].chunk == m[m.stage == "chunk"].chunk_c).all()
    # no free cue is left with a free suitable control
    left, spare = cues[~cues.cue_id.isin(got.cue_id)], pool[~pool.control_id.isin(got.control_id)]
    open_pairs = left.merge(spare, on="g", suffixes=("", "_c"))
    assert ((open_pairs.time_ms - open_pairs.time_ms_c).abs() < 1000).all()
    used_in_chunk = set(got[got.stage == "chunk"].control_id)
    for _, c in cues[~cues.cue_id.isin(got[got.stage == "chunk"].cue_id)].iterrows():
        same = pool[(pool.g == c.g) & (pool.chunk == c.chunk) & ((pool.time_ms - c.time_ms).abs() >= 1000)]
        assert set(same.control_id) <= used_in_chunk
    # a radius match lies in the first ten-second step that holds a control
    assert (m[m.stage == "radius"].distance_ms >= 1000).all()


def test_too_few_coarse_controls_is_an_error(spark):
    words = spark.createDataFrame([(i, i * 10) for i in range(5)], "word_id bigint, time_ms bigint")
    with pytest.raises(matching.MatchError):
        matching.coarse_controls(words, words, words, min_distance_ms=1000)


def test_modes():
    assert matching.resolve_modes(None, None) == ("strict", "strict")
    assert matching.resolve_modes("neg", None) == ("neg", "neg")
    assert matching.resolve_modes("strict", "all") == ("coarse", "strict")
    with pytest.raises(ValueError):
        matching.resolve_modes("other", None)


def test_folds_keep_groups_whole_for_any_partitioning(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "g": rng.integers(0, 23, 300), "y": rng.integers(0, 2, 300)}))
    a = group_folds(df.repartition(1), "g", "y", 5).select("id", "fold").orderBy("id").collect()
    b = group_folds(df.repartition(7), "g", "y", 5).select("id", "fold").orderBy("id").collect()
    assert a == b
    rotated = rotate_splits(group_folds(df, "g", "y", 5), 5)
    assert rotated.count() == 1500 and leaking_groups(rotated, "g").isEmpty()


def test_radius_draws_spread_over_the_first_step(spark):
    """One cue for each of many groups and twenty controls inside ten seconds: any of them may be drawn, farther ones never."""
    cues = spark.createDataFrame([(g, 0, g, 50_000) for g in range(200)], "g long, chunk long, cue_id long, time_ms long")
    pool = spark.createDataFrame(
        [(g, 1, 10_000 + g * 30 + i, 50_000 + (i - 10) * 950 + (475 if i >= 10 else 0)) for g in range(200) for i in range(21)]
        + [(g, 1, 10_000 + g * 30 + 25, 75_000) for g in range(200)], "g long, chunk long, control_id long, time_ms long")
    got = matching.strict_controls(cues, pool, group=["g"], chunk="chunk").toPandas()
    assert len(got) == 200 and set(got.stage) == {"radius"} and got.distance_ms.between(1000, 10_000).all()
    places = (got.control_id - 10_000) % 30
    assert places.nunique() >= 15 and places.value_counts().max() < 40
    assert matching.strict_controls(cues.repartition(7), pool.repartition(3), group=["g"], chunk="chunk").toPandas().sort_values("cue_id").control_id.tolist() == got.sort_values("cue_id").control_id.tolist()


def test_strict_controls_take_a_fixed_number_of_jobs(spark):
    def jobs(n):
        cues = spark.createDataFrame([(0, 0, i, i * 7) for i in range(n)], "g long, chunk long, cue_id long, time_ms long")
        pool = spark.createDataFrame([(0, 0, 10_000 + i, i * 5) for i in range(n)], "g long, chunk long, control_id long, time_ms long")
        context = spark.sparkContext
        context.setJobGroup(f"strict {n}", "strict")
        matched = matching.strict_controls(cues, pool, group=["g"], chunk="chunk").count()
        found = len(context.statusTracker().getJobIdsForGroup(f"strict {n}"))
        context.setJobGroup("", "")
        return found, matched

    few, none = jobs(4)
    many, matched = jobs(400)
    assert none == 0 and matched > 200 and many <= few + 20  # a stage found empty saves its jobs
    assert abs(jobs(800)[0] - many) <= 4


@pytest.mark.parametrize("side", [-1, 1])
def test_brackets_leave_no_free_control_on_their_side(spark, side):
    rng = np.random.default_rng(9)
    cues = pd.DataFrame({"g": rng.integers(0, 3, 80), "cue_id": range(80), "cue_ms": rng.integers(0, 20_000, 80)})
    free = pd.DataFrame({"g": rng.integers(0, 3, 60), "control_id": range(100, 160), "control_ms": rng.integers(0, 20_000, 60)})
    got = matching._bracketed(spark.createDataFrame(cues), spark.createDataFrame(free), ["g"], 700, side).toPandas()
    assert got.cue_id.is_unique and got.control_id.is_unique and len(got) > 30
    m = got.merge(cues, on="cue_id").merge(free, on="control_id", suffixes=("", "_c"))
    assert (m.g == m.g_c).all() and ((m.control_ms - m.cue_ms) * side >= 700).all() and ((m.control_ms - m.cue_ms).abs() == m.distance_ms).all()
    rest = cues[~cues.cue_id.isin(got.cue_id)].merge(free[~free.control_id.isin(got.control_id)], on="g")
    assert ((rest.control_ms - rest.cue_ms) * side < 700).all()
    # as many pairs as taking, for each cue in turn, any control that is still free
    want = 0
    for g in range(3):
        spare = sorted((free[free.g == g].control_ms * -side).tolist())
        for t in sorted(((cues[cues.g == g].cue_ms + side * 700) * -side).tolist()):
            if spare and spare[0] <= t:
                spare.pop(0)
                want += 1
    assert len(got) == want


def test_coarse_controls_give_out_a_short_pool_when_told(spark):
    cues = spark.createDataFrame([(i, i * 1000) for i in range(20)], "word_id long, time_ms long")
    pool = spark.createDataFrame([(100 + i, i * 10_000) for i in range(10)], "word_id long, time_ms long")
    with pytest.raises(matching.MatchError):
        matching.coarse_controls(cues, cues, pool, min_distance_ms=5_000)
    got = matching.coarse_controls(cues, cues, pool, min_distance_ms=5_000, required=False)
    assert sorted(r.word_id for r in got.collect()) == [103 + i for i in range(7)]


def _strict_rows(spark):
    rng = np.random.default_rng(12)
    cues = pd.DataFrame({"cue_id": range(90), "g": rng.integers(0, 3, 90), "chunk": rng.integers(0, 4, 90), "time_ms": rng.integers(0, 40_000, 90)})
    pool = pd.DataFrame({"control_id": range(1000, 1120), "g": rng.integers(0, 3, 120), "chunk": rng.integers(0, 4, 120), "time_ms": rng.integers(0, 40_000, 120)})
    return spark.createDataFrame(cues), spark.createDataFrame(pool)


def _strict(cues, pool):
    return matching.strict_controls(cues, pool, group=["g"], chunk="chunk").toPandas().sort_values("cue_id").reset_index(drop=True)


def test_strict_controls_count_their_keys_once(spark, monkeypatch):
    """No step counts the rows of its keys again, as long as the largest group is no longer than a segment."""
    taken, kind = [], type(spark.range(1))
    first = kind.first
    monkeypatch.setattr(kind, "first", lambda self: taken.append(1) or first(self))
    got = _strict(*_strict_rows(spark))
    assert len(got) > 60 and set(got.stage) == {"chunk", "radius"} and len(taken) == 1


def test_strict_controls_of_a_cut_group_are_the_same(spark, monkeypatch):
    from anchorgrid.operators.ordered import Ordered

    cues, pool = _strict_rows(spark)
    whole = _strict(cues, pool)
    cut, init = [], Ordered.__init__

    def short(self, d, k, o, most=None):
        init(self, d, k, o, 30, most)
        cut.append(self.split)

    monkeypatch.setattr(Ordered, "__init__", short)
    assert _strict(cues, pool).equals(whole) and any(cut)


def test_longest_line_holds_every_time_line(spark):
    cues = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (None, 4)], "g long, cue_id long")
    free = spark.createDataFrame([(0, 5), (1, 6), (1, 7), (2, 8), (None, 9), (None, 10), (None, 11), (None, 12), (None, 13), (None, 14)], "g long, control_id long")
    assert matching._longest_line(cues, free, ["g"]) == 10
    assert matching._longest_line(cues.where("g = 0"), free, ["g"]) == 9
    assert matching._longest_line(cues.limit(0), free.limit(0), ["g"]) == 0
