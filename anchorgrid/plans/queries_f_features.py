"""Kernel, dictionary and interval features, selection and fitting on the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from anchorgrid.functions import traces as tr
from anchorgrid.functions.hashing import draw
from anchorgrid.operators import dictionary as dic, fitting as fit, folds as fo, kernels as ke, selection as se
from anchorgrid.operators.metrics import threshold_metrics
from anchorgrid.plans.queries_c_series import traces16
from anchorgrid.plans.queries_d_metrics import SQL, cells_sql
from anchorgrid.plans.registry import query
from anchorgrid.plans.roles import EV, GRID, PREDS, SERIES, h32, h60, q6, r6


def windows(t):
    """One row per vector: 4 channels x 16 frames."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.transform(F.slice("embedding", c * 16 + 1, F.lit(16)), lambda x: x.cast("double")))
    return t.read("embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"), cut.alias("values"))


def training_sample(t, rows=64):
    return ke.sample_windows(windows(t), "values", "sample_id", rows)


def featured(t, *blocks):
    return windows(t).select("sample_id", "label", ke.features(F.col("values"), *blocks).alias("features"))


def summary(df):
    """Size, mean and largest value of every feature array."""
    return df.select("sample_id", "label", F.size("features").alias("size"), F.array_max("features").alias("largest"),
                     (F.aggregate("features", F.lit(0.0), lambda s, x: s + x) / F.size("features")).alias("mean"))


@query("C1_fixed_kernels_ppv")
def _(t):
    one = windows(t).withColumn("values", F.slice("values", 1, 1))
    params = ke.fit_patterns(ke.sample_windows(one, "values", "sample_id", 64), 168)
    return summary(one.select("sample_id", "label", ke.features(F.col("values"), ("pattern", params)).alias("features")))


@query("C2_multichannel_kernels")
def _(t):
    return summary(featured(t, ("pattern", ke.fit_patterns(training_sample(t), 168))))


@query("C3_four_poolings")
def _(t):
    params = ke.fit_patterns(training_sample(t), 168, poolings=ke.POOLINGS[:4], views=("raw", "diff"))
    return summary(featured(t, ("pattern", params)))


@query("C4_zero_crossing_rate", f"""SELECT sample_id, channel, {q6('sum(((value > 0.05 AND nx < 0.05) OR (value < 0.05 AND nx > 0.05))::INTEGER) / 16.0::DOUBLE')} AS rate
  FROM (SELECT *, lead(value) OVER (PARTITION BY sample_id, channel ORDER BY frame) AS nx FROM ({GRID})) GROUP BY 1, 2""")
def _(t):
    return traces16(t).select("sample_id", "channel", r6(ke.zero_crossing_rate(F.col("values"), 0.05)).alias("rate"))


@query("C5_competing_kernels")
def _(t):
    return summary(featured(t, ("competing", ke.fit_competing(4, 16, 8, 8, 42))))


@query("C9_competing_shapelets")
def _(t):
    x = training_sample(t)
    return summary(featured(t, ("shapelet", ke.fit_shapelets(x, 6, 4, 5, 42)), ("shapelet", ke.fit_shapelets(x, 6, 4, 5, 43, "diff"))))


@query("C10_shapelet_prototypes")
def _(t):
    return summary(featured(t, ("shapelet", ke.fit_shapelets(training_sample(t), 24, 1, 5, 7))))


@query("C17_random_kernel_groups")
def _(t):
    return summary(featured(t, *[("random", ke.fit_random(4, 16, 50, seed)) for seed in (1, 2, 3)]))


@query("C18_shared_budget_matrix")
def _(t):
    x = training_sample(t)
    return summary(featured(t, ("pattern", ke.fit_patterns(x, 168, poolings=ke.POOLINGS[:4])), ("competing", ke.fit_competing(4, 16, 8, 8, 42))))


# counts per order line: scaled to non-negative numbers with many zeros
_COUNTS = "SELECT l_orderkey, l_linenumber, l_returnflag, unnest(range(0, 4)) AS ix, unnest([l_quantity, l_discount * 100, l_tax * 100, l_extendedprice]) AS x FROM lineitem"


def counted(t):
    li = t.read("lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100, "l_extendedprice").alias("features"))


def _by_flag(df):
    long = df.select("l_returnflag", F.posexplode("scaled").alias("ix", "x"))
    return long.groupBy("l_returnflag", F.col("ix").cast("bigint").alias("ix")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x"), 5).alias("mean"), r6(F.max("x"), 5).alias("largest"))


@query("C6_sparse_scaler", f"""SELECT l_returnflag, ix, count(*) AS n, {q6('avg(CASE WHEN x > 0 THEN (sqrt(x) - m) / s ELSE 0.0 END)', 5)} AS mean, {q6('max(CASE WHEN x > 0 THEN (sqrt(x) - m) / s ELSE 0.0 END)', 5)} AS largest FROM ({_COUNTS})
  JOIN (SELECT ix, avg(sqrt(x)) AS m, stddev_samp(sqrt(x)) + pow(avg((x = 0)::INTEGER), 4) + 1e-8 AS s FROM ({_COUNTS}) GROUP BY ix) USING (ix) GROUP BY 1, 2""")
def _(t):
    rows = counted(t)
    return _by_flag(se.apply_sparse_scaler(rows, "features", se.fit_sparse_scaler(rows, "features"), mask=True, name="scaled"))


@query("C7_global_zero_scaler", f"""SELECT l_returnflag, ix, count(*) AS n, {q6('avg((sqrt(x) - m) / s)', 5)} AS mean, {q6('max((sqrt(x) - m) / s)', 5)} AS largest FROM ({_COUNTS})
  JOIN (SELECT ix, avg(sqrt(x)) AS m, stddev_pop(sqrt(x)) + pow((SELECT avg((x = 0)::INTEGER) FROM ({_COUNTS})), 4) + 1e-8 AS s FROM ({_COUNTS}) GROUP BY ix) USING (ix) GROUP BY 1, 2""")
def _(t):
    rows = counted(t)
    return _by_flag(se.apply_sparse_scaler(rows, "features", se.fit_sparse_scaler(rows, "features", per_column=False), mask=False, name="scaled"))


@query("C8_scale_without_centering", f"""SELECT l_returnflag, ix, count(*) AS n, {q6('avg(x / s)', 5)} AS mean, {q6('max(x / s)', 5)} AS largest FROM ({_COUNTS}) JOIN (SELECT ix, stddev_pop(x) AS s FROM ({_COUNTS}) GROUP BY ix) USING (ix) GROUP BY 1, 2""")
def _(t):
    return _by_flag(se.scale_without_centering(counted(t), "features", "scaled"))


# -- symbolic words ----------------------------------------------------------------------------------

CONFIG = {"window": 6, "dilation": 2, "word_length": 3, "binning": "depth"}
_W = f"""SELECT s.sample_id, s.channel, s.frame AS position, sum(v.value * cos(2 * pi() * i / 6)) AS c0, sum(v.value * sin(2 * pi() * i / 6)) AS c1, sum(v.value * cos(4 * pi() * i / 6)) AS c2
  FROM ({GRID}) s, (SELECT unnest(range(0, 6)) AS i) JOIN ({GRID}) v ON v.sample_id = s.sample_id AND v.channel = s.channel AND v.frame = s.frame + 2 * i WHERE s.frame <= 5 GROUP BY 1, 2, 3"""
_WORDS = f"""SELECT sample_id, channel, position, (c0 > t0)::INTEGER + 2 * (c1 > t1)::INTEGER + 4 * (c2 > t2)::INTEGER AS word FROM ({_W}), (SELECT median(c0) AS t0, median(c1) AS t1, median(c2) AS t2 FROM ({_W}))"""


def symbols(t, by=("sample_id", "channel")):
    co = dic.window_coefficients(traces16(t), CONFIG, list(by))
    return dic.words(co, dic.cut_points(co, 3, "depth"), 3, list(by))


@query("C11_symbolic_words", f"SELECT sample_id, channel, word::BIGINT AS word, count(*) AS n FROM ({_WORDS}) GROUP BY 1, 2, 3")
def _(t):
    return dic.word_counts(symbols(t), ["sample_id", "channel"])


@query("C11_equal_width_words", f"""SELECT sample_id, channel, position, ((c0 > t0)::INTEGER + 2 * (c1 > t1)::INTEGER + 4 * (c2 > t2)::INTEGER)::BIGINT AS word FROM ({_W}),
  (SELECT (min(c0) + max(c0)) / 2 AS t0, (min(c1) + max(c1)) / 2 AS t1, (min(c2) + max(c2)) / 2 AS t2 FROM ({_W}))""")
def _(t):
    co = dic.window_coefficients(traces16(t), CONFIG, ["sample_id", "channel"])
    out = dic.words(co, dic.cut_points(co, 3, "width"), 3, ["sample_id", "channel"])
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("C12_configuration_schedule", f"""SELECT config, channel::INTEGER AS channel, win::INTEGER AS "window", pow(2, {h32("'42:dilation:' || config")} % (floor(log2(15.0 / (win - 1)))::BIGINT + 1))::INTEGER AS dilation, least(win - 2, 7 + {h32("'42:word:' || config")} % 2)::INTEGER AS word_length,
  CASE WHEN {h32("'42:bins:' || config")} % 2 = 0 THEN 'depth' ELSE 'width' END AS binning, n FROM (SELECT c AS config, 4 + {h32("'42:window:' || c")} % 13 AS win, c // 4 AS cyc, c % 4 AS slot FROM (SELECT unnest(range(0, 100)) AS c))
  JOIN (SELECT cyc, ch AS channel, row_number() OVER (PARTITION BY cyc ORDER BY {h60("'42:channel:' || cyc || ':' || ch")}) - 1 AS slot FROM (SELECT unnest(range(0, 25)) AS cyc), (SELECT unnest(range(0, 4)) AS ch)) USING (cyc, slot)
  JOIN (SELECT channel, count(*) AS n FROM ({GRID}) GROUP BY 1) USING (channel)""")
def _(t):
    config = dic.configurations(t.spark, 4, 16, 100, 44)
    n = t.grid.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    return config.join(n, config["channel"] == n["channel"]).drop(n["channel"])


_CHI = f"""SELECT channel, word, sum(pow(coalesce(o, 0) - t * share, 2) / (t * share)) AS chi2 FROM (SELECT channel, word, count(*) AS t FROM ({_WORDS}) GROUP BY 1, 2) w,
  (SELECT label, count(*) / (SELECT count(*) FROM embeddings)::DOUBLE AS share FROM (SELECT (label >= 5)::INTEGER AS label FROM embeddings) GROUP BY 1) s
  LEFT JOIN (SELECT channel AS oc, word AS ow, label AS ol, count(*) AS o FROM ({_WORDS}) JOIN (SELECT vec_id AS sample_id, (label >= 5)::INTEGER AS label FROM embeddings) USING (sample_id) GROUP BY 1, 2, 3) o ON oc = channel AND ow = word AND ol = label GROUP BY 1, 2"""


def _labels(t):
    return t.read("embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"))


@query("C13_chi2_top_words", f"SELECT channel, word::BIGINT AS word, {q6('chi2')} AS chi2, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY chi2 DESC, word) AS rank FROM ({_CHI})) WHERE rank <= 4")
def _(t):
    counts = dic.word_counts(symbols(t), ["sample_id", "channel"]).join(_labels(t), "sample_id")
    sizes = _labels(t).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    return dic.chi2_top_k(counts, sizes, ["channel"], 4).withColumn("chi2", r6(F.col("chi2")))


@query("C14_word_grams", f"""SELECT channel, gram AS word, count(*) AS n FROM (SELECT channel, word || '-' || lead(word) OVER (PARTITION BY sample_id, channel ORDER BY position) AS gram FROM ({_WORDS})) WHERE gram IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return dic.word_counts(dic.word_grams(symbols(t), ["sample_id", "channel"], 2), ["channel"])


_IV = ", ".join(f"('{v}', {i}, {a}, {b})" for v, n in (("raw", 16), ("diff", 15), ("periodogram", 8)) for i, a, b in dic.interval_table(5, n))
_VIEWS = f"""SELECT 'raw' AS view, sample_id, channel, frame, value FROM ({GRID}) UNION ALL SELECT 'diff', sample_id, channel, frame, lead(value) OVER (PARTITION BY sample_id, channel ORDER BY frame) - value FROM ({GRID})
  UNION ALL SELECT 'periodogram', sample_id, channel, f, sqrt(pow(sum(value * cos(2 * pi() * f * frame / 16)), 2) + pow(sum(value * sin(2 * pi() * f * frame / 16)), 2)) FROM ({GRID}), (SELECT unnest(range(0, 8)) AS f) GROUP BY sample_id, channel, f"""


@query("C15_interval_features", f"""SELECT sample_id, channel, view, interval, {q6('avg(value)', 5)} AS mean, {q6('stddev_pop(value)', 5)} AS std, {q6('regr_slope(value, frame)', 5)} AS slope, {q6('median(value)', 5)} AS median,
  {q6('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 5)} AS iqr, {q6('min(value)', 5)} AS min, {q6('max(value)', 5)} AS max FROM ({_VIEWS}) JOIN (VALUES {_IV}) iv(iview, interval, a, b) ON iview = view AND frame >= a AND frame < b GROUP BY 1, 2, 3, 4""")
def _(t):
    out = dic.interval_features(traces16(t), ["sample_id", "channel"], 16, 5)
    return out.select("sample_id", "channel", "view", "interval", *[r6(F.col(c), 5).alias(c) for c in dic.STATISTICS])


# -- selection ------------------------------------------------------------------------------------------

_LI = """SELECT (l_returnflag = 'R')::INTEGER AS label, unnest(range(0, 7)) AS ix, unnest([l_quantity, l_extendedprice, l_discount, l_tax, p_size::DOUBLE, p_retailprice, 1.0::DOUBLE]) AS x FROM lineitem JOIN part ON p_partkey = l_partkey"""


def _f_sql(source, by=""):
    """F value per (by, ix) of long rows label, ix, x."""
    keys = f"{by}, ix" if by else "ix"
    return f"""SELECT {keys}, CASE WHEN sum(w) > 1e-9 THEN (sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) END AS f FROM (
      SELECT *, sum(n * m) OVER (PARTITION BY {keys}) / sum(n) OVER (PARTITION BY {keys}) AS gm FROM (SELECT {keys}, label, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS w FROM ({source}) GROUP BY {keys}, label)) GROUP BY {keys}"""


def line_features(t):
    part = t.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    li = t.read("lineitem").join(part, "l_partkey")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.array(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("p_size").cast("double"), "p_retailprice", F.lit(1.0)).alias("features"))


@query("L1_anova_f", f"SELECT ix::INTEGER AS ix, {q6('coalesce(f, 0.0)', 5)} AS f FROM ({_f_sql(_LI)})")
def _(t):
    return se.anova_f(line_features(t), "features").select("ix", r6(F.coalesce("f", F.lit(0.0)), 5).alias("f"))


@query("L2_ranked_groups", f"""SELECT ix::INTEGER AS ix, rank::INTEGER AS rank, ((rank - 1) % 3)::INTEGER AS group_ix FROM (SELECT ix, row_number() OVER (ORDER BY f DESC NULLS LAST, ix) AS rank FROM ({_f_sql(_LI)})) WHERE rank <= 6""")
def _(t):
    return se.ranked_groups(se.anova_f(line_features(t), "features"), 6, 2).select("ix", "rank", "group_ix")


@query("L3_channel_screening", f"""SELECT channel, {q6('score')} AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, channel) AS rank FROM (SELECT channel, avg(d * d) / (avg(v) + 1e-8) AS score FROM (
  SELECT channel, frame, max(m) FILTER (label = 1) - max(m) FILTER (label = 0) AS d, avg(v) AS v FROM (SELECT channel, frame, label, avg(value) AS m, var_pop(value) AS v FROM ({GRID}) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)) WHERE rank <= 3""")
def _(t):
    return se.screen_channels(t.grid, "channel", "frame", "value", "label", 3).withColumn("score", r6(F.col("score")))


# 64 vector positions in 4 families, votes of 3 folds x 2 repeats
_DEALT = f"""SELECT sample_id, repeat, (row_number() OVER (PARTITION BY repeat, label ORDER BY {h60("'42:' || repeat || ':' || sample_id")}, sample_id) - 1) % 3 AS inner_fold FROM (SELECT vec_id AS sample_id, (label >= 5)::INTEGER AS label FROM embeddings), (SELECT unnest(range(0, 2)) AS repeat)"""
_VOTEROWS = f"SELECT repeat, v AS vote, frame AS ix, label, value AS x FROM ({SERIES}) JOIN ({_DEALT}) USING (sample_id), (SELECT unnest(range(0, 3)) AS v) WHERE v <> inner_fold"
_VOTES = f"SELECT repeat, vote, ix, ix // 16 AS family, greatest(coalesce(f, 0), 0) AS f, row_number() OVER (PARTITION BY repeat, vote, ix // 16 ORDER BY f DESC, ix) AS r FROM ({_f_sql(_VOTEROWS, 'repeat, vote')})"


def vectors64(t):
    return t.read("embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def votes(t):
    return se.vote_scores(vectors64(t), "features", "label", "sample_id", folds=3, repeats=2)


def families(t):
    return t.spark.range(64).select(F.col("id").cast("int").alias("ix"), F.expr("cast(id div 16 as string)").alias("family"))


@query("L4_stable_ranking", f"""SELECT family::VARCHAR AS family, ix::INTEGER AS ix, {q6('fr + 0.05 * lf / max(lf) OVER (PARTITION BY family)', 5)} AS score FROM (SELECT family, ix, avg((r <= 5)::INTEGER) AS fr, avg(ln(1 + f)) AS lf FROM ({_VOTES}) GROUP BY 1, 2)""")
def _(t):
    return se.stable_ranking(votes(t), families(t), 5).select("family", "ix", r6(F.col("score"), 5).alias("score"))


_UTIL = f"SELECT family, median(u) AS utility FROM (SELECT family, repeat, vote, avg(ln(1 + f)) AS u FROM ({_VOTES}) WHERE r <= 16 GROUP BY 1, 2, 3) GROUP BY 1"


@query("L5_family_utility", f"SELECT family::VARCHAR AS family, {q6('utility', 5)} AS utility, 16::BIGINT AS capacity FROM ({_UTIL})")
def _(t):
    return se.family_utilities(votes(t), families(t)).withColumn("utility", r6(F.col("utility"), 5))


@query("L5_budget_allocation", f"""WITH u AS ({_UTIL}), w AS (SELECT family, exp((utility - max(utility) OVER ()) / 0.5) AS e, row_number() OVER (ORDER BY utility DESC, family) AS place FROM u), s AS (SELECT *, e / sum(e) OVER () AS wt FROM w WHERE place <= 5),
  sl AS (SELECT family, row_number() OVER (ORDER BY wt / j DESC, place, j) AS r FROM s, (SELECT unnest(range(1, 13)) AS j)) SELECT family::VARCHAR AS family, 4 + count(*) FILTER (r <= 4) AS budget FROM sl GROUP BY 1""")
def _(t):
    return se.allocate_budget(se.family_utilities(votes(t), families(t)), 20, active=12, minimum=4)


@query("L6_redundancy_suppression")
def _(t):
    v = votes(t)
    ranking = se.stable_ranking(v, families(t), 5).select("family", "ix", "rank")
    budgets = se.allocate_budget(se.family_utilities(v, families(t)), 20, minimum=4)
    return se.suppress_redundant(vectors64(t), "features", ranking, budgets, threshold=0.3)


@query("L7_expert_matrix", f"""SELECT sample_id, i - 1 AS position, e[[3, 17, 40, 5][i] + 1]::DOUBLE AS value FROM (SELECT vec_id AS sample_id, embedding AS e FROM embeddings), (SELECT unnest(range(1, 5)) AS i)""")
def _(t):
    out = se.assemble(vectors64(t), "features", [3, 17, 40, 5], "m")
    return out.select("sample_id", F.posexplode("m").alias("position", "value")).withColumn("position", F.col("position").cast("bigint"))


_CAND = f"""SELECT fold AS split, m.candidate, m.position, avg((label = (p >= m.cut)::INTEGER)::INTEGER) AS score FROM (SELECT fold, label, probability AS p FROM ({PREDS})), (VALUES ('PPV_MIX', 0, 0.4), ('ZC_MIX', 1, 0.5), ('MPV_MIX', 2, 0.6)) m(candidate, position, cut) GROUP BY 1, 2, 3"""


def candidate_scores(t):
    c = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.lit(i).alias("position"), F.lit(x).alias("cut")) for n, i, x in (("PPV_MIX", 0, 0.4), ("ZC_MIX", 1, 0.5), ("MPV_MIX", 2, 0.6))])).alias("c")
    rows = t.preds.select("fold", "label", "probability", c)
    hit = (F.col("label") == (F.col("probability") >= F.col("c.cut")).cast("int")).cast("int")
    return rows.groupBy(F.col("fold").alias("split"), "c.candidate", "c.position").agg(F.avg(hit).alias("score"))


@query("L8_candidate_choice", f"""WITH s AS ({_CAND}), w AS (SELECT candidate AS proposed, median(score) AS ms FROM s GROUP BY candidate ORDER BY ms DESC, min(position) LIMIT 1), c AS (SELECT split, score AS cut FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC) AS r FROM s) WHERE r = 1)
  SELECT proposed, {q6('ms')} AS median_score, {q6('avg((score >= cut)::INTEGER)')} AS support, CASE WHEN avg((score >= cut)::INTEGER) >= 0.6 THEN proposed ELSE 'PPV_MIX' END AS chosen FROM s JOIN w ON s.candidate = w.proposed JOIN c USING (split) GROUP BY proposed, ms""")
def _(t):
    out = se.choose_candidate(candidate_scores(t), vote_top=1, vote_threshold=0.6, series_length=32, length_threshold=128)
    return out.select("proposed", r6(F.col("median_score")).alias("median_score"), r6(F.col("support")).alias("support"), "chosen")


# -- fitting ----------------------------------------------------------------------------------------------


def split_vectors(t):
    h = draw("split", F.col("sample_id")) % 5
    rows = vectors64(t).withColumn("part", F.when(h == 4, "test").otherwise("train"))
    return rows.filter("part = 'train'"), rows.filter("part = 'test'")


@query("L9_ridge_grid")
def _(t):
    train, test = split_vectors(t)
    scored, alpha = fit.ridge_grid(train, test, "features")
    return threshold_metrics(scored, []).withColumn("alpha", F.lit(alpha))


@query("L10_linear_classifiers")
def _(t):
    train, test = split_vectors(t)
    out = None
    for kind in ("logistic_l2", "elastic_net", "linear_svm"):
        part = fit.fit_predict(train, test, "features", kind).select("sample_id", "label", "prediction", "probability", F.lit(kind).alias("classifier"))
        out = part if out is None else out.unionByName(part)
    return out


@query("L11_grid_search")
def _(t):
    board, _ = fit.grid_search(vectors64(t), "features", "sample_id", kinds={"logistic_l2": [0.1, 1.0], "linear_svm": [1.0]}, ks=[16], folds=2)
    return fit.best_per_classifier(board)


@query("L12_interval_forest")
def _(t):
    iv = dic.interval_features(traces16(t), ["sample_id", "channel"], 16, 5)
    cells = F.array_sort(F.collect_list(F.struct("channel", "view", "interval", *dic.STATISTICS)))
    rows = iv.groupBy("sample_id").agg(cells.alias("p"))
    flat = F.flatten(F.transform("p", lambda z: F.array(*[z[s] for s in dic.STATISTICS])))
    rows = rows.select("sample_id", flat.alias("features")).join(_labels(t), "sample_id")
    h = draw("split", F.col("sample_id")) % 5
    return fit.fit_predict(rows.filter(h != 4), rows.filter(h == 4), "features", "forest").select("sample_id", "label", "prediction", "probability")


_ACC = f"SELECT model, avg((label = prediction)::INTEGER) AS acc FROM ({PREDS}) GROUP BY 1"


@query("L13_weighted_ensemble", f"""SELECT sample_id, {q6('sum(pow(acc, 4) * probability) / sum(pow(acc, 4))')} AS probability, count(*) AS components, (sum(pow(acc, 4) * probability) / sum(pow(acc, 4)) >= 0.5)::INTEGER AS prediction
  FROM ({PREDS}) JOIN ({_ACC}) USING (model) GROUP BY sample_id""")
def _(t):
    acc = t.preds.groupBy("model").agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("acc"))
    return fit.weighted_ensemble(t.preds.join(acc, "model"), ["sample_id"], "acc").withColumn("probability", r6(F.col("probability")))


EXPERTS = {"first": ("logistic_l2", list(range(0, 32))), "second": ("logistic_l2", list(range(32, 64)))}


@query("L14_out_of_fold_experts")
def _(t):
    return fit.out_of_fold(vectors64(t), "features", "sample_id", EXPERTS, folds=2)


@query("L15_simplex_weights")
def _(t):
    rows = t.preds.select("sample_id", "label", F.col("model").alias("expert"), "probability")
    weights = fit.simplex_weights(rows, ["a", "b"], "sample_id")
    return t.spark.createDataFrame(list(weights.items()), "expert string, weight double")


@query("L16_group_average", f"""SELECT sample_id, {q6('avg(CASE WHEN model = \'b\' AND fold = 2 THEN 0.25 ELSE probability END)')} AS probability FROM ({PREDS}) GROUP BY 1""")
def _(t):
    rows = t.preds.withColumn("probability", F.when(~((F.col("model") == "b") & (F.col("fold") == 2)), F.col("probability")))
    return fit.group_average(rows, ["sample_id"], F.lit(0.25)).withColumn("probability", r6(F.col("probability")))
