"""Metrics, bootstrap, attribution and result tables on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorgrid.functions import values as v
from anchorgrid.functions.hashing import draw
from anchorgrid.operators import attribution as at, metrics as mt, resampling as rs, results as rl
from anchorgrid.operators.ordered import attach_row, exact_quantile
from anchorgrid.plans.registry import query
from anchorgrid.plans.roles import CUES, EV, PREDS, h32, h60, q6, r6
from anchorgrid.session import scratch
from anchorgrid.sources import files

LOGIT = "ln(probability / (1 - probability))"


def cells_sql(source, by, y="label", p="prediction", w="1"):
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    pick = lambda a, b: f"coalesce(sum({w}) FILTER ({y} = {a} AND {p} = {b}), 0)::DOUBLE"
    return f"SELECT {keys}{pick(1, 1)} AS tp, {pick(0, 1)} AS fp, {pick(0, 0)} AS tn, {pick(1, 0)} AS fn FROM ({source}) {group}"


def _div(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"


P, R, NP, NR = _div("tp", "tp + fp"), _div("tp", "tp + fn"), _div("tn", "tn + fn"), _div("tn", "tn + fp")
F1, NF1 = _div(f"2 * {P} * {R}", f"{P} + {R}"), _div(f"2 * {NP} * {NR}", f"{NP} + {NR}")
SQL = {
    "accuracy": "(tp + tn) / (tp + fp + tn + fn)", "balanced_accuracy": f"({R} + {NR}) / 2", "precision": P, "recall": R, "specificity": NR,
    "f1": F1, "negative_precision": NP, "negative_recall": NR, "negative_f1": NF1, "macro_f1": f"({F1} + {NF1}) / 2",
    "weighted_f1": f"({F1} * (tp + fn) + {NF1} * (tn + fp)) / (tp + fp + tn + fn)",
    "mcc": _div("tp * tn - fp * fn", "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"),
}


def ranking_sql(source, by, score="probability", w="1"):
    """roc_auc and average_precision per key from distinct scores."""
    return f"""SELECT {by}, CASE WHEN max(tp) > 0 AND max(fp) > 0 THEN sum(n * (tp - p / 2.0::DOUBLE)) / (max(tp)::DOUBLE * max(fp)) END AS roc_auc,
      CASE WHEN max(tp) > 0 AND max(fp) > 0 THEN sum(p * (tp::DOUBLE / (tp + fp))) / max(tp) END AS average_precision FROM (
      SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM (SELECT {by}, {score} AS s, sum({w} * label) AS p, sum({w} * (1 - label)) AS n
      FROM ({source}) GROUP BY {by}, {score}) WINDOW w AS (PARTITION BY {by} ORDER BY s DESC)) GROUP BY {by}"""


def scored_sql(source, by, logit):
    """The five attribution metrics of a logit column per key."""
    rows = f"SELECT *, 1 / (1 + exp(-{logit})) AS pr, (1 / (1 + exp(-{logit})) >= threshold)::INTEGER AS yy FROM ({source})"
    return f"""SELECT {by}, {SQL['macro_f1']} AS macro_f1, {SQL['balanced_accuracy']} AS balanced_accuracy, roc_auc, average_precision, loss
      FROM ({cells_sql(rows, by, p='yy')}) JOIN ({ranking_sql(rows, by, 'pr')}) USING ({by})
      JOIN (SELECT {by}, avg(ln(1 + exp({logit})) - label * {logit}) AS loss FROM ({rows}) GROUP BY {by}) USING ({by})"""


@query("A1_threshold_metrics", f"""SELECT model, fold, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, {', '.join(f'{q6(e)} AS {n}' for n, e in SQL.items())},
  tp + fn AS positive_support, tn + fp AS negative_support, tp + fp + tn + fn AS num_examples FROM ({cells_sql(PREDS, 'model, fold')})""")
def _(t):
    out = mt.threshold_metrics(t.preds, ["model", "fold"])
    return out.select("model", "fold", *mt.COUNTS, *[r6(F.col(m)).alias(m) for m in SQL], "positive_support", "negative_support", "num_examples")


@query("A2_roc_auc", f"SELECT model, fold, {q6('roc_auc')} AS roc_auc FROM ({ranking_sql(PREDS, 'model, fold')})")
def _(t):
    return mt.ranking_metrics(t.preds, ["model", "fold"]).select("model", "fold", r6(F.col("roc_auc")).alias("roc_auc"))


@query("A3_average_precision", f"SELECT model, lang, {q6('average_precision')} AS average_precision FROM ({ranking_sql(PREDS, 'model, lang')})")
def _(t):
    return mt.ranking_metrics(t.preds, ["model", "lang"]).select("model", "lang", r6(F.col("average_precision")).alias("average_precision"))


@query("A4_log_loss", f"SELECT model, fold, {q6(f'avg(-label * ln(probability) - (1 - label) * ln(1 - probability))')} AS loss FROM ({PREDS}) GROUP BY 1, 2")
def _(t):
    rows = t.preds.withColumn("logit", v.logit(F.col("probability")))
    return mt.log_loss(rows, ["model", "fold"], "logit").withColumn("loss", r6(F.col("loss")))


_CAND = f"""SELECT DISTINCT model, c FROM (SELECT model, probability AS c FROM ({PREDS}) UNION ALL SELECT model, unnest([pow(2.0, -23), 0.5::DOUBLE, 1 - pow(2.0, -23)]) FROM ({PREDS}))"""
_CUT = f"""SELECT c.model, c.c, sum((p.probability >= c AND label = 1)::INTEGER)::DOUBLE AS tp, sum((p.probability >= c AND label = 0)::INTEGER)::DOUBLE AS fp,
  sum((p.probability < c AND label = 0)::INTEGER)::DOUBLE AS tn, sum((p.probability < c AND label = 1)::INTEGER)::DOUBLE AS fn FROM ({_CAND}) c JOIN ({PREDS}) p ON p.model = c.model GROUP BY 1, 2"""


@query("A5_best_threshold", f"""SELECT model, c AS threshold, {q6('m')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(m, 12) DESC, round(b, 12) DESC, abs(c - 0.5), c) AS rn
  FROM (SELECT model, c, {SQL['macro_f1']} AS m, {SQL['balanced_accuracy']} AS b FROM ({_CUT}))) WHERE rn = 1""")
def _(t):
    return mt.best_threshold(t.preds, ["model"]).withColumn("value", r6(F.col("value")))


_FOLDM = f"""SELECT model, fold, metric, CASE metric WHEN 'accuracy' THEN {SQL['accuracy']} WHEN 'macro_f1' THEN {SQL['macro_f1']} ELSE {SQL['mcc']} END AS value
  FROM ({cells_sql(PREDS, 'model, fold')}), (VALUES ('accuracy'), ('macro_f1'), ('mcc')) m(metric)"""
_STATS = f"""count(*) AS num_folds, count(value) AS num_valid_folds, {q6('avg(value)')} AS mean, {q6('stddev_samp(value)')} AS standard_deviation,
  {q6('median(value)')} AS median, {q6('min(value)')} AS minimum, {q6('max(value)')} AS maximum, {q6('stddev_samp(value) / sqrt(count(value))')} AS standard_error"""
_STAT_COLUMNS = ("mean", "standard_deviation", "median", "minimum", "maximum", "standard_error")


def fold_metrics(t):
    m = mt.threshold_metrics(t.preds, ["model", "fold"]).select("model", "fold", "accuracy", "macro_f1", "mcc")
    return mt.to_long(m, ["model", "fold"], ["accuracy", "macro_f1", "mcc"])


@query("A6_fold_statistics", f"SELECT model, metric, {_STATS} FROM ({_FOLDM}) GROUP BY 1, 2")
def _(t):
    out = mt.fold_statistics(fold_metrics(t), ["model", "metric"])
    return out.select("model", "metric", "num_folds", "num_valid_folds", *[r6(F.col(c)).alias(c) for c in _STAT_COLUMNS])


@query("A7_pooled_metrics", f"""SELECT model, {q6(SQL['macro_f1'])} AS macro_f1, {q6(SQL['accuracy'])} AS accuracy, {q6('roc_auc')} AS roc_auc, {q6('average_precision')} AS average_precision
  FROM ({cells_sql(PREDS, 'model')}) JOIN ({ranking_sql(PREDS, 'model')}) USING (model)""")
def _(t):
    stored = F.when(F.col("sample_id") % 3 != 0, F.col("prediction"))  # the rest falls back to the threshold
    out = mt.pooled_metrics(t.preds.withColumn("prediction", stored), ["model"])
    return out.select("model", *[r6(F.col(c)).alias(c) for c in ("macro_f1", "accuracy", "roc_auc", "average_precision")])


# the metric summary of both models: the first stands for validation, the second for test
@query("S12_metric_summary_csv", f"""SELECT CASE WHEN model = 'a' THEN 'validation' ELSE 'test' END AS split, metric, {_STATS} FROM ({_FOLDM}) GROUP BY 1, 2""")
def _(t):
    split = F.when(F.col("model") == "a", "validation").otherwise("test")
    out = mt.fold_statistics(fold_metrics(t).withColumn("split", split), ["split", "metric"])
    folder = scratch(t.spark, "csv")
    files.write_metric_summary(out, folder)
    kinds = {"split": "string", "metric": "string", "num_folds": "bigint", "num_valid_folds": "bigint"}
    back = t.spark.read.option("header", True).schema(", ".join(f"{c} {kinds.get(c, 'double')}" for c in files.METRIC_SUMMARY)).csv(folder)
    return back.select(*kinds, *[r6(F.col(c)).alias(c) for c in _STAT_COLUMNS])


@query("A8_cv_summary", f"""SELECT *, (SELECT string_agg(f || ':' || n, ',' ORDER BY f) FROM (SELECT (chunk % 4)::VARCHAR AS f, count(*) AS n FROM ({EV}) WHERE user_id = s.model GROUP BY 1)) AS predictions_per_fold FROM (
  SELECT user_id AS model, count(DISTINCT k) AS samples, count(DISTINCT k) - count(DISTINCT CASE WHEN n = 1 THEN k END) AS duplicated_samples,
  coalesce(sum(CASE WHEN rn = 1 AND n > 1 THEN n END), 0)::BIGINT AS duplicate_occurrences, count(DISTINCT chunk % 4) AS folds, count(*) AS predictions
  FROM (SELECT *, count(*) OVER (PARTITION BY user_id, k) AS n, row_number() OVER (PARTITION BY user_id, k) AS rn FROM ({EV})) GROUP BY 1) s""")
def _(t):
    rows = t.ev.select(F.col("user_id").alias("model"), (F.col("chunk") % 4).alias("fold"), F.col("k").alias("sample_id"))
    listed = F.transform(F.array_sort(F.map_entries("predictions_per_fold")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return mt.cv_summary(rows, ["model"]).withColumn("predictions_per_fold", F.concat_ws(",", listed))


@query("A9_seed_statistics", f"SELECT metric, {_STATS} FROM (SELECT metric, fold % 3 AS seed, avg(value) AS value FROM ({_FOLDM}) GROUP BY 1, 2) GROUP BY 1")
def _(t):
    out = mt.seed_statistics(fold_metrics(t).withColumn("seed", F.col("fold") % 3), ["metric"])
    return out.select("metric", "num_folds", "num_valid_folds", *[r6(F.col(c)).alias(c) for c in _STAT_COLUMNS])


@query("A10_selection_counts", f"""SELECT l_returnflag AS expert, l_linestatus AS family, count(*) AS selected, count(DISTINCT l_suppkey) AS features, sum((l_discount = 0)::INTEGER)::BIGINT AS fallbacks FROM lineitem GROUP BY 1, 2""")
def _(t):
    rows = t.read("lineitem").withColumnsRenamed({"l_returnflag": "expert", "l_linestatus": "family"})
    return rl.selection_counts(rows, ["expert", "family"], "l_suppkey", F.col("l_discount") == 0)


_ATTRIBUTES = {"expert": "l_returnflag", "view": "l_suppkey % 7", "dilation_regime": "nullif(l_linenumber, 1)", "pooling": "l_linestatus"}


@query("A10_selected_distribution", " UNION ALL ".join(f"SELECT '{name}' AS category, coalesce(({column})::VARCHAR, 'none') AS value, count(*) AS selected FROM lineitem GROUP BY 2" for name, column in _ATTRIBUTES.items()))
def _(t):
    rows = t.read("lineitem").select(*[F.expr(column).alias(name) for name, column in _ATTRIBUTES.items()])
    return rl.selected_distribution(rows, list(_ATTRIBUTES))


# -- bootstrap ----------------------------------------------------------------------------------

REPS = 2000
_A = f"SELECT * FROM ({PREDS}) WHERE model = 'a'"
_B = f"SELECT * FROM ({PREDS}) WHERE model = 'b'"
_DRAW = f"""SELECT b.rep, ix, count(*) AS n FROM (SELECT rep, {h60("'42:' || rep || ':' || slot")} %% (SELECT count(*) FROM (%s)) AS ix
  FROM (SELECT unnest(range(0, {REPS})) AS rep), (SELECT unnest(range(0, (SELECT count(*) FROM (%s)))) AS slot)) b GROUP BY 1, 2"""


def _drawn(source, order):
    return f"SELECT d.rep, d.n, x.* FROM ({_DRAW % (source, source)}) d JOIN (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS ix FROM ({source})) x ON x.ix = d.ix"


def _cell_draws(source, keys, most):
    """Counts of each cell in each repetition: binomials of what is left, by the smallest count whose cumulated probability reaches the uniform."""
    names = ", ".join(keys)
    steps = [f"""WITH c AS MATERIALIZED (SELECT *, sum(n) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(n) OVER () AS total
  FROM (SELECT row_number() OVER (ORDER BY {names}) - 1 AS i, {names}, n FROM (SELECT {names}, count(*)::BIGINT AS n FROM ({source}) GROUP BY ALL))),
  d0 AS MATERIALIZED (SELECT rep, (SELECT max(total) FROM c)::BIGINT AS remains, 0::BIGINT AS k FROM (SELECT unnest(range(0, {REPS})) AS rep))"""]
    for i in range(most):
        u = f"({h60(f"'42:' || rep || ':{i}'")} + 0.5) / pow(2.0, 60)"
        steps.append(f"""d{i + 1} AS MATERIALIZED (SELECT rep, left_over - k AS remains, k FROM (SELECT s.rep, any_value(s.remains) AS left_over,
    CASE WHEN any_value(c.n) IS NULL THEN 0 WHEN any_value(c.n) = any_value(c.rest) THEN any_value(s.remains) ELSE coalesce(min(s.j) FILTER (s.reached >= s.u), any_value(s.remains)) END::BIGINT AS k
    FROM (SELECT rep, remains, j, u, sum(exp(lgamma(remains + 1) - lgamma(j + 1) - lgamma(remains - j + 1) + j * ln(p) + (remains - j) * ln(1 - p))) OVER (PARTITION BY rep ORDER BY j) AS reached
      FROM (SELECT rep, remains, {u} AS u, unnest(range(0, remains + 1)) AS j, least((SELECT n::DOUBLE / rest FROM c WHERE i = {i}), 0.9999999999) AS p FROM d{i})) s
    LEFT JOIN c ON c.i = {i} GROUP BY s.rep))""")
    union = " UNION ALL ".join(f"SELECT rep, k AS n, c.* EXCLUDE (i, n, rest, total) FROM d{i + 1} JOIN c ON c.i = {i}" for i in range(most))
    return f"{', '.join(steps)} {union}"


def _interval(values):
    return f"SELECT {q6('quantile_cont(value, 0.025)')} AS lower, {q6('quantile_cont(value, 0.975)')} AS upper, count(*) - count(value) AS dropped FROM ({values})"


@query("A11_bootstrap_macro_f1", f"""SELECT *, (SELECT {q6(SQL['macro_f1'])} FROM ({cells_sql(_A, '')})) AS point
  FROM ({_interval(f"SELECT rep, {SQL['macro_f1']} AS value FROM ({cells_sql(_cell_draws(_A, ['label', 'prediction'], 4), 'rep', w='n')})")})""")
def _(t):
    out = rs.bootstrap_threshold_metric(t.preds.filter("model = 'a'"), "macro_f1", REPS)
    return out.select(*[r6(F.col(c)).alias(c) for c in ("lower", "upper", "point")], "dropped")


@query("A11_bootstrap_roc_auc", f"""SELECT *, (SELECT {q6('roc_auc')} FROM ({ranking_sql(_A, 'model')})) AS point
  FROM ({_interval(f"SELECT rep, roc_auc AS value FROM ({ranking_sql(_drawn(_A, 'sample_id'), 'rep', w='n')})")})""")
def _(t):
    out = rs.bootstrap_ranking_metric(t.preds.filter("model = 'a'"), "roc_auc", REPS, ["sample_id"])
    return out.select(*[r6(F.col(c)).alias(c) for c in ("lower", "upper", "point")], "dropped")


_PAIR = f"SELECT a.sample_id, a.label, a.prediction AS pa, b.prediction AS pb FROM ({_A}) a JOIN ({_B}) b USING (sample_id)"


def pair(t):
    return rs.align(t.preds.filter("model = 'a'"), t.preds.filter("model = 'b'"))


@query("J5_align_models", f"""SELECT a.sample_id, a.label, a.probability AS probability_a, b.probability AS probability_b, a.prediction AS prediction_a, b.prediction AS prediction_b
  FROM ({_A}) a JOIN ({_B}) b USING (sample_id)""")
def _(t):
    return pair(t)


_PB = f"""SELECT rep, (SELECT {SQL['macro_f1']} FROM (SELECT ta AS tp, fa AS fp, na AS tn, ma AS fn)) AS a, (SELECT {SQL['macro_f1']} FROM (SELECT tb AS tp, fb AS fp, nb AS tn, mb AS fn)) AS b FROM (
  SELECT rep, {', '.join(f"coalesce(sum(n) FILTER (label = {y} AND p{m} = {p}), 0)::DOUBLE AS {c}{m}" for m in 'ab' for c, y, p in (('t', 1, 1), ('f', 0, 1), ('n', 0, 0), ('m', 1, 0)))}
  FROM ({_cell_draws(_PAIR, ['label', 'pa', 'pb'], 8)}) GROUP BY rep)"""


@query("A12_paired_bootstrap", f"""SELECT {q6('quantile_cont(a - b, 0.025)')} AS lower, {q6('quantile_cont(a - b, 0.975)')} AS upper, {q6('avg((a > b)::INTEGER)')} AS probability_a_better FROM ({_PB})""")
def _(t):
    return rs.paired_bootstrap(pair(t), "macro_f1", REPS).select(*[r6(F.col(c)).alias(c) for c in ("lower", "upper", "probability_a_better")])


_MC = f"""SELECT sum((pa = label AND pb <> label)::INTEGER)::BIGINT AS only_a, sum((pa <> label AND pb = label)::INTEGER)::BIGINT AS only_b,
  sum((pa = label AND pb = label)::INTEGER)::BIGINT AS both_correct, sum((pa <> label AND pb <> label)::INTEGER)::BIGINT AS both_wrong FROM ({_PAIR})"""


@query("A13_mcnemar", f"SELECT *, {q6('pow(abs(only_a - only_b) - 1, 2) / (only_a + only_b)')} AS statistic FROM ({_MC})")
def _(t):
    return rs.mcnemar(pair(t)).withColumn("statistic", r6(F.col("statistic"))).drop("p_value")


@query("A13_mcnemar_p_value")
def _(t):
    return rs.mcnemar(pair(t))


@query("A14_comparison_matrix")
def _(t):
    models = {m: t.preds.filter(F.col("model") == m) for m in ("a", "b")}
    models["c"] = models["a"].filter(F.col("lang") == "en")  # too little overlap: the pair keeps a reason
    return rs.comparison_matrix(models, "macro_f1", REPS)


_CL = f"SELECT group_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in ('tp', 'fp', 'tn', 'fn'))} FROM ({cells_sql(_A, 'group_id')})"


@query("A15_cluster_bootstrap", f"""SELECT {q6('quantile_cont(value, 0.025)')} AS lower, {q6('quantile_cont(value, 0.975)')} AS upper, (SELECT {q6(SQL['macro_f1'])} FROM ({cells_sql(_A, '')})) AS point
  FROM (SELECT rep, {SQL['macro_f1']} AS value FROM (SELECT rep, sum(n * tp) AS tp, sum(n * fp) AS fp, sum(n * tn) AS tn, sum(n * fn) AS fn FROM ({_drawn(_CL, 'group_id')}) GROUP BY rep))""")
def _(t):
    clusters = mt.confusion(t.preds.filter("model = 'a'"), ["group_id"])
    value = mt.metric_columns(*[F.col(c) for c in mt.COUNTS])["macro_f1"]
    return rs.cluster_bootstrap(clusters, ["group_id"], list(mt.COUNTS), value, REPS).select(*[r6(F.col(c)).alias(c) for c in ("lower", "upper", "point")])


_FM = f"SELECT fold, {SQL['macro_f1']} AS value FROM ({cells_sql(_A, 'fold')})"


@query("A16_bootstrap_fold_mean", f"""SELECT {q6('quantile_cont(value, 0.025)')} AS lower, {q6('quantile_cont(value, 0.975)')} AS upper, (SELECT {q6('avg(value)')} FROM ({_FM})) AS point
  FROM (SELECT rep, sum(n * value) / sum(n) AS value FROM ({_drawn(_FM, 'fold')}) GROUP BY rep)""")
def _(t):
    folds = mt.threshold_metrics(t.preds.filter("model = 'a'"), ["fold"]).select("fold", "macro_f1")
    return rs.bootstrap_mean(folds, "macro_f1", ["fold"], REPS).select(*[r6(F.col(c)).alias(c) for c in ("lower", "upper", "point")])


@query("A17_descriptive", f"SELECT metric, {_STATS} FROM ({_FOLDM}) GROUP BY 1")
def _(t):
    out = mt.fold_statistics(fold_metrics(t), ["metric"])
    return out.select("metric", "num_folds", "num_valid_folds", *[r6(F.col(c)).alias(c) for c in _STAT_COLUMNS])


@query("A18_metric_decrease", f"""SELECT a.fold, a.metric, {q6('CASE WHEN a.metric = \'mcc\' THEN b.value - a.value ELSE a.value - b.value END')} AS decrease
  FROM ({_FOLDM}) a JOIN ({_FOLDM}) b ON a.fold = b.fold AND a.metric = b.metric WHERE a.model = 'a' AND b.model = 'b'""")
def _(t):
    m = fold_metrics(t)
    a, b = m.filter("model = 'a'").withColumnRenamed("value", "x"), m.filter("model = 'b'").select("fold", "metric", F.col("value").alias("y"))
    j = a.join(b, ["fold", "metric"])
    value = F.when(F.col("metric") == "mcc", at.decrease(F.col("x"), F.col("y"), "loss")).otherwise(at.decrease(F.col("x"), F.col("y"), "macro_f1"))
    return j.select("fold", "metric", r6(value).alias("decrease"))


# -- attribution ----------------------------------------------------------------------------------

BITS = 8
FULL = 2**BITS - 1
ONES = [2**b for b in range(BITS)]
# additive effects per bit from the hash of (sample, bit), and one interaction of bits 0 and 1
_EFFECT = f"({h32("'e:' || sample_id || ':' || b")} % 2001 - 1000) / 500.0::DOUBLE"
def coal_sql(bits):
    return f"""SELECT fold, sample_id, label, threshold, c AS coalition, round(label - 0.5::DOUBLE + sum(CASE WHEN (c >> b) & 1 = 1 THEN {_EFFECT} ELSE 0.0 END)
  + CASE WHEN c & 3 = 3 THEN 0.75 ELSE 0.0 END, 6) AS logit FROM ({_A}), (SELECT unnest(range(0, {2**bits})) AS c), (SELECT unnest(range(0, {bits})) AS b) GROUP BY fold, sample_id, label, threshold, c"""


_COAL = coal_sql(BITS)


def coalitions(t, bits=BITS):
    c = F.col("coalition")
    total = F.col("label") - F.lit(0.5)
    for b in range(bits):
        effect = (draw("e", F.col("sample_id"), b) % 2001 - 1000) / F.lit(500.0)
        total = total + F.when(F.shiftright(c, b).bitwiseAND(F.lit(1)) == 1, effect).otherwise(0.0)
    total = total + F.when(c.bitwiseAND(F.lit(3)) == 3, 0.75).otherwise(0.0)
    rows = t.preds.filter("model = 'a'").withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(2**bits - 1))))
    rows = rows.withColumn("coalition", c.cast("bigint"))
    return rows.select("fold", "sample_id", "group_id", "label", "threshold", "coalition", F.round(total, 6).alias("logit"))


_ABL = f"""SELECT 'm' || b AS modality, f.fold, f.sample_id, f.label, f.threshold, f.logit AS full_logit, c.logit AS ablated_logit
  FROM ({_COAL}) f, (SELECT unnest(range(0, {BITS})) AS b) JOIN ({_COAL}) c ON c.sample_id = f.sample_id AND c.coalition = {2**BITS - 1} - (1 << b) WHERE f.coalition = {2**BITS - 1}"""
_ABLS = f"SELECT *, modality || '/' || scope AS ky FROM (SELECT *, unnest(['fold-' || fold, 'pooled']) AS scope FROM ({_ABL}))"


def ablations(t):
    rows = coalitions(t)
    full = rows.filter(F.col("coalition") == 2**BITS - 1).select("fold", "sample_id", "label", "threshold", F.col("logit").alias("full_logit"))
    bit = F.round(F.log2((FULL - F.col("coalition")).cast("double"))).cast("int")
    single = rows.filter((2**BITS - 1 - F.col("coalition")).isin(*[2**b for b in range(BITS)]))
    cut = single.select("sample_id", F.concat(F.lit("m"), bit.cast("string")).alias("modality"), F.col("logit").alias("ablated_logit"))
    return full.join(cut, "sample_id")


@query("A19_ablation_table", f"""WITH rows AS MATERIALIZED ({_ABLS}), dec AS (SELECT split_part(ky, '/', 1) AS modality, split_part(ky, '/', 2) AS scope, f.macro_f1 - c.macro_f1 AS macro_f1_decrease, f.balanced_accuracy - c.balanced_accuracy AS balanced_accuracy_decrease,
    f.roc_auc - c.roc_auc AS roc_auc_decrease, f.average_precision - c.average_precision AS average_precision_decrease, c.loss - f.loss AS loss_decrease
  FROM ({scored_sql('SELECT * FROM rows', 'ky', 'full_logit')}) f JOIN ({scored_sql('SELECT * FROM rows', 'ky', 'ablated_logit')}) c USING (ky))
  SELECT modality, scope, {', '.join(f'{q6(m + "_decrease", 5)} AS {m}_decrease' for m in at.METRICS)}, r::INTEGER AS rank FROM dec JOIN (SELECT modality, row_number() OVER (ORDER BY macro_f1_decrease DESC, modality) AS r FROM dec WHERE scope = 'pooled') USING (modality)""")
def _(t):
    out = at.ablation_table(ablations(t))
    return out.select("modality", "scope", *[r6(F.col(f"{m}_decrease"), 5).alias(f"{m}_decrease") for m in at.METRICS], "rank")


ORDERINGS = 32


def shap_sql(bits):
    order = f"""SELECT unit, rev, bit, CASE WHEN rev = 0 THEN r ELSE {bits - 1} - r END AS pos FROM (SELECT unit, bit, row_number() OVER (PARTITION BY unit ORDER BY {h60("'42:' || unit || ':' || bit")}) - 1 AS r
  FROM (SELECT unnest(range(0, {ORDERINGS // 2})) AS unit), (SELECT unnest(range(0, {bits})) AS bit)), (VALUES (0), (1)) v(rev)"""
    steps = f"SELECT *, sum(1 << bit) OVER (PARTITION BY unit, rev ORDER BY pos)::BIGINT AS after FROM ({order})"
    return f"""SELECT fold, sample_id, bit, avg(d) AS value, stddev_samp(d) / sqrt(count(*)) AS standard_error FROM (
  SELECT x.fold, x.sample_id, s.bit, s.unit, avg(x.logit - y.logit) AS d FROM ({steps}) s JOIN co x ON x.coalition = s.after
  JOIN co y ON y.sample_id = x.sample_id AND y.coalition = s.after - (1 << s.bit) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""


_SHAP = shap_sql(BITS)


def shapley(t, bits=BITS):
    return at.sampled_shapley(coalitions(t, bits), bits, ORDERINGS)


@query("A20_sampled_shapley", f"WITH co AS MATERIALIZED ({_COAL}) SELECT fold, sample_id, bit, {q6('value', 5)} AS value, {q6('standard_error', 5)} AS standard_error FROM ({_SHAP})")
def _(t):
    return shapley(t).select("fold", "sample_id", F.col("bit").cast("bigint").alias("bit"), r6(F.col("value"), 5).alias("value"), r6(F.col("standard_error"), 5).alias("standard_error"))


@query("A20_shapley_efficiency", f"SELECT fold, sample_id, 0.0::DOUBLE AS gap FROM ({_A})")
def _(t):
    return at.efficiency_gap(shapley(t), coalitions(t), BITS).withColumn("gap", r6(F.abs(F.col("gap")), 8))


# values are rounded first: a share next to a rounding edge depends on the last bit of a sum
@query("A21_sample_attributions", f"""WITH co AS MATERIALIZED ({_COAL}), v AS (SELECT fold, sample_id, bit, round(value, 9) AS value FROM ({_SHAP}))
  SELECT fold, sample_id, bit, {q6('round(abs(value) / sum(abs(value)) OVER (PARTITION BY sample_id) * 100, 9)', 3)} AS absolute_share_percent FROM v""")
def _(t):
    out = at.sample_attributions(shapley(t).withColumn("value", F.round("value", 9)))
    return out.select("fold", "sample_id", F.col("bit").cast("bigint").alias("bit"), r6(F.round("absolute_share_percent", 9), 3).alias("absolute_share_percent"))


@query("A21_modality_attributions", f"""WITH co AS MATERIALIZED ({_COAL}) SELECT bit, {q6('avg(value)')} AS mean_signed, {q6('avg(abs(value))')} AS mean_absolute, {q6('avg(abs(value)) / (bit + 1)')} AS absolute_per_channel FROM ({_SHAP}) GROUP BY bit""")
def _(t):
    sizes = t.spark.range(BITS).select(F.col("id").cast("int").alias("bit"), (F.col("id") + 1).alias("channels"))
    out = at.modality_attributions(shapley(t), sizes)
    return out.select(F.col("bit").cast("bigint").alias("bit"), *[r6(F.col(c)).alias(c) for c in ("mean_signed", "mean_absolute", "absolute_per_channel")])


@query("J10_baseline_variant_join", f"""SELECT fold, sample_id, modality, {q6('full_logit - ablated_logit')} AS difference FROM ({_ABL})""")
def _(t):
    rows = ablations(t)
    base = rows.select("fold", "sample_id", F.col("full_logit").alias("logit")).distinct()
    out = at.pooled_join(base, rows.select("fold", "sample_id", "modality", F.col("ablated_logit").alias("logit")), ["fold", "sample_id"], "logit")
    return out.select("fold", "sample_id", "modality", r6(F.col("difference")).alias("difference"))


LOWER_FACE = 2**BITS - 1 - 6  # without the two bits that stand for the lower face
_MASKS = ", ".join([f"('full', 'full', NULL, {FULL})", *(f"('modality_only-m{b}', 'modality_only', 'm{b}', {2**b})" for b in range(BITS)),
                    *(f"('leave_one_out-m{b}', 'leave_one_out', 'm{b}', {FULL - 2**b})" for b in range(BITS)), f"('lower-face', 'lower_face', 'Facial', {LOWER_FACE})"])
_VAR = f"""SELECT variant, kind, modality, {', '.join(f'{SQL[m]} AS {m}' for m in ('accuracy', 'macro_f1'))} FROM ({cells_sql(f"SELECT v.variant, v.kind, v.modality, label, (logit >= 0)::INTEGER AS yy FROM ({_COAL}) JOIN (VALUES {_MASKS}) v(variant, kind, modality, mask) ON mask = coalition", 'variant, kind, modality', p='yy')})"""


def variant_scores(t):
    variants = at.retraining_variants(t.spark, [f"m{b}" for b in range(BITS)])
    bit = F.pow(F.lit(2.0), F.regexp_extract("modality", "m([0-9]+)", 1).try_cast("int"))
    mask = F.when(F.col("kind") == "full", FULL).when(F.col("kind") == "modality_only", bit).when(F.col("kind") == "lower_face", LOWER_FACE).otherwise(FULL - bit)
    # eighteen variants of eight modalities
    rows = coalitions(t).withColumn("y", (F.col("logit") >= 0).cast("int")).join(F.broadcast(variants.withColumn("coalition", mask.cast("bigint"))), "coalition")
    return mt.threshold_metrics(rows, ["variant", "kind", "modality"], prediction="y")


@query("A22_retraining_variants", f"""SELECT v.variant, v.kind, v.modality, {q6('v.macro_f1')} AS macro_f1, {q6('f.macro_f1 - v.macro_f1')} AS decrease FROM ({_VAR}) v, (SELECT macro_f1 FROM ({_VAR}) WHERE kind = 'full') f""")
def _(t):
    scores = variant_scores(t).select("variant", "kind", "modality", "macro_f1")
    rows = attach_row(scores, scores.filter("kind = 'full'").select(F.col("macro_f1").alias("__full")))
    return rows.select("variant", "kind", "modality", r6(F.col("macro_f1")).alias("macro_f1"), r6(at.decrease(F.col("__full"), F.col("macro_f1"), "macro_f1")).alias("decrease"))


@query("A22_retraining_rankings", f"""SELECT v.kind, v.modality, {q6('v.accuracy')} AS value, row_number() OVER (PARTITION BY v.kind ORDER BY CASE WHEN v.kind = 'modality_only' THEN v.accuracy ELSE f.accuracy - v.accuracy END DESC, v.modality)::INTEGER AS rank
  FROM ({_VAR}) v, (SELECT accuracy FROM ({_VAR}) WHERE kind = 'full') f WHERE v.kind IN ('modality_only', 'leave_one_out')""")
def _(t):
    scores = variant_scores(t).withColumnRenamed("accuracy", "value")
    return at.retraining_rankings(scores.select("variant", "kind", "modality", "value")).select("kind", "modality", r6(F.col("value")).alias("value"), "rank")


TARGETS = [*(f"m{b}" for b in range(BITS)), "All"]
CONDITIONS = [*(("shift", m) for m in (-4, -2, -1, 1, 2, 4)), ("scale", 2), ("scale", 3)]
# perturbed logits: the full logit moved by a hash that grows with the magnitude
_ROB = f"""SELECT target, kind, magnitude, target || '/' || kind || '/' || magnitude AS ky, fold, sample_id, group_id, label, threshold, logit AS baseline_logit,
  round(logit + (abs(magnitude) / 4.0::DOUBLE) * ({h32("'r:' || target || ':' || kind || ':' || magnitude || ':' || sample_id")} % 2001 - 1000) / 500.0::DOUBLE, 6) AS perturbed_logit
  FROM (SELECT c.*, source AS group_id FROM ({_COAL}) c JOIN documents d ON d.doc_id = c.sample_id WHERE coalition = {2**BITS - 1}), (VALUES {', '.join(f"('{x}')" for x in TARGETS)}) t(target), (VALUES {', '.join(map(str, CONDITIONS))}) k(kind, magnitude)"""


def robustness_rows(t):
    cond = F.explode(F.array(*[F.struct(F.lit(a).alias("target"), F.lit(k).alias("kind"), F.lit(m).alias("magnitude"))
                               for a in TARGETS for k, m in CONDITIONS])).alias("c")
    rows = coalitions(t).filter(F.col("coalition") == 2**BITS - 1).select("*", cond).select("*", "c.target", "c.kind", "c.magnitude")
    noise = (draw("r", F.col("target"), F.col("kind"), F.col("magnitude"), F.col("sample_id")) % 2001 - 1000) / F.lit(500.0)
    return rows.withColumn("baseline_logit", F.col("logit")).withColumn(
        "perturbed_logit", F.round(F.col("logit") + (F.abs("magnitude") / F.lit(4.0)) * (draw("r", F.col("target"), F.col("kind"), F.col("magnitude"), F.col("sample_id")) % 2001 - 1000) / F.lit(500.0), 6))


_RS = f"""SELECT ky, count(*) AS n, avg((((1 / (1 + exp(-baseline_logit))) >= threshold) <> ((1 / (1 + exp(-perturbed_logit))) >= threshold))::INTEGER) AS flip_rate,
  avg(abs(1 / (1 + exp(-perturbed_logit)) - 1 / (1 + exp(-baseline_logit)))) AS probability_change, corr(baseline_logit, perturbed_logit) AS logit_correlation FROM ro GROUP BY ky"""
_ROBSUM = f"""SELECT split_part(ky, '/', 1) AS target, split_part(ky, '/', 2) AS kind, split_part(ky, '/', 3)::INTEGER AS magnitude, n, flip_rate, probability_change, logit_correlation,
  f.macro_f1 - c.macro_f1 AS macro_f1_decrease, c.loss - f.loss AS loss_decrease FROM ({_RS}) JOIN ({scored_sql('SELECT * FROM ro', 'ky', 'baseline_logit')}) f USING (ky) JOIN ({scored_sql('SELECT * FROM ro', 'ky', 'perturbed_logit')}) c USING (ky)"""


@query("A23_robustness_conditions", f"""WITH ro AS MATERIALIZED ({_ROB}) SELECT target, kind, magnitude, n, {', '.join(f'{q6(c, 5)} AS {c}' for c in ('flip_rate', 'probability_change', 'logit_correlation', 'macro_f1_decrease', 'loss_decrease'))},
  CASE WHEN kind = 'shift' THEN magnitude * 250.0::DOUBLE END AS shift_ms FROM ({_ROBSUM})""")
def _(t):
    out = at.robustness_summary(robustness_rows(t), 250.0)
    return out.select("target", "kind", "magnitude", "n", *[r6(F.col(c), 5).alias(c) for c in ("flip_rate", "probability_change", "logit_correlation", "macro_f1_decrease", "loss_decrease")], "shift_ms")


@query("A23_robustness_targets", f"""WITH ro AS MATERIALIZED ({_ROB}), s AS ({_ROBSUM}) SELECT target, {q6('m', 5)} AS mean_probability_change, {q6('f', 5)} AS mean_flip_rate, {q6('w', 5)} AS worst_macro_f1_decrease,
  CASE WHEN target <> 'All' THEN row_number() OVER (PARTITION BY target <> 'All' ORDER BY m DESC, target)::INTEGER END AS rank
  FROM (SELECT target, avg(probability_change) AS m, avg(flip_rate) AS f, max(macro_f1_decrease) AS w FROM s GROUP BY 1)""")
def _(t):
    out = at.robustness_targets(at.robustness_summary(robustness_rows(t), 250.0))
    return out.select("target", *[r6(F.col(c), 5).alias(c) for c in ("mean_probability_change", "mean_flip_rate", "worst_macro_f1_decrease")], "rank")


_MEAS = f"""SELECT event_type AS modality, 'mean_value' AS measure, avg(value) AS value FROM ({EV}) GROUP BY 1 UNION ALL SELECT event_type, 'rows', count(*)::DOUBLE FROM ({EV}) GROUP BY 1
  UNION ALL SELECT event_type, 'mean_k', avg(k) FROM ({EV}) GROUP BY 1"""
_RANKS = f"SELECT *, rank() OVER (PARTITION BY measure ORDER BY value DESC) + (count(*) OVER (PARTITION BY measure, value) - 1) / 2.0::DOUBLE AS rank FROM ({_MEAS})"


def measure_ranks(t):
    m = t.ev.groupBy(F.col("event_type").alias("modality")).agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).cast("double").alias("rows"), F.avg("k").alias("mean_k"))
    return at.average_ranks(mt.to_long(m, ["modality"], ["mean_value", "rows", "mean_k"]).withColumnRenamed("metric", "measure"))


@query("A26_rank_concordance", f"""SELECT a.measure AS "left", b.measure AS "right", {q6('corr(a.rank, b.rank)')} AS rho, count(*) AS n FROM ({_RANKS}) a JOIN ({_RANKS}) b ON a.modality = b.modality AND a.measure < b.measure GROUP BY 1, 2""")
def _(t):
    return at.rank_concordance(measure_ranks(t)).select("left", "right", r6(F.col("rho")).alias("rho"), "n")


@query("A26_rank_ranges", f"SELECT modality, max(rank) - min(rank) AS rank_range, CASE WHEN max(rank) - min(rank) >= 4 THEN 'discrepant' ELSE 'concordant' END AS interpretation FROM ({_RANKS}) GROUP BY 1")
def _(t):
    return at.rank_ranges(measure_ranks(t))


@query("W2_ranking", f"""SELECT user_id, {q6('avg(value)')} AS value, row_number() OVER (ORDER BY {q6('avg(value)')} DESC, user_id) AS rank FROM events GROUP BY 1""")
def _(t):
    from anchorgrid.operators.ordered import Ordered
    per = t.read("events").groupBy("user_id").agg(r6(F.avg("value")).alias("value")).withColumn("down", -F.col("value"))
    return Ordered(per, [], ["down", "user_id"]).numbered("rank").done().drop("down")


@query("W6_cumulative_counts", f"""SELECT model, s AS score, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM (SELECT model, probability AS s, sum(label) AS p, sum(1 - label) AS n FROM ({PREDS}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY model ORDER BY s DESC)""".replace("sum(p) OVER w", "(sum(p) OVER w)::BIGINT").replace("sum(n) OVER w", "(sum(n) OVER w)::BIGINT"))
def _(t):
    from anchorgrid.operators.ordered import Ordered
    cells = t.preds.groupBy("model", F.col("probability").alias("score")).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    line = Ordered(cells.withColumn("down", -F.col("score")), ["model"], ["down"]).running({"tp": F.col("p"), "fp": F.col("n")})
    return line.done().select("model", "score", "tp", "fp")


@query("A33_interval_overlap", f"""SELECT a.lang AS key, {q6('a.m - b.m')} AS difference, a.m - a.s <= b.m + b.s AND b.m - b.s <= a.m + a.s AS overlap, 0.05::DOUBLE / 4 AS bonferroni_alpha, 0.05::DOUBLE * 4 AS expected_false_positives FROM
  (SELECT lang, avg(probability) AS m, stddev_pop(probability) AS s FROM ({_A}) GROUP BY 1) a JOIN (SELECT lang, avg(probability) AS m, stddev_pop(probability) AS s FROM ({_B}) GROUP BY 1) b USING (lang)""")
def _(t):
    def side(m):
        s = t.preds.filter(F.col("model") == m).groupBy(F.col("lang").alias("key")).agg(F.avg("probability").alias("point"), F.stddev_pop("probability").alias("s"))
        return s.withColumn("lower", F.col("point") - F.col("s")).withColumn("upper", F.col("point") + F.col("s"))
    return at.interval_overlap(side("a"), side("b"), 4).withColumn("difference", r6(F.col("difference")))


@query("A34_median_duration", f"SELECT event_type, coalesce(median(k::DOUBLE), 300.0) AS duration FROM ({EV}) WHERE user_id % 5 <> 0 GROUP BY 1")
def _(t):
    train = t.ev.filter(F.col("user_id") % 5 != 0)
    return exact_quantile(train, ["event_type"], "k", 0.5, "duration").withColumn("duration", F.coalesce("duration", F.lit(300.0)))


# -- results tables: one run per (model, lang, fold) ------------------------------------------------

_RUNS = f"""SELECT 'm-' || model AS model, fold AS seed, lang AS variant, CASE lang WHEN (SELECT min(lang) FROM documents) THEN 'tgt-cue_src-robot_window-100' WHEN (SELECT max(lang) FROM documents) THEN 'tgt-cue_src-speaker_wL-500_wR-m' || 100 * (1 + fold)
  ELSE 'target-cue_window-' || 100 * (1 + fold) END AS family, avg(probability) AS mean FROM ({PREDS}) GROUP BY model, fold, lang"""


def runs(t):
    ends = t.read("documents").agg(F.min("lang").alias("lo"), F.max("lang").alias("hi"))
    per = attach_row(t.preds.groupBy("model", "fold", "lang").agg(F.avg("probability").alias("mean")), ends)
    hop = (100 * (1 + F.col("fold"))).cast("string")
    family = F.when(F.col("lang") == F.col("lo"), "tgt-cue_src-robot_window-100").when(
        F.col("lang") == F.col("hi"), F.concat(F.lit("tgt-cue_src-speaker_wL-500_wR-m"), hop)).otherwise(F.concat(F.lit("target-cue_window-"), hop))
    return per.select(F.concat(F.lit("m-"), "model").alias("model"), F.col("fold").alias("seed"), F.col("lang").alias("variant"), family.alias("family"),
                      F.lit("macro_f1").alias("metric"), "mean", F.lit(None).cast("string").alias("issue"))


@query("A35_symmetric_results", f"""SELECT model, variant, seed, regexp_extract(family, 'window-([0-9]+)', 1)::BIGINT AS left_ms, 'window-' || regexp_extract(family, 'window-([0-9]+)', 1) AS "window", true AS source_inferred, {q6('mean')} AS mean FROM ({_RUNS}) WHERE family LIKE 'target-%'""")
def _(t):
    good, _ = rl.collect_results(runs(t), event_source="speaker", symmetric=True)
    return good.select("model", "variant", "seed", "left_ms", "window", "source_inferred", r6(F.col("mean")).alias("mean"))


@query("A35_asymmetric_results", f"""SELECT model, variant, seed, 500::BIGINT AS left_ms, -100 * (1 + seed) AS right_ms, {q6('mean')} AS mean FROM ({_RUNS}) WHERE family LIKE '%_wR-m%' AND 500 - 100 * (1 + seed) > 0""")
def _(t):
    good, _ = rl.collect_results(runs(t), symmetric=False)
    return good.select("model", "variant", "seed", "left_ms", "right_ms", r6(F.col("mean")).alias("mean"))


@query("A35_collection_issues", f"""SELECT model, family, variant, seed, CASE WHEN family LIKE '%robot%' THEN 'source_unknown robot' ELSE 'window bounds are empty' END AS issue
  FROM ({_RUNS}) WHERE family LIKE '%robot%' OR (family LIKE '%_wR-m%' AND 500 - 100 * (1 + seed) <= 0)""")
def _(t):
    return rl.collect_results(runs(t))[1]


@query("A35_missing_windows", f"""SELECT DISTINCT m.model, 'window-' || w.w AS "window" FROM (SELECT DISTINCT model FROM ({_RUNS}) WHERE family LIKE 'target-%') m, (VALUES (100), (300), (900)) w(w)
  WHERE NOT EXISTS (SELECT 1 FROM ({_RUNS}) r WHERE r.model = m.model AND r.family = 'target-cue_window-' || w.w)""")
def _(t):
    good, _ = rl.collect_results(runs(t), symmetric=True)
    return rl.missing_windows(good, [(100, 100), (300, 300), (900, 900)])


@query("A36_model_ranking", f"""SELECT model, {q6('avg(value)')} AS value, count(*) AS windows, sum(runs)::BIGINT AS runs, row_number() OVER (ORDER BY avg(value) DESC NULLS LAST, model)::INTEGER AS rank
  FROM (SELECT model, family, avg(mean) AS value, count(*) AS runs FROM ({_RUNS}) WHERE family LIKE 'target-%' GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    good, _ = rl.collect_results(runs(t), symmetric=True)
    return rl.rank_models(good, "macro_f1").withColumn("value", r6(F.col("value")))


@query("A37_fold_result_issues", f"""SELECT user_id AS run, chunk AS fold, 'duplicate fold' AS issue FROM ({EV}) GROUP BY 1, 2 HAVING count(*) > 1
  UNION SELECT user_id, chunk, 'missing loss' FROM ({EV}) WHERE event_type = 'error' UNION SELECT user_id, chunk, 'not finite accuracy' FROM ({EV}) WHERE k % 10 = 0""")
def _(t):
    accuracy = F.when(F.col("k") % 10 == 0, float("nan")).otherwise(F.col("value"))
    full = F.create_map(F.lit("accuracy"), accuracy, F.lit("loss"), F.col("value"))
    part = F.create_map(F.lit("accuracy"), accuracy)
    rows = t.ev.select(F.col("user_id").alias("run"), F.col("chunk").alias("fold"), F.when(F.col("event_type") == "error", part).otherwise(full).alias("metrics"))
    return rl.fold_result_issues(rows, ["accuracy", "loss"])
