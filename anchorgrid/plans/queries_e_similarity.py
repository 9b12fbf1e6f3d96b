"""Neighbours, separability scans, spans and decoding on the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from anchorgrid.functions.hashing import draw
from anchorgrid.functions.traces import let
from anchorgrid.operators import attribution as at, separability as sep, similarity as sim, spans as sp
from anchorgrid.operators.ordered import exact_quantile
from anchorgrid.plans.queries_b_windows import links
from anchorgrid.plans.queries_c_series import long_form, traces16
from anchorgrid.plans.queries_d_metrics import SQL, cells_sql, ranking_sql
from anchorgrid.plans.registry import query
from anchorgrid.plans.roles import CUES, EV, GRID, LINKS, PGRID, h32, q6, r6
from anchorgrid.session import cut_lineage

# fold by hash of the vector; train 0-2, validation 3, test 4
_FOLD = h32("'split:' || sample_id") + " % 5"


def split_of(t):
    f = draw("split", F.col("sample_id")) % 5
    return F.when(f == 4, "test").when(f == 3, "validation").otherwise("train")


def _dist(fold):
    return f"""SELECT q.channel, q.sample_id AS query_id, r.sample_id AS reference_id, any_value(r.label) AS reference_label, sqrt(sum((q.value - r.value) * (q.value - r.value))) AS distance
  FROM (SELECT * FROM ({GRID}) WHERE {_FOLD} = {fold}) q JOIN (SELECT * FROM ({GRID}) WHERE {_FOLD} < 3) r ON q.channel = r.channel AND q.frame = r.frame GROUP BY 1, 2, 3"""


def _ranked(fold):
    return f"SELECT *, row_number() OVER (PARTITION BY channel, query_id ORDER BY distance, reference_id) AS rank FROM ({_dist(fold)})"


def sides(t, queries):
    rows = traces16(t).withColumn("split", split_of(t))
    q = rows.filter(F.col("split") == queries).select("channel", F.col("sample_id").alias("query_id"), "values")
    r = rows.filter("split = 'train'").select("channel", F.col("sample_id").alias("reference_id"), "label", "values")
    return q, r, rows


def neighbours(t, k, queries="test"):
    q, r, _ = sides(t, queries)
    return sim.nearest_references(q, r, ["channel"], k, metric="euclidean")


@query("J7_query_reference_blocks", f"""SELECT channel, query_id, reference_id, reference_label, {q6('distance')} AS distance, rank::INTEGER AS rank FROM ({_ranked(4)}) WHERE rank <= 3""")
def _(t):
    return neighbours(t, 3).filter("rank <= 3").withColumn("distance", r6(F.col("distance")))


@query("W8_top_k_neighbours", f"""SELECT channel, query_id, max(distance) FILTER (rank = 5) AS d5, count(*) AS n FROM (SELECT channel, query_id, {q6('distance')} AS distance, rank FROM ({_ranked(4)}) WHERE rank <= 5) GROUP BY 1, 2""")
def _(t):
    rows = neighbours(t, 5).filter("rank <= 5")
    return rows.groupBy("channel", "query_id").agg(r6(F.max(F.when(F.col("rank") == 5, F.col("distance")))).alias("d5"), F.count(F.lit(1)).alias("n"))


def _knn_sql(k, queries=4):
    return f"""SELECT channel, query_id, sum(reference_label / distance) FILTER (rank <= {k}) / sum(1 / distance) FILTER (rank <= {k}) AS probability,
      min(distance) FILTER (reference_label = 0) AS nearest_negative, min(distance) FILTER (reference_label = 1) AS nearest_positive, arg_min(reference_id, rank) AS nearest_reference
      FROM ({_ranked(queries)}) GROUP BY 1, 2"""


@query("D6_inverse_distance_knn", f"""SELECT channel, query_id, {q6('probability')} AS probability, (probability >= 0.5)::INTEGER AS prediction, {q6('nearest_negative')} AS nearest_negative, {q6('nearest_positive')} AS nearest_positive, nearest_reference FROM ({_knn_sql(5)})""")
def _(t):
    out = sim.knn_inverse_distance(neighbours(t, 5), ["channel"], 5)
    return out.select("channel", "query_id", r6(F.col("probability")).alias("probability"), "prediction", r6(F.col("nearest_negative")).alias("nearest_negative"), r6(F.col("nearest_positive")).alias("nearest_positive"), "nearest_reference")


_LAB = f"SELECT DISTINCT sample_id AS query_id, label FROM ({GRID})"
_VAL = " UNION ALL ".join(f"SELECT channel, {k} AS k, label, (probability >= 0.5)::INTEGER AS prediction FROM ({_knn_sql(k, 3)}) JOIN ({_LAB}) USING (query_id)" for k in (1, 3, 5))


@query("D7_neighbour_selection", f"""SELECT channel, 1.0::DOUBLE AS "window", k::INTEGER AS k, {q6('m')} AS macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(m, 12) DESC, k) AS rn FROM (SELECT channel, k, {SQL['macro_f1']} AS m FROM ({cells_sql(_VAL, 'channel, k')}))) WHERE rn = 1""")
def _(t):
    _, _, rows = sides(t, "validation")
    near = neighbours(t, 5, "validation")
    truth = rows.select("channel", F.col("sample_id").alias("query_id"), "label")
    tried = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5)]))).withColumn("window", F.lit(1.0))
    scored = sim.knn_inverse_distance(tried, ["channel", "window", "k"], F.col("k"))
    out = sim.select_neighbour_settings(scored.join(truth, ["channel", "query_id"]), ["channel"])
    return out.withColumn("macro_f1", r6(F.col("macro_f1")))


def knn_predictions(t):
    _, _, rows = sides(t, "test")
    truth = rows.select("channel", F.col("sample_id").alias("query_id"), "label")
    # read for each summary, so it is searched once
    return cut_lineage(sim.knn_inverse_distance(neighbours(t, 5), ["channel"], 5).join(truth, ["channel", "query_id"]))


_KP = f"SELECT *, (probability >= 0.5)::INTEGER AS prediction FROM ({_knn_sql(5)}) JOIN ({_LAB}) USING (query_id)"


@query("W10_example_rows", f"""SELECT channel, category, query_id, {q6('probability')} AS probability FROM (SELECT *, row_number() OVER (PARTITION BY channel, category ORDER BY abs(probability - 0.5) DESC, query_id) AS rn FROM (
  SELECT *, CASE WHEN prediction = label AND label = 1 THEN 'correct_negation' WHEN prediction = label THEN 'correct_control' ELSE 'high_confidence_error' END AS category FROM ({_KP}))) WHERE rn = 1""")
def _(t):
    out = sim.example_rows(knn_predictions(t), ["channel"])
    return out.select("channel", "category", "query_id", r6(F.col("probability")).alias("probability"))


@query("A25_separability_summary", f"""SELECT 'c' || channel AS modality, n, {q6('n / (SELECT count(DISTINCT sample_id) FROM (' + GRID + '))::DOUBLE')} AS coverage, {q6('macro_f1')} AS macro_f1, {q6('ms')} AS mean_same_class, {q6('md')} AS mean_different_class, {q6('mm')} AS mean_margin,
  1::BIGINT AS complete_folds, '1.0/5/1' AS settings, (row_number() OVER (ORDER BY macro_f1 DESC, channel))::INTEGER AS rank FROM (SELECT channel, count(*) AS n, avg(CASE WHEN label = 1 THEN nearest_positive ELSE nearest_negative END) AS ms,
  avg(CASE WHEN label = 1 THEN nearest_negative ELSE nearest_positive END) AS md, avg(nearest_negative - nearest_positive) AS mm FROM ({_KP}) GROUP BY 1) JOIN (SELECT channel, {SQL['macro_f1']} AS macro_f1 FROM ({cells_sql(_KP, 'channel')})) USING (channel)""")
def _(t):
    p = knn_predictions(t).withColumn("modality", F.concat(F.lit("c"), F.col("channel").cast("string")))
    folds = p.select("modality").distinct().select("modality", F.lit("complete").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(1.0).alias("window"), F.lit(5).alias("k"))
    out = sim.separability_summary(folds, p, t.read("embeddings").count())
    text = F.concat_ws(";", F.transform("settings", lambda s: F.concat_ws("/", s["window"].cast("string"), s["k"].cast("string"), s["c"].cast("string"))))
    return out.select("modality", "n", *[r6(F.col(c)).alias(c) for c in ("coverage", "macro_f1", "mean_same_class", "mean_different_class", "mean_margin")], "complete_folds", text.alias("settings"), "rank")


_OBS = f"SELECT sample_id, channel, any_value(label) AS label, max(CASE WHEN frame = sample_id % 16 THEN present END) AS observed FROM ({PGRID}) GROUP BY 1, 2"


@query("A24_presence_baseline", f"""SELECT q.sample_id, q.channel, {q6('coalesce(r.rate, b.rate)')} AS probability, (coalesce(r.rate, b.rate) >= 0.5)::INTEGER AS prediction FROM (SELECT * FROM ({_OBS}) WHERE {_FOLD} = 4) q
  LEFT JOIN (SELECT channel, observed, avg(label) AS rate FROM ({_OBS}) WHERE {_FOLD} <> 4 GROUP BY 1, 2) r ON r.channel = q.channel AND r.observed = q.observed JOIN (SELECT channel, avg(label) AS rate FROM ({_OBS}) WHERE {_FOLD} <> 4 GROUP BY 1) b ON b.channel = q.channel""")
def _(t):
    rows = traces16(t).withColumn("split", split_of(t)).withColumn("observed", F.get("present", (F.col("sample_id") % 16).cast("int")))
    rows = rows.select("sample_id", "channel", "label", "observed", "split")
    out = sim.presence_baseline(rows.filter("split <> 'test'"), rows.filter("split = 'test'"), ["channel"])
    return out.select("sample_id", "channel", r6(F.col("probability")).alias("probability"), "prediction")


@query("J11_attribution_by_modality", f"""SELECT k.channel, {q6('macro_f1')} AS dtw_macro_f1, {q6('r')} AS best_r, n FROM (SELECT channel, {SQL['macro_f1']} AS macro_f1 FROM ({cells_sql(_KP, 'channel')})) k
  JOIN (SELECT channel, max(abs(corr)) AS r FROM (SELECT channel, frame, corr(value, label) AS corr FROM ({GRID}) GROUP BY 1, 2) GROUP BY 1) s USING (channel) JOIN (SELECT channel, sum(present)::BIGINT AS n FROM ({PGRID}) GROUP BY 1) p USING (channel)""")
def _(t):
    p = knn_predictions(t).withColumn("modality", F.col("channel"))
    made = sim.metric_columns(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])["macro_f1"]
    a = sim.confusion(p, ["channel"]).select("channel", r6(made).alias("dtw_macro_f1"))
    b = sim.point_biserial(t.grid, ["channel"]).select("channel", r6(F.abs("r")).alias("best_r"))
    n = t.pgrid.groupBy("channel").agg(F.sum("present").alias("n"))
    return a.join(b, "channel").join(n, "channel")


@query("A29_point_biserial_scan", f"""SELECT channel, frame, {q6('r')} AS r FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(abs(r), 12) DESC, frame) AS rn FROM (SELECT channel, frame, corr(value, label) AS r FROM ({GRID}) GROUP BY 1, 2)) WHERE rn = 1""")
def _(t):
    return sim.point_biserial(t.grid, ["channel"]).withColumn("r", r6(F.col("r")))


@query("A30_modality_best_channel", f"""SELECT modality, name, frame, {q6('r')} AS r FROM (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY round(abs(r), 12) DESC, channel, frame) AS rn FROM (
  SELECT CASE WHEN channel < 2 THEN 'left' ELSE 'right' END AS modality, channel, 'ch' || channel AS name, frame, corr(value, label) AS r FROM ({GRID}) GROUP BY channel, frame)) WHERE rn = 1""")
def _(t):
    scan = sim.point_biserial(t.grid, ["channel"]).withColumn("channel_ix", F.col("channel")).withColumn(
        "modality", F.when(F.col("channel") < 2, "left").otherwise("right")).withColumn("name", F.concat(F.lit("ch"), F.col("channel").cast("string")))
    return sim.best_channel_per_modality(scan, "modality", "name").withColumn("r", r6(F.col("r")))


@query("D1_dtw_distance")
def _(t):
    rows = traces16(t)
    first = rows.select("channel", F.get("values", F.lit(0)).alias("level"), "sample_id", "values")
    return first.select("sample_id", "channel", sim.dtw_distance("values", F.reverse("values")).alias("distance"))


@query("D2_banded_dtw_neighbours")
def _(t):
    rows = sim.trajectories(traces16(t), ["sample_id", "label", "channel"]).withColumn("split", split_of(t))
    q = rows.filter("split = 'test'").select("channel", F.col("sample_id").alias("query_id"), "values")
    r = rows.filter("split = 'train'").select("channel", F.col("sample_id").alias("reference_id"), "label", "values")
    return sim.nearest_references(q, r, ["channel"], 3, metric="dtw", window=0.2)


@query("D3_class_mean_accuracy")
def _(t):
    return sim.class_mean_accuracy(traces16(t), ["channel"])


@query("D4_channel_scan")
def _(t):
    return sim.scan_channels(traces16(t), "channel", 2)


# fold f tests on hash f, validates on the next one and trains on the other three
def rotated_folds(t):
    place = F.pmod(draw("split", F.col("sample_id")) % 5 - F.col("fold"), F.lit(5))
    folds = t.read("embeddings").select(F.col("vec_id").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    return folds.withColumn("split", F.when(place == 0, "test").when(place == 1, "validation").otherwise("train"))


def modality_trajectories(t):
    """Two channels on each side and all four as one modality."""
    modality = F.explode(F.when(F.col("channel") < 2, F.array(F.lit("left"), F.lit("all"))).otherwise(F.array(F.lit("right"), F.lit("all"))))
    return sep.vector_trajectories(traces16(t).withColumn("modality", modality), ["sample_id", "label", "modality"])


@query("D5_scaled_pca")
def _(t):
    rows = modality_trajectories(t).filter("modality = 'all'")
    made = sep.project_components(rows, sep.fit_components(rows, ["modality"]), ["modality"])
    return made.select("sample_id", F.posexplode(F.arrays_zip("time_ix", "values")).alias("p", "x")).select("sample_id", F.col("x.time_ix").alias("frame"), F.col("x.values").alias("components"))


_SEEN = f"""SELECT sample_id, frame, CASE WHEN channel < 2 THEN 'left' ELSE 'right' END AS modality, max(value) FILTER (channel % 2 = 0) AS a, max(value) FILTER (channel % 2 = 1) AS b FROM ({PGRID}) GROUP BY 1, 2, 3 HAVING min(present) = 1"""
_MODALITY_FRAMES = f"SELECT * FROM ({_SEEN}) QUALIFY count(*) OVER (PARTITION BY sample_id, modality) >= 2"


# two scaled channels have the main directions (1, 1) and (1, -1): shares (1 + r) / 2 and (1 - r) / 2
@query("D5_keyed_components", f"""SELECT fold, modality, count(*) AS n, {q6('avg(a)')} AS mean_a, {q6('avg(b)')} AS mean_b, {q6('stddev_pop(a)')} AS scale_a, {q6('stddev_pop(b)')} AS scale_b,
  {q6('(1 + abs(corr(a, b))) / 2')} AS explained, {q6('sign(corr(a, b)) / 2')} AS weights FROM ({_MODALITY_FRAMES}), (SELECT unnest(range(0, 5)) AS fold) WHERE ({_FOLD} - fold + 5) % 5 > 1 GROUP BY 1, 2""")
def _(t):
    rows = modality_trajectories(t).filter("modality <> 'all'").join(rotated_folds(t).filter("split = 'train'"), "sample_id")
    out = sep.fit_components(rows, ["fold", "modality"], variance=0.5)
    both = lambda c: [r6(F.get(c, F.lit(i))).alias(f"{c}_{x}") for i, x in enumerate("ab")]
    weights = F.get("components", F.lit(0))
    return out.select(F.col("fold").cast("bigint").alias("fold"), "modality", "n", *both("mean"), *both("scale"), r6(F.col("explained")).alias("explained"), r6(weights[0] * weights[1]).alias("weights"))


@query("D8_fold_separability")
def _(t):
    return sep.fold_separability(modality_trajectories(t), rotated_folds(t), ["modality"])[0]


@query("D8_fold_predictions")
def _(t):
    return sep.fold_separability(modality_trajectories(t), rotated_folds(t), ["modality"])[1]


# -- spans: cue words as windows of +-6 h on 32 frames ------------------------------------------------

START, STEP, FRAMES = -21_600_000.0, 1_350_000.0, 32
ASSUMED = 1_500_000.0
_TOKENS = f"""SELECT l.negation_id AS sample_id, c.t AS anchor_ms, CASE WHEN c.k % 4 <> 0 THEN c.k * 60000.0::DOUBLE END AS measured_ms, CASE WHEN field = 'cue_tokens' THEN 'CUE' ELSE 'SCOPE' END AS span_type, w.t AS onset_ms
  FROM ({LINKS}) l JOIN ({CUES}) c ON c.event_id = l.negation_id JOIN ({EV}) w ON w.event_id = l.word_id"""
_SPANS = f"""SELECT DISTINCT sample_id, anchor_ms, span_type, onset_ms AS start_ms, onset_ms + CASE WHEN measured_ms IS NOT NULL AND onset_ms = anchor_ms THEN measured_ms ELSE {ASSUMED}::DOUBLE END AS end_ms,
  measured_ms IS NOT NULL AND onset_ms = anchor_ms AS measured FROM ({_TOKENS})"""


def spans(t):
    cues = t.cues.select(F.col("event_id").alias("sample_id"), F.col("t").alias("anchor_ms"), F.when(F.col("k") % 4 != 0, F.col("k") * F.lit(60000.0)).alias("measured_ms"))
    tokens = links(t).withColumnRenamed("negation_id", "sample_id").join(cues, "sample_id").join(
        t.ev.select(F.col("event_id").alias("word_id"), F.col("t").alias("onset_ms")), "word_id")
    kind = F.when(F.col("field") == "cue_tokens", "CUE").otherwise("SCOPE")
    return sp.token_spans(tokens.withColumn("span_type", kind), F.lit(ASSUMED))


@query("D9_token_spans", f"SELECT sample_id, span_type, start_ms, end_ms, measured FROM ({_SPANS})")
def _(t):
    return spans(t).drop("anchor_ms")


_CELLS = f"""SELECT sample_id, f, arg_max(CASE WHEN span_type = 'CUE' THEN 1 ELSE 3 END + CASE WHEN f = f0 THEN 0 ELSE 1 END, CASE WHEN span_type = 'CUE' THEN 1e15 ELSE 0 END + start_ms) AS tag FROM (
  SELECT s.*, f, min(f) OVER (PARTITION BY sample_id, span_type, start_ms) AS f0 FROM ({_SPANS}) s, (SELECT unnest(range(0, 32)) AS f) WHERE anchor_ms + {START}::DOUBLE + f * {STEP}::DOUBLE >= start_ms AND anchor_ms + {START}::DOUBLE + f * {STEP}::DOUBLE < end_ms) GROUP BY 1, 2"""
_TAGS = f"SELECT c.event_id AS sample_id, g.f AS frame, coalesce(x.tag, 0)::INTEGER AS tag FROM ({CUES}) c, (SELECT unnest(range(0, 32)) AS f) g LEFT JOIN ({_CELLS}) x ON x.sample_id = c.event_id AND x.f = g.f"


def tags(t):
    return sp.frame_tags(spans(t), t.cues.select(F.col("event_id").alias("sample_id")), start_ms=START, step_ms=STEP, frames=FRAMES)


@query("D10_frame_tags", f"SELECT sample_id, frame, tag FROM ({_TAGS})")
def _(t):
    return tags(t).select("sample_id", F.posexplode("tags").alias("frame", "tag")).withColumn("frame", F.col("frame").cast("bigint"))


@query("D11_label_statistics", f"""SELECT windows, frames, labeled_frames, windows_with_spans, spans, measured, assumed FROM (SELECT count(DISTINCT sample_id) AS windows, count(*) AS frames, sum((tag > 0)::INTEGER)::BIGINT AS labeled_frames FROM ({_TAGS})),
  (SELECT count(DISTINCT sample_id) AS windows_with_spans, count(*) AS spans, sum(measured::INTEGER)::BIGINT AS measured, sum((NOT measured)::INTEGER)::BIGINT AS assumed FROM ({_SPANS}))""")
def _(t):
    return sp.label_statistics(tags(t), spans(t), [])


# predicted tags: some frames fall out, some inside tags lose their begin
_PRED = f"""SELECT sample_id, frame, CASE WHEN h < 8 THEN 0 WHEN h < 14 AND tag IN (1, 3) THEN tag + 1 WHEN h < 17 AND tag = 0 THEN 4 ELSE tag END AS tag FROM (SELECT *, {h32("'tag:' || sample_id || ':' || frame")} % 100 AS h FROM ({_TAGS}))"""


def predicted(t, rows=None):
    def change(x, f):
        h = draw("tag", F.col("sample_id"), f) % 100
        return let(h, lambda h: F.when(h < 8, 0).when((h < 14) & x.isin(1, 3), x + 1).when((h < 17) & (x == 0), 4).otherwise(x))
    return (tags(t) if rows is None else rows).withColumn("tags", F.transform("tags", change))


def decoded(t):
    """(predicted, reference) spans; the tags of both, and the passes that count links, are made once.

    Tags are small in bytes and long in work, so the partitions are not to be coalesced by size.
    """
    rows = cut_lineage(tags(t).repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "sample_id"))
    return sp.decode_spans(cut_lineage(predicted(t, rows))), sp.decode_spans(rows)


def _decode_sql(source):
    return f"""SELECT sample_id, min(kind) AS span_type, min(frame) AS start_frame, max(frame) + 1 AS stop_frame FROM (
      SELECT *, sum(o) OVER (PARTITION BY sample_id ORDER BY frame) AS run FROM (SELECT *, CASE WHEN kind IS NOT NULL AND (tag IN (1, 3) OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY sample_id ORDER BY frame)) THEN 1 ELSE 0 END AS o
      FROM (SELECT *, CASE WHEN tag IN (1, 2) THEN 'CUE' WHEN tag IN (3, 4) THEN 'SCOPE' END AS kind FROM ({source})))) WHERE kind IS NOT NULL GROUP BY sample_id, run"""


@query("W7_decode_spans", _decode_sql(_PRED))
def _(t):
    out = sp.decode_spans(predicted(t))
    return out.select("sample_id", "span_type", F.col("start_frame").cast("bigint").alias("start_frame"), F.col("stop_frame").cast("bigint").alias("stop_frame"))


def _score_sql(condition):
    hits = f"SELECT p.span_type FROM ({_decode_sql(_PRED)}) p JOIN ({_decode_sql(_TAGS)}) r ON p.sample_id = r.sample_id AND p.span_type = r.span_type AND {condition}"
    return f"""SELECT span_type, tp::BIGINT AS tp, (predicted - tp)::BIGINT AS fp, (reference - tp)::BIGINT AS fn, {q6('tp / predicted::DOUBLE')} AS precision, {q6('tp / reference::DOUBLE')} AS recall, {q6('2 * tp / (predicted + reference)::DOUBLE')} AS f1 FROM (
      SELECT span_type, sum(h) AS tp, sum(p) AS predicted, sum(r) AS reference FROM (SELECT unnest([span_type, 'micro']) AS span_type, h, p, r FROM (
      SELECT span_type, 1 AS h, 0 AS p, 0 AS r FROM ({hits}) UNION ALL SELECT span_type, 0, 1, 0 FROM ({_decode_sql(_PRED)}) UNION ALL SELECT span_type, 0, 0, 1 FROM ({_decode_sql(_TAGS)}))) GROUP BY 1)"""


def _rounded(out):
    return out.select("span_type", "tp", "fp", "fn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("D12_score_exact", _score_sql("p.start_frame = r.start_frame AND p.stop_frame = r.stop_frame"))
def _(t):
    return _rounded(sp.score_exact(*decoded(t)))


@query("D12_score_overlap_high", _score_sql("""least(p.stop_frame, r.stop_frame) > greatest(p.start_frame, r.start_frame)
  AND (least(p.stop_frame, r.stop_frame) - greatest(p.start_frame, r.start_frame)) / (greatest(p.stop_frame, r.stop_frame) - least(p.start_frame, r.start_frame))::DOUBLE >= 0.6"""))
def _(t):
    return _rounded(sp.score_overlap(*decoded(t), 0.6))


@query("D12_score_overlap_low")
def _(t):
    return _rounded(sp.score_overlap(*decoded(t), 0.3))


@query("A31_frame_metrics", f"""SELECT {', '.join(f'{q6(SQL[m])} AS {m}' for m in ('precision', 'recall', 'f1', 'balanced_accuracy'))}, tp + fn AS positive_support, (SELECT {q6('avg((a.tag = b.tag)::INTEGER)')} FROM ({_PRED}) a JOIN ({_TAGS}) b USING (sample_id, frame)) AS tag_accuracy
  FROM ({cells_sql(f"SELECT (b.tag > 0)::INTEGER AS label, (a.tag > 0)::INTEGER AS prediction FROM ({_PRED}) a JOIN ({_TAGS}) b USING (sample_id, frame)", '')})""")
def _(t):
    both = predicted(t).select("sample_id", F.col("tags").alias("predicted")).join(tags(t).select("sample_id", F.col("tags").alias("reference")), "sample_id")
    out = sp.frame_metrics(both, [])
    return out.select(*[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "balanced_accuracy", "tag_accuracy")], "positive_support")


_WIN = f"SELECT 1 AS g, label, max(value) AS probability, (max(value) >= 0.25)::INTEGER AS prediction FROM ({GRID}) GROUP BY sample_id, label"


@query("A32_window_metrics", f"SELECT {q6(SQL['accuracy'])} AS window_accuracy, {q6(SQL['f1'])} AS window_f1, {q6('roc_auc')} AS window_roc_auc FROM ({cells_sql(_WIN, '')}), ({ranking_sql(_WIN, 'g')})")
def _(t):
    rows = t.read("embeddings").select((F.col("label") >= 5).cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    out = sp.window_metrics(rows, [], "p", 0.25)
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


def emissions(t):
    """Five tag scores per frame, a frame for every value of the vector: the five values from five times its place on, around the end."""
    n = F.size("embedding")
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda f: F.array(
        *[F.get("embedding", F.pmod(f * 5 + tag, n)).cast("double") * 10 for tag in range(5)]))
    return t.read("embeddings").select(F.col("vec_id").alias("sample_id"), frames.alias("e"))


TRANSITIONS, EDGE = np.full((5, 5), -0.5) + np.eye(5), np.zeros(5)


@query("D13_viterbi")
def _(t):
    out = emissions(t).select("sample_id", sp.viterbi(F.col("e"), TRANSITIONS, EDGE, EDGE).alias("tags"))
    return out.withColumn("tags", F.concat_ws(",", F.transform("tags", lambda x: x.cast("string"))))


@query("D14_positive_marginal")
def _(t):
    out = emissions(t).select("sample_id", sp.positive_marginal(F.col("e"), TRANSITIONS, EDGE, EDGE).alias("p"))
    return out.select("sample_id", F.posexplode("p").alias("frame", "probability"))
