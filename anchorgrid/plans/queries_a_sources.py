"""Scans, sinks, scalar functions and set operations on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorgrid.functions import channels as ch, naming, values as v
from anchorgrid.functions.hashing import draw
from anchorgrid.operators import checks
from anchorgrid.plans.registry import query
from anchorgrid.plans.roles import (
    CUES, EV, GRID, LINKS, PREDS, SCOPES, WORDS, h32, links, q6, r6, words,
)
from anchorgrid.session import scratch
from anchorgrid.sources import files, words as src

for _target, _fields in src.TARGET_FIELDS.items():
    query(
        f"S1_scan_words_{_target}",
        f"""SELECT * FROM ({WORDS}) WHERE word_id IN (SELECT word_id FROM ({LINKS})
        WHERE field IN ({','.join(f"'{f}'" for f in _fields)}))""",
    )(lambda t, target=_target: src.scan_words(words(t), links(t), target))


@query("S2_scan_non_negation",
       f"SELECT * FROM ({WORDS}) WHERE word_id NOT IN (SELECT word_id FROM ({LINKS}))")
def _(t):
    return src.scan_non_negation(words(t), links(t))


@query("S3_scan_turn_words", f"SELECT word_id, experiment, player, text, time_ms FROM ({WORDS})")
def _(t):
    return src.scan_turn_words(words(t))


@query("S4_modality_scan", f"""SELECT event_id, t AS time_ms, user_id, event_type, value FROM ({EV})
  WHERE t >= 1704412800000 AND t < 1705622400000""")
def _(t):
    kinds = ("click", "error", "purchase", "signup", "view")
    flat = t.ev.select("event_id", F.col("t").alias("time_ms"), "user_id", "event_type", "value")
    tables = {k: flat.filter(F.col("event_type") == k).drop("event_type") for k in kinds}
    return src.modality_scan(tables, F.lit(1704412800000), F.lit(1705622400000))


def _fold_table(t):
    split = F.element_at(F.array(F.lit("train"), F.lit("train"), F.lit("train"), F.lit("validation"), F.lit("test")),
                         (F.col("fold") + 1).cast("int"))
    return t.preds.filter("model = 'a'").select(
        "sample_id", "group_id", "label", F.col("fold").cast("int").alias("fold"), split.alias("split"))


_FOLD_SQL = f"""SELECT sample_id, group_id, label, fold::INTEGER AS fold,
  ['train','train','train','validation','test'][fold + 1] AS split FROM ({PREDS}) WHERE model = 'a'"""


@query("S5_load_fold", f"SELECT split, count(*) AS n, sum(label)::BIGINT AS positives FROM ({_FOLD_SQL}) GROUP BY 1")
def _(t):
    folder = scratch(t.spark, "fold")
    files.write_folds(_fold_table(t), folder)
    fold = files.load_fold(t.spark, folder, {"sample_id", "group_id", "label"})
    return fold.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


@query("S6_load_fold_dataset", _FOLD_SQL)
def _(t):
    folder = scratch(t.spark, "dataset")
    table = _fold_table(t)
    for name in ("train", "validation", "test"):
        rows = table.filter(F.col("split") == name).drop("split")
        rows.write.partitionBy("fold").parquet(f"{folder}/data/{name}")
    return files.load_fold_dataset(t.spark, folder, {"sample_id", "label"}).select("sample_id", "group_id", "label", "fold", "split")


@query("S11_fold_sink", f"SELECT fold, split, count(*) AS n FROM ({_FOLD_SQL}) GROUP BY 1, 2")
def _(t):
    folder = scratch(t.spark, "fold")
    table = _fold_table(t)
    files.write_folds(table, folder)
    files.write_folds(table.filter("fold = 0"), folder)  # replaces that partition only
    return t.spark.read.parquet(folder).groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"))


_PRED_ROWS = ["model", "fold", "sample_id", "group_id", "label", "logit", "probability", "threshold", "prediction"]


@query("S7_read_predictions", f"""SELECT model, fold::INTEGER AS fold, sample_id::VARCHAR AS sample_id, group_id,
  label, probability, threshold, prediction FROM ({PREDS})""")
def _(t):
    folder = scratch(t.spark, "jsonl")
    files.write_json_lines(t.preds.withColumn("logit", v.logit(F.col("probability"))).select(*_PRED_ROWS), folder)
    return files.read_predictions(t.spark, folder).drop("logit")


@query("S14_json_lines_sink", f"""SELECT model, sample_id, {q6('ln(probability / (1 - probability))')} AS logit
  FROM ({PREDS})""")
def _(t):
    folder = scratch(t.spark, "jsonl")
    files.write_json_lines(t.preds.withColumn("logit", v.logit(F.col("probability"))), folder)
    back = t.spark.read.schema("model string, sample_id bigint, logit double").json(folder)
    return back.withColumn("logit", r6(F.col("logit")))


# one summary file per (model, family) with fold means of the predictions
_FAMILY_SQL = "'tgt-cue_bal-05_src-' || lang || '_wL-500_wR-m' || (100 + 10 * fold) || '_spl-5'"


@query("S8_read_summaries", f"""SELECT model, 'target-cue_window-' || 100 * (1 + fold) AS family, CASE WHEN fold % 2 = 0 THEN 'pooled' END AS variant, 7::BIGINT AS seed,
  metric, {q6("CASE metric WHEN 'accuracy' THEN accuracy ELSE share END")} AS mean, n::INTEGER AS num_valid_folds
  FROM (SELECT model, fold, avg((label = prediction)::INTEGER) AS accuracy, avg(prediction) AS share, count(DISTINCT group_id) AS n FROM ({PREDS}) GROUP BY model, fold), (VALUES ('accuracy'), ('positive_share')) m(metric)""")
def _(t):
    per = t.preds.groupBy("model", "fold").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"), F.avg("prediction").alias("share"),
        F.countDistinct("group_id").cast("int").alias("num_valid_folds"))
    made = lambda c: F.struct(F.col(c).alias("mean"), "num_valid_folds")
    metric = F.create_map(F.lit("accuracy"), made("accuracy"), F.lit("positive_share"), made("share"))
    summary = F.struct(
        F.struct(metric.alias("validation"), metric.alias("test")).alias("fold_statistics"),
        F.create_map(F.lit("0"), F.struct(F.lit("r").alias("run_name"))).alias("folds"))
    runs = per.select(
        "model", F.concat(F.lit("target-cue_window-"), (100 * (1 + F.col("fold"))).cast("string")).alias("family"),
        F.when(F.col("fold") % 2 == 0, "pooled").alias("variant"), F.lit(7).alias("seed"), summary.alias("summary"))
    folder = scratch(t.spark, "summaries")
    files.write_summaries(runs, folder)
    return files.summary_metrics(files.read_summaries(t.spark, folder)).withColumn("mean", r6(F.col("mean")))


_TOKENS = """SELECT conv_id, turn, role, i - 1 AS token, conv_id || '-' || turn || '-' || (i - 1) AS word_id, word
  FROM (SELECT conv_id, turn, role, unnest(str_split(text, ' ')) AS word,
    unnest(range(1, len(str_split(text, ' ')) + 1)) AS i FROM conversations)"""


def tokens(t):
    conv = t.read("conversations")
    return conv.select(
        "conv_id", "turn", "role", F.posexplode(F.split("text", " ")).alias("pos", "word")
    ).select(
        "conv_id", "turn", "role", F.col("pos").cast("bigint").alias("token"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("pos").cast("string")).alias("word_id"),
        "word")


@query("S9_read_transcripts", f"""SELECT audio, array_to_string(list(word ORDER BY turn, token), '|') AS tokens,
  array_to_string(list(word_id ORDER BY turn, token), '|') AS word_ids, count(*)::INTEGER AS n
  FROM (SELECT *, conv_id AS audio FROM ({_TOKENS})) GROUP BY audio""")
def _(t):
    tok = tokens(t).select(
        F.col("conv_id").alias("audio"), (F.col("turn") * 1000000 + F.col("token")).alias("time_ms"), "word_id",
        F.col("word").alias("text"))
    return src.read_transcripts(tok).select(
        "audio", F.concat_ws("|", "tokens").alias("tokens"), F.concat_ws("|", "word_ids").alias("word_ids"),
        F.size("tokens").alias("n"))


@query("S10_negation_links", f"""SELECT conv_id || '-' || turn AS negation_id,
  CASE WHEN word LIKE 'n%' THEN 'cue_tokens' ELSE 'scope_tokens' END AS field, word_id
  FROM ({_TOKENS}) WHERE word LIKE 'n%' OR word LIKE 's%'""")
def _(t):
    tok = tokens(t).select(F.col("conv_id").alias("audio"), F.col("turn").alias("sentence"), "token", "word_id", "word")
    field = F.when(F.col("word").startswith("n"), "cue_tokens").when(F.col("word").startswith("s"), "scope_tokens")
    coordinates = tok.select(
        F.concat_ws("-", F.col("audio").cast("string"), F.col("sentence").cast("string")).alias("negation_id"),
        field.alias("field"), "audio", "sentence", "token").filter("field is not null")
    return src.coordinates_to_links(coordinates, tok).select("negation_id", "field", "word_id")


@query("S12_metrics_csv_sink", f"""SELECT fold::INTEGER AS fold, {q6('avg((label = prediction)::INTEGER)')} AS accuracy
  FROM ({PREDS}) WHERE model = 'a' GROUP BY fold""")
def _(t):
    folder = scratch(t.spark, "csv")
    per = t.preds.filter("model = 'a'").groupBy("fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"))
    files.write_csv(per, folder)
    back = t.spark.read.option("header", True).schema("fold int, accuracy double").csv(folder)
    return back.withColumn("accuracy", r6(F.col("accuracy")))


@query("S13_union_of_columns", f"""SELECT event_type, max_value, n, lang, pair FROM (
  SELECT event_type, CASE WHEN event_type = 'view' THEN NULL ELSE round(max(value), 6) END AS max_value,
    count(*) AS n, NULL AS lang, NULL AS pair FROM events GROUP BY event_type
  UNION ALL SELECT NULL, NULL, count(*), lang, '[' || min(doc_id) || ',' || max(doc_id) || ']' FROM documents GROUP BY lang)""")
def _(t):
    a = t.read("events").groupBy("event_type").agg(
        F.when(F.col("event_type") == "view", F.lit(float("nan"))).otherwise(F.round(F.max("value"), 6)).alias("max_value"),
        F.count(F.lit(1)).alias("n"))
    b = t.read("documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.array(F.min("doc_id"), F.max("doc_id")).alias("pair"))
    return files.union_tables([a, b])


# -- scalar functions ------------------------------------------------------------------

@query("F2_actor_relation", f"""SELECT event_id, CASE WHEN k < 3 OR user_id % 7 = 0 THEN 2
  WHEN user_id % 4 = k % 4 THEN 0 ELSE 1 END AS relation FROM ({EV})""")
def _(t):
    player = F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 4).cast("string")
    anchor = F.when(F.col("k") >= 3, F.col("k") % 4).otherwise(F.lit(None)).cast("string")
    return t.ev.select("event_id", v.actor_relation(player, anchor).alias("relation"))


@query("F3_actor_scope", f"""SELECT scope, count(*) AS n, sum(k)::BIGINT AS total FROM ({EV}), (VALUES ('anchor'),('other'),('all')) s(scope)
  WHERE scope = 'all' OR (scope = 'anchor' AND user_id % 4 = k % 4) OR (scope = 'other' AND user_id % 4 <> k % 4) GROUP BY scope""")
def _(t):
    relation = v.actor_relation(F.col("user_id") % 4, F.col("k") % 4)
    out = None
    for scope in v.SCOPE_OF_SOURCE.values():
        part = t.ev.filter(v.in_actor_scope(relation, scope)).agg(
            F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")).withColumn("scope", F.lit(scope))
        out = part if out is None else out.unionByName(part)
    return out


@query("F4_heartbeat_filter", f"""SELECT event_id, event_type, k FROM ({EV})
  WHERE NOT (event_type IN ('click', 'view')) OR k >= 26""")
def _(t):
    finger = F.col("event_type").isin("click", "view")
    bones = F.array_repeat(F.lit(0.0), F.col("k").cast("int"))
    return t.ev.filter(~finger | (F.size(bones) >= 26)).select("event_id", "event_type", "k")


@query("F5_modality_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'signup')")
def _(t):
    return t.read("events").filter(F.col("event_type").isin("click", "signup")).select("event_id", "event_type")


# numbers, words, and what casts to a double without being finite
@query("F6_finite_cast", """SELECT doc_id, n, CASE WHEN isfinite(try_cast(w AS DOUBLE)) THEN try_cast(w AS DOUBLE) ELSE 0.0 END AS x FROM (
  SELECT doc_id, unnest(range(0, 6)) AS n, unnest([split_part(text, ' ', 1 + CAST(n_chars % 9 AS INTEGER)), 'nan', 'Infinity', '-inf', n_chars || '.5e3', '-' || n_chars || '.25']) AS w FROM documents)""")
def _(t):
    word = F.split_part(F.col("text"), F.lit(" "), (1 + F.col("n_chars") % 9).cast("int"))
    size = F.col("n_chars").cast("string")
    made = F.array(word, F.lit("nan"), F.lit("Infinity"), F.lit("-inf"), F.concat(size, F.lit(".5e3")), F.concat(F.lit("-"), size, F.lit(".25")))
    docs = t.read("documents").select("doc_id", F.posexplode(made).alias("n", "w"))
    return docs.select("doc_id", F.col("n").cast("bigint").alias("n"), v.finite(F.col("w")).alias("x"))


@query("F7_fixed_array", """SELECT vec_id, i - 1 AS ix, CASE WHEN i <= 3 + vec_id % 8 THEN embedding[i]::DOUBLE ELSE 0.0 END AS x
  FROM embeddings, (SELECT unnest(range(1, 8)) AS i)""")
def _(t):
    short = F.slice("embedding", F.lit(1), (3 + F.col("vec_id") % 8).cast("int"))
    fixed = v.fixed_array(F.transform(short, lambda x: x.cast("double")), 7)
    return t.read("embeddings").select("vec_id", F.posexplode(fixed).alias("ix", "x")).withColumn("ix", F.col("ix").cast("bigint"))


@query("F8_quaternion", f"""SELECT vec_id, {q6('s * x / n')} AS x, {q6('s * y / n')} AS y, {q6('s * z / n')} AS z, {q6('s * w / n')} AS w
  FROM (SELECT *, sqrt(x*x + y*y + z*z + w*w) AS n, CASE WHEN w < 0 THEN -1.0 ELSE 1.0 END AS s FROM (
    SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings))""")
def _(t):
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    q = t.read("embeddings").select("vec_id", v.unit_quaternion(*e).alias("q"))
    return q.select("vec_id", *[r6(F.col("q")[i]).alias(a) for i, a in enumerate("xyzw")])


@query("F9_pose", f"""SELECT vec_id, px, {q6('qx / sqrt(qx*qx + qw*qw) * CASE WHEN qw < 0 THEN -1 ELSE 1 END')} AS qx FROM (
  SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN embedding[1] ELSE embedding[2] END::DOUBLE AS px,
    CASE WHEN vec_id % 2 = 0 THEN embedding[3] ELSE embedding[4] END::DOUBLE AS qx,
    CASE WHEN vec_id % 2 = 0 THEN embedding[5] ELSE embedding[6] END::DOUBLE AS qw FROM embeddings)""")
def _(t):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    zero, even = F.lit(0.0), F.col("vec_id") % 2 == 0
    place = lambda i: F.struct(e(i).alias("x"), zero.alias("y"), zero.alias("z"))
    turn = lambda i, j: F.struct(e(i).alias("x"), zero.alias("y"), zero.alias("z"), e(j).alias("w"))
    rows = t.read("embeddings").select(
        "vec_id", F.when(even, place(0)).alias("Position"), F.when(even, turn(2, 4)).alias("Orientation"),
        F.when(~even, place(1)).alias("position_"), F.when(~even, turn(3, 5)).alias("rotation_"))
    p = v.pose((F.col("Position"), F.col("Orientation")), (F.col("position_"), F.col("rotation_")))
    return rows.select("vec_id", p.alias("p")).select("vec_id", F.col("p")[0].alias("px"), r6(F.col("p")[3]).alias("qx"))


@query("F10_confidence_bits", f"""SELECT event_id, CASE WHEN b <= 1 THEN b::DOUBLE
  WHEN (b >> 23) & 255 = 255 THEN b::DOUBLE
  ELSE (CASE WHEN (b >> 31) & 1 = 1 THEN -1.0 ELSE 1.0 END) * CASE WHEN (b >> 23) & 255 = 0 THEN (b & 8388607) / 8388608.0::DOUBLE * pow(2.0, -126)
    ELSE (1 + (b & 8388607) / 8388608.0::DOUBLE) * pow(2.0, ((b >> 23) & 255) - 127) END END AS confidence
  FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN event_id % 2 ELSE {h32("'bits:' || event_id")} END AS b FROM events)""")
def _(t):
    bits = F.when(F.col("event_id") % 50 == 0, F.col("event_id") % 2).otherwise(draw("bits", F.col("event_id")))
    return t.read("events").select("event_id", v.decoded_confidence(bits).alias("confidence"))


@query("F11_bit_flags", f"""SELECT event_id, b AS bit, ((k >> b) & 1)::DOUBLE AS flag FROM ({EV}), (SELECT unnest(range(0, 8))::INTEGER AS b)""")
def _(t):
    return t.ev.select("event_id", F.posexplode(v.bit_flags(F.col("k"), 8)).alias("bit", "flag"))


@query("F12_modality_vectors", f"""SELECT event_type, ix::INTEGER AS ix, {q6('sum(x)', 4)} AS total, count(*) AS n FROM (
  SELECT event_type, unnest(range(0, len(a))) AS ix, unnest(a) AS x FROM (SELECT event_type, CASE event_type
    WHEN 'click' THEN [value, k::DOUBLE] WHEN 'view' THEN [value, (k & 1)::DOUBLE, ((k >> 1) & 1)::DOUBLE]
    ELSE [value] END AS a FROM ({EV}))) GROUP BY 1, 2""")
def _(t):
    vectors = {
        "click": F.array(v.finite(F.col("value")), v.finite(F.col("k"))),
        "view": F.concat(F.array(v.finite(F.col("value"))), v.bit_flags(F.col("k"), 2)),
    }
    from anchorgrid.operators.motion import extract
    wide = extract(t.ev, vectors, default=F.array(v.finite(F.col("value"))))
    return wide.select("event_type", F.posexplode("features").alias("ix", "x")).groupBy("event_type", "ix").agg(
        r6(F.sum("x"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query("F13_record_ids", f"""SELECT event_id, 'Word:[' || t || ', r"Player:[' || user_id || ', s\\"' || event_type || '\\"]", ' || k || ']' AS word_id,
  t AS time_ms, user_id AS player_no, event_type AS role, k AS token FROM ({EV})""")
def _(t):
    rendered = t.ev.select("event_id", naming.render_word_id(F.col("t"), F.col("user_id"), F.col("event_type"), F.col("k")).alias("word_id"))
    return rendered.select("event_id", "word_id", naming.parse_word_id(F.col("word_id")).alias("p")).select("event_id", "word_id", "p.*")


@query("F14_signed_ms", f"""SELECT event_id, CASE WHEN x < 0 THEN 'm' || (-x) ELSE x::VARCHAR END AS token, x AS back
  FROM (SELECT event_id, k * 100 - 5000 AS x FROM ({EV}))""")
def _(t):
    x = F.col("k") * 100 - 5000
    return t.ev.select("event_id", naming.encode_ms(x).alias("token")).withColumn("back", naming.decode_ms(F.col("token")))


@query("F15_window_bounds", f"SELECT event_id, 2000 - 10 * k AS start_ms, 2100 + k AS end_ms FROM ({EV})")
def _(t):
    start, end = naming.window_bounds(F.col("k") * 10 - 2000, F.col("k") + 2100)
    return t.ev.select("event_id", start.alias("start_ms"), end.alias("end_ms"))


_NAME_ARGS = f"""SELECT event_id, ['cue','scope','cueandscope'][1 + event_id % 3] AS target,
  ['speaker','listener','both'][1 + user_id % 3] AS source, k * 50 - 1000 AS l, 5000 + k AS r, 5 + k % 6 AS spl,
  ['coarse','strict','very_strict','neg'][1 + k % 4] AS anchors, ['coarse','strict','very_strict','neg'][1 + user_id % 4] AS controls FROM ({EV})"""


def _name_args(t):
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    modes = ("coarse", "strict", "very_strict", "neg")
    return t.ev.select(
        "event_id", pick(("cue", "scope", "cueandscope"), F.col("event_id") % 3).alias("target"),
        pick(("speaker", "listener", "both"), F.col("user_id") % 3).alias("source"), (F.col("k") * 50 - 1000).alias("l"),
        (5000 + F.col("k")).alias("r"), (5 + F.col("k") % 6).alias("spl"), pick(modes, F.col("k") % 4).alias("anchors"),
        pick(modes, F.col("user_id") % 4).alias("controls"))


_NAME_SQL = f"""SELECT *, 'tgt-' || target || '_bal-05_src-' || source || '_wL-' || CASE WHEN l < 0 THEN 'm' || (-l) ELSE l::VARCHAR END
  || '_wR-' || r || '_spl-' || spl || CASE WHEN anchors <> controls THEN '_ctrl-' || replace(controls, '_', '-') || '_anchors-' || replace(anchors, '_', '-')
  WHEN controls IN ('very_strict', 'neg') THEN '_ctrl-' || replace(controls, '_', '-')
  WHEN controls = 'strict' AND event_id % 2 = 0 THEN '_ctrl-strict' ELSE '' END AS family FROM ({_NAME_ARGS})"""


def _named(t):
    a = _name_args(t)
    return a.withColumn("family", naming.family_name(
        F.col("target"), F.lit(None).cast("double"), F.col("source"), F.col("l"), F.col("r"), F.col("spl"),
        F.col("anchors"), F.col("controls"), F.col("event_id") % 2 == 0))


@query("F16_family_name", f"SELECT event_id, family FROM ({_NAME_SQL})")
def _(t):
    return _named(t).select("event_id", "family")


@query("F17_parse_family", f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'cue' ELSE target END AS target,
  CASE WHEN event_id % 5 = 0 THEN 'speaker' ELSE source END AS event_source, event_id % 5 = 0 AS source_inferred,
  CASE WHEN event_id % 5 = 0 THEN 100 + user_id ELSE l END AS left_ms, CASE WHEN event_id % 5 = 0 THEN 100 + user_id ELSE r END AS right_ms,
  NULL::VARCHAR AS issue FROM ({_NAME_SQL}) JOIN (SELECT event_id, user_id FROM events) USING (event_id)""")
def _(t):
    legacy = F.concat(F.lit("target-cue_window-"), (100 + F.col("user_id")).cast("string"), F.lit("_splits-10"))
    named = _named(t).join(t.ev.select("event_id", "user_id"), "event_id")
    name = F.when(F.col("event_id") % 5 == 0, legacy).otherwise(F.col("family"))
    return named.select("event_id", name.alias("name")).select(
        "event_id", naming.parse_family(F.col("name")).alias("f")).select("event_id", "f.*")


@query("F18_window_labels", f"""SELECT event_id, CASE WHEN l = r THEN 'window-' || l ELSE 'windowL-' || CASE WHEN l < 0 THEN 'm' || (-l) ELSE l::VARCHAR END
  || '_windowR-' || r END AS label, l AS left_ms, r AS right_ms FROM (SELECT event_id, k * 100 - 2000 AS l, CASE WHEN k % 3 = 0 AND k > 30 THEN k * 100 - 2000 ELSE 2500 END AS r FROM ({EV}))""")
def _(t):
    left = F.col("k") * 100 - 2000
    right = F.when((F.col("k") % 3 == 0) & (F.col("k") > 30), left).otherwise(2500)
    e = t.ev.select("event_id", left.alias("l"), right.alias("r"))
    text = F.concat(F.lit(" ("), naming.encode_ms(F.col("l")), F.lit(" , "), naming.encode_ms(F.col("r")), F.lit(")"))
    a, b = naming.parse_window(text)
    return e.select("event_id", naming.window_label(F.col("l"), F.col("r")).alias("label"), a.alias("left_ms"), b.alias("right_ms"))


# channel names of the event streams: two features, a flag and presence per event type
_WIDTHS = {"click": 2, "error": 2, "purchase": 2, "signup": 2, "view": 2}
_FLAGS = {"click": 1, "view": 1}
_CH_SQL = """SELECT (row_number() OVER (ORDER BY m, o) - 1)::INTEGER AS channel_ix, m || '.' || s AS channel, m AS modality FROM (
  SELECT DISTINCT event_type AS m FROM events), (VALUES (0, 'feature_0'), (1, 'feature_1'), (2, 'flag_0'), (3, 'present')) c(o, s)
  WHERE s <> 'flag_0' OR m IN ('click', 'view')"""


def _channels(t):
    return ch.channel_table(t.spark, _WIDTHS, _FLAGS).join(t.read("events").select(F.col("event_type").alias("modality")), "modality", "left_semi")


@query("F20_channel_names", _CH_SQL)
def _(t):
    return _channels(t).select("channel_ix", "channel", "modality")


@query("F21_channel_layout", f"""SELECT modality, CASE WHEN channel LIKE '%feature_0' THEN 'raw' WHEN channel LIKE '%feature_1' THEN 'motion'
  WHEN channel LIKE '%flag%' THEN 'flag' ELSE 'present' END AS block, min(channel_ix) AS start, max(channel_ix) + 1 AS stop,
  count(*) AS width, true AS contiguous FROM ({_CH_SQL}) GROUP BY 1, 2""")
def _(t):
    return ch.channel_layout(_channels(t), {k: 1 for k in _WIDTHS})


@query("F22_modality_slices", f"""SELECT modality, min(channel_ix) AS start, max(channel_ix) + 1 AS stop, count(*) AS width
  FROM ({_CH_SQL}) WHERE modality <> 'error' GROUP BY 1""")
def _(t):
    return ch.modality_slices(_channels(t), ["click", "purchase", "signup", "view"])


@query("F23_mask_channels", f"""SELECT sample_id, channel, frame, CASE WHEN channel IN (1, 3) THEN 0.0 ELSE value END AS value FROM ({GRID})""")
def _(t):
    masked = t.spark.createDataFrame([(1,), (3,)], "channel bigint")
    return ch.mask_values(t.grid, masked, ["channel"]).select("sample_id", "channel", "frame", "value")


@query("F24_masked_names", f"""SELECT event_id, event_type AS modality, (k % 2)::INTEGER AS feature_ix FROM ({EV})""")
def _(t):
    name = F.concat("event_type", F.lit(".feature_"), (F.col("k") % 2).cast("string"))
    return t.ev.select("event_id", *[c.alias(n) for n, c in ch.parse_masked_channel(name, _WIDTHS).items()])


@query("F25_sigmoid_logit", f"""SELECT event_id, {q6('CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END', 9)} AS p,
  {q6('ln(greatest(1e-7, least(1 - 1e-7, y)) / (1 - greatest(1e-7, least(1 - 1e-7, y))))')} AS l
  FROM (SELECT event_id, value - 20 AS x, (k / 100.0)::DOUBLE AS y FROM ({EV}))""")
def _(t):
    return t.ev.select("event_id", r6(v.sigmoid(F.col("value") - 20), 9).alias("p"), r6(v.logit(F.col("k") / 100.0)).alias("l"))


@query("F26_json_safe", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS x FROM events")
def _(t):
    x = F.when(F.col("event_id") % 6 == 0, float("inf")).when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value"))
    return files.json_safe(t.read("events").select("event_id", x.alias("x")))


@query("F27_clipped_seconds", f"SELECT event_id, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, (k * 500 - 25000) / 1000.0::DOUBLE)) AS s FROM ({EV})")
def _(t):
    return t.ev.select("event_id", v.clipped_seconds(F.col("k") * 500 - 25000).alias("s"))


# codes 0..99, then 5 special tokens, sentinels, tasks and answers
@query("F31_vocabulary_ids", f"""SELECT event_id, k AS token_id, '<motion_' || k || '>' AS name, 'code' AS kind FROM ({EV})
  UNION ALL SELECT event_id, 100 + user_id % 5, ['<pad>','<eos>','<bos>','<som>','<eom>'][1 + user_id % 5], 'special' FROM ({EV})""")
def _(t):
    from anchorgrid.operators.tokens import vocabulary
    vocab = vocabulary(t.spark, codes=100, sentinels=8)
    ids = t.ev.select("event_id", F.explode(F.array(F.col("k"), 100 + F.col("user_id") % 5)).alias("token_id"))
    return ids.join(F.broadcast(vocab), "token_id").select("event_id", "token_id", "name", "kind")


# -- set operations ---------------------------------------------------------------------

@query("U1_union", f"SELECT event_id, 'cue' AS part FROM ({CUES}) UNION ALL SELECT event_id, 'scope' FROM ({SCOPES})")
def _(t):
    return t.cues.select("event_id", F.lit("cue").alias("part")).unionByName(t.scopes.select("event_id", F.lit("scope").alias("part")))


@query("U2_except", f"SELECT user_id, chunk FROM ({CUES}) EXCEPT SELECT user_id, chunk FROM ({SCOPES})")
def _(t):
    return t.cues.select("user_id", "chunk").subtract(t.scopes.select("user_id", "chunk"))


@query("U3_intersect", f"SELECT user_id FROM ({CUES}) INTERSECT SELECT user_id FROM ({SCOPES})")
def _(t):
    return checks.shared_ids(t.cues, t.scopes, "user_id")


@query("U4_subset", f"""SELECT count(*) = 0 AS is_subset, count(*) AS missing FROM (
  SELECT DISTINCT user_id FROM ({CUES}) WHERE user_id NOT IN (SELECT user_id FROM ({SCOPES})))""")
def _(t):
    gone = checks.missing_ids(t.cues.select("user_id").distinct(), t.scopes, "user_id")
    return gone.agg((F.count(F.lit(1)) == 0).alias("is_subset"), F.count(F.lit(1)).alias("missing"))


@query("J4_set_checks", f"""SELECT 'duplicate' AS check_name, count(*) AS n FROM (SELECT user_id FROM ({CUES}) GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'overlap', count(*) FROM (SELECT user_id FROM ({CUES}) INTERSECT SELECT user_id FROM ({SCOPES}))""")
def _(t):
    dup = checks.duplicate_ids(t.cues, "user_id").agg(F.lit("duplicate").alias("check_name"), F.count(F.lit(1)).alias("n"))
    shared = checks.shared_ids(t.cues, t.scopes, "user_id").agg(F.lit("overlap").alias("check_name"), F.count(F.lit(1)).alias("n"))
    return dup.unionByName(shared)


@query("J6_leak_safe_corpus", f"""SELECT c.doc_id FROM documents c WHERE c.source NOT IN (SELECT group_id FROM ({PREDS}) WHERE fold >= 3)""")
def _(t):
    folds = _fold_table(t).withColumnRenamed("group_id", "source")
    return checks.without_held_out(t.read("documents").select("doc_id", "source"), folds, "source").select("doc_id")


_INV = """SELECT source AS family, 10::BIGINT AS splits, min(doc_id) % 4 = 0 AS ambiguous FROM documents GROUP BY source"""


@query("J12_dataset_inventory", f"""SELECT family, splits, ambiguous, count(e.d) AS present, count(e.d) = splits AND NOT ambiguous AS complete
  FROM ({_INV}) c, (SELECT unnest(range(0, 10)) AS f) LEFT JOIN (SELECT DISTINCT source || '_fold-' || (doc_id % 10) AS d FROM documents) e ON e.d = family || '_fold-' || f
  GROUP BY 1, 2, 3""")
def _(t):
    docs = t.read("documents")
    configs = docs.groupBy(F.col("source").alias("family")).agg(
        F.lit(10).cast("bigint").alias("splits"), (F.min("doc_id") % 4 == 0).alias("ambiguous"))
    existing = docs.select(F.concat("source", F.lit("_fold-"), (F.col("doc_id") % 10).cast("string")).alias("dataset_id"))
    return checks.dataset_inventory(configs, existing)
