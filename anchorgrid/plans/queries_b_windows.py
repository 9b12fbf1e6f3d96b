"""Joins, matching, folds, turns and transcripts on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorgrid.functions.hashing import draw
from anchorgrid.operators import folds, grid, matching, turns, windows
from anchorgrid.plans.queries_a_sources import _TOKENS, tokens
from anchorgrid.plans.registry import query
from anchorgrid.plans.roles import (
    CUES, EV, LINKS, PREDS, SCOPES, WORDS, h32, h60, links, q6, r6, words,
)

MINUTE, HOUR = 60_000, 3_600_000


def anchors(t):
    return t.cues.select(F.col("event_id").alias("anchor_id"), F.col("user_id").alias("player"), F.col("t").alias("t0"))


def stream(t):
    return t.ev.select("event_id", F.col("user_id").alias("event_player"), "t", "event_type", "value")


_SPEAKER = f"""SELECT c.event_id AS anchor_id, e.event_id, e.t - c.t AS offset_ms, e.event_type, e.value
  FROM ({CUES}) c JOIN ({EV}) e ON e.user_id = c.user_id AND e.t >= c.t - 21600000 AND e.t < c.t + 21600000"""


def speaker_windows(t):
    joined = windows.attach_windows(
        anchors(t), stream(t), left=6 * HOUR, right=6 * HOUR, source="speaker", bucket_ms=12 * HOUR)
    return joined.select("anchor_id", "event_id", (F.col("t") - F.col("t0")).alias("offset_ms"), "event_type", "value")


@query("J1_anchor_window_join", _SPEAKER)
def _(t):
    return speaker_windows(t)


@query("F1_speaker_listener_both", f"""SELECT source, count(*) AS n, sum(event_id)::BIGINT AS total FROM (
  SELECT CASE WHEN e.user_id = c.user_id THEN 'speaker' ELSE 'listener' END AS source, e.event_id FROM ({CUES}) c
  JOIN ({EV}) e ON e.t >= c.t - 600000 AND e.t < c.t + 600000) GROUP BY 1
  UNION ALL SELECT 'both', count(*), sum(e.event_id)::BIGINT FROM ({CUES}) c JOIN ({EV}) e ON e.t >= c.t - 600000 AND e.t < c.t + 600000""")
def _(t):
    out = None
    sums = {"n": F.lit(1).cast("bigint"), "total": F.col("event_id")}
    for source in windows.SOURCES:
        part = windows.window_sums(anchors(t), stream(t), [(10 * MINUTE, 10 * MINUTE)], sums, source=source)
        part = part.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("source", F.lit(source))
        out = part if out is None else out.unionByName(part)
    return out


@query("J2_nearest_cue_distance", f"""SELECT p.event_id, least(p.t - b.t, a.t - p.t) AS distance_ms
  FROM (SELECT * FROM ({EV}) WHERE event_type NOT IN ('purchase', 'signup')) p
  ASOF LEFT JOIN (SELECT t FROM ({CUES})) b ON p.t >= b.t ASOF LEFT JOIN (SELECT t FROM ({CUES})) a ON p.t <= a.t""")
def _(t):
    pool = t.ev.filter(~F.col("event_type").isin("purchase", "signup")).select("event_id", "t")
    return windows.nearest_distance(pool, t.cues.select("event_id", "t"), t="t", id_column="event_id").select("event_id", "distance_ms")


@query("J2_nearest_cue_distance_by_player", f"""SELECT p.event_id, least(p.t - b.t, a.t - p.t) AS distance_ms
  FROM (SELECT * FROM ({EV}) WHERE event_type NOT IN ('purchase', 'signup')) p
  ASOF LEFT JOIN ({CUES}) b ON p.user_id = b.user_id AND p.t >= b.t ASOF LEFT JOIN ({CUES}) a ON p.user_id = a.user_id AND p.t <= a.t""")
def _(t):
    pool = t.ev.filter(~F.col("event_type").isin("purchase", "signup")).select("user_id", "event_id", "t")
    refs = t.cues.select("user_id", "event_id", "t")
    return windows.nearest_distance(pool, refs, t="t", by=["user_id"], id_column="event_id").select("event_id", "distance_ms")


_SCOPE_EDGES = f"""SELECT l.negation_id AS cue_id, l.word_id, w.time_ms - c.t AS distance_ms FROM ({LINKS}) l
  JOIN ({CUES}) c ON c.event_id = l.negation_id JOIN ({WORDS}) w ON w.word_id = l.word_id
  WHERE l.field = 'scope_tokens' AND w.time_ms - c.t >= 1100"""


def scope_edges(t):
    scope = links(t).filter("field = 'scope_tokens'").groupBy("negation_id").agg(F.collect_list("word_id").alias("ids"))
    record = F.array(F.struct(F.col("ids").alias("scope_tokens")))
    cues = scope.join(t.cues, F.col("negation_id") == F.col("event_id")).select(
        F.col("event_id").alias("cue_id"), F.col("t").alias("cue_ms"), record.alias("neg"))
    return windows.scope_of_cues(cues, words(t))


@query("J3_scope_lookup", _SCOPE_EDGES)
def _(t):
    return scope_edges(t)


@query("J13_all_word_windows", f"""SELECT w.word_id, 'none' AS label, s.left_ms, s.right_ms, e.event_id FROM ({WORDS}) w,
  (VALUES (300000::BIGINT, 300000::BIGINT), (-60000, 1200000)) s(left_ms, right_ms)
  JOIN ({EV}) e ON e.user_id = w.player AND e.t >= w.time_ms - s.left_ms AND e.t < w.time_ms + s.right_ms""")
def _(t):
    w = words(t).select("word_id", "player", F.col("time_ms").alias("t0"))
    sizes = [(5 * MINUTE, 5 * MINUTE), (-MINUTE, 20 * MINUTE)]
    out = windows.all_word_windows(w, stream(t), sizes, source="speaker", bucket_ms=20 * MINUTE)
    return out.select("word_id", "label", F.col("left_ms").cast("bigint"), F.col("right_ms").cast("bigint"), "event_id")


@query("V9_window_grid", f"""SELECT source, left_ms, right_ms, count(*) AS n FROM (
  SELECT s.source, -(i - 5) * 300000 AS left_ms, (i - 5) * 300000 + 600000 AS right_ms, c.user_id AS cu, e.user_id AS eu
  FROM (VALUES ('speaker'), ('listener'), ('both')) s(source), (SELECT unnest(range(0, 10)) AS i), ({CUES}) c
  JOIN ({EV}) e ON e.t >= c.t + (i - 5) * 300000 AND e.t < c.t + (i - 5) * 300000 + 600000)
  WHERE source = 'both' OR (source = 'speaker') = (cu = eu) GROUP BY 1, 2, 3""")
def _(t):
    settings = windows.window_grid(t.spark, size_ms=10 * MINUTE, step_ms=5 * MINUTE)
    out = None
    for source in windows.SOURCES:
        # ten settings by argument
        sizes = [(r.left_ms, r.right_ms) for r in settings.filter(F.col("source") == source).collect()]
        part = windows.window_sums(anchors(t), stream(t), sizes, {"n": F.lit(1).cast("bigint")}, source=source)
        part = part.groupBy("left_ms", "right_ms").agg(F.sum("n").alias("n")).withColumn("source", F.lit(source))
        out = part if out is None else out.unionByName(part)
    return out.filter("n > 0")


# -- turns and transcripts ------------------------------------------------------------------

_TURNS = """SELECT *, sum(change) OVER (PARTITION BY experiment ORDER BY time_ms, word_id) - 1 AS turn FROM (
  SELECT *, CASE WHEN lag(player) OVER w IS DISTINCT FROM player THEN 1 ELSE 0 END AS change
  FROM (SELECT word_id, experiment, player %% 3 AS player, time_ms, k FROM (%s)) WINDOW w AS (PARTITION BY experiment ORDER BY time_ms, word_id))""" % WORDS


def turn_words(t):
    w = words(t).select("word_id", "experiment", (F.col("player") % 3).alias("player"), "time_ms", "k")
    return turns.speaker_turns(w, "experiment", "player", ["time_ms", "word_id"])


@query("W1_speaker_turns", f"SELECT word_id, experiment, player, turn::BIGINT AS turn FROM ({_TURNS})")
def _(t):
    return turn_words(t).select("word_id", "experiment", "player", "turn")


_BINS = f"""SELECT word_id, experiment, player, k, time_ms, CASE WHEN n = 1 THEN 'middle' WHEN i / (n - 1)::DOUBLE < 1/3 THEN 'early'
  WHEN i / (n - 1)::DOUBLE < 2/3 THEN 'middle' ELSE 'late' END AS position_bin FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment, turn ORDER BY time_ms, word_id) - 1 AS i,
  count(*) OVER (PARTITION BY experiment, turn) AS n FROM ({_TURNS}))"""


def binned(t):
    return turns.turn_positions(turn_words(t), "experiment", ["time_ms", "word_id"])


@query("F28_turn_position", f"SELECT word_id, position_bin FROM ({_BINS})")
def _(t):
    return binned(t).select("word_id", "position_bin")


@query("W9_stable_word_order", f"""SELECT word_id, row_number() OVER (ORDER BY experiment, time_ms, word_id) AS position FROM ({WORDS})""")
def _(t):
    from anchorgrid.operators.ordered import Ordered
    return Ordered(words(t), [], ["experiment", "time_ms", "word_id"]).numbered("position").done().select("word_id", "position")


_SENT = f"""SELECT *, row_number() OVER (PARTITION BY audio, sentence ORDER BY turn, token) - 1 AS token_ix FROM (
  SELECT *, coalesce(sum(e) OVER (PARTITION BY audio ORDER BY turn, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence
  FROM (SELECT conv_id AS audio, turn, token, word_id, word, CAST(regexp_matches(word, '[.!?]$') AS INTEGER) AS e FROM ({_TOKENS})))"""


def sentenced(t):
    tok = tokens(t).withColumnRenamed("conv_id", "audio")
    return turns.sentences(tok, "audio", ["turn", "token"], "word")


@query("X1_sentences", f"SELECT word_id, sentence, token_ix FROM ({_SENT})")
def _(t):
    return sentenced(t).select("word_id", "sentence", "token_ix")


@query("X2_label_coordinates", f"""SELECT conv_id AS audio, turn AS sentence, token::INTEGER AS token,
  CASE WHEN token = 0 THEN 'cue_tokens' ELSE 'scope_tokens' END AS field FROM ({_TOKENS}) WHERE token = 0 OR word LIKE 's%'""")
def _(t):
    conv = t.read("conversations")
    tags = F.transform(F.split("text", " "), lambda w, i: F.when(i == 0, "[CUE]").when(w.startswith("s"), "[SCO]").otherwise("[O]"))
    labels = conv.select(F.col("conv_id").alias("audio"), F.col("turn").alias("sentence"), F.array(tags).alias("negations"))
    return turns.label_coordinates(labels).select("audio", "sentence", "token", "field")


# tagged tokens: every word split into a lexical head and its last character as punctuation
_SPANS = f"""SELECT *, stop - len AS start FROM (SELECT conv_id, turn, token, word_id, word, greatest(length(word), 1) AS len,
  (sum(greatest(length(word), 1) + 1) OVER (PARTITION BY conv_id, turn ORDER BY token) - 1)::BIGINT AS stop FROM ({_TOKENS}))"""


@query("X3_pos_by_overlap", f"""SELECT word_id, CASE WHEN length(word) <= 1 THEN 'PUNCT' ELSE 'L' || length(word) % 5 END AS pos
  FROM ({_SPANS})""")
def _(t):
    spans = turns.character_spans(tokens(t), ["conv_id", "turn"], ["token"], "word")
    size = F.length("word")
    pieces = F.filter(F.array(
        F.when(size > 1, F.struct(F.col("start").alias("start"), (F.col("stop") - 1).alias("stop"),
               F.concat(F.lit("L"), (size % 5).cast("string")).alias("pos"), F.lit(False).alias("is_punct"))),
        F.struct((F.col("stop") - 1).alias("start"), F.col("stop").alias("stop"), F.lit("PUNCT").alias("pos"), F.lit(True).alias("is_punct")),
    ), lambda x: x.isNotNull())
    tagged = spans.select("conv_id", "turn", F.explode(pieces).alias("p")).select("conv_id", "turn", "p.*", F.lit(False).alias("is_space"))
    return turns.pos_by_overlap(spans, tagged, ["conv_id", "turn"], "word_id")


# -- matching and sampling --------------------------------------------------------------------

_POOL = f"SELECT * FROM ({WORDS}) WHERE word_id NOT IN (SELECT word_id FROM ({LINKS}))"


def pool_words(t):
    from anchorgrid.sources.words import scan_non_negation
    return scan_non_negation(words(t), links(t))


@query("M1_coarse_controls", f"""SELECT p.word_id FROM ({_POOL}) p
  ASOF LEFT JOIN (SELECT t FROM ({CUES})) b ON p.time_ms >= b.t ASOF LEFT JOIN (SELECT t FROM ({CUES})) a ON p.time_ms <= a.t
  WHERE coalesce(least(p.time_ms - b.t, a.t - p.time_ms), 60000) >= 60000
  ORDER BY {h60("'42:' || p.word_id")}, p.word_id LIMIT (SELECT count(*) FROM ({CUES}))""")
def _(t):
    cues = t.cues.select(F.col("event_id").alias("word_id"), F.col("t").alias("time_ms"))
    pool = pool_words(t).select("word_id", "time_ms")
    return matching.coarse_controls(cues, cues, pool, min_distance_ms=MINUTE, required=False).select("word_id")


@query("M2_strict_controls")
def _(t):
    cues = t.cues.select("experiment", F.col("user_id").alias("player"), "chunk", F.col("event_id").alias("cue_id"), F.col("t").alias("time_ms"))
    pool = pool_words(t).select("experiment", "player", "chunk", F.col("word_id").alias("control_id"), "time_ms")
    return matching.strict_controls(cues, pool, group=["experiment", "player"], chunk="chunk")


_M3 = f"""SELECT experiment, player, pos, position_bin, word_id, row_number() OVER (PARTITION BY is_cue, experiment, player, pos, position_bin
  ORDER BY CASE WHEN is_cue THEN {h60("'42:cue:' || word_id")} ELSE {h60("'42:control:' || word_id")} END, word_id) AS rn, is_cue
  FROM (SELECT b.*, k % 7 AS pos, word_id IN (SELECT event_id FROM ({CUES})) AS is_cue FROM ({_BINS}) b)
  WHERE is_cue OR word_id IN (SELECT word_id FROM ({_POOL}))"""


@query("M3_very_strict_controls", f"""SELECT c.word_id AS cue_id, w.word_id AS control_id FROM ({_M3}) c JOIN ({_M3}) w
  ON c.experiment = w.experiment AND c.player = w.player AND c.pos = w.pos AND c.position_bin = w.position_bin AND c.rn = w.rn
  WHERE c.is_cue AND NOT w.is_cue""")
def _(t):
    rows = binned(t).withColumn("pos", F.col("k") % 7)
    keys = ["experiment", "player", "pos", "position_bin"]
    cues = rows.join(t.cues.select(F.col("event_id").alias("word_id")), "word_id", "left_semi").select(*keys, F.col("word_id").alias("cue_id"))
    pool = rows.join(pool_words(t).select("word_id"), "word_id", "left_semi").select(*keys, F.col("word_id").alias("control_id"))
    return matching.paired_by_rank(cues, pool, keys).select("cue_id", "control_id")


@query("M4_scope_controls")
def _(t):
    return matching.scope_controls(scope_edges(t), t.cues.select(F.col("event_id").alias("cue_id")))


@query("M5_anchor_set_check", f"""SELECT event_id, 'matched' AS missing_in FROM ({CUES}) WHERE event_id NOT IN (
  SELECT c.word_id FROM ({_M3}) c JOIN ({_M3}) w ON c.experiment = w.experiment AND c.player = w.player AND c.pos = w.pos
    AND c.position_bin = w.position_bin AND c.rn = w.rn WHERE c.is_cue AND NOT w.is_cue)""")
def _(t):
    rows = binned(t).withColumn("pos", F.col("k") % 7)
    keys = ["experiment", "player", "pos", "position_bin"]
    cues = rows.join(t.cues.select(F.col("event_id").alias("word_id")), "word_id", "left_semi").select(*keys, F.col("word_id").alias("cue_id"))
    pool = rows.join(pool_words(t).select("word_id"), "word_id", "left_semi").select(*keys, F.col("word_id").alias("control_id"))
    matched = matching.paired_by_rank(cues, pool, keys).select(F.col("cue_id").alias("event_id"))
    return matching.require_same_anchors(t.cues, matched, "event_id")


@query("M6_balanced_sample", f"""SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality
  ORDER BY {h60("'42:' || doc_id")}, doc_id) AS rn FROM labels WHERE toxic = 0) WHERE rn <= 25""")
def _(t):
    rows = t.read("labels").select("doc_id", "quality", "toxic")
    return matching.balanced_sample(rows, 50, label="quality", id_column="doc_id", excluded=rows.filter("toxic = 1")).select("doc_id", "quality")


@query("M7_corpus_split", f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {h60("'42:' || doc_id")}, doc_id)
  <= greatest(1, floor(0.1 * count(*) OVER ())) THEN 'validation' ELSE 'train' END AS split FROM documents""")
def _(t):
    return matching.corpus_split(t.read("documents").select("doc_id"), id_column="doc_id")


@query("M8_uniform_subsample", f"""SELECT event_id FROM (SELECT event_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id, event_type) AS n
  FROM ({EV}) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, event_id)) r
  WHERE n <= 5 OR pos IN (round_even(0 * (n - 1) / 4.0::DOUBLE, 0), round_even(1 * (n - 1) / 4.0::DOUBLE, 0), round_even(2 * (n - 1) / 4.0::DOUBLE, 0),
    round_even(3 * (n - 1) / 4.0::DOUBLE, 0), round_even(4 * (n - 1) / 4.0::DOUBLE, 0))""")
def _(t):
    return matching.subsample_uniform(t.ev, ["user_id", "event_type"], ["t", "event_id"], 5).select("event_id")


# -- folds ------------------------------------------------------------------------------------

_V1 = f"""SELECT o_custkey, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM (
  SELECT o_custkey, row_number() OVER (ORDER BY -pos, -n, {h60("'42:' || o_custkey")}, o_custkey) - 1 AS r FROM (
    SELECT o_custkey, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS pos, count(*) AS n FROM orders GROUP BY 1))"""


def order_folds(t):
    orders = t.read("orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").startswith("1").cast("int").alias("label"))
    return folds.group_folds(orders, "o_custkey", "label", 5)


@query("V1_group_folds", f"SELECT o_orderkey, o_custkey, fold::INTEGER AS fold FROM orders JOIN ({_V1}) USING (o_custkey)")
def _(t):
    return order_folds(t).select("o_orderkey", "o_custkey", "fold")


_ROT = f"""SELECT o_orderkey, o_custkey, o.fold AS own, f.fold::INTEGER AS fold, CASE WHEN o.fold = f.fold THEN 'test'
  WHEN o.fold = (f.fold + 1) % 5 THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT o_orderkey, o_custkey, fold FROM orders JOIN ({_V1}) USING (o_custkey)) o, (SELECT unnest(range(0, 5)) AS fold) f"""


def rotated(t):
    return folds.rotate_splits(order_folds(t), 5)


@query("V2_rotated_splits", f"SELECT o_orderkey, fold, split FROM ({_ROT})")
def _(t):
    return rotated(t).select("o_orderkey", "fold", "split")


@query("V3_group_leaks", f"""SELECT fold, c % 40 AS grp, count(DISTINCT split) AS splits FROM (SELECT fold, split, o_custkey AS c FROM ({_ROT}))
  GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""")
def _(t):
    return folds.leaking_groups(rotated(t).withColumn("grp", F.col("o_custkey") % 40), "grp")


@query("V4_groups_in_tests", f"""SELECT c % 97 AS grp, count(DISTINCT fold) AS folds FROM (SELECT fold, o_custkey AS c FROM ({_ROT}) WHERE split = 'test')
  GROUP BY 1 HAVING count(DISTINCT fold) > 1""")
def _(t):
    return folds.groups_in_several_tests(rotated(t).withColumn("grp", F.col("o_custkey") % 97), "grp")


_DUPS = f"""SELECT fold::INTEGER AS fold, CASE WHEN k % 3 = 0 THEN 'test' ELSE 'train' END AS split, k % 60 AS sample_id FROM (
  SELECT {h32("'v5:' || event_id")} % 4 AS fold, k FROM ({EV}))"""


@query("V5_duplicate_audit", f"""SELECT p.*, coalesce(test_occurrences, 0)::BIGINT AS test_occurrences, concat_ws(';', CASE WHEN in_split > 1 THEN 'within_split' END,
  CASE WHEN split = 'test' AND test_folds > 1 THEN 'across_test_folds' END) AS reason, 'fold:' || fold || ':' || split || ':' || sample_id AS sample_key
  FROM (SELECT fold, split, sample_id, count(*) AS in_split FROM ({_DUPS}) GROUP BY 1, 2, 3) p
  LEFT JOIN (SELECT sample_id, count(DISTINCT fold) AS test_folds, count(*) AS test_occurrences FROM ({_DUPS}) WHERE split = 'test' GROUP BY 1) USING (sample_id)
  WHERE in_split > 1 OR (split = 'test' AND test_folds > 1)""")
def _(t):
    rows = t.ev.select((draw("v5", F.col("event_id")) % 4).cast("int").alias("fold"),
                       F.when(F.col("k") % 3 == 0, "test").otherwise("train").alias("split"), (F.col("k") % 60).alias("sample_id"))
    return folds.duplicate_audit(rows, "sample_id")


@query("V6_fold_compatibility", f"""SELECT lang, count(*) AS folds, count(DISTINCT CASE WHEN lang < 'e' THEN 0 ELSE fold % 2 END) AS signatures, count(DISTINCT fold) AS names,
  count(*) >= 2 AND count(DISTINCT CASE WHEN lang < 'e' THEN 0 ELSE fold % 2 END) = 1 AND count(DISTINCT fold) = count(*) AS compatible
  FROM (SELECT DISTINCT lang, fold FROM ({PREDS})) GROUP BY lang""")
def _(t):
    runs = t.preds.select("lang", "fold").distinct().withColumn("signature", F.when(F.col("lang") < "e", 0).otherwise(F.col("fold") % 2))
    return folds.fold_compatibility(runs, ["signature"], "fold", ["lang"])


_POOLED = f"""SELECT sample_id, fold, label, probability FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY fold, probability) AS rn FROM (
  SELECT sample_id, fold, label, probability FROM ({PREDS}) WHERE model = 'a'
  UNION ALL SELECT sample_id, fold + 1, label, probability FROM ({PREDS}) WHERE model = 'a' AND {h32("'dup:' || sample_id")} % 100 = 0)) WHERE rn = 1"""


@query("V7_pool_folds", _POOLED)
def _(t):
    rows = t.preds.filter("model = 'a'").select("sample_id", "fold", "label", "probability")
    again = rows.filter(draw("dup", F.col("sample_id")) % 100 == 0).withColumn("fold", F.col("fold") + 1)
    return folds.pool_folds(rows.unionByName(again), "sample_id", ["fold", "probability"])


@query("V8_repeated_folds", f"""SELECT doc_id, repeat::INTEGER AS repeat, ((row_number() OVER (PARTITION BY repeat, quality
  ORDER BY {h60("'42:' || repeat || ':' || doc_id")}, doc_id) - 1) % 4)::INTEGER AS inner_fold
  FROM labels, (SELECT unnest(range(0, 3)) AS repeat)""")
def _(t):
    return folds.repeated_stratified_folds(t.read("labels").select("doc_id", "quality"), "quality", "doc_id", 4, 3).select("doc_id", "repeat", "inner_fold")


@query("V8_stratified_halves", f"""SELECT doc_id, repeat::INTEGER AS repeat, CASE WHEN 2 * row_number() OVER (PARTITION BY repeat, quality
  ORDER BY {h60("'42:' || repeat || ':' || doc_id")}, doc_id) <= count(*) OVER (PARTITION BY repeat, quality) THEN 'fit' ELSE 'score' END AS part
  FROM labels, (SELECT unnest(range(0, 5)) AS repeat)""")
def _(t):
    return folds.stratified_halves(t.read("labels").select("doc_id", "quality"), "quality", "doc_id", 5).select("doc_id", "repeat", "part")


@query("V10_pending_jobs", f"""SELECT DISTINCT user_id AS variant, chunk AS fold, 's' || k % 3 AS signature FROM ({EV}) e WHERE NOT EXISTS (
  SELECT 1 FROM ({EV}) d WHERE d.event_type = 'view' AND d.user_id = e.user_id AND d.chunk = e.chunk AND d.k % 3 = e.k % 3)""")
def _(t):
    jobs = t.ev.select(F.col("user_id").alias("variant"), F.col("chunk").alias("fold"),
                       F.concat(F.lit("s"), (F.col("k") % 3).cast("string")).alias("signature"), "event_type")
    done = jobs.select("variant", "fold", "signature", (F.col("event_type") == "view").alias("complete"))
    return folds.pending_jobs(jobs.drop("event_type").distinct(), done, ["variant", "fold"])
