"""Resampling, trace features, representation and token operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorgrid.functions import traces as tr
from anchorgrid.functions.hashing import draw
from anchorgrid.operators import grid, motion, representation as rep, tokens as tk
from anchorgrid.operators.ordered import Ordered
from anchorgrid.plans.queries_b_windows import _SPEAKER, speaker_windows
from anchorgrid.plans.registry import query
from anchorgrid.plans.roles import EV, GRID, PGRID, SERIES, h32, h60, q6, r6

START, STOP, POINTS = -21_600_000, 21_600_000, 32

# observations per (anchor, event type), duplicates averaged, then on the grid
_OBS = f"SELECT anchor_id, event_type, offset_ms, avg(value) AS v FROM ({_SPEAKER}) GROUP BY 1, 2, 3"
_POINTS = f"SELECT f, ({START} + f * ({STOP - START} / 31.0::DOUBLE))::DOUBLE AS g FROM (SELECT unnest(range(0, {POINTS})) AS f)"
_COVERED = f"""WITH obs AS MATERIALIZED ({_OBS}), pts AS MATERIALIZED ({_POINTS}),
  st AS (SELECT anchor_id, event_type, count(*) AS n, min(offset_ms) AS only_t, min(v) AS only_v FROM obs GROUP BY 1, 2)
  SELECT c.anchor_id, c.event_type, c.f AS frame, CASE WHEN b.offset_ms = a.offset_ms THEN b.v
    ELSE b.v + (a.v - b.v) * (c.g - b.offset_ms) / (a.offset_ms - b.offset_ms) END AS value
  FROM (SELECT anchor_id, event_type, f, g FROM st, pts WHERE n > 1) c
  ASOF JOIN obs b ON c.anchor_id = b.anchor_id AND c.event_type = b.event_type AND c.g >= b.offset_ms
  ASOF JOIN obs a ON c.anchor_id = a.anchor_id AND c.event_type = a.event_type AND c.g <= a.offset_ms
  UNION ALL
  SELECT anchor_id, event_type, f, only_v FROM (SELECT anchor_id, event_type, f, only_v,
    row_number() OVER (PARTITION BY anchor_id, event_type ORDER BY abs(g - only_t), f) AS rn FROM st, pts WHERE n = 1) WHERE rn = 1"""


def covered(t):
    return grid.resample(speaker_windows(t), ["anchor_id", "event_type"], "offset_ms", "value",
                         start_ms=START, stop_ms=STOP, points=POINTS)


@query("flagship_anchor_grid", f"""SELECT event_type, frame, count(*) AS covered, {q6('avg(value)')} AS mean_value FROM ({_COVERED}) GROUP BY 1, 2""")
def _(t):
    return covered(t).groupBy("event_type", F.col("frame").cast("bigint").alias("frame")).agg(
        F.count(F.lit(1)).alias("covered"), r6(F.avg("value")).alias("mean_value"))


@query("T1_step_gaps", f"""SELECT anchor_id, t, player, greatest(-10000.0, least(10000.0, offset_ms / 1000.0::DOUBLE)) AS relative_s,
  least(10000.0, coalesce(t - lag(t) OVER w, 0) / 1000.0::DOUBLE) AS previous_s, least(10000.0, coalesce(lead(t) OVER w - t, 0) / 1000.0::DOUBLE) AS next_s
  FROM (SELECT DISTINCT s.anchor_id, e.t, e.user_id AS player, s.offset_ms FROM ({_SPEAKER}) s JOIN ({EV}) e USING (event_id))
  WINDOW w AS (PARTITION BY anchor_id ORDER BY t, player)""")
def _(t):
    w = speaker_windows(t).join(t.ev.select("event_id", "t", F.col("user_id").alias("player")), "event_id")
    w = w.withColumn("t0", F.col("t") - F.col("offset_ms"))
    return grid.step_gaps(w, "anchor_id", "t", "player", "t0", clip=10000.0)


@query("T2_canonical_order", f"""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END, k, event_id) AS position FROM ({EV})""")
def _(t):
    order = F.create_map(*[F.lit(x) for p in (("view", 0), ("click", 1), ("signup", 2), ("purchase", 3)) for x in p])
    rows = t.ev.withColumn("modality_id", F.coalesce(order[F.col("event_type")], F.lit(4)))
    return Ordered(rows, ["user_id"], ["t", "modality_id", "k", "event_id"]).numbered("position").done().select("event_id", "position")


_RATE = f"""SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t <= lag(t) OVER w THEN 0.0 ELSE (value - lag(value) OVER w) / ((t - lag(t) OVER w) / 1000.0::DOUBLE) END AS rate0,
  CASE WHEN lag(t) OVER w IS NULL OR t <= lag(t) OVER w THEN 0.0 ELSE (k - lag(k) OVER w) / ((t - lag(t) OVER w) / 1000.0::DOUBLE) END AS rate1
  FROM ({EV}) WINDOW w AS (PARTITION BY event_type, user_id ORDER BY t, event_id)"""


def rates(t):
    rows = t.ev.withColumn("features", F.array(F.col("value"), F.col("k").cast("double")))
    return motion.with_rates(rows, ["event_type", "user_id"], ["t", "event_id"], "t")


@query("T3_rates", f"SELECT event_id, {q6('rate0', 9)} AS rate0, {q6('rate1', 9)} AS rate1 FROM ({_RATE})")
def _(t):
    return rates(t).select("event_id", r6(F.col("motion")[0], 9).alias("rate0"), r6(F.col("motion")[1], 9).alias("rate1"))


@query("W3_previous_event", f"""SELECT event_id, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY t, event_id) AS previous_id FROM ({EV})""")
def _(t):
    rows = Ordered(t.ev, ["event_type", "user_id"], ["t", "event_id"]).neighbour(["event_id"], "p", -1).done()
    return rows.select("event_id", F.col("p.event_id").alias("previous_id"))


@query("W4_previous_next_observation", f"""SELECT event_id, last_value(CASE WHEN k % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before_value, first_value(CASE WHEN k % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after_value FROM ({EV})""")
def _(t):
    seen = F.when(F.col("k") % 3 == 0, F.col("value"))
    line = Ordered(t.ev, ["user_id"], ["t", "event_id"]).carried(seen, "before_value", -1).carried(seen, "after_value", 1)
    return line.done().select("event_id", "before_value", "after_value")


# consecutive vectors of one class as rotations one second apart
_Q = """SELECT vec_id, label, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT *, sqrt(x*x + y*y + z*z + w*w) AS n FROM (
  SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings))"""
_W = f"""SELECT vec_id, s * rx AS rx, s * ry AS ry, s * rz AS rz, s * rw AS rw, sqrt(rx*rx + ry*ry + rz*rz) AS len FROM (
  SELECT *, CASE WHEN rw < 0 THEN -1.0 ELSE 1.0 END AS s FROM (
    SELECT vec_id, w * (-px) + pw * x + (y * (-pz) - z * (-py)) AS rx, w * (-py) + pw * y + (z * (-px) - x * (-pz)) AS ry,
      w * (-pz) + pw * z + (x * (-py) - y * (-px)) AS rz, w * pw - (x * (-px) + y * (-py) + z * (-pz)) AS rw
    FROM (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(z) OVER o AS pz, lag(w) OVER o AS pw FROM ({_Q}) WINDOW o AS (PARTITION BY label ORDER BY vec_id))))"""


@query("T4_angular_velocity", f"""SELECT vec_id, {q6('CASE WHEN len IS NULL OR len < 1e-8 THEN 0.0 ELSE rx / len * 2 * atan2(len, least(rw, 1.0)) / 2 END', 5)} AS ax,
  {q6('CASE WHEN len IS NULL OR len < 1e-8 THEN 0.0 ELSE rz / len * 2 * atan2(len, least(rw, 1.0)) / 2 END', 5)} AS az FROM ({_W})""")
def _(t):
    q = t.read("embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("q"))
    rows = motion.with_previous(q, ["label"], ["vec_id"], ["q"])
    seconds = F.when(F.col("previous").isNull(), F.lit(0.0)).otherwise(F.lit(2.0))
    turn = motion.angular_velocity(F.col("q"), F.coalesce(F.col("previous.q"), F.col("q")), seconds)
    return rows.select("vec_id", turn.alias("a")).select("vec_id", r6(F.col("a")[0], 5).alias("ax"), r6(F.col("a")[2], 5).alias("az"))


@query("T5_motion_vectors", f"""SELECT vec_id, {q6('coalesce((px - lag(px) OVER o) / 2, 0.0)', 5)} AS vx,
  {q6('CASE WHEN len IS NULL OR len < 1e-8 THEN 0.0 ELSE ry / len * 2 * atan2(len, least(rw, 1.0)) / 2 END', 5)} AS ay, 13::INTEGER AS width
  FROM (SELECT vec_id, label, embedding[5]::DOUBLE AS px FROM embeddings) JOIN ({_W}) USING (vec_id) WINDOW o AS (PARTITION BY label ORDER BY vec_id)""")
def _(t):
    from anchorgrid.functions import values as v
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    # the unit rotation in the stored hemisphere is turned back by the shortest path rule
    feats = F.concat(F.array(e(4), e(5), e(6)), v.unit_quaternion(e(0), e(1), e(2), e(3)))
    rows = t.read("embeddings").select("vec_id", "label", feats.alias("features"))
    numbered = Ordered(rows, ["label"], ["vec_id"]).numbered("rn").done()
    stream = numbered.withColumn("t", F.col("rn") * 2000).withColumn("event_type", F.lit("Head"))
    out = motion.with_motion(stream, ["label"], ["t", "vec_id"], "t", kinds=["Head"])
    return out.select("vec_id", r6(F.col("features")[7], 5).alias("vx"), r6(F.col("features")[11], 5).alias("ay"), F.size("features").alias("width"))


# nested payloads whose numbers follow from the event and their place in the vector
KINDS = ("Eye", "Facial", "Head", "LeftFinger", "RightHand")


def payload_rows(t):
    g = lambda ix: ((F.col("event_id") * 7 + F.lit(ix) * 13) % 41 - 20) / F.lit(10.0)
    many = lambda a, b: F.array(*[g(i) for i in range(a, b)])
    place = lambda at: F.struct(*[g(at + i).alias(c) for i, c in enumerate("xyz")])
    turn = lambda at: F.struct(*[g(at + i).alias(c) for i, c in enumerate("xyzw")])
    pose = lambda at: F.struct(place(at).alias("Position"), turn(at + 3).alias("Orientation"))
    gaze = lambda e: F.struct(g(9 * e).alias("Confidence"), ((F.col("event_id") + e) % 2 == 1).alias("IsValid"), pose(9 * e + 2).alias("Pose"))
    body = F.struct(place(0).alias("position"), turn(3).alias("rotation"))
    # every second confidence is written as the bit pattern of 0.5
    hand = F.struct(
        F.when(F.col("event_id") % 2 == 0, F.lit(1056964608)).otherwise(F.lit(1)).alias("handConfidence"), g(1).alias("handScale"), pose(2).alias("pointerPose"), pose(9).alias("rootPose"),
        F.array(*[turn(16 + 4 * b) for b in range(26)]).alias("boneRotations"), many(120, 125).alias("fingerConfidences"), many(125, 130).alias("pinchStrength"))
    face = F.struct(many(0, 63).alias("expressionWeights"), many(63, 65).alias("expressionWeightConfidences"),
                    F.struct((F.col("event_id") % 2 == 1).alias("IsValid"), (F.col("event_id") % 3 == 0).alias("IsEyeFollowingBlendshapesValid")).alias("status"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = t.ev.select("event_id", "user_id", "t", kind.alias("event_type"))
    text = F.when(F.col("event_type") == "Eye", F.to_json(F.struct(F.array(gaze(0), gaze(1)).alias("eyeGazes")))).when(F.col("event_type") == "Facial", F.to_json(face))
    text = text.when(F.col("event_type") == "LeftFinger", F.to_json(hand)).otherwise(F.to_json(body))
    return rows.withColumn("payload", text)


def _slots():
    """(kind, ix, what, start): what stands at each place of each vector, and where a rotation begins."""
    turns = {"Eye": [5, 14], "Facial": [], "Head": [3], "RightHand": [3], "LeftFinger": [5, 12, *range(16, 120, 4)]}
    special = {("Eye", 1): "odd", ("Eye", 10): "even", ("Facial", 65): "odd", ("Facial", 66): "third", ("LeftFinger", 0): "half"}
    width = {"Eye": 18, "Facial": 67, "Head": 7, "RightHand": 7, "LeftFinger": 130}
    for kind in KINDS:
        inside = {at + i: at for at in turns[kind] for i in range(4)}
        for ix in range(width[kind]):
            yield kind, ix, special.get((kind, ix), "turn" if ix in inside else "number"), inside.get(ix, ix)


def _moving():
    """(kind, place in the motion vector, place of the number or of the rotation, component; -1 for a plain rate)."""
    pose = lambda at: [(at + i, -1) for i in range(3)] + [(at + 3, c) for c in range(3)]
    parts = {"Eye": pose(2) + pose(11), "Facial": [(i, -1) for i in range(63)], "Head": pose(0), "RightHand": pose(0),
             "LeftFinger": [(1, -1), *pose(2), *pose(9), *[(16 + 4 * b, c) for b in range(26) for c in range(3)], *[(i, -1) for i in range(125, 130)]]}
    for kind in KINDS:
        yield from ((kind, place, at, c) for place, (at, c) in enumerate(parts[kind]))


def _num(e, ix):
    return f"((({e}) * 7 + ({ix}) * 13) % 41 - 20) / 10.0::DOUBLE"


def _unit(e, at, ix):
    norm = "sqrt(" + " + ".join(f"pow({_num(e, f'{at} + {i}')}, 2)" for i in range(4)) + ")"
    return f"CASE WHEN {norm} < 1e-8 THEN 0.0 ELSE {_num(e, ix)} / {norm} * CASE WHEN {_num(e, f'{at} + 3')} < 0 THEN -1 ELSE 1 END END"


_SLOTS = "(VALUES " + ", ".join(map(str, _slots())) + ") s(kind, ix, what, start)"
_MOVES = "(VALUES " + ", ".join(map(str, _moving())) + ") s(kind, place, start, c)"
_KINDS = f"SELECT event_id, user_id, t, [{', '.join(repr(k) for k in KINDS)}][event_id % 5 + 1] AS kind FROM ({EV})"
_PAIRS = f"SELECT *, lag(event_id) OVER w AS before, (t - lag(t) OVER w) / 1000.0::DOUBLE AS seconds FROM ({_KINDS}) WINDOW w AS (PARTITION BY kind, user_id ORDER BY t, event_id)"
_VALUES = f"""SELECT kind, ix, CASE what WHEN 'odd' THEN event_id % 2 WHEN 'even' THEN (event_id + 1) % 2 WHEN 'third' THEN (event_id % 3 = 0)::INTEGER WHEN 'half' THEN CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1 END
  WHEN 'turn' THEN {_unit('event_id', 'start', 'ix')} ELSE {_num('event_id', 'ix')} END::DOUBLE AS x FROM ({_KINDS}) JOIN {_SLOTS} USING (kind)"""
_ROTATED = ", ".join(f"{_unit('event_id', 'start', f'start + {i}')} AS a{i}, {_unit('before', 'start', f'start + {i}')} AS b{i}" for i in range(4))
_MOTION = f"""SELECT kind, ix, CASE WHEN before IS NULL OR seconds <= 0 THEN 0.0 WHEN c < 0 THEN rate WHEN len < 1e-8 THEN 0.0 ELSE [rx, ry, rz][c + 1] / len * CASE WHEN rw < 0 THEN -1 ELSE 1 END * 2 * atan2(len, least(abs(rw), 1.0)) / seconds END AS x
  FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS len FROM (SELECT *, a3 * -b0 + b3 * a0 + (a1 * -b2 - a2 * -b1) AS rx, a3 * -b1 + b3 * a1 + (a2 * -b0 - a0 * -b2) AS ry, a3 * -b2 + b3 * a2 + (a0 * -b1 - a1 * -b0) AS rz, a3 * b3 + a0 * b0 + a1 * b1 + a2 * b2 AS rw
  FROM (SELECT kind, place + CASE kind WHEN 'Eye' THEN 18 WHEN 'Facial' THEN 67 WHEN 'LeftFinger' THEN 130 ELSE 7 END AS ix, before, seconds, c, ({_num('event_id', 'start')} - {_num('before', 'start')}) / nullif(seconds, 0) AS rate, {_ROTATED} FROM ({_PAIRS}) JOIN {_MOVES} USING (kind))))"""


# every value and every motion of every modality, from one pass over nested payloads
@query("F12_T5_payload_motion", f"""SELECT kind AS modality, ix::BIGINT AS ix, count(*) AS n, {q6('avg(x)', 5)} AS mean, {q6('sqrt(avg(x * x))', 5)} AS size, {q6('min(x)', 5)} AS low, {q6('max(x)', 5)} AS high
  FROM ({_VALUES} UNION ALL {_MOTION}) GROUP BY 1, 2""")
def _(t):
    made = motion.with_motion(motion.extract_payloads(payload_rows(t)), ["event_type", "user_id"], ["t", "event_id"], "t", kinds=KINDS)
    x = made.select(F.col("event_type").alias("modality"), F.posexplode("features").alias("ix", "x"))
    out = x.groupBy("modality", "ix").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("size"), F.min("x").alias("low"), F.max("x").alias("high"))
    return out.select("modality", F.col("ix").cast("bigint").alias("ix"), "n", *[r6(F.col(c), 5).alias(c) for c in ("mean", "size", "low", "high")])


_NORM = f"""SELECT event_type, ix, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS std FROM (
  SELECT event_type, 0 AS ix, value AS x FROM ({EV}) WHERE k % 5 <> 0 UNION ALL SELECT event_type, 1, k::DOUBLE FROM ({EV}) WHERE k % 5 <> 0) GROUP BY 1, 2"""


def featured(t):
    return t.ev.select("event_id", "k", F.col("event_type").alias("modality"), F.array(F.col("value"), F.col("k").cast("double")).alias("features"))


def fitted(t):
    return grid.fit_normalizer(featured(t).filter(F.col("k") % 5 != 0))


@query("T6_fit_normalizer", f"SELECT event_type AS modality, ix::INTEGER AS feature_ix, {q6('mean')} AS mean, {q6('std')} AS std FROM ({_NORM})")
def _(t):
    return fitted(t).select("modality", "feature_ix", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("T7_apply_normalizer", f"""SELECT event_id, {q6('(value - a.mean) / a.std')} AS x0, {q6('(k - b.mean) / b.std')} AS x1, round(value, 6) AS back
  FROM ({EV}) e JOIN ({_NORM}) a ON a.event_type = e.event_type AND a.ix = 0 JOIN ({_NORM}) b ON b.event_type = e.event_type AND b.ix = 1""")
def _(t):
    norm = fitted(t)
    scaled = grid.apply_normalizer(featured(t), norm)
    back = grid.apply_normalizer(scaled.withColumn("z", F.col("features")), norm, invert=True)
    return back.select("event_id", r6(F.col("z")[0]).alias("x0"), r6(F.col("z")[1]).alias("x1"), F.round(F.col("features")[0], 6).alias("back"))


@query("T7_rescale", f"""SELECT event_id, {q6('(((value - a.mean) / a.std) * a.std + a.mean - c.mean) / c.std', 5)} AS x0 FROM ({EV}) e
  JOIN ({_NORM}) a ON a.event_type = e.event_type AND a.ix = 0
  JOIN (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1) c ON c.event_type = e.event_type""")
def _(t):
    own, target = fitted(t), grid.fit_normalizer(featured(t))
    out = grid.rescale(grid.apply_normalizer(featured(t), own), own, target)
    return out.select("event_id", r6(F.col("features")[0], 5).alias("x0"))


@query("T8_average_duplicates", f"""SELECT user_id, t // 3600000 AS hour, {q6('avg(value)')} AS value FROM ({EV}) GROUP BY 1, 2""")
def _(t):
    rows = t.ev.withColumn("hour", F.expr("t div 3600000"))
    return grid.average_duplicates(rows, ["user_id"], "hour", "value").withColumn("value", r6(F.col("value")))


@query("T9_grid_interpolation", f"SELECT anchor_id, event_type, frame, {q6('value', 5)} AS value FROM ({_COVERED})")
def _(t):
    return covered(t).select("anchor_id", "event_type", F.col("frame").cast("bigint").alias("frame"), r6(F.col("value"), 5).alias("value"))


@query("T10_channel_matrix", f"""WITH cov AS ({_COVERED}), ty AS (SELECT DISTINCT event_type FROM events)
  SELECT s.anchor_id AS sample_id, ty.event_type || CASE WHEN p = 0 THEN '.feature_0' ELSE '.present' END AS channel,
    {q6('coalesce(sum(CASE WHEN p = 0 THEN value WHEN cov.frame IS NULL THEN 0.0 ELSE 1.0 END), 0.0)', 4)} AS total
  FROM (SELECT event_id AS anchor_id FROM events WHERE event_type = 'purchase') s, ty, (VALUES (0), (1)) v(p)
  LEFT JOIN cov ON cov.anchor_id = s.anchor_id AND cov.event_type = ty.event_type GROUP BY 1, 2""")
def _(t):
    from anchorgrid.functions.channels import channel_table
    channels = channel_table(t.spark, {k: 1 for k in ("click", "error", "purchase", "signup", "view")})
    traces = grid.to_traces(covered(t), ["anchor_id", "event_type"], "value", POINTS).select(
        F.col("anchor_id").alias("sample_id"), F.col("event_type").alias("modality"), F.lit(0).alias("kind_ix"), "values", "present")
    out = grid.channel_matrix(traces, t.cues.select(F.col("event_id").alias("sample_id")), channels, POINTS)
    return out.select("sample_id", "channel", r6(tr.total(F.col("values")), 4).alias("total"))


# -- traces: 4 channels of 16 frames, or 1 channel of 64 -------------------------------------


def traces16(t):
    e = t.read("embeddings").withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(3))))
    part = F.slice("embedding", F.col("channel") * 16 + 1, F.lit(16))
    frames = F.sequence(F.lit(0), F.lit(15))
    present = F.transform(frames, lambda f: (draw("p", F.col("vec_id"), F.col("channel"), f) % 5 != 0).cast("int"))
    return e.select(
        F.col("vec_id").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"), F.col("channel").cast("bigint").alias("channel"),
        F.transform(part, lambda x: x.cast("double")).alias("values"), present.alias("present"))


def long_form(df, column, digits=6, name="value", keys=("sample_id", "channel")):
    return df.select(*keys, F.posexplode(column).alias("frame", "x")).select(
        *keys, F.col("frame").cast("bigint").alias("frame"), r6(F.col("x"), digits).alias(name))


@query("T11_collapse_near_constant", f"""SELECT sample_id, channel, frame, {q6('1e6 * CASE WHEN sample_id % 2 = 0 THEN avg(value * 1e-8) OVER (PARTITION BY sample_id, channel) ELSE value END')} AS value FROM ({GRID})""")
def _(t):
    tiny = F.when(F.col("sample_id") % 2 == 0, F.transform("values", lambda x: x * 1e-8)).otherwise(F.col("values"))
    flat = traces16(t).withColumn("values", tiny).withColumn("values", tr.collapse_near_constant(F.col("values")))
    return long_form(flat, F.transform("values", lambda x: x * 1e6))


@query("T12_differences", f"""SELECT sample_id, channel, frame, {q6('a')} AS first, {q6('b')} AS second FROM (
  SELECT sample_id, channel, frame, lead(value) OVER w - value AS a, lead(value, 2) OVER w - lead(value) OVER w - (lead(value) OVER w - value) AS b
  FROM ({GRID}) WINDOW w AS (PARTITION BY sample_id, channel ORDER BY frame)) WHERE frame < 14""")
def _(t):
    d = traces16(t).select("sample_id", "channel", F.arrays_zip(
        tr.difference(F.col("values")).alias("a"), tr.difference(F.col("values"), 2).alias("b")).alias("d"))
    rows = d.select("sample_id", "channel", F.posexplode("d").alias("frame", "x")).filter("frame < 14")
    return rows.select("sample_id", "channel", F.col("frame").cast("bigint").alias("frame"), r6(F.col("x.a")).alias("first"), r6(F.col("x.b")).alias("second"))


_REFLECT = "CASE WHEN g.frame + o < 0 THEN -(g.frame + o) WHEN g.frame + o > 15 THEN 30 - (g.frame + o) ELSE g.frame + o END"


def _smooth_sql(source):
    return f"""SELECT g.sample_id, g.channel, g.frame, any_value(g.value) AS value, avg(h.value) AS smooth FROM ({source}) g, (SELECT unnest(range(-2, 3)) AS o)
  JOIN ({source}) h ON h.sample_id = g.sample_id AND h.channel = g.channel AND h.frame = {_REFLECT} GROUP BY 1, 2, 3"""


@query("T13_moving_average", f"SELECT sample_id, channel, frame, {q6('smooth')} AS value FROM ({_smooth_sql(GRID)})")
def _(t):
    return long_form(traces16(t), tr.moving_average(F.col("values"), 5))


_REST = f"SELECT sample_id, channel, frame, value - smooth AS value FROM ({_smooth_sql(GRID)})"
_SQ = f"SELECT sample_id, channel, frame, value * value AS value FROM ({_REST})"


@query("T14_highpass_local_norm", f"""SELECT r.sample_id, r.channel, r.frame, {q6('r.value')} AS highpass, {q6('r.value / sqrt(s.smooth + 1e-6)', 4)} AS local_norm
  FROM ({_REST}) r JOIN ({_smooth_sql(_SQ)}) s USING (sample_id, channel, frame)""")
def _(t):
    views = traces16(t).select("sample_id", "channel", F.arrays_zip(
        tr.temporal_view(F.col("values"), "highpass").alias("a"), tr.temporal_view(F.col("values"), "local_norm").alias("b")).alias("d"))
    rows = views.select("sample_id", "channel", F.posexplode("d").alias("frame", "x"))
    return rows.select("sample_id", "channel", F.col("frame").cast("bigint").alias("frame"), r6(F.col("x.a")).alias("highpass"), r6(F.col("x.b"), 4).alias("local_norm"))


@query("C16_temporal_views", f"""SELECT 'raw' AS view, count(*) AS n, {q6('sum(value)', 4)} AS total FROM ({GRID})
  UNION ALL SELECT 'first_diff', count(*), {q6('sum(d)', 4)} FROM (SELECT lead(value) OVER (PARTITION BY sample_id, channel ORDER BY frame) - value AS d, frame FROM ({GRID})) WHERE frame < 15
  UNION ALL SELECT 'second_diff', count(*), {q6('sum(d)', 4)} FROM (SELECT lead(value, 2) OVER w - 2 * lead(value) OVER w + value AS d, frame FROM ({GRID}) WINDOW w AS (PARTITION BY sample_id, channel ORDER BY frame)) WHERE frame < 14
  UNION ALL SELECT 'smoothed', count(*), {q6('sum(smooth)', 4)} FROM ({_smooth_sql(GRID)})
  UNION ALL SELECT 'highpass', count(*), {q6('sum(value)', 4)} FROM ({_REST})
  UNION ALL SELECT 'local_norm', count(*), {q6('sum(r.value / sqrt(s.smooth + 1e-6))', 3)} FROM ({_REST}) r JOIN ({_smooth_sql(_SQ)}) s USING (sample_id, channel, frame)""")
def _(t):
    views = F.array(*[F.struct(F.lit(n).alias("view"), tr.temporal_view(F.col("values"), n).alias("x")) for n in tr.VIEWS])
    rows = traces16(t).select(F.explode(views).alias("v")).select("v.view", F.explode("v.x").alias("x"))
    out = rows.groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
    return out.select("view", "n", F.when(F.col("view") == "local_norm", r6(F.col("s"), 3)).otherwise(r6(F.col("s"), 4)).alias("total"))


@query("T15_masked_derivative", f"""SELECT sample_id, channel, frame, {q6('''CASE WHEN present = 1 AND pb = 1 AND pa = 1 THEN (va - vb) / (2 * 0.5)
  WHEN present = 1 AND pa = 1 THEN (va - value) / 0.5 WHEN present = 1 AND pb = 1 THEN (value - vb) / 0.5 ELSE 0.0 END''')} AS value FROM (
  SELECT *, lag(present) OVER w AS pb, lead(present) OVER w AS pa, lag(value) OVER w AS vb, lead(value) OVER w AS va
  FROM ({PGRID}) WINDOW w AS (PARTITION BY sample_id, channel ORDER BY frame))""")
def _(t):
    return long_form(traces16(t), tr.masked_derivative(F.col("values"), F.col("present"), 0.5))


# poses: 8 channels of 8 frames as Body xyz, Head xyz and two face channels
_POSES = f"""SELECT sample_id, (pos // 8)::INTEGER AS c, pos % 8 AS frame, CASE WHEN pos < 24 THEN 'Body' WHEN pos < 48 THEN 'Head' ELSE 'Facial' END AS modality,
  ((pos // 8) % 3)::INTEGER AS ix, value, CAST({h32("'q:' || sample_id || ':' || CASE WHEN pos < 24 THEN 'Body' WHEN pos < 48 THEN 'Head' ELSE 'Facial' END || ':' || pos % 8")} % 4 <> 0 AS INTEGER) AS present
  FROM (SELECT sample_id, frame AS pos, value FROM ({SERIES}))"""


def poses(t):
    e = t.read("embeddings").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(7))))
    modality = F.when(F.col("c") < 3, "Body").when(F.col("c") < 6, "Head").otherwise("Facial")
    e = e.withColumn("modality", modality)
    values = F.transform(F.slice("embedding", F.col("c") * 8 + 1, F.lit(8)), lambda x: x.cast("double"))
    present = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda f: (draw("q", F.col("vec_id"), F.col("modality"), f) % 4 != 0).cast("int"))
    return e.select(F.col("vec_id").alias("sample_id"), "modality", F.lit("raw").alias("block"), (F.col("c") % 3).alias("ix"),
                    values.alias("values"), present.alias("present"))


@query("T16_root_relative", f"""SELECT h.sample_id, 'relpos_pose_' || ['x', 'y', 'z'][h.ix + 1] AS block, h.frame, {q6('h.value - b.value')} AS value, h.present * b.present AS present
  FROM ({_POSES}) h JOIN ({_POSES}) b ON h.sample_id = b.sample_id AND h.ix = b.ix AND h.frame = b.frame WHERE h.modality = 'Head' AND b.modality = 'Body'""")
def _(t):
    out = rep.root_relative(poses(t)).select("sample_id", "block", F.posexplode(F.arrays_zip("values", "present")).alias("frame", "z"))
    return out.select("sample_id", "block", F.col("frame").cast("bigint").alias("frame"), r6(F.col("z.values")).alias("value"), F.col("z.present").alias("present"))


@query("T17_acceleration", f"""SELECT sample_id, ix, frame, {q6('''CASE WHEN present = 1 AND pb = 1 AND pa = 1 THEN (va - vb) / (2 * 0.25)
  WHEN present = 1 AND pa = 1 THEN (va - value) / 0.25 WHEN present = 1 AND pb = 1 THEN (value - vb) / 0.25 ELSE 0.0 END''')} AS value FROM (
  SELECT *, lag(present) OVER w AS pb, lead(present) OVER w AS pa, lag(value) OVER w AS vb, lead(value) OVER w AS va
  FROM ({_POSES}) WHERE modality = 'Facial' WINDOW w AS (PARTITION BY sample_id, c ORDER BY frame))""")
def _(t):
    moved = poses(t).withColumn("block", F.lit("motion"))
    return long_form(rep.acceleration(moved, 0.25, ["Facial"]), F.col("values"), keys=("sample_id", "ix"))


@query("T18_action_units", f"""SELECT sample_id, u AS unit, frame, {q6('avg(value)')} AS value FROM ({_POSES}) JOIN (VALUES ('brow', 0), ('brow', 1), ('cheek', 1)) m(u, i) ON i = ix
  WHERE modality = 'Facial' GROUP BY 1, 2, 3""")
def _(t):
    out = rep.action_units(poses(t), members={"brow": [0, 1], "cheek": [1]})
    return long_form(out, F.col("values"), keys=("sample_id", "block")).withColumnRenamed("block", "unit")


@query("T19_channel_drop", f"SELECT modality, ix, count(*) AS n FROM ({_POSES}) WHERE modality = 'Facial' OR (modality = 'Body' AND ix = 1) GROUP BY 1, 2")
def _(t):
    dropped = rep.dropped_channels(t.spark, keep_height_of="Body", table={"Body": {"pose": 0}, "Head": {"pose": 0}})
    kept = rep.drop_channels(poses(t), dropped)
    return kept.select("modality", "ix", F.explode("values").alias("x")).groupBy("modality", "ix").agg(F.count(F.lit(1)).alias("n"))


@query("T20_derived_standardization", f"""SELECT p.sample_id, p.modality, p.ix, frame, {q6('CASE WHEN present = 1 THEN (value - mean) / scale ELSE 0.0 END', 5)} AS value FROM ({_POSES}) p
  JOIN (SELECT modality, ix, avg(value) AS mean, greatest(stddev_pop(value), 1e-6) AS scale FROM ({_POSES}) WHERE present = 1 AND sample_id % 3 <> 0 GROUP BY 1, 2) f ON f.modality = p.modality AND f.ix = p.ix""")
def _(t):
    rows = poses(t)
    out = rep.apply_derived(rows, rep.fit_derived(rows.filter(F.col("sample_id") % 3 != 0)))
    return long_form(out, F.col("values"), digits=5, keys=("sample_id", "modality", "ix"))


@query("T21_mirror_copies", f"""SELECT sample_id::VARCHAR AS sample_id, modality, ix, frame, {q6('value')} AS value FROM ({_POSES})
  UNION ALL SELECT sample_id || '-mirror', modality, CASE WHEN modality = 'Facial' THEN 1 - ix ELSE ix END, frame,
    {q6("CASE WHEN modality <> 'Facial' AND ix = 0 THEN -value ELSE value END")} FROM ({_POSES}) WHERE sample_id % 2 = 0""")
def _(t):
    table = [r for r in rep.mirror_table(("Head", "Body", "Facial")) if r[1] == "raw"]
    return long_form(rep.with_mirror_copies(poses(t), F.col("sample_id") % 2 == 0, table), F.col("values"), keys=("sample_id", "modality", "ix"))


@query("T22_z_normalise", f"""SELECT sample_id, channel, frame, {q6('(value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8)', 5)} AS value
  FROM ({GRID}) WINDOW w AS (PARTITION BY sample_id, channel)""")
def _(t):
    return long_form(traces16(t), tr.z_normalised(F.col("values")), digits=5)


@query("T23_periodogram", f"""SELECT sample_id, channel, f AS frame, {q6('sqrt(pow(sum(value * cos(2 * pi() * f * frame / 16)), 2) + pow(sum(value * sin(2 * pi() * f * frame / 16)), 2))', 5)} AS value
  FROM ({GRID}), (SELECT unnest(range(0, 8)) AS f) GROUP BY 1, 2, 3""")
def _(t):
    return long_form(traces16(t), tr.periodogram(F.col("values"), 16), digits=5)


@query("T24_source_positions", f"""SELECT sample_id, channel, frame, CASE WHEN channel % 2 = 0 THEN frame - 2.5::DOUBLE ELSE 7.5 + (frame - 7.5) / 1.25::DOUBLE END AS position FROM ({GRID})""")
def _(t):
    f = F.col("frame").cast("double")
    shift, scale = tr.source_position(f, 16, "shift", 2.5), tr.source_position(f, 16, "scale", 1.25)
    return t.grid.select("sample_id", "channel", "frame", F.when(F.col("channel") % 2 == 0, shift).otherwise(scale).alias("position"))


_WARP = f"""SELECT g.sample_id, g.channel, g.frame, CASE WHEN p < 0 OR p > 15 THEN 0.0 ELSE a.value + (b.value - a.value) * (p - floor(p)) END AS linear,
  CASE WHEN round_even(p, 0) BETWEEN 0 AND 15 THEN n.present ELSE 0 END AS present
  FROM (SELECT *, 7.5 + (frame - 7.5) / 0.8::DOUBLE AS p FROM ({PGRID})) g
  LEFT JOIN ({PGRID}) a ON a.sample_id = g.sample_id AND a.channel = g.channel AND a.frame = floor(p)
  LEFT JOIN ({PGRID}) b ON b.sample_id = g.sample_id AND b.channel = g.channel AND b.frame = least(floor(p) + 1, 15)
  LEFT JOIN ({PGRID}) n ON n.sample_id = g.sample_id AND n.channel = g.channel AND n.frame = round_even(p, 0)"""


@query("T25_grid_warp", f"SELECT sample_id, channel, frame, {q6('CASE WHEN present = 1 THEN linear ELSE 0.0 END')} AS value, present::DOUBLE AS present FROM ({_WARP})")
def _(t):
    seen = F.transform("present", lambda p: p.cast("double"))
    warped = traces16(t).withColumn("present", seen).select(
        "sample_id", "channel", tr.linear_warp(F.col("values"), 16, "scale", 0.8).alias("v"), tr.nearest_warp(F.col("present"), 16, "scale", 0.8).alias("p"))
    masked = tr.collapse_near_constant(F.zip_with("v", "p", lambda a, b: F.when(b != 0, a * b).otherwise(F.lit(0.0))))
    out = warped.select("sample_id", "channel", F.posexplode(F.arrays_zip(masked.alias("v"), F.col("p"))).alias("frame", "z"))
    return out.select("sample_id", "channel", F.col("frame").cast("bigint").alias("frame"), r6(F.col("z.v")).alias("value"), F.col("z.p").alias("present"))


@query("T26_event_time_warp", f"""SELECT anchor_id, event_id, CASE WHEN event_type = 'click' THEN offset_ms + 3 * 250.0::DOUBLE WHEN event_type = 'view' THEN 1.2::DOUBLE * offset_ms ELSE offset_ms::DOUBLE END AS warped FROM ({_SPEAKER})""")
def _(t):
    from anchorgrid.operators.warp import warp_events
    rows = speaker_windows(t).withColumn("t0", F.lit(0)).withColumn("warped", F.col("offset_ms").cast("double"))
    rows = warp_events(rows, ["click"], "shift", 3, step_ms=250.0, t="warped", t_anchor="t0")
    rows = warp_events(rows, ["view"], "scale", 1.2, step_ms=250.0, t="warped", t_anchor="t0")
    return rows.select("anchor_id", "event_id", "warped")


@query("T27_shift_without_wrap", f"""SELECT g.sample_id, g.channel, g.frame, {q6('coalesce(s.value, 0.0)')} AS value FROM ({GRID}) g LEFT JOIN ({GRID}) s
  ON s.sample_id = g.sample_id AND s.channel = g.channel AND s.frame = g.frame - ({h32("'7:' || g.sample_id")} % 5 - 2)""")
def _(t):
    shift = (draw(7, F.col("sample_id")) % 5 - 2).cast("int")
    return long_form(traces16(t), tr.shift_without_wrap(F.col("values"), shift))


@query("T27_observed_noise")
def _(t):
    noisy = tr.add_noise(F.col("values"), F.col("present"), 0.05, 7, F.col("sample_id"), F.col("channel"))
    return long_form(traces16(t), noisy)


@query("T28_masked_pooling", f"""SELECT sample_id, channel, region, {q6('coalesce(avg(value) FILTER (present = 1), 0.0)')} AS mean, {q6('coalesce(max(value) FILTER (present = 1), 0.0)')} AS maximum,
  {q6('coalesce(stddev_pop(value) FILTER (present = 1), 0.0)')} AS std FROM ({PGRID}), (VALUES ('pre'), ('post'), ('global')) r(region)
  WHERE region = 'global' OR (region = 'pre') = (frame < 8) GROUP BY 1, 2, 3""")
def _(t):
    times = [i - 8.0 for i in range(16)]
    parts = F.array(*[F.struct(F.lit(r).alias("region"), tr.pooled(F.col("values"), F.col("present"), times, r).alias("s")) for r in tr.REGIONS])
    out = traces16(t).select("sample_id", "channel", F.explode(parts).alias("p"))
    return out.select("sample_id", "channel", "p.region", *[r6(F.col(f"p.s.{m}")).alias(m) for m in ("mean", "maximum", "std")])


@query("T29_clips", f"SELECT sample_id, channel, frame // 4 AS clip, {q6('avg(value)')} AS mean FROM ({GRID}) GROUP BY 1, 2, 3")
def _(t):
    out = traces16(t).select("sample_id", "channel", F.posexplode(tr.clips(F.col("values"), 4)).alias("clip", "x"))
    return out.select("sample_id", "channel", F.col("clip").cast("bigint").alias("clip"), r6(tr.mean(F.col("x"))).alias("mean"))


@query("T30_trajectories", f"""SELECT sample_id, channel, count(*)::INTEGER AS frames, {q6('sum(value)')} AS total, min(frame)::INTEGER AS first_frame
  FROM ({PGRID}) WHERE present = 1 GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(t):
    from anchorgrid.operators.similarity import trajectories
    out = trajectories(traces16(t), ["sample_id", "channel"])
    return out.select("sample_id", "channel", F.size("values").alias("frames"), r6(tr.total(F.col("values"))).alias("total"), F.col("time_ix")[0].alias("first_frame"))


@query("W5_moving_frame", f"""SELECT event_id, {q6('avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS smooth FROM ({EV})""")
def _(t):
    from anchorgrid.operators.ordered import centred_mean
    return centred_mean(t.ev, ["user_id"], ["t", "event_id"], "value", 2, "smooth").select("event_id", r6(F.col("smooth")).alias("smooth"))


# -- tokens -----------------------------------------------------------------------------------

# clips of 8 values; the codebook holds the 8 clip means of the classes' mean vectors
_CLIPS = f"SELECT sample_id, label, class10, (channel * 16 + frame) // 8 AS clip, frame % 8 AS i, value FROM ({GRID})"
_BOOK = f"SELECT class10 AS code, i, round(avg(value), 4) AS v FROM ({_CLIPS}) GROUP BY 1, 2"
_CODES = f"""SELECT sample_id, label, clip, arg_min(code, d * 1000000000000 + code) AS code FROM (SELECT sample_id, label, clip, code, round(sum((value - v) * (value - v)), 10) AS d
  FROM ({_CLIPS}) c JOIN ({_BOOK}) b USING (i) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""


def clip_rows(t):
    e = t.read("embeddings").select(
        F.col("vec_id").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"), F.col("label").alias("class10"),
        F.posexplode(tr.clips(F.transform("embedding", lambda x: x.cast("double")), 8)).alias("clip", "vector"))
    return e.withColumn("clip", F.col("clip").cast("bigint"))


def codebook(t):
    flat = clip_rows(t).select("class10", F.posexplode("vector").alias("i", "x")).groupBy("class10", "i").agg(F.round(F.avg("x"), 4).alias("v"))
    packed = flat.groupBy(F.col("class10").alias("code")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
    return packed.select("code", F.col("p.v").alias("vector"))


def coded(t):
    return tk.nearest_code(clip_rows(t), codebook(t), "vector")


@query("J8_nearest_code", f"SELECT sample_id, clip, code::BIGINT AS code FROM ({_CODES})")
def _(t):
    return coded(t).select("sample_id", "clip", "code")


def token_rows(t):
    return tk.collect_tokens(coded(t), "sample_id", "clip", "code", ["label"])


_TOK = f"SELECT sample_id, label, list(code::BIGINT ORDER BY clip) AS tokens FROM ({_CODES}) GROUP BY 1, 2"
_text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


@query("K1_learn_codebook")
def _(t):
    book = tk.fit_codebook(clip_rows(t), "vector", 16)
    return tk.nearest_code(clip_rows(t), book, "vector").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("K2_tokenize", f"SELECT sample_id, label, array_to_string(tokens, ',') AS tokens FROM ({_TOK})")
def _(t):
    return token_rows(t).select("sample_id", "label", _text("tokens").alias("tokens"))


@query("K3_J9_grouped_tokens", f"""SELECT sample_id, label, array_to_string(list(CASE WHEN clip < 4 THEN code ELSE code + 10 END ORDER BY clip), ',') AS tokens FROM ({_CODES}) GROUP BY 1, 2""")
def _(t):
    groups = coded(t).withColumn("group_ix", F.expr("cast(clip div 4 as int)"))
    per = tk.collect_tokens(groups, "sample_id", "clip", "code", ["label", "group_ix"])
    return tk.merge_groups(per, 10, 2).select("sample_id", "label", _text("tokens").alias("tokens"))


_AT = tk.Layout(10, 8)


@query("K4_classify_example", f"""SELECT sample_id, '{_AT.task + 3},{_AT.som},' || array_to_string(tokens, ',') || ',{_AT.eom}' AS encoder, ({_AT.answer} + label) || ',{_AT.eos}' AS decoder FROM ({_TOK})""")
def _(t):
    e, d = tk.classify_example(_AT, F.col("tokens"), F.col("label"))
    return token_rows(t).select("sample_id", _text(e).alias("encoder"), _text(d).alias("decoder"))


def _chosen_sql(low, high, count, name):
    drawn = h60(f"'{name}:' || sample_id || ':' || i")
    return f"list_sort([z.i FOR z IN list_sort([{{'h': {drawn}, 'i': i}} FOR i IN range({low}, {high} + 1)])[1:{count}]])"


# eight tokens, four of them hidden in two spans
@query("K5_span_corruption", f"""SELECT sample_id, '{_AT.task},{_AT.som},' || array_to_string(list_concat(tokens[1:b1], [{_AT.sentinel}], tokens[e1 + 1:b2], [{_AT.sentinel + 1}], tokens[e2 + 1:8]), ',') || ',{_AT.eom}' AS encoder,
  array_to_string(list_concat([{_AT.sentinel}], tokens[b1 + 1:e1], [{_AT.sentinel + 1}], tokens[b2 + 1:e2], [{_AT.eos}]), ',') AS decoder
  FROM (SELECT *, place[1] AS b1, place[1] + cut[1] AS e1, place[2] + cut[1] AS b2, place[2] + 4 AS e2 FROM (SELECT *, {_chosen_sql(1, 3, 1, 'cut')} AS cut, {_chosen_sql(0, 4, 2, 'place')} AS place FROM ({_TOK})))""")
def _(t):
    made = tk.denoise_examples(token_rows(t), _AT, "tokens", "sample_id", rate=0.5)
    return made.select("sample_id", _text("encoder_input").alias("encoder"), _text("decoder_target").alias("decoder"))


@query("K6_predict_tail", f"""SELECT sample_id, '{_AT.task + 1},{_AT.som},' || array_to_string(tokens[1:4], ',') || ',{_AT.eom}' AS encoder, array_to_string(tokens[5:8], ',') || ',{_AT.eos}' AS decoder FROM ({_TOK})""")
def _(t):
    e, d = tk.predict_example(_AT, F.col("tokens"))
    return token_rows(t).select("sample_id", _text(e).alias("encoder"), _text(d).alias("decoder"))


@query("K7_inbetween", f"""SELECT sample_id, '{_AT.task + 2},{_AT.som},' || array_to_string(tokens[1:s], ',') || ',{_AT.sentinel},' || array_to_string(tokens[s + 3:8], ',') || ',{_AT.eom}' AS encoder,
  array_to_string(tokens[s + 1:s + 2], ',') || ',{_AT.eos}' AS decoder FROM (SELECT *, 1 + {h32("'inbetween:' || sample_id")} % 5 AS s FROM ({_TOK}))""")
def _(t):
    e, d = tk.inbetween_example(_AT, F.col("tokens"), F.col("sample_id"))
    return token_rows(t).select("sample_id", _text(e).alias("encoder"), _text(d).alias("decoder"))


@query("K8_task_choice", f"SELECT vec_id, ['denoise', 'predict', 'inbetween'][1 + {h32("'42:3:' || vec_id")} % 3] AS task FROM embeddings")
def _(t):
    return t.read("embeddings").select("vec_id", tk.task_choice(F.col("vec_id"), 3).alias("task"))


@query("K9_pad_batch", f"""SELECT sample_id, batch, array_to_string(e, ',') || repeat(',{_AT.pad}', (ml - len(e))::INTEGER) AS encoder_padded, '{_AT.bos},' || array_to_string(d[1:len(d) - 1], ',') || repeat(',{_AT.pad}', (md - len(d))::INTEGER) AS decoder_input,
  array_to_string(d, ',') || repeat(',-100', (md - len(d))::INTEGER) AS labels FROM (SELECT *, max(len(e)) OVER (PARTITION BY batch) AS ml, max(len(d)) OVER (PARTITION BY batch) AS md FROM (
    SELECT sample_id, sample_id // 16 AS batch, list_concat([{_AT.task + 1}, {_AT.som}], list_concat(tokens[1:3 + sample_id % 4], [{_AT.eom}])) AS e, list_concat(tokens[4 + sample_id % 4:8], [{_AT.eos}]) AS d FROM ({_TOK})))""")
def _(t):
    n = (3 + F.col("sample_id") % 4).cast("int")
    rows = token_rows(t).select(
        "sample_id", tk._block(_AT, "predict", F.slice("tokens", F.lit(1), n)).alias("encoder_input"),
        tk._end(_AT, F.slice("tokens", n + 1, 8 - n)).alias("decoder_target"))
    out = tk.pad_batch(rows, _AT, F.expr("sample_id div 16"))
    return out.select("sample_id", "batch", *[_text(c).alias(c) for c in ("encoder_padded", "decoder_input", "labels")])


@query("K10_random_tokens", f"""SELECT sample_id, clip, CASE WHEN {h32("'replace:9:' || sample_id || ':' || clip")} / 4294967296.0::DOUBLE < 0.3 THEN {h32("'code:9:' || sample_id || ':' || clip")} % 10 ELSE code END AS code FROM ({_CODES})""")
def _(t):
    # key parts come in the order of the hash text
    changed = tk.random_tokens(F.col("tokens"), 10, 0.3, 9, F.col("sample_id"))
    out = token_rows(t).select("sample_id", F.posexplode(changed).alias("clip", "code"))
    return out.withColumn("clip", F.col("clip").cast("bigint"))


@query("K11_slot_masks", f"""SELECT batch, event_type, step, u < 0.05 OR (min(u) OVER (PARTITION BY batch) >= 0.05 AND row_number() OVER (PARTITION BY batch ORDER BY h, event_type, step) = 1) AS masked
  FROM (SELECT batch, event_type, step, {h32("'42:' || batch || ':' || event_type || ':' || step")} / 4294967296.0::DOUBLE AS u, {h60("'42:slot:' || batch || ':' || event_type || ':' || step")} AS h
  FROM (SELECT DISTINCT user_id AS batch, event_type, t // 86400000 AS step FROM ({EV})))""")
def _(t):
    slots = t.ev.select(F.col("user_id").alias("batch"), "event_type", F.expr("t div 86400000").alias("step"))
    return tk.slot_masks(slots, ["batch"], ["event_type", "step"], 0.05)


@query("K12_reconstruction_loss", f"""SELECT kind, {q6('avg(CASE WHEN kind = 1 THEN abs(value - 0.1) WHEN kind = 2 THEN pow(value - 0.1, 2) WHEN abs(value - 0.1) < 1 THEN 0.5 * pow(value - 0.1, 2) ELSE abs(value - 0.1) - 0.5 END)')} AS frame_loss,
  {q6('avg(CASE WHEN d IS NULL THEN NULL WHEN kind = 1 THEN abs(d) WHEN kind = 2 THEN d * d WHEN abs(d) < 1 THEN 0.5 * d * d ELSE abs(d) - 0.5 END)')} AS velocity_loss
  FROM (SELECT *, lead(value) OVER (PARTITION BY sample_id, channel ORDER BY frame) - value AS d FROM ({GRID})), (VALUES (1), (2), (3)) l(kind) GROUP BY kind""")
def _(t):
    out = None
    flat = F.transform("values", lambda _: F.lit(0.1))
    for kind, name in ((1, "l1"), (2, "l2"), (3, "smooth_l1")):
        a, b = tk.reconstruction_loss(F.col("values"), flat, name)
        part = traces16(t).select(a.alias("a"), b.alias("b")).agg(
            r6(F.sum("a.total") / F.sum("a.n")).alias("frame_loss"), r6(F.sum("b.total") / F.sum("b.n")).alias("velocity_loss"))
        part = part.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("A27_token_statistics", f"""SELECT c.label, count(*) AS used_codes, count(*) / 10.0::DOUBLE AS usage, {q6('-sum(n / t * ln(n / t))')} AS entropy, {q6('exp(-sum(n / t * ln(n / t)))')} AS perplexity,
  {q6('any_value(mu)')} AS mean_unique, {q6('-8 * ln(10.0)')} AS uniform_log_likelihood FROM (SELECT label, code, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY label)::DOUBLE AS t FROM ({_CODES}) GROUP BY 1, 2) c
  JOIN (SELECT label, avg(u) AS mu FROM (SELECT label, sample_id, count(DISTINCT code) AS u FROM ({_CODES}) GROUP BY 1, 2) GROUP BY 1) u ON u.label = c.label GROUP BY c.label""")
def _(t):
    s = tk.token_statistics(token_rows(t), 10, ["label"])
    return s.select("label", "used_codes", "usage", *[r6(F.col(c)).alias(c) for c in ("entropy", "perplexity", "mean_unique", "uniform_log_likelihood")])


@query("A28_latent_norms", f"""SELECT label, {q6('avg(n)')} AS mean_norm, (SELECT {q6('stddev_samp(value)')} FROM ({SERIES})) AS latent_std FROM (
  SELECT label, sample_id, sqrt(sum(value * value)) AS n FROM ({SERIES}) GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    from anchorgrid.operators.similarity import latent_statistics
    return latent_statistics(t.read("embeddings").select((F.col("label") >= 5).cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v")), "v", ["label"])
