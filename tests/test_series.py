import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorgrid.functions import face, naming, traces as tr, values as v
from anchorgrid.functions.channels import channel_table
from anchorgrid.operators import grid, motion, representation as rep


def test_channel_counts(spark):
    assert channel_table(spark).count() == 698
    assert len(face.BLENDSHAPES) == 63 and len(face.unit_members()) == 27 and len(face.unit_members("negation")) == 11
    members = sorted(i for m in face.unit_members().values() for i in m)
    assert members == [i for i in range(63) if not 14 <= i <= 21]  # all but the gaze shapes, once


def test_mirror_is_an_involution():
    assert all(face.mirror_partner(face.mirror_partner(n)) == n and face.mirror_partner(n) in face.BLENDSHAPES for n in face.BLENDSHAPES)
    table = {(r[0], r[1], r[2]): (r[3], r[4], r[5]) for r in rep.mirror_table()}
    assert len(table) == 698
    for (m, block, ix), (sm, sx, sign) in table.items():
        back = table[(sm, block, sx)]
        assert back[:2] == (m, ix) and sign * back[2] == 1.0


def test_resample_edges(spark):
    rows = [(1, 10, 1.0), (1, 10, 3.0), (1, 55, 4.0), (2, 26, 5.0), (3, 25, 7.0), (4, 0, 1.0), (4, 100, 2.0)]
    df = spark.createDataFrame(rows, "id int, t bigint, x double")
    out = grid.resample(df, ["id"], "t", "x", start_ms=0, stop_ms=100, points=5)
    got = {(r.id, r.frame): r.x for r in out.collect()}
    want = {(2, 1): 5.0, (3, 1): 7.0}
    for g in (25, 50):
        want[(1, g // 25)] = float(np.interp(g, [10, 55], [2.0, 4.0]))
    for g in range(0, 101, 25):
        want[(4, g // 25)] = 1 + g / 100
    assert got == pytest.approx(want)
    dense = {r.id: (r["values"], r.present) for r in grid.to_traces(out, ["id"], "x", 5).collect()}
    assert dense[2] == ([0, 5.0, 0, 0, 0], [0, 1, 0, 0, 0])


def test_trace_functions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=12)
    df = spark.createDataFrame([(x.tolist(), [2.0] * 11 + [2.0 + 1e-9])], "a array<double>, flat array<double>")
    a = F.col("a")
    row = df.select(
        tr.moving_average(a, 5).alias("ma"), tr.difference(a, 2).alias("d2"), tr.std(a).alias("s"), tr.collapse_near_constant(F.col("flat")).alias("flat"),
        tr.linear_warp(a, 12, "shift", 1.5).alias("w"), tr.shift_without_wrap(a, F.lit(-3)).alias("sh"), tr.periodogram(a, 12).alias("p")).first()
    padded = np.pad(x, 2, mode="reflect")
    assert row.ma == pytest.approx(np.convolve(padded, np.ones(5) / 5, "valid").tolist())
    assert row.d2 == pytest.approx(np.diff(x, 2).tolist()) and row.s == pytest.approx(x.std())
    assert len(set(row.flat)) == 1
    assert row.w == pytest.approx(np.interp(np.arange(12) - 1.5, np.arange(12), x, left=0, right=0).tolist())
    assert row.sh == pytest.approx(np.r_[x[3:], np.zeros(3)].tolist())
    assert row.p == pytest.approx(np.abs(np.fft.fft(x))[:6].tolist())


def test_angular_velocity(spark):
    def q(angle, axis):
        return [*(np.sin(angle / 2) * np.array(axis)), np.cos(angle / 2)]

    cases = [(q(0.5, (0, 0, 1)), q(0.1, (0, 0, 1)), 2.0, (0, 0, 0.2)), (q(0.1, (1, 0, 0)), [-c for c in q(0.4, (1, 0, 0))], 1.0, (-0.3, 0, 0)),
             (q(0.3, (0, 1, 0)), q(0.3, (0, 1, 0)), 1.0, (0, 0, 0)), (q(0.3, (0, 1, 0)), q(0.1, (0, 1, 0)), 0.0, (0, 0, 0))]
    df = spark.createDataFrame([(list(map(float, a)), list(map(float, b)), s) for a, b, s, _ in cases], "a array<double>, b array<double>, s double")
    got = [r[0] for r in df.select(motion.angular_velocity(F.col("a"), F.col("b"), F.col("s"))).collect()]
    for g, case in zip(got, cases):
        assert g == pytest.approx(case[3], abs=1e-9)


def test_full_modality_vectors(spark):
    q = "struct<x:double,y:double,z:double,w:double>"
    p = f"struct<Position:struct<x:double,y:double,z:double>,Orientation:{q}>"
    schema = (f"boneRotations array<{q}>, handConfidence bigint, handScale double, pointerPose {p}, rootPose {p}, fingerConfidences array<bigint>, "
              "pinchStrength array<double>, expressionWeights array<double>, conf array<double>, status struct<IsValid:boolean,IsEyeFollowingBlendshapesValid:boolean>")
    pose = ((1.0, 2.0, 3.0), (0.0, 0.0, 0.0, -2.0))
    row = ([(0.0, 0.0, 0.0, 1.0)] * 26, 1065353216, 0.5, pose, pose, [1065353216, 0, 1], [1.0], [0.5] * 70, None, (True, None))
    df = spark.createDataFrame([row], schema)
    hand = motion.finger_vector({c: F.col(c) for c in ("boneRotations", "handConfidence", "handScale", "pointerPose", "rootPose", "fingerConfidences", "pinchStrength")})
    out = df.select(hand.alias("h"), motion.face_vector(F.col("expressionWeights"), F.col("conf"), F.col("status")).alias("f")).first()
    assert len(out.h) == 130 and out.h[:9] == [1.0, 0.5, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0] and out.h[120:126] == [1.0, 0.0, 1.0, 0.0, 0.0, 1.0]
    assert len(out.f) == 67 and out.f[62:] == [0.5, 0.0, 0.0, 1.0, 0.0]
    wide = spark.createDataFrame([("Head", 1, 0, [0.0] * 6 + [1.0]), ("Head", 1, 500, [1.0] + [0.0] * 5 + [1.0]), ("LeftFinger", 1, 0, out.h)],
                                 "event_type string, s int, t bigint, features array<double>")
    moved = motion.with_motion(wide, ["s", "event_type"], ["t"], "t").orderBy("event_type", "t").collect()
    assert [len(r.features) for r in moved] == [13, 13, 226] and moved[1].features[7:] == [2.0, 0, 0, 0, 0, 0] and moved[0].features[7:] == [0.0] * 6


def test_names(spark):
    df = spark.createDataFrame([("tgt-cue_bal-05_src-listener_wL-m500_wR-1500_spl-10",), ("target-scope_window-250",), ("tgt-cue_src-cat_window-1",), ("x_wL-5_wR-m5_",)], "n string")
    got = [tuple(r) for r in df.select(naming.parse_family(F.col("n")).alias("f")).select("f.*").collect()]
    assert got[0] == ("cue", "listener", False, -500, 1500, None)
    assert got[1] == ("scope", "speaker", True, 250, 250, None)
    assert got[2][5] == "source_unknown cat" and got[3][5] == "window bounds are empty"
    ids = spark.createDataFrame([('Word:[-5, r"Player:[2, s\\"a\\"]", 7]',), ("Word:abc",)], "n string")
    parsed = [r[0] for r in ids.select(naming.parse_word_id(F.col("n"))).collect()]
    assert tuple(parsed[0]) == (-5, 2, "a", 7) and parsed[1] is None


def test_confidence_bits(spark):
    import struct

    numbers = [0.25, 1.5, 1e-40, -3.0, 0.1]
    bits = [struct.unpack("<I", struct.pack("<f", x))[0] for x in numbers] + [0, 1, 0x7F800000]
    df = spark.createDataFrame([(b,) for b in bits], "b bigint")
    got = [r[0] for r in df.select(v.decoded_confidence(F.col("b"))).collect()]
    want = [struct.unpack("<f", struct.pack("<f", x))[0] for x in numbers] + [0.0, 1.0, float(0x7F800000)]
    assert got == pytest.approx(want, rel=1e-12, abs=1e-50)
