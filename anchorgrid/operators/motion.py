"""Per-event feature vectors and their first-order motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anchorgrid.functions import values as v
from anchorgrid.functions.channels import FLAG_WIDTH, MOTION_WIDTH
from anchorgrid.functions.traces import let
from anchorgrid.operators.ordered import Ordered


def extract(events: DataFrame, vectors: dict[str, Column], default: Column | None = None) -> DataFrame:
    """Add ``features`` by event type; without a default an unknown type is an error."""
    chosen = None
    for kind, vector in vectors.items():
        test = F.col("event_type") == kind
        chosen = F.when(test, vector) if chosen is None else chosen.when(test, vector)
    other = default if default is not None else F.raise_error(
        F.concat(F.lit("unknown event type "), F.col("event_type"))).cast("array<double>")
    return events.withColumn("features", chosen.otherwise(other))


def eye_vector(gazes: Column) -> Column:
    """18 values: per eye confidence, validity, position and orientation."""
    parts = []
    for i in range(2):
        g = F.get(gazes, F.lit(i))
        parts += [
            F.array(F.coalesce(v.finite(g["Confidence"]), F.lit(0.0)),
                    F.coalesce(g["IsValid"].cast("double"), F.lit(0.0))),
            v.position(g["Pose"]["Position"]), v.quaternion(g["Pose"]["Orientation"]),
        ]
    return F.concat(*parts)


def face_vector(weights: Column, confidences: Column, status: Column) -> Column:
    """67 values: 63 blendshapes, 2 confidences, 2 validity flags."""
    flag = lambda name: F.coalesce(status[name].cast("double"), F.lit(0.0))
    return F.concat(
        v.fixed_array(weights, 63), v.fixed_array(confidences, 2),
        F.array(flag("IsValid"), flag("IsEyeFollowingBlendshapesValid")),
    )


def pose_vector(position: Column, rotation: Column) -> Column:
    return F.concat(v.position(position), v.quaternion(rotation))


def finger_vector(event: dict[str, Column]) -> Column:
    """130 values of one tracked hand; rows with fewer than 26 bones never get here."""
    bones = F.flatten(F.transform(F.slice(event["boneRotations"], 1, 26), v.quaternion))
    confidences = F.array(*[
        F.coalesce(v.decoded_confidence(F.get(event["fingerConfidences"], F.lit(i))), F.lit(0.0)) for i in range(5)])
    return F.concat(
        F.array(v.decoded_confidence(event["handConfidence"]), v.finite(event["handScale"])),
        v.pose((event["pointerPose"]["Position"], event["pointerPose"]["Orientation"])),
        v.pose((event["rootPose"]["Position"], event["rootPose"]["Orientation"])),
        bones, confidences, v.fixed_array(event["pinchStrength"], 5),
    )


_PLACE, _TURN = "struct<x:double,y:double,z:double>", "struct<x:double,y:double,z:double,w:double>"
_POSE = f"struct<Position:{_PLACE},Orientation:{_TURN}>"

#: Payload of each event type. Confidences are text, since a bit pattern and a number differ in how they are written.
PAYLOADS = {
    "Eye": f"eyeGazes array<struct<Confidence:double,IsValid:boolean,Pose:{_POSE}>>",
    "Facial": "expressionWeights array<double>, expressionWeightConfidences array<double>, status struct<IsValid:boolean,IsEyeFollowingBlendshapesValid:boolean>",
    **dict.fromkeys(("Head", "Body", "LeftHand", "RightHand"), f"position {_PLACE}, rotation {_TURN}"),
    **dict.fromkeys(("LeftFinger", "RightFinger"), (
        f"handConfidence string, handScale double, pointerPose {_POSE}, rootPose {_POSE}, boneRotations array<{_TURN}>, "
        "fingerConfidences array<string>, pinchStrength array<double>")),
}

#: Feature vector of each event type from its parsed payload.
VECTORS = {
    "Eye": lambda p: eye_vector(p["eyeGazes"]),
    "Facial": lambda p: face_vector(p["expressionWeights"], p["expressionWeightConfidences"], p["status"]),
    **dict.fromkeys(("Head", "Body", "LeftHand", "RightHand"), lambda p: pose_vector(p["position"], p["rotation"])),
    **dict.fromkeys(("LeftFinger", "RightFinger"), lambda p: finger_vector(p)),
}


def extract_payloads(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``features`` from the JSON ``payload`` by event type: each row is parsed once, with the schema of its type.

    Finger events with fewer than 26 bones are heartbeats without a measurement and go; an unknown type is an error.
    """
    vectors = {kind: let(F.from_json(F.col(payload), PAYLOADS[kind]), VECTORS[kind]) for kind in PAYLOADS}
    fingers = F.col("event_type").isin("LeftFinger", "RightFinger")
    bones = F.json_array_length(F.get_json_object(payload, "$.boneRotations"))
    return extract(events.filter(~fingers | (F.coalesce(bones, F.lit(0)) >= 26)), vectors)


def finger_flags(status: Column, pinches: Column) -> Column:
    """13 flags: 8 status bits and 5 pinch bits."""
    return F.concat(v.bit_flags(status, 8), v.bit_flags(pinches, FLAG_WIDTH["LeftFinger"] - 8))


# -- motion -------------------------------------------------------------------------------


def rate(current: Column, previous: Column, seconds: Column) -> Column:
    """Element-wise change per second; zeros when no time has passed."""
    return F.when(seconds > 0, F.zip_with(current, previous, lambda c, p: v.finite((c - p) / seconds))).otherwise(
        F.transform(current, lambda _: F.lit(0.0)))


def angular_velocity(current: Column, previous: Column, seconds: Column) -> Column:
    """Rotation vector per second along the shorter way between two xyzw quaternions."""

    def unit(q):
        return let(q, lambda q: let(
            F.greatest(F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]), F.lit(1e-8)),
            lambda n: F.transform(q, lambda c: c / n)))

    def relative(z):
        a, p = z["a"], z["p"]
        ax, ay, az, aw, bw = a[0], a[1], a[2], a[3], p[3]
        bx, by, bz = -p[0], -p[1], -p[2]  # inverse of the previous rotation
        return F.array(
            aw * bx + bw * ax + (ay * bz - az * by), aw * by + bw * ay + (az * bx - ax * bz),
            aw * bz + bw * az + (ax * by - ay * bx), aw * bw - (ax * bx + ay * by + az * bz))

    def vector(r):
        length = F.sqrt(r[0] * r[0] + r[1] * r[1] + r[2] * r[2])
        factor = F.when(r[3] < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * 2.0 * F.atan2(
            length, F.least(F.abs(r[3]), F.lit(1.0))) / length / seconds
        return F.when((seconds <= 0) | (length < 1e-8), F.array(*[F.lit(0.0)] * 3)).otherwise(
            let(factor, lambda f: F.transform(F.slice(r, 1, 3), lambda c: v.finite(c * f))))

    pair = F.struct(unit(current).alias("a"), unit(previous).alias("p"))
    return let(let(pair, relative), vector)


def pose_velocity(current: Column, previous: Column, seconds: Column, at: int = 0) -> Column:
    """Linear then angular velocity of the pose that starts at 0-based element ``at``."""
    cut = lambda a, start, n: F.slice(a, start + 1, n)
    return F.concat(
        rate(cut(current, at, 3), cut(previous, at, 3), seconds),
        angular_velocity(cut(current, at + 3, 4), cut(previous, at + 3, 4), seconds),
    )


def modality_motion(kind: str, current: Column, previous: Column, seconds: Column) -> Column:
    """Motion vector of one modality; its width is fixed per modality."""
    cut = lambda a, start, n: F.slice(a, start + 1, n)
    if kind == "Eye":
        return F.concat(pose_velocity(current, previous, seconds, 2), pose_velocity(current, previous, seconds, 11))
    if kind == "Facial":
        return rate(cut(current, 0, 63), cut(previous, 0, 63), seconds)
    if kind in ("Head", "Body", "LeftHand", "RightHand"):
        return pose_velocity(current, previous, seconds)
    bone = lambda a, b: F.slice(a, 17 + 4 * b, F.lit(4))
    bones = F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(25)), lambda b: angular_velocity(bone(current, b), bone(previous, b), seconds)))
    return F.concat(
        rate(cut(current, 1, 1), cut(previous, 1, 1), seconds), pose_velocity(current, previous, seconds, 2),
        pose_velocity(current, previous, seconds, 9), bones, rate(cut(current, 125, 5), cut(previous, 125, 5), seconds),
    )


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add ``previous``: struct of ``columns`` of the preceding event of the same stream."""
    return Ordered(df, keys, order).neighbour(columns, "previous", -1).done()


def with_rates(df: DataFrame, keys: list[str], order: list[str], t: str, features: str = "features") -> DataFrame:
    """Append the rate of every feature; the first event of a stream gets zeros."""
    rows = with_previous(df, keys, order, [t, features])
    seconds = F.coalesce((F.col(t) - F.col(f"previous.{t}")) / F.lit(1000.0), F.lit(0.0))
    before = F.coalesce(F.col(f"previous.{features}"), F.col(features))
    return rows.withColumn("motion", rate(F.col(features), before, seconds)).drop("previous")


def with_motion(df: DataFrame, keys: list[str], order: list[str], t: str, kinds=tuple(MOTION_WIDTH)) -> DataFrame:
    """Base features followed by the motion vector of their modality.

    ``kinds`` are the modalities that occur; each adds its branch to the expression.
    """
    rows = with_previous(df, keys, order, [t, "features"])
    seconds = F.coalesce((F.col(t) - F.col(f"previous.{t}")) / F.lit(1000.0), F.lit(0.0))
    before, motion = F.coalesce(F.col("previous.features"), F.col("features")), None
    for kind in kinds:
        vector = modality_motion(kind, F.col("features"), before, seconds)
        test = F.col("event_type") == kind
        motion = F.when(test, vector) if motion is None else motion.when(test, vector)
    first = F.col("previous").isNull()
    width = F.create_map(*[F.lit(x) for pair in MOTION_WIDTH.items() for x in pair])[F.col("event_type")]
    motion = F.when(first, F.array_repeat(F.lit(0.0), width)).otherwise(motion)
    return rows.withColumn("features", F.concat("features", motion)).drop("previous")
