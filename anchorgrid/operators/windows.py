"""Anchor windows: which events lie around an anchor, and how far the nearest cue is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from anchorgrid.operators.ordered import Ordered

ANY = "both"


def attach_windows(
    anchors: DataFrame, events: DataFrame, *, by: list[str] = (), left: int | str, right: int | str,
    source: str = ANY, anchor_player: str = "player", event_player: str = "event_player",
    t_anchor: str = "t0", t_event: str = "t", bucket_ms: int,
) -> DataFrame:
    """Inner interval join: events with ``t0 - left <= t < t0 + right``.

    Both sides get time buckets of ``bucket_ms`` (about the window length). The anchor row is
    copied into the few buckets its window touches, an event has exactly one, so the range
    test becomes an equi-join with a residual filter and no pair comes out twice. Anchor
    columns and event columns must have different names except ``by``. For
    ``source='speaker'`` the player joins the equi-key. A hot (key, bucket) is split by AQE's
    skew join.
    """
    lo = F.col(t_anchor) - (F.lit(left) if isinstance(left, int) else F.col(left))
    hi = F.col(t_anchor) + (F.lit(right) if isinstance(right, int) else F.col(right))
    width = F.lit(bucket_ms)
    sided = anchors.withColumn("__lo", lo).withColumn("__hi", hi).filter(F.col("__hi") > F.col("__lo"))
    sided = sided.withColumn(
        "__bucket",
        F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor((F.col("__hi") - 1) / width))),
    )
    placed = events.withColumn("__bucket", F.floor(F.col(t_event) / width))
    keys = ["__bucket", *by]
    residual = [F.col(t_event) >= F.col("__lo"), F.col(t_event) < F.col("__hi")]
    condition = [sided[k] == placed[k] for k in keys]
    if source == "speaker":
        condition.append(sided[anchor_player] == placed[event_player])
    joined = sided.join(placed, _all(condition), "inner")
    for k in keys:
        joined = joined.drop(placed[k])
    if source == "listener":
        residual.append(F.col(anchor_player) != F.col(event_player))
    return joined.filter(_all(residual)).drop("__bucket", "__lo", "__hi")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def all_word_windows(
    words: DataFrame, events: DataFrame, sizes: list[tuple[int, int]], **options
) -> DataFrame:
    """Windows of every word for several sizes, label ``none``: an unlabelled corpus.

    The sizes are a literal array, so they add no join of their own.
    """
    pairs = F.array(*[F.struct(F.lit(l).alias("left"), F.lit(r).alias("right")) for l, r in sizes])
    sized = words.withColumn("__size", F.explode(pairs)).select(
        "*", F.col("__size.left").alias("left_ms"), F.col("__size.right").alias("right_ms")
    ).drop("__size").withColumn("label", F.lit("none"))
    return attach_windows(sized, events, left="left_ms", right="right_ms", **options)


def nearest_distance(
    points: DataFrame, references: DataFrame, *, t: str, by: list[str] = (), id_column: str
) -> DataFrame:
    """Add ``distance_ms`` to the nearest reference in time, null when there is none.

    Both sides are put on one time line per ``by`` key; the last and the next reference time
    are carried along it. With no key all experiments share one clock and the line is cut
    into segments when it is long.
    """
    by = list(by)
    refs = references.select(*by, F.col(t)).distinct().select(
        *by, F.col(t), F.lit(0).alias("__kind"), F.col(t).alias("__ref")
    )
    line = points.withColumn("__kind", F.lit(1)).withColumn("__ref", F.lit(None).cast("bigint"))
    line = line.unionByName(refs, allowMissingColumns=True)
    found = (
        Ordered(line, by, [t, "__kind", id_column])
        .carried(F.col("__ref"), "__before", -1)
        .carried(F.col("__ref"), "__after", 1)
        .done()
    )
    return found.filter(F.col("__kind") == 1).withColumn(
        "distance_ms", F.least(F.col(t) - F.col("__before"), F.col("__after") - F.col(t))
    ).drop("__kind", "__ref", "__before", "__after")


def scope_of_cues(cues: DataFrame, words: DataFrame, min_distance_ms: int = 1100) -> DataFrame:
    """(cue_id, word_id, distance_ms): own scope words far enough from their cue.

    cues: cue_id, cue_ms, neg array<struct<scope_tokens:array<id>>>; words: word_id, time_ms.
    """
    own = cues.select("cue_id", "cue_ms", F.explode("neg").alias("__n")).select(
        "cue_id", "cue_ms", F.explode("__n.scope_tokens").alias("word_id")
    ).filter(F.col("word_id").isNotNull()).distinct()
    joined = own.join(words.select("word_id", "time_ms"), "word_id")
    distance = F.abs(F.col("time_ms") - F.col("cue_ms"))
    return joined.withColumn("distance_ms", distance).filter(distance >= min_distance_ms).select(
        "cue_id", "word_id", "distance_ms"
    )


SOURCES = ("speaker", "listener", "both")


def window_sums(
    anchors: DataFrame, events: DataFrame, windows: Sequence[tuple[int, int]], sums: dict[str, Column], *, source: str = ANY,
    anchor_player: str = "player", event_player: str = "event_player", anchor_id: str = "anchor_id", t_anchor: str = "t0", t_event: str = "t",
) -> DataFrame:
    """(anchor_id, left_ms, right_ms, sums): sums over the events with ``t0 - left <= t < t0 + right``, without one anchor-event pair.

    Hopping windows share their borders: each different border of an anchor is one mark on the time line of the events, and
    a window is the running sum at its end less the one at its start. So the work is events plus anchors x borders, however
    many events a window holds. ``listener`` is ``both`` less ``speaker``.
    """
    if source == "listener":
        parts = [window_sums(anchors, events, windows, sums, source=s, anchor_player=anchor_player, event_player=event_player,
                             anchor_id=anchor_id, t_anchor=t_anchor, t_event=t_event) for s in ("both", "speaker")]
        at = [anchor_id, "left_ms", "right_ms"]
        joined = parts[0].join(parts[1].select(*at, *[F.col(n).alias(f"__{n}") for n in sums]), at)
        return joined.select(*at, *[(F.col(n) - F.col(f"__{n}")).alias(n) for n in sums])
    borders = sorted({b for left, right in windows for b in (-left, right)})
    keys = ["__player"] if source == "speaker" else []
    totals = events.groupBy(*([F.col(event_player).alias("__player")] if keys else []), F.col(t_event).alias("__t")).agg(*[F.sum(c).alias(f"__v_{n}") for n, c in sums.items()])
    # one row for each time, so the order is the same whenever the plan is read; what lies on a border belongs behind it
    line = totals.select(*keys, "__t", F.lit(1).alias("__kind"), F.lit(None).cast(dict(anchors.dtypes)[anchor_id]).alias("__id"), F.lit(0).cast("bigint").alias("__b"), *[f"__v_{n}" for n in sums])
    nothing = [F.lit(0).cast(dict(totals.dtypes)[f"__v_{n}"]).alias(f"__v_{n}") for n in sums]
    marks = anchors.select(
        F.col(anchor_player).alias("__player"), F.explode(F.array(*[F.lit(b).cast("bigint") for b in borders])).alias("__b"), F.col(t_anchor).alias("__t0"),
        F.col(anchor_id).alias("__id")).select(*keys, (F.col("__t0") + F.col("__b")).alias("__t"), F.lit(0).alias("__kind"), "__id", "__b", *nothing)
    run = Ordered(marks.unionByName(line), keys, ["__t", "__kind", "__id", "__b"]).running({n: F.col(f"__v_{n}") for n in sums}).done()
    upto = run.filter("__kind = 0").groupBy(F.col("__id").alias(anchor_id)).agg(
        F.map_from_entries(F.collect_list(F.struct("__b", F.struct(*sums)))).alias("__m"))
    spans = F.array(*[F.struct(F.lit(left).cast("bigint").alias("left_ms"), F.lit(right).cast("bigint").alias("right_ms")) for left, right in windows])
    rows = upto.select(anchor_id, "__m", F.explode(spans).alias("w")).select(anchor_id, "w.*", F.try_element_at("__m", F.col("w.right_ms")).alias("__z"), F.try_element_at("__m", -F.col("w.left_ms")).alias("__a"))
    return rows.select(anchor_id, "left_ms", "right_ms", *[(F.col(f"__z.{n}") - F.col(f"__a.{n}")).alias(n) for n in sums])


def window_grid(spark: SparkSession, size_ms: int = 1000, step_ms: int = 500, per_source: int = 10) -> DataFrame:
    """Sliding window settings: ``per_source`` hops per event source, in (left, right) ms.

    Hop i covers ``[start, start + size)`` with ``start = (i - per_source/2) * step``; a window
    fully after the anchor has a negative left distance.
    """
    frame = spark.range(per_source).withColumn("source", F.explode(F.array(*[F.lit(s) for s in SOURCES])))
    start = (F.col("id") - per_source // 2) * step_ms
    return frame.select("source", (-start).alias("left_ms"), (start + size_ms).alias("right_ms"))
